"""Property tests on the test tables and on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from fewlabel.functions import numeric as N
from fewlabel.operators import budget, features, prepare, ranks, sampling, ssl, tasks
from fewlabel.operators.augment import plan as P
from fewlabel.plans.fixtures import examples, labelled
from tests.conftest import SF_CHECK, SF_SMALL


def test_exact_rank_equals_plain_window_and_ignores_partitioning(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("k", F.md5(F.concat(F.lit("s:"), "id")))
    from pyspark.sql import Window
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    a = ranks.exact_rank(df, ["k", "id"], partition_by=["g"], name="r")
    b = ranks.exact_rank(df.repartition(7), ["k", "id"], partition_by=["g"], name="r")
    want = {(r.id, r.r) for r in plain.collect()}
    assert {(r.id, r.r) for r in a.collect()} == want
    assert {(r.id, r.r) for r in b.collect()} == want


def test_exact_rank_global_by_value_range(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 101).alias("v"), F.col("id"))
    for n in (None, 1, 16):
        got = ranks.range_rank(df, ["v", "id"], name="r", n=n)
        rows = sorted((r.v, r.id, r.r) for r in got.collect())
        assert [r[2] for r in rows] == list(range(1, 501))


def test_range_rank_in_groups_with_nulls(spark):
    from pyspark.sql import Window
    rows = [(None if i % 4 == 3 else "ab"[i % 2], None if i % 5 == 0 else i * 7 % 11, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = ranks.range_rank(df, ["v", "id"], ["g"], "r", 7)
    assert sorted(got.columns) == sorted(want.columns)
    assert {tuple(r) for r in got.select("g", "v", "id", "r").collect()} == {tuple(r) for r in want.collect()}
    assert ranks.range_rank(df.where("id < 0"), ["v", "id"], ["g"], "r").count() == 0


def test_carve_splits_exact_disjoint_and_conserving(spark):
    ex = examples(spark, SF_CHECK)
    out = prepare.carve_splits(ex, [("train", 10), ("val", 10), ("test", 10)], seed=42)
    assert out.count() == ex.count()
    assert out.select("id").distinct().count() == ex.count()
    c = {(r.split, r.annotation): r.n for r in prepare.class_counts(out).collect()}
    for cls in tasks.TASKS["SL3"].labels:
        assert c[("train", cls)] == 10 and c[("val", cls)] == 10 and c[("test", cls)] == 10
    assert sum(c.values()) == ex.count()


def test_splits_keep_rows_with_nulls(spark):
    rows = [(str(i), None if i % 5 == 0 else "ab"[i % 2], None if i % 7 == 0 else f"t{i % 3}", None if i % 4 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, annotation string, topic string, ord bigint")
    carved = prepare.carve_splits(df, [("train", 5), ("test", 3)])
    assert {r.id for r in carved.collect()} == {r[0] for r in rows} and carved.count() == 60
    assert carved.where("split = 'UNL'").count() == 60 - 16
    held = prepare.topic_holdout(df, "t1", 0.25)
    c = {r.split: r["count"] for r in held.groupBy("split").count().collect()}
    n_test = sum(r[2] == "t1" for r in rows)
    assert c == {"test": n_test, "train": int(0.75 * (60 - n_test)), "val": 60 - n_test - int(0.75 * (60 - n_test))}
    kept = budget.label_budget(df, 15, balance=True)
    assert sorted((r["count"] for r in kept.groupBy("annotation").count().collect())) == [5, 5, 5]
    first = [r.ord for r in kept.where("annotation = 'a'").collect()]
    assert None in first  # a NULL ordinal comes first, it is not lost


@pytest.mark.parametrize("n", [1, 7, 10, 97])
@pytest.mark.parametrize("parts", [(0.7, 0.1, 0.2), (0.1, 0.2, 0.7), (0.33, 0.33, 0.34), (0.8, 0.15, 0.05), (0.3, 0.6, 0.1)])
def test_fraction_split_cuts_at_exact_fractions(spark, n, parts):
    from fractions import Fraction
    df = spark.range(n).select(F.col("id").cast("string").alias("id"))
    got = {r.split: r["count"] for r in prepare.fraction_split(df, parts, ["a", "b", "c"]).groupBy("split").count().collect()}
    x, y = Fraction(str(parts[0])), Fraction(str(parts[0])) + Fraction(str(parts[1]))
    want = {"a": int(n * x), "b": int(n * y) - int(n * x), "c": n - int(n * y)}
    assert got == {k: v for k, v in want.items() if v}


def test_buckets_stay_even_with_an_extreme_value_and_a_hot_one(spark):
    df = spark.range(4000).select(F.when(F.col("id") == 7, 10 ** 9).when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("v"), F.col("id").cast("string").alias("id"))
    b = ranks.range_bucket(df, ["v", "id"], "b", 32).groupBy(F.shiftright("b", 33)).count().toPandas()["count"]
    assert b.max() < 3 * 4000 / 32
    got = ranks.range_rank(df, ["v", "id"], name="r", n=32)
    rows = sorted((r.v, r.id, r.r) for r in got.collect())
    assert [r[2] for r in rows] == list(range(1, 4001))


def test_length_buckets_keep_null_texts(spark):
    df = spark.createDataFrame([("1", None), ("2", "x"), ("3", "yy" * 50)], "id string, sentence string")
    assert sampling.length_buckets(df, 2, 0.5).count() == 3


def test_a_nan_score_never_wins(spark):
    from fewlabel.operators import runs
    df = spark.createDataFrame([("t", 1, float("nan")), ("t", 2, 0.5), ("t", 3, None)], "task string, run_id int, val_acc double")
    assert [r.run_id for r in runs.best_run_per_task(df, legacy_col=None).collect()] == [2]


def test_fraction_split_counts(spark):
    out = prepare.fraction_split(labelled(spark, SF_CHECK), [0.6, 0.2, 0.2], ["train", "val", "test"], 42)
    c = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 239, "val": 80, "test": 80}


def test_label_budget_rules(spark):
    rows = [(str(i), "a", i) for i in range(10)] + [(str(100 + i), "b", 100 + i) for i in range(2)]
    df = spark.createDataFrame(rows, "id string, annotation string, ord bigint")
    bal = budget.label_budget(df, 8, balance=True)
    c = {r.annotation: r["count"] for r in bal.groupBy("annotation").count().collect()}
    assert c == {"a": 4, "b": 2}          # class smaller than its quota keeps all
    assert {r.id for r in bal.where("annotation = 'a'").collect()} == {"0", "1", "2", "3"}  # file order
    prop = budget.label_budget(df, 6, balance=False)
    c = {r.annotation: r["count"] for r in prop.groupBy("annotation").count().collect()}
    assert c == {"a": 5, "b": 1}          # int(6*10/12)=5, int(6*2/12)=1
    with pytest.raises(ValueError):
        budget.label_budget(df, 13)
    with pytest.warns(UserWarning):
        budget.label_budget(df, 7, balance=True).count()


def test_class_weights_sum_to_one_and_missing_class_raises(spark):
    lab = labelled(spark, SF_CHECK)
    w = tasks.class_weights(lab, tasks.TASKS["SL3"].labels)
    assert abs(sum(r.weight for r in w.collect()) - 1) < 1e-5
    with pytest.raises(Exception):
        tasks.class_weights(lab, ["Argument_for", "Argument_against", "NoArgument", "Other"]).collect()


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([("1", "Nope")], "id string, annotation string")
    with pytest.raises(Exception):
        tasks.encode_labels(df, ["Argument_for"]).collect()


def test_tsa_schedule_increases_to_one(spark):
    t = [r.threshold for r in ssl.tsa_schedule(spark, 40, 3).orderBy("step").collect()]
    assert all(a < b for a, b in zip(t, t[1:]))
    assert abs(t[-1] - 1.0) < 1e-12 and t[0] > 1 / 3


def test_plan_has_46_and_116_rows_per_sentence():
    rows = P.plan_rows()
    assert sum(1 for r in rows if r[0] == "labelled") == 116
    assert sum(1 for r in rows if r[0] == "unlabelled") == 46


def _loop_truncate(a, b, L):
    while a + b > L:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_pair_budget_equals_one_at_a_time_loop(spark):
    combos = [(a, b, L) for a in range(16) for b in range(16) for L in range(0, 12)]
    df = spark.createDataFrame(combos, "a int, b int, L int")
    got = {}
    for L in range(12):
        ka, kb = features.pair_budget(F.col("a"), F.col("b"), L + 3)
        for r in df.where(F.col("L") == L).select("a", "b", ka.alias("ka"), kb.alias("kb")).collect():
            got[(r.a, r.b, L)] = (r.ka, r.kb)
    for (a, b, L), v in got.items():
        assert v == _loop_truncate(a, b, L), (a, b, L)


def test_encoded_lengths_and_masks(spark):
    df = spark.createDataFrame([("1", "Hello world, hello again!", "topic one", 0),
                                ("2", "", "", 1), ("3", " ".join(["w"] * 50), "t", 0)],
                               "id string, sentence string, topic string, label int")
    vocab = features.vocabulary(df, ["sentence", "topic"], max_size=100)
    for left in (False, True):
        enc = features.encode_features(df, vocab, 12, pad_on_left=left, pad_token_segment_id=4 if left else 0)
        rows = {r.id: r for r in enc.collect()}
        for r in rows.values():
            assert len(r.input_ids) == len(r.attention_mask) == len(r.token_type_ids) == 12
            assert sum(r.attention_mask) == sum(1 for x in r.input_ids if x != 0)
        real = [x for x, m in zip(rows["2"].input_ids, rows["2"].attention_mask) if m == 1]
        assert real == [2, 3, 3]                  # [CLS] [SEP] [SEP] for two empty texts
        assert sum(rows["3"].attention_mask) == 12  # truncated to max_length
    ids = {r.token: r.token_id for r in vocab.collect()}
    enc = {r.id: r for r in features.encode_features(df, vocab, 12).collect()}
    h, w, a, t, o = (ids[x] for x in ("hello", "world", "again", "topic", "one"))
    assert enc["1"].input_ids == [2, h, w, h, a, 3, t, o, 3, 0, 0, 0]
    assert enc["1"].token_type_ids == [0] * 6 + [1] * 3 + [0] * 3
    left = {r.id: r for r in features.encode_features(df, vocab, 12, pad_on_left=True,
                                                      pad_token_segment_id=4).collect()}
    assert left["1"].input_ids == [0, 0, 0, 2, h, w, h, a, 3, t, o, 3]
    assert left["1"].token_type_ids == [4] * 3 + [0] * 6 + [1] * 3
    assert left["1"].attention_mask == [0] * 3 + [1] * 9


def test_sample_branches_distinct_and_raises(spark):
    rows = [("a", "X", 0, "p"), ("a", "X", 1, "p"), ("a", "Y", 0, "p"), ("a", "Z", 0, "p"),
            ("b", "X", 0, "p"), ("b", "Y", 0, "p")]
    aug = spark.createDataFrame(rows, "id string, aug_name string, n bigint, params string")
    out = sampling.sample_branches(aug, 2, seed=1)
    got = out.collect()
    for i in ("a", "b"):
        names = [r.aug_name for r in got if r.id == i]
        assert len(names) == 2 and len(set(names)) == 2
        assert sorted(r.branch for r in got if r.id == i) == [0, 1]
    with pytest.raises(Exception):
        sampling.sample_branches(aug, 3, seed=1).collect()


def test_composite_steps_permutation_cycles(spark):
    lab = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    unl = spark.createDataFrame([(f"u{i}",) for i in range(23)], "id string")
    out = sampling.composite_steps(lab, unl, mu=2, len_mode="max")   # len = max(5, 11) = 11
    rows = out.collect()
    l_rows = sorted((r.step, r.id) for r in rows if r.side == "labelled")
    u_rows = sorted((r.step, r.slot, r.id) for r in rows if r.side == "unlabelled")
    assert len(l_rows) == 11 and len(u_rows) == 22
    first = [i for _, i in l_rows[:5]]
    assert sorted(first) == [str(i) for i in range(5)]          # a permutation before repeating
    assert len({i for _, _, i in u_rows[:23]}) == min(22, 23)
    empty = sampling.composite_steps(lab, unl.limit(1), mu=2, len_mode="min")
    assert empty.count() == 0


def test_pseudo_label_pairs_golden(spark):
    # id 1: branch 1 best (0.97) -> target 2; branch 0 agrees? no (pred 0) -> pair; branch 2 pred 2 -> no pair
    logit = {0: [3.0, 0.0, 0.0], 1: [0.0, 0.0, 5.0], 2: [0.0, 0.0, 4.0]}
    rows = [(1, b, v) for b, v in logit.items()] + [(2, 0, [1.0, 1.0, 1.0]), (2, 1, [1.0, 1.2, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, branch bigint, logits array<double>")
    sc = ssl.softmax_scores(df)
    pairs = ssl.pseudo_label_pairs(sc, 0.95, only_wrong=True)
    assert [(r.id, r.branch, r.target) for r in pairs.collect()] == [(1, 0, 2)]
    allp = ssl.pseudo_label_pairs(sc, 0.95, only_wrong=False)
    assert sorted((r.id, r.branch) for r in allp.collect()) == [(1, 0), (1, 2)]


def test_three_loss_means(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [2.0, 0.0], 0)], "label bigint, logits array<double>, mask int")
    w = spark.createDataFrame([(0, 0.25), (1, 0.75)], "label bigint, weight double")
    import math
    ce0, ce1 = math.log(2), 2 + math.log(1 + math.exp(-2))
    plain = ssl.eval_loss(df).first().loss
    weighted = ssl.weighted_loss(df, w).first().loss
    annealed = ssl.tsa_loss(df, w).first().loss
    assert abs(plain - (ce0 + ce1) / 2) < 1e-9
    assert abs(weighted - (0.25 * ce0 + 0.75 * ce1) / 1.0) < 1e-9
    assert abs(annealed - (0.25 * ce0 * 1 + 0.75 * ce1 * 0) / 2) < 1e-9


def test_macro_f1_uses_union_of_classes(spark):
    from fewlabel.operators import metrics
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 1), (1, 1)], "pred int, label int")
    m = metrics.classification_metrics(df, prefix="t").first()
    # class 0: tp1 sup1 pred2 -> 2/3; class 1: tp1 sup3 pred1 -> 0.5; class 2: tp0 -> 0
    assert abs(m.t_f1_macro - (2 / 3 + 0.5 + 0) / 3) < 1e-9
    assert abs(m.t_acc - 0.5) < 1e-9 and abs(m.t_f1_micro - 0.5) < 1e-9


def test_early_stop_cases(spark):
    from fewlabel.operators import metrics
    rows = []
    rows += [("tie", e, v) for e, v in enumerate([3.0, 2.0, 2.0, 2.0, 2.0])]       # equal is no improvement
    rows += [("flat", e, 1.0) for e in range(4)]
    rows += [("late", e, v) for e, v in enumerate([3.0, 3.0, 3.0, 1.0])]          # improves at the last check
    df = spark.createDataFrame(rows, "run_id string, epoch bigint, val_loss double")
    got = {r.run_id: r for r in metrics.early_stop(df, 2).collect()}
    assert got["tie"].stop_epoch == 3 and got["tie"].best_epoch == 1
    assert got["flat"].stop_epoch == 2 and got["flat"].best_epoch == 0
    assert got["late"].stop_epoch == 2 and got["late"].best_epoch == 0
    got3 = {r.run_id: r for r in metrics.early_stop(df, 3).collect()}
    assert got3["late"].stop_epoch is None and got3["late"].best_epoch == 3


def test_best_run_fills_task_from_legacy(spark):
    from fewlabel.operators import runs
    df = spark.createDataFrame([(1, None, "A", 0.5, 1.0), (2, "A", "A", 0.9, 2.0), (3, "B", "B", 0.1, 3.0),
                                (4, None, "B", 0.1, 4.0)],
                               "run_id bigint, task string, legacy_task string, val_acc double, test_acc double")
    got = {r.task: (r.run_id, r.test_acc) for r in runs.best_run_per_task(df).collect()}
    assert got == {"A": (2, 2.0), "B": (3, 3.0)}


def test_spearman_average_ranks(spark):
    from fewlabel.operators import metrics
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 3.0)], "x double, y double")
    r = metrics.correlation_metrics(df, "x", "y").first()
    # ranks x: 1, 2.5, 2.5, 4 ; y: 1, 2, 3.5, 3.5
    import statistics
    rx, ry = [1, 2.5, 2.5, 4], [1, 2, 3.5, 3.5]
    assert abs(r.spearmanr - statistics.correlation(rx, ry)) < 1e-9


def test_softmax_helpers(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>")
    r = df.select(N.argmax("x").alias("a"), N.max_prob("x").alias("p"),
                  F.aggregate(N.softmax("x"), F.lit(0.0), lambda a, b: a + b).alias("s")).first()
    assert r.a == 1 and abs(r.s - 1) < 1e-12
