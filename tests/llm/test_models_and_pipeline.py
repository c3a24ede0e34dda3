import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fewlabel.llm import jaccard_join as jj
from fewlabel.llm import quality as qu
from fewlabel.llm import toxicity as tox
from fewlabel.llm.common import table
from tests.llm.helpers import SF_CHECK, SF_SMALL, awkward, doc_frame


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, quality int, toxic int, y int")


@pytest.fixture(scope="module")
def big(spark):
    d = "/root/testdata/sf0.1"
    return table(spark, d, "documents"), table(spark, d, "labels")


def test_toxicity_held_out(spark, big):
    docs, lab = big
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    model = tox.fit(docs, lab.where(half))
    got = tox.severity(docs, model).join(lab.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert got[got.y == 1].toxic.mean() > 0.85 and got[got.y == 0].toxic.mean() < 0.02
    assert (np.diff(model.cuts) > 0).all() and got.severity.between(0, tox.GRADES).all()
    graded = got[got.y == 1]
    assert graded.severity.mean() > got[got.y == 0].severity.mean() + 0.5


def test_ordinal_gradient_and_order():
    """The fit recovers weights and cuts of data drawn from the model."""
    rng = np.random.default_rng(0)
    n, k = 4000, 3
    x = rng.standard_normal((n, k))
    w, cuts = np.array([2.0, -1.0, 0.0]), np.array([-1.0, 0.5, 2.0])
    z = x @ w + rng.logistic(size=n)
    grade = (z[:, None] > cuts[None, :]).sum(axis=1)
    rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    got_w, got_c = tox.fit_ordinal(rows, cols, x.ravel(), grade, k, l2=0.0, steps=600, rate=0.05)
    assert np.allclose(got_w, w, atol=0.15) and np.allclose(got_c, cuts, atol=0.15)
    m = tox.OrdinalModel(["a"], got_w, got_c)
    assert (np.diff(m.severity(np.array([-3.0, 0.0, 3.0]))) > 0).all()


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    none = tox.fit(docs, labels(spark, [(1, 1, 0), (99, 1, 1), (5, 0, None), (6, 1, 7)]))
    got = tox.severity(docs, none)
    assert got.count() == docs.count() and got.where("toxic or severity > 0.001").count() == 0
    assert tox.severity(doc_frame(spark, []), none).count() == 0
    rude = doc_frame(spark, [(i, f"word{i} moron here" if i % 2 else f"word{i} kind here") for i in range(400)] + [(None, "moron moron"), (1000, None)])
    model = tox.fit(rude, labels(spark, [(i, 1, i % 2) for i in range(400)] + [(3, 1, 0), (None, 1, 1)]))
    kept = tox.without_toxic(rude, model)
    assert kept.columns == rude.columns and kept.where("text like '%moron%'").count() == 0 and kept.count() == 201


def test_quality_held_out_and_compiled_rules(spark, big):
    docs, lab = big
    model = qu.fit(docs, lab)
    got = qu.quality(docs, model).join(lab.select("doc_id", F.col("quality").alias("y")), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.y).mean() > 0.97 and got.score.between(0, 1).all()
    stats = qu.with_statistics(docs.limit(200), {"doc_id": "bigint"}).withColumn("score", model.score())
    for r in stats.collect():
        assert math.isclose(r.score, model.score_row(r.asDict()), abs_tol=1e-9)


def test_quality_never_sees_held_out_labels(spark, big):
    docs, lab = big
    docs, lab = docs.where("doc_id < 1500"), lab.where("doc_id < 1500")
    wrong = lab.withColumn("quality", F.when(qu.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert qu.fit(docs, lab) == qu.fit(docs, wrong)


def test_statistics_equal_plain_python(spark):
    docs = awkward(spark).unionByName(doc_frame(spark, [(50, "A b!\nb b 12 a|b b"), (51, "x")]))
    for r in qu.with_statistics(docs, {"doc_id": "bigint"}).join(docs.select("doc_id", "text").distinct(), "doc_id").distinct().collect():
        raw = (r.text or "").encode()
        w = raw.lower().split()
        assert math.isclose(r.log_words, math.log1p(len(w))) and math.isclose(r.log_bytes, math.log1p(len(raw)))
        assert math.isclose(r.s_digit, sum(48 <= c <= 57 for c in raw) / max(1, len(raw)))
        assert math.isclose(r.distinct, len(set(w)) / max(1, len(w)))
        assert math.isclose(r["repeat"], sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w)), abs_tol=1e-12)
        assert math.isclose(r.top_word, max((w.count(x) for x in set(w)), default=0) / max(1, len(w)))
        assert math.isclose(r.word_bytes, sum(map(len, w)) / max(1, len(w)))


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    one = qu.fit(docs, labels(spark, [(1, 1, 0), (6, 1, 0), (5, None, 0), (3, 9, 0)]))
    got = qu.quality(docs, one)
    assert got.count() == docs.count() and got.where("predicted = 1 and score > 0.99").count() == docs.count()
    none = qu.quality(docs, qu.fit(docs, labels(spark, [])))
    assert none.where("score = 0.5 and predicted = 0").count() == docs.count()
    assert none.where("doc_id is null and held_out").count() == 0
    assert qu.quality(doc_frame(spark, []), one).count() == 0


def test_tree_rules_keep_the_tightest_bounds():
    text = "Tree\n  If (feature 0 <= 2.5)\n   If (feature 0 <= 1.5)\n    Predict: 0.0\n   Else (feature 0 > 1.5)\n    Predict: 1.0\n  Else (feature 0 > 2.5)\n   Predict: 1.0\n"
    name, inf = qu.STATS[0], math.inf
    assert {r.bounds for r in qu.tree_rules(text)} == {((name, -inf, 2.5),), ((name, -inf, 1.5),), ((name, 1.5, 2.5),), ((name, 2.5, inf),)}


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF_CHECK, "documents")
    seen, cur = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, SF_CHECK)
        if name != "encoding":
            assert cur.columns == docs.columns and [t for _, t in cur.dtypes] == [t for _, t in docs.dtypes]
        cur = spark.createDataFrame(cur.collect(), cur.schema)
        seen[name] = cur
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["toxicity"] > ids["near_duplicates"] > ids["decontamination"] == ids["secrets"] == ids["encoding"]
    classes = jj.similar_classes(seen["toxicity"])
    assert ids["near_duplicates"] == {r.component_id for r in classes.collect()}
    assert seen["secrets"].where("text like '%[SECRET]%' and n_chars = length(text)").count() > 0
    assert seen["encoding"].where("not lossless").count() == 0
    toxic = {r.doc_id for r in table(spark, SF_CHECK, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, SF_CHECK, "labels").where("toxic = 0").collect()}
    assert len(ids["toxicity"] & toxic) < 0.4 * len(toxic) and len(clean - ids["toxicity"]) < 0.03 * len(clean)


def test_pipeline_of_awkward_documents(spark, tmp_path):
    for name, df in (("documents", awkward(spark)), ("labels", labels(spark, [(1, 1, 0)])),
                     ("benchmark", spark.createDataFrame([(1, "x")], "item_id bigint, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.where("not lossless").count() == 0
    keys = sorted(((r.doc_id, r.n_pieces) for r in got.collect()), key=str)
    assert len(keys) == 10 and (5, 1) not in keys  # the item went, and the second row of each repeated pair


def test_one_run_per_stage_is_the_query(spark):
    from fewlabel.llm import queries as q
    want = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in q.QUERIES["pipeline"](spark, SF_SMALL).collect()} == want


def test_a_repeated_doc_id_does_not_widen_the_sample(spark):
    docs = doc_frame(spark, [(1, f"text {i}") for i in range(5000)] + [(i, f"other {i}") for i in range(2, 30)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)], "doc_id bigint, quality int, toxic int")
    sample = tox.labelled_sample(docs, labels, "toxic", 20).collect()
    assert len(sample) <= 20 and len({r.doc_id for r in sample}) == len(sample)
