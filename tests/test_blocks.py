"""Steps that meet a table by blocks, and row expressions that stay linear in the text."""

import hashlib
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from fewlabel.operators import features as FT
from fewlabel.operators.augment import augmentors as A
from fewlabel.operators.augment import plan as P


def test_a_text_is_split_once_for_its_target_map(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(5 * i)) or None) for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = E.queries()["target_map"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {r.doc_id: r.target_map for r in df.collect()}
    assert set(got) == set(range(1, 30))
    for i, m in got.items():
        assert len(m) == 5 * i + 2
        assert m.index("1") == int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) % (5 * i) + 2 and m.count("1") == 1


def test_one_hot(spark):
    df = spark.createDataFrame([(0, 3), (2, 3), (5, 3), (None, 2)], "p int, n int")
    assert [r[0] for r in df.select(FT.one_hot("p", "n")).collect()] == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [None, None]]


def _spec(n):
    return P.AugmentorSpec("SynonymAug", {"aug_p": [0.5, 1.0]}, {"labelled": n, "unlabelled": 1})


def test_substitution_by_the_rule(spark):
    """Whole texts against the rule written out, with a repeated id, a null text and a null id."""
    cands = {w: [f"{w}{c}" for c in "xyz"] + [w] for w in "abcdefgh"}
    table = spark.createDataFrame(list(cands.items()), "word string, cands array<string>")
    texts = [("1", "(A) b, c d-e f  g. h unknown"), ("2", None), ("3", "a b"), ("3", "a b"), (None, "h g")]
    ex = spark.createDataFrame([(i, t, "UNL") for i, t in texts], "id string, sentence string, annotation string")
    got = {(r.id, r.params): r.sentence for r in A.aug_synonym(ex, table, _spec(2)).collect()}

    def md5(*parts):
        return hashlib.md5(":".join(p for p in parts if p is not None).encode()).hexdigest()

    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append((t or "").split(" "))
    want = {}
    for i, lists in by_id.items():
        toks = sorted(((p, t) for ts in lists for p, t in enumerate(ts)), key=lambda x: x[0])
        for c in P.configs(_spec(2)):
            params = P.params_string(c)
            v, w = int(md5("42", "0", params)[:15], 16), int(md5("42", "0", params, "c")[:8], 16)
            spots = []
            for at, (p, t) in enumerate(toks):
                m = re.fullmatch(r"(\W*)(\w)(\W*)", t)
                if m and m[2].lower() in cands:
                    h = md5("42", i, str(p))
                    spots.append((int(h[:15], 16) ^ v, at, m, (int(h[15:23], 16) ^ w) % 3))
            out = [t for _, t in toks]
            if spots:
                bar = sorted(s[0] for s in spots)[max(1, int(c["aug_p"] * len(spots))) - 1]
                for key, at, m, d in spots:
                    if key <= bar:
                        out[at] = m[1] + m[2].lower() + "xyz"[d] + m[3]
            want[i, params] = " ".join(out)
    assert got == want


def test_tokens_are_not_shuffled_one_by_one(spark):
    """A text of one word repeated sends that word to the table once."""
    ex = spark.createDataFrame([("1", "a " * 5000, "UNL")], "id string, sentence string, annotation string")
    table = spark.createDataFrame([("a", ["b"])], "word string, cands array<string>")
    plan = A.aug_synonym(ex, table, _spec(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan
    assert A.aug_synonym(ex, table, _spec(1)).where(F.col("sentence").contains("b")).count() == 2


def test_texts_are_moved_once_to_their_blocks(spark):
    """The distinct words of a block are found where its texts lie."""
    ex = spark.createDataFrame([(str(i), f"a b{i % 7} c", "UNL") for i in range(60)], "id string, sentence string, annotation string")
    table = spark.createDataFrame([("a", ["b"])], "word string, cands array<string>")
    df = A.aug_synonym(ex, table, _spec(1))
    assert df.where(F.col("sentence").startswith("b b")).count() == 120
    plan = df._jdf.queryExecution().optimizedPlan()
    dealt = [str(p) for p in plan.toString().split("\n") if "RepartitionByExpression" in p and "_blk" in p]
    assert len(dealt) == 3  # the texts for both steps, and the lists
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        final = A.aug_synonym(ex, table, _spec(1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in final
