"""TSV round trips with the edge cases of card S1 (null tokens fold to '')."""

import uuid

from fewlabel.session import scratch_path
from fewlabel.sources import tsv

EDGE = ["", "NA", "null", "na", "  blanks  ", 'say "hi"', "tab\there", "line\r\nbreak", "trailing\\",
        "None", "-", "plain"]


def test_examples_tsv_round_trip(spark):
    rows = [(str(i), "Argument_for", s, "topic with space") for i, s in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "id string, annotation string, sentence string, topic string")
    path = scratch_path(spark, f"test-io-{uuid.uuid4().hex}/train.tsv")
    tsv.write_examples_tsv(df, path)
    back = {r.id: r for r in tsv.read_examples_tsv(spark, path).collect()}
    assert len(back) == len(EDGE)
    for i, s in enumerate(EDGE):
        want = "" if s in tsv.NULL_TOKENS else s
        assert back[str(i)].sentence == want, (s, back[str(i)].sentence)
        assert back[str(i)].topic == "topic_with_space"


def test_merge_files_ignores_other_extensions(spark):
    base = scratch_path(spark, f"test-merge-{uuid.uuid4().hex}")
    a = spark.createDataFrame([("1", "x", "A")], "id string, sentence string, annotation string")
    b = spark.createDataFrame([("2", "y")], "id string, sentence string")
    tsv.write_examples_tsv(a, f"{base}/a.tsv")
    tsv.write_examples_tsv(b, f"{base}/b.TSV")
    a.write.json(f"{base}/c.json")
    m = tsv.merge_files(spark, base)
    assert m.columns == ["annotation", "id", "sentence"]
    assert sorted((tuple(r) for r in m.collect()), key=lambda r: r[1]) == [("A", "1", "x"), (None, "2", "y")]


def test_file_fingerprint_reads_no_file_and_sees_a_changed_one(spark):
    from pyspark.sql import functions as F

    from fewlabel.sources import cache
    base = scratch_path(spark, f"test-fp-{uuid.uuid4().hex}")
    df = spark.range(1000).withColumn("part", F.col("id") % 3)
    df.write.partitionBy("part").parquet(base)
    first = cache.file_fingerprint(spark, base)
    assert cache.file_fingerprint(spark, base) == first
    one = df.where("part = 1").drop("part").withColumn("id", F.when(F.col("id") == 1, 0).otherwise(F.col("id")))
    one.write.mode("overwrite").parquet(f"{base}/part=1")
    assert cache.file_fingerprint(spark, base) != first


def _awkward_rows(n):
    texts = ["plain", "two\nlines", 'say "hi"', "tab\there", "\n\n", '"', "line\r\nbreak", "", None, "x" * 300, "a\n" * 40 + "b", 'q"\n"q']
    return [(str(i), texts[i % len(texts)], "last") for i in range(n)]


def test_one_large_quoted_file_is_read_by_many_tasks(spark):
    """Splits of a few hundred bytes: records, quotes and line breaks lie over their ends."""
    from fewlabel.sources import quoted
    rows = _awkward_rows(2000)
    df = spark.createDataFrame(rows, "id string, sentence string, topic string")
    path = scratch_path(spark, f"test-split-{uuid.uuid4().hex}")
    tsv.write_examples_tsv(df.coalesce(1), path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = sorted((i, "" if t is None else t, x) for i, t, x in rows)
    try:
        for size in ("511", "97", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            lines = quoted._lines(spark, path, False)
            if size != "128m":
                assert lines.rdd.getNumPartitions() > 20
                assert quoted.splits_inside_quotes(lines)
            got = tsv.read_headerless(spark, path, ["id", "sentence", "topic"], skip_header=True)
            assert sorted((r.id, r.sentence or "", r.topic) for r in got.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_and_header_only_files(spark):
    base = scratch_path(spark, f"test-empty-{uuid.uuid4().hex}")
    df = spark.createDataFrame([], "id string, sentence string")
    tsv.write_examples_tsv(df.coalesce(1), f"{base}/a.tsv")
    assert tsv.read_headerless(spark, f"{base}/a.tsv", ["id", "sentence"], skip_header=True).count() == 0


def test_lines_are_cut_once_where_no_record_lies_over_a_split(spark):
    """Fragments are looked for only in files whose splits begin or end inside quotes."""
    from fewlabel.sources import quoted
    path = scratch_path(spark, f"test-cut-{uuid.uuid4().hex}")
    rows = [("a", 'say "hi"'), ("b", "two\nlines"), ("c", None), ("d", "\t")]
    tsv.write_examples_tsv(spark.createDataFrame(rows, "id string, sentence string").coalesce(1), path)
    got = quoted.records(spark, path)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [(r.first, r.record) for r in got.collect()] == [
        (True, "id\tsentence"), (False, 'a\t"say ""hi"""'), (False, 'b\t"two\nlines"'), (False, "c\t"), (False, 'd\t"\t"')]
