"""Queries: IO round trips (build step 4).  Each writes the source rows to a
fresh folder under the shared checkpoint folder and returns the read-back
table; the oracle is the source rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fewlabel.operators import metrics, prepare
from fewlabel.plans import q_features, q_sampling
from fewlabel.plans.fixtures import EX_SQL, LAB_SQL, examples, labelled, table
from fewlabel.plans.registry import query
from fewlabel.session import scratch_path
from fewlabel.sources import cache, tsv


def _scratch(spark, name):
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex}")


_TOKENS_SQL = ", ".join("'" + t + "'" for t in tsv.NULL_TOKENS)


@query("read_examples_tsv", f"""select id, annotation,
       case when sentence is null or sentence in ({_TOKENS_SQL}) then '' else sentence end as sentence,
       replace(topic, ' ', '_') as topic
  from (select id, annotation, sentence, 'topic ' || topic as topic from {EX_SQL} ex) t""")
def q_read_examples_tsv(spark, sf):
    ex = examples(spark, sf).withColumn("topic", F.concat(F.lit("topic "), F.col("topic")))
    path = _scratch(spark, "examples.tsv")
    tsv.write_examples_tsv(ex, path, ["id", "annotation", "sentence", "topic"])
    return tsv.read_examples_tsv(spark, path)


@query("write_examples_tsv", f"select id, annotation, sentence from {LAB_SQL} l")
def q_write_examples_tsv(spark, sf):
    path = _scratch(spark, "train.tsv")
    tsv.write_examples_tsv(labelled(spark, sf), path, ["id", "annotation", "sentence"])
    return tsv.read_headerless(spark, path, ["id", "annotation", "sentence"], skip_header=True)


@query("read_augmentations_dir", f"with {q_sampling.PLAN_SQL} select aug_name, n, params, id, sentence from aug")
def q_read_augmentations_dir(spark, sf):
    path = _scratch(spark, "augmentations_labelled")
    tsv.write_augmentations(q_sampling.aug_table(spark, sf), path)
    return tsv.read_augmentations_dir(spark, path).select("aug_name", "n", "params", "id", "sentence")


@query("read_csv", """select cast(doc_id as varchar) as id, text as sentence, source as topic from documents""")
def q_read_csv(spark, sf):
    path = _scratch(spark, "reviews.csv")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("sentence"), F.col("source").alias("topic"))
    tsv.write_csv(d, path)
    return tsv.read_csv(spark, path, "id string, sentence string, topic string")


@query("append_metrics", """select user_id as run_id, event_type as metric, event_id as step, value from events""")
def q_append_metrics(spark, sf):
    path = _scratch(spark, "metrics")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")
    for half in (0, 1):
        metrics.append_metrics(ev.where(F.col("step") % 2 == half).repartition("metric"), path)
    return spark.read.parquet(path).select("run_id", "metric", "step", "value")


@query("read_headerless", f"select id, sentence, annotation from {LAB_SQL} l")
def q_read_headerless(spark, sf):
    path = _scratch(spark, "sentences")
    tsv.write_examples_tsv(labelled(spark, sf), path, ["id", "sentence", "annotation"], header=False)
    return tsv.read_headerless(spark, path, ["id", "sentence", "annotation"])


@query("read_reviews_json", """select cast(doc_id as varchar) as id, cast(n_chars % 5 + 1 as varchar) as annotation,
       text as sentence, '' as topic
  from documents""")
def q_read_reviews_json(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("user_id"),
        F.col("lang").alias("business_id"), (F.col("n_chars") % 5 + 1).alias("stars"),
        F.lit("2020-01-01").alias("date"), "text", (F.col("doc_id") % 3).alias("useful"),
        F.lit(0).cast("bigint").alias("funny"), F.lit(1).cast("bigint").alias("cool"))
    path = _scratch(spark, "reviews.json")
    d.write.mode("overwrite").json(path)
    r = tsv.read_reviews_json(spark, path).select("review_id", "text", "stars")
    return prepare.prepare_reviews(r, {"review_id": "id", "text": "sentence", "stars": "annotation"})


@query("merge_files", f"""select annotation, id, sentence, topic from {LAB_SQL} l
union all
select null as annotation, id, sentence, null as topic from {EX_SQL} ex where annotation = 'UNL'""")
def q_merge_files(spark, sf):
    base = _scratch(spark, "topics")
    ex = examples(spark, sf)
    tsv.write_examples_tsv(ex.where("annotation <> 'UNL'"), f"{base}/labelled.tsv",
                           ["id", "annotation", "sentence", "topic"])
    tsv.write_examples_tsv(ex.where("annotation = 'UNL'"), f"{base}/unlabelled.TSV", ["id", "sentence"])
    ex.select("id").write.mode("overwrite").json(f"{base}/ids.json")   # not a TSV: ignored
    return tsv.merge_files(spark, base)


@query("feature_cache", q_features._encode_sql(False, 0))
def q_feature_cache(spark, sf):
    data = cache.file_fingerprint(spark, *[f"{sf.rstrip('/')}/{t}.parquet" for t in ("documents", "labels")])
    key = cache.cache_key("train", "models/words", q_features.MAX_LEN, "SL3", None, None, False, data=data)
    root = _scratch(spark, "cache")
    first, hit1 = cache.feature_cache(spark, key, lambda: q_features._encode(spark, sf, False, 0), root=root)
    second, hit2 = cache.feature_cache(spark, key, lambda: q_features._encode(spark, sf, False, 0), root=root)
    assert not hit1 and hit2, "feature cache miss then hit expected"
    return second
