"""Views over the driver's test tables used by the registered queries.

Each view is given twice: as a Spark DataFrame builder and as DuckDB SQL (for the
oracles).  Both read only the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- ex (examples)
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, sentence, topic, ord, annotation)``: documents with a 3-class label
    from ``labels``; documents without a label are ``UNL``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    annotation = (F.when(F.col("quality").isNull(), F.lit("UNL"))
                  .when(F.col("toxic") == 1, F.lit("NoArgument"))
                  .when(F.col("quality") == 1, F.lit("Argument_for"))
                  .otherwise(F.lit("Argument_against")))
    return j.select(F.col("doc_id").cast("string").alias("id"),
                    F.col("text").alias("sentence"),
                    F.col("source").alias("topic"),
                    F.col("doc_id").alias("ord"),
                    annotation.alias("annotation"))


EX_SQL = """(select cast(d.doc_id as varchar) as id, d.text as sentence, d.source as topic,
       d.doc_id as ord,
       case when l.doc_id is null then 'UNL'
            when l.toxic = 1 then 'NoArgument'
            when l.quality = 1 then 'Argument_for'
            else 'Argument_against' end as annotation
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).where(F.col("annotation") != "UNL")


LAB_SQL = f"(select * from {EX_SQL} ex where annotation <> 'UNL')"


# ---------------------------------------------------------------- logits
LOGIT_SCALE = 20.0
N_BRANCHES = 7
N_CLASSES = 10


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, branch, label, logits array<double>)``: 7 branches x 10 classes cut from all 64
    values of each embedding (the last branch goes on with the first six) and scaled by 20."""
    e = table(spark, sf_dir, "embeddings")
    b = F.explode(F.sequence(F.lit(0), F.lit(N_BRANCHES - 1))).alias("branch")
    x = e.select("vec_id", "label", F.concat("embedding", F.slice("embedding", 1, 6)).alias("embedding"), b)
    sl = F.slice("embedding", F.col("branch") * N_CLASSES + 1, N_CLASSES)
    return x.select(F.col("vec_id").alias("id"), F.col("branch").cast("bigint").alias("branch"),
                    F.col("label").cast("bigint").alias("label"),
                    F.transform(sl, lambda v: v.cast("double") * F.lit(LOGIT_SCALE)).alias("logits"))


LOGITS_SQL = """(select vec_id as id, cast(b as bigint) as branch, cast(label as bigint) as label,
       list_transform(list_concat(embedding, embedding[1:6])[b*10+1 : b*10+10], lambda v: cast(v as double) * 20.0) as logits
  from embeddings, range(0, 7) t(b))"""


# ---------------------------------------------------------------- runs, series
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one row per event.  ``task`` is null for even ids and the
    legacy column carries it then."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("task"),
        F.col("event_type").alias("legacy_task"),
        (F.col("user_id") % 5).cast("string").alias("topic"),
        F.col("user_id").alias("experiment_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("deleted")).otherwise(F.lit("active")).alias("lifecycle_stage"),
        F.col("value").alias("val_acc"),
        F.get_json_object("props", "$.k").cast("double").alias("test_acc"),
        F.col("ts"))


RUNS_SQL = """(select event_id as run_id,
       case when event_id % 2 = 1 then event_type end as task,
       event_type as legacy_task,
       cast(user_id % 5 as varchar) as topic,
       user_id as experiment_id,
       case when event_id % 7 = 0 then 'deleted' else 'active' end as lifecycle_stage,
       value as val_acc,
       cast(json_extract_string(props, '$.k') as double) as test_acc,
       ts
  from events)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation-loss series: per user (run) the events ordered by (ts, id)
    are checks 0, 1, ...; the loss is ``value``."""
    from pyspark.sql import Window
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("user_id").alias("run_id"),
                     (F.row_number().over(w) - 1).cast("bigint").alias("epoch"),
                     F.col("value").alias("val_loss"))


SERIES_SQL = """(select user_id as run_id,
       row_number() over (partition by user_id order by ts, event_id) - 1 as epoch,
       value as val_loss
  from events)"""
