"""The registered queries of this folder: each applies one operator, with production
parameters, to its whole table.  ``ORACLE`` holds DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewlabel.llm import decontaminate as dc
from fewlabel.llm import exact_dedup as ed
from fewlabel.llm import html_text as ht
from fewlabel.llm import jaccard_join as jj
from fewlabel.llm import learned_ann as ann
from fewlabel.llm import piece_sampling as ps
from fewlabel.llm import quality as qu
from fewlabel.llm import role_repair as rr
from fewlabel.llm import secrets as sec
from fewlabel.llm import spelling as sp
from fewlabel.llm import token_counts as tc
from fewlabel.llm import toxicity as tox
from fewlabel.llm import warc_revisit as warc
from fewlabel.llm.common import piece_model, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tox.severity(docs, tox.fit(docs, table(spark, sf_dir, "labels")))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sec.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "entropy")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, sec.BASE_KINDS),
                        F.sha2(sec.span_list(base), 256).alias("base_sha256"),
                        sec.span_list(F.col("spans")).alias("spans"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jj.similar_classes(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return qu.quality(docs, qu.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.token_counts(table(spark, sf_dir, "documents"), piece_model())


@query("op6_piece_sampling")
def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.encode(table(spark, sf_dir, "documents"), piece_model())


@query("op7_learned_partitions")
def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query("op8_decontaminate", dc.containment_sql())
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.extract_text(table(spark, sf_dir, "pages"))


@query("op10_warc_revisits", warc.revisit_sql())
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.crawl_of_pages(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", F.unix_seconds("fetched").alias("fetched_s"), "type", "outcome", "refers_to",
                        warc.header_text(F.col("headers")).alias("headers"), "digest", "length")


@query("op11_exact_dedup", ed.equal_texts_sql())
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.equal_texts(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.variants(table(spark, sf_dir, "documents"))


@query("op13_role_repair")
def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr.repaired(rr.damaged(table(spark, sf_dir, "conversations")))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
