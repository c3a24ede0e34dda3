"""TSV / CSV / JSON readers and writers for example and augmentation tables.

Spark writes a table as a folder of part files; a path such as ``train.tsv``
is that folder.  Text may hold tabs, quotes and newlines, so both sides quote
with doubled quotes and keep edge blanks.  Large files are split (``sources.quoted``).
"""

from __future__ import annotations

import csv
import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fewlabel.session import stored
from fewlabel.sources.quoted import read_quoted, records

# Tokens the examples reader folds to the empty string (the
# default NA set of the pandas CSV reader).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

EXAMPLE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "annotation", "sentence", "topic")])
AUGMENTATION_SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("params", T.StringType()),
                                    T.StructField("id", T.StringType()), T.StructField("sentence", T.StringType())])

TSV_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def fold_nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL and any null token -> '' in string columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = [F.lit(t) for t in tokens]
    return df.withColumns({c: F.when(F.col(c).isNull() | F.col(c).isin(*toks), F.lit("")).otherwise(F.col(c))
                           for c in cols})


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_examples_tsv(spark: SparkSession, path: str, schema: T.StructType = EXAMPLE_SCHEMA,
                      null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Examples TSV with header; null tokens become ''; spaces in topic become '_'."""
    df = fold_nulls(read_quoted(spark, path, schema, TSV_OPTIONS).drop("_file"), null_tokens)
    if "topic" in df.columns:
        df = df.withColumn("topic", F.replace(F.col("topic"), F.lit(" "), F.lit("_")))
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with a header; quoted fields may hold separators and newlines."""
    return read_quoted(spark, path, _struct(schema), {**TSV_OPTIONS, "sep": sep}, header).drop("_file")


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**TSV_OPTIONS).option("sep", sep).option("header", "true").csv(path)


def write_examples_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None,
                       mode: str = "overwrite", header: bool = True) -> None:
    """TSV with header, projected to ``columns`` (no index column)."""
    out = df.select(*columns) if columns else df
    out.write.mode(mode).options(**TSV_OPTIONS).option("header", str(header).lower()).csv(path)


def file_stem(path: Column) -> Column:
    """Last path part up to its first dot."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))


def read_augmentations_dir(spark: SparkSession, path: str, schema: T.StructType = AUGMENTATION_SCHEMA,
                           null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """All augmentation TSVs under ``path`` as one table with ``aug_name``.

    ``aug_name`` is the ``aug_name=...`` folder when written partitioned,
    else the stem of the file (or of its parent folder for Spark part files)."""
    df = read_quoted(spark, path, schema, TSV_OPTIONS, recursive=True).withColumnRenamed("_file", "_path")
    part = F.regexp_extract("_path", "aug_name=([^/]+)/", 1)
    parent = F.element_at(F.split("_path", "/"), -2)
    own = F.element_at(F.split("_path", "/"), -1)
    stem = F.when(own.startswith("part-"), file_stem(parent)).otherwise(file_stem(own))
    name = F.when(part != "", F.expr("url_decode(regexp_extract(_path, 'aug_name=([^/]+)/', 1))")).otherwise(stem)
    return fold_nulls(df.withColumn("aug_name", name).drop("_path"), null_tokens, ["params", "id", "sentence"])


def write_augmentations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One TSV folder per augmentor (``aug_name=...``) with ``n, params, id, sentence``."""
    (df.select("aug_name", "n", "params", "id", "sentence").write.mode(mode).partitionBy("aug_name")
     .options(**TSV_OPTIONS).option("header", "true").csv(path))


def read_headerless(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t",
                    skip_header: bool = False) -> DataFrame:
    """Delimited file read with given column names (all strings); with
    ``skip_header`` the file's own header line is dropped and replaced."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return read_quoted(spark, path, schema, {**TSV_OPTIONS, "sep": sep}, skip_header).drop("_file")


# Declared types of the business-review JSON lines.
REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()), T.StructField("stars", T.LongType()),
    T.StructField("date", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("useful", T.LongType()), T.StructField("funny", T.LongType()),
    T.StructField("cool", T.LongType())])


def read_reviews_json(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    """JSON lines with declared types (no inference)."""
    return spark.read.schema(schema).json(path)


def merge_files(spark: SparkSession, path: str, glob: str = "*.[tT][sS][vV]") -> DataFrame:
    """Union by name of every matching TSV (a file, or a folder that Spark wrote) directly under ``path``; a column
    missing in one input is NULL there; columns in sorted order.

    One scan over all inputs; the driver sees their distinct headers, each of which is one branch of the
    plan however many files have it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    own = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.regexp_replace(own, "^.*?" + re.escape(re.sub("^[a-z]+:/*", "/", path).rstrip("/")) + "/", "")
    top = F.element_at(F.split(below, "/"), 1)
    name = F.element_at(F.split(below, "/"), -1)
    inputs = found.where(top.rlike(f"^{fnmatch.translate(glob)}") & ~name.rlike("^[_.]")).select(top.alias("top")).distinct()
    names = sorted(r["top"] for r in inputs.collect())  # a listing, not data
    if not names:
        raise FileNotFoundError(f"no input matching {glob} under {path}")
    every = records(spark, [f"{path.rstrip('/')}/{n}" for n in names])
    headers = stored(every.where("first").select("file", F.col("record").alias("header")), "headers")
    out = None
    for (line,) in headers.select("header").distinct().collect():  # the distinct headers
        cols = next(csv.reader([line], delimiter="\t"))
        rows = every.where("not first").join(headers.where(F.col("header") == line).select("file"), "file", "left_semi")
        schema = ", ".join(f"`{c}` string" for c in cols)
        df = rows.select(F.from_csv("record", schema, {**TSV_OPTIONS, "multiLine": "true", "mode": "FAILFAST"}).alias("r")).select("r.*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
