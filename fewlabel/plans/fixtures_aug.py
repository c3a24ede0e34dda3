"""Candidate fixtures built from the documents table (so they scale with it).

* thesaurus: all words, put in a seeded hash order; a word's
  synonyms are the next three words of that order (scores 3, 2, 1);
* bilingual lexicons: all English words and all words of the pivot language, each in hash
  order; English rank ``r`` translates to pivot ranks ``r, r+1, r+2`` (mod the number of pivot
  words) with p = 0.5 / 0.3 / 0.2, and pivot rank ``q`` back to ``q, q-1, q-2`` (mod the number of
  English words), so every word of both sides has partners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewlabel.operators import features as FT
from fewlabel.operators.augment import candidates as C
from fewlabel.operators.ranks import range_rank
from fewlabel.plans.fixtures import table

# pivot languages of each model pair of the back-translation grid (the texts have no Russian)
PIVOTS = {"transformer.wmt19.en-de": ["de"], "transformer.wmt19.en-ru": ["es", "fr"]}
LEX_P = [0.5, 0.3, 0.2]


def _tok_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({col}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _ranked_words(docs: DataFrame, seed: str) -> DataFrame:
    """``(word, r)``: all words of the texts, numbered from 0 in a seeded hash order."""
    v = docs.select(F.explode(FT.tokenize("text")).alias("word")).distinct()
    v = v.withColumn("_h", F.unhex(F.md5(F.concat(F.lit(seed + ":"), F.col("word")))))  # the hash's bytes sort as its digits do
    return range_rank(v, ["_h", "word"], name="r").select("word", (F.col("r") - 1).alias("r"))


def _ranked_words_sql(where: str, seed: str) -> str:
    return f"""(select token as word,
           row_number() over (order by md5('{seed}:' || token), token) - 1 as r
      from (select distinct unnest({_tok_sql('text')}) as token from documents {where}) v)"""


def thesaurus_long(spark: SparkSession, sf: str) -> DataFrame:
    rw = _ranked_words(table(spark, sf, "documents"), "syn")
    n = F.lit(max(rw.count(), 1))
    a = rw.select("word", "r", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d"))
    a = a.withColumn("key", (F.col("r") + F.col("d")) % n)
    b = rw.select(F.col("word").alias("candidate"), F.col("r").alias("key"))
    return a.join(b, "key").select("word", "candidate", (F.lit(4) - F.col("d")).cast("bigint").alias("score"))


def thesaurus(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return C.ranked(thesaurus_long(spark, sf), ["word"], k)


THES_SQL = f"""rw as {_ranked_words_sql('', 'syn')},
thl as (select a.word, b.word as candidate, 4 - d as score
          from rw a, (values (1), (2), (3)) dd(d), rw b
         where b.r = (a.r + d) % (select count(*) from rw)),
thes as (select word, list(candidate order by score desc, candidate) as cands from thl group by word)"""


def lexicons(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``(forward, backward)`` with columns ``(model, src, tgt, p)``."""
    docs = table(spark, sf, "documents")
    en = _ranked_words(docs.where("lang = 'en'"), "en")
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(p).alias("p")) for i, p in enumerate(LEX_P)])).alias("x")

    def linked(src: DataFrame, tgt: DataFrame, model: str, sign: int) -> DataFrame:
        n = F.lit(max(tgt.count(), 1))
        s = src.select("word", "r", d).select("word", F.pmod(F.col("r") + sign * F.col("x.d"), n).alias("key"), F.col("x.p").alias("p"))
        return s.join(tgt.select(F.col("word").alias("tgt"), F.col("r").alias("key")), "key").select(
            F.lit(model).alias("model"), F.col("word").alias("src"), "tgt", "p")

    fw, bw = None, None
    for model, langs in PIVOTS.items():
        pivot = _ranked_words(docs.where(F.col("lang").isin(langs)), langs[-1])
        f, b = linked(en, pivot, model, 1), linked(pivot, en, model, -1)
        fw = f if fw is None else fw.unionByName(f)
        bw = b if bw is None else bw.unionByName(b)
    return fw, bw


def lexicon_sql() -> str:
    parts = [f"en as {_ranked_words_sql('where lang = \'en\'', 'en')}"]
    fws, bws = [], []
    pvals = ", ".join(f"({i}, {p})" for i, p in enumerate(LEX_P))
    for i, (model, langs) in enumerate(PIVOTS.items()):
        among = ", ".join(map(repr, langs))
        parts.append(f"pv{i} as {_ranked_words_sql(f'where lang in ({among})', langs[-1])}")
        fws.append(f"""select '{model}' as model, a.word as src, b.word as tgt, cast(dd.p as double) as p
  from en a, (values {pvals}) dd(d, p), pv{i} b
 where b.r = (a.r + dd.d) % (select count(*) from pv{i})""")
        bws.append(f"""select '{model}' as model, a.word as src, b.word as tgt, cast(dd.p as double) as p
  from pv{i} a, (values {pvals}) dd(d, p), en b
 where b.r = (a.r - dd.d + (select count(*) from en)) % (select count(*) from en)""")
    parts.append("fwd as (" + "\nunion all\n".join(fws) + ")")
    parts.append("bwd as (" + "\nunion all\n".join(bws) + ")")
    return ",\n".join(parts)
