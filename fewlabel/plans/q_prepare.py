"""Queries: clean splits, tasks and label budgets (build steps 1-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.operators import budget, prepare, tasks
from fewlabel.plans.fixtures import EX_SQL, LAB_SQL, examples, labelled, table
from fewlabel.plans.registry import query

SEED = 42
CARVE = [("train", 10), ("val", 10), ("test", 10)]
THREE = [tasks.ARGUMENT_FOR, tasks.ARGUMENT_AGAINST, tasks.NO_ARGUMENT]
KEY_SQL = "md5(concat_ws(':', '42', id))"


def carve(spark, sf):
    return prepare.carve_splits(examples(spark, sf), CARVE, seed=SEED)


CARVE_SQL = f"""with ex as {EX_SQL},
r as (select id, row_number() over (partition by annotation order by {KEY_SQL}, id) as rk
      from ex where annotation <> 'UNL'),
s as (select ex.*, case when rk <= 10 then 'train' when rk <= 20 then 'val'
                       when rk <= 30 then 'test' else 'UNL' end as split
      from ex left join r using (id))
"""


@query("carve_splits", CARVE_SQL + """select id, split,
       case when split = 'UNL' then 'UNL' else annotation end as annotation from s""")
def q_carve_splits(spark, sf):
    return carve(spark, sf).select("id", "split", "annotation")


@query("class_counts", CARVE_SQL + """select split,
       case when split = 'UNL' then 'UNL' else annotation end as annotation, count(*) as n
  from s group by all""")
def q_class_counts(spark, sf):
    return prepare.class_counts(carve(spark, sf), ["split", "annotation"])


@query("split_report", CARVE_SQL + """, c as (select split, count(*) as n from s group by split)
select split, n, round(n / (select count(*) from s), 6) as ratio,
       (sum(n) over () = (select count(*) from s))
         and ((select count(distinct id) from s) = (select count(*) from s)) as conserved
  from c""")
def q_split_report(spark, sf):
    return prepare.split_report(carve(spark, sf))


@query("compose_id", """select doc_id,
       source || cast(doc_id as varchar) || '_' || cast(n_chars as varchar) || '_'
         || cast(doc_id % 10 as varchar) as id
  from documents""")
def q_compose_id(spark, sf):
    d = table(spark, sf, "documents").withColumn("sentence_id", F.col("doc_id") % 10)
    return prepare.compose_id(d, "source", ["doc_id", "n_chars", "sentence_id"]).select("doc_id", "id")


# Raw annotation codes of the review data (with their leading space).
REVIEW_LABELS = {" NEG": "Argument_against", " POS": "Argument_for", " NA": "NoArgument"}


@query("recode_labels", """select cast(doc_id as varchar) as id,
       case when toxic = 1 then 'NoArgument' when quality = 1 then 'Argument_for'
            else 'Argument_against' end as annotation
  from labels""")
def q_recode_labels(spark, sf):
    lab = table(spark, sf, "labels")
    raw = lab.select(F.col("doc_id").cast("string").alias("id"),
                     F.when(F.col("toxic") == 1, F.lit(" NA")).when(F.col("quality") == 1, F.lit(" POS"))
                     .otherwise(F.lit(" NEG")).alias("annotation"))
    return prepare.recode_labels(raw, REVIEW_LABELS)


@query("prepare_unlabelled", """select cast(d.doc_id as varchar) as id, 'UNL' as annotation,
       d.text as sentence, '' as topic
  from documents d anti join labels l on d.doc_id = l.doc_id""")
def q_prepare_unlabelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return prepare.prepare_unlabelled(d, "doc_id", "text")


@query("prepare_reviews", """select cast(doc_id as varchar) as id,
       cast(n_chars % 5 + 1 as varchar) as annotation, text as sentence, '' as topic
  from documents""")
def q_prepare_reviews(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text",
                                             (F.col("n_chars") % 5 + 1).alias("stars"))
    return prepare.prepare_reviews(d, {"review_id": "id", "text": "sentence", "stars": "annotation"})


@query("distinct_labels", f"select distinct annotation from {EX_SQL} ex")
def q_distinct_labels(spark, sf):
    return prepare.distinct_labels(examples(spark, sf))


@query("overlap_check", f"""select ex.id, ex.sentence as sentence_a, ex.topic as topic_a, ex.ord as ord_a,
       ex.annotation as annotation_a, l.quality as quality_b, l.toxic as toxic_b
  from {EX_SQL} ex join (select cast(doc_id as varchar) as id, quality, toxic from labels) l
    on ex.id = l.id""")
def q_overlap_check(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    return prepare.overlap_check(examples(spark, sf), lab, "id")


PER_CLASS_SQL = f"""select * from {LAB_SQL} l
  qualify row_number() over (partition by annotation order by {KEY_SQL}, id) <= 10"""


@query("sample_per_class", f"select id, annotation from ({PER_CLASS_SQL}) t")
def q_sample_per_class(spark, sf):
    return prepare.sample_per_class(labelled(spark, sf), 10, SEED).select("id", "annotation")


@query("remainder", f"""select * from {EX_SQL} ex
  where id not in (select id from ({PER_CLASS_SQL}) t)""")
def q_remainder(spark, sf):
    ex = examples(spark, sf)
    taken = prepare.sample_per_class(labelled(spark, sf), 10, SEED)
    return prepare.remainder(ex, taken, "id")


@query("fraction_split", f"""with l as {LAB_SQL},
r as (select id, row_number() over (order by {KEY_SQL}, id) as rk, count(*) over () as n from l)
select id, case when rk <= floor(n * 0.6) then 'train'
                when rk <= floor(n * 0.8) then 'val' else 'test' end as split
  from r""")
def q_fraction_split(spark, sf):
    return prepare.fraction_split(labelled(spark, sf), [0.6, 0.2, 0.2], ["train", "val", "test"],
                                  SEED).select("id", "split")


@query("fraction_split_uneven", f"""with l as {LAB_SQL},
r as (select id, row_number() over (order by {KEY_SQL}, id) as rk, count(*) over () as n from l)
select id, case when rk <= floor(n * 0.7) then 'train' when rk <= floor(n * 0.8) then 'val'
                when rk <= floor(n * 0.83) then 'dev' else 'test' end as split
  from r""")
def q_fraction_split_uneven(spark, sf):
    return prepare.fraction_split(labelled(spark, sf), [0.7, 0.1, 0.03, 0.17], ["train", "val", "dev", "test"],
                                  SEED).select("id", "split")


@query("topic_names", """select cast(doc_id as varchar) as id,
       replace(regexp_replace(source || '-' || lang || '-' || cast(doc_id as varchar), '-[^-]*$', ''),
               '-', ' ') as topic
  from documents""")
def q_topic_names(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").cast("string").alias("id"), prepare.topic_names(raw).alias("topic"))


@query("topic_holdout", f"""with l as {LAB_SQL},
o as (select id, row_number() over (order by {KEY_SQL}, id) as rk, count(*) over () as n
      from l where topic <> 'src3')
select id, case when rk <= floor((1 - 0.15) * n) then 'train' else 'val' end as split from o
union all
select id, 'test' as split from l where topic = 'src3'""")
def q_topic_holdout(spark, sf):
    return prepare.topic_holdout(labelled(spark, sf), "src3", 0.15, SEED).select("id", "split")


@query("task_examples", f"select id, annotation from {EX_SQL} ex where annotation <> 'NoArgument'")
def q_task_examples(spark, sf):
    ex, _ = tasks.task_examples(examples(spark, sf), "SL2")
    return ex.select("id", "annotation")


@query("task_examples_three", f"""select id, cast(case annotation when 'Argument_for' then 0
       when 'Argument_against' then 1 when 'NoArgument' then 2 when 'UNL' then -1 end as bigint) as label
  from {EX_SQL} ex""")
def q_task_examples_three(spark, sf):
    ex, _ = tasks.task_examples(examples(spark, sf), "SL3")
    return tasks.encode_labels(ex, tasks.task_labels("SL3")).select("id", "label")


@query("regression_labels", """select cast(doc_id as varchar) as id, cast(n_chars as double) / 100 as label
  from documents""")
def q_regression_labels(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                             (F.col("n_chars") / 100).cast("string").alias("annotation"))
    return tasks.encode_labels(d, [], mode="regression").select("id", "label")


@query("encode_labels", f"""select id, cast(case annotation when 'Argument_for' then 0
       when 'Argument_against' then 1 when 'NoArgument' then 2 when 'UNL' then -1 end as bigint) as label
  from {EX_SQL} ex""")
def q_encode_labels(spark, sf):
    return tasks.encode_labels(examples(spark, sf), THREE).select("id", "label")


@query("class_weights", f"""with c as (select annotation as class, count(*) as n from {LAB_SQL} l group by 1)
select class, cast(case class when 'Argument_for' then 0 when 'Argument_against' then 1
                   else 2 end as bigint) as label, n,
       round((1.0 / n) / sum(1.0 / n) over (), 6) as weight
  from c""")
def q_class_weights(spark, sf):
    return tasks.class_weights(labelled(spark, sf), THREE)


def _budget_sql(quota_expr: str, order: str) -> str:
    return f"""with l as {LAB_SQL},
c as (select annotation, count(*) as n_c from l group by 1),
q as (select annotation, {quota_expr} as quota from c)
select id, annotation from (
  select l.id, l.annotation, q.quota,
         row_number() over (partition by l.annotation order by {order}) as rk
    from l join q using (annotation)) t
 where rk <= quota"""


@query("label_budget_balanced",
       _budget_sql("30 // (select count(*) from c)", "l.ord, l.id"))
def q_label_budget_balanced(spark, sf):
    return budget.label_budget(labelled(spark, sf), 30, balance=True).select("id", "annotation")


@query("label_budget_proportional",
       _budget_sql("cast(floor(100 * n_c / (select sum(n_c) from c)) as bigint)", "l.ord, l.id"))
def q_label_budget_proportional(spark, sf):
    return budget.label_budget(labelled(spark, sf), 100, balance=False).select("id", "annotation")


@query("label_budget_shuffled",
       _budget_sql("30 // (select count(*) from c)", "md5(concat_ws(':', '42', l.id)), l.id"))
def q_label_budget_shuffled(spark, sf):
    return budget.label_budget(labelled(spark, sf), 30, balance=True, shuffle=True,
                               seed=SEED).select("id", "annotation")
