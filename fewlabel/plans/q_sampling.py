"""Queries: augmentation plan, attach, branch sampling, composite steps, batches (build step 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.operators import sampling, tasks
from fewlabel.operators.augment import plan as P
from fewlabel.plans.fixtures import EX_SQL, examples
from fewlabel.plans.registry import query

SEED = 42
MU = 8
N_BRANCHES = 2


def _plan_values_sql() -> str:
    rows = ", ".join(f"('{s}', '{a}', {n}, '{p}')" for s, a, n, p in P.plan_rows())
    return f"(values {rows}) pv(side, aug_name, n, params)"


def _grid_values_sql() -> str:
    rows = []
    for spec in P.DEFAULT_SPECS:
        for c in P.configs(spec):
            for side in ("labelled", "unlabelled"):
                rows.append(f"('{spec.name}', '{spec.kind}', '{P.params_string(c)}', '{side}', "
                            f"{spec.n_times.get(side, 0)})")
    return f"(values {', '.join(rows)}) gv(aug_name, kind, params, side, n_times)"


PLAN_SQL = f"""plan as (select pv.aug_name, cast(pv.n as bigint) as n, pv.params, ex.id,
       case when ex.annotation = 'UNL' then 'unlabelled' else 'labelled' end as side
  from {EX_SQL} ex join {_plan_values_sql()}
    on pv.side = case when ex.annotation = 'UNL' then 'unlabelled' else 'labelled' end),
aug as (select aug_name, n, params, id, aug_name || ':' || cast(n as varchar) || ':' || id as sentence from plan)"""


def plan(spark, sf):
    return P.augmentation_plan(examples(spark, sf))


def aug_table(spark, sf):
    return plan(spark, sf).withColumn("sentence", P.placeholder_text())


@query("config_grid", f"""with ex as {EX_SQL},
c as (select case when annotation = 'UNL' then 'unlabelled' else 'labelled' end as side, count(*) as rows_in
        from ex group by 1)
select aug_name, kind, params, side, cast(n_times as bigint) as n_times,
       cast(n_times as bigint) * rows_in as n_rows
  from {_grid_values_sql()} join c using (side)""")
def q_config_grid(spark, sf):
    g = P.config_grid(spark)
    long = g.select("aug_name", "kind", "params", F.explode(F.array(
        F.struct(F.lit("labelled").alias("side"), F.col("labelled_n").alias("n_times")),
        F.struct(F.lit("unlabelled").alias("side"), F.col("unlabelled_n").alias("n_times")))).alias("s")
    ).select("aug_name", "kind", "params", "s.side", "s.n_times")
    counts = examples(spark, sf).groupBy(P.side_of().alias("side")).agg(F.count(F.lit(1)).alias("rows_in"))
    return F.broadcast(long).join(counts, "side").select(
        "aug_name", "kind", "params", "side", "n_times", (F.col("n_times") * F.col("rows_in")).alias("n_rows"))


@query("augmentation_plan", f"with {PLAN_SQL} select aug_name, n, params, id, side from plan")
def q_augmentation_plan(spark, sf):
    return plan(spark, sf)


@query("augmentations_of_examples", f"""with {PLAN_SQL}
select aug_name, n, params, id from aug
 where id in (select id from {EX_SQL} ex where annotation <> 'NoArgument')""")
def q_augmentations_of_examples(spark, sf):
    _, aug = tasks.task_examples(examples(spark, sf), "SL2", aug_table(spark, sf))
    return aug.select("aug_name", "n", "params", "id")


@query("attach_augmentations", f"""with {PLAN_SQL}
select ex.id, ex.annotation, count(*) as n_aug, count(distinct aug.aug_name) as n_types,
       min(aug.sentence) as first_aug
  from {EX_SQL} ex join aug using (id) where ex.annotation <> 'NoArgument'
 group by ex.id, ex.annotation""")
def q_attach_augmentations(spark, sf):
    ex, aug = tasks.task_examples(examples(spark, sf), "SL2", aug_table(spark, sf))
    a = sampling.attach_augmentations(ex, aug)
    return a.select("id", "annotation", F.size("augs").cast("bigint").alias("n_aug"),
                    F.size(F.array_distinct(F.transform("augs", lambda s: s["aug_name"]))).cast("bigint")
                    .alias("n_types"),
                    F.col("augs")[0]["sentence"].alias("first_aug"))


@query("encode_aug_names", f"""with {PLAN_SQL}
select aug_name, row_number() over (order by aug_name) - 1 as aug_code from (select distinct aug_name from aug) t""")
def q_encode_aug_names(spark, sf):
    return sampling.encode_aug_names(aug_table(spark, sf))


@query("sample_branches", f"""with {PLAN_SQL},
c as (select aug_name, row_number() over (order by aug_name) - 1 as aug_code
        from (select distinct aug_name from aug) t),
r as (select *, dense_rank() over (partition by id order by md5(concat_ws(':', '42', '0', id, aug_name)), aug_name)
                  as trank
        from aug),
v as (select * from r where trank <= {N_BRANCHES}
      qualify row_number() over (partition by id, aug_name
                                 order by md5(concat_ws(':', '42', '0', id, aug_name, n, params)), n, params) = 1)
select v.id, cast(v.trank - 1 as bigint) as branch, v.aug_name, v.n, v.params, c.aug_code
  from v join c using (aug_name)""")
def q_sample_branches(spark, sf):
    b = sampling.sample_branches(aug_table(spark, sf), N_BRANCHES, SEED, epoch=0)
    return b.select("id", "branch", "aug_name", "n", "params", "aug_code")


def _steps_sql(side: str, pred: str, total: str, width: int, epoch: int = 0) -> str:
    return f"""select {epoch}::bigint as epoch, cast(pos // {width} as bigint) as step, '{side}' as side,
       cast(pos % {width} as bigint) as slot, id
  from (select id, cyc * n + row_number() over (partition by cyc
                   order by md5(concat_ws(':', '42', '{epoch}', cyc, id)), id) - 1 as pos
          from (select ex.id, cnt.n, unnest(range(0, cast(ceil({total} / cnt.n) as bigint))) as cyc
                  from {EX_SQL} ex, (select count(*) as n from {EX_SQL} e2 where {pred}) cnt
                 where {pred.replace('e2.', 'ex.')}) a) b
 where pos < {total}"""


def _length_sql(pick: str) -> str:
    return (f"(select {pick}(sum(case when annotation <> 'UNL' then 1 else 0 end), "
            f"sum(case when annotation = 'UNL' then 1 else 0 end) // {MU}) from {EX_SQL} ez)")


COMPOSITE_LEN, COMPOSITE_MOST = _length_sql("least"), _length_sql("greatest")


@query("composite_steps", _steps_sql("labelled", "e2.annotation <> 'UNL'", COMPOSITE_LEN, 1)
       + "\nunion all\n"
       + _steps_sql("unlabelled", "e2.annotation = 'UNL'", f"({COMPOSITE_LEN} * {MU})", MU))
def q_composite_steps(spark, sf):
    ex = examples(spark, sf)
    lab = ex.where("annotation <> 'UNL'")
    unl = ex.where("annotation = 'UNL'")
    return sampling.composite_steps(lab, unl, MU, SEED, epoch=0)


@query("composite_steps_max", _steps_sql("labelled", "e2.annotation <> 'UNL'", COMPOSITE_MOST, 1, 1)
       + "\nunion all\n"
       + _steps_sql("unlabelled", "e2.annotation = 'UNL'", f"({COMPOSITE_MOST} * {MU})", MU, 1))
def q_composite_steps_max(spark, sf):
    """The longer length rule, where the shorter side is tiled, in the second epoch."""
    ex = examples(spark, sf)
    return sampling.composite_steps(ex.where("annotation <> 'UNL'"), ex.where("annotation = 'UNL'"), MU, SEED, epoch=1, len_mode="max")


@query("assign_batches_in_order", f"""select id, cast((row_number() over (order by ord, id) - 1) // 32 as bigint) as batch
  from {EX_SQL} ex""")
def q_assign_batches_in_order(spark, sf):
    return sampling.assign_batches(examples(spark, sf), 32, shuffle=False).select("id", "batch")


@query("assign_batches", f"""select id, cast((row_number() over (order by md5(concat_ws(':', '42', '0', id)), id) - 1)
            // 32 as bigint) as batch
  from {EX_SQL} ex""")
def q_assign_batches(spark, sf):
    return sampling.assign_batches(examples(spark, sf), 32, shuffle=True, seed=SEED).select("id", "batch")


@query("length_buckets", f"""with r as (select id, cast(length(sentence) as bigint) as length,
       cast((row_number() over (order by length(sentence), id) - 1) // 30 as bigint) as batch
  from {EX_SQL} ex)
select id, length, batch, min(length) over (partition by batch) as batch_min,
       max(length) over (partition by batch) as batch_max,
       greatest(cast(floor(0.2::double * min(length) over (partition by batch)) as bigint), 10) as budget
  from r""")
def q_length_buckets(spark, sf):
    b = sampling.length_buckets(examples(spark, sf), 30, 0.2)
    return b.select("id", "length", "batch", "batch_min", "batch_max", "budget")
