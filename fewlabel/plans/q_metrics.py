"""Queries: metrics, metric series and run-log analysis (build step 8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fewlabel.functions import numeric as N
from fewlabel.operators import metrics, runs
from fewlabel.plans.fixtures import LOGITS_SQL, RUNS_SQL, SERIES_SQL, logits, series, table
from fewlabel.plans.registry import query
from fewlabel.plans.fixtures import runs as runs_view

TOPICS = ["0", "1", "2", "3", "4"]
PATIENCE = 10
STEPS_PER_EPOCH = 10


def _r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("classification_metrics", f"""with s as (
  select cast(list_position(logits, list_max(logits)) - 1 as bigint) as p, label as y
    from {LOGITS_SQL} lg where branch = 0),
c as (select c, sum(sup) as sup, sum(pr) as pr, sum(tp) as tp from (
        select y as c, 1 as sup, 0 as pr, cast(p = y as int) as tp from s
        union all select p as c, 0, 1, 0 from s) u group by c),
a as (select avg(case when tp > 0 then 2.0::double * tp / (sup + pr) else 0.0::double end) as f1_macro,
             sum(tp) as tp, sum(sup) as n, sum(pr) as npred from c)
select round(tp::double / n, 6) as test_acc, round(f1_macro, 6) as test_f1_macro,
       round(2.0::double * tp / (n + npred), 6) as test_f1_micro,
       round((tp::double / n + 2.0::double * tp / (n + npred)) / 2, 6) as test_acc_and_f1
  from a""")
def q_classification_metrics(spark, sf):
    lg = logits(spark, sf).where("branch = 0").withColumn("pred", N.argmax("logits"))
    m = metrics.classification_metrics(lg, "pred", "label", prefix="test")
    return m.select(*_r6("test_acc", "test_f1_macro", "test_f1_micro", "test_acc_and_f1"))


@query("correlation_metrics", """with e as (
  select value as x, cast(json_extract_string(props, '$.k') as double) as y from events),
r as (select x, y,
             rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as rx,
             rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry
        from e)
select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearmanr,
       round((corr(x, y) + corr(rx, ry)) / 2, 6) as corr
  from r""")
def q_correlation_metrics(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return metrics.correlation_metrics(ev, "x", "y").select(*_r6("pearson", "spearmanr", "corr"))


@query("epoch_metrics", f"""select run_id, metric, epoch, round(avg(value), 6) as value from (
  select user_id as run_id, event_type as metric, value,
         (row_number() over (partition by user_id order by ts, event_id) - 1) // {STEPS_PER_EPOCH} as epoch
    from events) t group by all""")
def q_epoch_metrics(spark, sf):
    ev = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = ev.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), "value",
                      (F.row_number().over(w) - 1).alias("step"))
    e = metrics.epoch_metrics(steps, STEPS_PER_EPOCH)
    return e.select("run_id", "metric", "epoch", F.round("value", 6).alias("value"))


@query("best_epoch", f"""select run_id, epoch, val_loss from {SERIES_SQL} s
qualify row_number() over (partition by run_id order by val_loss, epoch) = 1""")
def q_best_epoch(spark, sf):
    return metrics.best_epoch(series(spark, sf))


@query("early_stop", f"""with s as {SERIES_SQL},
a as (select *, min(val_loss) over (partition by run_id order by epoch
                                    rows between unbounded preceding and 1 preceding) as best_before
        from s),
b as (select *, max(case when best_before is null or val_loss < best_before then epoch end)
                  over (partition by run_id order by epoch rows between unbounded preceding and current row)
                  as last_imp
        from a),
st as (select run_id, min(case when epoch - last_imp >= {PATIENCE} then epoch end) as stop_epoch,
              max(epoch) as last_epoch from b group by run_id),
w as (select b.run_id, b.epoch, b.val_loss, st.stop_epoch from b join st using (run_id)
       where b.epoch <= coalesce(st.stop_epoch, st.last_epoch)
      qualify row_number() over (partition by b.run_id order by b.val_loss, b.epoch) = 1)
select run_id, stop_epoch, epoch as best_epoch, val_loss as best_loss from w""")
def q_early_stop(spark, sf):
    return metrics.early_stop(series(spark, sf), PATIENCE)


@query("search_runs", f"""with r as {RUNS_SQL}
select run_id, experiment_id, coalesce(task, legacy_task) as task, val_acc,
       'runs/' || cast(experiment_id as varchar) || '/' || coalesce(task, legacy_task) as experiment,
       split_part('runs/' || cast(experiment_id as varchar) || '/' || coalesce(task, legacy_task), '/', 2)
         as experiment_key
  from r where lifecycle_stage = 'active'
   and experiment_id in (select user_id from events where event_type = 'error')""")
def q_search_runs(spark, sf):
    errs = table(spark, sf, "events").where("event_type = 'error'").select("user_id")
    r = runs.search_runs(runs_view(spark, sf), errs)
    task = F.coalesce("task", "legacy_task")
    exp = F.concat_ws("/", F.lit("runs"), F.col("experiment_id").cast("string"), task)
    return r.select("run_id", "experiment_id", task.alias("task"), "val_acc", exp.alias("experiment"),
                    runs.path_component(exp, 1).alias("experiment_key"))


@query("search_runs_by_hash", f"""with r as (
  select run_id, val_acc, md5(to_json(map(['task', 'topic'], [legacy_task, topic]))) as hash, experiment_id, lifecycle_stage
    from {RUNS_SQL} x)
select run_id, val_acc, hash from r
 where lifecycle_stage = 'active' and hash = (select min(hash) from r)
   and experiment_id in (select user_id from events where event_type = 'error')""")
def q_search_runs_by_hash(spark, sf):
    """The runs of one configuration: that of the least hash."""
    errs = table(spark, sf, "events").where("event_type = 'error'").select("user_id")
    rv = runs_view(spark, sf).withColumn("hash", runs.config_hash({"task": "legacy_task", "topic": "topic"}))
    wanted = rv.agg(F.min("hash")).first()[0]
    return runs.search_runs(rv, errs, run_hash=wanted).select("run_id", "val_acc", "hash")


@query("pending_runs", f"""with g as (
  select task, topic from (select distinct legacy_task as task from {RUNS_SQL} r) t,
         (values ('0'), ('1'), ('2'), ('3'), ('4'), ('5'), ('6')) v(topic)),
gh as (select task, topic, md5(to_json(map(['task', 'topic'], [task, topic]))) as hash from g),
lg as (select md5(to_json(map(['task', 'topic'], [legacy_task, topic]))) as hash
         from {RUNS_SQL} r where lifecycle_stage = 'active')
select * from gh where hash not in (select hash from lg)""")
def q_pending_runs(spark, sf):
    rv = runs_view(spark, sf)
    base = rv.select(F.col("legacy_task").alias("task")).distinct()
    grid = runs.expand_grid(base, {"topic": ["0", "1", "2", "3", "4", "5", "6"]})
    grid = grid.withColumn("hash", runs.config_hash({"task": "task", "topic": "topic", "data.path": F.lit("x")}))
    logged = rv.where("lifecycle_stage = 'active'").select(
        runs.config_hash({"task": "legacy_task", "topic": "topic"}).alias("hash"))
    return runs.pending_runs(grid, logged)


@query("best_metric_per_task", f"""select legacy_task as task, max(val_acc) as max_val_acc
  from {RUNS_SQL} r where lifecycle_stage = 'active' group by 1""")
def q_best_metric_per_task(spark, sf):
    rv = runs_view(spark, sf).where("lifecycle_stage = 'active'").withColumnRenamed("task", "_t").withColumnRenamed("legacy_task", "task")
    return runs.best_metric_per_task(rv, "task", "val_acc", "max_val_acc")


@query("cross_topic_matrix", f"""with m as (
  select coalesce(task, legacy_task) as task,
         max(case when topic = '0' then test_acc end) as topic_0,
         max(case when topic = '1' then test_acc end) as topic_1,
         max(case when topic = '2' then test_acc end) as topic_2,
         max(case when topic = '3' then test_acc end) as topic_3,
         max(case when topic = '4' then test_acc end) as topic_4
    from {RUNS_SQL} r where lifecycle_stage = 'active' group by 1)
select *, round((topic_0 + topic_1 + topic_2 + topic_3 + topic_4) / 5.0::double, 6) as mean from m""")
def q_cross_topic_matrix(spark, sf):
    rv = runs_view(spark, sf).where("lifecycle_stage = 'active'")
    rv = rv.withColumn("task", F.coalesce("task", "legacy_task"))
    m = runs.cross_topic_matrix(rv, "task", "topic", "test_acc", TOPICS)
    return m.withColumn("mean", F.round("mean", 6))


@query("best_run_per_task", f"""select coalesce(task, legacy_task) as task, run_id, val_acc, test_acc
  from {RUNS_SQL} r where lifecycle_stage = 'active'
qualify row_number() over (partition by coalesce(task, legacy_task) order by val_acc desc, run_id) = 1""")
def q_best_run_per_task(spark, sf):
    b = runs.best_run_per_task(runs_view(spark, sf).where("lifecycle_stage = 'active'"))
    return b.select("task", "run_id", "val_acc", "test_acc")
