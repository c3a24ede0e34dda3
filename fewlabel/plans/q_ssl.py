"""Queries: algebra on a table of logits (build step 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.functions import numeric as N
from fewlabel.operators import ssl
from fewlabel.plans.fixtures import LAB_SQL, LOGITS_SQL, labelled, logits
from fewlabel.plans.registry import query

THRESHOLD = 0.95
STEP_IDS = 50          # instances per composite step
PAIR_CAP = 10          # max pseudo-label pairs per step
TSA_T, TSA_STEP, TSA_K = 100, 50, 10
BATCH_IDS = 32
LAMBDA_U = 1.0


def scores(spark, sf):
    return ssl.softmax_scores(logits(spark, sf))


# Shared SQL: scores with max_prob and target.
S_SQL = f"""s as (select id, branch, label, logits,
       1.0::double / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) as max_prob,
       cast(list_position(logits, list_max(logits)) - 1 as bigint) as target,
       list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) as lse
  from {LOGITS_SQL} lg)"""

# Annealed threshold at step TSA_STEP of TSA_T with TSA_K classes.
THR_SQL = (f"(exp((cast({TSA_STEP} as double) / {TSA_T} - 1) * 5) * (1 - 1 / cast({TSA_K} as double))"
           f" + 1 / cast({TSA_K} as double))")


def tsa_thr():
    return N.tsa_threshold(F.lit(float(TSA_STEP)), F.lit(float(TSA_T)), F.lit(float(TSA_K)))


@query("softmax_scores", f"""with {S_SQL}
select id, branch, label, round(max_prob, 6) as max_prob, target from s""")
def q_softmax_scores(spark, sf):
    return scores(spark, sf).select("id", "branch", "label", F.round("max_prob", 6).alias("max_prob"), "target")


@query("tsa_schedule", f"""with n as (select count(*) as n from {LAB_SQL} l),
t as (select ((n + 15) // 16) * 2 as total from n)
select r.range as step,
       round(exp((r.range / t.total - 1) * 5) * (1 - 1 / 3.0::double) + 1 / 3.0::double, 6) as threshold
  from t, range(1, (select total from t) + 1) r""")
def q_tsa_schedule(spark, sf):
    n = labelled(spark, sf).count()
    total, _ = N.total_steps(n, batch_size=16, accumulation=1, max_epochs=2)
    return ssl.tsa_schedule(spark, total, 3).select("step", F.round("threshold", 6).alias("threshold"))


@query("tsa_mask", f"""with {S_SQL}
select id, round(max_prob, 6) as max_prob, target, label,
       cast(max_prob <= {THR_SQL} or target <> label as bigint) as mask
  from s where branch = 0""")
def q_tsa_mask(spark, sf):
    lg = logits(spark, sf).where("branch = 0")
    m = ssl.tsa_mask(lg, tsa_thr())
    return m.select("id", F.round("max_prob", 6).alias("max_prob"), "target", "label", "mask")


@query("confidence_mask", f"""with {S_SQL}
select id, round(max(max_prob), 6) as max_prob, max(max_prob) >= 0.95 as passes from s group by id""")
def q_confidence_mask(spark, sf):
    c = ssl.confidence_mask(scores(spark, sf), THRESHOLD)
    return c.select("id", F.round("max_prob", 6).alias("max_prob"), "passes")


@query("confidence_mask_tsa", f"""with {S_SQL}
select id, round(max(max_prob), 6) as max_prob, max(max_prob) >= pow({THR_SQL}, 1.0::double / 3) as passes
  from s group by id""")
def q_confidence_mask_tsa(spark, sf):
    thr = N.annealed_confidence(F.lit(float(TSA_STEP)), F.lit(float(TSA_T)), F.lit(float(TSA_K)))
    c = ssl.confidence_mask(scores(spark, sf), thr)
    return c.select("id", F.round("max_prob", 6).alias("max_prob"), "passes")


@query("best_branch", f"""with {S_SQL}
select id, branch as best_branch, target, round(max_prob, 6) as max_prob from s
qualify row_number() over (partition by id order by max_prob desc, branch) = 1""")
def q_best_branch(spark, sf):
    b = ssl.best_branch(scores(spark, sf))
    return b.select("id", "best_branch", "target", F.round("max_prob", 6).alias("max_prob"))


PAIRS_SQL = f"""{S_SQL},
r as (select *, row_number() over (partition by id order by max_prob desc, branch) as rn,
             max(max_prob) over (partition by id) as best_prob from s),
b as (select id, target as pseudo from r where rn = 1),
p as (select r.id, r.branch, r.label, r.logits, r.lse, b.pseudo as target, r.id // {STEP_IDS} as step
        from r join b using (id)
       where r.best_prob >= 0.95 and r.rn > 1 and r.target <> b.pseudo
      qualify row_number() over (partition by r.id // {STEP_IDS} order by r.id, r.branch) <= {PAIR_CAP})"""


def pairs(spark, sf):
    sc = scores(spark, sf).withColumn("step", F.col("id") / F.lit(STEP_IDS)).withColumn(
        "step", F.floor("step").cast("bigint"))
    return ssl.pseudo_label_pairs(sc, THRESHOLD, only_wrong=True, cap=PAIR_CAP, step_col="step")


@query("pseudo_label_pairs", f"with {PAIRS_SQL} select id, branch, target, step from p")
def q_pseudo_label_pairs(spark, sf):
    return pairs(spark, sf).select("id", "branch", "target", "step")


@query("eval_loss", f"""with {S_SQL}
select branch, count(*) as n, round(avg(lse - logits[label + 1]), 6) as loss from s group by branch""")
def q_eval_loss(spark, sf):
    e = ssl.eval_loss(logits(spark, sf), by=["branch"])
    return e.select("branch", "n", F.round("loss", 6).alias("loss"))


W_SQL = f"""w as (select label, (1.0::double / count(*)) / sum(1.0::double / count(*)) over () as weight
  from {LOGITS_SQL} lg where branch = 0 group by label)"""


def weights(spark, sf):
    return ssl.class_weights_from_labels(logits(spark, sf).where("branch = 0"), "label")


@query("weighted_loss", f"""with {S_SQL}, {W_SQL}
select branch, count(*) as n, round(sum(weight * (lse - logits[label + 1])) / sum(weight), 6) as loss
  from s join w using (label) group by branch""")
def q_weighted_loss(spark, sf):
    x = ssl.weighted_loss(logits(spark, sf), weights(spark, sf), by=["branch"])
    return x.select("branch", "n", F.round("loss", 6).alias("loss"))


@query("tsa_loss", f"""with {S_SQL}, {W_SQL}
select id // {BATCH_IDS} as batch, count(*) as n,
       round(sum(weight * (lse - logits[label + 1])
                 * cast(max_prob <= {THR_SQL} or target <> label as bigint)) / count(*), 6) as loss
  from s join w using (label) where branch = 0 group by 1""")
def q_tsa_loss(spark, sf):
    lg = logits(spark, sf).where("branch = 0").withColumn("batch", F.floor(F.col("id") / BATCH_IDS).cast("bigint"))
    m = ssl.tsa_mask(lg, tsa_thr()).drop("max_prob", "target")
    x = ssl.tsa_loss(m, weights(spark, sf), by=["batch"])
    return x.select("batch", "n", F.round("loss", 6).alias("loss"))


@query("ssl_loss", f"""with {PAIRS_SQL}, {W_SQL},
sup as (select s.id // {STEP_IDS} as step,
               sum(weight * (lse - logits[label + 1])) / sum(weight) as sup_loss
          from s join w using (label) where branch = 0 group by 1),
uns as (select step, sum(weight * (lse - logits[target + 1])) / sum(weight) as unsup_loss
          from p join w on p.target = w.label group by 1)
select step, round(sup_loss, 6) as sup_loss, round(coalesce(unsup_loss, 0), 6) as unsup_loss,
       round(sup_loss + {LAMBDA_U} * coalesce(unsup_loss, 0), 6) as loss
  from sup left join uns using (step)""")
def q_ssl_loss(spark, sf):
    return ssl.ssl_loss(
        logits(spark, sf).where("branch = 0").withColumn("step", F.floor(F.col("id") / STEP_IDS).cast("bigint")),
        pairs(spark, sf), weights(spark, sf), LAMBDA_U, step_col="step").select(
        "step", F.round("sup_loss", 6).alias("sup_loss"), F.round("unsup_loss", 6).alias("unsup_loss"),
        F.round("loss", 6).alias("loss"))


@query("ssl_loss_tsa", f"""with {PAIRS_SQL}, {W_SQL},
sup as (select s.id // {STEP_IDS} as step,
               sum(weight * (lse - logits[label + 1])
                   * cast(max_prob <= {THR_SQL} or target <> label as bigint)) / count(*) as sup_loss
          from s join w using (label) where branch = 0 group by 1),
uns as (select step, sum(weight * (lse - logits[target + 1])) / sum(weight) as unsup_loss
          from p join w on p.target = w.label group by 1)
select step, round(sup_loss, 6) as sup_loss, round(coalesce(unsup_loss, 0), 6) as unsup_loss,
       round(sup_loss + {LAMBDA_U} * coalesce(unsup_loss, 0), 6) as loss
  from sup left join uns using (step)""")
def q_ssl_loss_tsa(spark, sf):
    lab = logits(spark, sf).where("branch = 0").withColumn("step", F.floor(F.col("id") / STEP_IDS).cast("bigint"))
    x = ssl.ssl_loss(lab, pairs(spark, sf), weights(spark, sf), LAMBDA_U, step_col="step", tsa=tsa_thr())
    return x.select("step", *[F.round(c, 6).alias(c) for c in ("sup_loss", "unsup_loss", "loss")])


@query("ssl_report", f"""with {PAIRS_SQL},
m as (select id // {STEP_IDS} as step, avg(cast(best_prob >= 0.95 as double)) as u_mask
        from r where rn = 1 group by 1),
c as (select step, count(*) as u_batch_size from p group by step)
select step, round(u_mask, 6) as u_mask, coalesce(c.u_batch_size, 0) as u_batch_size
  from m left join c using (step)""")
def q_ssl_report(spark, sf):
    sc = scores(spark, sf).withColumn("step", F.floor(F.col("id") / STEP_IDS).cast("bigint"))
    rep = ssl.ssl_report(sc, pairs(spark, sf), THRESHOLD, step_col="step")
    return rep.select("step", F.round("u_mask", 6).alias("u_mask"), "u_batch_size")
