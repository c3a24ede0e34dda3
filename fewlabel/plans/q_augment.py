"""Queries: table-driven augmentors and their candidate tables (build step 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.operators.augment import augmentors as A
from fewlabel.operators.augment import candidates as C
from fewlabel.operators.augment import neighbour_graph as NG
from fewlabel.operators.augment import offline
from fewlabel.operators.augment import plan as P
from fewlabel.operators.augment import presets
from fewlabel.operators.augment import vectors as V
from fewlabel.plans import fixtures_aug as FA
from fewlabel.plans.fixtures import EX_SQL, examples, table
from fewlabel.plans.registry import query

SEED = 42
SPECS = {s.name: s for s in P.DEFAULT_SPECS}
CTX_K = 50
NEXT_STEPS = 10
TOP_K = 50  # candidates per word, as the augmentation grid asks for


def neighbours(spark, sf):
    """Neighbour lists of all words by their count vectors."""
    return NG.neighbour_graph(V.count_vectors(table(spark, sf, "documents"), size=32, min_count=5), k=TOP_K, seed=SEED)


def resources(spark, sf) -> offline.Resources:
    docs = table(spark, sf, "documents")
    return offline.Resources(
        neighbours=lambda: C.ranked(neighbours(spark, sf), ["word"], TOP_K), thesaurus=lambda: FA.thesaurus(spark, sf),
        contexts=lambda: C.smoothed_candidates(docs, CTX_K), lexicons=lambda: FA.lexicons(spark, sf),
        successors=lambda: C.successors(docs, k=50, top_p=0.9))


def _tok_sql(col: str) -> str:
    return FA._tok_sql(col)


def _plan_values(spec) -> str:
    rows = ", ".join(f"('{s}', '{a}', {n}, '{p}')" for s, a, n, p in P.plan_rows([spec]))
    return f"(values {rows}) pv(side, aug_name, n, params)"


CORE = r"'^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$'"


def substitution_sql(spec, lookup_ctes: str, lookup_join: str, cands_expr: str, default_aug_p: float,
                     choice: str) -> str:
    """DuckDB version of the substitution rule (see augment.substitute)."""
    key = ("xor(('0x' || substr(md5(concat_ws(':', '42', id, pos)), 1, 15))::bigint, "
           "('0x' || substr(md5(concat_ws(':', '42', n, params)), 1, 15))::bigint)")
    ch = ("xor(('0x' || substr(md5(concat_ws(':', '42', id, pos)), 16, 8))::bigint, "
          "('0x' || substr(md5(concat_ws(':', '42', n, params, 'c')), 1, 8))::bigint)")
    pick = "lc[1]" if choice == "best" else f"lc[({ch} % len(lc)) + 1]"
    return f"""with ex as {EX_SQL}, {lookup_ctes},
t as (select id, case when annotation = 'UNL' then 'unlabelled' else 'labelled' end as side,
             string_split(sentence, ' ') as toks from ex),
u0 as (select id, side, p - 1 as pos, toks[p] as token,
              lower(regexp_extract(toks[p], {CORE}, 1)) as core from t, unnest(range(1, len(toks) + 1)) r(p)),
u as (select id, side, pos, token, case when regexp_full_match(core, '[\\p{{L}}\\p{{N}}]+') then core end as word from u0),
u2 as (select *, lag(word) over (partition by id order by pos) as "left",
              lead(word) over (partition by id order by pos) as "right" from u),
rows as (select u2.*, pv.aug_name, cast(pv.n as bigint) as n, pv.params from u2 join {_plan_values(spec)}
           on pv.side = u2.side),
c as (select rows.*, {cands_expr} as cands from rows {lookup_join}),
k as (select *, case when cands is null then null
                     when cast(json_extract_string(params, '$.top_k') as int) is null then cands
                     else cands[1:cast(json_extract_string(params, '$.top_k') as int)] end as lc,
             coalesce(cast(json_extract_string(params, '$.aug_p') as double), {default_aug_p}::double) as aug_p
        from c),
k2 as (select *, case when lc is not null then {key} end as hk from k),
r as (select *, count(hk) over (partition by aug_name, n, params, id) as n_el,
             row_number() over (partition by aug_name, n, params, id order by hk nulls last) as rk from k2),
s as (select *, case when hk is not null and rk <= (case when n_el = 0 then 0
                                                        else greatest(1, floor(aug_p * n_el)) end)
                     then regexp_extract(token, '^([^\\p{{L}}\\p{{N}}]*)', 1) || {pick}
                          || regexp_extract(token, '([^\\p{{L}}\\p{{N}}]*)$', 1)
                     else token end as new_token from r)
select aug_name, n, params, id, string_agg(new_token, ' ' order by pos) as sentence
  from s group by aug_name, n, params, id"""


def _own(col: str) -> str:
    return f"case when rows.word is not null and len(list_filter({col}, lambda x: x <> rows.word)) > 0 " \
           f"then list_filter({col}, lambda x: x <> rows.word) end"


# ---------------------------------------------------------------- candidate tables
BIGRAM_SQL = f"""tk as (select {_tok_sql('text')} as t from documents),
bg as (select t[i] as word, t[i + 1] as candidate from tk, unnest(range(1, len(t))) r(i)),
bc as (select word, candidate, count(*) as score from bg group by all)"""


@query("candidate_topk", f"""with {BIGRAM_SQL},
w as (select *, pow(score, 1 / 0.7) as w from bc),
p as (select word, candidate, w / sum(w) over (partition by word) as p,
             row_number() over (partition by word order by w desc, candidate) as rank from w),
q as (select *, coalesce(sum(p) over (partition by word order by rank
                          rows between unbounded preceding and 1 preceding), 0) as before from p where rank <= 5)
select word, candidate, rank, round(p, 6) as p from q where before < 0.9""")
def q_candidate_topk(spark, sf):
    bc = C.bigram_counts(table(spark, sf, "documents"))
    out = C.candidate_topk(bc, ["word"], 5, temperature=0.7, top_p=0.9)
    return out.select("word", "candidate", "rank", F.round("p", 6).alias("p"))


@query("context_candidates", f"""with tk as (select {_tok_sql('text')} as t from documents),
tg as (select t[i] as "left", t[i + 1] as candidate, t[i + 2] as "right" from tk, unnest(range(1, len(t) - 1)) r(i)),
tc as (select "left", "right", candidate, count(*) as score from tg group by all)
select "left", "right", string_agg(candidate, ',' order by score desc, candidate) as cands from (
  select * from tc qualify row_number() over (partition by "left", "right" order by score desc, candidate) <= 5) x
 group by all""")
def q_context_candidates(spark, sf):
    tri, _ = C.context_candidates(table(spark, sf, "documents"), 5)
    return tri.select("left", "right", F.array_join("cands", ",").alias("cands"))


@query("pivot_paraphrases", f"""with {FA.lexicon_sql()},
f as (select * from fwd qualify row_number() over (partition by model, src order by p desc, tgt) <= 3),
b as (select * from bwd qualify row_number() over (partition by model, src order by p desc, tgt) <= 3)
select f.model, f.src as word, b.tgt as candidate, round(sum(f.p * b.p), 6) as score
  from f join b on f.model = b.model and f.tgt = b.src group by all""")
def q_pivot_paraphrases(spark, sf):
    """Both model pairs, over all words."""
    fw, bw = FA.lexicons(spark, sf)
    out = None
    for m in FA.PIVOTS:
        pp = C.pivot_paraphrases(fw.where(F.col("model") == m), bw.where(F.col("model") == m), 3, 3)
        pp = pp.select(F.lit(m).alias("model"), "word", "candidate", F.round("score", 6).alias("score"))
        out = pp if out is None else out.unionByName(pp)
    return out


# ---------------------------------------------------------------- augmentors
@query("aug_synonym", substitution_sql(SPECS["SynonymAug"], FA.THES_SQL,
                                       "left join thes l0 on l0.word = rows.word", _own("l0.cands"), 0.3,
                                       "uniform"))
def q_aug_synonym(spark, sf):
    return A.aug_synonym(examples(spark, sf), FA.thesaurus(spark, sf), SPECS["SynonymAug"], SEED)


def _lower_sql(name: str, side: str) -> str:
    """Continuation probabilities by one neighbour."""
    return f"""{name}m as (select "{side}", candidate, count(*) as m from t3 group by all),
{name}d as (select case when count(*) filter (m = 1) = 0 then 0.0::double
                   else count(*) filter (m = 1) / (count(*) filter (m = 1) + 2.0::double * count(*) filter (m = 2)) end as d from {name}m),
{name}k as (select candidate, count(*) as k from {name}m group by candidate),
{name}a as (select "{side}", cast(sum(m) as bigint) as al, count(*) as kinds from {name}m group by "{side}"),
{name} as (select x."{side}", candidate, greatest(m - d, 0.0::double) / al + d * kinds / al * (k / (select cast(sum(k) as double) from {name}k)) as p
             from {name}m x join {name}a using ("{side}") join {name}k using (candidate), {name}d)"""


SMOOTH_SQL = f"""tk as (select {_tok_sql('text')} as t from documents),
t3 as (select t[i] as "left", t[i + 1] as candidate, t[i + 2] as "right", count(*) as n from tk, unnest(range(1, len(t) - 1)) r(i) group by all),
{_lower_sql('pl', 'left')}, {_lower_sql('pr', 'right')},
d3 as (select case when count(*) filter (n = 1) = 0 then 0.0::double
              else count(*) filter (n = 1) / (count(*) filter (n = 1) + 2.0::double * count(*) filter (n = 2)) end as d from t3),
a3 as (select "left", "right", cast(sum(n) as bigint) as al, count(*) as kinds from t3 group by all),
p3 as (select t3."left", t3."right", t3.candidate, greatest(n - d, 0.0::double) / al + d * kinds / al * pl.p as p
         from t3 join pl on pl."left" = t3."left" and pl.candidate = t3.candidate
                 join a3 on a3."left" = t3."left" and a3."right" = t3."right", d3)"""


def _ranked_sql(source: str, keys: str, k: int) -> str:
    return f"""(select {keys}, list(candidate order by score desc, candidate) as cands from (
   select *, round(p, 12) as score from {source}
   qualify row_number() over (partition by {keys} order by round(p, 12) desc, candidate) <= {k}) x group by all)"""


@query("context_probabilities", f"""with {SMOOTH_SQL}
select "left", "right", candidate, round(p, 6) as p from p3""")
def q_context_probabilities(spark, sf):
    """Interpolated Kneser-Ney probabilities of all words seen between two neighbours."""
    both, _, _ = C.smoothed_contexts(table(spark, sf, "documents"))
    return both.select("left", "right", "candidate", F.round("p", 6).alias("p"))


CTX_CTES = f"""{SMOOTH_SQL},
c3 as {_ranked_sql('p3', '"left", "right"', CTX_K)}, cl as {_ranked_sql('pl', '"left"', CTX_K)}, cr as {_ranked_sql('pr', '"right"', CTX_K)}"""


@query("aug_contextual", substitution_sql(
    SPECS["ContextualWordEmbsAug"], CTX_CTES,
    'left join c3 l0 on l0."left" = rows."left" and l0."right" = rows."right" '
    'left join cl l1 on l1."left" = rows."left" left join cr l2 on l2."right" = rows."right"',
    f"coalesce({_own('l0.cands')}, {_own('l1.cands')}, {_own('l2.cands')})", 0.3, "uniform"))
def q_aug_contextual(spark, sf):
    tables = C.smoothed_candidates(table(spark, sf, "documents"), CTX_K)
    return A.aug_contextual(examples(spark, sf), *tables, SPECS["ContextualWordEmbsAug"], SEED)


def _bt_ctes() -> str:
    spec = SPECS["BatchBackTranslationAug"]
    cfg = ", ".join(f"('{P.params_string(c)}', '{c['model_names'][0]}', {c['from_num_beam']}, {c['to_num_beam']})"
                    for c in P.configs(spec))
    return f"""{FA.lexicon_sql()},
cfg as (select * from (values {cfg}) v(params, model, from_beam, to_beam)),
pf as (select c.params, f.src as word, f.tgt as pivot, f.p as p1 from fwd f join cfg c on c.model = f.model
       qualify row_number() over (partition by c.params, f.src order by f.p desc, f.tgt) <= c.from_beam),
pb as (select c.params, b.src as pivot, b.tgt as candidate, b.p as p2 from bwd b join cfg c on c.model = b.model
       qualify row_number() over (partition by c.params, b.src order by b.p desc, b.tgt) <= c.to_beam),
ps as (select pf.params, pf.word, pb.candidate, round(sum(p1 * p2), 9) as score
         from pf join pb on pf.params = pb.params and pf.pivot = pb.pivot group by all),
para as (select params, word, list(candidate order by score desc, candidate) as cands from ps group by all)"""


@query("aug_back_translation", substitution_sql(
    SPECS["BatchBackTranslationAug"], _bt_ctes(),
    "left join para l0 on l0.word = rows.word and l0.params = rows.params", _own("l0.cands"), 1.0, "best"))
def q_aug_back_translation(spark, sf):
    fw, bw = FA.lexicons(spark, sf)
    spec = SPECS["BatchBackTranslationAug"]
    para = A.paraphrase_table(fw, bw, spec)
    return A.aug_back_translation(examples(spark, sf), para, spec, SEED)


SUMMARY_SQL = f"""se as (select id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(sentence, ''),
              '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') as ss from ex),
it0 as (select id, i - 1 as si, ss[i] as s, {_tok_sql('ss[i]')} as w from se, unnest(range(1, len(ss) + 1)) u(i)),
wd as (select id, si, unnest(w) as word from it0),
tf as (select id, word, count(*) as tf from wd group by all),
sc as (select wd.id, wd.si, avg(tf.tf) as score from wd join tf using (id, word) group by all),
it as (select it0.*, len(w) as nw,
              case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                   else cast([] as ubigint[]) end as g,
              row_number() over (partition by it0.id order by coalesce(score, 0) desc, it0.si) as r
         from it0 left join sc on sc.id = it0.id and sc.si = it0.si),
tot as (select id, sum(nw) as nw from it group by id),
gr as (select ex.id, frac, greatest(cast(floor(frac * coalesce(tot.nw, 0)) as bigint), 10) as budget, 0 as r, 0::bigint as used,
              cast([] as ubigint[]) as grams, cast([] as bigint[]) as kept
         from ex left join tot using (id), (values (0.2::double), (0.5::double), (0.8::double)) f(frac)
       union all
       select x.id, x.frac, x.budget, x.r, case when take then used + nw else used end,
              case when take then list_concat(grams, g) else grams end, case when take then list_append(kept, si) else kept end
         from (select gr.id, frac, budget, gr.r + 1 as r, used, grams, kept, nw, g, si,
                      len(kept) = 0 or (used + nw <= budget and not list_has_any(grams, g)) as take
                 from gr join it on it.id = gr.id and it.r = gr.r + 1) x),
fin as (select id, frac, arg_max(kept, r) as kept from gr group by id, frac),
summ as (select fin.id, fin.frac, coalesce(string_agg(it.s, ' ' order by it.si), '') as summary
           from fin left join it on it.id = fin.id and list_contains(fin.kept, it.si) group by all)"""


@query("aug_summary", f"""with recursive ex as {EX_SQL}, {SUMMARY_SQL}
select pv.aug_name, cast(pv.n as bigint) as n, pv.params, ex.id, summ.summary as sentence
  from ex join {_plan_values(SPECS['BatchAbstSummAug'])} on pv.side = case when annotation = 'UNL' then 'unlabelled' else 'labelled' end
          join summ on summ.id = ex.id and summ.frac = cast(json_extract_string(pv.params, '$.max_length') as double)""")
def q_aug_summary(spark, sf):
    return A.aug_summary(examples(spark, sf), SPECS["BatchAbstSummAug"])


SUCC_SQL = f"""{BIGRAM_SQL},
sp as (select word, candidate, score / sum(score) over (partition by word) as p,
              row_number() over (partition by word order by score desc, candidate) as rank from bc),
sl as (select word, list(candidate order by rank) as cs, list(p order by rank) as ps from sp where rank <= 50 group by word),
sm as (select *, list_transform(range(1, len(ps) + 1), lambda i: list_reduce(ps[1:i], lambda x, y: x + y)) as sums from sl),
succ as (select word, cs[1:k] as cands, sums[1:k] as cum
           from (select *, least(len(cs), 1 + len(list_filter(sums, lambda c: c < 0.9::double))) as k from sm) x)"""


@query("aug_next_sentence", f"""with recursive ex as {EX_SQL}, {SUCC_SQL},
st as (select id, pv.aug_name, cast(pv.n as bigint) as n, pv.params, sentence, {_tok_sql('sentence')}[-1] as cur
         from ex join {_plan_values(SPECS['ContextualWordEmbsForSentenceAug'])}
           on pv.side = case when annotation = 'UNL' then 'unlabelled' else 'labelled' end),
wk as (select id, n, params, 0 as step, cur, cast([] as varchar[]) as gen from st
       union all
       select w.id, w.n, w.params, step + 1, s.cands[least(1 + len(list_filter(s.cum, lambda c: c <= u.u * s.cum[-1])), len(s.cands))],
              case when s.word is null then gen else list_append(gen,
                s.cands[least(1 + len(list_filter(s.cum, lambda c: c <= u.u * s.cum[-1])), len(s.cands))]) end
         from wk w left join succ s on s.word = w.cur,
              lateral (select ('0x' || substr(md5(concat_ws(':', '42', w.id, w.n, w.params, w.step)), 1, 8))::bigint / 4294967296.0 as u) u
        where step < {NEXT_STEPS})
select st.aug_name, st.n, st.params, st.id,
       case when len(gen) > 0 then st.sentence || ' ' || array_to_string(gen, ' ') else st.sentence end as sentence
  from st join wk on wk.id = st.id and wk.n = st.n and wk.params = st.params and wk.step = {NEXT_STEPS}""")
def q_aug_next_sentence(spark, sf):
    succ = C.successors(table(spark, sf, "documents"), k=50, top_p=0.9)
    return A.aug_next_sentence(examples(spark, sf), succ, SPECS["ContextualWordEmbsForSentenceAug"],
                               steps=NEXT_STEPS, seed=SEED)


def sometimes(spark, sf, preset: str):
    """A random pipeline over one row per (id, repeat) for the unlabelled side's two repeats."""
    rows = examples(spark, sf).select("id", "sentence", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    steps, p = presets.random_pipeline(preset, resources(spark, sf), SEED)
    out = A.augment_sometimes(rows, steps, p=p, seed=SEED)
    return out.select("id", "n", "sentence", F.array_join("applied", ",").alias("applied"))


@query("augment_sometimes")
def q_augment_sometimes(spark, sf):
    """The strong random pipeline: embedding neighbours, synonyms, next sentence, summary, each for 0.3 of the rows."""
    return sometimes(spark, sf, "strong")


@query("augment_weak")
def q_augment_weak(spark, sf):
    """The weak random pipeline: embedding neighbours and synonyms, each for 0.4 of the rows."""
    return sometimes(spark, sf, "weak")


def _reverse_words(texts):
    return [" ".join(reversed(t.split(" "))) for t in texts]


@query("batch_augment", """select cast(doc_id as varchar) as id,
       array_to_string(list_reverse(string_split('summarize: ' || text, ' ')), ' ') as sentence
  from documents""")
def q_batch_augment(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                             F.col("text").alias("sentence"))
    return A.batch_augment(d, _reverse_words, batch_size=30, prefix="summarize: ")
