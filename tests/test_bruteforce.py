"""Queries without an SQL oracle, checked against plain-Python brute force on
the whole sf0.001 tables (every text, whole texts)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pandas as pd
import regex

from fewlabel.operators.augment import augmentors as A
from fewlabel.operators.augment import candidates as C
from fewlabel.operators.augment import plan as P
from fewlabel.plans.fixtures import examples, table
from tests.conftest import SF_SMALL

SPLIT = re.compile(r"(?<=[.!?])\s+|\n+", re.ASCII)


def tokenize(s):
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", (s or "").lower()) if t]


def py_summary(text, frac, min_words=10):
    sents = [s for s in SPLIT.split(text or "") if s.strip(" ") != ""]
    words = [tokenize(s) for s in sents]
    tf = Counter(w for ws in words for w in ws)
    items = []
    for i, ws in enumerate(words):
        score = (sum(tf[w] for w in ws) / len(ws)) if ws else 0.0
        grams = {" ".join(ws[j:j + 3]) for j in range(len(ws) - 2)} if len(ws) >= 3 else set()
        items.append((-score, i, len(ws), grams))
    items.sort(key=lambda x: (x[0], x[1]))
    budget = max(math.floor(frac * sum(len(w) for w in words)), min_words)
    kept, grams, used = [], set(), 0
    for neg, i, nw, g in items:
        if not kept or (used + nw <= budget and not (grams & g)):
            kept.append(i)
            grams |= g
            used += nw
    return " ".join(sents[i] for i in sorted(kept))


def test_summaries_match_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = A.summarize(docs, [0.2, 0.5, 0.8], id_col="doc_id", text_col="text").toPandas()
    texts = dict(docs.toPandas().itertuples(index=False))
    assert len(got) == 3 * len(texts)
    for r in got.itertuples(index=False):
        assert r.summary == py_summary(texts[r.doc_id], r.frac), (r.doc_id, r.frac)


def test_summary_augmentor_rows(spark):
    spec = {s.name: s for s in P.DEFAULT_SPECS}["BatchAbstSummAug"]
    out = A.aug_summary(examples(spark, SF_SMALL), spec)
    assert out.count() == 18 * examples(spark, SF_SMALL).count()


def py_successors(texts, k, top_p):
    counts = defaultdict(Counter)
    for t in texts:
        ws = tokenize(t)
        for a, b in zip(ws, ws[1:]):
            counts[a][b] += 1
    table_ = {}
    for w, c in counts.items():
        tot = float(sum(c.values()))
        ranked = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]
        cands, probs, before = [], [], 0.0
        for cand, n in ranked:
            p = n / tot
            if before < top_p:
                cands.append(cand)
                probs.append(p)
            before += p
        cum, acc = [], 0.0
        for p in probs:
            acc += p
            cum.append(acc)
        table_[w] = (cands, cum)
    return table_


def unit(*parts):
    return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8], 16) / 4294967296.0


def test_next_sentence_matches_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    succ = C.successors(docs, k=50, top_p=0.9)
    spec = {s.name: s for s in P.DEFAULT_SPECS}["ContextualWordEmbsForSentenceAug"]
    ex = examples(spark, SF_SMALL)
    got = A.aug_next_sentence(ex, succ, spec, steps=5, seed=42).toPandas()
    table_ = py_successors([t for (t,) in docs.select("text").collect()], 50, 0.9)
    src = dict(ex.select("id", "sentence").toPandas().itertuples(index=False))
    n_lab = ex.where("annotation <> 'UNL'").count()
    assert len(got) == 20 * n_lab + 2 * (len(src) - n_lab)
    for r in got.itertuples(index=False):
        toks = tokenize(src[r.id])
        cur, gen = (toks[-1] if toks else None), []
        for step in range(5):
            if cur not in table_:
                cur = None
                continue
            cands, cum = table_[cur]
            u = unit(42, r.id, r.n, r.params, step)
            idx = sum(1 for c in cum if c <= u * cum[-1]) + 1
            cur = cands[min(idx, len(cands)) - 1]
            gen.append(cur)
        want = src[r.id] + (" " + " ".join(gen) if gen else "")
        assert r.sentence == want, (r.id, r.n)


def test_augment_sometimes_keeps_rows_and_untouched_texts(spark):
    import __spark_entry__ as E
    out = E.queries()["augment_sometimes"](spark, SF_SMALL).toPandas()
    src = dict(examples(spark, SF_SMALL).select("id", "sentence").toPandas().itertuples(index=False))
    assert len(out) == 2 * len(src)
    assert set(zip(out["id"], out["n"])) == {(i, n) for i in src for n in (0, 1)}
    untouched = out[out["applied"] == ""]
    assert len(untouched) > 0
    assert all(r.sentence == src[r.id] for r in untouched.itertuples(index=False))
    # each step is chosen for roughly p = 0.3 of the rows
    for step in ("WordEmbsAug", "SynonymAug", "ContextualWordEmbsForSentenceAug", "BatchAbstSummAug"):
        share = out["applied"].str.contains(step).mean()
        assert 0.15 < share < 0.45, (step, share)
