"""Spelling variants against plain counting and comparing."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fewlabel.llm import spelling as sp
from tests.llm.helpers import SF_CHECK, SF_SMALL, awkward, doc_frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    n = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_near(words):
    """Near words by the words that one deletion leaves."""
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for ws in by.values():
        for a in ws:
            for b in ws:
                if a != b and (abs(len(a) - len(b)) == 1 and _one_inserted(a, b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1):
                    near[a].add(b)
    return near


def _one_inserted(a, b):
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = brute_counts(rows)
    near = brute_near(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("sf,list_rows", [(SF_SMALL, sp.LIST_ROWS), (SF_CHECK, sp.LIST_ROWS), (SF_CHECK, 6)])
def test_tables(spark, sf, list_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(sp.variants(docs, list_rows)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def _vocabulary():
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(900)}
    words |= {"prefix" + "".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(900)}
    words |= {"".join(rng.choice(list("abc"), rng.integers(1, 7))) + "suffix" for _ in range(400)}
    return {w: 5 + i % 200 * (i % 3) for i, w in enumerate(sorted(words))}


@pytest.mark.parametrize("list_rows", [4, 40, sp.LIST_ROWS])
def test_dense_vocabulary_and_hot_prefix(spark, list_rows):
    """Lists much longer than the bound are split until nothing is left to split."""
    n = _vocabulary()
    near = brute_near(n)
    lists = sp.sorted_lists(spark.createDataFrame(list(n.items()), "word string, n bigint"), list_rows)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in sp.neighbours(lists).collect()}
    want = {w: (len(v), *min((-n[x], x) for x in v)) for w, v in near.items() if v}
    assert got == {w: (k, -m, b) for w, (k, m, b) in want.items()}


def test_split_lists_are_short(spark):
    words = spark.createDataFrame([(w, 5) for w in _vocabulary()], "word string, n bigint")
    lists = sp.sorted_lists(words, 20)
    long = [r for r in lists.groupBy(*sp.KEY).count().where("count > 20").collect()]
    assert all(r.hi - r.lo == 1 for r in long)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=3, max_size=4), min_size=1, max_size=40))
def test_matrix_rows(words):
    words = sorted(words)
    entries = sp._matrix(words, 4)
    q, e = sp.near_pairs(entries, np.array([0, len(words)]), 3)
    near = brute_near(words)
    assert sorted(zip(q.tolist(), e.tolist())) == sorted((i, words.index(b)) for i, a in enumerate(words) if len(a) == 3 for b in near[a])


def test_chain_ties_and_awkward_rows(spark):
    text = " ".join(["kitchen"] * 200 + ["kitchin"] * 40 + ["kitchinn"] * 8 + ["kitchinnn"] * 5 + ["litchen"] * 200 + ["Éclairs"] * 30 + ["éclairs"] * 5 + ["ABCDEF"] * 9)
    rows = [(1, text), (2, None), (3, ""), (None, text), (4, "x" * 50_000), (1, text), (5, " ".join(["y" * 300, "y" * 301] * 6))]
    got = found(sp.variants(doc_frame(spark, rows)))
    assert got == brute(rows)
    root = {w: r for w, _, r, *_ in got}
    assert root["kitchinn"] == "kitchen" and root["kitchin"] == "kitchen"


def test_no_words(spark):
    assert sp.variants(doc_frame(spark, [])).count() == 0
    assert sp.variants(doc_frame(spark, [(1, "a b c"), (2, None)])).count() == 0
    docs = awkward(spark)
    assert found(sp.variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
