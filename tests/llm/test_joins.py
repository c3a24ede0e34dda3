import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.llm import decontaminate as dc
from fewlabel.llm import jaccard_join as jj
from fewlabel.llm import learned_ann as ann
from fewlabel.llm import text_bytes as tb
from fewlabel.llm.common import table
from fewlabel.llm.components import components
from fewlabel.session import checkpoint_dir
from tests.llm.helpers import SF_SMALL, awkward, brute_classes, doc_frame, shingles


def check_classes(spark, rows):
    want = brute_classes(rows)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    expect = sorted(((rows[i][0], *want[i]) for i in range(len(rows))), key=key)
    got = sorted((tuple(r) for r in jj.similar_classes(doc_frame(spark, rows)).collect()), key=key)
    assert got == expect


def words(r, n, k=400):
    return [f"t{r.randint(0, k)}" for _ in range(n)]


def test_classes_of_awkward_rows(spark):
    check_classes(spark, [(r.doc_id, r.text) for r in awkward(spark).collect()])
    assert jj.similar_classes(doc_frame(spark, [])).count() == 0


def test_classes_of_small_sets_and_near_copies(spark):
    """Sets on both sides of every possible boundary, and a chain of copies that differ more and more."""
    r, rows = random.Random(3), []
    for n in range(1, 24):
        base = words(r, n + 4, 10 ** 6)
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 1 + n // 8)):
                w[r.choice([0, -1, r.randrange(len(w))])] = f"z{r.randint(0, 10 ** 6)}"
            rows.append(w[:-1] if r.random() < 0.3 else w)
    chain = words(r, 120, 10 ** 6)
    for i in range(30):
        chain = [*chain[3:], *words(r, 3, 10 ** 6)]
        rows.append(list(chain))
    r.shuffle(rows)
    check_classes(spark, [(i * 3 % 1009, " ".join(w)) for i, w in enumerate(rows)])


def test_classes_with_one_large_group_and_a_common_passage(spark, monkeypatch):
    """Pairwise similarities around the threshold, small blocks and salted lists: nothing may be lost."""
    monkeypatch.setattr(jj, "BLOCK_SETS", 8)
    r = random.Random(5)
    base, passage, rows = words(r, 80, 10 ** 6), words(r, 30, 10 ** 6), []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"q{r.randint(0, 10 ** 6)}"
        rows.append(w)
    rows += [words(r, r.randint(5, 60), 10 ** 6) + passage for _ in range(100)]
    check_classes(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])


@pytest.mark.parametrize("step", [1, 7, 10, 60, 500])
@pytest.mark.parametrize("size", [51, 61, 121, 130])
def test_lists_longer_than_the_buffer_lose_no_member(monkeypatch, size, step):
    """Long lists of both kinds between short ones, with copies, in batches of any size; a list's rest has no partners in itself."""
    monkeypatch.setattr(jj, "LIST_ROWS", 1)
    rows = []
    for kind in (0, 1):
        for token, m in ((3, 1), (5, size), (6, 1), (8, size), (9, 2)):
            for i in range(m):
                n = 10 if kind or m == 2 or i % 2 == 0 else 1000 * 2 ** (i // 2 % 5)
                rows += [(kind, token, 0, False, 100 * token + i, n, 0)] * (1 + (i % 5 == 0))
    names = ["kind", "token", "salt", "hot", "set_id", "n", "pos"]
    types = [jj.pa.int32(), jj.pa.int64(), jj.pa.int32(), jj.pa.bool_(), jj.pa.int64(), jj.pa.int32(), jj.pa.int32()]
    batches = [jj.pa.RecordBatch.from_arrays([jj.pa.array(c, t) for c, t in zip(zip(*rows[i:i + step]), types)], names=names)
               for i in range(0, len(rows), step)]
    got = [tuple(r.values()) for b in jj._lists(iter(batches)) for r in b.to_pylist()]
    entries = [(r[1], r[4]) for r in got if r[0] == 0]
    links = [(r[1], r[4]) for r in got if r[0] == 1]
    long = {(t, 100 * t + i) for t in (5, 8) for i in range(size)}
    assert set(entries) == long | {(9, 900), (9, 901)} and len(entries) == len(set(entries))
    assert {x for x in links if x[0] != x[1]} == {(100 * t, s) for t, s in long if s != 100 * t} | {(900, 901)}


def test_classes_of_a_table_equal_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_classes(docs).collect()}
    assert got == {rows[i][0]: want[i] for i in want}


def test_boundary_by_cost():
    assert jj.cost_boundary({}) == 0 and jj.cost_boundary({500: 10}) == 0
    assert jj.cost_boundary({1: 100, 3: 100, 4: 100}) == 5
    for n in range(1, 60):
        assert jj.prefix_size(n) == min(n - o + 1 for o in [min(x for x in range(n + 1) if 100 * x >= 80 * n)])
    for a in range(1, 15):
        for b in range(1, 15):
            assert jj.overlap_needed(a, b) == min(o for o in range(a + b + 1) if 100 * o >= 80 * (a + b - o))


def test_block_roots_equal_pairwise_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(100, 10 ** 9, rng.integers(0, 6))])).astype(np.uint64) for _ in range(40)]
    ids = rng.permutation(1000)[:40].astype(np.int64)
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if jj.linked(sets[i], sets[j]):
                    root[i] = min(root[i], root[j], key=lambda x: ids[x])
    assert jj.block_roots(sets, ids).tolist() == [int(ids[x]) for x in root]


def test_sketch_blocks_are_small_and_lossless():
    for rate in (0.0, 0.05, 3.0):
        counts = np.random.default_rng(3).poisson(rate, 1 << jj.SKETCH_BLOCK).astype(np.uint8)
        assert (jj.unpacked(jj.packed(counts)) == counts).all()
    counts = np.random.default_rng(3).poisson(0.05, 1 << jj.SKETCH_BLOCK).astype(np.uint8)
    assert len(jj.packed(counts)) < 0.6 * len(zlib.compress(counts.tobytes(), 1))


def test_sketches_of_tasks_do_not_stay(spark):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    r = random.Random(8)
    jj.similar_classes(doc_frame(spark, [(i, " ".join(words(r, 30))) for i in range(40)])).count()
    made = [p for p in set(folder.iterdir()) - before if p.name.startswith("jaccard")]
    assert made and all("counts" not in spark.read.parquet(str(p)).columns for p in made)


def test_histograms_pass_every_link_and_most_others_go():
    import pyarrow as pa
    r = np.random.default_rng(5)
    rows = []
    for n in (1, 5, 60, 400, 2_000, 90_000):
        for share in (0.0, 0.5, 0.75, 0.89, 0.9, 1.0):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[:int(n * share)], r.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)])
            rows.append((np.unique(a), np.unique(b)))
    k = list(range(len(rows)))
    x, y = ([jj.histogram(p[i]) for p in rows] for i in (0, 1))
    batch = pa.record_batch([pa.array(k), pa.array(k), pa.array(k), pa.array(k), pa.array(x, pa.binary()), pa.array(y, pa.binary())],
                            names=["a", "b", "comp_a", "comp_b", "x", "y"])
    kept = set(next(iter(jj._may_link(iter([batch])))).column("a").to_pylist())
    assert {i for i in k if jj.linked(*rows[i])} <= kept and not {0, 6, 12, 18, 19, 24} & kept - {0, 6}
    assert x[-1] is None and len(rows) - 1 in kept


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(30)] + [(500, 501 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shingles_equal_plain_sets(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tb, "BLOCK", 64)
    texts = ["a b c d e f", "A  b\tC d E f", "", None, " ", "x" * 300 + " y", "a b c", " a b", "é É e", "word " * 200, "a b c d e", "b c d e f"]
    got = list(tb.shingle_sets(pa.array(texts), 5, 100))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert got[0].tolist() == got[1].tolist() and len(np.intersect1d(got[0], got[10])) == 1
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(t) & shingles(u))


def test_one_of_each_class_keeps_columns_and_one_row(spark):
    a, b = "one two three four five six seven", "other words that are here for the test"
    docs = doc_frame(spark, [(5, a), (3, a), (None, a), (9, b), (9, b), (4, ""), (8, None), (None, "x y z"), (7, "solo"), (7, "duo duo")])
    got = jj.one_of_each_class(docs)
    assert got.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert rows == sorted([(3, a), (9, b), (4, ""), (8, None), (None, "x y z"), (7, "solo"), (7, "duo duo")], key=str)


ITEM = "the answer to this question is forty two and nothing else at all here"


def items(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id bigint, text string, hash bigint, sketch string")


def brute_contained(docs, its):
    out = {}
    for d, t in docs:
        for i, u in its:
            w, v = (t or "").encode().lower().split(), (u or "").encode().lower().split()
            if not v or t is None:
                continue
            k = min(5, len(v))
            mine = {tuple(v[x:x + k]) for x in range(len(v) - k + 1)}
            theirs = {tuple(w[x:x + k]) for x in range(len(w) - k + 1)}
            o = len(mine & theirs)
            if 100 * o >= 80 * len(mine):
                out[d, i] = (len(mine), max(o, out.get((d, i), (0, 0))[1]))
    return out


@pytest.mark.parametrize("broadcast_rows", [10 ** 6, 0])
def test_contained_items_equal_brute_force(spark, broadcast_rows):
    r = random.Random(7)
    its = [(1, ITEM), (2, "short"), (3, "Two Words"), (4, None), (5, ""), (6, ITEM), *[(10 + i, " ".join(words(r, r.randint(5, 40)))) for i in range(25)]]
    docs = [(1, "before " * 9 + ITEM.upper() + " after" * 9), (2, ITEM[:-15]), (3, "a short one"), (4, None), (5, ""), (None, ITEM), (1, ITEM), (1, ITEM)]
    full = [t for _, t in its if t]
    for i in range(80):
        w = words(r, r.randint(0, 30)) + (r.choice(full).split() if r.random() < 0.7 else words(r, 20))
        if w and r.random() < 0.5:
            w[r.randrange(len(w))] = "changed"
        docs.append((100 + i, " ".join([*w, *words(r, 5)])))
    docs += [(r.doc_id, r.text) for r in awkward(spark).collect()]
    got = dc.contained_items(doc_frame(spark, docs), items(spark, its), broadcast_rows=broadcast_rows).collect()
    assert {(g.doc_id, g.item_id): (g.n_item, g.n_shared) for g in got} == brute_contained(docs, its) and len(got) == len(brute_contained(docs, its))


def test_sketches_select_fewer_pairs_than_share_a_shingle(spark):
    its = [(i, " ".join(f"{c}{i}" for c in "abcdefghijklmnopqrstuvwxyzab")) for i in range(40)]
    docs = [(i, " ".join(t.split()[:5]) + f" and text number {i}") for i, t in its] + [(100, its[3][1])]
    d, rows = doc_frame(spark, docs), dc.sketched(dc.item_shingles(items(spark, its)))
    met = {(r.doc_id, r.item_id) for r in dc.candidate_pairs(d, rows, [5], rows.where("in_sketch").count()).collect()}
    assert (100, 3) in met and met <= {(i, i) for i in range(40)} | {(100, 3)}
    assert len(met) < 25, met  # 41 pairs share a shingle; a sketch holds 7 of 24
    assert [(r.doc_id, r.item_id) for r in dc.contained_items(d, items(spark, its)).collect()] == [(100, 3)]


@pytest.mark.parametrize("broadcast_rows", [10 ** 6, 0])
def test_clean_documents_and_empty_tables(spark, broadcast_rows):
    docs = doc_frame(spark, [(1, ITEM), (2, "clean"), (None, "x " + ITEM), (None, "clean too"), (3, None), (1, "other text of one")])
    got = dc.clean_documents(docs, items(spark, [(1, ITEM)]), broadcast_rows=broadcast_rows)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "clean"), (None, "clean too"), (3, None), (1, "other text of one")], key=str)
    assert dc.contained_items(docs, items(spark, [])).count() == 0 and dc.contained_items(doc_frame(spark, []), items(spark, [(1, ITEM)])).count() == 0
    plan = dc.contained_items(docs, items(spark, [(1, ITEM)]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, part string, ids string")


def brute_neighbours(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for q in sorted({i for i, _ in good if i % every == 0}):
        y = min((v.tolist() for i, v in good if i == q))
        best = {}
        for i, v in good:
            if i != q:
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - y) ** 2).sum())))
        for rank, (i, d) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:k], 1):
            out.add((q, rank, i, round(d, 9)))
    return out


def test_neighbours_of_awkward_vectors_are_exact_in_one_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    same = rng.standard_normal(8).astype(np.float32).tolist()
    rows += [(100 + i, same) for i in range(40)] + [(100, same), (200, None), (300, [0.0] * 8), (400, [float("nan")] + [1.0] * 7), (500, [float("inf")] * 8),
                                                    (600, [None] + [1.0] * 7), (None, same), (700, [1.0, 2.0]), (0, rows[0][1])]
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest_neighbours(vectors(spark, rows), 10, 20).collect()}
    assert got == brute_neighbours([r for r in rows if r[0] != 700], 10, 20)
    assert ann.nearest_neighbours(vectors(spark, []), 10, 20).count() == 0
    few = ann.nearest_neighbours(vectors(spark, rows[:3]), 10, 1).collect()
    assert len(few) == 6 and ann.nearest_neighbours(vectors(spark, rows[:1]), 10, 1).count() == 0


def test_recall_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.7 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    got = ann.nearest_neighbours(vectors(spark, rows), 10, 20).collect()
    want = {(q, i) for q, _, i, _ in brute_neighbours(rows, 10, 20)}
    assert len(got) == 1000 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    x = np.array([v for _, v in rows])
    part = ann.balanced_parts(ann._nearest(x, 10), 8)
    assert np.bincount(part).max() - np.bincount(part).min() <= 3
    router = ann.fit_router(x, 2000)
    assert router.parts == 8 and np.allclose(router.probabilities(x).sum(axis=1), 1)


def test_recall_on_the_table(spark):
    got = ann.nearest_neighbours(table(spark, SF_SMALL, "embeddings")).select("query_id", "vec_id").collect()
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF_SMALL, "embeddings").collect()]
    want = {(q, i) for q, _, i, _ in brute_neighbours(rows, 10, 100)}
    assert len(want & {tuple(r) for r in got}) >= 0.9 * len(want) and len(got) == len(want)


def test_no_sketch_error_changes_classes(spark, monkeypatch):
    """Order and salts of the lists come from a sketch of counts; with a useless sketch the classes are the same."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    docs = table(spark, SF_SMALL, "documents").where(F.col("doc_id") >= 0)
    want = {r.doc_id: r.component_id for r in jj.similar_classes(docs).collect()}
    size = 1 << jj.SKETCH_BITS
    rng = np.random.default_rng(0)
    monkeypatch.setattr(jj, "_sketch", lambda meta: (zlib.compress(rng.integers(0, 9, size).astype(np.uint8).tobytes(), 1), np.arange(0, size, 3), rng.integers(2, 5, len(range(0, size, 3)))))
    assert {r.doc_id: r.component_id for r in jj.similar_classes(docs).collect()} == want and len(rows) == len(want)


def test_long_words_of_a_structured_family_differ(spark):
    """A Thue-Morse word and its complement cancel in any polynomial modulo a power of two."""
    for bits in (10, 11, 12):
        x = [bin(i).count("1") % 2 for i in range(1 << bits)]
        a, b = "".join("ab"[i] for i in x), "".join("ba"[i] for i in x)
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        h, _ = tb.word_hashes(data, np.array([0, len(data)]))
        assert h[0] != h[1] and h[0] == h[2]
    rest = " some words that both texts have in common and that are many"
    rows = [(1, a + rest), (2, b + rest), (3, a + rest)]
    got = {r.doc_id: r.component_id for r in jj.similar_classes(doc_frame(spark, rows)).collect()}
    assert got[3] == 1
    assert got == {rows[i][0]: c for i, (_, c) in brute_classes(rows).items()}


def test_one_list_of_many_unlinked_sets(spark):
    """Thousands of texts that share a passage, too little of it to link."""
    rows = [(i, "the one passage that all of these texts begin with " + " ".join(f"w{i}x{j}" for j in range(14))) for i in range(3000)]
    rows += [(5000 + i, rows[i][1]) for i in range(0, 3000, 100)] + [(9999, rows[7][1] + " end")]
    got = {r.doc_id: r.component_id for r in jj.similar_classes(doc_frame(spark, rows)).collect()}
    assert all(got[5000 + i] == i for i in range(0, 3000, 100)) and got[9999] == 7
    assert sum(c != d for d, c in got.items()) == 31
