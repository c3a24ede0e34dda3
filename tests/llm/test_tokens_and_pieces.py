import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fewlabel.llm import piece_sampling as ps
from fewlabel.llm import token_counts as tc
from fewlabel.llm.common import piece_model, table
from tests.llm.helpers import SF_SMALL, awkward, doc_frame


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def transducer():
    return tc.TokenTransducer(piece_model())


def random_texts(transducer, n, seed=0):
    r = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDE0123456789.,;:!?()'\"-_/ \n\t") + [" ", "  ", "é", "ß", "中", "▁", "😀"]
    pieces = list(transducer.score)
    for i in range(n):
        yield "".join(r.choice(letters if i % 2 else pieces) for _ in range(r.randint(0, 25)))


def test_counts_equal_the_library_on_random_texts_whole_and_in_chunks(library, transducer):
    for t in random_texts(transducer, 3000):
        n = len(library.encode(t))
        assert [transducer.count(t, c) for c in (1 << 16, 1, 3, 7)] == [n] * 4, t


def test_combine_is_associative(transducer):
    r = random.Random(1)
    for t in random_texts(transducer, 200, 2):
        t = " " + t.replace("▁", " ")
        cuts = sorted(r.randint(0, len(t)) for _ in range(2))
        a, b, c = (transducer.chunk_map(x) for x in (t[:cuts[0]], t[cuts[0]:cuts[1]], t[cuts[1]:]))
        assert transducer.combine(transducer.combine(a, b), c) == transducer.combine(a, transducer.combine(b, c)) == transducer.chunk_map(t)


def test_counts_of_awkward_rows_and_of_a_table(spark, library):
    rows = tc.token_counts(awkward(spark), piece_model(), max_tokens=1000).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in awkward(spark).collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1000) for r in rows)
    docs = table(spark, SF_SMALL, "documents")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, piece_model()).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "")) for r in docs.collect()}
    assert tc.token_counts(doc_frame(spark, []), piece_model()).count() == 0


def test_samples_are_exact_draws_of_the_lattice():
    of = ps.PieceLattice(piece_model())
    n = 20_000
    ids, at = of.encode(["hello"] * n, np.arange(n).astype(np.uint64))
    found = {}
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        k = tuple(ids[a:b].tolist())
        found[k] = found.get(k, 0) + 1

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in of.ids:
                i = of.ids[s[:k]]
                for rest, p in paths(s[k:]):
                    yield (i, *rest), of.p[i] * p

    all_paths = dict(paths(" hello"))
    total = sum(all_paths.values())
    assert set(found) <= set(all_paths)
    for path, p in all_paths.items():
        assert abs(found.get(path, 0) / n - p / total) < 0.02


def test_encoding_is_lossless_and_reproducible(spark):
    docs = awkward(spark)
    one = ps.encode(docs, piece_model())
    two = ps.encode(docs.repartition(5), piece_model())
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids is None, r.ids or [])
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
    assert one.where("not lossless").count() == 0
    assert one.where("ids is null").count() == docs.where("text is null").count()
    texts = lambda df: sorted((r.doc_id or -1, r.text or "", r.text is None) for r in df.select("doc_id", "text").collect())
    assert texts(ps.decode(one, piece_model())) == texts(docs)
    whole = table(spark, SF_SMALL, "documents")
    assert ps.encode(whole, piece_model()).where("not lossless or n_pieces <> size(ids)").count() == 0
    assert ps.encode(doc_frame(spark, []), piece_model()).count() == 0


def test_another_seed_gives_other_segmentations(spark):
    docs = table(spark, SF_SMALL, "documents")
    a, b = ps.encode(docs, piece_model(), seed=1), ps.encode(docs, piece_model(), seed=2).withColumnRenamed("ids", "ids2")
    assert a.join(b.select("doc_id", "ids2"), "doc_id").where(F.col("ids") != F.col("ids2")).count() > docs.count() / 2


def test_table_overflow_keeps_results(monkeypatch):
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    keys = np.arange(len(texts)).astype(np.uint64)
    want, _ = ps.PieceLattice(piece_model()).encode(texts, keys)
    monkeypatch.setattr(ps, "TABLE_NODES", 500)
    of = ps.PieceLattice(piece_model())
    got = [of.encode([t], keys[i:i + 1])[0] for i, t in enumerate(texts)]
    assert np.array_equal(np.concatenate(got), want)


def test_a_null_key_draws_for_itself(spark):
    """A null id shares its draws with no ordinary id, -1 included."""
    text = "some ordinary words that have many segmentations into pieces " * 20
    got = [tuple(r.ids) for r in ps.encode(doc_frame(spark, [(None, text), (-1, text), (0, text), (None, text)]), piece_model()).collect()]
    assert len(set(got)) == 3
