"""Small document tables with awkward rows, and plain-Python counterparts."""

from tests.conftest import SF_CHECK, SF_SMALL  # noqa: F401

#: Columns of an input that share names with what operators use inside.
CLASH = "n bigint, token string, set_id string, h string, hash string, at string, _id string, text_key string, score string, part string"


def doc_frame(spark, rows):
    """(doc_id, text) rows as a documents table with extra, clashing columns."""
    extra = (1, "x", "x", "x", "x", "x", "x", "x", "x", "x")
    return spark.createDataFrame([(*r, "en", "src", 1, *extra) for r in rows],
                                 f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}")


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, texts beyond ASCII."""
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    return doc_frame(spark, [
        (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " \n\t "), (None, "a null id"), (5, "x"),
        (6, long), (7, "é ß 中文 😀 ▁   end"), (7, "é ß 中文 😀 ▁   end"), (8, "a  double   blank "), (None, None),
        (9, "y" * 5000), (1, "The quick brown fox jumps over the lazy dog."),
    ])


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows):
    """{index: (size, least id of the component)} by comparing all texts."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (len(sets[i]), (min(ids) if ids else None) if sets[i] else d)
    return out
