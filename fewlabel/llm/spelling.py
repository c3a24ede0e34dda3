"""Spelling variants: words one edit apart by dynamic programming over sorted word lists.

Words (counted by Spark) that differ by one inserted, deleted or replaced code point are
found in lists of words that agree wherever the edit is not:

* For words of lengths g and g + 1, the place of the edit is the length of their longest common
  prefix, from 0 to g.  It lies in the first or the second half, so the words share the last or the
  first half; each half is a *region* of places.  A list holds the words of one region that agree
  before and after it, and a pair belongs to exactly one list.
* A list of more than ``list_rows`` words has its region halved again, and so on until lists are
  short or the region is one place wide (then the list is a clique of at most an alphabet's
  words, or its square with the longer words).  Nothing is capped and no list goes unscanned.
* In a sorted list every word of length g is compared with the others by the edit matrix, of
  which only the band of three cells around the diagonal can be 1 or less.  The band's row after a
  prefix is computed once and reused by all neighbours in the list that share the prefix (by the
  longest common prefixes of adjacent words); a range of words whose shared prefix already costs
  more than one edit is skipped.  Rows for all words of many lists advance together, column by column, as
  arrays; rows are packed into one of 27 states, so a column is a table look-up.

Lists that share their ends are sorted by the reversed words.  Neighbours are added up inside a
list, so a list emits a row per word, not a row per pair.  Forms are followed to their roots by
pointer doubling: a form counts five times its word at least, so chains are short.

Memory: a task holds lists of at most ``list_rows`` words each, ``BUFFER_CELLS`` code points at a time.

Defined results: a null text has no words, a null doc_id counts as empty in the key of the
planted deletions; repeated rows count again; no words give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import discard, importable, pick, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs this many times as often as its word, at least.
FORM_RATIO = 5
#: Every so manieth hash of (document, run) plants a deletion.
PLANT = 199
LIST_ROWS = 8_192
BUFFER_CELLS = 1 << 21
#: Rows of the frontier of comparisons that are advanced at a time.
FRONTIER = 1 << 15
#: Salts for the join with the keys of long lists.
SALTS = 16


# -- words ------------------------------------------------------------------------

def _lower_ascii(run: Column) -> Column:
    """Lower-case A-Z only; where all is ASCII the plain function does that."""
    ascii_only = F.length(run) == F.octet_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the letter runs of all texts after the planted deletions.

    A deletion only shortens a run, so shorter runs need not be looked at.
    """
    d = pick(docs, doc_id="string", text="string")
    runs = d.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"),
                    F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", _lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % PLANT == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# -- the sorted lists -------------------------------------------------------------

def _listed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, g, lo, hi) with the key of their list: what lies before and after the region."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    k = F.greatest(F.col("g") - F.col("hi"), F.lit(0))
    after = F.when(k > 0, F.substring("word", F.length("word") - k + 1, k)).otherwise(F.lit(""))
    return rows.withColumn("list", F.xxhash64("g", "lo", "hi", before, after))


def _regions(rows: DataFrame) -> DataFrame:
    """Every row once for each half of its region of places [lo, hi)."""
    mid = F.expr("div(lo + hi, 2)").cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return rows.withColumn("_half", F.explode(halves)).select("word", "n", "g", F.col("_half.lo").alias("lo"), F.col("_half.hi").alias("hi"))


KEY = ["list", "g", "lo", "hi"]


def sorted_lists(words: DataFrame, list_rows: int = LIST_ROWS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n, g, lo, hi, list: every word in the lists of its own length and of the next shorter one."""
    size = F.length("word")
    lengths = words.withColumn("g", F.explode(F.array(size, size - 1))).where(F.col("g") >= least_length)
    rows = _listed(_regions(lengths.withColumn("lo", F.lit(0)).withColumn("hi", F.col("g") + 1)))
    out = None
    while True:
        long = written(rows.where(F.col("hi") - F.col("lo") > 1).groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"))
                       .where(F.col("c") > list_rows).drop("c"), "spelling-long-lists")
        if long.isEmpty():
            return rows if out is None else out.unionByName(rows)
        # salted, as such a list may hold a third of all words
        salted = long.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_long", F.lit(True))
        marked = rows.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(salted, [*KEY, "_salt"], "left").drop("_salt")
        marked = written(marked, "spelling-lists")
        short = marked.where(F.col("_long").isNull()).drop("_long")
        out = short if out is None else out.unionByName(short)
        rows = _listed(_regions(marked.where("_long").drop("_long", "list")))


# -- the banded matrix --------------------------------------------------------------

def _rows() -> tuple[np.ndarray, np.ndarray]:
    """The next packed row for each packed row and each of 8 outcomes of three comparisons, and the least cell of each row.

    A row after d letters of the entry holds the costs (2: two or more) against the first d - 1, d and d + 1
    letters of the query; the comparisons are of the entry's next letter with the query's letters d - 1, d, d + 1.
    """
    step = np.zeros((27, 8), np.uint8)
    least = np.zeros(27, np.uint8)
    for x, y, z in product(range(3), repeat=3):
        state = 9 * x + 3 * y + z
        least[state] = min(x, y, z)
        for a, b, c in product(range(2), repeat=3):  # 1: equal
            x2 = min(2, x + 1 - a, y + 1)
            y2 = min(2, y + 1 - b, z + 1, x2 + 1)
            z2 = min(2, z + 1 - c, y2 + 1)
            step[state, 4 * a + 2 * b + c] = 9 * x2 + 3 * y2 + z2
    return step, least


_STEP, _LEAST = _rows()
_FIRST = np.uint8(9 * 2 + 3 * 0 + 1)  # no letters read: no cell before the diagonal


def near_pairs(entries: np.ndarray, bounds: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, entry) of all pairs one edit apart within the lists; a query has g code points.

    ``entries`` is a matrix of code points (g + 1 columns, 0 after the end), sorted within each list;
    list i is rows ``bounds[i]`` to ``bounds[i + 1]``.
    """
    n = len(entries)
    size = np.where(entries[:, g] != 0, g + 1, g)
    same = np.zeros((n, g + 1), bool)
    same[1:] = entries[1:] == entries[:-1]
    lcp = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    lcp[bounds[:-1]] = -1  # a list begins
    lo = np.repeat(bounds[:-1], np.diff(bounds))
    hi = np.repeat(bounds[1:], np.diff(bounds))
    queries = np.flatnonzero((size == g) & (hi - lo > 1))
    padded = np.zeros((n, g + 4), entries.dtype)
    padded[:, 1:g + 2] = entries  # query letter i in column i + 1, so that i - 1 and i + 1 exist
    starts = [np.flatnonzero(lcp <= d) for d in range(g + 1)]  # where a new prefix of d + 1 letters begins
    q_out, e_out = [], []
    for i in range(0, len(queries), 4096):
        q = queries[i:i + 4096]
        todo = [(0, q, lo[q], hi[q], np.full(len(q), _FIRST))]
        while todo:
            d, q, a, b, state = todo.pop()
            if len(q) > FRONTIER and len(q) > 1:
                half = len(q) // 2
                todo += [(d, q[:half], a[:half], b[:half], state[:half]), (d, q[half:], a[half:], b[half:], state[half:])]
                continue
            if d >= g:
                # entries of g letters end here; with one letter more the cell beside the diagonal decides
                short = size[a] == g
                hit = short & ((state // 3) % 3 == 1)
                q_out.append(q[hit])
                e_out.append(a[hit])
                a = a + short  # the shorter word sorts first
                longer = a < b
                q, a, b, state = q[longer], a[longer], b[longer], state[longer]
            # the prefixes one letter longer within each range
            s = starts[d]
            first = np.searchsorted(s, a, "right") - 1
            last = np.searchsorted(s, b, "left")
            k = last - first
            at = np.repeat(np.arange(len(q)), k)
            child = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            begin = np.maximum(s[child], a[at])
            end = np.minimum(np.append(s, n)[child + 1], b[at])
            q, state = q[at], state[at]
            letter = entries[begin, d]
            bits = (4 * (padded[q, d] == letter) + 2 * (padded[q, d + 1] == letter) + (padded[q, d + 2] == letter)).astype(np.uint8)
            state = _STEP[state, bits]
            live = _LEAST[state] <= 1
            q, begin, end, state = q[live], begin[live], end[live], state[live]
            if d == g:
                hit = state // 9 == 1
                at = np.repeat(np.flatnonzero(hit), (end - begin)[hit])
                q_out.append(q[at])
                e_out.append(begin[at])
            elif len(q):
                todo.append((d + 1, q, begin, end, state))
    return (np.concatenate(q_out) if q_out else np.zeros(0, np.int64), np.concatenate(e_out) if e_out else np.zeros(0, np.int64))


def _matrix(words: list[str], columns: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{columns}").view(np.uint32).reshape(len(words), columns)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def _neighbours(rows: list[tuple], g: int) -> tuple:
    """Of whole lists of one g: word, n_near, best_n, best for the words that have neighbours."""
    words = [r[1] for r in rows]
    n = np.array([r[2] for r in rows], np.int64)
    lo, hi = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
    keys = [(r[0], r[3], r[4]) for r in rows]
    new = np.array([True] + [x != y for x, y in zip(keys[1:], keys)])
    bounds = np.append(np.flatnonzero(new), len(rows))
    q, e = near_pairs(_matrix([r[5] for r in rows], g + 1), bounds, g)
    plain = _matrix(words, g + 1)
    place = _shared(plain[q], plain[e])
    place = np.minimum(place, g)
    mine = (place >= lo[q]) & (place < hi[q]) & (q != e)
    q, e = q[mine], e[mine]
    longer = plain[e, g] != 0  # the other direction of these pairs: words of g letters see one another anyway
    q, e = np.concatenate([q, e[longer]]), np.concatenate([e, q[longer]])
    if not len(q):
        return [], [], [], []
    by_word = np.array(words)
    order = np.lexsort((by_word[e], -n[e], q))
    q, e = q[order], e[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    near = np.diff(np.append(first, len(q)))
    return [words[i] for i in q[first].tolist()], near.tolist(), n[e[first]].tolist(), [words[i] for i in e[first].tolist()]


def neighbours(lists: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: each word's count of near words and its most frequent one (ties: least in code-point order)."""
    importable(lists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held_g, cells, begun = None, 0, 0  # ``begun``: where the list that may go on starts

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                word, near, best_n, best = _neighbours(rows, held_g)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
                                                 names=["word", "n_near", "best_n", "best"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("list", "word", "n", "lo", "hi", "ord", "g")]
            for r in zip(*cols):
                g = r[6]
                if rows and (g != held_g or (r[0], r[3], r[4]) != (rows[-1][0], rows[-1][3], rows[-1][4])):
                    if len(rows) - begun == 1:  # a word alone in its list
                        rows.pop()
                        cells -= held_g + 1
                    begun = len(rows)
                    if g != held_g or cells > BUFFER_CELLS:
                        yield from done(rows)
                        rows, cells, begun = [], 0, 0
                held_g = g
                rows.append(r[:6])
                cells += g + 1
        yield from done(rows)

    # lists that share their ends are sorted from the end
    ordered = lists.withColumn("ord", F.when(F.col("lo") == 0, F.reverse("word")).otherwise(F.col("word")))
    ordered = ordered.repartition("list").sortWithinPartitions("g", "list", "lo", "hi", "ord")
    found = ordered.select("list", "word", "n", "lo", "hi", "ord", "g").mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    # the least of (-n, word) is the most frequent, then the least word
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("best"))).alias("x")) \
                .select("word", "n_near", (-F.col("x.k")).alias("best_n"), F.col("x.best").alias("best"))


# -- forms and roots ----------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last, by pointer doubling."""
    spark, before = forms.sparkSession, []
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots", before)
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now: list[str] = []
        moved = written(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
                        "spelling-roots", now)
        discard(spark, before)
        at, before = moved.drop("_moved"), now
        if moved.where("_moved").isEmpty():
            return at


def variants(docs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with its near words' count, its form and root."""
    words = written(word_counts(docs), "spelling-words")
    near = neighbours(sorted_lists(words, list_rows))
    of_word = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("best_n") >= FORM_RATIO * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= FORM_RATIO * F.col("n"), F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(of_word.where(F.col("form").isNotNull()).select("word", "form"))
    return of_word.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
