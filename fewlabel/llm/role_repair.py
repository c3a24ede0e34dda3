"""Conversation structure repair: generalised LR parsing of the roles with weighted edits.

A well-formed conversation is empty, or an optional system turn and then user / assistant
pairs::

    Conversation -> (empty) | Turns
    Turns        -> s Pair | Pair | Turns Pair
    Pair         -> u a

The LR automaton of this grammar reads a conversation row by row.  Its graph-structured stack has
one head for each state that ends a stack once all reductions are made (start, after s, after u, after
Turns); every row extends each head by keeping, reroling or deleting it, and before the first
and after every row by inserted turns.  Heads with equal stack tops are merged into the
one of least (cost, audit).  That loses nothing: of a head ``u`` the pair that ends it is reduced to Turns on the
start state whatever lies below, and of two audits of equal cost and equally many rows none begins with the other,
so their order stays when the same edits follow.

Scale: rows are dealt by ranges of (conversation, turn, ...) and read in order.  Runs of at most
``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` of text are a chunk, so a long conversation is many chunks in many
tasks.  A chunk that begins in the middle is parsed from every stack top it may meet, which gives a map
from entry to exit (cost, audit) - at most 16 entries; the maps of a conversation are composed in order by
minimum (cost, audit).  Earlier rows of equal role and text are found by grouping digests, not
rows.  Only the digest of a conversation over several chunks reads its rows in one stream, as
SHA-256 can't be composed; it holds one chunk at a time.

Defined results: rows go by turn, nulls first, rows of one turn by role and then by the text's
SHA-256; null roles and texts are one space.  A role counts by its first letter; only s, u and a can be
kept.  A null conv_id is a conversation of its own.  A conversation without rows has zeros, an empty audit and
the digest of nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import discard, importable, pick, written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
CHUNK_ROWS = 1_024
CHUNK_BYTES = 4 << 20
ROLE = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


# -- the automaton ------------------------------------------------------------------

START, SYSTEM, USER, TURNS = 0, 1, 2, 6
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (TURNS, "u"): USER, (USER, "a"): 3}
#: State -> (rule's name, length) where a rule is complete.
REDUCE = {3: ("Pair", 2), 4: ("Turns", 2), 5: ("Turns", 1), 7: ("Turns", 2)}
GOTO = {(START, "Pair"): 5, (SYSTEM, "Pair"): 4, (TURNS, "Pair"): 7, (START, "Turns"): TURNS}
#: A stack that ends in each head, from the bottom; what lies under ``u`` makes no difference.
STACK = {START: (START,), SYSTEM: (START, SYSTEM), USER: (START, USER), TURNS: (START, TURNS)}
ACCEPT = (START, TURNS)


def parse(stack: tuple[int, ...], terminal: str) -> tuple[int, ...] | None:
    """The stack after shifting a terminal and all reductions; None where it can't be shifted."""
    to = SHIFT.get((stack[-1], terminal))
    if to is None:
        return None
    stack = (*stack, to)
    while stack[-1] in REDUCE:
        name, size = REDUCE[stack[-1]]
        stack = stack[:-size]
        stack = (*stack, GOTO[stack[-1], name])
    return stack


#: The heads' transitions: (head, terminal) -> head.
AFTER = {(h, t): s[-1] for h in STACK for t in "sua" if (s := parse(STACK[h], t))}
#: The one terminal that an edit can put after a head.
PUT = {START: "u", SYSTEM: "u", USER: "a", TURNS: "u"}

Heads = dict[int, tuple[int, str]]


def _offer(heads: Heads, head: int, cost: int, audit: str) -> None:
    old = heads.get(head)
    if old is None or (cost, audit) < old:
        heads[head] = (cost, audit)


def inserted(heads: Heads) -> Heads:
    """With every turn that can be inserted here (a second one may follow the first; more never pay)."""
    out = dict(heads)
    for _ in range(2):
        for h, (cost, audit) in list(out.items()):
            _offer(out, AFTER[h, PUT[h]], cost + INSERT, audit + "I")
    return out


def read_row(heads: Heads, initial: str, must_go: bool, extra: int) -> Heads:
    """All heads after one row: deleted, kept or reroled."""
    out: Heads = {}
    for h, (cost, audit) in heads.items():
        _offer(out, h, cost + DELETE, audit + "D")
        if must_go:
            continue
        to = AFTER.get((h, initial))
        if to is not None:
            _offer(out, to, cost + extra, audit + "K")
        if PUT[h] != initial:
            _offer(out, AFTER[h, PUT[h]], cost + extra + REROLE, audit + "R")
    return inserted(out)


def best(heads: Heads) -> tuple[int, str]:
    return min(heads[h] for h in ACCEPT if h in heads)


def replay(entry: int, audit: str, roles: list[str]) -> Iterator[tuple[str, str | None, int | None]]:
    """(edit, role, row) of every edit; a deleted row has no role, an inserted turn no row."""
    head, i = entry, 0
    for e in audit:
        if e == "D":
            yield e, None, i
        elif e == "K":
            head = AFTER[head, roles[i][0]]
            yield e, roles[i], i
        else:
            role = ROLE[PUT[head]]
            head = AFTER[head, PUT[head]]
            yield e, role, None if e == "I" else i
        i += e != "I"


# -- rows in order, in chunks ----------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the rows of ``conversations`` with faults planted by a hash.

    A dropped row stays as one that is not present, so that its conversation is known.
    """
    c = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    c = c.withColumn("k", (F.crc32(key.cast("binary")) % 20).cast("int"))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return c.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (F.col("k") != 0).alias("present"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


ORDER = ["conv_id", "turn", "role", "digest", "row"]
MAP = "array<struct<entry: int, exit: int, cost: bigint, audit: string>>"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
CHUNK = (f"chunk bigint, conv_id bigint, begins boolean, ends boolean, roles array<string>, texts array<string>, blank bigint, duplicate bigint, "
         f"truncated bigint, illegal bigint, first string, last string, least_turn bigint, most_turn bigint, turns bigint, map {MAP}")
_CHUNK_NAMES = [c.split()[0] for c in CHUNK.replace(MAP, "map").split(", ")]


def _repeats(rows: DataFrame) -> DataFrame:
    """The keys of rows whose role and text came earlier in their conversation."""
    slim = rows.where("present").select(*ORDER)
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("x.row").alias("_row"))
    return slim.join(first, slim["conv_id"].eqNullSafe(first["_c"]) & (slim["role"] == first["_r"]) & (slim["digest"] == first["_d"])) \
               .where(F.col("row") != F.col("_row")).select(*ORDER)


class _Chunk:
    """One run of a conversation's rows in order: its counts and its map from stack top to stack top."""

    def __init__(self, conv_id, begins: bool) -> None:
        self.conv_id, self.begins = conv_id, begins
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.size = 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.least = self.most = None
        self.turns = 0
        self.heads = {h: inserted({h: (0, "")}) for h in ((START,) if begins else STACK)}

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        words = text.rstrip(BLANKS)
        blank = not words
        cut = not blank and not repeated and words[-1] not in ".!?"
        self.count["blank"] += blank
        self.count["duplicate"] += repeated and not blank
        self.count["truncated"] += cut
        initial = role[:1]
        if self.roles and self.roles[-1][:1] + initial not in LEGAL:
            self.count["illegal"] += 1
        if turn is not None:
            if self.least is None:
                self.least = turn
            if turn != self.most:
                self.turns += 1
                self.most = turn
        self.heads = {h: read_row(x, initial, blank or repeated, TRUNCATED * cut) for h, x in self.heads.items()}
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.roles) >= CHUNK_ROWS or self.size >= CHUNK_BYTES

    def values(self, chunk: int, ends: bool) -> tuple:
        table = [{"entry": h, "exit": e, "cost": c, "audit": a} for h, x in self.heads.items() for e, (c, a) in x.items()]
        first, last = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        return (chunk, self.conv_id, self.begins, ends, self.roles, self.texts, *(self.count[k] for k in COUNTS), first, last,
                self.least, self.most, self.turns, table)


def _chunks(schema: pa.Schema):
    """Sorted rows -> chunks.  ``chunk`` ascends in the order of the rows, over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() << 32) - 1
        out, held = [], 0
        now: _Chunk | None = None
        repeated = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "row", "kind")]
            for conv_id, turn, role, text, row, kind in zip(*cols):
                other = now is None or now.conv_id != conv_id
                if other or now.full():
                    if now is not None:
                        at += 1
                        out.append(now.values(at, other))
                        held += now.size
                        if held > CHUNK_BYTES or len(out) >= 256:
                            yield batch()
                            out, held = [], 0
                    now = _Chunk(conv_id, other and now is not None)
                if kind == 0:
                    repeated = row
                elif kind == 1:
                    now.add(turn, role, text, row == repeated)
        if now is not None:
            at += 1
            out.append(now.values(at, False))
        if out:
            yield batch()

    return run


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) as written chunks."""
    spark = rows.sparkSession
    importable(spark)
    r = pick(rows, conv_id="bigint", turn="bigint", role="string", text="string", present="boolean")
    r = r.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))
    stored: list[str] = []
    r = written(r.withColumn("digest", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id()), "repair-rows", stored)
    # a mark before each repeated row, instead of a join with the texts
    marks = _repeats(r).select(*ORDER, F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    both = r.select(*ORDER, F.when(F.col("present"), F.col("text")).alias("text"), F.when(F.col("present"), 1).otherwise(2).alias("kind")).unionByName(marks)
    ordered = both.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "kind")
    schema = pa.schema([(n, _arrow(n)) for n in _CHUNK_NAMES])
    made = written(ordered.select("conv_id", "turn", "role", "text", "row", "kind").mapInArrow(_chunks(schema), CHUNK), "repair-chunks")
    discard(spark, stored)
    return made


def _arrow(name: str) -> pa.DataType:
    if name in ("begins", "ends"):
        return pa.bool_()
    if name in ("roles", "texts"):
        return pa.list_(pa.string())
    if name in ("first", "last"):
        return pa.string()
    if name == "map":
        return pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.int64()


# -- decisions ----------------------------------------------------------------------

SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
DECIDED = "conv_id bigint, chunk bigint, entry int, edits string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _compose(parts: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one conversation -> entry and edits of each; the first row carries the whole's counts."""
    parts = parts.sort_values("chunk")
    conv_id = parts["conv_id"].iloc[0]
    heads: Heads = {START: (0, "")}
    trail, maps = [], []
    total = dict.fromkeys(COUNTS, 0)
    last, least, most, turns = None, None, None, 0
    for p in parts.itertuples():
        table = {(int(m["entry"]), int(m["exit"])): (int(m["cost"]), m["audit"]) for m in p.map}
        now: Heads = {}
        by: dict[int, int] = {}
        for (entry, leave), (cost, audit) in table.items():
            if entry in heads:
                x = (heads[entry][0] + cost, heads[entry][1] + audit)
                if leave not in now or x < now[leave]:
                    now[leave], by[leave] = x, entry
        heads = now
        trail.append(by)
        maps.append(table)
        for k in COUNTS:
            total[k] += int(getattr(p, k))
        if p.first is not None:
            total["illegal"] += last is not None and last + p.first not in LEGAL
            last = p.last
        if p.least_turn is not None:
            turns += int(p.turns) - (most is not None and most == int(p.least_turn))
            least = int(p.least_turn) if least is None else least
            most = int(p.most_turn)
    cost, audit = best(heads)
    head = min((h for h in ACCEPT if h in heads), key=lambda h: heads[h])
    entries, edits = [], []
    for by, table in zip(reversed(trail), reversed(maps)):
        entries.append(by[head])
        edits.append(table[by[head], head][1])
        head = by[head]
    gaps = 0 if least is None else most - least + 1 - turns
    n = len(parts)
    none = [None] * (n - 1)
    return pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv_id) else int(conv_id)] * n, "Int64"), "chunk": parts["chunk"].to_numpy(),
                         "entry": entries[::-1], "edits": edits[::-1], "gaps": pd.array([gaps, *none], "Int64"),
                         **{k: pd.array([total[k], *none], "Int64") for k in COUNTS}, "cost": pd.array([cost, *none], "Int64"), "audit": [audit, *none]})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that are a whole conversation -> its counts, audit and digest."""
    for b in batches:
        rows = b.to_pylist()
        out = []
        for r in rows:
            cost, audit = best({m["exit"]: (m["cost"], m["audit"]) for m in r["map"]})
            gaps = 0 if r["least_turn"] is None else r["most_turn"] - r["least_turn"] + 1 - r["turns"]
            lines = "\n".join(_lines(START, audit, r["roles"], r["texts"]))
            out.append((r["conv_id"], gaps, *(r[k] for k in COUNTS), cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
        if out:
            names = [*(c.split()[0] for c in SUMMARY.split(", ")), "repaired_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in ("audit", "repaired_sha256") else pa.int64())
                                              for n, x in zip(names, zip(*out))], names=names)


def _lines(entry: int, edits: str, roles: list[str], texts: list[str]) -> list[str]:
    return [f"{role}:{'' if i is None else texts[i]}" for _, role, i in replay(entry, edits, roles) if role is not None]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decided chunks by conversation, in order -> the digest of each conversation; one chunk is held at a time."""
    now, begun, some = None, False, False
    h = hashlib.sha256()
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["conv_id", "repaired_sha256"])

    for b in batches:
        for r in b.to_pylist():
            if not begun or r["conv_id"] != now:
                if begun:
                    out.append((now, h.hexdigest()))
                now, begun, some, h = r["conv_id"], True, False, hashlib.sha256()
            lines = _lines(r["entry"], r["edits"], r["roles"], r["texts"])
            if lines:
                h.update((("\n" if some else "") + "\n".join(lines)).encode())
                some = True
        if len(out) > 1000:
            yield batch()
            out = []
    if begun:
        out.append((now, h.hexdigest()))
    if out:
        yield batch()


def _is_whole():
    return F.col("begins") & F.col("ends")


def decided(parts: DataFrame) -> DataFrame:
    """Entry and edits of every chunk of a conversation of several chunks; its first chunk has the whole's counts."""
    importable(parts.sparkSession)
    slim = parts.where(~_is_whole()).drop("roles", "texts", "begins", "ends")
    slim = slim.withColumns({c: F.col(c).cast("string") for c in ("least_turn", "most_turn")})  # nullable integers lose digits in pandas
    return written(slim.groupBy("conv_id").applyInPandas(_compose, DECIDED), "repair-decided")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the turns of the repaired conversations, deleted rows left out.

    ``place`` ascends within a conversation; it has gaps.
    """
    parts = chunks(rows)
    edits = decided(parts).select("chunk", "entry", "edits")
    part = parts.select("chunk", "conv_id", "roles", "texts", "map", _is_whole().alias("whole")).join(edits, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                entry, e = r["entry"], r["edits"]
                if r["whole"]:
                    entry, e = START, best({m["exit"]: (m["cost"], m["audit"]) for m in r["map"]})[1]
                out = [(r["conv_id"], (r["chunk"] << 12) + k, x, role, "" if i is None else r["texts"][i])
                       for k, (x, role, i) in enumerate(replay(entry, e, r["roles"])) if role is not None]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["conv_id", "place", "edit", "role", "text"])

    return part.mapInArrow(run, "conv_id bigint, place bigint, edit string, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation."""
    parts = chunks(rows)
    whole = parts.where(_is_whole()).select("conv_id", "roles", "texts", *COUNTS, "least_turn", "most_turn", "turns", "map") \
                 .mapInArrow(_whole, f"{SUMMARY}, repaired_sha256 string")
    pieces = decided(parts)
    long = parts.where(~_is_whole()).select("chunk", "conv_id", "roles", "texts").join(pieces.select("chunk", "entry", "edits"), "chunk")
    digest = long.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string") \
                 .withColumnRenamed("conv_id", "_c")
    heads = pieces.where(F.col("audit").isNotNull()).drop("chunk", "entry", "edits")
    spread = heads.join(digest, heads["conv_id"].eqNullSafe(digest["_c"])).drop("_c")
    return whole.unionByName(spread)

