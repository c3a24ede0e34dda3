"""Conversation repair against a search over all edits."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fewlabel.llm import role_repair as rr
from tests.llm.helpers import SF_CHECK

WELL_FORMED = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    """conv_id -> [(turn, role, text)] after damage."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out[c] += [(t, role, text)] * (2 if k == 3 else 1)
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        w = text.rstrip(BLANKS)
        out.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, turns) by the plainest dynamic programming: whole audits and turns for every initials' state."""
    def state(initials):  # which continuations are open: by the well-formed prefixes
        if not initials:
            return "0"
        return "s" if initials == "s" else "u" if initials.endswith("u") else "t"

    def step(at, initial):
        return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("t", "u"): "u", ("u", "a"): "t"}.get((at, initial))

    def spread(best):
        for _ in range(3):
            for at, (c, a, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step(at, role[0])
                    if to and (to not in best or (c + 2, a + "I") < best[to][:2]):
                        best[to] = (c + 2, a + "I", [*out, (role, "")])
        return best

    best = spread({state(""): (0, "", [])})
    for (_, role, text), f in zip(rows, fault):
        new = {}

        def offer(to, c, a, out):
            if to and (to not in new or (c, a) < new[to][:2]):
                new[to] = (c, a, out)

        for at, (c, a, out) in best.items():
            offer(at, c + 3, a + "D", out)
            if f not in ("blank", "duplicate"):
                x = f == "truncated"
                offer(step(at, role[:1]), c + x, a + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    offer(step(at, r[0]), c + x + 2, a + "R", [*out, (r, text)])
        best = spread(new)
    return min((best[k] for k in ("0", "t") if k in best), key=lambda x: x[:2])


def brute(rows):
    out = {}
    for c, r in brute_damage(rows).items():
        f = faults(r)
        turns = [t for t, _, _ in r if t is not None]
        cost, audit, kept = cheapest(r, f)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(f.count(k) for k in ("blank", "duplicate", "truncated")),
                  sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(r, r[1:])), cost, audit,
                  hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())
    return out


def found(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, row bigint, digest string, chunk string")


def test_automaton_reads_the_grammar():
    for n in range(8):
        for word in product("sua", repeat=n):
            stack = (rr.START,)
            for t in word:
                stack = stack and rr.parse(stack, t)
            assert bool(stack and stack[-1] in rr.ACCEPT) == bool(WELL_FORMED.fullmatch("".join(word)))


def _all_edits(initials, fault):
    """Every edit sequence with at most two turns inserted in each place."""
    def one(i):
        if i == len(initials):
            return [("", "", 0)]
        rest = gap(i + 1)
        own = [("D", "", 3)]
        if fault[i] not in ("blank", "duplicate"):
            x = fault[i] == "truncated"
            own += [("K", initials[i], x), ("R", "u", 2 + x), ("R", "a", 2 + x)]
        return [(a + b, p + q, c + d) for a, p, c in own for b, q, d in rest]

    def gap(i):
        ins = [("I" * k, "".join(w), 2 * k) for k in range(3) for w in product("ua", repeat=k)]
        return [(a + b, p + q, c + d) for a, p, c in ins for b, q, d in one(i)]

    return min((c, a) for a, word, c in gap(0) if WELL_FORMED.fullmatch(word))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "", "truncated", "blank", "duplicate"])), max_size=4))
def test_least_cost_and_audit(rows):
    heads = rr.inserted({rr.START: (0, "")})
    for initial, f in rows:
        heads = rr.read_row(heads, initial, f in ("blank", "duplicate"), int(f == "truncated"))
    assert rr.best(heads) == _all_edits([i for i, _ in rows], [f for _, f in rows])


def test_table(spark):
    conversations = spark.read.parquet(f"{SF_CHECK}/conversations.parquet")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert found(rr.repaired(rr.damaged(conversations))) == brute(rows)


def _awkward():
    rows = [(1, None, "user", "no turn."), (1, 3, None, "no role."), (1, 4, "assistant", None), (None, 1, "user", "no id."), (None, 2, "assistant", "yes"),
            (2, None, "user", "a."), (2, None, "user", "a."), (3, 5, "", "empty role."), (3, 6, "tool", "x?"), (3, 7, "assistant", " \n\t"),
            (4, 1, "user", "é 😀!"), (4, 1, "assistant", "tie."), (4, 1, "user", "another."), (5, None, None, None), (7, 2**60, "user", "far."), (7, -5, "system", "early")]
    rows += [(6, i, "user" if i % 2 else "assistant", f"row {i}." + "y" * 300) for i in range(50)]
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, rr.CHUNK_ROWS])
def test_awkward_rows(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(rr, "CHUNK_ROWS", chunk_rows)
    rows = _awkward()
    assert found(rr.repaired(rr.damaged(frame(spark, rows)))) == brute(rows)


def test_hot_conversation_of_many_chunks(spark):
    """One conversation holds most rows, many of them equal; it is cut into chunks and composed."""
    roles = ["user", "assistant", "user", "system", "assistant", "user", "user"]
    rows = [(1, i, roles[i % 7], "the same." if i % 3 == 0 else f"text {i}" + ("." if i % 5 else "")) for i in range(9000)]
    rows += [(c, t, roles[(c + t) % 7], f"{c} {t}.") for c in range(2, 300) for t in range(c % 6)]
    df = frame(spark, rows).repartition(5)
    parts = rr.chunks(rr.damaged(df))
    assert parts.where("conv_id = 1").count() > 5
    assert found(rr.repaired(rr.damaged(df))) == brute(rows)


def test_repaired_turns_are_the_digest_s_rows(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}.") for i in range(3000)] + [(2, 0, "system", "s."), (3, 1, "assistant", "a")]
    damaged = rr.damaged(frame(spark, rows))
    turns = defaultdict(list)
    for r in sorted(rr.repaired_turns(damaged).collect(), key=lambda r: r.place):
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for c, x in found(rr.repaired(damaged)).items():
        assert hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() == x[-1]


def test_empty_table(spark):
    assert rr.repaired(rr.damaged(frame(spark, []))).count() == 0
