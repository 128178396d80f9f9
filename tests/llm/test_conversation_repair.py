"""Conversation repair against all edit sequences, and across any cut into segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpuskit.llm.conversation_repair import ENDING, Steps, backward, damage, refit, repair, solve
from corpuskit.llm.queries import QUERIES

ROLES = ["user", "assistant", "system", "tool", "", " "]
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        found.append("b" if not core else "d" if (role, text) in seen else "" if core[-1] in ".!?" else "t")
        seen.add((role, text))
    return found


def every_edit(rows, letters=3):
    """(cost, audit, repaired) of the best of all edit sequences with at most two insertions in a gap."""
    found = faults(rows)
    inserts = [[*p] for n in range(letters) for p in itertools.product(["user", "assistant"], repeat=n)]

    def options(i):
        role, text = rows[i]
        extra = found[i] == "t"
        yield 3, "D", []
        if found[i] in ("", "t"):
            yield extra, "K", [(role, text)]
            for name in ("user", "assistant"):
                yield 2 + extra, "R", [(name, text)]

    def extend(i, prefix):
        for added in inserts:
            cost, audit, out = prefix
            now = (cost + 2 * len(added), audit + "I" * len(added), out + [(n, "") for n in added])
            if not re.match(r"(s?(ua)*u?)?$", "".join(r[:1] or "-" for r, _ in now[2])):
                continue
            if i == len(rows):
                yield now
                continue
            for more, letter, row in options(i):
                after = (now[0] + more, now[1] + letter, now[2] + row)
                if re.match(r"(s?(ua)*u?)?$", "".join(r[:1] or "-" for r, _ in after[2])):
                    yield from extend(i + 1, after)

    legal = (e for e in extend(0, (0, "", [])) if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in e[2])))
    return min(legal, key=lambda e: e[:2])


def random_rows(rng, n):
    texts = ["Yes.", "No!", "cut off", " ", "", "Why? \n", "a\x1c", "."]
    return [(rng.choice(ROLES[: rng.choice([3, 6])]), rng.choice(texts) + rng.choice(["", "x."])) for _ in range(n)]


def test_least_audit_of_all_edits():
    rng = random.Random(11)
    for _ in range(250):
        rows = random_rows(rng, rng.randrange(5))
        turns = sorted(rng.randrange(6) for _ in rows)
        repaired, summary = solve(Steps(), turns, [r for r, _ in rows], [t for _, t in rows])
        cost, audit, out = every_edit(rows)
        assert (summary[5], summary[6]) == (cost, audit), rows
        assert [(r[3], r[4]) for r in repaired] == out
        assert summary[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found = faults(rows)
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(rows)]
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        assert summary[:5] == (gaps, *(found.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs))


def test_vectors_converge_and_a_rerun_stops_there():
    rng, steps = random.Random(2), Steps()
    calls = []

    def counted(row, after):
        calls.append(row)
        return steps(row, after)

    for _ in range(200):
        codes = bytes(rng.randrange(10) for _ in range(200))
        speculative = backward(steps, codes, ENDING)[0]
        other = tuple(rng.randrange(6) for _ in range(4))
        other = tuple(c - min(other) for c in other)
        calls.clear()
        assert refit(counted, codes, ENDING, other, speculative) == backward(steps, codes, other)[0]
        assert len(calls) < 200  # two steps a row until the vectors are equal
    assert len(steps.memo) < 2000


def plain(rows):
    """Expected summaries of (conv, turn, role, text, live) rows, one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv and r[4]]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        out[conv] = solve(Steps(), *([list(c) for c in zip(*own)] or [[], [], []]))
    return out


@pytest.mark.parametrize("segment_rows", [1, 3, 8192])
def test_any_cut_gives_the_same(spark, segment_rows):
    """One conversation with a third of all rows, many small ones, dropped rows, nulls."""
    rng = random.Random(segment_rows)
    rows = []
    for conv in range(60):
        size = 120 if conv == 7 else rng.randrange(1, 6)
        rows += [(conv, t, *r, rng.random() > 0.1 and conv != 9) for t, r in enumerate(random_rows(rng, size))]
    rows += [(None, 0, "user", "Hi.", True), (None, 1, None, "Hello.", True), (99, 1, "user", None, True), (98, 0, None, None, False)]
    rows += [(97, None, "user", "Hi.", True), (97, 4, "assistant", "Hello.", True), (97, 6, "user", "x" * 200_000, True)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{SCHEMA}, live boolean, audit string, seg int")
    df = df.repartition(5)
    found = repair(df, live_col="live", segment_rows=segment_rows)
    expected = plain(rows)
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == {c: s for c, (_, s) in expected.items()}
    assert found.count() == len(expected)
    turns = {}
    for r in repair(df, output="turns", live_col="live", segment_rows=segment_rows).collect():
        turns.setdefault(r.conv_id, []).append(tuple(r)[1:])
    assert {c: sorted(t) for c, t in turns.items()} == {c: t for c, (t, _) in expected.items() if t}


def test_equal_rows_and_empty_table(spark):
    """A conversation of equal rows can be split anywhere: all but one are duplicates."""
    df = spark.createDataFrame([(1, 5, "user", "Hi.")] * 50, SCHEMA)
    row = repair(df.repartition(4), segment_rows=7).first()
    assert (row.duplicate, row.illegal, row.cost, row.gaps) == (49, 49, 3 * 49 + 2, 0)
    empty = repair(df.limit(0))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"
    with pytest.raises(ValueError):
        repair(df, output="rows")


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t in (0, 1, None) for r, x in (("assistant", "One. Two!"), (None, None))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(str, damage(df).collect()))
    expected = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        text = "" if kind < 2 else x.translate({ord(k): None for k in ".!?"}) if kind == 2 else x
        expected += [(c, t, "user" if kind == 4 else r, text, kind != 0)] * (2 if kind == 3 else 1)
    names = ("conv_id", "turn", "role", "text", "live")
    assert found == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, e))})" for e in expected)


def test_query_reports_every_conversation(spark, small):
    found = QUERIES["op12_conversation_repair"](spark, small).collect()
    convs = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
    assert len(found) == convs and all(set(r.audit) <= set("DIKR") for r in found)
