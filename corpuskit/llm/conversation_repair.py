"""Repair of conversation structure at least cost, by rank-convergence parallel Viterbi.

Rows are sorted by range, so even one huge conversation is spread over many tasks.  A
conversation that lies inside a task is solved there.  The others become segments.  Each segment
runs the backward recursion from a speculative cost vector; fix-up passes hand every segment the
start vector of its successor and rerun it from the end only until the new vector differs
from the old one by a constant (vectors are kept with their smallest cost subtracted, so that
is equality).  With the stitched vectors one forward walk traces the least audit.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles.  Its states are: nothing
yet, after the system row, after a user row, after an assistant row.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuskit.session import freeze

SEGMENT_ROWS = 8192  # a longer run of one conversation is cut into segments
SEGMENT_CHARS = 2 << 20
OUTPUT_CHARS = 4 << 20

SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, SOUND = 0, 1, 2  # codes of rows; SOUND + 2 * class of the initial + truncated
CLASSES = {"s": 0, "u": 1, "a": 2}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
SPOKEN = (2, 2, 3, 2)  # state after the next user or assistant row
NAMES = ("user", "user", "assistant", "user")  # the role that row has
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # state after keeping a row, by class of its initial
ENDING = (0, 4, 2, 0)  # cost of the rows that are still owed at the end
OWED = ("", "II", "I", "")

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SUMMARY = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, sha256 string"
TURNS = "position long, edit string, turn long, role string, text string"


def code(role: str, text: str, seen: bool) -> int:
    """The first fault of a row, or what counts for its edits."""
    core = text.strip(SPACE)
    if not core:
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND + 2 * CLASSES.get(role[:1], 3) + (core[-1] not in ".!?")


class Steps:
    """One backward step: cost vectors relative to their smallest entry, and the least edits.

    There are few different vectors (entries differ by a few edits), so all steps are remembered.
    """

    def __init__(self):
        self.memo: dict = {}

    def __call__(self, row: int, after: tuple) -> tuple[tuple, tuple]:
        found = self.memo.get((row, after))
        if found is None:
            found = self.memo[row, after] = self._solve(row, after)
        return found

    def _solve(self, row: int, after: tuple) -> tuple[tuple, tuple]:
        own = []
        for state in range(4):
            options = [(DELETE + after[state], "D", state)]
            if row >= SOUND:
                extra = TRUNCATED * (row & 1)
                if state in KEPT[(row - SOUND) // 2]:
                    state_kept = KEPT[(row - SOUND) // 2][state]
                    options.append((extra + after[state_kept], "K", state_kept))
                options.append((REROLE + extra + after[SPOKEN[state]], "R", SPOKEN[state]))
            own.append(min(options))
        best = list(own)
        for state in (3, 2, 0, 1):  # an insertion leads to state 2 or 3, and never twice around
            cost, letters, end = own[SPOKEN[state]] if state > 1 else best[SPOKEN[state]]
            best[state] = min(own[state], (INSERT + cost, "I" + letters, end))
        least = min(cost for cost, _, _ in best)
        return tuple(cost - least for cost, _, _ in best), tuple((letters, end) for _, letters, end in best)


def backward(steps: Steps, codes: bytes, end: tuple) -> tuple[tuple, list]:
    """Cost vector before the rows and the moves of each row, given the vector behind them."""
    moves = [()] * len(codes)
    for i in range(len(codes) - 1, -1, -1):
        end, moves[i] = steps(codes[i], end)
    return end, moves


def refit(steps: Steps, codes: bytes, old: tuple, new: tuple, start: tuple) -> tuple:
    """The start vector under a new end vector; ends as soon as old and new differ by a constant only."""
    for row in reversed(codes):
        if old == new:
            return start
        old, new = steps(row, old)[0], steps(row, new)[0]
    return new


class Walk:
    """The forward walk over one conversation, fed with its segments in order."""

    def __init__(self):
        self.state = self.position = self.pairs = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.initial = self.turn = self.first_turn = None
        self.distinct = 0

    def segment(self, turns, roles, texts, codes: bytes, moves: list) -> Iterator[tuple]:
        """Advance; gives the repaired rows."""
        counts = self.counts
        for turn, role, text, row, move in zip(turns, roles, texts, codes, moves):
            if turn is not None and turn != self.turn:
                self.distinct += 1
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.turn = turn
            initial = role[:1]
            counts["illegal"] += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            counts["blank"] += row == BLANK
            counts["duplicate"] += row == DUPLICATE
            cut = row >= SOUND and row & 1
            counts["truncated"] += cut
            letters, end = move[self.state]
            yield from self._edits(letters, end, turn, role, text, cut)

    def _edits(self, letters, end, turn=None, role=None, text=None, cut=0) -> Iterator[tuple]:
        self.audit.append(letters)
        for letter in letters:
            name = NAMES[self.state]
            if letter == "I":
                self.counts["cost"] += INSERT
                self.state = SPOKEN[self.state]
                yield self._row("I", None, name, "")
            elif letter == "D":
                self.counts["cost"] += DELETE
            else:
                self.counts["cost"] += (REROLE if letter == "R" else 0) + TRUNCATED * cut
                yield self._row(letter, turn, name if letter == "R" else role, text)
        self.state = end

    def _row(self, edit, turn, role, text) -> tuple:
        self.digest.update(f"{chr(10) if self.position else ''}{role}:{text}".encode())
        self.position += 1
        return self.position - 1, edit, turn, role, text

    def finish(self) -> Iterator[tuple]:
        yield from self._edits(OWED[self.state], 3 if self.state else 0)

    def summary(self) -> tuple:
        if self.distinct:
            self.counts["gaps"] = self.turn - self.first_turn + 1 - self.distinct
        return *self.counts.values(), "".join(self.audit), self.digest.hexdigest()


def solve(steps: Steps, turns, roles, texts) -> tuple[list, tuple]:
    """Repaired rows and summary of one whole conversation."""
    seen: set = set()
    codes = bytearray()
    for pair in zip(roles, texts):
        codes.append(code(*pair, pair in seen))
        seen.add(pair)
    walk = Walk()
    moves = backward(steps, codes, ENDING)[1]
    rows = [*walk.segment(turns, roles, texts, codes, moves), *walk.finish()]
    return rows, walk.summary()


class Output:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += chars + 64
        if self.size > OUTPUT_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.size = [], 0


def _fields(kind: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(ddl).fields])


def _settle(rows: DataFrame, turns_out: bool, result: str, segment_rows: int) -> DataFrame:
    """Results of conversations inside one task, and segments of all others."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = rows.schema["conv"].dataType
    ddl = f"part int, seg int, turns array<long>, roles array<string>, texts array<string>, done struct<{_colons(result)}>"
    schema = _fields(kind, ddl)
    arrow, fields = to_arrow_schema(schema), T.StructType.fromDDL(result).names

    def settle(batches):
        part, steps, out = TaskContext.get().partitionId(), Steps(), Output(arrow)
        seg = size = 0
        opened, current, edge = False, None, True  # edge: the conversation may have begun in an earlier task
        turns, roles, texts = [], [], []

        def emit(whole: bool):
            nonlocal seg, size, turns, roles, texts
            if whole:
                found, summary = solve(steps, turns, roles, texts)
                for row in found if turns_out else [summary]:
                    yield from out.add((current, None, None, None, None, None, dict(zip(fields, row))), size if not turns_out else len(row[-1]))
            else:
                yield from out.add((current, part, seg, turns, roles, texts, None), size)
                seg += 1
            size, turns, roles, texts = 0, [], [], []

        for batch in batches:
            for conv, turn, role, text, live in zip(*(c.to_pylist() for c in batch.columns)):
                if opened and conv != current:
                    yield from emit(whole=not edge)
                    edge = False
                opened, current = True, conv
                if live:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    size += len(text) + len(role)
                    if len(turns) >= segment_rows or size >= SEGMENT_CHARS:
                        yield from emit(whole=False)
                        edge = True  # what follows of it is a further segment
        if opened:
            yield from emit(whole=False)
        yield from out.flush()

    return rows.mapInArrow(settle, schema)


def _colons(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def _codes(segments: DataFrame) -> DataFrame:
    """Codes of the rows of every segment, and its start vector from a speculative end vector.

    A row is a duplicate if its role and text occur earlier in its segment or first occur in an earlier one.
    """
    row = F.concat(F.char_length("r.roles").cast("string"), F.lit(":"), F.col("r.roles"), F.col("r.texts"))
    rows = segments.select("conv", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r"))
    local = rows.groupBy("conv", F.sha2(row, 256).alias("digest"), "part", "seg").agg(F.min("pos").alias("pos"))
    earlier = F.row_number().over(W.partitionBy("conv", "digest").orderBy("part", "seg"))
    later = local.withColumn("n", earlier).where("n > 1").groupBy("part", "seg").agg(F.collect_list("pos").alias("seen"))
    joined = segments.join(later, ["part", "seg"], "left").select("conv", "part", "seg", "roles", "texts", "seen")
    schema = _fields(segments.schema["conv"].dataType, "part int, seg int, codes binary, end array<long>, start array<long>")

    def encode(batches):
        steps = Steps()
        for batch in batches:
            conv, part, seg, *rest = batch.columns
            codes, starts = [], []
            for roles, texts, before in zip(*(c.to_pylist() for c in rest)):
                seen, before, own = set(), set(before or ()), bytearray()
                for place, pair in enumerate(zip(roles, texts)):
                    own.append(code(*pair, pair in seen or place in before))
                    seen.add(pair)
                codes.append(bytes(own))
                starts.append(backward(steps, own, ENDING)[0])
            longs = pa.list_(pa.int64())
            ends = pa.array([ENDING] * len(codes), longs)
            columns = [conv, part, seg, pa.array(codes, pa.binary()), ends, pa.array(starts, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(encode, schema)


def _fix_up(codes: DataFrame) -> DataFrame:
    """One pass: every segment takes its successor's start vector; ``moved`` tells where the start changed."""
    order = W.partitionBy("conv").orderBy("part", "seg")
    narrow = codes.select("conv", "part", "seg", "start")
    ending = F.array(*[F.lit(c).cast("long") for c in ENDING])
    following = narrow.select("part", "seg", F.coalesce(F.lead("start").over(order), ending).alias("new"))
    joined = codes.select("conv", "part", "seg", "codes", "end", "start").join(following, ["part", "seg"])
    schema = codes.select("conv", "part", "seg", "codes", "end", "start").schema.add("moved", "boolean")

    def rerun(batches):
        steps = Steps()
        for batch in batches:
            conv, part, seg, rows, ends, starts, new = (batch.column(i) for i in range(7))
            found = [
                refit(steps, c, tuple(e), tuple(n), tuple(s))
                for c, e, n, s in zip(rows.to_pylist(), ends.to_pylist(), new.to_pylist(), starts.to_pylist())
            ]
            moved = [list(f) != s for f, s in zip(found, starts.to_pylist())]
            columns = [conv, part, seg, rows, new, pa.array(found, pa.list_(pa.int64())), pa.array(moved)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select("conv", "part", "seg", "codes", "end", "start", "new").mapInArrow(rerun, schema)


def _trace(segments: DataFrame, codes: DataFrame, turns_out: bool, result: str) -> DataFrame:
    """Stream the segments of each conversation in order through one walk; one segment is held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _fields(segments.schema["conv"].dataType, result)
    arrow = to_arrow_schema(schema)
    joined = segments.join(codes.select("part", "seg", "codes", "end"), ["part", "seg"])
    ordered = joined.repartition("conv").sortWithinPartitions("conv", "part", "seg")

    def trace(batches):
        steps, out, walk, current = Steps(), Output(arrow), None, None

        def close():
            rows = list(walk.finish())
            for row in rows if turns_out else [walk.summary()]:
                yield from out.add((current, *row), len(row[-2]))

        for batch in batches:
            for i in range(batch.num_rows):
                conv, turns, roles, texts, own, end = (c[i].as_py() for c in batch.columns)
                if walk is None or conv != current:
                    if walk is not None:
                        yield from close()
                    walk, current = Walk(), conv
                moves = backward(steps, own, tuple(end))[1]
                for row in walk.segment(turns, roles, texts, own, moves):
                    if turns_out:
                        yield from out.add((conv, *row), len(row[-1]))
        if walk is not None:
            yield from close()
        yield from out.flush()

    return ordered.select("conv", "turns", "roles", "texts", "codes", "end").mapInArrow(trace, schema)


def repair(
    rows: DataFrame,
    output: str = "conversations",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    live_col: str | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The cheapest edits that make every conversation read ``(s?(ua)+)?``, ties to the least audit.

    Rows of a conversation are taken by turn (nulls first), then role, then a hash of the text.  Blank rows and
    rows whose role and text occurred earlier must go (Delete costs 3); truncated rows, which do not end in
    ``.!?``, cost 1 unless deleted; Rerole and Insert cost 2, Keep nothing.  ``output="conversations"``
    gives one row each: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256`` (of the
    repaired ``role:text`` rows joined by newlines); ``"turns"`` gives the repaired rows:
    ``conv_id, position, edit, turn, role, text`` (an inserted row has no turn).

    A null role or text is one space; null ids form one conversation; repeated rows are duplicates of
    each other; an empty table gives no rows; other columns are ignored.  Rows where ``live_col`` is
    not true do not count, but their conversation is reported, if need be with zeros and
    an empty audit.  Every size of conversation is exact.  The hash over a conversation is sequential by
    definition: the segments of one that spans several tasks stream through one task, one at a time.
    """
    if output not in ("conversations", "turns"):
        raise ValueError(f"unknown output: {output}")
    turns_out, result = (True, TURNS) if output == "turns" else (False, SUMMARY)
    live = F.coalesce(F.col(live_col).cast("boolean"), F.lit(False)) if live_col else F.lit(True)
    clean = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
        live.alias("live"),
    ).withColumn("hash", F.xxhash64("text"))
    # equal rows are interchangeable: the salt only lets a range of them be split
    salted = clean.withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "hash", "salt"]
    placed = salted.repartitionByRange(*order).sortWithinPartitions(*order[:-1], "text", "salt")
    settled = freeze(_settle(placed.select("conv", "turn", "role", "text", "live"), turns_out, result, segment_rows))
    segments = settled.where("part IS NOT NULL").select("conv", "part", "seg", "turns", "roles", "texts")
    codes = freeze(_codes(segments))
    while True:
        codes = freeze(_fix_up(codes))
        if not codes.where("moved").limit(1).count():
            break
    inside = settled.where("part IS NULL").select("conv", "done.*")
    return inside.unionByName(_trace(segments, codes, turns_out, result)).withColumnRenamed("conv", conv_col)


def damage(rows: DataFrame) -> DataFrame:
    """Seeded damage to ``conv_id, turn, role, text`` by crc32 of ``conv_id:turn`` modulo 20; ``live`` is false on dropped rows.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user.
    Nulls count as one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("live"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")
