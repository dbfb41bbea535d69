"""Repair of the role structure of conversations by iterative-deepening A*.

A repaired conversation reads ``(s?(ua)+)?``: perhaps a system row, then user and assistant in turn,
or nothing. Edits, by the ASCII order of their initials: Delete a row (4, required where it is blank
or a duplicate), Insert an empty row (3), Keep it (0), Rerole it to user or assistant (3); a row that
is truncated and stays costs 3 more. The cheapest edits win, of those the least string of initials.

**Search.** From a row and the last role that is left, only one role can be inserted or given, so a
path is its string of initials. Depth-first search tries the edits in ASCII order under a bound on
the cost; a bound that fails is raised to the least estimate that went beyond it, so the first path
to the end is the cheapest, and the least of these. The estimate is what single rows force, plus the
edits that neighbours with no legal order force between them. A failed (row, role) leaves in the
transposition table what its rest must cost at least; it is searched again only with more to spend.

**Scale.** Equal rows of a turn are counted before any shuffle. Rows are ordered by ranges of
(conversation, turn, role, text), so a long conversation is cut over many tasks. A conversation
within one task and ``SEGMENT`` rows is searched whole. Of longer ones each segment is searched
from every last role to every other; the segments then pass, in order and one at a time, a task that
holds four candidates: cost, initials and running hash. SHA-256 can only be computed in order, so
this last pass takes the rows of a conversation one after another, but never holds them.

Rows of a conversation are ordered by turn (nulls first), then role and text. A null conversation is
one like others. An empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import stored

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: Rows searched at a time, and bytes of their texts.
SEGMENT = 512
_SEGMENT_BYTES = 8 << 20

#: The last role that is left: none yet, system, user, assistant. What comes next if it is inserted
#: or given, and which initials may be kept.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = frozenset(("su", "ua", "au"))

#: Faults by number; the first that holds counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Row = tuple[str, int]


def _estimates(rows: list[Row]) -> list[int]:
    """Per position, what the rows from there on cost at least.

    A row to be deleted forces 4, a truncated one 3. Two neighbours among the others, in an order
    that is not legal, need a further edit on one of them or between them: 3, or what deleting a
    truncated one adds. Disjoint pairs add up.
    """
    n = len(rows)
    out = [0] * (n + 1)
    after = n  # the next row that may stay
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        if fault in (BLANK, DUPLICATE):
            out[i] = out[i + 1] + DELETE
            continue
        own = TRUNCATED if fault == CUT else 0
        best = out[i + 1] + own
        if after < n and initial + rows[after][0] not in _LEGAL:
            cut = (fault == CUT) + (rows[after][1] == CUT)
            more = INSERT if cut == 0 else DELETE - TRUNCATED
            forced = own + (TRUNCATED if rows[after][1] == CUT else 0) + more
            between = DELETE * (after - i - 1)
            best = max(best, forced + between + out[after + 1])
        out[i] = best
        after = i
    return out


class Search:
    """Cheapest edits of ``rows`` (initial, fault) that end in one of the roles of ``ends``."""

    def __init__(self, rows: list[Row], ends: tuple[int, ...]):
        self.rows, self.ends = rows, ends
        self.estimates = _estimates(rows)
        self.least: dict[int, int] = {}  # the transposition table, by 4 * row + role

    def _moves(self, at: int, role: int, left: int) -> list[tuple[int, int, int, str]]:
        """The edits that ``left`` pays for, in ASCII order: next row, role, what is left, initial."""
        moves = []
        if at < len(self.rows):
            initial, fault = self.rows[at]
            moves.append((at + 1, role, left - DELETE, "D"))
            moves.append((at, _NEXT[role], left - INSERT, "I"))
            if fault not in (BLANK, DUPLICATE):
                own = TRUNCATED if fault == CUT else 0
                kept = _KEPT[role].get(initial)
                if kept is not None:
                    moves.append((at + 1, kept, left - own, "K"))
                moves.append((at + 1, _NEXT[role], left - own - REROLE, "R"))
        else:
            moves.append((at, _NEXT[role], left - INSERT, "I"))
        return moves

    def _bound(self, at: int, role: int) -> int:
        return max(self.estimates[at], self.least.get(4 * at + role, 0))

    def _within(self, role: int, bound: int) -> str | None:
        """The first path within the bound, or None; then the table tells what is needed."""
        n, least = len(self.rows), self.least
        # a frame: row, role, what is left, its moves, the next of them, the least need beyond
        frames = [[0, role, bound, None, 0, 1 << 60]]
        path: list[str] = []
        while frames:
            frame = frames[-1]
            at, role, left, moves, k, need = frame
            if moves is None:
                if at == n and role in self.ends:
                    return "".join(path)
                moves = frame[3] = self._moves(at, role, left)
            if k < len(moves):
                frame[4] += 1
                to, to_role, rest, initial = moves[k]
                below = self._bound(to, to_role)
                if below > rest:
                    frame[5] = min(need, left - rest + below)
                else:
                    path.append(initial)
                    frames.append([to, to_role, rest, None, 0, 1 << 60])
                continue
            key = 4 * at + role
            least[key] = max(need, least.get(key, 0))
            frames.pop()
            if frames:
                path.pop()
                above = frames[-1]
                above[5] = min(above[5], above[2] - left + least[key])
        return None

    def _reachable(self, role: int) -> bool:
        if USER in self.ends or ASSISTANT in self.ends or role in self.ends:
            return True
        return role == NONE and SYSTEM in self.ends and any(
            i == "s" and f not in (BLANK, DUPLICATE) for i, f in self.rows
        )

    def best(self, role: int = NONE) -> tuple[int, str] | None:
        """Cost and initials of the cheapest edits after ``role``, the least of them."""
        if not self._reachable(role):
            return None
        bound = self._bound(0, role)
        while (path := self._within(role, bound)) is None:
            bound = self._bound(0, role)
        return bound, path


def repaired_rows(
    rows: list[tuple[str, str]], audit: str, role: int = NONE
) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits, starting after ``role``."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
        elif edit == "I":
            role = _NEXT[role]
            yield _ROLE[role], ""
        elif edit == "R":
            role = _NEXT[role]
            yield _ROLE[role], rows[at][1]
            at += 1
        else:
            role = _KEPT[role][rows[at][0][:1]]
            yield rows[at]
            at += 1


class _Digest:
    """Running SHA-256 of the repaired rows, joined by newlines."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def copy(self) -> _Digest:
        new = _Digest()
        new.hash, new.any = self.hash.copy(), self.any
        return new

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            if self.any:
                self.hash.update(b"\n")
            self.any = True
            self.hash.update(f"{role}:{text}".encode())


class _Sums:
    """What is counted along a conversation."""

    def __init__(self):
        self.turns = [None, None, 0]  # first, last and number of the turns that are not null
        self.faults = [0] * 4
        self.illegal, self.first, self.last = 0, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            if self.turns[1] != turn:
                self.turns[2] += 1
            if self.turns[0] is None:
                self.turns[0] = turn
            self.turns[1] = turn
        self.faults[fault] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial

    def join(self, other: _Sums) -> None:
        if other.last is None:
            return
        if other.turns[0] is not None:
            again = self.turns[1] == other.turns[0]
            first = other.turns[0] if self.turns[0] is None else self.turns[0]
            self.turns = [first, other.turns[1], self.turns[2] + other.turns[2] - again]
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        self.illegal += other.illegal
        if self.last is None:
            self.first = other.first
        elif self.last + other.first not in _LEGAL:
            self.illegal += 1
        self.last = other.last

    def counts(self) -> tuple[int, int, int, int, int]:
        first, last, number = self.turns
        gaps = 0 if first is None else last - first + 1 - number
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal


_BLANKS = "\x20\x09-\x0d"
_SOME = re.compile(f"[^{_BLANKS}]")
_ENDS = "\x20\t\n\x0b\x0c\r"

_RESULT = pa.schema(
    [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_RESULT_DDL = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
#: A segment that is not a whole conversation: its rows, as they are after the damage.
_ROWS = pa.list_(
    pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
               ("fault", pa.int32())])
)
_BEST = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENTS = pa.schema(
    [("part", pa.int64()), ("nth", pa.int64()), ("rows", _ROWS), ("best", _BEST)] + list(_RESULT)
)
_SEGMENTS_DDL = (
    "part long, nth long, "
    "rows array<struct<turn: bigint, role: string, text: string, fault: int>>, "
    "best array<struct<cost: bigint, audit: string>>, " + _RESULT_DDL
)


def _fault(text: str, first: bool) -> int:
    if not _SOME.search(text):
        return BLANK
    if not first:
        return DUPLICATE
    return SOUND if text.rstrip(_ENDS)[-1] in ".!?" else CUT


def _whole(rows: list[tuple]) -> tuple:
    """The result for a whole conversation of few rows (turn, role, text, fault)."""
    sums = _Sums()
    for turn, role, _, fault in rows:
        sums.add(turn, role[:1], fault)
    cost, audit = Search([(r[:1], f) for _, r, _, f in rows], (NONE, ASSISTANT)).best()
    digest = _Digest()
    digest.add(repaired_rows([(r, x) for _, r, x, _ in rows], audit))
    return *sums.counts(), cost, audit, digest.hash.hexdigest()


def _between(rows: list[tuple]) -> list[dict]:
    """The best edits from every last role (4 each) to every other, by 4 * from + to."""
    searches = [Search([(r[:1], f) for _, r, _, f in rows], (end,)) for end in range(4)]
    found = [searches[end].best(role) for role in range(4) for end in range(4)]
    return [{"cost": x[0], "audit": x[1]} if x else {"cost": None, "audit": None} for x in found]


def _segments(length: int, most_bytes: int):
    """From ordered rows (part, conv, turn, role, text, first, copies): whole results of the
    conversations that lie inside, segments of those that may go on in other tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, conv, part = None, None, 0
        rows: list[tuple] = []
        size = nth = 0
        begun = opened = False  # a row was seen; the conversation began in this task
        parts, results = [], []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal parts, results
            if parts:
                arrays = [pa.array([p[0] for p in parts], name.type)]
                for i, f in enumerate(_SEGMENTS):
                    arrays.append(pa.array([p[i + 1] for p in parts], f.type))
                yield pa.record_batch(arrays, names=["conv", *_SEGMENTS.names])
                parts = []

        def close(last: bool) -> None:
            """Ends a conversation, which may go on elsewhere if it is the first or last."""
            nonlocal rows, size, nth
            if opened and not last and nth == 0:
                parts.append((conv, None, None, None, None, *_whole(rows)))
            else:
                segment()
            rows, size, nth = [], 0, 0

        def segment() -> None:
            nonlocal rows, size, nth
            kept = [dict(zip(("turn", "role", "text", "fault"), r, strict=True)) for r in rows]
            parts.append((conv, part, nth, kept, _between(rows), *[None] * len(_RESULT)))
            rows, size, nth = [], 0, nth + 1

        for batch in batches:
            name = batch.schema.field("conv")
            columns = [batch.column(c).to_pylist()
                       for c in ("part", "conv", "turn", "role", "text", "first", "copies")]
            for part_, conv_, turn, role, text, first, copies in zip(*columns, strict=True):
                part = part_
                if not begun:
                    begun, conv = True, conv_
                elif conv_ != conv:
                    close(last=False)
                    opened, conv = True, conv_
                for k in range(copies):
                    rows.append((turn, role, text, _fault(text, first and k == 0)))
                    size += len(text)
                    if len(rows) >= length or size >= most_bytes:
                        segment()
            if len(parts) >= 200 or sum(len(p[3] or ()) for p in parts) >= length:
                yield from emit()
        if begun:
            close(last=True)
            yield from emit()

    return cut


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their segments, which come in order."""
    conv, begun, name = None, False, None
    out: list[tuple] = []

    def start():
        return _Sums(), [(0, "", _Digest()), None, None, None]

    def result(sums: _Sums, states: list) -> tuple:
        cost, audit, digest = min((s for s in (states[NONE], states[ASSISTANT]) if s),
                                  key=lambda s: s[:2])
        return conv, *sums.counts(), cost, audit, digest.hash.hexdigest()

    def emit() -> pa.RecordBatch:
        arrays = [pa.array([r[0] for r in out], name.type)]
        arrays += [pa.array([r[i + 1] for r in out], f.type) for i, f in enumerate(_RESULT)]
        return pa.record_batch(arrays, names=["conv", *_RESULT.names])

    sums, states = start()
    for batch in batches:
        name = batch.schema.field("conv")
        for i in range(batch.num_rows):
            conv_ = batch.column("conv")[i].as_py()
            if begun and conv_ != conv:
                out.append(result(sums, states))
                sums, states = start()
            begun, conv = True, conv_
            rows, best = batch.column("rows")[i].as_py(), batch.column("best")[i].as_py()
            here = _Sums()
            for r in rows:
                here.add(r["turn"], r["role"][:1], r["fault"])
            sums.join(here)
            pairs = [(r["role"], r["text"]) for r in rows]
            states = [_onward(states, best, end, pairs) for end in range(4)]
        if len(out) >= 1000:
            yield emit()
            out = []
    if begun:
        out.append(result(sums, states))
        yield emit()


def _onward(states: list, best: list[dict], end: int, rows: list[tuple[str, str]]):
    """The best candidate that ends a further segment in role ``end``."""
    options = []
    for role, state in enumerate(states):
        step = best[4 * role + end]
        if state is not None and step["cost"] is not None:
            options.append((state[0] + step["cost"], state[1] + step["audit"], role, step["audit"]))
    if not options:
        return None
    cost, audit, role, step = min(options)
    digest = states[role][2].copy()
    digest.add(repaired_rows(rows, step, role))
    return cost, audit, digest


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text) with ``copies`` of each after the damage: none, one or two.

    ``crc32('conv:turn') % 20`` decides: 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 makes it the user's. Null values are one blank there.
    """
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    drawn = rows.withColumn(
        "draw", F.crc32(F.concat(plain("conv"), F.lit(":"), plain("turn"))) % 20
    )
    text = (
        F.when(F.col("draw").isin(0, 1), F.lit(""))
        .when(F.col("draw") == 2, F.regexp_replace(plain("text"), "[.!?]", ""))
        .otherwise(plain("text"))
    )
    return drawn.select(
        "conv",
        "turn",
        F.when(F.col("draw") == 4, F.lit("user")).otherwise(plain("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per ``conv``: counts of gaps and faults, the cheapest edits and the repaired hash.

    ``rows``: conv, turn, role, text (not null but for conv and turn) and copies (0 for a row that
    only names its conversation).
    """
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # the first of equal rows is found by their digest, in keys that no conversation shares
    there = rows.filter("copies > 0")
    digest = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    firsts = there.select("conv", digest.alias("d"), F.struct(F.col("turn").alias("t")).alias("s"))
    firsts = firsts.groupBy("conv", "d").agg(F.min("s").alias("s")).select(
        F.col("conv").alias("c"), "d", F.col("s.t").alias("t"), F.lit(True).alias("first")
    )
    told = equal.withColumn("digest", digest)
    same = (
        told["conv"].eqNullSafe(firsts["c"])
        & (told["digest"] == firsts["d"])
        & told["turn"].eqNullSafe(firsts["t"])
    )
    order = ["conv", "turn", "role", "text"]
    ordered = (
        told.join(firsts, same, "left")
        .select(*order, F.coalesce("first", F.lit(False)).alias("first"), "copies")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().cast("long").alias("part"), *order, "first", "copies")
    )
    conv = rows.schema["conv"].dataType.simpleString()
    parts = stored(
        ordered.mapInArrow(_segments(segment, _SEGMENT_BYTES), f"conv {conv}, {_SEGMENTS_DDL}"),
        "segments",
    )
    joined = (
        parts.filter("part is not null")
        .select("conv", "part", "nth", "rows", "best")
        .repartition("conv")
        .sortWithinPartitions("conv", "part", "nth")
        .mapInArrow(_joined, f"conv {conv}, {_RESULT_DDL}")
    )
    return parts.filter("part is null").select("conv", *_RESULT.names).unionByName(joined)


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The conversations of (conv_id, turn, role, text), damaged, then repaired.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return repair(damaged(rows), segment).withColumnRenamed("conv", "conv_id")
