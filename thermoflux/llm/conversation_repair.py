"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

The turns of a conversation must read, by the first letters of their roles, ``(s?(ua)+)?``: perhaps a system turn, then
user and assistant in turn. Edits: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate turns),
Insert an empty user or assistant turn anywhere (5); a truncated turn that is not deleted adds 5. The audit is the string of
the edits' initials; of equally cheap repairs the one with the ASCII-least audit is taken.

Method: a path through the graph of (turns read, role state) has one integer weight. Its high digits are the cost; below stand
``width`` octal digits, one for each audit letter in order (D, I, K, R as 1 to 4), zero-padded at the end, so that comparing two integers
compares cost first and audits then. The least integer of every node decides everything. This is exact for paths of different lengths: of
two paths into one node neither audit is a proper prefix of the other at equal cost (what follows could only be inserts, which
cost), so their order never changes when both go on alike. Paths that are too far behind to win are left out (``SLACK``). Letters that all
nodes' best paths share are settled: their edits are emitted and their digits shifted out, so integers stay short and only
undecided turns are held.

Scale: the turns of a conversation are a sorted stream of one task (its digest is one sequential hash), read batch by batch and
never collected: a conversation of any length, or all rows without a conv_id, need the memory of their undecided turns only.
All else - damage, faults, duplicates - is DataFrame functions over the same one shuffle.

Cases: null roles and texts are one space (so such a text is blank); turns are ordered by turn (nulls first), then role and text; rows repeated
exactly are duplicates; a null conv_id is a conversation of its own; roles are kept by their first letter as it stands (an empty role
or another letter cannot be kept); a conversation whose rows were all dropped has zeros, an empty audit and the hash of nothing;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Edit costs, the letters' digits, and the states that the first letters of roles lead to.
DELETE, INSERT, REROLE, TRUNCATED_COST = 2, 5, 1, 5
LETTERS = " DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: State and role that an inserted or reroled turn has after each state.
TURN = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
ACCEPTING = (START, ASSISTANT)

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: From any state, what follows another state can be followed at this much more: two inserts, or one and the deletion of a
#: system turn. A path that is further behind the least one never wins.
SLACK = 2 * INSERT
BITS = 3
#: Audit letters that a path's integer has room for at first; doubled where more are undecided.
WIDTH = 96


class Repair:
    """The cheapest repair of a stream of turns; ``emit(edit, role, text)`` gets each settled edit in order (role None for a deleted turn)."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.emit = emit
        self.width = WIDTH
        self.paths: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: (integer, letters used)
        self.pending: deque[tuple[str, str]] = deque()
        self.state = START  # after the edits emitted so far

    def _step(self, value: int, used: int, letter: str, cost: int) -> tuple[int, int]:
        return value + (cost << BITS * self.width) + (LETTERS.index(letter) << BITS * (self.width - 1 - used)), used + 1

    def _with_inserts(self) -> dict[int, tuple[int, int]]:
        """Least paths after none, one or two inserts; a third would come back to a state at a higher cost."""
        best, layer = dict(self.paths), self.paths
        for _ in range(2):
            reached: dict[int, tuple[int, int]] = {}
            for state, (value, used) in layer.items():
                at, path = TURN[state][0], self._step(value, used, "I", INSERT)
                reached[at] = min(reached.get(at, path), path)
            for state, path in reached.items():
                best[state] = min(best.get(state, path), path)
            layer = reached
        return best

    def add(self, role: str, text: str, fault: int) -> None:
        if max(used for _, used in self.paths.values()) + 4 > self.width:
            self._settle()
            if 2 * max(used for _, used in self.paths.values()) > self.width:
                self.paths = {s: (v << BITS * self.width, used) for s, (v, used) in self.paths.items()}
                self.width *= 2
        self.pending.append((role, text))
        new: dict[int, tuple[int, int]] = {}

        def reach(state: int, path: tuple[int, int]) -> None:
            new[state] = min(new.get(state, path), path)

        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, (value, used) in self._with_inserts().items():
            reach(state, self._step(value, used, "D", DELETE))
            if fault in (NONE, TRUNCATED):
                kept = NEXT[state].get(role[:1])
                if kept is not None:
                    reach(kept, self._step(value, used, "K", more))
                reach(TURN[state][0], self._step(value, used, "R", REROLE + more))
        limit = (min(new.values())[0] >> BITS * self.width) + SLACK + 1 << BITS * self.width
        self.paths = {s: path for s, path in new.items() if path[0] < limit}

    def finish(self) -> int:
        """Settle what is left; returns the cost."""
        ends = self._with_inserts()
        best = min(ends[s] for s in ACCEPTING if s in ends)
        self.paths = {START: best}
        self._settle()
        return best[0] >> BITS * self.width

    def _settle(self) -> None:
        """Emit the letters that all paths share and shift their digits out."""
        total, mask = BITS * self.width, (1 << BITS * self.width) - 1
        paths = list(self.paths.values())
        low, differ = paths[0][0] & mask, 0
        for value, _ in paths[1:]:
            differ |= low ^ (value & mask)
        n = min(self.width + -differ.bit_length() // BITS, min(used for _, used in paths))
        for k in range(n):
            self._apply(LETTERS[(low >> total - BITS * (k + 1)) & 7])
        shift = BITS * n
        self.paths = {s: ((v >> total << total) | ((v & mask) << shift & mask), used - n) for s, (v, used) in self.paths.items()}

    def _apply(self, letter: str) -> None:
        turn = (None, "") if letter == "I" else self.pending.popleft()
        if letter == "D":
            self.emit("D", None, turn[1])
            return
        if letter == "K":
            self.state = NEXT[self.state][turn[0][:1]]
            self.emit("K", *turn)
            return
        self.state, role = TURN[self.state]
        self.emit(letter, role, turn[1])


# ---------------------------------------------------------------------------------- as Spark jobs


def _sorted_turns(turns: DataFrame, conv_col: str, dropped: Column | None) -> DataFrame:
    """(conv_id, turn, role, text, fault, dropped), a conversation's rows together and in order."""
    gone = F.lit(False) if dropped is None else dropped
    d = turns.select(F.col(conv_col).alias("conv_id"), "turn", gone.alias("dropped"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # a dropped row stays as a sign that its conversation is there
    d = d.withColumns({c: F.when(~F.col("dropped"), F.col(c)) for c in ("role", "text")})
    d = d.repartition("conv_id").withColumn("_h", F.xxhash64("role", "text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "_h", "role", "text").orderBy("turn")) > 1
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = (
        F.when(F.length(body) == 0, BLANK)
        .when(seen, DUPLICATE)
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    d = d.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "fault", "dropped")
    return d.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], open_, close) -> Iterator[list]:
    """Feed a partition's sorted rows: ``open_(conv_id)`` returns a function for each row, ``close()`` ends a conversation; yields lists of rows."""
    current, take = object(), None
    for b in batches:
        rows: list = []
        for conv, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if take is None or conv != current:
                if take is not None:
                    rows += close()
                current, take = conv, open_(conv)
            rows += take(*row) or ()
        yield rows
    if take is not None:
        yield close()


class _Summary:
    """Counts, audit and digest of one conversation after another."""

    def open(self, conv) -> Callable:
        self.conv, self.audit, self.hash, self.first = conv, [], hashlib.sha256(), True
        self.counts, self.illegal, self.before = [0] * 4, 0, None
        self.low = self.high = self.last = None
        self.distinct = 0
        self.repair = Repair(self.edit)
        return self.row

    def edit(self, letter: str, role: str | None, text: str | None) -> None:
        self.audit.append(letter)
        if role is not None:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def row(self, turn, role, text, fault, dropped) -> None:
        if dropped:
            return
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += turn != self.last
            self.last = turn
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.repair.add(role, text, fault)

    def close(self) -> list:
        cost = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [(self.conv, gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())]


class _Turns:
    """The repaired turns themselves, each as soon as it is settled."""

    def open(self, conv) -> Callable:
        self.conv, self.at, self.out = conv, 0, []
        self.repair = Repair(self.edit)
        return self.row

    def edit(self, letter: str, role: str | None, text: str | None) -> None:
        if role is not None:
            self.out.append((self.conv, self.at, letter, role, text))
            self.at += 1

    def row(self, turn, role, text, fault, dropped) -> list:
        if not dropped:
            self.repair.add(role, text, fault)
        return self._settled()

    def _settled(self) -> list:
        out, self.out = self.out, []
        return out

    def close(self) -> list:
        self.repair.finish()
        return self._settled()


def _run(turns: DataFrame, conv_col: str, dropped: Column | None, kind: type, columns: str) -> DataFrame:
    d = _sorted_turns(turns, conv_col, dropped)
    schema = T.StructType([d.schema["conv_id"], *T.StructType.fromDDL(columns).fields])
    names = schema.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, state = to_arrow_schema(schema), kind()
        for rows in _conversations(batches, state.open, state.close):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=arrow)

    return d.mapInArrow(work, schema)


def summary(turns: DataFrame, conv_col: str = "conv_id", dropped: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256 of the lines ``role:text``.

    ``dropped`` marks rows that are gone, but whose conversation is reported all the same."""
    columns = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _run(turns, conv_col, dropped, _Summary, columns)


def repaired(turns: DataFrame, conv_col: str = "conv_id", dropped: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position long, edit (K, R or I), role, text; deleted turns are left out."""
    return _run(turns, conv_col, dropped, _Turns, "position long, edit string, role string, text string")


def damaged(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows as a lossy transfer leaves them, by the checksum of ``conv_id:turn`` modulo 20: 0 dropped (column ``dropped``),
    1 without text, 2 without end marks, 3 twice, 4 with the role user. Nulls are one space."""
    space = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in (conv_col, "turn")]
    h = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    d = turns.select(F.col(conv_col).alias("conv_id"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), h.alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumns({"text": text, "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))})
    return d.select("conv_id", "turn", "role", "text", (F.col("_k") == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")
