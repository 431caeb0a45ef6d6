"""Conversation structure repair: the cheapest edits that give a conversation
the turns ``(system? (user assistant)+)?``.

The repair grammar is in Chomsky normal form: its symbols are pairs of states
(what the conversation has reached before a span and after it), a pair derives
two that meet in a state, or one row by one edit.  A cell holds, for a span of
rows and each pair of states, the least (cost, audit).  Two audits of one cost
and one pair of states are never prefixes of each other (the longer one would
have inserted more), so the least of the parts makes the least of the whole.
Insertions take no row; their closure is joined to the cells of single rows.

Cells are combined bottom-up by span length: every split of spans up to
``SPAN`` rows, then neighbouring spans of equal length.  Rows are dealt by
ranges of their order, so the spans of one long conversation lie in many tasks;
the cells of what a task holds of a conversation meet once for each conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import Scratch, partitions

#: Rows of the spans whose every split is tried.
SPAN = 8
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"

#: States: nothing yet, a system row, a user row, an assistant row.  Which role leads where:
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The states in which a conversation may end.
ENDS = (0, 3)
Cell = dict[tuple[int, int], tuple[int, str]]


def join_cells(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans from one split."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(r if r < 3 else 2, 4):  # no state leads back, but assistant to user
            other = right.get((r, q))
            if other is not None:
                best = out.get((p, q))
                total = cost + other[0]
                if best is None or total < best[0] or (total == best[0] and audit + other[1] < best[1]):
                    out[p, q] = (total, audit + other[1])
    return out


def _closure() -> Cell:
    out: Cell = {(p, p): (0, "") for p in range(4)}
    step: Cell = {(p, q): (INSERT, "I") for r in "ua" for p, q in MOVES[r].items()}
    for _ in range(2):
        out = merged(out, join_cells(out, step))
    return out


def merged(a: Cell, b: Cell) -> Cell:
    return {k: min(x for x in (a.get(k), b.get(k)) if x is not None) for k in a.keys() | b.keys()}


#: What insertions alone can do.
INSERTED = _closure()
#: What decides a row's cell: its role's initial ('' for other roles), and whether it is truncated; None if it can only be deleted.
Kind = tuple[str, bool] | None


def kind_of(initial: str, dead: bool, truncated: bool) -> Kind:
    return None if dead else (initial if initial in MOVES else "", truncated)


@cache
def row_cell(kind: Kind) -> Cell:
    """The cell of one row: kept, relabelled or deleted, with insertions around it."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind is not None:
        initial, truncated = kind
        more = TRUNCATED if truncated else 0
        for role in "ua":
            cell = merged(cell, {k: (RELABEL + more, "R") for k in MOVES[role].items()})
        cell = merged(cell, {k: (more, "K") for k in MOVES.get(initial, {}).items()})
    return join_cells(join_cells(INSERTED, cell), INSERTED)


@lru_cache(1 << 16)
def parse(rows: tuple[Kind, ...]) -> Cell:
    """The cell of a short span, every split tried, by length.  Spans of the same
    kinds of rows have the same cell, so a task parses each pattern once."""
    n = len(rows)
    spans = {(i, i + 1): row_cell(k) for i, k in enumerate(rows)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            j, cell = i + length, {}
            for k in range(i + 1, j):
                cell = merged(cell, join_cells(spans[i, k], spans[k, j])) if cell else join_cells(spans[i, k], spans[k, j])
            spans[i, j] = cell
    return spans[0, n]


class Spans:
    """Cells of a growing row of rows.  Finished spans of equal length combine at
    once, so few cells are held and an audit is copied a logarithm of times."""

    def __init__(self):
        self.done: list[tuple[int, Cell]] = []
        self.open: list[Kind] = []

    def add(self, kind: Kind) -> None:
        self.open.append(kind)
        if len(self.open) == SPAN:
            self.close()

    def close(self) -> None:
        if self.open:
            self.push(len(self.open), parse(tuple(self.open)))
            self.open = []

    def push(self, size: int, cell: Cell) -> None:
        while self.done and self.done[-1][0] <= size:
            n, before = self.done.pop()
            size, cell = size + n, join_cells(before, cell)
        self.done.append((size, cell))

    def cell(self) -> Cell:
        self.close()
        out: Cell = {(p, p): (0, "") for p in range(4)}
        for _, cell in reversed(self.done):
            out = join_cells(cell, out)
        return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its
    text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user.  Nulls
    count as one space.  A dropped row stays, marked, so that no conversation is lost."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


ORDER = ("conv_id", "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with what is wrong with each by itself, and ``again``: 2 where role and
    text stand at an earlier turn, 1 where they stand at this turn more than once.

    First places are counted by digest with partial sums, so a line that a third
    of all rows repeat is no large group; only digests that occur twice are joined."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    digest = F.sha2("text", 256)
    live = rows.where("not dropped")
    first = live.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d")) & ~F.col("dropped")
    again = F.when(F.col("first").isNull(), 0).when(place > F.col("first"), 2).otherwise(1)
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "dropped", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"), again.alias("again"))


FOUND = "blank long, duplicate long, truncated long, illegal long, gaps long"
PIECE = "conv_id long, part int, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, pairs array<int>, costs array<long>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


class _Piece:
    """What one task holds of one conversation."""

    def __init__(self, conv):
        self.conv, self.spans = conv, Spans()
        self.first = self.last = self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, text, blank, truncated, again):
        this = (turn, role, text) if again == 1 else None
        dead = blank or again == 2 or (this is not None and this == self.before)
        self.before = this
        self.blank += blank
        self.duplicate += dead and not blank
        self.truncated += truncated and not dead
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.spans.add(kind_of(initial, dead, truncated))

    def row(self, part: int) -> tuple:
        cell = self.spans.cell()
        pairs = sorted(cell)
        return (self.conv, part, self.first, self.last, self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, [4 * p + q for p, q in pairs], [cell[k][0] for k in pairs], [cell[k][1] for k in pairs])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("conv_id", pa.int64()), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string())] + [(c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
    schema = pa.schema([*fields, ("pairs", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
    part, now, done = TaskContext.get().partitionId(), None, []

    def out():
        cols = list(zip(*done)) or [[]] * len(schema)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for b in batches:
        names = ("conv_id", "turn", "role", "dropped", "blank", "truncated", "again")
        cols, texts = [b.column(c).to_pylist() for c in names], b.column("text")
        for i, (conv, turn, role, dropped, blank, truncated, again) in enumerate(zip(*cols)):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row(part))
                now = _Piece(conv)
            if not dropped:
                now.add(turn, role, texts[i].as_py() if again == 1 else None, blank, truncated, again)
        yield out()
    if now is not None:
        done.append(now.row(part))
    yield out()


def _whole(conv: int | None, pieces: list[dict]) -> tuple:
    """The pieces of one conversation, at most one for each task, combined."""
    spans, last, low, high, turns, illegal = Spans(), None, None, None, 0, 0
    for x in pieces:
        spans.push(1, {(k // 4, k % 4): (c, a) for k, c, a in zip(x["pairs"], x["costs"], x["audits"])})
        if x["first"] is not None:
            illegal += x["illegal"] + (last is not None and last + x["first"] not in _LEGAL)
            last = x["last"]
        if x["low"] is not None:
            turns += x["turns"] - (x["low"] == high)
            low, high = x["low"] if low is None else low, x["high"]
    cell = spans.cell()
    cost, audit = min(cell[0, q] for q in ENDS if (0, q) in cell)
    gaps = 0 if low is None else high - low + 1 - turns
    return conv, gaps, *(sum(x[c] for x in pieces) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit


EDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in EDITS.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    for b in batches:
        pieces = b.column("pieces")
        cols = list(zip(*(_whole(conv, pieces[i].as_py()) for i, conv in enumerate(b.column("conv_id").to_pylist())))) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for the
    rows of ``with_faults``, one row per conversation."""
    keys = [F.col(c) for c in ORDER[:3]] + [F.substring("text", 1, 64)]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*ORDER)
    pieces = dealt.mapInArrow(_pieces, PIECE)
    rest = [c for c in pieces.columns if c != "conv_id"]  # part comes first
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("pieces")).mapInArrow(_wholes, EDITS)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    conv, audit, at, system, pos, done = None, "", 0, 0, 0, []

    def place(edit, turn, role, text):
        nonlocal pos
        turned = ("user", "assistant")[(pos - system) % 2]
        done.append((conv, pos, turn, edit, role if edit == "K" else turned, text))
        pos += 1

    def inserts():
        nonlocal at
        while audit[at : at + 1] == "I":
            place("I", None, None, "")
            at += 1

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "head", "turn", "role", "dropped")]
        texts = b.column("text")
        for i, (key, head, turn, role, dropped) in enumerate(zip(*cols)):
            if head is not None:  # a conversation begins: its edits stand before its rows
                conv, audit, at, pos = key, head, 0, 0
                system = (len(audit) - audit.count("D")) % 2  # an odd number of turns has a system row first
                inserts()
            elif not dropped:
                edit = audit[at]
                at += 1
                if edit != "D":
                    place(edit, turn, role, texts[i].as_py())
                inserts()
            if len(done) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, edit, role, text): the turns of every repaired
    conversation, those of one conversation in their order within one partition.

    A conversation's rows stream through one task, sorted on disk where need be;
    the task holds its audit, a byte for each row, and no more than a batch of texts."""
    kinds = dict(rows.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    heads = edits.select("conv_id", F.col("audit").alias("head"), null("turn"), null("role"), F.lit("").alias("text"), F.lit(False).alias("dropped"))
    both = heads.unionByName(rows.select("conv_id", F.lit(None).cast("string").alias("head"), "turn", "role", "text", "dropped"))
    sorted_ = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "role", "text")
    return sorted_.mapInArrow(_repaired, "conv_id long, pos long, turn long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = sha = None
    for b in batches:
        done = []
        roles, texts = b.column("role"), b.column("text")
        for i, (key, pos) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("pos").to_pylist())):
            if pos == 0:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{roles[i].as_py()}:".encode())
            sha.update(texts[i].as_py().encode())
        cols = list(zip(*done)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["conv_id", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha): the SHA-256 of the ``role:text`` lines of ``repaired_turns``,
    taken as they stream by; a conversation without turns has no row."""
    return turns.mapInArrow(_digests, "conv_id long, sha string")


def repair(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edits, turns) of ``damage``d rows, or of any rows with conv_id, turn, role,
    text and dropped.

    Rows of a conversation are taken by turn, nulls first, then role, then text:
    that settles ties, and equal rows are alike.  A null conv_id is a conversation
    of its own; null roles and texts count as one space; an empty table gives
    nothing; a conversation of any length, and a text of any length, is repaired
    whole; columns that are not named here are ignored.
    """
    kinds = {"conv_id": "long", "turn": "long"}
    plain = rows.select(*[F.col(c).cast(k) for c, k in kinds.items()], *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], "dropped")
    faults = scratch.put(with_faults(plain), "conversation-faults", keep=True)
    edits = scratch.put(cheapest_edits(faults), "conversation-edits", keep=True)
    return edits, repaired_turns(faults, edits)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``, damaged and repaired: the columns
    of ``cheapest_edits`` and repaired_sha256.  A conversation of which no row is
    left has zeros, an empty audit and the digest of nothing."""
    edits, turns = repair(damage(conversations), Scratch(conversations.sparkSession))
    sums = turn_digests(turns).withColumnRenamed("conv_id", "c")
    out = edits.join(sums, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
