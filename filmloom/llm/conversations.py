"""Conversation repair by a dynamic program over grammar-compressed sequences.

A row is one of nine symbols: its role's initial (s, u, a or another) with or without a cut end, or a row that must go.
Rows give role initials `(s?(ua)+)?`, which an automaton of four states reads. A symbol's transfer matrix says for each
pair of states what the cheapest edits of that row cost, with inserted rows before it, and which they are. Matrices
multiply in min-plus arithmetic; of equal costs the edits of least initials stay, kept as ropes that are written out on
demand. Re-Pair replaces the most frequent neighbours of all sequences at hand by a new symbol again and again, so each
rule's matrix is made once, from its two parts, and serves all conversations.

Rows are sorted over all tasks by conversation, turn, role and text. A task cuts what it gets into pieces of bounded
size. A conversation in one piece is finished at once; of longer ones, each piece leaves its matrix, one scan over these
numbers tells the states at the borders, and the pieces are then read in order, never held together.

Rows: null role and text are one space; a null turn comes first and counts for no gap; a null conv_id is a conversation
of its own; rows of one turn go by role, then by a hash of role and text; repeated rows are duplicates; a conversation
without rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty table; further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from filmloom.llm.common import ready, saved

KEEP, REROLE, DELETE, INSERT, CUT_END = 0, 2, 3, 2, 1
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
BATCH_ROWS, BATCH_BYTES = 60_000, 24 << 20
LEAST_USES, MOST_RULES = 16, 400
STATES = 4  # nothing yet, after s, after u, after a
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_LEGAL = {"su", "ua", "au"}
# Inserted rows that lead from state to state, and from each state to an end that is allowed.
_FILLS = {(i, i): 0 for i in range(STATES)} | {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
_ENDS = (0, 2, 1, 0)
_GO, _FIRST = 9, 1  # symbols: 1 to 8 for initials and ends, 9 for rows that must go, from 10 on rules; 0 parts sequences
OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
       "repaired_sha256 string")
PIECE = ("part long, seg long, n_rows long, low long, high long, first long, last long, turns long, head string, tail string, "
         "costs array<long>, ranks array<long>, audits array<string>, roles array<string>, texts array<string>")
STREAM = f"{OUT}, {PIECE}"
_NAMES = [c.split(" ")[0] for c in STREAM.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c.split(" ")[0], _KINDS[c.split(" ")[1]]) for c in STREAM.split(", ")])
_OUT_SCHEMA = pa.schema(list(_SCHEMA)[:9])


class Rope:
    """Initials of edits: a string, or two ropes one after the other."""

    __slots__ = ("left", "right", "flat")

    def __init__(self, left: Rope | None, right: Rope | None, flat: str | None = None):
        self.left, self.right, self.flat = left, right, flat

    def __str__(self) -> str:
        if self.flat is None:
            out, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.flat is None:
                    todo += (rope.right, rope.left)
                else:
                    out.append(rope.flat)
            self.flat = "".join(out)
        return self.flat


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def better(a: Entry | None, cost: int, left: Rope, right: Rope) -> Entry:
    """The cheaper of two entries, of equal costs the one of least initials."""
    if a is None or cost < a[0]:
        return cost, Rope(left, right)
    if cost == a[0]:
        other = Rope(left, right)
        if str(other) < str(a[1]):
            return cost, other
    return a


def row_times(row: list[Entry | None], matrix: Matrix) -> list[Entry | None]:
    """A row of entries through a matrix."""
    out: list[Entry | None] = [None] * STATES
    for k, first in enumerate(row):
        if first is not None:
            for j, second in enumerate(matrix[k]):
                if second is not None:
                    out[j] = better(out[j], first[0] + second[0], first[1], second[1])
    return out


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product."""
    return [row_times(row, right) for row in left]


def edits(initial: str, cut_end: bool, must_go: bool) -> Matrix:
    """The transfer matrix of one row: inserted rows before it, then what becomes of it."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for (i, k), fill in _FILLS.items():
        ways = [("D", k, DELETE)]
        if not must_go:
            ways += [("K", _AFTER.get((k, initial)), KEEP + CUT_END * cut_end)]
            ways += [("R", _AFTER.get((k, x)), REROLE + CUT_END * cut_end) for x in "ua"]
        for letter, j, cost in ways:
            if j is not None:
                out[i][j] = better(out[i][j], INSERT * fill + cost, Rope(None, None, "I" * fill), Rope(None, None, letter))
    return out


def symbol(role: str, cut_end: bool, must_go: bool) -> int:
    """The number of a row's symbol."""
    return _GO if must_go else _FIRST + 2 * ("sua".find(role[0]) % 4 if role else 3) + cut_end


TERMINALS: list[Matrix] = [[], *(edits(x, c, False) for x in "sua?" for c in (False, True)), edits("?", False, True)]


def re_pair(sequences: list[list[int]], least: int = LEAST_USES, most: int = MOST_RULES) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules, numbered from 10 on, and the sequences written with them.

    The most frequent pair of neighbours is replaced, the least of equals, until none occurs `least` times.
    """
    lengths = [len(s) + 1 for s in sequences]
    text = np.zeros(sum(lengths), np.int64)
    at = 0
    for s, n in zip(sequences, lengths):
        text[at:at + n - 1] = s
        at += n
    rules: list[tuple[int, int]] = []
    while len(rules) < most and len(text) > 1:
        size = _GO + 1 + len(rules)
        pairs = text[:-1] * size + text[1:]
        counts = np.bincount(pairs[(text[:-1] > 0) & (text[1:] > 0)], minlength=1)
        best = int(counts.argmax())
        if counts[best] < least:
            break
        places = np.flatnonzero(pairs == best)
        if best // size == best % size:  # in a run of one symbol, every other place
            run = np.cumsum(np.append(True, np.diff(places) > 1)) - 1
            starts = np.append(0, np.flatnonzero(np.diff(run)) + 1)
            places = places[(np.arange(len(places)) - starts[run]) % 2 == 0]
        rules.append(divmod(best, size))
        text[places] = size
        text = np.delete(text, places + 1)
    stops = np.flatnonzero(text == 0)
    return rules, [text[a:b].tolist() for a, b in zip([0, *(stops[:-1] + 1)], stops)]


def matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """Matrices of all symbols, rules from the bottom up."""
    out = list(TERMINALS)
    for a, b in rules:
        out.append(times(out[a], out[b]))
    return out


def ended(row: list[Entry | None]) -> Entry:
    """The best of a row of entries with the inserted rows that end it."""
    best = None
    for entry, fill in zip(row, _ENDS):
        if entry is not None:
            best = better(best, entry[0] + INSERT * fill, entry[1], Rope(None, None, "I" * fill))
    return best


class Repair:
    """Takes rows and edits in order and hashes the repaired rows."""

    def __init__(self) -> None:
        self.hash, self.state, self.any = hashlib.sha256(), 0, False

    def take(self, audit: str, roles: list[str], texts: list[str]) -> None:
        rows = zip(roles, texts)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if self.state == 2 else "user"
            self.state = _AFTER[self.state, role[0]]
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True


class _Piece:
    """Neighbouring rows of one conversation."""

    def __init__(self, conv_id: int | None, seg: int, start: bool):
        self.conv_id, self.seg, self.whole = conv_id, seg, start
        self.symbols, self.roles, self.texts = [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut_end: bool) -> None:
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut_end and not (blank or again)
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.symbols.append(symbol(role, cut_end, blank or again))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + 64


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def finished(pieces: list[_Piece], part: int) -> pa.RecordBatch:
    """Results of whole conversations; matrices, edits and rows of the other pieces."""
    rules, sequences = re_pair([p.symbols for p in pieces])
    known = matrices(rules)
    start: list[Entry | None] = [(0, Rope(None, None, "")), *[None] * (STATES - 1)]
    rows = []
    for p, sequence in zip(pieces, sequences):
        row = dict.fromkeys(_NAMES) | {"conv_id": p.conv_id, "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal}
        if p.whole:
            entries = start
            for s in sequence:
                entries = row_times(entries, known[s])
            cost, rope = ended(entries)
            repair = Repair()
            repair.take(str(rope), p.roles, p.texts)
            row |= {"gaps": gaps(p.low, p.high, p.turns), "cost": cost, "audit": str(rope), "repaired_sha256": repair.hash.hexdigest()}
        else:
            whole: Matrix = [[(0, Rope(None, None, "")) if i == j else None for j in range(STATES)] for i in range(STATES)]
            for s in sequence:
                whole = times(whole, known[s])
            texts = [[None if e is None else str(e[1]) for e in line] for line in whole]
            ranks = [[sorted(t for t in line if t is not None).index(t) if t is not None else None for t in line] for line in texts]
            row |= {"part": part, "seg": p.seg, "n_rows": len(p.roles), "low": p.low, "high": p.high, "turns": p.turns,
                    "head": p.roles[0][:1] if p.roles else None, "tail": p.roles[-1][:1] if p.roles else None,
                    "costs": [None if e is None else e[0] for line in whole for e in line],
                    "ranks": [r for line in ranks for r in line], "audits": [t for line in texts for t in line],
                    "roles": p.roles, "texts": p.texts}
        rows.append(row)
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """The given damage by hash of conversation and turn: rows dropped (`gone`), emptied, cut, repeated, given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), part("role").alias("role"), part("text").alias("text"),
                                (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows in order over all tasks, with faults of their own; before rows that repeat an earlier turn's stands a mark."""
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), *(["gone"] if "gone" in rows.columns else [F.lit(False).alias("gone")]))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.withColumn("digest", F.when(~F.col("gone"), digest))
    light = rows.filter(~F.col("gone")).select("conv_id", "role", "digest", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    firsts = (light.groupBy("conv_id", "digest").agg(F.min("at").alias("start"), F.max("at").alias("stop"))
              .filter(F.col("start") != F.col("stop")).withColumnRenamed("conv_id", "c").withColumnRenamed("digest", "d"))
    marks = (light.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("at") > F.col("start")))
             .select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), F.lit(False).alias("gone"), "digest")
             .distinct())
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    order = ["conv_id", "turn", "role", "digest"]
    return (rows.unionByName(marks).withColumn("blank", blank).withColumn("cut_end", cut_end)
            .repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").isNotNull()))


def cut(ordered: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Results of conversations that lie in one piece, and pieces of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, seen, held = TaskContext.get().partitionId(), 0, 0, []
        piece = mark = last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "digest", "blank", "cut_end")]
            for conv_id, turn, role, text, gone, digest, blank, cut_end in zip(*columns):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        held.append(piece)
                        seen += piece.size
                    piece, last, made = _Piece(conv_id, made, piece is not None), None, made + 1
                elif len(piece.roles) >= piece_rows or piece.size >= piece_bytes:
                    piece.whole = False
                    held.append(piece)
                    seen += piece.size
                    piece, made = _Piece(conv_id, made, False), made + 1
                if seen >= BATCH_BYTES or len(held) >= BATCH_ROWS // 4:
                    yield finished(held, part)
                    held, seen = [], 0
                if gone:
                    continue
                here = (conv_id, turn, digest)
                if text is None:
                    mark = here
                    continue
                piece.add(turn, role, text, blank, here == mark or here == last, cut_end)
                last = here
        if piece is not None:
            piece.whole = False
            yield finished([*held, piece], part)

    return ordered.mapInArrow(run, STREAM)


def borders(table: pa.Table) -> pa.Table:
    """States before and after each piece of one conversation on its cheapest way, and the conversation's counts."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    togo: list[list[float]] = [[INSERT * e for e in _ENDS]]
    for r in reversed(rows):
        after, costs = togo[-1], r["costs"]
        togo.append([min((costs[STATES * i + j] + after[j] for j in range(STATES) if costs[STATES * i + j] is not None), default=float("inf"))
                     for i in range(STATES)])
    togo.reverse()
    state, out, illegal, turns, high, tail, low = 0, [], 0, 0, None, None, None
    for k, r in enumerate(rows):
        ways = [(r["costs"][STATES * state + j] + togo[k + 1][j], r["ranks"][STATES * state + j], j)
                for j in range(STATES) if r["costs"][STATES * state + j] is not None]
        after = min(ways)[2]
        out.append((r["part"], r["seg"], state, after))
        state = after
        illegal += r["illegal"]
        if r["head"] is not None:
            illegal += tail is not None and tail + r["head"] not in _LEGAL
            tail = r["tail"]
        turns += r["turns"] - (r["low"] is not None and r["low"] == high)
        low = r["low"] if low is None else low
        high = r["high"] if r["high"] is not None else high
    n = len(out)
    sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}
    counts = [gaps(low, high, turns), sums["blank"], sums["duplicate"], sums["truncated"], illegal, int(togo[0][0])]
    return pa.table([*(pa.array([o[i] for o in out], pa.int64()) for i in range(4)), *(pa.array([c] * n, pa.int64()) for c in counts)],
                    names=["part", "seg", "enter", "leave", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])


def joined(pieces: DataFrame) -> DataFrame:
    """Results of conversations in several pieces, each read piece by piece."""
    numbers = pieces.select("conv_id", "part", "seg", "low", "high", "turns", "head", "tail", "blank", "duplicate", "truncated", "illegal", "costs", "ranks")
    ways = numbers.groupBy("conv_id").applyInArrow(borders, "part long, seg long, enter long, leave long, gaps long, blank long, duplicate long, "
                                                            "truncated long, illegal long, cost long")
    audit = F.col("audits")[(STATES * F.col("enter") + F.col("leave")).cast("int")]
    rows = (pieces.select("conv_id", "part", "seg", "audits", "roles", "texts").join(ways, ["part", "seg"])
            .withColumn("edits", audit).drop("audits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, repair, audits = None, None, []

        def result() -> pa.RecordBatch:
            end = "I" * _ENDS[held["leave"]]
            repair.take(end, [], [])
            row = {k: held[k] for k in _OUT_SCHEMA.names[:7]} | {"audit": "".join(audits) + end, "repaired_sha256": repair.hash.hexdigest()}
            return pa.RecordBatch.from_pylist([row], _OUT_SCHEMA)

        for batch in batches:
            for i in range(batch.num_rows):  # one piece at a time
                row = batch.slice(i, 1).to_pylist()[0]
                if held is None or row["conv_id"] != held["conv_id"]:
                    if held is not None:
                        yield result()
                    repair, audits = Repair(), []
                held = row
                audits.append(row["edits"])
                repair.take(row["edits"], row.pop("roles"), row.pop("texts"))
        if held is not None:
            yield result()

    return rows.mapInArrow(run, OUT)


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows that are `gone`, where there is such a column, only name their conversation.
    """
    ready(rows.sparkSession)
    found = saved(cut(marked(rows), piece_rows, piece_bytes), "pieces")
    whole = found.filter(F.col("part").isNull()).select(*_OUT_SCHEMA.names)
    return whole.unionByName(joined(found.filter(F.col("part").isNotNull())))
