"""Usage budgets that are enforced: attempts are admitted in order of time, and only admitted ones count.

Whether an attempt passes depends on those admitted before it, so the log is decided span by span of time. What one span
hands to the next is small whatever the log: the admitted attempts of the last minute, the day's count and the totals.

* A cap bounds what a second can admit, so few of its attempts need a look. In one second an attempt passes only after
  all earlier ones that ask for no more tokens. Of the attempts of a second with equal tokens, only the first
  `per_minute` can pass; all others are refused without being moved.
* All spans are decided at the same time from an assumed start; those whose start turns out differently, or in which a
  total runs out, are decided again, until each starts where the one before ended. Equal starts give equal results, so
  the outcome is that of one pass in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import compress, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmloom.functions.text import local_day
from filmloom.session import materialize

SPAN_SECONDS = 3600


@dataclass(frozen=True)
class Caps:
    """The caps of a campaign; the sliding window is `window` seconds long."""

    per_minute: int
    tokens_per_minute: int
    per_day: int
    attempts: int
    tokens: int
    window: int = 60


@dataclass(frozen=True)
class Carry:
    """What a span hands on: (second, tokens) of the window's admitted attempts, the last day and its count, the totals."""

    recent: tuple[tuple[int, int], ...] = ()
    day: int | None = None
    day_attempts: int = 0
    attempts: int = 0
    tokens: int = 0


@dataclass(frozen=True)
class Outcome:
    """A decided span: what it hands on, the most tokens asked for at once, its first day and what that day admitted."""

    end: Carry
    most: int
    first_day: int
    first_admitted: int


def decided(rows: Iterator[tuple[int, int, int]], start: Carry, caps: Caps) -> tuple[list[bool], Outcome]:
    """Decisions on (second, day, tokens) in order, and their outcome. There is at least one row."""
    recent, held = deque(start.recent), sum(t for _, t in start.recent)
    day, day_attempts, attempts, tokens, most = start.day, start.day_attempts, start.attempts, start.tokens, 0
    out, first_day, first_admitted = [], None, 0
    for second, today, asked in rows:
        while recent and recent[0][0] <= second - caps.window:
            held -= recent.popleft()[1]
        if today != day:
            day, day_attempts = today, 0
        first_day = today if first_day is None else first_day
        most = max(most, asked)
        ok = (attempts < caps.attempts and day_attempts < caps.per_day and tokens + asked <= caps.tokens
              and len(recent) < caps.per_minute and held + asked <= caps.tokens_per_minute)
        out.append(ok)
        if ok:
            recent.append((second, asked))
            held, day_attempts, attempts, tokens = held + asked, day_attempts + 1, attempts + 1, tokens + asked
            first_admitted += today == first_day
    return out, Outcome(Carry(tuple(recent), day, day_attempts, attempts, tokens), most, first_day, first_admitted)


def candidates(log: DataFrame, caps: Caps, span: int, zone: str) -> DataFrame:
    """Attempts that could pass, with their span, second and day. An attempt without a time or tokens cannot."""
    timed = log.select("request_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("tokens").cast("long").alias("tokens"))
    usable = timed.where(F.col("second").isNotNull() & F.col("tokens").between(0, min(caps.tokens_per_minute, caps.tokens)))
    first = Window.partitionBy("second", "tokens").orderBy("request_id")
    few = usable.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= caps.per_minute).drop("turn")
    return few.withColumn("span", F.floor(F.col("second") / span)).withColumn(
        "day", F.unix_date(local_day(F.timestamp_seconds("second"), zone).cast("date")))


_FOUND = ("span long, request_ids array<long>, recent_seconds array<long>, recent_tokens array<long>, day int, day_attempts long, "
          "attempts long, tokens long, most long, first_day int, first_admitted long, chained int")
_LONGS, _DAYS = pa.list_(pa.int64()), ("day", "first_day", "chained")
_FOUND_ARROW = pa.schema([(name, _LONGS if kind == "array<long>" else pa.int32() if name in _DAYS else pa.int64())
                          for name, kind in (column.split(" ") for column in _FOUND.split(", "))])


def _start(number: int, known: Carry, span: int, caps: Caps) -> Carry:
    """Where a span starts after one that hands on `known`."""
    return replace(known, recent=tuple(x for x in known.recent if x[0] > number * span - caps.window))


def _run(rows: DataFrame, starts: dict[int, Carry], before: dict[int, int], span: int, caps: Caps) -> DataFrame:
    """One row per span: ids of its admitted attempts, bounded by the caps, and what it hands on.

    A task reads a range of spans in order as one stream, and a span whose predecessor (`before`) was just decided there starts
    where that one ended (`chained`): so a round settles the first range, not the first span alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("span", "second", "request_id", "day", "tokens"))))
        last, end = None, Carry()
        for number, own in groupby(attempts, key=itemgetter(0)):
            ids: list[int] = []
            chained = last is not None and before[number] == last
            ok, found = decided(_noting(own, ids), _start(number, end, span, caps) if chained else starts[number], caps)
            last, end = number, found.end
            yield pa.RecordBatch.from_pylist([{
                "span": number, "request_ids": list(compress(ids, ok)), "recent_seconds": [s for s, _ in end.recent],
                "recent_tokens": [t for _, t in end.recent], "day": end.day, "day_attempts": end.day_attempts, "attempts": end.attempts,
                "tokens": end.tokens, "most": found.most, "first_day": found.first_day, "first_admitted": found.first_admitted,
                "chained": int(chained)}], _FOUND_ARROW)

    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # a number of its own, or few bytes would meet in one task
    return rows.repartitionByRange(tasks, "span").sortWithinPartitions("span", "second", "request_id").mapInArrow(run, _FOUND)


def _noting(rows: Iterator[tuple], ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(second, day, tokens) of the rows of a span; their ids go to the list."""
    for _, second, request_id, day, tokens in rows:
        ids.append(request_id)
        yield second, day, tokens


def admitted(log: DataFrame, caps: Caps, span: int = SPAN_SECONDS, zone: str = "America/Los_Angeles") -> DataFrame:
    """(request_id, admitted) of every attempt of (request_id, ts, tokens); ids are whole numbers, ties of time go by id.

    The driver holds what each span hands on, one small record per span of the log. Every round settles at least the
    first range of spans that is not settled, of two a core; without a total running out, two or three rounds settle all.
    """
    if span < caps.window:
        raise ValueError("a span must be as long as the sliding window")
    rows = materialize(candidates(log, caps, span, zone), "candidates")
    spans = sorted(r["span"] for r in rows.select("span").distinct().collect())
    before = dict(zip(spans[1:], spans))
    before[spans[0] if spans else None] = None
    starts, ends, tables, todo = {n: Carry() for n in spans}, {}, {}, list(spans)
    while todo:
        done = materialize(_run(rows.where(F.col("span").isin(todo)) if len(todo) < len(spans) else rows, {n: starts[n] for n in todo}, before, span, caps), "spans")
        chained = set()
        for r in done.drop("request_ids").collect():
            end = Carry(tuple(zip(r["recent_seconds"], r["recent_tokens"])), r["day"], r["day_attempts"], r["attempts"], r["tokens"])
            ends[r["span"]] = Outcome(end, r["most"], r["first_day"], r["first_admitted"])
            tables[r["span"]] = done
            if r["chained"]:
                chained.add(r["span"])
        todo, known = [], Carry()
        for n in spans:
            if n in chained:
                starts[n] = _start(n, ends[before[n]].end, span, caps)
            start, used = _start(n, known, span, caps), starts[n]
            if not _alike(start, used, ends[n], caps):
                starts[n] = start
                todo.append(n)  # what it hands on is a guess until it is decided again
            known = _handed_on(start, used, ends[n], caps)
    out = None
    for table in {id(t): t for t in tables.values()}.values():
        mine = [n for n in spans if tables[n] is table]
        part = table.where(F.col("span").isin(mine)).select(F.explode("request_ids").alias("request_id"), F.lit(True).alias("admitted"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return log.select("request_id", F.lit(False).alias("admitted"))
    return log.select("request_id").join(out, "request_id", "left").select("request_id", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def _day_before(start: Carry, found: Outcome) -> int:
    """What the span's first day had admitted before the span."""
    return start.day_attempts if start.day == found.first_day else 0


def _alike(start: Carry, used: Carry, found: Outcome, caps: Caps) -> bool:
    """Whether a span that was decided from `used` decides alike from `start`: no count or total refuses in either."""
    if start == used:
        return True
    gained = found.end.attempts - used.attempts, found.end.tokens - used.tokens
    free = lambda c: (c.attempts + gained[0] < caps.attempts and c.tokens + gained[1] + found.most <= caps.tokens
                      and _day_before(c, found) + found.first_admitted < caps.per_day)
    return start.recent == used.recent and free(start) and free(used)


def _handed_on(start: Carry, used: Carry, found: Outcome, caps: Caps) -> Carry:
    """What a span decided from `used` hands on when it starts at `start`: exact if it decides alike, else a guess within the caps."""
    end = found.end
    one_day = end.day == found.first_day
    day_attempts = _day_before(start, found) + found.first_admitted if one_day else end.day_attempts
    return Carry(end.recent, end.day, min(day_attempts, caps.per_day), min(start.attempts + end.attempts - used.attempts, caps.attempts),
                 min(start.tokens + end.tokens - used.tokens, caps.tokens))
