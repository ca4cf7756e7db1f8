"""Best-fit packing by large-item matching.

A document's tokens are cut into pieces of at most one sequence. Only how many pieces have each length matters for a
packing, and there are at most `capacity` lengths: they are counted with Spark, packed as counts on the driver, and the
pieces then find their places by their rank among the pieces of their length.

The packing: two pieces above a third of the capacity are the most that a sequence can hold of that size, so they are
matched in pairs greedily (the longest with the longest that still fits). Shorter pieces go, longest first, into the
smallest gap that holds them, and open a new sequence only when no gap does.

Rows: a null or empty text is its end token alone; repeated rows and null ids are packed row by row; texts of any
length are cut and none is left out; equal lengths go by hash, id and piece; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmloom.llm.bpe import REMEMBERED, codec_of, vocabulary_text
from filmloom.llm.common import saved, slices, texts

CAPACITY = 1024
END = 2
SALTS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, seat long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of all documents. `seat` is a hash that spreads equal lengths over many tasks."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last = codec_of(spec.value, remembered), np.array([end], "<u4").tobytes()
        for batch in slices(batches, limit=4 << 20):
            rows: list[tuple] = []
            encoded = codec.encode_all(batch.column("text").to_pylist())
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encoded):
                packed += last
                n = len(packed) >> 2
                stops = list(range(n % capacity or capacity, n + 1, capacity))
                for k, stop in enumerate(stops):
                    start = stops[k - 1] if k else 0
                    crc = zlib.crc32(packed[4 * start:4 * stop])
                    seat = zlib.crc32(b"%d %d" % (-1 if doc_id is None else doc_id, k), crc)
                    rows.append((doc_id, k, start, stop - start, crc, seat))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "seat"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, pieces of it in each)]) of a packing of so many pieces of each length.

    The list is bounded by the number of lengths: each length splits at most two kinds of sequences.
    """
    left = Counter({n: c for n, c in counts.items() if c})
    large = sorted(n for n in left if 3 * n > capacity)
    open_by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def opened(times: int, held: list[tuple[int, int]]) -> None:
        if times:
            open_by_gap.setdefault(capacity - sum(n * k for n, k in held), []).append((times, held))

    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        mate = bisect.bisect_right(large, capacity - n) - 1
        while mate >= 0 and not left[large[mate]]:
            large.pop(mate)
            mate -= 1
        m = large[mate] if mate >= 0 else None
        if m is None:
            opened(left[n], [(n, 1)])
            left[n] = 0
        elif m == n:
            opened(left[n] // 2, [(n, 2)])
            opened(left[n] % 2, [(n, 1)])
            left[n] = 0
        else:
            times = min(left[n], left[m])
            opened(times, [(n, 1), (m, 1)])
            left[n] -= times
            left[m] -= times
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[n]
        gaps = sorted(g for g in open_by_gap if g >= n)
        while count:
            if gaps:
                gap = gaps.pop(0)
                times, held = open_by_gap[gap].pop()
                if open_by_gap[gap]:
                    gaps.insert(0, gap)
                else:
                    del open_by_gap[gap]
            else:
                gap, held = capacity, []
                times = -(-count // (capacity // n))
            each = gap // n
            full, rest = divmod(count, each)
            full = min(full, times)
            opened(full, [*held, (n, each)])
            count -= full * each
            if full < times and count:
                opened(1, [*held, (n, rest)])
                count -= rest
                full += 1
            if held:
                opened(times - full, held)
    return [x for gap in sorted(open_by_gap) for x in open_by_gap[gap]]


def places(packing: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the first ranks of its runs of pieces, and (first sequence, pieces in each, offset) of the runs."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: Counter = Counter()
    first = 0
    for times, held in packing:
        offset = 0
        for n, each in held:
            found.setdefault(n, []).append((ranked[n], first, each, offset))
            ranked[n] += times * each
            offset += n * each
        first += times
    return {n: (np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], np.int64))
            for n, rows in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. `cut` must be a stored table of pieces."""
    spark = cut.sparkSession
    cut = cut.withColumn("salt", F.pmod("seat", F.lit(salts)).cast("int"))
    per_salt = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # bounded by the number of lengths
    before = (Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("seat", "doc_id", "piece", "start")
    ranked = (cut.withColumn("rank", F.row_number().over(inside)).join(firsts, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("first") + F.col("rank") - 1).alias("rank")))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, rows = table.value[int(n)]
                k = np.searchsorted(starts, rank[at], "right") - 1
                inner = rank[at] - starts[k]
                first, each, base = rows[k].T
                sequence[at] = first + inner // each
                offset[at] = base + inner % each * n
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                   pa.array(sequence), pa.array(offset)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, out)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """Cut and pack whole documents. A worker remembers the ids of so many chunks of text; fewer take more time."""
    return pack(saved(pieces(docs, path, capacity, end, remembered), "pieces"), capacity)
