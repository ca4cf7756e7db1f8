"""Exact top-k inner products on a bit-sliced index.

Each component of a vector is quantised to an integer. A block of rows stores, for each component, one bitmap per binary
digit: the index. A query's score of all rows of a block is the sum, over components, of the query's weight times the
component's digits; it is worked out with bitmap arithmetic alone: digits are shifted by the weight's own digits and
bitmaps of equal place are added by full adders (two bitmaps of place p and one carry into p + 1), until each place holds
one bitmap. The slices of the sum are then read from the most significant downward: rows with a one are certainly among
the top while they are no more than k, rows with a zero drop out once k rows are certain. What is left at the boundary
is resolved exactly by scores and ids.

Queries go in blocks of bounded size against all rows, so what is sent to the tasks does not grow with the data; each
task gives k rows per query, and k of those stay.

Rows: vectors that are null, or hold null or non-finite components, take no part; vectors answer those of their own
length, and empty ones score 0; repeated vectors tie and the smaller id comes first; a row never answers itself, and of
rows that repeat an id none answers another, and the least vector asks; null ids take no part; an empty table gives an empty table.
Components so large that a sum of products could pass 64 bits are refused by an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmloom.llm.common import ready, saved

SCALE = 1024
EVERY = 100
K = 10
QUERY_BLOCK = 2048
ROW_BLOCK = 1 << 15
ANSWER = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, parts: floor(scale * x) of each component as double, of usable vectors."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    good = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                                                        ).filter(F.coalesce(fine, F.lit(False)))
    # Any two vectors of such components have a product below 2 ** 62.
    most = F.sqrt(F.lit(2.0 ** 62) / F.greatest(F.size("embedding"), F.lit(1))) / scale - 1
    large = F.exists(x, lambda v: F.abs(v) > most)
    parts = F.when(large, F.raise_error(F.lit("components are too large for sums of 64 bits"))).otherwise(
        F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))
    return good.select(F.col("vec_id").cast("bigint"), parts.cast("array<bigint>").alias("parts"))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps [component, digit, word] of values [row, component] taken from each component's least, and those least."""
    least = values.min(axis=0)
    shifted = (values - least).astype(np.uint64)
    digits = max(1, int(shifted.max()).bit_length())
    rows = -(-len(values) // 64) * 64
    bits = np.zeros((values.shape[1], digits, rows), np.uint8)
    for d in range(digits):
        bits[:, d, :len(values)] = ((shifted >> np.uint64(d)) & np.uint64(1)).T
    packed = np.packbits(bits, axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64), least


def added(places: list[np.ndarray]) -> list[np.ndarray]:
    """One bitmap per place of the sum of bitmaps: places[p] holds those that weigh 2 to the power p, one per row."""
    out, p, carried = [], 0, []
    while p < len(places) or carried:
        here = places[p] if p < len(places) else np.zeros((0, carried[0].shape[1]), np.uint64)
        here, carried = np.concatenate([here, *carried]) if carried else here, []
        while len(here) > 1:
            n = len(here) // 3
            if n:
                a, b, c = here[:n], here[n:2 * n], here[2 * n:3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                here = np.concatenate([half ^ c, here[3 * n:]])
            else:
                carried.append((here[:1] & here[1:]))
                here = here[:1] ^ here[1:]
        out.append(here[0] if len(here) else None)
        p += 1
    return out


def top_rows(total: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the k rows of largest sum among those alive, with all rows that tie at the boundary."""
    certain, open_ = np.zeros_like(alive), alive
    n = 0
    for digit in reversed(total):
        if digit is None:
            continue
        ones = open_ & digit
        count = int(np.bitwise_count(ones).sum())
        if n + count > k:
            open_ = ones
        elif n + count < k:
            certain, n, open_ = certain | ones, n + count, open_ & ~digit
        else:
            return certain | ones
    return certain | open_


class Index:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.digits, self.least = slices_of(self.values)
        self.words = self.digits.shape[2]
        every = np.zeros(self.words * 64, np.uint8)
        every[:len(ids)] = 1
        self.alive = np.packbits(every, bitorder="little").view(np.uint64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's best rows, best first, ties to the smaller id."""
        # Under a negative weight the digits are turned over: -x = (not x) + 1 - 2 ** digits. What that and the components'
        # least values add is the same for all rows, so the order of the sums is the order of the scores.
        components, digits, words = self.digits.shape
        negative = query < 0
        weight = np.abs(query)
        places: list[list[np.ndarray]] = [[] for _ in range(int(weight.max()).bit_length() + digits)] or [[]]
        flipped = self.digits ^ np.where(negative, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None, None]
        for b in range(int(weight.max()).bit_length()):
            at = np.flatnonzero((weight >> b) & 1)
            for d in range(digits):
                places[b + d].append(flipped[at, d])
        stacked = [np.concatenate(p) if p else np.zeros((0, words), np.uint64) for p in places]
        alive = self.alive
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        if lo < hi:
            alive = alive.copy()
            for i in range(lo, hi):
                alive[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        chosen = top_rows(added(stacked), alive, k)
        at = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        scores = self.values[at] @ query
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][best], scores[best]


def search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows."""
    spark = vectors.sparkSession
    ready(spark)
    table = saved(quantised(vectors, scale), "quantised")
    found = None
    for size in [r["d"] for r in table.select(F.size("parts").alias("d")).distinct().orderBy("d").collect()]:
        rows = table.filter(F.size("parts") == size)
        if not size:
            rows = rows.withColumn("parts", F.array(F.lit(0).cast("bigint")))
        asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("parts").alias("parts"))
        cell = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // query_block))))
        for block in asked.groupBy(cell.alias("cell")).count().orderBy("cell").collect():
            got = asked.filter(cell == block["cell"]).toArrow()
            ids = got.column("vec_id").to_numpy()
            values = np.array(got.column("parts").to_pylist(), np.int64)
            sent = spark.sparkContext.broadcast((ids, values))  # bounded by about query_block rows
            part = saved(rows.mapInArrow(_answers(sent, k), ANSWER), "answers")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _answers(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROW_BLOCK:
                yield answer(held)
                held = []
        if held:
            yield answer(held)

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
        parts = pa.chunked_array([b.column("parts") for b in held]).combine_chunks()
        index = Index(ids, parts.flatten().to_numpy().reshape(len(ids), -1))
        out: list[list[np.ndarray]] = [[], [], []]
        for query_id, query in zip(*sent.value):
            best, scores = index.top(int(query_id), query, k)
            for held_column, values in zip(out, (np.full(len(best), query_id), best, scores)):
                held_column.append(values)
        return pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run
