"""Collocations: phrases of two and three words, counted by merging counting quotient filters.

1. Tasks write their texts as blocks of some MB: word numbers of the block, and the block's own list of words with counts.
2. The lists are brought together by word. A phrase is counted ten times only if each of its words is, so words that
   occur less often get no id; a phrase with one of them needs no counter.
3. The ids return to the blocks that use them. Each block counts its pairs and triples in quotient filters, cut into
   ranges of the permuted key; filters of a range are merged, at most 256 in a task, in as many rounds as it takes.
4. Counts of ten or more leave the filters as candidates and are scored by joins.

Every step carries distinct words or n-grams of a block, never occurrences, so a word or phrase of any frequency is one
row a block. Nothing is sent to all tasks, and the driver holds only counts of words per task.

Rows: a null text is the empty text and has no words; a null lang is `und`; doc_id is not looked at; repeated rows count
once each; texts of any length are read whole; ties of score and count go by the phrase; an empty table gives an empty
table; further columns are not looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmloom.llm import quotient
from filmloom.llm.common import ready, saved

LEAST = 10
SHARE = 50  # per cent of a phrase's occurrences that lie in one longer candidate
BEST = 2000
BLOCK_BYTES = 12 << 20
FAN = 256  # filters that one task merges
# Marks that end a piece, and what parts words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_LETTERS = bytes.maketrans(BREAKS + b"\t" + _UPPER, b"." * len(BREAKS) + b" " + _LOWER)
_BREAK = b"."
CODED = "block long, codes binary, number int, lang string, word string, n long"
LISTED = "block long, number int, part int, place int, lang string, word string, f long"
SLICES = "places int, range long, block long, filter binary"
PHRASES = "w1 int, w2 int, w3 int, a long"


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with a lone mark wherever a piece ends."""
    return text.translate(_LETTERS).replace(_BREAK, b" . ").split()


class _Numbers(dict):
    """Numbers of words in order of appearance; the mark that ends pieces is 0."""

    def __init__(self, count: Iterator[int]):
        super().__init__({_BREAK: 0})
        self.count = count

    def __missing__(self, word: bytes) -> int:
        self[word] = number = next(self.count)
        return number


class _Block:
    """Texts of one block as numbers."""

    def __init__(self) -> None:
        self.count, self.words, self.codes, self.size = itertools.count(1), {}, [], 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.words.get(lang)
        if numbers is None:
            numbers = self.words[lang] = _Numbers(self.count)
        self.codes.append(np.array([*map(numbers.__getitem__, words_of(text)), 0], np.uint32))
        self.size += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """One row with the codes, frequent words having low numbers, and one row per word."""
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=next(self.count))
        order = np.argsort(-counts[1:], kind="stable") + 1
        numbers = np.zeros(len(counts), np.uint32)
        numbers[order] = np.arange(1, len(counts), dtype=np.uint32)
        planes = numbers[codes].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        yield self._batch([block], [zlib.compress(planes, 1)], None, None, None, None)
        for lang, words in self.words.items():
            listed = [(w, k) for w, k in words.items() if k]
            for at in range(0, len(listed), 50_000):
                part = listed[at:at + 50_000]
                k = np.fromiter((k for _, k in part), np.int64, len(part))
                yield self._batch(np.full(len(part), block), None, numbers[k].astype(np.int32), [lang] * len(part),
                                  pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), counts[k])

    @staticmethod
    def _batch(block, codes, number, lang, word, n) -> pa.RecordBatch:
        none = [None] * len(block)
        return pa.record_batch([pa.array(block, pa.int64()), pa.array(codes or none, pa.binary()),
                                pa.array(none if number is None else number, pa.int32()), pa.array(lang or none, pa.string()),
                                word if word is not None else pa.array(none, pa.string()),
                                pa.array(none if n is None else n, pa.int64())],
                               names=["block", "codes", "number", "lang", "word", "n"])


def coded(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks: rows with `codes`, and rows with a word, its lang, its number in the block and its count there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, made = TaskContext.get().partitionId() << 32, _Block(), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                held.add(lang, text)
                if held.size >= block_bytes:
                    yield from held.rows(first + made)
                    held, made = _Block(), made + 1
        if held.codes:
            yield from held.rows(first + made)

    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, CODED)


def decoded(blob: bytes) -> np.ndarray:
    """Word numbers of a block."""
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def listed(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """Of words with `least` occurrences: every block's number for it, with the word's place in its part and its count f.

    The word itself stands only in the first row of each word. Rows arrive sorted; a word has at most one row a block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None

        def closed(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            sums = np.add.reduceat(rows["n"].to_numpy(), starts)
            often = sums >= least
            place = np.cumsum(often) - 1 + made
            made += int(often.sum())
            sizes = np.diff(np.append(starts, len(rows)))
            keep, first = np.repeat(often, sizes), np.zeros(len(rows), bool)
            first[starts] = True
            kept, first = rows.filter(pa.array(keep)).combine_chunks(), pa.array(first[keep])
            none = pa.scalar(None, pa.string())
            one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            return pa.record_batch([one(kept["block"]), one(kept["number"]), pa.array(np.full(len(kept), part), pa.int32()),
                                    pa.array(np.repeat(place, sizes)[keep], pa.int32()),
                                    one(pc.if_else(first, one(kept["lang"]), none)), one(pc.if_else(first, one(kept["word"]), none)),
                                    pa.array(np.repeat(sums, sizes)[keep], pa.int64())],
                                   names=["block", "number", "part", "place", "lang", "word", "f"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            changed = [pc.not_equal(held[c].slice(1), held[c].slice(0, len(held) - 1)).to_numpy() for c in ("lang", "word")]
            starts = np.append(0, np.flatnonzero(changed[0] | changed[1]) + 1)
            if len(starts) > 1:
                yield closed(held.slice(0, int(starts[-1])), starts[:-1])
                held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield closed(held, np.array([0]))

    words = blocks.filter(F.col("word").isNotNull()).select("lang", "word", "block", "number", "n")
    return words.repartition("lang", "word").sortWithinPartitions("lang", "word").mapInArrow(run, LISTED)


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a dense word id from 1, and how many ids there are. The offsets are one number per part of `listed`."""
    spark = rows.sparkSession
    sizes = rows.groupBy("part").agg((F.max("place") + 1).cast("bigint").alias("size")).orderBy("part").collect()
    offsets, total = [], 1
    for row in sizes:
        offsets.append((row["part"], total))
        total += row["size"]
    table = spark.createDataFrame(offsets, "part int, offset long")
    return rows.join(F.broadcast(table), "part").withColumn("id", (F.col("offset") + F.col("place")).cast("int")).drop("part", "place", "offset"), total - 1


def filters(blocks: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Each block's pairs and triples of words with ids, in quotient filters cut into ranges."""
    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            codes = decoded(left["codes"][0].as_py())
            of_number = np.zeros(int(codes.max()) + 1, np.uint32)
            of_number[right["number"].to_numpy()] = right["id"].to_numpy()
            ids_ = of_number[codes]
            here = ids_ > 0
            both = here[:-1] & here[1:]
            block = left["block"][0].as_py()
            for places, whole in ((2, both), (3, both[:-1] & both[1:])):
                at = np.flatnonzero(whole)
                keys, counts = quotient.folded(quotient.permuted([ids_[at + k] for k in range(places)], width))
                found += [(places, range_, block, blob)
                          for range_, blob in quotient.cut(keys, counts, places * width, quotient.RANGE_BITS)]
        columns = list(zip(*found)) if found else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["places", "range", "block", "filter"])

    codes = blocks.filter(F.col("codes").isNotNull()).select("block", "codes")
    return codes.groupBy("block").cogroup(ids.select("block", "number", "id").groupBy("block")).applyInArrow(count, SLICES)


def _finer(width: int, prefix: int) -> Callable[[pa.Table], pa.Table]:
    """Merges filters of one range and shard and cuts the outcome into ranges of `prefix` bits."""
    def run(table: pa.Table) -> pa.Table:
        places, shard = table["places"][0].as_py(), table["shard"][0].as_py()
        found = quotient.merged(list(zip(table["filter"].to_pylist(), table["range"].to_pylist())), places * width)
        parts = quotient.cut(*found, places * width, prefix)
        return pa.table([pa.array([places] * len(parts), pa.int32()), pa.array([r for r, _ in parts], pa.int64()),
                         pa.array([shard] * len(parts), pa.int64()), pa.array([b for _, b in parts], pa.binary())],
                        names=["places", "range", "block", "filter"])

    return run


def merge(slices: DataFrame, width: int, blocks: int, least: int = LEAST, fan: int = FAN) -> DataFrame:
    """Phrases of `least` occurrences or more: rounds that merge at most about `fan` filters of a range in a task.

    Each round cuts ranges finer by as much as it merges, so filters keep their size at any number of blocks.
    """
    prefix = quotient.RANGE_BITS
    while blocks > fan:
        blocks, prefix = -(-blocks // fan), prefix + quotient.RANGE_BITS
        shards = slices.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(blocks)).cast("bigint"))
        slices = saved(shards.groupBy("places", "range", "shard").applyInArrow(_finer(width, prefix), SLICES), "filters")

    def phrases(table: pa.Table) -> pa.Table:
        places = table["places"][0].as_py()
        keys, counts = quotient.merged(list(zip(table["filter"].to_pylist(), table["range"].to_pylist())), places * width)
        often = counts >= least
        words = quotient.restored((keys[0][often], None if keys[1] is None else keys[1][often]), width, places)
        n = int(often.sum())
        third = pa.array(words[2].astype(np.int32)) if places == 3 else pa.nulls(n, pa.int32())
        return pa.table([pa.array(words[0].astype(np.int32)), pa.array(words[1].astype(np.int32)), third, pa.array(counts[often])],
                        names=["w1", "w2", "w3", "a"])

    return slices.groupBy("places", "range").applyInArrow(phrases, PHRASES)


def scored(found: DataFrame, words: DataFrame, totals: DataFrame, best: int = BEST, share: int = SHARE) -> DataFrame:
    """The best phrases of each lang. `found` is a stored table of phrases, `words` one of id, lang, word, f."""
    def rate(l: str, r: str) -> Column:
        """Exact to 38 digits: counts below 10 ** 15."""
        square, product = "cast(a as decimal(15,0)) * cast(a as decimal(15,0))", f"cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))"
        return F.expr(f"(cast(1000000 as decimal(7,0)) * {square}) div ({product})")

    def word(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), F.col("lang").alias(f"lang{k}"))

    pairs = found.filter(F.col("w3").isNull()).select("w1", "w2", "a")
    triples = found.filter(F.col("w3").isNotNull())
    longer = (triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
              .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    two = (pairs.join(longer, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
           .join(word(1), "w1").join(word(2), "w2")
           .select(F.col("lang1").alias("lang"), F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
           .withColumn("score", rate("l", "r")))
    head = pairs.select("w1", "w2", F.col("a").alias("f12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = (triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
             .withColumn("s1", rate("f1", "f23")).withColumn("s2", rate("f12", "f3"))
             .select(F.col("lang1").alias("lang"), F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
                     F.when(F.col("s1") <= F.col("s2"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
                     F.when(F.col("s1") <= F.col("s2"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
                     F.least("s1", "s2").alias("score")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, share: int = SHARE, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each lang of whole `documents` texts."""
    ready(docs.sparkSession)
    blocks = saved(coded(docs, block_bytes), "blocks")
    totals = blocks.filter(F.col("word").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    rows, total = numbered(saved(listed(blocks, least), "listed"))
    width = max(1, total.bit_length())
    n_blocks = blocks.filter(F.col("codes").isNotNull()).count()
    slices = filters(blocks, rows, width)
    found = saved(merge(saved(slices, "filters") if n_blocks > fan else slices, width, n_blocks, least, fan), "phrases")
    words = rows.filter(F.col("word").isNotNull()).select("id", "lang", "word", "f")
    return scored(found, words, totals, best, share)
