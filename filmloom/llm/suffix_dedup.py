"""Suffix-array dedup: repeated byte strings by merging the transforms of shards.

Every string of 200 bytes that starts anywhere else as well is a repeat, and each byte that a repeat covers is removed.

A string is found from its anchor, the last of its 64-byte grams of least hash: equal strings have their anchors at the
same place inside. The suffixes at the anchors, with the bytes before them, are a sampled Burrows-Wheeler transform of
each text; texts are the shards. Suffixes whose gram occurs once in the corpus are settled at once. The others meet by
gram, and their transforms are merged by iterative interleave refinement: all suffixes of a gram begin in one block, each
round splits the blocks by the next byte to the right, a suffix alone in its block is settled, and the depth at which
neighbours part is their common prefix; no suffix is sorted as a whole. The bytes before the anchors refine the blocks to
the left in the same way. The strings that begin l bytes before an anchor are repeats where a block of l bytes to the
left and 200 - l to the right holds more than one suffix.

Grams in very many places go another way with the same result: their strings are counted one by one by hash, so no task
has to hold them all. Equal texts are one shard; with two of them, all their strings are repeats.

Rows: null and empty texts and texts under 200 bytes have nothing removed; repeated rows are copies of each other; rows
without id are treated like others; texts are taken whole; an empty table gives an empty table; further columns are not
looked at. Texts, grams in many places and copies are told apart by 64 to 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmloom.llm.common import keeping_columns, saved, slices, texts, worker_state

LENGTH = 200
GRAM = 64
HOT = 1 << 16  # suffixes of one gram that a task merges: some 100 MB and three seconds
_CHUNK = 20_000
_PLACE_BITS = 28
_PLACE_MASK = (1 << _PLACE_BITS) - 1
_BASE = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_SALT = np.frombuffer(b"".join(hashlib.sha512(bytes([i])).digest() for i in range(32)), "<u8")
def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for texts of up to n bytes."""
    tables = worker_state("suffix powers", dict)
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in tables:
        if size > 1 << 16:  # of long texts' tables, one stays
            for k in [k for k in tables if k > 1 << 16]:
                del tables[k]
        tables[size] = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    return tables[size]


def gram_hashes(body: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    up, down = _steps(len(body))
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_SALT[body] * up[:len(body)], out=total[1:])
    h = (total[size:] - total[:-size]) * down[:len(body) - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` neighbours, by running minima from both ends of blocks of that size."""
    n = len(v)
    padded = np.full(-(-n // window) * window, _FULL, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - window + 1], ahead[window - 1:n])


def anchors(body: np.ndarray, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """place, hash, lo, hi of each anchor: the strings that start lo to hi bytes before it have it."""
    if len(body) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    h = gram_hashes(body, size)
    # The hash's high bits, then the place counted backwards: of equal hashes the last is least.
    back = np.uint64(_PLACE_MASK) - (np.arange(len(h), dtype=np.uint64) & np.uint64(_PLACE_MASK))
    least = _least(h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | back, length - size + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    place = (_PLACE_MASK - (least[first] & np.uint64(_PLACE_MASK)).astype(np.int64))
    place += first >> _PLACE_BITS << _PLACE_BITS
    place += np.where(place < first, 1 << _PLACE_BITS, 0)  # counted on beyond the bits of a place
    return place, h[place], place - last, place - first


def refined(blocks: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Blocks split by the next symbol of each suffix, in order; -1 for suffixes that are alone."""
    live = np.flatnonzero(blocks >= 0)
    out = np.full(len(blocks), -1, np.int64)
    if live.size:
        _, inverse, counts = np.unique(blocks[live] << 8 | symbols[live], return_inverse=True, return_counts=True)
        shared = counts > 1
        out[live] = np.where(shared, np.cumsum(shared) - 1, -1)[inverse]
    return out


def merged(gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, bytes_: list[bytes], length: int = LENGTH,
           size: int = GRAM) -> np.ndarray:
    """[suffix, l]: whether the string that starts l bytes before the suffix's anchor is a repeat among them.

    bytes_: the hi bytes before each anchor and the length - lo bytes from it on.
    """
    n, reach = len(gram), length - size
    body = np.zeros((n, reach + length), np.uint8)
    for i, b in enumerate(bytes_):
        body[i, reach - hi[i]:reach - hi[i] + len(b)] = np.frombuffer(b, np.uint8)
    _, start, counts = np.unique(gram, return_inverse=True, return_counts=True)
    start = np.where(counts[start] > 1, start, -1)
    right, kept = start, np.full((reach + 1, n), -1, np.int32)
    for depth in range(1, length + 1):  # one symbol a round, for blocks that several suffixes still share
        right = refined(np.where(length - lo >= depth, right, -1), body[:, reach + depth - 1].astype(np.int64))
        if depth >= size:
            kept[length - depth] = right
    left, found = start, np.zeros((n, reach + 1), bool)
    for l in range(reach + 1):
        if l:
            left = refined(np.where(hi >= l, left, -1), body[:, reach - l].astype(np.int64))
        rows = np.flatnonzero((lo <= l) & (l <= hi) & (left >= 0) & (kept[l] >= 0))
        if rows.size:
            _, inverse, counts = np.unique(left[rows] * (n + 1) + kept[l, rows], return_inverse=True, return_counts=True)
            found[rows[counts[inverse] > 1], l] = True
    return found


def _runs(found: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table, first and last byte (exclusive) that their repeats cover."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, place[row] - (high - 1), place[row] - low + length


_SPAN = "seal long, start long, stop long"


def _sampled(docs: DataFrame) -> DataFrame:
    """gram, seal, place of each anchor of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for seal, text in zip(batch.column("seal").to_pylist(), batch.column("text").to_pylist()):
                place, gram, _, _ = anchors(np.frombuffer(text.encode(), np.uint8))
                for column, values in zip(out, (gram.view(np.int64), np.full(len(place), seal), place)):
                    column.append(values)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["gram", "seal", "place"])

    return docs.select("seal", "text").mapInArrow(run, "gram long, seal long, place long")


def _contexts(hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """gram, seal, place, lo, hi, bytes of the suspects' anchors whose grams occur elsewhere, in hot grams or in others.

    What follows in the same task runs in the same worker: a second one a task would stay and keep its memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            rows: list[tuple] = []
            for seal, text, listed in zip(*(batch.column(c).to_pylist() for c in ("seal", "text", "places"))):
                body = text.encode()
                wanted = {x["place"] for x in listed if x["hot"] == hot}
                if not wanted:
                    continue
                for place, gram, lo, hi in zip(*(a.tolist() for a in _signed(anchors(np.frombuffer(body, np.uint8))))):
                    if place in wanted:
                        rows.append((gram, seal, place, lo, hi, body[place - hi:place - lo + LENGTH]))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                  names=["gram", "seal", "place", "lo", "hi", "bytes"])

    return run


def _signed(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return found[0], found[1].view(np.int64), *found[2:]


def _merge_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of contexts that come ordered by gram; whole grams are merged together, many at a time."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        gram, seal, place, lo, hi = (table.column(c).to_numpy() for c in ("gram", "seal", "place", "lo", "hi"))
        # A repeated row of the same id can bring a text twice; its anchors count once.
        _, once = np.unique(np.stack([gram, seal, place]), axis=1, return_index=True)
        bytes_ = table.column("bytes").take(pa.array(once)).to_pylist()
        row, start, stop = _runs(merged(gram[once], lo[once], hi[once], bytes_), place[once], LENGTH)
        return pa.record_batch([pa.array(seal[once][row]), pa.array(start), pa.array(stop)], names=["seal", "start", "stop"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _CHUNK:
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            whole = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if whole:
                yield out(table.slice(0, whole))
                held = table.slice(whole).to_batches()
    if held:
        yield out(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """one, two (hashes), seal, start of each string of the contexts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows: list[list] = [[], [], [], []]
            for seal, place, lo, hi, body in zip(*(part.column(c).to_pylist() for c in ("seal", "place", "lo", "hi", "bytes"))):
                for k in range(hi - lo + 1):
                    digest = hashlib.blake2b(body[k:k + LENGTH], digest_size=16).digest()
                    for column, value in zip(rows, (int.from_bytes(digest[:8], "little", signed=True),
                                                    int.from_bytes(digest[8:], "little", signed=True), seal, place - hi + k)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], names=["one", "two", "seal", "start"])


def repeats(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts: seal, text, spans of texts with repeats; copies: seal, other of texts that occur more than once).

    `docs` has doc_id, text, seal and other, two hashes of the text.
    """
    tagged = _sampled(docs).withColumn("tag", F.xxhash64("seal", "place"))
    several = saved(tagged.groupBy("gram").agg(F.min("tag").alias("low"), F.max("tag").alias("high"), F.count(F.lit(1)).alias("n"))
                    .filter("low < high").select("gram", (F.col("n") > hot).alias("hot")), "grams")
    places = (_sampled(docs).join(several, "gram").groupBy("seal")
              .agg(F.collect_set(F.struct("place", "hot")).alias("places")))
    shards = saved(docs.groupBy("seal", "other").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "shards")
    chosen = shards.select("seal", "first").join(places, "seal")
    suspects = saved(docs.join(chosen.hint("merge"), (docs["seal"] == chosen["seal"]) & docs["doc_id"].eqNullSafe(chosen["first"]))
                     .select(docs["seal"], "text", "places"), "suspects")
    listed, plain_of, hot_of = suspects.select("seal", "text", "places"), _contexts(False), _contexts(True)
    plain = (listed.mapInArrow(plain_of, "gram long, seal long, place long, lo long, hi long, bytes binary")
             .repartition("gram").sortWithinPartitions("gram").mapInArrow(_merge_tasks, _SPAN))
    counted = saved(listed.filter(F.exists("places", lambda x: x["hot"]))
                    .mapInArrow(lambda batches: _strings(hot_of(batches)), "one long, two long, seal long, start long"), "strings")
    often = saved(counted.withColumn("tag", F.xxhash64("seal", "start")).groupBy("one", "two")
                  .agg(F.min("tag").alias("low"), F.max("tag").alias("high")).filter("low < high").select("one", "two"), "often")
    many = counted.join(often, ["one", "two"]).select("seal", "start", (F.col("start") + LENGTH).alias("stop")).distinct()
    spans = plain.unionByName(many).groupBy("seal").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return suspects.select("seal", "text").join(spans.hint("merge"), "seal"), shards.filter("n > 1").select("seal", "other")


def joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Ordered spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for s in spans or []:
        start, stop = s["start"], s["stop"]
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def kept(text: str, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    body, parts, at = text.encode(), [], 0
    for start, stop in runs:
        parts.append(body[at:start])
        at = stop
    return b"".join([*parts, body[at:]])


def sealed(docs: DataFrame) -> DataFrame:
    """doc_id, text, seal, other."""
    return texts(docs).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("seal"),
                              F.xxhash64(F.lit("other"), "text").alias("other"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = sealed(docs)
    facts = saved(rows.select("doc_id", "seal", "other", F.octet_length("text").cast("bigint").alias("n_bytes"),
                              F.sha2("text", 256).alias("whole")), "facts")
    repeated, copies = repeats(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = [joined(s) for s in batch.column("spans").to_pylist()]
            digests = [hashlib.sha256(kept(t, r)).hexdigest() for t, r in zip(batch.column("text").to_pylist(), runs)]
            yield pa.record_batch([batch.column("seal"), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                                   pa.array([len(r) for r in runs], pa.int64()), pa.array(digests, pa.string())],
                                  names=["seal", "gone", "n", "rest"])

    cut = repeated.select("seal", "text", "spans").mapInArrow(run, "seal long, gone long, n long, rest string").dropDuplicates(["seal"])
    whole = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, some, none: F.when(whole, all_).otherwise(F.coalesce(some, none))
    return (facts.join(copies.withColumn("copied", F.lit(True)), ["seal", "other"], "left").join(cut, "seal", "left")
            .select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("gone"), F.lit(0)).alias("n_removed"),
                    pick(F.lit(1), F.col("n"), F.lit(0)).cast("bigint").alias("n_spans"),
                    pick(F.sha2(F.lit(""), 256), F.col("rest"), F.col("whole")).alias("kept_sha256")))


@keeping_columns
def cleaned(docs: DataFrame) -> DataFrame:
    """The same columns with the repeats cut out of every text; rows of which nothing is left go, others all stay.

    Where a cut goes through a character, its remaining bytes go too.
    """
    rows = sealed(docs)
    repeated, copies = repeats(rows)
    own = docs.withColumn("seal", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(
        "other", F.xxhash64(F.lit("other"), F.coalesce("text", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left = [kept(t, joined(s)).decode("utf-8", "ignore")
                    for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.record_batch([batch.column("seal"), pa.array(left, pa.string())], names=["seal", "left"])

    cut = repeated.select("seal", "text", "spans").mapInArrow(run, "seal long, left string").dropDuplicates(["seal"])
    facts = cut.join(copies.select("seal", F.col("other").alias("copied")).dropDuplicates(["seal"]), "seal", "full")
    marked = own.join(facts.hint("merge"), "seal", "left")
    text = F.when((F.col("copied") == F.col("other")) & (F.octet_length("text") >= LENGTH), F.lit("")).otherwise(F.coalesce("left", "text"))
    out = marked.withColumn("after", text).filter(~((F.col("after") == "") & (F.col("text") != "")) | F.col("text").isNull())
    return out.select(*[F.col("after").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
