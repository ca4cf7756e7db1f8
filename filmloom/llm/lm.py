"""Language-model scores from an Elias-Fano n-gram trie.

Word counts of the training texts are exact and complete, in a table of the shared folder. The frequent part of the model
is a trie of two levels: the most frequent words with their probabilities, and behind each of the first 65,536 words its
most frequent successors. Pointers between the levels and the successors' ids are monotone sequences in Elias-Fano form,
probabilities are codes into a quantised book, and a pair is found by a successor search relative to its context. The
file of the trie is bounded by `head` and `pairs`, is sent to the executors once and read there through a memory map.

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu)

Every pair counts, also one seen once or of rare words: those that are not in the trie are brought together with their
occurrences in all texts by a shuffle on the pair and counted there. So the bounds of the trie say only where a pair is
looked up. Each word and each end is followed by one token, so c(v) is the sum over all pairs of v and every context sums
to one. Words beyond the head are counted in the same way. The first word's context is the end of a text.

Rows: a null or empty text is its end token alone; null ids count as the empty id text; repeated rows count and are
scored row by row; texts are scored whole; without training rows every count is 0; further columns are not looked at.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmloom.llm.common import discarded, fold_of, fresh_name, let_go, portions, saved, slices, texts, worker_state

END = b" "  # no word holds a space
CONTEXTS = 1 << 16
HEAD = 1 << 18
PAIRS = 1 << 21
MU = 500.0
CODES = 4096
_FLUSH = 400_000
_TOKENS = 1 << 22


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, cumulative counts for selection."""

    def __init__(self, parts: dict[str, np.ndarray], low_bits: int, length: int):
        self.parts, self.low_bits, self.length = parts, low_bits, length

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            rest = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, rest << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1].astype(np.uint32)
        return cls({"low": low, "high": high, "before": before}, bits, n)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        word = np.searchsorted(self.parts["before"], i, "right") - 1
        rank = (i - self.parts["before"][word]).astype(np.int64)
        bits = self.parts["high"][word]
        place = np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the place of the rank-th one in a word, by halves
            half = np.bitwise_count((bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            later = half <= rank
            rank -= np.where(later, half, 0)
            place += np.where(later, width, 0)
        high = word.astype(np.int64) * 64 + place - i
        if not self.low_bits:
            return high
        at = i * self.low_bits
        first, shift = at >> 6, (at & 63).astype(np.uint64)
        low = self.parts["low"][first] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        low = np.where(over, low | (self.parts["low"][first + 1] << ((np.uint64(64) - shift) & np.uint64(63))), low)
        return high << self.low_bits | (low & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


def quantised(values: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """Codes and book: runs of equal numbers of different values share their mean."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(1)
    cut = np.unique(values)
    if len(cut) > codes:
        cut = cut[np.linspace(0, len(cut) - 1, codes).astype(np.int64)]
    code = np.searchsorted(cut, values, "right") - 1
    total, count = np.bincount(code, values, len(cut)), np.bincount(code, minlength=len(cut))
    return code.astype(np.uint16), total / np.maximum(count, 1)


class Trie:
    """Level 1: a code for each head word and a penalty for each context; level 2: successors and their codes."""

    def __init__(self, arrays: dict[str, np.ndarray], facts: dict):
        self.arrays, self.facts, self.decoded = arrays, facts, None
        part = lambda name: EliasFano({k: arrays[f"{name}.{k}"] for k in ("low", "high", "before")},
                                      facts[f"{name}.bits"], facts[f"{name}.length"])
        self.pointers, self.successors = part("pointers"), part("successors")

    @classmethod
    def build(cls, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, distinct: int,
              mu: float = MU, held: np.ndarray | None = None) -> Trie:
        """counts: of the head words by id; pairs: sorted context << 16 | word; held: C(v), else the sums of the pairs."""
        unigram = (counts + 1.0) / (total + distinct + 1.0)
        context, word = pairs >> 16, pairs & 0xFFFF
        starts = np.searchsorted(context, np.arange(CONTEXTS + 1))
        if held is None:
            held = np.bincount(context, pair_counts, CONTEXTS) if len(pairs) else np.zeros(CONTEXTS)
        joint = np.log10((pair_counts + mu * unigram[word]) / (held[context] + mu)) if len(pairs) else np.zeros(0)
        last = word[np.maximum(starts[1:] - 1, 0)] if len(pairs) else np.zeros(CONTEXTS, np.int64)
        lasts = np.where(starts[1:] > starts[:-1], last, 0)
        base = np.concatenate([[0], np.cumsum(lasts)])[:-1]  # makes the whole level one monotone sequence
        arrays, facts = {}, {}
        for name, values in (("pointers", starts), ("successors", word + base[context] if len(pairs) else word)):
            sequence = EliasFano.of(values)
            arrays |= {f"{name}.{k}": v for k, v in sequence.parts.items()}
            facts |= {f"{name}.bits": sequence.low_bits, f"{name}.length": sequence.length}
        for name, values in (("word", np.log10(unigram)), ("pair", joint), ("penalty", np.log10(mu / (held + mu)))):
            arrays[f"{name}.codes"], arrays[f"{name}.book"] = quantised(values)
        return cls(arrays, facts)

    def write(self, path: str) -> None:
        with open(path, "wb") as file:
            at, places = 0, {}
            for name, a in self.arrays.items():
                places[name] = [at, str(a.dtype), len(a)]
                at += a.nbytes + -a.nbytes % 8
            head = json.dumps({"places": places, "facts": self.facts}).encode()
            head += b" " * (-len(head) % 8)
            file.write(len(head).to_bytes(8, "little") + head)
            for a in self.arrays.values():
                file.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def map(cls, path: str) -> Trie:
        whole = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(whole[:8].tobytes(), "little")
        head = json.loads(whole[8:8 + size].tobytes())
        arrays = {}
        for name, (at, kind, n) in head["places"].items():
            start = 8 + size + at
            arrays[name] = whole[start:start + n * np.dtype(kind).itemsize].view(kind)
        return cls(arrays, head["facts"])

    def word(self, ids: np.ndarray) -> np.ndarray:
        return self.arrays["word.book"][self.arrays["word.codes"][ids]]

    def penalty(self, contexts: np.ndarray) -> np.ndarray:
        return self.arrays["penalty.book"][self.arrays["penalty.codes"][contexts]]

    def keys(self) -> np.ndarray:
        """The second level decoded, as sorted context << 16 | word: four bytes a pair, for a process that looks up many."""
        starts = self.pointers.get(np.arange(CONTEXTS + 1))
        out = np.empty(self.successors.length, np.uint32)
        context = np.repeat(np.arange(CONTEXTS, dtype=np.uint32), np.diff(starts))
        base = np.zeros(CONTEXTS, np.int64)
        if len(out):
            filled = np.flatnonzero(starts[1:] > starts[:-1])
            after = filled[filled > 0]
            before = starts[after]
            base[after] = np.where(before > 0, self.successors.get(np.maximum(before - 1, 0)), 0)
        for start in range(0, len(out), 1 << 16):
            part = context[start:start + (1 << 16)]
            words_ = self.successors.get(np.arange(start, start + len(part))) - base[part]
            out[start:start + len(part)] = part << np.uint32(16) | words_.astype(np.uint32)
        return out

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Places of the pairs (context << 16 | word) in the second level, -1 where a pair isn't kept.

        The level is decoded by the first call; a search step in the Elias-Fano form costs dozens of passes over the pairs.
        """
        if not self.successors.length:
            return np.full(len(pairs), -1, np.int64)
        if self.decoded is None:
            self.decoded = self.keys()
        wanted = pairs.astype(np.uint32)
        places = np.minimum(np.searchsorted(self.decoded, wanted), len(self.decoded) - 1)
        return np.where(self.decoded[places] == wanted, places, -1)

    def pair(self, places: np.ndarray) -> np.ndarray:
        return self.arrays["pair.book"][self.arrays["pair.codes"][places]]


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; bytes do exactly that."""
    return text.encode().lower().split()


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary), n of all training texts. Tasks add up what they read before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                    names=["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held.update(words(text))
                held[END] += 1
                if len(held) > _FLUSH:
                    yield from portions(out())
        if held:
            yield from portions(out())

    counted = training.select("text").mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The rows of the highest counts, as whole steps of a logarithmic histogram, `most` at most."""
    step = F.floor(64 * F.log2("n")).cast("int")
    counts = counted.filter(F.col("n") >= least).groupBy(step.alias("step")).count().collect()  # 4096 steps at most
    kept, floor = 0, None
    for row in sorted(counts, key=lambda r: -r["step"]):
        kept += row["count"]
        if kept > most:
            break
        floor = row["step"]
    return counted.filter((F.col("n") >= least) & (step >= floor if floor is not None else F.lit(False)))


class Head:
    """Ids of the head words, most frequent first."""

    def __init__(self, listed: bytes, counts: np.ndarray):
        self.ids = {END if w == b"" else w: i for i, w in enumerate(listed.split(b" "))} if len(counts) else {}
        self.counts, self.end = counts, self.ids.get(END, -1)
        self.trie: Trie | None = None

    def behind(self, path: str) -> Trie:
        """The trie of these words, mapped and decoded once in a process."""
        if self.trie is None:
            self.trie = Trie.map(path)
        return self.trie

    def sequence(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ids of all tokens with an end after each text, the ends' places, and the texts' words; -1 is not in the head."""
        split = [words(t) for t in texts_]
        get, end = self.ids.get, (self.end,)
        ids = np.array([i for ws in split for i in (*[get(w, -1) for w in ws], *end)], np.int64)
        return ids, np.cumsum([len(ws) + 1 for ws in split]) - 1, split

    def contexts(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = self.end
        return before


def head_of(name: str, head) -> Head:
    return worker_state(name, lambda: Head(*head.value))


def pair_counts(training: DataFrame, head, name: str) -> DataFrame:
    """pair (context << 16 | word), n of all training texts, for pairs of the first 65,536 words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head_of(name, head)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in slices(batches, limit=2 << 20):
            ids, ends, _ = known.sequence(batch.column("text").to_pylist())
            before = known.contexts(ids, ends)
            good = (ids >= 0) & (ids < CONTEXTS) & (before >= 0) & (before < CONTEXTS)
            held.append((before[good] << 16 | ids[good]).astype(np.uint32))
            if sum(map(len, held)) > _TOKENS:
                yield from portions(out())
        if held:
            yield from portions(out())

    return training.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _lists(ends: np.ndarray, at: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    """For each text that ends at one of `ends`, the rows of the columns that belong to its places among `at` (in order)."""
    stops = np.concatenate([[0], np.searchsorted(at, ends, "right")])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, head_words: int = HEAD, pairs: int = PAIRS,
          mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row, learnt from the other folds."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = texts(docs).select(F.col("doc_id").cast("bigint"), "text",
                              (fold_of("doc_id", folds) == held_out).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    vocabulary = saved(word_counts(training), "words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(vocabulary, head_words).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    discarded(vocabulary)
    # The end's own space would vanish among the separators, so it is written as the empty word.
    listed = b" ".join(b"" if w == END else w for w in top.column("word").to_pylist())
    counts = top.column("n").to_numpy().astype(np.float64)
    name = fresh_name("trie")
    head = context.broadcast((listed, counts))  # bounded by head_words
    often = saved(pair_counts(training, head, name).filter("n > 1"), "pairs")  # all others are counted below
    kept = most_frequent(often, pairs).toArrow().sort_by("pair")
    discarded(often)
    held = np.zeros(CONTEXTS)
    held[:len(counts)] = counts[:CONTEXTS]
    trie = Trie.build(counts, kept.column("pair").to_numpy(), kept.column("n").to_numpy(), total, distinct, mu, held)
    path = os.path.join(tempfile.mkdtemp(), name)
    trie.write(path)
    context.addFile(path)
    unseen = float(np.log10(1.0 / (total + distinct + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head_of(name, head)
        model = known.behind(SparkFiles.get(name))
        exact = np.log10(known.counts + 1.0) + unseen
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=2 << 20):
            ids, ends, split = known.sequence(batch.column("text").to_pylist())
            before = known.contexts(ids, ends)
            inside = ids >= 0
            base = np.zeros(len(ids))
            base[inside] = exact[ids[inside]]
            value = np.zeros(len(ids))
            value[inside] = model.word(ids[inside])
            after = before >= 0
            first = after & (before < CONTEXTS)
            value[first] += model.penalty(before[first])
            value[after & ~first] += np.log10(mu / (known.counts[before[after & ~first]] + mu))
            near = np.flatnonzero(first & inside & (ids < CONTEXTS))
            distinct_pairs, back = np.unique(before[near] << 16 | ids[near], return_inverse=True)
            places = model.find(distinct_pairs)[back]
            value[near[places >= 0]] = model.pair(places[places >= 0])
            starts = np.concatenate([[0], ends[:-1] + 1])
            open_ = inside & after
            tail = [(END if k == start else ws[k - start - 1], END if k == end else ws[k - start], k)
                    for start, end, ws in zip(starts.tolist(), ends.tolist(), split)
                    for k in (start + np.flatnonzero(~open_[start:end + 1])).tolist()]
            at = np.array([k for _, _, k in tail], np.int64)
            tails = _lists(ends, at, {
                "before": pa.array([v for v, _, _ in tail], pa.binary()), "word": pa.array([w for _, w, _ in tail], pa.binary()),
                "n": pa.array(known.counts[ids[at]].astype(np.int64) if len(known.counts) else np.zeros(len(at), np.int64),
                              mask=~inside[at])})
            open_[near[places >= 0]] = False
            at = np.flatnonzero(open_)
            stops = pa.array(np.concatenate([[0], np.searchsorted(at, ends, "right")]), pa.int32())
            pairs_ = pa.ListArray.from_arrays(stops, pa.array(before[at] << 32 | ids[at]))
            yield from portions(pa.record_batch(
                [pa.array(row + np.arange(len(ends))), batch.column("doc_id"), batch.column("held_out"),
                 pa.array(ends + 1 - starts), pa.array(np.add.reduceat(inside, starts, dtype=np.int64)),
                 pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(value, starts)), tails, pairs_],
                names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "tail", "pairs"]))
            row += len(ends)

    schema = ("row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, "
              "head_score double, tail array<struct<before: binary, word: binary, n: long>>, "
              "pairs array<long>")
    scored = saved(rows.mapInArrow(run, schema), "scored", "zstd")
    fold = (~F.col("held_out")).cast("int")
    # One number goes with each occurrence for its row and its fold; each is brought together by its word or pair.
    own = (2 * F.col("row") + fold).alias("marked")
    opened = lambda df: df.select("*", F.shiftright("marked", 1).alias("row"), F.col("marked").bitwiseAND(1).alias("trained"))
    tails = scored.select(own, F.inline("tail"))
    trained = lambda *by: F.sum("trained").over(Window.partitionBy(*by))

    def gain(*pair: str) -> Column:
        """What a pair adds to the log-probability of its word after a context in which it is not seen."""
        return F.log10(1 + trained(*pair) / (mu * (F.col("n") + 1.0) / (total + distinct + 1.0)))

    # All occurrences of a word beyond the head are here, so they give its count, and one shuffle on words serves both windows.
    rare = opened(tails.filter("n is null").select("marked", "before", "word").repartition("word")).withColumn("n", trained("word"))
    log = F.log10(F.col("n") + 1.0) + unseen
    rare = rare.select("row", (F.col("n") > 0).cast("bigint").alias("known"), log.alias("base"),
                       (log + F.log10(mu / (F.col("n") + mu)) + gain("word", "before")).alias("value"))
    zero = [F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base")]
    other = opened(tails.filter("n is not null").repartition("before", "word")).select("row", *zero, gain("before", "word").alias("value"))
    # Of a pair of head words, the word's count joins after the shuffle.
    marked = scored.select(own, F.explode("pairs").alias("pair")).repartition("pair")
    listed_counts = spark.createDataFrame(pa.table([pa.array(np.arange(len(counts))), pa.array(counts.astype(np.int64))], names=["word", "n"]),
                                          "word long, n long")  # bounded by head_words
    plain = (opened(marked).withColumn("seen", trained("pair")).withColumn("word", F.col("pair").bitwiseAND((1 << 32) - 1))
             .join(F.broadcast(listed_counts), "word")
             .select("row", *zero, F.log10(1 + F.col("seen") / (mu * (F.col("n") + 1.0) / (total + distinct + 1.0))).alias("value")))
    rest = rare.unionByName(other).unionByName(plain).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "base", "value")))
    known, base, value = (F.coalesce(F.col(c), F.lit(0)) for c in ("known", "base", "value"))
    return scored.drop("tail", "pairs").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + known).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), (F.col("head_base") + base).alias("base_score"),
        (F.col("head_score") + value).alias("score"))
