"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (digits or signs for letters, letters repeated, letters set apart) is a lattice of
characters: each sign may stand for its letters, be dropped, or be meant; each run of a letter may be one or two of it.
A Viterbi search over the lattice under a character language model restores the likeliest word. The restored text is
scored by a logistic model over counts of words and word beginnings.

The character model counts all texts of the table (four characters of a 28-letter alphabet, so its size is fixed) and
gives the words that mark toxic labels a share of their own. Labels are learnt from a bounded sample, the labelled rows
of smallest hash outside the held-out fold; scores use the text alone.

Rows: null and empty texts get the score of a text without words; repeated rows and null ids give a row each; texts are
scored whole; null labels teach nothing; with labels of one class or none, every score is the share of toxic labels
(0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from filmloom.llm.common import Memory, fold_of, fresh_name, saved, slices, texts, worker_state

SAMPLE = 20_000
FEATURES = 400
SHARE = 0.02  # of the character model, for the words that mark toxic labels
_LETTERS = 28  # 0: no letter, 1 to 26: a to z, 27: any other letter
_REMEMBERED = 150_000

# What signs may stand for, and signs that may only set letters apart.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
APART = ".-_*~'`^/\\"
NEVER_LAST = "@$€£"  # seldom written behind a word for their own sake
_TRIM = re.compile(r"^[^\w@$!|+(€£]+|(?:(?![@$!|+(€£])[\W_])+$")  # plain punctuation: signs at the ends may be letters
_ODD = re.compile(r"[^\W\d_][^\w\s]|[^\W_]_|[^\W\d_]\d|\d[^\W\d_]|[@$!|+(€£][^\W\d_]|([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1+")
_SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
_WORD = re.compile(r"[^\W\d_]+")


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point."""
    return np.fromiter((_symbol(chr(c)) for c in range(0x110000)), np.int8, 0x110000)


def spelt(text: str) -> np.ndarray:
    """The symbols of a text's characters, in lower case."""
    return _symbols()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)].astype(np.int64)


class CharacterModel:
    """Probabilities of a character after up to three, by interpolation of the four orders."""

    def __init__(self, counts: np.ndarray, own_words: list[str] = ()):
        table = counts.reshape((_LETTERS,) * 4).astype(float)
        if own_words:
            own = np.zeros_like(table)
            for word in own_words:
                s = [0, 0, 0, *map(_symbol, word), 0]
                for i in range(len(s) - 3):
                    own[tuple(s[i:i + 4])] += 1
                    own[(*s[i:i + 3][-3:], s[i + 3])] += 0
            table += own * (SHARE * max(table.sum(), 1.0) / own.sum())
        lower = np.full(_LETTERS, 1.0 / _LETTERS)
        self.orders = []
        for n in range(1, 5):
            part = table.sum(axis=tuple(range(4 - n))) if n < 4 else table
            seen, kinds = part.sum(-1, keepdims=True), (part > 0).sum(-1, keepdims=True)
            lower = (part + kinds * lower) / np.maximum(seen + kinds, 1) + np.where(seen == 0, lower, 0)
            self.orders.append(np.log(np.maximum(lower, 1e-12)))

    def step(self, history: tuple[int, ...], symbol: int) -> float:
        """Log-probability of a symbol; what lies before a word's start is unknown."""
        return float(self.orders[len(history)][(*history, symbol)])


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Options (text, log-probability of the disguise) for each run of equal characters."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c in SIGNS:
            options = [(c * n, -1.5)] + [(x * k, -1.0 - (n != k)) for x in SIGNS[c] for k in range(1, min(n, 2) + 1)]
            if not c.isdigit():
                options.append(("", -2.0))
            if c in NEVER_LAST and 0 < m.start() and m.end() == len(token):
                options = [(x, cost if x.isalpha() else -5.0) for x, cost in options]
        elif c in APART or c == " ":
            options = [(c, -0.5), ("", -1.0)]
        elif c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, -1.0)] if n == 2 else [(c, -0.5), (c * 2, -0.5)]
        else:
            options = [(c, 0.0)]
        out.append(options)
    return out


def restore(token: str, model: CharacterModel) -> str:
    """The likeliest reading of a token: Viterbi over the last three symbols, from a word's start to its end."""
    best: dict[tuple[int, ...], tuple[float, tuple]] = {(0,): (0.0, ())}
    for options in lattice(token):
        after: dict[tuple[int, ...], tuple[float, tuple]] = {}
        for history, (value, path) in best.items():
            for text, cost in options:
                total, h = value + cost, history
                for c in text:
                    s = _symbol(c)
                    if s or h[-1]:  # what follows a word's end is a start again
                        total += model.step(h, s)
                        h = (*h, s)[-3:] if s else (0,)
                if h not in after or total > after[h][0]:
                    after[h] = (total, (path, text))
        best = after
    value, path = max(((v + (model.step(h, 0) if h[-1] else 0.0), p) for h, (v, p) in best.items()), key=lambda x: x[0])
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


class Restorer:
    """Restores the words of texts, remembering a bounded number of tokens.

    `marks` are the features that matter: a word with doubled letters and no other sign of a disguise is decoded if it is
    one of them, or begins like one, when the doubling is taken from both. No other reading of it can have a feature.
    """

    def __init__(self, model: CharacterModel | None, marks: Iterable[str] = ()):
        self.model, self.known = model, Memory(self.words, _REMEMBERED)
        single = [_DOUBLE.sub(r"\1", f) for f in marks]
        self.whole = frozenset(f[:-1] for f in single if f.endswith("$"))
        self.starts = frozenset(f for f in single if not f.endswith("$"))
        self.lengths = sorted({len(f) for f in self.starts})

    def odd(self, core: str) -> bool:
        if " " in core or _ODD.search(core):
            return True
        return bool(self.whole or self.starts) and bool(_DOUBLE.search(core)) and any(map(self.meant, _WORD.findall(core)))

    def meant(self, word: str) -> bool:
        """Whether a word without its doubling is, or begins like, a feature without its own."""
        word = _DOUBLE.sub(r"\1", word)
        return word in self.whole or any(word[:n] in self.starts for n in self.lengths)

    def words(self, token: str) -> list[str]:
        core = _TRIM.sub("", token)
        if self.model is not None and self.odd(core):
            core = restore(core, self.model)
        return _WORD.findall(core)

    def tokens(self, text: str) -> Counter:
        """How often each token occurs, runs of single characters as tokens of their own besides."""
        text = text.lower()
        tokens = Counter(text.split())
        if self.model is not None:
            for m in _SPACED.finditer(text):
                parts = m[0].split(" ")
                if sum(map(str.isalpha, parts)) * 2 > len(parts):
                    tokens[m[0]] += 1
        return tokens

    def text(self, text: str) -> str:
        """The text, lower-cased, with its disguised tokens restored."""
        joined = _SPACED.sub(lambda m: " ".join(self.words(m[0])), text.lower())
        return re.sub(r"\S+", lambda m: " ".join(self.known[m[0]]) if self.odd(_TRIM.sub("", m[0])) else m[0], joined)


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [f"{word}$", *(word[:n] for n in range(4, min(len(word), 8) + 1))]


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of four characters over all texts."""
    size = _LETTERS ** 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, limit=1 << 20):
            s = spelt(f"   {' '.join(batch.column('text').to_pylist())} ")
            total += np.bincount(((s[:-3] * _LETTERS + s[1:-2]) * _LETTERS + s[2:-1]) * _LETTERS + s[3:], minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = texts(docs).select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return counts


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 400) -> np.ndarray:
    """Weights of a ridge logistic model by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 0
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(x.T @ (x @ v)) + penalty)
    w = z = np.zeros(x.shape[1])
    for k in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y) + keep * z
        new = z - rate * g
        z = new + k / (k + 3) * (new - w)
        w = new
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """doc_id, text, y of at most `sample` labelled rows outside the held-out fold: those whose id has the least hash."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
             .filter(fold_of("doc_id", folds) != held_out).filter(F.col("doc_id").isNotNull())
             .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))
    return texts(docs).join(F.broadcast(known), "doc_id")  # bounded by the sample


class Model:
    """What a score needs: the character model, the features' places and their weights."""

    def __init__(self, characters: CharacterModel | None, places: dict[str, int], weights: np.ndarray):
        self.characters, self.places, self.weights = characters, places, weights

    def reader(self) -> tuple[Restorer, Memory]:
        """A restorer and its memory of tokens: how many words a token holds and the places of their features."""
        restorer = Restorer(self.characters, self.places)

        def read(token: str) -> tuple[int, tuple[int, ...]]:
            words = restorer.words(token)
            return len(words), tuple(self.places[f] for w in words for f in features(w) if f in self.places)

        return restorer, Memory(read, _REMEMBERED)

    def vector(self, text: str, restorer: Restorer, memory: Memory) -> np.ndarray:
        x = np.zeros(len(self.places) + 1)
        total = 0
        for token, n in restorer.tokens(text).items():
            words, places = memory[token]
            total += words * n
            for k in places:
                x[k] += n
        x[-1] = total
        return np.log1p(x)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE,
        most: int = FEATURES) -> Model:
    """Features by their log-odds in the labelled sample, the character model, then weights on restored words."""
    rows = saved(training_rows(docs, labels, "toxic", folds, held_out, sample), "labelled")
    size = dict(rows.groupBy("y").count().collect())
    n = [size.get(0, 0), size.get(1, 0)]
    if not (n[0] and n[1]):
        share = n[1] / sum(n) if sum(n) else 0.0
        prior = math.log(share / (1 - share)) if 0 < share < 1 else 40.0 if share else -40.0
        return Model(None, {}, np.array([0.0, prior]))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Restorer(None)
        for batch in slices(batches, limit=2 << 20):
            held: list[Counter] = [Counter(), Counter()]
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                held[y].update({f for token in plain.tokens(text) for w in plain.known[token] for f in features(w)})
            names = list(held[0].keys() | held[1].keys())
            yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([h[f] for f in names], pa.int64()) for h in held)],
                                  names=["feature", "clean", "toxic"])

    found = (rows.select("text", "y").mapInArrow(seen, "feature string, clean long, toxic long").groupBy("feature")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= 4))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (found.withColumn("z", odds / error).filter((F.col("z") > 2.5) & (odds > 0.7))
            .orderBy(F.desc("z"), "feature").limit(most).collect())
    marks = [r["feature"][:-1] for r in best if r["feature"].endswith("$") and r["clean"] * n[1] * 10 < r["toxic"] * n[0]]
    characters = CharacterModel(character_counts(docs), marks)
    places = {r["feature"]: i for i, r in enumerate(best)}
    model = Model(characters, places, np.zeros(len(places) + 2))
    sent, name = docs.sparkSession.sparkContext.broadcast(model), fresh_name("toxicity")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = _worker(name, sent)
        for batch in slices(batches, limit=2 << 20):
            x = [sent.value.vector(t, restorer, memory).astype(np.float32).tobytes()
                 for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array(x, pa.binary())], names=["y", "x"])

    table = rows.select("text", "y").mapInArrow(vectors, "y int, x binary").toArrow()  # bounded by sample and features
    x = np.array([np.frombuffer(b, np.float32) for b in table.column("x").to_pylist()], float)
    model.weights = logistic(x, table.column("y").to_numpy().astype(float))
    return model


def _worker(name: str, sent) -> tuple[Restorer, Memory]:
    """The restorer and the memory of this worker for one model."""
    return worker_state(name, lambda: sent.value.reader())


def scored(docs: DataFrame, model: Model, columns: list[str], as_: str = "score") -> DataFrame:
    """The named columns of each row and its score, as a column of the given name."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), fresh_name("toxicity")
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(as_, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = _worker(name, sent)
        known, w = sent.value, sent.value.weights
        for batch in slices(batches, limit=2 << 20):
            x = np.array([known.vector(t or "", restorer, memory) for t in batch.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(p)], names=[*columns, as_])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, restored: the texts in lower case with their disguised words written out."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), fresh_name("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, _ = _worker(name, sent)
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(restorer.text, batch.column("text").to_pylist()), pa.string())],
                                  names=["doc_id", "restored"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, restored string")


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, folds, held_out)
    rows = texts(docs).select(F.col("doc_id").cast("bigint"), "text", (fold_of("doc_id", folds) == held_out).alias("held_out"))
    return scored(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
