"""Secret scans by grammar inference.

Fixed patterns find the plain secrets of a text. Their values are labelled credentials: for each kind a prefix tree of
their symbol classes is built and its statistically compatible states are merged into a probabilistic automaton; three
more are inferred from ordinary runs: those without a digit, and short and long ones with a digit, so that rare sorts
are learnt too. Every run of six credential letters or more, words included, is then scored by how much likelier its
format is under a credential automaton than under any ordinary one, and likely ones are added as spans of kind `format`. A run that holds a pattern's span and more is scored whole,
and where that is not likely, in its parts outside the span. Patterns' own spans always stay.

The automata are fitted on at most `sample` different values of each kind and twice as many ordinary runs of each sort,
those of smallest hash among all; patterns and scoring cover all rows and whole texts, in two passes that shuffle samples alone.

Rows: a null or empty text has no spans; repeated rows and null ids give a row each; texts are scanned whole; with no
credential of a kind in the table that kind adds nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmloom.llm.common import Memory, fresh_name, keeping_columns, slices, texts, worker_state

# The three plain patterns, and the letters that runs of credentials consist of.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9]")
KINDS = ("assign", "access", "hex")
ADDED = "format"
ORDINARY = ("words", "short", "long")

SAMPLE = 2000
# A likely run is likelier by MARGIN a symbol and by EVIDENCE as a whole, so that a short one has to be clearer.
MARGIN = 0.25
EVIDENCE = 17 * MARGIN
REMEMBERED = 100_000
_CONFIDENCE = 0.05
_SMALL = 12
_LETTERS = string.digits + string.ascii_letters
_CLASSES = bytes.maketrans(_LETTERS.encode(), "".join(
    "d" if c.isdigit() else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if c.islower() else "U" for c in _LETTERS).encode())
_DIGIT = re.compile("[0-9]")
_SHAPE = re.compile(rb"[dhHlU][dhHlU+/_.=-]{4,}[dhHlU]")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the plain patterns, by start and then in the order of the kinds."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def runs(text: str, taken: list[tuple[int, int, str, str]]) -> Iterator[tuple[bool, tuple[int, int], list[tuple[int, int]]]]:
    """Every run of credential letters that is not inside a span: whether spans cut it, the run, its parts outside them."""
    k, last = 0, len(taken)
    for m in RUN.finditer(text):
        start, end = m.span()
        while k < last and taken[k][1] <= start:
            k += 1
        parts, at, j = [], start, k
        while j < last and taken[j][0] < end:
            parts += [p.span() for p in RUN.finditer(text, at, max(at, taken[j][0]))]
            at = max(at, taken[j][1])
            j += 1
        if j == k:
            yield False, (start, end), []
        elif at < end or taken[k][0] > start:
            yield True, (start, end), parts + [p.span() for p in RUN.finditer(text, at, max(at, end))]


def added(text: str, taken: list[tuple[int, int, str, str]], likely: Callable[[bytes], bool]) -> list[tuple[int, int]]:
    """The runs that are likely, each whole; of one that is not likely whole, the likely parts."""
    if not taken and not any(map(likely, set(_SHAPE.findall(shape_of(text))))):
        return []
    spans = []
    for _, whole, parts in runs(text, taken):
        if likely(shape_of(text[slice(*whole)])):
            spans.append(whole)
        else:
            spans += [p for p in parts if likely(shape_of(text[slice(*p)]))]
    return spans


def shape_of(value: str) -> bytes:
    """The symbol classes of a value, which are all that an automaton reads."""
    return value.encode().translate(_CLASSES)


class Automaton:
    """A probabilistic automaton: transition counts and end counts of each state."""

    def __init__(self, values: list[str]):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]
        for value in values:
            state = 0
            for symbol in shape_of(value):
                self.count[state][symbol] = self.count[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                state = self.next[state][symbol]
            self.ends[state] += 1
        self._merge()
        # The symbols of a state and of the whole automaton, for smoothing.
        self.all = {}
        for counts in self.count:
            for symbol, n in counts.items():
                self.all[symbol] = self.all.get(symbol, 0) + n
        self.total = sum(self.all.values())

    def _seen(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether ends and symbols of two states, and of their successors, differ no more than chance allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if min(n, m) < _SMALL:
                continue
            bound = math.sqrt(0.5 * math.log(2 / _CONFIDENCE)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / n - self.count[b].get(s, 0) / m) > bound:
                    return False
                if s in self.next[a] and s in self.next[b] and self.next[a][s] != self.next[b][s]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a tree of states to the state `into` and, symbol by symbol, to its successors."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for s, child in self.next[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + self.count[b][s]
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def _merge(self) -> None:
        """Settle states from the root outwards: each next one joins a settled state that it is alike, or settles."""
        settled, order = {0}, [0]
        while True:
            edge = next(((r, s) for r in order for s, t in sorted(self.next[r].items()) if t not in settled), None)
            if edge is None:
                return
            state, symbol = edge
            blue = self.next[state][symbol]
            red = next((r for r in order if self._alike(r, blue)), None)
            if red is None:
                settled.add(blue)
                order.append(blue)
            else:
                self.next[state][symbol] = red
                self._fold(red, blue)

        self.total = sum(self.all.values())

    def score(self, shape: bytes) -> float:
        """Mean log-likelihood of a symbol, the end included. Unseen steps fall back to the symbols of all states."""
        total, kinds, state, sum_ = self.total, len(self.all) + 1, 0, 0.0
        for symbol in shape:
            general = (self.all.get(symbol, 0) + 0.01) / (total + 0.01 * (kinds + 16))
            if state is None:
                sum_ += math.log(general)
                continue
            sum_ += math.log((self.count[state].get(symbol, 0) + general) / (self._seen(state) + 1))
            state = self.next[state].get(symbol)
        end = self.ends[state] / (self._seen(state) + 1) if state is not None else 0.0
        return (sum_ + math.log(end + 0.01)) / (len(shape) + 1)


class Formats:
    """Automata of the kinds and of ordinary runs, and each kind's least likely score.

    That is the score that all but one in fifty credentials of the kind reach under an automaton of the other half of them.
    """

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[list[str]]):
        self.kinds = {}
        for kind, values in credentials.items():
            if values:
                halves = values[::2], values[1::2]
                scores = sorted(automaton.score(shape_of(v)) for learnt, held in (halves, halves[::-1])
                                for automaton in [Automaton(learnt or held)] for v in held)
                self.kinds[kind] = (Automaton(values), scores[len(scores) // 50])
        self.ordinary = [Automaton(values) for values in ordinary if values]

    def likely(self, shape: bytes) -> bool:
        """Whether some kind's format explains the shape well, and better by the margins than ordinary runs do."""
        ahead = max(MARGIN, EVIDENCE / (len(shape) + 1))
        plain = max((a.score(shape) for a in self.ordinary), default=-math.inf)
        return any(s >= least and s - plain >= ahead
                   for s, least in ((a.score(shape), least) for a, least in self.kinds.values()))


class Smallest:
    """The `most` different values of smallest hash among those that are offered."""

    def __init__(self, most: int):
        self.most, self.bound, self.values = most, 1 << 32, set()

    def offer(self, value: str) -> None:
        if crc32(value.encode()) <= self.bound:
            self.values.add(value)
            if len(self.values) > 2 * self.most:
                self.kept()

    def kept(self) -> set[str]:
        ranked = sorted((crc32(v.encode()), v) for v in self.values)[:self.most]
        self.values = {v for _, v in ranked}
        if len(ranked) == self.most:
            self.bound = ranked[-1][0]
        return self.values


def _sort(value: str) -> str:
    if not _DIGIT.search(value):
        return "words"
    return "short" if len(value) < 16 else "long"


def _others(text: str, taken: list[tuple[int, int, str, str]]) -> set[str]:
    """The different runs, and parts of runs, that no span touches."""
    if not taken:
        return set(RUN.findall(text))
    free = [parts if cut else [whole] for cut, whole, parts in runs(text, taken)]
    return {text[slice(*c)] for candidates in free for c in candidates}


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """kind, value: each task's values of smallest hash, of credentials and of ordinary runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("secrets", dict)  # lets go of what earlier steps kept
        found = {**{k: Smallest(sample) for k in KINDS}, **{k: Smallest(2 * sample) for k in ORDINARY}}
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for _, _, kind, value in spans:
                    found[kind].offer(value)
                for value in _others(text, spans):
                    found[_sort(value)].offer(value)
        for kind, values in found.items():
            kept = sorted(values.kept())
            yield pa.record_batch([pa.array([kind] * len(kept), pa.string()), pa.array(kept, pa.string())], names=["kind", "value"])

    return texts(docs).select("text").mapInArrow(run, "kind string, value string")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from the values of smallest hash of each kind, and from twice as many ordinary runs of each sort."""
    order = Window.partitionBy("kind").orderBy(F.crc32("value"), "value")
    most = F.when(F.col("kind").isin(*ORDINARY), 2 * sample).otherwise(sample)
    ranked = sampled(docs, sample).distinct().withColumn("rank", F.row_number().over(order))
    rows = ranked.filter((F.col("rank") <= 2 * sample) & (F.col("rank") <= most)).select("kind", "value").collect()
    values = {k: sorted(r["value"] for r in rows if r["kind"] == k) for k in (*KINDS, *ORDINARY)}
    return Formats({k: values[k] for k in KINDS}, [values[k] for k in ORDINARY])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, spans: array of (start, end, kind, base), by start and then in the order of the kinds."""
    model, name = docs.sparkSession.sparkContext.broadcast(fit(docs, sample)), fresh_name("formats")  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = worker_state(name, lambda: Memory(model.value.likely, REMEMBERED))
        order = {k: i for i, k in enumerate((*KINDS, ADDED))}
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = [(start, end, kind, True) for start, end, kind, _ in base]
                spans += [(start, end, ADDED, False) for start, end in added(text, base, likely.__getitem__)]
                spans.sort(key=lambda s: (s[0], order[s[2]]))
                out.append([dict(zip(("start", "end", "kind", "base"), s)) for s in spans])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<start: int, end: int, kind: string, base: boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text), n_format."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"), count(ADDED).alias("n_format"))


@keeping_columns
def redacted(docs: DataFrame, sample: int = SAMPLE, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of a text replaced by the mark; a null text stays null."""
    model, name = docs.sparkSession.sparkContext.broadcast(fit(docs, sample)), fresh_name("formats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = worker_state(name, lambda: Memory(model.value.likely, REMEMBERED))
        at = None
        for batch in slices(batches):
            at = batch.schema.get_field_index("text") if at is None else at
            out = [None if t is None else _masked(t, likely.__getitem__, mark) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(at, pa.field("text", pa.string())))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, likely: Callable[[str], bool], mark: str) -> str:
    base = base_spans(text)
    cuts = [(s[0], s[1]) for s in base] + added(text, base, likely)
    out, done = [], 0
    for start, end in sorted(cuts):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])
