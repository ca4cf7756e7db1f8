"""Byte-level BPE by forced-boundary splitting.

A merge across the bytes (x, y) makes a token that holds x next to y. A pair that occurs inside no token of the
vocabulary is therefore never merged across: it marks a certain cut. A text is cut at the vocabulary's word pattern and
then at all certain cuts; the fragments are encoded one by one, remembered, and their ids are concatenated.

Rows: a null text is the empty text and gives no ids; repeated rows and null ids give a row each; texts of any length
are encoded whole; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from filmloom.llm.common import Memory, slices, texts, worker_state

# Fixed value: the word pattern of the byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_DOUBLE_SPACE = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
_LIST_LIMIT = 48
REMEMBERED = 700_000  # chunks of a worker, some 150 MB; fewer words and fragments


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = {}, 256
    for byte in range(256):
        letters[chr(byte if byte in visible else spare)] = byte
        spare += byte not in visible
    return letters


class Codec:
    """Encoder and decoder of one vocabulary file. It remembers words and fragments, each up to a bound."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        spec = json.loads(spec)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.byte_ids = [0] * 256
        for token, i in vocabulary.items():
            if len(token) == 1:
                self.byte_ids[letters[token]] = i
        self.merged: list[int] = []
        self.ranks: list[dict[int, int]] = [{} for _ in self.tokens]  # by the left token, of each right one
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocabulary[left]][vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        pairs = [(a, b) for a in self.byte_ids for b in self.byte_ids]
        self.first = {(a, b): self.ranks[a].get(b, len(self.merged)) for a, b in pairs}  # before any merge
        self.joined = [bytearray(256) for _ in range(256)]  # 1 where the byte pair occurs inside a token
        for token in self.tokens:
            for a, b in zip(token, token[1:]):
                self.joined[a][b] = 1
        self.close = frozenset((a, b) for a in range(256) for b in range(256) if self.joined[a][b])
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = Memory(self._piece, remembered // 7)
        self.chunks = Memory(self._spaced, remembered * 10 // 7)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut wherever no token of the vocabulary could hold both neighbours."""
        if self.close.issuperset(zip(piece, piece[1:])):
            return [piece]
        joined, start, out = self.joined, 0, []
        for i, (a, b) in enumerate(zip(piece, piece[1:]), 1):
            if not joined[a][b]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the pair of least rank merges first, the leftmost of equals."""
        byte_ids = self.byte_ids
        ids = list(map(byte_ids.__getitem__, fragment))
        if len(ids) > _LIST_LIMIT:
            return self._merge_long(ids)
        ranks, merged, none = self.ranks, self.merged, len(self.merged)
        order = list(map(self.first.__getitem__, zip(ids, ids[1:])))
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            ids[i] = new = merged[best]
            del order[i], ids[i + 1]
            if i:
                order[i - 1] = ranks[ids[i - 1]].get(new, none)
            if i < len(order):
                order[i] = ranks[new].get(ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for fragments whose length would make list edits slow."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ranks[ids[i]].get(ids[j]) != rank:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := ranks[ids[a]].get(ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a word: of its fragments, one after the other."""
        fragments = self.fragments(piece)
        if len(fragments) == 1:
            return array("I", self.merge(piece)).tobytes()
        return b"".join([self.pieces[f] for f in fragments])

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a chunk with the space before it. Letters, and then marks, are two words of the pattern; no need to ask it."""
        letters = chunk.rstrip(_MARKS)
        if not letters.isalpha():
            return self._chunk(" " + chunk)
        if len(letters) < len(chunk):
            return self.chunks[letters] + self.pieces[chunk[len(letters):].encode()]
        return self._piece(b" " + letters.encode())  # remembered as a chunk, and nowhere else

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p.encode()] for p in WORDS.findall(chunk)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A lone space between two visible characters always starts a word."""
        first, *chunks = _LONE_SPACE.split(text) if _DOUBLE_SPACE.search(text) else text.split(" ")
        return self._chunk(first) + b"".join(map(self.chunks.__getitem__, chunks))

    def encode_all(self, texts_: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit numbers. A special token's own string is that token."""
        if self.split is None or not any(map(self.split.search, texts_)):
            return list(map(self._plain, texts_))
        parts, owners = [], []
        for i, text in enumerate(texts_):
            start = 0
            for m in self.split.finditer(text):
                parts += [text[start:m.start()], m[0]]
                owners += [i, i]
                start = m.end()
            parts.append(text[start:])
            owners.append(i)
        out: list[list[bytes]] = [[] for _ in texts_]
        for i, p in zip(owners, parts):
            out[i].append(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p))
        return list(map(b"".join, out))

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def codec_of(spec: str, remembered: int = REMEMBERED) -> Codec:
    """One codec per worker and vocabulary."""
    return worker_state(f"codec {len(spec)} {zlib.crc32(spec.encode())} {remembered}", lambda: Codec(spec, remembered))


def vocabulary_text(path: str) -> str:
    """A vocabulary file is a parameter of a few MB that the driver reads and sends to the workers."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each whole text, one row per row."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in slices(batches, limit=2 << 20):
            packed = codec.encode_all(batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(p) >> 2 for p in packed)], dtype=np.int64).astype("<i4")
            values = pa.py_buffer(b"".join(packed))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, values]))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), ids], names=["doc_id", "ids"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: each whole text's ids and the text that these ids give back, by one worker a task."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in slices(batches, limit=2 << 20):
            packed = codec.encode_all(batch.column("text").to_pylist())
            ids = [np.frombuffer(p, "<u4") for p in packed]
            back = [codec.decode(i.tolist()) for i in ids]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype("<i4")
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(back, pa.string())],
                                  names=["doc_id", "ids", "text"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the text of each row's ids; null ids give the empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                back = [codec.decode(i or []) for i in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(back, pa.string())],
                                      names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded rows."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2(F.col("text"), 256).alias("decoded_sha256"))
