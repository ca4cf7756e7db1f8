"""SentencePiece BPE by a table of the last token of every prefix.

Which token ends the encoding of a prefix is unique, and a token may follow another one exactly if the two, encoded
together, stay apart. So a text is read once: an automaton names all tokens that end at a place; the one that fits the
last token of the prefix before it is stored; from the end of the text, the ids are then read backwards.

Two tokens stay apart unless some merge crosses their border before one of the two border tokens is made. Undoing the
later made one of them, step by step, visits all candidates. That needs merges made in the order of their scores; where
scores tie (runs of spaces), the pair is merged by the rules themselves instead. Answers are remembered.

No token holds a space mark behind another letter, a closing mark behind a letter or digit, or a letter unknown to the
vocabulary (the first two are looked up in the vocabulary): these are certain cuts, so words are encoded one by one and
remembered. Unknown letters become the ids of their bytes.

Rows: a null text is the empty text and gives no ids; repeated rows and null ids give a row each; texts of any length
are encoded whole; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from filmloom.llm.common import Memory, slices, texts, worker_state

SPACE = "▁"  # Fixed value: how pieces write a space.
REMEMBERED = 600_000  # words of a worker
PAIRS = 2_000_000  # answers on pairs of tokens of a worker
_NEVER = 1 << 30
_MARKS = "!),.:;?]}"


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that is no UTF-8 becomes one U+FFFD."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("filmloom_each_byte", each_byte)


def read_model(path: str) -> bytes:
    """A vocabulary file is a parameter of some hundred kB that the driver reads and sends to the workers."""
    with open(path, "rb") as file:
        return file.read()


class Answers(dict):
    """Remembers answers of a function on numbers; starts anew when it is full."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: int):
        if len(self) >= self.most:
            self.clear()
        self[key] = answer = self.make(key)
        return answer


class PieceCodec:
    """Encoder and decoder of one model file of BPE pieces with byte fallback and without letter normalisation."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        rules = proto.normalizer_spec
        types = {p.type for p in proto.pieces}
        if (proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix
                or not types <= {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE} or kind.BYTE not in types):
            raise ValueError("needs BPE pieces with byte fallback, a space in front and no other normalisation")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.bytes = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        for byte, i in self.byte_ids.items():
            self.bytes[i] = bytes([byte])
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        for i, p in enumerate(proto.pieces):
            if p.type == kind.UNKNOWN:
                self.bytes[i] = proto.trainer_spec.unk_surface.encode()
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        self.rank = {p: order[proto.pieces[i].score] for p, i in normal.items()}
        self.spaced = {i for p, i in normal.items() if p[0] == SPACE}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in normal)
        letters = sorted({c for p in normal for c in p})
        inside = {b for p in normal for a, b in zip(p, p[1:]) if a.isalnum()}
        self.marks = "".join(c for c in letters if c in _MARKS and c not in inside)  # after a letter, a certain cut
        self.unknown = re.compile("([^" + "".join(map(re.escape, letters)) + "])")
        self._tokens(normal, letters)
        self.fits = Answers(self._fits, PAIRS)
        self.words = Memory(self._word, remembered)

    def _tokens(self, normal: dict[str, int], letters: list[str]) -> None:
        """Tokens that encode to themselves, their last merges, and the automaton that finds them."""
        shared: dict[int, int] = {}
        for r in self.rank.values():
            shared[r] = shared.get(r, 0) + 1
        self.text = [*letters, *sorted((p for p in normal if len(p) > 1), key=lambda p: (len(p), p))]
        number = {p: k for k, p in enumerate(self.text)}
        self.made = [-1] * len(self.text)  # rank of the merge that makes a token; letters are there from the start
        self.parts: list[tuple[int, int]] = [(0, 0)] * len(self.text)
        self.ordered = [True] * len(self.text)
        self.ids = [b""] * len(self.text)
        automaton = ahocorasick.Automaton()
        for k, piece in enumerate(self.text):
            if len(piece) > 1:
                left = self._merge(list(piece), stop=2)
                if len(left) != 2:
                    continue  # never a token of any text
                a, b = number[left[0]], number[left[1]]
                self.parts[k], self.made[k] = (a, b), self.rank[piece]
                self.ordered[k] = (self.ordered[a] and self.ordered[b] and shared[self.rank[piece]] == 1
                                   and max(self.made[a], self.made[b]) < self.rank[piece])
            ids = [normal[piece]] if piece in normal else [self.byte_ids[x] for x in piece.encode()]
            self.ids[k] = array("I", ids).tobytes()
            automaton.add_word(piece, (k, len(piece)))
        automaton.make_automaton()
        self.matches = automaton.iter

    def _merge(self, symbols: list[str], stop: int = 1) -> list[str]:
        """By the rules: the pair of best score merges first, the leftmost of equals, until `stop` symbols are left.

        With `stop` 2, fewer than two come back where the whole is never made of two.
        """
        rank = self.rank
        order = [rank.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while order and len(symbols) > stop:
            best = min(order)
            if best == _NEVER:
                return [] if stop > 1 else symbols
            i = order.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank.get(symbols[i - 1] + symbols[i], _NEVER)
            if i < len(order):
                order[i] = rank.get(symbols[i] + symbols[i + 1], _NEVER)
        return symbols

    def _fits(self, pair: int) -> bool:
        """Whether the second token may follow the first: encoded together, they stay apart."""
        left, right = divmod(pair, len(self.text))
        text, rank, made, parts = self.text, self.rank, self.made, self.parts
        if not (self.ordered[left] and self.ordered[right]):
            return self._merge(list(text[left] + text[right])) == [text[left], text[right]]
        before = _NEVER  # a crossing merge of lower rank would have come first
        while True:
            if rank.get(text[left] + text[right], _NEVER) < before:
                return False
            if made[left] > made[right]:
                before, left = made[left], parts[left][1]
            elif made[right] >= 0:
                before, right = made[right] + 1, parts[right][0]  # of equal ranks, the crossing one is further left
            else:
                return True

    def last_tokens(self, word: str) -> list[int]:
        """For each prefix of a word of known letters, the token that ends its encoding; -1 for the empty prefix."""
        last, fits, n = [-1] * (len(word) + 1), self.fits, len(self.text)
        for end, (token, size) in self.matches(word):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start or fits[last[start] * n + token]:
                    last[end] = token
        return last

    def _known(self, word: str) -> bytes:
        """Ids of a word of known letters, read from the end of its table of last tokens."""
        last, ids, text, at, out = self.last_tokens(word), self.ids, self.text, len(word), []
        while at:
            out.append(ids[last[at]])
            at -= len(text[last[at]])
        return b"".join(reversed(out))

    def _word(self, word: str) -> bytes:
        """Ids of a word: known letters by the table, unknown ones by their bytes."""
        parts = self.unknown.split(word)
        if len(parts) == 1:
            stem = word.rstrip(self.marks)
            if len(stem) < len(word) and stem[-1:].isalnum():
                return self.words[stem] + self.words[word[len(stem):]]
            return self._known(word)
        return b"".join(array("I", [self.byte_ids[x] for x in p.encode()]).tobytes() if k % 2 else self._part(p)
                        for k, p in enumerate(parts))

    def _part(self, part: str) -> bytes:
        """A part between unknown letters; remembered when it is a word of its own."""
        return self.words[part] if part else b""

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self._word(marked)
        if SPACE + SPACE in marked:
            return b"".join(map(self.words.__getitem__, re.findall(f"{SPACE}+[^{SPACE}]*", marked)))
        return b"".join(map(self.words.__getitem__, [SPACE + w for w in marked[1:].split(SPACE)]))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, without the space that was put in front; control ids give nothing."""
        if not self.silent.isdisjoint(ids):  # bytes on both sides of a control id are no letter together
            runs: list[list[int]] = [[]]
            for i in ids:
                runs[-1].append(i) if i not in self.silent else runs.append([])
            runs = [r for r in runs if r]
            return "".join(map(self._joined, runs))[runs[0][0] in self.spaced if runs else 0:]
        return self._joined(ids)[ids[0] in self.spaced if ids else 0:]

    def _joined(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "filmloom_each_byte")


def codec_of(model: bytes, remembered: int = REMEMBERED) -> PieceCodec:
    """One codec per worker and model."""
    return worker_state(f"pieces {len(model)} {zlib.crc32(model)} {remembered}", lambda: PieceCodec(model, remembered))


def round_trip(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids, text: each whole text's ids and the text that these ids give back."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value, remembered)
        for batch in slices(batches, limit=2 << 20):
            packed = list(map(codec.encode, batch.column("text").to_pylist()))
            back = [codec.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
            ends = np.cumsum([0, *(len(p) >> 2 for p in packed)], dtype=np.int64).astype("<i4")
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(back, pa.string())],
                                  names=["doc_id", "ids", "text"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the text of each row's ids; null ids give the empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                back = [codec.decode(i or []) for i in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(back, pa.string())],
                                      names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
