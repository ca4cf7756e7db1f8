"""SentencePiece BPE by prefix tables against the library and first principles."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from filmloom.llm import bpe, piece_bpe
from tests.llm.conftest import odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceCodec(piece_bpe.read_model(PATH), remembered=50)  # small, so that it forgets


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def random_texts(library):
    rng = random.Random(8)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    letters = [chr(i) for i in [*range(0x250), 0x200b, 0x2028, 0x3000, 0xfeff, 0xfffd, 0x1f600, 0x4e2d, 0x300, 0x10ffff]] + [" ", "  ", "\n", "▁", "."] * 30
    for _ in range(1500):
        yield "".join(rng.choices(letters, k=rng.randint(0, 25)))
        yield "".join(rng.choices(pieces, k=rng.randint(1, 10)))
        yield "".join(p.replace("▁", " ") for p in rng.choices(pieces, k=rng.randint(1, 10)))
        yield "".join(rng.choices(["e", "r", "er", "in", "the", "th", "an", "re"], k=rng.randint(1, 30)))
    for n in [*range(1, 40), 127, 128, 129, 5000]:
        yield " " * n
        yield "a" + " " * n + "b"
    yield from ["e" * 20_000, "ab\0" * 900, "<s></s><unk><0x41>", "\r\n\t"]


def test_codec_equals_the_library_on_random_texts(library, codec):
    for text in random_texts(library):
        want = library.encode(text)
        assert ids_of(codec, text) == want, repr(text)
        assert codec.decode(want) == library.decode(want)


def test_decoding_equals_the_library_on_any_ids(library, codec):
    rng = random.Random(9)
    kinds = [lambda: rng.randrange(32000), lambda: rng.randrange(3, 259), lambda: rng.choice([0, 1, 2, 259, 28705])]
    for _ in range(5000):
        ids = [rng.choice(kinds)() for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_pairs_stay_apart_as_the_merge_rules_say(codec):
    rng = random.Random(10)
    tokens = [k for k, ids in enumerate(codec.ids) if ids]
    close = [k for k in tokens if set(codec.text[k]) <= set("thein▁")]
    for a, b in [*((rng.choice(close), rng.choice(close)) for _ in range(4000)), *((rng.choice(tokens), rng.choice(tokens)) for _ in range(1000))]:
        merged = codec._merge(list(codec.text[a] + codec.text[b]))
        assert codec.fits[a * len(codec.text) + b] == (merged == [codec.text[a], codec.text[b]])


def test_each_prefix_ends_with_its_last_token(codec):
    for word in ("▁internationalization", "▁▁▁▁▁▁▁the", "strengths", "éééa"):
        for end, token in enumerate(codec.last_tokens(word)[1:], 1):
            assert codec.text[token] == codec._merge(list(word[:end]))[-1]


def test_round_trip_of_odd_rows(spark, odd, library):
    rows = bpe.digests(piece_bpe.round_trip(odd, PATH)).collect()
    assert Counter(rows) == Counter(bpe.digests(piece_bpe.decode(piece_bpe.round_trip(odd, PATH).select("doc_id", "ids"), PATH)).collect())
    want = Counter()
    for i, text in odd_texts():
        ids = library.encode(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want


def test_empty_tables(nothing):
    assert piece_bpe.round_trip(nothing, PATH).count() == 0


def test_models_of_other_kinds_are_refused():
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(piece_bpe.read_model(PATH))
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        piece_bpe.PieceCodec(proto.SerializeToString())
