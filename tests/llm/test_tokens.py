"""BPE and packing against the tokenizers library and first principles."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filmloom.llm import bpe, packing
from tests.llm.conftest import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary_text(PATH), remembered=50)  # small, so that it forgets


def test_codec_equals_the_library_on_random_texts(library, codec):
    rng = random.Random(3)
    letters = [chr(i) for i in [*range(0x250), 0x1680, 0x180e, 0x200b, 0x2028, 0x3000, 0xfeff, 0x1f600, 0x4e2d, 0x300, 0x660, 0xbd]]
    letters += ["  ", " ", "\n", "<|endoftext|>", "'s", "'ll", "."] * 30
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(5000)]
    texts += ["a" * 3000, "ab" * 2000 + " " + "é" * 500, "", " ", "\x1c x", "a \x1c b"]
    for text, packed in zip(texts, codec.encode_all(texts)):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_never_inside_a_token(codec):
    for token in codec.tokens[:50_000:7]:
        assert codec.fragments(token) == [token]
    assert len(codec.fragments("qé→z".encode())) > 1


def test_long_fragments_merge_like_short_ones(codec):
    rng = random.Random(1)
    for _ in range(300):
        body = "".join(rng.choices("thean ", k=rng.randint(2, 45))).encode()
        assert codec.merge(body) == codec._merge_long([codec.byte_ids[b] for b in body])


def test_round_trip_of_odd_rows(spark, odd, library):
    rows = bpe.digests(bpe.round_trip(odd, PATH)).collect()
    assert Counter(rows) == Counter(bpe.digests(bpe.decode(bpe.encode(odd, PATH), PATH)).collect())
    want = Counter()
    for i, text in odd_texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want


def test_empty_tables(nothing):
    assert bpe.digests(bpe.decode(bpe.encode(nothing, PATH), PATH)).count() == 0
    assert packing.packed(nothing, PATH).count() == 0


@pytest.mark.parametrize("capacity", [7, 30, 1024])
def test_plans_use_every_piece_once_and_few_sequences(capacity):
    rng = random.Random(capacity)
    for size in (0, 1, 5, 60, 3000):
        counts = Counter(rng.randint(1, capacity) for _ in range(size))
        plan, got = packing.plan(counts, capacity), Counter()
        for times, held in plan:
            assert times > 0 and sum(n * k for n, k in held) <= capacity
            assert sum(k for n, k in held if 3 * n > capacity) <= 2
            for n, k in held:
                got[n] += times * k
        assert got == counts
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert sum(t for t, _ in plan) <= 1.25 * least + 1


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packed_odd_rows(spark, odd, library, capacity):
    rows = packing.packed(odd, PATH, capacity).collect()
    tokens = defaultdict(list)
    for i, text in odd_texts():
        tokens[i].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    want = Counter()
    for i, lists in tokens.items():
        for ids in lists:
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
