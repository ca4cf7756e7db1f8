"""Collocations against plain counting, and quotient filters against dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from filmloom.llm import collocations, quotient
from tests.llm.conftest import DOCS

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, best, share=50):
    """The contract's rows from (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rest)[:best], 1)]
    return out


def odd_rows():
    rng, rows = random.Random(6), []
    for _ in range(300):
        words = rng.choices(["The", "the", "of", "ÉTÉ", "été", "a\x0bb", "漢字", "x\x00y", "new", "york", "city", "\x1c", "..", "ab,cd", " z"], k=rng.randint(0, 40))
        rows.append((rng.choice(["en", "fr", None, "und", ""]), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows + [("en", None), (None, ""), ("en", "x" * 70_000 + " new york city" * 50), ("fr", "a a a a a a a a a a a a a a")] + [("de", "ganz selten")] * 9


@pytest.mark.parametrize("least, best, block_bytes, fan", [(10, 2000, 12 << 20, 256), (2, 2000, 3000, 256), (2, 5, 500, 3), (10, 3, 1, 4)])
def test_odd_rows_in_blocks_and_rounds(spark, least, best, block_bytes, fan):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, g, None, None, 0.5, "seal", None, "x", "y", None, 1, None) for i, (g, t) in enumerate(rows)], DOCS).repartition(4)
    got = collocations.mine(docs, least, best, block_bytes=block_bytes, fan=fan)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least, best))


def test_empty_tables_and_no_phrases(spark, nothing):
    assert collocations.mine(nothing).count() == 0
    few = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert collocations.mine(few).count() == 0


def test_scores_beyond_64_bits(spark):
    words = spark.createDataFrame([(1, "en", "p", 4 * 10**12), (2, "en", "q", 5 * 10**12 + 1)], "id int, lang string, word string, f long")
    found = spark.createDataFrame([(1, 2, None, 3 * 10**12 + 7)], "w1 int, w2 int, w3 int, a long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    row = collocations.scored(found, words, totals).collect()[0]
    assert row["score"] == 1_000_000 * (3 * 10**12 + 7) ** 2 // (4 * 10**12 * (5 * 10**12 + 1))


@pytest.mark.parametrize("width", [1, 2, 7, 17, 21, 22, 27, 32])
@pytest.mark.parametrize("places", [2, 3])
def test_filters_lose_nothing(width, places):
    rng = np.random.default_rng(width)
    for n in (0, 1, 6, 2500):
        words = [rng.integers(0, min(2 ** width, 60) if n == 6 else 2 ** width, n).astype(np.uint32) for _ in range(places)]
        keys = quotient.permuted(words, width)
        assert all((a == b).all() for a, b in zip(words, quotient.restored(keys, width, places)))
        keys, counts = quotient.folded(keys)
        want = Counter(zip(*[w.tolist() for w in words]))
        spelled = lambda k, c: dict(zip(zip(*[w.tolist() for w in quotient.restored(k, width, places)]), c.tolist()))
        assert spelled(keys, counts) == want
        counts = counts * rng.integers(1, 400, len(counts))
        want, bits, filters = spelled(keys, counts), width * places, []
        for prefix in (8, 16):
            filters = [(blob, range_) for range_, blob in quotient.cut(keys, counts, bits, prefix)]
            got = {}
            for blob, range_ in filters:
                got |= spelled(*quotient.unpacked(blob, range_, bits))
            assert got == want
        if filters:
            assert spelled(*quotient.merged(filters + filters, bits)) == {k: 2 * v for k, v in want.items()}


def test_filters_are_smaller_than_their_keys():
    rng = np.random.default_rng(1)
    keys, counts = quotient.folded(quotient.permuted([rng.integers(0, 1 << 17, 500_000) for _ in range(3)], 17))
    assert sum(len(b) for _, b in quotient.cut(keys, counts, 51, 8)) < 7 * len(counts)
