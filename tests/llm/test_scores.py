"""Toxicity, quality and language-model scores: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from filmloom.llm import common, lm, quality, toxicity
from tests.llm.conftest import DOCS, LABELS, odd_texts, words

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    assert accuracy(toxicity.score(docs, labels), labels, "toxic") > 0.9
    assert accuracy(quality.score(docs, labels), labels, "quality") > 0.95


def test_rules_as_a_column_and_by_hand(spark, tables):
    """The compiled expression against the rules read one by one over the same statistics, and the folds and cut."""
    docs, labels = tables
    measured = quality.statistics(docs)
    rules = quality.fit(measured, labels)
    assert len(rules.weighted) > 3
    rows = measured.toPandas().sort_values("doc_id")
    total = np.full(len(rows), rules.intercept)
    for weight, rule in rules.weighted:
        holds = np.ones(len(rows), bool)
        for name, bound, below in rule:
            holds &= (rows[name] <= bound).to_numpy() if below else (rows[name] > bound).to_numpy()
        total += weight * holds
    got = quality.score(docs, labels).toPandas().sort_values("doc_id")
    assert got["doc_id"].tolist() == rows["doc_id"].tolist()
    assert np.allclose(got["score"], 1 / (1 + np.exp(-total)), atol=1e-9)
    assert got["held_out"].tolist() == [fold(i, 5) == 0 for i in got["doc_id"]]
    assert got["predicted"].tolist() == (got["score"] >= 0.3).astype(int).tolist()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows_and_missing_labels(spark, odd, nothing, no_labels, module):
    rows = module.score(odd, no_labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in odd_texts())
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, None, None, None), (None, 0, 1, ""), (9, 0, 1, ""), (9, 0, 1, "")], LABELS)
    assert module.score(odd, labels).count() == len(odd_texts())
    assert module.score(nothing, labels).count() == 0
    assert module.score(nothing, no_labels).count() == 0


def test_disguised_words_are_restored():
    text = "the idiot and the moron are stupid trash in the house of the other man "
    model = character_model(text, ["idiot", "moron", "stupid", "trash"])
    for disguised, plain in {"1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "$tupid": "stupid", "stuuupid": "stupid",
                             "tr@sh": "trash", "m.o.r.o.n": "moron", "idioot": "idiot", "10.2": "10.2", "house": "house"}.items():
        assert toxicity.restore(disguised, model) == plain, disguised


def character_model(text, own):
    s = toxicity.spelt("   " + text * 50)
    counts = np.bincount(((s[:-3] * 28 + s[1:-2]) * 28 + s[2:-1]) * 28 + s[3:], minlength=28 ** 4)
    return toxicity.CharacterModel(counts, own)


def test_viterbi_finds_the_best_of_all_readings():
    """Against every path of the lattice, with letters beyond ASCII, signs at both ends and letters set apart."""
    model = character_model("the idiot and the moron are stupid trash, émile идиот in the house of the other man ", ["idiot", "идиот"])

    def value(path):
        total, history = 0.0, (0,)
        for text, cost in path:
            total += cost
            for c in text:
                symbol = toxicity._symbol(c)
                if symbol or history[-1]:
                    total += model.step(history, symbol)
                    history = (*history, symbol)[-3:] if symbol else (0,)
        return total + (model.step(history, 0) if history[-1] else 0.0)

    rng = random.Random(8)
    tokens = ["1d10t", "!d!0t", "$tup1d", "i d i o t", "m.0.r", "ид1от", "éé", "a$$", "10.2", "...", "0"]
    tokens += ["".join(rng.choices("aiotéи10!$|. ", k=rng.randint(1, 7))) for _ in range(120)]
    for token in tokens:
        values = {}
        for path in itertools.product(*toxicity.lattice(token)):
            text = "".join(t for t, _ in path)
            values[text] = max(values.get(text, -math.inf), value(path))
        assert math.isclose(values[toxicity.restore(token, model)], max(values.values()), abs_tol=1e-9), token


def test_character_model_counts_letters(spark):
    """Each text between spaces, letters beyond ASCII as one symbol, over several tasks."""
    held = ["Émile", "идиот и я", None, "", "a—b", "1d10t"]
    docs = spark.createDataFrame([(k, t, *[None] * 11) for k, t in enumerate(held)], DOCS).repartition(1)
    counts = toxicity.character_counts(docs).reshape((28,) * 4)
    want = Counter()
    order = [r["text"] or "" for r in docs.collect()]
    s = [toxicity._symbol(c) for c in "   " + " ".join(order).lower() + " "]
    want.update(zip(s, s[1:], s[2:], s[3:]))
    assert {tuple(map(int, at)): int(counts[tuple(at)]) for at in np.argwhere(counts)} == dict(want)
    assert want[27, 27, 27, 27] == 2 and want[0, 27, 13, 9] == 1


def test_doubled_letters_of_marked_words_are_decoded():
    model = character_model("he can kill and they kill a pussy cat that is fat in the house of the man ", ["kill", "pussy", "fat"])
    marks = [f for word in ("kill", "pussy", "fat") for f in toxicity.features(word)]
    restorer = toxicity.Restorer(model, marks)
    for disguised, plain in {"kiill": "kill", "puussy": "pussy", "faat": "fat", "kkill": "kill"}.items():
        assert restorer.words(disguised) == [plain], disguised
    assert restorer.odd("kiillers") and not restorer.odd("faaster") and not restorer.odd("moon")


def test_signs_at_the_ends_of_words_are_decoded():
    text = "he is an ass and an idiot and a loser and the bitches run to the house of the man and it is a taxi tax "
    restorer = toxicity.Restorer(character_model(text, ["ass", "bitches", "idiot", "loser"]))
    for disguised, plain in {"a$$": "ass", "bitche$": "bitches", "!diot": "idiot", "|oser": "loser", "(a$$)": "ass",
                             "\"!d!ot\".": "idiot", "idiot!!!": "idiot", "house!": "house", "(house)": "house",
                             "$100": None, "man,": "man"}.items():
        assert restorer.words(disguised) == ([plain] if plain else []), disguised


def test_disguised_documents_score_as_toxic(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        body = words(rng, 40).split(" ")
        if bad:
            for word in rng.sample(["zebrable", "quormish", "vexotin"], 2):
                body.insert(rng.randint(0, 40), word)
        rows.append((i, " ".join(body), *[None] * 11))
        labels.append((i, 1, int(bad), None))
    for i, text in ((9001, "z3br4ble"), (9002, "q u o r m i s h"), (9003, "veeeexotin")):
        rows.append((i, words(rng, 15) + f" {text} " + words(rng, 15) + f" {text} " + words(rng, 5), *[None] * 11))
    rows.append((9004, words(rng, 40), *[None] * 11))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert [got[i] for i in (9001, 9002, 9003, 9004)] == [1, 1, 1, 0]


def test_lasso_and_trees_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    bins = (x * quality.BINS).astype(int)
    tree = quality.Tree(bins, 0.3 - y, np.full(4000, 0.21), 2)
    rules = [quality.simplified(r) for r in tree.rules]
    holds = np.array([[all((bins[i, k] <= at) == below for k, at, below in r) for r in rules] for i in range(4000)], float)
    weights, intercept = quality.lasso(holds, y, 0.002)
    assert (((holds @ weights + intercept) > 0) == y).mean() > 0.97
    assert quality.simplified(((0, 5, True), (0, 3, True), (1, 2, False))) == ((0, 3, True), (1, 2, False))


def test_elias_fano_and_trie_search():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 10 ** 12), (1000, 50), (5000, 10 ** 9)):
        values = np.sort(rng.integers(0, top, n))
        sequence = lm.EliasFano.of(values)
        if n:
            assert (sequence.get(np.arange(n)) == values).all()
    pairs = np.unique(rng.integers(0, 300, 4000) << 16 | rng.integers(0, 400, 4000))
    trie = lm.Trie.build(np.arange(500, 0, -1.0), pairs, np.full(len(pairs), 2.0), 10_000, 900)
    asked = np.unique(rng.integers(0, 320, 3000) << 16 | rng.integers(0, 420, 3000))
    places = trie.find(asked)
    assert ((places >= 0) == np.isin(asked, pairs)).all()
    assert (pairs[places[places >= 0]] == asked[places >= 0]).all()


def test_trie_is_decoded_once_for_all_lookups():
    rng = np.random.default_rng(2)
    for pairs in (np.unique(rng.integers(0, 1 << 32, 5000)), np.unique(rng.integers(7, 9, 90) << 16 | rng.integers(0, 1 << 16, 90)), np.zeros(0, np.int64)):
        trie = lm.Trie.build(np.ones(lm.CONTEXTS), pairs, np.ones(len(pairs)), 100, 10)
        assert trie.keys().dtype == np.uint32 and (trie.keys() == pairs).all()
        asked = np.concatenate([pairs[::3], pairs[1::3] ^ 1])
        assert ((trie.find(asked) >= 0) == np.isin(asked, pairs)).all()
        decoded = trie.decoded
        trie.find(asked)
        assert trie.decoded is decoded


def test_trie_file_round_trip_and_normalisation(tmp_path):
    counts, total, distinct = np.array([50.0, 30, 20, 5]), 105, 4
    pairs = np.array([0 << 16 | 1, 0 << 16 | 2, 2 << 16 | 0])
    trie = lm.Trie.build(counts, pairs, np.array([7.0, 3, 9]), total, distinct, mu=10.0)
    trie.write(str(tmp_path / "trie"))
    mapped = lm.Trie.map(str(tmp_path / "trie"))
    ids = np.arange(4)
    unseen = 1 / (total + distinct + 1)
    for context in range(4):
        places = mapped.find(np.full(4, context << 16) | ids)
        log = mapped.word(ids) + mapped.penalty(np.full(4, context))
        log[places >= 0] = mapped.pair(places[places >= 0])
        rest = 10 ** mapped.penalty(np.array([context]))[0] * unseen
        assert math.isclose((10 ** log).sum() + rest, 1, abs_tol=1e-6)


@pytest.mark.parametrize("head", [8, 1 << 18])
def test_scores_by_brute_force(spark, odd, head):
    """With a small head most words are joined; counts and base scores must not change."""
    rows = lm.score(odd, head_words=head).collect()
    token = {k: (t or "").encode().lower().split() + [b"end "] for k, (_, t) in enumerate(odd_texts())}
    ids = [i for i, _ in odd_texts()]
    train = Counter(w for k, ws in token.items() if fold(ids[k], 7) != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    want = Counter((ids[k], fold(ids[k], 7) == 2, len(ws), sum(train[w] > 0 for w in ws), n,
                    round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 4)) for k, ws in token.items())
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


@pytest.mark.parametrize("head, pairs", [(8, 4), (1 << 18, 0), (1 << 18, 1 << 21)])
def test_all_pairs_count_by_brute_force(spark, odd, head, pairs):
    """Pairs seen once and pairs of rare words too; the bounds of the trie change no score."""
    rows = lm.score(odd, head_words=head, pairs=pairs).collect()
    ids = [i for i, _ in odd_texts()]
    token = [(t or "").encode().lower().split() + [b" "] for _, t in odd_texts()]
    follow = [list(zip([b" ", *ws[:-1]], ws)) for ws in token]
    learnt = [k for k in range(len(ids)) if fold(ids[k], 7) != 2]
    one, two = Counter(w for k in learnt for w in token[k]), Counter(p for k in learnt for p in follow[k])
    n, v = sum(one.values()), len(one)
    want = [(ids[k], sum(math.log10((two[a, w] + lm.MU * (one[w] + 1) / (n + v + 1)) / (one[a] + lm.MU)) for a, w in follow[k]))
            for k in range(len(ids))]
    order = lambda x: (x[0] is None, x[0], x[1]) if x[0] is not None else (True, 0, x[1])
    got = sorted(((r["doc_id"], r["score"]) for r in rows), key=order)
    for (i, x), (j, y) in zip(got, sorted(want, key=order), strict=True):
        assert i == j and math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-6)


class Caught:
    """Stands for a table of texts and keeps the function that its tasks would run."""

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_counts_come_back_in_bounded_batches(spark):
    """Also without what an earlier step kept in the worker."""
    words_ = [f"w{i}" for i in range(200_000)]
    batch = pa.record_batch([pa.array([" ".join(words_)])], names=["text"])
    common._held["an earlier step"] = object()
    lm.word_counts(caught := Caught())
    out = list(caught.run(iter([batch])))
    assert not common._held
    assert max(b.nbytes for b in out) <= 1.1 * common.PORTION_BYTES
    assert Counter({w: n for b in out for w, n in zip(*(c.to_pylist() for c in b.columns))}) == Counter([*(w.encode() for w in words_), lm.END])
    head = words_[:60_000]
    sent = spark.sparkContext.broadcast((" ".join(head).encode(), np.ones(len(head))))
    lm.pair_counts(caught, sent, "counted")
    out = list(caught.run(iter([pa.record_batch([pa.array([" ".join(head + head[::-1])])], names=["text"])])))
    pairs = [*zip(range(59_999), range(1, 60_000)), (59_999, 59_999), *zip(range(59_999, 0, -1), range(59_998, -1, -1))]
    assert max(b.nbytes for b in out) <= 1.1 * common.PORTION_BYTES
    assert {p: n for b in out for p, n in zip(*(c.to_pylist() for c in b.columns))} == {v << 16 | w: 1 for v, w in pairs}
    common.let_go()


def test_lm_without_training_rows(spark, nothing):
    assert lm.score(nothing).count() == 0
    alone = next(i for i in range(100) if fold(i, 7) == 2)
    row = lm.score(spark.createDataFrame([(alone, "some words", *[None] * 11)], DOCS)).first()
    assert (row["n_known"], row["train_tokens"], row["n_tokens"], row["base_score"]) == (0, 0, 3, 0.0)
