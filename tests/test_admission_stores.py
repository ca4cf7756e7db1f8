"""Admission in streams, enforced budgets, versioned vector stores, commits and bound descriptors."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from filmloom.operators import release as R
from filmloom.operators.rules import GateError
from filmloom.session import new_dir
from filmloom.sources import commit_log, folders, sinks, vector_store
from filmloom.streaming import admission, budgets, serving

START = datetime(2024, 1, 1, 7, 0, tzinfo=timezone.utc)  # an hour before midnight in Los Angeles


# ---- admission inside a stream

REQUESTS = "request_id long, client string, ts timestamp"


def admitted_by_hand(batches, permits, seconds, kept):
    """Windows by arrival: each batch in order of time, none taken back later."""
    used, newest, out = {}, None, {}
    for batch in batches:
        horizon = None if newest is None else newest - kept * seconds
        for i, client, ts in sorted(batch, key=lambda r: (r[2] is None, r[2] or START, r[0])):
            if ts is None:
                out[i] = (False, "no time")
                continue
            w = int(ts.timestamp()) // seconds * seconds
            key = (client or "unknown", w)
            if horizon is not None and w < horizon:
                out[i] = (False, "late")
            elif used.get(key, 0) < permits:
                used[key] = used.get(key, 0) + 1
                out[i] = (True, None)
                newest = w if newest is None else max(newest, w)
            else:
                out[i] = (False, "limit")
    return out


def request_batches():
    rng, batches, i = random.Random(3), [], 0
    for k in range(4):
        batch = []
        for _ in range(150):
            at = START + timedelta(seconds=240 * k + rng.randrange(-200, 300))
            batch.append((i, rng.choice(["hot", "hot", "a", None]), rng.choice([at, at, at, at, None])))
            i += 1
        batches.append(batch)
    batches[3].append((i, "a", START - timedelta(days=1)))
    return batches


def test_each_request_is_answered_once_over_restarts(spark):
    batches, source, out, marks = request_batches(), new_dir(spark, "requests"), new_dir(spark, "out"), new_dir(spark, "marks")
    run = lambda: admission.serve_admission(spark.readStream.schema(REQUESTS).parquet(source), out, marks, 5, 60, 3).awaitTermination()
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, REQUESTS).repartition(3).write.mode("append").parquet(source)
        run()
        if k == 2:  # a failure after the batch was answered and before it was marked done: it runs again
            before = sorted(map(tuple, admission.answers(spark, out).collect()), key=str)
            folders.remove(spark, f"{marks}/commits/2")
            folders.remove(spark, f"{marks}/commits/.2.crc")
            run()
            assert sorted(map(tuple, admission.answers(spark, out).collect()), key=str) == before
    got = admission.answers(spark, out).collect()
    assert len(got) == sum(map(len, batches))
    assert {r["request_id"]: (r["admitted"], r["reason"]) for r in got} == admitted_by_hand(batches, 5, 60, 3)
    assert len(folders.batches_in(spark, f"{out}/used")) <= 2  # the limiter's memory does not grow with the stream


def test_repeated_ids_of_a_batch_are_one_request(spark):
    rows = [(1, "a", START), (1, "a", START + timedelta(seconds=1)), (2, "a", START)]
    got = admission.decide(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame([], "client string, window_start long, used long"), None, 1)
    assert sorted((r["request_id"], r["admitted"]) for r in got.collect()) == [(1, True), (2, False)]


def test_only_permits_leave_a_task(spark):
    used = spark.createDataFrame([], "client string, window_start long, used long")
    plan = admission.decide(spark.createDataFrame(request_batches()[0], REQUESTS), used, None)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# ---- enforced budgets

LOG = "request_id long, ts timestamp, tokens long"


def budget_by_hand(log, caps):
    """One attempt after the other."""
    recent, days, attempts, total, out = [], {}, 0, 0, {}
    for i, ts, tokens in sorted((r for r in log if r[1] is not None), key=lambda r: (int(r[1].timestamp()), r[0])):
        s, day = int(ts.timestamp()), (ts - timedelta(hours=8)).date()
        recent = [x for x in recent if x[0] > s - caps.window]
        ok = (tokens is not None and tokens >= 0 and attempts < caps.attempts and days.get(day, 0) < caps.per_day and total + tokens <= caps.tokens
              and len(recent) < caps.per_minute and sum(t for _, t in recent) + tokens <= caps.tokens_per_minute)
        out[i] = ok
        if ok:
            recent.append((s, tokens))
            days[day], attempts, total = days.get(day, 0) + 1, attempts + 1, total + tokens
    return out | {r[0]: False for r in log if r[1] is None}


def odd_log(seed, n=1500, seconds=40_000):
    rng, log = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(seconds=rng.randrange(seconds) if i % 3 else 3590 + i % 20)  # a third of all in a few seconds
        log.append((i, at, rng.choice([0, 1, 3, 8, 20, 60])))
    return log + [(n, None, 1), (n + 1, START, None), (n + 2, START, 10**12), (n + 3, START, -1)]


@pytest.mark.parametrize("caps", [
    budgets.Caps(5, 60, 10**6, 10**6, 10**9), budgets.Caps(5, 60, 120, 10**6, 10**9), budgets.Caps(5, 60, 10**6, 200, 10**9),
    budgets.Caps(5, 60, 10**6, 10**6, 900), budgets.Caps(3, 30, 70, 130, 700), budgets.Caps(50, 10**6, 10**6, 10**6, 10**9, 600)])
def test_budgets_equal_one_pass_in_order(spark, caps):
    log = odd_log(caps.per_minute)
    got = budgets.admitted(spark.createDataFrame(log, LOG).repartition(4), caps, span=600)
    assert {r["request_id"]: r["admitted"] for r in got.collect()} == budget_by_hand(log, caps)


def test_a_hot_second_and_an_empty_log(spark):
    caps = budgets.Caps(4, 50, 1000, 1000, 10**6)
    log = [(i, START, 1 + i % 37) for i in range(5000)] + [(5000 + i, START + timedelta(seconds=30 + i), 5) for i in range(60)]
    table = spark.createDataFrame(log, LOG)
    assert {r["request_id"]: r["admitted"] for r in budgets.admitted(table, caps).collect()} == budget_by_hand(log, caps)
    assert budgets.candidates(table, caps, 3600, "UTC").count() <= 37 * 4 + 60
    assert budgets.admitted(table.limit(0), caps).count() == 0


# ---- versions over batches

TEXTS = "movie_id long, language string, text string, version int"


def test_versions_in_any_order_end_alike(spark):
    batches = [[(1, "en", "b", 2), (2, "en", "x", 1)], [(1, "en", "a", 1), (2, "en", "x", 5), (3, "sr", "q", 1)], [(2, "en", "y", 4), (1, "en", "c", 3), (3, "sr", "p", 1)]]
    ends = []
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        source, out, marks = (new_dir(spark, n) for n in ("versions", "vectors", "marks"))
        for k in order:
            spark.createDataFrame(batches[k], TEXTS).write.mode("append").parquet(source)
            serving.serve_embeddings(spark.readStream.schema(TEXTS).parquet(source), out, "p1", 8, marks, buckets=4).awaitTermination()
        rows = vector_store.current(spark, out).collect()
        ends.append(sorted((r["movie_id"], r["language"], r["version"], r["text_sha256"], tuple(r["vector"])) for r in rows))
    assert ends[0] == ends[1] == ends[2] and [e[:3] for e in ends[0]] == [(1, "en", 3), (2, "en", 5), (3, "sr", 1)]


def test_a_batch_reads_and_writes_its_buckets_only(spark):
    path = new_dir(spark, "vectors")
    vector_store.create(spark, path, 16)
    texts = spark.createDataFrame([(i, "en", f"t{i}", 1) for i in range(200)], TEXTS)
    vector_store.add(texts, path, 0, "p1", 8, 16)
    few = spark.createDataFrame([(7, "en", "new", 2)], TEXTS)
    read = vector_store.touched(spark, path, few, 1, 16)
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "bucket#" in filters and "batch#" in filters and read.select("_metadata.file_path").distinct().count() == 1
    light = vector_store.heads(read)._jdf.queryExecution().optimizedPlan().toString().splitlines()[-1]
    assert "vector" not in light.split("Relation")[0]
    vector_store.add(few, path, 1, "p1", 8, 16)
    vector_store.add(few, path, 1, "p1", 8, 16)  # again, as after a failure
    assert vector_store.rows(spark, path).where("batch = 1").count() == 1
    assert vector_store.current(spark, path).count() == 200
    with pytest.raises(ValueError):
        vector_store.create(spark, path, 8)


# ---- commits and descriptors

SETS = [commit_log.LanguageSet("en", "en-v6", "p1"), commit_log.LanguageSet("sr", "sr-v6", "p1")]
VECTORS = "movie_id long, language string, fingerprint string, text_sha256 string, vector array<float>"


def paired(spark, ids, turned=False):
    rows = [(i, x, "a" * 64, "b" * 64, [0.6, 0.8] if not turned else [0.8, 0.6]) for i in ids for x in ("en", "sr")]
    return spark.createDataFrame([(i,) for i in ids], "movie_id long"), spark.createDataFrame(rows, VECTORS)


def test_of_two_writers_one_wins_and_readers_see_whole_states(spark):
    root = new_dir(spark, "store")
    movies, vectors = paired(spark, [1, 2, 3])
    assert commit_log.state(spark, root).count() == 0 and commit_log.publish(movies, vectors, root, "c1", SETS, 2) == 1
    outcomes, ready = [], threading.Barrier(2)

    def write(name):
        rows = [{"kind": "catalog", "language": None, "fingerprint": name}, {"kind": "language", "language": "en", "fingerprint": name}]
        ready.wait()
        try:
            outcomes.append((name, commit_log.commit(spark, root, rows, 1)))
        except commit_log.ConflictError:
            outcomes.append((name, None))

    writers = [threading.Thread(target=write, args=(n,)) for n in ("w1", "w2")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    winner = [n for n, v in outcomes if v == 2]
    assert len(winner) == 1 and sorted(v or 0 for _, v in outcomes) == [0, 2]
    assert {r["fingerprint"] for r in commit_log.state(spark, root).collect()} == set(winner)
    assert {r["fingerprint"] for r in commit_log.state(spark, root, 1).collect()} == {"c1", "p1"}


def test_a_language_that_is_not_ready_switches_nothing(spark):
    root = new_dir(spark, "store")
    movies, vectors = paired(spark, [1, 2, 3])
    commit_log.publish(movies, vectors, root, "c1", SETS, 2)
    more, theirs = paired(spark, [1, 2, 3, 4])
    for bad in (theirs.where("movie_id < 4 OR language = 'en'"), theirs.unionByName(theirs.where("movie_id = 2")),
                theirs.where("language = 'en'"), theirs.withColumn("vector", F.when(F.col("movie_id") == 1, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))):
        with pytest.raises(GateError):
            commit_log.publish(more, bad, root, "c2", SETS, 2)
    assert commit_log.version_of(spark, root) == 1 and commit_log.read_catalog(spark, root).count() == 3
    assert commit_log.publish(more, theirs, root, "c2", SETS, 2) == 2 and commit_log.read_vectors(spark, root).count() == 8
    with pytest.raises(GateError):
        commit_log.commit(spark, root, [{"kind": "catalog", "language": None}], 2)


def test_a_descriptor_is_bound_and_never_overwritten(spark):
    root, formats = new_dir(spark, "pair"), {"en": "en-v6", "sr": "sr-v6"}
    movies, vectors = paired(spark, [1, 2, 3])
    descriptor = R.paired_descriptor(movies, vectors, formats, "p1", "v6")
    assert sinks.publish_pair(descriptor, root) == "written" and sinks.publish_pair(descriptor, root) == "kept"
    stands = folders.read_text(spark, f"{root}/paired-release.json")
    others = [R.paired_descriptor(movies, paired(spark, [1, 2, 3], True)[1], formats, "p1", "v6"), R.paired_descriptor(movies, vectors, formats, "p2", "v6"),
              R.paired_descriptor(movies, vectors, formats, "p1", "v7"), R.paired_descriptor(movies, vectors, {"en": "x", "sr": "sr-v6"}, "p1", "v6"),
              R.paired_descriptor(*paired(spark, [1, 2]), formats, "p1", "v6")]
    for other in others:
        with pytest.raises(GateError, match="another"):
            sinks.publish_pair(other, root)
    for movies_, vectors_ in ((movies, vectors.where("movie_id <> 2 OR language = 'sr'")), (movies, vectors.unionByName(vectors.where("movie_id = 1"))),
                              (movies.unionByName(movies.where("movie_id = 1")), vectors), (movies, vectors.unionByName(vectors.where("language = 'en'").withColumn("language", F.lit("de"))))):
        with pytest.raises(GateError, match="not that of the catalog"):
            sinks.publish_pair(R.paired_descriptor(movies_, vectors_, formats, "p1", "v6"), new_dir(spark, "pair"))
    assert folders.read_text(spark, f"{root}/paired-release.json") == stands


def test_files_are_created_once(spark):
    path = f"{new_dir(spark, 'once')}/x.json"
    assert folders.read_text(spark, path) is None
    assert folders.create_once(spark, path, "é1") and not folders.create_once(spark, path, "2")
    assert folders.read_text(spark, path) == "é1" and folders.names_in(spark, path.rsplit("/", 1)[0]) == ["x.json"]
