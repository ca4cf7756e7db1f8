from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom import schemas
from filmloom.operators import filters as FL, search as S
from filmloom.operators.rules import failed_rules

MOVIE = ("movie_id long, title string, year int, imdb_id string, poster_path string, runtime_minutes int, original_language string, "
         "genres array<string>, average_rating decimal(16,12), rating_count long, cast array<string>")


def movie(i, year=2000, runtime=100, lang="en", genres=("Drama",), avg="4", count=10, cast=None):
    return (i, f"t{i}", year, f"{i:07d}", None, runtime, lang, list(genres) if genres is not None else None,
            Decimal(avg) if avg is not None else None, count, cast)


@pytest.fixture(scope="module")
def truth(spark):
    """One movie for each combination of a low, middle or high year, runtime and rating, and some with unknown fields."""
    rows = [movie(1 + 9 * y + 3 * r + a, year=1970 + 20 * y, runtime=80 + 20 * r, avg=str(1 + 1.5 * a), lang=("de", "it", "fi")[(y + r) % 3],
                  genres=(["War"], ["War", "Noir"], ["Noir", "Western"])[(r + a) % 3]) for y in range(3) for r in range(3) for a in range(3)]
    rows += [movie(28, avg=None, count=None), movie(29, runtime=None), movie(30, genres=None), movie(31, lang=None)]
    return spark.createDataFrame(rows, MOVIE).persist()


TESTS = {
    "year_min": lambda m, x: m["year"] >= x, "year_max": lambda m, x: m["year"] <= x,
    "runtime_min": lambda m, x: m["runtime_minutes"] is not None and m["runtime_minutes"] >= x,
    "runtime_max": lambda m, x: m["runtime_minutes"] is not None and m["runtime_minutes"] <= x,
    "genres_all": lambda m, x: m["genres"] is not None and set(x) <= set(m["genres"]),
    "genres_any": lambda m, x: m["genres"] is not None and bool(set(x) & set(m["genres"])),
    "original_language": lambda m, x: m["original_language"] == x}


def passing_by_hand(rows, criteria):
    def ok(m):
        for field, x in criteria.items():
            if field == "rating_min":
                above = criteria.get("rating_operator") == "gt"
                if m["average_rating"] is None or not (m["average_rating"] > x if above else m["average_rating"] >= x):
                    return False
            elif field != "rating_operator" and not TESTS[field](m, x):
                return False
        return True
    return sorted(m["movie_id"] for m in rows if ok(m))


@pytest.mark.parametrize("criteria", [
    {}, {"year_min": 1990, "year_max": 1990}, {"year_min": 1971}, {"runtime_min": 100}, {"runtime_max": 99}, {"rating_min": 1}, {"rating_min": Decimal("2.5")},
    {"rating_min": Decimal("2.5"), "rating_operator": "gte"}, {"rating_min": Decimal("2.5"), "rating_operator": "gt"}, {"genres_all": ["War", "Noir"]},
    {"genres_any": ["Western", "War"]}, {"genres_all": ["Noir"], "genres_any": ["Western"]}, {"original_language": "fi"}, {"original_language": "zh"},
    {"rating_min": Decimal("2.4999999999999"), "rating_operator": "gt"}, {"rating_min": Decimal("2.5000000000000001"), "rating_operator": "gte"},
    {"year_min": 1970, "year_max": 1990, "runtime_min": 80, "runtime_max": 100, "genres_all": ["War"], "rating_min": 1, "original_language": "de"}])
def test_filters_by_hand(spark, truth, criteria):
    expected = passing_by_hand([r.asDict() for r in truth.collect()], criteria)
    assert sorted(r.movie_id for r in FL.filter_movies(truth, criteria).collect()) == expected
    # the same through column operands and through the block kernel
    q = spark.createDataFrame([("q", *[criteria.get(f) if f != "rating_min" or f not in criteria else Decimal(criteria[f]) for f in FL.FIELDS])],
                              "query_id string, " + ", ".join(f"{f.strip()}" for f in criteria_ddl()))
    renamed = truth.withColumnRenamed("original_language", "lang").withColumn("query_id", F.lit("q"))
    passing = renamed.join(q, "query_id").where(FL.matches(FL.columns_of(), {"language": "lang"}))
    assert sorted(r.movie_id for r in passing.collect()) == expected
    if criteria:
        ranked = S.batch_hard_only(truth, q, limit=100)
        assert sorted(r.movie_id for r in ranked.collect()) == expected


def criteria_ddl():
    kinds = dict(part.strip().split(" ", 1) for part in schemas.CRITERIA.replace("(28,18)", "(28;18)").split(","))
    return [f"{f} {kinds[f]}".replace("(28;18)", "(28,18)") for f in FL.FIELDS]


def test_illegal_filter_values(spark):
    ddl = ", ".join(criteria_ddl())
    base = dict.fromkeys(FL.FIELDS)
    cases = {"original_language": {"original_language": "cn"}, "year_order": {"year_min": 2001, "year_max": 2000}, "genres_all": {"genres_all": []},
             "genres_any": {"genres_any": ["Drama", "Drama"]}, "rating_operator": {"rating_operator": "gt"}, "rating_min": {"rating_min": Decimal(6)},
             "actors_all": {"actors_all": [" Brad"]}, "actors_any": {"actors_any": ["José"]},
             "actors_contradiction": {"actors_any": ["A", "B"], "actors_exclude": ["A", "B", "C"]}}
    df = spark.createDataFrame([tuple({**base, **c}[f] for f in FL.FIELDS) for c in cases.values()], ddl)
    assert [r.f for r in df.select(failed_rules(FL.criteria_rules()).alias("f")).collect()] == [[name] for name in cases]


def vectors(spark, rows):
    return spark.createDataFrame([(i, "en", v) for i, v in rows], "movie_id long, language string, vector array<float>")


def test_filters_come_before_ranking(spark):
    movies = spark.createDataFrame([movie(1, year=1999)] + [movie(i) for i in range(2, 16)], MOVIE)
    v = vectors(spark, [(1, [1.0, 0.0])] + [(i, [1.0, 1.0]) for i in range(2, 16)])
    got = S.search_hybrid(movies, v, {"year_min": 2000}, [1.0, 0.0], "en").collect()
    assert [r.movie_id for r in got] == list(range(2, 12))
    mutant = S.search_hybrid(movies, v, {}, [1.0, 0.0], "en").where("year >= 2000").count()
    assert mutant == 9


@pytest.mark.parametrize("eligible", [0, 1, 9, 10, 15])
def test_caps(spark, eligible):
    movies = spark.createDataFrame([movie(i, year=2000 if i <= eligible else 1990) for i in range(1, 17)], MOVIE)
    v = vectors(spark, [(i, [1.0, float(i)]) for i in range(1, 17)])
    assert S.search_hybrid(movies, v, {"year_min": 2000}, [1.0, 0.0]).count() == min(eligible, 10)


def test_hard_only_order_and_guards(spark):
    rows = [movie(1, avg="3", count=5), movie(2, avg="4", count=9), movie(3, avg="4", count=5), movie(4, avg=None, count=None), movie(5, avg="3", count=5)]
    got = S.search_hard_only(spark.createDataFrame(rows, MOVIE), {"year_min": 2000})
    assert [r.movie_id for r in got.collect()] == [2, 3, 1, 5, 4]
    with pytest.raises(ValueError):
        S.search_hard_only(spark.createDataFrame(rows, MOVIE), {})
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            S.check_query_vector(bad)


def random_case(seed, n_movies=400, n_queries=60, dim=6):
    rng = np.random.default_rng(seed)
    labels, people = ["Drama", "Comedy", "Action", "War"], [f"P{i}" for i in range(6)]
    some = lambda pool, p: None if rng.random() < p else list(rng.choice(pool, rng.integers(1, 3), replace=False))
    maybe = lambda v, p=0.6: None if rng.random() < p else v
    movies = [movie(i, year=int(rng.integers(1950, 2020)), runtime=maybe(int(rng.integers(60, 120)), 0.2), lang=maybe(str(rng.choice(["en", "fr"])), 0.2),
                    genres=some(labels, 0.2), avg=maybe(str(rng.integers(0, 6)), 0.2), count=maybe(int(rng.integers(0, 4)), 0.2), cast=some(people, 0.3))
              for i in range(1, n_movies + 1)]
    # a third of all vectors are copies of one another, so ties must be broken by id
    vecs = [[1.0] * dim if i % 3 == 0 else rng.normal(size=dim).astype(np.float32).tolist() for i in range(1, n_movies + 1)]
    queries = [(f"q{j}", "en", maybe(int(rng.integers(1950, 2000))), maybe(int(rng.integers(1990, 2020))), maybe(70), maybe(110), some(labels, 0.7), some(labels, 0.7),
                maybe(Decimal(int(rng.integers(0, 5)))), maybe("gt", 0.5), maybe("en", 0.7), some(people, 0.8), some(people, 0.8), some(people, 0.8),
                [1.0] * dim if j % 2 else rng.normal(size=dim).tolist()) for j in range(n_queries)]
    return movies, vecs, queries


def brute(movies, vecs, queries, hybrid):
    def ok(m, q):
        (_, _, year, _, _, runtime, lang, genres, avg, _, cast) = m
        _, _, y0, y1, r0, r1, g_all, g_any, rating, op, code, a_all, a_any, a_ex, _ = q
        need = lambda v, t: v is not None and t(v)
        tests = [(y0, lambda: year >= y0), (y1, lambda: year <= y1), (r0, lambda: need(runtime, lambda v: v >= r0)), (r1, lambda: need(runtime, lambda v: v <= r1)),
                 (g_all, lambda: need(genres, lambda v: set(g_all) <= set(v))), (g_any, lambda: need(genres, lambda v: set(g_any) & set(v))),
                 (rating, lambda: need(avg, lambda v: v > rating if op == "gt" else v >= rating)), (code, lambda: lang == code),
                 (a_all, lambda: need(cast, lambda v: set(a_all) <= set(v))), (a_any, lambda: need(cast, lambda v: set(a_any) & set(v))),
                 (a_ex, lambda: need(cast, lambda v: not set(a_ex) & set(v)))]
        return all(bool(t()) for given, t in tests if given is not None), any(g is not None for g, _ in tests)
    out = set()
    for q in queries:
        scored = []
        for m, v in zip(movies, vecs):
            passes, active = ok(m, q)
            if not passes or (not hybrid and not active):
                continue
            if hybrid:
                a, b = np.asarray(v, dtype=np.float32).astype(float), np.asarray(q[-1])
                key = (round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 12), m[0])
            else:
                key = (-(m[9] if m[9] is not None else -1), -(m[8] if m[8] is not None else -1), m[0])
            scored.append((key, m[0]))
        out |= {(q[0], rank, i) for rank, (_, i) in enumerate(sorted(scored)[:10], 1)}
    return out


@pytest.mark.parametrize("max_block", [4096, 16])
def test_batch_search_equals_brute_force(spark, max_block):
    """max_block 4096 sends one block of queries, 16 several."""
    movies, vecs, queries = random_case(7)
    m = spark.createDataFrame(movies, MOVIE)
    serving = S.serving_table(m, vectors(spark, [(r[0], v) for r, v in zip(movies, vecs)]))
    q = spark.createDataFrame(queries, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", query_vector array<double>")
    near = S.batch_hybrid(serving, q, max_block=max_block)
    assert {(r.query_id, r["rank"], r.movie_id) for r in near.collect()} == brute(movies, vecs, queries, True)
    hard = S.batch_hard_only(m, q, max_block=max_block)
    assert {(r.query_id, r["rank"], r.movie_id) for r in hard.collect()} == brute(movies, vecs, queries, False)


def test_single_search_equals_batch(spark):
    movies, vecs, queries = random_case(11, n_queries=4)
    m, v = spark.createDataFrame(movies, MOVIE), vectors(spark, [(r[0], x) for r, x in zip(movies, vecs)])
    expected = brute(movies, vecs, queries, True)
    for q in queries:
        criteria = {f: x for f, x in zip(FL.FIELDS, q[2:-1]) if x is not None}
        got = S.search_hybrid(m, v, criteria, q[-1], "en").collect()
        assert {(q[0], i, r.movie_id) for i, r in enumerate(got, 1)} == {e for e in expected if e[0] == q[0]}


@pytest.mark.parametrize("hybrid", [True, False])
def test_kernel_in_small_steps(spark, monkeypatch, hybrid):
    """The same lists when a task works through its movies in slices and batches."""
    import pyarrow as pa
    movies, vecs, queries = random_case(23, n_movies=900)
    m = spark.createDataFrame(movies, MOVIE)
    q = spark.createDataFrame(queries, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", query_vector array<double>")
    serving = S.serving_table(m, vectors(spark, [(r[0], v) for r, v in zip(movies, vecs)]))
    side = S._movie_side(serving if hybrid else m, hybrid).toArrow()
    asked = q if hybrid else q.where(FL.has_active_filter())
    monkeypatch.setattr(S, "_CELLS", 1)
    out = pa.Table.from_batches(list(S._scan(S._Block(S._query_side(asked, hybrid).toArrow(), 10, hybrid), iter(side.combine_chunks().to_batches(max_chunksize=350)))))
    found = S.top_per_query(spark.createDataFrame(out.to_pandas(), S._TOP_SCHEMA))
    assert {(r.query_id, r["rank"], r.movie_id) for r in found.collect()} == brute(movies, vecs, queries, hybrid)


def kernel_case(vecs, asked, norms=None, years=None, year_min=None):
    """A batch of movies without metadata but a year, and a block's table of queries."""
    import pyarrow as pa
    none, n = lambda rows, kind: pa.nulls(rows, kind), len(vecs)
    words, vecs = pa.list_(pa.string()), np.asarray(vecs, dtype=np.float32)
    norms = np.sqrt((vecs.astype(float) ** 2).sum(axis=1)) if norms is None else np.asarray(norms, dtype=float)
    movies = pa.RecordBatch.from_pydict({
        "movie_id": np.arange(n), "year": np.asarray(years if years is not None else [2000.0] * n, dtype=float), "runtime": none(n, pa.float64()),
        "genres": none(n, words), "cast": none(n, words), "lang_code": none(n, pa.string()), "rating": none(n, pa.int64()), "votes": none(n, pa.int64()),
        "vector": pa.array(list(vecs), pa.list_(pa.float32())), "norm": norms})
    q = len(asked)
    queries = pa.table({"query_id": [str(i) for i in range(q)], "year_min": pa.array(year_min or [None] * q, pa.float64()),
                        **{f: none(q, pa.float64()) for f in ("year_max", "runtime_min", "runtime_max")}, **{f: none(q, words) for f in FL.ARRAY_FIELDS},
                        "rating_min": none(q, pa.int64()), "original_language": none(q, pa.string()),
                        "query_vector": pa.array([list(map(float, a)) for a in asked], pa.list_(pa.float64()))})
    return movies, queries


def kernel_lists(movies, queries):
    out = {}
    for batch in S._scan(S._Block(queries, 10, True), iter([movies])):
        for r in batch.to_pylist():
            out.setdefault(r["query_id"], []).append((r["k1"], r["movie_id"]))
    return {k: sorted(v) for k, v in out.items()}


def test_lists_of_a_rough_product_are_exact(monkeypatch):
    """Copies, neighbours closer than single precision tells, foreign norms, and movies that come the nearest last."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(3000, 64)).astype(np.float32)
    vecs[100:140] = vecs[7]  # ties go by id
    vecs[200:260] = vecs[8] * (1 + 1e-6 * rng.normal(size=(60, 64)))
    vecs[300:310] *= np.float32(1e30)
    vecs[310:320] *= np.float32(1e-25)
    norms = np.sqrt((vecs.astype(float) ** 2).sum(axis=1))
    norms[400:410] *= [0.25, 0.5, 0.999, 1.001, 2, 4, -1, np.inf, np.nan, 0]
    asked = [vecs[7], vecs[8], vecs[400].astype(float) * 1e-150, vecs[305], *rng.normal(size=(20, 64)), *np.eye(64)[:8]]
    order = np.argsort(vecs[:, 0].astype(float) / np.sqrt((vecs.astype(float) ** 2).sum(axis=1)))  # the nearest to the first axis last
    years, year_min = rng.integers(1950, 2000, 3000), [None if i % 3 else 1960.0 + i for i in range(len(asked))]
    for cells in (4_000_000, 6000):
        monkeypatch.setattr(S, "_CELLS", cells)
        for rows in (np.arange(3000), order):
            movies, queries = kernel_case(vecs[rows], asked, norms[rows], years[rows], year_min)
            found = kernel_lists(movies, queries)
            for i, a in enumerate(np.asarray(asked, dtype=float)):
                with np.errstate(all="ignore"):
                    d = np.round(1 - (vecs[rows].astype(float) * (a / np.sqrt(a @ a))).sum(axis=1) / norms[rows], 12)
                fits = np.isfinite(d) & (years[rows] >= (year_min[i] or 0))
                expected = sorted((x, j) for j, x in enumerate(d) if fits[j])[:10]
                got = found[str(i)]
                assert np.allclose([x for x, _ in got], [x for x, _ in expected], rtol=1e-11, atol=2e-12)
                assert [j for _, j in got] == [j for _, j in expected] or len({x for x, _ in expected}) > len({round(x, 10) for x, _ in expected})


def test_distances_are_taken_of_few_pairs(monkeypatch):
    """A filter that queries share meets the movies once, and what is surely too far has no distance taken."""
    rng = np.random.default_rng(6)
    movies, queries = kernel_case(rng.normal(size=(8000, 16)), rng.normal(size=(200, 16)), years=rng.integers(1950, 2000, 8000),
                                  year_min=[1960.0 + i % 3 for i in range(200)])
    taken, real = [], S._distances
    monkeypatch.setattr(S, "_distances", lambda units, *more: taken.append(len(units)) or real(units, *more))
    assert all(len(rows) == 10 for rows in kernel_lists(movies, queries).values())
    assert sum(taken) < 200 * 8000 / 50
    place, values = S._Block(queries, 10, True).bounds["year_min"]
    assert len(values) == 3 and set(place) == {0, 1, 2}


def test_movies_of_several_languages_take_one_task_a_core_each(spark):
    movies, vecs, queries = random_case(9, n_movies=40, n_queries=8)
    both = vectors(spark, [(r[0], v) for r, v in zip(movies, vecs)])
    both = both.unionByName(both.withColumn("language", F.lit("sr")))
    q = spark.createDataFrame(queries, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", query_vector array<double>")
    q = q.unionByName(q.select(F.concat("query_id", F.lit("s")).alias("query_id"), F.lit("sr").alias("language"), *q.columns[2:]))
    serving = S.serving_table(spark.createDataFrame(movies, MOVIE), both)
    found = S._rank_block(serving, q, 10, True, 4096)
    assert found.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    expected = brute(movies, vecs, queries, True)
    got = {(r.query_id, r["rank"], r.movie_id) for r in S.batch_hybrid(serving, q).collect()}
    assert got == expected | {(f"{name}s", rank, i) for name, rank, i in expected}


def test_unusable_vectors_give_nothing(spark):
    movies, vecs, queries = random_case(3, n_movies=20, n_queries=3)
    queries = [q[:-1] + (v,) for q, v in zip(queries, [None, [0.0] * 6, [1.0] * 6])]
    serving = S.serving_table(spark.createDataFrame(movies, MOVIE), vectors(spark, [(r[0], v) for r, v in zip(movies, vecs)]))
    q = spark.createDataFrame(queries, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", query_vector array<double>")
    assert {r.query_id for r in S.batch_hybrid(serving, q).collect()} <= {"q2"}


def test_unusable_movie_vectors_leave_the_others(spark):
    """Zero, short, null and NaN vectors neither answer nor disturb their neighbours; ragged requests harm nobody else."""
    movies = spark.createDataFrame([movie(i) for i in range(1, 15)], MOVIE)
    odd = {3: [0.0, 0.0], 5: [1.0], 7: None, 9: [float("nan"), 1.0], 11: [1.0, None], 13: [1.0, 2.0, 3.0]}
    rows = [(i, odd.get(i, [1.0, i / 10])) for i in range(1, 15)]
    serving = S.serving_table(movies, vectors(spark, rows))
    assert {r.movie_id for r in S.unusable_vectors(vectors(spark, rows), 2).collect()} == set(odd)
    nothing = [None] * len(criteria_ddl())
    asked = [("good", "en", *nothing, [1.0, 0.0]), ("short", "en", *nothing, [1.0]), ("long", "en", *nothing, [0.0, 0.0, 1.0]), ("nan", "en", *nothing, [float("nan"), 1.0])]
    q = spark.createDataFrame(asked, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", query_vector array<double>")
    got = {}
    for r in S.batch_hybrid(serving, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.movie_id)
    assert got == {"good": [1, 2, 4, 6, 8, 10, 12, 14], "short": [5], "long": [13]}
    assert [r.movie_id for r in S.search_hybrid(movies, vectors(spark, rows), {}, [1.0, 0.0], "en").collect()] == got["good"]


def test_answers_of_every_kind(spark):
    from filmloom.streaming.serving import answer
    movies = spark.createDataFrame([movie(i) for i in range(1, 4)], MOVIE)
    serving = S.serving_table(movies, vectors(spark, [(i, [1.0, i / 10]) for i in range(1, 4)]))
    base = dict.fromkeys(FL.FIELDS)
    rows = [("near", "en", *base.values(), "words", [1.0, 0.0]), ("ragged", "en", *base.values(), "words", [1.0]), ("mute", None, *base.values(), "words", [1.0, 0.0]),
            ("none", "en", *(base | {"year_min": 2050}).values(), "words", [1.0, 0.0]), ("hard", "en", *(base | {"year_min": 1990}).values(), None, None),
            ("order", "en", *(base | {"year_min": 2001, "year_max": 2000}).values(), None, None)]
    q = spark.createDataFrame(rows, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", semantic_query string, query_vector array<double>")
    got = {(r.query_id, r.route, r["rank"]) for r in answer(q, movies, serving, 2).collect()}
    lists = {(name, route, k) for name, route in (("near", "hybrid"), ("hard", "hard_only")) for k in (1, 2, 3)}
    assert got == lists | {("ragged", "invalid", 0), ("mute", "invalid", 0), ("none", "no_results", 0), ("order", "invalid", 0)}


def test_equal_filters_are_ranked_once_and_movies_dealt_out(spark, monkeypatch):
    """Movies of one partition, as a file of one row group gives, are scanned by several tasks."""
    movies, _, _ = random_case(5)
    m = spark.createDataFrame(movies, MOVIE).coalesce(1)
    q = spark.range(60).selectExpr("CAST(id AS STRING) AS query_id", *[f"CAST({'1950 + id % 3' if f == 'year_min' else 'NULL'} AS {kind}) AS {f}"
                                                                       for f, kind in (d.split(" ", 1) for d in criteria_ddl())])
    seen, rank = [], S._rank_block

    def watched(table, queries, *more):
        found = rank(table, queries, *more)
        seen.append((queries.count(), found.rdd.getNumPartitions()))
        return found

    monkeypatch.setattr(S, "_rank_block", watched)
    lists = {}
    for r in S.batch_hard_only(m, q).collect():
        lists.setdefault(r.query_id, {})[r["rank"]] = r.movie_id
    assert len(lists) == 60 and all(lists[str(i)] == lists[str(i % 3)] for i in range(60))
    assert seen[0][0] == 3 and seen[0][1] > 1


def test_a_batch_of_requests_is_ranked_once(spark, monkeypatch):
    """The ranked rows are read for the lists and for the requests without a list."""
    from filmloom.streaming import serving
    from pyspark.sql import functions as F
    calls = spark.sparkContext.accumulator(0)

    def counted(movies, table, asks):
        def run(batches):
            calls.add(1)
            yield from batches
        rows = asks.select(F.col("query_id").cast("string").alias("query_id"), F.lit("hybrid").alias("route"), F.lit(1).alias("rank"),
                           F.lit(7).cast("long").alias("movie_id"), F.lit(0.5).alias("distance")).coalesce(1)
        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(serving, "recommend", counted)
    movies, vecs, queries = random_case(3, n_queries=6)
    q = spark.createDataFrame(queries, "query_id string, language string, " + ", ".join(criteria_ddl()) + ", query_vector array<double>")
    rows = serving.answer(q.withColumn("semantic_query", F.lit("words")), None, None).collect()
    assert len(rows) == 6 and calls.value == 1


def test_answers_of_one_file_are_parsed_by_several_tasks(spark):
    """Answers of one partition, as a file of one row group gives, keep more than one core busy."""
    from filmloom.operators import criteria as CR
    answers = spark.range(0, 40, 1, 1).selectExpr("CAST(id AS STRING) AS query_id", "IF(id % 2 = 0, '{}', '{\"type\":') AS answer")
    parsed = CR.parse_criteria(answers)
    assert parsed.rdd.getNumPartitions() > 1
    assert sorted((int(r.query_id), r.type, tuple(r.failed)) for r in parsed.select("query_id", "type", "failed").collect()) == [
        (i, "invalid", ("shape",)) for i in range(40)]
