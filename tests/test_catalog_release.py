from __future__ import annotations

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from filmloom.operators import actors as AC, catalog as C, dictionary as D, evaluate as E, release as R, sampling as SA
from filmloom.operators.rules import GateError, duplicate_report, gate, violations, base_rules
from filmloom.plans import catalog_build
from filmloom.session import new_dir
from filmloom.sources import readers, sinks
from filmloom.streaming import limits


def write(spark, text, name):
    path = new_dir(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_tag_scores_grammar_and_top_tags(spark):
    """Rows made by a rule: quoted names, scores below zero and above one, ties, a foreign movie, and one of each bad kind."""
    names = ['"by the sea, at night"', "coast", '"a ""storm"""', "tide", "wreck"]
    scores = [0.25, 0.25, 2.5, -1, 2.5]
    lines = [f"{n},31,{s}" for n, s in zip(names, scores)] + ["fog,77,1", "odd,31,Infinity", "worse,31x,0", ",31,0.5", "", "   "]
    rows = readers.read_tag_scores(spark, write(spark, "\n".join(["tag,item_id,score", *lines]), "tags"))
    failed = sorted(((r.tag or "", *r.failed_rules) for r in rows.where(F.size("failed_rules") > 0).collect()))
    assert failed == [("", "blank"), ("", "blank"), ("", "tag"), ("odd", "score"), ("worse", "item_id")]
    good = rows.where(F.size("failed_rules") == 0).withColumnRenamed("item_id", "movieLensId")
    members = spark.createDataFrame([(31,), (32,)], "movieLensId long")
    top = {r.movieLensId: [t.name for t in r.relevantTags] for r in C.top_tags(C.keep_members(good, members, "movieLensId")).collect()}
    plain = [n[1:-1].replace('""', '"') if n[0] == '"' else n for n in names]
    assert top == {31: [n for _, n in sorted(zip([-s for s in scores], plain))]}


def test_top_ten_cut(spark):
    """Ties at the tenth place go by name."""
    rng = random.Random(12)
    rows = [(4, f"n{rng.randrange(10 ** 6)}", float(rng.randrange(4))) for _ in range(40)]
    top = C.top_tags(spark.createDataFrame(rows, "movieLensId long, tag string, score double")).first().relevantTags
    assert [t.name for t in top] == [t for _, t in sorted((-s, t) for _, t, s in rows)][:10]


def test_links_genres_ratings(spark):
    links = readers.read_links(spark, write(spark, "movieId,imdbId,tmdbId\n51,0190001,900\n52,0190002,\n53,tt19,901\n0,1,2\n54,5,0", "links")).collect()
    assert [(r.movieId, r.tmdbId, r.failed_rules) for r in links] == [
        (51, 900, []), (52, None, []), (53, 901, ["imdbId"]), (0, 2, ["movieId"]), (54, 0, ["tmdbId"])]
    genres = readers.read_genres(spark, write(spark, 'movieId,title,genres\n51,"Pier, The",War|Noir|War\n52,Tide,Noir|War\n53,Fog,(no genres listed)\n54,Rain,Noir|', "genres")).collect()
    assert [(r.title, r.genres, r.failed_rules) for r in genres] == [
        ("Pier, The", ["War", "Noir", "War"], ["genres"]), ("Tide", ["Noir", "War"], []), ("Fog", None, []), ("Rain", ["Noir", ""], ["genres"])]
    given = {"2.5": True, "0": True, "5.000": True, "5.0004": False, "4.12345": False, "-1": False, ".": False, "6": False, ".5": True, "1e0": False}
    text = "\n".join(["userId,movieId,rating,timestamp", *[f"{i + 1},51,{r},{i}" for i, r in enumerate(given)]])
    ratings = readers.read_ratings(spark, write(spark, text, "ratings"))
    assert {r.userId: not r.failed_rules for r in ratings.collect()} == {i + 1: ok for i, ok in enumerate(given.values())}
    agg = C.rating_aggregates(ratings.where(F.size("failed_rules") == 0), spark.createDataFrame([(51,), (60,)], "movieId long")).collect()
    assert [(r.movieId, r.rating_count, r.rating_sum) for r in agg] == [(51, 4, Decimal("8"))]
    assert readers.blank_lines(spark, write(spark, "a\n\n \nb", "blank")).count() == 2


def test_objects_in_any_layout(spark):
    text = '{"id":1} {"id":2}\n{"id":3}\n{\n  "id": 4\n}\n{\n  "id": "5"\n}\n{"id":6}'
    rows = readers.read_tolerant(spark, write(spark, text, "seq"), "id BIGINT", "sequence").collect()
    assert sorted((r.id or 5, r.shape_ok) for r in rows) == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, True)]


def test_identity_is_not_fooled(spark):
    """Repeats, moved nulls, other id sets and ids outside the digest's ranges."""
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "k long, v string")
    assert [tuple(r) for r in R.compare_rows(rows(1, 1, 2), rows(1, 2), "k", ["v"]).collect()] == [(1, ["repeated"])]
    assert R.compare_rows(rows(1, 1), rows(1, 1), "k", ["v"]).count() == 0
    a, b = ([R.chain_fingerprint(F.lit("v"), *[F.lit(x).cast("string") for x in xs]) for xs in pair] for pair in
            (((None, "b"), ("p|q", "r")), (("b", None), ("p", "q|r"))))
    row = spark.range(1).select(*[(x == y).alias(f"c{i}") for i, (x, y) in enumerate(zip(a, b))]).first()
    assert not any(row)
    for bad in (-1, None):
        with pytest.raises(Exception, match="bad id"):
            R.tree_digest(spark.createDataFrame([(1,), (bad,)], "k long"), "k").collect()
    v = spark.createDataFrame([(i, lang, "f", "t") for lang, ids in (("en", (1, 2)), ("sr", (3, 4))) for i in ids],
                              "movie_id long, language string, fingerprint string, text_sha256 string")
    assert not R.paired_release(v).first().complete
    assert R.paired_release(v.withColumn("movie_id", F.col("movie_id") % 2)).first().complete


def test_hot_movie_keeps_whole_results(spark):
    """One movie holds a third of all rows; sums and top tags stay exact."""
    rng = random.Random(3)
    rows = [(5 if i % 3 == 0 else rng.randrange(50), f"tag{rng.randrange(400)}-{i}", rng.randrange(1000) / 8) for i in range(30000)]
    df = spark.createDataFrame(rows, "movieLensId long, tag string, score double")
    expected = {m: sorted(((-s, t) for k, t, s in rows if k == m))[:10] for m in {r[0] for r in rows}}
    got = {r.movieLensId: [(-t.score, t.name) for t in r.relevantTags] for r in C.top_tags(df).collect()}
    assert got == expected
    ratings = df.select(F.col("movieLensId").alias("movieId"), (F.col("score") / 25).cast("decimal(10,3)").alias("rating"))
    sums = {r.movieId: (r.rating_count, r.rating_sum) for r in C.rating_aggregates(ratings).collect()}
    exact = {r.movieId: (r.n, r.s) for r in ratings.groupBy("movieId").agg(F.count("*").alias("n"), F.sum(F.col("rating").cast("decimal(28,10)")).alias("s")).collect()}
    assert sums == exact and sums[5][0] >= 10000


def test_full_build(spark):
    meta = ('{"title":"First (1999)","directedBy":"D","starring":"Ann A, Bob B","avgRating":3.5,"imdbId":"0000042","item_id":1}\n'
            '{"title":" Second (2001) ","directedBy":" ","starring":"Bob B, ","avgRating":4,"imdbId":"0000043","item_id":2}')
    paths = {
        "tag_scores": write(spark, "tag,item_id,score\ndark,1,0.9\nwarm,1,0.8\ndark,2,0.1\nlost,3,1", "t"), "metadata": write(spark, meta, "m"),
        "links": write(spark, "movieId,imdbId,tmdbId\n1,42,10\n", "l"), "genres": write(spark, "movieId,title,genres\n1,First,Drama|Comedy", "g"),
        "ratings": write(spark, "userId,movieId,rating,timestamp\n1,1,4,1\n2,1,3.5,1\n3,2,1,1", "r")}
    paths |= {"details": new_dir(spark, "d"), "dictionary": new_dir(spark, "w")}
    spark.createDataFrame([(10, 101, "en", "/p.jpg")], "tmdbId int, runtimeMinutes int, originalLanguage string, posterPath string").write.parquet(paths["details"])
    spark.createDataFrame([("dark", "mračno"), ("warm", "toplo")], "en string, sr string").write.parquet(paths["dictionary"])
    bad_imdb = dict(paths, metadata=write(spark, meta.replace('"0000042"', '"42"'), "m2"))
    with pytest.raises(GateError):  # the release catalog wants at least seven digits
        catalog_build.build(catalog_build.read_sources(spark, bad_imdb))
    catalog, excluded = catalog_build.build(catalog_build.read_sources(spark, paths))
    rows = {r.movieLensId: r for r in catalog.collect()}
    assert [r.movieLensId for r in excluded.collect()] == [3]
    assert rows[1].averageRating == Decimal("3.75") and rows[1].ratingCount == 2 and rows[1].cast == ["Ann A", "Bob B"]
    assert rows[1].semanticText == "Title: First. Year: 1999. Director: D. Tags: dark, warm."
    assert rows[2].semanticTextSr == "Naslov: Second. Godina: 2001. Režija: nepoznato. Tagovi: mračno."
    assert rows[2].ratingCount is None and rows[2].tmdbId is None and rows[2].cast == ["Bob B"]
    bad = dict(paths, links=write(spark, "movieId,imdbId,tmdbId\n1,77,10\n", "l2"))
    with pytest.raises(GateError):
        catalog_build.build(catalog_build.read_sources(spark, bad))


def test_rules_and_gate(spark):
    ok = (1, "a (1999)", "a", 1999, "42", Decimal(3), None, None)
    df = spark.createDataFrame([ok, (0, None, " ", 99, "x", Decimal(9), "a\nb", None)],
                               "movieLensId long, rawTitle string, title string, year int, imdbId string, movieLensAvgRating decimal(28,18), directedByRaw string, starringRaw string")
    assert all(r.violations == 1 for r in violations(df, base_rules()).collect())
    with pytest.raises(GateError):
        gate(violations(df, base_rules()))
    gate(violations(df.where("movieLensId = 1"), base_rules()))


def test_bag_digest_matches_definition_and_is_order_free(spark):
    rows = [(i, f"v{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v string")
    got = R.bag_digest(df).first()
    lanes = [0, 0, 0, 0]
    for i, v in rows:
        h = hashlib.sha256(f'{{"id":{i},"v":"{v}"}}'.encode()).hexdigest()
        for lane in range(4):
            lanes[lane] += int(h[15 * lane:15 * lane + 15], 16)
    assert got.digest == hashlib.sha256(":".join([R.BAG_DIGEST, "1000", *map(str, lanes)]).encode()).hexdigest()
    assert R.bag_digest(df.orderBy(F.desc("id")).repartition(5)).first() == got
    assert R.bag_digest(df.where("id <> 5")).first().digest != got.digest


def test_tree_digest_levels_and_repeated_ids(spark):
    df = spark.range(1, 10001).withColumnRenamed("id", "k")
    a = R.tree_digest(df, "k", fan_out=16).first()
    assert a.rows == 10000 and R.tree_digest(df.repartition(7), "k", fan_out=16).first() == a
    assert R.tree_digest(df.where("k <> 77"), "k", fan_out=16).first().digest != a.digest
    hot = df.withColumn("v", F.lit(0)).union(spark.range(5000).select(F.lit(77).alias("k"), F.col("id").alias("v")))
    twice = [R.tree_digest(x, "k", F.concat_ws(",", "k", "v"), fan_out=16).first() for x in (hot, hot.repartition(3))]
    assert twice[0] == twice[1] and twice[0].rows == 15000


def test_publication(spark):
    df, root = spark.range(1, 6).withColumnRenamed("id", "movie_id"), new_dir(spark, "store")
    sinks.publish_release(df, root, "movies", 1, "a")
    with pytest.raises(Exception):
        sinks.publish_release(df, root, "movies", 1, "a")
    with pytest.raises(GateError):  # a failing check leaves the pointer where it was
        sinks.publish_release(df.union(df), root, "movies", 2, "b", lambda d: duplicate_report(d, {"id": ["movie_id"]}))
    sinks.publish_release(df, root, "movies", 2, "b")  # and no target behind, so that a retry passes
    assert sinks.releases(spark, root).count() == 2 and sinks.current_release(spark, root).first().version == 2 and sinks.read_release(spark, root, "movies").count() == 5
    path = new_dir(spark, "target")
    assert sinks.load_idempotent(df.where("movie_id < 0"), df, path) == "insert"
    assert sinks.load_idempotent(spark.read.parquet(path), df, path) == "skip"
    with pytest.raises(GateError):
        sinks.load_idempotent(df.where("movie_id > 2"), df, path)


def test_stratified_sample_equals_round_robin(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1950, 2015) if i % 3 else 2012, [rng.choice("ABC")] if i % 3 else ["A"]) for i in range(1, 601)]
    df = spark.createDataFrame(rows, "movie_id long, year int, genres array<string>")
    band = lambda y: "0-pre1960" if y < 1960 else "1-1960-1979" if y <= 1979 else "2-1980-1999" if y <= 1999 else "3-2000-2009" if y <= 2009 else "4-2010plus"
    queues = {}
    for i, y, g in sorted(rows, key=lambda r: (hashlib.sha256(f"s|{r[0]}".encode()).hexdigest(), r[0])):
        queues.setdefault(f"{band(y)}|{g[0]}", []).append(i)
    expected = []
    while len(expected) < 150:
        for key in sorted(queues):
            if queues[key] and len(expected) < 150:
                expected.append(queues[key].pop(0))
    assert sorted(r.movie_id for r in SA.stratified_sample(df, 150, "s").collect()) == sorted(expected)


def test_actor_resolution(spark):
    names = spark.createDataFrame([(n,) for n in ["Uma Berg", "Egon Vance Jr.", "Zoë Martín", "Núria", "NÚRIA", "Nuria"]], "name string")
    cases = {"\u2003uma BERG ": "Uma Berg", "Egon Vance Jr.": "Egon Vance Jr.", "ZOË martín": "Zoë Martín", "NÚRIA": "NÚRIA", "Nuria": "Nuria",
             "nuria": "Nuria", "núria": None, "Berg": None, "Zoe Martin": None, "\rUma Berg": None, "ума берг": "Uma Berg"}
    aliases = spark.createDataFrame([("Ума Берг", "Uma Berg")], "alias string, target string")
    got = {r.proposed: r.resolved for r in AC.resolve_names(spark.createDataFrame([(c,) for c in cases], "proposed string"), names, aliases).collect()}
    assert {k: got[k] for k in cases if k[0] not in "\u2003\r"} == {k: v for k, v in cases.items() if k[0] not in "\u2003\r"}
    assert set(got) == set(cases)
    bad = spark.createDataFrame([("Uma Berg", "Uma Berg"), ("alias", "Nobody"), ("u", "Núria"), ("U", "Núria")], "alias string, target string")
    assert {(r.alias, r.problem) for r in AC.alias_problems(names, bad).collect()} == {
        ("Uma Berg", "registry key"), ("alias", "unknown target"), ("u", "repeated"), ("U", "repeated")}


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([("Q001", "semantic", 1, 1), ("Q001", "semantic", 2, 2)], "query_id string, mode string, movie_id long, rank int")
    judged = lambda rows: spark.createDataFrame(rows, "query_id string, movie_id long, score int")
    j = judged([("Q001", 1, 3), ("Q001", 2, 1)])
    row = E.relevance(E.with_scores(results, j), j).first()
    assert (row.mean_relevance, row.precision_at_10) == (2.0, 0.5) and abs(row.ndcg_at_10 - 1) < 1e-12
    pooled = judged([("Q001", 1, 1), ("Q001", 2, 0), ("Q001", 3, 3)])
    assert E.relevance(E.with_scores(results, pooled), pooled).first().ndcg_at_10 < 0.2
    partial = judged([("Q001", 1, 3)])
    assert E.relevance(E.with_scores(results, partial), partial).first().mean_relevance is None
    zero = judged([("Q001", 1, 0), ("Q001", 2, 0)])
    assert E.relevance(E.with_scores(results, zero), zero).first().ndcg_at_10 == 0
    bad = ['{"T":{"01":2}}', '{"T":{"1":"2"}}', '{"T":{"1":4}}', '{"T":{"1":1.5}}', '{"T":{"x":1}}', '{"T":5}', '{"T":{"7":1,"7":2}}', '{"T":[1]}', "[1]", "{"]
    for line in bad:
        rows = E.judgments_from_json(spark.createDataFrame([(line,)], "value string")).collect()
        assert rows and not any(r.ok for r in rows), line
    good = E.judgments_from_json(spark.createDataFrame([('{"T":{"7":3,"12":0}}',)], "value string")).collect()
    assert sorted((r.query_id, r.movie_id, r.score, r.ok) for r in good) == [("T", 7, 3, True), ("T", 12, 0, True)]


def test_percentiles_of_values_in_one_unit(spark):
    """A hundred thousand different values between 0 and 1: no range of the walk holds more than a few of them."""
    log = spark.range(100_000).select(F.lit("s").alias("stage"), (F.pmod(F.col("id") * 7919, F.lit(100_000)) / 100_000).alias("millis"))
    got = {r.p: r.value for r in E.latency_percentiles(log, [0.5, 0.95, 1.0]).collect()}
    assert got == {0.5: 0.49999, 0.95: 0.94999, 1.0: 0.99999}


def test_percentiles_equal_sorting(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"s{i % 4}", 12.0 if i % 3 == 1 else rng.randrange(5000) / 16) for i in range(5000)]
    got = {(r.stage, r.p): r.value for r in E.latency_percentiles(spark.createDataFrame(rows, "stage string, millis double"), [0.01, 0.5, 0.95, 1.0]).collect()}
    for stage in {r[0] for r in rows}:
        values = sorted(v for s, v in rows if s == stage)
        for p in (0.01, 0.5, 0.95, 1.0):
            index = min(max(-int(-(p * len(values)) // 1) - 1, 0), len(values) - 1)
            assert got[stage, p] == values[index], (stage, p)


def test_limits_and_usage_equal_brute_force(spark):
    rng = random.Random(1)
    log = [(i, 1704067200 + rng.randrange(4000) if i % 3 else 1704067260 + i % 50, "hot" if i % 3 == 0 else f"c{rng.randrange(4)}", rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(log, "request_id long, s long, client string, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    groups = {}
    for i, s, c, _ in sorted(log, key=lambda r: (r[1], r[0])):
        groups.setdefault((c, s // 60 * 60), []).append(i)
    counts = {(r.client, r.window_start): (r.requests, r.admitted, r.rejected) for r in limits.window_counts(df).collect()}
    assert counts == {k: (len(v), min(30, len(v)), max(0, len(v) - 30)) for k, v in groups.items()}
    assert {r.request_id for r in limits.rejected_requests(df).collect()} == {i for v in groups.values() for i in v[30:]}
    per_second = {}
    for _, s, _, t in log:
        a, b = per_second.get(s, (0, 0))
        per_second[s] = (a + 1, b + t)
    for r in limits.usage(df).collect():
        inside = [per_second[s] for s in per_second if r.second - 59 <= s <= r.second]
        before = [per_second[s] for s in per_second if s <= r.second]
        assert (r.attempts_60s, r.tokens_60s) == tuple(map(sum, zip(*inside)))
        assert (r.attempts_total, r.tokens_total) == tuple(map(sum, zip(*before)))


def test_dictionary_review(spark):
    ddl = "en string, machine string, sr string, reviewStatus string, manualOverride boolean"
    d = spark.createDataFrame([("dark", "mračno", "mračno", "auto_pass", False), ("warm", "toplo", "toplo", "review_required", False)], ddl)
    decisions = spark.createDataFrame([("dark", "тамно "), ("nope", "x"), ("warm", " ")], "en string, approvedSr string")
    assert {(r.en, r.problem) for r in D.review_problems(d, decisions).collect()} == {("nope", "unknown"), ("warm", "blank")}
    out = {r.en: r for r in D.apply_review(d, decisions.where("en = 'dark'")).collect()}
    assert (out["dark"].sr, out["dark"].reviewStatus, out["dark"].manualOverride) == ("tamno", "reviewed", True) and out["warm"].sr == "toplo"
    full = spark.createDataFrame([("dark", "mračno", "retained_baseline", "r", "high"), ("warm", "топло", "corrected", "r", "high"), ("x", "y", "odd", " ", "high")],
                                 "en string, approvedSr string, disposition string, rationale string, confidence string")
    base, new = d.where("en = 'dark'"), d.where("en = 'warm'")
    assert {r.en: r.problems for r in D.decision_problems(full, base, new).collect()} == {"warm": ["approved_text"], "x": ["known_key", "disposition", "rationale"]}
    problems = D.lock_problems(D.analyze(d), spark.createDataFrame([("dark",), ("cold",)], "tag string"))
    assert {(r.en, r.problem) for r in problems.collect()} == {("warm", "blank or unresolved"), ("warm", "only in left"), ("cold", "only in right")}


def test_embedding_stream_resumes(spark):
    from filmloom.streaming import serving
    source, out, marks = (new_dir(spark, n) for n in ("versions", "vectors", "marks"))
    ddl = "movie_id long, language string, text string"
    run = lambda: serving.serve_embeddings(spark.readStream.schema(ddl).parquet(source), out, "p1", 16, marks).awaitTermination()
    stored = lambda: sorted((r.movie_id, r.batch) for r in spark.read.parquet(out).collect())
    spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], ddl).write.parquet(source)
    run()
    assert stored() == [(1, 0), (2, 0)]
    spark.createDataFrame([(1, "en", "a"), (2, "en", "changed"), (3, "sr", "c")], ddl).write.mode("append").parquet(source)
    run()
    assert stored() == [(1, 0), (2, 0), (2, 1), (3, 1)]


def test_newest_text_of_a_batch_wins(spark):
    from filmloom.streaming import serving
    ddl = "movie_id long, language string, text string, version int"
    rows = spark.createDataFrame([(1, "en", "z old", 1), (1, "en", "a new", 2), (2, "en", "only", 1)], ddl)
    assert sorted((r.movie_id, r.text) for r in serving.newest(rows).collect()) == [(1, "a new"), (2, "only")]


def test_vector_reuse_rules(spark):
    from filmloom.operators import embedding as EM
    texts = spark.createDataFrame([(1, "en", "a"), (2, "en", "b"), (3, "en", "c")], "movie_id long, language string, text string")
    first = EM.embed_incrementally(texts.limit(0).withColumn("fingerprint", F.lit("")).withColumn("text_sha256", F.lit("")).withColumn(
        "vector", F.array(F.lit(1.0).cast("float"))).drop("text"), texts, "p1", 16)[1]
    torn = first.withColumn("vector", F.when(F.col("movie_id") == 3, F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    kept, fresh = EM.embed_incrementally(torn, texts, "p1", 16)
    assert sorted(r.movie_id for r in kept.collect()) == [1, 2] and [r.movie_id for r in fresh.collect()] == [3]
    assert EM.embed_incrementally(torn, texts, "p2", 16)[0].count() == 0


def test_vector_release_plan(spark):
    from filmloom.plans import vectors_build
    movies = spark.createDataFrame([(i,) for i in (1, 2, 3)], "movie_id long")
    texts = spark.createDataFrame([(i, lang, f"text {i} {lang}") for i in (1, 2, 3) for lang in ("en", "sr")], "movie_id long, language string, text string")
    none = spark.createDataFrame([], "movie_id long, language string, fingerprint string, text_sha256 string, vector array<float>")
    root = new_dir(spark, "store")
    vectors_build.build(movies, texts, none, "p1", 8, root, 1)
    assert sinks.read_release(spark, root, "movie_embeddings").count() == 3
    with pytest.raises(GateError, match="no pair"):
        vectors_build.build(movies, texts.where("movie_id <> 2 OR language = 'en'"), none, "p1", 8, root, 2)
    with pytest.raises(GateError, match="cut"):
        vectors_build.build(movies, texts.withColumn("text", F.repeat("text", F.lit(900))), none, "p1", 8, root, 2)
    assert sinks.current_release(spark, root).first().version == 1


def test_a_model_says_what_made_a_vector(spark, tmp_path):
    from filmloom.operators import embedding as EM
    texts = spark.createDataFrame([(1, "en", "a b c"), (2, "en", "a b c d e"), (3, "en", None), (4, "en", " "), (5, "sr", "a"), (5, "sr", "a")],
                                  "movie_id long, language string, text string")
    model = EM.Model("words", 2, encoder=lambda batch: [[0.6, 0.8]] * len(batch),
                     counter=lambda batch: [t.count(" ") + 1 for t in batch], limit=5)
    audit = {r["language"]: tuple(r)[1:] for r in EM.model_audit(texts, model).collect()}
    assert audit == {"en": (4, 1, 6), "sr": (2, 0, 2)}  # the input's own first word counts
    empty = spark.createDataFrame([], "movie_id long, language string, fingerprint string, text_sha256 string, vector array<float>")
    kept, fresh = EM.embed_with(empty, texts.where("text > ' '"), model)
    assert kept.count() == 0
    assert sorted((r["movie_id"], r["profile"], r["tokens"], r["truncated"]) for r in fresh.collect()) == [
        (1, "words", 4, False), (2, "words", 6, True), (5, "words", 2, False), (5, "words", 2, False)]
    short = EM.Model("words", 2, counter=lambda batch: [1], limit=5)
    with pytest.raises(Exception, match="counter returned"):
        texts.where("movie_id < 3").coalesce(1).select(short.tokens(F.col("text"))).collect()


def test_chunks_are_bounded_in_rows(spark, tmp_path):
    from filmloom.operators import embedding as EM
    texts = spark.range(100).select(F.col("id").alias("movie_id"), F.lit("en").alias("language"), F.concat(F.lit("text "), "id").alias("text"))
    path = str(tmp_path / "vectors")
    EM.embed_in_chunks(texts.where("movie_id < 60"), path, "p", 4, rows=20)
    first = spark.read.parquet(path)
    assert first.count() == 60 and first.where("chunk >= 0").select("chunk").distinct().count() == 3
    EM.embed_in_chunks(texts, path, "p", 4, rows=20)
    EM.embed_in_chunks(texts, path, "p", 4, rows=20)  # nothing is missing
    rows = spark.read.parquet(path)
    assert rows.count() == 100 and rows.select("movie_id").distinct().count() == 100
    assert rows.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 60


def test_rows_without_text_reach_no_encoder_as_null(spark, tmp_path):
    from filmloom.bindings import sources
    from filmloom.operators import embedding as EM
    rows = [(1, "en", "a", 2**60 + 1), (2, "en", None, None), (3, "en", " \t", 3), (4, "en", "abc", 2**60 + 3)]
    texts = spark.createDataFrame(rows, "movie_id long, language string, text string, other long").coalesce(1)
    strict = lambda batch: [[float(len(t)), 1.0] for t in batch]  # noqa: E731 - a null has no length
    encoded = EM.encode(EM.document_inputs(texts), strict, 2, batch_size=3)
    assert sorted((r["movie_id"], r["input"], r["other"], tuple(r["vector"])) for r in encoded.collect()) == [
        (1, "passage: a", 2**60 + 1, (10.0, 1.0)), (2, None, None, (0.0, 1.0)), (3, None, 3, (0.0, 1.0)), (4, "passage: abc", 2**60 + 3, (12.0, 1.0))]
    # chunks: what has no text is committed once, and a later run leaves it alone
    path = str(tmp_path / "vectors")
    for some in (texts.where("movie_id <= 2"), texts, texts):
        EM.embed_in_chunks(some.drop("other"), path, "p", 8, sources.length_encoder, 2)
    assert sorted(r["movie_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_encoder_queries_with_missing_texts(spark, tmp_path):
    from filmloom.bindings import QUERIES
    rows = [(i, None if i % 3 == 0 else " " if i % 3 == 1 else f"text {i}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["U1_encoder_plugin"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(i, 8, True) for i in range(12)]
    found = QUERIES["U1_chunk_commits"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(i, True, i % 2 == 0) for i in range(12)]
