"""Release identity: digests, readiness, comparison, conservation, pins and the publication gate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from filmloom.functions.vectors import is_valid_vector
from filmloom.operators.rules import one_row

TREE_DIGEST = "tree-sha256-4096-v1"
BAG_DIGEST = "bag-sha256-lanes-v1"
FAN_OUT = 4096
_LANES = 4


def row_hash(columns: Sequence[str]) -> Column:
    """sha256 of the row as JSON with nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def tree_digest(df: DataFrame, key: str, payload: Column | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """One row (rows, digest): an ordered digest built level by level over fixed ranges of the id.

    A range holds at most `fan_out` entries, whatever the skew: rows of one id are first reduced to a
    commutative sum, so that even a repeated id stays one entry. Levels end when one range is left.
    Ids below zero and null ids have no range of their own and are refused.
    """
    text = payload if payload is not None else F.col(key).cast("string")
    bad = F.col(key).isNull() | (F.col(key) < 0)
    key_ok = F.when(bad, F.raise_error(F.concat(F.lit("tree digest: bad id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    hashed = df.select(F.coalesce(key_ok.cast("bigint"), F.col(key)).alias("_k"), F.sha2(text, 256).alias("_h"))
    entries = hashed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_low"), *_lane_sums("_h"))
    lanes = F.concat_ws(":", *_lanes())
    # A single row keeps its own hash; repeated ids get the hash of their combined lanes.
    level = entries.select("_k", F.when(F.col("_n") == 1, F.col("_low")).otherwise(F.sha2(lanes, 256)).alias("_h"), "_n")
    top = level.agg(F.max("_k")).first()[0]
    span = 1
    while True:
        span *= fan_out
        level = (level.groupBy(F.floor(F.col("_k") / fan_out).alias("_g"))
                 .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))),
                                                      lambda e: e["_h"]), ""), 256).alias("_h"),
                      F.sum("_n").alias("_n")).select(F.col("_g").alias("_k"), "_h", "_n"))
        if top is None or top < span:
            break
    return level.select(F.col("_n").alias("rows"), F.col("_h").alias("digest"))


_PARTS = 3


def _lane_sums(column: str) -> list[Column]:
    """Four 60-bit lanes of a sha256, each summed as three 20-bit parts.

    Such sums are longs, so they stay in generated code, and hold 8e12 rows before they could overflow.
    """
    sums = []
    for lane in range(_LANES):
        value = F.conv(F.substr(F.col(column), F.lit(1 + 15 * lane), F.lit(15)), 16, 10).cast("bigint")
        sums += [F.sum(F.shiftright(value, 20 * part).bitwiseAND(F.lit(0xFFFFF))).alias(f"_l{lane}_{part}")
                 for part in range(_PARTS)]
    return sums


def _lanes() -> list[Column]:
    """The exact lane totals as text."""
    total = lambda lane: sum((F.coalesce(F.col(f"_l{lane}_{p}"), F.lit(0)).cast("decimal(20,0)")
                              * F.lit(1 << (20 * p)).cast("decimal(14,0)") for p in range(_PARTS)),
                             F.lit(0).cast("decimal(38,0)"))
    return [total(lane).cast("decimal(38,0)").cast("string") for lane in range(_LANES)]


def bag_digest(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, digest): digest of the rows as a multiset, in one pass and without moving any row.

    With the id among the columns, equal digests mean equal ordered content.
    """
    hashed = df.select(*by, row_hash(list(columns or df.columns)).alias("_h"))
    sums = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *_lane_sums("_h"))
    lanes = F.concat_ws(":", F.lit(BAG_DIGEST), F.col("rows").cast("string"), *_lanes())
    return sums.select(*by, "rows", F.sha2(lanes, 256).alias("digest"))


def vector_readiness(vectors: DataFrame, dimension: int, tolerance: float = 1e-4,
                     fingerprint: str = "fingerprint") -> DataFrame:
    """(language, vectors, valid) in one aggregate."""
    ok = is_valid_vector(F.col("vector"), dimension, tolerance)
    if fingerprint in vectors.columns:
        ok = ok & F.coalesce(F.col(fingerprint).rlike("^[0-9a-f]{64}$"), F.lit(False))
    return vectors.groupBy("language").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(ok).alias("valid"))


def _covered(movies: DataFrame, vectors: DataFrame) -> DataFrame:
    """(language, covered): how many movies have exactly one vector of a language; counts alone could hide a repeat."""
    single = vectors.groupBy("language", "movie_id").count().where("count = 1")
    return single.join(movies.select("movie_id").distinct(), "movie_id", "left_semi").groupBy("language").agg(
        F.count(F.lit(1)).alias("covered"))


def language_readiness(movies: DataFrame, vectors: DataFrame, states: DataFrame, dimension: int,
                       tolerance: float = 1e-4) -> DataFrame:
    """(language, movies, vectors, valid, state_count, ready). Each language stands for itself; none borrows."""
    counted = movies.agg(F.count(F.lit(1)).alias("movies")).first()["movies"]
    found = vector_readiness(vectors, dimension, tolerance).join(_covered(movies, vectors), "language", "left")
    listed = states.groupBy("language").agg(F.count(F.lit(1)).alias("state_rows"),
                                            F.max("embedded_count").alias("state_count"))
    joined = listed.join(found, "language", "full_outer").withColumn("movies", F.lit(counted).cast("bigint"))
    n = F.col("movies")
    ready = ((F.col("state_rows") == 1) & (F.col("vectors") == n) & (F.col("valid") == n) & (F.col("state_count") == n)
             & (F.col("covered") == n))
    return joined.select("language", "movies", F.coalesce("vectors", F.lit(0)).alias("vectors"),
                         F.coalesce("valid", F.lit(0)).alias("valid"), "state_count",
                         F.coalesce(ready, F.lit(False)).alias("ready"))


def compare_rows(stored: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, differing) for keys that are missing, extra, repeated on one side or unequal in any field.

    Rows are counted by key and content first, so a repeated row is never hidden behind its equal.
    """
    a, b = _counted(stored, key, fields, "a"), _counted(expected, key, fields, "b")
    joined = a.join(b, a["_ka"].eqNullSafe(b["_kb"]), "full_outer").withColumn(key, F.coalesce("_ka", "_kb"))
    unequal = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f))
                                        for f in fields]))
    more = F.col("_rows_a") != F.col("_rows_b")
    repeated = F.when(more | (F.greatest("_kinds_a", "_kinds_b") > 1), F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>"))
    differing = (F.when(F.col("_rows_b").isNull(), F.array(F.lit("extra")))
                 .when(F.col("_rows_a").isNull(), F.array(F.lit("missing"))).otherwise(F.concat(unequal, repeated)))
    return joined.select(key, differing.alias("differing")).where(F.size("differing") > 0)


def _counted(rows: DataFrame, key: str, fields: Sequence[str], side: str) -> DataFrame:
    """One row per key: its rows, its different contents and the fields of its least content."""
    content = F.struct(*[F.col(f) for f in fields])
    kinds = rows.select(F.col(key).alias(f"_k{side}"), content.alias("_c")).groupBy(f"_k{side}", "_c").agg(F.count(F.lit(1)).alias("_n"))
    one = kinds.groupBy(f"_k{side}").agg(F.sum("_n").alias(f"_rows_{side}"), F.count(F.lit(1)).alias(f"_kinds_{side}"), F.min("_c").alias("_c"))
    return one.select(f"_k{side}", f"_rows_{side}", f"_kinds_{side}", *[F.col(f"_c.{f}").alias(f"_{side}_{f}") for f in fields])


def conserved(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of `before` whose fields did not survive a transformation; empty when all is kept."""
    return compare_rows(after, before, key, fields)


def chain_fingerprint(version: Column, *inputs: Column) -> Column:
    """Identity of an output: hash over its version and its input hashes, nulls and separators written out."""
    parts = [c.cast("string").alias(f"p{i}") for i, c in enumerate((version, *inputs))]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def verify_chain(release: DataFrame, version: str, inputs: Sequence[str], stored: str = "fingerprint") -> DataFrame:
    recomputed = chain_fingerprint(F.col(version), *[F.col(i) for i in inputs])
    return release.withColumn("chain_ok", F.col(stored).eqNullSafe(recomputed))


LARGEST_ROW = 1 << 30  # files beyond this many bytes are read as a stream
_READ = 8 << 20


def file_hashes(spark, paths: str | list[str], limit: int = LARGEST_ROW) -> DataFrame:
    """(name, bytes, sha256, md5) of whole files of any size, each hashed by one task.

    Files up to `limit` bytes are rows of the binary source. Larger ones, which no row could hold, are read by the tasks
    in pieces of 8 MB, so memory does not grow with the file.
    """
    listed = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = listed.where(F.col("length") <= limit).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
                                                         F.md5("content").alias("md5"))
    large = listed.where(F.col("length") > limit).select(name, F.col("length").alias("bytes"), "path")
    return small.unionByName(large.repartition("path").mapInArrow(_streamed_hashes, "name string, bytes long, sha256 string, md5 string"))


def _streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sums = hashlib.sha256(), hashlib.md5()
            files, place = pafs.FileSystem.from_uri(row["path"])
            with files.open_input_stream(place) as stream:
                while piece := stream.read(_READ):
                    for s in sums:
                        s.update(piece)
            yield pa.RecordBatch.from_pylist([{"name": row["name"], "bytes": row["bytes"], "sha256": sums[0].hexdigest(), "md5": sums[1].hexdigest()}])


def check_pins(hashes: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, ok) for every pin; a pin is a sha256 or an md5."""
    joined = pins.join(hashes, "name", "left")
    pinned = F.when(F.length("pin") == 64, F.col("sha256")).otherwise(F.col("md5"))
    return joined.select("name", F.coalesce(pinned == F.col("pin"), F.lit(False)).alias("ok"))


def vector_set_problems(expected: DataFrame, vectors: DataFrame, dimension: int, tolerance: float = 1e-4) -> DataFrame:
    """(movie_id, problem): missing, extra or repeated ids, other fingerprint or text hash, bad vector.

    `expected` holds movie_id, fingerprint and text_sha256.
    """
    a = expected.select("movie_id", F.col("fingerprint").alias("_fp"), F.col("text_sha256").alias("_sha"),
                        F.lit(True).alias("_e"))
    b = vectors.select("movie_id", "fingerprint", "text_sha256",
                       is_valid_vector(F.col("vector"), dimension, tolerance).alias("_ok")).groupBy("movie_id").agg(
        F.count(F.lit(1)).alias("_v"), F.min("fingerprint").alias("fingerprint"), F.min("text_sha256").alias("text_sha256"),
        F.min("_ok").alias("_ok"))
    problem = (F.when(F.col("_v").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_v") > 1, "repeated")
               .when(~F.col("fingerprint").eqNullSafe(F.col("_fp")), "fingerprint")
               .when(~F.col("text_sha256").eqNullSafe(F.col("_sha")), "text hash").when(~F.col("_ok"), "vector"))
    return a.join(b, "movie_id", "full_outer").select("movie_id", problem.alias("problem")).where(
        F.col("problem").isNotNull())


def pair_vectors(vectors: DataFrame) -> DataFrame:
    """One row per pair of vectors of both languages; movies without exactly one pair are reported by `unpaired`."""
    side = lambda language, suffix: vectors.where(F.col("language") == language).select(
        "movie_id", F.col("vector").alias(f"embedding{suffix}"), F.col("fingerprint").alias(f"document_fingerprint{suffix}"))
    return side("en", "").join(side("sr", "_sr"), "movie_id")


def unpaired(movies: DataFrame, paired: DataFrame) -> DataFrame:
    """Movies without a pair, pairs without a movie, and movies with several pairs."""
    ids = paired.select("movie_id").distinct()
    several = paired.groupBy("movie_id").count().where("count > 1").select("movie_id", F.lit("repeated").alias("problem"))
    return (movies.select("movie_id").join(ids, "movie_id", "left_anti").withColumn("problem", F.lit("no pair"))
            .unionByName(ids.join(movies.select("movie_id"), "movie_id", "left_anti")
                         .withColumn("problem", F.lit("no movie"))).unionByName(several))


def paired_release(vectors: DataFrame, languages: Sequence[str] = ("en", "sr")) -> DataFrame:
    """One row binding all language sets: counts, digests of ids and of contents; complete only when all id sets agree.

    A repeated id changes the digest of its set, so equal counts of other ids are not taken for a pair.
    """
    digests = bag_digest(vectors, ["movie_id", "fingerprint", "text_sha256"], by=["language"]).join(
        bag_digest(vectors, ["movie_id"], by=["language"]).select("language", F.col("digest").alias("ids")).join(
            vectors.groupBy("language", "movie_id").count().groupBy("language").agg(F.max("count").alias("most")), "language"), "language")
    parts = [digests.where(F.col("language") == lang).agg(
        F.max("rows").alias(f"{lang}_rows"), F.max("digest").alias(f"{lang}_digest"), F.max("ids").alias(f"_{lang}_ids"),
        F.max("most").alias(f"_{lang}_most")) for lang in languages]
    row = one_row(*parts)
    first = F.col(f"_{languages[0]}_ids")
    complete = F.lit(True)
    for lang in languages:
        complete = complete & F.coalesce((F.col(f"_{lang}_ids") == first) & (F.col(f"_{lang}_most") == 1), F.lit(False))
    held = [x for lang in languages for x in (f"_{lang}_ids", f"_{lang}_most")]
    return row.withColumn("complete", complete).withColumn(
        "pair_fingerprint", chain_fingerprint(F.lit("paired-release-v2"), *[F.col(f"{x}_digest") for x in languages])).drop(*held)


def paired_problems(movies: DataFrame, vectors: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(language, movie_id, problem): per language, movies without a vector or with several, and vectors without a movie."""
    spark = movies.sparkSession
    named = spark.createDataFrame([(x,) for x in languages], "language string")
    wanted = movies.select("movie_id").distinct().join(F.broadcast(named), F.lit(True)).withColumn("_wanted", F.lit(True))
    held = vectors.groupBy("language", "movie_id").agg(F.count(F.lit(1)).alias("_n"))
    problem = (F.when(F.col("_n").isNull(), "missing").when(F.col("_wanted").isNull(), "extra").when(F.col("_n") > 1, "repeated"))
    return wanted.join(held, ["language", "movie_id"], "full_outer").select("language", "movie_id", problem.alias("problem")).where(
        F.col("problem").isNotNull())


def paired_descriptor(catalog: DataFrame, vectors: DataFrame, formats: dict[str, str], profile: str, version: str) -> DataFrame:
    """One row that binds all language sets to one catalog: its digest and id set, and of each language the count, digests
    of ids, texts and vectors, and the text format. `complete` if every set has each catalog id once and no other.

    `identity` is the hash of all of it but `complete`: any other catalog, format, profile or set gives another one.
    """
    facts = bag_digest(catalog).select(F.col("rows").alias("records"), F.col("digest").alias("catalog_digest"))
    ids = bag_digest(catalog.select("movie_id")).select(F.col("digest").alias("ids_digest"))
    kinds = {"ids": ["movie_id"], "texts": ["movie_id", "fingerprint", "text_sha256"], "vectors": ["movie_id", "vector"]}
    columns, complete = [], F.lit(True)
    row = one_row(facts, ids)
    for name, held in kinds.items():
        found = bag_digest(vectors, held, by=["language"])
        sets = [F.max(F.when(F.col("language") == x, F.col("digest"))).alias(f"{x}_{name}") for x in formats]
        counts = [F.max(F.when(F.col("language") == x, F.col("rows"))).alias(f"{x}_rows") for x in formats] if name == "ids" else []
        others = [F.count_if(~F.col("language").isin(list(formats))).alias("_others")] if name == "ids" else []
        row = one_row(row, found.agg(*counts, *sets, *others))
    # The id set of the catalog has the same digest as that of a language only if each id stands once in both.
    single = catalog.groupBy("movie_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("_most"))
    row = one_row(row, single)
    for x in formats:
        complete = complete & F.coalesce(F.col(f"{x}_ids") == F.col("ids_digest"), F.lit(False))
        columns += [f"{x}_rows", f"{x}_ids", f"{x}_texts", f"{x}_vectors"]
    row = row.withColumn("complete", complete & (F.col("_others") == 0) & (F.col("_most") == 1))
    fixed = {"descriptor": "paired-release-v3", "version": version, "profile": profile, **{f"{x}_format": f for x, f in formats.items()}}
    for name, value in fixed.items():
        row = row.withColumn(name, F.lit(value))
    bound = [*fixed, "records", "catalog_digest", "ids_digest", *columns]
    return row.select(*bound, "complete", F.sha2(F.to_json(F.struct(*bound), {"ignoreNullFields": "false"}), 256).alias("identity"))


def cast_readiness(movies: DataFrame) -> DataFrame:
    """One row: digest of the cast mapping and of the actor vocabulary, to compare with pinned values."""
    from filmloom.operators.actors import vocabulary
    mapping = bag_digest(movies, ["movie_id", "cast"]).select(
        F.col("rows").alias("movies"), F.col("digest").alias("mapping_digest"))
    names = bag_digest(vocabulary(movies), ["name"]).select(
        F.col("rows").alias("names"), F.col("digest").alias("vocabulary_digest"))
    return one_row(mapping, names)


def marked_synthetic(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """Manifests in which any key or value says that the data are fake."""
    return manifests.where(F.lower(F.col(text)).contains("fake"))


def load_decision(target: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (decision): skip when equal, insert into an empty target, else refuse."""
    t = bag_digest(target, columns).select(F.col("rows").alias("target_rows"), F.col("digest").alias("_t"))
    s = bag_digest(source, columns).select(F.col("rows").alias("source_rows"), F.col("digest").alias("_s"))
    decision = (F.when(F.col("_t") == F.col("_s"), "skip").when(F.col("target_rows") == 0, "insert").otherwise("refuse"))
    return one_row(t, s).select("target_rows", "source_rows", decision.alias("decision"))
