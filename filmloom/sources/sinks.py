"""Writers: ordered exports, manifests, publish-once folders and the release pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmloom.operators.catalog import coverage
from filmloom.operators.evaluate import markdown
from filmloom.operators.release import bag_digest, chain_fingerprint, load_decision, pair_vectors, unpaired
from filmloom.operators.rules import GateError, one_row
from filmloom.sources.folders import create_once, read_text

Check = Callable[[DataFrame], DataFrame]


def write_ordered(df: DataFrame, path: str, key: str) -> None:
    """Parquet in id order: range partitions, sorted inside."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str, key: str, fields: Sequence[str] | None = None) -> None:
    """Compact JSON lines in id order over the part files, nulls written out."""
    columns = list(fields or df.columns)
    ordered = df.select(*columns).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "errorifexists").text(path)


def manifest(df: DataFrame, key: str, versions: dict[str, str], inputs: dict[str, str],
             excluded: DataFrame | None = None) -> DataFrame:
    """One row: versions, input hashes, count, first and last id, digest, exclusions and fingerprint."""
    facts = df.agg(F.count(F.lit(1)).alias("records"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    digest = bag_digest(df).select("digest")
    parts = [facts, digest]
    if excluded is not None:
        parts.append(excluded.agg(F.count(F.lit(1)).alias("excluded")))
    row = one_row(*parts)
    for name, value in {**versions, **inputs}.items():
        row = row.withColumn(name, F.lit(value))
    identity = [F.lit(v) for v in [*versions.values(), *inputs.values()]]
    return row.withColumn("fingerprint", chain_fingerprint(*identity))


def exclusion_list(excluded: DataFrame, key: str, reason: str = "reason") -> DataFrame:
    """(key, reason) of what a release leaves out, in order; a table beside the manifest's count."""
    why = F.col(reason) if reason in excluded.columns else F.lit("excluded")
    return excluded.select(key, why.cast("string").alias("reason")).orderBy(key)


def full_manifest(df: DataFrame, key: str, versions: dict[str, str], inputs: dict[str, str], columns: Sequence[str],
                  excluded: DataFrame | None = None) -> DataFrame:
    """The manifest with, for each named column, how many records have it and how many lack it."""
    present = [F.count(c).alias(f"{c}_present") for c in columns]
    row = one_row(manifest(df, key, versions, inputs, excluded), df.agg(*present))
    return row.withColumns({f"{c}_absent": F.col("records") - F.col(f"{c}_present") for c in columns})


def manifest_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return coverage(df, columns)


def publish_once(df: DataFrame, path: str, check: Check | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to a staging folder, check what was written, then move it to its place by one rename.

    An existing target is refused and left as it is. `check` returns a (rule, violations) report; if it fails, or
    anything else does, the staging folder goes, the target does not appear, and a later call may try again.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(f"{path} exists already")
    staging = jvm.org.apache.hadoop.fs.Path(f"{path}.staging-{uuid.uuid4().hex}")
    try:
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging.toString())
        if check is not None:
            _refuse(check(spark.read.schema(df.schema).parquet(staging.toString()).select(*df.columns)))
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(staging, target):
            raise FileExistsError(f"{path} exists already")
    finally:
        if files.exists(staging):
            files.delete(staging, True)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _refuse(report: DataFrame) -> None:
    """Raise if any rule is broken; the message shows some and says how many there are."""
    bad = report.where(F.col("violations") > 0)
    some = bad.limit(20).collect()
    if some:
        raise GateError(f"{bad.count()} rules broken, among them " + ", ".join(f"{r['rule']}={r['violations']}" for r in some))


_RELEASES = "name string, version bigint, path string, records bigint, digest string, fingerprint string"


def publish_release(df: DataFrame, root: str, name: str, version: int, fingerprint: str,
                    check: Check | None = None, partition_by: Sequence[str] = ()) -> str:
    """Publish the data, then switch readers by appending one release row."""
    path = f"{root}/{name}/v{version}"
    back = publish_once(df, path, check, partition_by)
    facts = bag_digest(back).select(
        F.lit(name).alias("name"), F.lit(version).cast("bigint").alias("version"), F.lit(path).alias("path"),
        F.col("rows").alias("records"), "digest", F.lit(fingerprint).alias("fingerprint"))
    facts.coalesce(1).write.mode("append").json(f"{root}/_releases")
    return path


def releases(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_RELEASES).json(f"{root}/_releases")


def current_release(spark: SparkSession, root: str) -> DataFrame:
    """The newest release row of every name."""
    fields = ["version", "path", "records", "digest", "fingerprint"]
    newest = releases(spark, root).groupBy("name").agg(F.max_by(F.struct(*fields), "version").alias("r"))
    return newest.select("name", "r.*")


def read_release(spark: SparkSession, root: str, name: str) -> DataFrame:
    row = current_release(spark, root).where(F.col("name") == name).first()
    if row is None:
        raise LookupError(f"no release of {name}")
    return spark.read.parquet(row["path"])


def write_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Vector sets by language folder, so that a search reads one language only."""
    ordered = vectors.repartitionByRange(F.col("language"), F.col("movie_id")).sortWithinPartitions("language", "movie_id")
    return publish_once(ordered, path, partition_by=["language"])


def publish_pair(descriptor: DataFrame, root: str) -> str:
    """Write a paired descriptor once: `written`, `kept` where the same one stands already; a different one is refused."""
    spark = descriptor.sparkSession
    row = descriptor.first().asDict()
    if not row.pop("complete"):
        raise GateError("a language set is not that of the catalog")
    path, text = f"{root}/paired-release.json", json.dumps(row, sort_keys=True)
    if create_once(spark, path, text):
        return "written"
    if read_text(spark, path) != text:
        raise GateError("another paired release stands there and is not overwritten")
    return "kept"


def replace_vectors(movies: DataFrame, vectors: DataFrame, root: str, version: int, fingerprint: str) -> str:
    """Publish a full paired set: every movie with both languages, or nothing at all."""
    paired = pair_vectors(vectors)
    problems = unpaired(movies, paired)
    some = problems.limit(20).collect()
    if some:
        raise GateError(f"{problems.count()} problems, among them " + ", ".join(f"{r['movie_id']}: {r['problem']}" for r in some))
    return publish_release(paired, root, "movie_embeddings", version, fingerprint)


def load_idempotent(target: DataFrame, source: DataFrame, path: str) -> str:
    """skip when the target already holds the source, insert into an empty target, refuse otherwise."""
    decision = load_decision(target, source, source.columns).first()["decision"]
    if decision == "refuse":
        raise GateError("the target holds other data")
    if decision == "insert":
        source.write.mode("errorifexists").parquet(path)
    return decision


def write_report(rows: DataFrame, path: str) -> None:
    """The evaluation report as JSON lines; `write_markdown` gives the readable table."""
    rows.write.mode("errorifexists").json(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    """The readable table as text, in order over the part files; every run is in it."""
    markdown(rows).write.mode("errorifexists").text(path)
