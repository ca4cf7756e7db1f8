"""Releases of a catalog and all its language sets, switched together by a log of whole states.

A commit is the next numbered file of the log, created only if no other writer has created it. It holds the catalog row
and one row per language, so readers see all rows of one release or all of another. Data are written before, into folders
of their own; a writer that loses leaves the state as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmloom.operators.release import bag_digest, language_readiness, paired_problems
from filmloom.operators.rules import GateError
from filmloom.sources.folders import create_once, names_in, read_text
from filmloom.sources.sinks import publish_once

STATE = "version long, kind string, language string, records long, digest string, fingerprint string, format string, path string"
_DIGITS = 12


class ConflictError(RuntimeError):
    """Another writer has committed since the state was read."""


@dataclass(frozen=True)
class LanguageSet:
    """What a language's state row says beside its counts."""

    language: str
    text_format: str
    profile: str


def _log(root: str) -> str:
    return f"{root}/_log"


def version_of(spark: SparkSession, root: str) -> int:
    """The number of the last commit; 0 before the first."""
    return max((int(n.split(".")[0]) for n in names_in(spark, _log(root)) if n.endswith(".json")), default=0)


def state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The catalog row and the language rows of a commit, the last one unless another is named."""
    number = version_of(spark, root) if version is None else version
    text = read_text(spark, f"{_log(root)}/{number:0{_DIGITS}d}.json") if number else None
    rows = [] if text is None else json.loads(text)["rows"]
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    return spark.createDataFrame([tuple(number if n == "version" else r.get(n) for n in names) for r in rows], STATE)


def commit(spark: SparkSession, root: str, rows: Sequence[dict], read_version: int) -> int:
    """Make `rows` the state, if it still is that of `read_version`; the new version."""
    kinds = [r["kind"] for r in rows]
    languages = [r["language"] for r in rows if r["kind"] == "language"]
    if kinds.count("catalog") != 1 or len(set(languages)) != len(languages) or len(languages) != len(rows) - 1 or not languages:
        raise GateError("a release has one catalog row and one row for each language")
    text = json.dumps({"previous": read_version, "rows": list(rows)}, sort_keys=True)
    if version_of(spark, root) != read_version or not create_once(spark, f"{_log(root)}/{read_version + 1:0{_DIGITS}d}.json", text):
        raise ConflictError(f"the state has moved on from version {read_version}")
    return read_version + 1


def publish(movies: DataFrame, vectors: DataFrame, root: str, catalog_fingerprint: str, sets: Sequence[LanguageSet],
            dimension: int, read_version: int | None = None) -> int:
    """Write a catalog and its vectors, check that every language covers it, and switch all state rows at once.

    `movies` has a movie_id; `vectors` movie_id, language, fingerprint, text_sha256 and vector. Nothing becomes visible
    unless every language of `sets`, and no other, has one valid vector for every movie.
    """
    spark = movies.sparkSession
    based_on = version_of(spark, root) if read_version is None else read_version
    place = f"{root}/data/{uuid.uuid4().hex}"
    catalog = publish_once(movies, f"{place}/movies")
    stored = publish_once(vectors, f"{place}/vectors", partition_by=["language"])
    names = [s.language for s in sets]
    claims = spark.createDataFrame([(n, 1) for n in names], "language string, n int").join(
        catalog.agg(F.count(F.lit(1)).alias("embedded_count")), F.lit(True)).drop("n")
    ready = {r["language"]: r for r in language_readiness(catalog, stored, claims, dimension).collect()}
    bad = sorted(n for n in {*names, *ready} if n not in names or n not in ready or not ready[n]["ready"])
    if bad:
        raise GateError("not ready: " + ", ".join(bad) + _some(paired_problems(catalog, stored, names)))
    facts = bag_digest(catalog).first()
    digests = {r["language"]: r for r in bag_digest(stored, ["movie_id", "fingerprint", "text_sha256", "vector"], by=["language"]).collect()}
    rows = [{"kind": "catalog", "language": None, "records": facts["rows"], "digest": facts["digest"], "fingerprint": catalog_fingerprint,
             "format": None, "path": f"{place}/movies"}]
    rows += [{"kind": "language", "language": s.language, "records": digests[s.language]["rows"], "digest": digests[s.language]["digest"],
              "fingerprint": s.profile, "format": s.text_format, "path": f"{place}/vectors"} for s in sets]
    return commit(spark, root, rows, based_on)


def _some(problems: DataFrame) -> str:
    return "".join(f"; {r['language']} {r['movie_id']}: {r['problem']}" for r in problems.limit(10).collect())


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The movies of the current release."""
    return spark.read.parquet(_path(spark, root, "catalog"))


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The vectors of the current release."""
    return spark.read.parquet(_path(spark, root, "language"))


def _path(spark: SparkSession, root: str, kind: str) -> str:
    row = state(spark, root).where(F.col("kind") == kind).first()
    if row is None:
        raise LookupError("no release yet")
    return row["path"]
