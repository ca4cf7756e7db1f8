"""Vector release: texts and earlier vectors to a published paired set, all gates on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmloom.operators import embedding as EM, release as R
from filmloom.operators.rules import GateError
from filmloom.session import materialize
from filmloom.sources import sinks


def build(movies: DataFrame, texts: DataFrame, prior: DataFrame, profile: str, dimension: int, root: str, version: int,
          encoder: EM.Encoder | None = None, counter: EM.TokenCounter | None = None) -> str:
    """Path of the new release. Texts that would be cut, and vectors that do not match them, stop the build.

    With a `counter`, the encoder's own count decides what would be cut, else an estimate.
    """
    EM.refuse_truncated(EM.model_audit(texts, EM.Model(profile, dimension, encoder, counter=counter)))
    expected = EM.expected_vectors(texts, profile)
    kept, fresh = EM.embed_incrementally(prior, texts, profile, dimension, encoder)
    vectors = materialize(kept.select(*fresh.columns).unionByName(fresh), "vectors")
    for language in sorted(EM.TEXT_FORMATS):
        here = F.col("language") == language
        problems = R.vector_set_problems(expected.where(here), vectors.where(here), dimension)
        counts = problems.groupBy("problem").count().collect()  # a handful of kinds
        if counts:
            raise GateError(f"{language}: " + ", ".join(sorted(f"{r['problem']}={r['count']}" for r in counts)))
    fingerprint = R.paired_release(vectors).first()["pair_fingerprint"]
    return sinks.replace_vectors(movies, vectors, root, version, fingerprint)
