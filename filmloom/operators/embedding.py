"""Incremental embedding: what can be reused, what is pending, and the encoder and translator plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from filmloom.functions.normalize import with_nfc
from filmloom.functions.text import document_input, query_input, token_estimate
from filmloom.functions.vectors import document_fingerprint, is_valid_vector, pseudo_vector, text_hash, unit
from filmloom.session import new_dir

TEXT_FORMATS = {"en": "en-title-year-director-tags-v6", "sr": "sr-title-year-director-tags-v6"}
MAX_TOKENS = 512
MAX_BATCH = 128
CHUNK_ROWS = 1_000_000

# encode(list of texts) -> array of shape (texts, dimension)
Encoder = Callable[[list[str]], np.ndarray]
# count(list of texts) -> how many tokens the encoder makes of each before it cuts
TokenCounter = Callable[[list[str]], list[int]]
# translate(list of words) -> list of texts, None where no answer was completed
Translator = Callable[[list[str]], list[str | None]]


@dataclass(frozen=True)
class Model:
    """What a vector depends on: the encoder, the profile that names it and its settings, its size and what it reads.

    `factory` makes the encoder once in each task; with neither it nor `encoder`, vectors are those of `stand_in_vectors`.
    Without `counter`, tokens are estimated. A text of more than `limit` tokens is one that the encoder cuts.
    """
    profile: str
    dimension: int
    encoder: Encoder | None = None
    factory: Callable[[], Encoder] | None = None
    counter: TokenCounter | None = None
    limit: int = MAX_TOKENS
    batch_size: int = 32

    def tokens(self, text: Column) -> Column:
        """The encoder's own count of an input text, or the estimate; null for a null text."""
        if self.counter is None:
            return F.when(text.isNotNull(), token_estimate(text))
        counter = self.counter

        def count(inputs: pa.Array) -> pa.Array:
            numbers: list[int | None] = []
            for start in range(0, len(inputs), MAX_BATCH):
                texts = inputs.slice(start, MAX_BATCH).to_pylist()
                known = [t for t in texts if t is not None]
                found = list(counter(known)) if known else []
                if len(found) != len(known):
                    raise ValueError(f"counter returned {len(found)} numbers for {len(known)} texts")
                each = iter(found)
                numbers += [None if t is None else int(next(each)) for t in texts]
            return pa.array(numbers, pa.int64())

        return F.arrow_udf(count, "long")(text)


def expected_vectors(texts: DataFrame, profile: str, text: str = "text") -> DataFrame:
    """Adds fingerprint and text_sha256 to (movie_id, language, text)."""
    formats = F.create_map(*[F.lit(x) for pair in TEXT_FORMATS.items() for x in pair])
    return (texts.withColumn("fingerprint", document_fingerprint(
        F.col(text), F.col("language"), F.coalesce(formats[F.col("language")], F.lit("text-v1")), F.lit(profile)))
        .withColumn("text_sha256", text_hash(F.col(text))))


_IDENTITY = ["movie_id", "language", "fingerprint", "text_sha256"]


def match_prior(prior: DataFrame, expected: DataFrame, dimension: int, tolerance: float = 1e-4) -> DataFrame:
    """Expected rows with the prior vector of the same id, language, fingerprint and text hash, or null.

    A repeated prior row counts once: of different vectors of one identity that of the least hash.
    """
    valid = prior.where(is_valid_vector(F.col("vector"), dimension, tolerance)).select(*_IDENTITY, "vector", F.xxhash64("vector").alias("_h"))
    # Identities and a hash decide; vectors are then streamed past the decisions and never sorted.
    copies = valid.groupBy(*_IDENTITY, "_h").agg(F.count(F.lit(1)).alias("_n"))
    picked = copies.groupBy(*_IDENTITY).agg(F.min("_h").alias("_h"), F.max("_n").alias("_n"))
    columns = [*_IDENTITY, *[c for c in expected.columns if c not in _IDENTITY]]
    asked = expected.join(picked, _IDENTITY, "left").select(*columns, "_h", "_n")
    single = valid.join(asked.where("_n = 1").drop("_n").hint("shuffle_hash"), [*_IDENTITY, "_h"]).select(*columns, "vector")
    # Copies of a prior row are equal but for collisions of the hash, so the set of one identity is one vector.
    several = valid.join(asked.where("_n > 1").select(*_IDENTITY, "_h").distinct().hint("shuffle_hash"), [*_IDENTITY, "_h"], "left_semi")
    least = several.groupBy(*_IDENTITY).agg(F.array_min(F.collect_set("vector")).alias("vector"))
    repeated = least.join(asked.where("_n > 1").drop("_h", "_n").hint("shuffle_hash"), _IDENTITY).select(*columns, "vector")
    rest = asked.where("_n IS NULL").select(*columns, F.lit(None).cast(prior.schema["vector"].dataType).alias("vector"))
    return single.unionByName(repeated).unionByName(rest)


def reusable(prior: DataFrame, expected: DataFrame, dimension: int, tolerance: float = 1e-4) -> DataFrame:
    return match_prior(prior, expected.select(*_IDENTITY), dimension, tolerance).where(F.col("vector").isNotNull())


def pending(prior: DataFrame, expected: DataFrame, dimension: int, tolerance: float = 1e-4, nulls_match: bool = False) -> DataFrame:
    """Expected rows without a valid prior vector. With `nulls_match` a null text, whose hash is null, is found again too."""
    valid = prior.where(is_valid_vector(F.col("vector"), dimension, tolerance))
    if not nulls_match:
        return expected.join(valid.select(*_IDENTITY), _IDENTITY, "left_anti")
    known = valid.select(*[F.col(c).alias(f"_{c}") for c in _IDENTITY])
    return expected.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _IDENTITY], "left_anti")


def stand_in_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """The default encoder: a deterministic unit vector of the fingerprint, without any Python."""
    return rows.withColumn("vector", unit(pseudo_vector(F.col("fingerprint"), dimension)))


def encode(rows: DataFrame, encoder: Encoder, dimension: int, input_column: str = "input",
           batch_size: int = 32, out: str = "vector", factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """Run a user encoder over Arrow batches. Every text of a batch must get a vector of the right size.

    An encoder never sees a null: a row without input is encoded as the empty text, so that it has a vector as it has one of
    `stand_in_vectors`. Other columns pass as they are.
    With a `factory` each task makes its encoder once, so a model is loaded by the workers and never sent to them.
    """
    if not 1 <= batch_size <= MAX_BATCH:
        raise ValueError(f"batch size must be between 1 and {MAX_BATCH}")
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema]
    place = rows.columns.index(input_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = factory() if factory is not None else encoder
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = ["" if t is None else t for t in part.column(place).to_pylist()]
                vectors = np.asarray(use(texts), dtype=np.float32)
                if vectors.shape != (len(texts), dimension):
                    raise ValueError(f"encoder returned shape {vectors.shape}, expected {(len(texts), dimension)}")
                offsets = np.arange(len(texts) + 1, dtype=np.int32) * dimension
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def encode_with(rows: DataFrame, model: Model, input_column: str = "input") -> DataFrame:
    """Adds vector, profile, tokens and truncated, so that each vector says what made it and whether its text was cut."""
    counted = rows.withColumn("profile", F.lit(model.profile)).withColumn("tokens", model.tokens(F.col(input_column)))
    marked = counted.withColumn("truncated", F.coalesce(F.col("tokens") > model.limit, F.lit(False)))
    if model.encoder is None and model.factory is None:
        return stand_in_vectors(marked, model.dimension)
    return encode(marked, model.encoder, model.dimension, input_column, model.batch_size, factory=model.factory)


def model_audit(texts: DataFrame, model: Model, text: str = "text", by: str = "language") -> DataFrame:
    """(language, documents, truncated, longest) by the model's own count of its inputs, before anything is encoded."""
    inputs = document_inputs(texts, text)
    return token_audit(inputs, model.tokens(F.col("input")), by=by, limit=model.limit)


def translate(tags: DataFrame, translator: Translator, batch_size: int = 32) -> DataFrame:
    """(en, machine, completed, error) for pending tags. A failing batch is reported, not raised."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                words = frame["tag"].iloc[start:start + batch_size].tolist()
                try:
                    answers, error = list(translator(words)), "incomplete"
                    if len(answers) != len(words):
                        raise ValueError("translator returned a different number of texts")
                except Exception as problem:  # the keys stay retryable
                    answers, error = [None] * len(words), type(problem).__name__
                done = [isinstance(a, str) and bool(a.strip()) for a in answers]
                yield pd.DataFrame({"en": words, "machine": [a if d else None for a, d in zip(answers, done)],
                                    "completed": done, "error": [None if d else error for d in done]})

    return tags.select("tag").mapInPandas(run, "en string, machine string, completed boolean, error string")


def document_inputs(texts: DataFrame, text: str = "text") -> DataFrame:
    return with_nfc(texts, text, "_n").withColumn("input", document_input(F.col("_n"))).drop("_n")


def query_inputs(queries: DataFrame, text: str = "semantic_query") -> DataFrame:
    return with_nfc(queries, text, "_n").withColumn("input", query_input(F.col("_n"))).drop("_n")


def embed_incrementally(prior: DataFrame, texts: DataFrame, profile: str, dimension: int,
                        encoder: Encoder | None = None, batch_size: int = 32) -> tuple[DataFrame, DataFrame]:
    """(kept, fresh): the still valid prior vectors, and new vectors for the rest.

    Append `fresh` to the vector table; a later run then finds those rows in `prior`. Rows of another
    profile or of a changed text are not reused.
    """
    expected = expected_vectors(texts, profile)
    kept = reusable(prior, expected, dimension)
    rest = pending(prior, expected, dimension)
    if encoder is None:
        fresh = stand_in_vectors(rest, dimension)
    else:
        fresh = encode(document_inputs(rest), encoder, dimension, batch_size=batch_size)
    return kept, fresh.select(*_IDENTITY, "vector")


def embed_with(prior: DataFrame, texts: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """`embed_incrementally` by a model; fresh rows also have profile, tokens and truncated."""
    expected = expected_vectors(texts, model.profile)
    fresh = encode_with(document_inputs(pending(prior, expected, model.dimension)), model)
    return reusable(prior, expected, model.dimension), fresh.select(*_IDENTITY, "vector", "profile", "tokens", "truncated")


def embed_in_chunks(texts: DataFrame, path: str, profile: str, dimension: int, encoder: Encoder | None = None,
                    chunks: int | None = None, batch_size: int = 32, chunk: Column | None = None, rows: int = CHUNK_ROWS) -> None:
    """Encode what `path` lacks, chunk by chunk; each chunk is committed by a write of its own.

    A run that fails keeps the chunks it has committed. The next run reads them as prior vectors and encodes the rest; rows
    without a text are committed once like all others.
    What is missing is found once, with all fingerprints, and written by chunks of about `rows` rows, or by `chunks` of them.
    """
    spark = texts.sparkSession
    ddl = "movie_id long, language string, fingerprint string, text_sha256 string, vector array<float>"
    spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{path}/chunk=-1")
    prior = spark.read.schema(f"{ddl}, chunk int").parquet(path)
    missing = pending(prior, expected_vectors(texts, profile), dimension, nulls_match=True)
    n = chunks if chunks is not None else -(-missing.count() // rows)
    place = chunk if chunk is not None else F.pmod(F.xxhash64("movie_id", "language"), F.lit(max(n, 1))).cast("int")
    placed, todo = missing.withColumn("chunk", place.cast("int")), new_dir(spark, "pending")
    # A chunk is spread over a few tasks, so that none holds all its texts and its files stay few.
    spread = F.pmod(F.xxhash64("text_sha256", "movie_id"), F.lit(8))
    placed.repartition("chunk", spread).write.partitionBy("chunk").parquet(todo)
    for k in range(n):
        rest = spark.read.schema(placed.schema).parquet(todo).where(F.col("chunk") == k).drop("chunk")
        fresh = stand_in_vectors(rest, dimension) if encoder is None else encode(
            document_inputs(rest), encoder, dimension, batch_size=batch_size)
        fresh.select(*_IDENTITY, F.col("vector").cast("array<float>")).write.mode("append").parquet(f"{path}/chunk={k}")


def refuse_truncated(audit: DataFrame) -> None:
    """Refuse to publish vectors of texts that the encoder would cut."""
    from filmloom.operators.rules import GateError
    cut = audit.where("truncated > 0").collect()  # one row for each language
    if cut:
        raise GateError("texts are cut: " + ", ".join(f"{r[0]}={r['truncated']}" for r in cut))


def token_audit(documents: DataFrame, tokens: Column | None = None, text: str = "text",
                by: str = "language", limit: int = MAX_TOKENS) -> DataFrame:
    """(language, documents, truncated, longest). `tokens` is the plug-in count; the default is the estimate."""
    count = tokens if tokens is not None else token_estimate(document_input(F.col(text)))
    counted = documents.select(by, F.coalesce(count, F.lit(0)).alias("_t"))
    return counted.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("_t") > limit).alias("truncated"),
                                   F.max("_t").alias("longest"))


def mean_pool(tokens: DataFrame, key: str = "doc_id", vector: str = "vector", mask: str = "mask") -> DataFrame:
    """(doc, vector): mean of the unmasked token vectors, scaled to unit length.

    Sums run as one partial aggregate per document with Spark's vector summarizer; nothing is exploded.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    active = tokens.where(F.col(mask) != 0).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    means = active.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(key, vector_to_array("_m").alias("_m")).select(key, unit(F.col("_m")).alias("vector"))


def unpooled(tokens: DataFrame, key: str = "doc_id", mask: str = "mask") -> DataFrame:
    """Documents whose mask has no active token."""
    return tokens.groupBy(key).agg(F.count_if(F.col(mask) != 0).alias("active")).where("active = 0").select(key)


def canary_drift(stored: DataFrame, current: DataFrame, key: str = "movie_id") -> DataFrame:
    """(movie, drift, ok) between a stored canary vector and the current one."""
    from filmloom.functions.vectors import matches_canary, max_abs_difference
    a, b = stored.select(key, F.col("vector").alias("_a")), current.select(key, F.col("vector").alias("_b"))
    return a.join(b, key).select(key, max_abs_difference(F.col("_a"), F.col("_b")).alias("drift"),
                                 matches_canary(F.col("_a"), F.col("_b")).alias("ok"))
