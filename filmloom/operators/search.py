"""Filter first, then rank exactly: one query with Catalyst, many queries with a block kernel.

Vectors and query vectors that cannot be compared never reach a kernel, in whatever table they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmloom import vocab
from filmloom.functions.text import is_blank
from filmloom.functions.vectors import cosine_distance, is_valid_vector, l2_norm
from filmloom.operators.filters import ARRAY_FIELDS, FIELDS, filter_movies, has_active_filter
from filmloom.operators.release import language_readiness
from filmloom.operators.rules import GateError, Rule
from filmloom.session import new_dir, spread
from filmloom.sources.folders import names_in

LIMIT = vocab.RESULT_LIMIT
# Summation order differs between kernels; equal vectors must still tie, so distances are rounded before ranking.
DISTANCE_DIGITS = 12
CARD = ["movie_id", "title", "year", "imdb_id", "poster_path", "average_rating", "rating_count"]

_SCALE = 10 ** 12
_BIG = 2 ** 62


def hard_order() -> list[Column]:
    return [F.desc_nulls_last("rating_count"), F.desc_nulls_last("average_rating"), F.asc("movie_id")]


def search_hard_only(movies: DataFrame, criteria: Mapping[str, Any], limit: int = LIMIT) -> DataFrame:
    """Most rated first among the movies that pass. Needs at least one active filter, never vectors."""
    if all(criteria.get(f) is None for f in FIELDS if f != "rating_operator"):
        raise ValueError("hard-only ranking needs at least one active filter")
    return filter_movies(movies, criteria).orderBy(*hard_order()).limit(limit)


def search_hybrid(movies: DataFrame, vectors: DataFrame, criteria: Mapping[str, Any], query_vector: Sequence[float],
                  language: str | None = None, limit: int = LIMIT) -> DataFrame:
    """All filters, then exact cosine distance and id. `vectors` is long: movie_id, language, vector[, norm].

    Plain expressions, so filters and columns are pushed down. `batch_hybrid` gives the same rows faster when
    many vectors stay eligible, also for a one-row table of queries.
    """
    checked = check_query_vector(query_vector)
    chosen = vectors.where(is_valid_vector(F.col("vector"), int(checked.size)))
    chosen = chosen if language is None else chosen.where(F.col("language") == language)
    norm = F.col("norm") if "norm" in vectors.columns else l2_norm(F.col("vector"))
    q = F.array(*[F.lit(float(x)) for x in checked])
    eligible = filter_movies(movies, criteria)
    scored = eligible.join(chosen.select("movie_id", "vector", norm.alias("norm")), "movie_id")
    length = float(np.sqrt(np.dot(checked, checked)))
    distance = cosine_distance(F.col("vector"), q, F.col("norm"), F.lit(length))
    return (scored.withColumn("distance", F.round(distance, DISTANCE_DIGITS)).drop("vector", "norm")
            .where(F.col("distance").isNotNull()).orderBy("distance", "movie_id").limit(limit))


def check_query_vector(vector: Sequence[float]) -> np.ndarray:
    values = np.asarray(vector, dtype=np.float64)
    if values.ndim != 1 or values.size == 0 or not np.isfinite(values).all() or not float(np.dot(values, values)) > 0:
        raise ValueError("query vector must be finite and not zero")
    return values


def query_vector_rules(dimension: int, column: str = "query_vector") -> list[Rule]:
    """For a queries table: a vector is either absent or usable."""
    return [Rule("query_vector", F.col(column).isNull() | is_valid_vector(F.col(column), dimension))]


def serving_table(movies: DataFrame, vectors: DataFrame) -> DataFrame:
    """Filter columns beside the vector and its norm, one row per movie and language.

    Built once per release and written with partitionBy('language'): searches then read it without any join. Vectors
    that are null, zero or not finite, or hold null elements, are left out; `unusable_vectors` reports them.
    """
    wanted = ["movie_id", "year", "runtime_minutes", "genres", "average_rating", "rating_count",
              "original_language", "cast"]
    long = vectors.where(usable_vector(F.col("vector"))).select(
        "movie_id", "language", "vector", l2_norm(F.col("vector")).alias("norm"))
    return movies.select(*wanted).join(long, "movie_id")


def usable_vector(v: Column) -> Column:
    """Whether a vector of its own length can be compared: no null, finite, not zero."""
    return is_valid_vector(v, F.size(v))


def unusable_vectors(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """(movie_id, language) of vectors that no search can use."""
    good = usable_vector(F.col("vector")) if dimension is None else is_valid_vector(F.col("vector"), dimension)
    return vectors.where(~good).select("movie_id", "language")


def ready_for_search(movies: DataFrame, vectors: DataFrame, states: DataFrame, dimension: int) -> DataFrame:
    """Refuse to search a release in which any listed language lacks a vector, holds a bad one, or has a wrong state."""
    bad = language_readiness(movies, vectors, states, dimension).where(~F.col("ready")).select("language").collect()
    if bad:
        raise GateError("languages not ready: " + ", ".join(sorted(str(r["language"]) for r in bad)))
    return serving_table(movies, vectors)


# --- many queries ---------------------------------------------------------------------------------------

_TOP_SCHEMA = "query_id string, movie_id long, k1 double, k2 long, k3 long"
_ARRAYS = {"genres": ("genres_all", "genres_any", None), "cast": ("actors_all", "actors_any", "actors_exclude")}
_BOUNDS = [("year", "year_min", np.greater_equal), ("year", "year_max", np.less_equal),
           ("runtime", "runtime_min", np.greater_equal), ("runtime", "runtime_max", np.less_equal)]


def _fixed_point(column: str) -> Column:
    """Ratings as whole 1e-12 units, so that comparisons stay exact."""
    return (F.col(column).cast("decimal(16,12)") * F.lit(_SCALE)).cast("long")


def _least_units() -> Column:
    """The least rating in whole units that passes: at least the bound rounded up, or above it rounded down."""
    units = F.col("rating_min").cast("decimal(20,18)").cast("decimal(38,18)") * F.lit(_SCALE).cast("decimal(13,0)")
    above = F.floor(units).cast("long") + 1
    return F.when(F.col("rating_operator") == "gt", above).otherwise(F.ceil(units).cast("long"))


def _movie_side(table: DataFrame, with_vector: bool) -> DataFrame:
    columns = [F.col("movie_id").cast("long"), F.col("year").cast("double"),
               F.col("runtime_minutes").cast("double").alias("runtime"), "genres", "cast",
               F.col("original_language").alias("lang_code"),
               _fixed_point("average_rating").alias("rating"),
               F.col("rating_count").cast("long").alias("votes")]
    if with_vector:
        columns += ["language", "vector", F.col("norm").cast("double")]
    return table.select(*columns)


def _query_side(queries: DataFrame, with_vector: bool) -> DataFrame:
    columns = [F.col("query_id").cast("string"), *[F.col(f).cast("double") for f in
                                                   ("year_min", "year_max", "runtime_min", "runtime_max")],
               *ARRAY_FIELDS, _least_units().alias("rating_min"), "original_language"]
    if with_vector:
        columns += ["language", F.col("query_vector").cast("array<double>").alias("query_vector")]
    return queries.select(*columns)


class _Block:
    """A bounded set of queries, ready to be compared with batches of movies."""

    def __init__(self, queries: pa.Table, limit: int, with_vector: bool):
        self.limit, self.with_vector = limit, with_vector
        asked = {c: queries.column(c).to_pylist() for c in queries.column_names if c not in ("query_vector", "language")}
        self.ids = np.array(asked["query_id"], dtype=object)
        # Queries with equal bounds or labels share a test: (place of each query among the different tests or -1, tests).
        self.bounds = {f: _different([None if x != x else x for x in asked[f]]) for _, f, _ in _BOUNDS}  # NaN is no bound
        self.rating = _different(asked["rating_min"])
        self.code = _different(asked["original_language"])
        self.lists, self.labels = {}, {}
        for array, fields in _ARRAYS.items():
            used = sorted({x for f in fields if f for labels in asked[f] if labels for x in labels})
            index = {x: i for i, x in enumerate(used)}
            self.labels[array] = pa.array(used, pa.string())
            self.lists[array] = [self._group(asked[f], index) if f else None for f in fields]
        if with_vector:
            matrix = _matrix(queries.column("query_vector"))
            self.matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            self.rough, self.plain = _rough(self.matrix)

    @staticmethod
    def _group(lists: list[list[str] | None], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """(place of each query or -1, different label sets x labels indicator) of one filter group."""
        place, sets = _different([None if labels is None else tuple(sorted({index[x] for x in labels})) for labels in lists])
        if not sets:
            return None
        wanted = np.zeros((len(sets), len(index)), dtype=np.float32)
        for row, labels in enumerate(sets):
            wanted[row, list(labels)] = 1
        return place, wanted

    def passes(self, batch: pa.Table, queries: np.ndarray) -> np.ndarray:
        """Boolean queries x movies: every active filter holds; unknown metadata fails."""
        return np.unpackbits(self.passing(batch, queries), axis=1, count=batch.num_rows).view(bool)

    def passing(self, batch: pa.Table, queries: np.ndarray) -> np.ndarray:
        """The same as bits, eight movies to a byte. Each different test meets the movies once."""
        bits = np.full((queries.size, -(-batch.num_rows // 8)), 255, dtype=np.uint8)

        def hold(place: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> None:
            mine = place[queries]
            on = np.flatnonzero(mine >= 0)
            if on.size:
                used, which = np.unique(mine[on], return_inverse=True)
                bits[on] &= np.packbits(test(used), axis=1)[which]

        for column, field, compare in _BOUNDS:
            place, values = self.bounds[field]
            if len(values):
                known, bound = _doubles(batch, column), np.array(values, dtype=np.float64)
                hold(place, lambda used: compare(known[None, :], bound[used][:, None]))
        place, values = self.rating
        if len(values):
            (rating, rated), low = _longs(batch, "rating"), np.array(values, dtype=np.int64)
            hold(place, lambda used: rated[None, :] & (rating[None, :] >= low[used][:, None]))
        place, values = self.code
        if len(values):
            codes = _index_in(batch, "lang_code", pa.array(values, pa.string()))
            hold(place, lambda used: codes[None, :] == used[:, None])
        for array, groups in self.lists.items():
            if any(g is not None for g in groups):
                held, listed = _membership(batch.column(array).combine_chunks(), self.labels[array])
                for group, suits in zip(groups, _SUITS):
                    if group is not None:
                        place, wanted = group
                        hold(place, lambda used: listed[None, :] & suits(wanted[used] @ held.T, wanted[used].sum(axis=1)[:, None]))
        return bits

    def near(self, batch: pa.Table, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """(movie row, query, distance) candidates: at least the nearest `limit` per query, all ties kept.

        `known` is the last distance of a query's full list, or infinity: nothing beyond it is taken. A product in single
        precision, whose error is bounded, leaves out what is surely farther; distances of the rest are taken exactly.
        """
        vectors, norms, n = _matrix(batch.column("vector")), _doubles(batch, "norm"), batch.num_rows
        with np.errstate(all="ignore"):
            rough_vectors, plain = _rough(vectors / norms[:, None])
        columns = rough_vectors.T
        slack = (vectors.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -DISTANCE_DIGITS
        cut = _below(np.where(self.plain, 1.0 - known - slack, -np.inf))
        bits, odd = self.passing(batch, np.arange(len(self.ids))), np.packbits(~plain)[None, :]
        rows = max(16, _CACHED // max(1, n))  # few enough queries that their products stay in the cache
        for start in range(0, len(self.ids), rows):
            some = slice(start, start + rows)
            bits[some] &= np.packbits(self.rough[some] @ columns >= cut[some, None], axis=1) | odd
        # Lists that many rows could enter: what lies beyond the nearest `limit` of this batch is left out as well.
        many = np.flatnonzero(self.plain & (np.bitwise_count(bits).sum(axis=1, dtype=np.int64) > 4 * self.limit + 8))
        for start in range(0, many.size, rows):
            some = many[start:start + rows]
            rough = self.rough[some] @ columns
            rough[~np.unpackbits(bits[some], axis=1, count=n).view(bool) | ~plain[None, :]] = -np.inf
            worst = np.partition(rough, n - self.limit, axis=1)[:, n - self.limit].astype(np.float64)
            bits[some] &= np.packbits(rough >= _below(worst - 2 * slack)[:, None], axis=1) | odd
        cols, places = np.nonzero(bits)
        which, bit = np.nonzero(np.unpackbits(bits[cols, places][:, None], axis=1))
        cols, rows = cols[which], places[which] * 8 + bit
        fits = rows < n  # the last byte of a query without filters has bits beyond the last row
        cols, rows = cols[fits], rows[fits]
        scores, step = np.empty(rows.size), max(256, _CELLS // vectors.shape[1])
        for start in range(0, rows.size, step):
            r, c = rows[start:start + step], cols[start:start + step]
            scores[start:start + step] = _distances(self.matrix[c], vectors[r], norms[r])
        keep = np.isfinite(scores) & (scores <= known[cols])
        return rows[keep], cols[keep], scores[keep]

    def first(self, batch: pa.Table, queries: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(movie row, query): the first passing rows of an already ordered batch, `room` per query."""
        cols, rows = np.nonzero(self.passes(batch, queries))
        starts = np.searchsorted(cols, np.arange(queries.size))
        keep = (np.arange(cols.size) - starts[cols]) < room[cols]
        return rows[keep], queries[cols[keep]]


# By group: all, any and none of the wanted labels, from the number that a movie holds and the number wanted.
_SUITS = (lambda n, want: n == want, lambda n, want: n > 0, lambda n, want: n == 0)


def _different(values: list) -> tuple[np.ndarray, list]:
    """(place of each value among the different ones, -1 for null; the different values)."""
    found: dict = {}
    return np.array([-1 if v is None else found.setdefault(v, len(found)) for v in values], dtype=np.int64), list(found)


def _rough(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, and which rows are of unit length: the others are zero here and bound nothing."""
    plain = np.abs(np.sqrt(np.einsum("ij,ij->i", units, units)) - 1.0) <= 1e-3
    return np.where(plain[:, None], units, 0.0).astype(np.float32), plain


def _distances(units: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Distances of pairs, row by row."""
    with np.errstate(all="ignore"):
        return np.round(1.0 - np.einsum("ij,ij->i", units, vectors) / norms, DISTANCE_DIGITS)


def _below(cut: np.ndarray) -> np.ndarray:
    """Single precision numbers that are not above the given ones."""
    return np.nextafter(cut.astype(np.float32), np.float32(-np.inf))


def _hard_keys(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    votes, votes_known = _longs(batch, "votes")
    rating, rating_known = _longs(batch, "rating")
    return np.where(votes_known, -votes, _BIG), np.where(rating_known, -rating, _BIG)


def _doubles(batch: pa.Table, column: str) -> np.ndarray:
    return batch.column(column).to_numpy().astype(np.float64, copy=False)


def _longs(batch: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(column)
    return pc.fill_null(values, 0).to_numpy(), pc.is_valid(values).to_numpy()


def _index_in(batch: pa.Table, column: str, labels: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(batch.column(column), value_set=labels), -2).to_numpy()


def _membership(values: pa.ListArray, labels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """movies x labels: is the label in the movie's array; and is the array known and not empty."""
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.index_in(values.flatten(), value_set=labels), -1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(values)), lengths)
    held = np.zeros((len(values), len(labels)), dtype=np.float32)
    hit = flat >= 0
    held[rows[hit], flat[hit]] = 1
    return held, lengths > 0


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    array = vectors.combine_chunks()
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1).astype(np.float64)


class _Best:
    """Running top list per query over the batches of one task."""

    def __init__(self, limit: int):
        self.limit, self.state = limit, None

    def add(self, ids: np.ndarray, cols: np.ndarray, k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> None:
        new = (cols, k1, k2, k3, ids)
        merged = new if self.state is None else tuple(np.concatenate(p) for p in zip(self.state, new))
        cols, k1, k2, k3, ids = merged
        order = np.lexsort((ids, *[k for k in (k3, k2, k1) if k.size and k.min() != k.max()], cols))
        sorted_cols = cols[order]
        first = np.searchsorted(sorted_cols, sorted_cols, side="left")
        keep = order[(np.arange(order.size) - first) < self.limit]
        self.state = tuple(p[keep] for p in merged)

    def last(self, queries: int) -> np.ndarray:
        """The last first key of each full list, infinity for the others."""
        out = np.full(queries, np.inf)
        if self.state is not None:
            cols, k1 = self.state[:2]
            worst = np.full(queries, -np.inf)
            np.maximum.at(worst, cols, k1)
            full = np.bincount(cols, minlength=queries) >= self.limit
            out[full] = worst[full]
        return out

    def to_batch(self, query_ids: np.ndarray) -> pa.RecordBatch | None:
        if self.state is None or not self.state[0].size:
            return None
        cols, k1, k2, k3, ids = self.state
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[cols], pa.string()), pa.array(ids, pa.int64()), pa.array(k1, pa.float64()),
             pa.array(k2, pa.int64()), pa.array(k3, pa.int64())], names=["query_id", "movie_id", "k1", "k2", "k3"])


# Cells of the queries x movies matrices, and numbers of their vectors, that are worked on at a time; cells of a product that
# are held at a time; candidates that wait to be merged.
_CELLS = 4_000_000
_CACHED = 1 << 18
_WAITING = 1 << 20


def _scan(block: _Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = _Best(block.limit)
    seen = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if block.with_vector:
            seen = _scan_near(block, table, best, seen)
        else:
            _scan_ordered(block, table, best)
    result = best.to_batch(block.ids)
    if result is not None:
        yield result


def _scan_near(block: _Block, table: pa.Table, best: _Best, seen: int) -> int:
    """Candidates are merged whenever as many rows have been passed as before: few merges, and bounds that keep pace."""
    step = max(256, _CELLS // max(1, *block.matrix.shape))
    ids, known = table.column("movie_id").to_numpy(), best.last(len(block.ids))
    found, waiting, passed = [], 0, 0
    for start in range(0, table.num_rows, step):
        part = table.slice(start, step)
        rows, cols, distance = block.near(part, known)
        found.append((ids[start + rows], cols, distance))
        waiting, passed = waiting + rows.size, passed + part.num_rows
        if passed >= seen or waiting > _WAITING or start + step >= table.num_rows:
            movie, cols, distance = (np.concatenate(p) for p in zip(*found))
            if movie.size:
                zero = np.zeros(movie.size, dtype=np.int64)
                best.add(movie, cols, distance, zero, zero)
            known, seen, found, waiting, passed = best.last(len(block.ids)), seen + passed, [], 0, 0
    return seen


def _scan_ordered(block: _Block, table: pa.Table, best: _Best) -> None:
    """The batch in hard order, in growing steps; a query leaves as soon as its list is full."""
    k2, k3 = _hard_keys(table)
    order = np.lexsort((table.column("movie_id").to_numpy(), k3, k2))
    table, k2, k3 = table.take(pa.array(order)), k2[order], k3[order]
    ids = table.column("movie_id").to_numpy()
    open_queries, room = np.arange(len(block.ids)), np.full(len(block.ids), block.limit)
    start, step = 0, 256
    while start < table.num_rows and open_queries.size:
        step = max(256, min(step, _CELLS // open_queries.size))
        rows, cols = block.first(table.slice(start, step), open_queries, room[open_queries])
        rows += start
        best.add(ids[rows], cols, np.zeros(rows.size), k2[rows], k3[rows])
        room -= np.bincount(cols, minlength=room.size)
        open_queries = open_queries[room[open_queries] > 0]
        start, step = start + step, step * 2


def _rank_block(table: DataFrame, queries: DataFrame, limit: int, with_vector: bool, max_block: int) -> DataFrame:
    """Local top lists. Queries go in blocks of bounded size to the movies, which are dealt out evenly and read once.

    With vectors a block holds one language and one length of vector, so a pass reads that language alone and every
    cell of its matrix product counts. Queries of one block are sent out; more are written as blocks to the shared
    folder, and tasks read them from there, one after the other, so neither the driver nor a task ever holds all.
    """
    movie_side, query_side = _movie_side(table, with_vector), _query_side(queries, with_vector)
    kind = [F.col("language"), F.size("query_vector").alias("d")] if with_vector else [F.lit(None).alias("language"), F.lit(0).alias("d")]
    counts = query_side.groupBy(*kind).count().orderBy("language", "d").collect()
    context, found = table.sparkSession.sparkContext, None
    for row in counts:
        asked, movies = query_side, movie_side
        if with_vector:
            asked = asked.where((F.col("language") == row["language"]) & (F.size("query_vector") == row["d"]))
            movies = movies.where((F.col("language") == row["language"]) & (F.size("vector") == row["d"]))
        # Wide query vectors make smaller blocks: a block is bounded in bytes, not in rows alone.
        most = max(1, min(max_block, _BLOCK_BYTES // (8 * (row["d"] + 64))))
        parts = -(-row["count"] // most)
        if parts == 1:
            scan = _scanner(context.broadcast(_Block(asked.toArrow(), limit, with_vector)))
        else:
            scan = _folder_scanner(_written_blocks(asked, parts), limit, with_vector)
        # Each task passes all queries of a language by its movies and keeps ten of each: one task a core for each of several.
        dealt = spread(movies) if len(counts) == 1 else movies.repartition(context.defaultParallelism)
        top = dealt.mapInArrow(scan, _TOP_SCHEMA)
        found = top if found is None else found.unionByName(top)
    return found if found is not None else table.sparkSession.createDataFrame([], _TOP_SCHEMA)


_BLOCK_BYTES = 64 << 20
_PASS_BYTES = 64 << 20


def _scanner(shared):
    return lambda batches: _scan(shared.value, batches)


def _written_blocks(asked: DataFrame, parts: int) -> list[str]:
    """Folders of the query blocks in the shared folder, which tasks must be able to open by Arrow's file systems."""
    folder = new_dir(asked.sparkSession, "queries")
    (asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).repartition(parts, "part")
     .write.partitionBy("part").parquet(folder))
    return [f"{folder}/{name}" for name in names_in(asked.sparkSession, folder)]


def _folder_scanner(folders: list[str], limit: int, with_vector: bool):
    """Holds some MB of movies at a time and passes all blocks by them; each pass leaves its own top lists."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _PASS_BYTES:
                yield from _passes(folders, limit, with_vector, held)
                held, size = [], 0
        if held:
            yield from _passes(folders, limit, with_vector, held)

    return scan


def _passes(folders: list[str], limit: int, with_vector: bool, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    movies = pa.Table.from_batches(held).combine_chunks().to_batches()
    for folder in folders:
        files, place = pafs.FileSystem.from_uri(folder)
        block = pq.read_table(place, filesystem=files, partitioning=None)
        yield from _scan(_Block(block, limit, with_vector), iter(movies))


def top_per_query(candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Merge the local lists. The limit is applied before and after the shuffle."""
    w = Window.partitionBy("query_id").orderBy("k1", "k2", "k3", "movie_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def can_ask(dimension: int | None = None) -> Column:
    """Whether a query row has a language and a vector that can be compared; of a given length, if one is given."""
    v = F.col("query_vector")
    good = usable_vector(v) if dimension is None else is_valid_vector(v, dimension)
    return F.coalesce(F.col("language").isNotNull() & good, F.lit(False))


def batch_hybrid(serving: DataFrame, queries: DataFrame, limit: int = LIMIT, max_block: int = 4096) -> DataFrame:
    """(query_id, rank, movie_id, distance) for a table of queries with a language and a query_vector.

    No pair of query and movie is ever a row: a task holds one block of queries and keeps ten per query.
    Queries without a usable vector get nothing; `query_vector_rules` names them. A vector meets those of its own length.
    """
    found = _rank_block(serving.where(usable_vector(F.col("vector"))), queries.where(can_ask()), limit, True, max_block)
    return top_per_query(found, limit).select("query_id", "rank", "movie_id", F.col("k1").alias("distance"))


def batch_hard_only(movies: DataFrame, queries: DataFrame, limit: int = LIMIT, max_block: int = 4096) -> DataFrame:
    """(query_id, rank, movie_id) by rating count, average and id. Queries without a filter get nothing.

    Queries with equal filters have the same list, which is made once.
    """
    filters = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    active = queries.where(has_active_filter()).select(F.col("query_id").cast("string"), *FIELDS, F.sha2(filters, 256).alias("same"))
    different = active.drop("query_id").withColumnRenamed("same", "query_id").dropDuplicates(["query_id"])
    found = top_per_query(_rank_block(movies, different, limit, False, max_block), limit)
    lists = found.select(F.col("query_id").alias("same"), "rank", "movie_id")
    return active.select("query_id", "same").join(lists, "same").select("query_id", "rank", "movie_id")


def route(queries: DataFrame) -> Column:
    """alert rows go nowhere; without semantic text the hard order is used."""
    kind = F.col("type") if "type" in queries.columns else F.lit("query")
    return (F.when(kind != "query", "none")
            .when(is_blank(F.col("semantic_query")), "hard_only").otherwise("hybrid"))


def recommend(movies: DataFrame, serving: DataFrame, queries: DataFrame, limit: int = LIMIT,
              max_block: int = 4096) -> DataFrame:
    """(query_id, route, rank, movie_id, distance) for every row that asks for movies."""
    routed = queries.withColumn("route", route(queries))
    hard = batch_hard_only(movies, routed.where("route = 'hard_only'"), limit, max_block)
    near = batch_hybrid(serving, routed.where("route = 'hybrid'"), limit, max_block)
    return hard.select("query_id", F.lit("hard_only").alias("route"), "rank", "movie_id",
                       F.lit(None).cast("double").alias("distance")).unionByName(
        near.select("query_id", F.lit("hybrid").alias("route"), "rank", "movie_id", "distance"))


def with_cards(results: DataFrame, movies: DataFrame) -> DataFrame:
    """Attach the card columns. Results hold ten rows per query, so AQE ships them to the movies."""
    return results.join(movies.select(*CARD), "movie_id")


def result_guard(results: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, rows, ids, ok): at most `limit` results, all different."""
    per_query = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"),
                                                F.count_distinct("movie_id").alias("ids"))
    return per_query.withColumn("ok", (F.col("rows") <= limit) & (F.col("ids") == F.col("rows")))
