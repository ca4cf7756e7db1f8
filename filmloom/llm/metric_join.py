"""Near-duplicate vectors by an exact metric range join.

On unit vectors a least cosine is a greatest distance e. Some vectors serve as pivots; each vector lives in the cell of
its nearest pivot p. If x lives at p, y at q and d(x, y) <= e, the triangle inequality gives d(y, p) <= d(y, q) + 2e,
and in Euclidean space y is also no further than e from the plane between p and q: (d(y, p)^2 - d(y, q)^2) / 2d(p, q)
<= e. A vector is copied to every cell for which both hold, and so each cell finds all partners of the vectors that live
in it. Cells are joined by blocks of bounded size, each a task's matrix product. Equal vectors are one row of the join
with a number of copies.

Rows: vectors that are null, zero, without label, or hold null or non-finite components link with nothing: no links,
their own component, kept. Vectors of different length never link. Repeated rows are copies of each other. Rows that
repeat an id are one node of the components. Null ids count as partners but name no component. An empty table gives an
empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filmloom.llm.common import ready, saved
from filmloom.llm.components import components

LEAST = 0.98
PER_PIVOT = 8192
MOST_PIVOTS = 256
HOMES = 1024
MEMBERS = 2048
_SLACK = 1e-9


def usable() -> Column:
    """Whether a row has a label and a finite vector that is not zero."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def linked(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; rows link when labels are equal and the cosine reaches `least`."""
    ready(vectors.sparkSession)
    rows = saved(vectors.select(F.col("vec_id").cast("bigint"), "embedding", "label").withColumn("good", usable())
                 .withColumn("key1", F.xxhash64("embedding")).withColumn("key2", F.xxhash64(F.lit("second"), "embedding")),
                 "vectors")
    good = rows.filter("good")
    # 128 bits of hash and the label tell vectors apart. The class number is written once and so stays the same.
    classes = saved(good.groupBy("label", "key1", "key2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    pivots = (classes.orderBy("key1", "key2", "class").limit(min(MOST_PIVOTS, max(1, -(-count // PER_PIVOT))))
              .select("embedding").collect())
    cells = saved(_dealt(classes, [np.array(p["embedding"], float) for p in pivots], least), "cells")
    key = ["label", "width", "cell"]
    sizes = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("home").cast("int")).alias("homes"))
    sizes = sizes.select(*key, F.ceil(F.col("homes") / HOMES).cast("int").alias("blocks"),
                         F.ceil(F.col("members") / MEMBERS).cast("int").alias("chunks")).filter("blocks > 0")
    seat = F.xxhash64("class")
    placed = cells.join(sizes, key)
    homes = placed.filter("home").select("*", F.lit(True).alias("asks"), F.pmod(seat, "blocks").cast("int").alias("block"),
                                         F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    members = placed.select("*", F.lit(False).alias("asks"),
                            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                            F.pmod(seat, "chunks").cast("int").alias("chunk"))
    found = saved(homes.unionByName(members).groupBy(*key, "block", "chunk").applyInArrow(
        _cell(least), "class long, n long, root long"), "found")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    linked_classes = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    # The component of classes by number becomes the least id in it; an id that occurs twice joins its classes.
    known = classes.join(linked_classes.withColumnRenamed("id", "class"), "class", "left").select(
        "label", "key1", "key2", "class", "first", "copies", F.coalesce("component", "class").alias("component"))
    named = known.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = (known.join(named, "component").join(counts, "class", "left")
             .select("label", "key1", "key2", "component_id",
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.filter("good").join(facts, ["label", "key1", "key2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                               F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. A power of two, which changes no digit, first brings each row to where squares are finite."""
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealt(classes: DataFrame, pivots: list[np.ndarray], least: float) -> DataFrame:
    """label, width, cell, home, class, copies, embedding: each vector in its cell and copied to those near by."""
    far = math.sqrt(2 - 2 * least) + _SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                yield from spread(whole.slice(at, 1024))

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("embedding")
        widths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        starts = np.concatenate([[0], np.cumsum(widths)])[:-1]
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            x = flat[starts[rows][:, None] + np.arange(width)]
            x = _unit(x)
            p = _unit(np.array([v for v in pivots if len(v) == width]).reshape(-1, width))
            if not len(p):  # vectors of a rare length share one cell
                p = np.zeros((1, width))
            d2 = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0)
            own = d2.argmin(axis=1)
            home2 = d2[np.arange(len(x)), own][:, None]
            between = np.sqrt(np.maximum(((p[own][:, None, :] - p[None]) ** 2).sum(-1), 1e-30))
            near = (np.sqrt(d2) <= np.sqrt(home2) + 2 * far) & (d2 - home2 <= 2 * between * far + _SLACK)
            near[np.arange(len(x)), own] = True
            i, cell = np.nonzero(near)
            take = pa.array(rows[i])
            columns = [batch.column(c).take(take) for c in ("label", "class", "copies", "embedding")]
            yield pa.record_batch(
                [columns[0], pa.array(np.full(len(i), width, np.int32)), pa.array(cell.astype(np.int32)),
                 pa.array(own[i] == cell), *columns[1:]],
                names=["label", "width", "cell", "home", "class", "copies", "embedding"])

    # Components keep their own precision: floats as they are, all else as doubles.
    own = "float" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    source = classes.select("label", "class", "copies", F.col("embedding").cast(f"array<{own}>"))
    kind = classes.schema["label"].dataType.simpleString()
    return source.mapInArrow(run, f"label {kind}, width int, cell int, home boolean, class long, copies long, embedding array<{own}>")


def _cell(least: float):
    def run(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy()
        width = block.column("width")[0].as_py()
        x = block.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        x = _unit(x)
        ids, copies = block.column("class").to_numpy(), block.column("copies").to_numpy()
        homes, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        near = x[homes] @ x[members].T >= least
        near &= ids[homes][:, None] != ids[members][None]
        n = near @ copies[members]
        # Least class reachable inside the block, by rounds over the linked rows alone.
        h, m = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        sub = near[np.ix_(h, m)]
        low_h, low_m = ids[homes[h]].copy(), ids[members[m]].copy()
        while len(h):
            big = np.iinfo(np.int64).max
            new_h = np.minimum(low_h, np.where(sub, low_m[None], big).min(1))
            new_m = np.minimum(low_m, np.where(sub, new_h[:, None], big).min(0))
            both = {}
            for k, v in zip(np.concatenate([ids[homes[h]], ids[members[m]]]).tolist(), np.concatenate([new_h, new_m]).tolist()):
                both[k] = min(v, both.get(k, v))
            new_h = np.array([both[k] for k in ids[homes[h]].tolist()])
            new_m = np.array([both[k] for k in ids[members[m]].tolist()])
            done = (new_h == low_h).all() and (new_m == low_m).all()
            low_h, low_m = new_h, new_m
            if done:
                break
        root = ids[homes].copy()
        root[h] = low_h
        return pa.table({"class": np.concatenate([ids[homes], ids[members[m]]]),
                         "n": np.concatenate([n, np.zeros(len(m), np.int64)]).astype(np.int64),
                         "root": np.concatenate([root, low_m])})

    return run
