"""MinHash near-duplicates by tensored banding.

A plain banding of t tables needs t keys of 2r hashes. Here two collections of c keys of r hashes are drawn, and a table
belongs to each pair of them: c * c tables from 2 * c * r hashes. Two sets meet in some table exactly when they agree on
a key of each collection; with r = 3 and c = 12, sets at the threshold of 0.85 miss each other with a chance of 2e-5,
with c = 16 those at 0.80.
Keys that only one set has cannot meet and are dropped before the pairs are formed.

The tables only say which sets may be linked: sets that meet in a table, and sets connected by such meetings, form a
group, and inside a group every pair of compatible sizes is confirmed on full sets. Small groups are bundled; large ones
are split into blocks by size class (sets whose sizes differ too much cannot be similar) and dealt to a grid of tasks.
Equal sets are one node. A task gives a spanning forest of its links, never all pairs.

Rows: texts that are null, empty or without words have the empty set and link with nothing; texts shorter than a shingle
have one shingle, the whole sequence; repeated rows are copies; rows that repeat an id are one node; rows without id link
with nothing and are kept; texts are taken whole; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmloom.llm.common import keeping_columns, saved, slices, texts, worker_state
from filmloom.llm.components import components

WIDTH = 3
LEAST = 85  # per cent of the union
TABLES = 12  # keys of each of the two collections
PARTS = 3  # hashes in a key
BLOCK = 256
BUNDLE = 2000
_WORDS_REMEMBERED = 400_000


def _odd(seed: str, n: int) -> np.ndarray:
    """n odd 64-bit multipliers made from a seed."""
    raw = b"".join(hashlib.blake2b(f"{seed} {i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(raw, "<u8") | np.uint64(1)


_MIX = _odd("mix", 2)
_PLACE = _odd("place", 16)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, a bounded number of which is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= _WORDS_REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str, words: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of the whole sequence if it is shorter than one; else none."""
    split = text.encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        total += mixed(h[k:k + n] * _PLACE[k] + np.uint64(k))
    return np.unique(mixed(total))


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minima of the hashes under each multiplier."""
    out = np.full(len(multipliers), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = mixed(hashes[at:at + 4096, None] * multipliers)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def keys(hashes: np.ndarray, multipliers: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """The keys of both collections, one after the other."""
    minima = signature(hashes, multipliers).reshape(-1, parts)
    total = np.arange(len(minima), dtype=np.uint64)
    for k in range(parts):
        total = mixed(total + minima[:, k] * _PLACE[k])
    return total


def signed(docs: DataFrame, width: int = WIDTH, tables: int = TABLES, parts: int = PARTS) -> DataFrame:
    """doc_id, n_shingles, set1 and set2 (which tell sets apart), keys of both collections, of every row."""
    multipliers = _odd("minhash", 2 * tables * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state("minhash words", Words)
        for batch in slices(batches):
            sizes, one, two, near = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingles(text, words, width)
                sizes.append(len(h))
                one.append(h.sum(dtype=np.uint64))
                two.append(mixed(h ^ _PLACE[0]).sum(dtype=np.uint64))
                near.append(keys(h, multipliers, parts).view(np.int64) if len(h) else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                 pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(near, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set1", "set2", "keys"])

    return texts(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set1 long, set2 long, keys array<long>")


def parties(classes: DataFrame, tables: int = TABLES) -> DataFrame:
    """node, party: sets that meet in a table, or are connected by such meetings, have one party.

    The tables of the diagonal go first; of the others only those whose sets still belong to several parties matter then,
    so a large group of copies does not repeat its links table by table.
    """
    posed = classes.select("node", F.posexplode("keys").alias("place", "value"))
    common = saved(posed.groupBy("place", "value").count().filter("count > 1").drop("count"), "keys")
    hits = posed.join(common, ["place", "value"]).select(
        "node", (F.col("place") >= tables).alias("second"), F.struct("place", "value").alias("key"))
    both = hits.groupBy("node").agg(F.collect_list(F.when(~F.col("second"), F.col("key"))).alias("left"),
                                    F.collect_list(F.when(F.col("second"), F.col("key"))).alias("right"))
    paired = saved(both.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r"))
                   .select("node", (F.col("l.place") + tables == F.col("r.place")).alias("diagonal"),
                           F.xxhash64("l.place", "l.value", "r.place", "r.value").alias("table")), "tables")
    near = components(_stars(paired.filter("diagonal").select("table", "node"))).withColumnRenamed("id", "node")
    nodes = paired.select("node").distinct().join(near, "node", "left").select(
        "node", F.coalesce("component", "node").alias("label"))
    nodes = saved(nodes, "parties")
    labelled = saved(paired.filter("not diagonal").join(nodes, "node").select("table", F.col("label").alias("node")).distinct(),
                     "tables")
    joined = components(_stars(labelled)).withColumnRenamed("id", "label")
    all_ = nodes.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("party"))
    sizes = all_.groupBy("party").count().filter("count > 1").select("party")
    return saved(all_.join(sizes, "party").select("node", "party"), "parties")


def _stars(met: DataFrame) -> DataFrame:
    """a, b: the nodes of each table and the table's least one, where it has several."""
    first = saved(met.groupBy("table").agg(F.min("node").alias("b"), F.max("node").alias("last"))
                  .filter("b < last").drop("last"), "firsts")
    return met.join(first, "table").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def dealt(sets: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """team and the columns of `sets` (node, party, size, hashes): every pair of a party that may link shares a team.

    Parties of up to `block` sets are bundled by hash; larger ones go to pairs of blocks of equal or adjacent size class.
    """
    class_ = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / least)).cast("int")
    sets = sets.withColumn("class", class_)
    cells = saved(sets.groupBy("party", "class").agg(F.count(F.lit(1)).alias("n")), "cells")
    whole = cells.groupBy("party").agg(F.sum("n").alias("total"))
    bundles = max(1, -(-(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BUNDLE))
    blocks = cells.select("party", "class", F.ceil(F.col("n") / block).cast("int").alias("own"))
    shifted = lambda by, name: blocks.select("party", (F.col("class") + by).alias("class"), F.col("own").alias(name))
    plan = (blocks.join(shifted(-1, "above"), ["party", "class"], "left").join(shifted(1, "below"), ["party", "class"], "left")
            .join(whole, "party"))
    placed = sets.join(plan, ["party", "class"])
    small = placed.filter(F.col("total") <= block).withColumn(
        "team", F.array(F.xxhash64(F.lit("bundle"), F.pmod(F.xxhash64("party"), F.lit(bundles)))))
    seat = F.pmod(F.xxhash64("node"), "own").cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    name = lambda shift, kind, x, y: F.xxhash64("party", F.col("class") + shift, F.lit(kind), x, y)
    none = F.array().cast("array<bigint>")
    teams = F.concat(
        F.transform(upto(F.col("own")), lambda k: name(0, "own", F.least(seat, k), F.greatest(seat, k))),
        F.coalesce(F.transform(upto(F.col("above")), lambda k: name(0, "next", seat, k)), none),
        F.coalesce(F.transform(upto(F.col("below")), lambda k: name(-1, "next", k, seat)), none))
    large = placed.filter(F.col("total") > block).withColumn("team", teams)
    return small.unionByName(large).select(F.explode("team").alias("team"), "party", "node", "size", "hashes")


def _links(least: int):
    def of(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and the least node that links reach, inside one party of a task."""
        n = len(nodes)
        size = np.array([len(s) for s in sets])
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), size)
        shared = counts > 1
        owner, ids = owner[shared[ids]], (np.cumsum(shared) - 1)[ids[shared[ids]]]
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        both = np.zeros((n, n), np.float64)
        for start in range(0, int(shared.sum()), 8192):  # columns of the incidence matrix, so memory stays bounded
            lo, hi = np.searchsorted(ids, [start, start + 8192])
            part = np.zeros((n, 8192), np.float32)
            part[owner[lo:hi], ids[lo:hi] - start] = 1
            both += part @ part.T
        near = 100 * both >= least * (size[:, None] + size[None] - both)
        np.fill_diagonal(near, True)  # shingles of one set alone were left out above
        low = nodes.copy()
        while True:
            new = np.where(near, low[None], np.iinfo(np.int64).max).min(1)
            if (new == low).all():
                return nodes, low
            low = new

    def run(team: pa.Table) -> pa.Table:
        party, nodes = team.column("party").to_numpy(), team.column("node").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in team.column("hashes").to_pylist()]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(party, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(party[order])) + 1):
            if len(rows) > 1:
                one, other = of(nodes[rows], [sets[i] for i in rows])
                a.append(one[one != other])
                b.append(other[one != other])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def linked(docs: DataFrame, width: int = WIDTH, least: int = LEAST, tables: int = TABLES, parts: int = PARTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = saved(signed(docs, width, tables, parts), "signed")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = ["set1", "set2", "n_shingles"]
    classes = saved(rows.filter(some).groupBy(*own).agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state("minhash words", Words)
        for batch in slices(batches):
            found = [shingles(t, words, width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), batch.column("party"), pa.array([len(h) for h in found], pa.int64()),
                                   pa.array([h.tobytes() for h in found], pa.binary())],
                                  names=["node", "party", "size", "hashes"])

    # Who is in a party grows with the texts: a merge join at every size, never a broadcast.
    chosen = texts(docs).select(F.col("doc_id").cast("bigint").alias("node"), "text").join(
        parties(classes, tables).hint("merge"), "node")
    sets = saved(chosen.select("node", "party", "text").mapInArrow(run, "node long, party long, size long, hashes binary")
                 .filter("size > 0"), "shingles")
    links = dealt(sets, least).groupBy("team").applyInArrow(_links(least), "a long, b long")
    reached = components(links).withColumnRenamed("id", "node")
    named = classes.select(*own, "node").join(reached, "node", "left").select(
        *own, F.coalesce("component", "node").alias("component_id"))
    found = rows.filter(some).join(named, own).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@keeping_columns
def survivors(docs: DataFrame, width: int = WIDTH, least: int = LEAST, tables: int = TABLES, parts: int = PARTS) -> DataFrame:
    """The same columns of one row of each component: of the row of its least id. Rows that repeat that id stay once per text.

    Rows without words stay as they are, and so do rows without id.
    """
    found = linked(docs, width, least, tables, parts)
    kept = found.filter(F.col("kept") & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias("kept_id")).distinct()
    marked = docs.withColumn("wordless", F.coalesce(~F.col("text").rlike(r"[^ \t-\r]"), F.lit(True)))
    alone = marked.filter(F.col("doc_id").isNull() | F.col("wordless")).select(*docs.columns)
    # Two hashes stand for the text among rows of one id.
    own = {"seal": F.xxhash64("text"), "second": F.xxhash64(F.lit("second"), "text")}
    linked_rows = marked.filter(F.col("doc_id").isNotNull() & ~F.col("wordless")).join(
        kept, F.col("doc_id") == F.col("kept_id")).withColumns(own).dropDuplicates(["doc_id", *own])
    return linked_rows.select(*docs.columns).unionByName(alone)
