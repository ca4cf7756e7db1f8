"""JSON arrays read in splits, whatever the size of the file.

A file is cut at every closing brace (objects) or comma (plain values), which the text source does in parallel. What a
piece means depends on what stands before it: each piece is a transition of two states, inside a string or outside, with
a change of depth for either. Transitions are added up within a split, then over the splits of a file, of which there are
few; then every piece knows its depth, and an element ends where the depth is that of the array again. Pieces of an
element meet inside their split; only the two open ends of a split move to another task.

No whole file is ever in one task. An element is one row, as everywhere. Text that is no element (nothing between two
commas, a file that ends early, a broken element) is a row with a null value, so that the caller's rules report it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

OBJECTS, VALUES = "}", ","
_SPLIT = ["_file", "_block"]


def _pieces(spark: SparkSession, path, cut: str, key: str | None) -> DataFrame:
    """Each piece with its place in its split and its transition: quotes, and depth added from outside and from inside."""
    read = spark.read.option("lineSep", cut).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_position"))
    # Without escaped backslashes and quotes, every quote left begins or ends a string.
    parts = F.split(F.replace(F.replace(F.col("value"), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"', -1)
    depth = lambda text: F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))
    side = lambda odd: depth(F.array_join(F.filter("_parts", lambda _, i: i % 2 == odd), ""))
    closes = 1 if cut == OBJECTS else 0
    flips = ((F.size("_parts") - 1) % 2).alias("_flips")
    begins = F.col("value").rlike(rf'(?<!\\)"{key}"\s*:\s*\[') if key else F.lit(True)
    return (read.withColumn("_parts", parts).select("value", *_SPLIT, "_position", flips, side(0).alias("_outside"), side(1).alias("_inside"),
                                                   begins.alias("_begins"))
            .withColumn("_outside", F.col("_outside") - closes * (1 - F.col("_flips")))
            .withColumn("_inside", F.col("_inside") - closes * F.col("_flips")))


def _summed(pieces: DataFrame) -> DataFrame:
    """Sums within the split up to and with each piece: its quotes, and its depth if the split begins outside or inside."""
    so_far = Window.partitionBy(*_SPLIT).orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    quotes = pieces.withColumn("_quotes", F.sum("_flips").over(so_far))
    before = (F.col("_quotes") - F.col("_flips")) % 2
    step = lambda start: F.when(before == start, F.col("_outside")).otherwise(F.col("_inside"))
    return quotes.select("value", *_SPLIT, "_position", "_begins", "_quotes", F.row_number().over(so_far.orderBy("_position")).alias("_place"),
                         F.sum(step(0)).over(so_far).alias("_depth0"), F.sum(step(1)).over(so_far).alias("_depth1"))


def _starts(summed: DataFrame) -> DataFrame:
    """How each split begins: inside a string or not, at which depth, and the place from which on the array has begun;
    and the place of a file's last piece."""
    last = lambda c: F.max_by(c, "_place").alias(c)
    splits = summed.groupBy(*_SPLIT).agg(F.max("_place").alias("_size"), last("_quotes"), last("_depth0"), last("_depth1"),
                                         F.min(F.when(F.col("_begins"), F.col("_place"))).alias("_found"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    final = F.lead("_block").over(Window.partitionBy("_file").orderBy("_block")).isNull()
    known = splits.select(*_SPLIT, F.when(final, F.col("_size")).alias("_end"), "_depth0", "_depth1", "_found", (F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2).alias("_in"),
                          (F.count("_found").over(earlier) > 0).alias("_begun"))
    depth = F.sum(F.when(F.col("_in") == 0, F.col("_depth0")).otherwise(F.col("_depth1"))).over(earlier)
    return known.select(*_SPLIT, "_end", "_in", F.coalesce(depth, F.lit(0)).alias("_from"),
                        F.when(F.col("_begun"), 0).otherwise(F.col("_found")).alias("_first_place"))


def _elements(spark: SparkSession, path, cut: str, key: str | None) -> DataFrame:
    """(_file, _text, _first, _open): runs of pieces up to an element's end; the open one is what follows the last end."""
    level = 2 if key else 1
    summed = _summed(_pieces(spark, path, cut, key))
    placed = summed.join(_starts(summed.drop("value")), _SPLIT)
    depth = F.col("_from") + F.when(F.col("_in") == 0, F.col("_depth0")).otherwise(F.col("_depth1"))
    ends = ((F.col("_quotes") + F.col("_in")) % 2 == 0) & (depth == level) & (F.col("_place") >= F.col("_first_place"))
    ends = ends & F.coalesce(F.col("_place") != F.col("_end"), F.lit(True))  # no cut follows the last piece, so it ends nothing
    marked = placed.select(*_SPLIT, "_place", "value", F.coalesce(ends, F.lit(False)).cast("int").alias("_ends"))
    before = Window.partitionBy(*_SPLIT).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = marked.withColumn("_run", F.coalesce(F.sum("_ends").over(before), F.lit(0)))
    joined = _joined(numbered.groupBy(*_SPLIT, "_run").agg(
        F.collect_list(F.struct(F.col("_place").alias("at"), F.col("value").alias("text"))).alias("_held"), F.max("_ends").alias("_ends")), cut)
    middle = joined.where((F.col("_run") > 0) & (F.col("_ends") == 1)).select("_file", "_text", F.lit(False).alias("_first"), F.lit(False).alias("_open"))
    # A split's first run may have begun in an earlier one, its last may end in a later one.
    edges = joined.where((F.col("_run") == 0) | (F.col("_ends") == 0))
    order = Window.partitionBy("_file").orderBy("_block", "_run")
    number = F.coalesce(F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = (edges.withColumn("_at", F.row_number().over(order)).withColumn("_number", number).groupBy("_file", "_number")
             .agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_text").alias("text"))).alias("_held"),
                  F.max("_ends").alias("_ends"), F.min("_at").alias("_at")))
    return middle.unionByName(_joined(whole, cut).select("_file", "_text", (F.col("_at") == 1).alias("_first"), (F.col("_ends") == 0).alias("_open")))


def _joined(grouped: DataFrame, cut: str) -> DataFrame:
    """The pieces of a run in order, with the cuts between them."""
    texts = F.transform(F.array_sort("_held"), lambda p: p["text"])
    return grouped.withColumn("_text", F.array_join(texts, cut)).drop("_held")


def _values(run: Column, cut: str, first: Column, open_: Column) -> Column:
    """The elements of a run without its brackets, as an array; null or empty if it holds none and should."""
    closed = F.concat(run, F.lit(cut)) if cut == OBJECTS else run
    text = F.when(open_, F.regexp_replace(run, r"\]\s*$", "")).otherwise(closed)
    if cut == OBJECTS:  # the comma before an element is still there
        text = F.when(first, text).when(text.rlike(r"^\s*,"), F.regexp_replace(text, r"^\s*,", ""))
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")


def read_elements(spark: SparkSession, path, cut: str = OBJECTS) -> DataFrame:
    """(value) of every element of files that hold one JSON array each; null where text is no element."""
    runs = _elements(spark, path, cut, None)
    opened = F.col("_text").rlike("^﻿?\\s*\\[")
    body = F.when(F.col("_first"), F.regexp_replace("_text", "^﻿?\\s*\\[", "")).otherwise(F.col("_text"))
    good = (~F.col("_first") | opened) & (~F.col("_open") | F.col("_text").rlike(r"\]\s*$"))
    # Nothing but the closing bracket after the last object, or in an empty array, is no element.
    end = F.col("_open") & body.rlike(r"^\s*\]\s*$") & (F.col("_first") if cut == VALUES else F.lit(True))
    found = F.when(good, _values(body, cut, F.col("_first"), F.col("_open")))
    return runs.where(~(good & end)).select(F.explode_outer(found).alias("value"))


def read_document(spark: SparkSession, path, key: str) -> tuple[DataFrame, DataFrame]:
    """(_file, frame) of each document and (_file, value) of the objects in its array `key`, the last of its fields.

    `frame` is the document with an empty array, null if it has no such array or goes on after it. Only the frame is
    held as a whole.
    """
    runs = _elements(spark, path, OBJECTS, key)
    head = rf'(?s)^(.*?(?<!\\)"{key}"\s*:\s*\[)'
    begun = F.col("_text").rlike(head)
    body = F.when(F.col("_first"), F.regexp_replace("_text", head, "")).otherwise(F.col("_text"))
    # The last brace is a cut, which the last piece lacks unless white space follows it.
    tail = r"\]\s*(\}\s*)?$"
    frames = runs.groupBy("_file").agg(
        F.max(F.when(F.col("_first") & begun, F.regexp_extract("_text", head, 1))).alias("_head"),
        F.max(F.when(F.col("_open"), body.rlike(rf"^\s*{tail}"))).alias("_ended")).select(
        "_file", F.when(F.col("_ended"), F.concat("_head", F.lit("]}"))).alias("frame"))
    found = _values(F.when(F.col("_open"), F.regexp_replace(body, tail, "]")).otherwise(body), OBJECTS, F.col("_first"), F.col("_open"))
    items = runs.where((~F.col("_first") | begun) & ~(F.col("_open") & body.rlike(rf"^\s*{tail}"))).select("_file", F.explode_outer(found).alias("value"))
    return frames, items
