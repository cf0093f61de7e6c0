"""Delimited files whose records go on over several lines, put together by many tasks."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.storage import staged

# Encodings in which line breaks, quotes and separators are the bytes they are in ASCII.
SPLITTABLE = ("UTF-8", "US-ASCII", "ISO-8859-1")
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
SPLIT = ("file", "block")


def open_after(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted field is open at the end of a line that starts outside such a field, and of one that starts inside.

    A quote opens a field only at its start; what follows the closing quote up to the next separator belongs to the
    field, as Spark's reader takes it.
    """
    s = re.escape(sep)
    fields = rf'^(?:(?:{QUOTED}[^{s}]*+|(?!")[^{s}]*+){s})*+'

    def opens(text: Column) -> Column:
        last = F.regexp_replace(text, fields, "")
        return last.startswith('"') & ~last.rlike(f"^{QUOTED}")

    closing = rf'^[^"]*+(?:""[^"]*+)*+"[^{s}]*+'
    rest = F.regexp_replace(line, rf"{closing}{s}?+", "")
    return opens(line), ~line.rlike(closing) | opens(rest)


def lines_of(spark: SparkSession, path: str, files: DataFrame, sep: str, charset: str) -> DataFrame:
    """The lines of `files` (file), in the order of (block, id) within each file, written once.

    Files are split as lines of text are. `outside` and `inside` tell whether a quoted field is open after the line if
    none or one was open before it; `carriage` whether the line ends in a carriage return.
    """
    raw = F.col("value").cast("binary")
    value = F.decode(raw, charset) if charset != "UTF-8" else F.make_valid_utf8("value")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        value.alias("value"),
    )
    outside, inside = open_after(F.col("value"), sep)
    lines = lines.join(files, "file", "left_semi")
    return staged(lines.withColumns({"outside": outside, "inside": inside, "carriage": F.col("value").endswith("\r")}))


def _after(rows: DataFrame, window, set_to: Column, flips: Column) -> DataFrame:
    """`anchor` and `turns` up to and with each row: the state is `(anchor + turns) % 2`, or `(before + turns) % 2` without an anchor.

    A row sets the state, whatever it was, to `set_to`, or, where that is null, turns it by `flips`.
    """
    rows = rows.withColumn("turns", F.sum(flips).over(window))
    return rows.withColumn("anchor", F.last(set_to + F.col("turns"), ignorenulls=True).over(window))


def records_of(lines: DataFrame) -> DataFrame:
    """(file, block, id, record): the records that the lines make up, with the place of their first line.

    What a line does to the state, an open quoted field or none, is a map of two states to two; those of the lines of a
    split are composed there, those of the splits, one row each, within their file. Lines are shuffled once, by
    split; only the line groups that a split's border cuts are moved again. A quote that is never closed makes all that
    follows it in its file one record.
    """
    here = Window.partitionBy(*SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    fixed_to = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int"))
    # With both states apart a line either keeps the state or turns it around.
    turned = F.when((F.col("outside") != F.col("inside")) & F.col("outside"), 1).otherwise(0)

    narrow = _after(lines.select(*SPLIT, "id", "outside", "inside", "carriage"), here, fixed_to, turned)
    splits = narrow.groupBy(*SPLIT).agg(F.max_by(F.struct("anchor", "turns"), "id").alias("s"), F.min_by("carriage", "id").alias("carriage"))
    splits = splits.select(*SPLIT, "carriage", (F.col("s.anchor") + F.col("s.turns")).alias("sets"), F.col("s.turns").alias("turned"))
    # One row for each split of a file.
    order = Window.partitionBy("file").orderBy("block")
    splits = _after(splits, order.rowsBetween(Window.unboundedPreceding, 0), F.col("sets") % 2, F.col("turned"))
    state = (F.coalesce("anchor", F.lit(0)) + F.col("turns")) % 2
    splits = splits.select(*SPLIT, F.lag(state, 1, 0).over(order).alias("entering"), F.first("carriage").over(order).alias("carriage"))
    splits = staged(splits)

    rows = _after(lines.drop("carriage").repartition(*SPLIT), here, fixed_to, turned).join(splits, list(SPLIT))
    state = (F.coalesce("anchor", F.col("entering")) + F.col("turns")) % 2
    ordered = Window.partitionBy(*SPLIT).orderBy("id")
    starts = F.lag(state).over(ordered)
    rows = rows.withColumn("goes_on", F.coalesce(starts, F.col("entering")) == 1)
    rows = rows.withColumn("first", F.last(F.when(~F.col("goes_on"), F.col("id")), ignorenulls=True).over(here))
    ending = F.when(F.col("carriage"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    line = F.struct("id", ending.alias("value"))
    # Lines of a split without a first one belong to a record of an earlier split.
    groups = rows.groupBy(*SPLIT, "first").agg(F.sort_array(F.collect_list(line)).getField("value").alias("lines"), F.max_by(state, "id").alias("open"))
    groups = staged(groups.select(*SPLIT, "first", F.array_join("lines", "\n").alias("text"), (F.col("open") == 1).alias("open")))
    cut = groups.where("first IS NULL OR open")
    whole = groups.where("first IS NOT NULL AND NOT open").select(*SPLIT, F.col("first").alias("id"), F.col("text").alias("record"))
    # At most two rows a split: the end of an earlier record, which comes first, and the beginning of the next one.
    place = F.struct("block", F.coalesce("first", F.lit(-1)).alias("first"))
    upto = Window.partitionBy("file").orderBy("block", F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("first").isNotNull(), F.struct("block", "first")), ignorenulls=True).over(upto)
    joined = cut.withColumn("head", head).groupBy("file", "head").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "text"))).getField("text").alias("texts"))
    return whole.unionByName(joined.select("file", F.col("head.block").alias("block"), F.col("head.first").alias("id"), F.array_join("texts", "\n").alias("record")))


def without_headings(records: DataFrame) -> DataFrame:
    """Records with something on them, but for the first such one of each file."""
    records = records.where(F.trim("record", F.lit(" \t\r\n")) != "")
    # One row per file.
    headings = records.groupBy("file").agg(F.min(F.struct("block", "id")).alias("__heading"))
    return records.join(headings, "file").where(F.struct("block", "id") > F.col("__heading")).drop("__heading")
