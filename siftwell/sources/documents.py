"""Large JSON documents cut into their entries by many tasks."""

import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_
from typing import Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.storage import staged

SPLIT = ("file", "block")


def pieces_of(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The texts between closing braces of `files` (file, level), in the order of (block, id) within each file.

    Files are split as lines of text are, so a piece is as long as the text between two braces, whatever the length
    of the document. Each split is walked through as if it started where an entry has ended. The walk also tells by how
    much its quotes and its nesting go on, for a split that starts outside or inside a string; sums over earlier splits
    then tell how each starts, and those that start otherwise are walked through again.

    `quoted` tells whether a piece starts inside a string, `depth` and `after` the nesting before it and with the brace
    after it, `edge` whether a list of the level below may open or close in it. `ends` marks pieces whose brace ends an
    entry, `entry` counts those before in the split, and an `alone` piece is an entry of its own. Where that is an object
    after a comma, `object` is its text and `sound` whether it is valid; both are null elsewhere, and `other` is the
    text. `value` is either text as a piece, less the spaces around an object.
    """

    def walked(known: DataFrame) -> DataFrame:
        pieces = spark.read.text(path, lineSep="}").select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            "value",
        )
        # One row for each split of a file.
        pieces = pieces.join(F.broadcast(known), [c for c in SPLIT if c in known.columns])
        if "start" not in known.columns:
            pieces = pieces.withColumns({"started": F.lit(0), "start": _likely_start()})
        pieces = pieces.withColumn("w", _walk()("value", F.xxhash64("file"), "block", "level", "started", "start"))
        pieces = pieces.select(*SPLIT, "id", "level", "value", "w.*")
        by_itself = F.col("alone") & ~F.col("edge")
        tight, spaced = F.col("value").startswith(",{"), F.col("value").rlike(r"^[ \t\r\n]*,[ \t\r\n]*\{")
        own = F.when(tight, F.substr("value", F.lit(2))).when(spaced, F.regexp_replace("value", r"^[ \t\r\n]*,[ \t\r\n]*", ""))
        pieces = pieces.withColumn("object", F.when(by_itself, F.concat(own, F.lit("}"))))
        listed = F.concat(F.lit("["), "object", F.lit("]"))
        pieces = pieces.withColumns({
            "sound": F.when(F.col("object").isNotNull(), F.try_parse_json(listed).isNotNull()),
            "other": F.when(F.col("object").isNull(), F.col("value")),
        })
        # Texts are most of what is written.
        return staged(pieces.drop("value"), "zstd")

    pieces = walked(files.select("file", "level"))
    sums = pieces.groupBy(*SPLIT, "level").agg(*[F.sum(c).alias(c) for c in ("marks", "outside", "inside")])
    sums = staged(sums)
    sums = sums.withColumn("started", (_sum_before("marks") % 2).cast("int"))
    sums = sums.withColumn("start", _sum_before(F.when(F.col("started") == 1, F.col("inside")).otherwise(F.col("outside"))))
    others = staged(sums.where((F.col("started") != 0) | (F.col("start") != _likely_start())).select(*SPLIT, "level", "started", "start"))
    if not others.isEmpty():
        again = walked(others)
        pieces = pieces.join(F.broadcast(others.select(*SPLIT)), list(SPLIT), "left_anti").select(again.columns).union(again)
    piece = F.concat(F.lit(","), F.substr("object", F.lit(1), F.length("object") - 1))
    return pieces.drop("marks", "outside", "inside").withColumn("value", F.coalesce("other", piece))


def _likely_start() -> Column:
    """The depth at which a split starts where an entry has ended; the first one of a file starts at none."""
    return F.when(F.col("block") == 0, 0).otherwise(F.col("level")).cast("long")


def _sum_before(measure) -> Column:
    """The sum of a measure of splits over all earlier ones of the file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(measure).over(earlier), F.lit(0)).cast("long")


def _walk():
    """An Arrow UDF that goes through the pieces of each split in their order; it travels with the plan.

    Of a piece it gives what `pieces_of` tells, its quotes as `marks`, and the change of depth where the split starts
    `outside` a string or `inside` one.
    """
    special = np.zeros(256, bool)
    special[[ord(c) for c in '"\\[]{']] = True

    def measure(data: np.ndarray, bounds: np.ndarray) -> tuple:
        """Quotes of each piece, and (change, closes) for pieces that start outside a string and for those that start inside."""
        at = np.flatnonzero(special[data])
        kind, bounds = data[at], np.searchsorted(at, bounds)
        slash = kind == ord("\\")
        if slash.any():
            # What follows an odd number of backslashes in the same piece is escaped.
            order = np.arange(len(at))
            linked = np.zeros(len(at), bool)
            linked[1:] = slash[:-1] & (at[1:] == at[:-1] + 1)
            linked[bounds[bounds < len(at)]] = False
            run = np.maximum.accumulate(np.where(slash & ~linked, order, 0))
            kept = ~slash
            kept[1:] &= ~(linked[1:] & ((order[1:] - run[:-1]) % 2 == 1))
            kind, bounds = kind[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]
        quotes = np.concatenate([[0], np.cumsum(kind == ord('"'))])
        marks = quotes[bounds[1:]] - quotes[bounds[:-1]]
        quoted = (quotes[:-1] - np.repeat(quotes[bounds[:-1]], np.diff(bounds))) % 2
        steps = np.where(kind == ord('"'), 0, np.where(kind == ord("]"), -1, 1))
        sides = []
        for inside in (0, 1):
            sums = np.concatenate([[0], np.cumsum(np.where(quoted == inside, steps, 0))])
            change, start = sums[bounds[1:]] - sums[bounds[:-1]], sums[bounds[:-1]]
            # Lists that open and close within the piece say nothing about those that were open before.
            lowest = np.minimum.reduceat(np.append(sums[1:], 0), bounds[:-1]) if len(marks) else start
            closes = np.where(np.diff(bounds) > 0, np.maximum(start - lowest, 0), 0)
            brace = (marks % 2 == 1) == bool(inside)
            sides.append((change - brace, closes))
        return marks, *sides

    def texts_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = values.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        return data[bounds[0] : bounds[-1]], bounds - bounds[0]

    @F.arrow_udf("marks long, outside long, inside long, quoted boolean, depth long, after long, edge boolean, ends boolean, entry long, alone boolean")
    def walk(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        names = ("marks", "outside", "inside", "quoted", "depth", "after", "edge", "ends", "entry", "alone")
        held, last = {}, None
        for values, *columns in batches:
            file, block, level, started, start = [c.to_numpy(zero_copy_only=False) for c in columns]
            n = len(file)
            if not n:
                yield pa.StructArray.from_arrays([pa.array([], pa.bool_() if c in ("quoted", "edge", "ends", "alone") else pa.int64()) for c in names], names)
                continue
            fresh = np.ones(n, bool)
            fresh[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
            fresh[0] = last != (file[0], block[0])
            last = (file[-1], block[-1])
            first, known = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)), np.maximum.accumulate(fresh)

            def before(name: str, measured: np.ndarray) -> np.ndarray:
                sums = np.cumsum(measured) - measured
                sums = np.where(known, sums - sums[first], sums + held.get(name, 0))
                held[name] = sums[-1] + measured[-1]
                return sums

            marks, outside, inside = measure(*texts_of(values))
            odd, within = marks % 2 == 1, before("marks", marks) % 2 == 1
            quoted = within != (started == 1)
            change, closes = np.where(quoted, inside, outside)
            depth = start + before("depth", change)
            after = depth + change
            ends = (quoted == odd) & (after == level)
            # Outside strings and at the level of entries, the brace before has ended one.
            alone = ends & ~quoted & (depth == level)
            columns = (
                marks, np.where(within, inside[0], outside[0]), np.where(within, outside[0], inside[0]), quoted, depth, after,
                depth - closes < level, ends, before("entry", ends.astype(np.int64)), alone,
            )
            yield pa.StructArray.from_arrays([pa.array(c, pa.bool_() if c.dtype == bool else pa.int64()) for c in columns], names)

    return walk


def placed(pieces: DataFrame) -> DataFrame:
    """The pieces, each with the number of its `entry` in the file.

    An entry ends with a brace that brings the depth back to the level of the file: 1 in a list, 2 in a list within an
    object.
    """
    splits = staged(pieces.groupBy(*SPLIT).agg(F.count_if("ends").alias("own")))
    splits = splits.select(*SPLIT, _sum_before("own").alias("__earlier"))
    return pieces.join(F.broadcast(splits), list(SPLIT)).withColumn("entry", F.col("entry") + F.col("__earlier")).drop("__earlier")


def _list_finder():
    """A Pandas UDF that tells where lists open and close at the depth below the level; it travels with the plan."""
    rest = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
    token = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|[\[\]{]', re.S)

    def lists(text: str, quoted: bool, depth: int, level: int) -> list[dict]:
        found, name, start = [], None, 0
        if quoted:
            end = rest.match(text)
            if not end:
                return []
            start = end.end()
        for m in token.finditer(text, start):
            if m[0][0] == '"':
                name = m
            elif m[0] == "]":
                depth -= 1
                if depth == level - 1:
                    found.append({"key": None, "at": m.start()})
            else:
                if m[0] == "[" and depth == level - 1:
                    if level == 1:
                        found.append({"key": "list", "at": m.end()})
                    elif name is not None and text[name.end() : m.start()].strip() == ":":
                        try:
                            found.append({"key": json.loads(name[0]), "at": m.end()})
                        except ValueError:
                            pass
                depth += 1
        return found

    @F.pandas_udf("array<struct<key:string,at:int>>")
    def find(text: pd.Series, quoted: pd.Series, depth: pd.Series, level: pd.Series) -> pd.Series:
        return pd.Series([lists(*row) for row in zip(text, quoted, depth, level)])

    return find


def chosen_lists(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each file that may be one value: the key of its list of entries, where it opens and where it closes.

    The key is null where there is no such list. Files in which nesting ends early or never hold no single value and
    have no row.
    """
    here = F.struct("block", "id").alias("place")
    # Numbers only, so that rows are summed up where they are read.
    splits = places.groupBy(*SPLIT).agg(F.count_if(F.col("after") <= 0).alias("ended"), F.max_by("after", "id").alias("final"))
    one = splits.groupBy("file").agg(F.sum("ended").alias("ended"), F.max_by("final", "block").alias("final"))
    # The brace after the last piece is counted, whether it is there or not: its end is at -1 where it is not.
    one = one.where((F.col("ended") <= 2) & F.col("final").isin(0, -1)).select("file", (F.col("final") == 0).alias("braced"))
    events = places.where("edge").select("file", here, F.explode(_list_finder()("other", "quoted", "depth", "level")).alias("e"))
    events = staged(events.select("file", "place", "e.key", "e.at"))
    rank = F.array_position(F.array(*map(F.lit, ("list", *keys))), F.col("key"))
    opens = events.where(rank > 0).groupBy("file").agg(F.max_by(F.struct("key", F.col("place").alias("from"), F.col("at").alias("start")), F.struct(-rank, "place", "at")).alias("o"))
    opens = opens.select("file", "o.*")
    closes = events.where("key IS NULL").join(opens, "file").where(F.struct("place", "at") >= F.struct("from", "start"))
    closes = closes.groupBy("file").agg(F.min(F.struct("place", "at")).alias("c")).select("file", F.col("c.place").alias("to"), F.col("c.at").alias("stop"))
    return staged(one.join(opens.join(closes, "file"), "file", "left"))


def _with_texts(rows: DataFrame) -> DataFrame:
    """Pieces of files with a chosen list; `text` is what of a piece is within the list, `frame` what is not."""
    first, last = F.col("place") == F.col("from"), F.col("place") == F.col("to")
    start = F.when(first, F.col("start")).otherwise(0)
    stop = F.when(last, F.col("stop")).otherwise(F.length("value"))
    brace = F.lit("}")
    cut = F.concat(F.substr("value", start + 1, stop - start), F.when(last, "").otherwise(brace))
    text = F.when(_within(), F.when(first | last, cut).otherwise(F.concat("value", brace)))
    before = F.when(F.col("place") < F.col("from"), F.concat("value", brace)).when(first, F.substr("value", F.lit(1), F.col("start"))).otherwise("")
    after = F.when(F.col("place") > F.col("to"), F.concat("value", brace)).when(last, F.concat(F.substr("value", F.col("stop") + 1), brace)).otherwise("")
    return rows.withColumns({"text": text, "frame": F.concat(before, after)})


def _within() -> Column:
    """Whether a piece is between those in which the chosen list opens and closes, or one of them."""
    block, id_ = F.col("block"), F.col("id")
    starts = (block > F.col("from.block")) | ((block == F.col("from.block")) & (id_ >= F.col("from.id")))
    return starts & ((block < F.col("to.block")) | ((block == F.col("to.block")) & (id_ <= F.col("to.id"))))


def entries_of(places: DataFrame, lists: DataFrame, is_value, is_record) -> tuple[DataFrame, DataFrame]:
    """(file, whole, frame_bytes) and (file, origin, value, good): whether a file is exactly one JSON value, and the entries of its list.

    `is_value` makes the test for one value out of a column's name, `is_record` the one for an entry that is a record. A
    file is one value if what frames its list is one and each entry is one. Entries without braces of their own go with
    the next one that has some. Entries that are an object by themselves are read where the pieces were written.
    """
    # One row for each file cut.
    rows = places.join(F.broadcast(lists), "file")
    objects, apart = rows.where(F.col("sound").isNotNull() & _within()), rows.where(F.col("sound").isNotNull() & ~_within())
    rest = rows.where("sound IS NULL").withColumn("value", F.col("other"))
    if not apart.isEmpty():
        rest = rest.union(apart)
    rest = rest.withColumn("place", F.struct("block", "id"))
    rest = _with_texts(rest)
    own = F.sort_array(F.collect_list(F.struct("place", "text")))
    opens, closes = F.col("place") == F.col("from"), F.col("place") == F.col("to")
    texts = rest.where("text IS NOT NULL")
    parts = texts.where("NOT alone").groupBy("file", "entry").agg(F.first("key").alias("origin"), own.alias("parts"), F.max(opens).alias("opens"), F.max(closes).alias("closes"))
    parts = parts.select("file", "origin", F.array_join("parts.text", "").alias("text"), "opens", "closes")
    # Entries of one piece need not move.
    parts = parts.union(texts.where("alone").select("file", F.col("key").alias("origin"), "text", opens, closes))
    # Looking at the ends is much cheaper than trimming.
    spaced = reduce(or_, [F.col("text").startswith(c) | F.col("text").endswith(c) for c in " \t\r\n"])
    joined = parts.withColumn("joined", F.when(spaced, F.trim("text", F.lit(" \t\r\n"))).otherwise(F.col("text")))
    # Each run of entries but the first starts with the comma that parts it from those before.
    parted = F.col("joined").startswith(",")
    body = F.when(F.col("opens"), F.col("joined")).when(parted, F.substr("joined", F.lit(2)))
    listed = joined.withColumn("listed", F.concat(F.lit("["), body, F.lit("]")))
    blank = F.ltrim(body, F.lit(" \t\r\n")) == ""
    nothing = (F.col("joined") == "") & F.col("closes")
    sound = nothing | (~blank & F.try_parse_json("listed").isNotNull())
    entries = F.when(F.col("joined") != "", F.from_json("listed", "array<string>"))
    runs = listed.select("file", "origin", F.coalesce(sound, F.lit(False)).alias("sound"), F.posexplode_outer(entries).alias("pos", "value"))
    runs = staged(runs.withColumn("good", is_record("value")), "zstd")

    # The brace that ends an object was put after its last piece even where the file ends without one.
    frames = rest.where("frame != ''").groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "frame"))).getField("frame"), "").alias("frame"), F.first("braced").alias("braced"))
    frames = frames.select("file", F.when(F.col("braced"), F.col("frame")).otherwise(F.expr("left(frame, length(frame) - 1)")).alias("frame"))
    framed = frames.select("file", is_value("frame").alias("framed"), F.octet_length("frame").alias("frame_bytes"))
    # The pieces in which a list opens and closes are among the runs, so each file has some.
    unsound = objects.where("NOT sound").select("file", "sound")
    verdict = runs.select("file", "sound").union(unsound).groupBy("file").agg(F.every("sound").alias("sound")).join(framed, "file")
    verdict = verdict.select("file", (F.col("sound") & F.col("framed")).alias("whole"), F.when(F.col("sound"), F.col("frame_bytes")).alias("frame_bytes"))
    objects = objects.select("file", F.col("key").alias("origin"), F.col("object").alias("value"), F.lit(True).alias("good"))
    return staged(verdict), runs.where("pos IS NOT NULL").select("file", "origin", "value", "good").union(objects)
