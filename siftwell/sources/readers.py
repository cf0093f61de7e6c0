"""Loading CSV, TSV, JSON and Parquet with malformed rows set aside and problems listed."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import parse_number, quoted
from siftwell.operators.columns import nan_to_null, text_columns
from siftwell.operators.local import fixed
from siftwell.sources import delimited, documents
from siftwell.storage import release, staged

# Cell texts that mean "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Object fields that hold the records, in order of preference.
ENVELOPE_KEYS = ("records", "data", "rows", "results", "items")

# The wording of notes about column names, encoding, quarantined rows and JSON layouts below.
BOOLEAN_TEXTS = ("True", "False", "TRUE", "FALSE", "true", "false")
FORMATS = {"csv": "csv", "txt": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "parquet": "parquet"}
# Suffixes of compressed files.
COMPRESSION = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")
CORRUPT, SURPLUS, FILE = "_corrupt_record", "_surplus_fields", "_source_file"
ROW_SAMPLE = 5
# Beyond this Spark does not parse a text as one value: the limit for one record, and for what is around a list of them.
MOST_VALUE_BYTES = 126 << 20
# Longer texts between closing braces are passed over where documents are told from lines.
LONGEST_PIECE = MOST_VALUE_BYTES
# Documents of up to this size are parsed whole by one task, larger ones are cut into their entries by many.
WHOLE_BYTES = 16 << 20


@dataclass(frozen=True)
class LoadedTable:
    """A loaded table, the rows set aside while loading, and what was noticed about the source."""

    data: DataFrame
    quarantined: DataFrame
    source_type: str
    path: str
    notes: tuple[str, ...] = field(default=())

    @property
    def issues(self) -> DataFrame:
        return fixed(self.data.sparkSession, [(n,) for n in self.notes], "issue string")

    def summary(self) -> DataFrame:
        """(source_type, file_name, row_count, column_count)."""
        name = self.path.rstrip("/").rsplit("/", 1)[-1]
        return self.data.agg(F.count("*").alias("row_count")).select(
            F.lit(self.source_type).alias("source_type"),
            F.lit(name).alias("file_name"),
            "row_count",
            F.lit(len(self.data.columns)).alias("column_count"),
        )

    def release(self) -> None:
        """Remove the rows written while loading, which cannot be read afterwards."""
        release(self.data)

    def sample_rows(self, size: int = ROW_SAMPLE) -> DataFrame:
        """(row): a few rows as JSON."""
        return self.data.limit(size).select(F.to_json(F.struct(*map(quoted, self.data.columns))).alias("row"))


def detect_format(path: str) -> str:
    """csv, tsv, json or parquet by extension, which a suffix of compression may follow; csv without one.

    Other extensions are refused; pass the format to `load_table` for folders with a dot in their name.
    """
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    while len(parts) > 1 and parts[-1] in COMPRESSION:
        parts.pop()
    if len(parts) == 1:
        return "csv"
    if parts[-1] not in FORMATS:
        raise ValueError(f"unsupported file type .{parts[-1]}; csv, tsv, json and parquet are read")
    return FORMATS[parts[-1]]


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> LoadedTable:
    """Load a file or folder in the given or detected format."""
    kind = fmt or detect_format(path)
    if kind == "csv":
        return load_delimited(spark, path, ",", "csv", **options)
    if kind == "tsv":
        return load_delimited(spark, path, "\t", "tsv", **options)
    if kind == "json":
        return load_json(spark, path, **options)
    if kind == "parquet":
        return load_parquet(spark, path, **options)
    raise ValueError(f"unsupported format {kind!r}")


def na_to_null(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null, in all text columns at once."""
    texts = set(text_columns(df))
    return df.select(
        *[F.when(~quoted(c).isin(*NA_TOKENS), quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns]
    )


def tidy_names(raw: Sequence[str | None]) -> tuple[list[str], list[str]]:
    """Trimmed, unique column names, and notes on what had to be changed."""
    notes, names, taken = [], [], set()
    trimmed = [(c or "").lstrip("\ufeff").strip() for c in raw]
    unnamed = [f"unnamed_{i}" for i, c in enumerate(trimmed) if not c]
    for i, name in enumerate(trimmed):
        base = name or f"unnamed_{i}"
        unique, suffix = base, 0
        # Spark resolves names without regard to case, so that is what has to be unique.
        while unique.lower() in taken:
            suffix += 1
            unique = f"{base}_{suffix}"
        taken.add(unique.lower())
        names.append(unique)
    if unnamed:
        notes.append(
            f"{len(unnamed)} unnamed column(s) detected (likely stray delimiters in the source file): {unnamed}"
        )
    if any(c and c != c.strip() for c in raw):
        notes.append("Column headers had leading/trailing whitespace trimmed.")
    return names, notes


def _file_facts(spark: SparkSession, path: str, measures: dict[str, Column]) -> DataFrame:
    """One row per file: `first`, its first line with something on it, and `measures` over all such lines."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Ids rise within a block, and blocks are ordered by where they start.
    lines = lines.withColumns({"place": F.struct("block", F.monotonically_increasing_id())})
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("first"), *[m.alias(n) for n, m in measures.items()])


def load_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    source_type: str = "csv",
    encoding: str | None = None,
    multi_line: bool | None = None,
    typed: bool = True,
) -> LoadedTable:
    """Delimited text with a header in each file.

    A first pass measures the files: header, encoding, and whether quotes stay open at the end of a line. Files that
    agree are parsed together, each in its own encoding, and columns meet by name whatever their order. Records may
    go on over several lines: files with quotes open at a line's end (or all or none, by `multi_line`) are split like
    others, and their lines put together to records before they are parsed. Only where lines end in carriage returns alone, or the
    encoding given has other bytes for line breaks, is such a file one task. Everything is parsed as text once and written to the shared
    folder; `typed` then measures which columns hold only numbers or booleans and casts those. Rows with more fields
    than their header are quarantined, shorter ones are padded with nulls.
    """
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
    facts = _file_facts(spark, path, {"latin": F.max(~F.is_valid_utf8("value")), "open": F.max(odd)})
    facts = staged(facts.select("file", F.hex(F.encode("first", "UTF-8")).alias("heading"), "first", "latin", "open"))
    # One row per kind of file, not per file.
    kinds = facts.groupBy("heading", "latin", "open").agg(F.min("file").alias("file"), F.first("first").alias("first"))
    kinds = kinds.orderBy("file").collect()
    if not kinds:
        raise ValueError(f"{path} is empty")
    notes = ["File was not valid UTF-8; decoded using 'latin-1' fallback."] * any(k["latin"] for k in kinds if not encoding)
    parts, name_notes = [], []
    for kind in kinds:
        charset = encoding or ("ISO-8859-1" if kind["latin"] else "UTF-8")
        broken = kind["open"] if multi_line is None else multi_line
        names, own_notes = tidy_names(_heading(spark, kind["file"], sep, charset, broken))
        name_notes += [n for n in own_notes if n not in name_notes]
        alike = facts.where((F.col("heading") == kind["heading"]) & (F.col("latin") == kind["latin"]) & (F.col("open") == kind["open"]))
        if broken and charset.upper() in delimited.SPLITTABLE and _ends_in_newlines(spark, kind["file"]):
            lines = delimited.lines_of(spark, path, alike.select("file"), sep, charset.upper())
            rows = _parsed_records(delimited.without_headings(delimited.records_of(lines)), sep, names)
        else:
            rows = _parsed(spark, path, sep, charset, broken, names)
            if len(kinds) > 1:
                rows = rows.join(alike.select(F.col("file").alias(FILE)), FILE, "left_semi")
        parts.append(rows.drop(FILE))
    names = parts[0].drop(CORRUPT, SURPLUS).columns
    if any(set(p.columns) != set(parts[0].columns) or p.columns != parts[0].columns for p in parts):
        name_notes.append("Files have different headers; columns were matched by name.")
    rows = staged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    names = [c for c in rows.columns if c not in (CORRUPT, SURPLUS)]
    rows = rows.select(*map(quoted, names), CORRUPT, SURPLUS)

    quarantined = rows.where(SURPLUS).select(F.col(CORRUPT).alias("record"))
    kept = na_to_null(rows.where(~F.col(SURPLUS)).drop(CORRUPT, SURPLUS))
    # One pass over the written rows: rows set aside, rows kept, and what each column holds.
    measures = [F.count_if(SURPLUS).alias("set_aside"), F.count_if(~F.col(SURPLUS)).alias("kept")]
    if typed:
        measures += _type_measures(names)
    found = na_to_null(rows.drop(CORRUPT).withColumn("__kept", ~F.col(SURPLUS))).agg(*measures).first()
    set_aside = found["set_aside"]
    if set_aside:
        notes.append(
            f"{set_aside} row(s) had a mismatched column count and were quarantined (excluded) during load."
        )
    notes += name_notes
    data = _cast_measured(kept, names, found) if typed else kept
    if not found["kept"]:
        notes.append("Loaded dataframe has zero rows.")
    return LoadedTable(data, quarantined, source_type, path, tuple(notes))


def _layout(sep: str, charset: str, broken: bool) -> dict:
    # A pruned parse would not notice rows with the wrong number of fields.
    return dict(sep=sep, quote='"', escape='"', multiLine=broken, columnPruning=False, encoding=charset)


def _heading(spark: SparkSession, file: str, sep: str, charset: str, broken: bool) -> list[str | None]:
    """Fields of the header as they are, before Spark renames empty and repeated ones."""
    return list(spark.read.options(header=False, **_layout(sep, charset, broken)).csv(file).first())


def _parsed(spark: SparkSession, path: str, sep: str, charset: str, broken: bool, names: list[str]) -> DataFrame:
    """All columns as text, the raw record of rows that do not fit, whether they hold too many fields, and their file."""
    reader = spark.read.schema(_text_schema(names)).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    rows = reader.options(**_layout(sep, charset, broken)).csv(path)
    return rows.select(*map(quoted, names), CORRUPT, _surplus(sep, names), F.col("_metadata.file_path").alias(FILE))


def _parsed_records(records: DataFrame, sep: str, names: list[str]) -> DataFrame:
    """What `_parsed` gives, from one row per record."""
    options = dict(sep=sep, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, maxCharsPerColumn="-1")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, CORRUPT])
    rows = records.select(F.col("file").alias(FILE), F.from_csv("record", schema, options).alias("__row"))
    rows = rows.select(*[F.col("__row")[c].alias(c) for c in [*names, CORRUPT]], FILE)
    return rows.select(*map(quoted, names), CORRUPT, _surplus(sep, names), FILE)


def _ends_in_newlines(spark: SparkSession, file: str) -> bool:
    """Whether the first line of a file has no carriage return but at its end."""
    first = spark.read.text(file, lineSep="\n").first()
    return first is not None and "\r" not in first.value.removesuffix("\r")


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])


def _surplus(sep: str, names: Sequence[str]) -> Column:
    record = F.col(CORRUPT)
    return F.coalesce(record.isNotNull() & (_field_count(record, sep) > len(names)), F.lit(False)).alias(SURPLUS)


def _field_count(record: Column, sep: str) -> Column:
    """Fields in a raw record: separators outside quotes, plus one."""
    unquoted = F.regexp_replace(record, delimited.QUOTED, "q")
    return F.length(unquoted) - F.length(F.translate(unquoted, sep, "")) + 1


def _type_measures(names: Sequence[str]) -> list[Column]:
    """For each text column the kept values that there are, and those that read as each narrower type."""
    measures = []
    for i, name in enumerate(names):
        value = F.when(F.col("__kept"), quoted(name))
        whole = value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull()
        measures += [
            F.count(value).alias(f"n{i}"),
            F.count_if(whole).alias(f"bigint{i}"),
            F.count(parse_number(value)).alias(f"double{i}"),
            F.count_if(value.isin(*BOOLEAN_TEXTS)).alias(f"boolean{i}"),
        ]
    return measures


def _cast_measured(df: DataFrame, names: Sequence[str], found: Row) -> DataFrame:
    """Cast columns that hold nothing but whole numbers, numbers or booleans; columns without values stay text."""
    columns = []
    for i, name in enumerate(names):
        n = found[f"n{i}"]
        kind = next((k for k in ("bigint", "double", "boolean") if n and found[f"{k}{i}"] == n), None)
        columns.append(quoted(name).try_cast(kind).alias(name) if kind else quoted(name))
    return df.select(*columns)


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted top-level columns; arrays and maps stay as they are."""

    def leaves(schema: T.StructType, parent: Column | None, prefix: str) -> list[Column]:
        columns = []
        for f in schema:
            c = quoted(f.name) if parent is None else parent.getField(f.name)
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                columns += leaves(f.dataType, c, f"{name}.")
            else:
                columns.append(c.alias(name))
        return columns

    return df.select(*leaves(df.schema, None, ""))


def load_json(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    schema: T.StructType | None = None,
    whole_bytes: int = WHOLE_BYTES,
) -> LoadedTable:
    """Records from files that hold one per line, a list of them, one object around such a list, or one record.

    Each file is read as what it holds: a file whose whole text is exactly one JSON value is a document; all others have
    a record per line, which splits across tasks (`multi_line` decides for all files instead). What stands around line
    breaks decides first, so only files that open like a document and go on like one are read whole to see. In a document that is an object, the
    first usual key with a list gives the records. Whatever is not a record is quarantined as it stands. Parsed rows are
    written once.

    Documents of more than `whole_bytes` are cut into their entries by many tasks, with the same result. One entry, and
    all there is around the list, can each be of 126 MiB; a document that is one larger record is refused by name.
    """
    facts = _json_facts(spark, path, multi_line)
    parts, tested, large = [], [], facts.where("maybe AND bytes > " + str(whole_bytes))
    verdict = facts.select("file", "maybe")
    if not large.isEmpty():
        cut, entries = _cut(spark, path, large, multi_line)
        verdict = facts.join(cut, "file", "left").select("file", F.coalesce("whole", "maybe").alias("maybe"), "whole")
        tested.append(entries)
    else:
        verdict = verdict.withColumn("whole", F.lit(None).cast("boolean"))
    # Kinds: documents cut above, documents to read whole, lines.
    if multi_line is None and not verdict.where("maybe AND whole IS NULL").isEmpty():
        verdict = staged(verdict)
        texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        texts = texts.join(verdict.where("maybe AND whole IS NULL").select("file"), "file", "left_semi")
        small = texts.select("file", _one_value("value").alias("one"))
        verdict = verdict.join(small, "file", "left").withColumn("maybe", F.coalesce("one", "maybe")).drop("one")
    kind = F.when(F.col("whole"), "cut").when(F.col("maybe"), "whole").otherwise("lines")
    facts = staged(verdict.select("file", kind.alias("kind")))
    kinds = {r["kind"] for r in facts.select("kind").distinct().collect()}
    if not kinds:
        raise ValueError(f"{path} is empty")

    def read(kind: str) -> DataFrame:
        lines = spark.read.text(path, wholetext=kind == "whole").where(F.length(F.trim("value")) > 0)
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
        if len(kinds) > 1:
            lines = lines.join(facts.where(F.col("kind") == kind).select("file"), "file", "left_semi")
        return lines.drop("file")

    if "lines" in kinds:
        parts.append(read("lines").select(F.lit("lines").alias("origin"), "value"))
    if "whole" in kinds:
        parts.append(_unwrapped(read("whole")))
    # Each value is tested once: entries cut above where they were cut, others here.
    if parts:
        tested.append(staged(reduce(DataFrame.union, parts).withColumn("good", _is_record("value"))))
    values = reduce(DataFrame.union, tested)
    raw = _from_texts(spark, values.where("good"), schema)
    flat = nan_to_null(flatten(raw.drop(CORRUPT) if CORRUPT in raw.columns else raw))
    names, name_notes = tidy_names(flat.columns)
    data = flat.toDF(*names)
    bad = values.where("NOT good").select(F.col("value").alias("record"))

    found = {(r["origin"], r["good"]): r["count"] for r in values.groupBy("origin", "good").count().collect()}
    notes = [f"Top-level JSON was an object; used the '{k}' list field." for k in ENVELOPE_KEYS if (k, True) in found or (k, False) in found]
    for key in ENVELOPE_KEYS:
        if (key, False) in found and (key, True) not in found:
            raise ValueError(f"the {key!r} list in {path} does not hold records")
    if ("object", True) in found:
        notes.append("Top-level JSON was a single object; wrapped as a one-row table.")
    set_aside = sum(n for (_, fine), n in found.items() if not fine)
    if set_aside:
        notes.append(f"{set_aside} entries are not JSON records and were quarantined during load.")
    notes += name_notes
    if not any(fine for _, fine in found):
        notes.append("Loaded dataframe has zero rows.")
    return LoadedTable(data, bad, "json", path, tuple(notes))


def _json_facts(spark: SparkSession, path: str, multi_line: bool | None) -> DataFrame:
    """One row per file: whether it may be one document, its bytes, and the depth of records in such a document.

    Files are read in pieces that end with closing braces, so no line is held as a whole however long it is. Pieces beyond
    what Spark parses are passed over; a file of nothing else holds lines.
    """
    reader = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_PIECE)
    pieces = reader.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.ascii(F.ltrim("value", F.lit(" \t\r\n\ufeff"))).alias("start"),
        (F.ltrim("value", F.lit(" \r\n")) != "").alias("some"),
        # A string holds no line break, so what follows a brace and a line break is a comma or closes something, or all is not one value.
        F.col("value").rlike(r"^[\]\s]*\n[\]\s]*[^,\]\s]").alias("parted"),
    )
    # Numbers only, so that rows are summed up where they are read.
    splits = pieces.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("bytes"),
        F.max("some").alias("some"),
        F.min_by("start", F.when(F.col("start") != 0, F.col("id"))).alias("start"),
        (F.count_if("parted") - F.when((F.col("block") == 0) & (F.min("id") == F.min(F.when(F.col("parted"), F.col("id")))), 1).otherwise(0)).alias("parted"),
    )
    facts = splits.groupBy("file").agg(
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.max("some").alias("some"),
        F.min_by("start", F.when(F.col("start").isNotNull(), F.col("block"))).alias("start"),
        F.sum("parted").alias("parted"),
    )
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length").where("length > 0")
    facts = files.join(facts, "file", "left")
    some = F.col("n").isNull() | F.col("some") | (F.col("n") > 1) | (F.col("bytes") == F.col("length"))
    listed, keyed = F.col("start") == ord("["), F.col("start") == ord("{")
    maybe = F.coalesce((listed | keyed) & (F.col("parted") == 0), F.lit(False)) if multi_line is None else F.lit(multi_line)
    facts = facts.where(some).select("file", maybe.alias("maybe"), F.coalesce("bytes", "length").alias("bytes"), F.when(listed, 1).otherwise(2).alias("level"))
    return staged(facts)


def _cut(spark: SparkSession, path: str, large: DataFrame, multi_line: bool | None) -> tuple[DataFrame, DataFrame]:
    """(file, whole): true for files cut here, null for those to read whole, false for lines; and the entries cut."""
    places = documents.placed(documents.pieces_of(spark, path, large.select("file", "level")))
    lists = documents.chosen_lists(places, ENVELOPE_KEYS)
    verdict, entries = documents.entries_of(places, lists.where("key IS NOT NULL"), _one_value, _is_record)
    known = large.join(lists.select("file", F.col("key").isNotNull().alias("listed")), "file", "left").join(verdict, "file", "left")
    too_large = known.where((~F.col("listed") & (F.col("bytes") > MOST_VALUE_BYTES)) | (F.col("frame_bytes") > MOST_VALUE_BYTES)).first()
    if too_large:
        raise ValueError(f"{too_large['file']} looks like one JSON record of more than {MOST_VALUE_BYTES >> 20} MiB; split it, or pass multi_line")
    whole = F.when(F.col("listed").isNull(), False).when(F.col("listed"), F.coalesce("whole", F.lit(False)))
    if multi_line:
        whole = F.when(whole, True)
    verdict = staged(known.select("file", whole.alias("whole")))
    # One row for each file cut.
    entries = entries.join(F.broadcast(verdict.where("whole").select("file")), "file", "left_semi")
    return verdict, entries.select("origin", "value", "good")


def _one_value(text: str) -> Column:
    """Whether a text is exactly one JSON value; the parser alone would pass over what follows the first."""
    mark = "\u2063end"
    bare = F.when(F.col(text).startswith("\ufeff"), F.regexp_replace(text, r"^\x{FEFF}", "")).otherwise(F.col(text))
    listed = F.try_parse_json(F.concat(F.lit("["), bare, F.lit(f',"{mark}"]')))
    return F.coalesce(F.try_variant_get(listed, "$[1]", "string") == mark, F.lit(False))


def _is_record(text: str) -> Column:
    return F.coalesce(_one_value(text) & F.col(text).rlike(r"^\s*\{"), F.lit(False))


def _unwrapped(documents: DataFrame) -> DataFrame:
    """(origin, value): the entries of each document as JSON text, and the key, list or object they come from."""
    keys = F.from_json("value", T.StructType([T.StructField(k, T.StringType()) for k in ENVELOPE_KEYS]))
    lists = [F.when(F.ltrim(F.col("keys")[k]).startswith("["), F.struct(F.lit(k).alias("origin"), F.col("keys")[k].alias("list"))) for k in ENVELOPE_KEYS]
    valid = F.try_parse_json("value").isNotNull()
    is_list = valid & F.ltrim("value").startswith("[")
    chosen = F.when(is_list, F.struct(F.lit("list").alias("origin"), F.col("value").alias("list"))).when(valid, F.coalesce(*lists))
    split = documents.withColumn("value", F.regexp_replace("value", r"^\x{FEFF}", "")).withColumns({"keys": keys}).select("value", chosen.alias("chosen"))
    entries = F.when(F.col("chosen").isNotNull(), F.from_json("chosen.list", T.ArrayType(T.StringType()))).otherwise(F.array("value"))
    # The document ends here: only its origin goes along with each entry.
    listed = split.select(F.coalesce("chosen.origin", F.lit("object")).alias("origin"), entries.alias("entries"))
    return listed.select("origin", F.explode("entries").alias("value"))


def _from_texts(spark: SparkSession, values: DataFrame, schema: T.StructType | None) -> DataFrame:
    """Rows of a column of JSON texts; Spark infers the schema over all of them unless it is given."""
    texts = getattr(values.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        reader = reader.schema(schema)
    return DataFrame(reader._jreader.json(texts), spark)


def load_parquet(spark: SparkSession, path: str) -> LoadedTable:
    raw = nan_to_null(spark.read.parquet(path))
    names, notes = tidy_names(raw.columns)
    data = raw.toDF(*names)
    if data.isEmpty():
        notes.append("Loaded dataframe has zero rows.")
    return LoadedTable(data, _nothing(spark), "parquet", path, tuple(notes))


def _nothing(spark: SparkSession) -> DataFrame:
    return fixed(spark, [], "record string")
