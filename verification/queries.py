"""One query per operator, each over a whole test table or the dirtied orders view."""

import bz2
import uuid
from collections.abc import Callable
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import (
    moment_literal,
    normalize_text,
    parse_date,
    parse_number,
    parse_number_lenient,
    state_code,
    whole_days,
)
from siftwell.operators import charts, detectors, duplicates, facts, outliers, profile, quality, report, statistics
from siftwell.operators import transforms, values
from siftwell.operators.findings import Lineage, analyze, caveat, findings_of, omitted_tests, test_statistics
from siftwell.operators.quantiles import quantiles
from siftwell.plans.cleaning import apply_cleaning, measured, propose_cleaning, with_examples
from siftwell.storage import shared_folder
from siftwell.sources.readers import load_json, load_table
from verification.dirty import dirty_orders

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

ACTION = ("action", "column", "reason", "count", "method", "severity", "rows_affected")
CAPS = {"max_trends": 6, "max_pairs": 15, "max_categories": 5, "max_measures": 5}
WIDE_BASES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
WIDE_COLUMNS = 208
LINEITEM_PAIRS = [
    ("l_quantity", "l_extendedprice"),
    ("l_quantity", "l_discount"),
    ("l_extendedprice", "l_tax"),
    ("l_partkey", "l_suppkey"),
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def wide_column(number: int) -> str:
    """A derived measure with gaps, each of its own."""
    first, second = WIDE_BASES[number % 4], WIDE_BASES[number // 4 % 4]
    return f"CASE WHEN (l_orderkey + l_linenumber * 3) % {number + 5} > 1 THEN {first} + {second} * {number % 7} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


# --- profiling ---------------------------------------------------------------------------------


@query
def profile_nulls(spark, sf_dir):
    return profile.null_profile(dirty_orders(spark, sf_dir))


@query
def column_kinds(spark, sf_dir):
    return facts.scan_facts(dirty_orders(spark, sf_dir))


@query
def profile_distinct(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"))


@query
def profile_distinct_documents(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "documents"))


@query
def profile_minmax(spark, sf_dir):
    measured_columns = profile.column_profile(table(spark, sf_dir, "lineitem"), samples=False)
    return measured_columns.select("position", "column", "min_value", "max_value")


@query
def profile_minmax_text(spark, sf_dir):
    measured_columns = profile.column_profile(dirty_orders(spark, sf_dir), samples=False)
    return measured_columns.select("position", "column", "min_value", "max_value")


@query
def infer_types(spark, sf_dir):
    return profile.inferred_types(dirty_orders(spark, sf_dir))


@query
def infer_types_documents(spark, sf_dir):
    return profile.inferred_types(table(spark, sf_dir, "documents"))


@query
def sample_values(spark, sf_dir):
    drawn = values.sample_values(dirty_orders(spark, sf_dir))
    return drawn.select("column", F.array_join("sample_values", "|").alias("sample_values"))


@query
def empty_columns(spark, sf_dir):
    blanked = dirty_orders(spark, sf_dir).withColumn("blank", F.when(F.col("o_orderkey") < 0, "x"))
    return profile.empty_columns(blanked)


@query
def value_frequencies(spark, sf_dir):
    return values.value_counts(dirty_orders(spark, sf_dir), "priority")


@query
def duplicate_count(spark, sf_dir):
    return duplicates.duplicate_count(dirty_orders(spark, sf_dir))


@query
def dedupe(spark, sf_dir):
    return duplicates.drop_duplicate_rows(dirty_orders(spark, sf_dir))


@query
def dedupe_by_fingerprint(spark, sf_dir):
    """The route of large tables: fingerprints that repeat, then only their rows, without a broadcast."""
    df = dirty_orders(spark, sf_dir)
    return duplicates.drop_duplicate_rows(df, row_count=10**12, broadcast_fingerprints=0)


@query
def quality_score(spark, sf_dir):
    return quality.quality_score(dirty_orders(spark, sf_dir))


@query
def quality_score_documents(spark, sf_dir):
    return quality.quality_score(table(spark, sf_dir, "documents"))


# --- scalar functions --------------------------------------------------------------------------


@query
def to_numeric_strict(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select("o_orderkey", parse_number(F.col("revenue")).alias("revenue"))


@query
def to_numeric_safe(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select("o_orderkey", parse_number_lenient(F.col("revenue")).alias("revenue"))


@query
def parse_dates(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select("o_orderkey", parse_date(F.col("order_date")).alias("order_date"))


@query
def normalized_text(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select(
        "o_orderkey", normalize_text(F.col("priority")).alias("priority"), normalize_text(F.col("state")).alias("state")
    )


@query
def state_codes(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select("o_orderkey", state_code(F.col("state")).alias("state"))


@query
def days_since_first(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    start = moment_literal(events.agg(F.min("ts")).first()[0])
    return events.select("event_id", whole_days(start, F.col("ts")).cast("bigint").alias("days"))


# --- detectors and plan ------------------------------------------------------------------------


def _actions(proposals: DataFrame) -> DataFrame:
    return proposals.select(*ACTION)


@query
def detect_duplicates(spark, sf_dir):
    return _actions(detectors.detect_duplicates(duplicates.duplicate_count(dirty_orders(spark, sf_dir))))


@query
def detect_missing(spark, sf_dir):
    return _actions(detectors.detect_missing(measured(dirty_orders(spark, sf_dir))))


@query
def detect_numeric_text(spark, sf_dir):
    return _actions(detectors.detect_numeric_text(measured(dirty_orders(spark, sf_dir))))


@query
def detect_us_states(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return detectors.detect_state_variants(with_examples(df, measured(df))).select(*ACTION, "note")


@query
def detect_case_variants(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return detectors.detect_case_variants(with_examples(df, measured(df))).select(*ACTION, "note")


@query
def detect_outliers_iqr(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return _actions(detectors.detect_outliers(outliers.outlier_counts(df, outliers.iqr_fences(df))))


@query
def detect_outliers_events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return _actions(detectors.detect_outliers(outliers.outlier_counts(df, outliers.iqr_fences(df))))


@query
def cleaning_plan(spark, sf_dir):
    return propose_cleaning(dirty_orders(spark, sf_dir)).actions.select("sequence", *ACTION)


@query
def plan_summary(spark, sf_dir):
    return propose_cleaning(dirty_orders(spark, sf_dir)).summary


@query
def focused_replan(spark, sf_dir):
    plan = propose_cleaning(dirty_orders(spark, sf_dir), focus="amount")
    return plan.actions.select("sequence", "action", "column", "severity", "focused")


# --- transforms --------------------------------------------------------------------------------


@query
def coerce_numeric(spark, sf_dir):
    return transforms.coerce_numbers(dirty_orders(spark, sf_dir), ["revenue"])


@query
def impute_median(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    filled = transforms.impute_median(df, transforms.medians(df, ["revenue", "amount"]))
    return rounded(filled.select("o_orderkey", "revenue", "amount"))


@query
def impute_mode(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    filled = transforms.impute_mode(df, transforms.most_frequent(df, ["status", "segment"]))
    return filled.select("o_orderkey", "status", "segment")


@query
def column_modes(spark, sf_dir):
    return values.modes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_quantity", "l_suppkey"])


@query
def standardize_states(spark, sf_dir):
    return transforms.standardize_states(dirty_orders(spark, sf_dir), ["state"]).select("o_orderkey", "state")


@query
def standardize_case(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return transforms.standardize_variants(df, transforms.variant_table(df, ["priority"]), ["priority"]).select("o_orderkey", "priority")


@query
def standardize_by_lookup(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    lookup = transforms.variant_table(df, ["priority"]).where("variant != canonical")
    return transforms.replace_by_lookup(df, "priority", lookup).select("o_orderkey", "priority")


@query
def variant_groups(spark, sf_dir):
    return transforms.variant_table(dirty_orders(spark, sf_dir), ["priority", "state"])


@query
def drop_outliers(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return transforms.drop_outliers(df, outliers.iqr_fences(df, ["amount"])).select("o_orderkey", "amount")


@query
def drop_sparse_nulls(spark, sf_dir):
    return transforms.drop_missing(dirty_orders(spark, sf_dir), ["sparse_id"]).select("o_orderkey", "sparse_id")


def _cleaned(spark, sf_dir, approved):
    df = dirty_orders(spark, sf_dir)
    return apply_cleaning(df, propose_cleaning(df), approved)


@query
def apply_safe_plan(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir, "safe").data)


@query
def apply_full_plan(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir, "all").data)


@query
def row_audit(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    changes = apply_cleaning(df, propose_cleaning(df), "safe", audit=True).changes
    rows = changes.select("o_orderkey", F.explode("changes").alias("c")).select("o_orderkey", "c.*")
    number = F.col("column").isin("revenue", "amount")
    return rows.select(
        "o_orderkey", "column", "action", "old", F.when(~number, F.col("new")).alias("new_text"),
        F.when(number, F.round(F.col("new").try_cast("double"), 4)).alias("new_number"),
    )


@query
def rows_dropped(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    dropped = apply_cleaning(df, propose_cleaning(df), "all", audit=True).dropped
    key = F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("o_orderkey")
    return dropped.select("action", "column", key, "copies")


@query
def apply_nothing(spark, sf_dir):
    return _cleaned(spark, sf_dir, "none").data


@query
def cleaning_log(spark, sf_dir):
    return _cleaned(spark, sf_dir, "safe").log.select("sequence", "action", "column", "method", "count", "status")


@query
def cleaning_summary(spark, sf_dir):
    return _cleaned(spark, sf_dir, "safe").summary()


# --- statistics and findings -------------------------------------------------------------------


@query
def describe(spark, sf_dir):
    return statistics.describe(table(spark, sf_dir, "lineitem"), limit=10)


@query
def describe_dirty(spark, sf_dir):
    return statistics.describe(dirty_orders(spark, sf_dir))


@query
def quantile_search(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = quantiles(df, ["l_quantity", "l_extendedprice", "l_discount"], (0.25, 0.5, 0.75), listed_values=1000)
    rows = [(c, *qs) for c, qs in found.items()]
    return rounded(spark.createDataFrame(rows, "column string, p25 double, p50 double, p75 double"))


@query
def group_means(spark, sf_dir):
    return rounded(statistics.group_means(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"))


@query
def group_moments(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return rounded(statistics.group_moments(lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]), 4)


@query
def categorical_columns(spark, sf_dir):
    return statistics.categorical_columns(dirty_orders(spark, sf_dir))


@query
def trend_stats(spark, sf_dir):
    trends = statistics.pair_table(table(spark, sf_dir, "events"), [], "ts", ["event_id", "user_id", "value"])
    return rounded(trends.select("y", "n", "r", "slope", "first", "last"))


@query
def trend_stats_text_dates(spark, sf_dir):
    trends = statistics.pair_table(dirty_orders(spark, sf_dir), [], "order_date", ["o_orderkey", "amount"])
    return rounded(trends.select("y", "n", "r", "slope", "first", "last"))


@query
def pct_change(spark, sf_dir):
    trends = statistics.pair_table(table(spark, sf_dir, "events"), [], "ts", ["user_id", "value"])
    return trends.select("y", statistics.percent_change(F.col("first"), F.col("last")).alias("pct_change"))


@query
def pearson_pairs(spark, sf_dir):
    pairs = statistics.pair_table(table(spark, sf_dir, "lineitem"), LINEITEM_PAIRS)
    return rounded(pairs.select("x", "y", "n", "r", "slope", "intercept"), 5)


def _compared(spark, sf_dir, name, category, measures) -> DataFrame:
    return statistics.group_tests(statistics.group_moments(table(spark, sf_dir, name), [category], measures))


@query
def welch_t(spark, sf_dir):
    compared = _compared(spark, sf_dir, "lineitem", "l_linestatus", ["l_quantity", "l_extendedprice"])
    return rounded(compared.select("measure", "test", "groups", "n", "stat", "df1"), 4)


@query
def anova_f(spark, sf_dir):
    compared = _compared(spark, sf_dir, "events", "event_type", ["user_id", "value"])
    return rounded(compared.select("measure", "test", "groups", "n", "stat", "df1", "df2"), 5)


@query
def extreme_groups(spark, sf_dir):
    compared = _compared(spark, sf_dir, "lineitem", "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"])
    return compared.select("measure", "highest", "lowest")


@query
def p_values(spark, sf_dir):
    return rounded(test_statistics(table(spark, sf_dir, "events"), **CAPS).select("kind", "x", "y", "p"))


@query
def p_values_all(spark, sf_dir):
    """Every test of events, none left out."""
    tests = test_statistics(table(spark, sf_dir, "events")).select("kind", "x", "y", "n", "statistic", F.round("stat", 4).alias("stat"), "p")
    return rounded(tests)


@query
def p_values_all_lineitem(spark, sf_dir):
    return rounded(test_statistics(table(spark, sf_dir, "lineitem")).select("kind", "x", "y", "n", "statistic", "p"))


@query
def pearson_wide(spark, sf_dir):
    """All pairs of over 200 derived columns with gaps."""
    wide = table(spark, sf_dir, "lineitem").selectExpr(*[f"CAST({wide_column(i)} AS DOUBLE) AS w{i}" for i in range(WIDE_COLUMNS)])
    pairs = statistics.pair_table(wide, list(combinations(wide.columns, 2)))
    return pairs.select("x", "y", "n", F.round("r", 5).alias("r"), F.round("slope", 3).alias("slope"))


def _shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("related_columns", F.array_join("related_columns", "|")).drop("finding_id")


@query
def ranked_findings(spark, sf_dir):
    return _shown(findings_of(table(spark, sf_dir, "events"), limit=6, **CAPS))


@query
def ranked_findings_lineitem(spark, sf_dir):
    return _shown(findings_of(table(spark, sf_dir, "lineitem"), limit=6, **CAPS))


@query
def ranked_findings_all(spark, sf_dir):
    """Every finding, without caps or a limit."""
    return _shown(findings_of(table(spark, sf_dir, "events")))


@query
def ranked_findings_all_lineitem(spark, sf_dir):
    return _shown(findings_of(table(spark, sf_dir, "lineitem")))


@query
def findings_omitted(spark, sf_dir):
    """What the caps of the capped queries leave out."""
    return omitted_tests(table(spark, sf_dir, "lineitem"), **CAPS)


@query
def findings_after_cleaning(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir, "safe")
    return _shown(findings_of(cleaned.data, cleaned.log, limit=6, **CAPS))


@query
def caveats(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir, "safe")
    tests = test_statistics(cleaned.data, p_values=False, **CAPS)
    return tests.select("kind", "x", "y", caveat(F.array("x", "y"), Lineage.of(cleaned.log)).alias("caveat"))


# --- charts and report -------------------------------------------------------------------------


@query
def line_series(spark, sf_dir):
    return charts.line_series(table(spark, sf_dir, "events"), "ts", "value")


@query
def line_series_daily(spark, sf_dir):
    return rounded(charts.line_series(table(spark, sf_dir, "events"), "ts", "value", "1 day"))


@query
def scatter_points(spark, sf_dir):
    return charts.scatter_points(dirty_orders(spark, sf_dir), "amount", "sparse_id")


@query
def scatter_trendline(spark, sf_dir):
    return rounded(charts.trendline(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice"), 4)


@query
def bar_series(spark, sf_dir):
    return rounded(charts.bar_series(dirty_orders(spark, sf_dir), "status", "amount"))


@query
def chart_routing(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    routing = charts.route_charts(events, analyze(events, limit=6, **CAPS).findings)
    return routing.charts.select("rank", "chart_type", "caption", "n").unionByName(
        routing.skipped.select("rank", "reason"), allowMissingColumns=True
    )


@query
def report_schema(spark, sf_dir):
    return report.schema_overview(profile.column_profile(dirty_orders(spark, sf_dir), samples=False))


@query
def report_methodology(spark, sf_dir):
    return report.methodology(_cleaned(spark, sf_dir, "safe").log)


@query
def report_findings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = analyze(events, limit=6, **CAPS).findings
    return report.findings_table(found, charts.route_charts(events, found))


@query
def report_findings_executive(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = analyze(events, limit=6, **CAPS).findings
    return report.findings_table(found, charts.route_charts(events, found), "executive")


@query
def report_headline(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir, "safe")
    return report.headline(findings_of(cleaned.data, cleaned.log, limit=6, **CAPS), cleaned.summary())


# --- sources -----------------------------------------------------------------------------------


@query
def csv_load(spark, sf_dir):
    path = fresh_path(spark)
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return load_table(spark, path).data


@query
def tsv_load(spark, sf_dir):
    path = fresh_path(spark)
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_name", " c_name ")
    customers.write.option("header", True).option("sep", "\t").csv(path)
    return load_table(spark, path, "tsv").data


def _csv_lines(spark, sf_dir) -> DataFrame:
    """Order rows as CSV lines: some with a field too many, some one short, some with a missing-value token."""
    key = F.col("o_orderkey").cast("string")
    cells: Column = (
        F.when(F.col("o_orderkey") % 10 == 0, F.concat_ws(",", key, "o_orderstatus", "o_custkey", F.lit("extra")))
        .when(F.col("o_orderkey") % 10 == 1, F.concat_ws(",", key, "o_orderstatus"))
        .when(F.col("o_orderkey") % 10 == 2, F.concat_ws(",", key, F.lit("N/A"), "o_custkey"))
        .otherwise(F.concat_ws(",", key, F.concat(F.lit('"'), "o_orderpriority", F.lit(',x"')), "o_custkey"))
    )
    return table(spark, sf_dir, "orders").select(cells.alias("value"))


def _load_lines(spark, sf_dir):
    path = fresh_path(spark)
    # The lines hold no tab, so with tabs as separator they are written as they are, below a header.
    lines = _csv_lines(spark, sf_dir).withColumnRenamed("value", "k,v,c")
    lines.write.options(header=True, sep="\t", escapeQuotes=False).csv(path)
    return load_table(spark, path)


@query
def csv_ragged(spark, sf_dir):
    return _load_lines(spark, sf_dir).data


@query
def csv_quarantine(spark, sf_dir):
    return _load_lines(spark, sf_dir).quarantined


@query
def csv_issues(spark, sf_dir):
    return _load_lines(spark, sf_dir).issues


@query
def json_load(spark, sf_dir):
    path = fresh_path(spark)
    nested = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("detail")
    )
    nested.write.json(path)
    return load_json(spark, path, multi_line=False).data


def _write_document(records: DataFrame, path: str, head: str, tail: str, first: str, sep: str):
    """One file with one JSON document of all `records` (value): rendered and joined to runs by many tasks, written as a stream by one.

    `first` stands before the first record, a comma before the others, `sep` between lines.
    """

    def runs(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"value": [f"{sep},".join(batch.column(0).to_pylist())]})

    def framed(batches):
        yield pa.RecordBatch.from_pydict({"value": [head]})
        before = first
        for batch in batches:
            for run in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [before + run]})
                before = ","
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    joined = records.select("value").mapInArrow(runs, "value string").repartition(1)
    joined.mapInArrow(framed, "value string").write.text(path, lineSep=sep)


def _write_packed_document(records: DataFrame, path: str, head: str, tail: str):
    """One bzip2 file with one JSON document: `head`, each of `records` (value) after a comma, `tail`, in lines.

    Many tasks can read such a file, as they can one without compression. Rendered and compressed by many tasks to streams, which one task writes one after the other.
    """

    def packed(text) -> pa.RecordBatch:
        # The smallest blocks are the fastest to read.
        return pa.RecordBatch.from_pydict({"value": [bz2.compress(text, 1)]})

    def runs(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).cast(pa.large_binary())
                start, stop = (int.from_bytes(texts.buffers()[1][8 * i : 8 * i + 8].to_pybytes(), "little") for i in (texts.offset, texts.offset + len(texts)))
                yield packed(memoryview(texts.buffers()[2])[start : stop - 1])

    def framed(batches):
        yield packed(head.encode())
        yield from batches
        yield packed(tail.encode())

    lines = records.select(F.concat(F.lit(","), "value", F.lit("\n")).alias("value"))
    joined = lines.mapInArrow(runs, "value binary").repartition(1)
    # The streams are written as they are, between them one that holds a line break.
    streams = joined.mapInArrow(framed, "value binary").select(F.col("value").cast("string"))
    streams.write.option("encoding", "ISO-8859-1").text(path, lineSep=bz2.compress(b"\n", 1).decode("latin-1"))
    context = records.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    (written,) = files.globStatus(context._jvm.org.apache.hadoop.fs.Path(folder, "part-*"))
    if not files.rename(written.getPath(), context._jvm.org.apache.hadoop.fs.Path(folder, "document.json.bz2")):
        raise OSError(f"{written.getPath()} could not be renamed")


@query
def json_large_document(spark, sf_dir):
    """The whole of orders as one JSON document of one line, loaded with default options."""
    path = fresh_path(spark)
    record = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    _write_document(table(spark, sf_dir, "orders").select(F.to_json(record).alias("value")), path, '{"data":[', "]}", "", " ")
    return load_json(spark, path).data


@query
def json_document_in_pieces(spark, sf_dir):
    """The whole of lineitem, all columns, as one JSON document that is cut into records by many tasks."""
    path = fresh_path(spark)
    record = F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd"})
    # A null stands before the first record. Its text would take ten times the disk of the table.
    _write_packed_document(table(spark, sf_dir, "lineitem").select(record.alias("value")), path, '{"meta":{"n":[1]},"data":[null', "]}")
    return load_json(spark, path, whole_bytes=1 << 20).data


@query
def json_unwrap(spark, sf_dir):
    path = fresh_path(spark)
    # One envelope object per file, each with at most 500 records.
    record = F.struct("o_orderkey", "o_custkey", F.struct(F.col("o_orderstatus").alias("code")).alias("status"))
    files = (
        table(spark, sf_dir, "orders")
        .groupBy(F.floor(F.col("o_orderkey") / 500).alias("part"))
        .agg(F.to_json(F.struct(F.collect_list(record).alias("data"), F.lit(1).alias("meta"))).alias("value"))
    )
    files.write.partitionBy("part").text(path)
    return load_json(spark, path).data


@query
def latin1_load(spark, sf_dir):
    path = fresh_path(spark)
    accented = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" é")).alias("segment"))
    accented.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return load_table(spark, path).data


@query
def parquet_load(spark, sf_dir):
    return load_table(spark, f"{sf_dir}/customer.parquet").data


@query
def load_summary(spark, sf_dir):
    return load_table(spark, f"{sf_dir}/orders.parquet").summary()


# --- what loaders and statistics must not lose ----------------------------------------------------


def _text_files(spark, path, name, lines: DataFrame):
    lines.select(F.col("value").cast("string")).write.text(f"{path}/{name}")


@query
def json_lines_load(spark, sf_dir):
    """One record per line, all columns, without an option."""
    path = fresh_path(spark)
    table(spark, sf_dir, "conversations").write.json(path)
    return load_table(spark, path, "json").data


@query
def json_mixed_envelopes(spark, sf_dir):
    """Documents with different keys around their records, a plain list, and lines, side by side."""
    path = fresh_path(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("string"))
    record = F.to_json(F.struct("*"))
    for i, (before, after) in enumerate((('{"data":[', '],"n":1}'), ('{"meta":{"data":1},"records":[', "]}"), ("[", "]"))):
        own = orders.where(F.col("o_orderkey") % 4 == i).select(record.alias("r"), (F.col("o_orderkey") % 16).alias("k"))
        grouped = own.groupBy("k").agg(F.concat(F.lit(before), F.array_join(F.collect_list("r"), ","), F.lit(after)).alias("value"))
        _text_files(spark, path, f"part{i}", grouped.repartition(16, "k"))
    _text_files(spark, path, "part3", orders.where("o_orderkey % 4 = 3").select(record.alias("value")))
    return load_table(spark, f"{path}/*", "json").data


@query
def json_quarantine(spark, sf_dir):
    path = fresh_path(spark)
    value = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit('{"k": '), "o_orderkey")).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"))))
    table(spark, sf_dir, "orders").select(value.alias("value")).write.text(path)
    return load_table(spark, path, "json").quarantined


@query
def csv_quoted_newlines(spark, sf_dir):
    """Whole documents, whose texts hold line breaks, commas and quotes."""
    path = fresh_path(spark)
    table(spark, sf_dir, "documents").write.options(header=True, escape='"', quoteAll=True).csv(path)
    return load_table(spark, path, "csv").data


@query
def csv_header_orders(spark, sf_dir):
    """Files whose columns stand in another order."""
    path = fresh_path(spark)
    customers = table(spark, sf_dir, "customer").drop("c_acctbal")
    for i, columns in enumerate((customers.columns, customers.columns[::-1])):
        customers.where(F.col("c_custkey") % 2 == i).select(*columns).write.option("header", True).csv(f"{path}/part{i}")
    return load_table(spark, f"{path}/*", "csv").data.select(*customers.columns)


@query
def parse_dates_notations(spark, sf_dir):
    """Every notation in turn; those without a clock drop it, offsets lead to universal time."""
    patterns = ("d-MMM-yy", "MM.dd.yyyy", "yyyy.MM.dd", "yyyy-MM", "MMM d yyyy hh:mm a", "yyyyMMdd'T'HHmmss", "EEEE, MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    moment = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(patterns):
        text = F.when(F.col("o_orderkey") % 8 == i, F.date_format(moment, pattern)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text).alias("moment"))


def _odd_values(spark, sf_dir) -> DataFrame:
    """Events whose values are infinite or not a number here and there."""
    key = F.col("event_id")
    value = F.when(key % 50 == 0, float("inf")).when(key % 50 == 1, float("-inf")).when(key % 50 == 2, float("nan")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


@query
def quantile_infinities(spark, sf_dir):
    at = (0.0, 0.01, 0.5, 0.99, 1.0)
    found = quantiles(_odd_values(spark, sf_dir), ["value"], at, listed_values=100)["value"]
    return spark.createDataFrame([(p, v) for p, v in zip(at, found)], "p double, value double")


@query
def profile_nan(spark, sf_dir):
    return profile.null_profile(_odd_values(spark, sf_dir)).select("column", "row_count", "null_count")


@query
def profile_minmax_wide_integers(spark, sf_dir):
    """Whole numbers as text that doubles cannot tell apart."""
    wide = table(spark, sf_dir, "orders").select((F.lit(9007199254740992) + F.col("o_orderkey")).cast("string").alias("k"))
    return profile.column_profile(wide, samples=False).select("column", "min_value", "max_value")


@query
def standardize_many(spark, sf_dir):
    """Spellings of far more values than a plan holds, by a join."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    spelled = names.union(names.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name"))).union(names)
    return transforms.standardize_variants(spelled, transforms.variant_table(spelled, ["c_name"]), ["c_name"])


@query
def lookup_by_shuffle(spark, sf_dir):
    """A lookup too large to broadcast, with repeated variants."""
    lookup = table(spark, sf_dir, "customer").select(F.col("c_name").alias("variant"), F.concat(F.lit("x"), "c_custkey").alias("canonical"))
    lookup = lookup.union(lookup.select("variant", F.lit("z")))
    return transforms.replace_by_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", lookup, max_broadcast=0)


@query
def all_tests_lineitem(spark, sf_dir):
    """How many tests of each kind there are when nothing is left out."""
    tests = test_statistics(table(spark, sf_dir, "lineitem"), p_values=False)
    return tests.groupBy("kind").agg(F.countDistinct("x", "y").alias("n"))


@query
def custom_detector(spark, sf_dir):
    """A detector of one's own: text columns in which no value repeats."""

    def unique_text(facts: DataFrame) -> DataFrame:
        unique = facts.where((F.col("kind") == "text") & (F.col("distinct_count") == F.col("non_null")))
        return detectors.proposals(unique, 6, "flagged_not_dropped", F.lit("every value occurs once"), F.col("non_null"), severity="review")

    actions = propose_cleaning(table(spark, sf_dir, "customer"), detectors=[unique_text]).actions
    return actions.where("reason = 'every value occurs once'").select(*ACTION)
