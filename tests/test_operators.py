from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import statistics
from siftwell.operators.charts import chart_data, route_charts, trendline
from siftwell.operators.columns import numeric_columns, text_columns
from siftwell.operators.duplicates import drop_duplicate_rows, duplicate_count
from siftwell.operators.findings import Lineage, analyze, findings_of, test_statistics as statistics_of
from siftwell.operators.outliers import iqr_fences
from siftwell.operators.profile import column_profile, empty_columns
from siftwell.operators.quality import quality_score
from siftwell.operators.quantiles import quantiles
from siftwell.operators.statistics import categorical_columns, describe, group_moments, group_tests, pair_table
from siftwell.operators.transforms import replace_by_lookup
from siftwell.operators.values import modes, sample_values

ROUTES = [{}, {"listed_values": 0}, {"buckets": 4, "listed_values": 3}, {"buckets": 2, "listed_values": 0}]


@pytest.mark.parametrize("route", ROUTES)
def test_quantiles_match_numpy(spark, route):
    rng = np.random.default_rng(5)
    n = 2000
    table = {
        "normal": rng.normal(size=n),
        "tailed": np.exp(rng.normal(scale=6, size=n)),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n).astype(float)),
        "flat": np.full(n, 3.5),
        "wide": np.where(np.arange(n) % 2 == 0, -1.7e308, 1.7e308),
    }
    rows = [tuple(float(table[c][i]) for c in table) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in table) + ", nothing double")
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = quantiles(df, [*table, "nothing"], at, **route)
    assert set(found) == set(table)
    for c in ("normal", "tailed", "hot", "flat"):
        assert found[c] == pytest.approx(list(np.quantile(table[c], at)), rel=1e-12)
    assert found["wide"][0] == -1.7e308 and found["wide"][-1] == 1.7e308


def test_quantiles_of_whole_numbers_with_nulls(spark):
    df = spark.createDataFrame([(None,), (4,), (1,), (2,), (None,), (3,)], "v bigint")
    assert quantiles(df, ["v"], (0.5,)) == quantiles(df, ["v"], (0.5,), listed_values=0) == {"v": [2.5]}


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "a", None), (None, "a", None), (None, "a", None), (2, "", "b")]
    return spark.createDataFrame(rows, "k int, x string, y string")


def test_rows_that_differ_in_where_their_nulls_are_are_not_duplicates(copies):
    assert duplicate_count(copies).first()[0] == 3


@pytest.mark.parametrize("route", [{}, {"row_count": 7, "plain_rows": 0}, {"row_count": 7, "plain_rows": 0, "broadcast_fingerprints": 0}])
def test_one_of_each_row_stays(copies, route):
    left = drop_duplicate_rows(copies, **route)
    assert sorted(map(str, left.collect())) == sorted(map(str, copies.distinct().collect()))
    assert left.columns == copies.columns


def test_duplicates_with_maps_and_arrays(spark):
    df = spark.sql("""
      SELECT * FROM VALUES (map('a', 1, 'b', 2), array(1, null)), (map('b', 2, 'a', 1), array(1, null)),
        (map('a', 1), array(null, 1)), (map('a', 1), array(1, null)) AS t(`m.x`, l)""")
    assert duplicate_count(df).first()[0] == 1
    for route in ({}, {"row_count": 4, "plain_rows": 0}):
        assert drop_duplicate_rows(df, **route).count() == 3


def test_hot_row_is_one_row(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    assert duplicate_count(df).first()[0] == 1666
    assert drop_duplicate_rows(df, 5000, plain_rows=0).count() == 3334


def test_profile_of_every_logical_type(spark):
    rows = [
        (i, i / 2 if i % 2 else None, i % 2 == 0, str(i), f"{i}.5", f"2024-01-{i % 28 + 1:02d}", "x", f"u{i:04d}", f"c{i % 3}",
         f"{i} words that go on for long enough", None)
        for i in range(200)
    ]
    names = "n int, f double, b boolean, ti string, tf string, td string, k string, u string, c string, t string, e string"
    profile = {r["column"]: r for r in column_profile(spark.createDataFrame(rows, names)).collect()}
    types = {c: r["inferred_type"] for c, r in profile.items()}
    assert types == {
        "n": "integer", "f": "float", "b": "boolean", "ti": "integer", "tf": "float", "td": "date", "k": "constant",
        "u": "identifier", "c": "categorical", "t": "text", "e": "unknown",
    }
    assert (profile["ti"]["min_value"], profile["ti"]["max_value"]) == ("0", "199")
    assert (profile["td"]["min_value"], profile["td"]["max_value"]) == ("2024-01-01 00:00:00", "2024-01-28 00:00:00")
    assert (profile["f"]["null_count"], profile["f"]["null_pct"], profile["f"]["min_value"]) == (100, 0.5, "0.5")
    assert profile["n"]["sample_values"] == ["0", "1", "2", "3"] and profile["e"]["sample_values"] == []
    assert [r["column"] for r in empty_columns(spark.createDataFrame(rows, names)).collect()] == ["e"]


def test_profile_without_exact_counts_needs_no_value_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("t"))
    exact = {r["column"]: r for r in column_profile(df).collect()}
    sketched = {r["column"]: r for r in column_profile(df, samples=False, exact=False).collect()}
    assert sketched["t"]["unique_count"] == 7
    assert abs(sketched["id"]["unique_count"] - 1000) < 100
    assert all(sketched[c]["inferred_type"] == exact[c]["inferred_type"] for c in exact)


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0), ("b", 2, 3.0)], "`a.b` string, `x``y z` int, `1` double")
    assert [r["unique_count"] for r in column_profile(df).orderBy("position").collect()] == [2, 2, 2]
    assert duplicate_count(df).first()[0] == 1
    assert describe(df).count() == 2
    assert sample_values(df).where("column = 'a.b'").first()["sample_values"] == ["a", "b"]


def test_quality_of_an_empty_table_is_zero(spark):
    assert quality_score(spark.createDataFrame([], "a string, b int")).first()["quality_score"] == 0.0


def test_selectors_leave_booleans_out_of_numbers(spark):
    df = spark.createDataFrame([], "a int, b boolean, c string, d double, e decimal(9,2), f date")
    assert numeric_columns(df) == ["a", "d", "e"] and text_columns(df) == ["c"]


def test_mode_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), (None, None)], "t string, v double")
    assert {r["column"]: r["value"] for r in modes(df, ["t", "v"]).collect()} == {"t": "a", "v": "1.0"}


def test_fences_need_enough_values_and_spread(spark):
    df = spark.range(7).select("id", F.lit(1.0).alias("flat"))
    assert iqr_fences(df) == {}
    assert iqr_fences(spark.range(8).select("id", F.lit(1.0).alias("flat"))) == {"id": (-3.5, 10.5)}


def test_lookup_by_shuffle_equals_lookup_by_broadcast(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    pairs = spark.createDataFrame([("hot", "H"), ("4", "four")], "variant string, canonical string")
    small = replace_by_lookup(df, "v", pairs)
    large = replace_by_lookup(df, "v", pairs, max_broadcast=0)
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.where("v = 'H'").count() == 100


# --- tests and findings ------------------------------------------------------------------------


def test_constant_columns_are_not_correlated(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), F.lit(0.1).alias("flat"), (F.col("id") * 3 + 1).alias("line"))
    moments = {(r["x"], r["y"]): r for r in pair_table(df, [("x", "flat"), ("x", "line")]).collect()}
    assert moments["x", "flat"]["r"] is None
    assert moments["x", "line"]["r"] == pytest.approx(1.0)
    assert moments["x", "line"]["slope"] == pytest.approx(3.0) and moments["x", "line"]["intercept"] == pytest.approx(1.0)


def test_pair_moments_far_from_zero_stay_accurate(spark):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=500)
    y = 1e9 + 0.5 * (x - 1e9) + rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert pair_table(df, [("x", "y")]).first()["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def groups(spark, values):
    rows = [(level, float(v)) for level, vs in values.items() for v in vs]
    return group_tests(group_moments(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"])).collect()


def test_groups_without_inner_spread(spark):
    assert groups(spark, {"a": [1, 1, 1], "b": [1, 1, 1]})[0]["stat"] is None
    assert groups(spark, {"a": [1, 1, 1], "b": [2, 2, 2]})[0]["stat"] == float("-inf")
    assert groups(spark, {"a": [1, 1, 1], "b": [2, 2, 2], "c": [2, 2, 2]})[0]["stat"] == float("inf")


def test_small_groups_count_for_the_extremes_only(spark):
    (row,) = groups(spark, {"a": [1, 2, 3], "b": [4, 5, 7], "c": [99], "d": [-50, -51]})
    assert (row["groups"], row["test"], row["n"], row["highest"], row["lowest"]) == (2, "t-test", 6, "c", "d")
    assert groups(spark, {"a": [1, 2, 3], "b": [4]}) == []


def test_categories_have_two_to_twelve_levels(spark):
    df = spark.range(600).select(*[(F.col("id") % n).cast("string").alias(f"c{n}") for n in (1, 2, 12, 13, 300)])
    assert [r["column"] for r in categorical_columns(df).orderBy("position").collect()] == ["c2", "c12"]


@pytest.fixture(scope="module")
def sales(spark):
    """A rising measure with a group effect and an unrelated one, dates as text."""
    return spark.range(400).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"),
        F.when(F.col("id") % 2 == 0, "north").otherwise("south").alias("area"),
        (F.col("id") * 2 + F.when(F.col("id") % 2 == 0, 300).otherwise(0) + (F.col("id") * 7919 % 13)).cast("double").alias("sales"),
        (F.col("id") * 7919 % 101).cast("double").alias("noise"),
    )


def test_findings_are_ranked_and_worded(spark, sales):
    result = analyze(sales, goal="why")
    found = result.findings.collect()
    assert result.goal == "why" and result.summary_stats.count() == 2
    assert [f["rank"] for f in found] == list(range(1, len(found) + 1)) and len(found) <= 6
    # Highs come before mediums, and p-values rise within each.
    assert [(f["confidence"], f["p_value"]) for f in found] == sorted((f["confidence"], f["p_value"]) for f in found)
    texts = [f["summary"] for f in found]
    assert any(t.startswith("sales has increased over time (+") and t.endswith("tracked by day.") for t in texts)
    assert "sales differs significantly across area groups — 'north' averages highest, 'south' lowest." in texts
    assert "sales shows no significant correlation with noise." in texts


def test_a_perfect_fit_has_p_zero(spark):
    line = spark.range(30).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    (row,) = statistics_of(line).collect()
    assert row["p"] == 0.0 and row["r"] == pytest.approx(1.0)


def test_caveats_follow_the_log(spark, sales):
    log = spark.createDataFrame(
        [("dropped_rows", None, 5, "approved"), ("imputed", "sales", 3, "approved"), ("imputed", "noise", 3, "rejected")],
        "action string, column string, count bigint, status string",
    )
    lineage = Lineage.of(log)
    assert lineage == Lineage(5, ("sales",))
    for f in findings_of(sales, log).collect():
        assert f["caveat"].startswith("analysis excludes 5 row(s) removed as duplicates during cleaning")
        assert ("column(s) ['sales'] were modified" in f["caveat"]) == ("sales" in f["related_columns"])


def test_findings_are_split_into_charts_and_reasons(spark, sales):
    found = analyze(sales).findings
    routing = route_charts(sales, found)
    drawn, skipped = routing.charts.collect(), routing.skipped.collect()
    assert {c["finding_id"] for c in drawn} | {s["finding_id"] for s in skipped} == {f["finding_id"] for f in found.collect()}
    assert all(c["n"] == 400 for c in drawn)
    gone = route_charts(sales.drop("sales"), found)
    assert "Insufficient" in " ".join(s["reason"] for s in gone.skipped.collect())
    for c in drawn:
        x, y = next(f["related_columns"] for f in found.collect() if f["finding_id"] == c["finding_id"])
        assert chart_data(sales, c["chart_type"], x, y).count() > 0


def test_trendline_needs_spread(spark):
    df = spark.range(10).select(F.lit(1.0).alias("x"), F.col("id").alias("y"))
    assert trendline(df, "x", "y").count() == 0
    assert trendline(df, "y", "x").count() == 50


def test_tables_without_rows_or_plain_columns(spark):
    empty = spark.createDataFrame([], "a string, b int, c date")
    assert analyze(empty).findings.count() == 0
    assert {r["inferred_type"] for r in column_profile(empty).collect()} == {"unknown"}
    nested = spark.range(5).select(F.array("id").alias("a"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    assert analyze(nested).findings.count() == 0
    assert [r["unique_count"] for r in column_profile(nested).orderBy("position").collect()] == [5, 5]


def test_dates_do_not_depend_on_the_session_zone(spark):
    df = spark.range(40).select(
        F.expr("timestamp_ntz'2024-03-09 12:00:00' + make_interval(0, 0, 0, 0, CAST(id * 7 AS INT), 0, 0)").alias("t"),
        (F.col("id") * 2).alias("v"),
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        tables = []
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            tables.append(pair_table(df, [], "t", ["v"]).collect())
        assert tables[0] == tables[1] and tables[0][0]["first"] == 0 and tables[0][0]["last"] == 78
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_products_of_many_columns_are_what_sums_of_each_pair_are(spark, monkeypatch):
    c = 13
    columns = [
        F.when(F.col("id") % (i + 2) > 0, (F.sin(F.col("id") * (i + 1)) * 10 + i * 1000).cast("double")).alias(f"c{i}") for i in range(c - 3)
    ]
    odd = [F.lit(7.1).alias("same"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 3, 1.0).alias("one")]
    df = spark.range(500).select(*columns, *odd)
    pairs = [(x, y) if i % 3 else (y, x) for i, (x, y) in enumerate(combinations(df.columns, 2))]

    def found(width, held):
        monkeypatch.setattr(statistics, "AGGREGATE_WIDTH", width)
        monkeypatch.setattr(statistics, "GRAM_COLUMNS", held)
        table = statistics.pair_table(df, pairs)
        return {r.sequence: r for r in table.select("sequence", "x", "y", "n", "r", "slope", "intercept").collect()}

    plain = found(10_000, 1024)
    for held in (1024, 8, 14):
        wide = found(20, held)
        assert wide.keys() == plain.keys() and len(plain) > 60
        for key, row in plain.items():
            assert wide[key][:4] == row[:4]
            assert list(wide[key][4:]) == [v if v is None else pytest.approx(v, rel=1e-7, abs=1e-9) for v in row[4:]]
