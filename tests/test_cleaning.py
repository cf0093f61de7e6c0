import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell import apply_cleaning, propose_cleaning, quality_score
from siftwell.operators.transforms import replace_by_lookup
from siftwell.plans.cleaning import EXECUTION_ORDER
from siftwell.storage import shared_folder, staged
from verification.dirty import dirty_orders

SCHEMA = "city string, state string, price string, age double, grade string, mostly_missing string"


@pytest.fixture(scope="module")
def messy(spark):
    """60 rows, three of them copies: spellings, states, separators, nulls, one outlier."""
    rows = []
    for i in range(57):
        city = ("Oslo", "oslo", " Oslo", "Bergen")[i % 4]
        state = ("NY", "ny", "New York", "CA")[i % 4]
        price = None if i % 19 == 5 else (f"1,{i:03d}.50" if i % 3 == 0 else f"{i}.25")
        age = None if i % 20 == 3 else (900.0 if i == 50 else float(20 + i % 30))
        grade = None if i % 5 == 0 else ("A", "B")[i % 2]
        rows.append((city, state, price, age, grade, "x" if i % 4 == 0 else None))
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


@pytest.fixture(scope="module")
def plan(messy):
    return propose_cleaning(messy)


def listed(plan):
    return [(a["action"], a["column"], a["method"], a["severity"], a["count"]) for a in plan.actions.orderBy("sequence").collect()]


def test_plan(plan):
    assert listed(plan) == [
        ("dropped_rows", None, None, "safe", 3),
        ("imputed", "price", "median", "safe", 3),
        ("imputed", "age", "median", "safe", 3),
        ("imputed", "grade", "mode", "review", 13),
        ("flagged_not_dropped", "mostly_missing", None, "review", 44),
        ("coerced_type", "price", "to_numeric", "safe", 57),
        ("standardized", "city", "canonicalize", "safe", 2),
        ("standardized", "state", "us_state_canonicalize", "safe", 2),
        ("flagged_not_dropped", "age", "iqr", "review", 1),
    ]


def test_plan_is_the_same_each_time(messy, plan):
    assert plan.actions.collect() == propose_cleaning(messy).actions.collect()
    ids = [r["action_id"] for r in plan.actions.collect()]
    assert len(set(ids)) == len(ids)


def test_focus_marks_one_column(messy):
    focused = propose_cleaning(messy, focus="age")
    assert {r["column"] for r in focused.actions.where("focused").collect()} == {"age"}
    result = apply_cleaning(messy, focused, "safe")
    assert result.data.where("age > 800").count() == 0
    with pytest.raises(ValueError):
        propose_cleaning(messy, focus="nothing")


def test_rejecting_everything_changes_nothing(messy, plan):
    result = apply_cleaning(messy, plan, "none")
    assert sorted(map(str, result.data.collect())) == sorted(map(str, messy.collect()))
    assert result.applied.count() == 0
    summary = result.summary().first()
    assert summary["quality_score_before"] == summary["quality_score_after"]


def test_safe_actions(messy, plan):
    result = apply_cleaning(messy, plan, "safe")
    data = result.data
    assert dict(data.dtypes)["price"] == "double"
    assert data.where("price IS NULL OR age IS NULL").count() == 0
    assert {r[0] for r in data.select("city").distinct().collect()} == {"Oslo", "Bergen"}
    assert {r[0] for r in data.select("state").distinct().collect()} == {"NY", "CA"}
    assert data.where("grade IS NULL").count() > 0 and data.where("age = 900").count() == 1
    statuses = {(r["action"], r["column"]): r["status"] for r in result.log.collect()}
    assert statuses["imputed", "grade"] == "rejected" and statuses["imputed", "age"] == "approved"
    assert result.applied.count() + result.rejected.count() == plan.actions.count()


def test_fills_come_from_the_table_without_copies(messy, plan):
    """The median is taken after duplicates are gone and separators parsed."""
    result = apply_cleaning(messy, plan, "safe")
    distinct = messy.distinct()
    number = F.expr("try_cast(replace(price, ',', '') AS double)")
    median = distinct.select(F.percentile(number, F.lit(0.5))).first()[0]
    missing = distinct.where("price IS NULL").count()
    assert missing and result.data.where(F.col("price") == median).count() >= missing


def test_all_actions(messy, plan):
    data = apply_cleaning(messy, plan, "all").data
    assert data.where("grade IS NULL OR mostly_missing IS NULL OR age > 800").count() == 0


def test_searched_statistics_give_the_same_table(messy):
    route = {"buckets": 3, "listed_values": 2}
    searched = apply_cleaning(messy, propose_cleaning(messy, **route), "all", **route)
    plain = apply_cleaning(messy, propose_cleaning(messy), "all")
    assert sorted(map(str, searched.data.collect())) == sorted(map(str, plain.data.collect()))


def test_actions_by_id(messy, plan):
    coerce = plan.actions.where("action = 'coerced_type'").first()["action_id"]
    result = apply_cleaning(messy, plan, [coerce])
    assert [r["action_id"] for r in result.applied.collect()] == [coerce]
    assert result.data.count() == 60
    with pytest.raises(ValueError):
        apply_cleaning(messy, plan, "everything")


def test_failing_actions_are_logged(messy, plan):
    result = apply_cleaning(messy.drop("age"), plan, "all")
    failed = result.rejected.collect()
    assert {r["column"] for r in failed} == {"age"}
    assert all("FAILED TO APPLY" in r["note"] for r in failed)
    assert result.data.where("grade IS NULL").count() == 0


def test_other_types_are_cleaned_too(spark):
    df = spark.range(60).select(
        "id",
        F.create_map(F.lit("k"), F.col("id") % 3).alias("m"),
        F.when(F.col("id") % 10 != 3, (F.col("id") / 7).cast("decimal(20,6)")).alias("dec"),
        F.when(F.col("id") % 12 != 1, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int"))).alias("day"),
        F.when(F.col("id") % 15 != 0, F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 11 != 0, F.array(F.col("id") % 2)).alias("list"),
    )
    df = df.unionByName(df.where("id < 4"))
    result = apply_cleaning(df, propose_cleaning(df), "all")
    assert result.data.count() == 60
    assert result.data.where("dec IS NULL OR day IS NULL OR flag IS NULL").count() == 0
    assert dict(result.data.dtypes)["day"] == "date" and dict(result.data.dtypes)["flag"] == "boolean"
    assert result.data.where("list IS NULL").count() == 0 and result.rejected.count() == 0


def test_execution_order():
    assert EXECUTION_ORDER.index("coerced_type") < EXECUTION_ORDER.index("imputed") < EXECUTION_ORDER.index("flagged_not_dropped")


def test_cleaning_twice_finds_nothing_safe_left(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    once = apply_cleaning(df, propose_cleaning(df), "all").data
    again = propose_cleaning(once)
    assert again.actions.where("severity = 'safe'").count() == 0


def test_boundaries_of_null_shares(spark):
    """15 % missing is still safe, 50 % is already sparse."""
    df = spark.range(100).select(
        "id",
        F.when(F.col("id") >= 15, F.col("id")).alias("safe"),
        F.when(F.col("id") >= 16, F.col("id")).alias("review"),
        F.when(F.col("id") >= 50, F.col("id")).alias("sparse"),
    )
    kinds = {a[1]: (a[0], a[3]) for a in listed(propose_cleaning(df)) if a[2] != "iqr"}
    assert kinds == {"safe": ("imputed", "safe"), "review": ("imputed", "review"), "sparse": ("flagged_not_dropped", "review")}


def test_shares_above_nine_tenths_count_as_numbers(spark):
    df = spark.range(100).select(
        F.when(F.col("id") < 90, F.col("id").cast("string")).otherwise("x").alias("exactly"),
        F.when(F.col("id") < 91, F.col("id").cast("string")).otherwise("x").alias("above"),
    )
    assert [a[1] for a in listed(propose_cleaning(df)) if a[0] == "coerced_type"] == ["above"]


def test_any_number_of_values_is_consolidated_unless_limited(spark):
    few = spark.range(200).select(F.when(F.col("id") % 100 == 0, "ID1").otherwise(F.concat(F.lit("id"), F.col("id") % 100)).alias("v"))
    many = spark.range(202).select(F.when(F.col("id") % 101 == 0, "ID1").otherwise(F.concat(F.lit("id"), F.col("id") % 101)).alias("v"))
    assert [a[0] for a in listed(propose_cleaning(few))] == ["dropped_rows", "standardized"]
    assert [a[0] for a in listed(propose_cleaning(many))] == ["dropped_rows", "standardized"]
    assert [a[0] for a in listed(propose_cleaning(many, variant_values=100))] == ["dropped_rows"]


cell = st.one_of(st.none(), st.sampled_from(["1", "2", "1,000", "a", "A", " a", "ny", "NY", "2024-01-05", ""]))
row = st.tuples(cell, cell, st.one_of(st.none(), st.integers(-5, 5)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, max_size=20))
def test_any_table(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, n int")
    before = sorted(map(str, df.collect()))
    plan = propose_cleaning(df)
    assert sorted(map(str, df.collect())) == before
    assert 0.0 <= plan.summary.first()["quality_score"] <= 1.0
    result = apply_cleaning(df, plan, "all")
    assert result.applied.count() + result.rejected.count() == plan.actions.count()
    assert result.data.count() <= len(rows)
    assert 0.0 <= quality_score(result.data).first()["quality_score"] <= 1.0


def test_staging_uses_the_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == named if named else folder == spark.sparkContext.getCheckpointDir()
    df = spark.createDataFrame([(1, "a"), (None, None)], "`n.x` int, t string")
    assert sorted(map(str, staged(df).collect())) == sorted(map(str, df.collect()))


def test_nested_and_binary_columns(spark):
    df = spark.createDataFrame(
        [(bytearray(b"\x01\x02"), [1]), (bytearray(b"\x01\x02"), [2]), (None, None), (bytearray(b"\x03"), [3])] * 3 + [(bytearray(b"\x04"), [4])] * 9,
        "b binary, a array<int>",
    ).withColumn("i", F.monotonically_increasing_id())
    plan = propose_cleaning(df)
    assert {(a["column"], a["action"], a["method"]) for a in plan.actions.collect()} == {("b", "imputed", "mode"), ("a", "imputed", "mode")}
    filled = apply_cleaning(df, plan, "all").data
    assert filled.where("b = X'04'").count() == 12 and filled.where("a = array(4)").count() == 12


def test_a_repeated_variant_multiplies_nothing(spark):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    lookup = spark.createDataFrame([("v", "x", "b"), ("v", "x", "a"), ("w", "y", "c")], "column string, variant string, canonical string")
    assert sorted(r[0] for r in replace_by_lookup(df, "v", lookup).collect()) == ["a", "y"]


def test_not_a_number_is_filled(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 3 else float(i)) for i in range(20)], "k long, v double")
    plan = propose_cleaning(df)
    assert [(a["column"], a["method"], a["count"]) for a in plan.actions.collect()] == [("v", "median", 1)]
    assert apply_cleaning(df, plan, "safe").data.where("v = 10.0").count() == 2


def test_audit_accounts_for_every_row_and_value(spark):
    rows = [(i, None if i % 10 == 3 else f"{i},000" if i % 2 else str(i), " Yes" if i % 5 == 0 else "Yes", "x") for i in range(40)]
    rows += [rows[4], rows[4], rows[7]]
    df = spark.createDataFrame(rows, "id long, amount string, flag string, changes string")
    plan = propose_cleaning(df)
    result = apply_cleaning(df, plan, "all", audit=True)
    assert result.changes.columns == [*result.data.columns, "changes_7"]
    assert result.changes.drop("changes_7").exceptAll(result.data).count() == 0
    found = {r.id: [tuple(c) for c in r.changes_7] for r in result.changes.select("id", "changes_7").collect()}
    assert found[1] == [("amount", "1,000", "1000.0", "coerced_type")]
    assert found[2] == [] and found[5][1] == ("flag", " Yes", "Yes", "standardized")
    assert [c[0::3] for c in found[3]] == [("amount", "imputed")] and found[3][0][1] is None
    copies = {r.row: r.copies for r in result.dropped.where("action = 'dropped_rows'").collect()}
    assert sorted(copies.values()) == [1, 2] and all('"changes":"x"' in row for row in copies)
    kept = result.data.count()
    assert kept + sum(r.copies for r in result.dropped.collect()) == df.count()


def test_audit_of_nothing_and_of_failures(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string").limit(0)
    result = apply_cleaning(df, propose_cleaning(df), "all", audit=True)
    assert result.changes.count() == 0 and result.dropped.count() == 0
    plain = apply_cleaning(df, propose_cleaning(df), "all")
    assert plain.changes is None and plain.dropped is None
