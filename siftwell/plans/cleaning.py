"""Propose cleaning actions, and apply the approved ones.

Proposing reads the data and returns a small table of actions; nothing is changed. Applying builds a
new lazy DataFrame from the approved actions in an order that respects their dependencies, and a
log with the outcome of every action.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache, cached_property, reduce
from itertools import chain

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import quoted
from siftwell.operators.columns import kind_of, nan_to_null, text_columns
from siftwell.operators.detectors import (
    ACTION_COLUMNS,
    detect_case_variants,
    detect_duplicates,
    detect_missing,
    detect_numeric_text,
    detect_outliers,
    detect_state_variants,
    has_case_variants,
    is_state_column,
)
from siftwell.operators.duplicates import drop_duplicate_rows, duplicate_count
from siftwell.operators.facts import scan_facts, text_facts
from siftwell.operators.local import collected, fixed, together
from siftwell.operators.outliers import iqr_fences, outlier_counts
from siftwell.operators.quality import quality_score, scored
from siftwell.operators.quantiles import Span
from siftwell.operators.transforms import (
    coerce_numbers,
    drop_missing,
    drop_outliers,
    impute_median,
    impute_mode,
    medians,
    most_frequent,
    outside_any,
    standardize_variants,
    standardize_states,
    variant_examples,
    variant_table,
)
from siftwell.plans.audit import dropped_copies, dropped_rows, no_rows, noted, shown, tracked, untracked
from siftwell.storage import release, staged

ACTION_SCHEMA = T.StructType(
    [T.StructField("sequence", T.IntegerType())]
    + [T.StructField(c, T.LongType() if c in ("count", "rows_affected") else T.StringType()) for c in ACTION_COLUMNS]
    + [T.StructField("focused", T.BooleanType())]
)

EXECUTION_ORDER = ("dropped_rows", "coerced_type", "imputed", "standardized", "flagged_not_dropped")


@dataclass(frozen=True)
class CleaningPlan:
    """Proposed actions in proposal order, and a one-row summary of the table as it is."""

    actions: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class CleaningResult:
    """The cleaned table, and every proposed action with its outcome."""

    data: DataFrame
    log: DataFrame
    before: DataFrame
    #: `data` with what was changed in each row, and the rows that were dropped; only of an audited application.
    changes: DataFrame | None = None
    dropped: DataFrame | None = None

    @property
    def applied(self) -> DataFrame:
        return self.log.where(F.col("status") == "approved")

    @property
    def rejected(self) -> DataFrame:
        return self.log.where(F.col("status") == "rejected")

    def summary(self) -> DataFrame:
        """(rows_before, rows_after, quality_score_before, quality_score_after), measured once."""
        return self._summary

    def release(self) -> None:
        """Remove the staged tables behind `data`, which cannot be read afterwards."""
        release(self.data)

    @cached_property
    def _summary(self) -> DataFrame:
        before = self.before.select(
            F.col("row_count").alias("rows_before"), F.col("quality_score").alias("quality_score_before")
        )
        after = quality_score(self.data).select(
            F.col("row_count").alias("rows_after"), F.col("quality_score").alias("quality_score_after")
        )
        names = ("rows_before", "rows_after", "quality_score_before", "quality_score_after")
        return collected(before.unionByName(after, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names]))


def _text_part(df: DataFrame) -> DataFrame:
    """Facts of the text columns; an empty table with the same columns if there are none."""
    names = text_columns(df)
    if names:
        return text_facts(df, names)
    return text_facts(df.select(F.lit("").alias("none")).limit(0), ["none"])


def measured(df: DataFrame) -> DataFrame:
    """Scan and text facts of every column: what the detectors read. One row per column."""
    return scan_facts(df).join(F.broadcast(_text_part(df)), "column", "left")


def with_examples(df: DataFrame, facts: DataFrame, most_values: int | None = None) -> DataFrame:
    """Add the replacements to be shown in the notes of standardising actions."""
    chosen = facts.select(
        "column",
        F.coalesce(is_state_column(), F.lit(False)).alias("state"),
        F.coalesce(has_case_variants(most_values), F.lit(False)).alias("variants"),
    ).collect()
    states = [r["column"] for r in chosen if r["state"]]
    variants = [r["column"] for r in chosen if r["variants"] and not r["state"]]
    if not states and not variants:
        return facts.withColumn("examples", F.lit(None).cast("string"))
    return facts.join(F.broadcast(collected(variant_examples(df, states, variants))), "column", "left")


Detector = Callable[[DataFrame], DataFrame]


def propose_cleaning(
    df: DataFrame,
    focus: str | None = None,
    variant_values: int | None = None,
    detectors: Iterable[Detector] = (),
    **search,
) -> CleaningPlan:
    """Inspect `df` and propose actions; `focus` marks every action on one column for approval.

    Spellings are consolidated in columns of any number of values, or of `variant_values` at most. Not-a-number is missing.
    `detectors` are asked besides the usual ones: each turns the facts, one row per column, into `proposals`.
    """
    if focus is not None and focus not in df.columns:
        raise ValueError(f"no column {focus!r} to focus on")
    df = nan_to_null(df)
    spark = df.sparkSession
    scanned = scan_facts(df)
    rows = scanned.collect()
    known = {
        r["column"]: Span(r["row_count"] - r["null_count"], r["min_number"], r["max_number"])
        for r in rows
        if r["min_number"] is not None
    }
    # Texts and duplicates in one query whose stages run side by side, next to the outlier search.
    read = _text_part(df).unionByName(duplicate_count(df), allowMissingColumns=True)
    read_rows, fences = together(
        spark, read.collect, lambda: collected(outlier_counts(df, iqr_fences(df, known=known, **search)))
    )
    texts = fixed(spark, read_rows, read.schema)
    duplicates = texts.where(F.col("column").isNull()).select("duplicate_rows")
    per_column = texts.where(F.col("column").isNotNull()).drop("duplicate_rows")
    facts = collected(fixed(spark, rows, scanned.schema).join(F.broadcast(per_column), "column", "left"))
    described = collected(with_examples(df, facts, variant_values))
    proposals = [
        detect_duplicates(duplicates),
        detect_missing(described),
        detect_numeric_text(described),
        detect_state_variants(described),
        detect_case_variants(described, variant_values),
        detect_outliers(fences),
        *[detect(described) for detect in detectors],
    ]
    # A few actions per column of the table at most; over fixed facts they are found without a job.
    proposed = sorted(chain.from_iterable(p.collect() for p in proposals), key=lambda r: (r["stage"], r["position"]))
    actions = [
        Row(i, *[r[c] for c in ACTION_COLUMNS], focus is not None and r["column"] == focus)
        for i, r in enumerate(proposed, 1)
    ]
    totals = facts.agg(
        F.max("row_count").alias("row_count"),
        F.sum("null_count").alias("null_cells"),
        F.avg(F.col("normalized_count") / F.col("distinct_count")).alias("consistency"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(duplicates.first()["duplicate_rows"]).alias("duplicate_rows"),
    )
    return CleaningPlan(fixed(spark, actions, ACTION_SCHEMA), collected(scored(totals)))


def approved_ids(plan: CleaningPlan, approved: str | Iterable[str]) -> set[str]:
    """Ids selected by "safe" (with every action on the focused column), "all", "none" or a list of ids."""
    actions = plan.actions
    if approved == "safe":
        actions = actions.where((F.col("severity") == "safe") | F.col("focused"))
    elif approved == "none":
        return set()
    elif approved != "all":
        if isinstance(approved, str):
            raise ValueError(f"approved must be 'safe', 'all', 'none' or a list of ids, not {approved!r}")
        return set(approved)
    return {r["action_id"] for r in actions.select("action_id").collect()}


def apply_cleaning(df: DataFrame, plan: CleaningPlan, approved: str | Iterable[str], audit: bool = False, **search) -> CleaningResult:
    """Apply the approved actions of a plan made for `df`.

    Statistics used as fills and fences are taken from the table as it stands at that step, not from
    the plan. Spellings are consolidated as found in `df` itself.

    With `audit` the result also has `changes`, the cleaned table with an array of (column, old, new, action) in each row,
    and `dropped`, every row that an action dropped, as JSON with the number of copies dropped.
    """
    df = nan_to_null(df)
    gone: list[DataFrame] = []
    actions = sorted(plan.actions.collect(), key=lambda a: a["sequence"])
    ids = approved_ids(plan, approved)
    chosen = [a for a in actions if a["action_id"] in ids]
    by_class = {name: [a for a in chosen if a["action"] == name] for name in EXECUTION_ORDER}
    failures: dict[str, str] = {a["action_id"]: "[action not executed]" for a in chosen}
    working = df

    def attempt(action: Row, step: Callable[[DataFrame], DataFrame], drops: Callable[[DataFrame], DataFrame] | None = None) -> None:
        nonlocal working
        column = action["column"]
        if column is not None and column not in working.columns:
            failures[action["action_id"]] = f"[FAILED TO APPLY: column {column!r} not found]"
            return
        try:
            after = noted(working, column, action["action"], step) if audit and not drops else step(working)
            after.schema  # noqa: B018 - forces analysis, so a step that cannot work fails here
            gone.extend([drops(working)] if audit and drops else [])
            working = after
            failures.pop(action["action_id"], None)
        except (PySparkException, ValueError, KeyError) as error:
            reason = str(error).splitlines()[0]
            failures[action["action_id"]] = f"[FAILED TO APPLY: {reason}]"

    for action in by_class["dropped_rows"]:
        row_count = plan.summary.first()["row_count"]
        attempt(action, lambda d: drop_duplicate_rows(d, row_count), lambda d, a=action: dropped_copies(d, a))
    if audit:
        working = tracked(working)
    for action in by_class["coerced_type"]:
        attempt(action, lambda d, c=action["column"]: coerce_numbers(d, [c]))

    needs_statistics = by_class["imputed"] or [a for a in by_class["flagged_not_dropped"] if a["method"] == "iqr"]
    if by_class["dropped_rows"] and needs_statistics:
        # Every statistic below is another pass; none of them should repeat the duplicate shuffle.
        working = staged(working)

    present = [a for a in by_class["imputed"] if a["column"] in working.columns]
    numeric = [a["column"] for a in present if a["method"] == "median" and _readable(working, a["column"])]
    other = [a["column"] for a in present if a["method"] != "median"]
    middle, common = medians(working, numeric, **search), most_frequent(working, other)
    for action in by_class["imputed"]:
        c = action["column"]
        if action["method"] == "median":
            attempt(action, lambda d, c=c: impute_median(d, {c: middle[c]}) if c in middle else coerce_numbers(d, [c]))
        else:
            attempt(action, lambda d, c=c: impute_mode(d, {c: common[c]} if c in common else {}))

    spelled = [a["column"] for a in by_class["standardized"] if a["method"] == "canonicalize" and a["column"] in df.columns]
    spelled = [c for c in spelled if kind_of(df.schema[c].dataType) == "text"]
    spellings = staged(variant_table(df, spelled)) if spelled else None
    for action in by_class["standardized"]:
        c = action["column"]
        if c in working.columns and kind_of(working.schema[c].dataType) != "text":
            attempt(action, lambda d: d)
        elif action["method"] == "us_state_canonicalize":
            attempt(action, lambda d, c=c: standardize_states(d, [c]))
        else:
            attempt(action, lambda d, c=c: standardize_variants(d, spellings, [c]) if c in spelled else d)

    for action in by_class["flagged_not_dropped"]:
        c = action["column"]
        if action["method"] == "iqr":
            fences = cache(lambda c=c: iqr_fences(working, [c], minimum=1, flat=True, **search))
            outside = lambda d, a=action, f=fences: dropped_rows(d, a, outside_any(d, f()))
            attempt(action, lambda d, f=fences: drop_outliers(d, f()), outside)
        else:
            attempt(action, lambda d, c=c: drop_missing(d, [c]), lambda d, c=c, a=action: dropped_rows(d, a, quoted(c).isNull()))

    log = [_outcome(a, a["action_id"] in ids, failures.get(a["action_id"])) for a in actions]
    outcome = fixed(df.sparkSession, log, ACTION_SCHEMA)
    if not audit:
        return CleaningResult(working, outcome, plan.summary)
    dropped = reduce(DataFrame.unionByName, gone, no_rows(df))
    return CleaningResult(untracked(working), outcome, plan.summary, shown(working), dropped)


def _readable(df: DataFrame, column: str) -> bool:
    return kind_of(df.schema[column].dataType) in ("text", "integer", "float", "boolean")


def _outcome(action: Row, chosen: bool, failure: str | None) -> Row:
    fields = action.asDict()
    fields["status"] = "approved" if chosen and failure is None else "rejected"
    if chosen and failure is not None:
        fields["note"] = f"{fields['note'] or ''} {failure}".strip()
    return Row(*[fields[f.name] for f in ACTION_SCHEMA])
