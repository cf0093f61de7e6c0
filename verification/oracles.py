"""The same results in DuckDB's SQL, keyed like the queries."""

from itertools import combinations, product

from siftwell.functions.states import STATE_CODES
from verification.dirty import DIRTY_SQL
from verification.queries import LINEITEM_PAIRS

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DIRTY_COLUMNS = [
    ("o_orderkey", "integer"), ("order_date", "text"), ("priority", "text"), ("state", "text"), ("revenue", "text"),
    ("amount", "float"), ("status", "text"), ("segment", "text"), ("sparse_id", "integer"),
]
DOCUMENT_COLUMNS = [
    ("doc_id", "integer"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "integer"),
]
LINEITEM_COLUMNS = [
    ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
    ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "date"),
]
SPACE = r"'^\s+|\s+$', '', 'g'"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN try_cast({c} AS DOUBLE) END"


def lenient(c: str) -> str:
    return number(f"replace({c}, ',', '')")


def moment(c: str) -> str:
    return f"coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y'))"


def norm(c: str) -> str:
    return f"lower(regexp_replace({c}, {SPACE}))"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


STATES = "states AS (SELECT * FROM (VALUES {}) AS s(norm, code))".format(
    ", ".join(
        [f"('{name}', '{code}')" for name, code in STATE_CODES.items()]
        + [f"('{code.lower()}', '{code}')" for code in STATE_CODES.values()]
    )
)
DIRTY = f"dirty AS ({DIRTY_SQL})"


def cells(source: str, columns) -> str:
    """Every cell as (position, column, kind, text)."""
    return union(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS kind, CAST({c} AS VARCHAR) AS v FROM {source}"
        for i, (c, kind) in enumerate(columns)
    )


def facts(source: str, columns) -> str:
    """Per-column measurements as CTEs ending in `facts`."""
    return f"""
cells AS ({cells(source, columns)}),
grouped AS (
  SELECT position, "column", kind, v, count(*) AS n FROM cells GROUP BY ALL),
parsed AS (
  SELECT g.*, {norm('v')} AS norm, {number('v')} AS num, {lenient('v')} AS len, {moment('v')} AS ts, s.code
  FROM grouped g LEFT JOIN states s ON g.kind = 'text' AND s.norm = {norm('g.v')}),
topped AS (
  SELECT *, max(n) OVER (PARTITION BY "column", norm) AS top,
         row_number() OVER (PARTITION BY "column", norm ORDER BY n DESC, v) AS place FROM parsed),
facts AS (
  SELECT position, "column", kind,
    sum(n)::BIGINT AS row_count,
    coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS null_count,
    coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS non_null,
    count(v) AS distinct_count,
    count(DISTINCT CASE WHEN v IS NOT NULL THEN norm END) AS normalized_count,
    coalesce(sum(n) FILTER (num IS NOT NULL), 0) AS numeric_count,
    coalesce(sum(n) FILTER (len IS NOT NULL), 0) AS lenient_count,
    coalesce(sum(n) FILTER (ts IS NOT NULL), 0) AS date_count,
    coalesce(sum(n) FILTER (code IS NOT NULL), 0) AS state_count,
    count(*) FILTER (code IS NOT NULL AND v <> code) AS state_variants,
    coalesce(sum(n) FILTER (code IS NOT NULL AND v <> code), 0)::BIGINT AS state_variant_rows,
    coalesce(sum(n) FILTER (v IS NOT NULL AND place > 1), 0)::BIGINT AS variant_rows,
    bool_or(coalesce(num % 1 <> 0, false)) AS has_fraction,
    min(num) AS low_number, max(num) AS high_number, min(ts) AS low_moment, max(ts) AS high_moment,
    sum(n * length(v)) / nullif(sum(n) FILTER (v IS NOT NULL), 0) AS mean_length
  FROM topped GROUP BY position, "column", kind)"""


INFERRED = """CASE
  WHEN non_null = 0 THEN 'unknown'
  WHEN kind IN ('boolean', 'integer', 'float', 'date') THEN kind
  WHEN numeric_count / non_null > 0.9 THEN CASE WHEN has_fraction THEN 'float' ELSE 'integer' END
  WHEN date_count / non_null > 0.9 THEN 'date'
  WHEN distinct_count <= 1 THEN 'constant'
  WHEN distinct_count / non_null > 0.95 THEN CASE WHEN mean_length <= 24 THEN 'identifier' ELSE 'text' END
  WHEN distinct_count / non_null < 0.5 OR distinct_count <= 50 THEN 'categorical'
  ELSE 'text' END"""

DIRTY_FACTS = f"WITH {DIRTY}, {STATES}, {facts('dirty', DIRTY_COLUMNS)}"
DOCUMENT_FACTS = f"WITH {STATES}, {facts('documents', DOCUMENT_COLUMNS)}"

SHARE = "(null_count / greatest(row_count, 1))"
NUMERIC = "(kind IN ('integer', 'float') OR coalesce(lenient_count / nullif(non_null, 0) > 0.9, false))"
PERCENT = f"CAST(round({SHARE} * 100, 1) AS VARCHAR)"
IS_STATE = "(kind = 'text' AND coalesce(state_count / nullif(non_null, 0) >= 0.8, false) AND state_variants > 0)"

DETECT = {
    "duplicates": """SELECT 1 AS stage, -1 AS position, 'dropped_rows' AS action, CAST(NULL AS VARCHAR) AS "column",
      'exact duplicate records' AS reason, c AS count, CAST(NULL AS VARCHAR) AS method, 'safe' AS severity, c AS rows_affected
      FROM (SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS c) WHERE c > 0""",
    "missing": f"""SELECT 2 AS stage, position,
      CASE WHEN {SHARE} >= 0.5 THEN 'flagged_not_dropped' ELSE 'imputed' END AS action, "column",
      {PERCENT} || CASE WHEN {SHARE} >= 0.5 THEN '% missing — too sparse to safely impute'
        WHEN {NUMERIC} THEN '% missing numeric values' ELSE '% missing categorical/text values' END AS reason,
      null_count AS count,
      CASE WHEN {SHARE} >= 0.5 THEN NULL WHEN {NUMERIC} THEN 'median' ELSE 'mode' END AS method,
      CASE WHEN {SHARE} <= 0.15 THEN 'safe' ELSE 'review' END AS severity, null_count AS rows_affected
      FROM facts WHERE null_count > 0""",
    "numeric_text": """SELECT 3 AS stage, position, 'coerced_type' AS action, "column", 'numeric values stored as text' AS reason,
      non_null AS count, 'to_numeric' AS method, 'safe' AS severity, non_null AS rows_affected
      FROM facts WHERE kind = 'text' AND lenient_count / nullif(non_null, 0) > 0.9""",
    "states": f"""SELECT 4 AS stage, position, 'standardized' AS action, "column",
      'US state names/abbreviations recognized as variants of the same value' AS reason,
      state_variants AS count, 'us_state_canonicalize' AS method, 'safe' AS severity, state_variant_rows AS rows_affected
      FROM facts WHERE {IS_STATE}""",
    "variants": f"""SELECT 4 AS stage, position, 'standardized' AS action, "column", 'case/whitespace variants of the same value' AS reason,
      distinct_count - normalized_count AS count, 'canonicalize' AS method, 'safe' AS severity, variant_rows AS rows_affected
      FROM facts WHERE kind = 'text' AND distinct_count <= 100 AND normalized_count < distinct_count AND NOT {IS_STATE}""",
}


def outlier_ctes(source: str, columns) -> str:
    quartiles = union(
        f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS n, quantile_cont({c}::DOUBLE, 0.25) AS q1, "
        f"quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}"
        for i, c in columns
    )
    counts = union(
        f"SELECT f.position, f.\"column\", f.lo, f.hi, (SELECT count(*) FROM {source} WHERE {c} < f.lo OR {c} > f.hi) AS c "
        f"FROM fences f WHERE f.\"column\" = '{c}'"
        for _, c in columns
    )
    return f"""quartiles AS ({quartiles}),
fences AS (SELECT position, "column", q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM quartiles WHERE n >= 8 AND q3 <> q1),
outside AS ({counts})"""


def short(c: str) -> str:
    return f"regexp_replace(printf('%.2f', {c}), '(\\.\\d+?)0*$', '\\1')"


OUTLIERS = f"""SELECT 5 AS stage, position, 'flagged_not_dropped' AS action, "column",
  c || ' value(s) outside IQR bounds [' || {short('lo')} || ', ' || {short('hi')} || ']' AS reason,
  c AS count, 'iqr' AS method, 'review' AS severity, c AS rows_affected FROM outside WHERE c > 0"""

DIRTY_NUMERIC = [(0, "o_orderkey"), (5, "amount"), (8, "sparse_id")]
PLAN = f"""{DIRTY_FACTS}, {outlier_ctes('dirty', DIRTY_NUMERIC)},
proposals AS ({union([*DETECT.values(), OUTLIERS])}),
plan AS (SELECT CAST(row_number() OVER (ORDER BY stage, position) AS INTEGER) AS sequence, * FROM proposals)"""
ACTION = 'action, "column", reason, count, method, severity, rows_affected'


def examples(pairs: str, tail: str = "") -> str:
    """Note listing the three lowest replacements."""
    return (
        "(SELECT 'e.g. consolidating [' || string_agg('(''' || variant || ''', ''' || canonical || ''')', ', ' ORDER BY variant) "
        f"|| ']{tail}' FROM (SELECT * FROM ({pairs}) WHERE variant <> canonical ORDER BY variant LIMIT 3))"
    )


def variants_of(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", v AS variant,
      first_value(v) OVER (PARTITION BY norm ORDER BY n DESC, v) AS canonical, n, count(*) OVER (PARTITION BY norm) AS spellings
      FROM (SELECT {c} AS v, {norm(c)} AS norm, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY ALL)"""


STATE_PAIRS = f"SELECT DISTINCT d.state AS variant, s.code AS canonical FROM dirty d JOIN states s ON s.norm = {norm('d.state')}"

CLEANED = f"""{DIRTY}, {STATES},
dedup AS (SELECT DISTINCT * FROM dirty),
spelled AS ({variants_of('dirty', 'priority')}),
fills AS (SELECT
  (SELECT quantile_cont({lenient('revenue')}, 0.5) FROM dedup) AS revenue,
  (SELECT quantile_cont(amount, 0.5) FROM dedup) AS amount,
  (SELECT status FROM dedup WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1) AS status,
  (SELECT segment FROM dedup WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) AS segment),
safe AS (SELECT d.o_orderkey, d.order_date, coalesce(v.canonical, d.priority) AS priority, coalesce(s.code, d.state) AS state,
    coalesce({lenient('d.revenue')}, f.revenue) AS revenue, coalesce(d.amount, f.amount) AS amount,
    coalesce(d.status, f.status) AS status, d.segment, d.sparse_id
  FROM dedup d CROSS JOIN fills f LEFT JOIN spelled v ON v.variant = d.priority LEFT JOIN states s ON s.norm = {norm('d.state')}),
filled AS (SELECT * REPLACE (coalesce(segment, (SELECT segment FROM fills)) AS segment) FROM safe WHERE sparse_id IS NOT NULL),
reach AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM filled),
every AS (SELECT filled.* FROM filled, reach
  WHERE NOT coalesce(amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1), false))"""

CLEANED_DATA = "SELECT * REPLACE (round(revenue, 6) AS revenue, round(amount, 6) AS amount) FROM {}"


def score(source: str, columns, name: str = "score") -> str:
    """CTE with the quality parts of a table."""
    nulls = " + ".join(f"sum(({c} IS NULL)::INT)" for c, _ in columns)
    spelling = union(
        f"SELECT count(DISTINCT {norm(c)}) / nullif(count(DISTINCT {c}), 0) AS r FROM {source}"
        for c, kind in columns
        if kind == "text"
    )
    return f"""{name} AS (
  SELECT *, round(0.5 * completeness + 0.3 * uniqueness + 0.2 * consistency, 4) AS quality_score FROM (
    SELECT count(*) AS row_count, {len(columns)} AS column_count,
      1 - ({nulls}) / (count(*) * {len(columns)}) AS completeness,
      1 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))) / count(*) AS uniqueness,
      (SELECT avg(r) FROM ({spelling})) AS consistency
    FROM {source}))"""


def score_query(ctes: str, source: str, columns) -> str:
    return f"""WITH {ctes}{score(source, columns)}
SELECT row_count, column_count, round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness,
  round(consistency, 6) AS consistency, quality_score FROM score"""


def extremes(columns, source_facts: str, typed: str) -> str:
    shown = """CASE kind WHEN 'text' THEN CASE inferred
        WHEN 'integer' THEN CAST(CAST({n} AS HUGEINT) AS VARCHAR) WHEN 'float' THEN CAST({n} AS VARCHAR)
        WHEN 'date' THEN CAST({m} AS VARCHAR) END ELSE {t} END"""
    low = shown.format(n="low_number", m="low_moment", t="lo")
    high = shown.format(n="high_number", m="high_moment", t="hi")
    return f"""{source_facts}, typed AS ({typed}),
inferred AS (SELECT *, {INFERRED} AS inferred FROM facts)
SELECT i.position, i."column", {low} AS min_value, {high} AS max_value FROM inferred i LEFT JOIN typed t ON t."column" = i."column" """


def typed_extremes(source: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", CAST(min({c}){' + 0' * (kind == 'float')} AS VARCHAR) AS lo, CAST(max({c}) AS VARCHAR) AS hi FROM {source}"
        for c, kind in columns
        if kind != "text"
    )


def described(source: str, columns, ctes: str = "") -> str:
    rows = union(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"round(min({c})::DOUBLE, 4) + 0 AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, "
        f"round(max({c})::DOUBLE, 4) AS max FROM {source}"
        for c in columns
    )
    return ctes + rows


# --- tests -------------------------------------------------------------------------------------


def trends(source: str, date: str, measures, offset: int = 0) -> str:
    return union(
        f"""SELECT {offset + i} AS sequence, 'trend' AS kind, '{{date_name}}' AS x, '{y}' AS y,
      count(*) AS n, corr(y, d) AS r, regr_slope(y, d) AS slope, regr_intercept(y, d) AS intercept,
      arg_min(y, (t, y)) AS first, arg_max(y, (t, y)) AS last
      FROM (SELECT {y}::DOUBLE AS y, {date} AS t, date_sub('day', min({date}) OVER (), {date})::DOUBLE AS d
            FROM {source} WHERE {y} IS NOT NULL AND {date} IS NOT NULL)"""
        for i, y in enumerate(measures)
    )


def pairs_sql(source: str, pairs, offset: int = 0) -> str:
    return union(
        f"""SELECT {offset + i} AS sequence, 'pair' AS kind, '{x}' AS x, '{y}' AS y,
      regr_count({y}, {x})::BIGINT AS n, corr({y}, {x}) AS r, regr_slope({y}, {x}) AS slope,
      regr_intercept({y}, {x}) AS intercept, CAST(NULL AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS last FROM {source}"""
        for i, (x, y) in enumerate(pairs)
    )


def moments(source: str, categories, measures) -> str:
    return union(
        f"""SELECT {1000 + i} AS sequence, '{g}' AS category, '{m}' AS measure, {g} AS level,
      count({m}) AS n, avg({m}) AS mean, var_samp({m}) AS variance
      FROM {source} WHERE {g} IS NOT NULL GROUP BY {g} HAVING count({m}) > 0"""
        for i, (g, m) in enumerate(product(categories, measures))
    )


COMPARED = """compared AS (
  SELECT sequence, category, measure, groups, n,
    CASE WHEN groups = 2 THEN 't-test' ELSE 'one-way ANOVA' END AS test,
    CASE WHEN groups = 2 THEN (m1 - m2) / sqrt(error) ELSE (ssb / (groups - 1)) / (ssw / (n - groups)) END AS stat,
    CASE WHEN groups = 2 THEN error * error / spread ELSE groups - 1 END AS df1,
    CASE WHEN groups > 2 THEN (n - groups)::DOUBLE END AS df2, highest, lowest
  FROM (
    SELECT sequence, category, measure, count(*) FILTER (n >= 3) AS groups, (sum(n) FILTER (n >= 3))::BIGINT AS n,
      sum(n * (mean - grand) ** 2) FILTER (n >= 3) AS ssb, sum((n - 1) * variance) FILTER (n >= 3) AS ssw,
      sum(variance / n) FILTER (n >= 3) AS error, sum((variance / n) ** 2 / (n - 1)) FILTER (n >= 3) AS spread,
      arg_min(mean, level) FILTER (n >= 3) AS m1, arg_max(mean, level) FILTER (n >= 3) AS m2,
      arg_max(level, (mean, level)) AS highest, arg_min(level, (mean, level)) AS lowest
    FROM (SELECT *, sum(CASE WHEN n >= 3 THEN n * mean END) OVER w / sum(CASE WHEN n >= 3 THEN n END) OVER w AS grand
          FROM moments WINDOW w AS (PARTITION BY sequence))
    GROUP BY sequence, category, measure) WHERE groups >= 2)"""

# Tail of t (as F with one numerator degree of freedom) and F by Simpson's rule over the angle whose
# squared sine is the beta variable. The upper limit stops where the integrand has vanished.
P_VALUES = """angles AS (
  SELECT *, least(asin(sqrt(a * f / (b + a * f))), CASE WHEN b > 400 THEN sqrt((150 + 4 * a) / b) ELSE 2 END) AS theta,
    ln(2) - lgamma(a / 2) - lgamma(b / 2) + lgamma((a + b) / 2) AS scale
  FROM (SELECT *, CASE WHEN statistic = 't' THEN 1.0 ELSE df1 END AS a, CASE WHEN statistic = 't' THEN df1 ELSE df2 END AS b,
          CASE WHEN statistic = 't' THEN stat * stat ELSE stat END AS f FROM tests)),
areas AS (
  SELECT sequence, sum(weight * CASE WHEN a = 1 THEN exp(scale + (b - 1) * ln(cos(phi)))
      WHEN phi = 0 THEN 0 ELSE exp(scale + (a - 1) * ln(sin(phi)) + (b - 1) * ln(cos(phi))) END) * any_value(theta) / 12000 AS area
  FROM (SELECT sequence, a, b, scale, theta, theta * k / 4000 AS phi,
          CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight
        FROM angles, generate_series(0, 4000) AS g(k)) GROUP BY sequence),
valued AS (SELECT t.*, greatest(0.0, 1 - area) AS p FROM tests t JOIN areas USING (sequence))"""


def tests(source: str, date: str | None, date_name: str | None, numbers, categories, capped: bool = True) -> str:
    max_trends, max_pairs, max_measures = (6, 15, 5) if capped else (None, None, None)
    pairs = list(combinations(numbers, 2))[:max_pairs]
    linear = []
    if date:
        linear.append(trends(source, date, numbers[:max_trends]).replace("{date_name}", date_name))
    if pairs:
        linear.append(pairs_sql(source, pairs, len(numbers[:max_trends]) if date else 0))
    grouped = moments(source, categories, numbers[:max_measures]) if categories else None
    parts = [
        """SELECT sequence, kind, x, y, n, 't' AS statistic, r * sqrt((n - 2) / (1 - r * r)) AS stat, (n - 2)::DOUBLE AS df1,
        CAST(NULL AS DOUBLE) AS df2, r, slope, first, last, CAST(NULL AS BIGINT) AS groups,
        CAST(NULL AS VARCHAR) AS highest, CAST(NULL AS VARCHAR) AS lowest FROM linear
        WHERE n >= CASE WHEN kind = 'trend' THEN 6 ELSE 8 END AND r IS NOT NULL"""
    ]
    ctes = f"linear AS ({union(linear)})"
    if grouped:
        ctes += f", moments AS ({grouped}), {COMPARED}"
        parts.append(
            """SELECT sequence, 'group', category, measure, n, CASE WHEN groups = 2 THEN 't' ELSE 'f' END, stat, df1, df2,
            CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), groups, highest, lowest
            FROM compared"""
        )
    return f"{ctes}, tests AS ({union(parts)}), {P_VALUES}"


RELATED = "(p < 0.05 AND abs(r) >= 0.3)"
CHANGE = "round((last - first) / abs(nullif(first, 0)) * 100, 1)"


def findings(duplicates: str = "0", touched: str = "[]", limit: int | None = 6) -> str:
    """CTE `findings` from `valued`: texts, confidence and rank."""
    return f"""described AS (
  SELECT *,
    CASE kind
      WHEN 'trend' THEN y || ' has ' || CASE WHEN slope > 0 THEN 'increased' ELSE 'decreased' END || ' over time'
        || coalesce(' (' || printf('%+.1f', {CHANGE}) || '% over the observed period)', '') || ', tracked by ' || x || '.'
      WHEN 'group' THEN y || ' differs significantly across ' || x || ' groups — ''' || highest || ''' averages highest, ''' || lowest || ''' lowest.'
      ELSE CASE WHEN {RELATED} THEN x || ' and ' || y || ' show a ' || CASE WHEN abs(r) >= 0.6 THEN 'strong' ELSE 'moderate' END
        || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END || ' correlation.'
        ELSE x || ' shows no significant correlation with ' || y || '.' END
    END AS summary,
    CASE kind WHEN 'trend' THEN printf('linear trend: r=%.2f, p=%.4f, n=%d', r, p, n)
      WHEN 'pair' THEN printf('pearson r=%.2f, p=%.4f, n=%d', r, p, n)
      ELSE printf('%s: stat=%.2f, p=%.4f, groups=%d', CASE WHEN statistic = 't' THEN 't-test' ELSE 'one-way ANOVA' END, stat, p, groups)
    END AS statistical_support,
    CASE kind WHEN 'trend' THEN 'line' WHEN 'group' THEN 'grouped_bar'
      ELSE CASE WHEN {RELATED} THEN 'scatter_with_trendline' ELSE 'none' END END AS recommended_chart,
    CASE WHEN CASE WHEN kind <> 'pair' THEN p < 0.01 WHEN {RELATED} THEN p < 0.01 AND abs(r) >= 0.5 ELSE p >= 0.2 END
      THEN 'high' ELSE 'medium' END AS confidence,
    x || '|' || y AS related_columns, round(r, 4) + 0 AS effect_size, round(p, 6) AS p_value,
    {duplicates} AS duplicates, list_sort(list_intersect([x, y], {touched})) AS touched
  FROM valued WHERE CASE kind WHEN 'trend' THEN p < 0.05 AND abs(r) >= 0.2 WHEN 'group' THEN p < 0.05 ELSE true END),
noted AS (SELECT *, nullif(concat_ws('; ',
    CASE WHEN duplicates > 0 THEN 'analysis excludes ' || duplicates || ' row(s) removed as duplicates during cleaning' END,
    CASE WHEN len(touched) > 0 THEN 'column(s) [''' || array_to_string(touched, ''', ''') || '''] were modified during cleaning (imputed/standardized) — worth confirming that didn''t bias this result' END
  ), '') AS caveat FROM described),
findings AS (SELECT CAST(row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 1 ELSE 2 END, p_value, sequence) AS INTEGER) AS rank,
    summary, statistical_support, recommended_chart, confidence, related_columns, effect_size, p_value, caveat FROM noted
  {f"QUALIFY rank <= {limit}" if limit else ""})"""


EVENT_NUMBERS = ["event_id", "user_id", "value"]
EVENT_TESTS = tests("events", "ts", "ts", EVENT_NUMBERS, ["event_type"])
EVENT_FINDINGS = f"WITH {EVENT_TESTS}, {findings()}"
LINEITEM_NUMBERS = [c for c, kind in LINEITEM_COLUMNS if kind in ("integer", "float")]
LINEITEM_FINDINGS = f"WITH {tests('lineitem', 'l_shipdate', 'l_shipdate', LINEITEM_NUMBERS, ['l_returnflag', 'l_linestatus'])}, {findings()}"
EVENT_TESTS_ALL = tests("events", "ts", "ts", EVENT_NUMBERS, ["event_type"], capped=False)
LINEITEM_TESTS_ALL = tests("lineitem", "l_shipdate", "l_shipdate", LINEITEM_NUMBERS, ["l_returnflag", "l_linestatus"], capped=False)
LINEITEM_TESTS_LISTED = [
    *[("trend", "l_shipdate", y) for y in LINEITEM_NUMBERS[6:]],
    *[("pair", x, y) for x, y in list(combinations(LINEITEM_NUMBERS, 2))[15:]],
    *[("group", x, y) for x in ("l_returnflag", "l_linestatus") for y in LINEITEM_NUMBERS[5:]],
]
WIDE_BASES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
WIDE_COLUMNS = 208


def wide(name: int) -> str:
    """A derived column with gaps: one of four measures plus a share of another, for rows its number does not leave out."""
    a, b = WIDE_BASES[name % 4], WIDE_BASES[(name // 4) % 4]
    return f"CASE WHEN (l_orderkey + l_linenumber * 3) % {name + 5} > 1 THEN {a} + {b} * {name % 7} END"


SAFE_NUMBERS = ["o_orderkey", "revenue", "amount", "sparse_id"]
SAFE_TOUCHED = "['revenue', 'amount', 'status', 'priority', 'state']"
SAFE_DUPLICATES = "((SELECT count(*) FROM dirty) - (SELECT count(*) FROM dedup))"
SAFE_TESTS = tests("safe", moment("order_date"), "order_date", SAFE_NUMBERS, ["priority", "state", "status", "segment"])
SAFE_FINDINGS = f"WITH {CLEANED}, {SAFE_TESTS}, {findings(SAFE_DUPLICATES, SAFE_TOUCHED)}"

ROUTED = """routed AS (SELECT f.*, CASE recommended_chart WHEN 'none' THEN NULL ELSE (SELECT count(*) FROM events) END AS n FROM findings f)"""
NO_CHART = "No correlation/effect found — best represented as a stated conclusion rather than a chart with no visible pattern."

SUMMARY = f"""{CLEANED}, {score('dirty', DIRTY_COLUMNS, 'before')},
{score('safe', [(c, 'float' if c == 'revenue' else k) for c, k in DIRTY_COLUMNS], 'after')},
summary AS (SELECT b.row_count AS rows_before, a.row_count AS rows_after,
  b.quality_score AS quality_score_before, a.quality_score AS quality_score_after FROM before b, after a)"""


def scalar_query(expression: str, name: str) -> str:
    return f"WITH {DIRTY} SELECT o_orderkey, {expression} AS {name} FROM dirty"


def samples(source: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS sample_values "
        f"FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL ORDER BY v LIMIT 4)"
        for c, _ in columns
    )


def null_rows(columns, source: str = "dirty") -> str:
    return union(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) / count(*), 4) AS null_pct FROM {source}"
        for i, (c, _) in enumerate(columns)
    )


def kind_rows(columns, source: str = "dirty") -> str:
    def extreme(c: str, kind: str, which: str) -> str:
        return f"{which}({c})::DOUBLE" if kind in ("integer", "float") else "CAST(NULL AS DOUBLE)"

    return union(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"{extreme(c, kind, 'min')} AS min_number, {extreme(c, kind, 'max')} AS max_number FROM {source}"
        for i, (c, kind) in enumerate(columns)
    )


def distinct_rows(source: str, columns) -> str:
    return union(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM {source}"
        for i, (c, _) in enumerate(columns)
    )


def mode_rows(columns) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", (SELECT CAST({c} AS VARCHAR) FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS value"
        for c in columns
    )


def fenced(extra: str) -> str:
    return f"""WITH {DIRTY}, q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM dirty)
SELECT o_orderkey, amount FROM dirty, q WHERE {extra}"""


LINE_TREND = trends("events", "ts", EVENT_NUMBERS).replace("{date_name}", "ts")
DIRTY_TREND = trends("dirty", moment("order_date"), ["o_orderkey", "amount"]).replace("{date_name}", "order_date")
TREND_COLUMNS = "y, n, round(r, 6) + 0 AS r, round(slope, 6) + 0 AS slope, round(first, 6) + 0 AS first, round(last, 6) + 0 AS last"

ORACLES: dict[str, str] = {
    "profile_nulls": f"WITH {DIRTY} {null_rows(DIRTY_COLUMNS)}",
    "column_kinds": f"WITH {DIRTY} {kind_rows(DIRTY_COLUMNS)}",
    "profile_distinct": distinct_rows("lineitem", LINEITEM_COLUMNS),
    "profile_distinct_documents": distinct_rows("documents", DOCUMENT_COLUMNS),
    "profile_minmax": extremes(LINEITEM_COLUMNS, f"WITH {STATES}, {facts('lineitem', LINEITEM_COLUMNS)}", typed_extremes("lineitem", LINEITEM_COLUMNS)),
    "profile_minmax_text": extremes(DIRTY_COLUMNS, DIRTY_FACTS, typed_extremes("dirty", DIRTY_COLUMNS)),
    "infer_types": f'{DIRTY_FACTS} SELECT position, "column", {INFERRED} AS inferred_type FROM facts',
    "infer_types_documents": f'{DOCUMENT_FACTS} SELECT position, "column", {INFERRED} AS inferred_type FROM facts',
    "sample_values": f"WITH {DIRTY} {samples('dirty', DIRTY_COLUMNS)}",
    "empty_columns": f"WITH {DIRTY} SELECT 9 AS position, 'blank' AS \"column\", count(*) AS row_count, count(*) AS null_count, 1.0::DOUBLE AS null_pct FROM dirty",
    "value_frequencies": f"WITH {DIRTY} SELECT priority AS value, count(*) AS n FROM dirty WHERE priority IS NOT NULL GROUP BY priority",
    "duplicate_count": f"WITH {DIRTY} SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows",
    "dedupe_by_fingerprint": f"WITH {DIRTY} SELECT DISTINCT * FROM dirty",
    "dedupe": f"WITH {DIRTY} SELECT DISTINCT * FROM dirty",
    "quality_score": score_query(f"{DIRTY}, ", "dirty", DIRTY_COLUMNS),
    "quality_score_documents": score_query("", "documents", DOCUMENT_COLUMNS),
    "to_numeric_strict": scalar_query(number("revenue"), "revenue"),
    "to_numeric_safe": scalar_query(lenient("revenue"), "revenue"),
    "parse_dates": scalar_query(moment("order_date"), "order_date"),
    "normalized_text": f"WITH {DIRTY} SELECT o_orderkey, {norm('priority')} AS priority, {norm('state')} AS state FROM dirty",
    "state_codes": f"WITH {DIRTY}, {STATES} SELECT o_orderkey, s.code AS state FROM dirty d LEFT JOIN states s ON s.norm = {norm('d.state')}",
    "days_since_first": "SELECT event_id, date_sub('day', (SELECT min(ts) FROM events), ts) AS days FROM events",
    "detect_duplicates": f"WITH {DIRTY} SELECT {ACTION} FROM ({DETECT['duplicates']})",
    "detect_missing": f"{DIRTY_FACTS} SELECT {ACTION} FROM ({DETECT['missing']})",
    "detect_numeric_text": f"{DIRTY_FACTS} SELECT {ACTION} FROM ({DETECT['numeric_text']})",
    "detect_us_states": f"{DIRTY_FACTS} SELECT {ACTION}, {examples(STATE_PAIRS, ' into 2-letter codes')} AS note FROM ({DETECT['states']})",
    "detect_case_variants": f"{DIRTY_FACTS} SELECT {ACTION}, {examples(variants_of('dirty', 'priority'))} AS note FROM ({DETECT['variants']})",
    "detect_outliers_iqr": f"WITH {DIRTY}, {outlier_ctes('dirty', DIRTY_NUMERIC)} SELECT {ACTION} FROM ({OUTLIERS})",
    "detect_outliers_events": f"WITH {outlier_ctes('events', [(0, 'event_id'), (2, 'user_id'), (4, 'value')])} SELECT {ACTION} FROM ({OUTLIERS})",
    "cleaning_plan": f"{PLAN} SELECT sequence, {ACTION} FROM plan",
    "plan_summary": score_query(f"{DIRTY}, ", "dirty", DIRTY_COLUMNS),
    "focused_replan": f"{PLAN} SELECT sequence, action, \"column\", severity, coalesce(\"column\" = 'amount', false) AS focused FROM plan",
    "coerce_numeric": f"WITH {DIRTY} SELECT * REPLACE ({lenient('revenue')} AS revenue) FROM dirty",
    "impute_median": f"""WITH {DIRTY} SELECT o_orderkey,
      round(coalesce({lenient('revenue')}, (SELECT quantile_cont({lenient('revenue')}, 0.5) FROM dirty)), 6) AS revenue,
      round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty)), 6) AS amount FROM dirty""",
    "impute_mode": f"""WITH {DIRTY} SELECT o_orderkey,
      coalesce(status, (SELECT status FROM dirty WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status,
      coalesce(segment, (SELECT segment FROM dirty WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
      FROM dirty""",
    "column_modes": mode_rows(["l_returnflag", "l_quantity", "l_suppkey"]),
    "standardize_states": f"WITH {DIRTY}, {STATES} SELECT o_orderkey, coalesce(s.code, d.state) AS state FROM dirty d LEFT JOIN states s ON s.norm = {norm('d.state')}",
    "variant_groups": f"WITH {DIRTY} SELECT \"column\", variant, canonical, n FROM ({union([variants_of('dirty', 'priority'), variants_of('dirty', 'state')])}) WHERE spellings > 1",
    "drop_outliers": fenced("NOT coalesce(amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1), false)"),
    "drop_sparse_nulls": f"WITH {DIRTY} SELECT o_orderkey, sparse_id FROM dirty WHERE sparse_id IS NOT NULL",
    "apply_safe_plan": f"WITH {CLEANED} {CLEANED_DATA.format('safe')}",
    "apply_full_plan": f"WITH {CLEANED} {CLEANED_DATA.format('every')}",
    "row_audit": f"""WITH {CLEANED}, pairs AS (SELECT d AS d, s AS s FROM dedup d JOIN safe s USING (o_orderkey))
{union([
    "SELECT d.o_orderkey AS o_orderkey, 'revenue' AS \"column\", 'coerced_type' AS action, d.revenue AS old, CAST(NULL AS VARCHAR) AS new_text, round(s.revenue, 4) AS new_number FROM pairs WHERE contains(d.revenue, ',')",
    *[f"SELECT d.o_orderkey, '{c}', 'imputed', NULL, NULL, round(s.{c}, 4) FROM pairs WHERE d.{c} IS NULL" for c in ("revenue", "amount")],
    "SELECT d.o_orderkey, 'status', 'imputed', NULL, s.status, NULL FROM pairs WHERE d.status IS NULL",
    *[f"SELECT d.o_orderkey, '{c}', 'standardized', d.{c}, s.{c}, NULL FROM pairs WHERE d.{c} <> s.{c}" for c in ("priority", "state")],
])}""",
    "rows_dropped": f"""WITH {CLEANED}
SELECT 'dropped_rows' AS action, CAST(NULL AS VARCHAR) AS "column", o_orderkey, count(*) - 1 AS copies FROM dirty GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'flagged_not_dropped', 'sparse_id', o_orderkey, 1 FROM safe WHERE sparse_id IS NULL
UNION ALL SELECT 'flagged_not_dropped', 'amount', o_orderkey, 1 FROM filled WHERE o_orderkey NOT IN (SELECT o_orderkey FROM every)""",
    "json_large_document": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
    "json_document_in_pieces": "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem",
    "apply_nothing": DIRTY_SQL,
    "cleaning_log": f"{PLAN} SELECT sequence, action, \"column\", method, count, CASE severity WHEN 'safe' THEN 'approved' ELSE 'rejected' END AS status FROM plan",
    "cleaning_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "describe": described("lineitem", LINEITEM_NUMBERS),
    "describe_dirty": described("dirty", [c for _, c in DIRTY_NUMERIC], f"WITH {DIRTY} "),
    "quantile_search": union(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
    "group_means": "SELECT l_returnflag AS level, round(avg(l_extendedprice), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "group_moments": f"""SELECT category, measure, level, n, round(mean, 4) AS mean, round(variance, 4) AS variance
      FROM ({moments('lineitem', ['l_returnflag', 'l_linestatus'], ['l_quantity', 'l_extendedprice'])})""",
    "categorical_columns": f"""WITH {DIRTY} SELECT * FROM ({union(f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS levels FROM dirty" for i, (c, k) in enumerate(DIRTY_COLUMNS) if k == 'text')})
      WHERE levels BETWEEN 2 AND 12""",
    "trend_stats": f"SELECT {TREND_COLUMNS} FROM ({LINE_TREND})",
    "trend_stats_text_dates": f"WITH {DIRTY} SELECT {TREND_COLUMNS} FROM ({DIRTY_TREND})",
    "pct_change": f"SELECT y, {CHANGE} + 0 AS pct_change FROM ({LINE_TREND}) WHERE y <> 'event_id'",
    "pearson_pairs": f"SELECT x, y, n, round(r, 5) + 0 AS r, round(slope, 5) + 0 AS slope, round(intercept, 5) + 0 AS intercept FROM ({pairs_sql('lineitem', LINEITEM_PAIRS)})",
    "welch_t": f"WITH moments AS ({moments('lineitem', ['l_linestatus'], ['l_quantity', 'l_extendedprice'])}), {COMPARED} SELECT measure, test, groups, n, round(stat, 4) AS stat, round(df1, 4) AS df1 FROM compared",
    "anova_f": f"WITH moments AS ({moments('events', ['event_type'], ['user_id', 'value'])}), {COMPARED} SELECT measure, test, groups, n, round(stat, 5) AS stat, round(df1, 5) AS df1, round(df2, 5) AS df2 FROM compared",
    "extreme_groups": f"WITH moments AS ({moments('lineitem', ['l_returnflag'], ['l_quantity', 'l_extendedprice', 'l_tax'])}), {COMPARED} SELECT measure, highest, lowest FROM compared",
    "p_values": f"WITH {EVENT_TESTS} SELECT kind, x, y, round(p, 6) AS p FROM valued",
    "p_values_all": f"WITH {EVENT_TESTS_ALL} SELECT kind, x, y, n, statistic, round(stat, 4) + 0 AS stat, round(p, 6) AS p FROM valued",
    "p_values_all_lineitem": f"WITH {LINEITEM_TESTS_ALL} SELECT kind, x, y, n, statistic, round(p, 6) AS p FROM valued",
    "ranked_findings_all": f"WITH {EVENT_TESTS_ALL}, {findings(limit=None)} SELECT * FROM findings",
    "ranked_findings_all_lineitem": f"WITH {LINEITEM_TESTS_ALL}, {findings(limit=None)} SELECT * FROM findings",
    "findings_omitted": union(f"SELECT '{k}' AS kind, '{x}' AS x, '{y}' AS y" for k, x, y in LINEITEM_TESTS_LISTED),
    "pearson_wide": f"""WITH wide AS (SELECT [{', '.join(f"CAST({wide(i)} AS DOUBLE)" for i in range(WIDE_COLUMNS))}] AS w FROM lineitem),
      numbers AS (SELECT CAST(range AS INTEGER) AS k FROM range({WIDE_COLUMNS})),
      pairs AS (SELECT a.k AS i, b.k AS j FROM numbers a JOIN numbers b ON a.k < b.k)
      SELECT 'w' || i AS x, 'w' || j AS y, regr_count(w[j + 1], w[i + 1])::BIGINT AS n, round(corr(w[j + 1], w[i + 1]), 5) + 0 AS r,
        round(regr_slope(w[j + 1], w[i + 1]), 3) + 0 AS slope FROM wide, pairs GROUP BY i, j""",
    "ranked_findings": f"{EVENT_FINDINGS} SELECT * FROM findings",
    "ranked_findings_lineitem": f"{LINEITEM_FINDINGS} SELECT * FROM findings",
    "findings_after_cleaning": f"{SAFE_FINDINGS} SELECT * FROM findings",
    "caveats": f"""WITH {CLEANED}, {SAFE_TESTS}, touched AS (SELECT *, list_sort(list_intersect([x, y], {SAFE_TOUCHED})) AS t, {SAFE_DUPLICATES} AS d FROM tests)
      SELECT kind, x, y, nullif(concat_ws('; ', CASE WHEN d > 0 THEN 'analysis excludes ' || d || ' row(s) removed as duplicates during cleaning' END,
        CASE WHEN len(t) > 0 THEN 'column(s) [''' || array_to_string(t, ''', ''') || '''] were modified during cleaning (imputed/standardized) — worth confirming that didn''t bias this result' END), '') AS caveat FROM touched""",
    "line_series": "SELECT ts AS moment, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL",
    "line_series_daily": "SELECT date_trunc('day', ts)::TIMESTAMP AS moment, round(avg(value), 6) AS value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "scatter_points": f"WITH {DIRTY} SELECT amount AS x, sparse_id::DOUBLE AS y FROM dirty WHERE amount IS NOT NULL AND sparse_id IS NOT NULL",
    "scatter_trendline": """WITH fit AS (SELECT regr_slope(p_retailprice, p_partkey) AS s, regr_intercept(p_retailprice, p_partkey) AS i,
        min(p_partkey) AS lo, max(p_partkey) AS hi FROM part WHERE p_retailprice IS NOT NULL),
      points AS (SELECT k::INTEGER AS step, lo + (hi - lo) * k / 49 AS x, s, i FROM fit, generate_series(0, 49) AS g(k))
      SELECT step, round(x, 4) AS x, round(i + s * x, 4) AS y FROM points""",
    "bar_series": f"WITH {DIRTY} SELECT status AS level, round(avg(amount), 6) AS mean, count(*) AS n FROM dirty WHERE status IS NOT NULL AND amount IS NOT NULL GROUP BY status",
    "chart_routing": f"""{EVENT_FINDINGS}, {ROUTED} SELECT rank, CASE WHEN n > 0 THEN recommended_chart END AS chart_type,
      CASE WHEN n > 0 THEN summary || coalesce(' (Note: ' || caveat || '.)', '') END AS caption, n,
      CASE WHEN n IS NULL THEN '{NO_CHART}' END AS reason FROM routed""",
    "report_schema": f"""{DIRTY_FACTS} SELECT position, "column", {INFERRED} AS type, printf('%.1f%%', round({SHARE}, 4) * 100) AS null_share,
      distinct_count AS unique FROM facts""",
    "report_methodology": f"{PLAN} SELECT sequence, CASE severity WHEN 'safe' THEN 'applied' ELSE 'reviewed but not applied' END AS section, action, \"column\", reason, count, method FROM plan",
    "report_findings": f"""{EVENT_FINDINGS}, {ROUTED} SELECT rank, summary, statistical_support, confidence, caveat,
      CASE WHEN n > 0 THEN recommended_chart END AS chart_type, n, CASE WHEN n IS NULL THEN '{NO_CHART}' END AS no_chart_reason FROM routed""",
    "report_findings_executive": f"{EVENT_FINDINGS}, {ROUTED} SELECT rank, summary, caveat, CASE WHEN n > 0 THEN recommended_chart END AS chart_type FROM routed",
    "report_headline": f"""{SAFE_FINDINGS}, {SUMMARY[len(CLEANED) + 2:]}
      SELECT (SELECT summary FROM findings WHERE rank = 1) AS headline, (SELECT count(*) FROM findings) AS finding_count,
      quality_score_before, quality_score_after FROM summary""",
    "csv_load": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate, o_orderpriority FROM orders",
    "tsv_load": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "csv_ragged": """SELECT o_orderkey AS k, CASE o_orderkey % 10 WHEN 1 THEN o_orderstatus WHEN 2 THEN NULL ELSE o_orderpriority || ',x' END AS v,
      CASE WHEN o_orderkey % 10 <> 1 THEN o_custkey END AS c FROM orders WHERE o_orderkey % 10 <> 0""",
    "csv_quarantine": "SELECT o_orderkey || ',' || o_orderstatus || ',' || o_custkey || ',extra' AS record FROM orders WHERE o_orderkey % 10 = 0",
    "csv_issues": "SELECT count(*) || ' row(s) had a mismatched column count and were quarantined (excluded) during load.' AS issue FROM orders WHERE o_orderkey % 10 = 0",
    "json_load": "SELECT o_orderkey, o_totalprice AS \"detail.price\", o_orderstatus AS \"detail.status\" FROM orders",
    "json_unwrap": "SELECT o_orderkey, o_custkey, o_orderstatus AS \"status.code\" FROM orders",
    "latin1_load": "SELECT c_custkey, c_mktsegment || ' é' AS segment FROM customer",
    "parquet_load": "SELECT * FROM customer",
    "load_summary": "SELECT 'parquet' AS source_type, 'orders.parquet' AS file_name, count(*) AS row_count, 6 AS column_count FROM orders",
}

_CANONICAL = f"""WITH {DIRTY}, spelled AS ({variants_of('dirty', 'priority')})
SELECT d.o_orderkey, coalesce(s.canonical, d.priority) AS priority FROM dirty d LEFT JOIN spelled s ON s.variant = d.priority"""
ORACLES["standardize_case"] = _CANONICAL
ORACLES["standardize_by_lookup"] = _CANONICAL

ORACLES |= {
    "json_lines_load": "SELECT * FROM conversations",
    "json_mixed_envelopes": "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders",
    "json_quarantine": "SELECT '{\"k\": ' || o_orderkey AS record FROM orders WHERE o_orderkey % 9 = 0",
    "csv_quoted_newlines": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_header_orders": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer",
    "parse_dates_notations": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 3 THEN date_trunc('month', m)::TIMESTAMP WHEN 4 THEN m WHEN 5 THEN m
      WHEN 7 THEN m - INTERVAL 2 HOUR ELSE date_trunc('day', m)::TIMESTAMP END AS moment
      FROM (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS m FROM orders)""",
    "quantile_infinities": """WITH v AS (SELECT CASE event_id % 50 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE value END AS value
      FROM events WHERE event_id % 50 <> 2) SELECT 0.0::DOUBLE AS p, min(value) AS value FROM v UNION ALL SELECT 0.01, quantile_cont(value, 0.01) FROM v
      UNION ALL SELECT 0.5, quantile_cont(value, 0.5) FROM v UNION ALL SELECT 0.99, quantile_cont(value, 0.99) FROM v
      UNION ALL SELECT 1.0, max(value) FROM v""",
    "profile_nan": """SELECT 'event_id' AS "column", count(*) AS row_count, 0::BIGINT AS null_count FROM events
      UNION ALL SELECT 'value', count(*), count(*) FILTER (event_id % 50 = 2 OR (value IS NULL AND event_id % 50 > 2)) FROM events""",
    "profile_minmax_wide_integers": """SELECT 'k' AS "column", (9007199254740992 + min(o_orderkey))::VARCHAR AS min_value,
      (9007199254740992 + max(o_orderkey))::VARCHAR AS max_value FROM orders""",
    "standardize_many": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name FROM customer",
    "lookup_by_shuffle": "SELECT c_custkey, 'x' || c_custkey AS c_name FROM customer",
    "all_tests_lineitem": "SELECT 'trend' AS kind, 8::BIGINT AS n UNION ALL SELECT 'pair', 28 UNION ALL SELECT 'group', 16",
}

ORACLES["custom_detector"] = """SELECT 'flagged_not_dropped' AS action, 'c_name' AS "column", 'every value occurs once' AS reason, count(*) AS count,
  NULL::VARCHAR AS method, 'review' AS severity, count(*) AS rows_affected FROM customer HAVING count(DISTINCT c_name) = count(*)"""
