"""The same results in plain SQL for DuckDB, on the same tables.

Adding 0.0 after a rounding turns a negative zero into zero.
"""

from __future__ import annotations

APPLICATIONS = """
WITH li AS (
  SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS goods,
         COUNT(*) AS n
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.*, c.c_acctbal, c.c_mktsegment, c.c_nationkey, li.goods, li.n,
         CAST(('0x' || substr(md5(CAST(o.o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS h,
         date_diff('day', DATE '2002-01-01', CAST(o.o_orderdate AS DATE)) AS db
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
app AS (
SELECT o_orderkey AS SK_ID_CURR,
  CAST(CASE WHEN (o_totalprice > 440000 AND h < 55) OR h < 2 THEN 1 ELSE 0 END AS INT) AS TARGET,
  o_orderstatus AS CODE_GENDER,
  o_orderpriority AS NAME_EDUCATION_TYPE,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS OCCUPATION_TYPE,
  c_mktsegment AS NAME_FAMILY_STATUS,
  CASE c_nationkey % 4 WHEN 0 THEN 'Working' WHEN 1 THEN 'Commercial associate'
       WHEN 2 THEN 'Pensioner' ELSE 'State servant' END AS NAME_INCOME_TYPE,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
  CASE WHEN c_acctbal > 2500 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
  CAST(c_nationkey % 3 + 1 AS INT) AS REGION_RATING_CLIENT,
  CAST(COALESCE(n, 0) AS INT) AS CNT_CHILDREN,
  o_totalprice AS AMT_CREDIT,
  c_acctbal AS AMT_INCOME_TOTAL,
  o_totalprice / (12 + o_orderkey % 37) AS AMT_ANNUITY,
  goods AS AMT_GOODS_PRICE,
  CAST(db AS INT) AS DAYS_BIRTH,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 365243
            ELSE -(((o_orderkey * 7919 + 3) % 1200) * 10) END AS INT) AS DAYS_EMPLOYED
FROM b)"""


def quotient(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE {a} / {b} END"


def logarithm(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


FEATURED = APPLICATIONS + f""",
years AS (
  SELECT * REPLACE (NULLIF(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED),
    round(DAYS_BIRTH / -365.0::DOUBLE, 1) AS YEARS_OLD,
    round(NULLIF(DAYS_EMPLOYED, 365243) / -365.0::DOUBLE, 1) + 0.0 AS YEARS_EMPLOYED
  FROM app),
feat AS (
  SELECT *,
    {r(quotient("AMT_ANNUITY", "AMT_INCOME_TOTAL"), 0, "ANNUITY_INCOME_PERCENTAGE")},
    {r(quotient("AMT_CREDIT", "AMT_INCOME_TOTAL"), 0, "CREDIT_INCOME_PERCENTAGE")},
    {r(quotient("AMT_CREDIT", "AMT_ANNUITY"), 0, "CREDIT_DURATION")},
    {r(quotient("YEARS_EMPLOYED", "YEARS_OLD"), 0, "EMP_AGE_PERCENTAGE")},
    {logarithm("AMT_INCOME_TOTAL")} AS LOG_INCOME_TOTAL,
    {logarithm("AMT_ANNUITY")} AS LOG_ANNUITY,
    {logarithm("AMT_CREDIT")} AS LOG_CREDIT,
    {logarithm("YEARS_EMPLOYED")} AS LOG_YEARS_EMPLOYED
  FROM years)"""

APPLICATION_COLUMNS = [
    ("SK_ID_CURR", "bigint", True),
    ("TARGET", "int", False),
    ("CODE_GENDER", "string", True),
    ("NAME_EDUCATION_TYPE", "string", True),
    ("OCCUPATION_TYPE", "string", True),
    ("NAME_FAMILY_STATUS", "string", True),
    ("NAME_INCOME_TYPE", "string", False),
    ("NAME_CONTRACT_TYPE", "string", False),
    ("FLAG_OWN_REALTY", "string", False),
    ("REGION_RATING_CLIENT", "int", True),
    ("CNT_CHILDREN", "int", False),
    ("AMT_CREDIT", "double", True),
    ("AMT_INCOME_TOTAL", "double", True),
    ("AMT_ANNUITY", "double", True),
    ("AMT_GOODS_PRICE", "double", True),
    ("DAYS_BIRTH", "int", True),
    ("DAYS_EMPLOYED", "int", True),
]


def app(select: str) -> str:
    return APPLICATIONS + "\n" + select


def feat(select: str) -> str:
    return FEATURED + "\n" + select


def histogram(source: str, value: str, bins: int) -> str:
    return f"""{source},
v AS (SELECT {value} AS x FROM feat WHERE {value} IS NOT NULL),
m AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
l AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM m),
w AS (SELECT lo, (hi - lo) / {bins} AS width FROM l),
c AS (SELECT CAST(least(floor((x - lo) / width), {bins - 1}) AS INT) AS bin, count(*) AS n
      FROM v, w GROUP BY 1)
SELECT CAST(s.bin AS INT) AS bin, {r("lo + s.bin * width", 9, "lower")},
  {r("lo + (s.bin + 1) * width", 9, "upper")}, COALESCE(c.n, 0) AS count
FROM (SELECT unnest(range({bins})) AS bin) s CROSS JOIN w LEFT JOIN c ON c.bin = s.bin"""


def density_of(name: str) -> str:
    return f"""
SELECT point, round(max(gx), 4) AS x,
  round(sum(n * exp(-0.5 * pow((gx - middle) / h, 2.0)))
        / (max(total) * max(h) * sqrt(2 * pi())), 13) AS density, '{name}' AS amount
FROM (
  SELECT g.point, s.mn - 3 * h + g.point * ((s.mx - s.mn + 6 * h) / 99) AS gx, k.n, k.middle, s.h, s.total
  FROM (SELECT min({name}) AS mn, max({name}) AS mx, count({name}) AS total,
          stddev_samp({name}) * pow(count({name}), -0.2) AS h FROM app) s,
       (SELECT CAST(unnest(range(100)) AS INT) AS point) g,
       (SELECT (2 * lo + (2 * bin + 1) * width) / 2 AS middle, n FROM (
          SELECT least(floor(({name} - lo) / width), 999) AS bin, any_value(lo) AS lo,
            any_value(width) AS width, count(*) AS n
          FROM app, (SELECT min({name}) AS lo, (max({name}) - min({name})) / 1000 AS width FROM app)
          WHERE {name} IS NOT NULL GROUP BY 1)) k)
GROUP BY point"""


def correlation_rows(source: str, cols: list[str], digits: int = 8) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', digits, 'corr')} FROM {source}"
        for a in cols
        for b in cols
    )


def ranked_columns(cols: list[str]) -> str:
    return ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}"
        for c in cols
    )


def outcome_rates(dims: list[str]) -> str:
    one = """SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS applicants,
  '{o}' AS outcome, round(100.0::DOUBLE * count(*) FILTER (TARGET = {t}) / count(*), 1) AS percent
FROM app WHERE {d} IS NOT NULL GROUP BY {d}"""
    return " UNION ALL ".join(
        one.format(d=d, o=o, t=t) for d in dims for o, t in (("paid", 0), ("default", 1))
    )


MISSING = """, gaps AS (
  UNPIVOT (SELECT {sums} FROM feat) ON COLUMNS(*) INTO NAME "column" VALUE missing),
profile AS (SELECT "column", CAST(missing AS BIGINT) AS missing,
  round(100.0::DOUBLE * missing / (SELECT count(*) FROM feat), 3) AS percent FROM gaps)"""
MISSING_COLUMNS = [name for name, _, _ in APPLICATION_COLUMNS if name != "TARGET"] + [
    "YEARS_OLD", "YEARS_EMPLOYED", "ANNUITY_INCOME_PERCENTAGE", "CREDIT_INCOME_PERCENTAGE",
    "CREDIT_DURATION", "EMP_AGE_PERCENTAGE", "LOG_INCOME_TOTAL", "LOG_ANNUITY", "LOG_CREDIT",
    "LOG_YEARS_EMPLOYED",
]
PROFILE = FEATURED + MISSING.format(
    sums=", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in MISSING_COLUMNS)
)

DESCRIBED = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "YEARS_OLD", "CREDIT_DURATION"]
DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS stddev, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM feat"""
    for c in DESCRIBED
)

CATEGORIES = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "REGION_RATING_CLIENT"]


def woe_of(source: str, cols: list[str]) -> str:
    """CTEs ``woe`` with feature, bin, rows, events, non_events, woe, iv."""
    counts = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS bin, count(*) AS "rows",
  count(*) FILTER (TARGET = 1) AS events, count(*) FILTER (TARGET = 0) AS non_events
FROM {source} GROUP BY 2"""
        for c in cols
    )
    return f""", cells AS ({counts}),
shares AS (
  SELECT *, events::DOUBLE / (SELECT count(*) FROM app WHERE TARGET = 1) AS e,
    non_events::DOUBLE / (SELECT count(*) FROM app WHERE TARGET = 0) AS z FROM cells),
woe AS (
  SELECT feature, bin, "rows", events, non_events,
    CASE WHEN events > 0 AND non_events > 0 THEN ln(e / z) ELSE 0.0 END AS woe,
    CASE WHEN events > 0 AND non_events > 0 THEN (e - z) * ln(e / z) ELSE 0.0 END AS iv
  FROM shares)"""


COUNTS = APPLICATIONS + """, per_score AS (
  SELECT AMT_CREDIT AS threshold, count(*) FILTER (TARGET = 1) AS ones, count(*) AS "rows"
  FROM app GROUP BY 1),
counts AS (
  SELECT threshold, ones, "rows",
    CAST(sum(ones) OVER (ORDER BY threshold DESC) AS BIGINT) AS ones_above,
    CAST(sum("rows") OVER (ORDER BY threshold DESC) AS BIGINT) AS rows_above,
    CAST(sum(ones) OVER () AS BIGINT) AS total_ones,
    CAST(sum("rows") OVER () AS BIGINT) AS total_rows
  FROM per_score)
"""
RECALL = "ones_above::DOUBLE / total_ones"
PRECISION = "ones_above::DOUBLE / rows_above"
F_MEASURE = "2.0::DOUBLE * ones_above / (total_ones + rows_above)"


def folds(repeat: int) -> str:
    return (
        "CAST((row_number() OVER (PARTITION BY TARGET ORDER BY "
        f"md5('1:{repeat}:' || CAST(SK_ID_CURR AS VARCHAR)), SK_ID_CURR) - 1) % 10 AS INT) AS fold_{repeat}"
    )


def place(col: str) -> str:
    """CTE that numbers the values of a column, most frequent first."""
    return (
        f"{col}_place AS (SELECT {col} AS v, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS i "
        f"FROM app WHERE {col} IS NOT NULL GROUP BY {col})"
    )


def hot(col: str, i: int, out: str) -> str:
    return f"CASE WHEN {col} = (SELECT v FROM {col}_place WHERE i = {i}) THEN 1.0 ELSE 0.0 END::DOUBLE AS {out}"


HASH_SPLIT = "CAST(('0x' || substr(md5('42:' || CAST(SK_ID_CURR AS VARCHAR)), 1, 8)) AS BIGINT) < 3006477107"
AMOUNT_BIN = (
    "CASE WHEN AMT_CREDIT < 150000 THEN 0 WHEN AMT_CREDIT < 300000 THEN 1 "
    "WHEN AMT_CREDIT < 440000 THEN 2 ELSE 3 END"
)
Z_TWO = APPLICATIONS + """, m AS (
  SELECT avg(AMT_CREDIT) AS ma, stddev_pop(AMT_CREDIT) AS sa, avg(AMT_ANNUITY) AS mb,
    stddev_pop(AMT_ANNUITY) AS sb, corr(AMT_CREDIT, AMT_ANNUITY) AS rho FROM app)
"""

FEATURED_MONOTONE = (
    APPLICATIONS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, l AS (
  SELECT TARGET, unnest(['AMT_CREDIT', 'AMT_GOODS_PRICE', 'YEARS_OLD']) AS feature,
    unnest([AMT_CREDIT, AMT_GOODS_PRICE, round(DAYS_BIRTH / -365.0::DOUBLE, 1)]) AS v FROM app),
o AS (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS place, count(*) OVER (PARTITION BY feature) AS n,
    min(v) OVER (PARTITION BY feature) AS least FROM l WHERE v IS NOT NULL),
q AS (
  SELECT DISTINCT feature, v AS cut FROM o, range(1, 20) AS r(i) WHERE place = greatest(1, (i * n + 19) // 20) AND v > least),
c AS (SELECT feature, list(cut ORDER BY cut) AS cuts FROM q GROUP BY 1),
p AS (
  SELECT feature, len(list_filter(cuts, lambda x: x <= v)) AS bin, count(*) AS n, sum(TARGET) AS e FROM o JOIN c USING (feature) GROUP BY 1, 2),
a AS (SELECT feature, sum(n) AS alln, sum(e) AS alle, max(bin) + 1 AS m FROM p GROUP BY 1),
seg AS (
  SELECT x.feature, x.bin AS i, y.bin + 1 AS j, CAST(sum(p.n) AS BIGINT) AS n, CAST(sum(p.e) AS BIGINT) AS e
  FROM p x JOIN p y ON x.feature = y.feature AND x.bin <= y.bin JOIN p ON p.feature = x.feature AND p.bin BETWEEN x.bin AND y.bin GROUP BY 1, 2, 3),
s AS (
  SELECT seg.*, CASE WHEN e > 0 AND e < n THEN (e::DOUBLE / alle - (n - e)::DOUBLE / (alln - alle))
    * ln((e::DOUBLE / alle) / ((n - e)::DOUBLE / (alln - alle))) ELSE 0.0 END AS iv FROM seg JOIN a USING (feature)),
w AS (
  SELECT feature, sign, i, j, n, e, {'iv': iv, 'k': -1, 'begins': [CAST(0 AS BIGINT)]} AS best, 1 AS k
  FROM s, (SELECT unnest([1, -1]) AS sign) WHERE i = 0
  UNION ALL
  SELECT w.feature, w.sign, s.i, s.j, any_value(s.n), any_value(s.e),
    max({'iv': w.best.iv + s.iv, 'k': w.best.k - 1, 'begins': list_append(w.best.begins, CAST(s.i AS BIGINT))}), w.k + 1
  FROM w JOIN s ON s.feature = w.feature AND s.i = w.j AND w.sign * (s.e * w.n - w.e * s.n) > 0 GROUP BY w.feature, w.sign, s.i, s.j, w.k),
won AS (SELECT w.feature, max(best) AS way FROM w JOIN a ON a.feature = w.feature AND w.j = a.m GROUP BY 1),
d AS (SELECT feature, unnest(way.begins) AS i, unnest(range(len(way.begins))) AS bin,
  unnest(list_append(way.begins[2:], (SELECT m FROM a WHERE a.feature = won.feature))) AS j FROM won)
SELECT d.feature, CAST(d.bin AS INT) AS bin, CASE WHEN d.i > 0 THEN cuts[d.i] END AS lower, cuts[d.j] AS upper,
  s.n AS "rows", s.e AS events, round(s.e::DOUBLE / s.n, 9) AS event_rate
FROM d JOIN c USING (feature) JOIN s ON s.feature = d.feature AND s.i = d.i AND s.j = d.j"""
)

ORACLES: dict[str, str] = {
    # ---- sources, sinks, schema ----
    "read_csv": "SELECT * FROM orders",
    "register": app("SELECT CODE_GENDER, count(*) AS applicants FROM app GROUP BY CODE_GENDER"),
    "read_table": "SELECT o_orderkey, o_totalprice FROM orders",
    "write_prepared": app("SELECT * FROM app"),
    "sample_rows": app(
        "SELECT SK_ID_CURR, TARGET, AMT_CREDIT FROM app "
        "ORDER BY md5('7:' || CAST(SK_ID_CURR AS VARCHAR)), SK_ID_CURR LIMIT 10"
    ),
    "select_by_type": app(
        "SELECT " + ", ".join(n for n, t, _ in APPLICATION_COLUMNS if t != "double") + " FROM app"
    ),
    # ---- projections, filters, scalar expressions ----
    "select_cols": app("SELECT SK_ID_CURR, AMT_CREDIT, TARGET FROM app"),
    "drop_cols": app("SELECT * EXCLUDE (SK_ID_CURR, AMT_GOODS_PRICE, AMT_ANNUITY) FROM app"),
    "cast_cols": app(
        "SELECT SK_ID_CURR, CAST(trunc(AMT_CREDIT) AS INT) AS AMT_CREDIT, "
        "CAST(trunc(AMT_INCOME_TOTAL) AS INT) AS AMT_INCOME_TOTAL, "
        "TRY_CAST(NAME_EDUCATION_TYPE AS INT) AS NAME_EDUCATION_TYPE FROM app"
    ),
    "rename_cols": app(
        "SELECT SK_ID_CURR AS application_id, AMT_CREDIT AS norm_AMT_CREDIT, "
        "AMT_INCOME_TOTAL AS norm_AMT_INCOME_TOTAL FROM app"
    ),
    "sentinel_to_null": app("SELECT SK_ID_CURR, NULLIF(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED FROM app"),
    "years_from_days": feat("SELECT SK_ID_CURR, DAYS_BIRTH, YEARS_OLD FROM feat"),
    "ratio": feat("SELECT SK_ID_CURR, AMT_CREDIT, AMT_INCOME_TOTAL, CREDIT_INCOME_PERCENTAGE FROM feat"),
    "log_feature": feat(
        f"SELECT SK_ID_CURR, AMT_INCOME_TOTAL, {r('LOG_INCOME_TOTAL', 9, 'LOG_INCOME_TOTAL')} FROM feat"
    ),
    "add_credit_features": feat(
        "SELECT SK_ID_CURR, DAYS_EMPLOYED, YEARS_OLD, YEARS_EMPLOYED, ANNUITY_INCOME_PERCENTAGE, "
        "CREDIT_INCOME_PERCENTAGE, CREDIT_DURATION, EMP_AGE_PERCENTAGE, "
        + ", ".join(
            r(c, 9, c) for c in ["LOG_INCOME_TOTAL", "LOG_ANNUITY", "LOG_CREDIT", "LOG_YEARS_EMPLOYED"]
        )
        + " FROM feat"
    ),
    "filter_rows": app(
        "SELECT SK_ID_CURR, OCCUPATION_TYPE, AMT_CREDIT FROM app WHERE TARGET = 1 "
        "AND AMT_CREDIT > AMT_INCOME_TOTAL AND OCCUPATION_TYPE IS NOT NULL"
    ),
    "drop_missing": app(
        "SELECT SK_ID_CURR, OCCUPATION_TYPE, AMT_GOODS_PRICE FROM app "
        "WHERE OCCUPATION_TYPE IS NOT NULL AND AMT_GOODS_PRICE IS NOT NULL"
    ),
    "fill_missing": app(
        "SELECT SK_ID_CURR, COALESCE(OCCUPATION_TYPE, 'Unknown') AS OCCUPATION_TYPE, "
        "COALESCE(AMT_GOODS_PRICE, 0.0) AS AMT_GOODS_PRICE FROM app"
    ),
    "apply_threshold": app(
        "SELECT SK_ID_CURR, AMT_CREDIT, CAST(CASE WHEN AMT_CREDIT > 440000 THEN 1 ELSE 0 END AS INT) "
        "AS prediction FROM app"
    ),
    "range_filter": app("SELECT SK_ID_CURR, AMT_CREDIT FROM app WHERE AMT_CREDIT BETWEEN 100000 AND 300000"),
    # ---- aggregations ----
    "group_mean": app(
        "SELECT TARGET, round(avg(AMT_CREDIT), 4) AS avg_AMT_CREDIT, "
        "round(avg(AMT_INCOME_TOTAL), 4) AS avg_AMT_INCOME_TOTAL, "
        "round(avg(AMT_GOODS_PRICE), 4) AS avg_AMT_GOODS_PRICE FROM app GROUP BY TARGET"
    ),
    "describe_cols": feat(DESCRIBE),
    "crosstab": app(
        "SELECT TARGET, " + ", ".join(f"count(*) FILTER (CODE_GENDER = '{g}') AS {g}" for g in "FOP")
        + " FROM app GROUP BY TARGET"
    ),
    "crosstab_with_gaps": app(
        "SELECT OCCUPATION_TYPE, count(*) FILTER (NAME_CONTRACT_TYPE = 'Cash loans') AS cash_loans, "
        "count(*) FILTER (NAME_CONTRACT_TYPE = 'Revolving loans') AS revolving_loans "
        "FROM app GROUP BY OCCUPATION_TYPE"
    ),
    "pivot_mean": app(
        "SELECT TARGET, "
        + ", ".join(f"round(avg(AMT_INCOME_TOTAL) FILTER (CODE_GENDER = '{g}'), 4) AS {g}" for g in "FOP")
        + " FROM app GROUP BY TARGET"
    ),
    "pivot_mean_listed": app(
        "SELECT TARGET, "
        + ", ".join(
            f"round(avg(AMT_INCOME_TOTAL) FILTER (NAME_FAMILY_STATUS = '{s}'), 4) AS {s}"
            for s in ("BUILDING", "HOUSEHOLD")
        )
        + " FROM app GROUP BY TARGET"
    ),
    "count_where": app("SELECT count(*) FILTER (AMT_CREDIT > AMT_INCOME_TOTAL) AS count FROM app"),
    "group_count": app(
        "SELECT CNT_CHILDREN, count(*) FILTER (TARGET = 1) AS defaults, "
        "count(*) FILTER (TARGET = 0) AS non_defaults, count(*) AS applicants FROM app GROUP BY 1"
    ),
    "value_counts": app(
        "SELECT OCCUPATION_TYPE, count(*) AS count FROM app WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY 1"
    ),
    "share_of_total": app(
        "SELECT OCCUPATION_TYPE, count(*) AS count, "
        "round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM app), 0) AS percent FROM app "
        "WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"
    ),
    "outcome_rate_by_category": app(
        outcome_rates(
            ["CODE_GENDER", "OCCUPATION_TYPE", "FLAG_OWN_REALTY", "NAME_FAMILY_STATUS",
             "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "REGION_RATING_CLIENT"]
        )
    ),
    "class_balance": app(
        "SELECT count(*) FILTER (TARGET = 1) AS ones, count(*) FILTER (TARGET = 0) AS zeros, "
        "round(count(*) FILTER (TARGET = 1)::DOUBLE / count(TARGET), 9) AS share_ones, "
        "round(count(*) FILTER (TARGET = 0)::DOUBLE / count(TARGET), 9) AS share_zeros FROM app"
    ),
    "missing_profile": PROFILE + ' SELECT * FROM profile ORDER BY missing DESC, "column" LIMIT 10',
    "distinct_missing_rates": PROFILE + " SELECT DISTINCT percent FROM profile",
    "histogram": histogram(FEATURED, "DAYS_EMPLOYED / -365.0::DOUBLE", 50),
    "histogram_of_income": histogram(FEATURED, "AMT_INCOME_TOTAL", 4000),
    "log_distribution": histogram(FEATURED, "LOG_INCOME_TOTAL", 50),
    "density": app(density_of("AMT_CREDIT") + " UNION ALL " + density_of("AMT_GOODS_PRICE")),
    "correlation": feat(correlation_rows("feat", DESCRIBED)),
    "correlation_spearman": APPLICATIONS
    + ", ranked AS (SELECT "
    + ranked_columns(["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_GOODS_PRICE", "CNT_CHILDREN"])
    + " FROM app WHERE AMT_GOODS_PRICE IS NOT NULL) "
    + correlation_rows("ranked", ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_GOODS_PRICE", "CNT_CHILDREN"]),
    # ---- joins, set operations ----
    "semi_join_where": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem "
    "WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "attach_by_key": app(
        "SELECT a.SK_ID_CURR, a.AMT_CREDIT, a.AMT_INCOME_TOTAL, b.CODE_GENDER, b.OCCUPATION_TYPE "
        "FROM app a JOIN app b ON a.SK_ID_CURR = b.SK_ID_CURR"
    ),
    "union_rows": app(
        "SELECT CODE_GENDER, count(*) AS count, 'paid' AS outcome FROM app WHERE TARGET = 0 GROUP BY 1 "
        "UNION ALL "
        "SELECT CODE_GENDER, count(*) AS count, 'default' AS outcome FROM app WHERE TARGET = 1 GROUP BY 1"
    ),
    # ---- running values ----
    "carry_fill": app(
        "SELECT SK_ID_CURR, "
        + ", ".join(
            f"COALESCE(last_value({c} IGNORE NULLS) OVER (ORDER BY SK_ID_CURR ROWS BETWEEN UNBOUNDED "
            f"PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY SK_ID_CURR ROWS "
            f"BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
            for c in ("OCCUPATION_TYPE", "AMT_GOODS_PRICE")
        )
        + " FROM app"
    ),
    "cumulative_share": APPLICATIONS
    + """, g AS (
  SELECT CNT_CHILDREN, CAST(SUM(CAST(AMT_CREDIT AS DECIMAL(18,2))) AS DOUBLE) AS credit FROM app GROUP BY 1),
s AS (SELECT CNT_CHILDREN, credit / (SELECT sum(credit) FROM g) AS share FROM g)
SELECT CNT_CHILDREN, round(share, 9) AS share,
  round(sum(share) OVER (ORDER BY CNT_CHILDREN), 9) AS cumulative_share FROM s""",
    "running_class_counts": COUNTS + "SELECT * FROM counts",
    # ---- sort, limit, top-k ----
    "top_k": app("SELECT AMT_INCOME_TOTAL FROM app ORDER BY 1 DESC LIMIT 10"),
    "top_k_distinct": app("SELECT DISTINCT AMT_CREDIT FROM app ORDER BY 1 DESC LIMIT 5"),
    "sort_rows": app("SELECT SK_ID_CURR, OCCUPATION_TYPE, AMT_CREDIT FROM app ORDER BY 2 DESC NULLS LAST, 3, 1"),
    "head": app("SELECT SK_ID_CURR, AMT_CREDIT FROM app ORDER BY AMT_CREDIT DESC, SK_ID_CURR LIMIT 20"),
    # ---- feature preparation ----
    "assemble": app(
        "SELECT SK_ID_CURR, AMT_CREDIT AS f1, AMT_INCOME_TOTAL AS f2, DAYS_BIRTH::DOUBLE AS f3 FROM app"
    ),
    "scale": app(
        "SELECT SK_ID_CURR, "
        + ", ".join(
            r(f"{c} / (SELECT stddev_samp({c}) FROM app)", 6, f"scaled_{c}")
            for c in ("AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH")
        )
        + " FROM app"
    ),
    "zscore": app(
        "SELECT SK_ID_CURR, "
        + ", ".join(
            r(f"({c} - (SELECT avg({c}) FROM app)) / (SELECT stddev_pop({c}) FROM app)", 6, f"norm_{c}")
            for c in ("AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH", "AMT_GOODS_PRICE")
        )
        + " FROM app"
    ),
    "index_labels": APPLICATIONS
    + f", {place('OCCUPATION_TYPE')}, {place('NAME_EDUCATION_TYPE')} "
    + "SELECT SK_ID_CURR, OCCUPATION_TYPE, NAME_EDUCATION_TYPE, "
    + ", ".join(
        f"COALESCE((SELECT i FROM {c}_place WHERE v = {c}), (SELECT count(*) FROM {c}_place))::DOUBLE AS {c}Index"
        for c in ("OCCUPATION_TYPE", "NAME_EDUCATION_TYPE")
    )
    + " FROM app",
    "one_hot": APPLICATIONS
    + f", {place('CODE_GENDER')} SELECT SK_ID_CURR, {hot('CODE_GENDER', 0, 'is_first')}, "
    + f"{hot('CODE_GENDER', 1, 'is_second')} FROM app",
    "prep_stages": APPLICATIONS
    + f", {place('CODE_GENDER')}, {place('OCCUPATION_TYPE')} SELECT SK_ID_CURR, TARGET::DOUBLE AS label, "
    + ", ".join(hot("CODE_GENDER", i, f"f{i}") for i in range(3))
    + ", "
    + ", ".join(hot("OCCUPATION_TYPE", i, f"f{3 + i}") for i in range(4))
    + ", AMT_CREDIT AS f7 FROM app",
    "split": app(
        f"SELECT SK_ID_CURR, TARGET, CASE WHEN {HASH_SPLIT} THEN 'train' ELSE 'test' END AS part FROM app"
    ),
    "class_weights": app(
        "SELECT SK_ID_CURR, TARGET, round(CASE WHEN TARGET = 1 THEN (SELECT avg(1.0 - TARGET) FROM app) "
        'ELSE (SELECT avg(TARGET) FROM app) END, 9) AS "classWeights" FROM app'
    ),
    "impute_by": app(
        "SELECT SK_ID_CURR, AMT_CREDIT, round(COALESCE(AMT_GOODS_PRICE, "
        "(SELECT regr_intercept(AMT_GOODS_PRICE, AMT_CREDIT) FROM app) + "
        "(SELECT regr_slope(AMT_GOODS_PRICE, AMT_CREDIT) FROM app) * AMT_CREDIT), 3) AS AMT_GOODS_PRICE FROM app"
    ),
    # The column with fewer gaps, goods price, is refitted first in each round.
    "impute_two": APPLICATIONS
    + ", given AS (SELECT SK_ID_CURR, AMT_GOODS_PRICE AS g, CAST(nullif(DAYS_EMPLOYED, 365243) AS DOUBLE) AS e FROM app), "
    + "f0 AS (SELECT SK_ID_CURR, g, e, coalesce(g, (SELECT avg(g) FROM given)) AS gf, coalesce(e, (SELECT avg(e) FROM given)) AS ef FROM given)"
    + "".join(
        f", g{i} AS (SELECT * REPLACE (coalesce(g, (SELECT regr_intercept(g, ef) FROM f{i - 1}) + (SELECT regr_slope(g, ef) FROM f{i - 1}) * ef) AS gf) "
        f"FROM f{i - 1}), f{i} AS (SELECT * REPLACE (coalesce(e, (SELECT regr_intercept(e, gf) FROM g{i}) + (SELECT regr_slope(e, gf) FROM g{i}) * gf) AS ef) "
        f"FROM g{i})"
        for i in (1, 2)
    )
    + " SELECT SK_ID_CURR, round(gf, 2) AS AMT_GOODS_PRICE, round(ef, 2) AS DAYS_EMPLOYED FROM f2",
    # Carried along the key; imputed by the lines of the train part.
    "prepared_chain": APPLICATIONS
    + f", given AS (SELECT SK_ID_CURR, {HASH_SPLIT} AS train, AMT_GOODS_PRICE AS g, CAST(nullif(DAYS_EMPLOYED, 365243) AS DOUBLE) AS e, "
    + "round(DAYS_BIRTH / -365.0::DOUBLE, 1) AS YEARS_OLD, NAME_INCOME_TYPE, "
    + "COALESCE(last_value(OCCUPATION_TYPE IGNORE NULLS) OVER (ORDER BY SK_ID_CURR ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    + "first_value(OCCUPATION_TYPE IGNORE NULLS) OVER (ORDER BY SK_ID_CURR ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS OCCUPATION_TYPE FROM app), "
    + "f0 AS (SELECT *, coalesce(g, (SELECT avg(g) FROM given WHERE train)) AS gf, coalesce(e, (SELECT avg(e) FROM given WHERE train)) AS ef FROM given)"
    + "".join(
        f", g{i} AS (SELECT * REPLACE (coalesce(g, (SELECT regr_intercept(g, ef) FROM f{i - 1} WHERE train) "
        f"+ (SELECT regr_slope(g, ef) FROM f{i - 1} WHERE train) * ef) AS gf) FROM f{i - 1}), "
        f"f{i} AS (SELECT * REPLACE (coalesce(e, (SELECT regr_intercept(e, gf) FROM g{i} WHERE train) "
        f"+ (SELECT regr_slope(e, gf) FROM g{i} WHERE train) * gf) AS ef) FROM g{i})"
        for i in (1, 2)
    )
    + " SELECT SK_ID_CURR, OCCUPATION_TYPE, NAME_INCOME_TYPE, round(gf, 2) AS AMT_GOODS_PRICE, round(ef, 2) AS DAYS_EMPLOYED, YEARS_OLD FROM f2",
    "woe_table": APPLICATIONS
    + woe_of("app", CATEGORIES)
    + f' SELECT feature, bin, "rows", events, non_events, {r("woe", 9, "woe")}, {r("iv", 9, "iv")} FROM woe',
    # Exact twentieths, then the best rising or falling way to join them, by its last bin (i, j].
    "monotone_bins": FEATURED_MONOTONE,
    "count_ballots": APPLICATIONS
    + woe_of("app", [*CATEGORIES, "FLAG_OWN_REALTY", "NAME_INCOME_TYPE"])
    + """, s AS (
  SELECT *, events + non_events AS n, sum(events) OVER g * 1.0::DOUBLE * (events + non_events) / sum(events + non_events) OVER g AS expected
  FROM woe WINDOW g AS (PARTITION BY feature)),
t AS (
  SELECT feature, sum(iv) AS iv, count(*) - 1 AS free,
    sum(pow(events - expected, 2) / expected + pow(events - expected, 2) / (n - expected)) AS x FROM s GROUP BY 1),
u AS (
  SELECT feature, 'information_value' AS selector, iv AS strength FROM t
  UNION ALL SELECT feature, 'chi_square', (pow(x / free, 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * free))) / sqrt(2.0::DOUBLE / (9 * free)) FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY strength DESC, feature) AS place FROM u)
SELECT feature, selector, round(strength, 9) AS strength, CAST(place AS INT) AS place FROM v WHERE place <= 3""",
    "apply_woe": APPLICATIONS
    + f", binned AS (SELECT * REPLACE ({AMOUNT_BIN} AS AMT_CREDIT) FROM app)"
    + woe_of("binned", ["AMT_CREDIT", *CATEGORIES])
    + " SELECT SK_ID_CURR, "
    + ", ".join(
        r(
            f"(SELECT woe FROM woe WHERE feature = '{c}' AND bin IS NOT DISTINCT FROM CAST(binned.{c} AS VARCHAR))",
            9,
            f"{c}_woe",
        )
        for c in ["AMT_CREDIT", *CATEGORIES]
    )
    + " FROM binned",
    "rank_by_iv": APPLICATIONS
    + woe_of("app", CATEGORIES)
    + " SELECT feature, round(sum(iv), 9) AS information_value FROM woe GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "pca_of_two": Z_TWO
    + f"""SELECT SK_ID_CURR,
  {r("abs((AMT_CREDIT - ma) / sa + (AMT_ANNUITY - mb) / sb) / sqrt(2)", 6, "size_1")},
  {r("abs((AMT_CREDIT - ma) / sa - (AMT_ANNUITY - mb) / sb) / sqrt(2)", 6, "size_2")} FROM app, m""",
    "explained_variance": Z_TWO
    + """SELECT CAST(1 AS INT) AS component, round((1 + rho) / 2, 8) AS explained_variance,
  round((1 + rho) / 2, 8) AS cumulative FROM m
UNION ALL SELECT 2, round((1 - rho) / 2, 8), 1.0::DOUBLE FROM m""",
    # ---- tuning, evaluation ----
    "stratified_folds": app(f"SELECT SK_ID_CURR, TARGET, {folds(1)}, {folds(2)}, {folds(3)} FROM app"),
    "roc_auc": COUNTS
    + """SELECT round(CAST(sum(ones::HUGEINT * (2 * ((total_rows - total_ones) - (rows_above - ones_above))
  + "rows" - ones)) AS DOUBLE) / (2.0::DOUBLE * max(total_ones) * max(total_rows - total_ones)), 12) AS auc
FROM counts""",
    "recall_by_threshold": COUNTS + f"SELECT threshold, round({RECALL}, 9) AS recall FROM counts",
    "precision_by_threshold": COUNTS + f"SELECT threshold, round({PRECISION}, 9) AS precision FROM counts",
    "precision_recall_curve": COUNTS
    + f"SELECT threshold, round({RECALL}, 9) AS recall, round({PRECISION}, 9) AS precision FROM counts",
    "f_measure_by_threshold": COUNTS + f"SELECT threshold, round({F_MEASURE}, 9) AS f_measure FROM counts",
    "best_threshold": COUNTS
    + f"SELECT threshold, round({F_MEASURE}, 9) AS f_measure FROM counts ORDER BY {F_MEASURE} DESC, 1 DESC LIMIT 1",
    "roc_curve": COUNTS
    + "SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL "
    + "SELECT threshold, round((rows_above - ones_above)::DOUBLE / (total_rows - total_ones), 9) AS fpr, "
    + f"round({RECALL}, 9) AS tpr FROM counts",
    "confusion_matrix": app(
        "SELECT TARGET AS actual, count(*) FILTER (AMT_CREDIT <= 440000) AS predicted_0, "
        "count(*) FILTER (AMT_CREDIT > 440000) AS predicted_1 FROM app GROUP BY TARGET"
    ),
}
