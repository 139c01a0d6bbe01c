"""What the optimiser makes of the operators: scans, pushdown, shuffles."""

from loanlens.operators import features, joins, ordering, summaries, windows
from loanlens.plans.applications import applications, table
from loanlens.settings import OUTCOME_DIMENSIONS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_used_columns_are_read(spark, sf_dir):
    text = plan(ordering.top_k_distinct(table(spark, sf_dir, "orders"), "o_totalprice", 5))
    assert "ReadSchema: struct<o_totalprice:double>" in text and "TakeOrderedAndProject" in text


def test_filters_reach_the_scan(spark, sf_dir):
    lines = features.filter_rows(table(spark, sf_dir, "lineitem"), "l_quantity > 40")
    assert "GreaterThan(l_quantity,40.0)" in plan(lines)


def test_lines_are_not_read_when_not_needed(spark, sf_dir):
    text = plan(summaries.group_count(applications(spark, sf_dir), "NAME_EDUCATION_TYPE"))
    assert "lineitem" not in text


def test_many_dimensions_and_columns_in_one_scan(spark, sf_dir):
    rates = summaries.outcome_rate_by_category(applications(spark, sf_dir), OUTCOME_DIMENSIONS)
    profile = summaries.missing_profile(table(spark, sf_dir, "orders"))
    assert plan(rates).count("orders.parquet") == 1
    assert plan(profile).count("orders.parquet") == 1


def test_derived_columns_are_one_projection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    df = features.add_credit_features(
        orders.selectExpr(
            "o_orderkey AS DAYS_EMPLOYED", "o_custkey AS DAYS_BIRTH", "o_totalprice AS AMT_CREDIT",
            "o_totalprice AS AMT_ANNUITY", "o_totalprice AS AMT_INCOME_TOTAL",
        )
    )
    assert "Exchange" not in plan(df)


def test_no_raw_row_goes_through_a_single_task(spark, sf_dir):
    """Only the one-row-per-bucket tables may be gathered in one partition."""
    df = applications(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE")
    text = plan(windows.carry_fill(df, ["OCCUPATION_TYPE"], "SK_ID_CURR"))
    gathered = text.split("Exchange SinglePartition")[1:]
    assert all("HashAggregate" in part.splitlines()[1] for part in gathered)
    counts = windows.running_class_counts(applications(spark, sf_dir), "AMT_CREDIT", "TARGET")
    gathered = plan(counts).split("Exchange SinglePartition")[1:]
    assert gathered and all("HashAggregate" in part.splitlines()[1] for part in gathered)


def test_semi_join_reduces_keys_before_the_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    text = plan(joins.semi_join_where(lines, "l_orderkey", "l_quantity > 40"))
    assert "LeftSemi" in text and "GreaterThan(l_quantity,40.0)" in text and text.count("FileScan") == 2
