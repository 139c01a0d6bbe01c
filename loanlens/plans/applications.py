"""The applicant table, derived from the order, customer and line tables.

One row per order. Gaps, the employment sentinel and a learnable label come from
the keys and amounts, so the table grows with the data it is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.settings import EMPLOYMENT_SENTINEL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joins carry no hints: customers are broadcast only if Spark's size limit
    allows it, and a customer with very many orders is split by adaptive execution.
    Lines are summed per order first, and the whole branch disappears from plans
    that use neither goods price nor children."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            # Summed as whole cents: exact in any order, and cheaper than decimals.
            (F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("goods"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = table(spark, sf_dir, "orders").join(customers, "o_custkey").join(lines, "o_orderkey", "left")

    key = F.col("o_orderkey")
    chance = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    late = ((F.col("o_totalprice") > 440000) & (chance < 55)) | (chance < 2)
    employed = -(((key * 7919 + 3) % 1200) * 10)
    kind = F.col("c_nationkey") % 4
    return joined.select(
        key.alias("SK_ID_CURR"),
        F.when(late, 1).otherwise(0).alias("TARGET"),
        F.col("o_orderstatus").alias("CODE_GENDER"),
        F.col("o_orderpriority").alias("NAME_EDUCATION_TYPE"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("OCCUPATION_TYPE"),
        F.col("c_mktsegment").alias("NAME_FAMILY_STATUS"),
        F.when(kind == 0, "Working")
        .when(kind == 1, "Commercial associate")
        .when(kind == 2, "Pensioner")
        .otherwise("State servant")
        .alias("NAME_INCOME_TYPE"),
        F.when(key % 10 == 0, "Revolving loans").otherwise("Cash loans").alias("NAME_CONTRACT_TYPE"),
        F.when(F.col("c_acctbal") > 2500, "Y").otherwise("N").alias("FLAG_OWN_REALTY"),
        (F.col("c_nationkey") % 3 + 1).alias("REGION_RATING_CLIENT"),
        F.coalesce("lines", F.lit(0)).cast("int").alias("CNT_CHILDREN"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        (F.col("o_totalprice") / (12 + key % 37)).alias("AMT_ANNUITY"),
        F.col("goods").alias("AMT_GOODS_PRICE"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("2002-01-01").cast("date")).alias("DAYS_BIRTH"),
        F.when(key % 5 == 0, EMPLOYMENT_SENTINEL).otherwise(employed).cast("int").alias("DAYS_EMPLOYED"),
    )
