"""Feature vectors, scaling, encoding, splits and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions import hash_number, known, seeded_hash
from loanlens.session import settle


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector. Gaps are an error here: fill them first. The columns are
    named, never picked by type, so label and key cannot slip in."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def scale(
    df: DataFrame, cols: Sequence[str], mean: bool = False, std: bool = True
) -> DataFrame:
    """Add ``features`` and ``scaled_features``: divided by the sample deviation."""
    vectors = assemble(df, cols)
    scaler = StandardScaler(
        inputCol="features", outputCol="scaled_features", withMean=mean, withStd=std
    )
    return scaler.fit(vectors).transform(vectors)


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Spread a vector column over named columns."""
    values = vector_to_array(F.col(vector))
    return df.withColumns({name: values[i] for i, name in enumerate(names)})


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population deviation of each column, to scale other frames by. Gaps and NaN
    do not count."""
    moments = df.agg(
        *[F.avg(known(df, name)).alias(f"m{i}") for i, name in enumerate(cols)],
        *[F.stddev_pop(known(df, name)).alias(f"s{i}") for i, name in enumerate(cols)],
    ).head()
    return {name: (moments[f"m{i}"], moments[f"s{i}"]) for i, name in enumerate(cols)}


def zscore(
    df: DataFrame,
    cols: Sequence[str],
    prefix: str = "norm_",
    moments: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Columns less their mean, by their population deviation; a constant column becomes zero.

    Without ``moments`` of an earlier fit those of this frame are used. NaN becomes a gap.
    """
    moments = moments or fit_zscore(df, cols)
    normal = {n: (known(df, n) - F.lit(moments[n][0])) / F.lit(moments[n][1] or 1.0) for n in cols}
    return df.withColumns({prefix + name: value for name, value in normal.items()})


#: Values of a column up to which its indexes are looked up in the row's own expression.
LISTED = 250


def fit_index(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, index) of all values: most frequent first, ties alphabetical.

    Values are counted and sorted by range, so that equally frequent ones, of which there
    may be millions, spread over tasks; a value's index is its place in its task and the
    number of its feature's values in the tasks before. Written, and never on the driver.
    """
    long = df.select(*[F.col(name).cast("string").alias(name) for name in cols]).unpivot([], list(cols), "feature", "value")
    counts = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = ["feature", F.desc("n"), "value"]
    placed = settle(
        counts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("feature", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    )
    sizes = placed.groupBy("feature", "part").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("feature", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    found = placed.join(F.broadcast(offset), ["feature", "part"])
    return settle(found.select("feature", "value", (F.col("place") + F.col("offset")).alias("index")))


def index_labels(df: DataFrame, cols: Sequence[str], suffix: str = "Index", fitted: DataFrame | None = None) -> DataFrame:
    """Category to index, most frequent first, ties alphabetical; unseen or missing
    values get the next free index. ``fitted`` is a table of ``fit_index``, else that of
    this frame. Features of many values are joined by value."""
    fitted = fit_index(df, cols) if fitted is None else fitted
    sizes = {r["feature"]: r["n"] for r in fitted.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [name for name in cols if sizes.get(name, 0) <= LISTED]
    listed: dict[str, list[str]] = {name: [] for name in few}
    for r in fitted.where(F.col("feature").isin(few)).orderBy("feature", "index").collect():
        listed[r["feature"]].append(r["value"])
    found = {}
    for name, values in listed.items():
        place = F.array_position(F.lit(values).cast("array<string>"), F.col(name).cast("string"))
        found[name + suffix] = F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(len(values))).cast("double")
    indexed = df.withColumns(found)
    for name in cols:
        if name not in listed:
            lookup = fitted.where(F.col("feature") == name).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
            joined = indexed.join(lookup, F.col(name).cast("string") == F.col("_value"), "left")
            indexed = joined.withColumn(name + suffix, F.coalesce("_index", F.lit(sizes[name])).cast("double")).drop("_value", "_index")
    return indexed.select(*df.columns, *[name + suffix for name in cols])


def one_hot(
    df: DataFrame, cols: Sequence[str], drop_last: bool = True, suffix: str = "classVec"
) -> DataFrame:
    """Sparse indicator vector of each category column, with or without its last category.

    A missing category is an error: fill it first, or use ``prep_pipeline``.
    """
    indexed = [name + "Index" for name in cols]
    stages = [
        StringIndexer(inputCols=list(cols), outputCols=indexed),
        OneHotEncoder(
            inputCols=indexed, outputCols=[name + suffix for name in cols], dropLast=drop_last
        ),
    ]
    return Pipeline(stages=stages).fit(df).transform(df)


def prep_pipeline(cat_cols: Sequence[str], num_cols: Sequence[str], label: str | None = None) -> Pipeline:
    """Unfitted stages: category indexes, indicators, label index if one is named, feature
    vector.

    Every known category has an indicator; a missing or unseen one has none set.
    Fit it on the training rows and apply the fitted stages to both parts.
    """
    indexed = [name + "Index" for name in cat_cols]
    encoded = [name + "classVec" for name in cat_cols]
    stages = []
    if cat_cols:
        stages += [
            StringIndexer(inputCols=list(cat_cols), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded),
        ]
    if label is not None:
        stages.append(StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=encoded + list(num_cols), outputCol="features"))
    return Pipeline(stages=stages)


def split(
    df: DataFrame, key: str, share: float = 0.7, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test part by a hash of the key: no shuffle, no sort, and a row
    falls on the same side whatever the partitioning or however often it is read."""
    inside = hash_number(seed, key) < F.lit(round(share * 2**32))
    return df.where(inside), df.where(~inside)


def class_weights(df: DataFrame, label: str, out: str = "classWeights") -> DataFrame:
    """Ones get the share of zeros as their weight, zeros get the rest."""
    share = (
        df.where(F.col(label).isNotNull())
        .agg(F.avg(F.when(F.col(label) == 1, 0.0).otherwise(1.0)))
        .scalar()
    )
    return df.withColumn(out, F.when(F.col(label) == 1, share).otherwise(1 - share))


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    k: int = 10,
    repeats: int = 3,
    seed: int = 1,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``fold_1`` to ``fold_<repeats>``: per repeat, k folds of equal class mix.

    Rows of a class are numbered along a seeded hash of their unique key, and the
    number modulo k is the fold. The hash range is cut into buckets, which are
    even however unequal the classes are, and the numbers of rows in the buckets
    before are counted for all repeats in one pass.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = range(1, repeats + 1)
    digest = seeded_hash(F.concat(F.lit(f"{seed}:"), F.col("_repeat").cast("string")), "_key")
    place = F.floor(F.conv(F.substring("_hash", 1, 4), 16, 10).cast("bigint") * n / F.lit(65536)).cast("int")
    # Only key and label are ranked, for all repeats at once; the rows come to it last.
    places = (
        df.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
        .withColumn("_repeat", F.explode(F.array(*[F.lit(r) for r in every])))
        .withColumn("_hash", digest)
        .withColumn("_place", place)
    )
    counts = places.groupBy("_label", "_repeat", "_place").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("_label", "_repeat")
        .orderBy("_place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("_label", "_repeat", "_place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offsets = offsets.select(*[F.col(c).alias(f"{c}_") for c in ("_label", "_repeat", "_place")], "_before")
    same = (
        F.col("_label").eqNullSafe(F.col("_label_"))
        & (F.col("_repeat") == F.col("_repeat_"))
        & (F.col("_place") == F.col("_place_"))
    )
    inside = Window.partitionBy("_label", "_repeat", "_place").orderBy("_hash", "_key")
    number = F.row_number().over(inside) - 1 + F.col("_before")
    folds = (
        places.join(offsets, same)
        .withColumn("_fold", (number % k).cast("int"))
        .groupBy("_key")
        .agg(*[F.max(F.when(F.col("_repeat") == r, F.col("_fold"))).alias(f"fold_{r}") for r in every])
    )
    return df.join(folds, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
