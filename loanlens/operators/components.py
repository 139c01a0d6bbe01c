"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import PCA, PCAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.prep import assemble, fit_zscore, vector_columns, zscore
from loanlens.operators.windows import running_totals
from loanlens.session import small_frame


class Components(NamedTuple):
    """Fitted components and the mean and deviation of each column they were fitted with."""

    model: PCAModel
    moments: dict[str, tuple[float | None, float | None]]


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 7) -> Components:
    """Components of the z-scored columns. The driver sees the covariance matrix,
    whose size is fixed by the number of columns."""
    normal, moments = [f"norm_{name}" for name in cols], fit_zscore(df, cols)
    vectors = assemble(zscore(df, cols, moments=moments), normal).select("features")
    return Components(PCA(k=k, inputCol="features", outputCol="components").fit(vectors), moments)


def pca(df: DataFrame, cols: Sequence[str], k: int = 7, fitted: Components | None = None) -> DataFrame:
    """Add ``principal_component_1`` to ``_k``; all other columns, the label and key
    among them, stay beside them, so no join by position is needed.

    Components fitted before scale the columns by the moments of their own fit. A component's sign is free; it is set so that its largest loading is positive.
    """
    model, moments = fitted or fit_pca(df, cols, k)
    normal = [f"norm_{name}" for name in cols]
    vectors = assemble(zscore(df, cols, moments=moments), normal)
    loadings = model.pc.toArray()
    signs = [1.0 if max(column, key=abs) > 0 else -1.0 for column in loadings.T.tolist()]
    names = [f"principal_component_{i + 1}" for i in range(k)]
    spread = vector_columns(model.transform(vectors), "components", names)
    turned = {name: F.col(name) * F.lit(sign) for name, sign in zip(names, signs)}
    return spread.withColumns(turned).drop("features", "components", *normal)


def explained_variance(fitted: Components, df: DataFrame) -> DataFrame:
    """Share of variance per component and its running sum."""
    rows = [(i + 1, float(v)) for i, v in enumerate(fitted.model.explainedVariance.toArray())]
    shares = small_frame(df.sparkSession, rows, "component int, explained_variance double")
    return running_totals(shares, "component", ["explained_variance"]).withColumnRenamed(
        "running_explained_variance", "cumulative"
    )
