"""Preparation fitted on training rows: imputation, scaling, assembly, PCA.

Fitted values are written into a SQL statement, so a prepared pipeline is saved and loaded with the
standard persistence and needs no Python on the row path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gradewell.functions.features import burden_features
from gradewell.operators.profile import column_profile, exact_quantiles, fill_medians, medians, quantiles_without


@dataclass(frozen=True)
class Preparation:
    """Per feature: the fill value, the centre and the scale."""

    features: tuple[str, ...]
    fill: dict[str, float]
    centre: dict[str, float]
    scale: dict[str, float]

    def only(self, features: Sequence[str]) -> Preparation:
        """The same for some of the features."""
        return Preparation(tuple(features), *[{f: part[f] for f in features} for part in (self.fill, self.centre, self.scale)])

    def stage(self, output: str = "features") -> list[Transformer]:
        """Stages that add the assembled vector; cells that are missing or not finite take the fill value."""
        prepared = [f"_{f}" for f in self.features]
        columns = []
        for f, p in zip(self.features, prepared):
            clean = f"CASE WHEN isnan(`{f}`) OR abs(`{f}`) = double('infinity') THEN NULL ELSE double(`{f}`) END"
            columns.append(f"(coalesce({clean}, {self.fill[f]!r}D) - {self.centre[f]!r}D) / {self.scale[f]!r}D AS `{p}`")
        return [
            SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"),
            VectorAssembler(inputCols=prepared, outputCol=output),
            SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{p}`" for p in prepared) + ") FROM __THIS__"),
        ]


def fit_preparation(train: DataFrame, features: Sequence[str], scaler: str = "standard") -> Preparation:
    """Exact medians; then mean and population deviation ("standard"), median and interquartile range
    ("robust") of the filled columns, or no scaling ("none"). A scale of 0 becomes 1."""
    features = list(features)
    fitted = medians(train, features)
    fill = {r["feature"]: float(r["median"]) for r in fitted.collect()}
    centre, scale = dict.fromkeys(features, 0.0), dict.fromkeys(features, 1.0)
    if scaler == "standard":
        filled = fill_medians(train, features, fitted)
        for r in column_profile(filled, features).collect():
            centre[r["feature"]], scale[r["feature"]] = r["mean"], (r["var_pop"] or 0.0) ** 0.5 or 1.0
    elif scaler == "robust":
        filled = fill_medians(train, features, fitted)
        found = {(r["feature"], r["q"]): r["value"] for r in exact_quantiles(filled, features, [0.25, 0.5, 0.75]).collect()}
        for f in features:
            centre[f], scale[f] = found[(f, 0.5)], (found[(f, 0.75)] - found[(f, 0.25)]) or 1.0
    elif scaler != "none":
        raise ValueError(f"unknown scaler {scaler}")
    return Preparation(tuple(features), fill, centre, scale)


def fit_preparations(df: DataFrame, features: Sequence[str], scalers: Sequence[str], part: str, parts: Sequence, left_out: Sequence) -> dict[tuple, Preparation]:
    """:func:`fit_preparation` on the rows outside each part ``left_out`` (None: on all), by (scaler, part left out).

    Medians, moments and quantiles of all these tables come from the same counts per part: ``df`` is read as often as for one of them.
    """
    features = list(features)
    found = quantiles_without(df, features, [0.5], part, parts, left_out)
    fill = {(g, f): found[(g, f, 0.5)] or 0.0 for g in left_out for f in features}
    profile = {(r[part], r["feature"]): r for r in column_profile(df.filter(F.col(part).isin(*parts)), features, [part]).collect()}
    rest = {(g, f): [profile[(p, f)] for p in parts if p != g and (p, f) in profile] for g in left_out for f in features}
    missing = {at: sum(r["n_rows"] - r["n"] for r in rows) for at, rows in rest.items()}
    fitted = {}
    for scaler in scalers:
        if scaler not in ("standard", "robust", "none"):
            raise ValueError(f"unknown scaler {scaler}")
        if scaler == "robust":
            quantiles = quantiles_without(df, features, [0.25, 0.5, 0.75], part, parts, left_out, {at: (fill[at], n) for at, n in missing.items()})
        for g in left_out:
            centre, scale = dict.fromkeys(features, 0.0), dict.fromkeys(features, 1.0)
            for f in features if scaler != "none" else ():
                if scaler == "standard":
                    centre[f], variance = merged_moments(rest[(g, f)], fill[(g, f)], missing[(g, f)])
                    scale[f] = variance ** 0.5 or 1.0
                else:
                    low, centre[f], high = (quantiles[(g, f, q)] for q in (0.25, 0.5, 0.75))
                    scale[f] = (high - low) or 1.0
            fitted[(scaler, g)] = Preparation(tuple(features), {f: fill[(g, f)] for f in features}, centre, scale)
    return fitted


def merged_moments(profiles: Sequence[Mapping], fill: float, missing: int) -> tuple[float, float]:
    """Mean and population variance of a column whose parts have these profiles and ``missing`` cells the value ``fill``."""
    sets = [(r["n"], r["mean"], r["var_pop"], r["minimum"], r["maximum"]) for r in profiles if r["n"]] + ([(missing, fill, 0.0, fill, fill)] if missing else [])
    low, high = min(s[3] for s in sets), max(s[4] for s in sets)
    if low == high:  # rounding must not give a constant column a spread
        return low, 0.0
    n = sum(s[0] for s in sets)
    mean = sum(s[0] * s[1] for s in sets) / n
    return mean, sum(s[0] * (s[2] + (s[1] - mean) ** 2) for s in sets) / n


class BurdenFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the ten burden features as columns."""

    prefix = Param(Params._dummy(), "prefix", "prefix of the added columns", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, prefix: str = "burden_"):
        super().__init__()
        self._setDefault(prefix="burden_")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prefix = self.getOrDefault(self.prefix)
        return dataset.select("*", *[c.alias(prefix + n) for n, c in burden_features(dataset).items()])


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose inner products approximate a Gaussian kernel exp(-gamma |x-y|^2).

    With a linear classifier on top they take the place of kernel machines that cannot be distributed.
    """

    components = Param(Params._dummy(), "components", "number of random features", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0 means 1 / number of inputs", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "kernel_features", components: int = 128,
                 gamma: float = 0.0, seed: int = 42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", components=128, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count, gamma, seed = self.getOrDefault(self.components), self.getOrDefault(self.gamma), self.getSeed()

        @F.pandas_udf(ArrayType(DoubleType()))
        def project(values: pd.Series) -> pd.Series:
            if len(values) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(values.to_numpy())
            rng = np.random.default_rng(seed)  # the same directions in every task
            width = gamma if gamma > 0 else 1.0 / x.shape[1]
            directions = rng.normal(scale=np.sqrt(2 * width), size=(x.shape[1], count))
            offsets = rng.uniform(0, 2 * np.pi, size=count)
            return pd.Series(list(np.sqrt(2.0 / count) * np.cos(x @ directions + offsets)))

        projected = project(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(projected))


def gaussian_kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x-y|^2) for all rows of ``x`` and ``y``."""
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    squares -= 2 * x @ y.T
    np.maximum(squares, 0.0, out=squares)
    squares *= -gamma
    return np.exp(squares, out=squares)


class _KernelParams(HasInputCol, HasOutputCol):
    landmarks = Param(Params._dummy(), "landmarks", "number of rows that stand for all in the kernel", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0 means 1 / number of inputs", typeConverter=TypeConverters.toFloat)

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self._setDefault(inputCol="features", outputCol="kernel_features", landmarks=256, gamma=0.0)


class LandmarkKernelModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds features whose inner products are the kernel seen through the landmarks (Nyström).

    With L the landmarks and K = U diag(e) U' their kernel matrix, a row x becomes k(x, L) U diag(e)^(-1/2).
    """

    rows = Param(Params._dummy(), "rows", "landmark rows, one after another", typeConverter=TypeConverters.toListFloat)
    projection = Param(Params._dummy(), "projection", "matrix from kernel values to features, row by row", typeConverter=TypeConverters.toListFloat)
    count = Param(Params._dummy(), "count", "number of landmarks found", typeConverter=TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count, gamma = self.getOrDefault(self.count), self.getOrDefault(self.gamma)
        shared = dataset.sparkSession.sparkContext.broadcast((  # landmarks x (inputs + landmarks) numbers at most
            np.array(self.getOrDefault(self.rows)).reshape(count, -1), np.array(self.getOrDefault(self.projection)).reshape(count, -1)))

        @F.pandas_udf(ArrayType(DoubleType()))
        def lift(values: pd.Series) -> pd.Series:
            if len(values) == 0:
                return pd.Series([], dtype=object)
            landmarks, projection = shared.value
            return pd.Series(list(gaussian_kernel(np.stack(values.to_numpy()), landmarks, gamma) @ projection))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(F.col(self.getInputCol())))))


class LandmarkKernel(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`LandmarkKernelModel`: a Gaussian kernel exp(-gamma |x-y|^2) as features of a linear model.

    The landmarks are the distinct input vectors with the smallest hashes, so they depend neither on partitions nor on how often a
    vector occurs. Only they come to the driver, where their kernel matrix is factored once. With as many landmarks as distinct
    rows the kernel is exact.
    """

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "kernel_features", landmarks: int = 256, gamma: float = 0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LandmarkKernelModel:
        wanted = self.getOrDefault(self.landmarks)
        hashed = dataset.select(vector_to_array(F.col(self.getInputCol())).alias("x")).select("x", F.xxhash64("x").alias("h"))
        distinct = hashed.agg(F.approx_count_distinct("h")).first()[0]
        # Four times as many as asked for are left on average, so that few vectors are grouped.
        below = int(min(1.0, 4 * wanted / max(distinct, 1)) * float(2 ** 63 - 1024)) * 2 - 2 ** 63
        near = hashed.filter(F.col("h") <= below) if 4 * wanted < distinct else hashed
        found = near.groupBy("h").agg(F.first("x").alias("x")).orderBy("h").limit(wanted).collect()
        if not found:
            raise ValueError("no rows to take landmarks from")
        rows = np.array([r["x"] for r in found])
        gamma = self.getOrDefault(self.gamma) or 1.0 / rows.shape[1]
        values, vectors = np.linalg.eigh(gaussian_kernel(rows, rows, gamma))
        kept = values > values[-1] * 1e-10
        model = LandmarkKernelModel()
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), landmarks=wanted, gamma=gamma, count=len(rows),
                   rows=rows.ravel().tolist(), projection=(vectors[:, kept] / np.sqrt(values[kept])).ravel().tolist())
        return model


def fit_pca(train: DataFrame, input_col: str, k: int, output_col: str = "components"):
    """PCA fitted on training rows; returns the model and the explained share per component."""
    model = PCA(k=k, inputCol=input_col, outputCol=output_col).fit(train)
    return model, [float(v) for v in model.explainedVariance]


def embedding_vectors(df: DataFrame, column: str, output: str = "vector") -> DataFrame:
    """Arrays of floats as vectors."""
    return df.withColumn(output, array_to_vector(F.col(column).cast("array<double>")))
