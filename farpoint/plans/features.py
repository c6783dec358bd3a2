"""One fitted chain from raw columns to features, used for training and scoring alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.operators import encode, kmeans, pca, scale
from farpoint.operators.kmeans import Centers
from farpoint.sources import records

Trainer = Callable[[DataFrame, int], Centers]


@dataclass(frozen=True)
class Layout:
    """Which columns hold what."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    label: str = "label"
    key: str = "id"
    normal: str = "normal."

    def is_normal(self) -> Column:
        return F.col(self.label) == self.normal


CONNECTION = Layout(records.NUMERIC, records.CATEGORICAL)


@dataclass(frozen=True)
class FeatureChain:
    """Fitted steps; ``scale_own`` refits the scaler on whatever rows come in."""

    layout: Layout
    one_hot: encode.OneHot | None
    log: bool
    scaling: str | None
    scaler: scale.VectorScaler | None
    components: pca.Components | None
    unseen: str
    cap: float | None

    def encoded(self, df: DataFrame) -> DataFrame:
        out = encode.encode(df, self.layout.numeric, self.one_hot, self.unseen)
        return scale.log1p_features(out) if self.log else out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``; every raw column stays in the row."""
        out = self.encoded(df)
        scaler, components = self.scaler, self.components
        if self.scaling == "own":
            scaler = scale.fit_vectors(out, sumsq_cap=self.cap)
        if scaler and components:
            return components.after(scaler.mean, scaler.divisor).project(out)
        if scaler:
            return scaler.transform(out)
        return components.project(out) if components else out


def fit_features(
    train: DataFrame,
    layout: Layout,
    dictionary_from: DataFrame | None = None,
    one_hot: bool = True,
    log: bool = False,
    scaling: str | None = None,
    sumsq_cap: float | None = None,
    sample_sd: bool = False,
    pca_k: int | None = None,
    all_components: bool = False,
    centered: bool = False,
    unseen: str = "error",
) -> FeatureChain:
    """Fit dictionary, scaler and components in that order.

    ``scaling`` is None, ``train`` (statistics of the training rows, for all rows) or
    ``own`` (statistics of the rows being transformed).
    """
    model = None
    if one_hot and layout.categorical:
        source = train if dictionary_from is None else dictionary_from
        model = encode.fit_one_hot(source, layout.categorical)
    chain = FeatureChain(layout, model, log, scaling, None, None, unseen, sumsq_cap)
    rows = chain.encoded(train)
    scaler = None
    if scaling:
        scaler = scale.fit_vectors(rows, sumsq_cap=sumsq_cap, sample=sample_sd)
        rows = scaler.transform(rows)
    components = None
    if pca_k or all_components:
        components = pca.fit_components(rows, None if all_components else pca_k, centered=centered)
    return FeatureChain(layout, model, log, scaling, scaler, components, unseen, sumsq_cap)


@dataclass(frozen=True)
class Library:
    """Spark ML training of one model; restarts and sweeps take the same method, all in the same scans of packed rows.

    Their draws go by ``key``, or by the features of rows that have none.
    """

    iterations: int = 10
    runs: int = 1
    tol: float = 1e-4
    init: str = "k-means||"
    seed: int = 1
    key: tuple[str, ...] = ("id",)

    def __call__(self, df: DataFrame, k: int) -> Centers:
        if self.runs > 1:
            return self.sweep(df, [k])[k]
        return kmeans.train(df, k, self.iterations, tol=self.tol, init=self.init, seed=self.seed)

    def sweep(self, df: DataFrame, ks: Sequence[int]) -> dict[int, Centers]:
        """For every k the best of ``runs`` models, by training cost."""
        wanted = [k for k in ks for _ in range(self.runs)]
        key = self.key if set(self.key) <= set(df.columns) else ("features",)
        found = kmeans.train_packed(df, wanted, key, self.iterations, self.init, self.seed, tol=self.tol)
        return {k: kmeans.best_of(found[i * self.runs : (i + 1) * self.runs]) for i, k in enumerate(ks)}


def library(iterations: int = 10, runs: int = 1, tol: float = 1e-4, init: str = "k-means||", seed: int = 1) -> Library:
    """Library training, best of ``runs`` seeds."""
    return Library(iterations, runs, tol, init, seed)


def from_first_rows(iterations: int = 10, order: Sequence[str] = ("id",), tol: float = 0.0) -> Trainer:
    """Lloyd from the first k rows in key order: the same centres on every run."""
    return lambda df, k: kmeans.lloyd(df, kmeans.first_rows(df, k, order), iterations, tol=tol)
