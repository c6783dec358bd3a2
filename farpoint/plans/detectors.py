"""End-to-end detectors: each chains operators from raw rows to a result table.

Training and test rows are DataFrames with the columns a :class:`Layout` names.  The
default numbers are the usual settings for connection records.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.operators import (
    centroid_lof,
    evaluate,
    exact_lof,
    kmeans,
    labelling,
    ocsvm,
    shape,
    threshold,
)
from farpoint.operators.kmeans import Centers, Sweep
from farpoint.plans.features import (
    CONNECTION,
    FeatureChain,
    Layout,
    Library,
    Trainer,
    fit_features,
    from_first_rows,
    library,
)
from farpoint.session import dealt, materialize

CAP = 2e8


@contextmanager
def held(df: DataFrame):
    """Keep rows that a fit reads many times; lost blocks are recomputed."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _fitted(chain: FeatureChain, rows: DataFrame) -> DataFrame:
    """What a trainer keeps of the rows: the key and the features, not the whole record,
    no more in a task than :func:`farpoint.session.dealt` allows."""
    return dealt(chain.transform(rows).select(chain.layout.key, "features"))


# --- clustering and reports --------------------------------------------------


def cluster_rows(rows: DataFrame, layout: Layout = CONNECTION, k: int = 3, trainer: Trainer | None = None) -> DataFrame:
    """Cluster numeric rows; the original record stays beside its cluster."""
    chain = fit_features(rows, layout, one_hot=False)
    with held(chain.transform(rows)) as features:
        centers = (trainer or library(10))(features, k)
    return centers.assign(chain.transform(rows))


def cluster_label_report(
    train: DataFrame, test: DataFrame, layout: Layout = CONNECTION, k: int = 50, trainer: Trainer | None = None
) -> DataFrame:
    """Scaled numeric columns, train statistics for both sides; test rows counted per
    cluster and label, with an aligned text line."""
    chain = fit_features(train, layout, one_hot=False, scaling="train", sumsq_cap=CAP)
    with held(_fitted(chain, train)) as features:
        centers = (trainer or library(10))(features, k)
    counts = kmeans.label_counts(centers.assign(chain.transform(test)), label=layout.label)
    return counts.withColumn("line", shape.report_line(label=layout.label)).orderBy("cluster", layout.label)


def project_all(rows: DataFrame, layout: Layout = CONNECTION) -> DataFrame:
    """All principal components of the numeric columns."""
    return fit_features(rows, layout, one_hot=False, all_components=True).transform(rows)


def distance_features(
    train: DataFrame,
    others: Sequence[DataFrame],
    layout: Layout,
    pca_k: int = 8,
    k: int = 5,
    squared: bool = True,
    centered: bool = False,
    trainer: Trainer | None = None,
) -> list[DataFrame]:
    """log(1+x), components, k centres; every set gets its distances to all centres as
    ``dists``.  The first result belongs to the training rows."""
    chain = fit_features(train, layout, one_hot=False, log=True, pca_k=pca_k, centered=centered)
    with held(_fitted(chain, train)) as features:
        centers = (trainer or library(10))(features, k)
    return [centers.distances(chain.transform(df), squared=squared) for df in (train, *others)]


# --- detectors by majority label ---------------------------------------------


def judge_by_majority(train: DataFrame, test: DataFrame, centers: Centers, layout: Layout) -> DataFrame:
    """Test rows with the class of their cluster and the outcome; rows of a cluster
    without a class come out as ``noclass``."""
    counts = labelling.class_counts(centers.assign(train), centers.k, layout.is_normal())
    judged = labelling.attach_class(centers.assign(test), labelling.majority(counts))
    result = evaluate.outcome(layout.is_normal(), evaluate.judged_by_class(F.col("cluster_class")))
    return judged.withColumn("outcome", result)


def majority_detector(
    train: DataFrame,
    test: DataFrame,
    layout: Layout = CONNECTION,
    pca_k: int | None = 25,
    k: int = 120,
    one_hot: bool = True,
    scaling: str | None = None,
    sumsq_cap: float | None = None,
    unseen: str = "error",
    trainer: Trainer | None = None,
) -> DataFrame:
    """Confusion and rates of the majority-label detector."""
    chain = fit_features(
        train, layout, one_hot=one_hot, scaling=scaling, sumsq_cap=sumsq_cap, pca_k=pca_k, unseen=unseen
    )
    with held(_fitted(chain, train)) as features:
        centers = (trainer or library(10))(features, k)
    judged = judge_by_majority(chain.transform(train), chain.transform(test), centers, layout)
    return evaluate.rates(evaluate.confusion(judged))


def numeric_majority_detector(train: DataFrame, test: DataFrame, layout: Layout = CONNECTION, **options) -> DataFrame:
    """Without categories: 10 components, 120 clusters."""
    return majority_detector(train, test, layout, **{"pca_k": 10, "k": 120, "one_hot": False, **options})


def scaled_majority_detector(train: DataFrame, test: DataFrame, layout: Layout = CONNECTION, **options) -> DataFrame:
    """Numeric columns scaled with the magnitude guard: 5 components, 150 clusters."""
    defaults = {"pca_k": 5, "k": 150, "one_hot": False, "scaling": "train", "sumsq_cap": CAP}
    return majority_detector(train, test, layout, **{**defaults, **options})


def two_level_detector(
    train: DataFrame,
    test: DataFrame,
    layout: Layout = CONNECTION,
    pca_k: int | None = 20,
    k: int = 80,
    sub_k: int = 2,
    iterations: int = 10,
    low: float = 0.2,
    high: float = 0.8,
    force: Sequence[int] = (),
    unseen: str = "error",
    trainer: Trainer | None = None,
) -> DataFrame:
    """Impure clusters are clustered again; confusion and rates on the test rows."""
    chain = fit_features(train, layout, pca_k=pca_k, unseen=unseen)
    with held(chain.transform(train)) as features:
        centers = (trainer or library(iterations))(features, k)
        model, top = fit_two_level(features, centers, layout, sub_k, iterations, low, high, force)
    assigned_train = model.assign(chain.transform(train))
    sub = labelling.sub_classes(assigned_train, layout.is_normal())
    judged = labelling.attach_two_level_class(model.assign(chain.transform(test)), top, sub)
    result = evaluate.outcome(layout.is_normal(), evaluate.judged_by_class(F.col("cluster_class")))
    return evaluate.rates(evaluate.confusion(judged.withColumn("outcome", result)))


def fit_two_level(
    features: DataFrame,
    centers: Centers,
    layout: Layout,
    sub_k: int = 2,
    iterations: int = 10,
    low: float = 0.2,
    high: float = 0.8,
    force: Sequence[int] = (),
) -> tuple[labelling.TwoLevel, DataFrame]:
    """Second-level centres of the impure clusters, and the first level's classes."""
    assigned = centers.assign(features)
    counts = labelling.class_counts(assigned, centers.k, layout.is_normal())
    parents = [r.cluster for r in labelling.impure(counts, low, high, force).collect()]
    sub = labelling.train_sub(assigned, parents, sub_k, iterations, [layout.key])
    return labelling.TwoLevel(centers, sub), labelling.majority(counts)


# --- detectors by distance ---------------------------------------------------


def distance_detector(
    normal_train: DataFrame,
    test: DataFrame,
    layout: Layout = CONNECTION,
    dictionary_from: DataFrame | None = None,
    epsilon: float = 70000.0,
    pca_k: int | None = 10,
    k: int = 150,
    one_hot: bool = False,
    scaling: str | None = "train",
    sumsq_cap: float | None = CAP,
    unseen: str = "error",
    trainer: Trainer | None = None,
) -> DataFrame:
    """Trained on normal rows only: far from the nearest centre means attack."""
    chain, centers = fit_normal_model(
        normal_train, layout, dictionary_from, pca_k, k, one_hot, scaling, sumsq_cap, unseen, trainer
    )
    assigned = centers.assign(chain.transform(test))
    result = evaluate.outcome(layout.is_normal(), F.col("sq_distance") < epsilon)
    return evaluate.rates(evaluate.confusion(assigned.withColumn("outcome", result)))


def fit_normal_model(
    normal_train, layout, dictionary_from, pca_k, k, one_hot, scaling, sumsq_cap, unseen, trainer
) -> tuple[FeatureChain, Centers]:
    chain = fit_features(
        normal_train,
        layout,
        dictionary_from,
        one_hot=one_hot,
        scaling=scaling,
        sumsq_cap=sumsq_cap,
        pca_k=pca_k,
        unseen=unseen,
    )
    with held(_fitted(chain, normal_train)) as features:
        return chain, (trainer or library(10))(features, k)


def encoded_distance_detector(
    normal_train: DataFrame, test: DataFrame, everything: DataFrame, layout: Layout = CONNECTION, **options
) -> DataFrame:
    """One-hot rows, dictionary from the full file: 10 components, 120 clusters."""
    defaults = {
        "epsilon": 0.00075,
        "k": 120,
        "one_hot": True,
        "scaling": None,
        "sumsq_cap": None,
        "trainer": library(20, runs=10, tol=1e-6),
    }
    return distance_detector(normal_train, test, layout, everything, **{**defaults, **options})


def own_scaled_distance_detector(
    normal_train: DataFrame, test: DataFrame, everything: DataFrame, layout: Layout = CONNECTION, **options
) -> tuple[DataFrame, float]:
    """As above, each side scaled by its own statistics; also gives the training cost."""
    defaults = {"pca_k": 10, "k": 150, "one_hot": True, "scaling": "own", "sumsq_cap": None, "unseen": "error"}
    epsilon = options.pop("epsilon", 0.00075)
    trainer = options.pop("trainer", library(20, runs=10, tol=1e-6))
    chain, centers = fit_normal_model(
        normal_train, layout, everything, trainer=trainer, **{**defaults, **options}
    )
    cost = kmeans.within_cost(centers.assign(chain.transform(normal_train))).first().wssse
    assigned = centers.assign(chain.transform(test))
    result = evaluate.outcome(layout.is_normal(), F.col("sq_distance") < epsilon)
    return evaluate.rates(evaluate.confusion(assigned.withColumn("outcome", result))), cost


def cascade_detector(
    train: DataFrame,
    normal_train: DataFrame,
    test: DataFrame,
    layout: Layout = CONNECTION,
    epsilon: float = 75000.0,
    pca_k: int | None = 30,
    normal_k: int = 100,
    mixed_k: int = 80,
    one_hot: bool = True,
    unseen: str = "error",
    normal_trainer: Trainer | None = None,
    mixed_trainer: Trainer | None = None,
) -> DataFrame:
    """Far from every normal-only centre: attack; otherwise the class of the cluster in a
    second model over all training rows."""
    options = {"one_hot": one_hot, "pca_k": pca_k, "unseen": unseen}
    normal_chain = fit_features(normal_train, layout, train, **options)
    mixed_chain = fit_features(train, layout, **options)
    with held(normal_chain.transform(normal_train)) as features:
        normal_centers = (normal_trainer or library(20, runs=10, tol=1e-6))(features, normal_k)
    with held(mixed_chain.transform(train)) as features:
        mixed_centers = (mixed_trainer or library(10))(features, mixed_k)
    counts = labelling.class_counts(
        mixed_centers.assign(mixed_chain.transform(train)), mixed_centers.k, layout.is_normal()
    )
    first = normal_centers.assign(normal_chain.transform(test), cluster="normal_cluster", distance="normal_distance")
    both = mixed_centers.assign(mixed_chain.transform(first))
    judged = labelling.attach_class(both, labelling.majority(counts))
    name = threshold.cascade(F.col("normal_distance"), epsilon, F.col("cluster_class"))
    result = evaluate.outcome(layout.is_normal(), evaluate.judged_by_class(name))
    return evaluate.rates(evaluate.confusion(judged.withColumn("outcome", result)))


# --- detectors by density ----------------------------------------------------


def outlier_degree_detector(
    normal_train: DataFrame,
    test: DataFrame,
    everything: DataFrame,
    layout: Layout = CONNECTION,
    pca_k: int | None = 20,
    k: int = 100,
    percent: float = 2.0,
    unseen: str = "error",
    trainer: Trainer | None = None,
) -> DataFrame:
    """Inverse total distance to the centres; under the training rows' 2 % mark is an
    outlier.  Gives the test rows with score and outcome."""
    chain = fit_features(normal_train, layout, everything, pca_k=pca_k, unseen=unseen)
    with held(chain.transform(normal_train)) as features:
        centers = (trainer or library(20, runs=10, tol=1e-6))(features, k)
        degrees = features.select(threshold.outlier_degree(F.col("features"), centers.matrix).alias("degree"))
        cut = threshold.percent_position(degrees, "degree", percent)
    scored = chain.transform(test).withColumn("degree", threshold.outlier_degree(F.col("features"), centers.matrix))
    judged = evaluate.judged_by_score(-F.col("degree"), -cut)
    return scored.withColumn("outcome", evaluate.outcome(layout.is_normal(), judged))


def lof_detector(
    normal_train: DataFrame,
    test: DataFrame,
    everything: DataFrame,
    layout: Layout = CONNECTION,
    pca_k: int | None = 20,
    k: int = 100,
    min_pts: int = 5,
    percent: float = 98.0,
    weighted: bool = True,
    fixed_threshold: float | None = None,
    unseen: str = "error",
    trainer: Trainer | None = None,
) -> DataFrame:
    """Factor against the centres, weighted by cluster size or not; the threshold is the
    training rows' 98 % mark or a fixed number.  Gives the test rows."""
    chain = fit_features(normal_train, layout, everything, pca_k=pca_k, unseen=unseen)
    with held(chain.transform(normal_train)) as features:
        model, cut = _fit_lof(features, k, min_pts, percent, weighted, trainer, fixed_threshold)
    scored = model.score(chain.transform(test))
    judged = evaluate.judged_by_score(F.col("lof"), cut)
    return scored.withColumn("outcome", evaluate.outcome(layout.is_normal(), judged))


def _fit_lof(features, k, min_pts, percent, weighted, trainer, fixed=None, ascending=True):
    centers = (trainer or library(20, runs=10, tol=1e-6))(features, k)
    sizes = None
    if weighted:
        sizes = centroid_lof.sizes_vector(kmeans.cluster_sizes(centers.assign(features)), centers.k)
    model = centroid_lof.fit(centers.matrix, min_pts, sizes)
    if fixed is not None:
        return model, fixed
    return model, threshold.percent_position(model.score(features), "lof", percent, ascending)


def two_stage_lof_detector(
    first_half: DataFrame,
    second_half: DataFrame,
    test: DataFrame,
    everything: DataFrame,
    layout: Layout = CONNECTION,
    pca_k: int | None = 20,
    k: int = 100,
    min_pts: int = 5,
    percent: float = 2.0,
    keep: str = "inliers",
    unseen: str = "error",
    trainer: Trainer | None = None,
) -> DataFrame:
    """Stage 1 on the first half filters the second; stage 2 is trained on what is left
    and judges the test rows with its own centres and threshold.

    ``percent`` counts from the largest factor down.  ``keep`` may be ``outliers``.
    """
    chain = fit_features(first_half, layout, everything, pca_k=pca_k, unseen=unseen)
    with held(chain.transform(first_half)) as features:
        model, cut = _fit_lof(features, k, min_pts, percent, True, trainer, ascending=False)
    scored = model.score(chain.transform(second_half))
    kept = scored.filter(F.col("lof") < cut if keep == "inliers" else F.col("lof") > cut)
    with held(kept.select(layout.key, "features")) as survivors:
        model, cut = _fit_lof(survivors, k, min_pts, percent, True, trainer, ascending=False)
    result = model.score(chain.transform(test))
    judged = evaluate.judged_by_score(F.col("lof"), cut)
    return result.withColumn("outcome", evaluate.outcome(layout.is_normal(), judged))


def exact_lof_report(
    train: DataFrame,
    test: DataFrame,
    min_pts: int = 5,
    rule: str = "distinct",
    percent: float = 2.0,
    key: str = "id",
) -> DataFrame:
    """Test rows by falling factor against all training rows, flagged over the 2 % mark.

    ``rule`` is ``distinct`` (all rows at the k smallest distances) or ``heap``."""
    model = exact_lof.fit(train, min_pts, rule, key)
    return exact_lof.report(model.score(test), model.train_scores, key, percent)


# --- one-class SVM -----------------------------------------------------------


def two_model_svm(
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    layout: Layout,
    pca_k: int = 8,
    k: int = 5,
    nu: float = 0.1,
    trainer: Trainer | None = None,
    **svm,
) -> DataFrame:
    """A first model on distances to centres cleans the validation rows; a second one on
    their components judges the test rows.  Gives the test rows with outcome."""
    chain = fit_features(train, layout, one_hot=False, log=True, pca_k=pca_k, centered=True)
    with held(_fitted(chain, train)) as features:
        centers = (trainer or library(10))(features, k)
        by_distance = centers.distances(features, squared=False)
        first = ocsvm.train(by_distance, nu, features="dists", **svm)
    candidates = centers.distances(chain.transform(validation), squared=False)
    accepted = first.score(candidates, "dists").filter(F.col("accepted") & layout.is_normal())
    second = ocsvm.train(accepted, nu, **svm)
    judged = second.score(chain.transform(test))
    return judged.withColumn("outcome", evaluate.outcome(layout.is_normal(), F.col("accepted")))


# --- choosing k --------------------------------------------------------------


def sweep_distance(
    rows: DataFrame,
    ks: Iterable[int],
    layout: Layout = CONNECTION,
    one_hot: bool = False,
    scaling: str | None = None,
    sample_sd: bool = False,
    trainer: Trainer | None = None,
) -> Sweep:
    """Mean distance to the own centre for every k."""
    chain = fit_features(rows, layout, one_hot=one_hot, scaling=scaling, sample_sd=sample_sd)
    features = _sweep_rows(chain, rows)
    return _sweep(features, ks, trainer or library(20), kmeans.mean_distance, kmeans.mean_distances)


def _sweep_rows(chain: FeatureChain, rows: DataFrame) -> DataFrame:
    """Stored once: key and label, where there are such columns, and features."""
    kept = [c for c in (chain.layout.key, chain.layout.label) if c in rows.columns]
    return materialize(chain.transform(rows).select(*kept, "features"), "sweep")


def _sweep(features: DataFrame, ks: Iterable[int], trainer: Trainer, score, scores) -> Sweep:
    """All k in the same scans where the trainer can, else one after the other."""
    if not isinstance(trainer, Library):
        return kmeans.sweep(features, ks, trainer, score)
    ks = list(ks)
    models = trainer.sweep(features, ks)
    return Sweep(models, scores(features, [models[k] for k in ks]).select("k", "score"), features)


def sweep_entropy(rows: DataFrame, ks: Iterable[int], layout: Layout = CONNECTION, trainer: Trainer | None = None) -> Sweep:
    """Size-weighted label entropy for every k, on scaled one-hot rows."""
    chain = fit_features(rows, layout, scaling="train")
    features = _sweep_rows(chain, rows)
    return _sweep(
        features,
        ks,
        trainer or library(20, runs=10, tol=1e-6),
        lambda assigned: kmeans.mean_entropy(assigned, label=layout.label),
        lambda rows, models: kmeans.mean_entropies(rows, models, layout.label),
    )


def best_k_sample(
    rows: DataFrame,
    layout: Layout = CONNECTION,
    ks: Iterable[int] = range(10, 41, 10),
    fraction: float = 0.05,
    seed: int = 1,
    trainer: Trainer | None = None,
) -> DataFrame:
    """Sweep with random starts, then a sample of the best model's assignments as lines."""
    found = sweep_distance(
        rows,
        ks,
        layout,
        scaling="train",
        sample_sd=True,
        trainer=trainer or library(10, runs=5, init="random"),
    )
    assigned = found.best().assign(found.rows)
    line = F.concat_ws(",", F.col("cluster").cast("string"), F.col("features").cast("array<string>"))
    return kmeans.random_sample(assigned, fraction, seed).select(line.alias("value"))


def top_anomalies(
    rows: DataFrame,
    layout: Layout = CONNECTION,
    k: int = 150,
    n: int = 100,
    limit: int = 10,
    trainer: Trainer | None = None,
) -> DataFrame:
    """Original rows further from their centre than the n-th largest distance."""
    chain = fit_features(rows, layout, scaling="train")
    with held(chain.transform(rows)) as features:
        centers = (trainer or library(20, runs=10, tol=1e-6))(features, k)
        assigned = centers.assign(features).withColumn("distance", F.sqrt("sq_distance"))
        cut = threshold.nth_largest(assigned, "distance", n)
    scored = centers.assign(chain.transform(rows)).withColumn("distance", F.sqrt("sq_distance"))
    return threshold.top_rows(scored, threshold.above(F.col("distance"), cut), "distance", [layout.key], limit)


def threshold_sweep(
    normal_train: DataFrame,
    test: DataFrame,
    layout: Layout = CONNECTION,
    epsilons: Sequence[float] = (70000.0, 200000.0, 3000000.0, 7000000.0),
    pca_ks: Sequence[int] = (2, 4, 6, 8, 10, 20),
    ks: Sequence[int] = (2, 5, 10, 20, 50, 80, 100, 150),
    one_hot: bool = False,
    scaling: str | None = None,
    trainer: Trainer | None = None,
) -> DataFrame:
    """``(pca, k, epsilon, tp .. accuracy)`` for the whole grid.

    A model is fitted once per (pca, k) and the components once per pca; all k and all
    thresholds of a pca are counted in one pass over the test rows.
    """
    trainer = trainer or library(10)
    tables = []
    for components in pca_ks:
        chain = fit_features(normal_train, layout, one_hot=one_hot, scaling=scaling, pca_k=components)
        with held(chain.transform(normal_train)) as features:
            models = {k: trainer(features, k).matrix for k in ks}
        grid = evaluate.model_grid(chain.transform(test), models, layout.is_normal(), epsilons)
        tables.append(grid.select(F.lit(components).alias("pca"), "*"))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionAll(table)
    return result
