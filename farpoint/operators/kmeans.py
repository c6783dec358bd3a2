"""k-means: training, assignment, quality scores, sweeps over k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.functions import vectors


@dataclass(frozen=True)
class Centers:
    """k centres as a k x d matrix; a row's cluster is its index."""

    matrix: np.ndarray
    cost: float | None = None

    @property
    def k(self) -> int:
        return len(self.matrix)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(cluster, center)``."""
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(self.matrix)]
        return spark.createDataFrame(rows, "cluster int, center array<double>")

    def assign(
        self, df: DataFrame, features: str = "features", cluster: str = "cluster", distance: str = "sq_distance"
    ) -> DataFrame:
        """Add the nearest centre's index and the squared distance to it."""
        found = df.withColumn("_nearest", vectors.nearest_center(F.col(features), self.matrix))
        return found.withColumns({cluster: F.col("_nearest.cluster"), distance: F.col("_nearest.sq_distance")}).drop(
            "_nearest"
        )

    def distances(
        self, df: DataFrame, features: str = "features", output: str = "dists", squared: bool = True
    ) -> DataFrame:
        """Add the array of distances to all centres."""
        return df.withColumn(output, vectors.center_distances(F.col(features), self.matrix, squared))


def centers_from_table(table: DataFrame) -> Centers:
    rows = table.select("cluster", "center").orderBy("cluster").collect()
    return Centers(np.array([r.center for r in rows], dtype=float))


# --- training ----------------------------------------------------------------


def first_rows(df: DataFrame, k: int, order: Sequence[str], features: str = "features") -> np.ndarray:
    """Seeds: the first k rows in key order."""
    rows = df.select(*order, features).orderBy(*order).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} seeds wanted, {len(rows)} rows found")
    return np.array([r[features] for r in rows], dtype=float)


def lloyd(
    df: DataFrame, seeds: np.ndarray, iterations: int, features: str = "features", tol: float = 0.0
) -> Centers:
    """Plain Lloyd iterations from given seeds, the same result for any partitioning.

    Every task adds up its rows per cluster and hands on at most k partial sums, so a
    round shuffles k rows per task whatever the row count.  An empty cluster keeps its
    centre.  Stops early once no centre moves further than ``tol``.
    """
    centers, cost = np.asarray(seeds, dtype=float), None
    rows = df.select(features)
    for _ in range(iterations):
        sums = cluster_sums(rows, centers).collect()
        moved = centers.copy()
        for row in sums:
            moved[row.cluster] = np.asarray(row.total) / row.n
        cost = float(sum(row.cost for row in sums))
        shift = ((moved - centers) ** 2).sum(axis=1).max()
        centers = moved
        if shift <= tol * tol:
            break
    return Centers(centers, cost)


def cluster_sums(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(cluster, n, total, cost)``: size, vector sum, sum of squared distances."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centers.shape
        n, total, cost = np.zeros(k), np.zeros((k, d)), np.zeros(k)
        for batch in batches:
            x = vectors.to_matrix(batch.column(0), d)
            index, distance = vectors.nearest(x, centers)
            n += np.bincount(index, minlength=k)
            cost += np.bincount(index, weights=distance, minlength=k)
            for j in range(d):
                total[:, j] += np.bincount(index, weights=x[:, j], minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array(n[used].astype(np.int64)),
                vectors.to_lists(total[used]) if len(used) else pa.array([], pa.list_(pa.float64())),
                pa.array(cost[used]),
            ],
            names=["cluster", "n", "total", "cost"],
        )

    parts = rows.mapInArrow(partial, "cluster int, n long, total array<double>, cost double")
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), sum_arrays(F.col("total")).alias("total"), F.sum("cost").alias("cost")
    )


def sum_arrays(column: Column) -> Column:
    """Element-wise sum of an array column: one aggregate buffer whatever the width."""
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def train(
    df: DataFrame,
    k: int,
    iterations: int = 20,
    features: str = "features",
    runs: int = 1,
    tol: float = 1e-4,
    init: str = "k-means||",
    seed: int = 1,
) -> Centers:
    """Spark ML k-means, best of ``runs`` seeds by training cost."""
    vector = df.select(array_to_vector(F.col(features)).alias("features")).persist()
    try:
        best: Centers | None = None
        for run in range(runs):
            model = KMeans(k=k, maxIter=iterations, tol=tol, initMode=init, seed=seed + run).fit(vector)
            found = Centers(np.array(model.clusterCenters()), float(model.summary.trainingCost))
            if best is None or found.cost < best.cost:
                best = found
        return best
    finally:
        vector.unpersist()


# --- many models in the same rounds -------------------------------------------


def model_sums(rows: DataFrame, models: Sequence[np.ndarray]) -> DataFrame:
    """``(model, cluster, n, total, cost)`` of several sets of centres, from one scan.

    The first column holds features, as arrays or as packed blocks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(len(m)), np.zeros(m.shape), np.zeros(len(m))) for m in models]
        for batch in batches:
            for x in vectors.slices(batch.column(0), models[0].shape[1]):
                for centers, (n, total, cost) in zip(models, sums):
                    index, distance = vectors.nearest(x, centers)
                    n += np.bincount(index, minlength=len(n))
                    cost += np.bincount(index, weights=distance, minlength=len(n))
                    for j in range(x.shape[1]):
                        total[:, j] += np.bincount(index, weights=x[:, j], minlength=len(n))
        for model, (n, total, cost) in enumerate(sums):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), model, np.int32)),
                        pa.array(used.astype(np.int32)),
                        pa.array(n[used].astype(np.int64)),
                        vectors.to_lists(total[used]),
                        pa.array(cost[used]),
                    ],
                    names=["model", "cluster", "n", "total", "cost"],
                )

    parts = rows.mapInArrow(partial, "model int, cluster int, n long, total array<double>, cost double")
    return parts.groupBy("model", "cluster").agg(
        F.sum("n").alias("n"), sum_arrays(F.col("total")).alias("total"), F.sum("cost").alias("cost")
    )


def lloyd_together(
    df: DataFrame, seeds: Sequence[np.ndarray], iterations: int, features: str = "features", tol: float = 0.0
) -> list[Centers]:
    """Lloyd from several seeds, of the same or of different k, in the same rounds.

    A round is one scan, however many models there are; models that have come to rest take no
    further part.  The costs are those of the final centres, from one more scan.
    """
    rows, models = df.select(features), [np.asarray(s, dtype=float) for s in seeds]
    moving = list(range(len(models)))
    for _ in range(iterations):
        if not moving:
            break
        moved = [models[m].copy() for m in moving]
        for row in model_sums(rows, [models[m] for m in moving]).collect():
            moved[row.model][row.cluster] = np.asarray(row.total) / row.n
        shifts = [((new - models[m]) ** 2).sum(axis=1).max() for m, new in zip(moving, moved)]
        for m, new in zip(moving, moved):
            models[m] = new
        moving = [m for m, shift in zip(moving, shifts) if shift > tol * tol]
    costs = [0.0] * len(models)
    for row in model_sums(rows, models).collect():
        costs[row.model] += row.cost
    return [Centers(m, c) for m, c in zip(models, costs)]


def _drawn(key: Sequence[str], run: int | Column, step: int) -> Column:
    """A digest that orders the rows at random, alike wherever and however often it is computed."""
    run = run if isinstance(run, Column) else F.lit(run)
    return F.md5(F.concat_ws("-", run.cast("string"), F.lit(str(step)), *[F.col(k).cast("string") for k in key]))


def _share(digest: Column) -> Column:
    """The digest's first 32 bits as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def random_seeds(df: DataFrame, ks: Sequence[int], key: Sequence[str], seed: int = 1, features: str = "features") -> list[np.ndarray]:
    """For the i-th of ``ks`` that many rows, drawn at random by a digest of ``seed + i`` and the key.

    All draws come from one scan: the few rows whose digests are small enough to be drawn are
    kept, and ordered.  Rows with equal keys are ordered by their features.
    """
    n = df.count()
    if n < max(ks):
        raise ValueError(f"{max(ks)} seeds wanted, {n} rows found")
    draws = F.array(*[_drawn(key, seed + i, 0) for i in range(len(ks))])
    rows = df.select(*key, F.col(features).alias("x"), F.posexplode(draws).alias("model", "drawn"))
    likely = rows.where(_share(F.col("drawn")) < (8 * max(ks) + 64) / n)
    for found in (likely, rows):  # the second if ever the first should hold too few
        place = F.row_number().over(Window.partitionBy("model").orderBy("drawn", "x"))
        first = found.withColumn("place", place).where(F.col("place") <= max(ks)).orderBy("model", "place").collect()
        seeds = [[r.x for r in first if r.model == i][:k] for i, k in enumerate(ks)]
        if all(len(s) == k for s, k in zip(seeds, ks)):
            return [np.array(s, dtype=float) for s in seeds]
    raise AssertionError("rows were counted before")


def parallel_seeds(
    df: DataFrame, ks: Sequence[int], key: Sequence[str], seed: int = 1, steps: int = 2, features: str = "features"
) -> list[np.ndarray]:
    """Seeds by k-means||, for the i-th of ``ks`` with draws by ``seed + i``; scans do not grow with their number.

    Each step draws about 2 k rows with chances in proportion to their squared distance from the
    rows drawn before.  The drawn rows are weighted by the rows nearest to them and thinned to k:
    the heaviest first, then always the one of greatest weight times squared distance from those
    taken.  Where fewer than k different rows are drawn, random ones are added.
    """
    drawn = random_seeds(df, [1] * len(ks), key, seed, features)
    for step in range(1, steps + 1):
        far = df.select(*key, F.col(features).alias("x"), vectors.nearest_distances(F.col(features), drawn).alias("d"))
        costs = far.agg(*[F.sum(F.col("d")[i]) for i in range(len(ks))]).first()
        chances = [F.struct(_drawn(key, seed + i, step).alias("u"), (2.0 * k * F.col("d")[i]).alias("w"), F.lit(c or 0.0).alias("cost"))
                   for i, (k, c) in enumerate(zip(ks, costs))]
        asked = far.select(*key, "x", F.posexplode(F.array(*chances)).alias("model", "c"))
        found = asked.where(_share(F.col("c.u")) * F.col("c.cost") < F.col("c.w")).orderBy("model", *key, "x").collect()
        new = [[r.x for r in found if r.model == i] for i in range(len(ks))]
        drawn = [np.vstack([d, np.array(x, dtype=float)]) if x else d for d, x in zip(drawn, new)]
    weights = [np.zeros(len(d)) for d in drawn]
    for row in model_sums(df.select(features), drawn).collect():
        weights[row.model][row.cluster] = row.n
    seeds = [_thinned(d, w, k) for d, w, k in zip(drawn, weights, ks)]
    if any(len(s) < k for s, k in zip(seeds, ks)):
        spare = random_seeds(df, ks, key, seed, features)
        seeds = [np.vstack([s, r[: k - len(s)]]) for s, r, k in zip(seeds, spare, ks)]
    return seeds


def _thinned(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    taken, apart = [], np.ones(len(points))
    for _ in range(min(k, len(points))):
        worth = weights * apart
        best = int(worth.argmax())
        if worth[best] <= 0:
            break
        gap = ((points - points[best]) ** 2).sum(axis=1)
        apart = np.minimum(apart, gap) if taken else gap
        taken.append(best)
    return points[taken]


def train_together(
    df: DataFrame,
    ks: Sequence[int],
    key: Sequence[str],
    iterations: int = 20,
    init: str = "k-means||",
    seed: int = 1,
    features: str = "features",
    tol: float = 0.0,
) -> list[Centers]:
    """A model for each of ``ks`` (equal ones are restarts), all in the same scans; see :func:`lloyd_together`."""
    starts = {"k-means||": parallel_seeds, "random": random_seeds}[init](df, ks, key, seed, features=features)
    return lloyd_together(df, starts, iterations, features, tol)


def train_packed(
    df: DataFrame,
    ks: Sequence[int],
    key: Sequence[str],
    iterations: int = 20,
    init: str = "k-means||",
    seed: int = 1,
    features: str = "features",
    tol: float = 1e-4,
) -> list[Centers]:
    """As :func:`train_together`, on rows that are packed into blocks once, for tables of many rows.

    The draws of ``seed + i`` go by a hash of the row's key, so that they are the same however the
    rows are dealt.  k-means|| takes two steps; the rows it draws, weighted by the rows nearest to
    them, are thinned and settled on the driver, and random ones are added where fewer than k
    different ones were drawn.
    """
    if init not in ("k-means||", "random"):
        raise ValueError(f"no starts named {init}")
    blocks = vectors.packed(df, features, key).persist()
    try:
        n, d = vectors.packed_size(blocks)
        if n < max(ks):
            raise ValueError(f"{max(ks)} seeds wanted, {n} rows found")
        if init == "random":
            starts = _packed_random(blocks, n, d, ks, seed)
        else:
            starts = _packed_parallel(blocks, n, d, ks, seed)
        return lloyd_together(blocks, starts, iterations, "x", tol)
    finally:
        blocks.unpersist()


def _uniform(hashes: np.ndarray, run: int, step: int) -> np.ndarray:
    """For each key's hash a number from 0 to 1, anew for every run and step (splitmix64)."""
    mixed = hashes.view(np.uint64) + np.uint64((((run << 8) + step + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))) / 2.0**64


def _packed_draw(blocks: DataFrame, d: int, runs: Sequence[int], step: int, chances: Sequence[float], models=None) -> list[np.ndarray]:
    """Rows whose number is under their chance, for every run, by rising number.

    The chance is the same for all rows, or, given models, in proportion to the squared distance
    from the run's nearest centre.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = vectors.slices(batch.column(1), 1)  # eight bytes a row, cut as the features are
            for x, h in zip(vectors.slices(batch.column(0), d), hashes):
                h = np.ascontiguousarray(h).ravel().view(np.int64)
                for i, (run, chance) in enumerate(zip(runs, chances)):
                    u = _uniform(h, run, step)
                    rows = np.flatnonzero(u < (chance if models is None else chance * vectors.nearest(x, models[i])[1]))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), i, np.int32)), pa.array(u[rows]), vectors.to_lists(x[rows])],
                            names=["model", "u", "x"],
                        )

    found = blocks.select("x", "h").mapInArrow(drawn, "model int, u double, x array<double>")
    found = found.orderBy("model", "u", "x").collect()  # a few times k rows a run
    return [np.array([r.x for r in found if r.model == i], dtype=float).reshape(-1, d) for i in range(len(runs))]


def _packed_random(blocks: DataFrame, n: int, d: int, ks: Sequence[int], seed: int) -> list[np.ndarray]:
    runs, wanted = range(seed, seed + len(ks)), 8 * max(ks) + 64
    while True:
        drawn = _packed_draw(blocks, d, runs, 0, [wanted / n] * len(ks))
        if wanted >= n or all(len(x) >= k for x, k in zip(drawn, ks)):
            return [x[:k] for x, k in zip(drawn, ks)]
        wanted *= 8


def _packed_parallel(blocks: DataFrame, n: int, d: int, ks: Sequence[int], seed: int, steps: int = 2) -> list[np.ndarray]:
    runs, rows = range(seed, seed + len(ks)), blocks.select("x")
    drawn = _packed_random(blocks, n, d, [1] * len(ks), seed)
    for step in range(1, steps + 1):
        costs = np.zeros(len(ks))
        for row in model_sums(rows, drawn).collect():
            costs[row.model] += row.cost
        chances = [2.0 * k / cost if cost > 0 else 0.0 for k, cost in zip(ks, costs)]
        drawn = [np.vstack([old, new]) for old, new in zip(drawn, _packed_draw(blocks, d, runs, step, chances, drawn))]
    weights = [np.zeros(len(x)) for x in drawn]
    for row in model_sums(rows, drawn).collect():
        weights[row.model][row.cluster] = row.n
    seeds = [_settled(x, w, _thinned(x, w, k)) for x, w, k in zip(drawn, weights, ks)]
    if any(len(s) < k for s, k in zip(seeds, ks)):
        spare = _packed_random(blocks, n, d, ks, seed)
        seeds = [np.vstack([s, r[: k - len(s)]]) for s, r, k in zip(seeds, spare, ks)]
    return seeds


def _settled(points: np.ndarray, weights: np.ndarray, centers: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Lloyd on the few weighted points that were drawn."""
    for _ in range(rounds):
        index, _ = vectors.nearest(points, centers)
        n = np.bincount(index, weights=weights, minlength=len(centers))
        total = np.stack([np.bincount(index, weights=weights * p, minlength=len(centers)) for p in points.T], axis=1)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def best_of(models: Sequence[Centers]) -> Centers:
    """The model of least cost, the first of several."""
    return min(models, key=lambda m: m.cost)


def mean_distances(df: DataFrame, models: Sequence[Centers], features: str = "features") -> DataFrame:
    """``(model, k, score)``: mean plain distance to the nearest centre of every model, from one scan."""
    found = df.select(vectors.nearest_distances(F.col(features), [m.matrix for m in models]).alias("d"))
    means = found.agg(F.array(*[F.avg(F.sqrt(F.col("d")[i])) for i in range(len(models))]).alias("means"))
    ks = F.array(*[F.lit(m.k) for m in models])
    return means.select(F.posexplode("means").alias("model", "score")).select(
        "model", F.element_at(ks, F.col("model") + 1).alias("k"), "score"
    )


def mean_entropies(df: DataFrame, models: Sequence[Centers], label: str = "label", features: str = "features") -> DataFrame:
    """``(model, k, score)``: :func:`mean_entropy` of every model, from one scan."""
    clusters = vectors.nearest_clusters(F.col(features), [m.matrix for m in models])
    found = df.select(F.col(label).alias("label"), F.posexplode(clusters).alias("model", "cluster"))
    counts = found.groupBy("model", "cluster", "label").agg(F.count("*").alias("count"))
    totals = counts.groupBy("model", "cluster").agg(F.sum("count").alias("n"))
    terms = counts.join(totals, ["model", "cluster"])
    entropy = F.sum(-F.col("count") * F.log(F.col("count") / F.col("n"))) / F.sum("count")
    ks = F.array(*[F.lit(m.k) for m in models])
    scores = terms.groupBy("model").agg(entropy.alias("score"))
    return scores.select("model", F.element_at(ks, F.col("model") + 1).alias("k"), "score")


# --- tables about a clustering ----------------------------------------------


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count("*").alias("n"))


def label_counts(assigned: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    return assigned.groupBy(cluster, label).agg(F.count("*").alias("count"))


def within_cost(assigned: DataFrame, distance: str = "sq_distance") -> DataFrame:
    """Within-set sum of squared distances."""
    return assigned.agg(F.sum(distance).alias("wssse"))


def mean_distance(assigned: DataFrame, distance: str = "sq_distance") -> DataFrame:
    """Mean plain distance to the own centre."""
    return assigned.agg(F.avg(F.sqrt(distance)).alias("score"))


def mean_entropy(assigned: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Entropy of the labels in each cluster (natural log), weighted by cluster size.

    Rows are reduced to cluster x label counts first; both later steps see only those.
    """
    counts = label_counts(assigned, cluster, label)
    totals = counts.groupBy(cluster).agg(F.sum("count").alias("n"))
    share = F.col("count") / F.col("n")
    terms = counts.join(totals, cluster).withColumn("_h", -share * F.log(share))
    per_cluster = terms.groupBy(cluster).agg(F.first("n").alias("n"), F.sum("_h").alias("entropy"))
    return per_cluster.agg((F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("score"))


# --- sweeps ------------------------------------------------------------------


@dataclass(frozen=True)
class Sweep:
    """Models and scores per k, and the feature rows they were fitted on."""

    models: dict[int, Centers]
    scores: DataFrame
    rows: DataFrame

    def best_k(self) -> int:
        return best_k(self.scores).first().k

    def best(self) -> Centers:
        return self.models[self.best_k()]


def sweep(df: DataFrame, ks: Iterable[int], fit, score, parallel: int = 4) -> Sweep:
    """Train and score every k.

    ``fit(df, k)`` gives centres, ``score(assigned)`` a one-row ``score`` table.  The fits
    are independent jobs, submitted from a few driver threads so that small ones
    overlap; ``df`` should be persisted or stored.
    """
    ks = list(ks)
    in_session = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(parallel) as pool:
        fitted = {k: pool.submit(in_session(fit), df, k) for k in ks}
        models = {k: f.result() for k, f in fitted.items()}
    tables = [score(models[k].assign(df)).select(F.lit(k).alias("k"), "score") for k in ks]
    scores = tables[0]
    for table in tables[1:]:
        scores = scores.unionAll(table)
    return Sweep(models, scores, df)


def best_k(scores: DataFrame) -> DataFrame:
    """The k of the lowest score, lowest k on a tie."""
    return scores.orderBy("score", "k").limit(1)


# --- samples of assignments --------------------------------------------------


def random_sample(df: DataFrame, fraction: float = 0.05, seed: int = 1) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, keys: Sequence[str], one_in: int = 20) -> DataFrame:
    """The rows whose key hash is a multiple of ``one_in``."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(one_in)) == 0)
