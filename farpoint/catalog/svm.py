"""One-class SVM."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import SQL_EMBEDDINGS, SQL_TOPIC_CENTERS, embeddings, lines, query, r, rounded, sq
from farpoint.catalog.clusters import stored_lines
from farpoint.catalog.distances import topic_centers
from farpoint.operators import ocsvm
from farpoint.plans.detectors import two_model_svm
from farpoint.plans.features import Layout, from_first_rows
from farpoint.session import spread

_SQL = f"""WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS},
weights AS (SELECT topic AS cluster, count(*) / (SELECT count(*) FROM pts) AS alpha FROM pts GROUP BY topic)
SELECT p.id, {r(f"sum(alpha * exp(-1.0 * ({sq('p.x', 'c.x')}))) - 0.4")} AS score,
  sum(alpha * exp(-1.0 * ({sq('p.x', 'c.x')}))) - 0.4 > 0 AS accepted
FROM pts p CROSS JOIN centers c JOIN weights w ON w.cluster = c.cluster GROUP BY p.id"""


def _support(spark, sf_dir):
    """Topic means as support vectors, weighted by the topics' shares."""
    df = embeddings(spark, sf_dir)
    total = df.count()
    shares = df.groupBy(F.col("topic").alias("cluster")).agg((F.count("*") / F.lit(total)).alias("alpha"))
    return topic_centers(spark, sf_dir).table(spark).join(shares, "cluster")


@query("v1_support_vector_scores", _SQL)
def support_vector_scores(spark, sf_dir):
    scored = ocsvm.score_support_vectors(embeddings(spark, sf_dir), _support(spark, sf_dir), -1.0, 0.4)
    return scored.select("id", rounded("score").alias("score"), "accepted")


@query(
    "v1_support_vectors_in_blocks",
    f"SELECT id // 3 AS id, score, accepted FROM ({_SQL}) UNION ALL SELECT NULL, score, accepted FROM ({_SQL}) WHERE id % 5 = 0",
)
def support_vectors_in_blocks(spark, sf_dir):
    """The same with a support table too large to go along with every task, and rows whose ids are repeated or missing."""
    df = embeddings(spark, sf_dir)
    rows = df.withColumn("id", F.expr("id div 3")).unionByName(df.where("id % 5 = 0").withColumn("id", F.lit(None).cast("long")))
    scored = ocsvm.score_support_vectors(rows, _support(spark, sf_dir), -1.0, 0.4, model_bytes=2048)
    return scored.select("id", rounded("score").alias("score"), "accepted")


@query("v2_one_class_training")
def one_class_training(spark, sf_dir):
    """Trained on the normal embeddings: accepted rows per topic."""
    df = embeddings(spark, sf_dir)
    model = ocsvm.train(df.filter(F.col("label") == "normal."), 0.1)
    return model.score(df).groupBy("topic", "accepted").agg(F.count("*").alias("n"))


@query("v2_one_class_training_unscaled")
def one_class_training_unscaled(spark, sf_dir):
    df = stored_lines(spark, sf_dir)
    model = ocsvm.train(df, 0.1, scale=False, components=64)
    return model.score(df).groupBy("label", "accepted").agg(F.count("*").alias("n"))


def _landmarks(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df, ocsvm.train_landmarks(df.filter(F.col("label") == "normal."), 0.1, landmarks=64)


@query(
    "v2_landmark_rejected",
    f"WITH {SQL_EMBEDDINGS} SELECT count(*) AS n, floor(count(*) * 0.1)::BIGINT AS rejected FROM pts WHERE label = 'normal.'",
)
def landmark_rejected(spark, sf_dir):
    """Trained on landmarks of the normal embeddings: training rows rejected, as many as nu says."""
    df, model = _landmarks(spark, sf_dir)
    scored = model.score(df.filter(F.col("label") == "normal."))
    return scored.agg(F.count("*").alias("n"), F.count_if(~F.col("accepted")).alias("rejected"))


@query("v2_landmark_training")
def landmark_training(spark, sf_dir):
    """Accepted rows per topic, and on how many the model of Fourier features says the same."""
    df, model = _landmarks(spark, sf_dir)
    fourier = ocsvm.train(df.filter(F.col("label") == "normal."), 0.1)
    both = fourier.score(df, output="other").withColumnRenamed("accepted", "also")
    counts = model.score(both).groupBy("topic", "accepted")
    return counts.agg(F.count("*").alias("n"), F.count_if(F.col("accepted") == F.col("also")).alias("same"))


@query("v3_one_class_prediction")
def one_class_prediction(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    model = ocsvm.train(df.filter("id % 2 = 0"), 0.1)
    return model.score(df.filter("id % 2 = 1")).select("id", "score", "accepted")


@query("v4_two_model_detector")
def two_model_detector(spark, sf_dir):
    df = spread(lines(spark, sf_dir))
    layout = Layout(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    train = df.filter((F.col("label") == "normal.") & (F.col("l_orderkey") % 3 == 0))
    validation, test = df.filter("l_orderkey % 3 = 1"), df.filter("l_orderkey % 3 = 2")
    result = two_model_svm(
        train, validation, test, layout, pca_k=3, trainer=from_first_rows(5), components=64, steps=10
    )
    return result.groupBy("outcome").agg(F.count("*").alias("n"))
