"""Linear models over sparse vectors, calibration, topics. Text models and their search are in ``linear``, rising fits in ``isotonic``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.density import density_clusters
from tessera.operators.evaluation import counts, from_counts
from tessera.operators.neighbours import matrix
from tessera.operators.sums import summed
from tessera.runtime import Workspace


def with_balance(train: DataFrame) -> DataFrame:
    """Weights that give both classes the same total."""
    n = train.groupBy("y").agg(F.count("*").alias("m"))
    k, total = n.count(), train.count()
    return train.join(F.broadcast(n), "y").withColumn("weight", F.lit(float(total)) / (k * F.col("m")))


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 100):
    """Balanced logistic regression; the penalty is that of a liblinear-style constant ``c``."""
    from pyspark.ml.classification import LogisticRegression

    w = with_balance(train)
    total = w.agg(F.sum("weight")).first()[0]
    return LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-4).fit(w)


def fit_majority(train: DataFrame):
    """The most frequent class (ties: the smaller)."""
    return train.groupBy("y").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "y").first()["y"]


def predict(model, df: DataFrame) -> DataFrame:
    """record_id, y, p, score; the score is a probability where the model has one, else a margin."""
    if isinstance(model, int):
        return df.select("record_id", "y", F.lit(model).alias("p"), F.lit(float(model)).alias("score"))
    out = model.transform(df)
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select("record_id", "y", F.col("prediction").cast("int").alias("p"), score.alias("score"))


def macro_f1(pred: DataFrame) -> float:
    return pred.agg(*counts()).select(from_counts()["macro_f1"].alias("f")).first()["f"]


def platt(df: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic fit on the logit of the score.

    Newton steps from five sums over counts of distinct scores: the data is
    reduced before the first step and never collected.
    """
    p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    steps = df.groupBy(F.log(p / (1 - p)).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("k")).persist()
    a, b = 0.0, 1.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        r, w, x = F.col("n") * q - F.col("k"), F.col("n") * q * (1 - q), F.col("x")
        g0, g1, h00, h01, h11 = steps.agg(F.sum(r), F.sum(r * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
        step = np.linalg.solve(np.array([[h00 + 1e-9, h01], [h01, h11 + 1e-6]]), np.array([g0, g1]))
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-10:
            break
    steps.unpersist()
    return a, b


def isotonic_allowed(n: int, positives: int) -> bool:
    return n >= 1000 and min(positives, n - positives) >= 200


def principal(vectors: DataFrame, components: int) -> DataFrame:
    """id and v on the leading principal axes; sums of at most dim x dim numbers a task, no vector leaves it."""
    first = vectors.select("v").first()
    if first is None or components >= len(first["v"]):
        return vectors
    dim = len(first["v"])

    def work(batches):
        out = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if b.num_rows:
                x = np.concatenate([matrix(b.column("v")), np.ones((b.num_rows, 1))], axis=1)
                out += x.T @ x
        return out

    s = summed(vectors, work, (dim + 1, dim + 1))
    mean = s[-1, :-1] / s[-1, -1]
    _, axes = np.linalg.eigh(s[:-1, :-1] / s[-1, -1] - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :components]

    def turn(batches):
        for b in batches:
            if b.num_rows:
                y = (matrix(b.column("v")) - mean) @ axes
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, components), pa.int32()), pa.array(y.ravel()))], ["id", "v"])

    return vectors.mapInArrow(turn, "id long, v array<double>")


def cluster_topics(df: DataFrame, *, min_size: int = 30, components: int = 5, **options) -> DataFrame:
    """record_id, topic_id, assigned_probability: density clusters of ``vector`` (unit length, on ``components`` leading axes; 0 keeps all), topics by falling size, outliers -1."""
    ws = Workspace(df.sparkSession)
    unit = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))
    d = df.select("record_id", F.transform(unit, lambda x: x / F.greatest(norm, F.lit(1e-300))).alias("v"))
    d = ws.keep(d.withColumn("id", F.monotonically_increasing_id()), "vectors")
    vectors = d.select("id", "v")
    got = density_clusters(principal(vectors, components) if components else vectors, min_size=min_size, **options)
    return d.join(got, "id").select("record_id", F.col("cluster").alias("topic_id"), F.col("probability").alias("assigned_probability"))


def topic_descriptors(docs: DataFrame, topics: DataFrame, k: int = 10) -> DataFrame:
    """The k terms of highest class-based TF-IDF of every topic."""
    from pyspark.sql import Window

    from tessera.operators.features import term_counts

    c = term_counts(docs, "text").join(topics.where("topic_id >= 0").select("record_id", "topic_id"), "record_id").groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"))
    by_topic = c.withColumn("n", F.sum("tf").over(Window.partitionBy("topic_id")))
    by_term = c.groupBy("term").agg(F.sum("tf").alias("total"))
    mean = by_topic.select("topic_id", "n").distinct().agg(F.avg("n").alias("a"))
    w = by_topic.join(by_term, "term").crossJoin(F.broadcast(mean)).withColumn("x", F.col("tf") / F.col("n") * F.log(1 + F.col("a") / F.col("total")))
    rank = Window.partitionBy("topic_id").orderBy(F.desc("x"), "term")
    return w.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).select("topic_id", "term", "rn", F.round("x", 6).alias("weight"))
