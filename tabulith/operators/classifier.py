"""The table classifier: logistic regression over nine features, in cross-validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.operators.gates import FEATURES, TABLE

FOLDS = 5
ROUNDS = 25
SIZE = len(FEATURES) + 1  # the last weight is the intercept


def _odds(weights: list[Column]) -> Column:
    return sum((w * F.col(f) for w, f in zip(weights, FEATURES, strict=False)), weights[-1])


def _fits(rows: DataFrame) -> dict[int, np.ndarray]:
    """Weights for each fold, of the rows outside of it, by Newton's method.

    A round is one aggregate over all rows for all folds: gradients and Hessians are sums, so what
    reaches the driver is a few numbers a fold. The penalty is the sum of squared weights over
    two, the intercept left out.
    """
    outside = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("k <> fold")
    x = [*[F.col(f) for f in FEATURES], F.lit(1.0)]
    betas = {k: np.zeros(SIZE) for k in range(FOLDS)}
    ridge = np.diag([*[1.0] * (SIZE - 1), 0.0])
    fits: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        table = F.array(*[F.array(*map(F.lit, betas[k].tolist())) for k in range(FOLDS)])
        own = outside.withColumn("w", table[F.col("k")]).withColumn("p", 1 / (1 + F.exp(-_odds([F.col("w")[i] for i in range(SIZE)]))))
        off, curve = F.col("p") - F.col("label"), F.col("p") * (1 - F.col("p"))
        sums = [F.sum(off * a).alias(f"g{i}") for i, a in enumerate(x)]
        sums += [F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(SIZE) for j in range(i, SIZE)]
        largest = 0.0
        for r in own.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), *sums).collect():
            if r.low == r.high:
                continue
            hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(SIZE)] for i in range(SIZE)])
            step = np.linalg.solve(hessian + ridge + 1e-9 * np.eye(SIZE), np.array([r[f"g{i}"] for i in range(SIZE)]) + ridge @ betas[r.k])
            betas[r.k] = betas[r.k] - np.clip(step, -5, 5)
            fits[r.k] = betas[r.k]
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-7:
            break
    return fits


def cross_validation(features: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """Per fold: rows, precision and accuracy; folds are a hash of the table's key, so runs agree.

    A fold whose training rows are of one class, or that is empty, has no row.
    """
    rows = features.join(labels.select(*TABLE, F.col("label").cast("double").alias("label")), TABLE)
    rows = rows.select(*FEATURES, "label", F.pmod(F.xxhash64(F.lit(seed), *TABLE), F.lit(FOLDS)).cast("int").alias("fold")).persist()
    fits = _fits(rows)
    if not fits:
        return features.sparkSession.createDataFrame([], "fold int, n long, precision double, accuracy double")
    weights = F.create_map(*[y for k, b in sorted(fits.items()) for y in (F.lit(k), F.array(*map(F.lit, b.tolist())))])
    said = rows.withColumn("w", weights[F.col("fold")]).where("w is not null").withColumn("said", (_odds([F.col("w")[i] for i in range(SIZE)]) > 0).cast("double"))
    hit = (F.col("said") == 1) & (F.col("label") == 1)
    return said.groupBy("fold").agg(F.count("*").alias("n"), F.try_divide(F.count_if(hit), F.count_if(F.col("said") == 1)).alias("precision"), F.avg((F.col("said") == F.col("label")).cast("double")).alias("accuracy"))
