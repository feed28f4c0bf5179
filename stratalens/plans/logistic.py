"""Logistic regression by Newton steps whose gradient and Hessian are Spark aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE, TOLERANCE, MOST_STEPS = 1e-9, 1e-10, 200


def fit(df: DataFrame, features: list[str], label: str, weight: str | None = None) -> dict:
    """Coefficients (intercept first), standard errors, log-likelihood and convergence.

    One pass over df a step; the driver sees p and p * p sums alone. Rows with
    equal features are first counted, so a step reads only distinct patterns.
    """
    rows = df.groupBy(*features, label).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("_w")).cache()
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    p, y, w = len(x), F.col(label).cast("double"), F.col("_w")
    beta = np.zeros(p)
    try:
        for _ in range(MOST_STEPS):
            eta = sum((b * c for b, c in zip(map(float, beta), x, strict=True)), F.lit(0.0))
            mu = 1 / (1 + F.exp(-eta))
            sums = [F.sum(w * c * (y - mu)) for c in x] + [F.sum(w * mu * (1 - mu) * x[i] * x[j]) for i in range(p) for j in range(i, p)]
            like = F.sum(w * (y * eta - F.when(eta > 30, eta).otherwise(F.log1p(F.exp(eta)))))
            row = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate([*sums, like])]).first()
            gradient, hessian = np.array(row[:p]), np.zeros((p, p))
            hessian[np.triu_indices(p)] = row[p:-1]
            hessian = hessian + np.triu(hessian, 1).T + RIDGE * np.eye(p)
            step = np.linalg.solve(hessian, gradient)
            beta = beta + step
            if np.abs(step).max() < TOLERANCE:
                se = np.sqrt(np.diag(np.linalg.inv(hessian)))
                return {"beta": beta.tolist(), "se": se.tolist(), "z": (beta / se).tolist(), "odds": [math.exp(b) for b in beta], "loglik": row[-1], "converged": True}
    finally:
        rows.unpersist()
    return {"beta": beta.tolist(), "se": [math.nan] * p, "z": [math.nan] * p, "odds": [math.exp(min(b, 700)) for b in beta], "loglik": math.nan, "converged": False}


def lrt(full: dict, reduced: dict) -> tuple[float, int]:
    """Likelihood-ratio statistic and degrees of freedom of two fits."""
    return 2 * (full["loglik"] - reduced["loglik"]), len(full["beta"]) - len(reduced["beta"])
