"""A synthetic panel with planted defects, for examples and tests."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sondage.operators.levels import declare

SCHEMA = "id int, date date, grp string, site string, flag boolean, consented boolean, score double, income double, visits int, claims int, downtime int, cohort string, lab_value double"

#: The declared levels of grp, the last of which no row has.
LEVELS = ("alpha", "beta", "gamma", "delta", "epsilon")


def example_data(spark: SparkSession, n_id: int = 75, n_period: int = 12, seed: int = 2026) -> DataFrame:
    """``n_id`` units by ``n_period`` months. Rows are drawn by unit, so the table is the same in any partitioning."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in p["id"]:
                rng = np.random.default_rng([seed, int(i)])
                u, n = rng.normal(0, 0.8), n_period
                site = rng.choice(["North", "north", "North ", "South", "", "East"], n, p=[0.3, 0.06, 0.04, 0.3, 0.05, 0.25])
                lab = np.where(rng.random(n) < 0.12, None, np.round(rng.normal(7.4, 1.1, n), 2))
                yield pd.DataFrame({
                    "id": np.int32(i + 1), "date": [date(2024 + m // 12, m % 12 + 1, 1) for m in range(n)],
                    "grp": ["delta" if i == 0 and m < 3 else str(rng.choice(["alpha", "beta", "gamma"], p=[0.45, 0.35, 0.2])) for m in range(n)],
                    "site": site, "flag": rng.random(n) < 0.5, "consented": rng.random(n) < 0.995,
                    "score": np.round(50 + 6 * u + rng.normal(0, 5, n), 2), "income": np.round(rng.lognormal(10.4 + 0.25 * u, 0.55, n), 2),
                    "visits": rng.poisson(np.exp(1.1 + 0.3 * u), n).astype(np.int32), "claims": rng.negative_binomial(1.2, 1.2 / (1.2 + np.exp(1.4 + 0.3 * u)), n).astype(np.int32),
                    "downtime": np.where(rng.random(n) < 0.65, 0, rng.poisson(4, n)).astype(np.int32), "cohort": "2024", "lab_value": lab,
                })

    return declare(spark.range(n_id).mapInPandas(run, SCHEMA), "grp", LEVELS)
