"""Rules and factors as SQL table functions over partitions, in Arrow batches.

After ``register(spark)`` a session has::

    SELECT * FROM sweep(TABLE(returns) PARTITION BY entity_id ORDER BY (effective_date),
                        '[{"fast": 5, "slow": 20}]', 'excess')
    SELECT * FROM series_factor(TABLE(panel) PARTITION BY entity_id ORDER BY (effective_date),
                                'momentum', '{"lookback": 252, "skip": 21}')

``returns`` is (entity_id, effective_date, ret) and ``panel`` (entity_id, effective_date,
value). A partition is one series, at most a row per calendar day; Spark sorts it and hands
it over in batches. Own rules and factors are added by name.
"""
from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sweep import Rule, crossover_rule

#: A factor from a series of values and named parameters; NaN where it is not defined yet.
SeriesFactor = Callable[..., np.ndarray]


def momentum(values: np.ndarray, lookback: int = 252, skip: int = 21) -> np.ndarray:
    out = np.full(len(values), np.nan)
    out[lookback:] = values[lookback - skip:len(values) - skip] / values[:len(values) - lookback] - 1
    return out


def reversal(values: np.ndarray, lookback: int = 21) -> np.ndarray:
    return -momentum(values, lookback, 0)


RULES: dict[str, Rule] = {mode: crossover_rule(mode) for mode in ("excess", "long_only", "long_short")}
FACTORS: dict[str, SeriesFactor] = {"momentum": momentum, "reversal": reversal}


def register(spark: SparkSession, rules: dict[str, Rule] = RULES,
             factors: dict[str, SeriesFactor] = FACTORS) -> None:
    """Make ``sweep`` and ``series_factor`` known to the session's SQL."""
    spark.udtf.register("sweep", _sweep(dict(rules)))
    spark.udtf.register("series_factor", _factor(dict(factors)))


class _Series:
    """Collects the batches of one partition."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []
        self.given: tuple = ()

    def take(self, rows: pa.RecordBatch, *given: pa.Array) -> None:
        if rows.num_rows:
            self.batches.append(rows)
            self.given = tuple(g[0].as_py() for g in given)

    def whole(self) -> pa.Table:
        return pa.Table.from_batches(self.batches)


def _sweep(rules: dict[str, Rule]):
    class Sweep(_Series):
        def eval(self, rows: pa.RecordBatch, params: pa.Array, rule: pa.Array):
            self.take(rows, params, rule)
            return iter(())

        def terminate(self):
            if not self.batches:
                return
            table = self.whole()
            table = table.filter(table["ret"].is_valid())
            scorer = rules[self.given[1]](table["ret"].to_numpy().astype(float))
            found = []
            for trial, one in enumerate(json.loads(self.given[0])):
                try:
                    found.append((trial, scorer(one)))
                except Exception:  # noqa: BLE001 - a set that cannot be evaluated has no row
                    continue
            entity = self.batches[0].column("entity_id")[0].as_py()
            yield pa.table({"entity_id": pa.array([entity] * len(found), pa.string()),
                            "trial_ord": pa.array([t for t, _ in found], pa.int32()),
                            "sharpe": pa.array([s for _, s in found], pa.float64())})

    return F.arrow_udtf(Sweep, returnType="entity_id string, trial_ord int, sharpe double")


def _factor(factors: dict[str, SeriesFactor]):
    class Factor(_Series):
        def eval(self, rows: pa.RecordBatch, name: pa.Array, params: pa.Array):
            self.take(rows, name, params)
            return iter(())

        def terminate(self):
            if not self.batches:
                return
            table = self.whole()
            values = table["value"].to_numpy().astype(float)
            made = factors[self.given[0]](values, **json.loads(self.given[1]))
            yield pa.table({"entity_id": table["entity_id"], "effective_date": table["effective_date"],
                            "factor": pa.array(made, pa.float64(), from_pandas=True)})

    return F.arrow_udtf(Factor, returnType="entity_id string, effective_date date, factor double")
