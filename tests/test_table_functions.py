"""Rules and factors called from SQL give what the DataFrame operators give."""
import datetime
import json

import numpy as np
import pytest

from factmark.operators import factors, sweep, table_functions


@pytest.fixture(scope="module")
def panel(spark):
    r, first = np.random.default_rng(3), datetime.date(2001, 1, 1)
    rows = [(name, first + datetime.timedelta(days=i), float(v)) for name, n in (("a", 90), ("b", 40), ("c", 2))
            for i, v in enumerate(100 * np.cumprod(1 + r.normal(0, 0.02, n)))]
    return spark.createDataFrame(rows, "entity_id string, effective_date date, value double").repartition(3)


def test_sweep_from_sql_equals_the_operator(spark, panel):
    table_functions.register(spark)
    returns = factors.simple_returns(panel).select("entity_id", "effective_date", "ret")
    returns.createOrReplaceTempView("returns")
    params = sweep.parameter_list(sweep.parameter_table(spark, "fast < slow", fast=range(2, 5),
                                                        slow=range(3, 12)))
    params.append({"fast": 60, "slow": 80})  # fits the longest series only
    for mode in ("excess", "long_short"):
        got = spark.sql(f"""SELECT * FROM sweep(TABLE(returns) PARTITION BY entity_id ORDER BY (effective_date),
                            '{json.dumps(params)}', '{mode}')""").collect()
        want = sweep.sweep(returns, params, sweep.crossover_rule(mode)).collect()
        of = lambda rows: {(r.entity_id, r.trial_ord): r.sharpe for r in rows}
        assert len(got) == len(want) and of(got) == pytest.approx(of(want))
        assert {g.entity_id for g in got} == {"a", "b"}


def test_factors_from_sql_equal_the_operator(spark, panel):
    own = table_functions.FACTORS | {"twice": lambda values: 2 * values}
    table_functions.register(spark, factors=own)
    panel.createOrReplaceTempView("panel")
    ask = lambda name, params: {(r.entity_id, r.effective_date): r.factor for r in spark.sql(
        f"SELECT * FROM series_factor(TABLE(panel) PARTITION BY entity_id ORDER BY (effective_date), "
        f"'{name}', '{json.dumps(params)}')").collect()}
    rows = factors.momentum(panel, 30, 4).collect()
    assert ask("momentum", {"lookback": 30, "skip": 4}) == pytest.approx(
        {(r.entity_id, r.effective_date): r.factor for r in rows}, nan_ok=True)
    rows = factors.reversal(panel, 10).collect()
    assert ask("reversal", {"lookback": 10}) == pytest.approx(
        {(r.entity_id, r.effective_date): r.factor for r in rows}, nan_ok=True)
    assert ask("twice", {})[("a", datetime.date(2001, 1, 1))] == pytest.approx(
        2 * panel.where("entity_id = 'a' AND effective_date = DATE '2001-01-01'").first().value)
