"""Known values of the factors and the causality check that cannot pass vacuously."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day
from factmark.errors import LookAheadFactor, ResearchError
from factmark.operators import bitemporal, factors


def column(df, name="factor"):
    return [r[name] for r in df.orderBy("effective_date").collect()]


def test_momentum_by_hand_and_in_closed_form(panel_of):
    got = column(factors.momentum(panel_of(a=[100, 110, 120, 130, 500, 600]), 4, 1))
    assert got[:4] == [None] * 4
    assert got[4:] == pytest.approx([0.30, 500 / 110 - 1])
    growth = column(factors.momentum(panel_of(a=[100 * 1.01 ** t for t in range(400)])))
    assert growth[251] is None and growth[252:] == pytest.approx([1.01 ** 231 - 1] * 148)
    with pytest.raises(ResearchError):
        factors.momentum(panel_of(a=[1]), 5, 5)


def test_reversal_and_returns(panel_of):
    panel = panel_of(a=[100, 110, 99])
    assert column(factors.reversal(panel, 2)) == [None, None, pytest.approx(0.01)]
    assert column(factors.simple_returns(panel), "ret") == [None, pytest.approx(0.1),
                                                            pytest.approx(-0.1)]
    back = factors.cumulative_price(factors.simple_returns(panel).where("ret IS NOT NULL"))
    assert column(back, "price") == pytest.approx([1.1, 0.99])


def test_volatility_is_the_sample_deviation_of_log_returns(panel_of):
    prices = [100, 101, 99, 103, 104, 100, 98]
    got = column(factors.realised_volatility(panel_of(a=prices), 4))
    logs = np.diff(np.log(prices))
    want = [np.std(logs[t - 4:t], ddof=1) * math.sqrt(252) for t in range(4, 7)]
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx(want)
    with pytest.raises(ResearchError):
        factors.realised_volatility(panel_of(a=prices), 1)


def test_unpriceable_entities_are_refused_whole(panel_of):
    good, bad = factors.split_priceable(panel_of(oil=[10, -36.98, 5], spx=[1, 2, 3]))
    assert {r.entity_id for r in good.collect()} == {"spx"}
    assert [(r.entity_id, r.bad_prices) for r in bad.collect()] == [("oil", 1)]


BOOK = [("ACME", "book", 500.0, "2023-12-31", "2024-02-15"),
        ("ACME", "book", 400.0, "2023-12-31", "2024-03-20"),
        ("ACME", "book", 600.0, "2024-03-31", "2024-05-15"),
        ("ACME", "book", 550.0, "2024-03-31", "2024-06-20")]


def test_book_to_market_keeps_its_two_selections_apart(spark, facts_of):
    dates = ["2024-01-15", "2024-02-15", "2024-02-20", "2024-04-01", "2024-05-15", "2024-07-01"]
    caps = spark.createDataFrame([("ACME", day(d), 1000.0) for d in dates]
                                 + [("ACME", day("2024-08-01"), 0.0)],
                                 "entity_id string, effective_date date, value double")
    first = bitemporal.first_reports(facts_of(BOOK))
    assert column(factors.book_to_market(caps, first)) == [None, 0.5, 0.5, 0.5, 0.6, 0.6]


def test_a_late_first_report_of_an_old_period_does_not_displace_a_newer_one(spark, facts_of):
    facts = facts_of(BOOK + [("ACME", "book", 1.0, "2023-09-30", "2024-06-01")])
    caps = spark.createDataFrame([("ACME", day("2024-07-01"), 1000.0)],
                                 "entity_id string, effective_date date, value double")
    assert column(factors.book_to_market(caps, bitemporal.first_reports(facts))) == [0.6]


def leaky(panel):
    top = panel.groupBy("entity_id").agg(F.max("value").alias("top"))
    return panel.join(top, "entity_id").withColumn("factor", F.col("value") / F.col("top"))


def test_causality(panel_of):
    panel = panel_of(a=[100 + i + (i * 7) % 5 for i in range(60)])
    split = "2000-02-10"
    factors.assert_causal(lambda p: factors.momentum(p, 10, 2), panel, split)
    factors.assert_causal(lambda p: factors.realised_volatility(p, 5), panel, split)
    with pytest.raises(LookAheadFactor):
        factors.assert_causal(leaky, panel, split)
    with pytest.raises(ResearchError, match="vacuous"):
        factors.assert_causal(lambda p: factors.momentum(p, 50, 2), panel, split)
    for outside in ("1999-01-01", "2001-01-01"):
        with pytest.raises(ResearchError, match="both sides"):
            factors.assert_causal(leaky, panel, outside)


def test_causality_compares_one_and_the_same_panel(panel_of):
    """A panel that another computation gives other last digits moves nothing."""
    def unsteady(batches):
        import random
        for batch in batches:
            yield batch.assign(value=[v + random.random() / 1e9 for v in batch["value"]])

    panel = panel_of(a=[100 + i for i in range(40)])
    panel = panel.mapInPandas(unsteady, panel.schema)
    row = factors.causality_check(lambda p: factors.momentum(p, 5, 1), panel, "2000-01-20").first()
    assert (row.head_rows, row.compared, row.moved) == (20, 15, 0)


def test_registry_states_directions(spark):
    rows = {r.name: r.direction for r in factors.registry(spark).collect()}
    assert rows["momentum"] == "positive" and rows["size"] == "negative" and len(rows) == 5


def test_a_total_loss_ends_at_nothing(spark):
    rows = [("a", day("2020-01-01"), 0.1), ("a", day("2020-01-02"), -1.0), ("a", day("2020-01-03"), 0.5)]
    panel = spark.createDataFrame(rows, "entity_id string, effective_date date, ret double")
    got = [r.price for r in factors.cumulative_price(panel).orderBy("effective_date").collect()]
    assert got == [pytest.approx(1.1), 0.0, 0.0]


def test_caps_without_a_ratio_are_set_aside(spark):
    rows = [("a", day("2020-01-01"), 5.0), ("a", day("2020-01-02"), 0.0), ("b", day("2020-01-01"), None)]
    caps = spark.createDataFrame(rows, "entity_id string, effective_date date, value double")
    assert {r.reason for r in factors.unusable_caps(caps).collect()} == {
        "market cap is not positive", "no market cap"}
    assert factors.unusable_caps(caps).count() + caps.where("value > 0").count() == 3
