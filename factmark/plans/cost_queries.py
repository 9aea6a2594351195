"""Trade cost, borrow and capacity on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costs, validation
from . import bindings as b
from .registry import query, r6

# Gross Sharpe and yearly turnover of the published capacity table.
GROSS, TURNOVER = 2.0, 12.0

_COST_SQL = f"""{b.INSTRUMENTS_SQL}, cost AS (
  SELECT t.*, i.*, abs(shares) / adv AS rate, abs(shares) * price AS notional,
         sign(shares) * daily_volatility * 0.314 * abs(shares) / adv
           * pow(shares_outstanding / adv, 0.25) AS perm,
         sign(shares) * daily_volatility * 0.142 * pow(abs(shares) / adv, 0.6) AS temp
  FROM trades t JOIN instruments i USING (symbol))"""


@query(f"""WITH {_COST_SQL}
SELECT order_id, symbol, shares, days_held, round(rate, 6) AS participation_rate,
       round(perm, 8) AS permanent_impact, round(temp, 8) AS temporary_impact FROM cost""")
def market_impact(spark, sf_dir):
    """Participation, lasting and passing impact of every order line."""
    cost = costs.trade_costs(b.trades(spark, sf_dir), b.instruments(spark, sf_dir))
    return cost.select("order_id", "symbol", "shares", "days_held",
                       r6("participation_rate").alias("participation_rate"),
                       r6("permanent_impact", 8).alias("permanent_impact"),
                       r6("temporary_impact", 8).alias("temporary_impact"))


@query(f"""WITH {_COST_SQL}, c AS (
  SELECT symbol, notional, notional * commission AS commission, notional * spread / 2 AS spread,
         notional * (abs(perm) / 2 + abs(temp)) AS impact FROM cost)
SELECT symbol, count(*) AS orders, round(sum(commission), 3) AS commission,
       round(sum(spread), 3) AS spread, round(sum(impact), 3) AS impact,
       round(1e4 * sum(commission + spread + impact) / sum(notional), 6) AS cost_bps
FROM c GROUP BY 1""")
def trade_costs(spark, sf_dir):
    """Execution cost of every order line, summed per instrument."""
    cost = costs.trade_costs(b.trades(spark, sf_dir), b.instruments(spark, sf_dir))
    traded = F.sum(F.when(F.col("total_bps") > 0, 1e4 * F.col("total") / F.col("total_bps")))
    return cost.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("orders"), r6(F.sum("commission"), 3).alias("commission"),
        r6(F.sum("spread"), 3).alias("spread"), r6(F.sum("impact"), 3).alias("impact"),
        r6(1e4 * F.sum("total") / traded).alias("cost_bps"))


@query(f"""WITH {b.INSTRUMENTS_SQL}
SELECT order_id, symbol, shares, days_held,
       shares < 0 AND abs(shares) > borrow_available AS refused,
       CASE WHEN shares < 0 AND abs(shares) <= borrow_available
            THEN round(abs(shares) * price * borrow_fee_annual * days_held / 365, 6)
            WHEN shares >= 0 THEN 0 END AS borrow_fee
FROM trades JOIN instruments USING (symbol)""")
def borrow_check(spark, sf_dir):
    """Shorts beyond the borrow available are refused; the rest pay a fee."""
    decided = costs.borrow_decisions(b.trades(spark, sf_dir), b.instruments(spark, sf_dir))
    return decided.select("order_id", "symbol", "shares", "days_held", "refused",
                          r6("borrow_fee").alias("borrow_fee"))


def _net_sql(aum: str) -> str:
    rate = f"({aum} * {TURNOVER} / 252 / price / adv)"
    return (f"({GROSS} - ({TURNOVER} / 252 * (commission + spread / 2 + daily_volatility * "
            f"(0.314 * {rate} * pow(shares_outstanding / adv, 0.25) / 2 + 0.142 * pow({rate}, 0.6)))"
            f" * 252) / (daily_volatility * sqrt(252)))")


_ROUNDS_SQL = f"""{b.INSTRUMENTS_SQL}, bracket AS (
  SELECT 0 AS k, symbol, 1.0::DOUBLE AS lo, 1e11::DOUBLE AS hi FROM instruments
  UNION ALL
  SELECT k + 1, symbol, CASE WHEN net >= {GROSS} * 0.5 THEN mid ELSE lo END,
         CASE WHEN net >= {GROSS} * 0.5 THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, sqrt(lo * hi) AS mid, i.*, {_net_sql('sqrt(lo * hi)')} AS net
        FROM bracket JOIN instruments i USING (symbol) WHERE hi / lo >= 1.0001)),
ceilings AS (SELECT i.*, CASE WHEN {_net_sql('1e11')} >= {GROSS} * 0.5 THEN 'Infinity'::DOUBLE
             ELSE b.lo END AS aum_ceiling
             FROM instruments i JOIN (SELECT symbol, max_by(lo, k) AS lo FROM bracket GROUP BY 1) b
             USING (symbol))"""


@query(f"""WITH RECURSIVE {_ROUNDS_SQL}
SELECT symbol, round(aum_ceiling, 4) AS aum_ceiling FROM ceilings""")
def capacity(spark, sf_dir):
    """AUM at which costs leave half of the gross Sharpe."""
    out = costs.capacity(b.instruments(spark, sf_dir), GROSS, TURNOVER)
    return out.select("symbol", r6("aum_ceiling", 4).alias("aum_ceiling"))


@query(f"""WITH RECURSIVE {_ROUNDS_SQL}
SELECT symbol, aum, round({_net_sql('aum')}, 6) AS net_sharpe
FROM ceilings, (SELECT pow(10.0, e)::DOUBLE AS aum FROM range(5, 12) r(e)) d
WHERE aum_ceiling < 'Infinity'::DOUBLE AND aum <= least(aum_ceiling * 100, 1e11)""")
def capacity_curve(spark, sf_dir):
    ceilings = costs.capacity(b.instruments(spark, sf_dir), GROSS, TURNOVER)
    return costs.capacity_curve(ceilings, GROSS, TURNOVER).withColumn("net_sharpe",
                                                                      r6("net_sharpe"))


@query(f"""WITH RECURSIVE {_ROUNDS_SQL}, orders_of AS (
  SELECT symbol, sum(abs(shares)) AS shares FROM trades GROUP BY 1)
SELECT symbol, round(abs(shares) / adv, 6) AS participation_rate,
       round(1e4 * (commission + spread / 2 + daily_volatility * (0.314 * shares / adv
         * pow(shares_outstanding / adv, 0.25) / 2 + 0.142 * pow(shares / adv, 0.6))), 6) AS cost_bps,
       round(aum_ceiling, 4) AS aum_ceiling
FROM ceilings JOIN orders_of USING (symbol)""")
def cost_and_capacity(spark, sf_dir):
    """Cost of trading each instrument's whole order flow at once, beside its capacity."""
    market = b.instruments(spark, sf_dir)
    flow = b.trades(spark, sf_dir).groupBy("symbol").agg(F.sum(F.abs("shares")).alias("shares"))
    cost = costs.trade_costs(flow, market).select("symbol", "participation_rate", "total_bps")
    ceilings = costs.capacity(market, GROSS, TURNOVER).select("symbol", "aum_ceiling")
    return cost.join(ceilings, "symbol").select(
        "symbol", r6("participation_rate").alias("participation_rate"),
        r6("total_bps").alias("cost_bps"), r6("aum_ceiling", 4).alias("aum_ceiling"))


@query("""SELECT CASE WHEN p_retailprice - 900 <= 0 THEN 'price must be positive'
    WHEN p_size - 1 <= 0 THEN 'adv must be positive' END AS reason, count(*) AS instruments
FROM part GROUP BY 1""")
def instrument_validation(spark, sf_dir):
    """Instruments without a positive price, volume, volatility or share count."""
    parts = b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("symbol"),
        (F.col("p_retailprice") - 900).alias("price"), (F.col("p_size") - 1.0).alias("adv"),
        F.lit(0.02).alias("daily_volatility"), F.lit(1e6).alias("shares_outstanding"))
    good, bad = validation.split_instruments(parts)
    return (good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
            .groupBy("reason").agg(F.count(F.lit(1)).alias("instruments")))
