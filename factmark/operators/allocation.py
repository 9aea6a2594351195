"""Kelly sizing from bet logs and from panels of returns, and scenario shocks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import HALF_KELLY, fractional_kelly, growth_rate, kelly_fraction
from ..session import Scratch, materialise

# The starting set of shocks (name, return multiplier, volatility multiplier).
SCENARIOS = [
    ("market_crash", -2.0, 3.0),
    ("recession", -1.5, 2.0),
    ("high_volatility", 0.8, 2.5),
    ("bull_market", 1.5, 0.8),
]


def bet_kelly(bets: DataFrame, fraction: float = HALF_KELLY) -> DataFrame:
    """Win rate, win/loss ratio and sizing per strategy from (strategy, win, amount)."""
    per = bets.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_bets"),
        F.avg(F.col("win").cast("double")).alias("win_prob"),
        (F.avg(F.when(F.col("win"), F.col("amount")))
         / F.nullif(F.avg(F.when(~F.col("win"), F.col("amount"))), F.lit(0.0))
         ).alias("win_loss_ratio"))
    p, b = F.col("win_prob"), F.col("win_loss_ratio")
    sized = per.withColumn("kelly", kelly_fraction(p, b)).withColumn(
        "fractional_kelly", fractional_kelly(F.col("kelly"), fraction))
    bet = F.greatest(F.col("fractional_kelly"), F.lit(0.0))
    return sized.withColumn("growth", growth_rate(bet, p, b))


MOMENTS = ("portfolio_id string, n_dates long, status string, assets array<string>, "
           "mean array<double>, covariance array<double>, weights array<double>, variance double")
#: Figures (dates x assets) of a portfolio that one task may hold and solve directly.
DENSE = 2_000_000


def return_moments(returns: DataFrame, risk_free_rate: float = 0.0,
                   dense: int = DENSE) -> DataFrame:
    """Means, sample covariance and Kelly weights inv(S)(mu - r) per portfolio.

    ``returns`` is (portfolio_id, entity_id, effective_date, ret). Only dates on which
    every asset of the portfolio traded are used. ``status`` says why a portfolio has no
    weights: fewer than two dates, singular, or not positive semi-definite. A covariance of
    no fewer assets than dates is singular by its rank, so none is built. ``variance`` is
    that of the portfolio at its full weights.

    A portfolio of at most ``dense`` figures is solved in one task. A larger one never
    lies in one: its weights come from conjugate gradients over its rows
    (``weights_by_gradient``), and ``covariance`` is null.
    """
    clean = returns.where(F.col("ret").isNotNull()).select(
        "portfolio_id", "entity_id", "effective_date", "ret")
    # Two levels, so that one wide portfolio is counted by many tasks.
    sizes = materialise(
        clean.groupBy("portfolio_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_assets")), "sizes")
    whole = (clean.groupBy("portfolio_id", "effective_date").agg(F.count(F.lit(1)).alias("n"))
             .join(sizes, "portfolio_id").where("n = n_assets")
             .groupBy("portfolio_id", "n_assets").agg(F.count(F.lit(1)).alias("n_dates")))
    figures = F.col("n_dates") * F.col("n_assets")
    shape = materialise(whole.withColumn("wide", (figures > dense) & (F.col("n_assets") < F.col("n_dates")))
                        .withColumn("hopeless", F.col("n_assets") >= F.col("n_dates")), "shapes")
    small = shape.where("NOT wide AND NOT hopeless").select("portfolio_id", "n_assets")
    vectors = (clean.join(small, "portfolio_id")
               .groupBy("portfolio_id", "effective_date", "n_assets")
               .agg(F.sort_array(F.collect_list(F.struct("entity_id", "ret"))).alias("v"))
               .where(F.size("v") == F.col("n_assets"))
               .select("portfolio_id", F.col("v.entity_id").alias("assets"),
                       F.col("v.ret").alias("x")))

    def solve(pdf):
        import numpy as np
        import pandas as pd
        x = np.array(pdf["x"].tolist(), dtype=float)
        mean, assets = x.mean(axis=0), list(pdf["assets"].iloc[0])
        row = {"portfolio_id": pdf["portfolio_id"].iloc[0], "n_dates": len(x), "assets": assets,
               "mean": mean.tolist(), "covariance": None, "weights": None, "variance": None}
        cov = np.atleast_2d(np.cov(x, rowvar=False, ddof=1))
        row["covariance"] = cov.ravel().tolist()
        spectrum = np.linalg.eigvalsh(cov)
        status = "solved"
        if spectrum.min() < -1e-10 * max(1.0, np.abs(spectrum).max()):
            status = "not positive semi-definite"
        else:
            try:
                weights = np.linalg.solve(cov, mean - risk_free_rate)
                row["weights"], row["variance"] = weights.tolist(), float(weights @ cov @ weights)
            except np.linalg.LinAlgError:
                status = "singular"
        return pd.DataFrame([{**row, "status": status}])

    solved = vectors.groupBy("portfolio_id").applyInPandas(solve, MOMENTS)
    rest = [solved, _hopeless(clean, shape)]
    if not shape.where("wide").isEmpty():
        rest.append(weights_by_gradient(clean.join(shape.where("wide").select("portfolio_id"),
                                                   "portfolio_id"), risk_free_rate))
    out = rest[0]
    for other in rest[1:]:
        out = out.unionByName(other)
    return out


def _hopeless(clean: DataFrame, shape: DataFrame) -> DataFrame:
    """Portfolios whose covariance has no inverse whatever its values, with their means."""
    few = F.when(F.col("n_dates") < 2, "fewer than two dates").otherwise("singular")
    rows = clean.join(shape.where("hopeless"), "portfolio_id")
    kept = _whole_dates(rows)
    per = kept.groupBy("portfolio_id", "entity_id", "n_dates").agg(F.avg("ret").alias("mean"))
    listed = F.sort_array(F.collect_list(F.struct("entity_id", "mean")))
    return (per.groupBy("portfolio_id", "n_dates").agg(listed.alias("v"))  # a row per asset
            .select("portfolio_id", "n_dates", few.alias("status"),
                    F.col("v.entity_id").alias("assets"), F.col("v.mean").alias("mean"),
                    F.lit(None).cast("array<double>").alias("covariance"),
                    F.lit(None).cast("array<double>").alias("weights"),
                    F.lit(None).cast("double").alias("variance")))


def _whole_dates(rows: DataFrame) -> DataFrame:
    """Rows of the dates on which all ``n_assets`` of their portfolio traded."""
    dates = rows.groupBy("portfolio_id", "effective_date").agg(
        F.count(F.lit(1)).alias("_n"), F.first("n_assets").alias("_all")).where("_n = _all")
    return rows.join(dates.select("portfolio_id", "effective_date"),
                     ["portfolio_id", "effective_date"], "left_semi")


def weights_by_gradient(returns: DataFrame, risk_free_rate: float = 0.0, tolerance: float = 1e-12,
                        rounds: int = 500) -> DataFrame:
    """Kelly weights of wide portfolios without their covariance matrix, as ``MOMENTS``.

    Conjugate gradients, scaled by each asset's variance: S p is X'(X p) / (n - 1), two
    sums over the rows X of centred returns, one by date and one by asset. All portfolios
    advance together, at most ``rounds`` times; one is done when its residual has fallen by
    ``tolerance``. A first descent, to a right side drawn by a hash, meets a
    direction without curvature wherever the covariance is singular, or needs more rounds;
    only portfolios that pass it are solved. Between rounds a row per asset is kept.
    """
    spark, key = returns.sparkSession, ["portfolio_id", "entity_id"]
    with Scratch(spark, "gradient") as scratch:
        counts = (returns.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_assets")))
        rows = scratch.table(_whole_dates(returns.join(counts, "portfolio_id")))
        moments = scratch.table(rows.groupBy(*key).agg(
            F.avg("ret").alias("mean"), F.count(F.lit(1)).alias("n_dates"),
            F.var_samp("ret").alias("own")))
        x = scratch.table(rows.join(moments, key).select(
            *key, "effective_date", (F.col("ret") - F.col("mean")).alias("x"),
            (F.col("n_dates") - 1).alias("free")))
        sign = (F.xxhash64(*key) % 1_000_003) / 1_000_003.0
        probe = _descend(scratch, x, moments.withColumn("r", sign * F.sqrt("own")), 1e-6, rounds)
        firm = probe.groupBy("portfolio_id").agg(F.first("status").alias("_probe"))
        excess = F.col("mean") - F.lit(float(risk_free_rate))
        sound = moments.withColumn("r", excess).join(
            firm.where("_probe = 'solved'").select("portfolio_id"), "portfolio_id", "left_semi")
        solved = _descend(scratch, x, sound, tolerance, rounds)
        state = moments.join(solved.select(*key, "w", "status"), key, "left").withColumn(
            "status", F.coalesce("status", F.lit("singular")))
        done = F.col("status") == "solved"
        listed = F.sort_array(F.collect_list(F.struct("entity_id", "mean", "w")))
        return scratch.table(state.groupBy("portfolio_id", "n_dates", "status").agg(
            listed.alias("v"), F.sum(F.col("w") * excess).alias("_v")).select(  # a row per asset
                "portfolio_id", "n_dates",
                F.when(done, "solved").otherwise("singular").alias("status"),
                F.col("v.entity_id").alias("assets"), F.col("v.mean").alias("mean"),
                F.lit(None).cast("array<double>").alias("covariance"),
                F.when(done, F.col("v.w")).alias("weights"),
                F.when(done, F.col("_v")).alias("variance")), kept=True)


def _descend(scratch: Scratch, x: DataFrame, start: DataFrame, tolerance: float,
             rounds: int) -> DataFrame:
    """``w`` with S w = ``r`` for every portfolio of ``start`` and a status: solved,
    singular, or open where the rounds did not suffice."""
    key = ["portfolio_id", "entity_id"]
    scaled = F.coalesce(F.col("r") / F.nullif("own", F.lit(0.0)), F.lit(0.0))
    state = scratch.table(start.select(
        *key, "own", "r", F.lit(0.0).alias("w"), scaled.alias("p"), scaled.alias("z"),
        F.lit("open").alias("status"), F.lit(None).cast("double").alias("first")))
    for _ in range(rounds):
        live = state.where("status = 'open'")
        if live.isEmpty():
            break
        along = (x.join(live.select(*key, "p"), key).groupBy("portfolio_id", "effective_date")
                 .agg(F.sum(F.col("x") * F.col("p")).alias("y")))
        product = (x.join(along, ["portfolio_id", "effective_date"]).groupBy(*key, "free")
                   .agg(F.sum(F.col("x") * F.col("y")).alias("s"))
                   .select(*key, (F.col("s") / F.col("free")).alias("sp")))
        step = scratch.table(live.join(product, key))
        dots = step.groupBy("portfolio_id").agg(
            F.sum(F.col("r") * F.col("z")).alias("rz"), F.sum(F.col("p") * F.col("sp")).alias("psp"),
            F.sum(F.col("p") * F.col("p") * F.col("own")).alias("flat"))
        curved = F.col("psp") > 1e-13 * F.col("flat")
        alpha = F.when(curved, F.col("rz") / F.col("psp")).otherwise(0.0)
        moved = scratch.table(step.join(dots, "portfolio_id").select(
            *key, "own", "p", (F.col("w") + alpha * F.col("p")).alias("w"),
            (F.col("r") - alpha * F.col("sp")).alias("r"), "rz", curved.alias("curved"),
            F.coalesce("first", "rz").alias("first")).withColumn("z", scaled))
        after = moved.groupBy("portfolio_id").agg(F.sum(F.col("r") * F.col("z")).alias("rz2"))
        beta = F.coalesce(F.col("rz2") / F.nullif("rz", F.lit(0.0)), F.lit(0.0))
        status = (F.when(~F.col("curved") & (F.col("rz") > 0), "singular")
                  .when(F.col("rz2") <= tolerance ** 2 * F.col("first"), "solved").otherwise("open"))
        fresh = moved.join(after, "portfolio_id").withColumn("status", status).withColumn(
            "p", F.col("z") + beta * F.col("p")).select(*state.columns)
        known = state
        state = scratch.table(known.where("status <> 'open'").unionByName(fresh))
        scratch.drop(known, step, moved)
    return state


def kelly_weights(moments: DataFrame, fraction: float = 1.0) -> DataFrame:
    """Long form weights with the cash remainder and leverage kept, not normalised away."""
    scaled = F.transform("weights", lambda w: w * float(fraction))
    total = F.aggregate("w", F.lit(0.0), lambda a, w: a + w)
    gross = F.aggregate("w", F.lit(0.0), lambda a, w: a + F.abs(w))
    solved = moments.where("status = 'solved'").withColumn("w", scaled)
    pairs = F.explode(F.arrays_zip("assets", "w")).alias("p")
    return solved.select("portfolio_id", (1.0 - total).alias("cash_weight"),
                         gross.alias("gross_leverage"), pairs).select(
        "portfolio_id", F.col("p.assets").alias("entity_id"), F.col("p.w").alias("weight"),
        "cash_weight", "gross_leverage", (F.col("cash_weight") < 0).alias("is_levered"))


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SCENARIOS, "scenario string, return_multiplier double, volatility_multiplier double")


def scenario_shocks(moments: DataFrame, shocks: list[tuple] = SCENARIOS,
                    fraction: float = HALF_KELLY) -> DataFrame:
    """Portfolio mean and volatility under each shock, with the weights held fixed.

    The multiplier acts on volatility, so the variance takes its square. Weights come
    from the unshocked moments: re-optimising per shock would not be a stress test.
    """
    dot = F.aggregate(F.zip_with("weights", "mean", lambda w, m: w * m),
                      F.lit(0.0), lambda s, x: s + x)
    base = (moments.where("status = 'solved'")
            .withColumn("base_mean", float(fraction) * dot)
            .withColumn("base_variance", float(fraction) ** 2 * F.col("variance")))
    shock = F.explode(F.array(*[F.struct(
        F.lit(name).alias("scenario"), F.lit(float(m)).alias("m"), F.lit(float(v)).alias("v"))
        for name, m, v in shocks])).alias("s")
    return base.select("portfolio_id", "base_mean", "base_variance", shock).select(
        "portfolio_id", "s.scenario", (F.col("base_mean") * F.col("s.m")).alias("mean_return"),
        (F.sqrt("base_variance") * F.col("s.v")).alias("volatility"))
