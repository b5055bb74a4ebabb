"""Climatological reference forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.constants import POLLUTANTS
from hazeline.operators.daily import unpivot
from hazeline.operators.ordered import exact_percentiles
from hazeline.session import durable

# Fallback chain, finest level first; columns not in a level hold a placeholder.
LEVELS = (("station", "month", "hour"), ("station", "month"), ("month", "hour"), ("month",), ())
LAST_RESORT = 50.0


def climatology_median(train_obs: DataFrame) -> DataFrame:
    """Exact medians of every pollutant at the five levels (level 0 is the finest).

    One expansion and one distributed sort serve all levels; even the overall median never
    meets in a single task.
    """
    rows = unpivot(
        train_obs.select("station", F.month("ts").alias("month"), F.hour("ts").alias("hour"), *POLLUTANTS),
        ["station", "month", "hour"], list(POLLUTANTS),
    ).where("value IS NOT NULL")
    counted = rows.groupBy("station", "month", "hour", "pollutant", "value").agg(F.count(F.lit(1)).alias("_m"))
    blank = {"station": F.lit("*"), "month": F.lit(-1), "hour": F.lit(-1)}
    level = F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), *[
            (F.col(c) if c in keys else blank[c]).alias(c) for c in blank
        ]) for i, keys in enumerate(LEVELS)
    ]))
    expanded = counted.select("pollutant", "value", "_m", level.alias("k")).select("pollutant", "value", "_m", "k.*")
    medians = exact_percentiles(
        expanded, ["pollutant", "level", "station", "month", "hour"], "value", {"median": 0.5}, weight="_m")
    return medians.select("pollutant", "level", "station", "month", "hour", "median", "n_values")


def climatology_lookup(samples: DataFrame, medians: DataFrame, valid_time: str = "valid_time") -> DataFrame:
    """Adds `clim_<pollutant>` by the fallback chain (finest level present wins).

    The medians become one small table (at most stations x 12 x 24 rows at the finest level),
    written once; each level is a join on it, broadcast by Spark when its size allows. The
    overall median is spread over the twelve months, so the last two levels are one join.
    """
    wide = durable(medians.groupBy("level", "station", "month", "hour").agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("median"))).alias(p) for p in POLLUTANTS]))
    out = samples.withColumns({"_month": F.month(valid_time), "_hour": F.hour(valid_time)})
    keymap = {"station": "station", "month": "_month", "hour": "_hour"}
    for i, keys in enumerate(LEVELS[:3]):
        table = wide.where(F.col("level") == i).select(
            *[F.col(k).alias(keymap[k]) for k in keys], *[F.col(p).alias(f"_c{i}_{p}") for p in POLLUTANTS])
        out = out.join(table, [keymap[k] for k in keys], "left")
    spread = F.when(F.col("level") == 3, F.array("month")).otherwise(F.sequence(F.lit(1), F.lit(12)))
    months = wide.where(F.col("level") >= 3).withColumn("_month", F.explode(spread)).groupBy("_month").agg(*[
        F.min_by(p, F.when(F.col(p).isNotNull(), F.col("level"))).alias(f"_c3_{p}") for p in POLLUTANTS])
    out = out.join(months, "_month", "left")
    out = out.withColumns({
        f"clim_{p}": F.coalesce(*[F.col(f"_c{i}_{p}") for i in range(4)], F.lit(LAST_RESORT)) for p in POLLUTANTS
    })
    return out.drop("_month", "_hour", *[f"_c{i}_{p}" for i in range(4) for p in POLLUTANTS])


def climatology_rate(train: DataFrame, test: DataFrame, label: str, by: list[str], out: str = "p_clim") -> DataFrame:
    """Monthly event rate of the training rows per group, its overall rate where a month is new, else 0."""
    seen = train.where(F.col(label).isNotNull())
    monthly = seen.groupBy(*by, "month").agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    overall = monthly.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    got = test.join(monthly, [*by, "month"], "left").join(overall, list(by), "left")
    return got.withColumn(out, F.coalesce(F.col("_s") / F.col("_n"), F.col("_all"), F.lit(0.0))).drop("_s", "_n", "_all")


def climatology_expanding(daily: DataFrame, forecasts: DataFrame, events: dict[str, float]) -> DataFrame:
    """Event rates over all positive days up to the as-of date: target month, else every month.

    Counts per day are summed first; the running windows then see one row per calendar day.
    """
    per_day = daily.where(F.col("aqi") > 0).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("aqi") >= v).alias(e) for e, v in events.items()])
    asked = forecasts.select(F.col("date"), F.month("target_date").alias("month")).distinct()
    facts = per_day.withColumn("month", F.month("date")).withColumn("_ask", F.lit(False))
    probes = asked.withColumn("_ask", F.lit(True))
    both = facts.unionByName(probes, allowMissingColumns=True)
    run_m = Window.partitionBy("month").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Every calendar day once: a few hundred rows per year, whatever the number of stations.
    run_a = Window.partitionBy(F.lit(0)).orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["n", *events]
    summed = both.withColumns(
        {f"m_{c}": F.sum(c).over(run_m) for c in names} | {f"a_{c}": F.sum(c).over(run_a) for c in names}
    ).where("_ask")
    rate = {
        f"clim_{e}": F.when(F.col("m_n") > 0, F.col(f"m_{e}") / F.col("m_n"))
        .when(F.col("a_n") > 0, F.col(f"a_{e}") / F.col("a_n")).otherwise(0.0)
        for e in events
    }
    rates = summed.select("date", "month", *[c.alias(n) for n, c in rate.items()])
    return forecasts.withColumn("month", F.month("target_date")).join(rates, ["date", "month"], "left").drop("month")


def persistence_event(index, threshold: float, on_missing: float | None = None):
    """Today's event state as the forecast; missing state is null or the given value."""
    state = F.when(index.isNotNull(), (index >= threshold).cast("double"))
    return state if on_missing is None else F.coalesce(state, F.lit(float(on_missing)))
