"""Evaluation of daily event forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.numeric import fixed_point, round_half_even
from hazeline.operators.climatology import climatology_expanding, climatology_rate, persistence_event
from hazeline.operators.features import EVENTS
from hazeline.operators.verify import SCALE, brier_skill, event_flag, roll_up, square_error

FEATURES = ("aqi_t", "aqi_t_minus_1", "month_sin", "month_cos")
POOLED = "pooled"


def experiment_rows(labelled: DataFrame, horizons=(1, 2, 3), events: dict[str, float] = EVENTS) -> DataFrame:
    """One row per experiment (each station and all pooled), event, horizon and usable day."""
    usable = labelled
    for f in FEATURES:
        usable = usable.where(F.col(f).isNotNull())
    cells = F.explode(F.array(*[
        F.struct(F.lit(e).alias("event"), F.lit(v).alias("threshold"), F.lit(h).alias("horizon"), F.col(f"y_{e}_h{h}").alias("y"))
        for e, v in events.items() for h in horizons
    ]))
    keep = ["part", "station", "date", "month", *FEATURES]
    long = usable.select(*keep, cells.alias("c")).select(*keep, "c.*").where("y IS NOT NULL")
    return long.withColumn("experiment", F.explode(F.array(F.col("station"), F.lit(POOLED))))


def reference_forecasts(rows: DataFrame) -> DataFrame:
    """Test rows with monthly climatology and persistence probabilities."""
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    by = ["experiment", "event", "horizon"]
    out = climatology_rate(train, test, "y", by)
    return out.withColumn("p_pers", persistence_event(F.col("aqi_t"), F.col("threshold")))


def experiment_grid(rows: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Counts, status, Brier scores and skills per experiment, event and horizon.

    `scored` are test rows with p_clim, p_pers and optionally p_model.
    """
    by = ["experiment", "event", "horizon"]
    scored = reference_forecasts(rows) if scored is None else scored
    models = [m for m in ("clim", "pers", "model") if f"p_{m}" in scored.columns]
    counts = rows.groupBy(*by).agg(
        F.count_if(F.col("part") == "train").alias("train_days"), F.count_if(F.col("part") == "test").alias("test_days"),
        F.sum(F.when(F.col("part") == "test", F.col("y")).otherwise(0.0)).cast("long").alias("events"),
    )
    unit = float(10**SCALE)
    scores = scored.groupBy(*by).agg(*[
        (F.sum(fixed_point(square_error(F.col("y"), F.col(f"p_{m}")), SCALE)).cast("double") / unit / F.count(f"p_{m}")).alias(f"b_{m}")
        for m in models
    ])
    none = (F.col("test_days") == 0) | (F.col("train_days") == 0)
    out = counts.join(scores, by, "left").withColumn(
        "status", F.when(none, "no data").otherwise(event_flag(F.col("events"))))
    cols = {f"brier_{m}": F.when(~none, round_half_even(F.col(f"b_{m}"), 5)) for m in models}
    for m in models:
        if m != "clim":
            cols[f"bss_{m}_vs_clim"] = F.when(~none, round_half_even(brier_skill(F.col(f"b_{m}"), F.col("b_clim")), 4))
    if "model" in models:
        cols["bss_model_vs_pers"] = F.when(~none, round_half_even(brier_skill(F.col("b_model"), F.col("b_pers")), 4))
    return out.select(*by, "status", "test_days", "events", *[c.alias(n) for n, c in cols.items()])


def with_references(forecasts: DataFrame, daily: DataFrame, events: dict[str, float] = EVENTS) -> DataFrame:
    """Verifiable forecasts with outcomes, persistence and expanding climatology per event.

    Expects station, date (as-of), horizon, target_date, q10, q90, p_<event>.
    """
    seen = daily.select("station", F.col("date").alias("target_date"), F.col("aqi").alias("observed_aqi"))
    today = daily.select("station", "date", F.col("aqi").alias("_today"))
    rows = forecasts.join(seen, ["station", "target_date"], "inner").where("observed_aqi IS NOT NULL")
    rows = climatology_expanding(daily, rows.join(today, ["station", "date"], "left"), events)
    return rows.withColumns(
        {f"y_{e}": (F.col("observed_aqi") >= v).cast("double") for e, v in events.items()}
        | {f"pers_{e}": persistence_event(F.col("_today"), v, 0.0) for e, v in events.items()}
    ).drop("_today")


def daily_evaluation(rows: DataFrame, events: dict[str, float] = EVENTS) -> DataFrame:
    """Coverage, Brier scores and skills overall (horizon 'all') and by horizon."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("q10") <= F.col("observed_aqi")) & (F.col("observed_aqi") <= F.col("q90"))).alias("inside"),
    ]
    for e in events:
        aggs.append(F.sum(F.col(f"y_{e}").cast("long")).alias(f"n_{e}"))
        for kind, c in (("model", f"p_{e}"), ("pers", f"pers_{e}"), ("clim", f"clim_{e}")):
            aggs.append(F.sum(fixed_point(square_error(F.col(f"y_{e}"), F.col(c)), SCALE)).alias(f"{kind}_{e}"))
    sums = roll_up(rows.groupBy(F.col("horizon").cast("string").alias("horizon")).agg(*aggs), [], "horizon", "all")
    unit = float(10**SCALE)

    def score(kind: str, e: str) -> Column:
        return F.col(f"{kind}_{e}").cast("double") / unit / F.col("n")

    out = [
        F.col("n").alias("n_forecasts"),
        round_half_even(F.col("inside") / F.col("n"), 4).alias("coverage_80"),
    ]
    for e in events:
        out.append(F.col(f"n_{e}").alias(f"n_events_{e}"))
        out.append(event_flag(F.col(f"n_{e}")).alias(f"flag_{e}"))
        out += [round_half_even(score(k, e), 4).alias(f"brier_{k}_{e}") for k in ("model", "pers", "clim")]
        out += [round_half_even(brier_skill(score("model", e), score(k, e), True), 4).alias(f"bss_{e}_vs_{k}") for k in ("pers", "clim")]
    return sums.select("horizon", *out)
