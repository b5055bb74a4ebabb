"""Held-out verification: all candidate forecasts as columns of one sample table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.constants import POLLUTANTS
from hazeline.operators import bias as bs
from hazeline.operators.climatology import climatology_lookup, climatology_median
from hazeline.operators.features import hours_ahead, samples_of_hours
from hazeline.session import durable


def bias_columns(bias: DataFrame) -> DataFrame:
    """(station, issue_time, pollutant, bias_7d) to one column per pollutant."""
    return bias.groupBy("station", "issue_time").agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("bias_7d"))).alias(f"bias_{p}") for p in POLLUTANTS])


def with_candidates(issues: DataFrame, obs: DataFrame, drivers: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Samples with bias, corrected driver and lead blend per pollutant; further columns of issues and hours are kept."""
    bias = bias_columns(bs.bias_at_issue(issues, durable(bs.rolling_bias_7d(obs, drivers))))
    known = issues.join(bias, ["station", "issue_time"], "left")
    out = samples_of_hours(known, obs, hours_ahead(obs, drivers) if hours is None else hours)
    corrected = {f"bc_{p}": bs.driver_bias_corrected(F.col(f"driver_{p}"), F.col(f"bias_{p}")) for p in POLLUTANTS}
    out = out.withColumns(corrected)
    return out.withColumns({
        f"blend_{p}": bs.lead_blend(F.col(f"last_obs_{p}"), F.col(f"bc_{p}"), p, F.col("lead_h")) for p in POLLUTANTS
    })


def evaluation_table(issues: DataFrame, obs: DataFrame, drivers: DataFrame, train_obs: DataFrame) -> DataFrame:
    """Candidates plus climatology from the training observations, which depends on the valid hour alone."""
    hours = climatology_lookup(hours_ahead(obs, drivers), climatology_median(train_obs))
    return with_candidates(issues, obs, drivers, hours)
