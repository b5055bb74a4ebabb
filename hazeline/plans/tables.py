"""The views one query works on; aggregated views are computed once per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazeline.plans import adapters
from hazeline.session import durable, ready

# Hourly and daily tables: small against the raw rows and read several times by a plan.
AGGREGATED = ("obs", "drivers", "daily_long", "stations")


class Tables:
    """Attribute access to the views, e.g. `t.obs`.

    The raw tables are scanned once: an aggregated view is written to the checkpoint folder
    when it is first asked for, and every later use reads that small result.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ready(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = getattr(adapters, name)(self.spark, self.sf_dir)
        if name in AGGREGATED:
            view = durable(view)
        setattr(self, name, view)
        return view
