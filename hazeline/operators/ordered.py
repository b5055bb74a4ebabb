"""Order-dependent operators that never hold a whole group in one task.

Two tools are used throughout the package:

* `place` range-partitions rows by (group, order). A large group is spread over many
  tasks; per-task prefix results are joined to the few carried values that cross a task
  border (at most one group crosses each border, so that table is broadcast safely).
* time buckets with a halo: rows of a bounded look-back window are repeated in the next
  bucket, so windows run per (key, bucket) instead of per key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.clock import micros
from hazeline.functions.numeric import window_avg
from hazeline.session import durable

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class Placed:
    """Rows range-placed by (group, order); `_slot` is the place."""

    df: DataFrame
    group: tuple[str, ...]
    order: tuple[str, ...]

    def _local(self) -> Window:
        return Window.partitionBy("_slot", *self.group).orderBy(*self.order)

    def _earlier_slots(self) -> Window:
        w = Window.partitionBy(*self.group) if self.group else Window.partitionBy(F.lit(0))
        return w.orderBy("_slot")

    def _attach(self, border: DataFrame) -> DataFrame:
        """Join border values: at most two rows per task border, hence the broadcast."""
        return self.df.join(F.broadcast(border), ["_slot", *self.group], "left")

    def running(self, amounts: dict[str, Column]) -> "Placed":
        """Adds inclusive prefix sums `name` and group totals `name_total`."""
        df = self.df.withColumns({f"_a_{n}": c for n, c in amounts.items()})
        here = replace(self, df=df)
        per_slot = df.groupBy("_slot", *self.group).agg(
            *[F.sum(f"_a_{n}").alias(f"_s_{n}") for n in amounts], F.count(F.lit(1)).alias("_rows")
        )
        w = self._earlier_slots()
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        border = (
            per_slot.select(
                "_slot", *self.group,
                *[F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in amounts],
                *[F.sum(f"_s_{n}").over(every).alias(f"_t_{n}") for n in amounts],
                F.count(F.lit(1)).over(every).alias("_slots"),
            )
            .where("_slots > 1")
            .drop("_slots")
        )
        local = self._local()
        upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("_slot", *self.group)
        out = here._attach(border).withColumns(
            {n: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.sum(f"_a_{n}").over(upto) for n in amounts}
            | {f"{n}_total": F.coalesce(F.col(f"_t_{n}"), F.sum(f"_a_{n}").over(whole)) for n in amounts}
        )
        return replace(self, df=out.drop(*[f"_{k}_{n}" for n in amounts for k in "abt"]))

    def previous(self, columns: dict[str, str]) -> "Placed":
        """Adds `name` = value of the source column on the row before, in group order."""
        sources = list(columns.values())
        packed = F.struct(*[F.col(s).alias(f"v{i}") for i, s in enumerate(sources)])
        last = self.df.groupBy("_slot", *self.group).agg(
            F.max_by(packed, F.struct(*self.order)).alias("_last")
        )
        border = last.select(
            "_slot", *self.group, F.lag("_last").over(self._earlier_slots()).alias("_carry")
        ).where("_carry IS NOT NULL")
        out = self._attach(border).withColumn("_prev", F.lag(packed).over(self._local()))
        picked = F.coalesce("_prev", "_carry")
        out = out.withColumns({n: picked[f"v{i}"] for i, n in enumerate(columns)})
        return replace(self, df=out.drop("_prev", "_carry"))

    def rows(self) -> DataFrame:
        return self.df.drop("_slot")


def place(df: DataFrame, group: list[str], order: list[str], slots: int | None = None) -> Placed:
    """Spread rows by range of (group, order) and fix the placement durably."""
    spark = df.sparkSession
    n = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    placed = df.repartitionByRange(n, *keys).withColumn("_slot", F.spark_partition_id())
    return Placed(durable(placed), tuple(group), tuple(order))


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Distributed `row_number`; also adds the group size as `<name>_total`."""
    return place(df, group, order).running({name: F.lit(1)}).rows()


def ranked_values(
    values: DataFrame, group: list[str], value: str, weight: str | None = None,
    probes: DataFrame | None = None, probe: str | None = None, inclusive: str | None = None,
) -> DataFrame:
    """Distinct values per group with running counts, and optionally probe rows among them.

    Equal values are counted before the shuffle. A probe row carries its other columns in
    `_p` and, as `_upto`, how many values lie below it (or up to it where `inclusive`).
    """
    counted = (
        values.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_x"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("_n"))
        .withColumn("_k", F.lit(1))
    )
    if probes is None:
        return place(counted, group, ["_x"]).running({"_upto": F.col("_n")}).rows()
    extra = [c for c in probes.columns if c not in group and c != probe]
    asked = probes.select(
        *group, F.col(probe).alias("_x"), F.lit(0).cast("long").alias("_n"),
        F.when(F.col(inclusive), 2).otherwise(0).alias("_k"), F.struct(*extra).alias("_p"),
    )
    both = counted.unionByName(asked, allowMissingColumns=True)
    return place(both, group, ["_x", "_k"]).running({"_upto": F.col("_n")}).rows()


def percentiles_of(ranked: DataFrame, group: list[str], probs: dict[str, float], ends: bool = False) -> DataFrame:
    """Linear-interpolated percentiles read off `ranked_values`.

    With `ends` each one is struct(lo, hi, frac), for callers that transform the two order
    statistics before interpolating.
    """
    first, size = F.col("_upto") - F.col("_n"), F.col("_upto_total")
    aggs, wanted = [], F.lit(False)
    for name, p in probs.items():
        at = F.lit(float(p)) * (size - 1)
        lo, hi = F.floor(at), F.ceil(at)
        is_lo = (first <= lo) & (lo < F.col("_upto"))
        is_hi = (first <= hi) & (hi < F.col("_upto"))
        wanted = wanted | is_lo | is_hi
        aggs += [
            F.max(F.when(is_lo, F.col("_x"))).alias(f"_lo_{name}"),
            F.max(F.when(is_hi, F.col("_x"))).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_f_{name}"),
        ]
    picked = ranked.where((F.col("_k") == 1) & wanted).groupBy(*group).agg(*aggs, F.max(size).alias("n_values"))

    def result(n: str) -> Column:
        lo, hi, f = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_f_{n}")
        if ends:
            return F.struct(lo.alias("lo"), hi.alias("hi"), f.alias("frac")).alias(n)
        return (lo + f * (hi - lo)).alias(n)

    return picked.select(*group, *[result(n) for n in probs], "n_values")


def exact_percentiles(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact percentiles per group, for groups of any size; `weight` counts a row that many times."""
    return percentiles_of(ranked_values(df, group, value, weight), group, probs)


def probe_counts(ranked: DataFrame, group: list[str], probe: str) -> DataFrame:
    """The probe rows of `ranked_values` with `n_below` and the group's `n_values`."""
    return ranked.where("_k <> 1").select(
        *group, "_p.*", F.col("_x").alias(probe),
        F.col("_upto").alias("n_below"), F.col("_upto_total").alias("n_values"),
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in a total order, by a combinable aggregate (no window)."""
    rest = [c for c in df.columns if c not in keys]
    payload = F.struct(*rest)
    best = df.groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def with_halo(df: DataFrame, unit: Column, width: int, reach: int) -> DataFrame:
    """Adds `_bucket` and `_home`: each row in its own bucket and in later ones it can reach.

    `unit` is an integer position (microseconds, hours or days); a window looking back at
    most `reach` units can then run per bucket.
    """
    own = F.floor(unit / width).cast("long")
    last = F.floor((unit + reach) / width).cast("long")
    return (
        df.withColumn("_own", own)
        .withColumn("_bucket", F.explode(F.sequence(own, last)))
        .withColumn("_home", F.col("_bucket") == F.col("_own"))
        .drop("_own")
    )


def rolling_mean(
    df: DataFrame, keys: list[str], ts: str, value: str, out: str,
    window_us: int, min_count: int = 1,
) -> DataFrame:
    """Trailing right-closed mean over (t - window, t]; null below `min_count` values."""
    base = with_halo(df.withColumn("_us", micros(ts)), F.col("_us"), 2 * window_us, window_us)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-(window_us - 1), 0)
    return (
        base.withColumn("_n", F.count(F.col(value)).over(w))
        .withColumn(out, F.when(F.col("_n") >= min_count, window_avg(F.col(value), w)))
        .where("_home")
        .drop("_us", "_bucket", "_home", "_n")
    )


def asof_within(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str,
    columns: dict[str, str], lookback_us: int,
) -> DataFrame:
    """Backward as-of join, at most `lookback_us` old (closed), each column on its own.

    `columns` maps output names to columns of `right`; nulls are skipped.
    """
    rest = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(*keys, ts, F.struct(*rest, F.lit(1).alias("_mark")).alias("_left"))
    r = right.select(*keys, ts, *[F.col(s).alias(n) for n, s in columns.items()])
    r = with_halo(r.withColumn("_us", micros(ts)), F.col("_us"), 2 * lookback_us, lookback_us)
    l = l.withColumn("_us", micros(ts)).withColumn(
        "_bucket", F.floor(F.col("_us") / (2 * lookback_us)).cast("long")
    )
    both = l.unionByName(r.drop("_home"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-lookback_us, 0)
    return (
        both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in columns})
        .where("_left IS NOT NULL")
        .select(*keys, ts, *[f"_left.{c}" for c in rest], *columns)
    )


def asof_any_age(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str,
    columns: dict[str, str], bucket_us: int = 32 * DAY_US,
) -> DataFrame:
    """Backward as-of join without age limit, each column on its own, nulls skipped.

    Values are looked up inside a time bucket first; what is missing comes from a small
    table of last values per bucket, carried forward.
    """
    rest = [c for c in left.columns if c not in (*keys, ts)]
    bucket = F.floor(F.col("_us") / bucket_us).cast("long")
    l = left.select(*keys, ts, F.struct(*rest, F.lit(1).alias("_mark")).alias("_left"))
    r = right.select(*keys, ts, *[F.col(s).alias(n) for n, s in columns.items()])
    both = (
        l.unionByName(r, allowMissingColumns=True)
        .withColumn("_us", micros(ts))
        .withColumn("_bucket", bucket)
    )
    ends = both.groupBy(*keys, "_bucket").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_us"))).alias(n) for n in columns]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_bucket", *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in columns]
    )
    w = (
        Window.partitionBy(*keys, "_bucket").orderBy("_us")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in columns})
        .where("_left IS NOT NULL")
        .join(carried, [*keys, "_bucket"], "left")
        .select(
            *keys, ts, *[f"_left.{c}" for c in rest],
            *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in columns],
        )
    )


def previous_time(df: DataFrame, keys: list[str], ts: str, out: str, bucket_us: int = 32 * DAY_US) -> DataFrame:
    """Previous timestamp per key (rows unique per key and time), bucket by bucket."""
    base = df.withColumn("_us", micros(ts)).withColumn("_bucket", F.floor(F.col("_us") / bucket_us).cast("long"))
    ends = base.groupBy(*keys, "_bucket").agg(F.max(ts).alias("_end"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*keys, "_bucket", F.lag("_end").over(by_bucket).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_us")
    return (
        base.withColumn("_lag", F.lag(ts).over(inside))
        .join(carried, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_us", "_bucket", "_lag", "_carry")
    )


def calendar_shift(
    df: DataFrame, keys: list[str], date: str, value: str, shifts: dict[str, int]
) -> DataFrame:
    """Adds, per output name, the value exactly `days` later (negative: earlier) or null.

    Each row sends its value to the days that ask for it, so all lags and leads come out of
    one grouped shuffle; a missing day stays missing.
    """
    rest = [c for c in df.columns if c not in (*keys, date)]
    names = list(shifts)
    sends = F.array(
        F.struct(F.lit(-1).alias("k"), F.lit(0).alias("d")),
        *[F.struct(F.lit(i).alias("k"), F.lit(-shifts[n]).alias("d")) for i, n in enumerate(names)],
    )
    sent = df.withColumn("_s", F.explode(sends)).select(
        *keys,
        F.date_add(F.col(date), F.col("_s.d")).alias(date),
        F.when(F.col("_s.k") == -1, F.struct(*rest)).alias("_own"),
        *[F.when(F.col("_s.k") == i, F.col(value)).alias(n) for i, n in enumerate(names)],
    )
    met = sent.groupBy(*keys, date).agg(
        F.any_value("_own", True).alias("_own"), *[F.max(n).alias(n) for n in names]
    )
    return met.where("_own IS NOT NULL").select(*keys, date, "_own.*", *names)
