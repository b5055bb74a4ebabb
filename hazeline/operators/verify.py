"""Verification measures. Sums are taken once per finest group, overlapping groups are rolled up
from those few rows instead of reading the samples again."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.constants import (
    ALL_LEADS, CANDIDATES, INTERVAL_TO_SD, LEAD_BUCKETS, MIN_SD, SEVERE_PM10, SEVERE_PM25,
)
from hazeline.functions.index import category_rank
from hazeline.functions.numeric import (
    erfc, erfc_argument, erfc_text, exact_avg, fixed_point, round_half_even,
)
from hazeline.operators.ordered import place

SCALE = 9


def lead_bucket(lead: Column) -> Column:
    chain = None
    for name, lo, hi in LEAD_BUCKETS:
        inside = (lead >= lo) & (lead <= hi)
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain


def roll_up(sums: DataFrame, by: list[str], bucket: str = "bucket", total: str = ALL_LEADS) -> DataFrame:
    """Adds the overlapping total bucket to a table of sums (a few rows per group)."""
    amounts = [c for c in sums.columns if c not in (*by, bucket)]
    twice = sums.withColumn(bucket, F.explode(F.array(F.col(bucket), F.lit(total))))
    return twice.groupBy(*by, bucket).agg(*[F.sum(c).alias(c) for c in amounts])


def _error_sums(err: Column, name: str) -> list[Column]:
    return [
        F.count(err).alias(f"n_{name}"),
        F.sum(fixed_point(F.abs(err))).alias(f"a_{name}"),
        F.sum(fixed_point(err * err)).alias(f"q_{name}"),
        F.sum(fixed_point(err)).alias(f"s_{name}"),
    ]


def _metrics(name: str) -> dict[str, Column]:
    n = F.col(f"n_{name}")

    def mean(kind: str) -> Column:
        return F.when(n > 0, F.try_divide(F.col(f"{kind}_{name}").cast("double") / 1e6, n))

    return {
        "mae": round_half_even(mean("a"), 2), "rmse": round_half_even(F.sqrt(mean("q")), 2),
        "bias": round_half_even(mean("s"), 2), "n": n,
    }


def continuous_metrics(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, mean bias and count over pairs; null and 0 where there are none."""
    sums = df.groupBy(*by).agg(*_error_sums(F.col(yhat) - F.col(y), "x"))
    return sums.select(*by, *[c.alias(k) for k, c in _metrics("x").items()])


def pollutant_rows(table: DataFrame, models: dict[str, str], extra: dict[str, str] | None = None, pollutants=("pm25", "pm10", "o3", "no2")) -> DataFrame:
    """One row per sample and pollutant: target, one column per model, optional extras.

    `models` maps a model name to a column prefix, e.g. {"persistence": "last_obs_"}.
    """
    named = dict(models) | (extra or {})
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(p).alias("pollutant"), F.col(f"target_{p}").alias("target"),
            *[(F.col(prefix + p) if "{}" not in prefix else F.col(prefix.format(p))).alias(n) for n, prefix in named.items()],
        ) for p in pollutants
    ]))
    return table.select(lead_bucket(F.col("lead_h")).alias("bucket"), rows.alias("r")).select("bucket", "r.*")


def candidate_metrics(table: DataFrame, models: dict[str, str]) -> DataFrame:
    """Metrics of every candidate model per pollutant and lead bucket, total included."""
    rows = pollutant_rows(table, models)
    aggs = [c for m in models for c in _error_sums(F.col(m) - F.col("target"), m)]
    sums = roll_up(rows.groupBy("pollutant", "bucket").agg(*aggs), ["pollutant"])
    per_model = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), *[c.alias(k) for k, c in _metrics(m).items()]) for m in models
    ]))
    return sums.select("pollutant", "bucket", per_model.alias("m")).select("pollutant", "bucket", "m.*")


def best_model(metrics: DataFrame) -> DataFrame:
    """Smallest rounded MAE per pollutant and bucket; ties go to the earlier candidate."""
    rank = F.lit(len(CANDIDATES))
    for i, name in enumerate(CANDIDATES):
        rank = F.when(F.col("model") == name, i).otherwise(rank)
    key = F.when(F.col("mae").isNotNull(), F.struct("mae", rank.alias("r")))
    return metrics.groupBy("pollutant", "bucket").agg(
        F.coalesce(F.min_by("model", key), F.lit("None")).alias("best_model"), F.min("mae").alias("best_mae"))


def skill_vs_raw(metrics: DataFrame, raw: str = "raw_driver", models=("boosted", "rolling_bc", "lead_blend")) -> DataFrame:
    """MAE skill against the raw driver in percent; null when either MAE is missing or zero."""
    def mae(m: str) -> Column:
        return F.max(F.when(F.col("model") == m, F.col("mae")))

    wide = metrics.groupBy("pollutant", "bucket").agg(mae(raw).alias("_raw"), *[mae(m).alias(f"_{m}") for m in models])
    return wide.select("pollutant", "bucket", *[
        F.when((F.col("_raw") != 0) & (F.col(f"_{m}") != 0),
               round_half_even((1.0 - F.try_divide(F.col(f"_{m}"), F.col("_raw"))) * 100.0, 1)).alias(f"skill_{m}")
        for m in models
    ])


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, by: list[str]) -> DataFrame:
    """Share of complete rows inside [lo, hi], in percent."""
    full = F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull()
    inside = full & (F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))
    g = df.groupBy(*by).agg(F.count_if(full).alias("n"), F.count_if(inside).alias("_in"))
    pct = F.when(F.col("n") > 0, round_half_even(F.try_divide(F.col("_in").cast("double"), F.col("n")) * 100.0, 2))
    return g.select(*by, pct.alias("coverage_pct"), "n")


def square_error(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def brier_score(df: DataFrame, y: str, p: str, by: list[str], nulls: str = "mask") -> DataFrame:
    """Mean squared probability error.

    nulls="mask": incomplete rows are skipped, an empty group scores 0.0;
    nulls="none": one incomplete row makes the score null.
    """
    se = square_error(F.col(y), F.col(p))
    mean = exact_avg(se, SCALE)
    if nulls == "mask":
        score = F.coalesce(mean, F.lit(0.0))
    else:
        score = F.when(F.count(se) == F.count(F.lit(1)), mean)
    return df.groupBy(*by).agg(score.alias("brier"), F.count(se).alias("n"))


def brier_skill(score: Column, ref: Column, equal_first: bool = False) -> Column:
    """1 - score/ref; a zero reference gives 0 or minus infinity."""
    chain = F.when(ref == score, 0.0) if equal_first else None
    zero = F.when(score == 0, 0.0).otherwise(float("-inf"))
    chain = F.when(ref == 0, zero) if chain is None else chain.when(ref == 0, zero)
    return F.when(score.isNotNull() & ref.isNotNull(), chain.otherwise(1.0 - F.try_divide(score, ref)))


def counter_draw(rep: Column, pos: Column, n_blocks: Column, seed: int = 42) -> Column:
    """Pseudo-random block 0..n_blocks-1 from (seed, rep, pos) by integer arithmetic only."""
    x = (rep * 1_000_003 + pos * 7_919 + seed * 104_729) % 2_147_483_647
    for _ in range(3):
        x = (x * 48_271 + 11) % 2_147_483_647
        x = (x + F.floor(x / 65_536).cast("long") * 31) % 2_147_483_647
    return x % n_blocks


def counter_draws(rep: np.ndarray, pos: np.ndarray, n_blocks: int, seed: int = 42) -> np.ndarray:
    """`counter_draw` of whole arrays."""
    x = (rep * 1_000_003 + pos * 7_919 + seed * 104_729) % 2_147_483_647
    for _ in range(3):
        x = (x * 48_271 + 11) % 2_147_483_647
        x = (x + x // 65_536 * 31) % 2_147_483_647
    return x % n_blocks


#: Blocks of a group held by a task at a time, draws of a group made by one task, and draws held at a time.
CHUNK, SHARE, AT_ONCE = 1 << 17, 1 << 22, 1 << 18
DRAWN = {"rows": "long", "k": "long", "nm": "long", "nr": "long", "em": "long", "er": "long", "tm": "long", "tr": "long"}


def _drawn_sums(blocks: DataFrame, keys: list[str], block: int, reps: int, seed: int) -> DataFrame:
    """Sums over the drawn blocks per group and repetition, in as many rows as the group has chunks of blocks.

    The draws are made where the blocks are: a task holds one chunk of a group's blocks and the draws of a
    share of its repetitions, a piece at a time, so neither draws nor groups are joined or shuffled.
    """
    types = dict(blocks.dtypes)
    shares = F.least(F.lit(reps), F.ceil(F.col("n_blocks") * reps / SHARE)).cast("int")
    asked = blocks.withColumns({"_chunk": F.floor(F.col("_blk") / CHUNK).cast("long"), "_shares": shares}).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    group = [*keys, "_chunk", "_share"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rep long, n long, " + ", ".join(f"{c} {t}" for c, t in DRAWN.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        n_blocks, low, n = int(one["n_blocks"]), int(one["_chunk"]) * CHUNK, int(one["n"])
        mine = np.arange(int(one["_share"]), reps, int(one["_shares"]), dtype=np.int64)
        size = min(CHUNK, n_blocks - low)
        at = pdf["_blk"].to_numpy(np.int64) - low
        held = {}
        for c in ("len", "nm", "nr", "em", "er", "hm", "hr"):
            held[c] = np.zeros(size + 1, np.int64)  # the last place is that of draws from other chunks
            held[c][at] = pdf[c].to_numpy(np.int64)
        out = {c: np.zeros(len(mine), np.int64) for c in DRAWN}
        last = n_blocks - 1 - low if int(n) % block else -1
        wide = min(n_blocks, AT_ONCE)
        tall = max(1, AT_ONCE // wide)
        for i in range(0, len(mine), tall):
            rep, some = mine[i:i + tall, None], slice(i, i + tall)
            for j in range(0, n_blocks, wide):
                pos = np.arange(j, min(j + wide, n_blocks), dtype=np.int64)
                drawn = counter_draws(rep, pos[None, :], n_blocks, seed) - low
                drawn[(drawn < 0) | (drawn >= size)] = size
                for name, c in (("rows", "len"), ("nm", "nm"), ("nr", "nr"), ("em", "em"), ("er", "er")):
                    out[name][some] += held[c][drawn].sum(axis=1)
                if 0 <= last < size:
                    out["k"][some] += (drawn == last).sum(axis=1)
                if pos[-1] == n_blocks - 1:
                    end = drawn[:, -1]
                    out["tm"][some] = held["em"][end] - held["hm"][end]
                    out["tr"][some] = held["er"][end] - held["hr"][end]
        return pd.DataFrame({**{k: [one[k]] * len(mine) for k in keys}, "rep": mine, "n": n, **out})

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(tasks, *group).groupBy(*group).applyInPandas(run, schema)


def block_bootstrap(
    df: DataFrame, by: list[str], order: list[str], y: str, p: str, ref: str | None = None,
    block: int = 7, reps: int = 1000, seed: int = 42, draws: DataFrame | None = None,
) -> DataFrame:
    """Brier score (and skill against `ref`) of every bootstrap repetition.

    Rows are never resampled: each block of `block` consecutive rows is reduced to its
    squared-error sums. Drawing n_blocks blocks and cutting to n rows only ever cuts when
    the short last block was not drawn at all; then the last drawn block keeps as many rows
    as the short block has, so a second sum over those leading rows is enough. Rows without an
    error count as rows and add nothing. `draws` (rep, pos, drawn) replaces the counter's draws.
    """
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    order = [c for c in order if c not in keys]
    base = base.select(*keys, *order, F.col(y).alias("_y"), F.col(p).alias("_p"), F.col(ref or p).alias("_r"))
    rows = place(base, keys, order).running({"_rn": F.lit(1)}).rows()
    n, at = F.col("_rn_total"), (F.col("_rn") - 1)
    blk = F.floor(at / block).cast("long")
    last_len = F.pmod(n - 1, F.lit(block)) + 1
    head = F.pmod(at, F.lit(block)) < last_len
    em, er = square_error(F.col("_y"), F.col("_p")), square_error(F.col("_y"), F.col("_r"))
    rows = rows.withColumns({"_blk": blk, "_em": fixed_point(em, SCALE).cast("long"), "_er": fixed_point(er, SCALE).cast("long"), "_head": head})
    zero = F.lit(0).cast("long")
    blocks = rows.groupBy(*keys, "_blk").agg(
        F.max("_rn_total").cast("long").alias("n"), F.count(F.lit(1)).alias("len"),
        F.count("_em").alias("nm"), F.count("_er").alias("nr"),
        F.coalesce(F.sum("_em"), zero).alias("em"), F.coalesce(F.sum("_er"), zero).alias("er"),
        F.coalesce(F.sum(F.when(F.col("_head"), F.col("_em"))), zero).alias("hm"),
        F.coalesce(F.sum(F.when(F.col("_head"), F.col("_er"))), zero).alias("hr"),
    ).withColumn("n_blocks", F.ceil(F.col("n") / block).cast("long"))
    if draws is None:
        drawn = _drawn_sums(blocks, keys, block, reps, seed)
    else:
        asked = blocks.select(*keys, "n", "n_blocks", F.col("_blk").alias("pos")).join(draws.withColumnRenamed("drawn", "_blk"), "pos")
        drawn = asked.join(blocks.drop("n", "n_blocks").hint("merge"), [*keys, "_blk"])
        is_end = F.col("pos") == F.col("n_blocks") - 1
        short = (F.col("_blk") == F.col("n_blocks") - 1) & (F.col("len") < block)
        drawn = drawn.withColumns({
            "rows": F.col("len"), "k": short.cast("long"),
            "tm": F.when(is_end, F.col("em") - F.col("hm")).otherwise(zero), "tr": F.when(is_end, F.col("er") - F.col("hr")).otherwise(zero)})
    per_rep = drawn.groupBy(*keys, "rep").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in DRAWN])
    cut = (F.col("k") == 0) & (F.col("rows") > F.col("n"))
    used = F.least("rows", "n")
    unit = float(10**SCALE)
    bs = F.when(F.col("nm") > 0, F.when(cut, F.col("em") - F.col("tm")).otherwise(F.col("em")).cast("double") / unit / used)
    br = F.when(F.col("nr") > 0, F.when(cut, F.col("er") - F.col("tr")).otherwise(F.col("er")).cast("double") / unit / used)
    out = per_rep.select(*by, "rep", bs.alias("brier"), br.alias("brier_ref"))
    return out.withColumn("skill", brier_skill(F.col("brier"), F.col("brier_ref"), True)) if ref else out.drop("brier_ref")


def bootstrap_interval(reps: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """2.5 % and 97.5 % points over the repetitions (a bounded number of rows per group)."""
    return reps.groupBy(*by).agg(*[
        F.percentile(c, q).alias(f"{c}_{name}") for c in columns for name, q in (("lo", 0.025), ("hi", 0.975))
    ])


def _edges(n: int) -> list[float]:
    return [float(v) for v in np.linspace(0.0, 1.0, n + 1)[1:-1]]


def left_closed_bin(p: Column, n: int) -> Column:
    """Bin 0..n-1 of [e_i, e_i+1), the last one closed; literal edges."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in _edges(n)), F.lit(0))


def right_closed_bin(p: Column, n: int) -> Column:
    """Bin 0..n-1 of (e_i, e_i+1]."""
    return sum((F.when(p > e, 1).otherwise(0) for e in _edges(n)), F.lit(0))


def reliability_5(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Five fixed bins; empty bins are absent."""
    rows = df.where((F.col(p) >= 0) & (F.col(p) <= 1)).withColumn("bin", left_closed_bin(F.col(p), 5))
    return rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        round_half_even(exact_avg(F.col(p), SCALE), 4).alias("mean_predicted"),
        round_half_even(exact_avg(F.col(y), SCALE), 4).alias("observed_fraction"),
    )


def reliability_curve(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Ten bins, or five when a group has fewer than ten events.

    Means use right-closed bins; `n_hist` is the left-closed histogram count of the same
    bin number, which may differ. Both binnings come from one pass over the rows.
    """
    pc = F.col(p)
    cells = df.groupBy(
        *by, right_closed_bin(pc, 10).alias("r10"), right_closed_bin(pc, 5).alias("r5"),
        left_closed_bin(pc, 10).alias("l10"), left_closed_bin(pc, 5).alias("l5"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(fixed_point(F.col(y), SCALE)).alias("sy"), F.sum(fixed_point(pc, SCALE)).alias("sp"))
    events = F.sum("sy").over(Window.partitionBy(*by))  # at most a few dozen cells per group
    few = events < 10 * 10**SCALE
    cells = cells.withColumns({
        "n_bins": F.when(few, 5).otherwise(10),
        "rb": F.when(few, F.col("r5")).otherwise(F.col("r10")),
        "lb": F.when(few, F.col("l5")).otherwise(F.col("l10")),
    })
    unit = float(10**SCALE)
    parts = cells.select(*by, "n_bins", F.explode(F.array(
        F.struct(F.col("rb").alias("bin"), F.col("n").alias("n_curve"), "sy", "sp", F.lit(0).cast("long").alias("n_hist")),
        F.struct(F.col("lb").alias("bin"), F.lit(0).cast("long").alias("n_curve"), (F.col("sy") * 0).alias("sy"), (F.col("sp") * 0).alias("sp"), F.col("n").alias("n_hist")),
    )).alias("c")).select(*by, "n_bins", "c.*")
    g = parts.groupBy(*by, "n_bins", "bin").agg(*[F.sum(c).alias(c) for c in ("n_curve", "sy", "sp", "n_hist")]).where("n_curve > 0")
    return g.select(
        *by, "n_bins", "bin", "n_curve", "n_hist",
        round_half_even(F.col("sp").cast("double") / unit / F.col("n_curve"), 6).alias("mean_predicted"),
        round_half_even(F.col("sy").cast("double") / unit / F.col("n_curve"), 6).alias("observed_fraction"),
    )


def category_accuracy(table: DataFrame, observed: str, models: dict[str, str]) -> DataFrame:
    """Exact and within-one-tier accuracy per bucket and model, over known observations.

    `models` maps model names to category columns; persistence also needs a known forecast.
    """
    obs = category_rank(observed)
    known = table.where(F.col(observed) != "Unknown").withColumn("bucket", lead_bucket(F.col("lead_h")))
    aggs = [F.count(F.lit(1)).alias("n_valid")]
    for m, c in models.items():
        rank = category_rank(c)
        ok = (F.col(c) != "Unknown") if m == "persistence" else F.lit(True)
        aggs += [
            F.count_if(ok).alias(f"n_{m}"), F.count_if(ok & (rank == obs)).alias(f"e_{m}"),
            F.count_if(ok & (F.abs(rank - obs) <= 1)).alias(f"w_{m}"),
        ]
    sums = roll_up(known.groupBy("bucket").agg(*aggs), [])

    def pct(part: str, m: str) -> Column:
        share = F.try_divide(F.col(f"{part}_{m}").cast("double"), F.col(f"n_{m}")) * 100.0
        return F.coalesce(round_half_even(share, 2), F.lit(0.0))

    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), pct("e", m).alias("exact_pct"), pct("w", m).alias("within_one_pct")) for m in models
    ]))
    return sums.select("bucket", F.col("n_valid").alias("valid_hours"), rows.alias("m")).select("bucket", "valid_hours", "m.*")


def p_exceed(p10: Column, p50: Column, p90: Column, threshold: float) -> Column:
    """Gaussian exceedance probability from an 80 % interval."""
    return 0.5 * erfc(_exceed_z(p10, p50, p90, threshold))


def _exceed_z(p10: Column, p50: Column, p90: Column, threshold: float) -> Column:
    sd = F.greatest(F.lit(MIN_SD), (p90 - p10) / INTERVAL_TO_SD)
    return (threshold - p50) / sd / math.sqrt(2.0)


def with_exceedance(df: DataFrame, out: str = "p_raw") -> DataFrame:
    """Adds the larger of the two particle exceedance probabilities; null where either is missing.

    The polynomial's argument is a column of its own, so it is evaluated once per row and
    the generated code stays small.
    """
    limits = {"pm25": SEVERE_PM25, "pm10": SEVERE_PM10}
    z = {f"_z_{p}": _exceed_z(F.col(f"{p}_p10"), F.col(f"{p}_p50"), F.col(f"{p}_p90"), t) for p, t in limits.items()}
    step = df.withColumns(z).withColumns({f"_u_{p}": erfc_argument(F.col(f"_z_{p}")) for p in limits})
    tails = ", ".join(f"0.5D * ({erfc_text(f'_z_{p}', f'_u_{p}')})" for p in limits)
    whole = F.col("_z_pm25").isNotNull() & F.col("_z_pm10").isNotNull()
    return step.withColumn(out, F.when(whole, F.expr(f"greatest({tails})"))).drop(*z, *[f"_u_{p}" for p in limits])


def severe_state(pm25: Column, pm10: Column) -> Column:
    """1.0 when either particle size is at its severe threshold, else 0.0 (missing counts as not)."""
    yes = F.coalesce(pm25 >= SEVERE_PM25, F.lit(False)) | F.coalesce(pm10 >= SEVERE_PM10, F.lit(False))
    return yes.cast("double")


def severe_base_rate(train: DataFrame) -> DataFrame:
    """Event rate over training rows with both targets."""
    full = train.where(F.col("target_pm25").isNotNull() & F.col("target_pm10").isNotNull())
    return full.agg(
        exact_avg(severe_state(F.col("target_pm25"), F.col("target_pm10")), SCALE).alias("base_rate"),
        F.count(F.lit(1)).alias("n_train"),
    )


def severe_risk_table(table: DataFrame, observed: str, probs: dict[str, str]) -> DataFrame:
    """Event counts, Brier scores and skills per bucket.

    `probs` maps raw, calibrated, persistence, raw_driver and climatology to probability
    columns.
    """
    known = table.where(F.col(observed) != "Unknown").withColumns({
        "bucket": lead_bucket(F.col("lead_h")), "_y": (F.col(observed) == "Severe").cast("double")})
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("_y").cast("long")).alias("events")]
    for m, c in probs.items():
        se = square_error(F.col("_y"), F.col(c))
        aggs += [F.count(se).alias(f"n_{m}"), F.sum(fixed_point(se, SCALE)).alias(f"q_{m}")]
    sums = roll_up(known.groupBy("bucket").agg(*aggs), [])
    unit = float(10**SCALE)
    score = {m: F.coalesce(F.try_divide(F.col(f"q_{m}").cast("double") / unit, F.col(f"n_{m}")), F.lit(0.0)) for m in probs}
    out = {f"brier_{m}": round_half_even(s, 4) for m, s in score.items()}
    for m in ("raw", "calibrated"):
        for r in ("climatology", "persistence"):
            if m in probs and r in probs:
                out[f"bss_{m}_vs_{r}"] = round_half_even(brier_skill(score[m], score[r]), 4)
    return sums.select("bucket", "n_samples", "events", *[c.alias(n) for n, c in out.items()])


def event_flag(n: Column, least: int = 10) -> Column:
    """'insufficient events' below ten events, else 'valid'."""
    return F.when(n < least, "insufficient events").otherwise("valid")
