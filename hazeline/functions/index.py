"""Regulatory index as column expressions: every function compiles to one CASE chain.

Arguments are column names or SQL expressions (str); a Column is accepted where noted. The
chains are written as SQL text, which Spark parses in one call instead of hundreds.

`gap_mode="reference"` keeps the published behaviour for values between two integer-edged
bands (they are extrapolated with the top slope, or called "Good" when already an index);
`gap_mode="continuous"` gives such a value the top of the band below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.constants import CATEGORIES, CONC_BANDS, INDEX_BANDS, INDEX_NAMES

SEVERE_ABOVE = 400


def _normal(name: str) -> str:
    return name.strip().upper().replace(".", "").replace(" ", "")


_BY_NORMAL_NAME = {_normal(k): v for k, v in CONC_BANDS.items()}


def bands_of(pollutant: str):
    """(conc_low, conc_high, index_low, slope) rows of one pollutant, or None."""
    conc = _BY_NORMAL_NAME.get(_normal(pollutant))
    if conc is None:
        return None
    return [
        (float(lo), float(hi), float(ilo), float(ihi - ilo) / float(hi - lo))
        for (lo, hi), (ilo, ihi) in zip(conc, INDEX_BANDS)
    ]


def sub_index_text(pollutant: str, conc: str, gap_mode: str = "reference") -> str:
    """SQL text of the rounded sub-index; null for missing, negative or unknown."""
    bands = bands_of(pollutant)
    if bands is None:
        return "CAST(NULL AS DOUBLE)"

    def line(lo: float, ilo: float, slope: float) -> str:
        return f"rint({ilo!r}D + {slope!r}D * ({conc} - {lo!r}D))"

    out = [f"CASE WHEN {conc} IS NULL OR {conc} < 0 THEN NULL"]
    for k, (lo, hi, ilo, slope) in enumerate(bands):
        out.append(f"WHEN {conc} BETWEEN {lo!r}D AND {hi!r}D THEN {line(lo, ilo, slope)}")
        if gap_mode == "continuous" and k + 1 < len(bands):
            out.append(f"WHEN {conc} > {hi!r}D AND {conc} < {bands[k + 1][0]!r}D THEN {float(INDEX_BANDS[k][1])!r}D")
    lo, _, ilo, slope = bands[-1]
    return " ".join(out) + f" ELSE {line(lo, ilo, slope)} END"


def pm_index_text(pm25: str, pm10: str, gap_mode: str = "reference") -> str:
    return f"greatest({sub_index_text('PM2.5', pm25, gap_mode)}, {sub_index_text('PM10', pm10, gap_mode)})"


def category_text(index: str, gap_mode: str = "reference") -> str:
    """SQL text of the category; `index` should be a plain column, it is named many times."""
    out = [f"CASE WHEN {index} IS NULL THEN 'Unknown'"]
    for (lo, hi), name in zip(INDEX_BANDS, CATEGORIES):
        if gap_mode == "continuous":
            out.append(f"WHEN {index} < {hi + 1} THEN '{name}'")
        else:
            out.append(f"WHEN {index} BETWEEN {lo} AND {hi} THEN '{name}'")
    if gap_mode == "continuous":
        return " ".join(out) + " ELSE 'Severe' END"
    return " ".join(out) + f" WHEN {index} > {INDEX_BANDS[-1][1]} THEN 'Severe' ELSE 'Good' END"


def sub_index(pollutant: str, conc: str, gap_mode: str = "reference") -> Column:
    """Rounded sub-index of one pollutant."""
    return F.expr(sub_index_text(pollutant, conc, gap_mode))


def sub_index_any(pollutant: str, conc: str, gap_mode: str = "reference") -> Column:
    """Sub-index where the pollutant name is a column or expression too: no join needed."""
    name = f"regexp_replace(upper(trim({pollutant})), '[. ]', '')"
    arms = " ".join(f"WHEN '{k}' THEN {sub_index_text(k, conc, gap_mode)}" for k in _BY_NORMAL_NAME)
    return F.expr(f"CASE {name} {arms} END")


def aqi_max(*subs: Column) -> Column:
    """Largest of the sub-indices that are present; null when none is."""
    return subs[0] if len(subs) == 1 else F.greatest(*subs)


def aqi_category(index: str, gap_mode: str = "reference") -> Column:
    """Category name of an index column."""
    return F.expr(category_text(index, gap_mode))


def pm_index(pm25: str, pm10: str, gap_mode: str = "reference") -> Column:
    """Index of the two particle sizes; either may be missing."""
    return F.expr(pm_index_text(pm25, pm10, gap_mode))


def with_pm_aqi(df: DataFrame, cells: dict[str, tuple[str, str]], index: str | None = None, category: str | None = None) -> DataFrame:
    """Index and category of several (PM2.5, PM10) column pairs.

    `cells` maps a name to its pair; `index`/`category` are output patterns such as
    "aqi_{}", and None leaves that output out. The index is a column of its own before the
    categories refer to it, so it is computed once.
    """
    hidden = index or "_index_{}"
    out = df.withColumns({hidden.format(n): pm_index(a, b) for n, (a, b) in cells.items()})
    if category:
        out = out.withColumns({category.format(n): aqi_category(hidden.format(n)) for n in cells})
    return out if index else out.drop(*[hidden.format(n) for n in cells])


def pm_to_aqi(df: DataFrame, pm25: str = "pm25", pm10: str = "pm10", index: str = "aqi", category: str = "category") -> DataFrame:
    """Adds index and category of the two particle sizes."""
    return with_pm_aqi(df, {"": (pm25, pm10)}, index, category)


def dominant_pollutant(df: DataFrame, columns: list[str], out: str = "dominant") -> DataFrame:
    """Adds the name of the pollutant with the largest sub-index; first name wins a tie."""
    names = sorted(columns)
    subs = {f"_s_{n}": sub_index(INDEX_NAMES.get(n, n), n) for n in names}
    arms = " ".join(f"WHEN _s_{n} = _top THEN '{n}'" for n in names)
    return (
        df.withColumns(subs).withColumn("_top", aqi_max(*[F.col(s) for s in subs]))
        .withColumn(out, F.expr(f"CASE WHEN _top IS NULL THEN NULL {arms} END"))
        .drop("_top", *subs)
    )


def category_rank(name: str) -> Column:
    """0 (Good) .. 5 (Severe); -99 for anything else."""
    arms = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CATEGORIES))
    return F.expr(f"CASE {name} {arms} ELSE -99 END")


def is_severe(index: str) -> Column:
    """Index of 401 or more; any index above 400 counts."""
    return F.expr(f"{index} > {SEVERE_ABOVE}")


def category_thresholds(breakpoints: DataFrame) -> DataFrame:
    """Lowest index of the two alert categories."""
    return (
        breakpoints.where(F.col("category").isin("Severe", "Very Poor"))
        .groupBy(F.when(F.col("category") == "Severe", "Severe").otherwise("Very Poor or worse").alias("event"))
        .agg(F.min("index_low").alias("threshold"))
    )
