"""Temperature-inversion layers in vertical profiles.

No layer can reach across a single step that falls by more than the tolerance, so a profile
is cut there into independent pieces. Levels are placed by range of (profile, height), which
keeps even one giant profile spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.ordered import Placed, place

LAYER = "profile {0}, base_height double, top_height double, depth_m double, strength_c double, kind string"


def valid_levels(profiles: DataFrame) -> DataFrame:
    """Levels with both height and temperature."""
    ok = F.col("height_m").isNotNull() & F.col("temp_c").isNotNull() & ~F.isnan("height_m") & ~F.isnan("temp_c")
    return profiles.where(ok)


def bad_profiles(levels: DataFrame, order: list[str]) -> DataFrame:
    """Profiles whose heights, in record order, do not strictly increase, with the violations."""
    seq = place(valid_levels(levels), ["profile"], order).previous({"below": "height_m"}).rows()
    return seq.where(F.col("height_m") <= F.col("below")).groupBy("profile").agg(F.count(F.lit(1)).alias("violations"))


def _pieces(profiles: DataFrame, tol_c: float) -> Placed:
    """Levels with the piece number `seg`, their number `rn` and the height below."""
    seq = place(valid_levels(profiles).select("profile", "height_m", "temp_c"), ["profile"], ["height_m"])
    seq = seq.previous({"_below": "temp_c", "_h_below": "height_m"})
    falls = F.coalesce(F.col("_below") - F.col("temp_c") > tol_c, F.lit(False))
    return seq.running({"seg": falls.cast("long"), "rn": F.lit(1).cast("long")})


def _layers_of(h: np.ndarray, t: np.ndarray, tol: float) -> list[tuple[int, int]]:
    """(base, top) level numbers of one piece; the scan resumes at each peak."""
    found, at, n = [], 0, len(t)
    while at + 1 < n:
        if t[at + 1] <= t[at]:
            at += 1
            continue
        peak = at + 1
        for j in range(at + 2, n):
            if t[j] > t[peak]:
                peak = j
            elif t[peak] - t[j] > tol:
                break
        found.append((at, peak))
        at = peak
    return found


def inversion_layers(profiles: DataFrame, tol_c: float = 0.2, min_depth_m: float = 0.0) -> DataFrame:
    """All layers of every profile.

    Pieces stream through Arrow batches in (profile, piece, height) order; only the piece at
    the end of a batch is carried to the next one. Profiles whose heights repeat are not
    ordered profiles: find them with `bad_profiles` first.
    """
    pieces = _pieces(profiles, tol_c).rows()
    # A piece with one level cannot hold a layer; most pieces of a cooling profile go here.
    rows = pieces.select("profile", "seg", "rn", "height_m", "temp_c")
    n = profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = rows.repartition(int(n), "profile", "seg").sortWithinPartitions("profile", "seg", "rn")
    key_type = dict(profiles.dtypes)["profile"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = (pdf["profile"].ne(pdf["profile"].shift()) | pdf["seg"].ne(pdf["seg"].shift())).to_numpy()
            starts = np.flatnonzero(new)
            last = starts[-1] if len(starts) else 0
            rest = pdf.iloc[last:]
            yield layers(pdf.iloc[:last], starts[:-1])
        if rest is not None and len(rest):
            yield layers(rest, np.array([0]))

    def layers(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        p, h, t, rn = (pdf[c].to_numpy() for c in ("profile", "height_m", "temp_c", "rn"))
        out = []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            if b - a < 2:
                continue
            for i, j in _layers_of(h[a:b], t[a:b], tol_c):
                base, top = a + i, a + j
                depth, gain = h[top] - h[base], t[top] - t[base]
                if depth >= min_depth_m and depth > 0 and gain > 0:
                    out.append((p[base], h[base], h[top], depth, gain, "surface" if rn[base] == 1 else "elevated"))
        return pd.DataFrame(out, columns=["profile", "base_height", "top_height", "depth_m", "strength_c", "kind"])

    return ordered.mapInPandas(scan, LAYER.format(key_type))


def inversion_layers_exact(profiles: DataFrame, min_depth_m: float = 0.0) -> DataFrame:
    """Layers with zero tolerance: one aggregate per non-falling piece, no Python at all."""
    pieces = _pieces(profiles, 0.0).rows()
    h, t = F.col("height_m"), F.col("temp_c")
    g = pieces.groupBy("profile", "seg").agg(
        F.min(t).alias("t0"), F.max(t).alias("t1"),
        F.max_by(F.struct(h.alias("h"), F.col("rn").alias("rn")), F.struct((-t).alias("t"), h.alias("h"))).alias("base"),
        F.min_by(h, F.struct((-t).alias("t"), h.alias("h"))).alias("top_height"),
    ).where("t1 > t0")
    out = g.select(
        "profile", F.col("base.h").alias("base_height"), "top_height",
        (F.col("top_height") - F.col("base.h")).alias("depth_m"), (F.col("t1") - F.col("t0")).alias("strength_c"),
        F.when(F.col("base.rn") == 1, "surface").otherwise("elevated").alias("kind"),
    )
    return out.where((F.col("depth_m") >= min_depth_m) & (F.col("depth_m") > 0))


def strongest_inversion(layers: DataFrame) -> DataFrame:
    """The strongest layer per profile; the lowest base wins a tie."""
    row = F.struct("base_height", "top_height", "depth_m", "strength_c", "kind")
    best = F.max_by(row, F.struct("strength_c", (-F.col("base_height")).alias("b")))
    return layers.groupBy("profile").agg(best.alias("l")).select("profile", "l.*")
