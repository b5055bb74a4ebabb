"""DuckDB SQL fragments used by the correctness oracles."""

from __future__ import annotations

from hazeline.constants import CATEGORIES, INDEX_BANDS, breakpoint_rows
from hazeline.functions.index import bands_of


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


def rnd(expr: str, digits: int = 0) -> str:
    """Half-even rounding, as in `round_half_even`."""
    if digits == 0:
        return f"CAST(round_even({expr}, 0) AS DOUBLE)"
    f = num(10.0**digits)
    return f"(CAST(round_even(({expr}) * {f}, 0) AS DOUBLE) / {f})"


def davg(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def fixed(x: str, scale: int = 6) -> str:
    return f"CAST(round_even(({x}) * {num(10.0**scale)}, 0) AS HUGEINT)"


def esum(x: str, scale: int = 6) -> str:
    return f"(CAST(SUM({fixed(x, scale)}) AS DOUBLE) / {num(10.0**scale)})"


def eavg(x: str, scale: int = 6) -> str:
    return f"({esum(x, scale)} / NULLIF(COUNT({x}), 0))"


def wavg(x: str, over: str) -> str:
    return f"(CAST(SUM({fixed(x)}) OVER {over} AS DOUBLE) / 1e6 / NULLIF(COUNT({x}) OVER {over}, 0))"


def sub_index(pollutant: str, c: str, gap_mode: str = "reference") -> str:
    out = [f"CASE WHEN {c} IS NULL OR {c} < 0 THEN NULL"]
    bands = bands_of(pollutant)
    for k, (lo, hi, ilo, slope) in enumerate(bands):
        out.append(f"WHEN {c} >= {num(lo)} AND {c} <= {num(hi)} THEN "
                   + rnd(f"{num(ilo)} + {num(slope)} * ({c} - {num(lo)})"))
        if gap_mode == "continuous" and k + 1 < len(bands):
            out.append(f"WHEN {c} > {num(hi)} AND {c} < {num(bands[k + 1][0])} THEN {num(INDEX_BANDS[k][1])}")
    lo, _, ilo, slope = bands[-1]
    return " ".join(out) + f" ELSE {rnd(f'{num(ilo)} + {num(slope)} * ({c} - {num(lo)})')} END"


def category(i: str, gap_mode: str = "reference") -> str:
    out = [f"CASE WHEN {i} IS NULL THEN 'Unknown'"]
    if gap_mode == "continuous":
        for (_, hi), name in list(zip(INDEX_BANDS, CATEGORIES))[:-1]:
            out.append(f"WHEN {i} < {hi + 1} THEN '{name}'")
        return " ".join(out) + " ELSE 'Severe' END"
    for (lo, hi), name in zip(INDEX_BANDS, CATEGORIES):
        out.append(f"WHEN {i} >= {lo} AND {i} <= {hi} THEN '{name}'")
    return " ".join(out) + f" WHEN {i} > 500 THEN 'Severe' ELSE 'Good' END"


def pm_index(a: str, b: str) -> str:
    return f"greatest({sub_index('PM2.5', a)}, {sub_index('PM10', b)})"


def rank(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{c}' THEN {k}" for k, c in enumerate(CATEGORIES)) + " ELSE -99 END"


def percentile(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


_ST = {c: f"'st' || CAST({c} // {n} AS VARCHAR)" for c, n in {"user_id": 50, "l_suppkey": 34, "s_suppkey": 34, "o_custkey": 500}.items()}
REPORTING_DATE = "CAST(({ts} - INTERVAL 57601 SECOND) AS DATE) + 1"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


view("obs", f"""
SELECT {_ST['user_id']} AS station, date_trunc('hour', ts) AS ts,
  4 * {davg("CASE WHEN event_type IN ('click','view') THEN value END")} AS pm25,
  6 * {davg("CASE WHEN event_type IN ('purchase','signup') THEN value END")} AS pm10,
  {davg("CASE WHEN event_type = 'error' THEN value END")} AS no2,
  {davg("CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END")} AS o3
FROM events GROUP BY 1, 2""")

view("drivers", f"""
SELECT {_ST['l_suppkey']} AS station,
  TIMESTAMP '2024-01-01' + to_hours(CAST(l_orderkey % 720 AS INTEGER)) AS ts,
  6 * {davg('l_quantity')} AS pm2_5, {davg('l_extendedprice')} / 200 AS pm10,
  1000 * {davg('l_tax')} AS ozone, 800 * {davg('l_discount')} AS nitrogen_dioxide,
  5 * {davg('l_linenumber')} AS temperature_2m, 12 * {davg('l_linenumber')} AS relative_humidity_2m,
  {davg('l_quantity')} / 3 AS wind_speed_10m, 50 * {davg('l_linenumber')} AS wind_direction_10m,
  {davg('l_extendedprice')} / 60 AS boundary_layer_height, 1000 + {davg('l_linenumber')} AS surface_pressure
FROM lineitem GROUP BY 1, 2""")

view("daily_long", f"""
SELECT {_ST['o_custkey']} AS station, CAST(o_orderdate AS DATE) AS date,
  {davg('o_totalprice')} / 1000 AS aqi, {davg('(o_custkey % 300)')} + 1 AS pm25, {davg('(o_orderkey % 500)')} AS pm10
FROM orders GROUP BY 1, 2""")

view("soundings", f"""
SELECT l_partkey AS profile, CAST(l_orderkey AS DOUBLE) AS height_m, {davg('l_quantity')} AS temp_c
FROM lineitem GROUP BY 1, 2""")

view("fires", """
SELECT 28 + (o_custkey % 100) * CAST(0.06 AS DOUBLE) AS latitude, 72 + (o_orderkey % 100) * CAST(0.07 AS DOUBLE) AS longitude,
  CAST(o_orderdate AS DATE) AS acq_date, CAST((o_orderkey % 24) * 100 + o_custkey % 60 AS INTEGER) AS acq_time,
  o_orderpriority AS confidence, o_totalprice / 10000 AS frp
FROM orders""")

view("joint_samples", """
SELECT l_suppkey AS group_id, 8 * l_quantity AS pm25, l_extendedprice / 150 AS pm10 FROM lineitem""")

view("outcomes", f"""
SELECT {_ST['l_suppkey']} AS station, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y,
  l_discount * 10 AS p, l_tax * 10 AS ref, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4
FROM lineitem""")

view("hour_records", f"""
SELECT {_ST['user_id']} AS station, event_type AS parameter,
  time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 330 MINUTE AS ts, value,
  CAST(60 + event_id % 41 AS DOUBLE) AS coverage, event_id AS file_order
FROM events""")

view("stations", f"""
SELECT {_ST['s_suppkey']} AS station, MIN(s_name) AS name,
  28 + {davg('s_acctbal')} / 10000 AS lat, 77 + {davg('s_acctbal')} / 20000 AS lon
FROM supplier GROUP BY 1""")

view("locations", """
SELECT c_custkey AS id, c_mktsegment || ' ' || c_name AS name,
  28 + (c_custkey % 97) * CAST(0.01 AS DOUBLE) AS latitude, 77 + (c_nationkey % 25) * CAST(0.03 AS DOUBLE) AS longitude
FROM customer""")

view("breakpoints", "SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', {h}, {num(a)}, {num(b)}, {num(c)}, {num(d)}, '{k}')" for p, h, a, b, c, d, k in breakpoint_rows()
) + ") t(pollutant, averaging_hours, conc_low, conc_high, index_low, index_high, category)")


def sql(body: str, *views: str, recursive: bool = False, once: bool = False) -> str:
    """A query with the CTEs of the views it needs; with `once` each of these is evaluated once."""
    ordered: list[str] = []

    def need(v: str) -> None:
        for d in VIEWS[v][0]:
            need(d)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        need(v)
    kind = "AS MATERIALIZED" if once else "AS"
    ctes = ",\n".join(f"{v} {kind} ({VIEWS[v][1]})" for v in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
