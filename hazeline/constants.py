"""Fixed values of the regulatory index, the forecast rules and the source layouts."""

from __future__ import annotations

POLLUTANTS = ("pm25", "pm10", "o3", "no2")
QUANTILES = (0.1, 0.5, 0.9)

# Fixed values: (conc_low, conc_high, index_low, index_high, category) per pollutant.
CATEGORIES = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")
INDEX_BANDS = ((0, 50), (51, 100), (101, 200), (201, 300), (301, 400), (401, 500))
CONC_BANDS = {
    "PM2.5": ((0, 30), (31, 60), (61, 90), (91, 120), (121, 250), (251, 500)),
    "PM10": ((0, 50), (51, 100), (101, 250), (251, 350), (351, 430), (431, 500)),
    "NO2": ((0, 40), (41, 80), (81, 180), (181, 280), (281, 400), (401, 500)),
    "SO2": ((0, 40), (41, 80), (81, 380), (381, 800), (801, 1600), (1601, 2000)),
    "CO": ((0, 1.0), (1.1, 2.0), (2.1, 10.0), (10.1, 17.0), (17.1, 34.0), (34.1, 50.0)),
    "O3": ((0, 50), (51, 100), (101, 168), (169, 208), (209, 748), (749, 1000)),
    "NH3": ((0, 200), (201, 400), (401, 800), (801, 1200), (1201, 1800), (1801, 2000)),
}
AVERAGING_HOURS = {"PM2.5": 24, "PM10": 24, "NO2": 24, "SO2": 24, "CO": 8, "O3": 8, "NH3": 24}
INDEX_NAMES = {
    "pm25": "PM2.5", "pm10": "PM10", "no2": "NO2", "so2": "SO2", "co": "CO", "o3": "O3", "nh3": "NH3",
}
SEVERE_INDEX = 401.0
VERY_POOR_INDEX = 301.0
SEVERE_PM25 = 251.0
SEVERE_PM10 = 431.0
CATEGORY_RANK = {name: rank for rank, name in enumerate(CATEGORIES)}

# The 16-column hourly layout.
HOURLY_VALUES = ("pm25", "pm10", "no2", "so2", "co", "o3", "nh3", "at", "rh", "ws", "wd", "sr")

# Anchored header patterns, first match wins.
HEADER_TOKENS = {
    "PM2.5": "pm25", "PM25": "pm25", "PM10": "pm10", "NO2": "no2", "SO2": "so2", "CO": "co", "OZONE": "o3", "NH3": "nh3",
    "AT": "at", "RH": "rh", "WS": "ws", "WD": "wd", "SR": "sr",
}
# Of these tokens any text may follow; the others have to end as a word.
OPEN_TOKENS = ("PM2.5", "PM25", "PM10")
STATION_COLUMNS = tuple(dict.fromkeys(HEADER_TOKENS.values()))
# Agencies in station file names; the first also ends names of files that are not hourly.
AGENCIES = ("hspcb", "dpcc", "uppcb")
MAIN_AGENCY = AGENCIES[0]
# Text that means "missing" in the station files.
NA_TOKENS = ("NA", "N/A", "null", "NULL", "None", "-", "", "nan", "NaN")

# Names of the gridded driver variables.
AIR_VARIABLES = ("pm2_5", "pm10", "ozone", "nitrogen_dioxide")
MET_VARIABLES = (
    "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
    "wind_direction_10m", "boundary_layer_height", "surface_pressure",
)
DRIVER_OF = {"pm25": "pm2_5", "pm10": "pm10", "o3": "ozone", "no2": "nitrogen_dioxide"}

FEATURES_72H = (
    "lead_h", "driver_pm25", "driver_pm10", "driver_o3", "driver_no2",
    *MET_VARIABLES, "ventilation_index",
    "hour", "hour_sin", "hour_cos", "day_of_year", "doy_sin", "doy_cos",
    "last_obs_pm25", "last_obs_pm10", "last_obs_o3", "last_obs_no2",
)

# Persistence weight by pollutant for leads 1-24, 25-48, 49-72 h.
BLEND_WEIGHTS = {
    "pm25": (0.50, 0.25, 0.10),
    "pm10": (0.50, 0.25, 0.10),
    "no2": (0.80, 0.75, 0.70),
    "o3": (1.00, 1.00, 1.00),
}
DEFAULT_WEIGHTS = (0.50, 0.25, 0.10)
LEAD_BUCKETS = (("1-24h", 1, 24), ("25-48h", 25, 48), ("49-72h", 49, 72))
ALL_LEADS = "1-72h"

# Smallest half-width of a residual band (floor) per pollutant.
BAND_FLOOR = {"pm25": 5.0, "pm10": 10.0, "o3": 2.0, "no2": 3.0}
# Fixed values: (smallest half-width, share of the driver) of the fallback band.
FALLBACK_BAND = {"pm25": (25.0, 0.40), "pm10": (50.0, 0.45), "o3": (10.0, 0.35), "no2": (10.0, 0.35)}
LEAD_WIDENING = 0.004
INTERVAL_TO_SD = 2.563
MIN_SD = 5.0

# Fixed order that breaks ties between candidate models.
CANDIDATES = ("rolling_bc", "lead_blend", "boosted", "band_median", "persistence", "raw_driver", "climatology")

DAILY_FEATURES = ("aqi_d", "aqi_d_minus_1", "mean_aqi_7d", "pm_ratio", "month_sin", "month_cos")
WINTER_MONTHS = (10, 11, 12, 1, 2)


def breakpoint_rows():
    """The 42 breakpoint rows in pollutant order."""
    return [
        (name, AVERAGING_HOURS[name], float(lo), float(hi), float(ilo), float(ihi), cat)
        for name, bands in CONC_BANDS.items()
        for (lo, hi), (ilo, ihi), cat in zip(bands, INDEX_BANDS, CATEGORIES)
    ]

READING_ALIASES = {
    "pm25": "pm25", "pm2.5": "pm25", "pm10": "pm10", "o3": "o3", "ozone": "o3",
    "no2": "no2", "nitrogen_dioxide": "no2",
}
