"""Calendar, session, cycle and number columns of a bar's open instant: scalar expressions only."""

from __future__ import annotations

from barloom.plans.portable import Dialect, Stages, flag

#: Halving dates, new-moon reference (2000-01-06 18:14 UTC) and synodic month in days.
HALVINGS_US = (1354060800000000, 1468022400000000, 1589155200000000, 1713571200000000)
NEW_MOON_US, SYNODIC = 947182440000000, 29.53058867
TAU = "6.283185307179586e0"


def _root(n: str) -> str:
    return f"CASE WHEN ({n}) = 0 THEN 0 ELSE 1 + (abs({n}) - 1) % 9 END"


def time_columns(d: Dialect) -> Stages:
    """Cyclic hour/weekday/month/day-of-year, sessions, period ends."""
    t = d.ts("us")
    s1 = {"ts": t}
    s2 = {"h_i": "hour(ts)", "dow_i": d.weekday("ts"), "dom_i": "day(ts)", "month_i": "month(ts)", "year_i": "year(ts)", "doy_i": "dayofyear(ts)", "week_i": "weekofyear(ts)"}
    s3 = {}
    for name, col, n in (("hour", "h_i", 24), ("dow", "dow_i", 7), ("month", "month_i", 12), ("doy", "doy_i", 365)):
        s3 |= {f"{name}_sin": f"round(sin({TAU} * {col} / {n}e0), 9)", f"{name}_cos": f"round(cos({TAU} * {col} / {n}e0), 9)"}
    for h in (0, 4, 6, 8, 12, 16, 20):
        s3[f"is_hour_{h}"] = flag(f"h_i = {h}")
    s3 |= {
        "session_asia": flag("h_i <= 7"), "session_london": flag("h_i >= 8 AND h_i <= 15"), "session_ny": flag("h_i >= 14 AND h_i <= 21"),
        "session_overlap": flag("h_i >= 14 AND h_i <= 16"), "is_monday": flag("dow_i = 0"), "is_friday": flag("dow_i = 4"), "is_weekend": flag("dow_i >= 5"),
        "is_month_end": flag("day(last_day(ts)) = dom_i"), "is_quarter_end": flag("month_i % 3 = 0 AND day(last_day(ts)) = dom_i"),
        "week_of_month_i": d.div("dom_i - 1", "7") + " + 1",
        "is_opex": flag("dow_i = 4 AND dom_i >= 15 AND dom_i <= 21"), "is_quad_witching": flag("dow_i = 4 AND dom_i >= 15 AND dom_i <= 21 AND month_i % 3 = 0"),
        "is_nfp": flag("dow_i = 4 AND dom_i <= 7"), "is_cpi_window": flag("dom_i >= 10 AND dom_i <= 15"), "is_tax_window": flag("month_i = 4 AND dom_i <= 18"),
    }
    return [s1, s2, s3]


def numerology(d: Dialect) -> Stages:
    """Digit roots of date, price and volume; day flags; sexagenary, zodiac and moon-age columns by modular arithmetic."""
    t = d.ts("us")
    digits = "CAST(round(close * 100) AS BIGINT)"
    s1 = {"ts": t, "price_cents": digits}
    s2 = {"ymd_i": "year(ts) * 10000 + month(ts) * 100 + day(ts)", "doy_i": "dayofyear(ts)", "y_i": "year(ts)", "dom_i": "day(ts)", "price_int": "CAST(floor(close) AS BIGINT)"}
    s3 = {
        "date_sum": " + ".join(f"{d.div('ymd_i', str(10**k))} % 10" for k in range(8)), "price_dr_i": _root("price_int"), "doy_dr_i": _root("doy_i"),
        "year_dr_i": _root("y_i"), "price_is_master": flag("price_int % 100 IN (11, 22, 33)"), "doy_mirror_i": "CAST(reverse(CAST(doy_i AS STRING)) AS INT)",
        "day_13": flag("dom_i = 13"), "day_21": flag("dom_i = 21"), "is_prime_day": flag("dom_i IN (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)"),
        "is_fibonacci_day": flag("dom_i IN (1, 2, 3, 5, 8, 13, 21)"), "shemitah": flag("(y_i - 5) % 7 = 0"), "doy_div_9": flag("doy_i % 9 = 0"),
        "stem_i": "(y_i - 4) % 10", "branch_i": "(y_i - 4) % 12", "sexagenary_i": "(y_i - 4) % 60",
        "moon_age": f"((us - {NEW_MOON_US}) / 86400000000e0) - floor(((us - {NEW_MOON_US}) / 86400000000e0) / {SYNODIC}e0) * {SYNODIC}e0",
        "days_since_halving": f"(us - {HALVINGS_US[2]}) / 86400000000e0", "days_to_halving": f"({HALVINGS_US[3]} - us) / 86400000000e0",
        "price_contains_69": flag("CAST(price_int AS STRING) LIKE '%69%'"), "price_contains_113": flag("CAST(price_int AS STRING) LIKE '%113%'"),
        "price_palindrome": flag("price_int >= 10 AND CAST(price_int AS STRING) = reverse(CAST(price_int AS STRING))"),
        "round_1000": flag("price_int >= 1000 AND price_int % 1000 = 0"),
    }
    s4 = {"date_dr_i": _root("CAST(date_sum AS INT)"), "vortex_369": flag(f"({_root('CAST(date_sum AS INT)')}) IN (3, 6, 9)"), "moon_sin": f"sin({TAU} * moon_age / {SYNODIC}e0)"}
    return [s1, s2, s3, s4]
