"""Sky and number functions of an instant or a number: modular arithmetic from reference instants, scalar expressions only."""

from __future__ import annotations

from barloom.plans.portable import Dialect, Stages, flag

DAY_US = 86_400_000_000
#: The reference new moon (2000-01-06 18:14 UTC), the synodic month in days, and the days of the two calendars' references.
NEW_MOON_US, SYNODIC = 947182440000000, 29.53059
STEM_DAY, TZOLKIN_DAY = 10963, 15695  # 2000-01-07 and 2012-12-21 in days since 1970
#: First ages in days of the eight phases, new moon first.
PHASES = (1.85, 7.38, 9.23, 13.84, 16.61, 22.15, 23.99)
#: Planets in the order of their hours, and each weekday's first (Monday first).
PLANETS = ("Saturn", "Jupiter", "Mars", "Sun", "Venus", "Mercury", "Moon")
DAY_PLANET = (6, 2, 5, 1, 4, 0, 3)
#: The zodiac's first days as month * 100 + day.
ZODIAC = (("Aquarius", 120), ("Pisces", 219), ("Aries", 321), ("Taurus", 420), ("Gemini", 521), ("Cancer", 621), ("Leo", 723), ("Virgo", 823), ("Libra", 923), ("Scorpio", 1023), ("Sagittarius", 1122), ("Capricorn", 1222))


def _mod(a: str, n: int) -> str:
    """Floor modulus of an integer expression."""
    return f"((({a}) % {n}) + {n}) % {n}"


def sky(d: Dialect) -> Stages:
    """Moon age and phase, planetary hour and its ruler, zodiac sign, sexagenary day pillar, Tzolkin tone, sign and kin."""
    s1 = {"ts": d.ts("us"), "day_n": f"CAST({d.day('us')} AS BIGINT)", "age0": f"(us - {NEW_MOON_US}) / {DAY_US}e0"}
    s2 = {"moon_age": f"age0 - floor(age0 / {SYNODIC}e0) * {SYNODIC}e0", "dow": d.weekday("ts"), "md": "month(ts) * 100 + day(ts)", "hour_n": "hour(ts)"}
    first = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(DAY_PLANET))
    sign = " ".join(f"WHEN md < {start} THEN '{(('Capricorn', 0), *ZODIAC)[i][0]}'" for i, (_, start) in enumerate(ZODIAC))
    s3 = {
        "phase_i": "CASE " + " ".join(f"WHEN moon_age < {x} THEN {i}" for i, x in enumerate(PHASES)) + " ELSE 7 END",
        "lunar_sin": f"sin(6.283185307179586e0 * moon_age / {SYNODIC}e0)", "first_planet": f"CASE dow {first} END",
        "zodiac_t": f"CASE {sign} ELSE 'Capricorn' END", "stem_i": _mod(f"day_n - {STEM_DAY}", 10), "branch_i": _mod(f"day_n - {STEM_DAY}", 12),
        "tone_i": _mod(f"day_n - {TZOLKIN_DAY} + 3", 13) + " + 1", "tzolkin_i": _mod(f"day_n - {TZOLKIN_DAY} + 19", 20),
    }
    s4 = {"hour_planet_i": f"(first_planet + {_mod('hour_n - 6', 24)}) % 7", "kin_i": "((tone_i - 1) * 20 + tzolkin_i) % 260 + 1", "element_i": d.div("stem_i", "2")}
    return [s1, s2, s3, s4, {"double_power": flag("hour_planet_i = first_planet")}]


def numbers(d: Dialect) -> Stages:
    """Digit root, master-keeping reduction, mirror, palindrome and contained sequences of the whole part of the close."""
    digits = lambda n, k: " + ".join(f"{d.div(n, str(10**i))} % 10" for i in range(k))
    s1 = {"n_i": "CAST(floor(close) AS BIGINT)"}
    s2 = {"root_i": "CASE WHEN n_i = 0 THEN 0 ELSE 1 + (n_i - 1) % 9 END", "r1": digits("n_i", 10), "text_n": "CAST(n_i AS STRING)"}
    keep = "IN (11, 22, 33)"
    s3 = {"r1k": f"CASE WHEN n_i <= 9 OR n_i {keep} THEN n_i ELSE r1 END"}
    s4 = {"r2k": f"CASE WHEN r1k <= 9 OR r1k {keep} THEN r1k ELSE {digits('r1k', 3)} END"}
    s5 = {"reduced_i": f"CASE WHEN r2k <= 9 OR r2k {keep} THEN r2k ELSE {digits('r2k', 2)} END", "mirror_i": "CAST(reverse(text_n) AS BIGINT)", "is_palindrome": flag("text_n = reverse(text_n)")}
    s5 |= {f"contains_{x}": flag(f"text_n LIKE '%{x}%'") for x in (113, 322, 93, 213, 666, 777, 911, 369, 33, 11, 22)}
    return [s1, s2, s3, s4, s5]
