"""DuckDB twins of the general problems' queries."""

#: The instant of ohlcv and space_weather rows: unit by magnitude, then the wall clock of `local` collectors to UTC.
_UNIT = """CASE WHEN {c} < 1000000000 THEN NULL WHEN {c} < 100000000000 THEN {c} * 1000000 WHEN {c} < 100000000000000 THEN {c} * 1000
 WHEN {c} < 100000000000000000 THEN {c} ELSE {c} // 1000 END"""
_INSTANT = """{n}_raw AS (SELECT t.*, c.epoch_basis, c.zone_name, {unit} AS wall FROM {tab} t LEFT JOIN collectors c USING (collector)),
{n} AS (SELECT *, CASE WHEN epoch_basis = 'local' THEN epoch_us(timezone(zone_name, make_timestamp(wall))) ELSE wall END AS utc_us
 FROM {n}_raw WHERE wall >= 1688169600000000 AND wall < 1740787200000000)"""


def _instants(name: str, tab: str, col: str) -> str:
    return _INSTANT.format(n=name, tab=tab, unit=_UNIT.format(c="t." + col))


#: Zone abbreviations of the collectors' zones, hours east of UTC.
_ABBR = {"UTC": 0, "GMT": 0, "BST": 1, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "JST": 9, "IST": 5.5, "BRT": -3, "AEST": 10, "AEDT": 11}
_HOURS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ABBR.items())


def text_instants(name: str, tab: str, col: str) -> str:
    """CTEs giving `name`: the rows of a table with text times plus utc_us."""
    t = f'trim(t."{col}")'
    wall = [
        "try_strptime(s, '%Y-%m-%d %H:%M:%S')", "try_strptime(s, '%Y-%m-%dT%H:%M')", "try_strptime(s, '%d.%m.%Y %H:%M:%S')", "try_strptime(s, '%d %b %Y %H:%M:%S')",
        "CASE WHEN date_order = 'dmy' THEN try_strptime(s, ['%d/%m/%Y %H:%M:%S', '%d/%m/%y %I:%M %p']) ELSE try_strptime(s, ['%m/%d/%Y %H:%M:%S', '%m/%d/%y %I:%M %p']) END",
    ]
    return f"""{name}_s AS (SELECT t.*, c.zone_name, c.date_order, {t} AS s FROM {tab} t LEFT JOIN collectors c USING (collector)),
{name}_w AS (SELECT *, coalesce({", ".join(wall)}) AS wall,
  CASE WHEN regexp_full_match(s, '[0-9]{{10}}([.][0-9]+)?') THEN CAST(round(CAST(s AS DOUBLE) * 1000000) AS BIGINT)
   WHEN regexp_full_match(s, '[0-9]{{13}}') THEN CAST(s AS BIGINT) * 1000
   WHEN regexp_full_match(s, '.* [A-Z]{{3,4}}') AND s NOT LIKE '%, % % % % GMT' OR regexp_full_match(s, '[A-Z][a-z]{{2}} [0-9]+, .* [A-Z]{{3,4}}') THEN
    epoch_us(try_strptime(regexp_replace(s, ' [A-Z]{{3,4}}$', ''), ['%Y/%m/%d %H:%M:%S', '%b %d, %Y %I:%M:%S %p']))
     - CAST(3600000000 * CASE regexp_extract(s, '[A-Z]{{3,4}}$') {_HOURS} END AS BIGINT)
   WHEN s LIKE '% GMT' THEN epoch_us(try_strptime(s, '%a, %d %b %Y %H:%M:%S GMT'))
   WHEN regexp_full_match(s, '[0-9]{{8}}T[0-9]{{6}}Z') THEN epoch_us(try_strptime(s, '%Y%m%dT%H%M%SZ'))
   WHEN regexp_full_match(s, '[A-Z].* [+-][0-9]{{4}} [0-9]{{4}}') THEN epoch_us(try_strptime(s, '%a %b %d %H:%M:%S %z %Y'))
   WHEN regexp_full_match(s, '.*[0-9] [+-][0-9]{{4}}') THEN epoch_us(try_strptime(s, '%Y-%m-%d %H:%M %z'))
   WHEN regexp_full_match(s, '[0-9]{{4}}-.*([+-][0-9]{{2}}:[0-9]{{2}}|Z)') THEN epoch_us(TRY_CAST(s AS TIMESTAMPTZ)) END AS own FROM {name}_s),
{name} AS (SELECT * FROM (SELECT *, coalesce(own, least(epoch_us(timezone(zone_name, wall)),
   CASE WHEN timezone(zone_name, timezone(zone_name, wall) - INTERVAL 1 HOUR) = wall THEN epoch_us(timezone(zone_name, wall) - INTERVAL 1 HOUR) END)) AS utc_us FROM {name}_w)
  WHERE utc_us >= 1688169600000000 AND utc_us < 1740787200000000)"""


BARS = _instants("bars", "ohlcv", "open_time")
WIND = _instants("wind", "space_weather", '"timestamp"')
_CLEAN = "CASE WHEN {c} IS NULL OR isnan({c}) OR abs({c}) >= 1e24 THEN 0 ELSE {c} END"
_UNFIT = "CASE WHEN NOT isnan({c}) AND abs({c}) >= 1e24 THEN 1 ELSE 0 END"

_DAYS = f"""WITH {BARS},
keyed AS (SELECT collector, symbol, timeframe, utc_us, utc_us // 86400000000 AS day,
  arg_max({_CLEAN.format(c="volume")}, row_id) AS volume, arg_max({_CLEAN.format(c="taker_buy_volume")}, row_id) AS taker_buy_volume,
  max(CASE WHEN volume > 0 AND NOT isnan(volume) THEN 1 ELSE 0 END) AS active,
  arg_max({_UNFIT.format(c="volume")} + {_UNFIT.format(c="taker_buy_volume")}, row_id) AS unfit FROM bars GROUP BY ALL),
daily AS (SELECT collector, symbol, day, sum(CAST(volume AS DECIMAL(38, 6))) AS volume,
  sum(CAST(taker_buy_volume AS DECIMAL(38, 6))) AS taker_buy_volume, sum(active) AS active, sum(unfit) AS unfit FROM keyed GROUP BY ALL),
span AS (SELECT collector, symbol, min(day) AS a, max(day) AS b FROM daily GROUP BY ALL),
dense AS (SELECT s.collector, s.symbol, s.a, x.d AS day, coalesce(volume, 0) AS volume, coalesce(taker_buy_volume, 0) AS taker_buy_volume,
  coalesce(active, 0) AS active, coalesce(unfit, 0) AS unfit FROM (SELECT *, unnest(range(a, b + 1)) AS d FROM span) x JOIN span s USING (collector, symbol)
  LEFT JOIN daily y ON y.collector = x.collector AND y.symbol = x.symbol AND y.day = x.d)"""

_SUM = "sum({v}) OVER (PARTITION BY collector, symbol ORDER BY day ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"


def _rolling() -> str:
    cols = []
    for v in ("volume", "taker_buy_volume"):
        for w in (7, 30):
            s = f"CAST({_SUM.format(v=v, k=w - 1)} AS DOUBLE)"
            cols += [f"{s} AS {v}_{w}", f"{s} / least({w}, day - a + 1) AS {v}_avg_{w}"]
    cols += [f"CAST({_SUM.format(v=v, k=w - 1)} AS BIGINT) AS {v}_{w}" for v in ("active", "unfit") for w in (7, 30)]
    return f"{_DAYS} SELECT collector, symbol, strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS day_utc, {', '.join(cols)} FROM dense"


def _as_known(tab: str, out: str) -> str:
    return f"""(SELECT arg_max(m.row_id, (CAST(left(trim(m.date), 10) AS DATE), m.known_at, m.row_id)) FROM {tab} m
 WHERE m.known_at IS NOT NULL AND epoch_us(m.known_at) <= b.utc_us
 AND CAST(left(trim(m.date), 10) AS DATE) <= CAST(make_timestamp(b.utc_us) AS DATE)) AS {out}"""


CHAIN, TWEETS = text_instants("chain", "onchain_data", "timestamp"), text_instants("tweeted", "tweets", "created_at")
DATED = """dated AS (SELECT *, epoch_us(CAST(CAST(trim(date) AS DATE) AS TIMESTAMP)) AS utc_us FROM macro)"""
_FOUND3 = " UNION ALL ".join(
    (
        "SELECT 'ohlcv' AS tab, row_id, utc_us FROM bars WHERE CAST(open_time AS HUGEINT) * 1000 <> utc_us",
        "SELECT 'space_weather', row_id, utc_us FROM wind WHERE CAST(\"timestamp\" AS HUGEINT) * 1000000 <> utc_us",
        "SELECT 'onchain_data', id, utc_us FROM chain WHERE NOT regexp_full_match(\"timestamp\", '[0-9-]{10}T[0-9:]{8}[+]00:00')",
        "SELECT 'tweets', row_id, utc_us FROM tweeted WHERE NOT regexp_full_match(created_at, '[0-9-]{10}T[0-9:]{8}[+]00:00')",
    )
)
_SLOTS = """SELECT '{tab}' AS tab, collector, {series} AS series, s AS slot FROM (
 SELECT collector, {group} unnest(range(min(utc_us // {us}), max(utc_us // {us}) + 1)) AS s FROM {src}
 WHERE {x} IS NOT NULL AND NOT isnan({x}) GROUP BY collector{by}) t
 EXCEPT SELECT '{tab}', collector, {series}, utc_us // {us} FROM {src} WHERE {x} IS NOT NULL AND NOT isnan({x})"""
_FOUND4 = " UNION ALL ".join(
    f"(SELECT tab, collector, series, slot * {w} AS slot_start FROM ({_SLOTS.format(tab=tab, series=series, group="" if series == "''" else "series,", by="" if series == "''" else ", series", us=w * 1000000, src=src, x=x)}))"
    for tab, src, series, x, w in (
        ("space_weather", "wind", "''", "kp_index", 10800),
        ("onchain_data", "chain", "''", "funding_rate", 28800),
        ("macro", "dated", "series", "value", 86400),
    )
)



def _excursions(name: str, src: str, keys: str, x: str, relative: bool, busy: str) -> str:
    """CTEs: {name} = (keys, utc_us) of excursions and stuck readings among the plausible readings of src."""
    w = f"OVER (PARTITION BY {keys} ORDER BY utc_us)"
    off = lambda v, n: f"({v} - {n})" + (f" / {n}" if relative else "")

    def apart(values: list[str], sides: list[str]) -> str:
        gaps = [off(v, n) for v in values for n in sides]
        return "(" + " AND ".join(f"{g} > 12 * m" for g in gaps) + " OR " + " AND ".join(f"{g} < -12 * m" for g in gaps) + ")"

    exact = " OR ".join((apart(["x"], ["p1", "n1"]), apart(["x", "n1"], ["p1", "n2"]), apart(["x", "p1"], ["p2", "n1"])))
    step = "abs(x - p1)" + (" / p1" if relative else "")
    return f"""{name}_q AS (SELECT {keys}, utc_us, {x} AS x, {busy} AS busy FROM {src}),
{name}_n AS (SELECT *, lag(x) {w} AS p1, lag(x, 2) {w} AS p2, lead(x) {w} AS n1, lead(x, 2) {w} AS n2, lag(busy) {w} AS pb FROM {name}_q),
{name}_m AS (SELECT {keys}, quantile_cont({step}, 0.5) AS m FROM {name}_n WHERE busy AND pb GROUP BY ALL),
{name}_i AS (SELECT *, sum(CASE WHEN busy AND pb AND x = p1 THEN 0 ELSE 1 END) {w} AS island FROM {name}_n),
{name}_r AS (SELECT *, count(*) OVER (PARTITION BY {keys}, island) AS len, row_number() OVER (PARTITION BY {keys}, island ORDER BY utc_us) AS nth FROM {name}_i),
{name}_e AS (SELECT {keys}, utc_us FROM {name}_r JOIN {name}_m USING ({keys}) WHERE {exact}),
{name} AS (SELECT {keys}, utc_us FROM {name}_e UNION SELECT {keys}, utc_us FROM {name}_r WHERE busy AND len >= 6 AND nth > 1)"""


_K = "collector, symbol, timeframe"
_VW = f"OVER (PARTITION BY {_K} ORDER BY utc_us)"
_FOUND2 = f"""WITH {BARS}, {WIND},
f AS (SELECT {_K}, utc_us, CASE WHEN NOT isnan(close) THEN close END AS c, CASE WHEN NOT isnan(volume) THEN volume END AS v
 FROM bars QUALIFY row_number() OVER (PARTITION BY {_K}, utc_us ORDER BY row_id) = 1),
fw AS (SELECT collector, utc_us, CASE WHEN NOT isnan(solar_wind_speed) THEN solar_wind_speed END AS s FROM wind QUALIFY row_number() OVER (PARTITION BY collector, utc_us ORDER BY row_id) = 1),
fc AS (SELECT * FROM f WHERE c > 0 AND c <= 1e9), fv AS (SELECT * FROM f WHERE v >= 0 AND v <= 1e14), fs AS (SELECT * FROM fw WHERE s > 0 AND s <= 5000),
{_excursions("xc", "fc", _K, "c", True, "coalesce(v > 0, FALSE)")},
{_excursions("xv", "fv", _K, "v", False, "coalesce(v > 0, FALSE)")},
{_excursions("xs", "fs", "collector", "s", False, "TRUE")},
sv AS (SELECT {_K}, utc_us FROM xv_r WHERE busy AND len >= 6 AND nth > 1 UNION SELECT {_K}, utc_us FROM
 (SELECT *, lag(v) {_VW} AS p1, lead(v) {_VW} AS n1 FROM fv WHERE v > 0) WHERE v > 15 * p1 AND v > 15 * n1 UNION SELECT {_K}, utc_us FROM f WHERE v < 0 OR v > 1e14),
sc AS (SELECT {_K}, utc_us FROM xc UNION SELECT {_K}, utc_us FROM f WHERE c <= 0 OR c > 1e9),
sw AS (SELECT collector, utc_us FROM xs UNION SELECT collector, utc_us FROM fw WHERE s <= 0 OR s > 5000)
SELECT 'ohlcv' AS tab, row_id, 'close' AS field FROM bars JOIN sc USING ({_K}, utc_us)
UNION ALL SELECT 'ohlcv', row_id, 'volume' FROM bars JOIN sv USING ({_K}, utc_us)
UNION ALL SELECT 'space_weather', row_id, 'solar_wind_speed' FROM wind JOIN sw USING (collector, utc_us)"""



def _hampel(src: str, keys: str, x: str, field: str, log: bool, exact: str) -> str:
    """Rolling median and deviation of seven readings, the filter's verdict, and the excursions of `exact` it proposes."""
    w = lambda k: f"OVER (PARTITION BY {keys} ORDER BY utc_us ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    v = f"OVER (PARTITION BY {keys} ORDER BY utc_us)"
    out = ", ".join(k if k in keys else f"'' AS {k}" for k in ("collector", "symbol", "timeframe"))
    z = f"ln({x})" if log else x
    mad = lambda n: f"list_aggregate(list_transform(near{n}, lambda v: abs(v - med{n})), 'median') AS mad{n}"
    f32 = lambda c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    name = keys.replace(", ", " || ':' || ")
    return f"""SELECT {out}, '{field}' AS field, utc_us, {x} AS value, {f32('med7')} AS local_median, {f32('mad7')} AS local_mad, far7 AS hampel,
 (far7 OR far5 OR coalesce(lag(far5) {v}, FALSE) OR coalesce(lead(far5) {v}, FALSE)) AND ({name} || ':' || utc_us) IN (SELECT {name} || ':' || utc_us FROM {exact}) AS excursion FROM
 (SELECT *, abs(z - med7) > 1.4826 * 1.5 * mad7 AS far7, abs(z - med5) > 1.4826 * 1.5 * mad5 AS far5 FROM (SELECT *, {mad(7)}, {mad(5)} FROM
 (SELECT *, {z} AS z, list({z}) {w(3)} AS near7, median({z}) {w(3)} AS med7, list({z}) {w(2)} AS near5, median({z}) {w(2)} AS med5 FROM {src}) a) b) c"""


_LOCAL = "timezone(zone_name, {w})"
_TWICE = "(" + " OR ".join(f"timezone(zone_name, {_LOCAL} {s} INTERVAL 1 HOUR) = {{w}}" for s in "+-") + ")"
_NEVER = f"timezone(zone_name, {_LOCAL}) <> {{w}}"
_IN_SPAN = "{w} >= 1688169600000000 AND {w} < 1740787200000000"


def _normalised() -> str:
    """Every row of the four tables with its instant and flags."""
    parts = []
    for tab, name, col, unit in (("ohlcv", "bars", "open_time", 1000), ("space_weather", "wind", '"timestamp"', 1000000)):
        wall = "make_timestamp(wall)"
        local = f"coalesce(epoch_basis = 'local' AND {_IN_SPAN.format(w='wall')}, FALSE)"
        us = f"CASE WHEN {_IN_SPAN.format(w='wall')} THEN CASE WHEN epoch_basis = 'local' THEN CASE WHEN NOT {_NEVER.format(w=wall)} THEN epoch_us({_LOCAL.format(w=wall)}) END ELSE wall END END"
        parts.append(f"""SELECT '{tab}' AS tab, row_id, u AS utc_us, coalesce(CAST({col} AS HUGEINT) * {unit} = u, FALSE) AS standard, amb AS ambiguous, never AS nonexistent FROM
 (SELECT *, {us} AS u, {local} AND coalesce({_TWICE.format(w=wall)}, FALSE) AS amb, {local} AND coalesce({_NEVER.format(w=wall)}, FALSE) AS never FROM {name}_raw) q""")
    for tab, name, key, col in (("onchain_data", "chain", "id", '"timestamp"'), ("tweets", "tweeted", "row_id", "created_at")):
        plain = "own IS NULL AND wall IS NOT NULL AND zone_name IS NOT NULL"
        parts.append(f"""SELECT '{tab}', w.{key}, r.utc_us, coalesce(r.utc_us IS NOT NULL AND regexp_full_match(w.{col}, '[0-9-]{{10}}T[0-9:]{{8}}[+]00:00'), FALSE),
 {plain} AND coalesce({_IN_SPAN.format(w='epoch_us(wall)')} AND {_TWICE.format(w='wall')}, FALSE), {plain} AND coalesce({_IN_SPAN.format(w='epoch_us(wall)')} AND {_NEVER.format(w='wall')}, FALSE)
 FROM {name}_w w LEFT JOIN (SELECT {key} AS k, utc_us FROM {name}) r ON r.k = w.{key}""")
    return f"WITH {BARS}, {WIND}, {CHAIN}, {TWEETS} " + " UNION ALL ".join(parts)


_EXACT = _FOUND2[: _FOUND2.index("sv AS (")]
_SURGE = f"surge AS (SELECT {_K}, utc_us FROM (SELECT *, lag(v) {_VW} AS p1, lead(v) {_VW} AS n1 FROM fv WHERE v > 0) q WHERE v > 15 * p1 AND v > 15 * n1)"
SQL = {
    "p3_normalised": _normalised(),
    "p2_hampel": f"{_EXACT} {_SURGE}, positive AS (SELECT * FROM fv WHERE v > 0) "
    + " UNION ALL ".join((_hampel("fc", _K, "c", "close", True, "xc_e"), _hampel("positive", _K, "v", "volume", True, "surge"), _hampel("fs", "collector", "s", "solar_wind_speed", False, "xs_e"))),
    "p1_rolling_totals": _rolling(),
    "p1_found": f"SELECT collector, symbol, day_utc FROM ({_rolling()}) WHERE active_7 = 0",
    "p2_found": _FOUND2,
    "p3_found": f"WITH {BARS}, {WIND}, {CHAIN}, {TWEETS} {_FOUND3}",
    "p4_found": f"WITH {WIND}, {CHAIN}, {DATED} {_FOUND4}",
    "p5_found": f"WITH {BARS} SELECT b.row_id, {_as_known('macro_data', 'macro_row_id')}, {_as_known('ephemeris', 'ephemeris_row_id')} FROM bars b WHERE symbol = 'BTC'",
}
