"""Roll-ups of texts and events, sources and sinks, calendars and reports as queries, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import ciphers, sky
from barloom.operators import align, quantiles
from barloom.plans import relational
from barloom.plans.portable import DUCK, Dialect, Stages, change, compile_stages, feature_query, flag, lag, lead, over, ratio, rolling
from barloom.plans.relational import common, f32
from barloom.session import stored
from barloom.sources.bars import DUCK_BARS, bars

QUERIES, SQL = relational.QUERIES, relational.SQL  # one registry: common() writes into it


def _root(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE 1 + ({n} - 1) % 9 END"


def _words(d: Dialect, t: str) -> str:
    return f"regexp_extract_all({t}, '\\w+')" if d.duck else f"regexp_extract_all({t}, r'(\\w+)', 1)"


def _hits(d: Dialect, text: str) -> dict[str, str]:
    """Bullish whole words, words with a bearish beginning, shouted words, exclamation marks, urgency of a text."""
    low = f"lower(coalesce({text}, ''))"
    bull, bear = ", ".join(f"'{w}'" for w in ciphers.BULL), "|".join(ciphers.BEAR)
    match = (lambda w, p: f"regexp_matches({w}, '{p}')") if d.duck else (lambda w, p: f"{w} RLIKE r'{p}'")
    split = f"regexp_split_to_array(coalesce({text}, ''), '\\s+')" if d.duck else f"split(coalesce({text}, ''), r'\\s+')"
    shouted = f"length(w) > 1 AND {match('w', '[[:upper:]]' if d.duck else '[A-Z]')} AND NOT {match('w', '[[:lower:]]' if d.duck else '[a-z]')}"
    return {
        "bull": d.size(d.filter(_words(d, low), "w", f"w IN ({bull})")), "bear": d.size(d.filter(_words(d, low), "w", match("w", f"^({bear})"))), "caps": d.size(d.filter(split, "w", shouted)),
        "marks": f"length(coalesce({text}, '')) - length(replace(coalesce({text}, ''), '!', ''))", "urgent": "CASE WHEN " + " OR ".join(f"{low} LIKE '%{u}%'" for u in ciphers.URGENT) + " THEN 1 ELSE 0 END",
    }


SETS = ciphers.TARGETS


def _texts(d: Dialect, table: str, key: str, text: str) -> str:
    """key, six cipher sums with their roots, word hits, score and set flags of every row with a key."""
    sums = ", ".join(f"CAST({ciphers.cipher_sql(text, n)} AS BIGINT) AS c_{n}" for n in ciphers.CIPHERS)
    hits = ", ".join(f"{e} AS {n}" for n, e in _hits(d, text).items())
    roots = ", ".join(f"{_root(f'c_{n}')} AS r_{n}" for n in ciphers.CIPHERS)
    sets = ", ".join(f"CASE WHEN {' OR '.join(f'c_{n} IN ({', '.join(map(str, v))})' for n in ciphers.CIPHERS if n != 'reduction')} THEN 1 ELSE 0 END AS is_{s}" for s, v in SETS.items())
    score = "coalesce((bull - bear) / nullif(CAST(bull + bear AS DOUBLE), 0), 0e0) AS score"
    return f"(SELECT *, {roots}, {sets}, {score} FROM (SELECT {key}, {sums}, {hits} FROM {table}) x0)"


def _rollup(d: Dialect, source: str, keys: str) -> str:
    """Thirty aggregates per key: means of ciphers, modes of their roots (the smallest on ties), flags, sentiment, counts."""
    means = ", ".join(f"{f32(f'avg(c_{n})')} AS {n}_mean" for n in ciphers.CIPHERS)
    on = " AND ".join(f"a.{k} = m.{k}" for k in keys.split(", "))
    tall = " UNION ALL ".join(f"SELECT {keys}, '{n}' AS cipher, r_{n} AS root FROM {source} s{i}" for i, n in enumerate(ciphers.CIPHERS))
    modes = ", ".join(f"max(CASE WHEN cipher = '{n}' THEN root END) AS {n}_mode" for n in ciphers.CIPHERS)
    m = f"""SELECT {keys}, {modes} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, cipher ORDER BY k DESC, root) AS rn FROM
 (SELECT {keys}, cipher, root, count(*) AS k FROM ({tall}) y GROUP BY {keys}, cipher, root) z) w WHERE rn = 1 GROUP BY {keys}"""
    a = f"""SELECT {keys}, count(*) AS n, {means}, {', '.join(f'max(is_{s}) AS any_{s}' for s in SETS)}, {f32('avg(score)')} AS score_mean, {f32('min(score)')} AS score_min, {f32('max(score)')} AS score_max,
 CAST(sum(bull) AS BIGINT) AS bulls, CAST(sum(bear) AS BIGINT) AS bears, CAST(sum(caps) AS BIGINT) AS shouted, CAST(sum(marks) AS BIGINT) AS exclamations, max(urgent) AS any_urgent FROM {source} s GROUP BY {keys}"""
    return f"SELECT a.*, {', '.join(f'm.{n}_mode' for n in ciphers.CIPHERS)} FROM ({a}) a JOIN ({m}) m ON {on}"


def _tweets(d: Dialect) -> str:
    return _texts(d, "{tweeted}", f"collector, {d.div('utc_us', '14400000000')} AS bucket", "full_text")


def _news(d: Dialect) -> str:
    us = "epoch_us(published_at)" if d.duck else "unix_micros(published_at)"
    table = f"(SELECT *, {us} AS p_us FROM {{documents}} WHERE published_at IS NOT NULL AND outlet IS NOT NULL) q"
    return _texts(d, table, f"outlet, {d.div('p_us', '86400000000')} AS day", "text")


common("tweet_rollup", lambda d: _rollup(d, _tweets(d), "collector, bucket"))
common("news_rollup", lambda d: _rollup(d, _news(d), "outlet, day"))


def _alignment(d: Dialect) -> str:
    """Daily sentiment of tweets and of news: agreement and conflict, NULL unless both are there."""
    t = f"SELECT day, avg(score) AS s FROM (SELECT {d.div('bucket', '6')} AS day, score FROM {_tweets(d)} t0) t1 GROUP BY day"
    n = f"SELECT day, avg(score) AS s FROM {_news(d)} n0 GROUP BY day"
    both = "t.s IS NOT NULL AND n.s IS NOT NULL"
    agree, differ = "t.s > 0 AND n.s > 0 OR t.s < 0 AND n.s < 0", "t.s > 0 AND n.s < 0 OR t.s < 0 AND n.s > 0"
    return f"""SELECT coalesce(t.day, n.day) AS day, {f32('t.s')} AS tweets, {f32('n.s')} AS news, CASE WHEN {both} THEN CASE WHEN {agree} THEN 1 ELSE 0 END END AS alignment,
 CASE WHEN {both} THEN CASE WHEN {differ} THEN 1 ELSE 0 END END AS conflict FROM ({t}) t FULL JOIN ({n}) n ON t.day = n.day"""


common("sentiment_alignment", _alignment)


def _matches(d: Dialect) -> str:
    """Equal roots between ciphers of a document, shared values with the ciphers of its asset, convergence of flags."""
    r = ("ordinal", "reverse", "reduction", "english")
    pairs = [(a, b) for i, a in enumerate(r) for b in r[i + 1 :]]
    target = ", ".join(f"CAST({ciphers.cipher_sql('asset', n)} AS BIGINT) AS a_{n}" for n in r)
    eq = {f"{a}_{b}": f"CASE WHEN r_{a} = r_{b} THEN 1 ELSE 0 END" for a, b in pairs}
    return f"""SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in eq.items())}, CASE WHEN r_ordinal = r_reverse AND r_reverse = r_reduction THEN 1 ELSE 0 END AS triple,
 {' + '.join(eq.values())} AS matches, {' + '.join(f'CASE WHEN c_{n} % 1000 = a_{n} AND a_{n} > 0 THEN 1 ELSE 0 END' for n in r)} AS asset_hits, is_caution + is_pump + is_energy AS convergence
 FROM {_texts(d, '{documents}', f'doc_id, {target}', 'text')} t"""


common("cipher_matches", _matches)

# ---------------------------------------------------------------- sources and sinks
_CLOCK = 1735689600000000
_AGES = (("ohlcv", "bars", "us", 24), ("space_weather", "wind", "utc_us", 6), ("onchain_data", "chain", "utc_us", 12), ("tweets", "tweeted", "utc_us", 12), ("funding_rates", "funding_rates", "ts_unix * 1000", 24), ("open_interest", "open_interest", "ts_unix * 1000000", 6))
common("freshness_all", lambda d: f"""SELECT tab, max(us) AS newest_us, ({_CLOCK} - max(us)) / 60000000e0 AS age_minutes, CASE WHEN {_CLOCK} - max(us) > 3600000000 * limit_h THEN 1 ELSE 0 END AS stale FROM ({
    ' UNION ALL '.join(f"SELECT '{n}' AS tab, {u} AS us, {h} AS limit_h FROM {{{t}}}" for n, t, u, h in _AGES)}) t GROUP BY tab, limit_h""")
_TABLES = ("ohlcv", "space_weather", "onchain_data", "tweets", "macro", "funding_rates", "open_interest", "macro_data", "ephemeris")
common("availability", lambda d: " UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n, CASE WHEN count(*) > 0 THEN 'present' ELSE 'missing' END AS state FROM {{{t}}}" for t in _TABLES))
common("store_fallback", lambda d: """SELECT symbol, tf, us, series, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf, us ORDER BY store, series) AS rn FROM
 (SELECT 1 AS store, symbol, tf, us, series, close FROM {bars} WHERE volume IS NOT NULL UNION ALL SELECT 2, symbol, tf, us, series, close FROM {bars} WHERE symbol = 'BTC') u) v WHERE rn = 1""")
common("window_map", lambda d: " UNION ALL ".join(
    f"SELECT series, '{p}' AS parent, bucket, close FROM (SELECT series, bucket, close, row_number() OVER (PARTITION BY series ORDER BY bucket DESC) AS rn FROM (SELECT series, {d.div('us', str(w * 1_000_000))} AS bucket, {d.arg_max('close', 'us')} AS close FROM {{bars}} GROUP BY 1, 2) {p}0) {p}1 WHERE rn <= {n}"
    for p, w, n in (("h4", 14400, 120), ("d", 86400, 60), ("w", 604800, 26))))
common("append_new_dates", lambda d: """SELECT collector, series, date, max(row_id) AS row_id FROM {macro} m WHERE NOT EXISTS (SELECT 1 FROM {macro_data} x WHERE substr(trim(x.date), 1, 10) = m.date AND x.spx IS NULL) GROUP BY 1, 2, 3""")
common("hash_dedup", lambda d: f"""SELECT hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {"sha256(lower(trim(text)))" if d.duck else "sha2(lower(trim(text)), 256)"} AS hash FROM {{documents}} WHERE text IS NOT NULL) t GROUP BY hash""")
common("hourly_variance", lambda d: f"""SELECT hour, count(*) AS samples, {f32('avg(z2)')} AS mean_z2, {f32('max(z2)')} AS max_z2, {f32('stddev_samp(z2)')} AS sd_z2 FROM (
 SELECT {d.div('us', '3600000000')} AS hour, ((value - m) / nullif(s, 0)) * ((value - m) / nullif(s, 0)) AS z2 FROM (SELECT event_type, {"epoch_us(ts)" if d.duck else "unix_micros(CAST(ts AS TIMESTAMP))"} AS us, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM {{events}}) e) f GROUP BY hour HAVING count(*) >= 10""")
common("fixed_width_text", lambda d: f"""SELECT row_id, {f32('CAST(p1 AS DOUBLE)')} AS sun, {f32('(CAST(p2 AS DOUBLE) + CAST(p3 AS DOUBLE)) / 2')} AS mean_two FROM (SELECT row_id, {
    ', '.join(f"split_part(regexp_replace(trim(line), ' +', ' '{", 'g'" if d.duck else ''}), ' ', {k}) AS p{k}" for k in (1, 2, 3))} FROM (SELECT row_id, '  ' || CAST(sun_lon AS STRING) || '    ' || CAST(moon_lon AS STRING) || '  ' || CAST(mars_lon AS STRING) AS line FROM {{ephemeris}} WHERE sun_lon IS NOT NULL AND moon_lon IS NOT NULL AND mars_lon IS NOT NULL AND NOT isnan(sun_lon) AND NOT isnan(moon_lon) AND NOT isnan(mars_lon)) l) p""")
common("json_map_cache", lambda d: "SELECT collector, CAST(k AS BIGINT) AS epoch, CAST(v AS DOUBLE) AS rate FROM (SELECT collector, " + (
    "unnest(json_keys(j)) AS k, json_extract_string(j, '$.\"' || unnest(json_keys(j)) || '\"') AS v" if d.duck else "explode(from_json(j, 'map<string,string>')) AS (k, v)") + f""" FROM (SELECT collector, '{{{{' || {
    "string_agg" if d.duck else "listagg"}('"' || CAST(ts AS STRING) || '":"' || CAST(n AS STRING) || '"', ',') || '}}}}' AS j FROM (SELECT collector, {d.div('ts_unix', '86400000')} AS ts, count(*) AS n FROM {{funding_rates}} WHERE ts_unix IS NOT NULL GROUP BY 1, 2) c GROUP BY collector) s) m""")

# ---------------------------------------------------------------- joins, set operations, reports
def _published(d: Dialect) -> str:
    us = "epoch_us(published_at)" if d.duck else "unix_micros(published_at)"
    return f"(SELECT {d.div(us, '86400000000')} AS day, lang, text FROM {{documents}} WHERE published_at IS NOT NULL)"


common("hour_pairing", lambda d: f"""SELECT b.series, b.us, t.n AS tweets, {f32('abs(b.close / b.open - 1)')} AS move FROM {{bars}} b JOIN (SELECT collector, {d.div('utc_us', '3600000000')} AS h, count(*) AS n FROM {{tweeted}} GROUP BY 1, 2) t
 ON t.collector = split_part(b.series, ':', 1) AND t.h = {d.div('b.us', '3600000000')}""")
common("key_intersection", lambda d: "SELECT collector, symbol FROM {funding_rates} INTERSECT SELECT collector, symbol FROM {open_interest}")
common("key_difference", lambda d: "SELECT collector, symbol || 'USDT' AS symbol FROM {ohlcv} EXCEPT SELECT collector, symbol FROM {funding_rates}")
common("column_union", lambda d: "SELECT row_id, 'space_weather' AS tab, kp_index, CAST(NULL AS DOUBLE) AS value FROM {space_weather} UNION ALL SELECT row_id, 'macro', CAST(NULL AS DOUBLE), value FROM {macro}")
common("spine_by_group", lambda d: f"""SELECT s.day, {', '.join(f'coalesce(n_{l}, 0) AS docs_{l}' for l in ('en', 'de', 'es', 'fr'))}, coalesce(total, 0) AS total, coalesce(cautions, 0) AS cautions FROM (SELECT {'unnest(range(a, z + 1))' if d.duck else 'explode(sequence(a, z))'} AS day FROM
 (SELECT min(day) AS a, max(day) AS z FROM {_published(d)} r) q) s LEFT JOIN (SELECT day, count(*) AS total, {', '.join(f"count(CASE WHEN lang = '{l}' THEN 1 END) AS n_{l}" for l in ('en', 'de', 'es', 'fr'))}, count(CASE WHEN lower(text) LIKE '%caution%' THEN 1 END) AS cautions FROM {_published(d)} r2 GROUP BY day) c ON c.day = s.day""")
common("exchange_premium", lambda d: f"""SELECT symbol, tf, us, count(*) AS sources, {f32('(max(close) - min(close)) / min(close)')} AS premium FROM {{bars}} GROUP BY symbol, tf, us HAVING count(*) > 1""")
_ONE = lambda e: f"(SELECT {e} FROM {{bars}})"
common("zscored_inputs", lambda d: f"""SELECT series, us, {f32(f"(high - low - {_ONE('avg(high - low)')}) / coalesce(nullif({_ONE('stddev_pop(high - low)')}, 0), 1)")} AS range_z,
 {f32(f"(close - open - {_ONE('avg(close - open)')}) / coalesce(nullif({_ONE('stddev_pop(close - open)')}, 0), 1)")} AS body_z FROM {{bars}}""")


def _edges(d: Dialect) -> str:
    """Share of rising next bars where the close lies high or low against its mean, and where the distance rises or falls."""
    w = "OVER (PARTITION BY series ORDER BY us)"
    inner = f"SELECT series, tf, close / nullif(avg(close) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) - 1 AS dist, lead(close) {w} / close - 1 AS nxt, us FROM {{bars}}"
    rows = f"SELECT tf, round(dist, 10) AS dist, round(dist - lag(dist) {w}, 10) AS step, nxt FROM ({inner}) a"
    share = lambda c: f32(f"avg(CASE WHEN {c} THEN CASE WHEN nxt > 0 THEN 1e0 ELSE 0e0 END END)")
    return f"""SELECT tf, count(*) AS n, {share('dist > 0.02')} AS up_when_high, {share('dist < -0.02')} AS up_when_low, {share('step > 0')} AS up_when_rising, {share('step < 0')} AS up_when_falling FROM ({rows}) b WHERE nxt IS NOT NULL GROUP BY tf"""


common("directional_edges", _edges)
common("ticker_numbers", lambda d: f"""SELECT DISTINCT symbol, {', '.join(f"CAST({ciphers.cipher_sql('symbol', n)} AS BIGINT) AS {n}" for n in ciphers.CIPHERS)} FROM {{ohlcv}}""")
common("price_matches_ticker", lambda d: f"""SELECT series, us, CASE WHEN CAST(floor(close) AS BIGINT) % 1000 IN (v, w) THEN 1 ELSE 0 END AS matched FROM (SELECT series, us, close, CAST({ciphers.cipher_sql('symbol', 'ordinal')} AS BIGINT) AS v, CAST({ciphers.cipher_sql('symbol', 'jewish')} AS BIGINT) AS w FROM {{bars}}) t""")


def event_definitions(d: Dialect) -> Stages:
    """Sequence-model events: volume climax and moves of 2.5 true ranges, and whether one comes in the next five bars."""
    s1 = {"tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))", "v20": rolling("avg", "volume", 20, digits=None), "move": f"close - {lag('close')}"}
    s2 = {"atr": rolling("avg", "tr", 14), "climax": flag("volume > 3 * v20")}
    s3 = {"big_up": flag(f"move > 2.5 * {lag('atr')}"), "big_down": flag(f"move < -2.5 * {lag('atr')}")}
    ahead = "OVER (PARTITION BY series ORDER BY us ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
    return [s1, s2, s3, {f"{e}_ahead_i": f"max({e}) {ahead}" for e in ("climax", "big_up", "big_down")}]


QUERIES["event_definitions"], SQL["event_definitions"] = feature_query(event_definitions, bars, DUCK_BARS, ["climax", "big_up", "big_down", "climax_ahead_i", "big_up_ahead_i", "big_down_ahead_i"])

#: Scheduled rate decisions of 2023 to 2025; new years of the Chinese calendar; feast days of the cultural calendars (month * 100 + day by year).
RATE_DECISIONS = ("2023-09-20", "2023-11-01", "2023-12-13", "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12", "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18", "2025-01-29")
NEW_YEARS = ("2023-01-22", "2024-02-10", "2025-01-29")
FEASTS = {"easter": ("2023-04-09", "2024-03-31", "2025-04-20"), "diwali": ("2023-11-12", "2024-11-01", "2025-10-20"), "eid": ("2023-04-21", "2024-04-10", "2025-03-30"), "yom_kippur": ("2023-09-24", "2024-10-11", "2025-10-01"), "ramadan": ("2023-03-23", "2024-03-11", "2025-03-01")}


def market_calendar(d: Dialect) -> Stages:
    """Rate decisions, price index and payroll windows, option expiries, year parts, feast days, halving phase, moving-average top."""
    day = lambda ds: ", ".join(f"DATE '{x}'" for x in ds)
    apart = (lambda x: f"abs(datediff('day', date_n, DATE '{x}'))") if d.duck else (lambda x: f"abs(datediff(date_n, DATE '{x}'))")
    since = (lambda x: f"datediff('day', DATE '{x}', date_n)") if d.duck else (lambda x: f"datediff(date_n, DATE '{x}')")
    s1 = {"ts": d.ts("us"), "m111": rolling("avg", "close", 111, 60), "m350": rolling("avg", "close", 350, 200)}
    s2 = {"date_n": "CAST(ts AS DATE)", "dow": d.weekday("ts"), "dom": "day(ts)", "mon": "month(ts)", "y": "year(ts)"}
    s3 = {
        "fomc_day": flag(f"date_n IN ({day(RATE_DECISIONS)})"), "fomc_near": flag(" OR ".join(f"{apart(x)} <= 2" for x in RATE_DECISIONS)), "cpi_window": flag("dom BETWEEN 10 AND 15"), "nfp_day": flag("dow = 4 AND dom <= 7"),
        "opex_last_friday": flag("dow = 4 AND dom > day(last_day(ts)) - 7"), "quarterly_expiry": flag("dow = 4 AND dom > day(last_day(ts)) - 7 AND mon % 3 = 0"),
        "tax_season": flag("mon = 4 AND dom <= 18"), "payday": flag("dom IN (1, 15)"), "january": flag("mon = 1"), "santa_week": flag("mon = 12 AND dom >= 24"), "september": flag("mon = 9"), "election_year": flag("y % 4 = 0"),
        "chinese_new_year": flag(" OR ".join(f"{apart(x)} <= 7" for x in NEW_YEARS)), **{f"near_{n}": flag(" OR ".join(f"{apart(x)} <= 3" for x in ds)) for n, ds in FEASTS.items() if n != "ramadan"},
        "in_ramadan": flag(" OR ".join(f"{since(x)} BETWEEN 0 AND 30" for x in FEASTS["ramadan"])), "halving_days_i": since("2024-04-19"), "reward": "CASE WHEN date_n >= DATE '2024-04-19' THEN 3.125e0 ELSE 6.25e0 END",
        "palindrome_day": flag("CAST(y * 10000 + mon * 100 + dom AS STRING) = reverse(CAST(y * 10000 + mon * 100 + dom AS STRING))"), "friday_13": flag("dow = 4 AND dom = 13"),
        "pi_cycle": ratio("m111", "2 * m350"),
    }
    return [s1, s2, s3, {"halving_near": flag("abs(halving_days_i) <= 30"), "pi_top": flag("round(pi_cycle, 8) > 1"), "opex_near_i": "max(opex_last_friday) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"}]


_CALENDAR = [c for s in market_calendar(DUCK) for c in s if c not in ("ts", "date_n", "dow", "dom", "mon", "y", "m111", "m350")]
QUERIES["market_calendar"], SQL["market_calendar"] = feature_query(market_calendar, bars, DUCK_BARS, _CALENDAR)


def number_days(d: Dialect) -> Stages:
    """Day, week, year and price flags of numbers: named days, prime, power and Fibonacci days, sequences, completion, resonance."""
    s1 = {"ts": d.ts("us"), "n": "CAST(floor(close) AS BIGINT)", "v": "CAST(floor(coalesce(volume, 0)) AS BIGINT)"}
    s2 = {"dom": "day(ts)", "mon": "month(ts)", "y": "year(ts)", "doy_i": "dayofyear(ts)", "week_i": "weekofyear(ts)", "dow": d.weekday("ts"), "t": "CAST(n AS STRING)", "price_root_i": _root("n"), "volume_root_i": _root("v")}
    digits = lambda x, k: " + ".join(f"{d.div(x, str(10**i))} % 10" for i in range(k))
    s3 = {"date_sum": digits("(y * 10000 + mon * 100 + dom)", 8)}
    s4 = {"date_root_i": _root("CAST(date_sum AS INT)")}
    primes = ", ".join(str(p) for p in range(2, 367) if all(p % q for q in range(2, int(p**0.5) + 1)))
    s5 = {
        **{f"day_{k}": flag(f"dom = {k}") for k in (13, 21, 6, 27)}, **{f"doy_{k}": flag(f"doy_i = {k}") for k in (13, 27, 33, 47, 48, 72, 93, 113, 127, 189, 201, 211, 213, 217, 223, 224, 233, 303, 311, 322)},
        "doy_prime": flag(f"doy_i IN ({primes})"), "doy_fibonacci": flag("doy_i IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)"), "doy_power_of_2": flag("doy_i IN (1, 2, 4, 8, 16, 32, 64, 128, 256)"), "doy_div_9": flag("doy_i % 9 = 0"),
        "week_master": flag("week_i IN (11, 22, 33)"), "pct_year_93": flag("abs(doy_i / 365e0 - 0.93) < 0.01"), "sequential_date": flag("dom = mon + 1"), "same_day_month": flag("dom = mon"), "year_root_i": _root("y"), "shemitah": flag("(y - 5) % 7 = 0"), "jubilee": flag("(y - 17) % 50 = 0"),
        **{f"price_contains_{x}": flag(f"t LIKE '%{x}%'") for x in (113, 322, 93, 213, 666, 777, 911, 369, 69, 47)}, "price_master": flag("n % 100 IN (11, 22, 33)"), "round_1000": flag("n >= 1000 AND n % 1000 = 0"),
        "vortex": flag("date_root_i IN (3, 6, 9)"), "pump_date": flag("dom IN (14, 15, 16) OR dom IN (27, 17)"), "combo_i": "dow * 10 + date_root_i", "completion_9": flag("date_root_i = 9"), "mirror_root_i": "CASE WHEN date_root_i = 0 THEN 0 ELSE 10 - date_root_i END",
        "resonance": flag("price_root_i = date_root_i"), "double_resonance": flag("price_root_i = date_root_i AND volume_root_i = date_root_i"),
    }
    return [s1, s2, s3, s4, s5]


_NUMBERS = [c for s in number_days(DUCK) for c in s if c not in ("ts", "n", "v", "dom", "mon", "y", "dow", "t", "date_sum")]
QUERIES["number_days"], SQL["number_days"] = feature_query(number_days, bars, DUCK_BARS, _NUMBERS)


def decays(d: Dialect) -> Stages:
    """Bars since each of twelve events with fast and slow decay, the return since it, and whether the trend agrees."""
    s1 = {
        "ret": f"round({change('close')}, 8)", "v20": rolling("avg", "volume", 20, digits=None), "hi20": rolling("max", "high", 20, skip=1), "lo20": rolling("min", "low", 20, skip=1), "m50": rolling("avg", "close", 50), "ts": d.ts("us"),
        "pos": "row_number() OVER (PARTITION BY series ORDER BY us)", "peak": f"max(close) {over()}",
    }
    s2 = {"day_n": d.day("us"), "dow": d.weekday("ts"), "dom": "day(ts)"}
    s3 = {
        "ev_up2": flag("ret > 0.02"), "ev_down2": flag("ret < -0.02"), "ev_climax": flag("volume > 2 * v20"), "ev_break_up": flag("close > hi20"), "ev_break_down": flag("close < lo20"), "ev_peak": flag("close = peak"),
        "ev_green3": flag(f"ret > 0 AND {lag('ret')} > 0 AND {lag('ret', 2)} > 0"), "ev_red3": flag(f"ret < 0 AND {lag('ret')} < 0 AND {lag('ret', 2)} < 0"), "ev_monday": flag("dow = 0"), "ev_day13": flag("dom = 13"),
        "ev_cross_up": flag(f"close > m50 AND {lag('close')} <= {lag('m50')}"), "ev_cross_down": flag(f"close < m50 AND {lag('close')} >= {lag('m50')}"),
    }
    names = [n.removeprefix("ev_") for n in s3]
    s4 = {f"at_{n}": d.last(f"CASE WHEN ev_{n} = 1 THEN pos END", over()) for n in names} | {f"px_{n}": d.last(f"CASE WHEN ev_{n} = 1 THEN close END", over()) for n in names}
    s5 = {f"since_{n}_i": f"pos - at_{n}" for n in names}
    s6 = {f"fast_{n}": f"exp(-0.1 * since_{n}_i)" for n in names} | {f"slow_{n}": f"exp(-0.05 * since_{n}_i)" for n in names} | {f"return_since_{n}": f"close / nullif(px_{n}, 0) - 1" for n in names}
    s6 |= {f"{n}_x_bull": flag(f"ev_{n} = 1 AND close > m50") for n in names} | {f"{n}_x_bear": flag(f"ev_{n} = 1 AND close < m50") for n in names}
    return [s1, s2, s3, s4, s5, s6]


_DECAYS = [c for s in decays(DUCK) for c in s if c.startswith(("ev_", "since_", "fast_", "slow_", "return_since_")) or c.endswith(("_x_bull", "_x_bear"))]
QUERIES["event_decays"], SQL["event_decays"] = feature_query(decays, bars, DUCK_BARS, _DECAYS)


def uniqueness_weights(d: Dialect) -> str:
    """Class weight (inverse frequency over the least) of the barrier-like label of the next five bars, times 1 / overlap of five."""
    label = "CASE WHEN n5 / close - 1 > 0.02 THEN 2 WHEN n5 / close - 1 < -0.02 THEN 0 ELSE 1 END"
    rows = f"SELECT series, us, {label} AS label FROM (SELECT *, {lead('close', 5)} AS n5 FROM {{bars}}) a WHERE n5 IS NOT NULL"
    counts = f"SELECT label, count(*) AS k FROM ({rows}) b GROUP BY label"
    return f"SELECT r.series, r.us, r.label, {f32(f'(SELECT max(k) * 1e0 FROM ({counts}) e) / c.k / 5e0')} AS weight FROM ({rows}) r JOIN ({counts}) c ON c.label = r.label"


common("class_weights", uniqueness_weights)


# ---------------------------------------------------------------- validation, events, text
def _baselines(d: Dialect) -> str:
    """Accuracy of always long, always short, majority, the previous bar's direction, and of labels shuffled within the series."""
    rows = f"SELECT series, tf, row_number() OVER (PARTITION BY series ORDER BY us) AS pos, count(*) OVER (PARTITION BY series) AS n, CASE WHEN nxt > close THEN 1 ELSE 0 END AS y, CASE WHEN close > prv THEN 1 ELSE 0 END AS p FROM (SELECT *, {lead('close')} AS nxt, {lag('close')} AS prv FROM {{bars}}) a WHERE nxt IS NOT NULL AND prv IS NOT NULL"
    same = lambda a, b: f32(f"avg(CASE WHEN {a} = {b} THEN 1e0 ELSE 0e0 END)")
    return f"""SELECT a.tf, count(*) AS n, {f32('avg(a.y * 1e0)')} AS always_long, {f32('avg(1e0 - a.y)')} AS always_short, greatest({f32('avg(a.y * 1e0)')}, {f32('avg(1e0 - a.y)')}) AS majority, {same('a.p', 'a.y')} AS previous_bar, {same('s.y', 'a.y')} AS shuffled
 FROM ({rows}) a JOIN ({rows}) s ON s.series = a.series AND s.pos = (a.pos * 7919 + 13) % a.n + 1 GROUP BY a.tf"""


common("leakage_baselines", _baselines)
common("token_index", lambda d: f"""SELECT token, count(*) AS hits, count(DISTINCT row_id) AS tweets, min(row_id) AS first_row FROM (SELECT row_id, {"unnest" if d.duck else "explode"}({_words(d, "lower(coalesce(full_text, ''))")}) AS token FROM {{tweets}}) t GROUP BY token""")


def _fallback(d: Dialect) -> str:
    """Sentiment by lexicon with sarcasm, urgency and impact: sarcasm turns the sign, impact counts strong words and marks."""
    low = "lower(coalesce(full_text, ''))"
    any_of = lambda ws: "CASE WHEN " + " OR ".join(f"{low} LIKE '%{w}%'" for w in ws) + " THEN 1 ELSE 0 END"
    return f"""SELECT row_id, CASE WHEN sarcasm = 1 THEN -score ELSE score END + 0e0 AS sentiment, sarcasm, urgent, least(marks + 2 * strong + caps, 10) AS impact FROM
 (SELECT row_id, {any_of(('yeah right', 'sure thing', '/s', 'totally fine', 'what could go wrong'))} AS sarcasm, urgent, marks, caps, {any_of(('record', 'historic', 'massive', 'collapse', 'crash', 'surge'))} AS strong, coalesce((bull - bear) / nullif(CAST(bull + bear AS DOUBLE), 0), 0e0) AS score
 FROM (SELECT row_id, full_text, {', '.join(f'{e} AS {n}' for n, e in _hits(d, 'full_text').items())} FROM {{tweets}}) a) b"""


common("fallback_sentiment", _fallback)


def _event_sky(d: Dialect) -> str:
    """Moon, planetary hour, signs and day pillars at the instant of each tweet, the last one of every four-hour bucket."""
    cols = ("phase_i", "hour_planet_i", "stem_i", "branch_i", "tone_i", "tzolkin_i", "kin_i", "element_i", "double_power", "moon_age")
    body = compile_stages(sky.sky(d), "SELECT collector, row_id, utc_us AS us FROM {tweeted}", ["collector", "row_id", "us"], cols, hold=not d.duck)
    return f"SELECT collector, {d.div('us', '14400000000')} AS bucket, count(*) AS tweets, {', '.join(f'{d.arg_max(c, 'us', 'row_id')} AS {c}' for c in cols)} FROM ({body}) e GROUP BY 1, 2"


common("event_sky", _event_sky)
common("paper_account", lambda d: f"""SELECT series, count(*) AS closed, {f32('sum(pnl)')} AS realised, {f32('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)')} AS won, {f32('sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)')} AS lost, max(us) AS last_exit_us, CAST(max(held) AS BIGINT) AS longest FROM {relational._TRADES(d)} t GROUP BY series""")


def _decimal_root(d: Dialect) -> str:
    """Digital root of the digits of a number's first six decimals and whole part."""
    micro = "CAST(round(abs(funding_rate) * 1e6) AS BIGINT)"
    return f"SELECT row_id, n_micro, {_root('n_micro')} AS root FROM (SELECT row_id, {micro} AS n_micro FROM {{funding_rates}} WHERE funding_rate IS NOT NULL AND NOT isnan(funding_rate)) t"


common("decimal_root", _decimal_root)

#: Named products: (name, binary, continuous, side) of flow columns beyond their outer fifths.
PRODUCTS = tuple((f"px_{b}_{c}_{s}", b, c, s) for b in ("fg_fear", "fg_greed", "funding_high", "funding_neg", "post_liq_flag", "hash_capitulation", "premium_positive") for c in ("funding_z30", "liq_z", "whale_z", "oi_change_5", "premium_z") for s in ("high", "low"))


def named_products(spark, sf_dir):
    """Binary signals times the outer fifths of continuous ones over the whole sample, by a table of names."""
    flows = stored(QUERIES["flow_columns"](spark, sf_dir))
    wide = sorted({c for _, _, c, _ in PRODUCTS})
    pairs = F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in wide))
    cut = {r["f"]: r["q"] for r in quantiles.percentiles(flows.select(F.inline(pairs)), "f", "v", (0.2, 0.8)).collect()}
    over_ = lambda c, s: F.col(c) >= cut[c][1] if s == "high" else F.col(c) <= cut[c][0]
    return flows.select("series", "us", *(F.coalesce((F.col(b) == 1) & over_(c, s), F.lit(False)).cast("int").alias(n) if c in cut else F.lit(0).alias(n) for n, b, c, s in PRODUCTS))


QUERIES["named_products"] = named_products
_CUTS = ", ".join(f"quantile_cont({c}, 0.2) AS {c}_lo, quantile_cont({c}, 0.8) AS {c}_hi" for c in sorted({c for _, _, c, _ in PRODUCTS}))
SQL["named_products"] = f"""WITH f AS MATERIALIZED ({SQL['flow_columns']}), q AS (SELECT {_CUTS} FROM f) SELECT series, us, {', '.join(f"CASE WHEN {b} = 1 AND {c} {'>=' if s == 'high' else '<='} {c}_{'hi' if s == 'high' else 'lo'} THEN 1 ELSE 0 END AS {n}" for n, b, c, s in PRODUCTS)} FROM f, q"""


def common_timeline(spark, sf_dir):
    """One-hour bars of every symbol with the last closed four-hour and daily close of the symbol, as of the hour's open."""
    one = QUERIES["store_fallback"](spark, sf_dir)
    out = one.where("tf = '1h'").select("symbol", "us", "close")
    for tf, width in (("4h", 14_400_000_000), ("1d", 86_400_000_000)):
        side = one.where(f"tf = '{tf}'").select("symbol", (F.col("us") + width).alias("at"), F.col("close").alias(f"close_{tf}"))
        out = align.asof(out, side, ["symbol"], "us", "at", [f"close_{tf}"]).drop("matched_us")
    return out


QUERIES["common_timeline"] = common_timeline
SQL["common_timeline"] = f"""WITH o AS MATERIALIZED ({SQL['store_fallback']}), h4 AS (SELECT symbol, us + 14400000000 AS at, close AS close_4h FROM o WHERE tf = '4h'), d1 AS (SELECT symbol, us + 86400000000 AS at, close AS close_1d FROM o WHERE tf = '1d')
SELECT b.symbol, b.us, b.close, h4.close_4h, d1.close_1d FROM (SELECT * FROM o WHERE tf = '1h') b ASOF LEFT JOIN h4 ON h4.symbol = b.symbol AND b.us >= h4.at ASOF LEFT JOIN d1 ON d1.symbol = b.symbol AND b.us >= d1.at"""
