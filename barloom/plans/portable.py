"""One declarative definition, two dialects: stages of named SQL expressions over an ordered series.

A feature group is a list of stages; each stage maps column names to expressions over the columns before it. Spark runs
the group as one query (all windows share one partitioning and order, hence one exchange and sort); the same stages in
DuckDB's dialect are the oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stages = list[dict[str, str]]


class Dialect:
    """What differs between the engines; everything else in the stages is common SQL."""

    def __init__(self, duck: bool):
        self.duck = duck

    def quantile(self, x: str, q: float, over: str) -> str:
        return f"quantile_cont({x}, {q}) {over}" if self.duck else f"percentile({x}, {q}) {over}"

    def last(self, x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) {over}" if self.duck else f"last_value({x}) IGNORE NULLS {over}"

    def arg_max(self, x: str, *keys: str) -> str:
        """The present value of x with the greatest keys."""
        if self.duck:
            return f"arg_max({x}, ({', '.join(keys)},)) FILTER (WHERE {x} IS NOT NULL)" if len(keys) > 1 else f"arg_max({x}, {keys[0]}) FILTER (WHERE {x} IS NOT NULL)"
        return f"max_by({x}, struct({', '.join(keys)})) FILTER (WHERE {x} IS NOT NULL)"

    def clean(self, x: str) -> str:
        """x with NaN as NULL; Spark's scans do that already."""
        return f"CASE WHEN NOT isnan({x}) THEN {x} END" if self.duck else x

    def corr(self, a: str, b: str, n: int, least: int) -> str:
        """Correlation of the pairs with both present over n rows."""
        x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        k, s = f"count({x}) {over(n)}", lambda e: f"sum({e}) {over(n)}"
        spread = lambda e: f"(({k}) * {s(f'({e}) * ({e})')} - {s(e)} * {s(e)})"
        top = f"(({k}) * {s(f'{a} * {b}')} - {s(x)} * {s(y)})"
        # a constant side has no correlation
        return f"CASE WHEN {k} >= {least} AND {spread(x)} > 1e-12 AND {spread(y)} > 1e-12 THEN round({top} / sqrt({spread(x)} * {spread(y)}), 5) + 0e0 END"

    def ts(self, us: str) -> str:
        return f"make_timestamp({us})" if self.duck else f"timestamp_micros({us})"

    def weekday(self, ts: str) -> str:
        """Monday is 0."""
        return f"(isodow({ts}) - 1)" if self.duck else f"weekday({ts})"

    def day(self, us: str) -> str:
        return f"({us} // 86400000000)" if self.duck else f"({us} div 86400000000)"

    def div(self, a: str, b: str) -> str:
        return f"({a}) // ({b})" if self.duck else f"({a}) div ({b})"

    def collect(self, x: str, over: str) -> str:
        return f"list({x}) {over}" if self.duck else f"collect_list({x}) {over}"

    def map(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})" if self.duck else f"transform({a}, {v} -> {body})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})" if self.duck else f"filter({a}, {v} -> {body})"

    def size(self, a: str) -> str:
        return f"len({a})" if self.duck else f"size({a})"

    def at(self, a: str, i: str) -> str:
        """One-based; NULL outside."""
        return f"list_extract({a}, {i})" if self.duck else f"try_element_at({a}, {i})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})" if self.duck else f"sort_array({a})"

    def total(self, a: str) -> str:
        return f"list_sum({a})" if self.duck else f"aggregate({a}, CAST(0 AS DOUBLE), (s, v) -> s + v)"


SPARK, DUCK = Dialect(False), Dialect(True)

PART, ORDER = "series", "us"


def over(n: int | None = None, skip: int = 0, ahead: int | None = None) -> str:
    """The last n rows (all earlier rows if None), ending `skip` rows before this one; or the next `ahead` rows."""
    if ahead is not None:
        frame = f"ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING"
    else:
        start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + skip} PRECEDING"
        frame = f"ROWS BETWEEN {start} AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'}"
    return f"OVER (PARTITION BY {PART} ORDER BY {ORDER} {frame})"


def whole() -> str:
    return f"OVER (PARTITION BY {PART})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {PART} ORDER BY {ORDER})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY {PART} ORDER BY {ORDER})"


def rolling(fn: str, x: str, n: int, least: int | None = None, skip: int = 0, digits: int | None = 10) -> str:
    """fn(x) over n rows, NULL under `least` (n) present values; prices are rounded so that engines agree on comparisons."""
    value = f"{fn}({x}) {over(n, skip)}"
    return f"CASE WHEN count({x}) {over(n, skip)} >= {n if least is None else least} THEN {value if digits is None else f'round({value}, {digits})'} END"


def flag(cond: str) -> str:
    """0/1; an unknown comparison is 0."""
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def change(x: str, k: int = 1) -> str:
    return f"({x} - {lag(x, k)}) / nullif({lag(x, k)}, 0)"


def compile_stages(stages: Stages, source: str, keep: Sequence[str], show: Sequence[str], hold: bool = False) -> str:
    """Nested selects; fractional `show` columns are given to single precision, where both engines agree."""
    sql = source
    for stage in stages:
        if hold and not any(" OVER " in f" {e} " for e in stage.values()):
            # plain expressions behind a one-row generator, so that later stages do not write them out again
            fields = ", ".join(f"'{c}', {e}" for c, e in stage.items())
            sql = f"SELECT * FROM ({sql}) t LATERAL VIEW inline(array(named_struct({fields}))) h"
        else:
            sql = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM ({sql}) t"
    out = ", ".join([*keep, *(f"CAST({c} AS BIGINT) AS {c}" if c.endswith("_i") else c if c.endswith("_t") or _is_flag(stages, c) else f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in show)])
    return f"SELECT {out} FROM ({sql}) t"


def _is_flag(stages: Stages, col: str) -> bool:
    expr = next((s[col] for s in stages if col in s), "")
    return expr.startswith("CASE WHEN") and expr.endswith(" THEN 1 ELSE 0 END") and expr.count(" THEN ") == 1


def feature_query(
    build: Callable[[Dialect], Stages],
    source: Callable[[SparkSession, str], DataFrame],
    duck_source: str,
    show: Sequence[str],
    keep: Sequence[str] = ("series", "us"),
) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(Spark query, DuckDB text) of a feature group over a series source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(compile_stages(build(SPARK), "SELECT * FROM {src}", keep, show, hold=True), src=source(spark, sf_dir))

    head, _, body = duck_source.partition("--body--")
    return run, f"{head} {compile_stages(build(DUCK), body, keep, show)}"
