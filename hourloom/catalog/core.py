"""Registration of queries next to the SQL they must agree with.

Each entry has an output spec, ``name[:type]`` per column, that shapes both
sides alike: ``s`` text or boolean as is, ``i`` 64-bit integer, ``f`` double
rounded to six places, ``t`` timestamp as text, ``d`` date as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Decimal ties are nudged the same way on both sides before rounding.
NUDGE = 1e-9


def rounded(x: Column) -> Column:
    """``round(x, 6)`` of a double, through decimals only where arithmetic could err.

    Below 1e12 the scaled value is off by less than 1e-3 (its rounding and that of the shortest
    decimal of ``x``), so away from ties its nearest integer is the same, and the quotient of two
    exact doubles is the double of that decimal. Ties, large and special values take ``round``.
    """
    scaled = x * F.lit(1e6)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499)
    # Adding zero turns -0.0 into 0.0, as decimals do.
    return F.when(plain, whole / F.lit(1e6) + F.lit(0.0)).otherwise(F.round(x, 6))


_SPARK = {
    "s": lambda c: F.col(c),
    "i": lambda c: F.col(c).cast("bigint"),
    "f": lambda c: rounded(F.col(c).cast("double") + NUDGE),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
}
_DUCK = {
    "s": lambda c: c,
    "i": lambda c: f"CAST({c} AS BIGINT)",
    "f": lambda c: f"round(CAST({c} AS DOUBLE) + 1e-9, 6)",
    "t": lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')",
    "d": lambda c: f"strftime({c}, '%Y-%m-%d')",
}

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(needs, body: str) -> str:
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            deps, sql = CTES[name]
            for d in deps:
                add(d)
            done[name] = sql

    for n in needs:
        add(n)
    parts = [f"{k} AS ({v.strip()})" for k, v in done.items()] + [f"q AS ({body.strip()})"]
    return "WITH " + ",\n".join(parts)


def _spec(spec: str) -> list[tuple[str, str]]:
    return [(c.split(":")[0], c.split(":")[1] if ":" in c else "s") for c in spec.split()]


def query(name: str, spec: str, sql: str | None = None, needs: str = ""):
    """Register a function ``(spark, sf_dir) -> DataFrame`` and its SQL twin."""
    columns = _spec(spec)
    if sql is not None:
        picked = ", ".join(f"{_DUCK[t](c)} AS {c}" for c, t in columns)
        ORACLES[name] = with_ctes(needs.split(), sql) + f"\nSELECT {picked} FROM q"

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir).select(*[_SPARK[t](c).alias(c) for c, t in columns])

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return register
