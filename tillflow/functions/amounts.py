"""Money as whole cents, so that sums and shares are exact on every executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_cents(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` in whole cents.

    Integer columns already hold cents; decimals are scaled exactly; binary
    floating point is rounded to the nearest cent.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    if isinstance(kind, T.DecimalType):
        return F.round(F.col(name) * 100, 0).cast("bigint")
    return F.round(F.col(name) * 100).cast("bigint")


def from_cents(cents: Column, like: T.DataType) -> Column:
    """Cents back in the unit of a column of type ``like``."""
    if isinstance(like, T.IntegralType):
        return cents
    if isinstance(like, T.DecimalType):
        # Dividing by 100 with enough digits is exact for whole cents.
        return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(16,2)")
    return cents / F.lit(100.0)


def share_cents(line: str, final: str, original: str) -> Column:
    """``line * final / original`` of three columns in cents, halves toward plus infinity.

    Null where the original total is not positive: there is nothing to be
    proportional to.
    """
    # 64-bit arithmetic while 2 * line * final + original cannot overflow,
    # 38-digit decimals beyond.
    fast = _floor_div(f"2 * {line} * {final} + {original}", f"(2 * {original})")
    l, f, o = (f"CAST({c} AS DECIMAL(18,0))" for c in (line, final, original))
    exact = _floor_div(f"{l} * {f} * 2 + {o}", f"({o} * 2)")
    return F.expr(f"""
        CASE WHEN {original} > 0 THEN
          CASE WHEN abs({line}) < {1 << 31} AND abs({final}) < {1 << 30} AND {original} < {1 << 61}
               THEN {fast} ELSE {exact} END
        END""")


def _floor_div(n: str, d: str) -> str:
    # ``div`` drops the fraction toward zero; step down once for negative results.
    return f"(({n}) DIV {d} - CASE WHEN ({n}) % {d} < 0 THEN 1 ELSE 0 END)"
