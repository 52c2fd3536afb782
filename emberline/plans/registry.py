"""The registered queries, their DuckDB SQL, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.functions import geo
from emberline.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_E1, _E2, _QP, _R2 = geo.E1, geo.E2, geo.Q_POLE, geo.AUTHALIC_R2


def sin_authalic_sql(lat: str) -> str:
    """SQL for the sine of the authalic latitude."""
    s = f"sin(radians({lat}))"
    return f"((1-{_E2!r})*({s}/(1-{_E2!r}*{s}*{s}) - ln((1-{_E1!r}*{s})/(1+{_E1!r}*{s}))/(2*{_E1!r}))/{_QP!r})"


def box_area_sql(minx: str, miny: str, maxx: str, maxy: str) -> str:
    return f"({_R2!r}*radians(({maxx})-({minx}))*({sin_authalic_sql(maxy)}-{sin_authalic_sql(miny)}))"


def query(sql: str | None = None, ctes: bool = True, recursive: bool = False):
    """Register a query under its function's name, and its SQL with the input CTEs before it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{X.CTES}" + ("," if sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")) if ctes else sql
        return f

    return add


