"""Staged columns: expressions computed once per row, whatever reads them later.

Spark merges neighbouring projections and moves filters below them by copying
the expressions they use.  For an expression that is read inside a lambda (once
per line of a document) such a copy would redo the whole document per line.  A
one-row generator is a natural border: what it produces is not copied, while
filters on the columns passing through still reach the scan.
"""

from __future__ import annotations

from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# expressions of a plan live as long as the plan; those of no plan are a few per application
_built: WeakKeyDictionary = WeakKeyDictionary()
_planless: dict = {}


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns added that later steps read but never recompute."""
    values = [c.alias(n) for n, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*values))))


def per_plan(build):
    """Build an expression once per application and plan; it only names columns."""

    @wraps(build)
    def once(*args):
        app = SparkSession.active().sparkContext.applicationId
        key = (app, build.__module__, build.__qualname__, args[1:])
        held = _built.setdefault(args[0], {}) if args else _planless
        if key not in held:
            held[key] = build(*args)
        return held[key]

    return once
