"""Registered queries and the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame query, with its reference SQL if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def plan(name: str, oracle: str | None = None):
    """Like `query`, for functions of the `Tables` of one query."""
    from hazeline.plans.tables import Tables

    def add(fn):
        query(name, oracle)(lambda spark, sf_dir: fn(Tables(spark, sf_dir)))
        return fn

    return add
