"""Named queries: a function of the views, and the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marquee.sources.testdata import Views

PLANS: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        assert name not in PLANS, name
        PLANS[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
