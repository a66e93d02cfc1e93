"""Every named query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from marquee.plans.all import ORACLES, PLANS
from marquee.plans.catalog import catalog_oracle, catalog_rows
from marquee.session import tune
from marquee.sources.testdata import Views
from tools.check_oracle import compare, duck

QUERIES = {name: lambda spark, folder, fn=fn: fn(Views(tune(spark), folder)) for name, fn in PLANS.items()}


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tiny, name):
    verdict = compare(spark, con, tiny, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_catalog_in_parts(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables have no movie of several comments
    query = lambda spark, folder: catalog_rows(Views(tune(spark), folder), 2)
    assert query(spark, folder).filter("part > 0").count() > 0
    verdict = compare(spark, duck(folder), folder, "movie_catalog", query, catalog_oracle(2))
    assert verdict.startswith("ok"), verdict


def test_expiry_leaves_young_bookings(spark, tiny):
    v = Views(tune(spark), tiny)
    assert 0 < PLANS["expire_pending"](v).count() < v.bookings.filter("status = 'PENDING'").count()
