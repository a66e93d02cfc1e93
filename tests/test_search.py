"""The title index against a scan, page starts against offsets, and what their plans read."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.operators import catalog as C
from marquee.operators import search as X
from marquee.session import materialize


@pytest.fixture(scope="module")
def titles(spark):
    rng = random.Random(4)
    words = ["Đêm", "đỏ", "The", "the", "Ánh", "sáng", "RED", "red", "ΟΔΟΣ", "a%b", "x_y", "aaa", "aaaa", "Straße", "İstanbul", "", "re"]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(400)] + [(400, None), (401, ""), (402, "b" * 3_000)]
    return spark.createDataFrame(made, "movie_id long, title string")


@pytest.fixture(scope="module")
def index(titles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("titles"))
    X.build_index(titles, "movie_id", "title", path)
    return path


KEYWORDS = ["dem", "ĐÊM", "red", "RED", "the a", "aaa", "aaaa", "aaaaa", "%", "a%b", "x_y", "ssen", "ße", "οδος", "ΟΔΟΣ", "stan", "re", "r", "zzz", "red zzz", " ", "İst", "b" * 50, "", "ΣΟ", "Σ", "ΟΣ"]


def ids(df):
    return sorted(r.movie_id for r in df.collect())


@pytest.mark.parametrize("keyword", KEYWORDS)
def test_search_equals_the_scan(titles, index, keyword):
    assert ids(X.search(titles, "movie_id", "title", index, keyword)) == ids(C.folded_search(titles, keyword))
    assert ids(X.search(titles, "movie_id", "title", index, keyword, "case")) == ids(C.title_search(titles, keyword))
    assert ids(X.search(titles, "movie_id", "title", index, keyword, "as_is")) == ids(C.contains_filter(titles, "title", keyword))


def test_all_keywords_at_once(spark, titles, index):
    asked = spark.createDataFrame([(k,) for k in [*KEYWORDS, "red", None]], "keyword string")
    scans = {"folded": C.folded_search, "case": C.title_search, "as_is": lambda df, k: C.contains_filter(df, "title", k)}
    for mode, scan in scans.items():
        got = sorted((r.keyword, r.movie_id) for r in X.search_all(titles, "movie_id", "title", index, asked, mode).collect())
        assert got == sorted((k, i) for k in KEYWORDS for i in ids(scan(titles, k)))


def test_of_all_tables_only_counted_short_keywords_are_broadcast(spark, titles, index):
    asked = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    plan = X.search_all(titles, "movie_id", "title", index, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1
    sent = plan[plan.index("BroadcastExchange") :]
    assert "keywords-" in sent[: sent.index("FileScan") + 800] and "Generate" not in sent[: sent.index("FileScan")]


def test_only_lists_of_the_keyword_are_read(titles, index):
    plan = X.search(titles, "movie_id", "title", index, "sang do")._jdf.queryExecution().executedPlan().toString()
    scan = re.search(r"FileScan parquet \[piece.*", plan)[0]
    assert re.search(r"PartitionFilters: \[shard#\d+ IN \(", scan) and "In(piece, [" in scan


@pytest.mark.parametrize("size, rows", [(7, 100), (50, 1), (10, 100), (3, 0)])
def test_pages_equal_offsets(spark, size, rows):
    df = spark.range(rows).select((F.col("id") * 37 % 1009).alias("movie_id"), F.col("id").cast("string").alias("title")).repartition(4)
    starts = materialize(X.page_starts(df, "movie_id", size))
    pages = (rows + size - 1) // size
    assert sorted((r.page, r.n) for r in starts.collect()) == [(p, min(size, rows - p * size)) for p in range(pages)]
    for number in range(pages + 1):
        want = [r.movie_id for r in df.orderBy("movie_id").offset(number * size).limit(size).collect()]
        assert [r.movie_id for r in X.page_at(df, "movie_id", starts, number).collect()] == want


def test_a_deep_page_passes_over_nothing(spark, tmp_path):
    path = str(tmp_path / "movies")
    spark.range(60_000).select(F.col("id").alias("movie_id"), F.lit("t").alias("title")).write.parquet(path)
    df = spark.read.parquet(path)
    starts = materialize(X.page_starts(df, "movie_id", 50))
    page = X.page_at(df, "movie_id", starts, 1000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan
    assert "GreaterThanOrEqual(movie_id,50000)" in plan and "LessThan(movie_id,50050)" in plan
    assert [r.movie_id for r in page.collect()] == list(range(50_000, 50_050))
