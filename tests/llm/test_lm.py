"""Language-model scores against plain counting, and the compact sequences under them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import lm
from marquee.llm.elias_fano import EliasFano, Level, pack, unpack
from marquee.llm.queries import QUERIES


def plain_scores(docs, order):
    """A list of (held out, tokens, known, N, base score, score), unquantised, in the order of `docs`."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    texts = [(out, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""]) for out, t in docs]
    c = Counter(w for out, ts in texts if not out for w in ts)
    n, v, after = sum(c.values()), len(c), defaultdict(Counter)
    pads = [[" "] * (order - 1) + ts for _, ts in texts]
    places = [[(tuple(pad[j - k : j]), pad[j]) for k in range(1, order)] for pad in pads for j in range(order - 1, len(pad))]
    outs = [out for out, ts in texts for _ in ts]
    for out, grams in zip(outs, places):
        for h, w in grams if not out else ():
            after[h][w] += 1
    total, place, rows = {h: sum(x.values()) for h, x in after.items()}, iter(places), []
    for out, ts in texts:
        base = score = 0.0
        for w in ts:
            p = (c[w] + 1) / (n + v + 1)
            base += math.log10(p)
            for h, _ in next(place):
                if h in after:
                    p = max(after[h][w] - lm.DISCOUNT, 0) / total[h] + lm.DISCOUNT * len(after[h]) / total[h] * p
            score += math.log10(p)
        rows.append((out, len(ts), sum(c[w] > 0 for w in ts), n, base, score))
    return rows


def is_held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("order, bounds", [(2, {}), (3, {}), (2, {"block": 3000, "per_shard": 2000, "hot": 30}), (4, {"block": 5000, "per_shard": 3000, "hot": 20})])
def test_against_plain_counts(spark, tiny, order, bounds):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    held = F.pmod(lm.crc32_of("doc_id"), F.lit(7)) == 2
    got = {r.doc_id: r[1:] for r in lm.score(docs, held_out=held, order=order, **bounds).collect()}
    rows = docs.collect()
    for r, want in zip(rows, plain_scores([(is_held(r.doc_id), r.text) for r in rows], order)):
        mine = got[r.doc_id]
        assert mine[:4] == want[:4] and math.isclose(mine[4], want[4], rel_tol=1e-12)
        assert abs(mine[5] - want[5]) <= lm.STEP / 2 * want[1]  # each fraction is off by half a step at most


def test_query(spark, tiny):
    got = QUERIES["op13_lm_score"](spark, tiny).toPandas()
    out = got[got.held_out]
    assert len(got) == 200 and set(out.doc_id) == {i for i in got.doc_id if is_held(i)}
    assert out.score.sum() > out.base_score.sum() + 0.2 * out.n_tokens.sum()  # words in context are told better


def test_shards_and_hot_contexts_change_nothing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    one, many = (sorted(lm.score(docs, order=3, **b).collect()) for b in ({}, {"block": 2000, "per_shard": 1500, "hot": 10}))
    assert all(a[:5] == b[:5] and math.isclose(a.score, b.score, rel_tol=1e-9) for a, b in zip(one, many))


def test_probabilities_sum_to_one(spark):
    """Over all known tokens and one unknown, after any context, within what 8 bits lose."""
    texts = ["a b c a b", "a c", "b b b", "c a b"]
    asked = [f"{h} {w}" for h in ("a", "b", "c", "never") for w in ("a", "b", "c", "other")] + ["a", "b", "c", "never"]
    docs = spark.createDataFrame([(i, t, i >= len(texts)) for i, t in enumerate(texts + asked)], "doc_id long, text string, out boolean")
    got = {r.text: r.score for r in lm.score(docs, held_out=F.col("out")).join(docs.where("out"), "doc_id").collect()}
    # a text "h w" ends in an end; what ends a text after w follows from the texts "h" and "h w" with one word
    end = {}
    for w in ("a", "b", "c", "never"):
        start = plain_scores([(False, t) for t in texts] + [(True, w)], 2)[-1]
        end[w] = start[5]
    for h in ("a", "b", "c"):
        shares = plain_scores([(False, t) for t in texts] + [(True, f"{h} {w}") for w in ("a", "b", "c", "other")], 2)[-4:]
        for w, s in zip(("a", "b", "c", "other"), shares):
            assert abs(got[f"{h} {w}"] - s[5]) <= 3 * lm.STEP / 2
    c = Counter(w for t in texts for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    after = Counter(b for t in texts for a, b in zip(t.split(), [*t.split()[1:], ""]) if a == "b")
    p = lambda w: max(after[w] - 0.75, 0) / sum(after.values()) + 0.75 * len(after) / sum(after.values()) * (c[w] + 1) / (n + v + 1)
    assert math.isclose(sum(map(p, [*c, "unknown"])), 1.0)


def test_edges(spark):
    odd = [
        (1, "A b  C\x0b\td"), (1, "A b  C\x0b\td"), (2, None), (3, ""), (4, " \n "), (None, "a B"), (None, None),
        (5, "ÄÖ äö a b"), (6, "word " * 30_000), (7, "x" * 100_000), (8, "c d a b"), (16, "a b"),
    ]
    clash = {c: F.lit("z") for c in ("id", "ids", "block", "held", "n", "tokens", "words", "level", "score", "held_out")}
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns(clash)
    held = F.pmod(lm.crc32_of("doc_id"), F.lit(7)) == 2
    got = lm.score(docs, held_out=held, block=1000, per_shard=500, hot=5).collect()
    want = plain_scores([(i is not None and is_held(i), t) for i, t in odd], 2)
    assert sorted((str(r.doc_id), *r[1:5], round(r.base_score, 6)) for r in got) == sorted(
        (str(i), *w[:4], round(w[4], 6)) for (i, _), w in zip(odd, want)
    )
    assert lm.score(docs.where("doc_id = 77")).collect() == []
    none = lm.score(docs, held_out=F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("n, most", [(0, 9), (1, 1), (1, 2**64 - 1), (5, 6), (900, 1000), (1000, 5000), (30_000, 2**64 - 1), (30_000, 2**33)])
def test_elias_fano(n, most):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
    asked = np.r_[values, rng.integers(0, most, 500, dtype=np.uint64, endpoint=True)]
    sequence = EliasFano.of(values)
    assert (sequence.get(np.arange(len(values))) == values).all()
    place = np.searchsorted(values, asked)
    hit = np.isin(asked, values)
    assert (sequence.find(asked) == np.where(hit, place, -1)).all()
    if len(values):
        assert (sequence.successor(asked) == place).all()
        start = rng.integers(0, len(values), len(asked))
        end = np.minimum(start + 5, len(values))
        assert (sequence.successor(asked, start, end) == np.clip(place, start, end)).all()
    pointers = np.sort(rng.integers(0, 50, n)).astype(np.uint64)
    assert (EliasFano.of(pointers).get(np.arange(n)) == pointers).all()


@pytest.mark.parametrize("bits", [0, 1, 7, 31, 33, 63])
def test_packed_numbers(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    assert (unpack(pack(values, bits), bits, np.arange(1000)) == values).all()


def test_level_in_a_mapped_file(tmp_path):
    contexts, starts = np.array([3, 9, 2**63], np.uint64), np.array([0, 2, 3])
    successors = np.array([5, 7, 5, 0, 2**32 - 1], np.uint32)
    built = Level.build(contexts, starts, successors, np.arange(1, 6, dtype=np.uint8), np.array([11, 12, 13], np.uint8))
    (tmp_path / "level").write_bytes(built)
    for buffer in (built, np.memmap(tmp_path / "level", np.uint8, "r")):
        weights, codes = Level(buffer).find(np.array([3, 4, 9, 2**63], np.uint64), np.array([3, 1, 2, 2]), np.array([5, 6, 7, 5, 5, 7, 0, 2**32 - 1], np.uint32))
        assert weights.tolist() == [11, 0, 12, 13] and codes.tolist() == [1, 0, 2, 0, 3, 0, 4, 5]
