"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest

from marquee.llm.queries import ORACLES, QUERIES
from tools.check_oracle import compare, duck

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text: str) -> list[str]:
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and not luhn,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, tiny, name):
    verdict = compare(spark, duck(tiny), tiny, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_personal_data(spark, tiny, docs):
    for r in QUERIES["op1_pii"](spark, tiny).collect():
        base = plain_spans(docs.text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        assert r.n_email == sum(s.startswith("email") for s in base)


def test_language(spark, tiny, docs):
    got = QUERIES["op6_language"](spark, tiny).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs.lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_shards(spark, tiny, docs):
    got = QUERIES["op7_shard"](spark, tiny).collect()
    sizes, slots, shards = defaultdict(int), defaultdict(list), {}
    groups = defaultdict(int)
    for r in got:
        text = docs.text[r.doc_id].encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes"
        assert shards.setdefault(text, r.shard) == r.shard
        sizes[r.shard] += r["size"]
        groups[text] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    heap = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert max(sizes.values()) <= 1.02 * max(heap)


def test_secrets(spark, tiny, docs):
    got = QUERIES["op9_secrets"](spark, tiny).collect()
    found = {(r.doc_id, r.finding) for r in got}
    want = {(d, x) for d, t in docs.text.items() for w in t.split() for x in re.findall("[A-Za-z0-9+/_-]{16,}", w)}
    assert found == want
    secret = {(r.doc_id, r.finding) for r in got if r.is_secret}
    planted = {(d, m[1]) for d, t in docs.text.items() for m in re.finditer(r'(?:token = "|password=)([0-9a-f]{16,})', t)}
    assert planted <= secret


def test_pipeline(spark, tiny, docs):
    import corpus_pipeline

    rows = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, tiny)
        assert after.columns == rows.columns
        if name == "near duplicates":
            classes = {r.doc_id: r.component_id for r in QUERIES["op10_jaccard_join"](spark, tiny).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, c in classes.items() if d == c)
        kept = spark.createDataFrame(after.collect(), rows.schema)
    leaked = {r.doc_id for r in QUERIES["op4_decontaminate"](spark, tiny).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, c in classes.items() if d == c} - leaked
    final = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in kept.collect()}
    assert max(map([r.doc_id for r in final].count, {r.doc_id for r in final})) <= 3
