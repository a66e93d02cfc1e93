"""The last two stages of the corpus pipeline against a plain mixture and the laws of its shards."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_copies(docs):
    """doc_id -> how often the mixture takes it, in whole documents."""
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    total = defaultdict(int)
    for r in docs:
        total[r.source] += sizes[r.doc_id]
    sources = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, room = {}, set(sources), Fraction(sum(total.values()))
    while True:
        shares = sum(weight[s] for s in free)
        over = {s for s in free if room * weight[s] / shares > 3 * total[s]}
        if not over:
            target |= {s: room * weight[s] / shares for s in free}
            break
        target |= {s: Fraction(3 * total[s]) for s in over}
        room -= sum(target[s] for s in over)
        free -= over
    copies = {}
    for s in sources:
        rows = [r for r in docs if r.source == s]
        rows.sort(key=lambda r: hashlib.md5(f"mix/{r.doc_id}".encode()).hexdigest())
        words, start = int(target[s]), 0
        for r in rows:
            n = sizes[r.doc_id]
            left = max(0, min(start + n, words % total[s]) - start) if total[s] else 0
            taken = n * (words // total[s]) + left if total[s] else 0
            copies[r.doc_id], start = 1 if not n else -(-taken // n), start + n
    return {d: n for d, n in copies.items() if n}


def test_mixture_and_shards(spark, tiny):
    kept = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = spark.createDataFrame(stage(spark, kept, tiny).collect(), kept.schema)
    rows = kept.collect()
    texts = {r.doc_id: r.text for r in rows}
    assert len(texts) == len(rows)
    mixed = corpus_pipeline.mix_sources(spark, kept, tiny)
    assert mixed.columns == kept.columns
    want = plain_copies(rows)
    assert Counter(r.doc_id for r in mixed.collect()) == want and 1 < max(want.values()) <= 3
    final = corpus_pipeline.run(spark, tiny).collect()
    assert Counter(r.doc_id for r in final) == want
    shard_of, loads, slots = {}, Counter(), defaultdict(list)
    for r in final:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        assert shard_of.setdefault(data, r.shard) == r.shard  # equal texts together
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # longest first onto the least loaded: no shard is more than its last group above another
    groups = Counter()
    for r in final:
        groups[texts[r.doc_id]] += r.size
    assert max(loads.values()) - min(loads[k] for k in range(16)) <= max(groups.values())
