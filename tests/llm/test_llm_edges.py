"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import decontaminate, exact_dedup, jaccard, language, line_dedup, mixing, pii, secrets, shards, warc
from marquee.llm.components import components

SENTENCE = "The quick brown fox jumps over the lazy dog and then runs far away into the deep dark wood"
ODD = [
    (1, SENTENCE, "en", "a"),
    (2, SENTENCE.upper(), "en", "a"),
    (3, SENTENCE + " again", None, None),
    (3, SENTENCE + " again", None, None),
    (4, None, "en", None),
    (5, "", None, "b"),
    (6, " \t\n\x0b ", "de", "b"),
    (None, "one two three", None, "c"),
    (None, None, None, "c"),
    (7, "mail x.y@example.com or 10.0.0.1\n\nline\nline\n" + "wort " * 20_000, "de", "b"),
    (8, "x" * 50_000, "de", "a"),
    (9, "12345 678", None, "a"),
    (10, "über ÄÖÜ straße", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    clash = ["digest", "id", "n", "h", "t", "sid", "size", "shard", "n_lines", "words", "label", "score", "root", "key"]
    return rows.withColumns({c: F.lit(c) for c in clash})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark):
    rows = [(0, SENTENCE), (1, None), (2, ""), (3, "one two three"), (4, "never seen before words here at all"), (4, "Ä")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_exact_dedup(odd):
    got = exact_dedup.mark_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].keep_id, by[1].group_size, by[1].kept, by[2].kept) == (2, 2, False, True)
    assert by[3].group_size == 2 and by[3].kept and by[5].keep_id == by[4].keep_id == 5 and by[5].group_size == 3
    assert by[5].text_sha256 == hashlib.sha256(b"").hexdigest()
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted("2 3 5 6 None 7 8 9 10".split())


def test_exact_dedup_frequent_and_rare(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.mark_duplicates(rows, support=0.1)
    assert got.where("kept").count() == 1 + rows.where("text <> 'Same'").count()
    assert got.where("group_size = 667 and keep_id = 1998").count() == 667


def test_line_dedup(spark, odd):
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(odd, min_docs=2).where("doc_id is not null").collect()}
    assert got[4].text == got[5].text == "" and got[4].n_lines == 1 and got[4].n_dropped == 0
    assert got[1].text == got[2].text == "" and got[1].n_dropped == 1
    assert got[7].n_lines == 5 and got[7].n_dropped == 0 and got[6].text == " \t\n\x0b "
    lines = spark.createDataFrame([(i, f"own {i}\n  Shared \nend{i}") for i in range(12)], "doc_id long, text string")
    assert {r.text for r in line_dedup.drop_repeated_lines(lines).collect()} == {f"own {i}\nend{i}" for i in range(12)}


def test_mixing(spark, odd):
    schedule, taken = mixing.mix(odd, slots=1 << 10)
    rows = taken.collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r["size"] for r in rows)
    for target, words in {(r.target, sum(x.taken for x in rows if x.target == r.target)) for r in rows}:
        assert abs(target - words) <= 1
    assert schedule.agg(F.sum("n_words")).first()[0] == sum(r.taken for r in rows)
    assert mixing.targets([10, 0, 1000], (1, 1, 1)) == [(30.0, 30), (0.0, 0), (980.0, 980)]
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_shards(odd):
    rows = shards.assign_shards(odd, shards=3).collect()
    assert len(rows) == len(ODD)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r["size"] == 1}) == 1  # null and empty are the same text
    assert shards.least_loaded([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == {1: (0, 0), 2: (1, 0), 3: (1, 4), 4: (0, 5)}


def test_jaccard(spark, odd):
    got = jaccard.join_classes(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert all(by[i].component_id == i for i in (4, 5, 6, 7, 8, 9, 10)) and by[4].n_shingles == 0 and by[8].n_shingles == 1
    left = jaccard.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted("1 4 5 6 None None 7 8 9 10".split())


def test_jaccard_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):  # near copies of one text, each with edits of its own
        copy = list(words)
        for j in range(i % 4):
            copy[(7 * i + 13 * j) % 60] = f"x{i}{j}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{i}{k}" for k in range(30)) + " " + " ".join(words[:20]) for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in jaccard.join_classes(rows).collect()} == dict(enumerate(root))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i != 20] + [(50, 51), (51, 50), (60, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)} | {50: 50, 51: 50}


def test_decontaminate(spark, odd):
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_items(odd, items(spark)).collect()}
    assert found == {(1, 0), (2, 0), (3, 0), (None, 3)}
    left = decontaminate.drop_contaminated(odd, items(spark))
    assert left.columns == odd.columns and left.count() == len(ODD) - 5


def test_language(odd):
    got = language.identify(odd).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 9)} == {"und"}
    left = language.keep_identified(odd)
    assert left.columns == odd.columns and left.count() == len(ODD) - 5


def test_language_long_rows_and_many_languages(spark):
    learnt = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    names = [f"l{k:03}" for k in range(230)]
    word = lambda k: "".join(chr(0x4E00 + 3 * k + j) for j in range(3))
    rows = [(learnt[k], word(k) * 4, name) for k, name in enumerate(names)]
    rows += [(learnt[300 + i], "12 34 " * 20 + "alpha beta " * 40, "long") for i in range(3)] + [(learnt[400], "0 1", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang: r.lang_pred for r in language.identify(docs, letters=60, carry="lang").collect()}
    assert got == {**{n: n for n in names}, "long": "long", "none": "und"}


def test_language_first_row_is_read(spark):
    learnt = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, "x" * 500 + str(i), f"l{i % 300}") for i in learnt], "doc_id long, text string, lang string")
    assert len(language.training_rows(docs, "doc_id", "text", "lang", F.lit(True), 500)) == 300


def test_automaton():
    a = language.SuffixAutomaton("banana")
    assert [a.phrases(w) for w in ("anan", "nab", "", "xx", "bananab")] == [1, 2, 0, 2, 2]


def test_personal_data(odd):
    got = {r.doc_id: r for r in pii.find_personal_data(odd).where("doc_id is not null").collect()}
    assert (got[7].n_email, got[7].n_ip) == (1, 1) and got[7].spans.startswith("email:5:20,ip:24:32")
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.base_spans("a@b.c@d.e 1.2.3.256, 4111 1111 1111 1111, +1 (663) 555-6869") == [(0, 0, 5), (2, 21, 40), (3, 42, 59)]


def test_personal_data_learns_from_rare_rows(spark):
    texts = [(i, f"call me at +1 (663) 555-68{i % 90 + 10} soon" if i % 50 == 0 else "nothing to see") for i in range(1_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert pii.labelled_table(rows, "doc_id", "text", rows=50).count() == 20
    some = pii.labelled_table(rows, "doc_id", "text", rows=10).count()
    assert 1 <= some < 20


def test_personal_data_long_zeros():
    zeros = "0" * 5_000
    assert pii.base_spans(f"{zeros}.{zeros}.0.{zeros}1") == [(1, 0, 15_005)]
    assert pii.base_spans(f"1.2.3.{zeros}256") == []


def test_secrets(spark, odd):
    rows = odd.select("doc_id", "text", "source").unionByName(
        spark.createDataFrame([(20, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" x', None)], "doc_id long, text string, source string")
    )
    got = {(r.doc_id, r.is_secret) for r in secrets.scan(rows).collect()}
    assert got == {(8, False), (20, True)}


def test_secrets_short_and_mixed(spark):
    values = ["hunter2Secret", "Ab3dE6gH9jK2", "P@ssw0rd!2024xyz", "k9.8Qz!7rT#5w", "s3cr#t", "aZ9/b+c=d$e~f%10^", "zß9-Ünï!code"]
    forms = [
        "password={}", "pwd=  {}", "secret: {}", "the api_key = {} there", 'DB_TOKEN="{}"', "auth-key : '{}',", '{{"a":1,"password":"{}","b":2}}',
        "private_key => {}", "call(passwd='{}')", "http://h/?user=a&token={}&page=2", "see `credential={}`, then", "Password:\n{}\nnext",
    ]
    made = [(f, v) for f in forms for v in values]
    secret = [(i, f.format(v), "src") for i, (f, v) in enumerate(made)]
    prose = [(1000 + i, f"the key: winter came over {w} and a mountain", "src") for i, w in enumerate(("internationalisation", "misunderstandings") * 40)]
    other = [
        (2000, 'password="correct horse battery" x', "src"), (2001, "pwd=short", "src"), (2002, "path: /a/b/c.d", "src"),
        (2003, '{"auth":{"token":"q1!w2@"},"api_key":"e3#r4$t5"}', "src"),
    ]
    rows = spark.createDataFrame(secret + prose + other, "doc_id long, text string, source string")
    got = secrets.scan(rows).collect()
    found = {(r.doc_id, r.finding) for r in got}
    assert {(i, v) for i, (_, v) in enumerate(made)} == {f for f in found if f[0] < 1000}
    assert {(2000, "correct horse battery"), (2003, "q1!w2@"), (2003, "e3#r4$t5")} == {f for f in found if f[0] >= 2000}
    assert {(r.doc_id, r.finding) for r in got if r.doc_id < 1000 and not r.is_secret} == set()
    assert not any(r.is_secret for r in got if 1000 <= r.doc_id < 2000) and (1000, "winter") in found
    words = {i: t.split() for i, t, _ in secret}
    assert all(r.finding in words[r.doc_id][r.word] for r in got if r.doc_id < 1000)


def test_warc(spark, tmp_path):
    pages = [(1, "http://A.Example.com:80/x?y#z", "same"), (2, None, "same"), (2, None, "same"), (3, "", None), (4, "nonsense", ""),
             (None, "http://b.example/", "same"), (5, "http://é.example/ü", "Ü" * 70_000)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = warc.archive_round_trip(rows, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted(
        [("1", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "response", None), ("3", 0, "revisit", 4),
         ("4", 0, "response", None), ("None", 4, "revisit", 2), ("5", 140_000, "response", None)]
    )
    assert {r.payload_digest for r in got if r.page_id == 1} == {warc.payload_digest(b"same")}
    assert warc.url_key("http://u@A.Example.com:80/x?y#z") == "com,example,a:80)/x?y"


def test_warc_repeated_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 3)
    rows = spark.createDataFrame([(i // 4, "http://one.example/", f"p{i}") for i in range(100)], "page_id long, url string, html string")
    assert warc.archive_round_trip(rows, str(tmp_path)).count() == 100


def test_empty_tables(spark, none, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        exact_dedup.mark_duplicates(none), exact_dedup.drop_duplicates(none), line_dedup.drop_repeated_lines(none),
        *mixing.mix(none), shards.assign_shards(none), jaccard.join_classes(none), language.identify(none),
        decontaminate.find_items(none, items(spark)), pii.find_personal_data(none), secrets.scan(none),
        warc.archive_round_trip(pages, str(tmp_path)), jaccard.drop_near_duplicates(none), language.keep_identified(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    full = spark.createDataFrame(ODD, SCHEMA)
    assert decontaminate.find_items(full, items(spark).limit(0)).count() == 0
    assert decontaminate.drop_contaminated(full, items(spark).limit(0)).count() == len(ODD)
