"""Very long texts, lines and names; parsing and decoding held against plain forms; what reaches the driver."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import decontaminate, language, line_dedup, pii, secrets

PACKAGE = Path(__file__).resolve().parent.parent.parent / "marquee" / "llm"
#: Module -> how many gathers to the driver it has, and what bounds each.
GATHERED = {
    "decontaminate": (1, "sizes of items, 1 to 5 words"),
    "jaccard": (1, "the most frequent shingles, at most FREQUENT"),
    "language": (2, "one row a language; a few times LETTERS of labelled text a language"),
    "lm": (3, "contexts that hold more than one of MOST_HOT tokens each, three lists a level"),
    "mixing": (1, "sources, at most MOST_SOURCES"),
    "pii": (1, "LABELLED sequences"),
    "secrets": (2, "two kinds of label, twice"),
    "shards": (2, "the heap's items: groups above a share of the bytes, and bundles by hash"),
    "warc": (1, "one row a partition: the directory of archives"),
    "whitening": (3, "the most common length; dimensions; pairs of dimensions"),
}


def test_what_is_gathered():
    for path in PACKAGE.glob("*.py"):
        source = path.read_text()
        assert source.count(".collect()") == GATHERED.get(path.stem, (0, ""))[0], path.stem
        for call in (".toPandas(", ".toLocalIterator(", "localCheckpoint", "crossJoin", ".rdd"):
            assert call not in source, (path.stem, call)


def test_text_of_100_000_lines(spark):
    lines = [f"line {i}" if i % 3 else "Shared  " for i in range(100_000)]
    docs = spark.createDataFrame([(0, "\n".join(lines)), *[(i, f"shared\nown {i}") for i in range(1, 12)]], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[0].text == "\n".join(s for i, s in enumerate(lines) if i % 3)
    assert (got[0].n_lines, got[0].n_dropped, got[5].text) == (100_000, 33_334, "own 5")


def test_document_of_2_000_items(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    items = spark.createDataFrame([(i, words(i)) for i in range(2_000)] + [(7, words(7)), (7, "short one")], "item_id long, text string")
    dump = "\n".join(words(i) for i in range(2_000))
    docs = spark.createDataFrame([(1, dump), (1, dump), (2, f"before {words(3)} after"), (3, "nothing"), (None, words(7))], "doc_id long, text string")
    found = decontaminate.find_items(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, i) for i in range(2_000)} | {(2, 3), (None, 7)}
    assert len(found) == 2_002 and {(r.n_shared, r.n_item) for r in found} == {(8, 8)}


def test_items_that_share_their_runs(spark):
    items = spark.createDataFrame([(i, "a b c d e f g " + " ".join(f"{i}.{j}" for j in range(1 + i % 3))) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "x a b c d e f g y"), (1, "a b c d e f g 4.0 4.1 z")], "doc_id long, text string")
    lists = {r.item_id: r.text.split() for r in items.collect()}
    runs = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    want = {
        (d.doc_id, i): len(runs(ws) & runs(d.text.split()))
        for d in docs.collect() for i, ws in lists.items() if 100 * len(runs(ws) & runs(d.text.split())) >= 80 * len(runs(ws))
    }
    assert want and {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.find_items(docs, items).collect()} == want


def test_secrets_after_long_names_and_open_quotes(spark):
    many = " ".join(f'password="{i}open' for i in range(3_000))
    texts = [
        "password" + "x" * 70 + "=hunter2S!", "key" * 20_000 + ' = "k9.8Qz!7rT#5w"', 'secret: "two words" more', "x" * 200_000,
        many, "token='never closed and so on", 'api_key="' + "word " * 50 + 'end" after',
    ]
    docs = spark.createDataFrame([(i, t, None, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, finding string, word int")
    found: dict[int, set[str]] = {}
    for r in secrets.candidates(docs, "doc_id", "text", "source").collect():
        found.setdefault(r.id, set()).add(r.finding)
    assert "hunter2S!" in found[0] and "k9.8Qz!7rT#5w" in found[1] and "two words" in found[2]
    assert ("word " * 50 + "end") in found[6] and {"x" * 200_000} == found[3]
    assert {f.split()[0] for f in found[4]} >= {f"{i}open" for i in range(0, 2_999)}
    judged = secrets.scan(docs)
    assert {r.doc_id for r in judged.collect()} == set(found)


def test_words_are_parsed_as_one_by_one():
    random.seed(1)
    texts = ["the cat sat on the mat and the dog", "der hund und die katze über straße", "le chat ß"]
    tables = language.Tables(texts)
    parser = language.Parser(tables)
    words = ["".join(random.choice("thecatdoguberßüxz漢") for _ in range(random.randrange(1, 15))) for _ in range(500)] + ["x" * 5_000, "the"]

    def plain(word: str, text: str) -> int:
        word, text, count, at = f" {word} ", f" {text} ", 0, 0
        while at < len(word):
            size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in text), default=1)
            count, at = count + 1, at + size
            if size > 1_000:
                break
        return count

    got = parser.phrases(words)
    automata = [language.SuffixAutomaton(f" {t} ") for t in texts]
    for i, w in enumerate(words):
        assert got[i].tolist() == [a.phrases(f" {w} ") for a in automata]
        if len(w) < 100:
            assert got[i].tolist() == [plain(w, t) for t in texts]


def test_remembered_words_change_nothing():
    random.seed(2)
    tables = language.Tables(["one two three four", "un deux trois quatre"])
    texts = [" ".join("".join(random.choice("onetwdeuxr") for _ in range(4)) for _ in range(60)) for _ in range(80)] + [None, "", "12 ½ ²a"]
    counts = [np.concatenate([p.counts(texts[i : i + 7]) for i in range(0, len(texts), 7)]) for p in (language.Parser(tables), language.Parser(tables, 50))]
    assert (counts[0] == counts[1]).all() and counts[0][-3:-1].sum() == 0
    for text, row in zip(texts, counts[0]):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        assert row[0] == sum(c.isalpha() for w in words for c in w)
        assert row[1:].tolist() == (parser_sum(tables, words) if words else [0, 0])


def parser_sum(tables, words):
    return language.Parser(tables).phrases(words).sum(axis=0).tolist()


def test_little_learnt_text_is_no_handicap():
    letters = {"a": "abcdefgh", "b": "ijklmnop"}
    random.seed(4)
    text = lambda kind, n: " ".join("".join(random.choice(letters[kind]) for _ in range(3)) for _ in range(n))
    tables = language.Tables([text("a", 4_000), text("b", 100)])
    parser = language.Parser(tables)
    said = [language.verdict(c, ["a", "b"], tables.bits)[0] for c in parser.counts([text(k, 20) for k in "ab" * 20])]
    assert said == list("ab" * 20)


def enumerate_best(crf, x, n_labels):
    best = None
    for labels in itertools.product(range(n_labels), repeat=len(x)):
        score = sum(crf.weights[f, y] for fs, y in zip(x, labels) for f in fs) + crf.steps[-1, labels[0]]
        score += sum(crf.steps[a, b] for a, b in zip(labels, labels[1:]))
        if best is None or score > best[0] + 1e-12:
            best = score, list(labels)
    return best


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(6)
    n = len(pii.LABELS)
    crf = pii.Crf(rng.standard_normal((pii.BUCKETS + 1, n)), rng.standard_normal((n + 1, n)))
    crf.weights[pii.BUCKETS] = 0
    sequences = [[rng.integers(0, pii.BUCKETS, 3).tolist() for _ in range(k)] for k in (1, 2, 3, 4, 4)]
    for room in (1, 3, 50_000):  # also block by block
        assert crf.decode(sequences, room) == [enumerate_best(crf, s, n)[1] for s in sequences]


def test_field_learns_by_the_gradient_of_the_likelihood():
    """One step of learning from zero moves each weight as the difference of counts and uniform expectation says."""
    x, y = [[[1], [2, 3]], [[1]]], [[1, 2], [0]]
    crf = pii.Crf().fit(x, y, rounds=1, rate=0.5)
    n = len(pii.LABELS)
    want = np.zeros((4, n))
    for fs, labels in zip(x, y):
        for f_list, label in zip(fs, labels):
            for f in f_list:
                want[f, label] += 1
                want[f] -= 1 / n
    assert (np.sign(crf.weights[:4]).round() == np.sign(want.round(12))).all()


def test_long_line_is_decoded_in_blocks():
    text = " ".join(str(10**7 + i) for i in range(60_000))
    crf = pii.Crf()
    tracemalloc.start()
    base, _ = pii.all_spans([text], crf)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not base and peak < 500 * 60_000
    cut = pii.all_spans([text[: 9 * 1_000 - 1]], crf)[0]
    assert hashlib.sha256(pii.written(cut[0]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_clashing_columns_of_identified_rows(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 5, 6)], "doc_id long, text string, lang string, whole_row int, id int")
    kept = language.keep_identified(docs.withColumn("doc_id", F.lit(3).cast("long")))
    assert kept.columns == docs.columns and kept.count() == 1


def test_dictionary_is_counted_over_the_corpus(spark):
    """Words of any length and script count where the texts have them; parts of random strings do not."""
    texts = ["The configuration, straße and überraschung (straße) of configuration."] * 3 + ["x = getConfigurationOfStraße_HTTP"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([("configuration",), ("straße",), ("überraschung",), ("get",), ("http",)], "part string")
    known = secrets.word_table(docs, asked, least=5)
    assert {r.part for r in known.collect()} == {"configuration", "straße"}
    found = spark.createDataFrame([("getConfigurationOfStraße_HTTP",), ("zq8Kx",), ("configuration",), ("CONFIGURATION",)], "finding string")
    assert {r.finding: r.covered for r in secrets.with_coverage(found, known).collect()} == {
        "getConfigurationOfStraße_HTTP": 19, "zq8Kx": 0, "configuration": 13, "CONFIGURATION": 13,
    }
