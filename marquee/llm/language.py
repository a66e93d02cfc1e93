"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases wins."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import fresh

#: Letters of labelled text a language's automaton is built from.
LETTERS = 40_000
#: What `normal_words` takes for a break between letters.
BREAK = r"[^\p{L}\p{Nl}\p{No}]+"
#: Words of a task whose phrase counts are remembered; when there are more, the half used most stays.
REMEMBERED = 400_000
#: Texts that are parsed at a time.
SLICE = 500
UNKNOWN = "und"
RUN = re.compile(r"[^\W\d_]+")


def normal_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return RUN.findall(text.lower())


class SuffixAutomaton:
    """All substrings of a text: from state 0, following the letters of a string succeeds just if the text contains it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for letter in text:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            state = last
            while state != -1 and letter not in self.next[state]:
                self.next[state][letter] = new
                state = link[state]
            if state != -1:
                target = self.next[state][letter]
                if length[target] == length[state] + 1:
                    link[new] = target
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    link.append(link[target])
                    length.append(length[state] + 1)
                    link[target] = link[new] = copy
                    while state != -1 and self.next[state].get(letter) == target:
                        self.next[state][letter] = copy
                        state = link[state]
            last = new

    def phrases(self, word: str) -> int:
        """Greedy longest matches that `word` falls into; a letter the text lacks is a phrase of its own."""
        count, state, moves = 0, 0, self.next
        for letter in word:
            to = moves[state].get(letter)
            if to is None:
                count += 1 if state else 0
                to = moves[0].get(letter)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (1 if state else 0)


class Tables:
    """The automata of several languages as arrays: letters, and the moves (state, letter) -> state as sorted keys.

    States of all languages are numbered through; language i starts in `roots[i]`. `bits` is what a phrase of a language
    costs: a place in its text, by the length of what was learnt, and the letter that ends the phrase.
    """

    def __init__(self, texts: list[str]):
        texts = [f" {t} " for t in texts]
        self.letters = np.unique(code_points("".join(texts)))
        width, roots, keys, targets, states = len(self.letters), [], [], [], 0
        number = {chr(c): i for i, c in enumerate(self.letters.tolist())}
        for text in texts:
            moves = SuffixAutomaton(text).next
            roots.append(states)
            keys += [(states + at) * width + number[c] for at, to in enumerate(moves) for c in to]
            targets += [states + to for at in moves for to in at.values()]
            states += len(moves)
        self.roots = np.array(roots, np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.bits = np.array([np.log2(len(t)) for t in texts]) + np.log2(width + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Parser:
    """Phrase counts of texts under several languages; words, between two spaces, are parsed each on its own."""

    def __init__(self, tables: Tables, remembered: int = REMEMBERED):
        self.tables, self.remembered, self.width = tables, remembered, len(tables.letters)
        self.shift = np.uint64(64 - max(2 * len(tables.keys), 2).bit_length())
        slots = 1 << (64 - int(self.shift))
        # open addressing: a move sits in the first free slot from the one its key names
        self.slot_keys, self.slot_targets = np.full(slots + len(tables.keys), -1, np.int64), np.zeros(slots + len(tables.keys), np.int32)
        left, at = np.arange(len(tables.keys)), self._slot(tables.keys)
        while len(left):
            free = np.flatnonzero(self.slot_keys[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            winners = free[first]
            self.slot_keys[taken], self.slot_targets[taken] = tables.keys[left[winners]], tables.targets[left[winners]]
            rest = np.ones(len(left), bool)
            rest[winners] = False
            left, at = left[rest], at[rest] + 1
        self._forget(np.zeros((0, 1 + len(tables.roots)), np.int32), [])

    def _forget(self, rows: np.ndarray, words: list[str]) -> None:
        self.places: defaultdict[str, int] = defaultdict(None, zip(words, range(len(words))))
        self.places.default_factory = self.places.__len__
        self.rows, self.used = rows, np.zeros(len(words), np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _move(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where each state goes with a letter (by number, -1 if no language has it), or -1."""
        keys = np.where(letters >= 0, states * self.width + letters, -2)
        at, out = self._slot(np.maximum(keys, 0)), np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            found, wanted = self.slot_keys[at[open_]], keys[open_]
            same = found == wanted
            out[open_[same]] = self.slot_targets[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
            at[open_] += 1
        return out

    def phrases(self, words: list[str]) -> np.ndarray:
        """(word, language) -> greedy longest matches the word falls into, all words a letter at a time."""
        sizes = np.array([len(w) for w in words], np.int64) + 2
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        letters = code_points("".join([f" {words[i]} " for i in order]))
        place = np.minimum(np.searchsorted(self.tables.letters, letters), self.width - 1)
        letters = np.where(self.tables.letters[place] == letters, place, -1)
        starts, roots = np.cumsum(sizes) - sizes, self.tables.roots
        n, count = len(roots), np.zeros((len(words), len(roots)), np.int32)
        state = np.tile(roots, (len(words), 1))
        for j in range(int(sizes[0]) if len(words) else 0):
            k = int(np.searchsorted(-sizes, -j))  # words that have a letter j come first
            letter, now = np.repeat(letters[starts[:k] + j], n), state[:k].ravel()
            root = np.tile(roots, k)
            to = self._move(now, letter)
            stuck = np.flatnonzero(to < 0)
            more = (now[stuck] != root[stuck]).astype(np.int32)
            again = self._move(root[stuck], letter[stuck])
            to[stuck] = np.where(again >= 0, again, root[stuck])
            count[:k].reshape(-1)[stuck] += more + (again < 0)
            state[:k] = to.reshape(k, n)
        count += state != roots
        out = np.empty_like(count)
        out[order] = count
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """(letters, phrases by language...) of each text."""
        words = [normal_words(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        known = len(self.rows)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        fresh = list(islice(self.places, known, None))
        if fresh:
            # combining marks and the like count as letters for the pattern, but not for the verdict
            own = np.array([[len(w) if w.isalpha() else sum(map(str.isalpha, w))] for w in fresh], np.int32)
            parts = [self.phrases(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self.rows = np.concatenate([self.rows, np.hstack([own, np.concatenate(parts)])])
        out = np.zeros((len(texts), self.rows.shape[1]), np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.rows[at], (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int64)
        self.used = np.r_[self.used, np.zeros(len(fresh), np.int64)] + np.bincount(at, minlength=len(self.rows))
        if len(self.rows) > self.remembered:  # the words used most stay
            best = np.sort(np.argsort(-self.used, kind="stable")[: self.remembered // 2])
            names, used = list(self.places), self.used[best]
            self._forget(self.rows[best], [names[i] for i in best.tolist()])
            self.used = used
        return out


def verdict(counts: np.ndarray, names: list[str], bits: np.ndarray) -> tuple[str, float]:
    """The language that takes the fewest bits (ties: the first of `names`), and how far behind the next is, from 0 to 1."""
    if not counts[0] or not names:
        return UNKNOWN, 0.0
    cost = counts[1:] * bits
    order = np.argsort(cost, kind="stable")
    if len(order) == 1:
        return names[0], 1.0
    return names[order[0]], float(1 - cost[order[0]] / cost[order[1]])


def training_rows(docs: DataFrame, id_column: str, text_column: str, lang_column: str, chosen: Column, letters: int) -> dict[str, str]:
    """language -> labelled text of about `letters` code points: rows by the order of a hash, the last one cut.

    Languages come in the order of how much labelled text they have, then by name. Of a longer row its first `letters`
    letters are read. How large a share of a language's rows is read follows from its total, so that about four times
    what is needed reaches the driver, whatever the size of the table; the first row by the hash is always among them.
    """
    size, text, lang = F.length(text_column), F.col(text_column), F.col(lang_column)
    roll = F.pmod(F.xxhash64(F.lit("language"), id_column, text_column), F.lit(1 << 30))
    rows = docs.where(lang.isNotNull() & chosen & text.rlike(r"\p{L}"))
    each = rows.select(lang.alias("lang"), roll.alias("roll"), size.alias("size"))
    totals = each.groupBy("lang").agg(
        F.sum("size").alias("n"), F.sum(F.least("size", F.lit(letters))).alias("usable"), F.min("roll").alias("first")
    )
    totals = totals.orderBy(F.desc("n"), "lang").collect()
    if not totals:
        return {}
    bounds = [(r.lang, max(r.first + 1, int(min(1.0, 4 * letters / r.usable) * (1 << 30)))) for r in totals]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    cut = F.when(size > letters, F.substring(F.regexp_replace(text, BREAK, " "), 1, letters)).otherwise(text)
    picked = rows.select(lang.alias("lang"), roll.alias("roll"), text_column).join(bounds, "lang").where("roll < bound")
    taken = picked.select("lang", "roll", cut.alias("text")).collect()
    texts: dict[str, str] = {}
    for r in sorted(taken, key=lambda r: (r.lang, r.roll, r.text)):
        so_far = texts.get(r.lang, "")
        if len(so_far) < letters:
            texts[r.lang] = (so_far + " " + " ".join(normal_words(r.text)))[:letters]
    return {r.lang: texts[r.lang] for r in totals if texts.get(r.lang, "").strip()}


def identify(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    letters: int = LETTERS,
    carry: str | None = None,
) -> DataFrame:
    """(id, held_out, lang_pred, score), one row per row of `docs`; the column `carry`, if named, comes along.

    Rows with crc32(id as text) % 4 = 2 are held out: the automata are built from other rows with a text and a language
    (a bounded sample, `letters` a language, of every language that has such a row with a letter in it). Each word of a text, letters in lower case between two spaces, is parsed
    into the longest pieces that a language's text contains. A piece costs the bits that name a place in that text and
    the letter after it, so little learnt text is no handicap by itself; the language with the least cost of the whole text is
    the prediction, ties go to the language with more labelled text. The score is 1 minus its cost over that of the next language; 1 if
    there is no other. `und` with score 0 is for a text that is null or has no letters, and for all where nothing is
    labelled. A row with a null id is neither held out nor learnt from. An empty table gives an empty result; rows
    repeated are judged each; other columns are ignored.
    """
    remainder = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4))
    texts = training_rows(docs, id_column, text_column, lang_column, remainder != 2, letters)
    names = list(texts)
    tables = Tables([texts[n] for n in names]) if names else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            said = [(UNKNOWN, 0.0)] * batch.num_rows
            if tables is not None:
                parser = parser or Parser(tables)
                said = [verdict(c, names, tables.bits) for c in parser.counts(batch.column("t").to_pylist())]
            made = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            along = [batch.column("carried")] if carry else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), *made, *along],
                names=[id_column, "held_out", "lang_pred", "score", *[carry] * len(along)],
            )

    read = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
        F.col(text_column).alias("t"),
        *([F.col(carry).alias("carried")] if carry else []),
    )
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType)])
    schema = schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    if carry:
        schema = schema.add(carry, docs.schema[carry].dataType)
    return read.mapInArrow(judge, schema)


def keep_identified(docs: DataFrame, text_column: str = "text", **columns) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language `identify` can tell: all but those that are `und`."""
    kept, row = docs.columns, fresh(docs.columns, "whole_row")
    said = identify(docs.select("*", F.struct(*map(_quoted, kept)).alias(row)), text_column=text_column, carry=row, **columns)
    return said.where(F.col("lang_pred") != UNKNOWN).select(*[F.col(row).getField(c).alias(c) for c in kept])


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
