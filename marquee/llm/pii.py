"""Personal data: fixed patterns, and a linear-chain conditional random field that finds more of their kind."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Rows the labelled table is drawn from, and its sequences.
LABELLED_ROWS = 6_000
LABELLED = 1_500
#: Words on either side of one with a digit or an @ that belong to its sequence.
CONTEXT = 3
BUCKETS = 256

# nothing follows the repeats, so what they took is never given back and need not be remembered
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its first digit: from a later one it goes on alike
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TELLING = re.compile("[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SHAPES = str.maketrans(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "X" * 26 + "x" * 26 + "d" * 10
)


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: what the fixed patterns find."""
    found = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def sequences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words of a line, as (start, end), in which each is at most CONTEXT words from one with a digit or an @."""
    line_start = 0
    while line_start <= len(text):
        hit = TELLING.search(text, line_start)
        if hit is None:
            return
        line_start = text.rfind("\n", line_start, hit.start()) + 1 or line_start
        line_end = text.find("\n", hit.start())
        line_end = len(text) if line_end < 0 else line_end
        spans = [m.span() for m in TOKEN.finditer(text, line_start, line_end)]
        telling = [i for i, (a, b) in enumerate(spans) if TELLING.search(text, a, b)]
        first, last = telling[0] - CONTEXT, telling[0] + CONTEXT
        for i in telling[1:]:
            if i - CONTEXT > last + 1:
                yield spans[max(0, first) : last + 1]
                first = i - CONTEXT
            last = i + CONTEXT
        yield spans[max(0, first) : last + 1]
        line_start = line_end + 1


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % BUCKETS


def word_class(word: str) -> str:
    if "@" in word:
        return "at"
    if not DIGIT.search(word):
        return "letters" if word[:1].isalpha() else "signs"
    return "number" if not re.search("[A-Za-z]", word) else "mixed"


def shape_features(word: str) -> list[str]:
    """Names of what a word's shape shows; never its letters or digits themselves."""
    if not TELLING.search(word):
        return ["plain" if word[:1].isalpha() else "signs"]
    shape = word.translate(SHAPES)
    squeezed = re.sub(r"(.)\1+", r"\1", shape)[:16]
    n = shape.count("d")
    out = ["telling", "shape " + squeezed, f"digits {min(n, 20)}", "class " + word_class(word)]
    out += ["long " + re.sub(r"(.)\1{4,}", r"\1\1\1\1\1", shape)[:24], f"dots {min(shape.count('.'), 4)}"]
    return out + [f"starts {shape[0]}", f"ends {shape[-1]}"]


class Features:
    """Feature indices of words, remembered by shape."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}

    def own(self, word: str) -> list[int]:
        shape = word.translate(SHAPES) if TELLING.search(word) else ("x" if word[:1].isalpha() else "-")
        found = self.known.get(shape)
        if found is None:
            found = [_bucket(f) for f in shape_features(word)]
            if len(self.known) < 100_000:
                self.known[shape] = found
        return found

    def of(self, words: list[str]) -> list[list[int]]:
        kinds = ["edge", *map(word_class, words), "edge"]
        sides = [[_SIDES["before", a], _SIDES["after", b]] for a, b in zip(kinds, kinds[2:])]
        return [self.own(w) + s for w, s in zip(words, sides)]


_SIDES = {(s, k): _bucket(f"{s} {k}") for s in ("before", "after") for k in ("edge", "at", "letters", "signs", "number", "mixed")}


def padded(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place, feature) with BUCKETS where there is none, and the lengths."""
    most = max(len(s) for s in sequences)
    width = max((len(f) for s in sequences for f in s), default=1)
    out = np.full((len(sequences), most, width), BUCKETS, dtype=np.int64)
    for i, s in enumerate(sequences):
        for j, f in enumerate(s):
            out[i, j, : len(f)] = f
    return out, np.array([len(s) for s in sequences])


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Linear-chain conditional random field: weights by feature and label, and by neighbouring labels."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        n = len(LABELS)
        self.weights = np.zeros((BUCKETS + 1, n)) if weights is None else weights
        self.steps = np.zeros((n + 1, n)) if steps is None else steps  # row n: the start

    def fit(self, features: list[list[list[int]]], labels: list[list[int]], rounds: int = 80, rate: float = 0.3) -> Crf:
        """Adam on the penalised log-likelihood, all sequences at a time; the same result on every run."""
        x, lengths = padded(features)
        n, most, _ = x.shape
        k = len(LABELS)
        y = np.zeros((n, most), dtype=np.int64)
        for i, s in enumerate(labels):
            y[i, : len(s)] = s
        inside = np.arange(most) < lengths[:, None]
        seen_w, seen_s = np.zeros_like(self.weights), np.zeros_like(self.steps)
        np.add.at(seen_w, (x[inside], y[inside][:, None]), 1)
        np.add.at(seen_s, (np.full(n, k), y[:, 0]), 1)
        both = inside[:, 1:]
        np.add.at(seen_s, (y[:, :-1][both], y[:, 1:][both]), 1)
        moments = [np.zeros_like(a) for a in (self.weights, self.weights, self.steps, self.steps)]
        for turn in range(1, rounds + 1):
            emit = self.weights[x].sum(2)
            move = self.steps[:k]
            ahead = np.zeros((most, n, k))
            ahead[0] = self.steps[k] + emit[:, 0]
            for t in range(1, most):
                step = _sum_exp(ahead[t - 1][:, :, None] + move, 1) + emit[:, t]
                ahead[t] = np.where(inside[:, t, None], step, ahead[t - 1])
            back = np.zeros((most, n, k))
            for t in range(most - 2, -1, -1):
                step = _sum_exp(move + (emit[:, t + 1] + back[t + 1])[:, None, :], 2)
                back[t] = np.where(inside[:, t + 1, None], step, 0)
            total = _sum_exp(ahead[-1], 1)
            single = np.exp(ahead.transpose(1, 0, 2) + back.transpose(1, 0, 2) - total[:, None, None])
            want_w, want_s = np.zeros_like(self.weights), np.zeros_like(self.steps)
            for f in range(x.shape[2]):
                np.add.at(want_w, x[:, :, f][inside], single[inside])
            want_s[k] = single[:, 0].sum(0)
            for t in range(most - 1):
                rows = inside[:, t + 1]
                pair = ahead[t][rows][:, :, None] + move + (emit[rows, t + 1] + back[t + 1][rows])[:, None, :]
                want_s[:k] += np.exp(pair - total[rows][:, None, None]).sum(0)
            for j, (a, grad) in enumerate(
                ((self.weights, (seen_w - want_w) / n - 1e-4 * self.weights), (self.steps, (seen_s - want_s) / n - 1e-4 * self.steps))
            ):
                m, v = moments[2 * j], moments[2 * j + 1]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                a += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
            self.weights[BUCKETS] = 0
        return self

    def decode(self, features: Sequence[Sequence[list[int]]], room: int = 50_000) -> list[list[int]]:
        """The most probable labels (Viterbi), by batches of sequences of like lengths.

        A batch has about `room` words, of which a fifth is looked up at a time, one block after another: the scores of the
        labels are carried over and only a back pointer (a byte) per word and label is kept.
        """
        order = sorted(range(len(features)), key=lambda i: len(features[i]))
        out: list[list[int]] = [[]] * len(features)
        while order:
            longest = len(features[order[-1]])
            part = [order.pop() for _ in range(min(len(order), max(1, room // longest)))]
            lengths, n, k = np.array([len(features[i]) for i in part]), len(part), len(LABELS)
            came = np.zeros((longest, n, k), dtype=np.int8)
            block = max(1, room // (5 * n))
            for start in range(0, longest, block):
                x, _ = padded([features[i][start : start + block] for i in part])
                emit = self.weights[x].sum(2)
                for t in range(start, start + emit.shape[1]):
                    if not t:
                        score = self.steps[k] + emit[:, 0]
                        continue
                    each = score[:, :, None] + self.steps[:k]
                    came[t] = each.argmax(1)
                    step = each.max(1) + emit[:, t - start]
                    on = (t < lengths)[:, None]
                    came[t] = np.where(on, came[t], np.arange(k))
                    score = np.where(on, step, score)
            label = score.argmax(1)
            path = np.zeros((n, longest), dtype=np.int8)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = came[t][np.arange(n), label]
            for row, i in enumerate(part):
                out[i] = path[row, : lengths[row]].tolist()
        return out


class Run:
    """The words of a sequence; features are made for the slices that are asked for."""

    def __init__(self, features: Features, text: str, words: list[tuple[int, int]]):
        self.features, self.text, self.words = features, text, words

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, part: slice) -> list[list[int]]:
        first, last, _ = part.indices(len(self.words))
        near = [self.text[a:b] for a, b in self.words[max(0, first - 1) : last + 1]]
        return self.features.of(near)[first - max(0, first - 1) :][: max(0, last - first)]


def span_labels(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each word (start, end): that of the span it overlaps most of, B- where the span begins."""
    out = [0] * len(words)
    ends = [b for _, b in words]
    for kind, a, b in spans:
        first = bisect_right(ends, a)
        for i in range(first, len(words)):
            if words[i][0] >= b:
                break
            if not out[i]:
                out[i] = 1 + 2 * kind + (i > first)
    return out


def labelled_spans(text: str, words: list[tuple[int, int]], labels: list[int]) -> list[tuple[int, int, int]]:
    """Spans of words labelled alike, without signs around them; such without a digit or an @ are none."""
    out, i = [], 0
    while i < len(words):
        if not labels[i]:
            i += 1
            continue
        kind, j = (labels[i] - 1) // 2, i + 1
        while j < len(words) and labels[j] == 2 + 2 * kind:
            j += 1
        a, b = words[i][0], words[j - 1][1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if TELLING.search(text, a, b):
            out.append((kind, a, b))
        i = j
    return out


def all_spans(texts: list[str], model: Crf) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text; an added one overlaps no base span."""
    features, owners, places, base = Features(), [], [], []
    rows = []
    for i, text in enumerate(texts):
        base.append(base_spans(text))
        for words in sequences(text):
            owners.append(i)
            places.append(words)
            rows.append(Run(features, text, words))
    both = [list(b) for b in base]
    taken: dict[int, tuple[list[int], list[int]]] = {}
    for i, words, labels in zip(owners, places, model.decode(rows)):
        if not any(labels):
            continue
        if i not in taken:
            merged = sorted((a, b) for _, a, b in base[i])
            tops = list(np.maximum.accumulate([b for _, b in merged])) if merged else []
            taken[i] = ([a for a, _ in merged], tops)
        starts, tops = taken[i]
        for kind, a, b in labelled_spans(texts[i], words, labels):
            before = bisect_right(starts, b - 1)  # base spans that start before b; the furthest end tells the rest
            if not before or tops[before - 1] <= a:
                both[i].append((kind, a, b))
    return [(b, sorted(s)) for b, s in zip(base, both)]


def labelled_table(docs: DataFrame, id_column: str, text_column: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """(roll, words, labels): sequences of about `rows` rows with a digit or an @, picked by hash, labelled by the fixed patterns."""
    telling = docs.where(F.col(text_column).rlike("[0-9@]"))
    total = telling.count()
    roll = F.pmod(F.xxhash64(F.lit("labelled"), id_column, text_column), F.lit(1 << 30))
    share = min(1.0, rows / total) if total else 1.0

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, text in zip(batch.column("roll").to_pylist(), batch.column("t").to_pylist()):
                spans = base_spans(text)
                for i, words in enumerate(sequences(text)):
                    near = [s for s in spans if s[1] < words[-1][1] and s[2] > words[0][0]]
                    out.append((r, i, [text[a:b] for a, b in words[:64]], span_labels(words, near)[:64]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.list_(pa.string())),
                    pa.array([x[3] for x in out], pa.list_(pa.int64())),
                ],
                names=["roll", "place", "words", "labels"],
            )

    picked = telling.select(roll.alias("roll"), F.col(text_column).alias("t"))
    picked = picked.where(F.col("roll") < share * float(1 << 30))
    return picked.mapInArrow(label, "roll long, place long, words array<string>, labels array<long>")


def train(labelled: DataFrame, most: int = LABELLED) -> Crf:
    """A field trained on at most `most` labelled sequences (columns of `labelled_table`), in the order of their roll."""
    rows = labelled.orderBy("roll", "place", "words").limit(most).collect()
    if not rows:
        return Crf()
    features = Features()
    return Crf().fit([features.of(r.words) for r in rows], [list(r.labels) for r in rows])


def find_personal_data(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", labelled: DataFrame | None = None
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per row of `docs`.

    The fixed patterns give the base spans, non-overlapping within a kind; the n_ columns count them, and base_sha256
    is over them, written kind:start:end by kind and start, in code points. `spans` also holds what the random field
    finds outside of all base spans (n_added of them). It labels words by their shapes, in runs of words around each
    one with a digit or an @; it is trained on `labelled` (roll, place, words, labels), by default on a bounded table
    that the fixed patterns label. Null is the empty text; a text without findings has empty spans. Whole texts are
    searched, however long: a line is decoded in blocks, for some 150 bytes a word; rows repeated, null ids and empty tables need nothing special; other columns are ignored.
    """
    small_batches(docs)
    model = train(labelled if labelled is not None else labelled_table(docs, id_column, text_column))
    weights, steps = model.weights, model.steps

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Crf(weights, steps)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = all_spans(batch.column("t").to_pylist(), field)
                counts = np.zeros((len(found), len(KINDS)), dtype=np.int64)
                for i, (base, _) in enumerate(found):
                    for kind, _, _ in base:
                        counts[i, kind] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                        pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                        pa.array([written(s) for _, s in found], pa.string()),
                        pa.array([len(s) - len(b) for b, s in found], pa.int64()),
                    ],
                    names=[id_column, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    kind = docs.schema[id_column].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return read.mapInArrow(search, f"`{id_column}` {kind}, {counts}, base_sha256 string, spans string, n_added long")
