"""Language-model scores from a smoothed n-gram trie whose levels are cut into shards and never leave their task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import stored
from marquee.llm.elias_fano import EliasFano, Level

#: Tokens of a block of documents; a longer document is a block of its own.
BLOCK = 1 << 20
#: n-grams that a shard of the trie is asked for, about.
PER_SHARD = 2_000_000
#: A context met more often is spread over several shards; at most one of MOST_HOT contexts is.
HOT, MOST_HOT = 1_000_000, 65_536
#: What is taken off each count and given to words not seen after the context.
DISCOUNT = 0.75
#: A probability is kept as a code: code k (from 1) stands for 10 ** ((1 - k) * STEP).
STEP = 0.04
#: Local numbers of the two tokens that are no words: the end of a text, and what comes before its first word.
END, BEGIN = 0, 1


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(1 + np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 1, 255).astype(np.uint8)


def value(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** ((1.0 - np.arange(256)) * STEP)[codes]


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of pairs."""
    x = np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: END is the empty word and BEGIN a space: no word of a text is either.
MARKS = np.array([word_hash(b""), word_hash(b" ")], np.uint64)


def short(words: np.ndarray) -> np.ndarray:
    """32 bits of a word's hash, by which a context's successors are told apart."""
    return (words >> np.uint64(32)).astype(np.uint32)


def blocks_of(rows: Iterable[tuple[object, bytes | None, bool]], part: int, most: int = BLOCK) -> Iterator[tuple]:
    """(block, ids, held out, tokens of each text, hashes of the distinct words, tokens) of successive documents."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids: list = []
    held: list[bool] = []
    sizes: list[int] = []
    tokens: list[np.ndarray] = []
    seq, n = part << 32, 0

    def block() -> tuple:
        words = np.fromiter(map(word_hash, numbers), np.uint64, len(numbers))
        return seq, ids, held, np.array(sizes, np.int64).tobytes(), words.tobytes(), np.concatenate(tokens).tobytes()

    def begin() -> None:
        numbers.clear()
        for mark in (b"", b" "):
            numbers[mark]

    begin()
    for doc, text, out in rows:
        # bytes are lower-cased and split in ASCII alone, as the tokens are defined
        words = (text or b"").lower().split()
        if ids and n + len(words) + 1 > most:
            yield block()
            ids, held, sizes, tokens, n, seq = [], [], [], [], 0, seq + 1
            begin()
        ids.append(doc)
        held.append(out)
        sizes.append(len(words) + 1)
        tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        tokens.append(np.zeros(1, np.int32))
        n += len(words) + 1
    if ids:
        yield block()


BLOCK_FIELDS = "block long, held array<boolean>, sizes binary, words binary, tokens binary, n long, n_train long, n_texts long"


class Block:
    """The tokens of a block and, level by level, its distinct n-grams."""

    def __init__(self, sizes: bytes, words: bytes, tokens: bytes, held: list[bool]):
        self.sizes, self.words = np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64)
        self.tokens, self.held = np.frombuffer(tokens, np.int32), np.array(held, bool)
        self.train = ~np.repeat(self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def before(self, tokens: np.ndarray, first: int) -> np.ndarray:
        """The value of the token before each one, `first` at the beginning of a text."""
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[self.starts] = first
        return out

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, successors, training counts, gram of each token) of the distinct n-grams of `level` words."""
        size, last = len(self.words), self.before(self.tokens, BEGIN).astype(np.int64)
        keys, at, begin = mixed(self.words), last, BEGIN
        for _ in range(level - 2):  # one word more: the context of the token before, and that token
            distinct, at = np.unique(self.before(at, begin) * size + last, return_inverse=True)
            keys = mixed(keys[distinct // size], short(self.words)[distinct % size])
            begin = at[self.starts[0]]
        distinct, gram = np.unique(at * size + self.tokens, return_inverse=True)
        counts = np.bincount(gram[self.train], minlength=len(distinct))
        return keys[distinct // size], short(self.words)[distinct % size], counts, gram


@dataclass
class Hot:
    """Contexts met very often: their counts, sorted by key, and in the end the weight of what follows each unseen."""

    keys: np.ndarray
    counts: np.ndarray

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Place of each context, or -1."""
        if not len(self.keys):
            return np.full(len(contexts), -1, np.int64)
        place = np.minimum(np.searchsorted(self.keys, contexts), len(self.keys) - 1)
        return np.where(self.keys[place] == contexts, place, -1)


def deal(contexts: np.ndarray, successors: np.ndarray, shards: int, hot: Hot, limit: int) -> np.ndarray:
    """The shard of each n-gram: by context, and where that is hot, by successor too."""
    place = hot.find(contexts)
    salt = np.zeros(len(contexts), np.uint64)
    spread = np.flatnonzero(place >= 0)
    if len(spread):
        parts = (hot.counts[place[spread]] // limit + 1).astype(np.uint64)
        salt[spread] = mixed(successors[spread].astype(np.uint64)) % parts
    return (mixed(contexts, salt) % np.uint64(shards)).astype(np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    differs = np.zeros(len(columns[0]), bool)
    differs[:1] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differs)


def asks(block: Block, level: int, shards: int, hot: Hot, limit: int) -> Iterator[tuple]:
    """(shard, order, contexts, sizes, successors, counts): the block's n-grams by shard, sorted in each."""
    contexts, successors, counts, _ = block.grams(level)
    shard = deal(contexts, successors, shards, hot, limit)
    order = np.lexsort((successors, contexts, shard))
    edges = np.r_[_runs(shard[order]), len(order)]
    for a, b in zip(edges[:-1], edges[1:]):
        at = order[a:b]
        first = _runs(contexts[at])
        yield int(shard[at[0]]), at, contexts[at][first], np.diff(np.r_[first, len(at)]), successors[at], counts[at]


def level_of(contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray, hot: Hot, discount: float) -> tuple:
    """(trie level, n-grams, their contexts, counts, numbers of successors by context) from n-grams in any order."""
    seen = counts > 0
    contexts, successors, counts = contexts[seen], successors[seen], counts[seen]
    order = np.lexsort((successors, contexts))
    contexts, successors, counts = contexts[order], successors[order], counts[order]
    first = _runs(contexts, successors)
    if len(first):
        contexts, successors, counts = contexts[first], successors[first], np.add.reduceat(counts, first)
    start = _runs(contexts)
    sizes = np.diff(np.r_[start, len(contexts)])
    total = np.add.reduceat(counts, start) if len(start) else np.zeros(0, np.int64)
    keys, place = contexts[start], hot.find(contexts[start])
    if len(hot.keys):
        total = np.where(place >= 0, hot.counts[np.maximum(place, 0)], total)
    share = np.maximum(counts - discount, 0) / np.repeat(total, sizes)
    weights = np.where(place >= 0, 0, quantised(discount * sizes / total)).astype(np.uint8)
    built = Level.build(keys, start, successors, quantised(share), weights)
    return built, contexts, successors, counts, keys[place >= 0], sizes[place >= 0]


SHORT_ANSWER = "block long, level int, shard int, codes binary, weights binary, keys binary, numbers binary, n long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _frombuffers(column: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in column]) if column else np.zeros(0, kind)


def _words_level(blocks: DataFrame, shards: int, limit: int) -> DataFrame:
    """Answers of the first level: exact training counts of a block's words, and per shard the number of words and hot ones."""
    asked = T.StructType.fromDDL("shard int, block long, keys binary, counts binary")
    asked_arrow, answer = _arrow(asked), T.StructType.fromDDL(SHORT_ANSWER)
    answer_arrow = _arrow(answer)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _block_rows(batches):
            block = Block(r["sizes"], r["words"], r["tokens"], r["held"])
            counts = np.bincount(block.tokens[block.train], minlength=len(block.words))
            for s, at in _by_shard(block.words, shards):
                yield _batch([(s, r["block"], block.words[at].tobytes(), counts[at].astype(np.int64).tobytes())], asked_arrow)

    def count(table: pa.Table) -> pa.Table:
        shard, rows = table["shard"][0].as_py(), table.select(["block", "keys", "counts"]).to_pylist()
        keys, counts = _frombuffers([r["keys"] for r in rows], np.uint64), _frombuffers([r["counts"] for r in rows], np.int64)
        order = np.argsort(keys[counts > 0], kind="stable")
        keys, counts = keys[counts > 0][order], counts[counts > 0][order]
        first = _runs(keys)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        trie, out = EliasFano.of(keys), []
        for r in rows:
            place = trie.find(np.frombuffer(r["keys"], np.uint64))
            found = np.where(place >= 0, counts[np.maximum(place, 0)], 0) if len(keys) else np.zeros(len(place), np.int64)
            out.append((r["block"], 1, shard, found.astype(np.int64).tobytes(), None, None, None, None))
        often = counts > limit
        out.append((None, 1, shard, None, None, mixed(keys[often]).tobytes(), counts[often].astype(np.int64).tobytes(), len(keys)))
        return pa.Table.from_batches([_batch(out, answer_arrow)])

    return blocks.mapInArrow(ask, asked).groupBy("shard").applyInArrow(count, answer)


def _by_shard(words: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (words % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((words, shard))
    edges = np.r_[_runs(shard[order]), len(order)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(shard[order[a]]), order[a:b]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _grams_level(blocks: DataFrame, level: int, shards: int, hot: Hot, limit: int, discount: float) -> DataFrame:
    """Answers of a level: codes of a block's n-grams and weights of their contexts; per shard, what concerns hot contexts.

    Keys and numbers of a shard's own row: its part of a hot context and how many successors it holds (n is null),
    or n-grams that are hot contexts of the next level and their counts (n is 0).
    """
    asked = T.StructType.fromDDL("shard int, block long, contexts binary, sizes binary, successors binary, counts binary")
    asked_arrow, answer = _arrow(asked), T.StructType.fromDDL(SHORT_ANSWER)
    answer_arrow = _arrow(answer)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _block_rows(batches):
            block = Block(r["sizes"], r["words"], r["tokens"], r["held"])
            for s, _, contexts, sizes, successors, counts in asks(block, level, shards, hot, limit):
                parts = (contexts, sizes.astype(np.uint32), successors, counts.astype(np.uint32))
                yield _batch([(s, r["block"], *[p.tobytes() for p in parts])], asked_arrow)

    def answer_all(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        rows = table.select(["block", "contexts", "sizes", "successors", "counts"]).to_pylist()
        each = [
            (np.frombuffer(r["contexts"], np.uint64), np.frombuffer(r["sizes"], np.uint32).astype(np.int64), np.frombuffer(r["successors"], np.uint32))
            for r in rows
        ]
        contexts = np.concatenate([np.repeat(c, n) for c, n, _ in each])
        successors = np.concatenate([s for _, _, s in each])
        counts = _frombuffers([r["counts"] for r in rows], np.uint32).astype(np.int64)
        built, contexts, successors, counts, parts, numbers = level_of(contexts, successors, counts, hot, discount)
        trie, out = Level(built), []
        for r, (c, n, s) in zip(rows, each):
            weights, codes = trie.find(c, n, s)
            out.append((r["block"], level, shard, codes.tobytes(), weights.tobytes(), None, None, None))
        if len(parts):
            out.append((None, level, shard, None, None, parts.tobytes(), numbers.astype(np.int64).tobytes(), None))
        often = counts > limit
        if often.any():
            keys = mixed(contexts[often], successors[often])
            out.append((None, level, shard, None, None, keys.tobytes(), counts[often].tobytes(), 0))
        return pa.Table.from_batches([_batch(out, answer_arrow)])

    return blocks.mapInArrow(ask, asked).groupBy("shard").applyInArrow(answer_all, answer)


def _hot(rows: list, n_texts: int, level: int, limit: int) -> Hot:
    """Hot contexts of `level` words and more: those that shards report, and the beginning of a text."""
    keys = [_frombuffers([r["keys"] for r in rows], np.uint64)]
    counts = [_frombuffers([r["numbers"] for r in rows], np.int64)]
    begin = mixed(MARKS[BEGIN : BEGIN + 1])
    for _ in range(level - 2):
        begin = mixed(begin, short(MARKS[BEGIN : BEGIN + 1]))
    if n_texts > limit:
        keys, counts = [*keys, begin], [*counts, np.array([n_texts])]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return Hot(keys[order], counts[order])


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def score(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    held_out: Column | None = None,
    order: int = 2,
    discount: float = DISCOUNT,
    block: int = BLOCK,
    per_shard: int = PER_SHARD,
    hot: int = HOT,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`.

    Tokens of a text are its words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case) and one end; null is the empty text, which
    has the end alone. The model learns from the rows for which `held_out` is not true (null: not held out). With c the count of a token among
    N training tokens, V of them distinct, its base probability is (c + 1) / (N + V + 1), which leaves one share for all
    unknown words; base_score is the sum of the tokens' log10. `score` is that of an n-gram model of `order` words: after
    a context h met c(h) times and followed by n(h) different tokens, p(w|h) = max(c(hw) - discount, 0) / c(h) +
    discount * n(h) / c(h) * p(w|h'), h' being one word shorter and the last the base; a context not met counts as h'.
    Both fractions are kept in 8 bits (within 4.7 %). n_known counts tokens with c > 0. Every row gets its own scores,
    also rows repeated and null ids; an empty table gives an empty result, other columns are ignored. A text is held in memory as a
    whole, however long; words are told apart by 64 bits of a hash, successors of a context by 32.

    Documents become blocks of tokens, stored once. For each level, a block asks shards for its distinct n-grams, with
    their counts: a shard adds up the counts, builds its part of the level of the trie (Elias-Fano sequences in one
    flat buffer, viewed in place), and answers all blocks. So n-grams are counted before they are shuffled, the trie
    grows with the input and no task holds more than about `per_shard` n-grams. Contexts met over `hot` times (and more
    than one in 65,536 tokens) are dealt out by successor as well; only their keys, counts and numbers of successors reach the driver,
    at most 65,536 a level.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"), held.alias("held"))
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL(BLOCK_FIELDS).fields])
    arrow = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(n).to_pylist() for n in ("id", "text", "held")]))
        for seq, ids, out, sizes, words, tokens in blocks_of(rows, TaskContext.get().partitionId(), block):
            lengths, trained = np.frombuffer(sizes, np.int64), ~np.array(out, bool)
            yield _batch(
                [(ids, seq, out, sizes, words, tokens, int(lengths.sum()), int(lengths[trained].sum()), int(trained.sum()))], arrow
            )

    kept = stored(read.mapInArrow(cut, schema), "lm-blocks")
    n, n_train, n_texts = kept.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_train", "n_texts")]).first()
    shards, limit = int(n // per_shard) + 1, max(hot, int(n_train // MOST_HOT))
    lean = kept.select("block", "sizes", "words", "tokens", "held")
    levels = [stored(_words_level(lean, shards, limit), "lm-level")]
    own = levels[0].where("block is null")
    n_words = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    next_hot = own.where(F.length("keys") > 0).select("keys", "numbers").collect()  # at most MOST_HOT contexts
    hots: list[tuple[Hot, np.ndarray]] = []
    for level in range(2, order + 1):
        often = _hot(next_hot, n_texts, level, limit)
        levels.append(stored(_grams_level(lean, level, shards, often, limit, discount), "lm-level"))
        own = levels[-1].where("block is null")
        weights = np.zeros(len(often.keys))
        for r in own.where("n is null").select("keys", "numbers").collect():  # parts of at most MOST_HOT contexts
            np.add.at(weights, often.find(np.frombuffer(r["keys"], np.uint64)), np.frombuffer(r["numbers"], np.int64))
        hots.append((often, quantised(discount * weights / often.counts) if len(weights) else weights.astype(np.uint8)))
        next_hot = own.where("n = 0").select("keys", "numbers").collect() if level < order else []

    result = T.StructType([T.StructField(id_column, id_type)])
    for field in T.StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).fields:
        result.add(field)
    result_arrow = _arrow(result)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {(r["level"], r["shard"]): r for r in right.select(["level", "shard", "codes", "weights"]).to_pylist()}
        batches = []
        for r in left.to_pylist():
            b = Block(r["sizes"], r["words"], r["tokens"], r["held"])
            counts = np.zeros(len(b.words), np.int64)
            for s, at in _by_shard(b.words, shards):
                counts[at] = np.frombuffer(answers[1, s]["codes"], np.int64)
            base = ((counts + 1.0) / (n_train + n_words + 1.0))[b.tokens]
            p = base
            for k, (often, hot_weights) in enumerate(hots, 2):
                contexts, _, _, gram = b.grams(k)
                shares, weights = np.zeros(len(contexts)), np.ones(len(contexts))
                for s, at, _, sizes, _, _ in asks(b, k, shards, often, limit):
                    codes = np.frombuffer(answers[k, s]["codes"], np.uint8)
                    weight = np.repeat(np.frombuffer(answers[k, s]["weights"], np.uint8), sizes)
                    shares[at] = np.where(codes > 0, value(codes), 0.0)
                    weights[at] = np.where(weight > 0, value(weight), 1.0)
                place = often.find(contexts)
                if len(often.keys):
                    code = hot_weights[np.maximum(place, 0)]
                    weights = np.where(place >= 0, value(code), weights)
                p = shares[gram] + weights[gram] * p
            made = {
                id_column: pa.array(r["ids"], result_arrow.types[0]),
                "held_out": pa.array(r["held"]),
                "n_tokens": pa.array(b.sizes),
                "n_known": pa.array(np.add.reduceat((counts > 0)[b.tokens].astype(np.int64), b.starts)),
                "train_tokens": pa.array(np.full(len(b.sizes), n_train, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(base), b.starts)),
                "score": pa.array(np.add.reduceat(np.log10(p), b.starts)),
            }
            batches.append(pa.RecordBatch.from_arrays(list(made.values()), schema=result_arrow))
        return pa.Table.from_batches(batches, result_arrow)

    answered = levels[0].where("block is not null")
    for more in levels[1:]:
        answered = answered.unionByName(more.where("block is not null"))
    answered = answered.select("block", "level", "shard", "codes", "weights")
    return kept.drop("n", "n_train", "n_texts").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(judge, result)
