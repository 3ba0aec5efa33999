"""Operator 10: language-model scores from a weighted backoff model.

``score_documents`` learns all n-grams that occur twice. Blocks of texts ask buckets of hashes for the
counts and weights of their distinct n-grams, and are answered; no step sends a row for an n-gram.
``train`` and ``Scorer`` are the same model as an automaton in one process, for training texts whose
n-grams fit it; tests compare the two.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dupeframe.llm.words import WordHashes, chunks, text_bytes, windows
from dupeframe.staging import stage

# Shares of all training tokens. A word or n-gram with at least a share s of N tokens is one of
# at most 1 / s (of each length), which bounds the automaton of ``train`` whatever the corpus.
WORD_SHARE = 1e-6
CONTEXT_SHARE = 1e-4
GRAM_SHARE = 4e-6
FLUSH_WORDS = 1 << 18
BLOCK_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 22  # at most so many n-grams of a length meet in a bucket, on average
SLICES = 4  # at most so many parts in which texts are scored, so that disk holds the weights of one at a time
END = b""  # no word is empty
END_HASH = np.uint64(0)
ASKED = "block long, k int, bucket int, data binary"
ANSWER = "block long, k int, bucket int, back boolean, data binary"


def _hash(word: bytes) -> int:
    """Signed, as Spark's long."""
    from xxhash import xxh3_64_intdigest

    value = xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (h, c): the hash of each distinct token and its count, the end tokens included.
    Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([
                pa.array(map(_hash, tally), pa.int64()), pa.array(tally.values(), pa.int64())], names=["h", "c"])
            tally.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                for piece in chunks(text.as_py()):
                    tally.update(piece.lower().split())
                tally[END] += 1
                if len(tally) > FLUSH_WORDS:
                    yield flush()
        if tally:
            yield flush()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class _Numbers(dict):
    """word -> place in a sorted array of hashes, or -1; remembered within a task."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.hashes = array("q", hashes.tobytes())

    def __missing__(self, word: bytes) -> int:
        value = _hash(word)
        at = bisect_left(self.hashes, value)
        found = at if at < len(self.hashes) and self.hashes[at] == value else -1
        if len(self) > FLUSH_WORDS * 4:
            self.clear()
        self[word] = found
        return found


def count_grams(texts: DataFrame, words: np.ndarray, kept: list[np.ndarray]) -> DataFrame:
    """Rows (code, n) of the n-grams one longer than those of ``kept[-1]``.

    ``words`` are the sorted hashes of the context words; a code is (number of the n-gram
    without its last word in ``kept[-1]``, or of its first word) * len(words) + its last word.
    Only n-grams of context words whose beginning and ending are kept are counted.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((words, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept = shared.value
        numbers, end = _Numbers(words), None
        for batch in batches:
            parts = []
            for text in batch.column("text"):
                for piece in chunks(text.as_py()):
                    tokens = piece.lower().split()
                    parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
                end = numbers[END] if end is None else end
                parts.append(np.array([end, -1]))
            if not parts:
                continue
            last = grams = np.concatenate(parts)
            for codes in kept:
                grams = _extended(grams, last, len(words))
                place = np.searchsorted(codes, grams)
                place[place == len(codes)] = 0
                grams = np.where((grams >= 0) & (codes[place] == grams), place, -1) if len(codes) else (
                    np.full(len(grams), -1))
                last = last[1:]
            codes = _extended(grams, last, len(words))
            if kept:
                codes = np.where(grams[1:] >= 0, codes, -1)
            found, n = np.unique(codes[codes >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _extended(grams: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Codes of grams[i] followed by last[i + 1]; -1 where either is missing."""
    a, b = grams[:len(last) - 1], last[1:]
    return np.where((a >= 0) & (b >= 0), a * base + b, -1)


@dataclass
class Automaton:
    """States are frequent n-grams; a state without an arc for a word goes on, at its weight, to
    the state of its n-gram without the first word (its failure arc), down to the root."""

    tokens: int
    vocabulary: int
    discount: float
    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    contexts: np.ndarray  # the context number of each of these words, or -1
    n_contexts: int
    arc_keys: np.ndarray  # state * n_contexts + word
    arc_logs: np.ndarray
    arc_targets: np.ndarray
    fail: np.ndarray
    weight: np.ndarray  # log10 of the backoff weight

    def unigram(self, count: float) -> float:
        """log10 probability without context; count 0: of any word not seen in training."""
        if not self.tokens:
            return 0.0
        return log10((count - self.discount if count else self.discount * self.vocabulary) / self.tokens)

    def base(self, count: float) -> float:
        return log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))


def build_automaton(
    totals: tuple[int, int, int, int], words: np.ndarray, counts: np.ndarray, context_least: float,
    grams: list[tuple[np.ndarray, np.ndarray]],
) -> Automaton:
    """``grams[k]``: sorted codes and counts of the kept n-grams of k + 2 words.

    Absolute discounting: an arc has (n - D) / n(context), and a context's weight shares what is
    left among all other words in proportion to the next shorter context, so each state's
    probabilities sum to 1. Words not seen in training share one event of D * V / N.
    """
    tokens, vocabulary, once, twice = totals
    discount = min(once / (once + 2 * twice), 0.9) if once else 0.5
    contexts = np.where(counts >= context_least, np.cumsum(counts >= context_least) - 1, -1)
    by_context = counts[contexts >= 0]
    k = len(by_context)
    unigrams = [(c - discount) / tokens for c in by_context.tolist()]
    fail, weight = [0] + [0] * k, [1.0] * (k + 1)
    totals_of: list[float] = [tokens, *by_context.tolist()]
    arcs: dict[int, tuple[float, int]] = {}
    number = list(range(1, k + 1))  # state of each kept n-gram of the length at hand

    def probability(state: int, word: int) -> float:
        chance = 1.0
        while state:
            if arc := arcs.get(state * k + word):
                return chance * arc[0]
            chance *= weight[state]
            state = fail[state]
        return chance * unigrams[word]

    for codes, ns in grams:
        following: dict[int, list[tuple[int, int, int]]] = {}
        for place, (code, n) in enumerate(zip(codes.tolist(), ns.tolist())):
            following.setdefault(number[code // k], []).append((code % k, n, place))
        states = [0] * len(codes)
        for state, successors in following.items():
            total, left, lower = totals_of[state], 1.0, 1.0
            found = {}
            for word, n, place in successors:
                chance = (n - discount) / total
                left -= chance
                lower -= probability(fail[state], word)
                # the longer n-gram is a state itself, which fails to its ending
                states[place] = len(fail)
                ending = arcs.get(fail[state] * k + word, (0, word + 1))[1] if fail[state] else word + 1
                fail.append(ending)
                weight.append(1.0)
                totals_of.append(n)
                found[state * k + word] = (chance, states[place])
            arcs.update(found)
            weight[state] = max(left, 1e-12) / max(lower, 1e-12)
        number = states
    keys = np.array(sorted(arcs), np.int64)
    return Automaton(
        tokens, vocabulary, discount, words, counts, contexts, k, keys,
        np.log10([arcs[key][0] for key in keys.tolist()]) if len(keys) else np.empty(0),
        np.array([arcs[key][1] for key in keys.tolist()], np.int64),
        np.array(fail), np.log10(weight))


class Scorer:
    """Reads texts from left to right, carrying a state of the automaton."""

    def __init__(self, automaton: Automaton):
        a = self.automaton = automaton
        k = max(a.n_contexts, 1)
        self.arcs: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(a.fail))]
        for key, log, target in zip(a.arc_keys.tolist(), a.arc_logs.tolist(), a.arc_targets.tolist()):
            self.arcs[key // k][key % k] = (log, target)
        self.fail, self.weight = a.fail.tolist(), a.weight.tolist()
        self.to_root = [0.0] * len(self.fail)
        for state in range(1, len(self.fail)):  # a failure arc leads to an earlier length
            at = state
            while at:
                self.to_root[state] += self.weight[at]
                at = self.fail[at]
        self.numbers = _Numbers(a.words)
        self.facts: dict[bytes, tuple[float, float, int] | None] = {}

    def _learn(self, word: bytes) -> tuple[float, float, int] | None:
        a, at = self.automaton, self.numbers[word]
        if len(self.facts) > FLUSH_WORDS * 4:
            self.facts.clear()
        fact = None if at < 0 else (
            a.unigram(float(a.counts[at])), a.base(float(a.counts[at])), int(a.contexts[at]))
        self.facts[word] = fact
        return fact

    def of(self, data: bytes) -> tuple[int, int, float, float, Counter]:
        """(tokens, frequent tokens, base score, score, the rest): the scores lack the unigram
        terms of the rest, tokens that are not frequent; these are looked up by a join."""
        facts, arcs, fail, weight, to_root = self.facts, self.arcs, self.fail, self.weight, self.to_root
        score = base = 0.0
        state = n = 0
        rest: Counter = Counter()
        for piece in (*chunks(data), None):
            tokens = [END] if piece is None else piece.lower().split()
            n += len(tokens)
            for token in tokens:
                fact = facts.get(token, 0)
                if fact == 0:
                    fact = self._learn(token)
                if fact is None:
                    rest[token] += 1
                    score += to_root[state]
                    state = 0
                    continue
                base += fact[1]
                word = fact[2]
                if word < 0:
                    score += to_root[state] + fact[0]
                    state = 0
                    continue
                while state:
                    arc = arcs[state].get(word)
                    if arc:
                        score += arc[0]
                        state = arc[1]
                        break
                    score += weight[state]
                    state = fail[state]
                else:
                    score += fact[0]
                    state = word + 1
        return n, n - sum(rest.values()), base, score, rest


def train(
    texts: DataFrame, order: int = 3, word_share: float = WORD_SHARE,
    context_share: float = CONTEXT_SHARE, gram_share: float = GRAM_SHARE,
) -> tuple[Automaton, DataFrame]:
    """An automaton and the staged table (h, c) of all word counts, from a column ``text`` of
    bytes. Only totals and what the shares bound reach the driver."""
    words = stage(count_words(texts), "lm-words")
    row = words.agg(
        F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    totals = (row[0] or 0, *row[1:])
    tokens = totals[0]
    frequent = words.where(F.col("c") >= word_share * tokens).toArrow().sort_by("h")
    hashes, counts = np.array(frequent["h"], np.int64), np.array(frequent["c"], np.int64)
    contexts = hashes[counts >= context_share * tokens]
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(order - 1):
        found = count_grams(texts, contexts, [codes for codes, _ in grams]).where(
            (F.col("n") >= gram_share * tokens) & (F.col("n") > 1)).toArrow().sort_by("code")
        if not len(found):
            break
        grams.append((np.array(found["code"], np.int64), np.array(found["n"], np.int64)))
    return build_automaton(totals, hashes, counts, context_share * tokens, grams), words


def text_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, doc_id, held_out, tokens, lengths, words, seq) of about BLOCK_TOKENS tokens
    from columns ``doc_id``, ``held_out`` and ``text`` (bytes): the sorted hashes of a block's distinct
    words and how often each is there, and each token's word by its place in the order of frequency,
    which takes less room. Each text has its end, none is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, ids, held, parts, size = WordHashes(lower=True), [], [], [], 0

        def made() -> pa.RecordBatch:
            words, seq = _numbered(np.concatenate(parts))
            times = np.bincount(seq)
            place = np.empty(len(words), np.int32)
            place[_by_frequency(times)] = np.arange(len(words))
            return pa.RecordBatch.from_arrays([
                pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([size]),
                pa.array([_packed(np.array([len(part) for part in parts]))]), pa.array([_packed(_gaps(words), times)]),
                pa.array([_packed(place[seq])]),
            ], names=["doc_id", "held_out", "tokens", "lengths", "words", "seq"])

        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"))
            for doc, out, text in rows:
                ids.append(doc)
                held.append(out)
                parts.append(np.append(maker.of(text.as_py()), END_HASH))
                size += len(parts[-1])
                if size > BLOCK_TOKENS:
                    yield made()
                    ids, held, parts, size = [], [], [], 0
        if parts:
            yield made()

    made = docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id array<long>, held_out array<boolean>, tokens long, lengths binary, words binary, seq binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def _by_frequency(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times, kind="stable")


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, compressed by byte planes: the high bytes of small numbers take next to
    nothing."""
    data = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    size, widths = int.from_bytes(data[:8], "little"), [np.dtype(kind).itemsize for kind in kinds]
    if not size:
        return [np.empty(0, kind) for kind in kinds]
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8).reshape(sum(widths), -1)
    return [
        np.ascontiguousarray(part.T).view(kind).ravel()
        for part, kind in zip(np.split(planes, np.cumsum(widths)[:-1]), kinds)]


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted 64-bit keys; their running sum is the keys again."""
    gaps = keys.copy()
    gaps[1:] -= keys[:-1]
    return gaps


def _keys(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


@dataclass
class Level:
    """The n-grams of one length in a block. Those with a shorter n-gram that does not occur twice in
    training are left out, as they cannot either."""

    keys: np.ndarray  # sorted, distinct
    at: np.ndarray  # by place of the last word: number in ``keys``, or -1
    n: np.ndarray  # in all of training; 0 for an n-gram of two words or more that does not occur twice
    first: np.ndarray  # of all blocks that have the n-gram, this one adds it to its state
    back: np.ndarray  # log10 of the backoff weight as a context


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], and 0 where ``at`` is -1."""
    return np.append(values, values.dtype.type(0))[at]


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts 64-bit keys, and the sorted keys. The place of a key replaces its low bits, so
    that one sort of numbers does; keys that differ in these bits only are sorted again."""
    low = (np.uint64(1) << np.uint64(len(keys).bit_length())) - np.uint64(1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys)
        found = keys[order]
    return order, found


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the number of each key in them."""
    order, keys = _sorted(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[new], number


def _levels(block: dict, answers: pa.Table, size: int) -> tuple[np.ndarray, list[Level]]:
    """The text of each token and the n-grams of 1 to ``size`` words, with what is answered so far."""
    known: dict[tuple[bool, int], list[np.ndarray]] = {}
    for row in sorted(answers.to_pylist(), key=lambda row: row["bucket"]):
        known.setdefault((row["back"], row["k"]), []).extend(
            _unpacked(row["data"], np.float64 if row["back"] else np.int64))
    lengths, = _unpacked(block["lengths"], np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    gaps, times = _unpacked(block["words"], np.uint64, np.int64)
    words = _keys(gaps)
    seq = _by_frequency(times)[_unpacked(block["seq"], np.int32)[0]]
    hashes, levels = words[seq], []
    for k in range(1, size + 1):
        keys, at = words, seq
        if k > 1:
            kept = _take(levels[-1].n, levels[-1].at) > 1
            there = np.zeros(len(seq), bool)
            there[k - 1:] = kept[k - 2:-1] & kept[k - 1:] & (owner[:1 - k] == owner[k - 1:])
            keys, number = _numbered(windows(hashes, k)[there[k - 1:]])
            at = np.full(len(seq), -1)
            at[there] = number
        n = np.concatenate([np.empty(0, np.int64), *known.get((False, k), [])])
        level = Level(keys, at, n >> 1, (n & 1) > 0, np.zeros(len(keys)))
        if (True, k) in known:
            level.back[level.n > 1] = np.concatenate(known[True, k])
        levels.append(level)
    return owner, levels


def _asked(block: int, k: int, bits: int, keys: np.ndarray, *columns: np.ndarray) -> list[dict]:
    """A row for each bucket, i.e. value of the first ``bits`` bits, that has some of the sorted keys."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *edges.tolist(), len(keys)]
    return [
        {"block": block, "k": k, "bucket": bucket,
         "data": _packed(_gaps(keys[start:end]), *(column[start:end] for column in columns))}
        for bucket, (start, end) in enumerate(zip(edges, edges[1:])) if start < end]


def _table(asked: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(asked, pa.schema([
        ("block", pa.int64()), ("k", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())]))


def _answered(asked: pa.Table, back: bool, data: list[bytes]) -> pa.Table:
    return pa.table({name: asked[name] for name in ("block", "k", "bucket")} | {
        "back": pa.array([back] * len(data), pa.bool_()), "data": pa.array(data, pa.binary())})


def _met(asked: pa.Table, *kinds: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the rows of one bucket: where each row's keys end, all keys sorted, the order that sorts them,
    where each distinct key starts in it, and the columns, all rows' one after the other."""
    rows = [_unpacked(data.as_py(), np.uint64, *kinds) for data in asked["data"]]
    order, keys = _sorted(np.concatenate([_keys(row[0]) for row in rows]))
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.cumsum([len(row[0]) for row in rows]), keys, order, starts, [
        np.concatenate(column) for column in list(zip(*rows))[1:]]


def _by_row(order: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of its distinct key for each key, in the order of the rows."""
    found = np.empty(len(order), values.dtype)
    found[order] = np.repeat(values, np.diff(np.append(starts, len(order))))
    return found


def gram_counts(blocks: DataFrame, answers: DataFrame, k: int, bits: int) -> DataFrame:
    """Answers (block, k, bucket, back, data) with the counts in training of each block's n-grams of
    ``k`` words, doubled, and 1 more in one of the blocks; one row of each bucket has its totals.

    A block asks with its distinct n-grams, once each however frequent, and is answered in their
    order: what is learned is all that occurs twice, and none of it leaves Spark.
    """

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for row in block.to_pylist():
            owner, levels = _levels(row, answers, k)
            level = levels[-1]
            training = ~np.array(row["held_out"], bool)[owner] & (level.at >= 0)
            made += _asked(row["block"], k, bits, level.keys, np.bincount(level.at[training], minlength=len(level.keys)))
        return _table(made)

    def count(asked: pa.Table) -> pa.Table:
        ends, _, order, starts, (n,) = _met(asked, np.int64)
        total = np.add.reduceat(n[order], starts)
        totals = [int(x) for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]
        if k > 1:
            total[total < 2] = 0
        found = _by_row(order, starts, total * 2)
        found[order[starts[total > 1]]] += 1
        made = _answered(asked, False, [_packed(x) for x in np.split(found, ends[:-1])])
        for name, x in zip(("tokens", "words", "once", "twice"), totals):
            made = made.append_column(name, pa.array([x, *[None] * (len(ends) - 1)], pa.int64()))
        return made

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED).groupBy(
        "bucket").applyInArrow(count, f"{ANSWER}, tokens long, words long, once long, twice long")


def _logs(levels: list[Level], discount: float, tokens: int, unseen: float) -> list[np.ndarray]:
    """log10 probabilities after their context of the n-grams of each length; 0 if not kept."""
    logs = []
    for k, level in enumerate(levels):
        of = np.full(len(level.keys), tokens)
        if k:
            of = levels[k - 1].n[_ends(level, levels[k - 1])[0]]
        log, kept = np.full(len(level.keys), 0.0 if k else unseen), level.n > 0
        log[kept] = np.log10((level.n[kept] - discount) / of[kept])
        logs.append(log)
    return logs


def _ends(level: Level, below: Level) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each n-gram without its last and without its first word."""
    there = np.flatnonzero(level.at >= 0)
    place = np.empty(len(level.keys), np.int64)
    place[level.at[there]] = there
    return below.at[place - 1], below.at[place]


def gram_backoffs(
    blocks: DataFrame, answers: DataFrame, order: int, bits: int, totals: tuple[int, int, int, int]
) -> DataFrame:
    """Rows (k, bucket, data): the keys and backoff weights of all words and n-grams of k words that a kept
    n-gram continues.

    The weight of a context shares what absolute discounting leaves of its count among all words that
    do not follow it in a kept n-gram, in proportion to the next shorter context. Each kept n-gram
    is added to its context by one block.
    """
    tokens, discount, unseen = totals[0], _discount(totals), _unseen(totals)

    def add(block: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for row in block.to_pylist():
            levels = _levels(row, answers, order)[1]
            logs = _logs(levels, discount, tokens, unseen)
            for k in range(1, order):
                level, below = levels[k], levels[k - 1]
                prefix, suffix = (numbers[level.first] for numbers in _ends(level, below))
                states, number = np.unique(prefix, return_inverse=True)
                made += _asked(
                    row["block"], k, bits, below.keys[states], below.n[states],
                    np.bincount(number, level.n[level.first], len(states)).astype(np.int64),
                    np.bincount(number, minlength=len(states)),
                    np.bincount(number, 10.0 ** logs[k - 1][suffix], len(states)))
        return _table(made)

    def weigh(added: pa.Table) -> pa.Table:
        _, keys, order, starts, columns = _met(added, np.int64, np.int64, np.int64, np.float64)
        total, arcs, mass = (np.add.reduceat(column[order], starts) for column in columns[1:])
        left, lower = 1 - (total - arcs * discount) / columns[0][order[starts]], 1 - mass
        back = np.log10(np.maximum(left, 1e-12) / np.maximum(lower, 1e-12))
        return pa.table({name: added[name][:1] for name in ("k", "bucket")} | {
            "data": pa.array([_packed(_gaps(keys[starts]), back)])})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, ASKED).groupBy(
        "k", "bucket").applyInArrow(weigh, "k int, bucket int, data binary")


def with_backoffs(blocks: DataFrame, answers: DataFrame, weights: DataFrame, order: int, bits: int) -> DataFrame:
    """``answers`` and those with the weights of the words and n-grams of ``blocks``; 0 if nothing kept
    follows."""

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for row in block.to_pylist():
            for k, level in enumerate(_levels(row, answers, order - 1)[1], 1):
                made += _asked(row["block"], k, bits, level.keys[level.n > 1])
        return _table(made)

    def look_up(asked: pa.Table, weights: pa.Table) -> pa.Table:
        made, keys, back = [], np.empty(0, np.uint64), np.empty(0)
        for data in weights["data"]:  # one or none
            gaps, back = _unpacked(data.as_py(), np.uint64, np.float64)
            keys = _keys(gaps)
        for data in asked["data"]:
            wanted = _keys(*_unpacked(data.as_py(), np.uint64))
            at = np.searchsorted(keys, wanted)
            there = _take(keys, np.where(at < len(keys), at, -1)) == wanted
            made.append(_packed(np.where(there, _take(back, np.where(there, at, -1)), 0.0)))
        return _answered(asked, True, made)

    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED).groupBy(
        "k", "bucket").cogroup(weights.groupBy("k", "bucket")).applyInArrow(look_up, ANSWER)
    return answers.unionByName(found)


def _discount(totals: tuple[int, int, int, int]) -> float:
    _, _, once, twice = totals
    return min(once / (once + 2 * twice), 0.9) if once else 0.5


def _unseen(totals: tuple[int, int, int, int]) -> float:
    """log10 probability of any word not seen in training."""
    return log10(_discount(totals) * totals[1] / totals[0]) if totals[0] else 0.0


def score_texts(blocks: DataFrame, answers: DataFrame, order: int, totals: tuple[int, int, int, int]) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, base_score, score) of the texts of all blocks. A token
    has the probability of the longest kept n-gram that ends with it, times the weights of the longer contexts."""
    tokens, vocabulary = totals[:2]
    discount, unseen, smooth = _discount(totals), _unseen(totals), tokens + 0.5 * (vocabulary + 1)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for position, row in enumerate(block.to_pylist()):
            owner, levels = _levels(row, answers, order)
            logs, texts = _logs(levels, discount, tokens, unseen), len(row["doc_id"])
            words = levels[0]
            score = logs[0][words.at]
            for below, level, log in zip(levels, levels[1:], logs[1:]):
                follows = owner[1:] == owner[:-1]
                score[1:][follows] += _take(below.back, below.at)[:-1][follows]
                kept = _take(level.n, level.at) > 0
                score[kept] = log[level.at[kept]]
            made.append(pa.table({
                "doc_id": block["doc_id"][position].values, "held_out": block["held_out"][position].values,
                "n_tokens": pa.array(np.bincount(owner, minlength=texts)),
                "n_known": pa.array(np.bincount(owner, words.n[words.at] > 0, texts).astype(np.int64)),
                "base_score": pa.array(np.bincount(owner, np.log10((words.n + 0.5) / smooth)[words.at], texts)),
                "score": pa.array(np.bincount(owner, score, texts))}))
        return pa.concat_tables(made)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(
    docs: DataFrame, held_out: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text",
    word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE,
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), trained on the
    documents that are not ``held_out``.

    Every word is a context, and every n-gram that occurs twice in training is learned, whatever
    its share; the shares are of no effect, as nothing is broadcast. Tokens are words in
    lower-cased A-Z and one end. Null text is empty: one token. Null ids, ties and repeated rows
    are scored each; without training documents every probability is 1. Other columns are not
    read. No rows: no rows.
    """
    spark = docs.sparkSession
    blocks = stage(text_blocks(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        text_bytes(text_col).alias("text"))), "lm-blocks")
    size = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(6, (size // BUCKET_KEYS).bit_length())
    answers = spark.createDataFrame([], ANSWER)
    totals = (0, 0, 0, 0)
    for k in range(1, order + 1):
        counts = stage(gram_counts(blocks, answers, k, bits), "lm-counts")
        answers = answers.unionByName(counts.select(*answers.columns))
        if k == 1:
            totals = tuple(x or 0 for x in counts.agg(*map(F.sum, ("tokens", "words", "once", "twice"))).first())
        if not totals[0]:
            break
    weights = stage(gram_backoffs(blocks, answers, order, bits, totals), "lm-backoffs") if totals[0] else None
    slices = max(1, min(SLICES, size // BLOCK_TOKENS))
    scores = []
    for k in range(slices):
        some, known = (x.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == k) for x in (blocks, answers))
        if weights is not None:
            known = with_backoffs(some, known, weights, order, bits)
        scores.append(stage(score_texts(some, known, order, totals), "lm-scores"))
    return reduce(DataFrame.unionByName, scores).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"),
        "base_score", "score")


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under a trigram automaton, four fifths of them in training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
