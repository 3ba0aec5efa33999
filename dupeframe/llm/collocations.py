"""Operator 12: phrase collocations, counted in a dictionary of content-triggered chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from dupeframe.llm.words import WordHashes, mixed, text_bytes
from dupeframe.staging import global_index, stage

MOST_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: A window of MOST_WORDS - 1 words ends a chunk if its checksum is divisible by this.
TRIGGER = 32
# Characters that end a piece, and those that stand between words.
PIECE_ENDS, WORD_GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TO_GAPS = bytes.maketrans(PIECE_ENDS + WORD_GAPS, b"\n" * len(PIECE_ENDS) + b" " * len(WORD_GAPS))
_HELD = 1 << 19  # distinct entries that a task holds before it hands them on
_BYTES = 1 << 22  # of chunks that a task hashes at once
_SALTS = 64  # parts of a language where its rows meet its total
MAP_BITS = (20, 28)  # of a map of frequent grams: its size follows their number between these


# -- parsing -----------------------------------------------------------------------------------


def parse(words: list[bytes], most_words: int = MOST_WORDS, trigger: int = TRIGGER) -> Iterator[tuple[int, int, int]]:
    """Chunks (first word, end, owned) of a piece.

    Windows of most_words - 1 words with a checksum divisible by ``trigger`` cut the piece, if it has
    more words than ``trigger``: a chunk runs from the start of one such window to the end of the next, so neighbours share just that window, and
    what a chunk is depends on its own words only. A phrase of up to ``most_words`` words belongs
    to the chunk that owns its first word: every word but those of the closing window, which the next chunk
    owns, or all words of the last chunk.
    """
    shared = most_words - 1
    first, last = 0, len(words) - shared if len(words) > trigger else 0
    for at in range(1, last):  # a window at the very end would own nothing more than its words
        if crc32(b" ".join(words[at:at + shared])) % trigger == 0:
            yield first, at + shared, at - first
            first = at
    yield first, len(words), len(words) - first


def chunk_dictionary(docs: DataFrame, most_words: int = MOST_WORDS, trigger: int = TRIGGER,
                     text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, chunk, owned, times, number): the distinct chunks of all texts, with A-Z lowered and
    words one space apart, how often the parse has them, and a hash as their number.

    Null texts are empty and have none; a null lang is ``und``. Equal chunks are added up in the
    task, then by Spark. Only the two columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(
                    pa.string()),
                pa.array([k[2] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64()),
            ], names=["lang", "chunk", "owned", "times"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                for piece in text.as_py().lower().translate(_TO_GAPS).split(b"\n"):
                    words = piece.split()
                    if len(words) <= trigger:
                        if words:
                            found[lang, b" ".join(words), len(words)] += 1
                    else:
                        for first, end, owned in parse(words, most_words, trigger):
                            found[lang, b" ".join(words[first:end]), owned] += 1
                if len(found) > _HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()

    read = docs.select(text_bytes(text_col).alias("text"), F.coalesce(
        F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return read.mapInArrow(run, "lang string, chunk string, owned int, times long").groupBy(
        "lang", "chunk", "owned").agg(F.sum("times").alias("times")).withColumn("number", F.hash("lang", "chunk"))


# -- counting in distinct chunks ---------------------------------------------------------------


class _Chunks:
    """The words of many chunks as one array of hashes that also hold the language."""

    def __init__(self):
        self.hashes, self.langs = WordHashes(), {}
        # the gaps of chunks are single spaces; other control characters belong to words
        self.hashes.gap = np.zeros(256, bool)
        self.hashes.gap[[0x20, 0x0A]] = True

    def of_lang(self, lang: str) -> int:
        if lang not in self.langs:
            self.langs[lang] = int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")
        return self.langs[lang]

    def read(self, langs: list[str], chunks: list[str], counts: np.ndarray | int) -> np.ndarray:
        """Hashes of all words in order, for chunks of ``counts`` words."""
        found = self.hashes.of("\n".join(chunks).encode())
        own = np.array([self.of_lang(lang) for lang in langs], np.uint64)
        return mixed(found ^ np.repeat(own, counts))


class _Slice:
    """Some chunks of the dictionary: the hashes of all their words, one after the other, and the places
    at which phrases of any size start."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs, self.chunks = batch.column("lang").to_pylist(), batch.column("chunk").to_pylist()
        owned, self.times, self.numbers = (batch.column(k).to_numpy() for k in ("owned", "times", "number"))
        self.counts = pc.count_substring(batch.column("chunk"), " ").to_numpy().astype(np.int64) + 1
        self.first = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.mine = np.arange(len(self.owner)) - self.first[self.owner] < owned[self.owner]

    def hashes(self, reader: _Chunks) -> np.ndarray:
        return reader.read(self.langs, self.chunks, self.counts)

    def starts(self, size: int) -> np.ndarray:
        """True where ``size`` words of one chunk start with a word that it owns."""
        count = max(0, len(self.owner) - size + 1)
        return self.mine[:count] & (self.owner[:count] == self.owner[size - 1:])


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place: of its word and the size - 1 after it."""
    value = hashes[:max(0, len(hashes) - size + 1)].copy()
    for k in range(1, size):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(value)])
    return value


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where a hash is in the map (or, by chance, shares its bit)."""
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _slices(batch: pa.RecordBatch) -> Iterator[_Slice]:
    """The chunks of a batch, of about ``_BYTES`` bytes at a time."""
    sizes, at = np.cumsum(pc.binary_length(batch.column("chunk")).to_numpy().astype(np.int64)), 0
    while at < len(sizes):
        start = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, start + _BYTES)))
        yield _Slice(batch.slice(at, end - at))
        at = end


def frequent_map(hashes: DataFrame, number: int) -> np.ndarray:
    """A map of 64-bit ``hashes`` (one column of distinct longs), as bytes of bits.

    It has 1024 bits for each of ``number`` hashes, within the powers of two of ``MAP_BITS``, so it
    is 32 MiB at most; a fuller map only lets more pass that is counted in vain.
    """
    power = min(max(MAP_BITS[0], (1024 * max(number, 1)).bit_length()), MAP_BITS[1])
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << power) - 1))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, int({hashes.columns[0]} & 63)))").alias("bits")).toArrow()
    found = np.zeros(1 << (power - 6), np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint8)


def _word_hashes(words: DataFrame) -> DataFrame:
    """The hash of each (lang, phrase) of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Chunks()
        for batch in batches:
            hashes = reader.read(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), 1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    return words.select("lang", "phrase").mapInArrow(run, "hash long")


def _gram_counts(dictionary: DataFrame, sizes: range, marks, marked_size: int) -> DataFrame:
    """Rows (hash, a, chunk) of the phrases of ``sizes`` words whose every ``marked_size`` neighbouring words
    are in the map ``marks``: how often they occur, and the number of a chunk that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bits, kept, held = _Chunks(), marks.value, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(column)) for column in zip(*kept)]
            table = pa.table(columns, names=["hash", "a", "chunk"]).group_by("hash", use_threads=False).aggregate(
                [("a", "sum"), ("chunk", "min")])
            return pa.RecordBatch.from_arrays(
                [table.column(name).combine_chunks() for name in ("hash", "a_sum", "chunk_min")],
                names=["hash", "a", "chunk"])

        for batch in batches:
            for part in _slices(batch):
                hashes = part.hashes(reader)
                known = _marked(bits, _grams(hashes, marked_size))
                for size in sizes:
                    starts = part.starts(size)
                    for k in range(size - marked_size + 1):
                        starts &= known[k:k + len(starts)]
                    at = np.flatnonzero(starts)
                    if len(at):
                        owner = part.owner[at]
                        kept.append((_grams(hashes, size)[at].view(np.int64), part.times[owner], part.numbers[owner]))
                        held += len(at)
                if held > 8 * _HELD:
                    yield out()
                    kept, held = [], 0
        if held:
            yield out()

    return dictionary.mapInArrow(run, "hash long, a long, chunk int").groupBy("hash").agg(
        F.sum("a").alias("a"), F.min("chunk").alias("chunk"))


def _with_texts(grams: DataFrame, dictionary: DataFrame, most_words: int) -> DataFrame:
    """The ``grams`` (hash, a, chunk) with lang, phrase and words, from the chunk that each names."""

    def entries(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return mixed(hashes.view(np.uint64) ^ (numbers.view(np.uint32).astype(np.uint64) << np.uint64(32)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, numbers = batch.column("hash").to_numpy(), batch.column("chunk").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries(hashes, numbers).view(np.int64))], names=["entry"])

    count, context = grams.count(), grams.sparkSession.sparkContext
    marks = context.broadcast((
        frequent_map(grams.select(F.xxhash64("chunk").alias("number")), count),
        frequent_map(grams.select("hash", "chunk").mapInArrow(enter, "entry long"), count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (named, entered) = _Chunks(), marks.value
        for batch in batches:
            wanted = _marked(named, batch.column("key").to_numpy().view(np.uint64))
            for part in _slices(batch.filter(pa.array(wanted))):
                hashes, rows = part.hashes(reader), []
                for size in range(2, most_words + 1):
                    own, at = _grams(hashes, size), np.flatnonzero(part.starts(size))
                    at = at[_marked(entered, entries(own[at], part.numbers[part.owner[at]]))]
                    for place, c in zip(at.tolist(), part.owner[at].tolist()):
                        first = place - int(part.first[c])
                        phrase = " ".join(part.chunks[c].split(" ")[first:first + size])
                        rows.append((int(own[place].view(np.int64)), part.langs[c], phrase, size))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int32()))],
                        names=["hash", "lang", "phrase", "words"])

    texts = dictionary.withColumn("key", F.xxhash64("number")).mapInArrow(
        run, "hash long, lang string, phrase string, words int").groupBy("hash").agg(
        F.min(F.struct("lang", "phrase", "words")).alias("text"))
    found = stage(grams.join(texts, "hash").select("text.*", "a"), "phrases")
    marks.unpersist()
    return found


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS,
                  trigger: int = TRIGGER, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): rows (lang, phrase, words, a) of all phrases of 1 to ``most_words`` words that
    occur ``min_count`` times or more in a language, and rows (lang, n) of its word occurrences.

    Everything is counted inside the distinct chunks of ``chunk_dictionary``, weighted by how often the
    parse has them. A frequent phrase has frequent parts only, so counting goes up in steps: words by
    their text; two and three words in a row that are all in a map of the frequent words; more
    words whose every three are in a map of the frequent threes. Maps rule out only what cannot be
    frequent. Phrases of several words are counted by a 64-bit hash of their language and words; of each
    frequent one a chunk is known that has it, and its text is read there once. No text is
    shuffled but the dictionary.
    """
    context = docs.sparkSession.sparkContext
    dictionary = stage(chunk_dictionary(docs, most_words, trigger, text_col, lang_col), "chunks")
    words = stage(dictionary.select(
        "lang", F.explode(F.slice(F.split("chunk", " "), F.lit(1), F.col("owned"))).alias("phrase"), "times").groupBy(
        "lang", "phrase").agg(F.sum("times").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.where(F.col("a") >= min_count)
    marks = context.broadcast(frequent_map(_word_hashes(frequent), frequent.count()))
    often = F.col("a") >= min_count
    grams = stage(_gram_counts(dictionary, range(2, min(3, most_words) + 1), marks, 1).where(often), "grams")
    marks.unpersist()
    if most_words > 3:  # the map of twos and threes has the threes
        marks = context.broadcast(frequent_map(grams.select("hash"), grams.count()))
        longer = _gram_counts(dictionary, range(4, most_words + 1), marks, 3).where(often)
        grams = stage(grams.unionByName(longer), "grams")
        marks.unpersist()
    phrases = _with_texts(grams, dictionary, most_words)
    return phrases.unionByName(frequent.select("lang", "phrase", F.lit(1).alias("words"), "a")), totals


# -- scores ------------------------------------------------------------------------------------


def _part(first: Column, count: Column) -> Column:
    """``count`` words of a phrase from word ``first`` (from 1)."""
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def _with_lang(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with their language's one row of ``table``, which stands once for each of ``_SALTS``
    parts, so that a large language is not one task."""
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int")).join(
        repeated, ["lang", "_salt"]).drop("_salt")


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP, inside_percent: int = 100) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and more words.

    A cut after k words gives floor(1000 a n / (l r)) from the counts l and r of its parts; the
    lowest cut counts, ties to the smallest k. Products have 38 decimal digits. A phrase goes if
    a longer one that holds it has ``inside_percent`` of its count; as counts fall with length, the
    phrases with one word more decide that. Ranks come from a range sort by lang, falling score
    and count, and the phrase's bytes, and from a global index, so no language is one task.
    """
    several = phrases.where("words > 1")
    held = several.where("words > 2").select("lang", "a", F.explode(F.array(
        _part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longest = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    # the joins' keys are distinct phrases: none is hot
    kept = several.join(longest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(inside_percent) * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(
        F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"),
        _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    joined = _with_lang(cuts.join(counts.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"]).join(
        counts.withColumnsRenamed({"part": "tail", "times": "r"}), ["lang", "tail"]), totals)
    score = F.expr("(CAST(1000 * a AS DECIMAL(20,0)) * CAST(n AS DECIMAL(17,0)))"
                   " div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    best = joined.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    sortable = best.withColumns({"_down": -F.col("score"), "_rare": -F.col("a")})
    indexed = global_index(sortable, ["lang", "_down", "_rare", "phrase"], "place")[0]
    starts = indexed.groupBy("lang").agg(F.min("place").alias("start"))
    return _with_lang(indexed, starts).withColumn("rank", (F.col("place") - F.col("start") + 1).cast("long")).where(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The phrases of all documents, by language."""
    return collocations(*phrase_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
sized AS (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM starts),
f AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a
  FROM sized WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 100),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS m FROM often WHERE k > 2)) GROUP BY ALL),
kept AS (
  SELECT o.* FROM often o LEFT JOIN inside i USING (lang, phrase)
  WHERE o.k > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * o.a)),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, x.a AS l, y.a AS r, n.n,
         ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN n ON n.lang = c.lang),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""
