"""Operator 4: exact Jaccard join of word shingles by pivots and triangle-inequality windows.

The Jaccard distance d = 1 - J is a metric, and two documents link if d <= r. Pivots taken from
the whole corpus cannot part it: nearly every document has distance 1 to nearly every other, so
the windows d(x, q) <= d(x, p) + 2r would copy all documents to all pivots. Regions are therefore
made where distances are below 1: of x's shingles in one global order, a prefix of n - need + 1
must meet the prefix of anything within r, so each prefix shingle is a region and a document is
copied to the regions of its prefix only. The order is rare shingles first. Inside a region:

1. a pivot is taken and compared with every member; links join components;
2. a region within one component is done; what is left of the others takes the next pivot, for
   ``rounds`` rounds;
3. then the members outside a region's first component are compared with all the others, if
   their distances to the pivot differ by r at most (the triangle inequality).

Comparisons pass three bounds of the distance before whole sets are fetched: sizes, places of the
shared shingle in both prefixes, and the Hamming distance of parity sketches, which is at most
the number of shingles in one set only. Every pair within r meets in a region, and a pair is
passed over only if it is in one component already or a bound rules it out, so components are
exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dupeframe.llm.words import WordHashes, shingles, text_bytes
from dupeframe.staging import stage

SHINGLE_WORDS = 5
PERCENT = 80
# Shingles in more prefixes than this come last in the order. The flag is one of 2 ** BITS bits of
# a map that is broadcast, 8 MiB whatever the corpus; any map gives a valid order.
COMMON = 8
BITS = 26
PIVOT_ROUNDS = 1
# Regions of a member, the first ones by place, that go with it into the last join: a pair that shares
# some of them leaves it in the first of these only.
HEAD = 8
# Pivots of a region of a common shingle in the first round.
PIVOTS = 8
# Pivots that any region of more than ``common`` members has besides, from the middle of its groups.
MIDDLE_PIVOTS = 2


def _prefix_length(n: int, percent: int) -> int:
    """A set of n shares at least ceil(percent * n / 100) with anything it links to."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def bit_map(spots: DataFrame) -> np.ndarray:
    """The distinct values of the one column (0 to 2 ** BITS - 1) as a map of 64-bit words; at
    most 2 ** (BITS - 6) rows reach the driver."""
    name = spots.columns[0]
    rows = spots.groupBy(F.shiftright(name, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, int({name} & 63)))").alias("bits")
    ).toArrow()
    found = np.zeros(1 << (BITS - 6), np.uint64)
    found[np.array(rows["word"], np.int64)] = np.array(rows["bits"], np.int64).view(np.uint64)
    return found


def _has(found: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (found[spots >> np.uint64(6)] >> (spots & np.uint64(63))) & np.uint64(1) > 0


_SPOT = np.uint64((1 << BITS) - 1)


def common_shingles(texts: DataFrame, size: int, percent: int, common: int) -> np.ndarray:
    """The map of shingles that stand in more than ``common`` prefixes in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(lower=True)
        for batch in batches:
            parts = [np.empty(0, np.uint64)]
            for text in batch.column("text"):
                own = shingles(hashes.of(text.as_py()), size)
                parts.append(own[:_prefix_length(len(own), percent)])
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return bit_map(counts.where(F.col("n") > common).select(
        F.col("h").bitwiseAND(F.lit(int(_SPOT))).alias("spot")))


def _digest(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """One bit for each place that a hash can fall on, set if an odd number does; twice as many places
    as the next power of two, 64 at least."""
    places = max(64, 2 << (len(own) - 1).bit_length()) if len(own) else 64
    hits = np.bincount((own >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_distance(x: np.ndarray, y: np.ndarray) -> int:
    """At most the size of the symmetric difference; the longer sketch is folded."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def described(texts: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """Rows (row_id, doc_id, text_hash, n, digest, spot, rare, frequent, sketch) of all texts: the
    size and a digest of each set, and the hashes of its prefix, rare and common ones apart."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, common = WordHashes(lower=True), shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own = shingles(hashes.of(text.as_py()), size)
                length = _prefix_length(len(own), percent)
                often = _has(common, own & _SPOT)
                rare = own[~often][:length]
                digest = _digest(own) if len(own) else None
                rows.append((
                    len(own), digest, int.from_bytes(digest[:4], "little") & int(_SPOT) if digest else None,
                    rare.view(np.int64), own[often][:length - len(rare)].view(np.int64),
                    parity_sketch(own).view(np.int64)))
            columns = list(zip(*rows)) or [()] * 6
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"),
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                pa.array(columns[2], pa.int64()), pa.array(columns[3], long_list), pa.array(columns[4], long_list),
                pa.array(columns[5], long_list),
            ], names=["doc_id", "text_hash", "n", "digest", "spot", "rare", "frequent", "sketch"])

    return texts.mapInArrow(
        run, "doc_id long, text_hash long, n long, digest binary, spot long, rare array<long>, "
        "frequent array<long>, sketch array<long>").withColumn("row_id", F.monotonically_increasing_id())


def sets_of(texts: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """Rows (digest, shingles) of the sets whose spot is in ``wanted``, each once."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted, done = WordHashes(lower=True), shared.value, set()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own = shingles(hashes.of(text.as_py()), size)
                if len(own):
                    digest = _digest(own)
                    spot = np.array([int.from_bytes(digest[:4], "little")], np.uint64) & _SPOT
                    if digest not in done and _has(wanted, spot)[0]:
                        rows.append((digest, own.tobytes()))
                        done.add(digest)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
            ], names=["digest", "shingles"])

    return texts.select("text").mapInArrow(run, "digest binary, shingles binary").groupBy("digest").agg(
        F.first("shingles").alias("shingles"))


def _may_link(n: Column, at: Column, other_n: Column, other_at: Column, percent: int) -> Column:
    """Whether sizes, and what can follow a shared shingle at these places of both prefixes, allow
    a link. A pair's first shared shingle is one of its regions and passes this if it links."""
    sizes = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    most = 1 + F.least(n - at - 1, other_n - other_at - 1)
    return sizes & ((100 + percent) * most >= percent * (n + other_n))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp) of all nodes of ``edges`` (a, b): the smallest node reachable.

    Large stars and small stars in turn: every node's larger neighbours, then its smaller ones,
    are linked to its least neighbour, until nothing changes. A round is two aggregations and
    two joins on edges; each is written, so that a lost executor costs a re-read.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        "u <> v").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lower = large.distinct()
        root = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def jaccard_components(
    docs: DataFrame,
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    common: int = COMMON,
    rounds: int = PIVOT_ROUNDS,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, text_hash, component), one for each document;
    ``component`` is unique to a component, also where its ids are null.

    Documents link if their sets of ``size``-word shingles (words in lower-cased A-Z; a shorter
    text is one shingle) have ``percent`` % or more of their union in common. ``component_id`` is
    the smallest id reachable by links. Null, empty and wordless texts have no shingles and link
    with nothing. Null ids take part and are named by others' ids (null if all are null); equal
    texts and repeated rows are one set. Other columns are not read. No rows: no rows.

    Texts are read three times and never shuffled; what is shuffled is about a fifth of the
    shingles' hashes and the sets of candidates. Groups of equal sets are one node, so copies
    meet in no region. Region sizes are those of sharing rare shingles; a large group of near
    copies shares common ones, whose pivots are found by a combining aggregation and joined.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        text_bytes(text_col).alias("text"))
    told = stage(described(texts, size, percent, common_shingles(texts, size, percent, common)), "shingles")
    classes = stage(told.where("n > 0").groupBy("digest").agg(
        F.min("row_id").alias("node"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"),
        F.first("spot").alias("spot")), "shingle-classes")
    nodes = told.select("row_id", "rare", "frequent").join(
        classes.select(F.col("node").alias("row_id"), "n"), "row_id").withColumnRenamed("row_id", "node")
    sketches = told.select(F.col("row_id").alias("node"), "n", "sketch")

    members = stage(_regions(nodes, common), "regions")
    # (a, b, apart, union) with a < b, distance apart / union; without links every node is its own component
    spark = docs.sparkSession
    verified = [spark.createDataFrame([], "a long, b long, apart long, union long")]
    comps = spark.createDataFrame([], "node long, comp long")
    for step in range(rounds + 1):
        if step:
            members = _undecided(members, comps)
        if step < rounds:
            if step:
                members = stage(_next_pivot(members), "regions")
            pairs = (members if step else members.where("NOT frequent")).select(
                "*", F.explode("pivots").alias("p")).where(
                "node <> p.node" + (" AND comp <> p.comp" if step else "")).select(
                "node", "n", "at", F.col("p.node").alias("other"), F.col("p.n").alias("other_n"),
                F.col("p.at").alias("other_at"))
            if not step:
                pairs = pairs.unionByName(_with_pivots(members.where("frequent"), sketches, percent))
            members = members.select("h", "node", "n", "at", F.col("pivots")[0]["node"].alias("pivot"))
        else:
            pairs = _windowed(members, _all(verified), sketches, percent)
        wanted = pairs.where(_may_link(
            F.col("n"), F.col("at"), F.col("other_n"), F.col("other_at"), percent
        )).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        wanted = wanted.join(_all(verified).select("a", "b"), ["a", "b"], "left_anti")
        wanted = stage(_near_sketches(wanted, sketches, percent), "candidates")
        if wanted.isEmpty():
            continue
        verified.append(stage(_compared(wanted, classes, texts, size), "verified"))
        links = _all(verified).where(
            100 * (F.col("union") - F.col("apart")) >= percent * F.col("union"))
        comps = stage(components(links.select("a", "b")), "components")
    return _named(told, classes, comps)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _regions(nodes: DataFrame, common: int) -> DataFrame:
    """(h, node, n, at, frequent, pivots) of regions with two members or more; ``at`` is the place of h
    in the member's prefix, ``frequent`` whether h is common, or has more than ``common`` members though
    it is not. Pivots are the members with the least hashes (of one or more hash functions), which makes regions of one group agree on them.

    Regions of rare shingles are small and take one pivot from a window; those of common ones may
    hold a third of all nodes, so their ``PIVOTS`` pivots come from a combining aggregation and
    are joined. More pivots join more of a large group before its rest is compared.
    """
    def order(k: int) -> Column:
        return F.struct(F.xxhash64("node", F.lit(k)).alias("by"), "node", "n", "at")

    def places(*found: Column) -> Column:
        return F.array_distinct(F.array(*[F.struct(
            x["node"].alias("node"), x["n"].alias("n"), x["at"].alias("at")) for x in found]))

    rare = nodes.select(F.posexplode("rare").alias("at", "h"), "node", "n")
    region = Window.partitionBy("h")
    small = rare.withColumn("p", F.min(order(0)).over(region)).withColumn(
        "members", F.count(F.lit(1)).over(region)).where("members > 1").withColumn(
        "pivots", places(F.col("p"))).drop("p")
    frequent = nodes.select(F.posexplode("frequent").alias("at", "h"), "node", "n", F.size("rare").alias("skip"))
    frequent = frequent.withColumn("at", F.col("at") + F.col("skip")).drop("skip")
    least = [F.min(order(k)).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = frequent.groupBy("h").agg(F.count(F.lit(1)).alias("members"), *least).where("members > 1").select(
        "h", places(*[F.col(f"p{k}") for k in range(PIVOTS)]).alias("pivots"))
    return small.withColumn("frequent", F.col("members") > common).drop("members").unionByName(
        frequent.join(pivots, "h").withColumn("frequent", F.lit(True))).select(
        "h", "node", "n", "at", "frequent", "pivots")


def _with_pivots(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of a member and a pivot of its region that sizes, places and sketches allow to link. The
    bounds hold inside the join: a large region makes no row for a pair that they rule out.

    To the region's own pivots come ``MIDDLE_PIVOTS`` members with the most large regions for their size:
    in the middle of a group of near copies they link to more of it than others, so that little of
    the group is left to compare in the last join.
    """
    own = sketches.select("node", "sketch")
    # a node meets its sketch once, not once for each of its regions
    placed = members.groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("h", "at")).alias("places"))
    middle = placed.select(
        "node", "n", (-F.floor(100 * F.size("places") / F.col("n"))).alias("middle"), F.inline("places")).groupBy("h").agg(
        F.array(*[F.min(F.struct("middle", F.xxhash64("node", F.lit(k)).alias("by"), "node", "n", "at"))
                  for k in range(MIDDLE_PIVOTS)]).alias("pivots"))
    pivots = members.groupBy("h").agg(F.first("pivots").alias("pivots")).unionByName(middle.withColumn(
        "pivots", F.transform("pivots", lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"), x["at"].alias("at"))))
    ).select(F.col("h").alias("region"), F.explode("pivots").alias("p")).select(
        "region", F.col("p.node").alias("other"), F.col("p.n").alias("other_n"), F.col("p.at").alias("other_at")).distinct().join(
        own.select(F.col("node").alias("other"), F.col("sketch").alias("other_sketch")), "other")
    return placed.join(own, "node").select("node", "n", "sketch", F.inline("places")).join(
        pivots, (F.col("h") == F.col("region")) & (F.col("node") != F.col("other")) & _may_link(
            F.col("n"), F.col("at"), F.col("other_n"), F.col("other_at"), percent) & _sketches_allow(
            F.col("sketch"), F.col("other_sketch"), F.col("n") + F.col("other_n"), percent)).select(
        "node", "n", "at", "other", "other_n", "other_at")


def _undecided(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their components, of regions that are in more than one, and ``first``, the
    component of a region's pivot or else its smallest."""
    known = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    pivots = comps.select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_in"))
    known = known.join(pivots, "pivot", "left")
    open_regions = known.groupBy("h").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("pivot_in").alias("p"),
        F.max(F.col("comp") == F.col("pivot_in")).alias("with_pivot")).where("x <> y").select(
        "h", F.when(F.col("with_pivot"), F.col("p")).otherwise(F.col("x")).alias("first"))
    return known.drop("pivot_in").join(open_regions, "h")


def _next_pivot(members: DataFrame) -> DataFrame:
    """The members with one pivot from outside the region's first component."""
    pivots = members.where("comp <> first").groupBy("h").agg(
        F.min(F.struct(F.xxhash64("node").alias("by"), "node", "n", "at", "comp")).alias("p")).select(
        "h", F.array(F.struct("p.node", "p.n", "p.at", "p.comp")).alias("pivots"))
    return members.drop("pivot").join(pivots, "h")


def _sketches_allow(a: Column, b: Column, sizes: Column, percent: int) -> Column:
    """``sketch_distance`` in column expressions, for sizes that may link: one sketch is at most
    twice as long as the other."""
    def folded(x: Column, half: Column) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x = F.when(F.size(a) > F.size(b), folded(a, F.size(b))).otherwise(a)
    y = F.when(F.size(b) > F.size(a), folded(b, F.size(a))).otherwise(b)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return (100 + percent) * apart <= (100 - percent) * sizes


def _windowed(members: DataFrame, verified: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of a member outside the region's first component with members of other components,
    whose distances to the first pivot, where both are known, differ by the limit at most, and
    whose sketches allow a link; what a bound rules out leaves the join as no row. The first
    component, often nearly the whole region, is never paired with itself. Two members of different
    components share the same regions here as before, and a pair that met in one of the first
    regions of both is not made again in later ones."""
    both = verified.select("a", "b", (F.col("apart") / F.col("union")).alias("d"))
    ways = both.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d").unionByName(
        both.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "d"))
    # a node meets its distances and its sketch once, not once for each of its regions
    placed = members.groupBy("node", "pivot").agg(
        F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list(F.struct("at", "h", "first")).alias("places")
    ).join(ways, ["node", "pivot"], "left").groupBy("node").agg(
        F.first("n").alias("n"), F.first("comp").alias("comp"), F.sort_array(F.flatten(F.collect_list(F.transform(
            "places", lambda x: F.struct(x["at"], x["h"], x["first"], F.col("d")))))).alias("places"))
    placed = placed.join(sketches.select("node", "sketch"), "node").select(
        "node", "n", "comp", "sketch", F.slice("places", 1, HEAD).alias("head"), F.inline("places"))
    placed = placed.withColumn("head", F.transform(
        F.filter("head", lambda x: x["at"] < F.col("at")), lambda x: x["h"]))
    # members outside are shuffled once: as one side of both joins and as the other side of one
    columns = ["h", "node", "n", "at", "comp", "d", "sketch", "head"]
    outside = placed.where("comp <> first").select(*columns)
    inside = placed.where("comp = first").select(*columns)

    def met(others: DataFrame, also: Column) -> DataFrame:
        x, y = ({name: F.col(f"{side}.{name}") for name in columns} for side in "xy")
        near = F.coalesce(F.abs(x["d"] - y["d"]) <= (100 - percent) / 100 + 1e-9, F.lit(True))
        return outside.alias("x").join(
            others.alias("y"), (x["h"] == y["h"]) & (x["comp"] != y["comp"]) & also & near & _may_link(
                x["n"], x["at"], y["n"], y["at"], percent) & _sketches_allow(
                x["sketch"], y["sketch"], x["n"] + y["n"], percent) & ~F.arrays_overlap(x["head"], y["head"])).select(
            x["node"], x["n"], x["at"], y["node"].alias("other"), y["n"].alias("other_n"), y["at"].alias("other_at"))

    return met(outside, F.col("x.node") < F.col("y.node")).unionByName(met(inside, F.lit(True)))


def _near_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.array(x.values, np.int64).view(np.uint64) for x in batch.column(name)]
                     for name in ("sketch_a", "sketch_b")]
            sizes = np.array(batch.column("n_a")) + np.array(batch.column("n_b"))
            apart = np.array([sketch_distance(x, y) for x, y in zip(*sides)], np.int64)
            near = pa.array((100 + percent) * apart <= (100 - percent) * sizes)
            yield batch.select(["a", "b"]).filter(near)

    joined = pairs
    for side in ("a", "b"):
        joined = joined.join(sketches.select(
            F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return joined.mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, apart, union) of all pairs, from whole sets; the distance is apart / union.

    The texts are read once more and give the sets of the nodes in ``pairs``; each set goes to
    its pairs, and two sets meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = []
            for one, other in zip(batch.column("one"), batch.column("other")):
                x = np.frombuffer(one.as_buffer(), np.uint64)
                y = np.frombuffer(other.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                common = int(np.count_nonzero(y[place] == x))
                distances.append((len(x) + len(y) - 2 * common, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([
                batch.column("a"), batch.column("b"),
                pa.array([d[0] for d in distances], pa.int64()), pa.array([d[1] for d in distances], pa.int64()),
            ], names=["a", "b", "apart", "union"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    ends = stage(ends.join(classes.select("node", "digest", "spot"), "node"), "ends")
    found = sets_of(texts, size, bit_map(ends.select("spot")))
    met = found.join(ends, "digest").groupBy("a", "b").agg(
        F.max(F.when(F.col("node") == F.col("a"), F.col("shingles"))).alias("one"),
        F.max(F.when(F.col("node") == F.col("b"), F.col("shingles"))).alias("other"))
    return met.mapInArrow(run, "a long, b long, apart long, union long")


def _named(told: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """The smallest document id of each component, for all documents."""
    known = classes.select("node", "digest", "least_id").join(comps, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = known.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = known.join(least, "comp").select("digest", "component_id", F.col("comp").alias("component"))
    return told.select("doc_id", "text_hash", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash", "component")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Size and component of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
