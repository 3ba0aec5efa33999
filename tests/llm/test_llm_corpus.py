import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from llm_cases import ROWS, edge_docs, no_docs
from pyspark.sql import functions as F

from dupeframe import staging
from dupeframe.llm import jaccard_join, language_model, mixing, ordinal, simhash
from dupeframe.llm.words import WordHashes, shingles

WORDS = [f"w{k}" for k in range(400)]


def tokens(text):
    return (text or "").encode().lower().split()


# -- Jaccard join -----------------------------------------------------------------------------


def sets(text, size=5):
    words = tokens(text)
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute_force_components(rows, percent=80):
    own = [sets(text) for _, text, *_ in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                comp[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(own[i]), min(ids) if ids else None) for i in members]
    return sorted(out, key=repr)


def near_copies(seed):
    """Groups of edited copies, chains that link only through others, and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows = []
    for group in range(12):
        base = rng.choices(WORDS, k=rng.choice([4, 6, 30, 90, 200]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                base = words
            text = " ".join(words)
            rows.append((len(rows) * 3 % 101, text.upper() if rng.random() < 0.2 else text))
        rows.append((200 + group, passage + " " + " ".join(rng.choices(WORDS, k=rng.choice([5, 20, 80])))))
    return rows


@pytest.mark.parametrize("seed,common,rounds", [(1, 8, 1), (2, 2, 1), (3, 2, 3)])
def test_components_equal_brute_force(spark, seed, common, rounds):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, common=common, rounds=rounds).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=repr) == brute_force_components(rows)


def test_pairs_of_a_large_group_of_near_copies_leave_the_last_join_about_once(spark, monkeypatch):
    """400 copies of one text with 2 to 12 words changed share nearly all regions of their prefixes."""
    rng = random.Random(7)
    base = rng.choices(WORDS, k=300)
    rows = []
    for _ in range(400):
        words = list(base)
        for _ in range(rng.randint(2, 12)):
            words[rng.randrange(300)] = "".join(rng.choices("abcdefgh", k=6))
        rows.append((len(rows), " ".join(words)))
    rows += [(k, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))) for k in range(400, 500)]
    made, original = [], jaccard_join._windowed

    def counted(*args):
        pairs = original(*args)
        ends = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
        made.append((pairs.count(), pairs.select(*ends).distinct().count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "_windowed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.jaccard_components(docs, rounds=1).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=repr) == brute_force_components(rows)
    assert made[0][1] > 100 and made[0][0] <= 2 * made[0][1]


@pytest.mark.parametrize("rounds", [1, 2])
def test_links_are_found_where_every_pivot_is_ruled_out(spark, rounds):
    """A long text with the whole of two near copies is the pivot of all that they share."""
    def prefix(text):
        own = shingles(WordHashes(lower=True).of(text.encode()), 5)
        return set(own[:jaccard_join._prefix_length(len(own), 80)].tolist())

    for seed in range(2000):
        rng = random.Random(seed)
        words = rng.choices(WORDS, k=40)
        b, c = " ".join(words), " ".join([*words[:-1], "other"])
        a = " ".join([b, c, *rng.choices(WORDS, k=120)])
        if prefix(b) & prefix(c) <= prefix(a):
            break
    least = min(spark.range(3).select("id", F.xxhash64("id", F.lit(0)).alias("by")).collect(), key=lambda r: r.by).id
    texts = [b, c]
    texts.insert(least, a)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = jaccard_join.jaccard_components(docs, rounds=rounds).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=repr) == brute_force_components(rows)
    assert len({r.component_id for r in found}) == 2


def test_components_of_edges(spark):
    found = jaccard_join.jaccard_components(edge_docs(spark)).collect()
    wordless = [row for row in ROWS if not tokens(row[1])]
    rest = [row for row in ROWS if tokens(row[1])]
    wanted = brute_force_components(rest) + [(row[0], 0, row[0]) for row in wordless]
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=repr) == sorted(wanted, key=repr)
    assert jaccard_join.jaccard_components(no_docs(spark)).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
        x = np.unique(rng.choice(pool, rng.integers(1, 600)))
        y = np.unique(rng.choice(pool, rng.integers(1, 600)))
        apart = len(np.setxor1d(x, y))
        assert jaccard_join.sketch_distance(jaccard_join.parity_sketch(x), jaccard_join.parity_sketch(y)) <= apart


def test_word_hashes_agree_with_words():
    rng = random.Random(3)
    maker, known = WordHashes(lower=True), {}
    for _ in range(50):
        text = "".join(rng.choices("aAbé \n\t\x0b.", k=rng.randrange(60))).encode()
        words = text.lower().split()
        for word, value in zip(words, maker.of(text).tolist(), strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    assert len(shingles(maker.of(b"a b"), 5)) == 1 and len(shingles(maker.of(b""), 5)) == 0


# -- mixing -----------------------------------------------------------------------------------


def brute_force_targets(sizes, weights, share, most):
    wanted, free, left = {}, dict(enumerate(sizes)), share * sum(sizes)
    while free:
        total = sum(weights[k % len(weights)] for k in free)
        over = [k for k, s in free.items() if left * weights[k % len(weights)] / total >= most * s]
        if not over:
            return wanted | {k: left * weights[k % len(weights)] / total for k in free}
        for k in over:
            wanted[k] = most * free.pop(k)
            left -= wanted[k]
    return wanted


def test_targets_and_taken_words(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 300])), rng.choice(["a", "b", "c", "d", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.assign_positions(docs, mixing.WEIGHTS, 1.5, 2, mixing.SCHEDULES, buckets=8).collect()
    again = mixing.assign_positions(docs.repartition(3), mixing.WEIGHTS, 1.5, 2, mixing.SCHEDULES, buckets=8).collect()
    key = lambda r: (r.doc_id, r._mix)
    assert sorted(map(key, found)) == sorted(map(key, again))
    sources = ["a", "b", "c", "d", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == source) for source in sources]
    targets = brute_force_targets(sizes, mixing.WEIGHTS, 1.5, 2)
    for k, source in enumerate(sources):
        own = [r for r in found if r.source == source]
        assert all(abs(r._mix.target - targets[k]) < 1e-6 and r._mix.source_size == sizes[k] for r in own)
        assert abs(sum(r._mix.taken for r in own) - targets[k]) < 1
        assert all(r._mix.taken == sum(c.words for c in r._mix.copies) <= 2 * r._mix.size for r in own)
    order = mixing.training_order(mixing.assign_positions(docs, mixing.WEIGHTS, 1.5, 2, mixing.SCHEDULES)).collect()
    positions = [r._mix.position for r in order]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert all(len(r.text.split()) == r._mix.words for r in order)


def test_inverse_demand_inverts_the_integral(spark):
    for schedule in (mixing.STEADY, mixing.RISING, mixing.FALLING, [(0.0, 0.0), (0.3, 2.0), (0.3, 0.0), (1.0, 1.0)]):
        row = spark.range(0, 101).select(
            mixing.inverse_demand(F.col("id") / 100.0, schedule).alias("t"), (F.col("id") / 100.0).alias("u")).collect()
        for r in row:
            grid = np.linspace(0, r.t, 4001)
            weight = np.interp(grid, [t for t, _ in schedule], [w for _, w in schedule])
            full = np.linspace(0, 1, 4001)
            total = np.trapezoid(np.interp(full, [t for t, _ in schedule], [w for _, w in schedule]), full)
            assert abs(np.trapezoid(weight, grid) / total - r.u) < 2e-3
    with pytest.raises(ValueError):
        mixing.integrated([(0.0, 1.0), (0.5, 1.0)])


def test_mixing_edges(spark):
    mixed = mixing.assign_positions(edge_docs(spark), [1.0], 1.5, 2)
    assert mixed.count() == len(ROWS) and mixed.where("hash <> 7").count() == 0
    assert mixing.training_order(mixed).where("_mix.words < 1").count() == 0
    assert mixing.training_order(mixing.assign_positions(no_docs(spark), [1.0])).count() == 0


# -- ordinal classifier -----------------------------------------------------------------------


def dense_fit(grades, features, n_grades, rounds=200, rate=0.04, decay=3e-4):
    """``fit_ordinal`` on a dense matrix, with slopes from differences of the loss itself."""
    share = np.bincount(grades, minlength=n_grades)
    weight = (1 / np.maximum(share, 1))[grades] / np.count_nonzero(share)

    def loss(params):
        w, free = params[:features.shape[1]], params[features.shape[1]:]
        cuts = np.concatenate([[-40.0], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), [40.0]])
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
        score = features @ w
        chance = sigmoid(cuts[grades + 1] - score) - sigmoid(cuts[grades] - score)
        return -(weight * np.log(np.maximum(chance, 1e-9))).sum() + decay / 2 * (w ** 2).sum()

    params = np.zeros(features.shape[1] + n_grades - 1)
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        slope = np.array([(loss(params + e) - loss(params - e)) / 2e-6 for e in 1e-6 * np.eye(len(params))])
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        params -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    free = params[features.shape[1]:]
    return params[:features.shape[1]], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def test_the_sparse_fit_equals_a_dense_one_by_differences(monkeypatch):
    rng = np.random.default_rng(6)
    features = rng.random((60, 5)) * (rng.random((60, 5)) < 0.6)
    grades = np.clip((features @ [2, -1, 1, 0, 3] + rng.normal(0, 0.4, 60)).astype(int), 0, 2)
    rows, numbers = np.nonzero(features)
    values = features[rows, numbers].astype(np.float32)
    features = features.astype(np.float32).astype(np.float64)
    weights, cuts = dense_fit(grades, features, 3, rounds=60)
    for block in (7, 1 << 18):
        monkeypatch.setattr(ordinal, "_BLOCK", block)
        model = ordinal.fit_ordinal(
            grades, rows.astype(np.int32), numbers.astype(np.int32), values, 3, dimensions=8, min_rows=1, rounds=60)
        assert np.allclose(model.weights[:5], weights, atol=1e-3) and np.allclose(model.thresholds, cuts, atol=1e-3)


def test_an_id_with_many_rows_is_one_rated_text(spark, monkeypatch):
    from dupeframe.llm import ordinal as module

    docs = spark.createDataFrame(
        [(1, f"text number {k % 7}") for k in range(300)] + [(k, f"other words {k}") for k in range(2, 150)],
        "doc_id long, text string").repartition(4)
    seen, original = [], module.fit_ordinal
    monkeypatch.setattr(module, "fit_ordinal", lambda grades, *rest: seen.append(len(grades)) or original(grades, *rest))
    grades = docs.select("doc_id").distinct().withColumn("grade", (F.col("doc_id") % 3).cast("int"))
    one, two = (ordinal.train(frame, grades) for frame in (docs, docs.repartition(9)))
    assert seen == [149, 149]
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)


def test_the_driver_holds_the_sample_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"words {k} and some more {k % 5}") for k in range(200)], "doc_id long, text string")
    held, original = [], ordinal.fit_ordinal

    def fit(*args):
        held.append(pa.total_allocated_bytes())
        return original(*args)

    monkeypatch.setattr(ordinal, "fit_ordinal", fit)
    before = pa.total_allocated_bytes()
    ordinal.train(docs, docs.selectExpr("doc_id", "int(doc_id % 3) AS grade"))
    assert len(held) == 1 and held[0] <= before
    size, n = 1 << 20, 4000
    tracemalloc.start()
    original(
        np.arange(n) % 3, np.arange(size, dtype=np.int32) % n, np.arange(size, dtype=np.int32) % 5000,
        np.ones(size, np.float32), 3, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * size  # little more than the features twice, at 12 bytes each (28 before)


def test_held_out_grades(spark):
    rng = random.Random(5)

    def text(grade):
        words = rng.choices(WORDS, k=60)
        for _ in range(4):
            words[rng.randrange(60)] = {0: "dreadful$$", 1: "mediocre", 2: "w1"}[grade]
        return " ".join(words)

    rows = [(k, k % 3, text(k % 3)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, grade int, text string")
    model = ordinal.train(docs, docs.where("doc_id < 300").select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    graded = ordinal.grade_documents(docs.where("doc_id >= 300"), model).collect()
    right = np.mean([sum(t > 0.5 for t in r._grade.tails) == r.grade for r in graded])
    assert right > 0.95
    assert all(r._grade.kept == (r._grade.tails[1] >= 0.5) for r in graded)
    assert all(abs(r._grade.expected - sum(r._grade.tails)) < 1e-9 for r in graded)


def test_grading_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (5, 1, 1), (6, None, 1), (None, 1, 1), (9, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    grades = ordinal.rated(labels)
    assert sorted(map(tuple, grades.collect())) == [(4, 0), (5, 1), (9, 2)]
    docs = edge_docs(spark)
    graded = ordinal.grade_documents(docs, ordinal.train(docs, grades)).collect()
    assert len(graded) == len(ROWS) and all(r._grade.kept is not None and r.h == 7 for r in graded)
    assert ordinal.train(no_docs(spark), grades) is None
    unrated = ordinal.grade_documents(docs, ordinal.train(docs, grades.limit(0))).collect()
    assert all(r._grade.kept and r._grade.expected is None for r in unrated)
    assert ordinal.grade_documents(no_docs(spark), None).count() == 0


# -- SimHash ----------------------------------------------------------------------------------


def test_comparison_with_the_next_document(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 2, 40, 200]))) + "é中" * (k % 3)) for k in range(40)]
    rows[7] = (7, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.compare_with_next(docs).collect()}
    assert len(found) == 40
    plain = {k: t or "" for k, t in rows}
    for k, text in plain.items():
        following, half = plain[(k - 1) % 40], len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert found[k].n_chars == len(text)
        assert found[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        maker = simhash.SimHash()
        own = maker.of(text.encode())
        assert found[k].fingerprint == simhash.hexadecimal(own)
        assert found[k].near_edited == maker.likeness(own, maker.of(edited.encode()))
        assert found[k].near_next == maker.likeness(own, maker.of(following.encode()))


def test_simhash_edges(spark):
    assert simhash.compare_with_next(edge_docs(spark)).count() == len(ROWS)
    assert simhash.compare_with_next(no_docs(spark)).count() == 0
    one = simhash.compare_with_next(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


@pytest.mark.parametrize("radius,blocks", [(0, 1), (1, 2), (3, 5), (4, 6)])
def test_radius_search_equals_brute_force(spark, radius, blocks):
    rng = np.random.default_rng(7)
    bases = rng.integers(0, 1 << 63, (12, 1), dtype=np.uint64)
    made = []
    for k in range(120):
        value = int(bases[k % 12, 0])
        for bit in rng.integers(0, 64, rng.integers(0, 4)):
            value ^= 1 << int(bit)
        made.append(value)
    rows = [(f"{v:016x}", [v - (1 << 64) if v >> 63 else v]) for v in made]
    table = spark.createDataFrame(rows, "fingerprint string, words array<long>")
    found = simhash.within_radius(table.limit(30), table, radius, blocks, bits=64).collect()
    queries, every = set(made[:30]), set(made)
    wanted = {(q, v) for q in queries for v in every if (q ^ v).bit_count() <= radius}
    assert len(found) == len(wanted)
    assert {(int(r.query, 16), int(r.found, 16)) for r in found} == wanted


def edited_texts(rng, n=500):
    """(text, similarity to the first text) of one text and copies with single words changed."""
    words = [f"v{rng.randrange(5000)}" for _ in range(n)]
    for changed in (0, 1, 2, 4, 8, 11, 16, 30):
        copy = list(words)
        for k in rng.sample(range(n), changed):
            copy[k] = f"new{rng.randrange(10 ** 6)}"
        text, own, other = " ".join(copy), sets(" ".join(words)), sets(" ".join(copy))
        yield text, len(own & other) / len(own | other)


def test_edited_texts_are_found_as_by_brute_force(spark):
    rng, maker, made, queries, likeness = random.Random(11), simhash.SimHash(), [], [], {}
    for _ in range(20):
        for k, (text, similar) in enumerate(edited_texts(rng)):
            made.append(maker.of(text.encode()))
            if not k:
                queries.append(made[-1])
            likeness[simhash.hexadecimal(queries[-1]), simhash.hexadecimal(made[-1])] = similar
    table = lambda x: spark.createDataFrame(
        [(simhash.hexadecimal(w), w.view(np.int64).tolist()) for w in x], "fingerprint string, words array<long>")
    found = {(r.query, r.found): r.distance for r in simhash.within_radius(table(queries), table(made)).collect()}
    apart = {(simhash.hexadecimal(q), simhash.hexadecimal(w)): int(np.bitwise_count(q ^ w).sum())
             for q in queries for w in made}
    assert found == {pair: d for pair, d in apart.items() if d <= simhash.RADIUS}
    near = [pair for pair, similar in likeness.items() if similar >= 0.85]
    assert len(near) > 80 and sum(pair in found for pair in near) >= 0.95 * len(near)


def test_rows_that_are_not_queried_take_no_part_in_the_join(spark):
    rows = [(k, f"f{k % 7}") for k in range(60)] + [(None, "f1")]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    counts = spark.createDataFrame([("f0", 3), ("f3", 5)], "query string, n_within long")
    made = simhash.with_counts(table, F.col("doc_id") % 20 == 0, counts)
    wanted = [(k, f, {"f0": 3, "f3": 5}.get(f) if k is not None and k % 20 == 0 else None) for k, f in rows]
    assert sorted([(r.doc_id, r.fingerprint, r.n_within) for r in made.collect()], key=repr) == sorted(wanted, key=repr)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")


# -- language model ---------------------------------------------------------------------------


def test_scores(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(WORDS[:30], k=20)) + (" the cat sat" * 5)) for k in range(60)] + [
        (60, None), (61, "never seen words"), (None, "the cat")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n long")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = {r.doc_id: r for r in language_model.score_documents(docs, held).collect()}
    train = [t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*tokens(t), b""])
    total, vocabulary = sum(counts.values()), len(counts)
    for k, text in rows:
        words = [*tokens(text), b""]
        r = found[k]
        assert (r.n_tokens, r.train_tokens) == (len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (vocabulary + 1))) for w in words)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base))
        assert r.score < 0
    assert found[59].score > found[59].base_score  # repeats are predictable


@pytest.mark.parametrize("word_share,context_share", [(0.0, 0.0), (0.01, 0.02)])
def test_automaton_is_a_distribution_and_equals_direct_backoff(spark, word_share, context_share):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", "d d", "e f g"], k=12)) for _ in range(40)]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    automaton, words = language_model.train(docs, 3, word_share, context_share, 0.001)
    scorer = language_model.Scorer(automaton)
    known = dict(map(tuple, words.collect()))
    place = {h: k for k, h in enumerate(automaton.words.tolist())}

    def chance(state, h):
        score = 0.0
        word = int(automaton.contexts[place[h]]) if h in place else -1
        while state:
            if word in scorer.arcs[state]:
                return 10 ** (score + scorer.arcs[state][word][0])
            score, state = score + scorer.weight[state], scorer.fail[state]
        return 10 ** (score + automaton.unigram(float(known.get(h, 0))))

    for state in range(len(automaton.fail)):
        assert abs(sum(chance(state, h) for h in [*known, 0]) - 1) < 1e-9
    # the traversal against a plain one over n-gram counts kept as text
    grams = Counter()
    for t in texts:
        seq = [*t.split(), ""]
        for n in (2, 3):
            grams.update(tuple(seq[k:k + n]) for k in range(len(seq) - n + 1))
    assert len(automaton.arc_keys) <= len(grams)
    if not word_share:
        assert len(automaton.arc_keys) == sum(n > 1 for n in grams.values())


def test_language_model_edges(spark):
    held = F.col("doc_id") % 2 == 1
    found = language_model.score_documents(edge_docs(spark), held).collect()
    assert len(found) == len(ROWS) and all(r.score is not None and not math.isnan(r.score) for r in found)
    nothing = language_model.score_documents(edge_docs(spark), F.lit(True)).collect()
    assert len(nothing) == len(ROWS) and all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in nothing)
    assert language_model.score_documents(no_docs(spark), held).count() == 0


@pytest.mark.parametrize("gram_share,word_share", [(4e-6, 1e-6), (1.0, 1.0), (1e-3, 1e-3)])
def test_rare_n_grams_are_learned_and_scores_equal_the_whole_automaton(spark, gram_share, word_share):
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choices(WORDS, k=500))) for k in range(80)]
    rows += [(k, f"zig zag zog w{k} {'zig zag' if k % 2 else ''}") for k in range(80, 84)] + [(85, None), (86, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id").isin(83, 79, 86)
    found = {r.doc_id: r for r in language_model.score_documents(
        docs, held, word_share=word_share, gram_share=gram_share).collect()}
    whole, words = language_model.train(
        docs.where(~held).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")), 3, 0.0, 0.0, 0.0)
    assert whole.tokens * language_model.CONTEXT_SHARE > 3  # "zog" is rarer than a share would allow
    scorer = language_model.Scorer(whole)
    assert len(found) == len(rows)
    for k, text in rows:
        n, n_known, base, score, rest = scorer.of((text or "").encode())
        score += sum(rest.values()) * whole.unigram(0)
        base += sum(rest.values()) * whole.base(0)
        r = found[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, n_known, whole.tokens)
        assert abs(r.score - score) < 1e-6 and abs(r.base_score - base) < 1e-6


def bytes_below(*folders):
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("*") if f.is_file())


def test_disk_of_the_language_model_stays_below_four_times_the_texts(spark, monkeypatch):
    """Shuffle files of one step and all staged tables; the words are varied, so most n-grams occur once."""
    rng = random.Random(11)
    rows = [(k, " ".join(f"{rng.choice(WORDS)}{int(rng.paretovariate(0.4))}" for _ in range(2000))) for k in range(100)]
    size = sum(len(text) for _, text in rows)
    docs = spark.createDataFrame(rows + [(k + 100, text) for k, text in rows[:30]], "doc_id long, text string").coalesce(1)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    local, staged, used = list(blocks.localDirsString()), [], []

    def watched(df, label):
        """As ``stage``, but shuffle files stay and are counted."""
        path, before = staging.stage_path(df.sparkSession, label), bytes_below(*local)
        df.write.parquet(path)
        staged.append(path)
        used.append(bytes_below(*local) - before + bytes_below(*staged))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(language_model, "stage", watched)
    assert language_model.score_documents(docs, F.col("doc_id") % 5 == 1).count() == 130
    assert max(used) < 4 * size


@pytest.mark.parametrize("order", [1, 2, 3])
def test_blocks_and_slices_do_not_change_scores(spark, monkeypatch, order):
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 60)))) for k in range(120)] + [(None, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    held = F.col("doc_id") % 4 == 1
    whole = language_model.score_documents(docs, held, order).collect()
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(language_model, "BUCKET_KEYS", 20)
    found = language_model.score_documents(docs, held, order).collect()
    assert len(found) == len(whole) == len(rows)
    for a, b in zip(*(sorted(x, key=lambda r: (r.doc_id is None, r.doc_id)) for x in (whole, found))):
        assert a[:5] == b[:5] and abs(a.score - b.score) < 1e-9 and abs(a.base_score - b.base_score) < 1e-9


def test_pivots_of_large_regions_make_no_pairs_that_sketches_rule_out(spark, monkeypatch):
    """Each text takes one of two words at 14 places, so all shingles are shared and few texts link."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(word + rng.choice("ab") if at % 14 == 7 else word for at, word in enumerate(base))) for k in range(120)]
    met, original = [], jaccard_join._near_sketches

    def counted(pairs, *args):
        met.append(pairs.count())
        return original(pairs, *args)

    monkeypatch.setattr(jaccard_join, "_near_sketches", counted)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=repr) == brute_force_components(rows)
    assert met[0] <= 2 * len(rows)


def rows_of_joins_on_nodes(df):
    """Rows that each join on ``node`` of a query made."""
    df.collect()
    found = []

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return walk(plan.plan())
        if "Join" in plan.nodeName() and "Join [node#" in plan.simpleString(25):
            found.append(plan.metrics().apply("numOutputRows").value())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_a_node_meets_its_sketch_once_not_in_each_region(spark):
    """60 nodes in the same 40 regions; each has another sketch, so that no pair is left."""
    nodes, regions = 60, 40
    sketches = spark.createDataFrame(
        [(k, 100, [random.Random(k).getrandbits(63) for _ in range(4)]) for k in range(nodes)],
        "node long, n long, sketch array<long>")
    members = spark.range(nodes * regions).selectExpr(
        "id % 40 AS h", "id div 40 AS node", "100L AS n", "int(id % 40) AS at", "0L AS pivot", "id div 40 AS comp",
        "0L AS first", "array(named_struct('node', 0L, 'n', 100L, 'at', int(id % 40))) AS pivots")
    verified = spark.createDataFrame([(0, 1, 90, 190)], "a long, b long, apart long, union long")
    first = jaccard_join._with_pivots(members.select("h", "node", "n", "at", "pivots"), sketches, 80)
    last = jaccard_join._windowed(members.drop("pivots"), verified, sketches, 80)
    for pairs in (first, last):
        made = rows_of_joins_on_nodes(pairs)
        assert made and max(made) <= nodes


def test_near_copies_around_one_text_leave_few_pairs_to_the_last_join(spark, monkeypatch):
    """Copies of one text, a quarter with one word changed, the rest with 2 to 6: those with one link to
    each other, which needs no comparison of all pairs once a pivot from the middle has joined them."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(137)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(5, 132), 1 if k % 4 == 1 else rng.randint(2, 6)):
            words[at] = f"x{rng.randrange(10 ** 9)}"
        rows.append((k, " ".join(words)))
    met, original = [], jaccard_join._near_sketches

    def counted(pairs, *args):
        met.append(pairs.count())
        return original(pairs, *args)

    monkeypatch.setattr(jaccard_join, "_near_sketches", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = jaccard_join.jaccard_components(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=repr) == brute_force_components(rows)
    assert sum(met) <= 8 * len(rows)
