import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import edge_docs, no_docs
from pyspark.sql import functions as F

from dupeframe.llm import collocations, licenses, whitening

# -- whitening ---------------------------------------------------------------------------------


def spectra():
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    sample = rng.standard_normal((100, 24))
    return {
        "sample": np.cov(sample.T),
        "equal eigenvalues": turn @ np.diag([5, 5, 5, 3, 3, 2, 1, 1] + [0.5] * 16) @ turn.T,
        "identity": 7 * np.eye(24),
        "close eigenvalues": turn @ np.diag(np.r_[5, 5 - 1e-9, 4, 3, 2, 1, 0.9, 0.8, np.full(16, 0.1)]) @ turn.T,
        "diagonal": np.diag(np.arange(24.0)),
        "one direction above all": np.cov(sample.T) + 1000.0,
        "one": np.array([[2.0]]),
    }


@pytest.mark.parametrize("name", spectra())
def test_leading_eigenpairs(name):
    matrix = spectra()[name]
    values, vectors = whitening.leading_eigenpairs(matrix.astype(np.longdouble), 8)
    expected = np.linalg.eigvalsh(matrix)[::-1][:8]
    assert np.allclose(values, expected, rtol=0, atol=1e-13 * expected[0]) and len(values) == min(8, len(matrix))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-7
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * expected[0]


def test_counts_agree_with_the_spectrum():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 17):
        for matrix in (np.zeros((size, size)), *rng.standard_normal((6, size, size))):
            matrix = matrix + matrix.T
            for shift in rng.standard_normal(8) * 3:
                assert whitening.inertia_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


def test_directions_without_variance_have_no_component():
    values, vectors = whitening.leading_eigenpairs(np.diag([3.0, 0, 1, 0]).astype(np.longdouble), 8)
    assert values.tolist() == [3, 1] and vectors.shape == (4, 2)
    assert len(whitening.leading_eigenpairs(np.zeros((4, 4), np.longdouble), 8)[0]) == 0


def test_fit_and_whiten_against_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((300, 12)) @ np.diag(np.linspace(0.1, 2, 12))).astype(np.float32)
    vectors = [(k, v.tolist()) for k, v in enumerate(good)]
    nan, infinite, hole = good[0].tolist(), good[0].tolist(), good[0].tolist()
    nan[3], infinite[0], hole[-1] = float("nan"), float("-inf"), None
    odd = [(1000, None), (1001, nan), (1002, infinite), (1003, hole), (1004, []), (1005, [1.0, 2.0]), (None, good[7].tolist()),
           (3, good[3].tolist())]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumns(
        {"id": F.lit("x"), "vector": F.lit(1), "n": F.lit(2), "dims": F.lit(3)}).repartition(5)
    used = np.vstack([good, good[7], good[3]]).astype(np.float64)
    x = np.floor(1024 * used).astype(np.int64) + 100_000
    model = whitening.fit(df)
    assert model.n == 302 and model.sums == x.sum(axis=0).tolist() and len(model.eigenvalues) == 8
    assert model.trace == pytest.approx(np.cov(x.T, bias=True).trace(), rel=1e-12)
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:8], rtol=1e-12)
    found = whitening.whiten(df, model)
    rows = found.collect()
    ids = Counter(row.vec_id for row in rows)
    assert ids == Counter([*range(300), 3, None])
    deviations = ((302 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    expected = (x - x.mean(axis=0)) @ model.eigenvectors / np.sqrt(model.eigenvalues)
    for row in rows:
        at = 7 if row.vec_id is None else row.vec_id
        assert int(row.deviation) == deviations[at] and np.allclose(row.whitened, expected[at], atol=1e-9)
    assert whitening.identity_error(found, 8) < 1e-9
    again = whitening.fit(df.repartition(3))
    assert np.array_equal(again.eigenvectors, model.eigenvectors)


def test_whitening_of_few_equal_and_huge_vectors(spark):
    def of(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3):
        model = whitening.fit(of(rows))
        assert len(model.eigenvalues) == 0 and model.n == (len(rows) if rows and rows[0][1] else 0)
        found = whitening.whiten(of(rows), model).collect()
        assert [(int(r.deviation), r.whitened) for r in found] == [(0, [])] * model.n
    huge = of([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [2.0, 3.0])])
    model = whitening.fit(huge)
    n, x = 3, [[(1 << 53) + 100_000, 100_000], [-(1 << 53) + 100_000, 101_024], [102_048, 103_072]]
    sums = [sum(v) for v in zip(*x)]
    assert model.sums == sums
    exact = sum(Fraction(sum((n * v[i] - sums[i]) ** 2 for v in x), n ** 3) for i in range(2))
    assert model.trace == pytest.approx(float(exact), rel=1e-15)
    assert [int(r.deviation) for r in whitening.whiten(huge, model).orderBy("vec_id").collect()] == [
        sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]


# -- collocations ------------------------------------------------------------------------------


def brute_phrases(rows, min_count, most_words=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, most_words + 1):
                for at in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[at:at + size])] += 1
    return {k: a for k, a in counts.items() if a >= min_count}, totals


def brute_collocations(rows, min_count, top, inside_percent=100):
    counts, totals = brute_phrases(rows, min_count)
    found = {}
    for (lang, words), a in counts.items():
        held = any(other != words and other_lang == lang and len(other) > len(words)
                   and any(other[i:i + len(words)] == words for i in range(len(other) - len(words) + 1))
                   and 100 * b >= inside_percent * a for (other_lang, other), b in counts.items())
        if len(words) < 2 or held:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
                  for lang, all_of in found.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(all_of)[:top], 1))


def random_texts(seed, count, vocabulary):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de", None, "und", "ß"]),
             "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", " :"])
                     for _ in range(rng.randrange(60)))) for _ in range(count)] + [("en", None), ("de", "")]


@pytest.mark.parametrize("trigger", [1, 3, 1 << 30])
def test_phrases_against_brute_force(spark, trigger):
    rows = random_texts(trigger, 150, ["a", "B", "c", "dd", "É", "é", "x\x1cy", "中", "x y"])
    df = spark.createDataFrame(rows, "lang string, text string").withColumns(
        {"chunk": F.lit(1), "n": F.lit(1), "phrase": F.lit("p"), "words": F.lit(3)}).repartition(4)
    phrases, totals = collocations.phrase_counts(df, 5, 5, trigger)
    expected, sums = brute_phrases(rows, 5)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.a for r in phrases.collect()} == expected
    assert {r.lang: r.n for r in totals.collect()} == {lang: n for lang, n in sums.items() if n}
    for percent in (100, 60):
        found = collocations.collocations(phrases, totals, 20, percent).collect()
        assert sorted(tuple(row) for row in found) == brute_collocations(rows, 5, 20, percent)


def test_chunks_share_windows_and_own_each_word_once():
    rng = random.Random(1)
    for size in (1, 4, 5, 6, 200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(size)]
        chunks = list(collocations.parse(words, 5, 3))
        assert [p for first, _, owned in chunks for p in range(first, first + owned)] == list(range(size))
        assert all(end == min(size, first + owned + 4) for first, end, owned in chunks)
        # the same words are cut alike wherever they stand
        moved = [first + 7 for first, _, _ in collocations.parse([b"q"] * 7 + words, 5, 3) if first > 11]
        assert {first - 14 for first in moved} == {first for first, _, _ in chunks if first > 4}


def test_collocations_of_edge_cases(spark):
    phrases, totals = collocations.phrase_counts(edge_docs(spark), 2)
    texts = [(row.lang, row.text) for row in edge_docs(spark).collect()]
    assert sorted(tuple(r) for r in collocations.collocations(phrases, totals).collect()) == brute_collocations(
        texts, 2, 2000)
    assert collocations.collocations(*collocations.phrase_counts(no_docs(spark))).count() == 0


# -- licences ----------------------------------------------------------------------------------


def brute_statistics(templates, words):
    pieces = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    return [max([0, *[n for n in range(1, k + 2) if tuple(words[k + 1 - n:k + 1]) in pieces]]) for k in range(len(words))]


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        templates = {f"t{k}": " ".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))) for k in range(3)}
        phrases = {" ".join(rng.choice("abc") for _ in range(n)): f"p{n}" for n in (2, 3)}
        automaton = licenses.Automaton(templates, phrases, 2)
        words = [rng.choice([b"a", b"b", b"c", b"a", b"z"]) for _ in range(40)]
        sequences = [[w.encode() for w in t.split()] for t in (*templates.values(), *phrases)]
        stream = list(automaton.stream(words))
        assert [n for _, n in stream] == brute_statistics(sequences, words)
        for k, (state, n) in enumerate(stream):
            closed = sorted(p for p, least in automaton.closing[state] if n >= least)
            assert closed == [p for p, (_, s) in enumerate(automaton.phrases) if words[max(0, k + 1 - len(s)):k + 1] == s]
            if n >= 2:
                ends = {(t, e) for t, (_, s) in enumerate(automaton.templates) for e in range(n, len(s) + 1)
                        if s[e - n:e] == words[k + 1 - n:k + 1]}
                assert automaton.ends[state] >= ends and all(e <= len(automaton.templates[t][1]) for t, e in automaton.ends[state])
                assert {x for x in automaton.ends[state] if x in ends} == ends


def brute_base(text):
    words = licenses.split_words((text or "").encode())
    places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.encode().split()]
    return (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None),
            sorted({label for _, label in places}))


def test_phrases_of_texts_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["CC", "by", "general", "Public", "license", "all", "rights", "reserved", "é", "x1", "-", ".\n", "cc-by"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", "  ", "-", ", ", ""]) for _ in range(rng.randrange(40))))
            for k in range(300)] + [(None, None), (5, ""), (6, "all rights"), (7, "All Rights, reserved ALL rights reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "share": F.lit(2), "spans": F.lit(3)})
    found = licenses.scan_licenses(df).select(
        "doc_id", "n_words", "n_phrases", "first_word", "last_word", "phrase_labels").collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((k, *brute_base(text)) for k, text in rows), key=repr)


def test_spans_of_whole_edited_and_unrelated_texts():
    scanner = licenses.Scanner(licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES), 3, 8, 0.8)
    for label, text in licenses.TEMPLATES.items():
        for part in re.split(r"\n\s*\n", text):
            words = part.split()
            whole = scanner.scan(("Some words before. " + " ".join(words).upper() + " and after").encode())
            assert label in {span["label"] for span in whole["spans"]} and whole["share"] == 1
            if len(words) > 20:
                words[9] = "changed"  # one word of a long text
                words.insert(15, "added")
                found = [s for s in scanner.scan(" ".join(words).encode())["spans"] if s["label"] == label]
                assert found and 0.8 <= found[0]["share"] < 1
                cut = scanner.scan(" ".join(words[:len(words) // 2]).encode())
                assert label not in {span["label"] for span in cut["spans"]}
    for text in ("", "the software is provided to you and the work of the license", "MIT has a licence office", "x " * 5000):
        assert scanner.scan(text.encode())["spans"] == []
    twice = scanner.scan(b"Released under the MIT License. Other words stand here and go on. Released under the MIT License.")
    assert [(s["label"], s["first_word"], s["last_word"]) for s in twice["spans"]] == [("mit", 1, 4), ("mit", 13, 16)]


def test_licences_of_edge_cases(spark):
    found = licenses.scan_licenses(edge_docs(spark)).collect()
    assert len(found) == 10 and all(row.spans == [] and row.n_phrases == 0 for row in found)
    assert sorted(row.n_words for row in found) == sorted(
        len(licenses.split_words((row.text or "").encode())) for row in edge_docs(spark).collect())
    assert licenses.scan_licenses(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.Automaton({"short": "word"}, {})


def test_long_texts_and_words():
    scanner = licenses.Scanner(licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES), 3, 8, 0.8)
    long = b"all rights reserved. " * 150_000
    assert scanner.scan(long)["n_phrases"] == 150_000
    assert scanner.scan(b"x" * (3 << 20) + b" all rights reserved")["first_word"] == 1
