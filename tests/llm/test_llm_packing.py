import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from llm_cases import ROWS, edge_docs, no_docs
from public_tokenizers import path
from tokenizers import Tokenizer

from dupeframe.llm import tokens
from dupeframe.llm.packing import best_cuts, digests, pack_in_order
from dupeframe.llm.token_output import CapacityTree, best_fit_decreasing, pack_token_ids
from dupeframe.llm.tokens import Encoder

NAME = path("word_bpe_49k.json")


def plain_ids(text):
    return Tokenizer.from_file(NAME).encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_encoding_by_word_is_the_tokenizers(text):
    global _encoder, _plain
    if "_encoder" not in globals():
        _encoder, _plain = Encoder(NAME, 2), Tokenizer.from_file(NAME)
    ids, ends = _encoder.encode(text.encode())
    assert ids.tolist() == _plain.encode(text, add_special_tokens=False).ids + [2]
    assert ends[-1] == len(ids) and (np.diff(ends) > 0).all()


def brute_force_fit(lengths, capacity):
    rows = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rows if capacity - sum(lengths[i] for i in r) >= lengths[item]]
        if fits:
            max(fits, key=lambda r: sum(lengths[i] for i in r)).append(item)
        else:
            rows.append([item])
    return rows


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        for _ in range(20):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
            ours, brute = best_fit_decreasing(lengths, capacity), brute_force_fit(lengths, capacity)
            def fill(rows):
                return sorted(sum(lengths[i] for i in row) for row in rows)
            assert fill(ours) == fill(brute)
            assert sorted(i for row in ours for i in row) == list(range(len(lengths)))


def test_capacity_tree():
    tree = CapacityTree(10)
    assert tree.at_least(0) is None
    for capacity in (3, 8, 10):
        tree.add(capacity, 1)
    assert [tree.at_least(need) for need in (0, 3, 4, 9, 10)] == [3, 3, 8, 10, 10]
    tree.add(8, -1)
    assert tree.at_least(4) == 10


def test_best_cuts_equal_brute_force():
    rng = random.Random(2)

    def cost(lengths, penalties, capacity, cuts):
        total, first = 0, 0
        for cut in cuts:
            size = sum(lengths[first:cut])
            if size > capacity:
                return float("inf")
            total, first = total + capacity - size + penalties[cut - 1], cut
        return total

    for _ in range(60):
        n, capacity = rng.randint(1, 10), rng.randint(4, 12)
        lengths = [rng.randint(1, 4) for _ in range(n)]
        penalties = [rng.choice([0, 2, 9]) for _ in range(n)]
        every = [[k + 1 for k in range(n - 1) if mask >> k & 1] + [n] for mask in range(1 << (n - 1))]
        best = min(cost(lengths, penalties, capacity, cuts) for cuts in every)
        assert cost(lengths, penalties, capacity, best_cuts(lengths, penalties, capacity)) == best


def assert_pieces_cover(pieces, rows, capacity):
    found = {}
    for doc_id, start, length, crc, total in sorted(
            ((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces), key=repr):
        found.setdefault((doc_id, total), []).append((start, length, crc))
    wanted = {}
    for doc_id, text, *_ in rows:
        ids = plain_ids(text)
        wanted.setdefault((doc_id, len(ids)), []).append(np.array(ids, "<u4"))
    assert set(found) == set(wanted)
    for key, documents in wanted.items():
        assert sum(length for _, length, _ in found[key]) == sum(map(len, documents))
        for start, length, crc in found[key]:
            assert crc in {zlib.crc32(ids[start:start + length].tobytes()) for ids in documents}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def test_pack_in_order_edges(spark):
    for order in (["doc_id"], None):
        for block in (1 << 20, 100):
            pieces = digests(pack_in_order(edge_docs(spark), NAME, order, capacity=64, block_tokens=block)).collect()
            assert_pieces_cover(pieces, ROWS, 64)
    assert digests(pack_in_order(no_docs(spark), NAME, ["doc_id"])).count() == 0


def test_order_is_kept(spark):
    docs = spark.createDataFrame([(k, f"text number {k}. " * (k % 7 + 1)) for k in range(200)], "doc_id long, text string")
    pieces = pack_in_order(docs, NAME, ["doc_id"], capacity=50).orderBy("sequence_id", "offset").collect()
    assert [p.doc_id for p in pieces] == sorted(p.doc_id for p in pieces)


def test_pack_token_ids_round_trip(spark):
    for block in (1 << 22, 200):
        rows = pack_token_ids(edge_docs(spark), NAME, capacity=64, block_tokens=block).collect()
        assert len({r.sequence_id for r in rows}) == len(rows)
        documents = {}
        for r in rows:
            assert len(r.input_ids) == len(r.position_ids) == 64 and r.cu_seqlens[0] == 0
            assert r.n_tokens == r.cu_seqlens[-1] and not any(r.input_ids[r.n_tokens:])
            for k, (doc_id, start) in enumerate(zip(r.doc_ids, r.starts)):
                a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
                assert r.position_ids[a:b] == list(range(b - a))
                documents.setdefault(doc_id, []).append((start, tuple(r.input_ids[a:b])))
        assert sum(len(ids) for parts in documents.values() for _, ids in parts) == sum(
            len(plain_ids(text)) for _, text, *_ in ROWS)
        assert sorted(documents[5])[0][0] == 0
        assert [i for _, ids in sorted(documents[5]) for i in ids] == plain_ids(ROWS[8][1])
    assert pack_token_ids(no_docs(spark), NAME).count() == 0


def test_words_with_marks_are_encoded_as_the_tokenizer_does():
    rng = random.Random(11)
    parts = ["ab", "Cd", "the", "x", "'s", "'", "n't", ".", ",", "!?", "...", ";", ":", "é", "Ü", "中", "7", "-", " ", "<|", "“"]
    encoder = Encoder(NAME, 2)
    assert encoder.fold is bytes.lower
    for _ in range(400):
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12)))
        ids, ends = encoder.encode(text.encode())
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert ends[-1] == len(ids)
    assert Encoder(NAME, 2, by_word=False).fold is None


def test_sentence_ends_do_not_depend_on_the_way_a_word_is_learned():
    one, other = Encoder(NAME, 2), Encoder(NAME, 2)
    other.fold = None
    for text in ("One two. Three, four! five", "a. b.) c? \"d!\" e", "...", "x;y. z"):
        found = [encoder.encode(text.encode()) for encoder in (one, other)]
        assert [list(a) for a in found[0]] == [list(a) for a in found[1]]


def test_texts_and_words_longer_than_a_chunk():
    """Texts are handled in pieces of 1 MiB; none is cut in a word, and no word is too long."""
    from dupeframe.llm.words import CHUNK_BYTES, WordHashes, chunks

    rng = random.Random(12)
    words = [rng.choice(["alpha", "beta.", "Gamma", "delta!", "é", "x1"]) for _ in range(3 * CHUNK_BYTES // 5)]
    text = " ".join(words).encode()
    assert len(text) > 2 * CHUNK_BYTES and b" ".join(chunks(text)) == text and len(list(chunks(text))) > 2
    hashes, one = WordHashes(), WordHashes()
    each = {word: one.of(word.encode())[0] for word in set(words)}
    assert hashes.of(text).tolist() == [each[word] for word in words]
    ids, ends = Encoder(NAME, 2).encode(text)
    encoder = Encoder(NAME, 2)
    parts = {word: encoder.encode(word.encode())[0][:-1].tolist() for word in set(words)}
    assert ids.tolist() == [i for word in words for i in parts[word]] + [2] and ends[-1] == len(ids)
    long = b"y" * (3 * CHUNK_BYTES)
    assert len(hashes.of(long)) == 1 and list(chunks(long)) == [long]


def test_letters_of_any_script_go_straight_to_the_model():
    encoder, plain = Encoder(NAME, 2), Tokenizer.from_file(NAME)
    text = "Naïve ÉLÈVE, ΣΑΣ. 각자 中文*** word.*** word$$$ (end.)\" don't² x y"
    left = encoder._learn_letters
    rest = []
    encoder._learn_letters = lambda first, words: [rest.append(words[k]) or k for k in left(first, words)]
    ids, _ = encoder.encode(text.encode())
    assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert not {"Naïve", "ÉLÈVE,", "中文***", "word.***", "word$$$"} & {word.decode() for word in rest}


def test_frequent_words_stay_when_the_cache_is_full(monkeypatch):
    from dupeframe.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 8)
    encoder, plain = Encoder(NAME, 2), Tokenizer.from_file(NAME)
    texts = ["The cat, of é! " + " ".join(f"w{k}x{j} Über{'a' * k}." for j in range(2)) for k in range(30)]
    for text in [*texts, *texts[::-1]]:
        assert encoder.encode(text.encode())[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert b"The" in encoder.index and len(encoder.index) <= 8 + 8


def test_texts_that_are_looked_up_together_have_the_ids_of_each(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 20)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 30)
    texts = [b"", b"one two, three", b" \n", "Ünïcode wörds — 中文".encode(), b"long " * 300_000, b"end."]
    texts += [b" ".join(b"%d" % (7 * k + j) for j in range(9)) for k in range(20)]
    for by_word in (True, False):
        one, many = (Encoder(path("word_bpe_49k.json"), 2, by_word) for _ in range(2))
        for _ in range(2):
            assert [x.tolist() for x in many.encode_all(iter(texts))] == [one.encode(x)[0].tolist() for x in texts]
