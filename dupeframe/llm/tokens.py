"""Token ids of whole texts, made inside tasks."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from string import ascii_letters, punctuation
from types import ModuleType

import numpy as np

from dupeframe.llm.words import CHUNK_BYTES, chunks

CACHED_WORDS = 1 << 20
# Short texts are looked up together, about so many words at once.
TOGETHER = 1 << 13
# Characters that end a sentence, and closing marks that may follow them.
SENTENCE_ENDS = tuple(mark.encode() for mark in ".!?…。！？")
CLOSING = b"\"')]}"
# Fixed value: marks that may stand behind a word of letters.
MARKS = punctuation.encode()


class _Index(dict):
    """Words and their places; a new word gets the next place and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


def worker_encoder(path: str, end_id: int, by_word: bool = True) -> Encoder:
    """The encoder of this Python worker, which later tasks of the worker find with its words."""
    kept = sys.modules.setdefault("_dupeframe_encoders", ModuleType("_dupeframe_encoders")).__dict__
    key = f"{path}:{end_id}:{by_word}"
    if key not in kept:
        kept[key] = Encoder(path, end_id, by_word)
    return kept[key]


class Encoder:
    """Encodes texts with a vocabulary file of the ``tokenizers`` library.

    ``by_word`` is for tokenizers that drop white space and never join across it: each distinct
    word is then encoded once per Python worker and looked up afterwards. Other tokenizers encode each
    text as a whole. ``end_id`` closes every document.
    """

    def __init__(self, path: str, end_id: int, by_word: bool = True):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.by_word = end_id, by_word
        self.normal, self.cut, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.fold = self._letter_fold()
        self.tails: dict[bytes, tuple[list[int], bool] | None] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        for token, number in vocabulary.items() if suffix else ():
            self.ends_word[number] = token.endswith(suffix)
        self.index, self.flat = _Index(), array("I")
        self.starts, self.lengths, self.closes = array("q"), array("q"), array("b")

    def _pieces(self, text: str) -> list[str]:
        return [piece for piece, _ in self.cut.pre_tokenize_str(text)]

    def _letter_fold(self):
        """What the tokenizer does to ASCII letters before its model sees them, if that is nothing or
        lower case only; else None."""
        if not self.by_word or self.normal is None or self.cut is None:
            return None
        added = [str(token.content).rstrip(MARKS.decode()) for token in self.tokenizer.get_added_tokens_decoder().values()]
        folded = self.normal.normalize_str(ascii_letters)
        if self._pieces(folded) != [folded] or any(token.isalpha() for token in added):
            return None
        return {ascii_letters.lower(): bytes.lower, ascii_letters: bytes}.get(folded)

    def _tail(self, marks: bytes) -> tuple[list[int], bool] | None:
        """The ids of marks behind letters, and whether they end a sentence; None if the tokenizer does
        not take them apart from the letters."""
        if marks not in self.tails:
            text = marks.decode()
            apart = self.normal.normalize_str("a" + text) == "a" + text and (
                self._pieces("a" + text) == ["a", *self._pieces(text)])
            if len(self.tails) > CACHED_WORDS:
                self.tails.clear()
            self.tails[marks] = (
                self.tokenizer.encode(text, add_special_tokens=False).ids, marks.rstrip(CLOSING).endswith(SENTENCE_ENDS)
            ) if apart else None
        return self.tails[marks]

    def _letter_pieces(self, texts: list[str]) -> list[str] | None:
        """What the model sees of words of letters, all made in one call; None if one of them is
        not one piece."""
        joined = self.normal.normalize_str(" ".join(texts))
        found, at = self.cut.pre_tokenize_str(joined), 0
        words = joined.split(" ")
        if len(found) != len(texts) or len(words) != len(texts):
            return None
        for word, (_, span) in zip(words, found):
            if span != (at, at + len(word)):
                return None
            at += len(word) + 1
        return [piece for piece, _ in found]

    def _learn_letters(self, first: int, words: list[bytes]) -> list[int]:
        """Learn the words of letters, with marks behind them or not, straight from the model; returns the
        places of the rest. Words of ASCII letters whose folded form is known take its ids."""
        which, found, rest, others, texts = [], [], [], [], []
        tokenize, fold, known, tails = self.model.tokenize, self.fold, self.index.get, self.tails
        for k, word in enumerate(words):
            core, tail = word, None
            if not word.isalpha():
                core = word.rstrip(MARKS)
                if len(core) < len(word):
                    marks = word[len(core):]
                    tail = tails[marks] if marks in tails else self._tail(marks)
                    if tail is None:
                        rest.append(k)
                        continue
            if core.isalpha():
                folded = fold(core)
                at = known(folded, first)
                if at < first:
                    start = self.starts[at]
                    ids = self.flat[start:start + self.lengths[at]].tolist()
                else:
                    ids = [token.id for token in tokenize(folded.decode())]
                which.append(k)
                if tail:
                    ids += tail[0]
                    self.closes[first + k] = tail[1]
                found.append(ids)
            else:
                text = core.decode("utf-8", "replace")
                if text.isalpha():
                    others.append((k, tail))
                    texts.append(text)
                else:
                    rest.append(k)
        pieces = self._letter_pieces(texts) if texts else []
        if pieces is None:
            rest.extend(k for k, _ in others)
        else:
            for (k, tail), piece in zip(others, pieces):
                ids = [token.id for token in tokenize(piece)]
                which.append(k)
                if tail:
                    ids += tail[0]
                    self.closes[first + k] = tail[1]
                found.append(ids)
        if which:
            self._put(first, which, np.array(list(chain.from_iterable(found)), np.uint32), np.array(list(map(len, found))))
        return rest

    def _forget(self) -> None:
        """Drop the later half of the words; those met first are the frequent ones."""
        kept = len(self.starts) // 2
        index = _Index()
        index.update(islice(self.index.items(), kept))
        starts, lengths = (np.frombuffer(x, np.int64)[:kept] for x in (self.starts, self.lengths))
        ends = np.cumsum(lengths)
        flat = np.frombuffer(self.flat, np.uint32)[np.repeat(starts - ends + lengths, lengths) + np.arange(lengths.sum())]
        self.index, self.flat, self.closes = index, array("I", flat.tobytes()), self.closes[:kept]
        self.starts, self.lengths = array("q", (ends - lengths).tobytes()), array("q", lengths.tobytes())

    def _learn(self, words: list[bytes]) -> None:
        """Encode words whose places follow the last known one."""
        first = len(self.starts)
        self.starts.frombytes(bytes(8 * len(words)))
        self.lengths.frombytes(bytes(8 * len(words)))
        self.closes.frombytes(bytes(len(words)))
        left = self._learn_letters(first, words) if self.fold else list(range(len(words)))
        texts = {k: words[k].decode("utf-8", "replace") for k in left}
        plain = [k for k, text in texts.items() if text.isalpha()] if self.ends_word is not None else []
        if plain:
            # letters only: in one call with the others, told apart by the word ends
            joined = self.tokenizer.encode_batch_fast(
                [" ".join([texts[k] for k in plain])], add_special_tokens=False)[0]
            ids = np.array(joined.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                self._put(first, plain, ids, np.diff(ends, prepend=0))
            else:
                plain = []
        known = set(plain)
        rest = [k for k in left if k not in known]
        if rest:
            found = [one.ids for one in self.tokenizer.encode_batch_fast(
                [texts[k] for k in rest], add_special_tokens=False)]
            self._put(first, rest, np.array(list(chain.from_iterable(found)), np.uint32),
                      np.array([len(ids) for ids in found]))
            for k in rest:
                self.closes[first + k] = words[k].rstrip(CLOSING).endswith(SENTENCE_ENDS)

    def _put(self, first: int, which: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        places = first + np.array(which)
        np.frombuffer(self.starts, np.int64)[places] = len(self.flat) + np.cumsum(lengths) - lengths
        np.frombuffer(self.lengths, np.int64)[places] = lengths
        self.flat.frombytes(ids.tobytes())

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words, the place of each word and the number of ids up to its end."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        lengths = np.frombuffer(self.lengths, np.int64)[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        source = np.repeat(np.frombuffer(self.starts, np.int64)[at] - ends + lengths, lengths)
        ids = np.frombuffer(self.flat, np.uint32)[source + np.arange(total)] if total else (
            np.empty(0, np.uint32))
        return ids, at, ends

    def _piece(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHED_WORDS:
            self._forget()
        ids, at, ends = self._look_up(words)
        return ids, ends[np.frombuffer(self.closes, np.int8)[at] > 0]

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bits) with the closing id, and the token counts at which sentences
        end, the document's end included."""
        if not self.by_word:
            ids = self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.array([*ids, self.end_id], np.uint32), np.array([len(ids) + 1])
        parts, ends, total = [], [], 0
        for piece in chunks(data):
            if words := piece.split():
                ids, closed = self._piece(words)
                parts.append(ids)
                ends.append(closed + total)
                total += len(ids)
        parts.append(np.array([self.end_id], np.uint32))
        last = np.concatenate(ends) if ends else np.empty(0, np.int64)
        if len(last) and last[-1] == total:  # the closing id stays with the last sentence
            last = last[:-1]
        return np.concatenate(parts), np.append(last, total + 1)

    def _together(self, words: list[bytes], lengths: list[int]) -> Iterator[np.ndarray]:
        """The ids of texts of so many words, each with an empty word behind it that has the closing id."""
        if len(self.index) > CACHED_WORDS:
            self._forget()
        if b"" not in self.index:
            self.index[b""] = len(self.index)
            self.starts.append(len(self.flat))
            self.lengths.append(1)
            self.closes.append(0)
            self.flat.append(self.end_id)
        ids, _, ends = self._look_up(words)
        start = 0
        for end in ends[np.cumsum(lengths) - 1].tolist():
            yield ids[start:end]
            start = end

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text as ``encode`` gives them, without sentence ends."""
        words, lengths = [], []
        for data in texts:
            short = self.by_word and len(data) <= CHUNK_BYTES
            if short:
                before = len(words)
                words += data.split()
                words.append(b"")
                lengths.append(len(words) - before)
            if lengths and (not short or len(words) >= TOGETHER):
                yield from self._together(words, lengths)
                words, lengths = [], []
            if not short:
                yield self.encode(data)[0]
        if lengths:
            yield from self._together(words, lengths)
