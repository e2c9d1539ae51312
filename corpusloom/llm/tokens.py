"""Tokenizer ids of whole texts, inside tasks.

Byte-level BPE cuts a text before every single space that starts a word, so the ids of a text are the ids of its
words, each with its leading space. A batch's words are told apart by Arrow's dictionary encoding; each distinct
word is encoded once per worker and its ids are kept, under the word itself, in a bounded pool; a text's ids are
gathered from the pool. First words of texts, and texts where white space isn't so plain, are encoded as they are.
Vocabularies of words with a word's end (WordEncoder) drop white space, so that each word stands for itself.
Strings of special tokens in a text are those tokens, as they are by the library's default, or ordinary text if so asked.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm.textkit import SPACE, Words

POOL_BYTES = 96 << 20
WORD_BYTES = 160  # what a word costs in the pool besides its letters
JOINED = 500
_BEFORE_SPACE = [chr(c) + " " for c in range(0x3001) if re.match(r"\s", chr(c))]
_encoders: dict[tuple, "Encoder"] = {}


_KINDS = np.zeros(256, np.int8)  # ASCII letters 1; ASCII marks 2, but for the apostrophe, which may open a word's ending
_KINDS[[b for b in range(33, 127) if chr(b).isalpha()]] = 1
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2


class Encoder:
    """Texts to ids of 16 bits (the vocabulary must fit). pool_bytes bounds the pool: beyond it, it starts anew.

    plain: strings of special tokens are ordinary text."""

    def __init__(self, path: str, pool_bytes: int = POOL_BYTES, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = () if plain else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids don't fit in 16 bits")
        spelled = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens, self.closes = np.array([t.startswith("Ġ") for t in spelled]), np.array([t.endswith("</w>") for t in spelled])
        self.pool_bytes = pool_bytes
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.at, self.size, self.pool, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2"), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with a leading space, one after another, and how many each has; words hold no space.
        Many are encoded as one text: an id whose token starts with a space starts a word."""
        texts, counts = [], []
        run: list[str] = []
        for word in words:
            if word[0].isspace() or len(run) == JOINED:
                if run:
                    texts.append("".join(run))
                    counts.append(len(run))
                run = []
            if word[0].isspace():
                texts.append(" " + word)
                counts.append(1)
            else:
                run.append(" " + word)
        if run:
            texts.append("".join(run))
            counts.append(len(run))
        ids, sizes = [], []
        for text, count, found in zip(texts, counts, self.whole(texts)):
            starts = np.flatnonzero(self.opens[found])
            if count == 1:
                starts = np.zeros(1, np.int64)
            if len(starts) != count:
                raise ValueError("this vocabulary doesn't cut texts before spaces")
            ids.append(found)
            sizes.append(np.diff(starts, append=len(found)))
        return np.concatenate([np.zeros(0, "<u2"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _learn(self, words: list[str]) -> None:
        self._add(words, *self._spaced(words))

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])
        self.held += sum(map(len, words)) + WORD_BYTES * len(words)

    def _rows_of(self, words: list[str]) -> np.ndarray:
        """The pool's row of each of these distinct words (an empty one, which has no ids, gets row 0)."""
        known = self.rows.get
        rows = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(rows < 0) if words[i]]
        if new and self.held > self.pool_bytes:
            self._forget()
            new = [w for w in words if w]
        if new:
            self._learn(new)
            known = self.rows.get
            rows = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        return np.maximum(rows, 0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more at the end). A null text has none, like an empty one."""
        strings = texts.to_pylist()
        odd = [i for i, t in enumerate(strings) if t and (t[0] == " " or t[-1] == " " or any(x in t for x in _BEFORE_SPACE) or any(x in t for x in self.special))]
        apart = set(odd)
        if odd:
            texts = pa.array([None if i in apart else t for i, t in enumerate(strings)], pa.large_string())
        lists = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        first = np.asarray(lists.offsets).astype(np.int64)
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = first[:-1]  # each text has a first piece, maybe an empty one
        plain = ["" if i in apart or not t else t.partition(" ")[0] for i, t in enumerate(strings)]
        own = self.whole(plain) + self.whole([strings[i] for i in odd])
        row = self._rows_of(words)[coded.indices.to_numpy(zero_copy_only=False)]
        own_size = np.fromiter(map(len, own), np.int64, len(own))
        own_at = len(self.pool) + np.cumsum(own_size) - own_size
        pool = np.concatenate([self.pool, *own])
        at, size = (x[row] if len(x) else np.zeros(len(row), np.int64) for x in (self.at, self.size))
        at[heads], size[heads] = own_at[: len(heads)], own_size[: len(heads)]
        at[heads[odd]], size[heads[odd]] = own_at[len(heads) :], own_size[len(heads) :]  # an odd text is one piece
        ends = np.cumsum(size)
        ids = pool[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first]

    def encode_each(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, first = self.encode(texts)
        raw = ids.tobytes()
        return [raw[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


class WordEncoder(Encoder):
    """For vocabularies that drop white space, mark the ends of words and part letters from marks: a text's ids are those
    of its words, and a word's those of its stretches of letters and of marks."""

    def _learn(self, words: list[str]) -> None:
        others = [w for w in words if not w.isalpha()]
        letters = [w for w in words if w.isalpha()] if others else words
        runs = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        for run, ids in zip(runs, self.whole([" ".join(run) for run in runs])):
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(run):  # each is one word of the vocabulary's rules
                self._add(run, ids, np.diff(last, prepend=-1))
            else:
                others += run
        for i in range(0, len(others), JOINED):
            self._add(others[i : i + JOINED], *self._set_apart(others[i : i + JOINED]))

    def _set_apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, many as one text, between special tokens, which cut a text before all else."""
        if not self.special or any(x in w for w in words for x in self.special):
            found = self.whole(words)
            return np.concatenate([np.zeros(0, "<u2"), *found]), np.fromiter(map(len, found), np.int64, len(found))
        mark, end = self.special[0], self.tokenizer.token_to_id(self.special[0])
        (ids,) = self.whole([mark.join([*words, ""])])
        return ids[ids != end], np.diff(np.flatnonzero(ids == end), prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        starts, ends, first = words.starts, words.ends, words.first
        raw = words.data.tobytes()
        if not any(x.encode() in raw for x in self.special):
            kind = _KINDS[words.data]
            edge = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1  # a letter beside a mark
            at = np.zeros(len(kind) + 1, bool)
            at[starts] = at[edge] = True
            starts = np.flatnonzero(at)
            at[:] = False
            at[ends] = at[edge] = True
            ends, first = np.flatnonzero(at), np.searchsorted(starts, words.offsets)
        ink = words.data[~SPACE[words.data]]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ink)))
        coded = spelled.dictionary_encode()
        row = self._rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        at, size = (x[row] if len(x) else np.zeros(len(row), np.int64) for x in (self.at, self.size))
        after = np.cumsum(size)
        ids = self.pool[np.repeat(at - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate([[0], after])[first]


def encoder(path: str, plain: bool = False, words: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file; words: one that drops white space."""
    if (path, plain, words) not in _encoders:
        _encoders[path, plain, words] = (WordEncoder if words else Encoder)(path, plain=plain)
    return _encoders[path, plain, words]
