"""Ids of a lower-casing word-end BPE, the same as the tokenizers library gives, with each distinct word encoded once.

The vocabulary's normaliser and splitter never look across white space, so a text's ids are its words' ids in a row.
A word made of Latin-1 letters with other ASCII signs behind it is two or fewer library pre-tokens; its letters are
merged here, for many words at once, and kept. Every other word goes through the library,
which also finds the strings of special tokens in a text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

MAX_KEPT = 200_000
LONGEST = 40
#: Characters of texts that are split into words at a time; a longer text is split alone. Words take ten times their text.
AT_A_TIME = 1 << 19
_FAR = np.iinfo(np.int32).max
#: Letters whose lower case and composition are plain, and signs that form one pre-token (an apostrophe starts another).
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: itself where printable in Latin-1, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Merges of a word-end BPE over many words at once: in each round every word merges its first lowest-ranked pair."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(self.vocab.values()) + 1
        letters = byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([self.vocab[letters[b] + end] for b in range(256)], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _FAR)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, given as UTF-8 of at most LONGEST bytes."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(-(-len(word) // 6) * 6, []).append(i)
        for width, members in by_size.items():
            for at in range(0, len(members), 20_000):
                self._block([words[i] for i in members[at : at + 20_000]], members[at : at + 20_000], width, out)
        return out

    def _block(self, words: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        ids = np.full((len(words), width + 1), -1, dtype=np.int32)
        columns = np.arange(width)
        ids[:, :width] = np.where(columns < sizes[:, None], self.inner[raw], -1)
        ids[np.arange(len(words)), sizes - 1] = self.last[raw[np.arange(len(words)), sizes - 1]]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            first = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), first]
            go = least < _FAR
            if not go.all():
                done, step = ids[~go], 4 * ids.shape[1]
                data, ends = done.tobytes(), 4 * (done >= 0).sum(axis=1)
                for i, (r, end) in enumerate(zip(rows[~go].tolist(), ends.tolist(), strict=True)):
                    out[members[r]] = data[i * step : i * step + end]
                rows, ids, ranks, first, least = rows[go], ids[go], ranks[go], first[go], least[go]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            after = columns[None, :] > first[:, None]
            moved = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1)
            ids = np.where(np.concatenate([after, np.ones((len(rows), 1), bool)], axis=1), moved, ids)
            ids[each, first] = self.made[least]
            ranks = np.where(after, np.concatenate([ranks[:, 1:], np.full((len(rows), 1), _FAR, np.int32)], axis=1), ranks)
            ranks[each, first] = self._rank(ids[each, first], ids[each, first + 1])
            left = np.maximum(first - 1, 0)
            ranks[each, left] = np.where(first > 0, self._rank(ids[each, left], ids[each, first]), ranks[each, left])


class WordBpe:
    """Call with texts; returns each one's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = Merger(path)
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        if len(self.cores) > MAX_KEPT:
            self.cores = {}
        plain, other = [], []
        for word in new:
            core = word.rstrip(_SIGNS)
            if core.isalpha():  # of bytes: ASCII letters alone
                low = core.lower()
            elif _LETTERS.fullmatch(text := core.decode("utf-8", "replace")):
                low = text.lower().encode()
            else:
                other.append(word)
                continue
            if len(low) <= LONGEST and len(word) - len(core) <= LONGEST:
                plain.append((word, low, word[len(core) :]))
            else:
                other.append(word)
        parts = list({a for _, a, _ in plain}.union(b for _, _, b in plain if b).difference(self.cores))
        cores = self.cores
        cores.update(zip(parts, self.merge(parts), strict=True))
        self.words.update([(word, cores[a] + cores[b] if b else cores[a]) for word, a, b in plain])
        self.words.update(zip(other, self._by_library([w.decode("utf-8", "replace") for w in other]), strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        if len(self.words) > MAX_KEPT:
            self.words = {}
        self._learn(set().union(*split).difference(self.words))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, at, size = [], 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > AT_A_TIME:
                out += self._encode(texts[at:i])
                at, size = i, 0
            size += len(text)
        return out + self._encode(texts[at:])


@lru_cache(maxsize=1)
def loaded(path: str) -> WordBpe:
    """The tokenizer of this process: a Python worker's next tasks find the merges and the words kept so far."""
    return WordBpe(path)
