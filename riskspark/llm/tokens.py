"""Token ids of whole texts with few calls of a tokenizer.

A pre-tokenizer of the GPT-2 kind always cuts before a single space between two characters
that are not white space, around a single line feed between two such ones, where an ASCII
letter is followed by an ASCII mark, and where a mark other than the apostrophe is followed
by a letter; what comes after such a place does not depend on what was before.  So a text's ids
are the ids of its pieces in a row.  Pieces are cut and hashed as arrays over a batch
of texts; each different one is encoded once and kept for the next batches, and the texts'
ids are gathered from a pool.  Two pieces are taken for one only if two 64-bit hashes agree.

Special tokens of a library are pieces of their own wherever a text holds them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Bytes besides the space that are white space or taken for it by some pattern engines (fixed values).
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: White space of two and three UTF-8 bytes (fixed values: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_2 = np.array(sorted(b[0] << 8 | b[1] for b in _WIDE if len(b) == 2))
_WIDE_3 = np.array(sorted(b[0] << 16 | b[1] << 8 | b[2] for b in _WIDE if len(b) == 3))
#: Marks that make one pre-token with each other, behind letters too (fixed values: ASCII punctuation but the apostrophe).
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Words that are kept between batches, and bytes of one text that are worked on at once.
KEPT_WORDS, PART_BYTES = 1_000_000, 1 << 22


def _lone(data: np.ndarray, offsets: np.ndarray, byte: int) -> np.ndarray:
    """Where ``byte``, a white space, stands inside a text between two characters that are not white space."""
    at = np.flatnonzero(data == byte)
    inside = np.ones(data.size, bool)  # not a text's first or last byte
    filled = offsets[:-1] < offsets[1:]
    inside[offsets[:-1][filled]] = False
    inside[offsets[1:][filled] - 1] = False
    at = at[inside[at]]
    bad = _OTHER | (np.arange(256) == 0x20)
    at = at[~(bad[data[at - 1]] | bad[data[at + 1]])]
    wide = np.flatnonzero((data[at - 1] >= 0x80) | (data[at + 1] >= 0x80))
    if wide.size:
        x = np.concatenate([[0, 0, 0], data, [0, 0, 0]]).astype(np.int64)
        i = at[wide] + 3
        two, three = (lambda p: x[p] << 8 | x[p + 1]), (lambda p: x[p] << 16 | x[p + 1] << 8 | x[p + 2])
        near = np.isin(two(i - 2), _WIDE_2) | np.isin(three(i - 3), _WIDE_3) | np.isin(two(i + 1), _WIDE_2) | np.isin(three(i + 1), _WIDE_3)
        at = np.delete(at, wide[near])
    return at


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions inside texts where a piece begins, ascending."""
    feeds = _lone(data, offsets, 0x0A)
    letter, mark = _LETTER[data], _MARK[data]
    turn = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != 0x27) & letter[1:])) + 1
    begins = np.zeros(data.size, bool)
    for at in (_lone(data, offsets, 0x20), feeds, feeds + 1, turn):
        begins[at] = True
    begins[offsets[:-1][offsets[:-1] < data.size]] = False
    return np.flatnonzero(begins)


class WordCoder:
    """Ids of texts; ``encode`` gives those of a list of pieces as little-endian 32-bit, ``special`` those of special tokens."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: dict[str, int] | None = None):
        self.encode = encode
        self.special = {t.encode(): i.to_bytes(4, "little") for t, i in (special or {}).items()}
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.keys, self.check = np.zeros(0, K.U64), np.zeros(0, K.U64)
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.now = np.zeros(0, np.uint32), 0

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, ids, offsets) for runs of texts lo to hi - 1; null is empty. The offsets cut the ids by text."""
        data, offsets = K.text_bytes(texts)
        for lo, hi in K.pieces(offsets):
            part = offsets[lo : hi + 1]
            yield lo, hi, *self.run(data[part[0] : part[-1]], part - part[0])

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, _, ids, offsets in self.column(pa.array(texts, pa.string())):
            yield from (ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not data.size:
            return np.zeros(0, np.uint32), np.zeros(offsets.size, np.int64)
        spaces = self._around_special(data, offsets, cuts(data, offsets))
        if offsets.size == 2 and data.size > 2 * PART_BYTES:  # one long text, in parts that end before a cut
            last = spaces[np.searchsorted(spaces, np.arange(PART_BYTES, data.size - PART_BYTES, PART_BYTES)).clip(max=max(0, spaces.size - 1))] if spaces.size else spaces
            edges = np.unique(np.concatenate([[0], last, [data.size]]))
            ids = [self._ids(data[a:b], np.unique(np.append(spaces[(spaces > a) & (spaces < b)] - a, 0)))[0] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            ids = np.concatenate(ids)
            return ids, np.where(offsets > 0, len(ids), 0)
        begins = np.zeros(data.size, bool)
        begins[spaces] = True
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ids, ends = self._ids(data, starts)
        of_text = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids, of_text

    def _around_special(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cuts with those at both ends of special tokens, and without those inside them."""
        if self.find is None:
            return at
        raw = data.tobytes()
        if not any(t in raw for t in self.special):
            return at
        found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.find.finditer(raw, a, b)]
        inside = np.zeros(data.size + 1, np.int64)
        for a, b in found:
            inside[a + 1] += 1
            inside[b] -= 1
        at = at[np.cumsum(inside)[at] == 0]
        ends = np.array(found, np.int64).ravel()
        return np.union1d(at, np.setdiff1d(ends, offsets))

    def _ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at ``starts``, and how many there are up to each piece's end."""
        stops = np.append(starts[1:], data.size)
        coded = pa.array(K.Spans(data).hash(starts, stops)).dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.empty(words.size, np.int64)
        first[which[::-1]] = np.arange(which.size)[::-1]
        checks = K.Spans(data, 1).hash(starts, stops)
        check = checks[first]
        self.now += 1
        at = np.searchsorted(self.keys, words)
        known = np.zeros(words.size, bool)
        inner = at < self.keys.size
        known[inner] = self.keys[at[inner]] == words[inner]
        if (checks != check[which]).any() or (self.check[at[known]] != check[known]).any():
            return self._by_text(data, starts, stops)
        if not known.all():
            fresh = np.flatnonzero(~known)
            fresh = fresh[np.argsort(words[fresh])]
            new = first[fresh]
            raw = data.tobytes()
            got = self._encoded([raw[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist())])
            sizes = np.array([len(c) for c in got], np.int64) // 4
            begin = self.pool.size + np.cumsum(sizes) - sizes
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(got), "<u4")])
            place = at[fresh]
            self.keys, self.check, self.start, self.size, self.used = (
                np.insert(x, place, y) for x, y in ((self.keys, words[fresh]), (self.check, check[fresh]), (self.start, begin), (self.size, sizes), (self.used, self.now))
            )
            at = np.searchsorted(self.keys, words)
        self.used[at] = self.now
        start, size = self.start[at][which], self.size[at][which]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(start - ends + size, size) + np.arange(ends[-1] if ends.size else 0)]
        if self.keys.size > KEPT_WORDS:
            self._forget()
        return ids, ends

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        if not any(p in self.special for p in pieces):
            return self.encode([p.decode() for p in pieces])
        plain = [p for p in pieces if p not in self.special]
        got = dict(zip(plain, self.encode([p.decode() for p in plain]), strict=True)) | self.special
        return [got[p] for p in pieces]

    def _by_text(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the pieces' bytes, for a batch in which two different ones have one hash."""
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        every = list(dict.fromkeys(pieces))
        got = dict(zip(every, self._encoded(every), strict=True))
        ids = np.frombuffer(b"".join(got[p] for p in pieces), "<u4")
        return ids, np.cumsum([len(got[p]) // 4 for p in pieces])

    def _forget(self) -> None:
        """Keep the half that was used last."""
        order = np.sort(np.argsort(self.used, kind="stable")[self.keys.size // 2 :])
        self.keys, self.check, self.used, start, size = self.keys[order], self.check[order], self.used[order], self.start[order], self.size[order]
        ends = np.cumsum(size)
        self.pool = self.pool[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        self.start, self.size = ends - size, size


class PreTokenCoder:
    """Ids of words by their pre-tokens, each encoded once and kept for a while.

    ``encode``: ids of a list of pre-tokens.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str):
        import regex

        self.encode, self.split = encode, regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def tokens(self, word: str) -> list[str]:
        """Pre-tokens: most words are a space, letters and perhaps marks behind them."""
        body = word[1:] if word[0] == " " else word
        if body.isalpha():
            return [word]
        letters = body.rstrip(MARKS)
        if letters.isalpha():
            n = len(word) - len(body) + len(letters)
            return [word[:n], word[n:]]
        return self.split(word)

    def __call__(self, words: list[str]) -> list[bytes]:
        kept, split = self.kept, [self.tokens(w) for w in words]
        new = list(set().union(*split).difference(kept))
        kept.update(zip(new, self.encode(new), strict=True))
        get = kept.__getitem__
        out = [get(t[0]) if len(t) == 1 else b"".join(map(get, t)) for t in split]
        if len(kept) > KEPT_WORDS // 4:
            kept.clear()
        return out


@lru_cache(maxsize=2)
def library_coder(path: str, pattern: str) -> WordCoder:
    """Ids by the ``tokenizers`` library, no special tokens added but those in a text found; one coder for each Python worker.

    ``pattern``: how the tokenizer cuts pre-tokens.  Pre-tokens of a space and letters are encoded
    in long rows: there, tokens that begin with a space are just the first ones of each.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {}
    for i, token in tokenizer.get_added_tokens_decoder().items():
        if token.lstrip or token.rstrip or token.single_word:
            raise ValueError(f"special token {token.content!r} takes in what is around it")
        special[token.content] = i
    space_led = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        space_led[i] = token.startswith("Ġ")  # how byte-level vocabularies write a space

    def library(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for lo in range(0, len(texts), 4096) for e in tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]

    def rows(words: list[str]) -> Iterator[bytes]:
        parts = [words[lo : lo + 2000] for lo in range(0, len(words), 2000)]
        for part, ids in zip(parts, library(["".join(p) for p in parts]), strict=True):
            starts = np.flatnonzero(space_led[ids])
            if len(starts) != len(part):  # another idea of what a letter is
                yield from (x.tobytes() for x in library(part))
                continue
            blob, at = ids.tobytes(), (starts * 4).tolist() + [4 * len(ids)]
            yield from (blob[a:b] for a, b in zip(at, at[1:]))

    def encode(tokens: list[str]) -> list[bytes]:
        led = [t for t in tokens if t[0] == " " and t[1:].isalpha()]
        got = dict(zip(led, rows(led), strict=True))
        rest = [t for t in tokens if t not in got]
        got.update(zip(rest, (x.tobytes() for x in library(rest)), strict=True))
        return [got[t] for t in tokens]

    return WordCoder(PreTokenCoder(encode, pattern), special)
