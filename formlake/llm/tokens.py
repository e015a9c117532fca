"""Token ids of whole text columns.

Both public tokenizers used here cut a text at ASCII white space before they merge anything, so the ids
of a text are those of its pieces put together. Every distinct piece of a slice is encoded by the
``tokenizers`` library once, and a worker keeps what it has encoded, up to a fixed number of pieces.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from formlake.llm import words as W

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores

SLICE_BYTES = 1 << 20
#: Pieces that a worker remembers, and the longest in bytes; about 40 MB. Then it starts anew.
KEPT_PIECES, KEPT_BYTES = 1_000_000, 64


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _open_boundary(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of places before white space, those after a character that pattern libraries count as white space."""
    one = data[np.maximum(at - 1, 0)]
    two = data[np.maximum(at - 2, 0)]
    three = data[np.maximum(at - 3, 0)]
    odd = (one >= 0x1C) & (one <= 0x1F)
    odd |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    odd |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    odd |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    odd |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    odd |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return odd


def _marks_after_letters(data: np.ndarray) -> np.ndarray:
    """Places of ASCII punctuation right after an ASCII letter or digit: no token spans such a place."""
    return np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1


def pieces_with_space(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that hold every byte, cut before white space and before punctuation that ends a word."""
    space = W.SPACE[data]
    turn = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins = np.zeros(len(data) + 1, bool)
    begins[turn[~_open_boundary(data, turn)]] = True
    begins[_marks_after_letters(data)] = True
    begins[at] = True
    starts = np.flatnonzero(begins[:-1])
    return starts, np.append(starts[1:], len(data))


def pieces_without_space(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, cut before punctuation that ends them."""
    starts, ends = W.edges(data, at)
    cut = _marks_after_letters(data)
    begins, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[starts] = begins[cut] = True
    stops[ends] = stops[cut] = True
    # Texts stand end to end: a cut where one text meets the next is a start and an end already.
    return np.flatnonzero(begins), np.flatnonzero(stops)


def set_apart(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Makes each span one piece of its own; the pieces on both sides end and start there."""
    if not spans:
        return starts, ends
    begins, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[starts] = stops[ends] = True
    # Bytes inside a piece: more pieces have started than have ended.
    inside = np.cumsum(begins[:-1].astype(np.int64) - stops[:-1]) > 0
    for a, b in spans:
        stops[a] |= a > 0 and inside[a - 1]
        begins[b] |= b < len(data) and inside[b]
    for a, b in spans:
        begins[a + 1:b] = stops[a + 1:b] = False
        begins[a] = stops[b] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


class Encoder:
    """Encodes text columns with one tokenizer.

    With ``special_ids`` the ids are those of ``encode(text, add_special_tokens=False)``: the string of a
    special token inside a text is that token. Without, it is ordinary text (the library's ``encode_special_tokens``).
    """

    def __init__(self, path: str, special_ids: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_ids
        self.added = self._added(special_ids)
        normalizer, pattern = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # A plain byte-level tokenizer keeps white space; the other kind drops it.
        self.spaced = normalizer is None
        if pattern is None:
            raise ValueError("the tokenizer doesn't cut at white space")
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._forget()

    def _added(self, special_ids: bool) -> re.Pattern | None:
        """The strings that the library takes out of a text before it cuts anything, the longest first."""
        tokens = [t for t in self.tokenizer.get_added_tokens_decoder().values() if special_ids or not t.special]
        for t in tokens:
            if t.single_word or t.lstrip or t.rstrip or t.normalized and self.tokenizer.normalizer is not None:
                raise ValueError(f"the added token {t.content!r} isn't a plain string")
        strings = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        return re.compile(b"|".join(map(re.escape, strings))) if strings else None

    def _spans(self, raw: bytes, at: np.ndarray) -> list[tuple[int, int]]:
        """Places of added tokens in the rows; none reaches over the end of a row."""
        if self.added is None or not self.added.search(raw):
            return []
        rows = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
        return [m.span() for a, b in rows for m in self.added.finditer(raw, a, b)]

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)
        self.arena = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists], np.int64)
        total = int(sizes.sum())
        while self.used + total > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        flat = np.fromiter((i for x in lists for i in x), np.uint32, total)
        self.arena[self.used:self.used + total] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += total
        return starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, row after row, and the n + 1 places where the rows start."""
        data, at = W.text_bytes(texts)
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        starts, ends = (pieces_with_space if self.spaced else pieces_without_space)(data, at)
        raw = data.tobytes()
        starts, ends = set_apart(data, starts, ends, self._spans(raw, at))
        rows = np.searchsorted(starts, at)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        hashes = W.hash_ranges(data, starts, ends, W.BYTE_VALUES)
        own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == own[inside]
        at_arena, n_ids = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        at_arena[known], n_ids[known] = self.starts[place[known]], self.sizes[place[known]]
        new = np.flatnonzero(~known)
        mark = self.used
        if len(new):
            cuts = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            strings = [raw[a:b].decode("utf-8", "replace") for a, b in cuts]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            at_arena[new], n_ids[new] = self._add(found)
        lengths = n_ids[which]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat((at_arena[which] - sums[:-1]).astype(np.int32), lengths)
        take += np.arange(sums[-1], dtype=np.int32)
        ids = self.arena.take(take)
        if len(new):
            short = new[(ends - starts)[first[new]] <= KEPT_BYTES]
            if len(short) < len(new):  # long pieces are rare and not worth the memory
                self.arena, self.used = self.arena.copy(), mark
                keep = np.arange(n_ids[short].sum()) + np.repeat(
                    at_arena[short] - (np.cumsum(n_ids[short]) - n_ids[short]), n_ids[short])
                kept = self.arena[keep]
                at_arena[short] = mark + np.cumsum(n_ids[short]) - n_ids[short]
                self.arena[mark:mark + len(kept)] = kept
                self.used = mark + len(kept)
            to = place[short]
            self.starts = np.insert(self.starts, to, at_arena[short])
            self.sizes = np.insert(self.sizes, to, n_ids[short])
            self.keys = np.insert(self.keys, to, own[short])
        return ids, sums[rows]

    def encode_with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the id ``end`` after every row."""
        ids, at = self.encode(texts)
        n = len(at) - 1
        return np.insert(ids, at[1:], end), at + np.arange(n + 1)


@lru_cache(maxsize=2)
def encoder(path: str, special_ids: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path, special_ids)
