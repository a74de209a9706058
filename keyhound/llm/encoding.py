"""Token ids of many texts at once, equal to those the tokenizers library gives for each whole text.

A byte-level vocabulary splits a text before it looks for tokens, so a text may be cut wherever such a split
is certain, and every distinct part needs to be encoded once.  Cuts are found over the bytes of many texts:

* before a run of white space, before its last sign, and after that one unless it is a blank (which belongs
  to the next word);
* between ASCII letters, digits and other signs, except behind an apostrophe, which may start a contraction.

Nothing is cut beside a sign that may count as white space or not.  Parts of up to 16 bytes are looked
up by their bytes in a hash table held in arrays; longer ones in a dictionary; those above ``LONGEST`` bytes are not
remembered.  Both stores are bounded in bytes, whatever the text: a full one starts anew.

Texts that hold an added token of the vocabulary, and all texts of a tokenizer that is not byte-level,
go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import chain

import numpy as np

#: Parts in the table, and their ids: together at most some 35 MB.
TABLE_PARTS, TABLE_IDS = 1 << 19, 1 << 21
#: Bytes of keys and ids in the dictionary of longer parts.
STORE_BYTES = 8 << 20
LONGEST = 256
#: Bytes of text cut at once, parts looked up at once, and parts the library encodes at once.
_PIECE, _LOOKED_UP, _ENCODED = 1 << 19, 1 << 17, 2_000
_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER, _UNSURE = range(6)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = _LETTER
    kinds[128:] = _OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[28:32] = _UNSURE
    return kinds


_KIND = _kinds()
#: Cuts between a byte of one kind and the next, apart from white space.
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _SIGN), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _SIGN), (_SIGN, _DIGIT), (_SIGN, _LETTER)):
    _CUT[_a, _b] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; signs beyond ASCII that may be white space are unsure."""
    kind = _KIND[data]
    for lead, second, third in ((0xC2, (0x80, 0xA0), None), (0xE1, (0x9A, 0xA0), (0x80, 0x8E)), (0xE2, (0x80, 0x81), (0x80, 0xAF)), (0xE3, (0x80, 0x80), (0x80, 0x80))):
        at = np.flatnonzero(data[:-1] == lead) if len(data) else np.zeros(0, np.int64)
        at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
        if third:
            at = at[at + 2 < len(data)]
            at = at[(data[at + 2] >= third[0]) & (data[at + 2] <= third[1])]
            kind[at + 2] = _UNSURE
        kind[at] = kind[at + 1] = _UNSURE
    return kind


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of parts, each text's start among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds_of(data)
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(n, bool)
    cut[1:] = _CUT[before, after] & ~((data[:-1] == 39) & (after == _LETTER))
    space = kind == _SPACE
    solid = kind < _SPACE
    solid |= kind == _OTHER
    cut[1:] |= solid[:-1] & space[1:]  # a run begins
    edges = offsets[offsets < n]
    last = space[:-1] & solid[1:]  # the last sign of a run
    last[edges[edges > 0] - 1] = False  # what follows there is another text
    ends = np.flatnonzero(last)
    cut[ends[(ends > 0) & space[ends - 1]]] = True
    cut[ends[data[ends] != 32] + 1] = True
    cut[edges] = True
    return np.flatnonzero(cut)


class _Table:
    """Ids of short parts: two words of bytes and a length → a stretch of a pool."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.mask = 2 * TABLE_PARTS - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.low, self.high, self.size = (np.zeros(TABLE_PARTS, t) for t in (np.uint64, np.uint64, np.uint8))
        self.start, self.count = np.zeros(TABLE_PARTS, np.int32), np.zeros(TABLE_PARTS, np.int32)
        self.pool, self.used, self.parts = np.zeros(1 << 16, np.int32), 0, 0

    def _home(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ size) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each part, or -1."""
        at = self._home(low, high, size)
        entry = self.slot[at]
        wrong = self._wrong(entry, low, high, size)
        left = np.flatnonzero(wrong)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.slot[at[left]]
            entry[left] = found
            left = left[self._wrong(found, low[left], high[left], size[left])]
        return entry

    def _wrong(self, entry, low, high, size) -> np.ndarray:
        return (entry >= 0) & ((self.low[entry] != low) | (self.high[entry] != high) | (self.size[entry] != size))

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct new parts with their ids one after another; there is room for them."""
        n, total = len(low), len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        new = np.arange(self.parts, self.parts + n)
        self.low[new], self.high[new], self.size[new] = low, high, size
        self.count[new] = counts
        self.start[new] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + total] = ids
        self.used, self.parts = self.used + total, self.parts + n
        at = self._home(low, high, size)
        while len(new):
            free = self.slot[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            chosen = np.flatnonzero(free)[first]
            self.slot[at[chosen]] = new[chosen]
            rest = np.ones(len(new), bool)
            rest[chosen] = False
            new, at = new[rest], (at[rest] + 1) & self.mask


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        rule = settings.get("pre_tokenizer") or {}
        self.byte_level = (
            settings.get("normalizer") is None
            and rule.get("type") == "ByteLevel"
            and rule.get("use_regex", True)
            and not rule.get("add_prefix_space")
            and not (settings.get("truncation") or settings.get("padding"))
        )
        self.added = [x["content"].encode() for x in settings.get("added_tokens") or []]
        self.table = _Table()
        self.longer: dict[bytes, np.ndarray] = {}
        self.longer_bytes = 0

    def _library(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each part has."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start in range(0, len(parts), _ENCODED):
            texts = [x.decode("utf-8", "replace") for x in parts[start : start + _ENCODED]]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(counts[-1].sum())))
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's."""
        out: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for k, text in enumerate(texts):
            whole = not self.byte_level or any(x in text for x in self.added)
            if not whole:
                held.append(text)
                size += len(text)
            if held and (whole or size >= _PIECE or k + 1 == len(texts)):
                found, counts = self._parts(held)
                out.append(found)
                sizes.append(counts)
                held, size = [], 0
            if whole:
                found, counts = self._library([text])
                out.append(found)
                sizes.append(counts)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        return np.concatenate([np.zeros(0, np.int32), *out]), offsets

    def _parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of some texts; parts are looked up so many at a time."""
        joined = b"".join(texts)
        data = np.frombuffer(joined + bytes(16), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        starts = cuts(data[: len(joined)], offsets)
        ends = np.append(starts[1:], len(joined))
        if len(starts) <= _LOOKED_UP:
            ids, counts = self._look_up(joined, data, starts, ends)
        else:
            steps = range(0, len(starts), _LOOKED_UP)
            found = [self._look_up(joined, data, starts[k : k + _LOOKED_UP], ends[k : k + _LOOKED_UP]) for k in steps]
            ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = sums[np.searchsorted(starts, offsets)]
        return ids, np.diff(at)

    def _look_up(self, joined: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        short = np.flatnonzero(size <= 16)
        long = np.flatnonzero(size > 16)
        begin, length = starts[short], size[short]
        low = words[begin] & _MASK[np.minimum(length, 8)]
        high = words[np.minimum(begin + 8, len(words) - 1)] & _MASK[np.clip(length - 8, 0, 8)]
        length = length.astype(np.uint8)
        entry = self.table.find(low, high, length)
        missing = np.flatnonzero(entry < 0)
        extra, extra_start, extra_count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(missing):
            keys = np.empty(len(missing), [("low", "u8"), ("high", "u8"), ("size", "u1")])
            keys["low"], keys["high"], keys["size"] = low[missing], high[missing], length[missing]
            by = np.lexsort((keys["size"], keys["high"], keys["low"]))
            ordered = keys[by]
            new = np.ones(len(by), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            first = missing[by[new]]
            number = np.empty(len(by), np.int64)
            number[by] = np.cumsum(new) - 1
            a, b = begin[first].tolist(), (begin[first] + length[first]).tolist()
            ids, counts = self._library([joined[x:y] for x, y in zip(a, b, strict=True)])
            if self.table.parts + len(first) <= TABLE_PARTS and self.table.used + len(ids) <= TABLE_IDS:
                self.table.add(low[first], high[first], length[first], ids, counts)
                entry[missing] = self.table.parts - len(first) + number
                missing = missing[:0]
            else:
                extra, extra_start, extra_count = ids, (np.cumsum(counts) - counts)[number], counts[number]
        # Ids come from the table's pool, from parts that found no room in it, and from long parts.
        pool = [self.table.pool[: self.table.used]]
        at, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], counts[short] = self.table.start[entry], self.table.count[entry]
        if len(missing):
            at[short[missing]], counts[short[missing]] = extra_start + len(pool[0]), extra_count
            pool.append(extra)
        if len(long):
            found = self._long_ones([joined[x:y] for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            counts[long] = sizes = np.fromiter(map(len, found), np.int64, len(found))
            at[long] = np.cumsum(sizes) - sizes + sum(map(len, pool))
            pool.extend(found)
        source = np.concatenate(pool) if len(pool) > 1 else pool[0]
        stops = np.cumsum(counts)
        ids = source[np.repeat(at - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0)]
        if len(missing):
            self.table.clear()
        return ids, counts

    def _long_ones(self, parts: list[bytes]) -> list[np.ndarray]:
        new = [x for x in dict.fromkeys(parts) if x not in self.longer]
        fresh: dict[bytes, np.ndarray] = {}
        if new:
            ids, counts = self._library(new)
            fresh = dict(zip(new, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        found = [fresh[x] if x in fresh else self.longer[x] for x in parts]
        for x, ids in fresh.items():
            if len(x) <= LONGEST:
                if self.longer_bytes > STORE_BYTES:
                    self.longer, self.longer_bytes = {}, 0
                self.longer[x] = ids.copy()
                self.longer_bytes += len(x) + 4 * len(ids) + 200
        return found


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def _texts(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and where each id's begin and how many there are."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    tokenizer = load(path)
    added = {k: x.content for k, x in tokenizer.get_added_tokens_decoder().items()}
    size = tokenizer.get_vocab_size()
    texts = [b""] * size
    for text, number in tokenizer.get_vocab().items():
        texts[number] = added[number].encode() if number in added else bytes(byte_of[c] for c in text)
    lengths = np.fromiter(map(len, texts), np.int64, size)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(path: str, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes that ids of a byte-level vocabulary stand for, and where each id's begin, with the end."""
    pool, start, length = _texts(path)
    counts = length[ids]
    ends = np.cumsum(counts)
    at = np.repeat(start[ids] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    return pool[at].tobytes(), np.concatenate([[0], ends])
