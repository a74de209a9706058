"""Hashes of all short stretches of texts, over Arrow arrays, and the filter that tells which of them are in use.

A stretch is a run of 4, 8 or 16 ASCII bytes.  Windows of a size are packed into whole numbers by doubling, for a block of bytes at
once, so a text of any length takes the memory of a block.  Equal hashes are no proof: what they find is tested.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZES = (4, 8, 16)
#: Bytes of text handled at once.
BLOCK_BYTES = 1 << 17
_HIGH_BITS = np.uint64(0x8080808080808080)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, starts, values = texts.buffers()
    offsets = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretch_hashes(lead: str, texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of all stretches of ``sizes`` in the texts; those of another ``lead`` differ."""
    if not len(texts):
        return
    data, offsets = _bytes_of(texts)
    for start in range(0, len(data), BLOCK_BYTES):
        end = min(start + BLOCK_BYTES, len(data))
        count = end - start
        # Bytes beyond the end are no ASCII.
        block = np.full(count + 16, 255, np.uint8)
        block[: min(count + 16, len(data) - start)] = data[start : end + 16]
        first, last = np.searchsorted(offsets, [start, end - 1], "right") - 1
        lengths = np.minimum(offsets[first + 1 : last + 2], end) - np.maximum(offsets[first : last + 1], start)
        rows = np.repeat(np.arange(first, last + 1), lengths)
        room = offsets[rows + 1] - np.arange(start, end)
        one = block.astype(np.uint64)
        two = one[:-1] | one[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        for size in sizes:
            packed = (four if size == 4 else eight)[:count]
            fits = (room >= size) & (packed & _HIGH_BITS == 0)
            if size == 16:
                fits &= eight[8 : count + 8] & _HIGH_BITS == 0
            places = np.flatnonzero(fits)
            seed = np.uint64((ord(lead) << 8 | size) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            hashes = _mixed(packed[places] ^ seed)
            if size == 16:
                hashes = _mixed(hashes ^ eight[places + 8])
            yield rows[places], hashes


def listed_hashes(stretches: pa.Array) -> pa.Array:
    """The hash of each stretch that is led by its side's letter; null for other texts."""
    found, known = np.zeros(len(stretches), np.uint64), np.zeros(len(stretches), bool)
    lengths = pc.fill_null(pc.utf8_length(stretches), 0).to_numpy(zero_copy_only=False)
    leads = pc.fill_null(pc.utf8_slice_codeunits(stretches, 0, 1), "")
    for lead in pc.unique(leads).to_pylist():
        for size in SIZES:
            own = pc.equal(leads, lead).to_numpy(zero_copy_only=False) & (lengths == size + 1)
            texts = pc.utf8_slice_codeunits(stretches.filter(pa.array(own)), 1)
            places = np.flatnonzero(own)
            for rows, hashes in stretch_hashes(lead, texts, [size]):
                found[places[rows]], known[places[rows]] = hashes, True
    return pa.array(found.view(np.int64), mask=~known)


def passing(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash: its word has the four bits the hash asks for."""
    bits = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << (hashes >> np.uint64(6 * k) & np.uint64(63))
    places = hashes >> np.uint64(65 - len(words).bit_length()) if len(words) > 1 else np.zeros(len(hashes), np.uint64)
    return words[places.astype(np.int64)] & bits == bits


def offered(sides: dict[str, pa.Array], sizes: Sequence[int], words: np.ndarray) -> pa.Array:
    """For each row the different hashes of its sides' stretches that pass the filter."""
    count = len(next(iter(sides.values())))
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lead, texts in sides.items():
        for own, found in stretch_hashes(lead, texts, sizes):
            kept = passing(found, words)
            rows.append(own[kept])
            hashes.append(found[kept])
    row, found = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[new], found[new]
    offsets = np.searchsorted(row, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64)))
