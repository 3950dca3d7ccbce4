"""Words of texts as 128-bit numbers, so that runs of words are compared as arrays.

Words end at ASCII white space. A word of up to 32 bytes gets two 64-bit numbers by rounds that
take eight bytes each and are bijections of them; no sums of bytes are taken that different
words could share. Longer words get their BLAKE2 digest. Hashes of runs are taken over these numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from .repeats import grouped

_SPACE = re.compile(rb"[\x09-\x0D ]")
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 19  # bytes that are worked on at once
_SHORT = 32  # bytes of a word that is mixed in rounds
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Odd multipliers of the rounds of either number: any odd numbers do.
_ODD = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into parts of about half a megabyte."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > _CHUNK:
            found = _SPACE.search(text, at + _CHUNK)
            end = found.start() if found else end
        yield text if end - at == len(text) else text[at:end]
        at = end


def _numbers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of ``data``, and a row of two numbers for each."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_GAP[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    starts = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - starts
    out = np.empty((len(starts), 2), np.uint64)
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,)).copy()
    state = [sizes.astype(np.uint64) * np.uint64(a) for a, _ in _ODD]
    live = None  # all words
    for at in range(0, _SHORT, 8):
        if live is None:
            where, rest = starts, sizes
        else:
            live = live[sizes[live] > at]
            if not len(live):
                break
            where, rest = starts[live] + at, sizes[live] - at
        chunk = eight[where] & _MASKS[np.minimum(rest, 8)]
        for k, (a, b) in enumerate(_ODD):
            x = (state[k] if live is None else state[k][live]) ^ chunk
            x *= np.uint64(a)
            x ^= x >> np.uint64(32)
            x *= np.uint64(b)
            x ^= x >> np.uint64(29)
            if live is None:
                state[k] = x
            else:
                state[k][live] = x
        if live is None:
            live = np.flatnonzero(sizes > 8)
    out[:, 0], out[:, 1] = state
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        word = data[starts[i] : starts[i] + sizes[i]]
        out[i] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), "<u8")
    return starts, out


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and a row of two numbers for each word of all texts."""
    sizes, parts = np.zeros(len(texts), np.int64), [np.zeros((0, 2), np.uint64)]
    for a, b in grouped([len(x) for x in texts], _CHUNK):
        if b - a == 1:
            for piece in pieces(texts[a]):
                parts.append(_numbers(piece)[1])
                sizes[a] += len(parts[-1])
            continue
        starts, numbers = _numbers(b"\n".join(texts[a:b]))
        ends = np.cumsum([len(x) + 1 for x in texts[a:b]])
        sizes[a:b] = np.diff(np.searchsorted(starts, ends), prepend=0)
        parts.append(numbers)
    return sizes, parts[1] if len(parts) == 2 else np.concatenate(parts)
