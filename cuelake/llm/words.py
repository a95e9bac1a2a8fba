"""Words of many texts at once: byte classes, spans and position-free 64-bit hashes, all in numpy.

A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, so that a megabyte of text
costs a few array passes whatever its word lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to this many bytes and texts; longer ones are cut at white space.
CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 512
BLANKS = b" \t\n\x0b\x0c\r"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made into ``x``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _lower(byte: int) -> int:
    return byte + 32 if 65 <= byte <= 90 else byte


#: What a byte adds to a hash; A-Z count as a-z.
_VALUES = mix(np.array([_lower(b) + 1 for b in range(256)], dtype=np.uint64))

#: Words between white space.
SPACED = np.array([b not in BLANKS for b in range(256)])
#: Runs of letters, digits and bytes beyond ASCII: punctuation separates.
PLAIN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

#: Powers of a hash's base are kept up to this many; a longer stretch of text computes its own.
KEPT_POWERS = 1 << 23
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= KEPT_POWERS:
            _powers[base] = table
    return table


def pieces(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text in order, cut before white space into parts of about ``limit`` bytes."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(blank, at + 1, at + limit) for blank in (b" ", b"\n", b"\t", b"\r"))
        if cut < 0:
            ahead = [x for x in (text.find(blank, at + limit) for blank in (b" ", b"\n", b"\t", b"\r")) if x >= 0]
            cut = min(ahead, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def spans(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each word, its end, index of its text)."""
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], kind[joined], [False]))))
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return joined, edges[::2], edges[1::2], np.searchsorted(first, edges[::2], side="right") - 1


def hash_spans(joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[joined] * _power_table(_BASE, len(joined))[: len(joined)], out=sums[1:])
    value = (sums[end] - sums[start]) * _power_table(_INVERSE, len(joined) + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes(texts: list[bytes], kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in the order of the texts."""
    joined, start, end, owner = spans(texts, kind)
    return hash_spans(joined, start, end), owner


def by_text(texts: list[bytes | None], kind: np.ndarray = SPACED) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, word hashes of each text) for groups of neighbouring texts.

    A group holds about CHUNK_BYTES of text, or one longer text whose words were hashed piece by piece.
    """
    group: list[bytes] = []
    size = first = 0
    for k, text in enumerate(texts):
        text = text or b""
        if group and (size + len(text) > CHUNK_BYTES or len(group) == CHUNK_TEXTS):
            yield first, _split(group, kind)
            group, size, first = [], 0, k
        if len(text) > CHUNK_BYTES:
            yield k, [np.concatenate([hashes([p], kind)[0] for p in pieces(text)])]
            first = k + 1
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        yield first, _split(group, kind)


def _split(group: list[bytes], kind: np.ndarray) -> list[np.ndarray]:
    value, owner = hashes(group, kind)
    return np.split(value, np.searchsorted(owner, np.arange(1, len(group))))
