"""Polynomial prefix hashes of byte buffers, and word shingles from them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from searchloom.llm import workers

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A 64-bit value for each byte, so that small alphabets fill the hash's range.
_rng = np.random.default_rng(20_240_501)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _let_go() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


workers.at_change.append(_let_go)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def prefix_hashes(buffer: np.ndarray) -> np.ndarray:
    """H with H[0] = 0; the hash of buffer[i:j] is (H[j] - H[i]) * BASE**-i."""
    up, _ = powers(len(buffer))
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buffer] * up[: len(buffer)], out=out[1:])
    return out


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h + np.uint64((seed * 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


#: Bytes of a long text that are cut into words at a time.
SECTION = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _sections(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a section at a time."""
    at = 0
    while at < len(raw):
        end = SPACE.search(raw, at + SECTION) if len(raw) - at > SECTION else None
        upto = end.start() if end else len(raw)
        yield raw[at:upto].split()
        at = upto


def shingle_sets(texts: Iterable[str | None], width: int = 5, group_bytes: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first text, sorted distinct 64-bit shingle hashes of each) for groups of texts.

    Words are what stands between ASCII white space, in ASCII lower case; a text of fewer than ``width``
    words has its whole sequence as one shingle, and one without words none. A long text is taken in sections.
    """
    begin, docs, size, k = 0, [], 0, -1
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        if len(raw) > SECTION:
            if docs:
                yield begin, _group_sets(docs, width)
            yield k, [_long_set(raw, width)]
            begin, docs, size = k + 1, [], 0
            continue
        docs.append(raw.split())
        size += len(raw)
        if size >= group_bytes:
            yield begin, _group_sets(docs, width)
            begin, docs, size = k + 1, [], 0
    if docs:
        yield begin, _group_sets(docs, width)


def _long_set(raw: bytes, width: int) -> np.ndarray:
    last, parts = [], []
    for words in _sections(raw):
        if len(last) + len(words) >= width:
            parts += _group_sets([last + words], width)
        last = (last + words)[1 - width :] if width > 1 else []
    if not parts:
        parts = _group_sets([last], width)  # under ``width`` words in all
    return np.unique(np.concatenate(parts))


def _group_sets(docs: list[list[bytes]], width: int) -> list[np.ndarray]:
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in docs]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    h = prefix_hashes(np.frombuffer(b" ".join(flat), np.uint8))
    _, down = powers(len(h))
    out, at = [], 0
    for d in docs:
        n = len(d)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        first = starts[at : at + max(1, n - width + 1)]
        last = at + min(n, width) - 1 + np.arange(len(first))
        out.append(np.unique(mix((h[starts[last] + lengths[last]] - h[first]) * down[first])))
        at += n
    return out
