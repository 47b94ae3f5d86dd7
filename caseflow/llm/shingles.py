"""Word-shingle sets of texts, many texts at a time in numpy. Used inside tasks only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: A-Z to a-z; other bytes stay, and all of those of multi-byte characters.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(9, 14)]] = True
_seed = np.random.default_rng(20240229)
BYTE_VALUES = _seed.integers(0, 2**64, 256, dtype=U64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK * 5 // 4)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of lower-cased texts of about ``CHUNK`` bytes with the index of their first; a longer text is alone in its run."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if run and size + len(raw) > CHUNK:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``width``-word shingles; a shorter text's whole sequence is its only one."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANK[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, U64)] * len(texts)
    up, down = _power_tables(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUES[joined] * up[: len(joined)], dtype=U64)))
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64) * U64(BASE))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    grams = words.copy()
    for k in range(1, width):
        grams = mix(grams[:-1] * U64(BASE) + words[k:])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = words[a]
            with np.errstate(over="ignore"):
                for w in words[a + 1 : b]:
                    short = mix(np.array([short * U64(BASE) + w]))[0]
                out.append(mix(np.array([short + U64(b - a)])))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()
