"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least ``exponent`` times q and ``shortest`` words long, that no neighbouring word
extends. Periods are sought scale by scale, q from L to 2 L - 1 for L = 1, 2, 4 and so on. At scale L a document is cut into blocks of L
words, and for each block the sum of squared differences to every place L to 2 L - 1 words later is computed by a convolution: number-theoretic
transforms modulo 2**16 + 1, exact in integers and without any rounding. Only places without a mismatch give zero. A run of four
periods or more holds enough whole blocks in a row that all fit at distance q, so blocks in a row with one distance are the seeds; seeds inside a run that is already
known (of a shorter period, then) are dropped; the others are extended word by word, which also sorts out sums that are multiples of the modulus.
Blocks are never longer than 2**15 words: at larger scales several transforms cover a block's distances.

Work is n log(n)**2 for a document of n words, and a little more beyond 2**17 words; memory follows the longest text, as one
document is handled in one task. Documents are independent of one another, so nothing is shuffled. Null texts have no words, nor
have empty ones. Repeated rows and null ids are rows like others; an empty table gives an empty result. Columns other than the text and
``keep`` are ignored, and those of ``keep`` that clash with a result are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import bounded_batches

MODULUS = 2**16 + 1
#: A generator of the numbers modulo ``MODULUS``.
GENERATOR = 3
LONGEST_BLOCK = 1 << 15
#: Numbers that are transformed at once; they stay in a core's cache.
AT_ONCE = 1 << 16
#: Words that a task handles together.
TOGETHER = 1 << 18

_roots: dict[tuple[int, bool], list[np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same residue: 2**16 is -1."""
    return (x & 0xFFFF) - (x >> 16)


def _stages(n: int, back: bool) -> list[np.ndarray]:
    """Powers of the n-th root of unity (of its inverse) for each stage of a transform, from the widest to the narrowest."""
    if (n, back) not in _roots:
        root, stages, half = pow(GENERATOR, (MODULUS - 1) // n * (-1 if back else 1), MODULUS), [], n // 2
        while half:
            powers = np.ones(half, np.int64)
            done = 1
            while done < half:
                powers[done : 2 * done] = powers[:done] * pow(root, done, MODULUS) % MODULUS
                done *= 2
            stages.append(powers[:, None])
            root, half = root * root % MODULUS, half // 2
        _roots[n, back] = stages
    return _roots[n, back]


def transform(x: np.ndarray) -> np.ndarray:
    """Forward transform of each column, in bit-reversed order; ``x`` is overwritten. Numbers grow by a bit a stage and stay far under 2**63."""
    n = len(x)
    for powers in _stages(n, False):
        half = len(powers)
        pair = x.reshape(n // (2 * half), 2, half, -1)
        low, high = pair[:, 0], pair[:, 1]
        change = low - high
        low += high
        pair[:, 1] = _fold(change * powers)
    return x


def transform_back(x: np.ndarray) -> np.ndarray:
    """The inverse of ``transform`` times the number of rows."""
    n = len(x)
    for powers in reversed(_stages(n, True)):
        half = len(powers)
        pair = x.reshape(n // (2 * half), 2, half, -1)
        low, high = pair[:, 0], _fold(pair[:, 1] * powers)
        pair[:, 1] = low - high
        low += high
    return x


def squared_differences(x: np.ndarray, starts: np.ndarray, size: int, distance: int, squares: np.ndarray) -> np.ndarray:
    """Residues of the sums of (x[b + i] - x[b + d + i])**2 over i < size: a row for each d from ``distance`` on (``size`` of them), a column for each b in ``starts``.

    ``squares`` are the running sums of x * x.
    """
    block = np.zeros((2 * size, len(starts)), np.int64)
    # Reversed in the cycle, so that the product of the transforms is that of a correlation.
    block[0] = x[starts]
    block[size + 1 :] = x[starts[None, :] + np.arange(size - 1, 0, -1)[:, None]]
    far = starts[None, :] + distance + np.arange(2 * size)[:, None]
    product = _fold(_fold(transform(block)) * _fold(transform(x[far])))
    inner = _fold(transform_back(product)[:size]) * (2 * pow(2 * size, -1, MODULUS) % MODULUS)
    own, others = squares[starts + size] - squares[starts], squares[far[size:]] - squares[far[:size]]
    return (own[None, :] + others - inner) % MODULUS


def find_in_words(x: np.ndarray, bounds: np.ndarray, shortest: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in order. ``x`` numbers words, documents lie at ``bounds`` (start, end), and after each one stands a number of its own."""
    if exponent < 4:
        raise ValueError("seeds are sure to be found from an exponent of 4 on")
    sizes = bounds[:, 1] - bounds[:, 0]
    longest = int(sizes.max(initial=0))
    runs: set[tuple[int, int, int]] = set()
    scale = 1
    while max(shortest, exponent * scale) <= longest:
        block = min(scale, LONGEST_BLOCK)
        usable = sizes >= max(shortest, exponent * scale)
        counts = (sizes[usable] - scale) // block  # blocks that have a place ``scale`` words later
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(bounds[usable, 0], counts) + within * block
        padded = np.concatenate((x, np.zeros(2 * scale + 2 * block + 2, np.int64)))
        values = padded % MODULUS
        squares = np.concatenate((np.zeros(1, np.int64), np.cumsum(values * values % MODULUS)))
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, AT_ONCE // (2 * block))
        for at in range(0, len(starts), step):
            some = starts[at : at + step]
            for distance in range(scale, 2 * scale, block):
                d, b = np.nonzero(squared_differences(values, some, block, distance, squares) == 0)
                if len(d):
                    seeds.append((some[b], d + distance))
        if seeds:
            known = np.array(sorted(runs), np.int64).reshape(-1, 3)
            for first, last, distance in _chains(seeds, known, block, shortest, exponent):
                runs.update(_extended(x, first, last, distance, block, shortest, exponent))
        scale *= 2
    return sorted((a, n, q) for a, n, q in runs)


def _chains(seeds: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray, block: int, shortest: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(first block, end of the last one, distance) of blocks in a row that fit at one distance, where they may belong to a run not yet known."""
    start, distance = (np.concatenate(c) for c in zip(*seeds, strict=True))
    order = np.lexsort((start, distance))
    start, distance = start[order], distance[order]
    new = np.concatenate(([True], (distance[1:] != distance[:-1]) | (start[1:] != start[:-1] + block)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    a, e, d = start[first], start[last] + block, distance[first]
    # Words that agree with the one d later: so many at least, hence so many whole blocks.
    agree = np.maximum(shortest, exponent * d) - d
    stay = (e - a) // block >= np.maximum(1, (agree - block + 1) // block)
    if len(known):
        # A run that holds the whole stretch is, among those that begin before it, the one that reaches furthest.
        reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
        at = np.searchsorted(known[:, 0], a, side="right") - 1
        stay &= (at < 0) | (reach[at] < e + d)
    return zip(a[stay].tolist(), e[stay].tolist(), d[stay].tolist(), strict=True)


def _extended(x: np.ndarray, first: int, end: int, distance: int, block: int, shortest: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """The runs of this period that meet the blocks: neither side goes on for another whole block, or that one would have fitted too."""
    low, high = max(0, first - block), min(len(x) - distance, end + block)
    same = x[low:high] == x[low + distance : high + distance]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        length = b - a + distance
        if length >= max(shortest, exponent * distance):
            yield low + a, length, distance


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run repeats: those of a run after its first period go."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shortest: int = 6, exponent: int = 4) -> DataFrame:
    """``keep`` of every row with n_words, runs (start, length, period of each, in order) and collapsed (the words that are not repeats, one blank between them).

    Words are what white space of ASCII separates.
    """
    made = ["n_words", "runs", "collapsed"]
    keep = tuple(c for c in keep if c not in made)
    taken = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    long = T.LongType()
    run_type = T.ArrayType(T.StructType([T.StructField(c, long) for c in ("start", "length", "period")]))
    schema = T.StructType([*(taken.schema[c] for c in keep), T.StructField("n_words", long), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])
    arrow_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, n = 0, [], 0
            for value in batch.column(len(keep)):
                texts.append((value.as_py() or b"").split())
                n += len(texts[-1])
                if n >= TOGETHER:
                    yield found(batch, first, texts)
                    first, texts, n = first + len(texts), [], 0
            if texts:
                yield found(batch, first, texts)

    def found(batch: pa.RecordBatch, first: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        name = defaultdict(count(len(texts)).__next__)  # the first numbers stand after the documents
        flat = np.concatenate([np.array([*map(name.__getitem__, words), i], np.int64) for i, words in enumerate(texts)])
        ends = np.cumsum([len(words) + 1 for words in texts]) - 1
        bounds = np.stack((np.concatenate(([0], ends[:-1] + 1)), ends), 1)
        of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        runs = find_in_words(flat, bounds, shortest, exponent)
        for (a, length, q), i in zip(runs, np.searchsorted(ends, [r[0] for r in runs]).tolist(), strict=True):
            of[i].append((a - int(bounds[i, 0]), length, q))
        collapsed = []
        for words, mine in zip(texts, of, strict=True):
            if mine:
                words = [words[i] for i in np.flatnonzero(_kept(len(words), mine))]
            collapsed.append(b" ".join(words))
        front = batch.select(list(range(len(keep)))).slice(first, len(texts)).columns
        sizes = pa.array([len(words) for words in texts], pa.int64())
        listed = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in mine] for mine in of], arrow_runs)
        return pa.RecordBatch.from_arrays([*front, sizes, listed, pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)

    return bounded_batches(taken).mapInArrow(run, schema)
