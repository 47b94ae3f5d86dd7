"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they are read; only documents longer than a sequence are cut. Pieces of equal length are
interchangeable, so the packing is planned on the histogram of lengths (one count per length, whatever the corpus size): a bin
is filled greedily by best fit, then its smallest piece gives way to two unpacked pieces that fit the widened gap more tightly,
and the finished pattern is repeated as often as the counts allow. Pieces find their place by their rank among those of
their length, counted per partition and carried over, so no length is ever gathered.

Null texts are empty and hold the end token only. Rows are packed one by one, so repeated rows are packed repeatedly. An empty table gives an
empty result. Columns other than the text and ``keep`` are ignored, and those of ``keep`` that clash with a result are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import bounded_batches, pin

#: White space for the splitter of this module that is none for the tokenizer.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
TAIL = ".,;:?*$%&|>#"


#: How byte-level vocabularies write a byte as a character: printable ones as themselves, the others from 256 on.
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _own)}


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit bytes, remembered up to ``most`` words per Python worker.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words. It also lower-cases, and
    splits letters from the marks after them; words of small Latin letters go straight to its model, all others through the whole of it.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.path, self.most, self.tokenizer = path, most, Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(TAIL)
        if core and core.isalpha() and core != word:
            ids = self[core] + self[word[len(core) :]]
        elif core == word and core.islower() and core.isalpha() and max(core) < "\u0100":
            if not core.isascii():
                word_bytes = "".join(map(BYTE_LETTERS.__getitem__, core.encode()))
            else:
                word_bytes = core
            ids = array("I", [t.id for t in self.model.tokenize(word_bytes)]).tobytes()
        else:
            ids = self.encode(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD_BLANKS.search(text):
            return self.encode(text)
        try:
            text.encode("latin-1")
            text = text.lower()  # character by character in this range, as the tokenizer does it
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.split()))


_words: dict[str, WordIds] = {}


def words_for(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def tokenise(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` tokens: ``keep`` columns, piece, start, length, ids_crc32, and ids if asked for.

    ``_part`` and ``_rank`` number the pieces of a length within their partition.
    """
    made = ["piece", "start", "length", "ids_crc32", "_part", "_rank"]
    keep = tuple(c for c in keep if c not in {*made, "ids"})
    taken = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([
        *(taken.schema[c] for c in keep), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in made[1:]),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ])
    last = array("I", [end]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = words_for(tokenizer), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            rows, pieces, starts, lengths, sums, ranks, ids = [], [], [], [], [], [], []
            for row, value in enumerate(batch.column(len(keep))):  # one text at a time, not all of a batch as objects
                stream = words.of_text(value.as_py()) + last
                for number, at in enumerate(range(0, len(stream), 4 * length)):
                    piece = stream[at : at + 4 * length]
                    n = len(piece) // 4
                    rows.append(row)
                    pieces.append(number)
                    starts.append(at // 4)
                    lengths.append(n)
                    sums.append(zlib.crc32(piece))
                    ranks.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
            front = batch.select(list(range(len(keep)))).take(pa.array(rows, pa.int64())).columns if keep else []
            numbers = [pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, [part] * len(rows), ranks))]
            more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*front, *numbers, *more], names=schema.names)

    return bounded_batches(taken).mapInArrow(cut, schema)


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int]:
    """Two available lengths with the largest sum of at most ``room`` (0, 0: none)."""
    there = np.flatnonzero(counts[: room + 1])
    if not len(there):
        return 0, 0
    below = np.zeros(room + 1, np.int64)
    below[there] = there
    below = np.maximum.accumulate(below)
    partner = below[np.maximum(0, np.minimum(room - there, there - 1))]
    partner = np.where((counts[there] > 1) & (2 * there <= room), there, partner)
    sums = np.where(partner > 0, there + partner, 0)
    best = int(np.argmax(sums))
    return (int(there[best]), int(partner[best])) if sums[best] else (0, 0)


def plan(counts: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Patterns of piece lengths and how many sequences have each; ``counts[n]`` pieces of n tokens are all placed.

    Every pattern is repeated until the pieces of one of its lengths no longer suffice, so there are some thousand patterns at
    most, and planning costs the same for any number of documents.
    """
    left, patterns = counts.astype(np.int64).copy(), []
    while left.any():
        bin_, gap = [], length
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            bin_.append(int(fits[-1]))
            left[bin_[-1]] -= 1
            gap -= bin_[-1]
        while gap:
            small = bin_[-1]
            pair = _best_pair(left, gap + small)
            if sum(pair) <= small:
                break
            left[small] += 1
            for x in pair:
                left[x] -= 1
            bin_ = sorted([*bin_[:-1], *pair], reverse=True)
            gap += small - sum(pair)
        sizes, uses = np.unique(bin_, return_counts=True)
        more = int((left[sizes] // uses).min())
        left[sizes] -= more * uses
        patterns.append((bin_, 1 + more))
    return patterns


def slots(patterns: list[tuple[list[int], int]], length: int) -> np.ndarray:
    """Rows of (length, first rank, first sequence, offset): ranks from there on take consecutive sequences."""
    taken, first, rows = np.zeros(length + 1, np.int64), 0, []
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], first, offset))
            taken[size] += times
            offset += size
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """All pieces with sequence_id and offset, their place in a sequence of at most ``length`` tokens."""
    pieces = pin(tokenise(docs, tokenizer, text, keep, length, end, with_ids), "pieces")
    here = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows per length as there are partitions.
    earlier = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = here.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    counts = np.zeros(length + 1, np.int64)
    for row in here.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``length`` rows
        counts[row.length] = row.n
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, length), length))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size, rank):
        import pandas as pd

        rows = table.value
        keys = rows[:, 0] << 45 | rows[:, 1]
        at = np.searchsorted(keys, size.to_numpy() << 45 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 2] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 3]})

    placed = pieces.join(bases, ["length", "_part"]).withColumn("_at", place("length", F.col("_rank") + F.col("_base")))
    return placed.select(*(c for c in pieces.columns if not c.startswith("_")), "_at.sequence_id", "_at.offset")
