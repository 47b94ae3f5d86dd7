"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

Documents are placed one after the other, as a task reads them, and no document moves to another task. A level array counts the
partially filled windows of each fill level; a document goes to the level for which the sum of the squared counts, after the
document is placed, is least (a new window is level 0; a full one no longer counts). Of documents longer than a window, full windows are cut
off first, and only what remains is placed.

What stays open is settled by cutting, so hardly anything is padded: where a task holds more than ``open_windows`` windows, as it may if no two
documents fit together, the windows of the most crowded level are joined and cut into full ones; at the end of a task all open windows
are, and the last one is cut at powers of two, which are not padded. Windows whose level is a power of two are left whole at the end.
A task holds the tokens of its open windows and nothing else, and one that is run again makes the same rows.

Null texts are empty and hold the end token only. Rows are packed one by one, so repeated rows are packed repeatedly, and null ids like
others. An empty table gives an empty result. Very long texts are tokenised whole. Columns other than the text and ``keep`` are ignored,
and those of ``keep`` that clash with a result are left out.
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
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.packing import BYTE_LETTERS
from caseflow.session import bounded_batches

#: Pieces that a byte-level tokenizer never joins: a word with the blank before it, or blanks.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for this module's pattern that is none for the tokenizer.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
MARKS = ".,;:?!*$%&|>#"


class ChunkIds(dict):
    """Chunk -> its ids as little-endian 32-bit bytes, remembered up to ``most`` chunks per Python worker.

    Marks after letters are a piece of their own, so a word's ids are made once for all marks that follow it; letters go straight to the tokenizer's model.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.most, self.tokenizer = most, Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokens = self.tokenizer.model.tokenize

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        letters = core[1:] if core[:1] == " " else core
        # One piece of letters for both Python and the tokenizer: Latin ones mean the same to every version of Unicode.
        if letters.isalpha() and max(letters) < "\u0250":
            if core != chunk:
                ids = self[core] + self[chunk[len(core) :]]
            else:
                ids = array("I", [t.id for t in self.tokens("".join(map(BYTE_LETTERS.__getitem__, core.encode())))]).tobytes()
        else:
            ids = self.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD_BLANKS.search(text) or any(s in text for s in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


_chunks: dict[str, ChunkIds] = {}


def chunks_for(path: str) -> ChunkIds:
    if path not in _chunks:
        _chunks[path] = ChunkIds(path)
    return _chunks[path]


#: A piece: the row's kept values, start in its document, tokens of the whole document, ids.
Piece = tuple[tuple, int, int, bytes]


class Packer:
    """Windows under construction. ``done`` collects finished ones, each a list of pieces."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.level = np.zeros(length + 1, np.int64)  # number of open windows at each fill level; 0 and ``length`` stay 0
        self.windows: list[list[list[Piece]]] = [[] for _ in range(length + 1)]
        self.open, self.done = 0, []

    def best_level(self, size: int) -> int:
        """The level to place ``size`` tokens at: the change of the sum of squares is 2 (to - from + 1), or without ``from`` for a new window."""
        counts, to = self.level, self.length - size
        # From level h (1 to ``to``) to level h + size; a window that becomes full leaves the sum.
        change = 2 * (counts[size + 1 : self.length + 1] - counts[1 : to + 1]) + 2
        if to:
            change[-1] = 1 - 2 * counts[to]
            change[counts[1 : to + 1] == 0] = np.iinfo(np.int64).max
        fresh = 2 * counts[size] + 1 if to else 0
        at = int(change.argmin()) if to else 0
        return at + 1 if to and change[at] <= fresh else 0

    def add(self, piece: Piece, size: int) -> None:
        """Place ``size`` tokens, at most a window."""
        at = self.best_level(size)
        if at:
            window = self.windows[at].pop()
            self.level[at] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        self.put(window, at + size)
        if self.open > self.most:
            self.settle([self.take(int(self.level.argmax()))])

    def put(self, window: list[Piece], level: int) -> None:
        if level == self.length:
            self.done.append(window)
        else:
            self.windows[level].append(window)
            self.level[level] += 1
            self.open += 1

    def take(self, level: int) -> list[list[Piece]]:
        taken, self.windows[level] = self.windows[level], []
        self.level[level] = 0
        self.open -= len(taken)
        return taken

    def settle(self, levels: list[list[list[Piece]]], last: bool = False) -> None:
        """Join these windows and cut them into full ones; what remains stays open, or is cut at powers of two."""
        left = sum(len(p[3]) for windows in levels for w in windows for p in w) // 4
        room = min(left, self.length)
        window: list[Piece] = []
        if last and left < self.length:
            room = 1 << max(0, left.bit_length() - 1)
        size = room
        for piece in (p for windows in levels for w in windows for p in w):
            row, start, total, ids = piece
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((row, start, total, part))
                start, room, left = start + len(part) // 4, room - len(part) // 4, left - len(part) // 4
                if not room:
                    if last:
                        self.done.append(window)
                    else:
                        self.put(window, size)
                    window, room = [], min(left, self.length)
                    if last and left < self.length:
                        room = 1 << max(0, left.bit_length() - 1)
                    size = room

    def close(self) -> None:
        """Finish all open windows, the fullest first, so that few of them are cut."""
        uneven = []
        for level in range(self.length - 1, 0, -1):
            windows = self.take(level)
            if level & (level - 1):
                uneven.append(windows)
            else:
                self.done += windows
        self.settle(uneven, last=True)


def pack_online(
    docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 2048, end: int = 1, with_ids: bool = False,
    open_windows: int = 4096,
) -> DataFrame:
    """All pieces: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A window's number is that of its task's partition and its own in the task. A task holds ``open_windows`` x ``length`` ids at most.
    """
    made = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    keep = tuple(c for c in keep if c not in {*made, "ids"})
    taken = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([
        *(taken.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in made),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ])
    last = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids, number, kinds = chunks_for(tokenizer), TaskContext.get().partitionId() << 40, []
        packer = Packer(length, open_windows)

        def finished() -> pa.RecordBatch:
            nonlocal number
            rows, ids = [], []
            for window in packer.done:
                offset = 0
                for row, start, total, piece in window:
                    rows.append((*row, start, len(piece) // 4, zlib.crc32(piece), total, number, offset))
                    offset += len(piece) // 4
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
                number += 1
            packer.done = []
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds + [pa.int64()] * len(made), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

        for batch in batches:
            kinds = list(batch.schema.types[: len(keep)])
            rows = zip(*(batch.column(i).to_pylist() for i in range(len(keep))), strict=True) if keep else iter([()] * batch.num_rows)
            for row, value in zip(rows, batch.column(len(keep)), strict=True):
                stream = chunk_ids.of_text(value.as_py()) + last
                total = len(stream) // 4
                whole = total // length * length
                packer.done += [[(row, at, total, stream[4 * at : 4 * (at + length)])] for at in range(0, whole, length)]
                if total > whole:
                    packer.add((row, whole, total, stream[4 * whole :]), total - whole)
                if len(packer.done) >= 1024:
                    yield finished()
        packer.close()
        if packer.done:
            yield finished()

    return bounded_batches(taken).mapInArrow(run, schema)
