"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Texts and items are normalised alike (A-Z lower-cased, words are runs of digits, letters and all non-ASCII characters,
single blanks between them). The automaton holds every window of the items; each text is scanned once, and matches are
mapped back to code points of the original text.

Windows are made, made distinct and measured by Spark. An automaton is bounded by ``automaton_bytes`` of windows, each byte of which takes some forty in
memory. More windows are dealt out to several groups by their hash, whatever items they come from, each with an automaton of its own, and the text passes
through one after the other inside the same stage: texts are not shuffled in either case. Only one group at a time, of a measured size, passes the driver.

Null and empty texts have no words and no hits. Null or word-free items have no windows; a null item_id is matched but
listed nowhere. Repeated rows are answered row by row. Very long texts are scanned whole. An empty table of documents gives an empty result, an empty benchmark
no hits. Input columns other than the id and ``keep`` are ignored, and those of ``keep`` that clash with a result are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import bounded_batches, pin

#: Word bytes stay, A-Z become a-z, all other ASCII becomes a blank; UTF-8 bytes from 0x80 on are parts of word characters.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]

_automata: dict[str, object] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(text: str | None, size: int) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def window_table(items: DataFrame, size: int) -> DataFrame:
    """(window, n_words, items): every distinct window of (item, words) and the items that have it, null ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                found = list(dict.fromkeys(windows_of(text.as_py(), size)))
                n = [w.count(b" ") + 1 for w in found]
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found, pa.binary()), pa.array(n, pa.int32())], names=["item", "window", "n_words"])

    rows = bounded_batches(items).mapInArrow(run, "item long, window binary, n_words int")
    return rows.groupBy("window", "n_words").agg(F.collect_set("item").alias("items"))


def _automaton(key: str, windows: bytes):
    """Of (window, n_words, items) rows in Arrow's format; built once per Python worker."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        built = ahocorasick.Automaton()
        with pa.ipc.open_stream(windows) as rows:
            for batch in rows:
                for window, n_words, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    padded = f" {window.decode('latin-1')} "
                    built.add_word(padded, (len(padded), n_words, items))
        built.make_automaton()
        _automata[key] = built
    return _automata[key]


def scan_text(text: str | None, automaton, hit: np.ndarray | None, items: set[int]) -> tuple[int, np.ndarray | None]:
    """Number of words, and which of them lie in a match (None: none); ``items`` gains the items found."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), hit
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    blanks = None
    for end, (length, n_words, found) in automaton.iter(line):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            hit = np.zeros(len(words), bool) if hit is None else hit
        first = int(np.searchsorted(blanks, end - length + 1))
        hit[first : first + n_words] = True
        items.update(found)
    return len(words), hit


def spans_of(text: str, hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words as [start, end) in code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.concatenate(([False], np.frombuffer(raw.translate(NORMAL), np.uint8) != 32, [False]))
    edges = np.diff(word.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    firsts, lasts = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    return [[int(points[starts[a]]), int(points[ends[b]])] for a, b in zip(firsts, lasts, strict=True)]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    automaton_bytes: int = 4 << 20,
) -> DataFrame:
    """``keep`` columns of every document with n_words, n_hit, items (found, sorted) and spans (hit runs, code points)."""
    spark = docs.sparkSession
    bench = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("words"))
    table = pin(window_table(bench, window), "windows")
    total = table.agg(F.sum(F.octet_length("window") + 8 * F.size("items"))).first()[0] or 0
    groups = -(-total // automaton_bytes) or 1
    keep = tuple(c for c in keep if c not in {f.name for f in RESULT})
    taken = docs.select(*keep, F.col(text).alias("_text"))
    width = len(keep)
    kept = [taken.schema[c] for c in keep]
    mid = T.StructType([*kept, T.StructField("_text", T.StringType()), T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.LongType()))])
    final = T.StructType([*kept, *RESULT])
    out = taken
    for group in range(groups):
        part = table if groups == 1 else table.filter(F.pmod(F.xxhash64("window"), F.lit(groups)) == group)
        rows, sink = part.select("window", "n_words", "items").toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        shared, key, last = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex, group == groups - 1

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=key, last=last) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared.value)
            for batch in batches:
                texts = batch.column(width).to_pylist()
                before = batch.column(width + 1).to_pylist() if batch.num_columns > width + 1 else [None] * len(texts)
                known = batch.column(width + 2).to_pylist() if batch.num_columns > width + 1 else [None] * len(texts)
                counts, hits, ids, spans, marks = [], [], [], [], []
                for t, b, k in zip(texts, before, known, strict=True):
                    seen = set(k or ())
                    n, hit = scan_text(t, automaton, None if b is None else np.frombuffer(b, bool).copy(), seen)
                    counts.append(n)
                    hits.append(0 if hit is None else int(hit.sum()))
                    ids.append(sorted(seen))
                    if last:
                        spans.append([] if hit is None else spans_of(t, hit))
                    else:
                        marks.append(None if hit is None else hit.tobytes())
                listed = pa.array(ids, pa.list_(pa.int64()))
                front = [batch.column(i) for i in range(width)]
                if last:
                    made = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), listed, pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(front + made, names=final.names)
                else:
                    yield pa.RecordBatch.from_arrays([*front, batch.column(width), pa.array(marks, pa.binary()), listed], names=mid.names)

        out = bounded_batches(out).mapInArrow(scan, final if last else mid)
    return out
