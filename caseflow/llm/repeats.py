"""Repeated byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered only through their first ``length`` bytes, so equal groups after the last pass are exactly the windows that occur
more than once. The first pass keeps the suffixes worth sorting small: in each window the gram of smallest hash is its anchor, chosen by the
window's content alone, so equal windows have equal anchors. Anchors are sorted first, and those that occur once go. The
windows around the others are sorted by ``DIGITS`` digits each, most significant first; groups of one leave after every pass.

Equal texts are one text with a number of copies. Sorted anchors pass as a stream. An anchor's occurrences are sorted
in one task up to ``block`` of them; those of more frequent anchors are sorted across tasks, as rows keyed by window.

Null texts are empty, and texts shorter than ``length`` keep everything. Repeated rows are copies of a text, so nothing of
them is kept if they are long enough. An empty table gives an empty result; other columns are ignored. Results depend on the text
alone, so null and repeated ids do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shingles import BASE, BYTE_VALUES, CHUNK, U64, _power_tables, mix
from caseflow.session import bounded_batches, pin, scratch

GRAM = 48
DIGITS = 4
#: Windows that a task sorts at once.
WINDOWS = 250_000
#: Places of an anchor in one run of texts from which on they are spread, and over how many salts.
OFTEN, SALTS = 16, 64
TOP = U64(2**64 - 1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(len(data) + 1)
    return np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=U64))), down


def _sliding(values: np.ndarray, width: int, take, fill) -> np.ndarray:
    """``take`` (minimum or maximum) over every run of ``width`` values: two passes, whatever the width."""
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, fill, values.dtype))).reshape(-1, width)
    before = take.accumulate(padded, axis=1).ravel()
    after = take.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(after[:n], before[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, place, hash) of the anchors of all windows of ``texts``."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    sums, down = _sums(data)
    n = len(data) - gram + 1
    hashes = mix((sums[gram:] - sums[:n]) * down[:n])
    windows = np.ones(len(data) - length + 1, bool)  # starts of windows that stay inside their text
    for end in ends[:-1]:
        hashes[max(0, end - gram + 1) : end] = TOP
        windows[max(0, end - length + 1) : end] = False
    least = np.where(windows, _sliding(hashes, width, np.minimum, TOP), U64(0))
    sides = np.zeros(width - 1, U64)
    most = _sliding(np.concatenate((sides, least, sides)), width, np.maximum, U64(0))
    at = np.flatnonzero((most == hashes) & (hashes != TOP))
    owner = np.searchsorted(ends, at, side="right")
    return owner, at - (ends - sizes)[owner], hashes[at]


def repeated_windows(group: np.ndarray, contexts: list[bytes], anchor: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated window start in each context (-1: none).

    Contexts of one group hold the same gram at ``anchor``; a window is repeated if another context of the group has it at the
    same distance from the gram. Equal contexts repeat all of each other and are sorted once.
    """
    n = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sums, down = _sums(data)
    whole = mix((sums[base + sizes] - sums[base]) * down[base] + anchor.astype(U64) * U64(BASE) + sizes.astype(U64))
    _, first_of, same, copies = np.unique(mix(group.astype(U64) * U64(BASE) + whole), return_index=True, return_inverse=True, return_counts=True)
    low, high = np.full(len(first_of), -1), np.full(len(first_of), -1)
    last_start = sizes[first_of] - length
    usable = last_start >= 0
    many = usable & (copies > 1)
    low[many], high[many] = np.maximum(0, anchor[first_of][many] + gram - length), np.minimum(last_start[many], anchor[first_of][many])
    _, group_of, members = np.unique(group[first_of], return_inverse=True, return_counts=True)
    rivals = np.flatnonzero(usable & (members[group_of] > 1))
    # Windows at different distances from their gram never meet, so a few distances at a time are sorted, and memory stays small.
    at_once = max(1, WINDOWS // max(1, len(rivals)))
    for nearest in range(0, length - gram + 1 if len(rivals) else 0, at_once):
        far = np.arange(nearest, min(nearest + at_once, length - gram + 1))
        row, distance = np.repeat(np.arange(len(rivals)), len(far)), np.tile(far, len(rivals))
        source = first_of[rivals][row]
        start = anchor[source] - distance
        inside = (start >= 0) & (start + length <= sizes[source])
        row, source, start, distance = row[inside], source[inside], start[inside], distance[inside]
        flat = base[source] + start
        name = mix(group[source].astype(U64) * U64(BASE) + distance.astype(U64))
        step = -(-length // DIGITS)
        for digit in range(0, length, step):
            size = min(step, length - digit)
            name = mix(name * U64(BASE) + mix((sums[flat + digit + size] - sums[flat + digit]) * down[flat + digit]))
            _, name_of, seen = np.unique(name, return_inverse=True, return_counts=True)
            stay = seen[name_of] > 1
            row, start, flat, name = row[stay], start[stay], flat[stay], name[stay]
        if len(row):
            edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            who = rivals[row[edge]]
            lows, highs = np.minimum.reduceat(start, edge), np.maximum.reduceat(start, edge)
            low[who] = np.where(low[who] < 0, lows, np.minimum(low[who], lows))
            high[who] = np.maximum(high[who], highs)
    return low[same], high[same]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _anchor_rows(docs: DataFrame, length: int, remembered: int = 200_000) -> DataFrame:
    """(hash, salt, key, pos) of all texts; a task passes over copies of texts it remembers.

    Where a run of texts has an anchor very often, it is repeated for sure. All its places get salts, so that they are spread over tasks and stay; one
    of them goes to the others of that hash with salt 0 as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            texts, keys, size = [], [], 0

            def found() -> pa.RecordBatch:
                owner, at, value = anchors(texts, length)
                _, first, same, seen = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
                salt = np.where(seen[same] >= OFTEN, 1 + np.arange(len(value)) % SALTS, 0)
                again = first[seen >= OFTEN]
                rows, salt = np.concatenate((np.arange(len(value)), again)), np.concatenate((salt, np.zeros(len(again), salt.dtype)))
                held = pa.array(keys, pa.binary()).take(pa.array(owner[rows]))
                return pa.RecordBatch.from_arrays([pa.array(value[rows].view(np.int64)), pa.array(salt.astype(np.int32)), held, pa.array(at[rows].astype(np.int32))], names=["hash", "salt", "key", "pos"])

            for text in batch.column(0):  # one text at a time, not all of a batch as objects
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                key = hashlib.md5(raw).digest()
                if len(raw) < length or key in known:
                    continue
                if len(known) >= remembered:
                    known.clear()
                known.add(key)
                texts.append(raw)
                keys.append(key)
                size += len(raw)
                if size > CHUNK // 2:
                    yield found()
                    texts, keys, size = [], [], 0
            if texts:
                yield found()

    return bounded_batches(docs.select("text")).mapInArrow(run, "hash long, salt int, key binary, pos int")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _frequent(rows: DataFrame) -> DataFrame:
    """Anchors with more than one occurrence: (hash, salt, key, pos), in one streaming pass over the rows sorted by hash."""
    names, schema = ["hash", "salt", "key", "pos"], "hash long, salt int, key binary, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, count = None, 0  # the last row so far, and its number in its group
        for batch in batches:
            if not batch.num_rows:
                continue
            value, salt, pos = (batch.column(i).to_numpy() for i in (0, 1, 3))
            parts = np.ascontiguousarray(_fixed(batch.column(2), 16)).view(np.int64)
            if carried is not None:
                value, salt, parts, pos = (np.concatenate((x, y)) for x, y in zip(carried, (value, salt, parts, pos), strict=True))
            fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (salt[1:] != salt[:-1]) | (pos[1:] != pos[:-1]) | (parts[1:] != parts[:-1]).any(1)))
            value, salt, pos, parts = value[fresh], salt[fresh], pos[fresh], parts[fresh]
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (salt[1:] != salt[:-1])))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
            number = np.arange(len(value)) - begin
            number[begin == 0] += count  # the first group goes on
            # A row is repeated if it isn't alone in its group; whether the last one is shows only with the next batch.
            ends = np.concatenate((new[1:], [False]))
            keep = ~(new & ends & (number == 0)) | (salt > 0)
            keep[-1] = False
            carried, count = (value[-1:], salt[-1:], parts[-1:].copy(), pos[-1:]), int(number[-1])
            yield made(value, salt, parts, pos, keep)
        if carried is not None and (count > 0 or carried[1][0] > 0):
            yield made(*carried, np.array([True]))

    def made(value, salt, parts, pos, keep) -> pa.RecordBatch:
        raw = np.ascontiguousarray(parts[keep]).tobytes()
        offsets = pa.py_buffer(np.arange(0, len(raw) + 1, 16, dtype=np.int32).tobytes())
        keys = pa.Array.from_buffers(pa.binary(), len(raw) // 16, [None, offsets, pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(salt[keep].astype(np.int32)), keys, pa.array(pos[keep].astype(np.int32))], names=names)

    return rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt", "key", "pos").mapInArrow(run, schema)


def _hot(places: DataFrame, block: int) -> DataFrame:
    """Hashes of anchors with more than ``block`` places: (hash). Without salts an anchor has few places in any run of texts, and is looked for by its count."""
    counts = places.groupBy("hash", (F.col("salt") > 0).alias("spread")).agg(F.count(F.lit(1)).alias("n"))
    return pin(counts.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") > block).select("hash"), "hot")


def _contexts(placed: DataFrame, length: int) -> DataFrame:
    """(hash, key, pos, anchor, context, last) from (key, text, marks).

    Where a text has one context several times, as periodic texts do, only its first place is sent to be sorted; the windows of
    all of its places are repeated anyway, which rows with ``last`` (the last start of a repeated window) and no context say.
    """
    names = ["hash", "key", "pos", "anchor", "context", "last"]
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32())

    def rows_of(key: bytes, text: str, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
        raw, first = text.encode("utf-8", "surrogatepass"), {}
        for value, pos in zip(hashes.tolist(), places.tolist(), strict=True):
            begin = max(0, pos + GRAM - length)
            anchor, context = pos - begin, raw[begin : pos + length]
            # A text's contexts are told apart by their digests, so a long text is not held once more in pieces.
            name = (value, anchor, hashlib.blake2b(context, digest_size=16).digest())
            again = first.setdefault(name, pos)
            last = min(len(context) - length, anchor)
            if again == pos:
                yield value, key, pos, anchor, context, None
            elif last >= 0:
                yield value, key, pos, anchor, None, last
                if again >= 0:
                    yield value, key, again, anchor, None, last
                    first[name] = -1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, marks in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                fields = marks.values  # the marks of this text as columns, not as objects
                for row in rows_of(key.as_py(), text.as_py(), fields.field(0).to_numpy(), fields.field(1).to_numpy()):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return bounded_batches(placed.select("key", "text", "marks")).mapInArrow(run, "hash long, key binary, pos int, anchor int, context binary, last int")


def _sorted_in_tasks(contexts: DataFrame, length: int, at_once: int = 2 << 20) -> DataFrame:
    """(key, start, end) of what repeated windows cover around each occurrence; groups of about ``at_once`` bytes of contexts are sorted together."""
    names = ["key", "start", "end"]

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of these whole groups, whose contexts stay in Arrow's buffers but for the copy that is sorted."""
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        value, key, pos, anchor, context = (table.column(i) for i in range(5))
        value, pos, anchor = value.to_numpy(), pos.to_numpy().astype(np.int64), anchor.to_numpy().astype(np.int64)
        raw = _fixed(key.chunk(0), 16)
        # The same place of the same text is there once; rows are in order.
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (pos[1:] != pos[:-1]) | (raw[1:] != raw[:-1]).any(1)))
        rows = np.flatnonzero(fresh)
        low, high = repeated_windows(value[rows].view(U64), context.take(pa.array(rows)).to_pylist(), anchor[rows], length)
        some = np.flatnonzero(low >= 0)
        begin = (pos - anchor)[rows][some]
        yield pa.RecordBatch.from_arrays([key.take(pa.array(rows[some])).combine_chunks(), pa.array(begin + low[some]), pa.array(begin + high[some] + length)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = pc.is_null(batch.column(4))
            sure = batch.filter(known)
            begin = pc.subtract(sure.column(2), sure.column(3)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([sure.column(1), begin, pc.add(begin, pc.add(sure.column(5), length).cast(pa.int64()))], names=names)
            batch = batch.filter(pc.invert(known)).select(list(range(5)))
            if not batch.num_rows:
                continue
            size += batch.nbytes
            if size > at_once:
                value = batch.column(0).to_numpy()
                # Groups end where the hash changes; the last one may go on in the next batch.
                before = held[-1].column(0)[-1].as_py() if held else value[0]
                changes = np.flatnonzero(np.concatenate(([value[0] != before], value[1:] != value[:-1])))
                if len(changes):
                    at = int(changes[-1])
                    yield from flush([*held, batch.slice(0, at)] if at else held)
                    held, batch = [], batch.slice(at)
                    size = batch.nbytes
            held.append(batch)
        yield from flush(held)

    ordered = contexts.repartition("hash").sortWithinPartitions("hash", "key", "pos")
    return bounded_batches(ordered, 2 << 20).mapInArrow(run, "key binary, start long, end long")


def _sorted_across_tasks(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors too frequent for one task: every window around them is a row, and rows of a window are counted map-side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, pos, anchor, context, sure in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                last = sure if context is None else min(len(context) - length, anchor)
                starts = list(range(last + 1))
                # Windows known to be repeated need no name: null ones are not looked up.
                windows = [None if context is None else hashlib.blake2b(context[s : s + length], digest_size=16).digest() for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array([key] * len(starts), pa.binary()), pa.array([pos - anchor + s for s in starts], pa.int64())], names=["window", "key", "start"])

    windows = pin(contexts.mapInArrow(run, "window binary, key binary, start long").distinct(), "hot-windows")
    place = F.struct("key", "start")
    again = windows.filter("window IS NOT NULL").groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("window")
    found = windows.join(again, "window", "left_semi").unionByName(windows.filter("window IS NULL"))
    return found.select("key", "start", (F.col("start") + length).alias("end"))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, block: int = 50_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (maximal repeated runs in bytes)."""
    with scratch(docs.sparkSession) as keep:
        return _find_repeats(docs, doc_id, text, length, block, keep)


def _find_repeats(docs: DataFrame, doc_id: str, text: str, length: int, block: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", text_key(F.col("text")).alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"))
    nodes = keep(texts.groupBy("owner", "key").agg(F.count(F.lit(1)).alias("n")), "texts")
    copies = pin(nodes.groupBy("key").agg(F.sum("n").alias("copies"), F.min("owner").alias("owner")), "copies")
    places = pin(_frequent(_anchor_rows(texts, length)), "anchors")
    hot = _hot(places, block)
    marks = places.groupBy("key").agg(F.collect_list(F.struct("hash", "pos")).alias("marks"))
    contexts = _contexts(texts.select("text", "key", "owner").join(marks.join(copies.select("key", "owner"), "key"), ["owner", "key"]), length)
    if hot.limit(1).count():
        contexts = pin(contexts, "contexts")
        covered = _sorted_in_tasks(contexts.join(hot, "hash", "left_anti"), length)
        covered = covered.unionByName(_sorted_across_tasks(contexts.join(hot, "hash", "left_semi"), length))
    else:
        covered = _sorted_in_tasks(contexts, length)
    spans = keep(covered.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(copies.select("key", "copies"), "key", "right").filter("spans IS NOT NULL OR copies > 1"), "spans")
    found = nodes.select("owner", "key").join(spans, "key")
    joined = texts.join(found, ["owner", "key"], "left").select("doc_id", "text", "spans", "copies")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept, runs = [], [], [], [], []
            for value, marks, n in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = value.as_py().encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                if n is not None and n > 1 and len(raw) >= length:
                    merged = [[0, len(raw)]]
                else:
                    for a, b in sorted((m["start"], m["end"]) for m in marks.as_py() or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in merged))
                counts.append(len(merged))
                kept.append(digest.hexdigest())
                runs.append(merged)
            numbers = [pa.array(c, pa.int64()) for c in (sizes, removed, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(kept), pa.array(runs, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return bounded_batches(joined).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
