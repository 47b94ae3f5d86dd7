"""Exact Jaccard self-join of word-shingle sets with PartEnum signatures.

Sizes are cut into bands. Within a band, similar sets differ in at most k shingles, so when the shingle domain is hashed into
more than k parts, some parts agree entirely. Small sets enumerate subsets of their few parts; large ones use a first level of
parts, each with a second level of two of which one may differ, whose subsets are single parts. A set signs for its own band and for
the next ones that a similar larger set can lie in. Parts that are empty say nothing; a set with so many of them that
agreement might be among empty parts only also signs with its smallest shingles (prefix filter), so no pair is lost.

Sets with a common signature are checked exactly. Sets that are equal are one node. What is wanted are components, so a group of
N sets never yields N**2 pairs: each member is checked against the first of the groups that it shares most signatures with. Where a group then still spans several
components, small groups yield their pairs across components, and large ones are compared as blocks of sets by matrix products.
Memory is bounded: groups pass as sorted streams, hubs with many members and large groups are cut into blocks.

Null ids are kept but linked with nothing (component null); texts without words have no set, and their component is their own id. Rows
with one id count as one document. Repeated rows and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.components import components, smallest_reachable
from caseflow.llm.shingles import BASE, U64, chunks, mix, set_digest, shingle_sets
from caseflow.session import bounded_batches, pin, scratch

#: Members of one hub that meet in one task.
BLOCK = 2000
#: Shingles of all sets to a bucket of signatures; sets have about 0.6 signatures to a shingle.
BUCKET_SHINGLES = 800_000
#: Members up to which a signature's group yields pairs; larger ones are compared in blocks of that many sets and shingles.
PAIRED = 32
BLOCK_SETS, BLOCK_SHINGLES, SLICE = 768, 1_000_000, 2048
#: Hubs that a document is held against first.
HUBS = 2
#: Bytes of a table up to which it is sent to all tasks instead of moving the texts, and what a row and an entry of an array take at most.
SENT_BYTES, ROW_BYTES, ENTRY_BYTES = 24 << 20, 96, 48


class Scheme:
    """Bands and parts for similarity of at least ``percent`` / 100."""

    def __init__(self, percent: int, growth: float = 1.4, slack: float = 1.25):
        self.percent, self.slack = percent, slack
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * growth))))
        self.edges = np.array(edges, np.int64)

    def bands(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band that sets of these sizes sign for: similar sets are at most size * 100 / percent."""
        return (
            np.searchsorted(self.edges, sizes, side="right") - 1,
            np.searchsorted(self.edges, sizes * 100 // self.percent, side="right") - 1,
        )

    def most_different(self, band: int) -> int:
        """Shingles that two similar sets of a band can differ in: (|A| + |B|) (100 - p) / (100 + p) at most."""
        return int(2 * (self.edges[band + 1] - 1) * (100 - self.percent) // (100 + self.percent))

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts, and how many form a signature."""
        k = self.most_different(band)
        if k <= 3:
            return k + 2, 2  # one first-level part; all pairs of k + 2 second-level parts
        return 2 * int(np.ceil(self.slack * (k + 1) / 2)), 1  # first-level parts of two, one of which may differ


def signatures(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) for all signatures of ``sets``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    owners, found = [], []
    first, last = scheme.bands(sizes)
    flat = np.concatenate([sets[i] for i in full])
    owner = np.repeat(np.arange(len(sets)), sizes)
    place, weight = mix(flat ^ U64(0x5851F42D4C957F2D)) >> U64(33), mix(flat + U64(BASE))
    sparse = np.zeros(len(sets), bool)
    for band in np.unique(np.concatenate([first[full], last[full]])).tolist():
        members = np.flatnonzero((sizes > 0) & (first <= band) & (band <= last))
        if not len(members):
            continue
        parts, width = scheme.parts(band)
        slot = np.full(len(sets), -1)
        slot[members] = np.arange(len(members))
        mine = slot[owner]
        taken = mine >= 0
        cell = mine[taken] * parts + (place[taken] % U64(parts)).astype(np.int64)
        sums = np.zeros(len(members) * parts, U64)
        np.add.at(sums, cell, weight[taken])
        filled = np.bincount(cell, minlength=len(sums)) > 0
        sums, filled = sums.reshape(-1, parts), filled.reshape(-1, parts)
        agree = max(1, parts - scheme.most_different(band))
        sparse[members] |= (~filled).sum(1) >= agree
        for number, subset in enumerate(combinations(range(parts), width)) if width > 1 else ():
            some = filled[:, subset].any(1)
            value = np.zeros(len(members), U64)
            for part in subset:
                value = mix(value + sums[:, part])
            owners.append(members[some])
            found.append(mix(value + U64(((band << 32) + number + 1) * BASE % 2**64))[some])
        if width == 1:
            rows, columns = np.nonzero(filled)
            owners.append(members[rows])
            found.append(mix(sums[rows, columns] + (columns.astype(U64) + U64((band << 32) + 1)) * U64(BASE)))
    for i in np.flatnonzero(sparse):
        n = int(sizes[i])
        prefix = n - -(-n * scheme.percent // 100) + 1
        owners.append(np.full(prefix, i))
        found.append(mix(sets[i][:prefix] ^ U64(0xD1B54A32D192ED03)))
    return np.concatenate(owners), np.concatenate(found)


def filled_parts(sets: list[np.ndarray], scheme: Scheme) -> list[tuple[int, int, int, int]]:
    """For each set its first and last band, and how many signatures of single parts it has in each (none: 0)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first, last = scheme.bands(sizes)
    out = []
    for s, *bands in zip(sets, first.tolist(), last.tolist(), strict=True):
        place = mix(s ^ U64(0x5851F42D4C957F2D)) >> U64(33) if len(s) else s
        counts = []
        for band in bands:
            parts, width = scheme.parts(band) if len(s) else (1, 2)
            counts.append(int(np.count_nonzero(np.bincount((place % U64(parts)).astype(np.int64), minlength=parts))) if width == 1 else 0)
        out.append((*bands, *counts))
    return out


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, texts in chunks(batch.column(column).to_pylist()):
        yield first, shingle_sets(texts, width)


def sign(docs: DataFrame, width: int, scheme: Scheme, buckets: int, copies_known: int = 200_000) -> DataFrame:
    """Signatures of all sets as packed columns per bucket: (bucket, sig, hub, doc).

    A task signs once for equal sets as long as it remembers them. Within a run of texts only a signature's first document stands
    for it; the others are listed with it as their hub (``hub`` null: the rows are first ones). So however many documents share
    a signature, each run sends one row of it to the bucket's task. Signatures keep 48 bits, six bytes each: accidental meetings
    only cost a check. Columns are packed because rows of two numbers would shuffle several times as many bytes.
    """
    names = ["bucket", "sig", "hub", "doc"]

    def packed(place: np.ndarray, sig: np.ndarray, hub: np.ndarray | None, doc: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((doc, place))
        edges = np.flatnonzero(np.diff(place[order])) + 1
        for rows in np.split(order, edges) if len(order) else ():
            raw = sig[rows].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            yield int(place[rows[0]]), raw, None if hub is None else hub[rows].tobytes(), doc[rows].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, sets in _sets(batch, 1, width):
                fresh = []
                for i, s in enumerate(sets):
                    digest = set_digest(s)
                    if len(s) and digest not in known:
                        fresh.append(i)
                        known.add(digest)
                if len(known) > copies_known:
                    known.clear()
                owner, sig = signatures([sets[i] for i in fresh], scheme)
                if not len(owner):
                    continue
                doc, sig = ids[first + np.array(fresh, np.int64)[owner]], (sig >> U64(16)).astype(np.int64)
                order = np.lexsort((doc, sig))
                doc, sig = doc[order], sig[order]
                new = np.concatenate(([True], sig[1:] != sig[:-1]))
                hub = doc[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
                place = sig % buckets
                rest = ~new & (doc != hub)
                rows = [*packed(place[new], sig[new], None, doc[new]), *packed(place[rest], sig[rest], hub[rest], doc[rest])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    return bounded_batches(docs).mapInArrow(run, "bucket long, sig binary, hub binary, doc binary")


def shared(signed: DataFrame) -> DataFrame:
    """(sig, hub, doc) for each signature of several documents: hub is one of them, and doc each of the others.

    Lists of documents that already have a hub pass straight through; a bucket's first rows are sorted together.
    """

    def unpacked(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return wide.view("<i8").ravel()

    def batch_of(sig: np.ndarray, hub: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(hub), pa.array(doc)], names=["sig", "hub", "doc"])

    def grouped(sigs: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        hub = doc[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
        keep = np.concatenate(([False], (doc[1:] != doc[:-1]) | new[1:])) & ~new
        return batch_of(sig[keep], hub[keep], doc[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sigs, docs = None, [], []
        for batch in batches:
            for at, sig, hub, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != bucket and sigs:
                    yield grouped(sigs, docs)
                    sigs, docs = [], []
                bucket = at
                if hub is None:
                    sigs.append(unpacked(sig))
                    docs.append(np.frombuffer(doc, np.int64))
                else:
                    yield batch_of(unpacked(sig), np.frombuffer(hub, np.int64), np.frombuffer(doc, np.int64))
        if sigs:
            yield grouped(sigs, docs)

    return signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig long, hub long, doc long")


def send_sets(docs: DataFrame, wanted: DataFrame, width: int, short: bool = False) -> DataFrame:
    """The set of each document at each place where it is wanted: (a, block, place, doc, found), sorted within partitions.

    ``short`` sends the first 24 bits of each hash only.

    ``wanted`` has (doc, a, block, place). Each set is built once. Few rows go to all tasks, many are joined by a shuffle.
    """
    wanted = pin(wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "block", "place")).alias("meets")), "wanted")
    total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("meets")), F.lit(0))).first()
    small = total[0] * ROW_BYTES + total[1] * ENTRY_BYTES <= SENT_BYTES
    texts = docs.withColumnRenamed("doc_id", "doc").join(F.broadcast(wanted) if small else wanted, "doc").select("doc", "text", "meets")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            ids, meets = batch.column(0).to_pylist(), batch.column(2)
            for first, sets in _sets(batch, 1, width):
                sent = [_short(s) if short else s.tobytes() for s in sets]
                rows = [(m["a"], m["block"], m["place"], ids[first + i], s) for i, s in enumerate(sent) for m in meets[first + i].as_py()]
                for at in range(0, len(rows), 4096):
                    columns = zip(*rows[at : at + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "block", "place", "doc", "found"])

    built = bounded_batches(texts).mapInArrow(build, "a long, block long, place int, doc long, found binary")
    return built.repartition("a", "block").sortWithinPartitions("a", "block", "place")


def _short(found: np.ndarray) -> bytes:
    return (found >> U64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar.

    A first pass compares shortened hashes, which can only make sets look more alike, and leaves few pairs for the exact one.
    """
    return _compared(docs, _compared(docs, pin(pairs, "pairs"), width, percent, True), width, percent, False)


def _compared(docs: DataFrame, pairs: DataFrame, width: int, percent: int, short: bool) -> DataFrame:
    """``pairs`` that pass, each a meeting its partners in blocks."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    spread = pairs.join(blocks, "a").select(F.col("b").alias("doc"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("place"))
    heads = blocks.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            out = []
            for a, block, place, doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _long(raw) if short else np.frombuffer(raw, U64)
                if place == 0:
                    key, head = (a, block), found
                elif key == (a, block):
                    small, large = (found, head) if len(found) < len(head) else (head, found)
                    if len(small) * 100 < len(large) * percent:
                        continue
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        out.append((a, doc))
            yield _links(out)

    return pin(send_sets(docs, spread.unionByName(heads), width, short).mapInArrow(run, "a long, b long").distinct(), "similar")


def spanning_links(docs: list[int], sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the same of these sets as all links between them do; with ``side`` (0 or 1), all links from one side to the other.

    Sets may be of shortened hashes, and then hold one value several times: what that hides of an intersection is allowed for, so no link is missed.
    """
    sides = np.zeros(len(sets), np.int64) if side is None else np.array(side)
    order = np.argsort(sides, kind="stable")
    n = int((sides == 0).sum())
    if not n:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)[order]
    sets = [np.unique(sets[i]) for i in order]
    hidden = sizes - np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, name, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    cross = n < len(sets)
    if cross:  # a shingle counts if both sides have it
        seen = np.minimum(np.bincount(name[owner < n], minlength=len(seen)), np.bincount(name[owner >= n], minlength=len(seen))) + 1
    common = np.flatnonzero(seen > 1)
    rename = np.full(len(seen), -1)
    rename[common] = np.arange(len(common))
    name = rename[name]
    first, second = slice(0, n), slice(n, None) if cross else slice(0, n)
    both = np.zeros((n, len(sets) - n if cross else n), np.float32)
    for low in range(0, len(common), SLICE):
        inside = (name >= low) & (name < low + SLICE)
        has = np.zeros((len(sets), min(SLICE, len(common) - low)), np.float32)
        has[owner[inside], name[inside] - low] = 1
        both += has[first] @ has[second].T  # counts below 2**24 are exact
    found = []
    for at in range(0, n, 256):  # rows at a time, for the memory of what is made on the way
        rows = slice(at, min(at + 256, n))
        most = both[rows].astype(np.int64) + np.minimum(hidden[rows, None], hidden[None, second])
        # 100 * both >= percent * (sum of sizes - both)
        one, other = np.nonzero((100 + percent) * most >= percent * (sizes[rows, None] + sizes[None, second]))
        found.append((one + at, other + (n if cross else 0)))
    node, label = smallest_reachable(*(np.concatenate(c) for c in zip(*found, strict=True)))
    return [(docs[order[i]], docs[order[j]]) for i, j in zip(node.tolist(), label.tolist(), strict=True) if i != j]


def _meetings(clusters: DataFrame, percent: int) -> DataFrame:
    """(doc, a, block, place): which sets of a cluster meet where. ``clusters`` has (doc, cluster, n_shingles).

    A cluster is cut into bands of sizes, so wide that similar sets are in one band or in neighbouring ones, and each band into blocks of bounded size. Every two
    blocks of a band, and of neighbouring bands, meet in one task.
    """
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    banded = pin(clusters.withColumn("band", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("n_shingles")))), "clusters")
    blocks = pin(
        banded.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")), "blocks"
    )
    at = banded.join(blocks, ["cluster", "band"]).withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    for step, name in ((1, "above"), (-1, "below")):
        at = at.join(blocks.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias(name)), ["cluster", "band"], "left")
    at = pin(at, "meetings")
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    kinds = (
        (at.select("*", F.explode(count("blocks")).alias("other")), "band", 0, low * F.col("blocks") + high, (F.col("mine") > F.col("other")).cast("int")),
        (at.filter("above IS NOT NULL").select("*", F.explode(count("above")).alias("other")), "band", 1, F.col("mine") * F.col("above") + F.col("other"), F.lit(0)),
        (at.filter("below IS NOT NULL").select("*", F.explode(count("below")).alias("other")), "band - 1", 1, F.col("other") * F.col("blocks") + F.col("mine"), F.lit(1)),
    )
    out = None
    for rows, band, kind, number, place in kinds:
        key = F.shiftleft(F.expr(f"CAST(2 * ({band}) + {kind} AS long)"), 48) + number
        part = rows.select("doc", F.col("cluster").alias("a"), key.alias("block"), place.alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def compare_blocks(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within each cluster, enough to connect what all its links connect. ``clusters`` has (doc, cluster, n_shingles).

    Blocks of sets meet with shortened hashes, which may only link too much, and give links that connect each of their
    components. These few links are checked exactly; where one of them fails, as next to none does, its cluster is compared with whole hashes.
    What one task holds is bounded; the work of a large cluster of sets that are near but not similar is quadratic, and spread evenly.
    """

    def linked(clusters: DataFrame, short: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, sets, side = None, [], [], []
            for batch in batches:
                out = []
                for a, block, place, doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != (a, block):
                        out += spanning_links(ids, sets, percent, side) if len(ids) > 1 else []
                        key, ids, sets, side = (a, block), [], [], []
                    ids.append(doc)
                    sets.append(_long(raw) if short else np.frombuffer(raw, U64))
                    side.append(place)
                yield _links(out)
            if len(ids) > 1:
                yield _links(spanning_links(ids, sets, percent, side))

        return pin(bounded_batches(send_sets(docs, _meetings(clusters, percent), width, short)).mapInArrow(run, "a long, b long").distinct(), "block-links")

    clusters = pin(clusters, "clusters")
    tried = linked(clusters, True)
    exact = _compared(docs, tried, width, percent, False)
    failed = tried.join(exact, ["a", "b"], "left_anti").select(F.col("a").alias("doc"))
    again = pin(clusters.join(clusters.join(failed, "doc", "left_semi").select("cluster").distinct(), "cluster", "left_semi"), "again")
    if not again.limit(1).count():
        return exact
    return exact.unionByName(linked(again, False))


def _signing(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """``docs`` without those that ``roles`` (doc, signs) says don't sign. The shorter list of the two is sent to all tasks if it is short, else the texts are shuffled."""
    counts = {signs: n for signs, n in roles.groupBy("signs").count().collect()}
    signs = counts.get(True, 0) <= counts.get(False, 0)
    listed = roles.filter("signs" if signs else "NOT signs").select(F.col("doc").alias("doc_id"))
    return docs.join(F.broadcast(listed) if counts.get(signs, 0) * ROW_BYTES <= SENT_BYTES else listed, "doc_id", "left_semi" if signs else "left_anti")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links). Tables made on the way are gone when it returns."""
    with scratch(docs.sparkSession) as keep:
        return keep(_similar_components(docs, doc_id, text, width, percent), "components")


def _similar_components(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scheme = Scheme(percent)

    columns = ["first_band", "last_band", "first_parts", "last_parts"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, parts = [], [], []
            for _, sets in _sets(batch, 1, width):
                sizes += map(len, sets)
                digests += [set_digest(s) if len(s) else None for s in sets]
                parts += filled_parts(sets, scheme)
            numbers = [pa.array([x[i] for x in parts], pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *numbers], names=["doc_id", "n_shingles", "digest", *columns])

    sized = pin(bounded_batches(rows).mapInArrow(digest, "doc_id long, n_shingles long, digest binary, " + ", ".join(f"{c} int" for c in columns)), "digests")
    known = sized.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    firsts = pin(known.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    nodes = pin(known.join(firsts, "digest").select(F.col("doc_id").alias("doc"), "first"), "nodes")
    usable = rows.filter(F.col("doc_id").isNotNull())
    # Only the first document of equal sets signs, so copies add neither signatures nor members of groups. A document with several sets signs if it is the first of any.
    roles = pin(nodes.groupBy("doc").agg(F.max(F.col("doc") == F.col("first")).alias("signs")), "roles")
    signing = _signing(usable, roles)
    shingles = known.join(roles.filter("signs").select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").agg(F.sum("n_shingles")).first()[0] or 0
    groups = pin(shared(sign(signing, width, scheme, 1 + shingles // BUCKET_SHINGLES)).filter("hub != doc"), "groups")

    def as_nodes(links: DataFrame) -> DataFrame:
        left = links.join(nodes.select(F.col("doc").alias("a"), F.col("first").alias("x")), "a")
        return left.join(nodes.select(F.col("doc").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    # Of any two documents of a group the larger id is a ``doc`` there, so two documents share at most as many signatures as the
    # larger has rows. Two similar sets differ in at most ``differ`` shingles, hence in as many parts, and share all other
    # signatures that the one has in the band of the larger set. Pairs that can't are dropped before any set is moved.
    rows_of = groups.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"))
    heads_of = groups.select("sig", "hub").distinct().groupBy(F.col("hub").alias("doc")).agg(F.count(F.lit(1)).alias("heads"))
    traits = known.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max("n_shingles").alias("n"), (F.min("digest") != F.max("digest")).alias("several"), *(F.max(c).alias(c) for c in columns)
    )
    none = F.lit(0).cast("long")
    traits = pin(
        traits.join(rows_of, "doc", "left").join(heads_of, "doc", "left").withColumns({"rows": F.coalesce("rows", none), "heads": F.coalesce("heads", none)}), "traits"
    )

    def possible(pairs: DataFrame) -> DataFrame:
        left = traits.select(F.col("doc").alias("a"), F.struct("n", "several", "first_band").alias("x"))
        both = pairs.join(left, "a").join(traits.select(F.col("doc").alias("b"), F.struct(*traits.columns).alias("y")), "b")
        differ = F.expr(f"(x.n + y.n) * {100 - percent} div {100 + percent}")
        parts = F.expr("CASE WHEN y.first_band >= x.first_band THEN y.first_parts WHEN y.last_band >= x.first_band THEN y.last_parts ELSE 0 END")
        fits = F.expr(f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}") & (F.col("y.rows") >= parts - differ)
        return both.filter(F.col("x.several") | F.col("y.several") | fits).select("a", "b")

    # Each document is first held against the hubs that it has most signatures in common with; what that leaves open, the groups that still span several
    # components tell, and it is looked for there. So the first pairs are as many as documents, however many hubs a group has.
    met = groups.groupBy(F.col("hub").alias("a"), F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    order = W.partitionBy("b").orderBy(F.col("common").desc(), "a")  # a document has no more hubs than signatures
    best = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HUBS).select("a", "b")
    tried = pin(possible(best), "tried")
    # Rows of one id may have several sets, and then join several nodes.
    joined = nodes.groupBy("doc").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a != b").select("a", "b")
    links = as_nodes(verify(usable, tried, width, percent)).unionByName(joined)
    named = components(links)
    # Groups that span several components: all pairs across them that were not tried.
    label = pin(nodes.join(named.withColumnRenamed("node", "first"), "first", "left").groupBy("doc").agg(F.min(F.coalesce("component", "first")).alias("label")), "label")
    members = groups.select("sig", "doc").union(groups.select("sig", F.col("hub").alias("doc")).distinct()).join(label, "doc")
    members = pin(members, "members")
    mixed = pin(
        members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("sig", "n"), "mixed"
    )
    few = pin(members.join(mixed.filter(F.col("n") <= PAIRED).select("sig"), "sig", "left_semi"), "few")
    one, other = (few.select("sig", F.col("doc").alias(d), F.col("label").alias(f"label_{d}")) for d in "ab")
    across = one.join(other, "sig").filter("label_a != label_b AND a < b").select("a", "b").distinct()
    more = verify(usable, possible(across).join(tried, ["a", "b"], "left_anti"), width, percent)
    many = groups.join(mixed.filter(F.col("n") > PAIRED).select("sig"), "sig", "left_semi")
    # The same bound for one document and its largest possible partner.
    furthest = F.expr(f"(n + n * 100 div {percent}) * {100 - percent} div {100 + percent}")
    lonely = ~F.col("several") & (F.col("rows") + F.col("heads") < F.least("first_parts", "last_parts") - furthest)
    large = components(many.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    large = large.withColumnRenamed("node", "doc").join(traits.filter(~lonely), "doc").select("doc", F.col("component").alias("cluster"), F.col("n").alias("n_shingles"))
    more = as_nodes(more.unionByName(compare_blocks(usable, large, width, percent)))
    named = components(links.unionByName(more))
    final = nodes.join(named.withColumnRenamed("node", "first"), "first", "left").groupBy("doc").agg(F.min(F.coalesce("component", "first")).alias("component_id"))
    return sized.join(final.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _own_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame | None:
    """``docs`` with ``_key``: the id where one row has it, else a number of its own for each text of the id. None if no id is repeated."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    bare = docs.filter(F.col(doc_id).isNotNull())
    several = bare.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(doc_id)
    several = pin(several, "several")
    if not several.limit(1).count():
        return None
    top = bare.agg(F.max(doc_id)).first()[0]
    texts = docs.select(doc_id, digest.alias("_digest")).join(several, doc_id, "left_semi").distinct()
    # Written before it is read, so that a task that is run again can't number its rows anew.
    numbered = pin(texts.select(F.col(doc_id).alias("_id"), F.col("_digest").alias("_of"), (F.monotonically_increasing_id() + top + 1).alias("_number")), "numbered")
    keyed = docs.withColumn("_digest", digest).join(numbered, (F.col(doc_id) == F.col("_id")) & (F.col("_digest") == F.col("_of")), "left")
    return keyed.withColumn("_key", F.coalesce("_number", F.col(doc_id).cast("long"))).drop("_digest", "_id", "_of", "_number")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id, and of rows equal in id and text the least one by all columns.

    Rows of one id with different texts are different documents; where they are first by id in one component, one of them stays. Rows without an id all stay.
    Only the ids to remove meet the texts; few are sent to all tasks, many are joined by a shuffle.
    """
    def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
        gone = pin(gone, "gone")
        return rows.join(F.broadcast(gone) if gone.count() * ROW_BYTES <= SENT_BYTES else gone, key, "left_anti")

    columns, keyed = docs.columns, _own_keys(docs, doc_id, text)
    if keyed is None:
        named = similar_components(docs, doc_id, text, width, percent)
        return without(docs, named.filter("component_id < doc_id").select(F.col("doc_id").alias(doc_id)), doc_id).select(*columns)
    again = pin(keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.first(doc_id).alias("_id")), "keys")
    named = pin(similar_components(keyed, "_key", text, width, percent).distinct(), "components").filter("doc_id IS NOT NULL")
    ids = named.join(again.select(F.col("_key").alias("doc_id"), "_id"), "doc_id")
    firsts = ids.groupBy("component_id").agg(F.min(F.struct("_id", "doc_id")).alias("first"))
    kept = without(keyed, ids.join(firsts, "component_id").filter("first.doc_id != doc_id").select(F.col("doc_id").alias("_key")), "_key")
    copied = again.filter("n > 1").select("_key")
    once = kept.join(copied, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    return kept.join(copied, "_key", "left_anti").select(*columns).unionByName(once)
