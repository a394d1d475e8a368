"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are kept by what room is left; each carries a bitmap of sources that may not enter it again and one of
the duplicate clusters in it.  Pieces come longest first.  For each, the successor search starts at the
tightest room that holds it and goes on to wider ones until a compatible bin is found; bins with equal room
and equal bitmaps are interchangeable and looked at once.

Lengths are numbers of a tokenizer's ids, clusters are components of SimHash fingerprints, and sequences()
gives the packed ids.
"""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, text_rows, width
from .components import components
from .simhash import fingerprint, links
from .wavelet import chunks_of, tokens_of


class Packer:
    """Bins of one capacity; most_per_source pieces of a source and one of a cluster may share a bin."""

    def __init__(self, capacity: int, most_per_source: int):
        self.capacity, self.most = capacity, most_per_source
        # room -> (bitmap of full sources, bitmap of clusters) -> bins
        self._rooms: dict[int, dict[tuple[int, int], list[int]]] = {}
        self._mask = 0
        self._counts: list[dict[int, int]] = []
        self.used: list[int] = []

    def _put(self, room: int, marks: tuple[int, int], b: int) -> None:
        if room:
            self._rooms.setdefault(room, {}).setdefault(marks, []).append(b)
            self._mask |= 1 << room

    def _find(self, size: int, source: int, cluster: int) -> tuple[int, tuple[int, int]] | None:
        """Room and bitmaps of the tightest compatible bin."""
        rest = self._mask >> size
        room = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room, rest = room + step, rest >> step
            for marks in self._rooms[room]:
                if not marks[0] & source and not marks[1] & cluster:
                    return room, marks
            room, rest = room + 1, rest >> 1
        return None

    def add(self, size: int, source: int | None, cluster: int | None) -> tuple[int, int]:
        """(bin, offset) of a piece; source and cluster are small numbers, None conflicts with nothing."""
        s, c = 0 if source is None else 1 << source, 0 if cluster is None else 1 << cluster
        if size < self.capacity and (at := self._find(size, s, c)):
            room, marks = at
            same = self._rooms[room]
            bins = same[marks]
            b = bins.pop()
            if not bins:
                del same[marks]
                if not same:
                    del self._rooms[room]
                    self._mask ^= 1 << room
        else:
            b, room, marks = len(self.used), self.capacity, (0, 0)
            self.used.append(0)
            self._counts.append({})
        offset = self.used[b]
        self.used[b] += size
        full = marks[0]
        if source is not None:
            n = self._counts[b][source] = self._counts[b].get(source, 0) + 1
            if n >= self.most:
                full |= s
        self._put(room - size, (full, marks[1] | c), b)
        return b, offset


def pack(docs: DataFrame, capacity: int = 4096, most_per_source: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """Pack documents; docs has doc_id, n_tokens, source, cluster.

    Returns doc_id, piece, n_tokens, bin_id, bin_offset, bin_used: one row for each piece.  A document longer
    than the capacity is cut into full bins and a rest; nothing is dropped.  No two pieces of a duplicate
    cluster, other than a long document's own, and at most most_per_source of a source share a bin.

    Rows are dealt by a hash of all they carry into groups of about shard_rows, as many as the table asks
    for, and each group is packed for itself, in an order that only its rows decide: bins, and their ids, are
    the same whatever the partitions and however often a task runs.  Bins never cross groups, so a bin's
    constraints are seen whole, and a group's rows are a fair mix of sources and sizes.  Rows that are equal
    throughout come to one group and are packed shard_rows at a time.  Null or non-positive n_tokens counts
    as one token; null source or cluster conflicts with nothing; null doc_id and repeated rows are packed
    like any other; empty: no rows.
    """
    names = ("doc_id", "n_tokens", "source", "cluster")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(1)), F.lit(1)).alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"))
    groups = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("h", F.xxhash64(*names)).withColumn("g", F.pmod("h", F.lit(groups)))
    dealt = dealt.repartition(min(groups, 20 * width(docs.sparkSession)), "g").sortWithinPartitions("g", "h", *names)

    def run(it):
        at, base, got = None, 0, []

        def flush():
            nonlocal base
            packer, sources, out = Packer(capacity, most_per_source), {}, []
            times: dict[int, int] = defaultdict(int)
            for r in got:
                if r[3] is not None:
                    times[r[3]] += 1
            clusters = {c: k for k, c in enumerate(sorted(c for c, n in times.items() if n > 1))}
            got.sort(key=lambda r: order(r, capacity))
            for doc, n, source, cluster in got:
                s = None if source is None else sources.setdefault(source, len(sources))
                for piece in range(-(-n // capacity)):
                    size = min(capacity, n - piece * capacity)
                    b, offset = packer.add(size, s, clusters.get(cluster) if size < capacity else None)
                    out.append((doc, piece, size, b, offset))
            used, first = packer.used, (at << 32) + base
            base += len(used)
            got.clear()
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array([first + b for b in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()), pa.array([used[b] for b in cols[3]], pa.int64())], names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_used"])

        for b in batches(it):
            for g, *row in zip(*(b.column(x).to_pylist() for x in ("g", *names)), strict=True):
                if got and (g != at or len(got) >= 2 * shard_rows):
                    yield flush()
                if g != at:
                    at, base = g, 0
                got.append(tuple(row))
        if got:
            yield flush()

    return dealt.mapInArrow(run, "doc_id long, piece int, n_tokens long, bin_id long, bin_offset long, bin_used long")


def order(row: tuple, capacity: int) -> tuple:
    """Longest rest first, of equal ones the longer document; equal sizes follow each other by cluster, so their bins stay alike."""
    doc, n, source, cluster = row
    return -(n % capacity or capacity), -n, cluster is None, cluster or 0, doc is None, doc or 0, source is None, source or ""


def measured(docs: DataFrame, tokenizer: str, end: int = 1, cache: int = 500_000) -> DataFrame:
    """What pack() needs of documents: doc_id, n_tokens, source, cluster.

    n_tokens: ids that the tokenizer's file gives for the whole text, and an end id.  cluster: documents whose
    SimHash fingerprints (over distinct words) link within two bits, one after another, have the same;
    without words: null.  Null text: empty.  Repeated rows are measured each.  Empty table: no rows.
    """

    def run(it):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks = chunks_of(tokenizer, cache)
        for b in batches(it, 500):
            texts = b.column("text").to_pylist()
            sizes = [len(x) // 4 for x in tokens_of(texts, chunks, end)]
            fps = np.array([fingerprint(x, 1, True) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("origin"), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64(), mask=fps == 0)], names=["doc_id", "source", "n_tokens", "fp"])

    rows = stored(text_rows(docs, F.col("source").cast("string").alias("origin")).mapInArrow(run, "doc_id long, source string, n_tokens long, fp long"), "measured")
    # fingerprints that link to no other are a cluster of their own, of all rows that have them
    nodes = stored(components(links(rows.where("fp IS NOT NULL").select("fp").distinct())), "components")
    joined = rows.join(nodes, F.col("fp") == F.col("node"), "left")
    return joined.select("doc_id", "n_tokens", "source", F.coalesce("root", "fp").alias("cluster"))


def sequences(docs: DataFrame, tokenizer: str, placed: DataFrame, capacity: int = 4096, end: int = 1, cache: int = 500_000) -> DataFrame:
    """bin_id, n_tokens, ids (little-endian unsigned 32 bits): the training sequences of what pack() has placed.

    Documents are known by doc_id, which must not be null or name different texts; repeated rows of one text
    fill each place that they were given.
    """

    def run(it):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks, step = chunks_of(tokenizer, cache), 4 * capacity
        for b in batches(it, 500):
            for doc, ids in zip(b.column("doc_id").to_pylist(), tokens_of(b.column("text").to_pylist(), chunks, end), strict=True):
                parts = [ids[k : k + step] for k in range(0, len(ids), step)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["d", "nth", "ids"])

    parts = text_rows(docs).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).mapInArrow(run, "d long, nth int, ids binary")
    met = placed.join(parts, (F.col("doc_id") == F.col("d")) & (F.col("piece") == F.col("nth")))
    # a bin has at most capacity pieces and ids
    each = met.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("bin_offset", "ids"))).alias("all"))
    return each.select("bin_id", "n_tokens", F.expr("aggregate(all, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
