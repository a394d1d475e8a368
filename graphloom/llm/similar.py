"""Near copies by word shingles: SimHash candidates within a radius, verified by Jaccard similarity.

Fingerprints that differ in at most 2 m - 1 bits differ, in one of m segments, in at most one bit.  A segment
is cut into pieces, one of which has that bit, so each text is listed under its segments without one piece
(with pieces of one bit these are the one-wildcard variants), and a list is compared in blocks of that piece
that agree but for one bit.  Lists get more pieces, so longer keys, as the table grows, and a list that is
long all the same is compared in pairs of blocks, each a task's row of its own.  Candidates whose sizes or
parity bitmaps show that they can't be similar enough are dropped (no pair that is similar enough is), and
the others are linked only if their shingle sets are.  Large groups of near copies are joined by few links
first (stars, then each text's nearest of another group), so the last round, which verifies every candidate
between different groups, has few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, text_rows
from .components import components
from .simhash import fingerprint, shingles

#: Longer lists are compared by blocks of a piece.
WHOLE = 1500
#: Longer lists are cut into blocks of about so many rows, which meet two by two.
BLOCK = 16_384
#: Keys are long enough for lists of about so many rows, where fingerprints are spread evenly.
LIST = 8_192
#: Bits of the parity bitmap of a shingle set.
PARITY = 512
#: So many ids of eight bytes go to every executor.
BROADCAST_IDS = 500_000


def segments(radius: int) -> list[tuple[int, int]]:
    """(offset, bits) of the segments: of fingerprints within radius, one differs in at most one bit."""
    m = radius // 2 + 1
    cuts = [64 * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(radius: int, n: int) -> list[tuple[int, int, int, int, bool]]:
    """(offset and mask of a segment without a piece, offset and bits of the piece, whether it is the segment's first)."""
    segs = segments(radius)
    least = min(bits for _, bits in segs)
    pieces = next((p for p in range(2, least) if n <= LIST << (least - -(-least // p))), least)
    out = []
    for at, bits in segs:
        cuts = [bits * q // pieces for q in range(pieces + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append((at, ((1 << bits) - 1) & ~(((1 << (b - a)) - 1) << a), at + a, b - a, a == 0))
    return out


def parity(h: np.ndarray) -> bytes:
    """For each of PARITY classes of hashes whether the set has an odd number: two sets differ in at least as many elements as their bitmaps in bits."""
    odd = np.bincount((h & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _blocks(fp: np.ndarray, at: int, bits: int, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions to compare: where a piece of fp differs in one bit or (if equal) in none."""
    if len(fp) <= WHOLE:
        every = np.arange(len(fp))
        yield every, every
        return
    u = ((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(u, kind="stable")
    edges = np.searchsorted(u[order], np.arange((1 << bits) + 1))
    of = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    for v, mine in enumerate(of):
        others = [of[v ^ (1 << i)] for i in range(bits) if v < v ^ (1 << i)] + ([mine] if equal else [])
        other = np.concatenate(others) if others else mine[:0]
        if len(mine) and len(other):
            yield mine, other


def pairs_of(rows: dict[str, np.ndarray], at: int, bits: int, equal: bool, radius: int, similarity: float, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of rows (fp, size, label, bitmap, side) within radius that can be similar enough, under different labels and on different sides; if nearest, one for each position and block."""
    fp, size, label, bitmap, side = (rows[x] for x in ("fp", "size", "label", "bitmap", "side"))
    apart = (1 - similarity) / (1 + similarity)  # sets may differ in so many of all elements of both
    for mine, other in _blocks(fp, at, bits, equal):
        step = max(1, (1 << 18) // len(other))
        for k in range(0, len(mine), step):
            some = mine[k : k + step]
            d = np.bitwise_count(fp[some][:, None] ^ fp[other][None, :])
            i, j = np.nonzero(d <= radius)
            a, b = some[i], other[j]
            fits = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] < 0)) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
            i, j, a, b = i[fits], j[fits], a[fits], b[fits]
            fits = np.bitwise_count(bitmap[a] ^ bitmap[b]).sum(1, dtype=np.int64) <= apart * (size[a] + size[b]) + 1e-6
            i, j = i[fits], j[fits]
            if nearest and len(i):
                order = np.lexsort((label[other[j]], d[i, j], i))
                i, j = i[order], j[order]
                first = np.concatenate(([True], i[1:] != i[:-1]))
                i, j = i[first], j[first]
            if len(i):
                yield some[i], other[j]


def candidates(nodes: DataFrame, radius: int, similarity: float, nearest: bool) -> DataFrame:
    """a, b: texts (th) of nodes (th, fp, size, label, bitmap) within radius that can be similar enough, under different labels."""
    cut = variants(radius, nodes.count())
    keys = ", ".join(f"{v} * 4294967296L + (shiftrightunsigned(fp, {at}) & {mask}L)" for v, (at, mask, *_) in enumerate(cut))
    keyed = nodes.select(F.expr(f"explode(array({keys}))").alias("k"), "th", "fp", "size", "label", "bitmap")
    # keys of one label have nothing to compare; the others' lists are cut into blocks that meet two by two
    live = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select(F.col("k").alias("lk"), F.expr(f"cast(ceil(n / {BLOCK}) AS int)").alias("nb"))
    met = keyed.join(live, F.col("k") == F.col("lk")).withColumn("own", F.pmod(F.xxhash64("th"), F.col("nb")).cast("int"))
    met = met.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("own", "x"), "j": F.greatest("own", "x")})
    names = ("th", "fp", "size", "label", "bitmap", "own")
    lists = met.groupBy("k", "i", "j").agg(F.collect_list(F.struct(*names)).alias("rows")).where("size(rows) > 1")
    lists = lists.selectExpr("k", "i", "j", *(f"rows.{x} AS {x}" for x in names))

    def run(it):
        for b in it:
            for k, i, j, *cols in zip(*(b.column(x).to_pylist() for x in ("k", "i", "j")), *(b.column(x) for x in names), strict=True):
                th, fp, size, label, bitmap, own = (c.values for c in cols)
                rows = {"fp": np.array(fp).view(np.uint64), "size": np.array(size), "label": np.array(label)}
                rows["bitmap"] = np.frombuffer(b"".join(bitmap.to_pylist()), np.uint64).reshape(-1, PARITY // 64)
                rows["side"] = np.array(own) if i != j else np.full(len(own), -1)
                th = np.array(th)
                _, _, *piece = cut[k >> 32]
                for x, y in pairs_of(rows, *piece, radius, similarity, nearest):
                    got = np.unique(np.sort(np.stack([th[x], th[y]], 1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def stars(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """a, b: each text with the least of those that share 24 bits of the fingerprint, if within radius."""
    keys = ", ".join(f"{i} * 4294967296L + (shiftrightunsigned(fp, {8 * i}) & 16777215L)" for i in range(6))
    keyed = nodes.select(F.expr(f"explode(array({keys}))").alias("k"), "th", "fp", "size")
    least = keyed.groupBy("k").agg(F.min(F.struct("th", "fp", "size")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("mk"), "m")
    met = keyed.join(least, F.col("k") == F.col("mk")).where(f"th <> m.th AND bit_count(fp ^ m.fp) <= {radius} AND least(size, m.size) >= {similarity} * greatest(size, m.size) - 1e-9")
    return met.select(F.col("m.th").alias("a"), F.col("th").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts whose sets of shingles have that Jaccard similarity or more."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct(), "wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = text_rows(docs).select("text", F.xxhash64("text").alias("th")).join(ids, F.col("th") == F.col("want"), "left_semi")

    def run(it):
        kind = pa.list_(pa.int64())
        for b in batches(it, 200):
            sets = [np.unique(shingles(t, words)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(sets, kind)], names=["th", "s"])

    # a text that many rows repeat is sent on once by each task at most
    sets = stored(texts.dropDuplicates(["th"]).mapInArrow(run, "th long, s array<long>"), "sets")
    left = pairs.join(sets.select(F.col("th").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("th").alias("b"), F.col("s").alias("sb")), "b")
    met = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return met.where(F.col("common") >= similarity * (F.col("n") - F.col("common")) - 1e-9).select("a", "b")


def groups(docs: DataFrame, words: int = 5, radius: int = 9, similarity: float = 0.8) -> DataFrame:
    """th (XXH64 of the text by Spark), root: the group of every text that has near copies other than itself.

    Fingerprints are over a text's distinct words, the sets over shingles of words: an edit changes fewer
    words than shingles, so copies are nearer.  Texts without words are copies of each other.  Null text:
    empty.  Empty table: no rows.
    """

    def run(it):
        for b in batches(it):
            texts = b.column("text").to_pylist()
            got = np.array([fingerprint(x, 1, True) for x in texts], np.uint64).view(np.int64)
            sets = [np.unique(shingles(x, words)) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(got, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(parity, sets), pa.binary())], names=["th", "fp", "size", "bitmap"])

    marked = text_rows(docs).select(F.xxhash64("text").alias("th"), "text").mapInArrow(run, "th long, fp long, size int, bitmap binary")
    nodes = stored(marked.groupBy("th").agg(*(F.min(x).alias(x) for x in ("fp", "size", "bitmap"))), "nodes")
    edges, roots = None, None
    now = nodes.withColumn("label", F.col("th"))
    for step in ("stars", "nearest", "all"):
        pairs = stored(stars(now, radius, similarity) if step == "stars" else candidates(now, radius, similarity, step == "nearest"), "candidates")
        new = stored(verified(pairs, docs, words, similarity), "links")
        edges = new if edges is None else edges.unionByName(new)
        if roots is None or step == "nearest" or new.limit(1).count():
            roots = stored(components(edges), "roots")
        if step != "all":
            now = stored(nodes.join(roots, F.col("th") == F.col("node"), "left").select("th", "fp", "size", "bitmap", F.coalesce("root", "th").alias("label")), "labelled")
    return roots.select(F.col("node").alias("th"), "root")
