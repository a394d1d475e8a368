"""Exact removal of long repeated substrings with run-length compressed Burrows-Wheeler indexes.

Equal windows of ``length`` bytes have the same least k-gram hash (minimizer), so the text is cut into
segments of neighbouring windows that share one, and windows can only repeat within the segments of one
minimizer.  Equal segments collapse into one with a count, and where it is above one all their windows are
repeated; where all segments of a minimizer are equal that is all there is to know.  Where different
segments share a minimizer, a run-compressed Burrows-Wheeler transform is built over them: only at the ends
of its runs are the suffix array and the common prefix with the next suffix sampled, and matching statistics
of every position, its own suffix excluded, stream from these samples, since between samples they fall by
one each byte.  Windows with a match of ``length`` bytes or more are marked.

A minimizer with more text than one index should hold is cut again with longer k-grams, until the k-gram is
the window itself and all segments of a group are equal.  So no group is too large and none is cut short.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, stored, text_rows, trim, width

PIECE = 512  # windows in a segment, at most
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(8 * 256), "<u8").astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, root: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.empty(max(n, 1 << 17), np.uint64)
        got[0] = 1
        got[1:] = root
        _powers[name] = got = np.multiply.accumulate(got)
    return got[:n]


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram, by differences of prefix sums."""
    n = len(raw)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * _power("up", _ROOT, n), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _power("down", _INVERSE, n - k + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by running minima of blocks from both sides."""
    if w == 1:
        return h
    n = len(h)
    blocks = -(-n // w)
    x = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = h
    x = x.reshape(blocks, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(raw: bytes, k: int, length: int, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of the text's segments; windows start at each byte.

    The last array tells which segments have their minimizer twice or more: only those can hold a window
    that occurs twice within the segment.

    A very long text is taken in overlapping parts, so memory is bounded; a segment ends with its part,
    which is right, as each window is in one segment.
    """
    found = []
    for at in range(0, max(0, len(raw) - length + 1), part):
        x = np.frombuffer(raw, np.uint8, min(part + length - 1, len(raw) - at), at)
        w = length - k + 1
        h = _gram_hashes(x, k)
        m = _window_min(h, w)
        cut = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        size = np.diff(np.r_[cut, len(m)])
        if (size > PIECE).any():
            pieces = -(-size // PIECE)
            which = np.repeat(np.arange(len(cut)), pieces)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut, size = cut[which] + nth * PIECE, np.minimum(PIECE, size[which] - nth * PIECE)
        view, twice = np.lib.stride_tricks.sliding_window_view(h, w), np.empty(len(cut), bool)
        for j in range(0, len(cut), 4096):
            a = cut[j : j + 4096]
            b = a + size[j : j + 4096] - 1
            twice[j : j + 4096] = a + view[a].argmin(axis=1) != b + w - 1 - view[b][:, ::-1].argmin(axis=1)
        found.append((m[cut].view(np.int64), at + cut, size, twice))
    if not found:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class RunIndex:
    """A run-length BWT of texts with samples at run ends; answers matching statistics.

    The suffix array serves to make it and isn't kept: what stays is, for each run, its symbol and length,
    and for each run end its place in the texts and how far the match with the neighbouring suffix reaches.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        s = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
        s[self.starts + sizes - 1] = 0  # ends a text; bytes are 1 to 256
        self.n = n = len(s)
        # suffix array by doubling, from seven symbols a key; the ranks of each depth stay for common prefixes
        key = np.zeros(n, np.int64)
        for j in range(7):
            key <<= 9
            key[: max(0, n - j)] |= s[j:]
        ranks, depth = [], 7
        while True:
            order = np.argsort(key)
            ordered = key[order]
            new = np.zeros(n, np.int32)
            np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
            rank = np.empty(n, np.int32)
            rank[order] = new
            ranks.append((depth, rank))
            if new[-1] == n - 1:
                break
            key = rank.astype(np.int64) * (n + 1)
            key[: max(0, n - depth)] += rank[depth:] + 1
            depth *= 2
        bwt = s[order - 1]
        bwt[rank[0]] = -1  # nothing stands before the first symbol
        heads = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        tails = np.r_[heads[1:] - 1, n - 1]
        self.symbols, self.lengths = bwt[heads], tails - heads + 1
        # sampled where a run begins: the common prefix with the suffix before; where it ends: with that behind
        before, behind = heads[heads > 0], tails[tails < n - 1]
        at = order[np.r_[before, behind]]
        reach = _reach(s, ranks, at, order[np.r_[before - 1, behind + 1]])
        place = np.argsort(at, kind="stable")
        self.sampled, self.reach = at[place], reach[place]

    def statistics(self) -> np.ndarray:
        """For each position, texts and their ends in a row, the length of its longest match elsewhere.

        Between samples a match only gets shorter by what lies before, so the furthest reach so far holds.
        """
        furthest = np.r_[0, np.maximum.accumulate(self.reach)]
        held = np.diff(np.r_[0, self.sampled, self.n])
        here = np.arange(self.n)
        return np.repeat(furthest, held).clip(here) - here


def _reach(s: np.ndarray, ranks: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the common prefix of the suffixes at a and b ends, as a place behind a."""
    n, x, y = len(s), a.copy(), b.copy()
    for depth, rank in reversed(ranks):
        same = (x < n) & (y < n)
        same[same] = rank[x[same]] == rank[y[same]]
        x[same] += depth
        y[same] += depth
    open_ = np.ones(len(x), bool)
    for _ in range(6):
        open_ &= (x < n) & (y < n)
        open_[open_] = s[x[open_]] == s[y[open_]]
        x[open_] += 1
        y[open_] += 1
    return x


def _runs_of(mask: np.ndarray) -> bytes:
    """Runs [a, b) of true values, as pairs of 32-bit integers."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge.astype("<i4").tobytes()


def _full(n: int) -> bytes:
    return np.array([0, n], "<i4").tobytes()


def marked(texts: list[bytes], counts: list[int], length: int) -> list[bytes | None]:
    """For each distinct text the runs of its windows that occur elsewhere; those of a text with copies all do."""
    index = RunIndex(texts)
    stat = index.statistics() >= length
    out: list[bytes | None] = []
    for t, c, at in zip(texts, counts, index.starts.tolist(), strict=True):
        n = len(t) - length + 1
        runs = _full(n) if c > 1 else _runs_of(stat[at : at + n])
        out.append(runs or None)
    return out


_SEGMENT = "mh long, sh long, o1 long, o2 long, start int, windows int, c long, twice boolean"


def _segment_rows(owners: DataFrame, k: int, length: int) -> DataFrame:
    """owners: o1, o2, text (string or binary), c."""

    def run(it):
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        for b in batches(it, 1000):
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for o1, o2, text, c in zip(*(b.column(x).to_pylist() for x in ("o1", "o2", "text", "c")), strict=True):
                raw = text.encode() if isinstance(text, str) else text
                mh, start, n, twice = segments(raw, k, length)
                sh = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + w + length - 1]) for a, w in zip(start.tolist(), n.tolist(), strict=True)), np.uint64, len(n))
                full = np.ones(len(n), np.int64)
                for col, x in zip(cols, (mh, sh.view(np.int64), full * o1, full * o2, start.astype(np.int32), n.astype(np.int32), full * c, twice), strict=True):
                    col.append(x)
            if any(map(len, cols[0])):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], names=names)

    return owners.select("o1", "o2", "text", "c").mapInArrow(run, _SEGMENT)


def _cut_out(owners: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments (mh, sh, windows, c, o1, o2, start): mh, sh, windows, c, text."""
    each = wanted.groupBy(F.col("o1").alias("w1"), F.col("o2").alias("w2")).agg(F.collect_list(F.struct("mh", "sh", "windows", "c", "start")).alias("cuts"))
    met = owners.select("o1", "o2", "text").join(each, (F.col("o1") == F.col("w1")) & (F.col("o2") == F.col("w2"))).select("text", "cuts")

    def run(it):
        for b in batches(it, 500):
            got = []
            for text, cuts in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                raw = text.encode() if isinstance(text, str) else text
                got += [(x["mh"], x["sh"], x["windows"], x["c"], raw[x["start"] : x["start"] + x["windows"] + length - 1]) for x in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["mh", "sh", "windows", "c", "text"])

    # owners that are repeated rows give the same segments, hence the distinct
    return met.mapInArrow(run, "mh long, sh long, windows int, c long, text binary").dropDuplicates(["mh", "sh"])


def _indexed(cut: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """mh, sh, runs of the windows that occur elsewhere; a minimizer's segments come to one index."""

    def run(it):
        mh: list[int] = []
        sh, counts, texts, size = [], [], [], 0

        def flush():
            runs = marked(texts, counts, length)
            keep = [i for i, r in enumerate(runs) if r]
            return pa.RecordBatch.from_arrays([pa.array([mh[i] for i in keep], pa.int64()), pa.array([sh[i] for i in keep], pa.int64()), pa.array([runs[i] for i in keep], pa.binary())], names=["mh", "sh", "runs"])

        for b in it:
            for m, s, c, t in zip(*(b.column(x).to_pylist() for x in ("mh", "sh", "c", "text")), strict=True):
                if size >= index_bytes and m != mh[-1]:
                    yield flush()
                    mh, sh, counts, texts, size = [], [], [], [], 0
                mh.append(m)
                sh.append(s)
                counts.append(c)
                texts.append(t)
                size += len(t)
        if texts:
            yield flush()
        trim()

    return cut.repartition(width(cut.sparkSession), "mh").sortWithinPartitions("mh", "sh").mapInArrow(run, "mh long, sh long, runs binary")


def repeated_windows(owners: DataFrame, length: int, grams: tuple[int, ...], index_bytes: int) -> DataFrame:
    """o1, o2, start, windows, runs: for owners (o1, o2, text, c: how often it occurs) the windows that occur elsewhere too.

    runs are relative to start; null stands for all windows from start on.
    """
    segs = stored(_segment_rows(owners, grams[0], length), "segments")
    # written, so that both sides of the join are plain shuffles, whose hot keys are split
    per = stored(segs.groupBy("mh").agg(F.sum("c").alias("n"), F.min("sh").alias("a"), F.max("sh").alias("b"), F.max("twice").alias("t")).where("n > 1 OR t").selectExpr("mh AS g", "a = b AND n > 1 AS alike"), "minimizers")
    shared = stored(segs.join(per, F.col("mh") == F.col("g")).drop("g", "twice"), "shared")
    alike = shared.where("alike").select("o1", "o2", "start", "windows").distinct()
    unlike = shared.where("NOT alike")
    rep = F.min(F.struct("o1", "o2", "start")).alias("rep")
    groups = stored(unlike.groupBy("mh", "sh", "windows").agg(F.sum("c").alias("c"), rep).select("mh", "sh", "windows", "c", "rep.*"), "groups")
    size = groups.groupBy("mh").agg(F.sum(F.col("windows").cast("long") + length - 1).alias("size"), F.count(F.lit(1)).alias("n"))
    hot = stored(size.where(f"size > {index_bytes}").select(F.col("mh").alias("hot")), "hot")
    cut = stored(_cut_out(owners, groups, length), "cut")
    some = bool(hot.limit(1).count()) and len(grams) > 1
    calm = cut.join(hot, F.col("mh") == F.col("hot"), "left_anti") if some else cut
    found = _indexed(calm, length, index_bytes).select("mh", "sh", F.lit(0).alias("start"), F.lit(0).alias("windows"), "runs")
    if some:
        deep = cut.join(hot, F.col("mh") == F.col("hot"), "left_semi").select(F.col("mh").alias("o1"), F.col("sh").alias("o2"), "text", "c")
        inner = repeated_windows(deep, length, grams[1:], index_bytes)
        found = found.unionByName(inner.select(F.col("o1").alias("mh"), F.col("o2").alias("sh"), "start", "windows", "runs"))
    found = stored(found, "found").select(F.col("mh").alias("f1"), F.col("sh").alias("f2"), F.col("start").alias("at"), F.col("windows").alias("n"), "runs")
    met = unlike.join(found, (F.col("mh") == F.col("f1")) & (F.col("sh") == F.col("f2"))).select("o1", "o2", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("windows"), "runs")
    return alike.withColumn("runs", F.lit(None).cast("binary")).unionByName(met)


def _absolute(pieces: list) -> np.ndarray:
    """Runs of windows relative to pieces of a text, as runs relative to the text."""
    return np.concatenate([(np.array([[0, p["windows"]]]) if p["runs"] is None else np.frombuffer(p["runs"], "<i4").reshape(-1, 2)).astype(np.int64) + p["start"] for p in pieces])


def covered(pieces: list, length: int) -> list[tuple[int, int]]:
    """Maximal removed stretches of bytes, from pieces (start, windows, runs)."""
    if not pieces:
        return []
    runs = _absolute(pieces)
    runs[:, 1] += length - 1
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    end = np.maximum.accumulate(runs[:, 1])
    new = np.r_[True, runs[1:, 0] > end[:-1]]
    firsts = np.flatnonzero(new)
    return list(zip(runs[firsts, 0].tolist(), end[np.r_[firsts[1:] - 1, len(end) - 1]].tolist(), strict=True))


def cut(docs: DataFrame, length: int = 400, grams: tuple[int, ...] | None = None, index_bytes: int = 1 << 19, carry: tuple[str, ...] = (), least_words: int = 0, sure: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text that stays, without the bytes left of cut characters) of every row,
    and a struct, carried, of the columns in carry.

    Each byte that lies in ``length`` bytes which also start elsewhere, in this or another document, goes;
    first occurrences too.  With least_words, a stretch of such bytes goes only if it has so many words
    between ASCII white space, or ``sure`` bytes.  Null text: no bytes.  Null doc_id, ties and repeated rows: each row is a
    document, so repeated rows remove each other.  Texts below ``length`` bytes stay.  Empty table: no rows.
    """
    grams = grams or (max(1, length // 4), max(1, length - 16), length)
    own = lambda df: df.withColumns({"o1": F.coalesce("doc_id", F.lit(-1)), "o2": F.xxhash64("text")})
    owners = own(text_rows(docs)).withColumn("c", F.lit(1).cast("long"))
    spans = repeated_windows(owners, length, grams, index_bytes)
    each = spans.groupBy(F.col("o1").alias("w1"), F.col("o2").alias("w2")).agg(F.collect_set(F.struct("start", "windows", "runs")).alias("pieces"))
    rows = own(text_rows(docs, *carried(carry)))
    met = rows.join(each, (F.col("o1") == F.col("w1")) & (F.col("o2") == F.col("w2")), "left").drop("o1", "o2", "w1", "w2")

    def run(it):
        for b in batches(it, 500):
            got = []
            for text, pieces in zip(b.column("text").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                raw = text.encode()
                gone = [(a, e) for a, e in covered(pieces or [], length) if not least_words or e - a >= sure or len(raw[a:e].split()) >= least_words]
                kept, at = [], 0
                for a, e in gone:
                    kept.append(raw[at:a])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                got.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            keep = [(f.name, b.column(i)) for i, f in enumerate(b.schema) if f.name not in ("text", "pieces")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), *(pa.array([g[i] for g in got], t) for i, t in enumerate(kinds))], names=[*(n for n, _ in keep), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name not in ("text", "pieces"))
    out = met.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(["carried"] if carry else []))
