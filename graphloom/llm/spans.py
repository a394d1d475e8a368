"""Substring deduplication over sliding spans of sentences.

Runs of consecutive sentences are hashed, equal hashes meet across all documents, and each sentence that lies
in a run which is not its hash's first occurrence is removed.  By default, from every sentence on, the run that
has at least ``span`` sentences and ``words`` words is hashed; with ``fixed``, also every run of so many
sentences, single sentences of enough words, and the last sentences of each text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, stored, text_rows

_END = re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*\s+|\n+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Where each sentence lies with the space behind it; a sentence ends after . ! ? before white space, or with its line."""
    cuts = [m.end() for m in _END.finditer(text)]
    edges = [0, *(c for c in cuts if c < len(text)), len(text)] if text else []
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def key(sentence: str) -> bytes:
    return " ".join(sentence.split()).lower().encode()


def _ends(keys: list[bytes], span: int, words: int) -> list[int | None]:
    """For each sentence, where the run that begins with it ends; None if the text ends first."""
    sizes = [k.count(b" ") + 1 for k in keys]
    out: list[int | None] = []
    total = j = 0
    for i in range(len(keys)):
        while j < len(keys) and (total < words or j - i < span):
            total += sizes[j]
            j += 1
        out.append(j if total >= words and j - i >= span else None)
        total -= sizes[i]
    return out


def runs(text: str, span: int, words: int) -> list[tuple[int, int, int]]:
    """First sentence and 128-bit hash (as two signed longs) of every run; blank sentences are left out before."""
    keys = [k for a, b in sentences(text) if (k := key(text[a:b]))]
    out = []
    for i, j in enumerate(_ends(keys, span, words)):
        if j is not None:
            d = xxhash.xxh3_128_digest(b"\n".join(keys[i:j]))
            out.append((i, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return out


def every_run(keys: list[bytes], fixed: int, span: int, words: int) -> list[tuple[int, int]]:
    """Begin and end of every run of fixed sentences, of one and of span or more with so many words, and of the text's last fixed - 1.

    Left out are runs whose sentences all lie in shorter ones of these: where a run repeats, so do they.
    """
    n = len(keys)
    total = [0]
    for k in keys:
        total.append(total[-1] + k.count(b" ") + 1)
    tail = (max(0, n - fixed + 1), n)
    out: list[tuple[int, int]] = []
    has: set[tuple[int, int]] = set()
    for size in range(1, min(fixed, n) + 1):
        for i in range(n - size + 1):
            run = (i, i + size)
            by_content = size == fixed or (size == 1 or size >= span) and total[i + size] - total[i] >= words
            if by_content or run == tail:
                inner = [(a, a + m) for m in range(1, size) for a in range(i, i + size - m + 1) if (a, a + m) in has]
                if len({x for a, b in inner for x in range(a, b)}) < size:
                    out.append(run)
            if by_content:  # a tail is one only where its text ends
                has.add(run)
    return out


def digest(keys: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b"\n".join(keys))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def runs_of(text: str, fixed: int, span: int, words: int) -> list[tuple[int, int, int, int]]:
    """First sentence, number of sentences and 128-bit hash of the runs to compare; without fixed, of runs()."""
    keys = [k for a, b in sentences(text) if (k := key(text[a:b]))]
    which = every_run(keys, fixed, span, words) if fixed else [(i, j) for i, j in enumerate(_ends(keys, span, words)) if j is not None]
    return [(i, j - i, *digest(keys[i:j])) for i, j in which]


def cut_out(text: str, found: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the sentences of the runs (first, number); how many it has and how many went."""
    gone = {x for i, n in found for x in range(i, i + n)}
    kept, i, out = [], 0, 0
    for a, b in sentences(text):
        if not key(text[a:b]):
            kept.append(text[a:b])
            continue
        if i in gone:
            out += 1
        else:
            kept.append(text[a:b])
        i += 1
    return "".join(kept) if gone else text, i, out


def without(text: str, starts: set[int], span: int, words: int) -> tuple[str, int, int]:
    """The text without the sentences of runs that begin at starts; how many it has and how many went."""
    cuts = sentences(text)
    keys = [key(text[a:b]) for a, b in cuts]
    full = [k for k in keys if k]
    if not starts:
        return text, len(full), 0
    ends, upto = _ends(full, span, words), 0
    kept, i, gone = [], 0, 0
    for (a, b), k in zip(cuts, keys, strict=True):
        if not k:
            kept.append(text[a:b])
            continue
        if i in starts:
            upto = max(upto, ends[i])
        if i < upto:
            gone += 1
        else:
            kept.append(text[a:b])
        i += 1
    return "".join(kept), i, gone


def dedup(docs: DataFrame, span: int = 2, words: int = 14, carry: tuple[str, ...] = (), fixed: int = 0) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept (the text that stays) of every row, and a struct, carried, of the columns in carry.

    With fixed, every run of so many sentences counts, however short, and besides them single sentences and
    runs with enough words and the last fixed - 1 sentences of each text (all, if it has fewer): see every_run.
    The first occurrence of a run is that with the smallest (doc_id, place); a null doc_id comes last.
    Sentences are compared lower-cased, with white space folded.  Texts without a whole run stay as they
    are.  Null text: empty.  Rows of one doc_id count as documents in the order of a hash of their text, but
    rows that repeat both doc_id and text are the same document and lose nothing to each other.  Empty
    table: no rows.
    """

    own = lambda df: df.withColumns({"d": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "th": F.xxhash64("text")})

    def hashed(it):
        names = ("h1", "h2", "d", "th", "pos", "n")
        for b in batches(it, 1000):
            cols: list[list[int]] = [[] for _ in names]
            for d, th, text in zip(*(b.column(x).to_pylist() for x in ("d", "th", "text")), strict=True):
                for pos, n, h1, h2 in runs_of(text, fixed, span, words):
                    for col, x in zip(cols, (h1, h2, d, th, pos, n), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.int32()) for c in cols[4:]], names=list(names))

    all_runs = stored(own(text_rows(docs)).select("d", "th", "text").mapInArrow(hashed, "h1 long, h2 long, d long, th long, pos int, n int"), "runs")
    # written, so that both sides of the join are plain shuffles, whose hot keys are split
    firsts = stored(all_runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("d", "pos", "th")).alias("first")).where("times > 1").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), "firsts")
    met = all_runs.join(firsts, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    later = met.where(F.struct("d", "pos", "th") != F.col("first")).select(F.col("d").alias("w1"), F.col("th").alias("w2"), "pos", "n")
    starts = later.groupBy("w1", "w2").agg(F.collect_set(F.struct("pos", "n")).alias("starts"))
    rows = own(text_rows(docs, *carried(carry)))
    joined = rows.join(starts, (F.col("d") == F.col("w1")) & (F.col("th") == F.col("w2")), "left")

    def cut(it):
        for b in batches(it, 500):
            got = [cut_out(t, [(x["pos"], x["n"]) for x in s or ()]) for t, s in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True)]
            keep = [(f.name, b.column(i)) for i, f in enumerate(b.schema) if f.name not in ("text", "starts")]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.string())], names=[*(n for n, _ in keep), "n_sentences", "n_removed", "kept"])

    slim = joined.drop("d", "th", "w1", "w2")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name not in ("text", "starts"))
    return slim.mapInArrow(cut, f"{schema}, n_sentences long, n_removed long, kept string").select("doc_id", "n_sentences", "n_removed", "kept", *(["carried"] if carry else []))
