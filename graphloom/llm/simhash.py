"""SimHash near-duplicates by deletion variants.

Fingerprints of 64 bits that differ in at most two bits differ, in one of their two halves, in at most
one bit.  So each distinct fingerprint is indexed under its halves with one bit wildcarded (64 keys), equal
keys meet, and pairs are verified.  A key with very many fingerprints isn't paired: its fingerprints are
indexed once more with every two bits wildcarded, where at most four can share a key and all of them link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, text_rows, width
from .components import components

SEED = 42


def shingles(text: str, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of every word shingle of the text, A-Z lower-cased; of fewer words, one of all.  distinct: of each once."""
    w = text.encode().lower().split()
    if len(w) < words:
        rows = [b" ".join(w)] if w else []
    else:
        rows = w if words == 1 else list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    if distinct:
        rows = set(rows)
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in rows), np.uint64, len(rows))


def fingerprint(text: str, words: int = 3, distinct: bool = False) -> int:
    """Bit by bit the majority of XXH64 over the word shingles of the text, A-Z lower-cased; no word: 0.  distinct: repeats count once."""
    h = shingles(text, words, distinct)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # a part of a very long text at a time
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(it):
        for b in batches(it):
            got = np.array([fingerprint(x, words) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


def _one_wildcard(fps: DataFrame) -> DataFrame:
    """k, fp: 64 keys for each fp; k has the half's 32 bits without the wildcard, then which of the 64 it is."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    half = "(shiftrightunsigned(fp, if(v >= 32, 32, 0)) & 4294967295L)"
    return v.selectExpr(f"shiftleft({half} & ~shiftleft(1L, v & 31), 6) | v AS k", "fp")


def _two_wildcards(fps: DataFrame) -> DataFrame:
    """Links of fingerprints that agree but for two bits: such a key has four at most."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    keyed = v.selectExpr("fp", "i * 64 + j AS p", "fp & ~shiftleft(1L, i) & ~shiftleft(1L, j) AS m")
    met = keyed.groupBy("p", "m").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    return met.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).where("a <> b").select("a", "b")


def _within(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Enough verified pairs of a key's fingerprints to connect all that verified pairs connect."""
    x = fps.view(np.uint64)
    left, pairs = np.ones(len(x), bool), []
    while left.any():
        first = int(np.argmax(left))
        left[first], todo = False, [first]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(x ^ x[i]) <= most))
            left[near] = False
            pairs += [(int(fps[i]), int(fps[j])) for j in near]
            todo += near.tolist()
    return pairs


def links(fps: DataFrame, large: int = 256, broadcast_keys: int = 500_000) -> DataFrame:
    """a, b: verified pairs of the distinct fingerprints fps (fp) within two bits, enough for all components."""
    # 64 keys each: about a million rows for a task, however few the files
    spread = max(width(fps.sparkSession), -(-fps.count() // 20_000))
    keyed = _one_wildcard(fps.repartition(spread))
    keys = stored(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "keys")
    near = "bit_count(a ^ b) <= 2"
    found = keys.where("n = 2").where(near).select("a", "b")

    def run(it):
        for b in it:
            got = [p for row in b.column("fps") for p in _within(row.values.to_numpy(zero_copy_only=False), 2)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], names=["a", "b"])

    shared = keys.where(f"n > 2 AND n <= {large}").select("k")
    if shared.count() <= broadcast_keys:  # 8 bytes each; with more, both sides are shuffled
        shared = F.broadcast(shared)
    some = keyed.join(shared, "k").groupBy("k").agg(F.collect_list("fp").alias("fps"))
    found = found.unionByName(some.select("fps").mapInArrow(run, "a long, b long"))
    many = keys.where(f"n > {large}").select("k")
    if many.limit(1).count():
        found = found.unionByName(_two_wildcards(keyed.join(many, "k").select("fp").distinct()))
    return found.distinct()


def classes(docs: DataFrame, words: int = 3, large: int = 256) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row.

    Null text: no word, fingerprint 0, which links like any other.  Null doc_id: in a class but never its
    id, unless all its rows have none.  Repeated rows fall into one class.  Empty table: no rows.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    each = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    nodes = stored(components(links(each.select("fp"), large)), "components")
    first = each.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")
