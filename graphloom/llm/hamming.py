"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments.  In round s every query looks, in each segment's index, for the values at
exactly s bits from its own.  A code that first shows up in round s has s bits or more of difference in
every segment, so after round s all codes within segments * (s + 1) - 1 bits are known; a query is done when
its k-th verified distance is no more than that, and in its last round it looks only in as many segments as
it takes.  Probes are queries times masks, far more than Spark's size check expects of a generated table, so
they are broadcast only where they are counted and few; else both sides are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 64
#: So many probes, of about 100 bytes each, go to every executor; more are shuffled.
BROADCAST_PROBES = 100_000


def codes(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, code: bit i is 1 where element i is above zero.  Null vectors have no code; null elements give 0."""
    bits = F.aggregate(F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    fits = F.assert_true(F.size(vector) <= BITS, F.lit(f"vectors of more than {BITS} elements have no code"))
    return embeddings.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(fits.cast("long"), bits).alias("code"))


def layout(n: int) -> list[tuple[int, int]]:
    """(offset, bits) of the segments: a value of one has about four of n codes, so probes and candidates balance."""
    m = max(2, min(8, round(BITS / max(8, math.log2(max(2, n)) - 2))))
    cuts = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(code: str, at: int, bits: int) -> str:
    return f"(shiftrightunsigned({code}, {at}) & {(1 << bits) - 1}L)"


def _least(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def search(embeddings: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, hamming: for each row of queries its k nearest other rows of embeddings.

    Order: distance, then id; the query's own id is left out.  Equal codes are searched once, and of the rows
    of one code only the k + 1 smallest ids can be results.  Fewer than k other rows: all of them.  Null ids
    and null vectors are neither queries nor results.  Repeated rows of an id count once.  Empty: no rows.
    """
    spark = embeddings.sparkSession
    all_codes = stored(codes(embeddings, id_col, vector).distinct(), "codes")
    # the rows of a code, however many: the smallest ids of sixteen parts, then of all
    few = _least(all_codes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16))), ["code", "part"], ["id"], k + 1)
    few = stored(_least(few.select("id", "code"), ["code"], ["id"], k + 1).groupBy("code").agg(F.collect_list("id").alias("ids")), "classes")
    n = few.count()
    total = few.agg(F.sum(F.size("ids"))).first()[0] or 0
    need = min(k + 1, total)
    asked = stored(codes(queries, id_col, vector).distinct(), "queries")
    active = stored(asked.select(F.col("code").alias("q")).distinct().withColumn("most", F.lit(BITS)), "active")
    segs = layout(n)
    m = len(segs)
    entry = lambda code: F.expr("array(" + ", ".join(f"struct({j} AS j, {_segment(code, a, b)} AS v)" for j, (a, b) in enumerate(segs)) + ")")
    index = few.select("code", "ids", F.explode(entry("code")).alias("e")).select("code", "ids", F.col("e.j").alias("ij"), F.col("e.v").alias("iv"))
    best, waiting = None, active.count()
    # a round's masks: the segment, its bits, the mask and the bit from which the next round goes on
    masks = spark.createDataFrame([(j, b, 0, 0) for j, (_, b) in enumerate(segs)], "j int, b int, mask long, next int")
    off = [f"bit_count({_segment('(code ^ q)', a, b)})" for a, b in segs]
    own = "CASE j " + " ".join(f"WHEN {j} THEN {_segment('q', a, b)}" for j, (a, b) in enumerate(segs)) + " END"
    for s in range(max(b for _, b in segs) + 1):
        if s:
            masks = masks.where("next < b").withColumn("i", F.expr("explode(sequence(next, b - 1))")).selectExpr("j", "b", "mask | shiftleft(1L, i) AS mask", "i + 1 AS next")
        masks = stored(masks, "masks")
        # a code counts where it is first met: in no segment nearer, and in none before as near
        first = " AND ".join(f"({x} > {s} OR j <= {j} AND {x} = {s})" for j, x in enumerate(off))
        # with the first t segments of the round all within m * s + t - 1 bits are known
        probes = active.crossJoin(masks).where(f"j <= most - {m * s}").selectExpr("q", "most", "j", f"{own} ^ mask AS v")
        few_probes = waiting * sum(math.comb(b, s) for _, b in segs) <= BROADCAST_PROBES
        probes = F.broadcast(probes) if few_probes else probes.hint("merge")
        near = F.expr("bit_count(code ^ q) <= most")
        hit = probes.join(index, (F.col("j") == F.col("ij")) & (F.col("v") == F.col("iv")) & near & F.expr(first))
        found = hit.select("q", F.expr("bit_count(code ^ q)").alias("hamming"), F.explode("ids").alias("id"))
        best = stored(_least(found if best is None else best.unionByName(found), ["q"], ["hamming", "id"], k + 1), "best")
        known = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("hamming").alias("d")).withColumnRenamed("q", "kq")
        left = active.join(known, F.col("q") == F.col("kq"), "left").where(f"n IS NULL OR n < {need} OR d > {m * (s + 1) - 1}")
        active = stored(left.select("q", F.expr(f"if(n >= {need}, d, {BITS})").alias("most")), "active")
        waiting = active.count()
        if not waiting:
            break
    mine = asked.select(F.col("id").alias("query_id"), "code").join(best, F.col("code") == F.col("q")).where("query_id <> id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hamming", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("neighbor_id"), F.col("hamming").cast("int").alias("hamming"))
