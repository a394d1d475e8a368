"""Quality rules for documents and for their hosts.

Each text is judged by base rules.  A host's rate of failed documents is shrunk towards the rate of all
hosts by a beta prior fitted to the hosts themselves, and a host whose shrunk rate is too high takes its
documents with it.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, stored, text_rows

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words end at ASCII white space only."""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        times, done = Counter(windows), 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeats += i + 3 - max(i, done)
                done = i + 3
    return n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, the features and base_failed of every row, and a struct, carried, of the columns named in carry."""

    def run(it):
        for b in batches(it):
            got = list(zip(*map(features, b.column("text").to_pylist()), strict=True)) or [[]] * 5
            keep = [b.column(i) for i, f in enumerate(b.schema) if f.name != "text"]
            failed = [n < 50 or 100 * r > 50 * n for n, r in zip(got[0], got[4], strict=True)]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, pa.int64()) for x in got), pa.array(failed, pa.bool_())], names=[*(f.name for f in b.schema if f.name != "text"), *_NAMES, "base_failed"])

    rows = text_rows(docs, F.col(host).cast("string").alias("host"), *carried(carry))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*schema, *(f"{x} long" for x in _NAMES), "base_failed boolean"]))


def host_verdicts(measured: DataFrame, most: float = 0.5, least_strength: float = 1.0) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), rejected, for every host that is not null.

    The prior has the mean of the hosts' rates and, by the method of moments, their variance beyond what
    chance gives; where hosts don't differ it is as strong as all of an average host's documents.
    """
    hosts = stored(measured.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    p = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv"), F.avg("n_docs").alias("size")).first()
    mean = p["mean"] or 0.0
    spread = mean * (1 - mean)
    extra = (p["var"] or 0.0) - spread * (p["inv"] or 0.0)
    strength = max(least_strength, spread / extra - 1 if extra > 0 else (p["size"] or least_strength))
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > most)


def judge(docs: DataFrame, host: str = "source", most: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """The features, base_failed and kept of every row.

    kept: base rules hold and the host isn't rejected.  Null text: no words, so it fails.  Null host: base
    rules only.  Repeated rows are judged and counted each.  Empty table: no rows.  Columns named in carry
    come back in a struct, carried; others are ignored.
    """
    measured = stored(measure(docs, host, carry), "rules")
    bad = host_verdicts(measured, most).where("rejected").select(F.col("host").alias("bad_host"))
    # few hosts are rejected; a host with a third of all rows is split by the join's own skew handling
    joined = measured.join(bad, F.col("host") == F.col("bad_host"), "left")
    kept = ~F.col("base_failed") & F.col("bad_host").isNull()
    return joined.select("doc_id", *_NAMES, "base_failed", kept.alias("kept"), *(["carried"] if carry else []))
