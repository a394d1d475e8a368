"""The corpus pipeline: rules, classifier, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import compression, packing, rules, runindex, similar
from graphloom.llm.common import stored, table
from graphloom.llm.queries import TOKENIZER, tokenizer_path


#: So many ids of eight bytes go to every executor; with more, the texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Strings of so many bytes that occur twice are sought; on the tables given, 51 words in a row take more (99.98 % of them).
PASSAGE_BYTES = 240
#: What is covered by such strings goes if it has so many words, or, where words aren't spaced, so many bytes.
PASSAGE_WORDS, LONG_BYTES = 50, 400


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose host is rejected go."""
    return rules.judge(docs, carry=tuple(docs.columns)).where("kept").select("carried.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled part of the whole table, predicts bad go."""
    model = compression.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if model is None:  # nothing to learn from: nothing is rejected
        return docs
    return compression.score(docs, model, carry=tuple(docs.columns)).where("predicted = 1").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (0.8 or more of five-word shingles) stays.

    It is that of the smallest doc_id (null comes last), then of the smallest hash of the text, then of the
    whole row; of rows that are equal throughout one stays.  Null and empty texts are copies of each other.
    """
    roots = similar.groups(docs)
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keys = docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("t")).groupBy("d", "t").agg(F.count(F.lit(1)).alias("n"))
    keys = stored(keys, "keys")
    named = keys.join(roots, F.col("t") == F.col("th"), "left").select("d", "t", "n", F.coalesce("root", "t").alias("root"))
    order = F.struct(F.col("d").isNull().alias("last"), "d", "t")
    named = stored(named.withColumn("order", order), "named")
    least = named.groupBy("root").agg(F.min("order").alias("first")).select(F.col("root").alias("of"), "first")
    judged = stored(named.join(least, F.col("root") == F.col("of")).select("d", "t", "n", (F.col("order") == F.col("first")).alias("stays")), "judged")
    # keys that go, and those that stay with one row of several
    out = _of(docs, text, judged.where("NOT stays OR n > 1"), "left_anti")
    several = judged.where("stays AND n > 1")
    if several.limit(1).count():
        rows = _of(docs, text, several, "left_semi").groupBy(F.col("doc_id").alias("_key_d"), text.alias("_key_t"))
        one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
        out = out.unionByName(rows.agg(one.alias("_row")).select("_row.*"))
    return out


def _of(docs: DataFrame, text, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) one of the keys (d, t)."""
    keys = stored(keys.select(F.col("d").alias("_key_d"), F.col("t").alias("_key_t")), "some_keys")
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("_key_d")) & (text == F.col("_key_t")), how)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or LONG_BYTES bytes that occur elsewhere too are cut out, in whichever text.

    A passage is what strings of PASSAGE_BYTES that start elsewhere too cover, without a gap.  What is left
    of a cut character goes with it.
    """
    got = runindex.cut(docs, PASSAGE_BYTES, carry=tuple(docs.columns), least_words=PASSAGE_WORDS, sure=LONG_BYTES)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return got.select(*((new[c] if c in new else F.col("carried").getField(c)).alias(c) for c in docs.columns))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(packing.measured(docs, tokenizer_path(TOKENIZER)))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", best_fit),
]

#: The trained classifier and the packing can't be written in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
