"""Quality classifier by compression.

Two zstandard dictionaries are trained on good and on bad labelled texts.  A text is cut into pieces of
about a kilobyte, each piece is compressed with either dictionary and with none, and the normalised
difference of the two sizes over the whole text, with the share that is left without a dictionary, goes
through a logistic calibration.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, text_rows

PIECE = 1024
LEVEL = 3
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    means: list[float]
    scales: list[float]


class Scorer:
    def __init__(self, model: Model):
        self.model, self._pack = model, []
        for raw in (model.good, model.bad, None):
            if raw is None:
                self._pack.append(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False))
                continue
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self._pack.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, float]:
        """(bad - good) / (bad + good) and plain / length, of the whole text's compressed sizes."""
        raw = text.encode()
        if not raw:
            return 0.0, 1.0
        good, bad, plain = (sum(len(pack.compress(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)) for pack in self._pack)
        return (bad - good) / (bad + good), plain / len(raw)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 2)
        return _sigmoid(_design((x - self.model.means) / self.model.scales) @ np.array(self.model.weights))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _design(x: np.ndarray) -> np.ndarray:
    """Linear in the difference, so that a text more like the good never scores less; bent at the mean in the share."""
    x = np.clip(x, -6, 6)
    return np.column_stack([np.ones(len(x)), x, np.minimum(x[:, 1:], 0)])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(60):
        p = _sigmoid(x @ beta)
        grad = x.T @ (w * (p - y)) + penalty * beta * w.sum()
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty * w.sum() + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = 8 << 20, dict_bytes: int = 64 << 10, longest: int = 128 << 10) -> Model | None:
    """Learn from labelled documents outside the held-out fifth; None if either class has fewer than 8.

    The sample is bounded: of each class the per_class documents with the smallest hash of their id, of these
    those of at most longest bytes, and of these, in that order, as many as make most_bytes.  Repeated rows
    count once, and only what is taken comes to the driver.  Every second of them goes into a dictionary,
    the others calibrate.  Class shares come from all labels.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(f"NOT ({HELD_OUT})").distinct()
    share = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(share.get(0, 0), share.get(1, 0)) < 8:
        return None
    drawn = [marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * per_class rows of two numbers
    # numbers first: texts come to the driver only when it is known which, so never more than 2 * most_bytes
    sized = text_rows(docs).join(picked, "doc_id").where(f"text <> '' AND octet_length(text) <= {longest}").select("doc_id", "quality", F.octet_length("text").alias("size"), F.xxhash64("text").alias("t"))
    size = {0: 0, 1: 0}
    chosen = []
    for r in sized.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(2 * per_class).collect():
        if size[r["quality"]] + r["size"] <= most_bytes:
            chosen.append(r)
            size[r["quality"]] += r["size"]
    want = docs.sparkSession.createDataFrame([(r["doc_id"], r["t"]) for r in chosen], "want_d long, want_t long").distinct()
    found = text_rows(docs).withColumn("t", F.xxhash64("text")).join(F.broadcast(want), (F.col("doc_id") == F.col("want_d")) & (F.col("t") == F.col("want_t")))
    text = {(r["doc_id"], r["t"]): r["text"].encode() for r in found.select("doc_id", "t", "text").dropDuplicates(["doc_id", "t"]).collect()}
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in chosen:
        texts[r["quality"]].append(text[r["doc_id"], r["t"]])
    if min(map(len, texts.values())) < 8:
        return None
    made = []
    times = Counter(line for q in (0, 1) for t in texts[q][::2] for line in set(t.split(b"\n")))
    for q in (1, 0):
        # a line that several documents share, a licence or a quotation, says nothing on quality
        own = [b"\n".join(line for line in t.split(b"\n") if times[line] == 1) for t in texts[q][::2]]
        pieces = [t[k : k + PIECE] for t in own for k in range(0, len(t), PIECE)]
        try:
            made.append(zstandard.train_dictionary(dict_bytes, pieces, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the pieces themselves
            made.append(b"".join(pieces)[:dict_bytes])
    model = Model(made[0], made[1], [0.0], [0.0, 0.0], [1.0, 1.0])
    scorer = Scorer(model)
    x = np.array([scorer.features(t.decode()) for q in (0, 1) for t in texts[q][1::2]])
    y = np.array([q for q in (0, 1) for _ in texts[q][1::2]], float)
    total = share[0] + share[1]
    w = np.where(y == 1, share[1] / total / y.sum(), share[0] / total / (len(y) - y.sum())) * len(y)
    model.means, model.scales = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    model.weights = _logistic(_design((x - model.means) / model.scales), y, w).tolist()
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and a struct, carried, of the columns named in carry.

    Without a model (nothing to learn from) every text scores 0.5.  Null and empty text score alike, as
    incompressible.  Null doc_id: not held out.  Ties and repeated rows
    score alike; empty table: no rows; other columns are ignored.
    """

    def run(it):
        scorer = Scorer(model) if model else None
        for b in batches(it):
            s = scorer.scores(b.column("text").to_pylist()) if scorer else np.full(b.num_rows, 0.5)
            keep = [(f.name, b.column(i)) for i, f in enumerate(b.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=[*(n for n, _ in keep), "score", "predicted"])

    rows = text_rows(docs, *carried(carry)).withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, score double, predicted int").select("doc_id", "held_out", "score", "predicted", *(["carried"] if carry else []))
