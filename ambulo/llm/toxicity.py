"""Operator 10, toxicity by a character n-gram classifier with naive Bayes scaled features.

Features are the distinct character 3-, 4- and 5-grams of the lower-cased text, hashed. Each is scaled by its naive
Bayes log-count ratio between toxic and other training texts, and a logistic regression with an L2 penalty is fitted on
the scaled features. Features whose ratio may as well be zero (a test of significance) have weight zero. The fit runs
on a bounded sample of the labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, portions, table, tidy, unused

ORDERS = (3, 4, 5)
HASH_BITS = 20
#: Characters that are hashed at once.
PART = 1 << 18
#: Bound of the training sample: at most so many labelled rows, those of the least hash of doc_id.
TRAIN_ROWS = 8_000
#: Features are used whose log-count ratio is so many standard errors away from zero.
SIGNIFICANT = 4.0
SMOOTH, PENALTY, STEPS = 1.0, 1e-3, 300
THRESHOLD = 0.3


def ngrams(text: str | None) -> np.ndarray:
    """Hash buckets, some of them more than once, of the text's n-grams; spaces stand for all white space and both ends.

    Long texts are hashed in parts that overlap, each reduced to its distinct buckets.
    """
    if not text or not text.strip():
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) <= PART:
        return _hashed(codes)
    return np.concatenate([np.unique(_hashed(codes[at : at + PART + max(ORDERS) - 1])) for at in range(0, len(codes), PART)])


def _hashed(codes: np.ndarray) -> np.ndarray:
    codes, out = codes.astype(np.uint64), [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i]
                h ^= h >> np.uint64(29)
            out.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """Weights by hash bucket (zero for features not kept) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = ngrams(text)
        found = found[self.weights[found] != 0]
        z = self.bias + float(np.sort(self.weights[np.unique(found)].astype(np.float64)).sum())
        return 0.0 if z == -np.inf else 1.0 if z == np.inf else float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def in_training(doc_id: Column) -> Column:
    """Whether a labelled row may be learnt from; the other quarter is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The classifier of `docs` by `labels(doc_id, toxic)`; labels that are null are left out.

    Labels of one doc_id count as toxic if one is; of several texts under one doc_id the least is learnt from. Null
    doc_ids are not. Without toxic rows to learn from every score is 0, without others 1. Ratios are
    counted on the cluster; the driver holds the significant features of `rows` texts.
    """
    zero = np.zeros(1 << HASH_BITS, np.float32)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = usable.join(docs.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")
    sample = F.broadcast(cut(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)))

    def extract(batches):
        for batch in portions(batches):
            found = [np.unique(ngrams(t.as_py())).astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "f"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    train = cut(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(tidy(extract), "id long, y int, f array<int>"))
    classes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        return Model(zero, np.inf if n1 else -np.inf)
    spread = train.select("id", "y", F.explode("f").alias("f"))
    counted = spread.groupBy("f").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c")).withColumn("c0", F.col("c") - F.col("c1"))
    ratio = F.log((F.col("c1") + SMOOTH) / (n1 + 2 * SMOOTH)) - F.log((F.col("c0") + SMOOTH) / (n0 + 2 * SMOOTH))
    error = F.sqrt(1 / (F.col("c1") + SMOOTH) - 1 / (n1 + 2 * SMOOTH) + 1 / (F.col("c0") + SMOOTH) - 1 / (n0 + 2 * SMOOTH))
    top = counted.select("f", ratio.alias("r"), error.alias("e")).where(F.abs("r") >= SIGNIFICANT * F.col("e")).orderBy("f").collect()
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not top:
        return Model(zero, prior)
    index = {r["f"]: i for i, r in enumerate(top)}
    chosen = cut(train.sparkSession.createDataFrame([(f, i) for f, i in index.items()], "f int, i int"))
    kept = spread.join(F.broadcast(chosen), "f").groupBy("id").agg(F.sort_array(F.collect_list("i")).alias("i"))
    rows_ = train.select("id", "y").join(kept, "id", "left").orderBy("id").collect()  # `rows` rows
    y = np.array([r["y"] for r in rows_], float)
    at = np.repeat(np.arange(len(rows_)), [len(r["i"] or ()) for r in rows_])
    cols = np.array([i for r in rows_ for i in r["i"] or ()], np.int64)
    r = np.array([t["r"] for t in top])
    w, bias = _logistic(y, at, cols, r)
    zero[[t["f"] for t in top]] = (w * r).astype(np.float32)
    return Model(zero, bias)


def _logistic(y: np.ndarray, at: np.ndarray, cols: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias, by accelerated gradient descent."""
    n, values = len(y), r[cols]
    norm = np.sqrt(np.bincount(at, values**2, n).mean()) or 1.0
    w, b = np.zeros(len(r)), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    step, vw, vb = 4.0 / (norm**2 + 1), w.copy(), b
    loss_before = np.inf
    for k in range(STEPS):
        z = np.bincount(at, values * vw[cols], n) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = float(np.logaddexp(0, z).mean() - (y * z).mean() + PENALTY / 2 * (vw**2).sum())
        if loss > loss_before + 1e-9:
            step, vw, vb = step / 2, w.copy(), b  # too far: again from the last point, without momentum
            loss_before = np.inf
            continue
        loss_before = loss
        gw = np.bincount(cols, values * (p - y)[at], len(r)) / n + PENALTY * vw
        nw, nb = vw - step * gw, vb - step * float((p - y).mean())
        momentum = k / (k + 3)
        vw, vb = nw + momentum * (nw - w), nb + momentum * (nb - b)
        w, b = nw, nb
    return w, b


def score_documents(docs: DataFrame, model: Model, score: str = "toxicity") -> DataFrame:
    """docs with a column `score` (0 to 1, replacing one of that name) of every whole text.

    Null and empty texts and texts without a known feature get the bias alone. Null doc_ids and repeated rows are rows
    like any other; other columns pass through; an empty table gives an empty result. Long texts are scored whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS weights
    docs = docs.drop(score).withColumn("text", docs["text"].cast("string"))
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    where = docs.columns.index("text")

    def run(batches):
        for batch in portions(batches):
            scores = [sent.value.score(t.as_py()) for t in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(tidy(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold (pipeline stage).

    Texts without words score the bias, which is low where most labels are 0, and stay. Columns pass through, whatever
    their names. See `fit` for labels that are null, repeated or missing.
    """
    name = unused(docs, "toxicity")
    return score_documents(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)


def op10_nb_ngrams(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")), "score")
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
