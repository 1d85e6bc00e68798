"""Operator 11, quality by histogram gradient-boosted trees over document statistics.

Each whole text is reduced to a row of statistics (lengths, shares of character classes, repetition of words, word
pairs and lines, order of words). Trees are grown level by level on histograms of binned statistics, by the gradients
of the logistic loss, on a bounded sample of the labelled rows. The fitted trees are flat arrays of features,
thresholds, children and values, through which all rows of a batch walk side by side.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, portions, table, tidy

#: Bound of the training sample: at most so many labelled rows, those of the least hash of doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Least sum of second derivatives in a leaf, L2 penalty of leaf values, least gain of a split.
LEAST, PENALTY, GAIN = 4.0, 1.0, 1e-3
THRESHOLD = 0.5
#: Characters of a text that are looked at together.
PART = 1 << 20

CLASSES = ("lower", "upper", "letter", "digit", "space", "end", "punctuation", "symbol", "other")
NAMES = (
    "log_chars", "log_words", "log_lines", *(f"share_{c}" for c in CLASSES), "entropy", "word_mean", "word_sd", "word_longest", "line_mean", "distinct_words", "top_word", "top_pair", "same_next", "letterless",
    "capital_words", "upper_words", "marked_words", "bare_marks", "short_words", "long_words", "repeated_lines", "unended_lines", "bullets",
)
_ENDS, _BULLETS = frozenset(".!?。…"), frozenset("-*•|#")
_LOWER, _UPPER = 0, 1
BREAK = regex.compile(r"\s")


def _class(char: str) -> int:
    kind = unicodedata.category(char)
    if kind in ("Ll", "Lu"):
        return _LOWER if kind == "Ll" else _UPPER
    if char.isspace():
        return 4
    if char in _ENDS:
        return 5
    return {"L": 2, "M": 2, "N": 3, "P": 6, "S": 7}.get(kind[0], 8)


#: Class of each character of the first planes.
TABLE = np.fromiter((_class(chr(c)) for c in range(0x20000)), np.uint8, 0x20000)


def _parts(text: str):
    """Pieces of about PART characters, which end at white space where there is any near."""
    at = 0
    while at < len(text):
        to = at + PART
        if to < len(text):
            found = BREAK.search(text, to, to + PART)
            to = found.start() if found else to
        yield text[at:to]
        at = to


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, named by NAMES; of null and empty texts all are zero.

    Words are counted by hash, eight bytes each, and long texts are taken part by part.
    """
    out = np.zeros(len(NAMES))
    if not text:
        return out
    classes, codes_seen = np.zeros(len(CLASSES), np.int64), np.zeros(256, np.int64)
    hashes, longest, length, square = [np.empty(0, np.int64)], 0, 0, 0.0
    shape = np.zeros(7, np.int64)  # letterless, capital, upper, marked, bare marks, short, long
    for part in _parts(text):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes += np.bincount(TABLE[np.minimum(codes, len(TABLE) - 1)], minlength=len(CLASSES))
        codes_seen += np.bincount(codes & 255, minlength=256)
        some = part.split()
        if not some:
            continue
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        length, square, longest = length + int(sizes.sum()), square + float((sizes.astype(float) ** 2).sum()), max(longest, int(sizes.max()))
        hashes.append(np.fromiter(map(hash, some), np.int64, len(some)))
        odd = [w for w in some if not w.isalpha()]
        lettered = [any(map(str.isalpha, w)) for w in odd]
        shape += (
            lettered.count(False), sum(map(str.istitle, some)), sum(len(w) > 1 and w.isupper() for w in some), sum(a and not w[:-1].isalnum() for w, a in zip(odd, lettered, strict=True)),
            sum(len(w) == 1 for w in odd), int((sizes <= 2).sum()), int((sizes >= 12).sum()),
        )
    words = np.concatenate(hashes)
    with np.errstate(over="ignore"):
        pairs = words[:-1] * np.int64(0x9E3779B97F4A7C1) + words[1:]
    uses, paired = (np.unique(x, return_counts=True)[1] for x in (words, pairs))
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    n, k = max(len(words), 1), max(len(lines), 1)
    seen = codes_seen[codes_seen > 0] / len(text)
    mean = length / n
    out[:] = (
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), *(classes / len(text)), float(-(seen * np.log2(seen)).sum()), mean, math.sqrt(max(square / n - mean * mean, 0.0)), math.log1p(longest), math.log1p(len(words) / k),
        len(uses) / n, uses.max(initial=0) / n, paired.max(initial=0) / n, int((words[1:] == words[:-1]).sum()) / n, *(shape / n),
        1 - len(set(lines)) / k if lines else 0.0, sum(line[-1] not in _ENDS for line in lines) / k, sum(line[0] in _BULLETS for line in lines) / k,
    )
    return out


@dataclass
class Trees:
    """Boosted trees in flat arrays; node i goes to right[i] if its feature exceeds its threshold, a leaf to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the leaf values that each row reaches, plus the base."""
        out = np.full(len(rows), self.base)
        if not len(self.roots):
            return out
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        own = np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            over = rows[own, self.feature[at]] > self.threshold[at]
            at = np.where(over, self.right[at], self.left[at])
        return out + self.value[at].sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -500, 500)))


def grow(rows: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees for labels y (0, 1) of rows of statistics, level by level on histograms of at most BINS bins a feature.

    Ties between splits go to the first feature and the lowest bin. With one class of labels, or none, there are no
    trees, and the base is the log odds of the labels, each counted once more.
    """
    n, width = rows.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
            flat[k].append(v)
        i = len(flat["feature"]) - 1
        flat["left"][i] = flat["right"][i] = i
        return i

    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], rows[:, f], "left") for f in range(width)], axis=1)
        slots = binned + np.arange(width) * BINS
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, second = p - y, p * (1 - p)
            where, ids = np.zeros(n, np.int64), [node()]
            roots.append(ids[0])
            for level in range(DEPTH + 1):
                g, h = np.bincount(where, gradient, len(ids)), np.bincount(where, second, len(ids))
                for k, i in enumerate(ids):
                    flat["value"][i] = float(-RATE * g[k] / (h[k] + PENALTY))
                if level == DEPTH:
                    break
                cell = (where[:, None] * (width * BINS) + slots).ravel()
                shape = (len(ids), width, BINS)
                size = int(np.prod(shape))
                gs = np.bincount(cell, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
                hs = np.bincount(cell, np.repeat(second, width), size).reshape(shape).cumsum(axis=2)
                gr, hr = g[:, None, None] - gs, h[:, None, None] - hs
                gain = gs**2 / (hs + PENALTY) + gr**2 / (hr + PENALTY) - (g**2 / (h + PENALTY))[:, None, None]
                gain[(hs < LEAST) | (hr < LEAST)] = -np.inf
                best = gain.reshape(len(ids), -1).argmax(axis=1)
                top = gain.reshape(len(ids), -1).max(axis=1)
                f, b = best // BINS, best % BINS
                children, after = [], np.zeros((len(ids), 2), np.int64)
                for k, i in enumerate(ids):
                    splits = bool(top[k] > GAIN and b[k] < len(edges[f[k]]))
                    if splits:
                        flat["feature"][i], flat["threshold"][i] = int(f[k]), float(edges[f[k]][b[k]])
                        flat["left"][i], flat["right"][i] = node(), node()
                        after[k] = len(children), len(children) + 1
                        children += [flat["left"][i], flat["right"][i]]
                    else:  # stays a leaf, whose rows stay in it
                        after[k] = len(children)
                        children.append(i)
                over = binned[np.arange(n), f[where]] > b[where]
                where, ids = after[where, over.astype(np.int64)], children
            margin += np.array(flat["value"])[np.array(ids)][where]
    arrays = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in flat.items()}
    return Trees(base, np.array(roots, np.int64), **arrays)


def in_training(doc_id: Column) -> Column:
    """Whether a labelled row may be learnt from; the other third is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def _measured(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The columns `kept` of docs and the statistics of their texts, as an array."""
    docs = docs.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in portions(batches):
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.list_(pa.float64()))], [*kept, "x"])

    return docs.mapInArrow(tidy(run), ", ".join(f"{docs.schema[c].name} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """The trees of `docs` by `labels(doc_id, quality)`; labels that are null are left out.

    Labels of one doc_id count as good if all are; of several texts under one doc_id the least is learnt from. Null
    doc_ids are not. The driver holds the statistics of `rows` texts, never a text.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    present = usable.join(docs.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")
    sample = F.broadcast(cut(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    found = _measured(texts, ["doc_id", "quality"]).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(NAMES))
    return grow(x, np.array([r["quality"] for r in found], float))


def score_quality(docs: DataFrame, model: Trees, score: str = "quality_score") -> DataFrame:
    """docs with a column `score` (0 to 1, replacing one of that name) of every whole text.

    Null and empty texts have statistics of zero, and a score like any other. Null doc_ids and repeated rows are rows
    like any other; other columns pass through; an empty table gives an empty result. Long texts are scored whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most TREES * 2 ** (DEPTH + 1) nodes
    docs = docs.drop(score).withColumn("text", docs["text"].cast("string"))
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    where = docs.columns.index("text")

    def run(batches):
        for batch in portions(batches):
            rows = np.array([statistics(t.as_py()) for t in batch.column(where)]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(rows), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(tidy(run), schema)


def op11_histogram_trees(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")), "score")
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
