"""Quality classifier: naive-Bayes-scaled n-gram indicators with a linear hinge-loss model, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, chunks, mix

#: log2 of the hashed features; defaults of the bounds of the sample: labelled rows (about), and their features in all.
BITS, SAMPLE, SAMPLE_FEATURES = 18, 6000, 24_000_000
#: Smoothing of class counts; hinge penalty; passes of coordinate descent.
ALPHA, PENALTY, PASSES = 1.0, 1.0, 12
#: A row is predicted good from this score.
THRESHOLD = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature): the distinct byte 3-grams and 4-grams of each text, and how often a word follows itself."""
    words = Words(texts, lower=False)
    b = words.raw.astype(np.uint32)
    n = len(texts)
    begins = np.concatenate(([0], words.ends[:-1])) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), words.ends - begins)
    found = []
    for width in (3, 4):
        if len(b) >= width:
            gram = b[: len(b) - width + 1].copy()
            for k in range(1, width):
                gram = (gram << np.uint32(8)) | b[k : len(b) - width + 1 + k]
            own = owner[: len(gram)]
            inside = owner[width - 1 :] == own
            h = (gram.astype(U64) + U64(width << 40)) * U64(0x9E3779B97F4A7C15) >> U64(64 - BITS)
            found.append((own[inside] << BITS) | h[inside].astype(np.int64))
    # word n-grams that are one word n times over are one feature for each n, whatever the word
    twice = np.append((words.h[1:] == words.h[:-1]) & (words.doc[1:] == words.doc[:-1]), False) if len(words.h) else np.zeros(0, bool)
    run = twice
    for width in range(2, 9):
        found += [words.doc[run] << BITS | int(x >> U64(64 - BITS)) for x in mix(np.arange(4, dtype=U64) + U64(width << 8))]
        run = run & np.append(run[1:], False) if len(run) else run
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights, squared ratios, bias, slope, offset) from each row's features; the score is sigmoid(slope * margin + offset).

    Indicators are scaled by the log-count ratio of the classes and rows to length 1; the dual of
    the hinge loss is climbed one row at a time, in a fixed order. Every fifth row is kept from
    the fit and sets the sigmoid.
    """
    size = 1 << BITS
    count = np.fromiter(map(len, rows), np.int64, len(rows))
    bounds = np.concatenate(([0], np.cumsum(count)))
    feature = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
    y = np.where(labels > 0, 1.0, -1.0)
    aside = np.arange(len(rows)) % 5 == 4
    tally = lambda which: np.bincount(np.concatenate([np.zeros(0, np.int32), *(rows[i] for i in np.flatnonzero(which & ~aside))]), minlength=size) + ALPHA
    good, bad = tally(y > 0), tally(y < 0)
    n_good, n_bad = (y[~aside] > 0).sum() + 2 * ALPHA, (y[~aside] < 0).sum() + 2 * ALPHA
    ratio = np.log(good / n_good) - np.log(bad / n_bad)
    xs = lambda i: (feature[bounds[i] : bounds[i + 1]], ratio[feature[bounds[i] : bounds[i + 1]]] / norm[i])
    norm = np.array([np.sqrt(max(float(np.square(ratio[r]).sum()), 1e-12)) for r in rows])
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    learnt = np.flatnonzero(~aside)
    # the rarer class weighs as much as the other
    limit = np.where(y > 0, PENALTY * len(learnt) / max(1, 2 * (y[learnt] > 0).sum()), PENALTY * len(learnt) / max(1, 2 * (y[learnt] < 0).sum()))
    order = np.random.default_rng(1)
    for _ in range(PASSES):
        for i in order.permutation(learnt):
            f, x = xs(i)
            new = min(max(alpha[i] - (y[i] * (x @ w[f] + bias) - 1.0) / 2.0, 0.0), limit[i])  # a row's length is 1, with its bias 2
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * x
                bias += step
    margin = np.array([x @ w[f] + bias for f, x in map(xs, range(len(rows)))]) if len(rows) else np.zeros(0)
    slope, offset = _sigmoid(margin[aside], y[aside] > 0) if aside.any() else (1.0, 0.0)
    return w * ratio, ratio**2, bias, slope, offset


def _sigmoid(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels (Newton steps, smoothed targets)."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, x @ (p - target) + 1e-3 * theta), -1, 1)
    return max(float(theta[0]), 1e-3), float(theta[1])


def _fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("h")
    w, r2, bias, slope, offset = fit([np.frombuffer(x, "<i4") for x in pdf["features"]], pdf["label"].to_numpy())
    return pd.DataFrame([{"w": w.astype("<f4").tobytes(), "r2": r2.astype("<f4").tobytes(), "bias": bias, "slope": slope, "offset": offset}])


def _featured(batches):
    """Features of labelled texts, where they are read: no task gathers texts."""
    for part in chunks(batches, column=2):
        doc, feature = features(as_bytes(part.column(2)))
        bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
        own = [feature[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], names=["h", "label", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = SAMPLE, sample_features: int = SAMPLE_FEATURES):
    """Fit on about ``sample`` labelled rows, those whose ids hash under a threshold, and of them, by hash, as many as have ``sample_features`` features in all.

    What comes back has a fixed size. None if no labelled row has a text.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.min(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64("of"))
    n = ids.count()
    if n > sample:
        ids = ids.where(F.pmod("h", F.lit(1 << 32)) < F.lit(int(sample / n * (1 << 32))))
    # about ``sample`` rows are broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("of"))
    rows = rows.select("h", "label", "text").mapInArrow(_featured, "h long, label int, features binary")
    rows = rows.groupBy("h", "label").agg(F.min("features").alias("features"))
    upto = F.sum(F.octet_length("features") / 4).over(Window.orderBy("h"))  # over the sample's rows alone
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= sample_features).select("h", "label", "features", F.lit(0).alias("one"))
    got = rows.groupBy("one").applyInPandas(_fit_one, "w binary, r2 binary, bias double, slope double, offset double").collect()
    if not got:
        return None
    return np.frombuffer(got[0].w, "<f4"), np.frombuffer(got[0].r2, "<f4"), got[0].bias, got[0].slope, got[0].offset


def score_texts(texts: list[bytes], model) -> np.ndarray:
    w, r2, bias, slope, offset = model
    doc, feature = features(texts)
    total = np.bincount(doc, weights=w[feature], minlength=len(texts))
    norm = np.sqrt(np.maximum(np.bincount(doc, weights=r2[feature], minlength=len(texts)), 1e-12))
    return 1 / (1 + np.exp(-np.clip(slope * (total / norm + bias) + offset, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = SAMPLE, sample_features: int = SAMPLE_FEATURES) -> DataFrame:
    """Score every text by a classifier fitted on a bounded, documented sample of the labelled rows.

    Null texts count as empty; an empty text has the score of the model's bias. Without a labelled
    row every score is 0.5. Labels repeated for an id count once, by the least. Texts are scored
    whole, one slice of rows at a time; columns beyond those named are ignored.

    Returns doc_id and score.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample, sample_features)

    def run(batches):
        for part in chunks(batches):
            score = score_texts(as_bytes(part.column(1)), model) if model else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from quality labels of rows not held out."""
    held = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held("doc_id")).select("doc_id", F.col("quality").alias("label"))
    scored = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
