"""Quality rules: text statistics, fixed base limits, and robust multivariate outliers per language and source."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, chunks, drop_stash, mix, stash

# The base limits.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Transformed statistics and, for each, the spread that is always tolerated (ridge of the covariance).
VECTOR = {"v_length": 0.06, "v_symbols": 0.05, "v_marks": 0.06, "v_upper": 0.06, "v_repeats": 0.12, "v_lines": 0.16}
D = len(VECTOR)
#: Share of a group that the determinant is minimised over; most concentration steps; change of the determinants' logarithms at which they end.
H_SHARE, STEPS, SETTLED = 0.6, 8, 1e-3
#: Rows that the estimate above weighs as: a group's over its language's, and that over all rows'.
PRIOR_ROWS = 30.0
#: Moments are summed as integers of this fraction, so their sums don't depend on the order of rows.
UNIT = float(1 << 24)
#: Medians and cutoff of chi-square with D degrees of freedom; the cutoff's tail probability is 1e-9.
CHI2_MEDIAN, CUTOFF = 5.348, 54.0
#: Distances are counted in bins of this width in the logarithm; values of statistics in steps of 1/GRID.
BIN, GRID = 0.125, 64

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{v} double" for v in VECTOR)
NAMES = [c.split()[0] for c in STATS.split(", ")]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts and the transformed vector of each text."""
    words = Words(texts, lower=False)
    n, k = len(texts), len(words.h)
    per_text = lambda x: np.bincount(words.doc, weights=x, minlength=n)
    within = lambda flags: (lambda sums: sums[words.end] - sums[words.start])(np.concatenate(([0], np.cumsum(flags))))
    n_words = words.count
    word_chars = per_text(within((words.buf & 0xC0) != 0x80))
    upper = words.raw
    # two-byte capitals U+00C0..U+00DE: lead byte C3, then 80..9E
    capital = np.concatenate(((upper[:-1] == 0xC3) & (upper[1:] >= 0x80) & (upper[1:] <= 0x9E), [False])) if len(upper) else np.zeros(0, bool)
    n_symbols, n_marks = per_text(within(_SYMBOL[words.buf])), per_text(within(_MARK[words.buf]))
    n_upper = per_text(within(_UPPER[words.buf] | capital))

    repeated = np.zeros(n)
    if k >= 3:
        at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        t = mix(mix(words.h[at]) + words.h[at + 1]) ^ mix(words.h[at + 2] + U64(77))
        order = np.lexsort((t, words.doc[at]))
        s, d = t[order], words.doc[at][order]
        same = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(k, bool)
        for shift in range(3):
            covered[at[twice] + shift] = True
        repeated = per_text(covered)

    lines = np.zeros((2, n))
    for i, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.strip()]
        lines[:, i] = len(own), len(own) - len(set(own))

    root = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": lines[1],
        "n_repeat_words": repeated,
        "v_length": np.log((word_chars + 5) / (n_words + 1)),
        "v_symbols": root(n_symbols, word_chars),
        "v_marks": root(n_marks, word_chars),
        "v_upper": root(n_upper, word_chars),
        "v_repeats": root(repeated, n_words),
        "v_lines": root(lines[1], lines[0]),
    }


def _measure(batches):
    for part in chunks(batches):
        stats = text_statistics(as_bytes(part.column(1)))
        columns = [part.column(0), part.column(2), part.column(3)]
        columns += [pa.array(np.asarray(stats[c]).astype(float if c in VECTOR else np.int64)) for c in NAMES[3:]]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)


MODEL = "key string, start int, n long, mean array<double>, cov array<double>, inverse array<double>, scale double, logdet double"
_RIDGE = np.diag(np.square(list(VECTOR.values())))


def _model(key, start, n, mean, cov, scale=1.0) -> dict:
    held = cov + _RIDGE
    return {
        "key": key,
        "start": int(start),
        "n": int(n),
        "mean": [float(x) for x in mean],
        "cov": [float(x) for x in cov.ravel()],
        "inverse": [float(x) for x in np.linalg.inv(held).ravel()],
        "scale": float(scale),
        "logdet": float(np.linalg.slogdet(held)[1]),
    }


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's coordinatewise medians and interquartile spreads from the counts of its values."""
    mean, spread = np.zeros(D), np.zeros(D)
    for dim, own in pdf.groupby("dim"):
        own = own.sort_values("value")
        upto, total = own["n"].cumsum().to_numpy(), own["n"].sum()
        q1, q2, q3 = (own["value"].to_numpy()[np.searchsorted(upto, q * total)] / GRID for q in (0.25, 0.5, 0.75))
        mean[dim], spread[dim] = q2, (q3 - q1) / 1.349
    return pd.DataFrame([_model(pdf["key"].iloc[0], 0, pdf["n"].sum() // D, mean, np.diag(spread**2))])


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _moments(pdf: pd.DataFrame, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the rows of the bins, of each bin the given part."""
    count = (part * pdf["n"].to_numpy(float)).sum()
    mean = np.array([(part * pdf[f"s{i}"]).sum() for i in range(D)]) / UNIT / count
    cov = np.zeros((D, D))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = (part * pdf[f"p{i}_{j}"]).sum() / UNIT / count - mean[i] * mean[j]
    return mean, cov


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """The second start: mean and covariance of all rows."""
    mean, cov = _moments(pdf, np.ones(len(pdf)))
    return pd.DataFrame([_model(pdf["key"].iloc[0], 1, pdf["n"].sum(), mean, cov)])


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean and covariance of the H_SHARE rows nearest by distance, from moments summed by distance bin.

    Of the bin in which the share is reached, the part that is needed counts. ``scale`` brings the
    median distance to that of chi-square.
    """
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(float)
    upto, total = np.cumsum(n), n.sum()
    mean, cov = _moments(pdf, np.clip((H_SHARE * total - (upto - n)) / n, 0, 1))
    k = int(np.searchsorted(upto, total / 2))
    inside = (total / 2 - (upto[k] - n[k])) / n[k]
    median = np.exp((pdf["bin"].to_numpy()[k] + inside) * BIN)
    return pd.DataFrame([_model(pdf["key"].iloc[0], pdf["start"].iloc[0], total, mean, cov, max(1.0, median / CHI2_MEDIAN))])


def shrunk(own: tuple, above: tuple) -> tuple:
    """(n, mean, cov, scale) of an estimate, leaning on the one above by PRIOR_ROWS rows' weight."""
    w = own[0] / (own[0] + PRIOR_ROWS)
    return (own[0], *(w * x + (1 - w) * y for x, y in zip(own[1:], above[1:], strict=True)))


def _judges(pdf_iter):
    """Per group: its own estimate, shrunk toward its language's, that toward the one over all rows."""
    for pdf in pdf_iter:
        rows = []
        for _, r in pdf.iterrows():
            part = lambda k: (float(r[f"n_{k}"]), np.array(r[f"mean_{k}"]), np.array(r[f"cov_{k}"]).reshape(D, D), float(r[f"scale_{k}"]))  # noqa: B023, E731
            n, mean, cov, scale = shrunk(part(2), shrunk(part(1), part(0)))
            rows.append(_model(r["group"], 0, n, mean, cov, scale))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MODEL.split(", ")])


def _distance():
    off = [F.col(v) - F.get("mean", F.lit(i)) for i, v in enumerate(VECTOR)]
    terms = [off[i] * off[j] * F.get("inverse", F.lit(i * D + j)) * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base limits, then minimum-covariance-determinant outliers in each (language, source).

    A text fails the base limits with under 50 words, or with more than half of its words in
    3-word windows that it holds twice or more. Every text gives a vector of D transformed
    statistics. Each (language, source), each language and the whole table have an estimate with two
    starts: medians and interquartile spreads, and mean and covariance of all rows. Both take
    concentration steps (distances under the last estimate, then mean and covariance of the H_SHARE
    nearest rows) until no determinant changes by more than SETTLED, STEPS at most; the start with
    the smaller determinant holds. Each step is one grouped sum over all rows by distance bin, so a
    group may hold any share of the rows, and nothing but small models is gathered. Rows are judged by
    their group's estimate, which leans on its language's as if that were PRIOR_ROWS more rows, and
    that in the same way on the one over all rows; so every row has a distance, and there is no size
    at which the rule changes. Rows whose squared Mahalanobis distance, scaled to chi-square by its
    median, is over CUTOFF are rejected.

    Null texts count as empty (base_failed); null languages or sources are groups of their own.
    Repeated rows count each. An empty table gives an empty result; columns beyond the four named
    are ignored. Sums are of integers, so reruns agree.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    stats = stash(picked.mapInArrow(_measure, STATS), "quality-stats")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    keys = [F.lit("0"), F.concat(F.lit("1"), named("lang")), F.concat(F.lit("2"), named("lang"), F.lit("\x1f"), named("source"))]
    stats = stats.withColumn("group", F.concat_ws("\x1f", named("lang"), named("source"))).withColumn("keys", F.array(*keys))

    value = F.posexplode(F.array(*[F.floor(F.col(v) * GRID + 0.5).cast("int") for v in VECTOR]))
    values = stats.select("keys", value.alias("dim", "value")).groupBy("keys", "dim", "value").agg(F.count(F.lit(1)).alias("n"))
    values = values.select(F.explode("keys").alias("key"), "dim", "value", "n").groupBy("key", "dim", "value").agg(F.sum("n").alias("n"))
    fixed = lambda c: F.sum(F.round(c * UNIT).cast("long"))
    moments = [F.count(F.lit(1)).alias("n")] + [fixed(F.col(v)).alias(f"s{i}") for i, v in enumerate(VECTOR)]
    vs = list(VECTOR)
    moments += [fixed(F.col(vs[i]) * F.col(vs[j])).alias(f"p{i}_{j}") for i, j in _PAIRS]
    rows = stats.select(*vs, F.explode("keys").alias("key"))
    model = values.groupBy("key").applyInPandas(_start, MODEL).union(rows.groupBy("key").agg(*moments).groupBy("key").applyInPandas(_whole, MODEL))
    model = stash(model, "quality-model")
    for _ in range(STEPS):
        far = rows.join(model, "key").withColumn("bin", F.floor(F.log(F.greatest(_distance(), F.lit(1e-4))) / BIN).cast("int"))
        last, model = model, stash(far.groupBy("key", "start", "bin").agg(*moments).groupBy("key", "start").applyInPandas(_concentrate, MODEL), "quality-model")
        moved = model.select("key", "start", "logdet").join(last.select("key", "start", F.col("logdet").alias("before")), ["key", "start"])
        moved = moved.agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        drop_stash(last)
        if moved is None or moved <= SETTLED:
            break
    best = model.groupBy("key").agg(F.min_by(F.struct("n", "mean", "cov", "scale"), F.struct("logdet", "start")).alias("m"))
    groups = stats.select("group", "keys").distinct()
    for level in range(3):
        own = best.select(F.col("key").alias(f"key_{level}"), *[F.col(f"m.{c}").alias(f"{c}_{level}") for c in ("n", "mean", "cov", "scale")])
        groups = groups.join(own, F.get("keys", F.lit(level)) == F.col(f"key_{level}"))
    judges = stash(groups.drop("keys", "key_0", "key_1", "key_2").mapInPandas(_judges, MODEL), "quality-judges")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUTOFF)
    judged = stats.join(judges.select("key", "mean", "inverse", "scale"), F.col("group") == F.col("key")).withColumns({"base_failed": base_failed, "distance": _distance() / F.col("scale")})
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality verdicts on all documents."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
