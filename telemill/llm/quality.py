"""Quality classifier by positive-unlabelled learning.

A linear model over surface features of the whole text is fitted by minimising the non-negative unbiased risk

    prior * mean_P l(f) + max(0, mean_U l(-f) - prior * mean_P l(-f))        (l: logistic loss)

from trusted positives P and unlabelled texts U, of which nothing is known but their features.  The class prior
is estimated first: a P-against-U model orders the texts, and the prior is the smallest ratio of the share of U
to the share of P above a threshold, with a margin for small counts.

The fit uses a bounded sample (about MAX_POSITIVES and MAX_UNLABELLED rows, those whose key hash falls below their
share, and never more than twice as many); scores cover every row.  Defined cases: a null text counts as empty; an empty text has all features 0 and a
score; without positives or without unlabelled rows every score is 0.5; null labels are no positives.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.common import text_of

MAX_POSITIVES, MAX_UNLABELLED = 20_000, 40_000
THRESHOLD = 0.3
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "*%$#&@^~`", "|<>{}[]\\/=_+", "!?", ".,;:", "\"'()-")
_LUT = np.zeros(256, np.uint8)
for _k, _chars in enumerate(CLASSES, 1):
    _LUT[np.frombuffer(_chars.encode(), np.uint8)] = _k
_LUT[128:] = len(CLASSES) + 1
N_FEATURES = len(CLASSES) + 1 + 6
_SPACE = re.compile(r"\s+")


def features(text: str) -> list[float]:
    """Shares of character classes, and how much words, lines and bytes repeat."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    counts = np.bincount(_LUT[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 2)[1:]
    out = np.log1p(50.0 * counts / n).tolist()
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    again = sum(map(str.__eq__, words[1:], words))
    out += [
        math.log(n / m),
        math.log1p(len(set(words))) / math.log1p(m),
        math.log1p(20 * again / m),
        len(set(lines)) / len(lines),
        min(1.0, max(0, len(zlib.compress(raw, 1)) - 12) / n),
        math.log(n),
    ]
    return out


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"_id": batch["_id"], "_x": [features(t) for t in batch["_text"]]})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in U, from the scores of held-back P and of U under a P-against-U model."""
    cuts = np.unique(np.quantile(p, np.linspace(0.0, 0.9, 91)))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    q_p, q_u = above(p), above(u)
    margin = math.sqrt(math.log(20) / (2 * len(u))) + math.sqrt(math.log(20) / (2 * len(p)))
    best = np.argmin((q_u + margin) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray, ridge: float = 1e-3) -> dict:
    """Standardisation, weights and the estimated prior."""
    centre, scale = u.mean(0), u.std(0) + 1e-6
    ready = lambda x: np.hstack([np.clip((x - centre) / scale, -5, 5), np.ones((len(x), 1))])
    p, u = ready(p), ready(u)
    half = p[::2], p[1::2] if len(p) > 1 else p

    def against(w):
        a, b = _sigmoid(half[0] @ w) - 1, _sigmoid(u @ w)
        return (a @ half[0]) / len(a) + (b @ u) / len(b) + ridge * w

    w0 = _descend(against, p.shape[1], 200)
    prior = class_prior(half[1] @ w0, u @ w0)

    def risk(w):
        fp, fu = p @ w, u @ w
        plus = ((_sigmoid(fp) - 1) @ p) / len(fp)
        minus = (_sigmoid(fu) @ u) / len(fu) - prior * (_sigmoid(fp) @ p) / len(fp)
        inner = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return (prior * plus + minus if inner >= 0 else -minus) + ridge * w

    return {"centre": centre, "scale": scale, "weights": _descend(risk, p.shape[1]), "prior": prior}


def score_of(model: dict, x: Column) -> Column:
    """The model as a column expression."""
    terms = F.lit(float(model["weights"][-1]))
    for k, (c, s, w) in enumerate(zip(model["centre"], model["scale"], model["weights"], strict=False)):
        z = (x[k] - float(c)) / float(s)
        terms = terms + F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)) * float(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _sample(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """Features of about ``most`` rows, those whose key hash falls below their share; never more than twice as many."""
    share = min(1.0, most / max(1, total))
    hashed = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30))
    some = rows.where(hashed) if share < 1 else rows
    found = some.mapInPandas(_measure, f"_id {rows.schema['_id'].dataType.simpleString()}, _x array<double>")
    return np.array(sorted(r[0] for r in found.select("_x").limit(2 * most).collect()))


def model_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> dict | None:
    """The fitted model; None without positives or without unlabelled rows."""
    train = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).where(~held_out(F.col("_id")))
    trusted = labels.where("quality = 1").select(F.col(id_col).alias("_lid")).where(~held_out(F.col("_lid"))).distinct()
    positives = trusted.count()
    share = min(1.0, max_positives / max(1, positives))
    few = trusted.where(F.pmod(F.xxhash64(F.col("_lid").cast("string"), F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * max_positives)
    p = _sample(train.join(F.broadcast(few), F.col("_id") == F.col("_lid"), "left_semi"), 0, max_positives)
    u = _sample(train, train.count(), max_unlabelled)
    return fit(p, u) if len(p) and len(u) else None


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = model_of(docs, labels, id_col, text_col, max_positives, max_unlabelled)
    measured = docs.select(F.col(id_col).alias("_id"), _features(text_of(text_col)).alias("_x"))
    score = score_of(model, F.col("_x")) if model else F.lit(0.5)
    out = measured.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with their columns; no row leaves its task."""
    model = model_of(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _features(text_of(text_col)).alias("_x"))
    score = score_of(model, F.col("_x")) if model else F.lit(0.5)
    return rows.where(score >= THRESHOLD).select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns])
