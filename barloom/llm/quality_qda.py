"""Document quality by regularised quadratic discriminant analysis.

Each class is a normal distribution over transformed document statistics. The
covariances are shrunk towards the pooled one and towards a multiple of the
identity, so they stay invertible with few labelled rows. The score is the
posterior of class 1 from the Mahalanobis distances and log determinants, both
from Cholesky factors that are computed once and sent with the task.

Statistics and scoring see whole texts; a null text is empty and gets a score
like any other. Only the fit is on a bounded sample of labelled rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.functions.numeric import computed_once

#: Bound of the labelled sample that the fit sees.
MAX_LABELLED = 20_000
#: Shrinkage towards the pooled covariance, and towards the identity.
TOWARDS_POOLED = 0.3
TOWARDS_IDENTITY = 0.05
#: Characters whose share is a statistic, and a usual share.
COUNTED = {
    "symbols": (r"[#*$%&<>]+", 0.002),
    "digits": (r"\d+", 0.002),
    "capitals": (r"\p{Lu}+", 0.02),
    "marks": (r"[!?]+", 0.002),
    "bars": (r"[|]+", 0.002),
}
#: Every share is as if so much usual text were added, which keeps short texts from extremes.
SHORT = 20.0
FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "digits",
    "capitals",
    "marks",
    "bars",
    "distinct",
    "repeats",
    "line_repeats",
    "line_words",
)


def raw_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the whole row) and ``raw``, a struct of counts over the whole text."""
    split = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        "doc",
        "body",
        F.regexp_extract_all("body", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("words"),
        F.expr("filter(split(body, '\\n'), x -> length(x) > 0)").alias("lines"),
    )
    fields = {
        "words": F.size("words"),
        "kinds": F.size(F.array_distinct("words")),
        "chars": F.char_length("body"),
        "lines": F.size("lines"),
        "line_kinds": F.size(F.array_distinct("lines")),
        "runs": F.expr("size(filter(words, (w, i) -> i > 0 AND w = words[if(i > 0, i - 1, 0)]))"),
    }
    for name, (pattern, _) in COUNTED.items():
        fields[name] = F.char_length("body") - F.char_length(F.regexp_replace("body", pattern, ""))
    raw = F.struct(*(value.cast("double").alias(name) for name, value in fields.items()))
    # Through a one-row generator, so that a filter on the score is not pushed below the statistics.
    return computed_once(split, {"raw": raw}).select("doc", "raw")


def transformed(raw: pd.DataFrame) -> np.ndarray:
    """Feature matrix from the columns that ``raw_statistics`` makes.

    Shares become log odds, counts logarithms: both are nearer to normal than the raw numbers.
    """

    def share(part: pd.Series, whole: pd.Series, usual: float) -> np.ndarray:
        part, whole = part.to_numpy(float), np.maximum(whole.to_numpy(float), part.to_numpy(float))
        return np.log((part + SHORT * usual) / (whole - part + SHORT * (1 - usual)))

    def ratio(part: pd.Series, whole: pd.Series, usual: float) -> np.ndarray:
        return np.log((part.to_numpy(float) + SHORT * usual) / (whole.to_numpy(float) + SHORT))

    return np.column_stack(
        [
            np.log1p(raw["words"].to_numpy(float)),
            ratio(raw["chars"], raw["words"], 6.0),
            *(share(raw[name], raw["chars"], usual) for name, (_, usual) in COUNTED.items()),
            # How fast new words run out, less the usual slowing with length.
            ratio(raw["kinds"], raw["words"], 1.0) + 0.1 * np.log1p(raw["words"].to_numpy(float)),
            share(raw["runs"], raw["words"], 0.01),
            share(raw["lines"] - raw["line_kinds"], raw["lines"], 0.01),
            ratio(raw["words"], raw["lines"], 50.0),
        ]
    )


class Model(NamedTuple):
    """Per class (0, 1): mean, inverse Cholesky factor, log determinant, log prior. centre, scale: of all rows."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_priors: list[float]


def fit(matrix: np.ndarray, labels: np.ndarray, towards_pooled: float = TOWARDS_POOLED, towards_identity: float = TOWARDS_IDENTITY) -> Model:
    """Shrunken class covariances. A class without rows has the pooled moments, so it decides nothing."""
    size = matrix.shape[1] if matrix.ndim == 2 else len(FEATURES)
    if len(labels) == 0:
        matrix, labels = np.zeros((1, size)), np.zeros(1)
    centre, scale = matrix.mean(0), np.maximum(matrix.std(0), 1e-3)
    z = (matrix - centre) / scale
    groups = [z[labels == k] for k in (0, 1)]
    filled = [g if len(g) else z for g in groups]
    means = [g.mean(0) for g in filled]
    pooled = sum((g - m).T @ (g - m) for g, m in zip(filled, means)) / sum(map(len, filled))
    factors, log_dets = [], []
    for g, m in zip(filled, means):
        own = (g - m).T @ (g - m) / len(g)
        cov = (1 - towards_pooled) * own + towards_pooled * pooled
        cov = (1 - towards_identity) * cov + towards_identity * max(np.trace(cov) / size, 1e-3) * np.eye(size)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * float(np.log(np.diag(low)).sum()))
    priors = [(len(g) + 1) / (len(z) + 2) for g in groups]
    return Model(centre, scale, means, factors, log_dets, [float(np.log(p)) for p in priors])


def posterior(model: Model, matrix: np.ndarray) -> np.ndarray:
    """Probability of class 1."""
    z = (matrix - model.centre) / model.scale
    logs = []
    for k in (0, 1):
        d = (z - model.means[k]) @ model.factors[k].T
        logs.append(model.log_priors[k] - 0.5 * (model.log_dets[k] + (d * d).sum(1)))
    return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` rows of ``labels``, those with the smallest hash of their key.

    Null keys and labels other than 0 and 1 are not labels. Of documents that repeat
    a labelled key the smallest text counts, once. The sample does not
    depend on order or partitions; it is small by its bound, so it is sent to the
    texts, and only the statistics of its texts reach the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    sample = known.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_key"), "_key", "_label").limit(max_labelled)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    texts = texts.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    rows = raw_statistics(texts, "_text").select("raw.*", F.col("doc._label").alias("_label")).toPandas()
    return fit(transformed(rows), rows["_label"].to_numpy())


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc`` (the whole row) and ``score``, the posterior of class 1."""

    @pandas_udf("double")
    def score(raw: pd.DataFrame) -> pd.Series:
        return pd.Series(posterior(model, transformed(raw)))

    return raw_statistics(docs, text).select("doc", score("raw").alias("score"))
