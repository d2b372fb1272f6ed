"""Quality by hierarchical empirical Bayes: a document's evidence plus what its host and path show.

1. A logistic classifier over shape features of the whole text gives each document a log odds of
   being low quality. It is fitted on at most SAMPLE_ROWS labelled rows, those with the smallest hash
   of their id; weights are a few dozen numbers.
2. Over all documents, the mean of that probability is taken for every path and every host by grouped
   aggregation (pre-aggregated before the shuffle, so a host with a third of all rows costs one row a
   task). A host's posterior shrinks its mean toward the global prior, a path's toward its host's, as
   a beta prior of strength k would; k comes from the variance between groups by moments. A sparse
   site so keeps the prior, a large one speaks for itself.
3. A document's final log odds are its evidence plus the log odds of its path's posterior less those
   of the global prior. It is rejected at a probability of REJECT or more.

Posteriors (one row per path) are broadcast up to BROADCAST_ROWS paths and else joined by shuffle.

Cases: a null text is empty; a null host or path is a group of its own; a null id is kept; labels
that are null are not used, of several labels of a row the largest is; equal rows each are scored;
without labelled rows of both kinds the evidence is zero and nothing is rejected; no rows give no
rows; other columns pass through keep_good and are not read elsewhere, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from octavo.plans.tables import materialize, tidy
from octavo.llm.tokens import forget

SAMPLE_ROWS = 8000
BROADCAST_ROWS = 50_000
REJECT = 0.5
FEATURES = 14

_MARKS = b"#$%&*+/<=>@\\^_`{|}~"
_STOPS = b".,;:!?"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Shape of a text: repetition, length and kinds of words, marks, case, digits and lines."""
    text = text or ""
    words, raw = text.split(), text.encode("utf-8", "surrogatepass")
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    lengths = list(map(len, words))
    return [
        math.log1p(len(words)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(lengths) / n,
        sum(x <= 3 for x in lengths) / n,
        sum(x == 1 for x in lengths) / n,
        math.sqrt(share(_MARKS)),
        math.sqrt(share(_STOPS)),
        math.sqrt(share(b"!")),
        math.sqrt(share(_UPPER)),
        math.sqrt(share(_DIGITS)),
        len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features and their squares, so that both ends of a scale can count."""
    return np.column_stack([x, x * x])


class Classifier:
    """Logistic regression over standardised features and their squares."""

    def __init__(self):
        self.mean = np.zeros(FEATURES)
        self.scale = np.ones(FEATURES)
        self.beta = np.zeros(2 * FEATURES + 1)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> Classifier:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._design(x)
        keep = ridge * np.diag([1e-3] + [1.0] * (a.shape[1] - 1))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ self.beta, -30, 30)))
            step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + keep, a.T @ (y - p) - keep @ self.beta)
            self.beta = self.beta + step
            if np.abs(step).max() < 1e-7:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), _expand(z)])

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return np.clip(self._design(np.array([features(t) for t in texts])) @ self.beta, -20, 20)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    where: Column | None = None,
) -> Classifier:
    """Classifier from at most sample_rows labelled rows; label 0 is low quality. where: which ids may teach."""
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        "id IS NOT NULL AND y IS NOT NULL"
    )
    chosen = (
        (usable if where is None else usable.where(where))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
        .collect()
    )
    if len({r.y for r in chosen}) < 2:
        return Classifier()
    kind = docs.schema[id_col].dataType.simpleString()
    sample = F.broadcast(docs.sparkSession.createDataFrame([(r.id, 1 - r.y) for r in chosen], f"id {kind}, y int"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["y", "x"])
        tidy()

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = slim.join(sample, "id").select("y", "text").mapInArrow(measured, "y int, x array<double>").toArrow()
    if not rows.num_rows:
        return Classifier()
    return Classifier().fit(np.array(rows.column("x").to_pylist()), rows.column("y").to_numpy().astype(float))


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def evidence(docs: DataFrame, model: Classifier, text: str = "text", into: str = "log_odds") -> DataFrame:
    """docs, all columns, with the log odds of low quality."""
    at = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            odds = pa.array(model.log_odds(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, odds], names=[*batch.schema.names, into])
        tidy()

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _shrink(total: Column, n: Column, toward: Column, k: Column) -> Column:
    return (total + k * toward) / (n + k)


def _strength(groups: DataFrame, n: str, mean: str, prior: float) -> float:
    """Beta strength by moments: how much of the spread between groups is more than chance."""
    row = groups.agg(
        F.sum(F.col(n) * (F.col(mean) - prior) ** 2).alias("spread"),
        F.sum(n).alias("rows"),
        F.sum(F.col(n) * F.col(n)).alias("squares"),
        F.count("*").alias("groups"),
    ).first()
    if not row["groups"] or row["groups"] < 2 or not row["rows"] or not 0 < prior < 1:
        return 1000.0
    chance = prior * (1 - prior)
    between = (row["spread"] - (row["groups"] - 1) * chance) / (row["rows"] - row["squares"] / row["rows"])
    return float(min(1e6, max(1.0, chance / between - 1))) if between > 1e-12 else 1e6


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> tuple[DataFrame, float]:
    """(host, path, posterior) for each path and the global prior, from documents' log odds."""
    p = _probability(F.col("log_odds"))
    paths = materialize(
        scored.groupBy(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")).agg(
            F.sum(p).alias("bad"), F.count("*").alias("n")
        ),
        "quality-paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("n").alias("host_n"))
    total = paths.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    prior = min(1 - 1e-6, max(1e-6, total.bad / total.n)) if total.n else 0.5
    k_host = _strength(hosts.withColumn("mean", F.col("host_bad") / F.col("host_n")), "host_n", "mean", prior)
    k_path = _strength(paths.withColumn("mean", F.col("bad") / F.col("n")), "n", "mean", prior)
    hosts = hosts.withColumn(
        "host_posterior", _shrink(F.col("host_bad"), F.col("host_n"), F.lit(prior), F.lit(k_host))
    )
    out = (
        paths.alias("p")
        .join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
        .select(
            F.col("p.host").alias("host"),
            F.col("p.path").alias("path"),
            _shrink(F.col("bad"), F.col("n"), F.col("host_posterior"), F.lit(k_path)).alias("posterior"),
        )
    )
    return materialize(out, "quality-sites"), prior


def _with_sites(scored: DataFrame, sites: DataFrame, prior: float, keys: tuple[str, str], odds: str):
    """scored joined to its sites' posteriors, and the column of the final probability."""
    h, p, q = (_fresh(x, scored.columns) for x in ("site_host", "site_path", "site_posterior"))
    side = sites.toDF(h, p, q)
    if sites.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    same = [F.col(f"`{k}`").cast("string").eqNullSafe(F.col(x)) for k, x in zip(keys, (h, p), strict=True)]
    shift = F.log(F.col(q) / (1 - F.col(q))) - math.log(prior / (1 - prior))
    return scored.join(side, same[0] & same[1], "left"), _probability(
        F.col(f"`{odds}`") + F.coalesce(shift, F.lit(0.0))
    )


def score_quality(
    docs: DataFrame,
    model: Classifier,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, p_low and kept. host and path name columns of docs."""
    slim = docs.select(
        *[F.col(f"`{c}`").alias(x) for c, x in ((id_col, "doc_id"), (host, "host"), (path, "path"), (text, "text"))]
    )
    scored = materialize(evidence(slim, model).drop("text"), "quality-evidence")
    sites, prior = site_posteriors(scored)
    joined, p_low = _with_sites(scored, sites, prior, ("host", "path"), "log_odds")
    return joined.select("doc_id", F.round(p_low, 9).alias("p_low"), (p_low < REJECT).alias("kept"))


def keep_good(
    docs: DataFrame, model: Classifier, text: str = "text", host: str = "source", path: str = "lang"
) -> DataFrame:
    """docs, all columns, without those rejected.

    Sites are measured first; the texts are then read once more, so that they need not be shuffled.
    """
    slim = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in ((host, "host"), (path, "path"), (text, "text"))])
    sites, prior = site_posteriors(evidence(slim, model).drop("text"))
    odds = _fresh("log_odds", docs.columns)
    joined, p_low = _with_sites(evidence(docs, model, text, odds), sites, prior, (host, path), odds)
    return joined.where(p_low < REJECT).select(*[F.col(f"`{c}`") for c in docs.columns])
