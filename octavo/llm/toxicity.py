"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lowers case, maps look-alike letters (Greek, Cyrillic, full-width, accented) and digits that
stand for letters to plain Latin letters, drops invisible characters and makes every other character
a space. Terms start at a word's start: a whole word, or a stem that any ending may follow. Their
weights are log odds learned from labelled rows. A hit inside an exception phrase does not count. The
sum of weights is normalised by the text's length in words, and a logistic curve over the normalised
weight, the strongest term and the rate of hits gives a score from 0 to 1.

The lexicon is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows, those with the smallest
hash of their id. Their words are counted by grouped aggregation: copies of a document count once, and
only terms over the threshold come to the driver, at most MAX_TERMS of them (the strongest; a warning says where
more were over it), with three numbers for each row of the sample. Everything else sees every row and every
whole text; nothing of that is shuffled, and the model travels in the task closure.

Cases: a null or empty text has no hit and gets the score of none; a null id is kept, with held_out
false; labels that are null are not used, of several labels of a row the largest is; equal rows each
are scored; without labelled rows the seed terms alone make the model; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.shingles import mix
from octavo.plans.tables import discard, materialize, tidy

SAMPLE_ROWS = 8000
MAX_TERMS = 5000
THRESHOLD = 0.3
#: Word sets of at least this Jaccard similarity are copies; salts of the hashes that find them.
COPY = 0.8
_SALTS = mix(np.arange(1, 25, dtype=np.uint64))
#: Terms known beforehand, phrases in which they are harmless, letters that look alike.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid question of mine")
LOOKALIKES = dict(
    zip(
        "абвгдезикмнопрстухіјѕԁһɡαβεηικνορτυχωıłøđßæœ013457@$!",
        [*"abbrdezukmhonpctyxijsdhgabenikvoptuxwilodsaooieastasi"],
        strict=True,
    )
)


class _Fold(dict):
    """A translation table that fills itself: a character's plain lower-case letters, else a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Cf", "Mn"):
            out = ""
        else:
            plain = unicodedata.normalize("NFKD", c).lower()
            plain = "".join(LOOKALIKES.get(x, x) for x in plain if not unicodedata.combining(x))
            out = plain if plain.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """terms: weight by " word " or " stem"; exceptions: phrases; curve: intercept and slopes."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 2.0, 0.5, 0.5)
    key: int = field(default=0)

    def __post_init__(self):
        self.key = hash((tuple(sorted(self.terms.items())), self.exceptions, self.curve))


_automata: dict[int, object] = {}


def _automaton(lexicon: Lexicon):
    """One automaton for each worker process and lexicon."""
    if lexicon.key not in _automata:
        import ahocorasick

        _automata.clear()
        a = ahocorasick.Automaton()
        entries: dict[str, tuple] = {t: (len(t), w, False) for t, w in lexicon.terms.items()}
        entries |= {f" {fold(p)} ": (len(p) + 2, 0.0, True) for p in lexicon.exceptions}
        for k, v in entries.items():
            a.add_word(k, v)
        a.make_automaton()
        _automata[lexicon.key] = a
    return _automata[lexicon.key]


def hits(text: str | None, lexicon: Lexicon) -> tuple[int, list[float]]:
    """Number of words and the weights of the hits, the strongest one for each word start."""
    words = fold(text or "").split()
    folded, n = " " + " ".join(words) + " ", len(words)
    automaton = _automaton(lexicon)
    if not hasattr(automaton, "iter") or not len(automaton):
        return n, []
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, exception) in automaton.iter(folded):
        start = end - length + 1
        if exception:
            spared.append((start, end))
        elif weight > best.get(start, -math.inf):
            best[start] = weight
    return n, [w for s, w in best.items() if not any(a <= s < b for a, b in spared)]


def features(n: int, weights: list[float]) -> tuple[float, float, float]:
    """Strongest term; sum of weights over the root of the length; logarithm of hits in 1000 words."""
    if not weights:
        return 0.0, 0.0, 0.0
    return max(weights), sum(weights) / math.sqrt(max(n, 1)), math.log1p(1000 * len(weights) / max(n, 1))


def score(text: str | None, lexicon: Lexicon) -> tuple[float, int]:
    n, weights = hits(text, lexicon)
    z = lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], features(n, weights), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(weights)


def _slots(words: list[str]) -> list[int]:
    """Keys of a set of words: smallest hashes in pairs, of which near copies share one almost surely."""
    h = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
    least = mix(h[None, :] + _SALTS[:, None]).min(axis=1, initial=np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        return mix(least[::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2] + _SALTS[::2]).view(np.int64).tolist()


def word_sets(rows: DataFrame) -> DataFrame:
    """(row, y, words, slots): distinct folded words of each of rows (row, y, text), and the keys that copies share."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(fold(t.as_py() or "").split())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(words, pa.list_(pa.string())),
                    pa.array([_slots(w) for w in words], pa.list_(pa.int64())),
                ],
                names=["row", "y", "words", "slots"],
            )
        tidy()

    return rows.select("row", "y", "text").mapInArrow(folded, "row long, y int, words array<string>, slots array<long>")


def copies(sets: DataFrame, least: float = COPY) -> DataFrame:
    """(row): those of (row, y, words, slots) whose set of words is at least so similar (Jaccard) to that of a
    smaller row with the same label.

    A row is compared with the smallest row of each of its slots, so no slot's rows are paired; shared
    slots only propose, the sets themselves decide.
    """
    slots = sets.select("row", "y", F.posexplode("slots").alias("k", "slot"))
    hubs = slots.groupBy("y", "k", "slot").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = slots.join(hubs, ["y", "k", "slot"]).where("row <> hub").select("row", "hub").distinct()
    theirs = sets.select(F.col("row").alias("hub"), F.col("words").alias("hub_words"))
    met = pairs.join(sets.select("row", "words"), "row").join(theirs, "hub")
    both = F.size(F.array_intersect("words", "hub_words"))
    return met.where(both >= least * (F.size("words") + F.size("hub_words") - both)).select("row").distinct()


def learn_terms(sets: DataFrame) -> dict[str, float]:
    """Terms from (row, y, words, slots) of documents: distinct folded words and the label.

    Copies of a document count once. Whole words and stems of 4 to 10 letters whose documents are toxic far more often than chance (a
    likelihood ratio of 35 or more) with log odds of 2 or more. A longer term stays only where it
    says more than the stem it begins with.
    """
    once = materialize(sets.join(F.broadcast(materialize(copies(sets), "toxicity-copies")), "row", "left_anti").select("y", "words"), "toxicity-once")
    totals = once.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    n_bad, n_good = totals.bad or 0, totals.n - (totals.bad or 0)
    terms: dict[str, float] = {}
    if n_bad and n_good:
        whole = F.transform(F.filter("words", lambda w: F.length(w) > 2), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

        def stems(k: int):
            return F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.lit(" "), F.substring(w, 1, k)))

        grams = once.select("y", F.explode(F.array_distinct(F.concat(whole, *map(stems, range(4, 11))))).alias("g"))
        counted = grams.groupBy("g").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
        share, a, b = n_bad / (n_bad + n_good), F.col("a"), F.col("b")
        p = a / (a + b)
        rest = F.when(b > 0, b * F.log((1 - p) / (1 - share))).otherwise(F.lit(0.0))
        weight = F.log((a + 0.5) / (n_bad + 1)) - F.log((b + 0.5) / (n_good + 1))
        over = counted.where(a >= 5).where((p > share) & (2 * (a * F.log(p / share) + rest) >= 35) & (weight >= 2))
        found = over.select("g", weight.alias("w")).orderBy(F.desc("w"), "g").limit(MAX_TERMS + 1).collect()
        if len(found) > MAX_TERMS:
            warnings.warn(f"more than {MAX_TERMS} terms; the weakest are left out", stacklevel=2)
        for g, w in sorted(((r.g, r.w) for r in found[:MAX_TERMS]), key=lambda x: (len(x[0]), x[0])):
            begun = [terms[g[:k]] for k in range(5, len(g)) if g[:k] in terms]
            if not begun or w > max(begun) + 1:
                terms[g] = w
    discard(once)
    for word in SEEDS:
        if not any(f" {word} "[:k] in terms for k in range(4, len(word) + 3)):
            terms[f" {word} "] = 3.0
    return dict(sorted(terms.items(), key=lambda x: -x[1]))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression with a ridge on the slopes, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    keep = ridge * np.diag([1e-3] + [1.0] * x.shape[1])
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + keep, a.T @ (y - p) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def in_fold(id_col, fold_no: int = 2):
    """Whether crc32 of the id as text falls into the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == fold_no, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Lexicon:
    """Lexicon and curve from at most sample_rows labelled rows outside the held-out fold."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL")
        .where(~in_fold(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
        .collect()
    )
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sample = F.broadcast(spark.createDataFrame([(i, r.id, r.y) for i, r in enumerate(chosen)], f"row long, id {kind}, y int"))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    read = slim.join(sample, "id").select("row", "y", "text")
    sets = materialize(word_sets(read), "toxicity-words")
    lexicon = Lexicon(learn_terms(sets))
    discard(sets)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(*hits(t.as_py(), lexicon)) for t in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["row", "y", "x"])
        tidy()

    # Rows that share an id are all read, so the sample's bound is on its ids.
    rows = read.mapInArrow(measured, "row long, y int, x array<double>").orderBy("row", "x").toArrow()
    y = rows.column("y").to_numpy()
    if 0 < y.sum() < len(y):
        curve = fit_curve(np.array(rows.column("x").to_pylist()), y.astype(float))
        lexicon = Lexicon(lexicon.terms, lexicon.exceptions, curve)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted, n_hits."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s, _ in found], pa.int32()),
                    pa.array([n for _, n in found], pa.int32()),
                ],
                names=["doc_id", "score", "predicted", "n_hits"],
            )
        tidy()

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(scored, f"doc_id {kind}, score double, predicted int, n_hits int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs, all columns, without the documents predicted toxic."""
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py(), lexicon)[0] < THRESHOLD for t in batch.column(at)], pa.bool_()))
        tidy()

    return docs.mapInArrow(kept, docs.schema)
