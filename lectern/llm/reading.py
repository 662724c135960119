"""Reading level of documents: a linear pairwise ranker over syntax and vocabulary features, calibrated by isotonic
regression.

The ranker is fitted on pairs of graded documents and scores any stretch of text, since its features are means over
words and sentences. A document is scored sentence by sentence; its score is the median over its sentences (weighting
each sentence alike), so that passages for other readers don't move it. Isotonic regression over the graded documents
turns scores into levels.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scale import all_cores

#: Bounds of the sample the model is fitted on: graded documents (the smallest by a hash of doc_id), characters of each
#: (longer ones aren't taken), and pairs of them the ranker sees.
MOST_GRADED, MOST_CHARS, MOST_PAIRS = 3_000, 100_000, 200_000
#: Fewest words of a document that is given a level by the query.
LEAST_WORDS = 60

_BREAK = re.compile(r"(?<=[a-z0-9)\]\"'][.!?;])[ \t]+(?=\S)|\n\s*\n\s*|(?:^|\n)[ \t]*[*•-][ \t]+")
_MARK = re.compile(r"^\s*[*•-]\s+")
_ABBREVIATION = re.compile(r"\b(e\.g|i\.e|etc|cf|vs|Fig|Eq|Dr|No)\.")
_EDGE = ".,;:!?()[]\"'*-"

FEATURES = ("grade", "hard", "letters", "long", "words", "commas")


def sentences(text: str) -> list[str]:
    """Sentences of a text: cut behind sentence ends, at blank lines and at list marks; abbreviations end none.

    A single line end cuts nothing, so that a passage set line by line counts once, as one quotation."""
    return [_MARK.sub("", s) for s in _BREAK.split(_ABBREVIATION.sub(r"\1", text)) if s and not s.isspace()]


def clauses(text: str) -> list[str]:
    """Sentences, with run-on chains of three or more main clauses joined by 'and' taken apart."""
    out = []
    for s in sentences(text):
        parts = s.split(" and ")
        if len(parts) > 3 and len(s) > 30 * len(parts) / 2:
            out += parts
        else:
            out.append(s)
    return out


def measured(text: str, grades: dict[str, float], middle: float) -> np.ndarray:
    """Features of each sentence of at least three words; one row for the whole text where it has none."""
    rows = []
    for s in clauses(text):
        words = [w for w in (x.strip(_EDGE) for x in s.split()) if w]
        n = len(words)
        if n < 3:
            continue
        lengths = [len(w) for w in words]
        known = [grades.get(w.lower(), middle) for w in words if w.isalpha()] or [middle]
        rows.append((sum(known) / len(known), max(known), sum(lengths) / n, sum(1 for x in lengths if x > 8) / n, np.log1p(n / (1 + s.count(".\n"))), s.count(",") / n))
    if not rows:
        rows.append((middle, middle, float(len(text) and len(text) / max(1, len(text.split()))), 0.0, np.log1p(len(text.split())), 0.0))
    return np.array(rows, dtype=np.float64)


def word_grades(texts: list[str], levels: np.ndarray) -> tuple[dict[str, float], float]:
    """The mean level of the graded documents' sentences a word occurs in, shrunk to the overall mean; the mean."""
    middle = float(np.mean(levels)) if len(levels) else 0.0
    total: dict[str, float] = defaultdict(float)
    count: dict[str, int] = defaultdict(int)
    for text, level in zip(texts, levels):
        for w in {x.strip(_EDGE).lower() for x in text.split()}:
            if w.isalpha():
                total[w] += level
                count[w] += 1
    return {w: (total[w] + 2 * middle) / (count[w] + 2) for w in sorted(count)}, middle


def refined_grades(texts: list[str], levels: np.ndarray, grades: dict[str, float], middle: float, rounds: int = 3) -> dict[str, float]:
    """Word grades from sentences rather than documents: a sentence takes the mean grade of its words, pulled to the
    level of its document; a word takes the mean of its sentences. Words of stray sentences lose the document's level."""
    held = []
    for text, level in zip(texts, levels):
        for s in clauses(text):
            words = {w for w in (x.strip(_EDGE).lower() for x in s.split()) if w in grades}
            if len(words) > 2:
                held.append((words, level))
    for _ in range(rounds):
        total: dict[str, float] = defaultdict(float)
        count: dict[str, float] = defaultdict(float)
        for words, level in held:
            own = sum(grades[w] for w in words) / len(words)
            value = 0.6 * own + 0.4 * level
            for w in words:
                total[w] += value
                count[w] += 1
        grades = {w: (total[w] + middle) / (count[w] + 1) if w in count else g for w, g in grades.items()}
    return grades


def rank_weights(x: np.ndarray, levels: np.ndarray, most: int = MOST_PAIRS, ridge: float = 1e-2, seed: int = 1) -> np.ndarray:
    """Weights of a logistic ranker over differences of documents of unequal level, by Newton's method."""
    rng = np.random.default_rng(seed)
    n = len(levels)
    if n * (n - 1) // 2 <= most:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = rng.integers(0, n, most), rng.integers(0, n, most)
    apart = levels[i] != levels[j]
    i, j = i[apart], j[apart]
    if not len(i):
        return np.zeros(x.shape[1])
    d = (x[i] - x[j]) * np.sign(levels[i] - levels[j])[:, None]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / len(d) - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(scores: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of levels to scores with the least squared error: adjacent violators are pooled,
    and a pool has a knot at either end. Documents of one score start as one pool."""
    at, first = np.unique(scores, return_inverse=True)
    size = np.bincount(first).astype(np.float64)
    mean = np.bincount(first, weights=levels) / size
    pools: list[tuple[float, float, float, float]] = []
    for x, m, n in zip(at, mean, size):
        low, value, weight = x, m, n
        while pools and pools[-1][2] >= value:
            earlier = pools.pop()
            value, weight = (earlier[2] * earlier[3] + value * weight) / (earlier[3] + weight), earlier[3] + weight
            low = earlier[0]
        pools.append((low, x, value, weight))
    return np.array([x for p in pools for x in p[:2]]), np.array([p[2] for p in pools for _ in range(2)])


class Model:
    """Word grades, scaling, ranker weights, and the isotonic map from scores to levels; the languages it was fitted on."""

    def __init__(self, texts: list[str], levels: list[int], languages: frozenset = frozenset(), most_pairs: int = MOST_PAIRS):
        self.languages = languages
        y = np.array(levels, dtype=np.int64)
        self.known = np.unique(y)
        self.grades, self.middle = word_grades(texts, y)
        self.grades = refined_grades(texts, y, self.grades, self.middle)
        parts = [measured(t, self.grades, self.middle) for t in texts]
        x = np.array([np.median(p, axis=0) for p in parts]) if parts else np.zeros((0, len(FEATURES)))
        self.mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
        self.scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0) if len(x) else np.ones(len(FEATURES))
        self.weights = rank_weights((x - self.mean) / self.scale, y, most_pairs) if len(x) else np.zeros(len(FEATURES))
        scores = np.array([self.of(p) for p in parts])
        self.knots = isotonic(scores, y) if len(x) else (np.zeros(0), np.zeros(0))

    def of(self, rows: np.ndarray) -> float:
        return float(np.median(((rows - self.mean) / self.scale) @ self.weights))

    def score(self, text: str) -> float:
        return self.of(measured(text, self.grades, self.middle))

    def level(self, score: float) -> int:
        value = np.interp(score, *self.knots)
        return int(self.known[np.argmin(np.abs(self.known - value))])


def fitted(documents: DataFrame, graded: DataFrame, most: int = MOST_GRADED, most_chars: int = MOST_CHARS, most_pairs: int = MOST_PAIRS) -> Model:
    """The model fitted on at most ``most`` graded documents with a text of at most ``most_chars`` characters; ties in the
    hash go by doc_id."""
    labels = graded.where("doc_id is not null and level is not null").groupBy("doc_id").agg(F.min("level").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.where("text is not null and text <> ''").where(F.length("text") <= most_chars).join(F.broadcast(labels), "doc_id").select("doc_id", "text", "lang", "level").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Model([r["text"] for r in rows], [r["level"] for r in rows], frozenset(r["lang"] for r in rows), most_pairs)


def reading_levels(documents: DataFrame, graded: DataFrame, most_graded: int = MOST_GRADED, most_chars: int = MOST_CHARS, most_pairs: int = MOST_PAIRS, only: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_words, score, level) of every document with a text and an id, or of those ``only`` holds for.

    Null and empty texts have no row. Score and level are null where the model can't tell: without graded documents, and
    for languages (null among them) of which it saw none. A text without any sentence of three words is scored as a
    whole. ``most_graded``, ``most_chars`` and ``most_pairs`` bound the sample the model is fitted on, nothing else.
    """
    model = fitted(documents, graded, most_graded, most_chars, most_pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            scores = [model.score(t) if lang in model.languages else None for t, lang in zip(texts, b["lang"].to_pylist())]
            levels = [model.level(s) if s is not None else None for s in scores]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], b["source"], pa.array([len(t.split()) for t in texts], pa.int32()), pa.array(scores, pa.float64()), pa.array(levels, pa.int32())], names=["doc_id", "lang", "source", "n_words", "score", "level"])

    rows = documents.where("doc_id is not null and text <> ''").where(only or "true").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    return all_cores(rows).mapInArrow(run, "doc_id long, lang string, source string, n_words int, score double, level int")


def level_profile(levels: DataFrame) -> DataFrame:
    """Documents and words per source and level; the level is null for documents that have none."""
    return levels.groupBy("source", "level").agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"))
