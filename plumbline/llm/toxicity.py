"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import flat, sent, slices, stored

#: Tokens are counted by hash class, so tables have this size for any corpus.
CLASSES = 1 << 20
#: Characters of a word's stem, which speaks for words too rare to speak for themselves.
STEM = 4
#: Pseudo-counts of a token, split by the class totals (Dirichlet prior).
PRIOR = 10.0
#: Log-odds within this many standard errors of zero count as zero.
SURE = 2.5
#: What each token costs a passage: neutral words end it.
DRIFT = 0.5
#: Passages expected by chance at most so often in a clean document are reported.
MOST_EXPECTED = 0.01
#: Array values handled at a time.
CHUNK = 1 << 19

COUNT_SCHEMA = "token int, toxic bigint, clean bigint"
PASSAGE = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
SCAN_SCHEMA = ("doc_id bigint, n_words int, best double, evidence double, "
               "passages array<struct<first_word:int,end_word:int,score:double,expected:double>>")


@dataclass
class Model:
    """Token log-odds, the Gumbel law's rate and size factor, and the logistic curve over a
    document's evidence (which leaves the size factor to the curve's shift)."""

    odds: np.ndarray
    rate: float = 1.0
    size: float = 0.1
    slope: float = 0.3
    shift: float = 0.0

    def chance(self, score, n_words):
        """Log of how often passages of that score are expected in n clean words."""
        return np.log(self.size * np.maximum(n_words, 1)) - self.rate * score


def word_tokens(text: Column) -> Column:
    """Hashes of each lower-cased run of letters and digits and of its stem, in turn."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    pair = lambda w: F.array(F.xxhash64(w), F.xxhash64(F.lit("stem"), F.substring(w, 1, STEM)))
    return F.flatten(F.transform(runs, pair))


def token_scores(odds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A word's log-odds, or its stem's where the word's own are not sure; drift taken off."""
    own = odds[tokens[0::2] & (CLASSES - 1)]
    return np.where(own != 0, own, odds[tokens[1::2] & (CLASSES - 1)]) - DRIFT


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of each token class under a Dirichlet prior with the classes' overall ratio."""
    t, c = max(float(toxic.sum()), 1.0), max(float(clean.sum()), 1.0)
    a, b = toxic + PRIOR * t / (t + c), clean + PRIOR * c / (t + c)
    odds = np.log(a / b) - np.log(t / c)
    z2 = odds ** 2 / (1 / a + 1 / b)
    return odds * np.maximum(0.0, 1 - SURE ** 2 / np.maximum(z2, 1e-9))


def gumbel_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over clean tokens (their mean is negative)."""
    p = weights / max(weights.sum(), 1)
    if not (p[scores > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: a list of disjoint
    candidates, joined from the right while that raises the score."""
    positive = scores > 0
    edge = np.nonzero(np.diff(np.concatenate(([0], positive.astype(np.int8), [0]))))[0]
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, earlier place
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left, right = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:  # skip along earlier candidates with no lower start
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - l) for s, e, l, r, _ in found]


def _count(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of toxic and of other rows; per task first, then by token class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CLASSES), np.int64)
        for batch in slices(batches, "words", CHUNK):
            words, offsets = flat(batch.column("words"))
            toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), bool), np.diff(offsets))
            token = words & (CLASSES - 1)
            counts[0] += np.bincount(token[toxic], minlength=CLASSES)
            counts[1] += np.bincount(token[~toxic], minlength=CLASSES)
        used = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[0, used]), pa.array(counts[1, used])],
                                         ["token", "toxic", "clean"])

    sums = labelled.select("words", "toxic").mapInArrow(run, COUNT_SCHEMA).groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    out = np.zeros((2, CLASSES))
    at = sums.column("token").to_numpy()
    out[0, at], out[1, at] = sums.column("toxic").to_numpy(), sums.column("clean").to_numpy()
    return out[0], out[1]


def _scan(rows: DataFrame, model: Model) -> DataFrame:
    """Passages and evidence of every row (doc_id, words)."""
    get_model = sent(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get_model()
        limit = np.log(MOST_EXPECTED)
        for batch in slices(batches, "words", CHUNK):
            words, offsets = flat(batch.column("words"))
            scores, offsets = token_scores(m.odds, words), offsets // 2
            best, evidence, passages = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = segments(scores[a:b])
                top = max((s for _, _, s in found), default=0.0)
                kept = [(s, e, v, float(x)) for s, e, v in found if (x := m.chance(v, b - a)) <= limit]
                best.append(top)
                # the best passage, and what further outstanding ones add
                length = float(np.log(max(b - a, 1)))
                more = sorted(v for v in (m.rate * s - length for *_, s in found) if v > 0)[:-1]
                evidence.append(m.rate * top - length + sum(more))
                passages.append([{"first_word": s, "end_word": e, "score": v, "expected": float(np.exp(x))} for s, e, v, x in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int32)), pa.array(best, pa.float64()),
                 pa.array(evidence, pa.float64()), pa.array(passages, pa.list_(PASSAGE))],
                ["doc_id", "n_words", "best", "evidence", "passages"])

    return rows.select("doc_id", "words").mapInArrow(run, SCAN_SCHEMA)


def logistic(x: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on binned counts, lightly held to zero."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (all_ * p - ones) + 1e-3 * w
        hess = (design * (all_ * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(labelled: DataFrame) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic 0/1; null labels teach nothing).

    Three quarters of the rows, by a hash of the id, give the token counts; the rest give
    the Gumbel law's size factor (its clean rows) and the logistic curve, so that words
    seen once do not flatter it. All statistics are sums over all rows; tables of token
    classes and of evidence bins, both of fixed size, reach the driver.
    """
    rows = labelled.where("toxic IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), word_tokens(F.col("text")).alias("words"), (F.col("toxic") > 0).alias("toxic"),
        (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0).alias("_curve"))
    toxic, clean = _count(rows.where("NOT _curve"))
    model = Model(odds=log_odds(toxic, clean))
    model.rate = gumbel_rate(model.odds - DRIFT, clean)
    # the label rides along in doc_id, which the scan hands through
    curve = stored(_scan(rows.where("_curve").select(F.col("toxic").cast("bigint").alias("doc_id"), "words"), model).drop("passages"))
    sums = curve.where("doc_id = 0 AND n_words > 0").agg(
        F.count("*"), F.sum(F.col("n_words") * F.exp(-model.rate * F.col("best")))).first()
    if sums[0]:
        model.size = float(sums[0] / sums[1])
    found = curve.select(F.col("doc_id").alias("y"), F.round(F.greatest(F.lit(-50.0), F.least(F.lit(200.0), "evidence")), 1).alias("x"))
    bins = found.groupBy("x").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("x").collect()
    if bins:
        x, ones, n = (np.array([float(r[k]) for r in bins]) for k in ("x", "ones", "n"))
        model.slope, model.shift = logistic(x, ones, n)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5), n_words, passages of every row
    of ``docs`` (doc_id, text; others are ignored).

    A passage is a maximal scoring run of words, expected in at most MOST_EXPECTED clean
    documents of that length; its place counts runs of letters and digits. Null and empty
    texts have no passage and the score of a text without toxic words. Repeated rows and
    null ids are scored like others.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), word_tokens(F.col("text")).alias("words"))
    value = 1 / (1 + F.exp(-(model.slope * F.col("evidence") + model.shift)))
    scored = _scan(rows, model).withColumn("score", value)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "passages")


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of documents with a label (the greatest, where a doc_id has several)."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # sorted and merged at every size, so that what is shuffled follows the input
    return docs.select("doc_id", "text").join(one.hint("merge"), "doc_id")
