"""Toxic passages: maximal scoring segments over token log-odds, with extreme-value statistics per document."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import make_room, written

#: Labelled documents that the fit takes at most: those of least hash of their id. All else follows from them whole.
TRAIN_ROWS = 20_000
#: Share of the tokens that the Dirichlet prior weighs; least |z| of a word that scores; score of any other word.
PRIOR, LEAST_Z, NEUTRAL = 0.2, 4.0, -0.05
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time over its positive scores.

    Kept as a list of disjoint candidates with the cumulative sums before (left) and after (right) each. A new
    positive item looks back for the nearest candidate of smaller left sum; if that one's right sum is not
    smaller the item starts a candidate, else it joins with it and looks again. Links to that nearest candidate
    make the search amortised linear.
    """
    total = np.cumsum(scores)
    found: list[list] = []  # start, end, left, right, link
    for i in np.flatnonzero(scores > 0).tolist():
        start, right = i, float(total[i])
        left = float(total[i - 1]) if i else 0.0
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, i + 1, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - lft) for a, b, lft, r, _ in found]


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    decay: float
    log_k: float
    slope: float
    shift: float

    def significance(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """-ln of the chance that clean text of n tokens holds segments as good as the best r, at the best r.

        A segment of score S has the normalised score x = decay * S - ln(K n), and r of them with the sum T have
        about the chance exp(-T) T**(r-1) / (r! (r-1)!).
        """
        x = sorted((self.decay * s - self.log_k - math.log(n) for _, _, s in segments), reverse=True)
        best, total = -math.inf, 0.0
        for r, v in enumerate(x, 1):
            if v <= 0 and r > 1:
                break
            total += v
            best = max(best, total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r) if total > 1 else total)
        return best

    def score(self, significance: float) -> float:
        z = self.slope * squash(significance) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def squash(x: float) -> float:
    return math.asinh(max(x, -20.0))


def segments_of(words: list[str], scores: dict[str, float]) -> list[tuple[int, int, float]]:
    get = scores.get
    return maximal_segments(np.fromiter((get(w, NEUTRAL) for w in words), float, len(words))) if words else []


def _word_counts(batches):
    import pyarrow as pa

    make_room()
    counts: dict[str, list[int]] = {}

    def rows():
        out = pa.RecordBatch.from_pydict({"word": list(counts), "toxic": [c[1] for c in counts.values()], "clean": [c[0] for c in counts.values()]})
        counts.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in set(words_of(text)):  # once per document: repetition within one says nothing about the others
                counts.setdefault(w, [0, 0])[toxic] += 1
            if len(counts) > 500_000:
                yield rows()
    if counts:
        yield rows()


def _statistics(model: Model, value):
    """Per text: toxic or not, and value(segments, number of words), null for a text without a segment."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                segments = segments_of(words, model.scores)
                out.append(value(segments, len(words)) if segments else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.float64())], names=["toxic", "x"])

    return run


def _decay(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(weight * exp(x * scores)) = 1; weights are chances under clean text."""
    if not (scores > 0).any() or (scores * weight).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda x: float((weight * np.exp(x * scores)).sum()) - 1
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with slightly smoothed targets, by Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, w = np.where(y > 0, hi, lo), np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-6 * np.eye(2), a.T @ (t - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn the model from at most `train_rows` labelled documents outside the held-out fold.

    The sample (rows of least hash of their id) is the documented bound that lets it be broadcast to the
    documents and its statistics come to the driver: two numbers a document, and the words that score, which are no
    more than the sample's. Whole texts, words of any length and all segments take part, as they do in scoring.
    Words are counted per class in Spark; a word's log-odds ratio has a Dirichlet prior proportional to its frequency
    in the whole sample. Without labels of both kinds nothing is toxic. An id with several labels has the largest.
    """
    key = F.col(id_col).cast("string")
    labelled = labels.where((F.crc32(key) % folds != held_out_fold) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = written(rows.join(F.broadcast(sample), "id").select("text", "toxic"), "toxicity-sample")
    counts = texts.mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "toxicity-words")
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = float(sums[0] or 0), float(sums[1] or 0)
    if not n1 or not n0:
        return Model({}, 1.0, 0.0, 1.0, -5.0)
    weight = PRIOR * (n1 + n0)
    prior = weight * (F.col("toxic") + F.col("clean")) / (n1 + n0)
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y1 / (n1 + weight - y1)) - F.log(y0 / (n0 + weight - y0))
    scored = counts.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / y1 + 1 / y0))
    kept = scored.where(F.abs("z") >= LEAST_Z).orderBy("word").collect()
    scores = {r.word: float(r.odds) for r in kept}
    share = np.array([r.clean + 0.5 for r in kept] + [0.0]) / (n0 + 0.5 * len(scores))
    share[-1] = max(0.0, 1 - share.sum())
    decay = _decay(np.array([*scores.values(), NEUTRAL]), share)
    told = lambda model, value: texts.mapInArrow(_statistics(model, value), "toxic int, x double").collect()
    tops = sorted(r.x for r in told(Model(scores, decay, 0.0, 1.0, 0.0), lambda found, n: decay * max(s for *_, s in found) - math.log(n)) if r.x is not None and not r.toxic)
    # The mean of a Gumbel variable with unit decay lies Euler's constant above its mode.
    raw = Model(scores, decay, (float(np.mean(tops)) if tops else 0.0) - 0.5772156649, 1.0, 0.0)
    found = sorted((squash(-20.0 if r.x is None else r.x), r.toxic) for r in told(raw, raw.significance))
    slope, shift = _logistic(np.array([x for x, _ in found]), np.array([y for _, y in found], float))
    return Model(scores, decay, raw.log_k, slope, shift)


def _scorer(model: Model):
    def run(batches):
        import pyarrow as pa

        passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                segments = segments_of(words, model.scores)
                scores.append(model.score(model.significance(segments, len(words)) if segments else -20.0))
                edge = model.log_k + math.log(max(len(words), 1))
                good = [s for s in segments if model.decay * s[2] > edge]
                if good:  # places in the text are found again only where they are needed; lower() may change lengths
                    spans = [m.span() for m in _WORD.finditer(text.lower())]
                    passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s} for a, b, s in good])
                else:
                    passages.append([])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(passages, passage)], names=["id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score (chance of label 1), predicted (score >= 0.5) and its significant passages.

    A passage is (start, end, score) in characters of the lower-cased text. Null and empty texts have no passage
    and the least score. Null ids and repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(model), "id long, score double, passages array<struct<start: long, end: long, score: double>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not predicted to be toxic; the text is scored as in `score`."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        make_room()
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                words = words_of(text or "")
                segments = segments_of(words, model.scores)
                keep.append(model.score(model.significance(segments, len(words)) if segments else -20.0) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Fit on the labels outside the held-out fold and score every document; adds held_out to `score`'s columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out_fold=held_out_fold)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_out_fold, F.lit(False))
    return score(docs, model, id_col=id_col, text_col=text_col).withColumn("held_out", held)
