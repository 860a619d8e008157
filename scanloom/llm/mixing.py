"""Soft-membership mixing: nonnegative document rates whose expected domain token totals match target weights."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Labelled documents that the classifier is fitted on at most: those of least hash of their id.
TRAIN_ROWS = 10_000
#: Characters of a word's ends that are hashed, and buckets for its front and for its back.
GRAM, BUCKETS = 3, 512
#: Of so many labelled documents one is kept from the fit, to temper the posteriors and to tell their accuracy.
HELD_OUT = 5
_TEMPERATURES = [2.0**e for e in range(-2, 9)]


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once per row, however often it occurs: as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    """Tokens of a text here: its runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Buckets of a text's n-grams: for every word the hash of its first characters, and that of its last."""
    front = F.transform(words, lambda w: F.pmod(F.hash(F.substring(w, 1, GRAM)), F.lit(BUCKETS)))
    back = F.transform(words, lambda w: F.pmod(F.hash(F.substring(w, -GRAM, GRAM)), F.lit(BUCKETS)) + BUCKETS)
    return F.concat(front, back)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v)


def _doubles(numbers) -> Column:
    """A literal array, of numbers or of rows of numbers; as one string, so that the plan stays small."""
    nested = len(numbers) and not np.isscalar(numbers[0])
    return F.from_json(F.lit(json.dumps([[float(x) for x in r] for r in numbers] if nested else [float(x) for x in numbers])), "array<array<double>>" if nested else "array<double>")


@dataclass(frozen=True)
class Classifier:
    """Posteriors of domains from a text's n-grams.

    grams has, per bucket, the log share of that n-gram in each domain. A text's features are, per domain, the mean of
    those over its n-grams, its length, the share of its lines that are distinct and that of its words that repeat the
    word before. The domains' linear scores of the features, divided by the temperature, give the posteriors by their
    softmax.
    """

    domains: list[str]
    grams: list[list[float]]
    weights: list[list[float]]  # per domain: one weight per feature, then the constant
    temperature: float = 1.0
    accuracy: float | None = None  # on the labelled documents kept from the fit, as is loss (mean -ln posterior)
    loss: float | None = None

    def features(self, text: Column, words: Column) -> Column:
        zero, rows = _doubles([0.0] * len(self.domains)), _doubles(self.grams)
        add = lambda s, b: F.zip_with(s, F.get(rows, b), lambda x, y: x + y)
        n, lines = F.greatest(F.size(words), F.lit(1)), F.split(text, "\n")
        sums = F.aggregate(_grams(words), zero, add)
        means = _let(n, lambda size: F.transform(sums, lambda v: v / (2 * size)))
        again = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
        return F.concat(means, F.array(F.log(1.0 + n) / 10, _let(lines, lambda x: F.size(F.array_distinct(x)) / F.size(x)), again / n))

    def scores(self, text: Column, words: Column) -> Column:
        dot = lambda v, w: sum((v[i] * float(c) for i, c in enumerate(w[:-1])), F.lit(float(w[-1])))
        return _let(self.features(text, words), lambda v: F.array(*[dot(v, w) for w in self.weights]))

    def posteriors(self, text: Column, words: Column) -> Column:
        """Array of posteriors, in the order of domains; an empty one if no domain is known."""
        if not self.domains:
            return F.array().cast("array<double>")
        return _softmax(self.scores(text, words), self.temperature)


def _softmax(scores: Column, temperature: float) -> Column:
    raised = _let(scores, lambda s: _let(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp((v - top) / float(temperature)))))
    return _let(raised, lambda e: _let(_total(e), lambda t: F.transform(e, lambda v: v / t)))


def fit_classifier(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", train_rows: int = TRAIN_ROWS) -> Classifier:
    """Hashed n-gram counts per domain, and over them Gaussian discriminants with a pooled covariance, in closed form.

    `labelled` has an id and a domain per row; rows with nulls are left out, and of an id with several domains the
    least counts. Of the labelled rows at most train_rows take part, so they can be broadcast to the documents. One of
    HELD_OUT of them, by a hash, is not fitted on: those choose the temperature, for discriminants of long texts are
    too sure of themselves, and tell the accuracy. Without a labelled document no domain is known.
    """
    known = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(sample), "id")
    held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(HELD_OUT)) == 0
    rows = written(rows.select("domain", "text", held.alias("held")), "mixing-sample")
    words = _words(F.col("text"))
    fitted = rows.where("not held")
    if fitted.isEmpty():  # too few to keep any
        fitted = rows
    counts = fitted.select("domain", F.explode(_grams(words)).alias("b")).groupBy("domain", "b").count().collect()
    domains = sorted(r.domain for r in fitted.select("domain").distinct().collect())
    if not domains:
        return Classifier([], [], [])
    held_of = np.ones((2 * BUCKETS, len(domains)))
    for r in counts:
        held_of[r.b, domains.index(r.domain)] += r["count"]
    # Three decimals do, and keep the plans that hold these numbers small.
    raw = Classifier(domains, np.round(np.log(held_of) - np.log(held_of.sum(0)), 3).tolist(), [])
    d = len(domains) + 3
    # Computed once, before the many sums.
    x = fitted.select("domain", F.explode(F.array(_let(words, lambda w: raw.features(F.col("text"), w)))).alias("x"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = x.groupBy("domain").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("p")).collect()
    sums.sort(key=lambda r: r.domain)
    total = sum(r.n for r in sums)
    scatter, means = np.zeros((d, d)), []
    for r in sums:
        s, p = np.array(r.s), np.zeros((d, d))
        for (i, j), v in zip(pairs, r.p, strict=True):
            p[i, j] = p[j, i] = v
        means.append(s / r.n)
        scatter += p - np.outer(s, s) / r.n
    # Features are of the order of 1; one that hardly varies within the domains must not decide alone, nor by rounding.
    scale, centre = np.sqrt(np.maximum(np.diag(scatter) / total, 1e-4)), sum(np.array(r.s) for r in sums) / total
    inverse = np.linalg.pinv(scatter / total / np.outer(scale, scale) + 1e-3 * np.eye(d)) / np.outer(scale, scale)
    weights = []
    for r, m in zip(sums, means, strict=True):
        w = inverse @ (m - centre)
        weights.append([*map(float, w), float(np.log(r.n / total) - 0.5 * (m + centre) @ w)])
    return _tempered(Classifier(domains, raw.grams, weights), rows.where("held"), words)


def _tempered(classifier: Classifier, held: DataFrame, words: Column) -> Classifier:
    """The classifier with the temperature of least loss on held-out documents, and that loss and accuracy."""
    place = F.array_position(F.array(*map(F.lit, classifier.domains)), F.col("domain")).cast("int")
    scored = held.select(place.alias("y"), F.explode(F.array(_let(words, lambda w: classifier.scores(F.col("text"), w)))).alias("s"))
    # A domain that the fit has not seen is always missed, at the greatest loss.
    loss = lambda t: F.when(F.col("y") > 0, -F.log(F.greatest(F.get(_softmax(F.col("s"), t), F.col("y") - 1), F.lit(1e-12)))).otherwise(-np.log(1e-12))
    right = F.col("y") == F.array_position("s", F.array_max("s"))
    found = scored.agg(F.avg(right.cast("double")), *[F.avg(loss(t)) for t in _TEMPERATURES]).first()
    if found[0] is None:
        return classifier
    losses = list(found[1:])
    best = losses.index(min(losses))
    return Classifier(classifier.domains, classifier.grams, classifier.weights, _TEMPERATURES[best], float(found[0]), float(losses[best]))


@dataclass(frozen=True)
class Fit:
    """Rates as a function of a document's domain tokens: start at 1, and for each g: max(0, rate - tokens . g)."""

    steps: list[list[float]]
    totals: list[float]  # expected domain tokens of the last rates
    targets: list[float]

    @property
    def misfit(self) -> float:
        """Tokens by which the totals miss the targets, as a share of the targets' tokens."""
        return float(np.abs(np.subtract(self.totals, self.targets)).sum() / max(np.abs(self.targets).sum(), 1e-300)) if self.targets else 0.0

    def rate(self, tokens: Column) -> Column:
        rate = F.lit(1.0)
        for g in self.steps:
            rate = F.greatest(F.lit(0.0), rate - sum((tokens[i] * float(v) for i, v in enumerate(g)), F.lit(0.0)))
        return rate


def fit_rates(members: DataFrame, targets: list[float], *, rounds: int = 60, tolerance: float = 1e-5, accept: float | None = None) -> Fit:
    """Projected-gradient least squares: rates r >= 0 with sum_d r_d * tokens_dk near targets[k] for every domain k.

    `members` has an array column `tokens`: a document's tokens times its posterior, per domain. The gradient of
    half the squared misfit at document d is tokens_d . (totals - targets). It is scaled by the inverse of the K x K
    matrix of token products over the documents whose rates are above 0, so that one step meets the targets as far
    as no further rate is cut off at 0; more steps correct for those that are.

    A round is one map-side aggregation of K + K (K + 1) / 2 numbers. Rates are not kept between rounds: they are
    folded anew from the steps so far, K numbers each, so a lost executor costs nothing but its tasks. Steps go on
    until the misfit is below the tolerance, or no longer falls for five of them, as it does where no rates meet the
    targets. The best rates are returned with their misfit; one above `accept` raises, if that is given, else warns
    above 0.01.
    """
    k = len(targets)
    if not k:
        return Fit([], [], [])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    t = lambda i: F.col("tokens")[i]
    goal, steps, found = np.array(targets, float), [], []
    norm = max(float(np.linalg.norm(goal)), 1e-300)
    for _ in range(rounds + 1):
        rate = Fit(steps, [], []).rate(F.col("tokens"))
        rows = members.select("tokens", F.explode(F.array(rate)).alias("r"))
        live = F.when(F.col("r") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        now = rows.agg(*[F.sum(t(i) * F.col("r")) for i in range(k)], *[F.sum(t(i) * t(j) * live) for i, j in pairs]).first()
        if now[0] is None:
            return Fit([], [0.0] * k, [0.0] * k)
        totals, gram = np.array(now[:k], float), np.zeros((k, k))
        found.append((float(np.linalg.norm(totals - goal)), len(steps), totals))
        best = min(found, key=lambda f: f[:2])
        if best[0] <= tolerance * norm or best[1] + 5 <= len(steps):
            break
        for (i, j), v in zip(pairs, now[k:], strict=True):
            gram[i, j] = gram[j, i] = v
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        inverse = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-9, hermitian=True) / np.outer(scale, scale)
        steps.append((inverse @ (totals - goal)).tolist())
    fit = Fit(steps[: best[1]], best[2].tolist(), goal.tolist())
    if fit.misfit > (0.01 if accept is None else accept):
        text = f"the rates miss the targets by {fit.misfit:.3%} of their tokens"
        if accept is not None:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return fit


def memberships(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Id (and columns to keep), n_tokens and the array `tokens`: n_tokens times the posterior of each domain."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = lambda w: _let(F.size(w), lambda n: F.transform(classifier.posteriors(text, w), lambda p: p * n))
    one = _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), tokens(w).alias("tokens")))
    # An exploded array of one is computed once, however many of its fields are used.
    return docs.select(*(keep or [id_col]), F.explode(F.array(one)).alias("_found")).select(*(keep or [id_col]), "_found.n_tokens", "_found.tokens")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, total_tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", accept: float | None = None) -> DataFrame:
    """Per document: id, n_tokens, domains (expected tokens by domain), rate (the expected number of its uses), misfit.

    `weights` are relative target shares of tokens by domain; a domain without one gets what it has now, before
    the named ones are scaled to fill the rest. total_tokens defaults to the tokens there are. misfit is `Fit.misfit`,
    the same in all rows; see `fit_rates` for accept.

    Memberships are written once to the shared folder and every round reads those few numbers per document, not
    the texts. Null and empty texts hold 0 tokens and keep rate 1, for no rate of theirs changes a total. Without a
    labelled document there are no domains, and all rates are 1. Null ids and repeated rows stay; an empty table gives
    no rows; other columns are not read.
    """
    classifier = fit_classifier(docs, labelled, id_col=id_col, text_col=text_col, domain_col=domain_col)
    members = written(memberships(docs, classifier, id_col=id_col, text_col=text_col), "memberships")
    rates = fit_rates(members, targets_of(members, classifier, weights, total_tokens), accept=accept)
    names = F.array(*map(F.lit, classifier.domains)).cast("array<string>")
    return members.select(id_col, "n_tokens", F.map_from_arrays(names, "tokens").alias("domains"), rates.rate(F.col("tokens")).alias("rate"), F.lit(rates.misfit).alias("misfit"))


def totals_of(members: DataFrame, classifier: Classifier) -> dict[str, float]:
    """Expected tokens by domain as the documents stand."""
    if not classifier.domains:
        return {}
    now = members.agg(F.array(*[F.sum(F.col("tokens")[i]) for i in range(len(classifier.domains))]).alias("s")).first().s
    return {d: float(v or 0) for d, v in zip(classifier.domains, now, strict=True)}


def targets_of(members: DataFrame, classifier: Classifier, weights: dict[str, float], total_tokens: float | None = None) -> list[float]:
    """Target tokens by domain, in the classifier's order; see `mix` for domains without a weight."""
    now = totals_of(members, classifier)
    total = sum(now.values()) if total_tokens is None else total_tokens
    scale = total / max(sum(now.values()), 1e-300)
    rest = sum(v for d, v in now.items() if d not in weights) * scale
    share = (total - rest) / max(sum(weights[d] for d in now if d in weights), 1e-300)
    return [weights[d] * share if d in weights else v * scale for d, v in now.items()]


def weighed(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each as one struct `row` with its `memberships`, so that no column of theirs meets a name used here."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return memberships(whole, classifier, id_col="id", text_col="text", keep=["row", "id", "text"]).drop("text")


def repeated(rows: DataFrame, rates: Fit, *, text_col: str = "text") -> DataFrame:
    """The documents of `weighed`, each as often as its rate says: the whole part, and once more by a hash of id and text.

    The hash stands for a uniform number, so the expected number of uses is the rate and a rerun chooses alike.
    """
    # An exploded array of one is computed once, however often the rate names it.
    rate = rows.withColumn("rate", F.explode(F.array(rates.rate(F.col("tokens")))))
    uniform = F.pmod(F.xxhash64("id", F.col(f"row.`{text_col}`")), F.lit(1 << 30)) / float(1 << 30)
    copies = rate.withColumn("n", (F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    return copies.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def resampled(docs: DataFrame, rates: Fit, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`repeated` of `weighed`; where the rates come from the same documents, write those once for both."""
    return repeated(weighed(docs, classifier, id_col=id_col, text_col=text_col), rates, text_col=text_col)
