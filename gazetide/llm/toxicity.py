"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any other text is unlabelled and may hold toxic
text at the rate of the class prior. A numpy classifier minimises the class-prior-corrected risk
``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``, whose second term would
fall below zero by over-fitting and is then driven back. Several classifiers, each with its own
share of the unlabelled text, are trained in tasks of their own and averaged.

A document is the set of its words and word beginnings. Only features with which a text is toxic
rather than not, by a likelihood-ratio test, are used, and of those only what explains positives
that other features leave open; words that are merely rare or shared by copies add nothing, and a
long clean text scores like a short one.

Training reads a bounded sample (``max_positive``, ``max_unlabelled``, ``max_negative`` rows,
expected, by a hash of the id; the prior is counted over all labels); scoring reads every whole
text. Labels of the learning fold alone are used, confirmed clean ones only to set the scale of
the score, together with positives that the classifier has not seen.

Defined results: null and empty texts have no features and get the score of the bias. Rows with
a null id are never learned from and are not held out. Repeated label rows of a document count
once, toxic if one says so. With no positives at all every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetide.llm.common import fold_of

PUNCTUATION = ".,;:!?\"'()[]{}*#&%|-_<>/\\"
BEGINNINGS = (3, 4, 5, 6)


def features_of(word: str) -> list[str]:
    """The word, and its beginnings with a mark."""
    word = word.strip(PUNCTUATION)
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)] if word else []


def tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def hashed(feature: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(feature.encode()) >> 1


def document_features(text: str | None) -> list[int]:
    return sorted({hashed(f) for w in tokens(text) for f in features_of(w)})


LEAST_SURPRISE = 14.0
THRESHOLD = 0.7


def covering(rows, columns, chosen, n_p: int, most: int = 300):
    """Of the ``chosen`` columns those that explain the positives best, one after another: a
    positive counts half as much once more for every one it has. What only a family of
    copies shares explains nothing that the common marks do not. ``rows``, ``columns``: the
    cells of the positives."""
    import numpy as np

    at = np.searchsorted(chosen, columns)
    known = at < len(chosen)
    known[known] = chosen[at[known]] == columns[known]
    rows, at = rows[known], at[known]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    begins = np.searchsorted(at, np.arange(len(chosen) + 1))
    weight, left, taken = np.ones(n_p), np.ones(len(chosen), bool), []
    least = max(2.0, 0.005 * n_p)
    while len(taken) < most and len(chosen):
        gain = np.where(left, np.bincount(at, weight[rows], len(chosen)), 0.0)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        taken.append(best)
        left[best] = False
        weight[rows[begins[best] : begins[best + 1]]] *= 0.5
    return chosen[np.sort(np.array(taken, np.int64))]


def train(positive, unlabelled, negative, apart, prior: float, most: int = 4096, steps: int = 1000):
    """(features, weights, bias, scale, shift) from lists of feature arrays: positives,
    unlabelled, confirmed clean, and positives kept apart from training. numpy only."""
    import numpy as np

    def flat(docs):
        sizes = np.array([len(d) for d in docs], np.int64)
        values = np.concatenate([np.asarray(d, np.int64) for d in docs]) if len(docs) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(docs)), sizes), values

    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    rows_p, values_p = flat(positive)
    rows_u, values_u = flat(unlabelled)
    candidates, count_p = np.unique(values_p, return_counts=True)
    at = np.searchsorted(candidates, values_u)
    known = at < len(candidates)
    known[known] = candidates[at[known]] == values_u[known]
    count_u = np.bincount(at[known], minlength=len(candidates))
    rate_p, rate_u = count_p / n_p, count_u / n_u
    # Were a feature independent of the class, one rate would explain both counts: twice the
    # log-likelihood ratio says how far it does not.
    both = (count_p + count_u) / (n_p + n_u)
    gain = lambda k, n, r: k * np.log(np.maximum(k / n, 1e-12) / r) + (n - k) * np.log(np.maximum(1 - k / n, 1e-12) / np.maximum(1 - r, 1e-12))
    surprise = 2 * (gain(count_p, n_p, both) + gain(count_u, n_u, both))
    # Of those, features with which a text is toxic rather than not.
    chosen = np.flatnonzero((prior * rate_p > 0.5 * rate_u) & (surprise > LEAST_SURPRISE))
    if len(chosen) > most:
        chosen = np.sort(chosen[np.argsort(-surprise[chosen], kind="stable")[:most]])
    chosen = covering(rows_p, np.searchsorted(candidates, values_p), chosen, n_p)
    features = candidates[chosen]

    def matrix(rows, values):
        at = np.searchsorted(features, values)
        ok = at < len(features)
        ok[ok] = features[at[ok]] == values[ok]
        return rows[ok], at[ok]

    p, u = matrix(rows_p, values_p), matrix(rows_u, values_u)
    w, b = np.zeros(len(features)), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))

    def margin(x, n):
        return np.bincount(x[0], w[x[1]], n) + b if len(x[0]) else np.full(n, b)

    def gradient(x, slope):
        return np.bincount(x[1], slope[x[0]], len(w)) if len(x[0]) else np.zeros(len(w)), slope.sum()

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    softplus = lambda z: np.logaddexp(0, z)
    m, v, m_b, v_b = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for step in range(1, steps + 1):
        g_p, g_u = margin(p, n_p if len(positive) else 0), margin(u, n_u if len(unlabelled) else 0)
        negative_risk = (softplus(g_u).sum() / n_u) - prior * (softplus(g_p).sum() / n_p)
        as_negative = gradient(u, sigmoid(g_u) / n_u), gradient(p, -prior * sigmoid(g_p) / n_p)
        if negative_risk >= 0:
            as_positive = gradient(p, -prior * sigmoid(-g_p) / n_p)
            d_w = as_positive[0] + as_negative[0][0] + as_negative[1][0] + 1e-5 * w
            d_b = as_positive[1] + as_negative[0][1] + as_negative[1][1]
        else:  # over-fitted: back
            d_w, d_b = -as_negative[0][0] - as_negative[1][0], -as_negative[0][1] - as_negative[1][1]
        m, v = 0.9 * m + 0.1 * d_w, 0.999 * v + 0.001 * d_w**2
        m_b, v_b = 0.9 * m_b + 0.1 * d_b, 0.999 * v_b + 0.001 * d_b**2
        rate = 0.1 / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * m_b / (np.sqrt(v_b / (1 - 0.999**step)) + 1e-8)
    # The scale of the score: the best F1 on positives kept apart and confirmed clean text lies
    # at the threshold.
    toxic = np.sort(margin(matrix(*flat(apart)), len(apart)) if apart else margin(p, n_p))
    clean = np.sort(margin(matrix(*flat(negative)), len(negative)) if negative else margin(u, n_u))
    margins = np.unique(np.concatenate((toxic, clean, [b])))
    cuts = np.append((margins[1:] + margins[:-1]) / 2, margins[-1] + 1)
    hit = prior * (1 - np.searchsorted(toxic, cuts) / len(toxic))
    false = (1 - prior) * (1 - np.searchsorted(clean, cuts) / len(clean))
    f1 = 2 * hit / (hit + false + prior)
    best = cuts[f1 >= f1.max() - 1e-9]
    scale = 6 / max(1.0, float(np.median(toxic) - np.median(clean)))
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * (0.7 * best[0] + 0.3 * best[-1]))
    return features, w, b, scale, shift


def class_prior(labels: DataFrame) -> float:
    """Share of toxic among the labelled documents of the learning fold."""
    row = labels.agg(F.avg("toxic").alias("prior")).first()
    return float(row.prior or 0.0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    classifiers: int = 4,
    max_positive: int = 4_000,
    max_unlabelled: int = 12_000,
    max_negative: int = 4_000,
    folds: int = 3,
    held: int = 1,
) -> list[tuple]:
    """The trained classifiers, at most ``classifiers * 4096`` weights. ``docs``: doc_id, text;
    ``labels``: doc_id, toxic."""
    fold = fold_of(F.col("doc_id"), folds)
    labels = (
        labels.where((fold != held) & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return []
    prior = prior if prior is not None else counts[1] / sum(counts.values())
    n_docs = docs.count()

    def share(salt: int, most: int, n: int) -> Column:
        """True for about ``most`` of ``n`` rows, by a hash of the id."""
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))

    sample = labels.where(
        F.when(F.col("toxic") == 1, share(1, max_positive, counts[1])).otherwise(share(2, max_negative, counts.get(0, 0)))
    )
    # At most max_positive + max_negative rows, expected.
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .where(fold != held)
        .join(F.broadcast(sample), "doc_id", "left")
        .withColumn("u", share(3, max_unlabelled, n_docs))
        .where("toxic is not null or u")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(classifiers)).cast("int"))
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                rows = batch.slice(at, 200).to_pydict()
                for text, toxic, unlabelled, part in zip(rows["text"], rows["toxic"], rows["u"], rows["part"]):
                    found = document_features(text)
                    if toxic == 1:  # each classifier keeps its part of them apart
                        out += [(i, 3 if i == part else 1, found) for i in range(classifiers)]
                    if toxic == 0:
                        out.append((part, 0, found))
                    if unlabelled:
                        out.append((part, 2, found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in out], pa.int32()),
                        pa.array([r[1] for r in out], pa.int32()),
                        pa.array([r[2] for r in out], pa.list_(pa.int64())),
                    ],
                    names=["part", "kind", "features"],
                )

    def fit(key: tuple, groups: pa.Table) -> pa.Table:
        import numpy as np

        kinds = groups.column("kind").to_numpy()
        lists = groups.column("features").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        ends = ends - ends[0]
        # One order whatever the order of arrival.
        of = {k: sorted((values[ends[i] : ends[i + 1]] for i in np.flatnonzero(kinds == k)), key=lambda x: x.tobytes()) for k in (1, 2, 0, 3)}
        features, w, b, scale, shift = train(of[1], of[2], of[0], of[3], prior)
        return pa.table(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "features": pa.array([features], pa.list_(pa.int64())),
                "weights": pa.array([w], pa.list_(pa.float64())),
                "scalars": pa.array([[b, scale, shift]], pa.list_(pa.float64())),
            }
        )

    models = (
        rows.select("text", "toxic", "u", "part")
        .mapInArrow(extract, "part int, kind int, features array<long>")
        .groupBy("part")
        .applyInArrow(fit, "part int, features array<long>, weights array<double>, scalars array<double>")
        .collect()
    )
    return [(list(m.features), list(m.weights), *m.scalars) for m in sorted(models, key=lambda m: m.part)]


def scorer(models: list[tuple]):
    """A pandas UDF text -> score between 0 and 1."""
    weights: dict[int, list[float]] = {}
    for i, (features, w, *_) in enumerate(models):
        for f, x in zip(features, w):
            weights.setdefault(f, [0.0] * len(models))[i] = x

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        import math

        class Known(dict):
            """The features of a word that have a weight; most words have none."""

            def __missing__(self, word: str) -> tuple:
                if len(self) > 300_000:
                    self.clear()
                value = self[word] = tuple(h for f in features_of(word) if (h := hashed(f)) in weights)
                return value

        known = Known()
        found_in = known.__getitem__

        def one(text: str | None) -> float:
            if not models:
                return 0.0
            found: set[int] = set().union(*map(found_in, tokens(text)))
            total = 0.0
            for i, (_, _, b, scale, shift) in enumerate(models):
                z = scale * (b + math.fsum(weights[f][i] for f in found)) + shift
                total += 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
            return total / len(models)

        return pd.Series([one(t) for t in texts], dtype="float64")

    return score


def scored(docs: DataFrame, models: list[tuple], folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return docs.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        scorer(models)(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the learned classifiers reject."""
    models = learn(docs, labels)
    return docs.where(scorer(models)(F.col("text").cast("string")) < THRESHOLD)
