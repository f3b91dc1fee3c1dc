"""Mixing documents to target domain weights, in DataFrame expressions only.

Domains.  The labelled table names three: low quality, toxic and good.  Features of a text are its
distinct words (A-Z lower-cased, with the signs that hang on them), and of each its first four and its
last two characters.  Of a bounded sample of labelled rows, features that are so much likelier under
a label that none of all features would be by chance make up that label's lexicon, each with the
logarithm of its likelihood ratio as weight.  The sums of a text's weights for each label, its length
and how often its words repeat go into a softmax regression, fitted on the same sample; it gives the
text's posterior over the domains (its soft membership).

Rates.  With tokens t_d and posteriors p_dk, document rates r_d >= 0 give domain k an expected
sum_d r_d t_d p_dk tokens.  Projected gradient descent fits the rates to target totals by least
squares, in the variables r sqrt(t), so that a token of a long document weighs as much as one of a
short one.  A step needs a few sums over all documents (one aggregation) and moves every rate against
its own gradient, cut off at zero: r becomes max(0, r - p . s) with three numbers s.  It begins at the
solution for a sketch, the sums of the documents in the cells of a grid of posteriors, so that few
steps over all documents are left.  A rate is therefore an expression of its document's posterior
alone, whatever the number of documents.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, let

DOMAINS = ("low", "toxic", "good")
#: target share of expected tokens of each domain
TARGETS = {"low": 0.05, "toxic": 0.01, "good": 0.94}
#: The classifier is fitted on at most so many labelled documents, by hash of the id.
SAMPLE = 6_000
#: features of a label's lexicon at most, the strongest first
TERMS = 512
#: a feature is in so many texts of its label at least, and so many times likelier there
LEAST = 4
RATIO = 5.0
#: chance that any feature of a lexicon is there by accident
ACCIDENT = 0.01
#: slots of the table that features are looked up in
SLOTS = 1 << 15
#: cells of the sketch along each posterior
GRID = 64
#: largest error of a domain's total, as a share of all tokens
TOLERANCE = 1e-4
#: steps go on while they lower the error by a fifth in so many
PATIENCE = 10
_LABELS = ("low", "toxic")


def words_of(text: Column) -> Column:
    """Words between spaces and line ends, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _features(words: Column) -> Column:
    """Hashes of distinct words, of their first four and of their last two characters."""
    return F.concat(
        F.transform(words, lambda w: F.xxhash64(w)),
        F.transform(words, lambda w: F.xxhash64(F.lit(4), F.substring(w, 1, 4))),
        F.transform(words, lambda w: F.xxhash64(F.lit(2), F.substring(w, -2, 2))),
    )


def _numbers(values, kind: str) -> Column:
    """A constant array; one string of the plan in place of thousands of literals."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _adding(weights: Column):
    return lambda total, slot: total + F.get(weights, slot)


@dataclass(frozen=True)
class Classifier:
    #: the feature of each slot, and its weights for low quality and toxic; 0 where a slot is free
    table: tuple[int, ...]
    weights: tuple[tuple[float, ...], tuple[float, ...]]
    #: softmax coefficients of low and toxic against good: constant, both sums, length, repetition
    slopes: tuple[tuple[float, ...], tuple[float, ...]]

    def evidence(self, text: Column) -> Column:
        """struct(n: words, d: distinct words, low, toxic: sums of weights)."""
        slot = lambda h: h.bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int")
        table, weights = _numbers(self.table, "bigint"), [_numbers(w, "double") for w in self.weights]
        known = lambda hs: F.transform(F.filter(hs, lambda h: F.get(table, slot(h)) == h), slot)

        def summed(words: Column, distinct: Column, slots: Column) -> Column:
            sums = [F.aggregate(slots, F.lit(0.0), _adding(w)).alias(k) for k, w in zip(_LABELS, weights)]
            return F.struct(F.size(words).cast("long").alias("n"), F.size(distinct).cast("long").alias("d"), *sums)

        return let(words_of(text), lambda w: let(F.array_distinct(w), lambda u: let(known(_features(u)), lambda s: summed(w, u, s))))


def _inputs(e: str) -> list[Column]:
    """The numbers of the regression, from evidence."""
    n, d = F.col(f"{e}.n"), F.col(f"{e}.d")
    return [F.log1p(f"{e}.low"), F.log1p(f"{e}.toxic"), F.log1p(n), F.log((n + 1) / (d + 1))]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Labels, domain and text of the sample.  Several labels of an id: toxic before low before good."""
    named = (
        labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
        .groupBy(id_col)
        .agg(F.coalesce(F.max("toxic") > 0, F.lit(False)).alias("_toxic"), F.coalesce(F.min("quality") == 0, F.lit(False)).alias("_low"))
        .select(id_col, "_toxic", "_low", F.when(F.col("_toxic"), 1).when(F.col("_low"), 0).otherwise(2).alias("_k"))
        .orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
        .limit(SAMPLE)
    )
    # bounded by SAMPLE
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(named), id_col).select("_toxic", "_low", "_k", "_t")


def _lexicon(sample: DataFrame) -> tuple[list[int], list[list[float]]]:
    """The table of features and their weights for each label."""
    hashed = sample.select(*[F.col(f"_{k}").cast("int").alias(k) for k in _LABELS], _features(F.array_distinct(words_of(F.col("_t")))).alias("_h"))
    size = F.size("_h").cast("long")
    everything, *of_label = (float(x or 0) for x in hashed.agg(F.sum(size), *[F.sum(size * F.col(k)) for k in _LABELS]).first())
    # a feature counts for its text once as d and for each word that has it as n
    each = F.concat(
        F.transform("_h", lambda h: F.struct(h.alias("h"), F.lit(0).alias("d"), F.lit(1).alias("n"))),
        F.transform(F.array_distinct("_h"), lambda h: F.struct(h.alias("h"), F.lit(1).alias("d"), F.lit(0).alias("n"))),
    )
    rows = hashed.select(*_LABELS, F.explode(each).alias("e")).select(*_LABELS, "e.h", "e.d", "e.n")
    counts = [F.sum(F.col(x) * F.col(k)).cast("double").alias(f"{x}_{k}") for k in _LABELS for x in "dn"]
    seen = checkpointed(rows.groupBy("h").agg(F.sum("n").cast("double").alias("n"), *counts).where(" or ".join(f"d_{k} >= {LEAST}" for k in _LABELS)))
    best: dict[int, tuple[float, int, dict[str, float]]] = {}
    for k, whole in zip(_LABELS, of_label):
        if not 0 < whole < everything:
            continue
        share = whole / everything
        mine, other = F.col(f"n_{k}"), F.col("n") - F.col(f"n_{k}")
        ratio = F.log((mine + 0.5) / whole) - F.log((other + 0.5) / (everything - whole))
        gain = mine * F.log(mine / F.col("n") / share) + F.when(other > 0, other * F.log(other / F.col("n") / (1 - share))).otherwise(0.0)
        found = seen.where(F.col(f"d_{k}") >= LEAST)
        sure = math.log(max(found.count(), 1) / ACCIDENT)
        chosen = found.select("h", gain.alias("g"), ratio.alias("w")).where((F.col("g") >= sure) & (F.col("w") >= math.log(RATIO)))
        # TERMS rows at most
        for r in chosen.orderBy(F.col("g").desc(), "h").limit(TERMS).collect():
            slot = r["h"] & (SLOTS - 1)
            there = best.get(slot)
            if there and there[1] == r["h"]:
                there[2][k] = r["w"]
            elif there is None or there[0] < r["g"]:
                best[slot] = (r["g"], r["h"], {k: r["w"]})
    table, weights = [0] * SLOTS, [[0.0] * SLOTS for _ in _LABELS]
    for slot, (_, h, w) in best.items():
        table[slot] = h
        for i, k in enumerate(_LABELS):
            weights[i][slot] = w.get(k, 0.0)
    return table, weights


def _softmax_fit(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Ridge softmax regression of low and toxic against good, by Newton's method.

    Each domain has one text without any evidence beside the sample's, so that none is impossible.
    """
    x = np.vstack([np.column_stack([np.ones(len(x)), x]), np.repeat([[1.0, *np.zeros(x.shape[1])]], 3, axis=0)])
    k = np.r_[k, 0, 1, 2]
    m = x.shape[1]
    w, ridge = np.zeros(2 * m), np.tile(np.r_[1e-3, np.full(m - 1, 1e-2)], 2)
    for _ in range(200):
        z = np.column_stack([x @ w[:m], x @ w[m:], np.zeros(len(x))])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = np.concatenate([x.T @ (p[:, j] - (k == j)) for j in range(2)]) + ridge * w
        h = np.block([[(x.T * (p[:, i] * ((i == j) - p[:, j]))) @ x for j in range(2)] for i in range(2)])
        step = np.linalg.solve(h + np.diag(ridge + 1e-6), g)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w.reshape(2, m)


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Lexicons and regression of the sample; without labels all coefficients are 0."""
    sample = checkpointed(_labelled(docs, labels, id_col, text_col))
    table, weights = _lexicon(sample)
    draft = Classifier(tuple(table), (tuple(weights[0]), tuple(weights[1])), ((0.0,) * 5, (0.0,) * 5))
    # a few numbers of each text of the sample
    rows = sorted(tuple(r) for r in sample.select("_k", draft.evidence(F.col("_t")).alias("_e")).select("_k", *_inputs("_e")).collect())
    if not rows:
        return draft
    fitted = _softmax_fit(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows]))
    return Classifier(draft.table, draft.weights, tuple(tuple(map(float, w)) for w in fitted))


def memberships(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, then tokens (words) and p_low, p_toxic, p_good, which add up to 1.

    A null or empty text has no tokens, and the membership of a text without any evidence; without
    labels every membership is uniform.
    """
    model = classifier(docs, labels, id_col, text_col)
    scored = docs.select("*", model.evidence(F.col(text_col)).alias("_s"))
    logit = [sum((F.lit(w) * x for w, x in zip(ws[1:], _inputs("_s"))), F.lit(ws[0])) for ws in model.slopes]
    scored = scored.select("*", *[F.exp(F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))).alias(f"_e{k}") for k, z in enumerate(logit)])
    whole = F.col("_e0") + F.col("_e1") + 1.0
    shares = [(e / whole).alias(f"p_{k}") for e, k in zip((F.col("_e0"), F.col("_e1"), F.lit(1.0)), DOMAINS)]
    return scored.select("*", F.col("_s.n").alias("tokens"), *shares).drop("_s", "_e0", "_e1")


@dataclass(frozen=True)
class Rates:
    """Fitted rates, as the steps that lead to them from 1, and the largest error of a domain's total."""

    steps: tuple[tuple[float, ...], ...]
    gap: float

    def column(self) -> Column:
        """The rate of a row with tokens and p_...; 1 where there are no tokens, as these change nothing."""
        rate = F.lit(1.0)
        for s in self.steps:
            rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p_{d}") * F.lit(x) for d, x in zip(DOMAINS, s)), F.lit(0.0)))
        return F.when(F.col("tokens") > 0, rate).otherwise(1.0)


def _sketched(cells: np.ndarray, products: np.ndarray, tokens: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The step s for which max(0, 1 - p . s) meets the goal on the cells' mean posteriors."""
    p = cells / tokens[:, None]
    k = len(goal)
    floor = 1e-9 * tokens.sum() * np.eye(k)
    safe, s = np.linalg.inv(products.sum(axis=0) + floor), np.zeros(k)
    best, gap, metric = s, np.inf, safe
    for _ in range(2000):
        rate = np.maximum(0.0, 1.0 - p @ s)
        error = rate @ cells - goal
        now = np.abs(error).max() / tokens.sum()
        if now < gap:
            best, metric = s, np.linalg.inv(products[rate > 0].sum(axis=0) + floor) if now < 0.5 * gap else safe
            gap = now
        else:
            metric = safe
        if gap <= 0.01 * TOLERANCE:
            break
        s = s + metric @ error
    return best


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None) -> Rates:
    """Rates for a table of tokens and p_... that is read once for each step.

    targets are weights of the domains; the target totals are their shares of all tokens.  Should no
    rates meet the targets, or steps no longer bring them nearer, the nearest found are returned, a
    warning says so and ``gap``, the largest error as a share of all tokens, is beyond TOLERANCE.
    """
    weights = targets or TARGETS
    share = np.array([weights[d] for d in DOMAINS], float)
    share = share / share.sum()
    ps, t, k = [F.col(f"p_{d}") for d in DOMAINS], F.col("tokens").cast("double"), len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cell = F.floor(ps[0] * GRID) * (GRID + 1) + F.floor(ps[1] * GRID)
    # GRID x GRID rows at most
    rows = members.where(t > 0).groupBy(cell.alias("c")).agg(F.sum(t), *[F.sum(t * p) for p in ps], *[F.sum(t * ps[i] * ps[j]) for i, j in pairs]).collect()
    if not rows:
        return Rates((), 0.0)
    got = np.array(sorted(tuple(r) for r in rows), float)
    tokens, cells, products = got[:, 1], got[:, 2 : 2 + k], np.zeros((len(got), k, k))
    for (i, j), column in zip(pairs, got[:, 2 + k :].T):
        products[:, i, j] = products[:, j, i] = column
    everything = tokens.sum()
    goal, floor = share * everything, 1e-9 * everything * np.eye(k)
    safe = np.linalg.inv(products.sum(axis=0) + floor)
    steps, gaps, best = [_sketched(cells, products, tokens, goal)], [], (np.inf, ())
    while True:
        now = tuple(tuple(map(float, s)) for s in steps)
        rate = Rates(now, 0.0).column()
        sums = members.where(t > 0).select("*", rate.alias("_r")).agg(
            *[F.sum(F.col("_r") * t * p) for p in ps], *[F.sum(F.when(F.col("_r") > 0, t * ps[i] * ps[j]).otherwise(0.0)) for i, j in pairs]
        ).first()
        error = np.array(sums[:k], float) - goal
        gaps.append(float(np.abs(error).max() / everything))
        best = min(best, (gaps[-1], now))
        if gaps[-1] <= TOLERANCE:
            break
        if len(gaps) > PATIENCE and best[0] > 0.8 * min(gaps[:-PATIENCE]):
            warnings.warn(f"domain totals miss their targets by {best[0]:.2e} of all tokens", stacklevel=2)
            break
        # the metric of the documents that can still move; the safe one after a step that overshot
        active = np.zeros((k, k))
        for (i, j), x in zip(pairs, sums[k:]):
            active[i, j] = active[j, i] = x
        near = len(gaps) < 2 or gaps[-1] < 0.9 * gaps[-2]
        steps.append((np.linalg.inv(active + floor) if near else safe) @ error)
    return Rates(best[1], best[0])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row (ids of any type): id, tokens, p_low, p_toxic, p_good, rate, and gap of the fit.

    Repeated rows each get a row and a rate of their own, the same for each; null and empty texts
    have no tokens and the rate 1; without labels every membership is uniform.
    """
    members = memberships(docs.select(id_col, text_col), labels.select(id_col, "quality", "toxic"), id_col, text_col)
    members = checkpointed(members.drop(text_col))
    rates = fit_rates(members, targets)
    return members.select("*", rates.column().alias("rate"), F.lit(rates.gap).alias("gap"))
