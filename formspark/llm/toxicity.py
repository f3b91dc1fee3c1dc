"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, weighed by context windows.

Lexicon.  Terms are learned from a bounded, documented sample of labelled texts (never from the
held-out third).  Candidates are words and word beginnings.  A candidate counts once for each
neighbourhood it stands in, so that the ordinary words of a copied passage, which have the same
neighbours in every copy, find no support.  It becomes a term if it is so much more frequent in toxic
texts that none of all candidates would be by chance.  A term is a whole word, or a stem that any
ending may follow; frequent words with a short stem, which must match exactly, are terms too and belong
to the stem's family.

Matching.  The terms form a trie.  Each distinct word is run through it by the bit-parallel form of
its Levenshtein automaton: state sets for 0, 1 and 2 errors advance along the trie's edges, and a
branch is left as soon as all are empty.  Short terms must match exactly.

Context.  Each match looks at a window of words around it: signs of quotation (quote marks, reporting
words, a quoted line) lower its weight, signs of address (second person) raise it.

Evidence.  A family's exact matches, and apart from them its misspelled ones, are compared with those
that a clean text of that length has by chance, at the rate of the sample's clean texts: the evidence
is the Poisson deviance.  A stem that clean texts have now and then says little once in a long text and
much if it comes often; a misspelling that clean texts never have says nearly as much as the term, one
that is an ordinary word says nothing.  A logistic model of two sums, the evidence of families that clean
texts do not have and of the others, gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: The classifier is fitted on at most so many toxic and so many other labelled texts, by hash of the id.
TOXIC_SAMPLE = 2_000
OTHER_SAMPLE = 6_000
THRESHOLD = 0.7
#: word beginnings of this many characters can become stems
STEMS = range(3, 13)
#: a term is in so many toxic texts at least, and so many times likelier a word of them
LEAST = 4
RATIO = 5.0
#: chance that any term of the lexicon is there by accident
ACCIDENT = 0.01
#: occurrences in one text count up to this many
MOST = 8
#: matches look at so many words on either side
WINDOW = 6
QUOTED, ADDRESSED = 0.15, 1.5
#: share of a match by its errors
SHARES = (1.0, 0.9, 0.8)
#: what one quoted and one misspelled plain match come to; the fit counts each as so large a share of the sample
QUOTED_EVIDENCE, PLAIN_EVIDENCE, BELIEF = 2.5, 4.0, 0.01
#: chance matches come in clumps, as texts of one language or subject have them all: so many times the mean rate
CLUMPS = 8.0
#: a toxic text that is missed weighs as much in the fit as so many false alarms
MISSED = 3.0
#: parts of words that a Python worker counts before it sends them on
PARTS = 400_000
#: distinct words whose matches a Python worker keeps; a full table is dropped and begun again
CACHE = 250_000

WORD = re.compile(r"[^\W_]+")
LEET = str.maketrans("013457", "oieast")
QUOTES = re.compile("[\"“”„«»‹›]")
REPORTING = frozenset("said says saying called calls quote quoted quotes wrote writes word words term dit disent mot mots dijo dice palabra sagte sagt wort wörter".split())
SECOND = frozenset("you your yours youre u ur du dich dir dein deine tu te toi ton vous usted tú ti".split())


def errors_allowed(term: str, stem: bool) -> int:
    if stem:
        return 1 if len(term) >= 6 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Trie:
    """Terms with the errors they allow; a node is [children, its terms]."""

    #: term: whether it is a stem; or pairs of both, where a stem is also a word of its own
    terms: dict[str, bool] | tuple[tuple[str, bool], ...]
    root: list = field(init=False)

    def __post_init__(self):
        self.root = [{}, []]
        pairs = self.terms.items() if isinstance(self.terms, dict) else self.terms
        allowed = {(t, s): errors_allowed(t, s) for t, s in pairs}
        for (term, stem), k in allowed.items():
            node = self.root
            for c in term:
                node = node[0].setdefault(c, [{}, []])
            node[1].append((term, stem, k))
        self.most = max(allowed.values(), default=0)
        # k errors leave one of k + 1 pieces of a term as it is, shifted by k at most
        self.pieces: dict[str, list[tuple[int, int, int, float]]] = {}
        for (t, stem), k in allowed.items():
            for i in range(k + 1):
                a, z = len(t) * i // (k + 1), len(t) * (i + 1) // (k + 1)
                place = (a - k, a + k, len(t) - k, math.inf if stem else len(t) + k)
                of = self.pieces.setdefault(t[a:z], [])
                if place not in of:
                    of.append(place)
        self.sizes = sorted({len(p) for p in self.pieces})

    def may_match(self, word: str) -> bool:
        """Whether a piece of a term is at its place in the word; without one no term accepts it."""
        n, get = len(word), self.pieces.get
        for size in self.sizes:
            for at in range(n - size + 1):
                places = get(word[at : at + size])
                if places and any(a <= at <= z and least <= n <= most for a, z, least, most in places):
                    return True
        return False

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest errors that accepts the word, and its errors; ties: the longest, then the first."""
        if not self.may_match(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        n, k = len(word), self.most
        full, whole = (1 << (n + 1)) - 1, 1 << n
        best = None
        # level j holds which prefixes of the word are within j errors of the path so far
        stack = [(self.root, tuple((1 << (j + 1)) - 1 & full for j in range(k + 1)))]
        while stack:
            node, levels = stack.pop()
            for c, child in node[0].items():
                mask = masks.get(c, 0)
                now, before = [], 0
                for j, r in enumerate(levels):
                    x = r << 1 & mask
                    if j:
                        x |= levels[j - 1] << 1 | levels[j - 1] | before << 1
                    before = x & full
                    now.append(before)
                if not before:
                    continue
                for term, stem, allowed in child[1]:
                    for j in range(allowed + 1):
                        if now[j] if stem else now[j] & whole:
                            rank = (j, -len(term), term)
                            if best is None or rank < best:
                                best = rank
                            break
                if child[0]:
                    stack.append((child, tuple(now)))
        return (best[2], best[0]) if best else None


class Matcher(dict):
    """Matches of words, kept as they are asked for; ordinary words are no misspellings."""

    def __init__(self, trie: Trie, ordinary: frozenset[str] = frozenset()):
        super().__init__()
        self.trie, self.ordinary = trie, ordinary

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        plain = word if word.isalpha() else word.translate(LEET)
        hit = self.trie.match(plain)
        if hit and hit[1] and word in self.ordinary:
            hit = None
        self[word] = hit
        return hit


def matches(text: str, matcher: Matcher) -> tuple[int, list[tuple[str, str, int, float]]]:
    """How many words a text has, and its matches (word, term, errors, weight by context)."""
    low = text.lower()
    words = WORD.findall(low)
    hits = [i for i, m in enumerate(map(matcher.__getitem__, words)) if m]
    if not hits:
        return len(words), []
    spans = [m.span() for m in WORD.finditer(low)]
    out = []
    for i in hits:
        term, errors = matcher[words[i]]
        a, z = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[z - 1][1] + 2]
        line = low[low.rfind("\n", 0, spans[i][0]) + 1 : spans[i][0]].lstrip()
        around = set(words[a:z])
        weight = 1.0
        if line.startswith(">") or (QUOTES.search(before) and QUOTES.search(after)) or around & REPORTING:
            weight *= QUOTED
        if around & SECOND:
            weight *= ADDRESSED
        out.append((words[i], term, errors, weight))
    return len(words), out


def surprise(n: float, by_chance: float) -> float:
    """Poisson deviance (half) of so many matches where so many are by chance; no more than these: 0."""
    return n * math.log(n / by_chance) - (n - by_chance) if n > by_chance else 0.0


def counted(hits: list[tuple[str, str, int, float]], families: dict[str, str]) -> dict[tuple[str, bool], float]:
    """Weighed matches of each family, exact and misspelled; a word that is repeated gains with the logarithm."""
    weights: dict[tuple[str, bool], dict[str, list[float]]] = {}
    for word, term, errors, weight in hits:
        weights.setdefault((families[term], errors > 0), {}).setdefault(word, []).append(weight * SHARES[errors])
    return {key: sum(max(x) * (1 + math.log(len(x))) for x in words.values()) for key, words in weights.items()}


@dataclass(frozen=True)
class Model:
    #: term, whether it is a stem, and its family
    terms: tuple[tuple[str, bool, str], ...]
    #: words that look like misspellings of a term and are none
    ordinary: tuple[str, ...]
    #: family, and the matches a word of a clean text is by chance: exact, misspelled
    rates: tuple[tuple[str, float, float], ...]
    #: constant, and the slopes of the evidence of precise and of other families
    weights: tuple[float, float, float]

    def matcher(self) -> Matcher:
        return Matcher(Trie(tuple((t, s) for t, s, _ in self.terms)), frozenset(self.ordinary))

    @cached_property
    def families(self) -> dict[str, str]:
        return {t: f for t, _, f in self.terms}

    @cached_property
    def by_chance(self) -> dict[tuple[str, bool], float]:
        return {(f, wrong): r for f, *both in self.rates for wrong, r in zip((False, True), both)}

    @cached_property
    def precise(self) -> frozenset[tuple[str, bool]]:
        """Families, exact or misspelled, that no clean text of the sample has."""
        least = min(self.by_chance.values(), default=0.0)
        return frozenset(k for k, r in self.by_chance.items() if r <= 1.1 * least)

    def evidence(self, n_words: int, hits: list[tuple[str, str, int, float]]) -> tuple[float, float]:
        """Evidence of precise families and of the others."""
        out = [0.0, 0.0]
        for key, n in sorted(counted(hits, self.families).items()):
            plain = key in self.precise
            out[not plain] += surprise(n, n_words * self.by_chance[key] * (1.0 if plain else CLUMPS))
        return out[0], out[1]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Scores of rows of evidence."""
        x = np.log1p(np.asarray(evidence, float).reshape(-1, 2))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -60, 60)))


Part = tuple[str, bool]


def _parts(words: Counter) -> dict[Part, int]:
    """Words (False) and word beginnings (True), and how often each is there, up to MOST times."""
    out: Counter = Counter()
    for w, n in words.items():
        out[w, False] += n
        for k in STEMS:
            if len(w) >= k:
                out[w[:k], True] += n
    return {p: min(n, MOST) for p, n in out.items()}


def _counts(texts: DataFrame, wanted: frozenset | None, least: int) -> dict[Part, tuple[int, int]]:
    """In how many texts each part is and how often, of the wanted ones or those in at least so many texts."""

    def sent(seen: dict) -> pd.DataFrame:
        return pd.DataFrame([(w, s, d, n) for (w, s), (d, n) in seen.items()], columns=["part", "stem", "d", "n"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for batch in batches:
            for text in batch["_t"]:
                for p, n in _parts(Counter(WORD.findall(text.lower()))).items():
                    if wanted is None or p in wanted:
                        d, m = seen.get(p, (0, 0))
                        seen[p] = (d + 1, m + n)
                if len(seen) >= PARTS:
                    yield sent(seen)
                    seen = {}
        yield sent(seen)

    counted = texts.select("_t").mapInPandas(count, "part string, stem boolean, d long, n long").groupBy("part", "stem").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return {(r["part"], r["stem"]): (r["d"], r["n"]) for r in counted.where(F.col("d") >= least).toLocalIterator()}


def _neighbourhoods(good: dict[Part, int]):
    """Of each text the good parts of its words with the three words before and after, up to MOST times each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for text in batch["_t"]:
                words, seen, got = WORD.findall(text.lower()), Counter(), []
                threes = [zlib.crc32(" ".join(words[max(i, 0) : i + 3]).encode()) for i in range(-3, len(words) + 1)]
                for i, w in enumerate(words):
                    if w not in known:
                        known[w] = [good[p] for p in ((w, False), *((w[:k], True) for k in STEMS)) if p in good and len(p[0]) <= len(w)]
                    for p in known[w]:
                        if seen[p] < MOST:
                            seen[p] += 1
                            got.append((p, threes[i], threes[i + 4]))
                rows.append([[x[k] for x in got] for k in range(3)])
            yield pd.DataFrame(rows, columns=["parts", "before", "after"])

    return run


def _gain(n: float, others: float, share: float) -> float:
    """Log likelihood ratio of a part's occurrences in toxic and other texts against the share of toxic words."""
    whole = n + others
    if n <= share * whole:
        return 0.0
    return n * math.log(n / whole / share) + (others * math.log(others / whole / (1 - share)) if others else 0.0)


def learn_terms(support: dict[Part, tuple[int, int]], others: dict[Part, tuple[int, int]], words: tuple[int, int], tested: int) -> list[tuple[str, bool, str]]:
    """Terms with their families, the strongest family first.

    support: in how many toxic texts a part is, and in how many neighbourhoods; others: the same of the
    other texts, by occurrences; words: of toxic and of other texts; tested: candidates there were.
    """
    share = words[0] / sum(words)
    gains = {}
    for p, (d, n) in support.items():
        m = others.get(p, (0, 0))[1]
        if d >= LEAST and n >= LEAST and n * words[1] >= RATIO * (m + 0.5) * words[0] and (g := _gain(n, m, share)) >= math.log(max(tested, 1) / ACCIDENT):
            gains[p] = g
    terms, left = [], set(gains)
    while left:
        best = max(left, key=lambda p: (gains[p], not p[1], len(p[0]), p[0]))
        # of word and beginnings that say the same, the whole word, else the longest beginning
        near = [p for p in left if gains[p] >= 0.97 * gains[best] and (p[0].startswith(best[0]) or best[0].startswith(p[0]))]
        best = max(near, key=lambda p: (not p[1], len(p[0]), p[0]))
        terms.append((*best, best[0]))
        if best[1] and not errors_allowed(*best):
            terms += [(w, False, best[0]) for w, stem in sorted(gains) if not stem and w.startswith(best[0])]
        left = {p for p in left if not (p[0].startswith(best[0]) or best[0].startswith(p[0]))}
    return terms


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression of the evidence by Newton's method; slopes are never negative.

    What a quoted and what a plain match of a precise term come to stand in the sample as well, as a
    belief that data can outweigh, so that the score tells them apart where no labelled text has either.
    """
    belief = max(1.0, BELIEF * len(x))
    x, y = np.vstack([x, [[QUOTED_EVIDENCE, 0.0], [PLAIN_EVIDENCE, 0.0]]]), np.r_[y, 0.0, 1.0]
    a, m = np.column_stack([np.ones(len(x)), np.log1p(x)]), np.r_[np.where(y[:-2] > 0, MISSED, 1.0), belief, belief]
    w, ridge, use = np.zeros(3), np.array([1e-3, 1e-2, 1e-2]), [0, 1, 2]
    for _ in range(2):
        w[:] = 0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a[:, use].T @ (m * (p - y)) + ridge[use] * w[use]
            step = np.linalg.solve((a[:, use].T * (m * p * (1 - p))) @ a[:, use] + np.diag(ridge[use] + 1e-6), g)
            w[use] -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        use = [k for k in use if k == 0 or w[k] > 0]
    w[[k for k in range(3) if k not in use]] = 0
    return float(w[0]), float(w[1]), float(w[2])


def held_out(id_col: str = "doc_id"):
    """The third of ids that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn terms and weights from labelled rows that are not held out.

    Labels that are null are ignored; of several labels of an id the largest counts.  Without toxic
    or without other rows there are no terms, and every score is the smoothed share of toxic rows.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    named = named.groupBy(id_col).agg((F.max(label_col) > 0).alias("_y"))
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    taken = named.where("_y").orderBy(*order).limit(TOXIC_SAMPLE).unionAll(named.where(~F.col("_y")).orderBy(*order).limit(OTHER_SAMPLE))
    # the sample is bounded by its two limits, so it may be broadcast
    sample = small_batches(docs).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(taken), id_col).select("_t", "_y")
    sample = checkpointed(sample.distinct())
    toxic, clean = sample.where("_y").select("_t"), sample.where("not _y").select("_t")
    n_toxic, n_clean = toxic.count(), clean.count()
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    nothing = Model((), (), (), (float(np.log(share / (1 - share))), 0.0, 0.0))
    if not n_toxic or not n_clean:
        return nothing
    # the driver gets counts of parts that LEAST toxic texts have, and neighbourhoods of those that are left
    wanted = _counts(toxic, None, LEAST)
    others = _counts(clean, frozenset(wanted), 1)
    words = tuple(int(t.mapInPandas(_sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) for t in (toxic, clean))
    if not all(words):
        return nothing
    good = [p for p, (_, n) in sorted(wanted.items()) if n * words[1] >= RATIO * (others.get(p, (0, 0))[1] + 0.5) * words[0]]
    terms = learn_terms(_support(toxic, good), others, words, len(wanted))
    if not terms:
        return nothing

    draft = Model(tuple(terms), (), (), nothing.weights)
    rows = sample.mapInPandas(_measured(draft), MEASURED).collect()
    # a word that several clean texts have is no misspelling
    blamed = Counter(w for r in rows if not r["y"] for w in {h["word"] for h in r["hits"] if h["errors"]})
    ordinary = frozenset(w for w, n in blamed.items() if n > 1)
    measured = []
    for r in rows:
        hits = [tuple(h) for h in r["hits"] if not (h["errors"] and h["word"] in ordinary)]
        measured.append((r["n_words"], hits, float(r["y"])))
    chance: Counter = Counter()
    for _, hits, y in measured:
        if not y:
            chance.update(counted([(w, t, e, 1.0) for w, t, e, _ in hits], draft.families))
    rates = tuple((f, *((chance[f, wrong] + 0.5) / words[1] for wrong in (False, True))) for f in sorted({f for *_, f in terms}))
    model = Model(draft.terms, tuple(sorted(ordinary)), rates, nothing.weights)
    x = np.array([model.evidence(n, hits) for n, hits, _ in measured])
    y = np.array([y for *_, y in measured])
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    return replace(model, weights=_fit(x[order], y[order]))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"n": [len(WORD.findall(t)) for t in batch["_t"]]})


def _support(toxic: DataFrame, good: list[Part]) -> dict[Part, tuple[int, int]]:
    """In how many toxic texts, and in how many neighbourhoods, each part is.

    A neighbourhood is new if the three words before and the three after are both new; the copies of
    a passage count as one text.
    """
    before, after, texts = defaultdict(set), defaultdict(set), Counter()
    names = {p: i for i, p in enumerate(good)}
    held = toxic.mapInPandas(_neighbourhoods(names), "parts array<int>, before array<long>, after array<long>").orderBy("parts", "before", "after")
    for r in held.toLocalIterator():
        fresh = set()
        for p, b, a in zip(r["parts"], r["before"], r["after"]):
            if b not in before[p] and a not in after[p]:
                fresh.add(p)
            before[p].add(b)
            after[p].add(a)
        texts.update(fresh)
    return {p: (texts[i], min(len(before[i]), len(after[i]))) for p, i in names.items()}


MEASURED = "y boolean, n_words long, hits array<struct<word: string, term: string, errors: int, weight: double>>"


def _measured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for batch in batches:
            rows = [(y, *matches(text, matcher)) for text, y in zip(batch["_t"], batch["_y"])]
            yield pd.DataFrame(rows, columns=["y", "n_words", "hits"])

    return run


def score_texts(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, then score, predicted, n_matches and terms of every row, by the text alone.

    Null and empty texts have the score of a text without matches.
    """
    cache: list[Matcher] = []

    @F.pandas_udf("struct<score: double, n_matches: int, terms: string>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        if not cache:
            cache.append(_shared(model))
        got = [matches(t or "", cache[0]) for t in texts]
        scores = model.score(np.array([model.evidence(n, hits) for n, hits in got]))
        return pd.DataFrame({"score": scores, "n_matches": [len(h) for _, h in got], "terms": [",".join(sorted({t for _, t, *_ in h})) for _, h in got]})

    out = small_batches(docs).select(*keep, scored(F.col(text_col)).alias("_s"))
    return out.select(*keep, F.col("_s.score").alias("score"), (F.col("_s.score") >= THRESHOLD).cast("int").alias("predicted"), "_s.n_matches", "_s.terms")


_MATCHERS: dict[Model, Matcher] = {}


def _shared(model: Model) -> Matcher:
    """One table of matches for each model in a Python worker, over all its tasks."""
    if model not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[model] = model.matcher()
    return _MATCHERS[model]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, n_matches and terms.

    The model is learned from labelled rows that are not held out; a score depends on the text only.
    Repeated rows each get a row; a null id is not held out; other columns of docs are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    return score_texts(docs.withColumn("held_out", held_out(id_col)).select(id_col, "held_out", text_col), model, [id_col, "held_out"], text_col)
