"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts are sequences of words (lower-cased runs of letters, digits and characters beyond ASCII).  A
document is contaminated by an item of m words if some passage of it is within floor(0.2 m) word
edits of the item.

Windows.  For each item length m every window of m words is considered.  By the q-gram lemma a window
with such a passage shares at least m - 1 - 2k of its pairs of neighbouring words with items of
that length; windows with fewer cannot match and are left, without loss.

Candidates.  The CGK walk reads a window once while random bits, drawn by step and word, decide
whether to advance; equal words are read alike, so an edit shifts the walk only until both walks meet
again, and edit distance becomes Hamming distance of the walks.  Tables of sampled coordinates, over
several walks, give candidate pairs of window and item; the number of tables follows from the recall
wanted at the largest distance.  Every candidate is verified by the exact edit distance of the
item to all passages in and around the window.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import words

#: share of an item's words that may be edited
EDITS = 0.2
#: steps of a walk for each word of the item; a step advances every other time
STEPS = 2.2
#: tables over each walk, and the coordinates that a table samples
TABLES = 13
SAMPLES = 2
#: items whose tables every Python worker holds at a time; more items are done in blocks
ITEMS = 20_000
#: ... and characters of their texts
CHARACTERS = 8_000_000
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def allowed(m: int) -> int:
    return int(EDITS * m)


def least_pairs(m: int) -> int:
    """Pairs of words that the window at a passage's begin shares with an item it is within the allowed edits of.

    A deleted or replaced word costs the item two pairs, an inserted one a pair; a passage longer than
    the window by some insertions loses as many pairs again at its end: two an edit at most.
    """
    return max(1, m - 1 - 2 * allowed(m))


def walks(m: int) -> int:
    """Independent walks for items of m words.

    Deletions and insertions push a walk to one side, the further the longer the item, and fewer
    coordinates then agree.  Recall at the largest distance was measured as 1.0 of 200 passages a
    kind of edit with 8 walks for 40 to 200 words, and as 0.995 with 16 for 400.
    """
    return max(8, math.ceil(m / 20))


def embed(rows: np.ndarray, seed: int) -> np.ndarray:
    """CGK walks of rows of word hashes, zero behind the end."""
    n, m = rows.shape
    padded = np.concatenate([rows, np.zeros((n, 1), np.uint64)], axis=1)
    steps = np.random.default_rng(seed).integers(1, 2**63, int(STEPS * m), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((n, len(steps)), np.uint64)
    at, each = np.zeros(n, np.int64), np.arange(n)
    for j, step in enumerate(steps):
        symbol = padded[each, at]
        out[:, j] = symbol
        at = np.minimum(at + ((symbol * step) >> np.uint64(63)).astype(np.int64), m)
    return out


def tables(rows: np.ndarray) -> np.ndarray:
    """One key for each row and table; zero says nothing and matches nothing."""
    keys = []
    m = rows.shape[1]
    for walk in range(walks(m)):
        walked = embed(rows, 1000 + walk)
        rng = np.random.default_rng(7000 + 97 * walk + m)
        for t in range(TABLES):
            key = np.full(len(rows), np.uint64(walk * TABLES + t + 1))
            some = np.zeros(len(rows), bool)
            for j in rng.integers(0, int(STEPS * m), SAMPLES):
                key = (key ^ walked[:, j]) * np.uint64(0xA0761D6478BD642F)
                key ^= key >> np.uint64(31)
                some |= walked[:, j] != 0
            # behind their ends all walks are alike
            keys.append(np.where(some, key, np.uint64(0)))
    return np.stack(keys, axis=1)


def best_passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The fewest word edits from the item to any passage of the region, and the first end (exclusive) that has it."""
    peq: dict[int, int] = defaultdict(int)
    m = len(item)
    for i, w in enumerate(item.tolist()):
        peq[w] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for j, w in enumerate(region.tolist()):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Tables of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [t.lower().encode("utf-8", "replace") for _, t in items]
        by: dict[int, list[np.ndarray]] = defaultdict(list)
        for doc, _, _, h in words(texts):
            for d in np.unique(doc):
                by[int(d)].append(h[doc == d])
        self.ids, self.rows = [], []
        for d, parts in sorted(by.items()):
            self.ids.append(items[d][0])
            self.rows.append(np.concatenate(parts))
        lengths = sorted({len(r) for r in self.rows})
        #: lengths share 63 classes, in order
        self.classes = {m: k * 63 // max(len(lengths), 1) for k, m in enumerate(lengths)}
        self.lengths = lengths
        masks: dict[int, int] = defaultdict(int)
        singles = []
        for r in self.rows:
            if len(r) == 1:
                singles.append(r[0])
            for p in (r[:-1] * _PAIR + r[1:]).tolist():
                masks[p] |= 1 << self.classes[len(r)]
        self.pairs = np.array(sorted(masks), np.uint64)
        self.masks = np.array([masks[p] for p in self.pairs.tolist()], np.uint64)
        self.singles = np.unique(np.array(singles, np.uint64))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        self.longest = max(lengths, default=0)
        self.tables: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        for m in lengths:
            of = [i for i, r in enumerate(self.rows) if len(r) == m]
            keys = tables(np.stack([self.rows[i] for i in of]))
            self.tables[m] = []
            for column in keys.T.tolist():
                table = defaultdict(list)
                for i, key in zip(of, column):
                    if key:
                        table[key].append(i)
                self.tables[m].append((np.array(sorted(table), np.uint64), table))

    def pair_masks(self, pair: np.ndarray) -> np.ndarray:
        """For each pair of words the classes of lengths of the items that have it."""
        out = np.zeros(len(pair), np.uint64)
        maybe = np.flatnonzero(self.sieve[(pair >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.pairs):
            at = np.searchsorted(self.pairs, pair[maybe])
            at[at == len(self.pairs)] = 0
            hit = self.pairs[at] == pair[maybe]
            out[maybe[hit]] = self.masks[at[hit]]
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item index, edits, first byte, end byte) of the best passage of each text and item."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        rest: dict[int, list] = defaultdict(list)
        encoded = [t.lower().encode("utf-8", "replace") for t in texts]
        for doc, begin, end, h in words(encoded):
            if not len(doc):
                continue
            pair = np.zeros(len(h), np.uint64)
            pair[:-1] = h[:-1] * _PAIR + h[1:]
            mask = self.pair_masks(pair)
            keep = np.isin(h, self.singles) if len(self.singles) else np.zeros(len(h), bool)
            # pairs of any item, for windows of every length; a window that the block cuts off counts as it is
            total = np.zeros(len(h) + 1 + self.longest, np.int32)
            np.cumsum(mask != 0, out=total[1 : len(h) + 1])
            total[len(h) + 1 :] = total[len(h)]
            for m in self.lengths:
                if m > 1:
                    keep |= total[m - 1 : m - 1 + len(h)] - total[: len(h)] >= least_pairs(m)
            # a text cut into pieces is searched whole
            for d in sorted({*np.unique(doc[keep]).tolist(), int(doc[0]), int(doc[-1])}):
                o = slice(*np.searchsorted(doc, [d, d + 1]))
                rest[d].append((begin[o], end[o], h[o]))
        whole = {d: tuple(np.concatenate(x) for x in zip(*pieces)) for d, pieces in rest.items()}
        windows: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = defaultdict(list)
        for d, (begin, end, h) in whole.items():
            self._windows(d, begin, end, h, windows, found)
        for m, got in windows.items():
            of = np.concatenate([np.full(len(starts), d) for d, starts, _ in got])
            starts, rows = (np.concatenate(x) for x in zip(*((s, r) for _, s, r in got)))
            for (d, i), at in self._candidates(m, of, starts, rows).items():
                self._verify(d, i, at, *whole[d], found)
        return [(d, i, *best) for (d, i), best in sorted(found.items())]

    def _windows(self, d, begin, end, h, windows, found) -> None:
        """The windows of one text that share enough pairs of words with items of their length."""
        n = len(h)
        mask = self.pair_masks(h[:-1] * _PAIR + h[1:]) if n > 1 else np.zeros(0, np.uint64)
        padded = np.concatenate([h, np.zeros(self.longest, np.uint64)])
        for m in self.lengths:
            if m == 1:
                for i, r in enumerate(self.rows):
                    if len(r) == 1 and len(at := np.flatnonzero(h == r[0])):
                        found[d, i] = (0, int(begin[at[0]]), int(end[at[0]]))
                continue
            if n < m - allowed(m):
                continue
            flags = (mask >> np.uint64(self.classes[m])) & np.uint64(1)
            total = np.r_[0, np.cumsum(flags.astype(np.int64))]
            # a passage may begin so late that its window reaches beyond the text
            starts = np.arange(max(n - m + allowed(m), 0) + 1)
            got = total[np.minimum(starts + m - 1, n - 1)] - total[np.minimum(starts, n - 1)]
            starts = starts[got >= least_pairs(m)]
            if len(starts):
                windows[m].append((d, starts, padded[starts[:, None] + np.arange(m)]))

    def _candidates(self, m, of, starts, rows) -> dict[tuple[int, int], list[int]]:
        """Windows that share a key with an item, by text and item."""
        out: dict[tuple[int, int], list[int]] = defaultdict(list)
        for a in range(0, len(rows), 20_000):
            keys = tables(rows[a : a + 20_000])
            for t, (known, table) in enumerate(self.tables[m]):
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, keys[:, t]), len(known) - 1)
                for w in np.flatnonzero(known[at] == keys[:, t]).tolist():
                    for i in table[int(keys[w, t])]:
                        out[int(of[a + w]), i].append(int(starts[a + w]))
        return out

    def _verify(self, d, i, starts, begin, end, h, found) -> None:
        """The best passage among those in and around the windows; windows that overlap are one region."""
        item = self.rows[i]
        m = len(item)
        k = allowed(m)
        regions: list[list[int]] = []
        for s in sorted(set(starts)):
            a, z = max(0, s - k), min(len(h), s + m + k)
            if regions and a <= regions[-1][1]:
                regions[-1][1] = z
            else:
                regions.append([a, z])
        for a, z in regions:
            edits, stop = best_passage(item, h[a:z])
            if edits > k:
                continue
            # where the passage begins: the same search from its end backwards
            _, length = best_passage(item[::-1], h[a : a + stop][::-1])
            best = (edits, int(begin[a + stop - max(length, 1)]), int(end[a + stop - 1]))
            if (d, i) not in found or best < found[d, i]:
                found[d, i] = best


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ITEMS and CHARACTERS, or one longer item; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item_id, text in rows.toLocalIterator():
        if block and (len(block) == ITEMS or size + len(text) > CHARACTERS):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


_ITEMS: dict[str, Items] = {}


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and item found in it: id, item id, edits, similarity, first_byte, end_byte.

    The passage is the one with the fewest edits, then the first; byte places refer to the
    lower-cased text.  Null and empty texts and items without words match nothing.  Repeated rows of
    docs or of benchmark give repeated results; other columns are not read.  Ids are long, or strings
    where the column is of strings.
    """
    kind = "string" if docs.schema[id_col].dataType.typeName() == "string" else "long"
    schema = f"`{id_col}` {kind}, `{item_col}` long, edits int, similarity double, first_byte long, end_byte long"
    source = small_batches(docs).select(F.col(id_col).cast(kind).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_t") != "")
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        # bounded by ITEMS, so it may go to every executor
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = source.mapInPandas(_searching(shared, [id_col, item_col], kind), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _searching(shared, names: list[str], kind: str):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _ITEMS:
            _ITEMS.clear()
            _ITEMS[name] = Items(shared.value)
        items = _ITEMS[name]
        for batch in batches:
            ids = batch["_id"].tolist()
            rows = [
                (ids[d], items.ids[i], edits, 1 - edits / len(items.rows[i]), a, z)
                for d, i, edits, a, z in items.search(batch["_t"].tolist())
            ]
            if rows:
                out = pd.DataFrame(rows, columns=[*names, "edits", "similarity", "first_byte", "end_byte"])
                yield out.astype({names[1]: "Int64"} | ({names[0]: "Int64"} if kind == "long" else {}))

    return run
