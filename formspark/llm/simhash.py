"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints.  Words are runs of anything but ASCII white space, A-Z lower-cased; the features are
all shingles of three words.  A bit of the 64-bit fingerprint is set if it is set in over half of the
shingles' XXH64 hashes.

Search.  A fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word of
the perfect binary Golay code.  A segment's fuzzy keys are the codeword indices of all words within
one bit of it, so segments up to two bits apart share one.  Two fingerprints that differ in at most
three bits either have a segment without errors, and then another with one at most: an exact
segment and a fuzzy key of another, 33 bits or more.  Or every segment has exactly one error: fuzzy keys of
two segments, and the half of the third that the error is not in, 34 bits.  Equal keys meet in a
shuffle, and every meeting is verified on the whole fingerprints.

Documents with one fingerprint are one node, so exact copies never multiply; a bucket gives a
spanning forest of its verified links, so a dense group gives no more links than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import checkpointed, small_batches
from .graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: first bit and width of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: first bit of a key's kind
KIND = 36
#: generator polynomial of the (23, 12) Golay code
GENERATOR = 0b101011100011
#: buckets up to this size are compared by shifts over the whole batch, larger ones one by one
SMALL = 12
#: hashes whose bits are counted at a time
BLOCK = 400_000
TO_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every shingle, repeats included; of all words where there are fewer than three."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(TO_LOWER).split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxh64_intdigest(flat, SEED)]
    begins = [0, *accumulate(len(w) + 1 for w in words)]
    return [xxh64_intdigest(flat[a : b - 1], SEED) for a, b in zip(begins, begins[SHINGLE:])]


def _majorities(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """The fingerprint of each run of hashes; no hash: zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(np.asarray(sizes))
    if len(full):
        n = np.asarray(sizes)[full]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    out, hashes, sizes = [], [], []
    for text in texts:
        h = shingle_hashes(text)
        if len(hashes) + len(h) > BLOCK and hashes:
            out.append(_majorities(hashes, sizes))
            hashes, sizes = [], []
        hashes += h
        sizes.append(len(h))
    out.append(_majorities(hashes, sizes))
    return np.concatenate(out)


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(fingerprints([t or "" for t in texts]).view(np.int64))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every 12-bit head, and the error pattern of every syndrome (weight 3 at most)."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    heads = np.array([remainder(h << 11) for h in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    single = [1 << i for i in range(23)]
    for e in [0, *single, *(a | b for a in single for b in single if a < b), *(a | b | c for a in single for b in single for c in single if a < b < c)]:
        errors[remainder(e)] = e
    return heads, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word; the code is perfect."""
    heads, errors = _golay()
    syndrome = heads[words >> 11] ^ (words & 0x7FF)
    return (words ^ errors[syndrome]) >> 11


def _fuzzy(prints: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each fingerprint; of each row its distinct fuzzy keys, others -1."""
    word = (prints >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    near = np.stack([decode(word), *(decode(word ^ (1 << i)) for i in range(width))], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return word, near


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each fingerprint; the top bits of a key are its kind."""
    segments = [_fuzzy(prints, *s) for s in SEGMENTS]
    rows, keys, kind = [], [], 0

    def add(row: np.ndarray, key: np.ndarray) -> None:
        nonlocal kind
        rows.append(row)
        keys.append(kind << KIND | key)
        kind += 1

    for a, (exact, _) in enumerate(segments):
        for b, (_, near) in enumerate(segments):
            if a != b:
                row, at = np.nonzero(near >= 0)
                add(row, exact[row] << 12 | near[row, at])
    (_, x), (_, y), (third, _) = segments
    row, at = np.nonzero(x >= 0)
    many = (y >= 0).sum(axis=1)
    # the second segment's keys of the same row, for each of the first's
    _, where = np.nonzero(y >= 0)
    first = np.r_[0, np.cumsum(many)[:-1]]
    each = np.repeat(row, many[row])
    step = np.arange(len(each)) - np.repeat(np.cumsum(many[row]) - many[row], many[row])
    both = np.repeat(x[row, at], many[row]) << 12 | y[each, where[first[each] + step]]
    half = SEGMENTS[2][1] // 2
    for part in (third & ((1 << half) - 1), third >> half):
        add(each, both << 11 | part[each])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 4000):
            part = batch.iloc[at : at + 4000]
            prints = part["fp"].to_numpy(np.int64)
            rows, keys = fuzzy_keys(prints.view(np.uint64))
            yield pd.DataFrame({"key": keys, "fp": prints[rows], "node": part["node"].to_numpy()[rows]})


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one bucket: each member is compared with those not reached yet."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _differ(fp[left], fp[x]) <= bits
            if near.any():
                got = left[near]
                a.append(np.full(len(got), node[x]))
                b.append(node[got])
                queue.extend(got)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _links(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("key", "fp", "node")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            # the last key of a batch may go on in the next
            cut = np.searchsorted(now[0], now[0][-1])
            rest = [x[cut:] for x in now]
            if cut:
                yield from bucket_links(*(x[:cut] for x in now))
        if rest is not None and len(rest[0]):
            yield from bucket_links(*rest)

    def bucket_links(key, fp, node):
        fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begins, len(key)])
        a, b = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, min(SMALL, int(sizes.max()))):
            hit = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            hit = hit[_differ(fp[hit], fp[hit + d]) <= bits]
            a.append(node[hit])
            b.append(node[hit + d])
        for at, n in zip(begins[sizes > SMALL], sizes[sizes > SMALL]):
            x, y = _forest(fp[at : at + n], node[at : at + n], bits)
            a.append(x)
            b.append(y)
        if a and sum(map(len, a)):
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a, b) between nodes (fp, node) with distinct fingerprints.

    All links of small buckets and a spanning forest of each larger one: everything that can be
    reached through links of at most ``bits`` (three at most) differing bits stays reachable.
    """
    if bits > MAX_BITS:
        raise ValueError("the segments guarantee links of at most three bits")
    keyed = small_batches(nodes).select("fp", "node").mapInPandas(_keyed, "key long, fp long, node long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_links(bits), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Ids are integers.  component_id is the smallest id that links of at most ``bits`` differing bits reach, the row's own
    included.  Texts that are null or without words have the fingerprint zero and are linked like any
    other.  Rows with a null id are kept; their group takes the smallest id that is not null.
    Repeated rows stay repeated; other columns of docs are not read.
    """
    prints = checkpointed(small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), fingerprint(F.col(text_col)).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("node"))
    found = components(links(nodes.where(F.col("node").isNotNull()), bits))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
