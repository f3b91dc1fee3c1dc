"""Suffix-array removal of byte strings that also start in an earlier document.

Every byte covered by a 50-byte string that also starts in a document with a smaller id goes.  A
suffix array over every suffix would be many times the text, so only suffixes at *anchors* are kept,
and nothing is lost by that: the anchors of a text are the positions whose 24-byte gram has the
smallest hash of some 27 neighbouring grams, that is of some 50-byte window.  Two equal windows have
their smallest grams at the same place, so both have an anchor there, with 26 bytes at most to its
left and 50 to its right in the window.

1. Anchors whose gram occurs in one document only cannot be in a shared window.  Gram hashes meet in
   a shuffle (each batch sends a gram once) and only anchors seen in two documents go on.
2. The suffix at an anchor, with the bytes left of it, is its *context*.  Splitters sampled from the
   contexts range-partition them by the leading tokens of the suffix.  A batch sends equal contexts
   once, with the places that have them, sorted and compressed, so a passage in very many documents
   costs a few bytes a place.
3. A bucket sorts its suffixes by multikey quicksort (8-byte tokens, only ties go on to the next
   token), and the bytes before the anchors likewise from right to left.  Longest common prefixes of
   neighbours give, for each of the 27 windows, the classes of equal strings and their smallest id.
   Splitters are whole grams, so neighbours across a boundary differ within the gram already and no
   window of one bucket can be in another.
4. Places whose windows start in a smaller id go back to their documents, which mark the bytes.

All comparisons are of bytes; hashes only select candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import checkpointed, partitions, small_batches

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
CONTEXT = LEFT + LENGTH
#: bytes of text handled at a time
BLOCK = 1_000_000
#: anchors that a batch gathers before it sends them on
GATHER = 700_000
GATHER_CONTEXTS = 150_000
#: rows whose results are made at a time
ROWS = 1_000
#: bytes of text for each bucket; a task holds one bucket at a time
BUCKET_BYTES = 16_000_000
#: range buckets for each bucket of hashes
BUCKETS = 4
#: texts with more copies than this share of all documents (one in so many), and over 1000, are broadcast
MOST_COPIED = 1000
#: documents for each bucket, and grams of each, that the splitters are sampled from
SAMPLE_DOCS = 20
SAMPLE_GRAMS = 20
NO_ID = (1 << 63) - 1

_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xBF58476D1CE4E5B9)]


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each position."""
    h2 = (h := _BYTES[b])[:-1] * _MIX[0] + h[1:]
    h4 = h2[:-2] * _MIX[1] + h2[2:]
    h8 = h4[:-4] * _MIX[2] + h4[4:]
    n = len(b) - GRAM + 1
    h = (h8[:-8] * _MIX[3] + h8[8:])[:n] * _MIX[4] + h8[16 : 16 + n]
    h ^= h >> np.uint64(31)
    h *= _MIX[5]
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _slide(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over every run of ``width`` values."""
    m = 1
    while 2 * m <= width:
        x, m = f(x[:-m], x[m:]), 2 * m
    return f(x[: len(x) - (width - m)], x[width - m :]) if m < width else x


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of text: bytes, and of each piece its end, document and offset there.

    A text longer than a block comes in several pieces that overlap by a window less one byte.
    """
    parts, ends, docs, offsets, size = [], [], [], [], 0
    for d, text in enumerate(texts):
        at = 0
        while len(text) - at >= LENGTH:
            part = text[at : at + BLOCK]
            parts.append(part)
            size += len(part)
            ends.append(size)
            docs.append(d)
            offsets.append(at)
            at += len(part) - LENGTH + 1
            if size >= BLOCK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(docs), np.array(offsets)
                parts, ends, docs, offsets, size = [], [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(docs), np.array(offsets)


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document, position, gram hash) of all anchors, ordered by document."""
    for b, ends, docs, offsets in _pieces(texts):
        begins = np.r_[0, ends[:-1]]
        h = _grams(b)
        least = _slide(np.minimum, h, WINDOW)
        n = len(least)
        # windows that would reach into the next piece count for nothing
        least[np.repeat(ends, ends - begins)[:n] - np.arange(n) < LENGTH] = 0
        wide = np.zeros(len(h) + WINDOW - 1, np.uint64)
        wide[WINDOW - 1 : WINDOW - 1 + n] = least
        at = np.flatnonzero(_slide(np.maximum, wide, WINDOW)[: len(h)] == h)
        piece = np.searchsorted(begins, at, "right") - 1
        yield docs[piece], at - begins[piece] + offsets[piece], h[at]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the first foremost, and where each run of equal keys begins in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


ANCHORS = "bucket int, ids binary, ths binary, doc binary, h0 binary, h1 binary, h2 binary, lo binary, hi binary, known binary"
_SMALL = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "ths", "doc", "h0", "h1", "h2", "lo", "hi", "known"))])


def _send_anchors(buckets: int):
    """Batches of (id, th, text) to packed anchors, a row for each bucket of gram hashes."""

    def send(ids, ths, doc, pos, h) -> Iterator[pa.RecordBatch]:
        order, begins = _groups(h, doc)
        # a gram in two documents of this batch is known to be shared; one of its anchors tells the others
        new = np.zeros(len(order), bool)
        hs = h[order]
        new[np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])] = True
        ds = doc[order]
        run = np.cumsum(new) - 1
        first, last = ds[new], np.r_[ds[np.flatnonzero(new)[1:] - 1], ds[-1:]]
        shared = (first != last)[run]
        known = np.zeros(len(h), np.uint8)
        known[order] = shared.astype(np.uint8) + (shared & ~new)  # 0: unknown, 1: shared and sent on, 2: shared, needs no meeting
        bucket = (h >> np.uint64(16)) % np.uint64(buckets)
        bucket[known == 2] = (pos[known == 2] % buckets).astype(np.uint64)
        order = np.lexsort((pos, doc, bucket))
        bucket = bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        columns = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            o = order[a:z]
            there, local = np.unique(doc[o], return_inverse=True)
            g, p = h[o] >> np.uint64(16), pos[o]
            columns.append((
                int(bucket[a]), ids[there].tobytes(), ths[there].tobytes(), local.astype(np.uint32).tobytes(),
                *((g >> np.uint64(s)).astype(np.uint16).tobytes() for s in (0, 16, 32)),
                (p & 0xFFFF).astype(np.uint16).tobytes(), (p >> 16).astype(np.uint16).tobytes(), known[o].tobytes(),
            ))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*columns), _SMALL)], schema=_SMALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            got, n = [], 0
            for block in anchors(texts):
                got.append(block)
                n += len(block[0])
                if n >= GATHER:
                    yield from send(ids, ths, *map(np.concatenate, zip(*got)))
                    got, n = [], 0
            if n:
                yield from send(ids, ths, *map(np.concatenate, zip(*got)))

    return run


_SHARED = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32())])


def _one_by_one(handle):
    """Rows of buckets, each in one run, to what ``handle`` makes of the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now and rows:
                    yield from handle(rows)
                    rows = []
                now = r["bucket"]
                rows.append(r)
        if rows:
            yield from handle(rows)

    return run


def _shared_anchors(bucket: list[dict]) -> Iterator[pa.RecordBatch]:
    """Packed anchors of one bucket to (id, th, pos) of those whose gram is in two documents."""
    docs, parts, base = [], [], 0
    for r in bucket:
        ids, ths = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ths"], np.int64)
        g = sum(np.frombuffer(r[c], np.uint16).astype(np.uint64) << np.uint64(s) for c, s in (("h0", 0), ("h1", 16), ("h2", 32)))
        pos = np.frombuffer(r["lo"], np.uint16).astype(np.int32) | np.frombuffer(r["hi"], np.uint16).astype(np.int32) << 16
        parts.append((np.frombuffer(r["doc"], np.uint32) + np.uint32(base), g, pos, np.frombuffer(r["known"], np.uint8)))
        docs.append((ids, ths))
        base += len(ids)
    ids, ths = map(np.concatenate, zip(*docs))
    doc, g, pos, known = map(np.concatenate, zip(*parts))
    keep = known > 0
    meet = np.flatnonzero(known < 2)
    if len(meet):
        # a document is its id and text hash; ids alone decide whether another document has the gram
        _, name = np.unique(np.stack([ids, ths]), axis=1, return_inverse=True)
        name = name.ravel()[doc[meet]]
        order = np.argsort(g[meet], kind="stable")
        gs, ns = g[meet][order], name[order]
        begins = np.flatnonzero(np.r_[True, gs[1:] != gs[:-1]])
        sizes = np.diff(np.r_[begins, len(gs)])
        several = np.minimum.reduceat(ns, begins) != np.maximum.reduceat(ns, begins)
        several |= np.maximum.reduceat(known[meet][order], begins) > 0
        keep[meet[order[np.repeat(several, sizes)]]] = True
    at = np.flatnonzero(keep)
    for a in range(0, len(at), 100_000):
        o = at[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[o]]), pa.array(ths[doc[o]]), pa.array(pos[o].astype(np.int32))], schema=_SHARED)


_AROUND = np.arange(CONTEXT)


def _context_rows(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of each anchor: how many bytes there are left and right of it (26 and 50 at most), then the bytes."""
    wide = np.concatenate([np.zeros(LEFT, np.uint8), text, np.zeros(LENGTH, np.uint8)])
    rows = np.empty((len(pos), CONTEXT + 2), np.uint8)
    rows[:, 0] = np.minimum(pos, LEFT)
    rows[:, 1] = np.minimum(len(text) - pos, LENGTH)
    rows[:, 2:] = wide[pos[:, None] + _AROUND]
    return rows


def _gram_of(rows: np.ndarray) -> np.ndarray:
    """The gram at the anchor of each context, as byte strings that compare like its bytes."""
    return np.ascontiguousarray(rows[:, 2 + LEFT : 2 + LEFT + GRAM]).view(f"S{GRAM}").ravel()


def _texts_and_anchors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts, lists = batch.column("text").cast(pa.binary()), batch.column("at")
    for d in range(batch.num_rows):
        yield d, np.frombuffer(texts[d].as_py(), np.uint8), np.unique(lists[d].values.to_numpy()).astype(np.int64)


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, text, pos in _texts_and_anchors(batch):
            rows = _context_rows(text, pos[:: max(1, len(pos) // SAMPLE_GRAMS)])
            yield pa.RecordBatch.from_arrays([pa.array(_gram_of(rows).tolist(), pa.binary())], names=["gram"])


CONTEXTS = "bucket int, ids binary, ths binary, n int, data binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("ths", pa.binary()), ("n", pa.int32()), ("data", pa.binary())])


def _send_contexts(splitters: list[bytes]):
    """(id, th, text, at) to compressed contexts with their places, a row for each range of grams."""
    bounds = np.array(splitters, f"S{GRAM}")

    def send(ids, ths, doc, pos, rows) -> Iterator[pa.RecordBatch]:
        order = multikey_quicksort(np.ascontiguousarray(np.roll(rows, -2 - LEFT, axis=1)))
        rows = rows[order]
        new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
        begins = np.flatnonzero(new)
        bucket = np.searchsorted(bounds, _gram_of(rows[begins]), "right")
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        ends = np.r_[begins, len(rows)]
        columns = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            o = order[ends[a] : ends[z]]
            there, local = np.unique(doc[o], return_inverse=True)
            counts = np.diff(ends[a : z + 1])
            data = [rows[begins[a:z]].tobytes(), counts.astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), pos[o].astype(np.uint32).tobytes()]
            sizes = np.array([*map(len, data)], np.int64).tobytes()
            packed = pa.compress(sizes + b"".join(data), codec="zstd", asbytes=True)
            size = 32 + sum(map(len, data))
            columns.append((int(bucket[a]), ids[there].tobytes(), ths[there].tobytes(), size, packed))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*columns), _PACKED)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, docs, places, rows, n, base = [], [], [], [], [], 0, 0
        for batch in batches:
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            ths.append(batch.column("th").to_numpy(zero_copy_only=False))
            for d, text, pos in _texts_and_anchors(batch):
                for a in range(0, len(pos), GATHER_CONTEXTS):
                    p = pos[a : a + GATHER_CONTEXTS]
                    docs.append(np.full(len(p), base + d))
                    places.append(p)
                    rows.append(_context_rows(text, p))
                    n += len(p)
                    if n >= GATHER_CONTEXTS:
                        yield from send(*map(np.concatenate, (ids, ths, docs, places, rows)))
                        docs, places, rows, n = [], [], [], 0
            base += batch.num_rows
        if n:
            yield from send(*map(np.concatenate, (ids, ths, docs, places, rows)))

    return run


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: ties of one 8-byte token go on, group by group, to the next."""
    n, width = rows.shape
    tokens = np.zeros((n, -(-width // 8) * 8), np.uint8)
    tokens[:, :width] = rows
    tokens = tokens.view(">u8").astype(np.uint64)
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    tied = np.arange(n)  # places in order that are not settled
    for k in range(tokens.shape[1]):
        if not len(tied):
            break
        token = tokens[order[tied], k]
        by = np.lexsort((token, group[tied]))
        order[tied] = order[tied][by]
        token, g = token[by], group[tied]
        new = np.r_[True, (g[1:] != g[:-1]) | (token[1:] != token[:-1])]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.r_[begins, len(tied)])
        group[tied] = np.repeat(tied[begins], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order


def _classes(rows: np.ndarray, depths: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the common prefix (up to ``depths`` bytes) of each row with the one before it."""
    order = multikey_quicksort(rows)
    lcp = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 200_000):
        x, y = rows[order[a - 1 : a + 199_999]], rows[order[a : a + 200_000]]
        differ = x[: len(y)] != y
        lcp[a : a + len(y)] = np.where(differ.any(axis=1), differ.argmax(axis=1), depths)
    return order, lcp


def least_ids(ctx: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each context the smallest id that has each of its 27 windows; window s begins s bytes after the first."""
    n = len(ctx)
    out = np.full((n, WINDOW), NO_ID, np.int64)
    has_left, has_right = ctx[:, 0].astype(np.int64), ctx[:, 1].astype(np.int64)
    body = ctx[:, 2:]
    right, r_lcp = _classes(np.ascontiguousarray(body[:, LEFT:]), LENGTH)
    left, l_lcp = _classes(np.ascontiguousarray(body[:, :LEFT][:, ::-1]), LEFT)
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(WINDOW):
        before, after = LEFT - s, GRAM + s
        of_right[right] = np.cumsum(r_lcp < after)
        of_left[left] = np.cumsum(l_lcp < before)
        rows = np.flatnonzero((has_left >= before) & (has_right >= after))
        if not len(rows):
            continue
        key = of_right[rows] * (n + 1) + of_left[rows]
        order = np.argsort(key, kind="stable")
        k = key[order]
        begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.minimum.reduceat(low[rows][order], begins)
        out[rows[order], s] = np.repeat(least, np.diff(np.r_[begins, len(k)]))
    return out


_MARKS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("mark", pa.int64())])


def _bucket_marks(bucket: list[dict]) -> Iterator[pa.RecordBatch]:
    """A range bucket to (id, th, mark) of places with a window that starts in a smaller id.

    A mark is the place and, in the low bits, the windows.
    """
    contexts, counts, ids, ths, places = [], [], [], [], []
    for r in bucket:
        data = pa.decompress(r["data"], decompressed_size=r["n"], codec="zstd", asbytes=True)
        at = np.r_[32, 32 + np.cumsum(np.frombuffer(data[:32], np.int64))]
        rows, many, local, pos = (data[a:z] for a, z in zip(at, at[1:]))
        contexts.append(np.frombuffer(rows, np.uint8).reshape(-1, CONTEXT + 2))
        counts.append(np.frombuffer(many, np.uint32))
        local = np.frombuffer(local, np.uint32)
        ids.append(np.frombuffer(r["ids"], np.int64)[local])
        ths.append(np.frombuffer(r["ths"], np.int64)[local])
        places.append(np.frombuffer(pos, np.uint32).astype(np.int64))
    contexts, counts, ids, ths, places = map(np.concatenate, (contexts, counts, ids, ths, places))
    begins = np.r_[0, np.cumsum(counts[:-1], dtype=np.int64)]
    least = least_ids(contexts, np.minimum.reduceat(ids, begins))
    of = np.repeat(np.arange(len(counts)), counts)
    bit = np.int64(1) << np.arange(WINDOW, dtype=np.int64)
    for a in range(0, len(of), 50_000):
        o = slice(a, a + 50_000)
        mask = ((least[of[o]] < ids[o, None]) * bit).sum(axis=1)
        hit = np.flatnonzero(mask)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[o][hit]), pa.array(ths[o][hit]), pa.array(places[o][hit] << 32 | mask[hit])], schema=_MARKS
            )


def _covered(n: int, marks: np.ndarray) -> np.ndarray:
    """Which of n bytes the marked windows cover."""
    edge = np.zeros(n + 1, np.int32)
    pos, mask = marks >> 32, marks & 0xFFFFFFFF
    for s in range(WINDOW):
        begin = pos[(mask >> s & 1) == 1] - LEFT + s
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The part of the removed bytes that is whole UTF-8 characters."""
    begins = np.flatnonzero((text & 0xC0) != 0x80)
    whole = np.minimum.reduceat(gone, begins) if len(begins) else gone[:0]
    return np.repeat(whole, np.diff(np.r_[begins, len(text)]))


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _results(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield from results(whole.slice(at, ROWS))

    def results(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("id")
        first = batch.column("first").to_pylist()
        out = []
        for d, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            n, marks = len(text), batch.column("marks")[d]
            if n >= LENGTH and first[d] < ids[d].as_py():  # a copy of a whole earlier text
                gone, spans, kept, chars = n, 1, b"", b""
            elif marks.is_valid:
                b = np.frombuffer(text, np.uint8)
                cover = _covered(n, marks.values.to_numpy())
                gone, spans = int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                kept = b[~cover].tobytes()
                chars = b[~whole_characters(b, cover)].tobytes() if keep_text else b""
            else:
                gone, spans, kept, chars = 0, 0, text, text
            out.append((ids[d].as_py(), n, gone, spans, hashlib.sha256(kept).hexdigest(), chars.decode("utf-8", "replace") if keep_text else None))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("row")], names=[*_RESULT.names, "row"])

    return run


def _first_copies(narrow: DataFrame, n: int) -> DataFrame:
    """(id, th, first): of every text the smallest id that has the same one.

    Sizes are combined before their shuffle.  Texts with very many copies are fewer than MOST_COPIED by
    the bound on their size, so they are broadcast and their copies never meet in one task.
    """
    groups = narrow.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    bound = max(1000, n // MOST_COPIED)
    large = narrow.join(F.broadcast(groups.where(F.col("n") > bound).select("sha", F.col("first").alias("_large"))), "sha", "left")
    some = groups.where((F.col("n") > 1) & (F.col("n") <= bound)).select("sha", "first")
    rest = large.where("_large is null").join(some, "sha", "left").select("id", "th", F.coalesce("first", "id").alias("first"))
    return rest.unionAll(large.where("_large is not null").select("id", "th", F.col("_large").alias("first"))).distinct()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep`` also kept_text.

    n_spans counts maximal runs of removed bytes; kept_sha256 is of the remaining bytes concatenated.
    Ids are integers.  A null text is empty, texts under 50 bytes lose nothing, and matches never cross documents.  Of
    rows that share an id none is before the other, so repeated rows stay alike and keep each other;
    rows with a null id come after all others.  Other columns of docs are not read, but for those
    that ``keep`` names: they are returned, and kept_text is then the text without all removed
    characters (a character goes when all its bytes do).
    """
    text, kept = F.coalesce(F.col(text_col), F.lit("")), [c for c in keep or [] if c != id_col]
    # the lowest bit of the hash says that there is no id; the hash joins rows with their id, so no other column has to
    named = F.xxhash64(text).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col(id_col).isNull().cast("long"))
    row = [F.struct(*[F.col(c) for c in kept]).alias("row")] if kept else []
    base = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), named.alias("th"), text.alias("text"), *row)

    # 1. anchors whose gram is in two documents; buckets grow in number with the bytes of all texts, not in size
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES), 1)
    sent = base.select("id", "th", "text").mapInArrow(_send_anchors(buckets), ANCHORS)
    shared = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_one_by_one(_shared_anchors), "id long, th long, pos int")
    shared = checkpointed(shared.groupBy("id", "th").agg(F.collect_list("pos").alias("at")))

    # 2. the first of each group of equal texts; copies need no contexts of their own
    narrow = base.select("id", "th", F.sha2("text", 256).alias("sha"))
    first = _first_copies(narrow, n)
    whole = base.repartition(buckets, "id", "th")
    ones = shared.join(first.where(F.col("id") == F.col("first")), ["id", "th"]).select("id", "th", "at")
    # 3. range buckets of contexts; the sample for the splitters is bounded by the number of buckets
    ranges = BUCKETS * buckets
    docs_sampled = SAMPLE_DOCS * buckets
    sample = base.select("id", "th", "text").join(F.broadcast(shared.limit(docs_sampled)), ["id", "th"])
    grams = sorted(r["gram"] for r in sample.select("text", "at").mapInArrow(_sampled_grams, "gram binary").toLocalIterator())
    splitters = sorted({bytes(grams[k * len(grams) // ranges]) for k in range(1, ranges)}) if grams else []
    contexts = whole.join(ones, ["id", "th"]).select("id", "th", "text", "at").mapInArrow(_send_contexts(splitters), CONTEXTS)
    marks = contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_one_by_one(_bucket_marks), "id long, th long, mark long")

    # 4. marks back to their documents
    marks = marks.groupBy("id", "th").agg(F.collect_list("mark").alias("marks"))
    no_id = (F.col("th").bitwiseAND(F.lit(1).cast("long")) == 1).alias("_none")
    joined = whole.join(first.join(marks, ["id", "th"], "left"), ["id", "th"])
    joined = joined.select("id", "text", "first", "marks", F.struct(no_id, *[F.col("row")[c].alias(c) for c in kept]).alias("row"))
    result = StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string").add(joined.schema["row"])
    out = joined.mapInArrow(_results(bool(keep)), result).withColumn(id_col, F.when(~F.col("row")["_none"], F.col("id")))
    columns = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*columns, "kept_text", *[F.col("row")[c].alias(c) for c in kept]) if keep else out.select(*columns)
