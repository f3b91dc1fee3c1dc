"""Suffix dedup, SimHash and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from formspark.llm import decontaminate as dec
from formspark.llm import graph
from formspark.llm import simhash as sim
from formspark.llm import suffix_dedup as suf
from formspark.llm.words import words


def kept(docs):
    """(n, removed, spans, sha) of every (id, text) by the definition."""
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, prose):
    rng = random.Random(1)
    passages = [prose(rng, 14) for _ in range(6)]
    docs = []
    for i in range(160):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : a + rng.randint(40, 90)], prose(rng, rng.randint(0, 6))]
        docs.append((rng.randint(0, 10_000) * 200 + i, "".join(parts)))
    docs += [(5_000_001, docs[3][1]), (5_000_002, "é" * 60), (5_000_003, "xé" * 40 + "é" * 40), (5_000_004, "ab" * 60), (5_000_005, "b" + "ab" * 60), (5_000_006, "q" * 50), (5_000_007, "q" * 51)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in suf.suffix_dedup(df).collect())
    assert got == kept(docs)


def test_blocks_of_long_texts(monkeypatch, prose):
    rng = random.Random(2)
    texts = [prose(rng, 900).encode(), b"", b"z" * 49, prose(rng, 30).encode()]

    def every():
        return sorted({(int(d), int(p), int(h)) for block in suf.anchors(texts) for d, p, h in zip(*block)})

    whole = every()
    monkeypatch.setattr(suf, "BLOCK", 700)
    assert every() == whole
    for d, text in enumerate(texts):  # each window has an anchor
        at = np.array([p for e, p, _ in whole if e == d])
        assert all(((at >= s) & (at <= s + 50 - suf.GRAM)).any() for s in range(len(text) - 49))


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (500, 21), dtype=np.uint8)
    order = suf.multikey_quicksort(rows)
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)


def test_suffix_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in suf.suffix_dedup(odd_docs).collect()}
    assert len(got) == 9 and suf.suffix_dedup(odd_docs).count() == 10 and suf.suffix_dedup(no_docs).count() == 0
    last = suf.suffix_dedup(odd_docs.selectExpr("coalesce(doc_id, 9223372036854775807) as doc_id", "text"))
    assert {r.doc_id for r in last.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, (1 << 63) - 1}
    assert got[1].n_bytes == 0 and got[5].n_removed == 0 and got[6].n_bytes - got[6].n_removed <= 50 and got[None].n_removed == 0
    kept_rows = suf.suffix_dedup(odd_docs, keep=["doc_id", "text", "lang", "score", "id"]).collect()
    assert len(kept_rows) == 10 and {r.id for r in kept_rows if r.doc_id == 1} == {"a"}


def test_kept_text_is_whole_characters():
    b = np.frombuffer("aéb".encode(), np.uint8)
    assert suf.whole_characters(b, np.array([False, True, False, True])).tolist() == [False, False, False, True]


def fingerprint(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def test_simhash(spark, prose):
    rng = random.Random(4)
    docs = [(1000 - i, prose(rng, rng.choice([0, 1, 2, 3, 40, 300]))) for i in range(150)]
    for i in range(60):
        ws = docs[rng.randrange(150)][1].split(" ")
        if len(ws) > 100:
            ws[rng.randrange(len(ws))] = "changed"
        docs.append((i, " ".join(ws)))
    want = {i: fingerprint(t) for i, t in docs}
    find = components([(a, b) for a, x in want.items() for b, y in want.items() if (x ^ y).bit_count() <= 3])
    rows = sim.simhash_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", find(i)) for i, f in want.items()}


def test_golay():
    rng = np.random.default_rng(5)
    words_ = rng.integers(0, 1 << 23, 2000)
    code = sim.decode(words_)
    heads, _ = sim._golay()
    assert np.bitwise_count((code << 11 | heads[code]) ^ words_).max() <= 3
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    rows, keys = sim.fuzzy_keys(np.concatenate([x, y]))
    have = [set() for _ in range(6000)]
    for r, k in zip(rows.tolist(), keys.tolist()):
        have[r].add(k)
    assert all(have[i] & have[i + 3000] for i in range(3000))


def test_large_buckets_keep_components():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp ^ (np.uint64(1) << np.uint64(b)) for b in range(60)]))
    a, b = sim._forest(fp, np.arange(len(fp)), 3)
    find = components([(i, i) for i in range(len(fp))] + list(zip(a.tolist(), b.tolist())))
    brute = components([(i, j) for i in range(len(fp)) for j in range(len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 3])
    assert [find(i) for i in range(len(fp))] == [brute(i) for i in range(len(fp))] and len(a) < len(fp)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    find = components([e for e in edges if None not in e and e[0] != e[1]])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if None not in e and e[0] != e[1] for n in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_a_hub_stay_apart(spark, monkeypatch):
    """A node with nearly all rows: its rows are not gathered in one task."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "HEAVY", 500)
    monkeypatch.setattr(graph, "HUBS", 100)
    n = 20_000
    seen = spark.range(1, n + 1, 1, 8).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).unionAll(spark.range(1, n, 1, 8).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = graph._linked(seen, least, seen.count())
    sizes = [r["count"] for r in linked.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == seen.count() and max(sizes) < n / 2
    got = graph.components(seen.select(F.col("u").alias("a"), F.col("v").alias("b")))
    assert got.count() == n + 1 and got.where("component <> 0").count() == 0


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = sim.simhash_components(odd_docs).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert sim.simhash_components(no_docs).count() == 0


def edit(item, text):
    """Fewest word edits from the item to any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


@pytest.fixture(scope="module")
def leaks(prose):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(8, 40))) for k in range(30)] + [(77, "solitary"), (78, ""), (79, None)]
    docs = [(i, prose(rng, rng.randint(0, 80))) for i in range(40)]
    for k, text in items[:30]:
        for share in (0.0, 0.1, 0.2):
            ws = text.split()
            for _ in range(int(share * len(ws))):
                j = rng.randrange(len(ws))
                how = rng.random()
                if how < 0.4:
                    ws[j] = "zz"
                elif how < 0.7:
                    del ws[j]
                else:
                    ws.insert(j, "zz")
            docs.append((len(docs), f"{prose(rng, rng.randint(0, 30))} {' '.join(ws)} {prose(rng, rng.randint(0, 30))}"))
    docs += [(900, "a Solitary word"), (901, None), (902, "")]
    return items, docs


def test_decontamination(spark, leaks):
    items, docs = leaks
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = {}
    for i, text in docs:
        ws = split(text)
        for k, item in items:
            m = len(split(item))
            if m and (e := edit(split(item), ws)) <= dec.allowed(m):
                want[i, k] = e
    got = dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(want) and all(want[p] == e for p, e in found.items())
    assert len(found) >= 0.97 * len(want) and len(want) > 80
    texts = dict(docs)
    for r in got:
        passage = split(texts[r.doc_id].lower().encode()[r.first_byte : r.end_byte].decode())
        assert edit(split(dict(items)[r.item_id]), passage) == r.edits


@pytest.mark.parametrize("m", [60, 120, 200])
@pytest.mark.parametrize("kind", ["deletions", "insertions", "replacements"])
def test_recall_at_the_largest_distance(m, kind):
    rng = random.Random(m)
    new = lambda n: [f"w{rng.getrandbits(48)}" for _ in range(n)]
    items, texts = [new(m) for _ in range(200)], []
    for item in items:
        passage = list(item)
        for j in sorted(rng.sample(range(1, m - 1), dec.allowed(m)), reverse=True):
            passage[j : j + (kind != "insertions")] = [] if kind == "deletions" else new(1)
        texts.append(" ".join(new(m) + passage + new(m)))
    found = {(d, i) for d, i, *_ in dec.Items(list(enumerate(map(" ".join, items)))).search(texts)}
    assert sum((i, i) in found for i in range(200)) >= 0.99 * 200


def test_blocks_of_items(spark, monkeypatch):
    rows = [(k, "word " * (k + 1)) for k in range(9)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    monkeypatch.setattr(dec, "ITEMS", 4)
    monkeypatch.setattr(dec, "CHARACTERS", 60)
    blocks = list(dec._blocks(items, "item_id", "text"))
    assert sorted(x for b in blocks for x in b) == rows and all(len(b) <= 4 and (len(b) == 1 or sum(len(t) for _, t in b) <= 60) for b in blocks)
    docs = spark.createDataFrame([(1, "a word word word b")], "doc_id long, text string")
    assert {r.item_id for r in dec.contaminated(docs, items).collect()} == {0, 1, 2}


def test_words_across_blocks(monkeypatch, prose):
    from formspark.llm import words as w

    rng = random.Random(9)
    texts = [prose(rng, 400).lower().encode(), b"", b"x" * 900, "é à".encode()]
    flat = lambda: sorted((int(d), int(a), int(z), int(h)) for block in words(texts) for d, a, z, h in zip(*block))
    whole = flat()
    monkeypatch.setattr(w, "BLOCK", 300)
    assert flat() == whole
    assert [texts[d][a:z] for d, a, z, _ in whole] == [x for t in texts for x in re.findall(rb"[0-9a-z\x80-\xff]+", t)]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "no id here"), (2, None), (3, "  ")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(odd_docs, items).collect()] == [(None, 1)]
    assert dec.contaminated(no_docs, items).count() == 0 and dec.contaminated(odd_docs, items.limit(0)).count() == 0
