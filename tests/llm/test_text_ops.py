"""Toxicity, fingerprints, token counts and licence scans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from formspark.llm import fingerprints as fp
from formspark.llm import licenses as lic
from formspark.llm import token_counts as tok
from formspark.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(3)
    word = lambda a, z: "".join(rng.choice("abc") for _ in range(rng.randint(a, z)))
    for _ in range(5):
        terms = {word(3, 13): rng.random() < 0.3 for _ in range(12)}
        trie = tox.Trie(terms)
        for _ in range(300):
            w, best = word(0, 12), None
            for t, stem in terms.items():
                d = min(distance(t, w[:i]) for i in range(len(w) + 1)) if stem else distance(t, w)
                if d <= tox.errors_allowed(t, stem) and (best is None or (d, -len(t), t) < best):
                    best = (d, -len(t), t)
            got = trie.match(w)
            assert (got and (got[1], got[0])) == (best and (best[0], best[2]))


@pytest.mark.parametrize("stem", ["grobel", "groby"])
def test_misspellings_of_an_inflected_term(spark, prose, stem):
    rng = random.Random(21)
    forms = [stem, f"{stem}s", f"{stem}ish"]
    text = lambda w: f"{prose(rng, 20)} you {w} {prose(rng, 20)}"
    rows = [(i, text(forms[i % 3]), 1) for i in range(120)] + [(200 + i, prose(rng, 40), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(docs, docs)
    assert (stem, True, stem) in model.terms and ({(f, False, stem) for f in forms} <= set(model.terms)) == (len(stem) < 6)
    wrong = {"grobel": ["grabel", "gobel", "grovels", "grobelihs", "grobels", "grobely"], "groby": ["graby", "goby", "grovys", "grobyihs", "grobys", "grobyly"]}[stem]
    seen = spark.createDataFrame([(i, text(w)) for i, w in enumerate(wrong)] + [(100, prose(rng, 40))], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in tox.score_texts(seen, model, ["doc_id"]).collect()}
    assert got == {i: 1 for i in range(len(wrong))} | {100: 0}


def test_words_of_copied_texts_are_no_terms(spark, prose):
    """A passage that toxic texts copy from each other gives no term, nor do the words of copied clean texts."""
    rng = random.Random(22)
    passage, shared = " ".join(f"copied{c}word" for c in "abcdefgh"), " ".join(f"clean{c}text" for c in "abcdefgh")
    rows = [(i, f"{prose(rng, 30)} grobnik {prose(rng, 30)} {passage if i % 2 else ''} {prose(rng, 9)}", 1) for i in range(90)]
    rows += [(100 + i, f"{prose(rng, 60)} {shared if i % 3 == 0 else ''} {prose(rng, 9)}", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {f for *_, f in tox.fit(docs, docs).terms} == {"grobnik"}


def test_ordinary_words_are_no_misspellings(spark, prose):
    rng = random.Random(23)
    rows = [(i, f"{prose(rng, 30)} clowner {prose(rng, 30)}", 1) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 30)} {'crowner' if i % 5 == 0 else 'x'} {prose(rng, 30)}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(docs, docs)
    assert model.ordinary == ("crowner",)
    score = lambda w: float(model.score(model.evidence(*tox.matches(f"a plain {w} of some kind", model.matcher())))[0])
    assert score("crowner") < 0.1 and score("clownr") >= 0.7 <= score("clowner")


def test_context_weights():
    m = tox.Matcher(tox.Trie({"idiot": False, "worthless": False}))
    plain, quoted, aimed = (tox.matches(t, m)[1][0][3] for t in ("what an idiot", 'he said "idiot" to all', "you idiot"))
    assert quoted < plain < aimed
    assert [e for _, _, e, _ in tox.matches("an idiott and worthles 1diot", m)[1]] == [1, 1, 0]
    assert tox.matches("", m) == (0, []) and tox.surprise(0.5, 0.5) == 0.0 < tox.surprise(1, 0.5) < tox.surprise(1, 0.01)


SYLLABLES = "the and attion to thanedble anea eriner then edinth is thndor thonndon ernd reer thor edtionnt nd sting".split()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_on_the_tables(spark, sf):
    """A single misspelled insult decides, a quoted one does not, and held-out clean texts are left alone."""
    folder = f"/root/testdata/{sf}"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels)
    matcher = model.matcher()
    score = lambda t: float(model.score(model.evidence(*tox.matches(t, matcher)))[0])
    for n in (4, 40, 300):
        text = lambda x: " ".join([*(SYLLABLES * 20)[: n // 2], x, *(SYLLABLES * 20)[: n // 2]])  # noqa: B023, E731
        for wrong in ("idiott", "idoit", "worthles", "wortless", "disgustng", "patetic"):
            assert score(text(wrong)) >= 0.7 or wrong == "idoit", (n, wrong)
        for quoted in ('he said "idiot" to me', '“worthless” was the word', '> a moron\n'):
            assert score(text(f"\n{quoted}")) < 0.7, (n, quoted)
    held = tox.score_texts(docs.withColumn("held", tox.held_out()).join(labels, "doc_id").where("held"), model, ["doc_id", "toxic"]).collect()
    clean, toxic = [r for r in held if not r.toxic], [r for r in held if r.toxic]
    assert sum(r.predicted for r in clean) < 0.003 * len(clean) + 0.01
    assert sum(r.predicted for r in toxic) >= (0.83 if sf == "sf0.01" else 0.9375) * len(toxic) - 1e-9


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        text, toxic = prose(rng, rng.randint(20, 120)), i % 6 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "worthless", "vequ" + rng.choice(["a", "on", "ir", "et"])]))
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = tox.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(held) > 200
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_do_not_matter(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(docs, labels) == tox.fit(docs, flipped)


def test_toxicity_odd_rows(spark, odd_docs, no_docs, labelled):
    _, labels = labelled
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for ls in (labels.limit(0), none, labels):
        rows = tox.toxicity(odd_docs, ls).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert tox.toxicity(no_docs, labels).count() == 0


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_fingerprints(spark, prose):
    rng = random.Random(4)
    docs = {i: prose(rng, rng.randint(0, 400)) for i in range(0, 120, 3)}
    docs[999] = docs[0]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    order, errors = sorted(docs, reverse=True), []
    for k, i in enumerate(order):
        text, after = docs[i], docs[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(rows[i].near_edited - len(a & b) / len(a | b))
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.03
    assert rows[999].fingerprint == rows[0].fingerprint and len(rows[0].fingerprint) == 256


def test_ranges_of_ids_and_of_rows_without_one(spark, prose, monkeypatch):
    """Many small ranges, and a third of all rows without an id: each row's next one by the definition."""
    monkeypatch.setattr(fp, "ROWS", 3)
    monkeypatch.setattr(fp, "FAN", 4)
    rng = random.Random(41)
    rows = [(rng.randint(-(10**12), 10**12), prose(rng, 12)) for _ in range(200)] + [(None, prose(rng, 12)) for _ in range(100)] + [(None, "same text"), (None, "same text"), (7, "x"), (7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from pyspark.sql import functions as F

    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1])) + sorted((r for r in rows if r[0] is None), key=lambda r: (-hashed[r[1]], r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(text) // 3
        want.append((i, hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    got = fp.edited_fingerprints(df)
    assert sorted(((r.doc_id, r.edited_sha256) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_number_of_cuts_below(spark, monkeypatch):
    monkeypatch.setattr(fp, "FAN", 3)
    cuts = sorted(random.Random(42).sample(range(1000), 100))
    got = spark.range(-2, 1003).select("id", fp._below(cuts, __import__("pyspark").sql.functions.col("id")).alias("n")).collect()
    assert all(r.n == sum(c < r.id for c in cuts) for r in got)


def test_fingerprints_odd_rows(odd_docs, no_docs):
    rows = fp.edited_fingerprints(odd_docs).collect()
    assert len(rows) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = [r.fingerprint for r in rows if r.doc_id == 5]
    assert same[0] == same[1]
    assert fp.edited_fingerprints(no_docs).count() == 0
    assert fp.fingerprints(odd_docs).count() == 10


def test_fingerprint_plan_is_native(odd_docs):
    plan = fp.edited_fingerprints(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_single_document(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    r = fp.edited_fingerprints(df).first()
    assert r.edited_sha256 == hashlib.sha256("a b c d e f a b c".encode()).hexdigest() and r.near_next == 1.0


ODD_TEXTS = ["", " ", "  ", "a  b", "\n\n a", "abc\n", " x ", "▁▁a", "<s>hello</s>", "日本語テキスト😀", "a\tb\r\nc", "   lead", "tail   ", "x\0y", "the" * 60, "<0x0A>", "   \n   \n a"]


def test_token_counts_are_the_librarys(prose):
    c = tok.counter(tok.model_path())
    rng = random.Random(5)
    for text in [*ODD_TEXTS, *(prose(rng, 80) for _ in range(40))]:
        assert c.count(text) == len(c.model.encode(text)), text


def test_every_prefix(prose):
    c = tok.counter(tok.model_path())
    rng = random.Random(6)
    for text in [*ODD_TEXTS, *(prose(rng, 25) for _ in range(6))]:
        counts = c.prefix_counts(text)
        assert counts == [len(c.model.encode(text[:k])) for k in range(len(text) + 1)], text
        for budget in (0, 1, 5, 1000):
            assert c.cut(text, budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_token_query(spark, odd_docs, no_docs):
    c = tok.counter(tok.model_path())
    rows = tok.count_tokens(odd_docs, limit=10).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(c.model.encode(r.text or ""))) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in rows)
    assert tok.count_tokens(no_docs).count() == 0
    assert all(len(r.cuts) == 2 for r in tok.token_budgets(odd_docs, [1, 50]).collect())


def test_licenses_base(spark, prose):
    rng = random.Random(7)
    texts = ["", "MIT License", "the mit-license, apache  license; general\npublic\tLICENSE", "éMIT license", "mit der license", "summit license mit licenses", "GENERAL PUBLIC LICENSE general public license"]
    texts += [prose(rng, 60) + rng.choice([" Released under the MIT License.", " Licensed under the Apache License, Version 2.0.", " x"]) + prose(rng, 20) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lower = {i: i + 32 for i in range(65, 91)}
    for r in lic.license_scan(df).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(lower))
        places, labels = [], set()
        for phrase, label in lic.BASE:
            want = phrase.split()
            got = [i for i in range(len(words)) if words[i : i + len(want)] == want]
            places += got
            labels |= {label} if got else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    "text, label",
    [("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"),
     ("the Mozilla Public License, v. 2.0", "mpl-2.0"), ("Redistribution and use in source and binary forms, with or without modification", "bsd"),
     ("All rights reserved.", "proprietary"), ("released into the public domain", "public-domain")],
)
def test_license_rules(text, label):
    assert label in lic.scan(text.lower().encode())["labels"].split(",")


def shortest(parsed) -> list[str]:
    """Texts that a parsed regex matches: of every alternative the first characters, of repeats the fewest."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            # a class of separators gives the space, any other its first character
            first = [chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg if str(o) in ("LITERAL", "RANGE")]
            more = [" " if any(str(o) == "CATEGORY" and "SPACE" in str(a) and "NOT" not in str(a) for o, a in arg) else (first or ["x"])[0]]
        elif name == "BRANCH":
            more = [t for p in arg[1] for t in shortest(p)]
        elif name == "SUBPATTERN":
            more = shortest(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [t * arg[0] for t in shortest(arg[2])] if arg[0] else [""]
        elif name in ("ANY", "NOT_LITERAL"):
            more = ["x"]
        else:
            more = [""]
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_every_license_rule_fires(monkeypatch):
    from re import _parser

    lic.gate()  # of all rules
    for rule in lic.rules():
        texts = [t.encode("latin-1") for t in shortest(_parser.parse(rule.regex.pattern.decode("latin-1")))]
        texts = [t for t in texts if rule.regex.search(t)]
        assert texts, rule
        monkeypatch.setattr(lic, "rules", lambda rule=rule: (rule,))
        assert all(lic.detections(t) for t in texts), (rule, [t for t in texts if not lic.detections(t)])
        monkeypatch.undo()


def test_license_hosts_with_a_hyphen():
    assert lic.scan(b"https://www.ruby-lang.org/en/about/license")["labels"] == "ruby"
    assert lic.scan(b"see https://www.latex-project.org/lppl")["score"] >= 0.9


def test_license_suppression():
    kept = lic.detections(b"licensed under the gnu general public license, version 3.")
    assert [r.label for _, _, r in kept] == ["gpl-3.0"]
    assert len(lic.rules()) > 300 and lic.detections(b"nothing of the kind here") == []


def test_prefilter_loses_nothing(prose):
    rng = random.Random(8)
    for r in lic.rules():
        assert r.stem or any(g in k for k in r.keywords for g in lic.gate()) or all(any(g in k for g in lic.gate()) for k in r.keywords)
    text = prose(rng, 50).lower().encode()
    assert lic.scan(text)["labels"] == ""


def test_license_odd_rows(odd_docs, no_docs):
    assert lic.license_scan(odd_docs).count() == 10 and lic.license_scan(no_docs).count() == 0
