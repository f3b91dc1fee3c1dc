"""URL rules, chat quotations, mixing, the pipeline, and the queries' SQL."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

from formspark.llm import chat, mixing, queries, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, result = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[names.index(c)] for c in got.columns)) for r in result.fetchall())


def judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


URLS = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en", "http://example.com/en/x?y=/es/", "https://a.net/es/", "https://net/fr/1#q", "http://com", "http://com/",
        "http://notexample.com/en/", "http://ÄÖ.com/a", "://a.com/", "a://b://c.com/x", "http://a.com?x/", "http://.com/" + "p/" * 500, "http://" + "a." * 300 + "net/es/1"]
RULES = [*url_filter.RULES, ("block", "com", "/"), ("allow", "a.net", "/e"), ("block", "deep.a.net", "")]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['', 'www.', 'deep.'])}{rng.choice(['example.com', 'a.net', 'b.org'])}/{rng.choice(['en/', 'es/', 'fr', 'e'])}{k}" for k in range(60)]
    rows = [(k, u, 1, "r") for k, u in enumerate(urls)] + [(0, None, 1, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict int, rule string")
    rules = url_filter.rules_frame(spark, [*RULES, (None, "x", "/"), ("block", None, "/")])
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, rules).fillna({"rule": "-"}).collect())
    want = sorted((k, h, p, r or "-", v) for k, u, *_ in rows for h, p, r, v in [judge(u, RULES)])
    assert got == want
    assert url_filter.url_filter(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, rules.limit(0)).collect()} == {"allow"}


CHAT = [
    (1, 0, "user", "Hello there, world!\nHow do I bake bread?"), (1, 1, "assistant", "> How do I bake bread?\nWith flour.\n\nAnd water."),
    (1, 2, "user", "Ann wrote:\n> With flour.\n> \n>And  water\n>> how do i bake bread\nThanks"), (1, 3, "user", "> unknown words\nok"),
    (1, 4, "assistant", "> thanks\nwelcome\n> with flour!"), (1, 5, None, None), (2, 0, "user", ""), (2, 1, "user", "a > b\n  > x"), (None, 0, "user", "> hi"), (3, None, "user", "> yo"),
    (1, 6, "user", "> Welcome"), (2, 2, "user", "x"), (2, 3, "u", "> x"), (2, 3, "u", "> x"), (4, 0, "user", "same"), (4, 1, "user", "same"), (4, 2, "user", ">>> same\r\nyes"),
]


def test_chat(spark):
    df = spark.createDataFrame([(*r, 7) for r in CHAT], "conv_id long, turn long, role string, text string, depth int")
    got = chat.link_quotations(df)
    rows = {(r.conv_id, r.turn): r for r in got.collect()}
    assert got.count() == len(CHAT)
    assert rows[1, 1].text == "With flour.\n\nAnd water." and rows[1, 2].text == "Thanks" and rows[1, 4].text == "welcome"
    parents = {k: r.parent_turn for k, r in rows.items() if r.parent_turn is not None}
    assert parents == {(1, 1): 0, (1, 2): 1, (1, 4): 2, (1, 6): 4, (2, 3): 2, (4, 2): 0}
    assert (rows[1, 6].root_turn, rows[1, 6].depth) == (0, 4) and rows[1, 5].formatted == "<|unknown|>\n"
    order = [(r.conv_id, r.turn) for r in got.where("conv_id = 1").orderBy("conv_id", "root_turn", "depth", "turn").collect()]
    assert all(order.index((1, p)) < order.index(k) for k, p in parents.items() if k[0] == 1)
    assert chat.link_quotations(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHAT)
    result = con.execute(queries.ORACLES["op8_chat_quotes"])
    names = [d[0] for d in result.description]
    assert sorted(repr(tuple(r[names.index(c)] for c in got.columns)) for r in result.fetchall()) == sorted(repr(tuple(r)) for r in got.collect())


def test_quoted_replies_link(spark):
    """Every kind of quotation that the query puts in finds its message; the green SQL is not of empty work."""
    got = queries.QUERIES["chat_quoted_replies"](spark, SF).selectExpr("(conv_id + turn) % 6 AS kind", "turn", "n_quotes", "n_linked", "parent_turn", "depth")
    rows = [r for r in got.collect() if r.turn]
    assert max(r.depth for r in rows) >= 3
    for kind, share in ((0, 1.0), (1, 1.0), (2, 1.0), (3, 0.8), (4, 1.0)):
        of = [r for r in rows if r.kind == kind]
        assert of and sum(r.n_linked for r in of) >= share * sum(r.n_quotes for r in of) > 0
        assert all(r.parent_turn == r.turn - 1 for r in of if kind in (0, 2) and r.parent_turn is not None) or kind not in (0, 2)
    assert all(not r.n_quotes for r in rows if r.kind == 5)


EXCERPTS = [
    (1, 0, "u", "one two three four five six seven eight nine ten\n\nalpha beta gamma\n\nlast words here"),
    (1, 1, "u", "> one two three four\n> five six seven\n> eight nine ten\n>\n> alpha beta\n> gamma\nyes"),  # two of three paragraphs, wrapped anew
    (1, 2, "u", "> three four five six seven eight\nsure"), (1, 3, "u", "> three four five six eleven twelve\nno"), (1, 4, "u", "> seven eight nine\ntoo few"),
]


def test_excerpts_and_paragraphs(spark):
    df = spark.createDataFrame(EXCERPTS, "conv_id long, turn long, role string, text string")
    rows = {r.turn: r for r in chat.link_quotations(df).collect()}
    assert [rows[t].parent_turn for t in range(5)] == [None, 0, 0, None, None]


@pytest.fixture(scope="module")
def mixed(spark, prose):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        kind = 0 if i % 10 == 0 else 1 if i % 7 == 0 else 2
        extra = {0: "zzz qqq", 1: "scum trash", 2: ""}[kind]
        docs.append((i, " ".join([prose(rng, rng.randint(10, 60)), *[extra] * 12])))
        if i % 2:
            labels.append((i, 0 if kind == 0 else 1, int(kind == 1)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(0, 0, 0), (10, 0, 0), (20, 0, 0)], "doc_id long, quality int, toxic int")


def test_mixing_meets_targets(mixed):
    docs, labels = mixed
    got = mixing.mix(docs, labels, {"low": 0.2, "toxic": 0.1, "good": 0.7}).collect()
    assert len(got) == 400 and all(r.rate >= 0 and abs(r.p_low + r.p_toxic + r.p_good - 1) < 1e-9 for r in got)
    everything = sum(r.tokens for r in got)
    for p, share in (("p_low", 0.2), ("p_toxic", 0.1), ("p_good", 0.7)):
        assert abs(sum(r.tokens * r[p] * r.rate for r in got) / everything - share) < 1e-3
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert sum(r.p_toxic > 0.5 for r in got if r.doc_id in toxic) > 0.9 * len(toxic)


def test_rates_are_the_least_squares_solution(spark):
    """An independent solver of min sum t (r - 1)^2 with the same totals and r >= 0, by Newton's method on its dual."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.15, 0.1, 0.9], 3000)
    t = rng.integers(0, 900, 3000)
    rows = [(int(a), *map(float, q)) for a, q in zip(t, p)]
    members = spark.createDataFrame(rows, "tokens long, p_low double, p_toxic double, p_good double")
    rates = mixing.fit_rates(members)
    got = np.array([r.rate for r in members.select(rates.column().alias("rate")).collect()])
    goal = np.array([0.05, 0.01, 0.94]) * t.sum()
    dual = np.zeros(3)
    for _ in range(200):
        r = np.maximum(0, 1 - p @ dual)
        w = np.where(r > 0, t, 0)
        dual += 0.5 * np.linalg.solve((p.T * w) @ p + 1e-6 * np.eye(3), p.T @ (r * t) - goal)
    want = np.maximum(0, 1 - p @ dual)
    assert np.abs(p.T @ (want * t) - goal).max() < 1e-6 * t.sum() and rates.gap <= mixing.TOLERANCE and len(rates.steps) < 8
    assert np.abs(p.T @ (got * t) - goal).max() <= mixing.TOLERANCE * t.sum()
    assert np.abs(got - want)[t > 0].max() < 0.02 and (got[t == 0] == 1).all()


def test_rates_that_cannot_be_met_are_reported(spark):
    members = spark.createDataFrame([(100, 0.0, 0.0, 1.0), (50, 0.5, 0.0, 0.5)], "tokens long, p_low double, p_toxic double, p_good double")
    with pytest.warns(UserWarning, match="miss their targets"):
        rates = mixing.fit_rates(members, {"low": 0.1, "toxic": 0.5, "good": 0.4})
    assert rates.gap > 0.4


def test_memberships_find_the_domains(spark):
    """Held-out recall of every domain on the tables."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = mixing.memberships(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    kind = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    found = F.when(F.col("p_toxic") > 0.5, "toxic").when(F.col("p_low") > 0.5, "low").when(F.col("p_good") > 0.5, "good")
    loss = -F.log(F.when(kind == "toxic", F.col("p_toxic")).when(kind == "low", F.col("p_low")).otherwise(F.col("p_good")))
    rows = {r.k: r for r in got.select(kind.alias("k"), found.alias("f"), loss.alias("l")).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("f") == F.col("k")).alias("right"), F.sum("l").alias("loss")).collect()}
    assert all(r.right >= 0.9 * r.n for r in rows.values()) and sum(r.loss for r in rows.values()) / sum(r.n for r in rows.values()) < 0.15


def test_mixing_is_native(mixed):
    plan = mixing.memberships(*mixed)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_odd_rows(spark, odd_docs, no_docs, mixed):
    _, labels = mixed
    none = spark.createDataFrame([(None, 1, 0), (1, None, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    for ls in (labels, labels.limit(0), none):
        rows = mixing.mix(odd_docs, ls).collect()
        assert len(rows) == 10 and all(r.rate >= 0 for r in rows) and {r.tokens for r in rows if r.doc_id == 1} == {0}
    assert mixing.mix(no_docs, labels).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """A folder with documents, labels and benchmark, and what is planted in them."""
    base = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    clean = [(i, prose(rng, rng.randint(80, 160)), "en", "s") for i in range(240)]
    toxic = [(300 + i, prose(rng, 60) + " " + rng.choice(["scumbag", "worthless"]) + " " + prose(rng, 20), "en", "s") for i in range(60)]
    copies = [(400 + i, clean[i][1], "en", "t") for i in range(10)]
    near = [(420 + i, clean[20 + i][1].replace("river", "River", 1), "en", "t") for i in range(10)]
    passage = prose(rng, 60)
    repeats = [(440 + i, f"{prose(rng, 60)}\n{passage}\n{prose(rng, 60)}", "en", "t") for i in range(5)]
    items = [(k, prose(rng, 25)) for k in range(8)]
    leaks = [(460 + k, f"{prose(rng, 50)}\n{items[k][1]}\n{prose(rng, 50)}", "en", "t") for k in range(8)]
    rows = [(*r, len(r[1])) for r in [*clean, *toxic, *copies, *near, *repeats, *leaks]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in clean] + [(i, 1, 1) for i, *_ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, passage


def test_pipeline(spark, corpus):
    import corpus_pipeline

    base, rows, passage = corpus
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    clean = {r[0] for r in rows if r[0] < 240}
    assert clean <= set(out)
    assert not any(300 <= i < 360 for i in out), "toxic documents go"
    assert not any(400 <= i < 410 for i in out), "one document of each group of copies stays"
    assert not any(460 <= i for i in out), "benchmark leaks go"
    assert passage in out[440].text and not any(passage[60:200] in out[i].text for i in range(441, 445))
    assert all(r.rate >= 0 and r.n_chars == len(r.text) for r in out.values())


def test_pipeline_matches_stage_by_stage(spark, corpus):
    """The whole against brute-force versions of the middle stages on what the first one kept."""
    import corpus_pipeline
    from test_dedup_ops import components, edit, fingerprint, kept

    base, rows, _ = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, base)
    texts = {r.doc_id: r.text for r in first.collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    find = components([(a, b) for a, x in prints.items() for b, y in prints.items() if (x ^ y).bit_count() <= 3])
    second = corpus_pipeline.drop_near_copies(spark, first, base)
    left = {r.doc_id: r.text for r in second.collect()}
    assert left == {i: t for i, t in texts.items() if find(i) == i}
    removed = {i: n for i, _, n, _, _ in kept(list(left.items()))}
    third = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, second, base).collect()}
    assert all(len(left[i].encode()) - len(third[i].encode()) in range(removed[i] - 4, removed[i] + 1) for i in third)
    assert [c for c, _ in second.dtypes] == corpus_pipeline.COLUMNS
    docs3 = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in third.items()], docs.select(*corpus_pipeline.COLUMNS).schema)
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    leaks = {i for i, t in third.items() if any(edit(m, words(t)) <= int(0.2 * len(m)) for m in items)}
    fourth = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark_leaks(spark, docs3, base).collect()}
    assert fourth == {i: t for i, t in third.items() if i not in leaks} and len(leaks) >= 8
    docs4 = docs3.where(~docs3["doc_id"].isin(*leaks))
    fifth = corpus_pipeline.mix_domains(spark, docs4, base).collect()
    assert {r.doc_id: (r.text, r.tokens) for r in fifth} == {i: (t, len(t.split())) for i, t in fourth.items()} and len(fifth) == len(fourth)
    p, t = np.array([(r.p_low, r.p_toxic, r.p_good) for r in fifth]), np.array([r.tokens for r in fifth])
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-9
    # nothing here is of low quality, so that no rates of this corpus meet the target; the rest of the totals follows
    rates = np.array([r.rate for r in fifth])
    assert (rates >= 0).all() and abs((rates * t * p[:, 2]).sum() / t.sum() - 0.94) < 0.02


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs, corpus):
    import corpus_pipeline

    base, *_ = corpus
    everything = sorted((str(r.doc_id) for r in odd_docs.collect()))
    # texts without words are alike to the second stage, and so are a text, its repetition and its near copy
    want = [everything, ["1", "4", "5", "7", "8", "None"], everything, everything, everything]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd_docs, base)
        assert sorted(str(r.doc_id) for r in out.collect()) == want[k], k
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, no_docs, base).count() == 0


def test_pipeline_rows_with_null_or_shared_ids(spark, prose, tmp_path):
    """Distinct clean texts survive whatever their ids; true repeats, near copies and leaks go one by one."""
    import corpus_pipeline

    rng = random.Random(12)
    texts = [prose(rng, 120) for _ in range(16)]
    leaks = [prose(rng, 30) for _ in range(2)]
    ids = [None] * 5 + [7] * 5 + [*range(20, 26)]
    rows = list(zip(ids, texts))
    rows += [(None, texts[0]), (7, texts[5]), (None, texts[10]), (30, texts[11])]  # repeats, and copies of 20 and 21
    rows += [(None, texts[0] + " " + leaks[0] + " " + texts[1]), (7, texts[5] + " " + leaks[1] + " " + texts[6])]
    base = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20, 26)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(list(enumerate(leaks)), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    named = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    clean, leaky = sorted(zip(ids, texts), key=repr), rows[-2:]
    assert named(corpus_pipeline.drop_near_copies(spark, docs, base)) == sorted(clean + leaky, key=repr)
    assert named(corpus_pipeline.drop_benchmark_leaks(spark, docs, base)) == sorted(rows[:-2], key=repr)
    mixed = corpus_pipeline.mix_domains(spark, docs, base).collect()
    assert len(mixed) == len(rows) and all(r.tokens >= 100 and r.rate is not None and abs(r.p_low + r.p_toxic + r.p_good - 1) < 1e-9 for r in mixed)
    out = corpus_pipeline.run(spark, base).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted(ids, key=repr) and all(r.rate is not None for r in out)


def test_names_and_registry():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
