"""Sequences, votes and merges against plain Python models, geometry on small arrays."""

import random

import numpy as np
from pyspark.sql import functions as F

from formspark.operators import geometry as G
from formspark.operators import match as J
from formspark.operators import merge as M
from formspark.operators import quality as Q
from formspark.operators import recognise as R
from formspark.operators import sequence as W
from formspark.operators import vote as V


def pages(seed, n=60):
    rng = random.Random(seed)
    out = []
    for page in range(n):
        base, size = rng.randint(1, 500), rng.randint(1, 12)
        for i in range(size):
            kind = rng.random()
            serial = None if kind < 0.25 else rng.randint(1, 3000) if kind < 0.35 else base + i - (kind < 0.45)
            out.append((page, i, serial))
    return out


def grouped(rows):
    out = {}
    for page, i, s in sorted(rows):
        out.setdefault(page, []).append(s)
    return out


def filled(values):
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        if v is None and known:
            near = [k for k in known if k[0] < i][-1:] or known[:1]
            v = near[0][1] + i - near[0][0]
        out.append(v)
    return out


def test_inference(spark):
    rows = pages(1)
    df = spark.createDataFrame(rows, "page int, cell int, serial long")
    got = grouped([(r.page, r.cell, r.inferred) for r in W.infer_serials(df, ["page"], ["cell"]).collect()])
    assert got == {p: filled(v) for p, v in grouped(rows).items()}


def test_longest_run(spark):
    rows = pages(2) + [(99, 0, 5), (99, 1, 5), (99, 2, 7)]
    df = spark.createDataFrame(rows, "page int, cell int, serial long")
    got = {r.page: (r.run_start, r.run_length) for r in W.longest_run(df, ["page"]).collect()}
    for page, values in grouped(rows).items():
        known, best = sorted(v for v in values if v is not None), None
        start = 0
        for i in range(len(known)):
            if i and known[i] != known[i - 1] + 1:
                start = i
            if best is None or i - start + 1 > best[1]:
                best = (known[start], i - start + 1)
        assert got.get(page) == best


def test_duplicates_and_gaps(spark):
    rows = [(0, 0, 1), (0, 1, 2), (0, 2, 2), (0, 3, 4), (1, 0, 7), (1, 1, 7), (1, 2, 8), (2, 0, None), (3, 0, 4)]
    df = spark.createDataFrame(rows, "page int, cell int, serial long")
    got = grouped([(r.page, r.cell, r.repaired) for r in W.repair_duplicates(df, ["page"], ["cell"]).collect()])
    assert got == {0: [1, 2, 3, 4], 1: [7, 8, 8], 2: [None], 3: [4]}
    assert {r.page: (r.gaps, r.n_missing) for r in W.serial_gaps(df, ["page"]).collect()} == {0: ([3], 1), 1: ([], 0), 3: ([], 0)}


def test_a_stray_serial_costs_nothing(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (0, 2, 7), (0, 3, 900_000_000)], "page int, cell int, serial long")
    assert [(r.gaps, r.n_missing) for r in W.serial_gaps(df, ["page"]).collect()] == [([6], 900_000_000 - 5 - 2)]
    assert grouped([(r.page, r.cell, r.repaired) for r in W.repair_duplicates(df, ["page"], ["cell"]).collect()]) == {0: [5, 6, 7, 900_000_000]}


def test_duplicate_repair_by_its_definition(spark):
    """Against sets of free numbers, on random pages of few numbers."""
    rng = random.Random(5)
    rows = [(p, i, rng.choice([None, *range(1, 9)])) for p in range(150) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "page int, cell int, serial long").repartition(3)
    got = grouped([(r.page, r.cell, r.repaired) for r in W.repair_duplicates(df, ["page"], ["cell"]).collect()])
    for page, values in grouped(rows).items():
        given = [v for v in dict.fromkeys(values) if v is not None]
        free = set(range(min(given, default=0), max(given, default=0))) - set(given)
        now = list(values)
        for v in given:
            spots = [i for i, x in enumerate(values) if x == v]
            if len(spots) > 1 and free:
                number = min(free, key=lambda g: (abs(g - v), g))
                free.discard(number)
                now[min(spots, key=lambda i: (abs(i - (number - min(given))), i))] = number
            elif len(spots) > 1:
                now = filled([None if i in spots[1:] else x for i, x in enumerate(now)])
        assert got[page] == now, (page, values)


def test_samples_and_distinct_values(spark):
    rows = [(i % 3 or None, i, None if i % 5 == 0 else f"v{i % 40:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "part int, k int, v string")
    got = {r.part: (r["sample"], r.n_all) for r in Q.samples(df, F.col("v"), ["k"], ["part"], 4).collect()}
    for part in (None, 1, 2):
        want = [v for p, _, v in rows if p == part and v]
        assert got[part] == (want[:4], len(want))
    values = sorted((r.field, r.value) for r in Q.distinct_values(df, ["v", "part"], {"v": 3}).collect())
    assert values == [("part", ""), ("part", "1"), ("part", "2"), ("v", ""), ("v", "v01"), ("v", "v02")]


def test_votes(spark):
    rows = [(0, 0, "RVJ0000001", 60.0), (0, 1, "RVJ0000002", 90.0), (0, 2, "RVJ0000001", 50.0), (1, 0, "", 0.0), (1, 1, "x", 99.0), (1, 2, "y", 1.0), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "cell int, reader_ord int, value string, confidence double")
    assert {r.cell: r.voted for r in V.majority(df, ["cell"]).collect()} == {0: "RVJ0000001", 1: "x", 2: ""}
    got = {r.cell: (r.voted, r.voted_confidence) for r in V.confidence_vote(df, ["cell"]).collect()}
    assert got == {0: ("RVJ0000001", 70.0), 1: ("", 0.0), 2: ("", 0.0)}


def test_match_order(spark):
    page, left = ["page"], "page int, cell_index long, epic_id string, epic_confidence double, serial_no string"
    right = "page int, cell_index long, epic_id string, serial_no string, name string, relation string"
    records = spark.createDataFrame([(1, 0, "A", 90.0, "1"), (1, 1, "B", 75.0, "2"), (1, 2, "", 100.0, "3"), (1, 3, "Z", 100.0, "9"), (1, 4, None, 0.0, None)], left)
    entries = spark.createDataFrame([(1, 0, "A", "1", "n0", "r0"), (1, 1, "C", "5", "n1", "r1"), (1, 2, "B", "3", "n2", "r2"), (1, 3, "", "", "n3", "r3"), (1, 7, "A", "", "n7", "r7")], right)
    got = {r.cell_index: (r.name, r.relation, r.match_method) for r in J.match_records(records, entries, page).collect()}
    assert got == {0: ("n7", "r7", "id"), 1: ("n1", "r1", "position_override"), 2: ("n2", "r2", "serial"), 3: ("n3", "r3", "position"), 4: ("", "", "")}


def test_merge_keeps_every_row(spark):
    df = spark.createDataFrame([("2", "10", 0), ("2", "x", 1), ("10", "1", 2), ("", None, 3)], "part_no string, serial_no string, k int")
    assert [r.k for r in M.merged_all(df, ties=["k"]).collect()] == [0, 1, 2, 3]
    assert [r.k for r in M.page_order(df, ties=["k"]).collect()] == [1, 3, 2, 0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page int, cell int, serial long, value string, reader_ord int, confidence double")
    assert W.infer_serials(none, ["page"], ["cell"]).count() == 0
    assert W.correct_strays(none, ["page"], ["cell"]).count() == 0
    assert W.repair_duplicates(none, ["page"], ["cell"]).count() == 0
    assert V.majority(none, ["cell"]).count() == 0
    assert Q.fill_rates(none, ["value"]).first()["pct"] == 0.0


def test_geometry():
    assert G.group_positions([1, 2, 3, 40, 41, 100]) == [2, 40, 100]
    assert G.four_boundaries([0, 10, 50, 90, 100], 100) in ([0, 10, 50, 95], [5, 50, 90, 100])
    assert G.four_boundaries([5], 100) == [2, 34, 66, 98]
    assert G.inner_lines([0, 10, 33, 50, 66, 99], 99) == [0, 33, 66, 99]
    assert len(G.proportional_grid(1000, 700)) == 30
    page = np.full((1000, 700), 255, np.uint8)
    for y in range(30, 971, 94):
        page[y : y + 3, 10:690] = 0
    for x in (12, 235, 460, 685):
        page[30:970, x : x + 3] = 0
    boxes = G.detect_grid(page)
    assert len(boxes) == 30 and boxes[0][:2] == (13, 31)
    assert G.is_empty_cell(page[40:120, 20:230]) and not G.is_empty_cell(np.zeros((50, 50), np.uint8)) and G.is_empty_cell(np.zeros((5, 50), np.uint8))


def ruled(gaps=0, boxes=False):
    """A page of three columns and ten rows, its lines broken by gaps, or its cells drawn as boxes of their own."""
    page = np.full((1000, 700), 255, np.uint8)
    if boxes:
        for r in range(10):
            for c in range(3):
                y, x = 20 + r * 96, 15 + c * 225
                page[y : y + 90, x : x + 215] = 0
                page[y + 2 : y + 88, x + 2 : x + 213] = 255
        return page
    for y in range(30, 971, 94):
        page[y : y + 3, 10:690] = 0
    if gaps:
        for x in range(60, 690, 60):
            page[:, x : x + gaps] = 255
    return page


def test_lines_with_gaps_and_boxes():
    whole = G.detect_grid(ruled())
    assert len(whole) == 30 and [b[1] for b in G.detect_grid(ruled(gaps=12))] == [b[1] for b in whole]
    assert G.line_positions(ruled(gaps=12) <= 128, 1, 100, 0.3) == [] and G.bridged_positions(ruled(gaps=30) <= 128, 1, 120) == []
    boxes = G.sized_boxes(G.enclosed_boxes(ruled(boxes=True) <= 128), 1000, 700)
    assert len(boxes) == 30 and boxes[0] == (17, 22, 228, 108) and boxes[4] == (242, 118, 453, 204)
    text = np.full((1000, 700), 255, np.uint8)
    text[::40, 20:680:4] = 0  # thin strokes with short gaps are no line
    assert G.bridged_positions(text <= 128, 1, 141) == [] and len(G.detect_grid(text)) == 30


def test_runs_of_pixels():
    rng = np.random.default_rng(3)
    dark = rng.random((60, 90)) < 0.8
    for run in (1, 4, 9):
        want = []
        for y, row in enumerate(dark):
            cover = 0
            for part in "".join("x" if v else " " for v in row).split():
                cover += len(part) if len(part) >= run else 0
            if cover > 0.5 * 90:
                want.append(y)
        assert G.line_positions(dark, 1, run, 0.5) == G.group_positions(want)
        assert G.line_positions(dark.T, 0, run, 0.5) == G.group_positions(want)


def test_column_edges_from_ink():
    ink = np.array([0] * 12 + [50] * 80 + [0] * 6 + [50] * 80 + [0] * 2 + [50] * 5 + [0] * 10)
    assert G.density_boundaries(ink) == [12, 95, 185]
    assert G.density_boundaries(np.full(50, 99)) == [] and G.density_boundaries(np.array([])) == []


def test_preprocessing():
    light = np.linspace(60, 250, 200)[None, :].repeat(120, axis=0)
    page = light.copy()
    page[40:60, 20:180] -= 45  # a stroke that no single threshold finds under uneven light
    out = G.preprocessed(page.astype(np.uint8))
    assert (out[48:52, 30:170] == 0).mean() > 0.9 and (out[:20] == 255).mean() > 0.9
    assert set(np.unique(G.preprocessed(page.astype(np.uint8), adaptive=False))) <= {0, 255}


def test_first_image(spark):
    import zlib

    page = np.arange(12, dtype=np.uint8).reshape(3, 4)
    head = b"%%PDF-1.4\n5 0 obj <</Type /XObject /Subtype /Image /Width 4 /Height 3 /ColorSpace %s /BitsPerComponent 8 %s>>\nstream\n"
    doc = head % (b"/DeviceGray", b"/Filter /FlateDecode") + zlib.compress(page.tobytes()) + b"\nendstream"
    assert (G.first_image(doc) == page).all()
    assert (G.first_image(head % (b"/DeviceRGB", b"") + page.repeat(3).tobytes()) == page).all()
    for bad in (b"no image", head % (b"/DeviceGray", b"/Filter /DCTDecode") + b"x"):
        try:
            G.first_image(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    rows = G.page_images(spark.createDataFrame([("a.pdf", doc)], "path string, content binary")).collect()
    assert [(r.page_key, r.height, r.width, bytes(r.pixels)) for r in rows] == [("a.pdf", 3, 4, page.tobytes())]


def test_page_cells_and_readings(spark):
    blank = np.full((300, 240), 255, np.uint8).tobytes()
    df = spark.createDataFrame([("p", blank, 300, 240)], "page_key string, pixels binary, height int, width int")
    got = G.page_cells(df).collect()
    assert len(got) == 30 and all(r.empty for r in got)
    cells = spark.createDataFrame([("p", b"RVJ0000001"), ("q", None)], "k string, content binary")
    out = R.readings(cells, R.PassThrough, "id", ["plain", "scaled"], ["k"], good=lambda t: len(t) == 10)
    assert sorted((r.k, r.reader_ord, r.value) for r in out.collect()) == [("p", 0, "RVJ0000001"), ("q", 0, ""), ("q", 1, "")]


def test_cross_check(spark):
    df = spark.createDataFrame([("A", "B", "'12", "12 ", True), ("A", "", "", "5", True), ("A", "B", "", "", False)], "a string, b string, h string, g string, p boolean")
    c = F.col
    status, notes = J.cross_check({"epic": c("a"), "house": c("h"), "serial": F.lit(""), "name": F.lit("")}, {"epic": c("b"), "house": c("g"), "serial": F.lit("1"), "name": F.lit("x")}, c("p"))
    assert [tuple(r) for r in df.select(status, notes).collect()][0] == ("REVIEW", "id: A vs B")
    assert [r[0] for r in df.select(status).collect()] == ["REVIEW", "OK", "UNVERIFIED"]
