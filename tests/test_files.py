"""Files in and out: CSV contract, manifests, incremental streams, queue and command line."""

from pyspark.sql import functions as F

from formspark import cli, jobs
from formspark.sources import files, sinks
from formspark.streaming import incremental


def write(path, header, *lines):
    path.write_text("﻿" + ",".join(header) + "\n" + "\n".join(lines) + "\n", encoding="utf-8")


def test_record_files(spark, tmp_path):
    write(tmp_path / "a_page_2.csv", files.RECORD_COLUMNS, '1,2,x,,"Asha, ""A""","t\nu",,,,,,,,')
    write(tmp_path / "a_page_10.csv", files.RECORD_COLUMNS + files.CHECK_COLUMNS, "1,2,3,,,,,,,,,,,,OK,note")
    write(tmp_path / "b.csv", files.RECORD_COLUMNS)
    rows = {r["page"]: r for r in files.record_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {2, 10} and rows[2]["part_key"] == "a"
    assert rows[2]["Name (English)"] == 'Asha, "A"' and rows[2]["Name (Tamil)"] == "t\nu" and rows[2]["EPIC ID"] == "" and rows[2]["Cross_Check"] == ""
    assert rows[10]["Cross_Check_Notes"] == "note"


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "10", 'q"x', "5"), ("1", "", "b", ""), ("1", "2", None, "'7")], "p string, s string, n string, h string")
    out = sinks.record_rows(df, {"Part No": "p", "Serial No": "s", "Name (English)": "n", "House No": "h"})
    sinks.write_merged(out, str(tmp_path / "m"))
    back = files.record_files(spark, str(tmp_path / "m")).orderBy(F.expr("try_cast(`Serial No` as int)").asc_nulls_last()).collect()
    assert [(r["Serial No"], r["Name (English)"], r["House No"]) for r in back] == [("2", "", "'7"), ("10", 'q"x', "'5"), ("", "b", "")]
    sinks.write_pages(out.withColumn("page", F.lit(1)), str(tmp_path / "pages"), ["page"])
    assert spark.read.option("header", True).csv(str(tmp_path / "pages")).count() == 3
    lines = list(sinks.download(out.orderBy("Serial No")))
    assert lines[0].startswith("﻿AC No,Part No") and len(lines) == 4


def test_stream_sees_files_once(spark, tmp_path):
    src, done = tmp_path / "in", tmp_path / "done"
    src.mkdir()
    (src / "1.csv").write_text("1,a\n2,b\n")

    def step(batch, _):
        sinks.append_manifest(batch, str(done))

    for k in range(2):
        incremental.stream_new_files(spark, str(src), "key int, v string", str(tmp_path / "ck"), step)
        (src / f"{k + 2}.csv").write_text(f"{k + 10},c\n")
    assert sorted(r.key for r in spark.read.parquet(str(done)).collect()) == [1, 2, 10]
    work = spark.createDataFrame([(1,), (10,), (11,)], "key int")
    assert [r.key for r in incremental.pending(work, spark.read.parquet(str(done)), "key").collect()] == [11]


def test_documents_and_names(spark, tmp_path):
    name = "2024-EROLLGEN-S22-188-MDU-FinalRoll-Revision1-ENG-101-WI_page_3.pdf"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / name).write_bytes(b"x")
    (tmp_path / "other.pdf").write_bytes(b"y")
    docs = files.documents(spark, str(tmp_path))
    assert docs.count() == 2
    r = files.page_metadata(docs).first()
    assert (r.year, r.state_code, r.ac_no, r.part_no, r.page_no) == ("2024", "22", "188", "101", 3)
    assert files.page_metadata(docs, "TAM").count() == 0


def test_queue(spark, tmp_path):
    seen = []

    def work(_, directory):
        seen.append(directory)
        if directory == "bad":
            raise RuntimeError("no")

    q = jobs.Queue(spark, str(tmp_path / "log"), [("merge", work)])
    assert q.add("AC-1") and q.add("bad") and q.add("AC-1") is None
    q.run()
    assert seen == ["AC-1", "bad"]
    assert sorted((r.directory, r.status, r.error) for r in q.items().collect()) == [("AC-1", "done", ""), ("bad", "failed", "no")]
    assert sorted(list(v)[-1] for v in q.lines.values()) == ["AC-1 is done", "merge of bad failed: no"]
    assert [r.directory for r in q.registry(1).collect()] == ["bad"]
    for k in range(jobs.KEPT + 5):
        q.say(f"item {k}", "x")
    for _ in range(jobs.LINES + 5):
        q.say("item 50", "y")
    assert len(q.lines) == jobs.KEPT and len(q.lines["item 50"]) == jobs.LINES


def test_cli(spark, tmp_path):
    write(tmp_path / "a_page_1.csv", files.RECORD_COLUMNS, "1,2,3,RVJ0000001,A,,,,Father,,20,Male,,", "1,3,1,,B,,,,,,,,,")
    assert cli.main(["merge", str(tmp_path), str(tmp_path / "out"), "--part", "2-2"], spark) == 0
    assert files.record_files(spark, str(tmp_path / "out")).count() == 1
    assert cli.main(["analyze", str(tmp_path / "a_page_1.csv")], spark) == 0


def test_cli_options(spark, tmp_path, capsys):
    for ac in ("AC-1", "AC-2"):
        (tmp_path / ac).mkdir()
        for page in (1, 2):
            write(tmp_path / ac / f"{ac}_page_{page}.csv", files.RECORD_COLUMNS, f"{ac[3:]},{page},3,RVJ0000001,A,,,,Father,,20,Male,,")
    out = str(tmp_path / "out")
    assert cli.main(["merge", str(tmp_path), out, "--all"], spark) == 0 and "2 parts merged, 0 left" in capsys.readouterr().out
    assert files.record_files(spark, out).count() == 4
    assert cli.main(["merge", str(tmp_path), out, "--all"], spark) == 0 and "0 parts merged, 2 left" in capsys.readouterr().out
    assert cli.main(["merge", str(tmp_path), out, "--all", "--force", "--cross-check"], spark) == 0 and "2 parts merged, 0 left" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(out).columns == [*files.RECORD_COLUMNS, *files.CHECK_COLUMNS]
    assert spark.read.parquet(f"{out}.manifest").count() == 4 and spark.read.option("header", True).csv(f"{out}.parts").count() == 4
    assert cli.main(["preview", str(tmp_path), "--all", "--dry-run"], spark) == 0 and "and 0 more" in capsys.readouterr().out
    args = cli.parser().parse_args(["preview", str(tmp_path), "--all", "--validate"])
    assert cli.selected(spark, args).count() == 1


def test_pages_and_legacy(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one\ftwo\fthree"), ("b", None)], "doc string, text string")
    pages = files.split_pages(docs, skip_pages=1).drop("text")
    assert sorted(map(tuple, pages.collect())) == [("a", "three", 3), ("a", "two", 2)]
    assert sinks.write_split_pages(pages, str(tmp_path / "p"), "doc") == 2
    assert sinks.write_split_pages(files.split_pages(docs).drop("text"), str(tmp_path / "p"), "doc") == 2
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    new, old = spark.createDataFrame([(1, "n")], "k int, v string"), spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    assert sorted(map(tuple, files.with_legacy(new, old, "k").collect())) == [(1, "n"), (2, "o")]
    assert files.valid_directory("AC-188") and not any(map(files.valid_directory, ("AC-", "AC-1888", "AC-x", "ac-1", "AC-١")))


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("[OK] x\nfailed\nplain\n")
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.txt").write_text("no")
    listing = files.log_listing(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(r["name"] for r in listing.collect()) == ["a.log", "b.json"]
    tail = files.tail(files.log_lines(spark, str(tmp_path / "a.log")), ["line_no"], 2).collect()
    assert [(r.line, r.severity) for r in tail] == [("plain", ""), ("failed", "error")]
    try:
        files.log_lines(spark, f"{tmp_path}/../x")
        raise AssertionError
    except ValueError:
        pass


def test_manifest_moves(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "old"))
    for _ in range(2):
        assert incremental.migrated(spark, str(tmp_path / "old"), str(tmp_path / "new")).count() == 3
    incremental.reset(spark, str(tmp_path / "new"), F.col("id") > 0)
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2
