import pytest
from pyspark.sql import functions as F

from textloom.operators.checks import IntegrityError
from textloom.sources import config, readers, sheets, writers
from textloom.streaming import resume


def test_notes_from_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text('person_id,Visit_DateTime,doc_text,doc_id\n1,86400000,"two\nlines, ""quoted""",7.0\n1,0,x,\n')
    rows = readers.read_notes(spark, str(tmp_path / "n.csv")).orderBy("ord").collect()
    assert [(r["person_id"], str(r["visit_ts"]), r["doc_id"], r["text"]) for r in rows] == [(1, "1970-01-02 00:00:00", 7, 'two\nlines, "quoted"'), (1, "1970-01-01 00:00:00", None, "x")]


def test_bad_notes_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_notes(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.csv").write_text("person_id,doc_text\n1,x\n")
    with pytest.raises(IntegrityError, match="Visit_DateTime"):
        readers.read_notes(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("person_id,Visit_DateTime,doc_text\n1,soon,x\n")
    with pytest.raises(IntegrityError, match="1 rows"):
        readers.read_notes(spark, str(tmp_path / "b.csv"))


def test_json_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    assert readers.read_json_lines(spark, path, readers.TIMELINE).count() == 0
    df = spark.createDataFrame([(1, [("2020-01-01 00:00:00", "é")])], readers.TIMELINE)
    writers.write_json_lines(df, path)
    assert readers.read_json_lines(spark, path, readers.TIMELINE).collect() == df.collect()
    assert readers.read_corpus(spark, path, 1, 1).first()["text"] == "é"
    with pytest.raises(IntegrityError):
        readers.read_corpus(spark, path, 2)
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "bad.json"), readers.TIMELINE).collect()


def test_checkpoint_ids(spark, tmp_path):
    path = str(tmp_path / "done")
    assert readers.read_processed_ids(spark, path).count() == 0
    for _ in range(2):
        writers.append_ids(spark.createDataFrame([(3,), (4,)], "person_id long"), path)
    assert sorted(r["person_id"] for r in readers.read_processed_ids(spark, path).collect()) == [3, 4]
    (tmp_path / "x.txt").write_text("5\nfive\n")
    with pytest.raises(Exception):
        readers.read_processed_ids(spark, str(tmp_path / "x.txt")).collect()


def test_evidence_cells(spark):
    rows = spark.createDataFrame([('[{"visit_index": 1, "evidence_snippet": "a"}]',), ("[{'visit_index': 2, 'evidence_snippet': 'b'}]",), (None,)], "evidence string")
    assert [[e["visit_index"] for e in r["evidence"]] for r in readers.parsed_evidence(rows).collect()] == [[1], [2], []]
    with pytest.raises(Exception):
        readers.parsed_evidence(spark.createDataFrame([("nothing",)], "evidence string")).collect()


def test_ranking_files_prune(spark, tmp_path):
    df = spark.createDataFrame([("bm25", "full", 1, "i", 2, k, 0.5, False) for k in range(1, 9)], "retriever string, search_space string, question_id long, index_id string, doc_id long, rank int, score double, is_gold boolean")
    writers.write_ranking(df, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).filter("retriever = 'bm25' and rank <= 5")
    assert back.count() == 5
    assert "PushedFilters: [IsNotNull(rank), LessThanOrEqual(rank,5)]" in back._jdf.queryExecution().toString()


def test_writing_resumes(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert writers.write_missing(df.filter("k < 3"), str(tmp_path / "p"), ["k"]).count() == 3
    writers.write_missing(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_digests_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    digest = config.sha256_of(str(tmp_path / "a.txt"))
    files = readers.file_digests(spark, str(tmp_path))
    assert files.first()["sha256"] == digest
    manifest = spark.createDataFrame([("a.txt", digest), ("b.txt", "0")], "name string, sha256 string")
    assert [r["name"] for r in readers.manifest_mismatches(files, manifest).collect()] == ["b.txt"]
    with pytest.raises(ValueError):
        config.require_digest(str(tmp_path / "a.txt"), "0")


def test_flat_config(tmp_path):
    (tmp_path / "c").write_text("# note\nA: 1\nB: two # x\n")
    assert config.read_flat_config(str(tmp_path / "c"), {"A": "9"}) == {"A": "9", "B": "two"}
    (tmp_path / "d").write_text("oops\n")
    with pytest.raises(ValueError):
        config.read_flat_config(str(tmp_path / "d"), {})


def test_text_export(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "b"), (0, "a")], "visit_index int, block string")
    writers.write_text(blocks, str(tmp_path / "t"), "visit_index")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        writers.write_text(blocks.filter("visit_index > 5"), str(tmp_path / "u"), "visit_index")


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    schema = spark.range(1).schema
    for part in (range(0, 5), range(3, 8)):
        spark.createDataFrame([(k,) for k in part], schema).coalesce(1).write.mode("append").parquet(src)
        resume.process_available(resume.stream_files(spark, src, schema), lambda df: df.withColumn("double", F.col("id") * 2), out, check, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_windowed_counts_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "e")
    e = spark.createDataFrame([(0, "a"), (30, "a"), (70, "b"), (7200, "a")], "s long, kind string").select(F.timestamp_seconds("s").alias("ts"), "kind")
    e.coalesce(1).write.parquet(src)
    q = resume.windowed_counts(resume.stream_files(spark, src, e.schema), "ts", "1 minute", "10 minutes", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM counts").collect()) == [1, 1, 2]


def test_spreadsheets(spark, tmp_path):
    rows = [("a & <b> \x01 _x0041_", 1, 0.5, True), (None, None, None, None), ("", -3, 1e300, False), (" é\n\"q\" ", 2**53 + 1, -0.1, True)]
    df = spark.createDataFrame(rows, "t string, n long, x double, b boolean")
    sheets.write_spreadsheet(df, str(tmp_path / "a.xlsx"), 'it & "ems"')
    back = sheets.read_spreadsheet(spark, str(tmp_path / "a.xlsx"), "b boolean, t string, n long, x double", 'it & "ems"')
    assert [(r["t"], r["n"], r["x"], r["b"]) for r in back.collect()] == rows
    with pytest.raises(ValueError):
        sheets.read_spreadsheet(spark, str(tmp_path / "a.xlsx"), "other string")


def test_sheet_with_shared_strings(spark, tmp_path):
    import zipfile

    main, office = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="x" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>k</t></si><si><r><t>on</t></r><r><t>e</t></r></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row><c r="C3"><v>8</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in sheets.read_spreadsheet(spark, str(tmp_path / "s.xlsx"), "k string, v int").collect()] == [("one", 7), (None, 8)]


def test_shards_are_redone_where_they_are_not_whole(spark, tmp_path):
    path = str(tmp_path / "shards")
    df = spark.createDataFrame([(k, f"v{k}") for k in range(200)], "k long, v string")
    assert writers.write_shards(df, path, ["k"], 5) == [0, 1, 2, 3, 4] and writers.write_shards(df, path, ["k"], 5) == []
    for part in (tmp_path / "shards" / "shard=3").glob("*.parquet"):
        part.write_bytes(b"not parquet")
    for crc in (tmp_path / "shards" / "shard=3").glob(".*.crc"):
        crc.unlink()
    writers.delete(spark, f"{path}/shard=1")
    assert writers.write_shards(df, path, ["k"], 5) == [1, 3]
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == sorted((k, f"v{k}") for k in range(200))


def test_files_protocols_and_copies(spark, tmp_path):
    (tmp_path / "from").mkdir()
    (tmp_path / "from" / "p.yaml").write_text("version: 2\nbudget: 3500 # tokens\nruns:\n  - a: 1\n")
    digest = config.sha256_of(str(tmp_path / "from" / "p.yaml"))
    copy = lambda: config.copy_verified(str(tmp_path / "from"), str(tmp_path / "to"), {"p.yaml": digest})
    assert copy() == ["p.yaml"] and copy() == []
    assert config.read_protocol(str(tmp_path / "to" / "p.yaml"), digest, "2")["budget"] == "3500"
    with pytest.raises(ValueError):
        config.read_protocol(str(tmp_path / "to" / "p.yaml"), digest, "3")
    with pytest.raises(ValueError):
        config.copy_verified(str(tmp_path / "from"), str(tmp_path / "to"), {"p.yaml": "0"})
    assert readers.require_file(spark, str(tmp_path / "to" / "p.yaml"), digest, 48) and config.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(IntegrityError):
        readers.require_file(spark, str(tmp_path / "to" / "p.yaml"), size=1)


def test_vectors_must_be_contiguous(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 2.0]), (2, [1.0, 2.0])], "row long, vector array<double>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(IntegrityError):
        readers.read_vectors(spark, str(tmp_path / "v"), 2)
    with pytest.raises(IntegrityError):
        readers.read_vectors(spark, str(tmp_path / "v"), 3)


def test_sessions_of_events_equal_the_sql(spark, tmp_path):
    """Thirty days in files of one range of days each, gaps of exactly six hours and just under, equal times, no user and no time."""
    import duckdb

    from textloom.plans import catalog

    rows = [(k, (k * 7919) % 2592000, (k % 9) or None) for k in range(3000)]
    rows += [(5000 + k, at, 77) for k, at in enumerate((0, 21600, 43199, 43199, 64799, 90000, 111600, 133200, None, None))]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long")
    df.selectExpr("event_id", "CAST(timestamp_seconds(1704067200 + s) AS timestamp_ntz) AS ts", "user_id", "'click' AS event_type", "1.5D AS value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalog.QUERIES["stream_sessions"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLE_SQL["stream_sessions"]).fetchall(), key=str)
