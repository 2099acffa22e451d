"""Readers, writers and streams over small files."""

import gzip
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import types as T

from pyspark.sql import functions as F

from quernel.sources import readers, sinks
from quernel.sources.versions import Conflict, VersionedTable
from quernel.streaming import upsert

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n{"id": "b", "n": \n{"id": "a", "n": 3}\n')
    return str(p)


def test_jsonl(spark, lines, tmp_path):
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, lines, SCHEMA).collect()
    assert readers.jsonl_tolerant(spark, lines, SCHEMA).count() == 2
    assert readers.jsonl_tolerant(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0
    rows = readers.jsonl_enumerated(spark, lines, SCHEMA).orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [1, 2, 3] and rows[1]["bad"] is not None and rows[0]["bad"] is None
    assert {(r["id"], r["n"]) for r in readers.jsonl_parts(spark, lines, SCHEMA, "id").collect()} == {("a", 3)}


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    """As Python numbers them, with empty lines, in files of many splits, one, and none."""
    bodies = {"a.txt": "\n".join("" if i % 7 == 3 else f"line {i} " + "x" * (i % 90) for i in range(4000)) + "\n", "b.txt": "one\r\ntwo\r\n\r\nthree", "c.txt": "", "d.txt": "\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("x\ny\n")
    want = {(n, i, l.rstrip("\r\n")) for n in [*bodies, "e.txt.gz"] for i, l in enumerate(gzip.open(tmp_path / n, "rt", newline="\n") if n.endswith("gz") else open(tmp_path / n, newline="\n"), 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for most in (0, readers.BROADCAST_SPLITS):
            lines = readers.numbered_lines(spark, f"{tmp_path}/*", most)
            assert spark.read.text(f"{tmp_path}/a.txt").select("_metadata.file_block_start").distinct().count() > 3
            assert {(r["path"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in lines.collect()} == want
            assert lines.count() == len(want)
        assert readers.most_splits(spark, f"{tmp_path}/*") >= spark.read.text(f"{tmp_path}/*").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        for k, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before):
            spark.conf.set(k, v)


def test_a_bad_line_fails_with_its_place(spark, lines):
    with pytest.raises(Exception, match=r"invalid JSON at .*a\.jsonl:2"):
        readers.jsonl_strict(spark, lines, SCHEMA).collect()


def test_csv_with_mark_and_lacking_column(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("\ufeffid,n\na,1\n")
    assert readers.csv_checked(spark, str(p), ["id", "n"]).first()["id"] == "a"
    with pytest.raises(ValueError, match="lacks"):
        readers.csv_checked(spark, str(p), ["z"])
    assert readers.manifest(spark, str(p), SCHEMA).first()["line_no"] == 2


def test_manifest_numbers_the_lines_of_each_file(spark, tmp_path):
    for name in ("a", "b"):
        rows = "".join(f'"{name}{i}\nx",{i}\n' for i in range(500))
        (tmp_path / f"{name}.csv").write_text("id,n\n" + rows)
    got = readers.manifest(spark, f"{tmp_path}/*.csv", SCHEMA).collect()
    assert len(got) == 1000 and all(r["line_no"] == r["n"] + 2 and r["id"].endswith("\nx") for r in got)


def test_reports_are_bounded(spark):
    assert len(json.loads(sinks.json_report(spark.range(3)))) == 3 and sinks.markdown(spark.range(2)).count("\n") == 3
    for report in (sinks.json_report, sinks.markdown):
        with pytest.raises(ValueError, match="more than 2"):
            report(spark.range(3), 2)


def test_decisions_are_upserted(spark):
    kind = "id long, role string, decision string, at int"
    old = spark.createDataFrame([(1, "a", "no", 1), (1, "b", "yes", 5), (2, "a", None, 1)], kind)
    new = spark.createDataFrame([(1, "a", "yes", 2), (1, "b", "no", 4), (2, "a", "yes", 1), (3, "a", "no", 9)], kind)
    now = sinks.decided(old, new, "id")
    assert sorted(tuple(r) for r in now.collect()) == [(1, "a", "yes", 2), (1, "b", "yes", 5), (2, "a", "yes", 1), (3, "a", "no", 9)]
    sheet = sinks.review_sheet(spark.range(1, 5), now, "id", ["a", "b"]).orderBy("id").collect()
    assert [(r["a"], r["b"], r["agreed"]) for r in sheet] == [("yes", "yes", True), ("yes", "pending", False), ("no", "pending", False), ("pending", "pending", False)]


def test_seeds(spark, tmp_path):
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write("CCO name\n\nCC\n")
    assert {r[0] for r in readers.seeds(spark, str(tmp_path / "s.txt.gz")).collect()} == {"CCO", "CC"}
    (tmp_path / "t.txt").write_text("CCO x\n\tCCN y\n  CCC\n\u00a0\n")
    assert sorted(r[0] for r in readers.seeds(spark, str(tmp_path / "t.txt")).collect()) == ["CCC", "CCN", "CCO"]
    (tmp_path / "t.tsv").write_text("smiles\tcanonical_smiles\nA\tB\nC\t \n\t\n")
    assert sorted(r[0] for r in readers.seeds(spark, str(tmp_path / "t.tsv")).collect()) == ["B", "C"]
    (tmp_path / "t.jsonl").write_text('{"smiles": "A", "canonical_smiles": "\\tB "}\n{"smiles": "C"}\n{}\n')
    assert sorted(r[0] for r in readers.seeds(spark, str(tmp_path / "t.jsonl")).collect()) == ["B", "C"]
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="none of the columns"):
        readers.seeds(spark, str(tmp_path / "u.csv"))


def test_reports_by_path(spark, tmp_path):
    for step in (250, 500):
        d = tmp_path / "data_11_s1" / f"checkpoint-{step}" / "core"
        d.mkdir(parents=True)
        (d / "report.json").write_text(json.dumps({"n": step}))
    r = readers.reports(spark, str(tmp_path), T.StructType([T.StructField("n", T.IntegerType())]))
    assert {(x["phase"], x["step"], x["panel"], x["n"]) for x in r.collect()} == {("data_11_s1", 250, "core", 250), ("data_11_s1", 500, "core", 500)}
    assert readers.complete_checkpoints(r, 2).count() == 0


def test_images_and_archives(spark, tmp_path):
    ihdr = struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + ihdr + struct.pack(">I", zlib.crc32(b"IHDR" + ihdr)))
    (tmp_path / "b.png").write_bytes(b"no image")
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    (tmp_path / "c.png").write_bytes(b"\xff\xd8" + segment(0xE1, b"x" * 60000) + segment(0xE2, b"y" * 60000) + segment(0xC2, struct.pack(">BHHB", 8, 11, 13, 4) + b"z" * 12))
    (tmp_path / "d.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 3, 4, 16, 0, 0, 0, 0))
    (tmp_path / "e.png").write_bytes(b"")
    rows = {r["path"][-5:]: r for r in readers.image_metadata(spark, str(tmp_path / "*.png")).collect()}
    assert (rows["a.png"]["mode"], rows["a.png"]["width"], rows["a.png"]["height"]) == ("RGB", 7, 5) and not rows["b.png"]["openable"]
    assert (rows["c.png"]["mode"], rows["c.png"]["width"], rows["c.png"]["height"]) == ("CMYK", 13, 11) and rows["d.png"]["mode"] == "I;16" and not rows["e.png"]["openable"]
    read, body = [], (tmp_path / "c.png").read_bytes()
    assert readers.image_header(lambda at, n: read.append(n) or body[at : at + n])[0] == "JPEG" and sum(read) < 100
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/a.txt", "1")
        z.writestr("__MACOSX/a.txt", "2")
    assert [r["member"] for r in readers.zip_members(spark, str(tmp_path / "z.zip")).collect()] == ["x/a.txt"]


def test_paths(spark):
    df = spark.createDataFrame([("c:\\x\\data\\a.png",), ("y.png",)], "p string")
    assert [r[0] for r in df.select(readers.normal_path("p", "data/")).collect()] == ["data/a.png", "y.png"]
    listing = spark.createDataFrame([("r2/y.png",), ("r1/z.png",)], "path string")
    assert [r["resolved"] for r in readers.resolved(df, listing, "p", ["r1", "r2"]).orderBy("p").collect()] == [None, "r2/y.png"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert sinks.write_jsonl(df, str(tmp_path / "j")) == 3
    sinks.write_csv(df, str(tmp_path / "c"), ["id"])
    assert readers.csv_checked(spark, str(tmp_path / "c"), ["id"]).count() == 3
    path = str(tmp_path / "t")
    sinks.append_new(spark, df, path, "id")
    sinks.append_new(spark, df, path, "id")
    assert spark.read.parquet(path).count() == 3
    table = VersionedTable(spark, str(tmp_path / "v"))
    table.write(df, None)
    assert sinks.without_bad(table, df.where("id = 'b'"), ["id"], dry_run=True) == {"before": 3, "removed": 1, "after": 2}
    assert sinks.without_bad(table, df.where("id = 'b'"), ["id"])["after"] == 2
    assert {r[0] for r in table.read().select("id").collect()} == {"a", "c"}
    up = sinks.upserted(df, spark.createDataFrame([("a", 9), ("z", 1)], "id string, n int"), "id", ["n"])
    assert {tuple(r) for r in up.collect()} == {("a", 9), ("b", 2), ("c", 3)}
    twice = spark.createDataFrame([("a", 9, 1), ("a", 4, 2), ("a", None, 0), ("b", None, 1)], "id string, n int, at int")
    assert sorted(tuple(r) for r in sinks.upserted(df, twice, "id", ["n"], F.col("at")).collect()) == [("a", 4), ("b", 2), ("c", 3)]
    assert sorted(tuple(r) for r in sinks.upserted(df, twice, "id", ["n"]).collect()) == [("a", 9), ("b", 2), ("c", 3)]
    assert sinks.markdown(df.limit(1)).count("|") >= 6 and len(json.loads(sinks.json_report(df))) == 3
    sheet = sinks.review_sheet(df.select("id"), spark.createDataFrame([("a", "one", "ok", 1), ("a", "two", "ok", 2), ("b", "one", "ok", 1)], "id string, role string, decision string, at int"), "id", ["one", "two"])
    assert {r["id"]: r["agreed"] for r in sheet.collect()} == {"a": True, "b": False, "c": False}


def test_a_reader_always_finds_one_version(spark, tmp_path):
    """Readers run while versions are put, each sees one whole version."""
    import threading

    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    version = table.write(spark.range(10).selectExpr("id", "0 as version"), None)
    seen, stop = [], threading.Event()

    def reading():
        while not stop.is_set():
            rows = table.read().collect()
            seen.append((len(rows), {r["version"] for r in rows}))

    reader = threading.Thread(target=reading)
    reader.start()
    try:
        for n in range(1, 5):
            version = table.write(table.read(version).selectExpr("id", f"{n} as version"), version)
    finally:
        stop.set()
        reader.join()
    assert seen and all(n == 10 and len(v) == 1 for n, v in seen)
    assert table.expire(2) == 3 and table.numbers() == [3, 4] and table.read().first()["version"] == 4
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_a_second_writer_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    first = table.write(spark.range(3), None)
    table.write(spark.range(4), first)
    with pytest.raises(Conflict):
        table.write(spark.range(5), first)
    assert table.read().count() == 4 and len(list((tmp_path / "t" / "data").iterdir())) == 2
    now = table.current()
    assert table.read(table.put({}, now.schema, now)).count() == 0


def test_stream_upsert_is_last_wins(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, v int"
    for k, v in (("a", 1), ("b", 1), ("a", 2)):
        spark.createDataFrame([(k, v)], schema).write.mode("append").parquet(src)
    for _ in range(2):
        q = upsert.upsert(upsert.stream_of(spark, src, spark.read.parquet(src).schema, 1), str(tmp_path / "out"), str(tmp_path / "ck"), "k", "v")
        q.awaitTermination()
    assert {tuple(r) for r in upsert.latest(spark, str(tmp_path / "out")).select("k", "v").collect()} == {("a", 2), ("b", 1)}


def test_upserts_write_what_a_batch_brings(spark, tmp_path):
    """A small batch on a large table writes few bytes; the rows are those of a plain loop."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    want, written = {}, []
    for n in range(8):
        ids = range(20000) if n == 0 else range(n * 10, n * 10 + 30)
        rows = [(i, n * 100000 + i, "x" * 20) for i in ids]
        want |= {i: v for i, v, _ in rows}
        spark.createDataFrame(rows, "k long, v long, t string").coalesce(1).write.mode("append").parquet(src)
        upsert.upsert(upsert.stream_of(spark, src, spark.read.parquet(src).schema), out, ck, "k", "v", buckets=4, most_deltas=3).awaitTermination()
        table = VersionedTable(spark, out)
        written.append({f: b for p in table.current().parts.values() for f, b in p})
    assert {r["k"]: r["v"] for r in upsert.latest(spark, out).collect()} == want
    assert upsert.latest(spark, out).count() == len(want) and len(table.numbers()) == 2
    fresh = [sum(b for f, b in now.items() if f not in then) for then, now in zip([{}, *written], written)]
    assert fresh[1] < fresh[0] / 10 and fresh[2] < fresh[0] / 10


def test_numbered_scan_writes_files_by_the_number_of_documents(spark, monkeypatch):
    from quernel.plans import tables

    made, folder = [], tables._stream_folder
    monkeypatch.setattr(tables, "_stream_folder", lambda *a: made.append(folder(*a)) or made[-1])
    monkeypatch.setattr(tables, "FILE_ROWS", 25, raising=False)
    rows = tables.numbered_scan(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(rows) == n and all(r["in_order"] for r in rows)
    assert spark.read.text(f"{made[0]}/*.txt").select(F.input_file_name()).distinct().count() == -(-n // 25)
