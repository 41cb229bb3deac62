import gzip
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.operators.evals import fixed_histogram
from quillstone.sources import io
from quillstone.streaming import batches as B


def test_json_lines(spark, tmp_path):
    p = str(tmp_path / "a.jsonl.gz")
    with gzip.open(p, "wt") as f:
        f.write('{"suite": "s", "i": 1}\n\n{"suite": "t", "i": 2}\n')
    df = io.read_jsonl(spark, p, io.PREDICTION_SCHEMA)
    assert [(r["suite"], r["i"], r["gold"]) for r in df.orderBy("i").collect()] == [("s", 1, None), ("t", 2, None)]
    out = str(tmp_path / "out")
    io.write_jsonl(df, out, ["i"])
    io.append_jsonl(df, out)
    assert io.read_jsonl(spark, out, io.PREDICTION_SCHEMA).count() == 4
    names = lambda d: {x: (tmp_path / d / x).read_bytes() for x in os.listdir(tmp_path / d) if x.startswith("part-")}
    many = spark.range(500).selectExpr("id", "cast(id % 7 as string) as s")
    for d, rows in (("x", many), ("y", many.repartition(3)), ("z", many.where("id < 0"))):
        io.write_jsonl(rows, str(tmp_path / d), ["s", "id"])
    assert names("x") == names("y") and sorted(names("x"))[0] == "part-00000.json.gz"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"suite": "s"}\nnope\n')
    assert [r["text"] for r in io.bad_lines(spark, str(bad), "suite string").collect()] == ["nope"]


def test_whole_json_csv_workbook(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\n{"x": 4}\n')
    assert io.read_any_json(spark, str(tmp_path / "a.json")).count() == 2
    assert io.read_any_json(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.csv").write_text('a,b\n1,"x, ""y"""\n2,z\n')
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "c.csv"), where="a = '1'").collect()] == [("1", 'x, "y"')]
    (tmp_path / "d.csv").write_bytes(b"a\n\xff\xc3\xa9\n")
    assert io.read_csv(spark, str(tmp_path / "d.csv")).first()["a"] == "\ufffd\u00e9"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    assert io.read_workbooks(spark, str(tmp_path / "w.xlsx")).first()["cells"] == ["name", None, "5"]


def test_pins_and_pairs(spark, tmp_path):
    (tmp_path / "f.txt").write_text("abc")
    good = io.manifest_digest(str(tmp_path / "f.txt"))
    assert io.pinned(spark, str(tmp_path / "f.txt"), {"f.txt": good}).first()["ok"] is True
    assert io.pinned(spark, str(tmp_path / "f.txt"), {"f.txt": "0"}).first()["ok"] is False
    assert bytes(io.read_pinned(spark, str(tmp_path / "f.txt"), {"f.txt": good}).first()["content"]) == b"abc"
    for digests in ({"f.txt": "0"}, {"f.txt": good, "g.txt": good}, {}):
        with pytest.raises(ValueError):
            io.read_pinned(spark, str(tmp_path / "f.txt"), digests)
    out = str(tmp_path / "pair")
    m = io.write_pair(spark.range(5), out, {"seed": 1})
    rows, manifest = io.read_pair(spark, out)
    assert m == manifest == {"rows": 5, "seed": 1} and rows.count() == 5
    io.write_pair(spark.range(7), out, {"seed": 2})
    rows, manifest = io.read_pair(spark, out)
    assert manifest["seed"] == 2 and rows.count() == manifest["rows"] == 7
    assert len([x for x in os.listdir(out) if x.startswith("v-")]) == 2 and not [x for x in os.listdir(out) if x.startswith(".current-")]


def test_workbook_layouts(tmp_path):
    ns, rel = io._SHEETS, io._LINKS
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="b" r:id="rId7"/><sheet name="a" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c><c t="e"><v>#N/A</v></c></row><row r="4"><c><v>1.50</v></c></row></sheetData></worksheet>')
    got = list(io.workbook_rows((tmp_path / "w.xlsx").read_bytes()))
    assert got[0] == [] and got[2] == [] and got[3] == ["1.50"]
    assert got[1] == [None, "rich", *[None] * 24, "TRUE", "in", None]
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("x", "")
    assert list(io.workbook_rows((tmp_path / "e.xlsx").read_bytes())) == []


def test_reports(spark):
    assert io.markdown(spark.createDataFrame([("a|b", None)], "x string, y string")) == "| x | y |\n| --- | --- |\n| a\\|b |  |"
    with pytest.raises(ValueError):
        io.markdown(spark.range(1001))
    assert io.markdown(spark.range(1000)).count("\n") == 1001
    codes = spark.createDataFrame([('2"0', 3), ("500", 1)], "code string, n int")
    assert io.samples(codes, "requests_total", "n", ["code"]).splitlines() == ["# TYPE requests_total counter", 'requests_total{code="2\\"0"} 3', 'requests_total{code="500"} 1']
    assert io.summary(codes, "size", "n").splitlines() == ["# TYPE size summary", "size_sum 4", "size_count 2"]
    h = fixed_histogram(spark.createDataFrame([(1.0,), (7.0,), (99.0,)], "v double"), "v", [5, 10])
    text = io.exposition(h, "ms")
    assert text.splitlines() == ["# TYPE ms histogram", 'ms_bucket{le="5"} 1', 'ms_bucket{le="10"} 2', 'ms_bucket{le="+Inf"} 3']


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"request_id": "a", "state": "x", "lang": "en"}\n{"request_id": "b", "state": "y", "lang": "de"}\n')
    s = B.requests(spark, str(src), "request_id string, state string, lang string")
    q = B.micro_batches(s, lambda df: df.withColumn("n", F.length("state")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert {r["request_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}
    scored = spark.read.parquet(str(tmp_path / "out")).count()
    s = B.requests(spark, str(src), "request_id string, state string, lang string")
    # the same files from the start, as after a lost checkpoint: the epoch is written over, not added
    B.micro_batches(s, lambda df: df.withColumn("n", F.length("state")), str(tmp_path / "out"), str(tmp_path / "cp2"), once=True, most=1, order="request_id").awaitTermination(60)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == scored and again.select("_pass").distinct().count() == 2
    live = B.drop_expired(spark.createDataFrame([(1, "2020-01-01"), (2, None)], "i int, d string").withColumn("d", F.col("d").cast("timestamp")), "d")
    assert [r["i"] for r in live.collect()] == [2]
    (tmp_path / "ev").mkdir()
    spark.createDataFrame([("k", "2026-01-01 00:10:00", 1.0), ("k", "2026-01-01 00:50:00", 2.0), ("k", "2026-01-01 03:00:00", 4.0)], "k string, t string, v double").selectExpr("k", "cast(t as timestamp) t", "v").write.mode("overwrite").parquet(str(tmp_path / "ev"))
    w = B.windowed_metrics(spark.readStream.schema("k string, t timestamp, v double").parquet(str(tmp_path / "ev")), "t", ["k"], "v")
    q = w.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").where("n = 2 and total = 3").count() == 1
