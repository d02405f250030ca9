import json

import pytest
from pyspark.sql import functions as F

from docgrid.sources import files
from docgrid.streaming.increment import counts_by_window, process_new


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,café\n2,\n".encode())
    df = files.csv_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and [r.name for r in df.collect()] == ["café", ""]
    (tmp_path / "b.csv").write_bytes("x,y\ncafé,€\n".encode("cp1252"))
    assert files.csv_table(spark, str(tmp_path / "b.csv"), files.CP1252).first().y == "€"


def test_grids(spark, tmp_path):
    (tmp_path / "g1.csv").write_bytes('A,B,C\r\n"1,5",,z\r\n'.encode("cp1252"))
    (tmp_path / "g2.csv").write_bytes("xé,y\n".encode("cp1252"))
    got = {r.path.rsplit("/", 1)[1]: r.grid for r in files.csv_grids(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"g1.csv": [["A", "B", "C"], ["1,5", "", "z"]], "g2.csv": [["xé", "y"]]}
    assert sorted(r.id for r in files.file_ids(spark, str(tmp_path / "*.csv")).collect()) == ["g1", "g2"]


def test_json_and_corpus(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"b": ["x", "y"], "a": [], "c": ["z"]}, indent=1))
    got = [tuple(r) for r in files.json_dictionary(spark, str(tmp_path / "d.json")).orderBy("label_ord", "phrase_ord").collect()]
    assert got == [("b", 0, "x", 0), ("b", 0, "y", 1), ("a", 1, None, None), ("c", 2, "z", 0)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("one\ntwo")
    assert files.corpus(spark, str(tmp_path / "t")).first().text == "one\ntwo"
    df = spark.createDataFrame([("<div class=\"page\">a</div><div class=\"page\">b</div>", "['p', 'q']")], "html string, l string")
    assert [r.page for r in files.pages_of_html(df).collect()] == [0, 1]
    assert df.select(files.list_literal("l").alias("l")).first().l == ["p", "q"]


def test_writers_and_stubs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_csv(df, str(tmp_path / "o"), ["v", "k"], sep="\t", one_file=True)
    assert files.csv_table(spark, str(tmp_path / "o"), sep="\t").columns == ["v", "k"]
    files.write_by_key(df, "k", str(tmp_path / "p"))
    assert (tmp_path / "p" / "k=1").is_dir()
    for f in (files.pdf_tables, files.ocr, files.download):
        with pytest.raises(NotImplementedError):
            f("x")


def test_increment(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in (1, 2):
        spark.createDataFrame([(i, "x")], "id int, v string").write.mode("append").parquet(src)
        process_new(spark, src, "id int, v string", lambda d: d.withColumn("done", F.lit(True)), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == i


def test_windows(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 1.5d as value union all select timestamp'2024-01-01 00:50:00', 'a', 2d")
    assert [(r.n, r.total) for r in counts_by_window(df).collect()] == [(2, 3.5)]


def test_grids_with_line_breaks_in_quotes_and_many_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"x\r\ny",2\r\n' + b",".join(b"%d" % i for i in range(80)) + b"\r\n")
    grid = files.csv_grids(spark, str(tmp_path / "a.csv")).first().grid
    assert grid == [["x\r\ny", "2"], [str(i) for i in range(80)]]
