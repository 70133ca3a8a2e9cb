import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.streaming import rates


def test_tree_and_inventory(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x.html").write_bytes("日本".encode("cp932"))
    (tmp_path / "a" / "y.txt").write_text("t")
    (tmp_path / "a" / ".git" / "z.html").write_text("no")
    rows = {r["path"]: (r["text"], r["encoding"]) for r in files.pages(spark, str(tmp_path)).collect()}
    assert rows == {"a/x.html": ("日本", "cp932")}
    assert {r["path"] for r in files.inventory(spark, str(tmp_path)).collect()} == {"a/x.html", "a/y.txt"}


def test_lists_and_logs(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("# c\n\nu1\tp1\nu2\n k o 20010101000000 200 text/html 77 extra\nk o t 200 m bad\nshort line\n")
    assert {tuple(r) for r in files.pairs(spark, str(p)).collect()} == {("u1", "p1")}
    log = files.capture_log(spark, str(p)).collect()
    assert {(r["status"], r["length"]) for r in log} == {("200", 77), ("200", 0)}


def test_json_and_rules(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a": 1}\n{"a": 2}\n')
    assert files.jsonl(spark, str(p), "a int").count() == 2
    p.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception):
        files.jsonl(spark, str(p), "a int").collect()
    assert files.rules(str(tmp_path / "none.json")) == {}
    with pytest.raises(FileNotFoundError):
        files.rules(str(tmp_path / "none.json"), required=True)
    t = files.rule_table(spark, {"k": {"set": {"title": "x"}, "expect": {"title": "y"}}})
    assert tuple(t.collect()[0]) == ("k", "title", "x", "y")


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "t")
    d = spark.createDataFrame([(1, "a"), (2, "b")], "n int, corpus string")
    files.replace_scope(d, out, "corpus")
    files.replace_scope(spark.createDataFrame([(3, "b")], "n int, corpus string"), out, "corpus")
    assert {(r["n"], r["corpus"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (3, "b")}
    files.write_jsonl(d, str(tmp_path / "j"), ["n"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert files.tombstoned(d, d.where("n = 1"), "n").count() == 1


def test_bytes_predicates(spark):
    d = spark.createDataFrame([("a.gif", bytearray(b"GIF89a")), ("b.png", bytearray(b"no")), ("c.html", bytearray(b"  <p>Not Found</p>")), ("d.txt", None)], "p string, c binary")
    got = [tuple(r) for r in d.select(files.type_agrees(F.col("p"), F.col("c")), files.error_stub(F.col("p"), F.col("c"), ["not found"])).collect()]
    assert got[:3] == [(True, False), (False, False), (True, True)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('a', timestamp'2024-01-01 00:20:00'), ('a', timestamp'2024-01-01 01:30:00'), ('b', timestamp'2024-01-01 00:00:00') AS t(k, ts)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    q = rates.limited(stream, "k", "ts", most=2).writeStream.format("memory").queryName("lim").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["key"], str(r["ts"])[11:16], r["n"], r["allowed"]) for r in spark.table("lim").collect())
    assert got == [("a", "00:00", 1, True), ("a", "00:10", 2, True), ("a", "00:20", 3, False), ("a", "01:30", 1, True), ("b", "00:00", 1, True)]
