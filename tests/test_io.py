import os

import pytest
from pyspark.sql import functions as F

from weftmark import cli
from weftmark.functions import text as tf
from weftmark.options import Options
from weftmark.plans.analysis import analyze_directory
from weftmark.plans.jobs import Jobs
from weftmark.plans.report import export
from weftmark.sources import files
from weftmark.streaming.ingest import start

CODE = "int f(int n) { int s = 0; for (int i = 0; i < n; ++i) { s += i; } return s; }"


@pytest.fixture
def tree(tmp_path):
    names = ["a.cpp", "p%20q.cpp", "p%%q.cpp", "p+q [1].cpp", "sub/é.py", ".git/x.cpp", "build/y.cpp", "no.txt", "sub/b.JAVA"]
    for n in names:
        at = tmp_path / n
        at.parent.mkdir(exist_ok=True)
        at.write_text(CODE)
    os.symlink(tmp_path / "a.cpp", tmp_path / "z.cpp")
    (tmp_path / "lost.cpp").write_text(CODE)
    return tmp_path


def test_discovery(spark, tree, monkeypatch):
    found, warnings = files.discover(spark, str(tree))
    rows = found.orderBy("doc_id").collect()
    assert [r.display for r in rows] == sorted(["a.cpp", "lost.cpp", "p%20q.cpp", "p%%q.cpp", "p+q [1].cpp", "sub/é.py", "sub/b.JAVA"], key=str.encode)
    assert {r.content.decode() for r in rows} == {CODE} and not warnings
    real = files.os.access
    monkeypatch.setattr(files.os, "access", lambda p, m: os.remove(p) is None if p.endswith("lost.cpp") else real(p, m))  # lost between listing and reading
    found, warnings = files.discover(spark, str(tree))
    assert found.count() == 6 and len(warnings) == 1 and "lost.cpp" in warnings[0] and [r.doc_id for r in found.orderBy("doc_id").collect()] == list(range(6))
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tree / "none"))
    with pytest.raises(ValueError):
        files.discover(spark, str(tree / "no.txt"))


def test_directory_by_language_and_export(spark, tree):
    a = analyze_directory(spark, str(tree), Options(threshold=90, lexer="auto"))
    assert {(r.file_a, r.file_b) for r in a.named().collect()} >= {("a.cpp", "p%20q.cpp"), ("p%%q.cpp", "p%20q.cpp")}
    export(a, str(tree / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tree / "out")).where("similarity_percent = '100.00'").count() >= 6
    a.close()


def test_command_line(spark, tree, capsys):
    assert cli.main([str(tree / "a.cpp"), str(tree / "p%20q.cpp")]) == 0
    assert "tokens:       36" in (out := capsys.readouterr().out) and out.endswith("Similarity: 100.00%\n")
    assert cli.main(["--self-test"]) == 0 and "FAILED" not in capsys.readouterr().out
    assert cli.main([str(tree), "--top", "2", "--threshold", "50", "--format", "csv", "-o", str(tree / "r.csv")]) == 0
    assert (tree / "r.csv").read_text().count("\n") == 3
    for bad in (["--top", "0", "x"], ["--threshold", "101", "x"], [], ["--format", "pdf", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_escapes(spark):
    row = spark.createDataFrame([("a\x01\"\\\n\t", " " * 3 + "é" * 60)], "t string, u string").select(tf.json_escape(F.col("t")).alias("j"), tf.oneline(F.col("u")).alias("o"), tf.ends_with_any(F.lit("x.py"), [".PY", ".py"]).alias("e"), tf.fixed(F.lit(3.125)).alias("f")).first()
    assert row.j == 'a\\u0001\\"\\\\\\n\\t' and row.o == " " + "é" * 38 + "..." and row.e and row.f == "3.12"


def test_jobs_and_uploads(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path / "jobs"))
    first, second = jobs.create({"k": 5}, [{"name": "a"}]), jobs.create({}, [])
    with pytest.raises(ValueError):
        jobs.update(first, status="completed")
    jobs.update(first, status="running")
    jobs.update(first, status="failed", error="x")
    jobs.update(first, status="running")
    jobs.update(first, status="completed", result="{}", duration_ms=7)
    assert jobs.get(first).status == "completed" and [r.id for r in jobs.list().collect()] == [second, first]
    jobs.delete(second)
    assert jobs.list().count() == 1
    with pytest.raises(KeyError):
        jobs.get(second)
    up = lambda *rows: spark.createDataFrame(list(rows), "name string, content binary")
    assert sorted(tuple(r) for r in files.uploads(up(("a b.py", b"1"), ("a_b.py", b"2"), ("c.tsx", b"3"))).select("name").collect()) == [("a_b.py",), ("c.tsx",)]
    for bad in ([("a.py", b"")], [("a.py", b""), ("b.exe", b"")], [("a.py", b"x" * (1 << 20) + b"x"), ("b.py", b"")]):
        with pytest.raises(ValueError):
            files.uploads(up(*bad))


def test_stream(spark, tmp_path):
    schema = "doc_id bigint, text string"
    for i, rows in enumerate([[(1, CODE)], [(2, CODE), (3, "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/prints", f"{tmp_path}/matches", f"{tmp_path}/state").awaitTermination()
    assert [(r.lhs, r.rhs) for r in spark.read.parquet(f"{tmp_path}/matches").collect()] == [(2, 1)]
