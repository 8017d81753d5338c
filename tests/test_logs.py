"""Log files that grow, are rotated and emptied, read once each over restarts; findings with their context."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.streaming import jobs as J
from millrace.streaming import logs


@pytest.fixture
def drained(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    task = {"taskBytes": "64"}

    def run():
        rows = J.run_once(logs.tail(spark, f"{tmp_path}/in/*.log*", context=2, **task), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(r.line for r in rows.collect())

    return tmp_path / "in", run


def lines(a, b):
    return [f"line {k:05d} " + "x" * (k % 90) for k in range(a, b)]


def append(path, rows, end="\n"):
    with open(path, "a") as f:
        f.write("\n".join(rows) + end)


def test_growth_rotation_and_restart(drained):
    folder, run = drained
    append(folder / "a.log", lines(0, 100))
    assert run() == lines(0, 100)
    append(folder / "a.log", lines(100, 120))
    append(folder / "a.log", ["half a li"], end="")
    assert run() == lines(0, 120)
    append(folder / "a.log", ["ne"])
    os.rename(folder / "a.log", folder / "a.log.1")
    append(folder / "a.log", lines(200, 230))
    assert run() == sorted([*lines(0, 120), "half a line", *lines(200, 230)])
    os.rename(folder / "a.log.1", folder / "a.log.2")
    os.rename(folder / "a.log", folder / "a.log.1")
    append(folder / "a.log", lines(300, 301))
    assert run() == sorted([*lines(0, 120), "half a line", *lines(200, 230), *lines(300, 301)])
    assert run() == sorted([*lines(0, 120), "half a line", *lines(200, 230), *lines(300, 301)])


def test_emptied_and_written_anew(drained):
    folder, run = drained
    append(folder / "a.log", lines(0, 10))
    run()
    with open(folder / "a.log", "w") as f:
        f.write("\n".join(lines(50, 90)) + "\n")
    assert run() == lines(0, 10) + lines(50, 90)
    # under the same first line, but shorter
    with open(folder / "a.log", "w") as f:
        f.write("\n".join(lines(50, 52)) + "\n")
    assert run() == sorted(lines(0, 10) + lines(50, 90) + lines(50, 52))


def test_odd_files(drained):
    folder, run = drained
    (folder / "empty.log").write_bytes(b"")
    (folder / "bad.log").write_bytes(b"\xff\xfe\r\n\n" + b"y" * 5000 + b"\n")
    assert run() == sorted(["��", "", "y" * 5000])


def test_context_across_tasks(spark, tmp_path):
    rows = lines(0, 200)
    append(tmp_path / "a.log", rows)
    got = J.run_once(logs.tail(spark, f"{tmp_path}/*.log", context=3, taskBytes="50"), str(tmp_path / "out"), str(tmp_path / "state")).orderBy("at").collect()
    assert [r.line for r in got] == rows
    for k, r in enumerate(got):
        assert r.before == rows[max(0, k - 3) : k] and r.context == rows[k + 1 : k + 4]


def test_back_over_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "CHUNK", 5)
    data = b"a\n\nbbbbbbbbb\ncc\n"
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f:
        assert [logs.back(f, 13, n) for n in range(6)] == [13, 3, 2, 0, 0, 0]
    assert logs.complete(str(tmp_path / "x")) == len(data)


def test_findings(spark):
    text = ["ok", "10 | ERROR | first", "Traceback (most recent", "ValueError: x", "", "12 | ERROR | second", "noise", "a", "b", "c", "KeyError: alone", "ERROR quiet"]
    rows = [("f", "k", n, x, text[max(0, n - 3) : n], text[n + 1 : n + 4]) for n, x in enumerate(text)]
    got = logs.findings(spark.createDataFrame(rows, logs.SCHEMA), [r"\bERROR\b", "^Traceback", r"^\w+Error: "], ["quiet", "noise"]).orderBy("at").collect()
    assert [(r.at, r.context) for r in got] == [(1, ["Traceback (most recent", "ValueError: x"]), (5, ["a", "b"]), (10, [])]
    assert logs.findings(spark.createDataFrame(rows, logs.SCHEMA).where(F.lit(False)), ["x"]).count() == 0
