"""The export readers over files in many splits, against Python's own lines and csv reader."""

import csv
import random

import pytest

from boundwright.sources import exports as X


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "97")
    yield spark
    for name in names:
        spark.conf.unset(name)


def test_lines_over_splits(small_splits, tmp_path):
    rng = random.Random(3)
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["".join(rng.choice(["", "a", "int x;", "ä" * 30]) + rng.choice(breaks if i % 2 else breaks[:3]) for i in range(300)) + end for end in ("", "last", "last\n")]
    texts += ["", "\n", "one", "a\x0c", "\n\n\nb"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.c").write_bytes(text.encode())
    read = X.text_lines(small_splits, f"file://{tmp_path}")
    got = {}
    for r in read.collect():
        got.setdefault(int(r.file.rsplit("/", 1)[1][:-2]), []).append((r.line, r.text))
    want = {i: list(enumerate(text.replace("\r\n", "\n").replace("\r", "\n").splitlines(), 1)) for i, text in enumerate(texts)}
    want = {i: rows for i, rows in want.items() if rows}
    # A file that ends in another break and LF has one more empty line in Python.
    assert {i: [t for _, t in sorted(rows)] for i, rows in got.items()} == {i: [t for _, t in rows] for i, rows in want.items()}
    assert all(sorted(n for n, _ in rows) == list(range(1, len(rows) + 1)) for rows in got.values())


def test_cells_as_csv(spark):
    texts = ["a;b", ";", "", '"x;y";"";z', '"a""b";c', '"a"b;c', 'a"b;"c', '"open;x', '"a""', ";;\"q\"", ' "s";t', '"' + 'ab""' * 20000 + '";end']
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.c for r in rows.select("i", X.cells(rows.t).alias("c")).collect()}
    want = {i: next(csv.reader([t], delimiter=";"), None) or [""] for i, t in enumerate(texts)}
    assert got == want


def test_headers(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("﻿sep=;\nTitle; of it\n1;2\n\nOrder;Type;Order\n9;x;1,112\n;;\n8;y\nOrder;Type;Order\n")
    (tmp_path / "b.csv").write_text("﻿Type;Order\n" + "".join(f"t;{i}\n" for i in range(200)))
    (tmp_path / "c.csv").write_text("sep=;\nnote;x\nKind;Type\nk;only\n" + "9;z\n")
    (tmp_path / "d.csv").write_text("")
    rows = X.semicolon_csv(small_splits, f"file://{tmp_path}", ["Order", "Type", "Location"])
    got = sorted((r.file[-5], r.row, r.Order, r.Type, r.Location) for r in rows.collect())
    a = [("a", 6, "1,112", "x", ""), ("a", 8, "", "y", ""), ("a", 9, "Order", "Type", "")]
    assert got == a + [("b", i + 2, str(i), "t", "") for i in range(200)] + [("c", 5, "", "", "")]
    assert sorted(r.order_id for r in X.alarms(rows).collect()) == sorted([1112, *range(200)])
    (tmp_path / "e.csv").write_text("1;2\n")
    with pytest.raises(Exception, match="no header in"):
        X.semicolon_csv(small_splits, f"file://{tmp_path}", ["Order"]).collect()


def test_last_rows(spark):
    rows = spark.createDataFrame([("f", 2, "1,0", "true"), ("f", 11, "10", ""), ("f", 9, "10", "false"), ("f", 3, "1 0", "true"), ("g", 1, "7", "u"), ("f", 5, "x", "true")], "file string, row long, Order string, Classification string")
    assert sorted(map(tuple, X.labels(rows).collect())) == [(7, "u"), (10, "false")]


def test_call_files_grow_in_number(spark, sf_dir, monkeypatch):
    from boundwright.jobs import exported

    made, files = [], exported.X.export_files
    monkeypatch.setattr(exported.X, "export_files", lambda rows, *more: made.append(rows.select("part").distinct().count()) or files(rows, *more))
    monkeypatch.setattr(exported, "CALLS", 100, raising=False)
    # Before, sixteen files, each sorted by one task, however many calls there were.
    assert exported.export_calls(spark, sf_dir).count() > 5000 and made[0] > 50
