"""CSV files with breaks in cells, cut into many splits, against Python's csv module."""

import csv
import io
import random

import pytest


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _random_cell(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice('ab ,"\n') for _ in range(rng.randrange(12)))
    if kind < 0.33:
        return "long\n" * rng.randrange(400) + '"' + ",x\n" * 30
    return rng.choice(["plain", "7 in", "é", "x" * rng.randrange(60)])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_one_reader(spark, tmp_path, small_splits, monkeypatch, end):
    from tabscope.sources.readers import read_csv

    rng = random.Random(7)
    folder = tmp_path / "many.csv"
    folder.mkdir()
    expected = []
    for f in range(3):
        rows = [[str(f * 1000 + i), _random_cell(rng), _random_cell(rng)] for i in range(120)]
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if f == 1 else csv.QUOTE_MINIMAL)
        w.writerow(["id", "first,\nname", "second"])
        w.writerows(rows)
        (folder / f"{f}.csv").write_bytes(("﻿" if f == 2 else "").encode() + out.getvalue().encode())
        expected += rows
    monkeypatch.setattr("tabscope.sources.csv_records.CHUNK_BYTES", 900)
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
    df = read_csv(spark, str(folder), infer=False)
    assert df.columns == ["id", "first,\nname", "second"]
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
    assert got == [tuple(c or None for c in r) for r in sorted(expected, key=lambda r: int(r[0]))]


def test_quotes_inside_unquoted_cells_are_text(spark, tmp_path, small_splits):
    from tabscope.sources.readers import read_csv

    p = tmp_path / "inches.csv"
    lines = [f'{i},5" pipe,ok' if i % 3 else f'{i},"a ""b""\nc,d",6" x' for i in range(300)]
    p.write_text("id,size,note\n\n" + "\n  \n".join(lines))
    rows = {r["id"]: (r["size"], r["note"]) for r in read_csv(spark, str(p)).collect()}
    assert rows == {i: ('5" pipe', "ok") if i % 3 else ('a "b"\nc,d', '6" x') for i in range(300)}


def test_line_function_against_a_scan_by_character():
    from tabscope.sources.csv_records import line_function

    def scan(line, inside):
        i, start = 0, not inside
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1:i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = start = False
            elif start and c == '"':
                inside, start = True, False
            else:
                start = c == ","
            i += 1
        return inside

    rng = random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choice('a,""') for _ in range(rng.randrange(12)))
        assert line_function(line.encode()) == (scan(line, False), scan(line, True)), line
    assert line_function(b'"' + b'""' * 1_000_000) == (True, False)


def test_empty_header_only_and_open_quote(spark, tmp_path):
    from tabscope.sources.readers import read_csv

    p = tmp_path / "e.csv"
    p.write_text("")
    assert read_csv(spark, str(p)).collect() == []
    p.write_text("\n\na,b\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["a", "b"] and df.collect() == []
    p.write_bytes(b"a,b\r1,2\r3,4\r")
    assert sorted(map(tuple, read_csv(spark, str(p)).collect())) == [(1, 2), (3, 4)]
