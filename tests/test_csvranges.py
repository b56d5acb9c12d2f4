"""CSV by byte ranges against Spark's reader of whole files, wherever the files are cut."""

from __future__ import annotations

import random

import pytest

from tradeloom.sources import csvranges
from tradeloom.sources.tabular import read_catalog, read_csv

CELLS = ["", "a", "b c", "  padded ", "1,5", 'say ""hi""', '""', "line one\nline two", "\n\n", "crlf\r\nhere", "ü,ß\n日本",
         '"",""\n"",', "x" * 300, "y\n" * 60, "it's", "\t"]


def spelled(cell: str, chance: random.Random) -> str:
    return f'"{cell}"' if any(c in cell for c in ',"\n\r') or chance.random() < 0.3 else cell


def file_of(rows: int, seed: int, end: str) -> str:
    chance = random.Random(seed)
    lines = ["id,first,second"]
    for k in range(rows):
        cells = [str(k), *(spelled(chance.choice(CELLS), chance) for _ in range(chance.choice([1, 2, 2, 2, 3])))]
        lines.append(",".join(cells))
        if chance.random() < 0.1:
            lines.append("")
        if chance.random() < 0.1:
            lines.append(f'{k},5" pipe,un"quoted"')
    return end.join(lines) + (end if seed % 2 else "")


@pytest.fixture
def cut(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def at(size: int) -> None:
        for name, value in zip(names, (size, 1), strict=True):
            spark.conf.set(name, value)

    yield at
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size,end", [(83, "\n"), (997, "\r\n")])
def test_equals_whole_file_reader(spark, tmp_path, cut, size, end):
    for seed in (1, 2):
        (tmp_path / f"f{seed}.csv").write_text("﻿" * (seed - 1) + file_of(80, seed, end), newline="")
    whole = spark.read.options(header=True, **csvranges._OPTIONS).csv(str(tmp_path))
    want = sorted(map(tuple, whole.collect()), key=str)
    cut(size)
    got = csvranges.csv_table(spark, str(tmp_path), number="n", first=2)
    rows = got.collect()
    assert got.columns == ["id", "first", "second", "n"]
    unified = [tuple(c and c.replace("\r\n", "\n") if end == "\r\n" else c for c in tuple(r)[:3]) for r in rows]
    assert sorted(unified, key=str) == want and any("\r\n" in (r.second or "") for r in rows)
    in_order = [r.id for r in sorted(rows, key=lambda r: r.n)]
    assert [r.n for r in sorted(rows, key=lambda r: r.n)] == list(range(2, len(rows) + 2))
    assert in_order == [r.id for s in (1, 2) for r in spark.read.options(header=True, **csvranges._OPTIONS).csv(str(tmp_path / f"f{s}.csv")).collect()]
    if size < 100:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 50


def test_a_cell_over_many_ranges_and_an_open_end(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text('k,v\n1,"' + "long\n" * 200 + '"\n2,b\n3,"never closed\nend', newline="")
    cut(64)
    got = {r.k: r.v for r in csvranges.csv_table(spark, str(tmp_path)).collect()}
    assert got["1"] == "long\n" * 200 and got["2"] == "b" and len(got) == 3


def test_states_of_lines():
    for line, ends in [("a,b", (False, True)), ('a,"b', (True, False)), ('"a""b"', (False, False)), ('x"y', (False, False)),
                       ('""', (False, True)), ('",', (True, False)), ('"",""",', (True, False)), ('a,"b",c', (False, False)), ('"', (True, False))]:
        assert csvranges.ends_inside(line, False) == ends[0], line


def test_catalog_rows_are_numbered_as_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿a,b\n 1 ,"x\ny"\n2,\n', newline="")
    assert [tuple(r) for r in read_catalog(spark, str(tmp_path / "c.csv")).orderBy("row_number").collect()] == [("1", "x\ny", 2), ("2", "", 3)]
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c.csv")).collect()), key=str) == [(" 1 ", "x\ny"), ("2", None)]
