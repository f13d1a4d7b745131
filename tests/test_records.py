"""Quoted CSV in parallel against the reader that takes a file as one task."""

import random

import pytest
from pyspark.sql import functions as F

from voxrank.sources import files, records

PIECES = ["a", "bc", "é", " ", "", '"', '""', ",", "\n", "\r\n", "x y", "7", "N/A"]


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def field(r):
    kind = r.random()
    text = "".join(r.choices(PIECES, k=r.randint(0, 6)))
    if kind < 0.5:
        return quoted(text)
    plain = text.replace(",", "").replace("\n", "").replace("\r", "")
    return plain.lstrip('"') + ('5" wide' if kind > 0.9 else "") if kind > 0.55 else plain.replace('"', "")


@pytest.fixture(params=[1, 2, 3])
def written(request, tmp_path):
    """Two files: one long of many blocks, one short, with odd and doubled quotes, blank lines and long quoted texts."""
    r = random.Random(request.param)
    for name, rows in (("a.csv", 700), ("b.csv", 3)):
        lines = ["key,text,more"]
        for i in range(rows):
            text = quoted("line one\n" * r.randint(200, 400)) if i % 97 == 50 else field(r)
            lines.append(f"{name}{i},{text},{field(r)}")
            if r.random() < 0.05:
                lines.append("")
        end = "\r\n" if (name == "b.csv") == (request.param == 1) else "\n"
        body = end.join(lines) + (end if request.param != 2 else "")
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if request.param == 3 else b"") + body.encode())
    return str(tmp_path)


@pytest.mark.parametrize("block", [700, 5_000, 10_000_000])
def test_same_rows_as_one_task(spark, written, block):
    whole = files.read_csv(spark, written).select("key", "text", "more")
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    other.conf.set("spark.sql.files.openCostInBytes", "0")
    rows = records.read_records(other, written)
    found = rows.select("key", "text", "more")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))
    tasks = rows.select("_file", "_block").distinct().count()
    assert tasks > (5 if block < 10_000 else 1)
    numbered = files._read_numbered(other, written, True).orderBy("row_no").select("row_no", "key").collect()
    assert [x.row_no for x in numbered] == list(range(703))
    assert [x.key for x in numbered] == [f"a.csv{i}" for i in range(700)] + [f"b.csv{i}" for i in range(3)]


def test_cases_of_lines():
    inside = records.ends_inside
    assert not inside("a,b", False) and inside("a,b", True)
    assert inside('a,"b', False) and not inside('b",c', True) and inside('b","c', True)
    assert not inside('a 5" wide,b', False) and inside('a,"say ""hi""', False) and not inside('"say ""hi""",b', False)
    assert inside('he said ""x""', True) and not inside('"a"b,c', False) and inside('"a"b,"c', False)


def test_running_cases(spark):
    """All four kinds of blocks in a row, against a plain walk."""
    r = random.Random(9)
    rows = [("f", i, r.random() < 0.5, r.random() < 0.5) for i in range(60)] + [("g", i, False, True) for i in range(3)]
    table = spark.createDataFrame([(*x, False) for x in rows], "_file string, _block long, outside boolean, inside boolean, returns boolean")
    found = {(x._file, x._block): x.starts_inside for x in records.block_cases(table).collect()}
    now = {"f": False, "g": False}
    for name, block, outside, inside in rows:
        assert found[name, block] == now[name]
        now[name] = inside if now[name] else outside


def test_a_block_without_its_case_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n2\n")
    lines = records._lines(spark, str(tmp_path)).withColumns({
        "starts_inside": F.lit(None).cast("boolean"), "returns": F.lit(False)}).select("_file", "_block", "value", "starts_inside", "returns")
    with pytest.raises(Exception, match="changed while"):
        lines.mapInArrow(records._cut, records._PIECE).collect()
