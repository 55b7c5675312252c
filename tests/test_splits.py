"""Records cut split by split are those a whole file has."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tradeloom.sources import delimited, splits


def by_parts(lines, parts, delimiter):
    """Texts of all records of a file whose lines are read in parts; the last may have no end."""
    inside, records, pending = False, [], None
    for a, b in parts:
        function = splits.Function()
        for line in lines[a:b]:
            function.take(line)
        for kind, text in splits.cut(iter(lines[a:b]), inside, delimiter):
            if kind == splits.OPEN:
                pending = text
            elif kind == splits.MORE:
                pending += "\n" + text
            else:
                records.append(text if kind == splits.RECORD else pending + "\n" + text)
                pending = None if kind == splits.CLOSE else pending
        inside = function.ends[2 * splits.DELIMITERS.index(delimiter) + inside]
        assert inside == (pending is not None)
    return records + ([pending] if inside else [])


def test_any_split_gives_the_records_of_the_whole():
    r = random.Random(1)
    for _ in range(20_000):
        d = r.choice(splits.DELIMITERS)
        text = "".join(r.choice(['"', '"', d, "a", "\n", "\r", "\r\n", " ", ",", "b"]) for _ in range(r.randint(1, 24)))
        lines = text.removesuffix("\n").split("\n")
        a = r.randint(0, len(lines))
        b = r.randint(a, len(lines))
        got = [x for x in csv.reader(iter(by_parts(lines, [(0, a), (a, b), (b, len(lines))], d)), delimiter=d) if x]
        want = [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=d) if x]
        if text.endswith("\n") and want:  # a text reader doesn't tell whether the last line has an end
            want[-1][-1] = want[-1][-1].removesuffix("\n") if want[-1][-1] not in got[-1] else want[-1][-1]
        assert got == want, (text, d)


def sheet(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "2000")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_sheet_is_read_by_many_tasks(spark, tmp_path, small_splits, end):
    r = random.Random(7)
    odd = ["plain", "a,b", 'say ""hi""', 'say "hi"', "two\nlines", "three\r\nlines\rhere", "x" * 900 + "\n" + "y" * 4000, ""]
    rows = [[f"s{i}", r.choice(odd) if i % 7 == 0 else "shirt", str(i), f"{i},000.5"] for i in range(900)]
    (tmp_path / "big.csv").write_bytes(sheet([["SKU", "Product Name", "Qty", "Sales"], *rows], end).encode())
    (tmp_path / "small.csv").write_bytes(b"SKU,Qty,Sales\nz,1,2\n")
    tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 10
    raw, rejected = delimited.scan_delimited(spark, str(tmp_path))
    assert rejected.count() == 0
    got = [(x["sku"], x["name"], x["units"], x["revenue"]) for x in raw.where("dataset_id = 'big.csv'").orderBy("row_id").collect()]
    assert got == [(a, b or None, c, d) for a, b, c, d in rows]
    assert raw.where("dataset_id = 'small.csv'").count() == 1
    assert raw.select("row_id.block").distinct().count() > 10


def test_quotes_that_mislead(spark, tmp_path, small_splits):
    """Marks in the middle of cells, a cell over many splits, and a quote that is never closed."""
    rows = "".join(f's{i};5" pipe;{i};1\n' for i in range(400))
    wide = 's900;"' + "line of a note\n" * 900 + '";1;2\n'
    (tmp_path / "a.csv").write_text("SKU;Name;Qty;Sales\n" + rows + wide + rows)
    plain = rows.replace('"', "")
    (tmp_path / "b.csv").write_text("SKU;Name;Qty;Sales\n" + rows + 's9;"open;1;2\n' + plain)
    raw, _ = delimited.scan_delimited(spark, str(tmp_path))
    a = raw.where("dataset_id = 'a.csv'").orderBy("row_id").collect()
    assert [x["sku"] for x in a] == [f"s{i}" for i in range(400)] + ["s900"] + [f"s{i}" for i in range(400)]
    assert a[400]["name"] == "line of a note\n" * 900 and a[400]["units"] == "1" and a[5]["name"] == '5" pipe'
    b = raw.where("dataset_id = 'b.csv'").orderBy("row_id").collect()
    assert len(b) == 401 and b[-1]["name"] == "open;1;2\n" + plain.removesuffix("\n")


def test_headers_of_large_sheets(spark, tmp_path, small_splits):
    body = "".join(f"x{i},1,2\n" for i in range(900))
    (tmp_path / "late.csv").write_text("\n" * 3000 + "SKU,Qty,Sales\n" + body)
    (tmp_path / "endless.csv").write_text('SKU,Qty,"Sales\n' + body)
    (tmp_path / "lacks.csv").write_text("SKU,Colour\n" + body)
    (tmp_path / "lines.csv").write_text('SKU,"Qty",Sales,"a\nnote"\n' + body)
    raw, rejected = delimited.scan_delimited(spark, str(tmp_path))
    reasons = {x["file"].rsplit("/", 1)[1]: x["reason"] for x in rejected.collect()}
    assert reasons.keys() == {"late.csv", "endless.csv", "lacks.csv"} and "Revenue" in reasons["lacks.csv"]
    assert {x["dataset_id"]: x["count"] for x in raw.groupBy("dataset_id").count().collect()} == {"lines.csv": 900}


def test_text_is_not_shuffled(spark, tmp_path, small_splits):
    (tmp_path / "big.csv").write_text("SKU,Qty,Sales\n" + "".join(f'x{i},1,"2"\n' for i in range(2000)))
    lines = delimited.lines_of(spark, str(tmp_path), None)
    plan = delimited.records(lines, splits.entries(lines))._jdf.queryExecution().executedPlan().toString()
    text = plan[:plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "odd.csv").write_bytes(b"SKU,Name,Qty,Sales\nx,caf\xe9,1,2\n")
    raw, _ = delimited.scan_delimited(spark, str(tmp_path))
    assert raw.first()["name"] == "caf�"
