import pytest
from pyspark.sql import functions as F

from tradeloom.sources import delimited
from tradeloom.sources.roles import ROLES, has_role, mask_of, missing_required, resolve_roles, roles_present


@pytest.mark.parametrize("header", ["Units Sold", "units_sold", "UNITSSOLD", "unitssold"])
def test_header_spelling(header):
    assert resolve_roles([header])["units"] == header


def test_candidate_order_and_duplicates():
    assert resolve_roles(["Qty", "Units"])["units"] == "Units"
    assert resolve_roles(["SKU", "sku", "S K U"])["sku"] == "S K U"
    assert resolve_roles(["Margin £", "GM %", "Weeks of Stock"]) == {"margin_pct": "GM %", "margin_value": "Margin £", "cover_weeks": "Weeks of Stock"}


def test_missing_columns_are_named():
    text = missing_required(["SKU", "Colour"] + [f"c{i}" for i in range(12)])
    assert "UnitsSold, Revenue" in text and "SKU, Colour, c0" in text and text.endswith("c7....")
    assert missing_required(["sku", "qty", "sales"]) is None


def test_role_mask(spark):
    df = spark.range(1).select(F.lit(mask_of(["sku", "stock"])).alias("role_mask"))
    assert df.select(roles_present()).first()[0] == ["sku", "stock"]
    assert df.select(has_role("stock"), has_role("brand")).first() == (True, False)
    assert mask_of(ROLES) == (1 << 17) - 1


@pytest.fixture()
def folder(tmp_path):
    files = {
        "comma.csv": 'SKU,Units Sold,Revenue,Margin %\nA1,3,"£1,200.50",29.8%\n\nA2,x,N/A,50%\n',
        "semi.csv": "\ufeffproduct_code;Qty;Net Sales;Empty;Unnamed: 3\nB1;2;10;;q\n;;;;\nB2;4;20;;\n",
        "tabs.tsv": "Item Code\tPieces\tTurnover\tSell Through\nC1\t1\t5\t0.25\nC2\t2\t6\t0.5\n",
        "pipe.txt": "Style|QUANTITY|Total Revenue|Stock\nD1|1|5|\nD2|2|6|7\n",
        "bad.csv": "SKU,Colour\nE1,red\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_delimiters(spark, folder):
    got = {r.file.rsplit("/", 1)[1]: r.delimiter for r in delimited.headers(spark, folder).collect()}
    assert got == {"comma.csv": ",", "semi.csv": ";", "tabs.tsv": "\t", "pipe.txt": "|", "bad.csv": ","}


def test_scan_and_clean(spark, folder):
    raw, rejected = delimited.scan_delimited(spark, folder)
    assert [(r.file.rsplit("/", 1)[1], "Revenue" in r.reason) for r in rejected.collect()] == [("bad.csv", True)]
    rows = {r.sku: r for r in delimited.clean_lines(raw).collect()}
    assert set(rows) == {"A1", "A2", "B1", "B2", "C1", "C2", "D1", "D2"}
    assert (float(rows["A1"].revenue), rows["A1"].margin_pct, rows["A1"].margin_source) == (1200.5, 29.8, "explicit")
    assert (float(rows["A2"].units), float(rows["A2"].revenue)) == (0, 0)
    assert (rows["C1"].sell_through, rows["C2"].sell_through) == (25.0, 50.0)
    assert rows["B1"].stock is None and rows["D1"].stock == 0.0 and rows["D2"].stock == 7.0
    assert rows["A1"].row_id < rows["A2"].row_id


def test_columns_empty_in_one_dataset_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SKU,Qty,Sales,Stock\nx,1,10,\ny,2,20,NA\n")
    (tmp_path / "b.csv").write_text("SKU,Qty,Sales,Stock\nx,1,10,\ny,2,20,4\n")
    (tmp_path / "c.csv").write_text("SKU,Qty,Sales,Stock\nx,1,,5\ny,2,n/a,4\n")
    raw, _ = delimited.scan_delimited(spark, str(tmp_path))
    got = {(r.dataset_id, r.sku): r.stock for r in delimited.clean_lines(raw).collect()}
    assert got == {("a.csv", "x"): None, ("a.csv", "y"): None, ("b.csv", "x"): 0.0, ("b.csv", "y"): 4.0}
    assert [tuple(r) for r in delimited.incomplete_datasets(raw).collect()] == [("c.csv", "Missing required columns: Revenue.")]


def test_best_table(spark):
    tables = spark.createDataFrame([
        ("d", 0, ["notes"]), ("d", 1, ["SKU", "Rev enue"]), ("d", 2, ["sku", "UNITS_SOLD"]), ("e", 0, ["x"]), ("e", 1, ["y"])],
        "dataset_id string, position int, headers array<string>")
    assert {(r.dataset_id, r.position, r.score) for r in delimited.pick_best_table(tables).collect()} == {("d", 1, 2), ("e", 0, 0)}


def test_inventory(spark, folder):
    import hashlib

    got = {r.filename: r for r in delimited.file_inventory(spark, folder).collect()}
    raw = open(f"{folder}/bad.csv", "rb").read()
    assert (got["bad.csv"].size, got["bad.csv"].sha256, got["bad.csv"].extension) == (len(raw), hashlib.sha256(raw).hexdigest(), "csv")


def test_inventory_of_large_files(spark, tmp_path, monkeypatch):
    """Bytes of every kind, read as a stream: line ends, marks at the start, no text at all."""
    import hashlib
    import random

    r = random.Random(5)
    files = {"end.csv": b"a,b\n" * 900, "open.csv": b"a,b\n" * 900 + b"c", "mark.csv": b"\xef\xbb\xbf" + b"a\r\n" * 900, "mark_open.csv": b"\xef\xbb\xbf" + b"a\n" * 900 + b"\xef\xbb\xbf", "bytes.bin": r.randbytes(50_000),
             "breaks.bin": b"\n" * 3000, "wide.bin": b"\0" * 3000, "cr.bin": b"\r" * 2000 + b"\n\r\n", "small.csv": b"x", "packed.csv.gz": r.randbytes(4000), "PACKED.GZ": r.randbytes(4000)}
    (tmp_path / "below").mkdir()
    for name, raw in files.items():
        (tmp_path / "below" / name).write_bytes(raw)
    got = {x.filename: (x.size, x.sha256) for x in delimited.file_inventory(spark, str(tmp_path), large=1000).collect()}
    assert got == {name: (len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in files.items()}


def test_inventory_of_all_lines(spark, sf_dir):
    import hashlib

    from tradeloom.plans import catalogue

    lines = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").collect():
        lines.setdefault(r[0], []).append("|".join(map(str, r[1:])) + "\n")
    files = {k: "".join(sorted(v)).encode() for k, v in lines.items()}
    got = {r["key"]: (r["size"], r["sha256"]) for r in catalogue.QUERIES["supplier_inventory"](spark, sf_dir).collect()}
    assert got == {k: (len(f), hashlib.sha256(f).hexdigest()) for k, f in files.items()}


def test_inventory_writes_no_checksum_files(spark, sf_dir):
    """Each would be one more file to make, and its mode one more process where Hadoop's native library is missing."""
    import glob

    from tradeloom.plans import catalogue
    from tradeloom.staging import job_folder

    before = set(glob.glob(f"{job_folder(spark)}/files-*"))
    n = catalogue.QUERIES["supplier_inventory"](spark, sf_dir).count()
    made = (set(glob.glob(f"{job_folder(spark)}/files-*")) - before).pop()
    assert len(glob.glob(f"{made}/key=*/*.txt")) == n and not glob.glob(f"{made}/key=*/.*.crc")


def scanned(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    return delimited.scan_delimited(spark, str(tmp_path))


def test_quoted_cells(spark, tmp_path):
    text = '\n\nSKU,Product Name,Qty,Sales\r\nA1,"Red ""big"", shirt",1,"1,000"\r\nA2,"line one\nline two",2,20\r\nA3,plain,3,30,extra\r\nA4,short\r\n'
    raw, rejected = scanned(spark, tmp_path, quoted=text)
    rows = {r.sku: r for r in raw.collect()}
    assert set(rows) == {"A1", "A2", "A3", "A4"} and rejected.count() == 0
    assert (rows["A1"].name, rows["A1"].revenue, rows["A2"].name, rows["A2"].units) == ('Red "big", shirt', "1,000", "line one\nline two", "2")
    assert (rows["A3"].revenue, rows["A4"].name, rows["A4"].units) == ("30", "short", None)
    assert [r.sku for r in raw.orderBy("row_id").collect()] == ["A1", "A2", "A3", "A4"]


def test_headers_equal_but_for_case(spark, tmp_path):
    raw, _ = scanned(spark, tmp_path, case="SKU,sku,Qty,Sales\nfirst,second,1,2\n", same="SKU,SKU,Qty,Sales\nthird,fourth,1,2\n")
    assert {r.sku for r in raw.collect()} == {"second", "third"}


def test_numbers_beyond_their_column(spark, tmp_path):
    raw, _ = scanned(spark, tmp_path, good="SKU,Qty,Sales\nx,1,10\n", huge="SKU,Qty,Sales,Stock,GM%\na,1,5012345678901234567,1e400,1e300\nb,1e400,£7,3,20%\nc,n/a,text,1,1\n")
    lines = {r.sku: r for r in delimited.clean_lines(raw).collect()}
    assert (float(lines["a"].revenue), lines["a"].stock, float(lines["b"].units), float(lines["b"].revenue), float(lines["x"].revenue)) == (0, 0, 0, 7, 10)
    lost = {(r.role, r.cell) for r in delimited.unreadable_cells(raw).collect()}
    assert lost == {("revenue", "5012345678901234567"), ("stock", "1e400"), ("units", "1e400")}
    from tradeloom.operators.rollup import dataset_kpis, sku_rollup

    assert dataset_kpis(sku_rollup(delimited.clean_lines(raw))).count() == 2


def test_odd_files(spark, tmp_path):
    raw, rejected = scanned(spark, tmp_path, blank="\n \n", header="SKU,Qty,Sales", single="SKU,Qty,Sales\nz,1,2", open='SKU,Qty,Sales\ny,1,"2\n3')
    assert {r.sku for r in raw.collect()} == {"z", "y"}
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in rejected.collect()} == {("blank.csv", "File is empty.")}


def test_many_headers_make_one_plan(spark, tmp_path):
    raw, _ = scanned(spark, tmp_path, **{f"f{i}": f"SKU,Qty,Sales,Extra {i}\ns{i},1,2,3\n" for i in range(60)})
    assert raw.count() == 60 and "Union" not in raw._jdf.queryExecution().optimizedPlan().toString()


def test_sheets_are_written_from_one_pass_over_the_lines(spark, sf_dir, monkeypatch):
    """Every sheet starts with its header, and the written plan reads lineitem once."""
    from pyspark.sql import DataFrameWriter

    from tradeloom.plans import streams

    plans, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().sparkPlan().toString()), text(self, *a, **k))[1])
    path = streams.written_sheets(spark, sf_dir)
    assert plans[0].count("l_discount") and sum("FileScan" in line and "l_orderkey" in line for line in plans[0].splitlines()) == 1
    found = delimited.parsed(spark, path)
    assert found.where("n < 0 and reason is null").count() == found.select("file").distinct().count()
    assert found.where("n >= 0").count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_rows_of_a_sheet_at_chunk_borders(tmp_path):
    """Short, blank and overlong rows, empty marks, and more rows than one chunk."""
    head, lines = "SKU,Units,Revenue,Notes", []
    for i in range(delimited.CHUNK + 5):
        lines.append(["a,1,2,x", "b", "", ",,,", ",,,note", "c,n/a,3,,extra"][i % 6])
    rows = [r for b in delimited.Sheet(head, ",").rows(iter(lines), ("f", "d", 0)) for r in b.to_pylist()]
    whole = [(n, *{0: ("a", "1", "2"), 1: ("b", None, None), 4: (None,) * 3, 5: ("c", None, "3")}[n % 6]) for n in range(delimited.CHUNK + 5) if n % 6 in (0, 1, 4, 5)]
    assert [(r["n"], r["sku"], r["units"], r["revenue"]) for r in rows] == whole
    assert {(r["file"], r["dataset_id"], r["block"]) for r in rows} == {("f", "d", 0)}


def test_number_marks_are_read_as_by_the_patterns(spark):
    from tradeloom.functions.numbers import WHOLE_NUMBER, cell_number, without_marks

    cells = ["£1,234.50", "5%", "5 %", "5%%", "%", "5% ", "5%\u0085", "+.5e3", "12d", "nan", "1e400", "\t7\r\n", "\x0b8\f", "(5)", "", None, "₹9", "€1 000", "5 "]
    old = F.regexp_extract(without_marks(F.col("c")), r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z", 0).try_cast("double")
    old = F.nullif(F.nullif(old, F.lit(float("inf"))), F.lit(float("-inf")))
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", cell_number(F.col("c")).alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in got) and got[0].new == 1234.5 and got[1].new == 5.0 and got[3].new is None
