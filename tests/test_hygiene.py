import pytest
from pyspark.sql import functions as F

from tradeloom.functions import crypto, text as tx
from tradeloom.operators import governance as gov, hygiene


def verdicts(spark, files, **kw):
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files], "filename string, content binary")
    return {r.filename: r.verdict for r in hygiene.file_scan(df, **kw).collect()}


def test_file_stages(spark):
    got = verdicts(spark, [
        ("ok.csv", b"a,b\n1,2\n"), ("none.csv", b""), ("noext", b"x"), ("a.exe", b"x"), ("a.exe.csv", b"x"), ("a.b.csv", b"x"), ("x.xlsx", b"plain"),
        ("z.xlsx", b"PK\x03\x04rest"), ("l.xls", b"\xd0\xcf\x11\xe0rest"), ("s.csv", b"a,<SCRIPT>"), ("mz.txt", b"MZ\x90 data"), ("elf.txt", b"\x7fELF"), ("f.csv", b"=A1,2\n3,4\n")])
    assert got == {"ok.csv": "accepted", "none.csv": "empty", "noext": "no_extension", "a.exe": "extension_not_allowed", "a.exe.csv": "embedded_extension",
                   "a.b.csv": "accepted", "x.xlsx": "signature_mismatch", "z.xlsx": "accepted", "l.xls": "accepted", "s.csv": "dangerous_content",
                   "mz.txt": "dangerous_content", "elf.txt": "dangerous_content", "f.csv": "formula_injection"}


def test_whole_files_are_scanned(spark):
    late = b"x," * 40000 + b"<script"
    rows = b"1,2\n" * 60 + b"=A,=B\n" * 20
    assert verdicts(spark, [("a.csv", late), ("b.csv", rows)]) == {"a.csv": "dangerous_content", "b.csv": "formula_injection"}


@pytest.mark.parametrize("cell, bad", [("-20%", 0), ("+15.5", 0), ('"-1"', 0), ("(1200)", 0), ("£-1200.50", 0), ("=SUM(A1)", 1), ("@cmd", 1), ("-cmd", 1), ("- ", 1), ("", 0), ("x", 0)])
def test_injection_cells(spark, cell, bad):
    df = spark.createDataFrame([(cell,)], "t string").select(hygiene.csv_injection_share(F.col("t").cast("binary"), F.lit("csv")).alias("s"))
    assert df.first().s == bad


def test_five_percent_is_accepted(spark):
    assert verdicts(spark, [("a.csv", b"=x," + b"1," * 18 + b"1"), ("b.csv", b"=x," + b"1," * 17 + b"1")]) == {"a.csv": "accepted", "b.csv": "formula_injection"}
    assert verdicts(spark, [("a.tsv", b"=x\t1\n=y\t2")]) == {"a.tsv": "formula_injection"}


def test_masking(spark):
    df = spark.createDataFrame([("1", "Acme", "v1", "n", 2.0), ("2", "", None, "m", 3.0)], "sku string, supplier string, vendor_id string, buyer_notes string, revenue double")
    got = gov.mask_standard(df)
    assert got.columns == ["sku", "supplier", "vendor_id", "revenue"]
    a, b = got.orderBy("sku").collect()
    assert a.supplier == "VENDOR-37036CD8" and a.vendor_id.startswith("VENDOR-") and b.supplier is None and b.vendor_id is None


def test_sanitise(spark):
    df = spark.createDataFrame([(" ＜b＞ & 'q' \u2003",), (None,), ("x" * 3000,)], "t string").select(tx.page_text(F.col("t")).alias("c"), tx.too_long(tx.plain_text(F.col("t")), "uuid").alias("r"))
    a, b, c = df.collect()
    assert a.c == "&lt;b&gt; &amp; &#x27;q&#x27;" and b.c == "" and len(c.c) == 3000 and c.r and not a.r


def test_safe_filename(spark):
    cases = {"../../etc/passwd": "passwd", "C:\\x\\y.csv": "y.csv", "a:b*?.txt": "a_b__.txt", "...hid": "hid", "": "upload", "a/": "upload", "n\x00ul.csv": "nul.csv", "x" * 300: "x" * 300, "\x01.\x02..a": "a", "a/..": "upload", "x\ny/z\n": "z"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("n", tx.safe_filename(F.col("t")))
    assert {r.t: r.n for r in df.collect()} == cases


def test_injection_flags(spark):
    cases = {"hello world": (False, False), "1; DROP TABLE x": (True, False), "a OR 1=1": (True, False), "x /* y\n */": (True, False), "selection": (False, False),
             "<ScRipt>": (False, True), "JAVASCRIPT:alert": (False, True), "onclick =": (False, True), "note -- end": (True, False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.has_sql_injection(F.col("t")).alias("s"), tx.has_xss(F.col("t")).alias("x"))
    assert {r.t: (r.s, r.x) for r in df.collect()} == cases


def test_encryption_round_trip(spark):
    key = F.unhex(F.sha2(F.lit("k"), 256))
    df = spark.createDataFrame([("hello",), ("",), ("é" * 50,)], "t string")
    enc = df.withColumn("b", crypto.encrypt(F.col("t").cast("binary"), key)).withColumn("e", crypto.encrypt_text(F.col("t"), key))
    rows = enc.select("t", F.length("b").alias("n"), crypto.decrypt(F.col("b"), key).cast("string").alias("d"), crypto.decrypt_text(F.col("e"), key).alias("dt"),
                      crypto.decrypt(F.concat(F.col("b"), F.unhex(F.lit("00"))), key).alias("bad"), "e").collect()
    for r in rows:
        assert r.d == r.t == r.dt and r.n == len(r.t.encode()) + 28 and r.bad is None and "+" not in r.e and "/" not in r.e


def test_permissions_and_ownership(spark):
    df = spark.createDataFrame([("Director", "view_audit_logs"), ("AM", "view_audit_logs"), ("Guest", "ai_chat"), ("Admin", "unknown")], "r string, a string")
    assert [r.p for r in df.select(gov.has_permission(F.col("r"), F.col("a")).alias("p")).collect()] == [True, False, False, False]
    own = spark.createDataFrame([("Admin", None, "1"), ("MA", "1", "1"), ("MA", "1", "2"), ("MA", None, None), ("MA", "", "")], "r string, u string, c string")
    assert [r.o for r in own.select(gov.owns(F.col("r"), F.col("u"), F.col("c")).alias("o")).collect()] == [True, True, False, False, False]
