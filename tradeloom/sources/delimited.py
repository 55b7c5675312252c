"""Reading delimited sheets (CSV, TSV, TXT) with the delimiter found per file.

Lines come through Spark's text reader, from any store it reads, in splits of any size, and are
not moved: a task cuts its split into records on its own (see ``splits``). The first non-blank line
of a file gives the delimiter and the header, the header the position of every role. Files of a
single split, the usual case, are read once. For larger ones a pass before finds out how each
split starts; one small row a split tells its task, together with the header. Only records that lie across
borders of splits are brought together. No file is held whole, no list of files or headers
passes through the driver, and the plan doesn't grow with the number of headers.
"""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress, islice, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tradeloom.functions.numbers import cell_number, clean_numeric, in_range, parse_number, without_marks
from tradeloom.operators.rollup import as_percent, derive_margin
from tradeloom.sources.roles import KEY_HEADERS, REQUIRED, ROLES, has_role, mask_of, missing_required, role_positions
from tradeloom.sources.splits import OPEN, RECORD, cut, entries, header_of, stretches
from tradeloom.staging import staged

# Cell texts that count as empty.
EMPTY_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
               "NaN", "None", "n/a", "nan", "null"]
NUMERIC_ROLES = ["units", "revenue", "stock", "cost", "full_price_sales", "buy_qty", "margin_value", "retail",
                 "margin_pct", "sell_through", "cover_weeks"]
MONEY = {"units": "decimal(18,2)", "revenue": "decimal(18,4)", "cost": "decimal(18,4)", "margin_value": "decimal(18,6)",
         "retail": "decimal(18,2)", "full_price_sales": "decimal(18,4)"}
CHUNK = 1000
#: Rows of ``entries`` up to which they are broadcast: one for each further 128 MB of large files.
MAX_SPLITS = 1_000_000
NO_HEADER = "The header has to start and end in a file's first split."
_FACTS = ["file", "dataset_id", "block"]
_PARSED = ("file string, dataset_id string, block long, n long, " + ", ".join(f"{r} string" for r in ROLES)
           + ", role_mask int, header string, delimiter string, found map<string,string>, reason string, kind string, text string, head string")
_KINDS = {"block": pa.int64(), "n": pa.int64(), "role_mask": pa.int32(), "found": pa.map_(pa.string(), pa.string())}
_FIELDS = [f.strip().split()[0] for f in _PARSED.replace("map<string,string>", "map").split(",")]


class Sheet:
    """What a header record says: positions of the roles, and a reason to reject the file."""

    def __init__(self, head: str, delimiter: str):
        csv.field_size_limit(1 << 30)
        self.delimiter = delimiter
        columns = [c.strip() for c in next(csv.reader([head], delimiter=delimiter), [])]
        self.positions = role_positions(columns)
        self.named = [i for i, c in enumerate(columns) if c and not c.startswith("Unnamed:")]
        self.mask, self.reason = mask_of(self.positions), missing_required([columns[i] for i in self.named])
        self.found = {r: columns[i] for r, i in self.positions.items()}

    def rows(self, records: Iterator[str], facts: tuple) -> Iterator[pa.RecordBatch]:
        """The cells of records by role; records without any cell are left out."""
        empty, at, begin = {*EMPTY_CELLS, None}, list(self.positions.values()), 0
        reader = csv.reader(records, delimiter=self.delimiter, doublequote=True)
        while chunk := list(islice(reader, CHUNK)):
            # Whole columns at once: a column without an empty cell needs no look at its cells.
            columns = list(zip_longest(*chunk))
            columns += [(None,) * len(chunk)] * (max([*at, *self.named], default=-1) + 1 - len(columns))
            numbers, held = range(begin, begin + len(chunk)), [columns[i] for i in at]
            begin += len(chunk)
            if not any(map(empty.isdisjoint, held)):
                kept = [any(c not in empty for c in cells) for cells in zip(*held, *[columns[i] for i in self.named])]
                numbers, held = list(compress(numbers, kept)), [list(compress(c, kept)) for c in held]
            if numbers:
                yield self.batch([c if empty.isdisjoint(c) else [None if x in empty else x for x in c] for c in held], numbers, facts)

    def batch(self, columns: list, numbers, facts: tuple) -> pa.RecordBatch:
        same = {**dict(zip(_FACTS, facts)), "role_mask": self.mask}
        return batch_of(len(numbers), {**dict(zip(self.positions, columns)), "n": numbers, **{k: pa.repeat(pa.scalar(v, _KINDS.get(k, pa.string())), len(numbers)) for k, v in same.items()}})


def batch_of(n: int, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = [(f, _KINDS.get(f, pa.string())) for f in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(columns[f], k) if f in columns else pa.nulls(n, k) for f, k in kinds], _FIELDS)


def one_row(facts: tuple, **values) -> pa.RecordBatch:
    return batch_of(1, {**{k: [v] for k, v in zip(_FACTS, facts)}, **{k: [list(v.items()) if k == "found" else v] for k, v in values.items()}})


def lines_of(spark: SparkSession, path: str, dataset: Column | None) -> DataFrame:
    """(file, dataset_id, block, whole, value) of all lines of a folder; a split's lines lie in one
    partition, in order. ``whole`` says that the file has no other split."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    whole = F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    return text.select(F.col("_metadata.file_path").alias("file"), (file_stem() if dataset is None else dataset).alias("dataset_id"),
                       F.col("_metadata.file_block_start").alias("block"), whole.alias("whole"), "value")


def sheet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers, records and fragments of a task's splits."""
    for (file, dataset_id, block, whole, inside, delimiter, head), lines in stretches(batches, 7):
        facts, left = (file, dataset_id, block), []
        if block == 0:
            found = header_of(lines)
            if found is None and whole:
                continue
            first, delimiter, head, cuts = found or (None, None, None, None)
            sheet = Sheet(head, delimiter) if head else None
            reason = sheet.reason if sheet else NO_HEADER
            yield one_row(facts, n=-1, header=first, delimiter=delimiter, found=sheet.found if sheet else {}, reason=reason)
        elif inside is None:
            raise RuntimeError(f"splits of {file} changed while it was read")
        else:
            sheet = Sheet(head, delimiter) if head else None
            reason, cuts = sheet.reason if sheet else NO_HEADER, cut(lines, inside, delimiter)
        if reason:
            continue
        yield from sheet.rows(whole_records(cuts, left, whole), facts)
        for n, (kind, text) in left:
            yield one_row(facts, n=n, kind=kind, text=text, delimiter=delimiter, head=head)


def whole_records(cuts: Iterator[tuple[str, str]], left: list, whole: bool) -> Iterator[str]:
    """Records of a split; fragments, numbered as records, go to ``left``."""
    n = 0
    for kind, text in cuts:
        if kind == RECORD or kind == OPEN and whole:
            yield text
            n += 1
        else:
            left.append((n, (kind, text)))


def records(lines: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Headers (n = -1), records and fragments of ``lines``; ``starts`` are the staged ``entries``."""
    if starts is None:
        lines = lines.select("*", F.lit(None).cast("boolean").alias("inside"), *[F.lit(None).cast("string").alias(c) for c in ("delimiter", "head")])
    elif starts.count() <= MAX_SPLITS:
        lines = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("place", F.monotonically_increasing_id())
        lines = numbered.join(starts, ["file", "block"], "left").sortWithinPartitions("file", "block", "place")
    return lines.select("file", "dataset_id", "block", "whole", "inside", "delimiter", "head", "value").mapInArrow(sheet_rows, _PARSED)


def stitched(fragments: DataFrame) -> DataFrame:
    """Records whose parts lie in several splits, at the place they begin."""
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == OPEN)
    begun = F.last(F.when(F.col("kind") == OPEN, F.struct("block", "n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = fragments.select("file", "dataset_id", "delimiter", "head", begun.alias("begun"), F.struct("block", "text").alias("part"))
    whole = parts.groupBy("file", "dataset_id", "delimiter", "head", "begun").agg(F.array_sort(F.collect_list("part"))["text"].alias("texts"))
    whole = whole.select("file", "dataset_id", "begun.block", "begun.n", "delimiter", "head", F.array_join("texts", "\n").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, dataset_id, block, n, delimiter, head), texts in stretches(batches, 6):
            for batch in Sheet(head, delimiter).rows(texts, (file, dataset_id, block)):
                yield batch.set_column(_FIELDS.index("n"), "n", pa.array([n] * batch.num_rows, pa.int64()))

    return whole.mapInArrow(parse, _PARSED)


def parsed(spark: SparkSession, path: str, dataset: Column | None = None) -> DataFrame:
    """All files of a folder, staged: a row for each header (n = -1) and each record."""
    # The splits of both passes have to be the same, whatever cores come and go between them.
    setting, confs = "spark.sql.files.minPartitionNum", [spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")]
    given = spark.conf.get(setting, None)
    largest = sizes(spark, path).agg(F.max("length")).first()[0] or 0
    if given is None:
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    try:
        lines, starts = lines_of(spark, path, dataset), None
        if largest > min(map(in_bytes, confs)):
            starts = staged(entries(lines.where("NOT whole")), "split-entries")
        found = staged(records(lines, starts), "sheets")
    finally:
        if given is None:
            spark.conf.unset(setting)
    complete, fragments = found.where("kind IS NULL").drop("kind", "text", "head"), found.where("kind IS NOT NULL")
    if starts is None or starts.isEmpty():
        return complete
    return complete.unionByName(staged(stitched(fragments), "stitched").drop("kind", "text", "head"))


def in_bytes(setting: str) -> int:
    """Bytes of a size setting such as 134217728b or 128MB."""
    number = setting.rstrip("bBkKmMgGtT")
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(setting[len(number):].lower().rstrip("b"), 0)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("_metadata.file_path").alias("file"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, header, delimiter and the header name found for each role, of every file with a line."""
    return parsed(spark, path).where("n < 0").select("file", "header", "delimiter", "found")


def drop_empty(df: DataFrame, keep: tuple = ("dataset_id", "row_id")) -> DataFrame:
    """Trim header names; drop columns without a value, ``Unnamed:`` columns and rows
    without a value."""
    df = df.toDF(*[c.strip() for c in df.columns])
    data = [c for c in df.columns if c not in keep]
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(data)]).first()
    live = [c for i, c in enumerate(data) if filled[i] and not c.startswith("Unnamed:")]
    out = df.select(*[f"`{c}`" for c in df.columns if c in keep], *[f"`{c}`" for c in live])
    return out.dropna("all", subset=[f"`{c}`" for c in live]) if live else out.limit(0)


def file_stem() -> Column:
    """One file, one dataset."""
    return F.col("_metadata.file_name")


def scan_delimited(spark: SparkSession, path: str, dataset: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Role-mapped raw sheets of a folder, and the rejected files with their reason. Both results
    come from the stored records. A file of no bytes is one that Spark's readers don't list, so it
    is neither read nor rejected."""
    found = parsed(spark, path, dataset)
    raw = found.where("n >= 0").select("dataset_id", F.struct("file", "block", "n").alias("row_id"), *ROLES, "role_mask")
    blank = sizes(spark, path).select("file").join(found.where("n < 0").select("file"), "file", "left_anti").select("file", F.lit("File is empty.").alias("reason"))
    return raw, found.where("reason IS NOT NULL").select("file", "reason").unionByName(blank)


def unreadable_cells(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of numeric roles that hold a number no column can keep: not finite, or too large
    for its type. They count as 0, as any unreadable cell does; this table names them. Columns in
    ``keep`` come along from the cell's row, which spares a join with all rows."""
    number = lambda r: parse_number(without_marks(F.col(r)))
    lost = [F.when(number(r).isNotNull() & ~F.coalesce(in_range(number(r), MONEY.get(r, "double")).isNotNull(), F.lit(False)), F.struct(F.lit(r).alias("role"), F.col(r).alias("cell"))) for r in NUMERIC_ROLES]
    cells = raw.select("dataset_id", "row_id", *keep, F.explode(F.array_compact(F.array(*lost))).alias("c"))
    return cells.select("dataset_id", "row_id", *keep, "c.role", "c.cell")


PERCENTS = ["margin_pct", "sell_through"]


def number_in(role: str) -> Column:
    return clean_numeric(F.col(role))


def dataset_facts(raw: DataFrame, percents: list[str]) -> DataFrame:
    """Per dataset: the roles that hold any value at all, and the largest percentages.

    A column that is empty in every row of a dataset counts as absent there, whatever the
    same header holds in other datasets.
    """
    bits = [F.when(F.count(r) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(ROLES)]
    largest = [F.max(F.when(F.col(r).isNotNull(), number_in(r))).alias(f"max_{r}") for r in percents]
    return raw.groupBy("dataset_id").agg(reduce(lambda a, b: a + b, bits).cast("int").alias("role_mask"), *largest)


def complete(mask: str = "role_mask") -> Column:
    return reduce(lambda a, b: a & b, [has_role(r, mask) for r in REQUIRED])


def clean_lines(raw: DataFrame, fix_cover: bool = False) -> DataFrame:
    """Trading lines from role-mapped sheets: numbers cleaned, fractions turned into
    percentages, margin derived. Roles a dataset lacks stay NULL; datasets without SKU,
    units or revenue are left out (see ``incomplete_datasets``)."""
    percents = PERCENTS + (["cover_weeks"] if fix_cover else [])
    facts = staged(dataset_facts(raw, percents), "facts")
    out = raw.drop("role_mask").join(facts.where(complete()), "dataset_id")
    # One small function reads all cells: eleven copies of it in one compiled method are too large for the JVM to optimise.
    out = out.withColumn("_numbers", F.transform(F.array(*[F.when(has_role(r), F.coalesce(r, F.lit(""))) for r in NUMERIC_ROLES]), lambda c: F.when(c.isNotNull(), clean_numeric(c))))
    number = lambda i, kind: F.get("_numbers", F.lit(i)) if kind == "double" else F.coalesce(F.get("_numbers", F.lit(i)).try_cast(kind), F.when(F.get("_numbers", F.lit(i)).isNotNull(), F.lit(0).cast(kind)))
    out = out.withColumns({r: number(i, MONEY.get(r, "double")) for i, r in enumerate(NUMERIC_ROLES)}).drop("_numbers")
    out = out.withColumns({r: as_percent(r, f"max_{r}") for r in percents})
    return derive_margin(out.drop(*[f"max_{r}" for r in percents]))


def incomplete_datasets(raw: DataFrame) -> DataFrame:
    """Datasets whose SKU, units or revenue column holds no value, with the reason."""
    absent = F.array_compact(F.array(*[F.when(~has_role(r), F.lit(label)) for r, label in REQUIRED.items()]))
    return dataset_facts(raw, []).where(~complete()).select(
        "dataset_id", F.concat(F.lit("Missing required columns: "), F.array_join(absent, ", "), F.lit(".")).alias("reason"))


def pick_best_table(tables: DataFrame) -> DataFrame:
    """Of the tables of each dataset, the one whose header knows most key columns.

    ``tables``: dataset_id, position, headers ARRAY<STRING>. Ties go to the first.
    """
    bare = F.transform("headers", lambda h: F.regexp_replace(F.lower(h), "[ _]", ""))
    keys = F.array(*[F.lit(k) for k in KEY_HEADERS])
    scored = tables.withColumn("score", F.size(F.array_intersect(bare, keys)))
    best = F.max_by(F.struct("position", "score"), F.struct("score", -F.col("position")))
    return scored.groupBy("dataset_id").agg(best.alias("b")).select("dataset_id", "b.position", "b.score")


# Endings by which Spark's text reader takes a file for a compressed one.
PACKED = ["gz", "bz2", "deflate", "lz4", "snappy", "zst"]
BOM = b"\xef\xbb\xbf"


def file_inventory(spark: SparkSession, path: str, large: int = 128 << 20) -> DataFrame:
    """Size, SHA-256 and extension of raw files of a folder and the folders below it.

    Files above ``large`` bytes pass line by line through a running hash, each in a task of its own, so
    no file has to fit into a cell or a task's memory. Compressed ones, whose bytes only the reader of
    whole files gives, have to (2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = (F.col("length") <= large) | F.lower("path").rlike(r"\.(" + "|".join(PACKED) + ")$")
    small = files.where(whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    found = small
    if not files.where(~whole).select("path").isEmpty():
        found = small.unionByName(streamed_digests(spark, path, large))
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("filename"), "size", "sha256", F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"))


def streamed_digests(spark: SparkSession, path: str, large: int) -> DataFrame:
    """(path, size, sha256) of the files above ``large`` bytes, read in one piece each but never held."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, size, block), lines in stretches(batches, 3, decode=False):
            if block:
                raise RuntimeError(f"{file} was read in pieces")
            # The reader takes line ends away, and a mark at the start; what is missing in the end tells.
            running, marked, n, held, n_held = hashlib.sha256(), hashlib.sha256(BOM), 0, [], 0
            for line in lines:
                held.append(line)
                n, n_held = n + len(line) + 1, n_held + len(line)
                if n_held > 1 << 20 and len(held) > 1:
                    piece = b"\n".join([*held[:-1], b""])
                    running.update(piece)
                    marked.update(piece)
                    held, n_held = [line], len(line)
            rest = b"\n".join(held if n - size in (1, -2) else [*held, b""])
            chosen = marked if n - size in (-2, -3) else running
            if n - size not in (1, 0, -2, -3):
                raise RuntimeError(f"{file} has {size} bytes, of which {n} were read")
            chosen.update(rest)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([chosen.hexdigest()])], ["path", "size", "sha256"])

    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = lines.where((F.col("size") > large) & ~F.lower("file").rlike(r"\.(" + "|".join(PACKED) + ")$"))
    # A split takes files up to a size and the cost of opening them: with both at 8 TB, one file each.
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(1 << 43))
        return staged(lines.mapInArrow(digest, "path string, size bigint, sha256 string"), "digests")
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
