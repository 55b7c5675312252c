"""Incremental publishing: a sheet that is added, replaced or withdrawn changes its datasets only.

A sheet is kept as partial results that merge: per SKU the sums, the parts of the mean margin,
the first and last values with the place they come from; per week and channel the revenue. To publish
sheets, their own lines are summed up, the partials of the datasets' other sheets are
read, and the tables of these datasets are made from both. No other line or dataset is read.
Lines and partials are moved once each, into the ranges they are written in, and grouped there; the SKU
roll-up is written once and read back for the other tables; shuffle files go when what was made from them is written.

Everything lies in numbered versions: ``partials/v=n``, ``tables/<name>/v=n`` and, written last,
``manifest/v=n`` with a row for each sheet of the datasets it is about. A version counts when its
manifest is complete, which the file system shows at once, so a reader sees all of a publish
or nothing; a dataset's newest manifest rows say where its partials and tables lie. What a reader has begun to
read stays until ``vacuum``. One writer at a time.

Lines are cleaned ones (``clean_lines``) with a column ``sheet``. Whether percentages are
fractions and which columns are absent is decided when lines are cleaned; a sheet that changes this
for its dataset has to be published together with the dataset's other sheets.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.operators import alerts, rollup
from tradeloom.operators.rollup import DS, FIRST, LAST, first_present, first_values
from tradeloom.sources.publish import CLUSTERED_BY
from tradeloom.staging import shuffles_freed, staged

SUMS = ["units", "revenue", "cost", "full_price_sales", "margin_value"]
PARTIALS = ("skus", "weeks", "channels")
TABLES = ("sku_rollup", "kpis", "best_sellers", "reorder_alerts", "markdown_risk", "category_scorecard", "weekly_trend", "channel_split")
MANIFEST = "dataset_id string, sheet string, partials bigint"
#: SKU rows are moved by these before they are grouped, and so lie as they are written.
CLUSTER = [DS, "sku"]
#: A dataset's SKU with this many lines or more, and a thousandth of all, is summed up in so many slices.
HOT_LINES, SLICES = 1_000_000, 64


def hot_skus(lines: DataFrame) -> list[int]:
    """Hashes of the hot SKUs with their datasets, found by a sketch of fixed size."""
    seen = lines.select(F.xxhash64(*CLUSTER).alias("key")).agg(F.count("*").alias("n"), F.expr("approx_top_k(key, 1000, 10000)").alias("top")).first()
    return [x["item"] for x in seen["top"] or [] if x["count"] >= max(HOT_LINES, seen["n"] / 1000)]


def partial_rollup(lines: DataFrame) -> DataFrame:
    """What ``merged_rollup`` needs to know of the lines of each sheet and SKU, clustered for writing.
    A hot SKU has a row for each of its slices."""
    margin = F.col("margin_pct").try_cast("decimal(38,12)")
    last = F.when(F.col("row_id").isNotNull(), F.struct("row_id", *LAST))
    known, keys = lines.where(F.col("sku").isNotNull()), CLUSTER
    if hot := hot_skus(known):
        part = F.when(F.xxhash64(*CLUSTER).isin(hot), F.pmod(F.xxhash64("row_id"), F.lit(SLICES))).otherwise(F.lit(0))
        known, keys = known.withColumn("_slice", part), [*CLUSTER, "_slice"]
    return known.repartitionByRange(*keys).groupBy(*keys, "sheet").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum(margin).alias("margin_sum"), F.count("margin_pct").alias("margin_n"),
        F.max(last).alias("last"), *first_values(), F.max("role_mask").alias("role_mask")).drop("_slice")


def merged_rollup(partials: DataFrame) -> DataFrame:
    """The SKU roll-up of all lines behind the partials, clustered for writing."""
    kinds = {c: partials.schema[c].dataType for c in SUMS}
    mean = F.round(F.try_divide(F.sum("margin_sum").cast("double"), F.sum("margin_n").cast("double")), 9)
    merged = partials.repartitionByRange(*CLUSTER).groupBy(*CLUSTER).agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS], mean.alias("margin_pct"), F.max("last").alias("last"),
        *[F.min(c).alias(c) for c in ("_first", *[f"_{c}" for c in FIRST])], F.max("role_mask").alias("role_mask"))
    return merged.select(DS, "sku", *SUMS, "margin_pct", *[f"last.{c}" for c in LAST], *[first_present(c) for c in FIRST], "role_mask")


def partial_sums(periods: DataFrame, label: str) -> DataFrame:
    kind = periods.schema["revenue"].dataType
    return periods.where(F.col(label).isNotNull()).groupBy(DS, "sheet", label).agg(F.sum("revenue").cast(kind).alias("revenue"))


def analysis_tables(roll: DataFrame, weeks: DataFrame, channels: DataFrame) -> dict[str, DataFrame]:
    """All other published tables from the stored SKU roll-up and the partials."""
    kpis, few = staged(rollup.dataset_kpis(roll), "merged-kpis"), staged(alerts.contenders(roll), "contenders")
    return {"kpis": kpis, "best_sellers": alerts.best_of(few), "reorder_alerts": alerts.reorder_of(alerts.reorder_candidates(few)),
            "markdown_risk": alerts.markdown_of(alerts.markdown_candidates(few)), "category_scorecard": rollup.category_scorecard(roll),
            "weekly_trend": rollup.weekly_trend(weeks), "channel_split": rollup.channel_split(channels, kpis)}


class AnalysisStore:
    """Published analyses in a folder, kept up to date sheet by sheet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- versions ----------------------------------------------------------------------

    def _listed(self, path: str) -> list:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [e.getPath() for e in store.listStatus(top)] if store.exists(top) else []

    def versions(self) -> list[int]:
        """Numbers of the versions whose manifest is complete."""
        found = [int(p.getName()[2:]) for p in self._listed(f"{self.folder}/manifest") if p.getName().startswith("v=")]
        return sorted(v for v in found if any(p.getName() == "_SUCCESS" for p in self._listed(f"{self.folder}/manifest/v={v}")))

    def manifest(self) -> DataFrame:
        """(dataset_id, sheet, partials, version): the sheets of every dataset and where its tables are.
        A dataset all of whose sheets are withdrawn has one row without a sheet."""
        every = self._manifests()
        newest = every.groupBy(DS).agg(F.max("version").alias("version"))
        return every.join(newest, [DS, "version"]).select(DS, "sheet", "partials", "version")

    def _manifests(self) -> DataFrame:
        paths = [f"{self.folder}/manifest/v={v}" for v in self.versions()]
        if not paths:
            return self.spark.createDataFrame([], f"{MANIFEST}, version bigint")
        return self._numbered(self.spark.read.schema(MANIFEST).parquet(*paths))

    @staticmethod
    def _numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "/v=([0-9]+)/", 1).cast("bigint"))

    # ---- reading -----------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """A published table, all datasets at one state of the store."""
        return self._read(name, *self._current())

    def _current(self) -> tuple[DataFrame, list[int]]:
        current = staged(self.manifest().where("sheet IS NOT NULL").select(DS, "version").distinct(), "current")
        versions = sorted(r["version"] for r in current.select("version").distinct().collect())
        if not versions:
            raise FileNotFoundError(f"nothing is published in {self.folder}")
        return current, versions

    def _read(self, name: str, current: DataFrame, versions: list[int]) -> DataFrame:
        rows = self._numbered(self.spark.read.parquet(*[f"{self.folder}/tables/{name}/v={v}" for v in versions]))
        return rows.join(current, [DS, "version"], "left_semi").drop("version")

    def tables(self) -> dict[str, DataFrame]:
        """All published tables, at one state of the store."""
        current = self._current()
        return {name: self._read(name, *current) for name in TABLES}

    # ---- writing -----------------------------------------------------------------------

    def publish(self, lines: DataFrame, withdrawn: DataFrame | None = None) -> int:
        """Add or replace the sheets of ``lines`` and take away those of ``withdrawn`` (dataset_id,
        sheet); returns the number of the version. A publish that fails leaves what was there."""
        version = max([int(p.getName()[2:]) for p in self._listed(f"{self.folder}/manifest")], default=-1) + 1
        with shuffles_freed(self.spark):
            periods = staged(lines.groupBy(DS, "sheet", "week", "channel").agg(F.sum("revenue").alias("revenue")), "given-periods")
            self._write(partial_rollup(lines).sortWithinPartitions(*CLUSTER), f"partials/skus/v={version}", [])
            self._write_all("partials", version, {"weeks": partial_sums(periods, "week"), "channels": partial_sums(periods, "channel")})
            given = staged(periods.select(DS, "sheet").distinct(), "given-sheets")
            gone = given if withdrawn is None else given.unionByName(withdrawn.select(DS, "sheet")).distinct()
            touched = gone.select(DS).distinct()
            stays = self.manifest().where("sheet IS NOT NULL").join(touched, DS, "left_semi").join(gone, [DS, "sheet"], "left_anti").select(DS, "sheet", "partials")
            sheets = staged(stays.unionByName(given.withColumn("partials", F.lit(version).cast("bigint"))), "sheets-now")
            skus, weeks, channels = [self._partials(name, sheets) for name in PARTIALS]
            merged, place = merged_rollup(skus), f"tables/sku_rollup/v={version}"
            self._write(merged.sortWithinPartitions(*CLUSTER), place, [])
            roll = self.spark.read.schema(merged.schema).parquet(f"{self.folder}/{place}")
            self._write_all("tables", version, analysis_tables(roll, weeks, channels))
            empty = touched.join(sheets, DS, "left_anti").select(DS, F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("bigint").alias("partials"))
            self._write(sheets.unionByName(empty), f"manifest/v={version}", [DS])
        return version

    def _write_all(self, kind: str, version: int, tables: dict[str, DataFrame]) -> None:
        """Several tables of a version at the same time; none is read before the manifest is written."""
        keys = {"skus": "sku", **CLUSTERED_BY}
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(lambda name: self._write(tables[name], f"{kind}/{name}/v={version}", [DS, *([keys[name]] if name in keys else [])]), tables))

    def _write(self, rows: DataFrame, place: str, keys: list[str]) -> None:
        """Write rows clustered by ``keys``; without keys as they lie."""
        laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
        laid.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{place}")

    def _partials(self, name: str, sheets: DataFrame) -> DataFrame:
        """The partials of the staged (dataset_id, sheet, partials). Files are clustered by dataset: the
        range the datasets lie in reaches the scan."""
        versions = [r[0] for r in sheets.select("partials").distinct().collect()]
        low, high = sheets.agg(F.min(DS), F.max(DS)).first()
        rows = self._numbered(self.spark.read.parquet(*[f"{self.folder}/partials/{name}/v={v}" for v in sorted(versions)])) if versions else None
        if rows is None:
            rows = self._numbered(self.spark.read.parquet(f"{self.folder}/partials/{name}")).where("false")
        else:
            rows = rows.where(F.col(DS).between(low, high))
        return rows.join(sheets.withColumnRenamed("partials", "version"), [DS, "sheet", "version"], "left_semi").drop("version")

    def compact(self) -> int:
        """Write all that is current as one version, so that reading doesn't grow with publishes."""
        every = staged(self.manifest(), "manifest-now")
        now = every.where("sheet IS NOT NULL")
        version = self.versions()[-1] + 1
        with shuffles_freed(self.spark):
            self._write_all("partials", version, {name: self._partials(name, now.select(DS, "sheet", "partials")) for name in PARTIALS})
            self._write_all("tables", version, self.tables())
        self._write(every.select(DS, "sheet", F.when(F.col("sheet").isNotNull(), F.lit(version)).cast("bigint").alias("partials")), f"manifest/v={version}", [DS])
        return version

    def vacuum(self) -> None:
        """Delete versions that nothing current refers to, and publishes that never ended."""
        now = self.manifest()
        used = {r[0] for r in now.select(F.explode(F.array_distinct(F.array("partials", "version")))).where("col IS NOT NULL").distinct().collect()}
        tables = {r[0] for r in now.select("version").distinct().collect()}
        for place, kept in [(f"partials/{n}", used) for n in PARTIALS] + [(f"tables/{n}", tables) for n in TABLES] + [("manifest", tables)]:
            for path in self._listed(f"{self.folder}/{place}"):
                if path.getName().startswith("v=") and int(path.getName()[2:]) not in kept:
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
