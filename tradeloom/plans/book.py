"""The analysis of all datasets as one set of tables, built once per job.

The SKU rows feed five tables and those feed every later screen, so each is staged the
first time it is used (see ``tradeloom.staging``). A table nobody asks for is never built, and the SKU
rows hold only the columns that the tables asked for read. KPIs asked for alone are summed up from
the SKU rows as they come, which are then not stored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.operators import alerts, compare, governance, role_view, rollup, timeline
from tradeloom.sources import testtables
from tradeloom.staging import staged


STORED = ("kpis", "best_sellers", "reorder_alerts", "markdown_risk", "categories")
#: Tables that keep the first rows of each dataset; they are cut from the same few SKU rows.
LISTS = ("best_sellers", "reorder_alerts", "markdown_risk")
#: Sums and first values that a table reads from the SKU rows; ``rollup`` has them all.
FIGURES = ("units", "revenue", "margin_value")
READS = {"kpis": FIGURES, "categories": (*FIGURES, "category"), **dict.fromkeys([*LISTS, "contenders"], (*FIGURES, "category", "name")),
         "rollup": (*rollup.SUMS, *rollup.FIRST)}


class AnalysisBook:
    def __init__(self, lines: DataFrame, catalogue=None, pairing=None):
        """``catalogue`` makes the dataset table from rows with dataset_id and role_mask,
        ``pairing`` the comparisons from the dataset table."""
        self.lines, self._catalogue, self._pairing = lines, catalogue, pairing
        self._groups: DataFrame | None = None
        self._figures: DataFrame | None = None

    @classmethod
    def of_test_tables(cls, spark: SparkSession, sf_dir: str) -> "AnalysisBook":
        return cls(testtables.trading_lines(spark, sf_dir), testtables.datasets, testtables.pairs)

    def prepare(self, *names: str) -> "AnalysisBook":
        """Stage several tables at the same time; their jobs do not depend on each other."""
        stored = [name for name in names if name in READS]
        if stored != ["kpis"] and stored:
            self.skus(*[c for name in stored for c in READS[name]])
        lists = [name for name in names if name in LISTS]
        with ThreadPoolExecutor(len(names) + 1) as pool:
            for wave in ([*["contenders"][:len(lists)], *[name for name in names if name not in lists]], lists):
                list(pool.map(lambda name: getattr(self, name), wave))
        return self

    def skus(self, *columns: str) -> DataFrame:
        """SKU rows with at least these sums and first values; built anew only if the staged ones lack some."""
        if self._groups is None or not set(columns) <= set(self._groups.columns):
            kept = {*columns, *(self._groups.columns if self._groups else ())}
            groups = rollup.sku_groups(self.lines, *[[c for c in some if c in kept] for some in (rollup.SUMS, rollup.FIRST)])
            self._groups = staged(groups, "sku_groups")
        return self._groups.where(F.col("sku").isNotNull())

    @cached_property
    def datasets(self) -> DataFrame:
        known = [rows for rows in (self._groups, self._figures) if rows is not None]
        return staged(self._catalogue(known[0] if known else self.lines), "datasets")

    def private_datasets(self, companies: DataFrame) -> DataFrame:
        return staged(governance.private_datasets(self.datasets, companies), "private")

    @cached_property
    def pairs(self) -> DataFrame:
        return staged(self._pairing(self.datasets), "pairs")

    @cached_property
    def rollup(self) -> DataFrame:
        return self.skus(*READS["rollup"])

    @cached_property
    def kpis(self) -> DataFrame:
        if self._groups is not None:
            return staged(rollup.dataset_kpis(self.skus(*READS["kpis"])), "kpis")
        # Lines without a SKU stay apart: they count for no KPI, but make their dataset known.
        groups = rollup.sku_groups(self.lines, READS["kpis"], ()).withColumn("has_sku", F.col("sku").isNotNull())
        self._figures = staged(rollup.dataset_kpis(groups, "has_sku"), "kpis")
        return self._figures.where("has_sku").drop("has_sku")

    @cached_property
    def contenders(self) -> DataFrame:
        return staged(alerts.contenders(self.skus(*READS["contenders"])), "contenders")

    @cached_property
    def best_sellers(self) -> DataFrame:
        return staged(alerts.best_of(self.contenders), "best_sellers")

    @cached_property
    def reorder_alerts(self) -> DataFrame:
        return staged(alerts.reorder_of(alerts.reorder_candidates(self.contenders)), "reorder_alerts")

    @cached_property
    def markdown_risk(self) -> DataFrame:
        return staged(alerts.markdown_of(alerts.markdown_candidates(self.contenders)), "markdown_risk")

    @cached_property
    def categories(self) -> DataFrame:
        return staged(rollup.category_scorecard(self.skus(*READS["categories"])), "category_scorecard")

    @cached_property
    def periods(self) -> DataFrame:
        """Revenue per week and channel, so that both tables take one pass over the lines."""
        return staged(self.lines.groupBy("dataset_id", "week", "channel").agg(F.sum("revenue").alias("revenue")), "periods")

    @cached_property
    def weekly(self) -> DataFrame:
        """From ``periods`` where these are there; alone it needs no channel, which comes by one more join."""
        return staged(rollup.weekly_trend(self.__dict__.get("periods", self.lines)), "weekly_trend")

    @cached_property
    def channels(self) -> DataFrame:
        return rollup.channel_split(self.periods, self.kpis)

    @cached_property
    def heads(self) -> DataFrame:
        self.prepare(*STORED)
        return role_view.heads(self.kpis, self.best_sellers, self.reorder_alerts, self.markdown_risk, self.categories)

    @cached_property
    def role_actions(self) -> DataFrame:
        return role_view.role_actions(self.heads)

    @cached_property
    def sku_index(self) -> DataFrame:
        self.prepare("best_sellers", "markdown_risk", "reorder_alerts")
        return staged(compare.sku_index(self.best_sellers, self.markdown_risk, self.reorder_alerts), "sku_index")

    @cached_property
    def timeline(self) -> DataFrame:
        return timeline.timeline(self.datasets, self.kpis)

    def tables(self) -> dict[str, DataFrame]:
        self.prepare("rollup", "periods")
        return {"sku_rollup": self.rollup, "kpis": self.kpis, "best_sellers": self.best_sellers,
                "reorder_alerts": self.reorder_alerts, "markdown_risk": self.markdown_risk,
                "category_scorecard": self.categories, "weekly_trend": self.weekly, "channel_split": self.channels}
