"""The article store: articles with their sources and comparisons.

Three tables of Parquet files, partitioned by ``run_id``, and a ledger of commits. A run
writes its articles and both child tables first and its ledger row last; readers join on
the ledger, so a run that was cut off shows nothing, and its rerun overwrites only its own
partitions. One item has one article: items that have one are left out by an anti-join, a
second draft for one item is an error, and a committed run is never written again.

Drafts are written once, dealt and sorted by item, and a row's article id is its place there, so no
row moves again. Articles are sorted by id in each file, with Bloom filters on ``item_id``, so a
point read by either key touches a few row groups. The run's counters are taken by ``Observation``
in the same pass as the write and stored with the commit; the drafts are removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from curata.session import passing, stored
from curata.sources.tables import path_exists

ARTICLES = ("article_id bigint, item_id bigint, title string, url string, source_id string, what_changed string, "
            "why_it_matters string, comparison string, body string, scope_tags array<string>, engine string, "
            "model string, quality_status string, quality_issues array<string>, word_count int, fallback boolean, "
            "created_at timestamp, run_id bigint")
SOURCES = "article_id bigint, position int, url string, title string, source_id string, is_primary boolean, run_id bigint"
COMPARISONS = ("article_id bigint, position int, related_item_id bigint, related_title string, related_url string, "
               "similarity double, note string, run_id bigint")
COMMITS = "run_id bigint, stats map<string,bigint>"
_ROW_GROUP = 8 << 20
_PLACE_BITS = 33                # of monotonically_increasing_id: the row's place in its partition


def generation_counters() -> list:
    """A8, over drafts: taken while they are written."""
    return [F.count(F.lit(1)).alias("generated"),
            F.count_if(F.col("quality_status") == "pass").alias("passed"),
            F.count_if(F.col("quality_status") == "flagged").alias("flagged"),
            F.count_if(F.col("quality_status") == "fail").alias("failed_quality"),
            F.count_if(F.col("fallback")).alias("llm_fallbacks")]


def _numbered(written: DataFrame, start: int) -> DataFrame:
    """``article_id``, dense from ``start`` in the order in which the rows were written (``_at``: the
    number of the part and the place in it). A draft without an item is numbered, but left out."""
    part, place = F.shiftright("_at", _PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # a row per part
    return (written.where(F.col("item_id").isNotNull()).withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn("article_id", F.col("_off") + place + F.lit(start)).drop("_at", "_part", "_off"))


class ArticleStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _stored(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def commits(self) -> DataFrame:
        """The ledger: one row per committed run."""
        return self._stored("commits", COMMITS)

    def _committed(self, name: str, schema: str) -> DataFrame:
        # one ledger row per run, so the broadcast is bounded by the number of runs
        return self._stored(name, schema).join(F.broadcast(self.commits().select("run_id")), "run_id", "left_semi")

    def articles(self) -> DataFrame:
        return self._committed("articles", ARTICLES)

    def sources(self) -> DataFrame:
        return self._committed("article_sources", SOURCES)

    def comparisons(self) -> DataFrame:
        return self._committed("article_comparisons", COMPARISONS)

    def with_children(self, articles: DataFrame | None = None) -> DataFrame:
        """Articles with ``sources`` (primary first) and ``comparisons`` (similarity
        descending) nested; both keep their written position otherwise."""
        rows = self.articles() if articles is None else articles
        nested = {
            "sources": (self.sources(), F.struct((~F.col("is_primary")).alias("k"), "position"),
                        F.struct("url", "title", "source_id", "is_primary")),
            "comparisons": (self.comparisons(), F.struct((-F.col("similarity")).alias("k"), "position"),
                            F.struct("related_item_id", "related_title", "related_url", "similarity", "note"))}
        for name, (children, order, value) in nested.items():
            listed = children.join(rows.select("article_id"), "article_id", "left_semi").groupBy("article_id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v")))),
                            lambda x: x["v"]).alias(name))
            rows = rows.join(listed, "article_id", "left").withColumn(
                name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
        return rows

    def article(self, article_id: int) -> DataFrame:
        """C14: one article with its children; the id reaches all three scans."""
        one = F.col("article_id") == F.lit(article_id).cast("bigint")
        return self.with_children(self.articles().where(one))

    def recent(self, n: int) -> DataFrame:
        """The newest ``n`` articles by id."""
        return self.articles().orderBy(F.desc("article_id")).limit(n)

    def has_article(self, items: DataFrame) -> DataFrame:
        """``items`` with ``has_article``."""
        known = self.articles().select("item_id", F.lit(True).alias("has_article"))
        return items.join(known, "item_id", "left").withColumn(
            "has_article", F.coalesce("has_article", F.lit(False)))

    def is_committed(self, run_id: int) -> bool:
        return self.commits().where(F.col("run_id") == run_id).limit(1).count() > 0

    def append(self, drafts: DataFrame, run_id: int, created_at, stats: dict[str, int] | None = None) -> dict[str, int]:
        """Write the drafts of a run whose items have no article yet; the counters of what was
        written, with ``stats`` added, become the run's ledger row and are returned."""
        nothing = {"generated": 0, "passed": 0, "flagged": 0, "failed_quality": 0, "llm_fallbacks": 0}
        if self.is_committed(run_id):
            return nothing | (stats or {})
        kept = [f.split()[0] for f in ARTICLES.split(", ") if f.split()[0] in drafts.columns]
        # the texts that a draft was made from stay behind
        drafts = drafts.select(*(c for c in kept if c not in ("article_id", "run_id", "created_at")), "sources", "comparisons")
        with passing(self.spark):
            counted = nothing | self._write_run(drafts, run_id, created_at) | (stats or {})
        self.spark.createDataFrame([(run_id, counted)], COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.root}/commits")
        return counted

    def _write_run(self, drafts: DataFrame, run_id: int, created_at) -> dict[str, int]:
        """The three tables of a run, and its counters."""
        # in the order of the ids; a range exchange reads its input once more to sample it
        new = stored(drafts.join(self.articles().select("item_id"), "item_id", "left_anti").repartitionByRange("item_id")
                     .sortWithinPartitions("item_id").withColumn("_at", F.monotonically_increasing_id()), "drafts")
        twice = new.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"item {twice[0].item_id} has more than one draft")
        last = self.articles().agg(F.max("article_id")).first()[0] or 0
        rows = _numbered(new, last + 1).withColumns(
            {"run_id": F.lit(run_id).cast("bigint"), "created_at": F.lit(created_at).cast("timestamp")})
        seen = Observation()
        self._write(rows, "articles", ARTICLES, lambda out: out
                    .sortWithinPartitions("article_id").observe(seen, *generation_counters()))
        for name, schema, column in (("article_sources", SOURCES, "sources"),
                                     ("article_comparisons", COMPARISONS, "comparisons")):
            children = rows.select("article_id", "run_id", F.posexplode(column).alias("position", "child")).select(
                "article_id", "run_id", "position", "child.*")
            self._write(children, name, schema)
        return {k: int(v) for k, v in seen.get.items()}

    def _write(self, rows: DataFrame, name: str, schema: str, arrange=lambda out: out) -> None:
        fields = self.spark.createDataFrame([], schema).schema.fields
        out = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
        (arrange(out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
         .option("compression", "zstd").option("parquet.block.size", _ROW_GROUP).option("parquet.bloom.filter.enabled#item_id", "true")
         .parquet(f"{self.root}/{name}"))
