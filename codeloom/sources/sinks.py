"""Sinks (S11-S17, S20): keyed upserts, appends, partition overwrite, cascades and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.runtime import top


def upsert(target: DataFrame, batch: DataFrame, key: list[str], seq: str, keep_id: str | None = None) -> DataFrame:
    """The target after an insert-or-update; the last row of a key within the batch wins.

    Rows with a null in the key never collide and are all kept. With keep_id, an updated row
    keeps the target's value of that column.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    last = Window.partitionBy(*key).orderBy(F.desc(seq))
    keyed = batch.filter(whole).withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    if keep_id:
        old = target.filter(whole).select(*key, F.col(keep_id).alias("_old"))
        keyed = keyed.join(old, key, "left").withColumn(keep_id, F.coalesce("_old", keep_id)).drop("_old")
    columns = target.columns
    untouched = target.join(keyed.select(*key), key, "left_anti").select(*columns)
    return untouched.unionByName(keyed.select(*columns)).unionByName(batch.filter(~whole).select(*columns))


class VersionedTable:
    """A table as numbered versions in a folder that all executors share. A version counts once Spark has marked it as written whole.

    The newest `keep` versions stay, so that readers of the one before aren't cut off.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs, self._root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), root

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        numbers = [int(name[2:]) for f in self._fs.listStatus(self._root) if (name := f.getPath().getName()).startswith("v=")]
        return sorted(n for n in numbers if self.has(n))

    def has(self, number: int) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._root, f"v={number}/_SUCCESS"))

    def load(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest below a number; None if there is none."""
        found = [n for n in self.versions() if before is None or n < before]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def save(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._root, f"v={old}"), True)


def insert_absent(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The rows to append: one for each key that the target lacks."""
    return batch.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(*batch.columns)


def overwrite_workspaces(rows: DataFrame, path: str, partition: str = "workspace_id") -> None:
    """Replaces the workspaces present in rows and leaves others; rebuilding twice gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def cascade_delete(tables: dict[str, DataFrame], keys: dict[str, str], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows whose key is among the deleted ids (column id)."""
    return {name: df.join(deleted.select(F.col("id").alias(keys[name])), keys[name], "left_anti").select(*df.columns) for name, df in tables.items()}


def merge_stats(left: Column, right: Column) -> Column:
    """A shallow merge of two maps; the right side wins."""
    mine = F.map_filter(left, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(right), k), F.lit(False)))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(mine, right))


def merge_stats_json(left: Column, right: Column) -> Column:
    """S15 on JSON texts: nested values and types of the winning side stay whole; a text that is no object counts as none."""
    fields = lambda x: F.try_variant_get(F.try_parse_json(x), "$", "map<string,variant>")
    return F.to_json(merge_stats(fields(left), fields(right)))


def append(rows: DataFrame, path: str) -> None:
    """S16."""
    rows.write.mode("append").parquet(path)


def cost_rows(rows: DataFrame) -> DataFrame:
    """The cost rows worth appending; negative counts become 0, rows without tokens go."""
    clean = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    counts = ("input_tokens", "output_tokens")
    return rows.select(*[clean(c) if c in counts else F.col(c) for c in rows.columns]).filter("input_tokens > 0 or output_tokens > 0")


def _xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def site_entries(workspaces: DataFrame, users: DataFrame, base: str, limit: int | None = 1000) -> DataFrame:
    """(id, loc, lastmod, sitemap, rss) of public, ready workspaces, newest first."""
    owner = users.select(F.col("id").alias("owner_user_id"), "login")
    rows = workspaces.filter("is_public and status = 'ready'").join(owner, "owner_user_id", "left")
    rows = top(rows, limit, F.col("last_indexed_at").desc_nulls_last(), "id")
    loc = F.concat(F.lit(base.rstrip("/") + "/"), "id")
    day = F.date_format("last_indexed_at", "yyyy-MM-dd")
    title = F.concat_ws(" / ", "login", "name")
    return rows.select(
        "id", loc.alias("loc"), day.alias("lastmod"),
        F.concat(F.lit("<url><loc>"), _xml(loc), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit("</url>")).alias("sitemap"),
        F.concat(F.lit("<item><title>"), _xml(title), F.lit("</title><link>"), _xml(loc), F.lit("</link></item>")).alias("rss"),
    )
