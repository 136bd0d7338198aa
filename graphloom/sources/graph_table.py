"""A graph that grows batch by batch, with statistics that follow it."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.triples import triple_ends

KEYS = ("head", "relation", "tail")
_CHANGES = "relation string, triples bigint, scored bigint, confidence double, entities bigint, batch bigint"


# triples of one bucket, about, and buckets of a small table
BUCKET_ROWS = 200_000
FEW_BUCKETS = 16


def buckets_for(triples: int) -> int:
    """Buckets for a graph of so many triples: a task merges one, so it holds about as many triples at any size."""
    return max(FEW_BUCKETS, -(-triples // BUCKET_ROWS))


class GraphTable:
    """Triples and entity names in buckets of their keys, a partition for each batch.

    A batch is compared with the earlier graph where that lies: only the batch is
    shuffled, merged and then into the buckets of the table, and only triples that
    it adds or raises are written. Reading merges inside the buckets, without an exchange.
    What a batch changes is also kept as counts and sums per relation, so the
    statistics of the graph are sums over small tables.

    A batch sees the batches with smaller numbers and replaces its own partitions:
    running it again after a failure changes nothing. Numbers must ascend. Triples
    with a null end or relation are left out; a null confidence counts as unknown.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """``buckets`` holds for a new table; an existing one keeps its own."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = self._layout(buckets)
        name = "graph_" + hashlib.md5(self.path.encode()).hexdigest()
        self.triples, self.names = f"{name}_triples", f"{name}_names"
        self._attach(
            self.triples,
            "head string, relation string, tail string, confidence double, seq bigint, added int, scored int, gain double",
            ", ".join(KEYS),
            "triples",
        )
        self._attach(self.names, "name string", "name", "names")

    def _layout(self, buckets: int) -> int:
        where = f"{self.path}/layout"
        try:
            return self.spark.read.schema("buckets int").parquet(where).first().buckets
        except AnalysisException:
            self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(where)
            return buckets

    def _attach(self, table: str, columns: str, keys: str, folder: str) -> None:
        if self.spark.catalog.tableExists(table):
            return
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}, batch bigint) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        # partitions that an earlier application wrote
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def _rows(self, table: str, before: int | None) -> DataFrame:
        self.spark.catalog.refreshTable(table)
        rows = self.spark.table(table)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def graph(self, before: int | None = None) -> DataFrame:
        """One row per triple: highest confidence, first position; of the batches below ``before``, if given."""
        rows = self._rows(self.triples, before)
        return rows.groupBy(*KEYS).agg(F.max("confidence").alias("confidence"), F.min("seq").alias("seq"))

    def changes(self, triples: DataFrame, batch: int) -> DataFrame:
        """The triples that the batch adds or raises, with what each adds to the counts and sums."""
        fresh = (
            triples.dropna(subset=list(KEYS))
            .groupBy(*KEYS)
            .agg(F.max("confidence").alias("confidence"), F.min("seq").cast("bigint").alias("seq"))
        )
        earlier = self.graph(batch).select(
            *KEYS, F.col("confidence").alias("_confidence"), F.col("seq").alias("_seq"), F.lit(True).alias("_known")
        )
        had = F.col("_confidence").isNotNull()
        best, first = F.greatest("confidence", "_confidence"), F.least("seq", "_seq")
        # merged rows go to the buckets; with another number of partitions the join would move the table instead
        joined = fresh.repartition(self.buckets, *KEYS).join(earlier, list(KEYS), "left")
        news = F.col("_known").isNull() | ~best.eqNullSafe(F.col("_confidence")) | ~first.eqNullSafe(F.col("_seq"))
        return joined.filter(news).select(
            *KEYS,
            best.alias("confidence"),
            first.alias("seq"),
            F.col("_known").isNull().cast("int").alias("added"),
            (best.isNotNull() & ~had).cast("int").alias("scored"),
            (F.coalesce(best, F.lit(0.0)) - F.coalesce("_confidence", F.lit(0.0))).alias("gain"),
        )

    def merge(self, triples: DataFrame, batch: int) -> None:
        """Add a batch of (head, relation, tail, confidence, seq)."""
        self._replace(self.triples, self.changes(triples, batch), KEYS, batch)
        written = self._rows(self.triples, None).filter(F.col("batch") == batch)

        found = triple_ends(written.filter("added = 1"), ())
        self._replace(self.names, found.join(self._rows(self.names, batch), "name", "left_anti"), ("name",), batch)
        names = self._rows(self.names, None).filter(F.col("batch") == batch)

        sums = written.groupBy("relation").agg(
            F.sum("added").alias("triples"), F.sum("scored").alias("scored"), F.sum("gain").alias("confidence")
        )
        counts = sums.withColumn("entities", F.lit(0).cast("bigint")).unionByName(
            names.agg(F.count("*").alias("entities")), allowMissingColumns=True
        )
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    def _replace(self, table: str, rows: DataFrame, keys: tuple[str, ...], batch: int) -> None:
        # a table cannot be overwritten while it is read; the next batch takes the same place
        step = f"{self.path}/step/{table}"
        rows.write.mode("overwrite").parquet(step)
        # the buckets of the table: a file for each of them
        placed = self.spark.read.schema(rows.schema).parquet(step).repartition(self.buckets, *keys)
        self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {int(batch)}) SELECT * FROM {{rows}}", rows=placed)

    def _sums(self) -> DataFrame:
        try:
            return self.spark.read.schema(_CHANGES).parquet(f"{self.path}/changes")
        except AnalysisException:
            # no batch yet
            return self.spark.createDataFrame([], _CHANGES)

    def relation_statistics(self) -> DataFrame:
        """Triples and mean confidence of every relation of the merged graph."""
        known = self._sums().filter(F.col("relation").isNotNull())
        return known.groupBy("relation").agg(
            F.sum("triples").alias("n"), F.try_divide(F.sum("confidence"), F.sum("scored")).alias("avg_confidence")
        )

    def statistics(self) -> DataFrame:
        """One row as of ``graph_statistics``, for the merged graph; from the sums alone."""
        return self._sums().agg(
            F.coalesce(F.sum("entities"), F.lit(0)).alias("total_entities"),
            F.count_distinct("relation").alias("total_relations"),
            F.coalesce(F.sum("triples"), F.lit(0)).alias("total_triples"),
            F.coalesce(F.try_divide(F.sum("confidence"), F.sum("scored")), F.lit(0.0)).alias("average_confidence"),
        )

    def compact(self, target: str) -> GraphTable:
        """The merged graph as a single batch of a new table."""
        new = GraphTable(self.spark, target, self.buckets)
        new.merge(self.graph(), 0)
        return new
