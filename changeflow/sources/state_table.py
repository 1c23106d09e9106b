"""A table of current rows as levelled runs of key buckets, with a manifest per micro-batch.

A batch writes one run: the last event of each key it changed, in the buckets of those keys. ``fan_in`` runs of a level are merged
into one of the next, which rewrites only the buckets that they hold; all other files stay as they are. Runs are bucketed alike, so
a read merges them bucket by bucket without a shuffle.

The manifest names the runs, the barriers of truncated tables and the outputs of other sinks of the same batch. It is
written last, under another name first: a reader sees all of a batch or nothing of it, and a batch that is repeated takes the place
of its first try. Only folders that a manifest names are ever read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..envelope import LAYOUT, Layout
from ..operators.expand import split_pk_update
from ..operators.materialize import latest_per_key, place_of, truncates
from ..operators.skew import join_small

BUCKETS = 64
FAN_IN = 4


class Run(NamedTuple):
    folder: str
    level: int
    buckets: int  # how many of the buckets hold rows
    rows: int


class Manifest(NamedTuple):
    batch: int
    runs: list[Run]
    barriers: str | None
    sinks: dict[str, list[str]]


class _Files:
    """Small files in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.folder = folder
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        found = self.system.globStatus(self._path("*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def read(self, number: int) -> dict:
        stream = self.system.open(self._path(f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, number: int, content: dict) -> None:
        """Under another name first, so that no reader meets half of it."""
        draft, final = self._path(f"_draft-{uuid4().hex}"), self._path(f"{number}.json")
        stream = self.system.create(draft, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not self.system.rename(draft, final):
            self.system.delete(final, False)
            if not self.system.rename(draft, final):
                raise OSError(f"could not write manifest {number}")


class StateTable:
    """``layout`` names the columns of the log; ``schema`` is that of a stored row: table, key, op, after image, position and place."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout = LAYOUT, buckets: int = BUCKETS, fan_in: int = FAN_IN):
        self.spark, self.path, self.layout, self.buckets, self.fan_in = spark, path.rstrip("/"), layout, buckets, fan_in
        self.kept = [layout.op, layout.after, layout.pos, layout.sub]
        self.files = _Files(spark, f"{self.path}/manifests")

    def manifest(self, upto: int | None = None) -> Manifest | None:
        """The newest manifest, or the newest one of a batch not above ``upto``."""
        numbers = [n for n in self.files.numbers() if upto is None or n <= upto]
        if not numbers:
            return None
        found = self.files.read(numbers[-1])
        return Manifest(found["batch"], [Run(*r) for r in found["runs"]], found["barriers"], found["sinks"])

    def _write(self, rows: DataFrame, level: int, batch_id: int) -> Run | None:
        """``rows`` as a bucketed run; they are by bucket already, or are brought there by the caller."""
        name = f"state_run_{uuid4().hex}"
        folder = f"{self.path}/runs/run={batch_id}-{level}-{uuid4().hex[:8]}"
        writer = rows.write.bucketBy(self.buckets, *self.layout.row_key).sortBy(*self.layout.row_key)
        writer.option("path", folder).mode("overwrite").saveAsTable(name)
        try:
            held = self.spark.read.schema(rows.schema).parquet(folder).agg(
                F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col("_metadata.file_name")).alias("files")).first()
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the name only, the folder stays
        return Run(folder, level, held["files"], held["rows"]) if held["rows"] else None

    def _read(self, runs: Sequence[Run], schema: str) -> DataFrame:
        """Rows of the runs in one scan, which has a task for each bucket. The name is needed for the planning alone.

        Runs are folders ``run=...`` below one, so that Spark takes them as partitions and leaves all others out. Their list is taken
        from the store and not from the catalog.
        """
        name, keys, setting = f"state_run_{uuid4().hex}", ", ".join(f"`{c}`" for c in self.layout.row_key), "spark.sql.hive.manageFilesourcePartitions"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            self.spark.sql(f"CREATE TABLE {name} ({schema}, `run` string) USING parquet PARTITIONED BY (`run`) "
                           f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'")
            table = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")
        finally:
            self.spark.conf.set(setting, before)
        return table.filter(F.col("run").isin([r.folder.rsplit("=", 1)[1] for r in runs])).drop("run")

    def _live(self, rows: DataFrame, barriers: str | None) -> DataFrame:
        """The last event of each key that no truncate came after."""
        last = latest_per_key(rows, self.layout, self.kept)
        if barriers is None:
            return last
        met = join_small(last, self.spark.read.parquet(barriers), [self.layout.table], "left")
        return met.filter(F.col("barrier").isNull() | (place_of(last, self.layout) > F.col("barrier"))).drop("barrier")

    def apply(self, batch: DataFrame, batch_id: int, sinks: Mapping[str, DataFrame] | None = None) -> None:
        """Applies a micro-batch of committed changes; ``sinks`` are other outputs that become visible with it."""
        before = self.manifest(batch_id - 1) or Manifest(batch_id - 1, [], None, {})
        layout, folder = self.layout, f"{self.path}/batch-{batch_id}-{uuid4().hex[:8]}"
        rows = split_pk_update(batch, layout)
        keyed = latest_per_key(rows.filter(F.col(layout.key).isNotNull() & (F.col(layout.op) != "t")), layout, self.kept)
        run = self._write(keyed.repartition(self.buckets, *layout.row_key), 0, batch_id)
        runs = before.runs + ([run] if run else [])
        cleared = truncates(rows, layout)
        cleared = cleared.groupBy(layout.table).agg(F.max(place_of(cleared, layout)).alias("barrier"))
        barriers = f"{folder}/barriers"
        if before.barriers:
            cleared = cleared.unionByName(self.spark.read.parquet(before.barriers)).groupBy(layout.table).agg(F.max("barrier").alias("barrier"))
        cleared.write.parquet(barriers)
        outputs = {name: list(folders) for name, folders in before.sinks.items()}
        for name, df in (sinks or {}).items():
            df.write.parquet(f"{folder}/sink-{name}")
            outputs.setdefault(name, []).append(f"{folder}/sink-{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
        runs = self._levelled(runs, schema, batch_id)
        self.files.put(batch_id, {"batch": batch_id, "runs": runs, "barriers": barriers, "sinks": outputs, "schema": schema})

    def _levelled(self, runs: list[Run], schema: str, batch_id: int) -> list[Run]:
        """Merges the runs of each level that has ``fan_in`` of them. Deletes stay, as an older event may still come."""
        level = 0
        while level <= max((r.level for r in runs), default=-1):
            same = [r for r in runs if r.level == level]
            if len(same) >= self.fan_in:
                one = self._write(latest_per_key(self._read(same, schema), self.layout, self.kept), level + 1, batch_id)
                runs = [r for r in runs if r.level != level] + ([one] if one else [])
            level += 1
        return runs

    def _schema(self, batch: int) -> str:
        return self.files.read(batch)["schema"]

    def read(self) -> DataFrame | None:
        """Current rows: table, key, after image and position. None before the first batch."""
        found = self.manifest()
        if found is None:
            return None
        schema = self._schema(found.batch)
        rows = self._read(found.runs, schema) if found.runs else self.spark.createDataFrame([], schema.replace("`", ""))
        layout = self.layout
        return self._live(rows, found.barriers).filter(F.col(layout.op) != "d").select(*layout.row_key, layout.after, layout.pos)

    def read_sink(self, name: str) -> DataFrame | None:
        """What committed batches have written to another sink."""
        found = self.manifest()
        folders = found.sinks.get(name, []) if found else []
        return self.spark.read.parquet(*folders) if folders else None
