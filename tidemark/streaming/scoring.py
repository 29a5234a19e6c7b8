"""Window scores on streams, micro-batch by micro-batch, with no task that holds a series.

A keyed stateful operator gives every row of a key to one task, so a series with a
third of the stream would be scanned in one place. Here every micro-batch is a table:

1. Its rows are numbered along the series, where a series with a large share of them is cut
   into ordered chunks (``operators.ordering``), so neither the order of files nor one hot series matters.
2. Points are gathered by (series, block of positions) with the ``length - 1`` points before the
   block. The points before the batch's first one come from the series' tail.
3. Every new point has its window cut from its block; models and alerts follow, spread
   over all tasks.
4. The state left for the next batch is one row per touched series: how many points it has had
   and its last ``length - 1`` points.

State and output of a batch lie in folders named by its number and are written whole, so a
batch that is run again after a failure replaces what it left: results appear exactly
once. Every ``COMPACT`` batches the state is written for all series; in between only
for those touched, and a batch reads one full state and fewer than ``COMPACT`` parts.

Rows of a micro-batch are put in order; micro-batches follow each other as they arrive. Limit
a batch at the source (``maxFilesPerTrigger``). Keys are not null, (series, order) is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.arrays import let
from tidemark.operators.models import Model, score_windows
from tidemark.operators.ordering import LIGHT, fill_nearest, running_totals, series_chunk, series_sizes

COMPACT = 10


@dataclass
class WindowStream:
    """The state of a stream of points, and the windows of each micro-batch.

    ``folder`` is shared storage for the state, the output and the checkpoint. ``warm_start``
    begins every series with zeros, so its first point already has a full window. A row whose
    boolean ``control`` column is true resets its series and is no point. A series that no batch
    touched for ``silence_ms`` starts over.
    """

    folder: str
    length: int
    cols: Sequence[str] = ("x",)
    key: str = "series_id"
    order: Sequence[str] = ("ts",)
    warm_start: bool = False
    control: str | None = None
    silence_ms: int | None = None
    rows: int | None = None

    # -- the steps of one batch -----------------------------------------------------------------------

    def sizes(self, batch: DataFrame) -> DataFrame:
        """series_id, ``_rows``: the batch's rows of each series."""
        return series_sizes(batch.select(F.col(self.key).alias("series_id")).dropna(), ["series_id"])

    def numbered(self, batch: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
        """series_id, run (resets before the row), pos (points before it in its run; null for a reset), ts, columns."""
        reset = F.coalesce(F.col(self.control), F.lit(False)) if self.control else F.lit(False)
        picked = batch.select(
            F.col(self.key).alias("series_id"), *self.order, *[F.col(c).cast("double").alias(c) for c in self.cols], reset.alias("_reset")
        )
        cut = series_chunk(picked, ["series_id"], list(self.order), self.sizes(batch) if sizes is None else sizes)
        sums = {"_n": (~F.col("_reset")).cast("long"), "run": F.col("_reset").cast("long")}
        counted = running_totals(cut, ["series_id"], list(self.order), sums, light=LIGHT)
        if self.control:
            # the points before a reset are carried on from it, chunk by chunk
            counted = fill_nearest(counted.withColumn("_base", F.when(F.col("_reset"), F.col("_n"))), ["series_id"], list(self.order), ["_base"])
            base = F.when(F.col("run") > 0, F.col("_base")).otherwise(F.lit(0))
        else:
            base = F.lit(0)
        pos = F.when(~F.col("_reset"), F.col("_n") - base - 1)
        return counted.select("series_id", "run", pos.cast("long").alias("pos"), F.col(self.order[0]).alias("ts"), *self.cols)

    def blocks(self, batch: DataFrame, state: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
        """series_id, run, block, next (points before the run's first one here), points (ordered, with those before the block)."""
        rows = self.rows or max(512, 4 * self.length)
        sizes = self.sizes(batch) if sizes is None else sizes
        numbered = self.numbered(batch, sizes)
        if self.control:
            seen = numbered.select("series_id", "run", F.floor(F.coalesce("pos", F.lit(0)) / rows).cast("long").alias("block")).distinct()
        else:  # every row is a point of run 0, so the number of rows tells the blocks
            to = F.floor((F.col("_rows") - 1) / rows).cast("long")
            seen = sizes.select("series_id", F.lit(0).cast("long").alias("run"), F.explode(F.sequence(F.lit(0).cast("long"), to)).alias("block"))
        opened = seen.join(state.select("series_id", "next", "tail"), "series_id", "left")
        goes_on = F.col("run") == 0
        marks = opened.select("series_id", "run", "block", F.when(goes_on, F.coalesce("next", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("next"))

        first, last = F.floor(F.col("pos") / rows), F.floor((F.col("pos") + self.length - 1) / rows)
        point = F.struct("pos", "ts", *self.cols).alias("point")
        spread = numbered.where("pos IS NOT NULL").select("series_id", "run", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"), point)
        tail_rows = opened.where(goes_on & (F.col("block") == 0)).select("series_id", "run", F.posexplode("tail").alias("_i", "p"), F.size("tail").alias("_k"))
        before = tail_rows.select(
            "series_id", "run", (F.col("_i") - F.col("_k")).cast("long").alias("pos"),
            F.lit(None).cast(numbered.schema["ts"].dataType).alias("ts"), *[F.col("p")[c].alias(c) for c in self.cols],
        )
        # points before the batch reach as many blocks as points of the batch do
        reach = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"))).alias("block")
        before = before.select("series_id", "run", reach, point)
        gathered = (
            spread.withColumn("next", F.lit(None).cast("long"))
            .unionByName(before.withColumn("next", F.lit(None).cast("long")))
            .unionByName(marks.withColumn("point", F.lit(None).cast(spread.schema["point"].dataType)))
            .groupBy("series_id", "run", "block")
            .agg(F.max("next").alias("next"), F.sort_array(F.collect_list("point")).alias("points"))
        )
        # a block without a mark holds only points of the block before
        own = F.size(F.filter("points", lambda p: p["pos"] >= F.col("block") * rows))
        return gathered.where("next IS NOT NULL").withColumn("own", own)

    def windows(self, blocks: DataFrame, partitions: int | None = None) -> DataFrame:
        """One row per new point: run, idx, ts, buffer status (filled, real, required, ready) and its window, one array per column."""
        dealt = blocks.where("own > 0").repartition(partitions) if partitions else blocks.where("own > 0")
        # each column is taken out of the points once a block, below the explode, and windows are cut out of it
        arrays = [F.col(f"points.{c}").alias(f"_{i}") for i, c in enumerate(("pos", "ts", *self.cols))]
        at = F.explode(F.sequence(F.size("_0") - F.col("own") + 1, F.size("_0"))).alias("_at")
        spread = dealt.select("series_id", "run", "next", "own", *arrays).select("*", at)
        idx = F.col("next") + F.element_at("_0", F.col("_at"))
        real = F.least(idx + 1, F.lit(self.length)).cast("int")
        ts = F.element_at("_1", F.col("_at"))

        def column(i: int) -> Column:
            values = F.slice(f"_{i}", F.col("_at") - real + 1, real)
            return F.concat(F.array_repeat(F.lit(0.0), self.length - real), values) if self.warm_start else values

        filled = F.lit(self.length) if self.warm_start else real
        return spread.select(
            "series_id", "run", idx.alias("idx"), ts.alias("ts"), real.alias("real"), filled.alias("filled"), F.lit(self.length).alias("required"),
            (idx + 1 >= self.length).alias("ready"), *[column(i).alias(c) for i, c in enumerate(self.cols, 2)],
        )

    def tails(self, blocks: DataFrame, batch_id: int) -> DataFrame:
        """The new state of every series of the batch."""
        kept = self.length - 1
        tail = let(F.col("points"), lambda p: F.slice(p, F.greatest(F.size(p) - kept + 1, F.lit(1)), F.lit(kept))) if kept else F.slice("points", 1, 0)
        slim = F.transform(tail, lambda p: F.struct(*[p[c].alias(c) for c in self.cols]))
        reached = F.col("next") + F.when(F.col("own") > 0, F.element_at("points", -1)["pos"] + 1).otherwise(F.lit(0))
        state = F.struct(reached.cast("long").alias("next"), slim.alias("tail"))
        ends = blocks.select("series_id", "run", "block", state.alias("s"))  # before the aggregation, which sorts its rows
        last = ends.groupBy("series_id").agg(F.max_by("s", F.struct("run", "block")).alias("s"))
        return last.select("series_id", F.col("s.next").alias("next"), F.col("s.tail").alias("tail"), F.unix_millis(F.current_timestamp()).alias("at"), F.lit(batch_id).cast("long").alias("batch"))

    # -- state across batches -------------------------------------------------------------------------

    def _parts(self, batch_id: int) -> list[str]:
        """Folders with the state before a batch: the last full one and the parts after it."""
        full = batch_id // COMPACT * COMPACT - 1
        parts = [f"{self.folder}/state/{i}" for i in range(full + 1, batch_id)]
        return ([f"{self.folder}/state/full-{full}"] if full >= 0 else []) + parts

    def _schema(self, key_type: T.DataType) -> T.StructType:
        point = T.StructType([T.StructField(c, T.DoubleType()) for c in self.cols])
        return T.StructType(
            [T.StructField("series_id", key_type), T.StructField("next", T.LongType()), T.StructField("tail", T.ArrayType(point)), T.StructField("at", T.LongType()), T.StructField("batch", T.LongType())]
        )

    def state_before(self, spark: SparkSession, batch_id: int, key_type: T.DataType, touched: DataFrame | None = None) -> DataFrame:
        """One row per series: next, tail, at, batch; of the ``touched`` series only, where these are given."""
        schema, parts = self._schema(key_type), self._parts(batch_id)
        if not parts:
            return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        found = spark.read.schema(schema).parquet(*parts)
        if touched is not None:
            found = found.join(touched, "series_id", "left_semi")
        latest = found.groupBy("series_id").agg(F.max_by(F.struct("next", "tail", "at", "batch"), "batch").alias("s")).select("series_id", "s.*")
        if self.silence_ms is not None:
            latest = latest.where(F.col("at") >= F.unix_millis(F.current_timestamp()) - self.silence_ms)
        return latest

    def run_batch(self, batch: DataFrame, batch_id: int, emit: Callable[[DataFrame], DataFrame]) -> None:
        spark = batch.sparkSession
        key_type = batch.schema[self.key].dataType
        sizes = self.sizes(batch).persist()
        try:
            if sizes.isEmpty():
                self._save(spark.createDataFrame([], self._schema(key_type)), spark, batch_id, key_type)
                return
            blocks = self.blocks(batch, self.state_before(spark, batch_id, key_type, sizes.select("series_id")), sizes).persist()
            try:
                emit(self.windows(blocks)).write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
                self._save(self.tails(blocks, batch_id), spark, batch_id, key_type)
            finally:
                blocks.unpersist()
        finally:
            sizes.unpersist()

    def _save(self, new: DataFrame, spark: SparkSession, batch_id: int, key_type: T.DataType) -> None:
        new.write.mode("overwrite").parquet(f"{self.folder}/state/{batch_id}")
        if (batch_id + 1) % COMPACT == 0:
            written = spark.read.schema(self._schema(key_type)).parquet(f"{self.folder}/state/{batch_id}")
            old = self.state_before(spark, batch_id, key_type).join(written, "series_id", "left_anti")
            old.unionByName(written).write.mode("overwrite").parquet(f"{self.folder}/state/full-{batch_id}")

    # -- the stream ---------------------------------------------------------------------------------

    def writer(self, stream: DataFrame, emit: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
        """A stream writer that gives every batch's windows to ``emit`` and keeps what it returns; set a trigger and start it."""
        return stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda batch, i: self.run_batch(batch, i, emit))

    def read(self, spark: SparkSession) -> DataFrame:
        """All output of finished batches, with the number of the ``batch``."""
        return spark.read.option("basePath", f"{self.folder}/out").parquet(f"{self.folder}/out")


def full_windows(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("filled") == F.col("required"))


def scores(windows: DataFrame, load: Callable[[], Model], cols: Sequence[str] = ("x",), task: str = "score", length: int | None = None) -> DataFrame:
    """One model output per point whose window is full."""
    return score_windows(full_windows(windows), load, task, cols, ("series_id", "run", "idx", "ts", "ready"), length)


def forecasts(windows: DataFrame, load: Callable[[], Model], cols: Sequence[str] = ("x",), length: int | None = None) -> DataFrame:
    """The model's forecast after every point whose window is full: one row per step h (from 1) with pred_<column>."""
    out = scores(windows, load, cols, "forecast", length)
    steps = out.select("series_id", "run", "idx", F.posexplode(F.arrays_zip(*[F.col("out")[i].alias(f"pred_{c}") for i, c in enumerate(cols)])).alias("_h", "_p"))
    return steps.select("series_id", "run", "idx", (F.col("_h") + 1).alias("h"), *[F.col("_p")[f"pred_{c}"].alias(f"pred_{c}") for c in cols])


def alerts(scored: DataFrame, threshold: DataFrame | float | str, score: str = "score", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows strictly above the threshold: a number, a frame joined on the key, or the folder of such a table.

    A folder is read when this is called, so inside ``emit`` each batch sees the thresholds as they are then.
    """
    if isinstance(threshold, str):
        threshold = scored.sparkSession.read.parquet(threshold)
    if isinstance(threshold, DataFrame):
        return scored.join(threshold, list(by)).where(F.col(score) > F.col("threshold"))
    return scored.where(F.col(score) > threshold).withColumn("threshold", F.lit(float(threshold)))


def regular_stream(
    stream: DataFrame, seconds: int, late: str, col: str = "x", key: str = "series_id", ts: str = "ts"
) -> DataFrame:
    """Tumbling means that turn an unordered stream into a regular one; rows later than ``late`` are dropped."""
    width = F.window(ts, f"{seconds} seconds")
    grouped = stream.withWatermark(ts, late).groupBy(width.alias("_w"), key).agg(F.avg(col).alias(col), F.count(col).alias("n"))
    return grouped.select(key, F.col("_w.start").alias(ts), col, "n")
