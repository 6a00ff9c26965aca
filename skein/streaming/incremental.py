"""Structured Streaming: micro-batches of new rows, running state, idempotent snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.merge import Rule, keyed_merge
from skein.runtime import scratch


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """Rows so far by value of a column; a null value is a group."""
    return stream.groupBy(column).agg(F.count(F.lit(1)).alias("events"))


def session_batches(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Rows gathered until none came for `gap`, by key; rows later than `late` behind the newest are dropped by the watermark."""
    s = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("_s")).agg(F.count(F.lit(1)).alias("events"))
    return s.select(*keys, F.col("_s.start").alias("started"), F.col("_s.end").alias("ended"), "events")


def replayed(stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """Run a stream over what its source holds now and read what it wrote last (complete) or in all (append)."""
    spark = stream.sparkSession
    root = scratch(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{'state' if mode == 'complete' else f'batch={n}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(schema)
    return out.option("recursiveFileLookup", True).parquet(f"{root}/out")


class Snapshots:
    """A table as numbered snapshots in a folder: a batch merges into the newest and writes the next, once however often it is replayed."""

    def __init__(self, path: str, keys: list[str], rules: dict[str, Rule] | None = None):
        self.path, self.keys, self.rules = path.rstrip("/"), keys, rules or {}

    def _numbers(self, spark) -> list[int]:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, spark) -> DataFrame | None:
        n = self._numbers(spark)
        return spark.read.parquet(f"{self.path}/v{n[-1]}") if n else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: snapshot `number` is the newest older one with the batch merged in (of equal keys in a batch the greatest row)."""
        spark = batch.sparkSession
        older = [n for n in self._numbers(spark) if n < number]
        rest = [c for c in batch.columns if c not in self.keys]
        one = batch.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
        new = keyed_merge(spark.read.parquet(f"{self.path}/v{older[-1]}"), one, self.keys, self.rules) if older else one
        new.write.mode("overwrite").parquet(f"{self.path}/v{number}")


def split_reasoning(text: str, phase: str, hold: str) -> tuple[list[tuple[str, str]], str, str]:
    """(kind, piece) of a stretch of model output, and the state for the next: what could begin a tag is held back."""
    out, buffer = [], hold + text
    while True:
        tag = "</think>" if phase == "think" else "<think>"
        at = buffer.find(tag)
        if at >= 0:
            if at:
                out.append((phase, buffer[:at]))
            buffer, phase = buffer[at + len(tag) :], "answer" if phase == "think" else "think"
            continue
        keep = next((k for k in range(min(len(tag) - 1, len(buffer)), 0, -1) if tag.startswith(buffer[-k:])), 0)
        if len(buffer) > keep:
            out.append((phase, buffer[: len(buffer) - keep]))
        return out, phase, buffer[len(buffer) - keep :] if keep else ""


def split_streams(stream: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "text") -> DataFrame:
    """(stream_id, seq, kind, piece): answers and reasoning of many output streams told apart, with state across batches."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, hold = state.get if state.exists else ("answer", "")
        rows = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            found, phase, hold = split_reasoning(r.text or "", phase, hold)
            rows += [(k[0], r.seq, kind, piece) for kind, piece in found]
        state.update((phase, hold))
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "kind", "piece"])

    src = stream.select(F.col(key).cast("string").alias("stream_id"), F.col(order).cast("long").alias("seq"), F.col(text).alias("text"))
    return src.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, kind string, piece string", "phase string, hold string", "append", GroupStateTimeout.NoTimeout)
