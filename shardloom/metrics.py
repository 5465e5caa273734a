"""Metrics of operations: timed scopes on the driver, with sizes observed by Spark, and their export."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resident_mb() -> float:
    """Resident memory of this process in MB; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1048576
    except (OSError, ValueError):
        return 0.0


@dataclass
class Metrics:
    operation_name: str
    start_time: float = 0.0
    end_time: float = 0.0
    duration: float = 0.0
    input_size: int = 0
    output_size: int = 0
    memory_peak_mb: float = 0.0
    memory_start_mb: float = 0.0
    memory_end_mb: float = 0.0
    cpu_percent: float = 0.0
    throughput_mbps: float = 0.0
    shards_created: int = 0
    compression_ratio: float = 1.0


@dataclass
class Profiler:
    """Metrics of this process, the driver; figures of executors are those of Spark's own listeners."""

    history: list[Metrics] = field(default_factory=list)
    every: float = 0.5  # seconds between samples of memory and CPU

    @contextmanager
    def operation(self, name: str, input_size: int = 0) -> Iterator[Metrics]:
        """Time what runs inside and sample memory and CPU meanwhile; it may set output_size and shards_created. Kept also if it fails."""
        m = Metrics(name, start_time=time.time(), input_size=input_size, memory_start_mb=resident_mb())
        m.memory_peak_mb = m.memory_start_mb
        done, cpu = threading.Event(), time.process_time()

        def watch() -> None:
            while not done.wait(self.every):
                m.memory_peak_mb = max(m.memory_peak_mb, resident_mb())

        sampler = threading.Thread(target=watch, daemon=True)
        sampler.start()
        try:
            yield m
        finally:
            done.set()
            sampler.join()
            m.end_time = time.time()
            m.duration = m.end_time - m.start_time
            m.memory_end_mb = resident_mb()
            m.memory_peak_mb = max(m.memory_peak_mb, m.memory_end_mb)
            m.cpu_percent = (time.process_time() - cpu) / m.duration * 100 if m.duration > 0 else 0.0
            m.throughput_mbps = m.input_size / 1048576 / m.duration if m.duration > 0 else 0.0
            m.compression_ratio = m.output_size / m.input_size if m.input_size else 1.0
            self.history.append(m)

    def table(self, spark: SparkSession) -> DataFrame:
        """The history as rows of run_metrics."""
        return spark.createDataFrame([asdict(m) for m in self.history], "operation_name string, start_time double, end_time double, duration double, input_size bigint, output_size bigint, memory_peak_mb double, memory_start_mb double, memory_end_mb double, cpu_percent double, throughput_mbps double, shards_created int, compression_ratio double")

    def export(self, kind: str = "json") -> str:
        """The history as json, csv or summary; other kinds raise ValueError."""
        rows = [asdict(m) for m in self.history]
        if kind == "json":
            return json.dumps(rows, indent=2)
        if kind == "csv":
            return "\n".join([",".join(Metrics.__dataclass_fields__), *(",".join(map(str, r.values())) for r in rows)])
        if kind == "summary":
            return "\n".join(f"{m.operation_name}: {m.duration:.3f} s, {m.throughput_mbps:.2f} MB/s, {m.shards_created} shards" for m in self.history)
        raise ValueError(f"unknown format: {kind}")


#: Columns of an export, and the numbers among them that are written with six decimals.
_EXPORT = ("operation_name", "duration", "input_size", "output_size", "memory_peak_mb", "throughput_mbps", "shards_created", "compression_ratio")
_DECIMAL = ("duration", "memory_peak_mb", "throughput_mbps", "compression_ratio")


def export_rows(metrics: DataFrame, kind: str = "csv") -> DataFrame:
    """(run_id, line): rows of run_metrics of any number as lines of csv (without its head), json or summary; other kinds raise ValueError. Nulls are empty in csv and left out in json."""
    cols = [(F.col(c).cast("decimal(20,6)") if c in _DECIMAL else F.col(c)).alias(c) for c in _EXPORT]
    if kind == "csv":
        line = F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    elif kind == "json":
        line = F.to_json(F.struct(*cols))
    elif kind == "summary":
        line = F.concat("operation_name", F.lit(": "), F.coalesce(F.round("duration", 3).cast("string"), F.lit("?")), F.lit(" s, "), F.coalesce(F.col("shards_created").cast("string"), F.lit("?")), F.lit(" shards"))
    else:
        raise ValueError(f"unknown format: {kind}")
    return metrics.select("run_id", line.alias("line"))


_PROFILER = Profiler()


def get_profiler() -> Profiler:
    """The profiler of this process."""
    return _PROFILER
