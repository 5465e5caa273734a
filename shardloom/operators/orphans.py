"""References to records that do not exist.

Method: keyed pending-orphan state, maintained incrementally. New references probe the index of stored and removed keys,
arriving records resolve the references that wait for them, removals open references again, and the changes of each
batch are kept as differences of counts, whose sums are the snapshots. All folds are minima and maxima, so batches may
come in any order and more than once.

The state is a folder of tables in shared storage, with a part for each batch: `index` (what the batch told of keys) and
`refs`, whose kind `open` holds all references that are missing, removed or late after the batch (what is pending,
nothing else), and `held` those that came to rest in it. Both are cut into buckets by hash of the key; a batch reads the
buckets its keys lie in and the pending references, not the history. Parts are merged from time to time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir

KEY = ["run_id", "ref_id"]
NAMES = ["src_table", "run_id", "shard_id", "ref_field", "ref_id"]
REF = [*NAMES, "recorded_at"]
TIMES = ["first_written", "last_written", "last_removed"]
#: Most buckets of a state, and the events that make `replay` take one more.
BUCKETS, BUCKET_ROWS = 4096, 2_000_000
#: Parts that are merged into one.
COMPACT = 16

_INDEX = "run_id bigint, ref_id string, stored boolean, first_written timestamp_ntz, last_written timestamp_ntz, last_removed timestamp_ntz, bucket int"
_REFS = "src_table string, run_id bigint, shard_id string, ref_field string, ref_id string, recorded_at timestamp_ntz, before string, state string, kind string, bucket int"
_DELTA = "batch int, src_table string, period string, state string, n bigint"


def shard_references(meta: DataFrame, docs: DataFrame) -> DataFrame:
    """(src_table, run_id, shard_id, ref_field, ref_id, recorded_at): non-empty links of shard_meta and root_shard of doc_meta, in one pass over each."""
    links = F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref_id")) for c in ("parent_id", "next_shard", "previous_shard")))
    a = meta.select(F.lit("shard_meta").alias("src_table"), "run_id", "shard_id", F.inline(links), "recorded_at")
    b = docs.select(F.lit("doc_meta").alias("src_table"), "run_id", F.col("root_shard").alias("shard_id"), F.lit("root_shard").alias("ref_field"), F.col("root_shard").alias("ref_id"), F.col("created_at").alias("recorded_at"))
    return a.unionByName(b).where("ref_id <> ''").select(*REF)


def _told(arrivals: DataFrame | None, removals: DataFrame | None) -> DataFrame | None:
    """(run_id, ref_id, stored, first_written, last_written, last_removed) as rows to be folded."""
    ts = lambda c: F.lit(None).cast("timestamp_ntz").alias(c)
    w = F.col("written_at").cast("timestamp_ntz")
    parts = []
    if arrivals is not None:
        parts.append(arrivals.select("run_id", F.col("shard_id").alias("ref_id"), F.lit(True).alias("stored"), w.alias("first_written"), w.alias("last_written"), ts("last_removed")))
    if removals is not None:
        parts.append(removals.select("run_id", F.col("shard_id").alias("ref_id"), F.lit(False).alias("stored"), ts("first_written"), ts("last_written"), F.col("removed_at").cast("timestamp_ntz").alias("last_removed")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _fold(rows: DataFrame) -> DataFrame:
    """One row a key, pre-aggregated on the map side."""
    return rows.groupBy(*KEY).agg(F.max("stored").alias("stored"), F.min("first_written").alias("first_written"), F.max("last_written").alias("last_written"), F.max("last_removed").alias("last_removed"))


def judged() -> Column:
    """State of a reference beside its key's times: missing, removed, late or held.

    missing: never stored; removed: last removed after it was last stored; late: first stored after the reference was
    recorded. Null times compare as unknown (no removed, no late).
    """
    return (
        F.when(~F.coalesce("stored", F.lit(False)), F.lit("missing"))
        .when(F.col("last_removed") > F.col("last_written"), F.lit("removed"))
        .when(F.col("first_written") > F.col("recorded_at"), F.lit("late"))
        .otherwise("held")
    )


def _period() -> Column:
    return F.date_format("recorded_at", "yyyy-MM")


def _parts(batches: int) -> tuple[list[int], list[int]]:
    """Numbers of the parts that count after so many batches, and of all merged ones: a part has the number of its last batch, below zero if merged."""
    parts: list[int] = []
    merges: list[int] = []
    for b in range(1, batches + 1):
        parts.append(b)
        if len(parts) == COMPACT:
            parts = [-b]
            merges.append(-b)
    return parts, merges


@dataclass
class OrphanState:
    """The state after some batches, all of it in its folder; so a state is taken up again by folder, buckets and number of batches."""

    spark: SparkSession
    folder: str
    buckets: int = 64
    batches: int = 0

    @property
    def parts(self) -> list[int]:
        return _parts(self.batches)[0]

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None, buckets: int = 64) -> OrphanState:
        """An empty state, in a folder of its own in shared storage if none is given. The number of buckets stays as it is."""
        return cls(spark, folder or f"{shared_dir(spark)}/orphans-{uuid4().hex}", buckets)

    @classmethod
    def start(cls, refs: DataFrame, arrivals: DataFrame, removals: DataFrame) -> OrphanState:
        """The state after a first batch of all three."""
        return cls.new(refs.sparkSession).advance(refs, arrivals, removals)

    def _read(self, name: str, schema: str, parts: list[int], touched: list[int] | None = None) -> DataFrame:
        if not parts or touched == []:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/part={b}" for b in parts)).drop("part")
        return rows if touched is None else rows.where(F.col("bucket").isin(touched))

    def _write(self, df: DataFrame, name: str, part: int, *by: str) -> None:
        df = df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))
        (df.repartition("bucket") if self.buckets > 1 else df).write.mode("overwrite").partitionBy(*by, "bucket").parquet(f"{self.folder}/{name}/part={part}")

    def _refs(self, kind: str, parts: list[int], touched: list[int] | None = None) -> DataFrame:
        return self._read("refs", _REFS, parts, touched).where(F.col("kind") == kind)

    def advance(self, refs: DataFrame | None = None, arrivals: DataFrame | None = None, removals: DataFrame | None = None) -> OrphanState:
        """Fold one batch in: two writes. A batch that fails half-way and is folded again leaves the same state.

        Read of the state: the pending references; held ones of buckets with removals or new references; what the index
        knows of the batch's keys, in their buckets. Joined sides are unique by key, so adaptive skew joins may split hot
        keys; broadcasts are left to the planner, by size.
        """
        b = self.batches + 1
        fresh = self.spark.createDataFrame([], _REFS).select(*REF) if refs is None else refs.select(*NAMES, F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))
        told = _told(arrivals, removals)
        self._write(self.spark.createDataFrame([], _INDEX).drop("bucket") if told is None else _fold(told), "index", b)
        told = self._read("index", _INDEX, [b])
        touched = quiet = None
        if self.buckets > 1:  # collects at most that many rows
            asked = fresh.select(F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket"), F.lit(True).alias("stirs"))
            rows = asked.unionByName(told.select("bucket", F.col("last_removed").isNotNull().alias("stirs"))).groupBy("bucket").agg(F.max("stirs").alias("stirs")).collect()
            touched, quiet = sorted(r.bucket for r in rows), sorted(r.bucket for r in rows if r.stirs)
        keys = told.select(*KEY).unionByName(fresh.select(*KEY)).distinct()
        times = _fold(self._read("index", _INDEX, self.parts, touched).join(keys, KEY, "left_semi").unionByName(told).drop("bucket")).withColumn("heard", F.lit(True))
        # held references can change only if their key was removed, or count again only if they come again
        stirs = told.where("last_removed is not null").select(*KEY).unionByName(fresh.select(*KEY)).distinct()
        at_rest = self._refs("held", self.parts, quiet).join(stirs, KEY, "left_semi")
        pending = self._refs("open", [b - 1] if self.batches else [])
        rows = fresh.withColumn("state", F.lit("")).unionByName(pending.select(*REF, "state")).unionByName(at_rest.select(*REF, "state"))
        # a reference may lie in held and, since it was opened again, in open: the latter tells its state
        rank = F.when(F.col("state") == "", 0).when(F.col("state") == "held", 1).otherwise(2)
        one = rows.groupBy(*REF).agg(F.max_by("state", rank).alias("before"), F.min("state").alias("least"))
        now = one.join(times, KEY, "left").withColumn("state", F.when(F.col("heard").isNotNull() | (F.col("least") == ""), judged()).otherwise(F.col("before")))
        kept = now.where("state <> 'held' or before <> 'held'").select(*REF, "before", "state", F.when(F.col("state") == "held", "held").otherwise("open").alias("kind"))
        self._write(kept, "refs", b, "kind")
        if len(self.parts) + 1 == COMPACT:
            self._merge([*self.parts, b], -b)
        return OrphanState(self.spark, self.folder, self.buckets, b)

    def _merge(self, parts: list[int], whole: int) -> None:
        """Merge parts of index and of held references into one each, and the differences of counts of their batches; amortised over the batches between."""
        self._write(_fold(self._read("index", _INDEX, parts).drop("bucket")), "index", whole)
        self._write(self._refs("held", parts).select(*REF, "state", "kind").distinct().withColumn("before", F.col("state")), "refs", whole, "kind")
        self._moves([p for p in parts if p > 0]).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/delta/part={whole}")

    def vacuum(self) -> None:
        """Delete the parts that merged ones have replaced. A state of fewer batches can't be taken up after that."""
        parts, merges = _parts(self.batches)
        if not merges:
            return
        gone = [*(b for b in range(1, -merges[-1] + 1) if b != self.batches), *merges[:-1]]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in ("index", "refs"):
            for b in gone:
                place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/part={b}")
                place.getFileSystem(conf).delete(place, True)

    def _moves(self, parts: list[int]) -> DataFrame:
        """(batch, src_table, period, state, n) of these batches."""
        rows = self.spark.read.schema(_REFS + ", part int").option("basePath", f"{self.folder}/refs").parquet(*(f"{self.folder}/refs/part={b}" for b in parts)).where("before <> state")
        both = F.filter(F.array(F.struct(F.col("state"), F.lit(1).alias("d")), F.struct(F.col("before").alias("state"), F.lit(-1).alias("d"))), lambda x: x["state"] != "")
        return rows.select(F.col("part").alias("batch"), "src_table", _period().alias("period"), F.inline(both)).groupBy("batch", "src_table", "period", "state").agg(F.sum("d").cast("bigint").alias("n")).where("n <> 0")

    def references(self) -> DataFrame:
        """(src_table, run_id, shard_id, ref_field, ref_id, recorded_at, state) of the pending references: those open or answered late."""
        return self._refs("open", [self.batches] if self.batches else []).select(*REF, "state")

    def orphans(self) -> DataFrame:
        """(src_table, run_id, shard_id, ref_field, ref_id, state, period) of the pending references; a null recorded_at gives a null period, repeated references count once."""
        return self.references().select(*NAMES, "state", _period().alias("period")).distinct()

    def deltas(self) -> DataFrame:
        """(batch, src_table, period, state, n): by how many references of a period each batch changed the number in a state."""
        parts, merges = _parts(self.batches)
        late = [p for p in parts if p > 0]
        rows = [self.spark.read.schema(_DELTA).parquet(*(f"{self.folder}/delta/part={p}" for p in merges))] if merges else []
        rows += [self._moves(late)] if late else []
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], _DELTA)

    def snapshot(self, batch: int | None = None) -> DataFrame:
        """(src_table, period, state, n) of the references as they stand now, or stood after a batch, from the differences alone; a reference recorded at several times counts at each."""
        rows = self.deltas() if batch is None else self.deltas().where(F.col("batch") <= batch)
        return rows.groupBy("src_table", "period", "state").agg(F.sum("n").alias("n")).where("n <> 0")


def replay(refs: DataFrame, arrivals: DataFrame, removals: DataFrame, step: int = 1) -> tuple[OrphanState, list[str]]:
    """The state after batches of `step` months of references, arrivals and removals, by their own times, and the first month of each batch.

    Events are cut by batch once; a batch reads its own. Events without a time come first. Months are few at any size.
    """
    spark = refs.sparkSession
    none = lambda c: F.lit(None).cast("string").alias(c)
    of = lambda df, kind, key, at: df.select(F.lit(kind).alias("event"), none("src_table"), "run_id", none("shard_id"), none("ref_field"), F.col(key).alias("ref_id"), F.col(at).cast("timestamp_ntz").alias("at"))
    a = refs.select(F.lit("ref").alias("event"), *NAMES, F.col("recorded_at").cast("timestamp_ntz").alias("at"))
    rows = a.unionByName(of(arrivals, "stored", "shard_id", "written_at")).unionByName(of(removals, "removed", "shard_id", "removed_at"))
    folder = f"{shared_dir(spark)}/orphans-{uuid4().hex}"
    # one shuffle; a batch is cut into parts, so that it is no single task
    number = F.year("at") * 12 + F.month("at") - 1
    first = number - F.pmod(number, F.lit(step))
    rows = rows.withColumn("month", F.when(F.col("at").isNull(), "0000-00").otherwise(F.format_string("%04d-%02d", F.floor(first / 12), F.pmod(first, F.lit(12)) + 1)))
    rows.repartition("month", F.pmod(F.xxhash64("run_id", "ref_id"), F.lit(4))).write.mode("overwrite").partitionBy("month").parquet(f"{folder}/events")
    events = spark.read.parquet(f"{folder}/events")
    months = events.groupBy(F.col("month").cast("string").alias("month")).count().orderBy("month").collect()
    state = OrphanState.new(spark, folder, max(1, min(BUCKETS, sum(m["count"] for m in months) // BUCKET_ROWS)))
    for m in months:
        part = spark.read.schema("event string, src_table string, run_id bigint, shard_id string, ref_field string, ref_id string, at timestamp_ntz").parquet(f"{folder}/events/month={m.month}")
        kind = lambda k: part.where(F.col("event") == k)  # noqa: E731, B023
        state = state.advance(
            kind("ref").select(*NAMES, F.col("at").alias("recorded_at")), kind("stored").select("run_id", F.col("ref_id").alias("shard_id"), F.col("at").alias("written_at")), kind("removed").select("run_id", F.col("ref_id").alias("shard_id"), F.col("at").alias("removed_at"))
        )
    return state, [m.month for m in months]
