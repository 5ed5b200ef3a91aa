"""Keyed state of a stream that asks a model: which keys were asked, and which came back good."""

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from gradeframe.operators.joins import is_small
from gradeframe.sources import snapshots as P

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_OUTCOMES = "_outcomes"
#: Where a result was kept; the outcomes of one folder may be told more than once.
_PLACE = [StructField("run", LongType()), StructField("origin", StringType()), StructField("part", LongType())]


def record_outcomes(spark: SparkSession, path: str, key: Sequence[str], is_open) -> None:
    """Narrow rows (key, good, place) of the result folders that were not recorded before.

    Every result folder is read for this once, when a stream starts and not by its batches. A run that dies
    between the two writes records some outcomes twice, which changes nothing.
    """
    files = P.files_of(spark, path)
    seen = {name for marker, _ in files.find("_seen/*.json") for name in json.loads(files.read(marker))}
    names = P.folders(spark, path)
    if names is None and files.find("run=*"):
        names = P.commit(spark, path, lambda now: now)
    new = [name for name in names or [] if name not in seen]
    if new:
        rows = P.read_snapshot(spark, path, new)
        mark = uuid.uuid4().hex
        place = [F.col(f.name).cast(f.dataType).alias(f"_{f.name}") for f in _PLACE]
        told = rows.select(*key, (~is_open(rows)).alias("_good"), *place)
        told.write.parquet(f"{path}/{_OUTCOMES}/{mark}")
        files.put_new(f"_seen/{mark}.json", json.dumps(new))


def known_keys(schema: StructType, path: str, key: Sequence[str], spark: SparkSession, kept: str) -> DataFrame | None:
    """``key, _good, _round`` of every key with a recorded outcome: whether any was good, and how many folders hold a
    failure of it. Written to ``kept``, as all batches of a start read it; none where nothing was recorded."""
    if not P.files_of(spark, path).find(f"{_OUTCOMES}/*"):
        return None
    place = [StructField(f"_{f.name}", f.dataType) for f in _PLACE]
    kind = StructType([*(schema[k] for k in key), StructField("_good", BooleanType()), *place])
    told = spark.read.schema(kind).parquet(f"{path}/{_OUTCOMES}/*")
    folder = F.struct(*(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in place))
    known = told.groupBy(*key).agg(
        F.bool_or("_good").alias("_good"), F.count_distinct(F.when(~F.col("_good"), folder)).alias("_round")
    )
    known.write.mode("overwrite").parquet(kept)
    return spark.read.schema(known.schema).parquet(kept)


def to_ask(rows: DataFrame, known: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Rows of a stream whose key was not asked yet, or failed.

    A key is asked once a round, and every failure that is known opens a new round. The state is the key and the
    number of its round; what is known is joined to the rows of a batch.
    """
    key = list(key)
    if known is None:
        dealt = rows.withColumn("_round", F.lit(0).cast("long"))
    else:
        told = known.select(*(F.col(k).alias(f"_known_{k}") for k in key), "_good", F.col("_round").alias("_failures"))
        told = F.broadcast(told) if is_small(told) else told.hint("merge")
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in key))
        open_ = rows.join(told, same, "left").where(~F.coalesce("_good", F.lit(False)))
        dealt = open_.select(*rows.columns, F.coalesce("_failures", F.lit(0).cast("long")).alias("_round"))
    return dealt.dropDuplicates([*key, "_round"]).select(*rows.columns)


class state_in_rocks:
    """The state store that keeps large state on disk and commits what a batch changed, set while a query is started."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = {name: self.spark.conf.get(name, None) for name in STATE_STORE}
        for name, value in STATE_STORE.items():
            self.spark.conf.set(name, value)

    def __exit__(self, *_) -> None:
        for name, value in self.before.items():
            if value is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, value)
