"""Records of large CSV files, read by byte ranges.

A line end ends a record only outside quotes, that is after an even number of quotes in the file. Quotes are
counted per range, the counts before each range tell on which side of a quote it starts, and then every
range cuts its lines into records by itself. What a range holds of a record that lies across its ends is put together
afterwards.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

WHOLE, REST, OPENED = 0, 1, 2
_RECORDS = "file string, at long, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and range they were read from; a range's lines keep their order within a task."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    return spark.read.option("lineSep", "\n").text(path).select("value", *place)


def _ranges(lines: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """Of each file the ranges that hold lines: start, and whether quotes are open where it starts and ends.

    One entry per range, as many as the scan has tasks.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "at").agg((F.sum(quotes.cast("long")) % 2).cast("int").alias("odd"))
    found: dict[str, list[tuple[int, int, int]]] = {}
    for file, at, flips in odd.orderBy("file", "at").toLocalIterator():
        ranges = found.setdefault(file, [])
        opened = ranges[-1][2] if ranges else 0
        ranges.append((at, opened, opened ^ flips))
    broken = sorted(file for file, ranges in found.items() if ranges[-1][2])
    if broken:
        raise ValueError(f"quotes that are not closed in {broken[:3]}")
    return found


class _Range:
    """Cuts the lines of one range into records, batch by batch."""

    def __init__(self, file: str, at: int, opened: int):
        self.file, self.at, self.opened = file, at, opened
        self.kind, self.first = (REST, False) if opened else (WHOLE, at == 0)
        self.held: list[str] = []

    def _closed(self, kind: int) -> Iterator[tuple]:
        if self.held:
            yield self.file, self.at, kind, self.first, "\n".join(self.held)
            self.first = False
        self.held, self.kind = [], WHOLE

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch | tuple]:
        counts = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        after = (np.cumsum(counts) + self.opened) % 2
        before = np.concatenate([[self.opened], after[:-1]])
        starts = np.flatnonzero(before == 0)
        self.opened = int(after[-1])
        if not len(starts):
            self.held += lines.to_pylist()
            return
        # lines before the first start end the record that is held
        self.held += lines.slice(0, starts[0]).to_pylist()
        yield from self._closed(self.kind)
        inner, last = starts[:-1], int(starts[-1])
        if self.first and len(inner):  # a file's first record goes alone
            self.held = lines.slice(inner[0], (inner[1] if len(inner) > 1 else last) - inner[0]).to_pylist()
            yield from self._closed(WHOLE)
            inner = inner[1:]
        if len(inner):
            low = int(inner[0])
            offsets = pa.array(np.append(inner, last) - low, pa.int32())
            records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(low, last - low)), "\n")
            yield self._batch(records)
        self.held = lines.slice(last).to_pylist()

    def _batch(self, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        columns = [
            pa.repeat(pa.scalar(self.file), n),
            pa.repeat(pa.scalar(self.at, pa.int64()), n),
            pa.repeat(pa.scalar(WHOLE, pa.int32()), n),
            pa.repeat(pa.scalar(False), n),
            records,
        ]
        return pa.RecordBatch.from_arrays(columns, ["file", "at", "kind", "first", "record"])

    def end(self) -> Iterator[tuple]:
        yield from self._closed(REST if self.kind == REST else OPENED if self.opened else WHOLE)


def _row(row: tuple) -> pa.RecordBatch:
    names = ["file", "at", "kind", "first", "record"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def _cut(opened: dict[tuple[str, int], int]):
    """Lines in order of their range to records and pieces of records."""

    def as_batches(found) -> Iterator[pa.RecordBatch]:
        for one in found:
            yield one if isinstance(one, pa.RecordBatch) else _row(one)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            files, ats = batch.column("file"), batch.column("at").to_numpy(zero_copy_only=False)
            codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((np.diff(codes) != 0) | (np.diff(ats) != 0)) + 1
            for low, high in zip([0, *changes], [*changes, batch.num_rows]):
                if low == high:
                    continue
                file, at = files[int(low)].as_py(), int(ats[low])
                if current is None or (current.file, current.at) != (file, at):
                    if current:
                        yield from as_batches(current.end())
                    if (file, at) not in opened:
                        raise RuntimeError(f"the ranges of {file} changed while it was read; read it again")
                    current = _Range(file, at, opened[file, at])
                yield from as_batches(current.add(batch.column("value").slice(low, high - low)))
        if current:
            yield from as_batches(current.end())

    return cut


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the CSV records below ``path``, each as its text, without the first one of each file (its header) and
    without empty ones.

    Files are spread over tasks by byte ranges (``spark.sql.files.maxPartitionBytes``), also where cells hold line
    ends. Quotes must be used as CSV writers do: around a cell, and doubled inside it; an odd number of them in a
    file is refused. The files are read once to count quotes when this is called and once more with the result, and
    ranges where a record lies across an end once again. A record is held whole by one task.
    """
    lines = _lines(spark, path)
    ranges = _ranges(lines)
    opened = {(file, at): start for file, found in ranges.items() for at, start, _ in found}
    # a plain dictionary of one number per range travels with the tasks
    shared = spark.sparkContext.broadcast(opened)

    def cut(batches):
        yield from _cut(shared.value)(batches)

    whole = lines.mapInArrow(cut, _RECORDS).where(F.col("kind") == WHOLE).select("first", "record")
    across = [(file, at) for file, found in ranges.items() for at, start, end in found if start or end]
    if across:
        wanted = F.broadcast(spark.createDataFrame(across, "file string, at long"))
        pieces = lines.join(wanted, ["file", "at"], "left_semi").select("value", "file", "at")
        pieces = pieces.mapInArrow(cut, _RECORDS).where(F.col("kind") != WHOLE)
        order = Window.partitionBy("file").orderBy("at", "kind")
        pieces = pieces.withColumn("owner", F.sum((F.col("kind") == OPENED).cast("int")).over(order))
        joined = pieces.groupBy("file", "owner").agg(
            F.sort_array(F.collect_list(F.struct("at", "kind", "record"))).alias("parts"), F.max("first").alias("first")
        )
        whole = whole.unionByName(joined.select("first", F.array_join("parts.record", "\n").alias("record")))
    return whole.where(~F.col("first") & (F.col("record") != "")).select("record")
