"""SimHash near-duplicates found with BK-trees.

Equal fingerprints are one class. Classes are dealt to shards so that any two within the radius meet in
at least one (pigeonhole on blocks of the fingerprint); each shard is a BK-tree, whose children are keyed
by their integer Hamming distance to the parent, and a search follows only the edges within the radius.
Trees are built where their shard lies: sending every tree to every task would need all fingerprints on
the driver.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gradeframe.llm.components import components
from gradeframe.llm.measured import small_side
from gradeframe.llm.storage import reliable_checkpoint, written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Stands with a hash of the text for a null id; ids of documents are smaller.
NO_ID = 1 << 62
SHARD_ROWS = 2048
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    size = min(shingle, n)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (stops - np.fromiter(map(len, words), np.int64, n) - 1)[: n - size + 1].tolist()
    stops = (stops - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(starts))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


class BKTree:
    """Fingerprints by Hamming distance; fingerprints at one distance of a node share a subtree."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Positions of all values within the radius."""
        found, radius = [], self.radius
        values, children = self.values, self.children
        todo = [0] if values else []
        while todo:
            node = todo.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = children[node]
            if below:
                low, high = distance - radius, distance + radius
                todo += [child for edge, child in below.items() if low <= edge <= high]
        return found

    def add(self, value: int) -> int:
        """Put a value into the tree (equal ones once) and return its position."""
        node, new = 0, len(self.values)
        while new:
            distance = (self.values[node] ^ value).bit_count()
            if not distance:
                return node
            after = self.children[node].get(distance)
            if after is None:
                self.children[node][distance] = new
                break
            node = after
        self.values.append(value)
        self.children.append({})
        return new


def shard_links(values: list[int], sides: list[int], radius: int) -> list[tuple[int, int]]:
    """Positions of linked rows, one link less than rows for each connected group.

    Rows of side 0 form the tree. With rows of side 1, only links between the sides are looked for.
    """
    parent = list(range(len(values)))

    def top(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    tree, row_of, links = BKTree(radius), {}, []
    two = max(sides) > 0

    def search(row: int) -> None:
        for node in tree.near(values[row]):
            a, b = top(row_of[node]), top(row)
            if a != b:
                parent[b] = a
                links.append((row_of[node], row))

    for row in (r for r, side in enumerate(sides) if side == 0):
        if not two:
            search(row)
        row_of.setdefault(tree.add(values[row]), row)
    for row in (r for r, side in enumerate(sides) if side == 1):
        search(row)
    return links


def _blocks(bits: int, count: int) -> list[tuple[int, int]]:
    """Offsets and widths of ``count`` blocks that share ``bits`` evenly."""
    edges = [round(i * bits / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(fp: str, radius: int, spare: int = 2):
    """One key per choice of ``spare`` out of ``radius + spare`` blocks: values within ``radius`` bits agree
    on at least ``spare`` whole blocks, and so share a key."""
    keys = []
    for number, chosen in enumerate(combinations(_blocks(64, radius + spare), spare)):
        key = F.lit(number)
        for offset, width in chosen:
            block = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key.cast("long"), width).bitwiseOR(block)
        keys.append(key)
    return F.array(*keys)


def links_of(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``left, right`` of classes (``fp, rep``) within ``radius`` bits: a spanning forest per shard.

    A shard with more than ``shard_rows`` rows is cut into pieces, and every two pieces meet in a task of
    their own, so no task holds more than two pieces and no link is lost.
    """
    rows = classes.select("fp", "rep", F.explode(shard_keys("fp", radius)).alias("shard"))
    large = rows.groupBy("shard").count().where(F.col("count") > shard_rows)
    large = reliable_checkpoint(
        large.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("pieces"))
    )
    plain = F.lit(0)
    if large.isEmpty():
        dealt = rows.select("shard", plain.alias("low"), plain.alias("high"), plain.alias("side"), "fp", "rep")
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce("pieces", F.lit(1))).cast("int")
        dealt = (
            rows.join(large, "shard", "left")
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
            .select(
                "shard",
                F.least("own", "other").alias("low"),
                F.greatest("own", "other").alias("high"),
                (F.col("own") > F.col("other")).cast("int").alias("side"),
                "fp",
                "rep",
            )
        )
    key = ["shard", "low", "high"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None

        def linked(part: pd.DataFrame) -> pd.DataFrame:
            keys = part[key].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(part) else []
            edges = [0, *cuts, len(part)]
            fps, reps, sides = part["fp"].to_numpy(), part["rep"].to_numpy(), part["side"].to_numpy()
            out = []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    values = (fps[a:b].astype(np.uint64)).tolist()
                    for x, y in shard_links(values, sides[a:b].tolist(), radius):
                        out.append((reps[a + x], reps[a + y]))
            return pd.DataFrame(out, columns=["left", "right"], dtype="int64")

        for batch in batches:
            part = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if not len(part):
                continue
            same = (part[key].to_numpy() == part[key].iloc[-1].to_numpy()).all(axis=1)
            last = int(np.flatnonzero(same)[0])
            kept = part.iloc[last:]
            yield linked(part.iloc[:last])
        if kept is not None:
            yield linked(kept)

    ordered = dealt.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInPandas(search, "left long, right long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: documents linked at ``radius`` or fewer differing bits.

    ``component_id`` is the smallest id that can be reached. Null and empty texts have fingerprint 0 and
    are linked like any other; repeated rows share a component; rows with a null id have a component of
    documents near them, or null; an empty table gives an empty table; other columns are not read.
    """
    prints = written(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash")
    classes = reliable_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links_of(classes.where("rep is not null"), radius, shard_rows))
    placed = classes.join(found, classes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    placed = reliable_checkpoint(placed)
    return prints.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, with all their columns.

    Of rows that repeat such an id one stays. Rows with a null id are judged like others, after all rows with
    an id: they go if a document with an id is in reach, and of some without one stays. See ``near_duplicates`` for
    the rest.
    """
    own = F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", own).alias("doc_id"), "text")
    found = near_duplicates(rows, radius, shard_rows).groupBy("doc_id")
    # an id that is repeated with different texts goes if any of its rows has a smaller id in reach
    found = found.agg(F.min("component_id").alias("low"), F.count("*").alias("times"))
    found = written(found.where("low < doc_id or times > 1"), "near-duplicates")
    gone = small_side(found.where("low < doc_id").select("doc_id"))
    kept = rows.join(gone, "doc_id", "left_anti")
    repeated = found.where("low >= doc_id").select("doc_id")
    if repeated.isEmpty():
        return kept.select("_row.*")
    repeated = small_side(repeated)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("_row.*")
    return kept.join(repeated, "doc_id", "left_anti").select("_row.*").unionByName(once)
