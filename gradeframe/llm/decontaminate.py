"""Benchmark items found in documents by SimHash of item-sized windows; DataFrame functions only.

Every item is an array of hashed word shingles; a document window has as many words as the item. Windows
that hold too few shingles of items of their size can't reach the similarity and are never formed (no loss,
see ``windows_of``). The others get a SimHash, meet the items of their size on any block of
the fingerprint that differs by few bits (which finds all within the radius), and are compared exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.columns import bind, normalised
from gradeframe.llm.measured import small_side
from gradeframe.llm.storage import written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
#: Items with at most this share of different shingles are repetitive.
REPETITIVE = 0.75


def shingles_of(text: str, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` lower-cased words, in order and with repeats; none for shorter texts."""

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - size)
        hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
        return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<bigint>"))

    return bind(F.split(normalised(text), " "), runs)


def simhash(hashes: str) -> Column:
    """A bit is set where it is set in over half the hashes of the named column."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | "
        f"if(2 * size(filter({hashes}, h -> getbit(h, b) = 1)) > size({hashes}), shiftleft(1L, b), 0L))"
    )


def overlap(left: str, right: str) -> Column:
    """Shared shingles of two arrays, each as often as both have it."""
    return F.expr(
        f"aggregate(array_intersect({left}, {right}), 0, (n, h) -> n + "
        f"least(size(filter({left}, x -> x = h)), size(filter({right}, x -> x = h))))"
    )


def least_shared(item: Column, window: Column, similarity: float) -> Column:
    """Fewest shared shingles with which two arrays of these sizes can reach the similarity."""
    return F.ceil((item + window) * (similarity / (1 + similarity)) - 1e-9).cast("int")


def windows_of(texts: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """``text_key, n, windows``: starts of the windows that could be similar to an item of ``n`` shingles.

    A window starts at a shingle that some item of its size has: moving a window forward to the first such
    shingle loses none that it shares, so the best windows are among these. At the end of a text a
    window is cut short. It must hold as many shingles of items of its size as the similarity asks for.
    """
    index = items.select("n", F.explode("shingles").alias("hash")).distinct()
    index = small_side(written(index, "benchmark-shingles"))
    # the outer form, as the plain one would compute all shingles once more to filter empty arrays
    places = texts.select("text_key", "shingles", F.posexplode_outer("shingles").alias("at", "hash"))
    places = places.select("text_key", F.size("shingles").alias("total"), "at", "hash")
    found = places.join(index, "hash").groupBy("text_key", "n", "total").agg(
        F.sort_array(F.collect_set("at")).alias("at")
    )
    start = F.col("at")

    def fits(place: Column, i: Column) -> Column:
        held = F.least(F.col("n"), F.col("total") - place)
        last = F.get(start, i + least_shared(F.col("n"), held, similarity) - 1)
        return F.coalesce(last < place + F.col("n"), F.lit(False))

    kept = found.select("text_key", "n", F.filter(start, fits).alias("starts"))
    return kept.where(F.size("starts") > 0)


def block_values(fp: str, blocks: int, near: int) -> Column:
    """One struct per block of the fingerprint and value within ``near`` bits of it; ``fp`` names a column other
    than ``b`` and ``v``, which are taken."""
    width = 64 // blocks
    mask = (1 << width) - 1
    return F.expr(
        f"flatten(transform(sequence(0, {blocks - 1}), b -> transform("
        f"filter(sequence(0, {mask if near else 0}), "
        f"v -> bit_count(v) <= {near}), "
        f"v -> named_struct('block', b, 'value', (shiftrightunsigned({fp}, b * {width}) & {mask}L) ^ v))))"
    )


def text_key() -> Column:
    """Two hashes by which a text is known: equal texts have equal windows."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, similarity, start, distance``: the best window of each document for each item.

    A window starts at a shingle that the item has: moving it forward to the first such one loses nothing.
    Similarity is the weighted Jaccard similarity of word shingles, a shingle's weight being the number of
    times that it stands in the window or item. Fingerprints within ``radius`` bits differ by at most
    ``radius // blocks`` bits in one of the blocks, so none of them is missed; the default radius is wide
    enough that windows of the asked similarity stay within it but for odds of about one in 10**5, where most
    shingles of an item are different ones. In a repetitive item a few shingles that stand once more or less often can
    turn the whole fingerprint: its windows are found by the shingle that they start with instead, which
    is exact.

    Null and empty texts and items of less than ``shingle`` words match nothing. Equal texts are searched once
    and reported for each row; equal items are reported each; rows that are equal in id and text are
    reported once; of equally similar windows the first counts. Empty tables give an empty table;
    other columns are not read.
    """
    best = contaminated_texts(docs, benchmark, **options)
    # hashes of whole texts only, so that no text is moved
    rows = docs.select("doc_id", text_key().alias("text_key")).distinct()
    return rows.join(best, "text_key").select("doc_id", "item_id", "similarity", "start", "distance")


def contaminated_texts(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``text_key, item_id, similarity, start, distance``: the best window of each text for each item."""
    texts = docs.select(text_key().alias("text_key"), shingles_of("text", shingle).alias("shingles"))
    items = benchmark.select("item_id", shingles_of("text", shingle).alias("shingles"))
    items = written(items.select("item_id", "shingles", F.size("shingles").alias("n")), "benchmark-items")
    items = written(items.where("n > 0").withColumn("fp", simhash("shingles")), "benchmark-prints")

    starts = written(windows_of(texts, items, similarity), "windows")
    wanted = small_side(starts.select("text_key").distinct())
    windows = (
        texts.join(wanted, "text_key", "left_semi")
        .dropDuplicates(["text_key"])
        .join(starts, "text_key")
        .select("text_key", "n", "shingles", F.explode("starts").alias("start"))
        .select("text_key", "n", "start", F.slice("shingles", F.col("start") + 1, F.col("n")).alias("window"))
    )
    windows = written(windows.withColumn("window_fp", simhash("window")), "window-prints")

    near = items.select("item_id", "n", F.col("fp"), F.explode(block_values("fp", blocks, radius // blocks)).alias("b"))
    near = small_side(written(near.select("item_id", "n", "fp", "b.*"), "item-blocks"))
    probe = windows.select(
        "text_key", "n", "start", "window_fp", F.explode(block_values("window_fp", blocks, 0)).alias("b")
    ).select("text_key", "n", "start", "window_fp", "b.*")
    pairs = (
        probe.join(near, ["n", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("window_fp"))).cast("int"))
        .where(F.col("distance") <= radius)
        .select("text_key", "n", "start", "item_id", "distance")
    )
    repetitive = items.where(F.size(F.array_distinct("shingles")) <= REPETITIVE * F.col("n"))
    first = repetitive.select("item_id", "n", "fp", F.explode(F.array_distinct("shingles")).alias("hash"))
    first = small_side(written(first, "repetitive-items"))
    exact = windows.withColumn("hash", F.get("window", F.lit(0))).join(first, ["n", "hash"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("window_fp"))).cast("int").alias("distance")
    pairs = pairs.unionByName(exact.select("text_key", "n", "start", "item_id", distance)).distinct()
    shared = overlap("window", "shingles")
    checked = (
        pairs.join(windows.select("text_key", "n", "start", "window"), ["text_key", "n", "start"])
        .join(items.select("item_id", "shingles").withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
        .where(F.array_contains("shingles", F.get("window", F.lit(0))))
        .withColumn("shared", shared)
        .withColumn("similarity", F.col("shared") / (F.size("window") + F.size("shingles") - F.col("shared")))
        .where(F.col("similarity") >= similarity - 1e-12)
    )
    order = F.struct((-F.col("similarity")).alias("less"), "start", "distance")
    best = checked.groupBy("text_key", "item_id").agg(F.min(order).alias("best"))
    return best.select(
        "text_key",
        "item_id",
        (-F.col("best.less")).alias("similarity"),
        F.col("best.start").alias("start"),
        F.col("best.distance").alias("distance"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a window similar to a benchmark item, with all their columns.

    Rows are judged by their text, with or without an id. See ``contaminated`` for all other cases.
    """
    found = contaminated_texts(docs, benchmark, **options).select("text_key.*").distinct()
    found = written(found.select(F.col("a").alias("_a"), F.col("b").alias("_b")), "leaks")
    rows = docs.select(F.struct("*").alias("_row"), text_key().alias("_key"))
    rows = rows.select("_row", F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"))
    return rows.join(small_side(found), ["_a", "_b"], "left_anti").select("_row.*")
