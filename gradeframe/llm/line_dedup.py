"""Fuzzy line deduplication; DataFrame functions only.

Lines are normalised and hashed; equal ones are one class. The words of a line are dealt into blocks by their hash, and
each block of its fingerprint is the SimHash of the words that fell there, so that a changed word touches two
blocks at most and leaves the others as they were. Lines that agree in a block meet there; in short lines
every word is a block, and lines meet that agree in all but one. Every class meets the smallest one of its bucket.
Lines that share no bucket can be alike, too: lines that are not connected yet meet by cells, more of which than
edits are allowed leave out no pair that has the similarity. Candidates are verified by edit similarity. One occurrence
of each connected group stays.
"""

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.columns import bind, normalised
from gradeframe.llm.components import components
from gradeframe.llm.measured import small_side
from gradeframe.llm.storage import scratch, setting, written
from gradeframe.operators.bloom import blocks_for, key_filter, with_maybe

SIMILARITY = 0.9
#: Blocks have so many distinct words or up to twice as many; lines of fewer than three blocks' words leave out words.
BLOCK_WORDS = 4
MOST_BLOCKS = 32
SHORT_WORDS = 24
#: Letters that a block, or the rest of a short line, must hold: a few frequent words say too little.
BLOCK_LETTERS = 18
REST_LETTERS = 16
#: Word counts of similar lines differ by about so much; lines near a change of block number have blocks of both.
SLACK = 0.12
#: Lines of fewer words than this, but long, meet by their starts and ends.
FEW_WORDS = 6
END_LETTERS = 16
#: Binary digits of the counts behind a block's SimHash; counts of 64 words and more start anew.
DIGITS = 6
#: Longs that hold the counts of 64 bits, four in each; so many words at most are counted so.
LANES = 16
MOST_WORDS = 16_000
#: Edits of two texts are looked for up to this part of those allowed first.
FEW_EDITS = 8
#: Lines in memory at once where all lines of about a length meet.
BLOCK_ROWS = 1 << 16
#: Lines that have more cells than this in one place count as several. A cell takes 150 bytes of a hash table that doubles,
#: and several places can fall to one task.
BLOCK_CELLS = 5
#: Letters of a line that are cut into grams at a time.
STRETCH = 256
#: Cells of lines that a task has in memory, about.
TASK_CELLS = 100_000
#: Cells are met in as many passes as the pieces of lines are larger than the lines, times this; fewer where passes would
#: have less than so many letters of pieces.
PASSES = 3
PASS_LETTERS = 16_000_000
#: With this setting, what a query shuffled is removed when its result is written.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null id, and is the smallest one.
NO_ID = -(1 << 63)


#: Letters of a cell of a line: shorter ones tell too little, longer ones leave out more short lines.
LEAST_CELL = 7
MOST_CELL = 12
#: Cells after a common one that are compared, too.
AFTER = 3
#: Letters at least of a stretch of places that is dealt out at a time.
PIECE = 128


class Grams(NamedTuple):
    """Bitmaps of a number of words, a power of two, for pairs whose longer line has ``from_size`` to ``to_size`` letters."""

    size: int
    words: int
    from_size: int
    to_size: int
    #: Letters of further grams that are kept as a set, or none.
    set_size: int = 0


#: Longer lines share more grams by chance, so theirs are longer, with larger bitmaps and a set for what passes these.
GRAMS = (Grams(4, 32, 0, 511), Grams(5, 64, 512, (1 << 31) - 1, 6))

#: For lines that are too short for cells.
SHORT = Grams(4, 8, 0, 0)


def simhash(hashes: Column) -> Column:
    """A bit for each place that is set in over half the hashes of an array.

    All 64 counts are kept side by side: field ``c0`` has their lowest binary digits, ``c1`` the next, and so on.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("n"), *(zero.alias(f"c{i}") for i in range(DIGITS)))

    def add(counts: Column, word: Column) -> Column:
        fields, carry = [(counts["n"] + 1).alias("n")], word
        for i in range(DIGITS):
            fields.append(counts[f"c{i}"].bitwiseXOR(carry).alias(f"c{i}"))
            carry = counts[f"c{i}"].bitwiseAND(carry)
        return F.struct(*fields)

    def over_half(counts: Column) -> Column:
        least = F.floor(counts["n"] / 2).cast("int") + 1
        more, same = zero, F.lit(-1).cast("long")
        for i in reversed(range(DIGITS)):
            digit = -(F.shiftright(least, i).bitwiseAND(1)).cast("long")
            more = more.bitwiseOR(same.bitwiseAND(counts[f"c{i}"]).bitwiseAND(F.bitwise_not(digit)))
            same = same.bitwiseAND(F.bitwise_not(counts[f"c{i}"].bitwiseXOR(digit)))
        return more.bitwiseOR(same)

    return F.aggregate(hashes, start, add, over_half)


def _letters(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + w["n"])


def _block_buckets(words: Column, blocks: Column) -> Column:
    """A bucket for each block that holds enough letters."""

    def bucket(i: Column) -> Column:
        # the number of blocks is a power of two
        own = F.filter(words, lambda w: w["g"].bitwiseAND(blocks - 1) == i)

        def key(held: Column) -> Column:
            print_ = simhash(F.transform(held, lambda w: w["h"]))
            return F.when(_letters(held) >= BLOCK_LETTERS, F.xxhash64(blocks, i, print_))

        return bind(own, key)

    return F.transform(F.sequence(F.lit(0), blocks - 1), bucket)


def _rest_buckets(words: Column) -> Column:
    """A bucket for all words of a line, and one for all but one of them, for each word."""

    def buckets(whole: Column) -> Column:
        def without(w: Column) -> Column:
            rest = F.xxhash64(F.lit("rest"), whole["h"].bitwiseXOR(w["h"]))
            return F.when(whole["n"] - w["n"] >= REST_LETTERS, rest)

        every = F.when(whole["n"] >= REST_LETTERS, F.xxhash64(F.lit("rest"), whole["h"]))
        return F.concat(F.array(every), F.transform(words, without))

    total = F.aggregate(
        words,
        F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("n")),
        lambda t, w: F.struct(t["h"].bitwiseXOR(w["h"]).alias("h"), (t["n"] + w["n"]).alias("n")),
    )
    return bind(total, buckets)


def _end_buckets(norm: Column) -> Column:
    """Buckets for the start and the end of a line, of two lengths where the line is near a change of length."""

    def ends(factor: float) -> list[Column]:
        size = F.call_function("shiftleft", F.lit(1), F.floor(F.log2(F.length(norm) * factor)).cast("int"))
        usable = size >= END_LETTERS
        first = F.xxhash64(F.lit("start"), F.substring(norm, F.lit(1), size))
        last = F.xxhash64(F.lit("end"), F.substring(norm, -size, size))
        return [F.when(usable, first), F.when(usable, last)]

    return F.array(*ends(0.5 * (1 - SLACK)), *ends(0.5))


def _words_of(each: Column) -> Column:
    """Hash, letters and group of every word of a list."""

    def word(w: Column) -> Column:
        def hashed(h: Column) -> Column:
            return F.struct(h.alias("h"), F.length(w).alias("n"), _group(h, F.lit(MOST_BLOCKS)).alias("g"))

        return bind(F.xxhash64(w), hashed)

    return F.transform(each, word)


def _group(h: Column, blocks: Column) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(blocks - 1).cast("int")


def _levels(n: Column) -> Column:
    """Numbers of blocks of a line of ``n`` words: one, or two where the line is near a change of their number."""

    def level(factor: float) -> Column:
        power = F.floor(F.log2(n * factor / BLOCK_WORDS)).cast("int")
        return F.least(F.call_function("shiftleft", F.lit(1), F.greatest(power, F.lit(1))), F.lit(MOST_BLOCKS))

    return F.array_distinct(F.array(level(1 - SLACK), level(1 + SLACK)))


def _whole_buckets(words: Column, norm: Column) -> Column:
    """Buckets of lines of few words, which are not those of blocks."""
    none = F.array().cast("array<bigint>")
    rest = F.when(F.size(words) < SHORT_WORDS, _rest_buckets(words)).otherwise(none)
    return F.concat(rest, F.when(F.size(words) < FEW_WORDS, _end_buckets(norm)).otherwise(none))


def buckets_of(norm: Column) -> Column:
    """Keys under which a normalised line meets lines like it."""
    none = F.array().cast("array<bigint>")

    def found(w: Column) -> Column:
        blocks = F.flatten(F.transform(_levels(F.size(w)), lambda blocks: _block_buckets(w, blocks)))
        return F.concat(F.when(F.size(w) >= 3 * BLOCK_WORDS, blocks).otherwise(none), _whole_buckets(w, norm))

    words = _words_of(F.array_distinct(F.split(norm, " ")))
    return F.array_distinct(F.array_compact(bind(words, found)))


def bucket_rows(lines: DataFrame) -> DataFrame:
    """``key, size, bucket``: the rows of ``buckets_of`` for lines with ``key, size, norm``.

    The words of blocks are rows here, as a list of words costs far more to go through for each block. A SimHash takes sums
    of ``LANES`` longs with four counts of 16 bits in each. Lines of very many words are taken row by row.
    """
    # words are listed below a generator, whose output is computed once however often it is used
    listed = F.inline(F.array(F.struct(F.array_distinct(F.split("norm", " ")).alias("words"))))
    n = F.size("words")
    whole = lines.select("key", "size", "norm", listed).where((n < SHORT_WORDS) | (n > MOST_WORDS))
    many = F.array_distinct(F.array_compact(buckets_of(F.col("norm"))))
    few = F.array_distinct(F.array_compact(bind(_words_of(F.col("words")), lambda w: _whole_buckets(w, F.col("norm")))))
    whole = whole.select("key", "size", F.explode(F.when(n > MOST_WORDS, many).otherwise(few)).alias("bucket"))

    # all words of a line are in one task, so their groups need no shuffle
    words = lines.select("key", "size", "norm").repartition("key").select("key", "size", listed)
    words = words.where(n.between(3 * BLOCK_WORDS, MOST_WORDS))
    words = words.select("key", "size", _levels(n).alias("levels"), F.explode("words").alias("word"))
    words = words.select("key", "size", "levels", F.xxhash64("word").alias("h"), F.length("word").alias("n"))
    words = words.select("key", "size", F.explode("levels").alias("blocks"), "h", "n")
    ones = F.lit(sum(1 << 16 * i for i in range(4))).cast("long")
    lanes = [F.shiftrightunsigned("h", i).bitwiseAND(ones) for i in range(LANES)]
    blocks = words.groupBy("key", "size", "blocks", _group(F.col("h"), F.col("blocks")).alias("block")).agg(
        F.count("*").alias("m"), F.sum("n").alias("letters"), *(F.sum(c).alias(f"c{i}") for i, c in enumerate(lanes))
    )
    # a count over half the words has bit 14 set once this is added
    over = (F.lit(1 << 14).cast("long") - 1 - F.floor(F.col("m") / 2)) * ones
    digits = ones * ((1 << DIGITS) - 1)
    bits = [F.shiftrightunsigned(F.col(f"c{i}").bitwiseAND(digits) + over, 14).bitwiseAND(ones) for i in range(LANES)]
    print_ = reduce(Column.bitwiseOR, (F.shiftleft(b, i) for i, b in enumerate(bits)))
    blocks = blocks.where(F.col("letters") >= BLOCK_LETTERS)
    return blocks.select("key", "size", F.xxhash64("blocks", "block", print_).alias("bucket")).unionByName(whole)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, pos, norm`` of every line with a letter or digit."""
    # lines are normalised below the generator, whose output is computed once however often it is used
    lines = F.transform(F.split("text", "\n"), lambda line: normalised(line))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(lines).alias("pos", "norm"))
    return rows.where("norm != ''")


def texts_of(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, norm`` of some classes."""
    found = classes.join(keys, "key", "left_semi").select("key", "norm")
    return written(found.dropDuplicates(["key"]), "candidate-lines")


def _same_start(a: Column, b: Column) -> Column:
    """Length of a common start of two texts: all of it below two million characters."""
    size = F.least(F.length(a), F.length(b))

    def grown(at: Column, step: Column) -> Column:
        same = F.substr(a, at + 1, step) == F.substr(b, at + 1, step)
        return F.when((at + step <= size) & same, at + step).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), grown)


def edit_distance(a: Column, b: Column, most: Column) -> Column:
    """Levenshtein distance up to ``most``, else -1. What both texts start and end with never changes it and is
    taken off first, as the time goes with the length."""

    def rest(pair: Column) -> Column:
        def cut(at: Column) -> Column:
            return F.struct(
                F.reverse(F.substr(pair["a"], at + 1)).alias("a"), F.reverse(F.substr(pair["b"], at + 1)).alias("b")
            )

        return bind(_same_start(pair["a"], pair["b"]), cut)

    def measure(pair: Column) -> Column:
        # the time goes with the edits looked for, too, and alike texts have few
        few = F.call_function("levenshtein", pair["a"], pair["b"], F.floor(most / FEW_EDITS).cast("int"))
        all_ = F.call_function("levenshtein", pair["a"], pair["b"], most)
        return bind(few, lambda d: F.when(d >= 0, d).otherwise(all_))

    whole = F.struct(a.alias("a"), b.alias("b"))
    return bind(bind(bind(whole, rest), rest), measure)


def _verified(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``left, right`` of the pairs whose lines have the edit similarity; texts are read for candidates only."""
    pairs = written(pairs, "line-pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("left").alias("key")).unionByName(pairs.select(F.col("right").alias("key"))).distinct()
    texts = texts_of(small_side(written(wanted, "line-candidates")), classes)
    left = texts.select(F.col("key").alias("left"), F.col("norm").alias("a"))
    right = texts.select(F.col("key").alias("right"), F.col("norm").alias("b"))
    # pairs of long lines take far more time than others, so they are dealt to all tasks however few bytes they are
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(left, "left").join(right, "right").repartition(tasks, "left", "right")
    most = F.expr(_most("length(a)", "length(b)", similarity))
    return joined.where(edit_distance(F.col("a"), F.col("b"), most) >= 0).select("left", "right")


def _most(a: str, b: str, similarity: float) -> str:
    """SQL for the largest edit distance with which texts of these lengths have the similarity."""
    return f"cast(floor({1 - similarity!r}D * greatest({a}, {b}) + 1e-9D) as int)"


def _bucket_links(classes: DataFrame, similarity: float) -> DataFrame:
    """``left, right`` of the classes that are alike and meet in a bucket, each with the smallest class of it only."""
    rows = written(bucket_rows(classes), "line-bucket-rows")
    first = rows.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    first = written(first.select("bucket", "low"), "shared-buckets")
    # buckets of one class, nearly all of them, go here: by a filter of bounded size where that can tell
    blocks = blocks_for(first)
    if blocks:
        found = key_filter(first, ["bucket"], blocks)
        rows = with_maybe(rows, found, ["bucket"], blocks).where("_maybe").drop("_maybe")
    shared = rows.join(first, "bucket").groupBy("bucket", "low", "key").agg(F.min("size").alias("size"))
    shared = written(shared, "line-buckets")
    # texts whose lengths differ by more than the largest edit distance can't be similar
    near = F.expr(f"abs(size - other_size) <= {_most('size', 'other_size', similarity)}")
    tops = shared.where("key = low").select("bucket", F.col("size").alias("other_size"))
    stars = (
        shared.where("key != low")
        .join(tops, "bucket")
        .where(near)
        .select(F.col("low").alias("left"), F.col("key").alias("right"))
        .distinct()
    )
    stars = written(stars, "line-stars")
    return _verified(stars, classes, similarity)


def near_lines(classes: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of the line classes that are connected to others; ``classes`` has ``key, size, norm`` of each."""
    with scratch("line-links", "line-groups"):
        links = written(_bucket_links(classes, similarity), "line-links")
        groups = written(components(links), "line-groups")
    found = links.unionByName(_verified(all_alike(classes, groups, similarity), classes, similarity))
    return components(written(found, "all-line-links"))


def _grams(text: Column, q: int) -> Column:
    """16 bits of the hash of every gram, each once."""

    def of_piece(piece: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(piece) - q + 1)
        return F.transform(at, lambda i: F.xxhash64(F.substr(piece, i, F.lit(q))).bitwiseAND(0xFFFF))

    starts = F.sequence(F.lit(0), F.floor((F.length(text) - q) / STRETCH).cast("int"))
    pieces = F.transform(starts, lambda i: F.substr(text, i * STRETCH + 1, F.lit(STRETCH + q - 1)))
    hashes = F.flatten(F.transform(pieces, lambda piece: bind(piece, of_piece)))
    return F.array_distinct(F.transform(hashes, lambda h: (h - 0x8000).cast("short")))


def _bitmaps(lines: DataFrame, grams: Grams, similarity: float) -> DataFrame:
    """``key, size, part`` of every class that a pair of this length can have, the bits of its grams and their number."""
    q, words = grams.size, grams.words
    shortest = max(int(similarity / (1 - similarity) + 1e-9), int(grams.from_size * similarity), 1)
    lines = lines.where(F.col("size").between(shortest, grams.to_size))
    # a filled end gives short lines grams, too; stretches, so that no gram is looked for from the start of a long line
    filled = F.concat("norm", F.lit("\n" * (q - 1)))
    starts = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / STRETCH).cast("int"))
    pieces = lines.select("key", "size", "part", filled.alias("filled"), F.explode(starts).alias("at")).select(
        "key", "size", "part", F.substr("filled", F.col("at") * STRETCH + 1, F.lit(STRETCH + q - 1)).alias("piece")
    )
    places = pieces.select("*", F.explode(F.sequence(F.lit(1), F.length("piece") - q + 1)).alias("at"))
    hashed = places.select("key", "size", "part", F.xxhash64(F.substr("piece", F.col("at"), F.lit(q))).alias("h"))
    place = F.shiftrightunsigned("h", 32).bitwiseAND(63).cast("int")
    bits = hashed.select(
        "key",
        "size",
        "part",
        F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit"),
        F.col("h").bitwiseAND(words - 1).cast("int").alias("word"),
    )
    zero = F.lit(0).cast("long")
    names = [f"w{i}" for i in range(words)]
    maps = bits.groupBy("key", "size", "part").agg(
        *(F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(zero)).alias(w) for i, w in enumerate(names))
    )
    total = reduce(Column.__add__, map(F.bit_count, names))
    placed = maps.select("key", "size", "part", total.alias("bits"), *names)
    if not grams.set_size:
        return placed
    return placed.join(lines.select("key", _grams(F.col("norm"), grams.set_size).alias("set")), "key")


class Seeds(NamedTuple):
    """Cells of ``letters`` letters into which the longer line of a pair is cut, if it has ``from_size`` letters or more."""

    letters: int
    from_size: int


def _seeds(similarity: float) -> list[Seeds]:
    """Longest cells first. A line of ``from_size`` letters or more has more whole cells than edits allowed."""
    edits = 1 - similarity
    longest = min(MOST_CELL, math.ceil(1 / edits - 1e-6) - 1)
    return [Seeds(s, math.ceil(s / (1 - s * edits) - 1e-6)) for s in range(longest, LEAST_CELL - 1, -1)]


def _step(similarity: float) -> float:
    """Width of a band in the logarithm of the length: lines as long as the similarity allows are in the same or the next."""
    return -1.01 * math.log(similarity)


def _band(similarity: float) -> Column:
    return F.floor(F.log("size") / _step(similarity)).cast("int")


def _first_band(similarity: float) -> int:
    """The first band all of whose lines can be cut into cells."""
    return math.ceil(math.log(_seeds(similarity)[-1].from_size) / _step(similarity) - 1e-9)


def _without_nulls(df: DataFrame) -> DataFrame:
    """Columns that are known not to be null keep the test of a pair short."""
    none = {"array<smallint>": F.array().cast("array<smallint>"), "string": F.lit("")}
    return df.select(*(F.coalesce(c, none[t] if t in none else F.lit(0).cast(t)).alias(c) for c, t in df.dtypes))


def _wide(text: str) -> Column:
    """Two bytes for each letter of a text, so that none is looked for from the start; rare letters that take four are
    one sign here."""
    bytes_ = F.encode(text, "UTF-16BE")
    rare = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "\ufffd")
    return F.when(F.octet_length(bytes_) == 2 * F.length(text), bytes_).otherwise(F.encode(rare, "UTF-16BE"))


def _narrow(bytes_: str) -> str:
    """SQL for the text of bytes made by ``_wide``."""
    return f"decode({bytes_}, 'UTF-16BE')"


def _by_cells(lines: DataFrame, similarity: float) -> DataFrame:
    """``left, right`` of the classes that may have the edit similarity, where the shorter line is in a band of cells.

    The pieces of all lines are many times the lines, so they meet in passes, each of which takes some of the stretches
    and, where ``SHUFFLES_GO`` is set, has its shuffle removed before the next one.

    The longer line is cut into more cells than edits are allowed. Seen as a ring, they hold one from which on any
    number of cells has fewer edits than cells: so that cell stands in the other line as it is, moved by no more
    than the edits allow, with one edit at most in the cell after it and two in the next two. As many edits as cells are
    before it at least, so it is the last cell for lines only that have no more cells than needed: all edits are before it
    then, both lines end with it, and the first cell, which follows on the ring, has one edit at most.

    Cells meet the places of the other line that they can stand at by hash, and as one edit leaves one half of the cell
    that follows as it is, hashes of halves tell nearly all places by chance from others. Lines travel as pieces, one
    for each stretch of such places, and are cut where they meet.
    """
    step, seeds = _step(similarity), _seeds(similarity)
    least = "cast(ceil(exp(band * {0}D) - 1e-6D) as int)".format(step)
    letters = reduce(lambda rest, s: rest.when(F.expr(least) >= s.from_size, s.letters), seeds[1:], F.when(F.expr(least) >= seeds[0].from_size, seeds[0].letters))
    width = F.expr(f"cast(greatest({PIECE}, 2 * floor({1 - similarity!r}D * exp((band + 2) * {step}D) + 1)) as int)")
    lines = _without_nulls(lines).withColumn("band", _band(similarity)).where(F.col("band") >= _first_band(similarity))
    # the longer line, which has fewer cells than the other one has places, goes to both bands
    held = lines.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).where(F.col("band") >= _first_band(similarity))
    sizes = held.groupBy("band").agg(F.count("*").alias("rows"), F.sum("size").alias("letters"))
    sizes = sizes.select("*", letters.alias("s"), width.alias("width"))
    # cells of a line that meet in one place
    there = F.least(F.col("letters") / F.col("rows"), 1.75 * F.col("width")) / F.col("s")
    blocks = F.ceil(F.col("rows") * F.greatest(there / BLOCK_CELLS, F.lit(1.0)) / BLOCK_ROWS).cast("int")
    sizes = written(sizes.select("*", blocks.alias("blocks")), "line-bands")
    # cells take far more memory than the pieces they come from, so their number tells how many tasks share them
    dealt = F.sum(F.col("letters") * 2 * F.col("blocks"))
    cells, pieces, whole = sizes.agg(F.sum(F.col("letters") / F.col("s")), dealt, F.sum("letters")).first()
    if not cells:
        return lines.select(F.col("key").alias("left"), F.col("key").alias("right")).limit(0)
    passes = min(math.ceil(PASSES * pieces / whole), math.ceil(pieces / PASS_LETTERS))
    least_tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(math.ceil(cells / passes / TASK_CELLS), least_tasks)
    sizes = small_side(_without_nulls(sizes.drop("letters", "rows")))  # a row for each band

    def met(now: Column) -> DataFrame:
        return _cells_met(lines, held, sizes, similarity, tasks, now)

    if passes == 1:
        return met(F.lit(True))
    now = F.expr(f"pmod(band + 5 * bucket + 7 * block, {passes})")
    found = [written(met(now == i), "pairs-of-pass") for i in range(passes)]
    return reduce(DataFrame.unionByName, found).distinct()


def _cells_met(lines: DataFrame, held: DataFrame, sizes: DataFrame, similarity: float, tasks: int, now: Column) -> DataFrame:
    """One pass of ``_by_cells``: the pairs that meet at the places for which ``now`` is true."""
    # two keys of 32 bits are one long to the join
    place = F.hash("band", "block", "bucket").alias("place")
    # a cell has s letters; of the next one, the first half and what stays of the rest when one letter more or less is before it
    sizes = sizes.withColumn("half", F.expr("s div 2")).withColumn("rest", F.expr("s - half - 1"))
    # large bands are met in blocks, each of which has the cells of some hashes
    block = F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")
    own = F.expr("blocks = 1 or pmod(seed, blocks) = block")

    # the end of a line, which is followed by its start, is a piece of its own, -1
    held = held.join(sizes, "band").withColumn("cells", F.expr("cast(size div s as int)"))
    held = held.withColumn("edits", F.expr(_most("size", "0", similarity)))
    stretches = "sequence(if(cells = edits + 1, -1, 0), cast((size - s - half) div width as int))"
    held = held.select("*", F.explode(F.expr(stretches)).alias("bucket"))
    held = held.select("*", block).where(now)
    # cells that can stand in this stretch of the other line
    held = held.withColumn("cell", F.expr("cast(greatest(0, ceil((bucket * width - edits / 2) / s)) as int)"))
    last = "cast(least(edits, cells - 2, floor(((bucket + 1) * width - 1 + edits) / s)) as int)"
    held = held.withColumn("last", F.expr(f"if(bucket < 0, cell, {last})"))
    text = f"substr(norm, cell * s + 1, (last - cell + 1 + {AFTER}) * s)"
    held = held.where("cell <= last").select(
        place,
        F.col("key").alias("other_key"),
        F.col("size").alias("other_size"),
        F.col("part").alias("other_part"),
        "block",
        "blocks",
        "s",
        "half",
        "rest",
        "cell",
        "last",
        F.expr("if(bucket < 0, 1, cells - 1 - cell)").alias("follow"),
        F.expr("if(bucket < 0, size - s, cell * s)").alias("from"),
        F.expr(f"if(bucket < 0, concat(substr(norm, size - s + 1, s), substr(norm, 1, s)), {text})").alias("text"),
    )
    held = held.repartition(tasks, "place").withColumn("text", _wide("text"))
    held = held.select("*", F.explode(F.expr("sequence(0, last - cell)")).alias("at"))

    def cut(text: str, at: str, letters: str) -> str:
        return f"substr({text}, cast(2 * ({at}) + 1 as int), cast(2 * ({letters}) as int))"

    def half(text: str) -> str:
        return f"(hash({text}) & 65535L)"

    held = held.withColumn("seed", F.expr(f"hash({cut('text', 'at * s', 's')})")).where(own)
    rests = (f"shiftleft({half(cut('text', f'at * s + s + half + {i - 1}', 'rest'))}, {16 * (i + 1)})" for i in range(3))
    held = held.select(
        "place",
        "seed",
        "other_key",
        "other_size",
        "other_part",
        F.expr("from + at * s").alias("cell_at"),
        F.expr(" | ".join([half(cut("text", "at * s + s", "half")), *rests])).alias("halves"),
        F.expr(cut("text", "at * s + s", f"least({AFTER}, follow - at) * s")).alias("then"),
    )

    going = lines.join(sizes, "band")
    going = going.select("*", F.explode(F.expr("sequence(-1, cast((size - s - half) div width as int))")).alias("bucket"))
    going = going.select("*", block).where(now)
    end = f"concat(substr(norm, size - s + 1, s), substr(norm, 1, {AFTER} * s))"
    going = going.select(
        place,
        "key",
        "size",
        "part",
        "block",
        "blocks",
        F.expr("if(bucket < 0, size - s, bucket * width)").alias("first"),
        F.expr("if(bucket < 0, 1, cast(least(width, size - s - half - bucket * width + 1) as int))").alias("places"),
        F.col("s").alias("own_s"),
        "half",
        "rest",
        F.expr(f"if(bucket < 0, {end}, substr(norm, bucket * width + 1, width + {AFTER + 1} * s))").alias("piece"),
    )
    going = going.where("places > 0").repartition(tasks, "place").withColumn("piece", _wide("piece"))
    going = going.select("*", F.explode(F.expr("sequence(0, places - 1)")).alias("off"))
    going = going.withColumn("seed", F.expr(f"hash({cut('piece', 'off', 'own_s')})")).where(own)
    going = going.select(
        "place",
        "seed",
        "key",
        "size",
        "part",
        F.expr("first + off").alias("stands_at"),
        "own_s",
        F.expr(half(cut("piece", "off + own_s", "half"))).alias("next_half"),
        F.expr(half(cut("piece", "off + own_s + half", "rest"))).alias("next_rest"),
        F.expr(cut("piece", "off + own_s", f"{AFTER} * own_s")).alias("next"),
    )

    moved = "(stands_at - cell_at)"
    shifted = (f"(shiftrightunsigned(halves, {16 * (i + 1)}) & 65535L) = next_rest" for i in range(3))
    halves = " or ".join(["(halves & 65535L) = next_half", *shifted])
    # so many letters of both have twice the edits of their cells at most, as the last of them may be moved out
    cell = f"levenshtein({_narrow(cut('then', '0', 'own_s'))}, {_narrow(cut('next', '0', 'own_s'))}, 2) >= 0"
    size = "length(then)"
    cells = f"levenshtein({_narrow('then')}, {_narrow(f'substr(next, 1, {size})')}, cast({size} div own_s as int)) >= 0"
    met = going.join(held.hint("shuffle_hash"), ["place", "seed"]).where(
        "part != other_part and other_size >= size and (other_size > size or other_key > key)"
        f" and abs({moved}) + abs({moved} + other_size - size) <= {_most('other_size', '0', similarity)}"
        f" and ({halves}) and {cell} and {cells}"
    )
    return met.select(F.least("key", "other_key").alias("left"), F.greatest("key", "other_key").alias("right")).distinct()


def _by_bitmaps(lines: DataFrame, grams: Grams, similarity: float) -> DataFrame:
    """``left, right`` of the classes that may have the edit similarity, where the longer line has a length of ``grams``.

    An edit changes at most as many grams as a gram has letters, so two lines whose bitmaps of grams differ in more
    places are further apart. Every line meets all lines of about its length; a task holds ``BLOCK_ROWS`` lines of
    one side and the other side streams by.
    """
    most = _most("size", "other_size", similarity)
    maps = written(_bitmaps(lines, grams, similarity).withColumn("band", _band(similarity)), "line-grams")
    maps = _without_nulls(maps)
    sizes = maps.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = small_side(written(sizes, "line-bands"))
    names = [f"w{i}" for i in range(grams.words)]
    held = maps.join(sizes, "band").withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    own = [c for c in maps.columns if c != "band"]
    held = held.select("band", "block", *(F.col(c).alias(f"other_{c}") for c in own))
    going = maps.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    going = going.join(sizes, "band").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    common = reduce(Column.__add__, (F.bit_count(F.col(w).bitwiseAND(F.col(f"other_{w}"))) for w in names))
    near = F.expr(
        f"abs(size - other_size) <= {most} and {most} > 0"
        f" and greatest(size, other_size) between {grams.from_size} and {grams.to_size}"
    )
    once = (F.col("own") < F.col("band")) | (F.col("key") < F.col("other_key"))
    alike = F.greatest("bits", "other_bits") - common <= F.expr(f"{grams.size} * {most}")
    if grams.set_size:
        both = F.size(F.array_intersect("set", "other_set"))
        alike &= F.greatest(F.size("set"), F.size("other_set")) - both <= F.expr(f"{grams.set_size} * {most}")
    met = going.join(held.hint("shuffle_hash"), ["band", "block"])
    met = met.where((F.col("part") != F.col("other_part")) & near & once & alike)
    return met.select(F.least("key", "other_key").alias("left"), F.greatest("key", "other_key").alias("right"))


def all_alike(classes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``left, right`` of all classes that are not connected yet and may have the edit similarity; none that has it is
    left out.

    Lines that are long enough meet by cells, short ones (and all, where the similarity allows no cells that tell enough)
    by bitmaps.
    """
    if similarity >= 1:
        return groups.select(F.col("node").alias("left"), F.col("root").alias("right")).limit(0)
    lines = classes.select("key", "size", "norm").where(F.col("size") >= int(similarity / (1 - similarity) + 1e-9))
    lines = lines.join(small_side(groups).withColumnRenamed("node", "key"), "key", "left")
    lines = written(lines.select("key", "size", F.coalesce("root", "key").alias("part"), "norm"), "line-texts")
    if not _seeds(similarity):
        found = [_by_bitmaps(lines, grams, similarity) for grams in GRAMS]
        return reduce(DataFrame.unionByName, found)
    # the longest line whose band or the one before has no cells
    to_size = math.ceil(math.exp((_first_band(similarity) + 1) * _step(similarity)))
    short = written(_by_bitmaps(lines, Grams(SHORT.size, SHORT.words, 0, to_size), similarity), "short-pairs")
    # pieces that are dealt out by place stay there when they are cut
    with setting(lines.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return short.unionByName(written(_by_cells(lines, similarity), "long-pairs"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, and ``n_lines, n_removed``.

    Lines are linked if their normalised forms are equal or have an edit similarity of at least ``similarity``; no link is
    left out, for which lines meet by short cells, so a small part of the work grows with the square of the number
    of different lines. Of a connected group the line in the smallest document id stays (then by text hash, then the earliest). Lines without letters and digits stay.
    Null texts stay null with 0 lines, empty texts have one line; a text may lose all its lines and is then
    empty; rows that are equal in id and text are one document and share what happens to it. Rows with a null
    id come first in order. An empty table gives an empty table. Other columns are carried along; the names
    ``n_lines`` and ``n_removed`` are replaced.
    """
    lines = lines_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    hashes = F.xxhash64("norm").alias("key"), F.xxhash64(F.lit(1), "norm").alias("check")
    occurrences = written(lines.select("doc_id", "text_key", "pos", *hashes), "lines")
    place = F.struct("doc_id", "text_key", "pos")
    with scratch("repeated-lines"), setting(docs.sparkSession, SHUFFLES_GO, "true"):
        classes = lines.select("*", *hashes).groupBy("key", "check")
        classes = classes.agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("norm").alias("norm"))
        classes = written(classes.withColumn("size", F.length("norm")), "line-classes")
        groups = near_lines(classes, similarity)
        # only classes with several occurrences or links can lose any
        linked = classes.join(groups, classes["key"] == groups["node"], "left").select(
            "key",
            "check",
            "first",
            "last",
            F.coalesce("root", "key").alias("root"),
            F.col("root").isNotNull().alias("_linked"),
        )
        linked = written(linked.where(F.col("_linked") | (F.col("first") < F.col("last"))), "repeated-lines")
    kept = linked.groupBy("root").agg(F.min("first").alias("kept"))
    keep = linked.join(kept, "root").select("key", "check", "kept")
    gone = (
        occurrences.select("key", "check", "doc_id", "text_key", "pos")
        .join(keep, ["key", "check"])
        .where(F.struct("doc_id", "text_key", "pos") != F.col("kept"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("pos").alias("_gone"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_gone")
    )
    # the document's own columns travel in one struct, so that no name of theirs meets a name used here
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash"))
    joined = rows.join(gone, (F.col("_hash") == F.col("_key")) & (F.col("_id") == F.col("_doc")), "left")
    joined = joined.select("_row", "_gone", F.split("_row.text", "\n").alias("_lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(left)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *(text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in own),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
    )
