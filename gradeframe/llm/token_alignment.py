"""Alignment of the tokens that two tokenizers give the same text, by skipping along diagonals.

Both encodings are kept as arrays of byte ends. From a common end on, exponentially growing slices of both arrays
are compared at the current shift between their indexes, which jumps whole stretches of tokens that stand one to
one; where a slice differs, halving finds the first difference. The tokens there are walked to the next common
end, and the shift follows. Tokens of either side never cross a single space between two words, so what is known of
a word from an earlier text is kept, and only the other words of a text are encoded and aligned. How often tokens are
linked over the whole corpus is then counted, and every document's links are valued by these counts.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gradeframe.llm import bpe_tree
from gradeframe.llm.storage import written

#: A pair with at least this share of all links is looked up in a broadcast table, which so has at most as many rows.
HOT_SHARE = 200_000
LINKS_PER_BATCH = 500_000
FIRST_STEPS = 8
LONG_RUN = 1000
LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)
#: Words that a worker keeps, in two halves, and the letters of the longest one.
KEPT_WORDS = 80_000
KEPT_LETTERS = 48
#: A space that has no more white space beside it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: White space beside a space.
WIDE = re.compile(r" \s|[^\S ] ")

_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "a array<int>, b array<int>, n array<int>"


def has_long_run(text: str) -> bool:
    """Whether ``text`` holds ``LONG_RUN`` characters without white space, or of white space, in a row."""
    if len(text) < LONG_RUN:
        return False
    return max(map(len, text.split()), default=0) >= LONG_RUN or LONG_SPACE.search(text) is not None


def first_difference(x: list, y: list, i: int, j: int) -> int:
    """How many elements of ``x`` from ``i`` on equal those of ``y`` from ``j`` on: slices are doubled, then halved."""
    most = min(len(x) - i, len(y) - j)
    same, step = 0, 1
    while same < most:
        step = min(step, most - same)
        if x[i + same : i + same + step] == y[j + same : j + same + step]:
            same += step
            step *= 2
            continue
        while step > 1:
            half = step // 2
            if x[i + same : i + same + half] == y[j + same : j + same + half]:
                same += half
                step -= half
            else:
                step = half
        break
    return same


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """Stretches and irregular groups as ``i, i_end, j, j_end`` in order, and the indexes of all linked tokens.

    The tokens of a stretch stand one to one, so its first ends are equal. An irregular group has no common end but
    its last. Both arrays rise strictly and end alike.
    """
    bounds, left, right = [], [], []
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while i < n:
        x, y = i, j
        # short stretches are stepped through, longer ones are jumped
        stop = min(x + FIRST_STEPS, n, x + m - y)
        while x < stop and ends_a[x] == ends_b[y]:
            x += 1
            y += 1
        if x - i == FIRST_STEPS:
            same = first_difference(ends_a, ends_b, x, y)
            x += same
            y += same
        if x > i:
            bounds.append((i, x, j, y))
            left += range(i, x)
            right += range(j, y)
            i, j = x, y
            if i == n:
                break
        p, q = ends_a[x], ends_b[y]
        while p != q:
            left.append(x)
            right.append(y)
            if p < q:
                x += 1
                p = ends_a[x]
            else:
                y += 1
                q = ends_b[y]
        left.append(x)
        right.append(y)
        bounds.append((i, x + 1, j, y + 1))
        i, j = x + 1, y + 1
    return bounds, left, right


#: What the tokens of a word and the space before it add to a text's digest: its groups as they are written, its links
#: as bytes, and the numbers of its tokens on both sides and of its groups.
Word = tuple[str, bytes, int, int, int]


class Sides:
    """Both tokenizers, as ids and byte ends of a text."""

    def __init__(self, json_file: str, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a = bpe_tree.Encoder(json_file)
        self.fast = self._as_ranks()
        self.b = SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b""] * (1 + max(self.a.bytes_of))
        for number, data in self.a.bytes_of.items():
            self.bytes_a[number] = data
        # pieces start at spaces or hold none, and merges by rank (whole scores) go on alike on both sides of a space
        pieces = range(self.b.get_piece_size())
        self.by_words = all("▁" not in self.b.id_to_piece(n).lstrip("▁") for n in pieces) and all(
            self.b.get_score(n).is_integer() for n in pieces
        )
        self.used: dict[str, Word] = {}
        self.before: dict[str, Word] = {}
        self.bytes_b = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            is_byte = self.b.is_byte(number)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode("utf-8"))
        self.sizes_a = np.array([len(data) for data in self.bytes_a])
        self.sizes_b = np.array([len(data) for data in self.bytes_b])
        self.names_a = list(map(str, range(len(self.bytes_a))))
        self.names_b = list(map(str, range(len(self.bytes_b))))
    def _as_ranks(self):
        """A compiled encoder with the same merges, where the ids of merged tokens rise as their merges do."""
        from tiktoken import Encoding

        merged = [number for _, number in sorted(self.a.rank.values())]
        if merged != sorted(merged):
            return None
        special = set(self.a.added.values())
        ranks = {data: number for number, data in self.a.bytes_of.items() if number not in special}
        return Encoding("merges", pat_str=bpe_tree.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def byte_level(self, text: str) -> np.ndarray:
        # the compiled encoder takes the square of a long unsplit run, the other one does not
        if self.fast is None or has_long_run(text):
            return np.array(self.a.plain(text), np.int32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where the text is empty or a side does not give back its bytes."""
        none = np.empty(0, np.int32)
        if not text:
            return none, none
        whole = " " + text
        a, b = self.byte_level(whole), np.array(self.b.encode(text, num_threads=1), np.int32)
        data = whole.encode("utf-8", "surrogatepass")
        if self.sizes_a[a].sum() != len(data) or self.sizes_b[b].sum() != len(data):
            return none, none
        # pieces are the text cut up, with spaces for the sign of a space
        if "▁" in text and b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return none, none
        return a, b

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        return np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist()

    def spans(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """All groups of a text as ``i, i_end, j, j_end``; those of a stretch one by one."""
        a, b = self.encode(text)
        ends_a, ends_b = self.ends(a, b)
        out = []
        for i, i_end, j, j_end in align(ends_a, ends_b)[0]:
            if ends_a[i] == ends_b[j]:
                out += [(i + k, i + k + 1, j + k, j + k + 1) for k in range(i_end - i)]
            else:
                out.append((i, i_end, j, j_end))
        return out

    def _groups(self, a: np.ndarray, b: np.ndarray) -> tuple[list[str], list[int], list[int], list[int]]:
        """The groups of a text as they are written, their byte ends, and the indexes of all linked tokens."""
        ends_a, ends_b = self.ends(a, b)
        bounds, left, right = align(ends_a, ends_b)
        ids_a, ids_b = a.tolist(), b.tolist()
        names_a, names_b = self.names_a, self.names_b
        said, cuts = [], []
        for i, i_end, j, j_end in bounds:
            if ends_a[i] == ends_b[j]:
                said += [names_a[x] + "|" + names_b[y] for x, y in zip(ids_a[i:i_end], ids_b[j:j_end])]
                cuts += ends_a[i:i_end]
            else:
                left_names = ",".join(map(names_a.__getitem__, ids_a[i:i_end]))
                said.append(f"{left_names}|{','.join(map(names_b.__getitem__, ids_b[j:j_end]))}")
                cuts.append(ends_a[i_end - 1])
        return said, cuts, left, right

    def _words(self, words: list[str]) -> list[Word] | None:
        """What is to be known of some words, aligned as one text; none where a side does not give back its bytes."""
        a, b = self.encode(" ".join(words))
        if not len(a):
            return None
        said, cuts, left, right = self._groups(a, b)
        left = np.array(left)
        data = (a[left].astype(np.int64) << 32 | b[right]).tobytes()
        ends = np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in words])
        to_a = 1 + np.searchsorted(np.cumsum(self.sizes_a[a]), ends)
        to_b = 1 + np.searchsorted(np.cumsum(self.sizes_b[b]), ends)
        to_link = 8 * np.searchsorted(left, to_a)
        to_group = 1 + np.searchsorted(np.array(cuts), ends)
        out, x, g = [], 0, 0
        sizes = (np.diff(to, prepend=0).tolist() for to in (to_a, to_b, to_group))
        for n_a, n_b, n_groups, x_end in zip(*sizes, to_link.tolist()):
            out.append((";".join(said[g : g + n_groups]), data[x:x_end], n_a, n_b, n_groups))
            x, g = x_end, g + n_groups
        return out

    def _known(self, words: list[str]) -> list[Word] | None:
        """All words of a text in order. Those that are met stay when there are too many."""
        used, before = self.used, self.before
        known = list(map(used.get, words))
        places = [at for at, word in enumerate(known) if word is None]
        missing = []
        for word in dict.fromkeys([words[at] for at in places]):
            if word in before:
                used[word] = before[word]
            else:
                missing.append(word)
        new = {}
        if missing:
            found = self._words(missing)
            if found is None:
                return None
            new = dict(zip(missing, found))
            used.update(new if max(map(len, missing)) <= KEPT_LETTERS else {w: x for w, x in new.items() if len(w) <= KEPT_LETTERS})
        for at in places:
            word = words[at]
            known[at] = used.get(word) or new[word]
        if len(used) >= KEPT_WORDS // 2:
            self.used, self.before = {}, used
        return known

    def digest(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """Numbers of tokens and groups, the hash of the written groups, and all links, each as one number."""
        none = 0, 0, 0, "", np.empty(0, np.int64)
        if not text:
            return none
        if not self.by_words or "▁" in text or text != text.strip():
            a, b = self.encode(text)
            if not len(a):
                return none
            said, _, left, right = self._groups(a, b)
            written_out = hashlib.sha256(";".join(said).encode()).hexdigest()
            return len(a), len(b), len(said), written_out, a[left].astype(np.int64) << 32 | b[right]
        words = self._known(text.split(" ") if WIDE.search(text) is None else BETWEEN.split(text))
        if words is None:
            return none
        said, links, n_a, n_b, n_groups = zip(*words)
        written_out = hashlib.sha256(";".join(said).encode()).hexdigest()
        return sum(n_a), sum(n_b), sum(n_groups), written_out, np.frombuffer(b"".join(links), np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and times of the pairs of all rows, and the row of each."""
    a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
    sizes = np.diff(batch.column("a").offsets.to_numpy())
    return a.astype(np.int64), b.astype(np.int64), n.astype(np.int64), np.repeat(np.arange(batch.num_rows), sizes)


def _like(df: DataFrame, more: str) -> StructType:
    extra = df.sparkSession.createDataFrame([], more).schema
    return StructType([StructField(f.name, f.dataType) for f in df.schema] + list(extra))


class TokenAligner:
    """Alignment jobs for two vocabularies, whose files (a few megabytes) are read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, byte_level_json: str, piece_model: str):
        with open(byte_level_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
            shared = spark.sparkContext.broadcast({"files": (a.read(), b.read())})

        def sides() -> Sides:
            held = shared.value
            if "sides" not in held:  # the broadcast value lives as long as a worker
                held["sides"] = Sides(*held["files"])
            return held["sides"]

        self._sides = sides

    def with_groups(self, docs: DataFrame, text: str = "text", out: str = "groups") -> DataFrame:
        """All columns of ``docs`` and the groups of its text: the places of their tokens on both sides.

        Null and empty texts, and texts that a side does not give back, have none. A column named like
        ``out`` is replaced.
        """
        sides = self._sides
        names = ["first_a", "end_a", "first_b", "end_b"]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([(name, pa.int32()) for name in names]))
            for batch in batches:
                found = [[dict(zip(names, g)) for g in sides().spans(t)] for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "_g"])

        rows = docs.drop(out).select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
        span = ", ".join(f"{name}: int" for name in names)
        found = rows.mapInArrow(add, _like(rows, f"_g array<struct<{span}>>"))
        return found.select("_row.*", F.col("_g").alias(out))

    def links(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """One row per row of ``docs``: a number for it, its columns but the text in ``row``, counts, the hash of its
        groups, and its distinct linked id pairs with how often each is linked."""
        sides = self._sides

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                start, counts, pairs, held = 0, [], [], 0
                for at, value in enumerate(batch.column("_text")):
                    n_a, n_b, n_groups, sha, linked = sides().digest(value.as_py())
                    known, n = np.unique(linked, return_counts=True)
                    counts.append((n_a, n_b, n_groups, len(linked), sha))
                    pairs.append((known >> 32, known & 0xFFFFFFFF, n))
                    held += len(known)
                    if held >= LINKS_PER_BATCH or at + 1 == batch.num_rows:
                        columns = [pa.array(c) for c in zip(*counts)]
                        columns += [_lists([x.astype(np.int32) for x in side]) for side in zip(*pairs)]
                        own = batch.slice(start, len(counts)).select(["row"])
                        yield pa.RecordBatch.from_arrays(
                            [*own.columns, *columns],
                            ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"],
                        )
                        start, counts, pairs, held = at + 1, [], [], 0

        kept = [c for c in docs.columns if c != text]
        own = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
        rows = docs.select(own.alias("row"), F.col(text).alias("_text"))
        found = rows.mapInArrow(align, _like(rows.drop("_text"), f"{_COUNTS}, {_PAIRS}"))
        return found.withColumn("number", F.monotonically_increasing_id())

    def valued(self, docs: DataFrame, text: str = "text", hot_share: int = HOT_SHARE) -> DataFrame:
        """All columns of ``docs`` but the text, and ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

        ``n_best`` counts the links whose id pair is linked most often in the corpus of all pairs of that B id, ties
        included; ``count_sum`` adds the corpus counts of all links. Repeated rows count as often as they occur; rows
        without tokens have zeros and an empty hash; an empty table gives an empty table. Own columns with the names
        of the result are replaced.
        """
        ours = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        docs = docs.drop(*ours)
        spark = docs.sparkSession
        links = written(self.links(docs, text), "token-links")
        pairs = written(pair_counts(links), "token-pairs")
        total = pairs.agg(F.sum("n")).first()[0] or 0
        # every pair counted here holds at least 1 / hot_share of all links, so there are at most hot_share of them
        hot = pairs.where(F.col("n") * hot_share >= total)
        scored = written(_hot_scores(spark, links, hot), "token-scores")
        rare = scored.select("number", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("number", "x.*")
        known = pairs.where(F.col("n") * hot_share < total).withColumnRenamed("n", "times")
        sums = rare.join(known, ["a", "b"]).groupBy("number").agg(
            F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(F.lit(0).cast("long"))).alias("more_best"),
            F.sum(F.col("n") * F.col("times")).alias("more_sum"),
        )
        zero = F.lit(0).cast("long")
        whole = scored.drop("a", "b", "n").join(sums, "number", "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("more_best", zero),
                "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero),
            }
        )
        kept = [c for c in docs.columns if c != text]
        return whole.select(*(F.col("row")[c].alias(c) for c in kept), *ours)


def pair_counts(links: DataFrame) -> DataFrame:
    """``a, b, n, best``: linked id pairs, their links over all rows, and whether no pair of that ``b`` has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0

        def summed():
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            return known, np.bincount(at, np.concatenate(times)).astype(np.int64)

        def out():
            known, n = summed()
            for at in range(0, len(known), 100_000):
                part, m = known[at : at + 100_000], n[at : at + 100_000]
                ids = [pa.array((part >> 32).astype(np.int32)), pa.array((part & 0xFFFFFFFF).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(m)], ["a", "b", "n"])

        for batch in batches:
            a, b, n, _ = _flat(batch)
            keys.append(a << 32 | b)
            times.append(n)
            held += len(a)
            if held >= 4_000_000:
                known, n = summed()
                keys, times, held = [known], [n], len(known)
                if held >= 2_000_000:
                    yield from out()
                    keys, times, held = [], [], 0
        if keys:
            yield from out()

    found = links.select("a", "b", "n").mapInArrow(count, "a int, b int, n long")
    counted = found.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy("b"))
    return counted.withColumn("best", F.col("n") == most)


def _hot_scores(spark: SparkSession, links: DataFrame, hot: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` of each row's links among the ``hot`` pairs, and the rest of its pairs."""
    table = hot.toArrow()
    key = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast(
        (key[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order].astype(np.int64))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            a, b, n, row = _flat(batch)
            wanted = a << 32 | b
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for total, value in zip(sums, (best, counts)):
                np.add.at(total, row[hit], n[hit] * value[at[hit]])
            starts = np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))[:-1]
            rest = [_lists(np.split(x[~hit].astype(np.int32), starts)) if batch.num_rows else _lists([]) for x in (a, b, n)]
            own = [c for c in batch.schema.names if c not in ("a", "b", "n")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *map(pa.array, sums), *rest],
                [*own, "n_best", "count_sum", "a", "b", "n"],
            )

    scored = links.drop("a", "b", "n")
    return links.mapInArrow(score, _like(scored, f"n_best long, count_sum long, {_PAIRS}"))
