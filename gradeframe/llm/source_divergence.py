"""How far the sources of a language differ in their terms, by single-pass in-memory indexing.

Every task builds postings (term, source, count, documents) of the texts it reads until a bound on memory is
reached, then writes them as a run sorted by term and starts anew. Runs are cut by hash shard of the term; a shard's
pieces, read in order of their first term, are merged through a heap that opens a piece only when its first
term is due. The merged frequencies are streamed once for the divergence of pairs: what terms that two
sources both lack add is a product, and only terms that occur add corrections to it.
"""

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.storage import written

# Fixed value: a term, over the bytes of UTF-8 text.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK_POSTINGS = 600_000
BLOCK_BYTES = 32 << 20
PIECE_TERMS = 4_096
PAIR_BLOCK = 512
#: A posting is one number: occurrences below, documents above this bit. Both are far smaller in a block.
DOC_BIT = 40
#: Pairs of sources are worked out together while a batch has at most this many cells.
DENSE_CELLS = 1 << 24

PIECES = (
    "shard int, lang string, first string, terms array<string>, sizes array<int>, which array<int>,"
    " postings array<long>, names array<string>"
)
FREQUENCIES = "lang string, term string, n_docs long, sources array<string>, counts array<long>"


class Block:
    """Postings in memory, up to a bound."""

    def __init__(self, shards: int, postings: int = BLOCK_POSTINGS, size: int = BLOCK_BYTES):
        self.shards, self.postings, self.size = shards, postings, size
        self._empty()

    def _empty(self) -> None:
        self.groups: dict[str, dict[str, dict[bytes, int]]] = {}
        self.held = self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        """A document; the empty term counts documents."""
        # bytes.lower() changes A-Z alone
        found = Counter(TERM.findall(text.lower()))
        group = self.groups.setdefault(lang, {}).setdefault(source, {})
        before, one = len(group), 1 << DOC_BIT
        group[b""] = group.get(b"", 0) + one
        for term, count in found.items():
            held = group.get(term)
            if held is None:
                self.bytes += len(term)
                group[term] = count + one
            else:
                group[term] = held + count + one
        self.held += len(group) - before

    @property
    def full(self) -> bool:
        return self.held >= self.postings or self.bytes >= self.size

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block as a run: for each shard and language its terms in order, with their postings."""
        groups = self.groups
        self._empty()
        for lang, sources in groups.items():
            names = list(sources)
            whole: dict[bytes, list[int]] = {}
            for number, name in enumerate(names):
                for term, posting in sources[name].items():
                    held = whole.get(term)
                    if held is None:
                        whole[term] = [number, posting]
                    else:
                        held += (number, posting)
            shards: dict[int, list[bytes]] = {}
            for term in sorted(whole):
                shards.setdefault(zlib.crc32(term) % self.shards, []).append(term)
            pieces = [
                (shard, terms[at : at + PIECE_TERMS])
                for shard, terms in shards.items()
                for at in range(0, len(terms), PIECE_TERMS)
            ]
            for at in range(0, len(pieces), 64):
                yield _pieces(lang, names, pieces[at : at + 64], whole)


def _list(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _pieces(lang: str, names: list[str], pieces: list, whole: dict[bytes, list[int]]) -> pa.RecordBatch:
    terms = [term for _, some in pieces for term in some]
    flat = [whole[term] for term in terms]
    sizes = [len(x) // 2 for x in flat]
    both = np.array(list(chain.from_iterable(flat)), np.int64).reshape(-1, 2)
    n_terms = [len(some) for _, some in pieces]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *n_terms])]
    n_postings = np.diff(ends).tolist()
    columns = [
        pa.array([shard for shard, _ in pieces], pa.int32()),
        pa.array([lang] * len(pieces), pa.string()),
        pa.array([some[0] for _, some in pieces], pa.string()),
        _list(terms, n_terms, pa.string()),
        _list(sizes, n_terms, pa.int32()),
        _list(both[:, 0].astype(np.int32), n_postings, pa.int32()),
        _list(both[:, 1], n_postings, pa.int64()),
        _list(names * len(pieces), [len(names)] * len(pieces), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "first", "terms", "sizes", "which", "postings", "names"])


class Piece:
    """Terms of a run in order, with the places and document counts of their postings."""

    def __init__(self, terms: list[str], sizes, which, postings, names: list[str]):
        self.terms, self.names, self.which = terms, names, which
        self.counts, docs = postings & ((1 << DOC_BIT) - 1), postings >> DOC_BIT
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.docs = np.add.reduceat(docs, self.starts[:-1]).tolist() if len(docs) else []


def merged(pieces: Iterator[tuple], min_docs: int) -> Iterator[tuple]:
    """Frequencies of terms from pieces ``(shard, lang, first term, piece)`` in order of these.

    A piece is opened when the heap has nothing before its first term, so at most one piece of each run is held.
    The empty term, whose documents are all of a source's, is always kept.
    """
    heap: list[tuple[str, int, int, Piece]] = []
    place, term, docs, held = None, None, 0, []

    def closed() -> Iterator[tuple]:
        if term is not None and (docs >= min_docs or term == ""):
            sources: dict[str, int] = {}
            for piece, at in held:
                for i in range(piece.starts[at], piece.starts[at + 1]):
                    name = piece.names[piece.which[i]]
                    sources[name] = sources.get(name, 0) + int(piece.counts[i])
            yield place[1], term, docs, list(sources), list(sources.values())

    for number, (shard, lang, first, piece) in enumerate(chain(pieces, [(None, None, None, None)])):
        here = shard, lang
        while heap and (place != here or heap[0][0] < first):
            found, owner, at, top = heap[0]
            if found != term:
                yield from closed()
                term, docs, held = found, 0, []
            docs += top.docs[at]
            held.append((top, at))
            if at + 1 < len(top.terms):
                heapq.heapreplace(heap, (top.terms[at + 1], owner, at + 1, top))
            else:
                heapq.heappop(heap)
        if place != here:
            yield from closed()
            place, term, docs, held = here, None, 0, []
        if piece is not None:
            heapq.heappush(heap, (first, number, 0, piece))


def frequencies(
    docs: DataFrame, min_docs: int = MIN_DOCS, postings: int = BLOCK_POSTINGS, shards: int | None = None
) -> DataFrame:
    """``lang, term, n_docs, sources, counts`` of the terms in at least ``min_docs`` rows of a language.

    The empty term lists all sources of a language with counts of zero. Null texts, languages and sources count
    as empty ones. A term's row holds one entry per source of its language.
    """
    spark = docs.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shards, postings)
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text")):
                block.add(lang, source, text.as_py())
                if block.full:
                    yield from block.run()
        yield from block.run()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for i in range(batch.num_rows):
                    shard, lang, first, *lists = (batch.column(c)[i] for c in range(batch.num_columns))
                    terms, sizes, which, found, names = (x.values for x in lists)
                    numbers = (x.to_numpy(zero_copy_only=False) for x in (sizes, which, found))
                    yield shard.as_py(), lang.as_py(), first.as_py(), Piece(terms.to_pylist(), *numbers, names.to_pylist())

        def rows(some: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*some), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "term", "n_docs", "sources", "counts"])

        found = merged(pieces(), min_docs)
        while some := list(islice(found, 2_048)):
            yield rows(some)

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = docs.select(*read).withColumn("text", F.col("text").cast("binary"))
    runs = texts.mapInArrow(index, PIECES)
    dealt = runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(merge, FREQUENCIES)


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (n + 2 v)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", top, (n + 2 * v).cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p, q):
    return (p - q) * (p - q) // (p + q)


def _both(p, q, p_none, q_none):
    """What a term of both sources adds beyond what it adds as a term of either."""
    return _distance(p, q) - _distance(p, q_none) - _distance(p_none, q) + _distance(p_none, q_none)


def _dense(ids: list[np.ndarray], ps: list[np.ndarray], nones: list[np.ndarray]) -> tuple:
    """Sums of a batch over all pairs of its sources, from a table of terms and sources."""
    flat, of = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    names, at = np.unique(flat, return_inverse=True)
    none = np.zeros(len(names), np.int64)
    none[at] = np.concatenate(nones)
    share, there = np.ones((len(ids), len(names)), np.int64), np.zeros((len(ids), len(names)), bool)
    share[of, at], there[of, at] = np.concatenate(ps), True
    left, right, sums = [], [], []
    for i in range(len(names) - 1):
        own = there[:, i]
        value = _both(share[own, i : i + 1], share[own, i + 1 :], none[i], none[i + 1 :])
        left.append(np.full(len(names) - i - 1, names[i]))
        right.append(names[i + 1 :])
        sums.append(np.where(there[own, i + 1 :], value, 0).sum(axis=0))
    return np.concatenate(left), np.concatenate(right), np.concatenate(sums)


def _sparse(ids: np.ndarray, p: np.ndarray, none: np.ndarray) -> Iterator[tuple]:
    """Values of one term for the pairs of its sources, block by block."""
    order = np.argsort(ids)
    ids, p, none = ids[order], p[order], none[order]
    for low in range(0, len(ids), PAIR_BLOCK):
        for high in range(low, len(ids), PAIR_BLOCK):
            i, j = np.meshgrid(
                np.arange(low, min(low + PAIR_BLOCK, len(ids))),
                np.arange(high, min(high + PAIR_BLOCK, len(ids))),
                indexing="ij",
            )
            i, j = i[i < j], j[i < j]
            yield ids[i], ids[j], _both(p[i], p[j], none[i], none[j])


def _frame(lang: str, parts: list[tuple]) -> pd.DataFrame:
    a, b, value = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"lang": lang, "a": a, "b": b, "value": value})


def _corrections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What terms add to pairs of sources that both have them, beyond what each adds alone."""
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            lists = [rows[c].tolist() for c in ("ids", "ps", "nones")]
            width = len(np.unique(np.concatenate(lists[0])))
            pairs = sum(len(x) ** 2 for x in lists[0])
            # a table of terms and sources where it is mostly filled, each term's own pairs where it is not
            if width * len(rows) <= DENSE_CELLS and width * width * len(rows) <= 16 * pairs:
                found = [_dense(*lists)]
            else:
                found = (part for term in zip(*lists) for part in _sparse(*term))
            held: list[tuple] = []
            for part in found:
                held.append(part)
                if sum(len(a) for a, _, _ in held[-64:]) >= 200_000 or len(held) >= 4_096:
                    yield _frame(lang, held)
                    held = []
            if held:
                yield _frame(lang, held)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and terms above the language's share.

    Every row of ``docs`` is a document, repeated ones too. A null language, source or text is an empty one. Ties in
    value go to the smaller item in UTF-8 order. A source without terms takes part with counts of zero; a language
    without kept terms has distances of zero and no terms; an empty table gives an empty result. Columns other
    than ``text, lang, source`` are not read.
    """
    frequent = written(frequencies(docs, min_docs), "term-frequencies")
    postings = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    counts = frequent.where("term <> ''").select("lang", "term", postings).select("lang", "term", "x.*")
    counts = counts.withColumnsRenamed({"sources": "source", "counts": "count"}).where("count > 0")

    terms = frequent.where("term <> ''").withColumn("all", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_all"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    named = frequent.where("term = ''").select("lang", F.explode("sources").alias("source"))
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_all"])
    # sources are numbered within their language; the result has a row for every two of them
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    none = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v")))
    groups = written(groups.withColumns({"id": number, "none": none}), "term-groups")

    shares = counts.join(groups, ["lang", "source"])
    shares = shares.withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))

    # the distance of two sources: all terms as if both lacked them, then what each one's own terms change,
    # then what terms of both change beyond that
    other = groups.select("lang", F.col("id").alias("b"), F.col("none").alias("other"))
    pairs = groups.select("lang", F.col("id").alias("a"), "none", "v").join(other, "lang").where("a < b")
    neither = F.coalesce(F.col("v") * _apart(F.col("none"), F.col("other")), F.lit(0)).alias("value")
    own = shares.groupBy("lang", "id", "p", "none").agg(F.count("*").alias("times"))
    own = own.join(other, "lang").where("id <> b").groupBy("lang", "id", "b").agg(
        F.sum(
            F.col("times") * (_apart(F.col("p"), F.col("other")) - _apart(F.col("none"), F.col("other")))
        ).alias("value")
    )
    found = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "none")).alias("x"))
    found = found.where(F.size("x") > 1).select(
        "lang", F.col("x.id").alias("ids"), F.col("x.p").alias("ps"), F.col("x.none").alias("nones")
    )
    both = found.mapInPandas(_corrections, "lang string, a long, b long, value long")
    distances = (
        pairs.select("lang", "a", "b", neither)
        .unionByName(own.select("lang", F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "value"))
        .unionByName(both)
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    ways = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to"))))
    names = groups.select("lang", "id", "source")
    distances = (
        distances.select("lang", ways.alias("w"), "value")
        .select("lang", "w.id", "w.to", "value")
        .join(names, ["lang", "id"])
        .join(names.select("lang", F.col("id").alias("to"), F.col("source").alias("item")), ["lang", "to"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    distances = distances.withColumn("rank", rank)

    whole = terms.select("lang", "term", "all")
    marked = shares.join(whole, ["lang", "term"]).withColumn("q", _share(F.col("all"), F.col("n_all"), F.col("v")))
    marked = marked.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")
    )
    marked = marked.withColumn("rank", rank).where(F.col("rank") <= top)
    return distances.unionByName(marked).withColumn("rank", F.col("rank").cast("int"))
