"""Duplicate passages by content-defined blocks and a hash join of windows, in place of relative Lempel-Ziv parsing.

No longest match is searched and no text is parsed greedily: a parse of every document against every
reference block would cost the square of the corpus. The corpus, in the order of document ids, is cut into
blocks at content-defined borders: all windows of consecutive words that share their smallest word-run
hash (the seed) form one block. Blocks are indexed by seed and content, each with the first document that has
it, and whole blocks are joined by hash. Where a block shares its seed with other blocks but not its
whole content, the single windows are looked up, so that windows across block borders are found too.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.storage import written

WINDOW = 50
GRAM = 20

# Odd multipliers of the rolling hashes and of the mixing step.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MASK = (1 << 64) - 1


class _Known(dict):
    """Hashes of words, kept up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


class Rolling:
    """Hashes of word runs of any length, from sums of powers modulo 2**64."""

    def __init__(self):
        self.known = _Known()
        self.powers = [self._powers(b, 1 << 10) for b in _BASES]
        self.inverse = [self._powers(pow(b, -1, 1 << 64), 1 << 10) for b in _BASES]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base & _MASK, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def read(self, words: list[bytes]) -> None:
        n = len(words)
        if n >= len(self.powers[0]):
            self.powers = [self._powers(b, 2 * n) for b in _BASES]
            self.inverse = [self._powers(pow(b, -1, 1 << 64), 2 * n) for b in _BASES]
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        self.sums = []
        for powers in self.powers:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes * powers[:n], out=sums[1:])
            self.sums.append(sums)

    def runs(self, which: int, starts, sizes) -> np.ndarray:
        """Mixed hashes of the runs of words at ``starts``."""
        sums = self.sums[which]
        value = (sums[starts + sizes] - sums[starts]) * self.inverse[which][starts]
        value ^= value >> np.uint64(32)
        value *= _MIX
        return value ^ (value >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def parse_blocks(roll: Rolling, words: list[bytes], window: int, gram: int):
    """Starts, numbers of windows, seeds and two content hashes of the blocks of one document."""
    n = len(words)
    if n < window:
        return None
    roll.read(words)
    grams = roll.runs(0, np.arange(n - gram + 1), gram)
    lowest = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).min(axis=1)
    starts = np.concatenate([[0], np.flatnonzero(lowest[1:] != lowest[:-1]) + 1])
    many = np.diff(np.append(starts, len(lowest)))
    sizes = many + window - 1
    return starts, many, lowest[starts], roll.runs(0, starts, sizes), roll.runs(1, starts, sizes)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def blocks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The blocks of every document (``doc_id, row_key, text``), a row each."""
    names = ["doc_id", "row_key", "start", "many", "seed", "block", "check"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Rolling()
        for batch in batches:
            parts = []
            for doc_id, key, text in zip(batch["doc_id"], batch["row_key"], batch["text"]):
                found = parse_blocks(roll, words_of(text), window, gram)
                if found:
                    starts, many, seeds, first, second = found
                    parts.append((doc_id, key, starts, many, _signed(seeds), _signed(first), second))
            if parts:
                sizes = [len(p[2]) for p in parts]
                columns = [
                    np.repeat([p[0] for p in parts], sizes),
                    np.repeat([p[1] for p in parts], sizes),
                    *(np.concatenate([p[i] for p in parts]) for i in (2, 3, 4, 5)),
                    (np.concatenate([p[6] for p in parts]) >> np.uint64(33)).astype(np.int64),
                ]
                yield pd.DataFrame(dict(zip(names, columns)))

    schema = "doc_id long, row_key long, start int, many int, seed long, block long, check int"
    return docs.mapInPandas(parse, schema)


def _windows(window: int):
    """Single windows of the blocks that ``spans`` lists, by their hashes; equal ones of a document once."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Rolling()
        for batch in batches:
            for doc_id, key, text, spans in zip(
                batch["doc_id"], batch["row_key"], batch["text"], batch["spans"]
            ):
                roll.read(words_of(text))
                spans = np.asarray(spans, dtype=np.int64)
                starts, many = spans >> 32, spans & 0xFFFFFFFF
                at = np.concatenate([np.arange(s, s + m) for s, m in zip(starts, many)])
                yield pd.DataFrame(
                    {
                        "doc_id": doc_id,
                        "row_key": key,
                        "at": at,
                        "hash": _signed(roll.runs(0, at, window)),
                        "check": (roll.runs(1, at, window) >> np.uint64(33)).astype(np.int64),
                    }
                )

    return expand


def _span(start, many):
    return F.shiftleft(F.col(start).cast("long"), 32).bitwiseOR(many)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, row_key, spans``: runs of windows, packed as start and count, that also start in a
    document with a smaller id. ``docs`` has ``doc_id, row_key, text`` without null ids."""
    found = written(blocks(docs, window, gram), "blocks")
    seeds = (
        found.groupBy("seed")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("seed")
    )
    # what follows reads only blocks whose seed more than one document has
    found = written(found.join(seeds, "seed", "left_semi"), "shared-blocks")
    same = ["seed", "block", "check", "many"]
    index = found.groupBy(*same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    index = written(index, "block-index")
    several = index.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    # a document with a known block loses all of its windows; the first one is looked at window by window
    known = index.where("low < high").select(*same, "low")
    factors = (
        found.join(known, same).where("doc_id > low").select("doc_id", "row_key", _span("start", F.col("many")).alias("span"))
    )
    border = index.join(several, "seed", "left_semi").select(*same, F.col("low").alias("doc_id"))
    border = (
        found.join(border, [*same, "doc_id"], "left_semi")
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list(_span("start", F.col("many"))).alias("spans"))
    )
    schema = "doc_id long, row_key long, at int, hash long, check int"
    windows = docs.join(border, ["doc_id", "row_key"]).mapInPandas(_windows(window), schema)
    windows = written(windows, "border-windows")
    first = windows.groupBy("hash", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = first.where("low < high").select("hash", "check", "low")
    single = (
        windows.join(first, ["hash", "check"])
        .where("doc_id > low")
        .select("doc_id", "row_key", _span("at", F.lit(1).cast("long")).alias("span"))
    )
    spans = factors.unionByName(single)
    return spans.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("spans"))


def _cover(n: int, spans, window: int) -> np.ndarray:
    """Which of ``n`` words a listed window covers."""
    change = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        spans = np.asarray(spans, dtype=np.int64)
        starts, many = spans >> 32, spans & 0xFFFFFFFF
        np.add.at(change, starts, 1)
        np.add.at(change, starts + many + window - 1, -1)
    return np.cumsum(change)[:n] > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` for every row.

    A word goes if it is covered by ``window`` consecutive words that also start in a document with a smaller
    id, all judged on the input; ``kept`` joins the rest by single spaces and ``spans`` has the removed
    ranges of words. Null and empty texts have no words. Rows with equal ids never remove each other's words.
    A row with a null id keeps everything and removes nothing. An empty table gives an empty table; other
    columns are not read. Block and window hashes have 95 bits.
    """
    whole = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    named = whole.where("doc_id is not null")
    spans = duplicate_spans(named, window, gram)
    joined = named.join(spans, ["doc_id", "row_key"], "left").select("doc_id", "text", "spans")
    none = F.lit(None).cast("array<bigint>").alias("spans")
    joined = joined.unionByName(whole.where("doc_id is null").select("doc_id", "text", none))

    @F.pandas_udf("n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans):
            words = words_of(text)
            gone = _cover(len(words), own, window)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if len(edges) else words
            out.append(
                (
                    len(words),
                    len(words) - len(kept),
                    b" ".join(kept).decode("utf-8", "surrogatepass"),
                    [tuple(e) for e in edges.reshape(-1, 2).tolist()],
                )
            )
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "spans"])

    return joined.select("doc_id", cut("text", "spans").alias("_cut")).select("doc_id", "_cut.*")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
