"""Byte-level BPE, with long unsplit text encoded by tree concatenation.

Text is split into pre-tokens, which are encoded on their own. A pre-token too long for that is halved,
the halves are encoded apart, and a window around the join is encoded anew and grown until its first and its
last tokens agree with the halves. Every pair of neighbours in the result then comes from an encoding that
holds both, which makes the whole the encoding that merges would give. Very long texts are dealt as
parts to different tasks, cut between pre-tokens or, within a long one, anywhere.
"""

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_BYTES = 512
PART_CHARS = 1 << 16
#: Pre-tokens up to this are merged without a heap.
SHORT_BYTES = 48


def _byte_letters() -> dict[str, int]:
    """The letters by which a vocabulary file writes bytes: printable ones stand for themselves, the others
    for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes and decodes whole texts by the vocabulary and merges of a tokenizer file's content."""

    def __init__(self, content: str, leaf_bytes: int = LEAF_BYTES, window: int = 4):
        file = json.loads(content)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in file["model"]["vocab"]}
        ids = file["model"]["vocab"]
        self.bytes_of = {number: raw[token] for token, number in ids.items()}
        self.byte_id = [0] * 256
        for number, data in self.bytes_of.items():
            if len(data) == 1:
                self.byte_id[data[0]] = number
        self.rank = {}
        for order, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[left], ids[right]] = (order, ids[left + right])
        #: The same by their order alone, and what the merge of each order makes.
        self.order = {pair: order for pair, (order, _) in self.rank.items()}
        self.merged = dict(self.rank.values())
        self.no_order = 1 + max(self.merged, default=0)
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        self.bytes_of |= {number: text.encode() for text, number in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.words = regex.compile(PATTERN)
        self.leaf_bytes, self.window = max(2, leaf_bytes), max(2, window)
        self.known = _Words(self)

    def merge_short(self, data: bytes) -> list[int]:
        """Merges applied by rank, leftmost first, with the orders of all joins in a list: cheaper for few bytes."""
        get, merged, none = self.order.get, self.merged, self.no_order
        ids = [self.byte_id[b] for b in data]
        orders = [get(pair, none) for pair in zip(ids, ids[1:])]
        while orders:
            low = min(orders)
            if low == none:
                break
            at = orders.index(low)
            ids[at : at + 2] = [merged[low]]
            del orders[at]
            if at:
                orders[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(orders):
                orders[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Merges applied by rank, leftmost first, with a heap over the joins of a linked list."""
        if len(data) <= SHORT_BYTES:
            return self.merge_short(data)
        ids = [self.byte_id[b] for b in data]
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            found = rank.get((ids[at], ids[at + 1]))
            if found:
                heap.append((found[0], at, found[1], ids[at], ids[at + 1]))
        heapq.heapify(heap)
        while heap:
            _, at, merged, left, right = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != left or nxt >= n or ids[nxt] != right:
                continue
            ids[at], ids[nxt] = merged, -1
            after[at] = nxt2 = after[nxt]
            if nxt2 < n:
                before[nxt2] = at
                found = rank.get((merged, ids[nxt2]))
                if found:
                    heapq.heappush(heap, (found[0], at, found[1], merged, ids[nxt2]))
            prev = before[at]
            if prev >= 0:
                found = rank.get((ids[prev], merged))
                if found:
                    heapq.heappush(heap, (found[0], prev, found[1], ids[prev], merged))
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring pieces of one pre-token from their own encodings."""
        if not left or not right:
            return left or right
        size = self.window
        while True:
            a, b = left[-size:], right[:size]
            middle = self.merge(b"".join(map(self.bytes_of.__getitem__, chain(a, b))))
            left_agrees = len(a) == len(left) or middle[:2] == a[:2]
            right_agrees = len(b) == len(right) or middle[-2:] == b[-2:]
            if left_agrees and right_agrees:
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            size *= 2

    def tree(self, data: bytes) -> list[int]:
        """The encoding of one pre-token of any length."""
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join_parts(self, goes_on, pieces) -> list[int]:
        """One encoding from those of parts; ``goes_on`` tells which continue the pre-token before."""
        out, runs = [], []
        for on, ids in zip(goes_on, pieces):
            if on:
                runs[-1].append(list(ids))
            else:
                runs.append([list(ids)])
        for run in runs:
            while len(run) > 1:  # neighbours in pairs, level by level
                pairs = [self.join(*run[i : i + 2]) for i in range(0, len(run) - 1, 2)]
                run = pairs + ([run[-1]] if len(run) % 2 else [])
            out += run[0]
        return out

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.words.findall(text))))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.specials:
            return self.plain(text)
        out = []
        for piece in self.specials.split(text):
            number = self.added.get(piece)
            out += self.plain(piece) if number is None else [number]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def parts(self, text: str, size: int) -> Iterator[tuple[bool, bool, bytes]]:
        """Pieces of about ``size`` characters; whether each goes on within the pre-token before, and whether
        it is (part of) a single pre-token, not to be split again."""

        def closed(words: list[str]):
            # white space at the end would be split in another way without what follows
            end = len(words)
            while end and words[end - 1].isspace():
                end -= 1
            if end:
                yield False, False, "".join(words[:end]).encode("utf-8", "surrogatepass")
            for word in words[end:]:
                yield False, True, word.encode("utf-8", "surrogatepass")

        held: list[str] = []
        length = 0
        for piece in self.specials.split(text) if self.specials else [text]:
            special = piece in self.added
            for word in [piece] if special else self.words.findall(piece):
                long = len(word) > size and not special
                if held and (long or length + len(word) > size):
                    yield from closed(held)
                    held, length = [], 0
                if long:
                    data = word.encode("utf-8", "surrogatepass")
                    for at in range(0, len(data), size):
                        yield at > 0, True, data[at : at + size]
                else:
                    held.append(word)
                    length += len(word)
        yield from closed(held)


class _Words(dict):
    """Encodings of pre-tokens, kept up to a bounded number; those used since the last bound stay for another one."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.encoder.tree(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Tokenizer:
    """Column functions for one vocabulary; its file (a few megabytes) is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str, leaf_bytes: int = LEAF_BYTES):
        with open(path, encoding="utf-8") as file:
            # the broadcast value lives as long as a worker, and so does the encoder that a worker puts into it
            shared = spark.sparkContext.broadcast({"content": file.read()})

        def encoder() -> Encoder:
            held = shared.value
            if leaf_bytes not in held:
                held[leaf_bytes] = Encoder(held["content"], leaf_bytes)
            return held[leaf_bytes]

        def arrays(found) -> pd.Series:
            return pd.Series([np.array(ids, np.int32) for ids in found], dtype=object)

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            return arrays(map(encoder().encode, texts))

        @F.pandas_udf("array<int>")
        def encode_part(single: pd.Series, parts: pd.Series) -> pd.Series:
            own = encoder()
            return arrays(
                own.tree(d) if s else own.encode(d.decode("utf-8", "surrogatepass")) for s, d in zip(single, parts)
            )

        @F.pandas_udf("array<int>")
        def join_parts(goes_on: pd.Series, pieces: pd.Series) -> pd.Series:
            return arrays(map(encoder().join_parts, goes_on, pieces))

        @F.pandas_udf("string")
        def decode(ids: pd.Series) -> pd.Series:
            own = encoder()
            return pd.Series([own.decode(i.tolist()) for i in ids], dtype=object)

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def digests(ids: pd.Series) -> pd.DataFrame:
            own = encoder()
            out = [
                (
                    len(i),
                    hashlib.sha256(np.asarray(i).astype("<u4").tobytes()).hexdigest(),
                    hashlib.sha256(own.decode(i.tolist()).encode("utf-8")).hexdigest(),
                )
                for i in ids
            ]
            return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        def cut(size: int):
            def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                own = encoder()
                for batch in batches:
                    for a, b, text in zip(batch["_a"], batch["_b"], batch["_text"]):
                        pieces = list(own.parts(text, size))
                        yield pd.DataFrame(
                            {
                                "_a": a,
                                "_b": b,
                                "part": range(len(pieces)),
                                "goes_on": [p[0] for p in pieces],
                                "single": [p[1] for p in pieces],
                                "data": [p[2] for p in pieces],
                            }
                        )

            return parts

        self._encode, self._encode_part, self._join_parts, self._cut = encode, encode_part, join_parts, cut
        #: Texts from ids.
        self.decode = decode
        #: From ids: their number, the SHA-256 of them as little-endian unsigned 32-bit integers, and the
        #: SHA-256 of the decoded text.
        self.digests = digests

    def encode(
        self, docs: DataFrame, text: str = "text", ids: str = "ids", part_chars: int = PART_CHARS
    ) -> DataFrame:
        """All columns of ``docs`` and the token ids of its whole text.

        Strings of added tokens in a text become those tokens. Null and empty texts have no ids; repeated
        rows are encoded each; an empty table gives an empty table; a column named like ``ids`` is replaced.
        Texts over ``part_chars`` characters are cut into parts of about that size, which are encoded in
        different tasks and joined again; they are known by two hashes of the text.
        """
        docs = docs.drop(ids)
        size = F.coalesce(F.length(text), F.lit(0))
        short = docs.where(size <= part_chars).withColumn(ids, self._encode(text))
        # the table's own columns travel in one struct, so that no name of theirs meets a name used here
        rows = docs.where(size > part_chars).select(
            F.struct("*").alias("_row"),
            F.col(text).alias("_text"),
            F.xxhash64(text).alias("_a"),
            F.xxhash64(F.lit(1), text).alias("_b"),
        )
        parts = rows.select("_a", "_b", "_text").mapInPandas(
            self._cut(part_chars), "_a long, _b long, part int, goes_on boolean, single boolean, data binary"
        )
        encoded = parts.dropDuplicates(["_a", "_b", "part"]).select(
            "_a", "_b", F.struct("part", "goes_on", self._encode_part("single", "data").alias("ids")).alias("piece")
        )
        joined = encoded.groupBy("_a", "_b").agg(F.sort_array(F.collect_list("piece")).alias("_pieces"))
        joined = joined.select(
            "_a", "_b", self._join_parts(F.col("_pieces.goes_on"), F.col("_pieces.ids")).alias("_ids")
        )
        long = rows.join(joined, ["_a", "_b"]).select("_row.*", F.col("_ids").alias(ids))
        return short.unionByName(long.select(*short.columns))
