"""Token counts at every prefix of a text, by dynamic programming over a sentencepiece BPE vocabulary.

The encoding of a prefix ends with the one piece that fits on the encoding of what stands before that piece: two
neighbours fit if encoding them together gives just the two, and pieces whose neighbours all fit are the encoding.
So one pass from left to right finds the last piece, and with it the token count, of every prefix. The counts are
stored as differences, two bytes a code point; budgets, cuts and lengths of prefixes are read from them
without encoding again.
"""

import re
from math import inf
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SPACE = "▁"
STEP = "<i2"
NEVER = inf
PAIR = 1 << 32
HEADS = (8, 5)
KNOWN_PAIRS = 1_000_000
KNOWN_HEADS = 100_000
KNOWN_SEGMENTS = 300_000
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PrefixCounter:
    """Counts the tokens of all prefixes of a text by the content of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normal, kinds = proto.normalizer_spec, {piece.type for piece in proto.pieces}
        plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.add_dummy_prefix
        bpe = proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback
        if not (plain and bpe and kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("the model is not BPE with byte fallback, plain text and a space put before it")
        self.order = {piece.piece: -piece.score for piece in proto.pieces if piece.type == NORMAL}
        #: Numbers of letters and of the pieces that merges alone give back, as all pieces of an encoding are.
        pieces = [piece for piece in self.order if len(piece) == 1 or self.merge(piece) == [piece]]
        self.whole = {piece: number for number, piece in enumerate(pieces)}
        self.names, self.weights = pieces, [1] * len(pieces)
        self.sizes = _Sizes(pieces)
        self.fits: dict[int, bool] = {}
        self.heads: dict[str, tuple] = {}
        self.segments = re.compile(self._pattern())
        self.known = _Segments(self)

    def _pattern(self) -> str:
        """Segments between which no piece reaches: runs of letters that occur together in pieces, with the spaces
        before them, runs of spaces, and runs of letters that no longer piece holds."""
        if any(SPACE in piece.lstrip(SPACE) for piece in self.order):
            return r"(?s).+"
        group: dict[str, str] = {}

        def top(letter: str) -> str:
            while group.setdefault(letter, letter) != letter:
                letter = group[letter]
            return letter

        for piece in self.order:
            if len(piece) > 1:
                letters = piece.lstrip(SPACE)
                for letter in letters:
                    group[top(letter)] = top(letters[0])
        classes: dict[str, list[str]] = {}
        for letter in list(group):
            classes.setdefault(top(letter), []).append(letter)
        sets = ["".join(map(re.escape, sorted(letters))) for letters in classes.values()]
        runs = "|".join(f"[{letters}]+" for letters in sorted(sets, key=len, reverse=True))
        return rf"{SPACE}*(?:{runs})|{SPACE}+|[^{SPACE}{''.join(sets)}]+"

    def merge(self, text: str) -> list[str]:
        """The pieces of two neighbours' text by merges: best score first, leftmost first."""
        pieces, order = list(text), self.order.get
        scores = [order(pieces[at] + pieces[at + 1], NEVER) for at in range(len(pieces) - 1)]
        while scores:
            best = min(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            merged = pieces[at] + pieces.pop(at + 1)
            pieces[at] = merged
            del scores[at]
            if at:
                scores[at - 1] = order(pieces[at - 1] + merged, NEVER)
            if at < len(scores):
                scores[at] = order(merged + pieces[at + 1], NEVER)
        return pieces

    def counts(self, text: str) -> list[int]:
        """Tokens of each prefix of a text that is taken as it is, the empty one first."""
        last, counts = [-1], [0]
        whole, fits, sizes, heads = self.whole, self.fits, self.sizes, self.heads
        for head in HEADS:  # what another text with the same start was found to have there
            if len(text) > head and (known := heads.get(text[:head])):
                last, counts = [*known[0]], [*known[1]]
                break
        for end in range(len(counts), len(text) + 1):
            for length in sizes[text[end - 3 : end] if end > 2 else text[:end]]:
                if length > end:
                    continue
                piece = whole.get(text[end - length : end])
                if piece is None:
                    continue
                if length == end:
                    break
                pair = last[end - length] * PAIR + piece
                fit = fits.get(pair)
                if fit is None:
                    fit = self._fit(pair, last[end - length], piece)
                if fit:
                    break
            else:  # no longer piece fits, so the letter stands alone
                length, piece = 1, whole.get(text[end - 1])
                if piece is None:
                    piece = self._letter(text[end - 1])
            last.append(piece)
            counts.append(counts[end - length] + self.weights[piece])
            if end in HEADS:
                if len(heads) >= KNOWN_HEADS:
                    heads.clear()
                heads[text[:end]] = tuple(last), tuple(counts)
        return counts

    def _fit(self, pair: int, left: int, right: int) -> bool:
        """Whether two pieces stand beside each other in the encoding of their text."""
        if len(self.fits) >= KNOWN_PAIRS:
            self.fits.clear()
        a, b = self.names[left], self.names[right]
        found = self.fits[pair] = self.merge(a + b) == [a, b]
        return found

    def _letter(self, letter: str) -> int:
        """The number of a letter, which gets one if it is in no vocabulary and so stands as its bytes."""
        number = self.whole[letter] = len(self.names)
        self.names.append(letter)
        self.weights.append(1 if letter in self.order else len(letter.encode("utf-8")))
        return number

    def steps(self, text: str | None) -> bytes:
        """What each code point adds to the token count, two bytes each."""
        if not text:
            return b""
        whole = SPACE + text.replace(" ", SPACE)
        added = np.frombuffer(b"".join(map(self.known.__getitem__, self.segments.findall(whole))), STEP)
        added = added[1:] + np.where(np.arange(len(added) - 1) == 0, added[0], 0)
        return added.astype(STEP).tobytes()


class _Sizes(dict):
    """By the last three letters of a text, how long the pieces of several letters are that may end it, longest first."""

    def __init__(self, pieces: list[str]):
        self.pairs = {piece for piece in pieces if len(piece) == 2}
        found: dict[str, set[int]] = {}
        for piece in pieces:
            if len(piece) > 2:
                found.setdefault(piece[-3:], set()).add(len(piece))
        super().__init__({end: (*sorted(lengths, reverse=True), *self[end]) for end, lengths in found.items()})

    def __missing__(self, end: str) -> tuple[int, ...]:
        return (2,) if end[-2:] in self.pairs else ()


class _Segments(dict):
    """Steps of segments, kept up to a bounded number."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, segment: str) -> bytes:
        counts = self.counter.counts(segment)
        # refuses a change that two bytes don't hold
        steps = np.array(list(map(sub, counts[1:], counts)), STEP).tobytes()
        if len(segment) <= 64:
            if len(self) >= KNOWN_SEGMENTS:
                self.clear()
            self[segment] = steps
        return steps


def _sums(steps: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps or b"", STEP), dtype=np.int64)


@F.pandas_udf(LongType())
def total(prefixes: pd.Series) -> pd.Series:
    """Tokens of the whole text."""
    return pd.Series([int(np.frombuffer(s or b"", STEP).sum(dtype=np.int64)) for s in prefixes], dtype="int64")


@F.pandas_udf(LongType())
def tokens_of_first(prefixes: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first so many code points: of none below one, of the whole text beyond its end."""
    found = [
        int(np.frombuffer(s or b"", STEP)[: max(0, int(n))].sum(dtype=np.int64)) for s, n in zip(prefixes, chars)
    ]
    return pd.Series(found, dtype="int64")


@F.pandas_udf(LongType())
def longest_within(prefixes: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix of at most so many tokens.

    A longer prefix can have fewer tokens than a shorter one, so this is not the first place over the budget.
    """
    found = []
    for steps, limit in zip(prefixes, budget):
        inside = np.flatnonzero(_sums(steps) <= limit)
        found.append(int(inside[-1]) + 1 if len(inside) else 0)
    return pd.Series(found, dtype="int64")


class PrefixTokens:
    """Prefix counts as a column; the model file (under a megabyte) is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            shared = spark.sparkContext.broadcast({"model": file.read()})

        @F.pandas_udf("binary")
        def prefixes(texts: pd.Series) -> pd.Series:
            held = shared.value
            if "counter" not in held:  # the broadcast value lives as long as a worker
                held["counter"] = PrefixCounter(held["model"])
            return pd.Series(list(map(held["counter"].steps, texts)), dtype=object)

        self._prefixes = prefixes

    def prefixes(self, text: str | Column) -> Column:
        """The stored counts of a text; a null text has those of an empty one."""
        return self._prefixes(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))

    def with_prefixes(self, docs: DataFrame, text: str = "text", out: str = "prefixes") -> DataFrame:
        """All columns of ``docs`` and the stored counts; a column named like ``out`` is replaced.

        Rows stand for themselves, repeated ones too; an empty table gives an empty table.
        """
        return docs.drop(out).withColumn(out, self.prefixes(text))

    def token_counts(self, docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
        """``n_bytes``, ``n_tokens`` and ``over_limit`` beside all columns; own columns of these names are replaced.

        Null and empty texts have no bytes and no tokens.
        """
        docs = docs.drop("n_bytes", "n_tokens", "over_limit")
        counted = docs.withColumns(
            {
                "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
                "n_tokens": total(self.prefixes(text)),
            }
        )
        return counted.withColumn("over_limit", F.col("n_tokens") > limit)

    def truncated(self, docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
        """Texts cut to their longest prefix of at most ``limit`` tokens; null texts stay null."""
        kept = longest_within(self.prefixes(text), F.lit(limit)).cast("int")
        return docs.withColumn(text, F.substring(text, F.lit(1), kept))
