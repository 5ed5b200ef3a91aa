"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics are read from whole texts in Arrow batches. Trees are grown on binned statistics of a
bounded sample of labelled rows; each tree is a row of flat arrays in heap order, so that a batch of
documents walks all trees with a few numpy steps per level.
"""

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "spaces", "breaks", "punctuation", "symbols", "bangs", "bars",
    "beyond_ascii", "controls", "log_words", "mean_word", "longest_word", "distinct_words", "top_word",
    "repeated_neighbours", "marked_words", "log_lines", "distinct_lines", "mean_line", "sentence_ends",
)
SAMPLE_ROWS = 20_000
KEEP_SCORE = 0.7

_BYTES = np.arange(256)
_CLASSES = {
    "letters": (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 192),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "spaces": _BYTES == 32,
    "breaks": _BYTES == 10,
    "punctuation": np.isin(_BYTES, np.frombuffer(b".,;:?'\"()-", np.uint8)),
    "symbols": np.isin(_BYTES, np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)),
    "bangs": _BYTES == 33,
    "bars": _BYTES == 124,
    "beyond_ascii": _BYTES >= 128,
    "controls": (_BYTES < 32) & (_BYTES != 10),
}
_SHARES = np.array(list(_CLASSES.values()), dtype=float).T
_EDGES = b"!#$%&*|@^~"


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one whole text; an empty or null text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    size = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ _SHARES / size
    words = data.split()
    n = len(words)
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line]
    return [
        float(np.log1p(size)),
        *shares.tolist(),
        float(np.log1p(n)),
        size / max(n, 1),
        float(np.log1p(max(map(len, words), default=0))),
        len(seen) / max(n, 1) ** 0.75,
        max(seen.values(), default=0) / max(n, 1),
        sum(map(eq, words, words[1:])) / max(n, 1),
        sum(w[-1] in _EDGES for w in words) / max(n, 1),
        float(np.log1p(len(lines))),
        len(set(lines)) / max(len(lines), 1),
        float(np.log1p(size / max(len(lines), 1))),
        float(counts[46] + counts[63] + counts[33]) / max(n, 1),
    ]


def statistics_table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics_of(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))


@dataclass
class Trees:
    """Trees of equal depth, one row each: node ``i`` has the children ``2i+1`` and ``2i+2``."""

    depth: int
    start: float
    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray  # trees x inner nodes: larger values go to the right
    value: np.ndarray  # trees x leaves

    def score(self, table: np.ndarray) -> np.ndarray:
        rows = np.arange(len(table))
        total = np.full(len(table), self.start)
        inner = self.feature.shape[1]
        for feature, border, value in zip(self.feature, self.border, self.value):
            node = np.zeros(len(table), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (table[rows, feature[node]] > border[node])
            total += value[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def grow(
    table: np.ndarray,
    labels: np.ndarray,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    smooth: float = 2.0,
    least: float = 5.0,
) -> Trees:
    """Boost logistic loss with trees found on histograms; no rows, or one class, gives a constant score."""
    n, width = table.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = (labels.sum() + 0.5) / (n + 1.0)
    start = float(np.log(mean / (1 - mean)))
    feature = np.zeros((rounds, inner), dtype=np.int64)
    border = np.full((rounds, inner), np.inf)
    value = np.zeros((rounds, leaves))
    if n == 0 or labels.min() == labels.max():
        return Trees(depth, start, feature[:0], border[:0], value[:0])
    cuts = [np.unique(np.quantile(table[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], table[:, j], side="left") for j in range(width)])
    flat = binned + np.arange(width) * bins
    total = np.full(n, start)
    for t in range(rounds):
        p = 1.0 / (1.0 + np.exp(-total))
        slope, bend = p - labels, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (many, width, bins)
            g = np.bincount(at, np.repeat(slope, width), many * width * bins).reshape(shape)
            h = np.bincount(at, np.repeat(bend, width), many * width * bins).reshape(shape)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
            gain[(hl < least) | (ht - hl < least)] = 0.0
            for k in range(many):
                best = int(gain[k].argmax())
                j, b = divmod(best, bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], border[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (table[np.arange(n), feature[t][node]] > border[t][node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        value[t] = -rate * g / (h + smooth)
        total += value[t][leaf]
    return Trees(depth, start, feature, border, value)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **growth) -> Trees:
    """Trees from at most ``sample_rows`` labelled, not held-out documents, chosen by a hash of the id.

    Only the sample's statistics reach the driver. A document that is labelled more than once counts
    with its most frequent label (ties: 1); null labels and ids are left out.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("_label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample_rows)
    )

    @F.pandas_udf("array<double>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(t) for t in texts])

    # one text per labelled id, in case that an id has several
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "_label", read("text").alias("_stats"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("_stats", "_label")).alias("_row"))
        .orderBy("doc_id")
        .select("_row.*")
        .toPandas()
    )
    table = np.array(rows["_stats"].tolist(), dtype=float).reshape(len(rows), len(STATISTICS))
    return grow(table, rows["_label"].to_numpy(dtype=float), **growth)


def score(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole text; the trees travel with the tasks."""

    @F.pandas_udf("double")
    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(statistics_table(texts)))

    return docs.withColumn(name, walk(text))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_SCORE, **fitting) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Inputs of a score are statistics of the text alone. Null and empty texts are scored like a text
    without words; rows with equal ids are scored each; a null id is never held out; an empty table gives
    an empty table; without usable labels all scores are 0.5. Other columns are not read.
    """
    trees = fit(docs, labels, **fitting)
    scored = score(docs.select("doc_id", "text"), trees)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_SCORE, **fitting) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    trees = fit(docs, labels, **fitting)
    rows = score(docs.select(F.struct("*").alias("_row"), "text"), trees, name="_score")
    return rows.where(F.col("_score") >= threshold).select("_row.*")
