"""Approximate nearest neighbours with robust-pruned directed graphs.

Distinct vectors are dealt to shards by their norm's order of magnitude and by hash. Each shard is a directed graph built by insertion: a greedy
search from the entry point proposes neighbours for each new vector, and pruning with a relaxed distance keeps
the close and the differing ones. Queries go through every shard with a beam search. Searches of many vectors
advance together as numpy arrays, a hop at a time.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.storage import written

SHARD_ROWS = 32_768
MIN_SHARDS = 8
QUERY_CHUNK = 20_000
DEGREE = 32
BEAM = 64
RELAX = 1.2


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int):
    """Positions and squared distances of the ``beam`` nearest points met, nearest first (-1: none)."""
    n, rows = len(queries), np.arange(len(queries))
    square = np.einsum("ij,ij->i", points, points)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    first = entries[:beam]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = square[first] - 2 * queries @ points[first].T
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    while True:
        open_ = ~done
        live = rows[open_.any(axis=1)]
        if not len(live):
            break
        at = open_[live].argmax(axis=1)
        done[live, at] = True
        around = edges[ids[live, at]]
        d = square[around] - 2 * np.einsum("nkd,nd->nk", points[around], queries[live])
        known = (around[:, :, None] == ids[live][:, None, :]).any(axis=2)
        d = np.where((around < 0) | known, np.inf, d).astype(np.float32)
        all_ids = np.concatenate([ids[live], around], axis=1)
        all_dist = np.concatenate([dist[live], d], axis=1)
        all_done = np.concatenate([done[live], ~np.isfinite(d)], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        dist[live] = np.take_along_axis(all_dist, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
        ids[live] = np.where(np.isfinite(dist[live]), ids[live], -1)
    return ids, dist + np.einsum("ij,ij->i", queries, queries)[:, None].astype(np.float32)


def robust_prune(points: np.ndarray, owners: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` of the candidates ``near`` (-1: none) of each owner: the nearest one is kept, and drops
    all that are closer to it, by the factor ``relax``, than to the owner; and so on."""
    square = np.einsum("ij,ij->i", points, points)
    own = points[owners]
    spots = points[near]
    d = square[near] + square[owners][:, None] - 2 * np.einsum("nkd,nd->nk", spots, own)
    d = np.where((near < 0) | (near == owners[:, None]), np.inf, np.maximum(d, 0))
    between = square[near][:, :, None] + square[near][:, None, :] - 2 * spots @ spots.transpose(0, 2, 1)
    kept = np.full((len(owners), degree), -1, np.int64)
    rows = np.arange(len(owners))
    left = d.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        good = np.isfinite(left[rows, best])
        if not good.any():
            break
        kept[good, k] = near[rows, best][good]
        left[rows, best] = np.inf
        left[relax * relax * between[rows, best] <= d] = np.inf
        left[near == near[rows, best][:, None]] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, batch: int = 512):
    """Entry positions and the neighbours of every point (-1: none)."""
    n = len(points)
    rng = np.random.default_rng(7)
    order = rng.permutation(n)
    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order = np.concatenate([[middle], order[order != middle]]) if n else order
    edges = np.full((n, degree), -1, np.int64)
    entries = order[: min(n, 16)]  # several, as clusters may lie far apart
    at = 0
    while at < n:
        step = min(batch, max(64, at))
        fresh = order[at : at + step]
        if at:
            near, _ = beam_search(points, edges, entries, points[fresh], beam)
        else:
            near = np.full((len(fresh), 0), -1, np.int64)
        # points of one batch don't see each other in the graph: some of them are candidates directly
        d = ((points[fresh] ** 2).sum(axis=1)[None, :] - 2 * points[fresh] @ points[fresh].T).astype(np.float32)
        mates = fresh[np.argsort(d, axis=1)[:, : degree // 2 + 1 if at else len(fresh)]]
        chosen = robust_prune(points, fresh, np.concatenate([near, mates], axis=1), degree, relax)
        edges[fresh] = chosen
        # edges back
        source = np.repeat(fresh, degree)
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        owners, starts, counts = np.unique(target, return_index=True, return_counts=True)
        if len(owners):
            width = int(counts.max())
            for low in range(0, len(owners), 1024):
                some, c, s = owners[low : low + 1024], counts[low : low + 1024], starts[low : low + 1024]
                new = np.full((len(some), width), -1, np.int64)
                inside = np.arange(width)[None, :] < c[:, None]
                new[inside] = source[(s[:, None] + np.arange(width)[None, :])[inside]]
                new[(new[:, :, None] == edges[some][:, None, :]).any(axis=2)] = -1  # edges that exist
                both = np.concatenate([edges[some], new], axis=1)
                fits = ((both >= 0).sum(axis=1) <= degree)
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
                edges[some[fits]] = packed[fits]
                if (~fits).any():
                    edges[some[~fits]] = robust_prune(points, some[~fits], both[~fits], degree, relax)
        at += len(fresh)
    return entries, edges


def _flat(vectors: np.ndarray) -> np.ndarray:
    """Vectors, scaled to a largest norm of 1, with one more component, so that the nearest by distance has the
    largest inner product. Their norms should be of one order, as distances are of single precision."""
    if len(vectors):
        vectors = vectors / np.abs(vectors).max()  # squares of the scaled ones are finite
        vectors = vectors / np.sqrt((vectors**2).sum(axis=1).max())
    extra = np.sqrt(np.maximum(1 - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, extra]).astype(np.float32)


def _directions(queries: np.ndarray) -> np.ndarray:
    """Queries with norm 1, which leaves the order of their inner products, and no share in the added component."""
    scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
    scaled = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    return np.column_stack([scaled, np.zeros(len(scaled))]).astype(np.float32)


def norm_band(vector: str) -> Column:
    """Number of the band of norms, each 16 times the one before, that a vector of doubles is in; 1 is amid its band."""
    top = F.expr(f"array_max(transform({vector}, x -> abs(x)))")
    square = F.expr(
        f"aggregate({vector}, 0D, (s, x) -> s + pow(x / array_max(transform({vector}, y -> abs(y))), 2D))"
    )
    return F.floor((F.log2(top) + F.log2(square) / 2) / 4 + 0.5).cast("int")


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not null, not zero, without null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _smallest(rows: DataFrame, by: list[str], order: list, count: int) -> DataFrame:
    """The first ``count`` rows of each group; Spark cuts the groups before it moves them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= count)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    min_shards: int = MIN_SHARDS,
    query_chunk: int = QUERY_CHUNK,
    beam: int = BEAM,
    degree: int = DEGREE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` rows of largest inner product that the
    search finds, itself left out, ties to the smaller id.

    Equal vectors are one point of the graph and are told apart again afterwards, so groups of copies cost
    one search and all their members can be found. Every vector is indexed; the number of shards follows the
    number of distinct vectors, and a shard has about ``shard_rows`` points at most. Vectors of very different norms
    have shards of their own, so that a few long ones don't blur the distances of the others.

    Vectors that are null, empty, zero, or hold null or non-finite components neither ask nor are found;
    vectors are only compared with those of their length; rows with a null id are left out; of rows that
    repeat id and vector each counts; an empty table gives an empty table; other columns are not read.
    """
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: x.cast("double")).alias("v"),
        is_query.alias("asks"),
    )
    rows = rows.withColumn("size", F.size("v"))
    points = rows.groupBy("v", "size").agg(F.min("vec_id").alias("point"), F.max("asks").alias("asks"))
    points = written(points.withColumn("band", norm_band("v")), "points")
    # members of a point: more than k + 1 of them can't be among the nearest of any query
    members = rows.select("vec_id", "v", "asks").join(points.select("v", "point"), "v").select("vec_id", "point", "asks")
    members = written(members, "members")
    some = _smallest(members.select("point", "vec_id"), ["point"], ["vec_id"], k + 1).select("point", "vec_id")

    asks = points.groupBy("size").agg(F.sum(F.col("asks").cast("long")).alias("q"), F.count("*").alias("all"))
    counts = points.groupBy("size", "band").agg(F.count("*").alias("n")).join(F.broadcast(asks), "size")
    counts = counts.select(
        "size",
        "band",
        F.ceil(F.greatest(F.col("n") * min_shards / F.col("all"), F.col("n") / shard_rows)).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("q") / query_chunk)).cast("int").alias("chunks"),
    )
    counts = F.broadcast(counts)  # a row per length of vectors and band of norms
    dealt = points.join(counts, ["size", "band"])
    shard = F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point")
        held = np.array(part["v"].tolist(), dtype=np.float64)
        entries, edges = build_graph(_flat(held), degree, beam)
        return pd.DataFrame(
            {
                "size": [part["size"].iloc[0]],
                "band": [part["band"].iloc[0]],
                "shard": [part["shard"].iloc[0]],
                "chunks": [part["chunks"].iloc[0]],
                "points": [part["point"].to_numpy(np.int64).tobytes()],
                "vectors": [held.tobytes()],
                "entries": [entries.astype(np.int64).tobytes()],
                "edges": [edges.astype(np.int32).tobytes()],
            }
        )

    graphs = (
        dealt.withColumn("shard", shard)
        .groupBy("size", "band", "shard")
        .applyInPandas(build, "size int, band int, shard int, chunks int, points binary, vectors binary, entries binary, edges binary")
    )
    graphs = written(graphs, "graphs").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asking = (
        points.where("asks")
        .drop("band")
        .join(counts, "size")
        .withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("size", "band", "shard", "chunk", "point", "v")
    )

    def search(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(queries):
            return pd.DataFrame({"query": [], "point": [], "score": []}).astype({"query": "int64", "point": "int64"})
        g = graph.iloc[0]
        ids = np.frombuffer(g["points"], np.int64)
        held = np.frombuffer(g["vectors"], np.float64).reshape(len(ids), -1)
        edges = np.frombuffer(g["edges"], np.int32).reshape(len(ids), -1).astype(np.int64)
        entries = np.frombuffer(g["entries"], np.int64)
        flat = _flat(held)
        asked = np.array(queries["v"].tolist(), dtype=np.float64)
        names = queries["point"].to_numpy(np.int64)
        out = []
        for low in range(0, len(asked), 512):
            q = asked[low : low + 512]
            found, _ = beam_search(flat, edges, entries, _directions(q), beam)
            score = np.einsum("nkd,nd->nk", held[found], q)
            score = np.where(found < 0, -np.inf, score)
            best = np.lexsort((ids[found], -score), axis=1)[:, : k + 1]
            score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
            good = found >= 0
            out.append(
                pd.DataFrame(
                    {
                        "query": np.repeat(names[low : low + 512], good.sum(axis=1)),
                        "point": ids[found[good]],
                        "score": score[good],
                    }
                )
            )
        return pd.concat(out)

    place = ["size", "band", "shard", "chunk"]
    found = graphs.groupBy(*place).cogroup(asking.groupBy(*place)).applyInPandas(
        search, "query long, point long, score double"
    )
    best = [F.desc("score"), "vec_id"]
    found = _smallest(found.withColumnRenamed("point", "vec_id"), ["query"], best, k + 1)
    found = found.select("query", F.col("vec_id").alias("point"), "score").join(some, "point")
    found = _smallest(found, ["query"], best, k + 1).select("query", "vec_id", "score")
    found = written(found, "nearest")
    asked = members.where("asks").select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    hits = asked.join(found, "query").where("vec_id != query_id")
    ranked = _smallest(hits, ["query_id"], best, k)
    return ranked.select("query_id", F.col("_place").cast("int").alias("rank"), "vec_id", "score")
