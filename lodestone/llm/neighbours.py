"""Approximate nearest neighbours over learned partitions.

1. Balanced partitioning. Of a bounded sample (``SAMPLE`` vectors, by hash) the graph of the ``GRAPH`` nearest neighbours is
   cut in two halves of equal size, again and again: by the second eigenvector of the normalised graph, and then by
   exchanges of vertices that cut fewer edges. This gives some ``FANOUT`` parts of equal size at most.
2. Classifier. A softmax regression learns, from a vector, in which parts its neighbours of the graph lie.
3. Index. It puts every vector into its most probable part. Where parts are larger than ``LEAF`` on the average, each is
   divided again in the same way, by a sample and a classifier of its own (``LEVELS`` levels at most).
4. Routing. At each level a query visits the parts with the highest probability. How many is measured, not guessed:
   ``AUDIT`` queries are first compared with all vectors, and the least number is taken with which ``RECALL`` of
   their nearest (``LATER`` of those still in reach, below the first level) are met.
5. Search. A part's vectors lie in blocks of ``BLOCK`` by a hash, and so do the queries that visit it; each two
   blocks meet in one task by a matrix product, and what may be among a query's nearest is measured again as the
   root of the summed squares of differences. A query that met fewer vectors than it needs is compared with all. If the
   audited queries found less than ``LEAST_RECALL`` of their nearest after all, every query is compared with all.

Equal vectors are reduced before they are compared: of each vector's ids the ``NEAREST`` + 1 smallest are kept, and equal
queries are searched once. A vector that holds a third of all rows is then one query and eleven candidates.

Bounds: the sample is at most SAMPLE vectors and ``SAMPLE_BYTES``, in one task for each part that is divided; a model has FANOUT
rows of the vectors' length; the driver holds counts by part and the audit's recall by number of parts.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows without an id; vectors meet those of their own length only; rows that repeat an id and vector are one row; an
id with several vectors is a query with each, and a candidate with each for all rows but the one that asks; ranks are then
counted for each; an empty table gives no rows; other columns, label included, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table, written

EVERY, NEAREST = 100, 10
SAMPLE, SAMPLE_BYTES, GRAPH = 4096, 64 << 20, 10
FANOUT, LEAST_PARTS, LEAST, LEAF, LEVELS = 64, 16, 64, 4096, 3
AUDIT, RECALL, LATER, LEAST_RECALL = 256, 0.97, 0.99, 0.9
BLOCK, BLOCK_BYTES, QUERIES, PAIRS = 4096, 32 << 20, 512, 1 << 17
STEPS, RATE, DECAY = 150, 0.05, 1e-4


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id, dim, v (doubles, as bytes) of the rows that take part, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, out = [], [], []
            for i, v in enumerate(batch.column("embedding")):
                x = None if not v.is_valid or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is None or v.values.null_count or not np.isfinite(x).all() or not x.any():
                    continue
                keep.append(i)
                dims.append(len(x))
                out.append((x + 0.0).tobytes())  # -0.0 and 0.0 are equal
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

    known = rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return known.mapInArrow(run, "vec_id long, dim int, v binary").distinct()


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = [np.frombuffer(v.as_buffer(), np.float64) for v in column]
    return np.stack(raw) if raw else np.zeros((0, 0))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ids of each row's k nearest other rows."""
    out = np.empty((len(x), k), np.int64)
    for start in range(0, len(x), 512):
        d = squares(x[start : start + 512], x)
        d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        out[start : start + 512] = near
    return out


def halved(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which half each vertex of a graph goes to: equal halves with few edges between them."""
    n = len(weights)
    degree = np.maximum(weights.sum(1), 1e-9)
    root = np.sqrt(degree)
    near = weights / root[:, None] / root[None, :]
    first = root / np.linalg.norm(root)
    v = rng.standard_normal(n).astype(weights.dtype)
    for _ in range(60):  # power iteration towards the second eigenvector, the first being known
        v = near @ v + v
        v -= first * (first @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        inner = np.where(side, weights @ side, weights @ ~side)
        gain = degree - 2 * inner  # edges that are cut now less those that would be
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        most = min(len(a), len(b), max(1, n // 20))
        a, b = a[:most], b[:most]
        good = gain[a] + gain[b] - 2 * weights[a, b] > 1e-9
        if not good.any():
            break
        before = weights[np.ix_(side, ~side)].sum()
        swapped = side.copy()
        swapped[a[good]], swapped[b[good]] = False, True
        if weights[np.ix_(swapped, ~swapped)].sum() >= before:
            break
        side = swapped
    return side


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Each vertex's part, of parts (a power of two) of equal size."""
    n = len(near)
    weights = np.zeros((n, n), np.float32)
    weights[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    weights = np.maximum(weights, weights.T)
    part = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                new[own] += halved(weights[np.ix_(own, own)], rng)
        part = new
    return part


def fitted(x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """The classifier's weights (parts, dim + 1): trained on the parts of a sample and of its neighbours."""
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, min(GRAPH, len(x) - 1))
    part = balanced_parts(near, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1)
    for k in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[near[:, k]]), 1)
    target /= target.sum(1, keepdims=True)
    centre, scale = x.mean(0), x.std() or 1.0
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros((parts, z.shape[1]))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        gradient = (softmax(z @ w.T) - target).T @ z / len(z) + DECAY * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient * gradient
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    # the scaling becomes part of the weights
    inner = w[:, :-1] / scale
    return np.hstack([inner, (w[:, -1] - inner @ centre)[:, None]])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def models_of(placed: DataFrame, least: int, leaf: int, least_parts: int) -> DataFrame:
    """dim, node, parts, model: a classifier for each node (dim, node) with more than ``least`` vectors. placed: dim, node, v."""
    sizes = placed.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.ceil(F.log2(F.col("n") / leaf)), F.lit(math.log2(least_parts)))
    parts = F.pow(F.lit(2), F.least(wanted, F.floor(F.log2(F.col("n") / 16)), F.lit(math.log2(FANOUT)))).cast("int")
    sizes = sizes.where(F.col("n") > least).withColumn("parts", parts).where("parts > 1")
    # of each node a bounded sample: a share of its vectors by hash, then the first of them, each task ahead of the shuffle
    most = F.least(F.lit(SAMPLE), F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))
    order = Window.partitionBy("dim", "node").orderBy(F.xxhash64("v"), "v")
    sample = placed.join(sizes, ["dim", "node"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).where(F.col("k") <= most)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        dim, node, parts = (rows[c][0].as_py() for c in ("dim", "node", "parts"))
        models = [fitted(matrix(rows["v"]), parts, node & 0xFFFF).tobytes()] if len(rows) >= 2 * parts else []  # very long vectors: undivided
        return pa.table({"dim": pa.array([dim], pa.int32()), "node": [node], "parts": pa.array([parts], pa.int32()), "model": pa.array(models or [None], pa.binary())}).slice(0, len(models))

    return written(sample.select("dim", "node", "parts", "k", "v").groupBy("dim", "node").applyInArrow(fit, "dim int, node long, parts int, model binary"), "ann-models")


def routed(rows: DataFrame, models: DataFrame, most: int | None) -> DataFrame:
    """Each row (dim, node, weight, id, v) at its ``most`` most probable children (None: all), weight being a log probability; rows at nodes without a model stay there.

    Rows go to the models in chunks of a node, so that a node with most rows is many tasks.
    """

    def run(held: pa.Table, of: pa.Table) -> pa.Table:
        names = ["dim", "node", "weight", "id", "v"]
        if not len(of) or not len(held):
            return held.select(names)
        parts = of["parts"][0].as_py()
        w = np.frombuffer(of["model"][0].as_buffer(), np.float64).reshape(parts, -1)
        z = matrix(held["v"]) @ w[:, :-1].T + w[:, -1]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        k = min(most or parts, parts)
        child = np.argsort(-z, 1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(z)), k)
        out = held.select(names).take(pa.array(row))
        out = out.set_column(1, "node", pa.array(out["node"].to_numpy() * FANOUT + child.ravel() + 1))
        return out.set_column(2, "weight", pa.array(out["weight"].to_numpy() + z[row, child.ravel()]))

    chunks = rows.groupBy("dim", "node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    dealt = rows.join(chunks, ["dim", "node"]).withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.col("chunks"))).drop("chunks")
    each = models.join(chunks, ["dim", "node"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    by = ["dim", "node", "chunk"]
    return dealt.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(run, "dim int, node long, weight double, id long, v binary")


def nearest(pairs: DataFrame) -> DataFrame:
    """query, vec_id, score: of each query's rows the NEAREST + 1 nearest, ties to the smaller id."""
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= NEAREST + 1).drop("k")


def searched(visits: DataFrame, index: DataFrame) -> DataFrame:
    """query, vec_id, score: each query's nearest in the nodes it visits. visits and index: dim, node, id, v."""

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        at_most = F.least(F.lit(size), F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
        counts = rows.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.ceil(F.col("n") / at_most))
        dealt = rows.join(counts, ["dim", "node"]).withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.col("n")))
        held = F.sort_array(F.collect_list(F.struct("id", "v"))).alias(name)
        return dealt.groupBy("dim", "node", "block").agg(held).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, all_ = batch.column("some")[i].values, batch.column("all")[i].values
                ids, x = some.field("id").to_numpy(), matrix(some.field("v"))
                others, y = all_.field("id").to_numpy(), matrix(all_.field("v"))
                # within a margin above the error of the product lies all that may be nearest: it is measured again
                scale = max(np.abs(x).max(), np.abs(y).max())
                u, w = x / scale, y / scale
                near, margin = squares(u, w), 1e-9 * ((u * u).sum(1)[:, None] + (w * w).sum(1)[None, :])
                k = min(NEAREST + 1, len(y))
                a, b = np.nonzero(near - margin <= np.partition(near + margin, k - 1, 1)[:, k - 1 : k])
                score = np.concatenate([np.sqrt(((x[a[i : i + PAIRS]] - y[b[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(a), PAIRS)])
                order = np.lexsort((others[b], score, a))
                a, b, score = a[order], b[order], score[order]
                head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
                keep = rank <= NEAREST
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[keep]]), pa.array(others[b[keep]]), pa.array(score[keep])], ["query", "vec_id", "score"])

    met = blocks(visits, QUERIES, "some").join(blocks(index, BLOCK, "all"), ["dim", "node"])
    return nearest(met.select("some", "all").mapInArrow(run, "query long, vec_id long, score double"))


def parts_to_visit(ranks: DataFrame, true: DataFrame, recall: float) -> int:
    """The least number of parts in which the share ``recall`` of the true neighbours in reach lie. ranks: query, node, rank; true: query, node of a neighbour."""
    hit = true.join(ranks, ["query", "node"]).groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each rank, FANOUT at most
    total, so_far = sum(r["n"] for r in hit), 0
    for row in sorted(hit, key=lambda r: r["rank"]):
        so_far += row["n"]
        if so_far >= recall * total:
            return row["rank"]
    return 1


def neighbours(rows: DataFrame, every: int = EVERY, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST found of every row whose id is divisible by ``every``."""
    able = written(vectors_of(rows), "ann-vectors")
    few = Window.partitionBy("dim", "v").orderBy("vec_id")
    kept = able.withColumn("k", F.row_number().over(few)).where(F.col("k") <= NEAREST + 1)
    at_root = [F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("weight")]
    everything = written(kept.select("dim", *at_root, F.col("vec_id").alias("id"), "v"), "ann-index")
    asked = able.where(F.col("vec_id") % every == 0)
    queries = written(asked.select("dim", "v").distinct().withColumn("id", F.monotonically_increasing_id()), "ann-queries")
    unrouted = queries.select("dim", *at_root, "id", "v")
    audited = written(unrouted.orderBy(F.xxhash64("v"), "v").limit(AUDIT), "ann-audit")
    # an audited row itself is as near as can be, and is left out
    true = written(searched(audited, everything).where("score > 0").select("query", "vec_id"), "ann-audit-nearest")
    index, visits, tried = everything, unrouted, audited
    for level in range(LEVELS):
        models = models_of(index, 2 * leaf if level else LEAST, leaf, 2 if level else LEAST_PARTS)
        if models.isEmpty():
            break
        index = written(routed(index, models, 1), "ann-index")
        tried = written(routed(tried, models, None), "ann-audit-routes")
        order = Window.partitionBy("id", F.floor((F.col("node") - 1) / FANOUT)).orderBy(F.desc("weight"), "node")
        tried = tried.withColumn("rank", F.row_number().over(order))
        lie = true.join(index.select(F.col("id").alias("vec_id"), "node"), "vec_id").select("query", "node")
        most = parts_to_visit(tried.select(F.col("id").alias("query"), "node", "rank"), lie, LATER if level else recall)
        tried = tried.where(F.col("rank") <= most).drop("rank")
        visits = written(routed(visits, models, most), "ann-visits")
    found = written(searched(visits, index).select("query", "vec_id", "score"), "ann-found")
    enough = found.groupBy(F.col("query").alias("id")).agg(F.count(F.lit(1)).alias("have")).where(F.col("have") > NEAREST)
    met = true.join(found, ["query", "vec_id"], "left").agg(F.count("score").alias("met"), F.count(F.lit(1)).alias("all")).first()
    poor = met["met"] < LEAST_RECALL * met["all"]
    again = unrouted if poor else unrouted.join(enough, "id", "left_anti")
    exact = searched(again, everything).select("query", "vec_id", "score")
    found = exact if poor else found.join(enough.select(F.col("id").alias("query")), "query", "left_semi").unionByName(exact)
    # back to the rows that ask; each row's own is left out
    met = asked.withColumnRenamed("vec_id", "query_id").join(queries, ["dim", "v"]).join(found, F.col("id") == F.col("query"))
    met = met.where(~((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)))
    ranks = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
