"""Embedding near-dedup by NN-descent.

Vectors of equal labels with a cosine of ``LINK`` or more are linked. Equal vectors are one class
from the start. A neighbour graph of the classes is built and refined:

1. Start. Sign codes of random projections (``TABLES`` of them, more where codes are longer) bring vectors that are near each
   other into runs, in the order of ``FURTHER`` more code bits, so that in a run longer than a block
   neighbours are those that share the most bits; within blocks of a run, cosines of ``GUIDE`` or more give first neighbours.
   An angle of GUIDE is twice the angle of LINK, so whatever two links connect is a neighbour.
2. Refinement. Each vector's list is joined with the lists of those on it, what it brings is compared,
   and each vector keeps its best.
   A vector whose whole list is linked to it is saturated: its list doubles, up to ``MOST_LIST``.
3. Threshold edges. Vectors connected in the graph are cut into blocks by their angle to a hub. By the
   triangle inequality, two blocks near the hub are linked throughout and two at very different angles
   not at all; the other pairs of blocks are compared exactly by matrix products. This counts every link
   inside a connected part, whatever the lists held, and is the exact way for groups larger than any
   list. Of the links only counts and a spanning forest leave a task.
4. Audit. One class of equal vectors in ``AUDIT``, by its number, is compared with all vectors of its label,
   in blocks. Each vector counts by the share of its own links that is found, and of those that end in its own component; vectors with few
   links and with many are averaged apart (by powers of two). While the least of these averages is
   below ``RECALL``, new projections are added; after ``MOST_ATTEMPTS`` the query fails.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, vectors
without a label and rows without an id link with nothing (0 links, their own component); vectors
of different lengths do not link; rows that repeat an id and vector are counted as further vectors, and rows
with one id and different vectors or labels link each by its own;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shuffle_partitions, table, written
from lodestone.llm.components import components

LINK = 0.98
GUIDE = 2 * LINK * LINK - 1 - 1e-9
TABLES, FIRST_LIST, MOST_LIST, ROUNDS = 8, 16, 64, 3
BLOCK, RUN, FURTHER = 256, 96, 20
AUDIT, RECALL, MOST_ATTEMPTS = 50, 0.99, 4
#: The angle of LINK, the width of a band of angles, and a margin far above the error of a computed angle.
ANGLE, SURE = math.acos(LINK), 1e-6
BAND = ANGLE / 16


def matrix(column: pa.Array) -> np.ndarray:
    raw = [np.frombuffer(v.as_buffer(), np.float64) for v in column]
    return np.stack(raw) if raw else np.zeros((0, 0))


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, unit (doubles of length 1, as bytes) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, out = [], [], []
            for i, v in enumerate(batch.column("embedding")):
                x = None if not v.is_valid or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is None or v.values.null_count or not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()
                keep.append(i)
                dims.append(len(x))
                out.append((x / math.sqrt(float(x @ x)) + 0.0).tobytes())
            taken = batch.select(["vec_id", "label"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "unit"])

    known = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "label", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return known.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, unit binary")


def codes(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Each class once for each projection table: part (table, label, dim), code, further (more bits of it), at (a further projection), node, unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x = matrix(rows.column("unit"))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * (bits + FURTHER + 1)))
                projected = (x @ planes[dim]).reshape(len(x), tables, bits + FURTHER + 1)
                code = ((projected[:, :, :bits] > 0) << np.arange(bits)).sum(2)
                further = ((projected[:, :, bits:-1] > 0) << np.arange(FURTHER)).sum(2)
                for t in range(tables):
                    n = len(x)
                    columns = [pa.array(np.full(n, t, np.int32)), rows.column("label"), rows.column("dim"), pa.array(code[:, t].astype(np.int64)), pa.array(further[:, t].astype(np.int64)), pa.array(projected[:, t, -1]), rows.column("node"), rows.column("unit")]
                    yield pa.RecordBatch.from_arrays(columns, ["table", "label", "dim", "code", "further", "at", "node", "unit"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dim", "node", "unit").mapInArrow(run, f"table int, label {label}, dim int, code long, further long, at double, node long, unit binary")


def best(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, most: int) -> np.ndarray:
    """Which edges are among the ``most`` best of a or of b."""
    keep = np.zeros(len(a), bool)
    for end in (a, b):
        order = np.lexsort((-cosine, end))
        head = np.flatnonzero(np.concatenate([[True], end[order][1:] != end[order][:-1]])) if len(a) else np.zeros(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
        keep[order[rank < most]] = True
    return keep


def first_neighbours(coded: DataFrame) -> DataFrame:
    """u, v, cosine (u < v): guide edges within blocks of equal codes."""

    def edges(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        cosine = x @ x.T
        i, j = np.nonzero(np.triu(cosine >= GUIDE, 1))
        i, j, c = nodes[i], nodes[j], cosine[i, j]
        a, b = np.minimum(i, j), np.maximum(i, j)
        keep = best(a, b, c, FIRST_LIST)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(c[keep])], ["u", "v", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, units_ = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("table", "label", "dim", "code")), strict=True))
            ids = batch.column("node").to_numpy()
            raw = batch.column("unit")
            for i, key in enumerate(keys):
                if key != last or len(nodes) == RUN:
                    if len(nodes) > 1:
                        yield edges(np.array(nodes), np.stack(units_))
                    # within a long run, blocks overlap by half
                    half = RUN // 2 if key == last else len(nodes)
                    nodes, units_, last = nodes[half:], units_[half:], key
                nodes.append(ids[i])
                units_.append(np.frombuffer(raw[i].as_py(), np.float64))
        if len(nodes) > 1:
            yield edges(np.array(nodes), np.stack(units_))

    by = ["table", "label", "dim", "code"]
    runs = coded.repartition(shuffle_partitions(coded.sparkSession), *by).sortWithinPartitions(*by, "further", "at")
    return runs.mapInArrow(run, "u long, v long, cosine double").groupBy("u", "v").agg(F.max("cosine").alias("cosine"))


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) with a cosine of GUIDE or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("ij,ij->i", matrix(batch.column("x")), matrix(batch.column("y"))) if batch.num_rows else np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(cosine)], ["u", "v", "cosine"])
            yield out.filter(pa.array(cosine >= GUIDE))

    one = classes.select(F.col("node").alias("u"), F.col("unit").alias("x"))
    two = classes.select(F.col("node").alias("v"), F.col("unit").alias("y"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long, cosine double")


def lists(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Both directions of edges (u < v), each node's best as many as its list holds. sizes: node, most."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))
    rank = Window.partitionBy("u").orderBy(F.desc("cosine"), "v")
    both = both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= MOST_LIST)
    both = both.join(sizes.select(F.col("node").alias("u"), "most"), "u", "left").withColumn("most", F.coalesce("most", F.lit(FIRST_LIST)))
    return both.where("rank <= most").select("u", "v", "cosine", "most")


def refined(edges: DataFrame, classes: DataFrame, rounds: int) -> DataFrame:
    """NN-descent rounds over edges (u < v, cosine)."""
    sizes = edges.select(F.col("u").alias("node"), F.lit(FIRST_LIST).alias("most")).limit(0)
    known = written(edges, "neighbours")
    for _ in range(rounds):
        listed = written(lists(known, sizes), "neighbour-lists")
        # each list with the lists of those on it: both are bounded, however many lists a vector is on
        there = listed.select("u", F.col("v").alias("by"))
        onward = listed.select(F.col("u").alias("by"), "v")
        met = there.join(onward, "by").where("u <> v")
        pairs = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        more = compared(pairs.join(known, ["u", "v"], "left_anti"), classes)
        grown = written(known.unionByName(more), "neighbours")
        full = listed.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"), F.first("most").alias("most"))
        saturated = (F.col("n") == F.col("most")) & (F.col("least") >= LINK)
        sizes = full.select(F.col("u").alias("node"), F.when(saturated, F.least(2 * F.col("most"), F.lit(MOST_LIST))).otherwise(F.col("most")).alias("most"))
        before, known = known, grown
        if known.count() == before.count():
            break
    return known


def packed(rows: DataFrame, by: list[str], size: int, *more: Column, columns: tuple[str, ...] = ("node", "copies", "unit")) -> DataFrame:
    """Rows (by, ``columns``) in blocks by a hash of the node: by, block, held, and what ``more`` aggregates. A block has about ``size`` rows at most.

    Only counts of ``by`` decide how many blocks there are, so no task sees all rows of one value.
    """
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    rows = rows.join(counts, by).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")))
    held = F.sort_array(F.collect_list(F.struct(*columns))).alias("held")
    return rows.groupBy(*by, "block").agg(held, *more)


def held_matrix(held: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = held.values
    return values.field("node").to_numpy(), values.field("copies").to_numpy(), matrix(values.field("unit"))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[q] = p
            out.append((x, y))
    return out


def angles(rows: DataFrame) -> DataFrame:
    """Rows (root, node, copies, unit, hub) with the angle between unit and hub, and its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(sizes := np.array([len(x.as_buffer()) for x in batch.column("unit")], np.int64)).tolist():
                own = batch.filter(pa.array(sizes == dim))
                cosine = np.einsum("ij,ij->i", matrix(own.column("unit")), matrix(own.column("hub")))
                angle = np.arccos(np.clip(cosine, -1, 1))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("root", "node", "copies", "unit")), pa.array(angle), pa.array((angle / BAND).astype(np.int32))], ["root", "node", "copies", "unit", "angle", "band"])

    return rows.select("root", "node", "copies", "unit", "hub").mapInArrow(run, "root long, node long, copies long, unit binary, angle double, band int")


def threshold_edges(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, n: n links of u where v is null, else an edge of a forest that connects what the links connect.

    A connected part is cut into blocks of vectors at about one angle to its hub. Two blocks whose angles
    sum to less than the link's are linked throughout, and two whose angles are further apart than it are
    not at all; neither is compared. The pairs that are left are compared by matrix products.
    """
    part = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    part = part.unionByName(part.select(F.col("root").alias("node"), "root")).distinct()
    rows = written(classes.join(part, "node").select("root", "node", "copies", "unit"), "vector-parts")
    hubs = rows.where("node = root").select("root", F.col("unit").alias("hub"))
    ranged = written(angles(rows.join(hubs, "root")), "vector-angles")
    blocks = packed(ranged, ["root", "band"], BLOCK, F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("total"), F.min("node").alias("first"))
    blocks = written(blocks.withColumn("name", F.struct("band", "block")), "vector-blocks")

    def side(i: int) -> DataFrame:
        return blocks.select("root", *(F.col(c).alias(f"{c}{i}") for c in ("name", "low", "high", "total", "first")))

    pairs = side(1).join(side(2), "root").where("name1 <= name2").where(F.greatest(F.col("low1") - F.col("high2"), F.col("low2") - F.col("high1")) <= ANGLE + SURE)
    pairs = written(pairs.withColumn("sure", F.col("high1") + F.col("high2") <= ANGLE - SURE), "block-pairs")
    sure, open_ = pairs.where("sure"), pairs.where("NOT sure")
    # whole blocks that are linked: counts by block; every member has an edge to one block it is linked to, and each pair of blocks has one edge
    gain = sure.select("root", F.col("name1").alias("name"), F.col("total2").alias("gain"), F.col("first2").alias("mate"), (F.col("name1") == F.col("name2")).alias("own"))
    gain = gain.unionByName(sure.where("name1 <> name2").select("root", F.col("name2").alias("name"), F.col("total1").alias("gain"), F.col("first1").alias("mate"), F.lit(False).alias("own")))
    gain = gain.groupBy("root", "name").agg(F.sum("gain").alias("gain"), F.min("mate").alias("mate"), F.max("own").alias("own"))
    members = blocks.select("root", "name", F.explode("held").alias("x")).join(gain, ["root", "name"])
    members = members.select(F.col("x.node").alias("u"), "mate", (F.col("gain") - F.when(F.col("own"), F.col("x.copies")).otherwise(0)).alias("n"))
    whole = members.where("n > 0").select("u", F.lit(None).cast("long").alias("v"), "n")
    ties = members.where("u <> mate").select("u", F.col("mate").alias("v")).unionByName(sure.where("name1 <> name2").select(F.col("first1").alias("u"), F.col("first2").alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("same")[i].as_py()
                n1, c1, x1 = held_matrix(batch.column("h1")[i])
                n2, c2, x2 = held_matrix(batch.column("h2")[i])
                linked = x1 @ x2.T >= LINK
                if same:
                    np.fill_diagonal(linked, False)
                counts = [(n1, linked @ c2)] if same else [(n1, linked @ c2), (n2, linked.T @ c1)]
                a, b = np.nonzero(linked)
                tree = forest(n1[a], n2[b])
                u = np.concatenate([*(n[c > 0] for n, c in counts), np.array([x for x, _ in tree], np.int64)])
                n = np.concatenate([*(c[c > 0] for _, c in counts), np.zeros(len(tree), np.int64)])
                v = [None] * (len(u) - len(tree)) + [y for _, y in tree]
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v, pa.int64()), pa.array(n.astype(np.int64))], ["u", "v", "n"])

    held = lambda i: blocks.select("root", F.col("name").alias(f"name{i}"), F.col("held").alias(f"h{i}"))
    matched = open_.select("root", "name1", "name2").join(held(1), ["root", "name1"]).join(held(2), ["root", "name2"]).select((F.col("name1") == F.col("name2")).alias("same"), "h1", "h2")
    compared_ = matched.mapInArrow(run, "u long, v long, n long")
    return compared_.unionByName(whole).unionByName(ties.withColumn("n", F.lit(0).cast("long")))


def audit(classes: DataFrame, found: DataFrame, every: int = AUDIT) -> float:
    """The recall of ``found`` (node, n, root) for every ``every``-th vector, by brute force in blocks.

    Of each vector the share of its own links that are counted, and the share of them that are in its own
    component, whichever is less; averaged over the vectors with as many links (by powers of two). The
    least average, so that a large group does not hide what isolated pairs have lost.
    """
    rooted = classes.join(found.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    asked = rooted.where(F.col("node") % every == 0)
    columns = ("node", "copies", "root", "unit")
    blocks = packed(rooted, ["label", "dim"], 4 * BLOCK, columns=columns).withColumnRenamed("held", "all")
    queries = packed(asked, ["label", "dim"], 4 * BLOCK, columns=columns).select("label", "dim", F.col("held").alias("some"))

    def told(held: pa.StructScalar) -> tuple[np.ndarray, ...]:
        return *(held.values.field(c).to_numpy() for c in columns[:-1]), matrix(held.values.field("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, _, root, x = told(batch.column("some")[i])
                others, copies, theirs, y = told(batch.column("all")[i])
                linked = (x @ y.T >= LINK) & (nodes[:, None] != others[None, :])
                tied = linked & (root[:, None] == theirs[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array((m @ copies).astype(np.int64)) for m in (linked, tied))], ["node", "n", "tied"])

    true = queries.join(blocks, ["label", "dim"]).select("some", "all").mapInArrow(run, "node long, n long, tied long")
    true = true.groupBy("node").agg(F.sum("n").alias("n"), F.sum("tied").alias("tied"))
    held = true.join(found.select("node", F.col("n").alias("have")), "node", "left")
    share = F.least("n", F.coalesce("have", F.lit(0)), "tied") / F.col("n")
    by_size = held.where("n > 0").groupBy(F.floor(F.log2("n")).alias("size")).agg(F.avg(share).alias("recall"))
    least = by_size.agg(F.min("recall").alias("least")).first()["least"]
    return 1.0 if least is None else least


def tables_for(bits: int) -> int:
    """So many projection tables that an isolated pair at the angle of LINK shares a code in one of them with a chance of 0.995."""
    agree = (1 - ANGLE / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(0.005) / math.log1p(-agree)))


def near_duplicates(vectors: DataFrame, audit_every: int = AUDIT) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    able = written(units(vectors), "units")
    classes = able.groupBy("label", "dim", "unit").agg(F.min("vec_id").cast("long").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a number of its own for each class, since an id may come with several vectors
    named = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    classes = named.drop("least")
    bits = max(1, min(40, round(math.log2(max(1, classes.count()) / 64))))
    edges = None
    for attempt in range(MOST_ATTEMPTS):
        start = first_neighbours(codes(classes, tables_for(bits), bits, attempt))
        if edges is not None:
            start = start.unionByName(edges).groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
        edges = refined(start, classes, ROUNDS)
        told = written(threshold_edges(classes, edges), "links")
        counts = told.where(F.col("v").isNull()).groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
        root = components(told.where(F.col("v").isNotNull()).select(F.col("u").alias("a"), F.col("v").alias("b")))
        found = classes.select("node").join(counts, "node", "left").join(root, "node", "left")
        found = written(found.select("node", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root")), "vector-links")
        recall = audit(classes, found, audit_every)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"op2_nn_descent: recall {recall:.4f} of audited vectors after {MOST_ATTEMPTS} attempts, {RECALL} is needed")
    named = named.join(found, "node")
    named = written(named.select("label", "dim", "unit", "root", "least", (F.col("n") + F.col("copies") - 1).alias("n_links")), "vector-roots")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root", "least")
    found = able.join(named, ["label", "dim", "unit"]).select("vec_id", "n_links", "component_id")
    # whatever cannot link has no row above
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able_too = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = vectors.where(~able_too).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
