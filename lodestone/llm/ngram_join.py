"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct five-word shingles. Hashed into groups, the set is a point of
group counts, and the overlap of two sets is at most the sum over the groups of the smaller
count. Two documents link when 100 * overlap >= 75 * union, so they need an overlap of at least
75 / 175 of the sum of their sizes. The tree is laid out over Spark's partitions, from the top:

* Branches. With groups as fine as 48 bits of the shingle hash, a document hangs under its rarest
  coordinates: the first n - ceil(0.75 n) + 1 of them in a global order. If two points share
  none of those, the minima of all other coordinates cannot sum to the needed overlap. The order
  is by how many points have the coordinate, counted exactly (in packed shuffles, see
  ``branches``), then by hash. So coordinates of one point alone come first and make no row,
  and passages that many documents share come last, however many documents there are.
* Pages. Under a branch, entries are sorted by size and cut into pages of ``PAGE`` entries with
  bounding boxes: least and greatest size, the most that can still follow the branch's place in
  the order, and the greatest count in each group. Pages whose boxes' minima fall short are not
  opened together.
* Entries. Points of two pages are compared by the same three bounds, and the pairs that are
  left are verified on the shingle sets.

Equal sets are one entry (a class) from the start. Before pages are opened, each entry is
compared with the hub of its branch (the entry with the most shared branches) and with the entry before it; entries that these links
connect need no comparison any more, since only components are asked for. Pages of a branch
that is one component are never made, so a group of thousands of near copies costs a few
comparisons for each of its members. No pair of different components is left out.

Defined results: a text without words has an empty set, links with nothing, and is its own
component; fewer than five words are one shingle; a null doc_id takes part, but a component of
null ids alone has a null id; repeated rows are one class; an empty table gives no rows; columns
besides doc_id and text are left alone. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import numbered, shuffle_partitions, table, written
from lodestone.llm.components import components
from lodestone.llm.positions import pack_keys, pack_places, slice_name, unpack_keys, unpack_places
from lodestone.llm.words import mix, rolling, words

SHINGLE = 5
SLICE = 1 << 20
KEY_BYTES = 6
KEY = np.uint64((1 << 8 * KEY_BYTES) - 1)
LEAST_VECTOR, MOST_VECTOR = 16, 4096
PAGE, BOX = 128, 32


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each row."""
    for part in words(column, lower=True):
        first, n = part.first, len(part)
        whole = rolling(part.hashes, k)
        for i in range(n):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                found = np.unique(whole[a : b - k + 1])
            elif b > a:
                found = mix(rolling(part.hashes[a:b], b - a) + np.uint64(b - a))
            else:
                found = np.zeros(0, np.uint64)
            yield part.rows.start + i, found


def node_of(found: np.ndarray) -> int:
    """A 63-bit name of a set."""
    total = np.add.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D))) if len(found) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(found))], np.uint64))[0] >> np.uint64(1))


def needed(n):
    """The least overlap with a set of any size, and so the length of the prefix is n - needed(n) + 1."""
    return -(-75 * n // 100)


def vector(found: np.ndarray) -> bytes:
    """Group counts, in about a quarter as many groups as there are shingles; groups of half as many are unions of two."""
    size = min(MOST_VECTOR, max(LEAST_VECTOR, 1 << (max(1, len(found) // 4)).bit_length()))
    return np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32).astype("<u2" if len(found) < 1 << 16 else "<u4").tobytes()


def coarse_vector(found: np.ndarray) -> bytes:
    """Counts of BOX groups, for pages and their boxes."""
    return np.bincount((found & np.uint64(BOX - 1)).astype(np.int64), minlength=BOX).astype("<u4").tobytes()


def read_vector(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if n < 1 << 16 else "<u4").astype(np.int32)


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, txt, n, node, vec, coarse). txt: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(len(found), node_of(found), vector(found), coarse_vector(found)) for _, found in shingle_sets(batch.column("text"))]
            n, node, vec, coarse = zip(*held, strict=True) if held else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("txt"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(vec, pa.binary()), pa.array(coarse, pa.binary())],
                ["doc_id", "txt", "n", "node", "vec", "coarse"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("txt")).mapInArrow(run, f"doc_id {kind}, txt long, n long, node long, vec binary, coarse binary")


PROBES, FOUND, AGAIN, ROWS = 0, 1, 2, 3
_NAMES = ["to", "kind", "slice", "keys", "places", "counts"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_SCHEMA = "to int, kind int, slice long, keys binary, places binary, counts binary"


def _record(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], _NAMES)


def _home(name: int, partitions: int) -> int:
    return int(mix(np.array([name], np.uint64))[0] % np.uint64(partitions))


def probes(name: int, partitions: int, held: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows that a slice of sets sends. To each partition of keys: each of the slice's keys once, with the first
    set that has it and how many have it. To its home: the sets' names and sizes, and the other sets of such keys."""
    home, sizes = _home(name, partitions), np.array([len(x) for x in held])
    yield _record(home, ROWS, name, np.array(nodes, "<i8").tobytes(), None, sizes.astype("<i8").tobytes())
    keys, row = np.concatenate(held) & KEY, np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.zeros(len(keys), "<u4")
    counts[order[head]] = np.diff(np.append(head, len(keys)))
    rest = np.flatnonzero(counts == 0)
    if len(rest):
        yield _record(home, AGAIN, name, pack_keys(keys[rest], KEY_BYTES), pack_places(row[rest]), None)
    first = np.flatnonzero(counts)
    to = ((keys[first] >> np.uint64(24)) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(partitions + 1))
    for p in range(partitions):
        mine = first[order[edge[p] : edge[p + 1]]]
        if len(mine):
            many = None if counts[mine].max() == 1 else counts[mine].tobytes()
            yield _record(p, PROBES, name, pack_keys(keys[mine], KEY_BYTES), pack_places(row[mine]), many)


def shared_keys(batches: Iterator[pa.RecordBatch], partitions: int) -> Iterator[pa.RecordBatch]:
    """Of a partition of keys those that several sets have, sent to the homes of their slices with the number of these sets."""
    keys, counts, names, places = [], [], [], []
    for batch in batches:
        probe = batch.column("kind").to_numpy() == PROBES
        if not probe.all():
            yield batch.filter(pa.array(~probe))
        for i in np.flatnonzero(probe).tolist():
            keys.append(unpack_keys(batch.column("keys")[i].as_buffer(), KEY_BYTES))
            many = batch.column("counts")[i].as_py()
            counts.append(np.ones(len(keys[-1]), "<u4") if many is None else np.frombuffer(many, "<u4"))
            names.append(batch.column("slice")[i].as_py())
            places.append(batch.column("places")[i].as_py())
    if not keys:
        return
    ends = np.cumsum([0] + [len(k) for k in keys])
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    keys.clear(), counts.clear()
    order = np.argsort(all_keys)
    ranked = all_keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(np.add.reduceat(all_counts[order], head, dtype=np.int64), np.diff(np.append(head, len(order))))
    hit = np.flatnonzero(total > 1)
    edge = np.searchsorted(hit, ends)
    for i, name in enumerate(names):
        mine = hit[edge[i] : edge[i + 1]]
        if len(mine):
            yield _record(_home(name, partitions), FOUND, name, pack_keys(all_keys[mine], KEY_BYTES), pack_places(unpack_places(places[i])[mine - ends[i]]), total[mine].astype("<i8").tobytes())


def rarest(nodes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, row: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """The branches of a slice's sets. keys, row, count: the keys that other sets have too; a set's other keys come before them."""
    order = np.lexsort((keys, count, row))
    keys, row = keys[order], row[order]
    per = np.bincount(row, minlength=len(sizes))
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(sizes - per, per)
    kept = place < np.repeat(sizes - needed(sizes) + 1, per)
    row = row[kept]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[kept].view(np.int64)), pa.array(nodes[row]), pa.array(sizes[row].astype(np.int32)), pa.array((sizes[row] - place[kept]).astype(np.int32))],
        ["key", "node", "n", "rem"])


def branches(docs: DataFrame) -> DataFrame:
    """key, node, n, rem: each class under those of its rarest coordinates that others have too; rem: how many of its coordinates are not before the key.

    A map task works in slices of some ``SLICE`` coordinates. They meet in partitions by key, packed,
    and those that several sets have come back to their slice's home with their count.
    """
    partitions = shuffle_partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held, nodes, number, total = set(), [], [], 0, 0
        for batch in batches:
            for _, found in shingle_sets(batch.column("text")):
                node = node_of(found) if len(found) else 0
                if not len(found) or node in met:  # copies within a task say nothing new
                    continue
                met.add(node)
                held.append(found)
                nodes.append(node)
                total += len(found)
                if total >= SLICE:
                    yield from probes(slice_name(number), partitions, held, nodes)
                    held, nodes, number, total = [], [], number + 1, 0
        if held:
            yield from probes(slice_name(number), partitions, held, nodes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, again, rows = defaultdict(list), {}, {}
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                name, keys, places, counts = (batch.column(c)[i].as_py() for c in ("slice", "keys", "places", "counts"))
                if kind == ROWS:
                    rows[name] = np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")
                elif kind == AGAIN:
                    again[name] = keys, places
                else:
                    found[name].append((keys, places, counts))
        for name in list(found):
            raw = found.pop(name)
            keys, row = np.concatenate([unpack_keys(k, KEY_BYTES) for k, _, _ in raw]), np.concatenate([unpack_places(p) for _, p, _ in raw])
            count = np.concatenate([np.frombuffer(c, "<i8") for _, _, c in raw])
            if name in again:
                other = unpack_keys(again[name][0], KEY_BYTES)
                order = np.argsort(keys)
                count = np.concatenate([count, count[order[np.searchsorted(keys[order], other)]]])
                keys, row = np.concatenate([keys, other]), np.concatenate([row, unpack_places(again.pop(name)[1])])
            yield rarest(*rows.pop(name), keys, row, count)

    sent = docs.select("text").mapInArrow(send, _SCHEMA).repartitionById(partitions, "to")
    counted = sent.mapInArrow(lambda batches: shared_keys(batches, partitions), _SCHEMA).repartitionById(partitions, "to")
    return counted.mapInArrow(gather, "key long, node long, n int, rem int")


def may_link(n1, rem1, n2, rem2):
    """The bounds on sizes and on what can follow the branch, as columns."""
    fits = (75 * F.greatest(n1, n2) <= 100 * F.least(n1, n2)) & (175 * F.least(rem1, rem2) >= 75 * (n1 + n2))
    return fits


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of points (rows) in as many groups as the coarser has."""
    size = min(a.shape[-1], b.shape[-1])
    fold = lambda x: x if x.shape[-1] == size else x.reshape(*x.shape[:-1], -1, size).sum(-2)
    return np.minimum(fold(a), fold(b)).sum(-1)


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points' minima reach the needed overlap. points: node, n, vec."""
    left = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            va, vb = batch.column("va"), batch.column("vb")
            keep = [175 * overlap_bound(read_vector(va[i].as_buffer(), na[i]), read_vector(vb[i].as_buffer(), nb[i])) >= 75 * (na[i] + nb[i]) for i in range(len(na))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link. sets: node, hashes (sorted, as bytes)."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """node, hashes of the classes in ``owners`` (node, owner: doc_id and txt of a row of the class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for i, found in shingle_sets(batch.column("text")):
                if node_of(found) == nodes[i]:  # another text of the same id and hash would have another name
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), pa.array([found.tobytes()], pa.binary())], ["node", "hashes"])

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("txt"))
    # a repeated or null id alone does not say which text is meant
    same = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("txt") == F.col("owner.txt"))
    owned = own.join(owners.hint("shuffle_hash"), same)
    return owned.select("node", "text").mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def small_branches(entries: DataFrame) -> DataFrame:
    """opened_pages() for branches of one page: the entries are compared by the join itself."""
    one = entries.select("key", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("rem").alias("rem1"), F.col("root").alias("root1"))
    two = entries.select("key", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("rem").alias("rem2"), F.col("root").alias("root2"))
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("root1") != F.col("root2")) & may_link(F.col("n1"), F.col("rem1"), F.col("n2"), F.col("rem2")))
    return pairs.select("a", "b").distinct()


def opened_pages(entries: DataFrame, page: int = PAGE) -> DataFrame:
    """Pairs (a, b) of entries of different components under one branch that pass the bounds of pages and entries.

    entries: key, node, n, rem, root, coarse (counts of BOX groups).
    """
    order = Window.partitionBy("key").orderBy("n", "node")
    entries = entries.withColumn("page", F.floor((F.row_number().over(order) - 1) / page))
    entry = F.struct("node", "root", "n", "rem", "coarse")
    pages = entries.groupBy("key", "page").agg(
        F.collect_list(entry).alias("held"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rem").alias("rem"),
        F.min("root").alias("low"), F.max("root").alias("high"))
    one, two = (pages.select("key", *(F.col(c).alias(f"{c}{i}") for c in ("page", "held", "least", "most", "rem", "low", "high"))) for i in (1, 2))
    fits = (F.col("page1") <= F.col("page2")) & (75 * F.col("least2") <= 100 * F.col("most1"))
    fits &= 175 * F.least("rem1", "rem2") >= 75 * (F.col("least1") + F.col("least2"))
    fits &= ~((F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2")))
    pairs = one.join(two, "key").where(fits).select("held1", "held2")

    def points(held: pa.StructArray) -> tuple:
        numbers = [held.field(c).to_numpy().astype(np.int64) for c in ("node", "root", "n", "rem")]
        return *numbers, np.stack([np.frombuffer(v.as_buffer(), "<u4") for v in held.field("coarse")]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("held1"), batch.column("held2"), strict=True):
                node1, root1, n1, rem1, v1 = points(x.values)
                node2, root2, n2, rem2, v2 = points(y.values)
                if 175 * np.minimum(v1.max(0), v2.max(0)).sum() < 75 * (n1.min() + n2.min()):  # the boxes
                    continue
                total = n1[:, None] + n2[None, :]
                fits = (root1[:, None] != root2[None, :]) & (175 * np.minimum(rem1[:, None], rem2[None, :]) >= 75 * total)
                fits &= 75 * np.maximum(n1[:, None], n2[None, :]) <= 100 * np.minimum(n1[:, None], n2[None, :])
                i, j = np.nonzero(fits)
                for at in range(0, len(i), 4096):
                    p, q = i[at : at + 4096], j[at : at + 4096]
                    keep = 175 * np.minimum(v1[p], v2[q]).sum(1) >= 75 * total[p, q]
                    a, b = node1[p[keep]], node2[q[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = written(digests(docs), "ngram-digests")
    own = Window.partitionBy("key").orderBy("n", "node", F.desc("rem"))
    hung = branches(docs).withColumns({"prior": F.lag("node").over(own), "prior_n": F.lag("n").over(own), "prior_rem": F.lag("rem").over(own), "after": F.lead("node").over(own), "top": F.first("node").over(own)})
    # a class that several tasks met is there several times, side by side
    hung = hung.where(F.coalesce(F.col("prior") != F.col("node"), F.lit(True)) & ((F.col("top") != F.col("node")) | (F.col("after").isNotNull())))
    hung = written(hung.drop("after", "top"), "ngram-branches")
    # the entry with the most shared branches is the nearest to all others that a branch can name
    degree = hung.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hubs = hung.select("key", "node", "n", "rem").join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n", "rem")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.rem").alias("hub_rem"))

    def compared(rows: DataFrame, other: str) -> DataFrame:
        fits = may_link(F.col("n"), F.col("rem"), F.col(f"{other}_n"), F.col(f"{other}_rem")) & (F.col("node") != F.col(other))
        return rows.where(fits).select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b"))

    near = [compared(hung, "prior"), compared(hung.select("key", "node", "n", "rem").join(hubs, "key"), "hub")]
    points = rows.where(F.col("n") > 0).dropDuplicates(["node"]).select("node", "n", "vec", "coarse")
    first = written(bounded(near[0].unionByName(near[1]).distinct(), points), "ngram-pairs")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "txt"))
    owners = rows.where("n > 0").groupBy("node").agg(owner.alias("owner"))

    def linked(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = written(sets_of(docs, owners.join(involved, "node", "left_semi")), "ngram-sets")
        return written(verified(pairs, sets), "ngram-links")

    links = linked(first)
    root = components(links)
    entries = hung.select("key", "node", "n", "rem").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entries = written(entries, "ngram-entries")
    split = entries.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high").select("key", "held")
    mixed = entries.join(split, "key")
    mixed = written(mixed, "ngram-mixed")
    large = mixed.where(F.col("held") > PAGE).drop("held").join(points.select("node", "coarse"), "node")
    second = small_branches(mixed.where(F.col("held") <= PAGE)).unionByName(opened_pages(large)).distinct()
    second = written(bounded(written(second, "ngram-pairs"), points), "ngram-pairs")
    if not second.isEmpty():
        root = components(links.unionByName(linked(second)))
    named = rows.join(root, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (a null one last, then by text); rows without words stay."""
    rows = numbered(docs, "ngram-rows")
    found = join_components(rows.select(F.col("row").alias("doc_id"), "doc.text")).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("row"), "component_id")
    names = rows.select("row", F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("twin"))
    found = written(found.join(names, "row"), "ngram-found")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "twin", "row"))["row"]
    dropped = found.select("row").join(found.groupBy("component_id").agg(first.alias("row")).select("row"), "row", "left_anti")
    return rows.join(dropped, "row", "left_anti").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
