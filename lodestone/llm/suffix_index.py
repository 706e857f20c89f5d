"""Suffix-array dedup with a logarithmic family of indexes.

Texts are UTF-8 bytes; bytes covered by a ``WINDOW``-byte string that starts anywhere else too
are removed. Sparse suffix arrays do the search. Each window's suffix is taken at its anchor: the
place in the window where the hash of 16 bytes is least (leftmost of equals), which depends on the
window's bytes alone, so equal windows have anchors at equal distances. Of a window's bytes, at
least half lie after its anchor or at least half before it; an anchor is therefore filed twice, by
the ``HALF`` bytes that follow and, for the reversed text, by the ``HALF`` bytes before. Entries stand in suffix
order: by their first sixteen bytes, suffixes that agree in those by the hash of all ``HALF``, and equal ones by
their place. Suffixes with a common prefix of ``HALF`` bytes are therefore neighbours, and one that a third of all
rows share spreads over partitions. A suffix array is a stored table of the distinct keys in that order, in packed segments.

The corpus comes in batches (by a hash of the row; a few more the larger it is). Each is sorted once, in a pass that
decides which of its own entries have neighbours. Its suffix array is then merge-scanned with every level of the
family (``Family``): segments that overlap are searched in each other, so old levels are dealt
out by packed segments and none of their entries is sorted again. Levels of equal size merge by one streaming merge of their segments, so a corpus of n batches has at
most log2(n) + 1 levels and an entry is rewritten as often. A later session can open the family and scan further batches.
Anchors that the scans find mark the windows to be confirmed. Where the bytes of all windows of an anchor
occur again as a whole, they all are; the windows of other anchors go by the hash of all their bytes
through the packed search of positions.py, against one anchor for each context that occurs again.
Confirmed windows that overlap are the removed runs.

Defined results: a null or empty text has 0 bytes and the SHA-256 of nothing; rows that repeat each
other are removed whole if they have ``WINDOW`` bytes; a null doc_id is kept; an empty table gives
no rows; columns besides doc_id and text are left alone; runs may cut characters, so what is kept
is bytes. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.anchors import covered, named_rows
from lodestone.llm.common import shared_dir, shuffle_partitions, table, written
from lodestone.llm.positions import SCHEMA, repeated, send, slice_name, unpack_places
from lodestone.llm.words import byte_slices, inverse, mix, powers

WINDOW, HALF, GRAM = 400, 200, 16
LEAST_BATCH = 4_000_000
SLICE = 1 << 20
_U = np.uint64
_BASE = _U(0x9FB21C651E98DF25)
_BACK = inverse(_BASE)
_VALUE = mix(np.arange(301, 557, dtype=np.uint64))


class Bytes:
    """Hashes of any stretches of a run of bytes."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, n), out=self.total[1:])
        self.back = powers(_BACK, n + 1)

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.back[start])

    def anchors(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the windows that lie in one row, and the anchor of each."""
        w, n = window - GRAM + 1, len(self.data)
        size = np.diff(at)
        starts = np.arange(max(0, n - window + 1))
        starts = starts[np.arange(window, window + len(starts)) <= np.repeat(at[1:], size)[: len(starts)]]
        if not len(starts):
            return starts, starts
        grams = n - GRAM + 1
        gram = (self.total[GRAM:] - self.total[:-GRAM]) * self.back[:grams]
        # the hash above, the place below: least hash, then leftmost
        rank = (mix(gram) >> _U(32) << _U(32)) | np.arange(grams, dtype=np.uint64)
        # least of each w in a row, from running minima of blocks of w, forward and backward
        blocks = np.full(-(-grams // w) * w, ~_U(0), np.uint64)
        blocks[:grams] = rank
        blocks = blocks.reshape(-1, w)
        forward = np.minimum.accumulate(blocks, 1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(backward[starts], forward[starts + w - 1])
        return starts, (least & _U(0xFFFFFFFF)).astype(np.int64)


def ordered(data: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Eight bytes from ``at`` on (step 1) or back (step -1), as a number in their order."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | data[at + step * k].astype(np.uint64)
    return (out ^ _U(1 << 63)).view(np.int64)  # the order of signed numbers


#: A suffix entry: bytes 1 to 8 and 9 to 16 of the suffix, a hash of HALF bytes, and where it stands.
ORDER = ["one", "two", "key", "rid", "place"]
ENTRY = "one long, two long, key long, rid long, place int"


def suffixes(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The suffix entries of rows (rid, text)."""
    half = window // 2

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            rids = batch.column("rid").to_numpy()
            for part, data, at in byte_slices(batch.column("text"), SLICE):
                if len(data) < window:
                    continue
                text = Bytes(data)
                anchors = np.unique(text.anchors(at, window)[1])
                own = np.searchsorted(at, anchors, "right") - 1
                ahead, behind = anchors + half <= at[own + 1], anchors - half >= at[own]
                place = np.concatenate([anchors[ahead], anchors[behind]])
                rid = rids[part][np.concatenate([own[ahead], own[behind]])]
                heads = [np.concatenate([ordered(data, anchors[ahead] + k, 1), ordered(data, anchors[behind] - 1 - k, -1)]) for k in (0, 8)]
                keys = np.concatenate([text.hashes(anchors[ahead], half), ~text.hashes(anchors[behind] - half, half)])
                place = place - np.concatenate([at[own[ahead]], at[own[behind]]])
                yield pa.RecordBatch.from_arrays([*(pa.array(h) for h in heads), pa.array(keys.view(np.int64)), pa.array(rid), pa.array(place.astype(np.int32))], ORDER)

    return rows.select("rid", "text").mapInArrow(run, ENTRY)


def in_order(entries: DataFrame) -> DataFrame:
    """Suffix order, over all partitions: by bytes, then key, then place, so that a suffix that very many rows share is split between partitions."""
    return entries.repartitionByRange(shuffle_partitions(entries.sparkSession), *ORDER).sortWithinPartitions(*ORDER)


MET, EDGE, OPEN, KEYS = 0, 1, 2, 3
SEGMENT_COLUMNS = "part int, n int, first binary, last binary, packed binary"
SCANNED = f"kind int, {ENTRY}, {SEGMENT_COLUMNS}"
SEGMENT, LEAST_PART, MOST_PARTS, MANY = 1 << 14, 2048, 1 << 12, -1
NAME = "S24"


def names_of(one: np.ndarray, two: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Suffix keys as 24 bytes that compare as the three numbers do."""
    out = np.empty((len(one), 24), np.uint8)
    for i, part in enumerate((one, two, key)):
        out[:, 8 * i : 8 * i + 8] = (part.view(np.uint64) ^ _U(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view(NAME)


def told(kind: int, part: pa.RecordBatch) -> pa.RecordBatch:
    n = part.num_rows
    empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *part.columns, *empty], ["kind", *ORDER, "part", "n", "first", "last", "packed"])


class Group:
    """The group that a partition's scan stands in: how many entries, and the one not yet told."""

    def __init__(self, at_start: bool):
        self.n, self.at_start, self.held = 0, at_start, []

    def take(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.n += part.num_rows
        self.held.append(part)
        if self.n > 1:
            yield from (told(MET, x) for x in self.held)
            self.held = []

    def close(self, last: pa.RecordBatch, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.at_start or at_end:
            yield told(EDGE, last.slice(last.num_rows - 1))
            yield from (told(OPEN, x) for x in self.held)


class Segments:
    """Distinct keys that come in order, packed into segments that end at the bounds of parts.

    A key with one entry goes with its place, a key with more with MANY: its entries have met.
    """

    def __init__(self, bounds: np.ndarray, size: int):
        self.bounds, self.size, self.chunks, self.n = bounds, size, [], 0

    def add(self, names: np.ndarray, rid: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        if self.chunks and len(names) and self.chunks[-1][0][-1] == names[0]:  # goes on
            self.chunks[-1][2][-1] = MANY
            names, rid, place = names[1:], rid[1:], place[1:]
        if len(names):
            self.chunks.append((names, rid, place.copy()))
            self.n += len(names)
        if self.n >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """part, n, first, last, packed of each segment."""
        if not self.chunks:
            return
        names, rid, place = (np.concatenate(x) for x in zip(*self.chunks, strict=True))
        self.chunks, self.n = [], 0
        part = np.searchsorted(self.bounds, names, "right")
        cuts = np.union1d(np.flatnonzero(part[1:] != part[:-1]) + 1, np.arange(0, len(names), self.size)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(names)], strict=True):
            # byte by byte, so that what neighbours share is packed well
            planes = names[i:j].view(np.uint8).reshape(-1, 24).T.tobytes()
            yield int(part[i]), j - i, bytes(names[i]), bytes(names[j - 1]), planes + rid[i:j].astype("<i8").tobytes() + place[i:j].astype("<i4").tobytes()


def unpacked(raw: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 24 * n).reshape(24, n).T).reshape(-1).view(NAME)
    return names, np.frombuffer(raw, "<i8", n, 24 * n), np.frombuffer(raw, "<i4", n, 32 * n)


def segment_rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for values in found:
        columns = [pa.array([KEYS], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.int32()), *(pa.array([v], t) for v, t in zip(values, types, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", *ORDER, "part", "n", "first", "last", "packed"])


def scan(batch: DataFrame, bounds: np.ndarray) -> DataFrame:
    """One pass over a batch's entries in suffix order: those that met a neighbour (MET), what the partitions' ends leave open (EDGE, OPEN), and the distinct keys (KEYS), a suffix array in packed segments.

    Neighbours that agree in 16 bytes and in the hash of ``HALF`` have a common prefix of ``HALF`` bytes or
    more and form a group. A group inside a partition is decided there. The groups at its two ends may go
    on in the next partition: their keys are gathered, two rows a partition, and a single entry waits for
    the answer. No more than a batch of rows and a segment are held, however long a group is.
    """
    most = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, before, segments = None, None, None, Segments(bounds, most)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            one, two, key, rid, place = (batch.column(c).to_numpy() for c in ORDER)
            names = names_of(one, two, key)
            other = np.ones(n, bool)
            other[1:] = names[1:] != names[:-1]
            other[0] = group is None or names[0] != before
            head = np.flatnonzero(other)
            runs = head if other[0] else np.concatenate([[0], head])
            lengths = np.diff(np.append(runs, n))
            yield from segment_rows(segments.add(names[runs], rid[runs], np.where(lengths > 1, MANY, place[runs]).astype(np.int32)))
            cut = int(head[0]) if len(head) else n
            if cut:
                yield from group.take(batch.slice(0, cut))
            if len(head):
                if group is not None:
                    yield from group.close(batch.slice(0, cut) if cut else last, False)
                size = np.diff(np.append(head, n))
                good = size > 1
                good[-1] = False  # may go on
                start = 0
                if group is None and len(head) > 1:  # the partition's first group ends here
                    opening = Group(True)
                    yield from opening.take(batch.slice(0, int(head[1])))
                    yield from opening.close(batch.slice(0, int(head[1])), False)
                    good[0], start = False, 1
                inner = np.flatnonzero(np.repeat(good, size)) + cut
                if len(inner):
                    yield told(MET, batch.take(pa.array(inner)))
                group = Group(group is None and not start)
                yield from group.take(batch.slice(int(head[-1])))
            last, before = batch, names[-1]
        if group is not None:
            yield from group.close(last, True)
        yield from segment_rows(segments.flush())

    return in_order(batch.select(*ORDER)).mapInArrow(run, SCANNED)


def met_inside(seen: DataFrame) -> DataFrame:
    """rid, place of the entries of scan() that share a long prefix with another of their batch."""
    # a key at an edge is met if two partitions have it; two rows a partition are few enough to broadcast
    edges = seen.where(F.col("kind") == EDGE).groupBy("one", "two", "key").agg(F.count(F.lit(1)).alias("ends"))
    edges = edges.where("ends > 1").select("one", "two", "key")
    waiting = seen.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["one", "two", "key"], "left_semi")
    return seen.where(F.col("kind") == MET).select("rid", "place").unionByName(waiting.select("rid", "place"))


def met_between(fresh: DataFrame, levels: DataFrame) -> DataFrame:
    """rid, place of the single entries of either side whose key the other has.

    Segments of one part whose ranges overlap are merge-scanned; both are stored in order, so segments are dealt out by part as they are and no entry is sorted again.
    """
    ours, theirs = (side.select("part", *(F.col(c).alias(f"{c}{i}") for c in ("n", "first", "last", "packed"))) for i, side in ((1, fresh), (2, levels)))
    pairs = theirs.join(ours.hint("shuffle_hash"), "part").where("first1 <= last2 AND first2 <= last1").select("n1", "packed1", "n2", "packed2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n1, raw1, n2, raw2 in zip(*batch.columns, strict=True):
                one, two = unpacked(raw1.as_buffer(), n1.as_py()), unpacked(raw2.as_buffer(), n2.as_py())
                for (names, rid, place), others in ((one, two[0]), (two, one[0])):
                    at = np.minimum(np.searchsorted(others, names), len(others) - 1)
                    hit = np.flatnonzero((others[at] == names) & (place != MANY))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(place[hit])], ["rid", "place"])

    return pairs.mapInArrow(run, "rid long, place int")


def merged(segments: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The segments of several levels as those of one. Segments come by their first keys; keys before the next first are final."""
    most = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = None, None, Segments(bounds, most)

        def settled(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            names, rid, place = (x[:upto] for x in held)
            held = tuple(x[upto:] for x in held)
            if upto:
                other = np.concatenate([[True], names[1:] != names[:-1]])
                head = np.flatnonzero(other)
                many = np.diff(np.append(head, upto)) > 1
                yield from segment_rows(out.add(names[head], rid[head], np.where(many, MANY, place[head]).astype(np.int32)))

        for batch in batches:
            for own, n, first, raw in zip(*(batch.column(c) for c in ("part", "n", "first", "packed")), strict=True):
                if held is not None:
                    yield from settled(int(np.searchsorted(held[0], np.array([first.as_py()], NAME))[0]) if own.as_py() == part else len(held[0]))
                part, more = own.as_py(), unpacked(raw.as_buffer(), n.as_py())
                both = more if held is None else tuple(np.concatenate(x) for x in zip(held, more, strict=True))
                order = np.argsort(both[0], kind="stable")  # two runs in order: one merge
                held = tuple(x[order] for x in both)
        if held is not None:
            yield from settled(len(held[0]))
        yield from segment_rows(out.flush())

    rows = segments.repartition(shuffle_partitions(segments.sparkSession), "part").sortWithinPartitions("part", "first")
    return rows.select("part", "n", "first", "packed").mapInArrow(run, SCANNED)


def bounds_of(entries: DataFrame) -> np.ndarray:
    """Where the parts of a family end: every eighth of a hash sample of some 8 * MOST_PARTS distinct keys at most."""
    parts = min(MOST_PARTS, (n := entries.count()) // LEAST_PART)
    if parts < 2:
        return np.zeros(0, NAME)
    sample = entries.where(F.pmod(F.xxhash64("one", "two", "key"), F.lit(max(1, n // (8 * parts)))) == 0).select("one", "two", "key").distinct().collect()
    columns = [np.array([r[i] for r in sample], np.int64) for i in range(3)]
    return np.sort(names_of(*columns))[4::8]


class Family:
    """A logarithmic family of suffix arrays in a folder: levels of packed, ordered segments of distinct keys, at most one of each size but the newest.

    A new batch gets its suffix array, is merge-scanned against all levels, and becomes a level; levels of
    equal size merge first. Segments end at the bounds of parts, which the first batch sets, so that a batch's
    segments meet those of the same part only, and what is in order stays so. The list of levels is a small table
    of its own for each state, written last, so that ``Family.open`` finds the newest whole state, in this session or a later one.
    """

    def __init__(self, spark: SparkSession, folder: str, levels: list[tuple[int, str]], state: int, bounds: np.ndarray | None = None):
        self.spark, self.folder, self.levels, self.state, self.bounds = spark, folder, levels, state, bounds

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None) -> Family:
        return cls(spark, folder or f"{shared_dir(spark)}/lodestone/suffix-family-{uuid.uuid4().hex}", [], 0)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Family:
        """The family in ``folder`` as its last finished batch left it."""
        states = spark.read.parquet(f"{folder}/states/*")
        state = states.agg(F.max("state")).first()[0]
        rows = states.where(F.col("state") == state).orderBy("at").collect()  # a row for each level
        return cls(spark, folder, [(r["size"], r["path"]) for r in rows], state, np.frombuffer(bytes(rows[0]["bounds"]), NAME))

    def _stored(self, rows: DataFrame) -> str:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def level(self, path: str) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(path).where(F.col("kind") == KEYS).select("part", "n", "first", "last", "packed")

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-scan the entries of a batch against all levels, then take them in. rid, place of those that met, old ones too."""
        if self.bounds is None:
            self.bounds = bounds_of(batch)
        levels = list(self.levels)
        while len(levels) > 1 and levels[-1][0] == levels[-2][0]:
            (n, one), (m, two) = levels.pop(), levels.pop()
            levels.append((n + m, self._stored(merged(self.level(one).unionByName(self.level(two)), self.bounds))))
        fresh = self._stored(scan(batch, self.bounds))
        found = met_inside(self.spark.read.schema(SCANNED).parquet(fresh))
        if levels:
            known = self.level(levels[0][1])
            for _, path in levels[1:]:
                known = known.unionByName(self.level(path))
            found = found.unionByName(met_between(self.level(fresh), known))
        found = written(found.distinct(), "suffix-found")
        levels.append((1, fresh))
        state = self.spark.createDataFrame([(self.state + 1, i, n, path, self.bounds.tobytes()) for i, (n, path) in enumerate(levels)], "state int, at int, size int, path string, bounds binary")
        state.coalesce(1).write.parquet(f"{self.folder}/states/{self.state + 1}")
        self.levels, self.state = levels, self.state + 1
        return found


def ranges(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal anchors (windows with one anchor stand in a row)."""
    head = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return head, np.append(head[1:], len(anchors)) - 1


def marked(at: np.ndarray, lists: pa.Array, n: int) -> np.ndarray:
    """Which of n bytes the rows' lists of places name."""
    out = np.zeros(n + 1, bool)
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    out[lists.flatten().to_numpy() + np.repeat(at[:-1], sizes)] = True
    return out


def contexts(met: DataFrame, window: int) -> DataFrame:
    """The found anchors of rows (rid, text, anchors): rid, place, context, ahead, behind.

    context: a hash of all bytes of all windows that have the anchor; ahead, behind: the keys by which it was filed.
    """
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, found = batch.column("rid").to_numpy(), batch.column("anchors")
            for part, data, at in byte_slices(batch.column("text"), SLICE):
                if len(data) < window:
                    continue
                hit = marked(at, found.slice(part.start, part.stop - part.start), len(data))
                text = Bytes(data)
                starts, anchors = text.anchors(at, window)
                first, last = ranges(anchors)
                kept = hit[anchors[first]]
                place, first, last = anchors[first[kept]], starts[first[kept]], starts[last[kept]]
                end = last + window
                context = mix((text.total[end] - text.total[first]) * text.back[first] ^ mix(((end - first) << 20 | (place - first)).astype(np.uint64)))
                own = np.searchsorted(at, place, "right") - 1
                ahead, behind = place + half <= at[own + 1], place - half >= at[own]
                keys = [text.hashes(np.where(ok, p, 0), half).view(np.int64) for ok, p in ((ahead, place), (behind, place - half))] if len(place) else [place, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[part][own]), pa.array((place - at[own]).astype(np.int32)), pa.array(context.view(np.int64)), pa.array(keys[0], mask=~ahead), pa.array(keys[1], mask=~behind)],
                    ["rid", "place", "context", "ahead", "behind"])

    return met.select("rid", "text", "anchors").mapInArrow(run, "rid long, place int, context long, ahead long, behind long")


def sorted_out(found: DataFrame) -> DataFrame:
    """rid, whole, open of rows of contexts().

    whole: anchors whose context occurs again, so all their windows do. open: anchors whose windows are to
    be compared one by one: those of a context that occurs once, and one for each other context that
    shares a key with a different one. A passage with thousands of copies is opened once, not for each.
    """
    # as tables, so that adaptive execution can split the joins: a passage may bring a third of all rows under one key
    classes = written(found.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place")).alias("first")), "suffix-classes")
    keyed = found.select("context", F.explode(F.array("ahead", "behind")).alias("key")).where(F.col("key").isNotNull())
    groups = keyed.groupBy("key").agg(F.min("context").alias("low"), F.max("context").alias("high"))
    shared = written(groups.where("low <> high").select("key"), "suffix-shared")
    out = found.join(classes, "context")
    for key in ("ahead", "behind"):
        out = out.join(shared.select(F.col("key").alias(key), F.lit(True).alias(f"mixed_{key}")), key, "left")
    mixed = F.coalesce("mixed_ahead", "mixed_behind", F.lit(False))
    one = (F.col("n") == 1) | (F.col("first") == F.struct("rid", "place"))
    out = out.select("rid", "place", (F.col("n") > 1).alias("whole"), (mixed & one).alias("open")).where("whole OR open")
    return out.groupBy("rid").agg(F.collect_set(F.when(F.col("whole"), F.col("place"))).alias("whole"), F.collect_set(F.when(F.col("open"), F.col("place"))).alias("open"))


def windows_of(data: np.ndarray, at: np.ndarray, lists: pa.Array, window: int) -> tuple[Bytes | None, np.ndarray]:
    """The starts of the windows whose anchors the rows' lists name."""
    if len(data) < window:
        return None, np.zeros(0, np.int64)
    text = Bytes(data)
    starts, anchors = text.anchors(at, window)
    return text, starts[marked(at, lists, len(data))[anchors]]


def window_probes(met: DataFrame, window: int) -> DataFrame:
    """The windows of rows (rid, text, open) with an open anchor."""
    partitions = shuffle_partitions(met.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            rids, found = batch.column("rid").to_numpy(), batch.column("open")
            for part, data, at in byte_slices(batch.column("text"), SLICE):
                text, starts = windows_of(data, at, found.slice(part.start, part.stop - part.start), window)
                if len(starts):
                    yield from send(slice_name(number), partitions, rids[part], at, text.hashes(starts, window), starts, 8)
                number += 1

    return met.select("rid", "text", "open").mapInArrow(run, SCHEMA)


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
_RESULT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_RESULT_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def result(text: bytes, starts: np.ndarray | None, window: int, keep: bool) -> tuple:
    n, spans, kept = len(text), 0, text
    if starts is not None and len(starts):
        gone = covered(starts, window, n)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep else None


def settle(rows: DataFrame, keep: bool) -> DataFrame:
    """Rows (rid, doc_id, text, anchors) with the result of those without anchors; the others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pc.is_null(batch.column("anchors"))
            texts = pc.if_else(clean, batch.column("text"), None).cast(pa.binary())
            done = [result(t.as_py(), None, 1, keep) if t.is_valid else (None,) * 5 for t in texts]
            columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [()] * 5, _RESULT_TYPES, strict=True)]
            left = pc.if_else(clean, None, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), left, batch.column("anchors"), *columns], ["rid", "doc_id", "text", "anchors", *RESULT])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("rid", "doc_id", "text", "anchors").mapInArrow(run, f"rid long, doc_id {kind}, text string, anchors array<int>, {_RESULT_SCHEMA}")


def strip(rows: DataFrame, window: int, keep: bool) -> DataFrame:
    """The results of rows (doc_id, text, whole: anchors or null, places: confirmed windows or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, whole = batch.column("places"), batch.column("whole")
            for part, data, at in byte_slices(batch.column("text"), SLICE):
                n = part.stop - part.start
                starts = windows_of(data, at, whole.slice(part.start, n), window)[1]
                edge = np.searchsorted(starts, at)
                done = []
                for i in range(n):
                    own, more = starts[edge[i] : edge[i + 1]] - at[i], places[part.start + i]
                    if more.is_valid:
                        own = np.union1d(own, unpack_places(more.as_buffer()))
                    done.append(result(data[at[i] : at[i + 1]].tobytes(), own, window, keep))
                columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), _RESULT_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, n), *columns], ["doc_id", *RESULT])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "whole", "places").mapInArrow(run, f"doc_id {kind}, {_RESULT_SCHEMA}")


def batches_for(entries: int) -> int:
    """Batches that a corpus given at once is cut into: one more whenever it doubles, since each is scanned against all before it."""
    return 2 + (entries // LEAST_BATCH).bit_length()


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes that are left, if asked for."""
    rows = named_rows(docs)
    entries = written(suffixes(rows, window), "suffix-entries")
    batches = batches or batches_for(entries.count())
    family, found = Family.new(docs.sparkSession), []
    for batch in range(batches):
        found.append(family.add(entries.where(F.pmod("rid", F.lit(batches)) == batch)))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("rid").agg(F.collect_set("place").alias("anchors"))
    settled = written(settle(rows.join(hits, "rid", "left"), keep), "suffix-rows")
    met = settled.where(F.col("text").isNotNull()).select("rid", "doc_id", "text", "anchors")
    told = written(sorted_out(written(contexts(met, window), "suffix-contexts")), "suffix-told")
    # a table, so that a task that runs again meets its rows in the same order and names its slices alike
    open_rows = written(met.join(told.where(F.size("open") > 0).select("rid", "open"), "rid"), "suffix-open")
    confirmed = written(repeated(window_probes(open_rows, window), 8, flagged=False), "suffix-windows")
    marks = told.select("rid", "whole").join(confirmed, "rid", "full")
    stripped = strip(met.drop("anchors").join(marks, "rid", "left"), window, keep)
    return settled.where(F.col("text").isNull()).select(stripped.columns).unionByName(stripped)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
