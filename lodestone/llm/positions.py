"""Finding window hashes that occur more than once, with their places, in packed shuffles.

A map task works in slices of its rows. For each slice it sends, to each of P partitions by
hash, one row with the hashes and the places of the slice's windows (packed: some seven bytes a
window), and once a row that names the slice's rows. A window that the slice itself repeats is
settled there: its places go on as found, and a single one stands for all of them towards other
slices. So a passage that a third of all rows share brings a partition no more than one window
a slice. A partition sorts what it has, finds the groups, and sends the places back to the slice
that they came from, where they become one row for each row of the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import shuffle_partitions

PROBES, FOUND, ROWS = 0, 1, 2
NAMES = ["to", "kind", "slice", "keys", "places"]
SCHEMA = "to int, kind int, slice long, keys binary, places binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def record(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], NAMES)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as gaps of four bytes, byte plane by byte plane, so that the upper planes compress away."""
    gaps = np.diff(places, prepend=0).astype("<u4")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_places(raw) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(raw, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def slice_name(number: int) -> int:
    """A name that a rerun of the task gives again."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 28) | number


def send(name: int, partitions: int, rids: np.ndarray, first: np.ndarray, keys: np.ndarray, places: np.ndarray, width: int, flags: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of one slice. keys: hashes of the windows at ``places`` (ascending). flags: one bit of each, kept with its key.

    The partition is taken from a hash's upper bits, and ``width`` bytes of the lower ones are sent.
    """
    if not len(keys):
        return
    yield record(name % partitions, ROWS, name, rids.astype("<i8").tobytes(), first.astype("<i8").tobytes())
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(head, len(ranked)))
    again = np.repeat(size > 1, size)
    if again.any():
        yield record(name % partitions, FOUND, name, None, pack_places(np.sort(places[order[again]])))
    if flags is not None:
        keys = keys & ~np.uint64(1)
        keys[order[head]] |= np.maximum.reduceat(flags[order], head).astype(np.uint64)
    sent = np.zeros(len(keys), bool)
    sent[order[head]] = True
    keys, places = keys[sent], places[sent]
    to = ((keys >> np.uint64(40)) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(partitions + 1))
    for p in range(partitions):
        if edge[p] < edge[p + 1]:
            mine = order[edge[p] : edge[p + 1]]
            yield record(p, PROBES, name, pack_keys(keys[mine], width), pack_places(places[mine]))


def repeated(sent: DataFrame, width: int, flagged: bool) -> DataFrame:
    """Of the windows sent, those whose key another one has (flagged: and one of which has the flag). Rows: rid, places (packed)."""
    partitions = shuffle_partitions(sent.sparkSession)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, raws = [], [], []
        for batch in batches:
            probe = batch.column("kind").to_numpy() == PROBES
            rest = batch.filter(pa.array(~probe))
            if rest.num_rows:
                yield rest.set_column(0, "to", pa.array((rest.column("slice").to_numpy() % partitions).astype(np.int32)))
            for i in np.flatnonzero(probe).tolist():
                keys.append(unpack_keys(batch.column("keys")[i].as_buffer(), width))
                names.append(batch.column("slice")[i].as_py())
                raws.append(batch.column("places")[i].as_py())
        if not keys:
            return
        ends = np.cumsum([len(k) for k in keys])
        all_keys = np.concatenate(keys)
        keys.clear()
        order = np.argsort(all_keys)
        ranked = all_keys[order]
        plain = ranked >> np.uint64(1) if flagged else ranked
        head = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        size = np.diff(np.append(head, len(plain)))
        good = size > 1
        if flagged:
            good &= np.maximum.reduceat(ranked & np.uint64(1), head) > 0
        hit = np.sort(order[np.repeat(good, size)])
        edge = np.searchsorted(hit, np.concatenate([[0], ends]))
        for i, name in enumerate(names):
            if edge[i] < edge[i + 1]:
                begin = ends[i - 1] if i else 0
                yield record(name % partitions, FOUND, name, None, pack_places(unpack_places(raws[i])[hit[edge[i] : edge[i + 1]] - begin]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = defaultdict(list)
        rows: dict[int, tuple] = {}
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                name = batch.column("slice")[i].as_py()
                if kind == ROWS:
                    rows[name] = tuple(np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in ("keys", "places"))
                else:
                    found[name].append(unpack_places(batch.column("places")[i].as_buffer()))
        for name, parts in found.items():
            rids, first = rows[name]
            places = np.unique(np.concatenate(parts))
            edge = np.searchsorted(places, first)
            own = np.flatnonzero(edge[1:] > edge[:-1])
            packed = [pack_places(places[edge[i] : edge[i + 1]] - first[i]) for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rids[own]), pa.array(packed, pa.binary())], ["rid", "places"])

    back = sent.repartitionById(partitions, "to").mapInArrow(match, SCHEMA).repartitionById(partitions, "to")
    return back.mapInArrow(gather, "rid long, places binary").dropDuplicates(["rid"])
