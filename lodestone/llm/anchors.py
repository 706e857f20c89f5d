"""Substring dedup by fixed-block anchors.

The reference blocks are the documents' non-overlapping blocks of ``BLOCK`` words; every rolling
window of as many words probes them. Any ``WINDOW`` consecutive words hold a whole block, as
2 * BLOCK - 1 <= WINDOW, so of two equal windows each has a hit: its own block, which the other's
rolling window meets, or the rolling window that meets the other's block. A hit is extended over
the WINDOW-word windows around it, which are confirmed by the hash of all their words; confirmed
windows that overlap make up the maximal exact repeats, and their words are removed.

Three passes over texts: block probes, confirmation (only documents with hits), removal (the
same documents). Both searches are packed shuffles of positions.py, where a passage that very
many documents share counts once a slice.

Defined results: a null or blank text has no words (0, 0, SHA-256 of the empty string); rows that
repeat each other repeat all their windows; a null doc_id is kept; an empty table gives no rows;
columns besides doc_id and text are left alone. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shuffle_partitions, table, written
from lodestone.llm.positions import SCHEMA, repeated, send, slice_name, unpack_places
from lodestone.llm.words import inside, rolling, words

WINDOW = 35
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def block_of(window: int) -> int:
    return (window + 1) // 2


def named_rows(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text: rows that are equal have one rid."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text, F.length(text)).alias("rid"), "doc_id", text.alias("text"))


def block_probes(rows: DataFrame, block: int) -> DataFrame:
    """Every rolling window of ``block`` words, flagged where it is a reference block."""
    partitions = shuffle_partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for part in words(batch.column("text")):
                places = np.flatnonzero(inside(part.first, block))
                keys = rolling(part.hashes, block)[places]
                own = np.searchsorted(part.first, places, "right") - 1
                aligned = (places - part.first[own]) % block == 0
                yield from send(slice_name(number), partitions, rids[part.rows], part.first, keys, places, 5, aligned)
                number += 1

    return rows.select("rid", "text").mapInArrow(run, SCHEMA)


def around(hits: np.ndarray, block: int, window: int, n: int) -> np.ndarray:
    """The starts of the windows of a row of n words that hold a hit."""
    if n < window:
        return np.zeros(0, np.int64)
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, np.clip(hits + block - window, 0, n - window + 1), 1)
    np.add.at(change, np.clip(hits + 1, 0, n - window + 1), -1)
    return np.flatnonzero(np.cumsum(change[: n - window + 1]) > 0)


def window_probes(met: DataFrame, block: int, window: int) -> DataFrame:
    """The windows around the hits of rows (rid, text, places)."""
    partitions = shuffle_partitions(met.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            rids, hits = batch.column("rid").to_numpy(), batch.column("places")
            for part in words(batch.column("text")):
                size = np.diff(part.first)
                starts = [around(unpack_places(hits[part.rows.start + i].as_buffer()), block, window, int(size[i])) + part.first[i] for i in range(len(part))]
                places = np.concatenate(starts).astype(np.int64)
                yield from send(slice_name(number), partitions, rids[part.rows], part.first, rolling(part.hashes, window)[places], places, 8)
                number += 1

    return met.select("rid", "text", "places").mapInArrow(run, SCHEMA)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places lie in a window."""
    change = np.zeros(n + 1, np.int64)
    change[starts] += 1
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:n]) > 0


def kept_words(text: str, starts: np.ndarray, window: int) -> tuple[int, list[str]]:
    """How many words a text has, and those outside the windows at ``starts``."""
    found = _WORD.findall(text)
    if not len(starts):
        return len(found), found
    stays = ~covered(starts, window, len(found))
    return len(found), [found[i] for i in np.flatnonzero(stays).tolist()]


RESULT = ["n_words", "n_removed", "kept_sha256", "kept"]


def results(rows: list[tuple[int, list[str]] | None], keep_text: bool) -> list[pa.Array]:
    out = []
    for row in rows:
        if row is None:
            out.append((None, None, None, None))
            continue
        n, left = row
        kept = " ".join(left)
        out.append((n, n - len(left), hashlib.sha256(kept.encode()).hexdigest(), kept if keep_text else None))
    columns = zip(*out, strict=True) if out else [()] * 4
    return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]


def settle(rows: DataFrame, keep_text: bool) -> DataFrame:
    """Rows (rid, doc_id, text, places) with the result of those without places; the others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            clean = pc.is_null(batch.column("places"))
            texts = pc.if_else(clean, batch.column("text"), None).to_pylist()
            done = results([None if t is None else kept_words(t, none, 1) for t in texts], keep_text)
            left = pc.if_else(clean, None, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), left, batch.column("places"), *done], ["rid", "doc_id", "text", "places", *RESULT])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, text string, places binary, n_words long, n_removed long, kept_sha256 string, kept string"
    return rows.select("rid", "doc_id", "text", "places").mapInArrow(run, schema)


def strip(rows: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """The results of rows (doc_id, text, places: confirmed windows or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("places"), strict=True)
            done = [kept_words(t, unpack_places(p.as_buffer()) if p.is_valid else none, window) for t, p in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *results(done, keep_text)], ["doc_id", *RESULT])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "places").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept: the text that is left, if asked for."""
    block = block_of(window)
    rows = named_rows(docs)
    hits = written(repeated(block_probes(rows, block), 5, flagged=True), "anchor-hits")
    settled = written(settle(rows.join(hits, "rid", "left"), keep_text), "anchor-rows")
    met = settled.where(F.col("text").isNotNull()).select("rid", "doc_id", "text", "places")
    confirmed = written(repeated(window_probes(met, block, window), 8, flagged=False), "anchor-windows")
    stripped = strip(met.drop("places").join(confirmed, "rid", "left"), window, keep_text)
    return settled.where(F.col("text").isNull()).select(stripped.columns).unionByName(stripped)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
