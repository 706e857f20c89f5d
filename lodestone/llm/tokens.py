"""Token-id output: canonical length-limited Huffman coding of ids from global counts.

1. Every text is tokenised once; ids go to a table as 16- or 32-bit little-endian integers.
2. Ids are counted over all documents; code lengths come from package-merge with a limit,
   codes are canonical. The counts are one row per id of the vocabulary, whatever the corpus.
3. Documents are range-partitioned by doc_id and sorted; each partition packs whole documents
   into blocks of about BLOCK_IDS ids (a longer document has a block of its own) and writes
   one row per block: document ids, counts, the bit stream, and a bit offset for each
   CHECKPOINT ids, so that any part of a block decodes alone.
4. Reading goes the other way: a table of 2**limit entries gives symbol and length for the
   next bits; all stretches between checkpoints of a slice of blocks decode side by side.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows
with one doc_id keep a place each, ordered by their ids' bytes; an empty table writes files
without rows; other columns are left alone; a text of any length is coded whole.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, shuffle_partitions, table, written
from lodestone.llm.words import mix, words

END_ID = 1
BLOCK_IDS = 1 << 16
CHECKPOINT = 128
SLICE_IDS = 1 << 20
LIMIT = 16
CACHE_WORDS = 1_200_000
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_CLOSING = np.array([chr(b) in ".,;:!?" for b in range(256)])
_MARK_HASH = mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))
#: Byte to letter, as byte-level vocabularies write it: printable bytes stand for themselves, the rest from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
#: One for each Python worker, kept from task to task.
_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """A tokenizers file whose pre-tokeniser drops white space: the ids of a text are those of its words, end to end.

    Words are told apart by a 64-bit hash in an open-addressing table of up to CACHE_WORDS, which
    then starts anew; only words not met before go to the tokenizer, which lower-cases all of them. A closing mark after a letter
    is a word of its own to this end: letters and marks never share a pre-token.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.ids, self.at, self.n = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) % self.SLOTS
        return out

    def add(self, hashes: np.ndarray, fresh: list[str]) -> None:
        """hashes: distinct, none of them known."""
        number = np.arange(self.n, self.n + len(fresh), dtype=np.int32)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        open_ = np.arange(len(fresh))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = hashes[free]
            won = free[self.keys[slot[free]] == hashes[free]]
            self.values[slot[won]] = number[won]
            done = np.zeros(len(fresh), bool)
            done[won] = True
            open_ = open_[~done[open_]]
            slot[open_] = (slot[open_] + 1) % self.SLOTS
        made = self.encode_words(fresh)
        size = np.fromiter(map(len, made), np.int64, len(made))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.n += len(fresh)

    def encode_words(self, fresh: list[str]) -> list[list[int]]:
        """The ids of each word.

        To a word of lower-case letters alone, in composed form, the normaliser does nothing and the
        pre-tokeniser makes one piece of it: its bytes go to the model as they are.
        """
        tokenize = self.tokenizer.model.tokenize
        out: list[list[int] | None] = [None] * len(fresh)
        for i, word in enumerate(fresh):
            if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
                out[i] = [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, code in zip(rest, self.tokenizer.encode_batch_fast([fresh[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = code.ids
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, all their ids end to end, and how many each row has."""
        # special tokens are told apart by case, other words are not
        special = pc.any(pc.match_substring(column, "<|")).as_py()
        for part in words(column, lower=not special, without_last=True):
            start, end, hashes, data = part.start, part.end, part.hashes, part.data
            if len(start):
                # a word with a closing mark is two pieces
                mark = closes(data, start, end)
                hashes = np.stack([np.where(mark, part.without_last, hashes), np.where(mark, _MARK_HASH[data[end - 1]], np.uint64(0))], 1).ravel()
                real = np.stack([np.ones(len(mark), bool), mark], 1).ravel()
                start, end = np.stack([start, end - 1], 1).ravel()[real], np.stack([end - mark, end], 1).ravel()[real]
                hashes, owner = hashes[real], np.repeat(part.row_of_word(), 1 + mark)
                if self.n > CACHE_WORDS:
                    self.clear()
                word = self.find(hashes)
                if (lost := np.flatnonzero(word < 0)).size:
                    fresh, first = np.unique(hashes[lost], return_index=True)
                    raw = data.tobytes() if special else data.tobytes().lower()  # of bytes: ASCII letters only
                    self.add(fresh, [raw[start[i] : end[i]].decode("utf-8", "replace") for i in lost[first]])
                    word[lost] = self.find(hashes[lost])
                size = self.at[word + 1] - self.at[word]
                ends = np.cumsum(size)
                take = np.arange(int(ends[-1])) + np.repeat(self.at[word] - (ends - size), size)
                ids, per = self.ids[take], np.bincount(owner, size, len(part)).astype(np.int64)
            else:
                ids, per = np.zeros(0, np.uint32), np.zeros(len(part), np.int64)
            yield part.rows, ids, per


def closes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words end in one of .,;:!? right after a letter (ASCII, or of the Latin-1 supplement)."""
    long = end - start >= 2
    last, before = data[end - 1], data[np.maximum(end - 2, start)]
    lead = data[np.maximum(end - 3, start)]
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (end - start >= 3)
    return long & _CLOSING[last] & (_LETTER[before] | latin)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, wide: bool) -> DataFrame:
    """doc_id and ids (binary) of every row, the end id included."""
    kind = np.dtype("<u4" if wide else "<u2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        for batch in batches:
            for rows, ids, size in tokenizer.encode(batch.column("text")):
                at = np.cumsum(size)
                out = np.insert(ids, at, end_id).astype(kind)
                offsets = np.concatenate([[0], at + np.arange(1, len(at) + 1)]) * kind.itemsize
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, rows.stop - rows.start), binary.cast(pa.binary())], ["doc_id", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {id_type}, ids binary")


def id_counts(tokens: DataFrame, wide: bool) -> dict[int, int]:
    """How often each id occurs in all documents: at most one row per id of the vocabulary."""
    kind = np.dtype("<u4" if wide else "<u2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                part = np.bincount(np.frombuffer(value.as_buffer(), kind))
                if len(part) > len(total):
                    part, total = total, part.astype(np.int64)
                total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.toLocalIterator()}


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    leaves = sorted((n, i) for i, n in counts.items())
    if len(leaves) < 2:
        return {i: 1 for _, i in leaves}
    if len(leaves) > 1 << limit:
        raise ValueError(f"{len(leaves)} symbols do not fit codes of {limit} bits")
    # A package is (weight, leaves among the first of which it is made): as leaves are taken in
    # order, the number of leaves taken on each level says all.
    weight = np.array([n for n, _ in leaves], np.float64)
    level, taken = weight, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, pairs])
        order = np.argsort(merged, kind="stable")
        taken.append(order < len(weight))
        level = merged[order]
    need, length = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for is_leaf in reversed(taken):
        own = int(is_leaf[:need].sum())
        length[:own] += 1
        need = 2 * (need - own)
    length[:need] += 1
    return {i: int(n) for (_, i), n in zip(leaves, length, strict=True)}


def canonical_codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by id: shorter codes first, then by id."""
    code, size = np.zeros(max(lengths, default=0) + 1, np.uint32), np.zeros(max(lengths, default=0) + 1, np.uint8)
    at = last = 0
    for n, i in sorted((n, i) for i, n in lengths.items()):
        at <<= n - last
        code[i], size[i], last = at, n, n
        at += 1
    return code, size


def decode_table(lengths: dict[int, int], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each string of ``limit`` bits."""
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    at = 0
    for n, i in sorted((n, i) for i, n in lengths.items()):
        span = 1 << (limit - n)
        symbol[at : at + span], size[at : at + span] = i, n
        at += span
    return symbol, size


def pack(ids: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids``, and the bit offset of every CHECKPOINT-th of them."""
    n = size[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    # a code of 16 bits or fewer lies in three bytes; codes never share a bit, so sums are unions
    value = code[ids].astype(np.int64) << (24 - n - (at & 7))
    byte, total = at >> 3, (int(end[-1]) + 7) // 8 + 2
    stream = sum(np.bincount(byte + k, (value >> (16 - 8 * k)) & 255, total) for k in range(3))
    return stream.astype(np.uint8)[: total - 2].tobytes(), at[::CHECKPOINT]


def unpack(stream: np.ndarray, at: np.ndarray, count: np.ndarray, symbol: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """Decode stretches side by side. at: bit offsets in ``stream``; count: ids of each stretch."""
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint32)
    padded = np.concatenate([stream, np.zeros(8, np.uint8)]).astype(np.uint64)
    at = at.astype(np.int64)
    order = np.argsort(-count, kind="stable")
    at, first, count = at[order], first[order], count[order]
    for k in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -k, "left"))
        byte, off = at[:live] >> 3, (at[:live] & 7).astype(np.uint64)
        window = (padded[byte] << np.uint64(24)) | (padded[byte + 1] << np.uint64(16)) | (padded[byte + 2] << np.uint64(8)) | padded[byte + 3]
        seen = (window >> (np.uint64(32 - limit) - off)) & np.uint64((1 << limit) - 1)
        out[first[:live] + k] = symbol[seen]
        at[:live] += size[seen]
    return out


BLOCK_SCHEMA = "part int, block long, first long, doc_ids array<bigint>, n_tokens array<bigint>, n_ids long, bit_offsets array<bigint>, bits binary"


def encode_blocks(tokens: DataFrame, lengths: dict[int, int], wide: bool, partitions: int) -> DataFrame:
    """One row per block of documents, partitions in the order of doc_id."""
    kind = np.dtype("<u4" if wide else "<u2")
    code, size = canonical_codes(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0

        def row(docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.concatenate(parts)
            bits, at = pack(ids, code, size)
            values = [part, block, before, docs, [len(p) for p in parts], len(ids), at.tolist(), bits]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "first", "doc_ids", "n_tokens", "n_ids", "bit_offsets", "bits"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        docs: list = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(value.as_buffer(), kind)
                if docs and held + len(ids) > BLOCK_IDS:
                    yield row(docs, parts)
                    docs, parts, before, held, block = [], [], before + held, 0, block + 1
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if docs:
            yield row(docs, parts)

    ordered = tokens.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(encode, BLOCK_SCHEMA)


def decode_blocks(blocks: DataFrame, lengths: dict[int, int], limit: int) -> DataFrame:
    """part, place within the part, doc_id, n_tokens, ids (32-bit little-endian) for each document of the files."""
    symbol, size = decode_table(lengths, limit)
    names = ["part", "place", "doc_id", "n_tokens", "ids"]

    def several(batch: pa.RecordBatch) -> pa.RecordBatch:
        """All blocks of the batch, decoded side by side."""
        streams = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("bits")]
        base = np.concatenate([[0], np.cumsum([len(x) for x in streams])]) * 8
        n_ids = batch.column("n_ids").to_numpy()
        offsets = batch.column("bit_offsets")
        stretches = offsets.value_lengths().to_numpy()
        own = np.repeat(np.arange(len(n_ids)), stretches)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = offsets.flatten().to_numpy() + base[own]
        count = np.minimum(CHECKPOINT, n_ids[own] - nth * CHECKPOINT)
        ids = unpack(np.concatenate(streams), at, count, symbol, size, limit).astype("<u4")
        per = batch.column("n_tokens").flatten().to_numpy()
        docs = batch.column("n_tokens").value_lengths().to_numpy()
        ends = np.cumsum(per)
        place = np.repeat(batch.column("first").to_numpy() - (np.cumsum(n_ids) - n_ids), docs) + ends - per
        at = np.concatenate([[0], ends]) * 4
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
        part = np.repeat(batch.column("part").to_numpy(), docs)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(place, pa.int64()), batch.column("doc_ids").flatten(), pa.array(per, pa.int64()), binary], names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.cumsum(batch.column("n_ids").to_numpy()) // SLICE_IDS
            for edge in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
                yield several(batch.slice(int(edge[0]), len(edge)))

    columns = ["part", "first", "doc_ids", "n_tokens", "n_ids", "bit_offsets", "bits"]
    return blocks.select(columns).mapInArrow(decode, "part int, place long, doc_id long, n_tokens long, ids binary")


def part_starts(blocks: DataFrame) -> DataFrame:
    """part, part_start: the ids of all parts before. One row per range partition of the writer."""
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("part_start"))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, vocabulary: int = 49_408, limit: int = LIMIT) -> dict[int, int]:
    """Tokenise ``docs`` (doc_id, text) and write the coded files under ``path``; returns the code lengths."""
    spark = docs.sparkSession
    wide = max(vocabulary, end_id + 1) > 1 << 16
    tokens = written(token_table(docs, tokenizer_path, end_id, wide), "token-ids")
    lengths = code_lengths(id_counts(tokens, wide), limit)
    encode_blocks(tokens, lengths, wide, shuffle_partitions(spark)).write.parquet(f"{path}/blocks")
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").write.parquet(f"{path}/code")
    return lengths


def read_token_files(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) of each document, decoded from the files under ``path``."""
    lengths = {r["id"]: r["bits"] for r in spark.read.schema("id long, bits int").parquet(f"{path}/code").toLocalIterator()}
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    decoded = decode_blocks(blocks, lengths, limit)
    # the writer's partitions are few however large the corpus: a broadcast of two numbers each
    out = decoded.join(F.broadcast(part_starts(blocks)), "part")
    return out.select("doc_id", (F.col("part_start") + F.col("place")).alias("start"), "n_tokens", "ids")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, read them back, and give each document's digest."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lodestone/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_file())
    out = read_token_files(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
