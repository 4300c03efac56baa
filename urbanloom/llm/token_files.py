"""Directly addressable codes: token ids in byte levels with continuation bitmaps and rank directories.

A file holds the ids of consecutive documents. Level 0 has the low byte of every id; an id that needs more
sets its bit in the level's bitmap, and its next byte stands in the next level at the bit's rank. Ranks come
from a directory of counts (one for each 512 bits), so any single id is read without decoding a block.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAGIC = b"ULDAC\x00\x00\x01"
RANK_BITS = 512
#: Ids in a file before it is closed: bounds a worker's memory.
FILE_IDS = 1_000_000
#: Entries of a worker's cache of encoded words.
CACHE_WORDS = 200_000
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One file: header, document table (id, null flag, number of ids), then the levels."""
    head = [MAGIC, struct.pack("<QQ", len(counts), ids.size)]
    head.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    head.append(np.array([d is None for d in doc_ids], "u1").tobytes())
    head.append(np.array(counts, "<u8").tobytes())
    levels, rest = [], ids.astype("<u4", copy=False)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-bits.size % (RANK_BITS // 8), "u1")])
        ones = np.bitwise_count(bits).astype("u8").reshape(-1, RANK_BITS // 8).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if ones.size else np.zeros(0, "<u8")
        levels.append((rest.astype("u1"), bits, ranks))
        rest = rest[more] >> 8
        if not rest.size:
            break
    head.append(struct.pack("<Q", len(levels)))
    for chunks, bits, ranks in levels:
        head += [struct.pack("<QQQ", chunks.size, bits.size, ranks.size), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(head)


class TokenFile:
    """A file's bytes, read in place: random access by id(i), whole ranges by ids(a, b)."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids = struct.unpack_from("<QQ", data, 8)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.no_id = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        (n_levels,) = struct.unpack_from("<Q", data, at)
        at += 8
        self.levels = []
        for _ in range(n_levels):
            a, b, c = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((np.frombuffer(data, "u1", a, at), np.frombuffer(data, "u1", b, at + a), np.frombuffer(data, "<u8", c, at + a + b)))
            at += a + b + 8 * c

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        if i // RANK_BITS >= ranks.size:
            return int(np.bitwise_count(bits).sum())
        from_byte = i // RANK_BITS * (RANK_BITS // 8)
        whole = int(np.bitwise_count(bits[from_byte : i // 8]).sum())
        return int(ranks[i // RANK_BITS]) + whole + int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count()

    def id(self, i: int) -> int:
        """The i-th id: one byte and one bit from each level that it reaches."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 as unsigned 32-bit integers, level by level."""
        out = np.zeros(stop - start, "<u4")
        where = slice(None)
        index = np.arange(stop - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if stop <= start:
                break
            out[index[where]] |= chunks[start:stop].astype("<u4") << np.uint32(8 * k)
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first :][: stop - start].astype(bool)
            index, where = index[where][more], slice(None)
            start, stop = self._rank(bits, ranks, start), self._rank(bits, ranks, stop)
        return out


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Marks that the vocabulary's splitter never joins to the letters before them (an apostrophe it may).
TAIL_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: The settings of a vocabulary whose texts may be encoded piece by piece.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_as_assumed(path: str) -> bool:
    """Whether the vocabulary's file has the normaliser and splitter that WordEncoder's pieces rely on."""
    with open(path, encoding="utf-8") as source:
        held = json.load(source)
    split, *more = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = all(not a["normalized"] and not a["lstrip"] and not a["rstrip"] and a["content"].startswith("<|") for a in held.get("added_tokens") or [])
    levels = [(x["type"], x.get("use_regex"), x.get("add_prefix_space")) for x in more] == [("ByteLevel", False, False)]
    model = held.get("model") or {}
    return (held.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True and levels and plain and model.get("type") == "BPE" and not model.get("dropout")


class WordEncoder:
    """Text to ids with the tokenizers library, which is asked once for each distinct blank-free piece.

    So it is where splits_as_assumed(); texts under any other vocabulary go to the library whole. The vocabulary's normaliser and splitter never join characters over an ASCII blank, so the ids of a text
    are those of its pieces in order; it lower-cases, so pieces are held in lower case, unless the text may
    have a special token's string. Letters with marks behind them are two pieces to the splitter, and letters
    that the normaliser leaves alone go to the library's model directly. Pieces met lately are kept in two
    generations of at most CACHE_WORDS.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.by_piece = splits_as_assumed(path)
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _letters(self, piece: bytes) -> bytes:
        """Ids of a piece of letters, by the model alone if the normaliser leaves the piece as it is."""
        if piece.isascii():
            tokens = self.model.tokenize(piece.decode())
        else:
            text = piece.decode("utf-8", "replace")
            if text.lower() != text or not unicodedata.is_normalized("NFC", text):
                return self._whole(piece)
            tokens = self.model.tokenize("".join(map(self.letters.__getitem__, piece)))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _whole(self, piece: bytes) -> bytes:
        ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, piece: bytes) -> bytes:
        core = piece.rstrip(TAIL_MARKS)
        if not core or not (core.isalpha() if core.isascii() else core.decode("utf-8", "replace").isalpha()) or core != core.lower():
            return self._whole(piece)
        ids = self.known.get(core) or self.older.get(core) or self._letters(core)
        if len(core) < len(piece):
            self.known[core] = ids
            tail = piece[len(core) :]
            rest = self.known.get(tail) or self._whole(tail)
            self.known[tail] = rest
            ids += rest
        return ids

    def __call__(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return self._whole(text)
        pieces = (text if b"<|" in text else text.lower()).split()
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known, self.older = {}, self.known
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    found[i] = self.known[piece] = self.known.get(piece) or self.older.get(piece) or self._encode(piece)
        return b"".join(found)


@cache
def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: its cache serves all of the worker's tasks."""
    return WordEncoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes `text` (null: empty) and writes files in ascending doc_id order (null first); returns their manifest.

    docs needs doc_id and text; other columns are not read. Documents are dealt by ranges of doc_id; each task
    writes its own files under names of its own, and only files of the manifest, which the tasks that counted
    returned, are ever read: a repeated or lost task leaves at most unread files. Columns: part, seq, path,
    n_docs, n_ids, base (ids before the file). An empty table gives an empty manifest.
    """
    schema = "part long, seq long, path string, n_docs long, n_ids long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = worker_encoder(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), 0
        system, root = _filesystem(folder)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, counts, blobs, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, doc_ids, counts, blobs, held
            path = f"{root}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(path) as out:
                out.write(encode_file(doc_ids, counts, np.frombuffer(b"".join(blobs), "<u4")))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(counts), "n_ids": held}])
            seq, doc_ids, counts, blobs, held = seq + 1, [], [], [], 0
            return row

        system.create_dir(root, recursive=True)
        for batch in common.small_batches(batches, "body"):
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                blob = encode(body) + end
                doc_ids.append(doc_id)
                counts.append(len(blob) // 4)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= file_ids:
                    yield close()
        if counts:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body"))
    ordered = common.bound_batches(rows).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("body"))
    manifest = common.store(ordered.mapInArrow(write, schema))
    # Offsets in two steps: over the parts (as many as partitions), then over a part's files.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("_in", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part").select(
        "part", "seq", "path", "n_docs", "n_ids", (F.col("_base") + F.col("_in")).alias("base")
    )


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(row["path"]) as source:
                    held = TokenFile(source.read())
                ends = np.cumsum(held.counts.astype("i8"))
                starts = ends - held.counts.astype("i8")
                ids = held.ids(0, held.n_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.doc_ids, pa.int64(), mask=held.no_id),
                        pa.array(starts + row["base"], pa.int64()),
                        pa.array(held.counts.astype("i8"), pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A fixed number of tasks: the manifest's rows are tiny, but each stands for a whole file.
    files = manifest.count()
    tasks = max(1, min(files, manifest.sparkSession.sparkContext.defaultParallelism), files // 64)
    return manifest.repartition(tasks, "path").mapInArrow(read, schema)


def token_files(docs: DataFrame) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files hold, a row for each document.

    Null and empty texts hold the end id alone; rows with equal doc_id stay in an order fixed by their text.
    """
    folder = common.scratch_dir(docs.sparkSession)
    return read_files(write_files(docs, folder), folder)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, as read back from the token files."""
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
