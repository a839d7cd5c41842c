"""Token-ID output: documents in doc_id order as flat unsigned integer files with 64-bit document offsets.

Text is range-partitioned by doc_id and sorted; each task encodes its documents and writes one file, then bases come
from prefix sums over the files' totals (one row a file). Files are written under a temporary name and renamed, and
their content depends on the partition only, so a task that runs again replaces its file by an equal one.

File ``part-NNNNN.tok``, little-endian: magic ``TMTOK2\\0\\0``; the ids (16 bits if the vocabulary fits, else 32); padding to 8; n + 1 64-bit
offsets in ids; n 64-bit doc_ids; n bytes, 1 where the doc_id is null; padding to 8; 64-bit id width in bytes; 64-bit document count n. So a
task streams its ids and holds 17 bytes a document; the number of files follows the size of the input. Local files are memory-mapped on reading; other stores are read whole, a file at a time.

Defined cases: null and empty texts are documents of one end id; repeated doc_ids are several documents, equal ones in
a row; null doc_ids come first; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, new_path, partitions_for

MAGIC = b"TMTOK2\0\0"
#: Encoded chunks in each of the two generations that a worker keeps.
CACHE = 500_000


class _Encoder:
    """A tokenizer with the chunks it has encoded lately; lives as long as its Python worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        size = self.tok.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: set[str]) -> None:
        """Encode each chunk with a space before it. They go through the tokenizer in one text, where each space starts a chunk."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        fresh = []
        for c in chunks:
            if c not in self.young:
                if c in self.old:
                    self.young[c] = self.old[c]
                else:
                    fresh.append(c)
        for i in range(0, len(fresh), 4000):
            part = fresh[i : i + 4000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cut = (np.flatnonzero(self.opens[ids]) * self.width).tolist()
            raw = ids.tobytes()
            self.young.update(zip(part, [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)], strict=True)], strict=True))


@lru_cache(maxsize=4)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


tk.KEPT.append(encoder.cache_clear)


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as packed integers.

    Byte-level BPE never merges across pre-tokens, and a single space before a non-space always starts one. So a text
    is cut at its spaces and each distinct chunk, with its space, goes through the tokenizer once. A text with a space
    before white space or at its end is encoded as it is, and so is one that holds a token added to the vocabulary, and the part of any text before its first
    space.
    """
    enc = encoder(path)
    cuts = [t.split(" ") if t and not (enc.added and enc.added.search(t)) else [t or ""] for t in texts]
    chunks: set[str] = set().union(*(c[1:] for c in cuts))
    odd = {c for c in chunks if not c or c[0].isspace()}
    enc.learn(chunks - odd)
    plain = [not odd or odd.isdisjoint(c[1:]) for c in cuts]
    out = enc.whole([c[0] if p else t or "" for c, t, p in zip(cuts, texts, plain, strict=True)])
    get = enc.young.__getitem__
    return [a + b"".join(map(get, c[1:])) if p and len(c) > 1 else a for a, c, p in zip(out, cuts, plain, strict=True)]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


class FileWriter:
    """Writes one file as its documents come: ids go out at once, 17 bytes a document wait for the end. Nothing is seen until :meth:`close`."""

    def __init__(self, path: str, dtype: str) -> None:
        self.fs, self.at = _filesystem(path)
        self.tmp = f"{self.at}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp, buffer_size=1 << 20)
        self.out.write(MAGIC)
        self.width = np.dtype(dtype).itemsize
        self.keys, self.nulls, self.counts = array("q"), bytearray(), array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.keys.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // self.width)
        self.out.write(ids)

    def close(self) -> tuple[int, int]:
        """Move the file into place; returns its numbers of documents and ids."""
        offsets = np.r_[0, np.cumsum(np.array(self.counts, np.int64))].astype("<i8")
        n, total = len(self.counts), int(offsets[-1])
        self.out.write(b"\0" * (-total * self.width % 8))
        self.out.write(offsets.tobytes() + np.array(self.keys, "<i8").tobytes() + bytes(self.nulls) + b"\0" * (-n % 8) + np.array([self.width, n], "<i8").tobytes())
        self.out.close()
        self.fs.move(self.tmp, self.at)
        return n, total


def open_file(path: str) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Offsets, doc_ids and ids of a file; the ids are a view on the mapped file if it is local."""
    fs, at = _filesystem(path)
    raw = np.memmap(at, np.uint8, mode="r") if isinstance(fs, pafs.LocalFileSystem) else np.frombuffer(fs.open_input_stream(at).read(), np.uint8)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"not a token file: {path}")
    width, n = raw[-16:].view("<i8").tolist()
    end = len(raw) - 16 - n - (-n % 8)
    keys, nulls, offsets = raw[end - 8 * n : end].view("<i8"), raw[end : end + n], raw[end - 8 * (2 * n + 1) : end - 8 * n].view("<i8")
    return offsets, [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], raw[8 : 8 + int(offsets[-1]) * width].view(f"<u{width}")


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` and write the files; returns the manifest ``(part, file, n_docs, n_tokens, base)``, one row a file.

    ``base`` is the number of ids in all files before it.
    """
    spark = docs.sparkSession
    if "://" not in out_dir or out_dir.startswith("file:"):
        fs, at = _filesystem(out_dir)
        fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        dtype = encoder(tokenizer_path).dtype
        end = np.array([end_id], dtype).tobytes()
        file, writer = f"{out_dir}/part-{number:05d}.tok", None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for key, ids in zip(part[0].to_pylist(), encode(part[1].to_pylist(), tokenizer_path), strict=True):
                    writer = writer or FileWriter(file, dtype)
                    writer.add(key, ids + end)
        if writer:
            n_docs, n = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "file": [file], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n], pa.int64())}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    n = partitions_for(docs)
    keyed = docs.select("doc_id", "text").withColumn("__h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "__h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__h")
    parts = materialize(ordered.select("doc_id", "text").mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-parts")
    # One row a file: the prefix sum over them is small whatever the documents are.
    rows, base = [], 0
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], r["file"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(rows, "part int, file string, n_docs long, n_tokens long, base long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, crc32 of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                offsets, keys, ids = open_file(file)
                for a in range(0, len(keys), 10_000):
                    off = offsets[a : a + 10_001].tolist()
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(off[:-1], off[1:], strict=True)]
                    start = np.array(off[:-1], np.int64)
                    cols = [pa.array(keys[a : a + 10_000], pa.int64()), pa.array(start + base), pa.array(np.diff(np.array(off, np.int64))), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "base")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_to_files(docs: DataFrame, tokenizer_path: str | None = None, out_dir: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back: :func:`read_tokens` over :func:`write_tokens`."""
    spark: SparkSession = docs.sparkSession
    return read_tokens(write_tokens(docs, tokenizer_path or default_tokenizer(), out_dir or new_path(spark, "tokens", keep=True)))
