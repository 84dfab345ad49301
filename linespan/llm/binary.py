"""Operator 9: token ids in flat binary files.

Documents are dealt by ranges of doc_id, hash of the text and row, and sorted, so
rows that share an id, or have none, are split like all others.  Each task encodes
its range and writes three flat files to the shared folder: the ids (unsigned, 16 bits
where the vocabulary allows, else 32, little-endian), the 64-bit offsets of its
documents in them (one more than documents), and the 64-bit doc_ids.  A part is
written under a name of its own attempt and then renamed, so a repeated task
replaces it whole; what a lost attempt left is removed when all are written.  The
manifest has a row for each part; a running sum over it gives each part's base, so
nothing but the manifest is gathered.  Reading maps the files into memory, where the
store is a local or mounted folder, in as many tasks as there are parts.

Defined cases: null and empty texts have the end id alone; null doc_ids come
first, written as the smallest 64-bit number and read as null; repeated ids are
ordered by a hash of the text, and rows that are equal are interchangeable; an empty
table gives no part; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .scratch import Scratch
from .words import pieces, texts

TOKENIZER, END_ID, PIECE = "word_bpe_49k.json", 1, 4_000_000
NULL_ID = -(1 << 63)
PART = "part int, docs bigint, tokens bigint, path string, width int"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files below `uri`; returns the manifest (lazily: an action writes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, files, part = encoder(tokenizer_path), None, TaskContext.get().partitionId()
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                fs, root = _store(uri)
                fs.create_dir(root, recursive=True)
                name, tried = f"{root}/part-{part:05d}", f"{root}/_{uuid.uuid4().hex}"
                files = {k: fs.open_output_stream(f"{tried}.{k}") for k in ("ids", "offsets", "docs")}
                files["offsets"].write(np.zeros(1, "<i8").tobytes())
            data, offsets = texts(batch.column("text"))
            key = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")
            files["docs"].write(key.tobytes())
            n_docs += len(key)
            for a, b in pieces(offsets, PIECE):
                ids, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(enc.dtype.newbyteorder("<"))
                files["ids"].write(ids.tobytes())
                files["offsets"].write((n_tokens + ends + np.arange(1, b - a + 1)).astype("<i8").tobytes())
                n_tokens += len(ids)
        if files is not None:
            for k, f in files.items():
                f.close()
                fs.move(f"{tried}.{k}", f"{name}.{k}")
            row = {"part": [part], "docs": [n_docs], "tokens": [n_tokens], "path": [name], "width": [enc.dtype.itemsize]}
            schema = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("path", pa.string()), ("width", pa.int32())])
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    # Only rows that are equal in id and text are told apart by where they were read.
    order = ["doc_id", "_text", "_row"]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, PART)


def sweep(uri: str) -> None:
    """Remove what attempts that didn't end have left."""
    from pyarrow import fs

    store, root = _store(uri)
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("_"):
            store.delete_file(f.path)


def based(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each part; its rows are as many as tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _mapped(uri: str, path: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    store, _ = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32, in a task for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                offsets, key = _mapped(uri, p["path"] + ".offsets", "<i8"), _mapped(uri, p["path"] + ".docs", "<i8")
                ids = _mapped(uri, p["path"] + ".ids", f"<u{p['width']}")
                for a in range(0, len(key), 5_000):
                    o, k = np.asarray(offsets[a : a + 5_001]), np.asarray(key[a : a + 5_000])
                    crc = [zlib.crc32(np.asarray(ids[x:y], "<u4").tobytes()) for x, y in zip(o[:-1], o[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, mask=k == NULL_ID), pa.array(o[:-1] + p["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A number that is given isn't coalesced, however few bytes a manifest has.
    spread = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenized(spark, docs: DataFrame, tokenizer_path: str, name: str) -> DataFrame:
    """Write the files of docs and read them back."""
    scratch = Scratch(spark, name)
    uri = scratch.path("tokens")
    manifest = scratch.keep(write(docs, uri, tokenizer_path), "manifest")
    sweep(uri)
    return read(scratch.keep(based(manifest), "based"), uri)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenized(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER), "op9")


def stage_token_files(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, written in files and read back; documents that were mixed in more
    than once are written as often.  Null texts have the end id alone, an empty table no rows."""
    import public_tokenizers

    return tokenized(spark, docs, public_tokenizers.path(TOKENIZER), "pipeline-tokens")
