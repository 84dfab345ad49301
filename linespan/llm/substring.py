"""Operator 8: exact substring dedup with fixed-block anchors.

A window is WINDOW consecutive words.  Non-overlapping blocks of BLOCK words of
every document are the index; with 2 * BLOCK - 1 <= WINDOW every window holds a
whole block of its own document.  Every rolling window of BLOCK words of every
document probes the index.  Around each hit the windows of WINDOW words are
compared, which extends hits to maximal repeats: a window goes to the smallest
document that has it, and its words are removed from every other.

Probes travel packed: a task sends one row of bytes to each bucket of hash
values (about BUCKET words each), not a row a word.  Of more than FAN buckets a piece
of text would send rows of a few windows; then probes go first to FAN shelves, where
they are packed anew by bucket, so rows stay long at any size.  What occurs very often is
counted first (at most HOT_MAX blocks and HOT_MAX other windows, broadcast):
frequent blocks are answered in the probing task and frequent windows that are no
document's block are dropped there, as they hit nothing.  What a bucket still
gets of one window is at most HOT occurrences and one a piece of text (a batch or
PIECE bytes), or, beyond HOT_MAX, twice a HOT_MAX-th of all words.  Windows around hits are
ordinary rows, combined before they are shuffled, in joins that Spark may split.

Windows are equal when two independent 64-bit hashes are (probes, which only choose
what is compared further, by one of them, of which a bucket keeps at least 48 bits).

Defined cases: null, empty and blank texts have no words and the hash of the
empty text; texts of fewer than WINDOW words lose nothing; of rows that repeat
a doc_id neither is smaller, so they don't remove each other's words; null ids
count as larger than all others among the removed and never as smaller; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, pieces, texts

WINDOW, BLOCK = 50, 25
BUCKET, PIECE, FAN = 2_000_000, 4_000_000, 8_192
HOT, HOT_MAX = 200, 1_000_000
LAST = (1 << 63) - 1
U = np.uint64


def _rows(batch: pa.RecordBatch, piece: int = 2_000_000) -> Iterator[tuple[Words, np.ndarray, int, int]]:
    data, offsets = texts(batch.column("text"))
    ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
    for a, b in pieces(offsets, piece):
        yield Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), ids[a:b], a, b


def frequent(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows that occur most often: more than HOT times, and at most HOT_MAX that
    are a block of some document and HOT_MAX that are none.  Counted are all blocks, and other
    windows where a piece has them more than once; a piece sends each hash once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, _, _, _ in _rows(batch, PIECE):
                at, h = w.windows(BLOCK)
                h, back, c = np.unique(h, return_inverse=True, return_counts=True)
                block = np.zeros(len(h), bool)
                block[back[(at - w.first[w.row[at]]) % BLOCK == 0]] = True
                keep = block | (c > 1)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep]), pa.array(block[keep])], ["h", "c", "block"])

    counted = docs.mapInArrow(count, "h bigint, c bigint, block boolean").groupBy("h").agg(F.sum("c").alias("c"), F.max("block").alias("block"))
    hot = scratch.keep(counted.where(f"c > {HOT}"), "hot")
    by_count = hot.groupBy("block", F.floor(F.log2("c")).alias("k")).count().orderBy("k").collect()  # at most 128 rows
    found = []
    for block in (True, False):
        sizes = [r for r in by_count if r["block"] == block]
        least, above = HOT, sum(r["count"] for r in sizes)
        for r in sizes:
            if above <= HOT_MAX:
                break
            above, least = above - r["count"], 2 << r["k"]
        some = hot.where(f"block = {block} and c >= {least}" if least > HOT else f"block = {block}")
        found.append(np.sort(np.array([r["h"] for r in some.select("h").toLocalIterator()], np.int64).view(np.uint64)))
    return found[0], found[1]


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    k = np.searchsorted(known, h)
    k[k == len(known)] = 0
    return known[k] == h


def _planes(x: np.ndarray, keep: int) -> bytes:
    """The low bytes of numbers, byte by byte, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :keep].T).tobytes()


def _unplanes(b: bytes, n: int, keep: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :keep] = np.frombuffer(b, np.uint8).reshape(keep, n).T
    return out.reshape(-1).view(np.uint64)


PACKED = "bucket bigint, hash binary, runs binary, ids binary, parts binary, at binary, n bigint, salt bigint"


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal shares of the hash values, up to 2**31 of them."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _pack(h: np.ndarray, run: np.ndarray, pos: np.ndarray, ids: np.ndarray, part: np.ndarray, buckets: int, keep: int) -> pa.RecordBatch:
    """One row a bucket of probes: hash and place of each, and of each run of one text its id and part."""
    bucket = bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    h, run, pos, bucket = h[order], run[order], pos[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    out: list[list] = [[], [], [], [], [], []]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        r = run[x:y]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[0].append(_planes(h[x:y], keep))
        out[1].append(_planes(np.diff(np.append(head, y - x)).astype(np.uint64), 4))
        out[2].append(np.ascontiguousarray(ids[r[head]]).tobytes())
        out[3].append(_planes(part[r[head]], 4))
        out[4].append(_planes(pos[x:y].astype(np.uint64), 4))
        out[5].append(y - x)
    return _packed(bucket[cuts[:-1]], *out)


def _unpack(r: dict, keep: int) -> tuple[np.ndarray, ...]:
    """Hash, run, place, ids and parts of a packed row."""
    ids, n = np.frombuffer(r["ids"], np.int64), r["n"]
    run = np.repeat(np.arange(len(ids), dtype=np.int32), _unplanes(r["runs"], len(ids), 4).astype(np.int64))
    return _unplanes(r["hash"], n, keep), run, _unplanes(r["at"], n, 4).astype(np.int32), ids, _unplanes(r["parts"], len(ids), 4)


def _kept_bytes(buckets: int) -> int:
    return 6 if buckets <= FAN else 8


def probes(docs: DataFrame, buckets: int, hot: np.ndarray, idle: np.ndarray) -> DataFrame:
    """Rolling windows packed by bucket, without the idle ones, and the hits on hot blocks
    (bucket -1); docs: doc_id, text, part."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, idle))
    first, keep_bytes = min(buckets, FAN), _kept_bytes(buckets)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, ids, a, b in _rows(batch, PIECE):
                part = batch.column("part")[a:b].to_numpy().view(np.uint64)
                at, h = w.windows(BLOCK)
                row = w.row[at]
                pos = at - w.first[row]
                is_hot, is_idle = (_among(h, x) for x in shared.value)
                if is_hot.any():
                    n = int(is_hot.sum())
                    yield _packed(np.full(1, -1), [b""], [b""], [ids[row[is_hot]].tobytes()], [_planes(part[row[is_hot]], 4)], [pos[is_hot].astype("<i8").tobytes()], [n])
                keep = ~(is_hot | is_idle)
                if keep.any():
                    yield _pack(h[keep], row[keep], pos[keep], ids, part, first, keep_bytes)

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            start = np.cumsum([0, *(len(x[3]) for x in held)])
            h, pos, ids, part = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4))
            return _pack(h, np.concatenate([x[1] + s for x, s in zip(held, start, strict=False)]), pos, ids, part, buckets, 8)

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    yield pa.RecordBatch.from_pylist([r], schema=batch.schema)
                    continue
                held.append(_unpack(r, 8))
                n += r["n"]
                if n >= BUCKET:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    packed = docs.mapInArrow(probe, PACKED)
    if buckets <= FAN:
        return packed
    return packed.repartition("bucket", "salt").sortWithinPartitions("bucket").mapInArrow(repack, PACKED)


def hits(docs: DataFrame, buckets: int, hot: np.ndarray, idle: np.ndarray) -> DataFrame:
    """(doc_id, part, at): where in a row, in words, a run of BLOCK words starts that
    another document has too and one has as a block."""
    keep_bytes = _kept_bytes(buckets)

    def match(table: pa.Table) -> pa.Table:
        hs, runs, ids, parts, at = [], [], [], [], []
        direct, known = [], 0
        for r in table.to_pylist():
            if r["bucket"] < 0:
                i = np.frombuffer(r["ids"], np.int64)
                direct.append((i, _unplanes(r["parts"], len(i), 4).view(np.int64), np.frombuffer(r["at"], "<i8")))
                continue
            h, run, p, i, part = _unpack(r, keep_bytes)
            for x, v in zip((hs, runs, at, ids, parts), (h, run + np.int32(known), p, i, part.view(np.int64)), strict=True):
                x.append(v)
            known += len(i)
        if hs:
            h, run, p, ids, parts = (np.concatenate(x) for x in (hs, runs, at, ids, parts))
            del hs, runs, at
            order = np.argsort(h, kind="stable")
            h, run, p = h[order], run[order], p[order]
            d = ids[run]
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            block = np.maximum.reduceat(p % BLOCK == 0, cuts)
            several = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts)
            keep = np.repeat(block & several, np.diff(np.append(cuts, len(h))))
            direct.append((d[keep], parts[run[keep]], p[keep].astype(np.int64)))
        d, part, p = (np.concatenate([x[k] for x in direct] or [np.zeros(0, np.int64)]) for k in (0, 1, 2))
        return pa.table({"doc_id": d, "part": part, "at": p})

    return probes(docs, buckets, hot, idle).groupBy("bucket", "salt").applyInArrow(match, "doc_id bigint, part bigint, at bigint")


def _packed(bucket, hashes, runs, ids, parts, at, n) -> pa.RecordBatch:
    # Rows that need no bucket (hot blocks) are groups of their own, by a salt of their content.
    salt = [zlib.crc32(p, zlib.crc32(i)) if b < 0 else 0 for b, i, p in zip(bucket, ids, at, strict=True)]
    arrays = [pa.array(bucket, pa.int64()), *[pa.array(x, pa.binary()) for x in (hashes, runs, ids, parts, at)], pa.array(n, pa.int64()), pa.array(salt, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "hash", "runs", "ids", "parts", "at", "n", "salt"])


def _marks(lists, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the row of each."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _covered(w: Words, rows: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Words from `before` ahead of any mark to `after` behind it (exclusive), by word index of w.
    Marks behind the last word, which are those of another row with the same id and hash, don't count."""
    inside = at < w.count[rows]
    rows, at = rows[inside], at[inside]
    edge = np.zeros(len(w.start) + 1, np.int64)
    lo = np.maximum(w.first[rows] + at - before, w.first[rows])
    hi = np.minimum(w.first[rows] + at + after, w.first[rows + 1])
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def candidates(marked: DataFrame) -> DataFrame:
    """(h, g, _id, _sig, at) of the windows that hold a hit, h and g being two hashes; marked: doc_id, _sig, text, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, ids, a, b in _rows(batch):
                values, rows = _marks(batch.column("marks").slice(a, b - a), b - a)
                # A window that starts up to WINDOW - BLOCK words ahead of the hit holds it whole.
                starts = _covered(w, rows, values, WINDOW - BLOCK, 1)
                at, h = w.windows(WINDOW)
                keep = starts[at]
                at, h = at[keep], h[keep]
                sig = batch.column("_sig")[a:b].to_numpy(zero_copy_only=False)
                g = w.again(at, WINDOW)
                cols = [pa.array(x) for x in (h.view(np.int64), g.view(np.int64), ids[w.row[at]], sig[w.row[at]], at - w.first[w.row[at]])]
                yield pa.RecordBatch.from_arrays(cols, ["h", "g", "_id", "_sig", "at"])

    return marked.mapInArrow(run, "h bigint, g bigint, _id bigint, _sig bigint, at bigint")


def removed(marked: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 (and the kept text); marks are repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, _, a, b in _rows(batch):
                values, rows = _marks(batch.column("marks").slice(a, b - a), b - a)
                keep = ~_covered(w, rows, values, 0, WINDOW)
                raw = w.data.tobytes()
                n_kept = np.bincount(w.row[keep], minlength=b - a)
                # The kept words of each row, one space between them: byte runs of whole words.
                hashes, kept_text, k = [], [], np.flatnonzero(keep)
                start, end, cut = w.start[k].tolist(), w.end[k].tolist(), np.concatenate([[0], np.cumsum(n_kept)]).tolist()
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    t = b" ".join([raw[s:e] for s, e in zip(start[x:y], end[x:y], strict=True)])
                    hashes.append(hashlib.sha256(t).hexdigest())
                    if with_text:
                        kept_text.append(t.decode("utf-8", "replace"))
                cols = [batch.column("doc_id")[a:b], pa.array(w.count), pa.array(w.count - n_kept), pa.array(hashes, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_text, pa.string())] * with_text, names + ["kept_text"] * with_text)

    return marked.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def substring_dedup(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A row is known by its id and its text, as an id may repeat; hits, which only choose
    # what is compared, by the id and 32 bits of the text's hash.
    sig = F.xxhash64("text")
    named = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("_id"), sig.alias("_sig"), sig.bitwiseAND(0xFFFFFFFF).alias("part"))
    found = scratch.keep(hits(named.select("doc_id", "text", "part"), max(1, size // (6 * BUCKET)), *frequent(docs, scratch)), "hits")
    marks = found.groupBy(F.col("doc_id").alias("_id"), "part").agg(F.collect_set("at").alias("marks"))
    windows = scratch.keep(candidates(named.join(marks, ["_id", "part"]).select("doc_id", "_sig", "text", "marks")), "windows")
    first = scratch.keep(
        windows.groupBy("h", "g").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first != last").select("h", "g", "first"), "first"
    )
    repeated = windows.join(first, ["h", "g"]).where("_id > first")
    marks = scratch.keep(repeated.groupBy("_id", "_sig").agg(F.collect_set("at").alias("marks")), "marks")
    scratch.drop_all_but("marks")
    return removed(named.join(marks, ["_id", "_sig"], "left").select("doc_id", "text", "marks"), with_text)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op8"))
