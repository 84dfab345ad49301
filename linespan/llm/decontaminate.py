"""Operator 10: benchmark decontamination with BM25 and block-max WAND.

The test items are indexed: words in lower case without punctuation around
them, in chunks of at most CHUNK words, with BM25 impacts divided by the chunk's
own score, so 1 means that a passage has all that the chunk has.  Every document
is read in passages of 2 * CHUNK words that start every CHUNK words, so each
stretch of CHUNK words lies whole in one.  Each passage is a query that
retrieves every chunk at or above THRESHOLD: passages whose terms' largest
impacts, in each range of chunks, can't add up to that are passed over at once
for all passages of a batch, the others go through block-max WAND.  What is found is verified on the words around the passage: the
3-grams of the item's question and of its answer (its last third, as the table
has no column for it) must both be there, in the shares Q_SHARE and A_SHARE.

The index is broadcast in shards of about SHARD_WORDS words (an item is in one shard),
one scan of the documents for each, a job at a time: what a shard finds is written (the leaks, or for
the stage the hashes of the texts that leak) before the next one's index is made, so the driver and
a task hold one index however many there are.  Postings, their block maxima and their range maxima
are sparse, some 60 bytes a word at most, so a shard has a bound in bytes.  Counts of chunks and
terms are of all items and counted once, so scores don't depend on the sharding.  Only hashes of an
item's words go to the driver, a shard at a time.

Defined cases: null, empty and blank texts and items match nothing; items of
fewer than 3 words are verified by single words; an item that repeats is
reported under each id; null ids are reported as null; ties have no effect, as
all above the threshold are taken; extra columns pass by; empty tables give nothing.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import free_name
from .scratch import Scratch
from .words import Words, mix, pieces, span_hash, texts

CHUNK, THRESHOLD, Q_SHARE, A_SHARE, GRAM = 48, 0.5, 0.6, 0.5, 3
K1, B, BLOCK, RANGES, SHARD_WORDS, NO_DOC = 1.2, 0.75, 64, (64, 1024), 2_000_000, 1 << 62
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case, with ASCII punctuation around them taken off."""
    w = Words(data, offsets, lower=True, hashes=False)
    d = w.data
    upper = np.flatnonzero(d[:-1] == 0xC3) + 1  # À-Þ without ×
    upper = upper[(d[upper] >= 0x80) & (d[upper] <= 0x9E) & (d[upper] != 0x97)]
    if len(upper):
        d[upper] += 0x20
    s, e = w.start.copy(), w.end.copy()
    for _ in range(4):
        e -= (e - s > 1) & _PUNCT[d[e - 1]]
        s += (e - s > 1) & _PUNCT[d[np.minimum(s, len(d) - 1)]]
    w.hash = span_hash(d, s, e)
    return w


def grams(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def chunks_of(h: np.ndarray) -> list[np.ndarray]:
    """An item's words in chunks of about equal length, at most CHUNK."""
    step = math.ceil(len(h) / math.ceil(len(h) / CHUNK)) if len(h) else 1
    return [h[a : a + step] for a in range(0, len(h), step)]


def _hashes(items: list[str | None]) -> list[np.ndarray]:
    data, offsets = texts(pa.array(items, pa.string()) if items else pa.array([], pa.string()))
    w = plain_words(data.copy(), offsets)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _most(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, heads) if len(heads) else np.zeros(0)


class Index:
    """Postings of the chunks of some items: of term t, `chunk` and `impact` from start[t] to start[t + 1].

    counts: (document frequency of terms, number of chunks, mean chunk length) of all items,
    where these are not all."""

    def __init__(self, items: list[tuple[int | None, str | np.ndarray | None]], counts: tuple[dict[int, int], int, float] | None = None):
        self.ids = [i for i, _ in items]
        plain = [k for k, (_, t) in enumerate(items) if not isinstance(t, np.ndarray)]
        hashes = [t for _, t in items]
        for k, h in zip(plain, _hashes([items[k][1] for k in plain]), strict=True):
            hashes[k] = h
        self.question, self.answer, self.gram = [], [], [min(GRAM, len(h)) for h in hashes]
        self.words = np.array([len(h) for h in hashes], np.int64)
        chunks, item = [], []
        for k, h in enumerate(hashes):
            n, cut = min(GRAM, len(h)), len(h) - len(h) // 3
            self.question.append(np.unique(grams(h[:cut], min(n, max(cut, 1)))))
            self.answer.append(np.unique(grams(h[max(0, cut - n + 1) :], n)) if n else h)
            parts = chunks_of(h)
            chunks += parts
            item += [k] * len(parts)
        self.item = array("q", item)
        size = np.array([len(c) for c in chunks], np.int64)
        self.terms, term = np.unique(np.concatenate([*chunks, np.zeros(0, np.uint64)]), return_inverse=True)
        # One posting for each term of a chunk, in order of terms, then of chunks.
        pair, tf = np.unique(term.astype(np.int64) * max(1, len(chunks)) + np.repeat(np.arange(len(chunks)), size), return_counts=True)
        term, chunk = pair // max(1, len(chunks)), pair % max(1, len(chunks))
        df = np.bincount(term, minlength=len(self.terms)).astype(float)
        n_chunks, mean = len(chunks), float(size.mean()) if len(size) else 1.0
        if counts is not None:
            df = np.array([counts[0][t] for t in self.terms.view(np.int64).tolist()], float)
            _, n_chunks, mean = counts
        idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[chunk] / mean))
        impact /= np.bincount(chunk, weights=impact, minlength=len(chunks))[chunk]
        first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.start, self.chunk, self.impact = first.tolist(), array("q", chunk.tobytes()), array("d", impact.tobytes())
        self.most = _most(impact, first[:-1]).tolist()
        # The largest impact of each block of a list, and of each wide and narrow range of chunks.
        block = _heads(term * (1 << 40) + (np.arange(len(term)) - first[term]) // BLOCK)
        self.block_start, self.block_max = np.searchsorted(term[block], np.arange(len(self.terms) + 1)).tolist(), array("d", _most(impact, block).tobytes())
        self.ranges = []
        for n in RANGES:
            width = max(1, -(-len(chunks) // n))
            at = _heads(term * (1 << 40) + chunk // width)
            self.ranges.append((np.searchsorted(term[at], np.arange(len(self.terms) + 1)), (chunk[at] // width).astype(np.int32), _most(impact, at).astype(np.float32), n))

    @property
    def postings(self) -> list[tuple[array, array]]:
        """(chunks, impacts) of every term."""
        return [(self.chunk[a:b], self.impact[a:b]) for a, b in zip(self.start[:-1], self.start[1:], strict=True)]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every chunk whose impacts for these distinct terms reach the threshold.
        Lists skip to their next chunk by binary search."""
        chunks, impact, start = self.chunk, self.impact, self.start
        lists = [[chunks[start[t]], start[t], t] for t in terms]  # next chunk, position, term
        out, reach = [], threshold - 1e-9
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                total += self.most[x[2]]
                if total >= reach:
                    pivot = i
                    break
            if pivot < 0:
                return out
            chunk = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == chunk:
                pivot += 1
            # What the blocks that hold the pivot could give at most, and where they end.
            bound, beyond = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else NO_DOC
            for _, p, t in lists[: pivot + 1]:
                a, end = start[t], start[t + 1]
                p = bisect_left(chunks, chunk, p, end)
                if p < end:
                    b = (p - a) // BLOCK
                    bound += self.block_max[self.block_start[t] + b]
                    beyond = min(beyond, chunks[min(a + (b + 1) * BLOCK, end) - 1] + 1)
            if bound < reach:
                target = max(beyond, chunk + 1)
            elif lists[0][0] == chunk:
                score = sum(impact[x[1]] for x in lists[: pivot + 1])
                if score >= reach:
                    out.append((chunk, score))
                target = chunk + 1
            else:
                target = chunk
            for x in lists[: pivot + 1]:
                x[1] = bisect_left(chunks, target, x[1], start[x[2] + 1])
                x[0] = chunks[x[1]] if x[1] < start[x[2] + 1] else NO_DOC
            lists = [x for x in lists if x[0] != NO_DOC]
        return out


def _bounds(passages: np.ndarray, follows: np.ndarray, block: np.ndarray, term: np.ndarray, level: tuple) -> np.ndarray:
    """The largest sum of impacts over any range, of each passage (a block and the next of its row)."""
    first, range_, most, n = level
    out = np.zeros(len(passages), np.float32)
    for a in range(0, len(passages), 1_000):
        p = passages[a : a + 1_000]
        need = np.unique(np.concatenate([p, p[follows[p]] + 1]))
        lo, size = np.searchsorted(block, need), np.searchsorted(block, need, "right") - np.searchsorted(block, need)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row, t = np.repeat(np.arange(len(need)), size), term[at]
        each = first[t + 1] - first[t]
        at = np.repeat(first[t] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        sums = np.bincount(np.repeat(row, each) * n + range_[at], weights=most[at], minlength=len(need) * n).reshape(len(need), n)
        own = sums[np.searchsorted(need, p)]
        nxt = np.searchsorted(need, np.where(follows[p], p + 1, p))
        out[a : a + 1_000] = np.where(follows[p], (own + sums[nxt]).max(1), own.max(1))
    return out


def leaks(w: Words, index: Index, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question share, answer share) of the verified items of some texts."""
    if not len(index.terms) or not len(w.hash):
        return []
    k = np.searchsorted(index.terms, w.hash)
    k[k == len(index.terms)] = 0
    hit = np.flatnonzero(index.terms[k] == w.hash)
    # Blocks of CHUNK words, numbered through all rows; a passage is a block and the next of its row.
    per_row = -(-w.count // CHUNK)
    first = np.concatenate([[0], np.cumsum(per_row)])
    block = first[w.row[hit]] + (hit - w.first[w.row[hit]]) // CHUNK
    pair = np.unique(block * len(index.terms) + k[hit])
    block, term = pair // len(index.terms), pair % len(index.terms)
    row_of = np.repeat(np.arange(w.rows), per_row)
    follows = np.append(row_of[1:] == row_of[:-1], False) if len(row_of) else np.zeros(0, bool)
    passages = np.arange(first[-1])
    for level in index.ranges:  # what can't reach the threshold by the wide ranges isn't looked up in the narrow
        passages = passages[_bounds(passages, follows, block, term, level) >= threshold - 1e-4]
    found: dict[tuple[int, int], list[float]] = {}
    cut = np.searchsorted(block, np.arange(first[-1] + 1))
    for p in passages.tolist():
        t = np.unique(term[cut[p] : cut[min(p + 2, first[-1])] if follows[p] else cut[p + 1]])
        for chunk, score in index.search(t.tolist(), threshold):
            row, item = int(row_of[p]), index.item[chunk]
            a = w.first[row] + (p - first[row]) * CHUNK
            more = int(index.words[item])
            h = w.hash[max(w.first[row], a - more) : min(w.first[row + 1], a + 2 * CHUNK + more)]
            g = np.unique(grams(h, index.gram[item]))
            q, n = index.question[item], index.answer[item]
            shares = [np.isin(x, g if len(x) else g).mean() if len(x) else 1.0 for x in (q, n)]
            if shares[0] >= Q_SHARE and shares[1] >= A_SHARE:
                best = found.setdefault((row, item), [0.0, 0.0, 0.0])
                found[row, item] = [max(x, y) for x, y in zip(best, (score, *map(float, shares)), strict=True)]
    return [(r, i, *v) for (r, i), v in sorted(found.items())]


def _hashed(items: DataFrame) -> DataFrame:
    """(item_id, words, h): the word hashes of every item, in place of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashes(batch.column("text").to_pylist())
            cols = [batch.column("item_id"), pa.array([len(h) for h in hashes], pa.int64()), pa.array([h.tobytes() for h in hashes], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "words", "h"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id bigint, words bigint, h binary")


def _term_counts(hashed: DataFrame) -> DataFrame:
    """(term, df): in how many chunks of all items a term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(c) for h in batch.column("h").to_pylist() for c in chunks_of(np.frombuffer(h, np.uint64))]
            t, n = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["term", "df"])

    return hashed.mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _indexes(items: DataFrame, scratch: Scratch, shard_words: int | None = None) -> tuple[int, Iterator[Index]]:
    """The number of shards of about `shard_words` words, and their indexes, made one at a time."""
    hashed, shard_words = scratch.keep(_hashed(items), "items"), shard_words or SHARD_WORDS
    per_item = F.ceil(F.col("words") / F.lit(CHUNK))
    chunks, words = hashed.agg(F.sum(per_item), F.sum("words")).first()
    shards = max(1, math.ceil((words or 0) / shard_words))

    def each() -> Iterator[Index]:
        every = scratch.keep(_term_counts(hashed), "terms") if shards > 1 else None
        for k in range(shards):
            part = hashed.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(shards)) == k) if shards > 1 else hashed
            counts = None
            if every is not None:
                counts = {r["term"]: r["df"] for r in every.join(_term_counts(part).select("term"), "term", "left_semi").collect()}, chunks, words / chunks
            rows = [(r["item_id"], np.frombuffer(r["h"], np.uint64)) for r in part.collect()]  # about shard_words hashes
            yield Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1].tobytes())), counts)

    return shards, each()


_NAMES = ["doc_id", "item_id", "score", "question_share", "answer_share"]


def _scan(docs: DataFrame, shared, key: str, kind: str) -> DataFrame:
    """(key, item_id, score, question_share, answer_share) of every verified leak of one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in pieces(offsets):
                w = plain_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got = leaks(w, shared.value)
                rows = batch.column(key).take(pa.array([a + r[0] for r in got], pa.int64()))
                ids = pa.array([shared.value.ids[r[1]] for r in got], pa.int64())
                yield pa.RecordBatch.from_arrays([rows, ids, *[pa.array([r[k] for r in got], pa.float64()) for k in (2, 3, 4)]], [key, *_NAMES[1:]])

    return docs.mapInArrow(run, f"{key} {kind}, item_id bigint, score double, question_share double, answer_share double")


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share) of every verified leak."""
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "op10")
    shards, indexes = _indexes(items, scratch)
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for k, index in enumerate(indexes):
        shared = spark.sparkContext.broadcast(index)
        found = _scan(texts_, shared, "doc_id", "bigint")
        if shards == 1:
            return found
        parts.append(f"leaks-{k}")
        scratch.keep(found, parts[-1])
        shared.destroy()
    return spark.read.schema(found.schema).parquet(*map(scratch.path, parts))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak.  Of one shard, the scan that finds leaks drops their rows itself; of several, the md5 of
    the texts that leak are gathered in a table and their rows go by an anti-join.  Null and empty texts stay,
    rows are judged one by one whatever their id, columns pass through, an empty table stays empty."""
    scratch = Scratch(spark, "pipeline-leaks")
    shards, indexes = _indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
    hashed = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")
    parts = []
    for k, index in enumerate(indexes):
        shared = spark.sparkContext.broadcast(index)
        if shards == 1:
            return _clean(docs, shared)
        parts.append(f"leaks-{k}")
        scratch.keep(_scan(hashed, shared, "text_md5", "string").select("text_md5").distinct(), parts[-1])
        shared.destroy()
    own = free_name(docs, "_md5")
    gone = spark.read.schema("text_md5 string").parquet(*map(scratch.path, parts)).distinct().withColumnRenamed("text_md5", own + "_of")
    known = docs.withColumn(own, F.md5(F.col("text").cast("binary")))
    return known.join(gone, F.col(own) == F.col(own + "_of"), "left_anti").drop(own)


def _clean(docs: DataFrame, shared) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for a, b in pieces(offsets):
                w = plain_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep[[a + r[0] for r in leaks(w, shared.value)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
