"""Operator 12: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials of hashed word 1- and 2-grams are counted: one of the raw corpus, over all
documents, and one of the trusted target.  Trusted are all documents labelled of quality 1 and not
toxic, and each has one part: by a hash of its id the target counts it (about three of four), or
its score goes into the threshold.  Raw counts are scaled to the target's size, then one is added to
both, so a gram that is rare in either says little and one that is frequent in the raw corpus and
missing in the target says much.  A document's score is the sum of log p_target - log p_raw over its
grams, divided by their number.  The verdict is one threshold for all documents: the QUANTILE of the
scores of all trusted documents that the model has not counted, so about that share of clean
documents is lost.  Documents that fail a base rule (fewer than 50 words, or more than half of the
words repeated in runs of three) are not kept either way.

Ids of trusted documents stay in Spark: the target's texts are found by a join, and the quantile by
counting scores in bins.  What the driver gets is bounded: BUCKETS counts, and the few scores of the last bin.

Defined cases: null, empty and blank texts have no words, fail the base rules and score 0;
a document is trusted if it has labels of quality, all of them 1, and no label says toxic (nulls say nothing);
without trusted documents, or with none left for the threshold,
every document that passes the base rules is kept; null and repeated ids, and repeated rows, are judged
by their texts; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _narrowed
from .scratch import Scratch
from .words import Words, pieces, span_hash, texts

BUCKETS, QUANTILE, MIN_WORDS, MOST_REPEATED, WINDOW = 1 << 18, 0.01, 50, 50, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_OUT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """Rows a to b of a batch, their bytes, offsets and words."""
    data, offsets = texts(batch.column("text"))
    for a, b in pieces(offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, d, o, Words(d, o)


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word and every pair of neighbouring words."""
    at, two = w.windows(2)
    return np.concatenate([w.row, w.row[at]]), (np.concatenate([w.hash, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _again(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key): whether it occurs twice or more, and whether an earlier place has it."""
    order = np.lexsort((np.arange(len(key)), key, row))
    r, k = row[order], key[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    later, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def base(d: np.ndarray, o: np.ndarray, w: Words) -> dict[str, np.ndarray]:
    """The base measures of some rows."""
    n = len(o) - 1
    lead = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])  # code points before each byte
    out = {"n_words": w.count.astype(np.int64), "word_chars": np.bincount(w.row, weights=lead[w.end] - lead[w.start], minlength=n).astype(np.int64)}
    row_of = lambda at: np.searchsorted(o, at, "right") - 1
    out["n_symbols"] = np.bincount(row_of(np.flatnonzero(_SYMBOL[d])), minlength=n).astype(np.int64)
    # Lines end before a line feed or with the text; only lines that hold a word count.
    feeds = np.flatnonzero(d == 10)
    full = o[1:] > o[:-1]
    start = np.sort(np.concatenate([o[:-1][full], feeds[feeds + 1 < o[row_of(feeds) + 1]] + 1]))
    end = np.concatenate([start[1:], o[-1:]]) if len(start) else start
    end = end - ((end > 0) & (d[np.maximum(end - 1, 0)] == 10)) if len(start) else end
    holds = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[holds], end[holds]
    row = row_of(start)
    out["n_dup_lines"] = np.bincount(row[_again(row, span_hash(d, start, end))[1]], minlength=n).astype(np.int64)
    at, run = w.windows(WINDOW)
    covered = np.zeros(len(w.row) + 1, np.int64)
    many = at[_again(w.row[at], run)[0]]
    np.add.at(covered, many, 1)
    np.add.at(covered, many + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(w.row[np.cumsum(covered)[:-1] > 0], minlength=n).astype(np.int64)
    return out


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id and `fits` of all trusted documents: whether the model counts them, or they are for the threshold."""
    worst = [F.min((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")]
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(*worst).where("quality = 1 and coalesce(toxic, 0) = 0")
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0).alias("fits"))


def model(docs: DataFrame, fits: DataFrame, scratch: Scratch) -> np.ndarray:
    """log p_target - log p_raw of each bucket; fits: doc_id of the target's documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for *_, w in _texts(batch):
                n += np.bincount(_grams(w)[1], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    def counted(texts: DataFrame, name: str) -> np.ndarray:
        by_task = texts.select("text").mapInArrow(count, "bucket bigint, n bigint")
        out = np.zeros(BUCKETS)
        for r in scratch.keep(by_task.groupBy("bucket").agg(F.sum("n").alias("n")), name).collect():  # at most BUCKETS rows
            out[r["bucket"]] = r["n"]
        return out

    # The hint keeps the ids from being broadcast, however many they are, and the texts from being sorted.
    target = counted(docs.join(fits.hint("shuffle_hash"), "doc_id", "left_semi"), "target")
    if not target.sum():
        return np.zeros(BUCKETS)
    raw = counted(docs, "raw")
    return np.log(target + 1) - np.log(raw * (target.sum() / raw.sum()) + 1)


def measure(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The base measures, base_failed and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, d, o, w in _texts(batch):
                m = base(d, o, w)
                row, bucket = _grams(w)
                total = np.bincount(row, weights=shared.value[bucket], minlength=b - a)
                m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
                m["score"] = total / np.maximum(np.bincount(row, minlength=b - a), 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *map(pa.array, m.values())], ["doc_id", *m])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def threshold(measured: DataFrame, held: DataFrame, scratch: Scratch, quantile: float = QUANTILE) -> float | None:
    """The score at `quantile` of trusted documents that the model hasn't counted; held: their doc_id."""
    least = measured.where("not base_failed").groupBy("doc_id").agg(F.min("score").alias("score"))
    scores = scratch.keep(least.join(held.hint("shuffle_hash"), "doc_id", "left_semi").select("score"), "held")
    n = scores.count()
    if not n:
        return None
    near, left = _narrowed(scores, "score", n - int(quantile * n))
    for r in near.groupBy("score").count().orderBy(F.desc("score")).collect():  # one value, or those of one bin
        left -= r["count"]
        if left <= 0:
            return r["score"]


def rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, quantile: float = QUANTILE) -> DataFrame:
    """The base measures, base_failed, score and kept of every document."""
    sure = scratch.keep(trusted(labels), "trusted")
    measured = scratch.keep(measure(docs, model(docs, sure.where("fits"), scratch)), "measured")
    least = threshold(measured, sure.where("not fits"), scratch, quantile)
    scratch.drop_all_but("measured")
    return measured.withColumn("kept", ~F.col("base_failed") & (F.lit(True) if least is None else F.col("score") >= F.lit(least)))


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rules(docs, labels, Scratch(spark, "op12"))
