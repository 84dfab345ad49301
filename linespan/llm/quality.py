"""Operator 5: quality by importance resampling with hashed n-grams.

Two generative models of hashed word 1- and 2-grams are counted: one of the raw
corpus, over all documents, and one of the target, over a bounded sample of the
documents labelled good (the smallest hash in each of SLOTS slots).  A
document's log weight is the sum of log p_target - log p_raw over its n-grams.
With Gumbel noise seeded by the id and the words, the k largest keys are a sample of
k without replacement, weighted by importance.  k is the labelled documents' share of
good ones, times all documents, unless a share is given.

The k-th key is found by counting keys in bins, and bins in that bin, so nothing
is ranked in one task; rows with equal keys are told apart by their id and a number that
they get when the scores are written, so exactly k are kept.  The models are BUCKETS numbers each.

Defined cases: null, empty and blank texts have log weight 0 and take part;
documents labelled twice count as good if any label is 1; null labels are no
labels; without good labels the target equals the raw model; null ids and rows that
repeat an id have the noise of their words; only rows with the same id and words have
equal keys, and of those it doesn't matter which are kept; empty tables give no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, mix, pieces, texts

BUCKETS, SLOTS, SEED, BINS, FEW = 10_000, 4_096, 20_240, 1_024, 10_000
U = np.uint64


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, np.ndarray]]:
    """Row and bucket of every 1- and 2-gram of some rows, and a hash of each row's words."""
    data, offsets = texts(batch.column("text"))
    for a, b in pieces(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at, two = w.windows(2)
        h = np.concatenate([w.hash, two])
        yield np.concatenate([w.row, w.row[at]]), (h % U(BUCKETS)).astype(np.int64), a, b, w.whole(np.arange(b - a))


def _uniform(ids: np.ndarray, words: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) of the ids and the hashes of the words."""
    h = mix(ids.astype(np.int64).view(np.uint64) + mix(np.full(1, seed, np.uint64)))
    return ((mix(h ^ words) >> U(11)).astype(float) + 0.5) / float(1 << 53)


def sample_good(labels: DataFrame, slots: int = SLOTS) -> DataFrame:
    """At most `slots` ids of documents labelled good."""
    h = F.xxhash64("doc_id")
    good = labels.where("quality = 1 and doc_id is not null")
    return good.groupBy(F.pmod(h, F.lit(slots)).alias("s")).agg(F.min(F.struct(h.alias("h"), "doc_id"))["doc_id"].alias("doc_id")).select("doc_id")


def ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one added to every count."""
    good = {r["doc_id"] for r in sample_good(labels).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(good), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            chosen = np.isin(ids, shared.value) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for row, bucket, a, b, _ in _grams(batch):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[a:b][row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    model = np.ones((2, BUCKETS))
    for r in rows:
        model[:, r["bucket"]] += (r["target"], r["raw"])
    if not good or model[0].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    p = np.log(model / model.sum(axis=1, keepdims=True))
    return p[0] - p[1]


def scores(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key: the log weight with Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for row, bucket, a, b, words in _grams(batch):
                weight = np.bincount(row, weights=shared.value[bucket], minlength=b - a)
                key = weight - np.log(-np.log(_uniform(ids[a:b], words, seed)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(weight), pa.array(key)], ["doc_id", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, log_weight double, key double")


def _narrowed(rows: DataFrame, by: str, left: int) -> tuple[DataFrame, int]:
    """The few rows, by one column from its largest value down, among which the last of `left`
    is, and how many of them are still to be taken.  Rows of one value stay together."""
    least, most, inside = rows.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    while inside > FEW and most > least:
        at = (F.col(by).cast("double") - F.lit(float(least))) / F.lit((float(most) - float(least)) / BINS)
        counted = rows.where(F.col(by).between(least, most)).groupBy(F.least(F.floor(at), F.lit(BINS - 1)).alias("bin"))
        found = counted.agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).collect()  # at most BINS rows
        for r in sorted(found, key=lambda r: -r["bin"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        if (r["lo"], r["hi"]) == (least, most):
            break
        least, most, inside = r["lo"], r["hi"], r["n"]
    return rows.where(F.col(by).between(least, most)), left


def top(scored: DataFrame, k: int) -> DataFrame:
    """scored with `kept`: whether a row is among the k of largest key, then smallest id (none
    last), then smallest row number where there is one."""
    if k <= 0 or k >= scored.count():
        return scored.withColumn("kept", F.lit(k > 0))
    row = F.bitwise_not(F.col("row")) if "row" in scored.columns else F.lit(0)
    id_ = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(-(1 << 63)))  # the other way round
    ranks = {"_key": F.col("key"), "_id": id_.cast("long"), "_row": row.cast("long")}
    near, left = scored.select(*[c.alias(n) for n, c in ranks.items()]), k
    for by in ranks:
        near, left = _narrowed(near, by, left)
        if not near.agg(F.min(by) == F.max(by)).first()[0]:
            break
    last = near.orderBy(*[F.col(n).desc() for n in ranks]).limit(left)  # about FEW rows at most
    cut = last.orderBy(*ranks).first()
    return scored.withColumn("kept", F.struct(*ranks.values()) >= F.struct(*[F.lit(cut[n]).cast(t) for n, t in zip(ranks, ("double", "long", "long"), strict=True)]))


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key, kept for every document."""
    scored = scratch.keep(scores(docs, ratios(docs, labels)).withColumn("row", F.monotonically_increasing_id()), "scored")
    if share is None:
        share = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return top(scored, round((1.0 if share is None else share) * scored.count())).drop("row")


def op5_quality_resample(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels, Scratch(spark, "op5"))
