"""Operator 13: ranked lexical search in norm buckets, after LEMP.

Every benchmark item is a query, every document a vector of impacts: for each term that any item has,
the term's weight times its saturated frequency, in integers.  An item's score of a document is then
the inner product of the document's vector with the item's 0/1 vector.  Documents are put in the order
of their vectors' lengths (a range partitioning that is written) and searched in buckets:

1. by Cauchy-Schwarz a score is at most sqrt(terms of the item) * length, so a bucket whose longest vector
   can't reach an item's tenth best score so far is passed over, and so are all later ones;
2. inside a bucket each coordinate's largest value bounds what the coordinate can add.  Coordinates that
   can't reach the tenth best score together, by those bounds or by Cauchy-Schwarz on their number, stay
   closed; only documents on the lists of the others are candidates, and each is bounded by what it has there
   plus Cauchy-Schwarz on the rest of its length;
3. what survives is scored anew from its own terms in 64-bit integers.

About the SEED longest vectors are searched first; their tenth best scores start every task, and vectors too short
for all items aren't read (a filter on the length that reaches the Parquet scan).  A task keeps TOP documents an
item, Spark ranks them.  Bounds are taken with a margin over rounding, so the result is exact; terms are equal
by 64-bit hashes.

Items are searched in shards of about SHARD_TERMS terms, each with its own scan of the documents, so what
is broadcast and what the driver holds is bounded however many items there are.

Defined cases: null and empty texts and texts without terms have no vector and are no item; a score of 0 is no hit; every row of
either table counts as a document or an item of its own, also where ids are null or repeat; equal
scores go by ascending doc_id, null last; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, pieces, texts

TOP, BUCKET, SEED, SHARD_TERMS, MARGIN = 10, 1_024, 4_096, 2_000_000, 1 + 1e-9
_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    data, offsets = texts(batch.column("text"))
    for a, b in pieces(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True, gaps=_GAP)


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """Values of ascending rows as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and values of a list column without nulls."""
    o = column.offsets.to_numpy()
    return o - o[0], column.values.slice(o[0], o[-1] - o[0]).to_numpy(zero_copy_only=False)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id and its distinct terms' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in _terms(batch):
                pair = np.unique(np.rec.fromarrays([w.row.astype(np.int64), w.hash.view(np.int64)]))
                columns = [batch.column("item")[a:b], batch.column("item_id")[a:b], _lists(pair.f1, pair.f0, b - a)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item bigint, item_id bigint, terms array<bigint>").where(F.size("terms") > 0)


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, number of terms n, and the frequencies tf of its terms (places in the vocabulary), of documents with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, w in _terms(batch):
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                hit = known[at] == w.hash
                pair, tf = np.unique(w.row[hit].astype(np.int64) * len(known) + at[hit], return_counts=True)
                row = pair // len(known)
                columns = [batch.column("doc_id")[a:b], pa.array(w.count.astype(np.int64)), _lists((pair % len(known)).astype(np.int32), row, b - a), _lists(tf.astype(np.int64), row, b - a)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")
    return rows.where("n > 0")


def weights(counted: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term, the number of documents and that of all their terms."""
    n_docs, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # a shard's terms
    w = np.zeros(terms, np.int64)
    for r in found:
        w[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return w, n_docs, length


def impacts(counted: DataFrame, weight: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """doc_id, norm, terms and impacts of documents with an impact above 0."""
    shared = counted.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            (offsets, term), (_, tf) = _flat(batch.column("terms")), _flat(batch.column("tf"))
            row = np.repeat(np.arange(len(n)), np.diff(offsets))
            if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:  # beyond 64 bits on the way to a small number
                m = np.array([10 + 90 * int(x) * n_docs // length for x in n], np.int64)
            else:
                m = 10 + 90 * n * n_docs // length
            c = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            row, term, c = row[c > 0], term[c > 0], c[c > 0]
            norm = np.sqrt(np.bincount(row, weights=c.astype(float) ** 2, minlength=len(n)))
            columns = [batch.column("doc_id"), pa.array(norm), _lists(term, row, len(n)), _lists(c, row, len(n))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "norm", "terms", "impacts"])

    return counted.mapInArrow(run, "doc_id bigint, norm double, terms array<int>, impacts array<bigint>").where("norm > 0")


class Bucket:
    """Some documents' vectors, longest first, by row and by coordinate."""

    def __init__(self, norm: np.ndarray, offsets: np.ndarray, term: np.ndarray, c: np.ndarray):
        self.norm, self.offsets, self.term, self.c = norm, offsets, term, c
        row = np.repeat(np.arange(len(norm)), np.diff(offsets))
        order = np.argsort(term, kind="stable")
        self.by_row, self.by_c = row[order], c[order]
        self.terms, self.start = np.unique(term[order], return_index=True)
        self.most = np.maximum.reduceat(self.by_c, self.start) if len(self.start) else self.by_c
        self.start = np.append(self.start, len(term))

    def hits(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the bucket) and scores of at least `least`, and above 0."""
        at = np.searchsorted(self.terms, query)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == query] if len(self.terms) else at[:0]
        at = at[np.argsort(-self.most[at], kind="stable")]
        rest = np.arange(len(at), -1, -1)
        by_coordinates = np.concatenate([np.cumsum(self.most[at][::-1])[::-1], [0]])
        by_length = np.sqrt(rest) * self.norm[0]
        closed = np.minimum(by_coordinates, by_length) * MARGIN < max(least, 1)
        k = int(np.argmax(closed))  # the first place from which the rest can't reach it; at the end nothing is left
        lists = [slice(self.start[x], self.start[x + 1]) for x in at[:k]]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, c = np.concatenate([self.by_row[x] for x in lists]), np.concatenate([self.by_c[x] for x in lists]).astype(float)
        has = np.bincount(rows, weights=c, minlength=len(self.norm))
        left = np.sqrt(rest[k] * np.maximum(self.norm**2 * MARGIN - np.bincount(rows, weights=c**2, minlength=len(self.norm)), 0))
        most = has + np.minimum(by_coordinates[k], left)
        found = np.flatnonzero((has > 0) & (most * MARGIN >= least))
        size = self.offsets[found + 1] - self.offsets[found]
        own = np.repeat(np.arange(len(found)), size)
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.offsets[found], size)
        asked = np.isin(self.term[place], query)
        scores = np.zeros(len(found), np.int64)
        np.add.at(scores, own[asked], self.c[place[asked]])
        keep = scores >= max(least, 1)
        return found[keep], scores[keep]


def search(vectors: DataFrame, queries: list[np.ndarray], least: np.ndarray, top: int = TOP) -> DataFrame:
    """query (its place), doc_id and score of each task's best documents, `top` for each query, that reach least[query]."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = shared.value[0], shared.value[1].copy()
        root = np.sqrt([len(q) for q in asked])
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            norm = batch.column("norm").to_numpy(zero_copy_only=False)
            ids = [(i is None, i or 0) for i in batch.column("doc_id").to_pylist()]
            (offsets, term), (_, c) = _flat(batch.column("terms")), _flat(batch.column("impacts"))
            order = np.argsort(-norm, kind="stable")
            for a in range(0, len(order), BUCKET):
                rows = order[a : a + BUCKET]
                alive = np.flatnonzero(root * norm[rows[0]] * MARGIN >= floor)
                if not len(alive):
                    break
                size = offsets[rows + 1] - offsets[rows]
                starts = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(starts[-1]) + np.repeat(offsets[rows] - starts[:-1], size)
                bucket = Bucket(norm[rows], starts, term[place], c[place])
                for q in alive.tolist():
                    found, scores = bucket.hits(asked[q], int(floor[q]))
                    if len(found):
                        if len(found) > top:  # all that tie with the last one stay, for their ids
                            last = np.partition(scores, -top)[-top]
                            found, scores = found[scores >= last], scores[scores >= last]
                        mine = best.get(q, []) + [(-s, *ids[rows[f]]) for f, s in zip(found.tolist(), scores.tolist(), strict=True)]
                        best[q] = sorted(mine)[:top]
                        if len(best[q]) == top:
                            floor[q] = max(floor[q], -best[q][-1][0])
        out = [(q, None if none else i, -s) for q, mine in best.items() for s, none, i in mine]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query int, doc_id bigint, score bigint")


def _shard(docs: DataFrame, items: list, scratch: Scratch, name: str, top: int) -> DataFrame:
    """item_id, rank, doc_id and score for some items, as rows of item_terms."""
    vocabulary, place = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in items]).view(np.uint64), return_inverse=True)
    ends = np.cumsum([len(r["terms"]) for r in items])
    queries = [np.sort(x).astype(np.int32) for x in np.split(place, ends[:-1])]
    counted = scratch.keep(frequencies(docs, vocabulary), f"{name}-counted")
    weight, n_docs, length = weights(counted, len(vocabulary))
    longest = F.col("norm").desc()
    vectors = scratch.keep(impacts(counted, weight, n_docs, length).repartitionByRange(longest, "doc_id").sortWithinPartitions(longest), f"{name}-vectors")
    scratch.drop(f"{name}-counted")
    least = np.zeros(len(items), np.int64)
    if n_docs:
        long_from = vectors.agg(F.percentile_approx("norm", max(0.0, 1 - SEED / n_docs))).first()[0]
        best = Window.partitionBy("query").orderBy(F.col("score").desc())
        first = search(vectors.where(F.col("norm") >= F.lit(long_from)), queries, least, top).withColumn("no", F.row_number().over(best))
        for r in first.where(F.col("no") == top).collect():  # a row an item of the shard
            least[r["query"]] = r["score"]
    reach = float((least / np.sqrt([len(q) for q in queries])).min() / MARGIN)
    found = search(vectors.where(F.col("norm") >= F.lit(reach)), queries, least, top)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    names = docs.sparkSession.createDataFrame([(k, r["item_id"]) for k, r in enumerate(items)], "query int, item_id long")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, scratch: Scratch, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` documents of each item."""
    asked = scratch.keep(item_terms(items), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_TERMS))
    out = None
    for k in range(shards):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k).orderBy("item").collect()  # about SHARD_TERMS terms
        if rows:
            part = _shard(docs, rows, scratch, f"shard-{k}", top)
            if shards > 1:  # one shard's vectors at a time
                part = scratch.keep(part, f"found-{k}")
                scratch.drop(f"shard-{k}-vectors")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked_search(docs, items, Scratch(spark, "op13"))


OP13_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{OP13_TERM}') AS a FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(a))::BIGINT AS terms FROM d WHERE len(a) > 0),
f AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(a) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM f GROUP BY t), s),
q AS (SELECT k, item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '{OP13_TERM}'))) AS t FROM (SELECT row_number() OVER () AS k, * FROM benchmark)),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(a)::BIGINT * docs) // terms) AS m FROM d, s WHERE len(a) > 0),
x AS (SELECT k, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY k, item_id, r, doc_id),
y AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""
