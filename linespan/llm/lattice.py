"""Operator 2: near-duplicate vectors by E8 lattice hashing.

In each of TABLES tables a vector of unit length is projected at random to two
blocks of 8 dimensions, each decoded to the nearest point of the lattice E8; the
two points, the label and the table are the key of its cell.  Vectors look into
their own cells and, by one step in either block, the neighbouring cells whose
points are nearest.  Candidates are verified by cosine in double precision.

So that a group of near copies isn't compared pair by pair, vectors within half
the angle of the threshold of their cell's leader (the smallest id) form a ball:
all pairs in it link, by the triangle inequality.  Cells then hold balls, not
vectors, and two balls are compared by their leaders: what the radii decide is
counted by sizes, and only what they leave open is compared member by member.

Measured against brute force on pairs at the threshold, recall is in the README;
what is reported is exact (no pair under the threshold).

Defined cases: null label, or a vector that is null, empty, zero, or holds null
or non-finite components, links with nothing; vectors of different lengths don't
link; of rows that repeat a vec_id the smallest (label, vector) stands for all,
and each row is reported; null ids are reported alone; ties don't arise;
extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import mix

COSINE, TABLES, SCALE, PROBES, SEED = 0.93, 5, 0.3, 8, 8_1931
U = np.uint64


def _steps() -> np.ndarray:
    """The 240 shortest vectors of E8, from their rule: two entries of size 1, or eight halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


STEPS = _steps()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers of even sum."""
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(1) % 2)
    k = np.abs(d[odd]).argmax(1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return f


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by halves."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def _key(label: np.ndarray, table: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = mix(label.astype(np.int64).view(np.uint64) + U(table))
    for c in (*first.T, *second.T):
        h = mix(h * U(0x9E3779B97F4A7C15) + (2 * c).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(1, keepdims=True)
    v = vectors / big
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cells(vectors: np.ndarray, label: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """For each table: keys of every vector, its own cell first, then the nearest neighbours."""
    dims = vectors.shape[1]
    rng = np.random.default_rng(SEED + dims)
    for t in range(TABLES):
        turn = np.linalg.qr(rng.normal(size=(max(dims, 16), 16)))[0][:dims]
        shift = rng.random(16) * 2
        x = unit(vectors) @ turn / (SCALE * math.sqrt(64 / max(dims, 16))) + shift
        blocks = [x[:, :8], x[:, 8:]]
        at = [e8(b) for b in blocks]
        keys = [_key(label, t, *at)]
        for k in (0, 1) if probes else ():
            near = np.argsort(-((blocks[k] - at[k]) @ STEPS.T), axis=1)[:, : probes // 2]
            for j in range(near.shape[1]):
                moved = at[k] + STEPS[near[:, j]]
                keys.append(_key(label, t, moved, at[1]) if k == 0 else _key(label, t, at[0], moved))
        yield np.stack(keys, 1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    n, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.concatenate([[0], np.cumsum(n)])
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def keyed(vectors: DataFrame, probes: int) -> DataFrame:
    """(key, ball, own) for every cell that a vector is in or looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball, label = batch.column("ball").to_numpy(), batch.column("label").to_numpy()
            for rows, m in _by_length(batch.column("v")):
                for keys in cells(m, label[rows], probes):
                    own = np.zeros(keys.shape, bool)
                    own[:, 0] = True
                    cols = [keys.ravel() + m.shape[1], np.repeat(ball[rows], keys.shape[1]), own.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "ball", "own"])

    return vectors.select("ball", "label", "v").mapInArrow(run, "key bigint, ball bigint, own boolean")


def _with_cosine(pairs: DataFrame, va: str, vb: str) -> DataFrame:
    """pairs without the two vector columns, with their cosine (-2 if lengths differ)."""
    rest = [c for c in pairs.columns if c not in (va, vb)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*rest).schema) + ", cosine double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, -2.0)
            other = {i: (rows, m) for rows, m in _by_length(batch.column(vb)) for i in (m.shape[1],)}
            for rows, m in _by_length(batch.column(va)):
                if m.shape[1] in other:
                    rows_b, mb = other[m.shape[1]]
                    both, i, j = np.intersect1d(rows, rows_b, return_indices=True)
                    out[both] = (unit(m[i]) * unit(mb[j])).sum(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out)], [*rest, "cosine"])

    return pairs.select(*rest, va, vb).mapInArrow(run, schema)


def near_vectors(table: DataFrame, scratch: Scratch, cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0)
    sound &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    vectors = scratch.keep(rows.where(sound).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v"), "vectors")

    # Balls: the smallest id of a cell leads those near enough to it.
    own = keyed(vectors.withColumn("ball", F.col("vec_id")), 0).select("key", F.col("ball").alias("vec_id"))
    lead = scratch.keep(own.groupBy("key").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "lead")
    led = own.join(lead, "key").where("vec_id > lead").select("vec_id", "lead").distinct()
    led = led.join(vectors.select("vec_id", "v"), "vec_id").join(vectors.select(F.col("vec_id").alias("lead"), F.col("v").alias("w")), "lead")
    inner = math.cos(math.acos(cosine) / 2 - 1e-9)
    led = scratch.keep(_with_cosine(led, "v", "w").where(F.col("cosine") >= inner).groupBy("vec_id").agg(F.min(F.struct("lead", "cosine")).alias("s")).select("vec_id", "s.*"), "led")
    led = led.join(led.select(F.col("vec_id").alias("lead")), "lead", "left_anti")  # leaders lead themselves
    balls = vectors.join(led, "vec_id", "left").select("vec_id", "label", "v", F.coalesce("lead", "vec_id").alias("ball"), F.coalesce("cosine", F.lit(1.0)).alias("near"))
    balls = scratch.keep(balls, "balls")
    size = balls.groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.min("near").alias("near"))
    heads = scratch.keep(balls.where("vec_id = ball").select("ball", "v").join(size, "ball"), "heads")

    # Balls that meet in a cell, compared by their heads.
    met = scratch.keep(keyed(balls, probes).groupBy("key", "ball").agg(F.max("own").alias("own")), "cells")
    index = met.where("own").select("key", F.col("ball").alias("b"))
    pairs = met.join(index, "key").where("ball != b").select(F.least("ball", "b").alias("a"), F.greatest("ball", "b").alias("b")).distinct()
    for side, v in (("a", "v"), ("b", "w")):
        pairs = pairs.join(heads.select(F.col("ball").alias(side), F.col("v").alias(v), F.col("members").alias(f"m{side}"), F.col("near").alias(f"near_{side}")), side)
    pairs = _with_cosine(pairs, "v", "w")
    spread = F.when((F.col("ma") == 1) & (F.col("mb") == 1), 0.0).otherwise(F.acos(F.least("near_a", F.lit(1.0))) + F.acos(F.least("near_b", F.lit(1.0))) + 1e-9)
    angle, most = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))), math.acos(cosine)
    single = (F.col("ma") == 1) & (F.col("mb") == 1)
    kind = F.when(single, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
    kind = kind.when(F.col("cosine") < -1.5, "none").when(angle + spread <= most, "all").when(angle - spread > most, "none").otherwise("some")
    pairs = scratch.keep(pairs.withColumn("kind", kind).where("kind != 'none'").select("a", "b", "ma", "mb", "kind"), "pairs")

    # What the radii leave open, member by member.
    member = balls.select("vec_id", "ball", "v")
    some = pairs.where("kind = 'some'").select("a", "b")
    some = some.join(member.select(F.col("ball").alias("a"), F.col("vec_id").alias("x"), "v"), "a")
    some = some.join(member.select(F.col("ball").alias("b"), F.col("vec_id").alias("y"), F.col("v").alias("w")), "b")
    some = scratch.keep(_with_cosine(some, "v", "w").where(F.col("cosine") >= cosine).select("a", "b", "x", "y"), "some")

    whole = pairs.where("kind = 'all'")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("mb").alias("c")).unionByName(whole.select(F.col("b").alias("ball"), F.col("ma").alias("c")))
    by_ball = by_ball.groupBy("ball").agg(F.sum("c").alias("of_balls"))
    by_vector = some.select(F.col("x").alias("vec_id")).unionByName(some.select(F.col("y").alias("vec_id"))).groupBy("vec_id").agg(F.count(F.lit(1)).alias("of_members"))
    edges = whole.select("a", "b").unionByName(some.select("a", "b").distinct())
    comps = components(edges, scratch, "cc").withColumnRenamed("node", "ball")
    found = balls.select("vec_id", "ball").join(size.select("ball", "members"), "ball").join(by_ball, "ball", "left").join(comps, "ball", "left").join(by_vector, "vec_id", "left")
    links = F.col("members") - 1 + F.coalesce("of_balls", F.lit(0)) + F.coalesce("of_members", F.lit(0))
    found = scratch.keep(found.select("vec_id", links.alias("n_links"), F.coalesce("comp", "ball").alias("component_id")), "found")
    scratch.drop_all_but("found")
    out = rows.select("vec_id").join(found, "vec_id", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def op2_lattice_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op2"))
