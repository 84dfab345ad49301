"""Operator 3: set-similarity join on word 5-grams (T-occurrence, DivideSkip).

A document's set holds the 64-bit hashes of its distinct 5-word shingles, in
lower case (A-Z); two sets link when their Jaccard similarity is at least 3/4,
which is an overlap of at least T = ceil(3 (|a| + |b|) / 7).

Equal sets are one class and only classes are joined.  The inverted list of a member
is the classes that have it; lists of more than LONG classes are long.  DivideSkip for
a class: of the lists of its members in order, short ones first, only the first
n - T + 1 are merged (T the least overlap with any partner, 3/4 n) and L lists are
skipped, all long ones before any short one.  The merge is Spark's sort-merge join on
the member with occurrences counted by pair; a pair is a candidate when its count
reaches T - L, L being what the skipped lists could still give that pair.  Lists that
were skipped are only probed, by binary search: their postings are kept by class, as
sorted members, first the lowest hashes of each set (which exclude most candidates)
and then, for classes that still have candidates, whole sets made again from the texts.
Pairs whose merged and probed occurrences reach T are links.  The order of the lists
changes the work, never the result.

Classes that can't do without long lists ("exhausted": fewer than n - T + 1 short ones)
are merged on these too, but no long list is joined with itself as a whole.  First
each class on it meets only one other, a pair a class: the one with the smallest share
s of members on short lists, which of near copies is the one with the fewest changes,
and, while the list still touches several components, one that a hash chooses anew for
each list, so a class meets as many others as it is on lists (TURNS turns).  What then still touches several components can only link
over long lists alone if (4 - 7 s) (4 - 7 s') >= 9, s' being the other's share; a class
that can't do so even with the smallest s of its list is left out.  Of classes with
equal long parts the smallest set stands for all (it links with whatever one of them
links with, and only over it need they be tied), so each different long part is held
against each class, not each class against each.  A pair leaves that join only if the
members behind its place in both lists could be enough, and if the odd sketches of the
long parts, which bound from below by how much they differ, leave enough in common.
That is the remaining limit: in a group of very many near copies with long parts of
their own, what isn't linked by the turns is compared, though not written, by pairs.

Joins are on hashes, so Spark splits hot keys.  The members of long lists are broadcast
while there are at most LONG_MAX of them (32 MB), and joined to the sets beyond that.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; texts under 5 words have one shingle, the whole; a text is linked by its
words whatever its id, so rows that repeat an id are separate documents with
that id, and null ids are linked but name no component; ties of ids don't occur
in the result, which is the least id; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .langid import free_name
from .scratch import Scratch
from .words import Words, mix, pieces, texts

N, LONG, LONG_MAX, TURNS, SKETCH = 5, 24, 4_000_000, 2, 8
LAST = (1 << 63) - 1
U = np.uint64
#: Sets of sizes that differ by more can't link.
SIZES = "4 * least({0}, {1}) >= 3 * greatest({0}, {1})"
#: Nor can sets that share at most the smaller of the first two numbers.
REACH = "7 * least({0}, {1}) >= 3 * ({2} + {3})"


class Sets:
    """Shingle sets of some texts: rows one after another, hashes ascending in each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int = N):
        w = Words(data, offsets, lower=True)
        at, h = w.windows(n)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        row = np.concatenate([w.row[at], short])
        h = np.concatenate([h, w.whole(short)])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        self.row, self.hash = row[new], h[new]
        self.size = np.bincount(self.row, minlength=w.rows)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (self.hash, mix(self.hash ^ U(0x5851F42D4C957F2D)))]
        a, b = (t[self.first[1:]] - t[self.first[:-1]] for t in total)
        self.key = mix(a + mix(b) + self.size.astype(np.uint64)).view(np.int64)

    def low_size(self) -> np.ndarray:
        p = prefix(self.size)
        return np.minimum(self.size, p + np.maximum(8, p // 2))


def prefix(size):
    return size - (3 * size + 3) // 4 + 1


def _binary(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    return [values[a : a + k].tobytes() for a, k in zip(first.tolist(), size.tolist(), strict=True)]


def _per_piece(docs: DataFrame, columns: str, make) -> DataFrame:
    """Rows made of the sets of each piece of documents: make(sets, ids) -> arrays."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in pieces(offsets):
                s = Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in make(s, batch.slice(a, b - a))], names)

    return docs.mapInArrow(run, columns)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key): the size of each row's set and the class that it is in; a column `row` of docs passes through."""
    row = [c for c in docs.columns if c == "row"]
    return _per_piece(
        docs.select("doc_id", "text", *row),
        "doc_id bigint, n bigint, key bigint" + ", row bigint" * len(row),
        lambda s, b: [b.column("doc_id").cast(pa.int64()), s.size, s.key, *[b.column(c) for c in row]],
    )


def classes(docs: DataFrame) -> DataFrame:
    """One row a class that isn't empty: key, n, its lowest hashes."""

    def make(s: Sets, _) -> list:
        keep = s.size > 0
        low = pa.array(_binary(s.hash, s.first[:-1], s.low_size()), pa.binary()).filter(pa.array(keep))
        return [s.key[keep], s.size[keep], low]

    return _per_piece(docs.select("text"), "key bigint, n bigint, low binary", make).dropDuplicates(["key"])


def whole_sets(docs: DataFrame) -> DataFrame:
    return _per_piece(docs.select("text"), "key bigint, n bigint, members binary", lambda s, _: [s.key, s.size, pa.array(_binary(s.hash, s.first[:-1], s.size), pa.binary())])


def _both_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    for side in ("a", "b"):
        one = table.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col(value).alias(f"s{side}"))
        pairs = pairs.join(one, side)
    return pairs


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some values are in a sorted array, by binary search."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def odd_sketch(members: np.ndarray) -> list[int]:
    """SKETCH numbers whose bits tell whether an odd count of members falls there.  Two sets differ
    in at least as many members as their sketches do in bits."""
    odd = np.bincount((mix(members ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Occurrences of a candidate on the lists of a set: the shorter sorted array probes the longer."""
    if len(x) > len(y):
        x, y = y, x
    return int(_among(x, y).sum())


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs whose overlap can reach T.  s holds a set's lowest hashes or all of it; what
    is not known of either side is counted as shared, so with whole sets this is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i, (sa, sb) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                for s, n in ((x, na[i]), (y, nb[i])):  # compare up to where both are known
                    if len(s) < n:
                        x, y = x[: np.searchsorted(x, s[-1], "right")], y[: np.searchsorted(y, s[-1], "right")]
                most = _overlap(x, y) + min(na[i] - len(x), nb[i] - len(y))
                keep[i] = 7 * most >= 3 * (na[i] + nb[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


class Join:
    """One run of the join over a table of documents (doc_id, text, perhaps a bigint `row`)."""

    def __init__(self, docs: DataFrame, scratch: Scratch, long: int = LONG):
        self.long = long
        row = [c for c in docs.columns if c == "row"]
        self.docs, self.scratch, self.step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row), scratch, 0
        self.links, self.comps, self.sets, self.tables = None, None, None, {}
        self.signatures = scratch.keep(signatures(self.docs), "signatures")
        self.classes = scratch.keep(classes(self.docs), "classes")

    def _keep(self, df: DataFrame, what: str) -> DataFrame:
        self.step += 1
        self.tables[what] = f"{self.step}-{what}"
        return self.scratch.keep(df, self.tables[what])

    def _drop(self, *what: str) -> None:
        self.scratch.drop(*[self.tables.pop(w) for w in what if w in self.tables])

    # --- whole sets, made from the texts once for each class that needs one

    def fetch(self, keys: DataFrame) -> DataFrame:
        """A table of whole sets (key, n, members) that has these classes."""
        if self.sets is not None:
            keys = keys.join(self.sets.select("key"), "key", "left_anti")
        one = self.signatures.join(keys.distinct(), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        one = self._keep(one, "chosen")
        if one.isEmpty():
            return self.sets
        # A class none of whose rows has an id is read from the rows without ids.
        found = self.docs.join(one.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(self.docs.where("doc_id is null"))
        made = self._keep(whole_sets(found).join(one.select("key"), "key", "left_semi").dropDuplicates(["key"]), f"sets{self.step}")
        self._drop("chosen")
        self.sets = made if self.sets is None else self.sets.unionByName(made)
        return self.sets

    def add(self, pairs: DataFrame) -> None:
        """Test pairs (a, b), on the lowest hashes and then on whole sets, and tie what links."""
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        pairs = self._keep(pairs.where("a != b").select(*ends).distinct(), "pairs")
        near = self._keep(_linked(_both_sides(pairs, self.classes, "low")), "near")
        if not near.isEmpty():
            sets = self.fetch(near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))))
            found = self._keep(_linked(_both_sides(near, sets, "members")), f"links{self.step}")
            if not found.isEmpty():
                self.links = found if self.links is None else self.links.unionByName(found)
                self.comps = self._keep(components(self.links, self.scratch, f"cc{self.step}"), f"comps{self.step}")
        self._drop("pairs", "near")

    def with_comp(self, df: DataFrame) -> DataFrame:
        if self.comps is None:
            return df.withColumn("comp", F.col("key"))
        return df.join(self.comps.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    # --- candidates

    def lists_of(self, sets: DataFrame, column: str) -> DataFrame:
        """(member, c): the lengths of all inverted lists of two classes or more, over sets in a binary column."""

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m, c = np.unique(np.frombuffer(b"".join(batch.column(column).to_pylist()), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(c)], ["member", "c"])

        counted = sets.select(column).mapInArrow(members, "member bigint, c bigint").groupBy("member").agg(F.sum("c").alias("c"))
        return self._keep(counted.where("c > 1"), f"lists-{column}")

    def with_long(self, sets: DataFrame, column: str, long: DataFrame) -> tuple[DataFrame, object]:
        """sets with `long_members`, those of their members that have long lists, or, where all
        long lists are few, without and with a broadcast of their members."""
        if long.count() <= LONG_MAX:
            found = np.sort(np.array([r["member"] for r in long.toLocalIterator()], np.int64).view(np.uint64))
            return sets, self.docs.sparkSession.sparkContext.broadcast(found)

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column(column)
                size = [len(x) // 8 for x in raw.to_pylist()]
                flat = np.frombuffer(b"".join(raw.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("key").to_numpy(), size)), pa.array(flat)], ["key", "member"])

        flat = sets.select("key", column).mapInArrow(members, "key bigint, member bigint")
        marked = flat.join(long, "member").groupBy("key").agg(F.collect_list("member").alias("long_members"))
        return sets.join(marked, "key", "left"), None

    def prefixes(self, sets: DataFrame, column: str, long: DataFrame, complete: bool) -> DataFrame:
        """(member, key, n, rest, last, long, at, part, sketch): the members whose lists are merged for each set,
        those of short lists first.  `rest`: how many lists are skipped, or how many long ones
        where all short ones are merged; `last`: where the merged ones end in the order of the
        hashes (the largest number in the latter case); of whole sets `at`: a long member's place among them, `part`
        and `sketch`: a hash and an odd sketch of all of them.  From lowest hashes alone, a set that lacks short members gives one row
        without a member."""
        sets, shared = self.with_long(sets, column, long)
        names = ["member", "key", "n", "rest", "last", "long", "at", "part", "sketch"]
        marked = shared is None

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts: list[tuple] = []
                own = batch.column("long_members").to_pylist() if marked else [None] * batch.num_rows
                for key, n, raw, mine in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column(column), own, strict=True):
                    m = np.frombuffer(raw.as_buffer(), np.uint64)
                    known = np.sort(np.array(mine or [], np.int64).view(np.uint64)) if marked else shared.value
                    is_long = _among(m, known)
                    p, short = int(prefix(n)), m[~is_long]
                    if len(short) >= p:
                        end = int((short[p - 1] ^ U(1 << 63)).astype(np.int64))
                        parts.append((short[:p], key, n, n - p, end, False, None, 0, None))
                    elif complete:
                        of_long = m[is_long]
                        part, bits = int(mix(of_long).sum().view(np.int64)), odd_sketch(of_long)
                        parts.append((short, key, n, n - len(short), LAST, False, None, part, None))
                        some = of_long[: p - len(short)]
                        parts.append((some, key, n, n - len(short), LAST, True, np.arange(len(some)), part, bits))
                    else:
                        parts.append((None, key, n, 0, 0, True, None, 0, None))
                if not parts:
                    continue
                count = np.array([1 if x[0] is None else len(x[0]) for x in parts])
                member = np.concatenate([np.zeros(1, np.uint64) if x[0] is None else x[0] for x in parts]).view(np.int64)
                lacking = np.repeat([x[0] is None for x in parts], count)
                cols = [np.repeat(np.array([x[i] for x in parts], t), count) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int64), (5, bool))]
                at = np.concatenate([np.zeros(c, np.int32) if x[6] is None else x[6].astype(np.int32) for x, c in zip(parts, count, strict=True)])
                part = np.repeat(np.array([x[7] for x in parts], np.int64), count)
                sketch = pa.array([x[8] for x in parts], pa.list_(pa.int64())).take(pa.array(np.repeat(np.arange(len(parts)), count)))
                yield pa.RecordBatch.from_arrays([pa.array(member, mask=lacking), *map(pa.array, (*cols, at, part)), sketch], names)

        columns = ["key", "n", column] + ["long_members"] * marked
        return sets.select(*columns).mapInArrow(emit, "member bigint, key bigint, n int, rest int, last bigint, long boolean, at int, part bigint, sketch array<bigint>")

    def postings(self) -> DataFrame:
        """The rows of merged lists that several classes are on."""
        lists = self.lists_of(self.classes, "low")
        long = self._keep(lists.where(f"c > {self.long}").select("member"), "long")
        lacking = self._keep(self.prefixes(self.classes, "low", long, False), "prefixes")
        exhausted = self._keep(lacking.where("member is null").select("key"), "exhausted0")
        whole = None
        if not exhausted.isEmpty():
            # Lists of their other members can be long too: count them on whole sets.
            whole = self.fetch(exhausted)
            more = self.lists_of(whole.join(exhausted, "key", "left_semi"), "members").where(f"c > {self.long}").select("member")
            long = self._keep(long.unionByName(more).distinct(), "long1")
            lacking = self._keep(self.prefixes(self.classes, "low", long, False), "prefixes1")
            self._drop("prefixes", "exhausted0", "long", "lists-members")
        made = self._keep(lacking.where("member is not null").join(lists.select("member"), "member", "left_semi"), "short")
        if whole is not None:
            exhausted = self._keep(lacking.where("member is null").select("key"), "exhausted")
            whole = self.fetch(exhausted).join(exhausted, "key", "left_semi")
            whole = self._keep(self.prefixes(whole, "members", long, True), "whole")
            # Members that only whole sets brought in may meet in lists that weren't counted.
            own = whole.select("member").distinct().join(lists.select("member"), "member", "left_anti")
            in_low = lacking.where("member is not null").join(own, "member", "left_semi")
            made = self._keep(made.unionByName(in_low).unionByName(whole), "postings")
        self._drop("lists-low", "long", "long1", "prefixes", "prefixes1", "exhausted0", "exhausted", *["short", "whole"] * (whole is not None))
        return made

    def contested(self, postings: DataFrame) -> DataFrame:
        """Postings of members that classes of several components have."""
        known = self._keep(self.with_comp(postings), f"known{self.step}")
        several = known.groupBy("member").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("member")
        return self._keep(known.join(self._keep(several, f"several{self.step}"), "member", "left_semi"), f"contested{self.step}")

    def judge(self) -> DataFrame:
        """The signatures with the component (comp, a class) that each row is in."""
        postings = self.contested(self.postings())
        share = 1 - F.col("rest") / F.col("n")  # of a class's members on short lists
        reach = lambda s, t: (4 - 7 * s) * (4 - 7 * t) >= 9 - 1e-9
        differ = sum((F.bit_count(F.col("sketch_x")[k].bitwiseXOR(F.col("sketch_y")[k])) for k in range(SKETCH)), F.lit(0))
        # Over long lists alone: the members from here on, and those that the sketches leave, must be enough.
        over_long = "key_x != key_y and comp_x != comp_y and " + SIZES.format("n_x", "n_y") + " and " + REACH.format("(rest_x - at_x)", "(rest_y - at_y)", "n_x", "n_y")
        enough = 7 * (F.col("rest_x") + F.col("rest_y") - differ) >= 6 * (F.col("n_x") + F.col("n_y"))
        names = ("key", "n", "rest", "comp", "at", "sketch")
        fewest, ends = None, [F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")]
        for turn in range(TURNS):
            long = postings.where("long")
            if long.isEmpty():
                break
            if fewest is None:
                fewest = self._keep(long.groupBy("member").agg(F.min(share).alias("least")), "fewest")
                first = share
            else:  # the leaders of the first turn have met all that are on their lists
                first = F.xxhash64("key", "member", F.lit(turn))
            lead = long.groupBy("member").agg(F.min(F.struct(first.alias("first"), *names)).alias("lead"))
            lead = self._keep(lead.select("member", *[F.col(f"lead.{c}").alias(f"{c}_x") for c in names]), "leads")
            tied = long.select("member", *[F.col(c).alias(f"{c}_y") for c in names]).join(lead, "member")
            # A leader may share short members with a class as well: only what is known of both counts.
            sizes = "comp_x != comp_y and " + SIZES.format("n_x", "n_y") + " and " + REACH.format("rest_x", "rest_y", "n_x", "n_y")
            self.add(tied.where(sizes).where(enough).select(*ends))
            postings = self.contested(postings.drop("comp"))
        x, y = (postings.select("member", *[F.col(c).alias(f"{c}_{s}") for c in (*names, "last", "long")], share.alias(f"s_{s}")) for s in ("x", "y"))
        met = x.where("not long_x").join(y.where("not long_y"), "member").where("key_x < key_y and comp_x != comp_y and " + SIZES.format("n_x", "n_y"))
        more = None
        if fewest is not None:
            # Of classes with the same long part the smallest stands for all: who links with one of them
            # over long lists alone links with it, and it is on all lists that the others are on.
            head = postings.where("long").groupBy("member", "part").agg(F.min(F.struct("n", *[c for c in names if c != "n"])).alias("of"))
            head = head.select("member", *[F.col(f"of.{c}").alias(f"{c}_x") for c in names])
            other = y.where("long_y").join(fewest, "member").where(reach(F.col("s_y"), F.col("least")))
            more = head.join(other, (head["member"] == other["member"]) & F.expr(over_long) & enough).select(*ends).distinct()
        # Shared short members up to the nearer end of the two prefixes are all counted;
        # beyond it no more can be shared than the sets have left there.
        left = F.when(F.col("last_x") < F.col("last_y"), F.col("rest_x")).when(F.col("last_x") > F.col("last_y"), F.col("rest_y")).otherwise(F.least("rest_x", "rest_y"))
        counted = met.groupBy(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).agg(
            F.count(F.lit(1)).alias("shared"), F.min(left).alias("left"), F.min(F.col("n_x") + F.col("n_y")).alias("both")
        )
        counted = counted.where("7 * (shared + left) >= 3 * both").select("a", "b")
        self.add(counted if more is None else counted.unionByName(more))
        return self.with_comp(self.signatures)

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every document."""
        sig = self.judge()
        least = self._keep(sig.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "named")
        out = sig.join(least, "comp", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, scratch: Scratch, long: int = LONG) -> DataFrame:
    # A column `row` of the input is an extra column like any other here.
    return Join(docs.select("doc_id", "text"), scratch, long).run()


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op3"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row.  Nulls don't enter Spark's hash, so which columns are null is hashed too;
    maps and variants, which it refuses, are hashed as JSON."""
    at = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    plain = [F.to_json(F.struct(at[c]), {"ignoreNullFields": "false"}) if "map<" in kind or "variant" in kind else at[c] for c, kind in docs.dtypes]
    return F.xxhash64(*plain, *[x.isNull() for x in at.values()])


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of the least id (a row without one comes last), and
    all rows without words.  Rows that share an id are told apart by a hash of all columns; columns of any
    type and name pass through, and an empty table stays empty."""
    scratch = Scratch(spark, "pipeline-join")
    row = row_hash(docs)
    join = Join(docs.select("doc_id", "text", row.alias("row")), scratch)
    judged = scratch.keep(join.judge().where("n > 0").groupBy("comp", "doc_id", "row").agg(F.count(F.lit(1)).alias("c")), "judged")
    one = judged.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "c")).alias("one"))
    kept = scratch.keep(one.select(F.col("one.doc_id").alias("id"), F.col("one.row").alias("row"), F.col("one.c").alias("c")), "kept")
    scratch.drop_all_but("kept")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own, id_, of, c = (free_name(docs, n) for n in ("_row", "_id", "_of", "_c"))
    known = docs.where(has_words).withColumn(own, row)

    def chosen(which: str) -> DataFrame:
        least = kept.where(which).select(F.col("id").alias(id_), F.col("row").alias(of), F.col("c").alias(c))
        same = (F.col(own) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
        return known.join(least, same, "left_semi")

    out = docs.where(~has_words).unionByName(chosen("c = 1").drop(own))
    # Rows that repeat in all columns are rare: one of each is taken only where there are any.
    if kept.where("c > 1").limit(1).count():
        out = out.unionByName(chosen("c > 1").dropDuplicates([own, "doc_id"]).drop(own))
    return out
