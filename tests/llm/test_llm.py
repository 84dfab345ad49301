"""The ten operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linespan.llm import decontaminate, encoding, langid, lattice, mixing, ngram_join, quality, substring, tokens, urlfilter, words
from linespan.llm.binary import tokenized
from linespan.llm.components import components
from linespan.llm.scratch import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, member string"


def _rows(seed=1, n=160):
    """Documents with copies, near copies, a shared passage, nulls, empties, a long one and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)] + ["Ähre", "niño", "The", "THE", "x\u00a0y"]
    passage = [r.choice(vocab) for _ in range(60)]
    base = [r.choice(vocab) for _ in range(120)]
    out = []
    for i in range(n):
        kind = i % 8
        w = [r.choice(vocab) for _ in range(r.randint(0, 90))]
        if kind == 1:
            w = w[:30] + passage + w[30:]
        elif kind == 2:
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 3 and i > 8:
            w = out[i - 8][1].split() if out[i - 8][1] else w
        sep = [" ", "  ", "\n", "\t"][i % 4]
        out.append((i * 3 + 1, sep.join(w), ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], 0, "k", "m"))
    out += [(1000, None, "en", "s1", 0, None, None), (1001, "", None, None, 0, None, None), (1002, " \n\t", "en", "s2", 0, None, None), (1003, "one two", "en", "s1", 0, None, None)]
    out += [(1004, "One Two", "en", "s1", 0, None, None), (1005, " ".join(r.choice(vocab) for _ in range(30_000)), "en", "s1", 0, None, None), out[10], out[10]]
    return out


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def _words(t, lower=False):
    b = (t or "").encode()
    return WORD.findall(b.lower() if lower else b)  # bytes.lower() is A-Z alone


def test_hashes_tell_words_apart():
    texts = ["a b c", "", "a  b\tc", "ab c", None]
    d, o = words.texts(pa.array(texts))
    w = words.Words(d, o)
    assert w.count.tolist() == [3, 0, 3, 2, 0]
    h = [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(5)]
    assert h[0] == h[2] and h[3][1] == h[0][2] and len({*h[0], *h[3]}) == 4


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    r = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "É", "ß", "1", "23", "<|endoftext|>", "!", "\u0301", "İ", "Σ", "\u3000", "\u00a0", "\x1c", "…", "日本", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(3000)] + ["", None, " "]
    e = encoding.Encoder(public_tokenizers.path(name))
    d, o = words.texts(pa.array(texts))
    ids, counts = e.encode(d, o)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == e.whole([t or "" for t in texts])


def test_op1(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = sorted((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = tokens.token_counts(docs, path).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokens.token_counts(empty, path).count() == 0
    # Tables of every prefix, stored and read back, and the cut of the query, against the library.
    text = {r[0]: r[1] or "" for r in rows if r[0] < 100 or r[0] in (1000, 1001, 1002)} | {7000: "r" * 90 + "日本語" * 200 + "<|endoftext|>'re!  \n x", 7001: "don't  \u3000 stop"}
    some = spark_of(docs).createDataFrame(list(text.items()), "doc_id long, text string")
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for row in Scratch(spark_of(docs), "t1").keep(tokens.prefix_tables(some, path), "tables").collect():
        table, x = tokens.PrefixTable(row["ends"], row["counts"]), text[row["doc_id"]]
        want = [count(x[:i]) for i in range(len(x) + 1)]
        assert list(row["counts"]) == want and list(row["ends"]) == [len(x[:i].encode()) for i in range(len(x) + 1)]
        for limit in (0, 3, 20, 10_000):
            fits = max(i for i, c in enumerate(want) if c <= limit)
            assert table.cut(limit) == len(x[:fits].encode()) and table.at(table.cut(limit)) <= limit
    for limit in (1, 7, 40):
        for row in tokens.token_counts(some, path, limit).collect():
            x = text[row["doc_id"]]
            assert row["cut_bytes"] == len(x[: max(i for i in range(len(x) + 1) if count(x[:i]) <= limit)].encode())


def spark_of(df):
    return df.sparkSession


def _components(sets):
    inv = collections.defaultdict(list)
    for k, v in sets.items():
        for x in v:
            inv[x].append(k)
    par = {k: k for k in sets}

    def f(x):
        while par[x] != x:
            x = par[x]
        return x

    for k, v in sets.items():
        for y, i in collections.Counter(y for x in v for y in inv[x] if y > k).items():
            if 100 * i >= 75 * (len(v) + len(sets[y]) - i):
                a, b = f(k), f(y)
                par[max(a, b)] = min(a, b)
    return {k: f(k) for k in sets}


@pytest.mark.parametrize(("long", "most"), [(24, 4_000_000), (3, 4_000_000), (3, 0)])
def test_op3(spark, docs, rows, empty, long, most, monkeypatch):
    monkeypatch.setattr(ngram_join.Join.__init__, "__defaults__", (long,))
    monkeypatch.setattr(ngram_join.jaccard_components, "__defaults__", (long,))
    monkeypatch.setattr(ngram_join, "LONG_MAX", most)
    sets = {}
    for r in rows:
        w = _words(r[1], True)
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = _components(sets)
    got = ngram_join.jaccard_components(docs, Scratch(spark, "t3")).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(k, len(v), comp[k]) for k, v in sets.items()}
    if (long, most) != (3, 4_000_000):
        return
    kept = ngram_join.stage_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, c in comp.items() if k == c)
    assert ngram_join.jaccard_components(empty, Scratch(spark, "t3")).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    r = random.Random(8)
    a, b, c, d, e = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "abcde")
    near = a + " tail"
    rows = [
        (1, a, "x"), (2, near, "x"), (2, b, "x"),  # one of two rows of id 2 is a near copy
        (3, c, "x"), (3, d, "x"), (3, " \n", "x"), (3, None, "x"),  # unrelated texts, and rows without words, under one id
        (4, c, "x"), (None, near, "x"), (None, d, "x"),  # copies without an id
        (None, e, None), (None, e + " tail", "x"), (None, e, None), (None, "", "x"), (None, None, "x"),  # a group without any id
        (5, e.upper() + " more words", None), (6, "same id and words", None), (6, "same id and words", "x"), (6, "Same id and words", "x"),
        (7, "swapped nulls", "x"), (7, "swapped nulls", None),
    ]
    for n in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if n == 1 else rows, "doc_id long, text string, lang string").repartition(n)
        got = [tuple(x) for x in ngram_join.stage_near_duplicates(spark, docs, "").collect()]
        assert collections.Counter((i, t) for i, t, _ in got if i not in (6, 7)) == collections.Counter(
            [(1, a), (2, b), (3, c), (3, d), (3, " \n"), (3, None), (5, e.upper() + " more words"), (None, ""), (None, None)]
        )
        assert [x[0] for x in got].count(6) == [x[0] for x in got].count(7) == 1
        again = sorted(got, key=repr)
        first = again if n == 1 else first
        assert again == first
    alone = spark.createDataFrame([(None, e, None), (None, e + " tail", "x"), (None, e, None)], docs.schema)
    got = ngram_join.stage_near_duplicates(spark, alone, "").collect()
    assert len(got) == 1 and got[0]["doc_id"] is None


def test_near_duplicates_keep_columns_of_any_name_and_type(spark):
    r = random.Random(9)
    a, b = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "ab")
    schema = "doc_id long, text string, _row string, _id long, _of map<string,int>, _c array<map<int,string>>, `a.b` double"
    rows = [(1, a, "keep me", 9, {"x": 1, "y": None}, [{1: "z"}], 0.5), (2, a + " tail", "gone", 1, {}, None, None), (3, b, None, None, None, [], 1.0)]
    rows += [(4, "same words here", "r", 1, {"k": 2}, None, 2.0)] * 2 + [(5, None, "n", 0, None, None, None), (6, " ", None, 0, {"q": 0}, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = ngram_join.stage_near_duplicates(spark, docs.repartition(3), "")
    assert got.schema == docs.schema
    want = [rows[0], rows[2], rows[3], rows[5], rows[6]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    empty = ngram_join.stage_near_duplicates(spark, docs.where("false"), "")
    assert empty.schema == docs.schema and empty.collect() == []


def test_op8_null_and_repeated_ids(spark, monkeypatch):
    r = random.Random(3)
    passage, other = ([f"{k}{r.randrange(10**6)}" for _ in range(70)] for k in "po")
    new = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    # Long and short texts under one id and under none, in one piece with rows of clean ids.
    rows = [
        (1, passage + new(20)), (5, new(300) + passage), (5, new(9)), (5, passage[:55]), (6, new(30) + other), (7, other + new(30)),
        (None, new(400) + passage), (None, new(3)), (None, other[:60]), (None, []), (8, new(5) + other), (9, new(40)), (5, new(9)), (None, new(60) + passage),
    ]
    last, first, want = 1 << 62, {}, []
    for i, w in rows:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), last), last if i is None else i)
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (last if i is None else i):
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    for hot in (200, 1):
        monkeypatch.setattr(substring, "HOT", hot)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1)
        got = [tuple(x) for x in substring.substring_dedup(df, Scratch(spark, "t8")).collect()]
        assert collections.Counter(got) == collections.Counter(want)


def test_op8(spark, docs, rows, empty):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        w = _words(r[1])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), r[0])
    want = set()
    for r in rows:
        w = _words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < r[0]:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.add((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substring.substring_dedup(docs, Scratch(spark, "t8")).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want and any(w[2] for w in want)
    assert substring.substring_dedup(empty, Scratch(spark, "t8")).count() == 0


def test_op8_hot_blocks(spark, docs, monkeypatch):
    a = {tuple(r) for r in substring.substring_dedup(docs, Scratch(spark, "t8")).collect()}
    monkeypatch.setattr(substring, "HOT", 3)
    assert {tuple(r) for r in substring.substring_dedup(docs, Scratch(spark, "t8")).collect()} == a


def test_op8_more_buckets_than_shelves(spark, docs, monkeypatch):
    a = {tuple(r) for r in substring.substring_dedup(docs, Scratch(spark, "t8")).collect()}
    monkeypatch.setattr(substring, "FAN", 8)
    monkeypatch.setattr(substring, "BUCKET", 500)
    assert {tuple(r) for r in substring.substring_dedup(docs, Scratch(spark, "t8")).collect()} == a
    h = words.mix(np.arange(600_000, dtype=np.uint64))
    assert len(np.unique(substring.bucket_of(h, 200_000))) > 180_000 and substring.bucket_of(h, 1 << 31).max() < 1 << 31
    marked = docs.select("doc_id", "text", F.lit(0).cast("long").alias("part"))
    empty = np.zeros(0, np.uint64)
    monkeypatch.setattr(substring, "FAN", 1 << 20)
    want = {tuple(r) for r in substring.hits(marked, 100_000, empty, empty).collect()}
    monkeypatch.setattr(substring, "FAN", 64)
    assert want and {tuple(r) for r in substring.hits(marked, 100_000, empty, empty).collect()} == want


def test_op9(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t, n, want = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], n, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        n += len(ids)
    assert sorted(tuple(r) for r in tokenized(spark, docs, path, "t9").collect()) == sorted(want)
    assert tokenized(spark, empty, path, "t9").count() == 0


def test_op9_null_and_repeated_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    from linespan.llm import binary

    t = Tokenizer.from_file(path)
    rows = [(None, f"no id {i % 50}") for i in range(400)] + [(5, f"five {i}") for i in range(400)] + [(i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scratch = Scratch(spark, "t9")
        uri = scratch.path("tokens")
        manifest = scratch.keep(binary.write(df, uri, path), "manifest")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = manifest.collect()
    assert len(parts) == 4 and max(p["docs"] for p in parts) < 500  # an id, or having none, is no part of its own
    store, root = binary._store(uri)
    with store.open_output_stream(f"{root}/_lost.ids") as f:
        f.write(b"x")
    binary.sweep(uri)
    from pyarrow import fs

    assert len(store.get_file_info(fs.FileSelector(root))) == 3 * len(parts)
    back = binary.read(scratch.keep(binary.based(manifest), "based"), uri)
    assert back.rdd.getNumPartitions() == len(parts)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in back.collect()))
    assert [g[1] is None for g in got] == [True] * 400 + [False] * 420 and [g[1] for g in got[400:]] == sorted(g[1] for g in got[400:])
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got]).tolist()[:-1]]
    want = collections.Counter((i, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, x in rows)
    assert collections.Counter((g[1], g[3]) for g in got) == want


def test_op6(spark, docs, empty):
    got = mixing.plan(docs, Scratch(spark, "t6")).collect()
    by = collections.defaultdict(int)
    for r in got:
        by[r["source"]] += r["_mix_size"]
        assert r["_mix_copies"] <= 2
    target = {r["source"]: r["_mix_target"] for r in got}
    assert abs(sum(target.values()) - 1.5 * sum(by.values())) < 1e-6 and all(target[s] <= 2 * by[s] for s in by)
    again = {(r["doc_id"], r["_mix_copies"]) for r in mixing.plan(docs.repartition(7), Scratch(spark, "t6")).collect()}
    assert again == {(r["doc_id"], r["_mix_copies"]) for r in got}
    assert mixing.mix(docs, Scratch(spark, "t6")).count() == sum(r["_mix_copies"] for r in got)
    assert mixing.plan(empty, Scratch(spark, "t6")).count() == 0


def _deal(size, weights=(5.0, 2.0, 1.0)):
    """Targets by dealing the excess again until none is above its cap."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * size[s] for s in full}
        left, free = left - sum(2.0 * size[s] for s in full), free - full
    return target


def test_op6_targets_of_many_sources(spark):
    r = random.Random(12)
    size = {f"host{i}.example": r.choice([0, 1, 5, 50, 1000]) for i in range(500)} | {None: 77, "": 3}
    df = spark.createDataFrame(list(size.items()), "source string, source_size long").repartition(9)
    got = {x["source"]: x["target"] for x in mixing.allocate(df, Scratch(spark, "t6")).collect()}
    want = _deal(size)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_op6_null_and_repeated_ids_come_near_their_targets(spark):
    """Rows that share an id, or have none, and rows that are equal, don't draw all alike."""
    rows = [(None, f"a b c{i}", "s1", i) for i in range(400)] + [(None, "all the same", "s2", i) for i in range(300)] + [(9, "one id", "s3", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    got = mixing.plan(df, Scratch(spark, "t6")).collect()
    taken, target = collections.Counter(), {}
    for x in got:
        taken[x["source"]] += x["_mix_copies"] * x["_mix_size"]
        target[x["source"]] = x["_mix_target"]
        assert x["_mix_copies"] <= 2
    assert abs(taken["s2"] - target["s2"]) <= 3 and abs(taken["s3"] - target["s3"]) <= 2 and abs(taken["s1"] - target["s1"]) < 0.12 * target["s1"]
    again = collections.Counter((x["source"], x["text"], x["_mix_copies"]) for x in mixing.plan(df.repartition(3), Scratch(spark, "t6")).collect())
    assert again == collections.Counter((x["source"], x["text"], x["_mix_copies"]) for x in got)
    assert collections.Counter(r["extra"] for r in mixing.mix(df, Scratch(spark, "t6")).collect())


def test_op7(spark, docs, rows, empty):
    learnt = langid.learn(docs)
    assert set(learnt) == {"en", "de"}
    got = {r["doc_id"]: r["_lang"] for r in langid.identify(docs, learnt).collect()}
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identify(docs, {}).where("_lang.lang_pred != 'und'").count() == 0
    assert langid.identify(empty, learnt).count() == 0


def test_op7_letters_and_names(spark, docs):
    learnt = langid.learn(docs)
    odd = [(0, "½ ² Ⅷ"), (1, "1 2 _ !"), (2, "ª"), (3, "日本"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in odd], "doc_id long, text string, lang string, _lang string, __lang string")
    got = {r["doc_id"]: r["r"]["lang_pred"] for r in langid.identify(df, learnt, column="r").collect()}
    assert [k for k, v in got.items() if v == "und"] == [0, 1, 4, 5]
    assert langid.stage_language(spark, df, "").columns == df.columns


def test_op7_sample_is_bounded(spark):
    long = " ".join(f"wort{i}" for i in range(50_000))
    df = spark.createDataFrame([(i, long + chr(97 + i % 3) * 9, f"l{i % 7}") for i in range(60)], "doc_id long, text string, lang string")
    got = df.select(langid.slices(F.col("text"), 1_365).alias("s"), "text").collect()
    assert all(len(r["s"]) <= 1_365 + 2 and r["s"][:455] == r["text"][:455] and r["s"][-455:] == r["text"][-455:] for r in got)
    assert len(langid.learn(df)) == 7 and all(len(v) <= langid.DICT_BYTES for v in langid.learn(df).values())
    assert sum(map(len, langid.learn(df, total_bytes=7_000).values())) <= 7_000


def test_op7_learns_every_language(spark):
    """300 languages: also the rarest can be predicted, and what is learnt keeps its bound."""
    word = lambda k, i: f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i % 26)}{k * 7 + i % 5}"
    rows = [(k * 10 + i, " ".join(word(k, i * 31 + j) for j in range(40)), f"l{k:03}") for k in range(300) for i in range(2 if k % 3 else 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r["lang"] for r in df.where(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    learnt = langid.learn(df)
    assert set(learnt) == known and len(known) > 290 and sum(map(len, learnt.values())) <= langid.TOTAL_BYTES
    assert set(langid.learn(df, total_bytes=300_000)) == known
    got = langid.identify(df.where(F.col("doc_id") % 97 == 0), learnt).collect()
    assert len(got) > 5 and sum(r["_lang"]["lang_pred"] == r["lang"] for r in got if r["lang"] in known) >= 0.9 * len(got)


def test_op7_by_compressing_one_at_a_time(spark, docs, rows):
    """Sizes and winner against the library called for each text and dictionary."""
    import zstandard as Z

    learnt = langid.learn(docs)
    p = Z.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.SEGMENT, dict_size=langid.DICT_BYTES, write_content_size=False, write_dict_id=False)
    got = {r["doc_id"]: r["_lang"] for r in langid.identify(docs, learnt).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            continue
        data, sizes = r[1].lower().encode(), []
        for lang, d in learnt.items():
            c = Z.ZstdCompressor(compression_params=p, dict_data=Z.ZstdCompressionDict(d, dict_type=Z.DICT_TYPE_RAWCONTENT))
            sizes.append((sum(len(c.compress(data[i : i + langid.SEGMENT])) for i in range(0, len(data), langid.SEGMENT)), lang))
        (a, lang), (b, _) = sorted(sizes)
        assert got[r[0]]["lang_pred"] == lang and abs(got[r[0]]["score"] - (1 - a / b)) < 1e-12


def test_op7_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op7_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_op2(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(250, 64))
    vec = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i, v in enumerate(base):
        u, o = v / np.linalg.norm(v), r.normal(size=64)
        o -= o @ u * u
        c = r.uniform(0.925, 0.97)
        vec.append((1000 + i, (c * u + np.sqrt(1 - c * c) * o / np.linalg.norm(o)).tolist(), i % 3))
    vec += [(3000 + k, (base[0] + r.normal(size=64) * 0.05).tolist(), 0) for k in range(80)]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0] * 64, None), (9004, [], 1), (9005, [None, 1.0], 1), (9006, [2.0, 1.0], 1), (9007, [4.0, 2.0], 1)]
    df = spark.createDataFrame(vec + odd + odd[:1], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {x["vec_id"]: x for x in lattice.near_vectors(df, Scratch(spark, "t2")).collect()}
    want = collections.Counter()
    for label in range(3):
        ids = [v[0] for v in vec if v[2] == label]
        e = np.array([v[1] for v in vec if v[2] == label])
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        for i, j in zip(*np.where(np.triu(e @ e.T, 1) >= 0.93), strict=True):
            want[ids[i]] += 1
            want[ids[j]] += 1
    assert all(got[k]["n_links"] <= want[k] for k in got if k < 9000)
    assert sum(got[k]["n_links"] for k in got if k < 9000) >= 0.97 * sum(want.values())
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(9000, 9006)) and got[9007]["component_id"] == 9006
    assert lattice.near_vectors(df.limit(0), Scratch(spark, "t2")).count() == 0


def test_e8_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.e8(x)
    d = ((x - p) ** 2).sum(1)
    assert len(lattice.STEPS) == 240 and all((d <= ((x - p - s) ** 2).sum(1) + 1e-9).all() for s in lattice.STEPS)


def test_op4(spark):
    urls = ["http://a.example.net/en/1", "http://b.net/x", "https://Example.COM/de/9?q", "http://x.org/fr/", "http://x.org", None, "no-url", "https://cheap-pills.example.com/en/1",
            "https://www.library.example.org/en/4", "http://www.example.net", "x://A.B/C?d#e"]
    df = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: r for r in urlfilter.judge(df, urlfilter.train(urlfilter.seeds(spark))).collect()}
    assert [got[i]["rule"] for i in range(5)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None]
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "block", "allow"]
    assert (got[5]["host"], got[6]["path"], got[10]["host"], got[10]["path"]) == ("", "", "a.b", "/C")
    assert got[7]["verdict"] == "block" and got[8]["verdict"] == "allow" and got[9]["rule"] is None and got[11]["verdict"] == "allow"


def test_op4_held_out_accuracy(spark):
    blocked, allowed = urlfilter.accuracy(spark)
    assert blocked >= 0.6 and allowed >= 0.98


def test_op4_by_hand(spark):
    """Probabilities from the weights and the n-grams of one url at a time; an empty table and a very long url."""
    model = urlfilter.train(urlfilter.seeds(spark))
    urls = ["https://casino.example.com/win/now?x", "http://library.example.org/", "ftp://a/" + "b" * 50_000, None, "none"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(df, model).collect()}
    for i, r in got.items():
        grams = set()
        for mark, t in (("h", f"^{r['host']}$"), ("p", r["path"])):
            grams |= {mark + t[k : k + n] for n in urlfilter.SIZES for k in range(len(t) - n + 1)}
        from pyspark.ml.feature import HashingTF

        tf = HashingTF(numFeatures=urlfilter.FEATURES)
        z = model.intercept + sum(float(model.coefficients[j]) for j in {tf.indexOf(g) for g in grams})
        assert abs(r["p_block"] - 1 / (1 + np.exp(-z))) < 1e-9 and (r["rule"] or r["verdict"] == ("block" if r["p_block"] >= 2 / 3 else "allow")), i
    assert urlfilter.judge(df.limit(0), model).count() == 0


def test_op5(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 0), (7, 0, 1), (None, 1, 1), (10, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, Scratch(spark, "t5"), 0.25).collect()
    k = round(0.25 * len(got))
    best = sorted(got, key=lambda r: (-r["key"], r["doc_id"]))[:k]
    assert sum(r["kept"] for r in got) >= k and {r["doc_id"] for r in best} == {r["doc_id"] for r in got if r["kept"]}
    assert quality.resample(empty, labels, Scratch(spark, "t5")).count() == 0
    assert quality.resample(docs, labels.limit(0), Scratch(spark, "t5")).where("not kept").count() == 0


def test_op5_narrows_bins(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 5)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("log_weight"), (F.hash("id") % 1000).cast("double").alias("key"))
    kept = {r["doc_id"] for r in quality.top(df, 700).where("kept").collect()}
    assert kept == {r["doc_id"] for r in df.orderBy(F.col("key").desc(), "doc_id").limit(700).collect()}


def test_op5_ratios_and_weights(spark, docs, rows):
    """The models and weights by counting n-grams one text at a time."""
    def grams(text):
        d, o = words.texts(pa.array([text], pa.string()))
        w = words.Words(d, o)
        return [int(h) % quality.BUCKETS for h in (*w.hash, *w.windows(2)[1])]

    good = {r[0] for r in rows if r[0] % 5 == 1}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in {r[0] for r in rows}], "doc_id long, quality int, toxic int")
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(grams(r[1]))
        target.update(grams(r[1]) if r[0] in good else ())
    ratio = quality.ratios(docs, labels)
    norm = [sum(c.values()) + quality.BUCKETS for c in (target, raw)]
    want = [np.log((target[b] + 1) / norm[0]) - np.log((raw[b] + 1) / norm[1]) for b in range(quality.BUCKETS)]
    assert np.allclose(ratio, want)
    got = {r["doc_id"]: r["log_weight"] for r in quality.scores(docs, ratio).collect()}
    assert all(abs(got[r[0]] - sum(want[b] for b in grams(r[1]))) < 1e-6 for r in rows)


def test_op5_keeps_exactly_k(spark, monkeypatch):
    """Rows that are equal, or have no id, are told apart: exactly k are kept, and different words draw differently."""
    monkeypatch.setattr(quality, "FEW", 5)
    rows = [(None, "same words")] * 300 + [(7, "same words")] * 300 + [(None, f"text {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    for share in (0.1, 0.45, 0.9):
        got = quality.resample(df, labels, Scratch(spark, "t5"), share).collect()
        assert sum(r["kept"] for r in got) == round(share * 700)
        assert len({r["key"] for r in got}) == 102


ITEMS = [(1, "Which river runs through the old northern town of stones and what is its length"), (2, None), (3, ""), (4, "Short"), (5, " ".join(f"word{i}" for i in range(130)))]


def test_op10(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = ["x " * 100 + ITEMS[0][1].upper() + "? y" * 50, "nothing of it here", None, "", "a b " + ITEMS[4][1], "Which river runs through the old northern town", "z " * 20_000 + ITEMS[0][1]]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(0, 1), (4, 5), (6, 1)}
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(df, items.limit(0)).count() == 0


def test_op10_search_is_exhaustive():
    r = random.Random(5)
    index = decontaminate.Index([(i, " ".join(f"w{int(r.expovariate(0.03))}" for _ in range(r.randint(3, 120)))) for i in range(300)])
    for _ in range(150):
        terms = sorted(r.sample(range(len(index.terms)), r.randint(1, 40)))
        score = np.zeros(len(index.item))
        for t in terms:
            for c, x in zip(*index.postings[t], strict=True):
                score[c] += x
        for least in (0.1, 0.3):
            assert {c for c, _ in index.search(terms, least)} == set(np.flatnonzero(score >= least - 1e-9).tolist())


def _plain(text):
    """An item's or document's words as op10 compares them."""
    out = []
    for x in _words(text, True):
        x = "".join(chr(ord(c) + 32) if "À" <= c <= "Þ" and c != "×" else c for c in x.decode())
        for _ in range(4):
            x = x[:-1] if len(x) > 1 and x[-1] in PUNCT else x
            x = x[1:] if len(x) > 1 and x[0] in PUNCT else x
        out.append(x)
    return out


PUNCT = "".join(chr(c) for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def _leaks_by_hand(docs, items):
    """Every document passage against every item chunk with plain dictionaries."""
    D = decontaminate
    n = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    chunks = []
    for i, t in items:
        w = _plain(t)
        step = -(-len(w) // -(-len(w) // D.CHUNK)) if w else 1
        chunks += [(i, w, w[a : a + step]) for a in range(0, len(w), step)]
    df, mean = collections.Counter(x for *_, c in chunks for x in set(c)), np.mean([len(c) for *_, c in chunks])
    impact = []
    for *_, c in chunks:
        v = {x: np.log(1 + (len(chunks) - df[x] + 0.5) / (df[x] + 0.5)) * f * (D.K1 + 1) / (f + D.K1 * (1 - D.B + D.B * len(c) / mean)) for x, f in collections.Counter(c).items()}
        impact.append({x: y / sum(v.values()) for x, y in v.items()})
    out = {}
    for d, t in docs:
        w = _plain(t)
        for a in range(0, len(w), D.CHUNK):
            here = set(w[a : a + 2 * D.CHUNK])
            for (i, item, _), v in zip(chunks, impact, strict=True):
                score = sum(y for x, y in v.items() if x in here)
                if score < D.THRESHOLD - 1e-9:
                    continue
                k = min(D.GRAM, len(item))
                cut = len(item) - len(item) // 3
                around = n(w[max(0, a - len(item)) : a + 2 * D.CHUNK + len(item)], k)
                q, r = n(item[:cut], min(k, max(cut, 1))), n(item[max(0, cut - k + 1) :], k)
                shares = [len(x & around) / len(x) if x else 1.0 for x in (q, r)]
                if shares[0] >= D.Q_SHARE and shares[1] >= D.A_SHARE:
                    out[d, i] = max(out.get((d, i), 0.0), score)
    return out


@pytest.mark.parametrize("shard_words", [2_000_000, 300])
def test_op10_end_to_end(spark, shard_words, monkeypatch):
    """Pairs and scores against brute force, in one shard and in many."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    r = random.Random(9)
    vocab = [f"w{int(r.expovariate(0.02))}" for _ in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 6, 20, 60, 140])))) for i in range(60)] + [(60, None), (61, "")]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(r.randint(0, 300))]
        if d % 3 == 0:
            t = r.choice(items[:60])[1].split()
            t = t if d % 2 else [x if r.random() < 0.85 else "other" for x in t]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in t]
        docs.append((None if d == 50 else d, " ".join(w)))
    docs.append((500, None))
    want = _leaks_by_hand(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(df, bench).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_op10_stage_over_many_shards(spark, tmp_path, monkeypatch):
    """The stage drops the same rows in one shard and in many, in a plan of one scan at most, and keeps all columns."""
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(40)] + [(40, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(i % 50, " ".join([r.choice(vocab) for _ in range(80)] + (items[i % 40][1].split() if i % 4 == 0 else [])), {"k": i}, f"m{i}") for i in range(100)]
    docs += [docs[0], docs[1], (None, docs[4][1], {}, None), (None, None, None, None), (7, "", {}, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, tags map<string,int>, _md5 string").repartition(3)
    out = {}
    for words in (2_000_000, 100):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        got = decontaminate.stage_decontaminate(spark, df, str(tmp_path))
        assert got.schema == df.schema and got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
        out[words] = sorted(map(repr, map(tuple, got.collect())))
        assert decontaminate.stage_decontaminate(spark, df.where("false"), str(tmp_path)).collect() == []
    assert out[2_000_000] == out[100] and sorted(map(repr, [d for d in docs if d[1] is None or not any(x[1] and x[1] in d[1] for x in items)])) == out[100]


def test_op10_index_size():
    """100,000 items in a stated number of bytes."""
    import pickle

    r = np.random.default_rng(4)
    words_of = r.zipf(1.3, (100_000, 20)).astype(np.uint64) % np.uint64(1 << 40)
    index = decontaminate.Index([(i, h) for i, h in enumerate(words_of)])
    assert len(pickle.dumps(index)) < 200_000_000 and 60 * decontaminate.SHARD_WORDS <= 120_000_000


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(5, 5)]
    par = {x: x for e in edges for x in e}

    def f(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = f(a), f(b)
        par[max(a, b)] = min(a, b)
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"), "c").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: f(x) for x in linked}


def test_pipeline(spark, tmp_path, rows):
    """The stages against the operators' own results, checked one by one above."""
    import corpus_pipeline

    spark.createDataFrame(rows, DOC).drop("key", "member").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "token_files"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        before = Scratch(spark, "tp").keep(after, name)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == sorted(r["doc_id"] for r in before.collect()) and json.dumps(got)


def test_op8_no_bucket_grows_with_one_passage(spark):
    r = random.Random(6)
    new = lambda n: [f"n{r.randrange(10**15)}" for _ in range(n)]
    copy, header = new(60), new(60)
    rows = [(i, " ".join(copy)) for i in range(600)] + [(i, " ".join([*new(7), *header])) for i in range(600, 1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(0).cast("long")).repartition(4).cache()
    packed = substring.probes(df, 1, *substring.frequent(df.drop("part"), Scratch(spark, "t8")))
    assert packed.where("bucket >= 0").agg(F.sum("n")).first()[0] <= 7 * 600  # only windows that start in words of their own
    assert packed.where("bucket < 0").groupBy("salt").count().where("count > 1").isEmpty()
    got = substring.substring_dedup(df, Scratch(spark, "t8")).collect()
    assert {(x["doc_id"], x["n_removed"]) for x in got} == {(i, 0 if i in (0, 600) else 60) for i in range(1200)}
