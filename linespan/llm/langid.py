"""Operator 7: language by compression.

Each language has a zstandard raw-content dictionary made of a bounded sample of
its labelled documents: the one with the smallest hash in each of `SLOTS` hash
slots, found by an aggregation that Spark combines before it shuffles, and of each
`SLICES` slices spread over the whole text, DICT_BYTES / SLOTS characters together.
Every labelled language is learnt; where all dictionaries together would pass
TOTAL_BYTES, each is made smaller, so what is gathered and broadcast is bounded.  A text
is compressed with every dictionary, in segments short enough for the
dictionary to matter, over its whole length; the smallest sum wins.  The score
is the saving against the runner-up, and texts whose score is under
`MIN_MARGIN`, or that have no letter, are rejected.

Labels are read only of documents whose crc32(doc_id as text) mod 4 is not 2.
Only the slices go to the driver: SLOTS of each language, TOTAL_BYTES characters together (or a
few of each slot), cut by Spark before they are gathered.  Sampled texts that the other half of the
sample takes for another language are left out; Spark compresses them.  Predictions read whole texts.
A letter is a character of Unicode's category L.

Defined cases: null text, empty text and text without a letter give ``und``,
score 0, rejected; with no labelled document at all everything is ``und``; a tie
goes to the first language by code point and is rejected; null or repeated
doc_id and extra columns pass through, also ones named like the result.  The stage
keeps documents whose language is told, in their own columns; without any label
nothing is told and no document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SLICES, DICT_BYTES, SEGMENT, LEVEL, MIN_MARGIN, TOTAL_BYTES = 96, 3, 131_072, 4_096, 6, 0.001, 64 << 20
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(text: Column, most: int, parts: int = SLICES) -> Column:
    """A text of at most `most` characters: the whole, or slices at even distances from its start to its end."""
    each = most // parts
    cut = [F.substring(text, (F.floor((F.length(text) - each) * F.lit(k / max(1, parts - 1))) + 1).cast("int"), F.lit(each)) for k in range(parts)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *cut))


def learn(docs: DataFrame, slots: int = SLOTS, dict_bytes: int = DICT_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Language -> dictionary, from at most `slots` labelled documents a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    dict_bytes = min(dict_bytes, total_bytes // max(1, labelled.select("lang").distinct().count()))
    h = F.xxhash64("doc_id")
    chosen = (
        labelled.groupBy("lang", F.pmod(h, F.lit(slots)).alias("slot"))
        .agg(F.min(F.struct(h.alias("h"), "doc_id"))["doc_id"].alias("doc_id"))
        .select("lang", "doc_id")
    )
    # At most languages x slots ids: a size that does not grow with the corpus.
    found = labelled.join(F.broadcast(chosen), ["lang", "doc_id"])
    found = found.select("lang", "doc_id", slices(F.col("text"), max(SLICES, dict_bytes // slots)).alias("text"))
    found = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # of rows that repeat an id the least
    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for r in found.collect():
        if r["text"]:
            by_lang.setdefault(r["lang"], []).append((r["doc_id"], _fold(r["text"])))
    sample = {k: [t for _, t in sorted(v)] for k, v in sorted(by_lang.items())}
    return _dictionaries(_unmixed(docs.sparkSession, sample, dict_bytes), dict_bytes)


def _fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _dictionaries(sample: dict[str, list[bytes]], size: int) -> dict[str, bytes]:
    """Equal shares of the sampled texts, the longest nearest to the end."""
    return {k: b"\n".join(t[: max(1, size // len(v))] for t in sorted(v, key=len))[-size:] for k, v in sample.items()}


def _unmixed(spark, sample: dict[str, list[bytes]], size: int) -> dict[str, list[bytes]]:
    """Without sampled texts that the other half of the sample takes for another language."""
    if len(sample) < 2 or min(map(len, sample.values())) < 4:
        return sample
    halves = spark.sparkContext.broadcast([_dictionaries({k: v[i::2] for k, v in sample.items()}, size) for i in (0, 1)])
    rows = spark.createDataFrame([(k, j, t) for k, v in sample.items() for j, t in enumerate(v)], "lang string, j int, data binary")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = [_Sizes(d) for d in halves.value]
        for b in batches:
            mine = [sizes[1 - j % 2](bytes(x))[0][1] == k for k, j, x in zip(b["lang"], b["j"], b["data"], strict=True)]
            yield b[mine][["lang", "j"]]

    kept: dict[str, set[int]] = {}
    for r in rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(judge, "lang string, j int").collect():
        kept.setdefault(r["lang"], set()).add(r["j"])
    return {k: [t for j, t in enumerate(v) if j in kept[k]] if k in kept else v for k, v in sample.items()}


class _Sizes:
    """Compressed sizes of a text by language, the smallest first."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as Z

        p = Z.ZstdCompressionParameters.from_level(
            LEVEL, source_size=SEGMENT, dict_size=DICT_BYTES, write_content_size=False, write_dict_id=False
        )
        self.by = {
            k: Z.ZstdCompressor(compression_params=p, dict_data=Z.ZstdCompressionDict(d, dict_type=Z.DICT_TYPE_RAWCONTENT))
            for k, d in sorted(dictionaries.items())
        }

    def __call__(self, data: bytes) -> list[tuple[int, str]]:
        parts = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
        return sorted((sum(len(c.compress(p)) for p in parts), k) for k, c in self.by.items())


def classifier(dictionaries: dict[str, bytes], margin: float = MIN_MARGIN):
    """A function of one text: (language, score, rejected)."""
    sizes = _Sizes(dictionaries)

    def judge(text: str | None) -> tuple[str, float, bool]:
        if not text or not sizes.by or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        found = sizes(_fold(text))
        score = 1.0 - found[0][0] / found[1][0] if len(found) > 1 else 1.0
        return found[0][1], score, score < margin

    return judge


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MIN_MARGIN, column: str = "_lang") -> DataFrame:
    """docs with a struct column of lang_pred, score and rejected."""
    if column in docs.columns:
        raise ValueError(f"docs have a column {column} already")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = classifier(shared.value, margin)
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(column, predict(F.col("text")))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs.drop("lang"), learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.rejected"
    )


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with their own columns; null, empty and letterless
    texts go, rows that repeat or lack an id are judged one by one, an empty table stays empty."""
    told = free_name(docs, "_lang")
    return identify(docs, learn(docs), column=told).where(~F.col(f"{told}.rejected")).select(*docs.columns)
