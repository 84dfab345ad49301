"""Operator 1: exact token counts at every prefix.

A prefix dynamic programme over a text stores the exact token count of each of its
prefixes.  Over pieces (white space and the word behind it, see `encoding`) it is
a running sum: tokens(prefix) = tokens(shorter prefix) + tokens(piece).  Inside a
piece it keeps the last token of every prefix: a token ends a prefix if it stays
beside the last token of the prefix that it extends.  The last entry of a table is
the count of the text; "how many tokens have the first k bytes" and "what is the
longest prefix of at most n tokens" are look-ups in it.  `prefix_tables` stores
the tables, `PrefixTable` answers from a stored one without any tokenizer.

`token_counts` works the programme over the pieces and opens only the piece in
which the limit falls: what comes behind that piece has at least its tokens.

Whole texts are encoded, without begin, end or added special tokens; strings of
special tokens in a text are handled as the library does by default.

Defined cases: null and empty texts have 0 bytes and 0 tokens and a table of the
empty prefix alone; null and repeated doc_ids pass through; extra columns are not
read; empty tables give no rows.  Memory: one piece of about PIECE bytes of text,
or one longer text, and the worker's bounded store of known words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoding import encoder
from .words import pieces, texts

LIMIT, PIECE = 512, 4_000_000
TOKENIZER = "byte_bpe_50k.json"


class PrefixTable:
    """A stored table: `ends` (bytes of every prefix, the empty one first) and `counts`."""

    def __init__(self, ends: Sequence[int], counts: Sequence[int]):
        self.ends, self.counts = ends, np.asarray(counts)

    def at(self, n_bytes: int) -> int:
        """Tokens of the first n_bytes bytes; of the last whole character before, if they cut one."""
        return int(self.counts[bisect_right(self.ends, n_bytes) - 1])

    def cut(self, budget: int) -> int:
        """Bytes of the longest prefix of at most `budget` tokens.  Counts don't always grow
        with the prefix, as one more character can join tokens, so it is the last that fits."""
        return int(self.ends[np.flatnonzero(self.counts <= budget)[-1]]) if budget >= 0 else 0


def prefix_tables(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ends, counts) of every document: all prefixes that end with a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a in range(0, batch.num_rows, 64):
                tables = [enc.every_prefix(t or "") for t in column[a : a + 64].to_pylist()]
                lists = [pa.array([t[k] for t in tables], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids[a : a + 64], *lists], ["doc_id", "ends", "counts"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, ends array<bigint>, counts array<bigint>")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and cut_bytes: the longest prefix (of whole
    characters) within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in pieces(offsets, PIECE):
                raw, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row, start, end, count = enc.prefixes(raw, off)
                n = b - a
                first, behind = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
                tokens = np.where(behind > first, np.concatenate([[0], count])[behind], 0)
                cut = np.diff(off)
                fits = np.bincount(row[count <= limit], minlength=n)
                for r in np.flatnonzero(tokens > limit).tolist():
                    k = first[r] + fits[r]  # the piece in which the limit falls
                    upto = count[k - 1] if k > first[r] else 0
                    # No token has more than `longest` bytes, so what lies further can't fit.
                    most = min(end[k], start[k] + (limit - upto + 1) * enc.longest)
                    piece = raw[off[r] + start[k] : off[r] + most].tobytes().decode("utf-8", "ignore")
                    whole = np.flatnonzero(np.array(enc.inner(piece)) + upto <= limit)[-1]
                    cut[r] = start[k] + len(piece[:whole].encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit), pa.array(cut)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_bytes bigint"
    )


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
