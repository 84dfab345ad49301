"""Encoding many texts with a public tokenizer, one distinct word at a time.

Both vocabularies split a text before they merge, and never across the start of
a run of ASCII white space: what follows a word begins a new split.  So the ids
of a text are the ids of its pieces in order (with a byte-level vocabulary a
piece is white space and the word after it, with a word vocabulary the word),
and each worker keeps the ids of the pieces that it has met, by 64-bit hash.
A piece that ends in white space outside ASCII is kept together with the next.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .words import Words, span_hash

KNOWN_MAX = 2_000_000
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# The characters with the Unicode property White_Space.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SUFFIX = re.compile("'[a-z]+")
_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def _ends_in_other_space(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether spans end in white space outside ASCII, or in the separators 0x1C-0x1F."""
    if not len(start):
        return np.zeros(0, bool)

    def back(k: int) -> np.ndarray:
        return np.where(end - start >= k, data[np.maximum(end - k, 0)], 0)

    z, y, x = back(1), back(2), back(3)
    e280 = (x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    three = e280 | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    return three | ((z >= 0x1C) & (z <= 0x1F)) | ((y == 0xC2) & ((z == 0x85) | (z == 0xA0)))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.by_word = bool(self.ends.any())  # the word vocabulary marks word ends and drops white space
        self.dtype = np.dtype(np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        self.vocab, self.longest = vocab, max(map(len, vocab))
        self.names = {i: t for t, i in vocab.items()}
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.beside: dict[tuple, bool] = {}
        self._short = lru_cache(maxsize=1 << 14)(self._inner)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    # --- exact counts at every character of a piece

    def _fits(self, a: int | None, b: int) -> bool:
        """Whether the merges leave token b as it is behind token a (or at the start)."""
        if (a, b) not in self.beside:
            if len(self.beside) > KNOWN_MAX:
                self.beside.clear()
            want = [b] if a is None else [a, b]
            self.beside[a, b] = [t.id for t in self.tok.model.tokenize("".join(self.names[x] for x in want))] == want
        return self.beside[a, b]

    def _steps(self, s: str) -> list[int]:
        """Tokens of every prefix of a unit that merges don't leave, one letter of s a byte.
        The dynamic programme keeps the last token of every prefix: a token that ends at i is
        the last one there if it stays beside the last token of the prefix that it extends,
        since a sequence is what the merges give just if each two neighbours are."""
        last, count = [None], [0]
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - self.longest), i):
                t = self.vocab.get(s[j:i])
                if t is not None and self._fits(last[j], t):
                    break
            else:
                raise ValueError(f"no token ends at {i} of {s!r}")
            last.append(t)
            count.append(count[j] + 1)
        return count

    def _plain(self, text: str) -> list[int]:
        """Tokens of every prefix of a text without special strings."""
        if self.by_word:  # a word's end changes its tokens, so each prefix is a text of its own
            return [0, *map(len, self.whole([text[:i] for i in range(1, len(text) + 1)]))]
        out = [0] * (len(text) + 1)
        for letters, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            if _SUFFIX.fullmatch(text, a, b):  # 're, cut short, is split otherwise
                for i in range(a + 1, b + 1):
                    out[i] = out[a] + len(self.whole([text[a:i]])[0])
                continue
            at, steps = 0, self._steps(letters)
            for i in range(a, b):
                at += len(text[i].encode("utf-8", "surrogatepass"))
                out[i + 1] = out[a] + steps[at]
        cut = list(out)  # a prefix that ends in white space has that whole run as one unit
        for run in _BLANK.finditer(text):
            at, steps = 0, self._steps(self.tok.pre_tokenizer.pre_tokenize_str(run[0])[0][0])
            for i in range(*run.span()):
                at += len(text[i].encode())
                cut[i + 1] = out[run.start()] + steps[at]
        return cut

    def inner(self, text: str) -> list[int]:
        """Tokens of text[:i] for i from 0 to its length."""
        return self._short(text) if len(text) <= 64 else self._inner(text)

    def _inner(self, text: str) -> list[int]:
        out, done = [0], 0
        for found in self.special.finditer(text) if self.special else ():
            part = self._plain(text[done : found.end()])  # what is cut inside the special string is plain
            upto = out[-1]
            out += [upto + x for x in part[1:-1]]
            out.append(upto + part[found.start() - done] + 1)
            done = found.end()
        upto = out[-1]
        return out + [upto + x for x in self._plain(text[done:])[1:]]

    # --- ids of whole pieces

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Ids of new pieces.  Words of letters alone go joined by a space, told apart by word ends."""
        got: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.by_word and _LETTERS.fullmatch(p)]
        for a in range(0, len(plain), 256):
            part = plain[a : a + 256]
            ids = np.array(self.whole([" ".join(pieces[i] for i in part)])[0], self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                for i, x in zip(part, np.split(ids, cut[:-1]), strict=True):
                    got[i] = x
        rest = [i for i, x in enumerate(got) if x is None]
        for a in range(0, len(rest), 1024):
            part = rest[a : a + 1024]
            for i, x in zip(part, self.whole([pieces[i] for i in part]), strict=True):
                got[i] = x
        size = np.fromiter(map(len, got), np.int32, len(got))
        if len(self.keys) + len(keys) > KNOWN_MAX:
            self.forget()
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.ids = np.concatenate([self.ids, *[np.asarray(x, self.dtype) for x in got]])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.at, self.len = all_keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.len, size])[order]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of the pieces of some rows of text."""
        w = Words(data, offsets, hashes=False)
        if self.by_word:
            return w.start, w.end, w.row
        row, size = np.arange(w.rows), np.diff(offsets)
        last = np.where(w.count > 0, np.concatenate([w.end, [0]])[np.maximum(w.first[1:] - 1, 0)], offsets[:-1])
        tail = np.flatnonzero((last < offsets[1:]) & (size > 0))  # white space after the last word
        begin = np.concatenate([[0], w.end[:-1]]) if len(w.end) else w.end
        begin = np.maximum(begin, offsets[w.row])
        start, end, rows = np.concatenate([begin, last[tail]]), np.concatenate([w.end, offsets[tail + 1]]), np.concatenate([w.row, row[tail]])
        order = np.argsort(start, kind="stable")
        start, end, rows = start[order], end[order], rows[order]
        # A run of white space must not be cut: join what follows other white space to it.
        open_end = _ends_in_other_space(data, start, end)
        joined = np.flatnonzero(open_end[:-1] & (rows[:-1] == rows[1:])) + 1
        heads, tails = np.ones(len(start), bool), np.ones(len(start), bool)
        heads[joined], tails[joined - 1] = False, False
        return start[heads], end[tails], rows[heads]

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index into `at` and `len` of every piece; unknown pieces are learnt first."""
        keys, first, back = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > KNOWN_MAX:
                self.forget()
                known[:] = False
            raw = data.tobytes()
            new = np.flatnonzero(~known)
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]], end[first[new]], strict=True)])
            found = np.searchsorted(self.keys, keys)
        return found[back]

    def prefixes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every row, at every end of a piece: row, start and end of the piece (bytes from
        the row's start) and the exact number of tokens up to there.  The programme over
        pieces: tokens(prefix) = tokens(shorter prefix) + tokens(piece)."""
        start, end, row = self.pieces(data, offsets)
        k = self.lookup(data, start, end)
        total = np.cumsum(self.len[k], dtype=np.int64)
        first = np.searchsorted(row, np.arange(len(offsets) - 1))
        base = np.concatenate([[0], total])[first]
        return row, start - offsets[row], end - offsets[row], total - base[row]

    def every_prefix(self, text: str) -> tuple[list[int], list[int]]:
        """Bytes and tokens of every prefix of a text, the empty one first."""
        raw = text.encode("utf-8", "surrogatepass")
        _, start, end, count = self.prefixes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        size, tokens, upto = [0], [0], 0
        for a, b, c in zip(start.tolist(), end.tolist(), count.tolist(), strict=True):
            for ch in raw[size[-1] : a].decode():  # white space that the vocabulary drops
                size.append(size[-1] + len(ch.encode()))
                tokens.append(upto)
            piece = raw[a:b].decode("utf-8", "surrogatepass")
            for ch, t in zip(piece, self.inner(piece)[1:], strict=True):
                size.append(size[-1] + len(ch.encode("utf-8", "surrogatepass")))
                tokens.append(upto + t)
            upto = c
        for _ in range(len(raw) - size[-1]):
            size.append(size[-1] + 1)
            tokens.append(upto)
        return size, tokens

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, in order, and the number of ids of each row."""
        start, end, row = self.pieces(data, offsets)
        k = self.lookup(data, start, end)
        size = self.len[k]
        total = np.cumsum(size)
        shift = np.repeat(self.at[k] - (total - size), size)
        ids = self.ids[np.arange(len(shift)) + shift]
        counts = np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return ids, counts
