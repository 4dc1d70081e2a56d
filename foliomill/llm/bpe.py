"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

Texts are cut into words by the rules of the vocabulary's pre-tokenizer, on arrays of character
classes: a word begins where the class changes, and a few rules for blanks and contractions move
those marks. A block of words becomes one Arrow array, whose dictionary holds each word once.

The words that no earlier block has met are laid into one flat array of symbols. In each round every
word finds the lowest rank among its adjacent pairs (ranks come from a binary search over the sorted
pair keys; only pairs beside a fresh merge are searched again), and all occurrences of that pair in
that word are merged, left to right. Words that have no more pairs to merge leave the arrays. A
word's ids are remembered for as long as the Python worker lives, up to a fixed number of words.

An added token's string inside a text becomes that token, as the tokenizers library does by default.

Defined results: a null text counts as empty and has no ids. Texts and words of any length are
encoded whole: long texts are worked on in blocks, cut where a word begins for certain. A word takes
at most one round for each rank of the vocabulary, so the work stays in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: The pre-tokenizer's pattern (a fixed value of byte-level vocabularies of this kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 150_000
#: Texts, and bytes of texts, that are Python objects together; a longer text is alone.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1024, 1 << 20
#: Characters that are cut into words together.
BLOCK_CHARACTERS = 1 << 19
#: Character classes; all blanks come last.
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


@cache
def character_classes() -> np.ndarray:
    """The class of each code point."""
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for prop, number in (("L", LETTER), ("N", NUMBER), ("White_Space", BLANK)):
        for span in regex.finditer(rf"\p{{{prop}}}+", known):
            out[ord(known[span.start()]) : ord(known[span.end() - 1]) + 1] = number
    out[0xD800:0xE000] = OTHER
    out[ord(" ")] = SPACE
    return out


def word_starts(codes: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Where PATTERN's words begin; hard are sorted places where another text begins (0 is one)."""
    classes = character_classes()[codes]
    kind = np.minimum(classes, BLANK)
    blank = kind == BLANK
    begin = np.r_[True, kind[1:] != kind[:-1]]
    begin[hard] = True
    apart = np.zeros(len(codes) + 1, bool)
    apart[hard] = apart[-1] = True
    # the last blank before something else stands alone, or goes with it if it is a space
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~apart[1:-1])
    begin[last] = True
    begin[last[classes[last] == SPACE] + 1] = False
    # contractions
    mark = np.flatnonzero((codes == ord("'")) & begin)
    if len(mark):
        padded, ends = np.r_[codes, 0, 0], np.r_[apart, True]
        one, two = padded[mark + 1], padded[mark + 2]
        alone, joined = ~ends[mark + 1], ~ends[mark + 1] & ~ends[mark + 2]
        short = alone & np.isin(one, [ord(c) for c in "stmd"])
        pair = joined & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        begin = np.r_[begin, True, True]
        begin[mark[short | pair] + 1] = False
        begin[mark[short] + 2] = begin[mark[pair] + 3] = True
        begin = begin[: len(codes)]
    return np.flatnonzero(begin)


@dataclass
class Coded:
    """One text's words: their sizes in characters and in tokens, and all ids."""

    sizes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


class ByteBpe:
    """One vocabulary, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        value = {letter: b for b, letter in enumerate(byte_letters())}
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: added tokens that take blanks along or stand alone only are not known here")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            if token not in self.added:
                self.token_bytes[i] = bytes(value[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[x] for x in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.made_by_rank = made
        self.no_rank = len(pairs)
        self.byte_ranks = self._lookup(self.byte_ids[:, None], self.byte_ids[None, :])
        self.spelled = pa.array(self.token_bytes, pa.large_binary())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The text in pieces, each of whole words: added tokens, and what is between them, cut before a space after a word."""
        whole = self.split.split(text) if self.split is not None else [text]
        out: list[str] = []
        for piece in filter(None, whole):
            at = 0
            while len(piece) - at > BLOCK_CHARACTERS:
                cut = piece.find(" ", at + BLOCK_CHARACTERS)
                while cut > 0 and piece[cut - 1].isspace():
                    cut = piece.find(" ", cut + 1)
                if cut < 0:
                    break
                out.append(piece[at:cut])
                at = cut
            out.append(piece[at:])
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.no_rank)

    def merge_rounds(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words whose bytes lie one after another, and each word's number of ids; no word is empty."""
        symbols = self.byte_ids[raw]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        owners, found = [owner[:0]], [symbols[:0]]
        # ranks[i] is of the pair (i, i + 1); pairs over the end of a word have none
        ranks = np.full(len(symbols), self.no_rank, np.int64)
        ranks[:-1] = np.where(owner[:-1] == owner[1:], self.byte_ranks[raw[:-1], raw[1:]], self.no_rank)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            if (done := lowest == self.no_rank).any():
                ready = np.repeat(done, sizes)
                owners.append(owner[ready])
                found.append(symbols[ready])
                symbols, owner, ranks = symbols[~ready], owner[~ready], ranks[~ready]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # of hits side by side (as in "aaa") every second one merges, from the left
            fresh = np.r_[True, np.diff(at) > 1]
            first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]
            symbols[at] = self.made_by_rank[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            at = place[at]
            beside = np.zeros(len(symbols) + 1, bool)
            beside[at] = beside[at - 1] = True  # at - 1 may be -1: the spare place at the end
            near = np.flatnonzero(beside[:-1])
            ranks[near] = self.no_rank
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            ranks[near] = self._lookup(symbols[near], symbols[near + 1])
        owner = np.concatenate(owners)
        return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words into the cache."""
        plain = [w for w in words if w not in self.added]
        raw = "".join(plain).encode()
        ends = np.cumsum([len(w.encode()) for w in plain], dtype=np.int64)
        ids, counts = self.merge_rounds(np.frombuffer(raw, np.uint8), np.diff(ends, prepend=0))
        flat, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.cache.update(zip(plain, (flat[a:b] for a, b in zip([0, *stops], stops))))
        for w in words:
            if w in self.added:
                self.cache[w] = self.added[w].to_bytes(4, "little")

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. What no word asked for in the last two generations of the cache is forgotten."""
        if len(self.cache) > CACHED_WORDS:
            self.older, self.cache = self.cache, {}
        get, older = self.cache.get, self.older.get
        found = list(map(get, words))
        if missing := [n for n, ids in enumerate(found) if ids is None]:
            new = []
            for n in missing:
                if (ids := older(words[n])) is None:
                    new.append(words[n])
                else:
                    self.cache[words[n]] = ids
            if new:
                self.learn(new)
            for n in missing:
                found[n] = self.cache[words[n]]
        return found

    def _block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block of pieces: words of each, characters of each word, ids of each word, all ids."""
        text = "".join(pieces)
        raw = text.encode()
        ascii_only = len(raw) == len(text)
        codes = np.frombuffer(raw, np.uint8) if ascii_only else np.frombuffer(text.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        hard = np.cumsum(lengths) - lengths
        starts = word_starts(codes, hard)
        for n, piece in enumerate(pieces):
            if piece in self.added:  # stands whole
                starts = starts[(starts <= hard[n]) | (starts >= hard[n] + len(piece))]
        if ascii_only:
            places = np.r_[starts, len(raw)]
        else:
            places = np.r_[np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts], len(raw)]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.ids_of(distinct)
        bounds = np.cumsum([0, *map(len, known)], dtype=np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(known))]).take(words.indices)
        _, ends, ids = coded.buffers()
        counts = np.diff(np.frombuffer(ends, np.int64)[: len(coded) + 1]) // 4
        first = np.searchsorted(starts, hard)
        return np.diff(np.r_[first, len(starts)]), np.diff(np.r_[starts, len(codes)]), counts, np.frombuffer(ids, "<u4")[: counts.sum()]

    def encode_words(self, texts: list[str | None]) -> list[Coded]:
        """Each text's words and ids."""
        parts: list[list[Coded]] = [[] for _ in texts]
        owners: list[int] = []
        block: list[str] = []
        size = 0

        def flush() -> None:
            many, sizes, counts, ids = self._block(block)
            word = np.r_[0, np.cumsum(many)]
            token = np.r_[0, np.cumsum(counts)][word]
            word, token = word.tolist(), token.tolist()
            for n, owner in enumerate(owners):
                w, t = slice(word[n], word[n + 1]), slice(token[n], token[n + 1])
                parts[owner].append(Coded(sizes[w], counts[w], ids[t]))
            block.clear()
            owners.clear()

        for n, text in enumerate(texts):
            for piece in self.pieces(text) if text else ():
                block.append(piece)
                owners.append(n)
                size += len(piece)
                if size >= BLOCK_CHARACTERS:
                    flush()
                    size = 0
        if block:
            flush()
        none = np.empty(0, np.int64)
        return [
            p[0] if len(p) == 1 else Coded(*[np.concatenate([none.astype("<u4") if name == "ids" else none, *[getattr(c, name) for c in p]]) for name in ("sizes", "counts", "ids")]) for p in parts
        ]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [coded.ids.tobytes() for coded in self.encode_words(texts)]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        spelled = self.spelled.take(pa.array(np.frombuffer(ids, "<u4")))
        _, ends, data = spelled.buffers()
        return data.to_pybytes()[: int(np.frombuffer(ends, np.int64)[len(spelled)])].decode("utf-8", "replace") if len(spelled) else ""


_loaded: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """The vocabulary at path, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in small pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            full = np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES_AT_ONCE, "right")
            b = min(max(a + 1, int(full)), a + TEXTS_AT_ONCE, batch.num_rows)
            yield batch.slice(a, b - a)
            a = b


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of docs: doc_id, ids (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_file)
        for rows in slices(batches):
            coded = bpe.encode(rows.column("text").to_pylist())
            ids = [np.frombuffer(c, "<u4").astype(np.int64) for c in coded]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *ids])))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), flat], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip_digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_file)
        for rows in slices(batches):
            coded = bpe.encode(rows.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
