"""SentencePiece BPE: encoding by a table of distinct chunks, and decoding.

White space becomes a marker before a text is segmented, and no piece of the vocabulary has a marker
behind another character (that is checked when a vocabulary is read). So no piece crosses the place
where a run of markers begins, and a text can be cut there into marked words. It is also cut beside
ASCII characters that stand in no piece of more than one character, such as line feeds and digits.
Every chunk is segmented on its own, and equal chunks alike:

1. A block of texts becomes one Arrow array of chunks, whose dictionary is the table of the block's
   distinct chunks.
2. Chunks that no earlier block of this Python worker met are segmented, each once and all together on
   flat arrays: of all neighbours whose union is a piece, those with the best score are joined first,
   the leftmost of equals. What is in no piece becomes byte tokens.
3. The ids come back to their places by one Arrow ``take`` of the dictionary's indices.

The table lives in the worker, not in a Spark table: a joined table would shuffle the place of every
word of the corpus, to save at most one segmentation of each chunk a worker.

Defined results: a null text counts as empty and has no ids. Texts of any length are encoded whole;
long texts are worked on in blocks that end where a marked word begins. Repeated rows and ids have
rows each; a null doc_id stays null; other columns are not looked at, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliomill.llm.bpe import slices

MARK = "▁"
CACHED_CHUNKS = 150_000
BLOCK_CHARACTERS = 1 << 19
#: Chunks of more characters are cut beside pairs that no piece holds, and joined with a heap.
SHORT = 48
#: Types of pieces in the file, which lists only others than NORMAL.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol buffer message: number, and integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class PieceVocabulary:
    """One BPE vocabulary, read from a SentencePiece model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(value)) for number, value in model if number == 1]
        trainer, rules = dict(_fields(dict(model).get(2, b""))), dict(_fields(dict(model).get(3, b"")))
        names = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
            raise ValueError(f"{path}: only BPE with byte tokens, a marker before each text and no other normalization is known here")
        if unknown := set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: pieces of the types {sorted(unknown)} are not known here")
        plain = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        if crossing := next((p for p in plain if any(a != MARK and b == MARK for a, b in zip(p, p[1:]))), None):
            raise ValueError(f"{path}: the piece {crossing!r} crosses a marker")
        scores = {name: struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for name, i in plain.items()}
        order = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ids = plain
        self.rank = {name: order[score] for name, score in scores.items() if len(name) > 1}
        self.byte_ids = [0] * 256
        for i, (name, kind) in enumerate(zip(names, kinds)):
            if kind == BYTE:
                self.byte_ids[int(name[3:5], 16)] = i
        self.pairs = {name[n : n + 2] for name in self.rank for n in range(len(name) - 1)}
        inside = set().union(*self.rank)
        # symbols: pieces by id, then letters that only longer pieces have, then one for all others, which joins nothing
        letters = {c: len(names) + n for n, c in enumerate(sorted(inside - plain.keys()))}
        symbols = {**plain, **letters}
        self.symbol_of = np.full(0x110000, len(names) + len(letters), np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        unions = [(symbols[w[:n]] << 32 | symbols[w[n:]], r, plain[w]) for w, r in self.rank.items() for n in range(1, len(w)) if w[:n] in symbols and w[n:] in symbols]
        self.pair_keys, self.pair_ranks, self.pair_made = np.array(sorted(unions), np.int64).T.copy()
        self.no_rank = len(order)
        self.alone = np.array([c < 128 and chr(c) not in inside and c != ord(" ") for c in range(256)])
        spelled = {NORMAL: lambda name: name.replace(MARK, " ").encode(), UNKNOWN: lambda name: " ⁇ ".encode(), CONTROL: lambda name: b"", BYTE: lambda name: bytes([int(name[3:5], 16)])}
        self.spelled = pa.array([spelled[kind](name) for name, kind in zip(names, kinds)], pa.large_binary())
        self.decimals = pa.array([f"{i},".encode() for i in range(len(names))], pa.large_binary())
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _joined_by_heap(self, symbols: list[str]) -> list[str]:
        """A long run: the best pair of neighbours joins, again and again, by a heap of pairs in time n log n."""
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (r := self.rank.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(heap, (r, left, right, symbols[left] + symbols[right]))

        for n in range(len(symbols) - 1):
            offer(n, n + 1)
        while heap:
            _, left, right, whole = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != whole:
                continue
            symbols[left], symbols[right] = whole, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def _neighbours(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the union of two symbols (no_rank if it is no piece), and its id."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        known = self.pair_keys[at] == key
        return np.where(known, self.pair_ranks[at], self.no_rank), self.pair_made[at]

    def join_rounds(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks whose code points lie one after another: symbols, where each begins in codes, and its chunk.

        In each round the best pair of every chunk that still has one is joined, the leftmost of equals.
        """
        symbols, first = self.symbol_of[codes], np.arange(len(codes))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, ...]] = []
        ranks, made = np.full(len(symbols), self.no_rank), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner], made[inner] = self._neighbours(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            if (ready := lowest == self.no_rank).any():
                done.append((symbols[ready], first[ready], owner[ready]))
                rest = ~ready
                symbols, first, owner, ranks, made, lowest = (x[rest] for x in (symbols, first, owner, ranks, made, lowest))
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == lowest)
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            symbols, first, owner, ranks, made = (x[keep] for x in (symbols, first, owner, ranks, made))
            near = np.r_[at, at[at > 0] - 1]
            ranks[near] = self.no_rank
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            ranks[near], made[near] = self._neighbours(symbols[near], symbols[near + 1])
        symbols, first, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], first[order], owner[order]

    def segment_long(self, chunk: str) -> bytes:
        """The ids of a long chunk."""
        cuts = [0, *(n + 1 for n in range(len(chunk) - 1) if chunk[n : n + 2] not in self.pairs), len(chunk)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            for part in self._joined_by_heap(list(chunk[a:b])):
                i = self.ids.get(part)
                out += [self.byte_ids[b] for b in part.encode()] if i is None else [i]
        return np.array(out, "<u4").tobytes()

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, in which blanks stand for markers."""
        chunks = [c.replace(" ", MARK) for c in chunks]
        short = [n for n, c in enumerate(chunks) if len(c) <= SHORT]
        out = [b"" if len(c) <= SHORT else self.segment_long(c) for c in chunks]
        if short:
            codes = np.frombuffer("".join(chunks[n] for n in short).encode("utf-32-le"), "<u4")
            symbols, first, owner = self.join_rounds(codes, np.array([len(chunks[n]) for n in short]))
            unknown = np.flatnonzero(symbols >= len(self.spelled))
            bytes_of = [chr(c).encode() for c in codes[first[unknown]].tolist()]
            many = np.ones(len(symbols), np.int64)
            many[unknown] = [len(b) for b in bytes_of]
            ids, ends = np.repeat(symbols, many).astype("<u4"), np.cumsum(many)
            if len(unknown):
                places = np.concatenate([np.arange(e - len(b), e) for e, b in zip(ends[unknown].tolist(), bytes_of)])
                ids[places] = np.array(self.byte_ids)[np.frombuffer(b"".join(bytes_of), np.uint8)]
            flat, stops = ids.tobytes(), (4 * ends[np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])]).tolist()
            for n, a, b in zip(short, [0, *stops], stops):
                out[n] = flat[a:b]
        return out

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks. What no block of the last two generations of the table asked for is forgotten."""
        if len(self.cache) > CACHED_CHUNKS:
            self.older, self.cache = self.cache, {}
        found = list(map(self.cache.get, chunks))
        missing = [n for n, ids in enumerate(found) if ids is None]
        for n in missing:
            found[n] = self.older.get(chunks[n])
        new = [n for n in missing if found[n] is None]
        for n, ids in zip(new, self.segment([chunks[n] for n in new])):
            found[n] = ids
        self.cache.update((chunks[n], found[n]) for n in missing)
        return found

    def _block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a block of pieces of texts (with blanks for markers): ids of each, and all ids."""
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        hard = np.cumsum(sizes) - sizes
        blank, alone = raw == ord(" "), self.alone[raw]
        begin = blank | alone
        begin[1:] &= ~blank[:-1] | alone[1:]
        begin[1:] |= alone[:-1]
        begin[hard] = True
        starts = np.flatnonzero(begin)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(raw)].astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        known = self.ids_of(chunks.dictionary.to_pylist())
        bounds = np.cumsum([0, *map(len, known)], dtype=np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(known))]).take(chunks.indices)
        _, ends, ids = coded.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(coded) + 1] // 4
        return np.diff(np.r_[ends[np.searchsorted(starts, hard)], ends[-1]]), np.frombuffer(ids, "<u4")[: ends[-1]]

    def pieces(self, text: str) -> list[str]:
        """The marked text, blanks standing for markers, in pieces that begin where a chunk does."""
        text = " " + text.replace(MARK, " ")
        out, at = [], 0
        while len(text) - at > BLOCK_CHARACTERS:
            cut = text.find(" ", at + BLOCK_CHARACTERS)
            while cut > 0 and text[cut - 1] == " ":
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode_blocks(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, some of its ids), each text's parts in order; empty texts have none."""
        owners: list[int] = []
        block: list[str] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            many, ids = self._block(block)
            yield from zip(owners, np.split(ids, np.cumsum(many)[:-1]))
            block.clear()
            owners.clear()

        for n, text in enumerate(texts):
            for piece in self.pieces(text) if text else ():
                block.append(piece)
                owners.append(n)
                size += len(piece)
                if size >= BLOCK_CHARACTERS:
                    yield from flush()
                    size = 0
        if block:
            yield from flush()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids."""
        parts: list[list[np.ndarray]] = [[np.empty(0, "<u4")] for _ in texts]
        for n, ids in self.encode_blocks(texts):
            parts[n].append(ids)
        return [np.concatenate(p) for p in parts]

    def spell(self, table: pa.Array, ids: np.ndarray) -> bytes:
        """What table says of each id, one after another."""
        found = table.take(pa.array(ids))
        _, ends, data = found.buffers()
        return memoryview(data)[: int(np.frombuffer(ends, np.int64)[len(found)])].tobytes() if len(found) else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the marker before it; bytes that are no UTF-8 become replacement characters."""
        return self.spell(self.spelled, ids).removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[str, PieceVocabulary] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """The vocabulary at path, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = PieceVocabulary(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of docs: doc_id, ids (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file)
        for rows in slices(batches):
            coded = pieces.encode(rows.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *coded]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), flat], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode_documents(coded: DataFrame, model_file: str) -> DataFrame:
    """Per row of coded (doc_id, ids): doc_id, text; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file)
        for rows in batches:
            texts = [pieces.decode(np.array(ids.as_py() or [], np.int64)) for ids in rows.column("ids")]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and SHA-256 of the ids in decimal, joined by commas, and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file)
        for rows in slices(batches):
            n = rows.num_rows
            counts, listed, decoded = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for at, ids in pieces.encode_blocks(rows.column("text").to_pylist()):
                numbers, text = pieces.spell(pieces.decimals, ids)[:-1], pieces.spell(pieces.spelled, ids)
                listed[at].update(b"," + numbers if counts[at] and numbers else numbers)
                decoded[at].update(text if counts[at] else text.removeprefix(b" "))
                counts[at] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in listed], pa.string()), pa.array([h.hexdigest() for h in decoded], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
