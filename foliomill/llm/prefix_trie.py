"""The prefix trie of conversations: double-array tries over shards of sorted sequences.

A conversation becomes one row: its turns in order, each as the first 128 bits of the SHA-256 of role
and text (texts do not travel further), and each turn's number of words. Conversations with equal turns
become one row with their number, least id and digest of ids. Spark sorts these rows by range, so equal
prefixes lie together, and a prefix that a third of all conversations share is spread over as many
tasks as its continuations fill.

A task reads its sorted rows and packs a shard of at most ``SHARD_TURNS`` turns at a time into a double
array: turns are numbered densely, node s has its child by turn t at BASE[s] + t, and CHECK holds the
parent of each place. Sequences are followed through it, what they carry is added at their nodes, and
sums run from the deepest nodes upwards. A node that is neither on the way to the shard's first
sequence nor on that to its last belongs to this shard alone and is finished. The others, at most two
sequences of nodes a shard, carry what they have gathered so far into the next level, where the shards'
first and last sequences are sorted and packed in the same way, until one trie holds all that is left.
A level has thousands of times fewer turns than the one before it.

Digests of ids that end at a node are hashed in order of id by the task that reads them, as strings of
at most ``IDS_TOGETHER`` ids each that were joined before; they are never held together.

Defined results: a null conv_id is no conversation, its rows are left out. Turns are ordered by turn
(null first), then role, then digest; rows that repeat a turn are turns of their own. Null role and
text are empty. An empty table has no node. Other columns are not looked at, whatever their names. A
conversation's slim turns are one row, so one conversation must fit in memory at 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import join_hot, written

#: Turns that one double array holds, and that the last level may have.
SHARD_TURNS = 32_768
#: Sequences that a task of an upper level has at least, on average; a shard has a quarter as many. So each level is several times smaller than the one before it, however long its sequences.
UPPER_ROWS = 64
#: Ids of one sequence that are joined into one string.
IDS_TOGETHER_BITS = 12
#: Conversations whose first turns others take.
FAMILY, HEADS = 20, 4
TURN_BYTES = 16

#: One row for each sequence: its turns; their words; and from depth `at` on what its nodes carry besides their children in this level.
SEQUENCES = "seq binary, words array<long>, at int, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
#: One row for each finished node. parent_key names a parent that is not finished yet, whose conv_id is still open.
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node_key binary, parent_key binary"
NOBODY = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN_BYTES))


def turn_rows(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, bucket (of neighbouring ids), own (array of digest and words in order)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "digest", "words")))
    own = F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    rows = slim.repartitionByRange("conv_id").groupBy("conv_id").agg(own.alias("own")).sortWithinPartitions("conv_id")
    return rows.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), IDS_TOGETHER_BITS))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, bucket, turns: the first h turns of its family's first conversation, then its own behind h; h is crc32(conv_id) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    donor = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = conversations.select(F.col("conv_id").alias("donor"), F.slice("own", 1, HEADS - 1).alias("head"))
    joined = conversations.withColumn("donor", donor).withColumn("h", h).join(heads, "donor", "left")
    first = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", "bucket", F.concat(first, F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """Per distinct sequence of turns, in sorted order within partitions, SEQUENCES of the first level: what its last node carries."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    parts = (
        conversations.select("conv_id", "bucket", seq.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
        .groupBy("seq", "bucket")
        .agg(F.first("words").alias("words"), F.min("conv_id").alias("least"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
        .repartitionByRange("seq")
        .sortWithinPartitions("seq", "bucket")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # of one sequence: seq, words, least id, number, hash of ids

        def told(rows: list[list]) -> pa.RecordBatch:
            seq, words, least, n, digest = zip(*rows)
            none, one = [[0]] * len(rows), lambda values: [[x] for x in values]
            columns = [seq, words, list(map(len, words)), one(n), one(least), none, none, none, one(h.hexdigest() for h in digest)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEQUENCES)], schema=_SEQUENCES)

        for batch in batches:
            out = []
            for seq, words, least, n, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "words", "least", "n", "ids"))):
                if held and held[0] == seq:
                    held[2], held[3] = min(held[2], least), held[3] + n
                    held[4].update(b",")
                else:
                    if held:
                        out.append(held)
                    held = [seq, words, least, n, hashlib.sha256()]
                held[4].update(ids.encode())
            if out:
                yield told(out)
        if held:
            yield told([held])

    return parts.mapInArrow(run, SEQUENCES)


_SEQUENCES = pa.schema(
    [("seq", pa.binary()), ("words", pa.list_(pa.int64())), ("at", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("n", "least", "kids", "leaves", "saved")] + [("ends", pa.list_(pa.string()))]
)
_NODES = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("node_key", pa.binary()), ("parent_key", pa.binary())]
)


class DoubleArray:
    """A trie of sorted sequences of dense turn ids (from 0), which lie one after another in flat."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.alphabet = int(flat.max(initial=0)) + 1
        self.base = np.zeros(len(flat) + self.alphabet + 2, np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.check[0] = 0
        self.depth = np.zeros(len(self.base), np.int64)
        self.low, self.high = 1, 0  # the first free place, the last one taken
        rows, at, d = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), 0
        while len(rows := rows[lengths[rows] > d]):
            turn = flat[self.starts[rows] + d]
            new = np.r_[True, (at[rows[1:]] != at[rows[:-1]]) | (turn[1:] != turn[:-1])]
            places = self._place(at[rows][new], turn[new])
            d += 1
            self.depth[places] = d
            at[rows] = places[np.cumsum(new) - 1]

    def _free(self, many: int) -> np.ndarray:
        """The first free places, the array grown if there are too few."""
        width = 2 * many + 64
        while True:
            free = np.flatnonzero(self.check[self.low : self.low + width] < 0) + self.low
            if len(free) >= many:
                return free[:many]
            if self.low + width >= len(self.check):
                self._grow(len(self.check) + width)
            width *= 2

    def _grow(self, more: int) -> None:
        self.base, self.depth = (np.r_[x, np.zeros(more, np.int64)] for x in (self.base, self.depth))
        self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Places for the children of a level's nodes; those of a node lie together, in order of turn."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        many = np.diff(np.r_[first, len(parents)])
        out = np.empty(len(parents), np.int64)
        for a, n in zip(first[many > 1].tolist(), many[many > 1].tolist()):
            steps = turns[a : a + n] - turns[a]
            tries = self._free(64)
            fits = (self.check[np.minimum(tries[:, None] + steps, len(self.check) - 1)] < 0).all(axis=1) & (tries + steps[-1] < len(self.check))
            place = tries[fits.argmax()] if fits.any() else self.high + 1
            if place + steps[-1] >= len(self.check):
                self._grow(len(self.check) + int(steps[-1]))
            self.high = max(self.high, int(place + steps[-1]))
            out[a : a + n] = place + steps
            self.check[out[a : a + n]] = parents[a]
            self.base[parents[a]] = place - turns[a]
        only = first[many == 1]
        out[only] = self._free(len(only))
        self.check[out[only]] = parents[only]
        self.base[parents[only]] = out[only] - turns[only]
        self.high = max(self.high, int(out.max()))
        self.low = int(self._free(1)[0])
        return out

    def follow(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each depth: the sequences that reach it, and their nodes, found by BASE and CHECK."""
        rows, at, d = np.arange(len(self.lengths)), np.zeros(len(self.lengths), np.int64), 0
        while len(rows):
            yield d, rows, at[rows]
            rows = rows[self.lengths[rows] > d]
            to = self.base[at[rows]] + self.flat[self.starts[rows] + d]
            if (self.check[to] != at[rows]).any():
                raise ValueError("a sequence is not in the trie")
            at[rows] = to
            d += 1


def _pack(rows: pa.Table, upper: bool, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """One shard's finished nodes, and the sequences it hands on; the last shard hands on nothing.

    In upper levels any node may be the parent of nodes that are finished already, so all have keys.
    """
    col = {c: rows.column(c).combine_chunks() for c in _SEQUENCES.names}
    lengths = np.diff(np.r_[0, np.cumsum([len(s) for s in col["seq"].to_pylist()])]) // TURN_BYTES
    digests = np.frombuffer(b"".join(col["seq"].to_pylist()), np.uint8).reshape(-1, TURN_BYTES)
    halves = digests.view(">u8").astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    fresh = np.r_[True, (halves[order][1:] != halves[order][:-1]).any(axis=1)][: len(order)]
    flat = np.empty(len(order), np.int64)
    flat[order] = np.cumsum(fresh) - 1
    trie = DoubleArray(flat, lengths)
    size = len(trie.check)
    n, kids, leaves, saved, spoken_at = (np.zeros(size, np.int64) for _ in range(5))
    least = np.full(size, NOBODY)
    ends = np.full(size, None, object)
    start = col["at"].to_numpy().astype(np.int64)
    carried = {c: col[c].flatten().to_numpy() for c in ("n", "least", "kids", "leaves", "saved")}
    carried_ends = np.array(col["ends"].flatten().to_pylist(), object)
    first = np.r_[0, np.cumsum(lengths - start + 1)]
    spoken = col["words"].flatten().to_numpy()
    on_edge = np.zeros(size, bool)
    ways: dict[int, list[int]] = {0: [], len(lengths) - 1: []}
    for d, who, at in trie.follow():
        has = start[who] <= d
        where, place = at[has], (first[:-1] - start + d)[who[has]]
        for total, c in ((n, "n"), (kids, "kids"), (leaves, "leaves"), (saved, "saved")):
            np.add.at(total, where, carried[c][place])
        np.minimum.at(least, where, carried["least"][place])
        ended = carried_ends[place] != None  # noqa: E711
        ends[where[ended]] = carried_ends[place][ended]
        if d:
            spoken_at[at] = trie.starts[who] + d - 1
        for row, way in ways.items():
            if lengths[row] >= d:
                way.append(int(at[np.searchsorted(who, row)]))
    if not last:
        on_edge[[s for way in ways.values() for s in way]] = True
    words = np.r_[spoken, 0][spoken_at]
    words[0] = 0
    own = {c: x.copy() for c, x in (("n", n), ("least", least), ("kids", kids), ("leaves", leaves), ("saved", saved))}
    used = np.flatnonzero(trie.check >= 0)
    by_depth = used[np.argsort(-trie.depth[used], kind="stable")]
    for level in np.split(by_depth, np.flatnonzero(np.diff(trie.depth[by_depth])) + 1):
        leaves[level] += kids[level] == 0
        saved[level] += (n[level] - 1) * words[level]
        if trie.depth[level[0]]:
            up = trie.check[level]
            for total in (n, leaves, saved):
                np.add.at(total, up, total[level])
            np.minimum.at(least, up, least[level])
            np.add.at(kids, up, 1)
            # what an edge node keeps for the next level comes from children that are finished
            done = level[~on_edge[level]]
            for c, total in (("n", n), ("leaves", leaves), ("saved", saved)):
                np.add.at(own[c], trie.check[done], total[done])
            np.minimum.at(own["least"], trie.check[done], least[done])
            np.add.at(own["kids"], trie.check[done], 1)
    keys = {0: b""}
    need = np.ones(size, bool) if upper else np.isin(np.arange(size), [s for way in ways.values() for s in way])
    for s in by_depth[::-1][need[by_depth[::-1]]].tolist()[1:]:
        keys[s] = hashlib.sha256(keys[int(trie.check[s])] + digests[spoken_at[s]].tobytes()).digest()[:TURN_BYTES]
    done = used[~on_edge[used]]
    up = trie.check[done]
    open_parent = on_edge[up]
    root = done == 0
    finished = pa.RecordBatch.from_arrays(
        [
            pa.array(least[done]),
            pa.array(trie.depth[done]),
            pa.array(least[up], mask=open_parent | root),
            pa.array(n[done]),
            pa.array(kids[done]),
            pa.array(leaves[done]),
            pa.array(saved[done]),
            pa.array([NO_ENDS if e is None else e for e in ends[done]], pa.string()),
            pa.array([keys[s] if upper else None for s in done.tolist()], pa.binary()),
            pa.array([keys[s] if o else None for s, o in zip(up.tolist(), open_parent.tolist())], pa.binary()),
        ],
        schema=_NODES,
    )
    handed = []
    if not last:
        met: set[int] = set()
        for row, way in ways.items():
            fresh_from = next((d for d, s in enumerate(way) if s not in met), len(way))
            met |= set(way)
            if fresh_from < len(way):
                new = way[fresh_from:]
                a, b = trie.starts[row], trie.starts[row] + lengths[row]
                handed.append([digests[a:b].tobytes(), spoken[a:b], fresh_from, *([int(own[c][s]) for s in new] for c in ("n", "least", "kids", "leaves", "saved")), [ends[s] for s in new]])
    return finished, pa.RecordBatch.from_arrays([pa.array([h[k] for h in handed], f.type) for k, f in enumerate(_SEQUENCES)], schema=_SEQUENCES)


def _shards(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of at most so many turns, or of the least number of rows."""
    held: list[pa.RecordBatch] = []
    turns = rows = 0
    for batch in batches:
        sizes = 1 + pc.binary_length(batch.column("seq")).to_numpy() // TURN_BYTES
        a = 0
        for b, size in enumerate(sizes.tolist()):
            if rows >= least and turns + size > most:
                yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                held, turns, rows, a = [], 0, 0, b
            turns, rows = turns + size, rows + 1
        held.append(batch.slice(a))
    if rows:
        yield pa.Table.from_batches(held)


def _level(rows: DataFrame, most: int, upper: bool, last: bool) -> tuple[DataFrame, DataFrame]:
    """Finished nodes of sorted rows, and the sequences for the next level."""

    least = UPPER_ROWS // 4 if upper else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, most, least):
            finished, handed = _pack(shard, upper, last)
            for batch, other in ((finished, _SEQUENCES), (handed, _NODES)):
                if batch.num_rows:
                    gaps = {f.name: pa.nulls(batch.num_rows, f.type) for f in other}
                    both = gaps | dict(zip(batch.schema.names, batch.columns))
                    yield pa.RecordBatch.from_arrays([both[f.name] for f in [*_NODES, *_SEQUENCES]], [f.name for f in [*_NODES, *_SEQUENCES]])

    both = written(rows.mapInArrow(run, f"{NODES}, {SEQUENCES}"), "tries")
    return both.where("depth is not null").select(*_NODES.names), both.where("seq is not null").select(*_SEQUENCES.names)


def prefix_nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    whole = rebuilt(written(turn_rows(turns), "conversations"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    finished, rest = _level(sequences(whole), shard_turns, upper=False, last=False)
    levels = [finished]
    while True:
        left = rest.agg(F.sum(F.length("seq") / TURN_BYTES + 1).alias("turns"), F.count("*").alias("n")).first()
        if not left.n:
            break
        tasks = min(int(left.turns // (8 * shard_turns)), left.n // UPPER_ROWS)
        last = tasks <= 1
        dealt = rest.repartition(1) if last else rest.repartitionByRange(tasks, "seq")
        finished, rest = _level(dealt.sortWithinPartitions("seq", "at"), 1 << 62 if last else shard_turns, upper=True, last=last)
        levels.append(finished)
        if last:
            break
    # nodes of a level whose parents were finished in a later one learn their conv_id by the parent's key
    later = None
    out = []
    for nodes in reversed(levels):
        known, still = nodes.where("parent_key is null"), nodes.where("parent_key is not null")
        out.append(known.select(*names))
        if later is not None:
            facts = later.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent"))
            out.append(join_hot(still, facts, "parent_key", "left").select(*[F.col("parent").alias(c) if c == "parent_conv_id" else c for c in names]))
        keyed = nodes.where("node_key is not null").select("node_key", "conv_id")
        later = keyed if later is None else later.unionByName(keyed)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
