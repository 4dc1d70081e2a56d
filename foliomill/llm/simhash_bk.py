"""SimHash near-duplicates through BK-trees.

Each text gets a 64-bit SimHash over its word shingles. Distinct fingerprints link when they differ
in at most ``radius`` bits. A fingerprint within that radius of another shares with it at least
``keep`` of ``keep + radius`` bit blocks unchanged, so fingerprints are dealt into shards by every
choice of ``keep`` blocks; no link is lost, and a shard holds few fingerprints. Each shard is
indexed by a BK-tree (children keyed by their Hamming distance to the parent), and a query follows
only the edges that the triangle inequality leaves: those within the radius of its own distance.

Trees of all shards together have no size bound, so a tree is shipped by the shuffle to the tasks
that hold its queries instead of to every executor. Shards of more than BLOCK fingerprints are cut
into blocks, and each pair of blocks is a task group of its own: the tree of one block goes to the
queries of each other block. A task reports links as stars (each fingerprint with the least one it
reaches in the task), which keeps components and never the square of a group's size.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are
linked like any other; equal fingerprints are one node, however many rows have them. Rows that
repeat a document each get its result. An empty table gives an empty result; columns other than
doc_id and text are not looked at. A null doc_id gets a fingerprint and joins its component, but
names none.

``similar_documents`` links by a shingle similarity (the Jaccard of the sets of distinct shingles)
instead of a number of bits. 512-bit fingerprints of the sets only find candidates, and each link is
confirmed by the written sets of its two texts. As so many changed bits leave no blocks whole, its
shards are keyed by bands of least hashes of the set: a link at the similarity asked for has a shard
in common with a probability of 0.9996, and stands within the radius but for one in thousands.

Only texts that share a shard with another are looked at further; sets of others are not moved.
Candidates are confirmed in rounds, nearest first, so that a large group of near copies costs no square
of links: a text meets its nearest in its own block of a shard, then each component the nearest other
ones through one text each. The last round takes all that is left, so no candidate goes unseen; the texts
of a shard's largest component do not ask there, as the others ask them. A large group of texts that are
nearly similar enough has as many candidates there as the square of its size, so they never leave a task:
a first pass tells the texts that have one, their sets are sent to the groups that asked, and a second
pass confirms them block against block and tells stars of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.bpe import slices
from foliomill.llm.common import connected_components, join_hot, only_rows, text_or_empty, written, written_few

SHINGLE = 4
RADIUS = 4
KEEP = 2
#: XXH64's seed, a fixed value.
SEED = 42
#: Fingerprints of a shard that one tree holds at most.
BLOCK = 4096
#: For links by similarity: 64-bit words of a fingerprint, words of a shingle, similarity, shard keys and least hashes of each.
WIDE, WIDE_SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 8, 5, 0.8, 20, 5
#: Standard deviations that the radius of candidates leaves above the mean; small sets, where half of the hashes may have a bit, vary more.
DEVIATIONS = 4
#: Who asks in each round, and how many of its nearest candidates are confirmed (all at last): texts in their block, one text of each component, all texts.
ROUNDS = (("block", 1), ("one", 4), ("all", 1 << 62))
#: Fingerprints of a shard that one group of candidates holds at most, besides those that ask.
PAIR_BLOCK = 1024
#: Texts with candidates up to which their list is broadcast; beyond, the sets of all texts take one shuffle.
BROADCAST_NODES = 1_000_000
#: Oversized shards up to which their table is broadcast.
BROADCAST_SHARDS = 200_000
#: Comparisons that a task may have in memory at once, and fingerprints that it copies for them at a time.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 21, 1 << 15
#: Shingles of the sets that a block of texts holds at most, unless one text has more, and that are looked up at a time.
SET_BLOCK = 1 << 22


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the A-Z-lower-cased words of text; of all words where they are fewer."""
    words = (text or "").encode().lower().split()  # on bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def simhashes(hashes: list[np.ndarray], words: int = 1) -> np.ndarray:
    """The fingerprint of each list of hashes as a row of words: bits set in over half of the hashes, the words by other hashes each."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros((len(hashes), words), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat, sizes = np.concatenate(hashes), sizes[some]
    # eight bits at a time are counted in the bytes of a sum, which hold what 255 hashes may add up to
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bytewise = np.uint64(0x0101010101010101)
    for w in range(words):
        ones = np.empty((len(some), 8, 8), np.int64)  # by byte and bit
        for bit in range(8):
            sums = np.add.reduceat((flat >> np.uint64(bit)) & bytewise, starts)
            ones[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        bits = 2 * ones.reshape(len(some), 64) > sizes[:, None]
        out[some, w] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        if w + 1 < words:
            flat = remixed(flat)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found = simhashes([shingle_hashes(t, width) for t in rows.column("text").to_pylist()])[:, 0]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def shard_masks(radius: int = RADIUS, keep: int = KEEP) -> list[int]:
    """The bits of each choice of keep among keep + radius blocks, as signed longs."""
    edges = np.linspace(0, 64, radius + keep + 1).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Hamming distances of the rows of a and b, or of rows i of a and j of b; few rows are copied at a time."""
    i = np.arange(len(a)) if i is None else i
    j = np.arange(len(b)) if j is None else j
    out = np.empty(len(i), np.int64)
    for n in range(0, len(i), ROWS_AT_ONCE):
        here = slice(n, n + ROWS_AT_ONCE)
        out[here] = np.bitwise_count(a[i[here]] ^ b[j[here]]).sum(1, dtype=np.int64)
    return out


class BkForest:
    """BK-trees of many groups in flat arrays, built and searched level by level; a value is a row of 64-bit words."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        """groups is sorted; the first value of a group is its root. Equal values of a group hang below each other."""
        self.values = values
        self.fan = 64 * values.shape[1] + 1
        self.root_groups, self.roots = np.unique(groups, return_index=True)
        at = self.roots[np.searchsorted(self.root_groups, groups)]
        todo = np.setdiff1d(np.arange(len(values)), self.roots)
        at = at[todo]
        slots, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(todo):
            slot = at * self.fan + distances(values, values, todo, at)
            taken, first, which = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(taken)
            children.append(todo[first])
            at = todo[first][which]
            below = np.ones(len(todo), bool)
            below[first] = False
            todo, at = todo[below], at[below]
        slots, children = np.concatenate(slots), np.concatenate(children)
        order = np.argsort(slots)
        self.slots, self.children = slots[order], children[order]

    def within(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) index pairs at most radius apart, each query against the tree of its group."""
        place = np.searchsorted(self.root_groups, groups)
        place[place == len(self.root_groups)] = 0
        asked = np.flatnonzero(self.root_groups[place] == groups) if len(self.root_groups) else np.empty(0, np.int64)
        node = self.roots[place[asked]] if len(asked) else asked
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(asked):
            distance = distances(queries, self.values, asked, node)
            near = distance <= radius
            hits.append((asked[near], node[near]))
            low = np.searchsorted(self.slots, node * self.fan + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.slots, node * self.fan + np.minimum(distance + radius, self.fan - 1), "right")
            many = high - low
            asked = np.repeat(asked, many)
            step = np.arange(len(asked)) - np.repeat(np.cumsum(many) - many, many)
            node = self.children[np.repeat(low, many) + step]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def group_links(value: np.ndarray, group: np.ndarray, ask: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among the values of each group: queries (ask) against the tree's values (tree)."""
    in_tree, asking = np.flatnonzero(tree), np.flatnonzero(ask)
    forest = BkForest(value[in_tree], group[in_tree])
    q, v = forest.within(value[asking], group[asking], radius)
    a, b = asking[q], in_tree[v]
    reach = stars(len(value), a, b)
    linked = np.flatnonzero(reach != np.arange(len(value)))
    return linked, reach[linked]


def near_pairs(value: np.ndarray, group: np.ndarray, rows: dict[str, np.ndarray], radius: int, similarity: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each group, within the radius and of different labels: of each that asks its top nearest in the tree.

    Sets whose sizes alone keep their similarity below the one asked for are no candidates.
    """
    in_tree, asking = np.flatnonzero(rows["tree"]), np.flatnonzero(rows["ask"])
    q, v = BkForest(value[in_tree], group[in_tree]).within(value[asking], group[asking], radius)
    a, b = asking[q], in_tree[v]
    small, large = np.minimum(rows["size"][a], rows["size"][b]), np.maximum(rows["size"][a], rows["size"][b])
    fits = (rows["label"][a] != rows["label"][b]) & (small >= similarity * large)
    a, b = a[fits], b[fits]
    order = np.lexsort((remixed((rows["node"][a] ^ rows["node"][b]).view(np.uint64)), distances(value, value, a, b), a))
    a, b = a[order], b[order]
    taken = np.arange(len(a)) - np.searchsorted(a, a) < top
    return a[taken], b[taken]


def similar_pairs(sets: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets (arrays of distinct hashes) a and b of each pair have that Jaccard similarity or more."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    used, which = np.unique(np.r_[a, b], return_inverse=True)
    sizes = np.fromiter(map(len, sets[used]), np.int64, len(used))
    number, ends = np.unique(np.concatenate(sets[used]), return_inverse=True)[1], np.cumsum(sizes)
    own = np.split(number, ends[:-1])
    a, b = which[: len(a)], which[len(a) :]
    order = np.argsort(a, kind="stable")
    here = np.zeros(number.max(initial=-1) + 1, bool)
    for pairs in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        one = a[pairs[0]]
        here[own[one]] = True
        turn = np.cumsum(sizes[b[pairs]]) // SET_BLOCK
        for some in np.split(pairs, np.flatnonzero(np.diff(turn)) + 1):
            found = np.r_[0, np.cumsum(here[np.concatenate([own[n] for n in b[some]])])]
            last = np.cumsum(sizes[b[some]])
            common = found[last] - found[last - sizes[b[some]]]
            out[some] = common / (sizes[one] + sizes[b[some]] - common) >= similarity
        here[own[one]] = False
    return out


def by_groups(key: list[str], columns: list[str], work):
    """A mapInArrow function over rows sorted by key: work(numbers of groups, rows) on whole groups, many at a time. Columns are numbers, or lists of longs."""

    def values(column: pa.Array) -> np.ndarray:
        found = column.to_numpy(zero_copy_only=False)
        return found if pa.types.is_list(column.type) else found.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        numbers, last, number = np.empty(0, np.int64), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in key])
            before = np.concatenate([keys[:, :1] if last is None else last, keys[:, :-1]], 1)
            new = number + np.cumsum((keys != before).any(0))
            number, last = int(new[-1]), keys[:, -1:]
            numbers = np.r_[numbers, new]
            fresh = {c: values(batch.column(c)) for c in columns}
            held = {c: np.concatenate([held[c], fresh[c]]) for c in columns} if held else fresh
            whole = numbers != number
            if whole.any():
                yield from work(numbers[whole], {c: x[whole] for c, x in held.items()})
                numbers, held = numbers[~whole], {c: x[~whole] for c, x in held.items()}
        if len(numbers):
            yield from work(numbers, held)

    return run


def turns(numbers: np.ndarray, rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Groups and their rows, as many at a time as their comparisons allow; groups of one have nothing to link."""
    group = np.cumsum(np.r_[0, numbers[1:] != numbers[:-1]])
    sizes = np.bincount(group)
    turn = np.where(sizes > 1, np.cumsum(sizes.astype(float) ** 2) // PAIRS_AT_ONCE, -1)[group]
    for t in np.unique(turn[turn >= 0]):
        yield group[turn == t], {c: x[turn == t] for c, x in rows.items()}


def _pairs_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, keep: int = KEEP, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fp within the radius."""
    masks = shard_masks(radius, keep)
    shards = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(shards).alias("s")).select("fp", "s.choice", "s.bits")
    crowded = rows.groupBy("choice", "bits").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    paired = (
        rows.join(crowded, ["choice", "bits"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")
    )
    key = ["choice", "bits", "low", "high"]

    def links(numbers: np.ndarray, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for group, some in turns(numbers, rows):
            u, v = group_links(some["fp"].view(np.uint64)[:, None], group, some["own"] == some["low"], some["own"] == some["high"], radius)
            yield _pairs_of(some["fp"][u], some["fp"][v])

    return paired.repartition(*key).sortWithinPartitions(*key).mapInArrow(by_groups(key, ["own", "low", "high", "fp"], links), "u long, v long")


def raw_digest() -> Column:
    """SHA-256 of the text as it is."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def shingle_sets(docs: DataFrame, width: int = WIDE_SHINGLE, words: int = WIDE) -> DataFrame:
    """Per row of docs: doc_id, digest (of the text), node (a hash of the set), size, w0..: SimHash words of the set, bands (shard keys; none of an empty set), shingles (the sorted set)."""
    columns = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in rows.column("text").to_pylist()]
            found = simhashes(sets, words).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED) for x in sets], np.uint64)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64))) for x in (list(map(band_keys, sets)), sets)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("digest"), pa.array(node.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), *[pa.array(found[:, k]) for k in range(words)], *lists],
                ["doc_id", "digest", "node", "size", *columns, "bands", "shingles"],
            )

    schema = "doc_id long, digest binary, node long, size long, " + ", ".join(f"{c} long" for c in columns) + ", bands array<long>, shingles array<long>"
    return docs.select("doc_id", "text", raw_digest().alias("digest")).mapInArrow(run, schema)


@cache
def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of n multiplicative hash functions."""
    factors, shifts = np.random.default_rng(SEED).integers(0, 1 << 64, (2, n), np.uint64)
    return factors | np.uint64(1), shifts


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band: of the least values that the set has under some hash functions (MinHash)."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    factors, shifts = hash_functions(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 128):  # pieces that stay in a core's cache
        values = hashes[a : a + 128, None] * factors
        values += shifts
        np.minimum(least, values.min(0), out=least)
    key = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        key = remixed(key ^ column)
    return key


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Another hash of what each hash stands for (an xor-multiply mix)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_radius(similarity: float = SIMILARITY, words: int = WIDE) -> int:
    """Bits in which fingerprints of texts of that Jaccard similarity differ on average, and DEVIATIONS standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * words
    return int(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share)))


def crowded_nodes(distinct: DataFrame) -> DataFrame:
    """The nodes of distinct (node, bands) that share a shard with another, as a written table."""
    rows = distinct.select("node", F.posexplode("bands").alias("choice", "bits"))
    crowded = rows.groupBy("choice", "bits").agg(F.count("*").alias("count")).where("count > 1")
    return written(rows.join(crowded.select("choice", "bits"), ["choice", "bits"], "left_semi").select("node").distinct(), "crowded")


def wide_links(nodes: DataFrame, sets: DataFrame, radius: int, similarity: float, who: str, top: int, words: int = WIDE, block: int = PAIR_BLOCK) -> DataFrame | None:
    """Links (u, v) among nodes (node, label, size, w0, ..., bands) whose labels differ and that share a shard: of each that asks its top nearest candidates are confirmed by their sets (node, shingles).

    None if no shard has different labels. Where all ask, links are stars, which have the same components.
    """
    columns = [f"w{k}" for k in range(words)]
    # where all ask, a text carries 32 bits of each of its bands' keys
    code = lambda n: F.get("bands", F.lit(n)).bitwiseAND(F.lit(0xFFFFFFFF))
    again = [f"b{k}" for k in range((BANDS + 1) // 2)] if who == "all" else []
    codes = [F.coalesce(code(2 * k), F.lit(0)).bitwiseOR(F.shiftleft(F.coalesce(code(2 * k + 1), F.lit(0)), 32)).alias(b) for k, b in enumerate(again)]
    rows = nodes.select("node", "label", "size", *columns, *codes, F.posexplode("bands").alias("choice", "bits"))
    labels = rows.groupBy("choice", "bits", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("node").alias("first"))
    shards = labels.groupBy("choice", "bits").agg(F.sum("n").alias("count"), F.sum("shingles").alias("shingles"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1")
    # one text of each label stands for it, or all do; where sets are sent too, a block has not too many shingles
    size = F.col("labels") if who == "one" else F.col("count")
    parts = F.greatest(size / F.lit(block), F.col("shingles") / F.lit(SET_BLOCK)) if who == "all" else size / F.lit(block)
    shards = written(shards.select("choice", "bits", F.when(F.col("most.n") > 1, F.col("most.label")).alias("main"), F.ceil(parts).cast("int").alias("parts")), "shards")
    number = shards.count()
    if not number:
        return None
    rows = rows.join(F.broadcast(shards) if number <= BROADCAST_SHARDS else shards, ["choice", "bits"])
    if who == "one":
        rows = rows.join(labels.select("choice", "bits", F.col("first").alias("node")), ["choice", "bits", "node"])
    own = F.pmod(F.col("node"), F.col("parts")).cast("int")
    asks = F.lit(True) if who == "block" else ~F.col("label").eqNullSafe(F.col("main"))
    blocks = F.array(own) if who == "block" else F.when(asks, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    rows = rows.withColumns({"own": own, "ask": asks.cast("int"), "block": F.explode(blocks)}).withColumn("tree", (F.col("own") == F.col("block")).cast("int"))
    key, held = ["choice", "bits", "block"], ["node", "label", "size", "ask", "tree", *columns, *again]

    def candidates(group: np.ndarray, some: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, v = near_pairs(np.stack([some[c].view(np.uint64) for c in columns], 1), group, some, radius, similarity, top)
        if not again:
            return u, v
        # a pair is told in the first shard that both are in
        met = np.zeros(len(u), bool)
        for n in range(BANDS):
            codes = some[again[n // 2]].view(np.uint32).reshape(-1, 2)[:, n % 2]
            met |= (n < some["choice"][u]) & (codes[u] == codes[v])
        return u[~met], v[~met]

    def pairs(numbers: np.ndarray, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for group, some in turns(numbers, found):
            u, v = (some["node"][x] for x in candidates(group, some))
            # two that ask each other are told once
            both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            yield _pairs_of(both[:, 0].copy(), both[:, 1].copy())

    def doubts(numbers: np.ndarray, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The texts that have candidates: those that ask in parts of a bounded number of shingles, and in each part those that they ask."""
        for group, some in turns(numbers, found):
            u, v = candidates(group, some)
            if not len(u):
                continue
            asking = np.unique(u)
            start = np.searchsorted(group[asking], group[asking])
            before = np.r_[0, np.cumsum(some["size"][asking])]
            part = np.zeros(len(group), np.int64)
            part[asking] = (before[1:] - before[start]) // SET_BLOCK
            ends = np.concatenate([np.stack([asking, part[asking], 0 * asking + 1, 0 * asking], 1), np.stack([v, part[u], 0 * v, 0 * v + 1], 1)])
            places, which = np.unique(ends[:, :2], axis=0, return_inverse=True)
            flags = np.zeros((len(places), 2), np.int64)
            np.maximum.at(flags, which.ravel(), ends[:, 2:])
            at = places[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(some[k][at]) for k in ("choice", "bits", "block")], pa.array(places[:, 1].copy()), pa.array(some["node"][at]), pa.array(flags[:, 0].copy()), pa.array(flags[:, 1].copy())],
                ["choice", "bits", "block", "part", "node", "ask", "tree"],
            )

    def links(numbers: np.ndarray, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for group, some in turns(numbers, found):
            u, v = candidates(group, some)
            fine = similar_pairs(some["shingles"], u, v, similarity)
            reach = stars(len(group), u[fine], v[fine])
            linked = np.flatnonzero(reach != np.arange(len(group)))
            yield _pairs_of(some["node"][linked], some["node"][reach[linked]])

    dealt = rows.select(*key, *held).repartition(*key).sortWithinPartitions(*key)
    if who != "all":
        return confirmed(written(dealt.mapInArrow(by_groups(key, held, pairs), "u long, v long").distinct(), "candidates"), sets, similarity)
    told = written(dealt.mapInArrow(by_groups(key, [*key, *held], doubts), "choice long, bits long, block long, part long, node long, ask long, tree long"), "doubts")
    again_key = [*key, "part"]
    whole = told.join(nodes.select("node", "label", "size", *columns, *codes), "node").join(sets, "node").select(*again_key, *held, "shingles")
    return whole.repartition(*again_key).sortWithinPartitions(*again_key).mapInArrow(by_groups(again_key, ["choice", *held, "shingles"], links), "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, shingles) have that Jaccard similarity or more."""
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in ("u", "v"))
    both = pairs.join(left, "u").join(right, "v")
    a, b = F.size("u_set"), F.size("v_set")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return both.where(common / (a + b - common) >= similarity).select("u", "v")


def merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, root) of components that further links (u, v) join; only the components' roots are gone through again."""
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    half = written_few(join_hot(links, of("u"), "u", "left"), "half", links.count())
    ends = join_hot(half, of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    joined = connected_components(ends)
    moved = join_hot(roots, joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = joined.join(roots, "node", "left_anti")
    return written_few(moved.unionByName(fresh), "merged", roots.count() + joined.count())


def _similar(docs: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest, node) of each row of docs, the nodes with their first row, and the (node, root) of all linked nodes.

    A row is named by a struct of whether its doc_id is null, the doc_id, and the text's digest.
    """
    spark = docs.sparkSession
    columns = [f"w{k}" for k in range(WIDE)]
    marked = written(shingle_sets(docs, width), "simhash")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    distinct = written(marked.groupBy("node").agg(F.min(name).alias("first_doc"), *[F.first(c).alias(c) for c in ["size", *columns, "bands"]]), "fingerprints")
    crowded = crowded_nodes(distinct)
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_NODES else crowded
    nodes = written(distinct.drop("first_doc").join(few, "node", "left_semi"), "nodes")
    sets = written(marked.select("node", "shingles").join(few, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    roots = None
    for who, top in ROUNDS:
        labelled = nodes.withColumn("label", F.col("node")) if roots is None else nodes.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = wide_links(labelled, sets, wide_radius(similarity), similarity, who, top)
        if links is None:
            break
        new = written(links, "near")
        if not new.isEmpty():
            roots = connected_components(new) if roots is None else merged_roots(roots, new)
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    return marked.select("doc_id", "digest", "node"), distinct.select("node", "first_doc"), roots


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDE_SHINGLE) -> DataFrame:
    """Per row of docs: doc_id and component_id, the least doc_id of the texts that links of that similarity reach."""
    rows, nodes, roots = _similar(docs, similarity, width)
    return _named(rows, nodes, roots).select("doc_id", F.col("component_id.doc_id").alias("component_id"))


def _named(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (with node) and the least first_doc of each node's component, as component_id."""
    placed = written(nodes.join(roots, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root")), "placed")
    least = written(placed.groupBy("root").agg(F.min("first_doc").alias("component_id")), "least")
    return join_hot(rows, join_hot(placed, least, "root").select("node", "component_id"), "node")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (its least doc_id)."""
    marked = written(fingerprints(docs, width), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fingerprints")
    roots = connected_components(written(fingerprint_links(distinct.select("fp"), radius), "near"))
    named = _named(marked.withColumnRenamed("fp", "node"), distinct.withColumnRenamed("fp", "node"), roots)
    return named.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDE_SHINGLE) -> DataFrame:
    """One row of docs for each group of similar texts, with all its columns, whatever their names.

    It is the row with the least doc_id (null ids come last), of such rows that with the least digest
    of its text; of rows that repeat both, one. Rows are told apart by doc_id and text, so a row with
    a repeated or null doc_id only goes if its own text is in a group.
    """
    rows, nodes, roots = _similar(docs, similarity, width)
    named = _named(rows, nodes, roots)
    first = named.where(F.col("doc_id").eqNullSafe(F.col("component_id.doc_id")) & (F.col("digest") == F.col("component_id.digest")))
    return only_rows(docs, raw_digest(), first.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")))
