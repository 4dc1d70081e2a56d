"""Embedding near-duplicates over a robust-pruned flat graph.

A tree of centroids deals vectors to overlapping shards: every cell of more than BLOCK vectors is
divided by spherical k-means of a sample of its own, and a vector goes to the nearest child and, up to
``overlap`` children, to those that are hardly farther. So shards stay under BLOCK whatever the number
of vectors, and the work for a vector does not grow with it. Each shard becomes a graph: every vector
keeps the candidates that robust pruning leaves, from its nearest vectors and from some far ones, and
gets links back. The adjacency lists of a vector's shards are united. Every vector then searches each
of its shards: a greedy beam goes from the shard's medoid towards it, then the search expands through
all vectors within range until none is left. Cosines are computed in double precision, so every
reported link is verified. A pair that meets in several shards counts in the least of them only, so
tasks add up counts and never send pairs; for components they send stars (each vector with the least
one it reaches in the task). A cell that centroids cannot divide is cut into blocks, each of which is
searched from each other.

An audit compares the links of a sample of AUDITED vectors, drawn evenly from all, with brute force
over all rows. While its recall is below the target, shards overlap more; if the last overlap does not
reach it, all pairs are compared in blocks, up to EXACT_NODES distinct vectors, and beyond that the
operator raises an error that tells the recall. It never returns fewer links in silence.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing. Vectors of different lengths do not link; each length has an index of its own. Equal vectors
are one node of the graph, each row counting as a link of the others. A row without links is its own
component. Rows that repeat a vec_id are vectors of their own; a null vec_id names no component unless
all of its are null. An empty table gives an empty result; columns other than vec_id and embedding are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import connected_components, join_hot, written
from foliomill.llm.simhash_bk import stars

THRESHOLD = 0.95
#: Vectors of one graph at most; cells with more are divided.
BLOCK = 2048
#: Children of a cell at most, sampled vectors for each child, levels of the tree at most, and vectors that are dealt to children together.
FAN, SAMPLED, LEVELS, CHUNK = 64, 32, 8, 16_384
#: Cells up to which their table is broadcast.
BROADCAST_CELLS = 50_000
DEGREE, FAR_DEGREE, ALPHA, CANDIDATES = 20, 8, 1.2, 64
BEAM, QUERIES_AT_ONCE = 24, 256
AUDITED, TARGET_RECALL = 1024, 0.95
#: Children that a vector goes to at most, and how much farther than the nearest they may be, in the standard deviations that a linked vector's distance may differ by.
OVERLAPS = ((2, 4.0), (3, 6.0), (4, 8.0))
#: A cell is not divided if its children would hold this share of it on average.
LEAST_GAIN = 0.4
#: Distinct vectors up to which all pairs are compared where the index stays below the target.
EXACT_NODES = 500_000


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(1, initial=0, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an Arrow list column whose lists have one length."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a sample, started from rows spread evenly over it."""
    found = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), found)
    return found


def robust_prune(near: np.ndarray, sims: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Of each row's candidates (sorted from near to far) at most degree that no kept one stands before; -1 fills up.

    A candidate goes when a kept one is alpha times nearer to it than the row's own vector is.
    """
    rows = np.arange(len(near))
    own = np.maximum(0.0, 2 - 2 * sims[rows[:, None], near])
    alive = near >= 0
    out = np.full((len(near), degree), -1)
    for k in range(degree):
        first = alive.argmax(1)
        going = alive[rows, first]
        if not going.any():
            break
        pick = near[rows, first]
        out[going, k] = pick[going]
        between = np.maximum(0.0, 2 - 2 * sims[pick[:, None], near])
        alive &= ~((alpha**2 * between <= own) & going[:, None])
        alive[rows, first] = False
    return out


def build_graph(vectors: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Adjacency lists of a robust-pruned graph over unit vectors."""
    n = len(vectors)
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -2.0)
    many = min(CANDIDATES, n - 1)
    if many < 1:
        return [np.empty(0, np.int64)] * n
    near = np.argpartition(-sims, many - 1, axis=1)[:, :many]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    far = np.random.default_rng(seed).integers(0, n, (n, 2 * FAR_DEGREE))
    far = np.take_along_axis(far, np.argsort(-np.take_along_axis(sims, far, 1), axis=1, kind="stable"), 1)
    far[far == np.arange(n)[:, None]] = -1
    np.fill_diagonal(sims, 1.0)
    kept = np.concatenate([robust_prune(near, sims, DEGREE), robust_prune(far, sims, FAR_DEGREE)], 1)
    a, b = np.repeat(np.arange(n), kept.shape[1]), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    # links back, at most as many again for each vector, nearest first
    order = np.lexsort((-sims[a, b], b))
    into, source = b[order], a[order]
    place = np.arange(len(into)) - np.searchsorted(into, into)
    short = place < DEGREE + FAR_DEGREE
    a, b = np.r_[a, into[short]], np.r_[b, source[short]]
    pairs = np.unique(a * n + b)
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def range_search(vectors: np.ndarray, lists: np.ndarray, queries: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of cosine at least threshold that the graph leads to.

    lists has a row of neighbours for each vector, filled up with -1.
    """
    n, asked, found = len(vectors), [], []
    medoid = int((vectors @ vectors.mean(0)).argmax())
    padded = np.where(lists >= 0, lists, n)
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        q = queries[a : a + QUERIES_AT_ONCE]
        rows = np.arange(len(q))
        sims = np.full((len(q), n + 1), -np.inf)  # of what was seen; the last place takes the filling
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        open_ = np.full((len(q), n + 1), -np.inf)  # of what was seen and not expanded

        def expand(who: np.ndarray, node: np.ndarray) -> None:
            new = padded[node]
            at, column = np.nonzero(~seen[who[:, None], new])
            w, v = who[at], new[at, column]
            value = np.einsum("ij,ij->i", q[w], vectors[v])
            seen[w, v] = True
            sims[w, v] = open_[w, v] = value

        seen[:, medoid] = True
        sims[:, medoid] = open_[:, medoid] = q @ vectors[medoid]
        going = rows
        for _ in range(n):
            best = open_[going].argmax(1)
            # a query goes on while its best open vector is among the beam best it has seen
            bar = -np.partition(-sims[going], min(beam, n) - 1, axis=1)[:, min(beam, n) - 1]
            value = open_[going, best]
            on = (value > -np.inf) & (value >= bar)
            going, best = going[on], best[on]
            if not len(going):
                break
            open_[going, best] = -np.inf
            expand(going, best)
        while True:
            who, node = np.nonzero(open_[:, :n] >= threshold)
            if not len(who):
                break
            open_[who, node] = -np.inf
            for b in range(0, len(who), 8192):
                expand(who[b : b + 8192], node[b : b + 8192])
        w, v = np.nonzero(sims[:, :n] >= threshold)
        asked.append(w + a)
        found.append(v)
    return (np.concatenate(asked), np.concatenate(found)) if asked else (np.empty(0, np.int64),) * 2


def usable() -> Column:
    """Whether a row's vector can link."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))


def _few(table: DataFrame) -> DataFrame:
    """A written table of cells, broadcast while it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_CELLS else table


def _divide(overlap: int, margin: float, spread: float):
    """Functions for applyInPandas: centroids of a cell's sample, and children of a chunk of its vectors."""

    def nearest(vectors: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, child) pairs."""
        near = vectors @ means.T
        order = np.argsort(-near, axis=1, kind="stable")[:, : min(overlap, max(1, len(means) // 2))]
        sims = np.take_along_axis(near, order, 1)
        row, place = np.nonzero(sims >= sims[:, :1] - margin * np.sqrt(spread / vectors.shape[1]))
        return row, order[row, place]

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("node", kind="stable")
        vectors = unit(np.stack(sample["embedding"].to_numpy()))
        means = centroids(vectors, min(len(sample), int(sample["children"].iloc[0])))
        if len(nearest(vectors, means)[0]) > LEAST_GAIN * len(vectors) * len(means):
            means = means[:0]
        return pd.DataFrame({"dims": [sample["dims"].iloc[0]], "cell": [sample["cell"].iloc[0]], "means": [means.ravel()]})

    def deal(key: tuple, part: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = part[["node", "copies", "dims", "embedding", "cell"]]
        if not len(fitted) or not len(fitted["means"].iloc[0]):
            return out.assign(cell=-1 - out["cell"])  # below zero are cells that stay as they are
        dims, cell = int(key[0]), int(key[1])
        if not len(part):
            return out
        row, child = nearest(unit(np.stack(part["embedding"].to_numpy())), fitted["means"].iloc[0].reshape(-1, dims))
        out = out.iloc[row].reset_index(drop=True)
        out["cell"] = cell * (FAN + 1) + child + 1
        return out

    return fit, deal


def shards(nodes: DataFrame, overlap: int, margin: float, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (node, copies, dims, embedding, cell): nodes with each of their shards, a written table."""
    columns = ["node", "copies", "dims", "embedding", "cell"]
    kinds = dict(nodes.dtypes)["embedding"]
    fit, deal = _divide(overlap, margin, 2 - 2 * threshold)
    undivided, done = nodes.withColumn("cell", F.lit(0).cast("long")).select(columns), []
    for level in range(LEVELS):
        sizes = undivided.where("cell >= 0").groupBy("dims", "cell").count().where(F.col("count") > BLOCK)
        children = F.least(F.lit(FAN), F.greatest(F.lit(4), F.ceil(2 * F.col("count") / BLOCK))).cast("int")
        crowded = written(sizes.select("dims", "cell", "count", children.alias("children"), F.ceil(F.col("count") / CHUNK).cast("int").alias("parts")), "crowded")
        if crowded.isEmpty():
            break
        done.append(undivided.join(_few(crowded.select("dims", "cell")), ["dims", "cell"], "left_anti").select(columns))
        big = undivided.join(_few(crowded), ["dims", "cell"])
        drawn = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < F.lit(float(SAMPLED << 30)) * F.col("children") / F.col("count")
        means = big.where(drawn).groupBy("dims", "cell").applyInPandas(fit, "dims int, cell long, means array<double>")
        means = written(means, "means").join(crowded, ["dims", "cell"]).select("dims", "cell", "means", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        key = ["dims", "cell", "part"]
        parted = big.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        undivided = written(parted.groupBy(*key).cogroup(means.groupBy(*key)).applyInPandas(deal, f"node long, copies long, dims int, embedding {kinds}, cell long"), "cells")
    for part in done:
        undivided = undivided.unionByName(part)
    return written(undivided, "shards")


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("node", kind="stable")
    node = part["node"].to_numpy()
    lists = build_graph(unit(np.stack(part["embedding"].to_numpy())))
    return pd.DataFrame({"node": node, "cell": part["cell"].to_numpy(), "near": [node[x] for x in lists]})


def _table(lists: list[np.ndarray], filling: int) -> np.ndarray:
    """Lists as rows, filled up."""
    out = np.full((len(lists), max([1, *map(len, lists)])), filling)
    for row, values in zip(out, lists):
        row[: len(values)] = values
    return out


def _search(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").reset_index(drop=True)
        cell = part["cell"].iloc[0]
        node, copies, asks, held = (part[c].to_numpy() for c in ("node", "copies", "asks", "held"))
        vectors = unit(np.stack(part["embedding"].to_numpy()))
        inside, asking = np.flatnonzero(held), np.flatnonzero(asks)
        wanted = _table(part["near"].to_numpy()[inside].tolist(), -1)  # united lists name vectors of other shards too
        at = np.minimum(np.searchsorted(node[inside], wanted), len(inside) - 1)
        q, v = range_search(vectors[inside], np.where(node[inside][at] == wanted, at, -1), vectors[asking], threshold)
        q, v = asking[q], inside[v]
        q, v = q[q != v], v[q != v]
        # a pair counts in the least shard that both are in
        cells = part["cells"].to_numpy().tolist()
        of, to = _table(cells, -1), _table(cells, -2)
        step = max(1, (1 << 22) // of.shape[1] ** 2)
        counts = np.zeros(len(part))
        for a in range(0, len(q), step):
            x, y = q[a : a + step], v[a : a + step]
            both = (of[x][:, :, None] == to[y][:, None, :]).any(2)
            first = of[x, both.argmax(1)] == cell
            counts += np.bincount(x[first], copies[y[first]].astype(float), len(part))
        return _told(node, counts, stars(len(part), q, v))

    return run


def _told(node: np.ndarray, counts: np.ndarray, reach: np.ndarray) -> pd.DataFrame:
    told = (counts > 0) | (reach != np.arange(len(node)))
    return pd.DataFrame({"node": node[told], "links": counts[told].astype(np.int64), "reach": node[reach[told]]})


def _roles(own: str, other: str) -> Column:
    """What a row of block own is in the tasks of the pair with block other: it asks, or is held in the graph."""
    same = F.col(own) == F.col(other)
    role = lambda q, t, asks, held: F.struct(F.col(q).alias("q"), F.col(t).alias("t"), F.lit(asks).alias("asks"), F.lit(held).alias("held"))
    return F.when(same, F.array(role(own, own, True, True))).otherwise(F.array(role(own, other, True, False), role(other, own, False, True)))


def index_links(nodes: DataFrame, overlap: int, margin: float, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (node, links, reach) of all tasks; links of a node add up."""
    dealt = shards(nodes, overlap, margin, threshold)
    sizes = dealt.groupBy("dims", "cell").count().where(F.col("count") > BLOCK)
    crowded = written(sizes.select("dims", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "undivided")
    dealt = dealt.join(_few(crowded), ["dims", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    lists = dealt.groupBy("dims", "cell", "own").applyInPandas(_build, "node long, cell long, near array<long>")
    united = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_sort(F.collect_list("cell")).alias("cells")), "graph")
    paired = dealt.join(united, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = paired.withColumn("role", F.explode(_roles("own", "other"))).select("dims", "cell", "role.*", "node", "copies", "embedding", "cells", "near")
    return tasks.groupBy("dims", "cell", "q", "t").applyInPandas(_search(threshold), "node long, links long, reach long")


def exact_links(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """As index_links, by comparing every block of nodes with every block."""
    parts = max(1, -(-nodes.count() // block))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").reset_index(drop=True)
        node, copies, asks, held = (part[c].to_numpy() for c in ("node", "copies", "asks", "held"))
        vectors = unit(np.stack(part["embedding"].to_numpy()))
        inside, asking = np.flatnonzero(held), np.flatnonzero(asks)
        q, v = np.nonzero(vectors[asking] @ vectors[inside].T >= threshold)
        q, v = asking[q], inside[v]
        q, v = q[q != v], v[q != v]
        return _told(node, np.bincount(q, copies[v].astype(float), len(part)), stars(len(part), q, v))

    own = nodes.select("node", "copies", "dims", "embedding", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("own"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("role", F.explode(_roles("own", "other")))
    return paired.select("dims", "role.*", "node", "copies", "embedding").groupBy("dims", "q", "t").applyInPandas(compare, "node long, links long, reach long")


def audit_recall(nodes: DataFrame, links: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> float:
    """Share of the true links that was found of a bounded sample, drawn evenly from all nodes.

    It is the lesser of the share of all their links and the mean of each vector's share, so that
    neither a few large groups nor many small ones can hide the others.
    """
    picked = nodes.orderBy(F.xxhash64("node", F.lit(2)), "node").limit(audited).select("node", "dims", "embedding").toArrow()
    asked = {}
    for d in set(picked.column("dims").to_pylist()):
        some = picked.filter(pc.equal(picked.column("dims"), d))
        asked[d] = some.column("node").to_numpy(), matrix(some.column("embedding").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (names, queries) in asked.items():
                same = batch.filter(pc.equal(batch.column("dims"), d))
                for a in range(0, same.num_rows, 2048):
                    part = same.slice(a, 2048)
                    hit = (matrix(part.column("embedding")) @ queries.T >= threshold) & (part.column("node").to_numpy()[:, None] != names)
                    truth = part.column("copies").to_numpy() @ hit
                    some = np.flatnonzero(truth)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(truth[some])], ["node", "truth"])

    truth = nodes.select("node", "copies", "dims", "embedding").mapInArrow(run, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    got = F.least("truth", F.coalesce("links", F.lit(0)))
    total, found, each = truth.join(links.select("node", "links"), "node", "left").agg(F.sum("truth"), F.sum(got), F.avg(got / F.col("truth"))).first()
    return min(found / total, each) if total else 1.0


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, and recall, which the audit found (the same in all rows)."""
    kind = dict(rows.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = rows.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    good = rows.where(usable())
    distinct = good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    # numbered where they are written: the numbers are read from there ever after
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("node"), "copies", "first", F.size("embedding").alias("dims"), "embedding"), "vectors")
    n, recall = nodes.count(), 1.0
    found = links = None
    for overlap, margin in OVERLAPS if n else ():
        found = written(index_links(nodes, overlap, margin, threshold), "found")
        links = written(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")
        recall = audit_recall(nodes, links, threshold)
        if recall >= target:
            break
    else:
        if n > EXACT_NODES:
            raise RuntimeError(f"the index finds {recall:.3f} of the links, less than {target}, and {n} vectors are too many to compare all pairs")
        if n:
            found = written(exact_links(nodes, threshold), "found")
            links, recall = written(found.groupBy("node").agg(F.sum("links").alias("links")), "counts"), 1.0
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(recall).alias("recall"))
    if found is None:
        return alone(rows)
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("reach").alias("v")).where("u <> v"))
    placed = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left"), "placed")
    least = written(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = join_hot(placed, least, "root").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = join_hot(good, written(named, "named"), "embedding").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"))
    return linked.unionByName(alone(rows.where(~usable())))
