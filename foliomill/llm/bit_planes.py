"""Centroid clustering of integer vectors by popcounts over bit planes.

A vector's 64 components become integers. Bit i of all 64 together is one unsigned 64-bit word, the
vector's plane i, so a vector is as many words as its largest component has bits, the last plane being
the sign's. The dot product of two vectors is the sum over pairs of planes of 2**(i + j) times the
number of ones in the AND of the two words, less where one of them is the sign's plane. Squared
distances follow exactly: |v|^2 + |c|^2 - 2 v.c, all in 64-bit integers.

The vectors are packed once into a written table of planes. In each round every task compares its
planes with those of the centroids (k times 64 integers, the only thing that goes to the tasks), and
gives back counts and componentwise sums of each cluster, themselves counted in the planes; Spark adds
them up and k rows come to the driver. So no vector is ever shuffled, and a cluster that holds a third
of all rows costs nothing more.

Defined results: vectors that are null, have not exactly 64 components, or a null or non-finite
component are left out, and so is a table's rest when nothing is kept (no rows). Rows that repeat a
vec_id are vectors of their own. First centroids are chosen by the hash of vec_id, then by components
where ids repeat; a null vec_id has no hash and comes last. With fewer vectors than centroids there are
fewer centroids. Components whose integer has more than 27 bits have no distance in a long: an error.
Columns other than vec_id and embedding are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import written

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Integers of more bits have squared distances beyond a long.
MOST_BITS = 27
#: Vectors whose planes are compared together.
VECTORS_AT_ONCE = 4096


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per kept row: vec_id, v (array of long), the floor of scale times each component."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == COMPONENTS) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fits = F.forall(x, lambda c: F.abs(c) <= F.lit(float(1 << MOST_BITS) / scale))
    bad = F.raise_error(F.lit(f"a component times {scale} has more than {MOST_BITS} bits")).cast("array<bigint>")
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.when(fits, F.transform(x, lambda c: F.floor(c * scale))).otherwise(bad).alias("v"))


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Planes of rows of 64 integers: one unsigned 64-bit word for each row and bit, component 0 lowest."""
    ones = (values[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(ones, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(bits: int) -> np.ndarray:
    """What a one in each plane is worth; the last plane is the sign's."""
    w = 1 << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Dot products of each row of planes with each row of others, by weighted popcounts."""
    out = np.zeros((len(planes), len(others)), np.int64)
    for i, a in enumerate(weights(planes.shape[1])):
        for j, b in enumerate(weights(others.shape[1])):
            out += a * b * np.bitwise_count(planes[:, i, None] & others[None, :, j]).astype(np.int64)
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Squared length of each row, by popcounts of its planes with each other."""
    w = weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for i, a in enumerate(w):
        for j, b in enumerate(w):
            out += a * b * np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smallest of equals) and its squared distance."""
    away = squares(planes)[:, None] + squares(centroids)[None, :] - 2 * dots(planes, centroids)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(planes)), best]


def sums_of_clusters(planes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's rows, by counting ones of each plane."""
    out = np.zeros((k, COMPONENTS), np.int64)
    order = np.argsort(cluster, kind="stable")
    numbers, starts = np.unique(cluster[order], return_index=True)
    for i, w in enumerate(weights(planes.shape[1])):
        ones = np.unpackbits(np.ascontiguousarray(planes[order, i]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[numbers] += w * np.add.reduceat(ones, starts, axis=0, dtype=np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
            rows = batch.slice(at, VECTORS_AT_ONCE)
            yield rows, np.frombuffer(b"".join(rows.column("planes").to_pylist()), "<u8").reshape(-1, bits)


def packed_table(integers: DataFrame, bits: int) -> DataFrame:
    """Per row of integers: vec_id, planes (binary, eight bytes for each bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                rows = batch.slice(at, VECTORS_AT_ONCE)
                values = rows.column("v").flatten().to_numpy().reshape(-1, COMPONENTS)
                raw = pack(values, bits).astype("<u8").tobytes()
                step = 8 * bits
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array([raw[n : n + step] for n in range(0, len(raw), step)], pa.binary())], ["vec_id", "planes"])

    return integers.mapInArrow(run, "vec_id long, planes binary")


def _round(table: DataFrame, centroids: np.ndarray, bits: int) -> np.ndarray:
    """The centroids after one round: floors of the means; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pack(centroids, bits)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, COMPONENTS), np.int64)
        for _, planes in _blocks(batches, bits):
            cluster, _ = nearest(planes, own)
            counts += np.bincount(cluster, minlength=k)
            sums += sums_of_clusters(planes, cluster, k)
        met = np.flatnonzero(counts)
        rows = np.c_[counts, sums][met]
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(list(rows), pa.list_(pa.int64()))], ["cluster", "total"])

    parts = table.mapInArrow(run, "cluster long, total array<long>").select("cluster", F.posexplode("total").alias("at", "x"))
    out = centroids.copy()
    totals = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k times 65 rows at most
    counted = {r.cluster: int(r.x) for r in totals if r["at"] == 0}
    for r in totals:
        if r["at"]:
            out[r.cluster, r["at"] - 1] = int(r.x) // counted[r.cluster]
    return out


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    integers = integer_vectors(vectors, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    span = integers.select(F.array_max("v").alias("hi"), F.array_min("v").alias("lo")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).first()
    if span.hi is None:
        return spark.createDataFrame([], schema)
    bits = 1 + max(int(x).bit_length() if x >= 0 else (-int(x) - 1).bit_length() for x in (span.hi, span.lo))
    table = written(packed_table(integers, bits), "planes")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = integers.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        centroids = _round(table, centroids, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pack(centroids, bits)
        for rows, planes in _blocks(batches, bits):
            cluster, distance = nearest(planes, own)
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = written(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, total, sum(inertia.values()), digest[c]) for c, total in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(*[f.split()[0] for f in schema.split(", ")])
