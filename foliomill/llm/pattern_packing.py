"""Best-fit packing by patterns.

Documents become pieces of at most ``capacity`` tokens (a longer document is cut into full pieces,
its first piece being the shorter one). Packing looks only at the histogram of piece lengths, which
has ``capacity`` entries whatever the corpus: few-document patterns that fill a sequence exactly are
enumerated, non-negative least squares fits their repeat counts to the histogram, the counts are
rounded down to what the histogram holds, and best-fit decreasing packs the lengths left over. The
plan is a list of (pattern, repeats), at most some thousand entries; each piece then finds its place
by its rank among the pieces of its length. Ranks come from counts by (length, bucket) and a row
number within each bucket, so that a length that a third of all pieces share is ranked in many tasks.

Defined results: a null or empty text is one piece of the end token alone. Rows that repeat a
document are packed each. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.bpe import slices, vocabulary
from foliomill.llm.common import written

CAPACITY = 1024
END_ID = 2
#: Steps of projected gradient descent; the fit is only rounded down, so it need not be sharp.
STEPS = 300
#: Buckets among which the pieces of one length are ranked, for each shuffle partition.
BUCKETS_PER_PARTITION = 4
#: Rows of a plan up to which it is broadcast; patterns bound it (some 90,000 at the default capacity), so only a larger capacity can pass this.
BROADCAST_PLAN = 200_000


def document_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut to capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = vocabulary(tokenizer_file), end_id.to_bytes(4, "little")
        for rows in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for n, ids in enumerate(bpe.encode(rows.column("text").to_pylist())):
                ids += end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total, capacity), total]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of the given lengths that fill a sequence exactly; rows (a, b, c), c 0 in pairs."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    c = capacity - a - b
    good = (a >= b) & (b >= c) & (c >= 0) & (b > 0)
    a, b, c = a[good], b[good], c[good]
    return np.stack([a, b, c], 1)[have[c]]


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used near the histogram in the least squares sense.

    Accelerated projected gradient descent; each column of the system counts a pattern's lengths.
    Lengths are weighted by 1/sqrt(count), as their counts scatter like that.
    """
    weight = 1.0 / np.maximum(histogram, 1.0)
    used = patterns > 0

    def lengths_used(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), len(histogram))

    spread = lengths_used(np.ones(len(patterns))) * weight
    scale = 1.0 / np.maximum((spread[patterns] * used).sum(1), 1e-12)  # a diagonal bound of A'WA
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(steps):
        miss = (histogram - lengths_used(y)) * weight
        nxt = np.maximum(y + scale * (miss[patterns] * used).sum(1), 0.0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = nxt + (momentum - 1) / faster * (nxt - x)
        x, momentum = nxt, faster
    return x


def best_fit_decreasing(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: sequences with the same contents are one class."""
    classes: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by free space

    def add(contents: tuple[int, ...], free: int, n: int) -> None:
        if n:
            classes[free][contents] = classes[free].get(contents, 0) + n

    for length in range(capacity, 0, -1):
        todo, free = int(histogram[length]), length
        while todo and free <= capacity:
            if free == capacity:  # no open sequence has room: full sequences of this length, and one of the rest
                per = capacity // length
                add((length,) * per, capacity - per * length, todo // per)
                add((length,) * (todo % per), capacity - (todo % per) * length, 1 if todo % per else 0)
                break
            if not classes[free]:
                free += 1
                continue
            contents, n = classes[free].popitem()
            fits = free // length
            full = min(n, todo // fits)
            rest = min(todo - full * fits, fits) if full < n else 0
            add(contents + (length,) * fits, free - fits * length, full)
            if rest:
                add(contents + (length,) * rest, free - rest * length, 1)
            # what was not touched stays
            if n - full - (1 if rest else 0):
                classes[free][contents] = classes[free].get(contents, 0) + n - full - (1 if rest else 0)
            todo -= full * fits + rest
    return [(contents, n) for group in classes for contents, n in group.items()]


def packing_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use each length exactly as often as the histogram has it."""
    left = np.asarray(histogram, np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        repeats = np.floor(fit_repeats(patterns, left.astype(float))).astype(np.int64)
        for n in np.argsort(-repeats, kind="stable"):
            pattern = tuple(int(p) for p in patterns[n] if p)
            times = int(min(repeats[n], *(left[p] // pattern.count(p) for p in pattern)))
            if times > 0:
                for p in pattern:
                    left[p] -= times
                plan.append((pattern, times))
            elif not repeats[n]:
                break
    return plan + best_fit_decreasing(left, capacity)


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, ranks per sequence, first sequence, first offset) of each run of equal lengths."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in dict.fromkeys(pattern):
            per = pattern.count(length)
            rows.append((length, used.get(length, 0), times * per, per, sequence, offset))
            used[length] = used.get(length, 0) + times * per
            offset += per * length
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; pieces must be a written table, as it is read several times."""
    spark = pieces.sparkSession
    buckets = BUCKETS_PER_PARTITION * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = written(dealt.groupBy("length", "bucket").count(), "lengths")  # capacity x buckets rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # capacity rows at most
        histogram[length] = n
    rows = plan_rows(packing_plan(histogram, capacity))
    if not rows:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = spark.createDataFrame(rows, "plan_length long, first_rank long, ranks long, per long, first_sequence long, first_offset long")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    # bases are dealt by the key that the ranks are dealt by already; nothing of them need be broadcast
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("nth", nth).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth"))
    match = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    placed = ranked.join(F.broadcast(plan) if len(rows) <= BROADCAST_PLAN else plan, match)
    run = F.col("rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(run / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.col("length") * (run % F.col("per"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack_pieces(written(document_pieces(docs, tokenizer_file, capacity, end_id), "pieces"), capacity)
