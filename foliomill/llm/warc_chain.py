"""WARC archives: writing page records, and reading them back by boundary-chain verification.

Writing. Pages with equal payloads of at least MIN_SHARED bytes share one response record, that of
the least page_id; the others become revisit records that refer to it. Digests are grouped on slim
rows; payloads are not shuffled while the table of repeated digests is within a checked bound.

Reading. Archives are split like any text: every piece between two magics is a candidate record, and
its header's length gives the offset of the record after it. Offsets follow from the pieces' sizes
(a sum within each block, and one over the blocks of a file). Each block's task shortens its
candidates' links to their exits from the block by pointer jumping; joins then jump along the exits
from the start of each file, doubling the reach each round. Only candidates on that chain are
records, so a magic inside a payload is no boundary; payloads that hold one are put together again.

Defined results: null html is an empty payload; a null url leaves out its header; a null page_id is
written as an empty id and read as null. Of rows that repeat a page_id, each has its record, and all
rows with the least page_id of a payload are responses. What follows a broken record in a file is
unreachable and left out. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm.common import HOT_ROWS, HOT_SHARE, fresh_path, join_hot, written

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
MIN_SHARED = 100
#: Repeated digests up to which their table is broadcast (some 10 MB); beyond, payloads are shuffled.
BROADCAST_DIGESTS = 100_000
#: Bytes of a file whose candidates one window places among the records that hold a magic.
SPAN = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def shared_payloads(pages: DataFrame) -> DataFrame:
    """(payload_digest, first_id, pages) of the payloads that more than one page has."""
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("size"))
    shared = slim.where(F.col("size") >= MIN_SHARED).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
    return shared.where("pages > 1")


def records(pages: DataFrame) -> DataFrame:
    """One column, record: each page's whole record but its last line end."""
    html = F.coalesce(F.col("html"), F.lit(""))
    shared = written(shared_payloads(pages), "shared")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"))
    if shared.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(shared), "payload_digest", "left")
    else:  # digests that many pages have are broadcast all the same: at most HOT_SHARE of them
        often = F.col("pages") > F.lit(max(HOT_ROWS, pages.count() // HOT_SHARE))
        hot = F.broadcast(shared.where(often))
        rest = rows.join(F.broadcast(shared.where(often).select("payload_digest")), "payload_digest", "left_anti")
        rows = rows.join(hot, "payload_digest").unionByName(rest.join(shared.where(~often), "payload_digest", "left"))
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    size = F.octet_length("html")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", size.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", page("first_id")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """WARC files of the pages under path, one per task."""
    records(pages).write.option("lineSep", "\r\n").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text after each magic, with its file, block and order in the block."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value"
    )


#: What tells the contents of pieces apart.
CONTENT = ["size", "content", "more"]


def _content() -> list[Column]:
    return [F.octet_length("value").alias("size"), F.xxhash64("value").alias("content"), F.hash("value").alias("more")]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Slim rows, one per magic: file, block, nth, start, next (its successor's offset), header fields, digest."""
    head = F.substring_index("value", GAP, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: *([^\r\n]*)", 1), F.lit(""))
    rows = _pieces(spark, path).withColumn("head", head).withColumn("size", F.octet_length("value")).withColumn("head_size", F.octet_length("head"))
    number = lambda text: F.regexp_extract(text, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    rows = rows.withColumn("length", F.when(F.col("head_size") < F.col("size"), field("Content-Length").try_cast("long")))
    body = F.col("value").cast("binary").substr(F.col("head_size") + len(GAP) + 1, F.col("length").cast("int"))
    whole = F.col("head_size") + len(GAP) + F.col("length") <= F.col("size")
    slim = rows.select(
        "file", "block", "nth", *_content(), "head_size", "length",
        field("WARC-Type").alias("record_type"),
        number(F.coalesce(field("WARC-Record-ID"), F.lit(""))).alias("page_id"),
        number(F.coalesce(field("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
        F.regexp_extract(F.coalesce(field("WARC-Payload-Digest"), F.lit("")), r"sha256:(\w+)", 1).alias("said_digest"),
        field("X-Payload-Length").try_cast("long").alias("said_bytes"),
        F.when(whole, F.sha2(body, 256)).alias("digest"),
    )
    slim = written(slim, "pieces")
    taken = F.col("size") + len(MAGIC)
    blocks = slim.groupBy("file", "block").agg(F.sum(taken).alias("taken"))
    before = F.sum("taken").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    upto = F.sum(taken).over(Window.partitionBy("file", "block").orderBy("nth"))
    start = (F.col("base") + F.col("upto") - taken - len(MAGIC)).alias("start")
    placed = slim.withColumn("upto", upto).join(bases, ["file", "block"]).select("*", start)
    step = len(MAGIC) + F.col("head_size") + len(GAP) + F.col("length") + len(GAP)
    # what stands before a file's first magic is no candidate
    return placed.where("start >= 0").select(*[c for c in slim.columns], "start", (F.col("start") + step).alias("next"))


def _chain(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Of each candidate of a block (sorted by start) the index of the next one in the block, or its own."""
    at = np.minimum(np.searchsorted(starts, nexts), len(starts) - 1)
    return np.where(starts[at] == nexts, at, np.arange(len(starts)))


def block_exits(block: pd.DataFrame) -> pd.DataFrame:
    """Each candidate's link shortened to where its chain leaves the block, by pointer jumping."""
    block = block.sort_values("start", kind="stable")
    starts, nexts = block["start"].to_numpy(), block["next"].fillna(-1).to_numpy(np.int64)
    to = _chain(starts, nexts)
    while (to[to] != to).any():
        to = to[to]
    return pd.DataFrame({"file": block["file"].to_numpy(), "block": block["block"].to_numpy(), "start": starts, "exit": nexts[to]})


def reached_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entry reaches, by pointer jumping from the entry."""
    block = block.sort_values("start", kind="stable")
    starts = block["start"].to_numpy()
    to = _chain(starts, block["next"].fillna(-1).to_numpy(np.int64))
    reach = starts == block["entry"].to_numpy()
    while True:
        more = reach.copy()
        more[to[reach]] = True
        to = to[to]
        if (more == reach).all():
            return block[reach].drop(columns="entry")
        reach = more


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file; found must be a written table."""
    slim = found.select("file", "block", "start", "next")
    exits = written(slim.groupBy("file", "block").applyInPandas(block_exits, "file string, block long, start long, exit long"), "exits")
    targets = exits.select("file", F.col("exit").alias("start")).distinct()
    first = exits.where("start = 0").select("file", "start")
    jumps = written(exits.join(targets.union(first).distinct(), ["file", "start"], "left_semi"), "jumps")
    entries, reach = jumps.select("file", "block", "start"), first
    blocks = exits.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    hops = jumps.select("file", "start", "exit")
    for _ in range(max(0, int(blocks) - 1).bit_length()):
        reach = written(reach.union(reach.join(hops, ["file", "start"]).select("file", F.col("exit").alias("start"))).distinct(), "reach")
        further = hops.select("file", F.col("start").alias("exit"), F.col("exit").alias("further"))
        hops = written(hops.join(further, ["file", "exit"]).select("file", "start", F.col("further").alias("exit")), "hops")
    entered = entries.join(reach, ["file", "start"], "left_semi").select("file", "block", F.col("start").alias("entry"))
    inside = found.join(entered, ["file", "block"])
    schema = ", ".join(f"{n} {t}" for n, t in found.dtypes)
    return inside.select(*found.columns, "entry").groupBy("file", "block").applyInPandas(reached_in_block, schema)


def _mended(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, start, digest) of the records whose payloads hold a magic.

    Records on the chain do not overlap, so a candidate lies in the last of them that starts before it,
    if in any. A record is repeated in each span of the file that it reaches, and each span is searched
    on its own. The texts of candidates are found again by hashes of their contents, so the second scan
    need not cut the files as the first did.
    """
    spans = F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("next") - 1) / SPAN)))
    record = F.struct(F.col("start").alias("record"), F.col("next").alias("stop"), F.col("head_size").alias("head"), F.col("length").alias("wanted"))
    opens = broken.select("file", spans.alias("span"), F.greatest(F.col("start"), F.col("span") * SPAN).alias("start"), F.lit(0).alias("kind"), record.alias("record"))
    held = found.select("file", F.floor(F.col("start") / SPAN).alias("span"), "start", F.lit(1).alias("kind"), F.struct(*CONTENT).alias("content"))
    rows = opens.unionByName(held, allowMissingColumns=True)
    last = F.last("record", ignorenulls=True).over(Window.partitionBy("file", "span").orderBy("start", "kind"))
    parts = rows.withColumn("record", last).where((F.col("kind") == 1) & (F.col("start") < F.col("record.stop")))
    parts = written(parts.select("file", "start", "record.*", "content.*"), "parts")
    wanted = parts.select(*CONTENT).distinct()
    pieces = _pieces(spark, path).select("value", *_content())
    texts = pieces.join(F.broadcast(wanted) if parts.count() <= BROADCAST_DIGESTS else wanted, CONTENT, "left_semi").dropDuplicates(CONTENT)
    # a record that stands in very many archives of archives is one content
    joined = join_hot(parts, texts, CONTENT).groupBy("file", "record", "head", "wanted").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["value"]), MAGIC).cast("binary")
    body = text.substr(F.col("head") + len(GAP) + 1, F.col("wanted").cast("int"))
    return joined.select("file", F.col("record").alias("start"), F.when(F.octet_length(body) == F.col("wanted"), F.sha2(body, 256)).alias("mended"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    verified tells that a response's payload has the digest and size that its header gives.
    """
    found = written(candidates(spark, path), "candidates")
    kept = written(reachable(found), "records")
    broken = kept.where("digest IS NULL AND length IS NOT NULL")
    if not broken.isEmpty():
        kept = kept.join(_mended(spark, path, found, broken), ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "mended"))
    revisit = F.col("record_type") == "revisit"
    return kept.select(
        "page_id",
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(~revisit, F.coalesce((F.col("digest") == F.col("said_digest")) & (F.col("length") == F.col("said_bytes")), F.lit(False))).alias("verified"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """The pages written to archives in the shared folder and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
