"""What the operators of this subpackage share: the shared folder, written tables and components.

Tables written here go to the folder that the cluster names in ``spark.checkpoint.dir``, so that
they outlive any executor. Where the setting is absent (tests), a temporary folder is made, and
only in local mode.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space: space and the controls from tab to carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: Keys with more rows than this, and with more than one in HOT_SHARE of all rows, are joined apart; at most HOT_SHARE keys can have that.
HOT_ROWS, HOT_SHARE = 1_000, 10_000
#: Tables of at most so many rows have no hot keys to speak of.
FEW_ROWS = 20_000

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="foliomill-")
    return _own_folder


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/foliomill/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, computed once into the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_few(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """As written, for a table of at most so many rows: a file for each FEW_ROWS of them, so that small tables have few files and few tasks."""
    return written(df.coalesce(1 + rows // FEW_ROWS), tag)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until it clashes with no column (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """rows (of a written table) joined with facts, which has one row for each key; how is inner or left.

    Facts of keys that many rows have are broadcast, at most HOT_SHARE of them (in a left join also that
    there are none); so no task gets all rows of such a key. All other keys take an ordinary shuffle join.
    """
    keys = [key] if isinstance(key, str) else key
    n = rows.count()
    if n <= FEW_ROWS:
        return rows.join(facts, keys, how)
    [number] = free_names([*rows.columns, *facts.columns], "rows_of_key")
    counted = rows.groupBy(*keys).agg(F.count("*").alias(number)).where(F.col(number) > max(HOT_ROWS, n // HOT_SHARE))
    often = written(counted.select(*keys).na.drop(), "often")
    if often.isEmpty():
        return rows.join(facts, keys, how)
    hot = written(facts.join(F.broadcast(often), keys, "left_semi"), "hot")
    rest = rows.join(F.broadcast(often), keys, "left_anti").join(facts, keys, how)
    return rows.join(F.broadcast(often), keys, "left_semi").join(F.broadcast(hot), keys, how).unionByName(rest)


def only_rows(docs: DataFrame, digest: Column, chosen: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each row of chosen (doc_id, digest, copies): docs has copies such rows."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    name, one, two, many, row = free_names(docs.columns, "own_digest", "chosen_id", "chosen_digest", "chosen_copies", "whole_row")
    chosen = written(chosen.select(F.col("doc_id").alias(one), F.col("digest").alias(two), F.col("copies").alias(many)), "chosen")
    marked = docs.withColumn(name, digest)
    match = F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(name) == F.col(two))
    if chosen.where(F.col(many) > 1).isEmpty():
        return marked.join(chosen, match, "left_semi").select(*own)
    found = marked.join(chosen, match)
    once = found.where(F.col(many) == 1).select(*own)
    merged = found.where(F.col(many) > 1).groupBy(one, two).agg(F.first(F.struct(*own)).alias(row))
    return once.unionByName(merged.select(f"{row}.*"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (u, v) of longs.

    Returns (node, root): one row for each node that has a link, root being the same for, and only
    for, nodes that reach each other. Each round every node hooks onto the neighbour (or itself)
    with the least hash of that round, and links are carried over to the hooked nodes, so the graph
    shrinks by a constant factor and long chains take logarithmically many rounds. Each round's
    tables are written to the shared folder. Nothing is gathered on the driver but row counts.
    """
    spark = links.sparkSession
    both = links.where("u <> v").select("u", "v")
    live = written(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    mapping, most = None, 0
    for turn in range(rounds):
        n = live.count()
        most = most or n
        if not n:
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        hooks = written_few(
            live.groupBy("u").agg(F.min(rank("v")).alias("best")).select("u", F.least(F.col("best"), rank("u"))["id"].alias("to")),
            "hooks",
            n,
        )
        # one more hop along the hooks: a -> b -> c becomes a -> c
        nxt = hooks.select(F.col("u").alias("to"), F.col("to").alias("further"))
        hooks = join_hot(hooks, nxt, "to", "left").select("u", F.coalesce("further", "to").alias("to"))
        hooks = written_few(hooks, "hops", n)
        if mapping is None:
            mapping = hooks.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            step = hooks.select(F.col("u").alias("root"), "to")
            mapping = join_hot(mapping, step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        mapping = written_few(mapping, "roots", most)
        left = hooks.select("u", F.col("to").alias("u2"))
        right = hooks.select(F.col("u").alias("v"), F.col("to").alias("v2"))
        half = written_few(join_hot(live, left, "u"), "half", n)
        live = written_few(join_hot(half, right, "v").where("u2 <> v2").select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct(), "links", n)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if mapping is None:
        return spark.createDataFrame([], "node long, root long")
    return mapping
