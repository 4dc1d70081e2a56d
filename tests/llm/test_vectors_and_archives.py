"""Vectors and archives against brute force, with nulls, repeats, odd values and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import common, simhash_bk, vector_graph, warc_chain


def cloud(seed, n=300, dims=16):
    rng = np.random.default_rng(seed)
    loose = rng.normal(size=(n, dims))
    tight = rng.normal(size=dims) + rng.normal(size=(80, dims)) * 0.05
    chain = np.stack([np.cos(np.arange(40) * 0.2), np.sin(np.arange(40) * 0.2), *np.zeros((dims - 2, 40))], 1)
    return np.concatenate([loose, tight, chain, tight[:20], tight[:5] * 3]).astype(np.float32)


@pytest.mark.parametrize("block", [2048, 80])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    """One shard, and a tree of shards."""
    monkeypatch.setattr(vector_graph, "BLOCK", block)
    vectors = cloud(1)
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 7, []]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(vectors)] + [(900 + n, v, 1, "x") for n, v in enumerate(odd)]
    got = {r.vec_id: r for r in vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, shard string")).collect()}
    assert {r.recall for r in got.values()} == {got[0].recall} and got[0].recall >= 0.95
    u = vector_graph.unit(vectors.astype(np.float64))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    least = vector_graph.stars(len(u), *np.nonzero(near))
    found = sum(got[i].n_links for i in range(len(u)))
    assert len(got) == len(rows) and 0.98 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(u)))
    assert np.mean([got[i].component_id == least[i] for i in range(len(u))]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(u)))
    for n in range(len(odd)):
        assert (got[900 + n].n_links, got[900 + n].component_id, got[900 + n].kept) == (0, 900 + n, True)


def test_all_pairs_in_blocks(spark):
    vectors = cloud(2)[250:400]
    rows = [(n, 1 + n % 2, 16, v.tolist()) for n, v in enumerate(vectors)]
    found = vector_graph.exact_links(spark.createDataFrame(rows, "node long, copies long, dims int, embedding array<float>"), block=40).collect()
    u = vector_graph.unit(vectors)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    copies = 1 + np.arange(len(u)) % 2
    assert all(sum(r.links for r in found if r.node == n) == near[n] @ copies for n in range(len(u)))
    assert (vector_graph.stars(len(u), np.array([r.node for r in found]), np.array([r.reach for r in found])) == vector_graph.stars(len(u), *np.nonzero(near))).all()


def test_lengths_have_their_own_index(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [2e200, 0.0, 1e199]), (6, [1e-200, 1e-202, 0.0]), (None, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False)}


def test_too_many_vectors_for_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "EXACT_NODES", 2)
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="of the links"):
        vector_graph.near_vectors(rows, target=1.1)


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_graph.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert vector_graph.near_vectors(spark.createDataFrame([(1, None)], schema)).first().kept
    rows = vector_graph.near_vectors(spark.createDataFrame([(7, [1.0, 2.0]), (7, [1.0, 2.0]), (9, [2.0, 4.0])], schema)).collect()
    assert [r.n_links for r in rows] == [2, 2, 2] and {r.component_id for r in rows} == {7}


def test_graph_search_reaches_what_is_near():
    u = vector_graph.unit(cloud(5).astype(np.float64))
    lists = vector_graph.build_graph(u)
    padded = np.full((len(u), max(map(len, lists))), -1)
    for row, near in zip(padded, lists):
        row[: len(near)] = near
    q, v = vector_graph.range_search(u, padded, u)
    assert len(set(zip(q.tolist(), v.tolist()))) == len(q) and (np.einsum("ij,ij->i", u[q], u[v]) >= 0.95).all()
    assert len(q) >= 0.98 * (u @ u.T >= 0.95).sum()


def test_robust_pruning_drops_what_a_kept_one_stands_before():
    points = vector_graph.unit(np.array([[1, 0.0], [1, 0.1], [1, 0.2], [1, -0.3]]))
    sims = points @ points.T
    kept = vector_graph.robust_prune(np.array([[1, 2, 3]] * 4), sims, 3)[0].tolist()
    assert kept == [1, 3, -1]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(n, n + 1) for n in range(1000, 1200)] + [(2000, n) for n in range(2001, 2100)] + [(5, 5)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[top(a)] = top(b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(got[x], top(x)) for x in nodes}) == len(set(got.values())) == len({top(x) for x in nodes})


@pytest.mark.parametrize("few", [20_000, 5])
def test_components_grow_from_their_roots(spark, monkeypatch, few):
    """Links that come later join components as if all had come at once."""
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = np.random.default_rng(11)
    links = [(int(a) * 7 - 900, int(b) * 7 - 900) for a, b in rng.integers(0, 300, (260, 2))]
    frames = [common.written(spark.createDataFrame(links[a:b], "u long, v long"), "some") for a, b in ((0, 120), (120, 121), (121, 260))]
    roots = common.connected_components(frames[0])
    for more in frames[1:]:
        roots = simhash_bk.merged_roots(roots, more)
    sets = lambda df: {frozenset(r.nodes) for r in df.groupBy("root").agg(F.collect_set("node").alias("nodes")).collect()}
    whole = common.connected_components(spark.createDataFrame(links, "u long, v long"))
    assert sets(roots) == sets(whole) and roots.count() == whole.count()


def pages():
    magic = warc_chain.MAGIC
    fake = f"a{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n{magic}z"
    rows = [(1, "u", "x" * 150), (2, None, "x" * 150), (3, "u\r\nEvil: 1", None), (4, "é", fake), (5, "u", magic), (6, "u", "x" * 150), (None, "u", "y" * 300 + "é" * 400), (7, "q", magic * 40), (8, "u", "short"), (9, "u", "short")]
    return rows + [(i, "u", f"doc {i} " + "é" * i) for i in range(10, 70)] + [(70, "u", fake * 3), (71, "u", fake * 3)]


@pytest.mark.parametrize("split", ["700", "1m"])
def test_archives_round_trip(spark, split):
    rows = pages()
    frame = spark.createDataFrame([(*r, "c", "f") for r in rows], "page_id long, url string, html string, digest string, file string").coalesce(1)
    path = common.fresh_path(spark, "warc")
    warc_chain.write_archives(frame, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc_chain.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        body, r = (html or "").encode(), by[i]
        again = len(body) >= 100 and first[html or ""] != i
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if again else ("response", None)) and r.verified is not False


@pytest.mark.parametrize("few", [20_000, 3])
def test_archives_of_archives(spark, monkeypatch, few):
    """Payloads that are archives themselves, read by scans that cut the files differently, in small spans."""
    monkeypatch.setattr(warc_chain, "SPAN", 300)
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    record = lambda i, n: f"{warc_chain.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n" + "y" * n + "\r\n\r\n"
    rows = [(i, "u", "".join(record(1000 + k, (i * k) % 50) for k in range(i)) + f"tail {i}") for i in range(1, 40)]
    path = common.fresh_path(spark, "warc")
    warc_chain.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = common.written(warc_chain.candidates(spark, path), "candidates")
        kept = common.written(warc_chain.reachable(found), "records")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "33333")
        mended = {r.start: r.mended for r in warc_chain._mended(spark, path, found, kept.where("digest IS NULL AND length IS NOT NULL")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.page_id: r.digest or mended[r.start] for r in kept.collect()}
    assert got == {i: hashlib.sha256(html.encode()).hexdigest() for i, _, html in rows}


def test_what_follows_a_broken_record_is_left_out(spark, tmp_path):
    head = lambda i, n: f"{warc_chain.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((head(1, 3) + "abc\r\n\r\n" + head(2, 9) + "abc\r\n\r\n" + head(3, 3) + "abc\r\n\r\n").encode())
    (tmp_path / "b.warc").write_bytes(b"junk")
    assert sorted(r.page_id for r in warc_chain.read_archives(spark, f"file://{tmp_path}").collect()) == [1, 2]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_apart(spark, monkeypatch, how):
    """The same rows as an ordinary join: hot keys with and without facts, null keys, several keys."""
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = spark.createDataFrame([(k % 3 if k % 2 else None if k % 7 == 0 else k, "ab"[k % 2], k) for k in range(400)], "k long, s string, at long")
    facts = spark.createDataFrame([(0, "b", "x"), (1, "b", "y"), (4, "a", None), (999, "a", "z")], "k long, s string, fact string")
    for key in ("k", ["k", "s"]):
        own = facts.drop("s") if key == "k" else facts
        want = rows.join(own, key, how)
        got = common.join_hot(common.written(rows, "rows"), own, key, how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_pages(spark):
    assert warc_chain.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
