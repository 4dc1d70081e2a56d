"""SentencePiece round trips, conversation tries and centroid clusters against plain implementations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from foliomill.llm import bit_planes, common, piece_chunks, prefix_trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(seed, n):
    rng = random.Random(seed)
    letters = list("abcdetheinanr  \n\t▁é日本語🙂'.,-_<>/s01\r\x00​ ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(n)]
    texts += [None, "", " ", "▁", "   x", "q" * 3000, "ab" * 2000, "日本" * 1000, " " * 500, "x" + " " * 77 + "y", "\n" * 60, "<s></s><unk><0x0A>", "w " * 20_000]
    return [*texts, "".join(rng.choice("theinaros") for _ in range(20_000)), texts[0]]


def test_pieces_equal_the_library(spark, library):
    rows = list(enumerate(odd_texts(1, 400))) + [(None, "a b"), (0, "again")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, ids_sha256 string, n_tokens int, Ids int").repartition(3)
    got = piece_chunks.round_trip_digests(docs, MODEL).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = piece_chunks.encode_documents(docs, MODEL)
    assert sorted((r.doc_id, r.ids) for r in coded.collect() if r.doc_id) == sorted((i, library.encode(t or "")) for i, t in rows if i)
    back = {r.doc_id: r.text for r in piece_chunks.decode_documents(coded, MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows if i)


def test_long_texts_in_blocks(library, monkeypatch):
    monkeypatch.setattr(piece_chunks, "BLOCK_CHARACTERS", 50)
    texts = odd_texts(2, 200)
    for text, ids in zip(texts, piece_chunks.vocabulary(MODEL).encode(texts)):
        assert ids.tolist() == library.encode(text or "")


@pytest.mark.parametrize("cached", [0, 40])
def test_chunks_are_forgotten_and_found_again(library, monkeypatch, cached):
    monkeypatch.setattr(piece_chunks, "CACHED_CHUNKS", cached)
    vocabulary = piece_chunks.PieceVocabulary(MODEL)
    for text in odd_texts(3, 60):
        assert vocabulary.encode([text, "the in an", text])[2].tolist() == library.encode(text or "")


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        raw = f.read()
    crossing = b"\n" + bytes([len(p := "\n\x07a▁bcd".encode())]) + p
    (tmp_path / "m").write_bytes(crossing + raw)
    with pytest.raises(ValueError, match="crosses"):
        piece_chunks.PieceVocabulary(str(tmp_path / "m"))


def test_no_documents_no_pieces(spark):
    assert piece_chunks.round_trip_digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def plain_trie(rows):
    """Nodes of rows (conv_id, turn, role, text), as sets of tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        ends[seq].add(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, cs in members.items():
        under, todo = [], [p]
        while todo:
            under.append(todo.pop())
            todo += kids[under[-1]]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in under), saved, digest))
    return sorted(out, key=str)


def conversations(seed, n=150):
    rng = random.Random(seed)
    texts = ["", "a", "b c", "é d  e", None, "w " * 30]
    rows = []
    for c in rng.sample(range(400), n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 40])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(texts[: rng.choice([1, 2, 6])])))
    return rows + [(None, 1, "user", "nobody's"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (7, 3, "user", "other")] + [(1000 + k, t, "user", f"hot {t}") for k in range(90) for t in range(4)]


@pytest.mark.parametrize("shard, bits", [(32_768, 12), (30, 2), (4, 1), (200, 3)])
def test_tries_equal_plain_sets(spark, monkeypatch, shard, bits):
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER_BITS", bits)
    monkeypatch.setattr(prefix_trie, "UPPER_ROWS", 12)
    rows = conversations(shard)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, N int").repartition(5)
    assert sorted(map(tuple, prefix_trie.prefix_nodes(turns, shard).collect()), key=str) == plain_trie(rows)


def test_hot_open_parents_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(c, t, "user", f"{'same' if t == 0 else c} {t}") for c in range(0, 4000, 20) for t in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_nodes(turns, 20).collect()), key=str) == plain_trie(rows)


def test_long_conversations(spark):
    rows = [(c, t, "user", f"{t if t < 900 else (c, t)}") for c in (20, 40, 60) for t in range(1000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = prefix_trie.prefix_nodes(turns, 500).collect()
    assert len(nodes) == 1 + 900 + 3 * 100 and {r.n_leaves for r in nodes} == {1, 3}


def test_double_arrays_hold_what_is_put_in():
    rng = random.Random(4)
    seqs = sorted({tuple(rng.randrange(rng.choice([2, 50])) for _ in range(rng.randrange(6))) for _ in range(500)})
    flat = np.array([t for s in seqs for t in s], np.int64)
    trie = prefix_trie.DoubleArray(flat, np.array([len(s) for s in seqs]))
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes)
    for p in prefixes:
        at = 0
        for t in p:
            to = trie.base[at] + t
            assert trie.check[to] == at
            at = to
    nodes = {}
    for d, rows, at in trie.follow():
        for r, s in zip(rows.tolist(), at.tolist()):
            assert nodes.setdefault(s, seqs[r][:d]) == seqs[r][:d]


def test_no_conversations_no_nodes(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def plain_clusters(rows, k, rounds, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = sum(s for s, _ in found)
    return sorted(
        ((i, n, s, sum(t for t, m in found if m == n), total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (s, n) in zip(kept, found)), key=str
    )


@pytest.mark.parametrize("seed, spread", [(1, 0.3), (2, 20.0), (3, 1e5)])
def test_clusters_equal_plain_rounds(spark, seed, spread):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=64) * spread + (i % 5)).tolist()) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # a hot vector
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[9][1]), (900, None), (901, []), (902, [0.0] * 63), (903, [None] + [0.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [0.0] * 64), (907, [-0.0] * 64)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, Cluster int, n int").repartition(3)
    got = bit_planes.cluster_vectors(frame, k=7, rounds=3, scale=64)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 7, 3, 64)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, bit_planes.cluster_vectors(frame).collect()), key=str) == plain_clusters(rows, 16, 3, 64)
    assert bit_planes.cluster_vectors(frame.where("false")).collect() == []


def test_components_beyond_a_long_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="more than 27 bits"):
        bit_planes.cluster_vectors(frame).collect()


def test_popcounts_are_dot_products():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-5, 5, (9, 64))
    pa, pb = bit_planes.pack(a, 28), bit_planes.pack(b, 4)
    assert (bit_planes.dots(pa, pb) == a @ b.T).all() and (bit_planes.squares(pa) == (a * a).sum(axis=1)).all()
    cluster = rng.integers(0, 3, 50)
    assert (bit_planes.sums_of_clusters(pa, cluster, 4) == np.array([a[cluster == n].sum(axis=0) for n in range(4)])).all()
