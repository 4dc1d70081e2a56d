"""Operators on texts against plain implementations, with nulls, empties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomill.llm import bpe, brown_lm, common, exact_dedup, license_diagonals, pattern_packing, quality_cnn, simhash_bk, token_attribution

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, digest string, node long, key string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, "k") for i, t in rows], SCHEMA)


def sample(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "été", "the", "of", "GNU", "General", "Public", "License", "MIT", "mit", "license.", "cc-by", "Apache", "日本", "\x0bz", "x" * 40, "<|endoftext|>", "don't", "12", "🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    texts += [None, "", " \n\t", texts[0], texts[0] + " ", texts[0].replace(" ", "\n"), "one", "a b", "a b c d", "w " * 30_000, "q" * 20_000]
    return list(enumerate(texts)) + [(0, texts[0])]


ROWS = sample(60, 3)


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(frame(spark, ROWS), support=0.05).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append((-len(t or ""), i))
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = by_hash[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == min(members)[1] and (not r.kept or r.doc_id == r.keep_id)


def test_keeping_one_of_equals_keeps_columns(spark):
    docs = frame(spark, ROWS)
    kept = exact_dedup.keep_one_of_equals(docs)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(norm(r.text) for r in kept.collect()) == Counter({norm(t): 1 for _, t in ROWS})


def test_heavy_digests_are_verified(spark):
    docs = frame(spark, [(i, "hot" if i % 3 else f"cold {i}") for i in range(300)])
    heavy = exact_dedup.frequent_digests(exact_dedup.slim_rows(docs), 0.1).collect()
    assert [(r.group_size, r.keep_id) for r in heavy] == [(200, 1)]
    assert sum(r.kept for r in exact_dedup.exact_groups(docs, 0.1).collect()) == 101


def plain_bases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(n, label) for phrase, label in license_diagonals.PHRASES for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_license_places(spark):
    notice = " ".join(license_diagonals.NOTICES[0][0].split())
    rows = [*ROWS, (900, "x " + notice.title() + " y"), (901, notice.replace("granted", "granted here and")), (902, "MIT License mit license"), (903, "of the to and " * 50), (904, "GNU General Public\nLicense; CC BY")]
    got = license_diagonals.scan_licenses(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    plain = defaultdict(list)
    for i, t in rows:
        plain[i].append(plain_bases(t))
    for r in got:
        n, places = plain[r.doc_id][0]
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[900] == labels[901] == "mit" and labels[903] == "" and labels[904] == "cc-by,gpl"


def plain_labels(text, notices):
    """Labels and score by a plain vote of each notice's triples on each diagonal, merged as the operator merges them."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = {x for _, x in plain_bases(text)[1]}, 1.0 if plain_bases(text)[1] else 0.0
    triples = [tuple(words[n : n + 3]) for n in range(len(words) - 2)]
    for notice, label in notices:
        own = [tuple(notice.split()[n : n + 3]) for n in range(len(notice.split()) - 2)]
        votes = sorted((p - at, at) for p, t in enumerate(triples) for at, o in enumerate(own) if t == o)
        bands = []
        for d, at in votes:
            if not bands or d - bands[-1][-1][0] > license_diagonals.SLACK:
                bands.append([])
            bands[-1].append((d, at))
        for band in bands:
            share = len({at for _, at in band}) / len(own)
            span = max(d + at for d, at in band) + 3 - min(d + at for d, at in band)
            if share >= license_diagonals.COVERAGE and span <= len(notice.split()) + 2 * license_diagonals.SLACK:
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def test_notices_by_a_plain_vote(spark):
    rng = random.Random(14)
    long = " ".join(f"clause{rng.randrange(40)}" for _ in range(200))
    notices = [*license_diagonals.NOTICES, (long, "long"), ("of the to of the to of the", "odd"), ("too short", "never")]
    rows = []
    for i in range(150):
        words = rng.choice(notices)[0].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["new"], ["of", "the"]])
        rows.append((i, " ".join(["of the to"] * rng.randrange(4) + words + rng.choice(notices)[0].split()[: rng.randrange(20)])))
    rows += [(900, None), (901, long + " " + long), (902, "of the to " * 2000)]
    table = spark.createDataFrame([*notices, notices[0]], "text string, label string")
    found = {r.doc_id: r for r in license_diagonals.scan_licenses(frame(spark, rows), table).collect()}
    for i, text in rows:
        labels, score = plain_labels(text, notices)
        assert found[i].labels == labels and math.isclose(found[i].score, score), (i, text)
    assert {"long", "odd", "mit", ""} <= {r.labels for r in found.values()}


def test_notices_outside_ascii_and_in_turns(spark, monkeypatch):
    """Texts and notices are lower-cased alike; notices that are broadcast in several turns give what one turn gives."""
    notice = "Été über alles license text ÉCOLE ΣΑΣ İstanbul"
    texts = [notice, notice.lower(), "x " + notice + " of the of the MIT License", "of the " * 50, None, "", "GNU General Public License"]
    notices = spark.createDataFrame([(notice, "odd"), ("of the mit license", "own")], "text string, label string")
    docs = frame(spark, list(enumerate(texts)))
    whole = {r.doc_id: r for r in license_diagonals.scan_licenses(docs, notices).collect()}
    assert "odd" in whole[0].labels and "odd" in whole[2].labels and whole[2].labels == "mit,odd,own"
    monkeypatch.setattr(license_diagonals, "BROADCAST_POSITIONS", 5)
    assert {r.doc_id: r for r in license_diagonals.scan_licenses(docs, notices).collect()} == whole


def test_bpe_equals_the_library(spark, library):
    got = bpe.round_trip_digests(frame(spark, ROWS), PATH).collect()
    texts = defaultdict(list)
    for i, t in ROWS:
        texts[i].append(t or "")
    for r in got:
        ids = library.encode(texts[r.doc_id][0], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_texts(library):
    rng = random.Random(1)
    pool = [*map(chr, range(32, 127)), *map(chr, range(0x80, 0x250)), "\n", "  ", "\x1c", "\x85", "²", "Ⅷ", "٣", "ि", "　", "😀", "𝟘", "𐐀", "'ll", "'S"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 80))) for _ in range(500)] + ["aaaa" * 900, "\n\n\n a", "é" * 3000, " " * 50, "".join(rng.choices("abcdeft", k=20_000))]
    ours = bpe.vocabulary(PATH)
    for text, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert ours.decode(np.array([100, 250, 160, 50256], "<u4").tobytes()) == library.decode([100, 250, 160, 50256], skip_special_tokens=False)


def test_long_texts_are_cut_into_blocks(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARACTERS", 16)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\x1c ", "it's", "we'll", "'", "é", "字", "12", "...", "<|endoftext|>", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(1000)]
    texts += [" ".join(["a text of over sixty kilobytes,"] * 3000), "x" * 70_000]
    for text, ids in zip(texts, bpe.ByteBpe(PATH).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoded_arrays(spark, library):
    rows = {r.doc_id: r.ids for r in bpe.encode_documents(frame(spark, ROWS[1:12]), PATH).collect()}
    assert all(rows[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in ROWS[1:12])


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_token_attribution(spark, library, rule):
    rng = random.Random(4)
    rows = [(i, t) for i, t in ROWS[:70] if t]
    spans = {i: sorted(rng.sample(range(len(t) + 1), min(4, len(t) + 1))) for i, t in rows}
    docs = spark.createDataFrame([(i, t, [(a, b) for a, b in zip(spans[i], spans[i][1:])]) for i, t in rows], "doc_id long, text string, fields array<struct<start:int,stop:int>>")
    got = defaultdict(lambda: defaultdict(float))
    for r in token_attribution.section_tokens(docs, PATH, rule, "fields").collect():
        got[r.doc_id][r.start] += r.n_tokens
    ours = bpe.vocabulary(PATH)
    for i, text in rows:
        own = defaultdict(float)
        _, starts = token_attribution.cover([(a, b) for a, b in zip(spans[i], spans[i][1:])], len(text))
        edges = [*starts.tolist(), len(text)]
        char_of_byte, at = [c for c, letter in enumerate(text) for _ in letter.encode()], 0
        for token in library.encode(text, add_special_tokens=False).ids:
            size = len(ours.token_bytes[token])
            chars = sorted(set(char_of_byte[at : at + size]))
            share = Counter(next(n for n in range(len(edges) - 1) if edges[n] <= c < edges[n + 1]) for c in chars)
            if rule == "start":
                own[edges[min(share)]] += 1
            elif rule == "largest":
                own[edges[max(sorted(share), key=lambda n: share[n])]] += 1
            else:
                for n, k in share.items():
                    own[edges[n]] += k / len(chars)
            at += size
        assert {k: round(v, 6) for k, v in own.items() if v} == {k: round(v, 6) for k, v in got[i].items() if v}
        assert math.isclose(sum(got[i].values()), len(library.encode(text, add_special_tokens=False).ids))


def test_lines_are_sections_and_empty_texts_have_one(spark):
    rows = token_attribution.section_tokens(frame(spark, [(1, "a\n\nb"), (2, None), (3, "x\n")]), PATH).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.section, r.start, r.stop) for r in rows] == [(1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 3, 4), (2, 0, 0, 0), (3, 0, 0, 2)]
    docs = spark.createDataFrame([("title", None, "body")], "a string, b string, c string")
    text, spans = token_attribution.fields_as_text(["a", "b", "c"])
    row = docs.select(text.alias("t"), spans.alias("s")).first()
    assert row.t == "title\n\nbody" and [row.t[x.start : x.stop] for x in row.s] == ["title", "", "body"]


def test_packing(spark, library):
    rows = ROWS * 3
    got = pattern_packing.pack_documents(frame(spark, rows), PATH).collect()
    sequences, pieces = defaultdict(list), Counter()
    texts = dict((i, t or "") for i, t in ROWS)
    for r in got:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 1024)
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    repeats = Counter(i for i, _ in rows)
    assert all(n == repeats[i] * (len(library.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in pieces.items())


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_each_length_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(1025, np.int64)
    lengths = rng.integers(1, 1025, 5000) if seed < 2 else np.minimum(1024, rng.lognormal(5, 1, 5000).astype(int) + 1)
    np.add.at(histogram, lengths, 1)
    plan = pattern_packing.packing_plan(histogram)
    used = np.zeros(1025, np.int64)
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= 1024
        for p in pattern:
            used[p] += times
    assert (used == histogram).all()
    bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert sum(t for _, t in plan) <= 1.02 * bound + 2


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [*ROWS]
    for i in range(40):
        words = list(base)
        for _ in range(i // 8):
            words[rng.randrange(400)] = "changed"
        rows.append((1000 + i, " ".join(words)))
    got = simhash_bk.near_duplicates(frame(spark, rows)).collect()
    prints = {}
    for i, t in rows:
        prints.setdefault(i, plain_fingerprint(t))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == top(r.doc_id)
    assert any(r.doc_id != r.component_id for r in got if r.doc_id >= 1000)


def test_spark_and_xxhash_agree(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("été a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("été a b c".encode(), 42)


@pytest.mark.parametrize("block", [3, 4096])
def test_shards_lose_no_link(spark, block):
    rng = np.random.default_rng(2)
    values = np.unique(np.concatenate([rng.integers(0, 2**64, 300, np.uint64, endpoint=False), np.uint64(2**63 + 5) ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64))]))
    frame_ = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash_bk.fingerprint_links(frame_, block=block).collect()
    at = {int(v): n for n, v in enumerate(values.view(np.int64))}
    a, b = np.array([at[r.u] for r in links]), np.array([at[r.v] for r in links])
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    true_a, true_b = np.nonzero(np.triu(near, 1))
    assert near[a, b].sum() >= 0 and (simhash_bk.stars(len(values), a, b) == simhash_bk.stars(len(values), true_a, true_b)).all()


def test_similar_documents(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    close, far = list(base), list(base)
    for n in (100, 300, 500):
        close[n] = "new"
    for n in range(0, 600, 4):
        far[n] = f"v{n}"
    rows = [(5, " ".join(base)), (3, " ".join(close)), (9, " ".join(far)), (11, None), (12, ""), (13, "lone text")]
    got = {r.doc_id: r.component_id for r in simhash_bk.similar_documents(frame(spark, rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 9, 11: 11, 12: 11, 13: 13}
    assert {r.doc_id for r in simhash_bk.keep_one_of_similar(frame(spark, rows)).collect()} == {3, 9, 11, 13}


def test_keeping_one_of_similar_goes_by_rows(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    near = " ".join([*base[:150], "new", *base[151:]])
    base = " ".join(base)
    rows = [(3, base, "a"), (5, near, "b"), (5, "some other text", "c"), (None, near, "d"), (None, "a text without an id", "e"), (7, "twice the same", "f"), (7, "twice the same", "f"), (None, None, "g"), (None, "", "g")]
    names = ["__id", "own_digest", "Chosen_Id", "node", "component_id", "digest", "copies", "Chosen_Digest", "__own"]
    docs = spark.createDataFrame([(*r[:2], *[r[2]] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = simhash_bk.keep_one_of_similar(docs)
    assert got.columns == docs.columns
    found = sorted(((r[0], r[1] or "", r[2], r[3]) for r in got.collect()), key=str)
    assert found == sorted([(3, base, "a", "a"), (5, "some other text", "c", "c"), (None, "a text without an id", "e", "e"), (7, "twice the same", "f", "f"), (None, "", "g", "g")], key=str)
    equals = exact_dedup.keep_one_of_equals(docs)
    assert equals.columns == docs.columns and sorted(r[2] + r[3] for r in equals.collect()) == ["aa", "bb", "cc", "ee", "ff", "gg"]


def test_removed_documents_are_true_near_copies(spark):
    """All pairs of the documents left by exact deduplication, by the Jaccard of their five-word shingles."""
    docs = exact_dedup.keep_one_of_equals(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sets = []
    for d in docs:
        w = (d.text or "").encode().lower().split()
        sets.append({tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set())
    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(n)
    common = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    parent = list(range(len(docs)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for (a, b), c in common.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = defaultdict(list)
    for n, d in enumerate(docs):
        groups[top(n)].append(d.doc_id)
    true = {i for g in groups.values() for i in g if i != min(g)}
    table = spark.createDataFrame([(d.doc_id, d.text) for d in docs], "doc_id long, text string")
    gone = {d.doc_id for d in docs} - {r.doc_id for r in simhash_bk.keep_one_of_similar(table).collect()}
    assert gone <= true and len(gone) >= 0.9 * len(true) and true


def test_smallest_id_of_all(spark):
    rows = [(-(2**63), "a b"), (4, "ab"), (2**63 - 1, "a  b"), (None, "a b")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert got == {(-(2**63), 2**63 - 1, 4, False), (4, 2**63 - 1, 4, False), (2**63 - 1, 2**63 - 1, 4, True), (None, 2**63 - 1, 4, False)}


def test_repeated_lines_do_not_weigh(spark):
    rng = random.Random(10)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    line, body = new(16), new(504)
    shared = [(1, " ".join(line * 50 + new(400))), (2, " ".join(line * 50 + new(400)))]
    same = [(3, " ".join(body)), (4, " ".join(body + new(12) * 200))]
    got = {r.doc_id: r.component_id for r in simhash_bk.similar_documents(frame(spark, shared + same)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(12)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(1200):
        size = rng.choice([8, 12, 24, 60, 200, 500])
        shared, more = new(size), max(1, round(size * rng.uniform(0.05, 0.2)))
        pair = [" ".join(shared + new(more)), " ".join(shared + new(more))]
        a, b = ({tuple(t.split()[n : n + 5]) for n in range(len(t.split()) - 4)} for t in pair)
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        want[i] = len(a & b) / len(a | b)
    got = {r.doc_id: r.component_id for r in simhash_bk.similar_documents(frame(spark, rows)).collect()}
    joined = {i: got[2 * i] == got[2 * i + 1] == 2 * i for i in want}
    assert sum(0.7 <= j < 0.8 for j in want.values()) > 200 and sum(0.8 <= j < 0.9 for j in want.values()) > 200
    assert not any(joined[i] for i, j in want.items() if j < 0.8)
    assert np.mean([joined[i] for i, j in want.items() if j >= 0.8]) > 0.995


@pytest.mark.parametrize("rounds", [simhash_bk.ROUNDS, (("all", 1 << 62),), (("block", 1), ("one", 1), ("all", 1), ("all", 1 << 62))])
def test_groups_of_near_copies_in_blocks(spark, monkeypatch, rounds):
    monkeypatch.setattr(simhash_bk, "ROUNDS", rounds)
    monkeypatch.setattr(simhash_bk.wide_links, "__defaults__", (*simhash_bk.wide_links.__defaults__[:-1], 20))
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    rows = []
    for i in range(100):
        words = list(base)
        words[rng.randrange(600)] = f"new{i}"
        rows.append((i, " ".join(words)))
    for n in range(0, 600, 12):  # a relative of the group that no member is similar enough to
        base[n] = f"other{n}"
    rows.append((100, " ".join(base)))
    assert {r.doc_id: r.component_id for r in simhash_bk.similar_documents(frame(spark, rows)).collect()} == {**{i: 0 for i in range(100)}, 100: 100}


@pytest.mark.parametrize("shingles", [simhash_bk.SET_BLOCK, 5000])
def test_candidates_of_a_large_group_stay_in_their_tasks(spark, monkeypatch, shingles):
    """Texts of one family, most of them at a similarity of about 0.71: their pairs are candidates, and no table holds these."""
    monkeypatch.setattr(simhash_bk, "SET_BLOCK", shingles)
    rows_of, written = {}, simhash_bk.written

    def counted(df, tag):
        out = written(df, tag)
        rows_of[tag] = max(rows_of.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(simhash_bk, "written", counted)
    rng = random.Random(14)
    base = [f"w{n}" for n in range(300)]
    rows, sets = [], []
    for i in range(400):
        near = i % 10 == 9  # to the text before it
        words = list(words if near else base)
        for n in rng.sample(range(4, 296), 1 if near else 5):
            words[n] = f"new{i}-{n}"
        rows.append((i, " ".join(words)))
        sets.append({tuple(words[n : n + 5]) for n in range(296)})
    links = [(a, b) for a, b in itertools.combinations(range(400), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = list(range(400))
    for _ in range(400):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.doc_id: r.component_id for r in simhash_bk.similar_documents(frame(spark, rows)).collect()}
    assert got == dict(enumerate(least)) and 1 < len(set(least)) < 400
    if shingles > 5000:  # smaller parts meet the others of their group each
        assert max(rows_of.values()) <= 60 * 400, rows_of


def test_similar_pairs_of_sets(monkeypatch):
    monkeypatch.setattr(simhash_bk, "SET_BLOCK", 100)
    rng = np.random.default_rng(5)
    sets = np.empty(60, object)
    sets[:] = [np.unique(rng.integers(-50, 50, rng.integers(1, 90))) for _ in range(60)]
    a, b = rng.integers(0, 60, (2, 800))
    want = [len({*sets[x]} & {*sets[y]}) / len({*sets[x]} | {*sets[y]}) >= 0.4 for x, y in zip(a, b)]
    assert 0 < sum(want) < 800 and simhash_bk.similar_pairs(sets, a, b, 0.4).tolist() == want
    assert len(simhash_bk.similar_pairs(sets, a[:0], b[:0], 0.4)) == 0


def test_fingerprints_equal_plain_counts():
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 2**64, n, np.uint64, endpoint=False) for n in (0, 1, 2, 254, 255, 256, 1000, 0)]
    found = simhash_bk.simhashes(lists, 2)
    for hashes, words in zip(lists, found):
        for word in words:
            assert int(word) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
            hashes = simhash_bk.remixed(hashes)


def test_language_model_counts(spark):
    rows = [(i, t) for i, t in ROWS if i > 0]
    got = brown_lm.score_documents(frame(spark, rows)).collect()
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / len(ws)), rel_tol=1e-6)


def test_exchange_clustering_finds_classes_and_probabilities_add_up():
    rng = np.random.default_rng(3)
    units, truth = 60, np.r_[0, np.arange(59) % 4 + 1]
    rates = rng.dirichlet(np.full(5, 0.2), 5)
    table = np.zeros((units, units), np.int64)
    before = 0
    for _ in range(60_000):
        k = rng.choice(5, p=rates[truth[before]])
        now = rng.choice(np.flatnonzero(truth == k))
        table[before, now] += 1
        before = now
    found = brown_lm.exchange_clustering(table, 5)
    assert sum(len(set(found[truth == k])) == 1 for k in range(5)) >= 4
    grouped = np.zeros((5, 5))
    np.add.at(grouped, (found[:, None], found[None, :]), table)
    seen, types = (np.bincount(found, w, 5) for w in (table.sum(0), np.ones(units)))
    model = brown_lm.class_model(found, grouped, seen, types, np.array([0, 0, 3, 1, 0]))
    assert np.allclose((10**model.steps).sum(1), 1) and model.unmet == 2
    emitted = [((table.sum(0)[found == k] + 0.5).sum() + 0.5 * (k == 2)) / 10 ** model.spread[k] for k in range(5)]
    assert np.allclose(emitted, 1)


def test_words_are_placed_by_the_gain_of_the_class_bigrams():
    rng = np.random.default_rng(5)
    table = rng.integers(0, 50, (6, 6)).astype(float)
    likelihood = lambda t: brown_lm.xlogx(t).sum() - brown_lm.xlogx(t.sum(0)).sum() - brown_lm.xlogx(t.sum(1)).sum()
    word, side, klass, n = (np.array(x) for x in ([0, 0, 1, 2, 2, 2], [0, 1, 0, 0, 1, 1], [3, 2, 0, 5, 1, 4], [1, 2, 40, 7, 9, 1]))
    got = brown_lm.Placer(table).place(word, side, klass, n, 4)
    for w in range(3):
        gains = []
        for c in range(1, 6):
            t = table.copy()
            for s, k, m in zip(side[word == w], klass[word == w], n[word == w]):
                t[(k, c) if s == 0 else (c, k)] += m
            gains.append(likelihood(t))
        assert gains[got[w] - 1] >= max(gains) - 1e-6 * abs(max(gains))
    assert got[3] == 1 + table.sum(0)[1:].argmax()


@pytest.mark.parametrize("size", [25, 26, 100_000])
def test_model_scores_equal_a_plain_computation(spark, monkeypatch, size):
    """With a small dictionary most words get their class and count from the tables of rarer words."""
    monkeypatch.setattr(brown_lm.lexicon, "__defaults__", (size,))
    monkeypatch.setattr(brown_lm, "SEEDS", 10)
    if size == 26:  # joins split hot words
        monkeypatch.setattr(common, "FEW_ROWS", 10)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice('abcde')}{min(int(rng.expovariate(0.2)), rng.randrange(1, 60))}" for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    rows = [*enumerate(texts), (900, None), (901, "never met words here"), (902, ""), (903, "unmet " * 500)]
    docs = frame(spark, rows)
    train = docs.where(brown_lm.training(F.col("doc_id")))
    counts = common.written(brown_lm.word_counts(train), "words")
    lex, model, others = brown_lm.fit(train, counts)
    klass = dict(zip(lex.listed, model.classes.tolist()))
    rare = {r.word: r for r in others.collect()}
    count = {r.word: r.n for r in counts.collect()}
    assert set(klass) | set(rare) == set(count) and not set(klass) & set(rare) and (size > 25 or len(rare) > 20)
    every = {**klass, **{w: r["class"] for w, r in rare.items()}}
    token = {i: [*(t or "").lower().split(), ""] for i, t in rows}
    table, number = np.zeros((brown_lm.CLASSES,) * 2), brown_lm.CLASSES
    for i, ws in token.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for a, b in zip(["", *ws], ws):
                table[every[a], every[b]] += 1
    seen, types = (np.bincount([every[w] for w in count], [f(w) for w in count], number) for f in (count.get, lambda w: 1))
    once = np.bincount([every[w] for w in count], [count[w] == 1 for w in count], number)
    plain = brown_lm.class_model(model.classes, table, seen, types, once)
    assert np.allclose(plain.steps, model.steps) and np.allclose(plain.spread, model.spread) and plain.unmet == model.unmet
    for r in brown_lm.score_documents(docs).collect():
        want, before = 0.0, 0
        for w in token[r.doc_id]:
            c = every.get(w, model.unmet)
            want += plain.steps[before, c] + math.log10(count.get(w, 0) + 0.5) - plain.spread[c]
            before = c
        assert math.isclose(r.score, want, rel_tol=1e-9), r


def test_dictionary_is_a_threshold(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1), ("", 7)], "word string, n long")
    assert brown_lm.lexicon(counts, 3).listed == ["a", ""]
    assert brown_lm.lexicon(counts, 4).listed == ["a", "", "b", "c"]
    assert brown_lm.lexicon(counts, 1).listed == ["a", ""]  # the end token is always there


def good(rng):
    return " ".join(rng.choice(["the", "river", "and", "stone", "walk", "light"]) for _ in range(60)).capitalize() + "."


def test_classifier(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = good(rng)
        if bad:
            text = " ".join(w + "%%%" for w in text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        rows.append((i, text))
        if i % 5:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None), (901, ""), (902, good(rng) * 3000), (1, rows[1][1])]
    docs = frame(spark, rows)
    told = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_cnn.score_documents(docs, told).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.95
    assert {r.score for r in got if r.doc_id == 900} == {r.score for r in got if r.doc_id == 901}
    kept = quality_cnn.keep_good(docs, told)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)


def test_scores_cover_whole_texts_in_any_chunking():
    net = quality_cnn.train([b"good text here", b"b%%% a%%%"] * 20, np.array([1, 0] * 20), 0.5)
    text = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = net._pooled(text)
    before, quality_cnn.BYTES_AT_ONCE = quality_cnn.BYTES_AT_ONCE, 1024
    try:
        assert np.allclose(net._pooled(text), whole)
    finally:
        quality_cnn.BYTES_AT_ONCE = before
    assert net.probabilities([b"x" * 9000 + b" %%% ***"]) != net.probabilities([b"x" * 9000])


def plain_features(tables, text):
    """Mean and maximum over chunks of each filter's highest rectified response, one window after another."""
    filters, chunks = tables.shape[2], []
    for a in range(0, max(1, len(text)), quality_cnn.CHUNK):
        best = np.zeros(filters)
        for at in range(a, a + quality_cnn.CHUNK):
            for f in range(filters):
                window = sum(float(tables[k, text[at + k] if at + k < len(text) else quality_cnn.PAD, f]) for k in range(quality_cnn.WIDTH))
                best[f] = max(best[f], window)
        chunks.append(best)
    return np.r_[np.mean(chunks, 0), np.max(chunks, 0)]


def test_scores_equal_a_plain_convolution():
    rng = random.Random(15)
    trainer = quality_cnn.Trainer()
    trainer.p["weights"] = np.random.default_rng(1).normal(size=2 * quality_cnn.FILTERS)
    net = trainer.network()
    for size in (0, 3, 511, 515, 1300):
        text = bytes(rng.randrange(256) for _ in range(size))
        x = plain_features(net.tables, text)
        assert math.isclose(net.probabilities([text])[0], 1 / (1 + math.exp(-(x @ net.weights + net.bias))), rel_tol=1e-4)


def test_gradients_equal_differences():
    rng = random.Random(16)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (40, 700, 1200)]
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    trainer = quality_cnn.Trainer()
    trainer.p["weights"] = np.random.default_rng(2).normal(size=2 * quality_cnn.FILTERS) * 0.3

    def loss():
        p = trainer.network().probabilities(texts)
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weight.sum() + quality_cnn.DECAY / 2 * (trainer.p["weights"] ** 2).sum()

    gradient = trainer.gradients(texts, labels, weight)
    for name, at in [("bias", (0,)), ("weights", (3,)), ("weights", (quality_cnn.FILTERS + 5,)), ("filters", (0, 1, 2)), ("filters", (4, 7, 9)), ("embedding", (100, 3)), ("embedding", (110, 0))]:
        kept, step = trainer.p[name][at], 1e-3
        trainer.p[name][at] = kept + step
        above = loss()
        trainer.p[name][at] = kept - step
        below = loss()
        trainer.p[name][at] = kept
        assert math.isclose((above - below) / (2 * step), gradient[name][at], rel_tol=0.05, abs_tol=2e-4), (name, at)


def test_training_takes_whole_texts_in_a_fixed_order(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "CLASS_BYTES", 120_000)
    rows = [(i, f"text {i} " * (1 + i)) for i in range(60)] + [(1, "a text that comes first"), (7, "x" * 130_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    texts, told, share = quality_cnn.training_rows(frame(spark, rows), labels)
    again, _, _ = quality_cnn.training_rows(frame(spark, rows[::-1]), labels)
    used = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    want = sorted(min(t for j, t in rows if j == i) for i in used)
    assert texts == again and sorted(t.decode() for t in texts) == want and len(told) == len(used) and 0 < share < 1
    monkeypatch.setattr(quality_cnn, "CLASS_BYTES", 3000)
    fewer, _, _ = quality_cnn.training_rows(frame(spark, rows), labels)
    assert 0 < sum(map(len, fewer)) <= 6000 and {t.decode() for t in fewer} < set(want)


def test_without_labels_of_both_classes(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality_cnn.score_documents(docs, none).collect())


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_groups(docs), exact_dedup.keep_one_of_equals(docs), license_diagonals.scan_licenses(docs), bpe.round_trip_digests(docs, PATH), token_attribution.section_tokens(docs, PATH),
        pattern_packing.pack_documents(docs, PATH), simhash_bk.near_duplicates(docs), simhash_bk.keep_one_of_similar(docs), brown_lm.score_documents(docs), quality_cnn.score_documents(docs, labels),
    ):
        assert out.count() == 0


def test_null_ids(spark):
    docs = frame(spark, [(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (4, None)])
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_groups(docs).count() == 3 and exact_dedup.keep_one_of_equals(docs).count() == 2
    assert license_diagonals.scan_licenses(docs).count() == 3 and pattern_packing.pack_documents(docs, PATH).count() == 3
    assert simhash_bk.near_duplicates(docs).count() == 3 and brown_lm.score_documents(docs).count() == 3 and quality_cnn.score_documents(docs, labels).count() == 3
