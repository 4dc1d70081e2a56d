"""The pipeline's stages and the registered queries with SQL, on the smallest tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliomill.llm import license_diagonals, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_and_only_remove_rows(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_no_equal_texts_stay_and_no_other_goes(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    before, after = ({norm(r.text) for r in s.collect()} for s in stages[1:3])
    assert before == after and stages[2].count() == len(after)


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {r.doc_id for r in stages[1].collect()}
    assert np.mean([r.doc_id in kept for r in labels if r.quality == 1]) > 0.97


def test_packed_pieces_are_those_of_what_stayed(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    total = Counter()
    for r in stages[4].collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
    assert set(total) == set(texts)


def test_run_equals_the_stages(spark, stages):
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(stages[4].collect())


def test_run_on_an_empty_table(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null and very long texts, clashing names: each stage keeps one row of each text, with all columns."""
    long = " ".join(f"w{n}" for n in range(40_000))
    rows = [(1, "a fine text", 1, "x"), (1, "another one", 2, "y"), (None, "a fine  text", 3, "z"), (None, None, 4, "n"), (7, "", 5, "e"), (8, long, 6, "l"), (9, long + " more", 7, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, digest string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        want = {1, 2, 5, 6, 7} if name == "exact_dedup" else {1, 2, 5, 6}
        assert {r.node for r in got.collect()} in (want, want - {1} | {3}), name
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= set(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = con.sql(queries.ORACLES[name])
    at = {c: n for n, c in enumerate(found.columns)}
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(tuple(r[at[c]] for c in columns) for r in found.fetchall())


def test_license_bases_of_the_documents(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op6_license_scans"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text))
        starts = [n for phrase, _ in license_diagonals.PHRASES for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
        assert (rows[d.doc_id].n_words, rows[d.doc_id].n_base, rows[d.doc_id].first_word) == (len(words), len(starts), min(starts, default=None))
