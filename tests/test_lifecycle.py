import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliomill.operators import intake, retention
from foliomill.operators import parts as pt
from foliomill.plans import convert
from foliomill.plans.convert import convert_corpus
from foliomill.plans.derived import Derived
from foliomill.shared import fresh_path
from foliomill.sources import files, sinks
from foliomill.streaming import alarms, state

NOW = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("pages,size,n", [(1, 100, 1), (100, 100, 1), (101, 100, 2), (250, 100, 3), (2413, 100, 25)])
def test_plan_covers_each_page_once(spark, pages, size, n):
    rows = pt.plan_parts(spark.createDataFrame([("j", pages)], "id string, page_count int"), size).orderBy("ordinal").collect()
    assert len(rows) == n and [p for r in rows for p in range(r.first_page, r.last_page + 1)] == list(range(1, pages + 1))


def test_plan_refuses_no_pages(spark):
    with pytest.raises(Exception, match="at least 1"):
        pt.plan_parts(spark.createDataFrame([("j", 0)], "id string, page_count int"), 5).collect()


def bad_pages(pages, floor):
    def convert(batch):
        out = []
        for a, b in zip(batch["first_page"], batch["last_page"]):
            hit = any(a <= p <= b for p in pages)
            if hit and "raise" in pages:
                raise RuntimeError("boom")
            out.append((None, "timed_out", ["timeout"]) if hit else (" ".join(f"p{p}" * 20 for p in range(a, b + 1)), "success", []))
        return out

    return convert


def test_halving_leaves_named_gaps(spark):
    jobs = spark.createDataFrame([("a", "h", 40), ("b", "i", 3)], "id string, content_hash string, page_count int")
    rows = {r.job_id: r for r in convert_corpus(jobs, bad_pages([1, 6], 5), max_pages=20, max_depth=2, min_pages=5).collect()}
    assert [tuple(x) for x in rows["a"].missing_page_ranges] == [(1, 5), (6, 10)]
    assert rows["a"].status == "succeeded_incomplete" and "**Pages 1-5 are missing" in rows["a"].markdown and rows["a"].markdown.endswith("p40\n")
    assert rows["b"].status == "failed" or rows["b"].missing_page_ranges


def test_a_raising_converter_fails_rows_not_the_job(spark):
    def convert(batch):
        if (batch["job_id"] == "bad").any():
            raise RuntimeError("out of memory")
        return [("x" * 500, "success", []) for _ in range(len(batch))]

    jobs = spark.createDataFrame([("ok", "h", 1), ("bad", "i", 1)], "id string, content_hash string, page_count int")
    rows = {r.job_id: r for r in convert_corpus(jobs, convert).collect()}
    assert rows["ok"].status == "succeeded" and rows["bad"].status == "failed" and "resources" in rows["bad"].failure_reason


def test_lost_parts_are_requeued_then_given_up(spark):
    parts = spark.createDataFrame([(1, 1, 0, 9), (3, 1, 0, 9), (3, 1, 2, 90), (3, 1, 0, 90)], "attempt int, first_page int, split_depth int, last_page int")
    assert [r.a for r in parts.select(pt.retry_action(F.lit("lost")).alias("a")).collect()] == ["requeue", "give_up", "give_up", "halve"]


def test_partial_parts_are_told_and_finished_parts_convert_once(spark, tmp_path):
    """The converter leaves a file for each part it sees: those that succeed have one, lost ones as many as they have attempts."""

    def convert(batch):
        out = []
        for job, a, b in zip(batch["job_id"], batch["first_page"], batch["last_page"]):
            seen = len(list(tmp_path.glob(f"{job}-{a}-{b}-*")))
            (tmp_path / f"{job}-{a}-{b}-{seen}").touch()
            lost = a == 3 and seen < 2
            out.append((None, "lost", []) if lost else (f"pages {a}-{b} " * 60, "partial_success" if job == "x" and a == 1 else "success", []))
        return out

    jobs = spark.createDataFrame([("x", "h", 6), ("y", "i", 4)], "id string, content_hash string, page_count int")
    rows = {r.job_id: r for r in convert_corpus(jobs, convert, max_pages=2).collect()}
    assert {j: (r.status, r.any_partial, r.part_count) for j, r in rows.items()} == {"x": ("succeeded", True, 3), "y": ("succeeded", False, 2)}
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{j}-{a}-{a + 1}-{n}" for j, last in (("x", 6), ("y", 4)) for a in range(1, last, 2) for n in range(3 if a == 3 else 1))


def test_parts_that_stay_queued_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(convert, "retry_action", lambda event, *_: F.when(event.isNotNull(), F.lit("requeue")))
    jobs = spark.createDataFrame([("x", "h", 1)], "id string, content_hash string, page_count int")
    with pytest.raises(RuntimeError, match="still queued"):
        convert_corpus(jobs, lambda batch: [(None, "lost", []) for _ in range(len(batch))], max_attempts=1, max_depth=0)


def test_halves_are_numbered_after_all_parts_of_their_job(spark):
    def fails(batch):
        return [(None, "failure", ["memory"]) if b - a >= 2 else (f"p{a} " * 40, "success", []) for a, b in zip(batch["first_page"], batch["last_page"])]

    jobs = spark.createDataFrame([("x", "h", 12)], "id string, content_hash string, page_count int")
    row = convert_corpus(jobs, fails, max_pages=8, max_depth=2, min_pages=1).first()
    assert row.part_count == 6 and row.status != "failed" and [int(w[1:]) for w in dict.fromkeys(row.markdown.split())] == [1, 3, 5, 7, 9, 11]


def test_a_shared_folder_must_be_named_on_clusters():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, other=None: {"spark.master": "spark://host:7077"}.get(name, other))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fresh_path(Session, "x")
    assert fresh_path(Session, "x", "hdfs://here/").startswith("hdfs://here/x-")


def job(n, h, status, hours):
    return (str(n), h, status, NOW - dt.timedelta(hours=hours) if hours is not None else None)


def test_reaping_clocks(spark):
    jobs = [job(1, "a", "succeeded", 49), job(2, "b", "succeeded", 47), job(3, "c", "failed", 49), job(4, "d", "failed", 14 * 24), job(5, "e", "succeeded", 500), job(6, "e", "queued", None), job(7, "f", "succeeded", 60), job(8, "f", "failed", 1)]
    docs = [(h, "p") for h in "abcdefg"] + [("z", None)]
    j = spark.createDataFrame(jobs, "id string, content_hash string, status string, ended_at timestamp")
    d = spark.createDataFrame(docs, "content_hash string, inbox_path string")
    reaped = retention.reapable_uploads(d, j, F.lit(NOW))
    assert {r.content_hash for r in reaped.collect()} == {"a", "d", "f"}
    cleared = {r.content_hash: r.inbox_path for r in retention.clear_reaped(d, reaped).collect()}
    assert cleared["a"] is None and cleared["b"] == "p"


def test_pruning_is_strict_and_cascades(spark):
    cut = NOW - dt.timedelta(days=30)
    j = spark.createDataFrame([("old", "failed", cut - dt.timedelta(seconds=1)), ("edge", "failed", cut), ("live", "running", cut - dt.timedelta(days=9))], "id string, status string, ended_at timestamp")
    p = spark.createDataFrame([("old",), ("edge",)], "job_id string")
    jobs, parts = retention.prune_history(j, p, F.lit(cut))
    assert {r.id for r in jobs.collect()} == {"edge", "live"} and {r.job_id for r in parts.collect()} == {"edge"}


def test_terminal_states_absorb_and_replays_change_nothing(spark):
    rows = [("j", "queued", 1, 1), ("j", "running", 2, 2), ("j", "failed", 3, 3), ("j", "running", 4, 4), ("j", "succeeded", 5, 5), ("k", "running", 9, 1), ("k", "queued", 8, 2)]
    e = spark.createDataFrame([(a, b, NOW + dt.timedelta(seconds=c), d) for a, b, c, d in rows], "job_id string, status string, ts timestamp, seq long")
    once = sorted((r.job_id, r.status) for r in state.fold_states(e).collect())
    twice = sorted((r.job_id, r.status) for r in state.fold_states(e.union(e)).collect())
    assert once == twice == [("j", "failed"), ("k", "running")]


def test_rolling_alarm_counts_over_slice_edges(spark):
    times = [0, 86_000, 86_399, 86_500, 86_900, 87_300, 300_000]
    e = spark.createDataFrame([(t, dt.datetime.fromtimestamp(t, dt.UTC)) for t in times], "n long, ts timestamp")
    got = {r.n: (r.recent, r.alarm) for r in alarms.rolling_alarm(e).collect()}
    for t in times:
        want = sum(t - 900 <= x <= t for x in times)
        assert got[t] == (want, want >= 3)


OUTPUTS = "content_hash string, output_filename string, text string"


def test_replacing_outputs_keeps_other_documents(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    frame = lambda rows: spark.createDataFrame(rows, OUTPUTS)
    held = lambda: {(r.output_filename, r.text) for r in sinks.read_outputs(spark, path, frame([("", "", "")]).schema).collect()}
    assert held() == set()
    sinks.replace_outputs(frame([("a", "a1", "x"), ("a", "a2", "y"), ("a", "a3", "z"), ("b", "b1", "é")]), path)
    told = sinks.replace_outputs(frame([("a", "a1", "new"), ("a", "a2", "y")]), path).first()
    assert (told.files, told.bytes) == (2, 4)
    want = {("a1", "new"), ("a2", "y"), ("b1", "é")}
    assert held() == want
    sinks.compact_outputs(spark, path, frame([("", "", "")]).schema)
    assert held() == want
    sinks.replace_outputs(frame([("b", "b2", "other")]), path)
    sinks.compact_outputs(spark, path, frame([("", "", "")]).schema)
    assert held() == {("a1", "new"), ("a2", "y"), ("b2", "other")}
    assert sorted(p.name[:5] for p in (tmp_path / "out").iterdir()) == ["batch", "fold-", "fold-"]  # what the last fold replaced still stands


def test_a_job_that_dies_leaves_the_earlier_outputs_whole(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    first = spark.createDataFrame([(f"h{i}", f"f{i}", "old") for i in range(40)], OUTPUTS)
    sinks.replace_outputs(first, path)
    breaks = F.when(F.col("output_filename") == "f39", F.raise_error(F.lit("killed"))).otherwise(F.lit("new"))
    with pytest.raises(Exception, match="killed"):
        sinks.replace_outputs(first.repartitionByRange(8, "output_filename").withColumn("text", breaks), path)
    assert {r.text for r in sinks.read_outputs(spark, path, first.schema).collect()} == {"old"}
    sinks.replace_outputs(first.withColumn("text", F.lit("new")), path)
    assert [r.text for r in sinks.read_outputs(spark, path, first.schema).collect()] == ["new"] * 40


def test_deletion_and_pruning_reach_stored_tables(spark, tmp_path):
    """Delete, prune, compact and read: no stored row is written again, and what is gone stays gone."""
    root = f"file://{tmp_path}"
    old = NOW - dt.timedelta(days=40)
    rows = {
        "source_document": ([("a", "a.pdf"), ("b", "b.pdf"), ("c", "c.pdf")], "content_hash string, original_filename string"),
        "conversion_job": ([("1", "a", "succeeded", NOW), ("2", "b", "running", None), ("3", "c", "failed", old), ("4", "c", "succeeded", NOW)], "id string, content_hash string, status string, ended_at timestamp"),
        "conversion_part": ([("1", 1), ("1", 2), ("3", 1), ("4", 1)], "job_id string, ordinal int"),
        "markdown_output": ([("a.md", "a"), ("c.md", "c")], "output_filename string, content_hash string"),
    }
    for table, (data, schema) in rows.items():
        sinks.upsert_table(spark.createDataFrame(data, schema).withColumn("changed_at", F.lit(old)), f"{root}/{table}", 0)
    read = lambda t: sinks.read_table(spark, f"{root}/{t}", retention.STORED[t], "changed_at")
    plan = retention.deletion_plan(read("source_document"), read("conversion_job"), spark.createDataFrame([("a",), ("b",)], "content_hash string"))
    retention.store_deletions(plan, read("conversion_job"), read("conversion_part"), read("markdown_output"), root, F.lit(NOW))
    retention.store_pruning(read("conversion_job"), read("conversion_part"), root, F.lit(NOW - dt.timedelta(days=30)), F.lit(NOW))
    keys = lambda t: sorted(tuple(r) for r in read(t).select(*retention.STORED[t]).collect())
    want = {"source_document": [("b",), ("c",)], "conversion_job": [("2",), ("4",)], "conversion_part": [("4", 1)], "markdown_output": [("c.md",)]}
    assert {t: keys(t) for t in want} == want
    for table in want:
        sinks.compact_table(spark, f"{root}/{table}", retention.STORED[table], "changed_at")
    assert {t: keys(t) for t in want} == want and "__gone" not in read("conversion_job").columns
    sinks.upsert_table(spark.createDataFrame([("a", "again.pdf", NOW + dt.timedelta(days=1))], "content_hash string, original_filename string, changed_at timestamp"), f"{root}/source_document", 9)
    assert keys("source_document") == [("a",), ("b",), ("c",)]


def test_converters_that_hang_or_die_cost_one_part_each(spark):
    def hostile(batch):
        """Hangs, ends its process, eats memory or raises, as the part's job says."""
        import os
        import time

        out = []
        for job in batch["job_id"]:
            if job == "sleeps":
                time.sleep(60)
            elif job == "aborts":
                os.abort()
            elif job == "exits":
                os._exit(0)
            elif job == "eats":
                bytearray(1 << 40)
            elif job == "raises":
                raise RuntimeError("boom")
            out.append((f"text of {job}", "success", []))
        return out

    jobs = ["ok1", "sleeps", "ok2", "aborts", "exits", "ok3", "eats", "raises", "ok4"]
    parts = spark.createDataFrame([(j, 1) for j in jobs], "job_id string, ordinal int").coalesce(1)
    got = {r.job_id: (r.engine_status, r.new_markdown) for r in convert.convert_parts(parts, hostile, deadline=1.5, memory=1 << 30).collect()}
    assert got == {j: ("success", f"text of {j}") if j.startswith("ok") else ({"sleeps": "timed_out", "aborts": "lost", "exits": "lost"}.get(j, "failure"), None) for j in jobs}


def test_a_corpus_with_hostile_parts_is_converted(spark):
    def converter(batch):
        import os
        import time

        if (batch["job_id"] == "hangs").any() and (batch["first_page"] <= 3).all() and (batch["last_page"] >= 3).all():
            time.sleep(60)
        if (batch["job_id"] == "dies").any():
            os.abort()
        return [(f"p{a}-{b} " * 300, "success", []) for a, b in zip(batch["first_page"], batch["last_page"])]

    jobs = spark.createDataFrame([("hangs", "h", 8), ("dies", "i", 1), ("fine", "j", 2)], "id string, content_hash string, page_count int")
    rows = {r.job_id: r for r in convert_corpus(jobs, converter, max_pages=8, max_depth=2, min_pages=2, max_attempts=2, deadline=1.0).collect()}
    assert rows["fine"].status == "succeeded" and rows["dies"].status == "failed"
    assert rows["hangs"].status == "succeeded_incomplete" and [tuple(x) for x in rows["hangs"].missing_page_ranges] == [(3, 4)]


def test_files_over_the_limit_are_refused_unread(spark, tmp_path):
    with open(tmp_path / "huge.pdf", "wb") as f:
        f.truncate(3 << 30)  # sparse, and more than a row can hold
    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.7 small")
    scanned = files.scan_uploads(spark, f"file://{tmp_path}")
    rows = {r.filename: r for r in scanned.withColumn("reason", intake.rejection(F.col("filename"), F.col("head"), F.col("tail"), F.col("size_bytes"))).collect()}
    assert rows["huge.pdf"].size_bytes == 3 << 30 and "larger than the" in rows["huge.pdf"].reason and rows["huge.pdf"].content_hash is None
    assert rows["small.pdf"].reason is None and bytes(rows["small.pdf"].content) == b"%PDF-1.7 small"


def test_scanning_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7" + b"x" * 9000 + b"/Encrypt")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "deep er").mkdir()
    for name in ("c +%é.pdf", "d.txt"):
        (tmp_path / "deep er" / name).write_bytes(b"")
    (tmp_path / "deep er" / "e +%é.pdf").write_bytes(b"%PDF-")
    rows = {r.filename: r for r in files.scan_uploads(spark, f"file://{tmp_path}", "*.pdf").collect()}
    assert {n: r.size_bytes for n, r in rows.items()} == {"a.pdf": 9016, "b.pdf": 0, "c +%é.pdf": 0, "e +%é.pdf": 5}
    assert rows["c +%é.pdf"].path.endswith("deep er/c +%é.pdf") and rows["e +%é.pdf"].path.endswith("deep er/e +%é.pdf")
    assert rows["a.pdf"].size_bytes == 9016 and len(rows["a.pdf"].head) == 1024 and len(rows["a.pdf"].tail) == 8192 and rows["a.pdf"].tail.endswith(b"/Encrypt")
    assert rows["b.pdf"].content_hash == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_cheap_parts_are_called_in_groups_and_faults_cost_their_part_only():
    import os
    import time

    import pandas as pd

    from foliomill.plans.isolated import convert_isolated

    def converter(parts):
        for n in parts["n"]:
            if n == 700:
                os._exit(3)
            if n == 900:
                time.sleep(60)
            if n == 1100:
                raise ValueError("bad")
        return [(f"p{n} of {len(parts) > 1}", "success", []) for n in parts["n"]]

    found = convert_isolated(converter, pd.DataFrame({"n": range(3000)}), 1.0)
    odd = {n: r[1] for n, r in enumerate(found) if r[1] != "success"}
    assert len(found) == 3000 and odd == {700: "lost", 900: "timed_out", 1100: "failure"}
    assert all(r[0].startswith(f"p{n} ") for n, r in enumerate(found) if n not in odd)
    assert sum(r[0].endswith("True") for r in found if r[0]) > 1000  # most were called in groups


def test_jobs_join_hashes_and_no_texts(spark):
    plan = Derived(spark, "/root/testdata/sf0.001").jobs._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join ") < plan.index("sha2(")
