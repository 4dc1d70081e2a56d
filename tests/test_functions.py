import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliomill import schemas, states
from foliomill.functions import naming, status, text
from foliomill.operators import fidelity, intake, registry
from foliomill.sources import logs


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,slug",
    [("Report.pdf", "report"), ("../../etc/passwd", "passwd"), ("C:\\x\\Über Größe.PDF", "uber-groe"), ("日本.pdf", "document"), ("a" * 100 + ".pdf", "a" * 80), ("  --  .pdf", "document"), ("ﬁle №1.pdf", "file-no1")],
)
def test_slug(spark, name, slug):
    assert one(spark, naming.slug(F.col("n")), n=name) == slug


@pytest.mark.parametrize("raw,name", [(None, "document.pdf"), ("", "document.pdf"), ("a\\b/ c.pdf ", "c.pdf"), ("x/", "document.pdf"), ("\x1c y\u2003", "y")])
def test_display_name(spark, raw, name):
    assert one(spark, naming.display_name(F.col("n")), n=raw) == name


def test_filenames(spark):
    h = "0123456789ab" + "c" * 52
    assert one(spark, naming.output_filename(F.lit("s"), F.col("h")), h=h) == "s--0123456789ab.md"
    with pytest.raises(Exception, match="lowercase hex"):
        one(spark, naming.output_filename(F.lit("s"), F.col("h")), h="XYZ")


@pytest.mark.parametrize(
    "said,part",
    [("File is encrypted", "password"), ("deadline exceeded", "too long"), ("too many pages", "larger"), ("not allowed by policy", "would not accept"), ("EOF marker", "damaged or incomplete"), ("in the room", "ran out"), ("skipped", "could not handle"), ("??", "Upload it again")],
)
def test_failure_reason(spark, said, part):
    sentence = one(spark, status.failure_reason(F.array("e"), F.lit("failure")), e=said)
    assert part in sentence and 21 <= len(sentence) <= 219


def test_unknown_task_status_is_an_error(spark):
    with pytest.raises(Exception, match="unknown task status"):
        one(spark, status.job_state(F.col("t"), F.lit("success")), t="odd")


def test_counts_equal_python(spark):
    rng = random.Random(2)
    bits = ["# a", "#", "#b", "###### c", "####### d", "| --- | --- |", "|:--|--:|", "---|---", " | -- | --- |", "![x](y)", "<!-- IMAGE -->", "<!--image-->", "text", "", " ", "\u2003", "```"]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    rows = fidelity.structure_counts(spark.createDataFrame(list(enumerate(texts)), "n int, markdown string")).collect()
    image = re.compile(r"!\[[^\]]*\]\([^)]*\)|<!--\s*image\s*-->", re.I)
    for r in rows:
        t = texts[r.n]
        assert r.headings == len(re.findall(r"^#{1,6}\s+\S", t, re.M)), repr(t)
        assert r.tables == len(re.findall(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", t, re.M)), repr(t)
        assert r.figures == len(image.findall(t))
        found = list(image.finditer(t))
        assert r.figures_in_position == (not found or bool(t[found[-1].end() :].strip())), repr(t)


def test_strip_is_pythons(spark):
    for t in ["\x1c a \x1f", "\u2003b\u2028", "", "  ", "c"]:
        assert one(spark, text.strip(F.col("t")), t=t) == t.strip()


def test_sizes_and_pages(spark):
    assert one(spark, status.size_plain(F.col("n")), n=2048) == "2 KB"
    assert one(spark, status.size_decimal(F.col("n")), n=1572864) == "1.5 MB"
    assert one(spark, status.page_count_of(F.col("b")), b='{"document":{"page_count":0},"pages":4}') == 4
    assert one(spark, status.page_count_of(F.col("b")), b='{"document":{}}') is None


def test_halves_of_sizes_go_to_even(spark):
    """As printf does: 2.25 MB and 12.25 MB down, 14.55078125 MB and 2.75 MB up."""
    got = [one(spark, status.size_decimal(F.col("n")), n=n) for n in (2359296, 12845056, 15257600, 2883584, 1048576)]
    assert got == ["2.2 MB", "12.2 MB", "14.6 MB", "2.8 MB", "1.0 MB"]


def test_moments(spark):
    assert one(spark, status.iso_millis(status.parse_moment(F.col("t"))), t="2024-05-01T12:00:00.123456+02:00") == "2024-05-01T10:00:00.123Z"
    assert one(spark, status.iso_millis(status.parse_moment(F.col("t"))), t="2024-05-01T12:00:00") == "2024-05-01T12:00:00.000Z"


def test_intake_rules_in_order(spark):
    rows = [("big", b"%PDF-", b"", 11), ("empty", b"", b"", 0), ("word", b"PK", b"", 5), ("locked", b"%PDF-1", b"x/Encrypt", 5), ("fine", b"..%PDF-", b"%%EOF", 5)]
    frame = spark.createDataFrame(rows, "name string, head binary, tail binary, size long")
    said = {r["name"]: r["why"] for r in frame.select("name", intake.rejection(F.col("name"), F.col("head"), F.col("tail"), F.col("size"), 10).alias("why")).collect()}
    assert "larger" in said["big"] and "empty" in said["empty"] and "Not a PDF" in said["word"] and "password" in said["locked"] and said["fine"] is None


def test_conform_keeps_rows_and_fills_defaults(spark):
    old = spark.createDataFrame([("a", "queued", None)], "id string, status string, attempt int")
    row = schemas.conform(old, "conversion_job").first()
    assert (row.part_count, row.parts_completed, row.attempt, row.failure_reason) == (1, 0, 1, None)
    assert row.asDict().keys() == set(schemas.struct("conversion_job").names)


def test_log_lines(spark):
    lines = ['x INFO job_split job_id=7 file="a b.pdf" parts=3 reason="two words"', "nothing", 'job_failed job_id=8 file="say "hi".pdf" k=1 k=2']
    rows = logs.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (rows[0].event, rows[0].job_id, rows[0].file, rows[0].fields, rows[0].parse_ok) == ("job_split", "7", "a b.pdf", {"parts": "3", "reason": "two words"}, True)
    assert rows[1].event is None and not rows[1].parse_ok and rows[1].raw == "nothing"
    assert rows[2].event == "job_failed" and not rows[2].parse_ok and rows[2].fields["k"] == "2"


def test_state_sets():
    assert set(states.IN_FLIGHT) | set(states.TERMINAL) == set(states.JOB_STATES)
    assert set(status.DISPLAY) == set(states.JOB_STATES)


def test_fold_equals_the_library_over_all_characters(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    names = ["a" + chr(c) + "b" for c in codes] + ["", "plain", "Ünï ﬁn ½ Å Ⅷ 𝐀", None]
    frame = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    got = {r.n: r.f for r in frame.select("n", naming.nfkd_ascii(F.col("n")).alias("f")).collect()}
    assert got == {n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names}


def plain_seams(text):
    lines, n = text.splitlines(), 0
    divider = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
    for i, line in enumerate(lines):
        if i and divider.match(line):
            before = [x for x in lines[: i - 1] if x.strip()]
            n += bool(before and before[-1].lstrip().startswith("|"))
    return n


def test_seam_tables_equal_a_plain_count(spark):
    rng = random.Random(8)
    kinds = ["| a | b |", "| --- | --- |", "--- | ---", "", "  ", "text", "\t| c", "- --- |", " "]
    texts = ["".join(rng.choice(kinds) + rng.choice(["\n", "\r\n", "\x85"]) for _ in range(rng.randrange(14))) for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    got = {r.doc_id: r.seam_tables for r in fidelity.seam_tables(frame).collect()}
    assert got == {n: plain_seams(t) for n, t in enumerate(texts)} and max(got.values()) > 1


def test_nested_columns_are_decoded_and_encoded(spark):
    frame = spark.createDataFrame([(1, "[]", "[]"), (2, '["a","b"]', "[[1,2],[5,5]]"), (3, None, None)], "n int, errors string, ranges string")
    rows = frame.select("n", status.decode_errors(F.col("errors")).alias("e"), status.encode_ranges(status.decode_ranges(F.col("ranges"))).alias("r")).collect()
    assert sorted((r.n, r.e, r.r) for r in rows) == [(1, None, None), (2, ["a", "b"], "[[1,2],[5,5]]"), (3, None, None)]


def test_logs_are_read_and_jobs_of_a_document_are_newest_first(spark, tmp_path):
    (tmp_path / "a.log").write_text('job_submitted job_id=j1 file="a b.pdf" attempt=2\n')
    assert [(r.event, r.file) for r in logs.read_logs(spark, f"file://{tmp_path}").collect()] == [("job_submitted", "a b.pdf")]
    jobs = spark.createDataFrame([("1", "h", dt.datetime(2024, 1, 1)), ("2", "h", dt.datetime(2024, 1, 2)), ("3", "g", dt.datetime(2024, 1, 3))], "id string, content_hash string, created_at timestamp")
    assert [r.id for r in registry.jobs_of_document(jobs, "h").collect()] == ["2", "1"]


def test_a_slug_computes_its_name_once(spark):
    plan = spark.range(1).select(naming.slug(F.concat(F.lit("é.pdf"), F.col("id").cast("string"))).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?i)\.pdf$") == 1 and plan.count("[^a-z0-9]+") == 1
