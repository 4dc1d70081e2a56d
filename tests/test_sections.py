"""Sections against a plain implementation written for these tests, on fixed and random texts."""

import random
import re
import unicodedata

import pytest

from foliomill.operators import fidelity, sections

BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def plain_headings(lines):
    inside, found = False, {}
    for n, line in enumerate(lines):
        if re.match(r"\s{0,3}(```|~~~)", line):
            inside = not inside
        elif not inside and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)):
            found[n] = (len(m[1]), m[2])
    return found


def plain_cut(text, level):
    raw = text.splitlines(keepends=True)
    heads = plain_headings(text.splitlines())
    cuts = [n for n, (lv, _) in heads.items() if lv == level]
    out = []
    if cuts[0] and "".join(raw[: cuts[0]]).strip():
        out.append(["", "".join(raw[: cuts[0]])])
    for a, b in zip(cuts, [*cuts[1:], len(raw)]):
        out.append([heads[a][1], "".join(raw[a:b])])
    return out


def plain_sections(text, low, high):
    heads = plain_headings(text.splitlines())
    if not heads:
        return [("", text)]
    top = min(lv for lv, _ in heads.values())
    groups = []
    for title, body in plain_cut(text, top):
        if groups and len(body.encode()) < low:
            groups[-1][1] += body
        else:
            groups.append([title, body])
    out = []
    for title, body in groups:
        inner = {lv for lv, _ in plain_headings(body.splitlines()).values() if lv > top}
        if len(body.encode()) <= high or not inner:
            out.append((title, body))
            continue
        pieces = plain_cut(body, min(inner))
        if len(pieces) > 1 and not pieces[0][0]:
            first = pieces.pop(0)
            pieces[0][1] = first[1] + pieces[0][1]
        out += [(t or title, b) for t, b in pieces]
    return out


def random_text(rng):
    lines = []
    for _ in range(rng.randrange(0, 25)):
        kind = rng.random()
        if kind < 0.35:
            lines.append("#" * rng.randrange(1, 5) + " " + rng.choice(["A", "B ##", "Långe", "x y", "#"]))
        elif kind < 0.45:
            lines.append(rng.choice(["```", "~~~", "   ```py", "    ```"]))
        elif kind < 0.6:
            lines.append(rng.choice(["", "  ", "\t"]))
        else:
            lines.append("word " * rng.randrange(1, 12))
    return "".join(x + rng.choice(["\n", "\n", "\n", "\r\n", "\u2028", "\x85", "\x0b"]) for x in lines)


def test_random_texts_equal_the_plain_implementation(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(300)] + ["", "no heading", "# one", "\n\n# a\ntext\n# b\n", "## deep\n### deeper\n" + "x" * 200, "pre\n# a\n```\n# not\n```\n# b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    got = {}
    for r in sections.split_into_sections(docs, min_bytes=30, max_bytes=80).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.title, r.text))
    for n, text in enumerate(texts):
        assert [(t, b) for _, t, b in sorted(got[n])] == plain_sections(text, 30, 80), repr(text)


@pytest.mark.parametrize("low,high", [(1, 10_000_000), (10_000_000, 10_000_000)])
def test_no_content_is_lost_but_a_blank_start(spark, low, high):
    texts = ["intro\n# a\nx\n# b\ny\n", "# a\n" * 5, "\n \n## z\nq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    rows = sorted(sections.split_into_sections(docs, min_bytes=low, max_bytes=high).collect(), key=lambda r: (r.doc_id, r.ordinal))
    for n, text in enumerate(texts):
        joined = "".join(r.text for r in rows if r.doc_id == n)
        assert joined == text or text.removesuffix(joined).strip() == ""


def test_planned_files_equal_plain_sections(spark):
    rng = random.Random(21)
    docs = []
    for i in range(60):
        text = "".join(rng.choice(["# Top é\n", "## Über uns!\n", "### Deep\n", "words and more words\n", "\n", "```\n", "#\n"]) for _ in range(rng.randrange(0, 30)))
        docs.append((f"{i:064x}", rng.choice(["Räport.PDF", "a\\b/c d.pdf", "....pdf", "x" * 100]), text))
    found = sections.plan_outputs(spark.createDataFrame(docs, "content_hash string, filename string, markdown string"), threshold=100, min_bytes=40, max_bytes=160)
    got = sorted((r.content_hash, r.section_ordinal or 0, r.output_filename, r.section_title, r.text, r.bytes) for r in found.collect())

    def plain_slug(name):
        stem = re.sub(r"(?i)\.pdf$", "", name.replace("\\", "/").rsplit("/", 1)[-1])
        ascii_ = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", ascii_).strip("-")[:80].strip("-") or "document"

    want = []
    for digest, name, text in docs:
        pieces = plain_sections(text, 40, 160) if len(text.encode()) > 100 else []
        start = f"{plain_slug(name)}--{digest[:12]}"
        if len(pieces) < 2:
            want.append((digest, 0, f"{start}.md", None, text, len(text.encode())))
            continue
        for n, (title, body) in enumerate(pieces, 1):
            short = (plain_slug(title)[:40].strip("-") or "section") if title.strip() else "section"
            want.append((digest, n, f"{start}--{n:03d}-{short}.md", title or None, body, len(body.encode())))
    assert got == sorted(want) and any(w[1] > 1 for w in want)


def test_nothing_is_shuffled_and_no_python_runs(spark):
    docs = spark.createDataFrame([("0" * 64, "é.pdf", "# a\n")], "content_hash string, filename string, markdown string")
    frames = [sections.headings(docs, "content_hash"), sections.blocks_at_top(docs, "content_hash"), sections.split_into_sections(docs, "content_hash"), sections.plan_outputs(docs, 1), fidelity.seam_tables(docs, "content_hash")]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_the_mark_and_odd_texts_pass_through(spark):
    """Texts that hold the mark itself, no line break at their end, nothing, or null."""
    mark = sections.MARK
    texts = [f"# a{mark}c\nx{mark}h\n{mark}0# no\n# b{mark}", f"{mark}{mark}", "", "#\n# ", "# only", "```\n# code", "\r\n# a\r\n\r\n## b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    got = {}
    for r in sections.split_into_sections(docs, min_bytes=1, max_bytes=10).collect():
        got.setdefault(r.doc_id, []).append((r.title, r.text))
    assert got == {n: plain_sections(t, 1, 10) for n, t in enumerate(texts) if t is not None}
    heads = {(r.doc_id, r["at"]): (r.level, r.title) for r in sections.headings(docs).collect()}
    assert heads == {(n, at): h for n, t in enumerate(texts) if t for at, h in plain_headings(t.splitlines()).items()}


def test_prose_without_marks_costs_little(spark):
    """Characters that begin neither a heading nor a fence are passed over, as in any search for a rare character."""
    import time

    from pyspark.sql import functions as F

    docs = spark.range(1).select(F.repeat(F.lit("some plain words that go on\n"), 150_000).alias("markdown")).localCheckpoint()

    def seconds(column):
        found = []
        for _ in range(3):
            start = time.monotonic()
            docs.select(F.length(column).alias("n")).collect()
            found.append(time.monotonic() - start)
        return min(found)

    plain = seconds(F.regexp_replace("markdown", "#x", ""))
    assert seconds(sections._marked(F.col("markdown"))) < 8 * plain + 0.5


def test_fences_and_headings_at_odd_places(spark):
    """Gaps before fences, runs of marks, two fences on a line, breaks of all kinds."""
    starts = ["", " ", "   ", "    ", "\t", " ", "　 ", "x", "``", "#", "# "]
    marks = ["```", "~~~", "``````", "``~", "~~`", "``` ~~~", "#", "#\t", "####### x", "###### x", "# y"]
    texts = [b.join(f"{s}{m}" for s in starts[k:] + starts[:k]) + b + "# end" for k in range(len(starts)) for m in marks for b in BREAKS] + ["a\r\n# b\r\r\n# c\n\r# d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    got = {(r.doc_id, r["at"]): (r.level, r.title) for r in sections.headings(docs).collect()}
    assert got == {(n, at): h for n, t in enumerate(texts) for at, h in plain_headings(t.splitlines()).items()}
