"""Registered queries over texts: naming, measures, sections, fidelity, intake, logs and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill import schemas
from foliomill.functions import naming, text
from foliomill.operators import fidelity, intake, sections
from foliomill.plans.derived import Derived, with_tables
from foliomill.shared import fresh_path
from foliomill.sources import files, logs
from foliomill.sources.files import conform_expectations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Small bounds, so that the derived Markdown is divided.
THRESHOLD, MIN_BYTES, MAX_BYTES = 600, 120, 700


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return keep


def raw_names(d: Derived):
    """Names such as browsers send them, from the pages' addresses."""
    return d.table("pages").select("page_id", F.concat(F.lit("C:\\in/"), F.replace("url", F.lit("?"), F.lit("\\"))).alias("raw"))


RAW = r"concat('C:\in/', replace(url, '?', '\'))"


@query("""
 SELECT s_suppkey, CAST(octet_length(encode(c)) AS BIGINT) AS size_bytes, sha256(c) AS content_hash, substr(c, 1, 1024) AS head, right(c, 8192) AS tail
 FROM (SELECT s_suppkey, concat(repeat(concat(s_name, ' '), s_suppkey % 50), s_acctbal > 0, chr(10)) AS c FROM supplier)""")
def s1_scan_uploads(d):
    """A file for each supplier, written and scanned again."""
    path = fresh_path(d.spark, "uploads")
    text = F.concat(F.repeat(F.concat("s_name", F.lit(" ")), (F.col("s_suppkey") % 50).cast("int")), (F.col("s_acctbal") > 0).cast("string"))
    rows = d.table("supplier").select("s_suppkey", text.alias("text"))
    # files are written, and put in their place, by many tasks
    tasks = max(1, min(1024, -(-rows.count() // 500)))
    rows.repartition(tasks, "s_suppkey").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(path)
    found = files.scan_uploads(d.spark, path, "part-*")
    key = F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("long")
    return found.select(key.alias("s_suppkey"), "size_bytes", "content_hash", F.col("head").cast("string").alias("head"), F.col("tail").cast("string").alias("tail"))


@query(" SELECT content_hash, original_filename, size_bytes, page_count, first_seen_at, inbox_path FROM source_document")
def s2_scan_table(d):
    """The documents written as a registry table and read with its fixed schema."""
    path = fresh_path(d.spark, "registry")
    files.write_table(schemas.conform(d.documents, "source_document"), path, "source_document", 10_000)
    return files.scan_table(d.spark, path, "source_document").withColumn("first_seen_at", F.col("first_seen_at").cast("timestamp_ntz"))


@query("""
 SELECT concat('d', doc_id) AS file, CASE WHEN doc_id % 2 = 0 THEN concat(source, ',', lang) ELSE '' END AS traits, CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS INT) END AS pages,
   CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(doc_id % 7 AS INT) END AS headings, 0 AS tables, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS needles, '' AS notes FROM documents""")
def s4_scan_expectations(d):
    """Expectations written as JSON lines, some of whose fields are left out or no numbers, and scanned."""
    path = fresh_path(d.spark, "expectations")
    even = F.col("doc_id") % 2 == 0
    rows = d.table("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.when(even, F.array("source", "lang")).alias("traits"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 3 == 1, F.lit("some")).alias("pages"),
        F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7).alias("headings"), F.when(even, F.array(F.lit("needle"))).alias("must_contain"),
    )
    rows.write.json(path)
    found = files.scan_expectations(d.spark, path)
    return found.select("file", F.array_join("traits", ",").alias("traits"), "pages", "headings", "tables", F.size("must_contain").alias("needles"), "notes")


@query(r"""
 , w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS word FROM documents)
 SELECT doc_id, sha256(string_agg(regexp_replace(strip_accents(word), '[^\x00-\x7F]', '', 'g'), ' ' ORDER BY word)) AS folded FROM (SELECT DISTINCT doc_id, word FROM w) GROUP BY doc_id""")
def u2_nfkd_fold(d):
    """The fold over the distinct Latin words of each document."""
    words = d.table("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z\x{00C0}-\x{00FF}]+"), F.lit(0)))).alias("word"))
    distinct = words.select("word").distinct()
    folded = distinct.withColumn("folded", naming.nfkd_ascii(F.col("word")))
    back = words.join(folded, "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "folded"))).alias("all"))
    return back.select("doc_id", F.sha2(F.array_join(F.transform("all", lambda x: x["folded"]), " "), 256).alias("folded"))


@query(rf"""
 SELECT page_id, CASE WHEN trim(n) = '' THEN 'document.pdf' ELSE trim(n) END AS name FROM (SELECT page_id, regexp_extract(replace({RAW}, '\', '/'), '[^/]*$') AS n FROM pages)""")
def p1_display_name(d):
    return raw_names(d).select("page_id", naming.display_name(F.col("raw")).alias("name"))


@query("""
 SELECT doc_id, CASE WHEN n > 6000 THEN concat('"d', doc_id, '" is larger than the 6 KB this converter accepts.') WHEN n = 0 THEN concat('"d', doc_id, '" is empty — there is nothing to convert.')
   WHEN doc_id % 5 = 0 THEN 'Not a PDF. Only PDF files can be converted.'
   WHEN doc_id % 7 = 0 THEN concat('"d', doc_id, '" is password-protected, so its contents cannot be read. Remove the password and upload it again.') END AS reason
 FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def p2_validate(d):
    head = F.when(F.col("doc_id") % 5 == 0, "%PDX-").otherwise("xx%PDF-1.7").cast("binary")
    tail = F.when(F.col("doc_id") % 7 == 0, "..../Encrypt 5").otherwise("%%EOF").cast("binary")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return d.table("documents").select("doc_id", intake.rejection(name, head, tail, F.octet_length("text"), 6000).alias("reason"))


@query("""
 SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '"x" is password-protected, so its contents cannot be read. Remove the password and upload it again.'
   WHEN n_chars % 13 = 0 THEN '"x" could not be read — the file looks damaged or incomplete. Try re-saving or re-exporting it, then upload it again.'
   WHEN n_chars > 3000 THEN concat('"x" has ', format('{:,}', n_chars), ' pages, more than the 3,000 this converter accepts in one document. Split it into smaller files and upload those.') END AS verdict FROM documents""")
def p3_page_gate(d):
    pages = F.when(F.col("n_chars") % 13 > 0, F.col("n_chars"))
    return d.table("documents").select("doc_id", intake.page_rejection(F.lit("x"), pages, F.col("doc_id") % 11 == 0, 3000).alias("verdict"))


@query(" SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p4_content_identity(d):
    return d.table("documents").select("doc_id", intake.content_hash(F.col("text").cast("binary")).alias("content_hash"))


SLUG = "coalesce(nullif(trim(substr(trim(regexp_replace(lower(regexp_replace({0}, '(?i)\\.pdf$', '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, {1}), '-'), ''), '{2}')"


@query(f" SELECT doc_id, concat({SLUG.format('source', 80, 'document')}, '--', substr(sha256(text), 1, 12), '.md') AS output_filename FROM documents")
def p18_output_filename(d):
    return d.table("documents").select("doc_id", naming.output_filename(naming.slug(F.col("source")), F.sha2("text", 256)).alias("output_filename"))


@query(rf" SELECT page_id, {SLUG.format("regexp_extract(replace(" + RAW + r", '\', '/'), '[^/]*$')", 80, 'document')} AS slug FROM pages")
def p17_slug(d):
    return raw_names(d).select("page_id", naming.slug(F.col("raw")).alias("slug"))


@query(f"""
 SELECT doc_id, concat('s--', substr(sha256(text), 1, 12), '--', printf('%03d', doc_id % 1200), '-', CASE WHEN trim(title) = '' THEN 'section' ELSE {SLUG.format("title", 40, "section")} END, '.md') AS name
 FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE concat(source, ' - Part ', n_chars, '!') END AS title FROM documents)""")
def p19_section_filename(d):
    title = F.when(F.col("doc_id") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.col("source"), F.lit(" - Part "), F.col("n_chars").cast("string"), F.lit("!")))
    return d.table("documents").select("doc_id", naming.section_filename(F.lit("s"), F.sha2("text", 256), (F.col("doc_id") % 1200).cast("int"), title, naming.slug(title)).alias("name"))


COUNTS = r"""
   len(regexp_extract_all(markdown, '(?m)^#{1,6}\s+\S')) AS headings,
   len(regexp_extract_all(markdown, '(?m)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$')) AS tables,
   len(regexp_extract_all(markdown, '(?i)!\[[^\]]*\]\([^)]*\)|<!--\s*image\s*-->')) AS figures"""


@query(f"""
 SELECT doc_id, headings, tables, figures, figures = 0 OR trim(regexp_extract(markdown, '(?s)^.*(?:!\\[[^\\]]*\\]\\([^)]*\\))(.*)$', 1), ' ' || chr(10) || chr(13) || chr(9)) <> '' AS figures_in_position
 FROM (SELECT doc_id, markdown, {COUNTS} FROM markdown_doc)""")
def t9_t12_structure_counts(d):
    return fidelity.structure_counts(d.markdown).select("doc_id", "headings", "tables", "figures", "figures_in_position")


@query("""
 , docs AS (SELECT doc_id, markdown, CASE WHEN doc_id % 3 = 0 THEN ['# Doc', 'zzzz', 'REPLACE ME', ''] ELSE ['| a | b |', 'qqqq'] END AS needles FROM markdown_doc)
 SELECT doc_id, array_to_string(list_concat(list_filter(needles, lambda n: n <> '' AND NOT starts_with(n, 'REPLACE ME') AND NOT contains(markdown, n)),
   CASE WHEN len(regexp_extract_all(markdown, '(?i)!\\[[^\\]]*\\]\\([^)]*\\)')) > 0 AND trim(regexp_extract(markdown, '(?s)^.*(?:!\\[[^\\]]*\\]\\([^)]*\\))(.*)$', 1), ' ' || chr(10) || chr(13) || chr(9)) = '' THEN ['<figures appear only after the text>'] ELSE [] END), '|') AS missing
 FROM docs""")
def t13_missing_content(d):
    needles = F.when(F.col("doc_id") % 3 == 0, F.array(*[F.lit(x) for x in ("# Doc", "zzzz", "REPLACE ME", "")])).otherwise(F.array(F.lit("| a | b |"), F.lit("qqqq")))
    return d.markdown.select("doc_id", F.array_join(fidelity.missing_content(F.col("markdown"), needles, F.lit(1)), "|").alias("missing"))


LINES = r" , l AS (SELECT doc_id, unnest(string_split(rtrim(markdown, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(markdown, chr(10)), chr(10)), 1) AS ln FROM markdown_doc)"


SEAMS = r"""
 , p AS (SELECT *, last_value(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS prev FROM l)
 , seams AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$') AND coalesce(regexp_matches(prev, '^\s*\|'), false)) AS seam_tables FROM p GROUP BY doc_id)"""


@query(LINES + SEAMS + " SELECT doc_id, seam_tables FROM seams")
def w7_seam_tables(d):
    return fidelity.seam_tables(d.markdown)


ASCII_TITLE = r"regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')"
#: The derived Markdown with code fences before lines that begin with M to P, and another first line. Fences and headings of it as SQL, line by line.
FENCED = r"""
 , fenced AS (SELECT doc_id, source, regexp_replace(regexp_replace(markdown, '(?m)^([M-P])', '```' || chr(10) || '\\1', 'g'), '(?m)^# Doc [0-9]+', 'Doc') AS md FROM markdown_doc)
 , cut AS (SELECT doc_id, md, string_split(md, chr(10)) AS ls FROM fenced)
 , l AS (SELECT doc_id, ln, line, CASE WHEN ln < n THEN line || chr(10) ELSE line END AS raw
         FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln, len(ls) AS n FROM cut) WHERE ln < n OR line <> '')
 , f AS (SELECT *, regexp_matches(line, '^\\s{0,3}(```|~~~)') AS fence, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l)
 , par AS (SELECT *, count(*) FILTER (WHERE fence) OVER (PARTITION BY doc_id ORDER BY ln) AS fences FROM f)
 , h AS (SELECT *, CASE WHEN NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^#{1,6}\\s') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level,
                regexp_extract(line, '^(#{1,6})\\s+(.*?)\\s*#*\\s*$', 2) AS title FROM par)
 , t AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS top FROM h)
 , b AS (SELECT *, count(*) FILTER (WHERE level = top) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM t)
 , kept AS (SELECT * FROM (SELECT *, bool_and(blank) OVER (PARTITION BY doc_id, block) AS empty, sum(strlen(raw)) OVER (PARTITION BY doc_id, block) AS bytes FROM b)
            WHERE top IS NULL OR block > 0 OR NOT empty)""".replace("\\\\", "\\")

#: T5-T7 over those lines: blocks into groups, groups into pieces, an untitled first piece to the next.
SECTIONS = FENCED + f"""
 , grouped AS (SELECT *, max(CASE WHEN block = first_block OR bytes >= {MIN_BYTES} THEN block END) OVER (PARTITION BY doc_id ORDER BY ln) AS grp
               FROM (SELECT *, min(block) OVER (PARTITION BY doc_id) AS first_block FROM kept))
 , inner_fences AS (SELECT *, sum(strlen(raw)) OVER w AS grp_bytes, first_value(CASE WHEN level = top THEN title ELSE '' END) OVER (w ORDER BY ln) AS grp_title,
                           count(*) FILTER (WHERE fence) OVER (w ORDER BY ln) AS own_fences FROM grouped WINDOW w AS (PARTITION BY doc_id, grp))
 , inner_levels AS (SELECT *, CASE WHEN NOT fence AND own_fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}}\\s') THEN length(regexp_extract(line, '^(#+)', 1)) END AS own_level FROM inner_fences)
 , divided AS (SELECT *, CASE WHEN grp_bytes > {MAX_BYTES} THEN min(own_level) FILTER (WHERE own_level > top) OVER (PARTITION BY doc_id, grp) END AS cut_level FROM inner_levels)
 , numbered AS (SELECT *, count(*) FILTER (WHERE own_level = cut_level) OVER (PARTITION BY doc_id, grp ORDER BY ln) AS piece FROM divided)
 , filled AS (SELECT * FROM (SELECT *, bool_and(blank) OVER (PARTITION BY doc_id, grp, piece) AS void FROM numbered) WHERE cut_level IS NULL OR piece > 0 OR NOT void)
 , named AS (SELECT *, coalesce(max(CASE WHEN own_level = cut_level THEN title END) OVER (PARTITION BY doc_id, grp, piece), '') AS piece_title,
                    min(piece) OVER (PARTITION BY doc_id, grp) AS first_piece, max(piece) OVER (PARTITION BY doc_id, grp) AS last_piece FROM filled)
 , ridden AS (SELECT *, piece = first_piece AND piece_title = '' AND last_piece > first_piece AND cut_level IS NOT NULL AS rides FROM named)
 , sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, piece) AS ordinal, title, body FROM (
      SELECT doc_id, grp, CASE WHEN rides THEN piece + 1 ELSE piece END AS piece, coalesce(nullif(max(CASE WHEN NOT rides THEN piece_title END), ''), min(grp_title), '') AS title, string_agg(raw, '' ORDER BY ln) AS body
      FROM ridden GROUP BY 1, 2, 3))"""


def fenced_markdown(d):
    fenced = F.regexp_replace("markdown", "(?m)^([M-P])", "```\n$1")
    return d.markdown.withColumn("markdown", F.regexp_replace(fenced, r"(?m)^# Doc [0-9]+", "Doc"))


@query(FENCED + " SELECT doc_id, CAST(ln - 1 AS INT) AS line_number, level, title FROM h WHERE level IS NOT NULL")
def w5_headings(d):
    return sections.headings(fenced_markdown(d)).withColumnRenamed("at", "line_number")


@query(FENCED + """
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) AS INT) AS block, title, md5(body) AS text_md5
 FROM (SELECT doc_id, block, coalesce(max(CASE WHEN level = top THEN title END), '') AS title, string_agg(raw, '' ORDER BY ln) AS body FROM kept GROUP BY doc_id, block)""")
def w6_blocks(d):
    return sections.blocks_at_top(fenced_markdown(d)).select("doc_id", "block", "title", F.md5("text").alias("text_md5"))


@query(SECTIONS + " SELECT doc_id, CAST(ordinal AS INT) AS ordinal, title, md5(body) AS text_md5, CAST(strlen(body) AS INT) AS bytes FROM sections")
def t5_t7_sections(d):
    found = sections.split_into_sections(fenced_markdown(d), min_bytes=MIN_BYTES, max_bytes=MAX_BYTES)
    return found.select("doc_id", "ordinal", "title", F.md5("text").alias("text_md5"), F.octet_length("text").alias("bytes"))


@query(SECTIONS + f"""
 , counted AS (SELECT s.*, md, source, count(*) OVER (PARTITION BY doc_id) > 1 AND strlen(md) > {THRESHOLD} AS many FROM sections s JOIN fenced USING (doc_id))
 , texts AS (SELECT doc_id, md, source, many, ordinal, title, CASE WHEN many THEN body ELSE md END AS body FROM counted WHERE many OR ordinal = 1)
 SELECT sha256(doc_id::VARCHAR) AS content_hash, sha256(body) AS text_sha256, CAST(strlen(body) AS BIGINT) AS bytes, CASE WHEN many THEN CAST(ordinal AS INT) END AS section_ordinal,
        CASE WHEN many THEN nullif(title, '') END AS section_title,
        concat({SLUG.format('source', 80, 'document')}, '--', substr(sha256(doc_id::VARCHAR), 1, 12),
               CASE WHEN many THEN concat('--', printf('%03d', ordinal), '-', CASE WHEN trim(title) = '' THEN 'section' ELSE {SLUG.format(ASCII_TITLE, 40, 'section')} END) ELSE '' END, '.md') AS output_filename
 FROM texts""")
def t8_plan_outputs(d):
    docs = fenced_markdown(d).select(F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"), F.col("source").alias("filename"), "markdown")
    files = sections.plan_outputs(docs, THRESHOLD, MIN_BYTES, MAX_BYTES)
    return files.select("content_hash", F.sha2("text", 256).alias("text_sha256"), "bytes", "section_ordinal", "section_title", "output_filename")


@query("""
 SELECT o.output_filename FROM markdown_output o JOIN source_document s USING (content_hash) WHERE s.first_doc % 2 = 0 AND coalesce(o.section_ordinal, 9) > 1 AND o.section_ordinal IS NOT NULL""")
def j5_superseded(d):
    fresh = d.outputs.join(d.documents.where("first_doc % 2 = 0").select("content_hash"), "content_hash").where("section_ordinal IS NULL OR section_ordinal = 1")
    return sections.superseded_outputs(d.outputs, fresh).select("output_filename")


def expected(d: Derived):
    """An expectation per document: what the text's line starts promise, and a needle that half of them lack."""
    starts = lambda letters: F.regexp_count("text", F.lit(rf"(?m)^[{letters}]"))
    needle = F.when(F.col("doc_id") % 2 == 0, F.lit("# Doc")).otherwise(F.lit("REPLACE ME"))
    rows = d.markdown.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.array(F.col("source"), F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("traits"), F.col("n_chars").cast("string").alias("pages"),
        (starts("A-D") + 1 + F.col("doc_id") % 3).cast("int").alias("headings"), starts("E-H").alias("tables"), starts("I-L").alias("figures"), F.array(needle).alias("must_contain"), F.lit(None).cast("string").alias("notes"),
    )
    return conform_expectations(rows)


def results(d: Derived):
    """Results of the documents that reached the corpus."""
    states = F.array(*[F.lit(s) for s in ("succeeded", "failed", "succeeded_incomplete", "succeeded_suspect", "timed_out")])
    state = F.element_at(states, (F.col("doc_id") % 5 + 1).cast("int"))
    return d.markdown.where("doc_id % 13 <> 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), state.alias("status"), F.lit(1.5).alias("seconds"), "markdown", F.lit(None).cast("string").alias("failure_reason"), (1 + F.col("doc_id") % 3).cast("int").alias("attempt"))


MEASURED = rf"""
 , c AS (SELECT doc_id, markdown, text, {COUNTS},
     len(regexp_extract_all(text, '(?m)^[A-D]')) + 1 + doc_id % 3 AS eh, len(regexp_extract_all(text, '(?m)^[E-H]')) AS et, len(regexp_extract_all(text, '(?m)^[I-L]')) AS ef,
     CASE WHEN doc_id % 13 = 0 THEN 'missing_from_corpus' ELSE ['succeeded', 'failed', 'succeeded_incomplete', 'succeeded_suspect', 'timed_out'][doc_id % 5 + 1] END AS status FROM markdown_doc)
 , m AS (SELECT *, status IN ('succeeded', 'succeeded_incomplete', 'succeeded_suspect') AS converted,
     ef > 0 AND trim(regexp_extract(markdown, '(?s)^.*(?:!\[[^\]]*\]\([^)]*\))(.*)$', 1), ' ' || chr(10) || chr(13) || chr(9)) = '' AND figures > 0 AS trail FROM c)"""


@query(LINES + SEAMS + MEASURED + """
 SELECT concat('d', doc_id) AS file, status, converted, CASE WHEN converted THEN headings ELSE 0 END AS headings_found, CASE WHEN converted THEN tables ELSE 0 END AS tables_found,
   CASE WHEN converted THEN figures ELSE 0 END AS figures_found, CASE WHEN converted THEN seam_tables ELSE 0 END AS seam_tables,
   CASE WHEN converted AND trail THEN '<figures appear only after the text>' ELSE '' END AS missing FROM m JOIN seams USING (doc_id)""")
def j9_measure(d):
    found = fidelity.measure(expected(d), results(d))
    return found.select("file", "status", "converted", "headings_found", "tables_found", "figures_found", F.col("seam_tables").cast("long").alias("seam_tables"), F.array_join("missing_strings", "|").alias("missing"))


@query(MEASURED + """
 SELECT count(*) FILTER (WHERE status <> 'missing_from_corpus') AS runnable, count(*) FILTER (WHERE converted) AS converted,
   count(*) FILTER (WHERE converted) / count(*) FILTER (WHERE status <> 'missing_from_corpus') AS success_rate,
   count(*) FILTER (WHERE converted AND doc_id % 3 = 0) / count(*) FILTER (WHERE status <> 'missing_from_corpus') AS first_try_rate,
   sum(least(headings, eh)) FILTER (WHERE converted) / sum(eh) FILTER (WHERE converted) AS heading_recall, sum(least(tables, et)) FILTER (WHERE converted) / sum(et) FILTER (WHERE converted) AS table_recall,
   sum(least(figures, ef)) FILTER (WHERE converted) / sum(ef) FILTER (WHERE converted) AS figure_recall, count(*) FILTER (WHERE converted AND NOT trail) AS clean FROM m""")
def a10_fidelity_summary(d):
    return fidelity.summary(fidelity.measure(expected(d), results(d))).select("runnable", "converted", "success_rate", "first_try_rate", "heading_recall", "table_recall", "figure_recall", "clean")


@query(MEASURED + """
 , s AS (SELECT count(*) FILTER (WHERE converted) / count(*) FILTER (WHERE status <> 'missing_from_corpus') AS a, sum(least(headings, eh)) FILTER (WHERE converted) / sum(eh) FILTER (WHERE converted) AS b,
     sum(least(tables, et)) FILTER (WHERE converted) / sum(et) FILTER (WHERE converted) AS c, CASE WHEN count(*) FILTER (WHERE status = 'missing_from_corpus') = 0 THEN 1.0 ELSE 0.0 END AS d FROM m)
 SELECT gate, value, bar, value >= bar AS passed FROM (SELECT 'success rate' AS gate, a AS value, CAST(0.9 AS DOUBLE) AS bar FROM s UNION ALL SELECT 'heading recall', b, 0.95 FROM s
   UNION ALL SELECT 'table recall', c, 0.9 FROM s UNION ALL SELECT 'documents present', d, 1.0 FROM s)""")
def c2_evaluate_corpus(d):
    return fidelity.gates(fidelity.summary(fidelity.measure(expected(d), results(d))))


@query("""
 SELECT trait, 100 AS needed, count(*) AS documents, count(*) >= 100 AS met FROM (SELECT source AS trait FROM documents UNION ALL SELECT CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END FROM documents) GROUP BY trait""")
def a11_trait_coverage(d):
    e = expected(d)
    minima = e.select(F.explode("traits").alias("trait")).distinct().withColumn("needed", F.lit(100))
    return fidelity.trait_coverage(e, minima)


@query("""
 SELECT event_id, event_type AS said, concat('job-', event_id) AS job_id, concat('f ', user_id, '.pdf') AS file, CAST(user_id AS VARCHAR) AS attempt, 'two words' AS reason, event_id % 10 > 0 AS parse_ok FROM events""")
def s5_parse_logs(d):
    e = d.table("events")
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("2024-01-01 INFO job_failed job_id=job-"), text("event_id"), F.lit(' file="f '), text("user_id"), F.lit('.pdf" attempt='), text("user_id"), F.lit(' kind="'), F.col("event_type"), F.lit('" reason="two words"'), F.when(F.col("event_id") % 10 == 0, F.lit(' oops "rest')).otherwise(F.lit("")))
    parsed = logs.parse_log_lines(e.select(line.alias("value")))
    return parsed.select(F.regexp_extract("job_id", r"(\d+)", 1).cast("long").alias("event_id"), F.col("fields")["kind"].alias("said"), "job_id", "file", F.col("fields")["attempt"].alias("attempt"), F.col("fields")["reason"].alias("reason"), "parse_ok")


@query("""
 SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 2 THEN '' ELSE source END AS markdown, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 2 THEN 'failure' ELSE 'success' END AS status,
   CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS n_errors, CASE WHEN doc_id % 4 = 1 THEN 2.5 END AS processing_time, CASE WHEN doc_id % 4 = 1 THEN n_chars END AS page_count, doc_id % 4 = 0 AS corrupt FROM documents""")
def s6_parse_results(d):
    body = (
        F.when(F.col("doc_id") % 4 == 0, F.lit('{"document": {"md_con'))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"document":{"md_content":"'), F.col("source"), F.lit('","page_count":'), F.col("n_chars").cast("string"), F.lit('},"status":"success","errors":["e"],"processing_time":2.5}')))
        .when(F.col("doc_id") % 4 == 2, F.lit("{}"))
        .otherwise(F.concat(F.lit('{"document":{"md_content":"'), F.col("source"), F.lit('"},"status":"success"}')))
    )
    rows = logs.parse_results(d.table("documents").select("doc_id", body.alias("body")))
    return rows.select("doc_id", "markdown", "status", F.size("errors").alias("n_errors"), "processing_time", "page_count", "corrupt")
