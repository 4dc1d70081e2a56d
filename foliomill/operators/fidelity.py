"""Fidelity: counts of a document's structure against what is expected of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import states
from foliomill.functions.text import count_figures, count_headings, count_seam_tables, count_tables, figures_in_position

# The gates of a run.
FIRST_ATTEMPT_GATE, HEADING_GATE, TABLE_GATE = 0.90, 0.95, 0.90
PLACEHOLDER = "REPLACE ME"
TRAILING_FIGURES = "<figures appear only after the text>"


def structure_counts(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Docs with headings, tables, figures and figures_in_position; one pass over the text."""
    md = F.col(markdown)
    return docs.withColumns({"headings": count_headings(md), "tables": count_tables(md), "figures": count_figures(md), "figures_in_position": figures_in_position(md)})


def seam_tables(docs: DataFrame, key: str = "doc_id", markdown: str = "markdown") -> DataFrame:
    """Per document the tables that only blank lines part from a table before them."""
    return docs.select(key, count_seam_tables(F.col(markdown)).alias("seam_tables"))


def missing_content(markdown: Column, must_contain: Column, figures: Column) -> Column:
    """The expected strings that are not there, and an entry where expected figures only trail."""
    absent = F.filter(must_contain, lambda n: (n != "") & ~n.startswith(PLACEHOLDER) & ~F.contains(markdown, n))
    trail = F.when((figures > 0) & ~figures_in_position(markdown), F.array(F.lit(TRAILING_FIGURES))).otherwise(F.array().cast("array<string>"))
    return F.concat(absent, trail)


def measure(expectations: DataFrame, results: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Each expectation (file, headings, tables, figures, must_contain) with its measurement.

    results: file, status, seconds, markdown, failure_reason, and attempt (else 1). A file without a
    result is missing_from_corpus. strict_reference leaves documents with missing pages unconverted, as the
    harness this follows does.
    """
    good = [s for s in states.DOWNLOADABLE if not (strict_reference and s == "succeeded_incomplete")]
    attempt = F.coalesce("attempt", F.lit(1)) if "attempt" in results.columns else F.lit(1)
    found = results.select("file", F.col("status").alias("__status"), "seconds", "markdown", "failure_reason", attempt.alias("attempt"))
    joined = expectations.join(found, "file", "left").withColumn("status", F.coalesce("__status", F.lit("missing_from_corpus")))
    converted = F.col("status").isin(*good)
    md = F.when(converted, F.coalesce("markdown", F.lit("")))
    return joined.select(
        *expectations.columns,
        "status",
        converted.alias("converted"),
        "seconds",
        "failure_reason",
        "attempt",
        F.coalesce(count_headings(md), F.lit(0)).alias("headings_found"),
        F.coalesce(count_tables(md), F.lit(0)).alias("tables_found"),
        F.coalesce(count_figures(md), F.lit(0)).alias("figures_found"),
        F.coalesce(count_seam_tables(md), F.lit(0)).alias("seam_tables"),
        F.when(converted, missing_content(md, F.col("must_contain"), F.col("figures"))).otherwise(F.array().cast("array<string>")).alias("missing_strings"),
    )


def summary(measured: DataFrame) -> DataFrame:
    """A10: one row of rates, recalls and counts; a recall is null where nothing was expected.

    success_rate counts documents whatever their attempt, first_try_rate those that needed only one.
    """
    ok, here = F.col("converted"), F.col("status") != "missing_from_corpus"
    wanted = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    found = lambda c: F.coalesce(F.sum(F.when(ok, F.least(F.col(f"{c}_found"), F.col(c)))), F.lit(0))
    sums = measured.agg(
        F.count_if(here).alias("runnable"),
        F.count_if(~here).alias("missing"),
        F.count_if(ok).alias("converted"),
        F.count_if(ok & (F.col("attempt") == 1)).alias("first_try"),
        *[wanted(c).alias(f"{c}_expected") for c in ("headings", "tables", "figures")],
        *[found(c).alias(f"{c}_met") for c in ("headings", "tables", "figures")],
        F.coalesce(F.sum(F.when(ok, F.col("seam_tables"))), F.lit(0)).alias("seam_tables"),
        F.count_if(ok & (F.size("missing_strings") == 0)).alias("clean"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return sums.withColumns(
        {
            "success_rate": ratio("converted", "runnable"),
            "first_try_rate": ratio("first_try", "runnable"),
            "heading_recall": ratio("headings_met", "headings_expected"),
            "table_recall": ratio("tables_met", "tables_expected"),
            "figure_recall": ratio("figures_met", "figures_expected"),
            "seam_share": F.coalesce(ratio("seam_tables", "tables_met"), F.lit(0.0)),
        }
    )


def gates(summed: DataFrame) -> DataFrame:
    """A10: (gate, value, bar, passed) of a summary; without a value a gate passes, a missing document fails the run."""
    rows = summed.selectExpr(
        f"stack(4, 'success rate', success_rate, {FIRST_ATTEMPT_GATE}D, 'heading recall', heading_recall, {HEADING_GATE}D, 'table recall', table_recall, {TABLE_GATE}D, "
        "'documents present', if(missing = 0, 1D, 0D), 1D) AS (gate, value, bar)"
    )
    return rows.withColumn("passed", F.col("value").isNull() | (F.col("value") >= F.col("bar")))


def trait_coverage(expectations: DataFrame, minima: DataFrame) -> DataFrame:
    """Documents per trait against the least number asked for (minima: trait, needed)."""
    counted = expectations.select(F.explode(F.array_distinct("traits")).alias("trait")).groupBy("trait").agg(F.count("*").alias("documents"))
    return minima.join(counted, "trait", "left").select("trait", "needed", F.coalesce("documents", F.lit(0)).alias("documents")).withColumn("met", F.col("documents") >= F.col("needed"))
