"""License scans by diagonal voting.

Every rolling pair of words of a text is joined to the positions at which it stands in the license
templates. Each hit votes for a diagonal, text position minus template position. Phrases are voted for
by their pairs: a diagonal on which every pair of a phrase votes is a place of that phrase. Notices,
which are longer, are voted for by all their triples: the pair finds the position, and the third word
must agree too. Their neighbouring diagonals are merged, so that a few words put in or left out do no
harm, and a span stands if its votes cover enough of the notice within its length.

Only DataFrame functions are used. Notices are a table (text, label) of texts of any length; it is
broadcast in parts of about BROADCAST_POSITIONS words, each of which meets all texts in turn, so texts
and their words are never shuffled, and no frequent pair meets in one task.

Defined results: null texts count as empty; a text without words has n_words 0, no places, empty
labels and score 0. Rows that repeat doc_id and text each get the same result. An empty table gives
an empty result; columns other than doc_id and text are not looked at. Notices under three words never
match; those that repeat text and label count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm.common import LOWER, UPPER, text_or_empty, written

#: A word before its A-Z are lower-cased: everything but ASCII that is neither letter nor digit.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the base contract: phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening or defining sentences of well-known licenses.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
)
#: Words of all notices that are broadcast together.
BROADCAST_POSITIONS = 500_000
#: Spans whose votes cover at least this share of a notice's triples stand.
COVERAGE = 0.6
#: Diagonals this near belong to one span: so many words may be put in or left out at a place.
SLACK = 3
#: Stands at the end of each text's pairs, so that each text has a row; no word holds this character.
END = "\x00"


def notice_table(spark: SparkSession) -> DataFrame:
    """The notices of this module as a table."""
    return _constants(spark, list(NOTICES), ["text", "label"])


def _constants(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])
    return spark.range(1).select(F.inline(values))


def _templates(spark: SparkSession, notices: DataFrame) -> DataFrame:
    """Rows (template, label, length, voting, words): phrases count from 0, notices are named by a hash; -1 stands for texts' ends."""
    rows = [(n, label, text) for n, (text, label) in enumerate(PHRASES)]
    phrases = _constants(spark, rows, ["template", "label", "text"]).withColumn("template", F.col("template").cast("long"))
    words = lambda: F.regexp_extract_all(_lower(F.col("text")), F.lit(WORD), F.lit(0))
    own = notices.where("text IS NOT NULL AND label IS NOT NULL").select("text", "label").distinct()
    named = own.withColumn("template", F.xxhash64("text", "label").bitwiseOR(F.lit(1 << 32)))  # never the number of a phrase
    named = named.select("template", "label", words().alias("words")).where(F.size("words") >= 3)
    phrases = phrases.select("template", "label", words().alias("words"))
    return phrases.unionByName(named).withColumn("length", F.size("words")).withColumn("voting", F.col("length") - F.when(_phrase(), 1).otherwise(2))


def _lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else, in templates and texts alike."""
    return F.translate(text, UPPER, LOWER)


def _phrase() -> Column:
    return F.col("template").between(0, len(PHRASES) - 1)


def _positions(templates: DataFrame) -> DataFrame:
    """(template, at, pair, third, h) of all voting positions; third is null in phrases."""
    words = F.filter(F.transform("words", lambda w, n: F.struct(n.alias("at"), F.concat_ws(" ", w, F.get("words", n + 1)).alias("pair"), F.when(~_phrase(), F.get("words", n + 2)).alias("third"))), lambda x: x["at"] < F.col("voting"))
    ends = templates.sparkSession.range(1).select(F.lit(-1).cast("long").alias("template"), F.lit(0).alias("at"), F.lit(END).alias("pair"), F.lit(None).cast("string").alias("third"))
    return templates.select("template", F.inline(words)).unionByName(ends).withColumn("h", F.xxhash64(F.lower("pair")))


def pair_votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per hit: the text's key, template, template position and diagonal; texts' ends too."""
    positions = _positions(templates)
    turns = -(-templates.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // BROADCAST_POSITIONS) or 1
    text = text_or_empty()
    words = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    sized = words.withColumn("n_words", F.size("words").cast("long"))
    shorter = F.greatest(F.col("n_words") - 1, F.lit(0)).cast("int")
    pairs = F.zip_with(F.slice("words", F.lit(1), shorter), F.slice("words", F.lit(2), shorter), lambda a, b: F.concat(a, F.lit(" "), b))
    said = F.arrays_zip(F.array_append(pairs, F.lit(END)).alias("said"), F.slice("words", F.lit(3), F.greatest(F.col("n_words"), F.lit(1)).cast("int")).alias("next"))
    placed = sized.select("doc_id", "text_hash", "n_words", F.posexplode(said).alias("pos", "both")).select("doc_id", "text_hash", "n_words", "pos", "both.said", "both.next")
    hashed = placed.withColumn("h", F.xxhash64(F.lower("said")))
    hits = hashed.join(F.broadcast(positions), "h")
    if turns > 1:
        positions = written(positions.withColumn("turn", F.pmod(F.xxhash64("template", "at"), F.lit(turns))), "positions")
        each = [hashed.join(F.broadcast(positions.where(F.col("turn") == k).drop("turn")), "h") for k in range(turns)]
        hits = reduce(DataFrame.unionByName, each)
    # hashes find, words decide
    agree = (_lower(F.col("said")) == F.col("pair")) & (F.col("third").isNull() | (_lower(F.col("next")) == F.col("third")))
    return hits.where(agree).select("doc_id", "text_hash", "n_words", "template", "at", (F.col("pos") - F.col("at")).cast("long").alias("diagonal"))


def license_spans(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """Verified spans, and one row of template -1 per text: key, template, label, start, stop, score, copies."""
    spark = docs.sparkSession
    templates = _templates(spark, notice_table(spark) if notices is None else notices)
    key = ["doc_id", "text_hash", "n_words"]
    wide = F.when(_phrase(), 2).otherwise(3)
    lines = pair_votes(docs, templates).groupBy(*key, "template", "diagonal").agg(
        F.collect_set("at").alias("ats"),
        F.min(F.col("diagonal") + F.col("at")).alias("first"),
        F.max(F.col("diagonal") + F.col("at") + wide).alias("stop"),
        F.count("*").alias("copies"),
    )
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    # phrases and ends stand on one diagonal; notices may slip a little
    notice = ~_phrase() & (F.col("template") != -1)
    opens = F.when(notice & (F.col("diagonal") - F.lag("diagonal").over(along) <= SLACK), 0).otherwise(1)
    banded = lines.withColumn("opens", opens).withColumn("band", F.sum("opens").over(along))
    spans = banded.groupBy(*key, "template", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("diagonal").alias("diagonal"), F.min("first").alias("first"), F.max("stop").alias("stop"), F.max("copies").alias("copies")
    )
    ends = spark.range(1).select(F.lit(-1).cast("long").alias("template"), F.lit("").alias("label"), F.lit(0).alias("length"), F.lit(1).alias("voting"))
    notes = templates.select("template", "label", "length", "voting").unionByName(ends)
    spans = spans.join(notes, "template")
    score = F.col("votes") / F.col("voting")
    fits = F.col("stop") - F.col("first") <= F.col("length") + 2 * SLACK
    stands = F.when(notice, (score >= COVERAGE) & fits).otherwise(F.col("votes") == F.col("voting"))
    start = F.when(notice, F.col("first")).otherwise(F.col("diagonal"))
    return spans.where(stands).select(*key, "template", "label", start.alias("start"), "stop", score.cast("double").alias("score"), "copies")


def scan_licenses(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    end, base = F.col("template") == -1, _phrase()
    labels = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    found = license_spans(docs, notices).groupBy("doc_id", "text_hash", "n_words").agg(
        F.max(F.when(end, F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(~end).alias("labels"),
        F.coalesce(F.max(F.when(~end, F.col("score"))), F.lit(0.0)).alias("score"),
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.withColumn("again", again).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
