"""Token counts by offset mapping.

A document is encoded once, as a whole; its tokens' character spans are then joined to the spans of
its sections, both sorted by offset (an interval join inside the document). Words that lie within
one section are counted whole; only words across a boundary are taken apart into tokens. A token
across a boundary is allocated by one explicit rule:

* ``start``: to the section that holds its first character;
* ``largest``: to the section that holds most of its characters, the earlier one on a tie;
* ``split``: to all its sections, in shares of its characters.

A token that holds part of a character's bytes counts as spanning that character. Counts of a
document add up to the tokens of its whole text under every rule.

Defined results: a null or empty text has one empty section without tokens. Characters outside all
given sections belong to section -1. Rows that repeat a document are each attributed. An empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.bpe import ByteBpe, Coded, slices, vocabulary

RULES = ("start", "largest", "split")


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and starts of the lines of text; a line holds its line feed."""
    starts = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.arange(len(starts)), np.array(starts)


def cover(spans: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and starts of contiguous pieces that cover a text; gaps between spans have number -1.

    Spans are (start, stop), numbered as given; where spans overlap, the one that starts first wins.
    """
    numbers, starts, at = [], [], 0
    for n in sorted(range(len(spans)), key=lambda n: spans[n]):
        start, stop = max(spans[n][0], at), min(spans[n][1], length)
        if stop <= start:
            continue
        if start > at:
            numbers.append(-1)
            starts.append(at)
        numbers.append(n)
        starts.append(start)
        at = stop
    if at < length or not starts:
        numbers.append(-1)
        starts.append(at)
    return np.array(numbers), np.array(starts)


def token_spans(bpe: ByteBpe, word: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of a word, from the word's start."""
    raw = np.frombuffer(word.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum([len(bpe.token_bytes[i]) for i in ids])
    return char[np.r_[0, ends[:-1]]], char[ends - 1] + 1


def attribute(bpe: ByteBpe, text: str, coded: Coded, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece that begins at starts: its tokens, and how many of them cross its boundaries."""
    sizes, counts = coded.sizes, coded.counts
    ends, last_ids = np.cumsum(sizes), np.cumsum(counts)
    first = np.searchsorted(starts, ends - sizes, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    whole = first == last
    tokens = np.bincount(first[whole], counts[whole], len(starts)).astype(float)
    crossing = np.zeros(len(starts), np.int64)
    for w in np.flatnonzero(~whole):
        a, b = token_spans(bpe, text[ends[w] - sizes[w] : ends[w]], coded.ids[last_ids[w] - counts[w] : last_ids[w]])
        for begin, stop in zip((a + ends[w] - sizes[w]).tolist(), (b + ends[w] - sizes[w]).tolist()):
            low, high = np.searchsorted(starts, [begin, stop - 1], "right") - 1
            if low == high:
                tokens[low] += 1
                continue
            edges = np.r_[begin, starts[low + 1 : high + 1], stop]
            shares = np.diff(edges)
            if rule == "split":
                tokens[low : high + 1] += shares / shares.sum()
                crossing[low : high + 1] += 1
            else:
                to = low if rule == "start" else low + int(np.argmax(shares))
                tokens[to] += 1
                crossing[to] += 1
    return tokens, crossing


SCHEMA = "doc_id long, section int, start long, stop long, n_tokens double, n_crossing long"


def section_tokens(docs: DataFrame, tokenizer_file: str, rule: str = "largest", spans: str | None = None) -> DataFrame:
    """Rows (doc_id, section, start, stop, n_tokens, n_crossing), one per section of each document.

    spans names a column of array<struct<start,stop>> (in characters); without it, lines are sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_file)
        for rows in slices(batches):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            given = rows.column("spans").to_pylist() if spans else [None] * len(texts)
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, text, own, coded in zip(range(len(texts)), texts, given, bpe.encode_words(texts)):
                numbers, starts = cover([(s["start"], s["stop"]) for s in own or []], len(text)) if spans else line_spans(text)
                tokens, crossing = attribute(bpe, text, coded, starts, rule)
                stops = np.r_[starts[1:], len(text)]
                for into, column in zip(parts, (np.full(len(starts), doc), numbers, starts, stops, tokens, crossing)):
                    into.append(column)
            flat = [np.concatenate(p) for p in parts] if texts else [np.empty(0, int)] * 6
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(flat[0], pa.int64())), *[pa.array(c, t) for c, t in zip(flat[1:], (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))]],
                ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"],
            )

    wanted = [F.col("doc_id"), F.col("text")] + ([F.col(spans).alias("spans")] if spans else [])
    return docs.select(*wanted).mapInArrow(run, SCHEMA)


def fields_as_text(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """Two columns: the text of string fields joined by separator (null fields are empty), and their spans."""
    values = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for value in values:
        stop = at + F.length(value)
        spans.append(F.struct(at.alias("start"), stop.alias("stop")))
        at = stop + len(separator)
    return F.concat_ws(separator, *values), F.array(*spans)
