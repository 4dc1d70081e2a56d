"""Language-model scores from Brown class-based bigrams.

Every word of the training texts is counted in Spark and gets a class by exchange clustering (Kneser
and Ney 1993; Martin, Liermann and Ney 1998): a word goes to the class that raises the likelihood of
the class bigrams most. Three steps do so, each over all training texts:

* the SEEDS most frequent words are moved between classes, one after another, until a round moves none;
* all other words of a bounded dictionary are placed by how often they stand after and before words of
  each seed class;
* all rarer words, however many, are placed by how often they stand after and before words of each class
  of the dictionary. Their counts come from Spark aggregations, and their classes stay a table in Spark.

A token's probability is P(class | class before) * P(word | class), both smoothed; a text's score is
the sum of their logarithms, from which its perplexity follows. Class bigrams are counted over all
pairs of training tokens; those of two rarer words as soon as both have their classes. Words never met in training go to
the class that has most of the words met once, whose emissions leave room for one more word.

The dictionary is broadcast and settles most tokens where the text is read. Counts and classes of all
other words come from shuffle joins on the word. Counts cover all training texts and all their words.

Defined results: null texts count as empty; every text ends in one end token, so an empty one has
one token. A null doc_id counts as the empty text in the split. Rows that repeat a document are each
scored. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.bpe import slices
from foliomill.llm.common import join_hot, written

#: Words whose counts are broadcast, at most.
FREQUENT = 131_072
#: Counts below this have a place of their own in the histogram that sizes the dictionary.
EXACT_COUNTS = 4096
#: Words that are moved one after another, the end token included; classes; rounds of moves at most.
SEEDS, CLASSES, ROUNDS = 2048, 64, 8
#: Rows that a counting task holds before it adds them up.
HELD_ROWS = 400_000
#: Counts up to which the gain of a neighbour is looked up in a table.
SMALL = 8
#: Words placed together.
PLACED_AT_ONCE = 4096
#: Stands for the end token; no word is empty.
END = ""


def training(doc_id: Column) -> Column:
    return held_out_remainder(doc_id) != 1


def held_out_remainder(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Tokens:
    """The tokens of some texts: distinct words, each token's number among these (the end token's is last), tokens of each text."""

    words: pa.Array
    ids: np.ndarray
    sizes: np.ndarray


def tokens(texts: list[str | None]) -> Tokens:
    """Words of A-Z-lower-cased texts, cut at ASCII white space; an end token closes each text."""
    coded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join([*coded, b""]).lower(), np.uint8)  # bytes know no other letters
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    sizes = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1 - starts
    solid = raw[~blank]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(solid)).dictionary_encode()
    ends = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in coded]))
    ids = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(words.dictionary))
    return Tokens(words.dictionary, ids, np.diff(ends, prepend=0) + 1)


class Sums:
    """Rows of keys and counts, added up by key whenever there are many."""

    def __init__(self, keys: list[str]):
        self.keys, self.parts, self.rows = keys, [], 0

    def add(self, *columns: pa.Array) -> Iterator[pa.RecordBatch]:
        """Takes rows in (keys, n); now and then hands out sums."""
        self.parts.append(pa.table(columns, [*self.keys, "n"]))
        self.rows += len(columns[-1])
        if self.rows > HELD_ROWS:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            table = pa.concat_tables(self.parts).group_by(self.keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*self.keys, "n"])
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)
        self.parts, self.rows = [], 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["word"])
        for rows in slices(batches):
            t = tokens(rows.column("text").to_pylist())
            yield from sums.add(pa.concat_arrays([t.words, pa.array([END])]), pa.array(np.bincount(t.ids, minlength=len(t.words) + 1)))
        yield from sums.out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The broadcast dictionary: the most frequent words, most frequent first; words counted less than least are not in it."""

    listed: list[str]
    counts: np.ndarray
    least: int

    def index(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.listed)}

    def seeds(self) -> np.ndarray:
        """The places of the seeds in the dictionary, the end token's first."""
        end = self.listed.index(END) if END in self.listed else -1
        return np.array([end, *[i for i in range(min(len(self.listed), SEEDS)) if i != end][: SEEDS - 1]], np.int64)

    def spread(self, values: np.ndarray, other: int) -> np.ndarray:
        """values of the seeds as an array over the dictionary; other elsewhere."""
        out = np.full(len(self.listed), other, np.int64)
        out[self.seeds()] = values
        return out


def lexicon(counts: DataFrame, size: int = FREQUENT) -> Lexicon:
    """All words counted at least t times, t the least number that leaves size of them at most.

    t comes from a histogram of counts, exact below EXACT_COUNTS and by sixteenths of doublings above,
    so only the dictionary's words leave the executors, and none are sorted there.
    """
    n = F.col("n")
    step = F.when(n < EXACT_COUNTS, n).otherwise(EXACT_COUNTS + F.floor(16 * F.log2(n / EXACT_COUNTS))).cast("long")
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # some thousand rows
    least, total = None, 0
    for row in sorted(rows, key=lambda r: -r["step"]):
        total += row["words"]
        if total > size:
            break
        least = row["least"]
    top = counts.where(n >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    end = counts.where(F.col("word") == END).toArrow()  # is listed however few texts there are
    found = set(zip(top.column("n").to_pylist() + end.column("n").to_pylist(), top.column("word").to_pylist() + end.column("word").to_pylist()))
    ordered = sorted(found, key=lambda x: (-x[0], x[1]))
    return Lexicon([w for _, w in ordered], np.array([c for c, _ in ordered], np.int64), least if least is not None else 1 << 62)


def _places(get, t: Tokens) -> np.ndarray:
    """The dictionary's place of each distinct word and of the end token; -1 of others."""
    distinct = t.words.to_numpy(zero_copy_only=False).tolist()
    distinct.append(END)
    return np.fromiter(map(get, distinct, repeat(-1)), np.int64, len(distinct))


def _cells(docs: DataFrame, lex: Lexicon, of: np.ndarray, size: int, cells) -> DataFrame:
    """(cell, n): how often cells(prev, next, values, values of prev, of next) has each number, over all texts.

    of has a value for each word of the dictionary; other words have -1. A text begins after an end token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, sums = lex.index().get, Sums(["cell"])
        values = np.append(of, -1)
        for rows in slices(batches):
            t = tokens(rows.column("text").to_pylist())
            if not len(t.ids):
                continue
            at = _places(get, t)[t.ids]
            cell, n = np.unique(cells(at, values[at], size), return_counts=True)
            yield from sums.add(pa.array(cell), pa.array(n))
        yield from sums.out()

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _bigram_cells(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    before = np.r_[0, values[:-1]]
    both = (before >= 0) & (values >= 0)
    return before[both] * size + values[both]


def _context_cells(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Of the dictionary's words without a value: place * 2 size + the class before, or size + the class after."""
    before, after = np.r_[0, values[:-1]], np.r_[values[1:], 0]
    open_ = (at >= 0) & (values < 0)
    a, b = open_ & (before >= 0), open_ & (after >= 0)
    return np.r_[at[a] * 2 * size + before[a], at[b] * 2 * size + size + after[b]]


def seed_bigrams(docs: DataFrame, lex: Lexicon) -> np.ndarray:
    """How often each seed stands after each seed."""
    n = len(lex.seeds())
    found = _cells(docs, lex, lex.spread(np.arange(n), -1), n, _bigram_cells).toArrow()  # SEEDS squared rows at most
    out = np.zeros(n * n, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n)


def exchange_clustering(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit; the end token (unit 0) keeps class 0 to itself."""
    n = bigrams.astype(float)
    size = n.sum(0) + n.sum(1)
    order = np.argsort(-size, kind="stable")
    order = order[order != 0]
    klass = np.zeros(len(n), np.int64)
    klass[order] = 1 + np.arange(len(order)) % (classes - 1)

    member = np.zeros((len(n), classes))
    member[np.arange(len(n)), klass] = 1
    after, before = n @ member, n.T @ member  # of units: by class of the next unit, of the unit before
    table = member.T @ after
    for _ in range(rounds):
        moved = 0
        for w in order[size[order] > 0]:
            old, own = klass[w], n[w, w]
            to, of = after[w].copy(), before[w].copy()  # to and from the other units' classes
            to[old] -= own
            of[old] -= own
            table[old] -= to
            table[:, old] -= of
            table[old, old] -= own
            rows, columns = xlogx(table), table.T
            gain = (xlogx(table + to) - rows).sum(1) + (xlogx(columns + of) - rows.T).sum(1)
            d = np.diagonal(table)
            gain += xlogx(d + to + of + own) + xlogx(d) - xlogx(d + to) - xlogx(d + of)
            left, right = table.sum(1), table.sum(0)
            gain -= xlogx(left + to.sum() + own) - xlogx(left) + xlogx(right + of.sum() + own) - xlogx(right)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += to
            table[:, new] += of
            table[new, new] += own
            if new != old:
                moved += 1
                klass[w] = new
                after[:, old] -= n[:, w]
                after[:, new] += n[:, w]
                before[:, old] -= n[w]
                before[:, new] += n[w]
        if not moved:
            break
    return klass


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Placer:
    """Chooses the class that raises the likelihood of the class bigrams most when a word's neighbours are added."""

    def __init__(self, table: np.ndarray):
        self.table, self.ends = table, (table.sum(0), table.sum(1))
        self.small = [np.stack([xlogx(t + n) - xlogx(t) for n in range(SMALL + 1)]) for t in (table, table.T)]
        self.usual = 1 + int(table.sum(0)[1:].argmax())  # of words without known neighbours

    def place(self, word: np.ndarray, side: np.ndarray, klass: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
        """The class of each word; (word, side, klass, n) are sorted by word: side 0 counts the class before, 1 the class after."""
        gain, classes = np.zeros((words, len(self.table))), len(self.table)
        for a in range(0, len(word), 1 << 16):
            w, s, k, m = (x[a : a + (1 << 16)] for x in (word, side, klass, n))
            rows = np.empty((len(w), classes))
            for which, table in enumerate((self.table, self.table.T)):
                few, many = (s == which) & (m <= SMALL), (s == which) & (m > SMALL)
                rows[few] = self.small[which][m[few], k[few]]
                rows[many] = xlogx(table[k[many]] + m[many, None]) - xlogx(table[k[many]])
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, np.int64)
            if len(w):
                gain[w[starts]] += np.add.reduceat(rows, starts)
        for which, ends in enumerate(self.ends):
            total = np.bincount(word[side == which], n[side == which], words)[:, None]
            gain -= xlogx(ends + total) - xlogx(ends)
        gain[:, 0] = -np.inf  # the end token's own
        met = np.bincount(word, minlength=words) > 0
        return np.where(met, gain.argmax(1), self.usual)


def place_dictionary(docs: DataFrame, lex: Lexicon, seeds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word of the dictionary, and the class bigrams with those of the words placed here added."""
    size, known = CLASSES, lex.spread(seeds, -1)
    cells = _cells(docs, lex, known, size, _context_cells)
    placer = Placer(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PLACED_AT_ONCE):
                part = batch.slice(a, PLACED_AT_ONCE)
                lists = part.column("near")
                word = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                near = lists.flatten()
                code, n = near.field("code").to_numpy().astype(np.int64), near.field("n").to_numpy()
                klass = placer.place(word, code // size, code % size, n, len(lists))
                to = np.where(code < size, code * size + klass[word], klass[word] * size + code - size)
                cell, total = np.unique(to, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([part.column("place"), pa.nulls(len(cell), pa.int64())]), pa.array(np.r_[klass, cell]), pa.array(np.r_[np.zeros(len(klass), np.int64), np.bincount(total, n, len(cell)).astype(np.int64)])], ["place", "to", "n"])

    near = F.array_sort(F.collect_list(F.struct((F.col("cell") % (2 * size)).cast("int").alias("code"), "n"))).alias("near")
    lists = cells.groupBy(F.floor(F.col("cell") / (2 * size)).cast("long").alias("place")).agg(near)
    found = written(lists.mapInArrow(run, "place long, to long, n long"), "placed")
    placed = found.where("place IS NOT NULL").select("place", "to").toArrow()  # a row for each word of the dictionary at most
    out = np.where(known >= 0, known, placer.usual)
    out[placed.column("place").to_numpy()] = placed.column("to").to_numpy()
    return out, table + _table(found.where("place IS NULL"), size)


def _table(cells: DataFrame, size: int) -> np.ndarray:
    """Sums of n by cell (to) of a square table."""
    sums = cells.groupBy("to").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[sums.column("to").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(size, size)


def word_contexts(docs: DataFrame, lex: Lexicon, classes: np.ndarray) -> DataFrame:
    """(word, code, then, n) of words outside the dictionary, code telling the classes before and after; with then, how often two such words follow each other; and, with word null, class bigrams of the dictionary.

    code is (before + 1) * (CLASSES + 1) + after + 1, with 0 for a neighbour outside the dictionary; of bigrams before * CLASSES + class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, sums, wide = lex.index().get, Sums(["word", "code", "then"]), (CLASSES + 1) ** 2
        values = np.append(classes, -1)
        for rows in slices(batches):
            t = tokens(rows.column("text").to_pylist())
            if not len(t.ids):
                continue
            at = values[_places(get, t)][t.ids]
            before, after = np.r_[0, at[:-1]], np.r_[at[1:], 0]
            pairs, n = np.unique(before[(before >= 0) & (at >= 0)] * CLASSES + at[(before >= 0) & (at >= 0)], return_counts=True)
            rare = np.flatnonzero(at < 0)
            cell, times = np.unique(t.ids[rare] * wide + (before[rare] + 1) * (CLASSES + 1) + after[rare] + 1, return_counts=True)
            first = rare[after[rare] < 0]
            both, often = np.unique(t.ids[first] * len(t.words) + t.ids[first + 1], return_counts=True)
            words = pa.concat_arrays([t.words.take(pa.array(np.r_[cell // wide, both // len(t.words)])), pa.nulls(len(pairs), pa.string())])
            code = pa.concat_arrays([pa.array(cell % wide), pa.nulls(len(both), pa.int64()), pa.array(pairs)])
            then = pa.concat_arrays([pa.nulls(len(cell), pa.string()), t.words.take(pa.array(both % len(t.words))), pa.nulls(len(pairs), pa.string())])
            yield from sums.add(words, code, then, pa.array(np.r_[times, often, n]))
        yield from sums.out()

    return docs.select("text").mapInArrow(run, "word string, code long, then string, n long").groupBy("word", "code", "then").agg(F.sum("n").alias("n"))


def place_rare(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, to, n): each word's class; and, with word null, the class bigrams that these words are in."""
    placer, wide = Placer(table), CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PLACED_AT_ONCE):
                part = batch.slice(a, PLACED_AT_ONCE)
                lists = part.column("near")
                owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                near = lists.flatten()
                code, times = near.field("code").to_numpy(), near.field("n").to_numpy()
                # before and after apart, of one word together
                klass_, n = np.stack([code // wide - 1, code % wide - 1], 1).ravel(), np.repeat(times, 2)
                word, side = np.repeat(owner, 2), np.tile([0, 1], len(code))
                known = klass_ >= 0
                word, side, klass_, n = word[known], side[known], klass_[known], n[known]
                key, where = np.unique((word * 2 + side) * CLASSES + klass_, return_inverse=True)
                n = np.bincount(where, n, len(key)).astype(np.int64)
                word, side, klass_ = key // CLASSES // 2, key // CLASSES % 2, key % CLASSES
                klass = placer.place(word, side, klass_, n, len(lists))
                to = np.where(side == 0, klass_ * CLASSES + klass[word], klass[word] * CLASSES + klass_)
                cell, where = np.unique(to, return_inverse=True)
                total = np.bincount(where, n, len(cell)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([part.column("word"), pa.nulls(len(cell), pa.string())]), pa.array(np.r_[klass, cell]), pa.array(np.r_[np.zeros(len(klass), np.int64), total])], ["word", "to", "n"])

    lists = contexts.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("near"))
    return lists.mapInArrow(run, "word string, to long, n long")


@dataclass
class ClassModel:
    """Classes of the dictionary, log10 probabilities of class bigrams, log10 of each class's emission denominator, the class of unmet words."""

    classes: np.ndarray
    steps: np.ndarray
    spread: np.ndarray
    unmet: int


def class_model(classes: np.ndarray, table: np.ndarray, seen: np.ndarray, types: np.ndarray, once: np.ndarray) -> ClassModel:
    """table: class bigrams; of each class: seen tokens, distinct words, words met once."""
    number = len(table)
    unmet = 1 + int(once[1:].argmax())
    share = (seen + 0.5) / (seen.sum() + 0.5 * number)
    steps = np.log10((table + share) / (table.sum(1, keepdims=True) + 1.0))
    room = np.arange(number) == unmet
    return ClassModel(classes, steps, np.log10(seen + 0.5 * np.maximum(types + room, 1)), unmet)


def fit(train: DataFrame, counts: DataFrame) -> tuple[Lexicon, ClassModel, DataFrame]:
    """The dictionary, the model, and (word, n, class) of all other training words as a written table."""
    lex = lexicon(counts)
    rare = counts.where(F.col("n") < lex.least).where(F.col("word") != END)
    if not lex.listed:
        lone = np.ones(CLASSES)
        return lex, class_model(np.empty(0, np.int64), np.zeros((CLASSES, CLASSES)), 0 * lone, 0 * lone, 0 * lone), rare.withColumn("class", F.lit(1).cast("long"))
    bigrams = seed_bigrams(train, lex)
    seeds = exchange_clustering(bigrams)
    table = np.zeros((CLASSES, CLASSES))
    np.add.at(table, (seeds[:, None], seeds[None, :]), bigrams)
    classes, table = place_dictionary(train, lex, seeds, table)
    contexts = written(word_contexts(train, lex, classes), "contexts")
    table = _table(contexts.where("word IS NULL").select(F.col("code").alias("to"), "n"), CLASSES)
    placed = written(place_rare(contexts.where("word IS NOT NULL AND then IS NULL"), table), "classes")
    table += _table(placed.where("word IS NULL"), CLASSES)
    others = written(rare.join(placed.where("word IS NOT NULL").select("word", F.col("to").alias("class")), "word"), "rare")
    pairs = contexts.where("then IS NOT NULL").select("word", "then", "n")
    known = others.select("word", "class")
    # no word outside the dictionary is frequent in training, so these keys are never hot
    half = pairs.join(known.withColumnRenamed("class", "first"), "word").groupBy("first", "then").agg(F.sum("n").alias("n"))
    both = half.join(known.select(F.col("word").alias("then"), "class"), "then")
    table += _table(both.select((F.col("first") * CLASSES + F.col("class")).alias("to"), "n"), CLASSES)
    seen, types, once = (np.bincount(classes, w, CLASSES) for w in (lex.counts, np.ones(len(classes)), lex.counts == 1))
    for row in others.groupBy("class").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).collect():  # CLASSES rows at most
        for total, more in zip((seen, types, once), row[1:]):
            total[row[0]] += more
    return lex, class_model(classes, table, seen, types, once), others


def _token_sums(docs: DataFrame, lex: Lexicon, model: ClassModel) -> DataFrame:
    """Per text one row of sums (word null); a row for each token outside the dictionary, with sides; and one for each two such tokens in a row, with then.

    sides is (class before + 1) * (CLASSES + 1) + class after + 1, with 0 for a neighbour outside the dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, logs, values = lex.index().get, np.log10(np.append(lex.counts, 0) + 0.5), np.append(model.classes, -1)
        first = TaskContext.get().partitionId() << 40
        steps = np.zeros((CLASSES + 1, CLASSES + 1))  # the last row and column are of tokens outside the dictionary
        steps[:-1, :-1] = model.steps
        spread = np.append(model.spread, 0.0)
        for rows in slices(batches):
            t = tokens(rows.column("text").to_pylist())
            n = rows.num_rows
            places = _places(get, t)
            at = values[places][t.ids] if n else np.empty(0, np.int64)
            text = np.repeat(np.arange(n), t.sizes)
            before, after = np.r_[0, at[:-1]], np.r_[at[1:], 0]
            if not lex.listed:
                at[np.cumsum(t.sizes) - 1] = 0  # the end token has its class, met or not
                before, after = np.r_[0, at[:-1]], np.r_[at[1:], 0]
            rare = np.flatnonzero(at < 0)
            log_sum = np.bincount(text, np.where(at >= 0, logs[places][t.ids], 0), n)
            model_sum = np.bincount(text, steps[before, at] - spread[at], n)
            met = np.bincount(text, places[t.ids] >= 0, n).astype(np.int64)
            twice = rare[(after[rare] < 0)]
            m, k = len(rare), len(twice)
            none = lambda kind, many=m + k: pa.nulls(many, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first + np.r_[np.arange(n), text[rare], text[twice]]),
                    pa.concat_arrays([pa.nulls(n, pa.string()), t.words.take(pa.array(t.ids[np.r_[rare, twice]]))]),
                    pa.concat_arrays([pa.nulls(n + m, pa.string()), t.words.take(pa.array(t.ids[twice + 1]))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(((before[rare] + 1) * (CLASSES + 1) + after[rare] + 1).astype(np.int32)), pa.nulls(k, pa.int32())]),
                    pa.concat_arrays([pa.array(t.sizes.astype(np.int64)), none(pa.int64())]),
                    pa.concat_arrays([rows.column("doc_id"), none(pa.int64())]),
                    pa.concat_arrays([rows.column("held_out"), none(pa.bool_())]),
                    pa.concat_arrays([pa.array(met), none(pa.int64())]),
                    pa.concat_arrays([pa.array(log_sum), none(pa.float64())]),
                    pa.concat_arrays([pa.array(model_sum), none(pa.float64())]),
                ],
                ["key", "word", "then", "sides", "tokens", "doc_id", "held_out", "met", "log_sum", "model_sum"],
            )
            first += n

    schema = "key long, word string, then string, sides int, tokens long, doc_id long, held_out boolean, met long, log_sum double, model_sum double"
    return docs.select("doc_id", "text", (held_out_remainder(F.col("doc_id")) == 1).alias("held_out")).mapInArrow(run, schema)


def _numbers(values: np.ndarray) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    train = docs.where(training(F.col("doc_id")))
    counts = written(word_counts(train), "words")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lex, model, others = fit(train, counts)
    parts = written(_token_sums(docs, lex, model), "sums")
    wide = np.zeros((CLASSES + 1, CLASSES))
    wide[1:] = model.steps
    into, from_ = _numbers(wide), _numbers(np.c_[np.zeros(CLASSES), model.steps])
    spread = _numbers(model.spread)
    at = lambda table, n: F.get(table, n.cast("int"))
    klass = F.coalesce(F.col("class"), F.lit(model.unmet))
    rare = parts.where("word IS NOT NULL AND sides IS NOT NULL").select("key", "word", "sides")
    # a row for each rare token: a word that is frequent here and unmet in training is split by the adaptive join itself
    single = rare.join(others, "word", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), klass.alias("class"), "sides")
    before, after = F.floor(F.col("sides") / (CLASSES + 1)), F.col("sides") % (CLASSES + 1)
    moves = at(into, before * CLASSES + F.col("class")) + at(from_, F.col("class") * (CLASSES + 1) + after) - at(spread, F.col("class"))
    more = single.groupBy("key").agg(F.sum(F.log10(F.col("n") + 0.5)).alias("rare_sum"), F.count_if(F.col("n") > 0).alias("rare_met"), F.sum(moves).alias("rare_moves"))
    pairs = join_hot(parts.where("then IS NOT NULL").select("key", "word", "then"), others.select("word", "class"), "word", "left")
    pairs = written(pairs.select("key", "then", klass.alias("first")), "pairs")
    pairs = join_hot(pairs, others.select(F.col("word").alias("then"), "class"), "then", "left").select("key", "first", klass.alias("class"))
    chains = pairs.groupBy("key").agg(F.sum(at(_numbers(model.steps), F.col("first") * CLASSES + F.col("class"))).alias("chain_sum"))
    whole = parts.where("word IS NULL").drop("word", "then", "sides").join(more, "key", "left").join(chains, "key", "left")
    words_sum = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("met") + F.coalesce("rare_met", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (words_sum - F.col("tokens") * F.log10(F.lit(total + 0.5 * (types + 1)).cast("double"))).alias("base_score"),
        (words_sum + F.col("model_sum") + F.coalesce("rare_moves", F.lit(0.0)) + F.coalesce("chain_sum", F.lit(0.0))).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
