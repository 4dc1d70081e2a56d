"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and run through learned filters over chunks that overlap by a filter's
width less one, so that the chunks cover the whole text and no window is lost. Each filter's response
is max-pooled within every chunk; a text's features are the mean and the maximum over its chunks, and
a logistic layer combines them into one probability. Since filters are linear in a byte's embedding,
each filter position becomes a table with a row per byte, and scoring is table lookups and sums.

Training: at most PER_CLASS labelled rows of each class, picked by hash, with their whole texts; of
these as many as CLASS_BYTES hold, in the order of the hash (texts that do not fit are passed over), so
what reaches the driver is bounded. Of texts that share a doc_id the least one trains. A maximum over few windows is lower than one over many, so in each round a share of the texts
is replaced by a short excerpt of each: else short good texts would be taken for bad ones. Scoring
covers whole texts. Only the text is an input of a score.

Defined results: null and empty texts are one chunk of padding and get that chunk's score. Without
labelled rows of both classes every score is the share of label 1 (1.0 without any label). Rows that
repeat a document are each scored. An empty table gives an empty result; columns other than doc_id
and text, and of labels doc_id and quality, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.bpe import slices
from foliomill.llm.common import text_or_empty, written

#: Labelled rows of each class that training uses at most, and bytes of all their texts.
PER_CLASS, CLASS_BYTES = 1000, 16 << 20
EMBEDDING, FILTERS, WIDTH, CHUNK = 8, 24, 5, 512
#: Rounds over the training texts; more where these are few, until there are MIN_STEPS steps.
MIN_STEPS = 400
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 24, 0.01, 1e-4, 11
#: Share of the texts that a round of training cuts to an excerpt, and an excerpt's bytes.
EXCERPTS, EXCERPT_BYTES = 0.4, (12, 250)
#: Bytes that scoring looks up at a time.
BYTES_AT_ONCE = 1 << 14
PAD = 256


@dataclass
class Network:
    """tables[k, b]: what byte b at place k of a window adds to each filter; b = PAD adds nothing."""

    tables: np.ndarray
    weights: np.ndarray
    bias: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text, whole."""
        pooled = [self._pooled(t) for t in texts]
        return 1 / (1 + np.exp(-(np.stack(pooled) @ self.weights + self.bias))) if texts else np.empty(0)

    def _pooled(self, text: bytes) -> np.ndarray:
        filters = self.tables.shape[2]
        total, most, chunks = np.zeros(filters), np.zeros(filters), 0
        step = BYTES_AT_ONCE - BYTES_AT_ONCE % CHUNK
        for a in range(0, max(1, len(text)), step):
            part = chunk_maxima(responses(self.tables, padded(text[a : a + step + WIDTH - 1], min(step, len(text) - a))))
            total += part.sum(0)
            most = np.maximum(most, part.max(0))
            chunks += len(part)
        return np.r_[total / chunks, most]


def padded(text: bytes, own: int) -> np.ndarray:
    """Byte numbers for whole chunks of windows, the first own of which start in the text."""
    size = max(1, -(-own // CHUNK)) * CHUNK + WIDTH - 1
    out = np.full(size, PAD, np.int64)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def responses(tables: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Each filter's response at each window."""
    n = len(symbols) - WIDTH + 1
    out = tables[0].take(symbols[:n], axis=0)
    for k in range(1, WIDTH):
        out += tables[k].take(symbols[k : k + n], axis=0)
    return out


def chunk_maxima(response: np.ndarray) -> np.ndarray:
    """The rectified maximum of each filter in each chunk."""
    return np.maximum(response.reshape(-1, CHUNK, response.shape[1]).max(1), 0)


class Trainer:
    """Adam on the logistic loss; gradients flow through the windows that won the pooling."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.p = {
            "embedding": rng.normal(0, 0.5, (256, EMBEDDING)),
            "filters": rng.normal(0, 0.35, (WIDTH, EMBEDDING, FILTERS)),
            "weights": np.zeros(2 * FILTERS),
            "bias": np.zeros(1),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def tables(self) -> np.ndarray:
        real = np.einsum("be,kef->kbf", self.p["embedding"], self.p["filters"])
        return np.concatenate([real, np.zeros((WIDTH, 1, FILTERS))], 1).astype(np.float32)

    def gradients(self, texts: list[bytes], labels: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss, weighed by importance, and the decay of the weights."""
        tables, features, winners = self.tables(), [], []
        for text in texts:
            symbols = padded(text, len(text))
            r = responses(tables, symbols).reshape(-1, CHUNK, FILTERS)
            at = r.argmax(1)
            top = np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0], 0)
            features.append(np.r_[top.mean(0), top.max(0)])
            winners.append((symbols, at + CHUNK * np.arange(len(at))[:, None], top))
        x = np.stack(features)
        error = (1 / (1 + np.exp(-(x @ self.p["weights"] + self.p["bias"]))) - labels) * importance / importance.sum()
        g = {"weights": x.T @ error + DECAY * self.p["weights"], "bias": error.sum(keepdims=True)}
        rows, sent = [], []
        for e, (symbols, at, top) in zip(error, winners):
            share = np.full(top.shape, 1 / len(top)) * self.p["weights"][:FILTERS]
            best = top.argmax(0)
            share[best, np.arange(FILTERS)] += self.p["weights"][FILTERS:]
            grad = e * share * (top > 0)
            chunk, f = np.nonzero(grad)
            rows.append(symbols[at[chunk, f][:, None] + np.arange(WIDTH)])
            sent.append((f, grad[chunk, f]))
        symbols = np.concatenate(rows)
        f, grad = (np.concatenate(s) for s in zip(*sent))
        g["embedding"], g["filters"] = np.zeros((257, EMBEDDING)), np.zeros((WIDTH, EMBEDDING, FILTERS))
        embedded = np.r_[self.p["embedding"], np.zeros((1, EMBEDDING))]
        for k in range(WIDTH):
            np.add.at(g["embedding"], symbols[:, k], grad[:, None] * self.p["filters"][k][:, f].T)
            into = np.zeros((FILTERS, EMBEDDING))
            np.add.at(into, f, grad[:, None] * embedded[symbols[:, k]])
            g["filters"][k] = into.T
        g["embedding"] = g["embedding"][:256]
        return g

    def step(self, texts: list[bytes], labels: np.ndarray, importance: np.ndarray) -> None:
        self.t += 1
        for k, grad_k in self.gradients(texts, labels, importance).items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad_k
            self.v[k] = 0.999 * self.v[k] + 0.001 * grad_k**2
            self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def network(self) -> Network:
        return Network(self.tables(), self.p["weights"].copy(), float(self.p["bias"][0]))


def excerpt(text: bytes, rng: np.random.Generator) -> bytes:
    """text, or with the chance EXCERPTS some words of it."""
    size = int(np.exp(rng.uniform(*np.log(EXCERPT_BYTES))))
    if rng.random() >= EXCERPTS or len(text) <= size:
        return text
    at = int(rng.integers(0, len(text) - size))
    at = text.rfind(b" ", 0, at) + 1  # from a word's start, so that a text may begin there
    return text[at : at + size]


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Network:
    """A network fitted to labelled texts; share is that of label 1 among all labelled rows."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(np.zeros((WIDTH, 257, 1), np.float32), np.zeros(2), float(np.log(share / (1 - share))))
    trainer, rng = Trainer(), np.random.default_rng(SEED)
    # rows count as often as their class does among all labelled rows, half way to balance
    weight = np.where(labels == 1, np.sqrt(share) / labels.mean(), np.sqrt(1 - share) / (1 - labels.mean()))
    for _ in range(max(EPOCHS, -(-MIN_STEPS // -(-len(texts) // BATCH)))):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            trainer.step([excerpt(texts[i], rng) for i in some], labels[some], weight[some])
    return trainer.network()


def remainder(doc_id: Column) -> Column:
    """The fold of a row; rows with 1 are held out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and labels of a bounded sample, and the share of label 1 among all labels that may be used."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = usable.agg(F.avg("quality")).first()[0]
    pick = lambda q: usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
    chosen = pick(0).union(pick(1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", text_or_empty().alias("text"), "quality")
    found = written(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")), "labelled")  # 2 * PER_CLASS rows at most
    room, fits = {0: CLASS_BYTES, 1: CLASS_BYTES}, []
    for row in found.select("doc_id", "quality", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["size"] <= room[row["quality"]]:
            room[row["quality"]] -= row["size"]
            fits.append(row["doc_id"])
    rows = found.where(F.col("doc_id").isin(fits)).orderBy("doc_id").toArrow() if fits else found.limit(0).toArrow()
    return [t.encode() for t in rows.column("text").to_pylist()], rows.column("quality").to_numpy(), 1.0 if share is None else float(share)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    network = train(*training_rows(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            scores = network.probabilities([(t or "").encode() for t in rows.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id")) == 1).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    network = train(*training_rows(docs, labels))

    @F.pandas_udf("double")
    def score(texts):
        found = [network.probabilities([(t or "").encode() for t in texts.iloc[a : a + 64]]) for a in range(0, len(texts), 64)]
        return texts.__class__(np.concatenate(found) if found else [], dtype=float)

    return docs.where(score(F.col("text")) >= 0.5)
