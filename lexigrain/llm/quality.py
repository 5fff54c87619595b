"""Quality classifier on random-indexing word vectors.

Every token and every token shape ("Aa", "A!", "a$", "0") has a random index
vector with a few entries of +1 or -1, drawn from its hash.  A word vector is
the sum of the index vectors around the word's occurrences in the training
sample, added to its own, scaled to length one; words not seen there have their
index vector, folded into a fixed number of rows.  A document is pooled as the
mean of its word vectors and of its shape vectors, with the lengths of the two
means, the share of different tokens and the logarithm of the token count.  A
two-layer network (numpy) turns that into a logit, and a temperature fitted on
held-back rows of the sample turns logits into calibrated probabilities.

The classifier is fitted on at most ``sample_rows`` labelled rows of at most
``sample_bytes`` of text together, taken in the order of a hash of their ids;
these bounds are parameters.  A text is learnt from whole or not at all: one
that would pass the second bound is left out.  Every row of the table is scored
on its whole text.

Defined results: null text counts as empty, and empty texts get the score of a
document without tokens; null ids are scored and count as not held out; rows
without a label are scored as any other; of several labels of an id the
largest counts; repeated rows are learnt from once and scored each; with no labelled rows every score is 0.5, with labels of one
kind only the score is the share of label 1, smoothed; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import id_text, trimmed

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Letters as a, A or Aa, digits as 0, signs as they are, runs as one."""
    s = _LETTERS.sub(lambda m: "a" if (w := m[0]).islower() else "A" if w.isupper() and len(w) > 1 else "Aa" if w[0].isupper() else "aA", token)
    return _RUN.sub(r"\1", _DIGITS.sub("0", s))[:16]


def index_vectors(keys: list[str], dim: int, ones: int) -> np.ndarray:
    """Sparse vectors of ``ones`` entries +1 or -1 at places given by a hash."""
    out = np.zeros((len(keys), dim), np.float32)
    for r, k in enumerate(keys):
        h = xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 11)
        for _ in range(ones):
            out[r, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
            h //= 2 * dim
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Word and shape vectors, the network and its temperature; a few MB."""

    words: dict[str, int]
    shapes: dict[str, int]
    word_rows: np.ndarray  # known words, then the folded rows of others
    shape_rows: np.ndarray
    fold: int
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None

    def rows(self, token: str) -> tuple[int, int]:
        w = self.words.get(token)
        if w is None:
            w = len(self.words) + xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % self.fold
        s = self.shapes.get(k := shape(token))
        if s is None:
            s = len(self.shapes) + xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) % self.fold
        return w, s

    def pool(self, text: str, known: dict[str, tuple[int, int]]) -> np.ndarray:
        counts = Counter(text.split())
        n = sum(counts.values())
        dim = self.word_rows.shape[1]
        if not n:
            return np.zeros(2 * dim + 5, np.float32)
        found = []
        for t in counts:
            if (r := known.get(t)) is None:
                r = known[t] = self.rows(t)
            found.append(r)
        at = np.array(found, np.int64)
        c = np.fromiter(counts.values(), np.float32, len(counts)) / np.float32(n)
        w, s = c @ self.word_rows[at[:, 0]], c @ self.shape_rows[at[:, 1]]
        more = [np.linalg.norm(w), np.linalg.norm(s), len(counts) / n, np.log1p(n), c.max()]
        return np.concatenate((w, s, np.array(more, np.float32)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.maximum(((x - self.mean) / self.scale) @ a + b, 0) @ c + d)[:, 0]

    def scores(self, texts: list[str], known: dict[str, tuple[int, int]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.stack([self.pool(t, known) for t in texts]) if texts else np.zeros((0, len(self.mean)), np.float32)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def word_vectors(tokens: list[list[str]], dim: int, ones: int, window: int, most: int) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing: a vector for each of the ``most`` commonest words."""
    counts = Counter(t for doc in tokens for t in doc)
    names = [t for t, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most] if c > 1]
    words = {t: i for i, t in enumerate(names)}
    index = index_vectors(names, dim, ones)
    padded = np.vstack((index, np.zeros((1, dim), np.float32)))
    context = np.zeros_like(padded)
    for doc in tokens:
        ids = np.fromiter((words.get(t, len(names)) for t in doc), np.int64, len(doc))
        for gap in range(1, window + 1):
            np.add.at(context, ids[gap:], padded[ids[:-gap]])
            np.add.at(context, ids[:-gap], padded[ids[gap:]])
    return words, _unit(_unit(context[:-1]) + _unit(index))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int, seed: int, epochs: int = 60) -> list[np.ndarray]:
    """Adam on the logistic loss of a network with one hidden layer."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    layers = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, 1)) * np.sqrt(1 / hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            xb, yb = x[order[at : at + 128]], y[order[at : at + 128]]
            h = np.maximum(xb @ layers[0] + layers[1], 0)
            out = (h @ layers[2] + layers[3])[:, 0]
            g = ((1 / (1 + np.exp(-np.clip(out, -60, 60)))) - yb)[:, None] / len(xb)
            gh = (g @ layers[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((xb.T @ gh + 1e-3 * layers[0], gh.sum(0), h.T @ g + 1e-3 * layers[2], g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                layers[i] = layers[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss on held-back rows."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_texts(
    texts: list[str], labels: list[int], dim: int = 48, ones: int = 4, window: int = 2, words: int = 20_000, fold: int = 1024, hidden: int = 24, seed: int = 3
) -> Model:
    """The classifier of a sample that fits one process."""
    y = np.array(labels, np.float64)
    constant = None if len(set(labels)) > 1 else (sum(labels) + 1) / (len(labels) + 2) if labels else 0.5
    tokens = [t.split() for t in texts]
    names, rows = word_vectors(tokens, dim, ones, window, words)
    seen = sorted({shape(t) for doc in tokens for t in set(doc)})[:words]
    folded = _unit(index_vectors([f"fold {i}" for i in range(fold)], dim, ones))
    model = Model(
        names, {s: i for i, s in enumerate(seen)}, np.vstack((rows, folded)),
        np.vstack((_unit(index_vectors([f"shape {s}" for s in seen], dim, ones)), folded)),
        fold, np.zeros(1), np.ones(1), [], 1.0, constant,
    )
    if constant is None:
        known: dict[str, tuple[int, int]] = {}
        x = np.stack([model.pool(t, known) for t in texts]).astype(np.float64)
        back = np.arange(len(x)) % 5 == 4
        if len(set(y[~back])) < 2:
            back[:] = False
        model.mean, model.scale = x[~back].mean(0), x[~back].std(0) + 1e-3
        z = (x - model.mean) / model.scale
        model.layers = train_network(z[~back], y[~back], hidden, seed)
        if back.any():
            model.temperature = best_temperature(model.logits(x[back]), y[back])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels may not be learnt: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4_000, sample_bytes: int = 24_000_000) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out."""
    marks = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    # the sample is bounded, so its ids may be broadcast; ids without a row are met by taking twice as many
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marks.orderBy(*order).limit(2 * sample_rows)
    texts = id_text(docs, id_col, text_col)
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_key"))
    sizes = found.distinct().orderBy(*order, "text_key").limit(sample_rows).collect()  # ids and sizes only
    left, taken = sample_bytes, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["doc_id"], r["text_key"], r["label"]))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(taken, "doc_id long, text_key long, label int")
    rows = texts.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "text_key"])
    rows = rows.dropDuplicates(["doc_id", "text_key"]).orderBy(*order, "text_key").select("text", "label").collect()
    return fit_texts([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_words: int = 200_000) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[str, tuple[int, int]] = {}
        for b in batches:
            known = trimmed(known, max_words)
            s = shared.value.scores(b.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
