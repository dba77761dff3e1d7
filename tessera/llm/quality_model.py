"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.shingles import word_hashes

#: The most labelled rows that a model is fitted on, those with the lowest hashes of their ids.
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, LEAST, PENALTY = 120, 4, 0.1, 64, 20, 1.0

_CLASSES = np.zeros(256, np.int64)  # 0 rest of ASCII, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 stop, 7 mark, 8 other, 9 first byte, 10 later byte
for _chars, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), (" \t\r\x0b\x0c", 4), ("\n", 5), (".,;:?", 6), ("#*$%&|<>", 7), ("!-_=+~^/\\@[]{}()\"'`", 8)):
    _CLASSES[[ord(c) for c in _chars]] = _k
_CLASSES[0xC0:] = 9
_CLASSES[0x80:0xC0] = 10
FEATURES = (
    "log_chars log_words word_bytes longest_word upper lower digits spaces newlines stops marks others accents exclamations "
    "distinct_words distinct_triples top_word lines_per_word dup_lines short_lines mean_line"
).split()


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts have the statistics of no words."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts.to_pylist()):
        body = np.frombuffer((text or "").encode(), np.uint8)
        if not len(body):
            continue
        counts = np.bincount(_CLASSES[body], minlength=11)
        chars = len(body) - counts[10]
        hashes, _ = word_hashes(body, np.array([len(body)]))
        n = max(1, len(hashes))
        solid = len(body) - counts[4] - counts[5]
        lines = [x for x in text.split("\n") if x.strip()]
        ordered = np.sort(hashes)
        runs = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))) if len(ordered) else np.zeros(1)
        triples = n - 2
        distinct = len(np.unique(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7))) / triples if triples > 0 else 1.0
        lengths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
        share = counts / chars
        out[row] = (
            np.log1p(chars), np.log1p(len(hashes)), solid / n, max(map(len, text.split()), default=0), share[1], share[2], share[3], share[4], share[5],
            share[6], share[7], share[8], share[9], (body == 33).sum() / chars, len(runs) / n, distinct, runs.max() / n, len(lines) / n,
            1 - len(set(lines)) / max(1, len(lines)), (lengths < 30).mean(), np.log1p(lengths.mean()),
        )
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i has children 2i + 1 and 2i + 2. ``leaves`` follow the nodes."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of every row: all trees are gone down at once, one level at a time."""
        total = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not trees:
            return total
        which = np.arange(trees)[None, :]
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[which, at]] > self.cut[which, at])
        return total + self.leaves[which, at - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees for the log loss: values fall into BINS quantile bins, and every level's splits come from histograms of
    gradients by node and bin. Without rows the score is one half, with one class it is that class's smoothed share."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    inner = 2**depth - 1
    feature, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    if len(y) < 2 * LEAST or y.min() == y.max():
        return Trees(base, feature[:0], cuts[:0], leaves[:0])
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            chosen, at_bin = np.zeros(many, np.int64), np.full(many, BINS, np.int64)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * BINS + binned[:, j]
                g = np.bincount(key, gradient, many * BINS).reshape(many, BINS)
                h = np.bincount(key, weight, many * BINS).reshape(many, BINS)
                c = np.bincount(key, minlength=many * BINS).reshape(many, BINS)
                gl, hl, cl = g.cumsum(1)[:, : len(e)], h.cumsum(1)[:, : len(e)], c.cumsum(1)[:, : len(e)]
                gs, hs, cs = g.sum(1, keepdims=True), h.sum(1, keepdims=True), c.sum(1, keepdims=True)
                gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
                gain[(cl < LEAST) | (cs - cl < LEAST)] = -1
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                best[better], chosen[better], at_bin[better] = gain[np.arange(many), top][better], j, top[better]
            feature[t, first : first + many] = chosen
            cuts[t, first : first + many] = [edges[j][b] if b < len(edges[j]) else np.inf for j, b in zip(chosen, at_bin, strict=True)]
            local = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), chosen[local]] > at_bin[local])
        leaf = node - inner
        leaves[t] = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + PENALTY)
        margin += leaves[t][leaf]
    return Trees(base, feature, cuts, leaves)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from: the CRC-32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Trees:
    """A model of ``label`` fitted on at most ``most`` labelled documents that are not held out.

    Null labels and ids don't count; of repeated labels the lowest counts, of documents that share an id the one with the lowest
    statistics. Only the statistics and labels of the sample reach the driver, at most ``most`` rows of numbers, and only its ids
    are broadcast.
    """
    small_batches(docs.sparkSession)
    named = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y is not null")
    named = named.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = named.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(sample), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["_id", "x", "y"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", "_t", "_y").mapInArrow(run, f"_id {kind}, x array<double>, y double")
    found = found.groupBy("_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow().sort_by("_id")
    x = np.array(found["x"].to_pylist(), float).reshape(found.num_rows, len(FEATURES))
    return fit(x, found["y"].to_numpy())


def score(docs: DataFrame, model: Trees, text: str = "text", added: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from a half upwards), or named as ``added`` says.

    Every row is scored by its whole text alone; null and empty texts have a score too; repeated rows have equal scores;
    an empty table stays empty. Columns of the names that are added may not be there already.
    """
    if set(added) & set(docs.columns):
        raise ValueError(f"columns {' and '.join(added)} are added")
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(statistics(batch.column(at)))
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{added[0]}` double, `{added[1]}` int")
