"""Packing documents into sequences: cutting-stock column generation over a histogram of lengths."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, running_total, small_batches

#: Tokens of a sequence; tokens of a step of the histogram; pivots of the linear program; rows of a piece of a ranking.
LENGTH, UNIT, PIVOTS, PIECE = 2048, 8, 4000, 4_096
#: The id that ends every document.
END_ID = 1
# The split of byte-level BPE into words, and the code points that stand for bytes in its vocabulary file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Ids:
    """Ids of texts, as little-endian bytes, by a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary is also loaded into ``tiktoken``, which gives the same ids about three times as fast. A probe text
    is encoded by both before the first use; texts that hold the string of a special token, and those that ``tiktoken`` refuses
    because a run of white space is too long for its regular expression, go to ``tokenizers``.
    """

    held: dict[str, Ids] = {}
    PROBE = "It's  a test,\n\n of 1234 naïve wörds!! \t日本語 <tag> we'll x\u00a0y z   "

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        hidden = [b for b in range(256) if b not in _SHOWN]
        byte = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = self.library.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        if self._fast(self.PROBE) != self._library(self.PROBE):
            raise ValueError(f"{path} is not byte-level BPE of the known split")

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _fast(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._library(text)
        try:
            return self._fast(text)
        except ValueError:
            return self._library(text)


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and its end id, cut into whole sequences and a rest: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids.of(tokenizer_path)
        for batch in batches:
            index, start, size, crc, tokens = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = known.encode(batch.column(1)[i].as_py()) + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    index.append(i)
                    start.append(at)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
            columns = [batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The items of the highest total price that fit into ``room``, by dynamic programming over room; items may repeat."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fitting = np.searchsorted(sizes, c, "right")
        if fitting:
            worth = prices[:fitting] + value[c - sizes[:fitting]]
            k = int(worth.argmax())
            value[c], last[c] = worth[k], k
        if value[c - 1] > value[c]:
            value[c], last[c] = value[c - 1], -1
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(value[room]), pattern


def cutting_stock(demand: dict[int, int], room: int, pivots: int = PIVOTS) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> how many) and how often to use each, together exactly the demand; each pattern fits ``room``.

    Revised simplex on the linear program that uses the fewest patterns, started from patterns of one size; each pivot brings
    in the pattern that a knapsack finds most valuable at the current prices, until none is worth more than 1. Uses
    are rounded down; the few items left are packed first-fit by decreasing size.
    """
    sizes = np.array(sorted(s for s, d in demand.items() if d > 0))
    if not len(sizes):
        return []
    wanted = np.array([demand[int(s)] for s in sizes], float)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    uses = inverse @ wanted
    for _ in range(pivots):
        prices = inverse.sum(0)
        worth, pattern = best_pattern(prices, sizes, room)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, uses / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        uses -= ratio[out] * step
        uses[out] = ratio[out]
        uses = np.maximum(uses, 0)
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    found: Counter[tuple[tuple[int, int], ...]] = Counter()
    left = wanted.astype(np.int64)
    for j in np.argsort(-uses):
        pattern = columns[:, j].astype(np.int64)
        held = pattern > 0
        times = int(min(np.floor(uses[j] + 1e-6), (left[held] // pattern[held]).min()))
        if times > 0:
            left -= times * pattern
            found[tuple((int(sizes[i]), int(pattern[i])) for i in np.flatnonzero(held))] += times
    bins: list[tuple[int, Counter[int]]] = []
    for i in np.flatnonzero(left)[::-1]:
        size, many = int(sizes[i]), int(left[i])
        while many:
            at = next((b for b, (free, _) in enumerate(bins) if free >= size), None)
            if at is None:
                bins.append((room, Counter()))
                at = len(bins) - 1
            free, held = bins[at]
            held[size] += 1
            bins[at] = (free - size, held)
            many -= 1
    for _, held in bins:
        found[tuple(sorted(held.items()))] += 1
    return [(dict(p), times) for p, times in found.items()]


def _shelves(counts: dict[int, int], length: int, unit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(class, first rank, rank after, each, first sequence, first slot)`` that place every rank of a class.

    Class 0 are whole sequences; class c holds pieces of up to c units. There are some rows for each class, however many pieces.
    """
    out, base = [], 0
    rank: Counter[int] = Counter()
    if counts.get(0):
        out.append((0, 0, counts[0], 1, 0, 0))
        base = counts[0]
    for pattern, times in cutting_stock({c: n for c, n in counts.items() if c}, length // unit):
        slot = 0
        for c, each in sorted(pattern.items(), reverse=True):
            out.append((c, rank[c], rank[c] + each * times, each, base, slot))
            rank[c] += each * times
            slot += each
        base += times
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, unit: int = UNIT, end_id: int = END_ID
) -> DataFrame:
    """The pieces of all documents with their place: columns of :func:`pieces`, ``sequence_id`` and ``offset``.

    Every id of a document (null texts are empty) and its end id lie in exactly one piece. Pieces of a whole sequence
    stand alone; the rests, by length in steps of ``unit``, are combined by :func:`cutting_stock` and dealt to its
    patterns by their rank within their step, in the order of a hash. ``offset`` is gapless from 0 in a sequence.
    Repeated rows are packed each for itself; null ids stay null; other columns are not read; no rows give no rows.
    The histogram (a row for each step) and the patterns are all that the driver holds; ranking goes by pieces of a
    step, so that one length may hold any share of the rows.
    """
    parts = cut(pieces(docs, tokenizer_path, doc_id, text, length, end_id))
    step = F.when(F.col("length") == length, 0).otherwise(F.ceil(F.col("length") / unit)).cast("int")
    parts = parts.withColumn("_class", step)
    counts = {r["_class"]: r["n"] for r in parts.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = [(counts.get(c, 0) // PIECE).bit_length() for c in range(length // unit + 1)]
    order = F.xxhash64("doc_id", "start", "ids_crc32").alias("_order")
    parts = parts.select("*", order, F.lit(1).alias("_one"), F.get(F.lit(bits), F.col("_class")).alias("_bits"))
    bucket = F.when(F.col("_bits") == 0, 0).otherwise(F.expr("shiftright(_order, 64 - _bits)")).cast("long")
    tie = [F.col("_order"), F.col("doc_id"), F.col("doc_tokens")]
    ranked = running_total(parts.withColumn("_bucket", bucket), ["_class"], "_bucket", tie, "_one", "_rank")
    shelves = docs.sparkSession.createDataFrame(_shelves(counts, length, unit), "_c int, _from long, _to long, _each long, _base long, _slot long")
    on = (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(shelves), on)  # some rows for each of length / unit classes
    nth = F.col("_rank") - F.col("_from")
    placed = placed.withColumns({"sequence_id": F.col("_base") + F.expr("(_rank - _from) div _each"), "_at": F.col("_slot") + F.pmod(nth, F.col("_each"))})
    before = W.partitionBy("sequence_id").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
