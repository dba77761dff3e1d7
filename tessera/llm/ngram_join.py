"""Exact Jaccard join of documents on word shingles, by size-banded tiles and hashed bitmap signatures.

Sizes are cut into bands. Two sets that reach the threshold differ in few shingles, at most k for a band, so when the hash
space is cut into more than k blocks the sets agree on all of some block. A tile holds the documents of a band (and those
just below it, that may pair with it) that agree on one block. Every pair above the threshold meets in a tile. Within tiles
bit counts of hashed bitmaps bound the overlap from above, and what remains is decided on the sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, release, small_batches, spread_join
from tessera.llm.graph import connected_components
from tessera.llm.shingles import mix, shingle_sets

_U = np.uint64
_LAST = 2**63 - 1
#: Documents of one tile that are compared at once. The sets of larger tiles get tiles of their rarest shingles; of those, the
#: ones that are still larger are cut into blocks of this size and each pair of blocks is compared apart.
TILE = 1024
#: Most bits of a bitmap, and bytes of the filter that says which documents' arrays are needed.
MAX_BITS, FILTER_BYTES = 1 << 15, 1 << 23


class Bands:
    """Bands of set sizes for a threshold ``num / den``, and the blocks that each band's sets are cut into.

    Only strong blocks, of at least ``least`` shingles, stand for a set, so that sets meet in a tile over more than one
    shingle of a passage that many documents share.
    """

    def __init__(self, num: int, den: int, top: int = 1 << 40):
        self.num, self.den = num, den
        high = num / den >= 0.85
        ratio, self.least = (den / num) ** (3 if high else 2), 3 if high else 2
        self.low = [1]
        while self.low[-1] <= top:
            self.low.append(int(self.low[-1] * ratio) + 1)
        self._blocks: dict[int, int] = {}

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1

    def most(self, size: int, band: int) -> int:
        """Shingles in which a set may differ from one that it reaches the threshold with, both at most of the band's sizes."""
        largest = 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        return min(largest, size * (self.den - self.num) // self.num)

    def _strong(self, size: int, blocks: int) -> float:
        """A number of strong blocks that a set of random hashes rarely falls below: the mean less three deviations."""
        rate = size / blocks
        p = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(self.least))
        return blocks * p - 3 * math.sqrt(blocks * p * (1 - p))

    def blocks(self, band: int) -> int:
        """The fewest blocks, in steps, of which nearly every set of the band has enough strong ones."""
        if band not in self._blocks:
            low, high = self.low[band], self.low[band + 1] - 1
            sizes = [max(1, low * self.num // self.den), low, (low + high) // 2, high]
            k = self.most(high, band)
            tries = sorted({k + 1 + round((k + 1) * i / 50) for i in range(100)})
            short = lambda m: max(self.most(s, band) + 1 - self._strong(s, m) for s in sizes)
            self._blocks[band] = next((m for m in tries if short(m) <= 0), min(tries, key=short))
        return self._blocks[band]

    def marks(self, found: np.ndarray) -> np.ndarray:
        """The blocks' hashes of one set, in its own band and in the next where it may pair with that.

        A set with more strong blocks than it may have differences agrees in one of them with any partner, which has that strong
        block too. A set with fewer gives all its blocks, empty ones too; two such sets meet in one of those.
        """
        size, out = len(found), []
        own = self.of(size) if size else 0
        for band in (own, own + 1):
            if not size or band > own and self.den * size < self.num * self.low[band]:
                continue
            k = self.most(size, band)
            if k == 0 and band == own and (size + 1) * self.num > size * self.den:
                continue  # only equal sets pair, and those are one set here
            m = self.blocks(band)
            block = ((found >> _U(32)) * _U(m)) >> _U(32)  # ascends with the sorted hashes
            edges = np.flatnonzero(np.diff(block, prepend=block[:1] + _U(1)))
            sums = mix(np.add.reduceat(mix(found), edges) + mix(block[edges] + _U(band << 32)))
            strong = np.diff(edges, append=size) >= self.least
            if strong.sum() > k:
                out.append(sums[strong])
            else:
                empty = np.setdiff1d(np.arange(m, dtype=_U), block[edges])
                out += [sums, mix(empty + _U((band << 32) + (1 << 31)))]
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Which of 2**w classes the hashes of a set fall into, at least four classes for each, as 64-bit words."""
    bits = min(MAX_BITS, max(64, 1 << (4 * max(1, len(found)) - 1).bit_length()))
    out = np.zeros(bits // 64, _U)
    at = found & _U(bits - 1)
    np.bitwise_or.at(out, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out


def fold(words: np.ndarray, length: int) -> np.ndarray:
    """A bitmap with fewer classes: those whose numbers agree in the low bits fall together."""
    return words if len(words) == length else np.bitwise_or.reduce(words.reshape(-1, length), axis=0)


def bound(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> int:
    """More shingles two sets do not share: every class that only one of them has holds one that the other lacks."""
    length = min(len(a), len(b))
    a, b = fold(a, length), fold(b, length)
    return min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))


def reaches(shared: int, size_a: int, size_b: int, num: int, den: int) -> bool:
    return den * shared >= num * (size_a + size_b - shared)


def _sets(rows: DataFrame, width: int, bands: Bands | None = None) -> DataFrame:
    """``doc, n, s1, s2, marks``: a set's size, two sums that identify it, and with ``bands`` its blocks' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, marks, none = [], [], [], [], np.zeros(0, np.int64)
            for found in shingle_sets(batch.column(1), width):
                once = mix(found)
                n.append(len(found))
                s1.append(once.sum().view(np.int64))
                s2.append(mix(once + _U(1)).sum().view(np.int64))
                marks.append(bands.marks(found) if bands else none)
            ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *marks]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "s1", "s2", "marks"])

    return rows.mapInArrow(run, "doc long, n long, s1 long, s2 long, marks array<long>")


def _arrays(rows: DataFrame, width: int, wanted: np.ndarray | None) -> DataFrame:
    """``doc, found, bits``: sorted arrays and bitmaps of the documents that the filter ``wanted`` lets pass."""
    spread = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = spread.value
        for batch in batches:
            if filled is not None:
                batch = batch.filter(pa.array(_passes(filled, batch.column(0).to_numpy())))
            sets = list(shingle_sets(batch.column(1), width))
            maps = [bitmap(x) for x in sets]
            columns = [batch.column(0)]
            for parts in (sets, maps):
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, _U), *parts]).view(np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, ["doc", "found", "bits"])

    return rows.mapInArrow(run, "doc long, found array<long>, bits array<long>")


def _places(docs: np.ndarray) -> list[np.ndarray]:
    h = mix(docs.astype(np.int64).view(_U))
    return [(h >> _U(s)) & _U(FILTER_BYTES * 8 - 1) for s in (0, 26)]


def _passes(filled: np.ndarray, docs: np.ndarray) -> np.ndarray:
    out = np.ones(len(docs), bool)
    for at in _places(docs):
        out &= (filled[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
    return out


def _filter_of(docs: DataFrame) -> np.ndarray:
    """A Bloom filter of ids: FILTER_BYTES, however many there are. Its words are joined on the executors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(FILTER_BYTES, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy()):
                np.bitwise_or.at(filled, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))
        words = filled.view(np.int64)
        held = np.flatnonzero(words)
        for i in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[i : i + (1 << 16)]), pa.array(words[held[i : i + (1 << 16)]])], ["at", "word"])

    parts = docs.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    table = parts.toArrow()
    words = np.zeros(FILTER_BYTES // 8, np.int64)
    words[table["at"].to_numpy()] = table["word"].to_numpy()
    return words.view(np.uint8)


def _verified(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold: bit counts first, then the sorted arrays."""
    left = arrays.select(F.col("doc").alias("a"), F.col("found").alias("fa"), F.col("bits").alias("ba"))
    right = arrays.select(F.col("doc").alias("b"), F.col("found").alias("fb"), F.col("bits").alias("bb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "fa", "ba", "fb", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for i in range(batch.num_rows):
                fa, ba, fb, bb = (batch.column(c)[i].values.to_numpy().view(_U) for c in range(2, 6))
                if not reaches(bound(ba, len(fa), bb, len(fb)), len(fa), len(fb), num, den):
                    continue
                shared = int((np.take(fb, np.searchsorted(fb, fa), mode="clip") == fa).sum()) if len(fb) else 0
                held.append(reaches(shared, len(fa), len(fb), num, den) and i)
            keep = [i for i in held if i is not False]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, "a long, b long")


def _within_tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components within tiles whose bit counts allow a link.

    ``rows``: ``mark, sid, n, component, bits``. A tile of over TILE rows is cut into blocks by a hash of the document; every
    pair of blocks is one group, so a group never holds more than about two blocks.
    """
    counted = rows.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("_of"))
    placed = rows.join(counted, "mark").withColumn("_own", F.pmod(F.xxhash64("sid", "mark"), "_of"))
    dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    dealt = dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})

    def run(table: pa.Table) -> pa.Table:
        own, i, j = table["_own"].to_numpy(), table["_i"][0].as_py(), table["_j"][0].as_py()
        sid, n, component = table["sid"].to_numpy(), table["n"].to_numpy(), table["component"].to_numpy()
        maps = [x.values.to_numpy().view(_U) for x in table["bits"].combine_chunks()]
        length = min(map(len, maps))
        bits = np.stack([fold(m, length) for m in maps])
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in first.tolist():
            ys = second[(component[second] != component[x]) & ((i != j) | (sid[second] > sid[x]))]
            ys = ys[den * np.minimum(n[ys], n[x]) >= num * np.maximum(n[ys], n[x])]
            if len(ys):
                most = np.minimum(n[x] - np.bitwise_count(bits[x] & ~bits[ys]).sum(1, dtype=np.int64), n[ys] - np.bitwise_count(bits[ys] & ~bits[x]).sum(1, dtype=np.int64))
                ys = ys[den * most >= num * (n[x] + n[ys] - most)]
                a += [min(sid[x], y) for y in sid[ys]]
                b += [max(sid[x], y) for y in sid[ys]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    columns = dealt.select("mark", "_i", "_j", "_own", "sid", "n", "component", "bits")
    return columns.groupBy("mark", "_i", "_j").applyInArrow(run, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Two documents link when ``den * intersection >= num * union`` of their sets of distinct shingles of ``width`` words (A-Z
    lower-cased, white space of ASCII); a text of fewer words is one shingle; without words the set is empty and linked
    with nothing. ``component_id`` is the smallest id reachable by links, itself included. The result is exact; no
    bucket is capped. Ids are integers; rows that share an id are one document in links; a null id is larger than any.
    Repeated rows give repeated results and other columns are not read.

    Equal sets become one first. In each tile every set is paired with the tile's smallest id only; what this leaves apart
    is compared in those tiles that hold several components. So a group of n copies costs n pairs. Sets of large tiles, as those
    that only share a common passage, are dealt to tiles of their rarest shingles first (see :func:`_by_rarest`).
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    sized = cut(_sets(rows, width).select("doc", "n", "s1", "s2"))
    shared = _shared_tiles(rows, width, Bands(num, den))
    release(spark)
    arrays = cut(_arrays(rows, width, _filter_of(shared.select("sid").distinct())))
    links = _links_to_leads(shared, arrays, num, den)
    release(spark)
    links = links.union(_links_across(shared, arrays, links, num, den))
    release(spark)
    whole = connected_components(links, "a", "b").select(F.col("node").alias("sid"), "component")
    found = _groups(sized).join(whole, "sid", "left").select("s1", "s2", "n", F.coalesce("component", "sid").alias("component"))
    out = sized.join(found, ["s1", "s2", "n"], "left").withColumn("component", F.coalesce("component", "doc"))
    real = [F.when(F.col(c) != _LAST, F.col(c)) for c in ("doc", "component")]
    return out.select(real[0].alias("doc_id"), F.col("n").alias("n_shingles"), real[1].alias("component_id"))


def _groups(sets: DataFrame, *more: Column) -> DataFrame:
    """Equal sets as one, under the smallest id."""
    return sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("sid"), *more)


def _shared_tiles(rows: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``mark, sid, n, lead`` for the tiles of two sets and more; lead is the smallest id of the tile."""
    marked = _groups(_sets(rows, width, bands), F.first("marks").alias("marks")).select("sid", "n", F.explode("marks").alias("mark"))
    tile = W.partitionBy("mark")
    tiles = marked.withColumns({"lead": F.min("sid").over(tile), "high": F.max("sid").over(tile)})
    return cut(tiles.where("lead < high").select("mark", "sid", "n", "lead"))


def _links_to_leads(shared: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    pairs = shared.where("lead < sid").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    return cut(_verified(pairs, arrays, num, den))


def _links_across(shared: DataFrame, arrays: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components that share a tile."""
    part = connected_components(links, "a", "b").select(F.col("node").alias("sid"), "component")
    named = shared.join(part, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = cut(_mixed(named))
    apart = named.join(mixed.where("tile <= 1"), "mark")
    if not mixed.where("tile > 1").isEmpty():
        crowd = named.join(mixed.where("tile > 1"), "mark").select("sid", "n", "component").distinct()
        rare = cut(_by_rarest(crowd, arrays, num, den))
        apart = apart.select("mark", "sid", "n", "component").union(rare.join(_mixed(rare), "mark").select("mark", "sid", "n", "component"))
    bits = arrays.select(F.col("doc").alias("sid"), "bits").dropDuplicates(["sid"])
    tiles = apart.join(bits, "sid").select("mark", "sid", "n", "component", "bits")
    return cut(_verified(_within_tiles(tiles, num, den), arrays, num, den))


def _mixed(tiles: DataFrame) -> DataFrame:
    """``mark, tile`` of the tiles that hold several components; ``tile`` is their size as a multiple of TILE."""
    sized = tiles.groupBy("mark").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), (F.count(F.lit(1)) / TILE).alias("tile"))
    return sized.where("c1 < c2").select("mark", "tile")


def _by_rarest(crowd: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """``mark, sid, n, component``: new tiles, one for a shingle, for the sets ``sid, n, component`` of tiles larger than TILE.

    Sets meet in a large tile over a passage that very many documents share. Shingles are ranked by how many of these sets hold
    them, and each set goes only to the tiles of its rarest. Two sets that reach the threshold share a part num / den, rounded up, of
    either; the rarest shingle that they share is left when either set drops all but one of so many of its commonest, so
    the pair meets there. Shingles that only one set holds need no tile and change no rank from above.
    """
    found = arrays.select(F.col("doc").alias("sid"), F.explode("found").alias("mark"))
    held = found.join(crowd.select("sid").distinct(), "sid").distinct()
    counts = cut(held.groupBy("mark").agg(F.count(F.lit(1)).alias("sets"), F.count(F.lit(1)).alias("weight")).where("sets > 1"))
    rank = F.row_number().over(W.partitionBy("sid").orderBy(F.desc("sets"), F.desc("mark")))
    ranked = spread_join(held, counts, ["mark"], "weight").withColumn("_rank", rank)
    return ranked.join(crowd, "sid").where(F.col("_rank") * den >= F.col("n") * num).select("mark", "sid", "n", "component")
