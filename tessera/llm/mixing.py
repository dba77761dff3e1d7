"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, running_total, word_count, words

#: Weights of the sources by code point, repeating; the most often that a source is gone through.
WEIGHTS, EPOCHS = (5.0, 2.0, 1.0), 3
#: Words of one item of a document that is in service when its source has had its target; all others are one item.
QUANTUM = 16
#: Rows that one piece of a running total may hold on average.
PIECE = 4_096
#: The most sources whose table of sizes and targets is broadcast; with more it is joined by a shuffle.
MOST_BROADCAST = 10_000

_SOURCE = ["_name", "_none"]


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to a table ``(source, source_size, ...)`` with one row for each source.

    Sources in code point order, null last, weigh as ``weights`` repeating and share the sum of all sizes. A target
    stops at ``epochs`` times its source's size; what is left over is shared again by weight until none is above: the
    sources sorted by size over weight are filled in turn, and the first that does not reach its limit sets the level
    for the rest. The table has a row for each source, so its windows are small.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * epochs).cast("double")
    table = sources.withColumn("_weight", weight).withColumn("_limit", limit)
    ratio, everything = [F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last()], W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = W.orderBy(*ratio).rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy(*ratio).rowsBetween(0, W.unboundedFollowing)
    table = table.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_filled": F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0)),
            "_left": F.sum("_weight").over(later),
        }
    )
    table = table.withColumn("_level", (F.col("_total") - F.col("_filled")) / F.col("_left"))
    reached = F.col("_limit") <= F.col("_level") * F.col("_weight")
    level = F.min(F.when(~reached, F.struct(ratio[0].alias("r"), F.col("source").isNull().alias("n"), "source", "_level"))).over(everything)
    target = F.coalesce(F.least(level["_level"] * F.col("_weight"), F.col("_limit")), F.col("_limit"))
    return table.withColumn("target", target).drop("_weight", "_limit", "_total", "_filled", "_left", "_level")


class Mix:
    """The queues of one mix. ``placed`` has a row for each document, ``order`` one for each item that the mix takes.

    ``placed``: ``doc_id, source, size, source_size, target, start``. ``start`` is the number of words of its source that are
    shuffled before it, in the order of an MD5 of seed and id (rows that repeat an id come in the order of their texts'
    MD5). Running totals go by pieces of a source, so a source with a third of all rows is spread out too. Rows are known
    by ``_name, _none`` (the source and whether it is null) and ``start``, which no two documents with words share.
    """

    def __init__(
        self, docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix"
    ):
        self.docs, self.text, self.epochs = docs, text, epochs
        self.columns = {
            "doc_id": F.col(doc_id),
            "source": F.col(source).cast("string"),
            "_name": F.coalesce(F.col(source).cast("string"), F.lit("")),
            "_none": F.col(source).isNull(),
            "size": word_count(F.col(text)),
            "_order": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))),
            "_text": F.md5(F.coalesce(F.col(text), F.lit(""))),
        }
        rows = cut(docs.select(*(c.alias(n) for n, c in self.columns.items())))  # texts are read and split once
        summed = rows.groupBy("source", *_SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
        every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        open_ended = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * epochs)
        sources = source_targets(summed, weights, epochs).withColumns(
            {
                "_digits": F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("_rows") / PIECE))).cast("int"),
                "_budget": F.sum("source_size").over(every),
                "_horizon": 1 + F.coalesce(F.max(F.when(open_ended, 2 * QUANTUM / F.col("target"))).over(every), F.lit(0.0)),
            }
        )
        self.sources = cut(sources.drop("source", "_rows"))
        self.few = self.sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        keyed = self._with_sources(rows)
        self.pieces = cut(keyed.groupBy(*_SOURCE, "_piece").agg(F.sum("size").alias("_sum")))
        self.placed = cut(self._place(keyed))

    def _small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.few else table

    def _with_sources(self, rows: DataFrame) -> DataFrame:
        joined = rows.join(self._small(self.sources), _SOURCE).withColumn("_piece", F.substring(F.col("_order"), F.lit(1), F.col("_digits")))
        # else rows would stay dealt by source, and a source's pieces in one task
        return joined if self.few else joined.repartition(*_SOURCE, "_piece")

    def _place(self, keyed: DataFrame) -> DataFrame:
        return running_total(keyed, _SOURCE, "_piece", [F.col("_order"), F.col("_text"), F.col("doc_id")], "size", "start", self.pieces)

    @property
    def order(self) -> DataFrame:
        """The items of the mix up to the end of its budget: ``_name, _none, start, copy, at, words, taken, virtual_finish``.

        Every document with words is queued ``epochs`` times over. An item is a copy of it, or QUANTUM words of the one copy of each source
        that is in service when the source reaches its target, so that the end can cut it. Its virtual finish time is its source's
        words up to its end over the source's target. Items are range-sorted by it over the whole cluster, a running total
        goes over the ranges, and the mix ends where the total budget, the sum of all sizes, is used up. No item that finishes after
        ``_horizon`` can come before that end: by then each source has had its target.
        """
        begin = F.col("copy") * F.col("source_size") + F.col("start")
        copies = self.placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(self.epochs - 1)))).withColumn("_begin", begin)
        serving = (F.col("_begin") < F.col("target")) & (F.col("_begin") + F.col("size") > F.col("target"))
        last = F.least(F.col("size") - 1, F.greatest(F.lit(0), F.ceil(F.col("_horizon") * F.col("target")) - F.col("_begin")).cast("long"))
        at = F.explode(F.when(serving, F.sequence(F.lit(0).cast("long"), last, F.lit(QUANTUM).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
        items = copies.withColumn("_step", F.when(serving, F.lit(QUANTUM)).otherwise(F.col("size"))).withColumn("at", at)
        items = items.withColumn("words", F.least(F.col("_step"), F.col("size") - F.col("at"))).withColumn("_begin", F.col("_begin") + F.col("at"))
        items = items.withColumn("virtual_finish", (F.col("_begin") + F.col("words")) / F.col("target")).where("virtual_finish <= _horizon")
        items = items.select(*_SOURCE, "start", "copy", "at", "words", "virtual_finish", "_begin", "_budget")
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["virtual_finish", "_none", "_name", "_begin"]
        ranges = cut(items.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
        totals = running_total(ranges, [], "_range", [F.col(c) for c in order], "words", "_before")
        taken = F.least("words", F.col("_budget") - F.col("_before"))
        return totals.where("_before < _budget").select(*_SOURCE, "start", "copy", "at", "words", taken.alias("taken"), "virtual_finish")

    def taken_words(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken``: the words of all items of each document."""
        served = self.order.groupBy(*_SOURCE, "start").agg(F.sum("taken").alias("_taken"))
        own = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.monotonically_increasing_id())  # no document without words has an item
        rows = self.placed.withColumn("start", own).join(served, [*_SOURCE, "start"], "left")
        return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"))

    def documents(self) -> DataFrame:
        """The copies that the mix takes, sorted by their virtual finish times, with the columns of the documents.

        The items of a source are taken in the order of its queue, so the words that the global order takes of each source tell which of its
        copies are in the mix. The texts are placed again rather than joined, so that repeated rows keep their own columns.
        """
        quotas = self.order.groupBy(*_SOURCE).agg(F.sum("taken").alias("_quota"))
        row = F.struct(*(F.col(f"`{c}`") for c in self.docs.columns)).alias("_row")
        whole = self.docs.select(*(c.alias(n) for n, c in self.columns.items()), F.col(f"`{self.text}`").alias("_words"), row)
        placed = self._place(self._with_sources(whole)).join(self._small(cut(quotas)), _SOURCE, "left")
        copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(self.epochs - 1))))
        begin = F.col("copy") * F.col("source_size") + F.col("start")
        copies = copies.withColumn("_begin", begin).withColumn("taken", F.least("size", F.coalesce("_quota", F.lit(0)) - F.col("_begin")))
        copies = copies.where("taken > 0 or (size = 0 and copy = 0)")
        finish = F.when(F.col("target") > 0, (F.col("_begin") + F.greatest("taken", F.lit(0))) / F.col("target"))
        copies = copies.withColumn("virtual_finish", F.coalesce(finish, F.lit(0.0)))
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["virtual_finish", "_none", "_name", "_begin", "_order", "_text"]
        copies = copies.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        short = (F.col("taken") < F.col("size")) & (F.col("taken") > 0)
        some = F.array_join(F.slice(words(F.col("_words")), F.lit(1), F.greatest(F.lit(1), F.col("taken").cast("int"))), " ")
        new = {self.text: F.when(short, some).otherwise(F.col("_words"))}
        if "n_chars" in self.docs.columns:
            new["n_chars"] = F.length(F.coalesce(new[self.text], F.lit(""))).cast(self.docs.schema["n_chars"].dataType)
        return copies.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in self.docs.columns))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row for each document with ``taken``, the words the mix takes of all its copies, 0 where it takes none.

    Columns: ``doc_id, source, size, source_size, target, taken``. Null texts and texts without words have size 0 and nothing taken;
    a source without words has target 0; null sources are one source; null ids are shuffled together, in the order of
    their texts; repeated rows are documents of their own. Extra columns are not read. No rows give no rows.
    """
    return Mix(docs, **options).taken_words()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, in the order of their virtual finish times.

    Copies repeat rows, and a cut copy has its first words, joined by single spaces; ``n_chars``, where there is one, is brought up to
    date. Documents without words stay once. Names of extra columns may be any; see :func:`taken_words` for the rest.
    """
    return Mix(docs, **options).documents()
