"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import words

#: Samples in a fingerprint; the standard error of a likeness s is sqrt(s * (1 - s) / SAMPLES).
SAMPLES = 64
#: Rows that a bucket of neighbouring ids holds on average, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 512, 65_536
#: Samplers that are evaluated in one row; SAMPLES is a multiple of it.
AT_ONCE = 4
#: Values beyond this many times their mean are not looked for: a minimum lies there once in exp(FAR).
FAR = 12.0
_LOWEST = -(2**63)


def sample_order(term: Column, weight: Column, total: Column, k: Column) -> Column:
    """The k-th sampler's value for a term of a given weight, as a long whose minimum over a document is the sample.

    From a hash of the term and k come r and c, both of the Gamma(2, 1) distribution, and b, uniform in [0, 1). The
    weight is floored to a power of exp(r) shifted by b, t = floor(ln(w) / r + b), and the term with the least
    ln(c) - r * (t - b + 1) is sampled together with t; two weighted sets then have the same sample with a
    probability that is their generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones.
    The upper 31 bits hold that value, the lower 32 identify the term and t.

    Logarithms are costly, and few terms come near the minimum, which is exponential with the document's ``total`` weight as
    its rate. With x = exp(-r) and 1 - y <= c the value is at least (1 - y) * x / (x + p * (1 - x)) / w, where p is 1 - b for
    weight 1 (Bernoulli's inequality) and 1 else. Null where that is above FAR / total.
    """
    bits = F.xxhash64(term, k)

    def uniform(at: int, width: int) -> Column:
        part = F.shiftrightunsigned(bits, at) if at + width == 64 else F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(2**width - 1))
        return (part.cast("double") + 0.5) * F.lit(2.0**-width)

    x, y, b = uniform(0, 13) * uniform(13, 13), uniform(26, 13) * uniform(39, 13), uniform(52, 12)
    p = F.when(weight == 1, 1.0 - b).otherwise(1.0)
    near = (1.0 - y) * x * total < (x + p * (1.0 - x)) * weight * FAR
    r = -F.ln(x)
    t = F.floor(F.ln(weight) / r + b)
    value = F.ln(-F.ln(y)) - r * (t - b + 1)
    mark = F.shiftrightunsigned(term, 32).bitwiseXOR(t)
    return F.when(near, F.shiftleft(_place(value), 32).bitwiseOR(mark.bitwiseAND(F.lit(2**32 - 1))))


def _place(value: Column) -> Column:
    return F.floor((value + 64.0) * float(2**24))  # values lie between -64 and 8 for weights of at least 1


def with_terms(rows: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each word of a row's texts ``first`` and ``second``, with ``term``, ``weight``, ``side``, ``n_first`` and ``n_second``.

    A word that both have equally often is one row of side 3, else each side (1 and 2) has its own; a row without words gives
    one of weight 0. ``n_first`` and ``n_second`` are the texts' numbers of words. Hashes of words are sorted as primitive longs, with
    the number of the text in the lowest bit; then runs are counted. Nothing is shuffled.
    """
    keep = [c for c in rows.columns if c not in (first, second)]
    rows = rows.select(*keep, words(F.col(first)).alias("_w1"), words(F.col(second)).alias("_w2"))
    even = F.transform("_w1", lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)))
    odd = F.transform("_w2", lambda w: F.xxhash64(w).bitwiseOR(F.lit(1).cast("long")))
    keep += ["n_first", "n_second"]
    rows = rows.withColumns({"n_first": F.size("_w1"), "n_second": F.size("_w2"), "_all": F.concat(even, odd)}).select(*keep, "_all")
    rows = rows.select(*keep, F.sort_array("_all").alias("_s"))
    s = F.col("_s")
    ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
    rows = rows.select(*keep, "_s", F.when(F.size(s) > 0, ends).alias("_e"))
    # The outer form keeps rows without words, and no filter over the whole expression is inferred from it.
    rows = rows.select(*keep, "_s", "_e", F.posexplode_outer("_e").alias("_j", "_end"))
    e, j, end = F.col("_e"), F.coalesce("_j", F.lit(0)), F.coalesce("_end", F.lit(-1))
    value = F.coalesce(F.get(s, end), F.lit(0))
    before, after = F.coalesce(F.get(e, j - 1), F.lit(-1)), F.coalesce(F.get(e, j + 1), F.lit(-1))
    count, odd_one = end - before, value.bitwiseAND(F.lit(1)) == 1
    again = ~odd_one & F.coalesce(F.get(s, after) == value + 1, F.lit(False)) & (after - end == count)
    told = odd_one & F.coalesce(F.get(s, before) == value - 1, F.lit(False)) & (before - F.coalesce(F.get(e, j - 2), F.lit(-1)) == count)
    side = F.when(told, 0).when(odd_one, 2).when(again, 3).otherwise(1)
    rows = rows.select(*keep, value.bitwiseAND(F.lit(-2)).alias("term"), count.cast("double").alias("weight"), side.alias("side"))
    return rows.where("side <> 0")


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """A row for each of ``keys`` with ``first`` and ``second``, the samples of both texts; a text without words has null.

    ``rows`` come from :func:`with_terms`; their columns besides ``keys`` are numbers and are carried. Terms go through one hash
    aggregation; minima are combined before anything is shuffled, and where rows lie by a part of the keys, nothing
    is. A sampler whose minimum lies beyond FAR / total (one in exp(FAR)) has the sample -1; that depends on its text only.
    """
    meta = [c for c in rows.columns if c not in (*keys, "term", "weight", "side")]
    total = F.when(F.col("side") == 1, F.col("n_first")).when(F.col("side") == 2, F.col("n_second")).otherwise(F.least("n_first", "n_second"))
    term = rows.select(*keys, *meta, "term", "weight", "side", total.cast("double").alias("_total"))
    # A group of samplers at a time: so few columns make one small method, which the JIT compiler takes.
    term = term.select("*", F.explode(F.array(*(F.lit(g) for g in range(0, samples, AT_ONCE)))).alias("_k"))
    valued = [sample_order(F.col("term"), F.col("weight"), F.col("_total"), F.col("_k") + j).alias(f"v{j}") for j in range(AT_ONCE)]
    term = term.select(*keys, *meta, "side", "_k", *valued)
    sides = {"a": F.col("side") != 2, "b": F.col("side") != 1}
    minima = [F.min(F.when(on, F.col(f"v{j}"))).alias(f"{c}{j}") for j in range(AT_ONCE) for c, on in sides.items()]
    grouped = term.groupBy(*keys, "_k").agg(*(F.max(m).alias(m) for m in meta), *minima)
    found = []
    for c, n in (("a", "n_first"), ("b", "n_second")):
        far = F.shiftleft(_place(F.ln(FAR / F.col(n))), 32)
        own = F.array(*(F.when(F.col(f"{c}{j}") < far, F.col(f"{c}{j}")).otherwise(F.lit(-1)) for j in range(AT_ONCE)))
        found.append(F.when(F.col(n) > 0, own).alias(c))
    parts = grouped.select(*keys, *meta, F.struct("_k", *found).alias("_part"))
    joined = parts.groupBy(*keys).agg(*(F.max(m).alias(m) for m in meta), F.sort_array(F.collect_list("_part")).alias("_parts"))
    sides_of = [F.when(F.col(n) > 0, F.flatten(F.col(f"_parts.{c}"))).alias(name) for c, n, name in (("a", "n_first", "first"), ("b", "n_second", "second"))]
    return joined.select(*keys, *(m for m in meta if m not in ("n_first", "n_second")), *sides_of)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples; of two sides without terms 1, of one without terms 0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / float(samples))


def as_text(samples: Column) -> Column:
    """A fingerprint as hexadecimal text, eight digits for the identity of each sample; empty without terms."""
    digits = F.transform(samples, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(2**32 - 1))), 8, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(""))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id, samples, fingerprint`` of every document, for rows with unique ids.

    The terms are the words of the whole text, weighted by their number. Null and empty texts have null samples and an
    empty fingerprint.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), F.lit("").alias("_none"))
    out = signatures(with_terms(rows, "_t", "_none"), ["doc_id"], samples)
    return out.select("doc_id", F.col("first").alias("samples"), as_text(F.col("first")).alias("fingerprint"))


def neighbour_buckets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns ``_id, doc_id, _text, _bucket, _order`` with every document and, at the end of its bucket, the next one's copy.

    Buckets are ranges of ids between approximate quantiles, so that neighbours lie together. ``_order`` is 0 for rows of the
    bucket and above for copies: the first document of the next lower bucket or, below the last, of the highest. At most
    MAX_BUCKETS pairs of numbers reach the driver and are broadcast.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    ids = rows.select("_id")
    wanted = int(min(MAX_BUCKETS, max(1, ids.count() // BUCKET_ROWS)))
    coarse, fine = _bounds(ids, wanted)
    first = F.size(F.filter(F.lit(coarse) if coarse else F.array().cast("array<bigint>"), lambda x: x <= F.col("_id")))
    second = F.size(F.filter(F.get(F.lit(fine), first), lambda x: x <= F.col("_id")))
    bucket = (first.cast("long") * F.lit(len(max(fine, key=len)) + 1) + second).alias("_bucket")
    heads = sorted((r["_bucket"], r["top"]) for r in ids.select("_id", bucket).groupBy("_bucket").agg(F.max("_id").alias("top")).collect())
    copies = [(top, heads[i + 1][0] if i + 1 < len(heads) else heads[0][0], 1 if i + 1 < len(heads) else 2) for i, (_, top) in enumerate(heads)]
    spark = docs.sparkSession
    halo = spark.createDataFrame(copies, "_id long, _above long, _wrap int")
    marked = rows.select("*", bucket).join(F.broadcast(halo), "_id", "left")
    places = F.array_compact(
        F.array(
            F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("o")),
            F.when(F.col("_above").isNotNull(), F.struct(F.col("_above").alias("b"), F.col("_wrap").alias("o"))),
        )
    )
    dealt = marked.select("_id", "doc_id", "_text", F.explode(places).alias("_p"))
    return dealt.select("_id", "doc_id", "_text", F.col("_p.b").alias("_bucket"), F.col("_p.o").alias("_order"))


def _bounds(ids: DataFrame, wanted: int) -> tuple[list[int], list[list[int]]]:
    """Ascending bounds of about ``wanted`` ranges, as a coarse list and a list of finer ones below each of its steps."""
    if wanted < 2:
        return [], [[_LOWEST]]
    share = [i / wanted for i in range(1, wanted)]
    found = ids.agg(F.percentile_approx("_id", share, max(10_000, 4 * wanted)).alias("q")).first()["q"]
    bounds = sorted(set(found))
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    return [p[0] for p in parts], [[_LOWEST], *parts]


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document in descending order of ids, after the last the first. Columns: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``. Null texts count as empty; null ids come last;
    rows with equal ids come in the order of their texts; a lone document is its own next. Ids are integers. Other
    columns are not read. Texts are shuffled once, by ranges of ids; terms are not shuffled at all.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = neighbour_buckets(docs, doc_id, text).repartition(parts, "_bucket")
    order = W.partitionBy("_bucket").orderBy("_order", F.desc("_id"), "_text")
    rows = dealt.withColumns({"_next": F.lead("_text").over(order), "_row": F.row_number().over(order)})
    n, half = F.length("_text"), F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.select("_bucket", "_row", "_order", "doc_id", n.cast("long").alias("n_chars"), "_text", edited.alias("_edited"))
    rows = rows.withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
    digits = [F.conv(F.substring("_sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"_sha{i}") for i in range(4)]  # numbers are cheaper to carry
    rows = rows.select("_bucket", "_row", "_order", "doc_id", "n_chars", "_text", "_edited", *digits)
    signed = signatures(with_terms(rows, "_text", "_edited"), ["_bucket", "_row"], samples)
    after = F.lead("first").over(W.partitionBy("_bucket").orderBy("_row"))
    there = F.lead("_row").over(W.partitionBy("_bucket").orderBy("_row")).isNotNull()
    out = signed.withColumns({"_after": after, "_there": there}).where("_order = 0")
    return out.select(
        "doc_id",
        "n_chars",
        F.concat(*(F.lpad(F.lower(F.hex(f"_sha{i}")), 16, "0") for i in range(4))).alias("edited_sha256"),
        as_text(F.col("first")).alias("fingerprint"),
        as_text(F.col("second")).alias("edited_fingerprint"),
        likeness(F.col("first"), F.col("second"), samples).alias("near_edited"),
        likeness(F.col("first"), F.col("_after"), samples).alias("near_next"),
    )
