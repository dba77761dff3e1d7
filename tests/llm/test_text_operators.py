from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, line_templates, mixing, ngram_join, packing, quality_model, quality_rules
from tessera.llm.graph import connected_components
from tests.llm.fixtures import documents, no_documents, prose

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 21), (30, 30), (None, 1)] + [(i, i + 1) for i in range(100, 160)]
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    found = {r["node"]: r["component"] for r in rows}
    assert found[9] == found[5] == 3 and found[21] == 20 and found[30] == 30 and found[160] == 100
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_classes(docs, width, num, den):
    sets = []
    for doc, text in docs:
        w = split((text or "").translate(LOWER))
        sets.append((doc, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    label = {d: d for d, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            shared = len(s & t)
            if s and t and den * shared >= num * (len(s) + len(t) - shared):
                x, y = find(a), find(b)
                label[max(x, y, key=key)] = min(x, y, key=key)
    return sorted(((d, len(s), find(d)) for d, s in sets), key=repr)


def key(x):
    return (x is None, x)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 8, 10), (2, 1, 2)])
def test_near_duplicates_match_all_pairs(spark, width, num, den):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    for g in range(12):  # groups of near copies of all degrees
        words = prose(50 + g, 60 + 40 * g).split()
        for c in range(6):
            rows.append((100 + 10 * g + c, " ".join("edit" if i % max(2, 60 // (c + 1)) == c else w for i, w in enumerate(words))))
    rows += [(900, "a b c d"), (901, "A B c d"), (902, "a b"), (903, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_duplicate_classes(frame, width=width, num=num, den=den).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_classes(rows, width, num, den)


def test_tiles_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    words = prose(7, 100).split()
    rows = [(i, " ".join(["x" * (1 + i)] * (i % 30) + words[i % 30 :])) for i in range(40)]
    found = ngram_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2, num=7, den=10).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_classes(rows, 2, 7, 10)


@pytest.mark.parametrize("num, den", [(9, 10), (8, 10), (6, 10)])
def test_a_passage_that_many_documents_share(spark, monkeypatch, num, den):
    """Sets of large tiles meet in tiles of their rarest shingles: no link is lost, and the passage itself makes no tile."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    passage, seen = prose(3, 60), []
    rows = [(i, f"{prose(100 + i // 3, 50)} {passage} {prose(500 + i, i % 4)}") for i in range(60)]
    rows += [(60 + i, prose(900, 70) + f" {i}") for i in range(20)] + [(80, passage), (81, None), (82, "x")]
    by_rarest = ngram_join._by_rarest
    monkeypatch.setattr(ngram_join, "_by_rarest", lambda *a: seen.append(by_rarest(*a)) or seen[-1])
    found = ngram_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=num, den=den).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_classes(rows, 3, num, den)
    assert seen and max(r["count"] for r in seen[0].groupBy("mark").count().collect()) < 30


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicate_classes(no_documents(spark)).collect() == []


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 20, 500, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        assert ngram_join.bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) >= len(np.intersect1d(a, b))


def brute_tokens(line):
    own = split(line)
    masked = ["<*>" if re.search("[0-9]", w) else w for w in own]
    constant = len(own) - masked.count("<*>")
    if len(own) < 5 or constant < 3 or 2 * constant < len(own):
        return tuple(own), masked == own
    return tuple(masked), True


def brute_lines(rows):
    """The lines that go, by a tree of dictionaries: token count, leading tokens, one field of the rest."""
    first, lines = {}, []
    for doc, text in rows:
        for n, line in enumerate(text.split("\n") if text is not None else []):
            t, varies = brute_tokens(line)
            if t:
                lines.append((doc, text, n, t))
                first[t] = (min(first[t][0], doc) if t in first else doc, varies and len(t) >= 10)
    tree = collections.defaultdict(list)
    for t, (doc, varies) in first.items():
        for g in range(5) if varies else ():
            rest = len(t) - 3
            tree[len(t), t[:3], g, t[3 + rest * g // 5 : 3 + rest * (g + 1) // 5]].append((doc, t))
    merged = {t: doc for t, (doc, _) in first.items()}
    for branch in tree.values():
        doc, head = min(branch, key=lambda x: (x[0], hashlib.md5(" ".join(x[1]).encode()).hexdigest()))
        for _, t in branch:
            known = [x == y for x, y in zip(t, head, strict=True) if not x == y == "<*>"]
            if 10 * sum(known) >= 8 * len(known):
                merged[t] = min(merged[t], doc)
    return {(d, text, n) for d, text, n, t in lines if merged[t] < d}


def check_lines(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, _drop int")
    out = line_templates.drop_recurring_lines(frame).collect()
    gone = brute_lines([(2**63 - 1 if d is None else d, t) for d, t in rows])
    want = collections.Counter()
    for d, t in rows:
        key = 2**63 - 1 if d is None else d
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (key, t, n) not in gone)
        want[d, left, 0 if t is None else t.count("\n") + 1, sum((key, t, n) in gone for n in range((t or "").count("\n") + 1))] += 1
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out) == want
    return {r["doc_id"]: r["text"] for r in out}


def test_line_templates(spark):
    shared = "User alice logged in from host 10.0.0.1 at noon with a fresh token today"
    rows = [
        (1, shared + "\nonly here one two three"), (2, "top line\n" + shared.replace("10.0.0.1", "172.16.9.9")), (3, shared.replace("fresh token", "stale cookie")),
        (4, None), (5, ""), (6, "short one"), (7, "short one"), (8, "one two three four five"), (9, " one  two three\tfour five"), (9, "top line"), (None, shared), (9, "top line"),
    ]
    out = check_lines(spark, rows)
    assert out[2] == "top line" and out[3] == "" and out[1].startswith("User") and out[7] == "" and out[None] == ""
    everything = line_templates.drop_recurring_lines(documents(spark))
    assert everything.count() == documents(spark).count() and "component" in everything.columns
    assert line_templates.drop_recurring_lines(no_documents(spark)).count() == 0


def test_two_fields_vary(spark):
    line = "job {} on node {} finished its run in the night and was sent to {} by {}"
    rows = [(1, line.format(17, "b2", "Ann", "mail")), (2, line.format(18, "b3", "Bob", "post")), (3, line.format(18, "b3", "Bob", "post").replace("night", "day").replace("finished its run", "has no end"))]
    assert len(split(rows[0][1])) == 18
    assert check_lines(spark, rows) == {1: rows[0][1], 2: "", 3: rows[2][1]}


@pytest.mark.parametrize("seed", range(3))
def test_lines_like_a_tree_of_dictionaries(spark, monkeypatch, seed):
    import random

    monkeypatch.setattr(line_templates, "FILTER_WORDS", 1 if seed else 1 << 17)
    rng = random.Random(seed)
    heads = [prose(700 + i, 4 + i % 14).split() for i in range(12)]

    def line():
        words = list(rng.choice(heads))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(["7", "eight", "9x", "ten"])
        return rng.choice([" ", "  ", "\t"]).join(words)

    rows = [(rng.randrange(40), "\n".join(line() for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    assert any(text == "" for text in check_lines(spark, rows).values())


def brute_whole(rows):
    """The lines that go if every line meets every earlier one of its token count and leading tokens."""
    first, lines = {}, []
    for doc, text in rows:
        for n, line in enumerate(text.split("\n")):
            t, varies = brute_tokens(line)
            if t:
                lines.append((doc, n, t))
                first[t] = (min(first[t][0], doc) if t in first else doc, varies and len(t) >= 10)
    merged = {t: doc for t, (doc, _) in first.items()}
    for t, (doc, varies) in first.items():
        for o, (other, also) in first.items():
            if varies and also and other < doc and len(o) == len(t) and o[:3] == t[:3]:
                known = [x == y for x, y in zip(t, o, strict=True) if not x == y == "<*>"]
                if 10 * sum(known) >= 8 * len(known):
                    merged[t] = min(merged[t], other)
    return {(d, n) for d, n, t in lines if merged[t] < d}


def check_whole(spark, rows):
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    gone = brute_whole(rows)
    left = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}
    assert {r["doc_id"]: r["text"] for r in out} == left and sum(r["n_dropped"] for r in out) == len(gone) and len(out) == len(rows)
    return left


def changed(line, *places):
    return " ".join(f"other{i}" if i in places else w for i, w in enumerate(line.split()))


def test_lines_alike_to_none_of_the_earliest(spark):
    """A line alike to the second of its branch only, and one that differs from its like in each of five fields."""
    line, spread = " ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(20)), " ".join(f"v{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(25))
    first, second = changed(line, 3, 4, 5), line
    third = changed(line, 16, 17)
    rows = [(1, first), (2, second.replace("wt", "x").replace("ws", "y")), (3, third), (4, spread), (5, changed(spread, 4, 8, 13, 17, 22))]
    assert check_whole(spark, rows) == {1: first, 2: rows[1][1], 3: "", 4: spread, 5: ""}


@pytest.mark.parametrize("seed", range(3))
def test_whole_leaves_like_all_pairs(spark, seed):
    import random

    rng = random.Random(seed)
    heads = [prose(800 + i, 10 + 5 * i).split() for i in range(8)]

    def line():
        words = list(rng.choice(heads))
        for _ in range(rng.randrange(len(words) // 3)):
            words[rng.randrange(3, len(words))] = rng.choice(["7", "eight", "nine", "ten"])
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(70)]
    check_whole(spark, rows)
    assert len(brute_whole(rows)) > len(brute_lines(rows))


def test_rows_of_numbers_are_compared_literally(spark):
    rows = [
        (1, "12 7 3.5 40 9\n1 2 3 4 5 6 7 8 9 10 11\nSum 1 2 3 4\n1 2 3 4 5 6 7 8 9 a b c"), (2, "12 7 3.6 40 9\n1 2 3 4 5 6 7 8 9 10 12\nSum 1 2 3 5\n1 2 3 4 5 6 7 8 8 a b c"),
        (3, "12  7 3.5 40 9\n1 2 3 4 5 6 7 8 9 10 12\nSum 1 2 3 6"), (4, "paid 12 euros to Ann"), (5, "paid 13 euros to Ann"),
    ]
    assert check_lines(spark, rows) == {**dict(rows[:2]), 3: "Sum 1 2 3 6", 4: rows[3][1], 5: ""}


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    from tessera.llm import common

    rows = [(7, i) for i in range(3000)] + [(i % 50 + 100, i) for i in range(1000)] + [(9, 1)]
    frame = spark.createDataFrame(rows, "k long, v long")
    table = common.cut(frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")).where("n > 1"))
    joined = common.spread_join(frame, table, ["k"], "n")
    assert sorted(map(tuple, joined.select("k", "v", "m").collect())) == sorted((k, v, 2999 if k == 7 else 950 + k - 100) for k, v in rows if k != 9)
    monkeypatch.setattr(common, "HOT", 2)
    assert common.spread_join(frame, table, ["k"], "n").count() == 4000


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > epochs * sizes[s]]
        if not over:
            return {**capped, **target}
        capped.update({s: epochs * sizes[s] for s in over})


def brute_queue(rows, epochs=3, quantum=16):
    """Words taken of each document, by a queue that serves one item after the other."""
    import heapq

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sizes = collections.Counter()
    for _, source, size, _ in rows:
        sizes[source] += size
    target, budget, heap = brute_targets(sizes, epochs=epochs), sum(sizes.values()), []
    for source in sizes:
        own = sorted((md5(f"mix:{'' if d is None else d}"), md5(t), i) for i, (d, s, n, t) in enumerate(rows) if s == source and n)
        at = 0
        for _, _, i in own * epochs:
            size = rows[i][2]
            step = quantum if at < target[source] < at + size else size
            for part in range(0, size, step):
                n = min(step, size - part)
                heap.append(((at + part + n) / target[source], source is None, source or "", at + part, n, i))
            at += size
    heapq.heapify(heap)
    taken = [0] * len(rows)
    while heap and budget:
        *_, n, i = heapq.heappop(heap)
        taken[i] += min(n, budget)
        budget -= min(n, budget)
    return taken


@pytest.mark.parametrize("most", [10_000, 2])
def test_mixing(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
    docs = documents(spark)
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    given = [(r["doc_id"], r["source"], len(split(r["text"])), r["text"] or "") for r in docs.collect()]
    want = collections.Counter((d, s, n, t) for (d, s, n, _), t in zip(given, brute_queue(given), strict=True))
    assert collections.Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rows) == want
    sizes = collections.Counter()
    for _, source, size, _ in given:
        sizes[source] += size
    target = brute_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= mixing.QUANTUM for s in target) and sum(taken.values()) == sum(sizes.values())
    order = mixing.Mix(docs).order.collect()
    assert sum(r["taken"] for r in order) == sum(taken.values())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(split(r["text"]))
    want = collections.Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    assert +got == +want
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.taken_words(docs.repartition(7)).collect()), key=repr)
    assert mixing.mixed_documents(no_documents(spark)).count() == 0 and mixing.taken_words(no_documents(spark)).count() == 0


def test_mixed_documents_keep_any_columns_and_repeated_rows(spark):
    rows = [(i, prose(i, 20 + i), f"s{i % 3}", i, "t", "o", 0, 1.5) for i in range(40)]
    rows += [(3, prose(3, 23), "s0", 77, "u", "p", 1, 2.5), (50, None, None, 1, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken string, _order string, _begin long, virtual_finish double")
    out = mixing.mixed_documents(docs).collect()
    assert out[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert {r["size"] for r in out if r["doc_id"] == 3} == {3, 77} and {tuple(r)[3:] for r in out} <= {r[3:] for r in rows}
    texts, begun = {r[0]: r[1] for r in rows}, collections.Counter()
    for r in out:  # the rows come in the order of the queue: no source is ahead of another by more than the document in service
        assert r["text"] is None or texts[r["doc_id"]].startswith(r["text"])
        begun[r["source"]] += len(split(r["text"]))
    assert sum(begun.values()) == sum(len(split(r[1])) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_targets_level_out(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 20_000]) for i in range(9)} | {None: 7}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = brute_targets(sizes)
    assert all(math.isclose(found[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs, library = documents(spark), Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    filled = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        filled += at
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        copies = 2 if r["doc_id"] == 8 else 1
        assert sum(p["length"] for p in pieces[r["doc_id"]]) == copies * len(ids)
        for p in pieces[r["doc_id"]]:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part)
    assert packing.pack(no_documents(spark), tokenizer_path()).count() == 0


def test_ids_of_both_tokenizers():
    """The fast way gives the ids of the library: for every code point in context, for random strings, for all that texts hold."""
    import random

    from tokenizers import Tokenizer

    library, both = Tokenizer.from_file(tokenizer_path()), packing.Ids.of(tokenizer_path())
    rng = random.Random(5)
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"ab {c}{c} x{c}1 {c}\n" for c in points]
    texts += ["".join(rng.choice(points) if rng.random() < 0.3 else rng.choice(" \n\t'sdmtlreve019.,<|>") for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += [x for x in texts_of_fixtures() if x and len(x) < 100_000] + ["<|endoftext|>", "a<|endoftext|>b", "", " ", "\r\n\r\n  \n"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(both.encode(t), "<u4").tolist() for t in texts] == want


def texts_of_fixtures():
    from tests.llm.fixtures import texts

    return texts()


@pytest.mark.parametrize("run", [" " * 1_000_001, "\n" * 3_000_000])
def test_long_white_space_is_packed(spark, run):
    from tokenizers import Tokenizer

    text = f"before{run}after"
    ids = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 1]
    rows = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path()).collect()
    assert sum(r["length"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rows)


@pytest.mark.parametrize("seed", range(5))
def test_cutting_stock_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = collections.Counter(rng.integers(1, 65, 3000).tolist())
    patterns = packing.cutting_stock(dict(demand), 64)
    made = collections.Counter()
    for pattern, times in patterns:
        assert sum(size * n for size, n in pattern.items()) <= 64
        for size, n in pattern.items():
            made[size] += n * times
    assert made == demand
    assert sum(n for _, n in patterns) <= 1.03 * sum(s * n for s, n in demand.items()) / 64 + 3
    assert packing.cutting_stock({}, 64) == []


def brute_metrics(text):
    w = split(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_metrics(spark):
    docs = documents(spark)
    rows = quality_rules.base_metrics(docs).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=repr)
    assert found == sorted(((r["doc_id"], *brute_metrics(r["text"])) for r in docs.collect()), key=repr)


def test_binomial_tail():
    for n, p in ((10, 0.3), (200, 0.02), (1000, 0.005)):
        for k in range(0, int(n * p) + 1):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(quality_rules.binomial_tail(k, n, p), exact, rel_tol=1e-9)


def test_certified_cutoffs_keep_the_promise(spark):
    good = [(i, prose(i, 60), 1) for i in range(400)]
    bad = [(1000 + i, prose(i, 60).replace(" ", " *** "), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_rules.judge_quality(docs, labels, false_rejection=0.2).collect()}
    assert sum(not out[i]["kept"] for i in range(400)) <= 0.2 * 400
    assert not any(out[1000 + i]["kept"] for i in range(100)) and not out[None]["kept"]
    few = quality_rules.judge_quality(docs, labels.limit(3)).where("not base_failed and not kept")
    assert few.count() == 0  # nothing can be promised, so nothing is rejected
    assert quality_rules.judge_quality(no_documents(spark), labels).count() == 0


def test_classifier(spark):
    good = [(i, prose(i, 60 + i % 50), 1) for i in range(300)]
    bad = [(1000 + i, " | ".join(prose(i, 60).upper().split()), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (7, None), (7, 1)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    out = quality_model.score(docs, model).withColumn("held", quality_model.held_out(F.col("doc_id"))).collect()
    assert all(r["predicted"] == (r["doc_id"] < 1000) for r in out)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    odd = documents(spark).drop("score")
    scored = quality_model.score(odd, model)
    assert scored.count() == odd.count() and scored.where("score between 0 and 1").count() == odd.count()
    assert quality_model.score(no_documents(spark).drop("score"), model).count() == 0
    none = quality_model.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.score(docs.limit(3), none).collect()} == {0.5}


def test_held_out_labels(spark):
    """Labels that the model has not seen: area under the curve and accuracy on the tables."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the tables are not here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    wanted = labels.where(quality_model.held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    rows = quality_model.score(docs.join(wanted, "doc_id"), model).select("score", "predicted", "quality").collect()
    good, bad = (sorted(r["score"] for r in rows if r["quality"] == q) for q in (1, 0))
    above = sum(np.searchsorted(bad, s, "left") + 0.5 * (np.searchsorted(bad, s, "right") - np.searchsorted(bad, s, "left")) for s in good)
    assert len(rows) > 500 and above / (len(good) * len(bad)) > 0.99
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.97 * len(rows)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    model = quality_model.fit(x, y, trees=10, depth=3)
    for row, margin in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.base
        for t in range(10):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.cut[t, node])
            total += model.leaves[t, node - 7]
        assert math.isclose(total, margin)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert quality_model.statistics(pa.array([None, "", "a"])).shape == (3, len(quality_model.FEATURES))


def generalised_jaccard(a, b):
    x, y = collections.Counter(split(a)), collections.Counter(split(b))
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def test_fingerprints(spark):
    docs = documents(spark)
    rows = docs.collect()
    out = fingerprints.fingerprint_edits(docs).collect()
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    want = collections.Counter()
    for i, r in enumerate(ordered):
        text, after = r["text"] or "", ordered[(i + 1) % len(ordered)]["text"] or ""
        half = len(text) // 2
        want[r["doc_id"], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    prints = collections.defaultdict(set)
    text_of = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in out:
        prints[text_of[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.fingerprint_edits(no_documents(spark)).count() == 0
    assert fingerprints.fingerprint_edits(docs.where("doc_id = 9")).first()["near_next"] == 1.0
    assert {r["doc_id"] for r in fingerprints.fingerprint(docs.where("doc_id < 12").dropDuplicates(["doc_id"])).collect()} == set(range(12))


def test_collision_rate_is_generalised_jaccard(spark):
    rows = [(i, prose(i // 2, 200) if i % 2 else " ".join([*prose(i // 2, 200).split()[: 20 + 3 * i], *prose(900 + i, 60).split()])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(frame).collect()}
    errors = [out[i]["near_next"] - generalised_jaccard(rows[i][1], rows[i - 1][1]) for i in range(1, 60)]
    assert abs(sum(errors) / len(errors)) < 0.03 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.09


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    rows = [(i * i, prose(i, 20 + i)) for i in range(60)]
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (doc, text) in enumerate(rows):
        after, half = rows[i - 1][1], len(text) // 2
        assert out[doc]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
