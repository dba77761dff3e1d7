from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    good = [(i, prose(i, 120) + "\n" + prose(1000 + i, 80), "en", f"s{i % 4}", 0) for i in range(200)]
    copies = [(300 + i, re.sub(r"^(\S+ ){50}\S+", lambda m: m[0].rpartition(" ")[0] + " changed", good[i][1]), "en", "s1", 0) for i in range(5)]
    near = [(400 + i, " ".join("edit" if k in (30, 160) else w for k, w in enumerate(good[20 + i][1].replace("\n", " ").split())), "en", "s2", 0) for i in range(5)]
    bad = [(500 + i, " | ".join(prose(i, 60).upper().split()), "en", "s0", 0) for i in range(100)]
    spark.createDataFrame(good + copies + near + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not any(i >= 500 for i in ids["quality_classifier"]) and ids["quality_classifier"] >= set(range(200))
    assert ids["line_dedup"] >= set(range(200)) and not ids["line_dedup"] & set(range(300, 305))
    assert ids["ngram_join"] >= set(range(200)) and not ids["ngram_join"] & set(range(400, 405))
    words = sum(len(re.findall(r"\S+", r["text"])) for r in seen["ngram_join"].collect())
    mixed = sum(len(re.findall(r"\S+", r["text"])) for r in seen["mixing"].collect())
    assert 0.99 * words <= mixed <= words
    assert ids["packing"] == ids["mixing"]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_copies_with_short_lines_go(spark):
    text = f"Short title\n{prose(1, 40)}\n\nAll rights reserved."
    rows = [(1, text), (2, text), (3, text.replace("Short title", "Another title")), (4, "All rights reserved."), (5, prose(1, 40)), (6, None), (7, "Page 1 of many"), (8, f"Page 2 of many\n{prose(1, 40)}"), (9, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out == {1: text, 3: "Another title\n", 6: None, 7: "Page 1 of many", 8: "Page 2 of many"}


def test_lines_alike_to_any_earlier_one_go(spark):
    line = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxy"]
    other = " ".join("else" if i in (4, 8, 13, 17, 22) else w for i, w in enumerate(line))
    docs = spark.createDataFrame([(1, " ".join(line), "en", "s", 0), (2, f"{other}\nAnd this stays", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: " ".join(line), 2: "And this stays"}


def test_columns_may_have_any_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("*", *(F.col("doc_id").alias(c) for c in ("score", "predicted", "n_lines", "n_dropped", "_drop", "_key", "size", "taken", "component_id", "start")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)


def written(frame, path):
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def test_stages_like_brute_force(spark, folder, tmp_path):
    """Every stage over what the one before kept, against plain Python over the same rows."""
    import collections

    from tessera.llm import quality_model
    from tests.llm import test_text_operators as brute

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    held = {name: written(stages[name](spark, docs, folder), f"{tmp_path}/first") for name in ("quality_classifier",)}
    import pyarrow as pa

    rows = docs.collect()
    scores = model.score(quality_model.statistics(pa.array([r["text"] for r in rows])))
    kept = held["quality_classifier"].collect()
    assert sorted(map(tuple, kept)) == sorted(tuple(r) for r, s in zip(rows, scores, strict=True) if s >= 0.5)

    lines = written(stages["line_dedup"](spark, held["quality_classifier"], folder), f"{tmp_path}/second")
    gone = brute.brute_lines([(r["doc_id"], r["text"]) for r in kept])
    want = {}
    for r in kept:
        left = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], r["text"], n) not in gone)
        if left == r["text"] or left.split():
            want[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want

    near = written(stages["ngram_join"](spark, lines, folder), f"{tmp_path}/third")
    classes = brute.brute_classes(sorted(want.items()), 5, 8, 10)
    assert {r["doc_id"] for r in near.collect()} == {d for d, _, c in classes if d == c}

    mixed = written(stages["mixing"](spark, near, folder), f"{tmp_path}/fourth")
    given = [(r["doc_id"], r["source"], len(r["text"].split()), r["text"]) for r in near.collect()]
    taken, found = dict(zip([g[0] for g in given], brute.brute_queue(given), strict=True)), collections.Counter()
    for r in mixed.collect():
        found[r["doc_id"]] += len(r["text"].split())
    assert +found == collections.Counter({d: n for d, n in taken.items() if n})

    packed = stages["packing"](spark, mixed, folder).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    from tokenizers import Tokenizer

    library, sizes = Tokenizer.from_file(brute.tokenizer_path()), collections.Counter()
    for r in mixed.collect():
        sizes[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert tokens == sizes
    filled = collections.Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    lengths = [n for r in mixed.collect() for n in [len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1]]
    assert max(filled.values()) <= 2048 and len(filled) <= first_fit(lengths, 2048)


def first_fit(lengths, room):
    """Sequences that first-fit decreasing needs for documents that are not cut; these are all about as long, so some room must stay."""
    left = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, x in enumerate(left) if x >= n), None)
        if at is None:
            left.append(room - n)
        else:
            left[at] -= n
    return len(left)
