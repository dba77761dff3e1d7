"""Small tables with everything that operators must bear."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, line int, component string, start int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.4) for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 300)
    near = " ".join(("changed" if i == 150 else w) for i, w in enumerate(base.split()))
    return [
        None, "", " \t\n ", "One", "two words", base, base, near, prose(2, 80), prose(3, 80) + "\n" + prose(9, 60), prose(4, 70) + "\n" + prose(9, 60),
        "x " * 60, "é É ñ 日本語   'twas <|endoftext|> it's", prose(5, 30_000), "a b c d e f\nA B C D E F\na b c d e f", "#*$ %& |<> " * 20,
    ]


def doc_rows() -> list[tuple]:
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "") if i % 2 else None, None, "w", 1, "c", 2) for i, t in enumerate(texts())]
    rows.append(rows[8])  # a repeated row
    rows.append((None, prose(6, 90), None, None, None, None, None, None, None, None))
    rows.append((40, base_copy(), "en", "s1", 3, 1.0, None, None, None, None))
    return rows


def base_copy() -> str:
    return prose(1, 300)


def documents(spark):
    return spark.createDataFrame(doc_rows(), DOC_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
