"""Small tables with the cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits string, n string, key string, lead string"


def words(r: random.Random, n: int) -> str:
    pool = ["the", "ing", "ion", "era", "st", "le", "de", "ou", "la", "ve"]
    return " ".join("".join(r.choice(pool) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, repeated rows, ties, characters of every width."""
    r = random.Random(5)
    texts = [None, "", " ", "a", "\n", "one two", "Ünïcödé 日本語 😀 text", "tab\tand  two spaces ", words(r, 12), words(r, 60), words(r, 30_000), "<|endoftext|> x<|endoftext|>", "\0 nul", "x" * 70_000, "1" * 3000]
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(50, "same words here again and again", None, None, None, None, None, None, None)] * 2
    rows += [(51, "same words here again and again", "en", "s", 1, None, None, None, None)]
    rows += [(None, "no id here", "en", "s", 1, None, None, None, None)]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
