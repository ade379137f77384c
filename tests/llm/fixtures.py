"""Small documents with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, syllables=("ka", "lo", "mi", "tre", "son", "ab", "ur", "ny")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("xx", "yy")[i % 2]
        text = prose(rng, rng.randint(12, 90), ("ka", "lo", "mi", "tre") if lang == "xx" else ("süß", "ör", "pe", "qua"))
        out.append((i, text, lang, f"s{i % 3}", len(text)))
    base = out[5][1]
    out += [
        (n, base, "xx", "s0", 1),  # an exact copy
        (n + 1, base + " extra", "xx", "s1", 1),  # a near copy
        (n + 2, None, None, None, None),
        (n + 3, "", "xx", "s0", 0),
        (n + 4, " \t\n ", None, "s1", 4),
        (n + 5, "one", "xx", None, 3),
        (n + 6, "123 456 !!", "yy", "s2", 10),
        (n + 7, prose(rng, 20_000), "xx", "s0", 1),  # very long
        (n + 8, "<|endoftext|> a  b\n\n c d <|startoftext|>x", "xx", "s2", 1),
        (n + 9, "line\nline\nline\nÉté Σίσυφος İ 你好", "yy", "s2", 1),
    ]
    out.append(out[7])  # a repeated row
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


CLASHES = ["size", "kept", "shard", "slot", "_row", "ids", "score", "n_words", "words", "runs", "copy", "component_id", "key", "total", "length", "h"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def labels(spark, data=None):
    if data is None:
        data = [(i, int(i % 7 != 0), 0) for i in range(40)] + [(None, 1, 0), (41, None, None)]
    return spark.createDataFrame(data, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
