"""Texts that are awkward on purpose, and small tables of them."""

import random

AWKWARD = [
    None, "", " ", "\n", "\n\n \t\x0b\x0c\r", "a", "A b", "a b c", "É é ß x　y", "x" * 5000, "w " * 3000,
    "one two three four five six seven eight nine ten eleven twelve", "tab\tnew\nline\r\nend ", "  double  spaces  ",
    "▁mark ▁▁x", "<|endoftext|> token=abc \U0001F600", "\x00\x1c\x85 odd",
]


def prose(seed: int, n: int, words: int = 400) -> str:
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "", "ving")]
    out = []
    for i in range(n):
        word = rnd.choice(vocabulary[:words])
        out.append(word + (".\n" if i % 23 == 22 else "." if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)
