import random
import re
from collections import Counter

from pyspark.sql import functions as F

from bytewake.llm.line_dedup import MIN_PAGES, SHARES, drop_boilerplate


def blank(line):
    return re.fullmatch(r"[\x20\x09-\x0D]*", line)


def boilerplate(rows, shares=SHARES, least=MIN_PAGES):
    """(host, line) of the lines to drop."""
    pages = Counter(host for host, _ in set(rows))
    held = Counter((host, line) for host, text in set(rows) if text is not None for line in set(text.split("\n")))
    share = lambda line: next(s for up_to, s in shares if up_to is None or len(line) <= up_to)
    return {
        (host, line) for (host, line), n in held.items()
        if not blank(line) and n >= least and 1000 * n > share(line) * pages[host]
    }


def brute(rows, shares=SHARES, least=MIN_PAGES):
    drop = boilerplate(rows, shares, least)
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [line for line in lines if (host, line) not in drop]
        out.append((host, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    lines = ["menu", "footer é", "", "  ", "a|b", "unique"] + [f"line {i}" for i in range(40)]
    rows = [
        (rnd.choice(["a", "a", "a", "b", "c", None]), "\n".join(rnd.choices(lines, [9, 5, 5, 2, 1, 1] + [1] * 40, k=rnd.randint(1, 9))))
        for _ in range(300)
    ] + [("a", None), ("b", ""), (None, None), ("solo", "menu\nmenu")] + [("a", "menu\nfooter é")] * 5
    pages = spark.createDataFrame(rows, "host string, text string")
    shares = ((4, 250), (7, 200), (None, 60))
    got = drop_boilerplate(pages, shares=shares, min_pages=4).collect()
    want = brute(rows, shares, 4)
    assert sum(r[3] for r in want) > 100
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_share_falls_with_length(spark):
    """As set for production: of 200 pages of a host, four hold a long passage, four a sentence, five another, five a word."""
    passage, sentence, often = "long passage " * 20, "a sentence of some length", "another sentence of some length"
    rows = [("a", f"own text {i}\nits second line {i}") for i in range(200)]
    for i, extra in [(0, passage), (50, sentence), (100, often), (150, "word")]:
        for k in range(i, i + (5 if extra in (often, "word") else 4)):
            rows[k] = ("a", f"{rows[k][1]}\n{extra}")
    got = drop_boilerplate(spark.createDataFrame(rows, "host string, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    left = "\n".join(r["text"] for r in got)
    assert passage not in left and often not in left
    assert left.count(sentence) == 4 and left.count("word") == 5


def test_copies_are_one_page_and_near_copies_lose_what_they_share(spark):
    """A third of the host's rows are copies of one page; they stay whole.  Near copies in numbers count as pages with boilerplate."""
    rows = [("a", f"own {i}") for i in range(60)] + [("a", "first line\nsecond line\nthird line")] * 40
    near = [("b", f"own {i}") for i in range(60)] + [("b", f"first line\nsecond line\nown line {i}") for i in range(20)]
    got = drop_boilerplate(spark.createDataFrame(rows + near, "host string, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows + near))
    left = Counter(r["text"] for r in got)
    assert left["first line\nsecond line\nthird line"] == 40 and left["own line 7"] == 1


def test_page_of_boilerplate_alone_is_left_blank(spark):
    rows = [("a", f"menu\nown {i}") for i in range(9)] + [("a", "menu\n ")]
    got = {r["text"] for r in drop_boilerplate(spark.createDataFrame(rows, "host string, text string")).collect()}
    assert got == {f"own {i}" for i in range(9)} | {" "}


def test_long_text_empty_table_and_clashing_columns(spark):
    long = "\n".join(f"l{i}" for i in range(20000))
    rows = [("a", f"{long}\n{i}") for i in range(6)]
    pages = spark.createDataFrame(rows, "host string, text string").withColumn("n_Lines", F.lit("x")).withColumn("drop", F.lit(1)).withColumn("_Kept", F.lit(2))
    got = sorted(drop_boilerplate(pages).collect())
    assert [(r["text"], r["n_lines"], r["n_dropped"], r["drop"] + r["_Kept"]) for r in got] == [(str(i), 20001, 20000, 3) for i in range(6)]
    assert drop_boilerplate(pages.limit(0)).count() == 0


def test_native(spark):
    pages = spark.createDataFrame([("a", "x")], "host string, text string")
    plan = drop_boilerplate(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
