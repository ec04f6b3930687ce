"""The stages one after another against brute force, and the queries with SQL against DuckDB."""

import os

import duckdb
import pytest
import sentencepiece
import zstandard

import corpus_pipeline
from bytewake.llm import tokenizer_files
from bytewake.llm.quality_rules import Rules, measure
from bytewake.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import prose
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_line_dedup import blank, brute as brute_lines
from tests.llm.test_near_dedup import brute_fingerprint, brute_groups, near_copies

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not tokenizer_files.installed(), reason="vocabulary files are absent")


def brute(docs, items):
    compressor = zstandard.ZstdCompressor(level=Rules().level)
    docs = [(d, t, s) for d, t, s in docs if measure(t or "", Rules(), compressor).kept]
    after = []
    cut = brute_lines([(s, t) for _, t, s in docs])
    for (d, _, s), (_, text, _, dropped) in zip(docs, cut):
        if not dropped or any(not blank(x) for x in text.split("\n")):
            after.append((d, text, s))
    after.sort()
    roots = brute_groups([brute_fingerprint(t) for _, t, _ in after])
    after = [row for i, row in enumerate(after) if roots[i] == i]
    leaked = {r[0] for r in brute_leaks([(d, t) for d, t, _ in after], items) if r[5]}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files.path("piece_bpe_32k.model"))
    return sorted((d, tuple(library.encode(t))) for d, t, _ in after if d not in leaked)


def test_pipeline_equals_brute_force(spark, tmp_path):
    items = [(i, prose(900 + i, 25)) for i in range(3)]
    docs = [(i, f"shared footer line\n{prose(i, 70 + i)}", f"s{i % 2}") for i in range(24)]
    docs += [(30 + i, t, "s0") for i, t in enumerate(near_copies(1, 5))] + [(40 + i, prose(77, 90), "s1") for i in range(4)]
    docs += [(50, f"{prose(50, 80)} {items[1][1]}", "s0"), (51, None, "s0"), (52, "", None), (53, "too short", "s1"), (54, "same thing " * 90, "s1")]
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(docs, items)
    assert 50 not in dict(want) and len(want) > 20
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF_DIR).select(*columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))
