import random
import zlib

import pytest
from pyspark.sql import functions as F

from bytewake import session
from bytewake.llm import token_records as tr
from bytewake.llm import tokenizer_files
from bytewake.staging import stage_in
from tests.llm.helpers import AWKWARD, prose

pytestmark = pytest.mark.skipif(not tokenizer_files.installed(), reason="vocabulary files are absent")


@pytest.fixture(scope="module")
def spec():
    return tokenizer_files.content("byte_bpe_50k.json").decode()


def library(spec, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def written(spark, docs, spec, **more):
    return tr.write(docs, session.work_dir(spark, "records"), spec, stage_in(spark, "test"), **more)


def test_parts_give_the_ids_of_the_whole(spec):
    rnd = random.Random(3)
    some = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", "'", "12", ".", "!!", " ", "　", "<|endoftext|>", "\x1c", "\U0001F600", "\r\n"]
    texts = ["".join(rnd.choices(some, k=rnd.randint(0, 25))) for _ in range(3000)] + [t or "" for t in AWKWARD]
    coder = tr.Encoder(spec)
    assert coder.encode(texts) == [coder.pack(ids) for ids in library(spec, texts)]


def test_the_library_is_asked_for_ids_alone(spec):
    """Not for the places of tokens, which cost more than the ids; parts that it has told are not asked for again."""
    class Fast:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, []

        def encode_batch_fast(self, texts, add_special_tokens):
            self.asked.append(texts)
            return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    coder = tr.Encoder(spec)
    coder.tokenizer = fast = Fast(coder.tokenizer)
    texts = [prose(1, 300), f"{prose(1, 20)} {'long' * 40} \ttab", "", "  two  spaces "]
    for _ in range(2):
        assert coder.encode(texts) == [coder.pack(ids) for ids in library(spec, texts)]
    assert "long" * 40 not in coder.known and sum("ving" in t for asked in fast.asked for t in asked if len(t) > 1000) == 1


def test_named_tokens_are_what_the_library_takes_them_for(spec):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|", "<|endoftext |>", "hello world"]
    coder = tr.Encoder(spec)
    for _ in range(2):
        assert coder.encode(texts) == [coder.pack(ids) for ids in library(spec, texts)]
    assert coder.tokenizer.token_to_id("<|endoftext|>") in library(spec, texts)[0]


def test_long_parts_are_not_remembered(spec):
    texts = ["start " + "日本語" * 3000 + " short " + "x1" * tr.MEMORABLE, "日本語" * 3000 + " short"]
    coder = tr.Encoder(spec)
    for _ in range(2):
        assert coder.encode(texts) == [coder.pack(ids) for ids in library(spec, texts)]
    assert "short" in coder.known and max(map(len, coder.known)) <= tr.MEMORABLE


def test_other_tokenizers_get_whole_texts():
    spec = tokenizer_files.content("word_bpe_49k.json").decode()
    coder = tr.Encoder(spec)
    assert not coder.parted
    texts = ["Two  words", "", prose(1, 30)]
    assert coder.encode(texts) == [coder.pack(ids) for ids in library(spec, texts)]


def test_files_hold_all_documents_in_order(spark, spec, monkeypatch):
    monkeypatch.setattr(tr, "RUN", 3)
    rows = [(i * 7 % 40, prose(i, i * 5)) for i in range(40)] + [(5, "b"), (5, "a"), (5, "a"), (None, "x"), (None, None)] + [
        (100 + i, t) for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = written(spark, docs, spec)
    got = tr.read(manifest, with_ids=True).orderBy("shard", "record").collect()
    ids = [x + [0] for x in library(spec, [t for _, t in rows])]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert sorted(map(str, zip([r["doc_id"] for r in got], [list(r["ids"]) for r in got]))) == sorted(map(str, zip([d for d, _ in rows], ids)))
    start = 0
    for r in got:
        packed = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(packed))
        start += r["n_tokens"]
    plain = {(r["doc_id"], tuple(r["ids"])) for r in got}
    shuffled = [(r["doc_id"], tuple(r["ids"])) for r in tr.read_shuffled(manifest, 1).collect()]
    assert set(shuffled) == plain and len(shuffled) == len(got)
    assert shuffled != [(r["doc_id"], tuple(r["ids"])) for r in tr.read_shuffled(manifest, 2).collect()]


def test_damage_is_noticed():
    record = tr.frame(tr.payload_of(None, 2, b"\x01\x00\x02\x00"))
    assert tr.parse(tr.unframe(record))[0] is None
    for i in range(len(record)):
        broken = record[:i] + bytes([record[i] ^ 1]) + record[i + 1:]
        with pytest.raises(ValueError):
            tr.unframe(broken)


def test_masked_checksum_is_undone():
    crc = ((tr.masked(b"abc") - 0xA282EAD8) & 0xFFFFFFFF)
    assert ((crc << 15 | crc >> 17) & 0xFFFFFFFF) == zlib.crc32(b"abc")


def test_empty_table_and_extra_columns(spark, spec):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").withColumn("shard", F.lit("s"))
    assert tr.read(written(spark, docs, spec)).count() == 1
    empty = written(spark, docs.limit(0), spec)
    assert empty.count() == 0 and tr.read(empty).count() == 0 and tr.read_shuffled(empty, 1).count() == 0
