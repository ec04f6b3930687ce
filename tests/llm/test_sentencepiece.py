import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from bytewake.llm import sentencepiece_fst as fst
from bytewake.llm import tokenizer_files
from tests.llm.helpers import AWKWARD, documents, prose

pytestmark = pytest.mark.skipif(not tokenizer_files.installed(), reason="vocabulary files are absent")


@pytest.fixture(scope="module")
def model():
    return tokenizer_files.content("piece_bpe_32k.model")


def fuzz(seed, n, some):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(some, k=rnd.randint(0, 40))) for _ in range(n)]


SOME = [" ", "  ", "\n", "\t", "the", "tion", "a", "b", "er", "ing", "é", "ß", "日本", "\U0001F600", ".", ",", "12", "0", "▁", "'", "<0x0A>", " "]


def ids_of(machine, text):
    return np.frombuffer(machine.encode(text), "<i4").tolist()


def test_merges_equal_the_library(model):
    machine, library = fst.compiled(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = fuzz(1, 2000, SOME) + [t or "" for t in AWKWARD] + [prose(i, 100) for i in range(20)]
    for text in texts:
        ids = ids_of(machine, text)
        assert ids == library.encode(text)
        assert machine.decode(ids) == library.decode(ids)
        if "▁" not in text:
            assert machine.decode(ids) == text


def test_one_finite_path(model):
    """All sequences of pieces of a short unit: exactly the library's has weight 0."""
    machine = fst.compiled(model)

    def sequences(unit):
        if not unit:
            yield []
        for n in range(1, len(unit) + 1):
            if unit[:n] in machine.score or n == 1:
                for rest in sequences(unit[n:]):
                    yield [unit[:n], *rest]

    for unit in ("▁there", "▁ationer", "▁xqz1", "▁▁▁a", "ééa"):
        finite = [s for s in sequences(unit) if machine.is_start(s[0]) and all(map(machine.follows, s, s[1:]))]
        assert finite == [machine.path(unit)] == [machine.merged(unit)]


def unigram(byte_fallback):
    """A small model with hand-set scores."""
    proto = pb.ModelProto()
    for text, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)] * byte_fallback + [
        ("▁", -2.1, 1), ("a", -3.0, 1), ("b", -3.3, 1), ("ab", -4.7, 1), ("▁a", -3.9, 1), ("▁ab", -6.05, 1), ("ba", -5.2, 1), ("c", -9.0, 1), ("abc", -9.4, 1),
    ]:
        proto.pieces.add(piece=text, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = byte_fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    return proto.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_scores_equal_the_library(byte_fallback):
    data = unigram(byte_fallback)
    machine, library = fst.Transducer(fst.Model.parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in fuzz(2, 1500, ["a", "b", "c", " ", "é", "x", "  ", "\n"]):
        assert ids_of(machine, text) == library.encode(text)


def test_models_that_change_characters_are_refused(model):
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        fst.Model.parse(proto.SerializeToString())


def test_memory_of_units_is_bounded(model, monkeypatch):
    monkeypatch.setattr(fst, "REMEMBERED", 5)
    monkeypatch.setattr(fst, "PAIRS", 5)
    machine, library = fst.Transducer(fst.Model.parse(model)), sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(100):
        text = prose(i, 4)
        assert ids_of(machine, text) == library.encode(text)
        assert len(machine.paths) <= 5 + 4 and len(machine.older) <= 5 + 4 and len(machine.pairs) <= 5


def test_documents(spark, model):
    docs = documents(spark, AWKWARD).withColumn("N_IDS", F.lit("x")).withColumn("ids2", F.lit(1))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = fst.encode(docs, model).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in got] == library.encode([t or "" for t in AWKWARD])
    assert all(r["round_trip"] or "▁" in AWKWARD[r["doc_id"]] for r in got)
    assert [r["n_ids"] for r in got] == [len(r["ids"]) for r in got]
    assert fst.encode(docs.limit(0), model).count() == 0


def test_long_units_are_not_remembered(model):
    machine, library = fst.Transducer(fst.Model.parse(model)), sentencepiece.SentencePieceProcessor(model_proto=model)
    text = "日本語" * 3000 + " short " + "x1" * fst.MEMORABLE + " short"
    assert ids_of(machine, text) == ids_of(machine, text) == library.encode(text)
    assert "short" in machine.paths and max(map(len, [*machine.paths, *machine.older])) <= fst.MEMORABLE
