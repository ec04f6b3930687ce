"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file:

* the normaliser: white space becomes the mark U+2581, one mark goes in front;
* the pieces: an arc from each position of the input over each piece that
  matches there;
* byte fallback: a character in no piece is an arc that writes its UTF-8 bytes.

An arc's weight in the tropical semiring depends on the model.  In a unigram
model it is the negated score of the piece, and the state is the position.  In
a merge model it is 0 if merging the texts of the piece before and of this one
stops at just these two, and infinite if not; the state is position and last
piece.  A sequence of pieces is the result of merging exactly if all
neighbouring ones pass, because no merge crosses a border between them sooner
in a longer text than in the two alone, so of all paths one is finite.  For the
same reason each position has at most one last piece with a finite path to it,
and the composed machine is kept as one state per position.

The machine is composed with each *unit* of a text: no piece has a mark behind
another character, so no arc crosses from a character to a mark, and texts fall
into units there.  Units repeat, and each worker remembers the paths of the last
one or two times ``REMEMBERED`` of them that are at most ``MEMORABLE`` long.  Whole texts are encoded, of any length.

Defined results: a null text counts as an empty one, which has no pieces; equal
texts get equal pieces; an empty table gives an empty one; input columns named
like result columns are replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bytewake.llm.common import add_columns, texts

MARK = "▁"
REMEMBERED = 400_000
#: longer units hardly repeat, and in scripts without spaces a unit may be a whole text
MEMORABLE = 64
PAIRS = 1_000_000
UNIGRAM, MERGES = 1, 2  # model types
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types
#: a unigram model gives an unknown character so much less than its rarest piece
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Model:
    """What the transducer is compiled from."""

    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    dummy_prefix: bool
    byte_fallback: bool
    unknown: int

    @staticmethod
    def parse(data: bytes) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep characters and white space as they are can be compiled")
        if trainer.model_type not in (UNIGRAM, MERGES) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only unigram and merge models with white space in front can be compiled")
        pieces = tuple((p.piece, p.score, p.type) for p in proto.pieces)
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces can't be compiled")
        return Model(trainer.model_type, pieces, norm.add_dummy_prefix, trainer.byte_fallback,
                     next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN))


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.score = {text: score for text, score, kind in model.pieces if kind == NORMAL}
        self.ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        known = "".join(text for text in self.ids if len(text) == 1)
        self.unknown = re.compile(f"([^{re.escape(known)}])") if known else re.compile("(.)", re.DOTALL)
        # all pieces that end at each place of an input, in one walk over it
        self.machine = ahocorasick.Automaton()
        for text in self.ids:
            self.machine.add_word(text, (len(text), text))
        self.machine.make_automaton()
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.lone = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.inner = any(MARK in text.lstrip(MARK) for text in self.ids)
        self.out = [
            b"" if kind == CONTROL else bytes([int(text[3:5], 16)]) if kind == BYTE
            else " ⁇ ".encode() if kind == UNKNOWN else text.replace(MARK, " ").encode()
            for text, _, kind in model.pieces
        ]
        self.starts: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a new line that is in no piece is a border of its own; its unit begins with it and has no mark
        self.breaks_lines = not any("\n" in text for text in self.ids)

    # weights of a merge model

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text after all merges: best score first, the leftmost of equal ones."""
        parts, score = list(text), self.score
        merges = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while merges and (best := max(merges)) > NEVER:
            at = merges.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del merges[at]
            if at < len(merges):
                merges[at] = score.get(parts[at] + parts[at + 1], NEVER)
            if at:
                merges[at - 1] = score.get(parts[at - 1] + parts[at], NEVER)
        return parts

    def is_start(self, piece: str) -> bool:
        known = self.starts.get(piece)
        if known is None:
            known = self.starts[piece] = self.merged(piece) == [piece]
        return known

    def follows(self, before: str, piece: str) -> bool:
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[before, piece] = self.merged(before + piece) == [before, piece]
        return known

    # shortest paths through the machine composed with one unit

    def path(self, unit: str) -> list[str]:
        return self._merge_path(unit) if self.model.kind == MERGES else self._unigram_path(unit)

    def _merge_path(self, unit: str) -> list[str]:
        runs = self.unknown.split(unit)
        if len(runs) > 1:  # a character in no piece stands alone, and nothing reaches across it
            return [p for i, run in enumerate(runs) if run for p in ([run] if i % 2 else self._merge_path(run))]
        last = [""] * (len(unit) + 1)  # the piece that ends at each place
        pairs = self.pairs
        for end, (size, piece) in self.machine.iter(unit):
            end += 1
            if last[end]:
                continue
            if size == end:
                finite = self.is_start(piece)
            else:
                before = last[end - size]
                if not before:
                    continue
                finite = pairs.get((before, piece))
                if finite is None:
                    finite = self.follows(before, piece)
            if finite:
                last[end] = piece
        out, end = [], len(unit)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _unigram_path(self, unit: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), -1)] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - self.longest), end):
                score = self.score.get(unit[start:end])
                if score is None:
                    if end - start > 1:
                        continue
                    score = self.lone
                if (weight := best[start][0] - score) < best[end][0]:
                    best[end] = weight, start
        out, end = [], len(unit)
        while end:
            out.append(unit[best[end][1]:end])
            end = best[end][1]
        return out[::-1]

    def written(self, pieces: list[str]) -> list[int]:
        """Output labels of a path."""
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.model.byte_fallback:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)
        return out

    # whole texts

    def _of(self, key: str) -> bytes:
        unit = key if key[0] == "\n" else MARK + key
        found = self.older.get(key)
        if found is None:
            ids = self.written(self.path(unit))
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(key) <= MEMORABLE:
            self.paths[key] = found
        return found

    def forget(self) -> None:
        """Between texts: of two generations of remembered units the older goes once the newer is full."""
        if len(self.paths) >= REMEMBERED:
            self.older = dict(self.paths)
            self.paths.clear()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        self.forget()
        if self.breaks_lines and self.model.dummy_prefix and self.model.byte_fallback and not self.inner and MARK not in text:
            keys = text.replace("\n", " \n").split(" ")
            if "" not in keys:
                paths, compose = self.paths, self._of
                return b"".join([paths.get(k) or compose(k) for k in keys])
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        units = [marked] if self.inner or not self.model.byte_fallback else UNITS.findall(marked)
        return np.array(self.written([p for unit in units for p in self.path(unit)]), "<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(data: bytes) -> Transducer:
    """One machine for each model and Python worker, with what it remembers."""
    return Transducer(Model.parse(data))


FIELDS = [
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()),
]


def encode(docs: DataFrame, model: bytes, text: str = "text", prefix: str = "") -> DataFrame:
    """Documents with their ids, and whether decoding these gives the text back."""

    def make():
        machine = compiled(model)

        def columns(part: pa.RecordBatch) -> list[pa.Array]:
            whole = texts(part, text)
            found = [machine.encode(t) for t in whole]
            sizes = np.array([len(f) // 4 for f in found], np.int64)
            flat = np.frombuffer(b"".join(found), "<i4")
            ends = np.cumsum(sizes)
            same = [machine.decode(flat[e - n:e].tolist()) == t for e, n, t in zip(ends, sizes, whole)]
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            return [
                pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(sizes),
                pa.array([zlib.crc32(f) for f in found], pa.int64()), pa.array(same, pa.bool_()),
            ]

        return columns

    return add_columns(docs, text, [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], make)
