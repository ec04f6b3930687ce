"""Token ids in length-delimited binary records, with an offset index.

A data file is a run of records, each framed as

    length of the payload   8 bytes
    masked checksum of it   4 bytes
    payload
    masked checksum of it   4 bytes

all little-endian.  A checksum is CRC-32, masked by a rotation by 15 bits and an
offset, so that a checksum of bytes that hold checksums stays useful.  The
payload is the document id (a flag byte for null, 8 bytes), the width of an id
(one byte, 2 or 4) and the ids.

An index file has 24 bytes for each record of its data file: the record's
offset, its whole length, and the ids in records before it.  Records can so be
read in any order, and tasks can start anywhere.

Documents are dealt out by ranges of their id, sorted in each, and each task
writes one data file and one index.  Where a document's ids begin in the whole
corpus is the sum over earlier files, a few numbers per file, plus what the
index says.

Encoding: a text is cut in front of single spaces.  The pre-tokeniser of
byte-level files never joins anything across such a cut, so the ids of the parts
are those of the whole.  Parts repeat, and each worker remembers the ids of the
last one or two times ``REMEMBERED`` of them but for those longer than
``MEMORABLE``; all come from the tokenizers
library, many in one call.  Where a cut
could fall inside a run of white space, or where a text names an added token, such
as the end of a text, the library gets the whole text; with a tokenizer of another
kind it always does.  So ids are the library's, also those of named tokens.

Defined results: a null text counts as an empty one and holds the end id alone;
null ids come first; equal ids are ordered by their text; an empty table gives
no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytewake.llm import shared_files
from bytewake.llm.common import steps, texts
from bytewake.staging import Stage

REMEMBERED = 500_000
#: longer parts hardly repeat, and in scripts without spaces a part may be a whole text
MEMORABLE = 64
#: parts that the library encodes in one call
CALL = 2_000
#: parts whose ids are put together at once
GATHER = 1_000_000
#: how byte-level vocabularies write a space
SPACE = "\u0120"
INDEX_ENTRY = "<QQQ"
INDEX_BYTES = struct.calcsize(INDEX_ENTRY)
#: records that one reading task takes at a time, and the most tasks
RUN = 20_000
TASKS = 20_000
#: looks at the spaces, of which there are fewer than characters
INSIDE_SPACE = re.compile(r" (?<=\s )(?=\s|\Z)")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def unframe(record: bytes) -> bytes:
    length, check = struct.unpack_from("<QI", record)
    if masked(record[:8]) != check or len(record) != length + 16:
        raise ValueError("damaged record length")
    payload = record[12:12 + length]
    if masked(payload) != struct.unpack_from("<I", record, 12 + length)[0]:
        raise ValueError("damaged record")
    return payload


def payload_of(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return struct.pack("<?qB", doc_id is None, doc_id or 0, width) + ids


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    missing, doc_id, width = struct.unpack_from("<?qB", payload)
    return None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


class Encoder:
    """A tokenizer of the tokenizers library that remembers the parts it has seen."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        kinds = json.loads(spec)
        self.parted = kinds.get("normalizer") is None and kinds.get("pre_tokenizer") == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        names = [t["content"] for t in kinds.get("added_tokens") or [] if t["content"]]
        self.named = re.compile("|".join(map(re.escape, names)) if names else r"(?!)")
        if any(" " in name for name in names):
            self.parted = False  # parts put next to each other could make up a name
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def library(self, whole: list[str]) -> list[bytes]:
        # without the places of tokens in the text, which nobody asks for
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]

    def spaced(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each behind a space, encoded as one text; every part begins where a token with a space does."""
        encoded, = self.tokenizer.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)
        ids = np.array(encoded.ids, np.int64)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(parts):
            return self.library([" " + p for p in parts])
        packed = ids.astype(f"<u{self.width}").tobytes()
        bounds = [*(starts * self.width).tolist(), len(packed)]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    def look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts; of two generations of remembered ones the older goes once the newer is full."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        packed = list(map(self.known.get, parts))
        missing = [i for i, ids in enumerate(packed) if ids is None]
        named = [parts[i] for i in missing]
        if named:
            older = list(map(self.older.get, named)) if self.older else [None] * len(named)
            fresh = self.fresh([p for p, ids in zip(named, older) if ids is None])
            found = [fresh[p] if ids is None else ids for p, ids in zip(named, older)]
            for i, ids in zip(missing, found):
                packed[i] = ids
            self.known.update(zip(named, found) if len(max(named, key=len)) <= MEMORABLE else
                              ((p, ids) for p, ids in zip(named, found) if len(p) <= MEMORABLE))
        return packed

    def fresh(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts as the library gives them."""
        # white space at an end of a part would meet that of its neighbour
        odd = [p for p in parts if not p or p[0].isspace() or p[-1].isspace()]
        plain = list(set(parts).difference(odd)) if odd else parts
        found: dict[str, bytes] = {}
        for some, encode in ((plain, self.spaced), (odd, lambda parts: self.library([" " + p for p in parts]))):
            for at in range(0, len(some), CALL):
                found.update(zip(some[at:at + CALL], encode(some[at:at + CALL])))
        return found

    def encode(self, whole: list[str]) -> list[bytes]:
        is_cut = [self.parted and not INSIDE_SPACE.search(t) and not self.named.search(t) for t in whole]
        cut = [t for c, t in zip(is_cut, whole) if c]
        parts = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        ends = parts.offsets.to_numpy()[1:]
        first = parts.offsets.to_numpy()[:-1]
        coded = parts.flatten().dictionary_encode()
        distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        packed = self.look_up(distinct)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        ids = np.frombuffer(b"".join(packed), f"<u{self.width}")
        place = np.cumsum(size) - size
        # the first part of a text has no space in front
        bodies = iter([self.gather(code[a + 1:b], ids, place, size) for a, b in zip(first.tolist(), ends.tolist())])
        starts = iter(first.tolist())
        heads = self.library([distinct[code[next(starts)]] if c else t for c, t in zip(is_cut, whole)])
        return [head + next(bodies) if c else head for head, c in zip(heads, is_cut)]

    @staticmethod
    def gather(code: np.ndarray, ids: np.ndarray, place: np.ndarray, size: np.ndarray) -> bytes:
        """Ids of a run of parts, one after another."""
        out = []
        for at in range(0, len(code), GATHER):
            some = code[at:at + GATHER]
            n = size[some]
            out.append(ids[np.repeat(place[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    """One for each worker process and tokenizer."""
    return Encoder(spec)


MANIFEST = "shard long, data string, index string, n_records long, n_ids long"


def write(docs: DataFrame, folder: str, spec: str, stage: Stage, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, write data and index files below ``folder``; returns their manifest, one row per file in order."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, data, index = encoder(spec), None, None
        end = coder.pack([end_id])
        offset = n_ids = n_records = 0
        for batch in batches:
            for part in steps(batch, "text"):
                if data is None:
                    paths = [shared_files.new_file(folder, s) for s in (".records", ".index")]
                    data, index = map(shared_files.create, paths)
                for key, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts(part, "text"))):
                    record = frame(payload_of(key, coder.width, ids + end))
                    data.write(record)
                    index.write(struct.pack(INDEX_ENTRY, offset, len(record), n_ids))
                    offset += len(record)
                    n_ids += len(ids) // coder.width + 1
                    n_records += 1
        if data is not None:
            data.close()
            index.close()
            row = [shared_files.partition(), *paths, n_records, n_ids]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "data", "index", "n_records", "n_ids"])

    ranged = source.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return stage(ranged.mapInArrow(run, MANIFEST), "manifest")


def _runs(manifest: DataFrame) -> DataFrame:
    """Slices of at most RUN records, with the ids in files before theirs, a task for each."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(RUN).cast("long")))
    runs = manifest.withColumn("ids_before", before).select("shard", "data", "index", "ids_before", "n_records", first.alias("first"))
    # few bytes that stand for much work: their number decides, not their size
    n = manifest.agg(F.sum(F.ceil(F.col("n_records") / RUN))).first()[0] or 1
    return runs.repartition(min(int(n), TASKS), "shard", "first")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Records of all files: shard, record, doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    names = ["shard", "record", "doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                with shared_files.open_file(task["index"]) as file:
                    n = min(RUN, task["n_records"] - task["first"])
                    file.seek(task["first"] * INDEX_BYTES)
                    entries = list(struct.iter_unpack(INDEX_ENTRY, file.read(n * INDEX_BYTES)))
                with shared_files.open_file(task["data"]) as file:
                    file.seek(entries[0][0])
                    for at in range(0, n, 1000):
                        yield _batch(task, at, entries[at:at + 1000], file, names, with_ids)

    return _runs(manifest).mapInArrow(
        run, "shard long, record long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _batch(task: dict, at: int, entries: list[tuple], file, names: list[str], with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(len(names) + with_ids)]
    for i, (_, length, ids_before) in enumerate(entries):
        doc_id, ids = parse(unframe(file.read(length)))
        row = [task["shard"], task["first"] + at + i, doc_id, task["ids_before"] + ids_before, len(ids), zlib.crc32(ids.tobytes())]
        for column, value in zip(columns, row + [ids] * with_ids):
            column.append(value)
    arrays = [pa.array(c, pa.int64()) for c in columns[:len(names)]] + [pa.array(c, pa.list_(pa.int64())) for c in columns[len(names):]]
    return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Records in an order that the seed decides; only index entries are shuffled, records are read where they are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                with shared_files.open_file(task["index"]) as file:
                    n = min(RUN, task["n_records"] - task["first"])
                    file.seek(task["first"] * INDEX_BYTES)
                    entries = list(struct.iter_unpack(INDEX_ENTRY, file.read(n * INDEX_BYTES)))
                yield pa.RecordBatch.from_pylist([
                    {"data": task["data"], "record": task["first"] + i, "offset": offset, "length": length}
                    for i, (offset, length, _) in enumerate(entries)
                ], pa.schema([("data", pa.string()), *[(c, pa.int64()) for c in ("record", "offset", "length")]]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for batch in batches:
            rows = []
            for place in batch.to_pylist():
                if place["data"] not in files:
                    if len(files) >= 64:
                        files.clear()
                    files[place["data"]] = shared_files.open_file(place["data"])
                file = files[place["data"]]
                file.seek(place["offset"])
                rows.append(parse(unframe(file.read(place["length"]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "ids"])

    entries = _runs(manifest).mapInArrow(places, "data string, record long, offset long, length long")
    return entries.orderBy(F.xxhash64(F.lit(seed), "data", "record")).mapInArrow(fetch, "doc_id long, ids array<long>")
