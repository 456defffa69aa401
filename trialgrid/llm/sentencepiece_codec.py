"""Encoding and decoding with a sentencepiece model by tables of distinct chunks.

A chunk is a run of white space markers with the characters up to the next run.
Where no piece holds a marker after another character, no piece crosses from one
chunk into the next, so a chunk's pieces do not depend on what stands beside it:
each distinct one is segmented once, and a text's ids are those of its chunks by
position. The table lives in the task: joined over the whole corpus, every word
of every text would be shuffled, several times the input.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_BORDER = re.compile(f"[^ {MARK}](?=[ {MARK}])")
#: Characters of a text that are cut into chunks at a time.
BLOCK = 1 << 20
#: Distinct chunks that a task's table holds before it starts anew.
TABLE = 1 << 18
#: Bytes of a model file that is sent to the tasks, at most.
MODEL_BYTES = 64 << 20


@lru_cache(maxsize=2)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separable(model: bytes) -> bool:
    """Whether the model's pieces never cross a white space marker, so that chunks can be segmented one by one.

    It must leave the text as it is but for the markers, of which it puts one in
    front, and have no pieces of the user's own, which are cut out first.
    """
    from sentencepiece import sentencepiece_model_pb2

    read = sentencepiece_model_pb2.ModelProto.FromString(model)
    rules, kinds = read.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    whole = all(MARK not in p.piece.lstrip(MARK) and p.type not in (kinds.USER_DEFINED, kinds.UNUSED) for p in read.pieces)
    whole = whole and any(p.piece == MARK for p in read.pieces)
    greedy = read.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
    return bool(plain and whole and greedy and not read.trainer_spec.treat_whitespace_as_suffix)


def _blocks(text: str, size: int) -> Iterator[str]:
    """The text in blocks that begin where a run of markers does."""
    start = 0
    while len(text) - start > size:
        border = _BORDER.search(text, start + size)
        if border is None:
            break
        yield text[start : border.end()]
        start = border.end()
    yield text[start:]


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class ChunkTable:
    """Ids of distinct chunks as 4-byte numbers, segmented by the library when first seen."""

    def __init__(self, processor, most: int = TABLE):
        self.processor, self.most = processor, most
        self._begin()

    def _begin(self) -> None:
        # a marker alone is the piece itself; the library gives nothing for an empty string
        self.ids = {m: _packed([self.processor.piece_to_id(MARK)]) for m in (" ", MARK)}

    def encode(self, texts: Sequence[str], block: int = BLOCK) -> list[bytes]:
        """Ids of whole texts, without end ids; the library is called once for a ``block`` of characters, about."""
        found: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for k, text in enumerate(texts):
            for part in _blocks(" " + text, block) if text else ():
                held.append((k, _CHUNK.findall(part)))
                size += len(part)
                if size >= block:
                    self._look_up(held, found)
                    held, size = [], 0
        self._look_up(held, found)
        return [b"".join(parts) for parts in found]

    def _look_up(self, held: list[tuple[int, list[str]]], found: list[list[bytes]]) -> None:
        new = set().union(*[chunks for _, chunks in held]).difference(self.ids)
        if len(self.ids) + len(new) > self.most:
            self._begin()
            new = set().union(*[chunks for _, chunks in held]).difference(self.ids)
        if new:  # the library puts a marker in front, which stands for the chunk's first
            self.ids.update(zip(new, map(_packed, self.processor.encode([c[1:] for c in new], num_threads=1)), strict=True))
        for k, chunks in held:
            found[k].append(b"".join(map(self.ids.__getitem__, chunks)))


def _encoding(model, chunked: bool, column: int, name: str, most: int = 1 << 20):
    """Adds the arrays of ids, of about ``most`` characters of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model.value)
        end = _packed([processor.eos_id()])
        encode = ChunkTable(processor).encode if chunked else lambda texts: [_packed(processor.encode(t)) for t in texts]
        for batch in batches:
            start, held, size = 0, [], 0
            for k in range(batch.num_rows):
                held.append(batch.column(column)[k].as_py() or "")
                size += len(held[-1])
                if size >= most or k == batch.num_rows - 1:
                    each = [ids + end for ids in encode(held)]
                    ends = np.cumsum([0, *map(len, each)]) // len(end)
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(each), np.int32)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(ids)) for c in batch.columns), ids], names=[*batch.schema.names, name])
                    start, held, size = k + 1, [], 0

    return run


def _decoding(model, column: int, name: str, most: int = 1 << 22):
    """Adds the decoded texts; about ``most`` characters of them go out at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model.value)
        for batch in batches:
            start, held, size = 0, [], 0
            for k in range(batch.num_rows):
                ids = batch.column(column)[k].values
                held.append(processor.decode(ids.to_numpy().tolist()) if ids is not None and len(ids) else "")
                size += len(held[-1])
                if size >= most or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(held)) for c in batch.columns), pa.array(held, pa.string())], names=[*batch.schema.names, name])
                    start, held, size = k + 1, [], 0

    return run


def read_model(path: str) -> bytes:
    """The bytes of a model file, which is no larger than ``MODEL_BYTES``."""
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError("the model file is too large to be sent to tasks")
    return model


def _wider(df: DataFrame, name: str, kind: DataType) -> StructType:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode_texts(df: DataFrame, model: bytes, *, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with an array of ids, the whole text's and the end id, as the library encodes it without sampling.

    A null or empty text has the end id alone; a text of any length is cut into
    chunks block by block. Repeated rows, other columns and an empty table stay
    as they are. A model whose pieces may cross markers encodes texts whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    run = _encoding(shared, separable(model), df.columns.index(text), name)
    return df.mapInArrow(run, _wider(df, name, ArrayType(IntegerType())))


def decode_ids(df: DataFrame, model: bytes, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text that the library decodes from an array of ids; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(_decoding(shared, df.columns.index(ids), name), _wider(df, name, StringType()))


def encode_documents(docs: DataFrame, model: bytes, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), one row per input row: every text encoded, and its ids decoded again."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return decode_ids(encode_texts(plain, model).drop("text"), model)
