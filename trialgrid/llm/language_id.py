"""Language identification with string kernels.

Two texts are as alike as the character n-grams of several lengths that are
present in both, over the geometric mean of how many each has. A few training
texts are landmarks; kernel values to them, whitened, are a text's features
(Nystroem), on which ridge regressions learn one language against the rest.
Texts are scored a batch at a time by matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt

GRAMS = (1, 2, 3)
DIMENSIONS = 1 << 14
_LETTER_TABLE: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters, one flag for each."""
    global _LETTER_TABLE
    if _LETTER_TABLE is None:
        _LETTER_TABLE = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER_TABLE


def presence(text: str | None, out: np.ndarray) -> bool:
    """Mark the hashed n-grams of a lower-cased text; what is no letter counts as one blank. False without letters."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return False
    code = np.where(letter, code, 32)
    stay = letter | np.concatenate([[True], letter[:-1]])
    code = np.concatenate([[32], code[stay], [32]]).astype(np.uint64)
    value = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            break
        value = value[: len(code) - n + 1] * np.uint64(0x2545F4914F6CDD1D) + code[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            out[(bt.mix(value) & np.uint64(DIMENSIONS - 1)).astype(np.int64)] = 1
    return True


class KernelClassifier:
    """One-versus-rest kernel ridge regression on Nystroem features of presence kernels."""

    def __init__(self, x: np.ndarray, labels: list[str], landmarks: int = 64, ridge: float = 1e-3):
        self.languages = sorted(set(labels))
        where = {lang: [i for i, l in enumerate(labels) if l == lang] for lang in self.languages}
        # landmarks in turn from each language
        turns = sorted((k, lang, i) for lang, rows in where.items() for k, i in enumerate(rows))
        chosen = [i for _, _, i in turns[: max(landmarks, len(self.languages))]]
        marks = x[chosen].astype(np.float32)
        self.marks = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T)
        inner = self.marks.T @ self.marks
        value, vector = np.linalg.eigh(inner.astype(np.float64))
        kept = value > 1e-6 * value.max()
        self.white = (vector[:, kept] / np.sqrt(value[kept])).astype(np.float32)
        features = self._features(x)
        target = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        gram = features.T @ features + ridge * len(features) * np.eye(features.shape[1])
        self.weights = self.white @ np.linalg.solve(gram, features.T @ target).astype(np.float32)

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1, dtype=np.float32, keepdims=True), 1))
        return (x.astype(np.float32) @ self.marks) / size

    def _features(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x).astype(np.float64) @ self.white

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its share of the scores, by softmax."""
        margin = self._kernel(x) @ self.weights * 4
        share = np.exp(margin - margin.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        return share.argmax(1), share.max(1).astype(np.float64)


def _marking(batches):
    for batch in batches:
        out = []
        row = np.zeros(DIMENSIONS, np.uint8)
        for text in batch.column(1).to_pylist():
            row[:] = 0
            presence(text, row)
            out.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "marks"])


def _predicting(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts, held = batch.column(1), batch.column(2)
            langs, scores = [], []
            block = np.zeros((128, DIMENSIONS), np.uint8)
            for at in range(0, len(texts), len(block)):
                part = texts[at : at + len(block)].to_pylist()
                block[:] = 0
                some = np.array([presence(t, block[k]) for k, t in enumerate(part)], bool)
                if model is None:
                    best, score = np.zeros(len(part), int), np.zeros(len(part))
                else:
                    best, score = model.predict(block[: len(part)])
                some &= model is not None
                langs += [model.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.where(some, score, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), held, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def train(docs: DataFrame, per_language: int = 150, landmarks: int = 64) -> KernelClassifier | None:
    """A classifier of at most ``per_language`` texts for each language, those of least hash."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id"))
    sample = docs.select("doc_id", "lang", "text").withColumn("rank", rank).where(F.col("rank") <= per_language)
    table = sample.orderBy("lang", "rank").select("lang", "text").mapInArrow(_marking, "lang string, marks binary").toArrow()
    if not table.num_rows:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1)
    some = x.any(1)
    labels = [lang for lang, s in zip(table["lang"].to_pylist(), some.tolist(), strict=True) if s]
    return KernelClassifier(x[some], labels, landmarks) if labels else None


def identify_languages(
    docs: DataFrame, folds: int = 5, per_language: int = 150, landmarks: int = 64, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The language of every text.

    Learns from rows with text and language whose crc32(id as text) mod ``folds``
    is not 0, at most ``per_language`` of each. Returns (doc_id, held_out,
    lang_pred, score); score is the winner's share, 0 to 1.

    Null texts and texts without letters are ``und`` with score 0, as is every
    text if there is nothing to learn from. With one language all texts get it.
    A null id counts as the empty text for the fold. Rows that repeat an id are
    texts of their own; no rows give no rows; other columns play no part.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (fold == 0).alias("held_out"), F.col(lang).cast("string").alias("lang"))
    model = train(plain.where("not held_out and text is not null and lang is not null"), per_language, landmarks)
    shared = spark.sparkContext.broadcast(model)
    return plain.select("doc_id", "text", "held_out").mapInArrow(_predicting(shared), "doc_id long, held_out boolean, lang_pred string, score double")
