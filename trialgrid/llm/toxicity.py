"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each gets the
probabilities of the categories before it as further inputs. While training,
those are out-of-fold predictions, so that a model learns from probabilities as
good as it will get. The other inputs are words and beginnings of words, chosen
by how unevenly a category's documents have them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt

#: Lengths in bytes of the beginnings of words; whole words come besides.
HEADS = (4, 5, 6, 7, 8)


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, byte by byte."""
    low = bt.LOWER[data]
    after = np.zeros(len(low), bool)
    after[1:] = low[:-1] == 0xC3
    return np.where(after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low).astype(np.uint8)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the document of each."""
    low = _lower(data)
    starts, ends, at = bt.tokens(low, bounds, bt.ALNUM)
    sums, doc = bt.prefix_sums(low), np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    values, docs = [bt.span_hash(sums, starts, ends)], [doc]
    for n in HEADS:
        long = ends - starts > n
        values.append(bt.span_hash(sums, starts[long], starts[long] + n, n))
        docs.append(doc[long])
    return np.concatenate(values), np.concatenate(docs)


class Chain:
    """Logistic models in the order of their categories."""

    def __init__(self, columns: list[np.ndarray], labels: dict[str, np.ndarray], most: int = 400, folds: int = 4, ridge: float = 0.3, weights: np.ndarray | None = None):
        self.categories = list(labels)
        n = len(columns)
        weights = np.ones(n) if weights is None else weights * (n / weights.sum())
        chosen = {c: self._choose(columns, y, most) for c, y in labels.items()}
        self.known = np.unique(np.concatenate(list(chosen.values()) or [np.zeros(0, np.uint64)]))
        x = np.zeros((n, len(self.known)), np.float32)
        for i, values in enumerate(columns):
            x[i, self._find(values)] = 1
        fold = np.arange(n) % folds
        earlier = np.zeros((n, 0))
        self.models: list[tuple[np.ndarray, np.ndarray]] = []
        for c, y in labels.items():
            own = np.searchsorted(self.known, chosen[c])
            inputs = np.concatenate([x[:, own], earlier, np.ones((n, 1))], 1)
            self.models.append((own, self._fit(inputs, y, ridge, weights)))
            unseen = np.zeros(n)
            for f in range(folds):
                test = fold == f
                unseen[test] = self._p(inputs[test], self._fit(inputs[~test], y[~test], ridge, weights[~test]))
            earlier = np.concatenate([earlier, unseen[:, None]], 1)

    @staticmethod
    def _choose(columns: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
        values = np.concatenate(columns or [np.zeros(0, np.uint64)])
        label = np.repeat(y, [len(c) for c in columns])
        distinct, code = np.unique(values, return_inverse=True)
        a, b = (np.bincount(code, label == k, len(distinct)) for k in (1, 0))
        n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
        held = a + b
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (held * (n1 + n0 - held) * n1 * n0)
        chi = np.where((held >= 3) & np.isfinite(chi), chi, 0)
        best = np.lexsort((distinct, -chi))[:most]
        return np.sort(distinct[best[chi[best] > 0]])

    @staticmethod
    def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))

    @classmethod
    def _fit(cls, x: np.ndarray, y: np.ndarray, ridge: float, weights: np.ndarray) -> np.ndarray:
        w = np.zeros(x.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(15):
            p = cls._p(x, w)
            hessian = (x.T * (weights * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
            change = np.linalg.solve(hessian, x.T @ (weights * (p - y)) + penalty * w)
            w -= change
            if np.abs(change).max() < 1e-6:
                break
        return w

    def _find(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, values)
        at = np.minimum(at, len(self.known) - 1)
        return at[self.known[at] == values] if len(self.known) else np.zeros(0, np.int64)

    def predict(self, values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """Probabilities by document and category."""
        x = np.zeros((n, len(self.known)), np.float32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
            hit = self.known[at] == values
            x[docs[hit], at[hit]] = 1
        earlier = np.zeros((n, 0))
        for own, w in self.models:
            inputs = np.concatenate([x[:, own], earlier, np.ones((n, 1))], 1)
            earlier = np.concatenate([earlier, self._p(inputs, w)[:, None]], 1)
        return earlier


def _gathering(batches):
    for batch in batches:
        out = [b""] * batch.num_rows
        for row, data, bounds in bt.slices(batch.column(0)):
            values, docs = features(data, bounds)
            for k in range(len(bounds) - 1):
                out[row + k] = np.unique(values[docs == k]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], names=["features", *batch.schema.names[1:]])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], per_class: int = 1500, target: str = "toxic") -> Chain | None:
    """A chain fitted on at most ``per_class`` labelled documents for each value of ``target``.

    Those are the ones of least hash. Each stands for as many labels of its value
    as there are for one in the sample, so that probabilities are those of all
    labels, whatever their number. Rows with a null label or text are left
    out; of several texts for an id one counts; without both values of the target
    there is no chain.
    """
    told = labels.select(F.col("doc_id").alias("__id"), *[F.col(c).cast("int").alias(f"__{c}") for c in categories]).dropna()
    # of several labels for an id the greatest counts, in the sample as in the shares
    names = [f"__{c}" for c in categories]
    told = told.groupBy("__id").agg(F.max(F.struct(*names)).alias("__s")).select("__id", "__s.*").withColumn("__h", F.xxhash64("__id"))
    total = {r[0]: r[1] for r in told.groupBy(f"__{target}").count().collect()}
    few = [told.where(F.col(f"__{target}") == v).orderBy("__h", "__id").limit(per_class) for v in (0, 1)]
    sample = few[0].unionByName(few[1])
    joined = docs.where("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    # one text for each id, so that what comes to the driver is bounded
    rows = joined.groupBy("__id", "__h", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "__id", "__h", *names)
    shape = "features binary, __id long, __h long, " + ", ".join(f"__{c} int" for c in categories)
    table = rows.mapInArrow(_gathering, shape).toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table["__h"][i].as_py(), table["__id"][i].as_py()))
    table = table.take(pa.array(order, pa.int64()))
    if len(set(table[f"__{target}"].to_pylist())) < 2:
        return None
    columns = [np.frombuffer(x, np.uint64) for x in table["features"].to_pylist()]
    weights = np.array([total[v] / min(total[v], per_class) for v in table[f"__{target}"].to_pylist()])
    return Chain(columns, {c: table[f"__{c}"].to_numpy().astype(np.float64) for c in categories}, weights=weights)


def _predicting(shared, categories: tuple[str, ...], limit: float, target: str):
    def run(batches):
        chain = shared.value
        for batch in batches:
            p = np.zeros((batch.num_rows, len(categories)))
            if chain is not None:
                for row, data, bounds in bt.slices(batch.column(1)):
                    values, docs = features(data, bounds)
                    p[row : row + len(bounds) - 1] = chain.predict(values, docs, len(bounds) - 1)
            flag = p[:, categories.index(target)] >= limit
            columns = [pa.array(p[:, k]) for k in range(len(categories))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(flag)], names=["doc_id", *[f"p_{c}" for c in categories], "toxic"])

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: tuple[str, ...] = ("quality", "toxic"),
    limit: float = 0.3,
    per_class: int = 1500,
    target: str = "toxic",
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Probabilities of every category for every text, and whether it is rejected.

    ``labels`` has doc_id and one 0/1 column for each category, in the order of
    the chain. Returns (doc_id, p_<category> ..., toxic); ``toxic`` holds if the
    probability of ``target`` is ``limit`` or more.

    A null or empty text has no words and is judged by the prior; if there is
    nothing to learn from, all probabilities are 0. Labels without a document,
    and null labels, are left out; of several labels for an id one counts. Rows
    that repeat an id are judged one by one; no rows give no rows; other columns
    play no part.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chain = train(plain, labels, categories, per_class, target)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    shape = ", ".join(["doc_id long", *[f"p_{c} double" for c in categories], "toxic boolean"])
    return plain.mapInArrow(_predicting(shared, categories, limit, target), shape)


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), limit: float = 0.3, per_class: int = 1500) -> DataFrame:
    """Documents that :func:`score_toxicity` does not reject, all columns kept.

    Rows are judged one by one where they lie, whatever their ids; null and empty
    texts are judged by the prior; without labels, or rows, nothing is rejected;
    any names of columns may occur.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    chain = train(plain, labels, categories, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    text_at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            if model is None:
                yield batch
                continue
            keep = np.ones(batch.num_rows, bool)
            for row, data, bounds in bt.slices(batch.column(text_at)):
                values, owner = features(data, bounds)
                p = model.predict(values, owner, len(bounds) - 1)
                keep[row : row + len(bounds) - 1] = p[:, categories.index("toxic")] < limit
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
