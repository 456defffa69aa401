"""Tables that are made of other tables of their level, kept in folders by level, and that grow with their inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .io import load


@dataclass(frozen=True)
class Product:
    """A kind of table under a root, made by ``make`` of the tables of other kinds, or products, of the same level.

    ``levels`` are the columns that name a level, the widest first; ``make``
    gets one table for each input and returns one that has the level columns.
    """

    kind: str
    inputs: tuple[str | Product, ...]
    make: Callable[..., DataFrame]
    levels: tuple[str, ...] = ("session",)


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _kind(given: str | Product) -> str:
    return given.kind if isinstance(given, Product) else given


def _missing(spark: SparkSession, root: str, product: Product, level: dict) -> DataFrame:
    """Levels (their columns) that all inputs have and the product has not, within the given one."""
    found = None
    for given in product.inputs:
        own = load(spark, root, _kind(given), **level).select(*product.levels).distinct()
        found = own if found is None else found.join(own, list(product.levels), "left_semi")
    done = _kept(spark, f"{root}/{product.kind}.done")
    return found if done is None else found.join(done, list(product.levels), "left_anti")


def produce(spark: SparkSession, root: str, product: Product, *, redo: bool = False, **level) -> DataFrame:
    """The product's rows within a level; what is missing is made of its inputs there first.

    Inputs are looked up under the same root, those that are products produced
    in turn. Only levels that are not done are read and made, and only their
    folders are written; they count as done afterwards, so that a run that
    breaks off writes the same folders again. ``redo`` makes all levels anew.
    """
    for given in product.inputs:
        if isinstance(given, Product):
            produce(spark, root, given, redo=redo, **level)
    names = list(product.levels)
    if redo:
        first = _kind(product.inputs[0])
        new = load(spark, root, first, **level).select(*names).distinct()
    else:
        new = _missing(spark, root, product, level)
    new = spark.createDataFrame(new.collect(), new.schema)  # names of levels, fixed before anything is written
    if not new.isEmpty():
        made = product.make(*[load(spark, root, _kind(g), **level).join(new, names, "left_semi") for g in product.inputs])
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(f"{root}/{product.kind}")
        new.write.mode("append").parquet(f"{root}/{product.kind}.done")
    done = _kept(spark, f"{root}/{product.kind}")
    if done is None:
        raise FileNotFoundError(f"{product.kind}: no inputs under {root}")
    for name, value in level.items():
        done = done.where(F.col(name) == value)
    return done


def merged(sums: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Sums kept by level as sums over all of them."""
    return sums.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])
