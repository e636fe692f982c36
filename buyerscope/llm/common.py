"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters; everything else belongs to a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet: the wanted ones, with underscores added where they are taken (in any case of letters)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def worker_cache(family: str, key: str, build: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task: the last one of each family (a new worker builds it anew)."""
    store = sys.__dict__.setdefault("_buyerscope_worker_cache", {})
    if store.get(family, ("",))[0] != key:
        store[family] = (key, build())
    return store[family][1]


def share(spark: SparkSession, family: str, value: object) -> Callable[[], object]:
    """Broadcast an object of bounded size; the result, called in a task, returns it.

    Its class travels with it, and a worker unpacks it once.
    """
    packed, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: worker_cache(family, key, lambda: cloudpickle.loads(packed.value))
