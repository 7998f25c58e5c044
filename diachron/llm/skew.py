"""Joins whose keys may be hot, without a hot task (DataFrame functions only)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the heaviest keys that are broadcast: a fixed number, whatever the input.
HEAVIEST = 1000


def join_one(many: DataFrame, one: DataFrame, key: str, weight: str, spread: Column, most: int = HEAVIEST, hint: str | None = None) -> DataFrame:
    """``many`` with the columns of ``one``, whose ``key`` (string or binary) is unique, or nulls.

    The ``most`` keys of the largest ``weight`` are matched by a broadcast of their rows. What they
    match, and rows without a key, go through the shuffle under keys of their own (``spread``), which
    nothing matches, so no task gets more than a thousandth of the weight for one key. ``hint`` names
    the join of the others, for a ``one`` that is much smaller than ``many``.
    """
    values = [c for c in one.columns if c != key]
    one = one.where(F.col(key).isNotNull())  # what the join would ask of one side only; alike, both read one shuffle
    heavy = one.orderBy(F.desc(weight), key).limit(most).select(F.col(key).alias("__heavy"), *[F.col(c).alias(f"__h_{c}") for c in values])
    light = one.select(F.col(key).alias("__light"), *[F.col(c).alias(f"__l_{c}") for c in values])
    kind = many.schema[key].dataType.simpleString()
    apart = F.concat(F.lit("apart, under a key of its own: "), F.coalesce(spread.cast("string"), F.lit(""))).cast(kind)
    first = many.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    first = first.withColumn("__key", F.when(F.col("__heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(apart))
    both = first.join(light.hint(hint) if hint else light, F.col("__key") == F.col("__light"), "left")
    return both.select(*many.columns, *[F.when(F.col("__heavy").isNull(), F.col(f"__l_{c}")).otherwise(F.col(f"__h_{c}")).alias(c) for c in values])


def one_row_each(docs: DataFrame, stay: DataFrame, keys: list[Column], every: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are a row of ``stay``, one for each key; all of them where ``every`` holds.

    Of rows with one key the least by the other columns stays. Nulls are equal. The window works on
    the join's partitioning, so the rows are dealt once; a key is met by its own repeats only.
    """
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    names = [f"{prefix}k{i}" for i in range(len(keys))]
    plain = lambda k: F.coalesce(k.cast("string"), F.lit(""))
    rows = docs.select("*", *[plain(k).alias(n) for n, k in zip(names, keys, strict=True)], F.coalesce(every, F.lit(False)).alias(f"{prefix}every"))
    wanted = stay.toDF(*[f"{prefix}w{i}" for i in range(len(keys))])
    wanted = wanted.select(*[plain(F.col(c)).alias(c) for c in wanted.columns])
    met = rows.join(wanted, [F.col(n) == F.col(w) for n, w in zip(names, wanted.columns, strict=True)], "left_semi")
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    nth = F.row_number().over(W.partitionBy(*names).orderBy(*order))
    return met.withColumn(f"{prefix}nth", nth).where((F.col(f"{prefix}nth") == 1) | F.col(f"{prefix}every")).select(*[F.col(f"`{c}`") for c in docs.columns])
