"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys can be.
HOT_SHARE = 64
SKETCH_ITEMS = 4096


def hot_keys(df: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Hash of each hot key and the number of parts its rows are to be cut into.

    One pass over the key columns: each task keeps a sketch of bounded size and only the
    sketches move. At most ``2 * HOT_SHARE`` pairs reach the driver, whatever the data. They are
    fetched at once, so both sides of a join are sure to be cut the same way. A key the sketch
    overrates is merely cut for nothing.
    """
    share = F.greatest(F.col("n") / HOT_SHARE, F.lit(1.0))
    found = (
        df.select(F.xxhash64(*keys).alias("h"))
        .agg(
            F.expr(f"approx_top_k(h, {2 * HOT_SHARE}, {SKETCH_ITEMS})").alias("top"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(F.explode("top").alias("t"), share.alias("share"))
        .filter(F.col("t.count") > F.col("share"))
        .select("t.item", F.ceil(F.col("t.count") / F.col("share")).cast("int").alias("parts"))
    )
    return {row["item"]: row["parts"] for row in found.collect()}


def _parts(hot: dict[int, int], keys: Sequence[str]) -> Column:
    pairs = [F.lit(x) for item in hot.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.xxhash64(*keys)), F.lit(1))


def _holds(kind: T.DataType, sort: type | tuple[type, ...]) -> bool:
    if isinstance(kind, sort):
        return True
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, sort) for f in kind.fields)
    return isinstance(kind, T.ArrayType) and _holds(kind.elementType, sort)


def digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of some columns of a row, whatever their types; null and missing entries count."""
    parts: list[Column] = []
    for name in columns:
        c = F.col(f"`{name}`")
        told = F.to_json(F.struct(c)) if _holds(df.schema[name].dataType, (T.MapType, T.VariantType)) else c
        parts += [told.isNull(), told]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def one_each(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One of the facts of each key, the same on every run; equal facts are no choice."""
    rest = [c for c in facts.columns if c not in keys]
    picked = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), digest(facts, rest)) if rest else F.first(F.lit(1))
    one = facts.groupBy(*keys).agg(picked.alias("_one"))
    return one.select(*keys, *[F.col("_one").getField(c).alias(c) for c in rest])


def _salted(rows: DataFrame, parts: Column) -> DataFrame:
    """``rows`` with ``_salt`` from 0 to ``parts``, also for rows that are equal.

    A row's salt is its place in its task, whose rows are sorted by a hash first: a task that runs again deals the same
    rows to the same salts.
    """
    hashed = rows.withColumn("_hash", digest(rows, rows.columns)).sortWithinPartitions("_hash")
    return hashed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts.cast("bigint")).cast("int")).drop("_hash")


def lookup(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    weigh: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``facts``, which has one row per key; see ``one_each``.

    Rows of a hot key are spread over several tasks, equal rows too, and the fact of that key is repeated once per
    part: a bounded number of extra rows. Without hot keys it is a plain join. ``weigh`` is a table with the same keys to
    look for hot ones in, for rows that are themselves the outcome of a long plan.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup keeps rows: left or inner only")
    hot = hot_keys(rows if weigh is None else weigh, keys)
    if not hot:
        return rows.join(facts, list(keys), how)
    parts = _parts(hot, keys)
    salted = _salted(rows, parts)
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
