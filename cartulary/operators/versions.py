"""Questions about the version history of places, for all places at once.

A history has ``place_id, version_ts, entry_id`` and any fields. Versions are ordered by
``(version_ts, entry_id)``. Answers are aggregates that combine before the shuffle, or come from one
sorted scan (``sortedscan``) where a version has to know the one before it: no window ever holds a
whole history, so a place with a large share of all versions is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.notes import json_notes
from cartulary.functions.text import fill_blank, header_tokens, title_level2
from cartulary.functions.times import fmt_iso, fmt_mdy
from cartulary.operators.hotkeys import digest
from cartulary.operators.recipes import HOURS_MODE, PRESENCE_MODE
from cartulary.operators.sortedscan import first_in, first_place, in_order, segments, taken

PLACE = "place_id"
ORDER = ("version_ts", "entry_id")


def version_order() -> Column:
    return F.struct(*ORDER)


def _fields(names: Sequence[str]) -> Column:
    return F.struct(*names)


def dated_versions(versions: DataFrame, strict: bool = False) -> DataFrame:
    """Versions of a known place with a usable date. Strict: an undated one fails the job instead."""
    if strict:
        bad = F.concat(F.lit("version without a date: "), F.col("entry_id").cast("string"))
        checked = F.when(F.col("version_ts").isNull(), F.raise_error(bad)).otherwise(
            F.col("version_ts")
        )
        return versions.withColumn("version_ts", checked)
    return versions.filter(F.col("version_ts").isNotNull() & F.col(PLACE).isNotNull())


def ordered_versions(versions: DataFrame) -> DataFrame:
    """Dated versions, oldest first within a place, by one range-partitioned sort.

    A sort by the full key may cut a long history between tasks; a window numbering could not.
    """
    return dated_versions(versions).orderBy(PLACE, *ORDER)


def filter_by_field(
    versions: DataFrame, key: str | Column, changed: str = "changed_fields", keep_unfiltered: bool = True
) -> DataFrame:
    """Versions that touched one field.

    A place none of whose versions did keeps its whole history, or is left out with
    ``keep_unfiltered=False``.
    """
    touched = F.array_contains(F.col(changed), F.lit(key) if isinstance(key, str) else key)
    hits = versions.filter(touched)
    if not keep_unfiltered:
        return hits
    # Only places with a hit, each once; a version without place is of no place with one.
    touching = hits.filter(F.col(PLACE).isNotNull()).select(PLACE).distinct().withColumn("_any", F.lit(True))
    kept = versions.join(touching, PLACE, "left")
    return kept.filter(touched | F.col("_any").isNull()).drop("_any")


def asof_before(
    versions: DataFrame, threshold: Column, fields: Sequence[str] = (), out: str = "v"
) -> DataFrame:
    """Per place the last version strictly before the threshold, else its earliest one.

    ``threshold`` is a literal or a column that is constant within a place.
    """
    names = [*ORDER, *(f for f in fields if f not in ORDER)]
    before = F.when(F.col("version_ts") < threshold, version_order())
    chosen = F.coalesce(
        F.max_by(_fields(names), before), F.min_by(_fields(names), version_order())
    )
    per_place = dated_versions(versions).groupBy(PLACE).agg(chosen.alias(out))
    return per_place.select(PLACE, f"{out}.*")


def first_with(
    versions: DataFrame,
    present: Column,
    at_first: Sequence[str],
    before_first: Sequence[str],
    fallback_to_self: bool = False,
) -> DataFrame:
    """First version for which ``present`` holds, with fields of the version just before it.

    Adds ``found``, the fields at the first such version, and ``prior_*`` fields. A place for
    which it never holds gets nulls and the ``prior_*`` fields of its last version. With
    ``fallback_to_self`` a place that starts out present takes ``prior_*`` from that version.
    """
    dated = dated_versions(versions)
    names = [*ORDER, *(f for f in dict.fromkeys([*at_first, *before_first]) if f not in ORDER)]
    if not before_first:
        firsts = dated.groupBy(PLACE).agg(
            F.min_by(_fields(names), F.when(present, version_order())).alias("_first")
        )
        return firsts.select(
            PLACE,
            F.col("_first").isNotNull().alias("found"),
            *(F.col(f"_first.{c}").alias(c) for c in names),
        )
    rows = dated.select(
        PLACE,
        *ORDER,
        F.coalesce(present, F.lit(False)).alias("_present"),
        version_order().alias("_at"),
        _fields(names).alias("_hit"),
        _fields(before_first).alias("_before"),
    )

    def summary(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        hit = first_in(column["_present"].to_numpy(zero_copy_only=False), starts, ends)
        return {
            "_start": taken(column["_at"], starts),
            "_hit": taken(column["_hit"], hit),
            "_inside": pa.array(hit > starts),  # the version before the hit is in this segment
            "_prior": taken(column["_before"], np.where(hit > starts, hit - 1, -1)),
            "_end": taken(column["_before"], ends - 1),
        }

    kind = {f.name: f.dataType for f in rows.schema.fields}
    parts = [("_start", kind["_at"]), ("_hit", kind["_hit"]), ("_inside", T.BooleanType()), ("_prior", kind["_before"]), ("_end", kind["_before"])]
    found = segments(rows, PLACE, [*ORDER, "_present"], summary, T.StructType([T.StructField(*p) for p in parts]))
    told = F.struct(F.struct("_start", F.col("_hit").isNotNull()).alias("_place"), "_hit", "_inside", "_prior", "_end")
    joined = found.groupBy(PLACE).agg(in_order(told, "_place").alias("_all"))
    at = first_place(F.col("_all"), lambda s: s["_hit"].isNotNull())
    one = F.get("_all", F.col("_n") - 1)
    first = F.when(F.col("_n") > 0, one["_hit"])
    prior = (
        F.when(F.col("_n") == 0, F.element_at("_all", -1)["_end"])
        .when(one["_inside"], one["_prior"])
        .otherwise(F.get("_all", F.col("_n") - 2)["_end"])
    )
    settled = joined.withColumn("_n", at).select(PLACE, first.alias("_first"), prior.alias("_prior"))
    prior = F.col("_prior")
    if fallback_to_self:
        prior = F.coalesce(prior, F.struct(*(F.col(f"_first.{c}") for c in before_first)))
    return settled.withColumn("_prior", prior).select(
        PLACE,
        F.col("_first").isNotNull().alias("found"),
        F.col("_first.version_ts").alias("version_ts"),
        F.col("_first.entry_id").alias("entry_id"),
        *(F.col(f"_first.{c}").alias(c) for c in at_first if c not in ORDER),
        *(F.col(f"_prior.{c}").alias(f"prior_{c}") for c in before_first),
    )


def first_brand(versions: DataFrame, brand: str = "brand", self_prior: bool = False) -> DataFrame:
    """First branded version and the name and link of the version just before it.

    Never branded: brand ``None`` and the name and link seen last. ``self_prior`` is the older
    rule: an empty brand counts as none and a place branded from the start is its own prior.
    """
    present = F.col(brand).isNotNull() & (F.col(brand) != "None")
    if self_prior:
        present = present & (F.col(brand) != "")
    extra = [c for c in ("source", "header", "category", "url") if c in versions.columns]
    before = [c for c in ("name", "url") if c in versions.columns]
    found = first_with(versions, present, [brand, *extra], before, fallback_to_self=self_prior)
    return found.withColumn(brand, F.when(F.col("found"), F.col(brand)).otherwise("None"))


def parent_first(versions: DataFrame, parent: str = "parent") -> DataFrame:
    """First version with a parent, and what applied it."""
    present = F.col(parent).isNotNull() & (F.col(parent) != "None")
    extra = [c for c in ("source",) if c in versions.columns]
    found = first_with(versions, present, [parent, *extra], [])
    return found.withColumn(parent, F.when(F.col("found"), F.col(parent)).otherwise("None"))


NO_CHANGE = "No change was detected"


def first_change(versions: DataFrame, threshold: Column, tracked: Sequence[str]) -> DataFrame:
    """The last version before any tracked field changes, from the threshold on.

    The base is the first version at or after the threshold. All versions up to the first change
    equal the base in the tracked fields, so the change is the first version that differs from
    the one before it; states are compared by a 64-bit hash. Places without a base give no row.
    """
    since = dated_versions(versions).filter(F.col("version_ts") >= threshold)
    rows = since.select(
        PLACE,
        *ORDER,
        digest(since, tracked).alias("_state"),
        version_order().alias("_at"),
        _fields(tracked).alias("_fields"),
    )

    def summary(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        state = column["_state"].to_numpy()
        moved = np.concatenate(([False], state[1:] != state[:-1]))
        moved[starts] = False
        change = first_in(moved, starts, ends)
        return {
            "_start": taken(column["_at"], starts),
            "_state": taken(column["_state"], starts),
            "_base": taken(column["_fields"], starts),
            "_held": taken(column["_at"], np.where(change >= 0, change - 1, -1)),  # the last version before a change inside
            "_end": taken(column["_at"], ends - 1),
        }

    kind = {f.name: f.dataType for f in rows.schema.fields}
    parts = [("_start", kind["_at"]), ("_state", kind["_state"]), ("_base", kind["_fields"]), ("_held", kind["_at"]), ("_end", kind["_at"])]
    found = segments(rows, PLACE, [*ORDER, "_state"], summary, T.StructType([T.StructField(*p) for p in parts]))
    # Where two batches part rows of one time and entry, the one that goes on behind them comes later.
    told = F.struct(F.struct("_start", "_end", "_state").alias("_place"), "_state", "_held", "_end")
    joined = found.groupBy(PLACE).agg(
        in_order(told, "_place").alias("_all"), F.min_by("_base", F.struct("_start", "_end", "_state")).alias("_base")
    )
    base = F.get("_all", F.lit(0))["_state"]
    at = first_place(F.col("_all"), lambda s: (s["_state"] != F.col("_first")) | s["_held"].isNotNull())
    one = F.get("_all", F.col("_n") - 1)
    between = one["_state"] != F.col("_first")  # it begins with the change
    last = (
        F.when(F.col("_n") == 0, F.element_at("_all", -1)["_end"])
        .when(between, F.get("_all", F.col("_n") - 2)["_end"])
        .otherwise(one["_held"])
    )
    settled = joined.withColumn("_first", base).withColumn("_n", at)
    return settled.select(PLACE, "_base", (F.col("_n") > 0).alias("changed"), last.alias("_last")).select(
        PLACE,
        F.col("_last.version_ts").alias("version_ts"),
        F.col("_last.entry_id").alias("entry_id"),
        "changed",
        F.when(F.col("changed"), fmt_iso(F.col("_last.version_ts")))
        .otherwise(NO_CHANGE)
        .alias("changed_at"),
        *(F.col(f"_base.{c}").alias(c) for c in tracked),
    )


def present_vs_edited(
    places: DataFrame, versions: DataFrame, threshold: Column, badge: str, header: str, title: str
) -> DataFrame:
    """One row per asked place: badge now, badge and header at the as-of version, its source.

    ``places`` has ``place_id``, ``present_badge`` and ``title``; blanks where nothing is known.
    """
    at = asof_before(versions, threshold, [badge, header])
    joined = places.join(at, PLACE, "left")
    return joined.select(
        PLACE,
        F.coalesce(fmt_mdy(F.col("version_ts")), F.lit("")).alias("edited_at"),
        F.coalesce(F.array_join(header_tokens(F.col(header)), " | "), F.lit("")).alias(
            "version_header"
        ),
        fill_blank(F.col("present_badge")).alias("present_badge"),
        fill_blank(F.col(badge)).alias("edited_badge"),
        F.coalesce(title_level2(F.col(title)), F.lit("")).alias("source_level_2"),
    )


def header_asof(versions: DataFrame, threshold: Column, header: str = "header") -> DataFrame:
    """Header tokens of the as-of version in one text."""
    at = asof_before(versions, threshold, [header])
    return at.select(
        PLACE,
        F.coalesce(F.array_join(header_tokens(F.col(header)), " | "), F.lit("")).alias(
            "version_header"
        ),
    )


def notes_asof(
    versions: DataFrame, threshold: Column, badge: str = "badge", notes: str = "notes_json"
) -> DataFrame:
    """Note of the as-of version, only when its badge says it was edited."""
    at = asof_before(versions, threshold, [badge, notes])
    edited = F.lower(F.trim(fill_blank(F.col(badge)))).startswith("edit")
    return at.select(
        PLACE, F.when(edited, json_notes(F.col(notes))).otherwise("").alias("rca_note")
    )


def mode_filter_key(field: str) -> str:
    """Filter key of a contested field, for a whole job."""
    return HOURS_MODE[0] if field.strip().lower() == "hours" else PRESENCE_MODE[0]
