"""Proof documents: JSON whose sections may carry any attributes and any fields in their rows.

A document is read as a variant, so nothing it says is lost: what is known by name becomes a column, the rest stays
beside it. A JSON null counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_TEXTS = ["label", "entity_id", "id", "flag", "date"]
ROW_NUMBERS = ["count", "value"]


def _text(of: str, path: str) -> Column:
    return F.try_variant_get(of, F.lit(f"$.{path}"), "string")


def _fields(of: str) -> Column:
    """The fields of a JSON object by name; null for anything else."""
    return F.try_variant_get(of, F.lit("$"), "map<string,variant>")


def fields_json(fields: Column) -> Column:
    """A map of variants as one JSON object, its names in order."""
    return F.to_json(F.to_variant_object(fields))


def read_proof(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per section of each proof document, its data rows still nested.

    Columns: run_id, meta (title, source_doc, generated_at), section_no, id, title, type, summary (min, max), data (an
    array of variants) and fields, a map of all attributes but the data. A document is a file, or a line of one.
    A section that is no object has no attributes; data that is no list is none; a file that is no JSON has no sections.
    """
    reader = spark.read.option("multiLine", not one_per_line).option("singleVariantColumn", "doc")
    docs = reader.json(path)
    meta = F.struct(*[_text("doc", f"meta.{c}").alias(c) for c in ("title", "source_doc", "generated_at")])
    listed = F.try_variant_get("doc", F.lit("$.sections"), "array<variant>")
    each = docs.select(_text("doc", "run_id").alias("run_id"), meta.alias("meta"), F.posexplode(listed).alias("section_no", "s"))
    return each.select(
        "run_id",
        "meta",
        "section_no",
        *[_text("s", c).alias(c) for c in ("id", "title", "type")],
        F.struct(*[_text("s", f"summary.{c}").alias(c) for c in ("min", "max")]).alias("summary"),
        F.try_variant_get("s", F.lit("$.data"), "array<variant>").alias("data"),
        F.map_filter(_fields("s"), lambda k, _: k != "data").alias("fields"),
    )


def proof_rows(sections: DataFrame) -> DataFrame:
    """One row per data row of a section, in the order given; one with ``pos`` null for a section without.

    Known fields are columns: texts as they are shown, ``count`` and ``value`` as doubles beside what was written
    (``count_text``, ``value_text``). ``row`` is the whole row as JSON, ``others`` its further fields as JSON.
    Rows that are null are left out.
    """
    keep = [c for c in sections.columns if c not in ("data", "fields")]
    said = F.filter("data", lambda d: ~F.is_variant_null(d))
    places = F.filter(F.transform("data", lambda d, i: F.when(~F.is_variant_null(d), i)), lambda i: i.isNotNull())
    each = sections.select(*keep, F.explode_outer(F.arrays_zip(places.alias("pos"), said.alias("d"))).alias("r"))
    each = each.select(*(F.col(c).alias("section_id" if c == "id" else c) for c in keep), F.col("r.pos").alias("pos"), F.col("r.d").alias("d"))
    known = [*ROW_TEXTS, *ROW_NUMBERS]
    others = F.map_filter(_fields("d"), lambda k, _: ~k.isin(known))
    return each.select(
        *[c for c in each.columns if c != "d"],
        *[_text("d", c).alias(c) for c in ROW_TEXTS],
        *[F.try_variant_get("d", F.lit(f"$.{c}"), "double").alias(c) for c in ROW_NUMBERS],
        *[_text("d", c).alias(f"{c}_text") for c in ROW_NUMBERS],
        F.to_json("d").alias("row"),
        fields_json(others).alias("others"),
    )
