"""Answers of a model, from raw text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from batchloom.functions.phone import phone_flag
from batchloom.functions.scalars import strip, truncate_text
from batchloom.schemas import ANALYSIS_FIELDS

# Code fence around an answer, texts read as true, fallback length.
FENCE_OPEN, FENCE_CLOSE = "```json", "```"
TRUE_TEXTS = ["true", "yes", "1"]
FALLBACK_CHARS = 200
EMPTY_ANSWER = "Empty response"
NOT_AN_OBJECT = "Answer is not a JSON object"
CONTACT_NOT_TEXT = "Contact is not a text"

# What is left of these values when they stand for "nothing".
_EMPTY_VALUES = ["0", "0.0", "false", "[]", "{}"]


def unfence(text: Column) -> Column:
    """Cut an opening json fence and a closing fence; a bare opening fence stays."""
    bare = strip(text)
    opened = F.when(bare.startswith(FENCE_OPEN), F.substr(bare, F.lit(len(FENCE_OPEN) + 1))).otherwise(bare)
    return F.when(
        opened.endswith(FENCE_CLOSE), F.substr(opened, F.lit(1), F.length(opened) - len(FENCE_CLOSE))
    ).otherwise(opened)


def parse_whole(text: Column) -> Column:
    """VARIANT of a text that is JSON from end to end, else null.

    The parser stops after the first value; inside brackets it has to read on,
    and a second value would make the inner list longer than one.
    """
    boxed = F.try_parse_json(F.concat(F.lit("[["), text, F.lit("]]")))
    second = F.try_variant_get(boxed, "$[0][1]", "variant")
    return F.when(second.isNull(), F.try_variant_get(boxed, "$[0][0]", "variant"))


def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "string")


def decode_analysis(df: DataFrame, column: str) -> DataFrame:
    """Typed analysis columns from stored JSON text; unreadable rows are dropped."""
    doc = F.col("__doc")
    return (
        df.withColumn("__doc", parse_whole(F.col(column)))
        .filter(doc.isNotNull())
        .withColumns({name: _field(doc, name) for name in ANALYSIS_FIELDS})
        .drop("__doc")
    )


def normalize_response(df: DataFrame, column: str, phone_mode: str = "executed") -> DataFrame:
    """Add success, the five analysis fields, phone_number and error for answer texts.

    An object is taken field by field; text that is not JSON becomes the
    description; an empty answer and JSON of another kind are failures.
    """
    raw, text, doc = F.col(column), F.col("__text"), F.col("__doc")
    kind, contact_kind = F.col("__kind"), F.col("__contact_kind")
    contact = F.col("__contact")
    parsed = (
        df.withColumn("__text", unfence(raw))
        .withColumn("__doc", parse_whole(text))
        .withColumn("__kind", F.substring_index(F.schema_of_variant(doc), "<", 1))
        .withColumn("__contact", _field(doc, "business_contact"))
        .withColumn("__contact_kind", F.schema_of_variant(F.try_variant_get(doc, "$.business_contact", "variant")))
    )
    bad_contact = (
        contact_kind.isNotNull() & ~contact_kind.isin("STRING", "VOID") & ~contact.isin(_EMPTY_VALUES)
    )
    error = (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(EMPTY_ANSWER))
        .when(kind.isNotNull() & (kind != "OBJECT"), F.lit(NOT_AN_OBJECT))
        .when(F.coalesce(bad_contact, F.lit(False)), F.lit(CONTACT_NOT_TEXT))
    )
    marked = parsed.withColumn("error", error)
    ok = F.col("error").isNull()
    is_object, is_text = ok & (kind == "OBJECT"), ok & kind.isNull()
    image = _field(doc, "store_image")
    return marked.withColumns(
        {
            "success": ok,
            "store_image": F.when(is_object, F.lower(image).isin(TRUE_TEXTS)).when(is_text, F.lit(False)),
            "text_content": F.when(is_object, _field(doc, "text_content")).when(is_text, text),
            "store_name": F.when(is_object, _field(doc, "store_name")),
            "business_contact": F.when(is_object, contact),
            "image_description": F.when(is_object, _field(doc, "image_description")).when(
                is_text, truncate_text(text, FALLBACK_CHARS)
            ),
            "phone_number": F.when(is_object, phone_flag(F.when(contact_kind == "STRING", contact), phone_mode)).when(
                is_text, F.lit(False)
            ),
        }
    ).drop("__text", "__doc", "__kind", "__contact", "__contact_kind")
