"""Verdict expressions: normalising, parsing, scoring and reconciling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulelens.functions.text import literal_map, strip

# Fixed values.
VERDICTS = ("pass", "fail", "partial")
SEVERITY = {"pass": 0, "partial": 1, "fail": 2}
PARSE_ERROR = "Error parsing LLM response: "
EVALUATION_ERROR = "Error evaluating with LLM"
ERROR_TITLES = {
    "LLM_UNAVAILABLE": "Servicio de IA no disponible",
    "EMBEDDING_UNAVAILABLE": "Servicio de búsqueda no disponible",
    "UNEXPECTED_ERROR": "Error inesperado",
}
DEFAULT_ERROR_TITLE = "Error en la evaluación"


def normalise(verdict: Column) -> Column:
    low = F.lower(verdict)
    return F.when(low.isin(*VERDICTS), low).otherwise("fail")


def strip_fences(raw: Column) -> Column:
    text = strip(raw)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def parse_response(raw: Column) -> Column:
    """Raw evaluator text to ``struct(verdict, explanation, suggestions, error_code)``.

    Text that is no JSON gives fail with the first 500 characters; JSON that is no object, or whose
    verdict is no string, gives fail with an evaluation error.
    """
    doc = F.try_parse_json(strip_fences(raw))
    is_object = F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))
    verdict = F.try_variant_get(doc, "$.verdict", "variant")
    kind = F.schema_of_variant(verdict)
    usable = is_object & (verdict.isNull() | (kind == "STRING"))
    suggestions = F.coalesce(
        F.try_variant_get(doc, "$.suggestions", "array<string>"), F.array().cast("array<string>")
    )
    none = F.array().cast("array<string>")
    parsed = F.struct(
        normalise(F.coalesce(F.try_variant_get(doc, "$.verdict", "string"), F.lit("fail"))).alias("verdict"),
        F.coalesce(F.try_variant_get(doc, "$.explanation", "string"), F.lit("")).alias("explanation"),
        suggestions.alias("suggestions"),
        F.lit(None).cast("string").alias("error_code"),
    )
    broken = F.struct(
        F.lit("fail").alias("verdict"),
        F.concat(F.lit(PARSE_ERROR), F.left(raw, F.lit(500))).alias("explanation"),
        none.alias("suggestions"),
        F.lit("PARSE_ERROR").alias("error_code"),
    )
    wrong = F.struct(
        F.lit("fail").alias("verdict"),
        F.lit(EVALUATION_ERROR).alias("explanation"),
        none.alias("suggestions"),
        F.lit("EVALUATION_ERROR").alias("error_code"),
    )
    return F.when(doc.isNull(), broken).when(~F.coalesce(usable, F.lit(False)), wrong).otherwise(parsed)


def parse_error(raw: Column) -> Column:
    """Task error text to ``struct(code, message, technical, title)``; null when there is none."""
    doc = F.try_parse_json(raw)
    code = F.try_variant_get(doc, "$.code", "string")
    message = F.try_variant_get(doc, "$.message", "string")
    titles = F.coalesce(F.element_at(literal_map(ERROR_TITLES), code), F.lit(DEFAULT_ERROR_TITLE))
    coded = F.struct(
        code.alias("code"),
        message.alias("message"),
        F.try_variant_get(doc, "$.technical", "string").alias("technical"),
        titles.alias("title"),
    )
    nothing = F.lit(None).cast("string")
    plain = F.struct(
        nothing.alias("code"),
        raw.alias("message"),
        nothing.alias("technical"),
        F.lit(DEFAULT_ERROR_TITLE).alias("title"),
    )
    has_code = (F.coalesce(code, F.lit("")) != "") & (F.coalesce(message, F.lit("")) != "")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).when(has_code, coded).otherwise(plain)


def points(verdict: Column) -> Column:
    return F.when(verdict == "pass", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)


def severity(verdict: Column) -> Column:
    """pass < partial < fail < anything unknown."""
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(F.element_at(ranks, verdict), F.lit(len(SEVERITY)))


def more_severe(primary: Column, secondary: Column) -> Column:
    """The conservative choice; a tie keeps the primary."""
    return F.when(severity(secondary) > severity(primary), secondary).otherwise(primary)


def percent(score: Column) -> Column:
    """Whole percent, truncated, as reports print it (plain double arithmetic)."""
    return F.floor(score * 100).cast("bigint")
