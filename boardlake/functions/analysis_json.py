"""Model answers: finding the JSON object, checking it, reading it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boardlake.functions.text import let, strip

# ---- fixed values: required answer fields, in checking order -------------------------
REQUIRED = {
    "keywords": "list", "key_skills": "list", "job_description": "str",
    "key_responsibilities": "list", "match_score": "score", "score_reasoning": "str",
    "skills_we_have": "list", "skills_we_are_missing": "list",
    "cover_letter_talking_points": "list", "red_flags": "list",
    "interview_prep_topics": "list", "application_tips": "str", "company_type": "str",
    "company_size_estimate": "str", "company_highlights": "list", "recommendation": "str",
    "recommendation_notes": "str",
}
RECOMMENDATIONS = ["apply", "maybe", "skip"]
# --------------------------------------------------------------------------------------

OBJECT = "object"


def _object_only(text: Column) -> Column:
    v = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def json_object_text(c: Column) -> Column:
    """Text of the JSON object inside an answer: the whole answer, else a fenced block,
    else the outermost braces; NULL when none of them parses to an object."""
    text = strip(c)
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]+?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(
        *[F.when(_object_only(t).isNotNull(), t) for t in (text, fenced, braces)]
    )


def extract_json(c: Column) -> Column:
    """VARIANT object inside an answer, or NULL."""
    return F.try_parse_json(json_object_text(c))


def params_or_empty(c: Column) -> Column:
    """Stored parameters as VARIANT; unreadable ones become {}."""
    return F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("{}")))


def _field(v: Column, name: str, dtype: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", dtype)


def _type_name(field: Column) -> Column:
    """The name of a JSON type as the error texts say it; NULL for a missing field."""

    def name(s: Column) -> Column:
        starts = lambda p: F.startswith(s, F.lit(p))
        return (
            F.when(starts("STRING"), "str").when(starts("ARRAY"), "list")
            .when(starts("BIGINT"), "int").when(starts("BOOLEAN"), "bool")
            .when(starts("OBJECT"), "dict").when(starts("VOID"), "NoneType")
            .when(starts("DECIMAL(") & F.endswith(s, F.lit(",0)")), "int")
            .when(s.isNotNull(), "float")
        )

    return let(F.schema_of_variant(field), name)


def match_score(v: Column) -> Column:
    """Whole number as int() reads it: 8, 8.7 -> 8, "8" -> 8, true -> 1; "8.5" -> NULL."""

    def read(field: Column) -> Column:
        as_type = lambda dtype: F.try_variant_get(field, "$", dtype)
        from_text = let(strip(as_type("string")), lambda t: F.when(
            t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")))
        return let(_type_name(field), lambda kind: (
            F.when(kind == "str", from_text)
            .when(kind == "bool", as_type("boolean").cast("bigint"))
            .when(kind.isin("int", "float"), as_type("double").try_cast("bigint"))
        ))

    return let(_field(v, "match_score"), read)


def recommendation(v: Column) -> Column:
    return F.lower(strip(_field(v, "recommendation", "string")))


def _shown(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "str", F.concat(F.lit("'"), text, F.lit("'")))
        .when(kind == "NoneType", "None")
        .when(kind == "bool", F.initcap(text))
        .otherwise(text)
    )


def _field_error(v: Column, name: str, want: str, score: Column) -> Column:
    """What is wrong with one field, or NULL."""

    def judge(kind: Column) -> Column:
        text = _field(v, name, "string")
        if want == "list":
            said = F.concat(F.lit(f"'{name}' must be an array (got "), kind, F.lit(")"))
            problem = F.when(kind != "list", said)
        elif want == "str":
            said = F.concat(F.lit(f"'{name}' must be a non-empty string (got "), kind, F.lit(")"))
            problem = F.when(kind != "str", said).when(strip(text) == "", said)
        else:
            problem = F.when(score.isNull(), F.concat(
                F.lit(f"'{name}' must be a number (got "), kind, F.lit(": "), _shown(text, kind),
                F.lit(")"),
            )).when(~score.between(1, 10), F.concat(
                F.lit(f"'{name}' must be 1-10 (got "), text, F.lit(")")))
        return F.when(kind.isNull(), F.lit(f"missing field '{name}'")).otherwise(problem)

    return let(_type_name(_field(v, name)), judge)


def analysis_errors(v: Column, score: Column, advice: Column) -> Column:
    """array<string> of problems, in field order; empty for a valid answer. ``score`` and
    ``advice`` are the match score and recommendation already read from it."""
    checks = [_field_error(v, name, want, score) for name, want in REQUIRED.items()]
    shown = _shown(_field(v, "recommendation", "string"), _type_name(_field(v, "recommendation")))
    unknown = _field(v, "recommendation").isNotNull() & ~F.coalesce(
        advice.isin(RECOMMENDATIONS), F.lit(False))
    checks.append(F.when(unknown, F.concat(
        F.lit("'recommendation' must be one of ['apply', 'maybe', 'skip'] (got "), shown, F.lit(")"))))
    return F.array_compact(F.array(*checks))


def validated(v: Column) -> Column:
    """struct(errors, match_score, recommendation): the last two normalised."""

    def check(x: Column) -> Column:
        read = F.struct(match_score(x).alias("score"), recommendation(x).alias("advice"))
        return let(read, lambda r: F.struct(
            analysis_errors(x, r["score"], r["advice"]).alias("errors"),
            r["score"].alias("match_score"), r["advice"].alias("recommendation"),
        ))

    return let(v, check)
