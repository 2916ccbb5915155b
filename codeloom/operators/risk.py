"""Scoring, gating, review texts and verdicts.

The model calls themselves are a batch job elsewhere; its answers are a table
``responses(fn_id, stage, response_text)`` with one row per function and stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.folds import bind
from .rules import fallback_field

RISK, VERDICT = "risk", "verdict"

# --- review texts ------------------------------------------------------------

_ANSWER_FORM = (
    "Answer with one JSON object holding vulnerable (true or false), confidence (0 to 1), "
    "vulnerability_type (one of the list), severity (" + ", ".join(dims.SEVERITIES) + "), "
    "explanation, code_snippet and remediation."
)
_FOCUS = {
    "c": "Look at copies without bounds, formats taken from input, lifetime of allocations, "
    "size arithmetic, commands, paths, keys and parsing of network data.",
    "javascript": "Look at data reaching the page or an evaluator, merged prototypes, commands, "
    "queries built from text, paths, outgoing requests, tokens and weak randomness.",
    "python": "Look at evaluated text, queries built from text, shells, loaded objects, paths, "
    "outgoing requests, templates, missing checks and weak hashes.",
}


def _or_none(items: Column, limit: int) -> Column:
    return F.coalesce(
        F.nullif(F.array_join(F.slice(items, 1, limit), ", "), F.lit("")), F.lit("None")
    )


def risk_prompt(name: Column, code: Column, imports: Column, deps: Column) -> Column:
    """Text asking for one number; three imports and five dependencies are shown."""
    return F.concat(
        F.lit("Rate the security risk of this function with one number from 0.0 to 1.0.\n\n"),
        F.lit("Function:\n```\n"), code, F.lit("\n```\nName: "), name,
        F.lit("\nImports: "), _or_none(imports, 3), F.lit("\nDeps: "), _or_none(deps, 5),
    )


def review_prompt(
    lang: Column, name: Column, line: Column, code: Column, imports: Column, deps: Column
) -> Column:
    """Text asking for a verdict, by language; unknown languages read as C."""

    def template(key: str) -> Column:
        types = ", ".join(dims.VULN_TYPES[key])
        return F.concat(
            F.lit(f"Review this {key} function for security flaws. {_ANSWER_FORM}\n"),
            F.lit(f"Types: {types}.\n{_FOCUS[key]}\n\nFunction: "), name,
            F.lit("\nLine: "), line.cast("string"),
            F.lit("\nImports: "), _or_none(imports, 5),
            F.lit("\nDependencies: "), _or_none(deps, 10),
            F.lit(f"\n\n```{key}\n"), code, F.lit("\n```"),
        )

    return (
        F.when(lang == "python", template("python"))
        .when(lang == "javascript", template("javascript"))
        .otherwise(template("c"))
    )


def scoring_code(code: Column) -> Column:
    """Only so much of a preprocessed function is shown for scoring."""
    return F.substring(code, 1, dims.CODE_LIMIT_FOR_SCORING)


# --- answers -------------------------------------------------------------------


def with_answers(functions: DataFrame, answers: DataFrame) -> DataFrame:
    """Left join by ``fn_id``, with both sides sorted where they lie.

    Every function can have an answer, so the answers grow with the functions.  The optimizer's estimate does not
    see the rows that an explosion adds; left to it, the answers can be broadcast, that is gathered in the driver.
    """
    return functions.join(answers.hint("merge"), "fn_id", "left")


def attach_responses(functions: DataFrame, responses: DataFrame, stage: str) -> DataFrame:
    """Left join of one stage's answers as ``<stage>_text``.

    Both sides are hashed by ``fn_id``: a second stage joined on the result
    reuses that partitioning, so only answers are shuffled again.  ``fn_id`` is
    unique on the function side, so no key is hot.
    """
    answers = responses.where(F.col("stage") == stage).select(
        "fn_id", F.col("response_text").alias(f"{stage}_text")
    )
    return with_answers(functions, answers)


def parse_risk(text: Column) -> Column:
    """First number of the answer, else by word, else the default."""
    number = F.regexp_extract(text, dims.RISK_NUMBER, 0)
    lowered = F.lower(text)
    score = F.when(number != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number.try_cast("double"))))
    for words, value in dims.RISK_WORDS:
        score = score.when(lowered.rlike(dims.any_of(words)), value)
    return score.otherwise(dims.DEFAULT_RISK)


def risk_score(text: Column) -> Column:
    """Score of an answer; a missing one scores the default."""
    return F.when(text.isNull(), dims.DEFAULT_RISK).otherwise(parse_risk(text))


def risk_tier(score: Column, inclusive: bool = True) -> Column:
    """``analyse``, ``medium`` (skipped) or ``low`` (skipped)."""
    enough = score >= dims.ANALYSE_AT if inclusive else score > dims.ANALYSE_AT
    return (
        F.when(enough, "analyse").when(score > dims.MEDIUM_ABOVE, "medium").otherwise("low")
    )


def json_body(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without both in order."""
    start = F.instr(text, "{")
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    cut = F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(cut)


def _truth(value: Column) -> Column:
    """Truth of a JSON value in text form; "false", "0" and blanks are false."""
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("false", "0", "0.0", "", "[]", "{}")


VERDICT_FIELDS = [
    "vulnerable", "confidence", "vulnerability_type", "severity", "explanation", "code_snippet",
    "remediation",
]


def parse_verdicts(answers: DataFrame, text: str = "verdict_text") -> DataFrame:
    """Adds ``accepted`` and the verdict fields of a JSON answer.

    ``vulnerable``, ``confidence`` and ``explanation`` must be present and the
    confidence must be a number, else the answer is not accepted.  The text is
    parsed once, into texts by key that every field reads: asked for one by one, each
    field of a variant would build its cast anew.
    """
    body, blank = json_body(F.col(text)), F.lit("")

    def verdict(fields: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_element_at(fields, F.lit(name))

        def has(name: str) -> Column:
            return F.map_contains_key(fields, F.lit(name))

        confidence = field("confidence").try_cast("double")
        # An answer that repeats a key has no fields, but names them.
        named = fields.isNull() & F.array_contains(F.json_object_keys(body), "severity")
        return F.struct(
            F.coalesce(
                has("vulnerable") & has("confidence") & has("explanation")
                & confidence.isNotNull(),
                F.lit(False),
            ).alias("accepted"),
            _truth(field("vulnerable")).alias("vulnerable"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
            field("vulnerability_type").alias("vulnerability_type"),
            F.when(has("severity"), field("severity")).when(named, None).otherwise("medium").alias("severity"),
            F.coalesce(field("explanation"), blank).alias("explanation"),
            F.substring(F.coalesce(field("code_snippet"), blank), 1, dims.SNIPPET_LIMIT).alias("code_snippet"),
            F.coalesce(field("remediation"), blank).alias("remediation"),
        )

    found = F.try_variant_get(F.try_parse_json(body), "$", "map<string,string>")
    # Exploded, so that a condition on the fields has no text parsed a second time.
    read = answers.select("*", F.explode(F.array(bind(found, verdict))).alias("_verdict"))
    return read.select(*answers.columns, "_verdict.*")


def fallback_verdicts(functions: DataFrame) -> DataFrame:
    """Verdict fields by fallback rules alone."""
    fields = {
        f: F.col("fallback.snippet") if f == "code_snippet" else fallback_field(F.col("fallback.no"), f)
        for f in VERDICT_FIELDS
    }
    return functions.withColumns(fields).drop("fallback")


def risk_answers(responses: DataFrame) -> DataFrame:
    """``fn_id, answered_score``: read before the join, so a number is shuffled, not a text."""
    return responses.where(F.col("stage") == RISK).select(
        "fn_id", risk_score(F.col("response_text")).alias("answered_score")
    )


def settle_verdicts(functions: DataFrame, responses: DataFrame) -> DataFrame:
    """The accepted answer, else the rule verdict.

    Answers are read behind the join: a gate on the functions then spares those that nothing asks for.
    """
    texts = attach_responses(functions, responses, VERDICT)
    kept = [c for c in texts.columns if c != f"{VERDICT}_text"]
    read = parse_verdicts(texts, f"{VERDICT}_text").select(
        *kept, F.when(F.col("accepted"), F.struct(*VERDICT_FIELDS)).alias("answer")
    )
    answered = F.col("answer").isNotNull()

    def settled(name: str) -> Column:
        rule = (
            F.col("fallback.snippet")
            if name == "code_snippet"
            else fallback_field(F.col("fallback.no"), name)
        )
        return F.when(answered, F.col(f"answer.{name}")).otherwise(rule)

    return (
        read.withColumns(
            {
                **{name: settled(name) for name in VERDICT_FIELDS},
                "verdict_source": F.when(answered, "response").otherwise("fallback"),
            }
        )
        .drop("answer", "fallback")
    )


def accept_findings(verdicts: DataFrame) -> DataFrame:
    """Vulnerable verdicts above the confidence bar."""
    return verdicts.where(
        F.col("vulnerable") & (F.col("confidence") > dims.ACCEPT_ABOVE)
    ).withColumn("vulnerability_type", F.coalesce("vulnerability_type", F.lit("unknown")))
