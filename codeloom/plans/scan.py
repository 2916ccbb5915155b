"""End-to-end scan: files to verdicts and findings.

The whole text part is one narrow stage.  Code never crosses a shuffle: the
rule verdict is computed beside it, and only ids, names and verdict columns go
on to the joins with the answer table and to the reports.  Both joins are keyed by
``fn_id``, which is unique on the function side, so no key is hot and the
functions are shuffled once for the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import risk as R
from ..operators.functions import extract_functions
from ..operators.rules import fallback_rule, rule_hits

FINDING_COLUMNS = [
    "file", "lang", "function", "vulnerability_type", "confidence", "severity", "line_number",
    "code_snippet", "explanation", "remediation",
]


def scored_functions(
    files: DataFrame, responses: DataFrame | None = None, inclusive: bool = True
) -> DataFrame:
    """Functions with ``risk_score``, ``tier`` and the rule verdict, without code."""
    narrow = extract_functions(
        files, ["name", "line_number"], {"fallback": lambda b: fallback_rule(b.code)}
    ).withColumnsRenamed({"path": "file", "name": "function"})
    if responses is None:
        scored = narrow.withColumn("risk_score", F.lit(dims.DEFAULT_RISK))
    else:
        scored = (
            R.with_answers(narrow, R.risk_answers(responses))
            .withColumn("risk_score", F.coalesce("answered_score", F.lit(dims.DEFAULT_RISK)))
            .drop("answered_score")
        )
    return scored.withColumn("tier", R.risk_tier(F.col("risk_score"), inclusive))


def reviewed(
    files: DataFrame, responses: DataFrame | None = None, inclusive: bool = True
) -> DataFrame:
    """Every function with score, tier and verdict, in one pass."""
    scored = scored_functions(files, responses, inclusive)
    if responses is None:
        return R.fallback_verdicts(scored).withColumn("verdict_source", F.lit("fallback"))
    return R.settle_verdicts(scored, responses)


def verdicts(
    files: DataFrame, responses: DataFrame | None = None, inclusive: bool = True
) -> DataFrame:
    """One verdict per function that passes the gate.

    The gate reads columns of the function side only, so the optimizer moves it
    below the join with the verdict answers.
    """
    return reviewed(files, responses, inclusive).where(F.col("tier") == "analyse")


def findings(
    files: DataFrame, responses: DataFrame | None = None, inclusive: bool = True
) -> DataFrame:
    return R.accept_findings(verdicts(files, responses, inclusive)).select(*FINDING_COLUMNS)


def scan(
    files: DataFrame,
    responses: DataFrame | None = None,
    inclusive: bool = True,
    rules: list[tuple[str, str]] = (),
) -> tuple[DataFrame, DataFrame]:
    """(findings, rule hits).  ``rules`` adds the caller's own (id, regex) pairs."""
    hits = extract_functions(
        files, ["name", "line_number"], {"hits": lambda b: rule_hits(b.code, rules)}
    ).select(
        F.col("path").alias("file"), F.col("name").alias("function"), "line_number",
        F.explode("hits").alias("rule_id"),
    )
    return findings(files, responses, inclusive), hits


def finding_struct(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])
