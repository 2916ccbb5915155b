"""Predicates, catalogs and rule scans over functions and calls.

Small catalogs become one alternation or one array of conditions at
plan-building time, so they run inside the scan stage; catalog joins are
broadcasts of fixed size.  There is no theta or cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.folds import bind


def tags_where(conditions: list[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for tag, cond in conditions]))


# --- names, parameters, decorators ----------------------------------------


def name_risk_categories(name: Column) -> Column:
    """Categories with a keyword inside the function name, each once."""
    lowered = F.lower(name)
    return tags_where(
        [(cat, lowered.rlike(dims.any_of(words))) for cat, words in dims.RISK_KEYWORDS.items()]
    )


def user_input_params(lang: Column, params: Column) -> Column:
    """Whether a parameter looks like outside input; in C any ``char *`` does."""

    def named(words: list[str]) -> Column:
        return F.exists(params, lambda p: F.lower(p["name"]).rlike(dims.any_of(words)))

    words = dims.USER_INPUT_PARAMS
    char_pointer = F.exists(
        params, lambda p: p.annotation.contains("*") & p.annotation.contains("char")
    )
    return (
        F.when(lang == "python", named(words["python"]))
        .when(lang == "javascript", named(words["javascript"]))
        .when(lang == "c", named(words["c"]) | char_pointer)
    )


def web_endpoint(decorators: Column) -> Column:
    return F.exists(decorators, lambda d: F.lower(d).rlike(dims.any_of(dims.WEB_DECORATORS)))


def traditional_risk(lang: Column, name: Column, params: Column, decorators: Column) -> Column:
    """.3 for input parameters, .4 for a web decorator, .2 per name category."""
    score = (
        F.when((lang != "c") & user_input_params(lang, params), 0.3).otherwise(0.0)
        + F.when((lang == "python") & web_endpoint(decorators), 0.4).otherwise(0.0)
        + F.size(name_risk_categories(name)) * F.lit(0.2)
    )
    return F.round(F.least(score, F.lit(1.0)), 4)


# --- calls ------------------------------------------------------------------


def dangerous_calls_c(
    spark: SparkSession, calls: DataFrame, crypto_focus: bool = False
) -> DataFrame:
    """Calls found in the C catalog with their categories.

    A name is looked up whole and by its catalog prefix, both as equality, so
    one broadcast hash join answers either.
    """
    prefix = F.regexp_extract("name", "^(" + "|".join(dims.PREFIX_FUNCTIONS) + ")", 1)
    keyed = calls.where(F.col("lang") == "c").withColumn(
        "key",
        F.explode(
            F.array(
                F.struct(F.col("name").alias("function"), F.lit("exact").alias("match_kind")),
                F.struct(prefix.alias("function"), F.lit("prefix").alias("match_kind")),
            )
        ),
    )
    catalog = F.broadcast(
        dims.dangerous_functions(spark, crypto_focus).select(
            F.struct("function", "match_kind").alias("key"), "category"
        )
    )
    return keyed.join(catalog, "key").select(
        "file_id", "fn_id", "function", "name", "category", F.col("key.match_kind").alias("match_kind")
    )


def with_dangerous_flag(
    functions: DataFrame, names: Column, crypto_focus: bool = False
) -> DataFrame:
    """``has_dangerous_calls`` without a join: overlap with the fixed name list."""
    rows = dims.dangerous_function_rows(crypto_focus)
    exact = sorted({f for _, f, kind in rows if kind == "exact"})
    prefixes = sorted({f for _, f, kind in rows if kind == "prefix"})
    flag = F.arrays_overlap(names, F.array(*[F.lit(f) for f in exact]))
    if prefixes:
        flag = flag | F.exists(names, lambda n: n.rlike("^(?:" + "|".join(prefixes) + ")"))
    return functions.withColumn("has_dangerous_calls", flag)


def dangerous_call_py(full_name: Column) -> Column:
    """Whether a dotted call contains one of the listed names."""
    return F.lower(full_name).rlike(dims.any_of(dims.DANGEROUS_PY_NAMES))


def full_call_name(obj: Column, name: Column) -> Column:
    return F.concat_ws(".", obj, name)


def py_call_category(full_name: Column) -> Column:
    """First category, in order, with a term in the call name; else null."""
    lowered = F.lower(full_name)
    out = None
    for cat, words in dims.PY_CALL_CATEGORIES.items():
        hit = lowered.rlike(dims.any_of(words))
        out = F.when(hit, cat) if out is None else out.when(hit, cat)
    return out


def sql_calls(calls: DataFrame) -> DataFrame:
    """One row per call of the SQL category, with whether a direct argument puts a string together."""
    full = full_call_name(F.col("object"), F.col("name"))
    return calls.withColumn("call", full).where(py_call_category(F.col("call")) == "sql_queries").select(
        "fn_id", "line_number", "call", F.col("string_concat").alias("has_string_concat")
    )


# --- code -------------------------------------------------------------------


def required_literal(regex: str) -> str:
    """The longest run of plain characters that every match of ``regex`` holds; "" if none is sure.

    Groups and classes end a run; a repeated or optional character is not part of one.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "|" and not depth or regex.startswith("(?", i) and not depth and i == 0:
            return ""
        if c == "[":
            i = regex.index("]", i + 2 if regex[i + 1] != "^" else i + 3)
        if c in "()":
            depth += 1 if c == "(" else -1
        escaped = c == "\\"
        i += escaped
        plain = (regex[i] if not regex[i].isalnum() else "") if escaped else "" if c in ".^$[]()*+?{}|" else c
        follows = regex[i + 1 : i + 2]
        if plain and not depth and follows not in ("*", "?", "{"):
            run += plain
            if follows == "+":
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
            if c == "{" and not escaped:
                i = regex.index("}", i)
        i += 1
    return max([*runs, run], key=len)


def _guarded(text: Column, regex: str) -> Column:
    """``regex`` found in ``text``; it runs only on a text that holds its literal.

    (?d): "." stops at a line feed only.
    """
    literal, found = required_literal(regex), text.rlike("(?d)" + regex)
    return text.contains(literal) & found if literal else found


def rule_hits(code: Column, extra: list[tuple[str, str]] = ()) -> Column:
    """Ids of the catalog rules found in a text (plus caller's own id, regex).

    One pass looks for any of the rules' literals; a text without one has no hit, and in others only
    the rules whose own literal is there run.
    """
    rules = [(rule_id, regex) for rule_id, _, regex in dims.rule_rows()] + list(extra)
    literals = {required_literal(regex) for _, regex in rules}
    # A literal that holds a shorter one adds nothing to the search for any.
    least = sorted(a for a in literals if not any(b != a and b in a for b in literals))
    hits = tags_where([(rule_id, _guarded(code, regex)) for rule_id, regex in rules])
    if "" in literals:
        return hits
    some = code.rlike(dims.any_of(least, lower=False))
    return F.when(some, hits).otherwise(F.expr("cast(array() as array<string>)"))


def rule_scan(texts: DataFrame, key: list[str], code: str, extra=()) -> DataFrame:
    """One row per text and rule that hits."""
    types = F.create_map(*[F.lit(x) for row in dims.rule_rows() for x in row[:2]])
    hits = texts.select(*key, F.explode(rule_hits(F.col(code), extra)).alias("rule_id"))
    return hits.withColumn("vulnerability_type", F.try_element_at(types, F.col("rule_id")))


def crypto_indicators(code: Column) -> Column:
    lowered = F.lower(code)
    return tags_where(
        [(tag, lowered.rlike(dims.any_of(words))) for tag, words in dims.CRYPTO_INDICATORS.items()]
    )


def c_security_flags(code: Column) -> dict[str, Column]:
    alloc = code.contains("malloc(") | code.contains("calloc(")
    return {
        "buffer_overflow_risk": code.rlike("(?i)" + "|".join(dims.BUFFER_OVERFLOW_PATTERNS)),
        "format_string_risk": code.rlike("(?i)" + "|".join(dims.FORMAT_STRING_PATTERNS)),
        "memory_leak_risk": alloc & ~code.contains("free("),
        "integer_overflow_risk": F.lit(False),
        "null_pointer_risk": code.rlike(dims.NULL_POINTER_PATTERN),
    }


def hardcoded_secrets(text: Column) -> Column:
    """Every literal credential assignment in a text."""
    return F.regexp_extract_all(text, F.lit(dims.SECRET_PATTERN), F.lit(0))


def fallback_rule(code: Column) -> Column:
    """``struct(no, snippet)`` of the first fallback rule that hits; no 0 for none.

    Only this leaves the text stage; :func:`fallback_field` names the rest.
    """

    def first_hit(lowered: Column) -> Column:
        out = None
        for no, (regex, *_) in enumerate(dims.FALLBACK_RULES, 1):
            hit = F.struct(
                F.lit(no).alias("no"),
                F.substring(
                    F.regexp_extract(lowered, "(?d)" + regex, 0), 1, dims.FALLBACK_SNIPPET_LIMIT
                ).alias("snippet"),
            )
            cond = _guarded(lowered, regex)
            out = F.when(cond, hit) if out is None else out.when(cond, hit)
        return out.otherwise(F.struct(F.lit(0).alias("no"), F.lit("").alias("snippet")))

    return bind(F.lower(code), first_hit)


def fallback_field(rule_no: Column, field: str) -> Column:
    """One verdict field as the fallback rule of that number states it."""
    rules = dims.FALLBACK_RULES
    values = {
        "vulnerable": (False, [True] * len(rules)),
        "confidence": (0.0, [r[1] for r in rules]),
        "vulnerability_type": (None, [r[2] for r in rules]),
        "severity": ("none", [dims.FALLBACK_SEVERITY] * len(rules)),
        "explanation": (dims.FALLBACK_CLEAN, [r[3] + dims.FALLBACK_SUFFIX for r in rules]),
        "remediation": ("", [dims.FALLBACK_REMEDIATION] * len(rules)),
    }
    none, by_rule = values[field]
    return F.get(F.array(F.lit(none), *[F.lit(v) for v in by_rule]), rule_no)


# --- taxonomy ----------------------------------------------------------------


def outside_taxonomy(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """Findings whose type the language's closed list does not hold."""
    return findings.join(
        F.broadcast(dims.vuln_types(spark)), ["lang", "vulnerability_type"], "left_anti"
    )


def with_severity_rank(spark: SparkSession, findings: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(dims.severity_levels(spark)), "severity", "left")


def confidence_band(confidence: Column) -> Column:
    out = None
    for low, band in dims.CONFIDENCE_BANDS:
        cond = confidence >= low
        out = F.when(cond, band) if out is None else out.when(cond, band)
    return out
