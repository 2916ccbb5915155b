"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import brace_code as B
from ..functions import normalize as N
from ..functions import python_code as P
from ..functions.folds import pair_index
from ..functions.lexing import js_skeleton
from ..operators import buildlog as L
from ..operators import functions as X
from ..operators import risk as R
from ..operators import rules as U
from ..plans import reports as Q
from ..plans import scan as S
from ..session import scratch_path
from ..sources import corpus
from ..sources import files as Z
from ..streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

col, lit = F.col, F.lit


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- inputs ------------------------------------------------------------------


def _files(spark: SparkSession, sf: str, *langs: str) -> DataFrame:
    files = corpus.source_files(spark, sf)
    return files.where(col("lang").isin(*langs)) if langs else files


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a file: sources, documents (by language) and pages."""
    docs = _documents(spark, sf).select(
        F.concat_ws("/", lit("docs"), "source", F.concat_ws(".", "doc_id", "lang")).alias("path"),
        col("text").alias("content"),
    )
    pages = _pages(spark, sf).select(
        F.concat(lit("pages/"), col("page_id").cast("string"), lit(".html")).alias("path"),
        col("html").alias("content"),
    )
    return _files(spark, sf).select("path", "content").unionByName(docs).unionByName(pages)


def _responses(files: DataFrame) -> DataFrame:
    return corpus.responses(files)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return S.verdicts(files, _responses(files))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return S.findings(files, _responses(files))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return Z.scan_build_records(corpus.build_records(spark, sf))


def _blocks(spark: SparkSession, sf: str, lang: str, *fields: str, **derive) -> DataFrame:
    return X.extract_functions(_files(spark, sf, lang), list(fields), derive)


# --- sources -------------------------------------------------------------------


@query
def scan_source_files(spark, sf):
    inv = _inventory(spark, sf).select("path", Z.extension(col("path")).alias("ext"))
    return inv.where(col("ext").isin(list(dims.LANGUAGES))).orderBy("path")


@query
def scan_text_files(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query
def decode_with_fallback(spark, sf):
    """German texts are stored as Latin-1 bytes, French ones in quotes of code page 1252, Spanish ones as
    UTF-16 in either order of bytes, one source with a byte-order mark, the others as UTF-8."""
    western = F.encode("text", "ISO-8859-1")
    spanish = F.when(col("source") == "src0", F.concat(F.unhex(lit("FFFE")), F.encode("text", "UTF-16LE"))).when(
        col("source") < "src2", F.encode("text", "UTF-16LE")
    ).otherwise(F.encode("text", "UTF-16BE"))
    raw = _documents(spark, sf).select(
        "doc_id",
        F.when(col("lang") == "de", western)
        .when(col("lang") == "fr", F.concat(F.unhex(lit("93")), western, F.unhex(lit("94"))))
        .when(col("lang") == "es", spanish)
        .otherwise(F.encode("text", "UTF-8"))
        .alias("raw"),
    )
    decoded = raw.select("doc_id", Z.decode_with_fallback(col("raw")).alias("d"))
    return decoded.select("doc_id", "d.encoding", F.md5("d.content").alias("content_md5"))


@query
def route_language(spark, sf):
    return _inventory(spark, sf).select(
        "path", Z.extension(col("path")).alias("ext"), Z.language(col("path")).alias("lang")
    )


@query
def unsupported_files(spark, sf):
    return Z.unsupported(spark, _inventory(spark, sf)).select("path", "ext")


@query
def scan_preprocessed(spark, sf):
    return _inventory(spark, sf).where(Z.extension(col("path")) == "i").select(
        "path", F.length("content").alias("n_chars")
    )


@query
def drop_marker_line(spark, sf):
    """Preprocessed files carry a wrapper message, headers do not."""
    files = _files(spark, sf, "c").withColumn(
        "raw",
        F.when(col("ext") == "i", F.concat(lit(N.MARKER + " Preprocessing\n"), col("content")))
        .otherwise(col("content")),
    )
    return files.select("file_id", F.md5(N.drop_marker_line(col("raw"))).alias("content_md5"))


@query
def lines_explode(spark, sf):
    return Z.number_lines(_documents(spark, sf), "doc_id", "text")


@query
def read_findings_json(spark, sf):
    reports = Q.report_json(Q.single_file_reports(_findings(spark, sf)))
    return Z.read_findings(reports)


@query
def quarantine_files(spark, sf):
    _, rejected = Z.quarantine(_inventory(spark, sf))
    return rejected.select("path", "error")


@query
def scan_build_records(spark, sf):
    return _records(spark, sf).select(
        "record_id", "cwd", "compiler", F.array_join("argv", " ").alias("argv")
    )


# --- sinks and reports -----------------------------------------------------------


@query
def report_single_file(spark, sf):
    return Q.report_json(Q.single_file_reports(_findings(spark, sf)))


@query
def report_scan(spark, sf):
    return Q.scan_report(_files(spark, sf), _findings(spark, sf))


@query
def report_preprocessed(spark, sf):
    """C files; the gate is exclusive here."""
    files = _files(spark, sf, "c")
    reviewed = S.reviewed(files, _responses(files), inclusive=False)
    checked = files.withColumn("error", Z.file_error(col("path"), col("content")))
    return Q.preprocessed_reports(reviewed, checked)


@query
def report_build_summary(spark, sf):
    return Q.build_summary(_files(spark, sf), _findings(spark, sf))


@query
def sink_per_file_json(spark, sf):
    """One file per report, written and read back with the place where it was found."""
    target = scratch_path(spark, "reports")
    Q.write_reports(_findings(spark, sf), target)
    found = Z.read_report_files(spark, target).select(
        F.substring_index("path", target.rsplit("/", 1)[1] + "/", -1).alias("report_path"), "value"
    )
    return found.select(
        "report_path", F.from_json("value", Z.REPORT).alias("r")
    ).select(
        Z.language(col("r.file")).alias("lang"), "r.file", "r.total_vulnerabilities", "report_path",
        F.size("r.findings").alias("n_listed"),
    )


# --- normalisation ----------------------------------------------------------------

# Lines with compiler extensions, put before each C file.
EXTENSION_LINES = (
    "static __attribute__((unused)) int __always_inline__ probe_{K}(char * restrict p);\n"
    "struct s {\n  int restricted; } __packed__ __aligned__ (8);\n"
    "fd_set set_{K}; FD_ZERO(&set_{K}); FD_SET (0, &set_{K}); if (FD_ISSET(0, &set_{K})) { }\n"
)


def _extended(spark, sf):
    head = F.replace(lit(EXTENSION_LINES), lit("{K}"), col("file_id").cast("string"))
    return _files(spark, sf, "c").withColumn("content", F.concat(head, col("content")))


def _text(df: DataFrame, value: Column) -> DataFrame:
    return df.select("file_id", value.alias("text"))


@query
def strip_c_comments(spark, sf):
    return _text(_files(spark, sf, "c"), N.strip_c_comments(col("content")))


@query
def drop_c_directives(spark, sf):
    return _text(_files(spark, sf, "c"), N.drop_c_directives(col("content")))


@query
def strip_gcc_attributes(spark, sf):
    return _text(_extended(spark, sf), N.strip_gcc_attributes(col("content")))


@query
def stub_fd_macros(spark, sf):
    return _text(_extended(spark, sf), N.stub_fd_macros(col("content")))


@query
def canonical_whitespace(spark, sf):
    return _text(_extended(spark, sf), N.canonical_whitespace(col("content")))


@query
def strip_ts_types(spark, sf):
    return _text(_files(spark, sf, "javascript"), N.strip_ts_types(col("content")))


# --- functions ----------------------------------------------------------------------


@query
def py_functions(spark, sf):
    return _blocks(spark, sf, "python", "name", "kind", "line_number", "end_line").select(
        "fn_id", "name", "kind", "line_number", "end_line"
    )


@query
def py_class_context(spark, sf):
    return _blocks(spark, sf, "python", "full_name", "class_context").select(
        "fn_id", "full_name", "class_context"
    )


@query
def py_decorators(spark, sf):
    fns = _blocks(spark, sf, "python", "decorators", "first_line")
    return fns.select("fn_id", "first_line", F.array_join("decorators", ",").alias("decorators"))


@query
def py_params(spark, sf):
    fns = _blocks(spark, sf, "python", "code")
    return fns.select("fn_id", F.posexplode(P.python_params(col("code"))).alias("pos", "p")).select(
        "fn_id", "pos", "p.name", "p.annotation", "p.default"
    )


@query
def py_return_annotation(spark, sf):
    return _blocks(spark, sf, "python", "name", "code").select(
        "fn_id", "name", P.python_return(col("code")).alias("return_annotation")
    )


@query
def js_functions(spark, sf):
    return _blocks(spark, sf, "javascript", "name", "kind", "line_number", "end_line").select(
        "fn_id", "name", "kind", "line_number", "end_line"
    )


@query
def js_params(spark, sf):
    fns = _blocks(spark, sf, "javascript", params=lambda b: B.js_params(b.kind, b.signature))
    return fns.select("fn_id", F.array_join("params", ",").alias("params"))


@query
def c_functions(spark, sf):
    return _blocks(spark, sf, "c", "name", "line_number", "return_type").select(
        "fn_id", "name", "line_number", "return_type"
    )


@query
def c_params(spark, sf):
    fns = _blocks(spark, sf, "c", params=lambda b: B.c_params(b.signature))
    return fns.select(
        "fn_id", F.size("params").alias("param_count"), F.posexplode("params").alias("pos", "p")
    ).select("fn_id", "param_count", "pos", "p.name", "p.type", "p.is_pointer", "p.is_array")


@query
def c_function_span(spark, sf):
    return _blocks(spark, sf, "c", "line_number", "end_line", "code").select(
        "fn_id", "line_number", "end_line", F.md5("code").alias("code_md5")
    )


@query
def py_function_source(spark, sf):
    return _blocks(spark, sf, "python", "code").select("fn_id", "code")


@query
def js_function_source(spark, sf):
    return _blocks(spark, sf, "javascript", "code").select("fn_id", "code")


@query
def union_functions(spark, sf):
    return X.extract_functions(_files(spark, sf), ["name", "line_number"]).select(
        "fn_id", "lang", "name", "line_number"
    )


@query
def number_functions(spark, sf):
    return X.extract_functions(_files(spark, sf), ["name", "line_number"]).select(
        "path", "fn_no", "name", "line_number"
    )


@query
def parse_recovery(spark, sf):
    """Files of finished orders hold a broken line between two copies of their text."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        col("o_orderkey").alias("file_id"), "o_orderstatus"
    )
    files = corpus.broken_twice(_files(spark, sf).join(orders, "file_id"), col("o_orderstatus") == "F")
    return X.parse_quality(files).select(
        "file_id", "n_lines", "n_unbalanced", "error_line", "n_kept", "functions_before", "functions_after"
    )


# --- imports and calls ------------------------------------------------------------------


def _imports(spark, sf, lang):
    return X.extract_imports(_files(spark, sf, lang))


@query
def py_imports(spark, sf):
    return _imports(spark, sf, "python").select(
        "file_id", "line_number", "kind", "module", "name", "alias", "statement"
    )


@query
def js_imports(spark, sf):
    return _imports(spark, sf, "javascript").select(
        "file_id", "line_number", "kind", "module", "statement"
    )


@query
def c_includes(spark, sf):
    return _imports(spark, sf, "c").select("file_id", "line_number", "module", "statement")


@query
def hint_includes(spark, sf):
    return X.hint_includes(_files(spark, sf)).select(
        "file_id", F.array_join("hints", ";").alias("hints")
    )


@query
def py_calls(spark, sf):
    return X.extract_python_calls(_files(spark, sf)).select(
        "fn_id", "line_number", "name", "object", "kind", "args_count", "kwargs_count",
        U.dangerous_call_py(U.full_call_name(col("object"), col("name"))).alias("is_dangerous"),
    )


@query
def js_calls(spark, sf):
    return X.extract_calls(_files(spark, sf, "javascript")).select("fn_id", "name")


@query
def c_calls(spark, sf):
    return X.extract_calls(_files(spark, sf, "c")).select("fn_id", "name")


@query
def page_script_calls(spark, sf):
    """Calls made by the inline scripts of each page."""
    scripts = F.regexp_extract_all("html", lit(r"(?s)<script[^>]*>(.*?)</script>"))
    names = F.array_distinct(
        F.flatten(F.transform(scripts, lambda s: B.js_call_names(pair_index(js_skeleton(s)))))
    )
    return _pages(spark, sf).select("page_id", F.explode(names).alias("name"))


# --- classification -----------------------------------------------------------------------


@query
def dangerous_calls_c(spark, sf):
    return U.dangerous_calls_c(spark, X.extract_calls(_files(spark, sf, "c"))).select(
        "fn_id", "name", "category", "match_kind"
    )


@query
def crypto_catalog_extend(spark, sf):
    """The merged catalog in use: C calls by category under the crypto focus."""
    calls = X.extract_calls(_files(spark, sf, "c"))
    return U.dangerous_calls_c(spark, calls, crypto_focus=True).groupBy(
        "category", "name", "match_kind"
    ).agg(F.count("*").alias("n_functions"))


@query
def has_dangerous_calls(spark, sf):
    fns = _blocks(spark, sf, "c", "name", calls=lambda b: X.call_names(lit("c"), b.skeleton))
    return U.with_dangerous_flag(fns, col("calls")).select("fn_id", "name", "has_dangerous_calls")


@query
def crypto_indicators(spark, sf):
    tagged = _blocks(spark, sf, "c", "name", tags=lambda b: U.crypto_indicators(b.code))
    return tagged.select("fn_id", F.explode("tags").alias("indicator"))


@query
def crypto_enrich_context(spark, sf):
    contexts = X.build_contexts(_files(spark, sf, "c"))
    deps = F.concat("dependencies", U.crypto_indicators(col("function_code")))
    return contexts.select("fn_id", F.array_join(deps, ",").alias("dependencies"))


def _with_params(spark, sf):
    fns = X.extract_functions(
        _files(spark, sf),
        ["name", "kind", "decorators", "signature", "return_type", "code"],
    )
    return X.with_params(fns)


@query
def user_input_params(spark, sf):
    return _with_params(spark, sf).select(
        "fn_id", U.user_input_params(col("lang"), col("params")).alias("has_user_input_params")
    )


@query
def dangerous_calls_py(spark, sf):
    calls = X.extract_python_calls(_files(spark, sf))
    full = U.full_call_name(col("object"), col("name"))
    return calls.select("fn_id", "line_number", full.alias("call")).where(
        U.dangerous_call_py(col("call"))
    )


@query
def name_risk_categories(spark, sf):
    fns = X.extract_functions(_files(spark, sf), ["name"])
    return fns.select("fn_id", "name", F.explode(U.name_risk_categories(col("name"))).alias("category"))


@query
def web_endpoint_flag(spark, sf):
    return _blocks(spark, sf, "python", "name", "decorators").select(
        "fn_id", "name", U.web_endpoint(col("decorators")).alias("is_web_endpoint")
    )


@query
def traditional_risk_score(spark, sf):
    return _with_params(spark, sf).select(
        "fn_id",
        U.traditional_risk(col("lang"), col("name"), col("params"), col("decorators")).alias("score"),
    )


@query
def rule_scan(spark, sf):
    _, hits = S.scan(_files(spark, sf))
    return hits.select("file", "function", "line_number", "rule_id")


@query
def rule_scan_pages(spark, sf):
    """The catalog, which holds rules for code, and two of the caller's own for pages."""
    own = [("inline_script", "<script>[^<]"), ("plain_http_link", r"http://[\w.]+")]
    return U.rule_scan(_pages(spark, sf), ["page_id"], "html", own)


@query
def rule_scan_documents(spark, sf):
    """The catalog, which holds rules for code, and two of the caller's own for prose."""
    own = [("credential_in_text", r"(password|token)\s*=\s*\S"), ("access_key", "AKIA[A-Z0-9]{16}")]
    return U.rule_scan(_documents(spark, sf), ["doc_id"], "text", own)


@query
def fallback_verdict(spark, sf):
    out = S.verdicts(_files(spark, sf))
    return out.select("fn_id", *R.VERDICT_FIELDS)


@query
def c_security_flags(spark, sf):
    fns = _blocks(spark, sf, "c", "code")
    flags = U.c_security_flags(col("code"))
    return fns.select("fn_id", *[v.alias(k) for k, v in flags.items()])


@query
def py_pattern_categories(spark, sf):
    calls = X.extract_python_calls(_files(spark, sf))
    full = U.full_call_name(col("object"), col("name"))
    return calls.select(
        "fn_id", "line_number", full.alias("call"), U.py_call_category(full).alias("category")
    ).where(col("category").isNotNull())


@query
def sql_string_concat_flag(spark, sf):
    return U.sql_calls(X.extract_python_calls(_files(spark, sf)))


@query
def vuln_taxonomy(spark, sf):
    found = U.outside_taxonomy(spark, _findings(spark, sf))
    return found.select("lang", "vulnerability_type", "file", "function", "line_number")


@query
def severity_scale(spark, sf):
    ranked = U.with_severity_rank(spark, _findings(spark, sf))
    return ranked.where(col("severity_rank") >= 4).select(
        "file", "function", "line_number", "severity", "severity_rank"
    )


@query
def confidence_bands(spark, sf):
    return _verdicts(spark, sf).groupBy(U.confidence_band(col("confidence")).alias("band")).agg(
        F.count("*").alias("n"), F.count_if(col("confidence") >= 0.7).alias("n_probable")
    )


@query
def hardcoded_secrets(spark, sf):
    hits = _documents(spark, sf).select(
        "doc_id", F.posexplode(U.hardcoded_secrets(col("text"))).alias("pos", "literal")
    )
    return hits


# --- scoring, prompts, answers ---------------------------------------------------------------


@query
def build_context(spark, sf):
    return X.build_contexts(_files(spark, sf)).select(
        "fn_id", "function_name", "line_number", F.md5("function_code").alias("code_md5"),
        F.array_join("imports", ";").alias("imports"),
        F.array_join("dependencies", ",").alias("dependencies"),
    )


@query
def risk_context_truncate(spark, sf):
    """Whole files stand for long functions here."""
    return _files(spark, sf, "c").select(
        "file_id", R.scoring_code(F.concat_ws("\n", "content", "content")).alias("scoring_code")
    )


@query
def render_risk_prompt(spark, sf):
    return X.build_contexts(_files(spark, sf)).select(
        "fn_id",
        R.risk_prompt(
            col("function_name"), col("function_code"), col("imports"), col("dependencies")
        ).alias("prompt"),
    )


@query
def render_vuln_prompt(spark, sf):
    return X.build_contexts(_files(spark, sf)).select(
        "fn_id",
        R.review_prompt(
            col("lang"), col("function_name"), col("line_number"), col("function_code"),
            col("imports"), col("dependencies"),
        ).alias("prompt"),
    )


@query
def attach_responses(spark, sf):
    files = _files(spark, sf)
    fns = X.extract_functions(files, ["name"]).select("fn_id", "name")
    answers = _responses(files)
    return R.attach_responses(R.attach_responses(fns, answers, R.RISK), answers, R.VERDICT)


@query
def parse_risk_response(spark, sf):
    answers = _responses(_files(spark, sf)).where(col("stage") == R.RISK)
    return answers.select("fn_id", R.parse_risk(col("response_text")).alias("score"))


@query
def parse_risk_text(spark, sf):
    """The same reading of free text answers: every conversation turn."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return turns.select("conv_id", "turn", R.parse_risk(col("text")).alias("score"))


@query
def default_risk(spark, sf):
    files = _files(spark, sf)
    return S.scored_functions(files, _responses(files)).select("fn_id", "risk_score")


@query
def parse_verdict(spark, sf):
    answers = _responses(_files(spark, sf)).where(col("stage") == R.VERDICT)
    return R.parse_verdicts(answers, "response_text").select("fn_id", "accepted", *[
        F.when(col("accepted"), col(f)).alias(f) for f in R.VERDICT_FIELDS
    ])


@query
def settled_verdicts(spark, sf):
    return _verdicts(spark, sf).select("fn_id", "verdict_source", *R.VERDICT_FIELDS)


@query
def risk_gate(spark, sf):
    files = _files(spark, sf)
    scored = S.scored_functions(files, _responses(files))
    return scored.select(
        "fn_id", "tier", R.risk_tier(col("risk_score"), inclusive=False).alias("strict_tier")
    )


@query
def accept_findings(spark, sf):
    return _findings(spark, sf)


# --- summaries -----------------------------------------------------------------------------------


@query
def scan_summary(spark, sf):
    return Q.scan_summary(_files(spark, sf), _findings(spark, sf))


@query
def offline_scan_summary(spark, sf):
    """Flagship: the whole scan without answers, files to counters."""
    files = _files(spark, sf)
    return Q.scan_summary(files, S.findings(files))


@query
def functions_summary(spark, sf):
    files = _files(spark, sf)
    return Q.functions_summary(S.scored_functions(files, _responses(files)))


@query
def findings_by_file(spark, sf):
    return Q.findings_by_file(_findings(spark, sf))


@query
def clean_files(spark, sf):
    return Q.clean_files(_files(spark, sf), _findings(spark, sf))


@query
def rollup_findings(spark, sf):
    return Q.rollup_findings(_findings(spark, sf))


# --- incremental and streaming -----------------------------------------------------------------


def _with_status(spark, sf):
    """Files beside their order's status.  Thin rows are joined and dealt evenly, so that no text is shuffled."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    status = orders.select("o_orderkey", "o_orderstatus", col("o_orderpriority").alias("priority"))
    thin = corpus.spread(orders.select("o_orderkey", "o_orderpriority").join(status, "o_orderkey"))
    return thin.select(*corpus.file_columns(), "o_orderstatus", "priority").withColumnRenamed(
        "priority", "o_orderpriority"
    )


def _previous_files(spark, sf):
    """What an earlier scan saw: no open orders, and pending ones with other text."""
    old = _with_status(spark, sf).where(col("o_orderstatus") != "O")
    text = F.when(col("o_orderstatus") == "P", F.concat("content", lit(OLD_LINES))).otherwise(col("content"))
    return old.withColumn("content", text).drop("o_orderstatus", "o_orderpriority")


def _present_files(spark, sf):
    """What is there now: finished orders of low priority have gone."""
    return _with_status(spark, sf).where(~_gone()).drop("o_orderstatus", "o_orderpriority")


def _gone():
    return (col("o_orderstatus") == "F") & (col("o_orderpriority") == "5-LOW")


# A line of an earlier text.
OLD_LINES = "# old\n"


def _previous_manifest(spark, sf):
    return I.manifest(_previous_files(spark, sf))


@query
def incremental_scan(spark, sf):
    return I.changed_paths(_files(spark, sf), _previous_manifest(spark, sf))


@query
def changed_findings(spark, sf):
    return I.changed_findings(_files(spark, sf), _previous_manifest(spark, sf))


@query
def deleted_paths(spark, sf):
    return I.deleted_paths(_present_files(spark, sf), _previous_manifest(spark, sf))


@query
def corrected_findings(spark, sf):
    """An earlier scan and one of what is there now, in one store: what holds after both."""
    store = scratch_path(spark, "scans")
    I.scan_changes(_previous_files(spark, sf), 1, store)
    I.scan_changes(_present_files(spark, sf), 2, store)
    return I.kept_findings(spark, store)


@query
def scan_versions(spark, sf):
    """The manifest that those two scans leave: each path's last change."""
    store = scratch_path(spark, "scans")
    I.scan_changes(_previous_files(spark, sf), 1, store)
    I.scan_changes(_present_files(spark, sf), 2, store)
    return I.kept_manifest(spark, store)


@query
def append_findings(spark, sf):
    """The offline scan as an append-only stream over the orders as they arrive."""
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    arriving = (
        spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    )
    thin = corpus.spread(arriving.select("o_orderkey", "o_orderpriority"))
    return I.scan_as_stream(spark, corpus.files_from_orders(thin))


def _event_files(events):
    """Thin events to files; those of the first batch have the earlier text where it differed."""
    keyed = events.withColumnsRenamed({"path": "event_path", "lang": "event_lang"})
    old = F.when(col("old"), F.concat("content", lit(OLD_LINES))).otherwise(col("content"))
    made = keyed.select(*corpus.file_columns(), "old")
    return made.withColumn("content", old).drop("old")


@query
def stream_findings(spark, sf):
    """Files appear, change and go in three batches; the last one comes twice, as after a crash."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = next(c for c, name in zip(corpus.file_columns(), corpus.FILE_FIELDS, strict=True) if name == "path")
    never, always = lit(False), lit(True)
    waiting, pending = col("o_orderstatus") == "O", col("o_orderstatus") == "P"
    batches = [(~waiting, never, pending), (waiting | pending, never, never), (_gone(), always, never)]
    inbox, store, checkpoint = (scratch_path(spark, x) for x in ("inbox", "scans", "scans-checkpoint"))
    thin = ["path", "seq", "deleted", "old", "o_orderkey", "o_orderpriority"]
    for seq, (rows, deleted, old) in enumerate(batches):
        events = orders.where(rows).withColumns({"path": path, "seq": lit(seq), "deleted": deleted, "old": old})
        events.select(*thin).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(events.select(*thin).schema).parquet(inbox)
        I.correcting_stream(arriving, store, checkpoint, files_of=_event_files).awaitTermination()
    I.record_scan(events.select(*thin), seq, store, files_of=_event_files)
    return I.kept_findings(spark, store)


# --- build records -----------------------------------------------------------------------------


@query
def compile_sources(spark, sf):
    return L.compile_sources(_records(spark, sf)).select("record_id", "arg_no", "source")


@query
def preprocessor_flags(spark, sf):
    return L.preprocessor_flags(_records(spark, sf))


@query
def compile_only_flag(spark, sf):
    return _records(spark, sf).select("record_id", L.compile_only(col("argv")).alias("compile_only"))


@query
def resolve_source_path(spark, sf):
    sources = L.compile_sources(_records(spark, sf))
    absolute = sources.withColumn("source_path", L.absolute_source(col("cwd"), col("source")))
    return absolute.select(
        "record_id", "arg_no", "source_path",
        L.preprocessed_path(col("source_path"), "/home/dev/proj", "out").alias("output_path"),
    ).withColumn("meta_path", L.metadata_path(col("output_path")))


@query
def compiler_family(spark, sf):
    return L.compiler_family(spark, _records(spark, sf)).select("record_id", "compiler", "family")
