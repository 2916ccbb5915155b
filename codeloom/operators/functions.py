"""From ``files`` to ``functions``, ``imports``, ``calls`` and ``contexts``.

All of these are narrow: one pass over each file's row, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brace_code as B
from ..functions import python_code as P
from ..functions.folds import bind
from ..functions.lexing import c_skeleton, js_parts, python_parts, unix_newlines
from ..functions.recovery import structure_of
from ..functions.spans import spans_of
from ..functions.walks import literals_of, signatures_of

MAX_IMPORTS = 5
MAX_DEPENDENCIES = 10
_NO_STRINGS = "cast(array() as array<string>)"


def _by_language(lang: Column, python: Column, javascript: Column, c: Column) -> Column:
    return F.when(lang == "python", python).when(lang == "javascript", javascript).when(
        lang == "c", c
    )


def import_statements(lang: Column, text: Column) -> Column:
    """Canonical import statements of one file in line order."""
    statement = lambda r: r.statement
    return _by_language(
        lang,
        F.transform(P.python_imports(text), statement),
        F.transform(B.js_imports(text), statement),
        F.transform(B.c_includes(text), statement),
    )


BLOCK_FIELDS = [
    "name", "full_name", "kind", "class_context", "line_number", "end_line", "decorators",
    "signature", "return_type", "first_line", "code", "skeleton",
]


# The expressions below read columns by name, so one of each sort
# serves every plan: building them takes thousands of calls into the JVM.
@cache
def _parts() -> list[Column]:
    """A file's text, and its skeleton where passes over the text give it."""
    lang, text = F.col("lang"), unix_newlines(F.col("content"))
    none = F.lit(None).cast("string")
    read = bind(
        text,
        lambda t: _by_language(
            lang, python_parts(t), js_parts(t), F.struct(none.alias("bare"), c_skeleton(t).alias("simple"))
        ),
    )
    # Exploded, so that the optimizer leaves the expression where it is; the same below.
    return [text.alias("_text"), F.explode(F.array(read)).alias("_parts")]


@cache
def _given() -> Column:
    """What a file's spans are read from."""
    skeleton = F.coalesce("_parts.simple", "_literals")
    read = bind(
        skeleton, lambda s: _by_language(F.col("lang"), P.python_given(s), B.js_given(s), B.c_given(s))
    )
    return F.explode(F.array(read)).alias("_given")


class _Reads:
    """Stands for a block and remembers the fields that are read."""

    def __init__(self):
        self.names: set[str] = set()

    def __getattr__(self, name: str) -> Column:
        self.names.add(name)
        return F.col(name)

    __getitem__ = __getattr__


@cache
def _file_blocks(with_imports: bool, needed: frozenset[str]) -> Column:
    """Blocks of a file, or ``struct(blocks, imports)``; Python's skeleton serves both."""
    lang, text, skel, spans = F.col("lang"), F.col("_text"), F.col("_given.skeleton"), F.col("_spans")
    blocks = _by_language(
        lang, *[found(text, skel, spans, needed) for found in (P.python_found, B.js_found, B.c_found)]
    )
    if not with_imports:
        return blocks
    imports = _by_language(
        lang,
        F.transform(P.python_imports(text, skel), lambda r: r.statement),
        import_statements(F.lit("javascript"), text),
        import_statements(F.lit("c"), text),
    )
    return F.struct(blocks.alias("blocks"), F.slice(imports, 1, MAX_IMPORTS).alias("imports"))


def _with_skeletons(files: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns of the files, text and skeleton; the walk reads only what the passes have left."""
    parts = files.select(*kept, *_parts())
    left = F.when(F.col("_parts.simple").isNull(), F.col("_parts.bare"))
    return parts.withColumn("_literals", literals_of(F.col("lang"), left))


def _with_spans(files: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns of the files, and those that :func:`_file_blocks` reads."""
    skeleton = F.coalesce("_parts.simple", "_literals").alias("_skeleton")
    given = _with_skeletons(files, *kept).select(*kept, "_text", skeleton, _given())
    return given.withColumn("_spans", spans_of(F.col("lang"), F.col("_given.walked")))


def extract_functions(
    files: DataFrame,
    fields: list[str] = BLOCK_FIELDS,
    derive: dict[str, Callable[[Column], Column]] | None = None,
    with_imports: bool = False,
) -> DataFrame:
    """One row per function definition.

    ``fn_no`` counts the functions of a file in line order and makes ``fn_id``.
    ``derive`` adds columns computed from the block beside its text, so that a
    plan that needs no source need not emit it, and a later filter cannot pull
    the computation apart.  ``with_imports`` carries the file's first imports
    along, so that a context needs no join back to the file.
    """

    def row(b: Column, i: Column, extra: list[Column]) -> Column:
        return F.struct(
            *extra,
            (i + 1).alias("fn_no"),
            *[b[name].alias(name) for name in fields],
            *[fn(b).alias(name) for name, fn in (derive or {}).items()],
        )

    reads = _Reads()
    for fn in (derive or {}).values():
        fn(reads)
    needed = frozenset([*fields, *reads.names])
    if with_imports:
        rows = bind(
            _file_blocks(True, needed),
            lambda f: F.transform(f.blocks, lambda b, i: row(b, i, [f.imports.alias("imports")])),
        )
    else:
        rows = F.transform(_file_blocks(False, needed), lambda b, i: row(b, i, []))
    out = _with_spans(files, "file_id", "path", "lang").select("file_id", "path", "lang", F.inline(rows))
    return out.withColumn("fn_id", F.concat_ws("#", "file_id", "fn_no"))


@cache
def _param_columns() -> dict[str, Column]:
    blank = F.lit(None).cast("string")

    def named(name: Column, annotation: Column = blank, default: Column = blank) -> Column:
        return F.struct(
            name.alias("name"), annotation.alias("annotation"), default.alias("default")
        )

    params = _by_language(
        F.col("lang"),
        F.col("_signature.params"),
        F.transform(B.js_params(F.col("kind"), F.col("signature")), lambda n: named(n)),
        F.transform(B.c_params(F.col("signature")), lambda p: named(p["name"], p.type)),
    )
    result = F.when(F.col("lang") == "python", F.col("_signature.result")).otherwise(F.col("return_type"))
    return {"params": params, "return_type": result}


def with_params(functions: DataFrame) -> DataFrame:
    """Adds ``params`` (name, annotation, default) and Python return types.

    Python's are read by a walk, as a fold over every annotation takes most of a scan.
    """
    signature = signatures_of(F.when(F.col("lang") == "python", F.col("code")))
    return functions.withColumn("_signature", signature).withColumns(_param_columns()).drop("_signature")


def call_names(lang: Column, skeleton: Column) -> Column:
    """Called names of one function, distinct and in name order."""
    names = _by_language(
        lang,
        P.python_call_names(skeleton),
        B.js_call_names(skeleton),
        B.c_call_names(skeleton),
    )
    return F.sort_array(F.array_distinct(names))


def extract_calls(files: DataFrame) -> DataFrame:
    """Distinct called names of each function, one row each."""
    fns = extract_functions(
        files, ["name"], {"calls": lambda b: call_names(F.col("lang"), b.skeleton)}
    )
    return fns.select(
        "file_id", "fn_id", "lang", F.col("name").alias("function"),
        F.explode("calls").alias("name"),
    )


def extract_python_calls(files: DataFrame) -> DataFrame:
    """Every Python call with object, kind, line and argument counts."""
    fns = extract_functions(
        files.where(F.col("lang") == "python"),
        ["name", "skeleton", "first_line"],
    )
    # Only what the walk reads and the result holds goes through it.
    found = fns.select("file_id", "fn_id", "name", P.called(F.col("skeleton"), F.col("first_line")).alias("calls"))
    return found.select(
        "file_id", "fn_id", F.col("name").alias("function"), F.explode("calls").alias("c")
    ).select("file_id", "fn_id", "function", "c.*")


def extract_imports(files: DataFrame) -> DataFrame:
    """Import records; columns a language does not have are null."""
    blank = F.lit(None).cast("string")

    def record(r: Column, kind: Column, module: Column = blank, name=blank, alias=blank) -> Column:
        return F.struct(
            r.line_number.alias("line_number"),
            kind.alias("kind"),
            module.alias("module"),
            name.alias("name"),
            alias.alias("alias"),
            r.statement.alias("statement"),
        )

    found = bind(
        unix_newlines(F.col("content")),
        lambda t: _by_language(
            F.col("lang"),
            F.transform(
                P.python_imports(t), lambda r: record(r, r.kind, r.module, r["name"], r["alias"])
            ),
            F.transform(B.js_imports(t), lambda r: record(r, r.kind, r.module)),
            F.transform(
                B.c_includes(t),
                lambda r: record(
                    r, F.lit("include"), F.regexp_extract(r.statement, r"[<\"]([^>\"]+)[>\"]", 1)
                ),
            ),
        ),
    )
    return files.select("file_id", "path", "lang", F.explode(found).alias("i")).select(
        "file_id", "path", "lang", "i.*"
    )


def hint_includes(files: DataFrame) -> DataFrame:
    """Per C file up to five of the first fifty lines that name a common header."""
    from .. import dims

    lines = F.slice(F.split(unix_newlines(F.col("content")), "\n"), 1, 50)
    plain = [h for h in dims.HINT_HEADERS if not h.endswith("/")]
    folder = [h for h in dims.HINT_HEADERS if h.endswith("/")]

    def times(line: Column) -> Column:
        # A line that names both sorts is listed once for each.
        hits = [F.lit(False), F.lit(False)]
        for n, names in enumerate((plain, folder)):
            for h in names:
                hits[n] = hits[n] | line.contains(h)
        return F.flatten(
            F.array(
                F.when(hits[0], F.array(F.trim(line))).otherwise(F.expr(_NO_STRINGS)),
                F.when(hits[1], F.array(F.trim(line))).otherwise(F.expr(_NO_STRINGS)),
            )
        )

    hints = F.slice(F.flatten(F.transform(lines, times)), 1, MAX_IMPORTS)
    return files.where(F.col("lang") == "c").select("file_id", "path", hints.alias("hints"))


def build_contexts(files: DataFrame) -> DataFrame:
    """Function, its code, five imports and ten called names, without a join."""
    fns = extract_functions(
        files,
        ["name", "line_number", "code"],
        {
            "dependencies": lambda b: F.slice(
                call_names(F.col("lang"), b.skeleton), 1, MAX_DEPENDENCIES
            )
        },
        with_imports=True,
    )
    return fns.withColumnsRenamed({"name": "function_name", "code": "function_code"})


def parse_quality(files: DataFrame) -> DataFrame:
    """How far each file reads: lines, brackets left open, and the first line where its structure breaks.

    ``error_line`` is null for a sound file; ``n_kept`` counts the lines before it, all if there is none.  The
    functions that start before and from that line on show what the extraction still finds behind it.
    """

    # Two steps: nested in one expression, they would take the analyzer too many rounds.
    read = _with_spans(files, "file_id", "path", "lang").select(
        "file_id", "path",
        F.size(F.split("_text", "\n")).alias("n_lines"),
        structure_of(F.col("lang"), F.col("_skeleton")).alias("s"),
        F.col("_spans.line_number").alias("starts"),
    )
    behind = F.size(F.filter("starts", lambda n: F.coalesce(n >= F.col("s.error_line"), F.lit(False))))
    return read.select(
        "file_id", "path", "n_lines", F.col("s.net").alias("n_unbalanced"), "s.error_line",
        F.coalesce(F.col("s.error_line") - 1, "n_lines").alias("n_kept"),
        (F.size("starts") - behind).alias("functions_before"), behind.alias("functions_after"),
    )
