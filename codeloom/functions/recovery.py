"""Where the structure of a file first breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import bind
from .lexing import ELSE, ENDIF, IF, c_skeleton, js_skeleton, python_skeleton
from .walks import balance_of

_OPENER = "struct<bracket:string,line:int>"
_ZERO = (
    f"named_struct('line', 1, 'net', 0, 'error', cast(null as int), 'stack', cast(array() as array<{_OPENER}>),"
    f" 'branches', cast(array() as array<struct<net:int,change:int,stack:array<{_OPENER}>,after:array<{_OPENER}>>>))"
)
_END = "\x19"
#: A line that no bracket holds: a Python header, or a typed C header in the first column.
_HEADS = {
    "python": r"(?m)^[ \t]*+(?:async[ \t]+def|def|class)[ \t]+\w+",
    "c": r"(?m)^(?!(?:return|else|case|goto|typedef)\b)[A-Za-z_][\w \t*]*[ \t*]\w+[ \t]*\((?=[^;{}]*\{)",
}
#: The brace of a linkage block, which may hold functions.
_LINKAGE = "\x1a"
_TOKENS = "(\n+|[\x04\x1a(){}\\[\\]" + IF + ELSE + ENDIF + "])"


def _bare(skeleton: Column, head: str | None) -> Column:
    """What a scan reads: brackets, marks of headers, linkage and branches, line breaks."""
    text = skeleton if head is None else F.regexp_replace(skeleton, f"({head})", "\x04$1")
    text = F.regexp_replace(text, r"\bextern\s+\"\s*\{", _LINKAGE)
    return F.regexp_replace(text, "[^\n\x04\x1a(){}\\[\\]" + IF + ELSE + ENDIF + "]+", "")


def _scan(skeleton: Column, counted: str, head: str | None) -> Column:
    """``struct(net, error_line)`` by one fold over brackets, headers and branches, with a stack.

    A closing bracket that does not fit breaks the structure on its line; one that is never closed,
    which the next header or the end of the text tells, on the line where it opens.  The scan then goes on
    from there with an empty stack.  Branches of a directive start from one state.
    """
    tokens = F.array_append(F.regexp_extract_all(_bare(skeleton, head), F.lit(_TOKENS)), F.lit(_END))

    def step(s: Column, t: Column) -> Column:
        n = F.size(s.stack)
        top = F.get(s.stack, n - 1)
        opens, closes = t.isin("(", "[", "{", _LINKAGE), t.isin(")", "]", "}")
        fits = F.coalesce(
            top.bracket.isin("{", _LINKAGE) & (t == "}")
            | (top.bracket == F.when(t == ")", "(").when(t == "]", "[").otherwise("")),
            F.lit(False),
        )
        restarts = ((t == _END) | ((t == "\x04") & F.coalesce(top.bracket != _LINKAGE, F.lit(False)))) & (n > 0)
        error = F.when(closes & ~fits, s.line).when(restarts, top.line)
        part = F.get(s.branches, F.size(s.branches) - 1)
        branched = F.size(s.branches) > 0
        change = s.net - part.net
        larger = F.abs(change) > F.abs(part.change)
        rest = F.slice(s.branches, 1, F.greatest(F.size(s.branches) - 1, F.lit(0)))
        best = F.struct(
            part.net.alias("net"), F.when(larger, change).otherwise(part.change).alias("change"), part.stack.alias("stack"),
            F.when(larger, s.stack).otherwise(part.after).alias("after"),
        )
        started = F.struct(s.net.alias("net"), F.lit(0).alias("change"), s.stack.alias("stack"), s.stack.alias("after"))
        none = F.expr(f"cast(array() as array<{_OPENER}>)")
        side = F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(
            F.when(t.startswith("\n"), s.line + F.length(t)).otherwise(s.line).alias("line"),
            F.when((t == ELSE) & branched, part.net)
            .when((t == ENDIF) & branched, part.net + best.change)
            .when(t.isin(*counted, _LINKAGE), s.net + side)
            .otherwise(s.net)
            .alias("net"),
            F.coalesce(s.error, error).cast("int").alias("error"),
            F.when(opens, F.array_append(s.stack, F.struct(t.alias("bracket"), s.line.alias("line"))))
            .when(closes, F.when(fits, F.slice(s.stack, 1, n - 1)).otherwise(s.stack))
            .when(restarts, none)
            .when((t == ELSE) & branched, part.stack)
            .when((t == ENDIF) & branched, best.after)
            .otherwise(s.stack)
            .alias("stack"),
            F.when(t == IF, F.array_append(s.branches, started))
            .when((t == ELSE) & branched, F.array_append(rest, best))
            .when((t == ENDIF) & branched, rest)
            .otherwise(s.branches)
            .alias("branches"),
        )

    return F.aggregate(
        tokens, F.expr(_ZERO), step, lambda s: F.struct(s.net.alias("net"), s.error.alias("error_line"))
    )


def structure_of(lang: Column, skeleton: Column) -> Column:
    """As :func:`structure`, of a file's skeleton and by a walk; the arguments must be columns of a table."""
    bare = (
        F.when(lang == "python", _bare(skeleton, _HEADS["python"]))
        .when(lang == "javascript", _bare(skeleton, None))
        .when(lang == "c", _bare(skeleton, _HEADS["c"]))
    )
    return balance_of(lang, bare)


def structure(lang: Column, text: Column) -> Column:
    """``struct(net, error_line)`` of a file: brackets left open, and the first broken line or null."""

    def of(skeleton: Column, counted: str, head: str | None = None) -> Column:
        return bind(skeleton, lambda skel: _scan(skel, counted, head))

    return (
        F.when(lang == "python", of(python_skeleton(text), "()[]{}", _HEADS["python"]))
        .when(lang == "javascript", of(js_skeleton(text), "{}"))
        .when(lang == "c", of(c_skeleton(text), "{}", _HEADS["c"]))
    )
