"""Where functions begin and end: one walk over a file's marks, braces or lines.

The texts are prepared by column expressions; only the stack machine runs in Python, over whole Arrow columns, as a
fold of column expressions is interpreted anew at every token.  The functions travel inside the tasks.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import CLOSE, OPEN, PAIR_MARK
from .lexing import ELSE, ENDIF, FIELD, FN_CLOSE, FN_OPEN, HEAD, IF

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOUND = (
    "array<struct<line_number:int,end_line:int,name:string,kind:string,class_context:string,params:string,"
    "result:string,first_line:int,decorators:array<string>>>"
)
_HEAD_LINE = re.compile(r"\s*(async\s+def|def|class)\s+(\w+)", re.A)
_DECORATOR = re.compile(r"\s*@\s*([\w.]+)", re.A)
#: What a line with a header can begin with, behind blanks.
_BEFORE_HEAD = frozenset("acd\t\r\f\v")
# A set stands first, by which the search skips other text; only a whole mark goes on.
_TOKENS = re.compile(f"([{{}}{HEAD}{FN_OPEN}{IF}-{ENDIF}](?:(?<={FN_OPEN})[^{FN_CLOSE}]*{FN_CLOSE})?)")
_IN_MARK = re.compile(f"{PAIR_MARK}|[{HEAD}{IF}-{ENDIF}]")
_TYPED = re.compile(r"\w", re.A)


def line_spans(skeleton: str) -> list[tuple]:
    """Functions of a Python skeleton, by one walk over its lines with the stack of open ``def``/``class`` blocks.

    A block ends at the last non-blank line before a logical line that is not
    indented deeper.  Lines inside brackets or literals never end a block, but no bracket holds a
    ``def`` or ``class``: such a line starts anew, so that a lost bracket does not hide the rest.
    """
    done, stack, decorators = [], [], []
    depth = last = decorated_at = 0

    def close(indent: int) -> None:
        while stack and stack[-1][0] >= indent:
            block = stack.pop()
            if block[3] != "class":
                done.append((block[1], last, *block[2:]))

    for n, line in enumerate(skeleton.split("\n"), 1):
        bare = line.lstrip(" ")
        if not bare:
            continue
        first = bare[0]
        goes_on = line[0] == "\x02"
        head = _HEAD_LINE.match(line) if first in _BEFORE_HEAD else None
        if head and not goes_on:
            depth = 0
        if depth == 0 and not goes_on:
            indent = len(line) - len(bare)
            if first == "\t":
                white = line[: len(line) - len(line.lstrip(" \t"))]
                indent = len(white) + 7 * white.count("\t")
            if stack and stack[-1][0] >= indent:
                close(indent)
            if head:
                kind = {"class": "class", "def": "function"}.get(head[1], "async_function")
                classes = ".".join(b[2] for b in stack if b[3] == "class") or None
                stack.append((indent, n, head[2], kind, classes, None, None, decorated_at or n, decorators))
            if first == "@":
                found = _DECORATOR.match(line)
                decorators = [*decorators, found[1] if found else "complex_decorator"]
                decorated_at = decorated_at or n
            elif decorated_at:
                decorators, decorated_at = [], 0
        # Counting six characters takes less than one search for them.
        net = (
            bare.count("(") + bare.count("[") + bare.count("{") - bare.count(")") - bare.count("]") - bare.count("}")
        )
        if net:
            depth = max(depth + net, 0)
        last = n
    close(0)
    return sorted(done, key=lambda s: s[0])


_NESTED_MARK = re.compile(f"{FN_OPEN}[^{FN_OPEN}{FN_CLOSE}]*+{FN_OPEN}")
_MARK_TOKENS = re.compile(f"[{FN_OPEN}{FN_CLOSE}]|[^{FN_OPEN}{FN_CLOSE}]++")


def unnested(marked: str) -> str:
    """Without the marks that stand inside others: those of functions in a parameter's default."""
    if not _NESTED_MARK.search(marked):
        return marked
    out, depth = [], 0
    for t in _MARK_TOKENS.findall(marked):
        after = depth + (t == FN_OPEN) - (t == FN_CLOSE)
        if max(depth, after) <= 1:
            out.append(t)
        depth = after
    return "".join(out)


def brace_spans(marked: str, nested: bool) -> list[tuple]:
    """Pair the braces of each marked header.

    ``nested`` is false for C, where a function may only start outside all braces; a typed header in the
    first column starts one all the same, so that a lost brace does not hide the rest of the file.
    Every branch of a conditional directive starts at the depth before it, and the depth after it is that
    of the branch that changed it most.  Blocks still open at the end of the text, or at such a header,
    end there, which a negative line tells.
    """
    done, stack, branches = [], [], []
    depth, head = 0, 1
    # Text without structure, which only counts lines, and tokens in turn.
    parts = _TOKENS.split(marked)
    line = 1 + parts[0].count("\n")

    def close(least: int, end: int) -> None:
        while stack and stack[-1][0] >= least:
            block_depth, at, *named = stack.pop()
            done.append((at, end, *named, block_depth))

    for t, behind in zip(parts[1::2], parts[2::2], strict=True):
        if t == "{":
            depth += 1
        elif t == "}":
            close(depth - 1, line)
            depth = max(depth - 1, 0)
        elif t == HEAD:
            head = line
        elif t == IF:
            branches.append((depth, 0))
        elif t in (ELSE, ENDIF):
            if branches:
                before, most = branches.pop()
                most = depth - before if abs(depth - before) > abs(most) else most
                depth = before
                if t == ELSE:
                    branches.append((before, most))
                else:
                    depth += most
        elif len(t) > 1:
            said = _IN_MARK.sub("", t[1:-1]).replace(OPEN, "(").replace(CLOSE, ")")
            kind, name, params, result = said.split(FIELD)[:4]
            lost = not nested and depth > 0 and bool(_TYPED.match(result))
            if lost:
                close(0, 1 - head)
            at = line if kind == "class" else head
            if kind == "line_arrow":
                done.append((at, line, name, kind, params, result, depth))
            if kind == "method" and not (stack and stack[-1][3] == "class" and stack[-1][0] == depth - 1):
                kind = "property_method"
            if kind != "line_arrow" if nested else depth == 0 or lost:
                depth = 0 if lost else depth
                stack.append((depth, at, name, kind, params, result))
        line += behind.count("\n")
    close(0, -line)
    found = sorted(s for s in done if s[3] != "class")
    return [(at, end, name, kind, None, params, result, at, ()) for at, end, name, kind, params, result, _ in found]


def _found(lang: pa.Array, walked: pa.Array) -> pa.Array:
    """Spans of each text; null for a null one."""
    rows, offsets, last = [], [], 0
    for language, text in zip(lang.to_pylist(), walked.to_pylist(), strict=True):
        offsets.append(None if text is None else last)
        if text is not None:
            rows += line_spans(text) if language == "python" else brace_spans(unnested(text), language != "c")
            last = len(rows)
    strings, numbers = pa.string(), pa.int32()
    kinds = [numbers, numbers, strings, strings, strings, strings, strings, numbers, pa.list_(strings)]
    names = ["line_number", "end_line", "name", "kind", "class_context", "params", "result", "first_line", "decorators"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    spans = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return pa.ListArray.from_arrays(pa.array([*offsets, last], numbers), spans)


def spans_of(lang: Column, walked: Column) -> Column:
    """The functions of a text: a Python skeleton, or one of C or JavaScript with marked headers.

    The arguments must be columns of a table, not folds: Spark takes no fold as a function's argument.
    """
    # Python reads no text that is not UTF-8.
    return F.arrow_udf(_found, FOUND)(lang, F.make_valid_utf8(walked))


def given(skeleton: Column, walked: Column) -> Column:
    """What a file's spans and blocks are read from."""
    return F.struct(skeleton.alias("skeleton"), walked.alias("walked"))
