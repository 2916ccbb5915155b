"""Row-local lexing: literal blanking, bracket folds and small helpers.

A source file is one row, so everything here is a column expression over that
row's text.  Nothing is exploded to lines and shuffled back together: the scan
stays narrow from the file read to the findings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import bind, pair, pair_index, plain, running_text

# Control characters used as marks inside skeleton text (never valid in source).
LIT_OPEN, LIT_CLOSE = "\x01", "\x02"
#: A literal that interpolates, and an interpolation in one.
CODED_OPEN, CODED_CLOSE, PART_OPEN, PART_CLOSE = "\x1a", "\x1b", "\x1c", "\x1d"
HEAD, FN_OPEN, FN_CLOSE, FIELD = "\x04", "\x05", "\x06", "\x07"
# A directive that opens a conditional part, begins its next branch or ends it.
IF, ELSE, ENDIF = "\x0e", "\x0f", "\x10"
BRANCHES = f"[{IF}-{ENDIF}]"
MARKS = "[\x01-\x08\x0e-\x1f\ue000-\uf8ff]"

# No pattern repeats a group over file-sized text: Java's matcher recurses for
# such groups and would overflow the stack on long literals.  Each pattern
# starts with its possible first characters, so other text is skipped quickly.
_PY_PREFIXED = r"(?<=(?<!\w)(?:[fF]|[fF][rR]|[rR][fF]))"
_PY_LITERAL = (
    r"""(?=["'#])(?:(\"{3})((?s:.*?))\"{3}|('{3})((?s:.*?))'{3}"""
    rf"""|{_PY_PREFIXED}(?:(")([^"\n]*+)"|(')([^'\n]*+)')"""
    r"""|(")[^"\n]*+"|(')[^'\n]*+'|#[^\n]*+)"""
)
# From the quotes back to the prefix, as quotes are rarer than letters.
_PY_LONG_CODED = r"""(?=["'])(?:\"{3}|'{3})(?<=\b(?:[fF][rR]?|[rR][fF])(?:\"{3}|'{3}))"""
_C_LITERAL = r"""(?=["'/])(?:(")[^"\n]*+"|(')[^'\n]*+'|/\*((?s:.*?))\*/|//[^\n]*+)"""
_JS_LITERAL = (
    r"""(?=["'/`])(?:(")[^"\n]*+"|(')[^'\n]*+'|/\*((?s:.*?))\*/|//[^\n]*+|`([^`]*+)`)"""
)


# A directive with the lines that a backslash adds to it; their line breaks stay.
_DIRECTIVE = rf"(?m)^({BRANCHES}?)[ \t]*+#[^\n]*+|\G(?<=\\)(\n)[^\n]*+"
_CONDITIONS = [("if", IF), ("el", ELSE), ("endif", ENDIF)]
_ATTRIBUTE = r"__attribute__\s*" + pair("a", r"[^\n]")


def unix_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def bracket_balance(text: Column, brackets: str = "()[]{}") -> Column:
    """Opening less closing brackets of a short text."""
    only = F.regexp_replace(text, "[^" + re.escape(brackets) + "]+", "")
    return bind(
        only,
        lambda b: F.when(b.isin("", "()", "[]", "{}", "()()"), 0).otherwise(
            F.length(F.translate(b, brackets[1::2], ""))
            - F.length(F.translate(b, brackets[0::2], ""))
        ),
    )


def pulled_up(text: Column, pattern: str) -> Column:
    """Statements over several lines repeated in one, before their first line.

    ``pattern`` has three groups: what stands before the list, the list, what ends it.  The copy
    ends with a mark; the statement itself stays behind it, so that lines keep their numbers.
    Two passes over the texts that hold such a statement, whatever their number.
    """
    copied = F.regexp_replace(text, pattern, f"{HEAD}$1$2$3{FIELD}$2$3")
    flat = F.regexp_replace(copied, f"(?:{HEAD}|\\G(?<=\n))([^\n{FIELD}]*+)(?:\n|({FIELD}))", "$1 $2")
    return F.when(text.contains("import") & text.rlike(pattern), flat).otherwise(text)


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def _without_escapes(text: Column) -> Column:
    """Blank backslash pairs, so that a quote in the text always ends a literal."""
    return F.regexp_replace(text, rf"(?=[\\{MARKS[1:]})(?:{MARKS}|\\.)", " ")


def _blank_marked(text: Column, keep_close: bool) -> Column:
    """Drop what stands between literal marks, but keep its line breaks."""
    tail = f"(\\n|{LIT_CLOSE})" if keep_close else f"(?:(\\n)|{LIT_CLOSE})"
    pattern = f"(?:{LIT_OPEN}|\\G(?<=\\n))[^\\n{LIT_CLOSE}]*+{tail}"
    return bind(
        F.replace(text, F.lit(LIT_OPEN + LIT_CLOSE), F.lit("")),
        lambda t: F.when(t.contains(LIT_OPEN), F.regexp_replace(t, pattern, "$1")).otherwise(t),
    )


# --- literals that hold code ---------------------------------------------------------
#
# Most interpolations hold no quotes, braces or formats: two passes take them out of their literals.  Texts
# with others are read by a fold.
#
# A stack of modes tells what a token is: text of a literal, a comment, or code, outside or inside an
# interpolation.  Modes are named by what ends them: a quote ("f" before it if braces interpolate),
# "#" or "//" (the line's end), "/*", ":" (a format, ended by the interpolation's brace), and an
# opening bracket inside an interpolation.  An empty stack is code outside all of them.

_MODES = "named_struct('stack', cast(array() as array<string>), 'prev', '')"
_PY_TOKENS = r"""(\"{3}|'{3}|["'#{}()\[\]:\n]|[^"'#{}()\[\]:\n]++)"""
_PY_PREFIX = r"(?:^|\W)(?:[fF][rR]?|[rR][fF])$"
_JS_TOKENS = r"""(/\*|\*/|//|\$\{|["'`{}\n]|[^"'`{}\n/*$]++|[/*$])"""


def _interpolated(text: Column, pattern: str, starts: str, rule) -> Column:
    """One fold over the tokens; ``rule(t, top, below, prev)`` says what a token does and leaves.

    Outside of literals and comments only tokens that match ``starts`` do something.  The action is "push:" and a mode, "pop", "pop2" or "".
    """

    def step(s: Column, t: Column) -> Column:
        n = F.size(s.stack)
        top, below = F.coalesce(F.get(s.stack, n - 1), F.lit("")), F.coalesce(F.get(s.stack, n - 2), F.lit(""))
        acted = bind(
            rule(t, top, below, s.prev),
            lambda r: F.struct(
                F.struct(
                    F.when(r["do"].startswith("push:"), F.array_append(s.stack, F.substring(r["do"], 6, 9)))
                    .when(r["do"] == "pop", F.slice(s.stack, 1, n - 1))
                    .when(r["do"] == "pop2", F.slice(s.stack, 1, n - 2))
                    .otherwise(s.stack)
                    .alias("stack"),
                    t.alias("prev"),
                ).alias("state"),
                r.out.alias("out"),
            ),
        )
        # Code outside of literals is most of a text and stays as it is.
        idle = (n == 0) & ~t.rlike(starts)
        as_is = F.struct(F.struct(s.stack.alias("stack"), t.alias("prev")).alias("state"), t.alias("out"))
        return F.when(idle, as_is).otherwise(acted)

    return running_text(F.regexp_extract_all(text, F.lit(pattern)), F.expr(_MODES), step)


def _does(do: str | Column, out: str | Column) -> Column:
    return F.struct(
        (F.lit(do) if isinstance(do, str) else do).alias("do"), (F.lit(out) if isinstance(out, str) else out).alias("out")
    )


def _python_rule(t: Column, top: Column, below: Column, prev: Column) -> Column:
    quote = t.isin('"', "'", '"""', "'''")
    line_end = t == "\n"
    end = F.regexp_replace(top, "^f", "")
    # Three quotes end a literal of one: the other two are an empty one.
    ends = quote & ((t == end) | ((F.length(end) == 1) & t.startswith(end)))
    in_text = top.rlike("^f?[\"']")
    # Lines inside a long literal are marked, so that no code in them looks like a statement.
    text_line = F.when(F.length(end) == 3, "\n" + LIT_CLOSE).otherwise("\n")
    close = F.when(F.length(end) == 3, LIT_CLOSE).otherwise("")
    inside = top != ""
    return (
        F.when(top == "#", F.when(line_end, _does("pop", t)).otherwise(_does("", "")))
        .when(
            in_text,
            F.when(ends, _does("pop", close))
            .when(line_end & (F.length(end) == 1), _does("pop", t))
            .when(line_end, _does("", text_line))
            .when((t == "{") & top.startswith("f"), _does("push:{", t))
            .otherwise(_does("", "")),
        )
        .when(
            top == ":",
            F.when(t == "{", _does("push:{", t)).when(t == "}", _does("pop2", t)).otherwise(_does("", "")),
        )
        .when(quote, _does(F.concat(F.lit("push:"), F.when(prev.rlike(_PY_PREFIX), F.lit("f")).otherwise(""), t), t))
        .when(t == "#", _does("push:#", ""))
        # A second brace right after the first was no interpolation.
        .when((t == "{") & (top == "{") & (prev == "{") & below.startswith("f"), _does("pop", "}"))
        .when(inside & t.isin("{", "(", "["), _does(F.concat(F.lit("push:"), t), t))
        .when(
            ((t == "}") & (top == "{")) | ((t == ")") & (top == "(")) | ((t == "]") & (top == "[")), _does("pop", t)
        )
        .when((t == ":") & (top == "{") & below.rlike("^(?:f|:)"), _does("push::", ""))
        .otherwise(_does("", t))
    )


def _js_rule(t: Column, top: Column, below: Column, prev: Column) -> Column:
    line_end = t == "\n"
    kept = F.when(line_end, t).otherwise("")
    return (
        F.when(top == "`", F.when(t == "`", _does("pop", "")).when(t == "${", _does("push:{", " +(")).otherwise(_does("", kept)))
        .when(top.isin('"', "'"), F.when((t == top) | line_end, _does("pop", kept)).otherwise(_does("", "")))
        .when(top == "/*", F.when(t == "*/", _does("pop", "")).otherwise(_does("", kept)))
        .when(top == "//", F.when(line_end, _does("pop", t)).otherwise(_does("", "")))
        .when(t.isin("`", "/*", "//"), _does(F.concat(F.lit("push:"), t), ""))
        .when(t.isin('"', "'"), _does(F.concat(F.lit("push:"), t), t))
        .when((top != "") & t.isin("{", "${"), _does("push:{", t))
        .when((t == "}") & (top == "{"), _does("pop", F.when(below == "`", ")").otherwise(t)))
        .otherwise(_does("", t))
    )


def python_skeleton(text: Column) -> Column:
    """Code without comments and literal contents, line for line.

    A literal leaves its opening quotes, and the code that it interpolates in braces.  A triple-quoted one
    also leaves a close mark, so a line that *starts* with the mark goes on with or ends a longer literal.
    """

    def read(p: Column) -> Column:
        return F.coalesce(p.simple, F.when(p.bare.isNotNull(), _interpolated(p.bare, _PY_TOKENS, "[\"'#]", _python_rule)))

    return bind(python_parts(text), read)


def python_parts(text: Column) -> Column:
    """``struct(bare, simple)``: the text without escapes, and its skeleton if passes over the text give it, else null."""

    def blanked(t: Column) -> Column:
        marked = F.regexp_replace(
            t, _PY_LITERAL, f"$1$3$5$7$9$10{LIT_OPEN}$2$4{LIT_CLOSE}{CODED_OPEN}$6$8{CODED_CLOSE}"
        )
        simple = _without_coded(_blank_marked(F.replace(marked, F.lit(CODED_OPEN + CODED_CLOSE), F.lit("")), True), _PY_PART)
        long = t.rlike(_PY_LONG_CODED)
        # What two passes can't take out of a literal still has its mark.
        return _parts(t, F.when(~long, bind(simple, lambda x: F.when(~x.contains(CODED_OPEN), x))))

    return bind(_without_escapes(text), blanked)


def _parts(bare: Column, simple: Column) -> Column:
    return F.struct(bare.alias("bare"), simple.alias("simple"))


#: Interpolations that can be taken out as they are.
_PY_PART = r"\{[^{}\"'#:!\n\x1b]++\}"
_JS_PART = rf"{PART_OPEN}[^{PART_CLOSE}]*+{PART_CLOSE}"


def _without_coded(text: Column, part: str) -> Column:
    """Literals between coded marks as the parts and line breaks in them."""
    inside = rf"(?:{CODED_OPEN}|\G(?<=[\n}}{PART_CLOSE}]))[^\n{{{PART_OPEN}{CODED_CLOSE}]*+(?:(\n|{part})|{CODED_CLOSE})"
    return bind(text, lambda t: F.when(t.contains(CODED_OPEN), F.regexp_replace(t, inside, "$1")).otherwise(t))


def c_skeleton(text: Column) -> Column:
    """C code without literals, comments, directives and attributes; branches leave their marks."""
    marked = F.regexp_replace(
        _without_escapes(text), _C_LITERAL, f"$1$2{LIT_OPEN}$3{LIT_CLOSE}"
    )

    def told(t: Column) -> Column:
        out = t
        for word, mark in _CONDITIONS:
            out = F.regexp_replace(out, rf"(?m)^([ \t]*+#[ \t]*+{word})", f"{mark}$1")
        return F.when(t.contains("#") & t.rlike(r"#[ \t]*+(?:if|el|endif)"), out).otherwise(t)

    return bind(
        F.regexp_replace(bind(_blank_marked(marked, False), told), _DIRECTIVE, "$1$2"),
        lambda t: F.when(
            t.contains("__attribute__"),
            plain(F.regexp_replace(pair_index(t), _ATTRIBUTE, "")),
        ).otherwise(t),
    )


def js_skeleton(text: Column) -> Column:
    """JavaScript without comments and literals; plain strings leave a quote, templates their code."""

    def read(p: Column) -> Column:
        return F.coalesce(p.simple, F.when(p.bare.isNotNull(), _interpolated(p.bare, _JS_TOKENS, "[\"'`]|/[*/]", _js_rule)))

    return bind(js_parts(text), read)


def js_parts(text: Column) -> Column:
    """As :func:`python_parts`."""

    def blanked(t: Column) -> Column:
        parted = F.regexp_replace(t, r"\$\{([^`{}\"'\n]*+)\}", f"{PART_OPEN}$1{PART_CLOSE}")
        return bind(
            F.when(t.contains("${"), parted).otherwise(t), lambda x: _parts(t, F.when(~x.contains("${"), simple(x)))
        )

    def simple(t: Column) -> Column:
        coded = f"{CODED_OPEN}$4{CODED_CLOSE}"
        marked = F.regexp_replace(t, _JS_LITERAL, f"$1$2{LIT_OPEN}$3{LIT_CLOSE}{coded}")
        kept = _without_coded(_blank_marked(F.replace(marked, F.lit(CODED_OPEN + CODED_CLOSE), F.lit("")), False), _JS_PART)
        opened = F.replace(kept, F.lit(PART_OPEN), F.lit(" +("))
        return F.replace(opened, F.lit(PART_CLOSE), F.lit(")"))

    return bind(_without_escapes(text), blanked)


def split_top_level(text: Column) -> Column:
    """Split a parameter list at the commas outside every bracket and literal.

    Only ever applied to one signature, so the fold is short.
    """
    tokens = F.regexp_extract_all(
        text,
        F.lit(
            r"""("(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|#[^\n]*+|=>|[\[\](){}<>,]|[^\[\](){}<>,"'#=]++|[="'])"""
        ),
    )
    zero = F.expr("named_struct('depth', 0, 'cur', '', 'out', cast(array() as array<string>))")

    def step(s: Column, t: Column) -> Column:
        cut = (t == ",") & (s.depth == 0)
        return F.struct(
            F.when(t.isin("(", "[", "{", "<"), s.depth + 1)
            .when(t.isin(")", "]", "}", ">"), F.greatest(s.depth - 1, F.lit(0)))
            .otherwise(s.depth)
            .alias("depth"),
            F.when(cut, F.lit(""))
            .when(t.startswith("#"), s.cur)
            .otherwise(F.concat(s.cur, t))
            .alias("cur"),
            F.when(cut, F.array_append(s.out, s.cur)).otherwise(s.out).alias("out"),
        )

    pieces = F.aggregate(tokens, zero, step, lambda s: F.array_append(s.out, s.cur))
    trimmed = F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(trimmed, lambda p: p != "")
