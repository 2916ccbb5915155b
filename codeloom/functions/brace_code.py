"""Lexical extraction from C and JavaScript/TypeScript text.

Parentheses are indexed first, so that a header finds the end of its parameters however deep they
nest.  Headers are then marked inside the skeleton by regular expressions (one pass per form, in
compiled JVM code); one walk over the few structural tokens that are left (marks, braces, conditional
directives, line breaks) pairs the braces.  A scan takes them by ``spans.py``; ``c_blocks`` and ``js_blocks`` do it
by a fold, as one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import CLOSE, OPEN, bind, chosen, pair, pair_index, plain, running_rows, running_text, same_pair
from .lexing import (
    BRANCHES,
    ELSE,
    ENDIF,
    FIELD,
    FN_CLOSE,
    FN_OPEN,
    HEAD,
    IF,
    c_skeleton,
    js_skeleton,
    line_slice,
    lines_of,
    pulled_up,
    split_top_level,
)
from .spans import given

_MARKED = f"{FN_OPEN}([^{FN_CLOSE}]*+){FN_CLOSE}"
_NESTED_MARK = f"{FN_OPEN}[^{FN_OPEN}{FN_CLOSE}]*+{FN_OPEN}"
#: The token behind the last one.
_END = "\x19"
_STRUCTURE = f"(\\n+|[{{}}{HEAD}{FN_OPEN}{IF}{ELSE}{ENDIF}])"
_SPAN = (
    "struct<line_number:int,end_line:int,name:string,kind:string,params:string,"
    "result:string,depth:int>"
)
_ZERO = (
    "named_struct('line', 1, 'depth', 0, 'head', 1, 'seen', 0,"
    f" 'open', cast(array() as array<{_SPAN}>),"
    " 'branches', cast(array() as array<struct<depth:int,change:int>>))"
)


def _mark(kind: str, name: str, params: str = "", result: str = "") -> str:
    return FN_OPEN + FIELD.join([kind, name, params, result]) + FN_CLOSE


def _unnested(marked: Column) -> Column:
    """Without the marks that stand inside others: those of functions in a parameter's default."""

    def step(depth: Column, t: Column) -> Column:
        after = F.when(t == FN_OPEN, depth + 1).when(t == FN_CLOSE, depth - 1).otherwise(depth)
        out = F.when(F.greatest(depth, after) > 1, "").otherwise(t)
        return F.struct(after.alias("state"), out.alias("out"))

    tokens = F.regexp_extract_all(marked, F.lit(f"([{FN_OPEN}{FN_CLOSE}]|[^{FN_OPEN}{FN_CLOSE}]++)"))
    return running_text(tokens, F.lit(0), step)


def _outer(marked: Column) -> Column:
    return bind(marked, lambda m: F.when(m.rlike(_NESTED_MARK), _unnested(m)).otherwise(m))


def _spans(marked: Column, nested: bool) -> Column:
    """As :func:`_paired`, with the marking done once."""
    return bind(_outer(marked), lambda text: _paired(text, nested))


def _paired(outer: Column, nested: bool) -> Column:
    """Pair the braces of each marked header: ``spans.brace_spans`` as a column expression.

    ``nested`` is false for C, where a function may only start outside all braces; a typed header in the
    first column starts one all the same, so that a lost brace does not hide the rest of the file.
    Every branch of a conditional directive starts at the depth before it, and the depth after it is that
    of the branch that changed it most.  Blocks still open at the end of the text, or at such a header,
    end there, which a negative line tells.
    """

    # What the marks say, in order; the fold then runs over bare structure only.
    heads = F.transform(
        F.regexp_extract_all(outer, F.lit(_MARKED)),
        lambda m: bind(
            F.split(F.regexp_replace(plain(m), f"[{HEAD}{IF}-{ENDIF}]", ""), FIELD),
            lambda part: F.struct(
                F.get(part, F.lit(0)).alias("kind"),
                F.get(part, F.lit(1)).alias("name"),
                F.get(part, F.lit(2)).alias("params"),
                F.get(part, F.lit(3)).alias("result"),
            ),
        ),
    )
    bare = F.regexp_replace(
        F.regexp_replace(outer, _MARKED, FN_OPEN), f"[^\\n{{}}{HEAD}{FN_OPEN}{IF}{ELSE}{ENDIF}]+", ""
    )
    tokens = F.array_append(F.regexp_extract_all(bare, F.lit(_STRUCTURE)), F.lit(_END))

    def step(s: Column, t: Column, mark: Column) -> Column:
        kind = mark.kind
        enclosing = F.get(s.open, F.size(s.open) - 1)
        in_class = F.coalesce(
            (enclosing.kind == "class") & (enclosing.depth == s.depth - 1), F.lit(False)
        )
        starts = t == FN_OPEN
        lost = starts & (s.depth > 0) & mark.result.rlike(r"^\w") & F.lit(not nested)
        new = F.struct(
            F.when(kind == "class", s.line).otherwise(s["head"]).alias("line_number"),
            s.line.alias("end_line"),
            mark["name"].alias("name"),
            F.when((kind == "method") & ~in_class, "property_method")
            .otherwise(kind)
            .alias("kind"),
            mark.params.alias("params"),
            mark.result.alias("result"),
            F.when(lost, 0).otherwise(s.depth).alias("depth"),
        )
        one_line = starts & (kind == "line_arrow")
        pushes = starts & ~one_line if nested else starts & ((s.depth == 0) | lost)
        closes = (t == "}") & F.coalesce(enclosing.depth >= s.depth - 1, F.lit(False))
        part = F.get(s.branches, F.size(s.branches) - 1)
        change = s.depth - part.depth
        change = F.when(F.abs(change) > F.abs(part.change), change).otherwise(part.change)
        rest = F.slice(s.branches, 1, F.greatest(F.size(s.branches) - 1, F.lit(0)))
        branched = F.size(s.branches) > 0

        def ended(which, line: Column) -> Column:
            return F.transform(F.filter(s.open, which), lambda o: o.withField("end_line", line))

        state = F.struct(
            s.line.alias("line"),
            F.when(t == "}", F.greatest(s.depth - 1, F.lit(0)))
            .when((t == ELSE) & branched, part.depth)
            .when((t == ENDIF) & branched, part.depth + change)
            .when(lost, 0)
            .otherwise(s.depth)
            .alias("depth"),
            s["head"].alias("head"),
            F.when(starts, s.seen + 1).otherwise(s.seen).alias("seen"),
            F.when(lost, F.array(new))
            .when(pushes, F.array_append(s.open, new))
            .when(closes, F.filter(s.open, lambda o: o.depth < s.depth - 1))
            .otherwise(s.open)
            .alias("open"),
            F.when(t == IF, F.array_append(s.branches, F.struct(s.depth.alias("depth"), F.lit(0).alias("change"))))
            .when((t == ELSE) & branched, F.array_append(rest, F.struct(part.depth.alias("depth"), change.alias("change"))))
            .when((t == ENDIF) & branched, rest)
            .otherwise(s.branches)
            .alias("branches"),
        )
        out = (
            F.when(one_line, F.array(new))
            .when(closes, ended(lambda o: o.depth >= s.depth - 1, s.line))
            .when(lost, ended(lambda o: o.depth >= 0, 1 - s["head"]))
            .when(t == _END, ended(lambda o: o.depth >= 0, -s.line))
        )

        def moved(line: Column = s.line, depth: Column = s.depth, head: Column = s["head"]) -> Column:
            after = F.struct(
                line.alias("line"), depth.alias("depth"), head.alias("head"), s.seen.alias("seen"), s.open.alias("open"),
                s.branches.alias("branches"),
            )
            return F.struct(after.alias("state"), F.lit(None).cast(f"array<{_SPAN}>").alias("out"))

        # Most tokens only move on.
        return (
            F.when(t.startswith("\n"), moved(line=s.line + F.length(t)))
            .when(t == "{", moved(depth=s.depth + 1))
            .when(t == HEAD, moved(head=s.line))
            .otherwise(F.struct(state.alias("state"), out.alias("out")))
        )

    closed = bind(
        heads,
        lambda mark_of: running_rows(
            tokens, F.expr(_ZERO), lambda s, t: bind(F.get(mark_of, s.seen), lambda mark: step(s, t, mark)), _SPAN
        ),
    )
    return F.array_sort(F.filter(closed, lambda o: o.kind != "class"))


def _blocks(text: Column, skel: Column, spans: Column, code, needed: frozenset[str] | None = None) -> Column:
    """``code(lines, span)`` cuts a function out of original or skeleton lines."""

    def block(o: Column, lines: Column, skel_lines: Column) -> Column:
        return chosen(
            needed,
            name=lambda: o["name"],
            full_name=lambda: o["name"],
            kind=lambda: o.kind,
            class_context=lambda: F.lit(None).cast("string"),
            line_number=lambda: o.line_number,
            end_line=lambda: o.end_line,
            decorators=lambda: F.expr("cast(array() as array<string>)"),
            signature=lambda: o.params,
            return_type=lambda: o.result,
            first_line=lambda: o.line_number,
            code=lambda: code(lines, o),
            skeleton=lambda: code(skel_lines, o),
        )

    def lines_if(name: str, whole: Column, body) -> Column:
        return bind(lines_of(whole), body) if needed is None or name in needed else body(whole)

    return lines_if(
        "code", text,
        lambda lines: lines_if(
            "skeleton", skel, lambda skel_lines: F.transform(spans, lambda o: block(o, lines, skel_lines))
        ),
    )


# --------------------------------------------------------------------------
# C
# --------------------------------------------------------------------------

# After a line break, ";" or "}": specifiers, of which one may be a bracketed type, the name, the
# parameters, and declarations of the old style.  Runs of words are character classes, not repeated
# groups, so their number is free.
_C_SPECIFIERS = rf"(?:[A-Za-z_][\w\s*]*?(?:{pair('t', r'[\w\s*]')}[\w\s*]*?)?[\s*])?"
_C_OLD_STYLE = r"(?:[A-Za-z_][\w\s*,\[\]]*+;\s*)*+"
_C_HEAD = (
    rf"(?<![^\n;}}])(?<specifiers>[ \t]*+{_C_SPECIFIERS})(?!(?:if|for|while|switch|return|sizeof|else|do)\b)"
    rf"(?<name>[A-Za-z_]\w*+)(?<space>\s*){pair('a', '[^{};]')}(?<rest>[\s{IF}-{ENDIF}]*+{_C_OLD_STYLE})\{{"
)
_C_MARKED = (
    f"${{specifiers}}{HEAD}${{name}}${{space}}{same_pair('a')}${{rest}}"
    + _mark("function", "${name}", "${at}", "${specifiers}") + "{"
)
_STORAGE = r"\b(?:static|extern|inline|register|__inline__|__inline|_Noreturn)\b"
FALLBACK_LINES = 20


def _c_marked(skel: Column) -> Column:
    return F.regexp_replace(pair_index(skel), _C_HEAD, _C_MARKED)


def c_given(skeleton: Column) -> Column:
    return given(skeleton, _c_marked(skeleton))


def c_found(text: Column, skel: Column, spans: Column, needed: frozenset[str] | None = None) -> Column:
    """Blocks of one C file whose spans are known, with the fields that are needed."""

    def settle(o: Column) -> Column:
        settled = o.withField(
            "end_line",
            F.when(
                o.end_line < 0,
                F.greatest(o.line_number, F.least(-o.end_line, o.line_number + (FALLBACK_LINES - 1))),
            ).otherwise(o.end_line),
        )
        if needed is not None and "return_type" not in needed:
            return settled
        return settled.withField(
            "result",
            F.trim(
                F.regexp_replace(
                    F.regexp_replace(F.regexp_replace(o.result, _STORAGE, " "), r"\s+", " "),
                    r"\s*\*\s*",
                    " *",
                )
            ),
        )

    return _blocks(
        text,
        F.when(skel.rlike(BRANCHES), F.regexp_replace(skel, BRANCHES, "")).otherwise(skel),
        F.transform(spans, settle),
        lambda text_lines, o: line_slice(text_lines, o.line_number, o.end_line),
        needed,
    )


def c_blocks(text: Column) -> Column:
    """Function definitions of one C file; prototypes have no body and drop out.

    An unterminated function keeps the first twenty lines.
    """
    return bind(c_skeleton(text), lambda skel: c_found(text, skel, _spans(_c_marked(skel), nested=False)))


def c_params(signature: Column) -> Column:
    """Named parameters with their type text and pointer/array flags."""

    def describe(p: Column) -> Column:
        fn_pointer = F.regexp_extract(p, r"\(\s*\*\s*(\w+)\s*\)", 1)
        plain = F.regexp_extract(p, r"[\s*](\w+)\s*(?:\[[^\]]*\]\s*)*$", 1)
        name = F.when(fn_pointer != "", fn_pointer).otherwise(plain)
        shape = F.regexp_replace(
            F.when(
                fn_pointer != "", F.regexp_replace(p, r"\(\s*\*\s*\w+\s*\)", "(*)")
            ).otherwise(F.regexp_replace(p, r"([\s*])\w+(\s*(?:\[[^\]]*\]\s*)*)$", "$1$2")),
            r"\s*\*\s*",
            " *",
        )
        kind = F.regexp_replace(F.trim(F.regexp_replace(shape, r"\s+", " ")), r"(?<=[*(]) (?=\*)", "")
        return F.struct(
            name.alias("name"),
            kind.alias("type"),
            kind.contains("*").alias("is_pointer"),
            kind.contains("[").alias("is_array"),
        )

    return F.filter(
        F.transform(split_top_level(F.coalesce(signature, F.lit(""))), describe),
        lambda p: p["name"] != "",
    )


def c_includes(text: Column) -> Column:
    """Every ``#include`` line with its number."""
    numbered = F.transform(
        lines_of(text),
        lambda line, i: F.when(
            line.contains("#include"),
            F.struct((i + 1).alias("line_number"), F.trim(line).alias("statement")),
        ),
    )
    return F.filter(numbered, lambda r: r.statement.startswith("#include"))


_C_NOT_CALLS = ["if", "for", "while", "switch", "return", "sizeof"]


def c_call_names(skeleton: Column) -> Column:
    """Called names in the body, in text order; of ``o->f()`` the member ``f``."""
    body = F.regexp_replace(skeleton, r"^[^{]*\{", "")
    found = F.regexp_extract_all(body, F.lit(r"\b([A-Za-z_]\w*+)\s*\("))
    return F.filter(found, lambda n: ~n.isin(*_C_NOT_CALLS))


# --------------------------------------------------------------------------
# JavaScript / TypeScript
# --------------------------------------------------------------------------

# A mark is never part of a type.
_RET = rf"(?:\s*:\s*[^={{}};(){OPEN}{CLOSE}{FN_OPEN}]*)?"
# Possessive: what follows a name never goes on with one of its characters.
_ID = r"[\w$]++"
_GENERIC = r"(?:<[^<>()]*>)?"
_KEYWORDS = r"(?!(?:if|for|while|switch|catch|function|return|with|do|else|try|new|typeof|await)\b)"
_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*+\*?\s*"
_ANONYMOUS = "anonymous_"


def _arrow(name: str) -> str:
    return rf"(?:{pair(name)}{_RET}|\b{_ID})\s*=>\s*"


def _value(name: str) -> str:
    function = rf"function\b\s*\*?\s*(?:{_ID})?\s*{_GENERIC}\s*{pair(name + 'f')}{_RET}\s*"
    return rf"(?:async\b\s*)?(?:{function}|{_arrow(name + 'a')})"


# What only some texts with an arrow hold: a body in braces or without, behind a bare name or anything.  Each starts
# with the arrow itself, so that a search for it is quick.  An arrow right behind a parenthesis has no bare name.
_BRACED, _UNBRACED = r"=>\s*\{", rf"=>\s*(?![{{\s{FN_OPEN}])"
_BARE = f"(?<!{CLOSE} ?=>)"


# (word the text must hold, what else it must hold or "", pattern up to the opening brace, replacement), applied in this
# order; a marked header is not matched again because the mark stands before its brace.
def _js_forms() -> list[tuple[str, str, str, str]]:
    args, kept = pair("a"), same_pair("a")
    return [
        ("class", "", r"(?=c)(\bclass\b[^{};()\x11\x12]*+)\{", "$1" + _mark("class", "") + "{"),
        (
            "=",
            rf"=\s*(?:async|function|{OPEN}|{_ID}\s*=>)",
            rf"(?=[clv])(\b(?:const|let|var)\s+)(?<n>{_ID})(?<v>\s*(?::[^=;{{}}\n]*)?=\s*{_value('b')})\{{",
            f"$1{HEAD}${{n}}${{v}}" + _mark("variable_function", "${n}") + "{",
        ),
        (
            "=>",
            _UNBRACED,
            rf"(?=[clv])(\b(?:const|let|var)\s+)(?<n>{_ID})(?<v>\s*=\s*(?:async\b\s*)?{_arrow('b')})"
            rf"(?![{{\s{FN_OPEN}])",
            f"$1{HEAD}${{n}}${{v}}" + _mark("line_arrow", "variable_function" + "\x08" + "${n}"),
        ),
        (
            ":",
            rf":\s*(?:async|function|{OPEN}|{_ID}\s*=>)",
            rf"(?=[\w$\"'])(?<n>(?<![\w$]){_ID}|[\"'])(?<v>\s*:\s*{_value('b')})\{{",
            f"{HEAD}${{n}}${{v}}" + _mark("property_method", "${n}") + "{",
        ),
        (
            "function",
            "",
            rf"(?m)(^[ \t]*(?:export\s+(?:default\s+)?)?)(?<w>(?:async\s+)?function\b\s*\*?\s*)(?<n>{_ID})"
            rf"(?<s>\s*{_GENERIC}\s*){args}(?<r>{_RET}\s*)\{{",
            f"$1{HEAD}${{w}}${{n}}${{s}}{kept}${{r}}" + _mark("declaration", "${n}", "${at}") + "{",
        ),
        (
            "function",
            "",
            rf"(?=f)(?<w>\bfunction\b\s*\*?\s*(?:{_ID})?\s*){args}(?<r>{_RET}\s*)\{{",
            f"{HEAD}${{w}}{kept}${{r}}" + _mark("expression", _ANONYMOUS + "expression", "${at}") + "{",
        ),
        (
            "=>",
            _BRACED,
            rf"{args}(?<r>{_RET}\s*=>\s*)\{{",
            f"{HEAD}{kept}${{r}}" + _mark("arrow", _ANONYMOUS + "arrow", "${at}") + "{",
        ),
        (
            "=>",
            _BRACED.replace("=>", f"=>{_BARE}"),
            rf"(?=[\w$])(\b{_ID})(\s*=>\s*)\{{",
            f"{HEAD}$1$2" + _mark("arrow", _ANONYMOUS + "arrow", "$1") + "{",
        ),
        (
            "=>",
            _UNBRACED,
            rf"{args}(?<r>\s*=>\s*)(?![{{\s{FN_OPEN}])",
            f"{HEAD}{kept}${{r}}" + _mark("line_arrow", "arrow\x08" + _ANONYMOUS + "arrow", "${at}"),
        ),
        (
            "=>",
            _UNBRACED.replace("=>", f"=>{_BARE}"),
            rf"(?=[\w$])(\b{_ID})(\s*=>\s*)(?![{{\s{FN_OPEN}])",
            f"{HEAD}$1$2" + _mark("line_arrow", "arrow\x08" + _ANONYMOUS + "arrow", "$1"),
        ),
        (
            "{",
            rf"{CLOSE}{_RET}\s*\{{",
            rf"(?m)^([ \t]*{_MODIFIERS}){_KEYWORDS}(?<n>{_ID})(?<s>\s*{_GENERIC}\s*){args}(?<r>{_RET}\s*)\{{",
            f"$1{HEAD}${{n}}${{s}}{kept}${{r}}" + _mark("method", "${n}", "${at}") + "{",
        ),
    ]


def _marked_if(text: Column, word: str, sure: str, pattern: str, replacement: str) -> Column:
    """Most files lack most forms, and a plain search is cheaper than a pass."""

    def holds(t: Column) -> Column:
        return t.contains(word) & t.rlike(sure) if sure else t.contains(word)

    return bind(text, lambda t: F.when(holds(t), F.regexp_replace(t, pattern, replacement)).otherwise(t))


_START = {
    "declaration": r"((?:async\s+)?function\b.*)$",
    "expression": r"((?:async\s+)?function\b.*)$",
    "variable_function": rf"=\s*((?:async\b\s*)?(?:function\b|[(\x11]|{_ID}\s*=>).*)$",
    "property_method": rf"(?::\s*|(?=[(\x11]))((?:async\b\s*)?(?:function\b|[(\x11]|{_ID}\s*=>).*)$",
    "method": r"([(\x11].*)$",
    "arrow": rf"((?:async\b\s*)?(?:\([^()]*\)|{pair('a')}|\b{_ID})\s*=>.*)$",
}


def _js_code(lines: Column, o: Column) -> Column:
    """Source from the function's own first column to its closing brace."""
    head = F.get(lines, o.line_number - 1)
    cut = None
    for kind, pattern in _START.items():
        here = F.regexp_extract(head, pattern, 1)
        cut = F.when(o.kind == kind, here) if cut is None else cut.when(o.kind == kind, here)
    first = bind(cut, lambda c: F.when(c != "", c).otherwise(head))
    last = F.get(lines, o.end_line - 1)
    tail = F.when(last.contains("}"), F.concat(F.substring_index(last, "}", 1), F.lit("}")))
    tail = tail.otherwise(last)
    middle = F.slice(lines, o.line_number + 1, o.end_line - o.line_number - 1)
    return F.when(
        o.end_line > o.line_number,
        F.array_join(F.concat(F.array(first), middle, F.array(tail)), "\n"),
    ).otherwise(first)


def _js_marked(skel: Column) -> Column:
    marked = skel
    for word, sure, pattern, replacement in _js_forms():
        marked = _marked_if(marked, word, sure, pattern, replacement)
    return marked


# Functions keep the index in their skeletons: it serves their calls, too.
def js_given(skeleton: Column) -> Column:
    return bind(pair_index(skeleton), lambda skel: given(skel, _js_marked(skel)))


def js_found(text: Column, skel: Column, spans: Column, needed: frozenset[str] | None = None) -> Column:
    """Blocks of one JavaScript file whose spans are known, with the fields that are needed."""

    def settle(o: Column) -> Column:
        at = F.instr(o["name"], "\x08")
        return (
            o.withField(
                "kind", F.when(at > 0, F.substring_index(o["name"], "\x08", 1)).otherwise(o.kind)
            )
            .withField(
                "name",
                F.when(o["name"].isin('"', "'"), "anonymous_property").otherwise(
                    F.substring_index(o["name"], "\x08", -1)
                ),
            )
            .withField("end_line", F.abs(o.end_line))
        )

    return _blocks(text, skel, F.transform(spans, settle), _js_code, needed)


def js_blocks(text: Column) -> Column:
    """The six function forms of one JavaScript or TypeScript file.

    An arrow whose body is an expression counts as one line.
    """
    return bind(
        pair_index(js_skeleton(text)), lambda skel: js_found(text, skel, _spans(_js_marked(skel), nested=True))
    )


def js_params(kind: Column, signature: Column) -> Column:
    """Parameter names; patterns and defaults count as ``complex_param``.

    Methods list plain names only; property and variable functions list none.
    """

    def describe(p: Column) -> Column:
        bare = F.trim(F.regexp_replace(p, r"\??\s*:.*$", ""))
        return (
            F.when(p.rlike(r"^[\{\[]") | p.rlike(r"=(?!>)"), "complex_param")
            .when(bare.rlike(rf"^(?:\.\.\.)?\s*{_ID}$"), bare)
            .otherwise("complex_param")
        )

    names = F.transform(split_top_level(F.coalesce(signature, F.lit(""))), describe)
    return (
        F.when(kind.isin("property_method", "variable_function"), F.expr("cast(array() as array<string>)"))
        .when(
            kind == "method",
            F.filter(names, lambda n: (n != "complex_param") & ~n.startswith("...")),
        )
        .otherwise(names)
    )


_JS_IMPORT = r"^\s*import\s+(?:type\s+)?(.+?)\s+from\s+[\"']([^\"']+)[\"']"
_JS_BARE = r"^\s*import\s+[\"']([^\"']+)[\"']"
_JS_REQUIRE = r"\b(?:const|let|var)\s+([\w$]+|\{[^{}=;]*\}|\[[^\[\]=;]*\])[^=;]*=\s*require\(\s*[\"'`]([^\"'`]+)[\"'`]"


_JS_OPEN_IMPORT = (
    r"(?m)^([ \t]*import\s[^{}\n]*\{)([^}\n]*+\n[^}]*+)(\}[^;\"'\n]*[\"'][^\"'\n]*[\"'])"
)


def js_imports(text: Column) -> Column:
    """ES imports and ``require`` calls as canonical statements, in line order."""

    def one(line: Column, i: Column) -> Column:
        def name(p: Column) -> Column:
            pair = F.split(F.trim(p), r"\s+as\s+")
            same = (F.size(pair) == 2) & (F.get(pair, F.lit(0)) == F.get(pair, F.lit(1)))
            return F.when(same, F.get(pair, F.lit(0))).otherwise(F.array_join(pair, " as "))

        listing = F.translate(F.regexp_extract(line, _JS_IMPORT, 1), "{}", "")
        names = F.filter(
            F.transform(F.split(listing, ","), name), lambda n: n != ""
        )
        module = F.regexp_extract(line, _JS_IMPORT, 2)
        bare = F.regexp_extract(line, _JS_BARE, 1)
        var, required = F.regexp_extract(line, _JS_REQUIRE, 1), F.regexp_extract(line, _JS_REQUIRE, 2)
        return F.struct(
            (i + 1).alias("line_number"),
            F.when(module != "", F.lit("import"))
            .when(bare != "", F.lit("bare_import"))
            .when(required != "", F.lit("require"))
            .alias("kind"),
            F.when(module != "", module).when(bare != "", bare).otherwise(required).alias("module"),
            F.when(
                module != "",
                F.concat(
                    F.lit("import {"), F.array_join(names, ", "), F.lit("} from '"), module, F.lit("'")
                ),
            )
            .when(bare != "", F.concat(F.lit("import '"), bare, F.lit("'")))
            .otherwise(
                F.concat(F.lit("const "), var, F.lit(" = require('"), required, F.lit("')"))
            )
            .alias("statement"),
        )

    # A list over several lines counts on its first line.
    joined = F.transform(
        lines_of(pulled_up(text, _JS_OPEN_IMPORT)), lambda line: F.substring_index(line, FIELD, 1)
    )
    hits = F.filter(
        F.transform(joined, lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda r: (r.line.contains("import") & r.line.rlike(r"^\s*import\s"))
        | r.line.contains("require("),
    )
    return F.filter(
        F.transform(hits, lambda r: one(r.line, r.i)), lambda r: r.kind.isNotNull()
    )


_JS_NOT_CALLS = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "async"]


def js_call_names(skeleton: Column) -> Column:
    """Callee or property names of an indexed skeleton, in text order; ``new X()`` is not a call."""
    body = F.regexp_replace(
        skeleton,
        rf"\bfunction\b\s*\*?\s*(?:{_ID})?\s*[({OPEN}]|\bnew\s+[\w$.]+\s*{_GENERIC}\s*[({OPEN}]",
        "(",
    )
    body = F.regexp_replace(
        body, rf"(?m)^[ \t]*{_MODIFIERS}{_KEYWORDS}{_ID}\s*{_GENERIC}\s*{pair('a')}({_RET}\s*\{{)", f"{same_pair('a')}$3"
    )
    found = F.regexp_extract_all(body, F.lit(rf"(?<![\w$])({_ID})\s*[({OPEN}]"))
    return F.filter(found, lambda n: ~n.isin(*_JS_NOT_CALLS))
