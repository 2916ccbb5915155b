"""Lexical extraction from Python text: functions, classes, imports, calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import bind, chosen, pair, pair_index, plain, running_rows
from .lexing import (
    FIELD,
    LIT_CLOSE,
    bracket_balance,
    line_slice,
    lines_of,
    pulled_up,
    python_skeleton,
    split_top_level,
)
from .spans import given
from .walks import calls_of

_SPAN = (
    "struct<line_number:int,end_line:int,name:string,kind:string,class_context:string,"
    "indent:int,first_line:int,decorators:array<string>>"
)
_NO_NAMES = "cast(array() as array<string>)"
_ZERO = (
    f"named_struct('depth', 0, 'last', 0, 'deco', {_NO_NAMES}, 'deco_ln', 0,"
    f" 'open', cast(array() as array<{_SPAN}>))"
)
_HEAD = r"^\s*(async\s+def|def|class)\s+(\w+)"
# In a skeleton the closing mark at the line start ends a multi-line literal.
_CONTINUES = "\x02"


def _line_records(skel: Column) -> Column:
    """Non-blank skeleton lines with indentation, bracket balance and header."""

    def record(numbered: Column) -> Column:
        line = numbered.line
        indent = F.regexp_extract(line, r"^[ \t]*", 0)
        head = line.rlike(r"^\s*(async\s+def|def|class)\s")
        return F.struct(
            numbered.ln.alias("ln"),
            F.length(F.replace(indent, F.lit("\t"), F.lit(" " * 8))).alias("indent"),
            bracket_balance(line).alias("net"),
            line.startswith(_CONTINUES).alias("cont"),
            F.when(head, F.regexp_extract(line, _HEAD, 1)).otherwise("").alias("head"),
            F.when(head, F.regexp_extract(line, _HEAD, 2)).otherwise("").alias("name"),
            F.when(
                F.ltrim(line).startswith("@"),
                F.coalesce(
                    F.nullif(F.regexp_extract(line, r"^\s*@\s*([\w.]+)", 1), F.lit("")),
                    F.lit("complex_decorator"),
                ),
            ).alias("deco"),
        )

    numbered = F.transform(skel, lambda line, i: F.struct((i + 1).alias("ln"), line.alias("line")))
    return F.transform(F.filter(numbered, lambda n: F.trim(n.line) != ""), record)


def _close(open_: Column, keep, end: Column) -> Column:
    return F.transform(
        F.filter(open_, lambda o: ~keep(o)), lambda o: o.withField("end_line", end)
    )


def _spans(records: Column) -> Column:
    """Fold the lines once, keeping the stack of open ``def``/``class`` blocks: ``spans.line_spans`` as an expression.

    A block ends at the last non-blank line before a logical line that is not
    indented deeper.  Lines inside brackets or literals never end a block, but no bracket holds a
    ``def`` or ``class``: such a line starts anew, so that a lost bracket does not hide the rest.
    """

    def step(s: Column, x: Column) -> Column:
        depth = F.when((x["head"] != "") & ~x.cont, 0).otherwise(s.depth)
        logical = (depth == 0) & ~x.cont
        keep = lambda o: ~logical | (o.indent < x.indent)
        is_head = logical & (x["head"] != "")
        classes = F.array_join(
            F.transform(
                F.filter(s.open, lambda o: (o.indent < x.indent) & (o.kind == "class")),
                lambda o: o["name"],
            ),
            ".",
        )
        new = F.struct(
            x.ln.alias("line_number"),
            x.ln.alias("end_line"),
            x["name"].alias("name"),
            F.when(x["head"] == "class", "class")
            .when(x["head"] == "def", "function")
            .otherwise("async_function")
            .alias("kind"),
            F.nullif(classes, F.lit("")).alias("class_context"),
            x.indent.alias("indent"),
            F.when(s.deco_ln > 0, s.deco_ln).otherwise(x.ln).alias("first_line"),
            s.deco.alias("decorators"),
        )
        kept = F.filter(s.open, keep)
        # Decorator lines may continue over brackets, so they only reset on a
        # logical line of another sort.
        decorated = logical & x.deco.isNotNull()
        none = F.expr(_NO_NAMES)
        state = F.struct(
            F.greatest(depth + x.net, F.lit(0)).alias("depth"),
            x.ln.alias("last"),
            F.when(decorated, F.array_append(s.deco, x.deco))
            .when(logical, none)
            .otherwise(s.deco)
            .alias("deco"),
            F.when(decorated & (s.deco_ln == 0), x.ln)
            .when(logical & ~decorated, F.lit(0))
            .otherwise(s.deco_ln)
            .alias("deco_ln"),
            F.when(is_head, F.array_append(kept, new)).otherwise(kept).alias("open"),
        )
        closed = F.when(
            logical & F.exists(s.open, lambda o: o.indent >= x.indent), _close(s.open, keep, s["last"])
        )
        return F.struct(state.alias("state"), closed.alias("out"))

    # A statement in the first column behind the last line ends what is open.
    end = F.expr(
        "named_struct('ln', 0, 'indent', 0, 'net', 0, 'cont', false, 'head', 'end', 'name', '', 'deco', cast(null as string))"
    )
    return F.array_sort(running_rows(F.array_append(records, end), F.expr(_ZERO), step, _SPAN))


def python_given(skeleton: Column) -> Column:
    return given(skeleton, skeleton)


def python_found(text: Column, skel: Column, spans: Column, needed: frozenset[str] | None = None) -> Column:
    """Blocks of one Python file whose spans are known, with the fields that are needed."""
    none = F.lit(None).cast("string")

    def build(lines: Column, skel_lines: Column) -> Column:
        return F.transform(
            spans,
            lambda o: chosen(
                needed,
                name=lambda: o["name"],
                full_name=lambda: F.concat_ws(".", o.class_context, o["name"]),
                kind=lambda: o.kind,
                class_context=lambda: o.class_context,
                line_number=lambda: o.line_number,
                end_line=lambda: o.end_line,
                decorators=lambda: o.decorators,
                signature=lambda: none,
                return_type=lambda: none,
                first_line=lambda: o.first_line,
                code=lambda: line_slice(lines, o.line_number, o.end_line),
                skeleton=lambda: line_slice(skel_lines, o.first_line, o.end_line),
            ),
        )

    def lines_if(name: str, whole: Column, body) -> Column:
        return bind(lines_of(whole), body) if needed is None or name in needed else body(whole)

    return lines_if("code", text, lambda lines: lines_if("skeleton", skel, lambda skel_lines: build(lines, skel_lines)))


def python_blocks(text: Column) -> Column:
    """Functions of one file with their source and skeleton, in line order."""

    def of(skel: Column) -> Column:
        spans = bind(lines_of(skel), lambda lines: _spans(_line_records(lines)))
        return python_found(text, skel, F.filter(spans, lambda o: o.kind != "class"))

    return bind(python_skeleton(text), of)


# --------------------------------------------------------------------------
# Signatures
# --------------------------------------------------------------------------

_SIGNATURE = (
    rf"^\s*(?:async\s+)?def\s+\w+\s*(?:\[[^\]]*+\]\s*)?{pair('a')}\s*(?:->\s*([^:\n]+?)\s*)?:[ \t]*(?:\n|#|\S|$)"
)
# Escapes of quotes and backslashes stand aside, so that a quote always ends a literal.
_ASIDE = [("\\\\", "\x0e"), ('\\"', "\x0f"), ("\\'", "\x10")]
_STRING = r"""\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"[^"\n]*+"|'[^'\n]*+'"""
_HELD, _HELD_END = "\x13", "\x14"
_HELD_TEXT = f"{_HELD}([^{_HELD_END}]*+){_HELD_END}"


def _signature(code: Column, part: str) -> Column:
    """Parameters ("params") or the result ("result") as written in a function's header.

    Literals are taken out first, parentheses indexed, and the literals of the part, which are the
    first ones of the function, put back.
    """
    aside = code
    for escape, mark in _ASIDE:
        aside = F.replace(aside, F.lit(escape), F.lit(mark))
    held = F.regexp_replace(aside, rf"({_STRING})|#[^\n]*+", f"{_HELD}$1{_HELD_END}")

    def cut(text: Column) -> Column:
        def filled(found: Column, before: Column) -> Column:
            pieces = F.split(plain(found), _HELD)
            literals = F.slice(F.regexp_extract_all(text, F.lit(_HELD_TEXT)), before + 1, F.size(pieces) - 1)
            whole = F.zip_with(pieces, literals, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
            return F.array_join(whole, "")

        def of(indexed: Column) -> Column:
            params = F.regexp_extract(indexed, _SIGNATURE, 2)
            if part == "params":
                return filled(params, F.lit(0))
            before = F.length(params) - F.length(F.translate(params, _HELD, ""))
            return filled(F.regexp_extract(indexed, _SIGNATURE, 3), before)

        return bind(pair_index(F.regexp_replace(text, _HELD_TEXT, _HELD)), of)

    out = bind(F.replace(held, F.lit(_HELD + _HELD_END), F.lit("")), cut)
    for escape, mark in reversed(_ASIDE):
        out = F.replace(out, F.lit(mark), F.lit(escape))
    return out


_FRAME_OF_NOTE = "struct<base:string,done:array<string>,text:string,kind:int,commas:int>"
_NOTE_TOKENS = r"""([\w.]+|"[^"]*+"|'[^']*+'|[\[\](){},]|[^\s\w.])"""
#: What an element of an annotation is so far.
_NOTHING, _NAME, _QUOTED, _SUBSCRIPT, _COMPLEX = range(5)


def annotation_text(text: Column) -> Column:
    """Annotation as reported: dotted names, literals and subscripts, however deep they nest.

    ``Name[...]`` keeps a name or a list of elements, anything else is elided.  One fold over the
    tokens with a stack of open brackets; a frame without a base is a list or a call.
    """
    complex_ = F.lit("complex_annotation")
    empty = F.expr(_NO_NAMES)

    def frame(base: Column) -> Column:
        return F.struct(
            base.alias("base"), empty.alias("done"), F.lit("").alias("text"), F.lit(_NOTHING).alias("kind"),
            F.lit(0).alias("commas"),
        )

    def element(f: Column) -> Column:
        return F.when(f.kind == _COMPLEX, complex_).otherwise(f.text)

    def now(f: Column, value: Column, kind: Column) -> Column:
        """The frame with one more piece in its element; a second piece makes it complex."""
        free = f.kind == _NOTHING
        return f.withField("text", F.when(free, value).otherwise("")).withField(
            "kind", F.when(free, kind).otherwise(F.lit(_COMPLEX))
        )

    def result(f: Column) -> Column:
        done = F.when(f.kind == _NOTHING, f.done).otherwise(F.array_append(f.done, element(f)))
        single = (f.kind == _NAME) & f.text.rlike(r"^[A-Za-z_]\w*$") & ~f.text.isin("None", "True", "False")
        inner = F.when(f.commas > 0, F.array_join(done, ", ")).when(single, f.text).otherwise("...")
        return F.concat(f.base, F.lit("["), inner, F.lit("]"))

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        top, under = F.get(stack, n - 1), F.get(stack, n - 2)
        rest = F.slice(stack, 1, n - 1)
        subscript = (t == "[") & (top.kind == _NAME)
        # The name in front of a subscript is its base; the element comes back when it closes.
        opened = F.when(subscript, top.withField("text", F.lit("")).withField("kind", F.lit(_NOTHING))).otherwise(top)
        base = F.when(subscript, top.text)
        closed = F.when(
            top.base.isNotNull() & (t == "]"), now(under, result(top), F.lit(_SUBSCRIPT))
        ).otherwise(now(under, F.lit(""), F.lit(_COMPLEX)))
        after_comma = (
            top.withField("done", F.array_append(top.done, element(top)))
            .withField("text", F.lit("")).withField("kind", F.lit(_NOTHING)).withField("commas", top.commas + 1)
        )
        quoted = t.rlike("^[\"']")
        piece = F.when(quoted, now(top, F.substring(t, F.lit(2), F.length(t) - 2), F.lit(_QUOTED))).otherwise(
            now(top, t, F.when(t.rlike(r"^[\w.]+$"), _NAME).otherwise(_COMPLEX))
        )
        return (
            F.when(t.isin("[", "(", "{"), F.concat(rest, F.array(opened, frame(base))))
            .when(t.isin("]", ")", "}") & (n > 1), F.array_append(F.slice(stack, 1, n - 2), closed))
            .when(t == ",", F.array_append(rest, after_comma))
            .otherwise(F.array_append(rest, piece))
        )

    stack = F.aggregate(
        F.regexp_extract_all(text, F.lit(_NOTE_TOKENS)),
        F.array(frame(F.lit(None).cast("string"))).cast(f"array<{_FRAME_OF_NOTE}>"),
        step,
        lambda s: F.when((F.size(s) == 1) & (F.get(s, F.lit(0)).commas == 0), element(F.get(s, F.lit(0)))).otherwise(complex_),
    )
    return F.when(text.rlike(r"^[\w.]+$"), text).otherwise(stack)


def default_text(text: Column) -> Column:
    """Default value as reported: constants, names and empty list or dict."""
    body = F.regexp_extract(text, "^[\"'](.*)[\"']$", 1)
    return (
        F.when(text.rlike(r"^[\w.]+$"), text)
        .when(text.rlike(r"""^"(?:[^"\\]|\\.)*+"$|^'(?:[^'\\]|\\.)*+'$"""), F.concat(F.lit("'"), body, F.lit("'")))
        .when(text.rlike(r"^\[.*\]$"), "[]")
        .when(text.rlike(r"^\{[^{}]*:.*\}$|^\{\}$"), "{}")
        .otherwise("complex_default")
    )


def python_params(code: Column) -> Column:
    """Positional parameters, ``*args`` and ``**kwargs``; others are omitted.

    Names before ``/`` and names after ``*`` are not positional-or-keyword and
    are left out, as in the results to match.
    """

    def select(parts: Column) -> Column:
        slash = F.array_position(parts, "/").cast("int")
        star_at = F.array_position(
            F.transform(parts, lambda p: p.startswith("*") & ~p.startswith("**")), True
        ).cast("int")
        plain = F.filter(
            parts,
            lambda p, i: (i >= slash)
            & ((star_at == 0) | (i + 1 < star_at))
            & ~p.startswith("*"),
        )
        args = F.filter(parts, lambda p: p.rlike(r"^\*\w"))
        kwargs = F.filter(parts, lambda p: p.rlike(r"^\*\*\w"))
        return F.concat(plain, args, kwargs)

    def describe(p: Column) -> Column:
        note = F.trim(F.regexp_extract(p, r"^\*{0,2}\w+\s*:\s*([^=]+)", 1))
        value = F.trim(F.regexp_extract(p, r"^\*{0,2}\w+\s*(?::[^=]+)?=(.*)$", 1))
        return F.struct(
            F.regexp_extract(p, r"^(\*{0,2}\w+)", 1).alias("name"),
            F.when(note != "", annotation_text(note)).alias("annotation"),
            F.when(value != "", default_text(value)).alias("default"),
        )

    return F.transform(bind(split_top_level(_signature(code, "params")), select), describe)


def python_return(code: Column) -> Column:
    return bind(F.trim(_signature(code, "result")), lambda note: F.when(note != "", annotation_text(note)))


# --------------------------------------------------------------------------
# Imports and calls
# --------------------------------------------------------------------------

_PLAIN_IMPORT = r"^[ \t]*import[ \t]+(.+)$"
_OPEN_IMPORT = r"(?m)^([ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]*\()([^()\n]*+\n[^()]*+)(\))"
_CONTINUED_IMPORT = r"(?m)^([ \t]*(?:from|import)\b[^\n\\]*+)((?:\\\n[^\n\\]*+)++)($)"
_FROM_IMPORT = r"^[ \t]*from[ \t]+(\.*)([\w.]*)[ \t]+import\b[ \t]*(.*)$"


def python_imports(text: Column, skeleton: Column | None = None) -> Column:
    """One record per imported name, in line order, with a canonical statement.

    A parenthesised list counts on its first line.
    """

    def names(listing: Column) -> Column:
        parts = F.split(F.regexp_replace(listing, r"[()\\;]", " "), ",")
        return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")

    def one(line: Column, i: Column) -> Column:
        def records(stmt: Column) -> Column:
            def record(p: Column) -> Column:
                stem = F.concat(stmt.stem, p["name"])
                return F.struct(
                    (i + 1).alias("line_number"),
                    F.when(stmt.is_from, "from_import").otherwise("import").alias("kind"),
                    F.when(stmt.is_from, stmt.module).otherwise(p["name"]).alias("module"),
                    F.when(stmt.is_from, p["name"]).alias("name"),
                    p["alias"].alias("alias"),
                    F.when(p["alias"].isNotNull(), F.concat(stem, F.lit(" as "), p["alias"]))
                    .otherwise(stem)
                    .alias("statement"),
                )

            return F.transform(F.transform(names(stmt.listing), named), record)

        def named(p: Column) -> Column:
            return F.struct(
                F.regexp_extract(p, r"^([\w.*]+)", 1).alias("name"),
                F.nullif(F.regexp_extract(p, r"\s+as\s+(\w+)$", 1), F.lit("")).alias("alias"),
            )

        def part(n: int) -> Column:
            return F.regexp_extract(line, _FROM_IMPORT, n)

        def statement(module: Column) -> Column:
            return F.struct(
                F.lit(True).alias("is_from"), module.alias("module"), part(3).alias("listing"),
                F.concat(F.lit("from "), module, F.lit(" import ")).alias("stem"),
            )

        plain = F.struct(
            F.lit(False).alias("is_from"), F.lit("").alias("module"),
            F.regexp_extract(line, _PLAIN_IMPORT, 1).alias("listing"), F.lit("import ").alias("stem"),
        )
        # What a line says is read once for all its names.  The word is looked for first: it spares most lines the patterns.
        read = F.when(line.rlike(_FROM_IMPORT), bind(F.concat(part(1), part(2)), statement)).when(
            line.rlike(_PLAIN_IMPORT), plain
        )
        return F.when(line.contains("import"), bind(read, records))

    # "from m import (" ... ")" may span lines: the list is pulled up to its
    # first line, the other lines stay where they are.
    skel = python_skeleton(text) if skeleton is None else skeleton
    whole = bind(bind(skel, lambda t: pulled_up(t, _OPEN_IMPORT)), lambda t: pulled_up(t, _CONTINUED_IMPORT))
    lines = lines_of(whole)
    merged = F.transform(lines, lambda line: F.substring_index(line, FIELD, 1))
    found = F.filter(F.transform(merged, one), lambda r: r.isNotNull())
    return F.flatten(found)


_CALL_TOKENS = (
    r"(\n|(?:(?<=[)\]}\x02\x22'])\.)?(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*[ \t]*\("
    r"|[(\[{]|[)\]}]|,|[=!<>:]=|=|\*\*|\w+|[^\s])"
)
_FRAME = (
    "struct<line:int,name:string,object:string,kind:string,"
    "args:int,kwargs:int,filled:boolean,named:boolean,shape:string,concat:boolean>"
)
_CALL_ZERO = f"named_struct('line', 0, 'head', false, 'prev', '', 'open', cast(array() as array<{_FRAME}>))"
# The shape of an argument has a character for each operand and operator: s for a string, f for one
# that interpolates, c for a concatenation in parentheses, + and -, L for operators that bind less, m
# for others, o for anything else.  Strings side by side are one.
_LOOSE = ["and", "or", "not", "in", "is", "if", "else", "lambda", "for", "async", "==", "!=", "<=", ">=", ":=", "<", ">", "|", "^", "&"]
_CONCATENATES = r"^[^L]*\+s$|^s\+[^-+L]*$|^[sf]*f[sf]*$|^c$"
_NOT_CALLS = [
    "if", "elif", "while", "for", "return", "and", "or", "not", "in", "is", "lambda", "assert",
    "with", "yield", "await", "except", "raise", "del", "else", "from", "import", "as",
    "async", "match", "case",
]


def python_calls(skeleton: Column, first_line: Column) -> Column:
    """Calls of one function: name, object, kind, line, argument counts and string concatenation.

    One fold over the structural tokens with a stack of open brackets; each
    frame counts its own top-level arguments and notes the shape of the one at hand.  ``string_concat``
    says whether a positional argument is a string with interpolations, or a sum whose last step has
    a plain string beside the plus.
    """
    tokens = F.regexp_extract_all(skeleton, F.lit(_CALL_TOKENS))

    def step(s: Column, t: Column) -> Column:
        opener = t.rlike(r"[(\[{]$")
        closer = t.rlike(r"^[)\]}]$")
        path = F.regexp_extract(t, r"^\.?((?:\w+\.)*)\w+\s*\($", 1)
        name = F.regexp_extract(t, r"(\w+)\s*\($", 1)
        dotted = t.startswith(".")
        after_value = s.prev.rlike(r"^[)\]]$")
        obj = F.regexp_replace(
            F.concat(F.when(dotted, F.lit("complex_object.")).otherwise(""), path), r"\.$", ""
        )
        is_named = (name != "") & ~name.isin(*_NOT_CALLS) & ~s["head"]
        is_anon = (t == "(") & after_value
        frame = F.struct(
            s.line.alias("line"),
            F.when(is_anon, "complex_call").otherwise(name).alias("name"),
            F.nullif(obj, F.lit("")).alias("object"),
            F.when(is_anon, "complex_call")
            .when(is_named & (obj != ""), "method_call")
            .when(is_named, "function_call")
            .otherwise("")
            .alias("kind"),
            F.lit(0).alias("args"),
            F.lit(0).alias("kwargs"),
            F.lit(False).alias("filled"),
            F.lit(False).alias("named"),
            F.lit("").alias("shape"),
            F.lit(False).alias("concat"),
        )
        n = F.size(s.open)
        last = F.get(s.open, n - 1)
        below = F.slice(s.open, 1, F.greatest(n - 1, F.lit(0)))

        def counted(f: Column) -> Column:
            plain_arg = f.filled & ~f.named
            return (
                f.withField("args", f["args"] + plain_arg.cast("int"))
                .withField("kwargs", f.kwargs + (f.filled & f.named).cast("int"))
                .withField("concat", f["concat"] | (plain_arg & f["shape"].rlike(_CONCATENATES)))
                .withField("filled", F.lit(False))
                .withField("named", F.lit(False))
                .withField("shape", F.lit(""))
            )

        def top(change) -> Column:
            return F.when(n > 0, F.array_append(below, change(last))).otherwise(s.open)

        quote = t.isin('"', "'")
        code = (
            F.when(quote, "s")
            .when(t.isin("+", "-"), t)
            .when(t.isin(*_LOOSE) | name.isin("and", "or", "not", "in", "if", "else", "lambda"), "L")
            .when(t.rlike(r"^[*/%@~]"), "m")
            # An interpolation is part of its string.
            .when((t == LIT_CLOSE) | ((t == "{") & last["shape"].rlike("[sf]$")), "")
            .otherwise("o")
        )
        # The letters in front of a quote belong to the string.
        prefixed = quote & s.prev.rlike("^(?:[fF][rR]?|[rR][fF]|[rRuU])$") & last["shape"].endswith("o")
        stem = F.when(prefixed, F.regexp_replace(last["shape"], "o$", "")).otherwise(last["shape"])
        piece = F.when(prefixed & s.prev.rlike("[fF]"), "f").otherwise(code)
        # Three quotes, and strings side by side, are one; a long literal's close mark is none.
        shape = F.when(quote & ~prefixed & stem.rlike("[sf]$"), stem).otherwise(F.concat(stem, piece))
        content = t != "\n"
        touched = top(lambda f: f.withField("filled", F.lit(True)).withField("shape", shape))
        # "**options" is a keyword argument, too.
        starred = top(
            lambda f: F.when(f.filled, f.withField("shape", shape)).otherwise(
                f.withField("filled", F.lit(True)).withField("named", F.lit(True))
            )
        )
        # A lone parenthesis stands for what is in it.
        inner = F.when(last["shape"].rlike(_CONCATENATES) & ~last["shape"].rlike("^[sf]*$"), "c").when(
            last["shape"].rlike("^[sf]+$"), last["shape"]
        )
        group = (t == ")") & (last["kind"] == "") & (last["name"] == "") & (last["args"] == 0) & inner.isNotNull()
        outer = F.get(s.open, n - 2)
        regrouped = F.array_append(
            F.slice(s.open, 1, F.greatest(n - 2, F.lit(0))),
            outer.withField("shape", F.regexp_replace(outer["shape"], "o$", inner)),
        )
        state = F.struct(
            F.when(t == "\n", s.line + 1).otherwise(s.line).alias("line"),
            F.when(t.isin("def", "class"), True)
            .when(content, False)
            .otherwise(s["head"])
            .alias("head"),
            F.when(content, t).otherwise(s.prev).alias("prev"),
            F.when(opener, F.array_append(touched, frame))
            .when(closer & group & (n > 1), regrouped)
            .when(closer, below)
            .when(t == ",", top(counted))
            .when(t == "=", top(lambda f: f.withField("named", F.lit(True)).withField("shape", F.lit(""))))
            .when(t == "**", starred)
            .when(content, touched)
            .otherwise(s.open)
            .alias("open"),
        )
        done = F.when(closer & (n > 0) & (last["kind"] != ""), F.array(counted(last)))
        # Line breaks, and code outside of all brackets, change no frame.
        nothing = F.lit(None).cast(f"array<{_FRAME}>").alias("out")
        broken = F.struct((s.line + 1).alias("line"), s["head"].alias("head"), s.prev.alias("prev"), s.open.alias("open"))
        passed = F.struct(
            s.line.alias("line"), t.isin("def", "class").alias("head"), t.alias("prev"), s.open.alias("open")
        )
        return (
            F.when(~content, F.struct(broken.alias("state"), nothing))
            .when((n == 0) & ~opener, F.struct(passed.alias("state"), nothing))
            .otherwise(F.struct(state.alias("state"), done.alias("out")))
        )

    return F.transform(
        running_rows(tokens, F.expr(_CALL_ZERO).withField("line", first_line.cast("int")), step, _FRAME),
        lambda f: F.struct(
            f.line.alias("line_number"),
            f["name"].alias("name"),
            f.object.alias("object"),
            f.kind.alias("kind"),
            f["args"].alias("args_count"),
            f.kwargs.alias("kwargs_count"),
            f["concat"].alias("string_concat"),
        ),
    )


def called(skeleton: Column, first_line: Column) -> Column:
    """As :func:`python_calls`, by a walk; the arguments must be columns of a table."""
    return calls_of(skeleton, first_line, _NOT_CALLS)


def python_call_names(skeleton: Column) -> Column:
    """Just the called names, in text order; a cheap pass for contexts."""
    found = F.regexp_extract_all(
        F.regexp_replace(skeleton, r"\b(?:def|class)\s+\w+\s*\(", "("),
        F.lit(r"([A-Za-z_]\w*)[ \t]*\("),
    )
    return F.filter(found, lambda n: ~n.isin(*_NOT_CALLS))
