"""Folds over a text's tokens as walks: literals that hold code, calls and signatures, brackets left open.

As in ``spans.py``, texts and tokens are prepared by column expressions, and only the stack machine runs in Python,
over whole Arrow columns.  Each walk leaves what the fold of the same name gives.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import CLOSE, OPEN, PAIR_MARK
from .lexing import ELSE, ENDIF, IF, LIT_CLOSE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- literals that hold code ---------------------------------------------------------

_PY_TOKENS = re.compile(r"""\"{3}|'{3}|["'#{}()\[\]:\n]|[^"'#{}()\[\]:\n]++""")
# Java's "$" also stands before a last line break of any sort.
_PY_PREFIX = re.compile(r"(?:^|\W)(?:[fF][rR]?|[rR][fF])[\r\x85\u2028\u2029]?\Z", re.A)
_JS_TOKENS = re.compile(r"""/\*|\*/|//|\$\{|["'`{}\n]|[^"'`{}\n/*$]++|[/*$]""")
_QUOTES = {'"', "'", '"""', "'''"}
_PARTNER = {"(": ")", "[": "]", "{": "}"}


def python_literals(text: str) -> str:
    """Python code without comments and literal contents: the rules of ``lexing._python_rule``."""
    stack, out, prev = [], [], ""
    for t in _PY_TOKENS.findall(text):
        top = stack[-1] if stack else ""
        if not top:
            if t in _QUOTES:
                stack.append(("f" if _PY_PREFIX.search(prev) else "") + t)
            elif t == "#":
                stack.append(t)
                prev = t
                continue
            out.append(t)
        elif top == "#":
            if t == "\n":
                stack.pop()
                out.append(t)
        elif top[-1] in "\"'":
            end = top.removeprefix("f")
            long = len(end) == 3
            if t in _QUOTES and (t == end or not long and t.startswith(end)):
                stack.pop()
                out.append(LIT_CLOSE if long else "")
            elif t == "\n":
                if not long:
                    stack.pop()
                out.append("\n" + LIT_CLOSE if long else t)
            elif t == "{" and top[0] == "f":
                stack.append(t)
                out.append(t)
        elif top == ":":
            if t == "{":
                stack.append(t)
                out.append(t)
            elif t == "}":
                del stack[-2:]
                out.append(t)
        else:  # in an interpolation
            below = stack[-2] if len(stack) > 1 else ""
            if t in _QUOTES:
                stack.append(("f" if _PY_PREFIX.search(prev) else "") + t)
                out.append(t)
            elif t == "#":
                stack.append(t)
            elif t == "{" and top == "{" and prev == "{" and below[:1] == "f":
                stack.pop()
                out.append("}")
            elif t in _PARTNER:
                stack.append(t)
                out.append(t)
            elif t == _PARTNER[top]:
                stack.pop()
                out.append(t)
            elif t == ":" and top == "{" and below[:1] in ("f", ":"):
                stack.append(t)
            else:
                out.append(t)
        prev = t
    return "".join(out)


def js_literals(text: str) -> str:
    """JavaScript without comments and literal contents: the rules of ``lexing._js_rule``."""
    stack, out = [], []
    for t in _JS_TOKENS.findall(text):
        top = stack[-1] if stack else ""
        if top == "`":
            if t == "`":
                stack.pop()
            elif t == "${":
                stack.append("{")
                out.append(" +(")
            elif t == "\n":
                out.append(t)
        elif top == "/*":
            if t == "*/":
                stack.pop()
            elif t == "\n":
                out.append(t)
        elif top and top in "\"'":
            if t == top or t == "\n":
                stack.pop()
                if t == "\n":
                    out.append(t)
        elif top == "//":
            if t == "\n":
                stack.pop()
                out.append(t)
        elif t in ("`", "/*", "//"):
            stack.append(t)
        elif t in ('"', "'"):
            stack.append(t)
            out.append(t)
        elif top and t in ("{", "${"):
            stack.append("{")
            out.append(t)
        elif t == "}" and top == "{":
            stack.pop()
            out.append(")" if stack and stack[-1] == "`" else t)
        else:
            out.append(t)
    return "".join(out)


def _literals(lang: pa.Array, bare: pa.Array) -> pa.Array:
    walk = {"python": python_literals, "javascript": js_literals}
    pairs = zip(lang.to_pylist(), bare.to_pylist(), strict=True)
    return pa.array([None if text is None else walk[language](text) for language, text in pairs], pa.string())


def literals_of(lang: Column, bare: Column) -> Column:
    """Skeletons of texts without escapes; null for a null text.  The arguments must be columns of a table."""
    return F.arrow_udf(_literals, "string")(lang, F.make_valid_utf8(bare))


# --- brackets left open --------------------------------------------------------------

BALANCE = "struct<net:int,error_line:int>"
LINKAGE = "\x1a"
_STRUCTURE = re.compile(f"\n+|[\x04\x1a(){{}}\\[\\]{IF}{ELSE}{ENDIF}]")
_FITS = {")": "(", "]": "[", "}": "{" + LINKAGE}


def balance(bare: str, counted: str) -> tuple[int, int | None]:
    """Brackets left open and the first broken line: the fold ``recovery._scan``, with stacks that share their rests."""
    line, net, error, stack, branches = 1, 0, None, None, []
    for t in _STRUCTURE.findall(bare):
        if t[0] == "\n":
            line += len(t)
            continue
        if t in "([{\x1a":
            stack = (t, line, stack)
            net += t in counted or t == LINKAGE
        elif t in ")]}":
            if stack and stack[0] in _FITS[t]:
                stack = stack[2]
            elif error is None:
                error = line
            net -= t in counted
        elif t == "\x04":
            if stack and stack[0] != LINKAGE:
                error = stack[1] if error is None else error
                stack = None
        elif t == IF:
            branches.append((net, 0, stack, stack))
        elif branches:
            before, change, first, after = branches.pop()
            if abs(net - before) > abs(change):
                change, after = net - before, stack
            if t == ELSE:
                net, stack = before, first
                branches.append((before, change, first, after))
            else:
                net, stack = before + change, after
    if stack and error is None:
        error = stack[1]
    return net, error


def _balances(lang: pa.Array, bare: pa.Array) -> pa.Array:
    pairs = zip(lang.to_pylist(), bare.to_pylist(), strict=True)
    found = [None if text is None else balance(text, "()[]{}" if language == "python" else "{}") for language, text in pairs]
    rows = [None if f is None else {"net": f[0], "error_line": f[1]} for f in found]
    return pa.array(rows, pa.struct([("net", pa.int32()), ("error_line", pa.int32())]))


def balance_of(lang: Column, bare: Column) -> Column:
    """``struct(net, error_line)`` of what a file has left of structure; its arguments must be columns of a table."""
    return F.arrow_udf(_balances, BALANCE)(lang, bare)


# --- calls ---------------------------------------------------------------------------

CALLS = (
    "array<struct<line_number:int,name:string,object:string,kind:string,args_count:int,kwargs_count:int,"
    "string_concat:boolean>>"
)
_CALL_TOKENS = re.compile(
    r"\n|(?:(?<=[)\]}\x02\x22'])\.)?(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*[ \t]*\("
    r"|[(\[{]|[)\]}]|,|[=!<>:]=|=|\*\*|\w+|[^\s]",
    re.A,
)
_CALLED = re.compile(r"\.?((?:\w+\.)*)(\w+)\s*\(\Z", re.A)
_CONCATENATES = re.compile(r"^[^L]*\+s$|^s\+[^-+L]*$|^[sf]*f[sf]*$|^c$")
_STRINGS = re.compile("[sf]+")
_STRING_PREFIX = re.compile("(?:[fF][rR]?|[rR][fF]|[rRuU])")
_LOOSE = {
    "and", "or", "not", "in", "is", "if", "else", "lambda", "for", "async", "==", "!=", "<=", ">=", ":=", "<", ">", "|",
    "^", "&",
}
_LOOSE_CALLS = {"and", "or", "not", "in", "if", "else", "lambda"}


class _Frame:
    """An open bracket: what it calls, and its arguments so far."""

    __slots__ = ("line", "name", "object", "kind", "args", "kwargs", "filled", "named", "shape", "concat")

    def __init__(self, line: int, name: str, obj: str | None, kind: str):
        self.line, self.name, self.object, self.kind = line, name, obj, kind
        self.args = self.kwargs = 0
        self.filled = self.named = self.concat = False
        self.shape = ""

    def count(self) -> None:
        if self.filled:
            if self.named:
                self.kwargs += 1
            else:
                self.args += 1
                self.concat = self.concat or bool(_CONCATENATES.search(self.shape))
        self.filled = self.named = False
        self.shape = ""


def python_calls(skeleton: str, first_line: int, not_calls: frozenset[str]) -> list[tuple]:
    """Calls of one function's skeleton, in the order in which they end: the fold ``python_code.python_calls``."""
    done: list[tuple] = []
    stack: list[_Frame] = []
    line, head, prev = first_line, False, ""
    for t in _CALL_TOKENS.findall(skeleton):
        if t == "\n":
            line += 1
            continue
        last = stack[-1] if stack else None
        opener = t[-1] in "([{"
        if last is None and not opener:
            head, prev = t in ("def", "class"), t
            continue
        closer = t in (")", "]", "}")
        name = path = ""
        if opener and len(t) > 1:
            path, name = _CALLED.match(t).groups()
        group = False
        if closer and t == ")" and last.kind == last.name == "" and last.args == 0 and len(stack) > 1:
            if _STRINGS.fullmatch(last.shape):
                group, inner = True, last.shape
            elif last.shape and _CONCATENATES.search(last.shape):
                group, inner = True, "c"
        if closer:
            stack.pop()
            if last.kind:
                last.count()
                done.append((last.line, last.name, last.object, last.kind, last.args, last.kwargs, last.concat))
            if group and stack[-1].shape.endswith("o"):
                stack[-1].shape = stack[-1].shape[:-1] + inner
        elif t == ",":
            last.count()
        elif t == "=":
            last.named, last.shape = True, ""
        else:
            if last is not None:
                _touch(last, t, name, prev)
            if opener:
                stack.append(_opened(t, path, name, prev, head, line, not_calls))
        head, prev = t in ("def", "class"), t
    return done


def _touch(last: _Frame, t: str, name: str, prev: str) -> None:
    """One more token in the argument at hand."""
    shape = last.shape
    if t in ('"', "'"):
        if shape.endswith("o") and _STRING_PREFIX.fullmatch(prev):
            # The letters in front of a quote belong to the string.
            shape = shape[:-1] + ("f" if "f" in prev or "F" in prev else "s")
        elif not shape.endswith(("s", "f")):
            shape += "s"
    elif t in ("+", "-"):
        shape += t
    elif t in _LOOSE or name in _LOOSE_CALLS:
        shape += "L"
    elif t[0] in "*/%@~":
        shape += "m"
    elif t != LIT_CLOSE and not (t == "{" and shape.endswith(("s", "f"))):
        shape += "o"
    if t == "**" and not last.filled:
        last.filled = last.named = True
        return
    last.filled, last.shape = True, shape


def _opened(t: str, path: str, name: str, prev: str, head: bool, line: int, not_calls: frozenset[str]) -> _Frame:
    if t == "(" and prev in (")", "]"):
        return _Frame(line, "complex_call", None, "complex_call")
    obj = (("complex_object." if t[0] == "." else "") + path).removesuffix(".")
    called = name and name not in not_calls and not head
    return _Frame(line, name, obj or None, ("method_call" if obj else "function_call") if called else "")


def calls_of(skeleton: Column, first_line: Column, not_calls: list[str]) -> Column:
    """The calls of a function; its arguments must be columns of a table."""
    words = frozenset(not_calls)

    def found(skeletons: pa.Array, lines: pa.Array) -> pa.Array:
        rows, offsets = [], [0]
        for text, line in zip(skeletons.to_pylist(), lines.to_pylist(), strict=True):
            if text is not None:
                rows += python_calls(text, line, words)
            offsets.append(len(rows))
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        names = ["line_number", "name", "object", "kind", "args_count", "kwargs_count", "string_concat"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        calls = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), calls)

    return F.arrow_udf(found, CALLS)(F.make_valid_utf8(skeleton), first_line.cast("int"))


# --- signatures ----------------------------------------------------------------------

SIGNATURE = "struct<params:array<struct<name:string,annotation:string,default:string>>,result:string>"
# What "." and "$" are in Java.
_DOT = r"[^\n\r\x85\u2028\u2029]"
_DOLLAR = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_ASIDE = [("\\\\", "\x0e"), ('\\"', "\x0f"), ("\\'", "\x10")]
_HELD, _HELD_END = "\x13", "\x14"
_STRING = re.compile(r"""(\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"[^"\n]*+"|'[^'\n]*+')|#[^\n]*+""")
_HELD_TEXT = re.compile(f"{_HELD}([^{_HELD_END}]*+){_HELD_END}")
_DEF = re.compile(r"\s*(?:async\s+)?def\s+\w+\s*(?:\[[^\]]*+\]\s*)?\(", re.A)
_RESULT = re.compile(rf"\s*(?:->\s*([^:\n]+?)\s*)?:[ \t]*(?:\n|#|\S|{_DOLLAR})", re.A)
_PARENTHESIS = re.compile("[()]")
# A whole header without literals, comments, marks and inner parentheses, as most are.
_CLEAR = "\"'#\\\\()\x0e-\x18\ue000-\uf8ff"
_CLEAR_DEF = re.compile(
    rf"\s*(?:async\s+)?def\s+\w+\s*\(([^{_CLEAR}]*+)\)\s*(?:->\s*([^:\n{_CLEAR}]+?)\s*)?:[ \t]*(?:[\n#]|\S)", re.A
)
_ANY_MARK = re.compile(f"{PAIR_MARK}|[{OPEN}{CLOSE}]")
_MARKED = {OPEN: "(", CLOSE: ")"}
_LIST_TOKENS = re.compile(
    r"""("(?:\\%s|[^"\\])*+"|'(?:\\%s|[^'\\])*+'|#[^\n]*+|=>|[\[\](){}<>,]|[^\[\](){}<>,"'#=]++|[="'])""" % (_DOT, _DOT)
)
_BRACKETED = re.compile(r"""[\[\](){}<>"'#]""")
_BLANKS = re.compile(r"\s+", re.A)
_WORDS = re.compile(rf"[\w.]+{_DOLLAR}", re.A)
_STARRED = re.compile(r"\*\w", re.A)
_NAMED = re.compile(r"\*{0,2}\w+", re.A)
_NOTE = re.compile(r"\*{0,2}\w+\s*:\s*([^=]+)", re.A)
_VALUE = re.compile(rf"\*{{0,2}}\w+\s*(?::[^=]+)?=({_DOT}*){_DOLLAR}", re.A)
_LITERAL = re.compile(rf"""(?:"(?:[^"\\]|\\{_DOT})*+"|'(?:[^'\\]|\\{_DOT})*+'){_DOLLAR}""")
_BODY = re.compile(rf"""["']({_DOT}*)["']{_DOLLAR}""")
_LIST = re.compile(rf"\[{_DOT}*\]{_DOLLAR}")
_DICT = re.compile(rf"\{{[^{{}}]*:{_DOT}*\}}{_DOLLAR}|\{{\}}{_DOLLAR}")
_NOTE_TOKENS = re.compile(r"""[\w.]+|"[^"]*+"|'[^']*+'|[\[\](){},]|[^\s\w.]""", re.A)
_SINGLE = re.compile(r"[A-Za-z_]\w*", re.A)
_NOTHING, _NAME, _QUOTED, _SUBSCRIPT, _COMPLEX = range(5)
_COMPLEX_NOTE = "complex_annotation"


def _plain(text: str) -> str:
    return _ANY_MARK.sub(lambda m: _MARKED.get(m[0], ""), text)


def python_signature(code: str) -> tuple[str, str]:
    """Parameters and result as written in a function's header: ``python_code._signature`` of either part."""
    clear = _CLEAR_DEF.match(code)
    if clear:
        return clear[1], clear[2] or ""
    aside = code
    for escape, mark in _ASIDE:
        aside = aside.replace(escape, mark)
    held = _STRING.sub(lambda m: f"{_HELD}{m[1] or ''}{_HELD_END}", aside).replace(_HELD + _HELD_END, "")
    bare = _HELD_TEXT.sub(_HELD, held)
    params = result = ""
    head = _DEF.match(bare)
    if head:
        depth = 1
        for found in _PARENTHESIS.finditer(bare, head.end()):
            depth += 1 if found[0] == "(" else -1
            if not depth:
                rest = _RESULT.match(bare, found.end())
                if rest:
                    params, result = bare[head.end() : found.start()], rest[1] or ""
                break
    out, before = [], 0
    for part in (params, result):
        whole = _plain(part)
        n = whole.count(_HELD)
        if n:
            literals = _HELD_TEXT.findall(held)[before : before + n]
            pieces = whole.split(_HELD)
            whole = "".join(p + h for p, h in zip(pieces, [*literals, *[""] * (len(pieces) - len(literals))], strict=True))
        before = params.count(_HELD)
        for escape, mark in reversed(_ASIDE):
            whole = whole.replace(mark, escape)
        out.append(whole)
    return out[0], out[1]


def _pieces(text: str) -> list[str]:
    if not _BRACKETED.search(text):
        return text.split(",")
    depth, cur, pieces = 0, [], []
    for t in _LIST_TOKENS.findall(text):
        if t == "," and not depth:
            pieces.append("".join(cur))
            cur = []
            continue
        if t in ("(", "[", "{", "<"):
            depth += 1
        elif t in (")", "]", "}", ">"):
            depth = max(depth - 1, 0)
        if t[0] != "#":
            cur.append(t)
    return [*pieces, "".join(cur)]


def top_level(text: str) -> list[str]:
    """A list split at its outer commas: ``lexing.split_top_level``."""
    trimmed = [_BLANKS.sub(" ", p).strip(" ") for p in _pieces(text)]
    return [p for p in trimmed if p]


class _Note:
    """An open bracket of an annotation: its base, the elements that are done and the one at hand."""

    __slots__ = ("base", "done", "text", "kind", "commas")

    def __init__(self, base: str | None):
        self.base, self.done, self.text, self.kind, self.commas = base, [], "", _NOTHING, 0

    def add(self, value: str, kind: int) -> None:
        free = self.kind == _NOTHING
        self.text, self.kind = (value, kind) if free else ("", _COMPLEX)

    def element(self) -> str:
        return _COMPLEX_NOTE if self.kind == _COMPLEX else self.text

    def result(self) -> str:
        done = self.done if self.kind == _NOTHING else [*self.done, self.element()]
        single = self.kind == _NAME and _SINGLE.fullmatch(self.text) and self.text not in ("None", "True", "False")
        return f"{self.base}[{', '.join(done) if self.commas else self.text if single else '...'}]"


def note_text(text: str) -> str:
    """An annotation as reported: ``python_code.annotation_text``."""
    if _WORDS.match(text):
        return text
    stack = [_Note(None)]
    for t in _NOTE_TOKENS.findall(text):
        top = stack[-1]
        if t in ("[", "(", "{"):
            base = None
            if t == "[" and top.kind == _NAME:
                base, top.text, top.kind = top.text, "", _NOTHING
            stack.append(_Note(base))
        elif t in ("]", ")", "}") and len(stack) > 1:
            stack.pop()
            if top.base is not None and t == "]":
                stack[-1].add(top.result(), _SUBSCRIPT)
            else:
                stack[-1].add("", _COMPLEX)
        elif t == ",":
            top.done.append(top.element())
            top.text, top.kind, top.commas = "", _NOTHING, top.commas + 1
        elif t[0] in "\"'":
            top.add(t[1:-1], _QUOTED)
        else:
            top.add(t, _NAME if _WORDS.match(t) else _COMPLEX)
    last = stack[0]
    return last.element() if len(stack) == 1 and not last.commas else _COMPLEX_NOTE


def value_text(text: str) -> str:
    """A default as reported: ``python_code.default_text``."""
    if _WORDS.match(text):
        return text
    if _LITERAL.match(text):
        body = _BODY.match(text)
        return f"'{body[1] if body else ''}'"
    return "[]" if _LIST.match(text) else "{}" if _DICT.match(text) else "complex_default"


def _described(p: str) -> tuple[str, str | None, str | None]:
    if p.isidentifier() and p.isascii():
        return p, None, None
    name, note, value = _NAMED.match(p), _NOTE.match(p), _VALUE.match(p)
    noted, valued = (found[1].strip(" ") if found else "" for found in (note, value))
    return name[0] if name else "", note_text(noted) if noted else None, value_text(valued) if valued else None


def python_params(text: str) -> list[tuple]:
    """Name, annotation and default of the parameters in a list: ``python_code.python_params``."""
    parts = top_level(text)
    slash = parts.index("/") + 1 if "/" in parts else 0
    star = next((i for i, p in enumerate(parts) if p[0] == "*" and p[:2] != "**"), len(parts))
    plain = [p for p in parts[slash:star] if p[0] != "*"]
    args = [p for p in parts if _STARRED.match(p)]
    kwargs = [p for p in parts if p[0] == "*" and _STARRED.match(p, 1)]
    return [_described(p) for p in [*plain, *args, *kwargs]]


def _signatures(code: pa.Array) -> pa.Array:
    rows, offsets, results, absent = [], [0], [], []
    for text in code.to_pylist():
        params, result = python_signature(text) if text is not None else ("", "")
        if params:
            rows += python_params(params)
        offsets.append(len(rows))
        result = result.strip(" ")
        results.append(note_text(result) if result else None)
        absent.append(text is None)
    strings = pa.string()
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    params = pa.StructArray.from_arrays([pa.array(c, strings) for c in columns], ["name", "annotation", "default"])
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), params)
    return pa.StructArray.from_arrays([listed, pa.array(results, strings)], ["params", "result"], mask=pa.array(absent, pa.bool_()))


def signatures_of(code: Column) -> Column:
    """``struct(params, result)`` of a Python function, null for a null text; the argument must be a column of a table."""
    return F.arrow_udf(_signatures, SIGNATURE)(F.make_valid_utf8(code))
