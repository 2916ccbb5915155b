"""Extraction from hand-written sources."""

import pytest
from codeloom.functions import brace_code as B
from codeloom.functions import python_code as P
from codeloom.operators import functions as X
from pyspark.sql import functions as F

PY = '''import os
from ..core.db import (connect,
    cursor as cur)

class Outer(Base):
    """doc

def fake(x): text
    """
    @app.route('/x/{y}', methods=["GET", "POST"])
    @login
    def view(self, a: int = 3, *args, k=1, **kw) -> Optional[Dict[str, Any]]:
        x = foo(a, b=2)(3).bar(len(str(a)), **kw)
        return "a".join(self.db.run(x))
# column zero

    class Inner:
        async def load(
            self,
            q: Dict[str, List[int]] = {},
            p='x,y',  # a comment (
        ):
            def deep(): return eval(user)
            return deep()

def one_line(x, /, y: "T", *, z): pass
print(1)
'''

JS = """import a, { b, c as d } from 'm';
import {
  e,
  f
} from "many";
class A extends B {
  constructor(opts) { super(opts);
  }
  async save(data: string, ...rest): Promise<void> {
    // } stray
    return this.q("INSERT {" + data, `x ${a} }
 }`);
  }
}
const f1 = async (u, cb) => {
  return go(u);
};
const f2 = n => n * 2;
const api = {
  handler: function (req, res) {
    return items.map(x => x.id);
  },
  'quoted': (items) => {
    return 1;
  },
  short(a) { return a; },
};
export async function load({ id, b }, retries = 3, ...more): Promise<Map<string, number>> {
  if (out) { return new Foo(out.json()); }
}
app.get('/r', (req, res) => {
  setTimeout(function () { tick(); }, 10);
});
"""

C = '''#include <stdio.h>
#define X(a) { a }
int proto(int a);
struct s { int a; };
/* int fake(void) {
*/
static const char *copy(char *dst, const char *src, int (*cb)(int, void *), char *av[4]) {
    strcpy(dst, "}\\""); // {
    if (x) { o->f(dst); }
}
int one(void) { return 1; } int two(int a){ return g(a); }
static int
multi(int a,
      unsigned char **b)
{
    return sizeof(a);
}
int open_ended(int x) {
   foo(x);
'''


def _rows(spark, text, column):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(F.explode(column(F.col("t"))).alias("r")).select("r.*").collect()


def test_python_spans_classes_and_decorators(spark):
    rows = {r.full_name: r for r in _rows(spark, PY, P.python_blocks)}
    assert {k: (r.line_number, r.end_line) for k, r in rows.items()} == {
        "Outer.view": (12, 14),
        "Outer.Inner.load": (18, 24),
        "Outer.Inner.deep": (23, 23),
        "one_line": (26, 26),
    }
    assert rows["Outer.view"].decorators == ["app.route", "login"]
    assert rows["Outer.view"].first_line == 10
    assert rows["Outer.Inner.load"].kind == "async_function"
    assert rows["one_line"].code == 'def one_line(x, /, y: "T", *, z): pass'


def test_python_signatures(spark):
    df = spark.createDataFrame([(PY,)], "t string")
    rows = (
        df.select(F.explode(P.python_blocks(F.col("t"))).alias("b"))
        .select(
            "b.name",
            P.python_params(F.col("b.code")).alias("params"),
            P.python_return(F.col("b.code")).alias("ret"),
        )
        .collect()
    )
    got = {r["name"]: ([tuple(p) for p in r.params], r.ret) for r in rows}
    assert got["view"] == (
        [("self", None, None), ("a", "int", "3"), ("*args", None, None), ("**kw", None, None)],
        "Optional[...]",
    )
    assert got["load"][0] == [
        ("self", None, None), ("q", "Dict[str, List[int]]", "{}"), ("p", None, "'x,y'"),
    ]
    assert got["one_line"][0] == [("y", "T", None)]


def test_python_calls_and_imports(spark):
    df = spark.createDataFrame([(PY,)], "t string")
    blocks = df.select(F.explode(P.python_blocks(F.col("t"))).alias("b")).where("b.name = 'view'")
    calls = blocks.select(
        F.explode(P.python_calls(F.col("b.skeleton"), F.col("b.first_line"))).alias("c")
    ).select("c.*")
    assert {tuple(c)[:6] for c in calls.collect()} == {
        (10, "route", "app", "method_call", 1, 1),
        (13, "foo", None, "function_call", 1, 1),
        (13, "complex_call", None, "complex_call", 1, 0),
        (13, "bar", "complex_object", "method_call", 1, 1),
        (13, "len", None, "function_call", 1, 0),
        (13, "str", None, "function_call", 1, 0),
        (14, "run", "self.db", "method_call", 1, 0),
        (14, "join", "complex_object", "method_call", 1, 0),
    }
    statements = [(r.line_number, r.statement) for r in _rows(spark, PY, P.python_imports)]
    assert statements == [
        (1, "import os"),
        (2, "from ..core.db import connect"),
        (2, "from ..core.db import cursor as cur"),
    ]


def test_javascript_forms(spark):
    rows = _rows(spark, JS, B.js_blocks)
    assert [(r.name, r.kind, r.line_number, r.end_line) for r in rows] == [
        ("constructor", "method", 7, 8),
        ("save", "method", 9, 13),
        ("f1", "variable_function", 15, 17),
        ("f2", "variable_function", 18, 18),
        ("handler", "property_method", 20, 22),
        ("anonymous_arrow", "arrow", 21, 21),
        ("anonymous_property", "property_method", 23, 25),
        ("short", "property_method", 26, 26),
        ("load", "declaration", 28, 30),
        ("anonymous_arrow", "arrow", 31, 33),
        ("anonymous_expression", "expression", 32, 32),
    ]
    assert rows[2].code == "async (u, cb) => {\n  return go(u);\n}"
    statements = [(r.line_number, r.statement) for r in _rows(spark, JS, B.js_imports)]
    assert statements == [
        (1, "import {a, b, c as d} from 'm'"), (2, "import {e, f} from 'many'"),
    ]


def test_javascript_params(spark):
    df = spark.createDataFrame([(JS,)], "t string")
    rows = (
        df.select(F.explode(B.js_blocks(F.col("t"))).alias("b"))
        .select("b.name", B.js_params(F.col("b.kind"), F.col("b.signature")).alias("p"))
        .collect()
    )
    got = [(r["name"], r.p) for r in rows]
    assert ("save", ["data"]) in got
    assert ("load", ["complex_param", "complex_param", "...more"]) in got
    assert ("handler", []) in got


def test_c_functions(spark):
    rows = _rows(spark, C, B.c_blocks)
    assert [(r.name, r.line_number, r.end_line, r.return_type) for r in rows] == [
        ("copy", 7, 10, "const char *"),
        ("one", 11, 11, "int"),
        ("two", 11, 11, "int"),
        ("multi", 13, 17, "int"),
        ("open_ended", 18, 20, "int"),
    ]
    df = spark.createDataFrame([(rows[0].signature,)], "s string")
    params = df.select(F.explode(B.c_params(F.col("s"))).alias("p")).select("p.*").collect()
    assert [tuple(p) for p in params] == [
        ("dst", "char *", True, False),
        ("src", "const char *", True, False),
        ("cb", "int (*)(int, void *)", True, False),
        ("av", "char *[4]", True, True),
    ]


def test_headers_and_odd_files(spark):
    files = spark.createDataFrame(
        [
            (1, "a.h", "c", "int f(int a);\nextern void g(char *p);\n"),
            (2, "empty.py", "python", ""),
            (3, "crlf.py", "python", "def a():\r\n    return 1\r\n\r\nx = 2\r\n"),
            (4, "open.c", "c", "void f(void) {\n  if (1) {\n"),
        ],
        "file_id long, path string, lang string, content string",
    )
    fns = X.extract_functions(files).select("fn_id", "name", "line_number", "end_line").collect()
    assert sorted(tuple(r) for r in fns) == [("3#1", "a", 1, 2), ("4#1", "f", 1, 3)]
    quality = {r.file_id: tuple(r)[2:] for r in X.parse_quality(files).collect()}
    assert quality[4] == (3, 2, 2, 1, 1, 0) and quality[1] == (3, 0, None, 3, 0, 0)


def test_long_literals_do_not_overflow(spark):
    """Megabyte literals, escapes and deep nesting in one file."""
    blob = '"' + "\\x41" * 200_000 + '"'
    text = f"char *a = {blob};\n" + "int f(void) {\n" + "{" * 5000 + "}" * 5000 + "\n}\n"
    rows = _rows(spark, text, B.c_blocks)
    assert [(r.name, r.line_number, r.end_line) for r in rows] == [("f", 2, 4)]
    py = '"""' + "x'\n" * 100_000 + '"""\ndef f():\n    return 1\n'
    assert [r.line_number for r in _rows(spark, py, P.python_blocks)] == [100_002]


# --- shapes outside the templates -----------------------------------------------


@pytest.mark.parametrize(
    ("code", "names"),
    [
        ("int f(a, b) int a; char *b; {\n return a;\n}\n", ["f"]),
        ("main() {\n return 0;\n}\n", ["main"]),
        ("_Atomic(int) g(void) {\n return 1;\n}\n", ["g"]),
        ("TYPE(x) m(int a) {\n return a;\n}\n", ["m"]),
        (" ".join(["static"] * 16) + " int s(void) {\n return 1;\n}\n", ["s"]),
        ("int d(int (*cb)(int (*in)(int (*z)(int)))) {\n return 1;\n}\n", ["d"]),
        ('__attribute__((section("x"))) int a(void) {\n return 1;\n}\n', ["a"]),
        ("#define M(x) do { \\\n  x; \\\n} while (0)\nint b(void) {\n return 1;\n}\n", ["b"]),
        ("#define OPEN \\\n  {\nint c(void) {\n return 1;\n}\nint e(void) {\n return 2;\n}\n", ["c", "e"]),
        ("int p(int a);\nint q;\nstruct s { int x; };\nint t[] = { 1 };\n", []),
    ],
)
def test_c_definitions(spark, code, names):
    row = spark.createDataFrame([(code,)], "code string").select(B.c_blocks(F.col("code")).alias("b")).first()
    assert [b["name"] for b in row["b"]] == names
    for b in row["b"]:
        assert code.split("\n")[b["end_line"] - 1] == "}"


def test_continued_and_wide_imports(spark):
    py = "from a import \\\n    b, c\nfrom d import (\n  e,\n  f as g,\n)\nimport h\n"
    js = "import {\n  a,\n  b as c\n} from 'm';\nimport {d} from 'n';\nconst {x, y} = require('z');\n"
    row = (
        spark.createDataFrame([(py, js)], "py string, js string")
        .select(P.python_imports(F.col("py")).alias("py"), B.js_imports(F.col("js")).alias("js"))
        .first()
    )
    assert [(r["line_number"], r["name"] or r["module"]) for r in row["py"]] == [
        (1, "b"), (1, "c"), (3, "e"), (3, "f"), (7, "h")
    ]
    assert [(r["line_number"], r["statement"]) for r in row["js"]] == [
        (1, "import {a, b as c} from 'm'"), (5, "import {d} from 'n'"), (6, "const {x, y} = require('z')"),
    ]


def test_imports_are_linear(spark):
    """Eight thousand multi-line imports; a quadratic step would take minutes."""
    import time

    one = "import {\n  alpha,\n  beta\n} from 'module';\n"
    frame = spark.createDataFrame([(one * 8000,)], "js string").select(F.size(B.js_imports(F.col("js"))).alias("n"))
    start = time.perf_counter()
    assert frame.first()["n"] == 8000
    assert time.perf_counter() - start < 40


# --- code in literals ---------------------------------------------------------------


def _python(spark, text):
    """Per function: params, result and calls."""
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(P.python_blocks(F.col("t"))).alias("b"))
    rows = df.select(
        "b.name", "b.line_number", "b.end_line", P.python_params(F.col("b.code")).alias("params"),
        P.python_return(F.col("b.code")).alias("ret"), P.python_calls(F.col("b.skeleton"), F.col("b.first_line")).alias("calls"),
    )
    return {r["name"]: r for r in rows.collect()}


INTERPOLATED = """def f(b, d):
    x = f"{h(b)}: {d['k(']:>{w(1)}} {{no(2)}} {y!r:{'(' }}"
    text = '''not {code(1)}''' + "{neither(2)}"  # f"{comment(3)}"
    return f'''a
{g(x)}
def no(): {k(f"{m(1)}", [n(2), 3])}
''' + f"{f"{inner(1)}"}" + rf'{raw(1)}\\d'

def after(a):
    return f"{a:%Y(}" or last(a)
"""


def test_calls_inside_f_strings(spark):
    got = _python(spark, INTERPOLATED)
    assert [(r["line_number"], r["end_line"]) for r in got.values()] == [(1, 7), (9, 10)]
    assert [(c["line_number"], c["name"], c["args_count"]) for c in got["f"]["calls"]] == [
        (2, "h", 1), (2, "w", 1), (5, "g", 1), (6, "m", 1), (6, "n", 1), (6, "k", 2), (7, "inner", 1), (7, "raw", 1),
    ]
    assert [c["name"] for c in got["after"]["calls"]] == ["last"]


def _js_calls(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(B.js_blocks(F.col("t"))).alias("b"))
    rows = df.select("b.name", "b.line_number", "b.end_line", "b.signature", B.js_call_names(F.col("b.skeleton")).alias("c")).collect()
    return [(r["name"], r["line_number"], r["end_line"], r["signature"], r["c"]) for r in rows]


def test_calls_inside_templates(spark):
    text = (
        "function t(xs) {\n  // `${comment(1)}`\n  const s = 'no ${plain(1)}' + tag`x ${h(1)}`;\n"
        "  return `<ul>${xs.map(x => `<li ${ {a: k(x)}.a }>${`deep ${inner(x)}`}\n</li>`).join(`\n`)}`;\n}\n"
        "const after = () => {\n  return go();\n};\n"
    )
    got = _js_calls(spark, text)
    assert [(n, a, b) for n, a, b, _, _ in got] == [("t", 1, 7), ("anonymous_arrow", 4, 4), ("after", 8, 10)]
    assert got[0][4] == ["h", "map", "k", "inner", "join"] and got[2][4] == ["go"]


def test_code_in_literals_is_linear(spark):
    """A megabyte of literals with interpolations; copies that grow with the text would take minutes."""
    import time

    py = "def f(x):\n    return [\n" + "        f'a {h(x)} b',\n" * 40_000 + "    ]\n"
    js = "const f = (x) => {\n  return [\n" + "    `a ${h(x)} b`,\n" * 40_000 + "  ];\n};\n"
    start = time.perf_counter()
    (block,) = _rows(spark, py, P.python_blocks)
    assert block.end_line == 40_003 and block.skeleton.count("h(x)") == 40_000
    (block,) = _rows(spark, js, B.js_blocks)
    assert block.end_line == 40_004 and block.skeleton.count("h") == 40_000
    assert time.perf_counter() - start < 60


def test_both_readings_of_literals_agree(spark):
    """Plain interpolations are taken out by passes over the text; the fold must leave the same."""
    import random

    from codeloom.functions import lexing as L

    rnd = random.Random(5)
    py = ['f"a {x(1)} b"', "rf'{y}'", "'no {z(1)}'", '"it\'s"', "# don't {w}\n", "go(1)", "{1: 2}", " + ", "\n", "F'{a}{b[0]}'", "of"]
    js = ["`a ${x(1)} b`", "'no ${z(1)}'", '"it\'s"', "// don't ${w}\n", "/* `${v}`\n */", "go(1)", "{a: 1}", " + ", "\n", "``", "`\n${a}${b}$`"]
    rows = [("".join(rnd.choice(py) + rnd.choice(["", " "]) for _ in range(12)), "".join(rnd.choice(js) for _ in range(12))) for _ in range(300)]
    df = spark.createDataFrame(rows, "py string, js string").select(
        L.python_skeleton(F.col("py")).alias("a"), L._interpolated(F.col("py"), L._PY_TOKENS, "[\"'#]", L._python_rule).alias("b"),
        L.js_skeleton(F.col("js")).alias("c"), L._interpolated(F.col("js"), L._JS_TOKENS, "[\"'`]|/[*/]", L._js_rule).alias("d"),
    )
    for r in df.collect():
        assert r.a == r.b and r.c == r.d


# --- signatures of any depth ------------------------------------------------------------


def _nested(depth, inner="1"):
    return "".join(f"g{i}(" for i in range(depth)) + inner + ")" * depth


def test_signatures_of_any_depth(spark):
    deep = _nested(60)
    py = (
        f"def a(x={deep}, *, k=')', **kw) -> Dict[str, Dict[str, Dict[str, Dict[str, Tuple[int, str]]]]]:\n    return go(1)\n"
        "async def b(t={(1): 2, 'x):': (3, 4)},  # a comment ):\n            u: 'T(' = \"it\\\"s)\", v=[(1)]) -> Optional[List[int]]:\n    pass\n"
        "def c(p: Callable[[int], str] = None, q: Union[int, None,] = 1, r: A[b.c] = 2, s: int | None = 3) -> x.Y: pass\n"
    )
    got = _python(spark, py)
    assert [tuple(p) for p in got["a"]["params"]] == [("x", None, "complex_default"), ("**kw", None, None)]
    assert got["a"]["ret"] == "Dict[str, Dict[str, Dict[str, Dict[str, Tuple[int, str]]]]]"
    assert [tuple(p) for p in got["b"]["params"]] == [("t", None, "{}"), ("u", "T(", "'it\\\"s)'"), ("v", None, "[]")]
    assert got["b"]["ret"] == "Optional[...]"
    assert [tuple(p)[:2] for p in got["c"]["params"]] == [
        ("p", "Callable[complex_annotation, str]"), ("q", "Union[int, None]"), ("r", "A[...]"), ("s", "complex_annotation"),
    ]
    assert got["c"]["ret"] == "x.Y"
    js = (
        f"const f = (a = {deep}, b) => {{\n  return h();\n}};\n"
        "function r(run, wait = function () { return p(3); }, limit = (2)) {\n  return run(wait);\n}\n"
        f"class A {{\n  save(x = {deep}) {{\n    return q(x);\n  }}\n}}\n"
        f"app.get('/', async (req, res = {deep}) => {{\n  done();\n}});\n"
    )
    found = _js_calls(spark, js)
    assert [(n, a, b) for n, a, b, _, _ in found] == [
        ("f", 1, 3), ("anonymous_expression", 4, 4), ("r", 4, 6), ("save", 8, 10), ("anonymous_arrow", 12, 14),
    ]
    assert found[2][3] == "run, wait = function () { return p(3); }, limit = (2)" and found[3][4][-1] == "q"
    params = "int " + "".join(f"(*p{i})(int, " for i in range(40)) + "char *z" + ")" * 40
    c = f"int f({params}) {{\n  return g(1);\n}}\nint h(void) {{\n  return 2;\n}}\n"
    assert [(r.name, r.signature, r.end_line) for r in _rows(spark, c, B.c_blocks)] == [("f", params, 3), ("h", "void", 6)]


# --- conditional directives ----------------------------------------------------------------


@pytest.mark.parametrize(
    ("code", "found"),
    [
        # Two heads share a body.
        ("#if A\nint g(void) {\n#else\nint g(int x) {\n#endif\n  if (y) { z(); }\n}\nint last(void) {\n}\n",
         [("g", 2, 7), ("g", 4, 7), ("last", 8, 9)]),
        # A brace that one branch opens and one of a later directive closes.
        ("int a(void) {\n#ifdef A\n  if (x) {\n#endif\n  y();\n#ifdef A\n  }\n#endif\n}\nint b(void) {\n}\n", [("a", 1, 9), ("b", 10, 11)]),
        ("int a(void) {\n#ifndef A\n  x();\n#elif B\n  if (x) {\n#else\n  while (y) {\n#endif\n  y();\n#if !A\n  }\n#endif\n}\nint b(void) {\n}\n",
         [("a", 1, 13), ("b", 14, 15)]),
        # Directives in a parameter list, and around heads with the brace behind them.
        ("int p(int a,\n#ifdef B\n  int b,\n#endif\n  int c) {\n}\n", [("p", 1, 6)]),
        ("#ifdef A\nint q(int a)\n#else\nint q(long a)\n#endif\n{\n}\nint r(void) {\n}\n", [("q", 4, 7), ("r", 8, 9)]),
        # Nested ones, and a function in each branch.
        ("#if A\n# if B\nint s(void) {\n}\n# else\nint s(int a) {\n}\n# endif\n#else\nint t(void) {\n}\n#endif\nint u(void) {\n}\n",
         [("s", 3, 4), ("s", 6, 7), ("t", 10, 11), ("u", 13, 14)]),
        # More #else and #endif than #if.
        ("#else\n#endif\n#endif\nint v(void) {\n}\n", [("v", 4, 5)]),
    ],
)
def test_conditional_directives(spark, code, found):
    rows = _rows(spark, code, B.c_blocks)
    assert [(r.name, r.line_number, r.end_line) for r in rows] == found
    assert not any(chr(i) in r.skeleton + r.signature for r in rows for i in range(0x0E, 0x19))


def test_many_functions_are_linear(spark):
    """Ten thousand functions in one file; a step that copies what it has found would take minutes."""
    import time

    start = time.perf_counter()
    code = "".join(f"int f{i}(int a) {{\n  return g(a);\n}}\n" for i in range(10_000))
    df = spark.createDataFrame([(code,)], "t string").select(B.c_blocks(F.col("t")).alias("b"))
    last = df.select(F.size("b").alias("n"), F.get("b", F.lit(9_999))["end_line"].alias("end")).first()
    assert tuple(last) == (10_000, 30_000)
    py = "".join(f"def f{i}(a):\n    return g(a)\n" for i in range(10_000))
    df = spark.createDataFrame([(py,)], "t string").select(P.python_blocks(F.col("t")).alias("b"))
    assert df.select(F.size("b")).first()[0] == 10_000
    assert time.perf_counter() - start < 60


# --- recovery ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("lang", "code", "quality", "names"),
    [
        # lines, open brackets, first broken line, lines before it, functions before and from it on
        ("python", "def a():\n    return 1\nx = (1, [2\ndef b():\n    return 2\n", (6, 2, 3, 2, 1, 1), ["a", "b"]),
        ("python", "def a():\n    return (1]\ndef b(x):\n    return 2", (4, 0, 2, 1, 1, 1), ["a", "b"]),
        ("python", "def a():\n    return f'{x(1)}' + '('\n", (3, 0, None, 3, 1, 0), ["a"]),
        ("python", "x = (1,\n\n", (3, 1, 1, 0, 0, 0), []),
        ("c", "int a(void) {\n  if (x) {\n}\nint b(int y) {\n  return y;\n}\n", (7, 1, 1, 0, 0, 2), ["a", "b"]),
        ("c", "#if A\nint a(void) {\n#else\nint a(int x) {\n#endif\n}\n", (7, 0, None, 7, 2, 0), ["a", "a"]),
        ("c", 'extern "C" {\nint a(void) {\n}\n}\n', (5, 0, None, 5, 1, 0), ["a"]),
        ("javascript", "function a() {\n  b(1];\n}\nfunction c() {\n}\n", (6, 0, 2, 1, 1, 1), ["a", "c"]),
    ],
)
def test_first_broken_line(spark, lang, code, quality, names):
    files = spark.createDataFrame([(1, "p", lang, code)], "file_id long, path string, lang string, content string")
    assert tuple(X.parse_quality(files).first())[2:] == quality
    assert [r["name"] for r in X.extract_functions(files, ["name"]).collect()] == names


# --- SQL built in calls ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("argument", "concat"),
    [
        ('"a" + x', True), ('x + "a"', True), ('x + y + "a"', True), ('"a" + x + y', False), ('f"{x}"', True), ('"a" f"{x}" "b"', True),
        ('"a" "b" + x', True), ("x + y", False), ('x, "a" + y', True), ('k="a" + y', False), ('*["a" + y]', False),
        ('"a" % x', False), ('"a" * 2 + x', False), ('("a" + x)', True), ('("a"\n "b") + x', True), ('"a" + x if y else z', False),
        ('"a" + x == z', False), ('x - "a"', False), ('"a".join(x) + y', False), ('lambda: "a" + x', False), ('b"a" + x', False), ('r"a" + x', True),
        ('[f"{x}"]', False), ('g("a" + x)', False), ("", False), ('f"{x}" + y', False), ('f"{x}".format(y)', False),
    ],
)
def test_string_concatenation_per_call(spark, argument, concat):
    import ast

    code = f"def f(x):\n    return db.execute({argument})\n"
    ast.parse(code)
    calls = _python(spark, code)["f"]["calls"]
    (call,) = [c for c in calls if c["name"] == "execute"]
    assert call["string_concat"] is concat


def test_walk_and_fold_find_the_same_functions(spark):
    """A scan walks over marks and lines in Arrow batches, where a fold was interpreted anew at every token."""
    import random

    from codeloom.operators import functions as X

    rnd = random.Random(11)
    odd = {
        "python": (PY, ["\tdef g():\n", "  @w\n", "@x.y(\n", ")\n", "]\n", '"""\n', "class B:\n", "async  def q(a):\n", "é = 1\n", "\n"]),
        "javascript": (JS, ["{", "}", "(", ")", "x => ", "(a = (c) => { d }) => {", "function () {", "`", "\n", "get b() {"]),
        "c": (C, ["{", "}", "#if A\n", "#else\n", "#endif\n", "int f(int a) {\n", "static g(void)\n{\n", "  int h(x) {\n", ";", "/*"]),
    }
    rows = [(lang, None) for lang in odd] + [("cobol", "def f(): pass\n")]
    for lang, (text, pieces) in odd.items():
        pieces = pieces + text.splitlines(True)
        rows += [(lang, text)] + [(lang, "".join(rnd.choice(pieces) for _ in range(15))) for _ in range(40)]
    files = spark.createDataFrame(
        [(i, f"p{i}", lang, text) for i, (lang, text) in enumerate(rows)], "file_id long, path string, lang string, content string"
    )
    walked = X.extract_functions(files)
    assert "ArrowEvalPython" in walked._jdf.queryExecution().executedPlan().toString()
    lang, text = F.col("lang"), F.col("content")
    folded = files.select("file_id", F.posexplode(
        F.when(lang == "python", P.python_blocks(text)).when(lang == "javascript", B.js_blocks(text)).when(lang == "c", B.c_blocks(text))
    ).alias("n", "b")).select("file_id", (F.col("n") + 1).alias("fn_no"), "b.*")
    names = folded.columns
    assert sorted(map(str, walked.select(names).collect())) == sorted(map(str, folded.collect()))
