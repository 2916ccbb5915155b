"""Walks give what the folds of the same name give, and a plan computes only the fields that are read."""

import random

from pyspark.sql import functions as F

from codeloom.functions import brace_code, recovery, spans, walks
from codeloom.functions import lexing as L
from codeloom.functions import python_code as P
from codeloom.functions.folds import pair_index
from codeloom.operators import functions as X

PY = [
    'f"a {x(1)} b"', "rf'{y!r:>{w}}'", "'no {z(1)}'", '"it\'s"', "# don't {w}\n", "go(1)", "{1: 2}", " + ", "\n", "F'{a}{b[0]}'",
    "of", 'f"""a\n{b}', '"""', "'''", 'f"{d["k"]}"', "f'{{no}} {x:{w}}'", "(", ")", "[", "]", "}", "{", ":", "f", '"', "'",
]
JS = [
    "`a ${x(1)} b`", "'no ${z(1)}'", '"it\'s"', "// don't ${w}\n", "/* `${v}`\n */", "go(1)", "{a: 1}", " + ", "\n", "``",
    "`\n${a}${b}$`", "`x ${f({a: `y ${b}`})}`", "${", "}", "{", "`", "/*", "*/", "/", "'",
]
CALLS = [
    "run", "a.b.go(", ".then(", "(", ")", "[", "]", "{", "}", ",", "=", "==", "**", "*", '"', "'", "\x02", "f", "rb", "\n", " + ", "-",
    "1", "not (", "in (", "def f(", "class ", "x", "if (", " ",
]
STRUCTURE = ["\n", "(", ")", "[", "]", "{", "}", "\x0e", "\x0f", "\x10", "def f(a):\n", "\nint f(int a) {\n", 'extern "{', "x"]


def _texts(pieces, rows, length, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(length))) for _ in range(rows)]


def test_literals_by_walk_and_by_fold_agree(spark):
    rows = [*zip(_texts(PY, 400, 30), _texts(JS, 400, 30), strict=True), (None, None), ("f ", "")]
    table = spark.createDataFrame(rows, "py string, js string")
    found = table.select(
        "py", "js",
        L._interpolated(F.col("py"), L._PY_TOKENS, "[\"'#]", L._python_rule).alias("py_fold"),
        L._interpolated(F.col("js"), L._JS_TOKENS, "[\"'`]|/[*/]", L._js_rule).alias("js_fold"),
        walks.literals_of(F.lit("python"), F.col("py")).alias("py_walk"),
        walks.literals_of(F.lit("javascript"), F.col("js")).alias("js_walk"),
    ).collect()
    for r in found:
        if r.py is None:
            assert r.py_walk is None and r.js_walk is None
        else:
            assert (r.py_walk, r.js_walk) == (r.py_fold, r.js_fold), (r.py, r.js)


def test_calls_by_walk_and_by_fold_agree(spark):
    table = spark.createDataFrame([(t, n) for n, t in enumerate(_texts(CALLS, 600, 120), 1)], "s string, n int")
    found = table.select(
        "s", P.python_calls(F.col("s"), F.col("n")).alias("fold"), P.called(F.col("s"), F.col("n")).alias("walk")
    ).collect()
    assert sum(len(r.walk) for r in found) > 500
    for r in found:
        assert r.walk == r.fold, r.s


def test_structure_by_walk_and_by_fold_agree(spark):
    langs = ["python", "javascript", "c", "other"]
    table = spark.createDataFrame(
        [(langs[n % 4], t) for n, t in enumerate(_texts(STRUCTURE, 400, 30))] + [("c", None)], "lang string, s string"
    )
    lang, s = F.col("lang"), F.col("s")
    fold = F.lit(None).cast(walks.BALANCE)
    for name, counted in (("python", "()[]{}"), ("javascript", "{}"), ("c", "{}")):
        fold = F.when(lang == name, recovery._scan(s, counted, recovery._HEADS.get(name))).otherwise(fold)
    found = table.select(lang, s, fold.alias("fold"), recovery.structure_of(lang, s).alias("walk")).collect()
    for r in found:
        assert r.walk == (None if r.s is None else r.fold), (r.lang, r.s)


def test_marks_in_marks(spark):
    table = spark.createDataFrame([(t,) for t in _texts(["\x05", "\x07", "\x06", "\x04", "a", "{", "\n"], 300, 25)], "s string")
    for r in table.select("s", brace_code._outer(F.col("s")).alias("fold")).collect():
        assert spans.unnested(r.s) == r.fold, r.s


def test_only_fields_that_are_read_are_computed(spark):
    files = spark.createDataFrame(
        [(1, "a.py", "python", "def f(a):\n    return f'{g(\"x\")}'\n"), (2, "b.js", "javascript", "function f(a) { return `${g({b: 1})}` }"),
         (3, "c.c", "c", "static int f(int a) {\n  return g(a);\n}\n"), (4, "d.py", "python", None)],
        "file_id long, path string, lang string, content string",
    )
    whole = {r.fn_id: r for r in X.extract_functions(files).collect()}
    assert sorted(whole) == ["1#1", "2#1", "3#1"]
    for fields in (["name"], ["line_number", "code"], ["skeleton"], ["return_type", "signature"]):
        some = X.extract_functions(files, fields)
        assert {r.fn_id: tuple(r[f] for f in fields) for r in some.collect()} == {
            k: tuple(r[f] for f in fields) for k, r in whole.items()
        }
    # The source of a function is cut out by slices of its lines.
    slices = [
        X.extract_functions(files, f)._jdf.queryExecution().optimizedPlan().toString().count("slice(")
        for f in (["name"], ["name", "code"])
    ]
    assert slices[0] < slices[1]


FORMS = [
    "class A ", "const f = ", "let $x : T = ", "var g=", "async ", "async", "function ", "function h", "(a)", "(a, b)", "((c) => d)", " => ", "=>",
    "\n  =>\n", "{", "}", "\x05", "x", "$y", "n: ", "'k': ", ": T", "  get ", "  m", "  static async m ", "if ", "\n", " ", ";", "return 1", ") ", "(",
]


def test_searches_before_passes_lose_no_header(spark):
    table = spark.createDataFrame([(t,) for t in _texts(FORMS, 6000, 14)], "s string").select(pair_index(F.col("s")).alias("s"))
    columns = []
    for n, (word, sure, pattern, _) in enumerate(brace_code._js_forms()):
        sought = F.col("s").contains(word) & (F.col("s").rlike(sure) if sure else F.lit(True))
        columns += [
            F.count_if(F.col("s").rlike(pattern)).alias(f"n{n}"), F.count_if(F.col("s").rlike(pattern) & ~sought).alias(f"lost{n}")
        ]
    found = table.agg(*columns).first().asDict()
    assert all(c > 0 for name, c in found.items() if name.startswith("n")), found
    assert not any(c for name, c in found.items() if name.startswith("lost")), found
    # Most texts with an arrow are not passed over once for each form with one.
    assert sum(bool(sure) for _, sure, _, _ in brace_code._js_forms()) >= 8


def test_long_coded_literals_are_found_from_their_quotes(spark):
    table = spark.createDataFrame([(t,) for t in _texts([*PY, "rf", "Fr", "f'''", 'xf"""', "é", "\n"], 600, 12)], "s string")
    plain = F.col("s").rlike("\\b(?:[fF][rR]?|[rR][fF])(?:\"{3}|'{3})")
    found = table.select("s", plain.alias("plain"), F.col("s").rlike(L._PY_LONG_CODED).alias("quick")).collect()
    assert sum(r.plain for r in found) > 50
    for r in found:
        assert r.plain == r.quick, r.s


SIGNED = [
    "def f(", "async def g[T: (int)](", "a", "b: int", "c=1", ", ", ",", "*", "*args", "**kw", "/", ": Dict[str, List[Opt['x']]]", ": a.B", ": (x)",
    ': "T | None"', "='a,(b'", '="it\\\'s \\"q\\" \\\\"', "=[1, 2]", "={1: (2)}", "={}", "=(1, (2, (3, (4, (5, 6)))))", "= lambda x: y", "(", ")", "[", "]", "{", "}",
    "# no, ) 'x\n", "\n    ", " ", ")", "):", ") -> None:", ") -> 'A(':", ") -> Tuple[str, Dict[str, int]]:", ") -> f(x)[1]:\n", " pass", '"""d\n"""', "'", '"', "\u2028", "\r",
]


def test_signatures_by_walk_and_by_fold_agree(spark):
    rnd = random.Random(11)
    some = [t if n % 4 else "def f(a, " + t for n, t in enumerate(_texts(SIGNED, 900, 14, 5))]
    closed = ["def f(" + ", ".join(rnd.sample(SIGNED[2:21], 4)) + rnd.choice(SIGNED[32:37]) for _ in range(900)]
    rows = [(t,) for t in [*some, *closed, None, "", "def f(a):", "def f(a: x = 'y') -> z: # w"]]
    found = spark.createDataFrame(rows, "code string").select(
        "code", P.python_params(F.col("code")).alias("params"), P.python_return(F.col("code")).alias("result"),
        walks.signatures_of(F.col("code")).alias("walk"),
    ).collect()
    assert sum(len(r.params or ()) for r in found) > 2000 and sum(r.result is not None for r in found) > 200
    for r in found:
        if r.code is None:
            assert r.walk is None and r.params is None and r.result is None
        else:
            assert (r.walk.params, r.walk.result) == (r.params, r.result), r.code


def test_parameters_are_read_without_folds_over_code(spark):
    table = spark.createDataFrame([(1, "a.py", "python", "def f(a: x = 1) -> y:\n  pass\n")], "file_id int, path string, lang string, content string")
    fns = X.with_params(X.extract_functions(table, ["name", "kind", "decorators", "signature", "return_type", "code"]))
    assert [(p.name, p.annotation, p.default) for r in fns.collect() for p in r.params] == [("a", "x", "1")]
    plan = fns._jdf.queryExecution().optimizedPlan().toString()
    assert "_signatures(" in plan


def test_an_import_line_is_read_once_for_its_names():
    listed = P.python_imports(F.col("t"), F.col("s"))._jc.toString()
    assert listed.count("from[ \\t]+(\\.*)") <= 4


def test_called_names_are_sorted_without_a_comparator():
    assert "sort_array" in X.call_names(F.col("lang"), F.col("s"))._jc.toString()
