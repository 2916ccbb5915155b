"""Rules, scores, verdicts, reports, file sources, streams and build records."""

import json

import pytest
from codeloom.functions import normalize as N
from codeloom.operators import buildlog as L
from codeloom.operators import risk as R
from codeloom.operators import rules as U
from codeloom.plans import reports as Q
from codeloom.plans import scan as S
from codeloom.sources import files as Z
from codeloom.streaming import incremental as I
from pyspark.sql import functions as F

SOURCES = {
    "pkg/a.py": "def run(user_input):\n    return eval(user_input)\n\ndef ok(x):\n    return x\n",
    "pkg/b.py": 'def find(uid):\n    q = f"SELECT * FROM t WHERE id = {user_id}"\n    return q\n',
    "web/c.js": "function go(code) {\n  return eval(req.user.code);\n}\n",
    "src/d.c": "int f(int a) {\n    return a;\n}\n",
    "notes.txt": "not code\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in SOURCES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "pkg/latin.py").write_bytes("# café\ndef l(): pass\n".encode("latin-1"))
    (root / "src/e.c.i").write_text(N.MARKER + " note\nint g(void) {\n  return 1;\n}\n")
    return root


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_discovery_decoding_and_scan(spark, tree):
    files = Z.source_table(Z.scan_source_files(spark, str(tree)))
    by_name = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert set(by_name) == {"a.py", "b.py", "c.js", "d.c", "latin.py", "e.c.i"}
    assert by_name["latin.py"].encoding == "latin1" and "café" in by_name["latin.py"].content
    assert by_name["e.c.i"].lang == "c"
    assert Z.scan_preprocessed(spark, str(tree)).count() == 1
    found = {(r.file.rsplit("/", 1)[1], r.function, r.vulnerability_type, r.confidence)
             for r in S.findings(files).collect()}
    assert found == {
        ("a.py", "run", "code_injection", 0.9),
        ("b.py", "find", "sql_injection", 0.9),
        ("c.js", "go", "code_injection", 0.9),
    }
    assert S.findings(files, inclusive=False).count() == 0
    summary = Q.scan_summary(files, S.findings(files)).first()
    assert tuple(summary) == (6, 3, 3)


def test_own_rules(spark, tree):
    files = Z.source_table(Z.scan_source_files(spark, str(tree)))
    _, hits = S.scan(files, rules=[("own", r"return\s+x")])
    assert {(r.function, r.rule_id) for r in hits.collect()} >= {("ok", "own"), ("run", "xss_4")}


def test_stream_equals_batch(spark, tree):
    batch = Z.source_table(Z.scan_source_files(spark, str(tree)))
    raw = (
        spark.readStream.format("binaryFile")
        .schema(spark.read.format("binaryFile").load(str(tree / "pkg")).schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{py,js,c,i}")
        .load(str(tree))
        .select("path", "content")
    )
    streamed = I.scan_as_stream(spark, Z.source_table(raw))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, S.findings(batch).collect()))


def test_incremental(spark, tree):
    files = Z.source_table(Z.scan_source_files(spark, str(tree)))
    seen = I.manifest(files.where(~F.col("path").endswith("d.c"))).withColumn(
        "sha", F.when(F.col("path").endswith("a.py"), "old").otherwise(F.col("sha"))
    )
    got = {(r.path.rsplit("/", 1)[1], r.change) for r in I.changed_paths(files, seen).collect()}
    assert got == {("d.c", "new"), ("a.py", "changed")}
    assert I.unscanned(files, seen).count() == 2


def test_reports_round_trip(spark, tree, tmp_path):
    files = Z.source_table(Z.scan_source_files(spark, str(tree)))
    found = S.findings(files)
    Q.write_reports(found, str(tmp_path / "out"))
    back = Z.read_findings_json(spark, str(tmp_path / "out"))
    assert back.count() == 3
    rows = {r.section: r for r in Q.scan_report(files, found).collect()}
    assert json.loads(rows["scan_summary"].payload)["total_vulnerabilities"] == 3
    assert _one(spark, "x.c.i", Q.report_path) == "x.c.analysis.json"
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".crc")
    root = str(tree).lstrip("/")
    assert [n.rsplit(root + "/", 1)[1] for n in names] == ["pkg/a.analysis.json", "pkg/b.analysis.json", "web/c.analysis.json"]
    good, bad = Z.quarantine(
        spark.createDataFrame(
            [("a.py", "x"), ("b.txt", "x"), ("c.c", None), ("d.js", "a\x00b")],
            "path string, content string",
        )
    )
    assert good.count() == 1 and {r.error for r in bad.collect()} == {
        "unsupported extension", "unreadable", "not text",
    }


@pytest.mark.parametrize(
    "text, score",
    [("0.75", 0.75), ("1.5", 1.0), ("2.0", 0.0), ("10", 0.5), ("unsafe", 0.2), ("", 0.5),
     ("Critical!", 0.8), ("moderate", 0.5), (None, 0.5)],
)
def test_risk_answers(spark, text, score):
    assert _one(spark, text, R.risk_score) == score


@pytest.mark.parametrize(
    "text, accepted, vulnerable, confidence",
    [
        ('{"vulnerable": true, "confidence": 0.8, "explanation": "x"}', True, True, 0.8),
        ('so {"vulnerable": true, "confidence": 7, "explanation": "x"} bye', True, True, 1.0),
        ('{"vulnerable": "false", "confidence": "0.6", "explanation": "x"}', True, False, 0.6),
        ('{"vulnerable": null, "confidence": -1, "explanation": null}', True, False, 0.0),
        ('{"vulnerable": true, "confidence": 0.8}', False, None, None),
        ('{"vulnerable": true, "confidence": "no", "explanation": "x"}', False, None, None),
        ('{"vulnerable": tr', False, None, None),
        ("} nothing {", False, None, None),
        ("", False, None, None),
    ],
)
def test_verdict_answers(spark, text, accepted, vulnerable, confidence):
    df = spark.createDataFrame([(text,)], "verdict_text string")
    row = R.parse_verdicts(df).first()
    assert row.accepted is accepted
    if accepted:
        assert (row.vulnerable, row.confidence, row.severity) == (vulnerable, confidence, "medium")


def test_gate_is_inclusive_by_choice(spark):
    df = spark.createDataFrame([(0.5,), (0.31,), (0.3,), (0.51,)], "s double")
    tiers = df.select(R.risk_tier(F.col("s")), R.risk_tier(F.col("s"), False)).collect()
    assert [tuple(t) for t in tiers] == [
        ("analyse", "medium"), ("medium", "medium"), ("low", "low"), ("analyse", "analyse"),
    ]


def test_normalisation(spark):
    assert _one(spark, N.MARKER + " x\ncode", N.drop_marker_line) == "code"
    assert _one(spark, "code\n" + N.MARKER, N.drop_marker_line) == "code\n" + N.MARKER
    text = "int a; // x\n/* b\n c */ int d;\n\nint e;"
    assert _one(spark, text, N.strip_c_comments) == "int a; \n int d;\nint e;"
    text = "#include <a>\n#if X\n  #define Y\nint a;\n#undef Z"
    assert _one(spark, text, N.drop_c_directives) == "#if X\nint a;\n#undef Z"
    assert _one(spark, "int restricted; char *restrict p;", N.strip_gcc_attributes) == (
        "int restricted; char *p;"
    )
    assert _one(spark, "fd_set s; FD_ZERO(&s); x = FD_ISSET(0, &s);", N.stub_fd_macros) == (
        "int s; ; x = 1;"
    )
    assert _one(spark, "f(a: string, b: Foo): void {", N.strip_ts_types) == "f(a, b): void {"
    assert _one(spark, "f(a: any): void{", N.strip_ts_types) == "f(a){"


def test_c_flags_and_secrets(spark):
    df = spark.createDataFrame(
        [("char *p = malloc(4); strcpy(p, q);",), ("printf(msg); if (*p==1) {}",)], "c string"
    )
    flags = U.c_security_flags(F.col("c"))
    rows = df.select(*[v.alias(k) for k, v in flags.items()]).collect()
    assert rows[0].buffer_overflow_risk and rows[0].memory_leak_risk and rows[0].null_pointer_risk
    assert rows[1].format_string_risk and not rows[1].null_pointer_risk
    assert _one(spark, "api_key = 'a1'\nPASSWORD == \"b\"", U.hardcoded_secrets) == [
        "api_key = 'a1'", 'PASSWORD == "b"',
    ]


def test_build_arguments(spark):
    df = spark.createDataFrame(
        [(1, "/w/p", ["-I", "-D", "a.c", "-include", "b.c", "-std=c11", "-Ix", "-o", "c.o", "-U"])],
        "record_id long, cwd string, argv array<string>",
    )
    assert [r.source for r in L.compile_sources(df).collect()] == ["a.c"]
    flags = [r.flag for r in L.preprocessor_flags(df).orderBy("flag_no").collect()]
    assert flags == ["-I", "-D", "-include", "b.c", "-std=c11", "-Ix", "-U"]
    path = lambda p: _one(spark, p, lambda c: L.preprocessed_path(c, "/w/p", "out/"))
    assert path("/w/p/src/./a.c") == "out/src/a.c.i"
    assert path("/w/q/../x/b.c") == "out/x/b.c.i"
    assert path("/other/b.c") == "out/other/b.c.i"


# --- sinks and encodings ---------------------------------------------------------


def _reports(spark, rows):
    return spark.createDataFrame(rows, "path string, value string").repartition(3)


def test_reports_are_published_whole_or_not(spark, tmp_path):
    from codeloom.sources.report_files import REPORT_FILES, register

    register(spark)
    target = tmp_path / "deep" / "reports"
    rows = [(f"a/b{i}/r{i}.analysis.json", f'{{"file": "{i}"}}') for i in range(20)] + [("/top.analysis.json", None)]
    write = lambda df, place: df.write.format(REPORT_FILES).mode("append").save(str(place))
    write(_reports(spark, rows), target)
    back = {r.path.split("/reports/")[1]: r.value for r in Z.read_report_files(spark, str(target)).collect()}
    assert back == {p.lstrip("/"): v for p, v in rows if v}
    assert (target / "top.analysis.json").read_text() == ""
    for bad, place in [
        (_reports(spark, [*rows, ("../x", "y")]), tmp_path / "never"),  # one task fails
        (_reports(spark, rows[:2]), target),  # there is a result already
    ]:
        with pytest.raises(Exception):
            write(bad, place)
    assert not (tmp_path / "never").exists() and len(list(target.rglob("*.json"))) == 21
    assert not [p for p in tmp_path.rglob("*") if "staging" in p.name]
    write(_reports(spark, rows[:0]), "file:" + str(tmp_path / "empty"))
    assert (tmp_path / "empty").is_dir()


@pytest.mark.parametrize(
    ("raw", "content", "encoding"),
    [
        ("é日\U0001f600".encode(), "é日\U0001f600", "utf-8"),
        (b"\xef\xbb\xbfx = 1", "x = 1", "utf-8"),
        ("caf\xe9".encode("latin-1"), "café", "latin1"),
        ("\u201cx\u201d \u20ac5 caf\xe9".encode("cp1252"), "\u201cx\u201d \u20ac5 café", "cp1252"),
        (b"a\x81\xe9", "a\x81\xe9", "latin1"),  # a byte that code page 1252 has no character for
        ("def f(): # é日\U0001f600\n".encode("utf-16"), "def f(): # é日\U0001f600\n", "utf-16-le"),
        (b"\xfe\xff" + "x = 1".encode("utf-16-be"), "x = 1", "utf-16-be"),
        ("int main(void) {}".encode("utf-16-le"), "int main(void) {}", "utf-16-le"),
        ("int main(void) {}".encode("utf-16-be"), "int main(void) {}", "utf-16-be"),
        ("\ufeff".encode("utf-16-le"), "", "utf-16-le"),
        (b"a\x00b", "a\x00b", "utf-8"),  # odd length: set aside later
        (b"\xff\xfe\x00\xd8", "\xff\xfe\x00\xd8", "latin1"),  # half a pair
        (b"", "", "utf-8"),
    ],
)
def test_encodings(spark, raw, content, encoding):
    df = spark.createDataFrame([(raw,)], "raw binary").select(Z.decode_with_fallback(F.col("raw")).alias("d")).select("d.*")
    assert tuple(df.first()) == (content, encoding)


def test_encodings_of_large_and_missing_files(spark):
    big = ("x = 'é日'  # " * 100_000).encode("utf-16-le")
    df = spark.createDataFrame([("a.py", big), ("b.py", None), ("c.py", b"\x00\x01\x02\x03")], "path string, content binary")
    rows = {r.path: r for r in Z.source_table(df).collect()}
    assert rows["a.py"].content == big.decode("utf-16-le") and rows["a.py"].error is None
    assert rows["b.py"].error == "unreadable" and rows["c.py"].error == "not text"


# --- rules by their literals -------------------------------------------------------------


@pytest.mark.parametrize(
    ("regex", "literal"),
    [
        (r"SELECT.*\+.*", "SELECT"), (r"`SELECT.*\$\{.*\}`", "`SELECT"), (r"if.*token.*==.*None", "token"),
        (r"if\s*\(\s*!.*auth", "auth"), (r"v-html\s*=", "v-html"), (r"os\.path\.join\([^)]*\+.*\.\.", "os.path.join("),
        (r"colou?r+x", "colo"), (r"ab|abc", ""), (r"(?i)abc", ""), (r"(abc|d)e", "e"), (r"[abc]d{2}x", "x"), (r"\bword\w+", "word"),
    ],
)
def test_required_literals(regex, literal):
    assert U.required_literal(regex) == literal


def test_rules_hit_as_without_literals(spark):
    import random

    from codeloom import dims

    rnd = random.Random(2)
    parts = ["SELECT ", "execute(", "`SELECT ${x}`", " + ", "if ", "password", "==", '""', "token", "None", "os.path.join(", "..", "\n", "x", "auth", "(!", "eval(", "innerHTML ="]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    own = [("any", r"x|SEL")]
    for extra in ((), own):
        rules = [(rule, regex) for rule, _, regex in dims.rule_rows()] + list(extra)
        plain = U.tags_where([(rule, F.col("t").rlike("(?d)" + regex)) for rule, regex in rules])
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(U.rule_hits(F.col("t"), extra).alias("a"), plain.alias("b"))
        rows = df.collect()
        assert all(r.a == r.b for r in rows) and any(r.a for r in rows)


# --- the store of scans ---------------------------------------------------------------------


BAD = "def run(user_input):\n    return eval(user_input)\n"
BAD_TOO = "def also(user_input):\n    return eval(user_input)\n"


def _event(spark, *rows):
    return spark.createDataFrame(
        [(i, p, "python", c, seq, c is None) for i, (p, c, seq) in enumerate(rows)],
        "file_id long, path string, lang string, content string, seq int, deleted boolean",
    )


def _held(spark, store):
    return {(r.file, r.function) for r in I.kept_findings(spark, store).collect()}


def test_store_replaces_and_withdraws(spark, tmp_path):
    store = str(tmp_path / "store")
    assert _held(spark, store) == set() and I.kept_manifest(spark, store).count() == 0
    I.record_scan(_event(spark, ("a.py", BAD, 0), ("b.py", BAD, 0), ("c.py", "x = 1", 0)), 1, store)
    assert _held(spark, store) == {("a.py", "run"), ("b.py", "run")}
    # a changes, b goes, c is as it was, d comes and goes and comes; of two events of a path the last one holds
    events = _event(
        spark, ("a.py", "y = 2", 1), ("a.py", BAD + BAD_TOO, 2), ("b.py", BAD_TOO, 1), ("b.py", None, 2), ("c.py", "x = 1", 1),
        ("d.py", BAD, 1), ("d.py", None, 2), ("d.py", BAD_TOO, 3), ("e.py", None, 1),
    )
    I.record_scan(events, 2, store)
    want = {("a.py", "run"), ("a.py", "also"), ("d.py", "also")}
    assert _held(spark, store) == want
    marks = {r.path: (r.change, r.version) for r in I.kept_manifest(spark, store).collect()}
    assert marks == {"a.py": ("changed", 2), "b.py": ("deleted", 2), "c.py": ("new", 1), "d.py": ("new", 2)}
    # A crash between the two writes: findings without a manifest do not count, and the version runs again.
    I.record_scan(_event(spark, ("a.py", None, 3)), 3, store)
    (tmp_path / "store/manifest/version=3/_SUCCESS").unlink()
    assert _held(spark, store) == want
    for _ in range(2):
        I.record_scan(_event(spark, ("a.py", None, 3), ("b.py", BAD, 3)), 3, store)
        assert _held(spark, store) == {("d.py", "also"), ("b.py", "run")}
    # An old version that runs again gives what it gave.
    I.record_scan(events, 2, store)
    assert _held(spark, store) == {("d.py", "also"), ("b.py", "run")}


def test_scans_of_whole_tables(spark, tmp_path):
    store = str(tmp_path / "store")
    first = _event(spark, ("a.py", BAD, 0), ("b.py", BAD, 0)).drop("seq", "deleted")
    second = _event(spark, ("b.py", BAD_TOO, 0), ("c.py", BAD, 0)).drop("seq", "deleted")
    I.scan_changes(first, 1, store)
    I.scan_changes(second, 2, store)
    assert _held(spark, store) == {("b.py", "also"), ("c.py", "run")}
    I.scan_changes(first.limit(0), 3, store)
    assert _held(spark, store) == set()
    I.scan_changes(first, 4, store)
    assert _held(spark, store) == {("a.py", "run"), ("b.py", "run")}


def test_stream_with_corrections(spark, tmp_path):
    store, inbox, checkpoint = (str(tmp_path / x) for x in ("store", "inbox", "checkpoint"))
    for seq, rows in enumerate([[("a.py", BAD), ("b.py", BAD)], [("a.py", BAD_TOO)], [("b.py", None), ("c.py", BAD)]]):
        events = _event(spark, *[(p, c, seq) for p, c in rows])
        events.write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(events.schema).parquet(inbox)
        I.correcting_stream(arriving, store, checkpoint).awaitTermination()
    assert _held(spark, store) == {("a.py", "also"), ("c.py", "run")}
    I.correcting_stream(arriving, store, checkpoint).awaitTermination()  # nothing new
    assert _held(spark, store) == {("a.py", "also"), ("c.py", "run")}


def test_rollup_tells_nulls_from_totals(spark):
    found = spark.createDataFrame(
        [("c", None, "high", 0.5), ("c", "xss", "high", 0.9), (None, "xss", "low", 0.7)],
        "lang string, vulnerability_type string, severity string, confidence double",
    )
    rows = {tuple(r) for r in Q.rollup_findings(found).select("lang", "vulnerability_type", "level", "n_findings").collect()}
    assert {(None, None, 3, 3), ("c", None, 2, 2), ("c", None, 1, 1), ("c", None, 0, 1), (None, None, 2, 1)} <= rows


def test_stored_tables_are_discarded(spark):
    from pathlib import Path

    from codeloom.session import discard, stored

    plain = spark.range(5)
    kept, gone = stored(plain, "kept"), stored(plain, "gone")
    places = [Path(t.inputFiles()[0].removeprefix("file://")).parent for t in (kept, gone)]
    discard(gone, plain)
    assert places[0].exists() and not places[1].exists() and kept.count() == 5
    discard(gone)


def test_answers_are_never_gathered_in_the_driver(spark):
    """Answers are as many as functions; their estimate, made before they are exploded, tells nothing."""
    files = spark.createDataFrame([(1, "a.py", "py", "python", "def f(x):\n    return x\n")], "file_id long, path string, ext string, lang string, content string")
    answers = spark.range(4).select(
        F.concat_ws("#", F.lit(1), F.col("id") + 1).alias("fn_id"),
        F.explode(F.array(F.struct(F.lit("risk").alias("stage"), F.lit("0.9").alias("response_text")))).alias("r"),
    ).select("fn_id", "r.*")
    fns = spark.createDataFrame([("1#1", "f")], "fn_id string, name string")
    attached = R.attach_responses(R.attach_responses(fns, answers, R.RISK), answers, R.VERDICT)
    for df in (attached, S.reviewed(files, answers)):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") >= 2 and len(rows) == 1
    assert attached.first().risk_text == "0.9" and attached.first().verdict_text is None


def test_a_verdict_is_read_once_for_all_its_fields(spark):
    texts = [
        '{"vulnerable": true, "confidence": "0.70", "explanation": [1, "b"], "severity": null, "code_snippet": 1.50}',
        'Sure: {"vulnerable": 1, "confidence": 2, "explanation": "a}"} end',
        '{"vulnerable": true, "confidence": 0.9, "explanation": "a", "confidence": 0.8, "severity": "low"}',
        '} {"vulnerable": true', "{", "}", "", None,
    ]
    answers = spark.createDataFrame(list(enumerate(texts)), "fn_id int, response_text string")
    read = R.parse_verdicts(answers, "response_text")
    rows = {r.fn_id: r for r in read.collect()}
    assert [rows[n].accepted for n in range(len(texts))] == [True, True, *[False] * 6]
    first, second = rows[0], rows[1]
    assert (first.vulnerable, first.confidence, first.explanation, first.severity, first.code_snippet) == (
        True, 0.7, '[1,"b"]', None, "1.5",
    )
    assert (second.vulnerable, second.confidence, second.explanation, second.severity) == (True, 1.0, "a}", "medium")
    assert rows[2].severity is None and rows[3].severity == "medium"
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") == 1 and "reverse(" not in plan


def _orders(spark, folder, rows=40):
    keys = spark.range(rows).selectExpr(
        "id AS o_orderkey", "element_at(array('O', 'F', 'P'), cast(id % 3 + 1 AS int)) AS o_orderstatus",
        "element_at(array('1-URGENT', '5-LOW'), cast(id % 2 + 1 AS int)) AS o_orderpriority",
    )
    twice = keys.where("o_orderkey = 4").selectExpr("o_orderkey", "'P' AS o_orderstatus", "'2-HIGH' AS o_orderpriority")
    none = spark.sql("SELECT cast(null AS bigint) AS o_orderkey, 'F' AS o_orderstatus, '5-LOW' AS o_orderpriority")
    keys.unionByName(twice).unionByName(none).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_files_with_their_status_shuffle_no_text(spark, tmp_path):
    from codeloom.registry import queries as registry

    sf = _orders(spark, tmp_path / "sf")
    found = registry._with_status(spark, sf)
    status = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS file_id", "o_orderstatus", "o_orderpriority")
    wanted = registry._files(spark, sf).join(status, "file_id")
    assert found.columns == wanted.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner")
    assert "AS content" in above and "AS content" not in below


def test_changed_paths_keep_their_parts(spark):
    dealt = I._dealt(spark.createDataFrame([("a.py",), ("b.py",)], "path string"))
    assert dealt.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_answers_are_read_behind_the_gate(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "def f(a):\n  pass\n")], "file_id long, path string, lang string, content string")
    answers = spark.createDataFrame(
        [("1#1", "risk", "0.9"), ("1#1", "verdict", '{"vulnerable": true, "confidence": 0.8, "explanation": "x"}')],
        "fn_id string, stage string, response_text string",
    )
    found = S.findings(files, answers)
    assert [(r.function, r.confidence, r.vulnerability_type) for r in found.collect()] == [("f", 0.8, "unknown")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") == 1 and "try_variant_get(" in plan.split("Join LeftOuter")[0]
