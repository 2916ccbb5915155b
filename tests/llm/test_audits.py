"""Spelling variants, filter audit and decontamination beside brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, filter_audit, queries, spelling

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- 11: spelling variants -----------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_forms(rows) -> set:
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def misspelt(rnd: random.Random, word: str) -> str:
    i, c = rnd.randrange(len(word) + 1), rnd.choice("abéz")
    return rnd.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


def spelling_rows():
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abcdeéÿ") for _ in range(rnd.randint(6, 11))) for _ in range(25)]
    weighted = []
    for stem in stems:
        weighted += [stem] * 150
        for _ in range(6):
            one = misspelt(rnd, stem)
            weighted += [one] * 26 + [misspelt(rnd, one)] * 5
    weighted += ["Straße×Größe", "ABCDEF", "abcdef", "x"] * 6 + ["prefix" + chr(97 + i) for i in range(20)] * 5
    rnd.shuffle(weighted)
    rows = [(i, " ".join(weighted[a : a + 40])) for i, a in enumerate(range(0, len(weighted), 40))]
    return rows + [(None, None), (None, "prefixa prefixa"), (7, ""), rows[3], rows[3]]


def test_spelling_forms_equal_brute_force(spark):
    rows = spelling_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute_forms(rows)
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of forms
    for part_words in (spelling.PART_WORDS, 16):  # parts as they come, and cut into blocks
        got = spelling.spelling_forms(df, part_words=part_words).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spelling_of_awkward_and_empty_tables(spark, docs, rows, none):
    got = spelling.spelling_forms(docs).collect()
    assert {tuple(r) for r in got} == brute_forms([(r[0], r[1]) for r in rows]) and len({r["word"] for r in got}) == len(got)
    assert spelling.spelling_forms(none).count() == 0


def test_position_index_finds_one_edit():
    rnd = random.Random(8)
    words = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(900)})
    index = spelling.PositionIndex(words)
    for q in words[:200] + ["", "a", "abcabcabcabc"]:
        assert sorted(words[k] for k in index.near(q)) == sorted(w for w in words if one_edit(w, q))
    assert spelling.PositionIndex([]).near("abc") == []


# --- 12: filter audit ----------------------------------------------------------------


def brute_audit(rows, labels) -> set:
    """Every order applied to every part, document by document."""
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    said = defaultdict(lambda: [False, False])
    for key, quality, toxic in labels:
        if key is not None:
            said[key][0] |= quality == 1
            said[key][1] |= toxic == 1
    parts = defaultdict(list)
    for key, text, source in rows:
        text = text or ""
        words = SPACE_WORDS.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": key is not None and first[text] < key,
        }
        parts[source or ""].append(({f for f, x in fails.items() if x}, *said.get(key, (False, False))))
    out = []
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                out.append(
                    (part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                     sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
                )
    total = Counter()
    for r in out:
        total[r[0], r[1][r[2] - 1]] += r[4]
    return {(*r, total[r[0], r[1][r[2] - 1]]) for r in out}


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def test_audit_equals_brute_force(spark, docs, rows, none):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    marked = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = filter_audit.audit(docs, marked)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][3:] == [
        (n, "bigint") for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    ]
    found = got.collect()
    want = brute_audit([(r[0], r[1], r[3]) for r in rows], labels)
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert filter_audit.audit(none, marked).count() == 0
    alone = filter_audit.audit(docs, marked.limit(0)).collect()
    assert {tuple(r) for r in alone} == brute_audit([(r[0], r[1], r[3]) for r in rows], [])


def test_paths_through_the_lattice(spark):
    reach, leave = filter_audit.paths(4)
    assert reach[-1] == leave[0] == 24 and all(reach[s] * leave[s] for s in range(16))
    with pytest.raises(ValueError):
        filter_audit.interactions(spark.createDataFrame([], "part string, mask int, n long"), "ABCDEFGHI")
    three = spark.createDataFrame([("p", 0, 2), ("p", 5, 3), ("p", 5, 1), ("p", 7, 1)], "part string, mask int, n long")
    got = filter_audit.interactions(three, "xyz").collect()
    assert len(got) == 18 and {r["kept"] for r in got if r["step"] == 3} == {2}
    shares = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}
    assert sum(shares.values()) == 6 * 5 and shares["x"] == shares["z"]  # 6 orders, 5 documents removed in each


# --- 13: decontamination -------------------------------------------------------------

BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_marks(rows, items, window=10) -> Counter:
    windows = defaultdict(set)
    for item, text in items:
        words = BENCH_WORDS.findall(lowered(text or ""))
        for a in range(max(0, len(words) - window) + 1):
            if words:
                windows[tuple(words[a : a + window])].add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for key, text in rows:
        spans = [m.span() for m in BENCH_WORDS.finditer(lowered(text or ""))]
        words = [lowered(text or "")[a:b] for a, b in spans]
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= ids
        runs = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i for i in sorted(hit) if i + 1 not in hit]
        out[
            key, len(words), len(hit), tuple(sorted(str(i) for i in found if i is not None)),
            tuple((spans[a][0], spans[b][1]) for a, b in zip(runs, ends)),
        ] += 1
    return out


def bench_case():
    rnd = random.Random(11)
    words = ["ab", "Ünü", "C3", "日本", "x", "the", "it's", "e-f"]

    def passage(n):
        return rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(n))

    items = [(i, passage(rnd.randint(1, 40))) for i in range(6, 30)]
    items += [(30, None), (31, "--"), (None, passage(25)), (6, passage(14)), (32, "ab ab ab ab ab ab ab ab ab ab ab ab"), (33, "C3 日本 x")]
    rows = [(i, passage(rnd.randint(0, 60)).upper() + "! " + (rnd.choice(items)[1] or "")) for i in range(60)]
    rows += [(None, None), (5, ""), (70, "AB-" * 40), (71, items[5][1]), (71, items[5][1]), (72, " ".join(t or "" for _, t in items) * 3)]
    return rows, items


def test_marks_equal_brute_force(spark, none):
    rows, items = bench_case()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, items string").repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = brute_marks(rows, items)
    for size in (decontaminate.AUTOMATON_WORDS, 60):  # one automaton, and several
        got = decontaminate.contamination(df, bench, automaton_words=size).collect()
        assert Counter(
            (r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got
        ) == want
    assert any(k[2] for k in want) and any(not k[2] for k in want)
    assert decontaminate.contamination(none, bench).count() == 0
    clean = decontaminate.contamination(df, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["n_hit"] or r["items"] for r in clean)


def test_long_texts_are_read_once(spark):
    words = ["a"] * 400_000
    automaton = decontaminate.Automaton([("1", [b"a"] * 30), ("2", [b"a"] * 4 + [b"b"] * 9)])
    assert automaton.scan([w.encode() for w in words]) == ([(0, 400_000)], {"1"})
    odd = [(i, " ".join(words)) for i in range(2)]
    bench = spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(odd, "doc_id long, text string"), bench).collect()
    assert [(r["n_hit"], len(r["spans"])) for r in got] == [(400_000, 1)] * 2


def test_digests_of_the_query(spark, tmp_path):
    rows, items = bench_case()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op13_benchmark_decontamination(spark, str(tmp_path)).collect()
    want = Counter()
    for (key, n, hit, ids, _), times in brute_marks(rows, items).items():
        want[key, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0] += times
    assert Counter(tuple(r) for r in got) == want
    assert queries.op13_benchmark_decontamination(spark, str(tmp_path)).where(F.col("contaminated")).count() > 1
