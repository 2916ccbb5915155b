"""The pipeline beside its stages' brute-force results, and the registered queries' columns."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from codeloom.llm import oracle, quality, queries, secrets
from test_operators import SPACES, Sets, features, shingles

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_": "doc_id keep_id group_size kept text_sha256",
    "op4_": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_": "doc_id line_no class_doc_id class_line_no class_size kept",
    "op8_": "doc_id held_out lang_pred score",
    "op9_": "page_id url text n_chars",
    "op10_": "doc_id n_shingles component_id",
    "op11_": "word form root n n_near form_n",
    "op12_": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_": "doc_id n_words n_hit n_items items_sha256 contaminated",
}


def test_names():
    names = [n for p in COLUMNS for n in queries.queries() if n.startswith(p)]
    assert len(names) == len(COLUMNS) == len(queries.queries())
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(oracle.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("prefix", ["op1_", "op4_", "op8_", "op9_"])
def test_columns_and_rows(spark, prefix):
    name = next(n for n in queries.queries() if n.startswith(prefix))
    out = queries.queries()[name](spark, SF)
    assert set(COLUMNS[prefix].split()) <= set(out.columns)
    source = "pages" if prefix == "op9_" else "documents"
    assert out.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


@pytest.mark.parametrize("prefix", ["op3_", "op11_", "op12_", "op13_"])
def test_queries_equal_their_sql(spark, prefix):
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    name = next(n for n in queries.queries() if n.startswith(prefix))
    columns = COLUMNS[prefix].replace(" ", ", ")
    want = con.execute(f"SELECT {columns} FROM ({oracle.oracle_sql()[name]})").fetchall()
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns.split(", "))
    assert Counter(tuple(r) for r in got.select(*columns.split(", ")).collect()) == Counter(want)


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None and 8 <= r[0] < 60]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline(spark, rows, folder):
    trusted = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id")
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), trusted)
    good = {(r["doc_id"], r["text"]): r["quality"]["kept"] for r in judged.collect()}
    left = [r[:2] for r in rows if good[r[0], r[1]]]
    assert left and not any(features(t)[-1] for _, t in left)

    def order(r):
        return (r[0] is None, r[0] or 0)

    groups = defaultdict(list)
    for r in left:
        groups[SPACES.sub(" ", r[1])].append(r)
    left = [min(g, key=order) for g in groups.values()]
    sets, held = Sets(), [shingles(t, 5) for _, t in left]
    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                sets.join(i, j)
    near = defaultdict(list)
    for i, r in enumerate(left):
        near[sets.find(i)].append(r)
    left = [min(g, key=order) for g in near.values()]
    assert any(len(g) > 1 for g in near.values())
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for key, text in left:
        clean = secrets.mask(text, secrets.spans_of(text))
        want[key] = np.array(own.encode(clean, add_special_tokens=False).ids + [1], "<u4").tobytes()
    got = defaultdict(dict)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]][r["start"]] = bytes(r["ids"])
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    assert {k: b"".join(v for _, v in sorted(p.items())) for k, p in got.items()} == want


def test_stages_keep_the_columns_of_documents(spark, folder, docs):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert [f.dataType for f in out.schema] == [table.schema[c].dataType for c in corpus_pipeline.COLUMNS]


def test_stages_on_an_empty_table(spark, folder, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
