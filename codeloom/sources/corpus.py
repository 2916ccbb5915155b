"""Source-code tables derived from the ``orders``, ``part`` and ``supplier`` tables.

The given tables hold no source files, so each order becomes one file: a header
plus three functions picked from templates by its key.  The derivation is a
projection (no shuffle), so a skewed customer or key range cannot make a large
group, and the corpus grows with the table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PY_HEADER = """\
import os, sys as system
import hashlib
from typing import Any, Dict as D
from ..core.db import (connect,
    cursor as cur)
from flask import Flask, request
"""

PY_FUNCTIONS = [
    '''\
def run_expr_{ID}(user_input, ctx=None):
    """Evaluate text; the words def and class( are only text."""
    # def not_a_function(x):
    result = eval(user_input)
    return result
''',
    '''\
@app.route('/search/{ID}')
@login_required
def search_{ID}(request, *args, limit=10, **kwargs):
    cursor = db.cursor()
    cursor.execute("SELECT * FROM t WHERE name = '" + request.args.get('q') + "'")
    return cursor.fetchall()
''',
    '''\
class Store{ID}(Base):
    """Keeps rows.

def fake(self): this line is text
    """

    def __init__(self, path: str = 'a.db', opts: Dict[str, Any] = {}) -> None:
        self.path = path

    async def load_user_{ID}(self, user_id: int, retries: int = 3) -> Optional[Dict[str, Any]]:
        query = f"SELECT * FROM users WHERE id = {user_id}"
        return await self.db.execute(query)
''',
    '''\
def ping_{ID}(host):
    os.system("ping -c 1 " + host)
    subprocess.call("ls " + host, shell=True)
''',
    '''\
def total_{ID}(values,
           weight: float = 1.5,
           labels=[]):
    acc = 0

    for v in values:
        acc += round(v * weight, 2)
# a comment at column zero
    return acc
''',
    '''\
def outer_{ID}(payload):
    def inner_{ID}(item):
        return hashlib.md5(item.encode()).hexdigest()
    return [inner_{ID}(p) for p in json.loads(payload)]
''',
    '''\
def check_token_{ID}(token):
    if token == "{PRI}":
        return True
    password = "s3cr3t-{ID}"
    return hmac.compare_digest(token, password)
''',
    '''\
async def apply_{ID}(user_code, path):
    exec(user_code, {})
    with open("/data/" + path) as fh:
        return fh.read()
''',
    '''\
def label_{ID}(item, width=8):
    name = f"{escape_{ID}(item['na(me'])}: {len(str(item)):>{width}}"
    query = f'SELECT * FROM t WHERE id = {quote_{ID}(f"<{item}>")}'
    return db.execute(f"INSERT {name}") or db.query(query, "x" + name)
''',
    '''\
def merge_{ID}(first, table={(1, (2, (3, (4, (5, (6, (7, (8, (9, 0))))))))): "a,b):"},
               mode: Dict[str, Dict[str, Dict[str, Dict[str, int]]]] = None) -> Tuple[str, Dict[str, List[Dict[str, int]]]]:
    return combine_{ID}(first, table, mode=mode)
''',
]

JS_HEADER = """\
import express, { Request, Response as Res } from 'express';
import * as fs from 'fs';
import 'reflect-metadata';
const mysql = require('mysql2');
"""

JS_FUNCTIONS = [
    """\
function render_{ID}(req, res) {
  const q = req.query.q;
  document.getElementById('out').innerHTML = q;
  if (q) { track('{', q); }
}
""",
    """\
const findUser_{ID} = async (userId, cb) => {
  const sql = `SELECT * FROM users WHERE id = ${userId}`;
  return db.query(sql, cb);
};
""",
    """\
class Repo{ID} extends Base {
  constructor(opts) {
    super(opts);
    this.db = connect(opts.url);
  }

  async save(data, ...rest) {
    // } a stray brace
    return this.db.query("INSERT INTO t VALUES ('" + data.name + "')");
  }
}
""",
    """\
const api_{ID} = {
  handler: function (req, res) {
    return eval(req.body.user.code);
  },
  list: (items) => {
    return items.map(pick);
  },
};
""",
    """\
interface Opts{ID} { id: number; name: string; }
type Key{ID} = string | number;
function conv_{ID}(key: string, size: number): void {
  const m: Map<string, number> = new Map<string, number>();
  m.set(key, size);
}
""",
    """\
app.get('/r/{ID}', (req, res) => {
  const name = req.params.name;
  res.send(fs.readFileSync('./files/' + name));
});
""",
    """\
export async function load_{ID}({ id, opts }, retries = 3) {
  const out = await fetch(`/api/${id}`);
  return out.json();
}
""",
    """\
const twice_{ID} = n => n * 2;
setTimeout(function () {
  evaluate_{ID}(twice_{ID}(4));
}, 10);
""",
    """\
const build_{ID} = (opts = wrap(a(b(c(d(e(f(g(h(i(j(1))))))))))), last) => {
  return `list ${opts.pick(`<${tag_{ID}(last)}>`).join(sep_{ID}(last))} end ${tail_{ID}(`${last}`)}`;
};
""",
]

C_HEADER = """\
#include <stdio.h>
#include <stdlib.h>
#include <openssl/evp.h>
#include "local.h"
#define MAX_LEN 64
static int counter = 0;
"""

C_FUNCTIONS = [
    """\
int copy_name_{ID}(char *dst, const char *src) {
    char buf[16];
    strcpy(buf, src); /* an unbounded } copy */
    sprintf(dst, "%s{", buf);
    return 0;
}
""",
    """\
static void log_msg_{ID}(const char *user_msg)
{
    // printf(user_msg) is risky {
    printf(user_msg);
}
""",
    """\
void *make_buf_{ID}(size_t n, int flags[4]) {
    char *p = malloc(n * 4);
    if (p == NULL) { return NULL; }
    memset(p, 0, n);
    return p;
}
""",
    """\
int decrypt_block_{ID}(EVP_CIPHER_CTX *ctx, unsigned char *out,
                       int outl, RSA *key) {
    if (EVP_DecryptUpdate(ctx, out, &outl, out, outl) != 1) {
        ERR_print_errors_fp(stderr);
        return -1;
    }
    return RSA_private_decrypt(outl, out, out, key, 1);
}
""",
    """\
int run_cmd_{ID}(int argc, char **argv) {
    char line[64];
    fgets(line, sizeof(line), stdin);
    return system(argv[1]);
}
""",
    """\
int add_{ID}(int a, int b) {
    int acc = 0;
    for (int i = 0; i < b; i++) {
        acc += a;
    }
    return acc;
}
""",
    """\
int helper_{ID}(int value);
struct item_{ID} { int id; char tag[8]; };
int helper_{ID}(int value) {
    struct item_{ID} it = { value, "x" };
    return ops->apply(it.id, value);
}
""",
    """\
X509 *parse_cert_{ID}(const unsigned char *data, long len) {
    X509 *cert = d2i_X509(NULL, &data, len);
    ASN1_INTEGER *sn = d2i_ASN1_INTEGER(NULL, &data, len);
    if (!cert) return NULL;
    free(sn);
    return cert;
}
""",
    """\
#if defined(FAST_{ID})
int scale_{ID}(int a) {
#else
int scale_{ID}(int a, int by) {
#endif
    if (a) {
        return grow_{ID}(a);
    }
    return a;
}

int after_{ID}(void) {
    return scale_{ID}(1);
}
""",
]

LANGS = ["python", "javascript", "c"]
HEADERS = {"python": PY_HEADER, "javascript": JS_HEADER, "c": C_HEADER}
FUNCTIONS = {"python": PY_FUNCTIONS, "javascript": JS_FUNCTIONS, "c": C_FUNCTIONS}
# Extension by (key div 3) % 4.
EXTENSIONS = {
    "python": ["py", "py", "py", "py"],
    "javascript": ["js", "jsx", "ts", "tsx"],
    "c": ["c", "c", "h", "i"],
}
# A function's place in the file picks its template: (key div 3 div step + shift) % their number.
SLOTS = [(1, 0), (9, 3), (80, 5)]
# A line that leaves brackets open, by language.
BROKEN = {
    "python": "total = add(1, [2\n",
    "javascript": "const lost = run(1, [2;\n",
    "c": "int lost[] = { 1, (2;\n",
}


def spread(table: DataFrame) -> DataFrame:
    """Thin rows dealt evenly: each grows a hundredfold below, and a scan's splits don't tell."""
    return table.repartition(3 * table.sparkSession.sparkContext.defaultParallelism)


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by)).cast("long")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, path, ext, lang, content`` -- one source file per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return files_from_orders(spread(orders.select("o_orderkey", "o_orderpriority")))


def files_from_orders(orders: DataFrame) -> DataFrame:
    """The derivation itself: a projection, so batch or streaming alike."""
    return orders.select(*file_columns())


FILE_FIELDS = ["file_id", "path", "ext", "lang", "content"]


@cache
def file_columns() -> list[Column]:
    """The fields of a file, in the order of FILE_FIELDS, from ``o_orderkey`` and ``o_orderpriority``."""
    key = F.col("o_orderkey")
    turn = _div(key, len(LANGS))
    text = ext = None
    for n, lang in enumerate(LANGS):
        bodies = F.array(*[F.lit(t) for t in FUNCTIONS[lang]])
        parts = [F.lit(HEADERS[lang])]
        for slot, (step, shift) in enumerate(SLOTS, 1):
            body = F.get(bodies, ((_div(turn, step) + shift) % len(FUNCTIONS[lang])).cast("int"))
            name = F.concat(key.cast("string"), F.lit(f"_{slot}"))
            parts.append(F.replace(body, F.lit("{ID}"), name))
        content = F.replace(F.concat_ws("\n", *parts), F.lit("{PRI}"), F.col("o_orderpriority"))
        extension = F.get(F.array(*[F.lit(e) for e in EXTENSIONS[lang]]), (turn % 4).cast("int"))
        is_lang = key % len(LANGS) == n
        text = F.when(is_lang, content) if text is None else text.when(is_lang, content)
        ext = F.when(is_lang, extension) if ext is None else ext.when(is_lang, extension)
    lang_name = F.get(F.array(*[F.lit(x) for x in LANGS]), (key % len(LANGS)).cast("int"))
    return [
        key.alias("file_id"),
        F.concat(
            F.lit("src/"), lang_name, F.lit("/mod_"), key.cast("string"), F.lit("."), ext
        ).alias("path"),
        ext.alias("ext"),
        lang_name.alias("lang"),
        text.alias("content"),
    ]


def broken_twice(files: DataFrame, where: Column) -> DataFrame:
    """Files, those of ``where`` twice in one with a line between that leaves brackets open."""
    line = F.lit(None).cast("string")
    for lang, text in BROKEN.items():
        line = F.when(F.col("lang") == lang, text).otherwise(line)
    content = F.concat("content", F.lit("\n"), line, "content")
    return files.withColumn("content", F.when(where, content).otherwise(F.col("content")))


# Raw answers of an external scoring job, by function.
RISK_TEXTS = [
    "0.75", "1.5", "Score: 0.9", "this looks unsafe", "High risk of misuse", "10", "", None,
]
VERDICT_TEXTS = [
    '{"vulnerable": true, "confidence": 0.85, "vulnerability_type": "sql_injection", '
    '"severity": "critical", "explanation": "query built from input", '
    '"code_snippet": "execute(q)", "remediation": "bind parameters"}',
    'Sure, here it is: {"vulnerable": true, "confidence": 0.6, "vulnerability_type": "xss", '
    '"explanation": "unescaped"} Hope that helps.',
    '{"vulnerable": true, "confidence": 0.9}',
    '{"vulnerable": true, "confidence": ',
    '{"vulnerable": true, "confidence": 1.7, "vulnerability_type": "made_up_type", '
    '"severity": "severe", "explanation": "over the top"}',
    '{"vulnerable": 1, "confidence": "0.55", "vulnerability_type": null, "severity": "low", '
    '"explanation": "string number"}',
    '{"vulnerable": "false", "confidence": 0.9, "vulnerability_type": "ssrf", '
    '"explanation": "a string"}',
    None,
]


# No derived file holds more functions than this.
MAX_FUNCTIONS = 9


def responses(files: DataFrame) -> DataFrame:
    """``fn_id, stage, response_text``: answers by file and function number.

    Made from the file ids alone; numbers a file does not reach join nothing.
    """

    def pick(texts: list[str | None], n: Column) -> Column:
        return F.get(F.array(*[F.lit(t) for t in texts]), (n % len(texts)).cast("int"))

    def answer(stage: str, text: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), text.alias("response_text"))

    numbered = files.select(
        "file_id", F.explode(F.sequence(F.lit(1), F.lit(MAX_FUNCTIONS))).alias("fn_no")
    )
    n = F.col("file_id") + F.col("fn_no")
    return (
        numbered.select(
            F.concat_ws("#", "file_id", "fn_no").alias("fn_id"),
            F.explode(
                F.array(
                    answer("risk", pick(RISK_TEXTS, n * 3)),
                    answer("verdict", pick(VERDICT_TEXTS, n)),
                )
            ).alias("r"),
        )
        .select("fn_id", "r.*")
        .where(F.col("response_text").isNotNull())
    )


def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record`` JSON lines: one compiler call per part, wrappers by brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    stem = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    compiler = F.get(
        F.array(*[F.lit(c) for c in ["gcc", "clang", "/usr/bin/cc", "g++", "cc-wrapper", "icc"]]),
        (key % 6).cast("int"),
    )
    number = key.cast("string")
    argv = (
        F.when(
            key % 4 == 0,
            F.array(
                F.lit("-c"), F.lit("-I"), F.lit("include"),
                F.concat(F.lit("-DSIZE="), F.col("p_size").cast("string")),
                F.concat(F.lit("src/"), stem, F.lit("_"), number, F.lit(".c")),
                F.lit("-o"), F.lit("out.o"),
            ),
        )
        .when(
            key % 4 == 1,
            F.array(
                F.lit("-std=c99"), F.lit("-include"), F.lit("pre.c"), F.lit("-UDEBUG"),
                F.concat(F.lit("/opt/code/../lib/"), stem, F.lit("_"), number, F.lit(".c")),
                F.lit("util.c"),
            ),
        )
        .when(
            key % 4 == 2,
            F.array(
                F.lit("-O2"), F.lit("-D"), F.lit("NAME"), F.lit("-Ivendor"), F.lit("-c"),
                F.concat(F.lit("../shared/./"), stem, F.lit(".c")),
            ),
        )
        .otherwise(F.array(F.lit("main.o"), F.lit("-lm"), F.lit("-I")))
    )
    return part.select(
        F.to_json(
            F.struct(
                key.alias("record_id"),
                F.concat(F.lit("/home/dev/proj/"), F.lower(F.col("p_type"))).alias("cwd"),
                compiler.alias("compiler"),
                argv.alias("argv"),
            )
        ).alias("record")
    )
