"""Each operator on the awkward table beside a brute-force version."""

import base64
import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import (
    bpe, exact_dedup, html_text, language_id, line_dedup, ngram_join, packing, quality, secrets, sharding,
)

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def counted(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


class Sets:
    """Union-find over anything."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# --- 1: sharding -----------------------------------------------------------------


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.indices((1 << bits,) * n).reshape(n, -1)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(index)))
        steps = np.abs(np.diff(cells[:, np.argsort(index)], axis=1)).sum(axis=0)
        assert (steps == 1).all()


def test_shards_are_even_and_ordered(docs, rows):
    got = sharding.hilbert_shards(docs, 7).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(n))
        assert [r["hilbert"] for r in own] == sorted(r["hilbert"] for r in own)
    ends = defaultdict(list)
    for r in got:
        ends[r["shard"]].append(r["hilbert"])
    assert all(max(ends[i]) <= min(ends[i + 1]) for i in range(6))


def test_shards_of_few_rows(spark, docs, none):
    assert sharding.hilbert_shards(none, 4).count() == 0
    few = docs.where("doc_id < 3")
    assert sorted(r["shard"] for r in sharding.hilbert_shards(few, 40).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        sharding.hilbert_shards(docs, 0)


def test_manifest_and_files(spark, docs, tmp_path):
    sharded = sharding.hilbert_shards(docs.drop("shard"), 3)
    assert sum(r["rows"] for r in sharding.manifest(sharded).collect()) == docs.count()
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert counted(back.select("doc_id", "text").collect()) == counted(docs.select("doc_id", "text").collect())


# --- 2: byte-level BPE -------------------------------------------------------------


def test_encoding_equals_tiktoken(docs, rows, none):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={}
    )
    got = bpe.encode(docs, MULTI, public_tokenizers.PATTERN, block_chars=2000).collect()
    want = Counter(
        (r[0], np.array(own.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows
    )
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    digests = bpe.encode(docs, MULTI, public_tokenizers.PATTERN, digest=True).collect()
    assert counted(digests) == Counter(
        (k, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest())
        for (k, i, t), n in want.items() for _ in range(n)
    )
    assert bpe.encode(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_long_words(spark):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={}
    )
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdetion") for _ in range(n)) for n in (398, 399, 400, 401, 402, 900, 100_000)]
    texts += ["z" * 401, "é" * 300, "ab" * 5000 + " short " + "th" * 201, " " + "x" * 400, "日本" * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in bpe.encode(frame, MULTI, public_tokenizers.PATTERN).collect()}
    assert time.perf_counter() - start < 60
    for i, t in enumerate(texts):
        assert bytes(got[i]["ids"]) == np.array(own.encode_ordinary(t), "<u4").tobytes(), i
        assert bytes(got[i]["decoded"]) == t.encode()


def test_words_of_a_block_merge_together():
    # No fold in a plan: the merges of all distinct words of a block are rounds over flat arrays.
    ranks = bpe.RankMap(*bpe.RankMap.parts(bpe.read_ranks(MULTI)))
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeinrst é日") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    ids, starts, sizes, back = bpe._merged(words, ranks)
    for i, w in enumerate(words):
        want = bpe.merged_long([ranks.byte_ids[x] for x in w.encode()], ranks.pairs)
        assert ids[starts[i] : starts[i] + sizes[i]].tolist() == want
        assert back[i] == w.encode()


def test_every_pair_has_its_place():
    pairs = {(a + 1, b + 1): r + 1 for (a, b), r in bpe.pair_ranks(bpe.read_ranks(MULTI)).items()}
    table, factors = bpe.placed(pairs)
    for (a, b), r in pairs.items():
        key = (a << 17) + b
        assert (key << 17) + r in {table[(a * f + b * g) % len(table)] for f, g in factors}
    assert sum(v >= 0 for v in table) == len(pairs)


def test_chunks_keep_the_pattern_apart():
    rnd, words = random.Random(1), regex.compile(public_tokenizers.PATTERN).findall
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "-", "'s", "\x1c", " ", "日"]
    for _ in range(20000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        first, *rest = bpe.chunks(s)
        assert words(first) + [w for c in rest for w in words(" " + c)] == words(s)


# --- 3: exact duplicates -------------------------------------------------------------


@pytest.mark.parametrize(("size", "bits"), [(1024, 64), (7, 64), (1024, 5)])
def test_exact_groups(docs, rows, none, size, bits):
    data = docs if bits == 64 else docs.where("doc_id < 12")
    rows = rows if bits == 64 else [r for r in rows if r[0] is not None and r[0] < 12]
    got = exact_dedup.exact_groups(data, block_bytes=size, print_bits=bits).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[SPACES.sub(" ", r[1] or "")].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_groups(none).count() == 0


def test_keep_first_keeps_one_of_each(docs, rows):
    got = exact_dedup.keep_first(docs).collect()
    texts = [SPACES.sub(" ", r["text"] or "") for r in got]
    assert len(set(texts)) == len(texts) == len({SPACES.sub(" ", r[1] or "") for r in rows})


def test_names_are_places_in_the_order_of_all_keys(spark):
    rnd = random.Random(10)
    keys = list({(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(900)})
    want = {k: i for i, k in enumerate(sorted(keys))}
    for parts in (1, 7):
        frame = spark.createDataFrame(keys, "a long, b long").repartition(parts)
        got = exact_dedup._numbered(frame, "names", ["a", "b"], ["a", "b"]).collect()
        assert {(r["a"], r["b"]): r["name"] for r in got} == want
    assert exact_dedup._numbered(frame.limit(0), "names", ["a"], ["a", "b"]).count() == 0


# --- 4: secrets ----------------------------------------------------------------------


def base_spans(text):
    kinds = [
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
         r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        (r"AKIA[A-Z0-9]+", 0, 16),
        (r"[0-9a-f]+", 0, 32),
    ]
    return sorted(
        (m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n
    )


def test_base_spans(docs, rows, none):
    rnd = random.Random(2)
    parts = ["token", "API_KEY", "apikey", "=", ": ", '"', "'", "AKIA", "0123456789abcdef", "Zz9", " ", "pass", "passwd", "é"]
    for _ in range(5000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert secrets.base_spans(s) == base_spans(s)
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(rows) and secrets.scan_secrets(none).count() == 0
    want = Counter()
    for r in rows:
        spans = base_spans(r[1] or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        kinds = [k for _, k, _ in spans]
        want[r[0], kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_windows_equal_entropy_from_scratch():
    rnd = random.Random(3)
    for _ in range(200):
        s = "".join(rnd.choice("abcdefgh" if rnd.random() < 0.5 else "ab") for _ in range(rnd.randint(0, 60)))
        hot = set()
        for i in range(len(s) - 9):
            counts = Counter(s[i : i + 10]).values()
            if -sum(c / 10 * math.log2(c / 10) for c in counts) >= 2.0 - 1e-9:
                hot |= set(range(i, i + 10))
        found = {x for a, b in secrets._hot_windows(s, 10, 2.0) for x in range(a, b)}
        assert found == hot


def test_entropy_and_allow_list(docs):
    key = "ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5z0"
    assert secrets.entropy_spans(f"key {key} end") == [(4, 4 + len(key))]
    for clean in ("id 123e4567-e89b-12d3-a456-426614174000", "averyveryverylongwordwithoutdigitsinit",
                  "sha256:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", "1" * 40):
        assert not secrets.entropy_spans(clean)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs.where("doc_id is not null")).collect()}
    assert "hunter2" not in "".join(t for t in masked.values() if t) and key not in "".join(t for t in masked.values() if t)
    assert masked[4] == "one" and masked[0] is None


def plain_entropy_spans(text):
    """Allow-list and cover by trying everything."""
    run = r"[A-Za-z0-9+/_=-]*"
    held = re.compile(f"{run}(?:{secrets.PLACEHOLDER.pattern}){run}")
    allowed = [m.span() for p in (*secrets.ALLOW, held) for m in p.finditer(text)]
    found = []
    for m in secrets.CANDIDATE.finditer(text):
        for k in secrets.CLASSES:
            for r in k.run.finditer(m[0]):
                w, bits = k.limits(len(r[0]))
                hot = [i for i in range(len(r[0]) - w + 1)
                       if -sum(c / w * math.log2(c / w) for c in Counter(r[0][i : i + w]).values()) >= bits - 1e-9]
                at = m.start() + r.start()
                spans = []
                for i in hot:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + w
                    else:
                        spans.append([i, i + w])
                found += [(at + a, at + b) for a, b in spans if k.keylike(r[0][a:b])]
    merged = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged if not any(x <= a and b <= y for x, y in allowed)]


def test_entropy_spans_equal_a_plain_version():
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    parts = ["EXAMPLE", "sha256:", "commit ", " ", "\n", "0123456789", "=", "abcdefghijklm", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "the", "-"]
    seen = 0
    for _ in range(400):
        text = "".join(
            rnd.choice([rnd.choice(parts), "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 45)))]) for _ in range(rnd.randint(1, 9))
        )
        got = secrets.entropy_spans(text)
        assert got == plain_entropy_spans(text), text
        seen += len(got)
    assert seen > 100


def test_long_encoded_runs_are_linear():
    blob = base64.b64encode(random.Random(4).randbytes(750_000)).decode()
    start = time.perf_counter()
    assert secrets.spans_of(blob)
    assert not secrets.entropy_spans(blob + "EXAMPLE")
    assert secrets.spans_of(f"token={blob} " + "ab12" * 9 + " ") and secrets.spans_of("sha1:" * 100_000) == []
    assert time.perf_counter() - start < 6


# --- 5: quality rules ----------------------------------------------------------------


def test_short_mixed_keys():
    rnd = random.Random(9)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    for n in (20, 21, 22, 23):
        key = "".join(rnd.sample(chars, n - 3)) + "aA7"
        assert secrets.spans_of(f"a key {key} here") == [(6, 3, 6 + n)]
        assert secrets.mask(f"a {key}.", secrets.spans_of(f"a {key}.")) == "a [entropy removed]."
    for key in ("qWmZrTxKvBnHyGdLpJcFsA", "xKqPzRwMvTjYbNhGdLcFsAeU"):
        assert secrets.spans_of(f"a key {key} here") == [(6, 3, 6 + len(key))]
    for name in ("getElementsByClassName", "aaaaaaaaaaAAAAAAAAAA11", "InternationalizationService"):
        assert secrets.spans_of(f"a name {name} here") == []


def features(text):
    words = WORDS.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def grams(text):
    def chained(values):
        h = 42
        for v in values:
            raw = v if isinstance(v, bytes) else v.to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(raw, seed=h)
        return h

    one = [chained([w.encode()]) for w in WORDS.findall(text)]
    return [g & (quality.BUCKETS - 1) for g in one + [chained(p) for p in zip(one, one[1:], strict=False)]]


def test_quality(spark, docs, rows, none):
    trusted = [r[0] for r in rows if r[0] is not None and r[0] % 3 == 0]
    frame = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    got = quality.judge(docs, frame).select("doc_id", "text", "quality.*").collect()
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1] or ""))
        if r[0] in trusted:
            good.update(grams(r[1] or ""))
    n, m = sum(raw.values()), sum(good.values())
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        want = features(text)
        assert want == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        own = grams(text)
        if not own:
            assert r["score"] is None and not r["kept"]
            continue
        score = sum(math.log(0.9 * (good[g] / m) / (raw[g] / n) + 0.1) for g in own) / len(own)
        assert r["score"] == pytest.approx(score)
        assert r["kept"] == (not want[-1] and r["score"] >= quality.THRESHOLD)
    assert quality.judge(none, frame).count() == 0
    alone = quality.judge(docs, frame.limit(0)).where("abs(quality.score) > 1e-9")
    assert alone.count() == 0


# --- 6: packing ----------------------------------------------------------------------


def test_first_fit_by_the_tree():
    rnd = random.Random(4)
    for _ in range(50):
        sizes = sorted((rnd.randint(1, 100) for _ in range(rnd.randint(0, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            i = next((i for i, x in enumerate(room) if x >= s), len(room))
            if i == len(room):
                room.append(100)
            want.append((i, 100 - room[i]))
            room[i] -= s
        bins, offsets = packing.first_fit(np.array(sizes, dtype=np.int64), 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def test_packing(docs, rows, none):
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    got = packing.pack_documents(docs, JSON, public_tokenizers.PATTERN, length=256, group_docs=20, with_ids=True).collect()
    want = Counter(
        (r[0], np.array(own.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in rows
    )
    whole = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole[r["doc_id"], r["doc_tokens"]].append(r)
    for (key, ids), n in want.items():
        pieces = sorted(whole[key, len(ids) // 4], key=lambda r: r["start"])
        starts = Counter((r["start"], bytes(r["ids"])) for r in pieces)
        for at in range(0, len(ids), 1024):
            assert starts[at // 4, ids[at : at + 1024]] >= n
    assert sum(r["length"] for r in got) == sum(len(i) // 4 * n for (_, i), n in want.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack_documents(none, JSON, public_tokenizers.PATTERN).count() == 0


def test_added_tokens(spark):
    library, special = Tokenizer.from_file(JSON), list(packing.read_added(JSON))
    assert special
    texts = [f"a{t}b" for t in special] + [t * 2 for t in special] + [f" x {t} y\n{t}\n z {t[:-1]} {t[1:]}" for t in special]
    texts += [f"{t}  a" for t in special] + [f"a  {t}" for t in special] + ["", "plain text"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(frame, JSON, public_tokenizers.PATTERN, with_ids=True).collect()
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got}
    assert found == {i: [*library.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


# --- 7: near-duplicate lines -----------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, s, n):
    out = list(s)
    for _ in range(n):
        kind, i = rnd.random(), rnd.randrange(len(out) + 1)
        if kind < 0.4 and out:
            out[i % len(out)] = rnd.choice("abc")
        elif kind < 0.7 and out:
            del out[i % len(out)]
        else:
            out.insert(i, rnd.choice("abc"))
    return "".join(out)


def test_automaton_and_segments():
    rnd = random.Random(6)
    for _ in range(5000):
        e = rnd.choice([1, 2, 3])
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(e + 1, 12)))
        b = edited(rnd, a, rnd.randint(0, 4))
        near = distance(a, b) <= e
        assert line_dedup.within(a, b, e) == near
        if near and a != b and min(len(a), len(b)) > e:
            short, long = sorted((a, b), key=len)
            assert not e or set(line_dedup.index_keys(short, ((0, e),))) & line_dedup.probe_keys(long, ((0, e),))


def allowed(a, b):
    """Edits between two lines: none up to 5 characters of the shorter, 1 up to 20, 2 beyond."""
    n = min(len(a), len(b))
    return 0 if n <= 5 else 1 if n <= 20 else 2


def test_line_classes(spark, docs, rows, none):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(20, 40))) for _ in range(12)]
    made = [(1000 + i, "\n".join(edited(rnd, x, rnd.randint(0, 3)) for x in rnd.sample(base, 5))) for i in range(30)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = line_dedup.line_classes(frame).collect()
    found = [
        (r[0], n, x) for r in [*rows, *made] for n, x in enumerate((r[1] or "").split("\n")) if WORDS.search(x)
    ]
    lines, sets = sorted({x for _, _, x in found}), Sets()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and line_dedup.within(a, b, allowed(a, b)):
                sets.join(a, b)
    first, size = {}, Counter()
    for key, n, x in sorted(found, key=lambda f: (f[0] is None, f[0] or 0, f[1])):
        first.setdefault(sets.find(x), (key, n))
        size[sets.find(x)] += 1
    want = Counter((k, n, *first[sets.find(x)], size[sets.find(x)]) for k, n, x in found)
    assert Counter(tuple(r)[:5] for r in got) == want
    assert sum(r["kept"] for r in got) == len(size)
    assert line_dedup.line_classes(none).count() == 0


def test_short_lines(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(n)) for n in (*range(6, 24), 9, 12, 15, 18)]
    lines = base + [edited(rnd, x, rnd.randint(1, 3)) for x in base] + ["x", "yz", "#1", "wvu", "vu##", "2", "()[]{}"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    sets = Sets()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if distance(a, b) <= allowed(a, b):
                sets.join(i, j)
    least = {}
    for i in range(len(lines)):
        least.setdefault(sets.find(i), i)
    got = {r["doc_id"]: r["class_doc_id"] for r in line_dedup.line_classes(frame).collect()}
    assert got == {i: least[sets.find(i)] for i in range(len(lines))}
    assert 20 < len(set(got.values())) < len(lines) - 5


def test_short_lines_do_not_chain(spark):
    """Words of a few letters are all within two edits of others; they stay apart."""
    lines = ["A.", "un.", "on.", "Pat.", "The", "That", "ab", "abc", "abcd", "abcde", "abcdef", "abcdeg", "abcdefgh"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {lines[r["doc_id"]]: lines[r["class_doc_id"]] for r in line_dedup.line_classes(frame).collect()}
    assert got == {x: "abcdef" if x == "abcdeg" else x for x in lines}


# --- 8: languages ------------------------------------------------------------------------


def test_languages(spark, docs, rows, none):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(table.where(~out))
    got = language_id.predict(table, model).join(table.select("doc_id", "lang", out.alias("out")), "doc_id").collect()
    held = [r for r in got if r["out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    odd = language_id.predict(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert by[0] == by[1] == by[2] == by[3] == "und" and by[4] in model.languages
    assert language_id.predict(none, model).count() == 0
    empty = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}


# --- 9: pages ------------------------------------------------------------------------------

LONG = "It was the best of the days in the house of a friend and they had been there for a long time, so that all of it was as it is. " * 2
PAGES = [
    (None, ""), ("", ""), ("<p>", ""),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Short.</article><footer>(c) {LONG}</footer>",
     f"T\n{LONG.strip()}\nShort."),
    (f"<div class='content'><h2>Head</h2><p>{LONG}</p><p>Be it.</p><p>{LONG}</p></div>",
     f"Head\n{LONG.strip()}\nBe it.\n{LONG.strip()}"),
    (f"<article><p>a &lt;b&gt; &amp; &#8211; {LONG}</p><div id=comments><p>{LONG}</p></div></article>",
     f"a <b> & – {LONG.strip()}"),
    (f"<article><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}<input></form><!-- {LONG} --><script>var a='</p>{LONG}';</script></article>",
     LONG.strip()),
    (f"<div class=cookie-notice><p>{LONG}</p></div><main><p>{LONG}</p><ul><li>one\n two<li>three</ul></main>",
     f"{LONG.strip()}\none two\nthree"),
]


def test_pages(spark):
    frame = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_main_text(frame).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert html_text.extract_main_text(frame.limit(0)).count() == 0
    assert html_text.main_text("<a" * 50 + "<p x='\"><b>" * 50) is not None
    assert html_text.main_text(f"<article>{'<p>' + html.escape(LONG) + '</p>'}" * 200).count("\n") == 199


def test_names_do_not_veto_articles():
    text = LONG.strip()
    for names in ("post-12 post type-post category-news tag-python", "site has-sidebar", "sidebar", "comments"):
        assert html_text.main_text(f"<article class='{names}'><p>{LONG}</p></article>") == text
        assert html_text.main_text(f"<div class='{names}'><article><p>{LONG}</p></article></div>") == text
        assert html_text.main_text(f"<div class='{names}'><p>{LONG}</p></div><p><a href=x>Home</a></p>") == text
    page = f"<article><div class='entry-header'><h1>T</h1></div><h2 id=search>S</h2><p>{LONG}</p>"
    assert html_text.main_text(page + f"<section id=search><p>{LONG}</p><p>Go</p></section>") == f"T\nS\n{text}\n{text}"
    assert html_text.main_text(page + f"<div class='x ads'><p>{LONG * 3}</p></div>") == f"T\nS\n{text}"
    related = f"<div class=related><article><p>A card.</p></article></div>"
    assert html_text.main_text(page + "</article>" + related) == f"T\nS\n{text}"


OTHERS = [
    "Это было лучшее время в доме моего старого друга, и они жили там очень долго, так что все осталось как есть.",
    "Ήταν η καλύτερη εποχή στο σπίτι ενός φίλου και ζούσαν εκεί για πολύ καιρό, ώστε όλα έμειναν όπως ήταν πριν.",
    "كانت أفضل الأيام في بيت صديق لي وقد عاشوا هناك زمنا طويلا حتى بقي كل شيء على ما هو عليه دون أي تغيير يذكر أبدا.",
    "那是朋友家里最好的日子，他们在那里住了很久，所以一切都保持原样，没有任何改变，人们仍然记得那段时光。" * 2,
]


@pytest.mark.parametrize("text", OTHERS)
def test_pages_without_known_stop_words(text):
    nav = "<nav><a href=x>Home</a></nav>"
    assert len(text) >= html_text.RULES.short_chars
    assert html_text.main_text(f"<div><p>{text}</p><p>{text * 3}</p></div>") == f"{text}\n{text * 3}"
    page = f"{nav}<div><p>{text * 3}</p><p>{text}</p><p><a href=x>{text}</a></p></div><footer>{text}</footer>"
    assert html_text.main_text(page) == f"{text * 3}\n{text}"


def test_blocks_without_stop_words():
    code = "x0 = f(y1, y2); " * 5
    names = "Kowalski, Jan; Nowak, Anna; " * 8
    nav, foot = "<nav><a href=x>Home</a></nav>", "<footer>(c) X</footer>"
    page = f"<p>{LONG}</p><pre>{code}</pre><p>{LONG}</p><pre>{names}</pre>"
    want = "\n".join(x.strip() for x in (LONG, code, LONG, names))
    assert html_text.main_text(page) == want
    assert html_text.main_text(nav + page + foot) == want
    assert html_text.main_text("<p>One line.</p><p>Another line.</p>") == "One line.\nAnother line."
    assert html_text.main_text(f"{nav}<p>One line.</p><p>Another line.</p>{foot}") == "One line.\nAnother line."


def test_links_in_articles():
    link = "<a href=x>A. Author, A title of some length, 2001, in a journal of the field, pages 1 to 20</a>"
    line = "A. Author, A title of some length, 2001, in a journal of the field, pages 1 to 20"
    page = f"<nav>{link}</nav><article><p>{LONG}</p><ul><li>{link}<li><a href=y>B</a></ul><p>{link}</p>"
    page += f"<table><tr><td><a href=z>C</a></table></article><p>{link}</p>"
    assert html_text.main_text(page) == f"{LONG.strip()}\n{line}\nB\n{line}\nC"
    assert html_text.main_text(f"<p>{LONG}</p><ul><li>{link}</ul>") == LONG.strip()


def test_articles_beside_the_text():
    cards = "<article><h3><a href=x>Card</a></h3><p><a href=x>A teaser of a few words</a></p></article>" * 3
    page = f"<div id=content><p>{LONG}</p><p>{LONG}</p></div><div>{cards}</div>"
    got = html_text.main_text(page)
    assert got.startswith(f"{LONG.strip()}\n{LONG.strip()}") and "teaser" not in got
    got = html_text.main_text(f"<main></main><div>{cards}</div><div><p>{LONG * 2}</p></div>")
    assert (LONG * 2).strip() in got and "teaser" not in got
    short = f"<div class=ad>{LONG}</div><article><p>One line.<p>Another line.</article>"
    assert html_text.main_text(short) == "One line.\nAnother line."
    posts = f"<article><p>{LONG}</p></article>" * 2
    assert html_text.main_text(posts + f"<p><a href=x>{LONG}</a></p>") == f"{LONG.strip()}\n{LONG.strip()}"


def test_comments_adverts_and_notices_in_articles():
    rest = f"<p>{LONG}</p><p>{LONG}</p>"
    want = f"{LONG.strip()}\n{LONG.strip()}"
    extra = f"<p>{LONG} And <b>more</b> of it.</p>"
    for odd in (
        f"<section class=comment-section><h3>3 comments</h3>{extra * 3}</section>", f"<div class=advertisement-box>{extra}</div>",
        f"<div class='alert alert-warning'>{extra}</div>", f"<div id=post-comments>{extra}</div>", f"<div class=adSlot2>{extra}</div>",
        f"<div role=complementary>{extra}</div>", f"<ul class=user_comments><li>{extra}</ul>", "<div class=newsletter-signup><p>Join us</p></div>",
    ):
        assert html_text.main_text(f"<article>{rest}{odd}</article>") == want, odd
    for fine in ("has-sidebar", "category-news", "tag-python", "ad-free", "cookie-recipe", "comment-policy-text", "notice-board", "main-content"):
        page = f"<article class={fine}><div class={fine}><p>{LONG}</p></div><p>{LONG}</p></article>"
        assert html_text.main_text(page) == want, fine
    # A name on all of an article's text says nothing.
    assert html_text.main_text(f"<article><div class=notice>{rest}</div></article>") == want


def plain_blocks(page):
    """Blocks by plain searches of the whole stack: (text, outside, inside, heading, names around it)."""
    out, stack, now = [], [], None
    for m in re.finditer(r"<(/?)([a-z0-9]+)((?: [^>]*)?)>|([^<]+)", page):
        closing, name, attributes, text = m[1], m[2], m[3] or "", m[4]
        if text:
            if now is None:
                now = [[], any(e["outside"] for e in stack), any(e["inside"] for e in stack),
                       any(e["name"] in html_text._HEADINGS for e in stack), [e["mark"] for e in stack if e["mark"]], 0]
                out.append(now)
            now[0].append(text)
            now[5] += len(text) * any(e["name"] == "a" for e in stack)
            continue
        if name in html_text._BLOCKS:
            now = None
        names = [i for i, e in enumerate(stack) if e["name"] == name]
        if closing:
            if names:
                del stack[names[-1] :]
            continue
        while stack and name in html_text._CLOSED_BY.get(stack[-1]["name"], ()):
            stack.pop()
        blocks = [i for i, e in enumerate(stack) if e["name"] in html_text._BLOCKS]
        if name in html_text._BLOCKS and blocks and stack[blocks[-1]]["name"] == "p":
            del stack[blocks[-1] :]
        around = any(e["inside"] for e in stack)
        value = re.search("class=([^ >]+)", attributes)
        kind = html_text.judged_names(value[1]) if value and name in html_text._BLOCKS and name not in html_text._UNNAMED else ""
        stack.append({
            "name": name, "inside": name in ("article", "main"), "mark": {"kind": kind, "inside": around, "holds": False} if kind else None,
            "outside": name in html_text._OUTSIDE or "hidden" in attributes or (name == "header" and not around),
        })
        if name in ("article", "main") and not any(e["outside"] for e in stack):
            for e in stack:
                if e["mark"]:
                    e["mark"]["holds"] = True
    for b in out:
        b[0] = " ".join(html.unescape("".join(b[0])).split())
    return [b for b in out if b[0]]


def plain_ruled_out(blocks, text):
    weights = [0 if b[1] else max(len(b[0]) - b[5], 0) for b in blocks]
    out = []
    for b, t in zip(blocks, text):
        bad = b[1]
        for e in b[4]:
            own = [(x, w) for x, w in zip(blocks, weights) if any(e is y for y in x[4])]
            beside = sum(w for x, w in zip(blocks, weights) if x[2]) - sum(w for x, w in own if x[2])
            below = sum(w for _, w in own)
            counts = 2 * beside > sum(weights) if e["holds"] else (beside > 0 and e["kind"] == "bad") or 2 * below <= sum(weights)
            bad = bad or (counts and not (e["kind"] == "weak" and t))
        out.append(bad)
    return out


def test_blocks_equal_a_plain_version():
    rnd = random.Random(9)
    names = ["div", "p", "ul", "li", "a", "b", "h2", "article", "main", "nav", "header", "section", "table", "tr", "td", "span", "footer"]
    classes = ["", "", "", " class=comments", " class=menu", " class=ad-box", " class=text", " class=share", " hidden"]
    for _ in range(400):
        page = ""
        for _ in range(rnd.randint(1, 60)):
            name = rnd.choice(names)
            page += rnd.choice([f"<{name}{rnd.choice(classes)}>", f"</{name}>", "word " * rnd.randint(1, 30), "x &amp; y "])
        blocks, plain = html_text.blocks_of(page), plain_blocks(page)
        assert [(b.text, b.outside, b.inside, b.heading, b.linked) for b in blocks] == [(b[0], b[1], b[2], b[3], b[5]) for b in plain]
        text = [rnd.random() < 0.5 for _ in blocks]
        assert html_text._ruled_out(blocks, text) == plain_ruled_out(plain, text), page


def test_pages_of_any_nesting_are_linear():
    start = time.perf_counter()
    for page in (
        "<div>" * 16_000 + LONG, "<div class=menu>y" * 16_000, "<div>" * 8_000 + "</p></b></span>" * 8_000, "<option>" * 16_000 + "z",
        "<b>" * 16_000 + "<p>t</p>" * 4_000, "<article>" + "<div class=comment-box><article>x" * 8_000, "<h1><b>x" * 8_000,
    ):
        html_text.main_text(page)
    assert time.perf_counter() - start < 5


# --- 10: n-gram Jaccard join ------------------------------------------------------------------


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize(("percent", "n"), [(85, 4), (50, 2)])
def test_jaccard_classes(docs, rows, none, percent, n):
    got = ngram_join.jaccard_classes(docs, percent, n).collect()
    held, sets = [shingles(r[1], n) for r in rows], Sets()
    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                sets.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if held[i] and r[0] is not None:
            least[sets.find(i)] = min(r[0], least.get(sets.find(i), r[0]))
    want = Counter((r[0], len(held[i]), least.get(sets.find(i)) if held[i] else r[0]) for i, r in enumerate(rows))
    assert counted(got) == want
    kept = ngram_join.keep_first(docs, percent, n)
    assert kept.columns == docs.columns
    classes = {sets.find(i) for i in range(len(rows)) if held[i]}
    blank = {(r[0], r[1] or "") for i, r in enumerate(rows) if not held[i]}
    assert kept.count() == len(classes) + len(blank)
    assert ngram_join.jaccard_classes(none, percent, n).count() == 0
