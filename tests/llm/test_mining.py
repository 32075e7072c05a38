"""Phrase collocations, secret scans and centroid clustering against brute force, on odd rows and on given tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import automata, centroids, collocations, queries, secretscan

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, a long, phrase string, n long, range int, block string"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_centroid_clustering"])
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert want.columns == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())


def paths_of(a):
    """Every sequence of an automaton with its weight, by walking it."""
    def walk(d, state, path):
        level = a.levels[d]
        for i in range(level.starts[state], level.starts[state + 1]):
            label = level.labels[i]
            here = (*path, a.words[int(label) - 1].as_py()) if label else path
            if d + 1 == len(a.levels):
                yield here, int(level.targets[i])
            else:
                yield from walk(d + 1, int(level.targets[i]), here)
    return dict(walk(0, 0, ()))


def automaton(counts, depth=3):
    rows = sorted(counts)
    words = sorted({w for r in rows for w in r})
    columns = [np.array([words.index(r[d]) + 1 if d < len(r) else 0 for r in rows], np.int64) for d in range(depth)]
    return automata.build(pa.array(words, pa.binary()), columns, np.array([counts[r] for r in rows], np.int64))


words = st.sampled_from([b"a", b"b", b"ab", "é".encode(), b"\x01", b"zz"])
tables = st.dictionaries(st.lists(words, min_size=1, max_size=3).map(tuple), st.integers(1, 5), min_size=1, max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(tables, min_size=1, max_size=4), tables, st.integers(1, 9))
def test_automata(parts, asked, least):
    built = [automata.load(automata.dump(automaton(p))) for p in parts]
    assert [paths_of(b) for b in built] == parts
    total = Counter()
    for p in parts:
        for path, n in p.items():
            for size in range(1, len(path) + 1):
                total[path[:size]] += n
    found = {tuple(p): n for p, n in automata.union(built, least)}
    assert {p: n for p, n in found.items() if n >= least} == {p: n for p, n in total.items() if n >= least}
    assert all(total[p] == n for p, n in found.items())
    order = sorted(asked)
    assert automata.compose(built[0], automaton(asked)).tolist() == [parts[0].get(p, 0) for p in order]


def test_equal_states_are_one():
    """Sequences that end alike share their ends: 50 first words with the same continuations make one state a level."""
    counts = {(b"%02d" % i, x, y): 1 for i in range(50) for x in (b"x", b"y") for y in (b"u", b"v")}
    assert [len(level.starts) - 1 for level in automaton(counts).levels] == [1, 1, 1]


def phrases(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, table in f.items():
        cands = {p: a for p, a in table.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(longest[p[i : i + size]], a)
        rows = []
        for p, a in cands.items():
            score, k = min((2000000 * a // (table[p[:k]] + table[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < share * a:
                rows.append((-score, -a, " ".join(p).encode(), table[p[:k]], table[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "Two", "three", "été", "the", "the", "\x01x", "ZK"]) + rng.choice(["", "", ".", ",\t", "\r"]) for _ in range(rng.randrange(400))) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None, "und", ""]), 1, "x", 2, 3, "y") for i, t in enumerate(texts)]
    rows += [(50, None, "en", 1, "x", 1, 1, "x"), (51, "", None, 1, "x", 1, 1, "x"), (None, None, None, None, None, None, None, None), (52, "the the the " * 5000, "en", 1, "x", 1, 1, "x"), *[rows[0]] * 3]
    for stride, words_, block in ((1024, 1 << 21, 1 << 13), (8, 64, 5)):  # many borders, small shards and blocks
        monkeypatch.setattr(collocations, "STRIDE", stride)
        monkeypatch.setattr(collocations, "RANGE_WORDS", words_)
        monkeypatch.setattr(collocations, "SHARD_BYTES", 1 << 23 if stride == 1024 else 2000)
        monkeypatch.setattr(collocations, "BLOCK", block)
        docs = spark.createDataFrame(rows, DOCS).repartition(5)
        for top in (7, None):
            got = sorted(tuple(r) for r in collocations.collocations(docs, 6, 80, top).collect())
            want = phrases([r[1:3] for r in rows], 6, 80, top)
            assert got == want and len(got) > 20
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 2**62
    rows = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, words int, a long")
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 5)], "lang string, phrase string, a long")
    assert collocations.scored(rows, counts).first()["score"] == 2000000 * big // (2 * big + 5)


def test_trigram_queries():
    q = {r.kind: secretscan.trigram_query(r) for r in secretscan.BASE + secretscan.MORE}
    assert q["hex"] == secretscan.EVERY
    assert q["access"] == frozenset([frozenset(["aki", "kia"])])
    assert frozenset(["tok", "oke", "ken"]) in q["assign"] and frozenset(["api", "pik", "ike", "key"]) in q["assign"]
    assert {"-be", "beg", "pri", "key", "ey-"} <= next(iter(q["private"]))
    assert q["github"] == frozenset(frozenset([f"gh{c}", f"h{c}_"]) for c in "opsu")
    rule = lambda p: secretscan.trigram_query(secretscan.Rule("x", p))
    assert rule("a*b+c?") == rule(".") == rule("(abc)?") == rule("abc|.") == secretscan.EVERY
    assert rule("[^a]bcd") == frozenset([frozenset(["bcd"])])
    assert rule("(foo|bar){2}x") == frozenset([frozenset(["foo"]), frozenset(["bar"])]) or all(a & {"foo", "bar"} for a in rule("(foo|bar){2}x"))


ATOMS = st.recursive(st.sampled_from(["a", "b", "abc", "[ab]", "x_y", "[a-c]", "."]), lambda inner: st.one_of(st.lists(inner, min_size=2, max_size=3).map("".join), st.lists(inner, min_size=2, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"), inner.map(lambda x: f"(?:{x})?"), inner.map(lambda x: f"(?:{x})+"), inner.map(lambda x: f"(?:{x})*"), inner.map(lambda x: f"(?:{x}){{2,3}}")), max_leaves=6)


@settings(max_examples=300, deadline=None)
@given(ATOMS, st.text("abcxy_", max_size=14))
def test_every_match_fulfils_the_query(pattern, text):
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    if re.search(pattern, text):
        assert any(a <= grams for a in secretscan.trigram_query(secretscan.Rule("x", pattern)))


def spans_by_hand(text):
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0, 20, 0), ("hex", r"[0-9a-f]+", 0, 24, 0),
        ("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, 0), ("github", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 0, 0),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 0), ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0, 0),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, 0), ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0, 0),
    ]
    found = sorted((m.start(), n, kind, m.end()) for n, (kind, p, group, least, flags) in enumerate(kinds) for m in re.compile(p, flags).finditer(text or "") if len(m[group]) >= least)
    line = lambda rows: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in rows)
    of = lambda n: sum(x[1] == n for x in found)
    return of(0), of(1), of(2), hashlib.sha256(line([x for x in found if x[1] < 3]).encode()).hexdigest(), line(found)


def test_secrets(spark, tmp_path, monkeypatch):
    key = "0123456789abcdef" * 3
    texts = [
        None, "", "nothing", f"été ✓ PASSWORD = '{key}' and token: abc token: abcdef", "AKIA" + "A1" * 8 + " AKIAAKIA12", "AKIAAKIA" + "9" * 12, f"{key}ſ{key}G{key[:23]}",
        "-----BEGIN RSA PRIVATE KEY----- x -----BEGIN PRIVATE KEY-----", f"ghp_{'a1' * 20} xoxb-1234567890ab AIza{'x' * 36} eyJa.eyJb.c_d sk_live_{'4' * 17}", "api_key\"  :  \"a.b/c+d=", "apikey=12345 apikey=123456 pas sword tok en",
        "word " * 40_000 + f"secret={key}", "toKen=abcdefgh paſsword=abcdefgh", "secret" * 5 + "=secret=secret=",
    ]
    rows = [(i, t, "en", 1, "x", 2, 3, "y") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[3], *rows[0][2:]), (None, None, *rows[0][2:]), (3, texts[8], *rows[0][2:])]
    for size in (1 << 22, 64):
        monkeypatch.setattr(secretscan, "BLOCK_BYTES", size)
        folder = f"{tmp_path}/{size}"
        spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
        df = secretscan.secret_scan(spark, folder)
        assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(((r[0], *spans_by_hand(r[1])) for r in rows), key=str)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert secretscan.secret_scan(spark, f"{tmp_path}/none").count() == 0


def test_secrets_of_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: spans_by_hand(r.text) for r in docs}
    assert sum(x[0] for x in got.values()) > 5


def test_index_of_all_trigrams(spark):
    """An index without a list of trigrams holds every one of them."""
    rows = secretscan.keyed(spark.createDataFrame([(1, "abcd"), (2, "Bcde"), (3, None), (4, "éa")], "doc_id long, text string"))
    got = secretscan.index(rows.coalesce(1)).filter("gram >= 0").collect()
    named = {int(r.gram).to_bytes(3, "big"): sorted(r.rows) for r in got}
    assert named == {b"abc": [0], b"bcd": [0, 1], b"cde": [1], "éa".encode(): [3]}


def clusters(vectors, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) <= 65536 for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centers)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str)


def test_centroids(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(i % 3, 0.3) for _ in range(64)]) for i in range(90)]
    same = [0.125] * 64
    vectors += [(100 + i, same) for i in range(40)] + [(7, same), (7, [1.0] * 64), (None, [2.0] * 64), (None, same)]
    vectors += [(200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 65), (204, [None, *same[1:]]), (205, [float("nan"), *same[1:]]), (206, [float("-inf"), *same[1:]]), (207, [65536.5, *same[1:]]), (208, [-65536.0, *same[1:]])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, cluster int").repartition(3)
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    for k, rounds in ((6, 4), (40, 2)):
        got, _ = centroids.cluster(df, k, rounds)
        assert sorted(map(tuple, got.collect()), key=str) == clusters(vectors, k, rounds)
    few, centers = centroids.cluster(df.filter("vec_id < 3"), 40, 1)
    assert few.count() == len(centers) == 3
    assert centroids.cluster(df.limit(0))[0].count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 30), st.integers(1, 9))
def test_progressive_search(seed, n, k):
    rng = np.random.default_rng(seed)
    vectors, centers = rng.integers(-3, 3, (n, 64)) << rng.integers(0, 21), rng.integers(-3, 3, (k, 64)) << rng.integers(0, 21)
    distance = ((vectors[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    number, least = centroids.nearest(vectors, centers)
    assert number.tolist() == distance.argmin(axis=1).tolist() and least.tolist() == distance.min(axis=1).tolist()
    assert (centroids.walsh(vectors)[:, 0] == vectors.sum(axis=1)).all()
