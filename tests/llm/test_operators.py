"""Small cases of every corpus operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import bitpack, decontaminate, langid, linededup, neardup, packing, quality, repeats, rules, tokens, warc
from callweave.llm.common import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, digest string, family long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "Changed"
    passage = prose(2, 70)
    texts = [
        base, base.upper(), " ".join(near), None, "", " \n\t ", "one", "Two words", "a b c d",
        "short one\n" + passage + "\n" + prose(3, 30), prose(4, 40) + "\n" + passage + "\nshort one",
        passage + "\n" + passage, "été ñandú ÉCOLE " * 30, prose(5, 30_000, 900), "###$$$ | <> ***", "1234 5678",
    ]
    out = [(i, t, "en" if i % 2 else None, "s", 1, "clash", "clash", 7) for i, t in enumerate(texts)]
    return out + [out[0], (None, base, "en", "s", 1, "c", "c", 1), (None, None, None, None, None, None, None, None), (3, "another text under id three", "de", "s", 1, "c", "c", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(docs, rows, nothing):
    got = {(r.doc, r.text_hash): r.removed for r in linededup.removals(docs).collect()}
    keyed = sorted({(r.doc, r.text_hash, r.text) for r in linededup.keyed(docs).collect()}, key=lambda r: r[:2])
    seen, want = [], {}
    for doc, text_hash, text in keyed:
        for n, line in enumerate((text or "").split("\n")):
            w = WORD.findall(fold(line))
            if len(w) < 5:
                continue
            s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            if any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
                want.setdefault((doc, text_hash), []).append(n)
            seen.append(s)
    assert got == want
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert linededup.removals(nothing).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    import corpus_pipeline

    texts = ["Read more\n\nunlike", "read  MORE\nread more now\n\nread", "one two three four five\nread\nREAD more", "more read\n \nfive\nOne two three four five", "one two three four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), {}
    for i, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            w = tuple(WORD.findall(fold(line)))
            if w in seen:
                want.setdefault(i, []).append(n)
            seen |= {w} if w else set()
    assert {r.doc_id: r.removed for r in linededup.line_dedup(spark, str(tmp_path)).filter("n_removed > 0").collect()} == want
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want.get(i, [])) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {i: t for i, t in left.items() if WORD.search(t)}


def test_line_candidates_of_cut_runs(spark):
    rng = random.Random(8)
    rows = [(node, n := rng.randrange(4, 30), [1, *rng.sample(range(2, 9), k=rng.randrange(3))] if node < 300 else [rng.randrange(9, 40)]) for node in range(900)]
    classes = spark.createDataFrame(rows, "node long, n int, prefix array<bigint>")
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = linededup.candidates(classes, 75).select("*", F.input_file_name().alias("file")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    runs, given, pairs = {}, {}, {(r.a, r.b) for r in got if r.token is None}
    for node, n, prefix in rows:
        for place, token in enumerate(prefix):
            runs.setdefault(token, []).append((n, node, place))
    for r in got:
        if r.token is not None:
            given.setdefault(r.token, []).append(r.node)
    for token, run in runs.items():
        if token in given:  # a long run, or one at the end of a range: all its rows, once each
            assert sorted(given[token]) == sorted(node for _, node, _ in run) or len(run) <= linededup.SHORT_RUN
        if len(run) > linededup.SHORT_RUN:
            assert token in given
            continue
        for i, (n, a, p) in enumerate(sorted(run)):
            for m, b, q in sorted(run)[i + 1 :]:
                if 100 * n >= 75 * m and 175 * (min(p, q) + min(n - p, m - q)) >= 75 * (n + m):
                    assert (min(a, b), max(a, b)) in pairs or {a, b} <= set(given.get(token, []))
    # the run of token 1, a third of all rows, is not one task's
    assert len({r.file for r in got if r.token == 1}) > 2


def test_line_signatures_bound_differences():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 400):
        x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        y = np.unique(np.concatenate([x[: n - n // 4], rng.integers(0, 2**63, n // 3, dtype=np.uint64)]))
        sides = linededup.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert sum(int(s[0] ^ s[1] if s[0] ^ s[1] >= 0 else (s[0] ^ s[1]) + 2**64).bit_count() for s in ([int(v) for v in side] for side in sides)) <= len(np.setxor1d(x, y))


def test_lines_of_a_long_run(spark):
    """A template whose words but for a few are the same, in more lines than a short run or a block holds."""
    rng, base = random.Random(12), prose(51, 40).split()
    texts = [(i, " ".join(base[:k] + [f"z{rng.randrange(9)}"] * m + base[k + m :])) for i in range(700) for k in [rng.randrange(40)] for m in [rng.choice([1, 1, 2, 6])]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc: (r.exact, r.links) for r in linededup.matched_lines(docs).collect()}
    for i, s in enumerate(sets):
        others = {frozenset(o) for o in sets if o != s and 100 * len(s & o) >= 75 * len(s | o)}
        exact = s in sets[:i]
        earlier = exact or any(100 * len(s & o) >= 75 * len(s | o) for o in sets[:i])
        assert (i in got) == earlier
        if i in got:
            assert got[i] == (exact, len(others))


def library(path=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or tokens.default_path())


def library_ids(coder, text):
    return coder.encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = [
    "The don't, I'll 12 x_y!! Éİ ß", "a b c\x1cd \t\r\n  e", "", None, "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "été Straße ２３ 한국어 ㅋㅋ", "it's 'tis rock'n'roll",
    "ÀÉ× ÷÷ Áx e\u0301 \x0b\x0c x\u00a0y z", "x" * 300 + " " + "y'" * 200, "ÇA À\u0300 ΑΣ ΣΑΣ.", "\ufeffhi\u200b there", "½ ²3 ª µm", "<| <|>| |<", "“quoted” – dash…",
]


def test_piece_encoder_equals_library(monkeypatch):
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    coder, own = tokens.PieceEncoder(tokens.default_path()), library()
    assert coder.by_piece
    whole = Path("/root/testdata/sf0.001/documents.parquet")
    texts = ODD_TEXTS + (pq.read_table(whole, columns=["text"]).column("text").to_pylist() if whole.exists() else [])
    for kept in (tokens.KEPT, 40):  # also with a table that is always full
        monkeypatch.setattr(tokens, "KEPT", kept)
        for low in range(0, len(texts), 50):
            part = texts[low : low + 50]
            ids, counts = coder.encode(pa.array(part, pa.string()), 7)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(own, t) + [7] for t in part]


def test_other_vocabularies_are_encoded_whole():
    import pyarrow as pa

    path = tokens.default_path().replace(tokens.DEFAULT_VOCABULARY, "byte_bpe_50k.json")
    coder, own = tokens.PieceEncoder(path), library(path)
    assert not coder.by_piece
    ids, counts = coder.encode(pa.array(ODD_TEXTS), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(own, t) + [1] for t in ODD_TEXTS]


def test_token_files(spark, docs, rows, nothing):
    own = library()
    got = bitpack.read_tokens(bitpack.write_tokens(docs, shared_path(spark, "t")), with_ids=True).collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    at = 0
    for r, (key, text) in zip(sorted(got, key=lambda r: r.start), want):
        ids = np.array(library_ids(own, text) + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (key, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    assert len(got) == len(rows)
    assert bitpack.read_tokens(bitpack.write_tokens(nothing, shared_path(spark, "t"))).count() == 0


def test_token_query(spark, docs, rows, tmp_path):
    """The registered query against the library, for every row."""
    docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    own, at = library(), 0
    got = {r.doc_id: r for r in bitpack.token_ids(spark, str(tmp_path)).collect()}
    for r in sorted(spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(library_ids(own, r.text) + [2], "<u4")
        q = got[r.doc_id]
        assert (q.start, q.n_tokens, q.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(tmp_path, bits):
    from pyarrow import fs

    ids = np.random.default_rng(bits).integers(0, 2**bits, 150_001, dtype=np.uint64).astype("<u4")
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "x.bin"), compression=None) as sink:
        writer = bitpack.Writer(sink, bits)
        for key, part in enumerate(np.array_split(ids, 7)):
            writer.add([key], np.array([len(part)]), part)
        writer.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.bin")) as source:
        reader = bitpack.Reader(source)
        assert (reader.range(0, len(ids)) == ids).all() and (reader.range(65_530, 131_080) == ids[65_530:131_080]).all()
        assert (reader.document(3) == np.array_split(ids, 7)[3]).all() and len(reader.range(5, 5)) == 0


def test_packing(spark, docs, rows, nothing, tmp_path):
    got = packing.pack(docs, shared_path(spark, "p")).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == 4 * r.length and r.offset == 0 for r in got)
    assert [r.length for r in got if r.doc_id == 4] == [1]
    assert packing.decompose(nothing).count() == 0
    docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    own, pieces = library(), {}
    for r in packing.packing(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ids = np.array(library_ids(own, d.text) + [1], "<u4")
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_near_duplicates(docs, rows, nothing):
    got = neardup.near_duplicates(docs).collect()
    sets = {}
    for r in rows:
        w = WORD.findall(fold(r[1]))
        if w and r[0] is not None:
            sets.setdefault(r[0], []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = {k: k for k in {r[0] for r in rows if r[0] is not None}}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(k, root(k)) for k in parent}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    base = prose(41, 120)
    near = (5, base.replace(base.split()[60], "edit", 1))
    got = neardup.near_duplicates(spark.createDataFrame([(2, base), near, near, near, (7, prose(42, 50))], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), *[(5, 2, False)] * 3, (7, 7, True)]


def test_near_duplicate_family_in_blocks(spark, monkeypatch):
    from callweave.llm import families

    monkeypatch.setattr(families, "BLOCK_SETS", 5)
    base = prose(9, 200).split()
    texts = [(i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_repeats(docs, rows, nothing):
    got = {(r.doc, r.text_hash): {x for s in r.spans for x in range(s.begin, s.end)} for r in repeats.repeated_spans(docs).collect()}
    keyed = {(r.doc, r.text_hash): WORD.findall(fold(r.text)) for r in linededup.keyed(docs).collect()}
    where = {}
    for (doc, _), w in keyed.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(doc)
    want = {}
    for key, w in keyed.items():
        hit = {x for i in range(len(w) - 49) if len(where[tuple(w[i : i + 50])]) > 1 for x in range(i, i + 50)}
        if hit:
            want[key] = hit
    assert got == want
    assert repeats.repeated_spans(nothing).count() == 0


def test_minimisers_of_recurring_values():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(0, 30, 4)
        values, window = rng.integers(0, 4, counts.sum()).astype(np.uint64), int(rng.integers(1, 8))
        want, base = set(), 0
        for c in counts:
            want |= {int(base + i + values[base + i : base + i + window].argmin()) for i in range(c - window + 1)}
            base += c
        place, owner = repeats.minimisers(values, counts, window)
        assert place.tolist() == sorted(want)
        low, high = repeats.owned(values, counts, place, owner, window)
        stands = {int(p - b): int(p) for p, lo, hi in zip(place, low, high) for b in range(lo, hi + 1)}
        starts = [int(base + i) for base, c in zip(np.cumsum(counts) - counts, counts) for i in range(c - window + 1)]
        assert stands == {i: i + int(values[i : i + window].argmin()) for i in starts}
        assert sum(high - low + 1) == len(starts)


def test_repeats_of_periodic_text(spark):
    verse = " ".join([prose(31, 20)] * 20)
    texts = [(1, f"{prose(32, 30)} {verse} {prose(33, 30)}"), (2, f"{prose(34, 45)} {verse} {prose(35, 10)}")]
    got = {r.doc: [(s.begin, s.end) for s in r.spans] for r in repeats.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [(30, 430)], 2: [(45, 445)]}


@pytest.mark.parametrize("coalesced, slots", [("true", 1 << 24), ("false", 1 << 24), ("false", 64)])
def test_repeats_whose_sides_only_third_documents_share(spark, monkeypatch, coalesced, slots):
    """Left ends that no nearest neighbour has, in runs inside a sort range and in runs that ranges cut; also with a filter
    of open windows that is full."""
    monkeypatch.setattr(repeats, "WINDOW_SLOTS", slots)
    rng = np.random.default_rng(5)
    core = prose(41, 200).split()
    texts = [(200 + i, " ".join(prose(700 + i, 30).split() + ["same"] * (70 + i % 7) + prose(800 + i % 5, 30).split())) for i in range(30)]
    for i in range(120):
        a, b = sorted(int(x) for x in rng.integers(0, 200, 2))
        a, b = (60, 110) if i < 3 else (a, max(b, min(a + 52, 200)))
        texts.append((i, " ".join(prose(500 + i, 20).split() + core[a:b] + prose(900 + i, 20).split())))
    where = {}
    split = {i: t.split() for i, t in texts}
    for i, w in split.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i: {x for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)} for i, w in split.items()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        found = repeats.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc: {x for s in r.spans for x in range(s.begin, s.end)} for r in found} == {i: w for i, w in want.items() if w}


def test_decontamination(spark, docs, rows, nothing):
    items = spark.createDataFrame([(1, " ".join(rows[9][1].split()[5:25])), (2, "Two, words"), (3, None), (4, "--"), (5, rows[12][1][:90]), (5, "one")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in items.collect():
        w = word.findall(fold(r.text))
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in decontaminate.contamination(docs, items).collect())
    want = Counter()
    for r in rows:
        w, hit, found = word.findall(fold(r[1])), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        want[r[0], len(w), len(hit), tuple(sorted(found)), bool(hit)] += 1
    assert got == want
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_proximity_matches(spark):
    rows = decontaminate.row_keys(spark.createDataFrame([(1, "a b x c d"), (2, "a q q q q q b c d"), (3, "a b c d")], "doc_id long, text string"))
    ranked = decontaminate.materialise(decontaminate.rank_terms(decontaminate.windows(spark.createDataFrame([(1, "a b c d")], "item_id long, text string")), rows), "r")
    assert {r.doc for r in decontaminate.matches(rows, ranked).collect()} == {3}
    assert {r.doc for r in decontaminate.matches(rows, ranked, slack=2).collect()} == {1, 3}


def test_rule_statistics(docs, rows, nothing):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(docs).collect())
    want = Counter()
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(triples)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({i + j for i, t in enumerate(triples) if many[t] > 1 for j in range(3)})] += 1
    assert got == want
    assert rules.statistics(nothing).count() == 0


def test_rule_risk(spark):
    from math import comb

    got = [r.p for r in spark.createDataFrame([(200, 3), (50, 0), (1000, 9)], "n long, k long").select(rules.low_tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect()]
    want = [sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) for n, k in ((200, 3), (50, 0), (1000, 9))]
    assert got == pytest.approx(want, rel=1e-9)
    texts = [(i, prose(i, 80) if i % 4 else "LOUD " + prose(i, 80).upper(), "en") for i in range(3000)]
    stats = rules.materialise(rules.statistics(spark.createDataFrame(texts, "doc_id long, text string, lang string")), "s")
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(3000)] + [(None, 1), (1, None)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in rules.apply(stats, rules.calibrate(stats, labels)).collect()}
    assert not any(kept[i] for i in range(0, 3000, 4)) and sum(kept.values()) > 0.95 * 2250
    assert all(r.kept == (not r.base_failed) for r in rules.apply(stats, rules.calibrate(stats, labels.limit(0))).collect())


def test_language_id(spark, docs, rows, nothing):
    words = {"xx": "the of and ation ing with", "yy": "der und heit keit schen lich"}
    learn = [(i, " ".join(random.Random(i).choices(words[k].split(), k=30)), k) for i in range(200) for k in [("xx", "yy")[i % 2]]]
    model = langid.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "the ation with and"), (2, "und der keit lich"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["xx", "yy", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert [r.rejected for r in got][2:] == [True] * 3
    assert langid.predict(docs, model).count() == len(rows) and langid.accepted(docs, model).columns == docs.columns
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_quality(spark, docs, rows, nothing):
    texts = [(i, prose(i, 60) if i % 2 else prose(i, 60).upper() + "!!! ### |") for i in range(200)]
    table = quality.features(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("label", (F.col("doc_id") % 2).cast("int"))
    model = quality.fit(table)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in quality.score(table, model).collect())
    scored = quality.score(quality.features(docs), model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    alone = quality.fit(table.filter("label = 1"))
    assert {r.score for r in quality.score(table, alone).collect()} == {1.0}
    assert quality.score(quality.features(nothing), quality.fit(table.limit(0))).count() == 0


def test_warc(spark, nothing):
    html = "<p>" + "é" * 200
    pages = [(5, "http://a\nb", html), (2, None, html), (9, "u", html), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", html), (2, "u", html), (7, "u", "x" * 3_000_000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, bundle string")
    index = warc.write_bundles(frame, shared_path(spark, "w"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(index, with_payload=True).collect())
    want = Counter()
    for page, _, text in pages:
        data = (text or "").encode()
        again = text == html and page != 2
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want
    place = index.filter("page_id = 7").first()
    files, name = bitpack._filesystem(place.bundle)
    with files.open_input_file(name) as source:
        assert warc.BundleReader(source).record(place.frame, place.offset)[1] == b"x" * 3_000_000
    assert warc.read_bundles(warc.write_bundles(frame.limit(0), shared_path(spark, "w"))).count() == 0


@pytest.mark.parametrize("ids", ["null", "one", "each twice"])
def test_language_sample_without_ids(spark, ids):
    """Missing and repeated ids change neither the labels that are learned nor what is kept; also beyond the sample's size."""
    words = {"en": "the and of house water", "de": "der und nicht haus wasser", "fr": "le et dans maison eau", "es": "el y los casa agua"}
    rng = random.Random(4)
    texts = [(lang, " ".join(rng.choice(w.split()) + rng.choice(["", "s"]) for _ in range(30))) for _ in range(60) for lang, w in words.items()]
    rows = [(None if ids == "null" else 1 if ids == "one" else i, t, lang) for i, (lang, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows * (2 if ids == "each twice" else 1), "doc_id long, text string, lang string")
    for sample in (3000, 120):
        model = langid.fit(docs, sample=sample, epochs=30)
        assert model.labels == ["de", "en", "es", "fr"]
        assert langid.accepted(docs, model).count() > 0.9 * docs.count()
