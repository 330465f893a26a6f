"""Small tests of the operators against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from larkspur.llm import adscan, circulant, fm_quality, lang_fusion, lpf_dedup, mixing, record_files, repetition, spm_scan, url_filter  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, rows, parts=3):
    full = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, block string").repartition(parts)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeats, a very long text."""
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(80, 400))) for _ in range(9)]
    rows = [(i, "".join(r.choice(base)[r.randrange(0, 30) : r.randrange(60, 400)] for _ in range(r.randrange(0, 5))), "a" if i % 3 else "b") for i in range(90)]
    rows += [(200, None, None), (201, "", "a"), (202, "  \n", "a"), (203, "z" * 30_000, "c"), (204, "one two", "a"), (205, "ONE two", "a"), (206, "é" * 200, "a")]
    return rows


@pytest.fixture(scope="module")
def odd_df(spark, odd):
    return documents(spark, odd).cache()


def empty(df):
    return df.limit(0)


def test_url_filter_brute_force(spark):
    r = random.Random(2)
    hosts = ["net", "a.net", "example.net", "x.example.net", "notexample.net", "example.com", "b.org", "org", "EXAMPLE.net", ""]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x', '/de/', '/fr/a?b#c', '?q', '#/en/'])}" for _ in range(300)] + [None, "", "no scheme", "ftp://a.net/en/://b.org/fr/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string").repartition(4)
    rules = [(v, h, p) for v, h, p in url_filter.RULES] + [("block", "example.net", "/"), ("allow", "x.example.net", "/en/")]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        best = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert got[i] == (host, path, best and best[1], best[2] if best else "allow"), u
    odd = spark.createDataFrame([(None, "http://a.net/en/"), (None, None), (3, "http://x.org/fr/" + "y" * 300_000), (3, "http://x.org/fr/" + "y" * 300_000)], "page_id bigint, url string")
    found = sorted(((x.page_id or 0, x.host, x.rule, x.verdict) for x in url_filter.filter_urls(odd, spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")).collect()), key=lambda x: (x[0], x[1], x[2] or ""))
    assert found == sorted([(0, "a.net", "net/", "block"), (0, "", None, "allow"), (3, "x.org", "org/fr/", "allow"), (3, "x.org", "org/fr/", "allow")], key=lambda x: (x[0], x[1], x[2] or ""))
    assert url_filter.filter_urls(empty(pages), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


def test_token_records_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [*odd, (300, "hello <|endoftext|> x", "a"), (301, "twice", "a"), (301, "twice", "a"), (301, "other", "a"), (None, None, None), (302, "\0 a\u3000 b \u2003c\n d \n", "a"), (303, " lead\ttab x ", "a")]
    df = documents(spark, rows)
    out = f"file://{tmp_path}/records"
    got = record_files.token_records(df, path, path=out).collect()
    of = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((i, len(of(t)), zlib.crc32(of(t).tobytes())) for i, t, _ in rows), key=key)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0)) and 50256 in of("hello <|endoftext|> x").tolist()
    assert record_files.token_records(empty(df), path).count() == 0
    first = sorted(p for p in (tmp_path / "records").iterdir() if p.suffix == ".rec")[0]
    n = first.with_suffix(".idx").stat().st_size // 16
    assert [record_files.read_record(f"file://{first}", k)[0] for k in reversed(range(n))][::-1] == [record_files.NO_ID if i is None else i for i in in_order[:n]]
    broken = bytearray(first.read_bytes())
    broken[30] ^= 1
    first.write_bytes(bytes(broken))
    with pytest.raises(ValueError):
        record_files.read_record(f"file://{first}", 0)


def test_units_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), record_files.Encoder(path)
    r = random.Random(4)
    bits = ["a", "é", " ", "  ", "\n", " the", "ing", "日", "1", "'s", "!", "\t", "\x00", "\x1c", "\u00a0", "\u2003", "<|endoftext|>", "x y"]
    values = ["".join(r.choice(bits) for _ in range(r.randrange(0, 12))) for _ in range(3000)]
    got = enc.encode(pa.array(values))
    for t, ids in zip(values, got):
        assert np.frombuffer(ids, enc.kind).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def brute_repeats(t, m):
    w = re.findall(WORD, t)
    n, cov, rep, longest = len(w), set(), set(), 0
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    for i in range(n - 2):
        if c[tuple(w[i : i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    for i in range(n):
        b = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            b = max(b, k)
        if b >= m:
            longest = max(longest, b)
            cov |= set(range(i, i + b))
    return n, sum(map(len, w)), len(rep), len(cov), longest


def test_repetition_brute_force():
    r = random.Random(2)
    values = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 50))) for _ in range(150)] + ["", " \n ", "a"]
    got = repetition.measure_texts(values, 4)
    names = ("n_words", "word_chars", "n_repeat_words", "n_covered", "longest_repeat")
    assert list(zip(*(got[c].tolist() for c in names))) == [brute_repeats(t, 4) for t in values]
    assert repetition.duplicate_lines("a\nb\na\n \n \na") == 2


def test_each_limit_rejects(spark):
    fresh = iter(f"w{k}" for k in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    a, b, block = new(9), new(9), new(110)
    covered = new(20) + a + new(5) + b + new(5) + a + new(5) + b + new(20) + b
    longest = block + new(190) + block + new(190)
    clean = new(30) + a + new(200) + a + new(20_000)
    texts = [" ".join(w) for w in (covered, longest, clean)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in repetition.verdicts(repetition.measure(df)).collect()}
    assert not any(r.base_failed for r in rows.values()) and [rows[k].kept for k in range(3)] == [False, False, True]
    assert rows[0].n_covered > 0.4 * rows[0].n_words and rows[0].longest_repeat == 9
    assert rows[1].n_covered <= 0.4 * rows[1].n_words and rows[1].longest_repeat == 110
    assert {r.doc_id for r in repetition.keep(df).collect()} == {2}


def test_repetition_frames(odd, odd_df):
    out = {x.doc_id: x for x in repetition.verdicts(repetition.measure(odd_df)).collect()}
    assert len(out) == len(odd) and out[200].n_words == 0 and out[200].base_failed and not out[200].kept
    kept = repetition.keep(odd_df)
    assert kept.columns == odd_df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in out.items() if x.kept}
    assert repetition.keep(empty(odd_df)).count() == 0


def test_mixing(spark, odd_df):
    rows = [(i, "w " * (1 + i % 5), "hot" if i % 3 else f"s{i % 4}", "clash") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    weights = {r.mix_source: r for r in mixing.plan(docs.select(F.col("source").alias("mix_source"), mixing.token_count(F.col("text")).alias("mix_tokens")), 0.97, None, 1.0)[0].collect()}
    w = np.array([r.weight for r in weights.values()])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - 0.97 * np.log(len(w))) < 1e-4
    out = mixing.mix(docs, entropy=0.97, max_repeats=None, block_docs=50)
    got = collections.Counter()
    for r in out.groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect():
        got[r.source] = r.t
    assert all(weights[s].budget - 5 <= got[s] <= weights[s].budget for s in weights)
    whole = out.where("mix_pass = 0").groupBy("source").count().collect()
    assert all(r["count"] == sum(x[2] == r.source for x in rows) for r in whole if r.source != "hot")
    covering = mixing.mix(docs, entropy=0.97, max_repeats=None, budget_ratio=None)
    assert covering.select("doc_id").distinct().count() == 900
    assert mixing.mix(odd_df, budget_ratio=None).where("doc_id >= 200").select("doc_id").distinct().count() == 7
    assert mixing.mix(empty(docs)).count() == 0


def test_mixing_odd_input(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    rows = [(i, "w " * (1 + i % 4), "s" if i % 4 else None, f"own{i}", i) for i in range(200)] + [(None, "a b", "s", "n", 1), (None, "a b c", None, "m", 2), (7, "w w", "s", "again", 3), (7, "w w", "s", "again", 3), (300, "w " * 40_000, "t", "long", 4), (301, None, "t", "null", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_source string, MIX_KEY int").repartition(4)
    out = mixing.mix(docs, entropy=0.9, max_repeats=None, budget_ratio=None, block_docs=10)
    assert sorted(out.columns) == sorted([*docs.columns, "mix_pass", "mix_tokens"])
    got = collections.Counter((r.doc_id, r.text, r.source, r.mix_source, r.MIX_KEY) for r in out.collect())
    want = collections.Counter(rows)
    assert got.keys() == want.keys() and all(got[k] >= want[k] for k in want)
    # Against one running sum over each source: the part of a pass ends at the same document whatever the blocks are.
    one = mixing.mix(docs, entropy=0.9, max_repeats=None, budget_ratio=None, block_docs=10**6)
    assert collections.Counter((r.doc_id, r.text, r.mix_pass) for r in out.collect()) == collections.Counter((r.doc_id, r.text, r.mix_pass) for r in one.collect())


def test_mixing_covering_budget_keeps_the_repetition_limit(spark):
    counts = {"hot": 9_000, **{f"m{k}": 960 for k in range(15)}, "s0": 900, "s1": 840, "s2": 270, "s3": 90}
    rows = [(s, n) for s, n in counts.items()]
    tokens = spark.createDataFrame(rows, "mix_source string, mix_tokens bigint")
    p = {s: n / sum(counts.values()) for s, n in counts.items()}
    worst = lambda a: max(x ** (a - 1) for x in p.values()) * max(x ** (1 - a) for x in p.values())
    got = mixing.plan(tokens, 0.97, 4.0, None)[0].collect()
    a = got[0].exponent
    assert all(r.tokens <= r.budget <= 4 * r.tokens + 1 for r in got), {r.mix_source: r.budget / r.tokens for r in got}
    assert worst(a) <= 4 + 1e-9 and worst(a - 1e-6) > 4
    docs = spark.createDataFrame([(i, "w " * 30, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n // 30))], "doc_id bigint, text string, source string")
    times = mixing.mix(docs, entropy=0.97, max_repeats=4.0, budget_ratio=None).groupBy("doc_id").count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    assert times.n == docs.count() and times.most <= 4


def test_factorisation_machine(spark, odd_df):
    r = random.Random(1)
    texts = [" ".join(r.choice(["good", "fine", "nice"] if k % 2 else ["bad##", "JUNK!!", "worse$$"]) for _ in range(30)) for k in range(200)]
    rows = [fm_quality.features(t, len(t)) for t in texts]
    bias, w, v = fm_quality.fit(rows, np.array([k % 2 for k in range(200)], float))
    m = fm_quality.margins(rows, bias, w, v)
    assert ((m > 0) == np.array([k % 2 == 1 for k in range(200)])).all()
    i, x = rows[0]
    pairs = sum(float(v[i[a]] @ v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert abs(float(m[0]) - (bias + float((w[i] * x).sum()) + pairs)) < 1e-3
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    scored = fm_quality.score(odd_df, fm_quality.train(odd_df, none)).collect()
    assert len(scored) == odd_df.count() and all(abs(s.score - 0.5) < 1e-6 for s in scored)


def test_quality_is_learned_from_whole_texts(spark):
    # The first 700 distinct words are the same in all texts; what tells them apart comes after.
    head = " ".join(f"w{k}" for k in range(700))
    rows = [(i, head + " " + " ".join(f"{'good' if i % 2 else 'poor'}{k}" for k in range(300)), i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    scores = {r.doc_id: r.score for r in fm_quality.score(df, fm_quality.train(df.where("doc_id < 900"), df.select("doc_id", "quality").where("doc_id < 900"))).collect()}
    assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(900, 1000))
    part = pa.RecordBatch.from_pydict({"text": [rows[0][1]], "n_chars": pa.array([None], pa.int64()), "label": [0.0]})
    fitted = next(fm_quality.fit_batches(iter([part])))
    idx, val = fm_quality.features(rows[0][1], None)
    assert fitted.column(1)[0].as_py() == idx.tobytes() and fitted.column(2)[0].as_py() == val.tobytes()


def test_quality_odd_rows(spark):
    rows = [(1, "fine words here", 3, "c"), (1, "fine words here", 3, "c"), (None, "fine words here", 3, "c"), (2, None, None, None), (3, "", 0, "c"), (4, "x" * 200_000 + " y", 200_002, "c"), (5, "BAD## " * 50_000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, label string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (5, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    scored = fm_quality.score(docs, fm_quality.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    same = {r.score for r in scored if r.doc_id in (1, None)}
    assert len(same) == 1 and next(iter(same)) > next(r.score for r in scored if r.doc_id == 5)
    # Scores are the machine's, computed by all pairs in double precision.
    bias, w, v = model = fm_quality.train(docs, labels)
    w, v = w.astype(float), v.astype(float)
    by_id = {r.doc_id: r.score for r in fm_quality.score(docs, model).collect()}
    for i, t, n, _ in rows:
        idx, val = fm_quality.features(t or "", n)
        val = val.astype(float)
        m = bias + (w[idx] * val).sum() + sum(float(v[idx[a]] @ v[idx[b]]) * val[a] * val[b] for a in range(len(idx)) for b in range(a))
        assert abs(by_id[i] - 1 / (1 + np.exp(-m))) < 1e-4


def test_quality_is_learned(spark, sf_dir):
    out = fm_quality.op5_fm_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((out.predicted == 1) == (out.quality == 1)).mean() > 0.85


def test_sentencepiece_equals_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), spm_scan.Model(path)
    r = random.Random(1)
    bits = ["a", "b", "é", " ", "  ", "\n", "the", "ing", " t", "日", "▁", "!", "aaaa", "\t", "x", "\x00"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randrange(0, 25)))
        assert np.frombuffer(model.encode(t), "<i4").tolist() == sp.encode(t), repr(t)
        assert model.decode(model.encode(t)) == t.replace("▁", " ")
    for n in range(60):
        t = "".join(r.choice(["a", "b", "the", "ing", "aaaa", "1", "on"] + ([" "] if n % 3 == 0 else [])) for _ in range(300)).replace("  ", " ").strip()
        assert model.ids_of(spm_scan.scan_text(model, " " + t, 64)) == sp.encode(t)


@pytest.mark.parametrize("size", [128, spm_scan.CHUNK])
def test_sentencepiece_frames(spark, odd, size):
    import sentencepiece

    rows = [*odd, (300, "again and\n again  " * 40, "a"), (300, "again and\n again  " * 40, "a"), (300, "other", "a"), (None, "no id", "a"), (None, None, None), (301, "x y" * 20_000, "a"), (302, "▁ a▁", "a")]
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = [(r.doc_id, np.frombuffer(r.ids, "<i4").tolist(), r.round_trip) for r in spm_scan.encode(documents(spark, rows), path, size).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((i, sp.encode(t or ""), True) for i, t, _ in rows), key=key)
    assert spm_scan.encode(empty(documents(spark, rows)), path).count() == 0


def brute_removed(rows, length=100):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_brute_force(odd, odd_df, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lpf_dedup.dedup(odd_df, hot).collect()}
    assert got == brute_removed(odd)


def test_equal_doc_ids_count_by_place(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(300))
    df = documents(spark, [(1, text, "a"), (1, text, "a"), (None, text[:150], "a"), (None, text[:150], "a")], 2)
    got = sorted((r.n_bytes, r.n_removed) for r in lpf_dedup.dedup(df).collect())
    # The null ids come first: one of them stays, and of the others what it does not cover, once.
    assert got == [(150, 0), (150, 150), (300, 150), (300, 300)]


def test_equal_fingerprints_only_nominate(monkeypatch):
    r = random.Random(6)
    parts = ["".join(r.choice("abcdefgh ") for _ in range(260)) for _ in range(6)]
    rows = [(i, parts[i % 6][: 200 + i] + parts[(i + 1) % 6]) for i in range(12)]
    raws = [t.encode() for _, t in rows]
    real = lpf_dedup.anchors

    def collide(*a):
        key, print_, *rest = real(*a)
        return key * 0, print_ * 0, *rest

    monkeypatch.setattr(lpf_dedup, "anchors", collide)
    blob = lpf_dedup.zstandard.ZstdCompressor().compress(b"".join(raws))
    block = lpf_dedup.Block(0, np.arange(12, dtype="<i8").tobytes(), np.array([len(x) for x in raws], "<i8").tobytes(), blob)
    (key, head, tail), (h, t) = block.reduced()
    kept = {block.raw[a : b + 100] for a, b in zip(head.tolist(), tail.tolist())}
    assert len(h) and len(kept) > 1 and all(block.raw[a : b + 100] in kept for a, b in zip(h.tolist(), t.tolist()))


def test_previous_factors_brute_force():
    r = random.Random(8)
    for _ in range(60):
        n, least = r.randrange(2, 60), r.randrange(1, 5)
        s = "".join(r.choice("ab") for _ in range(n))
        data = np.frombuffer(s.encode(), np.uint8)
        lengths, ranks = lpf_dedup.suffix_ranks(data, 100)
        order = np.array(sorted(range(n), key=lambda i: s[i:]))
        assert (np.diff(ranks[-1][order]) > 0).all()
        shared = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)
        lcp = np.r_[0, lpf_dedup.common_prefix(data, lengths, ranks, order[:-1], order[1:])]
        assert lcp[1:].tolist() == [shared(i, j) for i, j in zip(order[:-1].tolist(), order[1:].tolist())]
        got = np.empty(n, np.int64)
        got[order] = lpf_dedup.previous_factors(order, lcp, least)
        want = [max((shared(i, j) for j in range(i)), default=0) for i in range(n)]
        assert got.tolist() == [x if x >= least else 0 for x in want]


def test_judge_by_batches():
    r = np.random.default_rng(3)
    rows = sorted(zip(r.integers(0, 30, 400).tolist(), r.integers(0, 5, 400).tolist(), range(400)))
    rows += [(99, i // 2, 1000 + i) for i in range(40)]
    key, d, place = (np.array(c, np.int64) for c in zip(*rows))
    for hot in (3, 50):
        for size in (1, 2, 7, 1000):
            judge, out = lpf_dedup.Judge(hot), set()
            for k in range(0, len(key), size):
                b = judge.feed(*(x[k : k + size] for x in (key, d, d, place * 0, place)))
                out |= set(zip(*(c.to_pylist() for c in b.columns))) if b is not None else set()
            want = set()
            for g in set(key.tolist()):
                own = [(x, p) for k, x, p in rows if k == g]
                first = {}
                for x, p in own:
                    if x in first:
                        want.add((g, 0, p, lpf_dedup.COPY))
                    else:
                        first[x] = p
                for n, p in enumerate(first.values()):
                    if len(first) > 1 and n < hot:
                        want.add((g, 0, p, lpf_dedup.MEET))
                    if len(first) > hot:
                        want.add((g, 0, p, lpf_dedup.WINDOWS))
            assert out == want


def test_suffix_dedup_rewrites(odd, odd_df):
    out = lpf_dedup.remove(odd_df)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == odd_df.columns and len(rows) == len(odd)
    assert rows[200].text is None and rows[201].text == "" and rows[206].n_chars == len(rows[206].text)
    assert lpf_dedup.remove(empty(odd_df)).count() == 0 and lpf_dedup.dedup(empty(odd_df)).count() == 0


def brute_components(rows, k):
    s = {}
    for i, t, _ in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        s[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in s}
    changed = True
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {i: (len(s[i]), comp[i], comp[i] == i) for i in s}


@pytest.mark.parametrize("rounds,block", [(2, 1024), (0, 16)])
def test_near_duplicates_brute_force(spark, odd, monkeypatch, rounds, block):
    monkeypatch.setattr(circulant, "ROUNDS", rounds)
    monkeypatch.setattr(circulant, "BLOCK", block)
    r = random.Random(3)
    base = [[f"{r.choice('abcdefgh')}{r.randrange(40)}" for _ in range(60)] for _ in range(3)]
    rows = list(odd)
    for i in range(300, 380):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(60)] = f"z{r.randrange(9)}"
        rows.append((i, " ".join(w), "a"))
    df = documents(spark, rows)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in circulant.near_duplicates(df, 2).collect()}
    assert got == brute_components(rows, 2)
    kept = circulant.keep(df, 2)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_near_duplicates_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(circulant, "SPREAD", 3)
    r = random.Random(9)
    base = [f"w{k}" for k in range(40)]
    near = lambda: " ".join(x if r.random() > 0.03 else f"z{r.randrange(5)}" for x in base)
    rows = [(i, near(), "a") for i in range(40, 70)] + [(50, near(), "a"), (50, "quite another text of its own", "a"), (90, "quite another text of its own", "a"), (None, "no id one", "a"), (None, "no id two words more", "a"), (95, "no id one", "a"), (96, "", "a"), (96, "", "a"), (97, "lone " * 30_000, "a")]
    df = documents(spark, rows)
    got = collections.Counter(tuple(x) for x in circulant.near_duplicates(df, 2).collect())
    sets = [({tuple(w[j : j + 2]) for j in range(max(1, len(w) - 1))} if (w := (t or "").split()) else set()) for _, t, _ in rows]
    ids = [-1 if i is None else i for i, _, _ in rows]
    parent = {i: i for i in ids}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(ids[x]), root(ids[y])))
                parent[b] = a
    null = lambda i: None if i == -1 else i
    assert got == collections.Counter((null(i), len(s), null(root(i)), root(i) == i) for i, s in zip(ids, sets))
    kept = circulant.keep(df, 2).collect()
    assert {x.doc_id for x in kept} == {null(i) for i in ids if root(i) == i}


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingle_sets_of_arrow_texts(size):
    # Words that differ in the last byte, by a NUL, at the edges of eight bytes and of LONG; blanks are only the six.
    words = [x for k in (1, 7, 8, 9, 16, 63, 64, 65, 72, 200) for x in ("a" * k, "a" * (k - 1) + "b", "a" * k + "\0")] + ["É", "é", "x\x1cy", "x\x85y", "x\u00a0y", "Aa"]
    r = random.Random(4)
    values = ["", " ", "\t\r\n\x0b\x0c ", "lone", " Two  words ", *("".join(r.choice(words) + r.choice([" ", "\n\t", "\x0b", "\x0c\r"]) for _ in range(n)) for n in (1, 2, 4, 5, 90, 90, 90)), None, "lone"]
    got = circulant.shingle_sets(pa.array([v or "" for v in values]).slice(1), size)
    want = []
    for v in values[1:]:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), v or ""))
        want.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    assert all((np.diff(g.astype(object)) > 0).all() for g in got)
    for g, x in zip(got, want):
        assert [len(np.intersect1d(g, h)) for h in got] == [len(x & y) for y in want]


def test_band_keys_cost_less_than_their_definition():
    r = np.random.default_rng(1)
    sets = [np.sort(r.integers(0, 1 << 64, 500, np.uint64)) for _ in range(120)]

    def plain():
        with np.errstate(over="ignore"):
            at, flat = np.arange(0, 60_000, 500), circulant.permute((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
            for k in range(circulant.BANDS * circulant.ROWS):
                np.minimum.reduceat(circulant.permute(flat - np.uint32(k)), at)

    def seconds(f):
        begin = time.process_time()
        f()
        return time.process_time() - begin

    assert min(seconds(lambda: circulant.band_keys(sets)) for _ in range(7)) < 0.85 * min(seconds(plain) for _ in range(7))


def test_band_keys_match_as_often_as_the_sets_are_alike():
    r = np.random.default_rng(2)
    for inter, own in ((16, 2), (400, 50), (200, 100)):
        x = r.integers(0, 1 << 64, (1500, inter + 2 * own), np.uint64)
        keys = circulant.band_keys([np.sort(s) for y in x for s in (y[: inter + own], np.r_[y[:inter], y[inter + own :]])])
        met, p = (keys[::2] == keys[1::2]).sum(1), (inter / (inter + 2 * own)) ** circulant.ROWS
        assert abs(met.mean() - circulant.BANDS * p) < 5 * (circulant.BANDS * p * (1 - p) / 1500) ** 0.5
        assert inter / (inter + 2 * own) < 0.8 or met.min() > 0


def test_shared_bands_are_looked_up_and_rows_not_sorted(spark):
    classes = spark.createDataFrame([(i, 9, [i, 100 + i % 7, 200 + i // 4]) for i in range(40)], "node bigint, n bigint, bands array<bigint>")
    got = circulant.shared_buckets(classes)
    assert sorted(map(tuple, got.select("band", "node").collect())) == sorted((b, i) for i in range(40) for b in (100 + i % 7, 200 + i // 4))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_near_duplicates_empty(odd_df):
    assert circulant.near_duplicates(empty(odd_df)).count() == 0 and circulant.keep(empty(odd_df)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[100:200] = x[100]  # a common vector
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(600)] + [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in adscan.search(df, F.col("vec_id") % 20 == 0, probes=10_000).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        others = np.delete(np.arange(600), q)
        best = others[np.lexsort((others, -s[others]))[:20]]
        found = [v for _, v, _ in sorted(got[q])]
        assert len(found) == 20 and all(abs(score - s[v]) < 1e-12 for _, v, score in got[q])
        hit += len(set(found) & set(best))
    assert hit / (30 * 20) > 0.97 and sorted(v for _, v, _ in got[100]) == list(range(101, 121))
    few = adscan.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4 and adscan.search(df.limit(0), F.lit(True)).count() == 0


def test_repeated_queries(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(20, [float(v) for v in x[20]]), (40, [float(v) for v in -x[40]]), (None, [1.0] * 8), (7, [1.0] * 5)]
    got = collections.Counter((r.query_id, r["rank"]) for r in adscan.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect())
    # Equal rows are one query; id 40 has two vectors, each with ranks of its own.
    assert got == {(q, k): 2 if q == 40 else 1 for q in (0, 20, 40) for k in range(1, 6)}


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_of_the_default_probes(spark, clustered, monkeypatch):
    rng = np.random.default_rng(9)
    n, d = 6000, 24
    x = rng.standard_normal((n, d))
    if clustered:
        x = x * 0.3 + rng.standard_normal((40, d))[rng.integers(0, 40, n)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(adscan, "QUERY_PART", 50)
    found = collections.defaultdict(set)
    for r in adscan.search(df, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
        assert len(found[q]) == 20
    assert hit / (n // 20 * 20) >= 0.9


def brute_fusion(pages, logp, langs, words, strength):
    """Posteriors page by page, the priors of each from all other pages."""
    n = len(langs)
    at = {w: lang_fusion.TextModel(logp, words) for w in [0]}[0]
    rows = []
    for i, url, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)", url or "")
        host = m[1].lower() if m else ""
        text = re.sub(lang_fusion.MARKUP, " ", html or "")
        said = re.search(r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", html or "")
        declared = "" if not said else said[1].lower() if said[1].lower() in langs else "other"
        ll = at.loglik(text)
        p = np.exp(ll - ll.max())
        rows.append((i, host, ".".join(host.split(".")[-2:][::-1]), host.split(".")[-1], declared, ll, p / p.sum()))
    total = sum(r[6] for r in rows)
    prior0 = (total + 1) / (total.sum() + n)
    said = {k: sum((r[6] for r in rows if r[4] == k), np.zeros(n)) for k in {r[4] for r in rows}}
    out = {}
    for i, host, domain, suffix, declared, ll, p in rows:
        prior = prior0
        for same in (lambda r: r[3] == suffix, lambda r: r[2] == domain and r[3] == suffix, lambda r: r[1] == host):
            s = np.maximum(sum((r[6] for r in rows if same(r)), np.zeros(n)) - p, 0)
            prior = (s + strength * prior) / (s.sum() + strength)
        score = ll + np.log((said[declared] + 0.5) / (total + 0.5 * (n + 2))) + np.log(prior)
        q = np.exp(score - score.max())
        out.setdefault(i, []).append((langs[int(np.argmax(score))], 1 / q.sum(), langs[int(np.argmax(p))], declared))
    return out


def test_language_fusion_brute_force(spark):
    r = random.Random(12)
    words = {"en": "the house garden quiet water stone light".split(), "fr": "la maison jardin calme eau pierre lumière".split(), "de": "das haus garten ruhig wasser stein licht".split()}
    docs = spark.createDataFrame([(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(60) for k in [list(words)[i % 3]]], "doc_id bigint, text string, lang string")
    hosts = ["a.net", "b.net", "x.b.net", "c.fr", "www.c.fr", "d.de", ""]
    pages = []
    for i in range(120):
        k = r.choice(list(words))
        body = " ".join(r.choice(words[r.choice([k, k, k, "en"])]) for _ in range(r.choice([0, 1, 3, 60])))
        lang = r.choice(["", f' lang="{k}"', " lang=xx", f" lang='{k.upper()}-x'"])
        pages.append((i, f"http://{r.choice(hosts)}/p{i}" if i % 9 else None, f"<html{lang}><p>{body}</p></html>" if i % 11 else None))
    pages += [pages[5], pages[5], (None, "http://a.net/", "<p>the house"), (500, "http://d.de/x", "<p>" + "das haus " * 40_000)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id bigint, url string, html string, lang string, confidence string").repartition(5)
    langs, logp = lang_fusion.fit(docs)
    for most, strength in ((40, 20.0), (5, 3.0)):
        got = collections.defaultdict(list)
        for x in lang_fusion.identify(df, docs, most, strength).collect():
            got[x.page_id].append((x.lang, x.confidence, x.text_lang, x.declared))
        want = brute_fusion(pages, logp, langs, most, strength)
        assert got.keys() == want.keys()
        for i, rows in want.items():
            assert len(got[i]) == len(rows)
            for a, b in zip(sorted(got[i]), sorted(rows)):
                assert a[3] == b[3] and abs(a[1] - b[1]) < 1e-6 and (a[0] == b[0] or b[1] < 0.5001), (i, a, b)


def test_language_fusion(spark):
    en, fr = "the house and the garden were quiet ", "la maison et le jardin sont calmes "
    docs = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)], "doc_id bigint, text string, lang string")
    rows = [(i, f"http://h{i % 2}.net/x", f"<html lang='{'en' if i % 2 else 'fr'}'><p>{en if i % 2 else fr}</p></html>", "z") for i in range(20)]
    rows += [(30, "http://h1.net/y", "<p></p>", "z"), (31, "http://h0.net/y", None, "z"), (32, None, None, "z"), (33, "http://h0.net/q", f"<html lang=xx><script>{en}</script>{fr}", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, lang string")
    got = {r.page_id: r for r in lang_fusion.identify(pages, docs).collect()}
    assert len(got) == 24 and all(got[i].lang == ("en" if i % 2 else "fr") for i in range(20))
    # Without text the host decides.
    assert got[30].lang == "en" and got[31].lang == "fr" and got[33].lang == "fr" and got[33].declared == "other"
    assert lang_fusion.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in lang_fusion.identify(pages, docs.limit(0)).collect()} == {None}
