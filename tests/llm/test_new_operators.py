"""Ranked search, alignment of tokenizers and language-model scores against brute force, with odd rows."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from larkspur.llm import wand  # noqa: E402


def documents(spark, rows, parts=3):
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 1.0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, score double").repartition(parts)


def words_of(r, n):
    return " ".join(r.choices(["the", "of", "Ünï", "x1", "Rare" + str(r.randrange(60)), "a-b", "deé", "."], k=n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    got = [(i, words_of(r, r.randrange(1, 60))) for i in range(400)]
    got += [(5, got[5][1]), (5, got[5][1]), (None, got[7][1]), (None, None), (900, None), (901, ""), (902, " . - "), (903, "the x1 " * 30_000), (904, "rare3")]
    return got


def best_of(rows, items, top):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, collections.Counter(pattern.findall(lower(t)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        asked, found = collections.Counter(pattern.findall(lower(text))), []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, window, item_bytes, top", [(2_000_000, 256, 4_000_000, 20), (500, 4, 200, 7), (1, 1, 4_000_000, 1)])
def test_wand_equals_all_scores(spark, rows, monkeypatch, shard, window, item_bytes, top):
    for k, v in (("SHARD", shard), ("FIRST_WINDOW", window), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(wand, k, v)
    r = random.Random(3)
    items = [(i, words_of(r, r.randrange(1, 20))) for i in range(25)] + [(3, "rare3 rare3 the"), (3, "rare3 rare3 the"), (None, "Rare5"), (70, None), (71, ""), (72, "the of"), (73, "unheardof")]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id bigint, text string, doc_id double")
    got = [tuple(x) for x in wand.rank(documents(spark, rows, 5), frame, top).collect()]
    assert sorted(got, key=str) == best_of(rows, items, top)


def test_wand_of_nothing(spark, rows):
    items = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    docs = documents(spark, rows)
    assert wand.rank(docs.limit(0), items).count() == 0 == wand.rank(docs, items.limit(0)).count()
    assert wand.rank(documents(spark, [(1, None), (2, " .")]), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_pivots_skip_what_cannot_enter():
    import numpy as np

    n = 20_000
    terms = np.tile(np.array([0, 1]), n)
    terms[3] = 2  # one document holds the rare term instead of the second common one
    shard = wand.Shard(np.arange(n), np.full(n, 9), np.full(n, 2), terms, np.ones(2 * n, np.int64), np.array([1, 2, 9000]), n, 9 * n)
    touched = []
    inner = shard.impacts
    shard.impacts = type("Seen", (), {"__getitem__": lambda self, k: (touched.append(np.size(inner[k])), inner[k])[1]})()
    heap = shard.search(np.array([0, 1, 2]), np.ones(3, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1)
    assert heap[1].tolist() == [1] and sum(touched) < 3 * wand.FIRST_WINDOW


def alignment_of(texts):
    """Tokens of whole texts by the libraries, groups by common byte offsets, every link one by one."""
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    alphabet = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    spelt = {i: bytes(alphabet[c] for c in t) for t, i in tok.get_vocab().items() if all(c in alphabet for c in t)}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        x, y = [spelt[i] for i in a], [piece(i) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(None)
            continue
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (x, y)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        docs.append((len(a), len(b), groups, [(p, q) for g, h in groups for p in g for q in h]))
    counts = collections.Counter(link for d in docs if d for link in set(d[3]))
    most = {}
    for (p, _), n in counts.items():
        most[p] = max(n, most.get(p, 0))
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            name = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d[2])
            best = sum(counts[x] == most[x[0]] for x in d[3])
            yield (d[0], d[1], len(d[2]), len(d[3]), best, sum(counts[x] for x in d[3]), hashlib.sha256(name.encode()).hexdigest())


ODD_TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b\t c", "foo▁bar baz", "<|endoftext|> x<s>y </s>", "naïve café 北京 \U0001f600\U0001f600 x", "\0 a\0b", "\x85a \x85b", "　x y",
             "a\x1c b", "don't we'll", "zz" * 400, "é" * 300, "0" * 77, " \n \n", "a\r\nb", "﻿a b", "ﬁ é x", "==== ====", "x" * 41 + " y", "a b  c"]


def test_alignment_equals_byte_offsets(spark):
    from larkspur.llm import token_align

    r = random.Random(8)
    vocabulary = ["the", "tion", "anthropology", "Zürich", "naïve", "x=1;", "\n", "  ", "日本", "12345", "!?", "Rare", "\t", "😀", "'s", "wh", "ééé"]
    texts = ODD_TEXTS + ["".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "", "\n"]) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    texts += [texts[-1], texts[-2], "the tion Rare " * 2_000]
    rows = list(enumerate(texts)) + [(None, "the x=1;"), (3, "the x=1;"), (3, "the x=1;")]
    got = token_align.align(documents(spark, rows, 5), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *x) for (i, _), x in zip(rows, alignment_of([t for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for none in (documents(spark, rows).limit(0), documents(spark, [(1, None), (2, "")])):
        got = token_align.align(none, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect()
        assert all(tuple(x)[1:] == (0, 0, 0, 0, 0, 0, "") for x in got)


def test_transducer_states():
    from larkspur.llm.token_align import Transducer

    t = Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b"bcx"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)] and t.groups([2, 3], [0, 3]) == [(2, 2)]
    assert t.groups([2, 2], [2, 0, 1]) == [(1, 1), (2, 3)] and t.groups([], []) == []
    assert t.groups([3], [0]) is None is t.groups([0], [0]) is t.groups([2], [2, 2]) is t.groups([2], [])
    before = dict(t.memo)
    assert t.groups([0, 1], [0, 1]) == [(2, 2)] and t.memo == before


def test_arrays_find_what_is_there(tmp_path):
    import numpy as np

    from larkspur.llm.hash_arrays import Arrays, write_part

    path, r = f"file://{tmp_path}/x", np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 64, 5_000, np.uint64))
    values = r.integers(1, 9, len(keys))
    for part, at in ((4, slice(0, 2_000)), (1, slice(2_000, 2_001)), (2, slice(2_001, None))):
        for _ in range(2):  # a second attempt leaves the same
            write_part(path, part, keys[at], values[at].astype("<i4"))
    found = Arrays(path, "<i4", [(4, int(keys[0])), (1, int(keys[2_000])), (2, int(keys[2_001]))])
    asked = np.unique(np.r_[keys[::3], r.integers(0, 1 << 64, 2_000, np.uint64), np.uint64(0)])
    known = dict(zip(keys.tolist(), values.tolist()))
    assert found.find(asked).tolist() == [known.get(k, 0) for k in asked.tolist()]
    assert Arrays(path, "<i4", []).find(asked).sum() == 0 == len(found.find(asked[:0]))
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == [f"part-0000{k}.{e}" for k in (1, 2, 4) for e in ("key", "val")]


def kneser_ney(train, texts, n):
    """Scores by dictionaries, straight from the definition."""
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""]
    levels = {n: collections.Counter()}
    for t in train:
        s = [" "] * (n - 1) + tokens(t)
        levels[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s)))
    for k in range(n - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    raw = collections.Counter(w for t in train for w in tokens(t))
    d = {}
    for k, c in levels.items():
        n1, n2, n3, n4 = (sum(v == x for v in c.values()) for x in (1, 2, 3, 4))
        d[k] = (0, 0.5, 1, 1.5)
        if min(n1, n2, n3):
            y = n1 / (n1 + 2 * n2)
            own = (0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            d[k] = own if all(0 < x < i for i, x in enumerate(own) if i) else d[k]
    follows = {k: collections.defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            follows[k][g[:-1]].append(v)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(raw) + 1)
        seen = follows[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        c = levels[k].get(g, 0)
        return (c - d[k][min(c, 3)] + sum(d[k][min(v, 3)] for v in seen) * p(g[1:])) / sum(seen)

    for t in texts:
        s = [" "] * (n - 1) + tokens(t)
        grams = [tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s))]
        total = sum(raw.values())
        base = sum(math.log10((raw[g[-1]] + 1) / (total + len(raw) + 1)) for g in grams)
        yield len(grams), sum(raw[g[-1]] > 0 for g in grams), base, sum(math.log10(p(g)) for g in grams), total


@pytest.mark.parametrize("n, share, gather", [(1, 0.25, 1_500_000), (2, 0.25, 1_500_000), (2, 0.001, 20), (3, 0.01, 50), (4, 0.25, 1_500_000)])
def test_kneser_ney_equals_definition(spark, rows, monkeypatch, n, share, gather):
    from larkspur.llm import kneser_ney as model

    monkeypatch.setattr(model, "HOT_SHARE", share)
    monkeypatch.setattr(model, "GATHER", gather)
    monkeypatch.setattr(model, "BATCH", 6 * gather)
    monkeypatch.setattr(model, "MANY", 255 if share == 0.25 else 3)
    docs = documents(spark, [r for r in rows if r[0] != 903] + [(906, "a\x0bb\x1cc \x85 é É I İ"), (903, "the x1 " * 300)], 4)
    held = model.held_out(model.F.col("doc_id"))
    known = docs.where(~held).collect()
    got = model.score(docs, model.train(docs.where(~held), n))
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    every = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(every, kneser_ney([r.text for r in known], [r.text for r in every], n))]
    found = sorted(map(tuple, got.collect()), key=lambda x: (str(x[0]), x[1], x[3]))
    assert len(found) == len(want) and 0 < len(known) < len(every)
    for x, y in zip(found, sorted(want, key=lambda x: (str(x[0]), x[1], x[3]))):
        assert x[:3] == y[:3] and x[5] == y[5] and x[3:5] == pytest.approx(y[3:5], rel=1e-9)


def test_kneser_ney_is_a_distribution(spark, rows):
    import numpy as np
    import pyarrow as pa

    from larkspur.llm import kneser_ney as model

    m = model.train(documents(spark, rows).where("doc_id < 300"), 2)
    words = sorted({w for i, t in rows if i is not None and i < 300 and t for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))})
    assert len(words) + 1 == m.vocabulary
    for context in ("the", "rare3", "neverseen"):
        g = model.Grams(pa.array([f"{context} {w}" for w in [*words, "unheard"]] + [context]), 2)
        p, _ = m.probabilities(g)
        # The second token after each start and context; the end follows the bare context.
        places = np.flatnonzero(g.at)[g.starts + 1]
        assert p[places].sum() == pytest.approx(1, abs=1e-9)


def test_kneser_ney_without_texts(spark, rows):
    from larkspur.llm import kneser_ney as model

    docs = documents(spark, rows)
    assert model.score(docs.limit(0), model.train(docs)).count() == 0
    got = model.score(docs, model.train(docs.limit(0))).collect()
    assert len(got) == len(rows) and all((r.n_known, r.base_score, r.score, r.train_tokens) == (0, 0, 0, 0) for r in got)


@pytest.mark.parametrize("name", ["op11_wand_ranking", "op13_kneser_ney"])
def test_equals_sql(spark, sf_dir, name):
    import duckdb

    from larkspur.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.queries()[name](spark, sf_dir)
    theirs = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in theirs.description]
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(plain, df.select(columns).collect())) == sorted(map(plain, theirs.fetchall())) and sorted(columns) == sorted(df.columns)


def test_samples_hold_as_many_rows_as_there_are(spark):
    from larkspur.llm.common import hash_sample

    few = spark.range(40_000).selectExpr("CASE id % 4 WHEN 0 THEN 40 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 13 END AS vec_id", "id")
    for n in (100, 16_384, 39_999, 40_000, 50_000):
        assert hash_sample(few, n, "vec_id").count() == min(n, 40_000)
    assert hash_sample(few.limit(0), 10, "vec_id").count() == 0
    many = spark.range(5_000)
    assert [r.id for r in hash_sample(many, 50, "id").collect()] == [r.id for r in many.orderBy(wand.F.xxhash64("id"), "id").limit(50).collect()]


def test_neighbours_where_few_ids_fill_many_rows(spark):
    import numpy as np

    from larkspur.llm import adscan

    r = np.random.default_rng(4)
    x = r.standard_normal((9_000, 8))
    x[:200] = x[200]  # one vector in many rows
    ids = np.array([40, 5, 6, 13])[np.arange(9_000) % 4]
    ids[:300] = 40
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>").repartition(6)
    got = adscan.search(rows, wand.F.col("vec_id") % 20 == 0, 5)
    found = {}
    for q in got.collect():
        found.setdefault(q.query_id, []).append(q)
    queries = np.unique(x[ids == 40], axis=0)
    assert list(found) == [40] and len(found[40]) == 5 * len(queries)
    assert {q.vec_id for q in found[40]} <= {5, 6, 13}
    best = np.sort(queries @ x[ids != 40].T, axis=1)[:, -5:]
    mine, want = (collections.Counter(np.round(v, 7).tolist()) for v in ([q.score for q in found[40]], best.ravel()))
    assert (mine & want).total() > 0.9 * want.total()


def test_aligned_units_are_the_same_when_their_names_are_known():
    import public_tokenizers
    from larkspur.llm import token_align

    own = token_align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    units = ["the", "house", "tokenizers", "été", "x1y2", "中文", "a", "incomprehensibilities", "!?", "of"]
    first = own.units(units)
    own.memo, own.old = {}, {}
    again = own.units(units)
    assert first == again and any(g[1][0] == g[1][1] == g[1][2] for g in first) and any(g[1][0] != g[1][2] for g in first)
