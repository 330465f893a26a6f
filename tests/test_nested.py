"""The walk of nested JSON, and audits of documents, against plain Python."""

from __future__ import annotations

import collections
import copy
import json
import math
import random

from pyspark.sql import functions as F

from larkspur.operators import failures, nested

NAMES = ["prompt", "answer", "a", "b.c", "né", 'q"x', "x\\y", "", "0", "[1]", "parsed"]


def value(r, deep):
    kind = r.random()
    if deep == 0 or kind < 0.3:
        return r.choice([1, 2.5, None, True, "prompt", 'say "answer": x', "}{][", "", "\\", "a\nb"])
    if kind < 0.65:
        return {r.choice(NAMES): value(r, deep - 1) for _ in range(r.randrange(4))}
    return [value(r, deep - 1) for _ in range(r.randrange(4))]


def escaped(r, text):
    """The same JSON with some letters as escapes."""
    return "".join(f"\\u{ord(c):04x}" if c in "promtnsw" and r.random() < 0.2 and text[i - 1] != "\\" and inside(text, i) else c for i, c in enumerate(text))


def inside(text, at):
    """Within a string and in none of its own escapes."""
    within, k = False, 0
    while k < at:
        if within and text[k] == "\\":
            k += 2
            if k > at:
                return False
            continue
        within ^= text[k] == '"'
        k += 1
    return within


def leaves(v, path=()):
    if isinstance(v, (dict, list)) and v:
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from leaves(x, (*path, k))
    else:
        yield path


def names(v):
    if isinstance(v, dict):
        for k, x in v.items():
            yield k
            yield from names(x)
    elif isinstance(v, list):
        for x in v:
            yield from names(x)


def test_walk_equals_python(spark):
    r = random.Random(12)
    docs = [value(r, r.randrange(7)) for _ in range(250)]
    texts = [escaped(r, json.dumps(v, ensure_ascii=r.random() < 0.5)) for v in docs]
    assert all(json.loads(t) == v for t, v in zip(texts, docs)) and any("\\u0070" in t for t in texts)
    bad = ["", "{", '{"a": }', '{"prompt": 1, "prompt": 2}', "nul", None, "[" * 60 + "]" * 60, '{"a": 1} x']
    rows = spark.createDataFrame(list(enumerate([*texts, *bad])), "id int, json string").repartition(4)
    got = collections.Counter()
    for x in nested.walk(rows, "id", "json").collect():
        got[x.key, tuple(p.place if p.name is None else p.name for p in x.path)] += 1
    assert got == collections.Counter((i, p) for i, v in enumerate(docs) for p in leaves(v))
    assert sorted(x.key for x in nested.unreadable(rows, "id", "json").collect()) == list(range(250, 258))
    found = sorted(((x.id, x.name) for x in nested.forbidden_names(rows, "id", "json", failures.FORBIDDEN).collect()), key=str)
    want = [(i, n) for i, v in enumerate(docs) for n in set(names(v)) & set(failures.FORBIDDEN)] + [(k, None) for k in range(250, 258)]
    assert found == sorted(want, key=str) and len(want) > 80
    assert nested.walk(rows.limit(0), "id", "json").count() == 0 == nested.forbidden_names(rows.limit(0), "id", "json", ("a",)).count()


def catalog():
    counts = {"invalid_json": 3, "answer_wrong": 0, "answer_changes_across_positions": 2, "treatment_quote_recovery": 1}
    scopes = {"invalid_json": "row", "answer_wrong": "row", "answer_changes_across_positions": "group", "treatment_quote_recovery": "cross_run"}
    totals = {"row": 7, "group": 3, "cross_run": 0}
    return {
        "category_counts": counts,
        "category_scopes": scopes,
        "scope_denominators": totals,
        "category_rates": {k: n / totals[scopes[k]] if totals[scopes[k]] else 0.0 for k, n in counts.items()},
        "max_examples_per_category": 2,
        "examples": [{"category": c, "scope": scopes[c], "run": "base", "group_id_sha256": "x"} for c in ("invalid_json", "invalid_json", "answer_changes_across_positions")],
    }


def rules_of(c):
    """The rules in plain Python."""
    out = set()
    counts, scopes, rates, totals, limit = (c.get(k) for k in ("category_counts", "category_scopes", "category_rates", "scope_denominators", "max_examples_per_category"))
    every = {*counts, *scopes, *rates}
    if set(names(c)) & set(failures.FORBIDDEN):
        out.add("forbidden_name")
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if any(not whole(counts.get(k)) or counts[k] < 0 for k in every):
        out.add("count_names")
    if any(k not in scopes for k in every):
        out.add("scope_names")
    if any(k not in rates for k in every):
        out.add("rate_names")
    if any(s not in nested.SCOPES for s in scopes.values()):
        out.add("unknown_scope")
    if set(totals) != set(nested.SCOPES) or not all(whole(v) and v >= 0 for v in totals.values()):
        out.add("denominators")
    for k in every:
        n = totals.get(scopes.get(k))
        if whole(n) and whole(counts.get(k)) and k in rates and not math.isclose(rates[k], counts[k] / n if n else 0.0, rel_tol=0, abs_tol=1e-15):
            out.add("wrong_rate")
    if not whole(limit) or limit <= 0:
        out.add("limit")
    if any(e.get("category") not in scopes or e.get("scope") != scopes[e["category"]] for e in c["examples"]):
        out.add("example_scope")
    if whole(limit) and any(n > limit for n in collections.Counter(e.get("category") for e in c["examples"]).values()):
        out.add("too_many")
    return out


def test_catalog_documents(spark):
    base = catalog()
    made = [base]
    for path, v in (
        (("category_counts", "invalid_json"), 4), (("category_counts", "invalid_json"), -1), (("category_counts", "answer_wrong"), 0.5), (("category_counts", "new"), 1), (("category_scopes", "answer_wrong"), "rows"),
        (("category_scopes", "new"), "row"), (("category_rates", "invalid_json"), 3 / 7 + 1e-14), (("category_rates", "new"), 0.0), (("scope_denominators", "row"), 8), (("scope_denominators", "more"), 1),
        (("scope_denominators", "group"), -3), (("scope_denominators", "cross_run"), 1), (("max_examples_per_category",), 1), (("max_examples_per_category",), 0), (("max_examples_per_category",), 1.5),
        (("examples", 0, "scope"), "group"), (("examples", 2, "category"), "other"), (("examples", 2, "category"), "invalid_json"), (("examples", 0, "sample_id"), "s"), (("more",), [{"deep": {"prompt": {}}}]),
    ):
        c = copy.deepcopy(base)
        at = c
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = v
        made.append(c)
    for k in ("max_examples_per_category",):
        c = copy.deepcopy(base)
        del c[k]
        made.append(c)
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(made)] + [(100, "{"), (101, None)], "id int, json string").repartition(3)
    got = collections.defaultdict(set)
    for x in nested.catalog_document_problems(rows, "id", "json", failures.FORBIDDEN).collect():
        got[int(x.key)].add(x.rule)
    want = {i: rules_of(c) for i, c in enumerate(made) if rules_of(c)} | {100: {"unreadable"}, 101: {"unreadable"}}
    assert dict(got) == want and 0 not in want and len(want) == len(made) + 1


def test_tampered_hashes(spark):
    rows = spark.createDataFrame([("base", f"g{k // 3}", f"s{k}", k / 9, "x", k % 2 == 0, k % 3 == 0, None, "stop") for k in range(9)], "run_name string, group_id string, sample_id string, target_position double, answer string, valid_json boolean, answer_correct boolean, evidence_quotes_correct boolean, finish_reason string")
    rows = rows.withColumns({c: F.lit(None).cast("boolean") for c in ("evidence_quotes_applicable", "all_predicted_quotes_supported", "all_predicted_quotes_supported_applicable")})
    stored = failures.examples(failures.catalog(rows), 3).drop("rank")
    assert stored.where("scope = 'group'").count() > 0 and failures.tampered(stored, rows).count() == 0
    odd = stored.withColumn("group_sha256", F.when(F.col("category") == "answer_wrong", F.reverse("group_sha256")).otherwise(F.col("group_sha256")))
    assert {r.category for r in failures.tampered(odd, rows).collect()} == {"answer_wrong"}
