"""Validation as data: every operator gives violations (rule, key, detail), and an empty frame means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import render_document
from ..lineage import cut


def broken(**rules: Column) -> Column:
    """Names of the rules that do not hold, as an array; null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items())))


def violations(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """One row for each rule that a row breaks; a rule is a condition that must hold, and null counts as broken."""
    return rows.select(F.explode(broken(**rules)).alias("rule"), F.col(key).cast("string").alias("key"))


def raw_samples(samples: DataFrame, length_error: float = 0.02, position_error: float = 0.03) -> DataFrame:
    """Length and position errors, evidence and quotes in the prompt, ids that come once, and the invariants of a group.

    Rows with an evaluation_mode, where there is such a column, are diagnostics: of their length it is only asked that there are tokens.
    """
    ids = F.forall("evidence", lambda e: F.contains(F.col("prompt"), render_document(e["id"], e["text"])))
    length = F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= length_error * F.col("target_tokens")
    room = F.col("base_tokens") < F.col("target_tokens")
    if "evaluation_mode" in samples.columns:
        diagnostic = F.col("evaluation_mode").isNotNull()
        length, room = F.when(diagnostic, F.col("actual_tokens") > 0).otherwise(length), diagnostic | room
    rules = {"length_error": length, "position_error": F.abs(F.col("actual_position") - F.col("target_position")) <= position_error, "evidence_in_prompt": ids, "room_for_fillers": room}
    if "quotes" in samples.columns:
        rules["quotes_in_prompt"] = F.forall(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: F.contains(F.col("prompt"), q))
    invariant = ("answer", "filler_fingerprint", "task", "filler_type", "target_tokens")
    # Samples are dear and read three times: what is asked of them is cut, without their texts.
    samples = cut(samples.select("sample_id", "group_id", "position_label", *invariant, broken(**rules).alias("bad")))
    one = samples.select(F.explode("bad").alias("rule"), F.col("sample_id").cast("string").alias("key"))
    again = violations(samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "sample_id", unique_id=F.col("n") == 1)
    same = {c: F.min(c) == F.max(c) for c in invariant}  # one value that is not null; none gives null, which is broken
    g = samples.groupBy("group_id").agg(*(v.alias(k) for k, v in same.items()), (F.count_distinct("position_label") == F.count(F.lit(1))).alias("labels"))
    return one.unionByName(again).unionByName(violations(g, "group_id", **{f"one_{c}": F.col(c) for c in same}, unique_labels=F.col("labels")))


def sample_counts(samples: DataFrame, condition: list[str]) -> DataFrame:
    """(field, value, rows): rows by condition and by position, the number of rows and that of groups."""
    what = F.array(F.struct(F.lit("condition").alias("field"), F.concat_ws("|", *(F.col(c).cast("string") for c in condition)).alias("value")), F.struct(F.lit("position").alias("field"), F.col("position_label").alias("value")), F.struct(F.lit("rows").alias("field"), F.lit("*").alias("value")))
    rows = samples.select(F.explode(what).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("rows"))
    groups = samples.select("group_id").distinct().agg(F.count(F.lit(1)).alias("rows")).select(F.lit("groups").alias("field"), F.lit("*").alias("value"), "rows")
    return rows.unionByName(groups)


def replica_histogram(samples: DataFrame, fact: str, replica: str) -> DataFrame:
    """Facts by how many replicas they have."""
    n = samples.select(fact, replica).distinct().groupBy(fact).agg(F.count(F.lit(1)).alias("replicas"))
    return n.groupBy("replicas").agg(F.count(F.lit(1)).alias("facts"))


def matched_bank(samples: DataFrame, fact: str, replica: str) -> DataFrame:
    """A fact's content is one over its replicas, their position grids are equal, their fillers differ."""
    r = samples.groupBy(fact, replica).agg(F.array_join(F.sort_array(F.collect_set("position_label")), ",").alias("grid"), F.min("answer").alias("answer"), F.min("filler_fingerprint").alias("filler"))
    g = r.groupBy(fact).agg(F.count_distinct("grid").alias("grids"), F.count_distinct("answer").alias("answers"), F.count_distinct("filler").alias("fillers"), F.count(F.lit(1)).alias("replicas"))
    return violations(g, fact, one_grid=F.col("grids") == 1, one_answer=F.col("answers") == 1, distinct_fillers=F.col("fillers") == F.col("replicas"))


#: The fields of an assistant's payload, and whether ids and quotes are given under each supervision.
PAYLOAD = ("answer", "confidence", "evidence_ids", "evidence_quotes")
SUPERVISED = {"answer": (False, False), "evidence_id": (True, False), "evidence": (True, True)}


def chat_rows(rows: DataFrame, key: str, supervision: Column | None = None) -> DataFrame:
    """Roles are system, user, assistant; ids are unique; the assistant's text is a JSON object of the four fields and no others.

    With a supervision mode, evidence ids and quotes are there exactly where the mode says so; an unknown mode is a violation.
    """
    roles = F.transform("messages", lambda m: m["role"]) == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    content = F.element_at("messages", -1)["content"]
    v = F.try_parse_json(content)
    exact = v.isNotNull() & (F.array_sort(F.json_object_keys(content)) == F.array(*map(F.lit, PAYLOAD)))
    rules = {"roles": roles, "payload": exact}
    if supervision is not None:
        some = lambda f: F.coalesce(F.json_array_length(F.get_json_object(content, f"$.{f}")), F.lit(0)) > 0
        fits = F.lit(False)
        for mode, (ids, quotes) in SUPERVISED.items():
            fits = fits | ((supervision == mode) & (some("evidence_ids") == ids) & (some("evidence_quotes") == quotes))
        rules["supervision"] = ~F.coalesce(exact, F.lit(False)) | fits
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return violations(rows, key, **rules).unionByName(violations(again, key, unique_id=F.col("n") == 1))


def matched_design(rows: DataFrame, key: str) -> DataFrame:
    """Variants of one pairing differ in supervision only: one prompt for each (pairing, cell); both pairings expose facts alike."""
    inputs = rows.groupBy("pairing", key).agg(F.count_distinct("prompt_hash").alias("p"))
    a = violations(inputs, key, same_input_across_supervision=F.col("p") == 1)
    e = rows.groupBy("fact", "pairing", "supervision").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position_label").alias("positions"))
    f = e.groupBy("fact").agg(F.count_distinct("n").alias("n"), F.max(F.when(F.col("pairing") == "independent", F.col("positions"))).alias("ind"))
    return a.unionByName(violations(f, "fact", equal_exposures=F.col("n") == 1, independent_has_one_position=F.col("ind") == 1))


def matched_cells(rows: DataFrame, fact: str, variants: int, tokens: str, filler: str, most_gap: float) -> DataFrame:
    """The variant matrix of a matched design: every (fact, replica) in every variant, fillers equal across variants, token sums within a gap."""
    g = rows.groupBy(fact, "replica").agg(F.count_distinct("variant").alias("v"), F.count_distinct(filler).alias("f")).withColumn("cell", F.concat_ws("/", fact, "replica"))
    t = rows.groupBy("variant").agg(F.sum(tokens).alias("t")).agg(((F.max("t") - F.min("t")) / F.greatest(F.avg("t"), F.lit(1.0))).alias("gap")).withColumn("all", F.lit("*"))
    return violations(g, "cell", every_variant=F.col("v") == variants, same_fillers=F.col("f") == 1).unionByName(violations(t, "all", token_gap=F.col("gap") <= most_gap))


def _cell(*columns: str) -> Column:
    return F.concat_ws("/", *(F.col(c).cast("string") for c in columns))


def matched_variants(rows: DataFrame, pairings: tuple[str, str], modes: tuple[str, ...], fact: str, replica: str, most_gap: float) -> DataFrame:
    """Violations (rule, key) of a matched design over its variants: rows with pairing, supervision, position_label, filler_fingerprint,
    fact_fingerprint and actual_tokens.

    Every pairing has every mode (complete_matrix).  Within a pairing a (fact, replica) is there once in every mode (unique_cell,
    every_mode), with one position, filler, fact and length (same_input).  Between the pairings, in the first mode, it is there in both
    (both_pairings) with one fact, filler and length.  Facts are exposed alike within a pairing (equal_exposures); under the first pairing a fact
    stays at one position, under the second each exposure has its own.  The pairings' tokens differ by no more than a share.
    """
    key = _cell("pairing", fact, replica).alias("key")
    inputs = F.struct("position_label", "filler_fingerprint", "fact_fingerprint", "actual_tokens")
    c = rows.groupBy("pairing", fact, replica).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("supervision").alias("m"), F.count_distinct(inputs).alias("d")).select("*", key)
    out = violations(c, "key", unique_cell=F.col("n") == F.col("m"), every_mode=F.col("m") == len(modes), same_input=F.col("d") == 1)
    first = rows.where(F.col("supervision") == modes[0])
    across = ("fact_fingerprint", "filler_fingerprint", "actual_tokens")
    b = first.groupBy(fact, replica).agg(F.count_distinct("pairing").alias("p"), *(F.count_distinct(f).alias(f) for f in across)).select("*", _cell(fact, replica).alias("key"))
    out = out.unionByName(violations(b, "key", both_pairings=F.col("p") == 2, **{f"same_{f}": F.col(f) == 1 for f in across}))
    e = first.groupBy("pairing", fact).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position_label").alias("positions"))
    is_first = F.col("pairing") == pairings[0]
    each = e.select("*", _cell("pairing", fact).alias("key"))
    out = out.unionByName(violations(each, "key", independent_at_one_position=~is_first | (F.col("positions") == 1), paired_at_every_position=is_first | (F.col("positions") == F.col("n"))))
    alike = e.groupBy("pairing").agg(F.count_distinct("n").alias("n"))
    out = out.unionByName(violations(alike, "pairing", equal_exposures=F.col("n") == 1))
    tokens = first.groupBy("pairing").agg(F.sum("actual_tokens").alias("t")).agg(((F.max("t") - F.min("t")) / F.greatest(F.avg("t"), F.lit(1.0))).alias("gap")).withColumn("key", F.lit("*"))
    known = F.col("pairing").isin(*pairings) & F.col("supervision").isin(*modes)
    matrix = rows.agg(F.count_distinct(F.when(known, F.struct("pairing", "supervision"))).alias("n"), F.bool_and(known).alias("known")).withColumn("key", F.lit("*"))
    out = out.unionByName(violations(tokens, "key", token_gap=F.col("gap") <= most_gap))
    return out.unionByName(violations(matrix, "key", complete_matrix=(F.col("n") == len(pairings) * len(modes)) & F.col("known")))


def realized_pairing(left: DataFrame, right: DataFrame, by: str, index: str, fact: str, replica: str, positions: int, most_gap: float) -> DataFrame:
    """By group, how strictly two realized subsets match: left independent, right paired, both with fact_fingerprint, filler_fingerprint,
    task, filler_type, target_tokens, position_label and prompt_tokens.

    Rows are compared place by place (`index`): same (fact, replica), fact and filler.  Rows by task, filler type, length and replica, and by position,
    are as many on both sides.  Every fact of the right side has all positions.  strict is all of this and a token gap within a share.
    """
    side = lambda x, n: x.select(F.col(by).alias("by"), F.col(index).alias("at"), F.struct(fact, replica).alias(f"id{n}"), F.col("fact_fingerprint").alias(f"fact{n}"), F.col("filler_fingerprint").alias(f"filler{n}"), F.col("prompt_tokens").alias(f"t{n}"))
    pairs = side(left, 1).join(side(right, 2), ["by", "at"], "full_outer")
    same = lambda c: F.bool_and(F.coalesce(F.col(f"{c}1") == F.col(f"{c}2"), F.lit(False)))
    t1, t2 = F.coalesce(F.sum("t1"), F.lit(0)), F.coalesce(F.sum("t2"), F.lit(0))
    g = pairs.groupBy("by").agg(same("id").alias("same_ordered_identities"), same("fact").alias("same_facts"), same("filler").alias("same_fillers"), t1.alias("independent_tokens"), t2.alias("paired_tokens"))
    g = g.withColumn("token_gap", F.round(F.abs(F.col("independent_tokens") - F.col("paired_tokens")) / F.greatest((F.col("independent_tokens") + F.col("paired_tokens")) / 2, F.lit(1.0)), 9))
    fields = {"task": "task", "filler_type": "filler_type", "target_tokens": "target_tokens", "replica": replica, "position": "position_label"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("value")) for k, c in fields.items())))
    long = lambda x, sign: x.select(F.col(by).alias("by"), F.lit(sign).alias("sign"), each.alias("x")).select("by", "sign", "x.*")
    excess = long(left, 1).unionByName(long(right, -1)).groupBy("by", "field", "value").agg(F.sum("sign").alias("excess"))
    place = F.col("field") == "position"
    h = excess.groupBy("by").agg(F.bool_and(place | (F.col("excess") == 0)).alias("same_counts"), F.bool_and(~place | (F.col("excess") == 0)).alias("same_positions"))
    blocks = right.groupBy(F.col(by).alias("by"), fact).agg(F.count_distinct("position_label").alias("p")).groupBy("by").agg(F.bool_and(F.col("p") == positions).alias("complete_blocks"))
    x = g.join(h, "by").join(blocks, "by", "left").withColumn("complete_blocks", F.coalesce("complete_blocks", F.lit(False)))
    conditions = ("same_ordered_identities", "same_facts", "same_fillers", "same_counts", "same_positions", "complete_blocks")
    strict = F.col("token_gap") <= most_gap
    for c in conditions:
        strict = strict & F.col(c)
    return x.select(F.col("by").alias(by), *conditions, "independent_tokens", "paired_tokens", "token_gap", strict.alias("strict"))


def ordered_identities(rows: DataFrame, variant: str, reference: str, index: str, wanted: DataFrame, fact: str, replica: str) -> DataFrame:
    """Violations (rule, key) of variants whose rows are picked by one list of places: another number of rows than the reference (same_rows),
    and places at which a variant lacks a row or holds another (fact, replica) than the reference (same_identity)."""
    n = rows.groupBy(variant).agg(F.count(F.lit(1)).alias("n"))
    whole = n.where(F.col(variant) == reference).select(F.col("n").alias("whole"))  # one row
    out = violations(n.crossJoin(F.broadcast(whole)), variant, same_rows=F.col("n") == F.col("whole"))
    identity = F.struct(fact, replica).alias("id")
    ours = rows.where(F.col(variant) == reference).select(F.col(index).alias("at"), identity).join(wanted.select(F.col(index).alias("at")).distinct().hint("merge"), "at")
    others = rows.select(variant).distinct().where(F.col(variant) != reference)  # a few variants
    asked = ours.crossJoin(F.broadcast(others))
    theirs = rows.select(variant, F.col(index).alias("at"), identity.alias("other"))
    # Both sides are as large as a variant, whatever size the planner takes them for: no broadcast.
    x = asked.join(theirs.hint("merge"), [variant, "at"], "left").withColumn("key", _cell(variant, "at"))
    return out.unionByName(violations(x, "key", same_identity=F.col("id") == F.col("other")))


def siblings(rows: DataFrame, key: list[str], fields: list[str], modes: int) -> DataFrame:
    """A realized subset: rows that differ in supervision only have one value of each field, and every mode once.

    One value is a least that is the greatest: with one distinct count only, rows are not multiplied, and those dealt out by a part of the key stay.
    """
    one = lambda f: F.coalesce(F.min(f) == F.max(f), F.lit(False)).alias(f"d_{f}")
    g = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("supervision").alias("m"), *map(one, fields)).withColumn("k", F.concat_ws("/", *(F.col(c).cast("string") for c in key)))
    return violations(g, "k", every_mode_once=(F.col("n") == modes) & (F.col("m") == modes), **{f"same_{f}": F.col(f"d_{f}") for f in fields})


def pairing_comparison(rows: DataFrame, fact: str, position: str, tokens: str, most_gap: float = 0.02) -> DataFrame:
    """By supervision: whether both pairings have the same facts, exposures and positions, their token gap, and all of it together.

    Rows are counted by (supervision, fact, position) once; both pairings stand side by side in it.
    """
    of = lambda p, c: F.sum(F.when(F.col("pairing") == p, c).otherwise(0))
    one = F.lit(1)
    cell = rows.groupBy("supervision", fact, position).agg(of("paired", one).alias("p"), of("independent", one).alias("i"), of("paired", F.col(tokens)).alias("pt"), of("independent", F.col(tokens)).alias("it"))
    by_fact = cell.groupBy("supervision", fact).agg(*(F.sum(c).alias(c) for c in ("p", "i", "pt", "it")))
    by_position = cell.groupBy("supervision", position).agg(F.sum("p").alias("p"), F.sum("i").alias("i")).groupBy("supervision").agg(F.bool_and(F.col("p") == F.col("i")).alias("same_positions"))
    gap = F.abs(F.sum("pt") - F.sum("it")) / F.greatest((F.sum("pt") + F.sum("it")) / 2, F.lit(1.0))
    g = by_fact.groupBy("supervision").agg(F.bool_and((F.col("p") > 0) == (F.col("i") > 0)).alias("same_facts"), F.bool_and(F.col("p") == F.col("i")).alias("same_exposures"), F.round(gap, 9).alias("token_gap"))
    x = g.join(by_position, "supervision")
    return x.withColumn("strict", F.col("same_facts") & F.col("same_exposures") & F.col("same_positions") & (F.col("token_gap") <= most_gap))


def selected_summary(rows: DataFrame, by: list[str], ids: str, mask: str) -> DataFrame:
    """Token lengths of selected rows: rows, tokens, completion tokens, least and most, and masks that are no suffix of ones."""
    from ..functions.text import is_suffix_mask

    n = F.size(ids).cast("bigint")
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("bigint")
    fine = (F.size(mask) == F.size(ids)) & is_suffix_mask(F.col(mask))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(n).alias("tokens"), F.sum(ones).alias("completion_tokens"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad_masks"))


def balanced_prefix(rows: DataFrame, cell: list[str], cap: str, sample: str) -> DataFrame:
    """Cap diagnostics: one row for each (cap, cell), and the same sample in a cell under every cap.

    The caps that a cell has are bits of 64-bit words, so that samples alone are counted as distinct values: rows are not multiplied for that.
    """
    found = [r[0] for r in rows.select(cap).distinct().collect()]  # a few settings; null is one, which no cell counts
    known = sorted(c for c in found if c is not None)
    words = range(-(-max(1, len(known)) // 63))
    bit = lambda w: F.coalesce(*(F.when(F.col(cap) == c, F.lit(1 << (k % 63))) for k, c in enumerate(known) if k // 63 == w), F.lit(0)).cast("bigint")
    g = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(F.bit_or(bit(w)).alias(f"has{w}") for w in words), F.count_distinct(sample).alias("s"))
    caps = sum((F.bit_count(f"has{w}") for w in words), F.lit(0))
    x = g.withColumn("c", caps).withColumn("k", F.concat_ws("/", *(F.col(c).cast("string") for c in cell)))
    return violations(x, "k", one_row_a_cap=(F.col("n") == len(found)) & (F.col("c") == len(found)), one_sample=F.col("s") == 1)


def chat_protocol(rows: DataFrame) -> DataFrame:
    """By tokenizer, from renderings (tokenizer, protocol, prompt_ids, full_ids, text, sentinels): the first protocol that passes.

    A protocol passes if the prompt's ids are a prefix of the whole's and every sentinel is in the text once at least.
    `native` is preferred to `merge_system`; with neither the tokenizer fails.
    """
    n = F.size("prompt_ids")
    prefix = (n <= F.size("full_ids")) & (F.slice("full_ids", F.lit(1), n) == F.col("prompt_ids"))
    kept = F.forall("sentinels", lambda x: F.contains(F.col("text"), x))
    x = rows.select("tokenizer", "protocol", F.coalesce(prefix & kept, F.lit(False)).alias("ok"), (F.size("full_ids") - n).alias("completion_tokens"))
    ok = lambda p: F.coalesce(F.bool_or((F.col("protocol") == p) & F.col("ok")), F.lit(False))
    g = x.groupBy("tokenizer").agg(ok("native").alias("native"), ok("merge_system").alias("merged"), F.max(F.when((F.col("protocol") == "native") & F.col("ok"), F.col("completion_tokens"))).alias("n1"), F.max(F.when((F.col("protocol") == "merge_system") & F.col("ok"), F.col("completion_tokens"))).alias("n2"))
    chosen = F.when(F.col("native"), "native").when(F.col("merged"), "merge_system")
    return g.select("tokenizer", F.when(chosen.isNull(), "failed").otherwise("passed").alias("status"), chosen.alias("selected_protocol"), F.when(F.col("native"), "passed").otherwise("failed").alias("native_status"), F.when(F.col("native"), F.col("n1")).otherwise(F.col("n2")).alias("completion_tokens"))


def blocks(rows: DataFrame, stratum: list[str], fact: str, replica: str, replicas: int, k: int) -> DataFrame:
    """Facts without every replica once, and strata with fewer than k facts."""
    f = rows.groupBy(*stratum, fact).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(replica).alias("d"))
    a = violations(f, fact, complete_block=(F.col("n") == replicas) & (F.col("d") == replicas))
    s = f.groupBy(*stratum).agg(F.count(F.lit(1)).alias("facts")).withColumn("stratum", F.concat_ws("/", *(F.col(c).cast("string") for c in stratum)))
    return a.unionByName(violations(s, "stratum", enough_facts=F.col("facts") >= k))


def full_matrix(rows: DataFrame, cell: list[str], cells: int, groups: int) -> DataFrame:
    """Every run has all cells with so many groups each."""
    c = rows.groupBy("run_name", *cell).agg(F.count_distinct("group_id").alias("g"))
    r = c.groupBy("run_name").agg(F.count(F.lit(1)).alias("cells"), F.min("g").alias("low"), F.max("g").alias("high"))
    return violations(r, "run_name", all_cells=F.col("cells") == cells, groups_per_cell=(F.col("low") == groups) & (F.col("high") == groups))


def coverage(rows: DataFrame, tasks: int, positions: int) -> DataFrame:
    r = rows.groupBy("run_name").agg(F.count_distinct("task").alias("t"), F.count_distinct("position_label").alias("p"))
    return violations(r, "run_name", tasks=F.col("t") >= tasks, positions=F.col("p") >= positions)


def queue_health(statuses: DataFrame) -> DataFrame:
    """failed, validated, running, stalled or unknown, from status texts; which of them count follows from the top one's stage."""
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("top", "qwen", "qwen_training", "mistral", "mistral_training")}
    failed = {c: F.startswith(v, F.lit("failed")) for c, v in low.items()}
    first, second = F.contains(low["top"], F.lit("stage=qwen")), F.contains(low["top"], F.lit("stage=mistral"))
    part = F.when(first, failed["qwen"] | failed["qwen_training"]).when(second, failed["qwen"] | failed["mistral"] | failed["mistral_training"]).otherwise(F.lit(False))
    state = F.when(failed["top"], "failed").when(F.startswith(low["top"], F.lit("validated")), "validated").when(part, "failed").when(F.col("process_present"), "running").when(~F.col("process_present"), "stalled").otherwise("unknown")
    return statuses.withColumn("health", state)


def identity_changes(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Runs whose stored identity differs from the one they resume with."""
    return a.select(key, F.struct(*fields).alias("old")).join(b.select(key, F.struct(*fields).alias("new")), key).where(~F.col("old").eqNullSafe(F.col("new"))).select(key)


def prompt_budget(rows: DataFrame, key: str, tokens: str, new_tokens: int, window: int) -> DataFrame:
    return violations(rows, key, fits_window=F.col(tokens) + new_tokens <= window)


def release_selection(files: DataFrame, prefixes: list[str], suffixes: list[str], most_bytes: int) -> DataFrame:
    """Why each file is in or out of a public release: allow-lists first, then size."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | F.startswith(F.col("path"), F.lit(p))
    kind = F.lit(False)
    for s in suffixes:
        kind = kind | F.endswith(F.col("path"), F.lit(s))
    return files.withColumn("decision", F.when(~inside, "outside").when(~kind, "kind").when(F.col("bytes") > most_bytes, "too_large").otherwise("included"))
