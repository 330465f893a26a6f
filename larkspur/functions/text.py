"""Text functions of scoring and prompts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation that normalization deletes, and the articles that it drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?U)\b(a|an|the)\b"
#: Fixed patterns of answer options, tried in this order.
OPTION_JSON = r"""(?i)["']answer["']\s*:\s*["']?([ABCD])["']?"""
OPTION_BARE = r"(?i)^[\s\(\[]*([ABCD])[\s\)\].,:;!-]*\z"
OPTION_PHRASE = r"(?i)\b(?:the\s+)?(?:answer|option|choice)\s*(?:is|=|:)?\s*[\(\[]?([ABCD])[\)\]]?\b"
#: A token is a run of letters, digits and underscores, or one other character that is no white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def normalize_answer(c: Column) -> Column:
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def token_f1(predicted: Column, expected: Column) -> Column:
    """F1 of the multisets of normalized words; 1 if both are empty, 0 if one is."""
    p, e = words(normalize_answer(predicted)), words(normalize_answer(expected))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(e, t)))
    precision, recall = shared / F.size(p), shared / F.size(e)
    none = (F.size(p) == 0) | (F.size(e) == 0)
    return F.when(none, (F.size(p) == F.size(e)).cast("double")).when(shared == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def answer_score(metric: Column, prediction: Column, references: Column) -> Column:
    """The best score over the references by the named metric; an unknown metric is an error."""
    best = lambda f: F.array_max(F.transform(references, f))
    p = F.coalesce(prediction, F.lit(""))
    return (
        F.when(metric == "exact", best(lambda r: (p == r).cast("double")))
        .when(metric == "normalized_exact", best(lambda r: (normalize_answer(p) == normalize_answer(r)).cast("double")))
        .when(metric == "qa_f1_en", best(lambda r: token_f1(p, r)))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported answer metric: "), F.coalesce(metric, F.lit("null")))))
    )


def is_json_object(c: Column) -> Column:
    """Whether a text is one JSON object and nothing else: it must parse both as an array's only element and as a field."""
    one = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    fits = one.isNotNull() & field.isNotNull() & (F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1)
    return F.coalesce(fits & F.schema_of_variant(one).like("ARRAY<OBJECT%"), F.lit(False))


def quotes_supported(quotes: Column, prompt: Column) -> Column:
    return (F.size(quotes) > 0) & F.forall(quotes, lambda q: F.contains(prompt, q))


def is_superset(predicted: Column, expected: Column) -> Column:
    return F.size(F.array_except(expected, predicted)) == 0


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def cuts_token(text: Column, at: Column) -> Column:
    """Whether a place (characters before it) lies within a run of letters, digits and underscores, which a break there makes two tokens of."""
    return F.substring(text, at, F.lit(2)).rlike(r"^[\p{L}\p{N}_]{2}\z") & (at > 0)


def chat_tokens(system: Column, user: Column) -> Column:
    return token_count(F.concat(system, F.lit("\n\n"), user))


#: Ways to count tokens by name; register() adds one, such as a model's tokenizer behind a UDF of the caller's.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words_and_marks": token_count,
    "blanks": lambda c: F.regexp_count(c, F.lit(r"[^ \t\r\n]+")),
    "quarter_characters": lambda c: F.ceil(F.length(c) / 4).cast("int"),
}


def register_counter(name: str, count: Callable[[Column], Column]) -> None:
    COUNTERS[name] = count


def count_tokens(name: str, c: Column) -> Column:
    if name not in COUNTERS:
        raise ValueError(f"unknown token counter: {name}")
    return COUNTERS[name](c)


def option_letter(parsed_answer: Column, generated: Column) -> tuple[Column, Column]:
    """An option A-D and where it was found: parsed JSON, JSON in the raw text, a bare letter, one explicit phrase."""
    text = F.coalesce(generated, F.lit(""))
    given = F.upper(F.trim(parsed_answer))
    in_json = F.upper(F.regexp_extract(text, OPTION_JSON, 1))
    bare = F.upper(F.regexp_extract(text, OPTION_BARE, 1))
    said = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(OPTION_PHRASE), F.lit(1)), F.upper))
    by_json = given.isin("A", "B", "C", "D")
    letter = F.when(by_json, given).when(in_json != "", in_json).when(bare != "", bare).when(F.size(said) == 1, F.get(said, F.lit(0)))
    source = F.when(by_json, "parsed_json").when(in_json != "", "truncated_or_embedded_json").when(bare != "", "bare_option").when(F.size(said) == 1, "explicit_answer_phrase").otherwise("unextractable")
    return letter, source


def target_option(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("A", "B", "C", "D"), t).otherwise(F.raise_error(F.concat(F.lit("target answer is not one option letter: "), F.coalesce(c, F.lit("null")))))


def position_label(position: Column) -> Column:
    """p000 to p100, rounding halves to even."""
    return F.concat(F.lit("p"), F.lpad(F.bround(position * 100).cast("int").cast("string"), 3, "0"))


def render_document(i: Column, text: Column) -> Column:
    return F.concat(F.lit("[Document "), i, F.lit("]\n"), text)


#: What a prompt begins with.
CONTEXT = "<context>\n"


# The template of a prompt, which split_prompt reads again.
def render_prompt(documents: Column, query: Column) -> Column:
    body = F.array_join(F.transform(documents, lambda x: render_document(x["id"], x["text"])), "\n\n")
    return F.concat(F.lit(CONTEXT), body, F.lit("\n</context>\n\nQuestion: "), query, F.lit("\nResponse:"))


def insert_cluster(filler: Column, evidence: Column, index: Column) -> Column:
    n = F.size(filler)
    head = F.when(index > 0, F.slice(filler, F.lit(1), F.greatest(index, F.lit(1)))).otherwise(F.slice(filler, F.lit(1), F.lit(0)))
    tail = F.when(index < n, F.slice(filler, F.least(index, n - 1) + 1, F.greatest(n - index, F.lit(0)))).otherwise(F.slice(filler, F.lit(1), F.lit(0)))
    return F.concat(head, evidence, tail)


def insertion_index(text: Column, position: Column) -> Column:
    """Characters before the newline nearest to a position (a tie goes to the earlier); ends for 0 and 1."""
    n = F.length(text)
    target = F.bround(n * position).cast("int")
    # The last newline at or before the target and the first from it on, as offsets from 0; -1 if there is none.
    before = F.substring(text, F.lit(1), target + 1)
    previous = F.when(F.locate("\n", before) > 0, F.length(before) - F.locate("\n", F.reverse(before))).otherwise(F.lit(-1))
    after = F.substring(text, target + 1, n)
    following = F.when(F.locate("\n", after) > 0, target + F.locate("\n", after) - 1).otherwise(F.lit(-1))
    both = F.when(target - previous <= following - target, previous).otherwise(following)
    near = F.when((previous >= 0) & (following >= 0), both).when(previous >= 0, previous).when(following >= 0, following).otherwise(target)
    return F.when(position <= 0, 0).when(position >= 1, n).otherwise(near)


def insert_block(text: Column, block: Column, index: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), index), F.lit("\n"), block, F.lit("\n"), F.substring(text, index + 1, F.length(text)))


def remove_first(text: Column, part: Column) -> Column:
    at = F.locate(part, text) if isinstance(part, str) else F.instr(text, part)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def occurrences(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def remove_needle(text: Column, needle: Column) -> Column:
    """Without a needle that occurs once, and without the newlines of its block; null where it does not occur exactly once."""
    block = F.concat(F.lit("\n"), needle, F.lit("\n"))
    less = F.when(F.contains(text, block), remove_first(text, block)).otherwise(remove_first(text, needle))
    return F.when(occurrences(text, needle) == 1, F.regexp_replace(less, r"^\n+|\n+\z", ""))


def without_documents(context: Column, documents: Column) -> Column:
    """Take each rendered document out once, then squeeze runs of newlines to two."""
    less = F.aggregate(documents, context, lambda acc, x: remove_first(acc, render_document(x["id"], x["text"])))
    return F.regexp_replace(less, r"\n{3,}", "\n\n")


def split_prompt(prompt: Column) -> tuple[Column, Column]:
    """Context and question of a prompt of the fixed template; nulls where it does not fit."""
    marker, tail = "</context>\n\nQuestion: ", "\nResponse:"
    at = F.locate(marker, prompt)
    fits = (at > 0) & F.endswith(prompt, F.lit(tail))
    context = F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit("</context>"))
    rest = F.substring(prompt, at + len(marker), F.length(prompt))
    return F.when(fits, context), F.when(fits, F.substring(rest, F.lit(1), F.length(rest) - len(tail)))


def completion_mask(prompt: Column, full: Column) -> Column:
    """0 for the prompt's tokens and 1 for the rest; null where the prompt is no prefix."""
    n = F.size(prompt)
    prefix = F.slice(full, F.lit(1), n) == prompt
    return F.when((n <= F.size(full)) & prefix, F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(full) - n)))


def is_suffix_mask(mask: Column) -> Column:
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    return mask == F.concat(F.array_repeat(F.lit(0), F.size(mask) - ones), F.array_repeat(F.lit(1), ones))


def merge_system(messages: Column) -> Column:
    """A leading system message goes in front of the user message after it; null where there is none after it."""
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    merged = F.struct(F.lit("user").alias("role"), F.concat(first["content"], F.lit("\n\n"), second["content"]).alias("content"))
    rest = F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0)))
    return F.when((F.size(messages) == 0) | (first["role"] != "system"), messages).when(second["role"] == "user", F.concat(F.array(merged), rest))


def assistant_payload(mode: Column, answer: Column, ids: Column, quotes: Column) -> Column:
    """JSON of the four target fields by supervision mode, keys sorted, with blanks after separators."""
    from .hashing import json_text

    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, json_text), ", "), F.lit("]"))
    none = F.lit("[]")
    show_ids = F.when(mode.isin("evidence_id", "evidence"), listed(ids)).otherwise(none)
    show_quotes = F.when(mode == "evidence", listed(quotes)).otherwise(none)
    return F.concat(F.lit('{"answer": '), json_text(answer), F.lit(', "confidence": 1.0, "evidence_ids": '), show_ids, F.lit(', "evidence_quotes": '), show_quotes, F.lit("}"))


def latex_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\x00"))
    for ch in "&%$#_{}":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    out = F.replace(F.replace(out, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))
    return F.replace(out, F.lit("\x00"), F.lit("\\textbackslash{}"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def continued_book(normal: Column, long: Column) -> Column:
    """normal followed by what long has beyond its length; null where long is no longer."""
    return F.when(F.length(long) > F.length(normal), F.concat(normal, F.substring(long, F.length(normal) + 1, F.length(long))))
