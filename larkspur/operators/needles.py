"""Needles in books: rows for each book, case, length and position, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cuts_token, insert_block, insertion_index, position_label, token_count
from ..lineage import cut, dealt
from .audits import broken, violations
from .generate import fit_prefix, word_tokens


#: Books in a task, each with a text for each case, length and position.
BOOKS = 500
#: Tokens kept free, as a needle may be put within a word and make two of it.
ROOM = 4


def needle_rows(books: DataFrame, cases: DataFrame, lengths: list[int], positions: list[float]) -> DataFrame:
    """books (book, text), cases (case_id, needle, answer, question): a group for each book, case and length, a row for each position.

    The cases are a benchmark's and few: they are broadcast to the books.  All positions of a group share one fitted text; a text that does
    not come down to a length has no rows of it.  Books are dealt out before they multiply, with as many words as the longest length can take, and the tokens of words are counted once a book.
    """
    most = max(lengths)
    words = F.slice(F.split("text", " ", most + 1), F.lit(1), F.lit(most))
    x = dealt(books, BOOKS, "book").select("book", words.alias("words")).withColumn("counts", word_tokens(F.col("words"))).crossJoin(F.broadcast(cases)).withColumn("target_tokens", F.explode(F.array(*map(F.lit, lengths))))
    out = fit_prefix(x, "words", "needle", F.col("target_tokens") - ROOM, counts="counts").where("fitted is not null")
    g = out.select(F.concat_ws("-", "book", "case_id", "target_tokens").alias("group_id"), "book", "case_id", "needle", "answer", "question", "target_tokens", "fitted", "fitted_tokens", F.sha2("fitted", 256).alias("base_sha256"))
    r = g.withColumn("target_position", F.explode(F.array(*map(F.lit, positions))))
    at = insertion_index(F.col("fitted"), F.col("target_position"))
    r = r.withColumn("at", at.cast("int")).withColumn("context", insert_block(F.col("fitted"), F.col("needle"), F.col("at")))
    # The needle's newlines part tokens: those of text and needle are known, and one more comes where a token is cut.
    total = F.col("fitted_tokens") + cuts_token(F.col("fitted"), F.col("at")).cast("int")
    end = F.col("at") >= F.length("fitted")
    prefix = F.when(F.col("at") <= 0, 0).when(end, F.col("fitted_tokens") - token_count(F.col("needle"))).otherwise(token_count(F.substring(F.col("fitted"), F.lit(1), F.col("at"))))
    label = position_label(F.col("target_position"))
    return r.select(F.concat_ws("@", "group_id", label).alias("sample_id"), "group_id", "book", "case_id", "target_tokens", total.alias("actual_tokens"), label.alias("position_label"), "target_position", (prefix / F.greatest(total, F.lit(1))).alias("actual_position"), "context", "needle", "answer", "question", "base_sha256")


def audit(rows: DataFrame, labels: int, slack: int = 192) -> DataFrame:
    """Violations (rule, key): ids that repeat, overflow or slack of tokens, the needle not in the text, an answer that is not there
    exactly once, missing positions, and answers or base texts that change within a group."""
    times = (F.length("context") - F.length(F.replace("context", "answer", F.lit("")))) / F.length("answer")
    bad = broken(fits=F.col("actual_tokens") <= F.col("target_tokens"), little_slack=F.col("target_tokens") - F.col("actual_tokens") <= slack, needle_present=F.contains(F.col("context"), F.col("needle")), answer_once=(F.length("answer") > 0) & (times == 1))
    # Rows are dear and read three times: what is asked of them is cut, without their texts.
    rows = cut(rows.select("sample_id", "group_id", "position_label", "answer", "needle", "base_sha256", bad.alias("bad")))
    one = rows.select(F.explode("bad").alias("rule"), F.col("sample_id").cast("string").alias("key"))
    again = violations(rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "sample_id", unique_id=F.col("n") == 1)
    g = rows.groupBy("group_id").agg(F.count_distinct("position_label").alias("p"), F.count_distinct("answer", "needle").alias("t"), F.count_distinct("base_sha256").alias("b"))
    return one.unionByName(again).unionByName(violations(g, "group_id", every_position=F.col("p") == labels, one_target=F.col("t") == 1, one_base=F.col("b") == 1))


def summary(rows: DataFrame) -> DataFrame:
    """Rows and groups by length, the most tokens, and the largest error of a position."""
    g = rows.groupBy("target_tokens", "group_id").agg(F.count(F.lit(1)).alias("n"), F.max("actual_tokens").alias("t"), F.max(F.abs(F.col("actual_position") - F.col("target_position"))).alias("e"))
    return g.groupBy("target_tokens").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("t").alias("most_tokens"), F.round(F.max("e"), 9).alias("position_error"))
