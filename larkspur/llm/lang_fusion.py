"""Language ID of web pages by Bayesian fusion of text, declared language, address suffix and host.

    P(lang | page)  ~  P(text | lang) * P(declared | lang) * P(lang | host)

P(text | lang) is a naive Bayes model over hashed character trigrams of words, fitted on at most FIT_DOCS documents with
a known language, chosen by a hash of doc_id.  Words of a page depend on each other, so its log likelihood is the mean over all its
words times min(words, text_words): beyond that many words the text is as sure as it gets, and does not drown the other evidence.  P(declared | lang) and P(lang | host) come from grouped aggregation of the
text posteriors of all pages.  The host prior is smoothed along a hierarchy: all pages -> suffix (last label of
the host) -> domain (last two labels) -> host; a level with n pages weighs n against `strength` of the level above it.  A page's own
posterior is taken out of its host's sums, so no page is its own evidence.

The aggregations have a row for each host at most and combine before their shuffle.  Joins back to the pages are by
host; Spark splits a host with many pages.  Text is read whole.

Defined results: a null or empty page has no text evidence (a flat likelihood); a null url or one without :// has the
host '' and only the priors of all pages; an unknown declared language counts as 'other', none as ''; repeated
rows count each (a copy is evidence for the other) and get equal results up to rounding; a very long page is read whole; without any labelled document the language is null; equal posteriors go to the
language that is first by name; an empty table gives no rows; other columns are ignored.  Every language of the fitted sample is two
columns beside each page (likelihood and posterior), so this is for tens of languages; rows that share a doc_id of the sample are all learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, freed, hash_sample, near, slices, table
from .url_filter import url_host

BUCKETS = 1 << 15
FIT_DOCS = 3000
#: Weight of the text, in words, and of a level's prior, in pages: defaults of `identify`.
TEXT_WORDS = 40
STRENGTH = 20.0
MEMO = 300_000
WORDS = re.compile(r"[^\W\d_]+")
MARKUP = r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def trigrams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2)]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, count) of the trigrams of a task's documents, of those that occur."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for w in WORDS.findall(text.lower()):
                for t in trigrams(w):
                    at[t] += 1
    for lang, n in sums.items():
        seen = np.flatnonzero(n) if n.any() else np.zeros(1, np.int64)  # a language without trigrams is one, too
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log P(trigram | language) as an array (BUCKETS, languages).

    It learns from FIT_DOCS rows of documents at most, or from all rows of their ids where ids repeat.  The driver gets one row for each
    language and trigram bucket of these.
    """
    known = docs.where("lang is not null and text is not null")
    picked = hash_sample(known.select("doc_id"), FIT_DOCS, "doc_id").distinct()
    # At most FIT_DOCS ids are broadcast.
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id")
    counted = sample.select("lang", "text").mapInArrow(count_batches, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    m = np.full((BUCKETS, len(langs)), 0.5)
    m[counted["bucket"], [langs.index(x) for x in counted["lang"]]] += counted["n"]
    return langs, np.log(m / m.sum(0))


class TextModel:
    def __init__(self, logp: np.ndarray, most: int):
        self.logp, self.most, self.memo = logp, most, {}

    def word(self, w: str) -> np.ndarray:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[w] = self.logp[trigrams(w)].mean(0)
        return got

    def loglik(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        if not words:
            return np.zeros(self.logp.shape[1])
        return np.sum([self.word(w) for w in words], axis=0) / len(words) * min(len(words), self.most)


def text_batches(batches: Iterator[pa.RecordBatch], sent, most: int) -> Iterator[pa.RecordBatch]:
    model = TextModel(sent.value, most)
    for b in slices(batches):
        k = b.schema.get_field_index("text")
        ll = np.array([model.loglik(t) for t in b.column(k).to_pylist()]).reshape(b.num_rows, -1)
        p = np.exp(ll - ll.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        both = [pa.array(np.ascontiguousarray(x)) for x in (*ll.T, *p.T)]
        rest = [i for i in range(b.num_columns) if i != k]
        n = ll.shape[1]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *both], names=[*(b.schema.names[i] for i in rest), *(f"l{i}" for i in range(n)), *(f"p{i}" for i in range(n))])


def declared(html: Column, langs: list[str]) -> Column:
    """The lang of the html element, its first part; 'other' for a language that the text model does not know."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    return F.when(found.isNull() | (found == ""), F.lit("")).when(found.isin(langs), found).otherwise(F.lit("other"))


def identify(pages: DataFrame, docs: DataFrame, text_words: int = TEXT_WORDS, strength: float = STRENGTH) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared of every page."""
    langs, logp = fit(docs)
    none = F.lit(None)
    if not langs:
        return pages.select(F.col("page_id").cast("bigint").alias("page_id"), none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"), none.cast("string").alias("declared"))
    n = len(langs)
    sent = pages.sparkSession.sparkContext.broadcast(logp)  # BUCKETS numbers a language
    host = url_host(F.col("url"))
    label = F.split("host", "[.]")
    light = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), F.coalesce(declared(F.col("html"), langs), F.lit("")).alias("declared"), F.coalesce(F.regexp_replace("html", MARKUP, " "), F.lit("")).alias("text"))
    light = light.withColumn("suffix", F.element_at(label, -1)).withColumn("domain", F.concat_ws(".", F.slice(F.reverse(label), 1, 2)))
    shape = "page_id bigint, host string, declared string, suffix string, domain string, " + ", ".join(f"{c}{i} double" for c in "lp" for i in range(n))
    read = cut(light.select("page_id", "host", "declared", "text", "suffix", "domain").mapInArrow(freed(lambda it: text_batches(it, sent, text_words)), shape))

    each = range(n)
    hosts = read.groupBy("suffix", "domain", "host").agg(*(F.sum(f"p{i}").alias(f"h{i}") for i in each))
    domains = hosts.groupBy("suffix", "domain").agg(*(F.sum(f"h{i}").alias(f"d{i}") for i in each))
    suffixes = domains.groupBy("suffix").agg(*(F.sum(f"d{i}").alias(f"s{i}") for i in each))
    # One number for each language and for each (declared, language): a row for each of n + 2 declared values.
    said = read.groupBy("declared").agg(*(F.sum(f"p{i}").alias(f"c{i}") for i in each)).collect()
    total = [sum(r[f"c{i}"] for r in said) for i in each]
    pages_all = max(sum(total), 1e-9)
    prior = [(t + 1.0) / (pages_all + n) for t in total]
    kinds = n + 2
    said_log = {r["declared"]: [float(np.log((r[f"c{i}"] + 0.5) / (total[i] + 0.5 * kinds))) for i in each] for r in said}

    # Suffixes are few in any collection: they are broadcast behind a count, or else joined, and Spark splits the common ones.
    levels = hosts.join(domains, ["suffix", "domain"]).join(near(cut(suffixes)), "suffix").select("host", *(f"{c}{i}" for c in "hds" for i in each))
    x = read.join(levels, "host")
    # Sums without this page's own part, then the level above with weight STRENGTH.
    sums = {c: [F.greatest(F.col(f"{c}{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in each] for c in "hds"}
    above: list[Column] = [F.lit(v) for v in prior]
    for c in "sdh":
        size = sum(sums[c][1:], sums[c][0]) + F.lit(strength)
        x = x.withColumns({f"prior_{c}{i}": (sums[c][i] + F.lit(strength) * above[i]) / size for i in each})
        above = [F.col(f"prior_{c}{i}") for i in each]

    def of_declared(i: int) -> Column:
        out = F.lit(0.0)
        for k, v in said_log.items():
            out = F.when(F.col("declared") == k, F.lit(v[i])).otherwise(out)
        return out

    x = x.withColumns({f"m{i}": F.col(f"l{i}") + of_declared(i) + F.log(above[i]) for i in each})
    best = F.greatest(*(F.col(f"m{i}") for i in each)) if n > 1 else F.col("m0")
    top_text = F.greatest(*(F.col(f"p{i}") for i in each)) if n > 1 else F.col("p0")
    x = x.withColumn("best", best).withColumn("top_text", top_text)
    name = lambda c, top: F.coalesce(*(F.when(F.col(f"{c}{i}") == F.col(top), F.lit(langs[i])) for i in each))
    z = sum((F.exp(F.col(f"m{i}") - F.col("best")) for i in each), F.lit(0.0))
    return x.select("page_id", name("m", "best").alias("lang"), (1 / z).alias("confidence"), name("p", "top_text").alias("text_lang"), "declared")


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
