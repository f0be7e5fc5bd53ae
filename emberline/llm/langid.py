"""Language of pages by fusing evidence: text, declared language, address suffix, and a prior of the host.

* Text: letter trigrams under a smoothed model of each language, learned from all documents with a known language; the sums
  are ``BUCKETS`` numbers a language, added up within tasks first. Trigrams overlap, so a text counts as at most ``TRIGRAMS`` independent ones.
* Declared language (``<html lang>``) and address suffix: how often each value stands with each language, from sums of text
  posteriors over all pages by value; a page that lies about its language thus weakens the evidence of that value.
* Host prior: sums of posteriors over all pages by host, smoothed towards its domain's, smoothed towards that of all pages. A
  page's own share is taken out of the sums, so it is not its own witness.

The posterior is the normalised product of the three likelihoods and the prior.

Cases: a null or empty page has no text evidence; a null address has an empty host and no suffix, a missing or odd
declaration is a value of its own; ties go to the language that comes first in the alphabet; repeated pages are
witnesses of each other; without known languages the language is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls
from .batches import bounded, with_columns
from .stored import stored
from .words import LOWER, mix, utf8

TRIGRAMS, BUCKETS = 40, 1 << 14
#: Rows that a parent's distribution counts for, and the smoothing of value counts.
STRENGTH, SMOOTHING = 5.0, 1.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[0x80:] = _LETTER[0x20] = True


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each trigram of bytes of letters and blanks, within one text."""
    data, offsets = utf8(texts)
    data = LOWER[data].astype(np.uint64)
    n = max(len(data) - 2, 0)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    letters = _LETTER[data.astype(np.uint8)]
    keep = letters[:n] & letters[1:n + 1] & letters[2:n + 2] & (text[:n] == text[2:n + 2])
    code = (data[:n] << np.uint64(16)) | (data[1:n + 1] << np.uint64(8)) | data[2:n + 2]
    return (mix(code[keep]) >> np.uint64(40)).astype(np.int64) % BUCKETS, text[:n][keep]


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # language by bucket

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        """Log likelihood of each text in each language, with the weight of at most ``TRIGRAMS`` trigrams."""
        bucket, text = trigrams(texts)
        count = np.bincount(text, minlength=len(texts))
        total = np.stack([np.bincount(text, p[bucket], len(texts)) for p in self.log_p], axis=1)
        return total * (np.minimum(count, TRIGRAMS) / np.maximum(count, 1))[:, None]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Trigram models of all languages that ``lang`` names beside any text with a trigram."""
    own = bounded(docs.sparkSession) and docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            bucket, text = trigrams(batch.column(0))
            names = batch.column(1).to_pylist()
            for name in set(names):
                mine = np.array([x == name for x in names])
                got = np.bincount(bucket[mine[text]], minlength=BUCKETS)
                counts[name] = counts[name] + got if name in counts else got
        for name, count in counts.items():
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(count[seen])],
                                             names=["lang", "bucket", "n"])

    summed = (own.mapInArrow(run, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    lang = np.array(summed["lang"].to_pylist(), dtype=object)
    names = sorted(set(lang))
    counts = np.full((len(names), BUCKETS), 0.5)
    for i, name in enumerate(names):
        mine = lang == name
        counts[i, summed["bucket"].to_numpy()[mine]] += summed["n"].to_numpy()[mine]
    return Languages(names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts)


def plain_text(html: Column) -> Column:
    """The visible text of a page."""
    text = F.regexp_replace(html, "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>", " ")
    return F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", " "), "&#?[A-Za-z0-9]{1,8};", " ")


def declared(html: Column) -> Column:
    """The main part of the html element's language, or ``-``."""
    tag = F.regexp_extract(html, "(?is)<html\\b[^>]*>", 0)
    found = F.regexp_extract(F.lower(tag), "(?s)\\slang\\s*=\\s*[\"']?([a-z]{2,3})\\b", 1)
    return F.coalesce(F.when(found != "", found), F.lit("-"))


def normalised(logs: Column) -> Column:
    """Probabilities from logs."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def added(*logs: Column) -> Column:
    out = logs[0]
    for more in logs[1:]:
        out = F.zip_with(out, more, lambda a, b: a + b)
    return out


def sums(df: DataFrame, keys: list[str], column: str, n: int, name: str) -> DataFrame:
    """The sum of an array column over the rows of each key, by place; partial sums before the shuffle."""
    made = df.groupBy(*keys).agg(*[F.sum(F.col(column)[i]).alias(f"__{i}") for i in range(n)])
    return made.select(*keys, F.array(*[f"__{i}" for i in range(n)]).alias(name))


def value_evidence(df: DataFrame, value: str, posterior: str, n: int, name: str) -> DataFrame:
    """Log of how likely each value is in each language, from posteriors summed by value."""
    by_value = sums(df, [value], posterior, n, "own")
    whole = sums(by_value, [], "own", n, "all").select("all").scalar()
    rows = by_value.withColumns({"__all": whole, "__values": by_value.select(F.count("*")).scalar()})
    return rows.select(value, F.zip_with("own", "__all", lambda own, every: F.log(
        (own + SMOOTHING) / (every + SMOOTHING * F.col("__values")))).alias(name))


def smoothed(own: Column, mine: Column, parent: Column) -> Column:
    """Shares of a group without one row's part, with the parent's shares as ``STRENGTH`` more rows."""
    rest = F.zip_with(own, mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    n = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(rest, parent, lambda a, p: (a + STRENGTH * p) / (n + STRENGTH))


def identify(pages: DataFrame, languages: Languages, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, language, confidence, text_language, declared, suffix, host), one per page."""
    n = len(languages.names)
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    host = F.regexp_replace(urls.host(F.col("url")), "^.*@|:[0-9]*$", "")
    facts = own.select("page_id", host.alias("host"), declared(F.col("html")).alias("declared"), plain_text(F.col("html")).alias("text"))
    facts = facts.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    if not n:
        return facts.select("page_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"),
                            F.lit(None).cast("string").alias("text_language"), "declared", "suffix", "host")
    shared = pages.sparkSession.sparkContext.broadcast(languages)

    def start():
        model = shared.value
        return lambda texts: (pa.array(list(model.likelihoods(texts)), pa.list_(pa.float64())),)

    read = with_columns(facts, ["text"], [T.StructField("log_text", T.ArrayType(T.DoubleType()))], start, drop=["text"])
    read = stored(read.withColumn("by_text", normalised(F.col("log_text"))))

    # Values first seen with text alone, then posteriors of text and declaration summed by host and domain.
    said = read.join(value_evidence(read, "declared", "by_text", n, "log_declared"), "declared")
    said = said.join(value_evidence(read, "suffix", "by_text", n, "log_suffix"), "suffix")
    said = stored(said.withColumn("mine", normalised(added(F.col("log_text"), F.col("log_declared")))))
    hosts = stored(sums(said, ["domain", "host"], "mine", n, "host_sum"))
    domains = stored(sums(hosts, ["domain"], "host_sum", n, "domain_sum"))
    every = sums(domains, [], "domain_sum", n, "all").select("all").scalar()
    flat = F.array(*[F.lit(1.0 / n)] * n)
    placed = said.join(hosts, ["domain", "host"]).join(domains, "domain").withColumn("every", every)
    placed = placed.withColumn("prior_all", smoothed(F.col("every"), F.col("mine"), flat))
    placed = placed.withColumn("prior_domain", smoothed(F.col("domain_sum"), F.col("mine"), F.col("prior_all")))
    placed = placed.withColumn("prior", smoothed(F.col("host_sum"), F.col("mine"), F.col("prior_domain")))
    placed = placed.withColumn("posterior", normalised(added(
        F.col("log_text"), F.col("log_declared"), F.col("log_suffix"), F.transform("prior", lambda p: F.log(p)))))
    names = F.array(*map(F.lit, languages.names))

    def top(column: str) -> Column:
        return F.get(names, F.array_position(column, F.array_max(column)).cast("int") - 1)

    return placed.select("page_id", top("posterior").alias("language"), F.array_max("posterior").alias("confidence"),
                         top("by_text").alias("text_language"), "declared", "suffix", "host")
