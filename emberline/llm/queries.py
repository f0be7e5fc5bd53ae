"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import bpe, chunks, hpylm, langid, near, nbsvm, packing, pii, ranges, resample, suffixes, tokens_out, turns, urls
from .catalog import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query()
def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text by the streaming transducer, decoded again by the state machine."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file).drop("text")
    return bpe.decode(coded, file).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of ten words of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = suffixes.mark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = suffixes.hit_words()
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        "longest_match")


@query()
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as shard files and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = tokens_out.write(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_folder(spark), end=1)
    return tokens_out.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    paired = ranges.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, moved = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - moved),
                                                  F.substring("next_text", F.lit(1), moved)))
    facts = edited.select("doc_id", n.cast("long").alias("n_chars"),
                          F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")
    return chunks.compare(facts, "text", {"edited": ("edited_fingerprint", "contained_edited", "near_edited"),
                                          "next_text": ("next_fingerprint", "contained_next", "near_next")}
                          ).drop("next_fingerprint")


@query()
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over sets of two-word shingles."""
    return near.link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


URL_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
             urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


@query("""
WITH RECURSIVE
plain AS (SELECT url, regexp_replace(html, '<!--.*?-->|<script\\b.*?</script>', ' ', 'gis') AS html FROM pages
          WHERE regexp_matches(html, '(?i)canonical|refresh') AND instr(url, '://') > 0),
headed AS (SELECT url, html, replace(regexp_extract(regexp_extract(html, '<base\\b[^>]*\\bhref\\b[^>]*>', 0, 'is'),
                      '\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is'), '&amp;', '&') AS href,
                  regexp_extract(url, '^(.*?)://', 1, 's') AS scheme,
                  translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
                  coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), ''), '/') AS p FROM plain),
scripts AS (SELECT url, html, CASE WHEN href = '' OR href[1] = '#' THEN url WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
            WHEN href[1:2] = '//' THEN scheme || ':' || href WHEN href[1] = '/' THEN scheme || '://' || h || href
            WHEN href[1] = '?' THEN scheme || '://' || h || p || href
            ELSE scheme || '://' || h || regexp_extract(p, '^(.*/)', 1, 's') || href END AS base FROM headed),
raw AS (
  SELECT url, base, replace(regexp_extract(regexp_extract(html, '<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'),
                      '\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is'), '&amp;', '&') AS link FROM scripts
  UNION ALL
  SELECT url, base, replace(regexp_extract(regexp_extract(html, '<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'),
                      '\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is'), '&amp;', '&') FROM scripts),
based AS (SELECT url, base, link, regexp_extract(base, '^(.*?)://', 1, 's') || '://'
                   || translate(regexp_extract(base, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS root,
                 coalesce(nullif(regexp_extract(base, '^.*?://[^/?#]*([^?#]*)', 1, 's'), ''), '/') AS p FROM raw WHERE link <> ''),
dotted AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
             WHEN link[1:2] = '//' THEN regexp_extract(base, '^(.*?)://', 1, 's') || ':' || link WHEN link[1] = '/' THEN root || link
             WHEN link[1] = '?' THEN root || p || link
             WHEN link[1] = '#' THEN root || p || regexp_extract(base, '^[^?#]*(\\?[^#]*)', 1, 's')
             ELSE root || regexp_extract(p, '^(.*/)', 1, 's') || link END AS whole FROM based),
parted AS (SELECT url, whole, regexp_extract(whole, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS p FROM dotted),
kept AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(p, '/')[2:], lambda x: [x])),
                   lambda done, x: CASE WHEN x[1] = '..' THEN done[1:len(done) - 1] WHEN x[1] = '.' THEN done ELSE done || x END) AS parts FROM parted),
whole AS (SELECT url, CASE WHEN regexp_matches(p, '/[.][.]?(/|$)')
            THEN regexp_extract(whole, '^(.*?://[^/?#]*)', 1, 's') || '/' || array_to_string(parts, '/')
                 || CASE WHEN regexp_matches(p, '/[.][.]?$') AND len(parts) > 0 THEN '/' ELSE '' END
                 || regexp_extract(whole, '^[^?#]*([?#].*)$', 1, 's')
            ELSE whole END AS target FROM kept),
every AS (SELECT url AS u FROM pages UNION SELECT target FROM whole),
addressed AS (
  SELECT u, h, p, CASE WHEN instr(u, '://') > 0 THEN
      translate(regexp_extract(u, '^(.*?)://', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || h
      || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1, 's') END AS address
  FROM (SELECT u, coalesce(translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS h,
               coalesce(regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS p FROM every)),
ruled AS (
  SELECT *, CASE WHEN (h = 'example.net' OR ends_with(h, '.example.net')) AND starts_with(p, '/en/') THEN 'example.net/en/'
    WHEN (h = 'example.com' OR ends_with(h, '.example.com')) AND starts_with(p, '/de/') THEN 'example.com/de/'
    WHEN (h = 'org' OR ends_with(h, '.org')) AND starts_with(p, '/fr/') THEN 'org/fr/'
    WHEN (h = 'net' OR ends_with(h, '.net')) AND starts_with(p, '/') THEN 'net/' END AS rule FROM addressed),
told AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM ruled),
edges AS (SELECT DISTINCT a.address AS x, b.address AS y FROM whole w JOIN told a ON a.u = w.url JOIN told b ON b.u = w.target
          WHERE a.address <> b.address),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT DISTINCT t.address AS node, t.own AS verdict FROM told t JOIN both_ways e ON e.x = t.address WHERE t.own IS NOT NULL
          UNION SELECT e.y, r.verdict FROM reach r JOIN both_ways e ON e.x = r.node),
passed AS (SELECT node, min(verdict) AS verdict FROM reach GROUP BY node)
SELECT p.page_id, coalesce(t.h, '') AS host, coalesce(t.p, '') AS path, t.rule AS rule,
       coalesce(t.own, a.verdict, 'allow') AS verdict, t.own IS NULL AND a.verdict IS NOT NULL AS by_alias
FROM pages p LEFT JOIN told t ON t.u = p.url LEFT JOIN passed a ON a.node = t.address
""")
def op8_redirect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page: its rule's, or what its aliases pass on."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether the checksum of an id's text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


#: Texts scored this high or higher are kept.
QUALITY_THRESHOLD = 0.3


@query()
def op2_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    scored = nbsvm.score(docs, nbsvm.learn(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@query()
def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base matches, and what the random field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"))


@query()
def op9_bayesian_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page from its text, declaration, address and host."""
    known = langid.learn(table(spark, sf_dir, "documents").select("text", "lang"))
    return langid.identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), known)


@query()
def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text")
    scored, n = hpylm.learn_and_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


@query()
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that mend its structure, and what they give."""
    rows, gone = turns.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.repair(rows, gone=gone)


@query()
def op13_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the n-grams of the benchmark, with the weights and scores of all."""
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query()
def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of token ids filled by a seed document and its lexical neighbours."""
    made = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
