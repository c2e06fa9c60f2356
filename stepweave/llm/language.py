"""Language of web pages by Bayesian evidence fusion.

log P(language | page) adds up, from counts over all rows:
* text: byte-trigram likelihoods learned from labelled documents (a table of languages x BUCKETS, of a fixed size), the
  page's mean per trigram times at most EVIDENCE trigrams, as neighbouring trigrams are not independent;
* declared language (<html lang>, searched in the whole page outside comments, scripts, styles and titles): how often pages of a language by text declare it, smoothed;
* address suffix: the host's last label, and a two-letter first part of the path, the same way;
* host prior: language shares of the host, smoothed with its domain's, those with its suffix's, those with all pages'.
Counts of a page's own host and domain leave the page itself out.

Defined cases: a page without text, declaration or url falls back on what remains, down to the overall shares; null
columns count as absent; documents without a language are not learned from; without any documents the result has null
languages; repeated rows give equal results; an empty table gives an empty result; other columns are not read. More than
MAX_LANGUAGES languages are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stepweave.llm.hot import with_group
from stepweave.llm.textbytes import column_bytes, slices
from stepweave.session import cut

BUCKETS, EVIDENCE, MAX_LANGUAGES, SMOOTH = 1 << 13, 40, 64, 5.0
KEYS = ("host", "domain", "suffix", "declared", "part")
_HIDDEN = re.compile(r"(?is)<(script|style|title)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
_ROOT = re.compile(r"""(?is)<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b.*?(?:</\1\s*>|\Z)|<html(?=[\s/])((?:"[^"]*"|'[^']*'|[^>"'])*[^>]*)""")
_DECLARED = re.compile(r"""(?is)\blang\s*=\s*["']?\s*([a-z]{2,3})""")


def declared_language(source: str) -> str | None:
    """The language of the first <html> tag that names one, outside comments and raw text, wherever it stands."""
    for m in _ROOT.finditer(source):
        told = _DECLARED.search(m[2]) if m[2] else None
        if told:
            return told[1].lower()
    return None


def _buckets(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    b = raw[lo:hi].astype(np.uint32)
    upper = (b >= 65) & (b <= 90)
    b[upper] += 32
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]) * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64)


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all documents; each batch sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            raw, off = column_bytes(batch.column(0))
            for k, name in enumerate(names):
                if name not in total:
                    if len(total) > MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    total[name] = np.zeros(BUCKETS, np.int64)
                for a in range(int(off[k]), int(off[k + 1]), 1 << 20):
                    total[name] += np.bincount(_buckets(raw, a, min(int(off[k + 1]), a + (1 << 20) + 2)), minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    return docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(bucket | language); at most MAX_LANGUAGES x BUCKETS numbers come to the driver."""
    rows = trigram_counts(docs).collect()
    names = sorted({r["lang"] for r in rows})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.full((len(names), BUCKETS), 0.5)
    for r in rows:
        n[names.index(r["lang"]), r["bucket"]] += r["n"]
    return names, np.log(n / n.sum(1, keepdims=True)) if names else n


def page_evidence(pages: DataFrame, table: np.ndarray) -> DataFrame:
    """(page_id, url, declared, text_score array: log-likelihood of each language)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            declared, score = [], []
            for source in batch.column(2).to_pylist():
                source = source or ""
                declared.append(declared_language(source))
                raw = np.frombuffer(" ".join(_HIDDEN.sub(" ", source).split()).encode(), np.uint8)
                at, sums = 0, np.zeros(len(table))
                n = max(len(raw) - 2, 0)
                while at < n:
                    sums += table @ np.bincount(_buckets(raw, at, at + (1 << 20) + 2), minlength=BUCKETS)
                    at += 1 << 20
                score.append((sums / max(n, 1) * min(n, EVIDENCE)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(score, pa.list_(pa.float64()))], ["page_id", "url", "declared", "text_score"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, declared string, text_score array<double>")


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, url, lang, probability, text_lang, declared), a row for each page."""
    names, table = likelihoods(docs)
    k = len(names)
    if not k:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = page_evidence(pages, table).withColumn("host", host)
    rows = rows.withColumn("domain", F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2))).withColumn("domain", F.when(F.contains("host", F.lit(".")), F.col("domain")).otherwise(F.lit("")))
    rows = rows.withColumn("suffix", F.when(F.col("host") != "", F.element_at(F.split("host", r"\."), -1)).otherwise(F.lit(""))).withColumn("part", F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit(""))))
    best = F.array_position("text_score", F.array_max("text_score")).cast("int") - 1
    flat = F.array_max("text_score") == F.array_min("text_score")  # no text: no guess
    rows = cut(rows.withColumn("guess", F.when(flat, F.lit(-1)).otherwise(best)).withColumns({k: F.nullif(k, F.lit("")) for k in KEYS}))
    overall = rows.agg(*(F.sum((F.col("guess") == i).cast("long")).alias(str(i)) for i in range(k))).first()
    total = [(overall[i] or 0) for i in range(k)]
    everywhere = [(t + 1) / (sum(total) + k) for t in total]
    out = rows
    for key in KEYS:  # counts of each language by text; rows of a hot host and rows without one are spread
        found = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*(F.sum((F.col("guess") == i).cast("long")) for i in range(k))).alias(f"n_{key}"), F.count("*").alias("rows"))
        out = with_group(out, found, [key], "rows").drop("rows")
    own = lambda i: (F.col("guess") == i).cast("int")

    def count(key: str, i: int) -> Column:
        return F.greatest(F.coalesce(F.col(f"n_{key}")[i], F.lit(0)) - own(i), F.lit(0))

    def size(key: str) -> Column:
        return sum((count(key, i) for i in range(k)), F.lit(0))

    score = []
    for i in range(k):
        shares = F.lit(everywhere[i])
        for key in ("suffix", "domain", "host"):
            shares = (count(key, i) + SMOOTH * shares) / (size(key) + SMOOTH)
        told = F.log(shares)
        for key in ("declared", "part"):  # P(value | language), up to what all languages share
            told = told + F.when(F.col(key).isNotNull(), F.log((count(key, i) + 1.0) / F.lit(float(total[i] + k)))).otherwise(0.0)
        score.append(F.col("text_score")[i] + told)
    out = out.withColumn("score", F.array(*score))
    top = F.array_max("score")
    lang = F.array(*map(F.lit, names))
    weight = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return out.select("page_id", "url", F.get(lang, F.array_position("score", top).cast("int") - 1).alias("lang"), (1 / weight).alias("probability"), F.when(F.col("guess") >= 0, F.get(lang, F.col("guess"))).alias("text_lang"), "declared")
