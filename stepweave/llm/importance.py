"""Importance resampling towards a target distribution of hashed word features.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased; features are runs of up to ``runs`` words joined by
one space, and a feature's bucket is its bytes' crc32 modulo ``buckets``. A bucket's gain compares its share of the target with
its share of all documents; a document's weight is the sum of its features' gains, and the highest weights after Gumbel noise
are drawn, which is sampling without replacement by weight.

Scan: an Aho-Corasick automaton holds words between delimiters (" word "), each with a payload of its crc32 and its length in bytes.
A task turns about a megabyte of texts into bytes with one delimiter between any two words or texts, and the automaton emits the
payloads of all its words in one go. A run's crc32 is composed from the payloads of its words (a crc shifted by the next
length, then added), so no run is ever built as a string. The dictionary holds the at most MAX_WORDS most frequent words, of
at most WORD_BYTES bytes, in SAMPLE_DOCS documents: it decides on speed alone, as a word that it lacks is found by its
delimiters and gets the same payload computed at its place.

Both scans read all texts; counts are added up within each task first, so each sends at most ``buckets`` numbers. The driver
holds the counts of the buckets and one number for each partition of the ranking, never rows.

Defined cases: null texts, empty ones and texts without words have no features and weight 0; they take no part in the draw, nor
does any text of fewer than ``least_words`` words. A null id counts as an empty one in the noise and comes last among equal scores. Rows that repeat an
id are drawn on their own. Texts of any length are read whole. An empty target or table counts nothing, which is no error. Only the id and
the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stepweave.llm.sampling import bounded_sample
from stepweave.llm.textbytes import column_bytes, slices
from stepweave.session import cut

MAX_WORDS, WORD_BYTES, SAMPLE_DOCS = 50_000, 64, 2_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_CLEAN = np.full(256, 0x20, np.uint8)  # what a byte becomes: itself, its lower case, or the delimiter
_CLEAN[0x80:] = np.arange(0x80, 256)
_CLEAN[0x30:0x3A] = np.arange(0x30, 0x3A)
_CLEAN[0x61:0x7B] = _CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)


def _crc_shifts() -> np.ndarray:
    """Tables [k, i, b]: what byte i of a crc with value b becomes when 2**k zero bytes follow."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the crc is linear but for its ends
    tables = np.zeros((32, 4, 256), np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for i in range(4):
        tables[0, i] = one[byte] if i == 0 else byte << np.uint32(8 * i - 8)
    for k in range(1, 32):
        for i in range(4):
            tables[k, i] = _shift_once(tables[k - 1], tables[k - 1, i])
    return tables


def _shift_once(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_SHIFT = _crc_shifts()


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of strings put together, from both parts' crc32 and the second's length in bytes."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        bit = (length >> k & 1).astype(bool)
        out[bit] = _shift_once(_SHIFT[k], out[bit])
    return out ^ second


class Scanner:
    """An automaton over delimiter-bounded words, and the payloads of the words of texts."""

    def __init__(self, words: list[bytes]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)  # a character for each byte, so positions are in bytes
        if words:
            self.automaton.make_automaton()

    def payloads(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, crc32, bytes) of each word in order, and how many words the automaton lacked."""
        n, lens = len(off) - 1, np.diff(off)
        line = np.full(int(off[-1] - off[0]) + n + 1, 0x20, np.uint8)  # a delimiter before each text and at the end
        begin = off[:-1] - off[0] + np.arange(n)
        line[np.arange(off[-1] - off[0]) + np.repeat(np.arange(n) + 1, lens)] = _CLEAN[raw[off[0] : off[-1]]]
        ink = line != 0x20
        start, end = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1, np.flatnonzero(ink[:-1] & ~ink[1:]) + 1
        data = line.tobytes()
        crc, known = np.zeros(len(start), np.uint32), np.zeros(len(start), bool)
        if len(self.crc) and len(start):
            hit = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, hit[:, 0])
            crc[at], known[at] = self.crc[hit[:, 1]], True
        lacked = np.flatnonzero(~known)
        crc[lacked] = np.fromiter((zlib.crc32(data[s:e]) for s, e in zip(start[lacked].tolist(), end[lacked].tolist())), np.uint32, len(lacked))
        return np.searchsorted(begin, start, "right") - 1, crc, end - start, len(lacked)

    def features(self, raw: np.ndarray, off: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, crc32) of each run of 1 to ``runs`` words, and the number of words of each text."""
        row, crc, size, _ = self.payloads(raw, off)
        rows, out, whole = [row], [crc], crc
        if runs > 1:
            space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
            spaced = joined(space, crc, size)
            for k in range(1, min(runs, len(crc))):
                whole = joined(whole[:-1], spaced[k:], size[k:] + 1)
                same = row[:-k] == row[k:]
                rows.append(row[:-k][same])
                out.append(whole[same])
        return np.concatenate(rows), np.concatenate(out), np.bincount(row, minlength=len(off) - 1)


def dictionary(docs: DataFrame, most: int = MAX_WORDS, doc_id: str = "doc_id", text: str = "text") -> list[bytes]:
    """The most frequent words of a bounded sample of documents, at most ``most``."""
    some = bounded_sample(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), ["id"], SAMPLE_DOCS)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = some.select(F.explode(F.split(low, _NO_WORD)).alias("w")).filter(f"w <> '' AND octet_length(w) <= {WORD_BYTES}")
    return [r["w"].encode() for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()]


_SCANNERS: dict[int, Scanner] = {}


def _scanner(words) -> Scanner:
    """The scanner of a broadcast dictionary, built once a worker; any dictionary gives the same payloads."""
    key = id(words.value)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(words.value)
    return _SCANNERS[key]


def bucket_counts(texts: DataFrame, words, runs: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all ``texts`` in each bucket; ``words`` is a broadcast dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scan = np.zeros(buckets, np.int64), None
        for batch in batches:
            scan = scan or _scanner(words)
            raw, off = column_bytes(batch.column(0))
            for i, j in slices(off):
                total += np.bincount(scan.features(raw, off[i : j + 1], runs)[1] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of add-one shares) of each bucket."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, words, gain: np.ndarray, runs: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each of ``docs``."""
    kind, buckets = docs.select(F.col(doc_id)).schema[0].dataType.simpleString(), np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            scan = scan or _scanner(words)
            raw, off = column_bytes(batch.column(1))
            for i, j in slices(off):
                row, crc, n = scan.features(raw, off[i : j + 1], runs)
                size = np.bincount(row, minlength=j - i)
                total = np.zeros(len(row) + 1, np.int64)
                order = np.argsort(row, kind="stable")
                np.cumsum(gain[crc[order] % buckets], out=total[1:])
                end = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in (n, size, total[end] - total[end - size]))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, best: str, tie: str) -> tuple[DataFrame, int]:
    """Written ``rows`` with their place (from 1) by ``best`` descending, ties to the smaller ``tie``; and their number.

    Rows are dealt to ranges; a row's place is its place in its range and the sizes of the ranges before it.
    Equal rows are told apart by a number, so they are dealt to several ranges too.
    """
    spark = rows.sparkSession
    order = [F.desc(best), F.col(tie).asc_nulls_last(), F.asc("_n")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.drop("_n").withColumn("_at", F.monotonically_increasing_id()))  # the range, then 33 bits of the place in it
    sizes = sorted(placed.groupBy(F.shiftright("_at", 33).alias("range")).agg(F.count("*").alias("k")).collect())
    before, seen = [], 0
    for part, k in sizes:
        before.append((part, seen))
        seen += k
    ahead = spark.createDataFrame(before, "_range long, _ahead long")
    met = placed.join(F.broadcast(ahead), F.shiftright("_at", 33) == F.col("_range"))
    return met.withColumn("rank", F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_range", "_ahead"), seen


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, most: int = MAX_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each of ``docs``; rank is null where it isn't drawn.

    ``target``: a table with the same text column. ``percent`` of the documents with ``least_words`` words or more are drawn.
    """
    spark: SparkSession = docs.sparkSession
    words = spark.sparkContext.broadcast(dictionary(docs, most, doc_id, text))  # at most ``most`` words of WORD_BYTES bytes
    gain = gains(bucket_counts(docs, words, runs, buckets, text), bucket_counts(target, words, runs, buckets, text))
    scored = cut(weighed(docs, words, gain, runs, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit, n = ranked(scored.filter(F.col("n_words") >= least_words), "score", "doc_id")
    drawn = fit.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
