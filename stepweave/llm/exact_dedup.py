"""Exact dedup by content-defined chunk recipes.

1. Each text is normalised (every run of ASCII white space becomes one space) and cut where a rolling gear hash of
   the last 16 bytes meets a mask, so equal passages give equal chunks wherever they stand.
2. Chunk contents move once, combined on the map side, and are deduplicated by their bytes. A chunk's identifier is
   its 128-bit digest; where two contents share a digest, the verified identifier gets an ordinal that tells them apart.
3. Texts are equal when their ordered identifier lists (recipes) are; only recipes (16 bytes for each 4 kB or so) are
   grouped, and only (key, smallest doc_id, size) of groups with more than one member is joined back.

Defined cases: null text counts as empty; all empty texts are one group; rows that repeat a doc_id stay separate rows of
the result and count in group_size; the smallest doc_id of a group stays, and of several rows with that doc_id all are
marked kept. A null doc_id is larger than any other: it isn't kept beside one, and where a group has null ids only, keep_id is
null and its rows are marked kept. ``drop_copies`` goes by rows instead of ids and keeps exactly one row of each text. An
empty table gives an empty result; other columns are ignored by ``recipes`` and kept by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stepweave.llm.hot import with_group
from stepweave.llm.names import number_of, numbered
from stepweave.session import cut, discard

WINDOW, MIN_BYTES, MAX_BYTES = 16, 512, 65_536
MASK = np.uint32(((1 << 11) - 1) << 16)  # a cut every 2 kB or so past the minimum

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_RUN = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")  # runs that a single space isn't already
DIGEST_BYTES, MAX_COLLIDING_BYTES, MAX_HOT_BYTES = 16, 64 << 20, 4096
_PART = 1 << 20


def cut_points(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``."""
    n = len(data)
    if n <= MIN_BYTES:
        return [n] if n else []
    raw, found = np.frombuffer(data, np.uint8), []
    for lo in range(0, n, _PART):  # the window reaches back over the part's start
        back = max(0, lo - WINDOW + 1)
        h = _GEAR[raw[back : lo + _PART]]
        for k in (1, 2, 4, 8):  # gear hash of 16 bytes by doubling
            g = h.copy()
            g[k:] += h[:-k] << np.uint32(k)
            h = g
        found.append(np.flatnonzero((h[lo - back :] & MASK) == 0) + lo + 1)
    ends, last = [], 0
    for p in np.concatenate(found).tolist():
        while p - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if p - last >= MIN_BYTES:
            ends.append(p)
            last = p
    while n - last > MAX_BYTES:
        last += MAX_BYTES
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunks(text: str | None) -> tuple[bytes, list[bytes]]:
    data = _RUN.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))
    ends = cut_points(data)
    return data, [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def distinct_chunks(docs: DataFrame, text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(digest, chunk): the distinct chunk contents, compared byte by byte.

    A task forwards a content once for each few megabytes it reads, and Spark combines again before the shuffle, so
    a chunk of a third of all rows arrives a few times from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict[bytes, bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], ["digest", "chunk"])

        for batch in batches:
            seen: dict[bytes, bytes] = {}
            size = 0
            for value in batch.column(0):
                for chunk in _chunks(value.as_py())[1]:
                    if chunk not in seen:
                        seen[chunk] = _digest(chunk, digest_bytes)
                        size += len(chunk)
                if size > 1 << 23:
                    yield out(seen)
                    seen, size = {}, 0
            yield out(seen)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "digest binary, chunk binary").distinct()


def colliding_chunks(docs: DataFrame, text: str = "text", digest_bytes: int = DIGEST_BYTES) -> dict[bytes, list[bytes]]:
    """Digests that different contents share, with those contents in order; as a rule none.

    Only digests move in the second grouping. Contents are fetched for shared digests alone; if they sum to more than
    MAX_COLLIDING_BYTES (never, with 128 bits), that is an error, so what the driver and the tasks get has a checked size.
    """
    chunks = distinct_chunks(docs, text, digest_bytes)
    shared = cut(chunks.groupBy("digest").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("bytes")).filter("n > 1"))
    total = shared.agg(F.sum("bytes")).first()[0]
    if not total:
        return {}
    if total > MAX_COLLIDING_BYTES:
        raise ValueError(f"chunks of {total} bytes share digests of {digest_bytes} bytes")
    found: dict[bytes, list[bytes]] = {}
    for r in sorted(chunks.join(shared, "digest", "left_semi").collect(), key=lambda r: bytes(r["chunk"])):
        found.setdefault(bytes(r["digest"]), []).append(bytes(r["chunk"]))
    discard(shared)
    return found


def _keyed(values: pa.Array, shared: dict[bytes, list[bytes]], digest_bytes: int) -> tuple[list[bytes], list[str]]:
    """Recipe and digest of each text."""
    recipe, sha = [], []
    for value in values:
        data, chunks = _chunks(value.as_py())
        ids = [_digest(c, digest_bytes) for c in chunks]
        if shared:
            ids = [d + (bisect_left(shared[d], c) if d in shared else 0).to_bytes(4, "big") for d, c in zip(ids, chunks)]
        recipe.append(b"".join(ids))
        sha.append(hashlib.sha256(data).hexdigest())
    return recipe, sha


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, recipe, text_sha256), a row for each row of ``docs``; recipe is the list of verified identifiers."""
    shared = colliding_chunks(docs, text, digest_bytes)
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, sha = _keyed(batch.column(1), shared, digest_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha)], ["doc_id", "recipe", "text_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, recipe binary, text_sha256 string")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    The grouping combines on the map side; ``with_group`` spreads the rows of large groups when they meet its result.
    """
    listed = cut(recipes(docs, doc_id, text, digest_bytes))
    groups = cut(listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    # what is broadcast is short: longer recipes count as groups of one row there, and join as all others do
    figures = groups.withColumn("rank", F.expr(f"if(length(recipe) <= {MAX_HOT_BYTES}, group_size, 1)"))
    met = with_group(listed, figures, ["recipe"], "rank")
    own = F.col("keep_id").isNull() | F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(False))
    return met.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), own.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, its columns unchanged.

    The row with the smallest doc_id stays (null is the largest); of several with that id one, by the hash of the row. Rows
    move once, those of one text combined on the map side.
    """
    shared = colliding_chunks(docs, text)
    rows, key, at = numbered(docs), number_of(docs, doc_id), int(number_of(docs, text)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe = pa.array(_keyed(batch.column(at), shared, DIGEST_BYTES)[0], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, recipe], [*batch.schema.names, "recipe"])

    hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    tagged = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("recipe", BinaryType())]))
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(key).isNull(), key, F.xxhash64(*hashed)))
    return tagged.groupBy("recipe").agg(first.alias("row")).select("row.*").toDF(*docs.columns)
