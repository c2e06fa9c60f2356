"""SimHash fingerprints of 128 bits, and the search within a Hamming radius. DataFrame functions only.

Terms are adjacent word pairs (the last word stands alone); a term weighs as many as its first word has characters, up to 12,
so short frequent words count little, and each occurrence counts. A term's hash votes with its weight for or against
each bit. Votes are summed two to a long (32 bits each), so 64 sums make 128 bits.

The search hashes each distinct fingerprint into permuted block tables: with ``radius`` + 2 blocks, fingerprints within
the radius agree on two blocks at least, so each pair of blocks is the key of one table. A query and a fingerprint are compared
wherever they share a key and found in the first such table alone, so nothing has to be made distinct. The fingerprints of a
key are dealt into salts of about SALT_ROWS, each of which meets all queries of the key. Nothing is left out.

Defined cases: null counts as empty; a text without words has the fingerprint of zeros; equal texts have equal
fingerprints; rows that repeat an id stay apart rows; an empty table gives an empty result; other columns are not read.
MAX_WEIGHT is part of the term's definition: raising it lets long words count for more.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from stepweave.session import cut

WHITE = r"[\x20\x09-\x0D]+"
SALT_ROWS, MAX_WEIGHT = 1_024, 12
_PAIR = 0x0000000100000001


def terms(text: Column) -> Column:
    """Array of struct(h, w): hash and weight of each term of a text."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.least(F.length(a), F.lit(MAX_WEIGHT)).cast("long").alias("w")))


def _bits(half: str) -> Column:
    """64 bits from the 32 sums of two votes each: a bit is set where its votes are more than half of all."""
    parts = [f"if(2 * ({half}{i} & 4294967295) > w, {1 << i}L, 0L) | if(2 * shiftrightunsigned({half}{i}, 32) > w, shiftleft(1L, {i + 32}), 0L)" for i in range(32)]
    return F.expr("coalesce(" + " | ".join(f"({p})" for p in parts) + ", 0L)")


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, f1, f2): the halves of the fingerprint of each row; ``keys`` must name a row."""
    lean = rows.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("t")).select(*keys, F.col("t.h").alias("p"), F.xxhash64("t.h").alias("q"), F.col("t.w").alias("weight"))
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_PAIR)) * F.col("weight")).alias(f"{h}{i}") for h in ("p", "q") for i in range(32)]
    voted = lean.groupBy(*keys).agg(F.sum("weight").alias("w"), *sums)
    return voted.select(*keys, _bits("p").alias("f1"), _bits("q").alias("f2"))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))) / F.lit(128.0)


def as_text(f1: str, f2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def _masks(blocks: int) -> list[tuple[str, str]]:
    """The bits of each block in both halves, as SQL numbers."""
    edge = [128 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    signed = lambda x: f"(-{(1 << 64) - x - 1}L - 1L)" if x >> 63 else f"{x}L"
    return [(signed(m & (2**64 - 1)), signed(m >> 64)) for m in bits]


def _tables(prints: DataFrame, blocks: int) -> DataFrame:
    """(t, m1, m2, f1, f2): each fingerprint under each pair of ``blocks`` blocks."""
    mask = _masks(blocks)
    keys = [f"struct({t} AS t, f1 & ({mask[i][0]} | {mask[j][0]}) AS m1, f2 & ({mask[i][1]} | {mask[j][1]}) AS m2)" for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    return prints.select("f1", "f2", F.expr(f"explode(array({', '.join(keys)}))").alias("k")).select("k.*", "f1", "f2")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(q1, q2, f1, f2): for each distinct query (f1, f2) all other distinct fingerprints that differ in at most ``radius`` bits, each once."""
    blocks = radius + 2
    asked = _tables(queries.select("f1", "f2").distinct(), blocks).select("t", "m1", "m2", F.col("f1").alias("q1"), F.col("f2").alias("q2"))
    table = _tables(prints.select("f1", "f2").distinct(), blocks)
    # salts of the keys that need more than one: at most one such key for SALT_ROWS rows of the table
    large = cut(table.groupBy("t", "m1", "m2").agg(F.count("*").alias("n")).filter(f"n > {SALT_ROWS}").select("t", "m1", "m2", F.expr(f"cast(n div {SALT_ROWS} + 1 as int)").alias("salts")))
    salted = lambda rows, salt: rows.join(large, ["t", "m1", "m2"], "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salt).drop("salts")
    if not large.isEmpty():
        table = salted(table, F.expr("cast(pmod(xxhash64(f1, f2), salts) as int)"))
        asked = salted(asked, F.explode(F.expr("sequence(0, salts - 1)")))
    agree = [f"((f1 ^ q1) & {a}) | ((f2 ^ q2) & {b}) = 0" for a, b in _masks(blocks)]
    first = "CASE " + " ".join(f"WHEN ({agree[i]}) AND ({agree[j]}) THEN {t}" for t, (i, j) in enumerate(combinations(range(blocks), 2))) + " END"
    met = asked.join(table, [c for c in table.columns if c not in ("f1", "f2")])
    return met.filter(F.expr(f"bit_count(f1 ^ q1) + bit_count(f2 ^ q2) BETWEEN 1 AND {int(radius)} AND t = {first}")).select("q1", "q2", "f1", "f2")


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) in descending order of distinct non-null ids; the last is followed by the first.

    Ids are cut into ranges; only each range's ends, as many as partitions, are ordered together.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(ids.select("id").filter("id is not null").distinct().repartitionByRange(n, "id").select("id", F.spark_partition_id().alias("range")))
    ends = placed.groupBy("range").agg(F.max("id").alias("top"))
    one = Window.partitionBy(F.lit(0)).orderBy("range")
    below = ends.select(F.col("range").alias("r"), F.lag("top").over(one).alias("below"), F.max("top").over(Window.partitionBy(F.lit(0))).alias("first"))
    inside = placed.withColumn("prev", F.lag("id").over(Window.partitionBy("range").orderBy("id")))
    return inside.join(F.broadcast(below), F.col("range") == F.col("r")).select("id", F.coalesce("prev", "below", "first").alias("next_id"))


def edited_pairs(docs: DataFrame, radius: int = 3, every: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (the last third replaced by the start of the next document), and the search.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near); the next document is
    that of ``next_ids``, by its smallest start where an id repeats; a row without an id follows itself. n_near is the search's
    result for the rows whose id (or its hash, if it is no number) is divisible by ``every``, else null: how many other distinct fingerprints of all texts are
    within ``radius`` bits of theirs.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed, lone = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    order = next_ids(placed.select(F.col("doc_id").alias("id")))
    need = placed.groupBy("doc_id").agg(F.max(F.expr("length(text) div 3")).alias("need"))
    # the exchange of the texts by id serves as source of the starts and as the texts they go to
    source = placed.select(F.col("doc_id").alias("src"), F.col("text").alias("src_text"))
    heads = order.join(need, F.col("id") == F.col("doc_id")).join(source, F.col("next_id") == F.col("src")).select(F.col("id").alias("of"), "next_id", F.expr("substring(src_text, 1, cast(need AS int))").alias("head"))
    heads = heads.groupBy("of", "next_id").agg(F.min("head").alias("head"))
    same = Window.partitionBy("doc_id").orderBy("text")  # a computed order would change the exchange
    both = placed.withColumn("nth", F.row_number().over(same).cast("long")).join(heads, F.col("doc_id") == F.col("of"))
    # rows without an id meet nothing, so they only need a number each and stay where they are
    none = lone.withColumn("nth", F.monotonically_increasing_id()).withColumn("next_id", F.col("doc_id")).withColumn("head", F.col("text"))
    facts = ["doc_id", "nth", "next_id", "n_chars", "edited_sha256"]

    def printed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("n_chars", F.length("text"))
        rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 3), substring(head, 1, n_chars div 3))"))
        two = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*facts, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("text")))).alias("x")).select(*facts, "x.v", "x.text")
        return fingerprints(two, [*facts, "v"])

    prints = printed(both).unionByName(printed(none))
    pick = lambda c, v: F.max(F.when(F.col("v") == v, F.col(c)))
    wide = cut(prints.groupBy(*facts).agg(pick("f1", 0).alias("f1"), pick("f2", 0).alias("f2"), pick("f1", 1).alias("e1"), pick("f2", 1).alias("e2")))
    after = wide.filter("nth = 1 and doc_id is not null").select(F.col("doc_id").alias("after"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    number = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, NumericType) else F.xxhash64("doc_id")
    asks = F.coalesce(number % every == 0, F.lit(False))
    found = within_radius(wide.filter(asks), wide, radius).groupBy("q1", "q2").agg(F.count("*").alias("n_near"))
    near = wide.filter(asks).select("doc_id", "nth", "f1", "f2").join(found, (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left").select(F.col("doc_id").alias("near_id"), F.col("nth").alias("near_nth"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    out = wide.join(after, F.col("next_id") == F.col("after"), "left").join(near, (F.col("doc_id") == F.col("near_id")) & (F.col("nth") == F.col("near_nth")), "left")
    f1, f2 = F.col("f1"), F.col("f2")
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text("f1", "f2").alias("fingerprint"),
        as_text("e1", "e2").alias("edited_fingerprint"),
        likeness(f1, f2, F.col("e1"), F.col("e2")).alias("near_edited"),
        likeness(f1, f2, F.coalesce("n1", "f1"), F.coalesce("n2", "f2")).alias("near_next"),
        "n_near",
    )
