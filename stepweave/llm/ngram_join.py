"""N-gram Jaccard join by universe partitioning, exact.

A text's set is its distinct 5-word shingles (64-bit hashes). Two sets of sizes r and s with Jaccard of 0.8 or more differ
in at most H = floor((r + s) / 9) shingles.

* Size bands double: band b holds sizes 2**b up to 2**(b+1) - 1. A set is indexed in its own band, and in the next if a set of
  that band can link with it (role "up"); two sets meet in the larger one's band and nowhere else.
* The band's universe of shingles is hashed into M segments. At most H segments of a pair differ, so pairs share
  segment subsets; each non-empty subset gives one signature.
* Allocation by cost: an empty segment gets 0 (it would pair everything), as does one whose signature turns out to be hot; a
  non-empty one gets 1. In bands of small sets, where it costs few rows, segments are larger and get 2: their one-deletion
  neighbourhoods are indexed too. A set whose allocations don't exceed H also indexes each shingle alone.
* Contraction: in each signature's group a first set is the hub. Each set is verified against the one hub it shares by far
  the most with, and connected components of those links are single nodes from then on; a group of thousands of near
  copies shrinks to one node with as many verifications as it has members.
* Groups of at most COMMON sets give pairs of different components, counted: with c allocations left after the hot ones, a
  linked pair shares at least c - H of them, which removes most pairs that merely share a passage. The rest is verified.
* Groups of more sets are hot if they hold several components. Sets that lost so many allocations to hot groups that c <= H
  form families: a hot group's hub is its set with the most hot signatures, and a family is all such sets of the groups of
  one hub. Families are cut into blocks, and each pair of blocks is one small task that compares differences from the
  block's majority set and returns a spanning forest of the links between components, never the pairs.

Equal sets are handled once: a set is known by a 63-bit sum of its shingles' hashes, and sets that share one (told apart by a second,
independent sum) are renamed by the second before anything else. Links are verified on shingle hashes of 64 bits within a
pair. Within one family work grows with the square of its sets, in tasks of at most BLOCK_SETS sets a side.

Defined cases: empty texts and texts without words (null too) have empty sets, linked with nothing. Rows that repeat a doc_id, with equal
or different texts, are documents of their own with a result row each; rows without an id link like others, and where
all rows of a component lack one, component_id is null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stepweave.llm.components import components
from stepweave.llm.names import number_of, numbered
from stepweave.llm.textbytes import column_bytes, mix, shingles, slices
from stepweave.session import cut, discard

LOAD, SMALL, COMMON = 3, 5, 16  # shingles a segment at the band's top; bands below SMALL have deletions; sets of a cold group
BLOCK_SETS, BLOCK_BYTES = 1024, 1 << 22  # of a family's blocks
MAX_RENAMED = 100_000  # set ids that several sets share
HUB_PAIRS, MAX_HUBS = 512, 10_000  # pairs of an id in one place; ids that are dealt to several
_U = np.uint64


def segments(band: np.ndarray) -> np.ndarray:
    """Segments of each band's universe."""
    top = 2 << band.astype(np.int64)
    return np.where(band < SMALL, np.maximum(top // 4, 2), top // LOAD)


def _sums(h: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """Even sums of hashes of each set's shingles."""
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h ^ _U(salt)), out=total[1:])
    end = np.cumsum(n)
    return mix((total[end] - total[end - n]) ^ n.astype(_U)) & ~_U(1)


def _sets(raw: np.ndarray, off: np.ndarray, renamed: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the shingles, and (size, id, second id) of the sets; ids are even, and equal for equal sets.

    A first sum, of which ``width`` bits count, is the id unless it is one of ``renamed``; the second is then.
    """
    row, h = shingles(raw, off)
    n = np.bincount(row, minlength=len(off) - 1)
    ids, twin = _sums(h, n, 0xA5A5A5A5), _sums(h, n, 0x5A17C0DE5EED)
    if width < 64:
        ids &= _U((1 << width) - 1)
    if len(renamed):
        ids = np.where(np.isin(ids, renamed), twin, ids)
    return row, h, n, ids, twin


def _index(row: np.ndarray, h: np.ndarray, n: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (row, value) in one role, and for each text its allocations and those that count in pairs (0: none do)."""
    own = np.zeros(len(n), np.int64)
    own[n > 0] = np.frexp(n[n > 0].astype(float))[1] - 1
    band = own + up
    here = (n > 0) & ((n * 5 // 4 >= 2 << own) if up else True)
    keep = here[row]
    row, h = row[keep], h[keep]
    m = segments(band)
    seg = ((h >> _U(32)) % m[row].astype(_U)).astype(np.int64)
    order = np.argsort((row << 32) | seg, kind="stable")
    row, h, seg = row[order], h[order], seg[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
    at = np.flatnonzero(first)
    member = mix(h * _U(3) + _U(1))
    total = np.add.reduceat(member, at) if len(at) else member
    salt = mix((band[row].astype(_U) << _U(40)) + seg.astype(_U))
    size = np.diff(np.append(at, len(h)))
    rows, values = [row[at]], [mix(total ^ salt[at])]
    small = band < SMALL
    gives = np.where(small[row[at]], np.minimum(size, 2), 1)
    part = np.repeat(np.arange(len(at)), size)
    fewer = small[row] & (size[part] > 1)  # one-deletion neighbourhoods
    rows.append(row[fewer])
    values.append(mix((total[part[fewer]] - member[fewer]) ^ salt[fewer]))
    alloc = np.bincount(row[at], gives, len(n)).astype(np.int64)
    partner = np.minimum(n * 5 // 4, (2 << own) - 1) if not up else n * 5 // 4
    short = here & (alloc <= (n + partner) // 9)
    alone = short[row]
    rows.append(row[alone])
    values.append(mix(member[alone] ^ mix(band[row[alone]].astype(_U) + _U(1 << 50))))
    return np.concatenate(rows), np.concatenate(values), np.where(here, alloc, 0), np.where(here & ~small & ~short, alloc, 0)


def set_table(docs: DataFrame, renamed: np.ndarray, width: int = 64) -> DataFrame:
    """(doc_id, id, twin, n, and for the roles own and up: alloc, counts), a row for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            for i, j in slices(off):
                row, h, n, ids, twin = _sets(raw, off[i : j + 1], renamed, width)
                roles = [x for up in (False, True) for x in _index(row, h, n, up)[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids.view(np.int64)), pa.array(twin.view(np.int64)), pa.array(n.astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in roles)], ["doc_id", "id", "twin", "n", "alloc", "counts", "alloc_up", "counts_up"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, id long, twin long, n int, alloc int, counts int, alloc_up int, counts_up int")


def distinct_sets(docs: DataFrame, width: int = 64) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The set of each row, the distinct sets (id, rep: smallest doc_id, ...), both written, and the renamed ids."""
    info, renamed = cut(set_table(docs, np.zeros(0, _U), width)), np.zeros(0, _U)
    for again in (False, True):
        sets = cut(info.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"), F.min("twin").alias("low"), F.max("twin").alias("high"), *(F.min(c).alias(c) for c in ("n", "alloc", "counts", "alloc_up", "counts_up"))))
        clash = sets.filter("low <> high").select("id").limit(MAX_RENAMED + 1).collect()
        if not clash:
            break
        if again or len(clash) > MAX_RENAMED:
            raise ValueError(f"{len(clash)} set ids are shared by different sets")
        renamed = np.array([r["id"] for r in clash], np.int64).view(_U)
        discard(info, sets)
        info = cut(set_table(docs, renamed, width))
    return info.drop("twin"), sets.drop("low", "high"), renamed


def signatures(docs: DataFrame, renamed: np.ndarray, width: int = 64) -> DataFrame:
    """(sig, key): key is the set's id, plus 1 in the role up. Equal sets of a task are indexed once, while few are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            for i, j in slices(off):
                row, h, n, ids, _ = _sets(raw, off[i : j + 1], renamed, width)
                fresh = np.ones(len(n), bool)
                for k, x in enumerate(ids.tolist()):
                    if x in seen:
                        fresh[k] = False
                    elif len(seen) < 200_000:
                        seen.add(x)
                row, h = row[fresh[row]], h[fresh[row]]
                for up in (False, True):
                    at, value, _, _ = _index(row, h, np.where(fresh, n, 0), up)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array((ids[at] | _U(up)).view(np.int64))], ["sig", "key"])

    return docs.select("text").mapInArrow(run, "sig long, key long")


def _runs(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, bool]]:
    """Groups of rows sorted by the first column, as (group column, other columns, sizes, hot).

    Cold groups come whole, many at a time, and are those of at most ``most`` rows. Rows of hot groups come as they
    arrive, so memory doesn't grow with a group; each piece has the group's first row before it.
    """
    hold = [np.zeros(0, np.int64) for _ in range(width)]
    burning = False  # hold begins with the first row of a hot group, already sent
    for batch in _ended(batches):
        if batch is not None:
            hold = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(hold)]
        if not len(hold[0]):
            continue
        start = np.flatnonzero(np.append(True, hold[0][1:] != hold[0][:-1]))
        size = np.diff(np.append(start, len(hold[0])))
        done = np.ones(len(start), bool)
        done[-1] = batch is None
        hot = size > most
        hot[0] |= burning
        for k in np.flatnonzero(hot):
            part = slice(start[k], start[k] + size[k])
            if not (burning and k == 0 and size[k] == 1):
                yield hold[0][part], [h[part] for h in hold[1:]], size[k : k + 1], True
        cold = np.repeat(done & ~hot, size)
        if cold.any():
            yield hold[0][cold], [h[cold] for h in hold[1:]], size[done & ~hot], False
        burning = bool(hot[-1])
        if batch is not None:
            wait = slice(start[-1], start[-1] + 1) if burning else slice(start[-1], None)
            hold = [h[wait] for h in hold]


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _shared(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, key) to (sig, key, hub): groups of two or more sets; the hub is the first key in its own band, else null."""
    last = (None, None)
    for sig, (key,), size, hot in _runs(batches, 2, most):
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        at = np.repeat(np.arange(len(size)), size)
        if hot:  # a piece of one group: its first row may be an old one, its hub an earlier key
            if last[0] == sig[0]:
                hub = last[1]
                new[0] = False
            else:
                own = np.flatnonzero(key & 1 == 0)
                hub = key[own[0]] if len(own) else None
            if hub is None and (key & 1 == 0).any():
                hub = key[np.flatnonzero(key & 1 == 0)[0]]
            last = (sig[0], hub)
            hubs = np.full(len(key), hub if hub is not None else 1, np.int64)
        else:
            count = np.bincount(at[new], minlength=len(size))
            new &= count[at] > 1
            own = np.flatnonzero(new & (key & 1 == 0))
            first = np.ones(len(size), np.int64)
            first[at[own[::-1]]] = key[own[::-1]]
            hubs = first[at]
        if new.any():
            hub = pa.array(hubs[new], mask=hubs[new] & 1 == 1)
            yield pa.RecordBatch.from_arrays([pa.array(sig[new]), pa.array(key[new]), hub], ["sig", "key", "hub"])


def _pairs(batches: Iterator[pa.RecordBatch], common: int) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, key, label) to pairs (hot false, a, b) of cold groups across labels and rows (hot true, sig, key, label)."""
    names = ["hot", "a", "b", "label"]
    sent = None
    for sig, (key, label), size, hot in _runs(batches, 3, common):
        if hot:
            rows = slice(1 if sent == sig[0] else 0, None)
            sent = sig[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sig[rows]), bool)), pa.array(sig[rows]), pa.array(key[rows]), pa.array(label[rows])], names)
            continue
        start = np.cumsum(size) - size
        left, right = [], []
        for k in np.unique(size[size > 1]):
            table = start[size == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            left.append(table[:, i].ravel())
            right.append(table[:, j].ravel())
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            meet = (label[i] != label[j]) & (key[i] & key[j] & 1 == 0)  # two of role up meet in their own band
            i, j = i[meet], j[meet]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(i), bool)), pa.array(key[i]), pa.array(key[j]), pa.nulls(len(i), pa.int64())], names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) whose shingle sets have 100 * intersection >= 80 * union."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            sides = []
            for k in (2, 3):
                raw, off = column_bytes(part.column(k))
                row, h = shingles(raw, off)
                sides.append((h, np.searchsorted(row, np.arange(part.num_rows + 1))))
            (ha, ia), (hb, ib) = sides
            good = np.zeros(part.num_rows, bool)
            for k in range(part.num_rows):
                x, y = ha[ia[k] : ia[k + 1]], hb[ib[k] : ib[k + 1]]
                if len(x) and len(y) and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = 100 * both >= 80 * (len(x) + len(y) - both)
            yield part.select([0, 1]).filter(pa.array(good))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts link. The exchange of the texts serves both joins.

    An id of more than HUB_PAIRS pairs gets salts: its text is sent once a salt and its pairs are dealt to them. The MAX_HUBS largest ones are
    broadcast by id; any other has less than 1 / MAX_HUBS of all pairs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = cut(pairs.select("a", "b"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("hub"), F.lit(0).alias("side")), F.struct(F.col("b").alias("hub"), F.lit(1).alias("side")))).alias("x")).select("x.*")
    large = ends.groupBy("hub", "side").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max("n").alias("n")).filter(F.col("n") > HUB_PAIRS)
    large = cut(large.orderBy(F.desc("n"), "hub").limit(MAX_HUBS).select("hub", F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("salts")))
    known = lambda rows, key: rows.join(F.broadcast(large), F.col(key) == F.col("hub"), "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop("hub")
    texts = known(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), "text")
    out = pairs
    for side in ("a", "b"):
        dealt = known(out, side).withColumn(f"salt_{side}", F.expr("cast(pmod(xxhash64(a, b), salts) AS int)")).drop("salts")
        out = dealt.join(texts.select(F.col("doc_id").alias(side), F.col("salt").alias(f"salt_{side}"), F.col("text").alias(f"text_{side}")), [side, f"salt_{side}"])
    return out.select("a", "b", "text_a", "text_b").mapInArrow(_verify, f"a {kind}, b {kind}")


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, text) to (rep, set): the sorted hashes as bytes."""
    for batch in batches:
        raw, off = column_bytes(batch.column(1))
        for i, j in slices(off):
            row, h = shingles(raw, off[i : j + 1])
            end = np.searchsorted(row, np.arange(j - i + 1))
            packed = [h[x:y].tobytes() for x, y in zip(end, end[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary())], ["rep", "set"])


def _forest(block: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest (a, b) of the links between different labels among the sets of one pair of blocks."""
    tokens = [np.frombuffer(x, _U) for x in block["set"]]
    m, n = len(tokens), np.array([len(t) for t in tokens])
    owner = np.repeat(np.arange(m), n)
    _, token, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    base = often * 2 > m  # the majority set; what counts is how each set differs from it
    there = np.bincount(owner[base[token]], minlength=m)
    apart = n + base.sum() - 2 * there
    shared = np.zeros((m, m), np.float32)
    useful = np.flatnonzero(np.where(base, m - often, often) >= 2)
    column = np.full(len(often), -1)
    column[useful] = np.arange(len(useful))
    at = column[token]
    for lo in range(0, len(useful), 2048):
        part = slice(lo, lo + 2048)
        bits = np.repeat(base[useful[part]][None, :], m, 0).astype(np.float32)
        here = (at >= lo) & (at < lo + 2048)
        bits[owner[here], at[here] - lo] = ~base[token[here]]
        shared += bits @ bits.T
    differ = apart[:, None] + apart[None, :] - 2 * shared
    label, part = block["label"].to_numpy(), block["block"].to_numpy()
    link = (9 * differ <= n[:, None] + n[None, :]) & (label[:, None] != label[None, :])
    if (part != part[0]).any():
        link &= part[:, None] != part[None, :]
    rep, a, b = block["rep"].to_numpy(), [], []
    open_ = link.any(1)
    for root in range(m):
        if not open_[root]:
            continue
        open_[root], stack = False, [root]
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(link[x] & open_):
                open_[y] = False
                stack.append(y)
                a.append(rep[x])
                b.append(rep[y])
    return pd.DataFrame({"a": a, "b": b}).astype({"a": block["rep"].dtype, "b": block["rep"].dtype})


def _family_links(family: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between labels within families (hub, rep, label, n), enough to connect all that are connected."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    reps = family.select("rep").distinct()
    sets = cut(docs.join(reps, docs["doc_id"] == reps["rep"]).select("rep", "text").mapInArrow(_set_bytes, f"rep {kind}, set binary").dropDuplicates(["rep"]))
    sizes = family.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = family.join(sizes, "hub").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    placed = rows.select("hub", "lo", "hi", "block", "rep", "label").join(sets, "rep")
    found = cut(placed.groupBy("hub", "lo", "hi").applyInPandas(_forest, f"a {kind}, b {kind}").distinct())
    discard(sets)
    return found


def _roles(sets: DataFrame) -> DataFrame:
    """(key, rep, n, alloc, counts, weight, reach): a row for each role of each set; reach is the H of its largest partner."""
    each = lambda up: F.struct((F.col("id") + int(up)).alias("key"), F.col("alloc_up" if up else "alloc").alias("alloc"), F.col("counts_up" if up else "counts").alias("counts"), F.lit(int(up)).alias("up"))
    rows = sets.select("rep", "n", F.explode(F.array(each(False), each(True))).alias("r")).select("rep", "n", "r.*").filter("alloc > 0")
    band = F.floor(F.log2(F.col("n") + F.lit(0.5)))
    partner = F.floor(F.col("n") * 5 / 4)
    partner = F.when(F.col("up") == 1, partner).otherwise(F.least(partner, F.pow(F.lit(2), band + 1) - 1))
    return rows.select("key", "rep", "n", "alloc", "counts", F.when(band + F.col("up") < SMALL, 2).otherwise(1).alias("weight"), F.floor((F.col("n") + partner) / 9).alias("reach"))


def _components(docs: DataFrame, common: int, width: int) -> DataFrame:
    """(doc_id, n, component) of ``docs`` (doc_id, text), where no doc_id is null or repeated; component is null for empty sets."""
    info, sets, renamed = distinct_sets(docs, width)
    roles = cut(_roles(sets))
    side = lambda k, *cols: roles.select(F.col("key").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    alike = F.expr("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    by_rep = lambda pairs: pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).filter("a < b").distinct()

    # every signature moves once; what is kept are the few that two sets share
    group = cut(signatures(docs, renamed, width).repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_shared, "sig long, key long, hub long"))

    # contraction: the hub that a set shares most with, if that is at least half of what a link would need
    star = group.filter("hub <> key").groupBy("key", "hub").agg(F.count("*").alias("shared")).groupBy("key").agg(F.max(F.struct("shared", "hub")).alias("best"))
    star = star.select(F.col("key").alias("a"), F.col("best.hub").alias("b"), F.col("best.shared").alias("shared")).join(side("a", "rep", "n", "counts"), "a").join(side("b", "rep", "n", "counts"), "b")
    links = cut(verified(by_rep(star.filter(alike & F.expr("2 * shared >= greatest(counts_a, counts_b) - floor((n_a + n_b) / 9)"))), docs))
    labels = components(links)
    named = sets.join(labels, sets["rep"] == labels["node"]).select(F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("k"), F.xxhash64("component").alias("own"))

    # pairs of different components within common groups; rows of the others
    spread = group.join(named, group["key"] == named["k"], "left").select("sig", "key", F.coalesce("own", F.xxhash64(F.shiftright("key", 1), F.lit("set"))).alias("label"))
    found = cut(spread.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(lambda rows: _pairs(rows, common), "hot boolean, a long, b long, label long").groupBy("hot", "a", "b").agg(F.count("*").alias("shared"), F.min("label").alias("label")))
    discard(group)
    hot = found.filter("hot").select(F.col("a").alias("sig"), F.col("b").alias("key"), "label")
    mixed = hot.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
    lost = cut(hot.join(mixed, "sig", "left_semi").groupBy("key").agg(F.count("*").alias("lost"), F.min("label").alias("label")))
    spare = lambda k: side(k, "rep", "n", "counts").join(lost.select(F.col("key").alias(k), F.col("lost").alias(f"lost_{k}")), k, "left").na.fill(0, [f"lost_{k}"])
    cold = found.filter("not hot").join(spare("a"), "a").join(spare("b"), "b")
    pairs = by_rep(cold.filter(alike & F.expr("shared >= greatest(counts_a - lost_a, counts_b - lost_b) - floor((n_a + n_b) / 9)")))
    more = cut(verified(pairs, docs))
    heavy = lost.join(roles, "key").filter("alloc - weight * lost <= reach").select("key", "lost", "rep", "n")
    held = cut(hot.join(mixed, "sig", "left_semi").join(heavy, "key").select("sig", "rep", "n", "label", "lost"))
    discard(found, lost, roles)
    links = links.union(more)
    if not held.isEmpty():
        hubs = held.groupBy("sig").agg(F.max_by("rep", F.struct("lost", F.xxhash64("rep"))).alias("hub"), F.count("*").alias("k")).filter("k > 1").select("sig", "hub")
        links = links.union(_family_links(held.join(hubs, "sig").select("hub", "rep", "label", "n").distinct(), docs))
    labels = components(links)
    of = sets.join(labels, sets["rep"] == labels["node"], "left").select(F.col("id").alias("_id"), F.coalesce("component", "rep").alias("component"))
    return info.join(of, (info["id"] == of["_id"]) & (info["n"] > 0), "left").select("doc_id", "n", "component")


def _distinct_ids(docs: DataFrame) -> bool:
    """Whether no doc_id of ``docs`` is null or repeated."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()


def _numbered(docs: DataFrame, common: int, width: int) -> DataFrame:
    """(row, n, component): classes of rows that are numbered because ids don't name them; ``docs`` is a written (row, text)."""
    return _components(docs.select(F.col("row").alias("doc_id"), "text"), common, width).withColumnRenamed("doc_id", "row")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", common: int = COMMON, width: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``; a document without links is its own component."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if _distinct_ids(docs):
        return _components(docs, common, width).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    found = cut(_numbered(docs, common, width))
    named = found.join(docs.select("row", "doc_id"), "row")
    low = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("low"))
    out = named.join(low, "component", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged: the one with the smallest id, null being the largest.

    Rows go by number where ids repeat or are null, so no row takes another with it.
    """
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if _distinct_ids(lean):
        named, key = numbered(docs), number_of(docs, doc_id)
        gone = _components(lean, common, 64).filter("doc_id <> component").select(F.col("doc_id").alias("gone"))
        return named.join(gone, F.col(key) == F.col("gone"), "left_anti").toDF(*docs.columns)
    named, key, words = cut(numbered(docs).withColumn("row", F.monotonically_increasing_id())), number_of(docs, doc_id), number_of(docs, text)
    rows = named.select("row", F.col(key).alias("doc_id"), F.col(words).alias("text"))
    found = cut(_numbered(rows, common, 64)).filter("component IS NOT NULL")
    first = found.join(rows.select("row", "doc_id"), "row").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = found.join(first, "component").filter("row <> first.row").select(F.col("row").alias("gone"))
    return named.join(gone, F.col("row") == F.col("gone"), "left_anti").drop("row").toDF(*docs.columns)
