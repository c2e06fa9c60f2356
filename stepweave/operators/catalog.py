"""Joins, rankings and roll-ups over a parts catalog, and vector matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.functions import scalars as s
from stepweave.operators import nearest
from stepweave.session import cut


def latest_inventory(inventories: DataFrame) -> DataFrame:
    """The inventory of each set with the highest version, then id; combines on the map side."""
    best = inventories.groupBy("set_num").agg(F.max(F.struct("version", "inventory_id")).alias("best"))
    return best.select("set_num", F.col("best.inventory_id").alias("inventory_id"))


def required_quantities(inventories: DataFrame, requirements: DataFrame) -> DataFrame:
    """Required quantity of each (set, part, colour) of the latest inventory."""
    return requirements.join(latest_inventory(inventories), "inventory_id").groupBy("set_num", "part_num", "color_id").agg(F.sum("quantity").alias("qty")).filter("qty > 0")


def set_requirements(inventories: DataFrame, requirements: DataFrame, elements: DataFrame, images: DataFrame, colors: DataFrame) -> DataFrame:
    """Required quantity of each (set, part, colour) of the latest inventory, with element, image and colour.

    Dimensions are reduced to one row a key before they are joined, so no join multiplies rows.
    """
    qty = required_quantities(inventories, requirements)
    element = elements.groupBy("part_num", "color_id").agg(F.min("element_id").alias("element_id"))
    image = images.groupBy("part_num", "color_id").agg(F.min("img_url").alias("img_url"))
    color = colors.groupBy("color_id").agg(F.min(F.struct("name", "rgb")).alias("c")).select("color_id", F.col("c.name").alias("color_name"), F.col("c.rgb").alias("rgb"))
    out = qty.join(element, ["part_num", "color_id"], "left").join(image, ["part_num", "color_id"], "left").join(color, "color_id", "left")
    return out.withColumn("needs_image", F.col("img_url").isNull())


def part_library(requirements: DataFrame, elements: DataFrame, images: DataFrame, colors: DataFrame) -> DataFrame:
    """The distinct (part, colour) pairs with image, element and colour maps; one equi join for each."""
    pairs = requirements.groupBy("part_num", "color_id").agg(F.sum("quantity").alias("qty"), F.countDistinct("inventory_id").alias("sets"))
    element = elements.groupBy("part_num", "color_id").agg(F.min("element_id").alias("element_id"))
    image = images.groupBy("part_num", "color_id").agg(F.min("img_url").alias("img_url"))
    return pairs.join(element, ["part_num", "color_id"], "left").join(image, ["part_num", "color_id"], "left").join(colors.select("color_id", "rgb"), "color_id", "left")


def element_lookup(asked: DataFrame, elements: DataFrame, requirements: DataFrame, inventories: DataFrame, fallback: DataFrame) -> DataFrame:
    """(set_num, element_id) to part, colour, quantity: an inventory row of the set, the largest quantity first.

    An element that no inventory has gives its part without a quantity; one found only in other sets falls to ``fallback``
    (element_id, part_num, color_id, quantity), as does an unknown one.
    """
    rows = requirements.select("inventory_id", "part_num", "color_id", "quantity").join(inventories.select("inventory_id", F.col("set_num").alias("in_set")), "inventory_id", "left")
    listed = elements.select("element_id", "part_num", "color_id").join(rows, ["part_num", "color_id"], "left")
    hit = F.max_by(F.struct("part_num", "color_id", "quantity"), F.struct("quantity", "inventory_id"))
    best = cut(listed.groupBy(F.col("in_set").alias("set_num"), "element_id").agg(hit.alias("hit")))  # one row for each set that lists an element, and one with a null set
    own, loose = best.filter("set_num IS NOT NULL"), best.filter("set_num IS NULL").select("element_id", F.col("hit").alias("loose"))
    key, other = ["set_num", "element_id"], fallback.select("element_id", F.struct("part_num", "color_id", "quantity").alias("other"))
    # only what its set doesn't list meets the rest
    missed = asked.join(own, key, "left_anti").join(loose, "element_id", "left").join(other, "element_id", "left")
    found = asked.join(own, key).select(*key, "hit").unionByName(missed.select(*key, F.coalesce(F.when(F.col("set_num").isNotNull(), F.col("loose")), "other").alias("hit")))
    return found.select(*key, "hit.part_num", "hit.color_id", "hit.quantity")


def set_pairs(sets: DataFrame, set_parts: DataFrame, inventories: DataFrame, requirements: DataFrame, spare: str) -> DataFrame:
    """(part, colour) pairs of each set: its own list, else its latest inventory without rows where ``spare`` holds."""
    listed = set_parts.join(sets, "set_num", "left_semi").select("set_num", "part_num", "color_id").distinct()
    rest = sets.join(set_parts, "set_num", "left_anti")
    built = latest_inventory(inventories).join(rest, "set_num", "left_semi").join(requirements.filter(~F.expr(spare)), "inventory_id").select("set_num", "part_num", "color_id").distinct()
    return listed.union(built)


def assigned_qty(rows: DataFrame) -> DataFrame:
    """Assigned quantity of each part and colour; null and 0 count as 1."""
    return rows.groupBy("part_num", "color_id").agg(F.sum(F.coalesce(F.nullif("qty", F.lit(0)), F.lit(1))).alias("assigned"))


def confirmed_totals(examples: DataFrame) -> DataFrame:
    """Confirmed quantity (1 where not positive) and rows of each part and colour."""
    return examples.groupBy("part_num", "color_id").agg(F.sum(F.when(F.col("qty") > 0, F.col("qty")).otherwise(1)).alias("total"), F.count("*").alias("n"))


def confirmed_usage(required: DataFrame, examples: DataFrame) -> DataFrame:
    """Required against confirmed quantity: what remains and what is over."""
    used = confirmed_totals(examples)
    rows = required.groupBy("part_num", "color_id").agg(F.sum("quantity").alias("required")).join(used, ["part_num", "color_id"], "left").na.fill(0, ["total", "n"])
    over = F.col("total") - F.col("required")
    return rows.withColumn("remaining", F.greatest(-over, F.lit(0))).withColumn("over", F.greatest(over, F.lit(0)))


def pool_max_qty(parts: DataFrame) -> DataFrame:
    """For each part and colour the largest quantity."""
    return parts.groupBy("part_num", "color_id").agg(F.max("quantity").alias("quantity"))


def context_counts(required: DataFrame) -> DataFrame:
    """Rows, total quantity and rows without an image."""
    return required.agg(F.count("*").alias("parts"), F.sum("qty").alias("total"), F.count_if(F.col("img_url").isNull()).alias("without_image"))


def _channels(asked: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and r, g, b of the rows whose rgb array has all three."""
    return asked.select(*columns, *(F.get("rgb", F.lit(i)).cast("int").alias(c) for i, c in enumerate("rgb"))).dropna(subset=["r", "g", "b"])


def _nearest_of_channels(parts: DataFrame, colors: DataFrame, k: int, per_cell: float | None = None) -> DataFrame:
    """(r, g, b, rank, color_id, distance) of the distinct colours of ``parts``."""
    palette = colors.groupBy("rgb").agg(F.min("color_id").alias("color_id")).select("color_id", s.hex_rgb(F.col("rgb")).alias("c")).filter("c IS NOT NULL")
    return nearest.nearest_palette(parts.select("r", "g", "b").distinct(), palette, k, per_cell)[0]


def nearest_colours(asked: DataFrame, colors: DataFrame, k: int = 6, per_cell: float | None = None) -> DataFrame:
    """The ``k`` nearest colours of each (query, rgb array), of a palette of any size; ties go to the lower colour.

    Distinct asked colours visit rings of cells of the RGB cube, see ``nearest.nearest_palette``.
    """
    parts = _channels(asked, "query")
    return parts.join(_nearest_of_channels(parts, colors, k, per_cell), ["r", "g", "b"]).select("query", "rank", "color_id", "distance")


def colour_top5(asked: DataFrame, colors: DataFrame) -> DataFrame:
    """The five best colours by 1 / (1 + distance)."""
    return nearest_colours(asked, colors, 5).select("query", "rank", "color_id", (1 / (1 + F.col("distance"))).alias("score"))


def rgb_match(segments: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """Candidates of each segment (set_num, segment, rgb, density) among its own set's pool (set_num, part_num, color_id, rgb).

    Score .92 colour + .08 density, rounded half up to 4 places; ties keep part and colour order. An equi join by set.
    """
    best = pool.groupBy("set_num", "part_num", "color_id").agg(F.max(F.struct("qty", "rgb")).alias("b")).select("set_num", "part_num", "color_id", s.hex_rgb(F.col("b.rgb")).alias("pool_rgb")).filter("pool_rgb IS NOT NULL")
    density = F.when(F.col("density") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("density") - 0.55)))).otherwise(0.5)
    rows = segments.filter("rgb IS NOT NULL").join(best, "set_num").withColumn("score", F.round(0.92 * s.rgb_similarity(s.rgb_distance(F.col("rgb"), F.col("pool_rgb"))) + 0.08 * density, 4))
    w = Window.partitionBy("set_num", "segment").orderBy(F.desc("score"), "part_num", "color_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("set_num", "segment", "rank", "part_num", "color_id", "score")


def knn_same_attr(queries: DataFrame, catalog: DataFrame, k: int = 10, cell_rows: int = nearest.CELL_ROWS) -> DataFrame:
    """Cosine neighbours with the query's attribute; all of the catalog only for attributes it lacks.

    ``queries`` and ``catalog``: (vec_id, embedding, label). A vector isn't a candidate for itself. Exact, see ``nearest.nearest_unit``.
    """
    return nearest.nearest_unit(nearest.unit_rows(queries, "vec_id", "label"), nearest.unit_rows(catalog, "vec_id", "label"), k, cell_rows)[0]


def memory_score(queries: DataFrame, memory: DataFrame, least: float = 0.8, cell_rows: int = nearest.CELL_ROWS) -> DataFrame:
    """Best cosine of each query and element over the element's vectors, from ``least`` up. Exact, see ``nearest.best_by_label``."""
    best, _ = nearest.best_by_label(nearest.unit_rows(queries, "vec_id", None), nearest.unit_rows(memory, "vec_id", "element_id"), least, cell_rows)
    return best.withColumnRenamed("label", "element")


def confirmed_memory(labels: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with their unit vectors, labels without one); all occurrences of an element are kept."""
    unit = embeddings.select("element_id", s.l2_normalize(F.col("embedding")).alias("vector")).filter("vector IS NOT NULL")
    return labels.join(unit, "element_id"), labels.join(unit, "element_id", "left_anti")


def coverage_manifest(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """How many distinct elements have a vector, duplicates, and the share."""
    ids = labels.groupBy("element_id").agg(F.count("*").alias("n")).join(embeddings.select("element_id").distinct().withColumn("hit", F.lit(1)), "element_id", "left")
    return ids.agg(F.count("*").alias("elements"), F.count("hit").alias("matched"), F.sum(F.col("n") - 1).alias("duplicates"), (F.count("hit") / F.count("*")).alias("ratio"))


def coverage_ids(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each distinct element of the labels, and whether it has a vector: the lists of matched and unmatched ids as rows."""
    known = embeddings.select("element_id").distinct().withColumn("matched", F.lit(True))
    return labels.select("element_id").distinct().join(known, "element_id", "left").na.fill(False, ["matched"])


def confirm_rollup(examples: DataFrame) -> DataFrame:
    """Per element the first part and colour by time, count, and distinct bundles and reviewers in first-seen order."""
    rows = examples.groupBy("part_num").agg(F.min_by("color_id", F.struct("ts", "event_id")).alias("color_id"), F.count("*").alias("n"))
    for one, many in (("bundle", "bundles"), ("reviewer", "reviewers")):
        if one in examples.columns:
            seen = examples.groupBy("part_num", one).agg(F.min(F.struct("ts", "event_id")).alias("first"))
            rows = rows.join(seen.groupBy("part_num").agg(F.array_sort(F.collect_list(F.struct("first", one))).getField(one).alias(many)), "part_num")
    return rows


def topk_accuracy(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries with a right candidate (``right`` true) among the first k."""
    best = hits.groupBy("query").agg(F.min(F.when(F.col("right"), F.col("rank"))).alias("rank"))
    return best.agg(F.count("*").alias("queries"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks))


def expected_coverage(expected: DataFrame, pool: DataFrame) -> DataFrame:
    """Expected (part, colour) pairs, with whether the pool has them."""
    pairs = pool.select("part_num", "color_id").distinct().withColumn("present", F.lit(True))
    return expected.select("part_num", "color_id").distinct().join(pairs, ["part_num", "color_id"], "left").na.fill(False, ["present"])


# fixed values: words in the names of metal colours
METAL = r"(?i)chrome|pearl|metal|silver|gold|drum"


def catalog_rank(asked: DataFrame, images: DataFrame, colors: DataFrame, pairs: DataFrame, stock: DataFrame, k: int = 20, most: int = 600, metallic: bool = False, hide_depleted: bool = False, similarity: DataFrame | None = None) -> DataFrame:
    """Candidates for each crop (query, set_num, rgb) among the images of its 6 nearest colours, first ``most`` by part.

    Score: colour distance, -60 in the set, -5 with an image, stock adjustment; with ``metallic`` -8 for a metal colour and 4 for any
    other; 25 times the image difference where ``similarity`` (query, part_num, color_id, difference), see ``images.image_differences``, has one. Smaller is
    better; ``hide_depleted`` leaves out what is used up. With enough candidates of the set (half of k, 3 at least) only
    those are listed. ``most`` and ``k`` are part of the rule.
    """
    rgb, pair = ["r", "g", "b"], ["part_num", "color_id"]
    crops, own_pairs, enough = _channels(asked, "query", "set_num"), pairs.select("set_num", *pair).distinct(), min(max(3, k // 2), k)
    listed = cut(_listed(crops, images, colors, stock, most))
    cost = F.col("distance") - F.when(F.col("own") == 1, 60.0).otherwise(0.0) - F.when(F.col("shown"), 5.0).otherwise(0.0) + s.stock_adjustment(F.col("remaining"), hide_depleted)
    if metallic:
        names = colors.groupBy("color_id").agg(F.min("name").alias("color_name"))
        listed = listed.join(names, "color_id", "left")
        cost = cost + F.when(F.coalesce(F.rlike("color_name", F.lit(METAL)), F.lit(False)), -8.0).otherwise(4.0)
    if similarity is not None:  # a score of its own for each crop and image: as many rows as ``similarity`` may have
        rows = crops.join(listed, rgb).join(own_pairs.withColumn("own", F.lit(1)), ["set_num", *pair], "left").join(similarity.select("query", *pair, "difference"), ["query", *pair], "left")
        rows = rows.withColumn("score", F.bround(cost + F.coalesce(F.col("difference") * 25.0, F.lit(0.0)), 3)).filter("score IS NOT NULL")
        by_query = Window.partitionBy("query")
        rows = rows.withColumn("owned", F.count("own").over(by_query)).filter((F.col("owned") < enough) | (F.col("own") == 1))
        return rows.withColumn("rank", F.row_number().over(by_query.orderBy("score", *pair))).filter(F.col("rank") <= k).select("query", "rank", *pair, "score")
    scored = lambda rows, own: rows.withColumn("own", F.lit(own)).withColumn("score", F.bround(cost, 3)).filter("score IS NOT NULL")
    hit = F.struct("score", *pair)
    # what any crop of a colour may list of other sets' images: k, and as many as its own images may take the place of
    place = F.row_number().over(Window.partitionBy(*rgb).orderBy("score", *pair))
    best = scored(listed, 0).withColumn("place", place).filter(F.col("place") <= k + enough - 1).groupBy(*rgb).agg(F.collect_list(hit).alias("best"))
    mine = scored(crops.join(own_pairs, "set_num").join(listed, [*rgb, *pair]), 1).groupBy("query").agg(F.collect_list(hit).alias("mine"))
    met = crops.join(mine, "query", "left").join(best, rgb, "left").withColumn("mine", F.coalesce("mine", F.array().cast(mine.schema["mine"].dataType)))
    others = F.filter("best", lambda b: ~F.exists("mine", lambda m: (m["part_num"] == b["part_num"]) & (m["color_id"] == b["color_id"])))
    ranked = F.slice(F.array_sort(F.when(F.size("mine") < enough, F.concat("mine", others)).otherwise(F.col("mine"))), 1, k)
    return met.select("query", F.posexplode(ranked).alias("nth", "hit")).select("query", (F.col("nth") + 1).alias("rank"), *(f"hit.{c}" for c in (*pair, "score")))


def _listed(crops: DataFrame, images: DataFrame, colors: DataFrame, stock: DataFrame, most: int) -> DataFrame:
    """(r, g, b, part_num, color_id, distance, shown, remaining): the first ``most`` images by part of each distinct colour of ``crops``.

    A colour's list is the same for all crops, so it is made once; no palette colour gives more than its first ``most`` images to one.
    """
    near = cut(_nearest_of_channels(crops, colors, 6).select("r", "g", "b", "color_id", "distance"))
    wanted = images.join(near.select("color_id").distinct(), "color_id", "left_semi").groupBy("part_num", "color_id").agg(F.bool_and(F.col("img_url") != "").alias("shown"))
    held = wanted.withColumn("nth", F.row_number().over(Window.partitionBy("color_id").orderBy("part_num"))).filter(F.col("nth") <= most).drop("nth")
    rows = near.join(held, "color_id").withColumn("nth", F.row_number().over(Window.partitionBy("r", "g", "b").orderBy("part_num", "color_id"))).filter(F.col("nth") <= most).drop("nth")
    return rows.join(stock, ["part_num", "color_id"], "left").select("r", "g", "b", "part_num", "color_id", "distance", "shown", "remaining")


def image_manifest(manifest: DataFrame, mapped: DataFrame) -> DataFrame:
    """Manifest rows with part, colour and quantity from either side; the map alone if the manifest is empty."""
    joined = manifest.join(mapped.select("element_id", *(F.col(c).alias(f"m_{c}") for c in ("part_num", "color_id", "qty"))), "element_id", "left")
    rows = joined.select("element_id", "image", *(F.coalesce(c, f"m_{c}").alias(c) for c in ("part_num", "color_id", "qty")))
    any_row = manifest.limit(1).select(F.lit(1).alias("one"))
    alone = mapped.withColumn("one", F.lit(1)).join(F.broadcast(any_row), "one", "left_anti").select("element_id", F.lit(None).cast("string").alias("image"), "part_num", "color_id", "qty")
    return rows.unionByName(alone)


def duplicate_keys(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """A10: keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
