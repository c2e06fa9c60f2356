"""Column functions: pure expressions, no Python per row (F01-F22, P01, P11, P17-like rules live with their operators)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_int(text: Column) -> Column:
    """Whole numbers only; blank, null and anything else give null."""
    return F.when(F.rlike(text, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.try_to_number(F.trim(text), F.lit("S999999999999999999")).cast("long"))


def bundle_fields(bundle_id: Column) -> Column:
    """struct(set_num, bag, page, step, crop) of ``<set>_bagB_pP_sS_cC``; all null where it doesn't match."""
    pattern = r"^(.+)_bag([0-9]+)_p([0-9]+)_s([0-9]+)_c([0-9]+)$"
    part = lambda k: F.nullif(F.regexp_extract(bundle_id, pattern, k), F.lit(""))
    return F.struct(part(1).alias("set_num"), *(part(k).cast("int").alias(n) for k, n in enumerate(("bag", "page", "step", "crop"), 2)))


def crop_fields(crop_id: Column) -> Column:
    """struct(page, step, crop) of ``pP_sS_cC``."""
    pattern = r"p([0-9]+)_s([0-9]+)_c([0-9]+)$"
    return F.struct(*(F.nullif(F.regexp_extract(crop_id, pattern, k), F.lit("")).cast("int").alias(n) for k, n in enumerate(("page", "step", "crop"), 1)))


def first_version_id(crop: Column, step: Column) -> Column:
    """``pP_sS_cC`` of a later id (``bag_BB_page_PPP_step_S_CCC``), whose unknown step comes from ``step``; without one it is an error."""
    part = lambda k: F.regexp_extract(crop, r"^bag_[0-9]+_page_([0-9]+)_step_([0-9]+|unknown)_([0-9]+)$", k)
    known = F.coalesce(part(2).try_cast("int"), step)
    named = F.when(known.isNotNull(), F.concat(F.lit("p"), part(1).cast("int"), F.lit("_s"), known, F.lit("_c"), part(3).cast("int")))
    return F.when(part(1) != "", F.coalesce(named, F.raise_error(F.concat(F.lit("unknown step in "), crop)).cast("string"))).otherwise(crop)


def crop_id(page: Column, step: Column, crop: Column) -> Column:
    return F.format_string("p%d_s%d_c%d", page, step, crop)


def parse_qty(text: Column, low: int = 1, high: int = 500) -> Column:
    """quantity of ``x12``, ``12x`` or ``12`` between ``low`` and ``high``, else null."""
    digits = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)^\s*x\s*([0-9]{1,3})\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)^\s*([0-9]{1,3})\s*x?\s*$", 1), F.lit(""))).cast("int")
    return F.when(digits.between(low, high), digits)


def duplicate_tokens(tokens: Column) -> Column:
    """how many tokens of an array of struct<text, x, y> repeat the text of an earlier one; only those with a place count."""
    placed = F.filter(tokens, lambda t: t["x"].isNotNull() & t["y"].isNotNull() & t["text"].isNotNull())
    return F.size(placed) - F.size(F.array_distinct(F.transform(placed, lambda t: F.lower(t["text"]))))


def strict_qty(text: Column) -> Column:
    """the ``Nx`` form only."""
    return F.nullif(F.regexp_extract(text, r"^([0-9]{1,2})x$", 1), F.lit("")).cast("int")


def text_qty(text: Column) -> Column:
    """in free text the first ``xN``, else the first ``Nx``."""
    first = F.nullif(F.regexp_extract(text, r"(?i)\bx\s?([0-9]{1,3})\b", 1), F.lit(""))
    return F.coalesce(first, F.nullif(F.regexp_extract(text, r"(?i)\b([0-9]{1,3})\s?x\b", 1), F.lit(""))).cast("int")


def qty_sequence(numbers: Column, texts: Column) -> Column:
    """array<struct(qty, text)> to the longer length; a missing text is ``Nx``."""
    zipped = F.arrays_zip(numbers.alias("qty"), texts.alias("text"))
    return F.transform(zipped, lambda z: F.struct(z["qty"].alias("qty"), F.coalesce(z["text"], F.concat(z["qty"].cast("string"), F.lit("x"))).alias("text")))


def hex_rgb(value: Column, invalid: str = "null") -> Column:
    """array(r, g, b) of a hex colour; an invalid one is null or, with ``invalid='black'``, (0, 0, 0)."""
    clean = F.regexp_replace(F.trim(value), "^#", "")
    part = lambda k: F.conv(F.substring(clean, k, 2), 16, 10).cast("int")
    rgb = F.when(F.rlike(clean, F.lit("^[0-9a-fA-F]{6}$")), F.array(part(1), part(3), part(5)))
    return F.coalesce(rgb, F.array(F.lit(0), F.lit(0), F.lit(0))) if invalid == "black" else rgb


def rgb_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two colours."""
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(3)), F.lit(0)).cast("double"))


def rgb_similarity(distance: Column) -> Column:
    """1 - d / 441.6729, within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 441.6729))


def avg_hash(values: Column) -> Column:
    """64-bit average hash of up to 64 grey values, the first in the lowest bit."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    bits = F.transform(values, lambda v, i: F.when(v >= mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits))


def hash_colour_score(hash_similarity: Column, mse: Column, colour: Column) -> Column:
    """.55 of (.62 hash + .38 (1 - mse)) and .45 colour; colour alone without an image."""
    return F.coalesce(0.55 * (0.62 * hash_similarity + 0.38 * (1 - mse)) + 0.45 * colour, colour)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(vector: Column) -> Column:
    """unit vector; null for zero vectors and where a value isn't finite."""
    norm = F.sqrt(dot(vector, vector))
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite & (norm > 0), F.transform(vector, lambda v: v.cast("double") / norm))


def round_even(value: Column, places: int) -> Column:
    """rounded half to even; what rounds to zero keeps its sign, as SQL's doubles do (``bround`` gives 0.0 for all of it)."""
    rounded = F.bround(value, places)
    return F.when((rounded == 0) & value.cast("string").startswith("-"), F.lit(-0.0)).otherwise(rounded)


def intersection_area(a: str, b: str) -> Column:
    """shared area of two boxes given as column prefixes (x, y, w, h)."""
    c = F.col
    wide = F.least(c(f"{a}x") + c(f"{a}w"), c(f"{b}x") + c(f"{b}w")) - F.greatest(c(f"{a}x"), c(f"{b}x"))
    tall = F.least(c(f"{a}y") + c(f"{a}h"), c(f"{b}y") + c(f"{b}h")) - F.greatest(c(f"{a}y"), c(f"{b}y"))
    return F.greatest(wide, F.lit(0)) * F.greatest(tall, F.lit(0))


def overlaps(a: str, b: str) -> Column:
    """true where boxes share more than an edge."""
    c = F.col
    return (c(f"{a}x") < c(f"{b}x") + c(f"{b}w")) & (c(f"{b}x") < c(f"{a}x") + c(f"{a}w")) & (c(f"{a}y") < c(f"{b}y") + c(f"{b}h")) & (c(f"{b}y") < c(f"{a}y") + c(f"{a}h"))


def inside(a: str, b: str, pad: float = 0) -> Column:
    """whether box a lies in box b widened by ``pad``."""
    c = F.col
    return (c(f"{a}x") >= c(f"{b}x") - pad) & (c(f"{a}y") >= c(f"{b}y") - pad) & (c(f"{a}x") + c(f"{a}w") <= c(f"{b}x") + c(f"{b}w") + pad) & (c(f"{a}y") + c(f"{a}h") <= c(f"{b}y") + c(f"{b}h") + pad)


def holds_point(a: str, x: Column, y: Column) -> Column:
    """whether a point lies in a box, edges included."""
    c = F.col
    return x.between(c(f"{a}x"), c(f"{a}x") + c(f"{a}w")) & y.between(c(f"{a}y"), c(f"{a}y") + c(f"{a}h"))


def centre(a: str) -> tuple[Column, Column]:
    """centre of a box."""
    c = F.col
    return c(f"{a}x") + c(f"{a}w") / 2, c(f"{a}y") + c(f"{a}h") / 2


def centre_distance(a: str, b: str) -> Column:
    """distance of two boxes' centres."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clipped(a: str, width: int, height: int) -> Column:
    """struct(x, y, w, h) of the part of a box on a page; null if none is."""
    c = F.col
    x1, y1 = F.greatest(c(f"{a}x"), F.lit(0)), F.greatest(c(f"{a}y"), F.lit(0))
    x2, y2 = F.least(c(f"{a}x") + c(f"{a}w"), F.lit(width)), F.least(c(f"{a}y") + c(f"{a}h"), F.lit(height))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def iou(a: str, b: str) -> Column:
    shared = intersection_area(a, b)
    union = F.col(f"{a}w") * F.col(f"{a}h") + F.col(f"{b}w") * F.col(f"{b}h") - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def ocr_variants(number: Column) -> Column:
    """the numbers that a single confused digit gives (7/2, 8/3, 5/6 both ways, 1 to 7, 0 to 8), without the number itself."""
    # fixed values: digits that are read for each other
    swaps = {"7": "2", "2": "7", "8": "3", "3": "8", "5": "6", "6": "5", "1": "7", "0": "8"}
    text = number.cast("string")
    table = F.create_map(*[F.lit(x) for pair in swaps.items() for x in pair])
    place = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.element_at(table, F.substring(text, i, F.lit(1))), F.substring(text, i + 1, F.length(text))))
    return F.array_sort(F.array_distinct(F.transform(F.filter(place, lambda v: v.isNotNull()), lambda v: v.cast("int"))))


def text_counts(text: Column) -> Column:
    """F16: struct(words, long_words, numbers, lines): alphabetic words, those of 5 letters or more, number tokens, non-blank lines."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.regexp_count(t, F.lit("[A-Za-z]+")).alias("words"), F.regexp_count(t, F.lit("[A-Za-z]{5,}")).alias("long_words"), F.regexp_count(t, F.lit("[0-9]+")).alias("numbers"), F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")).alias("lines"))


def safe_key(text: Column) -> Column:
    """letters, digits, ``-`` and ``_`` only; ``unknown`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("unknown"))


def stock_adjustment(remaining: Column, hide_depleted: bool = False) -> Column:
    """-30 in stock, +90 depleted (null, to be left out, with ``hide_depleted``), 0 where unknown."""
    return F.when(remaining > 0, -30.0).when(remaining.isNotNull(), F.lit(None).cast("double") if hide_depleted else F.lit(90.0)).otherwise(0.0)


def iso_timestamp(ts: Column) -> Column:
    """UTC ISO-8601 text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_safe(row: Column) -> Column:
    """JSON of a struct, times as UTC ISO-8601, nulls kept."""
    return F.to_json(row, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "ignoreNullFields": "false"})


def with_suffix(set_num: Column) -> Column:
    """``-1`` appended where there is no suffix."""
    return F.when(F.contains(set_num, F.lit("-")), set_num).otherwise(F.concat(set_num, F.lit("-1")))


def without_suffix(set_num: Column) -> Column:
    return F.regexp_replace(set_num, "-[0-9]+$", "")
