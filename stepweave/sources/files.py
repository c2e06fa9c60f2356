"""Page listings, manifests and recogniser tables as sources, and the sinks of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stepweave.sources.versioned import Store

_TSV = {"sep": "\t", "header": "true"}


def page_list(files: DataFrame, *more: str) -> DataFrame:
    """(set_num, run, page, path) of ``.../<set>/<run>/page_NNN.png``; other names are dropped."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/page_([0-9]+)\.png$", k)
    rows = files.select(part(1).alias("set_num"), part(2).alias("run"), part(3).try_cast("int").alias("page"), "path", "modificationTime", *more)
    return rows.filter("page IS NOT NULL")


def page_run_latest(files: DataFrame) -> DataFrame:
    """Pages of each set's most recently written run."""
    pages = page_list(files)
    runs = pages.groupBy("set_num").agg(F.max_by("run", F.struct("modificationTime", "run")).alias("run"))
    return pages.join(runs, ["set_num", "run"], "left_semi")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of image files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)


def content_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of each file."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def latest_artifact(files: DataFrame, pattern: str) -> DataFrame:
    """Newest file of each key, the first group of ``pattern`` in its name."""
    keyed = files.withColumn("key", F.regexp_extract("path", pattern, 1)).filter("key <> ''")
    return keyed.groupBy("key").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def catalog_scan(spark: SparkSession, root: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """The catalog's tables below ``root`` with the columns and types of their DDL, in that order; others aren't read.

    A table whose columns are missing fails when it is read, not later.
    """
    found = {}
    for name, ddl in tables.items():
        kinds = [part.strip().rsplit(" ", 1) for part in ddl.split(",")]
        found[name] = spark.read.parquet(f"{root}/{name}.parquet").select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds))
    return found


def truth_import(rows: DataFrame, source: str) -> DataFrame:
    """(set_id, bag, start_page, source, confidence) of truth rows, one a section: the row with the lowest page.

    Rows without a number or page aren't truth; an imported section counts as certain.
    """
    typed = rows.select(F.col("set_id").cast("long").alias("set_id"), F.col("bag").cast("int").alias("bag"), F.col("page").cast("int").alias("start_page")).filter("bag > 0 AND start_page > 0")
    return typed.groupBy("set_id", "bag").agg(F.min("start_page").alias("start_page")).withColumns({"source": F.lit(source), "confidence": F.lit(1.0)})


def manifest(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of manifests that are a bare list or ``{"entries": [...]}``; ``entry`` is the DDL of one. Other items are dropped."""
    return manifest_entries(spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file")), entry)


def manifest_entries(documents: DataFrame, entry: str) -> DataFrame:
    """Entries of manifest documents (file, value)."""
    bare = F.from_json("value", f"array<struct<{entry}>>")
    held = F.from_json("value", f"struct<entries: array<struct<{entry}>>>")["entries"]
    listed = F.when(F.rlike("value", F.lit(r"^\s*\[")), bare).otherwise(held)
    return documents.select("file", F.explode(listed).alias("e")).filter("e IS NOT NULL").select("file", "e.*")


def token_table(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """Quantity tokens of a recogniser's table (text, left, top, width, height, conf): ``Nx`` or ``xN``, boxes scaled, confidence / 100 from 0 up."""
    kept = rows.filter(F.rlike("text", F.lit(r"^([0-9]{1,2}x|x[0-9]{1,2})$")))
    scaled = {n: F.round(F.col(c) / scale).cast("int") for n, c in (("x", "left"), ("y", "top"), ("w", "width"), ("h", "height"))}
    return kept.select("text", *(v.alias(n) for n, v in scaled.items()), F.greatest(F.col("conf") / 100.0, F.lit(0.0)).alias("confidence"))


def embedding_scan(vectors: DataFrame, items: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Vectors with the columns of their item, joined by ``key``, and their ``length``.

    Vectors that are null or empty, or hold a null or non-finite value, are dropped, as are items without a vector.
    """
    good = f"size({embedding}) > 0 AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return vectors.select(key, embedding).filter(good).withColumn("length", F.size(embedding)).join(items, key)


def crop_cache(rows: DataFrame) -> DataFrame:
    """Typed crops with the crop index from their id and reading order; rows without an id are dropped."""
    return rows.filter("crop_id IS NOT NULL AND crop_id <> ''").withColumn("crop_index", F.regexp_extract("crop_id", "_c([0-9]+)$", 1).try_cast("int"))


def review_state(rows: DataFrame) -> DataFrame:
    """One row for each part of each crop of review documents (crops map<string, struct<status, parts array>>)."""
    crops = rows.select("set_num", "bag", F.explode("crops").alias("crop_id", "crop"))
    return crops.select("set_num", "bag", "crop_id", F.col("crop.status").alias("status"), F.posexplode_outer("crop.parts").alias("slot", "part"))


def json_sink(rows: DataFrame, path: str, part: str | None = None) -> int:
    """``rows`` as the new version of a committed JSON table, cut by ``part`` if given.

    Written whole or not at all: until the commit, and after a write that failed, ``json_table`` reads the version before.
    """
    return Store(rows.sparkSession, path, "json").write({"rows": rows}, parts={"rows": part} if part else None, keep_parts=False)


def json_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version that ``json_sink`` committed, or an earlier one."""
    return Store(spark, path, "json").read("rows", version)


def tsv_sink(rows: DataFrame, path: str, flags: str) -> int:
    """Audit rows with their flags joined by ``|``, as the new version of a committed table."""
    return Store(rows.sparkSession, path, "csv", _TSV).write({"rows": rows.withColumn(flags, F.concat_ws("|", flags))})


def tsv_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version that ``tsv_sink`` committed, or an earlier one."""
    return Store(spark, path, "csv", _TSV).read("rows", version)


def review_export(slots: DataFrame) -> DataFrame:
    """One nested document for each crop: progress counts and slot records in order."""
    record = F.struct("slot", "label", "status")
    return slots.groupBy("crop").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "needs_review").alias("open"), F.sort_array(F.collect_list(record)).alias("slots"))


def bundle_manifest(bundles: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Approved bundles' artifacts (map role -> path, array of cutouts) as rows with target keys; blank paths are dropped.

    With ``files`` (path, length): whether each exists, and its size.
    """
    some = bundles.filter("status = 'approved'")
    named = some.select("bundle_id", F.explode("artifacts").alias("role", "path"))
    cut = some.select("bundle_id", F.posexplode("cutouts").alias("k", "path")).select("bundle_id", F.concat(F.lit("slot_cutout_"), F.col("k")).alias("role"), "path")
    rows = named.unionByName(cut).filter("path IS NOT NULL AND trim(path) <> ''")
    rows = rows.withColumn("target", F.concat_ws("/", F.lit("bundles"), "bundle_id", F.regexp_extract("path", "[^/]+$", 0)))
    if files is None:
        return rows
    sizes = files.groupBy("path").agg(F.max("length").alias("size"))
    return rows.join(sizes, "path", "left").withColumn("exists", F.col("size").isNotNull())


def page_index(files: DataFrame) -> DataFrame:
    """Ordinal page, path and hash of each page file with bytes, in one pass over the files."""
    hashed = page_list(files.select("path", "modificationTime", F.sha2("content", 256).alias("sha256")), "sha256")
    return hashed.select("set_num", "page", "path", "sha256")


def run_manifest(index: DataFrame) -> DataFrame:
    """For each set its pages, the first and the last, and how many distinct contents they have."""
    return index.groupBy("set_num").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.countDistinct("sha256").alias("contents"))
