"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of letters, digits, ``_``, ``+``, ``/`` and ``-``: 12 or more with a digit, or 24 or more without one; private
key headers are candidates too, and so is any value right after an assignment to a name of _NAMES, which may go on after ``_`` or ``-``, or after
the scheme of an authorisation header: to the closing quote, or else to white space, quotes or angle brackets without the
punctuation that ends it; and what stands between a user and the host of an address. Such a value may hold a run that is a candidate too. Each becomes a finding with its offset and the text around it.
The forest's features are the candidate's length, its transitions between character classes and how likely its letters follow
each other in the corpus's words, digit and capital shares, the share of its letters in words that the corpus uses often
(dictionary coverage), whether it stands in a path or address, and its neighbours: an assignment or quote before it, and how
often the word before it goes with secrets (taken out of fold for the labelled findings themselves).

Labelled findings are a table of the caller's, or planted ones: random keys, tokens and passwords of many shapes (1) and compound words, hashes of
addresses and checksums, numbers, dates, placeholders and named prose (0), set into contexts of the corpus itself. Training takes at most
MAX_LABELLED labelled findings (the first by hash); every candidate is scored. BEFORE and AFTER are how much context a finding
keeps: features read no further.

Defined cases: null and empty texts have no findings; texts of any length are scanned whole; repeated rows give repeated
findings; with labels of one class only the score is that class, with none 0; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from math import log2

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.llm.hot import with_group
from stepweave.llm.sampling import bounded_sample
from stepweave.session import cut, discard

MAX_LABELLED, MAX_PLANTED, OFTEN, SMOOTH, FOLDS = 20_000, 3_000, 20, 5.0, 5
# fixed values: what a candidate looks like, and words that name secrets
_RUN = r"(?:(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}|[A-Za-z_+/-]{24,})={0,2}"
CANDIDATE = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----|(?<![A-Za-z0-9_+/-]){_RUN}"
_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|(?<![a-z])pw|secret|token|(?:api|access|private|signing)[_-]?key|credential|auth)(?:[_-][a-z0-9_-]{0,30})?"
_MAYBE, _NAME_PARTS = "[0-9]|[A-Za-z_+/-]{24}|-----BEGIN", ("pass", "pwd", "pw", "secret", "token", "key", "credential", "auth", "://")
# a value follows a name and an assignment, a scheme of an authorisation header, or a user in an address
_LEADS = rf"""(?i:{_NAMES}["']?\s*[:=]+>?\s*["']?|authorization["']?\s*[:=]+\s*["']?(?:bearer|basic|token)\s+|://[^\s/:@"'<>]{{0,64}}:)"""
ASSIGNED = _LEADS + r"""(?=((?<=://[^\s/:@"'<>]{0,64}:)[^\s/@"'<>]+(?=@)|(?<!://[^\s/:@"'<>]{0,64}:)(?:(?<=")[^"\r\n]+(?=")|(?<=')[^'\r\n]+(?=')|[^\s"'`<>]*[^\s"'`<>.,;:)\]}])))"""
BEFORE, AFTER = 60, 20
FEATURES = ("length", "transitions", "likely", "digits", "capitals", "coverage", "in_path", "assigned", "quoted", "before_rate")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, candidate, before, after), one row for each match; start counts characters from 0.

    Offsets are running sums over a text's matches, so the work is linear in them.
    """
    words = F.lower(F.col(text))
    named = F.lit(False)
    for part in _NAME_PARTS:
        named = named | F.contains(words, F.lit(part))
    # cheap tests, which any match passes, come before the patterns
    some = (F.rlike(F.col(text), F.lit(_MAYBE)) & F.rlike(F.col(text), F.lit(CANDIDATE))) | (named & F.rlike(F.col(text), F.lit(ASSIGNED)))
    rows = docs.filter(some).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for pattern, mark in ((CANDIDATE, ""), (ASSIGNED, "_named")):
        some = F.rlike("text", F.lit(pattern))
        rows = rows.withColumns({f"gaps{mark}": F.when(some, F.split("text", pattern)), f"hits{mark}": F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))})
    rows = rows.withColumn("values", F.when(F.col("hits_named").isNotNull(), F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(1)))).drop("text")
    each = rows.select("row", "doc_id", F.explode_outer(F.concat(_plain(), _named())).alias("m")).select("row", "doc_id", "m.*")
    order = Window.partitionBy("row", "named").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("start", F.sum(F.col("gap") + F.col("hit")).over(order) - F.col("hit") + F.col("inside"))
    return each.filter("kept").select("doc_id", F.col("start").cast("long").alias("start"), "candidate", "before", "after")


_MATCHES = "array<struct<named:boolean,nth:int,gap:int,hit:int,inside:int,kept:boolean,candidate:string,before:string,after:string>>"


def _zipped(mark: str, **more: Column) -> Column:
    """Each match with the gap before and after it."""
    gaps, hits = F.col(f"gaps{mark}"), F.col(f"hits{mark}")
    return F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), F.slice(gaps, F.lit(2), F.size(hits)).alias("then"), *(c.alias(k) for k, c in more.items()))


def _found(matches: Column) -> Column:
    return F.coalesce(matches.cast(_MATCHES), F.array().cast(_MATCHES))


def _plain() -> Column:
    """Matches of CANDIDATE."""
    part = lambda m, i: F.struct(F.lit(False).alias("named"), i.alias("nth"), F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("hit"), F.lit(0).alias("inside"), F.lit(True).alias("kept"), m["hit"].alias("candidate"), F.right(m["gap"], F.lit(BEFORE)).alias("before"), F.left(F.coalesce(m["then"], F.lit("")), F.lit(AFTER)).alias("after"))
    return _found(F.transform(_zipped(""), part))


def _named() -> Column:
    """Values after ASSIGNED, kept if they aren't matches of CANDIDATE as they are; ``before`` holds the whole assignment."""

    def part(m: Column, i: Column) -> Column:
        before = F.right(F.concat(m["gap"], m["hit"]), F.greatest(F.lit(BEFORE), F.length(m["hit"])))
        after = F.substr(F.coalesce(m["then"], F.lit("")), F.length(m["value"]) + 1, F.lit(AFTER))
        return F.struct(F.lit(True).alias("named"), i.alias("nth"), F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("hit"), F.length(m["hit"]).alias("inside"), (~F.rlike(m["value"], F.lit(rf"\A{_RUN}\z"))).alias("kept"), m["value"].alias("candidate"), before.alias("before"), after.alias("after"))

    return _found(F.transform(_zipped("_named", value=F.col("values")), part))


def common_words(docs: DataFrame, text: str = "text", least: int = OFTEN) -> DataFrame:
    """(word, n): lower-case runs of 3 or more ASCII letters that occur at least ``least`` times in all texts."""
    words = docs.select(F.explode_outer(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word")).filter(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _letters(text: Column) -> Column:
    """Pairs of neighbouring letters of lower-case words, with ends marked."""
    marked = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z]+", " "), F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substr(marked, i, F.lit(2)))
    return F.filter(pairs, lambda p: p != "  ")


def follows(words: DataFrame) -> Column:
    """Map from a pair of letters (at most 27 * 27) to the logarithm of how often its second follows its first in ``words``."""
    pairs = words.select("n", F.explode(_letters(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    first: dict[str, int] = {}
    for r in pairs:
        first[r["pair"][0]] = first.get(r["pair"][0], 0) + r["n"]
    return F.create_map(*(F.lit(x) for r in pairs for x in (r["pair"], log2((r["n"] + 1) / (first[r["pair"][0]] + 27))))) if pairs else F.lit(None).cast("map<string,double>")


def planted(docs: DataFrame, most: int = MAX_PLANTED) -> DataFrame:
    """(doc_id, start, candidate, before, after, y): two labelled findings in each of at most ``most`` contexts of the corpus.

    A corpus of fewer texts gives each context several times, one of no texts nothing.
    """
    h = F.xxhash64("doc_id", F.lit(41))
    spot = docs.filter("text IS NOT NULL").select("doc_id", h.alias("h"), F.expr("cast(pmod(xxhash64(doc_id), length(text) + 1) as int)").alias("start"), "text")
    spot = spot.select("doc_id", "h", "start", F.regexp_replace(F.expr(f"substring(text, greatest(start - {BEFORE - 20}, 0) + 1, least(start, {BEFORE - 20}))"), r"\S+$", "").alias("lead"), F.expr(f"concat(' ', substring(text, start + 1, {AFTER - 1}))").alias("after"))
    spot = cut(bounded_sample(spot, ["h", "start"], most))
    again = most // max(spot.count(), 1)  # few contexts are used several times
    spot = spot.withColumn("h", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(again, 1))), lambda i: F.xxhash64("h", i))))
    hexes = F.sha2(F.col("h").cast("string").cast("binary"), 512)
    spot = spot.withColumns({"x": hexes, "b": F.base64(F.unhex(hexes)), "k": F.expr("cast(pmod(shiftright(h, 8), 1 << 20) as int)"), "w": F.filter(F.split("lead", "[^A-Za-z]+"), lambda w: F.length(w) >= 3)})
    c = F.col

    def pick(by: Column, *options: Column) -> Column:
        return F.get(F.array(*options), (by % len(options)).cast("int"))

    def row(value: Column, before: Column, y: float) -> Column:
        return F.struct(value.alias("candidate"), F.concat("lead", before).alias("before"), F.lit(y).alias("y"))

    draw = lambda salt: F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1 << 20))
    some = lambda salt, *options: pick(draw(salt), *(F.lit(o) for o in options))
    # each part is a column of its own, built once: written out at every use, their code passes what the driver can compile
    spot = spot.withColumns(
        {"plain": F.translate("b", "+/=", "aZ9"), "letters": F.translate("x", "0123456789", "ghijklmnop"), "numbers": F.translate("x", "abcdef", "012345"), "mark": some(9, "!", "#", "$", "&", "%", "@", "")}
        | {f"word{i}": F.coalesce(F.get("w", F.lit(i)), F.lit(w)) for i, w in enumerate(("river", "garden", "winter", "stone"))}
        | {f"piece_{p}": F.translate(F.base64(F.unhex(F.sha2(F.concat("x", F.lit(p)), 256))), "+/=", "aZ9") for p in "abc"}
        | {f"draw_{p}": draw(p) for p in ("a", "b", "c", 11, 12)}
        # fixed values: names and neighbours of secrets and of what only looks like one
        | {"name": F.concat(some(1, "", "", "db_", "MY_", "client-", "app_"), some(2, "password", "api_key", "secret", "token", "access_key", "auth", "passwd", "PASS", "pwd", "pw", "apikey"), some(3, "", "", "", "_key", "_value", "-2")), "sets": some(6, " = ", ": ", "=", " => ", ":", " := ")}
        | {"scheme": some(15, "Authorization: Bearer ", "Authorization: Basic ", 'Authorization": "Bearer ')}
    )
    spot = spot.withColumns({
        "always": F.concat("name", "sets", some(7, "", '"', "'")),
        "quoted": F.concat("name", "sets", some(8, '"', "'")),
        "address": F.concat(some(16, "postgres://", "mysql://", "https://", "amqp://", "redis://"), F.lower("word1"), F.lit(":")),
        "short": F.concat(F.initcap("word0"), F.expr("k % 97"), "mark", F.substring("plain", 1, 3)),
        "hashed": pick(c("k"), F.substring("x", 1, 40), F.substring("x", 1, 32), F.substring("x", 1, 64), F.regexp_replace(F.substring("x", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")),
    })
    spot = spot.withColumn("named", F.when(draw(4) % 4 == 0, some(5, "", "key ", "use ", "")).otherwise(c("always")))
    first = lambda text, n: F.substr(c(text), F.lit(1), n.cast("int"))
    piece = lambda p, least, most: first(f"piece_{p}", least + c(f"draw_{p}") % (most - least + 1))
    secret = pick(
        draw(10),
        row(first("x", 20 + c("draw_11") % 60), c("named"), 1.0),
        row(piece("a", 16, 44), c("named"), 1.0),
        row(first("b", 20 + c("draw_11") % 44), c("named"), 1.0),
        row(F.concat(F.lit("AKIA"), F.upper(F.substring("plain", 1, 16))), c("named"), 1.0),
        row(F.concat(first("letters", 2 + c("draw_12") % 4), some(13, "_", "-"), piece("a", 16, 36)), c("named"), 1.0),
        row(F.concat_ws("-", first("letters", 2 + c("draw_12") % 4), F.substring("numbers", 1, 12), piece("a", 10, 24)), c("named"), 1.0),
        row(F.concat_ws(".", piece("a", 3, 20), piece("b", 3, 40), piece("c", 3, 40)), F.when(draw(14) % 2 == 0, some(15, "Authorization: Bearer ", "authorization: Token ", 'Authorization": "Bearer ')).otherwise(c("always")), 1.0),
        row(piece("a", 8, 40), c("scheme"), 1.0),
        row(c("short"), c("always"), 1.0),
        row(F.concat(piece("a", 3, 6), "mark", piece("b", 3, 7)), c("always"), 1.0),
        row(F.concat(piece("a", 3, 6), "mark", piece("b", 3, 7)), c("address"), 1.0),
        row(c("short"), c("address"), 1.0),
        row(first("letters", 8 + c("draw_11") % 12), c("always"), 1.0),
        row(F.concat_ws(" ", F.lower("word0"), piece("a", 1, 3), F.lower("word2")), c("quoted"), 1.0),
        row(F.concat_ws(" ", piece("a", 1, 2), piece("b", 1, 2), piece("c", 1, 2)), c("quoted"), 1.0),
        row(F.lit("-----BEGIN RSA PRIVATE KEY-----"), some(17, "", "\n"), 1.0),
    )
    harmless = pick(
        F.floor(c("k") / 5),
        row(F.lower(F.concat_ws("-", "word0", "word1", "word2", "word3")), F.lit(""), 0.0),
        row(F.concat(F.lower("word0"), F.initcap("word1"), F.initcap("word2"), F.initcap("word3")), F.lit(""), 0.0),
        row(F.concat(F.lit("org/commit/"), "hashed"), F.lit("https://example."), 0.0),
        row(F.concat(pick(c("k"), F.lit("com/files/"), F.lit("/static/img/"), F.lit("net/a/b/")), "hashed"), pick(c("k"), F.lit("http://www.example."), F.lit("at "), F.lit("ftp://files.example.")), 0.0),
        row(c("hashed"), pick(c("k"), F.lit("sha256 checksum "), F.lit("commit "), F.lit("md5: "), F.lit("revision = "), F.lit("uuid ")), 0.0),
        row(F.substring("numbers", 1, 16), pick(c("k"), F.lit(""), F.lit("number "), F.lit("phone: ")), 0.0),
        row(F.concat_ws("/", "word0", "word1", F.concat("word2", F.expr("k % 10"))), F.lit(""), 0.0),
        row(F.concat_ws("_", "word0", "word1", "word2"), c("named"), 0.0),
        row(F.lower("word0"), c("always"), 0.0),
        row(some(18, "your_password_here", "${DB_PASSWORD}", "os.environ", "None", "null", "true", "********", "xxxxxxxxxxxx", "string", "required", "changes", "getpass()", "{{token}}", "self.token", "config.get('key')", "...", "N/A"), c("always"), 0.0),
        row(F.concat(F.lit("2024-0"), F.expr("k % 9 + 1"), F.lit("-1"), F.expr("k % 9"), F.lit("T1"), F.expr("k % 7"), F.lit("-30-00")), F.lit("on "), 0.0),
    )
    return spot.select("doc_id", F.col("start").cast("long").alias("start"), "after", F.explode(F.array(secret, harmless)).alias("f")).select("doc_id", "start", "f.candidate", "f.before", "after", "f.y")


def _features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the features but before_rate. ``found`` has a unique ``key``; ``words``: (word, n)."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "_+/-=", "ddddd")
    runs = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1"))
    often = follows(words)
    pairs = _letters(c)
    likely = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(often, p), F.lit(-12.0))) / F.greatest(F.size(pairs), F.lit(1))
    parts = found.select("key", F.explode(F.array_distinct(F.filter(F.split(F.lower("candidate"), "[^a-z]+"), lambda w: F.length(w) >= 3))).alias("part"))
    known = parts.join(words, F.col("part") == F.col("word")).groupBy("key").agg(F.sum(F.length("part")).alias("covered"))
    out = found.join(known, "key", "left")
    return out.withColumns({
        "length": F.length("candidate").cast("double"),
        "transitions": (runs - 1) / n,
        "likely": likely,
        "digits": F.length(F.regexp_replace(c, "[^0-9]", "")) / n,
        "capitals": F.length(F.regexp_replace(c, "[^A-Z]", "")) / n,
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "in_path": (F.rlike("before", F.lit(r"[/\\.@]\S*$")) | F.contains(c, F.lit("/"))).cast("double"),
        "assigned": F.rlike("before", F.lit(r"[:=]\s*[\"']?$")).cast("double"),
        "quoted": F.rlike("before", F.lit(r"[\"'`]$")).cast("double"),
        "near": F.coalesce(F.lower(F.regexp_extract("before", r"([^\W_]+)[^\w]*$", 1)), F.lit("")),
    })


def findings(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", trees: int = 30, seed: int = 3) -> DataFrame:
    """(doc_id, start, candidate, score, secret), a row for each candidate.

    ``labels``: (doc_id, start, y) of labelled findings; without them, planted ones.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = candidates(docs)
    if labels is None:
        found = found.withColumn("y", F.lit(None).cast("double")).withColumn("real", F.lit(True)).unionByName(planted(docs).withColumn("real", F.lit(False)))
    else:
        y = labels.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("y").cast("double").alias("y")).groupBy("_d", "_s").agg(F.max("y").alias("y"))
        found = found.join(y, (found["doc_id"] == y["_d"]) & (found["start"] == y["_s"]), "left").drop("_d", "_s").withColumn("real", F.lit(True))
    found = cut(found.withColumn("key", F.monotonically_increasing_id()))  # kept before it is used twice
    words = cut(common_words(docs))
    rows = cut(_features(found, words).withColumn("fold", F.pmod(F.xxhash64("doc_id", "start"), F.lit(FOLDS)).cast("int")))
    discard(found)
    known = rows.filter("y IS NOT NULL")
    mean = known.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean")).first()["mean"]
    if mean in (0.0, 1.0):
        scored = rows.withColumn("score", F.lit(float(mean)))
    else:
        # a labelled finding's rate leaves out its own fold
        by_fold = rows.groupBy("near", "fold").agg(F.sum("y").alias("y"), F.count("y").alias("n"), F.count("*").alias("rows"))
        folds = by_fold.groupBy("near").agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"), F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("y", "n").alias("of")))).alias("folds"))
        full = with_group(rows, folds, ["near"], "rows").withColumn("own", F.when(F.col("y").isNotNull(), F.try_element_at("folds", F.col("fold"))))
        less = lambda total, part: F.coalesce(F.col(total), F.lit(0)) - F.coalesce(F.col(f"own.{part}"), F.lit(0))
        full = full.withColumn("before_rate", (less("all_y", "y") + SMOOTH * mean) / (less("all_n", "n") + SMOOTH)).drop("folds", "own", "rows")
        full = cut(full)  # the forest reads its sample several times, and scoring reads all; neither joins again
        discard(rows)
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        ready = gather.transform(full)
        sample = bounded_sample(ready.filter("y IS NOT NULL"), ["key"], MAX_LABELLED).select("features", "y")
        model = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=9, seed=seed).fit(sample)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.filter("real").select("doc_id", "start", "candidate", "score", (F.col("score") >= 0.5).alias("secret"))
