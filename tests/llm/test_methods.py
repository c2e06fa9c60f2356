"""Methods against plain loops, planted cases and every kind of block."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import boosting, html_text, language, mixing, quality_gam, sampling

PROSE = "The first part of a story, told at length and with many words. It goes on for a while, then it ends."
BLOCKS = {
    "h1": ("<h1>Title of it</h1>", "Title of it"),
    "p": (f"<p>{PROSE}</p>", PROSE),
    "h3": ("<h3>Part two</h3>", "Part two"),
    "ul": ("<ul><li>First item</li><li>Second, longer item of the list.</li><li>3</li></ul>", "First item\nSecond, longer item of the list.\n3"),
    "ol": ("<ol><li>One</li><li>Two</li></ol>", "One\nTwo"),
    "pre": ("<pre>x = 1\n  y = 2</pre>", "x = 1 y = 2"),
    "code": ("<pre><code>for i in x:\n print(i)</code></pre>", "for i in x: print(i)"),
    "quote": (f"<blockquote>{PROSE}</blockquote>", PROSE),
    "short quote": ("<blockquote><p>Short words.</p></blockquote>", "Short words."),
    "table": ("<table><caption>Numbers</caption><tr><th>Year</th><th>Sum</th></tr><tr><td>2001</td><td>17</td></tr></table>", "Numbers\nYear\nSum\n2001\n17"),
    "figure": ("<figure><img src='a'><figcaption>A caption of the picture</figcaption></figure>", "A caption of the picture"),
    "dl": ("<dl><dt>Term</dt><dd>What it means, in short.</dd></dl>", "Term\nWhat it means, in short."),
    "math": ("<p>Here <math><mi>a</mi><mo>=</mo><mn>5</mn><annotation>a=5</annotation></math> holds.</p>", "Here a=5 holds."),
    "object": ("<p>See <object data='x'>the drawing</object> and <canvas>a plot</canvas>.</p>", "See the drawing and a plot."),
    "section": (f"<section><h2>Sub</h2><p>{PROSE}</p></section>", "Sub\n" + PROSE),
    "details": ("<details><summary>More</summary><p>Hidden words.</p></details>", "More\nHidden words."),
    "div": ("<div>Some text in a div, with words.</div>", "Some text in a div, with words."),
}
OTHER = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>", "<header><h1>Site</h1><p>Our slogan, for all.</p></header>", "<div class='sidebar'><ul><li>Popular item</li><li>Other item</li></ul><table><tr><td>12</td><td>13</td></tr></table></div>",
    "<aside><h3>See also</h3><dl><dt>Term</dt><dd>Meaning</dd></dl><pre>code</pre></aside>", "<div class='cookie-notice'><p>We use cookies on this site.</p></div>", "<form><p>Your name</p><ul><li>Option</li></ul></form>", "<section class='comments'><h3>Comments</h3><ul><li><p>Nice article, thanks for it.</p></li></ul></section>",
    "<footer><p>Copyright 2020, all rights reserved.</p><ul><li>Imprint</li></ul></footer>", "<div class='ad'><figure><figcaption>Buy this now.</figcaption></figure></div>", "<ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul>",
]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_html_keeps_every_block(spark, model):
    rng = random.Random(1)
    pages, want = [], {}
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class='content'>", "</div>"), ("", "")):
        for trial in range(25):
            kinds = rng.sample(list(BLOCKS), rng.randint(2, 8)) if trial else list(BLOCKS)
            kinds += [] if {"p", "section", "quote"} & set(kinds) else ["p"]
            before, after = rng.sample(OTHER[:6], rng.randint(0, 3)), rng.sample(OTHER[4:], rng.randint(0, 3))
            inside, cut = [rng.choice(OTHER[2:9])] if trial % 4 == 3 else [], rng.randint(0, len(kinds))
            body = "".join(BLOCKS[k][0] for k in kinds[:cut]) + "".join(inside) + "".join(BLOCKS[k][0] for k in kinds[cut:])
            pages.append((len(pages), "u", f"<html><body>{''.join(before)}{start}{body}{end}{''.join(after)}</body></html>"))
            want[len(want)] = "\n".join(BLOCKS[k][1] for k in kinds)
    got = html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_html_long_repeated_and_odd(spark, model):
    long = "<html><body><article>" + "<p>" + PROSE + "</p>" + f"<p>{PROSE}</p>" * 20_000 + "</article><footer>Copyright</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, "<article><p>" + PROSE + "&nbsp;&#233;")], "page_id long, url string, html string").selectExpr("*", "html AS text", "page_id AS nodes")
    got = sorted((r["page_id"], r["n_chars"], len(r["text"].split("\n"))) for r in html_text.extracted(rows, model).collect())
    assert got == [(1, 20_001 * (len(PROSE) + 1) - 1, 20_001)] * 2 + [(2, len(PROSE) + 2, 1)]


def plain_mixture(ids, weights, size):
    """Slot by slot, all blocks of all sources: (slot, position) of each id of ``ids`` {source: ids in order}."""
    from fractions import Fraction
    from math import ceil

    blocks = {s: [rows[i : i + size] for i in range(0, len(rows), size)] for s, rows in ids.items()}
    used, out, slot, position = dict.fromkeys(blocks, 0), {}, 0, 0
    while blocks:
        total, done, t = sum(weights[s] for s in blocks), dict.fromkeys(blocks, 0), 0
        names = sorted(blocks, key=lambda s: (-weights[s], s is None, str(s)))
        ended = False
        while not ended:
            ready = [s for s in names if Fraction(done[s] * total, weights[s]) // 1 <= t]
            s = min(ready, key=lambda s: (ceil(Fraction((done[s] + 1) * total, weights[s])), names.index(s)))
            for i in blocks[s][used[s]]:
                out[i] = slot, position
                position += 1
            used[s], done[s], t, slot = used[s] + 1, done[s] + 1, t + 1, slot + 1
            if used[s] == len(blocks[s]):
                del blocks[s]
                ended = True
    return out


@pytest.mark.parametrize("weights", [None, {"src0": 5000, "src1": 3000}, {"src0": 5003, "src1": 2999, "src2": 1, None: 700}, {"src0": 1}])
def test_mixing_is_the_plain_schedule(spark, weights):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "nullif(source, 'src3') AS source")
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h")).collect()
    count = {}
    for r in rows:
        count[r["source"]] = count.get(r["source"], 0) + 1
    size = 8
    given = mixing.natural_weights(count) if weights is None else {s: max(1, weights.get(s, 1)) for s in count}
    order = sorted(rows, key=lambda r: (r["h"] % -(-count[r["source"]] // size), r["h"]))
    ids = {s: [r["doc_id"] for r in order if r["source"] == s] for s in count}
    got = {r["row"]["doc_id"]: (r["slot"], r["position"]) for r in mixing.mixed(docs, weights=weights, block_rows=size).collect()}
    assert got == plain_mixture(ids, given, size)


def test_mixing_refuses_what_it_cannot_lay_out():
    with pytest.raises(ValueError):
        mixing.first_slots({"a": 10_007, "b": 10_009}, {"a": 10**9, "b": 10**9}, most=1000)
    assert mixing.first_slots({"a": 10**9 + 7, "b": 10**9 + 9}, {"a": 3, "b": 10**9})[1]


def test_mixing_writes_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = {r["doc_id"]: r["position"] for r in mixing.mixed(docs.select("doc_id", "source")).select("row.doc_id", "position").collect()}
    ordered = mixing.in_mixed_order(docs)
    parts = ordered.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), "doc_id").collect()
    assert [place[r["doc_id"]] for r in sorted(parts, key=lambda r: r["m"])] == list(range(len(place))) and ordered.columns == docs.columns


def test_language_with_false_and_absent_declarations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 200")
    rows, truth = [], {}
    langs = ["de", "en", "es", "fr"]
    for k, r in enumerate(docs.select("doc_id", "lang", "text").orderBy("doc_id").collect()):
        told = r["lang"] if k % 3 == 0 else langs[(langs.index(r["lang"]) + 1) % 4] if k % 3 == 1 else None
        rows.append((k, f"http://h{k % 50}.example.org/x/{k}", f"<html{f' lang={told}' if told else ''}><body><p>{r['text']}</p></body></html>"))
        truth[k] = r["lang"]
    got = language.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    right = [r["lang"] == truth[r["page_id"]] for r in got]
    assert sum(right) / len(right) > 0.97 and all(0 < r["probability"] <= 1 for r in got)
    assert sum(r["lang"] != r["declared"] for r in got if r["page_id"] % 3 == 1) > 0.95 * sum(r["page_id"] % 3 == 1 for r in got)


def test_language_of_the_host_and_odd_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["lang"]: r["text"] for r in docs.filter("n_chars > 500").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    rows = [(k, f"http://a.{lang}host.org/p/{k}", f"<p>{text[lang]}</p>") for k, lang in enumerate(["fr"] * 20 + ["de"] * 20)]
    rows += [(100, "http://a.frhost.org/q", None), (101, "http://b.dehost.org/", "<html>"), (102, "http://a.frhost.org/r", "x" * 3_000_000), (102, "http://a.frhost.org/r", "x" * 3_000_000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS host", "url AS lang", "1 AS guess", "html AS declared")
    got = language.identified(pages, docs).collect()
    by = {r["page_id"]: r["lang"] for r in got}
    assert by[100] == "fr" and by[101] == "de" and len(got) == len(rows)
    assert len({(r["lang"], r["probability"]) for r in got if r["page_id"] == 102}) == 1


def test_quality_scores_are_sums_of_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(200).collect()
    x = quality_gam.features(pa.array([r["text"] for r in rows], pa.string()))
    got = {r["doc_id"]: r["score"] for r in quality_gam.scores(docs, model).collect()}
    at = lambda edges, v: sum(e <= v for e in edges)
    for r, f in zip(rows, x):
        logit = model.base + sum(t[at(e, v)] for e, t, v in zip(model.edges, model.tables, f))
        logit += sum(t[at(model.pair_edges[i], f[i]), at(model.pair_edges[j], f[j])] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-logit))) < 1e-9
    plain = rows[5]["text"]
    one = dict(zip(quality_gam.FEATURES, quality_gam.features(pa.array([plain]))[0]))
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), plain))
    assert abs(one["log_words"] - np.log1p(len(words))) < 1e-9 and abs(one["distinct"] - len(set(words)) / len(words)) < 1e-9
    assert abs(one["upper"] - sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in plain) / len(plain.encode())) < 1e-9


def test_quality_of_a_hot_id(spark):
    docs = spark.range(4000).selectExpr("if(id < 2000, 4, id) AS doc_id", "concat('word ', id, if(id % 2 = 0, ' !!!', ' plain text.')) AS text")
    labels = spark.createDataFrame([(4, 1)] + [(d, d % 2) for d in range(2000, 2400)], "doc_id long, quality int")
    assert quality_gam.scores(docs, quality_gam.train(docs, labels, max_labelled=300)).count() == 4000


def test_bounded_sample(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 10 = 0, null, id % 700) AS k")
    some = sampling.bounded_sample(rows, ["id"], 300).collect()
    assert 200 < len(some) <= 300 and some == sampling.bounded_sample(rows.repartition(7), ["id"], 300).collect()
    assert sampling.bounded_sample(rows, ["k"], 9000).count() == 5000 and sampling.bounded_sample(rows.limit(0), ["id"], 5).count() == 0
    assert sampling.bounded_sample(spark.range(5000).selectExpr("1 AS k"), ["k"], 50).count() in (0, 50)


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    fitted = boosting.fit(x, y)
    assert ((fitted.logit(x) > 0) == y).mean() > 0.97
    again = boosting.fit(x, y)
    assert (again.logit(x) == fitted.logit(x)).all()
    assert boosting.fit(x, np.ones(2000)).logit(x[:3]).tolist() == boosting.fit(x, np.ones(2000)).logit(x[5:8]).tolist()
    assert len(boosting.fit(x[:0], y[:0]).logit(x[:2])) == 2
    tied = np.repeat(x[:1], 50, 0)
    assert abs(boosting.fit(tied, y[:50]).logit(tied)).max() < 5
