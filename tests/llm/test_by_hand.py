"""Features of urls and fused scores of languages, computed again in plain Python."""

import html
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stepweave.llm import language, url_filter

URLS = ["https://www.Example.com/a/b-c/d.html?x=1&y=2&&z#top", "http://shop.example.net", "ftp://10.0.0.1/files//x?q", "no scheme here", "", None, "https://a-b-c.d.org/?#", "https://www.example.com/a/z9", "https://www.example.com/a?x", "http://localhost:8080/p/1/2/3"]


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_features(url, every):
    text = url or ""
    host, path = split_url(url)
    m = re.search(r"\?([^#]*)", text)
    query = m[1] if m else ""
    labels = host.split(".")
    count = Counter(host)
    facts = lambda h, p: (h.split(".")[-1], ".".join(h.split(".")[-2:]), (re.match(r"/([^/]*)", p) or ["", ""])[1])
    out = {
        "length": len(text), "host_length": len(host), "depth": sum(bool(p) for p in path.split("/")), "labels": len(labels), "digits": len(re.findall("[0-9]", text)) / max(len(text), 1), "hyphens": host.count("-"),
        "entropy": -sum(c / len(host) * math.log2(c / len(host)) for c in count.values()) if host else 0.0, "params": sum(bool(p) for p in query.split("&")), "query_length": len(query), "fragment": float("#" in text),
    }
    for i, name in enumerate(("suffix", "domain", "part")):
        same = [split_url(u)[0] for u in every if facts(*split_url(u))[i] == facts(host, path)[i]]
        out |= {f"{name}_urls": math.log1p(len(same)), f"{name}_hosts": math.log1p(len(set(same)))}
    return out


def test_url_features(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    rows = url_filter.lexical(pages.withColumn("host", url_filter.host_of(F.col("url"))).withColumn("path", url_filter.path_of(F.col("url"))))
    for r in url_filter.with_statistics(rows, rows).collect():
        want = plain_features(r["url"], URLS * 2)
        assert set(want) == set(url_filter.FEATURES)
        for name, value in want.items():
            assert abs(r[name] - value) < 1e-9, (r["url"], name, r[name], value)


def bucket(a, b, c):
    return ((((a * 65599 + b) * 65599 + c) % 2**32) * 2654435761 % 2**32) >> 19


def trigrams(data):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return [bucket(*data[i : i + 3]) for i in range(len(data) - 2)]


def plain_languages(pages, docs):
    names = sorted({lang for _, lang in docs if lang})
    table = np.full((len(names), language.BUCKETS), 0.5)
    for text, lang in docs:
        if lang:
            for b in trigrams((text or "").encode()):
                table[names.index(lang), b] += 1
    table = np.log(table / table.sum(1, keepdims=True))
    k, rows = len(names), []
    for page_id, url, source in pages:
        shown = " ".join(re.sub(r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", source or "").split())
        found = trigrams(shown.encode())
        score = [sum(table[i, b] for b in found) / max(len(found), 1) * min(len(found), language.EVIDENCE) for i in range(k)]
        host = (re.match(r"(?s).*?://([^/?#]*)", url or "") or ["", ""])[1].lower()
        m = re.search(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", source or "")
        part = re.match(r"(?s).*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", url or "")
        rows.append({"page_id": page_id, "score": score, "guess": int(np.argmax(score)) if max(score) > min(score) else -1, "host": host or None, "domain": ".".join(host.split(".")[-2:]) if "." in host else None, "suffix": host.split(".")[-1] or None, "declared": m[1].lower() if m else None, "part": part[1].lower() if part else None})
    total = [sum(r["guess"] == i for r in rows) for i in range(k)]
    out = {}
    for r in rows:
        n = lambda key, i: sum(x["guess"] == i for x in rows if x is not r and r[key] is not None and x[key] == r[key])  # noqa: B023, E731
        fused = []
        for i in range(k):
            share = (total[i] + 1) / (sum(total) + k)
            for key in ("suffix", "domain", "host"):
                share = (n(key, i) + language.SMOOTH * share) / (sum(n(key, j) for j in range(k)) + language.SMOOTH)
            told = math.log(share)
            for key in ("declared", "part"):
                if r[key] is not None:
                    told += math.log((n(key, i) + 1) / (total[i] + k))
            fused.append(r["score"][i] + told)
        top = int(np.argmax(fused))
        out[r["page_id"]] = (names[top], 1 / sum(math.exp(f - fused[top]) for f in fused), names[r["guess"]] if r["guess"] >= 0 else None, r["declared"])
    return out


def test_fused_scores(spark):
    docs = [("the cat and the dog went to the house with them", "en"), ("der Hund und die Katze gingen mit dem Haus", "de"), ("le chat et le chien sont dans la maison avec eux", "fr"), (None, "en"), ("nothing told", None)]
    pages = []
    for i, (lang, words) in enumerate([("en", "the dog and the cat"), ("de", "die Katze und der Hund"), ("fr", "le chien et le chat"), ("de", "la"), ("en", "")] * 4):
        url = [f"https://www.a{i % 3}.de/de/x", f"http://b.example.fr/{'fr' if i % 2 else 'page'}/", "https://c.org", None, "no scheme"][i % 5 if i % 4 else (i // 4) % 5]
        pages.append((i, url, f"<html{f' lang={lang}' if i % 3 else ''}><title>der der der</title><!-- le le --><body><p>{html.escape(words)}</p><script>the the</script></body></html>"))
    pages += [(90, "https://www.a0.de/", None), (91, None, ""), (92, None, "<HTML class='x' LANG = 'FR-ca'>xy")]
    got = language.identified(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()
    want = plain_languages(pages, docs)
    assert len(got) == len(want)
    for r in got:
        lang, probability, text_lang, declared = want[r["page_id"]]
        assert (r["lang"], r["text_lang"], r["declared"]) == (lang, text_lang, declared) and abs(r["probability"] - probability) < 1e-9, (r, want[r["page_id"]])
