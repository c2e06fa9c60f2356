"""Main text of HTML pages: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

A page is cut into tags and texts once; open elements make a tree. Nodes are all elements but plain inline markup, which
lends its text and link counts to its node. The model scores every node from its own and its subtree's density, attribute
tokens, depth, siblings and ancestors. Each run of text straight in the body, or in plain inline tags there, has an anonymous
paragraph as its node. Decoding keeps or drops nodes with the best total score under one rule: what a
dropped node holds is dropped too. Kept texts are joined by block.

The model is fitted on at most TRAIN_PAGES pages of at most TRAIN_CHARS characters (the first by hash of the id): nodes in
or around the page's <article>, <main> or role=main count as content, others don't. Each page is also learned in
variants with another main element, with its paragraphs as lists, tables, preformatted text, figures and other blocks, with common
boilerplate of the same tags added and with texts straight in the body, so that no one tag decides.

Defined cases: null and empty html give an empty text; broken markup is read as far as it goes (an unclosed script ends with
the page); pages of any length are read whole; repeated rows give equal results; an empty table gives an empty result.
Character references are decoded and any white space, no-break spaces too, becomes one space within a block.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stepweave.llm.boosting import Boosted, fit
from stepweave.llm.sampling import bounded_sample

TRAIN_PAGES, TRAIN_CHARS = 200, 60_000

# fixed values: HTML's own vocabulary
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg audio video annotation select button head".split())
INLINE = frozenset("a abbr b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q rb rp rt ruby s samp semantics slot small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tr div section article main body".split())
# fixed values: words in class, id and role that speak for or against main text
BAD_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar comment comments respond reply discussion disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended widget login search form pagination pager copyright legal contentinfo complementary dialog".split())
GOOD_WORDS = frozenset("article content main body post entry story text page hentry blog column prose".split())
KINDS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "table", "figure", "h", "list")

_KIND = {t: i for i, t in enumerate(KINDS)} | {f"h{i}": KINDS.index("h") for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), KINDS.index("list"))
_LAST_BAD, _LAST_GOOD = KINDS.index("form"), KINDS.index("main")

# an attribute is a name, and a value in double quotes, in single quotes, or up to white space or the tag's end
_ATTR = re.compile(r"""(=?[^\s/>=]+|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?|=)*+)(?:>|\Z)|<[!?][^>]*>""", re.S)
_TELLING = frozenset(("class", "id", "role"))
MARK = "data-y"  # labels of made pages; where it occurs in a page, another name that doesn't
_WORD = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Page:
    """Nodes in page order, with parents, and text pieces (node, block, raw text).

    ``mark``: the attribute that labels nodes of made pages; pages of a corpus are read without one.
    """

    def __init__(self, source: str, mark: str | None = None) -> None:
        self.mark = mark
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.good, self.bad, self.label, self.start = [0], [0], [-1], [0]
        self.kind, self.depth, self.order, self.kids, self.above_bad, self.above_good = [len(KINDS)], [0], [0], [0], [0], [0]
        self.own, self.stops = [0], [0]
        self.links: dict[int, int] = {}
        self.tags: dict[int, int] = {}
        self.pieces: list[tuple[int, int, str]] = []
        self.seen = 0  # characters of text so far
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]  # tag, node
        block, at, in_link = 0, 0, 0
        bare, bare_block, told = 0, -1, -1  # the anonymous node of the body's text in this block, and the label of inline tags
        pos, end = 0, len(source)
        while pos < end:
            m = _TOKEN.search(source, pos)
            stop = m.start() if m else end
            if stop > pos:
                text = source[pos:stop]
                node = stack[-1][1]
                if not node and block != bare_block and not text.isspace():
                    bare, bare_block = self._add("p", 0, 0, 0, told), block
                if not node and block == bare_block:
                    node = bare
                self.pieces.append((node, block, text))
                self.own[node] += len(text)
                self.seen += len(text)
                self.stops[node] += text.count(".") + text.count(",")
                if in_link:
                    self.links[node] = self.links.get(node, 0) + len(text)
            if not m:
                break
            pos, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                if name == "a":
                    in_link = max(0, in_link - 1)
                if name not in INLINE:
                    block += 1
                continue
            if name in RAW:
                if name == "head":  # its parts are raw themselves, and it may lack an end
                    continue
                whole = _ATTR.sub("", m[3]).rstrip().endswith("/")  # <svg ... />; a slash of a last unquoted value is the value's
                close = _END[name].search(source, pos) if not whole else None
                pos = close.end() if close else (pos if whole else end)
                continue
            if name in ("html", "body"):
                continue
            if name in VOID:
                if name == "br":
                    node = stack[-1][1]
                    self.pieces.append((bare if not node and block == bare_block else node, block, " "))
                elif name == "hr":
                    block += 1
                continue
            if name in CLOSES_P or name in CLOSED_BY:
                goal = CLOSED_BY.get(name, ("p",))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in goal:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES and stack[k][0] not in goal:
                        break
            here = stack[-1][1]
            lends = bare if name in INLINE and not here and block == bare_block else here
            self.tags[lends] = self.tags.get(lends, 0) + 1
            good = bad = 0
            label = -1
            if m[3]:
                for a in _ATTR.finditer(m[3]):
                    said = a[1].lower()
                    if said not in _TELLING and said != self.mark:
                        continue
                    value = (a[2] or a[3] or a[4] or "").lower()
                    if said == self.mark:
                        label = int(value == "1")
                        continue
                    words = _WORD.findall(value)
                    good += sum(w in GOOD_WORDS for w in words)
                    bad += sum(w in BAD_WORDS for w in words)
            if name in INLINE and not (good or bad):
                if name == "a":
                    in_link += 1
                if label >= 0:
                    told = label
                stack.append((name, here))
                continue
            if name not in INLINE:
                block += 1
                told = -1
            at = self._add(name, here, good, bad, label)
            if name == "a":
                in_link += 1
            stack.append((name, at))

    def _add(self, name: str, here: int, good: int, bad: int, label: int) -> int:
        """A new node under ``here``."""
        at = len(self.tag)
        self.tag.append(name)
        self.parent.append(here)
        self.good.append(good)
        self.bad.append(bad)
        self.label.append(label)
        self.start.append(self.seen)
        self.own.append(0)
        self.stops.append(0)
        self.kind.append(_KIND[name] if name in _KIND else len(KINDS))
        self.depth.append(self.depth[here] + 1)
        self.order.append(self.kids[here])
        self.kids[here] += 1
        self.kids.append(0)
        self.above_bad.append(self.above_bad[here] + self.bad[here] + (self.kind[here] <= _LAST_BAD))
        self.above_good.append(self.above_good[here] + self.good[here] + (_LAST_BAD < self.kind[here] <= _LAST_GOOD))
        return at

    def ends(self) -> list[int]:
        """One past the last node of each node's subtree: nodes are in page order."""
        out = list(range(1, len(self.tag) + 1))
        for v in range(len(out) - 1, 0, -1):
            u = self.parent[v]
            if out[v] > out[u]:
                out[u] = out[v]
        return out

    def keep(self, logit: np.ndarray) -> list[bool]:
        """Kept nodes of the best decoding; the root stays, and texts of a node and its block weigh with their length."""
        n = len(self.tag)
        keep = (logit * (1 + np.log1p(self.own))).tolist()
        drop = [-x for x in keep]
        for v in range(n - 1, 0, -1):
            u = self.parent[v]
            drop[u] += drop[v]
            keep[u] += max(keep[v], drop[v])
        kept = [True] * n
        for v in range(1, n):
            kept[v] = kept[self.parent[v]] and keep[v] >= drop[v]
        return kept

    def text(self, kept: list[bool]) -> str:
        blocks: list[str] = []
        last, run = -1, []
        for node, block, raw in self.pieces:
            if block != last:
                blocks.append("".join(run))
                last, run = block, []
            if kept[node] and node:  # the root itself holds white space only
                run.append(raw)
        blocks.append("".join(run))
        out = (" ".join(entities.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in out if b)

    def labels(self) -> np.ndarray:
        """1 in, at or around main elements, 0 elsewhere; the mark decides for its subtree where it is given."""
        n = len(self.tag)
        y = np.zeros(n)
        for v in range(1, n):
            own = self.label[v]
            y[v] = own if own >= 0 else max(y[self.parent[v]], float(self.tag[v] in ("article", "main")))
        return self.around(y)

    def around(self, y: np.ndarray) -> np.ndarray:
        for v in range(len(y) - 1, 0, -1):
            if y[v]:
                y[self.parent[v]] = 1
        return y


def node_features(pages: list[Page]) -> np.ndarray:
    """One row for each node of each page, in order."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = lambda name: np.fromiter(chain.from_iterable(getattr(p, name) for p in pages), np.int64, int(sizes.sum())).astype(float)
    spread = lambda maps: np.concatenate([np.bincount(np.fromiter(m.keys(), np.int64, len(m)), np.fromiter(m.values(), np.int64, len(m)), n) for m, n in zip(maps, sizes)])
    own, kind, kids = flat("own"), flat("kind").astype(int), flat("kids")
    of = np.maximum(flat("parent").astype(int), 0) + first
    end = np.fromiter(chain.from_iterable(p.ends() for p in pages), np.int64, len(own)) + first
    parts = np.column_stack([own, flat("stops"), spread([p.links for p in pages]), spread([p.tags for p in pages]), kind == KINDS.index("p")])
    upto = np.vstack([np.zeros(5), np.cumsum(parts, 0)])
    sub = upto[end] - upto[:-1]
    text, safe, order = sub[:, 0], np.maximum(sub[:, 0], 1), flat("order")
    size = np.repeat([max(p.seen, 1) for p in pages], sizes)
    x = [flat("depth"), np.log1p(own), np.log1p(text), text / safe[first], sub[:, 2] / safe, sub[:, 1] / safe, safe / (sub[:, 3] + 1), sub[:, 4], flat("bad"), flat("good"), flat("above_bad"), flat("above_good"), order, kids[of], order / np.maximum(kids[of], 1), text / safe[of], flat("start") / size, kids]
    return np.column_stack([*x, *(kind == k for k in range(len(KINDS)))]).astype(float)


_MAIN = ('article', 'main', 'div class="post-content"', 'div id="content"', 'section class="entry-body"', 'div class="story"', "div", "section", 'div role="main"')
_EXTRA = (
    '<header class="site-header" data-y="0"><div class="logo">{a}</div><p>{b}</p></header>', '<header data-y="0"><h1>{a}</h1></header>', '<aside class="sidebar" data-y="0"><h3>{a}</h3><ul><li><a href="#">{a}</a></li><li><a href="#">{a}</a></li></ul><p>{b}</p></aside>', '<div id="sidebar" data-y="0"><p>{b}</p></div>',
    '<aside data-y="0"><p>{b}</p></aside>', '<div class="cookie-notice" data-y="0"><p>{b}</p><a href="#">{a}</a></div>', '<div id="consent" data-y="0">{b}</div>', '<form action="/s" data-y="0"><label>{a}</label><input name="q"><p>{b}</p></form>', '<section class="comments" data-y="0"><h3>{a}</h3><div class="comment"><p>{b}</p></div><div class="comment"><p>{b}</p></div></section>',
    '<div id="comments" data-y="0"><ol><li><p>{b}</p></li><li><p>{b}</p></li></ol></div>', '<div class="related" data-y="0"><a href="#">{a}</a> <a href="#">{a}</a></div>', '<div class="ad-banner" data-y="0">{b}</div>', '<div class="ad" data-y="0"><p>{b}</p></div>', '<div class="share social" data-y="0"><a href="#">{a}</a></div>', '<nav class="breadcrumb" data-y="0"><a href="#">{a}</a> &gt; <a href="#">{a}</a></nav>', '<div class="menu" data-y="0"><ul><li><a href="#">{a}</a></li><li><a href="#">{a}</a></li></ul></div>', '<footer data-y="0"><p>{b}</p></footer>', '<div class="footer" data-y="0">{b}</div>', '<div class="newsletter" data-y="0"><p>{b}</p></div>',
    '<ul data-y="0"><li><a href="#">{a}</a></li><li><a href="#">{a}</a></li><li><a href="#">{a}</a></li></ul>', '<ul class="menu" data-y="0"><li>{a}</li><li>{a}</li></ul>', '<table class="navigation" data-y="0"><tr><td><a href="#">{a}</a></td><td><a href="#">{a}</a></td></tr></table>', '<table class="sidebar" data-y="0"><caption>{a}</caption><tr><th>{a}</th><td>{b}</td></tr></table>', '<dl class="footer-links" data-y="0"><dt>{a}</dt><dd>{b}</dd></dl>',
    '<figure class="advert" data-y="0"><img src="x"><figcaption>{b}</figcaption></figure>', '<pre class="cookie" data-y="0">{b}</pre>', '<blockquote class="promo" data-y="0">{b}</blockquote>', '<aside data-y="0"><dl><dt>{a}</dt><dd>{b}</dd></dl><ol><li>{b}</li><li>{b}</li></ol></aside>', '<aside data-y="0"><table><tr><td>{a}</td><td>{b}</td></tr></table></aside>', '<footer data-y="0"><ul><li>{a}</li><li>{b}</li></ul><pre>{b}</pre></footer>', '<footer data-y="0"><table><tr><td>{a}</td><td>{a}</td></tr></table></footer>',
    '<nav data-y="0"><h2>{a}</h2><p>{b}</p><dl><dt>{a}</dt><dd>{a}</dd></dl></nav>', '<header data-y="0"><ul><li>{a}</li><li>{a}</li></ul><figure><figcaption>{b}</figcaption></figure></header>', '<form data-y="0"><table><tr><td>{a}</td><td><input></td></tr></table><ul><li>{b}</li></ul></form>', '<section id="comments" data-y="0"><h2>{a}</h2><ul class="comment-list"><li><p>{b}</p><pre>{b}</pre></li></ul></section>', '<div class="comments" data-y="0"><dl><dt>{a}</dt><dd>{b}</dd></dl><blockquote>{b}</blockquote><table><tr><td>{b}</td></tr></table></div>',
)
_PARAGRAPH = re.compile(r"<p\b[^>]*>(.*?)(?:</p>|(?=<p\b))", re.S | re.I)
_OPEN = re.compile(r"<(article|main)\b[^>]*>", re.I)


def reshaped(inner: str, rng: random.Random) -> str:
    """Main text with many of its paragraphs as other kinds of blocks."""

    def other(m: re.Match[str]) -> str:
        words = re.sub(r"<[^>]*>", " ", m[1]).split()
        if not words or rng.random() < 0.3:
            return m[0]
        words = words[: rng.choice((3, 12, 60, len(words)))]
        step = rng.randint(1, 14)
        parts = [" ".join(words[i : i + step]) for i in range(0, len(words), step)][:12]
        if rng.random() < 0.2:
            parts = [str(rng.randint(0, 9999)) for _ in parts]
        whole, head = " ".join(words), " ".join(words[:3])
        listed = "".join(f"<li>{x}</li>" for x in parts)
        cells = "".join(f"<tr><th>{x.split()[0]}</th><td>{x}</td><td>{i}</td></tr>" for i, x in enumerate(parts))
        return rng.choice((
            f"<ul>{listed}</ul>", f"<ol>{listed}</ol>", f"<p>{head}</p><ul>{listed}</ul>", f"<pre>{whole}</pre>", f"<pre><code>{head}\n {whole}</code></pre>", f"<blockquote>{whole}</blockquote>", f"<blockquote><p>{whole}</p></blockquote>",
            f"<table><caption>{head}</caption>{cells}</table>", f"<table><thead><tr><th>{head}</th></tr></thead><tbody>{cells}</tbody></table>", "<dl>" + "".join(f"<dt>{x.split()[0]}</dt><dd>{x}</dd>" for x in parts) + "</dl>", f'<figure><img src="x"><figcaption>{head}</figcaption></figure>', f"<figure><figcaption>{whole}</figcaption></figure>",
            f"<h2>{head}</h2><p>{whole}</p>", f"<h3>{head}</h3>", f"<h4>{head}</h4><div>{whole}</div>", f"<section><h2>{head}</h2><p>{whole}</p></section>", f"<details><summary>{head}</summary><p>{whole}</p></details>", f"<div>{whole}</div>", f"<p>{head} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>", f"<address>{head}</address>", f"<center>{whole}</center>",
        ))

    return _PARAGRAPH.sub(other, inner)


def _marked(fragment: str, mark: str) -> str:
    """Well-formed markup with its outermost blocks labelled as content."""
    out, depth, at = [], 0, 0
    for m in _TOKEN.finditer(fragment):
        if m[1]:
            depth -= 1
        elif m[2]:
            if not depth:
                out += [fragment[at : m.end(2)], f' {mark}="1"']
                at = m.end(2)
            depth += m[2].lower() not in VOID
    return "".join([*out, fragment[at:]])


def free_mark(source: str) -> str:
    """A name for labels that the page doesn't hold anywhere."""
    mark, low = MARK, source.lower()
    while mark in low:
        mark += "y"
    return mark


def variants(source: str, rng: random.Random, count: int = 5) -> list[str]:
    """The page, and versions of it with another main element and added boilerplate, labelled by ``free_mark`` of the page."""
    out, mark = [source], free_mark(source)
    m = _OPEN.search(source)
    if not m:
        return out
    close = re.search(rf"</{m[1]}\s*>", source[m.end() :], re.I)
    inner = source[m.end() : m.end() + close.start()] if close else source[m.end() :]
    head, tail = source[: m.start()], source[m.end() + close.end() :] if close else ""
    words = re.findall(r"[^\s<>&]+", re.sub(r"<[^>]*>", " ", inner))[:400] or ["x"]

    def extra() -> str:
        some = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
        return rng.choice(_EXTRA).replace(MARK, mark).format(a=some(1, 4), b=some(4, 60) + ".")

    for _ in range(count):
        main = rng.choice(_MAIN)
        mid = reshaped(inner, rng) if rng.random() < 0.8 else inner
        if rng.random() < 0.4 and "</p>" in mid:
            spots = [x.end() for x in re.finditer("</p>", mid)]
            k = rng.choice(spots)
            mid = mid[:k] + extra() + mid[k:]
        if rng.random() < 0.3:
            mid += extra()
        middle = f'<{main} {mark}="1">{mid}</{main.split()[0]}>'
        if rng.random() < 0.4:
            middle = f'<div class="{rng.choice(("wrapper", "container", "row", "page", "site"))}">{extra()}{middle}{extra()}</div>'
        before = "".join(extra() for _ in range(rng.randint(0, 3)))
        after = "".join(extra() for _ in range(rng.randint(0, 3)))
        out.append(head + before + middle + after + tail)
    return out + bare_variants(inner, head, tail, extra, rng, mark)


def bare_variants(inner: str, head: str, tail: str, extra: Callable[[], str], rng: random.Random, mark: str) -> list[str]:
    """The main texts, or some boilerplate, straight in the body: alone, with boilerplate around, and between paragraphs."""
    texts = [t.strip() for t in re.split(r"(?:<[^>]*>)+", inner) if t.strip()] or ["x"]

    def bare() -> str:
        some = texts[rng.randrange(len(texts)) :][: rng.randint(1, 6)]
        if rng.random() < 0.4:
            some = [" ".join(some[0].split()[: rng.randint(2, 12)])]
        return f'<span {mark}="1">{rng.choice(("<br><br>", "<br>", " ")).join(some)}</span>'

    part = lambda: f'<p {mark}="1">{rng.choice(texts)}</p>'
    blocks = lambda: "".join(_marked(reshaped(f"<p>{t}</p>", rng), mark) for t in texts[:8])
    links = rng.choice((" | ", " ", " &gt; ")).join(f'<a href="#">{t[:12]}</a>' for t in texts[: rng.randint(2, 5)])
    return [
        f"<body>{bare()}</body>",
        head + extra() + bare() + extra() + tail,
        head + bare() + tail,
        f"<body>{part()}{bare()}{part()}</body>",
        f"<body>{extra()}{blocks()}{extra()}</body>",
        head + extra() + blocks() + tail,
        f'{head}<span {mark}="0">{links}</span><div {mark}="1">{inner}</div><span {mark}="0">&copy; {texts[0][:20]}</span>{tail}',
    ]


def _seed_pages(rng: random.Random) -> list[str]:
    """A few plain pages, so that an empty table gives a model too."""
    word = lambda: "".join(rng.choice("abdeghilmnorstuw") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    return [f'<html><body><nav><ul><li><a href="#">{word()}</a></li><li><a href="#">{word()}</a></li></ul></nav><article><h1>{prose(6)}</h1>' + "".join(f"<p>{prose(rng.randint(5, 90))}</p>" for _ in range(rng.randint(1, 9))) + f"</article><footer>{prose(8)}</footer></body></html>" for _ in range(20)]


def train(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> Boosted:
    """Fit on at most ``max_pages`` pages of at most TRAIN_CHARS characters."""
    fit_pages = pages.select("page_id", "html").filter(F.length("html") <= TRAIN_CHARS)
    rows = sorted(bounded_sample(fit_pages, ["page_id", "html"], max_pages).collect(), key=lambda r: (r["page_id"] is None, r["page_id"], r["html"]))
    rng, x, y = random.Random(5), [], []
    for source in [*(r["html"] for r in rows), *_seed_pages(rng)]:
        for one in variants(source, rng):
            page = Page(one, free_mark(source))
            label = page.labels()
            if label.any():
                x.append(node_features([page])[1:])
                y.append(label[1:])
    return fit(np.concatenate(x), np.concatenate(y))


def extracted(pages: DataFrame, model: Boosted) -> DataFrame:
    """(page_id, url, text, n_chars, kept_nodes, nodes), a row for each page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                parsed = [Page(h or "") for h in part.column(2).to_pylist()]
                logit = np.split(model.logit(node_features(parsed)), np.cumsum([len(p.tag) for p in parsed])[:-1])
                kept = [p.keep(v) for p, v in zip(parsed, logit)]
                text = [p.text(k) for p, k in zip(parsed, kept)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([sum(k) for k in kept], pa.int64()), pa.array([len(k) for k in kept], pa.int64())], ["page_id", "url", "text", "n_chars", "kept_nodes", "nodes"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, kept_nodes long, nodes long")
