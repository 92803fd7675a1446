"""Main text of web pages: boosted trees over DOM nodes, decoded as one consistent tree.

A forgiving parser builds the element tree of the whole page. Every block element, and
every run of text between blocks, has features of its format (tag, attribute tokens,
depth, siblings) and of its subtree (text, links, tags, punctuation). Boosted trees,
trained in numpy on generated labelled pages, give each node the probability that main
text lies in it. Decoding takes the most probable labelling in which a node without main
text has no descendant with it and a node with it has no ancestor without.

Parsing is linear in the page: an end tag is looked up in counts of open elements, and the
ends of elements that are skipped whole are matched in one pass before.

Defined results: null or empty html gives an empty text; tags that are never closed end
with their parent, at any depth; text inside scripts, styles and the like is never main
text, and those that are never closed run to the end of the page; buttons, drawings,
players and the like are skipped up to their end tag, or up to the next tag where they
have none inside their parent; input columns named like the new ones are replaced;
repeated rows repeat.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftgraph.llm.boost import Boosted, fit
from weftgraph.llm.common import map_texts, table

FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
TREES, DEPTH, PAGES, SEED = 80, 5, 1500, 13

# Element names of the HTML standard, by their part in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
SKIPPED = frozenset("noscript template svg math object head select button canvas audio video".split())
NO_BOUNDARY = frozenset("svg math button select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opening tag ends an open element of its set, up to the nearest scope.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table div article section body html main aside nav header footer form".split())
GROUPS = [
    {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"li", "ul", "ol", "dl", "dt", "dd"},
    {"article", "main"},
    {"section"},
    {"div"},
    {"nav", "menu"},
    {"header"},
    {"footer"},
    {"aside"},
    {"form", "fieldset", "dialog"},
    {"table", "tbody", "thead", "tr", "td", "th"},
    {"#text"},
    {"blockquote", "pre", "figure", "figcaption"},
    {"html", "body", "#root"},
]
TOKENS = [
    set("content article main post story entry text body prose page hentry articlebody".split()),
    set("nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs links".split()),
    set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion outbrain taboola dfp".split()),
    set("comment comments reply replies respond discussion disqus reader readers thread reviews".split()),
    set("share social related recommended cookie cookies consent notice notification alert popup modal newsletter subscribe signup login search widget tags meta".split()),
    set("footer header masthead sidebar side aside rail secondary copyright topbar bottom site".split()),
]
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
_MAIN, _OUT = frozenset({"article", "main"}), frozenset("nav menu header footer aside form fieldset dialog".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: What stands between a tag's name and its >: attributes, whose values may be quoted and of any length.
_REST = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+""")
#: Comments and raw text, to their end or that of the page, and other tags.
_PAIRED = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?)([a-z][^\s/>]*)", re.I | re.S)
_LABEL = re.compile(r'data-y="(\d)"')
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[a-z0-9]+")


class Dom:
    """Nodes in page order (parents first) and runs of text between block boundaries."""

    def __init__(self) -> None:
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.runs: list[tuple[int, list[str], int]] = []  # owner, pieces, characters in links

    def add(self, tag: str, parent: int, attrs: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        return len(self.tag) - 1


def _tag_end(page: str, at: int) -> int:
    """The position after the > that ends a tag, quoted values skipped; a quote that is never closed is none."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    if "=" not in page[at:end]:
        return end + 1
    rest = _REST.match(page, at).end()
    return (rest if page.startswith(">", rest) else end) + 1


def skipped_ends(page: str) -> dict[int, int]:
    """For each SKIPPED element, by the position of its tag, that of its end tag inside its parent.

    One pass: a stack of open elements in which an end tag closes what is open inside it.
    Buttons and selects do not nest, so a second one ends the first.
    """
    out: dict[int, int] = {}
    if not any(f"<{t}" in page or f"<{t.upper()}" in page for t in SKIPPED):
        return out
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    for m in _PAIRED.finditer(page):
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in VOID or tag in INLINE or tag in RAW or tag == "p" or tag in IMPLIED:
            continue  # these are often left open and never hold the others' ends
        if not m[2]:
            while tag in ("button", "select") and count.get(tag):
                top, _ = stack.pop()
                count[top] -= 1
            stack.append((tag, m.start()))
            count[tag] = count.get(tag, 0) + 1
        elif count.get(tag):
            while True:
                top, at = stack.pop()
                count[top] -= 1
                if top == tag:
                    break
            if tag in SKIPPED:
                out[at] = m.start()
    return out


class _Frame:
    """An open block element and the inline elements open in it."""

    __slots__ = ("counts", "inlines", "node", "scope", "tag")

    def __init__(self, tag: str, node: int, scope: dict) -> None:
        self.tag, self.node, self.scope = tag, node, scope  # scope: open block tags by count since the nearest SCOPE element
        self.inlines: list[str] = []
        self.counts: dict[str, int] = {}


def parse(page: str | None) -> Dom:
    dom = Dom()
    page = page or ""
    stack = [_Frame("#root", 0, {})]
    opened: dict[str, int] = {}  # block tags open anywhere
    run: list[str] = []
    link = links = 0
    at, n = 0, len(page)
    ends = skipped_ends(page)

    def boundary() -> None:
        nonlocal run, links
        if run:
            if any(not r.isspace() for r in run):
                dom.runs.append((stack[-1].node, run, links))
            run = []
        links = 0

    def pop_through(tags) -> None:
        """Close blocks up to the nearest of some tags."""
        nonlocal link
        boundary()
        while True:
            top = stack.pop()
            link -= top.counts.get("a", 0)
            opened[top.tag] -= 1
            if top.tag not in SCOPE:
                top.scope[top.tag] -= 1
            if top.tag in tags:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            run.append(page[at:lt])
            if link:
                links += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # <!--> is a comment too
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                run.append("<")
                at = lt + 1
            continue
        tag = m[2].lower()
        at = _tag_end(page, m.end())
        top = stack[-1]
        if m[1]:
            if tag in INLINE:
                if top.counts.get(tag):
                    while True:
                        last = top.inlines.pop()
                        top.counts[last] -= 1
                        link -= last == "a"
                        if last == tag:
                            break
            elif tag not in VOID and opened.get(tag):
                pop_through((tag,))
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                boundary()
            continue
        if tag in RAW or tag in SKIPPED:
            if not page.startswith("/>", at - 2):
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else n
                elif lt in ends:
                    at = _tag_end(page, max(ends[lt], at))
                elif tag not in ("head", "noscript", "template"):
                    at = n if (end := page.find("<", at)) < 0 else end
            if tag not in NO_BOUNDARY:
                boundary()
            continue
        if tag in INLINE:
            top.inlines.append(tag)
            top.counts[tag] = top.counts.get(tag, 0) + 1
            link += tag == "a"
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            closes = [t for t in ("p", *IMPLIED.get(tag, ())) if top.scope.get(t) and (t != "p" or tag in CLOSES_P)]
            if closes:
                pop_through(closes)
        boundary()
        top = stack[-1]
        if tag not in SCOPE:
            top.scope[tag] = top.scope.get(tag, 0) + 1
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Frame(tag, dom.add(tag, top.node, page[m.end() : at]), {} if tag in SCOPE else top.scope))
    boundary()
    return dom


def _prepare(dom: Dom) -> tuple[list[str], list[tuple[int, int]]]:
    """Decoded texts of the runs; mixed elements get a #text child for each of their runs."""
    mixed = set(dom.parent)
    texts, owners = [], []
    for owner, pieces, links in dom.runs:
        text = " ".join(entities.unescape("".join(pieces)).split())
        node = dom.add("#text", owner) if owner in mixed else owner
        texts.append(text)
        owners.append((node, links))
    return texts, owners


def features(dom: Dom, texts: list[str], owners: list[tuple[int, int]]) -> np.ndarray:
    n = len(dom.tag)
    chars, links, words, points, tags, para, mains, outs = (np.zeros(n) for _ in range(8))
    before = np.full(n, -1.0)
    total = 0
    for text, (node, link) in zip(texts, owners, strict=True):
        if before[node] < 0:
            before[node] = total
        total += len(text)
        chars[node] += len(text)
        links[node] += min(link, len(text))
        words[node] += text.count(" ") + 1
        points[node] += text.count(".") + text.count(",") + text.count(";") + text.count(":") + text.count("?")
    group = np.array([_GROUP.get(t, 5) for t in dom.tag])
    parent = dom.parent
    para[group == 0] = chars[group == 0]
    n_para = (group == 0).astype(float)
    mains[[i for i, t in enumerate(dom.tag) if t in _MAIN]] = 1
    outs[[i for i, t in enumerate(dom.tag) if t in _OUT]] = 1
    own = np.zeros((n, len(TOKENS)))
    above = np.zeros((n, 4))  # an ancestor: main, out, attribute speaks for main, speaks against
    depth = np.zeros(n)
    nth, count = np.zeros(n), np.zeros(n)
    kin: dict[tuple[int, str], int] = {}
    for i in range(n):
        p = parent[i]
        if dom.attrs[i]:
            found = {t for a in _ATTR.findall(dom.attrs[i]) for t in _TOKEN.findall("".join(a).lower())}
            if found:
                own[i] = [len(found & k) > 0 for k in TOKENS]
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = above[p]
            above[i, 0] = max(above[i, 0], mains[p])
            above[i, 1] = max(above[i, 1], outs[p])
            above[i, 2] = max(above[i, 2], own[p, 0])
            above[i, 3] = max(above[i, 3], own[p, 1:].max())
            nth[i] = count[p]
            count[p] += 1
            kin[p, dom.tag[i]] = kin.get((p, dom.tag[i]), 0) + 1
    siblings = np.array([count[p] if p >= 0 else 1 for p in parent])
    same = np.array([kin.get((p, t), 1) for p, t in zip(parent, dom.tag, strict=True)])
    tags += 1
    down = [chars, links, words, points, tags, para, n_para]
    below = [mains.copy(), outs.copy()]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in down:
            a[p] += a[i]
        for a in below:
            a[p] += a[i]
        if before[i] >= 0 and (before[p] < 0 or before[i] < before[p]):
            before[p] = before[i]
    size = np.maximum(chars, 1)
    up = np.array([p if p >= 0 else 0 for p in parent])
    out = [
        np.log1p(chars), links / size, np.log1p(words), points / size, np.log1p(tags), np.log1p(chars / tags), depth, nth, siblings - nth - 1, np.log1p(same),
        para / size, np.log1p(n_para), below[0], below[1], chars / max(total, 1), np.maximum(before, 0) / max(total, 1), links[up] / size[up], np.log1p(siblings),
    ]
    hot = np.zeros((n, len(GROUPS)))
    hot[np.arange(n), group] = 1
    return np.column_stack([*out, own, above[:, :2], hot, above[:, 2:]]).astype(np.float32)


def decode(dom: Dom, p: np.ndarray) -> np.ndarray:
    """The most probable labelling without contradiction between ancestors and descendants."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    n = len(p)
    in_, out = yes.tolist(), no.tolist()  # best scores of subtrees: node with main text, without
    parent = dom.parent
    for i in range(n - 1, 0, -1):
        in_[parent[i]] += max(in_[i], out[i])
        out[parent[i]] += out[i]
    keep = np.zeros(n, bool)
    for i in range(n):
        keep[i] = in_[i] > out[i] and (i == 0 or keep[parent[i]])
    return keep


#: Nodes that trees see at once.
NODES = 50_000


def scores_of(model: Boosted, x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[model.probability(x[i : i + NODES]) for i in range(0, len(x), NODES)]])


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    out, waiting, nodes = [], [], 0

    def flush() -> None:
        nonlocal waiting, nodes
        if waiting:
            scores, at = scores_of(model, np.concatenate([x for *_, x in waiting])), 0
            for dom, texts, owners, x in waiting:
                keep = decode(dom, scores[at : at + len(x)])
                at += len(x)
                out.append("\n\n".join(t for t, (node, _) in zip(texts, owners, strict=True) if t and keep[node]))
        waiting, nodes = [], 0

    for page in pages:
        dom = parse(page)
        texts, owners = _prepare(dom)
        waiting.append((dom, texts, owners, features(dom, texts, owners)))
        nodes += len(dom.tag)
        if nodes >= NODES:
            flush()
    flush()
    return out


def made_page(rng: random.Random) -> str:
    """A generated page; data-y="1" marks elements whose direct text is main text."""
    stock = ["an", "ber", "con", "dé", "el", "fir", "ge", "ha", "in", "ka", "lo", "mi", "no", "per", "ra", "sto", "ti", "un", "ver", "wo", "the", "ñe"]
    word = lambda: "".join(rng.choices(stock, k=rng.randint(1, 4)))
    junk = rng.choice(["", "", "", "$$$", "&amp;&amp;", " |", "!!"])

    def sentence(least=3, most=18):
        w = [word() for _ in range(rng.randint(least, most))]
        return " ".join(x + junk for x in w).capitalize() + rng.choice([".", ".", ".", ",", "?"])

    def prose(most=6):
        return " ".join(sentence() for _ in range(rng.randint(1, most)))

    name = lambda *c: f' {rng.choice(["class", "class", "id"])}="{rng.choice(c)}"'
    links = lambda k: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))
    end = lambda t: rng.choice([f"</{t}>", f"</{t}>", f"</{t}>", ""])

    def ad():
        return rng.choice([f'<div{name("ad", "ads", "advert", "banner", "sponsored", "promo-box", "ad-slot")}>{prose(3)}</div>', f'<aside{name("promo", "ad")}><p>{prose(2)}</p></aside>', f'<div class="ad-banner"><a href="x">{sentence(2, 8)}</a></div>'])

    def heading():
        """One word or more, with or without a full stop."""
        return sentence(1, 9) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 8))).capitalize()

    def aside():
        """What stands inside an article but is not its text."""
        kind = rng.random()
        if kind < 0.45:
            return ad()
        if kind < 0.7:
            return f'<div{name("share", "social-share", "related", "newsletter-signup")}><p>{sentence(2, 6)}</p><ul>{links(3)}</ul></div>'
        if kind < 0.85:
            return f'<div{name("notice", "alert", "notice-box")}>{sentence(2, 12)}</div>'
        return f"<form><label>{word()}</label><input><p>{sentence(2, 6)}</p><button>{word()}</button></form>"

    def block():
        """One or more elements of main text."""
        kind = rng.random()
        if kind < 0.62:
            return f'<p data-y="1">{prose() if rng.random() < 0.85 else sentence(1, 4)}' + end("p")
        if kind < 0.72:
            return f'<{(t := rng.choice(["h2", "h2", "h3", "h4"]))} data-y="1">{heading()}</{t}>'
        if kind < 0.79:
            t = rng.choice(["ul", "ul", "ol"])
            return f"<{t}>" + "".join(f'<li data-y="1">{sentence(1, 12)}{end("li")}' for _ in range(rng.randint(1, 6))) + f"</{t}>"
        if kind < 0.83:
            return f'<blockquote data-y="1">{prose(2)}</blockquote>' if rng.random() < 0.5 else f'<blockquote><p data-y="1">{prose(2)}</p></blockquote>'
        if kind < 0.87:
            return "<table>" + "".join(f'<tr><td data-y="1">{word()}</td><td data-y="1">{sentence(1, 4)}</td></tr>' for _ in range(rng.randint(2, 4))) + "</table>"
        if kind < 0.9:
            return f'<pre data-y="1">{heading()}</pre>'
        if kind < 0.93:
            return f'<figure><img src="a.png"><figcaption data-y="1">{sentence(1, 10)}</figcaption></figure>'
        if kind < 0.96:
            return f'<p data-y="1">{sentence()} <a href="/{word()}">{word()} {word()}</a> {sentence()}</p>'
        return f'<div{rng.choice(["", name("text", "paragraph", "block")])} data-y="1">{prose()}</div>'

    def article_parts():
        title = heading() if rng.random() < 0.7 else sentence(3, 10)
        tag = rng.choice(["h1", "h1", "h1", "h2"])
        head = f'<{tag}{rng.choice(["", "", name("title", "headline", "entry-title")])} data-y="1">{title}</{tag}>'
        if rng.random() < 0.15:
            head = f'<header>{head}<p class="byline">{word()} {word()}</p></header>' if rng.random() < 0.5 else f"<header>{head}</header>"
        if rng.random() < 0.95:
            yield head
        if rng.random() < 0.5:
            yield f'<p data-y="1"><b>{title if rng.random() < 0.6 else prose(2)}<br>'
        n = rng.choice([0, 0, 1, 2, 3, 5, 9, 14])
        cut = rng.randrange(n + 1) if n > 2 and rng.random() < 0.25 else None
        for i in range(n):
            if i == cut:
                yield rng.choice(["<section>", "<div>", f"<div{name('body', 'text', 'entry')}>"])
            yield block()
            if rng.random() < 0.07:
                yield aside()
        if cut is not None and cut < n:
            yield "</section></div>"

    def comments():
        one = lambda: f'<{(t := rng.choice(["div", "li", "article", "div"]))}{name("comment", "reply", "comment-body")}><p>{prose(3)}</p></{t}>'
        return f'<{(t := rng.choice(["div", "section"]))}{name("comments", "comment-list", "reader-comments", "discussion")}>' + (f"<h3>{word()}</h3>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{t}>"

    before, after = [], []
    if rng.random() < 0.8:
        before.append(rng.choice([f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", f'<div{name("nav", "menu", "navbar")}><ul>{links(rng.randint(3, 9))}</ul></div>', f"<nav>{' '.join(f'<a href=x>{word()}</a>' for _ in range(5))}</nav>"]))
    if rng.random() < 0.4:
        before.insert(0, f'<header{rng.choice(["", name("site-header", "header", "masthead")])}><h1>{word()}</h1><p>{sentence(2, 6)}</p></header>')
    if rng.random() < 0.2:
        before.append(f'<div{name("breadcrumb", "breadcrumbs")}><a href="/">{word()}</a> &gt; {word()}</div>')
    if rng.random() < 0.6:
        before.append("<!-- ad 1 -->" + ad())
    if rng.random() < 0.25:
        rng.choice([before, after]).append(f'<div{name("cookie", "cookie-notice", "notice", "alert", "consent")}>{prose(2)}</div>')
    if rng.random() < 0.3:
        rng.choice([before, after]).append(f'<{(t := rng.choice(["aside", "div"]))}{name("sidebar", "side", "widget", "rail")}><h3>{word()}</h3><ul>{links(4)}</ul><p>{prose(2)}</p></{t}>')
    if rng.random() < 0.3:
        after.append(comments())
    if rng.random() < 0.2:
        after.append(f'<div{name("related", "recommended")}><h3>{word()}</h3><ul>{links(4)}</ul></div>')
    if rng.random() < 0.2:
        after.append(f"<form><p>{sentence(2, 6)}</p><label>{word()}</label><input><button>{word()}</button></form>")
    if rng.random() < 0.25:
        after.append(ad())
    if rng.random() < 0.85:
        after.append(rng.choice([f"<footer>&copy; {word()} &middot; {prose(2)}</footer>", f"<footer><p>{prose(2)}</p><ul>{links(3)}</ul></footer>", f'<div{name("footer", "site-footer")}>&copy; {sentence(2, 8)}</div>']))
    body = "".join(article_parts())
    kind = rng.random()
    if kind < 0.55:
        body = f'<article{rng.choice(["", "", name("post", "entry", "h-entry")])}>{body}</article>'
    elif kind < 0.7:
        body = f"<main>{body}</main>" if rng.random() < 0.5 else f"<main><article>{body}</article></main>"
    elif kind < 0.93:
        body = f'<div{name("content", "article-body", "post", "main-content", "entry-content", "story")}>{body}</div>'
    else:
        body = f"<div>{body}</div>"
    if rng.random() < 0.15:
        body = body.rsplit("</", 1)[0] + comments() + "</" + body.rsplit("</", 1)[1]
    inner = "".join(before) + body + "".join(after)
    if rng.random() < 0.3:
        inner = f'<div{name("page", "wrapper", "container", "site")}>{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{word()}</title><script>var a = '<p>';</script></head><body>{inner}" + rng.choice(["</body></html>", ""])


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a generated page's nodes, and whether main text lies in each."""
    dom = parse(page)
    marks = [bool(_LABEL.search(a)) for a in dom.attrs]
    texts, owners = _prepare(dom)
    y = np.zeros(len(dom.tag))
    for node, _ in owners:
        own = marks[node] if node < len(marks) else marks[dom.parent[node]]
        while own and node >= 0:
            y[node] = 1
            node = dom.parent[node]
    return features(dom, texts, owners), y


_MODEL: dict[tuple, Boosted] = {}


def model(seed: int = SEED, pages: int = PAGES) -> Boosted:
    """Trees fitted on `pages` generated pages; once a process, as seed and size decide."""
    if (seed, pages) not in _MODEL:
        rng = random.Random(seed)
        x, y = zip(*(labelled(made_page(rng)) for _ in range(pages)), strict=True)
        _MODEL[seed, pages] = fit(np.concatenate(x), np.concatenate(y), TREES, DEPTH)
    return _MODEL[seed, pages]


def extract_main(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, trees: Boosted | None = None) -> DataFrame:
    """`pages` with `text`, the main text of the whole html, and `n_chars`, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())  # some kilobytes

    def make():
        def run(htmls):
            texts = main_texts(htmls, shared.value) if htmls else []
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_texts(pages, html_col, FIELDS, make, keep)


def op1_htmlmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", "n_chars")
