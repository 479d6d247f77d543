"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Tags score negative, by name. Words score by the log odds of their run of text to be content:
a sum of weights of the elements around it, of the words of their classes, ids and roles, and of the run's own length, end and links;
so words are positive in prose and negative in menus, whatever the container is called. All weights come from labelled pages. An
element whose words add up to less than nothing, by more than its best run holds, and whose best run is short counts as one tag with a bounded penalty, so an advertisement
within an article is left out and does not cut the article. One linear scan over what remains finds the contiguous run of the highest sum:
the content region. No name excludes anything by itself; only what is no text at all (scripts, styles, titles, comments) is skipped.

The data have no labelled pages, so `labelled_pages` makes some by rules: articles among menus, side bars, notices, comments
and footers, some of which are prose, and articles with sections and class words that elsewhere mark such things. `fit` takes any other
(html, spans of content) pairs just as well.

Tags are read by the states of an HTML tokenizer: quotes in unquoted values are characters. Character references are decoded within each
piece of text, so they never form across tags. Elements that are open are counted by name: time is linear in the page.

Defined results: null, empty and markup-only pages have an empty text; unclosed and misnested tags are closed where HTML closes
them; the whole page is read, whatever its length; each row is judged by itself; `extract` keeps other columns.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?+)?+"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)")
OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</[^a-zA-Z>][^>]*+>?|</>", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]++))?+""")
#: Elements whose content is not markup.
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
INLINE = frozenset(["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"])
SHUTS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SHUTS_OWN = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: What holds the page itself is no part that could be left out of it.
FRAMES = frozenset(["html", "body", "main"])
#: Bounds of a word's and of a tag's score, the most that a left-out element costs, and the sum from which a run within an element keeps it.
WORD_MOST, TAG_MOST, PENALTY, GOOD_RUN = 2.0, 1.5, 1.5, 12.0


@lru_cache(4096)
def _marks(tag: str, attrs: str) -> frozenset[str]:
    """Features of an element: its name, the words of its classes, ids and roles, and whether it is hidden."""
    out = {f"in:{tag}"}
    if tag in ("html", "body") or not attrs.strip(" /\t\n\r\f"):  # classes of the whole page tell what it has somewhere
        return frozenset(out)
    found = {k.lower(): v.strip("\"'") for k, v in reversed(ATTRIBUTE.findall(attrs))}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        out.add("hidden")
    for name in f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split():
        out |= {f".{w}" for w in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w}
    return frozenset(out)


def _of_run(text: str, n: int, block: str, linked: bool) -> tuple[str, ...]:
    """Features of a run of text of n words whose nearest block element is `block`."""
    ends = "ends" if text.rstrip()[-1:] in ".!?:;…。" else "open"
    return f"words:{min(n.bit_length(), 6)}", ends, f"{'link' if linked else 'at'}:{block}"


def events(page: str) -> Iterator[tuple]:
    """What a page consists of, in order: ("text", its decoded text), ("tag", name), ("open", name, features) and ("close", name)."""
    stack: list[str] = []
    where: dict[str, list[int]] = {}
    blocks: list[int] = []
    at, end = 0, len(page)

    def shut(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            name = stack.pop()
            where[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            yield "close", name

    def deepest(names: tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            yield "text", html.unescape(page[at:stop])
            at = stop
            continue
        m = TAG.match(page, at)
        if not m:
            m = OTHER.match(page, at)
            if m:
                at = m.end()
            else:
                yield "text", "<"
                at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            yield "tag", tag
            depth = deepest((tag,))
            # a block element is not closed by the end of an inline one around it
            if depth >= 0 and (tag not in INLINE or not blocks or blocks[-1] < depth):
                yield from shut(depth)
            continue
        if tag in SHUTS_P and (depth := deepest(("p",))) >= 0:
            yield from shut(depth)
        if tag in SHUTS_OWN:
            own, within = SHUTS_OWN[tag]
            # of several that end here, the outermost below the container
            bound = deepest(within)
            places = [where[n][-1] for n in own if where.get(n) and where[n][-1] > bound]
            if places:
                yield from shut(min(places))
        if tag == "body" and (depth := deepest(("head",))) >= 0:  # an unclosed head ends here
            yield from shut(depth)
        yield "tag", tag
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = _closing(tag).search(page, at)
            at = (page.find(">", close.start()) + 1 or end) if close else end
            continue
        where.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(tag)
        yield "open", tag, _marks(tag, m[3] if len(m[3]) < 1000 else m[3][:1000])
    yield from shut(0)


@lru_cache(None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}[\\s/>]", re.I)


def runs(page: str) -> list[tuple[str, set[str]]]:
    """The runs of text with words and the features of each, for training."""
    apart = _has_article(page)
    opened: list[frozenset[str]] = []
    blocks = ["page"]
    out = []
    for kind, what, *more in events(page):
        if kind == "open":
            opened.append(more[0])
            blocks += [] if what in INLINE else [what]
        elif kind == "close":
            opened.pop()
            if what not in INLINE:
                blocks.pop()
        elif kind == "text" and (n := len(what.split())):
            around = set().union(*opened)
            if apart and not around & {"in:article", "in:main"}:
                around.add("apart")
            out.append((what, around | set(_of_run(what, n, blocks[-1], "in:a" in around))))
    return out


def _has_article(page: str) -> bool:
    return re.search(r"<(?:article|main)[\s>]", page, re.I) is not None


class Weights:
    """words: the weight of each feature of a run of text; tags: the score of each tag."""

    def __init__(self, words: dict[str, float], tags: dict[str, float], bias: float, other_tag: float) -> None:
        self.words, self.tags, self.bias, self.other_tag = words, tags, bias, other_tag


def fit(pages: list[tuple[str, list[str]]], rounds: int = 400, pull: float = 1e-5) -> Weights:
    """Weights from labelled pages: (html, the runs of text that are content, in order).

    Words: logistic regression on the features of each run, a run counting as the root of its words. Tags: smoothed log odds of a tag to
    stand between two runs of content, negative and bounded.
    """
    seen, y, size = [], [], []
    inside, outside = {}, {}
    for page, content in pages:
        wanted, k = [" ".join(c.split()) for c in content], 0
        before, held = False, []
        for kind, what, *_ in events(page):
            if kind == "tag":
                held.append(what)
            elif kind == "text" and what.split():
                own = k < len(wanted) and " ".join(what.split()) == wanted[k]
                k += own
                y.append(own)
                for t in held:
                    side = inside if own and before else outside
                    side[t] = side.get(t, 0) + 1
                before, held = own, []
        assert k == len(wanted), "content that is not in the page"
        for text, features in runs(page):
            seen.append(features)
            size.append(math.sqrt(len(text.split())))
    names = {f: i for i, f in enumerate(sorted(set().union(*seen)))}
    row = np.repeat(np.arange(len(seen)), [len(f) for f in seen])
    column = np.array([names[f] for features in seen for f in sorted(features)])
    want, share = np.array(y, float), np.array(size) / sum(size)
    w, b = np.zeros(len(names)), 0.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the mean loss, with a weak pull of the weights to 0
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(seen)) + b, -30, 30)))
        d = (p - want) * share
        g, gb = np.bincount(column, d[row], len(names)) + pull * w, d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w, b = w - 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-9), b - 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    score = lambda t: max(-TAG_MOST, min(-0.1, math.log((inside.get(t, 0) + 1) / total_in) - math.log((outside.get(t, 0) + 1) / total_out)))
    return Weights({f: float(w[i]) for f, i in names.items()}, {t: score(t) for t in inside | outside}, float(b), -0.5)


#: Class words of the labelled pages: of what is never an article's, of what is not when it is short or links, and of articles.
_NEVER = "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay comment comments replies reply disqus sidebar widget widgets paywall disclaimer".split()
_SHORT = "banner notice notices respond discussion menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended recommendations toolbar pagination pager login search alert skip".split()
_ARTICLE = "content article main post entry body story text".split()


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages by rules, each with the runs of text of its article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda a, b: say(a, b).capitalize() + r.choice("...!?")
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 4)}</a></li>' for _ in range(r.randint(3, 12))) + "</ul>"
    name = lambda names, more=(): r.choice(["class", "id"]) + "='" + r.choice(["{}", "{}", "{}-box", "site-{}", "{}-{}"]).format(r.choice(names), r.choice([*names, *more])) + "'"
    out = []
    for i in range(n):
        own: list[str] = []

        def mine(text: str) -> str:
            own.append(text)
            return text

        def stray() -> str:
            """Something that is not the article's, wherever it stands."""
            kind = r.randrange(10)
            if kind < 3 or kind == 9:
                return f"<div {name(_NEVER, _SHORT)}>{r.choice([say(1, 14), f'<p>{prose(8, 40)}</p>', f'<p>{prose(5, 20)}</p><p>{prose(5, 30)}</p>', links()])}</div>"
            if kind == 3:
                return f"<aside {name(_SHORT + _NEVER) if r.random() < 0.6 else ''}>{r.choice([links(), f'<h3>{say(1, 3)}</h3>' + links(), f'<p>{prose(5, 25)}</p>'])}</aside>"
            if kind == 4:
                return f"<div {name(_SHORT)}>{r.choice([links(), say(1, 4)])}</div>"
            if kind == 5:
                return f"<form><label>{say(1, 3)}</label><input><p>{prose(3, 25)}</p><button>{say(1, 2)}</button></form>"
            if kind == 6:
                return f"<section {name(['comments', 'comment'])}><h3>{say(1, 3)}</h3><p>{prose(5, 40)}</p><p>{prose(5, 40)}</p></section>"
            if kind == 7:
                return f"<nav>{links()}</nav>"
            return f"<{r.choice(['div hidden', 'div aria-hidden=true', 'noscript', 'template', 'select', 'dialog', 'menu'])}>{prose(2, 20)}</div>"

        def part() -> str:
            kind = r.randrange(10)
            if kind == 0:
                return "<ul>" + "".join(f"<li>{mine(say(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if kind == 1:
                return f"<blockquote><p>{mine(prose(5, 40))}</p></blockquote>"
            if kind == 2:
                return f"<section {name(_ARTICLE + _SHORT)}><h2>{mine(say(1, 7))}</h2><p>{mine(prose(20, 90))}</p><p>{mine(prose(20, 60))}</p></section>"
            if kind == 3:
                return f"<div {name(_ARTICLE + _SHORT)}><p>{mine(prose(25, 90))}</p></div>"
            if kind == 4:
                return f"<table><tr><td>{mine(say(1, 5))}</td><td>{mine(say(1, 5))}</td></tr></table>"
            if kind == 5:
                return f"<figure><img><figcaption>{mine(say(3, 12))}</figcaption></figure>"
            return f"<p>{mine(prose(6, 90))}{('<br>' + mine(prose(4, 20))) if r.random() < 0.2 else ''}{(' <b>' + mine(say(1, 3)) + '</b>') if r.random() < 0.2 else ''}{(' <a href=x>' + mine(say(1, 3)) + '</a>') if r.random() < 0.3 else ''}{'</p>' if r.random() < 0.9 else ''}"

        if i % 20 == 7:  # text without markup
            page = " ".join(prose(4, 40) for _ in range(r.randint(1, 6)))
            out.append((page, [page]))
            continue
        tag = ("article", "main", "div", "article", f"div {name(_ARTICLE)}")[i % 5]
        before = f"<!DOCTYPE html><html><head><title>{say(3, 8)}</title><style>p{{}}</style><script>f(1)</script></head><body>" + r.choice(["", f"<header><div>{say(1, 4)}</div>{links()}</header>", f"<header><p>{prose(2, 9)}</p></header>"]) + r.choice([f"<nav>{links()}</nav>", f"<div {name(_SHORT)}>{links()}</div>"]) + "".join(stray() for _ in range(r.randint(0, 3)))
        head = f"<h1>{mine(r.choice([say, prose])(1, 10))}</h1>"
        head = f"<header>{head}<p>{mine(say(2, 6))}</p></header>" if tag in ("article", "main") and r.random() < 0.3 else head
        body = head + "".join(part() + (stray() if r.random() < 0.15 else "") for _ in range(r.choice([0, 0, 1, 2, r.randint(2, 12)]))) + f"<p>{mine(prose(2, 40))}</p>"
        after = "".join(stray() for _ in range(r.randint(0, 4))) + f"<footer>{r.choice([say(2, 15), f'<p>{prose(5, 25)}</p>', links()])}</footer></body></html>"
        out.append((f"{before}<{tag}>{body}</{tag.split()[0]}>{after}", own))
    return out


@lru_cache(1)
def weights() -> Weights:
    return fit(labelled_pages())


def region(scores: list[float]) -> tuple[int, int]:
    """(first, last + 1) of the contiguous run with the highest sum, the first such; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def scored(page: str, w: Weights) -> list[tuple[float, str]]:
    """(score, text) of the page's words, tags and left-out elements, in order. The text of a tag is a space if it parts blocks, else empty."""
    apart = w.words.get("apart", 0.0) if _has_article(page) else 0.0
    count: dict[str, int] = {}
    around, articles = w.bias, 0
    blocks = ["page"]
    out: list[tuple[float, str]] = []
    opened: list[tuple[int, set[str], list[float]]] = []
    #: Sum, best sum of a run that ends here and best sum of a run, of the innermost open element; all its words if it has any.
    now = [0.0, 0.0, 0.0, 0.0]

    def add(score: float, text: str, words: int = 0) -> None:
        out.append((score, text))
        now[0] += score
        now[1] = max(0.0, now[1] + score)
        now[2] = max(now[2], now[1])
        now[3] += words

    for kind, what, *more in events(page):
        if kind == "text":
            n = len(what.split())
            if not n:
                out.append((0.0, what))
                continue
            odds = around + (0.0 if articles else apart) + sum(w.words.get(f, 0.0) for f in _of_run(what, n, blocks[-1], count.get("in:a", 0) > 0))
            add(n * max(-WORD_MOST, min(WORD_MOST, odds)), what, n)
        elif kind == "tag":
            add(w.tags.get(what, w.other_tag), "" if what in INLINE else " ")
        elif kind == "open":
            for f in more[0]:
                count[f] = count.get(f, 0) + 1
                if count[f] == 1:
                    around += w.words.get(f, 0.0)
            articles += what in ("article", "main")
            blocks += [] if what in INLINE else [what]
            opened.append((len(out), more[0], now))
            now = [0.0, 0.0, 0.0, 0.0]
        else:
            start, features, outer = opened.pop()
            for f in features:
                count[f] -= 1
                if not count[f]:
                    around -= w.words.get(f, 0.0)
            articles -= what in ("article", "main")
            if what not in INLINE:
                blocks.pop()
            inner, now = now, outer
            if inner[3] and inner[0] < -inner[2] and inner[2] < GOOD_RUN and what not in INLINE and what not in FRAMES:
                del out[start:]
                add(max(inner[0], -PENALTY), " ", inner[3])
            else:
                # runs within the element end where it ends; a run that ends here may begin before it
                now[1] = max(inner[1], now[1] + inner[0], 0.0)
                now[2] = max(now[2], inner[2], now[1])
                now[0] += inner[0]
                now[3] += inner[3]
    return out


def main_text(page: str | None, w: Weights | None = None) -> str:
    if not page:
        return ""
    seen = scored(page, weights() if w is None else w)
    a, b = region([s for s, _ in seen])
    return " ".join("".join([t for _, t in seen[a:b]]).split())


def extract(pages: DataFrame, column: str = "html", to: str = "text", w: Weights | None = None) -> DataFrame:
    """pages with the main text of each."""
    small_batches(pages.sparkSession)
    w = weights() if w is None else w

    @F.pandas_udf("string")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for r in rows:
            yield pd.Series([main_text(x, w) for x in r], dtype=object)

    return pages.withColumn(to, run(column))


def query(spark, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
