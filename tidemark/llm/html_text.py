"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its block elements; inline elements belong to the block around them.  The
trees rate every block from its subtree's density, attribute tokens, depth and siblings.  The
decoding gives every subtree the best of three states: all content, no content, or mixed, where
the children decide.  So no block inside rejected content is kept, nor the other way round.

Training labels come from the pages themselves: in a bounded sample, blocks under elements whose
name or attributes say what they are.  Copies of the sample's pages, with elements renamed and
further menus, notices, forms and comments put in, keep the trees from relying on one template.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BoostedTrees

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title textarea noscript template iframe noembed noframes svg math canvas object audio video select option button map datalist".split())
IN_HEAD = frozenset("base bgsound link meta title style script noscript template noframes basefont".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
OUTER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
# Words of class, id and role attributes.
REJECTED = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "disclaimer discussion disqus footer form header legal login masthead menu menubar meta modal nav navbar navigation "
    "newsletter notice notification overlay pager pagination popup promo promoted related replies reply respond search "
    "share sharing sidebar sidenav signup social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
KEPT = frozenset("article articlebody body content entry main page post story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_NEXT = {n: re.compile(rf"<(/?){n}\b", re.I) for n in ("button", "select")}
_SAID = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Blocks in page order: parent, tag, attribute tokens, and their text runs in page order."""

    __slots__ = ("parent", "tag", "tokens", "runs", "links")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.tokens: list[frozenset[str]] = [frozenset()]
        self.runs: list[tuple[int, str]] = []  # (block, text of one run without a block boundary)
        self.links: list[int] = [0]  # characters inside links

    def open(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        said = " ".join(_CAMEL.sub(" ", a or b or c) for a, b, c in _SAID.findall(attributes)) if "=" in attributes else ""
        self.tokens.append(frozenset(t.lower() for t in _TOKEN.findall(said)))
        self.links.append(0)
        return len(self.parent) - 1


def parse(html: str | None) -> Page:
    """The block tree of ``html``; unclosed and misplaced tags are put right as browsers mostly do."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block, inline ones too
    held: list[str] = []
    hidden, in_link, at, text = 0, 0, 0, html or ""
    loose = ""  # the open button or select without an end tag of its own

    def flush() -> None:
        if held:
            run = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if run:
                page.runs.append((stack[-1][1], run))

    def put(part: str) -> None:
        if part and stack[-1][0] == "head" and not part.isspace():
            close(len(stack) - 1)
        if part and not hidden:
            held.append(part)
            if in_link and not part.isspace():
                page.links[stack[-1][1]] += len(part.strip())

    def close(depth: int) -> None:
        nonlocal hidden, in_link
        while len(stack) > depth:
            name = stack[-1][0]
            if name not in INLINE:
                flush()
            stack.pop()
            hidden -= name in UNSEEN
            in_link -= name == "a"

    def find(names: tuple[str, ...], stop: tuple[str, ...]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stop:
                break
        return 0

    while True:
        m = _TAG.search(text, at)
        if m is None:
            # A tag that the end of the page cuts off is no text.
            cut = text.rfind("<", at)
            broken = cut >= 0 and ">" not in text[cut:] and re.match(r"</?[A-Za-z]", text[cut:]) is not None
            put(text[at:cut] if broken else text[at:])
            break
        put(text[at : m.start()])
        at, name = m.end(), (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name == "br" or name == "hr":
                put(" ")
            elif k := find((name,), ()):
                # An inline element does not close blocks that were opened inside it.
                if name not in INLINE or all(n in INLINE for n, _ in stack[k:]):
                    close(k)
                elif not any(n not in INLINE for n, _ in stack[k + 1 :]):
                    close(k)
            continue
        # Optional end tags: a head ends where something else begins, as do options and controls that nothing closes.
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name not in INLINE and name not in VOID and name not in RAW and (k := find(("option",), ("select", "datalist"))):
            close(k)
        if loose and (name in ("input", "textarea", "button", "select") or not (name in INLINE or name in VOID or name in RAW or name in ("option", "optgroup"))):
            if k := find((loose,), ()):
                close(k)
            loose = ""
        if name in VOID:
            if name in ("br", "hr", "img"):
                put(" " if name != "img" else "")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            if name not in INLINE:
                put(" ")
            continue
        if name in CLOSES_P and (k := find(("p",), ("table", "td", "th", "button", "article", "section", "div"))):
            close(k)
        elif name in CLOSED_BY_ITSELF and (k := find(CLOSED_BY_ITSELF[name], OUTER[name])):
            close(k)
        if name == "html" or (name == "head" and len(stack) > 1):
            continue
        if name in _NEXT:
            end = _NEXT[name].search(text, at)
            loose = "" if end and end.group(1) else name
        block = stack[-1][1]
        if name not in INLINE:
            flush()
            if not hidden and name not in UNSEEN:
                block = page.open(block, name, m.group(3))
        elif m.group(3).endswith("/") and not hidden:
            continue
        stack.append((name, block))
        hidden += name in UNSEEN
        in_link += name == "a"
    close(0)
    return page


_GROUPS = (
    ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"),
    ("table", "tbody", "tr", "td", "th"), ("article", "main", "section"), ("nav", "menu"), ("aside",),
    ("header", "footer"), ("form", "fieldset", "dialog"), ("div", "center"),
)
_GROUP = {t: k for k, names in enumerate(_GROUPS) for t in names}
N_FEATURES = len(_GROUPS) + 21


def features(page: Page) -> np.ndarray:
    """One row a block: its kind, attribute tokens, depth, subtree density, siblings and ancestors."""
    n = len(page.parent)
    parent = page.parent
    own = [0] * n
    words = [0] * n
    for block, run in page.runs:
        own[block] += len(run)
        words[block] += run.count(" ") + 1
    chars, links, blocks, all_words = own[:], page.links[:], [1] * n, words[:]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        up = parent[k]
        chars[up] += chars[k]
        links[up] += links[k]
        blocks[up] += blocks[k]
        all_words[up] += all_words[k]
    for k in range(1, n):
        children[parent[k]].append(k)
    out = np.zeros((n, N_FEATURES))
    depth, above_bad, above_good, above_aside, above_article = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    total, g = max(chars[0], 1), len(_GROUPS)
    place, before = [0] * n, [0] * n
    for own_children in children:
        for k, c in enumerate(own_children):
            place[c], before[c] = k, chars[own_children[k - 1]] if k else 0
    passed = 0
    for k in range(n):
        up, tag, said = parent[k], page.tag[k], page.tokens[k]
        bad, good = len(said & REJECTED), len(said & KEPT)
        if k:
            depth[k] = depth[up] + 1
            above_bad[k] = above_bad[up] or int(bad > 0)
            above_good[k] = above_good[up] or int(good > 0)
            above_aside[k] = above_aside[up] or int(tag in ASIDE)
            above_article[k] = above_article[up] or int(tag in ("article", "main"))
        row = out[k]
        if tag in _GROUP:
            row[_GROUP[tag]] = 1
        siblings = children[up] if k else [0]
        around = chars[up] if k else chars[0]
        row[g:] = (
            bad, good, above_bad[k], above_good[k], above_aside[k], above_article[k], depth[k],
            np.log1p(chars[k]), np.log1p(own[k]), chars[k] / blocks[k], links[k] / max(chars[k], 1),
            all_words[k] / blocks[k], blocks[k], len(children[k]), len(siblings), place[k] / len(siblings),
            chars[k] / max(around, 1), chars[k] / total, np.log1p(before[k]), passed / total,
            1.0 if all_words[k] and chars[k] / all_words[k] > 9 else 0.0,
        )
        passed += own[k]
    return out


def seeds(page: Page) -> np.ndarray:
    """1 for blocks that are content by their names and attributes, 0 for the reverse, -1 for unknown."""
    n = len(page.parent)
    label, article = np.full(n, -1), np.zeros(n, dtype=bool)
    has_text = np.zeros(n, dtype=bool)
    for block, _ in page.runs:
        has_text[block] = True
    for k in range(1, n):
        up, said = page.parent[k], page.tokens[k]
        article[k] = article[up] or page.tag[k] in ("article", "main") or bool(said & {"article", "articlebody", "story", "post", "entry"})
        if label[up] == 0 or page.tag[k] in ASIDE or said & REJECTED:
            label[k] = 0
        elif article[k] and has_text[k]:
            label[k] = 1
    if not (label == 1).any():  # a page that does not say where its text is
        label[(label == -1) & has_text & np.array([t in ("p", "h1", "h2", "blockquote", "pre") for t in page.tag])] = 1
    # A block with content and nothing else below it is content as well.
    some, other = label == 1, label == 0
    for k in range(n - 1, 0, -1):
        some[page.parent[k]] |= some[k]
        other[page.parent[k]] |= other[k]
    label[(label == -1) & some & ~other & article] = 1
    return label


_RENAMES = (("article", 'div class="post-content"'), ("nav", 'div class="top-menu"'), ("footer", 'div id="footer"'), ("article", "main"), ("article", 'div id="main"'))
_INSERTS = (
    '<aside class="sidebar"><h3>{}</h3><p>{}</p></aside>', '<div class="notice">{}</div>', '<form><p>{}</p><input name="q"></form>',
    '<section class="comments"><h3>{}</h3><div class="comment"><p>{}</p></div></section>', '<div class="advert"><p>{}</p></div>',
    '<header><p>{}</p></header>', '<div class="cookie-banner"><p>{}</p></div>', '<ul class="menu"><li><a href="/">{}</a></li></ul>',
    '<div class="related"><a href="/x">{}</a></div>',
)


def varied(html: str, number: int) -> str:
    """A copy of a page with other names for its parts and one more part that is not content."""
    rng = np.random.default_rng([number, zlib.crc32(html.encode("utf-8", "replace"))])
    old, new = _RENAMES[rng.integers(len(_RENAMES))]
    out = re.sub(rf"<{old}\b[^>]*>", f"<{new}>", html).replace(f"</{old}>", f"</{new.split()[0]}>")
    texts = re.findall(r"<p>([^<]{20,400})", html) or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    for _ in range(2):
        insert = _INSERTS[rng.integers(len(_INSERTS))].replace("{}", texts[rng.integers(len(texts))])
        spots = [m.start() for m in re.finditer(r"<p>|</article>|</main>|<footer|</body>|</div>", out)] or [len(out)]
        spot = spots[rng.integers(len(spots))]
        out = out[:spot] + insert + out[spot:]
    return out


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """The kept blocks: the best choice of all, none or mixed for every subtree, from the leaves up.

    The text a mixed block holds itself follows the block's own rating.
    """
    n = len(page.parent)
    has_text = [False] * n
    for block, _ in page.runs:
        has_text[block] = True
    yes = (-np.logaddexp(0, -logit)).tolist()
    no = (-np.logaddexp(0, logit)).tolist()
    mixed_cost = -0.7
    content, nothing, mixed = yes[:], no[:], [mixed_cost + (max(a, b) if t else 0.0) for a, b, t in zip(yes, no, has_text, strict=True)]
    mixed[0] += 0.7
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        content[up] += content[k]
        nothing[up] += nothing[k]
        mixed[up] += max(content[k], nothing[k], mixed[k])
    state, kept = [0] * n, [False] * n
    for k in range(n):
        above = state[page.parent[k]] if k else 2
        if above != 2:
            state[k] = above
        else:
            best = max(content[k], nothing[k], mixed[k])
            state[k] = 1 if best == content[k] else 0 if best == nothing[k] else 2
        kept[k] = state[k] == 1 or (state[k] == 2 and yes[k] > no[k])
    return kept


def extract(model: BoostedTrees, pages: list[str | None], block: int = 512) -> list[str]:
    """The main text of every page; rated ``block`` pages at a time."""
    out: list[str] = []
    for start in range(0, len(pages), block):
        parsed = [parse(h) for h in pages[start : start + block]]
        logits = model.logit(np.concatenate([features(p) for p in parsed])) if parsed else np.zeros(0)
        at = 0
        for page in parsed:
            kept = decode(page, logits[at : at + len(page.parent)])
            at += len(page.parent)
            out.append(" ".join(run for b, run in page.runs if kept[b]))
    return out


def fit(pages: DataFrame, max_pages: int = 400, variants: int = 4) -> BoostedTrees:
    """Train on the blocks of at most ``max_pages`` pages, chosen by a hash of page_id, and their variants."""
    chosen = pages.select("page_id").where("page_id is not null and html is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").select("html")

    def rated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for html in frame["html"]:
                if not html:
                    continue
                for k in range(variants + 1):
                    page = parse(varied(html, k) if k else html)
                    label, x = seeds(page), features(page)
                    yield pd.DataFrame({"x": list(x[label >= 0]), "y": label[label >= 0].astype(np.int32)})

    got = sample.mapInPandas(rated, "x array<double>, y int").toPandas()
    model = BoostedTrees()
    if len(got):
        # The order of rows from Spark is free; sorted, the fit is the same on every run.
        x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(dtype=np.float64)
        order = np.lexsort([*x.T, y])
        model.fit(x[order], y[order])
    return model


def main_text(pages: DataFrame, model: BoostedTrees) -> DataFrame:
    """``pages`` with ``main_text``: the article's blocks in page order, joined by one space.

    Null and empty pages give the empty text, as do pages without any content block.  Repeated
    rows get the same text.  Column names other than ``html`` and ``main_text`` are free.
    """

    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_html in batches:
            yield pd.Series(extract(model, list(pages_html)), dtype="object")

    return pages.withColumn("main_text", F.pandas_udf(extracted, "string")("html"))
