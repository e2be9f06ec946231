"""HTML extraction with a style tree of each site: pages of a host share one tree, and text paths of low importance are cut from each page."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.session import staged

#: Importance below which a text path is cut, and pages of a host from which its tree is trusted.
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 8
#: A text tells of its site only beside a block of which so many times its own length makes up for it.
LEAST_COMPANY = 4
#: Weight of what a node says against how it is laid out.
GAMMA = 0.9
#: Cut paths of all hosts that may be copied to every task, and the salts of a host beyond that.
MOST_BROADCAST = 20_000
SALTS = 64
#: Share of a page's text that its articles hold at least, where they are the story.
LEAST_ARTICLE = 0.3

# Elements that are no text of a page, whatever a site does with them.
SILENT = frozenset("script style noscript template head title svg canvas iframe object math select option textarea button datalist".split())
NOISE = frozenset("nav footer aside form dialog menu".split())
# Words of which a whole class token, id, role or aria-label consists that names what is not the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "side footer header masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comments comment reply replies disqus widget toolbar pagination pager search complementary "
    "contentinfo alert gdpr".split())
# Words that leave the meaning of a noise word beside them as it is ('share-box'), and those that do so for a page header.
BESIDE_NOISE = frozenset(
    "area bar block bottom box button buttons col column container footer form group icons inner item items link links list main mobile module "
    "outer page panel post posts primary row secondary section site slot social top ul unit".split())
#: Noise words of what may hold articles of others; how far an element is from the article.
OTHERS = frozenset("comment comments disqus recommended related replies reply".split())
BY_NAME, BY_OTHERS, FOR_SURE = 1, 2, 3
HEADERS = frozenset("header masthead".split())
BESIDE_HEADER = frozenset("bar container global inner outer site top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(script|style|noscript|template|textarea|title|iframe|svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    path: tuple[str, ...]
    noise: bool
    text: str


#: Noise words that keep their meaning as the first or as the last part of a longer name ('comment-body', 'user-comments').
FIRST_NOISE = frozenset("advert advertisement comment comments cookie cookies disqus newsletter".split())
LAST_NOISE = FIRST_NOISE | frozenset("adverts breadcrumb breadcrumbs sidebar".split())
#: Parts of names that speak of something else than the element itself, and those that scripts put in front.
ABOUT_OTHERS = frozenset("has no not with without hide free".split())
SCRIPT_MARKS = frozenset("js is".split())


@lru_cache(maxsize=65536)
def _is_noise(token: str, inside: bool) -> int:
    """Whether a class token, id, role or label says that an element is not the article, as a level; `inside` an article a header is part of it."""
    ordered = [w.lower() for w in _NAME_PART.findall(token)]
    while ordered and ordered[0] in SCRIPT_MARKS:
        ordered = ordered[1:]
    parts = set(ordered)
    if len(ordered) > 1 and (ordered[0] in FIRST_NOISE or ordered[-1] in LAST_NOISE) and not parts & ABOUT_OTHERS:
        return BY_OTHERS if parts & OTHERS else BY_NAME
    if parts & HEADERS:
        return BY_NAME if not inside and parts <= HEADERS | BESIDE_HEADER else 0
    if not parts & NOISE_WORDS or not parts <= NOISE_WORDS | BESIDE_NOISE:
        return 0
    return BY_OTHERS if parts & OTHERS else BY_NAME


def _names(attributes: str, inside: bool = False) -> tuple[str, int]:
    """Style of an element from its attributes (numbers left out), and whether they name it as noise or hide it, as a level."""
    if not attributes or ("=" not in attributes and "hidden" not in attributes.lower()):
        return "", 0
    style, noise = [], 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden":
            noise = FOR_SURE
            continue
        noise = max([noise, *(_is_noise(t, inside) for t in ([value] if name.lower() == "aria-label" else value.split()))])
        if name.lower() in ("class", "id"):
            style.append(re.sub(r"\d+", "0", value.strip().lower()))
    return ".".join(style), noise


def blocks(page: str, wrapped: bool = False) -> list[Block]:
    """The text blocks of a page in order, each with the path of styled elements above it.

    An element is noise by its tag, because it is hidden, or by its names, as is what it holds. Names of headings are
    anchors, names of html, body, article and main say nothing, and no name reaches into a main element. If nearly all
    text of a page stands in articles that only a name above them drops, such as that of a wrapper around the page, the page is read
    again with `wrapped`: names then do not reach into articles, but those of comments and related articles.

    Unclosed and wrongly nested elements are closed as browsers close them: a new paragraph or block ends an open paragraph, a new
    item ends its neighbour, an end tag closes everything opened inside, an end tag without start is ignored.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    kept = named_only = 0
    pieces: list[str] = []
    where: tuple[tuple[str, ...], int] | None = None

    def end_block() -> None:
        nonlocal where, kept, named_only
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.append(Block(where[0], where[1] > 0, text))
                kept += len(text) * (where[1] == 0)
                named_only += len(text) * (where[1] == BY_NAME and any(s.split(".")[0] == "article" for s in where[0]))
        where = None

    def add(text: str) -> None:
        nonlocal where
        if where is None:
            if not text.strip():
                return
            where = tuple(s for t, s, _ in stack if t not in INLINE), stack[-1][2] if stack else 0
        elif stack and stack[-1][2] != where[1]:
            end_block()
            return add(text)
        pieces.append(text)

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            add(page[last:m.start()])
        last = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag not in INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    # An inline end tag does not reach across a block.
                    if tag not in INLINE or all(t in INLINE for t, _, _ in stack[k + 1:]):
                        del stack[k:]
                    break
            continue
        if tag == "br" or tag == "hr" or tag not in INLINE:
            if tag == "br":
                add(" ") if where is not None else None
            else:
                end_block()
        if tag in VOID:
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE[tag]:
                    break
        inside = any(t in ("article", "main") for t, _, _ in stack)
        style, named = _names(m.group(4), inside)
        above = stack[-1][2] if stack else 0
        if tag == "main" and above < FOR_SURE or tag == "article" and wrapped and above == BY_NAME:
            above = 0
        if tag in ("html", "body", "article", "main") or tag in HEADINGS and named < FOR_SURE:
            named = 0
        by_tag = tag in NOISE or tag in SILENT or tag == "header" and not inside
        noise = max(above, named, FOR_SURE if by_tag else 0)
        stack.append((tag, f"{tag}.{style}" if style else tag, noise))
    if last < len(page):
        rest = page[last:]
        # A tag that the page breaks off is no text.
        add(rest[:rest.index("<")] if re.match(r"[^<]*<[A-Za-z/!][^>]*\Z", rest, re.S) else rest)
    end_block()
    return blocks(page, wrapped=True) if not wrapped and named_only > LEAST_COMPANY * kept else out


def host_of(url: str | None) -> str:
    """Host of an address, lower-cased; pages without one share the empty host."""
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


def _key(path: tuple[str, ...]) -> str:
    return ">".join(path)


def _text_hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _company(texts: dict[str, list[str]]) -> dict[str, str]:
    """For each text path of a page its longest block at another path; empty if that is short beside the path's own text."""
    longest = sorted(((max(len(t) for t in text), node, max(text, key=lambda t: (len(t), t))) for node, text in texts.items()), reverse=True)[:2]
    out = {}
    for node, text in texts.items():
        size, _, block = next((x for x in longest if x[1] != node), (0, "", ""))
        out[node] = block if LEAST_COMPANY * size >= sum(map(len, text)) else ""
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: every element path with the sequence of its child styles, every text path with its words; both beside what tells copies."""
    for batch in batches:
        hosts, nodes, kinds, values, beside = [], [], [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = host_of(url)
            children: dict[str, dict[str, None]] = {}
            texts: dict[str, list[str]] = {}
            for b in blocks(page or ""):
                for k in range(len(b.path)):
                    children.setdefault(_key(b.path[:k]), {})[b.path[k]] = None
                if not b.noise:
                    texts.setdefault(_key(b.path), []).append(b.text)
            whole = _text_hash(*(x for node, text in texts.items() for x in (node, *text)))
            for node, below in children.items():
                hosts.append(host), nodes.append(node), kinds.append("style"), values.append(_text_hash(",".join(below))), beside.append(whole)
            company = _company(texts)
            for node, text in texts.items():
                hosts.append(host), nodes.append(node), kinds.append("text"), values.append(_text_hash(" ".join(text))), beside.append(_text_hash(company[node]))
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in (hosts, nodes, kinds)], *[pa.array(x, pa.int64()) for x in (values, beside)]],
                                         ["host", "node", "kind", "value", "beside"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content) of the merged tree of each host.

    `node` is the path of styled elements from the root. Its presentation importance is the entropy of its child sequences over
    the pages that have it, its content importance the entropy of its texts, both to the base of the number of pages: 1 when
    every page differs, 0 when all are alike. Copies of a page count once: a text counts once for each longest block that
    stands beside it on a page, so an article is not taken for a notice because its page is mirrored, repeated or dated anew; a
    text that has next to nothing beside it is the article itself. What is noise by itself is not looked at. Only hashes
    travel, made distinct and then summed on the map side, so a host with most of the pages is no larger task than others.
    """
    seen = pages.select("url", "html").mapInArrow(_observe, "host string, node string, kind string, value long, beside long").distinct()
    counted = seen.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("host", "node", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("weighted"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("weighted") / F.col("pages")) / F.log("pages")).otherwise(F.lit(1.0))
    told = sums.withColumn("importance", entropy)
    one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    # Pages of a node are those that tell of its text; a node without own text has those of its children.
    return told.groupBy("host", "node").agg(F.coalesce(one("text", "pages"), F.max("pages")).alias("pages"), one("style", "importance").alias("presentation"),
                                            one("text", "importance").alias("content"))


def noisy_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, node): text-bearing nodes whose combined importance is low: the same words under the same style on most pages.

    The content of a node is all its text on a page, as one value. Only a node that has both text and child elements combines its
    entropy with that of its own child sequences, weighted by GAMMA; elsewhere the content alone decides. Nodes of fewer
    than `least_pages` pages that are no copies tell nothing and stay. Nothing is carried up the tree.
    """
    tree = style_tree(pages)
    combined = GAMMA * F.col("content") + (1 - GAMMA) * F.coalesce(F.col("presentation"), F.col("content"))
    low = (F.col("pages") >= least_pages) & F.col("content").isNotNull() & (combined < least_importance)
    return tree.where(low).select("host", "node")


def main_text(page: str | None, noisy: frozenset[str] = frozenset()) -> str:
    """The blocks of the article, joined by blank lines; `noisy` holds the paths that the site's tree has cut.

    Articles, or else a main element, stand for the page if they hold `LEAST_ARTICLE` of its text; less than that is a teaser beside the story.
    """
    found = [b for b in blocks(page or "") if not b.noise and not (noisy and _key(b.path) in noisy)]
    size = lambda some: sum(len(b.text) for b in some)
    for tag in ("article", "main"):
        held = [b for b in found if any(s.split(".")[0] == tag for s in b.path)]
        if held and size(held) >= LEAST_ARTICLE * size(found):
            return "\n\n".join(b.text for b in held)
    return "\n\n".join(b.text for b in found)


def extract(pages: DataFrame, **settings) -> DataFrame:
    """`pages` with `text` (the main text, empty if none) in place of html.

    The whole html of every page is read; null html is empty. Elements that are never text and elements named as menus, adverts,
    comments and the like go; of the rest, text paths go that the style tree of the host finds alike on its pages. If a page has
    articles that hold a fair share of its text, only they count, else such a main element, else the page. Character references are decoded, white space inside a
    block becomes one space, blocks stand in page order with a blank line between. Null addresses share one tree.
    Repeated rows are rows of the result, but copies of a page count once in the tree. A column `text` of `pages` is replaced; other columns stay.
    """
    low = staged(noisy_nodes(pages, **settings))
    # The few cut paths of each host; a path is cut only with many pages behind it, so a host has far fewer of them than pages.
    cut = low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("_cut"))
    kept = [c for c in pages.columns if c not in ("text", "html")]
    if low.count() <= MOST_BROADCAST:
        spread, cut = F.lit(0), F.broadcast(cut.withColumn("_salt", F.lit(0)))
    else:
        # Salts from the row itself: the pages of one host spread over many tasks, its cut paths are repeated for each.
        spread = F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")
        cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^.*?://([^/?#]*)", 1))
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], "html", host.alias("_host"), spread.alias("_spread"))
    joined = rows.join(cut, (rows["_host"] == cut["host"]) & (rows["_spread"] == cut["_salt"]), "left").select(*[F.col(f"`{c}`") for c in kept], "html", "_cut")
    schema = pages.select(*[F.col(f"`{c}`") for c in kept]).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, frozenset(cut or ())) for page, cut in zip(batch.column("html").to_pylist(), batch.column("_cut").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
