"""Article text, title and fragments from landed pages.

Well-formed pages are read with native expressions, nested articles and blocks by the depth of their tags. Pages that these
cannot read exactly (class-marked containers, unclosed tags, unusual entities, unclosed scripts) are the only ones handed to a
small HTML reader, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from presslake.functions.text import _col, clean_text, collapse_spaces, fix_mojibake, is_empty, strip
from presslake.functions.urls import query_parameter
from presslake.operators.skew import lookup_join
from presslake.operators.stage import computed

# ---- fixed values: content regions in order of preference ----
CONTENT_REGIONS = [
    "article", "main", ".content", ".article-content", ".post-content", ".entry-content", ".story-content",
    ".news-content", ".text-content", "[role=main]", ".main-content", ".article-body", ".story-body",
]
# ---- end of fixed values ----
MIN_REGION = 100
MIN_CASCADE = 200

# One pass, first match wins, so a comment around a script or a script around a comment is read in order.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"</?[A-Za-z!][^>]*>"
# References that the given pages hold; the ampersand comes last so that `&amp;lt;` becomes `&lt;` and not `<`.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&")]
# Decimal references that name the character itself: 32 to 126 and 160 to 54999, with any leading zeros.
PLAIN_NUMBER = r"#0*(?:3[2-9]|[4-9][0-9]|1[01][0-9]|12[0-6]|1[6-9][0-9]|[2-9][0-9]{2}|[1-9][0-9]{3}|[1-4][0-9]{4}|5[0-4][0-9]{3})"
KNOWN_ENTITY = "(?:" + "|".join([PLAIN_NUMBER, *sorted(name2codepoint)]) + ");"
OTHER_ENTITY = rf"&(?!{KNOWN_ENTITY})(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
CLASS_REGION = (
    r"(?i)class\s*=\s*[\"']?[^\"'>]*\b(?:content|(?:article|post|entry|story|news|text|main)-content"
    r"|(?:article|story)-body)\b|role\s*=\s*[\"']?main\b"
)


def visible(html: Column | str) -> Column:
    """Page source without comments, scripts and styles."""
    return F.regexp_replace(_col(html), HIDDEN, " ")


def region(source: Column | str, tag: str) -> Column:
    """Inner source of the first `tag` element; '' when there is none."""
    return F.regexp_extract(_col(source), rf"(?is)<{tag}(?=[\s/>])[^>]*>(.*?)</{tag}\s*>", 1)


def siblings(source: Column | str, tag: str) -> Column:
    """Inner sources of all `tag` elements that stand side by side, as an array; nested ones are read wrongly."""
    return F.regexp_extract_all(_col(source), F.lit(rf"(?is)<{tag}(?=[\s/>])[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def _tags(source: Column, tag: str) -> Column:
    """struct<tags, parts, depth>: the start and end tags of one element, what stands between them, and how many are open after each.

    Depths are sums over the tags so far: a start tag counts up, an end tag down.
    """
    mark = rf"(?i)</?{tag}(?=[\s/>])[^>]*>"
    found = F.struct(F.regexp_extract_all(source, F.lit(mark), F.lit(0)).alias("tags"), F.split(source, mark, -1).alias("parts"))

    def with_depth(f: Column) -> Column:
        steps = F.transform(f["tags"], lambda t: F.when(t.startswith("</"), -1).otherwise(1))
        depth = _once(steps, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)))
        return F.struct(f["tags"].alias("tags"), f["parts"].alias("parts"), depth.alias("depth"))

    return _once(found, with_depth)


def _balanced(tags: Column) -> Column:
    """Whether every start tag has its end tag and the other way round."""
    depth = tags["depth"]
    return F.coalesce((F.array_min(depth) >= 0) & (F.element_at(depth, -1) == 0), F.lit(False))


def _inside(tags: Column, i: Column) -> Column:
    """How many parts stand inside the element that tag number `i` opens: up to the first tag behind it that leaves one less open than it found."""
    behind = F.slice(tags["depth"], i + 2, F.greatest(F.size(tags["depth"]) - i - 1, F.lit(0)))
    return F.array_position(behind, F.get(tags["depth"], i) - 1).cast("int")


def nested(source: Column | str, tag: str) -> Column:
    """Inner sources of all `tag` elements in the order of their start tags, those inside others included; null unless all are closed."""
    def read(tags: Column) -> Column:
        starts = F.filter(F.transform(tags["tags"], lambda t, i: F.when(~t.startswith("</"), i)), lambda i: i.isNotNull())
        inner = F.transform(starts, lambda i: F.array_join(F.slice(tags["parts"], i + 2, _inside(tags, i)), " "))
        return F.when(_balanced(tags), inner)

    return _once(_tags(_col(source), tag), read)


def body(source: Column | str) -> Column:
    """Inner source of the body, also when its end tag is missing."""
    return F.regexp_extract(_col(source), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)


def decode_entities(c: Column | str) -> Column:
    """Text with the HTML 4 named and the plain decimal references decoded, each once; anything else stays."""
    text = _col(c)
    names = F.create_map(*[F.lit(x) for pair in name2codepoint.items() for x in pair])

    def decoded(piece: Column) -> Column:
        name = F.rtrim(F.regexp_extract(piece, "^" + KNOWN_ENTITY, 0), F.lit(";"))
        code = F.when(name.startswith("#"), F.substr(name, F.lit(2)).try_cast("int")).otherwise(F.try_element_at(names, name))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(name == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(char, F.substr(piece, F.length(name) + 2)))

    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
    return F.when(text.contains("&"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)


def plain(source: Column | str) -> Column:
    """Text of a piece of page source: text nodes joined by a space, entities decoded, spaces collapsed."""
    return collapse_spaces(decode_entities(F.regexp_replace(_col(source), TAG, " ")))


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Regions(HTMLParser):
    """Collects the text of every element that matches a region, in document order."""

    def __init__(self, matches):
        super().__init__(convert_charrefs=True)
        self.matches, self.open, self.found, self.in_text = matches, [], [], False

    def handle_starttag(self, tag, attrs):
        self.in_text = False
        if tag in VOID:
            return
        names = self.matches(tag, {k: v or "" for k, v in attrs})
        pieces = [] if names else None
        self.found.extend((name, pieces) for name in names)
        self.open.append((tag, pieces))

    def handle_endtag(self, tag):
        self.in_text = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_comment(self, data):
        self.in_text = False

    def handle_data(self, data):
        if any(tag in ("script", "style") for tag, _ in self.open):
            return
        for _, pieces in self.open:
            if pieces is None:
                continue
            if self.in_text and pieces:
                pieces[-1] += data
            else:
                pieces.append(data)
        self.in_text = True

    def texts(self, name):
        return [" ".join(" ".join(pieces).split()) for n, pieces in self.found if n == name]


def _region_names(tag: str, attrs: dict[str, str]) -> list[str]:
    names = [tag, *("." + c for c in attrs.get("class", "").split())]
    return names + (["[role=main]"] if attrs.get("role") == "main" else [])


def _parse(html: str, matches) -> _Regions:
    reader = _Regions(matches)
    reader.feed(html)
    reader.close()
    return reader


def _tree_text(html: str, min_region: int = MIN_REGION) -> str:
    page = _parse(html, _region_names)
    for name in CONTENT_REGIONS:
        text = " ".join(filter(None, page.texts(name)))
        if len(text) > min_region:
            return text
    return " ".join(page.texts("body")[:1])


def tree_text(html: Column | str, min_region: int = MIN_REGION) -> Column:
    """Region text by walking the element tree; null in, null out."""
    @F.pandas_udf(T.StringType())
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: _tree_text(page, min_region), na_action="ignore")

    return read(html)


def page_text(df: DataFrame, html: str = "html", out: str = "text", min_region: int = MIN_REGION,
              reader: str | None = None) -> DataFrame:
    """Add the article text of a page: the first region with more than `min_region` characters, else the body.

    Text of at most `min_region` characters counts as not extracted and becomes null. `reader` names a column that says
    whether `patterns` or the `tree` reader read the page.
    """
    stripped = lambda source: F.regexp_replace(source, TAG, " ")
    tidy = lambda c: collapse_spaces(F.when(F.col(c).contains("&"), decode_entities(c)).otherwise(F.col(c)))
    # Each step is its own projection, so no pattern runs twice; main and body are read only when needed.
    steps = df.withColumn("__src", visible(html)).withColumn("__siblings", siblings("__src", "article"))
    steps = steps.withColumn("__opened", F.regexp_count("__src", F.lit(r"(?i)<article(?=[\s/>])")))
    # Articles inside others, or without an end tag, are not found side by side.
    steps = steps.withColumn("__articles", F.when(F.col("__opened") == F.size("__siblings"), F.col("__siblings")).otherwise(
        F.coalesce(nested("__src", "article"), "__siblings")))
    steps = steps.withColumn("__raw", stripped(F.array_join("__articles", " ")))
    steps = steps.withColumn("__text", tidy("__raw"))
    for name, source in (("main", region("__src", "main")), ("body", body("__src"))):
        steps = steps.withColumn(f"__no_{name}", F.length("__text") > min_region)
        steps = steps.withColumn("__raw", F.when(F.col(f"__no_{name}"), F.col("__raw")).otherwise(stripped(source)))
        steps = steps.withColumn("__text", F.when(F.col(f"__no_{name}"), F.col("__text")).otherwise(tidy("__raw")))
    source = F.col("__src")
    needs_tree = (
        (F.col("__opened") != F.size("__articles"))
        | source.rlike(r"(?is)<!--|<(?:script|style)\b")
        | (~F.col("__no_main") & (F.regexp_count(source, F.lit(r"(?i)<main\b")) > 1))
        | (~F.col("__no_body") & source.rlike(CLASS_REGION))
        | F.col("__raw").rlike(OTHER_ENTITY)
    )
    read = steps.select(*df.columns, F.col("__text"), F.when(needs_tree, F.col(html)).alias("__odd"))
    told = [F.when(F.col("__odd").isNull(), "patterns").otherwise("tree").alias(reader)] if reader else []
    read = read.withColumn("__text", F.coalesce(tree_text("__odd", min_region), "__text"))
    read = read.withColumn("__text", fix_mojibake("__text"))
    kept = [c for c in df.columns if c not in (out, reader)]
    return computed(
        read.select(*kept, F.when(F.length("__text") > min_region, F.col("__text")).alias(out), *told), "page_text"
    )


def extraction_cascade(df: DataFrame, candidates: list[tuple[str, Column, int]], out: str = "text") -> DataFrame:
    """The first candidate longer than its own limit, with its name in `extraction_method`.

    Candidates are evaluated in the given order and only until one fits; list cheap ones first.
    """
    hit = F.lit(None).cast("struct<method:string,text:string>")
    for name, value, limit in reversed(candidates):
        text = strip(value)
        hit = F.when(F.length(text) > limit, F.struct(F.lit(name).alias("method"), text.alias("text"))).otherwise(hit)
    return df.withColumn("__hit", hit).select(
        *[c for c in df.columns if c not in (out, "extraction_method")],
        F.col("__hit.text").alias(out),
        F.col("__hit.method").alias("extraction_method"),
    )


def page_title(df: DataFrame, html: str = "html", out: str = "title") -> DataFrame:
    """The `<title>` of a page as text."""
    return df.withColumn(out, plain(region(html, "title")))


def heading_candidates(source: Column | str) -> list[Column]:
    """Heading texts in order of preference, from the most specific heading to the share title."""
    s = _col(source)
    h1 = lambda c, attrs="": F.regexp_extract(c, rf"(?is)<h1\b{attrs}[^>]*>(.*?)</h1\s*>", 1)
    cls = r"[^>]*\bclass\s*=\s*[\"']?[^\"'>]*"
    token = lambda name: rf"[^>]*\bclass\s*=\s*[\"']?(?:[^\"'>]*\s)?{name}(?=[\s\"'>])"
    share = F.regexp_extract(
        s, r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']og:title[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)", 1
    )
    parts = [h1(s, token("article-title")), h1(s, token("a-headline")), h1(s, cls + "title"), h1(s, cls + "headline"),
             h1(region(s, "article")), h1(s)]
    return [plain(p) for p in parts] + [strip(decode_entities(share))]


def own_site_name(domain: str = "domain") -> Column:
    """Lower-case name of a site whose feed puts that name in place of titles; null for all others."""
    return F.when(F.col(domain) == "deadline.com", "deadline")


def is_generic_title(site_name: Column | None = None) -> Column:
    """Whether a title is empty or just the name of its site, on sites that are known for it."""
    site_name = own_site_name() if site_name is None else site_name
    return F.coalesce(site_name.isNotNull() & (is_empty("title") | (F.lower(strip("title")) == site_name)), F.lit(False))


def title_repair(df: DataFrame, pages: DataFrame, site_name: Column | None = None, html: str = "html",
                 row_id: str | None = None) -> DataFrame:
    """Replace titles that are empty or just the site name by the heading of the landed page.

    `site_name` is the lower-case name of a row's site, null for sites whose titles are trusted. A heading
    must differ from that name and have more than five characters; without one the title stays. Only the
    pages of affected rows are read. A page landed more than once gives the headings of its longest version, so
    a row stays one row. Adds `title_repaired`.
    """
    site_name = own_site_name() if site_name is None else site_name
    marked = df.withColumn("__site", site_name).withColumn("__generic", is_generic_title(site_name))
    headings = pages.join(marked.filter("__generic").select("url").distinct(), "url", "left_semi").select(
        "url", F.length(html).alias("__size"), F.array(*heading_candidates(html)).alias("__headings")
    )
    headings = headings.groupBy("url").agg(F.max_by("__headings", F.struct("__size", "__headings")).alias("__headings"))
    joined = lookup_join(marked, headings, ["url"], [row_id] if row_id else None)
    usable = F.filter("__headings", lambda t: (F.length(t) > 5) & (F.lower(t) != F.col("__site")))
    found = F.when(F.col("__generic"), F.get(usable, F.lit(0)))
    return joined.withColumn("__found", found).select(
        *[F.coalesce("__found", "title").alias("title") if c == "title" else F.col(c) for c in df.columns],
        F.col("__found").isNotNull().alias("title_repaired"),
    )


FRAGMENT_PREFIX, FRAGMENT_CLASS = "news-feed-", "news-band__content"


def _fragment(html: str, element_id: str, content_class: str) -> str | None:
    """Text of the first `content_class` block inside the block with `element_id`; short lines are dropped."""

    class Fragment(_Regions):
        inside = 0

        def handle_starttag(self, tag, attrs):
            got = dict(attrs)
            if tag == "div" and got.get("id") == element_id:
                self.inside = self.inside or len(self.open) + 1
            super().handle_starttag(tag, attrs)

        def handle_endtag(self, tag):
            super().handle_endtag(tag)
            if self.inside and len(self.open) < self.inside:
                self.inside = 0

    reader = Fragment(None)
    reader.matches = lambda tag, attrs: (
        ["hit"] if reader.inside and tag == "div" and content_class in attrs.get("class", "").split() else []
    )
    reader.feed(html)
    reader.close()
    if not reader.found:
        return None
    text = " ".join(s for s in (piece.strip() for piece in reader.found[0][1]) if s)
    if len(text) <= MIN_REGION:
        return None
    lines = (line.strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if len(line) > 10)


OVERVIEW_DOMAIN, OVERVIEW_PATH, OVERVIEW_PARAMETER = "journalisten.dk", "/nyhedsoverblik", "news_band_id"


def is_overview_entry(domain: Column | str = "domain", url: str = "url") -> Column:
    """Whether an address names one entry of an overview page."""
    named = F.col(url).contains(OVERVIEW_PATH) & F.col(url).contains(OVERVIEW_PARAMETER + "=")
    return F.coalesce((_col(domain) == OVERVIEW_DOMAIN) & named, F.lit(False))


def _attribute(tag: Column, name: str) -> Column:
    value = rf"(?i)(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])


def _native_fragment(html: Column, element_id: Column, content_class: str) -> Column:
    """struct<text, odd>: as `_fragment`, by the depth of the div tags; `odd` where that cannot tell."""
    source = visible(html)

    def read(tags: Column) -> Column:
        first = lambda test: F.array_min(F.filter(F.transform(tags["tags"], lambda t, i: F.when(~t.startswith("</") & test(t, i), i)), lambda i: i.isNotNull()))
        named = F.filter(F.transform(tags["tags"], lambda t, i: F.when(~t.startswith("</") & (_attribute(t, "id") == element_id), i)), lambda i: i.isNotNull())
        blocks = F.transform(named, lambda i: F.struct(i.alias("begin"), (i + _inside(tags, i)).alias("end")))
        marked = lambda t: F.array_contains(F.split(_attribute(t, "class"), r"\s+"), content_class)
        hit = _once(blocks, lambda b: first(lambda t, i: F.exists(b, lambda x: (i >= x["begin"]) & (i < x["end"])) & marked(t)))
        pieces = _once(hit, lambda h: F.when(h.isNotNull(), F.split(F.array_join(F.slice(tags["parts"], h + 2, _inside(tags, h)), "<div>"), TAG, -1)))

        def told(pieces: Column) -> Column:
            text = F.array_join(F.filter(F.transform(pieces, lambda x: strip(decode_entities(x))), lambda x: x != ""), " ")
            kept = lambda t: F.filter(F.transform(F.split(t, "\n", -1), strip), lambda x: F.length(x) > 10)
            return F.struct(_once(text, lambda t: F.when(F.length(t) > MIN_REGION, F.array_join(kept(t), "\n"))).alias("text"),
                            (~_balanced(tags) | F.coalesce(F.exists(pieces, lambda x: x.rlike(OTHER_ENTITY)), F.lit(False))).alias("odd"))

        return _once(pieces, told)

    out = _once(_tags(source, "div"), read)
    unread = source.rlike(r"(?is)<!--|<(?:script|style)\b")
    return _once(out, lambda o: F.struct(o["text"].alias("text"), (o["odd"] | unread).alias("odd")))


def with_fragment(df: DataFrame, html: str, element_id: Column, content_class: str, out: str) -> DataFrame:
    """`df` with the text of the block that `element_id` names: natively where its tags are balanced, else by the HTML reader.

    Null without page, name or block. The reader's inputs are columns of their own, so that it runs once and on odd pages only.
    """
    @F.pandas_udf(T.StringType())
    def read(pages: pd.Series, names: pd.Series) -> pd.Series:
        texts = [_fragment(p, n, content_class) if p is not None and n is not None else None for p, n in zip(pages, names)]
        return pd.Series(texts, dtype=object)

    named = df.withColumn("__id", element_id)
    usable = F.col(html).isNotNull() & F.col("__id").isNotNull()
    named = named.withColumn("__native", F.when(usable, _native_fragment(F.col(html), F.col("__id"), content_class)))
    told = named.select(*df.columns, "__id", F.col("__native.text").alias("__text"), F.when(F.col("__native.odd"), F.col(html)).alias("__odd"))
    told = computed(told, "fragments")
    text = F.when(F.col("__odd").isNull(), F.col("__text")).otherwise(read("__odd", "__id"))
    return told.select(*[c for c in df.columns if c != out], text.alias(out))


def entry_text(df: DataFrame, html: str, url: str, out: str) -> DataFrame:
    """`df` with the text of the entry that an address names in an overview page; null without page, name or block."""
    return with_fragment(df, html, F.concat(F.lit(FRAGMENT_PREFIX), query_parameter(url, OVERVIEW_PARAMETER)), FRAGMENT_CLASS, out)


def fragment_text(df: DataFrame, domain: str = OVERVIEW_DOMAIN, path: str = OVERVIEW_PATH,
                  parameter: str = OVERVIEW_PARAMETER, prefix: str = FRAGMENT_PREFIX,
                  content_class: str = FRAGMENT_CLASS) -> DataFrame:
    """Text of one entry of an overview page, named by a query parameter of its address.

    Blocks are found by the depth of their tags; only pages with unclosed blocks, scripts or unusual references go to the HTML reader.
    """
    rows = (
        df.filter((F.col("domain") == domain) & F.col("url").contains(path))
        .select("url", "html", F.concat(F.lit(prefix), query_parameter("url", parameter)).alias("element_id"))
        .dropna()
    )
    told = with_fragment(rows, "html", F.col("element_id"), content_class, "text")
    return computed(told.select("url", "text"), "fragment_text").dropna(subset=["text"])


def cleaned(df: DataFrame, text: str = "text") -> DataFrame:
    """Second pass over extracted text: leftover tags and white-space runs."""
    return df.withColumn(text, clean_text(text))
