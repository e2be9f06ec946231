import html as html_lib

import pytest
from pyspark.sql import functions as F

from presslake.operators import extract

LONG = "word " * 40
P = f"<p>{LONG}</p>"


def text_of(spark, page):
    df = spark.createDataFrame([(1, page)], "id int, html string")
    return extract.page_text(df).first().text


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav>menu</nav><article><h1>Head</h1>{P}</article><footer>f</footer>"), "Head " + LONG.strip()),
    "main when the article is short": (page(f"<article>short</article><main>{P}</main>"), LONG.strip()),
    "body when nothing is long": (page(f"<article>short</article><div>{P}</div>"), "short " + LONG.strip()),
    "two articles are joined": (page(f"<article>{P}</article><article>{P}</article>"), (LONG + LONG).strip()),
    "nested articles count twice": (page(f"<article>{P}<article>in</article></article>"), (LONG + "in in").strip()),
    "class region": (page(f"<div>menu</div><div class='x story-body'><div>{P}</div><div>end</div></div>"), LONG + "end"),
    "class region in order": (page(f"<div class='story-body'>late {P}</div><div class='content'>first {P}</div>"), "first " + LONG.strip()),
    "role main": (page(f"<div>menu</div><div role='main'><div>{P}</div></div>"), LONG.strip()),
    "scripts and styles": (page(f"<article><script>var t='</article>';</script><style>p{{}}</style>{P}</article>"), LONG.strip()),
    "comments": (page(f"<article><!-- <script> -->a<!-- x > y -->{P}</article>"), "a " + LONG.strip()),
    "known entities": (page(f"<article>{P}&amp;lt; &lt;b&gt; &quot;q&quot; &#39;&nbsp;x</article>"), LONG + "&lt; <b> \"q\" ' x"),
    "other entities": (page(f"<article>{P}caf&eacute; &#8217;s &#x2013;</article>"), LONG + "café ’s –"),
    "unclosed body": (f"<html><body><div>{P}", LONG.strip()),
    "unclosed article": (page(f"<div>menu</div><article>{P}"), LONG.strip()),
    "mojibake": (page(f"<article>{P}KÃ¸benhavn</article>"), LONG + "København"),
    "words of neighbouring tags stay apart": (page(f"<article><b>one</b><i>two</i>{P}</article>"), "one two " + LONG.strip()),
    "too short": (page("<article>tiny</article>"), None),
    "no body": ("plain " * 50, None),
    "empty": ("", None),
    "null": (None, None),
}


@pytest.mark.parametrize("name", list(CASES))
def test_page_text(spark, name):
    source, want = CASES[name]
    assert text_of(spark, source) == want


def test_long_pages_are_read_whole(spark):
    words = " ".join(f"w{i}" for i in range(60000))
    assert text_of(spark, page(f"<article><p>{words}</p></article>")) == words


def test_both_readers_agree(spark):
    pages = [c[0] for n, c in CASES.items() if c[0] and n not in ("mojibake",)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    both = extract.page_text(df).select("id", "html", "text").withColumn("tree", extract.tree_text("html")).collect()
    for r in both:
        tree = r.tree if len(r.tree) > 100 else None
        assert r.text == tree, pages[r.id]


def test_plain_page_columns_are_not_carried(spark, tmp_path):
    spark.createDataFrame([("u", page(f"<article>{P}</article>"))], "url string, html string").write.parquet(str(tmp_path / "p"))
    df = extract.page_text(spark.read.parquet(str(tmp_path / "p"))).filter(F.length("text") >= 150).select("url")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("article(?=[\\s/>])[^>]*>(.*?)</article") == 1, "the region pattern runs once per page"
    assert "BatchEvalPython" not in plan and plan.count("ArrowEvalPython") == 1


def test_cascade(spark):
    df = spark.createDataFrame([(1, "a" * 10, "b" * 300), (2, "a" * 201, "b" * 300), (3, None, "b" * 200)], "id int, a string, b string")
    out = extract.extraction_cascade(df, [("first", F.col("a"), 200), ("second", F.col("b"), 200)])
    assert {r.id: r.extraction_method for r in out.collect()} == {1: "second", 2: "first", 3: None}


HEADS = [
    ("<h1>Deadline</h1><h1 class='x article-title y'>The real title</h1>", "The real title"),
    ("<h1 class='my-title'>Some title</h1><h1 class='a-headline'>Main headline</h1>", "Main headline"),
    ("<h1 class='my-title'>Deadline</h1><article><h1>In the article</h1></article>", "In the article"),
    ("<h1>Short</h1><meta property='og:title' content='Shared &amp; told'>", "Shared & told"),
    ("<h1>abc</h1>", "Deadline"),
]


def test_title_repair(spark):
    rows = [(f"https://deadline.com/{i}", " deadline ", "deadline.com") for i in range(len(HEADS))]
    rows += [("https://deadline.com/0", "Kept", "deadline.com"), ("https://deadline.com/0", "Deadline", "other.com"),
             ("https://deadline.com/404", "", "deadline.com")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, url string, title string, domain string")
    pages = spark.createDataFrame([(f"https://deadline.com/{i}", page(h)) for i, (h, _) in enumerate(HEADS)], "url string, html string")
    got = {r.id: (r.title, r.title_repaired) for r in extract.title_repair(df, pages, row_id="id").collect()}
    for i, (_, want) in enumerate(HEADS):
        assert got[i] == ((want, True) if want != "Deadline" else (" deadline ", False))
    n = len(HEADS)
    assert got[n] == ("Kept", False) and got[n + 1] == ("Deadline", False) and got[n + 2] == ("", False)


def test_fragment(spark):
    entry = lambda i, inner: f"<div id='news-feed-{i}'><div><div class='news-band__content x'>{inner}</div></div></div>"
    body = f"<div><p>{html_lib.escape(LONG)}</p>\n short \n<div>A second line of text</div></div>"
    source = page(entry(1, "other " * 30) + entry(7, body) + "<div class='news-band__content'>" + "tail " * 40 + "</div>")
    url = "https://journalisten.dk/nyhedsoverblik?a=1&news_band_id="
    rows = [(url + "7", "journalisten.dk", source), (url + "8", "journalisten.dk", source), (url + "7", "a.dk", source),
            ("https://journalisten.dk/nyhedsoverblik", "journalisten.dk", source)]
    out = extract.fragment_text(spark.createDataFrame(rows, "url string, domain string, html string")).collect()
    assert [r.url for r in out] == [url + "7"]
    assert "second line" in out[0].text and "other" not in out[0].text and "tail" not in out[0].text


def test_references_are_read_without_python(spark):
    import html as stdlib

    refs = ["&rsquo;", "&#8217;", "&#039;", "&mdash;", "&eacute;", "&amp;lt;", "&amp;", "&euro;", "&#54999;", "&nbsp;"]
    kept = ["&", "a & b", "&;", "&#x41;", "&#55296;", "&#130;", "&unknownname;", "&&lt;"]
    df = spark.createDataFrame([(r, f"x{r}y{r}") for r in [*refs, *kept]], "ref string, source string")
    got = {r.ref: (r.text, r.other) for r in df.select(
        "ref", extract.decode_entities("source").alias("text"), F.col("source").rlike(extract.OTHER_ENTITY).alias("other")).collect()}
    for ref in refs:
        assert got[ref] == (stdlib.unescape(f"x{ref}y{ref}"), False)
    assert got["&&lt;"] == ("x&<y&<", False) and got["a & b"] == ("xa & bya & b", False)
    assert all(got[r] == (f"x{r}y{r}", True) for r in ("&#x41;", "&#55296;", "&#130;", "&unknownname;"))
    page = "<html><body><article><p>" + "l&rsquo;&eacute;t&#233; &mdash; caf&eacute; " * 20 + "</p></article></body></html>"
    frame = spark.createDataFrame([(page,)], "html string")
    assert extract.page_text(frame).first().text == extract._tree_text(page)


def test_articles_side_by_side_need_no_tree(spark):
    a, b, filler = "first part " * 12, "second part " * 12, "<article-list>x</article-list>"
    pages = {
        "siblings": f"<body><article>{a}</article>{filler}<article>{b}</article></body>",
        "nested": f"<body><article>{a}<article>{b}</article></article></body>",
        "unclosed": f"<body><article>{a}</body>",
        "empty one": f"<body><article> </article><article>{b}</article></body>",
        "none": f"<body>{a}</body>",
        "null": None,
    }
    df = spark.createDataFrame(list(pages.items()), "name string, html string")
    got = {r.name: (r.text, r.reader) for r in extract.page_text(df, reader="reader").collect()}
    assert got["siblings"] == (f"{a}{b}".strip(), "patterns") and got["empty one"] == (b.strip(), "patterns")
    assert got["nested"][1] == "patterns" and got["unclosed"][1] == "tree" and got["none"] == (a.strip(), "patterns") and got["null"][0] is None
    for name in ("siblings", "empty one", "nested"):
        assert extract._tree_text(pages[name]) == got[name][0]


def test_nested_elements_by_depth(spark):
    import random

    rng = random.Random(12)

    def tree(tag, depth):
        inner = "".join(rng.choice([f"text {rng.randrange(99)} ", f"<p>para {rng.randrange(99)}</p>", tree(tag, depth - 1) if depth else "x"]) for _ in range(rng.randint(1, 4)))
        return f"<{tag} class='c{rng.randrange(3)}'>{inner}</{tag}>"

    pages = [f"<body>{'intro ' * 30}{tree('article', 4)}between{tree('ARTICLE', 3)}</body>" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    for r in extract.page_text(df, min_region=5, reader="reader").withColumn("tree", extract.tree_text("html", 5)).collect():
        assert r.reader == "patterns" and (r.text or "") == (r.tree if len(r.tree) > 5 else ""), r.html


def test_fragments_by_depth_equal_the_reader(spark):
    import random

    rng = random.Random(13)

    def block(depth):
        attrs = rng.choice(["", " id='f1'", ' class="hit x"', " class=hit", " id=f1 class='a hit'", " data-id='f1'"])
        inner = "".join(rng.choice([f"line {rng.randrange(99)} of words\n", "<p>p &amp; q</p>", "a&nbsp;b", block(depth - 1) if depth else "z"]) for _ in range(rng.randint(1, 4)))
        return f"<div{attrs}>{inner}</div>" if rng.random() < 0.97 else f"<div{attrs}>{inner}"

    pages = ["<body>" + "".join(block(4) for _ in range(3)) + "filler words " * 9 + "</body>" for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    told = extract.with_fragment(df, "html", F.lit("f1"), "hit", "text").withColumn("n", extract._native_fragment(F.col("html"), F.lit("f1"), "hit")).collect()
    assert all(r.text == extract._fragment(r.html, "f1", "hit") for r in told)
    assert sum(not r.n.odd for r in told) > 50 and sum(r.text is not None for r in told) >= 5
