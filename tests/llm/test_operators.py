"""Each operator against a brute-force version, and on nulls, empty tables, repeated rows, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from presslake.llm import decontaminate, htmltree, langid, license_scan, mixing, neardup, quality, sharding, suffixes, urlfilter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rule string, _row string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    """Random words with exact copies, near copies, shared passages, blanks, nulls, one long text and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(30)
    texts = [text(rng.randint(1, 80)) for _ in range(60)]
    texts += [f"{text(10)} {passage}\n{text(15)}" for _ in range(8)]
    base = text(60)
    texts += [base] * 4
    for _ in range(10):
        parts = base.split(" ")
        parts[rng.randrange(60)] = "changed"
        texts.append(" ".join(parts))
    texts += [None, None, "", "   \n", "one two", "ONE two", "Tab\tand\nline", "x" * 30_000, f"{base} " * 40, "\n".join(["same line here"] * 9)]
    rows = [(i, t, "en" if i % 2 else "de", None if i % 7 == 0 else f"s{i % 3}", 1, "r", "x") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[61], (None, texts[5], "en", "s1", 1, "r", "x"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_key(found, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in found)


def test_suffixes(docs, rows, empty):
    first = {}
    known = sorted((r[0], r[1].encode()) for r in rows if r[0] is not None and r[1] is not None)
    for doc, data in known:
        for i in range(len(data) - 49):
            first.setdefault(data[i:i + 50], doc)
    expected = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc is not None and first[data[i:i + 50]] < doc:
                covered[i:i + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(data, covered) if not c)
        expected.append((doc, len(data), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for settings in ({}, {"chunk_bytes": 5000, "bucket_suffixes": 300}):
        assert by_key(suffixes.deduplicate(docs, **settings).collect(), *names) == collections.Counter(expected)
    assert suffixes.deduplicate(empty).count() == 0
    kept = suffixes.kept_texts(docs).select("doc_id", "kept").collect()
    assert collections.Counter((r["doc_id"], hashlib.sha256(bytes(r["kept"] or b"")).hexdigest()) for r in kept) == collections.Counter((e[0], e[4]) for e in expected)


def test_cover_meets_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 0])
def test_decontamination_of_very_long_texts(spark, most):
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(4000)}"
    item = [word() for _ in range(40)]
    longer = [word() for _ in range(3000)]
    long = [word() for _ in range(150_000)]
    long[70_000:70_040] = item
    long[90_000:90_013] = item[7:20]
    long[90_020:90_032] = item[7:19]
    long[120_000:122_000] = longer[500:2500]
    long[121_000] = "other"
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[::-1])), (3, " ".join(item * 300))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(longer))], "item_id bigint, text string")
    told = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, most_broadcast=most).collect()}
    assert (told[1]["n_words"], told[1]["n_hit"], told[1]["items"]) == (150_000, 40 + 13 + 1999, ["1", "2"])
    assert told[2]["n_hit"] == 0 and told[3]["n_hit"] == told[3]["n_words"] == 12_000 and told[3]["contaminated"]


def test_decontamination(spark, docs, rows, empty):
    passage = rows[61][1].split("\n")[0].split(" ", 10)[10]
    items = [(1, passage), (2, passage), (3, "one two"), (4, None), (5, ""), (None, rows[0][1]), (6, rows[64][1]), (3, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = PLAIN.findall(lower(text))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i:i + size])].add(item)
    sizes = {len(k) for k in windows}
    expected = []
    for doc, text, *_ in rows:
        w, hit, ids = PLAIN.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i:i + size])):
                    hit.update(range(i, i + size))
                    ids |= found - {None}
        expected.append((doc, len(w), len(hit), tuple(sorted(map(str, ids))), bool(hit) and 20 * len(hit) >= len(w)))
    for most in (decontaminate.MOST_BROADCAST, 0):
        told = decontaminate.contamination(docs, bench, most_broadcast=most).collect()
        got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in told)
        assert got == collections.Counter(expected)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not e[4] for e in expected)
    spans = decontaminate.clean(docs, bench, drop="spans")
    assert spans.count() == len(rows) and decontaminate.contamination(spans, bench.where("item_id = 1")).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mixing(docs, rows, empty):
    told = mixing.mix(docs).collect()
    assert len(told) == len(rows)
    size = lambda t: len(SPACED.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = dict(zip(order, (3, 1, 2) * len(order)))
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if weight[k] * level > 2 * sizes[k]}
        if not over:
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
        open_ -= over
    target |= {k: weight[k] * level for k in open_}
    taken = collections.Counter()
    for r in told:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for k in order:
        assert taken[k] == round(target[k])
    again = mixing.mix(docs.repartition(7)).collect()
    assert by_key(again, "doc_id", "size", "taken") == by_key(told, "doc_id", "size", "taken")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() >= sum(r["taken"] > 0 for r in told) - 4
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def shingles(text):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, rows, empty):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    expected = []
    for i, r in enumerate(rows):
        component = least.get(find(i)) if sets[i] else r[0]
        expected.append((r[0], len(sets[i]), component, r[0] == component if r[0] is not None and component is not None else component is None))
    told = neardup.near_duplicates(docs).collect()
    assert by_key(told, "doc_id", "n_shingles", "component_id", "kept") == collections.Counter(expected)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.one_of_each(docs).columns == docs.columns


def test_one_row_of_each_component(spark, docs, rows, empty):
    rng = random.Random(21)
    text = lambda: " ".join(f"w{rng.randrange(10**5)}" for _ in range(60))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    a, b, c, d = (text() for _ in range(4))
    made = [(1, a, "x")] * 5 + [(2, near(a), "x")] * 3 + [(None, a, "x")] * 2 + [(None, b, "x")] * 4 + [(None, near(b), "y")] * 2
    made += [(7, c, "x"), (7, near(c), "x"), (7, d, "x"), (8, d, "x")] + [(9, text(), "x")]
    made += [(4, text(), "u")] + [(5, t, s) for t in (text(),) for s in ("u", "v", "u")] + [(10, " ", "x")] * 2 + [(None, "", "x")] * 2 + [(None, None, "x")]
    frame = spark.createDataFrame(made, "doc_id bigint, text string, `a.b` string").repartition(4)
    told = collections.Counter(tuple(r) for r in neardup.one_of_each(frame).collect())
    short = collections.Counter((i, t) for i, t, _ in told.elements())
    assert short[1, a] == 1 and short[2, near(a)] == 0 and short[None, a] == 0
    assert short[None, b] + short[None, near(b)] == 1 and short[7, c] + short[7, near(c)] == 1
    assert short[7, d] == 1 and short[8, d] == 0 and sum(n for (i, _), n in short.items() if i in (4, 5, 9)) == 3
    assert short[10, " "] == 1 and short[None, ""] == 2 and short[None, None] == 1
    assert sum(told.values()) == 11 and set(told) <= set(made)
    assert collections.Counter(tuple(r) for r in neardup.one_of_each(frame.repartition(9)).collect()) == told
    components = {r["component_id"] for r in neardup.near_duplicates(docs).collect() if r["n_shingles"] and r["component_id"] is not None}
    assert collections.Counter(r["doc_id"] for r in neardup.one_of_each(docs).collect() if shingles(r["text"])) == collections.Counter(components)
    assert neardup.one_of_each(empty).count() == 0 and neardup.one_of_each(frame).columns == frame.columns


def test_links_that_the_star_misses_are_found(spark):
    """A ring of texts, each close to its neighbours only, is one component whatever its centre; and tiles meet each other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(40):
        words = words[3:] + [f"n{rng.randrange(10**6)}" for _ in range(3)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {0}


def test_bayes_bounds():
    needed = neardup.least_matches()
    assert all(needed[n] < 0.85 * n for n in needed) and needed[128] > 0.6 * 128


def test_components(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(50)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    told = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(links).collect()}
    assert {told[bytes([i])] for i in range(51)} == {b"\0"} and told[b"\xf1"] == b"\xf0"


def test_quality_statistics(docs, rows, empty):
    expected = []
    for doc, text, *_ in rows:
        text = text or ""
        w = SPACED.findall(text)
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        bad = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        expected.append((doc, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), bad))
    told = quality.judge(docs, []).collect()
    assert by_key(told, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter(expected)
    assert all(r["kept"] == (not r["base_failed"]) for r in told)
    assert quality.judge(empty, []).count() == 0 and quality.keep(docs, []).columns == docs.columns


def test_rules_find_what_labels_say(spark):
    rng = random.Random(3)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(600)]
    labels = [r["a"] > 0.7 and r["b"] <= 0.5 for r in rows]
    rules = quality.learn(rows, labels)
    told = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert sum(x == y for x, y in zip(told, labels)) > 0.97 * len(rows)
    assert quality.learn([], []) == [] and quality.learn(rows, [False] * 600) == []
    text = spark.createDataFrame([(i, "good plain words here " * 5 if i % 2 else "bad# words$ all% over& " * 5) for i in range(60)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 0), (5, None)], "doc_id bigint, quality int")
    rules = quality.learn_from(text, marks)
    assert rules and quality.learn_from(text, marks.limit(0)) == []
    statistics = quality.judge(text, rules).select("doc_id", F.col("rule").isNull().alias("fine")).collect()
    assert all(r["fine"] == bool(r["doc_id"] % 2) for r in statistics)


def test_licences(spark, docs, empty):
    texts = ["Released UNDER the MIT License. Under the MIT license", "Licensed under the Apache License, Version 2.0.", "x cc by nc cc by nc", None, "",
             "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "the of and rights", "MIT License under the"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["filler words only"] * 80)], "doc_id bigint, text string")
    told = {r["doc_id"]: r for r in license_scan.scan(found).collect()}
    assert [tuple(told[i]["base_labels"]) for i in range(9)] == [("mit",), ("apache-2",), ("cc-by-nc",), (), (), (), (), (), ()]
    assert [p["at"] for p in told[0]["places"]] == [1, 5] and [p["at"] for p in told[2]["places"]] == [1, 4]
    assert "gpl-3" in told[5]["labels"] and "proprietary" in told[6]["labels"] and not told[7]["labels"] and not told[8]["labels"]
    assert all(0 <= r["score"] <= 1 for r in told.values()) and told[3]["n_words"] == 0
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(empty).count() == 0
    # A phrase that most files carry has no rare word, and a file may hold more rare words than are looked up.
    many = " filler ".join(t.text for t in license_scan.TEMPLATES)
    common = spark.createDataFrame([(i, t) for i, t in enumerate([many] + ["All rights reserved. filler"] * 30)], "doc_id bigint, text string")
    told = {r["doc_id"]: r["labels"] for r in license_scan.scan(common, top_words=2).collect()}
    assert set(told[0]) == {t.label for t in license_scan.TEMPLATES} and all(told[i] == ["proprietary"] for i in range(1, 31))


def licence_matches(text, templates, least, tolerance):
    """Every template at every place, word by word."""
    words = PLAIN.findall(lower(text))
    at = lambda i: words[i] if 0 <= i < len(words) else None
    found = set()
    for t in templates:
        parts, key = t.text.split(), t.key_phrase.split()
        first = next(i for i in range(len(parts)) if parts[i:i + len(key)] == key)
        for start in range(-len(parts), len(words)):
            if all(at(start + first + k) == w for k, w in enumerate(key)):
                share = sum(any(at(start + i + d) == w for d in range(-tolerance, tolerance + 1)) for i, w in enumerate(parts)) / len(parts)
                if share >= least:
                    found.add((t.label, start, share))
    return sorted(found)


@pytest.mark.parametrize("settings", [{}, {"tolerance": 0}, {"top_words": 1, "tolerance": 2, "least_share": 0.8}])
def test_licences_equal_a_look_at_every_place(spark, docs, rows, settings):
    rng = random.Random(11)
    templates = license_scan.TEMPLATES
    texts = [None, "", " ", "the of and or", "MIT License under the", "x" * 30_000, "under the MIT license " * 50]
    for k in range(150):
        words = []
        for t in rng.choices(templates, k=rng.randint(1, 3)):
            part = t.text.split()
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(part))
                part[i:i + rng.randint(0, 1)] = rng.choice([[], ["new"], ["one", "more"], ["the"]])
            words += part[rng.choice([0, 0, 3]):] + rng.choices(["filler", "the", "license", "of", "text"], k=rng.randint(0, 20))
        texts.append((", " if k % 2 else " ").join(words).title() if k % 3 else "\n".join(words))
    texts.append(" ".join(t.text for t in templates) + " the software of license" * 20_000 + templates[1].text)
    texts += texts[8:10]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, texts[3], "", ""), (9, texts[9], "", ""), (None, texts[10], "", "")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, word string, start string").repartition(7), **settings)
    told = collections.Counter((r["doc_id"], r["n_words"], tuple(tuple(p) for p in sorted(r["places"])), tuple(r["labels"]),
                                tuple((m["label"], m["at"], round(m["share"], 9)) for m in r["matches"])) for r in found.collect())
    least, tolerance = settings.get("least_share", license_scan.LEAST_SHARE), settings.get("tolerance", license_scan.TOLERANCE)
    hand = collections.Counter()
    for i, t, *_ in rows:
        words = PLAIN.findall(lower(t))
        places = sorted((name, k) for name, p in license_scan.BASE_PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split())
        matches = licence_matches(t, templates, least, tolerance)
        labels = sorted({name for name, _ in places} | {m[0] for m in matches})
        hand[i, len(words), tuple(places), tuple(labels), tuple((m, k, round(v, 9)) for m, k, v in matches)] += 1
    assert told == hand


def test_a_word_more_or_less_does_not_end_a_match(spark):
    text = license_scan.TEMPLATES[1].text.split()
    cut = text[:5] + ["and", "more"] + text[5:40] + text[42:]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(cut))] + [(i, "plain words") for i in range(3, 40)], "doc_id bigint, text string")
    share = lambda **s: {r["doc_id"]: max((m["share"] for m in r["matches"]), default=0) for r in license_scan.scan(docs, **s).where("doc_id < 3").collect()}
    assert share(tolerance=0)[2] < 0.7 and share()[2] > 0.95 and share()[1] == share(tolerance=0)[1] == 1


def test_languages(spark, empty):
    rng = random.Random(2)
    words = {"aa": ["kala", "mala", "tal", "lak"], "bb": ["üren", "ten", "reuz", "ütz"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 34 !!", "aa"), (103, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train_on(docs.where("doc_id < 40"))
    told = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(told[i]["lang_pred"] == lang for i, _, lang in rows[:80])
    assert [told[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in told.values())
    assert langid.train_on(docs.limit(0)) is None and {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_copies_do_not_thin_the_sample(spark, monkeypatch):
    """Each language gives its distinct texts, up to the sample, however many copies some of them have."""
    spread = lambda n, of: spark.range(n).select(F.concat(F.lit(f"{of} text "), F.least("id", F.lit(40)).cast("string")).alias("text"), F.lit(of).alias("lang"))
    docs = spread(60_000, "aa").union(spread(30, "bb")).union(spark.range(900).select(F.concat(F.lit("text "), F.col("id").cast("string")), F.lit("cc")))
    monkeypatch.setattr(langid, "fit", lambda texts, langs, **settings: (texts, langs))
    texts, langs = langid.train_on(docs, sample=50)
    assert collections.Counter(langs) == {"aa": 41, "bb": 30, "cc": 50} and len(set(texts)) == 121


def test_long_texts_keep_their_language():
    """Large vocabularies: a megabyte of any language has nearly all n-grams that fit into the slots."""
    import numpy as np

    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäéñö"))
    shares = {lang: rng.dirichlet(np.full(len(letters), 2.0)) for lang in ("aa", "bb", "cc", "dd")}

    def write(lang, n):
        words = np.array(["".join(rng.choice(letters, rng.integers(2, 11), p=shares[lang])) for _ in range(min(n, 20_000))])
        return " ".join(rng.choice(words, n)).encode()

    langs = [lang for lang in shares for _ in range(30)]
    model = langid.fit([write(lang, 150) for lang in langs], langs)
    for n in (150, 20_000, 160_000):
        texts = [write(lang, n) for lang in shares]
        told = langid._kernel(langid.presence(texts), model.landmarks) @ model.weights + model.offset
        assert n < 160_000 or min(map(len, texts)) > 1_000_000
        assert [model.langs[i] for i in told.argmax(axis=1)] == list(shares)


def test_shards(docs, rows, empty):
    told = sharding.shard(docs, block=20, fan=2).collect()
    assert len(told) == len(rows)
    slots, homes, loads = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in told:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    of = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert by_key(told, "doc_id", "size", "text_crc32") == of
    for r in told:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())
    # No shard is fuller than another by more than the largest group that cannot be divided.
    group = collections.Counter()
    for (_, size, crc), n in of.items():
        group[size, crc] += size * n
    assert max(loads.values()) - min(loads.get(k, 0) for k in range(24)) <= max(group.values())
    out = sharding.sharded_documents(docs)
    assert out.count() == len(rows) and out.columns == [*docs.columns, "shard", "slot"]
    assert sharding.shard(empty).count() == 0


def test_differencing_balances():
    import numpy as np

    rng = np.random.default_rng(4)
    loads = np.zeros((3000, 24), np.int64)
    loads[:, -1] = rng.integers(10, 20_000, 3000)
    parts, totals = sharding.difference(loads)
    assert totals.sum() == loads.sum() and totals.max() - totals.min() < 20
    assert (np.sort(parts, axis=1) == np.arange(24)).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>&nbsp;word<br>next<p>Two&#8217;s
 end<div class="share-box">Share</div><aside>Aside</aside><form><input>Go</form><section id="comments"><p>I agree</p></section><p>Stay here daily</p></article>
<div class="cookie-notice">Cookies</div><footer>&copy; x</footer>"""


def test_pages(spark):
    pages = [(i, f"https://a.example/{i}", PAGE.replace("One", f"One{i}").replace("Two", f"Two{i}").replace("Head", f"Head{i}"), "clash") for i in range(12)]
    pages += [(50, "https://b.example/x", PAGE, "clash"), (51, None, None, None), (52, "nothing", "", ""), (53, None, "<p>Plain", ""), (53, None, "<p>Plain", "")]
    told = {r["page_id"]: r["text"] for r in htmltree.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")).collect()}
    assert told[50] == "Head & line\n\nOne bold word next\n\nTwo’s end\n\nStay here daily"
    assert (told[51], told[52], told[53]) == ("", "", "Plain")
    assert htmltree.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_style_tree_cuts_what_a_site_repeats(spark):
    page = "<html><body><article><div class=x><p>Follow our daily letter</p></div><div class=y><p>{}</p></div></article></body></html>"
    pages = [(i, f"http://h.example/{i}", page.format(f"Story number {i} of many")) for i in range(20)]
    pages.append((99, "http://other.example/", page.format("Alone")))
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    told = {r["page_id"]: r["text"] for r in htmltree.extract(frame).collect()}
    assert told[3] == "Story number 3 of many" and told[99] == "Follow our daily letter\n\nAlone"


def test_copies_of_a_page_do_not_empty_it(spark):
    page = "<html><body><div class=ad>Ad {ad}</div><article><h1>{head}</h1><p class=date>Day {day}</p><p class=body>{body}</p></article></body></html>"
    body = lambda i: f"Story {i} of many with words enough to be the article of its page"
    pages = [("equal", 1, 0, "One", 1)] * 9 + [("dated", 1, i, "One", i) for i in range(9)] + [(None, 1, 0, "One", 1)] * 9
    pages += [("most", 0, 0, "Head", 0)] * 90 + [("most", i, i, f"Head {i}", i) for i in range(1, 11)]
    rows = [(i, host and f"http://{host}.example/{i}", page.format(ad=ad, head=head, day=day, body=body(story))) for i, (host, story, day, head, ad) in enumerate(pages)]
    told = {r["page_id"]: r["text"] for r in htmltree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert told == {i: f"{head}\n\nDay {day}\n\n{body(story)}" for i, (_, story, day, head, _) in enumerate(pages)}
    # A notice beside stories that differ still goes, however often one of them is repeated.
    page = "<article><p class=x>Follow our daily letter</p><p class=y>{}</p></article>"
    rows = [(i, "http://h.example/", page.format(body(max(0, i - 80)))) for i in range(90)]
    told = {r["page_id"]: r["text"] for r in htmltree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert told == {i: body(max(0, i - 80)) for i in range(90)}


@pytest.mark.parametrize("wrapper", ["<div class='content has-sidebar'>", "<div class=no-sidebar>", "<div class='ad-free wide'>", "<div id=with-menu>", "<div class=content-sidebar-wrap>",
                                     "<div class=overlay>", "<div class='page modal' role=search>"])
def test_names_of_wrappers_drop_nothing(wrapper):
    for tag in ("article", "main"):
        page = f"{wrapper}<{tag}><header class=entry-header><h1>Head</h1></header><p>Story</p></{tag}><section class=related-posts><article>Others</article></section></div>"
        assert htmltree.main_text(page) == "Head\n\nStory"


def test_names_inside_articles_drop_only_noise():
    page = ("<article><div class=entry-header><h1>A</h1></div><section id=related-work><h2 id=search>B</h2><p>C</p></section><div class=social-science>D</div><p class=side-note>E</p>"
            "<div class=header>F</div><div class='box share-links'>X</div><div class=adSlot1>X</div><div aria-label='Related posts'>X</div><section id=comments><article class=comment>X</article></section></article>")
    assert htmltree.main_text(page) == "A\n\nB\n\nC\n\nD\n\nE\n\nF"
    # Articles of others are not the page's, however long they are.
    for name in ("comments", "related", "sidebar"):
        assert htmltree.main_text(f"<div class=post><p>Plain story</p></div><div class={name}><article>One more voice on the story</article></div>") == "Plain story"
    assert htmltree.main_text(f"<div class=post><p>Plain story</p></div><div class=comments><article>{'long ' * 99}</article></div>") == "Plain story"


def test_addresses(spark):
    urls = ["http://A.example.COM/en/1?x=1", "https://www.example.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://com/", "http://example.com#f", None, "no", "http://",
            "http://notcom/en/", "ftp://b.net/fr/#a://c"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    told = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), sample=50, rounds=2).collect()}
    assert [told[i]["rule"] for i in range(11)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, "com/", None, None, None, None, None, "net/fr/"]
    assert (told[0]["host"], told[0]["path"], told[5]["host"], told[5]["path"], told[7]["host"]) == ("a.example.com", "/en/1", "example.com", "", "")
    assert {told[i]["verdict"] for i in range(11)} <= {"allow", "block"} and told[0]["verdict"] == "block" and told[1]["verdict"] == "allow"
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_trees_learn_given_labels(spark):
    rows = [(i, f"https://s{i % 5}.org/{'1234567' if i % 2 else 'words'}/{i % 9}") for i in range(200)]
    labels = spark.createDataFrame([(u, "block" if "1234567" in u else "allow") for _, u in rows[:120]], "url string, verdict string")
    told = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels=labels).collect()}
    assert all((told[i] == "block") == ("1234567" in u) for i, u in rows)


def test_letters_are_those_of_unicode():
    assert [langid.has_letter(t) for t in ("½", "²", "Ⅷ", "12 _ !", "", "ª", "ʰ", "Ж", "字", "1a")] == [False] * 5 + [True] * 5


def test_rules_do_not_depend_on_repeated_ids(spark):
    rng = random.Random(3)
    text = lambda bad: " ".join(rng.choice(["#", "$$", "x"] if bad else ["word", "other", "plain"]) for _ in range(40))
    rows = [(i, text(i % 2)) for i in range(60)] + [(i % 4, text(i % 3)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    found = [quality.learn_from(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(k), labels, sample=40) for k in (1, 5, 9)]
    assert found[0] and found[0] == found[1] == found[2]


def test_names_of_comments_notices_and_sidebars():
    story = "<p>" + "The story goes on. " * 30 + "</p>"
    for name in ("comment-body", "user-comments", "js-cookie-notice", "article-sidebar", "comments_list wide", "newsletter-wrap"):
        page = f"<body><article>{story}<div class='{name}'><p>Not the story</p></div></article></body>"
        assert htmltree.main_text(page) == ("The story goes on. " * 30).strip()
    for name in ("has-sidebar", "no-sidebar", "ad-free", "with-menu", "related-work", "social-science", "side-note", "entry-header", "no-comments"):
        assert "Kept" in htmltree.main_text(f"<body><article>{story}<div class='{name}'><p>Kept</p></div></article></body>")


def test_a_teaser_beside_a_story_does_not_stand_for_the_page():
    story = "The story goes on. " * 30
    page = f"<body><article><h2>Teaser</h2><p>Read more</p></article><div class='text'><p>{story}</p></div></body>"
    assert htmltree.main_text(page) == f"Teaser\n\nRead more\n\n{story.strip()}"
    swapped = f"<body><article><p>{story}</p></article><div class='text'><p>Read more</p></div></body>"
    assert htmltree.main_text(swapped) == story.strip()
