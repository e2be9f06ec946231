import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from presslake import dims
from presslake.functions import text as tx, times, urls


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("domain,want", [
    ("edition.cnn.com", "cnn.com"), ("www.cnn.com", "cnn.com"), ("cnn.com", "cnn.com"), ("deadline.com", "deadline.com"),
    ("localhost", "localhost"), ("", ""), (" WWW.A.B.C ", "b.c"), ("pressgazette.co.uk", "co.uk"),
])
def test_base_domain(spark, domain, want):
    assert one(spark, urls.base_domain("d"), d=domain) == want


def test_base_domain_with_two_part_suffixes(spark):
    assert one(spark, urls.base_domain("d", ["co.uk"]), d="news.pressgazette.co.uk") == "pressgazette.co.uk"


@pytest.mark.parametrize("url,authority,host", [
    ("https://user@WWW.X.com:80/a?b#c", "user@WWW.X.com:80", "user@www.x.com:80"),
    ("http://www.a.dk", "www.a.dk", "a.dk"), ("//b.org/x|y z", "b.org", "b.org"), ("mailto:x", "", ""), (None, "", ""),
])
def test_url_parts(spark, url, authority, host):
    assert one(spark, urls.url_authority("u"), u=url) == authority
    assert one(spark, urls.url_host("u"), u=url) == host


def test_query_parameter(spark):
    url = "https://j.dk/o?x=1&news_band_id=77#z"
    assert one(spark, urls.query_parameter("u", "news_band_id"), u=url) == "77"
    assert one(spark, urls.query_parameter("u", "other"), u=url) is None


@pytest.mark.parametrize("host,strict,loose", [
    ("cnn.com", True, True), ("us.cnn.com", True, True), ("notcnn.com", False, True), ("abt.dk", False, True),
    ("cnn.com.evil.org", False, False),
])
def test_host_matches(spark, host, strict, loose):
    assert one(spark, urls.host_matches(F.col("h"), ["cnn.com", "bt.dk"]), h=host) is strict
    assert one(spark, urls.host_matches(F.col("h"), ["cnn.com", "bt.dk"], strict=False), h=host) is loose


def test_same_domain(spark):
    assert one(spark, urls.same_domain("a", "b"), a="WWW.bbc.com", b="bbc.com") is True
    assert one(spark, urls.same_domain("a", "b"), a="news.bbc.com", b="bbc.com") is False


SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_whitespace_agrees_with_unicode(spark):
    assert sorted(tx.WHITESPACE) == sorted(SPACES)
    text = "a".join(SPACES) + "b" + "".join(SPACES)
    assert one(spark, tx.strip("t"), t=" " + text) == text.strip()
    assert one(spark, tx.collapse_spaces("t"), t=text) == re.sub(r"\s+", " ", text).strip()


def test_clean_text(spark):
    assert one(spark, tx.clean_text("t"), t=" <p>a\n<b>c</b> d\xa0 e</p> x < y") == "a c d e x < y"
    assert one(spark, tx.normalize_text("t"), t="") is None
    assert one(spark, tx.normalize_text("t"), t="  a  b ") == "a b"


def test_mojibake(spark):
    assert one(spark, tx.fix_mojibake("t"), t="KÃ¸benhavn Ã† Ã˜ Ã… cafÃ© voilÃ ") == "København Æ Ø Å café voilà"
    assert one(spark, tx.fix_mojibake("t"), t="København") == "København"


def test_content_hash(spark):
    assert one(spark, tx.content_hash("t"), t="æ") == hashlib.md5("æ".encode()).hexdigest()
    assert one(spark, tx.content_hash("t"), t="") is None


def test_utf8_clean_drops_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa6"),), (bytearray("x�y".encode()),)], "b binary")
    got = [r.v for r in df.select(tx.utf8_clean(F.col("b").cast("string")).alias("v")).collect()]
    assert got == ["abæ", "x�y"]


def test_nfkc_is_optional(spark):
    assert one(spark, tx.nfkc("t"), t="ﬁ½") == unicodedata.normalize("NFKC", "ﬁ½")
    assert one(spark, tx.utf8_clean("t"), t="ﬁ½") == "ﬁ½"


@pytest.mark.parametrize("domain,text,word,anywhere", [
    ("a.dk", "", "da", "da"), ("a.com", "Dette er godt", "da", "da"), ("a.com", "other matters", "en", "da"),
    ("a.com", "sky", "en", "en"), ("a.com", None, "en", "en"),
])
def test_guess_language(spark, domain, text, word, anywhere):
    assert one(spark, tx.guess_language("d", "t"), d=domain, t=text) == word
    assert one(spark, tx.guess_language("d", "t", whole_words=False), d=domain, t=text) == anywhere


@pytest.mark.parametrize("domain,want", [("a.dk", "DK"), ("a.co.uk", "GB"), ("a.com", "US"), ("a.org", "US"), ("a.fr", "unknown")])
def test_guess_country(spark, domain, want):
    assert one(spark, tx.guess_country("d"), d=domain) == want


@pytest.mark.parametrize("raw,want", [
    ("20240101T101500Z", "2024-01-01 10:15"), ("2024-01-01T10:00:00+02:00", "2024-01-01 10:00"),
    ("2024-01-01T10:00:00.5", "2024-01-01 10:00"), ("2024-01-01", "2024-01-01"), ("some Thing", "some Thing"), (None, None),
])
def test_display_time(spark, raw, want):
    assert one(spark, times.display_time("t"), t=raw) == want


def test_parse_time(spark):
    read = F.date_format(times.parse_time("t"), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, read, t="20240101T101500Z") == "2024-01-01 10:15:00"
    assert one(spark, read, t="2024-01-01T10:00:00+02:00") == "2024-01-01 08:00:00"
    assert one(spark, read, t="no time") is None


def test_default_lists():
    assert len(dims.RELIABLE_DOMAINS) == len(set(dims.RELIABLE_DOMAINS)) == 75
    assert len(dims.DANISH_DOMAINS) == 28 and len(dims.PROBLEMATIC_DOMAINS) == 9
    assert len(dims.CORE_TERMS) == 19 and len(dims.KEYWORD_TERMS) == 16 and len(dims.TOPICS) == 14
    assert [t for t, _, _ in dims.TOPIC_LABELS] == dims.TOPICS
