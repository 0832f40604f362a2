from pyspark.sql import functions as F

from tidemark.functions import dates, hashing, text, urls


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_slug_may_end_in_a_dash_after_the_cut(spark):
    assert one(spark, "  Hello, World! ", text.slug) == "hello-world"
    assert one(spark, "ab cd", lambda c: text.slug(c, 3)) == "ab-"


def test_url_identity(spark):
    ask = lambda u: one(spark, u, urls.identity)
    assert ask(" HTTPS://Www.Example.COM:443/A/?utm_source=x&b=2&a=1&gclid=3#top ") == "https://www.example.com/A?a=1&b=2"
    assert ask("http://example.com") == "http://example.com/"
    assert ask("http://example.com:80//") == "http://example.com/"
    assert ask("not a url ") == "not a url"
    assert ask("http://e.com/?b=1&a=2&b=0") == "http://e.com/?a=2&b=0&b=1" or ask("http://e.com/?b=1&a=2&b=0") == "http://e.com/?a=2&b=1&b=0"


def test_url_weak_keeps_order_and_drops_ref(spark):
    assert one(spark, "http://e.com/a/?z=1&ref=x&a=2#f", urls.weak) == "http://e.com/a/?z=1&a=2"
    assert one(spark, "http://e.com/a/", urls.weak) == "http://e.com/a"


def test_public_https(spark):
    for url, good in (("https://a.gov.au/x", True), ("http://a.gov.au", False), ("https://a.gov.au:444/", False), ("https://u@a.gov.au/", False), ("https://localhost/", False), ("", False)):
        assert one(spark, url, urls.is_public_https) is good, url
    assert one(spark, "https://www.a.gov.au/x", lambda c: urls.is_allowed(c, [".gov.au"])) is True


def test_absolute(spark):
    rows = spark.createDataFrame([("../b?utm_x=1", "https://e.com/a/c"), ("mailto:x@y", "https://e.com/"), (None, "https://e.com/")], "h string, b string")
    assert [r[0] for r in rows.select(urls.absolute(F.col("h"), F.col("b"))).collect()] == ["https://e.com/b", None, None]


def test_source_dates(spark):
    for given, want in {
        "2024-02-29T10:00": ("2024-02-29", "day"),
        "2024-02-30": None,
        "2024-13": None,
        "2024-05": ("2024-05-01", "month"),
        "2024": ("2024-01-01", "year"),
        "on 3/4/2021": ("2021-04-03", "day"),
        "5 Sept 2020": ("2020-09-05", "day"),
        "31 February 2020": None,
        "May 2019": ("2019-05-01", "month"),
        "Soon": None,
        None: None,
    }.items():
        got = one(spark, given, dates.source_date)
        assert (None if got is None else tuple(got)) == want, given


def test_hashes(spark):
    def djb(s):
        h = 5381
        for c in s:
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(c)
        return h

    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "https://example.com/x?y=1"):
        assert one(spark, s, hashing.djb2) == djb(s)
        assert one(spark, s, hashing.fnv1a) == fnv(s)


def test_fingerprint_and_kind(spark):
    good = "a" * 64 + ":12"
    assert tuple(one(spark, good, hashing.fingerprint)) == ("a" * 64, 12)
    assert one(spark, "a" * 64 + ":0", hashing.fingerprint) is None
    row = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"PK\x03\x04rest"),), (bytearray(b"text"),)], "c binary")
    assert [r[0] for r in row.select(hashing.kind_of(F.col("c"))).collect()] == ["pdf", "docx", None]


def test_text(spark):
    assert one(spark, "Report (opens in a new window) PDF, 3.2 MB north_east", text.link_title) == "Report"
    assert one(spark, "Government announces  Big Plan | News", text.headline) == "big plan"
    assert one(spark, "court_note_x", text.display_name) == "Court Note X"
    assert one(spark, None, text.display_name) == "Unknown"
    assert one(spark, "word " * 200, text.summary).endswith("word…")
    assert one(spark, "One. Two! Three? Four. Five.", text.first_sentences) == "One. Two! Three? Four."
