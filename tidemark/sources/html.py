"""Pages, feeds and documents as rows. Parsing is per page; resolving, deduplicating and filtering are Columns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.functions import json_text
from tidemark.functions.dates import source_date
from tidemark.functions.text import link_title, squeezed, xml_plain
from tidemark.functions.urls import absolute, identity, is_public_https
from tidemark.sources import page_tree

# Wordings that pages use around dates and files.
PUBLISHED = ("date published", "published on", "published", "publication date", "date issued", "issued on", "release date")
TIMED = ("published", "publication", "date issued", "issued on", "release date")
OTHERWISE_TIMED = ("updated", "modified", "reviewed", "deadline", "closing", "close", "closes", "event date", "effective")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TOPICS = ("artificial intelligence", "ai", "policy", "standard", "framework", "guidance", "guideline", "practice note", "regulation", "legislation", "instrument")
FILE_ENDINGS, FILE_TYPES = ("pdf", "doc", "docx", "rtf"), ("pdf", "msword", "wordprocessingml", "rtf")
FILE_ACTIONS, FILE_NAMES = ("download", "view", "open", "read"), ("document", "file", "pdf", "word", "doc", "docx", "rtf")
# End of fixed values.

LINK = "array<struct<at:int,href:string,title:string,text:string,dates:array<string>>>"
EVIDENCE = "struct<shown:string,metas:array<string>,times:array<struct<value:string,property:string,context:string>>,others:array<string>>"
FIELDS = f"og:string,h1:string,title:string,evidence:{EVIDENCE},text:string"
FILE = "array<struct<at:int,tag:string,value:string,words:string,type:string,download:boolean,headings:string>>"


#: Pages that a worker has parsed at a time; it gets as many as make a batch of Spark's.
PAGES = 100


def _parsed(function: Callable) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A task that gives what is read from few pages at a time, as Arrow, so that no batch stands as trees or Python objects."""

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in batches:
            for at in range(0, len(held), PAGES):
                yield function(held.slice(at, PAGES).to_pylist())

    return task


def _rows(function: Callable, schema: str) -> Callable[[Column], Column]:
    def applied(column: Column) -> Column:
        kind = to_arrow_type(StructType.fromDDL(f"held {schema}")["held"].dataType)
        task = _parsed(lambda xs: pa.array([function(x) for x in xs], kind))
        return F.arrow_udf(task, schema, F.ArrowUDFType.SCALAR_ITER)(column)

    return applied


def _one_of(words: tuple[str, ...]) -> str:
    """A pattern for whole words, with any white space between them."""
    return r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def semantic(html: str | None) -> str:
    return page_tree.semantic_text(page_tree.page(html))


def semantic_text(html: Column) -> Column:
    """Text of the first of main, article or body, without the page's frame."""
    return _rows(semantic, "string")(html)


def links(html: Column) -> Column:
    """The links of an index page that stand for entries, in order, with their entry's text and what may date it."""
    return _rows(lambda x: page_tree.entry_links(page_tree.page(x)), LINK)(html)


def page_fields(html: Column) -> Column:
    """og title, first heading, title, what may date the page, and its text; a page is parsed once."""
    return _rows(lambda x: page_tree.fields(page_tree.page(x)), f"struct<{FIELDS}>")(html)


def _first_date(texts: Column) -> Column:
    return F.get(F.filter(F.transform(texts, source_date), lambda d: d.isNotNull()), 0)


def published(evidence: Column) -> Column:
    """(date, precision): the date after a visible label, else from metadata, else of a time that the words around it say is
    that of publication and of nothing else, else from what metadata call a date. Null if there is none."""
    day = rf"(?:(?:{'|'.join(WEEKDAYS)})\s*)?"
    form = r"((?:\d{1,2}\s+[a-z]+\s+\d{4})|(?:[a-z]+\s+\d{4})|(?:\d{4}-\d{2}(?:-\d{2})?))"
    label = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in PUBLISHED) + r")\s*:?\s*" + day + form
    shown = source_date(F.nullif(F.regexp_extract(evidence["shown"], label, 1), F.lit("")))
    said = lambda t: F.rlike(t["context"], F.lit("(?i)" + _one_of(TIMED))) & ~F.rlike(t["context"], F.lit("(?i)" + _one_of(OTHERWISE_TIMED)))
    times = F.transform(F.filter(evidence["times"], lambda t: (t["property"] == "datepublished") | said(t)), lambda t: t["value"])
    return F.coalesce(shown, _first_date(evidence["metas"]), _first_date(times), _first_date(evidence["others"]))


def document_candidate(pages: DataFrame, html: str = "html", url: str = "url", fallback: str | None = None, most: int = 600) -> DataFrame:
    """(url, title, text, date, precision): one candidate a page; the first title that isn't empty, cleaned, else ``fallback``.
    White space around a title is no part of it, so that an icon's name before it is at the title's end."""
    held = pages.select(url, F.col(fallback or url).alias("_fallback"), page_fields(F.col(html)).alias("f"))
    full = lambda c: F.nullif(c, F.lit(""))
    title = full(link_title(squeezed(F.coalesce(full(F.col("f.og")), full(F.col("f.h1")), full(F.col("f.title")), F.col("_fallback")))))
    dated = held.withColumn("_d", published(F.col("f.evidence")))
    return dated.select(url, F.coalesce(title, "_fallback").alias("title"), F.left("f.text", F.lit(most)).alias("text"), F.col("_d.date").alias("date"), F.col("_d.precision").alias("precision"))


def index_candidates(pages: DataFrame, relevant: Callable[[Column, Column], Column], most: int = 25, page: str = "page_id", html: str = "html", url: str = "url", allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Candidates of index pages: links of entries to other pages on ``allowed`` hosts with titles of eight characters or more,
    the first of each url, then relevant ones, at most ``most`` a page in document order. ``items`` counts before
    relevance. One gathering of each page's links, which the page bounds, gives places and counts."""
    each = pages.select(F.col(page).alias("page"), F.col(url).alias("base"), F.inline(links(F.col(html))))
    named = each.withColumn("title", link_title(F.col("title"))).where(F.char_length("title") >= 8).withColumn("url", absolute(F.col("href"), F.col("base")))
    kept = named.where(F.col("url").isNotNull() & (F.col("url") != identity(F.col("base"))) & (allowed(F.col("url")) if allowed else F.lit(True)))
    candidate = F.struct("at", "url", "title", F.left("text", F.lit(300)).alias("text"), _first_date(F.col("dates")).alias("d"))
    firsts = kept.groupBy("page", "url").agg(F.min_by(candidate, "at").alias("c"))
    listed = firsts.groupBy("page").agg(F.array_sort(F.collect_list("c")).alias("cs")).select("page", F.size("cs").alias("items"), F.filter("cs", lambda c: relevant(c["title"], c["url"])).alias("cs"))
    out = listed.select("page", F.col("items").cast("long").alias("items"), F.posexplode(F.slice("cs", 1, most)).alias("place", "c"))
    return out.select("page", (F.col("place") + 1).alias("place"), "c.url", "c.title", "c.text", F.col("c.d.date").alias("date"), F.col("c.d.precision").alias("precision"), "items")


def linked_files(pages: DataFrame, html: str = "html", url: str = "url", most: int = 8) -> DataFrame:
    """(url, files, error): the addresses of the policy files that a page's content refers to, in order. A reference counts if it
    looks like a file and its own words say that it is on the topic, or if it only says to open it and the headings do.
    More than ``most``, or one that isn't public and safe, is an error and not a shorter list."""
    held = pages.select(F.monotonically_increasing_id().alias("_row"), url, _rows(lambda x: page_tree.file_references(page_tree.page(x)), FILE)(F.col(html)).alias("_files"))
    each = held.select("_row", url, F.inline_outer("_files"))
    like = lambda c, pattern: F.rlike(c, F.lit("(?i)" + pattern))
    ending = rf"\.(?:{'|'.join(FILE_ENDINGS)})(?:$|[?#])"
    action = rf"^(?:{'|'.join(FILE_ACTIONS)})(?:\s+(?:the\s+)?(?:{'|'.join(FILE_NAMES)}))?$"
    is_file = like(F.col("value"), ending) | like(F.col("type"), "|".join(FILE_TYPES)) | F.col("download") | like(F.col("value"), r"(?:^|/)(?:download|attachment)(?:/|$|[?#])")
    bare = (F.col("tag") != "a") | like(F.col("words"), action) | (F.col("download") & (F.col("words") == ""))
    topical = like(F.concat_ws(" ", "words", "value"), _one_of(TOPICS)) | (bare & like(F.col("headings"), _one_of(TOPICS)))
    found = each.withColumn("_to", F.when(is_file & topical & ~F.lower("value").startswith("javascript:"), absolute(F.col("value"), F.col(url))))
    listed = found.groupBy("_row", url).agg(F.array_sort(F.collect_set("_to")).alias("files"), F.bool_or(F.col("_to").isNotNull() & ~is_public_https(F.col("_to"))).alias("_unsafe"))
    error = F.when(F.col("_unsafe"), "unsafe file").when(F.size("files") > most, "too many files")
    return listed.select(url, F.when(error.isNull(), F.col("files")).alias("files"), error.alias("error"))


def feed_items(feeds: DataFrame, xml: str = "xml", key: str = "feed_id") -> DataFrame:
    """(feed, at, title, url, date): items of RSS and entries of Atom feeds; lenient about everything between them."""
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    each = feeds.select(F.col(key).alias("feed"), F.posexplode(items).alias("at", "item"))

    def field(*names: str) -> Column:
        pattern = rf"(?s)<(?:{'|'.join(names)})\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:{'|'.join(names)})>"
        return F.nullif(squeezed(xml_plain(F.regexp_extract("item", pattern, 1))), F.lit(""))

    href = F.nullif(F.regexp_extract("item", r"<link\b[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return each.select("feed", "at", field("title").alias("title"), identity(F.coalesce(field("link"), href)).alias("url"), field("pubDate", "published", "updated", "dc:date").alias("date"))


def feed_valid(xml: Column) -> Column:
    return F.rlike(xml, F.lit(r"<(?:channel|feed)\b"))


def docx(content: bytes | None, most: int = 4 << 20) -> dict:
    """(text, error) of a Word file; the error says whether it is none, is encrypted, or is larger than ``most`` bytes inside."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as held:
            info = held.getinfo("word/document.xml")
            if info.flag_bits & 1:
                return {"text": None, "error": "encrypted"}
            if info.file_size > most:
                return {"text": None, "error": "too large"}
            xml = held.read(info).decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, RuntimeError):
        return {"text": None, "error": "not a Word file"}
    text = re.sub(r"<w:tab\b[^>]*/>", "\t", re.sub(r"<w:br\b[^>]*/>|</w:p>", "\n", xml))
    text = unescape(re.sub(r"<[^>]+>", "", text))
    return {"text": re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip(), "error": None}


def docx_text(content: Column) -> Column:
    """(text, error)."""
    made = F.pandas_udf(lambda xs: pd.DataFrame([docx(x) for x in xs], columns=["text", "error"]), "text string, error string")
    return made(content)


def retrieve(targets: DataFrame, fetch: Callable[[str], dict], url: str = "url", attempts: int = 2) -> DataFrame:
    """(url, ok, status, body, error) from an injected fetcher; errors are rows. 408, 429 and 5xx are tried again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for target in frame[url]:
                row = None
                for _ in range(attempts):
                    try:
                        got = fetch(target)
                        status = int(got.get("status", 200))
                        row = (target, 200 <= status < 300, status, got.get("body"), None)
                        if status not in (408, 429) and status < 500:
                            break
                    except Exception as error:  # noqa: BLE001  a failed fetch is a result
                        row = (target, False, None, None, f"{type(error).__name__}: {error}")
                out.append(row)
            yield pd.DataFrame(out, columns=["url", "ok", "status", "body", "error"])

    return targets.select(url).mapInPandas(run, "url string, ok boolean, status int, body string, error string")


def json_array(reply: Column, schema: str) -> Column:
    """The rows of a reply's first array; null where there is none that is closed and parses."""
    array = F.regexp_extract(reply, r"(?s)\[.*", 0)
    return F.from_json(json_text.balanced(array), f"array<struct<{schema}>>")
