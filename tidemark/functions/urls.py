"""URL functions as Columns: two canonical forms, safety checks, parts."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with the register's own lists.
TRACKING = ("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
WEAK_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "ref", "fbclid")
# End of fixed values.

SHAPE = r"^(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


#: Most addresses: of printable ASCII, with a plain host, a path, and no query but parameters of campaigns. The group is its
#: canonical form. No part is gone back into, so that one look costs a third of one at the pattern below.
COMMON = (
    r"\A(https?://[a-z0-9.-]++(?:/(?=[/?#]|\z)|(?:/++[!-\x22$-.0->@-~]++)++))/*+"
    r"(?:\?(?:&*+utm_[!-\x22$-%\x27-~]*+)*+&*+)?+(?:#[!-~]*+)?+\z"
)
#: Most addresses with a plain host, without user and port. The group is the host.
COMMON_HOST = r"\Ahttps?://([a-z0-9.-]++)(?:[/?#][!-~]*+)?+\z"
#: An address in canonical form that has no query.
PLAIN = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*/(?:[^?#\s]*[^?#/\s])?$"
#: An address that is in canonical form but for what is dropped from its end: slashes, a query that is only campaign
#: parameters, a fragment. The group is its canonical form.
LOADED = (
    r"^(https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*/[^?#\s]*[^?#/\s])/*"
    rf"(?:\?&*(?:(?i:utm_[^&#\s]*|(?:{'|'.join(TRACKING)})(?:=[^&#\s]*)?)(?:&+|(?=#|\z)))*)?(?:#[!-~]*)?\z"
)
#: An address over https with a plain host that has a dot, and no user or port. The group is its host.
SIMPLE = r"^https://([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?:[/?#][!-~]*)?\z"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), SHAPE, group)


def is_url(url: Column) -> Column:
    return F.rlike(F.trim(url), F.lit(SHAPE)) & (part(url, 2) != "")


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    common = F.regexp_extract(url, COMMON_HOST, 1)
    return F.when(common != "", common).otherwise(_any_host(url))


def _any_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), "^.*@", ""), r":\d*$", "")


def _built(url: Column, build) -> Column:
    """``build`` over the url's parts, each read once; null where the text isn't a URL with a host."""
    parts = F.struct(F.lower(part(url, 1)).alias("scheme"), F.lower(part(url, 2)).alias("authority"), part(url, 3).alias("path"), part(url, 4).alias("query"))
    return F.get(F.transform(F.array(parts), lambda p: F.when((p["scheme"] != "") & (p["authority"] != ""), build(p))), 0)


def _authority(p: Column) -> Column:
    """Host and port, without the scheme's own port."""
    held = p["authority"]
    own = ((p["scheme"] == "https") & held.endswith(":443")) | ((p["scheme"] == "http") & held.endswith(":80"))
    return F.when(own, F.regexp_replace(held, r":\d+$", "")).otherwise(held)


def _rebuilt(p: Column, path: Column, pairs: Column) -> Column:
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.concat(p["scheme"], F.lit("://"), _authority(p), path, query)


def _name(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def canonical(url: Column) -> Column:
    """The identity of a source: no fragment, no campaign parameters, the others sorted by name, no slash at
    the end of a path. Null where the text isn't a URL with a host. Escapes are left as they are."""
    dropped = lambda q: F.lower(_name(q)).startswith("utm_") | F.lower(_name(q)).isin(*TRACKING)

    def build(p: Column) -> Column:
        kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~dropped(q))
        indexed = F.transform(kept, lambda q, i: F.struct(_name(q).alias("name"), i.alias("at"), q.alias("pair")))
        path = F.regexp_replace(p["path"], "/+$", "")
        return _rebuilt(p, F.when(path == "", F.lit("/")).otherwise(path), F.transform(F.array_sort(indexed), lambda s: s["pair"]))

    # most addresses have nothing to be changed, or something at their end only, which one look each shows
    common = F.regexp_extract(url, COMMON, 1)
    return F.when(url.isNull(), F.lit(None)).when(common != "", common).when(F.rlike(url, F.lit(PLAIN)), url).when(F.rlike(url, F.lit(LOADED)), F.regexp_extract(url, LOADED, 1)).otherwise(_built(url, build))


def identity(url: Column) -> Column:
    """Canonical, or the trimmed text where that isn't one."""
    return F.coalesce(canonical(url), F.trim(url))


def weak(url: Column) -> Column:
    """The weaker form: five parameters gone, order kept, one slash off the end."""

    def build(p: Column) -> Column:
        kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~_name(q).isin(*WEAK_TRACKING))
        path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        return F.regexp_replace(_rebuilt(p, path, kept), "/$", "")

    return F.coalesce(_built(url, build), F.regexp_replace(url, "/+$", ""))


def identities(*urls: Column) -> Column:
    """Distinct identities of the given urls, in order, without empty ones."""
    given = F.filter(F.array(*urls), lambda u: u.isNotNull() & (u != ""))
    return F.array_distinct(F.transform(given, identity))


def is_public_https(url: Column) -> Column:
    port = F.regexp_extract(part(url, 2), r":(\d*)$", 1)
    return F.coalesce(is_url(url) & (F.lower(part(url, 1)) == "https") & port.isin("", "443") & ~F.contains(part(url, 2), F.lit("@")) & F.contains(host(url), F.lit(".")), F.lit(False))


def is_allowed(url: Column, suffixes: Sequence[str], hosts: Sequence[str] = ()) -> Column:
    def named(held: Column) -> Column:
        out = held.isin(*hosts) if hosts else F.lit(False)
        for s in suffixes:
            out = out | held.endswith(s)
        return out

    # most hosts one look shows
    simple = F.regexp_extract(url, SIMPLE, 1)
    return F.when(url.isNull(), False).when(simple != "", named(simple)).otherwise(is_public_https(url) & named(host(url)))


def title_from(url: Column) -> Column:
    """The last path segment, decoded, without its extension, dashes as spaces."""
    last = F.element_at(F.filter(F.split(part(url, 3), "/"), lambda p: p != ""), -1)
    last = F.when(F.size(F.filter(F.split(part(url, 3), "/"), lambda p: p != "")) > 0, last)
    return F.regexp_replace(F.regexp_replace(F.try_url_decode(last), r"\.[A-Za-z0-9]{1,5}$", ""), "[-_]+", " ")


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, 3)).endswith(".pdf"), F.lit(False))


def absolute(href: Column, base: Column) -> Column:
    """RFC 3986 resolution, then canonical; null if it isn't http or https."""

    def joined(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        out = []
        for h, b in zip(hrefs, bases):
            try:
                out.append(urljoin(b or "", h) if h is not None else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    full = F.pandas_udf(joined, "string")(href, base)
    return F.when(F.lower(part(full, 1)).isin("http", "https"), canonical(full))


def landed_on_home(asked: Column, got: Column) -> Column:
    """Whether a request for a page ended at its site's front page."""
    root = lambda u: F.lower(part(u, 3)).isin("", "/", "/home", "/home/", "/index.html", "/index.htm", "/index.php", "/default.aspx")
    return ~root(asked) & root(got)
