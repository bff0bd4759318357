"""URLs as columns: one canonicaliser with a policy, hosts, keys, links."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.text import short_hash


@dataclass(frozen=True)
class UrlPolicy:
    """drop: pattern for names of query parameters to take out (matched from the start, any case).
    drop_query_under: pattern of paths whose whole query goes. invalid: what bad input gives (None: the input, trimmed).
    standard: the address is parsed as browsers do first (see standard_url)."""

    drop: str | None = None
    drop_query_under: str | None = None
    strip_slash: bool = False
    invalid: str | None = None
    standard: bool = False


#: What each use of addresses in the collection pipeline takes out.
SCOPE = UrlPolicy(drop=r"(?:utm_|fbclid|gclid|yclid|_ga|ref$)", strip_slash=True)
REVISIT = UrlPolicy(drop=r"(?:utm_|fbclid|gclid|yclid|_ga|ref$)", strip_slash=True, invalid="")
CANDIDATE = UrlPolicy(drop_query_under=r"/(?:e|event)/")
OPAQUE = UrlPolicy(drop=r"(?:utm_|fbclid$|gclid$|yclid$|ref$|source$)")
IDENTITY = UrlPolicy(drop=r"(?:utm_|ref$|source$|from$|fbclid$|gclid$)", strip_slash=True, invalid="")
TARGET = UrlPolicy(drop=r"(?:utm_|ref$|source$|from$|fbclid$|gclid$|usp$|edit_requested$)", strip_slash=True, invalid="")

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(url: Column, part: str) -> Column:
    """scheme, host, path or query (with its question mark) of an address; "" where it is none."""
    group = {"scheme": 1, "host": 2, "path": 3, "query": 4}[part]
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, group)
    if part == "host":
        found = F.regexp_replace(F.regexp_replace(F.lower(found), r"^[^@]*@", ""), r":\d+$", "")
    return F.lower(found) if part == "scheme" else found


def host(url: Column) -> Column:
    """Host in lower case without a leading www.; "" for no address."""
    return F.regexp_replace(url_part(url, "host"), r"^www\.", "")


def host_under(host_col: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    hit = F.lit(False)
    for d in domains:
        d = d.lower().removeprefix("www.")
        hit = hit | (host_col == d) | host_col.endswith("." + d)
    return hit


def canonical_url(url: Column, policy: UrlPolicy = SCOPE) -> Column:
    """The address without fragment and tracking parameters, scheme and host in lower case."""
    url = F.coalesce(url, F.lit(""))
    if policy.standard:
        parsed = standard_url(url)
        return F.when(parsed.isNull(), F.trim(url) if policy.invalid is None else F.lit(policy.invalid)).otherwise(canonical_url(parsed, replace(policy, standard=False)))
    path = url_part(url, "path")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.substring(url_part(url, "query"), F.lit(2), F.length(url))
    if policy.drop:
        names = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike("^" + policy.drop))
        query = F.array_join(names, "&")
    if policy.drop_query_under:
        query = F.when(path.rlike(policy.drop_query_under), F.lit("")).otherwise(query)
    port = F.regexp_extract(F.regexp_extract(url, _PARTS, 2), r"(:\d+)$", 1)
    scheme = url_part(url, "scheme")
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), F.lit("")).otherwise(port)
    whole = F.concat(scheme, F.lit("://"), url_part(url, "host"), port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    if policy.strip_slash:
        whole = F.regexp_replace(whole, "/$", "")
    bad = F.trim(url) if policy.invalid is None else F.lit(policy.invalid)
    return F.when(url_part(url, "host") != "", whole).otherwise(bad)


#: Characters that stay as they are in paths, queries and fragments (the URL standard's percent-encode sets).
_PATH_KEEPS, _QUERY_KEEPS, _FRAGMENT_KEEPS = r"[!$%&'()*+,\-./0-9:;=@A-Z\[\]\\_a-z|~]", r"[!$%&()*+,\-./0-9:;=?@A-Z\[\]\\^_`a-z{|}~]", r"[!#$%&'()*+,\-./0-9:;=?@A-Z\[\]\\^_a-z{|}~]"


def percent_encoded(text: Column, keeps: str) -> Column:
    """Text with all characters but those that `keeps` matches as their UTF-8 bytes in hexadecimal."""
    coded = lambda c: F.when(c.rlike(keeps), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.when(text.rlike(f"^(?:{keeps})*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), coded), ""))


def without_dots(path: Column) -> Column:
    """A path without . and .. segments, encoded ones too; a segment that goes up from the root stays there."""
    one, two = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))

    def walk(segments: Column) -> Column:
        last = F.size(segments) - 1
        tail = lambda s, kept: F.when(s["i"] == last, F.concat(kept, F.array(F.lit("")))).otherwise(kept)

        def step(s: Column, part: Column) -> Column:
            up = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
            out = F.when(part.rlike(two), tail(s, up)).when(part.rlike(one), tail(s, s["out"])).otherwise(F.concat(s["out"], F.array(part)))
            return F.struct(out.alias("out"), (s["i"] + 1).alias("i"))

        return F.concat(F.lit("/"), F.array_join(F.aggregate(segments, start, step, lambda s: s["out"]), "/"))

    inside = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), F.element_at(F.transform(F.array(inside), walk), 1)).otherwise(path)


@F.pandas_udf(T.StringType())
def _ascii_host(hosts: pd.Series) -> pd.Series:
    """Labels in Punycode where they have other letters (NFKC and lower case first); null where a host can't be one."""
    import unicodedata
    from urllib.parse import unquote

    def one(host):
        if host is None:
            return None
        labels = []
        for label in unicodedata.normalize("NFKC", unquote(host)).lower().replace("\u3002", ".").split("."):
            label = unicodedata.normalize("NFC", label)
            labels.append(label if label.isascii() else "xn--" + label.encode("punycode").decode())
        out = ".".join(labels)
        return None if not out or any(c in out for c in " #%/:<>?@[\\]^|") or any(ord(c) < 33 or ord(c) == 127 for c in out) else out

    return hosts.map(one)


def ascii_host(host_col: Column) -> Column:
    """A host name in ASCII, null where it can't be one. Python sees hosts with other letters, percent signs or forbidden characters only."""
    plain = r"^[a-z0-9.\-_~!$&'()*+,;=]+$"
    lower = F.lower(host_col)
    return F.when(lower.rlike(plain), lower).otherwise(_ascii_host(F.when(~lower.rlike(plain), host_col)))


def standard_url(url: Column) -> Column:
    """An http or https address as the URL standard serialises it: control characters and outer blanks off, scheme and host in lower case, other letters
    of the host in Punycode, default ports off, backslashes as slashes, dot segments resolved, path, query and fragment percent-encoded; null for no such address."""
    tidy = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$", ""), "[\t\n\r]", "")
    parts = r"(?is)^(https?):[/\\]*([^/\\?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda g: F.regexp_extract(tidy, parts, g)
    scheme, authority = F.lower(part(1)), part(2)
    login = F.regexp_extract(authority, "^(.*@)", 1)
    rest = F.regexp_replace(authority, "^.*@", "")
    port = F.regexp_extract(rest, r":(\d*)$", 1)
    number = F.regexp_replace(port, "^0+(?=.)", "")
    shown = F.when((number == "") | ((scheme == "http") & (number == "80")) | ((scheme == "https") & (number == "443")), "").otherwise(F.concat(F.lit(":"), number))
    name = ascii_host(F.regexp_replace(rest, r":\d*$", ""))
    path = percent_encoded(F.translate(part(3), "\\", "/"), _PATH_KEEPS)
    path = F.when(path == "", F.lit("/")).otherwise(without_dots(path))
    query = F.when(F.regexp_replace(tidy, "(?s)#.*$", "").contains("?"), F.concat(F.lit("?"), percent_encoded(part(4), _QUERY_KEEPS))).otherwise("")
    fragment = F.when(tidy.contains("#"), F.concat(F.lit("#"), percent_encoded(part(5), _FRAGMENT_KEEPS))).otherwise("")
    sound = tidy.rlike(parts) & name.isNotNull() & (F.length(number) <= 5) & (F.coalesce(number.try_cast("int"), F.lit(0)) <= 65535)
    return F.when(sound, F.concat(scheme, F.lit("://"), login, name, shown, path, query, fragment))


def opaque_key(url: Column) -> Column:
    """A short hash that stands for an address, so that state holds no addresses."""
    return short_hash(canonical_url(url, OPAQUE))


def event_slug(url: Column) -> Column:
    """Name of an event page: the path part behind /e/."""
    return F.lower(F.regexp_extract(url_part(url, "path"), r"/e/([A-Za-z0-9_-]+)", 1))


def form_url(url: Column) -> Column:
    """Google Forms address in its view form; "" for other addresses."""
    h, path = url_part(url, "host"), url_part(url, "path")
    form = F.regexp_extract(path, r"^(/forms/(?:u/\d+/)?d/(?:e/)?[A-Za-z0-9_-]+)", 1)
    return (
        F.when((h == "forms.gle") & (F.length(path) > 1), F.concat(F.lit("https://forms.gle"), F.regexp_replace(path, "/$", "")))
        .when(h.isin("docs.google.com", "forms.google.com") & (form != ""), F.concat(F.lit("https://docs.google.com"), form, F.lit("/viewform")))
        .otherwise(F.lit(""))
    )


def identity_url(url: Column) -> Column:
    """Address as an identity: event pages by slug, forms by view form, others without tracking parameters."""
    slug = F.when(host_under(host(url), ["livepocket.jp"]), event_slug(url)).otherwise(F.lit(""))
    return (
        F.when(slug != "", F.concat(F.lit("https://t.livepocket.jp/e/"), slug)).when(form_url(url) != "", form_url(url)).otherwise(canonical_url(url, IDENTITY))
    )


def identity_key(url: Column, shop: Column, product: Column, deadline: Column, external_id: Column) -> Column:
    """What names a record: address with variant, else an external id, else shop, product and deadline."""
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s・･\-_]+", "")
    variant = F.concat_ws("|", clean(shop), clean(product), F.coalesce(deadline, F.lit("")))
    link = identity_url(url)
    external = F.coalesce(external_id, F.lit(""))
    return (
        F.when(link != "", F.concat(F.lit("url:"), link, F.lit("|variant:"), variant))
        .when(external != "", F.concat(F.lit("id:"), external))
        .otherwise(F.concat(F.lit("fallback:"), variant))
    )


@F.pandas_udf(T.StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute address of a reference on a page; null where it can't be one."""
    from urllib.parse import urljoin, urlsplit

    def one(h, b):
        try:
            whole = urljoin(b or "", h or "")
            parts = urlsplit(whole)
            return whole if parts.scheme and (parts.netloc or parts.scheme not in ("http", "https")) else None
        except ValueError:
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype=object)
