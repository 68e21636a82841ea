"""URLs and domains as column expressions. Regular expressions, since URL parsers return null for lenient input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import let, trim_ws
from .dictionaries import CONTACT_FILE_EXTENSIONS, FILE_EXTENSIONS, LOADING_TITLES, MARKETPLACES, SOCIAL_DOMAINS, TWO_LABEL_SUFFIXES

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query, 5 fragment; '' where absent."""
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def looks_like_website(c: Column) -> Column:
    """A dotted host, optionally with scheme and path; no address, no blanks; the last label has a letter."""
    t = trim_ws(c)
    label = r"[^\s@/?#:.]+"
    return F.coalesce(~F.contains(t, F.lit("@")) & t.rlike(rf"^(?:[Hh][Tt][Tt][Pp][Ss]?://)?(?:{label}\.)+(?=[^\s@/?#:.]*\p{{L}})[^\s@/?#:.]{{2,}}(?::\d+)?(?:[/?#]\S*)?$"), F.lit(False))


def normalize_url(c: Column) -> Column:
    """Trimmed, https:// where no scheme is given, null without a host."""
    t = trim_ws(c)
    u = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(F.startswith(t, F.lit("//")), F.concat(F.lit("https:"), t)).otherwise(F.concat(F.lit("https://"), t))
    return F.when((t != "") & (host(u) != ""), u)


def canonical_url(url: Column, keep_query: bool = False) -> Column:
    """Lower-case scheme and host, no trailing slash, no fragment."""
    p = F.regexp_replace(path(url), "/+$", "")
    out = F.concat(scheme(url), F.lit("://"), F.lower(host(url)), F.when(p == "", "/").otherwise(p))
    return F.concat(out, F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")) if keep_query else out


def bare_host(url: Column) -> Column:
    h = F.when(F.contains(url, F.lit("//")), host(url)).otherwise(F.regexp_extract(url, r"^([^/?#]*)", 1))
    return F.lower(F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":\d*$", ""))


def registered_domain(url: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label before it; null without a host. Suffixes of two labels are a parameter."""
    two = lambda h: F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    three = lambda h: F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return let(F.regexp_replace(bare_host(url), r"\.+$", ""), lambda h: F.when(h == "", None).when(two(h) == "", h).when(two(h).isin(*suffixes) & (three(h) != ""), three(h)).otherwise(two(h)))


def domain_in(url: Column, domains: tuple[str, ...]) -> Column:
    """By registered domain, or by the whole host for entries of more labels."""
    return F.coalesce(registered_domain(url).isin(*domains) | F.regexp_replace(bare_host(url), r"^www\.", "").isin(*domains), F.lit(False))


def is_marketplace(url: Column) -> Column:
    return domain_in(url, MARKETPLACES)


def is_social(url: Column) -> Column:
    return domain_in(url, SOCIAL_DOMAINS)


def join_url(base: Column, href: Column) -> Column:
    """A link against its page's address: absolute, //host, /root, ?query or relative; one level of ../ per pair is resolved."""
    origin = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), r"[^/]*$", "")
    joined = F.concat(folder, href)
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"^(.*?)/(?!\.\./)[^/]+/\.\./", "$1/")
    joined = F.regexp_replace(joined, r"^(?:/\.\.)+/", "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, F.when(path(base) == "", "/").otherwise(path(base)), href))
        .otherwise(F.concat(origin, joined))
    )


def resolve_href(base: Column, href: Column, keep_query: bool = False, excluded: tuple[str, ...] | None = None) -> Column:
    """Crawlable links; null for mail, telephone, script and anchor links, other schemes and files."""
    excluded = excluded or (CONTACT_FILE_EXTENSIONS if keep_query else FILE_EXTENSIONS)
    ends = "(?:" + "|".join(e.replace(".", r"\.") for e in excluded) + ")$"

    def of(u: Column) -> Column:
        p = F.when(path(u) == "", "/").otherwise(path(u))
        out = F.concat(scheme(u), F.lit("://"), host(u), p)
        if keep_query:
            out = F.concat(out, F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise(""))
        return F.when(scheme(u).isin("http", "https") & (host(u) != "") & ~F.lower(p).rlike(ends), out)

    usable = lambda h: (h != "") & ~F.lower(h).rlike(r"^(?:mailto:|tel:|javascript:|#)")
    return let(trim_ws(href), lambda h: F.when(usable(h), let(join_url(base, h), of)))


def same_domain(a: Column, b: Column) -> Column:
    """U8: true where b has no domain."""
    db = registered_domain(b)
    return db.isNull() | F.coalesce(registered_domain(a) == db, F.lit(False))


def entry_variants(url: Column) -> Column:
    """The address and its http/https and www/no-www forms, the given scheme first, without fragment."""
    h = F.regexp_replace(host(url), r"^(?i:www\.)", "")
    www = F.when(host(url).rlike(r"^(?i:www\.)"), F.array(F.concat(F.lit("www."), h), h)).otherwise(F.array(h, F.concat(F.lit("www."), h)))
    tail = F.concat(F.when(path(url) == "", "/").otherwise(path(url)), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    schemes = F.when(scheme(url) == "http", F.array(F.lit("http"), F.lit("https"))).otherwise(F.array(F.lit("https"), F.lit("http")))
    made = F.flatten(F.transform(schemes, lambda s: F.transform(www, lambda w: F.concat(s, F.lit("://"), w, tail))))
    return F.array_distinct(F.concat(F.array(F.regexp_replace(url, "#.*$", "")), made))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; '' where absent."""
    return F.coalesce(F.try_url_decode(F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))


def unwrap_redirect(url: Column) -> Column:
    """The target behind a search engine's redirect; its own pages are null, other addresses stay."""
    relative = F.startswith(url, F.lit("/url?")) & ~F.startswith(url, F.lit("//"))

    def of(a: Column) -> Column:
        target = lambda *names: F.nullif(F.coalesce(*[F.nullif(query_value(a, n), F.lit("")) for n in names], F.lit("")), F.lit(""))
        return let(
            registered_domain(a),
            lambda d: F.when(relative, target("q", "url"))
            .when((d == "duckduckgo.com") & F.startswith(path(a), F.lit("/l/")), target("uddg"))
            .when((d == "google.com") & (path(a) == "/url"), target("q", "url"))
            .when(d == "google.com", None)
            .when(d.isin("yandex.ru", "ya.ru"), target("url", "to"))
            .otherwise(F.when(scheme(a).isin("http", "https") & (host(a) != ""), a)),
        )

    return let(F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url), of)


def is_seller_url(url: Column, allow_slug: bool = False, site: str = "wildberries.ru") -> Column:
    """A seller page by number, or by any name with `allow_slug`; the host, if any, belongs to the site."""
    pattern = r"^/seller/[^/?#]+/?$" if allow_slug else r"^/seller/\d+/?$"
    h = F.lower(host(url))
    return F.coalesce(((h == "") | F.contains(h, F.lit(site))) & F.lower(path(url)).rlike(pattern), F.lit(False))


def seller_url(base: Column, href: Column, allow_slug: bool = False, site: str = "wildberries.ru") -> Column:
    """U12"""
    return let(join_url(base, href), lambda u: F.when((href != "") & is_seller_url(u, allow_slug, site), u))


def is_unexpected_url(url: Column, site: str = "wildberries.ru") -> Column:
    """Another site's page, or a seller path of a wrong form."""
    h = F.lower(host(url))
    return F.coalesce(((h != "") & ~F.contains(h, F.lit(site))) | (F.startswith(F.lower(path(url)), F.lit("/seller")) & ~is_seller_url(url, True, site)), F.lit(False))


def is_html(content_type: Column, body: Column) -> Column:
    """U14"""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return ((t == "") | F.contains(t, F.lit("html")) | F.contains(t, F.lit("text/plain"))) & (F.coalesce(body, F.lit("")) != "")


def is_analyzable(status: Column, content_type: Column, body: Column, rendered: Column) -> Column:
    return is_html(content_type, body) & ((status < 400) | rendered)


#: Statuses of pages that refuse a plain client.
BLOCKED = (403, 429, 498, 503)


def needs_render(status: Column, title: Column) -> Column:
    """U15"""
    return status.isin(*BLOCKED) | F.coalesce(F.lower(trim_ws(title)).isin(*LOADING_TITLES), F.lit(False))


def zone_score(h: Column) -> Column:
    """U16"""
    x = F.regexp_replace(F.lower(h), r"^www\.", "")
    return F.when(x.rlike(r"\.(?:ru|рф|xn--p1ai)$"), 8).when(x.rlike(r"\.(?:fr|ua|by|kz|al|pl|de)$"), -10).otherwise(0)
