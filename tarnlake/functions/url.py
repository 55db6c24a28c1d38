"""Addresses. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm

#: Fixed values.
TRACKING = ("fbclid", "gclid", "ref", "source")
TWO_LABEL_SUFFIXES = ("gov.in", "nic.in", "co.in", "org.in", "ac.in", "res.in", "net.in")
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
PAGE_ENDINGS = ("", ".html", ".htm", ".php", ".asp", ".aspx", ".jsp")


def part(c: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if missing."""
    return F.coalesce(F.regexp_extract(c, r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group), F.lit(""))


def host(c: Column) -> Column:
    """Lower case, without user, port and dots at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(norm(c), 2)), r"^.*@|:\d*$", ""), r"^\.+|\.+$", "")


def root_domain(h: Column) -> Column:
    """The registrable part: two labels, or three below a suffix of two."""
    bare = F.regexp_replace(h, r"^www\.", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    two, three = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."), F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(n <= 2, bare).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def trusted(h: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        own = d.lower().strip(".")
        out = out | (h == own) | h.endswith(f".{own}")
    return out


def canonical(c: Column) -> Column:
    """https, lower-case host, single slashes without one at the end, query sorted without tracking, no fragment."""
    text = norm(c)
    scheme = F.lower(part(text, 1))
    path = F.regexp_replace(F.when(part(text, 3) == "", F.lit("/")).otherwise(part(text, 3)), "/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(part(text, 4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|" + "|".join(TRACKING) + r")(=|$)"))
    query = F.array_join(F.sort_array(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")
    whole = F.concat(F.when(scheme.isin("http", "https"), F.lit("https")).otherwise(scheme), F.lit("://"), F.lower(part(text, 2)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(text == "", F.lit("")).otherwise(whole)


def ending(c: Column) -> Column:
    """The last path segment's file ending with its dot, or empty."""
    last = F.regexp_extract(F.lower(part(c, 3)), r"([^/]*)$", 1)
    return F.when(F.contains(last, F.lit(".")), F.concat(F.lit("."), F.regexp_extract(last, r"\.([^.]*)$", 1))).otherwise(F.lit(""))


def kind(c: Column) -> Column:
    """document, html, or asset for whatever should not be crawled."""
    e = ending(c)
    return F.when(e.isin(*DOCUMENT_ENDINGS), "document").when(e.isin(*PAGE_ENDINGS), "html").otherwise("asset")


def collect(c: Column) -> Column:
    """The distinct addresses in a text, in order, without punctuation at their ends."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s\"'<>()]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;]+$", "")))


#: Hosts of sources, authorities of hosts, words of addresses.
SOURCE_HOSTS = {
    "birac": ("birac.nic.in",), "dst": ("dst.gov.in",), "startup india": ("startupindia.gov.in", "www.startupindia.gov.in"), "meity startup hub": ("msh.meity.gov.in", "meity.gov.in"),
    "msme": ("msme.gov.in", "my.msme.gov.in"),
}
HOST_SOURCES = (
    ("Startup India", ("startupindia.gov.in",), ()), ("MSME", ("msme.gov.in", "dcmsme.gov.in", "champions.gov.in"), ()), ("DST", ("dst.gov.in", "nstedb.com"), ()), ("BIRAC", ("birac.nic.in",), ("biracrdif.org",)),
    ("MeitY Startup Hub", ("msh.meity.gov.in", "meity.gov.in"), ()),
)
AUTHORITIES = {
    "onlinedst.gov.in": "DST_APPLICATION_PORTAL", "nidhi.dst.gov.in": "DST_PROGRAMME_PORTAL", "rdifund.anrf.gov.in": "IMPLEMENTING_AGENCY_PORTAL", "anrf.gov.in": "IMPLEMENTING_AGENCY_PORTAL",
    "tdb.gov.in": "IMPLEMENTING_AGENCY_PORTAL", "aistic.gov.in": "GOVERNMENT_COOPERATION_PORTAL", "india.gov.in": "GOVERNMENT_PORTAL", "nic.in": "GOVERNMENT_TECHNICAL_HOST",
}
PROOF_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
APPLICATION_WORDS = ("apply", "application", "register", "registration", "submit", "proposal", "portal", "login")
GENERIC_APPLICATION_PATHS = ("/announcement/applications-invited-throughout-year", "/bhaskar/register")
DOORS = r"(?:^|[/_.?=&-])(?:login|signin|sign-in|register|captcha)(?:$|[/_.?=&-])"


def http_or_empty(c: Column) -> Column:
    """The trimmed text if it is an http address with a host, else empty."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(part(text, 1)).isin("http", "https") & (part(text, 2) != ""), text).otherwise(F.lit(""))


def is_http(c: Column) -> Column:
    """An http address with a host and without white space within."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return (http_or_empty(text) != "") & ~text.rlike(r"(?U)\s")


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def comparable(c: Column) -> Column:
    """An http address to compare by: scheme and host in lower case, no default port, single slashes, none at the end, the query
    decoded, sorted and encoded again without tracking, no fragment; other texts are empty."""
    text = norm(c)
    scheme, port = F.lower(part(text, 1)), F.regexp_extract(part(text, 2), r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.when(part(text, 3) == "", F.lit("/")).otherwise(part(text, 3)), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    split = F.transform(F.filter(F.split(part(text, 4), "&"), lambda p: p != ""), lambda p: F.struct(read(F.substring_index(p, "=", 1)).alias("k"), read(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.sort_array(F.filter(split, lambda p: ~F.lower(p["k"]).isin(*PROOF_TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), _host_of(text), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(http_or_empty(text) == "", F.lit("")).otherwise(whole)


def _host_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(part(text, 2)), r"^.*@|:\d*$", "")


def official_for(source: Column, c: Column) -> Column:
    """The address is of the source's own hosts or of a public body's."""
    h, name = F.when(http_or_empty(norm(c)) != "", _host_of(norm(c))).otherwise(F.lit("")), F.lower(norm(source))
    own = trusted(h, ["gov.in", "nic.in"])
    for key, hosts in SOURCE_HOSTS.items():
        own = own | ((name == key) & trusted(h, list(hosts)))
    return (h != "") & own


def source_of(c: Column) -> Column:
    """The source that an http address belongs to, or an empty text."""
    h = F.regexp_replace(F.when(http_or_empty(norm(c)) != "", _host_of(norm(c))).otherwise(F.lit("")), r"^www\.", "")
    out = F.when(h == "", F.lit(""))
    for name, below, exact in HOST_SOURCES:
        out = out.when(trusted(h, list(below)) | (h.isin(*exact) if exact else F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(""))


def authority(c: Column) -> Column:
    """Whose a host outside the site is: the host itself in AUTHORITIES, then the first that it is below, then public suffixes."""
    h = F.regexp_replace(F.regexp_replace(_host_of(norm(c)), r"\.+$", ""), r"^www\.", "")
    out = F.when(h == "", F.lit("OTHER_EXTERNAL"))
    for known, name in AUTHORITIES.items():
        out = out.when(h == known, F.lit(name))
    for known, name in AUTHORITIES.items():
        out = out.when(h.endswith(f".{known}"), F.lit(name))
    return out.when(h.endswith(".gov.in"), F.lit("OTHER_GOVERNMENT_PORTAL")).otherwise(F.lit("OTHER_EXTERNAL"))


def looks_closed(c: Column, title: Column) -> Column:
    """The address or the title is that of a door: login, registration or a captcha."""
    return F.lower(F.concat_ws(" ", F.coalesce(c, F.lit("")), F.coalesce(title, F.lit("")))).rlike(DOORS)


def plausible_application(c: Column) -> Column:
    """Empty and unreadable addresses pass; others must have a word of applications."""
    u = F.lower(comparable(c))
    return (u == "") | u.rlike("|".join(APPLICATION_WORDS))


def application_url(c: Column, name: Column, official: Column) -> Column:
    """struct(url, state) of a record's application address; official tells whether it is on its source's trusted hosts."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    path, of, none = F.lower(part(text, 3)), F.lower(F.coalesce(name, F.lit(""))), F.lit(None).cast("string")
    made = lambda u, state: F.struct(u.alias("url"), F.lit(state).alias("state"))
    indirect = F.contains(of, F.lit("fund of funds")) | F.contains(of, F.lit("credit guarantee"))
    generic = F.contains(path, F.lit(GENERIC_APPLICATION_PATHS[0])) | F.contains(path, F.lit(GENERIC_APPLICATION_PATHS[1]))
    out = F.when((text == "") & indirect, made(none, "INDIRECT_OR_INTERMEDIARY_APPLICATION")).when(text == "", made(none, "NOT_FOUND")).when(generic, made(none, "GENERIC_OR_UNVERIFIED"))
    return out.when(part(text, 2).endswith("birac.nic.in") & path.endswith("/login.php"), made(c, "GENERAL_OFFICIAL_PORTAL")).when(official, made(c, "OFFICIAL_LINK")).otherwise(made(none, "UNTRUSTED_DOMAIN"))
