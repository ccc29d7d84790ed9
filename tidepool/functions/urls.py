"""URL expressions: canonical forms, sites, paths and hosts that must not be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visits, besides utm_*; fixed values.
TRACKING = ("fbclid", "gclid", "gbraid", "mc_cid", "mc_eid", "msclkid", "wbraid")
#: Path words by page type, first match counts; fixed values.
PATH_TYPES = (
    ("pricing", r"(?i)(pricing|plans?|billing|subscriptions?)"),
    ("changelog", r"(?i)(changelog|release|updates?|whats-new)"),
    ("features", r"(?i)(features?|products?|solutions?|platform)"),
    ("docs", r"(?i)(docs?|help|guides?|support)"),
)
#: Paths that a crawl leaves out; fixed values.
BLOCKED_PATH = r"(?i)/(login|log-in|signin|sign-in|signup|sign-up|auth|account|checkout|cart|billing-portal|admin|dashboard)(/|$)"
#: Hosts and networks of one's own; fixed values.
PRIVATE_HOST = r"(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal)$"
PRIVATE_NETWORKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("100.64.0.0", 10))

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """Scheme (1), authority (2), path (3), query with its mark (4) or fragment (5); empty if absent."""
    return F.regexp_extract(F.trim(url), _URL, n)


def is_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(_URL), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host without credentials and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def site(url: Column) -> Column:
    """The host without a leading www. or m.; equal for pages of one site."""
    return F.regexp_replace(host(url), r"^(www|m)\.", "")


def _parameters(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(part(url, 4), r"^\?", ""), "&"), lambda p: p != "")


def _tracks(parameter: Column) -> Column:
    name = F.lower(F.regexp_extract(parameter, "^[^=]*", 0))
    return name.startswith("utm_") | name.isin(*TRACKING)


def stripped_parameters(url: Column) -> Column:
    """Names of the tracking parameters that canonical() drops, in their order."""
    return F.transform(F.filter(_parameters(url), _tracks), lambda p: F.regexp_extract(p, "^[^=]*", 0))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without credentials and default port, no fragment, no tracking parameters,
    the others sorted by name, single slashes, none at the end. What is no URL comes back trimmed; null is empty."""
    kept = F.filter(_parameters(url), lambda p: ~_tracks(p))
    name = lambda p: F.regexp_extract(p, "^[^=]*", 0)
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(ordered, lambda x: x["p"]), "&")
    path = F.regexp_replace(F.regexp_replace(part(url, 3), "/{2,}", "/"), "/+$", "")
    whole = F.concat(origin(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(F.when(is_url(url), whole).otherwise(F.trim(url)), F.lit(""))


def origin(url: Column) -> Column:
    """Scheme, host and port, unless that is the scheme's own."""
    whole = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(F.regexp_replace(part(url, 2), r"^.*@", "")))
    return F.regexp_replace(whole, "^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")


def absolute(href: Column, base: Column) -> Column:
    """A link's address on the page whose address is given."""
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href)).otherwise(F.concat(origin(base), F.when(folder == "", "/").otherwise(folder), href))
    )


def built(base: Column, path: Column) -> Column:
    """The canonical address of a path on a page's origin."""
    return canonical(F.concat(origin(base), path))


def same_domain(a: Column, b: Column) -> Column:
    """Whether two addresses have one host, but for a leading www.; false if either is none."""
    name = lambda url: F.regexp_replace(host(url), r"^www\.", "")
    return F.coalesce(is_url(a) & is_url(b) & (name(a) == name(b)), F.lit(False))


def cross_origin(requested: Column, final: Column) -> Column:
    """Whether a redirect leaves the origin; true if either address is none."""
    return F.coalesce(~(is_url(requested) & is_url(final)) | (origin(requested) != origin(final)), F.lit(True))


def path_type(url: Column) -> Column:
    """homepage for the root, else the first type whose words the path has, else other."""
    path = part(url, 3)
    out = F.when(F.regexp_replace(path, "/+$", "") == "", "homepage")
    for name, words in PATH_TYPES:
        out = out.when(path.rlike(words), name)
    return out.otherwise("other")


def path_signal(url: Column) -> Column:
    """Path and query as words."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", part(url, 3), part(url, 4)), "[-_/]+", " "))


def blocked_path(url: Column) -> Column:
    return ~is_url(url) | part(url, 3).rlike(BLOCKED_PATH)


def ipv4(address: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.split(address, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    value = octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * (1 << 8) + octet(3)
    return F.when(address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


def private_host(name: Column) -> Column:
    """Names and addresses inside one's own network, IPv6 forms included."""
    number = ipv4(F.regexp_replace(name, r"(?i)^\[?::ffff:([\d.]+)\]?$", "$1"))
    inside = F.lit(False)
    for network, bits in PRIVATE_NETWORKS:
        first = sum(int(x) << 8 * (3 - i) for i, x in enumerate(network.split(".")))
        inside = inside | number.between(first, first + (1 << 32 - bits) - 1)
    return name.rlike(PRIVATE_HOST) | F.coalesce(inside, F.lit(False)) | name.rlike(r"(?i)^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?$")


def input_error(url: Column) -> Column:
    """Why an address can't be taken, or null: empty, invalid, not https, with credentials, private."""
    url = F.trim(F.coalesce(url, F.lit("")))
    whole = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return (
        F.when(url == "", "empty").when(~is_url(whole) | (host(whole) == "") | url.rlike(r"\s"), "invalid")
        .when(F.lower(part(whole, 1)) != "https", "not_https").when(part(whole, 2).contains("@"), "credentials").when(private_host(host(whole)), "private_host")
    )
