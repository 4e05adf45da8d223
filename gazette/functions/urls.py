"""Urls as columns: the parts of a url, its query as an ordered list of names and values, and forms built from them.

A url is taken apart by one pattern; its query is an array of (name, value) that higher-order functions filter, change, sort and join
again. All of it is built-in columns, so that it runs within one stage's generated code and over any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query names that only track, names that wrap another url, and path segments that mean the same.
TRACKING_NAMES = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "referrer")
TRACKING_START = "utm_"
REDIRECT_NAMES = ("continue", "dest", "destination", "redirect", "redirecturl", "returnurl", "target", "targeturl", "url")
PATH_ALIASES = {"noticeview": "views", "noticeviews": "views", "views": "views"}
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: Urls within urls that are followed at most.
UNWRAPPED = 3
#: scheme, authority, path, query behind its mark.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?s:#.*)?$"
#: user data, host, port of an authority.
AUTHORITY = r"^(?:(.*)@)?(\[[^\]]*\]|[^:@]*)(?::([0-9]*))?$"
#: The hosts of gallery boards, the paths of their lists and posts, and the query item of a list of recommended posts, on either host.
GALLERY_HOST, MOBILE_HOST, GALLERY_DOMAIN = "gall.dcinside.com", "m.dcinside.com", ".dcinside.com"
LIST_PATHS = ("/board/lists", "/mgallery/board/lists", "/mini/board/lists")
VIEW_PATHS = ("/board/view", "/mgallery/board/view", "/mini/board/view")
RECOMMENDED = {GALLERY_HOST: ("exception_mode", "recommend"), MOBILE_HOST: ("recommend", "1")}
GALLERY_ID = "[A-Za-z0-9_-]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    # get() would derive the type of all that then does anew for every row
    return F.element_at(F.transform(F.array(value), then), 1)


def group(url: Column, i: int, pattern: str = URL) -> Column:
    return F.regexp_extract(url, pattern, i)


def decoded(text: Column, plus: bool = True) -> Column:
    """Percent-decoded, of a query with + as a space; as it is where that isn't valid."""
    kept = text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.call_function("try_url_decode", kept), F.replace(text, F.lit("+"), F.lit(" ")) if plus else text)


def encoded(text: Column) -> Column:
    """Percent-encoded as in a query: letters, digits and - . _ ~ stay, a space is +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_items(query: Column) -> Column:
    """The query's (name, value) in their order; an item without = has an empty value."""
    items = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    at = lambda x: F.instr(x, "=")
    name = lambda x: F.when(at(x) > 0, F.substr(x, F.lit(1), at(x) - 1)).otherwise(x)
    value = lambda x: F.when(at(x) > 0, F.substr(x, at(x) + 1)).otherwise(F.lit(""))
    return F.transform(items, lambda x: F.struct(decoded(name(x)).alias("name"), decoded(value(x)).alias("value")))


def query_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(encoded(x["name"]), F.lit("="), encoded(x["value"]))), "&")


def with_query(url: Column, items: Column) -> Column:
    """url with other items in its query, and without its fragment."""
    query = query_text(items)
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(F.size(items) > 0, F.concat(base, F.lit("?"), query)).otherwise(base)


def item(items: Column, name: str) -> Column:
    """The first value of a name; null if there is none."""
    return F.get(F.transform(F.filter(items, lambda x: x["name"] == name), lambda x: x["value"]), 0)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(group(group(url, 2), 2, AUTHORITY)), r"\.+$", "")


def is_web(url: Column) -> Column:
    """Whether a url is http or https and has a host."""
    return F.lower(group(url, 1)).isin("http", "https") & (group(group(url, 2), 2, AUTHORITY) != "")


def unwrapped(url: Column) -> Column:
    """The url that a redirect's query holds, plain or encoded once more, up to UNWRAPPED times; else url."""
    held = lambda u: F.filter(query_items(group(u, 4)), lambda x: F.replace(F.lower(x["name"]), F.lit("_"), F.lit("")).isin(*REDIRECT_NAMES))
    targets = lambda u: F.filter(F.flatten(F.transform(held(u), lambda x: F.array(x["value"], decoded(x["value"], plus=False)))), is_web)
    return F.aggregate(F.sequence(F.lit(1), F.lit(UNWRAPPED)), url, lambda u, _: F.coalesce(F.get(targets(u), 0), u))


def plain_path(path: Column) -> Column:
    """Without repeated slashes and with segments of one meaning in one form."""
    aliases = F.create_map(*[F.lit(x) for kv in PATH_ALIASES.items() for x in kv])
    segments = F.split(F.regexp_replace(F.when(path == "", "/").otherwise(path), "/+", "/"), "/")
    return F.array_join(F.transform(segments, lambda s: F.coalesce(F.try_element_at(aliases, F.lower(s)), s)), "/")


def plain_items(query: Column) -> Column:
    """Each item once and none that tracks, by name in any case, then value."""
    tracks = lambda x: F.lower(x["name"]).startswith(TRACKING_START) | F.lower(x["name"]).isin(*TRACKING_NAMES)
    kept = F.array_distinct(F.filter(query_items(query), lambda x: ~tracks(x)))
    placed = F.transform(kept, lambda x, i: F.struct(F.lower(x["name"]).alias("by"), x["value"].alias("value"), i.alias("place"), x["name"].alias("name")))
    return F.array_sort(placed)


def canonical(url: Column) -> Column:
    """The same text for urls that lead to the same page: unwrapped, without fragment, user data, tracking, default port and order of the
    query. Null if it is no web url or its port no number."""

    def built(u: Column) -> Column:
        return let(F.struct(F.lower(group(u, 1)).alias("scheme"), group(u, 2).alias("place"), group(u, 3).alias("path"), group(u, 4).alias("query")), with_host)

    def with_host(u: Column) -> Column:
        named = group(u["place"], 2, AUTHORITY)
        return let(F.struct(named.alias("named"), F.regexp_replace(F.lower(named), r"\.+$", "").alias("host"), F.regexp_replace(group(u["place"], 3, AUTHORITY), "^0+", "").alias("port")), lambda at: joined(u, at))

    def joined(u: Column, at: Column) -> Column:
        scheme, host, number = u["scheme"], at["host"], at["port"]
        usual = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])
        place = F.when((number == "") | (number == F.try_element_at(usual, scheme)), host).otherwise(F.concat(host, F.lit(":"), number))
        base = F.concat(scheme, F.lit("://"), place, plain_path(u["path"]))
        query = F.when(u["query"] == "", "").otherwise(let(plain_items(u["query"]), lambda items: F.when(F.size(items) > 0, F.concat(F.lit("?"), query_text(items))).otherwise("")))
        fine = scheme.isin("http", "https") & (at["named"] != "") & (host != "") & (F.length(number) < 6) & (F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)) < 65536)
        return F.when(fine, F.concat(base, query))

    # without a query nothing is wrapped
    return let(let(F.trim(url), lambda u: F.when(is_web(u), F.when(u.contains("?"), unwrapped(u)).otherwise(u))), built)


def absolute(base: Column, link: Column) -> Column:
    """A link made absolute against a web url: http(s) without user data, else null."""

    def joined(x: Column) -> Column:
        scheme, place, path = group(base, 1), group(base, 2), group(base, 3)
        root = F.concat(scheme, F.lit("://"), place)
        folder = F.regexp_extract(path, "^(.*/)", 1)
        folder = F.when(folder == "", "/").otherwise(folder)
        own, rest = F.regexp_extract(x, "^([^?#]*)", 1), F.regexp_extract(x, r"^[^?#]*(\??(?s:.*))$", 1)
        full = F.when(own.startswith("/"), own).when(own == "", path).otherwise(F.concat(folder, own))
        query = F.when((own == "") & ~x.startswith("?") & (group(base, 4) != ""), F.concat(F.lit("?"), group(base, 4), rest)).otherwise(rest)
        out = F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x).when(x.startswith("//"), F.concat(scheme, F.lit(":"), x))
        return out.otherwise(F.concat(root, without_dots(full), query))

    fine = lambda u: F.when(is_web(u) & (group(group(u, 2), 1, AUTHORITY) == "") & ~group(u, 2).contains("@"), u)
    squeezed = F.trim(F.regexp_replace(link, r"(?U)\s+", " "))
    return let(let(F.nullif(squeezed, F.lit("")), joined), fine)


def without_dots(path: Column) -> Column:
    """The path without its . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda held, s: F.when(s == ".", held).when(s == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(s)))
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.get(parts, 0)), step)
    ended = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.contains("/."), F.array_join(ended, "/")).otherwise(path)


def redacted(url: Column) -> Column:
    """Scheme, host, port, path and the sorted names of the query, without its values; empty for what is no url."""
    names = F.array_sort(F.array_distinct(F.transform(query_items(group(url, 4)), lambda x: x["name"])))
    blank = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("value")))
    port = group(group(url, 2), 3, AUTHORITY)
    place = F.concat(F.lower(group(group(url, 2), 2, AUTHORITY)), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    base = F.concat(F.lower(group(url, 1)), F.lit("://"), place, group(url, 3))
    return F.when(F.coalesce(group(url, 1), F.lit("")) == "", "").otherwise(F.when(F.size(names) > 0, F.concat(base, F.lit("?"), query_text(blank))).otherwise(base))


def trimmed_path(url: Column) -> Column:
    return F.regexp_replace(group(url, 3), "/+$", "")


def values_of(items: Column, name: str) -> Column:
    return F.transform(F.filter(items, lambda x: (x["name"] == name) & (x["value"] != "")), lambda x: x["value"])


def gallery_list_id(url: Column) -> Column:
    """The board of which a url is a list: in the path on the mobile host, the only id of the query on the other. Else null."""
    usual = group(url, 1).isin("http", "https") & group(group(url, 2), 3, AUTHORITY).isin("", "80", "443")
    mobile = F.regexp_extract(group(url, 3), f"^/board/({GALLERY_ID})/?$", 1)
    own = let(values_of(query_items(group(url, 4)), "id"), lambda ids: F.when((F.size(ids) == 1) & F.get(ids, 0).rlike(f"^{GALLERY_ID}$"), F.get(ids, 0)))
    found = F.when(host_of(url) == MOBILE_HOST, F.nullif(mobile, F.lit(""))).when((host_of(url) == GALLERY_HOST) & trimmed_path(url).isin(*LIST_PATHS), own)
    return F.when(usual, found)


def is_recommended_list(url: Column) -> Column:
    """Whether a url is a gallery list of recommended posts only."""
    held = F.lit(False)
    for host, (name, value) in RECOMMENDED.items():
        held = F.when(host_of(url) == host, values_of(query_items(group(url, 4)), name) == F.array(F.lit(value))).otherwise(held)
    return F.coalesce(gallery_list_id(url).isNotNull() & held, F.lit(False))


def keep_list_filter(target: Column, source: Column) -> Column:
    """source, limited to recommended posts if target is and both are lists of one board. Nothing else of target's query is taken over."""
    wanted = is_recommended_list(target) & ~is_recommended_list(source) & (gallery_list_id(target) == gallery_list_id(source))

    def limited(name: str, value: str) -> Column:
        others = F.filter(query_items(group(source, 4)), lambda x: x["name"] != name)
        return with_query(source, F.concat(others, F.array(F.struct(F.lit(name).alias("name"), F.lit(value).alias("value")))))

    changed = F.when(host_of(source) == MOBILE_HOST, limited(*RECOMMENDED[MOBILE_HOST])).otherwise(limited(*RECOMMENDED[GALLERY_HOST]))
    return F.when(F.coalesce(wanted, F.lit(False)), changed).otherwise(source)


def mobile_detail(detail: Column, target: Column, external_id: Column) -> Column:
    """A post's url in the form of the mobile board target, if it is a post of that board; else detail.

    The post's number is its query's, else the record's external id.
    """
    board = F.regexp_extract(group(target, 3), "^/*(?i:board)/+([^/]+)/*$", 1)
    items = query_items(group(detail, 4))
    gallery, post = F.get(values_of(items, "id"), 0), F.coalesce(F.get(values_of(items, "no"), 0), external_id)
    fits = (host_of(target) == MOBILE_HOST) & host_of(detail).endswith(GALLERY_DOMAIN) & F.lower(trimmed_path(detail)).isin(*VIEW_PATHS)
    fits = fits & (gallery == board) & gallery.rlike(f"^{GALLERY_ID}$") & post.rlike("^[0-9]+$")
    return F.when(F.coalesce(fits, F.lit(False)), F.concat(group(target, 1), F.lit("://"), group(target, 2), F.lit("/board/"), gallery, F.lit("/"), post)).otherwise(detail)
