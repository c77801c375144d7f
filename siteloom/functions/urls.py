"""URL keys, scope and path patterns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "{token}"


def clean_url(url: Column) -> Column:
    """Without fragment, trailing slashes, scheme and ``www.``; case and query stay."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), "/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^https?://", ""), r"^www\.", "")


def is_opaque_token(segment: Column) -> Column:
    """16 or more word characters with a digit or with letters of both cases."""
    mixed = segment.rlike("[a-z]") & segment.rlike("[A-Z]")
    return segment.rlike("^[A-Za-z0-9_-]{16,}$") & (segment.rlike("[0-9]") | mixed)


def host_of(url: Column) -> Column:
    return F.substring_index(clean_url(url), "/", 1)


def route_shape(url: Column) -> Column:
    """``clean_url`` with opaque path segments replaced by ``{token}``."""
    parts = F.split(clean_url(url), "/")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(is_opaque_token(x), TOKEN).otherwise(x))
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "/")


def slugify(url: Column) -> Column:
    return F.replace(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit("_"))


def is_in_scope(url: Column, base: Column, allow_subdomains: bool = False) -> Column:
    """Same host; with subdomains, same last two labels. An empty host is in scope."""
    a, b = host_of(url), host_of(base)
    same = (a == "") | (b == "") | (a == b)
    if not allow_subdomains:
        return same
    la, lb = F.split(a, r"\."), F.split(b, r"\.")
    tail = lambda x: F.slice(x, -2, 2)
    return same | ((F.size(la) >= 2) & (F.size(lb) >= 2) & (F.when((F.size(la) >= 2) & (F.size(lb) >= 2), tail(la) == tail(lb))))


def _without_dots(path: Column) -> Column:
    """A path with ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda acc, x: (
        F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x)))
    )
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    folder = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(folder, "/")


def resolve_href(base: Column, href: Column) -> Column:
    """The absolute http(s) URL of a link, null for an empty one, ``#...`` or another scheme."""
    href = F.regexp_replace(F.trim(F.coalesce(href, F.lit(""))), r"^\s+|\s+$", "")
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_replace(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(rest, "[?#].*$", "")
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    target = F.regexp_replace(href, "[?#].*$", "")
    tail = F.regexp_extract(href, "([?#].*)$", 1)
    has_scheme = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    whole = (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(has_scheme, F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(target), tail))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, target)), tail))
    )
    return F.when((href == "") | href.startswith("#"), F.lit(None)).otherwise(whole)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_params(path: Column) -> Column:
    """``id``, ``id_2``, ... for the opaque segments of a path."""
    opaque = F.filter(_segments(path), is_opaque_token)
    return F.transform(opaque, lambda x, i: F.when(i == 0, "id").otherwise(F.concat(F.lit("id_"), (i + 1).cast("string"))))


def path_pattern(path: Column) -> Column:
    """A path whose opaque segments are numbered parameters, ``{id}``, ``{id_2}``, ..."""
    segments = _segments(path)

    def named(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(segments, 1, i + 1), is_opaque_token))
        name = F.when(before == 1, "{id}").otherwise(F.concat(F.lit("{id_"), before.cast("string"), F.lit("}")))
        return F.when(is_opaque_token(x), name).otherwise(x)

    return F.concat(F.lit("/"), F.array_join(F.transform(segments, named), "/"))


def endpoint_id(method: Column, host: Column, pattern: Column) -> Column:
    return F.concat(method, F.lit(" "), host, pattern)


def component_id(page_url: Column, path: Column) -> Column:
    return F.concat_ws("|", page_url, path)


def state_style_id(page_url: Column, path: Column, state: Column, prop: Column) -> Column:
    return F.concat_ws("|", page_url, path, state, prop)


def request_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def request_path(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def query_names(url: Column) -> Column:
    """Sorted distinct names of the query parameters that have a value; values are left out."""
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x.rlike("^[^=]*=.+"))
    names = F.transform(pairs, lambda x: F.url_decode(F.substring_index(x, "=", 1)))
    return F.array_sort(F.array_distinct(names))
