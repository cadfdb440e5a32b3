"""URL scalars as SQL text, built on ``regexp_extract`` and array functions."""

from __future__ import annotations

from .sql import Sql, bind, case, each, grab, has, let, quote, sub, text
from .text import trim_blanks

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:[^/?#@]*@)?([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_WEB = "('http', 'https', 'ftp', 'ws', 'wss')"

# Store host suffix -> store id.
STORE_HOSTS = {
    "dlsite.com": "dlsite",
    "dmm.co.jp": "fanza",
    "melonbooks.co.jp": "melonbooks",
    "pixiv.net": "pixiv",
    "fantia.jp": "fantia",
}


def scheme_of(url: Sql) -> Sql:
    """Lower-case scheme, empty when the value is not an absolute URL."""
    return f"lower({grab(text(url), _URL, 1)})"


def host_of(url: Sql) -> Sql:
    return sub(f"lower({grab(text(url), _URL, 2)})", r":\d*$")


def authority_of(url: Sql) -> Sql:
    """host[:port] in lower case, the scheme's default port left out."""
    return sub(
        sub(
            f"concat({scheme_of(url)}, ' ', lower({grab(text(url), _URL, 2)}))",
            r"^(http .*):80$|^(https .*):443$",
            "$1$2",
        ),
        r"^\S* ",
    )


def is_hierarchical(url: Sql) -> Sql:
    return has(text(url), r"^\s*(?:(?:https?|ftp|wss?)://[^/?#]+|file://)", True)


def is_absolute(url: Sql) -> Sql:
    """Parsable as an absolute URL: web schemes need a host, others only a scheme."""
    return (
        f"({scheme_of(url)} <> '' and ({scheme_of(url)} not in {_WEB} or {is_hierarchical(url)}))"
    )


def path_of(url: Sql) -> Sql:
    """Path part; a web URL without one has the path ``/``."""

    def path(u: Sql) -> Sql:
        return f"if({is_hierarchical(u)}, coalesce(nullif({grab(u, _URL, 3)}, ''), '/'), {grab(u, _URL, 3)})"

    return bind(url, path)


def _origin(url: Sql) -> Sql:
    return f"if({is_hierarchical(url)}, concat({scheme_of(url)}, '://', {authority_of(url)}), 'null')"


def origin_of(url: Sql) -> Sql:
    return bind(url, lambda u: f"if({is_absolute(u)}, {_origin(u)}, '')")


def path_key(url: Sql) -> Sql:
    """Origin + path without trailing slashes; empty when not a URL."""
    return bind(
        url,
        lambda u: f"if({is_absolute(u)}, concat({_origin(u)}, {sub(path_of(u), r'/+$')}), '')",
    )


def page_key(url: Sql) -> Sql:
    """Identity of a page: like ``path_key`` but a non-URL is its own key."""
    return f"coalesce(nullif({path_key(url)}, ''), {text(url)})"


def resolve_against(base: Sql, value: Sql) -> Sql:
    """Absolute form of a link found on page ``base``."""
    return let(
        trim_blanks(text(value)),
        lambda v: case(
            (f"{v} = '' or {scheme_of(v)} <> ''", v),
            (f"startswith({v}, '//')", f"concat({scheme_of(base)}, ':', {v})"),
            (f"startswith({v}, '/')", f"concat({origin_of(base)}, {v})"),
            default=f"concat({origin_of(base)}, {grab(path_of(base), r'^(.*/)', 1)}, {v})",
        ),
    )


def _segment_shape(segment: Sql) -> Sql:
    def shape(s: Sql) -> Sql:
        return let(
            grab(s, r"^([^.]*)"),
            lambda name: "concat("
            + case(
                (has(name, r"^[0-9]+$"), "':id'"),
                (
                    f"length({name}) = 0 or length({name}) > 16 or {has(name, r'[^\x20-\x7E]')}"
                    f" or ({has(name, '[0-9]')} and {has(name, '[A-Za-z]')})",
                    "':slug'",
                ),
                default=f"lower({name})",
            )
            + f", {grab(s, r'^[^.]*([.].*)$')})",
        )

    return let(sub(segment, r"%[0-9A-Fa-f]{2}"), shape)


def url_pattern(url: Sql) -> Sql:
    """URL shape with ids and slugs masked, at most four segments shown."""

    def build(path: Sql) -> Sql:
        def join(parts: Sql) -> Sql:
            shapes = each(f"slice({parts}, 1, 4)", _segment_shape)
            more = f"if(size({parts}) > 4, '/…', '')"
            tail = f"if(endswith({path}, '/') and size({parts}) > 0, '/', '')"
            return f"concat('/', array_join({shapes}, '/'), {more}, {tail})"

        return let(f"array_remove(split({path}, '/'), '')", join)

    return f"if({is_absolute(url)}, {let(path_of(url), build)}, '')"


def path_shape(path: Sql) -> Sql:
    """Redacted path: numbers and long segments masked, everything else kept."""
    masked = each(
        f"split({text(path)}, '/', -1)",
        lambda p: case((has(p, r"^[0-9]+$"), "':id'"), (f"length({p}) > 12", "':slug'"), default=p),
    )
    return f"array_join({masked}, '/')"


def host_suffixes(host: Sql) -> Sql:
    """``a.b.c`` -> [a.b.c, b.c, c]: turns a suffix test into an equality join."""
    return let(
        f"split({text(host)}, '[.]')",
        lambda parts: f"transform(sequence(1, size({parts})), "
        f"i -> array_join(slice({parts}, i, size({parts})), '.'))",
    )


def store_of_url(url: Sql) -> Sql:
    """Which store a request goes to; ``other`` for every other host."""
    return let(
        host_of(url),
        lambda h: case(
            *[
                (f"{h} = {quote(suffix)} or endswith({h}, {quote('.' + suffix)})", quote(store))
                for suffix, store in STORE_HOSTS.items()
            ],
            default="'other'",
        ),
    )


def page_url(url: Sql) -> Sql:
    """Page address without fragment and without one trailing slash."""
    return sub(sub(text(url), r"#.*$"), r"/$")


def same_page(a: Sql, b: Sql) -> Sql:
    return f"{page_url(a)} = {page_url(b)}"


def absolutize(url: Sql, origin: str) -> Sql:
    return let(
        trim_blanks(text(url)),
        lambda v: case(
            (f"startswith({v}, '//')", f"concat('https:', {v})"),
            (f"startswith({v}, '/')", f"concat({quote(origin)}, {v})"),
            default=v,
        ),
    )


def percent_encode(value: Sql) -> Sql:
    """Percent-encoding as browsers do it for a query component."""
    encoded = f"url_encode({trim_blanks(text(value))})"
    for escaped, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("+", "%20")):
        encoded = f"replace({encoded}, {quote(escaped)}, {quote(plain)})"
    return encoded


# Search addresses of the stores; {q} is the encoded keyword.
SEARCH_URLS = {
    ("dlsite", "primary"): "https://www.dlsite.com/books/fsr/=/language/jp/keyword/{q}/",
    ("dlsite", "female"): "https://www.dlsite.com/girls/fsr/=/language/jp/keyword/{q}/",
    ("fanza", "search"): "https://www.dmm.co.jp/search/=/searchstr={q}/",
    ("melonbooks", "search"): (
        "https://www.melonbooks.co.jp/search/search.php?name={q}&adult_check_flg=1"
    ),
    ("pixiv", "tag"): (
        "https://www.pixiv.net/ajax/search/artworks/{q}?word={q}"
        "&order=date_d&mode=all&p=1&s_mode=s_tag&type=all&lang=ja"
    ),
    ("pixiv", "title-caption"): (
        "https://www.pixiv.net/ajax/search/artworks/{q}?word={q}"
        "&order=date_d&mode=all&p=1&s_mode=s_tc&type=all&lang=ja"
    ),
    ("fantia", "search"): (
        "https://fantia.jp/posts?brand_type=0&keyword={q}&stock=all&category="
        "illust%2Ccomic%2Cvtuber%2Cvoice%2Cvoiceactor%2C3d%2C2d_anime%2Cgame%2Cmusic%2C"
        "novel%2Cdoll%2Cart%2Cprogram%2Chandmade%2Chistory%2Crailroad%2Cshop%2Cother%2C"
        "fortune%2Ccosplay%2Cidol%2Cyoutuber%2Cphoto_movie%2Cother_real"
    ),
}
PIXIV_READER_URL = "https://www.pixiv.net/search.php?word={q}&order=date_d&s_mode=s_tag"
PIXIV_ARTIST_URL = "https://www.pixiv.net/search/users?nick={q}&s_mode=s_usr"
PLUS_FOR_SPACE = ("dlsite",)


def _fill(template: str, encoded: Sql) -> Sql:
    return f"replace({quote(template)}, '{{q}}', {encoded})"


def search_url(store: Sql, step: Sql, query: Sql) -> Sql:
    def build(encoded: Sql) -> Sql:
        plussed = f"replace({encoded}, '%20', '+')"
        return case(
            *[
                (
                    f"{store} = {quote(s)} and {step} = {quote(st)}",
                    _fill(template, plussed if s in PLUS_FOR_SPACE else encoded),
                )
                for (s, st), template in SEARCH_URLS.items()
            ]
        )

    return let(percent_encode(query), build)


def reader_search_url(store: Sql, query: Sql) -> Sql:
    """The search page a person would open (first step of the store's plan)."""
    first = "map('dlsite', 'primary', 'fanza', 'search', 'melonbooks', 'search', 'fantia', 'search')"
    return (
        f"if({store} = 'pixiv', {_fill(PIXIV_READER_URL, percent_encode(query))}, "
        f"{search_url(store, f'{first}[{store}]', query)})"
    )


def artist_search_url(artist: Sql) -> Sql:
    return _fill(PIXIV_ARTIST_URL, percent_encode(artist))
