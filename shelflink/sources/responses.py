"""Captured store responses -> catalogue items and classified search steps.

``responses(step_id, store, tier, query, http_status, final_url, body, ts)``.  Each
response is parsed inside its own row: one body yields at most ``items_per_step``
items, so first-id-wins and the cut need no shuffle, and bodies never travel.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import sql as S
from ..functions.sql import Sql, case, each, let, pattern, quote, text
from ..functions.text import collapse_spaces, decode_entities, strip_tags, trim_blanks
from ..functions.urls import absolutize
from ..plans import stores as P

sub, has, grab, grab_all = (partial(f, ascii=True) for f in (S.sub, S.has, S.grab, S.grab_all))

# How each store's response looks (markers, item starts, slice sizes).
A_ORIGIN = "https://www.dlsite.com"
A_START, A_SLICE = 'data-list_item_product_id="', 15000
A_LIST = 'id="search_result_list"'
A_NOT_FOUND = r"work_not_found|条件に一致する作品は見つかりませんでした"
B_ORIGIN = "https://www.dmm.co.jp"
B_LINK = r"/-/detail/=/cid=([a-z0-9_]+)"
B_BEFORE, B_AFTER = 900, 1600
B_AGE = r'id="agecheck"|年齢認証|18歳以上'
B_NOT_FOUND = r"該当する|見つかりません|0\s*件"
C_ORIGIN = "https://www.melonbooks.co.jp"
C_START, C_SLICE = r'<li class="product_[0-9]+"', 12000
C_NOT_FOUND = r"該当する商品|見つかりませんでした|0\s*件"
D_ORIGIN = "https://www.pixiv.net"
E_ORIGIN = "https://fantia.jp"
E_LOGIN = r"(?i)/sessions/signin|ログインしてください|sign in to fantia"
E_AGE = r"age_check|年齢確認|18歳以上"
E_NOT_FOUND = r"検索結果|の投稿"
BLOCKED_TITLE_A = r"(?i)<title>[^<]*\b(403|404|429|50\d)\b[^<]*</title>"
BLOCKED_TITLE_B = r"(?i)<title>[^<]*\b(404|403|429)\b[^<]*</title>"
MIN_BODY = 3000

ITEM_DDL = (
    "product_id string, title string, url string, maker string, author string, category string, price int,"
    " price_text string, currency string, is_free boolean, original_price int, original_price_text string,"
    " discount_label string, labels array<string>, approx_cny int, image_url string, age_rating int"
)
ITEM_TYPE = ", ".join(":".join(f.strip().split(" ")) for f in ITEM_DDL.split(","))
_FIELDS = [tuple(f.strip().split(" ")) for f in ITEM_DDL.split(",")]


def _item(**values: Sql) -> Sql:
    defaults = {"is_free": "false", "labels": "cast(array() as array<string>)"}
    parts = []
    for name, kind in _FIELDS:
        empty = "''" if kind == "string" else f"cast(null as {kind})"
        parts.append(f"{quote(name)}, cast({values.get(name, defaults.get(name, empty))} as {kind})")
    return f"named_struct({', '.join(parts)})"


def _plain(html: Sql) -> Sql:
    return strip_tags(html)


def _first_wins(items: Sql, limit: int | None) -> Sql:
    """Drop unusable items and repeats of an id, then cut to one page of results."""

    def unique(xs: Sql) -> Sql:
        kept = f"filter({xs}, (x, i) -> array_position(transform({xs}, o -> o.product_id), x.product_id) = i + 1)"
        return kept if limit is None else f"slice({kept}, 1, {limit})"

    return let(f"filter({items}, x -> x is not null)", unique)


def price_parts(html: Sql) -> Sql:
    """struct(value, currency, text) of the price markup of the first store, or null."""
    base = grab(html, r'class="work_price_base"[^>]*>([^<]*)<')
    suffix = grab(html, r'class="work_price_suffix"[^>]*>([^<]*)<')
    prefix = _plain(grab(html, r'class="work_price_prefix"[^>]*>([^<]*)<'))
    currency = f"if({has(html, r'class=.work_price_suffix.[^>]*>[^<]*<')}, {_plain(suffix)}, '円')"
    return let(
        base,
        lambda b: f"if({sub(b, '[^0-9]')} = '', null, named_struct('value', try_cast({sub(b, '[^0-9]')} as int),"
        f" 'currency', {currency}, 'text', concat({prefix}, {collapse_spaces(b)}, {currency})))",
    )


def _attr(tag: Sql, name: str) -> Sql:
    regex = rf"(?i){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return decode_entities(f"concat({grab(tag, regex, 1)}, {grab(tag, regex, 2)})")


def _item_a(b: Sql) -> Sql:
    name = grab(b, r'(?s)<dd class="work_name">(.*?)</dd>')
    maker_block = grab(b, r'(?s)<dd class="maker_name">(.*?)</dd>')
    category = grab(grab(b, r'(?s)<dd class="work_category[^"]*">(.*?)</dd>'), r"(?s)<a\b[^>]*>(.*?)</a>")
    wrap = grab(b, r'(?s)<dd class="work_price_wrap">(.*?)</dd>')
    struck = r'class="[^"]*\bstrike\b'
    current = f"if({has('w', struck)}, {grab('w', rf'(?s)^(.*?){struck}')}, w)"
    struck_part = f"if({has('w', struck)}, {price_parts(grab('w', rf'(?s)({struck}.*)$'))}, null)"
    prices = (
        f"get(transform(array({wrap}), w -> named_struct('now', coalesce({price_parts(current)}, {price_parts('w')}),"
        f" 'was', {struck_part})), 0)"
    )
    cny = f"from_json({decode_entities(grab(b, r"data-currency_price='([^']+)'"))}, 'map<string,double>')['CNY']"
    thumb = sub(f"split({grab(b, r'thumb-candidates=\"\[([^\]]*)\]')}, ',')[0]", r"^['\s]+|['\s]+$")
    labels = each(
        grab_all(grab(b, r'(?s)<dd class="work_deals work_labels">(.*?)</dd>'), r">([^<>]+)<"), _plain
    )

    def build(anchor: Sql, product: Sql, p: Sql) -> Sql:
        href = absolutize(_attr(anchor, "href"), A_ORIGIN)
        title = collapse_spaces(f"coalesce(nullif({_attr(anchor, 'title')}, ''), {_plain(grab(anchor, r'(?s)^<a\b[^>]*>(.*)</a>'))})")
        made = _item(
            product_id=product,
            title=title,
            url=href,
            maker=_plain(grab(maker_block, r"(?s)<a\b[^>]*>(.*?)</a>")),
            author=_plain(grab(maker_block, r'(?s)<span class="author[^"]*">(.*?)</span>')),
            category=_plain(category),
            price=f"{p}.now.value",
            price_text=f"coalesce({p}.now.text, '')",
            currency=f"coalesce({p}.now.currency, '')",
            is_free=f"coalesce({p}.now.value = 0, false)",
            original_price=f"{p}.was.value",
            original_price_text=f"coalesce({p}.was.text, '')",
            discount_label=_plain(grab(b, r'class="[^"]*type_sale[^"]*"[^>]*>([^<]*)<')),
            labels=f"array_remove({labels}, '')",
            approx_cny=let(cny, lambda c: f"if({c} is null, null, if({c} > 0, greatest(1, cast(floor({c} + 0.5D) as int)), 0))"),
            image_url=absolutize(thumb, A_ORIGIN),
        )
        return let(made, lambda m: f"if({anchor} = '' or not contains({m}.url, {product}) or {m}.title = '', null, {m})")

    return let(
        grab(name, r"(?s)(<a\b[^>]*>.*?</a>)"),
        lambda a: let(grab(b, rf'^{A_START}([^"]*)"'), lambda pid: let(prices, lambda p: build(a, pid, p))),
    )


def _slices(body: Sql, start: str, size: int) -> Sql:
    """The text from each item start up to the next one; the last slice is cut off."""
    parts = f"split({body}, {pattern('(?=' + start + ')', ascii=True)})"
    return let(
        f"filter({parts}, x -> {has('x', '^' + start)})",
        lambda xs: f"transform({xs}, (x, i) -> if(i + 1 = size({xs}), left(x, {size}), x))",
    )


def items_a(body: Sql, limit: int) -> Sql:
    scope = f"if(contains({body}, {quote(A_LIST)}), concat({quote(A_LIST)}, substring_index({body}, {quote(A_LIST)}, -1)), {body})"
    return _first_wins(each(_slices(scope, A_START, A_SLICE), _item_a), limit)


def items_b(body: Sql, limit: int) -> Sql:
    """Consecutive links to one id form a block; a block starts 900 characters before
    its first link and ends 1600 after its last, or where the next block starts."""
    pieces = f"split({body}, {pattern('(?i)(?=/-/detail/=/cid=)', ascii=True)})"
    step = (
        "named_struct('at', s.at + length(p), 'links', concat(s.links, if("
        + has("p", r"(?i)^/-/detail/=/cid=[a-z0-9_]")
        + f", array(named_struct('cid', {grab('p', r'(?i)^' + B_LINK)}, 'at', s.at)), cast(array() as array<struct<cid:string,at:int>>))))"
    )
    links = (
        f"aggregate({pieces}, named_struct('at', 0, 'links', cast(array() as array<struct<cid:string,at:int>>)),"
        f" (s, p) -> {step}, s -> s.links)"
    )
    def blocks(ls: Sql) -> Sql:
        starts = f"filter({ls}, (l, i) -> i = 0 or get({ls}, i - 1).cid <> l.cid)"

        def cut(ss: Sql) -> Sql:
            following = f"get({ss}, i + 1)"
            last = f"array_max(transform(filter({ls}, l -> l.at >= b.at and ({following} is null or l.at < {following}.at)), l -> l.at))"
            begin = f"greatest(0, b.at - {B_BEFORE})"
            end = f"least({last} + {B_AFTER}, if({following} is null, length({body}), greatest(0, {following}.at - {B_BEFORE})))"
            return f"transform({ss}, (b, i) -> substr({body}, {begin} + 1, greatest(0, {end} - {begin})))"

        return let(starts, cut)

    return _first_wins(each(let(links, blocks), _item_b), limit)


def _item_b(b: Sql) -> Sql:
    price = f"try_cast({sub(grab(b, r'(?s)<p class="text-\[#b42f59\][^"]*">.*?<span class="font-bold[^"]*">([0-9,]+)\s*円</span>'), '[^0-9]')} as int)"
    made = let(
        price,
        lambda p: _item(
            product_id=grab(b, r"(?i)cid=([a-z0-9_]+)"),
            title=decode_entities(_plain(grab(b, r'(?s)<p class="text-sm font-bold[^"]*"[^>]*>(.*?)</p>'))),
            url=f"replace(split({grab(b, r'href="(https?://www\.dmm\.co\.jp/[^"]*?/-/detail/=/cid=[^"]+)"')}, '[?]')[0], '&amp;', '&')",
            maker=collapse_spaces(decode_entities(grab(b, r"サークル[：:]\s*([^<]{1,60})<"))),
            category=_plain(grab(b, r'<span class="inline-block text-white[^"]*">([^<]+)</span>')),
            price=p,
            price_text=f"if({p} is null, '', concat('¥', format_number({p}, 0)))",
            currency="'JPY'",
            is_free=f"coalesce({p} = 0, false)",
        ),
    )
    return let(made, lambda m: f"if({m}.product_id = '' or {m}.title = '' or {m}.url = '', null, {m})")


def items_c(body: Sql, limit: int) -> Sql:
    return _first_wins(each(_slices(body, C_START, C_SLICE), _item_c), limit)


def _item_c(b: Sql) -> Sql:
    read = lambda regex: collapse_spaces(decode_entities(grab(b, regex)))
    price_text = collapse_spaces(decode_entities(strip_tags(grab(b, r'(?s)class="item-price"[^>]*>(.*?)</p>'))))
    made = let(
        price_text,
        lambda t: _item(
            product_id=grab(b, r"product_([0-9]{4,})"),
            title=collapse_spaces(decode_entities(strip_tags(grab(b, r'(?s)class="item-ttl product_title"[^>]*>(.*?)</p>')))),
            url=f"concat({quote(C_ORIGIN + '/detail/detail.php?product_id=')}, {grab(b, r'product_([0-9]{4,})')})",
            maker=read(r'href="/circle/index\.php\?circle_id=[0-9]+"[^>]*title="([^"]*)"'),
            author=read(r'text_type=author&name=[^"]*"[^>]*title="([^"]*)"'),
            category=read(r'<a href="[^"]*category_id=[0-9]+"[^>]*title="([^"]*)"'),
            price=f"try_cast({sub(t, '[^0-9]')} as int)",
            price_text=t,
            currency="'JPY'",
            is_free=f"coalesce(try_cast({sub(t, '[^0-9]')} as int) = 0, false)",
        ),
    )
    return let(made, lambda m: f"if({m}.product_id = '' or {m}.title = '', null, {m})")


_D_WORK = "struct<id:string,title:string,userName:string,url:string,xRestrict:string>"
_D_BLOCK = f"struct<data:array<{_D_WORK}>,total:string>"
_D_SCHEMA = f"error string, message string, body struct<illustManga:{_D_BLOCK},manga:{_D_BLOCK}>"


def _json(body: Sql) -> Sql:
    return f"from_json({body}, {quote(_D_SCHEMA)})"


def items_d(body: Sql, limit: int) -> Sql:
    """JSON answer; the whole list is taken (the store pages it)."""
    made = _item(
        product_id="w.id",
        title=trim_blanks(text("w.title")),
        url=f"concat({quote(D_ORIGIN + '/artworks/')}, w.id)",
        author=trim_blanks(text("w.userName")),
        maker=trim_blanks(text("w.userName")),
        image_url=text("w.url"),
        category="'pixiv'",
        age_rating="coalesce(try_cast(w.xRestrict as int), 0)",
    )
    works = f"coalesce({_json(body)}.body.illustManga.data, {_json(body)}.body.manga.data)"
    none = f"filter(transform(cast(array() as array<{_D_WORK}>), w -> {made}), x -> false)"
    return f"coalesce(transform(filter({works}, w -> coalesce(w.id, '') not in ('', '0')), w -> {made}), {none})"


def items_e(body: Sql, limit: int) -> Sql:
    pieces = f"split({body}, {pattern('(?i)(?=href=\"/posts/[0-9]+\")', ascii=True)})"
    link = r'(?is)^href="/posts/([0-9]+)"[^>]*>(.{0,400}?)</a>'

    def one(piece: Sql, rest: Sql) -> Sql:
        shown = collapse_spaces(decode_entities(strip_tags(grab(piece, link, 2))))
        title = let(shown, lambda t: collapse_spaces(f"coalesce(nullif({grab(t, r'「([^」]+)」')}, ''), {t})"))
        circle = let(
            grab(rest, r'(?is)href="/fanclubs/[0-9]+"[^>]*>(.{0,140}?)</a>'),
            lambda c: collapse_spaces(decode_entities(strip_tags(c))),
        )
        made = let(
            circle,
            lambda c: _item(
                product_id=grab(piece, link),
                title=title,
                url=f"concat({quote(E_ORIGIN + '/posts/')}, {grab(piece, link)})",
                author=c,
                maker=c,
                category="'fantia'",
            ),
        )
        return let(made, lambda m: f"if({m}.product_id = '' or length({m}.title) < 2, null, {m})")

    def walk(ps: Sql) -> Sql:
        before = f"aggregate(slice({ps}, 1, i), 0, (n, x) -> n + length(x))"
        matched = f"length({grab('p', r'(?is)^(href="/posts/[0-9]+"[^>]*>.{0,400}?</a>)')})"
        return f"transform({ps}, (p, i) -> {one('p', f'substr({body}, {before} + {matched} + 1, 900)')})"

    return _first_wins(let(pieces, walk), None)


def _blank(body: Sql) -> Sql:
    return f"not {S.has(body, r'\S')}"


def reason_a(body: Sql, n: Sql) -> Sql:
    scope = f"if(contains({body}, {quote(A_LIST)}), substring_index({body}, {quote(A_LIST)}, -1), {body})"
    return case(
        (_blank(body), "'empty-response'"),
        (has(body, BLOCKED_TITLE_A), "'blocked'"),
        (f"length({body}) < {MIN_BODY}", "'unexpected-page'"),
        (f"{n} > 0", "'ok'"),
        (has(scope, A_NOT_FOUND), "'not-found'"),
        default="'no-items-parsed'",
    )


def reason_b(body: Sql, n: Sql) -> Sql:
    return case(
        (_blank(body), "'empty-response'"),
        (f"contains(coalesce(final_url, ''), '/age_check/') or {has(f'left({body}, 4000)', B_AGE)}", "'age-check'"),
        (has(body, BLOCKED_TITLE_B), "'blocked'"),
        (f"{n} > 0", "'ok'"),
        (has(body, B_NOT_FOUND), "'not-found'"),
        default="'no-items-parsed'",
    )


def reason_c(body: Sql, n: Sql) -> Sql:
    return case(
        (_blank(body), "'empty-response'"),
        (f"length({body}) < {MIN_BODY}", "'unexpected-page'"),
        (f"{n} > 0", "'ok'"),
        (has(body, C_NOT_FOUND), "'not-found'"),
        default="'no-items-parsed'",
    )


def reason_d(body: Sql, n: Sql) -> Sql:
    payload = f"try_parse_json({body})"
    field = lambda path, kind="string": f"try_variant_get({payload}, '{path}', '{kind}')"
    refused = f"coalesce({field('$.error')}, 'false') not in ('false', '0', '')"
    data = f"coalesce({field('$.body.illustManga.data', 'array<variant>')}, {field('$.body.manga.data', 'array<variant>')})"
    total = f"coalesce(try_cast(coalesce({field('$.body.illustManga.total')}, {field('$.body.manga.total')}) as double), 0)"
    return case(
        (f"{payload} is null", "'invalid-json'"),
        (f"is_variant_null({payload}) or {refused}", f"if(coalesce({field('$.message')}, '') <> '', 'blocked', 'unexpected-payload')"),
        (f"{data} is null", "'no-items-parsed'"),
        (f"{n} > 0", "'ok'"),
        (f"{total} = 0", "'not-found'"),
        default="'no-items-parsed'",
    )


def reason_e(body: Sql, n: Sql) -> Sql:
    return case(
        (has(body, E_LOGIN), "'login-required'"),
        (has(body, E_AGE), "'age-check'"),
        (f"{n} > 0", "'ok'"),
        (has(body, E_NOT_FOUND), "'not-found'"),
        default="'no-items-parsed'",
    )


for _id, _parse in {
    "dlsite": (items_a, reason_a),
    "fanza": (items_b, reason_b),
    "melonbooks": (items_c, reason_c),
    "pixiv": (items_d, reason_d),
    "fantia": (items_e, reason_e),
}.items():
    P.register(replace(P.store(_id), parse=_parse))


def parse_responses(responses: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Responses with ``items``, ``reason``, ``ok`` and ``item_count``, in one pass over
    the table: a row only runs the rules of its own store."""
    known = [s for s in P.stores() if s.parse is not None and s.id in cfg.stores]
    names = ", ".join(quote(s.id) for s in known)
    none = f"cast(array() as array<struct<{ITEM_TYPE}>>)"
    found = case(
        *[(f"store = {quote(s.id)}", s.parse[0]("body", cfg.items_per_step)) for s in known], default=none
    )
    reason = case(*[(f"store = {quote(s.id)}", s.parse[1]("body", "size(_found)")) for s in known])
    read = (
        responses.where(f"store in ({names})")
        .withColumn("body", F.coalesce("body", F.lit("")))
        .withColumn("_found", F.expr(found))
        .withColumn("reason", F.expr(reason))
    )
    return (
        read.withColumn("items", F.expr("if(reason = 'ok', _found, slice(_found, 1, 0))"))
        .withColumn("ok", F.col("reason").isin("ok", "not-found"))
        .withColumn("item_count", F.size("items"))
        .drop("body", "_found")
    )


def search_steps(parsed: DataFrame) -> DataFrame:
    return parsed.select("store", "query", "step_id", "tier", "http_status", "ok", "reason", "item_count", "ts")


def store_items(parsed: DataFrame) -> DataFrame:
    """One row per item of an answer, ``pos`` = place in the answer.  The outer form with a filter
    behind it: for the plain one Spark adds a filter on the size of ``items`` and moves it below the
    parsing, so every body would be parsed again for each of the places that filter names it."""
    return parsed.select(
        "store", "step_id", "query", F.posexplode_outer("items").alias("pos", "_item")
    ).where("pos is not null").select("store", "step_id", "query", "pos", "_item.*")


def parse_product_page(pages: DataFrame) -> DataFrame:
    """``pages(url, body)`` of the first store -> title and price; null for short bodies."""
    read = pages.withColumns(
        {
            "_price": F.expr(price_parts("body")),
            "_title": F.expr(f"nullif({strip_tags(grab('body', r'(?s)<h1[^>]*id="work_name"[^>]*>(.*?)</h1>'))}, '')"),
        }
    )
    whole = f"length(body) >= {MIN_BODY}"
    return read.select(
        "url",
        F.expr(f"if({whole}, _title, null)").alias("title"),
        F.expr(f"if({whole}, _price.value, null)").alias("price"),
        F.expr(f"if({whole}, coalesce(_price.text, ''), null)").alias("price_text"),
    )
