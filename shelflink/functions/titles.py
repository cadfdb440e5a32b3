"""Title rules as SQL text over NFKC input: brackets, labels, noise, cleaning."""

from __future__ import annotations

from .sql import Sql, any_of, array_of, case, each_indexed, grab, grab_all, has, keep, let, pattern, quote, repeat, sub, text
from .text import (
    CJK,
    HAN,
    KANA,
    chapter_number,
    collapse_spaces,
    has_meaningful_chars,
    meaningful_length,
    strip_chapters,
    trim_blanks,
)

# A segment matching one of these is a site name or an advertisement.
SITE_NOISE = [
    r"(?:漫画|漫畫|マンガ|コミック|comic|manga)\s*(?:网|網|屋|吧|站|網站|网站|之家|空间|小站|世界|大全|馆|館|库|庫|图|圖|城|社)",
    r"(?:免费|免費|無料|在线|在線|在线阅读|在线观看|試し読み|立ち読み|ネタバレ|汉化|漢化|生肉|raw|盗版|小說|小说)",
    r"(?:官网|官方|網站|网站|首頁|首页|最新|更新|连载|連載|全集|全卷|全巻|免费阅读|免費閱讀)",
    r"\b(?:read|online|free|raw|scan)\b",
    r"\.(?:com|net|org|cc|me|tv|xyz|top|site|info|club|vip|cn|jp|tw|io|app|us|biz|fun|art)\b",
]

# Headings of page sections, never titles.
SECTION_HEADINGS = [
    r"^more like this$",
    r"^post a comment$",
    r"^comments?$",
    r"^recommend(ed|ations)?$",
    r"^related( works?| galleries?)?$",
    r"^you may also like$",
    r"^tags?$",
    r"^artists?$",
    r"^groups?$",
    r"^languages?$",
    r"^categories$",
    r"^pages?$",
    r"^parodies$",
    r"^uploaded$",
    r"^download$",
    r"^save this search$",
    r"^search$",
    r"^filter",
    r"^sort",
    r"^settings$",
    r"^show (?:more|all)$",
    r"^おすすめ$",
    r"^関連(作品)?$",
    r"^コメント$",
    r"^作者",
    r"^タグ$",
    r"^シリーズ",
    r"^この作品を買った人",
    r"^レビュー$",
    r"^概要$",
    r"^作品情報$",
]

# Words trimmed from either end of a title, tried in this order.
BOUNDARY_TOKENS = [
    "無料", "免费", "免費", "在线", "在線", "在线阅读", "在线阅读", "在线观看", "全文",
    "漫画", "漫畫", "マンガ", "コミック", "comic", "manga",
    "raw", "生肉", "汉化", "漢化", "试看", "試し読み", "立ち読み",
    "连载", "連載", "完结", "完結", "最新", "更新", "全集", "全巻", "全卷", "免费阅读", "免費閱讀",
]

# Everything after one of these is site text; first rule that fits wins.
STRONG_NOISE = [
    (r"免费|免費|無料", False),
    (r"在线阅读|在线阅读|在线观看|在线漫画|在線|在线", False),
    (r"(?:漫画|漫畫|マンガ|コミック)(?:网|網|屋|吧|站|網站|网站|之家|空间|世界|大全|馆|館|库|庫|圖|图)", False),
    (r"汉化|漢化|生肉|熟肉", False),
    (r"试看|試し読み|立ち読み|ネタバレ", False),
    (r"最新章节|最新話|全巻|全卷", False),
    (r"\braw\b|\bR18\b", True),
]

# Segment separators, bracket pairs, edition labels, bracket notes.
SEPARATOR = r"\s*[|｜/／»«›]\s*|\s*::\s*|\s*[–—]+\s*|\s+-\s*|_+"
BRACKETS = [
    ("【", "】"), ("[", "]"), ("（", "）"), ("(", ")"), ("「", "」"), ("『", "』"),
    ("〈", "〉"), ("《", "》"), ("<", ">"),
]
EDITIONS = [
    "DL版", "DL", "ダウンロード版", "英訳", "英語", "English", "Chinese", "中文", "中文版",
    "漢化", "汉化", "汉化组", "漢化組", "翻訳", "翻訳版", "Translated", "Digital", "デジタル",
    "無修正", "Uncensored", "Censored", "Raw", "生肉", "熟肉", "日本語訳", "日本語版",
    "個人翻訳", "个人汉化", "機翻", "机翻", "嵌字", "モザイク", "修正版", "再録", "再录",
]
EDITION_LABEL = rf"[\s\-–—_·•|｜]*[\[【（(「『]\s*(?:{'|'.join(EDITIONS)})\s*[\]】）)」』]"
LATIN_BRACKET = r"[\s\-–—_·•|｜]*[\[【（(]\s*[A-Za-z0-9][A-Za-z0-9 .,'\&_\-]{0,24}\s*[\]】）)]"
TRANSLATION_BRACKET = (
    r"[\s\-–—_·•|｜]*[\[【（(][^\[\]【】（）()]{0,24}"
    r"(?:汉化|漢化|翻译|翻譯|翻訳|中文|中国語|日本語訳|个人|個人|机翻|機翻|赞助|贊助|掃圖|扫图)"
    r"[^\[\]【】（）()]{0,24}[\]】）)]"
)
ANNOTATION_HINT = r"\d|ページ|page|vol\.?|号|巻|収録|版"
BRACKET_AT_END = r"[\s\-–—_·•|｜]*([\[【（(][^\[\]【】（）()]{1,60}[\]】）)])\s*$"
EDGE_PUNCTUATION = (
    r"^[\s\-–—_·•|｜/、,，.。:：;；!！?？~～]+|[\s\-–—_·•|｜/、,，.。:：;；!！?？~～]+$"
)
EMPTY_BRACKET = r"[\[【（(「『]\s*[\]】）)」』]"
ANY_BRACKETED = r"[\[【（(「『〈《<][^\]】）)」』〉》>]{0,60}[\]】）)」』〉》>]"

# Artist labels, all labels, and values that are no artist.
ARTIST_LABELS = "artists?|circles?|groups?|authors?"
INFO_LABELS = (
    "parodies?|tags?|groups?|artists?|circles?|authors?|characters?|languages?|categories?|"
    "pages?|uploaded|favorites?"
)
NOT_AN_ARTIST = (
    r"^(?:original|japanese|english|chinese|translated|doujinshi|manga|various|none|unknown|full[- ]?color)$"
)


def is_section_heading(value: Sql) -> Sql:
    patterns = "|".join(f"(?:{p})" for p in SECTION_HEADINGS)
    return let(
        collapse_spaces(value),
        lambda v: f"({v} = '' or {has(v, r'^#?[0-9]{3,}$')} or {has(v, patterns, True)})",
    )


def is_noise_segment(segment: Sql, host: Sql) -> Sql:
    core = f"lower(split({sub(text(host), r'^www[.]')}, '[.]')[0])"
    patterns = "|".join(f"(?:{p})" for p in SITE_NOISE)
    return let(
        collapse_spaces(segment),
        lambda v: f"(length({v}) <= 1 or {has(v, patterns, True)}"
        f" or (length({core}) >= 3 and contains(lower({v}), {core})))",
    )


def split_leading_bracket(value: Sql) -> Sql:
    """struct(inner, rest) of a leading, properly closed bracket block, else null.
    ``value`` has collapsed spaces; nesting of the same bracket kind is honoured."""

    def closing(v: Sql, close: Sql) -> Sql:
        opening = f"left({v}, 1)"
        step = case(
            ("acc.done > 0", "acc"),
            (f"c = {opening}", "named_struct('depth', acc.depth + 1, 'pos', acc.pos + 1, 'done', 0)"),
            (
                f"c = {close}",
                "named_struct('depth', acc.depth - 1, 'pos', acc.pos + 1,"
                " 'done', if(acc.depth = 1, acc.pos + 1, 0))",
            ),
            default="named_struct('depth', acc.depth, 'pos', acc.pos + 1, 'done', 0)",
        )
        return (
            f"aggregate(split({v}, ''), named_struct('depth', 0, 'pos', 0, 'done', 0),"
            f" (acc, c) -> {step}, acc -> acc.done)"
        )

    def cut(v: Sql) -> Sql:
        pairs = "map(" + ", ".join(f"{quote(a)}, {quote(b)}" for a, b in BRACKETS) + ")"

        def parts(end: Sql) -> Sql:
            block = (
                f"named_struct('inner', {collapse_spaces(f'substr({v}, 2, {end} - 2)')},"
                f" 'rest', {collapse_spaces(f'substr({v}, {end} + 1)')})"
            )
            return f"if({end} > 0, {let(block, lambda b: f'if({b}.inner <> {chr(39) * 2}, {b}, null)')}, null)"

        return let(f"{pairs}[left({v}, 1)]", lambda close: f"if({close} is null, null, {let(closing(v, close), parts)})")

    return let(value, cut)


def unwrap_leading(value: Sql) -> Sql:
    """The text with its leading bracket opened: ``[a] b`` -> ``a b``."""
    return let(
        collapse_spaces(value),
        lambda v: let(
            split_leading_bracket(v),
            lambda b: f"if({b} is null, {v}, {collapse_spaces(f'concat({b}.inner, {quote(' ')}, {b}.rest)')})",
        ),
    )


def strip_edition_labels(value: Sql) -> Sql:
    def once(s: Sql) -> Sql:
        cut = sub(sub(sub(s, EDITION_LABEL, " ", True), TRANSLATION_BRACKET, " "), LATIN_BRACKET, " ")
        return let(collapse_spaces(cut), lambda n: f"if({meaningful_length(n)} < 2, {s}, {n})")

    bracket = has(value, r"[\]】）)」』]")
    return f"if({bracket}, {repeat(collapse_spaces(value), 6, once)}, {collapse_spaces(value)})"


def strip_source_annotation(value: Sql) -> Sql:
    def once(s: Sql) -> Sql:
        inner = sub(grab(s, BRACKET_AT_END), r"^.|.$")
        head = collapse_spaces(grab(s, rf"(?s)^(.*?){BRACKET_AT_END}"))
        return f"if({has(inner, ANNOTATION_HINT, True)}, " + let(
            head, lambda h: f"if({meaningful_length(h)} >= 2, {h}, {s})"
        ) + f", {s})"

    bracket = has(value, r"[\]】）)]\s*$")
    return f"if({bracket}, {repeat(collapse_spaces(value), 3, once)}, {collapse_spaces(value)})"


def strip_boundary_noise(value: Sql) -> Sql:
    """Cut at the first strong marker that leaves a title, then trim noise words off
    both ends until nothing changes (every pass of the word list removes at least two
    characters, so length / 2 passes always reach the fixed point)."""

    def cut(v: Sql) -> Sql:
        def head(regex: str, ignore_case: bool) -> Sql:
            raw = grab(v, rf"(?s)^(.*?)(?:{regex})", 1, ignore_case)
            kept = collapse_spaces(raw)
            return (
                f"if({has(v, regex, ignore_case)} and length({raw}) >= 2"
                f" and {meaningful_length(kept)} >= 2 and {meaningful_length(kept)} < {meaningful_length(v)},"
                f" {kept}, null)"
            )

        heads = ", ".join(head(regex, ic) for regex, ic in STRONG_NOISE)
        any_strong = any_of([has(v, regex, ic) for regex, ic in STRONG_NOISE])
        return f"if({any_strong}, coalesce({heads}, {v}), {v})"

    def trim_ends(v: Sql) -> Sql:
        fits = "length(s) - length(t) >= 2"
        front = f"if(startswith(lower(s), lower(t)) and {fits}, {trim_blanks('substr(s, length(t) + 1)')}, s)"
        back = let(
            front,
            lambda f: f"if(endswith(lower({f}), lower(t)) and length({f}) - length(t) >= 2,"
            f" {trim_blanks(f'left({f}, length({f}) - length(t))')}, {f})",
        )
        passes = f"aggregate({array_of(BOUNDARY_TOKENS)}, p, (s, t) -> {back})"
        loop = f"aggregate(sequence(1, 1 + int(length({v}) / 2)), {v}, (p, i) -> {passes})"
        words = "|".join(BOUNDARY_TOKENS)
        return f"if({has(v, rf'^(?:{words})|(?:{words})$', True)}, {loop}, {v})"

    return let(let(collapse_spaces(value), cut), trim_ends)


def trim_punctuation(value: Sql) -> Sql:
    return collapse_spaces(sub(sub(text(value), EMPTY_BRACKET, " "), EDGE_PUNCTUATION))


def variant_key(value: Sql) -> Sql:
    """Two titles with equal keys differ only in bracketed parts, blanks or case."""
    return f"lower({sub(sub(text(value), ANY_BRACKETED), r'\s+')})"


def title_segment(working: Sql, host: Sql) -> Sql:
    """struct(segment, dropped) after site-name segments are removed; dropped is the
    removed segments joined by ``|``, null when nothing was removed."""

    def describe(segment: Sql, index: Sql) -> Sql:
        stripped = collapse_spaces(strip_boundary_noise(strip_chapters(unwrap_leading(segment))))
        return (
            f"named_struct('segment', {segment}, 'pos', {index}, 'size', {meaningful_length(stripped)},"
            f" 'noise', {is_noise_segment(segment, host)})"
        )

    def decide(infos: Sql) -> Sql:
        def marked(with_noise: Sql) -> Sql:
            kana = keep(with_noise, lambda x: f"{has(f'{x}.segment', KANA)}")
            others_han = f"forall({with_noise}, x -> {has('x.segment', KANA)} or {has('x.segment', HAN)})"
            bilingual = (
                f"(not exists({with_noise}, x -> x.noisy) and size({with_noise}) > 1"
                f" and size({kana}) = 1 and {others_han})"
            )
            return let(
                f"transform({with_noise}, x -> named_struct('segment', x.segment, 'size', x.size,"
                f" 'noisy', if({bilingual}, not {has('x.segment', KANA)}, x.noisy)))",
                pick,
            )

        def pick(final: Sql) -> Sql:
            good = f"filter({final}, x -> not x.noisy)"
            bad = f"filter({final}, x -> x.noisy)"

            def choose(usable: Sql) -> Sql:
                wrapped = let(split_leading_bracket(collapse_spaces("x.segment")), lambda b: f"({b} is not null and {b}.rest = '')")
                return (
                    f"coalesce(get(filter({usable}, x -> {wrapped}), 0).segment,"
                    f" get(filter({usable}, x -> x.size >= 2), 0).segment, get({usable}, 0).segment)"
                )

            chosen = (
                f"named_struct('segment', {let(good, choose)},"
                f" 'dropped', array_join(transform({bad}, x -> x.segment), '|'))"
            )
            whole = f"named_struct('segment', {working}, 'dropped', cast(null as string))"
            return f"if(size({good}) > 0 and size({bad}) > 0, {chosen}, {whole})"

        largest = f"array_max(transform({infos}, x -> x.size))"
        noisy = f"x.noise or x.size = 0 or (x.pos > 0 and x.size <= 4 and {largest} >= x.size * 3)"
        return let(
            f"transform({infos}, x -> named_struct('segment', x.segment, 'size', x.size, 'noisy', {noisy}))",
            marked,
        )

    def segments(parts: Sql) -> Sql:
        whole = f"named_struct('segment', {working}, 'dropped', cast(null as string))"
        return f"if(size({parts}) > 1, {let(each_indexed(parts, describe), decide)}, {whole})"

    parts = f"array_remove(transform(split({working}, {pattern(SEPARATOR)}), x -> {trim_blanks('x')}), '')"
    return let(parts, segments)


def clean_title(raw: Sql, normalized: Sql, host: Sql) -> Sql:
    """struct(raw_title, cleaned, confidence, notes, chapter_hint) of one title.

    ``raw`` is the decoded, space-collapsed title and ``normalized`` its NFKC form.
    Under-cleaning is preferred: every rule keeps at least two meaningful characters.
    """

    def noted(before: Sql, after: Sql, note: str) -> Sql:
        return f"if({after} <> {before}, {quote(note)}, null)"

    def start(n: Sql) -> Sql:
        wrapped = let(
            split_leading_bracket(n),
            lambda b: f"if({b} is not null and {b}.rest = '' and {has_meaningful_chars(f'{b}.inner')}, {b}.inner, null)",
        )
        return let(wrapped, lambda w: let(f"coalesce({w}, {n})", lambda working: after_wrap(w, working)))

    def after_wrap(w: Sql, working: Sql) -> Sql:
        return let(title_segment(working, host), lambda seg: editions(w, seg))

    def editions(w: Sql, seg: Sql) -> Sql:
        return let(
            collapse_spaces(f"{seg}.segment"),
            lambda a: let(
                strip_edition_labels(a),
                lambda b: let(strip_source_annotation(b), lambda c: prefix(w, seg, a, b, c)),
            ),
        )

    def prefix(w: Sql, seg: Sql, a: Sql, b: Sql, c: Sql) -> Sql:
        def opened(block: Sql) -> Sql:
            rest = collapse_spaces(strip_chapters(f"{block}.rest"))
            joined = collapse_spaces(f"concat({block}.inner, ' ', {block}.rest)")
            label = f"{meaningful_length(f'{block}.inner')} > 0 and {meaningful_length(rest)} >= 4"
            return case(
                (
                    f"{block} is null or not {has_meaningful_chars(joined)}",
                    f"named_struct('value', {c}, 'note', cast(null as string))",
                ),
                (label, f"named_struct('value', {rest}, 'note', 'dropped-prefix-label')"),
                default=f"named_struct('value', {joined}, 'note', 'unwrapped-leading')",
            )

        return let(
            let(split_leading_bracket(c), opened), lambda d: finish(w, seg, a, b, c, d)
        )

    def finish(w: Sql, seg: Sql, a: Sql, b: Sql, c: Sql, d: Sql) -> Sql:
        def last(e: Sql) -> Sql:
            def noise(f: Sql) -> Sql:
                notes = (
                    f"array_compact(array(if({w} is null, null, 'unwrapped'),"
                    f" if({seg}.dropped is null, null, concat('dropped-site-segment:', {seg}.dropped)),"
                    f" {noted(a, b, 'stripped-edition-label')}, {noted(b, c, 'stripped-source-annotation')},"
                    f" {d}.note, {noted(f'{d}.value', e, 'stripped-chapter')},"
                    f" {noted(e, f, 'stripped-noise-word')}))"
                )
                return let(trim_punctuation(f), lambda g: let(notes, lambda ns: result(g, ns)))

            return let(strip_boundary_noise(e), noise)

        return let(strip_chapters(f"{d}.value"), last)

    def result(cleaned: Sql, notes: Sql) -> Sql:
        sure = (
            f"exists({notes}, x -> startswith(x, 'dropped-site-segment') or x in"
            " ('unwrapped', 'stripped-chapter', 'dropped-prefix-label', 'stripped-edition-label'))"
        )
        confidence = case(
            (f"not {has_meaningful_chars(cleaned)} or length({cleaned}) < 2", "'low'"),
            (sure, "'high'"),
            default="'medium'",
        )
        return (
            f"named_struct('raw_title', {raw}, 'cleaned', {cleaned}, 'confidence', {confidence},"
            f" 'notes', {notes}, 'chapter_hint', {chapter_number(normalized)})"
        )

    empty = (
        f"named_struct('raw_title', '', 'cleaned', '', 'confidence', 'low', 'notes', array('empty'),"
        " 'chapter_hint', cast(null as int))"
    )
    return f"if({raw} = '', {empty}, {let(collapse_spaces(normalized), start)})"


def artist_names(raw_names: Sql, limit: int) -> Sql:
    """Clean, filter and de-duplicate raw artist names, first spelling wins."""

    def one(x: Sql) -> Sql:
        return trim_blanks(sub(sub(sub(collapse_spaces(x), r"^#+"), r"(?s)[（(].*$"), r"\s+\d{1,4}$"))

    def dedupe(names: Sql) -> Sql:
        usable = (
            f"length(n) between 2 and 40 and not {has('n', NOT_AN_ARTIST, True)} and not {has('n', r'^[0-9]+$')}"
        )
        return let(
            f"filter({names}, n -> {usable})",
            lambda ns: f"slice(filter({ns}, (n, i) -> array_position(transform({ns}, m -> lower(m)), lower(n)) = i + 1), 1, {limit})",
        )

    return let(f"transform({raw_names}, x -> {one('x')})", dedupe)


def heading_artists(headings: Sql) -> Sql:
    """Names in CJK bracket prefixes of headings (at most two)."""
    prefix = grab("x", r"^\s*[\[【]\s*([^\]】]{2,40}?)\s*[\]】]")
    found = f"filter(transform({headings}, x -> {prefix}), x -> {has('x', CJK)})"
    return artist_names(found, 2)


def info_artists(info: Sql) -> Sql:
    """Names in the artist / circle / group / author fields of the info block."""
    values = grab_all(
        text(info),
        rf"(?s)(?:{ARTIST_LABELS})\s*[:：]\s*(.*?)(?=\s*(?:{INFO_LABELS})\s*[:：]|$)",
        1,
        True,
    )
    parts = f"flatten(transform({values}, v -> split(v, {pattern(r'[|｜/／、,，;；]\s*')})))"
    return artist_names(parts, 3)
