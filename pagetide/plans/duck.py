"""DuckDB SQL twins of the Spark column functions (used only by the oracles).

Each builder takes SQL expression text and returns SQL expression text with
the same semantics as the like-named Spark function in ``pagetide.functions``.
Patterns come from ``functions.patterns`` so both engines run the same regex.
"""

from __future__ import annotations

from pagetide.functions import patterns as P
from pagetide.functions import text as TX


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str) -> str:
    """regexp_replace, all matches (Java's default)."""
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def rx(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def strip(x: str) -> str:
    return rr(x, P.STRIP, "")


def nz(x: str) -> str:
    return f"nullif({x}, '')"


# ---------------------------------------------------------------- URLs


def with_https(v: str) -> str:
    return f"(CASE WHEN contains({v}, '://') THEN {rr(v, P.SCHEME_PREFIX, 'https://')} ELSE 'https://' || {v} END)"


def netloc(u: str) -> str:
    return rx(u, P.NETLOC)


def url_error(raw: str) -> str:
    v = strip(raw)
    norm = with_https(rr(v, P.TRAILING_PUNCT, ""))
    host = netloc(norm)
    return (
        f"(CASE WHEN {raw} IS NULL OR {v} = '' THEN 'empty' "
        f"WHEN contains(split_part(split_part({v}, '//', -1), '/', 1), ' ') THEN 'looks_like_text' "
        f"WHEN {host} = '' THEN 'no_host' "
        f"WHEN NOT contains(split_part({host}, ':', 1), '.') THEN 'no_tld' END)"
    )


def normalize_url(raw: str) -> str:
    v = strip(raw)
    v = rr(v, P.TRAILING_PUNCT, "")
    v = with_https(v)
    v = rr(v, r"(?s)\A(https://[^/?#]*?)\.+([/?#].*)?\z", r"\1\2")
    return f"(CASE WHEN {url_error(raw)} IS NULL THEN {v} END)"


def domain_of_normalized(n: str) -> str:
    h = f"lower({netloc(n)})"
    h = rr(h, r"\Awww\.", "")
    h = rr(h, r":.*\z", "")
    return rr(h, r"\.+\z", "")


def url_domain(raw: str) -> str:
    return domain_of_normalized(normalize_url(raw))


def site_name(d: str) -> str:
    return f"(replace({d}, '.', '-') || {lit(P.SITE_NAME_SUFFIX)})"


def repo_name(d: str) -> str:
    return f"({lit(P.REPO_NAME_PREFIX)} || {site_name(d)})"


def url_path(u: str) -> str:
    return rr(rx(u, P.PATH), r";[^/]*\z", "")


def url_slug(u: str) -> str:
    path = rr(url_path(rr(u, r"/+\z", "")), r"\A/+|/+\z", "")
    slug = rr(f"lower(replace({path}, '/', '--'))", r"[^a-z0-9\-]", "")
    return (
        f"(CASE WHEN {path} = '' THEN 'index' "
        f"WHEN length({slug}) > {P.MAX_SLUG_LEN} THEN substring({slug}, 1, {P.MAX_SLUG_LEN}) || '-' || "
        f"substring(sha256({u}), 1, {P.SLUG_HASH_LEN}) ELSE {slug} END)"
    )


def is_content_url(u: str) -> str:
    return f"(NOT regexp_matches({u}, {lit(P.STATIC_ASSET)}))"


def drop_query(u: str) -> str:
    return rr(u, r"[?#].*\z", "")


def batch_id_agg(u: str) -> str:
    return f"substring(sha256(array_to_string(list_sort(list({u})), chr(10))), 1, {P.BATCH_ID_LEN})"


def batch_id_of(arr: str) -> str:
    return f"substring(sha256(array_to_string(list_sort({arr}), chr(10))), 1, {P.BATCH_ID_LEN})"


def is_homepage(u: str, d: str) -> str:
    x = rr(u, r"/+\z", "")
    return (
        f"({x} IN ('https://' || {d}, 'https://www.' || {d}, 'http://' || {d}, 'http://www.' || {d}))"
    )


# ---------------------------------------------------------------- text


def decode_entities(x: str) -> str:
    for ent, ch in P.ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def strip_html(x: str) -> str:
    s = rr(x, P.BR_TAG, " ")
    s = rr(s, P.ANY_TAG, "")
    s = rr(s, P.WS_RUN, " ")
    return strip(s)


def br_to_newline(x: str) -> str:
    return rr(x, P.BR_TAG, "\n")


def _count_char(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, {lit(ch)}, '')))"


def is_artifact_line(line: str) -> str:
    s = strip(line)
    return (
        f"(length({s}) > {TX.ARTIFACT_MIN_LEN} AND NOT contains({s}, ' ') AND "
        f"({_count_char(s, '-')} > {TX.ARTIFACT_MAX_SEP} OR {_count_char(s, '_')} > {TX.ARTIFACT_MAX_SEP}) AND "
        f"regexp_matches({s}, '\\p{{Lu}}'))"
    )


def clean_body(x: str) -> str:
    kept = f"list_filter(string_split({x}, chr(10)), lambda l: NOT {is_artifact_line('l')})"
    return strip(f"array_to_string({kept}, chr(10))")


def artifact_line_count(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda l: {is_artifact_line('l')}))::BIGINT"


def yaml_escape(x: str) -> str:
    s = f"replace({x}, '\\', '\\\\')"
    s = f"replace({s}, '\"', '\\\"')"
    return f"replace({s}, chr(10), ' ')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, {lit(P.WS_RUN)}), lambda w: w <> '')"


def wrap_summary(x: str, indent: int = TX.WRAP_INDENT, width: int = TX.WRAP_WIDTH) -> str:
    prefix = lit(" " * indent)
    step = (
        "lambda acc, w: CASE WHEN length(acc.line) + length(w) + 1 > " + str(width) + " "
        "THEN {'lines': list_append(acc.lines, rtrim(acc.line)), 'line': " + prefix + " || w || ' '} "
        "ELSE {'lines': acc.lines, 'line': acc.line || w || ' '} END"
    )
    init = "{'lines': []::VARCHAR[], 'line': " + prefix + "}"
    acc = f"list_reduce({words(x)}, {step}, {init})"
    return (
        f"(SELECT array_to_string(CASE WHEN trim(a.line) <> '' THEN list_append(a.lines, rtrim(a.line)) "
        f"ELSE a.lines END, chr(10)) FROM (SELECT {acc} AS a))"
    )


def condense_summary(x: str) -> str:
    s = strip(x)
    sentences = f"list_filter(list_transform(string_split({s}, '. '), lambda t: {strip('t')}), lambda t: t <> '')"
    hit = " OR ".join(f"contains(lower(t), {lit(p)})" for p in TX.PAGE_STRUCTURE_PHRASES)
    business = f"list_filter({sentences}, lambda t: NOT ({hit}))"
    chosen = f"list_slice(CASE WHEN len({business}) > 0 THEN {business} ELSE {sentences} END, 1, {TX.CONDENSE_MAX_SENTENCES})"
    sent = "(" + rr("x", r"\.\z", "") + " || '.')"
    step = (
        "lambda acc, x: CASE WHEN NOT acc.stop AND acc.len + length(" + sent + ") + "
        "(CASE WHEN len(acc.parts) > 0 THEN 1 ELSE 0 END) <= " + str(TX.CONDENSE_MAX_CHARS) + " "
        "THEN {'parts': list_append(acc.parts, " + sent + "), 'len': acc.len + length(" + sent + ") + "
        "(CASE WHEN len(acc.parts) > 0 THEN 1 ELSE 0 END), 'stop': false} "
        "ELSE {'parts': acc.parts, 'len': acc.len, 'stop': true} END"
    )
    init = "{'parts': []::VARCHAR[], 'len': 0::BIGINT, 'stop': false}"
    return f"nullif(array_to_string(list_reduce({chosen}, {step}, {init}).parts, ' '), '')"


# ---------------------------------------------------------------- HTML


def field(html: str, pattern: str) -> str:
    raw = rx(html, pattern)
    return strip(rr(decode_entities(rr(raw, P.ANY_TAG, "")), P.WS_RUN, " "))


def meta_value(html: str, attr: str, value: str) -> str:
    first, second = (f"nullif({quoted(html, p)}, '')" for p in (P.meta_content(attr, value), P.meta_content_first(attr, value)))
    raw = f"coalesce({first}, {second}, '')"
    return strip(rr(decode_entities(rr(raw, P.ANY_TAG, "")), P.WS_RUN, " "))


def quoted(html: str, pattern: str) -> str:
    return f"({rx(html, pattern, 1)} || {rx(html, pattern, 2)})"


def page_lang(html: str) -> str:
    return f"lower({quoted(html, P.LANG)})"


# The main content, written apart from the Spark fold: its own token regex, and
# open elements as one path such as '>div>nav>', cut at an element's last place.
_PIECES = (
    r"(?is)<!--(?:.*?-->|.*)|<script\b(?:.*?</(?:script|style)\s*>|.*)|<style\b(?:.*?</(?:script|style)\s*>|.*)|<svg\b[^>]*/>"
    r"|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>|<iframe\b.*?</iframe\s*>"
    r"|<head\b.*?(?:</head\s*>|<body\b[^>]*>)"
    r"""|</?[a-z](?:[^"'>]|"[^"]*"|'[^']*')*>|</?[a-z][^>]*>|<[!?/][^>]*>|[^<]+|<"""
)
_OUT = "sidebar|navigation|filter|widget|widget-area|sidebar-widget|menu|ad|ads|advert|advertisement"
_OUT_NAMED = (
    r"(?is)[\s\"'](class|id)\s*=\s*(\"([^\"]*\s)?(" + _OUT + r")(\s[^\"]*)?\"|'([^']*\s)?(" + _OUT + r")(\s[^']*)?'|(" + _OUT + r")[\s/>])"
)


def tag_name(t: str) -> str:
    return f"(CASE WHEN starts_with({t}, '<') THEN lower(regexp_extract({t}, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE '' END)"


def content_pieces(html: str) -> str:
    """The tokens outside blocks that are no content, joined by a private mark."""
    kinds = ("'nav','aside','header','footer','menu','div','section','span','article','main','form','ul','ol','li','dl','p','table',"
             "'blockquote','figure','details','center','body','html'")
    bad = f"(x.n IN ('nav','aside','header','footer','menu') OR regexp_matches(x.t, {lit(_OUT_NAMED)}))"
    cut_at = "regexp_extract(acc.path, '^(.*>)' || x.n || '>', 1)"
    # path before this token's own element: siblings close, content leaves what cannot hold it
    before = (
        "(CASE WHEN x.n IN ('p', 'li') AND ends_with(acc.path, '>' || x.n || '>') THEN acc.path[:-(length(x.n) + 2)] "
        "WHEN x.n IN ('article', 'main') AND acc.skip > 0 AND regexp_extract(acc.path[:acc.skip], '([a-z0-9]+)>$', 1) IN ('nav', 'header', 'menu') "
        "THEN regexp_extract(acc.path[:acc.skip], '^(.*>)[a-z0-9]+>$', 1) ELSE acc.path END)"
    )
    still = f"(CASE WHEN acc.skip > length({before}) THEN 0 ELSE acc.skip END)"
    opened = (
        f"{{'path': {before} || x.n || '>', 'skip': (CASE WHEN {still} = 0 AND {bad} THEN length({before} || x.n || '>') ELSE {still} END), "
        f"'got': (CASE WHEN {still} = 0 AND NOT {bad} THEN list_append(acc.got, x.t) ELSE acc.got END)}}"
    )
    closed = (
        f"{{'path': {cut_at}, 'skip': (CASE WHEN acc.skip > length({cut_at}) THEN 0 ELSE acc.skip END), "
        "'got': (CASE WHEN acc.skip = 0 THEN list_append(acc.got, x.t) ELSE acc.got END)}"
    )
    plain = "{'path': acc.path, 'skip': acc.skip, 'got': (CASE WHEN acc.skip = 0 THEN list_append(acc.got, x.t) ELSE acc.got END)}"
    step = (
        f"lambda acc, x: CASE WHEN x.n NOT IN ({kinds}) OR ends_with(x.t, '/>') THEN {plain} "
        f"WHEN NOT starts_with(x.t, '</') THEN {opened} WHEN {cut_at} = '' THEN {plain} ELSE {closed} END"
    )
    tokens = f"list_transform(regexp_extract_all({html}, {lit(_PIECES)}), lambda t: {{'t': t, 'n': {tag_name('t')}}})"
    return f"list_reduce({tokens}, {step}, {{'path': '>', 'skip': 0::BIGINT, 'got': []::VARCHAR[]}}).got"


def _anchor(t: str) -> str:
    """An anchor's start tag as its target between two marks, without quotes."""
    value = rx(t, r"""(?is)^<a((\s|/)+[^\s"'>/=]+(\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?)*?(\s|/)+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 6)
    bare = f"(CASE WHEN {value}[1] IN (chr(34), chr(39)) THEN {value}[2:-2] ELSE {value} END)"
    return f"(CASE WHEN {bare} <> '' THEN chr(57345) || {bare} || chr(57346) ELSE '' END)"


def _anchors(s: str) -> str:
    done = rr(s, r"\x{E001}([^\x{E001}\x{E002}\x{E003}]*)\x{E002}([^\x{E001}\x{E003}]*)\x{E003}", r"[\2](\1)")
    return rr(done, r"\x{E001}[^\x{E001}\x{E002}\x{E003}]*\x{E002}|[\x{E001}\x{E002}\x{E003}]", "")


def pieces_markdown(pieces: str) -> str:
    n, piece = tag_name("t"), []
    piece.append(f"WHEN {n} = '' THEN (CASE WHEN starts_with(t, '<') AND t <> '<' THEN '' ELSE t END)")
    piece.append(r"WHEN regexp_matches(t, '(?i)^</(h[1-6]|p)\b') OR regexp_matches(t, '(?i)^<p\b') THEN chr(10) || chr(10)")
    piece.append(r"WHEN regexp_matches(t, '(?i)^<h[1-6]\b') THEN chr(10) || chr(10) || repeat('#', t[3]::INT) || ' '")
    piece.append(r"WHEN regexp_matches(t, '(?i)^<li\b') THEN chr(10) || '- '")
    piece.append(r"WHEN regexp_matches(t, '(?i)^</?br\b') OR regexp_matches(t, '(?i)^</(li|ul|ol|div|section|article|main|table|tr|blockquote)\b') THEN chr(10)")
    piece.append(f"WHEN {n} = 'a' THEN (CASE WHEN starts_with(t, '</') THEN chr(57347) ELSE {_anchor('t')} END) ELSE ''")
    s = f"array_to_string(list_transform({pieces}, lambda t: CASE {' '.join(piece)} END), '')"
    s = _anchors(s)
    s = decode_entities(s)
    s = rr(s, r"[ \t\x{A0}]+", " ")
    s = rr(s, r"[ \t]*\n[ \t]*", "\n")
    s = rr(s, r"\n{3,}", "\n\n")
    return strip(s)


def markdown_lite(html: str) -> str:
    return pieces_markdown(content_pieces(html))


def count_links(pieces: str) -> str:
    only = f"list_filter({pieces}, lambda t: {tag_name('t')} = 'a')"
    marks = f"array_to_string(list_transform({only}, lambda t: CASE WHEN starts_with(t, '</') THEN chr(57347) ELSE {_anchor('t')} END), '')"
    return f"len(string_split({marks}, chr(57346) || chr(57347))) - 1"


def count_headings(pieces: str) -> str:
    return f"len(list_filter({pieces}, lambda t: regexp_matches(t, '(?i)^<h[1-6]\\b')))"


def plain_text(md: str) -> str:
    return strip(rr(md, P.WS_RUN, " "))


def main_text(md: str) -> str:
    s = rr(md, r"(?m)^#{1,6} ", "")
    s = rr(s, r"(?m)^- ", "")
    s = rr(s, r"\[([^\]]*)\]\([^)]*\)", r"\1")
    return plain_text(s)


def lead_text(md: str) -> str:
    s = rr(md, r"(?m)^#{1,6} .*$", "")
    return main_text(s)


def lead_sentences(t: str, n: int) -> str:
    from pagetide.functions.html import lead_pattern

    return strip(rx(t, lead_pattern(n)))


def hrefs(html: str) -> str:
    bare = rr("x", P.HREF_QUOTES, "")
    return f"list_transform(regexp_extract_all({html}, {lit(P.HREF)}, 1), lambda x: {decode_entities(bare)})"


def remove_dot_segments(u: str) -> str:
    """Independent of the Spark form: segments with depth counted from the end."""
    parts = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)\z"
    path = rx(u, parts, 2)
    closed = f"(CASE WHEN regexp_matches({path}, '/\\.\\.?\\z') THEN {path} || '/' ELSE {path} END)"
    walked = (
        f"list_reduce(list_transform(string_split({closed}, '/'), lambda s: [s]), lambda acc, s: CASE WHEN s[1] = '.' THEN acc "
        f"WHEN s[1] = '..' THEN (CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END) ELSE list_concat(acc, s) END)"
    )
    fixed = f"({rx(u, parts, 1)} || array_to_string({walked}, '/') || {rx(u, parts, 3)})"
    return (
        f"(CASE WHEN regexp_matches({u}, '(?s)\\A[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)?/\\.\\.?(/|\\z|\\?|#)') "
        f"THEN {fixed} ELSE {u} END)"
    )


def resolve_href(h: str, b: str) -> str:
    """``h`` must already be stripped."""
    scheme = rx(b, r"\A([A-Za-z][A-Za-z0-9+.\-]*):")
    origin = rx(b, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)")
    no_frag = rr(b, r"#.*\z", "")
    no_query = rr(no_frag, r"\?.*\z", "")
    bd = rr(rx(no_query, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/.*)?)"), r"[^/]*\z", "")
    base_dir = f"(CASE WHEN ends_with({bd}, '/') THEN {bd} ELSE {origin} || '/' END)"
    return (
        f"(CASE WHEN regexp_matches({h}, '\\A[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {h} "
        f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
        f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
        f"WHEN starts_with({h}, '#') THEN {no_frag} || {h} "
        f"WHEN starts_with({h}, '?') THEN {no_query} || {h} "
        f"WHEN {h} = '' THEN {no_frag} "
        f"ELSE {base_dir} || {h} END)"
    )
