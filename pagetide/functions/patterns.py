"""Regular expressions shared by the Spark columns and the DuckDB oracles.

Every pattern here stays inside the common subset of Java regex (Spark) and
RE2 (DuckDB): no look-around, no back-references, inline flags only,
explicit ``\\x{..}`` code points instead of ``\\s`` where Unicode matters.
"""

# Python's str.isspace() set, spelled out (Java's \s and RE2's \s are ASCII only).
WS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters, those of Latin-1 first: Java tests a class of these alone by
# one table look-up, the whole class by a chain of ranges.
WS_LATIN = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0"
WS_WIDE = "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Leading or trailing whitespace of the whole string (Python str.strip()).
STRIP = r"\A" + WS + r"+|" + WS + r"+\z"

SCHEME_PREFIX = r"(?s)\A.*?://"
# Host part of a URL that starts with a scheme: everything up to / ? or #.
NETLOC = r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
# Path of a URL (after the optional scheme + netloc, before ? or #).
PATH = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)"

# ---- fixed values that must equal the reference (URL handling) ------------
# Characters stripped from the end of user input.
TRAILING_PUNCT = r"[.,;:!? ]+\z"
# Static-asset / build-artifact URLs that are not content pages.
STATIC_ASSET = (
    r"(?i)(/_next/static/|/_nuxt/|/static/(js|css|media)/|/assets/(js|css)/)"
    r"|\.(css|js|mjs|jsx|ts|tsx|map|woff2?|ttf|eot|otf|ico|png|jpe?g|gif|svg|webp|avif|mp4|webm|pdf|zip|tar|gz)\z"
)
MAX_SLUG_LEN = 80
SLUG_HASH_LEN = 8
BATCH_ID_LEN = 16
SITE_NAME_SUFFIX = "-website-search-skill"
REPO_NAME_PREFIX = "skill-folder-"
# ---------------------------------------------------------------------------

BR_TAG = r"(?i)<br" + WS + r"*/?>"
ANY_TAG = r"<[^>]+>"
WS_RUN = WS + r"+"
WS_LATIN_RUN = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}]+"

# HTML field extraction (E1). (?is): case-insensitive, dot matches newline.
TITLE = r"(?is)<title[^>]*>(.*?)</title"
H1 = r"(?is)<h1[^>]*>(.*?)</h1"
# An attribute value in double or in single quotes: groups 1 and 2, of which
# one is empty. A quote of the other kind is part of the value.
QUOTED = r"""(?:"([^"]*)"|'([^']*)')"""
LANG = r"(?is)<html\b[^>]*\blang=" + QUOTED


META_TAG = r"(?is)<meta\b[^>]*>"


def meta_content(attr: str, value: str) -> str:
    """<meta {attr}="{value}" ... content="..."> (attribute order: name first)."""
    return r"(?is)<meta\b[^>]*\b" + attr + r"=[\"']" + value + r"[\"'][^>]*\bcontent=" + QUOTED


def meta_content_first(attr: str, value: str) -> str:
    """<meta content="..." ... {attr}="{value}"> (attribute order: content first)."""
    return r"(?is)<meta\b[^>]*\bcontent=" + QUOTED + r"[^>]*\b" + attr + r"=[\"']" + value + r"[\"']"


# Main content (E2/E3): pages are cut into tokens, blocks that are no content end
# at their own end tag, however deep they nest.
# ---- fixed values that must equal the reference (excluded tags) ----------
EXCLUDED_TAGS = ("nav", "aside", "header", "footer", "menu")
# ---------------------------------------------------------------------------
# Classes and ids of widgets and ads (our choice).
EXCLUDED_CLASSES = (
    "sidebar", "navigation", "filter", "widget", "widget-area", "sidebar-widget",
    "menu", "ad", "ads", "advert", "advertisement",
)
# Elements whose inside is one token and no text. A script or style without an
# end goes on to the end of the page, the others then mean nothing.
SILENT_TAGS = ("script", "style", "noscript", "template", "svg", "iframe", "head")
# A comment, a silent element, a tag (quoted values may hold >), other markup, text, a lone <.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\z)|<svg\b[^>]*/>"
    + "".join(rf"|<{t}\b.*?</{t}\s*>" for t in SILENT_TAGS[2:-1])
    + r"|<head\b.*?(?:</head\s*>|<body\b[^>]*>)"
    + r"""|</?[a-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*+>|<[!?/][^>]*+>|[^<]++|<"""
)
TAG_NAME = r"\A</?([A-Za-z][A-Za-z0-9]*)"
# Elements that can be a block to leave out, or end one that is open inside them.
TRACKED_TAGS = (
    "nav", "aside", "header", "footer", "menu", "div", "section", "span", "article", "main", "form", "ul", "ol", "li", "dl",
    "p", "table", "blockquote", "figure", "details", "center", "body", "html",
)
# Elements that close one of their own kind that is still open, and content that
# no open navigation, menu or header can hold.
SELF_CLOSING_SIBLINGS = ("p", "li")
CONTENT_TAGS = ("article", "main")
NEVER_AROUND_CONTENT = ("nav", "header", "menu")
_names = "|".join(EXCLUDED_CLASSES)
EXCLUDED_CLASS = (
    r"(?is)[\s\"'](?:class|id)\s*=\s*(?:\"(?:[^\"]*\s)?(?:" + _names + r")(?:\s[^\"]*)?\"|'(?:[^']*\s)?(?:" + _names
    + r")(?:\s[^']*)?'|(?:" + _names + r")(?:[\s/>]))"
)
# End tags that become a line break.
BREAK_TAGS = ("ul", "ol", "div", "section", "article", "main", "table", "tr", "blockquote")
# The href of an anchor's start tag, attribute by attribute: quoted values may hold anything.
TAG_HREF = (
    r"""(?is)\A<a(?:[\s/]+[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?[\s/]+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
)
# Private-use marks of an anchor's target, text and end while a page is put
# together; an anchor that begins inside another one ends it.
LINK_OPEN, LINK_TEXT, LINK_END = "\ue001", "\ue002", "\ue003"
LINK = "\ue001([^\ue001-\ue003]*)\ue002([^\ue001\ue003]*)\ue003"
LINK_MARKS = "\ue001[^\ue001-\ue003]*\ue002|[\ue001-\ue003]"
# One pass per kind of quote: group 1 the target, group 2 the text.
ANCHORS = tuple(
    r"(?is)<a\b[^>]*\bhref=" + q + "([^" + q + "]*)" + q + r"[^>]*>(.*?)</a" + WS + r"*>" for q in ('"', "'")
)
# An href attribute of an <a> (white space before it, so not data-href): group 1
# is the value with its quotes, or bare.
HREF = r"""(?is)<a[ \t\r\n\f](?:[^>]*?[ \t\r\n\f])?href[ \t\r\n\f]*=[ \t\r\n\f]*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""
HREF_QUOTES = r"""\A["']|["']\z"""
INLINE_SPACE = r"[ \t\x{A0}]+"
SPACE_AROUND_NL = r"[ \t]*\n[ \t]*"
MANY_NL = r"\n{3,}"

# Named HTML entities, decoded in this order; &amp; last so "&amp;lt;" stays "&lt;".
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&rsquo;", "’"),
    ("&lsquo;", "‘"),
    ("&rdquo;", "”"),
    ("&ldquo;", "“"),
    ("&euro;", "€"),
    ("&bull;", "•"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&trade;", "™"),
    ("&eacute;", "é"),
    ("&egrave;", "è"),
    ("&agrave;", "à"),
    ("&ccedil;", "ç"),
    ("&auml;", "ä"),
    ("&ouml;", "ö"),
    ("&uuml;", "ü"),
    ("&szlig;", "ß"),
    ("&ntilde;", "ñ"),
    ("&#8217;", "’"),
    ("&#8211;", "–"),
    ("&#8212;", "—"),
    ("&#8230;", "…"),
    ("&#160;", " "),
    ("&amp;", "&"),
)

# Words of running text (keyword jobs): letters and digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
