"""Pages that reach branches which no driver table reaches.

``probed`` queries run over the whole ``pages`` table and these rows: sites with
a root page for each tier of the description, page types, meta tags in all
quotings, artifact lines, nested blocks, assets, other sites' and invalid URLs.
"""

from __future__ import annotations

from contextvars import ContextVar

_on: ContextVar[bool] = ContextVar("pagetide_probes", default=False)

_ARTIFACT = "Chunk-" + "-".join(["abcdefghij"] * 12)
_LONG = "A sentence of the root page that is long enough to describe the whole site by itself."


def _page(body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html lang='en'><head>{head}</head><body>{body}</body></html>"


_ROWS = [
    # description tiers: first sentence, condensed summary, meta, Open Graph, generic
    ("https://first.example.com/", _page(f"<h1>Zz</h1><p>{_LONG} More.</p>")),
    ("https://www.second.example.com", _page("<p>Zz top. This page links to other pages. The business sells 12 kinds of rope in three towns. It opened long ago.</p>")),
    ("http://meta.example.com/", _page("<h1>Zz</h1><p>Zz.</p>", '<meta name="description" content="It\'s a meta description of the &quot;root&quot;">')),
    ("https://graph.example.com", _page("<p>Zz.</p>", "<meta content='An Open Graph \"description\" of it' property='og:description'><meta property=og:url content='https://graph.example.com/canonical'>")),
    ("https://plain.example.com/zz", _page("<h1>Zz</h1><p>Zz.</p>")),
    ("https://plain.example.com/og", _page("<p>Zz.</p>", "<meta property='og:url' content=\"https://plain.example.com/og\"><meta name='description' content='short'>")),
    # page types by first segment
    *[(f"https://types.example.com/{seg}/zz", _page(f"<h1>Zz {seg}</h1><p>Zz.</p>"))
      for seg in ("services", "solutions", "blog", "insights", "about", "who-we-are", "contact", "locations", "pricing", "plans", "docs", "faq", "product", "store", "zz")],
    ("https://types.example.com/", _page("<h1>Zz</h1>")),
    # artifact lines, next to a line that only looks like one
    ("https://lines.example.com/a", _page(f"<p>Zz.</p><p>{_ARTIFACT}</p><p>{_ARTIFACT.lower()}</p><p>{_ARTIFACT.replace('-', '_')}</p><p>end</p>")),
    # blocks in blocks, and links of all kinds
    ("https://nest.example.com/n", _page(
        "<nav><div><nav>a</nav>b</div>c</nav><div class='box sidebar'><div>d</div>e</div><h2>Zz</h2><p>f <a href='/ok?x=1'>ok</a><p>"
        "<a href=\"/a.pdf\">pdf</a> <a href=/static/js/x.js>js</a> <a href='/_next/static/y'>y</a> <a href='https://other.example.org/z'>off</a> "
        "<a href='http://localhost/q'>no dot</a> <a href='http://'>none</a> <a href='//'>slashes</a> <a href='mailto:a@b.co'>mail</a>")),
    ("https://nest.example.com/n?again", _page("<article><h1>Zz</h1><ul><li>one<li>two</ul><aside><article>t</article></aside>g</article>")),
    # nothing to keep, no site
    ("https://blank.example.com/b", _page("<nav>only a menu</nav>")),
    ("http://localhost/page", _page("<p>No site.</p>")),
]
#: (page_id, url, html)
PAGES = [(1_000_000_000 + i, url, html) for i, (url, html) in enumerate(_ROWS)]


def active() -> bool:
    return _on.get()


def with_probes(fn):
    """``fn`` over ``pages`` and these rows."""

    def run(spark, sf):
        token = _on.set(True)
        try:
            return fn(spark, sf)
        finally:
            _on.reset(token)

    return run


def probed_sql(sql: str) -> str:
    """A statement over ``pages`` as one over ``pages`` and these rows."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}::BIGINT, {lit(u)}, {lit(h)})" for i, u, h in PAGES)
    both = f"probed_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES {rows}) v(page_id, url, html))"
    head = "WITH RECURSIVE "
    if not sql.startswith(head):
        raise ValueError("not a statement with common table expressions")
    return f"{head}{both},\n{sql[len(head):].replace('FROM pages', 'FROM probed_pages')}"
