"""DuckDB oracle SQL, one statement per registered query.

Built from named CTEs that mirror the Spark plans step by step (same
regexes, same tie-breaks). ``oracle_sql()`` assembles each query's CTEs
in dependency order.
"""

from __future__ import annotations

from pagetide.functions import patterns as P
from pagetide.operators import search as QS
from pagetide.operators import sites as STS
from pagetide.operators import sync as SY
from pagetide.plans import duck as D
from pagetide.plans import probes
from pagetide.plans import queries as Q
from pagetide.plans import vocab as V
from pagetide.sources import snapshots as SN

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTES[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def build(select: str, *deps: str) -> str:
    names = _order(deps)
    if not names:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in names) + "\n" + select


L = D.lit
NL = "chr(10)"

# ---------------------------------------------------------------- pages

cte("k1", f"SELECT page_id AS seq, url, html, {D.normalize_url('url')} AS _n FROM pages")
cte("kp", f"SELECT {D.domain_of_normalized('_n')} AS domain, url, seq, html FROM k1", "k1")
cte(
    "pt1",
    f"""SELECT domain, url, seq, {D.markdown_lite('html')} AS markdown,
  {D.field('html', P.TITLE)} AS m_title,
  {D.meta_value('html', 'name', 'description')} AS m_description,
  {D.meta_value('html', 'property', 'og:description')} AS m_og_description,
  {D.meta_value('html', 'property', 'og:url')} AS m_og_url,
  {D.field('html', P.H1)} AS j_title
FROM kp""",
    "kp",
)
cte("pt2", f"SELECT *, {D.lead_text('markdown')} AS _text FROM pt1", "pt1")
cte(
    "pt",
    f"""SELECT domain, url, seq, markdown, url AS sourceURL, nullif(m_og_url, '') AS ogUrl,
  nullif(m_title, '') AS m_title, nullif(m_description, '') AS m_description,
  nullif(m_og_description, '') AS m_og_description, nullif(j_title, '') AS j_title,
  nullif({D.lead_sentences('_text', 1)}, '') AS j_description,
  nullif({D.lead_sentences('_text', 3)}, '') AS j_summary
FROM pt2""",
    "pt2",
)
cte(
    "rf",
    f"""SELECT domain, coalesce(nullif(sourceURL, ''), nullif(ogUrl, '')) AS url, seq,
  coalesce(m_title, nullif({D.strip_html('j_title')}, ''), 'Untitled') AS title,
  coalesce(m_description, m_og_description, {D.strip_html("coalesce(j_description, '')")}) AS description,
  {D.strip_html("coalesce(j_summary, '')")} AS summary, markdown
FROM pt WHERE {D.strip("coalesce(markdown, '')")} <> ''""",
    "pt",
)
cte(
    "rd1",
    "SELECT *, " + D.url_slug("coalesce(url, '')") + " AS slug, "
    + D.clean_body(D.br_to_newline("markdown")) + " AS body FROM rf",
    "rf",
)
cte(
    "rd",
    f"""SELECT domain, slug, url, seq, title, description, summary, body,
  '---' || {NL} || 'title: \"' || {D.yaml_escape('title')} || '\"' || {NL}
  || 'description: \"' || {D.yaml_escape('description')} || '\"' || {NL}
  || 'url: \"' || coalesce(url, '') || '\"' || {NL}
  || 'summary: |' || {NL} || {D.wrap_summary('summary')} || {NL} || '---' || {NL} || {NL} || body AS content
FROM rd1""",
    "rd1",
)
cte(
    "docs",
    """SELECT domain, slug, url, seq, title, description, summary, body, content, sha256(content) AS content_sha
FROM (SELECT *, row_number() OVER (PARTITION BY domain, slug ORDER BY seq DESC, url DESC) AS _r FROM rd)
WHERE _r = 1""",
    "rd",
)

# main text (E3 table)
cte("mt", f"SELECT domain, url, seq, {D.main_text(D.markdown_lite('html'))} AS text FROM kp", "kp")

# markdown with its counts
cte("md0", f"SELECT domain, url, seq, {D.content_pieces('html')} AS got FROM kp", "kp")

# links (E4)
cte(
    "lk0",
    f"""SELECT domain, url, seq, (i - 1)::INTEGER AS pos, h[i] AS href
FROM (SELECT domain, url, seq, {D.hrefs('html')} AS h FROM kp), range(1, len(h) + 1) t(i)""",
    "kp",
)
cte(
    "lk1",
    f"SELECT * EXCLUDE (_r), {D.remove_dot_segments('_r')} AS target "
    f"FROM (SELECT *, {D.resolve_href('_h', 'url')} AS _r FROM (SELECT *, {D.strip('href')} AS _h FROM lk0))",
    "lk0",
)
cte("lk2", f"SELECT *, {D.normalize_url('target')} AS _tn FROM lk1", "lk1")
cte(
    "links",
    f"""SELECT domain, url, seq, pos, href, target, {D.domain_of_normalized('_tn')} AS target_domain,
  coalesce({D.domain_of_normalized('_tn')} = domain, false) AS is_same_site,
  {D.is_content_url('target')} AS is_content
FROM lk2""",
    "lk2",
)

# URL references (pages' own URLs + link targets)
cte(
    "refs0",
    """SELECT domain AS site, url AS raw, seq, 'page' AS kind FROM kp
UNION ALL SELECT domain AS site, target AS raw, seq, 'link' AS kind FROM links""",
    "kp",
    "links",
)
cte("refs1", f"SELECT *, {D.url_error('raw')} AS error, {D.normalize_url('raw')} AS nurl FROM refs0", "refs0")
cte("refs", f"SELECT *, {D.domain_of_normalized('nurl')} AS domain FROM refs1", "refs1")
cte(
    "inv",
    f"""SELECT domain, url, {D.url_slug('url')} AS slug, {D.is_content_url('url')} AS is_content, first_seq, n_refs
FROM (SELECT domain, nurl AS url, min(seq) AS first_seq, count(*) AS n_refs FROM refs WHERE error IS NULL GROUP BY domain, nurl)""",
    "refs",
)

# discovery (E5)
cte(
    "disc0",
    """SELECT domain, url AS found FROM kp
UNION ALL SELECT domain, target AS found FROM links WHERE is_same_site""",
    "kp",
    "links",
)
cte("disc1", f"SELECT domain, found, {D.normalize_url('found')} AS _n FROM disc0", "disc0")
cte(
    "disc",
    f"""SELECT domain, url, n_refs, {D.url_slug('url')} AS slug FROM (
  SELECT domain, url, count(*) AS n_refs
  FROM (SELECT domain, {D.drop_query('_n')} AS url, {D.domain_of_normalized('_n')} AS _d FROM disc1)
  WHERE url IS NOT NULL AND {D.is_content_url('url')} AND _d = domain
  GROUP BY domain, url)""",
    "disc1",
)

# ---------------------------------------------------------------- snapshots

spec = SN.SPEC
cte("site_pages", "SELECT domain, url, seq FROM kp", "kp")
cte("prev_map", f"SELECT * FROM site_pages WHERE seq % {spec.prev_drop_mod} <> 0", "site_pages")
cte("cur_map", f"SELECT * FROM site_pages WHERE seq % {spec.cur_drop_mod} <> 0 OR seq % {spec.prev_drop_mod} = 0", "site_pages")
cte("cached_urls", f"SELECT * FROM prev_map WHERE seq % {spec.uncached_mod} <> 0", "prev_map")
cte(
    "batches",
    f"""SELECT domain, chunk, {D.batch_id_of('urls')} AS batch_id, urls, len(urls)::BIGINT AS n_urls,
  CASE WHEN chunk % {spec.failed_chunk_mod} = 2 THEN 'failed' ELSE 'completed' END AS status,
  TIMESTAMP '{SN.PREV_RUN_TS}' + to_minutes(chunk) AS ts
FROM (SELECT domain, chunk, list_sort(list(url)) AS urls FROM (
  SELECT domain, url, ((row_number() OVER (PARTITION BY domain ORDER BY url) - 1) // {spec.batch_chunk})::INTEGER AS chunk
  FROM cached_urls) GROUP BY domain, chunk)""",
    "cached_urls",
)
cte(
    "prev_candidates",
    f"""SELECT domain, url, misses AS consecutive_misses,
  TIMESTAMP '{SN.PREV_RUN_TS}' - to_days((misses - 1) * 7) AS first_missing_at,
  TIMESTAMP '{SN.PREV_RUN_TS}' AS last_missing_at
FROM (SELECT domain, url, (1 + (seq // {spec.prev_drop_mod}) % 2)::INTEGER AS misses
      FROM site_pages WHERE seq % {spec.prev_drop_mod} = 0)""",
    "site_pages",
)
cte(
    "empty_site",
    "SELECT domain FROM (SELECT domain, count(*) AS n FROM site_pages GROUP BY domain) ORDER BY n DESC, domain LIMIT 1",
    "site_pages",
)
cte(
    "run_map",
    f"""SELECT s.domain, s.url, s.seq, s.run_id::INTEGER AS run_id,
  NOT ((s.seq % {spec.cur_drop_mod} = 0 AND s.run_id >= 2) OR (s.seq % {spec.uncached_mod} = 3 AND s.run_id = 3)
       OR (e.domain IS NOT NULL AND s.run_id = 1)) AS present
FROM (SELECT * FROM site_pages, range(0, {spec.n_runs}) r(run_id)) s
LEFT JOIN empty_site e ON e.domain = s.domain""",
    "site_pages",
    "empty_site",
)

# ---------------------------------------------------------------- sync

cte(
    "diff",
    """SELECT coalesce(p.domain, c.domain) AS domain, coalesce(p.url, c.url) AS url,
  CASE WHEN p.url IS NULL THEN 'new' WHEN c.url IS NULL THEN 'deleted' ELSE 'unchanged' END AS status
FROM (SELECT DISTINCT domain, url FROM prev_map) p
FULL OUTER JOIN (SELECT DISTINCT domain, url FROM cur_map) c ON p.domain = c.domain AND p.url = c.url""",
    "prev_map",
    "cur_map",
)
cte(
    "health",
    f"""SELECT domain, n_cached, n_new, n_deleted, deleted_ratio,
  reason IN ('', 'first_run') AS trusted, reason
FROM (SELECT *, CASE WHEN n_cached = 0 THEN 'first_run' WHEN n_new = 0 THEN 'empty_map'
                     WHEN deleted_ratio >= {SY.MAX_DELETION_RATIO} THEN 'mass_deletion' ELSE '' END AS reason
  FROM (SELECT *, round(CASE WHEN n_cached = 0 THEN 0.0 WHEN n_new = 0 THEN 1.0
                             ELSE n_deleted::DOUBLE / n_cached END, 6) AS deleted_ratio
    FROM (SELECT domain, count(*) FILTER (WHERE status <> 'new') AS n_cached,
                 count(*) FILTER (WHERE status <> 'deleted') AS n_new,
                 count(*) FILTER (WHERE status = 'deleted') AS n_deleted
          FROM diff GROUP BY domain)))""",
    "diff",
)
cte(
    "effective",
    """SELECT d.domain, d.url, CASE WHEN NOT h.trusted AND d.status = 'deleted' THEN 'unchanged' ELSE d.status END AS status,
  h.trusted
FROM diff d JOIN health h ON d.domain = h.domain""",
    "diff",
    "health",
)
cte(
    "counter",
    f"""SELECT domain, url, consecutive_misses, first_missing_at, last_missing_at,
  CASE WHEN _back THEN 'cleared' WHEN consecutive_misses >= {SY.DELETION_MISS_THRESHOLD} THEN 'delete' ELSE 'pending' END AS action
FROM (
  SELECT coalesce(b.domain, m.domain) AS domain, coalesce(b.url, m.url) AS url,
    (CASE WHEN m._miss THEN coalesce(b.c_misses, 0) + 1 ELSE b.c_misses END)::INTEGER AS consecutive_misses,
    strftime(CASE WHEN m._miss THEN coalesce(b.c_first, TIMESTAMP '{SN.RUN_TS}') ELSE b.c_first END, '%Y-%m-%d %H:%M:%S') AS first_missing_at,
    strftime(CASE WHEN m._miss THEN TIMESTAMP '{SN.RUN_TS}' ELSE b.c_last END, '%Y-%m-%d %H:%M:%S') AS last_missing_at,
    b._back
  FROM (
    SELECT c.domain, c.url, c.consecutive_misses AS c_misses, c.first_missing_at AS c_first,
           c.last_missing_at AS c_last, k.url IS NOT NULL AS _back
    FROM prev_candidates c LEFT JOIN (SELECT DISTINCT domain, url FROM cur_map) k
      ON c.domain = k.domain AND c.url = k.url
  ) b
  FULL OUTER JOIN (
    SELECT domain, url, true AS _miss FROM (
      SELECT domain, url FROM prev_map UNION SELECT domain, url FROM prev_candidates
    ) kn
    WHERE NOT EXISTS (SELECT 1 FROM cur_map c WHERE c.domain = kn.domain AND c.url = kn.url)
      AND kn.domain IN (SELECT domain FROM health WHERE trusted)
  ) m ON b.domain = m.domain AND b.url = m.url
)""",
    "prev_candidates",
    "prev_map",
    "cur_map",
    "health",
)
# each run against the last trusted one: a walk over the runs of every site
cte(
    "run_steps",
    """SELECT a.domain, a.run_id, a.n_new, b.run_id AS base, b.n_new AS n_cached, coalesce(l.n, 0) AS n_deleted,
  a.nth FROM (SELECT domain, run_id, count(*) FILTER (WHERE present) AS n_new,
                     row_number() OVER (PARTITION BY domain ORDER BY run_id) AS nth FROM run_map GROUP BY domain, run_id) a
JOIN (SELECT domain, run_id, count(*) FILTER (WHERE present) AS n_new FROM run_map GROUP BY domain, run_id) b
  ON a.domain = b.domain AND b.run_id < a.run_id
LEFT JOIN (SELECT x.domain, x.run_id AS base, y.run_id, count(*) AS n FROM run_map x JOIN run_map y
             ON x.domain = y.domain AND x.url = y.url AND x.run_id < y.run_id
           WHERE x.present AND NOT y.present GROUP BY ALL) l
  ON l.domain = a.domain AND l.base = b.run_id AND l.run_id = a.run_id""",
    "run_map",
)
cte(
    "run_walk",
    """SELECT domain, run_id, 1::BIGINT AS nth, run_id AS next_base, 0::BIGINT AS n_cached, n_new, 0::BIGINT AS n_deleted, true AS trusted
FROM (SELECT domain, run_id, count(*) FILTER (WHERE present) AS n_new FROM run_map GROUP BY domain, run_id)
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY run_id) = 1
UNION ALL
SELECT domain, run_id, nth, CASE WHEN ok THEN run_id ELSE base END, n_cached, n_new, n_deleted, ok
FROM (SELECT s.*, s.n_cached = 0 OR (s.n_new > 0 AND 10 * s.n_deleted < 3 * s.n_cached) AS ok
      FROM run_walk w JOIN run_steps s ON s.domain = w.domain AND s.nth = w.nth + 1 AND s.base = w.next_base)""",
    "run_map",
    "run_steps",
)
cte("run_health", "SELECT domain, run_id, n_cached, n_new, n_deleted, trusted FROM run_walk", "run_walk")
cte(
    "miss_history",
    f"""SELECT domain, url, run_id, consecutive_misses, consecutive_misses = {SY.DELETION_MISS_THRESHOLD} AS deleted
FROM (SELECT *, (sum(_inc) OVER (PARTITION BY domain, url, _grp ORDER BY run_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER AS consecutive_misses
  FROM (SELECT r.domain, r.url, r.run_id, r.present,
          (NOT r.present AND h.trusted)::INTEGER AS _inc,
          sum(r.present::INTEGER) OVER (PARTITION BY r.domain, r.url ORDER BY r.run_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _grp
        FROM run_map r JOIN run_health h ON r.domain = h.domain AND r.run_id = h.run_id)
  WHERE _grp > 0)
WHERE consecutive_misses >= 1 AND (consecutive_misses < {SY.DELETION_MISS_THRESHOLD}
  OR (consecutive_misses = {SY.DELETION_MISS_THRESHOLD} AND _inc = 1))""",
    "run_map",
    "run_health",
)
cte(
    "completed_urls",
    """SELECT domain, url, batch_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY ts DESC, batch_id ASC) AS _r
  FROM (SELECT domain, batch_id, ts, unnest(urls) AS url FROM batches WHERE status = 'completed'))
WHERE _r = 1""",
    "batches",
)
cte(
    "cached_pages",
    """SELECT c.domain, c.url, c.batch_id FROM completed_urls c
WHERE EXISTS (SELECT 1 FROM effective e WHERE e.status = 'unchanged' AND e.domain = c.domain AND e.url = c.url)""",
    "completed_urls",
    "effective",
)
cte("legacy", f"SELECT * FROM cached_urls WHERE seq % {Q.LEGACY_MOD} = 0", "cached_urls")
cte(
    "cached_fallback",
    """SELECT domain, url, 'state' AS source FROM cached_pages
UNION ALL
SELECT l.domain, l.url, 'legacy' AS source FROM (SELECT DISTINCT domain, url FROM legacy) l
WHERE EXISTS (SELECT 1 FROM effective e WHERE e.status = 'unchanged' AND e.domain = l.domain AND e.url = l.url)
  AND NOT EXISTS (SELECT 1 FROM cached_pages s WHERE s.domain = l.domain AND s.url = l.url)""",
    "cached_pages",
    "legacy",
    "effective",
)
cte(
    "backfill",
    """SELECT e.domain, e.url FROM effective e WHERE e.status = 'unchanged'
  AND NOT EXISTS (SELECT 1 FROM cached_fallback c WHERE c.domain = e.domain AND c.url = e.url)""",
    "effective",
    "cached_fallback",
)
cte(
    "queue",
    """SELECT domain, url, kind,
  row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN kind = 'new' THEN 0 ELSE 1 END, url)::INTEGER AS queue_pos
FROM (SELECT domain, url, 'new' AS kind FROM effective WHERE status = 'new'
      UNION ALL SELECT domain, url, 'backfill' AS kind FROM backfill)""",
    "effective",
    "backfill",
)
cte(
    "pending_batches",
    f"""SELECT g.domain, g.chunk, g.batch_id, g.n_urls,
  CASE WHEN coalesce(f._done, false) THEN 'reuse' WHEN coalesce(f._poll, false) THEN 'resume' ELSE 'submit' END AS state
FROM (SELECT domain, chunk, {D.batch_id_agg('url')} AS batch_id, count(*)::BIGINT AS n_urls
      FROM (SELECT *, ((queue_pos - 1) // {Q.QUEUE_CHUNK})::INTEGER AS chunk FROM queue) GROUP BY domain, chunk) g
LEFT JOIN (SELECT domain, batch_id, bool_or(status = 'completed') AS _done, bool_or(status = 'polling') AS _poll
           FROM (SELECT domain, batch_id, status FROM batches
                 UNION ALL
                 SELECT domain, {D.batch_id_agg('url')}, CASE (chunk + length(domain)) % 3 WHEN 0 THEN 'completed' ELSE 'polling' END
                 FROM (SELECT *, ((queue_pos - 1) // {Q.QUEUE_CHUNK})::INTEGER AS chunk FROM queue)
                 WHERE (chunk + length(domain)) % 3 < 2 GROUP BY domain, chunk)
           GROUP BY domain, batch_id) f
  ON g.domain = f.domain AND g.batch_id = f.batch_id""",
    "queue",
    "batches",
)

# previous documents: rendered cached pages, every 13th edited
cte(
    "prev_docs",
    f"""SELECT domain, slug, url, seq, body, content, sha256(content) AS content_sha FROM (
  SELECT domain, slug, url, seq,
    CASE WHEN seq % {spec.edited_mod} = 0 THEN body || 'x' ELSE body END AS body,
    CASE WHEN seq % {spec.edited_mod} = 0 THEN content || 'x' ELSE content END AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY domain, slug ORDER BY seq DESC, url DESC) AS _r
        FROM rd WHERE seq IN (SELECT seq FROM cached_urls))
  WHERE _r = 1)""",
    "rd",
    "cached_urls",
)
cte(
    "content_diff",
    """SELECT c.domain, c.slug, c.url,
  CASE WHEN p.content_sha IS NULL THEN 'added' WHEN p.content_sha = c.content_sha THEN 'unchanged' ELSE 'updated' END AS status
FROM docs c LEFT JOIN prev_docs p ON c.domain = p.domain AND c.slug = p.slug""",
    "docs",
    "prev_docs",
)
cte(
    "sync_report",
    """SELECT domain, count(*) FILTER (WHERE status = 'added') AS added,
  count(*) FILTER (WHERE status = 'updated') AS updated,
  count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) AS total
FROM content_diff GROUP BY domain""",
    "content_diff",
)

# ---------------------------------------------------------------- sites


def _category_values(categories) -> str:
    rows = []
    for i, c in enumerate(categories):
        for kw in c.keywords:
            rows.append(f"({i}, {L(c.name)}, {L(kw)}, {c.min_hits}, {L(c.expansion)})")
    return "VALUES " + ", ".join(rows)


cte(
    "hp",
    f"""SELECT domain, arg_min(url, seq) AS url, min(seq) AS seq FROM (
  SELECT domain, coalesce(nullif(sourceURL, ''), nullif(ogUrl, '')) AS url, seq FROM pt)
WHERE {D.is_homepage('url', 'domain')} GROUP BY domain""",
    "pt",
)
cte(
    "expansions",
    f"""SELECT domain, category, n_keywords, cat_rank, expansion FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cat_order)::INTEGER AS cat_rank FROM (
    SELECT p.domain, k.cat_order, k.category, k.expansion, k.min_hits, count(DISTINCT k.keyword) AS n_keywords
    FROM (SELECT domain, lower(coalesce(m_title, j_title, '') || ' ' || coalesce(j_summary, '')) AS text FROM pt) p
    JOIN ({_category_values(V.FIXTURE_CATEGORIES)}) k(cat_order, category, keyword, min_hits, expansion)
      ON contains(p.text, k.keyword)
    GROUP BY p.domain, k.cat_order, k.category, k.expansion, k.min_hits)
  WHERE n_keywords >= min_hits)
WHERE cat_rank <= {V.MAX_CATEGORIES}""",
    "pt",
)


def _rules_sql(rules) -> tuple[str, str]:
    aggs = ", ".join(
        f"bool_or({' OR '.join(f'contains(t, {L(x)})' for x in r.terms)}) AS r{i}" for i, r in enumerate(rules)
    )
    t3 = "coalesce(" + ", ".join(f"CASE WHEN r{i} THEN {L(r.description)} END" for i, r in enumerate(rules)) + ", NULL)"
    return aggs, t3


_aggs, _t3 = _rules_sql(V.FIXTURE_DESCRIPTION_RULES)
_jd = D.strip("coalesce(p.j_description, '')")
_js = D.strip("coalesce(p.j_summary, '')")
_md = D.strip("coalesce(p.m_description, '')")
_og = D.strip("coalesce(p.m_og_description, '')")
cte(
    "site_description",
    f"""SELECT s.domain,
  coalesce(h.t2a, h.t2b, h.t2c, h.t2d, r.t3, 'a website at ' || s.domain) AS description,
  CASE WHEN h.t2a IS NOT NULL THEN 'homepage_description' WHEN h.t2b IS NOT NULL THEN 'homepage_summary'
       WHEN h.t2c IS NOT NULL THEN 'meta_description' WHEN h.t2d IS NOT NULL THEN 'og_description'
       WHEN r.t3 IS NOT NULL THEN 'title_rules' ELSE 'generic' END AS tier
FROM (SELECT DISTINCT domain FROM pt) s
LEFT JOIN (SELECT hp.domain,
    CASE WHEN length({_jd}) > {V.HOMEPAGE_MIN_DESCRIPTION} THEN {_jd} END AS t2a,
    CASE WHEN length({_js}) > {V.HOMEPAGE_MIN_SUMMARY} THEN {D.condense_summary(_js)} END AS t2b,
    CASE WHEN length({_md}) > {V.HOMEPAGE_MIN_DESCRIPTION} THEN {_md} END AS t2c,
    CASE WHEN length({_og}) > {V.HOMEPAGE_MIN_DESCRIPTION} THEN {_og} END AS t2d
  FROM hp JOIN pt p ON hp.domain = p.domain AND hp.seq = p.seq) h ON s.domain = h.domain
LEFT JOIN (SELECT domain, {_t3} AS t3 FROM (
    SELECT domain, {_aggs} FROM (
      SELECT domain, lower(coalesce(j_title, m_title, '')) AS t FROM pt)
    GROUP BY domain)) r ON s.domain = r.domain""",
    "pt",
    "hp",
)

# ---------------------------------------------------------------- search


def m(col: str, pattern: str) -> str:
    return f"regexp_matches(lower({col}), {L(pattern.lower())})"


def _tier_sql(pattern: str) -> str:
    return (
        f"CASE WHEN {m('title', pattern)} OR {m('summary', pattern)} THEN 'strong' "
        f"WHEN {m('description', pattern)} OR {m('url', pattern)} OR {m('slug', pattern)} THEN 'moderate' "
        f"WHEN {m('body', pattern)} THEN 'weak' END"
    )


def _matched_terms_sql(pattern: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {m('content', t)} THEN 1 ELSE 0 END)" for t in QS.terms_of(pattern)) + ")::INTEGER"


cte(
    "ranked",
    f"""SELECT * FROM (SELECT domain, slug, url, title, {_tier_sql(Q.SEARCH_PATTERN)} AS tier,
  {_matched_terms_sql(Q.SEARCH_PATTERN)} AS matched_terms FROM docs) WHERE tier IN ('strong', 'moderate')""",
    "docs",
)
cte(
    "top",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY
  CASE WHEN tier = 'strong' THEN 1 WHEN tier = 'moderate' THEN 2 ELSE 3 END, matched_terms DESC, url, slug)::INTEGER AS rank
  FROM ranked) WHERE rank <= {Q.TOP_N}""",
    "ranked",
)


def _topics_values(topics) -> str:
    return "VALUES " + ", ".join(f"({i}, {L(n)}, {L(p.lower())})" for i, (n, p) in enumerate(topics))


cte(
    "topic_hits",
    f"""SELECT t.topic, d.* FROM docs d JOIN ({_topics_values(V.FIXTURE_TOPICS)}) t(i, topic, pat)
  ON regexp_matches(lower(d.content), t.pat)""",
    "docs",
)


def _topic_tier() -> str:
    return "CASE " + " ".join(
        f"WHEN topic = {L(n)} THEN {_tier_sql(p)}" for n, p in V.FIXTURE_TOPICS
    ) + " END"


def _families_values(fams) -> str:
    return "VALUES " + ", ".join(f"({L(n)}, {L(p.lower())})" for n, p in fams)


cte(
    "pmatch",
    f"""SELECT domain, slug, family, phrase, count(*) AS n FROM (
  SELECT d.domain, d.slug, f.family, unnest(regexp_extract_all(lower(d.content), f.pat, 0)) AS phrase
  FROM docs d, ({_families_values(V.FIXTURE_PATTERN_FAMILIES)}) f(family, pat))
GROUP BY domain, slug, family, phrase""",
    "docs",
)


def _category_case() -> str:
    seg = "split_part(slug, '--', 1)"
    parts = ["CASE WHEN slug = 'index' THEN 'homepage'"]
    for name, keys in QS.PAGE_TYPES:
        parts.append(f"WHEN {seg} IN ({', '.join(L(k) for k in keys)}) THEN {L(name)}")
    parts.append(f"WHEN {seg} = '' THEN 'other' ELSE {seg} END")
    return " ".join(parts)


cte("categorized", f"SELECT domain, slug, url, seq, {_category_case()} AS category FROM docs", "docs")

# ---------------------------------------------------------------- queries

SQL: dict[str, str] = {}

SQL["url_inventory"] = build("SELECT * FROM inv", "inv")
SQL["url_inventory_by_domain"] = build(
    f"""SELECT site, count(*) AS n_refs, count(*) FILTER (WHERE error IS NOT NULL) AS n_invalid,
  count(DISTINCT nurl) AS n_distinct, count(*) FILTER (WHERE domain <> site) AS n_offsite_refs,
  count(*) FILTER (WHERE NOT {D.is_content_url('nurl')}) AS n_asset_refs
FROM refs GROUP BY site""",
    "refs",
)
SQL["slug_collisions"] = build(
    """SELECT i.domain, i.slug, i.url, g.n_urls FROM inv i
JOIN (SELECT domain, slug, count(*) AS n_urls FROM inv GROUP BY domain, slug HAVING count(*) > 1) g
  ON i.domain = g.domain AND i.slug = g.slug""",
    "inv",
)
SQL["discover_urls"] = build("SELECT * FROM disc", "disc")
SQL["discovery_scope"] = build(
    f"""SELECT g.site, g.n_same_site_refs, g.n_offsite_refs, g.n_asset_refs, g.n_with_query,
  coalesce(k.n_distinct, 0) AS n_distinct, coalesce(k.n_distinct, 0)::BIGINT AS n_kept
FROM (SELECT site, count(*) FILTER (WHERE _same) AS n_same_site_refs, count(*) FILTER (WHERE NOT _same) AS n_offsite_refs,
        count(*) FILTER (WHERE _same AND NOT _content) AS n_asset_refs,
        count(*) FILTER (WHERE _same AND nurl <> {D.drop_query('nurl')}) AS n_with_query
      FROM (SELECT *, domain = site AS _same, {D.is_content_url('nurl')} AS _content FROM refs WHERE error IS NULL)
      GROUP BY site) g
LEFT JOIN (SELECT site, count(DISTINCT {D.drop_query('nurl')}) AS n_distinct FROM refs
           WHERE error IS NULL AND domain = site AND {D.is_content_url('nurl')} GROUP BY site) k ON g.site = k.site""",
    "refs",
)
SQL["batch_ids"] = build(
    f"""SELECT domain, chunk, count(*) AS n_urls, {D.batch_id_agg('url')} AS batch_id FROM (
  SELECT domain, url, ((row_number() OVER (PARTITION BY domain ORDER BY url) - 1) // {SY.BATCH_SIZE})::INTEGER AS chunk FROM disc)
GROUP BY domain, chunk""",
    "disc",
)
SQL["page_metadata"] = build(
    f"""SELECT domain, url, seq, nullif(title, '') AS title, nullif(description, '') AS description,
  nullif(og_description, '') AS og_description, nullif(og_url, '') AS og_url, nullif(lang, '') AS lang, nullif(h1, '') AS h1
FROM (SELECT domain, url, seq, {D.field('html', P.TITLE)} AS title,
  {D.meta_value('html', 'name', 'description')} AS description,
  {D.meta_value('html', 'property', 'og:description')} AS og_description,
  {D.meta_value('html', 'property', 'og:url')} AS og_url,
  {D.page_lang('html')} AS lang, {D.field('html', P.H1)} AS h1 FROM kp)""",
    "kp",
)
SQL["extract_markdown"] = build(
    f"""SELECT domain, url, seq, {D.pieces_markdown('got')} AS markdown, ({D.count_links('got')})::INTEGER AS n_links,
  ({D.count_headings('got')})::INTEGER AS n_headings FROM md0""",
    "md0",
)
SQL["main_text"] = build("SELECT domain, url, seq, text, length(text)::BIGINT AS n_chars FROM mt", "mt")
SQL["page_links"] = build("SELECT * FROM links", "links")
cte(
    "kw_tf",
    f"""SELECT domain, url, seq, term, count(*) AS tf FROM (
  SELECT domain, url, seq, unnest(string_split_regex(lower(text), {L(P.TOKEN_SPLIT)})) AS term FROM mt)
WHERE length(term) >= 1 GROUP BY domain, url, seq, term""",
    "mt",
)
SQL["keyword_summary"] = build(
    f"""SELECT l.domain, l.url, l.seq, coalesce(k.keywords, '') AS keywords, coalesce(k.keyword_tf, 0)::BIGINT AS keyword_tf, l.lead
FROM (SELECT domain, url, seq, nullif({D.lead_sentences('text', 1)}, '') AS lead FROM mt) l
LEFT JOIN (
  SELECT domain, url, seq, string_agg(term, ' ' ORDER BY r) AS keywords, sum(tf)::BIGINT AS keyword_tf FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.domain, t.url, t.seq ORDER BY t.tf DESC, d.df ASC, t.term ASC) AS r
    FROM kw_tf t JOIN (SELECT term, count(*) AS df FROM kw_tf GROUP BY term) d ON t.term = d.term)
  WHERE r <= 8 GROUP BY domain, url, seq) k
ON l.domain = k.domain AND l.url = k.url AND l.seq = k.seq""",
    "mt",
    "kw_tf",
)
SQL["page_docs"] = build(
    """SELECT domain, slug, url, seq, title, description, summary, body, content_sha, length(content)::BIGINT AS n_chars
FROM docs""",
    "docs",
)
SQL["sync_docs"] = SQL["cache_only_docs"] = SQL["doc_upsert_stream"] = SQL["page_docs"]
SQL["sync_run_log"] = build(
    f"""SELECT r.run_id::INTEGER AS run_id, '{SN.RUN_TS}' AS run_ts, m.domain, CASE WHEN coalesce(d.n, 0) = 0 THEN 'error_no_pages' ELSE 'ok' END AS status,
  true AS trusted, CASE WHEN r.run_id = 0 THEN 'first_run' ELSE 'cache_only' END AS reason, m.n AS urls_discovered,
  CASE WHEN r.run_id = 0 THEN m.n ELSE 0 END AS new_urls, CASE WHEN r.run_id = 0 THEN m.n ELSE 0 END AS queued,
  CASE WHEN r.run_id = 0 THEN m.n ELSE 0 END AS fetched, 0::BIGINT AS deleted,
  CASE WHEN r.run_id = 0 THEN coalesce(d.n, 0) ELSE 0 END AS added, 0::BIGINT AS updated,
  CASE WHEN r.run_id = 1 THEN coalesce(d.n, 0) ELSE 0 END AS unchanged, coalesce(d.n, 0) AS total,
  CASE WHEN r.run_id = 0 THEN 1 + 5 * m.n ELSE 0 END::BIGINT AS credits
FROM (SELECT domain, count(DISTINCT url) AS n FROM kp GROUP BY domain) m
LEFT JOIN (SELECT domain, count(*) AS n FROM docs GROUP BY domain) d ON d.domain = m.domain, range(0, 2) r(run_id)""",
    "kp",
    "docs",
)
SQL["artifact_lines_by_domain"] = build(
    f"""SELECT domain, count(*) AS n_pages, sum(len(string_split(md, chr(10))))::BIGINT AS n_lines,
  sum({D.artifact_line_count('md')})::BIGINT AS n_artifact_lines
FROM (SELECT domain, {D.br_to_newline('markdown')} AS md FROM pt) GROUP BY domain""",
    "pt",
)
_hdr = D.rx("content", r"(?s)\A---\n(.*?)\n---\n")


def _pfield(name: str) -> str:
    raw = D.rx("_hdr", r"(?m)^" + name + r": \"(.*)\"$")
    return f"replace(replace({raw}, '\\\"', '\"'), '\\\\', '\\')"


SQL["parse_page_docs"] = build(
    f"""SELECT domain, slug, {_pfield('title')} AS title, {_pfield('description')} AS description, {_pfield('url')} AS url,
  {D.strip(D.rr(D.rx('_hdr', r'(?s)\nsummary: \|\n(.*)\z'), r'[ \n]+', ' '))} AS summary,
  sha256({D.rx('content', r'(?s)\A---\n.*?\n---\n\n(.*)\z')}) AS body_sha
FROM (SELECT *, {_hdr} AS _hdr FROM docs)""",
    "docs",
)
SQL["homepage"] = build("SELECT domain, url, seq FROM hp", "hp")
SQL["map_diff"] = build("SELECT * FROM diff", "diff")
SQL["map_health"] = build("SELECT * FROM health", "health")
SQL["effective_map"] = build("SELECT * FROM effective", "effective")
SQL["miss_counter"] = build("SELECT * FROM counter", "counter")
SQL["miss_history"] = build("SELECT * FROM miss_history", "miss_history")
# ST2 (keyed streaming state) must produce exactly the window form
SQL["miss_counter_stream"] = SQL["miss_history"]
SQL["cached_pages"] = build("SELECT * FROM cached_pages", "cached_pages")
SQL["cached_pages_fallback"] = build("SELECT * FROM cached_fallback", "cached_fallback")
SQL["backfill_urls"] = build("SELECT * FROM backfill", "backfill")
SQL["fetch_queue"] = build("SELECT * FROM queue", "queue")
SQL["pending_batches"] = build("SELECT * FROM pending_batches", "pending_batches")
SQL["content_diff"] = build("SELECT * FROM content_diff", "content_diff")
SQL["delete_pages"] = build(
    """SELECT d.domain, d.slug, d.url FROM docs d
WHERE NOT EXISTS (SELECT 1 FROM counter c WHERE c.action = 'delete' AND c.domain = d.domain AND c.url = d.url)""",
    "docs",
    "counter",
)
SQL["sync_report"] = build("SELECT * FROM sync_report", "sync_report")
SQL["cost_estimate"] = build(
    f"""SELECT n.domain, n.n_queue, n.n_queue > {Q.MAX_PAGES} AS capped,
  (CASE WHEN n.n_queue > {Q.MAX_PAGES} THEN {Q.MAX_PAGES} ELSE n.n_queue END)::BIGINT AS scrape_count,
  ({STS.COST_MAP} + {STS.COST_PER_PAGE} * CASE WHEN n.n_queue > {Q.MAX_PAGES} THEN {Q.MAX_PAGES} ELSE n.n_queue END)::BIGINT AS est_credits,
  CASE WHEN k.domain IS NOT NULL THEN 'update' ELSE 'create' END AS action
FROM (SELECT domain, count(*) AS n_queue FROM queue GROUP BY domain) n
LEFT JOIN (SELECT DISTINCT domain FROM prev_docs) k ON n.domain = k.domain""",
    "queue",
    "prev_docs",
)
SQL["run_cost"] = build(
    f"""SELECT s.domain, coalesce(f.n, 0)::BIGINT AS n_fetched,
  (CASE WHEN coalesce(f.n, 0) = 0 THEN {STS.COST_MAP} ELSE {STS.COST_MAP} + {STS.COST_PER_PAGE} * f.n END)::BIGINT AS credits
FROM (SELECT DISTINCT domain FROM cur_map) s LEFT JOIN (SELECT domain, count(*) AS n FROM queue GROUP BY domain) f
  ON s.domain = f.domain""",
    "cur_map",
    "queue",
)
SQL["dry_run_preview"] = build(
    f"""SELECT domain, total, new, unchanged, deleted, backfill, pages_to_scrape,
  pages_to_scrape > {Q.MAX_PAGES} AS capped,
  (CASE WHEN pages_to_scrape > {Q.MAX_PAGES} THEN {Q.MAX_PAGES} ELSE pages_to_scrape END)::BIGINT AS scrape_count,
  ({STS.COST_MAP} + {STS.COST_PER_PAGE} * CASE WHEN pages_to_scrape > {Q.MAX_PAGES} THEN {Q.MAX_PAGES} ELSE pages_to_scrape END)::BIGINT AS est_credits,
  (CASE WHEN pages_to_scrape > {Q.MAX_PAGES} THEN {Q.MAX_PAGES} ELSE pages_to_scrape END) = 0 AND deleted = 0 AS up_to_date
FROM (SELECT e.*, coalesce(b.n, 0)::BIGINT AS backfill, (e.new + coalesce(b.n, 0))::BIGINT AS pages_to_scrape
  FROM (SELECT domain, count(*) FILTER (WHERE status <> 'deleted') AS total, count(*) FILTER (WHERE status = 'new') AS new,
               count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'deleted') AS deleted
        FROM effective GROUP BY domain) e
  LEFT JOIN (SELECT domain, count(*) AS n FROM backfill GROUP BY domain) b ON e.domain = b.domain)""",
    "effective",
    "backfill",
)
SQL["site_expansions"] = build("SELECT * FROM expansions", "expansions")
SQL["site_description"] = build("SELECT * FROM site_description", "site_description")
SQL["asset_filter_report"] = build(
    f"""SELECT domain, count(*) AS n_urls, count(*) FILTER (WHERE NOT is_content) AS n_removed FROM (
  SELECT DISTINCT site AS domain, nurl AS url, {D.is_content_url('nurl')} AS is_content
  FROM refs WHERE error IS NULL AND domain = site) GROUP BY domain""",
    "refs",
)
SQL["pending_deletions"] = build(
    """SELECT domain, count(*) AS n_pending, array_to_string(list(url ORDER BY url) FILTER (WHERE _r <= 5), ' ') AS first_pending
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url) AS _r FROM counter WHERE action = 'pending')
GROUP BY domain""",
    "counter",
)
SQL["batch_status"] = build(
    f"""SELECT domain, status, error, count(*) AS n_batches, sum(n_urls)::BIGINT AS n_urls, sum(credits)::BIGINT AS credits_used FROM (
  SELECT domain, status, n_urls, CASE WHEN status <> 'failed' THEN '' WHEN length(domain) % 3 = 0 THEN 'batch_failed'
         WHEN length(domain) % 3 = 1 THEN 'poll_timeout' ELSE 'message' END AS error, CASE WHEN status = 'completed' THEN 5 * n_urls ELSE 0 END AS credits
  FROM batches
  UNION ALL
  SELECT domain, 'polling', count(*), '', 0 FROM (SELECT *, (queue_pos - 1) // {Q.QUEUE_CHUNK} AS chunk FROM queue)
  WHERE (chunk + length(domain)) % 3 = 1 GROUP BY domain, chunk) GROUP BY ALL""",
    "batches",
    "queue",
)
SQL["site_manifest"] = build(
    f"""SELECT d.domain, {D.site_name('d.domain')} AS site_name, d.description, coalesce(r.total, 0)::BIGINT AS page_count,
  coalesce(e.expansions, '') AS expansions, coalesce(e.expansion_lines, '') AS expansion_lines
FROM site_description d
LEFT JOIN sync_report r ON d.domain = r.domain
LEFT JOIN (SELECT domain, string_agg(category, '; ' ORDER BY cat_rank) AS expansions,
                  string_agg('- **' || category || '**: `' || expansion || '`', chr(10) ORDER BY cat_rank) AS expansion_lines
           FROM expansions GROUP BY domain) e
  ON d.domain = e.domain""",
    "site_description",
    "sync_report",
    "expansions",
)
SQL["map_scan"] = build("SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY seq) AS seq FROM site_pages", "site_pages")
SQL["state_cached"] = build(
    """SELECT b.domain, b.url, b.batch_id, pt.m_title AS title, sha256(pt.markdown) AS markdown_sha
FROM (SELECT domain, batch_id, unnest(urls) AS url FROM batches WHERE status = 'completed') b JOIN pt ON pt.domain = b.domain AND pt.url = b.url""",
    "batches",
    "pt",
)
SQL["sync_map"] = build(
    """SELECT domain, url, seq FROM cur_map WHERE domain IN (SELECT domain FROM health WHERE trusted)
UNION ALL SELECT domain, url, seq FROM prev_map WHERE domain NOT IN (SELECT domain FROM health WHERE trusted)""",
    "cur_map",
    "prev_map",
    "health",
)
SQL["sync_guard_log"] = probes.probed_sql(build(
    f"""SELECT 0 AS run_id, '{SN.RUN_TS}' AS run_ts, m.domain,
  CASE WHEN m.n = 0 THEN 'error_empty_map' WHEN coalesce(d.n, 0) = 0 THEN 'error_no_pages' ELSE 'ok' END AS status,
  m.n > 0 AS trusted, CASE WHEN m.n = 0 THEN 'empty_map' ELSE 'first_run' END AS reason, m.n AS urls_discovered, m.n AS new_urls, m.n AS queued,
  m.n AS fetched, 0::BIGINT AS deleted, coalesce(d.n, 0) AS added, 0::BIGINT AS updated, 0::BIGINT AS unchanged, coalesce(d.n, 0) AS total,
  (1 + 5 * m.n)::BIGINT AS credits
FROM (SELECT domain, count(DISTINCT url) AS n FROM kp WHERE domain IS NOT NULL GROUP BY domain UNION ALL SELECT 'nomap.example.com', 0) m
LEFT JOIN (SELECT domain, count(*) AS n FROM docs GROUP BY domain) d ON d.domain = m.domain""",
    "kp",
    "docs",
))
SQL["search_any"] = build(f"SELECT domain, slug, url FROM docs WHERE {m('content', Q.SEARCH_PATTERN)}", "docs")
SQL["search_narrow"] = build(
    f"SELECT domain, slug, url FROM docs WHERE {m('content', Q.NARROW[0])} AND {m('content', Q.NARROW[1])}", "docs"
)
SQL["match_lines"] = build(
    f"""SELECT domain, slug, line_no, line FROM (
  SELECT domain, slug, (i)::INTEGER AS line_no, ls[i] AS line
  FROM (SELECT domain, slug, string_split(content, chr(10)) AS ls FROM docs), range(1, len(ls) + 1) t(i))
WHERE {m('line', Q.LINE_PATTERN)}""",
    "docs",
)
SQL["preview"] = build(
    f"""SELECT domain, slug, array_to_string(list_slice(string_split(content, chr(10)), 1, {QS.PREVIEW_LINES}), chr(10)) AS preview
FROM docs WHERE {m('content', Q.PREVIEW_PATTERN)}""",
    "docs",
)
SQL["list_titles"] = build("SELECT domain, slug, title FROM docs", "docs")
SQL["list_slugs"] = build("SELECT domain, slug FROM docs", "docs")
SQL["rank_tiers"] = build("SELECT * FROM ranked", "ranked")
SQL["top_pages"] = build("SELECT * FROM top", "top")
_own_tier = "CASE " + " ".join(f"WHEN e.category = {L(c.name)} THEN {_tier_sql(c.expansion)}" for c in V.FIXTURE_CATEGORIES) + " END"
SQL["search_by_topic"] = build(
    f"""SELECT topic, domain, slug, url, tier FROM (SELECT *, {_topic_tier()} AS tier FROM topic_hits) WHERE tier IS NOT NULL
UNION ALL
SELECT topic, domain, slug, url, tier FROM (
  SELECT e.category AS topic, d.domain, d.slug, d.url, {_own_tier} AS tier
  FROM docs d JOIN expansions e ON d.domain = e.domain AND regexp_matches(lower(d.content), lower(e.expansion))) WHERE tier IS NOT NULL""",
    "topic_hits",
    "expansions",
)
SQL["load_bands"] = build(
    """SELECT domain, n_candidates, n_strong, CASE WHEN n_candidates <= 3 THEN 'quick' WHEN n_candidates <= 7 THEN 'moderate' ELSE 'deep' END AS band,
  least(n_candidates, 5)::BIGINT AS n_first
FROM (SELECT domain, count(*) AS n_candidates, count(*) FILTER (WHERE tier = 'strong') AS n_strong FROM ranked GROUP BY domain)""",
    "ranked",
)
SQL["too_many_results"] = build(
    f"""SELECT g.topic, g.domain, coalesce(h.n, 0)::BIGINT AS n_hits,
  CASE WHEN coalesce(h.n, 0) >= {QS.TOO_MANY} THEN 'narrow' WHEN coalesce(h.n, 0) = 0 THEN 'broaden' ELSE 'ok' END AS advice
FROM (SELECT d.domain, t.topic FROM (SELECT DISTINCT domain FROM docs) d, ({_topics_values(V.FIXTURE_TOPICS)}) t(i, topic, pat)) g
LEFT JOIN (SELECT topic, domain, count(*) AS n FROM topic_hits GROUP BY topic, domain) h
  ON g.topic = h.topic AND g.domain = h.domain""",
    "docs",
    "topic_hits",
)
SQL["citations"] = build("SELECT domain, slug, '- [' || title || '](' || url || ')' AS citation FROM top", "top")
_link_md = QS.LINK_MD
SQL["markdown_links"] = build(
    f"""SELECT domain, url, seq, (i - 1)::INTEGER AS pos, t[i] AS text, h[i] AS href FROM (
  SELECT domain, url, seq, regexp_extract_all(md, {L(_link_md)}, 1) AS t, regexp_extract_all(md, {L(_link_md)}, 2) AS h
  FROM (SELECT domain, url, seq, {D.rr(D.rr('html', P.ANCHORS[0], r'[\2](\1)'), P.ANCHORS[1], r'[\2](\1)')} AS md FROM kp)), range(1, len(t) + 1) r(i)""",
    "kp",
)
SQL["pattern_matches"] = build("SELECT * FROM pmatch", "pmatch")
SQL["categorize_pages"] = build("SELECT * FROM categorized", "categorized")
SQL["sample_per_category"] = build(
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, category ORDER BY seq, slug)::INTEGER AS sample_rank
  FROM categorized) WHERE sample_rank <= {QS.SAMPLES_PER_CATEGORY}""",
    "categorized",
)
SQL["synthesize_top"] = build(
    """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY n_pages DESC, n_occurrences DESC, phrase ASC)::INTEGER AS rank
  FROM (SELECT family, phrase, sum(n)::BIGINT AS n_occurrences, count(*) AS n_pages, count(DISTINCT domain) AS n_sites
        FROM pmatch GROUP BY family, phrase))
WHERE rank <= 10""",
    "pmatch",
)


# documents as pages
cte(
    "dp",
    """SELECT source AS domain, 'doc:' || CAST(doc_id AS VARCHAR) AS url, doc_id AS seq, CAST(doc_id AS VARCHAR) AS slug,
  split_part(text, chr(10), 1) AS title, '' AS description, '' AS summary, text AS body, text AS content
FROM documents""",
)
cte(
    "dkw_tf",
    f"""SELECT domain, url, seq, term, count(*) AS tf FROM (
  SELECT domain, url, seq, unnest(string_split_regex(lower(body), {L(P.TOKEN_SPLIT)})) AS term FROM dp)
WHERE length(term) >= 1 GROUP BY domain, url, seq, term""",
    "dp",
)
SQL["document_keywords"] = build(
    f"""SELECT l.domain, l.url, l.seq, coalesce(k.keywords, '') AS keywords, coalesce(k.keyword_tf, 0)::BIGINT AS keyword_tf, l.lead
FROM (SELECT domain, url, seq, nullif({D.lead_sentences('body', 1)}, '') AS lead FROM dp) l
LEFT JOIN (
  SELECT domain, url, seq, string_agg(term, ' ' ORDER BY r) AS keywords, sum(tf)::BIGINT AS keyword_tf FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.domain, t.url, t.seq ORDER BY t.tf DESC, d.df ASC, t.term ASC) AS r
    FROM dkw_tf t JOIN (SELECT term, count(*) AS df FROM dkw_tf GROUP BY term) d ON t.term = d.term)
  WHERE r <= 8 GROUP BY domain, url, seq) k
ON l.domain = k.domain AND l.url = k.url AND l.seq = k.seq""",
    "dp",
    "dkw_tf",
)
SQL["document_patterns"] = build(
    f"""SELECT domain, slug, family, phrase, count(*) AS n FROM (
  SELECT d.domain, d.slug, f.family, unnest(regexp_extract_all(lower(d.content), f.pat, 0)) AS phrase
  FROM dp d, ({_families_values(V.FIXTURE_PATTERN_FAMILIES)}) f(family, pat))
GROUP BY domain, slug, family, phrase""",
    "dp",
)
SQL["document_topics"] = build(
    f"""SELECT g.topic, g.domain, coalesce(h.n, 0)::BIGINT AS n_hits,
  CASE WHEN coalesce(h.n, 0) >= {QS.TOO_MANY} THEN 'narrow' WHEN coalesce(h.n, 0) = 0 THEN 'broaden' ELSE 'ok' END AS advice
FROM (SELECT d.domain, t.topic FROM (SELECT DISTINCT domain FROM dp) d, ({_topics_values(V.FIXTURE_TOPICS)}) t(i, topic, pat)) g
LEFT JOIN (SELECT t.topic, d.domain, count(*) AS n FROM dp d JOIN ({_topics_values(V.FIXTURE_TOPICS)}) t(i, topic, pat)
           ON regexp_matches(lower(d.content), t.pat) GROUP BY t.topic, d.domain) h
  ON g.topic = h.topic AND g.domain = h.domain""",
    "dp",
)


SQL |= {f"{name}_indexed": SQL[name] for name in ("search_any", "search_narrow", "rank_tiers")}
SQL |= {f"{name}_probed": probes.probed_sql(SQL[name]) for name in Q.PROBED}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
