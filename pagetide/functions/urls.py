"""URL keys (U1-U9) as Spark Column expressions.

All functions take and return ``Column``; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions import patterns as P


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: trims every Unicode whitespace char."""
    return F.btrim(_c(c), F.lit(P.WS_LATIN + P.WS_WIDE))


def _input_host_part(v: Column) -> Column:
    # v.split("//")[-1].split("/")[0]
    return F.substring_index(F.substring_index(v, "//", -1), "/", 1)


def _with_https(v: Column) -> Column:
    return F.when(v.contains("://"), F.regexp_replace(v, P.SCHEME_PREFIX, "https://")).otherwise(
        F.concat(F.lit("https://"), v)
    )


def netloc(url: Column | str) -> Column:
    """Host[:port] of a URL with a scheme; '' when absent."""
    return F.regexp_extract(_c(url), P.NETLOC, 1)


def error_of_stripped(v: Column | str) -> Column:
    """U2 on input already passed through ``py_strip`` (NULL stays NULL)."""
    v = _c(v)
    host = netloc(_with_https(F.regexp_replace(v, P.TRAILING_PUNCT, "")))
    return (
        F.when(v.isNull() | (v == ""), F.lit("empty"))
        .when(_input_host_part(v).contains(" "), F.lit("looks_like_text"))
        .when(host == "", F.lit("no_host"))
        .when(~F.substring_index(host, ":", 1).contains("."), F.lit("no_tld"))
    )


def normalized_of_stripped(v: Column | str) -> Column:
    """U1 on stripped input, without the validity check."""
    n = _with_https(F.regexp_replace(_c(v), P.TRAILING_PUNCT, ""))
    return F.regexp_replace(n, r"(?s)\A(https://[^/?#]*?)\.+([/?#].*)?\z", "$1$2")


def url_error(raw: Column | str) -> Column:
    """NULL when the input is a usable URL, else a reason code.

    Reasons: ``empty``, ``looks_like_text`` (space in the host part),
    ``no_host``, ``no_tld`` (no dot in the host without port).
    """
    return error_of_stripped(py_strip(raw))


def normalize_url(raw: Column | str) -> Column:
    """Trimmed, trailing punctuation removed, https forced, host dot dropped.

    Returns NULL for inputs that ``url_error`` rejects. For wide pipelines
    prefer ``with_url_keys``, which stages the same work.
    """
    return F.when(url_error(raw).isNull(), normalized_of_stripped(py_strip(raw)))


def domain_of_normalized(norm: Column | str) -> Column:
    """U3 on an already normalized URL."""
    host = F.lower(netloc(norm))
    host = F.regexp_replace(host, r"\Awww\.", "")
    host = F.regexp_replace(host, r":.*\z", "")
    return F.regexp_replace(host, r"\.+\z", "")


def url_domain(raw: Column | str) -> Column:
    """Site key — lower-cased host, ``www.``, port and trailing dot stripped.

    NULL for inputs that ``url_error`` rejects. Pass a column (not a large
    expression): the input is referenced several times.
    """
    return domain_of_normalized(normalize_url(raw))


def map_url(domain: Column | str) -> Column:
    return F.concat(F.lit("https://"), _c(domain))


def site_name(domain: Column | str) -> Column:
    """U4: display name; not injective (a.b.com and a-b.com collide)."""
    return F.concat(F.replace(_c(domain), F.lit("."), F.lit("-")), F.lit(P.SITE_NAME_SUFFIX))


def repo_name(domain: Column | str) -> Column:
    return F.concat(F.lit(P.REPO_NAME_PREFIX), site_name(domain))


def url_path(url: Column | str) -> Column:
    """Generic-URL path: no query, fragment, or ``;params`` of the last segment."""
    path = F.regexp_extract(_c(url), P.PATH, 1)
    return F.regexp_replace(path, r";[^/]*\z", "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element transform).

    Keeps expressions that use an intermediate several times from growing
    into duplicated subtrees in generated code.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def url_slug(url: Column | str) -> Column:
    """Page key inside a site (file name in the reference).

    path of the URL without trailing slashes, ``/`` -> ``--``, lower-cased,
    everything outside ``[a-z0-9-]`` dropped; root is ``index``; longer than
    80 chars -> first 80 + ``-`` + 8 hex of sha256(url).
    """
    u = _c(url)
    path = F.regexp_replace(url_path(F.regexp_replace(u, r"/+\z", "")), r"\A/+|/+\z", "")

    def from_path(p: Column) -> Column:
        slug = F.regexp_replace(F.lower(F.replace(p, F.lit("/"), F.lit("--"))), r"[^a-z0-9\-]", "")

        def finish(sl: Column) -> Column:
            long = F.concat(F.substring(sl, 1, P.MAX_SLUG_LEN), F.lit("-"), F.substring(F.sha2(u, 256), 1, P.SLUG_HASH_LEN))
            return F.when(p == "", F.lit("index")).when(F.length(sl) > P.MAX_SLUG_LEN, long).otherwise(sl)

        return _let(slug, finish)

    return _let(path, from_path)


def is_content_url(url: Column | str) -> Column:
    """False for static assets and build artifacts."""
    return ~_c(url).rlike(P.STATIC_ASSET)


def drop_query(url: Column | str) -> Column:
    """U8: URL without query and fragment."""
    return F.regexp_replace(_c(url), r"[?#].*\z", "")


def batch_id_agg(url: Column | str) -> Column:
    """U9 (aggregate): 16 hex of sha256 over the sorted URLs joined by newline."""
    joined = F.array_join(F.array_sort(F.collect_list(_c(url))), "\n")
    return F.substring(F.sha2(joined, 256), 1, P.BATCH_ID_LEN)


def batch_id_of(urls: Column | str) -> Column:
    """U9 (scalar): same hash for an array column of URLs."""
    return F.substring(F.sha2(F.array_join(F.array_sort(_c(urls)), "\n"), 256), 1, P.BATCH_ID_LEN)


def is_homepage(url: Column | str, domain: Column | str) -> Column:
    """URL without trailing slashes is {http,https}://{,www.}domain."""
    u = F.regexp_replace(_c(url), r"/+\z", "")
    d = _c(domain)
    return u.isin(
        F.concat(F.lit("https://"), d),
        F.concat(F.lit("https://www."), d),
        F.concat(F.lit("http://"), d),
        F.concat(F.lit("http://www."), d),
    )


def with_url_keys(df, raw: str, error: str | None = None, nurl: str = "_nurl", domain: str | None = None):
    """Add validity reason, normalized URL and site key of column ``raw``.

    Staged projections: each heavy intermediate is a column referenced
    several times downstream, so Catalyst keeps the stages apart and every
    generated method stays small.
    """
    keep = [c for c in df.columns if c not in {nurl, error, domain}]
    d = df.select(*keep, py_strip(raw).alias("_v"))
    d = d.select(*keep, error_of_stripped("_v").alias("_e"), normalized_of_stripped("_v").alias("_n0"))
    out = [*keep, F.when(F.col("_e").isNull(), F.col("_n0")).alias(nurl)]
    if error:
        out.append(F.col("_e").alias(error))
    d = d.select(*out)
    if domain:
        d = d.select("*", domain_of_normalized(nurl).alias(domain))
    return d
