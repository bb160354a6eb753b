"""Per-query sharing of sub-plans.

A query often needs the same sub-plan several times (the page table feeds
the documents, the site descriptions and the expansions). Inside one
``scoped`` query build each ``shared`` sub-plan is constructed once; names
listed in ``materialize`` are written on first use, so their (expensive)
computation runs once for all consumers. A new query call builds afresh.
"""

from __future__ import annotations

from contextvars import ContextVar

from pagetide.session import written

# (shared sub-plans by key, names to materialize) of the query being built;
# a context of its own per thread, so concurrent builds share nothing
_scope: ContextVar[tuple[dict, frozenset] | None] = ContextVar("pagetide_query_scope", default=None)


def shared(fn):
    def wrapper(spark, sf, *args, **kwargs):
        scope = _scope.get()
        if scope is None or args or kwargs:
            return fn(spark, sf, *args, **kwargs)
        memo, materialize = scope
        key = (fn.__module__, fn.__name__, sf)
        if key not in memo:
            df = fn(spark, sf)
            if fn.__name__ in materialize:
                # several consumers in this query: compute once, read back
                # from the shared folder, each the columns that it needs
                df = written(df, fn.__name__)
            memo[key] = df
        return memo[key]

    wrapper.__name__ = fn.__name__
    return wrapper


def scoped(fn, materialize: tuple[str, ...] = ()):
    def run(spark, sf):
        from pagetide.session import checkpoint_dir

        checkpoint_dir(spark)
        if _scope.get() is not None:
            return fn(spark, sf)
        token = _scope.set(({}, frozenset(materialize)))
        try:
            return fn(spark, sf)
        finally:
            _scope.reset(token)

    return run
