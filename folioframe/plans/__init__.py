from . import checks, parts, queries, runs  # noqa: F401
