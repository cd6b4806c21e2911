"""Multi-operator plans and the registered queries."""

from quiverlake.plans import code, contexts, edits, files, functions, imports, knowledge, retrieval, roundtrips, sessions, statistics, streams  # noqa: F401  they register their queries
