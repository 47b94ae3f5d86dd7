"""All registered queries and, where there is one, the SQL that checks them."""

from __future__ import annotations

from caseflow.plans import modelled, oracle_sql, relational  # noqa: F401  (importing registers the queries)


def queries() -> dict[str, relational.Query]:
    return dict(relational.REGISTRY)


def oracles() -> dict[str, str]:
    return {name: oracle_sql.statement(name) for name in queries() if name in oracle_sql.QUERIES}
