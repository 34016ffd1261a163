"""Registered queries with the SQL that must give the same rows."""


def all_queries() -> dict:
    from lectern.plans.registered import documents, levels, maintenance, searching

    return {**searching.QUERIES, **levels.QUERIES, **documents.QUERIES, **maintenance.QUERIES}
