"""Independent SQL for every query that SQL can express, in its most direct form.

The statements join and count naively (OR joins, range joins, correlated lookups) and so check the
rewrites in the library. They run on the generic test tables in DuckDB.
"""

from oracles import costs, health, jobs, tags


def all_sql() -> dict[str, str]:
    return {**jobs.SQL, **costs.SQL, **health.SQL, **tags.SQL}
