"""Small helpers shared by the tests."""

import re


def rows(df):
    """Rows as tuples in a fixed order, nulls last."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def final_plan(df):
    """The executed plan with its subqueries, after adaptive changes and without the plans they replaced."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.match(r"[ :|]*", line).end()
        if skip is not None and depth > skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)
