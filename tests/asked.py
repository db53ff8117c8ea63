"""A search service of our own for tests: rows by date, query and page, narrowed by a request, which it logs."""

import os

ROWS = [
    {"keys": [f"2024-01-{1 + i % 9:02}", f"q{i % 4}", f"https://a.example/{'shop' if i % 3 else 'Blog'}/{i % 5}"], "clicks": i % 7, "impressions": 10 + i, "ctr": 0.1, "position": 1 + i % 3}
    for i in range(60)
]


def search(first, limit, start, end, filters):
    if log := os.environ.get("ASKED_LOG"):
        with open(log, "a") as f:
            f.write(f"{first} {limit} {start} {end} {filters}\n")
    rows = [r for r in ROWS if (start is None or r["keys"][0] >= str(start)) and (end is None or r["keys"][0] <= str(end))]
    for field, kind, value in filters:
        held = lambda r, k=kind, v=value: r["keys"][2] == v if k == "equals" else v.lower() in r["keys"][2].lower()
        rows = [r for r in rows if held(r)]
    return rows[first : first + limit]
