"""The registered cycles against a plain search of the same network."""

from collections import Counter, defaultdict

from quillgraph.plans import catalog
from quillgraph.plans.domain import Domain

SF = "/root/testdata/sf0.001"


def test_g05_cycles_of_every_length(spark):
    orders = defaultdict(list)
    for r in Domain(spark, SF).assignees().collect():
        orders[r.doc_id].append((r.pos, r.name))
    n = defaultdict(Counter)
    for names in orders.values():
        first = min(names)[1]
        n[first].update(x for _, x in names if x != first)
    after = {a: [b for _, b in sorted((-k, b) for b, k in c.items())[:2]] for a, c in n.items()}
    want = set()

    def go(path):
        for b in after.get(path[-1], []):
            if b == path[0]:
                want.add((">".join(path), len(path)))
            elif b > path[0] and b not in path:
                go([*path, b])

    for a in after:
        go([a])
    got = [(r.nodes, r.length) for r in catalog.queries()["g05_cycles"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert max(k for _, k in want) > 3
