"""Identity clusters against all pairs of accounts."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from matchloom.operators.identity import clusters, components
from matchloom.plans.identity import accounts
from matchloom.plans import registry


def need(n):
    return n if n <= 15 else max(7 if n <= 100 else 50, n // 2, int(n * 0.99))


def by_pairs(rows):
    games, names = defaultdict(dict), {}
    for account, game, place, name in rows:
        if account is not None and game is not None:
            old = games[account].get(game)
            games[account][game] = place if old is None else min(old, place)
            names[account] = name
    links, apart = defaultdict(set), []
    for a, b in combinations(sorted(games), 2):
        x, y = games[a], games[b]
        n, shared = max(len(x), len(y)), x.keys() & y.keys()
        if abs(len(x) - len(y)) <= (2 if n <= 20 else max(10, int(n * 0.05))) and len(shared) >= need(n):
            if names[a] == names[b] and all(x[g] == y[g] for g in shared):
                links[a].add(b)
                links[b].add(a)
            else:
                apart.append((a, b))
    out, root = {}, {}
    for a in sorted(games):
        if a not in root:
            todo = [a]
            while todo:
                c = todo.pop()
                if c not in root:
                    root[c] = a
                    todo += links[c]
    groups = defaultdict(list)
    for a, r in root.items():
        groups[r].append(a)
    for r, members in groups.items():
        broken = any(root[a] == root[b] for a, b in apart if root[a] == r)
        most = max(len(games[a]) for a in members)
        best = sorted(a for a in members if len(games[a]) == most)
        tied = any(games[a] != games[best[0]] for a in best)
        owner = None if broken or tied else best[0]
        for a in members:
            out[a] = (owner, "conflict" if broken else "tied" if tied else "alone" if len(members) == 1 else "canonical" if a == owner else "alias")
    return out


def found(df):
    return {r.account: (r.owner, r.status) for r in df.collect()}


def test_identity_clusters_equal_all_pairs(spark, sf):
    rows = [tuple(r) for r in accounts(spark, sf).collect()]
    got, wanted = found(registry.queries()["identity_clusters"](spark, sf)), by_pairs(rows)
    assert got == wanted
    kinds = {(a[0], s) for a, (_, s) in got.items()}
    assert {("q", "alias"), ("t", "alias"), ("p", "canonical"), ("p", "alone"), ("s", "alone"), ("u", "alone"), ("r", "alone")} <= kinds


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_games_long_lists_and_contradictions(spark, tmp_path, seed):
    """Games that all accounts share, copies in number, chains of near copies, clashes inside a component, ties, nulls and repeats."""
    rnd = random.Random(seed)
    rows = []
    for p in range(40):
        base = rnd.sample(range(100, 3000), rnd.choice([3, 10, 15, 30, 160])) + list(range(8))
        for k in range(rnd.choice([1, 1, 2, 3, 5])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                own[rnd.randrange(len(own))] = 5000 + rnd.randrange(5)
            shift = {rnd.choice(own)} if rnd.random() < 0.2 else set()
            rows += [(f"{p:02d}-{k}", g, g % 7 + (g in shift), f"name {p if rnd.random() < 0.999 else 0}") for g in set(own)]
    names = {a: n for a, _, _, n in rows}
    rows = [(a, g, q, names[a]) for a, g, q, _ in rows]
    rows += [("copy%03d" % i, g, 1, "copies") for i in range(60) for g in range(8)] + [(None, 1, 1, "x"), ("99", None, 1, "x"), rows[0]]
    df = spark.createDataFrame(rows, "account string, game long, place long, name string").repartition(5)
    got, wanted = found(clusters(df, f"file://{tmp_path}/a")), by_pairs(rows)
    assert got == wanted and {s for _, s in got.values()} >= {"alone", "alias", "canonical"}
    assert clusters(df.where("false"), f"file://{tmp_path}/b").count() == 0


def test_components_of_a_chain(spark, tmp_path):
    nodes = list(range(60))
    random.Random(3).shuffle(nodes)
    links = spark.createDataFrame([*zip(nodes, nodes[1:]), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links, f"file://{tmp_path}").collect()}
    assert got == {n: 0 for n in nodes} | {100: 100, 101: 100}
