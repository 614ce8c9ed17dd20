"""Vector codes against SQL and a plain loop, and the trees against all distances."""

import hashlib
import math

import duckdb
import numpy as np

from matchloom.llm.metrictree import Tree
from matchloom.llm.vectorcodes import OP11_SQL, compressed, op11_vector_codes


def by_loops(rows):
    """rows: (vec_id, label, vector), those that can be coded, in order."""
    q = np.array([[math.floor(256 * x) for x in v] for _, _, v in rows], np.int64).reshape(len(rows), 16, -1)
    books = q[:64].copy().transpose(1, 0, 2)
    pick = lambda p: ((q[:, p, None] - books[p][None]) ** 2).sum(-1)
    for _ in range(2):
        new = books.copy()
        for p in range(16):
            near = pick(p).argmin(1)
            for e in set(near.tolist()):
                new[p, e] = q[near == e, p].sum(0) // (near == e).sum()
        books = new
    d = np.stack([pick(p) for p in range(16)], 1)
    error = d.min(2).sum(1)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    labels = [label for _, label, _ in rows]
    return [(r[0], bytes(d[i].argmin(1).astype(np.uint8)).hex(), int(error[i]), int(sum(e for e, x in zip(error, labels) if x == r[1])), digest) for i, r in enumerate(rows)]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, op11_vector_codes(spark, sf).collect())) == sorted(con.execute(OP11_SQL).fetchall())


def test_odd_rows_equal_loops(spark):
    """Null, non-finite, short, uneven and repeated vectors, null ids and labels, large components, clashing and dotted names."""
    rng = np.random.default_rng(4)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(size=32)]
    rows = [(i, None if i % 7 == 0 else i % 3, vector()) for i in range(150)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(40)] + [(300, 2, [1000.0] * 31 + [-1000.0]), (None, None, vector())]
    odd = [(-1, 1, None), (-2, 1, [*vector()[:31], None]), (-3, 1, [float("nan")] * 32), (-4, None, [float("inf"), *vector()[:31]]), (-5, 1, []), (-6, 1, vector()[:31]), (310, 1, vector()[:16])]
    ddl = "vec_id long, label int, embedding array<float>, `a.b` int, code string, label_error string"
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows + odd], ddl).repartition(5)
    got = sorted(map(tuple, compressed(frame).collect()), key=key)
    assert got == sorted(by_loops(rows), key=key)
    twice = sorted(map(tuple, compressed(frame.union(frame)).collect()), key=key)
    assert len(twice) == 2 * len(got) and twice[0] == twice[1]
    assert compressed(frame.where("false")).count() == 0 and compressed(spark.createDataFrame(odd[:6], ddl.split(", `")[0])).count() == 0
    assert [r[1] for r in by_loops(rows[:3])] == [r.code for r in sorted(compressed(frame.where("vec_id in (0, 1, 2)")).collect())]


def test_trees_equal_all_distances():
    rng = np.random.default_rng(7)
    for n, d, spread in ((1, 4, 100), (30, 2, 3), (700, 4, 60), (3000, 4, 500), (2000, 1, 4), (900, 3, 1 << 26)):
        points = rng.integers(-spread, spread, size=(n, d))
        points[n // 2 :][: n // 4] = points[0]
        book = np.concatenate([points[rng.integers(0, n, size=20)], points[:2], rng.integers(-spread, spread, size=(5, d))])
        tree = Tree.unpacked(Tree(points, leaf=8).packed())
        dist = ((points[:, None] - book[None]) ** 2).sum(-1)
        entry, error = tree.nearest(book)
        assert (entry == dist.argmin(1)).all() and (error == dist.min(1)).all()
        sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        tree.add_to(book, sums, counts)
        for e in range(len(book)):
            assert counts[e] == (entry == e).sum() and (sums[e] == points[entry == e].sum(0)).all()


def test_balls_are_owned_as_a_whole():
    """Well-parted clouds are taken over by cached sums; few points are looked at."""
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    points = np.concatenate([c + rng.integers(-50, 50, size=(500, 2)) for c in centres])
    ball, own, rest, _ = Tree(points).owners(centres)
    assert len(rest) == 0 and sorted(set(own)) == [0, 1, 2, 3] and len(ball) < 40
