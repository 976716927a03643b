import math

import numpy as np

from paperloom.llm import embed_dedup as ed

from .test_simhash import components


def brute(rows, least=0.98):
    fine = [(i, l, np.array(x, float)) for i, x, l in rows if i is not None and l is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links, edges = {i: 0 for i, *_ in rows}, []
    for a in range(len(fine)):
        for b in range(a):
            (i, l, x), (j, m, y) = fine[a], fine[b]
            if l == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    top = components(edges)
    return {i: (links[i], top.get(i, i)) for i in links}


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, point int, x double")
    out = ed.near_duplicates(df).collect()
    assert len(out) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for label in range(3):
        for _ in range(60):
            centre = rng.normal(size=48)
            for _ in range(int(rng.integers(1, 9))):
                x = (centre + rng.normal(size=48) * rng.uniform(0, 0.17)).astype(np.float32)
                rows.append((k, [float(v) for v in x], label))
                k += 1
    rows += [(k + j, [float(v) for v in np.array(rows[j][1]) * 4], rows[j][2]) for j in range(20)]
    rows += [(k + 100 + j, rows[0][1], 0) for j in range(40)]
    rows = [(i, [float(np.float32(v)) for v in x], l) for i, x, l in rows]
    a, b = got(spark, rows), brute(rows)
    found, wanted = sum(n for n, _ in a.values()), sum(n for n, _ in b.values())
    assert 0.995 * wanted <= found <= wanted and wanted > 500
    assert sum(a[i][1] == b[i][1] for i in a) >= 0.995 * len(a)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [float("nan"), 1.0, 1.0], 0), (6, [float("inf"), 1.0, 1.0], 0),
        (7, one, 0), (8, one, None), (9, one, 1), (10, one, 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [-1.0, -2.0, -3.0], 0),
        (14, [1e30, 2e30, 3e30], 0),
    ]
    a = got(spark, rows)
    assert a == brute(rows)
    assert a[7] == (3, 7) and a[14] == (3, 7) and a[8] == (0, 8) and a[9] == (0, 9)
    assert got(spark, []) == {}


def test_rows_of_one_id_and_null_ids(spark):
    one, near, far = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [3.0, -2.0, 1.0]
    rows = [(1, one, 0), (1, one, 0), (1, far, 0), (2, near, 0), (None, one, 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in ed.near_duplicates(df).collect())
    assert out == [(0, 0, 0, True), (0, 0, 0, True), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_calibration():
    for rows in (10, 10**3, 10**5, 10**7, 10**9):
        depth, n = ed.plan(rows)
        p = ed.collision(0.2, depth)
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(ed.COUNT)) <= 1 - ed.RECALL
        assert rows * ed.collision(math.sqrt(2), depth) <= ed.MEET
    assert ed.plan(10**9)[1] < 10 * ed.plan(10**3)[1]  # lines grow slowly
