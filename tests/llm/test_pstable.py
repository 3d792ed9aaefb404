import math

import numpy as np
import pytest

from lodestar.llm import pstable


def _brute(rows, cosine=0.93):
    def fine(v, label):
        return label is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    ids = [r[0] for r in rows]
    n, comp = dict.fromkeys(ids, 0), {i: i for i in ids}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, lab in rows if fine(v, lab)}
    label = {i: lab for i, _, lab in rows}
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in ids:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (n[i], comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(150):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.3])
        rows.append((3 * i, [float(np.float32(x)) for x in v], int(rng.integers(2)) if i % 11 else None))
    rows += [(1000 + i, rows[1][1], rows[1][2]) for i in range(40)]  # one common vector
    rows += [(2000, [2 * x for x in rows[1][1]], rows[1][2]), (2001, None, 1), (2002, [], 1), (2003, [0.0] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, [float("nan")] * 16, 1), (2006, [float("inf")] * 16, 1), (2007, rows[1][1][:8], 1)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pstable.near_duplicates(frame, block=block).collect()}
    assert got == _brute(rows)


def test_repeats_null_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (5, [1.0, 0.01], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in pstable.near_duplicates(frame).collect())
    assert got == [(-1, 0, -1, True), (1, 1, 1, True), (1, 1, 1, True), (5, 1, 1, False)]
    assert pstable.near_duplicates(frame.limit(0)).count() == 0
