"""The cover tree's tables and meetings against all pairs, however deep the tree has to go."""

from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import cover_tree as C


def brute(rows):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    unit = [np.asarray(r[1], float) / np.linalg.norm(np.asarray(r[1], float)) if o else None for r, o in zip(rows, ok)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= C.THRESHOLD:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return sorted((r[0], links[i], min(least[top(i)]), r[0] == min(least[top(i)])) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(3), []
    centres = rng.normal(size=(6, 8))
    for k in range(500):  # clusters of very different widths
        spread = (0.02, 0.05, 0.1, 0.3)[k % 4]
        out.append((k, [float(v) for v in (centres[k % 6] + spread * rng.normal(size=8)).astype(np.float32)], int(k % 2)))
    out += [(k, [float(v) * (k - 490) for v in range(1, 9)], 0) for k in range(500, 560)]  # one direction, no ball tells them apart
    out += [(k, out[0][1], 0) for k in range(560, 575)]  # equal vectors
    out += [(575, None, 0), (576, [0.0] * 8, 0), (577, [1.0, None, 1.0], 0), (578, [1.0, float("nan")], 1), (579, out[3][1], None), (580, [1.0, 2.0], 0), (581, [1.0, 2.0], 0)]
    return out


@pytest.mark.parametrize("block", [8192, 40, 12])
def test_links_and_components(spark, rows, block, monkeypatch):
    monkeypatch.setattr(C, "PIVOTS", 16 if block == 12 else 64)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, size int")
    got = C.near_duplicates(df, block=block)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == brute(rows)


def test_single_points_are_children_without_a_search(monkeypatch):
    monkeypatch.setattr(C, "TRIED", 4)
    x = np.random.default_rng(5).normal(size=(300, 16))
    x[150:] = x[:150] + 0.02 * x[150:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one = np.ones(300, np.int64)
    tree = C.CoverTree(x)
    met = C.Meeting(tree, tree, one, one)
    assert (met.links[0] == ((x @ x.T >= C.THRESHOLD).sum(axis=1) - 1)).all()
