import hashlib
import math
import random

import numpy as np
import pytest
from test_vector_codes import as_floats

from emberscope.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, inertia string"


def brute(data, k=8, rounds=10):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in data
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    own = [list(v) for _, v in order[:k]]
    for step in range(rounds + 1):
        now = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(own)) for _, v in rows]
        for j in range(len(own) if step < rounds else 0):
            mine = [v for (_, v), (_, at) in zip(rows, now) if at == j]
            if mine:
                own[j] = [sum(c) // len(mine) for c in zip(*mine)]
    whole = sum(d for d, _ in now)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in own]
    out = [(i, j, d, sum(x for x, y in now if y == j), whole, digests[j]) for (i, _), (d, j) in zip(rows, now)]
    return sorted(out, key=str)


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in data], SCHEMA)


def awkward(seed=2):
    rng = random.Random(seed)
    data = [(i, as_floats(rng.gauss(0, 10 ** rng.randrange(-2, 2)) for _ in range(64))) for i in range(120)]
    data += [(200 + i, data[i % 2][1]) for i in range(50)]
    data += [(3, data[4][1]), (None, data[6][1]), (300, None), (301, [None] * 64), (302, [math.nan] * 64), (303, [math.inf] * 64)]
    data += [(304, [1.0] * 63), (305, [1.0] * 65), (306, []), (307, [0.0] * 64), (308, [-1e-6] * 64), (309, [100.0] * 64)]
    return data


def test_equals_integers_one_by_one(spark):
    data = awkward()
    got = centroids.clusters(frame(spark, data).repartition(5)).drop("centroid").collect()
    assert sorted(map(tuple, got), key=str) == brute(data)


def test_few_rows_and_none(spark):
    assert centroids.clusters(frame(spark, [])).collect() == []
    assert centroids.clusters(frame(spark, [(1, None), (2, [0.5] * 3)])).collect() == []
    few = awkward()[:3] + awkward()[:1]
    assert sorted(map(tuple, centroids.clusters(frame(spark, few)).drop("centroid").collect()), key=str) == brute(few)


def test_planes_give_exact_products():
    rng = np.random.default_rng(5)
    for top in (1, 2, 1000, (1 << 27) - 1):
        values, own = rng.integers(-top, top, (40, 64)), rng.integers(-top, top, (5, 64))
        planes = centroids.planes_of(values)
        assert (centroids.values_of(planes) == values).all()
        assert (centroids.dots(planes, centroids.planes_of(own)) == own @ values.T).all()
    for same in (np.zeros((2, 64), np.int64), np.full((2, 64), -1)):
        assert (centroids.values_of(centroids.planes_of(same)) == same).all()


def test_too_large_components_end_with_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(frame(spark, [(1, [1e9] * 64)])).collect()
