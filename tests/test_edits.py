import random

import numpy as np

from siltstone.functions.edits import Texts, distances, nearest, single
from siltstone.operators.match import matched

from .test_near_passages import distance


def some_texts(seed, n, lengths):
    r = random.Random(seed)
    return ["".join(r.choices("abcd é日𝄞", k=r.choice(lengths))) for _ in range(n)]


def test_distances_and_nearest_equal_brute_force():
    x = some_texts(1, 60, [0, 1, 5, 63, 64, 65, 127, 128, 129, 200, 300])
    y = some_texts(2, 40, [0, 1, 5, 63, 64, 65, 127, 128, 150, 260]) + [t[:2] + t[3:] + "z" for t in x[:10]]
    i, j = np.repeat(np.arange(60), 50), np.tile(np.arange(50), 60)
    a, b = Texts(x), Texts(y)
    truth = np.array([distance(x[p], y[q]) for p, q in zip(i, j, strict=True)])
    assert (distances(a, i, b, j) == truth).all()
    assert [single(a.of(p), b.of(q)) for p, q in zip(i[:900], j[:900], strict=True)] == truth[:900].tolist()
    ratio = (truth / np.maximum(np.maximum(a.size[i], b.size[j]), 1)).reshape(60, 50)
    for most in (1, 120, 1 << 18):
        which, d = nearest(a, b, np.zeros(60, np.int64), np.full(60, 50), most)
        assert (which == ratio.argmin(axis=1)).all()
        assert (d == truth.reshape(60, 50)[np.arange(60), which]).all()


def test_many_far_excerpts_of_one_text_are_compared_without_cells(spark):
    r = random.Random(3)
    long = lambda: "".join(r.choices("abcdefghij", k=300))
    s = spark.createDataFrame([(1, k, long()) for k in range(150)], "id long, idx int, sentence string")
    e = spark.createDataFrame([(1, k, long()) for k in range(150)], "id long, part int, excerpt string")
    # One cell at a time, as levenshtein() goes, these are 2,000 million cells; far excerpts leave no bound to stop at.
    m = matched(e, s, "id")
    assert "levenshtein" not in m._jdf.queryExecution().toString()
    assert m.where("stage = 'near'").count() == 150
