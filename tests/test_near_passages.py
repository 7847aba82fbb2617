from siltstone.plans import reference as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_every_excerpt_has_its_nearest_sentence(spark, monkeypatch):
    sentences = {1: ["The board met in May", "No risk was found", "Suppliers were trained"], 2: ["A b c d", "Something else entirely"]}
    excerpts = [(1, 0, "The board met in May"), (1, 1, "risk was"), (1, 2, "zzzz qqqq"), (1, 3, "Suppliers are trainer"), (2, 0, "Some thing other"), (2, 1, "x")]
    e = spark.createDataFrame(excerpts, "doc_id long, part int, excerpt string")
    s = spark.createDataFrame([(d, i, t) for d, ts in sentences.items() for i, t in enumerate(ts)], "doc_id long, idx int, sentence string")
    monkeypatch.setattr(R, "_excerpts", lambda *_: (e, s))
    truth = set()
    for d, part, x in excerpts:
        ts = sentences[d]
        if x in ts:
            best = (ts.index(x), 1.0)
        elif any(x in t for t in ts):
            best = (next(i for i, t in enumerate(ts) if x in t), 0.999)
        else:
            scores = [1 - distance(x, t) / max(len(x), len(t)) for t in ts]
            best = (scores.index(max(scores)), round(max(scores), 6))
        truth.add((d, part, *best))
    got = R.passage_match_near(spark, "").select("doc_id", "part", "matched_idx", "score").collect()
    assert {tuple(r) for r in got} == truth
    assert len(got) == len(excerpts)
