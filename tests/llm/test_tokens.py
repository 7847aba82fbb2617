import os
import random

import pytest

from siltstone.llm import tokens as K
from siltstone.llm.packing import fill, fill_containers, hilbert_key, packed_stream
from siltstone.llm.pieces import Tally, Tree, bodies, cut_texts, overlapped, pieces

PATH = K.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

ODD = ["", " ", "a", "  two  blanks ", "it's 'sit we'll", "x" * 5000, "日本語の文章。次の文！", "ภาษาไทยไม่มีช่องว่าง", "<|endoftext|>", "a b　c", "tab\tnl\n\n\nend  ", "½5²³ 1.5", "é̂" * 50, "🙂👍🏽" * 40, "word " * 4000]


def texts(n=150, seed=3):
    r = random.Random(seed)
    words = ["the", "plan", "it's", "review;", "日本", "ขั้น", "3.14", "“said”", "\n", "  ", "Größe", "—", "end.", "Acme's", " "]
    base = [" ".join(r.choices(words, k=r.randrange(1, 300))) for _ in range(n)]
    return base + [b[: len(b) // 2] + "!" + b[len(b) // 2 :] for b in base[:40]] + ODD


def test_ids_equal_those_of_whole_texts():
    e, plain = K.ChunkEncoder(PATH), K.encoding(PATH).encode_ordinary
    for t in texts():
        assert list(e.encode(t)) == plain(t)
    assert e.hits > 0


def test_ids_with_a_small_memo():
    e, plain = K.ChunkEncoder(PATH, keep=3), K.encoding(PATH).encode_ordinary
    assert all(list(e.encode(t)) == plain(t) for t in texts(40))


def test_chunks_follow_content():
    a = "".join(random.Random(1).choices("abcdefgh ", k=4000))
    cuts = {a[i:j] for i, j in zip([0, *K.chunk_ends(a)], K.chunk_ends(a), strict=False)}
    b = "shifted " + a
    again = {b[i:j] for i, j in zip([0, *K.chunk_ends(b)], K.chunk_ends(b), strict=False)}
    assert len(cuts & again) > len(cuts) / 2


def test_encode_corpus_cases(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, "", "z"), (3, None, "z"), (None, "c", "z")]
    got = sorted((str(r["id"]), list(r["ids"])) for r in K.encode_corpus(spark.createDataFrame(rows, "id int, text string, ids string"), "id", "text").collect())
    plain = K.encoding(PATH).encode_ordinary
    assert got == sorted([("1", plain("a b")), ("1", plain("a b")), ("2", []), ("3", []), ("None", plain("c"))])
    assert K.encode_corpus(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_hilbert_neighbours_touch():
    import numpy as np

    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_fill_is_whole_and_tight():
    r = random.Random(2)
    sizes = [r.randrange(0, 100) for _ in range(2000)]
    packed = fill(sizes, 100)
    assert sorted(i for c in packed for i in c) == list(range(2000))
    assert all(sum(sizes[i] for i in c) <= 100 for c in packed)
    assert len(packed) <= 1.02 * sum(sizes) / 100 + 1
    stream = list(packed_stream(((s, i) for i, s in enumerate(sizes)), 100, window=128))
    assert sorted(w for c in stream for _, w in c) == list(range(2000))
    assert all(sum(s for s, _ in c) <= 100 for c in stream)


def test_containers(spark):
    plain = K.encoding(PATH).encode_ordinary
    ts = [t for t in texts(60) if len(plain(t)) < 20_000]
    rows = [(i, t, "x") for i, t in enumerate([*ts, None, ts[0]])] + [(0, ts[0], "y"), (None, "null key", "z")]
    df = spark.createDataFrame(rows, "id int, text string, container string")
    got = fill_containers(df, "id", "text", 200).collect()
    per, size = {}, {}
    for r in got:
        per[r["container"]] = per.get(r["container"], 0) + r["n_tokens"]
        size.setdefault(r["id"], []).append((r["first_token"], r["n_tokens"]))
    assert max(per.values()) <= 200
    for i, t in enumerate(ts[1:], 1):
        n = len(plain(t))
        assert sorted(size[i]) == [(a, min(200, n - a)) for a in range(0, max(n, 1), 200)]
    assert sum(n for _, n in size[0]) == 2 * len(plain(ts[0]))
    assert size[len(ts)] == [(0, 0)]
    assert None in size
    assert fill_containers(spark.createDataFrame([], "id int, text string"), "id", "text", 10).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        fill_containers(df, "id", "text", 0)


def count(s):
    return len(K.encoder(PATH).encode(s))


@pytest.mark.parametrize("limit", [8, 40, 200])
def test_bodies_cover_and_fit(limit):
    for t in texts(40):
        spans = bodies(t, limit, lambda a, b, t=t: count(t[a:b]))
        assert "".join(t[a:b] for a, b in spans) == t
        assert all(count(t[a:b]) <= limit or len(t[a:b]) <= 16 for a, b in spans)


def test_tally_is_exact_at_safe_places():
    e = K.encoder(PATH)
    for t in texts(40):
        tally = Tally(t, K.PartCounter(e, keep=50))
        assert tally.of(0, len(t)) == count(t)
        k = tally.places
        for i, j in [(0, len(k) // 2), (len(k) // 3, len(k) - 1)]:
            assert tally.of(k[i], k[j]) == count(t[k[i] : k[j]])


def test_pieces_prefer_outer_boundaries():
    t = "Heading one\n\n" + "One sentence of text here. " * 6 + "\n\nHeading two\n\n" + "Another sentence of text. " * 6
    spans = bodies(t, 60, lambda a, b: count(t[a:b]))
    assert any(t[a:].startswith("Heading two") for a, _ in spans)


@pytest.mark.parametrize(("limit", "overlap"), [(50, 10), (64, 0), (20, 8)])
def test_pieces(limit, overlap):
    e = K.encoder(PATH)
    for t in [" ".join(f"Sentence number {i} is here." for i in range(200)), *texts(30)]:
        if not t:
            continue
        got = pieces(t, limit, overlap, count, K.PartCounter(e))
        assert got[0][1] == 0
        assert got[-1][2] == len(t)
        assert all(x[2] == y[1] for x, y in zip(got, got[1:], strict=False))
        for start, a, b, n in got:
            assert start <= a < b
            assert n == count(t[start:b])
            assert n <= limit or b - a <= 16
            assert count(t[start:a]) <= overlap
    t = " ".join(f"Sentence number {i} is here." for i in range(200))
    if overlap:
        assert all(overlap // 2 <= count(t[s:a]) for s, a, *_ in pieces(t, limit, overlap, count, K.PartCounter(e))[1:])
    assert overlapped(t, [(0, 9)], limit, overlap, count) == [(0, 0, 9, count(t[:9]))]


def test_cut_texts_cases(spark):
    long_ = "para one. " * 300
    rows = [(1, long_, "a"), (2, "short", "b"), (3, None, "c"), (4, "", "d"), (None, "n", "e"), (2, "short", "f")]
    got = cut_texts(spark.createDataFrame(rows, "id int, text string, piece_no string"), "id", "text", 64, 8).collect()
    assert sum(r["id"] == 2 for r in got) == 2
    assert not any(r["id"] in (3, 4) for r in got)
    assert any(r["id"] is None for r in got)
    mine = sorted((r["piece_no"], r["body_char"], r["end_char"], r["n_tokens"]) for r in got if r["id"] == 1)
    assert mine[0][1] == 0
    assert mine[-1][2] == len(long_)
    assert all(x[2] == y[1] for x, y in zip(mine, mine[1:], strict=False))
    assert max(m[3] for m in mine) <= 64
    with pytest.raises(ValueError, match="overlap"):
        cut_texts(spark.createDataFrame(rows, "id int, text string, piece_no string"), "id", "text", 8, 8)


NESTED = "# A\ntext one here\n## B\n" + "word " * 30 + "\n### C\nmore text in c\n## B2\nlast b\n# D\nend of it\n- item\n  - sub a\n  - sub b\n- item two\n"


def test_sections_nest_and_siblings_merge():
    n = lambda a, b: len(NESTED[a:b].split())
    got = [NESTED[a:b] for a, b in bodies(NESTED, 60, n)]
    assert [x[:3] for x in got] == ["# A", "# D"]
    got = [NESTED[a:b] for a, b in bodies(NESTED, 40, n)]
    # B with its C is a subtree of its own: it is entered alone, and what it is cut into is merged with nothing beside it.
    assert [x.split("\n")[0] for x in got] == ["# A", "## B", "## B2", "# D"]
    got = [NESTED[a:b] for a, b in bodies(NESTED, 12, n)]
    assert "- item\n  - sub a\n  - sub b\n- item two\n" in got
    assert all(not x.strip().startswith("#") or "\n" in x.strip() for x in got)


def test_ranks_of_headings():
    t = Tree("1. Intro\n\nText.\n\n1.1 Sub\n\nText\n\nPlain Title\n\nmore text.\n### C\n<h2>D</h2>")
    assert [r for _, r in t.headings] == [1, 2, 7, 7, 3, 2]


def test_overlap_of_long_words():
    word = "x" * 70
    text = "\n\n".join(" ".join([word] * 12) for _ in range(12))
    count = lambda s: len(s.split())
    spans = bodies(text, 12, lambda a, b: count(text[a:b]))
    got = overlapped(text, spans, 24, 8, count)
    assert all(count(text[s:b]) == 8 for s, b, *_ in got[1:])


def test_headings_in_a_row_and_before_lists():
    n = lambda t: lambda a, b: len(t[a:b].split())
    for t in ("# A\n# B\n# C\n" + "word " * 20, "# A\n## B\n### C\n" + "word " * 20, "Title\n\n- a b c d\n- e f g h\n- i j k l", "Title\n\nOther Title\n\nThird\n\n" + "word " * 9, "# A\n\n# A\n\n# A", "1. a b c\n1.1 d e f\n1.1.1 g h i"):
        for limit in (1, 2, 3, 5, 8):
            got = bodies(t, limit, n(t))
            assert "".join(t[a:b] for a, b in got) == t
            assert all(n(t)(a, b) <= limit or not t[a:b].strip(" \n").count(" ") for a, b in got)


def test_chunks_have_a_largest_size():
    for t in ("a" * 50_000, "ab " * 20_000, "x" * 4200, "x" * 8193):
        ends = K.chunk_ends(t)
        assert ends[-1] == len(t)
        assert all(b - a <= 4096 + 48 for a, b in zip([0, *ends], ends, strict=False))
        e = K.ChunkEncoder(K.vocabulary_path(), held=5000)
        assert list(e.encode(t)) == K.encoding(K.vocabulary_path()).encode_ordinary(t)
