"""SimHash, vector codes and hard negatives against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import hardneg, simhash, vectorcodes

DOCS = "doc_id bigint, text string, code bigint, node bigint, block string, `rank` string, `group` string"
VECTORS = "vec_id bigint, embedding array<float>, label int, id_ string, vector_ string, error string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, "b", "r", "g") for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, y, "i", "v", "e") for i, x, y in rows], VECTORS)


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, differ):
    """Least id reachable, by search over all pairs."""
    near = {i: [j for j, y in codes.items() if (x ^ y).bit_count() <= differ] for i, x in codes.items()}
    out = {}
    for i in sorted(codes):
        queue = [] if i in out else [i]
        while queue:
            j = queue.pop()
            if j not in out:
                out[j] = i
                queue += near[j]
    return out


def texts(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta Gamma delta épsilon 字 zeta eta theta".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 150))) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(pool).split()
        w[rng.randrange(len(w))] = "changed"
        pool.append(" ".join(w))
    return [None, "", " \t\n", "one", "one two", "one two", "A a a a a a a a a", *pool]


@pytest.mark.parametrize("group_least", [3, 2048])
def test_simhash_equals_brute_force(spark, group_least):
    rows = list(enumerate(texts(5, 60)))
    want = {i: brute_fingerprint(t, 4) for i, t in rows}
    component = brute_components(want, 4)
    got = simhash.simhash_duplicates(docs(spark, rows), group_least=group_least).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{want[i]:016x}", component[i]) for i in want}
    assert want[0] == want[1] == 0 and len(set(component.values())) < len(want) - 20


def test_simhash_odd_rows(spark):
    assert simhash.simhash_duplicates(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (None, None), (3, "a b c d e"), (4, "x y z"), (4, "p q r"), (9, "p q r"), (8, "x y z")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_duplicates(docs(spark, rows)).collect())
    assert got == [(-1, None), (-1, None), (3, 3), (4, 4), (4, 4), (8, 4), (9, 4)]  # rows of one id are one document


def test_a_long_text_is_cut_nowhere(monkeypatch):
    text = " ".join(texts(9, 40)[7:])
    want = brute_fingerprint(text, 4)
    monkeypatch.setattr(simhash, "PIECE", 50)
    monkeypatch.setattr(simhash, "STEP", 3)
    assert simhash.fingerprint(text.encode(), 4) == want
    assert simhash.fingerprint(("x" * 500).encode(), 4) == brute_fingerprint("x" * 500, 4)


def test_a_text_of_megabytes():
    text = b"Some words of a long text " * 300_000
    assert simhash.fingerprint(text, 4) == brute_fingerprint("some words of a long text " * 300_000, 4)


def test_gray_order():
    codes = np.arange(64, dtype=np.uint64)
    in_order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(in_order[1:] ^ in_order[:-1]) == 1).all()
    assert [sum(w for _, w in simhash.segments(k)) for k in range(6)] == [64] * 6


@pytest.mark.parametrize("seed", range(4))
def test_forest_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    codes = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in rng.integers(0, 1 << 63, 12, dtype=np.uint64)] + [rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    want = brute_components({i: int(c) for i, c in enumerate(codes)}, 4)
    one = simhash.Forest(codes, np.zeros(len(codes), dtype=np.int64)).link(np.array([0]), np.array([0]), 4)
    assert one.tolist() == [want[i] for i in range(len(codes))]
    tree = (np.arange(len(codes)) * 3 // len(codes)).astype(np.int64)
    a, b = np.array([0, 1, 2, 0, 0, 1]), np.array([0, 1, 2, 1, 2, 2])
    assert simhash.Forest(codes, tree).link(a, b, 4).tolist() == one.tolist()


def test_a_ball_of_near_codes_is_not_compared_pair_by_pair():
    rng = np.random.default_rng(1)
    flips = np.zeros(20_000, dtype=np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, len(flips)).astype(np.uint64)
    codes = np.unique(flips)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    assert set(simhash.Forest(codes, np.zeros(len(codes), dtype=np.int64)).link(np.array([0]), np.array([0]), 4).tolist()) == {0}


def test_kd_tree_gives_the_lower_index_on_ties():
    rng = np.random.default_rng(3)
    points = rng.integers(-3, 4, (200, 4))
    queries = rng.integers(-4, 5, (9000, 4))
    at, far = vectorcodes.KdTree(points).nearest(queries)
    d = ((queries[:, None, :] - points) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    same = vectorcodes.KdTree(np.ones((40, 2), dtype=np.int64))
    assert same.nearest(np.zeros((3, 2), dtype=np.int64))[0].tolist() == [0, 0, 0]


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((i, [int(np.floor(1024 * float(np.float32(v)))) for v in x], y) for i, x, y in rows if x and all(v is not None and np.isfinite(v) for v in x))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    step = width // parts
    cut = [[r[1][p * step : p * step + step] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [nearest(books[p], c[p])[1] for c in cut]
            new.append([[sum(v) // len(v) for v in zip(*(c[p] for c, o in zip(cut, own, strict=True) if o == e), strict=True)] if e in own else books[p][e] for e in range(len(books[p]))])
        books = new
    out = {r[0]: [nearest(books[p], c[p]) for p in range(parts)] for r, c in zip(kept, cut, strict=True)}
    labels = {r[0]: r[2] for r in kept}
    errors = {i: sum(d for d, _ in v) for i, v in out.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in v), errors[i], sum(e for j, e in errors.items() if labels[j] == labels[i]), digest) for i, v in out.items()}


def some_vectors(seed, n, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, width))
    rows = [(i, [float(v) for v in np.float32(centres[i % 6] + rng.normal(0, 0.05, width))], int(rng.integers(0, 4))) for i in range(n)]
    rows[5] = (5, rows[4][1], None)
    rows[7] = (7, rows[4][1], None)
    return rows


def test_vector_codes_equal_brute_force(spark):
    rows = some_vectors(2, 150)
    odd = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1), (904, [float("inf")] * 8, 1), (905, [1.0] * 4, 1)]
    want = brute_codes(rows + odd, 4, 20, 3)
    got = vectorcodes.compress_vectors(vectors(spark, rows + odd).repartition(5), entries=20, rounds=3).collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == want and len(got) == 150


def test_vector_codes_odd_rows(spark):
    empty = vectorcodes.compress_vectors(vectors(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vectorcodes.compress_vectors(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)])).count() == 0  # cannot be cut into four parts
    few = vectorcodes.compress_vectors(vectors(spark, [(1, [1.0] * 4, 1), (1, [1.0] * 4, 1), (None, [2.0] * 4, None)])).collect()
    assert sorted((r["vec_id"] or -1, r["code"], r["error"]) for r in few) == [(-1, "02020202", 0), (1, "00000000", 0), (1, "00000000", 0)]
    with pytest.raises(Exception, match="a component of"):
        vectorcodes.compress_vectors(vectors(spark, [(1, [1e9] * 4, 1)])).count()


def brute_negatives(rows, every, k, top, limits):
    kept = {}
    for i, x, y in rows:
        if i is not None and y is not None and x and all(v is not None and np.isfinite(v) for v in x):
            value = (y, [int(np.floor(256 * float(np.float32(v)))) for v in x])
            kept[i] = min(value, kept.get(i, value))
    out = []
    for a in (i for i in kept if i % every == 0):
        score = sorted((-sum(p * q for p, q in zip(kept[a][1], v[1], strict=True)), i) for i, v in kept.items() if i != a)
        for s, i in [(s, i) for s, i in score if kept[i][0] == kept[a][0]][:k]:
            near = [(-t, j) for t, j in score if kept[j][0] != kept[a][0] and limits[0] * -s <= 100 * -t <= limits[1] * -s][:top]
            out += [(a, i, n + 1, j, -s, t) for n, (t, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("anchors_held", "block_least"), [(16_384, 8192), (3, 20)])
def test_hard_negatives_equal_brute_force(spark, anchors_held, block_least):
    rows = some_vectors(4, 160)
    rows = [(i, [round(v * 8) / 8 for v in x], y) for i, x, y in rows]  # many ties
    rows += [(20, [0.0] * 8, 3), (30, rows[30][1], rows[30][2]), (None, [1.0] * 8, 1), (910, None, 1), (920, [float("nan")] * 8, 1), (930, [None] * 8, 2)]
    got = hardneg.hard_negatives(vectors(spark, rows).repartition(3), every=10, anchors_held=anchors_held, block_least=block_least)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 10, 5, 10, (30, 90))


def test_hard_negatives_odd_rows(spark):
    assert hardneg.hard_negatives(vectors(spark, [])).count() == 0
    assert hardneg.hard_negatives(vectors(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [-1.0], 2)])).count() == 0
    shifted = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    rows = [(100, [1.0], 2), (98, [1.0], 1), (3, [0.5], 1), (4, [0.5], 1), (5, [0.95], 1)]
    assert [tuple(r) for r in hardneg.hard_negatives(vectors(spark, rows), label=shifted).orderBy("rank").collect()] == [(100, 98, 1, 3, 65536, 32768), (100, 98, 2, 4, 65536, 32768)]


def test_scores_beyond_floating_point_stay_exact():
    a = np.array([[(1 << 26) + 1, 3]], dtype=np.int64)
    assert hardneg.scores(a, a)[0, 0] == ((1 << 26) + 1) ** 2 + 9
    big = np.full((1, 64), 1 << 26, dtype=np.int64)
    big[0, 0] += 1
    assert hardneg.scores(big, big)[0, 0] == sum(int(x) ** 2 for x in big[0])
