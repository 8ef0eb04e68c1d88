"""Annotators: rules by hand, decoding and parsing against brute force, a trained model on unseen texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import annotation, perceptron, syntax

DIR = "/root/testdata/sf0.01"


def annotate(spark, rows, annotator=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, pos string")
    t = (annotator or annotation.RuleAnnotator()).annotate(docs)
    return t.orderBy("doc_id", "sentence_idx", "token_idx")


def test_rules_by_hand(spark):
    t = annotate(spark, [(1, "The old walls were carried to towns. We must not stop", "en", "")])
    got = [(r["text"], r["pos"], r["lemma"], r["dep_head"], r["dep_rel"], r["head_text"]) for r in t.collect()]
    assert got == [
        ("The", "DET", "the", 2, "det", "old"),
        ("old", "NOUN", "old", 3, "compound", "walls"),
        ("walls", "NOUN", "wall", 5, "nsubj", "carried"),
        ("were", "AUX", "be", 5, "aux:pass", "carried"),
        ("carried", "VERB", "carri", 0, "root", None),
        ("to", "ADP", "to", 7, "case", "towns"),
        ("towns", "NOUN", "town", 5, "obj", "carried"),
        ("We", "PRON", "we", 2, "nsubj", "must"),
        ("must", "AUX", "must", 0, "root", None),
        ("not", "PART", "not", 2, "dep", "must"),
        ("stop", "NOUN", "stop", 2, "obj", "must"),
    ]
    assert {r["pattern"] for r in syntax.grammar(t).collect()} == {"passive", "negation", "tense"}


def test_modifiers_brought_along_equal_those_grouped(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 100")
    t = annotation.RuleAnnotator().annotate(docs, ("lang",))
    a, b = syntax.grammar(t, ["complex_np"]), syntax.grammar(t.drop("modifiers"), ["complex_np"])
    assert a.count() == b.count() > 100 and a.exceptAll(b).count() == 0
    few = annotation.RuleAnnotator().annotate(docs, (), ("pos", "token_idx"))
    assert few.columns == ["doc_id", "token_idx", "pos"] and few.count() == t.count()


def test_odd_texts(spark):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, " . !? ", "xx", None), (None, "a", None, None), (4, "ed", "tlh", ""), (5, "word " * 20_000, "de", ""), (4, "ed", "tlh", "")]
    t = annotate(spark, rows).collect()
    assert sorted({(r["doc_id"] or 0) for r in t}) == [0, 4, 5] and len(t) == 1 + 2 + 20_000
    assert annotate(spark, rows[:0]).count() == 0
    assert all(r["dep_head"] == 0 and r["dep_rel"] == "root" for r in t if r["doc_id"] != 5)


def brute_best(scores, moves):
    ways = itertools.product(range(scores.shape[1]), repeat=len(scores))
    return max(sum(scores[i, t] for i, t in enumerate(w)) + moves[-1, w[0]] + sum(moves[a, b] for a, b in itertools.pairwise(w)) for w in ways)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 2, 5, 0])
    begins = np.cumsum(sizes) - sizes
    scores, moves = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(4, 3))
    tags = perceptron.viterbi(scores, begins, sizes, moves)
    for b, n in zip(begins, sizes, strict=True):
        if n:
            own = tags[b : b + n]
            value = sum(scores[b + i, t] for i, t in enumerate(own)) + moves[-1, own[0]] + sum(moves[x, y] for x, y in itertools.pairwise(own))
            assert value == pytest.approx(brute_best(scores[b : b + n], moves))
    assert len(perceptron.viterbi(np.zeros((0, 3)), np.array([0]), np.array([0]), moves)) == 0


def replay(steps, n):
    """Heads that a sequence of actions builds."""
    stack, nxt, heads = [0], 1, [None] * n
    for s2, s1, b1, action in steps:
        assert (s1, s2, b1) == (stack[-1], stack[-2] if len(stack) > 1 else -1, nxt if nxt <= n else -1)
        if action == perceptron.SHIFT:
            stack.append(nxt)
            nxt += 1
        elif action <= perceptron.R:
            heads[s2 - 1] = s1
            del stack[-2]
        else:
            heads[s1 - 1] = s2
            stack.pop()
    return heads


def test_every_tree_has_its_actions():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        order, heads = rng.permutation(n) + 1, [0] * n
        for i in range(1, n):
            heads[order[i] - 1] = int(order[rng.integers(0, i)])
        flat = perceptron.projective(heads)
        assert sorted(flat).count(0) == 1
        steps = perceptron.gold_actions(flat, [0] * n)
        assert replay(steps, n) == flat and len(steps) == 2 * n


def test_a_parser_with_any_weights_gives_trees():
    rng = np.random.default_rng(4)
    sizes = np.array([4, 0, 1, 9, 30])
    begins = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    head, relation = perceptron.parse(rng.integers(0, 12, n), rng.integers(0, 99, n), begins, sizes, rng.normal(size=(1 << perceptron.BITS, perceptron.ACTIONS)))
    for b, k in zip(begins, sizes, strict=True):
        own = head[b : b + k]
        assert (own < 0).sum() == (k > 0) and all(b <= h < b + k for h in own if h >= 0)
        for i in range(b, b + k):
            seen = set()
            while i >= 0:
                assert i not in seen
                seen.add(i)
                i = head[i]
    assert all((relation[i] == annotation.RELATIONS.index("root")) == (head[i] < 0) for i in range(n) if head[i] < 0)


def test_a_trained_model_on_unseen_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 3000")
    seen, unseen = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    rules = annotation.RuleAnnotator()
    model = perceptron.train(perceptron.training_sentences(seen, rules, most=400), rounds=5, parts=2)
    key = ["doc_id", "sentence_idx", "token_idx"]
    gold = rules.annotate(unseen).select(*key, F.col("pos").alias("want"), F.col("dep_head").alias("at"), F.col("dep_rel").alias("rel"))
    got = perceptron.TrainedAnnotator(model).annotate(unseen)
    both = got.join(gold, key)
    n, tags, heads, labelled = both.agg(F.count("*"), F.avg((F.col("pos") == F.col("want")).cast("double")), F.avg((F.col("dep_head") == F.col("at")).cast("double")), F.avg(((F.col("dep_head") == F.col("at")) & (F.col("dep_rel") == F.col("rel"))).cast("double"))).first()
    print(n, tags, heads, labelled)
    assert n == gold.count() and tags > 0.97 and heads > 0.8 and labelled > 0.75
    assert got.columns == rules.annotate(unseen).columns
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "one", None, "x"), (4, "the cat is walking " * 5000, "en", "x")]
    assert annotate(spark, rows, perceptron.TrainedAnnotator(model)).count() == 1 + 20_000
    none = perceptron.train(perceptron.training_sentences(seen.where("false"), rules))
    assert not none.tagger.any()


def test_pieces_and_parts(spark):
    import pyarrow as pa

    from lexiloom.operators import annotation

    sizes = [annotation.PIECE - 1, 1, 1, 3 * annotation.PIECE, 0, 2]
    batch = pa.RecordBatch.from_pydict({"toks": pa.array([["x"] * n for n in sizes])})
    assert [p.num_rows for p in annotation.pieces(batch)] == [2, 1, 1, 2]
    docs = spark.createDataFrame([(1, "The old walls fall. He was seen in the big house."), (2, "the cat sees old dogs and cats"), (3, None)], "doc_id bigint, text string")
    full = annotation.RuleAnnotator().annotate(docs)
    parts = annotation.RuleAnnotator().annotate(docs, (), ("pos", "dep_head", "is_stop", "head_lemma"), by=("pos",))
    sql = "sum(dep_head) h, sum(cast(is_stop as int)) s, max(head_lemma) l"
    want = {tuple(r) for r in full.groupBy("pos").agg(*map(F.expr, ["count(*)", *sql.split(", ")])).collect()}
    assert want == {tuple(r) for r in parts.groupBy("pos").agg(F.sum("n"), F.sum("dep_head"), F.sum("is_stop"), F.max("head_lemma")).collect()}
    few = annotation.RuleAnnotator().annotate(docs, (), ("token_idx", "head_text", "toks", "tags"), {"dep_rel": ("nsubj",)}).collect()
    assert few and {(r.doc_id, r.token_idx, r.head_text) for r in few} == {(r.doc_id, r.token_idx, r.head_text) for r in full.where("dep_rel = 'nsubj'").collect()}
    assert all(len(r.toks) == len(r.tags) > r.token_idx for r in few)


@pytest.mark.parametrize("name, passes, shuffles", [("lemma_kwic", 1, False), ("rule_annotation", 0, True), ("grammar_counts", 1, True), ("dependency_examples", 0, True)])
def test_one_pass_over_all_texts(spark, name, passes, shuffles):
    """What is left to do has one pass at most (for grammar_counts over the first documents), and concordances shuffle nothing."""
    from lexiloom.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == passes and ("Exchange" in plan) == shuffles
