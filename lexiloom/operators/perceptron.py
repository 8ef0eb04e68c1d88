"""A trainable annotator: averaged-perceptron tagger with Viterbi decoding, and an arc-standard parser.

Training is distributed by iterative parameter mixing: each round sends the weights out, every
partition trains on its own sentences, and Spark averages the weights by feature.  Features are
hashed, so a model has a fixed size (``BITS``) whatever the corpus, and that is all that reaches the driver.
Decoding works on all sentences of a batch at once, step by step: those of similar length are laid out
side by side, so that cost is linear in tokens and memory bounded by ``CELLS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .annotation import RELATIONS, TAGS, Annotator, Batch, Wanted, annotate_batches, decimal, lexemes, token_rows

BITS = 16
#: Sentences whose weights are updated together; stack cells laid out at a time; longest training sentence.
MINIBATCH, CELLS, LONGEST = 64, 1 << 21, 200
T, R = len(TAGS), len(RELATIONS)
SHIFT, ACTIONS = 0, 1 + 2 * R  # then left arcs, then right arcs, by relation
NO_TAG, ROOT_TAG = T, T + 1


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """Feature numbers from the hashes of their parts."""
    h = np.full(1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64, copy=False)) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def _hashes(b: Batch, words: pa.Array) -> np.ndarray:
    """CRC-32 of "language word" for words of the batch's languages, a byte of all words at a time."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data, sizes = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = ends[:-1][order], sizes[order]
    first = np.array([zlib.crc32(f"{lang} ".encode()) for lang in b.langs] + [0], dtype=np.uint32)
    state = ~first[b.lang[order]]
    steps = int(lengths[0]) if n else 0
    live = n - np.searchsorted(lengths[::-1], np.arange(1, steps + 1))  # words that have a byte at each step
    for j in range(steps):
        k = live[j]
        state[:k] = _CRC[(state[:k] ^ data[starts[:k] + j]) & 255] ^ state[:k] >> 8
    out = np.empty(n, dtype=np.int64)
    out[order] = ~state
    return out


@dataclass
class Model:
    """Weights of the tagger (features by tag, tag by tag with a start row) and of the parser (features by action)."""

    tagger: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, T)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((T + 1, T)))
    parser: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, ACTIONS)))


def word_features(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words, and of no word behind them: as a token's own (the word and its ends), as the one before and the one after."""
    words = np.append(_hashes(b, b.lower), 1)
    ends = [np.append(_hashes(b, pc.utf8_slice_codeunits(b.lower, -k, None)), 1) for k in (1, 2, 3, 4)]
    shape = np.append(2 * decimal(b.lower) + (pc.utf8_length(b.lower).to_numpy() < 4), 0)
    own = np.stack([_mixed(1, words), *(_mixed(2 + k, e) for k, e in enumerate(ends)), _mixed(7, shape)], axis=1)
    return own, _mixed(8, words), _mixed(9, words)


def beside(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words before and after each token in its sentence, or that of no word."""
    none = len(b.lower)
    before, after = np.full(b.n, none), np.full(b.n, none)
    if b.n:
        inner = b.place[1:] > 0
        before[1:][inner], after[:-1][inner] = b.word[:-1][inner], b.word[1:][inner]
    return before, after


def tag_features(b: Batch) -> np.ndarray:
    """(token, feature): the word and its ends, and the words beside it."""
    (own, left, right), (before, after) = word_features(b), beside(b)
    return np.concatenate([own[b.word], left[before, None], right[after, None]], axis=1)


def tag_scores(b: Batch, weights: np.ndarray) -> np.ndarray:
    """(token, tag): the sums of the features' weights, added up once for each distinct word."""
    (own, left, right), (before, after) = word_features(b), beside(b)
    out = weights[own].sum(axis=1)[b.word]
    out += weights[left].take(before, axis=0)
    out += weights[right].take(after, axis=0)
    return out


def viterbi(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The tag sequence of greatest score for each sentence, all sentences a step at a time."""
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = begins[order], sizes[order]
    steps = int(lengths[0]) if len(lengths) else 0
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, steps + 1))  # sentences that have a token at each step
    back = np.zeros(scores.shape, dtype=np.int8)
    tags = np.zeros(len(scores), dtype=np.int64)
    now = np.ascontiguousarray((scores[starts[: live[0]]] + moves[-1]).T) if steps else None  # (tag, sentence)
    last = np.zeros(len(lengths), dtype=np.int64)
    for t in range(1, steps + 1):
        n = live[t] if t < steps else 0
        last[n : now.shape[1]] = now[:, n:].argmax(axis=0)
        if n:
            best, where = _best_ways(now[:, :n], moves)
            at = starts[:n] + t
            back[at] = where.T
            now = best + scores[at].T
    for t in range(steps - 1, -1, -1):
        at = starts[: live[t]] + t
        tags[at] = last[: live[t]]
        last[: live[t]] = back[at, last[: live[t]]]
    return tags


def _best_ways(now: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tag, sentence): the greatest score of a tag before and the move from it, and that tag; of equal ones the first."""
    kinds = len(now)
    if now.shape[1] < 128:  # too few sentences for array operations by tag
        ways = now[:, None, :] + moves[:-1, :, None]
        return ways.max(axis=0), ways.argmax(axis=0)
    best, where = now[0] + moves[0][:, None], np.zeros((kinds, now.shape[1]), dtype=np.int8)
    for k in range(1, kinds):
        ways = now[k] + moves[k][:, None]
        np.copyto(where, k, where=ways > best)
        np.maximum(best, ways, out=best)
    return best, where


def projective(heads: list[int]) -> list[int]:
    """Heads (1-based, 0 the root) with each arc that crosses another lifted to its head's head until none does."""
    heads = list(heads)

    def crosses(d: int) -> bool:
        h = heads[d - 1]
        for k in range(min(d, h) + 1, max(d, h)) if h else ():
            while k not in (0, h):
                k = heads[k - 1]
            if k != h:
                return True
        return False

    changed = True
    while changed:
        changed = False
        for d in sorted(range(1, len(heads) + 1), key=lambda d: abs(heads[d - 1] - d)):
            if crosses(d):
                heads[d - 1], changed = heads[heads[d - 1] - 1], True
    return heads


def gold_actions(heads: list[int], relations: list[int]) -> list[tuple[int, int, int, int]] | None:
    """(second, first, next, action) of every step to a projective tree, tokens from 1 and 0 the root; null if there is none."""
    n = len(heads)
    waiting = [0] * (n + 1)
    for h in heads:
        waiting[h] += 1
    stack, nxt, out = [0], 1, []
    while len(stack) > 1 or nxt <= n:
        s1, s2 = stack[-1], stack[-2] if len(stack) > 1 else -1
        if s2 > 0 and heads[s2 - 1] == s1 and not waiting[s2]:
            action, gone = 1 + relations[s2 - 1], -2
        elif s2 >= 0 and heads[s1 - 1] == s2 and not waiting[s1]:
            action, gone = 1 + R + relations[s1 - 1], -1
        elif nxt <= n:
            action, gone = SHIFT, 0
        else:
            return None
        out.append((s2, s1, nxt if nxt <= n else -1, action))
        if gone:
            waiting[stack[-1] if gone == -2 else stack[-2]] -= 1
            del stack[gone]
        else:
            stack.append(nxt)
            nxt += 1
    return out


def parse_features(tags: np.ndarray, words: np.ndarray, s2: np.ndarray, s1: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """(state, feature) of the two topmost words of the stack and the next one; places index ``tags`` and ``words``."""
    t2, t1, tb, w2, w1, wb = tags[s2], tags[s1], tags[b1], words[s2], words[s1], words[b1]
    gap = np.minimum(np.maximum(s1 - s2, 0), 6)
    return np.stack([*_of_tags(t2, t1, tb, gap), *_of_words(t2, t1, tb, w2, w1, wb)], axis=1)


def _of_tags(t2, t1, tb, gap) -> list[np.ndarray]:
    return [_mixed(20, t2, t1), _mixed(21, t2, t1, tb), _mixed(22, t1, tb), _mixed(27, t2, t1, gap), _mixed(28, t2, tb)]


def _of_words(t2, t1, tb, w2, w1, wb) -> list[np.ndarray]:
    return list(_mixed(np.array([[23], [24], [25], [26], [29]]), np.stack((w2, t2, w1, t1, w2)), np.stack((t1, w1, tb, wb, w1))))


def tag_table(weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of all features of tags alone, for each three tags and gap."""
    kinds = T + 2
    t2, t1, tb, gap = (x.ravel() for x in np.meshgrid(*(np.arange(kinds),) * 3, np.arange(7), indexing="ij"))
    return sum(weights[f] for f in _of_tags(t2, t1, tb, gap))


def _allowed(depth: np.ndarray, second_is_root: np.ndarray, more: np.ndarray) -> np.ndarray:
    """(state, action) that may be taken: the root is no dependent, and takes its own last."""
    out = np.zeros((len(depth), ACTIONS), dtype=bool)
    out[:, SHIFT] = more
    out[:, 1 : 1 + R] = ((depth > 1) & ~second_is_root)[:, None]
    out[:, 1 + R :] = ((depth > 1) & (~second_is_root | ~more))[:, None]
    return out


def parse(tags: np.ndarray, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, weights: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each token's head (flat place, -1 for a root) and relation."""
    n = len(tags)
    table = tag_table(weights) if table is None else table
    head, relation = np.full(n, -1), np.full(n, RELATIONS.index("root"))
    # What each kind of state may not do is never the best: by depth over 1, the root as second, words left.
    masks = np.where(_allowed(np.repeat((1, 2), 4), np.tile((False, False, True, True), 2), np.tile((False, True), 4)), 0, -np.inf).astype(weights.dtype)
    # Two further places: no word, and the root.
    tags, words = np.append(tags, (NO_TAG, ROOT_TAG)), np.append(words, (2, 3)).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        width = int(sizes[order[0]]) + 1
        own, order = order[: max(1, CELLS // width)], order[max(1, CELLS // width) :]
        start, end = begins[own], begins[own] + sizes[own]
        stack = np.full(len(own) * width, n + 1)
        base, depth, nxt = np.arange(len(own)) * width, np.ones(len(own), dtype=np.int64), start.copy()
        steps = 2 * (width - 1)
        live = len(own) - np.searchsorted(sizes[own][::-1], np.arange(steps) // 2 + 1)  # a sentence takes two steps for each token
        for m in live.tolist():
            high, at, top = depth[:m], nxt[:m], base[:m] + depth[:m]
            s1, deep = stack.take(top - 1), high > 1
            s2 = np.where(deep, stack.take(top - 1 - deep), n)
            more = at < end[:m]
            b1 = np.where(more, at, n)
            t2, t1, tb = tags.take(s2), tags.take(s1), tags.take(b1)
            scores = table.take(((t2 * (T + 2) + t1) * (T + 2) + tb) * 7 + np.minimum(np.maximum(s1 - s2, 0), 6), axis=0)
            for f in _of_words(t2, t1, tb, words.take(s2), words.take(s1), words.take(b1)):
                scores += weights.take(f, axis=0)
            scores += masks.take(deep * 4 + (s2 == n + 1) * 2 + more, axis=0)
            action = scores.argmax(axis=1)
            rows = np.flatnonzero(action == SHIFT)
            stack[top[rows]] = at[rows]
            depth[:m] -= 1
            depth[rows] += 2
            nxt[rows] += 1
            rows = np.flatnonzero((action > SHIFT) & (action <= R))
            up, down = s1[rows], s2[rows]
            head[down], relation[down] = up, action[rows] - 1
            stack[top[rows] - 2] = up
            rows = np.flatnonzero(action > R)
            up, down = s2[rows], s1[rows]
            head[down], relation[down] = np.where(up == n + 1, -1, up), action[rows] - 1 - R
    relation[head < 0] = RELATIONS.index("root")
    return head, relation


class Averaged:
    """Weights and the sum of all their values so far."""

    def __init__(self, weights: np.ndarray):
        self.now, self.late, self.steps = weights.copy(), np.zeros_like(weights), 0

    def update(self, at, by) -> None:
        np.add.at(self.now, at, by)
        np.add.at(self.late, at, np.asarray(by) * self.steps)

    def mean(self) -> np.ndarray:
        return self.now - self.late / max(1, self.steps)


def _train_part(sentences: list[tuple[str, list[str], list[int], np.ndarray]], model: Model) -> Model:
    """One round over (language, words, tags, steps of ``gold_actions``) of a partition."""
    tagger, moves, parser = Averaged(model.tagger), Averaged(model.moves), Averaged(model.parser)
    for a in range(0, len(sentences), MINIBATCH):
        some = sentences[a : a + MINIBATCH]
        b = Batch(pa.array([s[1] for s in some], pa.list_(pa.string())), [s[0] for s in some])
        gold, sizes = np.concatenate([s[2] for s in some]).astype(np.int64), b.ends - b.begins
        for x in (tagger, moves, parser):
            x.steps += 1
        features = tag_features(b)
        got = viterbi(tagger.now[features].sum(axis=1), b.begins, sizes, moves.now)
        wrong = np.flatnonzero(got != gold)
        tagger.update((features[wrong], gold[wrong, None]), 1.0)
        tagger.update((features[wrong], got[wrong, None]), -1.0)
        for tags, by in ((gold, 1.0), (got, -1.0)):
            before = np.where(b.place > 0, np.concatenate(([0], tags[:-1])), T)
            moves.update((before, tags), by)
        sizes_ = [len(s[3]) for s in some]
        if not any(sizes_):
            continue
        s2, s1, b1, action = np.concatenate([s[3] for s in some]).T
        base = np.repeat(b.begins - 1, sizes_)
        s2 = np.where(s2 < 0, b.n, np.where(s2 == 0, b.n + 1, base + s2))
        s1, b1 = np.where(s1 == 0, b.n + 1, base + s1), np.where(b1 < 0, b.n, base + b1)
        tags, words = np.append(gold, (NO_TAG, ROOT_TAG)), np.append(_word_hashes(b), (2, 3))
        features = parse_features(tags, words, s2, s1, b1)
        allowed = _allowed(np.where(s2 == b.n, 1, 2), s2 == b.n + 1, b1 < b.n)
        got = np.where(allowed, parser.now[features].sum(axis=1), -np.inf).argmax(axis=1)
        wrong = np.flatnonzero(got != action)
        parser.update((features[wrong], action[wrong, None]), 1.0)
        parser.update((features[wrong], got[wrong, None]), -1.0)
    return Model(tagger.mean(), moves.mean(), parser.mean())


def _word_hashes(b: Batch) -> np.ndarray:
    return _hashes(b, b.lower)[b.word]


def training_sentences(docs: DataFrame, annotator: Annotator, most: int = 1000, lang_col: str = "lang") -> DataFrame:
    """(lang, toks, tags, heads, rels): the sentences of ``most`` documents, chosen by a hash of their id, as an annotator sees them.

    Sentences of over ``LONGEST`` tokens are left out.
    """
    def first(x: DataFrame) -> DataFrame:
        return x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    # Ids are chosen before texts are read: only the chosen texts leave their partitions.
    ids = F.broadcast(first(docs.select("doc_id")).select(F.col("doc_id").alias("chosen")).distinct())
    x = docs.select("doc_id", lang_col, "text")
    some = first(x.join(ids, x["doc_id"].eqNullSafe(ids["chosen"]), "left_semi"))
    t = annotator.annotate(some, (lang_col,))
    rows = F.array_sort(F.collect_list(F.struct("token_idx", "text", "pos", "dep_head", "dep_rel")))
    s = t.groupBy("doc_id", "sentence_idx").agg(F.first(lang_col).alias("lang"), rows.alias("r")).where(F.size("r") <= LONGEST)
    return s.select("doc_id", "sentence_idx", "lang", *(F.col(f"r.{c}").alias(a) for c, a in (("text", "toks"), ("pos", "tags"), ("dep_head", "heads"), ("dep_rel", "rels"))))


def train(sentences: DataFrame, rounds: int = 4, parts: int = 8) -> Model:
    """A model of annotated sentences (doc_id, sentence_idx, lang, toks, tags, heads, rels); tags and relations outside the lists are X and dep."""
    spark = sentences.sparkSession
    tag_no, rel_no = {t: i for i, t in enumerate(TAGS)}, {r: i for i, r in enumerate(RELATIONS)}

    def with_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for heads, rels in zip(batch.column("heads").to_pylist(), batch.column("rels").to_pylist(), strict=True):
                found.append([x for step in gold_actions(projective(heads), [rel_no.get(r, rel_no["dep"]) for r in rels]) or [] for x in step])
            tags = [[tag_no.get(t, tag_no["X"]) for t in tags] for tags in batch.column("tags").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "sentence_idx", "lang", "toks")), pa.array(tags, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "sentence_idx", "lang", "toks", "tags", "steps"])

    # Every round reads them; their trees are taken to steps once.
    kinds = ", ".join(f"{c} {sentences.schema[c].dataType.simpleString()}" for c in ("doc_id", "sentence_idx", "lang", "toks"))
    sentences = stored(sentences.repartition(parts, "doc_id").mapInArrow(with_steps, f"{kinds}, tags array<int>, steps array<int>"), "training-sentences")
    rows = sentences.repartition(parts, "doc_id").sortWithinPartitions(F.xxhash64("doc_id", "sentence_idx"), "doc_id", "sentence_idx").select("lang", "toks", "tags", "steps")
    model = Model()
    names = ("tagger", "moves", "parser")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            data = []
            for batch in batches:
                for lang, toks, tags, steps in zip(*(batch.column(c).to_pylist() for c in ("lang", "toks", "tags", "steps")), strict=True):
                    data.append((lang, toks, tags, np.array(steps, dtype=np.int64).reshape(-1, 4)))
            if not data:
                return
            mine = _train_part(data, sent.value)
            for name in names:
                w = getattr(mine, name)
                at = np.flatnonzero(w.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(np.arange(len(at) + 1) * w.shape[1], len(at) * w.shape[1]).astype(np.int32)), pa.array(w[at].ravel()))], names=["name", "at", "w"])

        # A row of number -1 says that a partition took part; missing rows are zero.
        width = max(T, ACTIONS)
        sums = rows.mapInArrow(run, "name string, at int, w array<double>").groupBy("name", "at").agg(F.count("*").alias("n"), *(F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(width)))
        found = sums.toArrow()
        sent.unpersist()
        model = Model()
        name, at, n = (found.column(c).to_pylist() for c in ("name", "at", "n"))
        columns = np.stack([np.nan_to_num(found.column(f"w{i}").to_numpy()) for i in range(width)], axis=1)
        takers = {x: k for x, i, k in zip(name, at, n, strict=True) if i == -1}
        for row, (x, i) in enumerate(zip(name, at, strict=True)):
            if i >= 0:
                w = getattr(model, x)
                w[i] = columns[row, : w.shape[1]] / takers[x]
    return model


class TrainedAnnotator:
    """Tags and heads by a trained model; lemmas and morphology by the endings of ``annotation`` for the tag."""

    def __init__(self, model: Model, name: str = "perceptron", version: str = "1", lang_col: str = "lang"):
        self.model = Model(*(w.astype(np.float32) for w in (model.tagger, model.moves, model.parser)))
        self.name, self.version, self.lang_col = name, version, lang_col

    def info(self) -> dict[str, str]:
        return {"backend": "perceptron", "model_name": self.name, "model_version": self.version}

    def annotate(self, docs: DataFrame, keep: tuple[str, ...] = (), columns: tuple[str, ...] | None = None, only: dict[str, tuple] | None = None, by: tuple[str, ...] | None = None) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(self.model)
        tables: list[np.ndarray] = []  # of tags, made once in each task

        def work(batch: pa.RecordBatch, b: Batch, ids: list[str], wanted: Wanted) -> pa.RecordBatch:
            m, sizes = sent.value, b.ends - b.begins
            tags = viterbi(tag_scores(b, m.tagger), b.begins, sizes, m.moves) if b.n else np.zeros(0, np.int64)
            if not tables:
                tables.append(tag_table(m.parser))
            head, relation = parse(tags, _word_hashes(b), b.begins, sizes, m.parser, tables[0])
            if not {"lemma", "head_lemma", "morph"} & {*wanted.columns, *wanted.only}:
                return token_rows(batch, b, ids, wanted, None, tags, tags, head, relation)
            pairs, which = np.unique(b.word * T + tags, return_inverse=True) if b.n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found = lexemes(b.lower.take(pa.array(pairs // T)), b.lang[pairs // T], b.langs, pairs % T)
            return token_rows(batch, b, ids, wanted, found, which, tags, head, relation)

        return annotate_batches(docs, keep, self.lang_col, work, columns, only, by)
