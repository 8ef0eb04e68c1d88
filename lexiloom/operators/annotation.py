"""From documents to annotated tokens: lemma, tag, morphology, head and relation.

``Annotator`` is the protocol: a table of documents in, a token table out, in the schema that
``operators.syntax`` reads, with each head's text, lemma and tag beside its dependent and each word's modifiers beside it.  Sentences are split into tokens by Spark; tags and heads are
computed in Arrow batches of sentences with arrays over all tokens of a batch, so that
a token costs a few array operations and a very long sentence no more than its length.

``RuleAnnotator`` needs no model: closed word classes, endings, and attachment to the
nearest word that can be a head.  It serves where no trained model is at hand,
and as the source of training sentences for ``operators.perceptron``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import STOP_WORDS_EN
from ..functions.tokens import marked, marked_sentences
from ..sources.storage import stored

TAGS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "NOUN", "NUM", "PART", "PRON", "VERB", "X"]
RELATIONS = ["advmod", "amod", "aux", "aux:pass", "case", "cc", "compound", "conj", "dep", "det", "neg", "nmod", "nsubj", "nummod", "obj", "relcl", "root"]

#: Closed word classes of each language.
CLOSED: dict[str, dict[str, str]] = {
    "en": {
        "DET": "the a an this that these those every each some any no",
        "ADP": "of in to for on with at by from as into over under about after before",
        "CCONJ": "and or but nor",
        "AUX": "is are am was were be been has have had do does did will would can could must should may might",
        "PRON": "i you he she it we they who which what them him us me",
        "PART": "not",
        "ADV": "then there here now very also never always",
    },
    "de": {"DET": "der die das den dem des ein eine einen einem", "ADP": "in mit von zu auf für bei über aus nach", "CCONJ": "und oder aber", "AUX": "ist sind war waren wird werden hat haben", "PRON": "ich er sie es wir ihr sich", "PART": "nicht"},
    "fr": {"DET": "le la les un une des du ce cette", "ADP": "de à en dans sur pour par avec", "CCONJ": "et ou mais", "AUX": "est sont était a ont sera", "PRON": "je il elle nous vous ils qui que", "PART": "ne pas"},
    "es": {"DET": "el la los las un una unos este esta", "ADP": "de en a con por para sobre", "CCONJ": "y o pero", "AUX": "es son era ha han será", "PRON": "yo él ella nosotros ellos que se", "PART": "no"},
}
#: Endings of open classes: (ending, tag, morphology, is it cut off for the lemma).  The first that fits is taken.
ENDINGS: dict[str, list[tuple[str, str, str, bool]]] = {
    "en": [("ly", "ADV", "", False), ("tion", "NOUN", "", False), ("ness", "NOUN", "", False), ("ment", "NOUN", "", False), ("ed", "VERB", "Tense=Past", True), ("ing", "VERB", "VerbForm=Ger", True), ("ble", "ADJ", "", False), ("ous", "ADJ", "", False), ("ful", "ADJ", "", False), ("s", "NOUN", "Number=Plur", True)],
    "de": [("lich", "ADJ", "", False), ("ig", "ADJ", "", False), ("ung", "NOUN", "", False), ("heit", "NOUN", "", False), ("keit", "NOUN", "", False), ("te", "VERB", "Tense=Past", True), ("en", "VERB", "Tense=Pres", True)],
    "fr": [("ment", "ADV", "", False), ("tion", "NOUN", "", False), ("eux", "ADJ", "", False), ("er", "VERB", "VerbForm=Inf", False), ("é", "VERB", "Tense=Past", True)],
    "es": [("mente", "ADV", "", False), ("ción", "NOUN", "", False), ("oso", "ADJ", "", False), ("ado", "VERB", "Tense=Past", True), ("ar", "VERB", "VerbForm=Inf", False)],
}
#: Forms of auxiliaries: lemma and morphology.
FORMS: dict[str, tuple[str, str]] = {
    **dict.fromkeys(("is", "are", "am", "be"), ("be", "Tense=Pres")),
    **dict.fromkeys(("was", "were", "been"), ("be", "Tense=Past")),
    **dict.fromkeys(("has", "have"), ("have", "Tense=Pres")),
    "had": ("have", "Tense=Past"),
    **dict.fromkeys(("do", "does"), ("do", "Tense=Pres")),
    "did": ("do", "Tense=Past"),
    "will": ("will", "Tense=Fut"),
    "not": ("not", "Polarity=Neg"),
}
RELATIVE = ("who", "which", "qui")
DEFAULT_LANG = "en"

TOKEN_SCHEMA = "sentence_idx int, token_idx int, text string, text_lc string, lemma string, pos string, pos_fine string, morph string, dep_head int, dep_rel string, is_punct boolean, is_stop boolean, head_text string, head_lemma string, head_pos string, modifiers array<string>"
#: What a token can bring along of its whole sentence, if asked for by name: texts and tags in order.
SENTENCE_COLUMNS = "toks array<string>, tags array<string>"
#: Tokens that are worked on at a time, or one sentence if that has more: what bounds a task's memory.
PIECE = 1 << 18
#: Longer sentences wait for each other; bytes of texts that are taken apart at a time.
LONG, TEXTS = 100, 1 << 22
#: Relations of what modifies a noun.
MODIFIERS = ("amod", "nmod", "compound", "nummod", "appos")
_CLOSED = {lang: {w: tag for tag, ws in classes.items() for w in ws.split()} for lang, classes in CLOSED.items()}
_STOP = pa.array(sorted(set(STOP_WORDS_EN)))
_TAG_NO = {t: i for i, t in enumerate(TAGS)}


class Annotator(Protocol):
    """What every annotator offers."""

    def info(self) -> dict[str, str]:
        """Names and versions that a result should be stored with."""

    def annotate(self, docs: DataFrame, keep: tuple[str, ...] = (), columns: tuple[str, ...] | None = None, only: dict[str, tuple] | None = None, by: tuple[str, ...] | None = None) -> DataFrame:
        """The token table of ``docs``: doc_id, kept columns, then those of ``columns`` (all of ``TOKEN_SCHEMA`` by default).

        What is not asked for is not made, as Spark cannot see into the tasks to leave it out itself: columns that are not named, tokens
        of which a column of ``only`` has none of its values, and with ``by`` single tokens.  Then the rows are (by, n, other columns), added up
        within a task's pieces: counts of tokens, sums of numbers, greatest strings.  They are parts that Spark has to add up.
        """


@dataclass(frozen=True)
class Wanted:
    """What of the token table is asked for, see ``Annotator.annotate``; several ``only`` are alternatives, a function of a column is a test."""

    columns: tuple[str, ...]
    only: dict[str, object] | tuple[dict[str, object], ...] = field(default_factory=dict)
    by: tuple[str, ...] | None = None


@lru_cache(maxsize=1 << 15)
def lexeme(word: str, lang: str, tag: str | None = None) -> tuple[str, str, str]:
    """Lemma, tag and morphology of a lower-case word; with a tag, its lemma and morphology as that."""
    closed = _CLOSED.get(lang, _CLOSED[DEFAULT_LANG])
    if word in closed and tag in (None, closed[word]):
        lemma, morph = FORMS.get(word, (word, "")) if lang == "en" else (word, "")
        return lemma, closed[word], morph
    if word.isdecimal() and tag in (None, "NUM"):
        return word, "NUM", ""
    for ending, kind, morph, cut in ENDINGS.get(lang, ENDINGS[DEFAULT_LANG]):
        if word.endswith(ending) and len(word) > len(ending) + 1 and tag in (None, kind):
            return (word[: -len(ending)] if cut else word), kind, morph
    return word, tag or "NOUN", ""


@dataclass(frozen=True)
class Lexemes:
    """``lexeme`` of many words: lemmas, numbers of tags, morphology."""

    lemma: pa.Array
    tag: np.ndarray
    morph: pa.Array


def decimal(words: pa.Array) -> np.ndarray:
    """Which words have decimal digits alone."""
    out = np.zeros(len(words), dtype=bool)
    some = np.flatnonzero(pc.invert(pc.match_substring_regex(words, "[a-z]")).to_numpy(zero_copy_only=False))
    out[some] = [w.isdecimal() for w in words.take(pa.array(some)).to_pylist()]
    return out


def _flags(mask: pa.Array) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False)


def lexemes(words: pa.Array, lang: np.ndarray, langs: list[str], tags: np.ndarray | None = None) -> Lexemes:
    """``lexeme`` of all words at once, each with its language's number in ``langs`` and, if given, its tag's number."""
    n = len(words)
    length, digits = pc.utf8_length(words).to_numpy(), decimal(words)
    tag = np.full(n, _TAG_NO["NOUN"]) if tags is None else tags.copy()
    morphs, morph = [""], np.zeros(n, dtype=np.int64)
    open_, lemma = np.ones(n, dtype=bool), words

    def take(own: np.ndarray, kind: np.ndarray | int, as_: str = "") -> np.ndarray:
        """Give those words that have no lexeme yet and the right tag theirs."""
        own = own & open_ if tags is None else own & open_ & (tags == kind)
        if tags is None:
            tag[own] = kind[own] if isinstance(kind, np.ndarray) else kind
        if as_ not in morphs:
            morphs.append(as_)
        morph[own], open_[own] = morphs.index(as_), False
        return own

    def replaced(own: np.ndarray, by: pa.Array) -> pa.Array:
        return pc.replace_with_mask(lemma, pa.array(own), by)

    for i, name in enumerate(langs):
        here = lang == i
        own_words, at = words.filter(pa.array(here)), np.full(n, -1)
        closed = _CLOSED.get(name, _CLOSED[DEFAULT_LANG])
        at[here] = pc.index_in(own_words, value_set=pa.array(list(closed))).fill_null(-1).to_numpy()
        known = take(at >= 0, np.array([*(_TAG_NO[t] for t in closed.values()), -1])[at])
        if name == "en":
            for form, (base, as_) in FORMS.items():
                own = known & _flags(pc.equal(words, form))
                if own.any():
                    if as_ not in morphs:
                        morphs.append(as_)
                    morph[own], lemma = morphs.index(as_), replaced(own, pa.array([base] * int(own.sum())))
        take(here & digits, _TAG_NO["NUM"])
        for ending, kind, as_, cut in ENDINGS.get(name, ENDINGS[DEFAULT_LANG]):
            own = length > len(ending) + 1
            own &= here
            own[here] &= _flags(pc.ends_with(own_words, ending))
            own = take(own, _TAG_NO[kind], as_)
            if cut and own.any():
                lemma = replaced(own, pc.utf8_slice_codeunits(words.filter(pa.array(own)), 0, -len(ending)))
    return Lexemes(lemma, tag, pa.array(morphs).take(pa.array(morph)))


class Batch:
    """The tokens of a batch of sentences, laid out flat.

    ``lower`` and ``lang`` (a number in ``langs``) are the distinct pairs of lower-case word and language and ``word`` each
    token's number among them; ``of`` is each token's sentence, ``place`` its index there.
    """

    def __init__(self, toks: pa.Array, langs: list[str | None] | pa.Array):
        flat = toks.flatten()
        sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
        self.n, self.flat = len(flat), flat
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(self.n) - self.begins[self.of]
        known = (langs.cast(pa.string()) if isinstance(langs, pa.Array) else pa.array(langs, pa.string())).fill_null("").dictionary_encode()
        of_each = [x or DEFAULT_LANG for x in known.dictionary.to_pylist()]
        self.langs = sorted(set(of_each))
        lang = np.array([self.langs.index(x) for x in of_each], dtype=np.int64)[known.indices.to_numpy()][self.of] if self.n else np.zeros(0, np.int64)
        coded = pc.utf8_lower(flat).dictionary_encode()
        kinds = max(1, len(self.langs))
        pair = coded.indices.to_numpy().astype(np.int64) * kinds + lang
        found = np.zeros(len(coded.dictionary) * kinds, dtype=bool)
        found[pair] = True
        pairs = np.flatnonzero(found)
        self.word = (np.cumsum(found) - 1)[pair]
        self.lower, self.lang = coded.dictionary.take(pa.array(pairs // kinds)), pairs % kinds

    @property
    def words(self) -> list[tuple[str, str]]:
        return [(self.langs[i], w) for i, w in zip(self.lang.tolist(), self.lower.to_pylist(), strict=True)]

    def nearest(self, of_kind: np.ndarray, ahead: bool) -> np.ndarray:
        """For each token the nearest other one of its sentence after (or before) it that is of a kind; -1 without one."""
        at = np.arange(self.n)
        if ahead:
            found = np.minimum.accumulate(np.where(of_kind, at, self.n)[::-1])[::-1]
            found = np.append(found[1:], self.n)
            return np.where(found < self.ends[self.of], found, -1)
        found = np.maximum.accumulate(np.where(of_kind, at, -1))
        found = np.concatenate(([-1], found[:-1]))
        return np.where(found >= self.begins[self.of], found, -1)

    def first(self, of_kind: np.ndarray) -> np.ndarray:
        """The first token of a kind in each sentence, -1 without one (and for sentences without tokens)."""
        found = np.flatnonzero(of_kind)
        at = np.searchsorted(found, self.begins)
        first = np.append(found, self.n)[at]
        return np.where(first < self.ends, first, -1)


def rule_heads(b: Batch, tag: np.ndarray, be: np.ndarray, past: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's head (flat place, -1 for a root) and relation, by nearest words.

    The root is a sentence's first verb, else its first auxiliary, else noun, else word.  Words
    that modify go to the next noun, those that go with verbs to the next verb; nouns and pronouns next to
    the root are its subject and object; what finds no head goes to the root.
    """
    is_ = {t: tag == i for i, t in enumerate(TAGS)}
    at = np.arange(b.n)
    top = np.full(len(b.begins), -1)
    for kind in ("VERB", "AUX", "NOUN"):
        top = np.where(top < 0, b.first(is_[kind]), top)
    root = np.where(top < 0, b.begins, top)[b.of]
    noun_ahead, noun_before, verb_ahead = b.nearest(is_["NOUN"], True), b.nearest(is_["NOUN"], False), b.nearest(is_["VERB"], True)
    before_is = np.zeros((2, b.n), dtype=bool)
    if b.n:
        before_is[:, 1:] = (relative[:-1], is_["NOUN"][:-1])
    before_is &= b.place > 0
    passive = be & (verb_ahead >= 0) & past[verb_ahead]
    clausal = is_["VERB"] | is_["AUX"]
    head, relation, open_ = np.full(b.n, -1), np.full(b.n, RELATIONS.index("root"), dtype=np.int8), at != root

    def rule(name: str, holds: np.ndarray, to: np.ndarray) -> None:
        """Give the tokens that have no head yet and for which the rule holds theirs."""
        own = np.flatnonzero(holds & open_)
        head[own], relation[own], open_[own] = to[own], RELATIONS.index(name), False

    for name, kind in (("det", "DET"), ("amod", "ADJ"), ("nummod", "NUM"), ("case", "ADP"), ("cc", "CCONJ")):
        rule(name, is_[kind] & (noun_ahead >= 0), noun_ahead)
    rule("aux:pass", is_["AUX"] & passive, verb_ahead)
    for name, kind in (("aux", "AUX"), ("neg", "PART"), ("advmod", "ADV")):
        rule(name, is_[kind] & (verb_ahead >= 0), verb_ahead)
    rule("relcl", is_["VERB"] & before_is[0] & (noun_before >= 0), noun_before)
    rule("conj", is_["VERB"], root)
    rule("compound", is_["NOUN"] & (noun_ahead == at + 1), noun_ahead)
    rule("nsubj", is_["NOUN"] & clausal[root] & (at < root) & ((noun_ahead < 0) | (noun_ahead > root)), root)
    rule("obj", is_["NOUN"] & clausal[root] & (at > root) & (noun_before < root), root)
    rule("nmod", is_["NOUN"] & (noun_before >= 0) & ~before_is[1], noun_before)
    rule("nsubj", is_["PRON"] & (at < root), root)
    rule("obj", is_["PRON"], root)
    rule("dep", open_, root)
    return head, relation


def token_rows(batch: pa.RecordBatch, b: Batch, ids: list[str], wanted: Wanted, lexemes_: Lexemes | None, which: np.ndarray, tag: np.ndarray, head: np.ndarray, relation: np.ndarray) -> pa.RecordBatch:
    """The token table of a batch; ``which`` is each token's number in ``lexemes_``."""
    def named(values: list[str] | pa.Array, at: np.ndarray) -> pa.Array:
        return (values if isinstance(values, pa.Array) else pa.array(values, pa.string())).take(pa.array(at)) if len(at) else pa.array([], pa.string())

    @lru_cache(maxsize=1)
    def modifiers() -> pa.Array:
        return modifiers_of(b, head, relation)

    make = {
        "sentence_idx": lambda at: batch.column("sentence_idx").take(pa.array(b.of[at])),
        "token_idx": lambda at: pa.array(b.place[at].astype(np.int32)),
        "text": lambda at: b.flat.take(pa.array(at)),
        "text_lc": lambda at: named(b.lower, b.word[at]),
        "lemma": lambda at: named(lexemes_.lemma, which[at]),
        "pos": lambda at: named(TAGS, tag[at]),
        "pos_fine": lambda at: named([""], np.zeros(len(at), dtype=np.int8)),
        "morph": lambda at: named(lexemes_.morph, which[at]),
        "dep_head": lambda at: pa.array(np.where(head[at] < 0, 0, b.place[head[at]] + 1).astype(np.int32) if len(at) else np.zeros(0, np.int32)),
        "dep_rel": lambda at: named(RELATIONS, relation[at]),
        "is_punct": lambda at: pa.array(np.zeros(len(at), dtype=bool)),
        "is_stop": lambda at: pc.is_in(b.lower, _STOP).take(pa.array(b.word[at])) if len(at) else pa.array([], pa.bool_()),
        "toks": lambda at: batch.column("toks").take(pa.array(b.of[at])),
        "tags": lambda at: pa.ListArray.from_arrays(pa.array(np.append(b.begins, b.n).astype(np.int32)), named(TAGS, tag)).take(pa.array(b.of[at])),
        "modifiers": lambda at: modifiers().take(pa.array(at)),
    }

    def of_heads(c: str, at: np.ndarray) -> pa.Array:
        up = head[at]
        has = up >= 0
        return make[c](up[has]).take(pa.array(np.cumsum(has) - 1, mask=~has))

    make |= {f"head_{c}": lambda at, c=c: of_heads(c, at) for c in ("text", "lemma", "pos")}
    at = np.arange(b.n)

    def those(only: dict[str, object]) -> np.ndarray:
        at = np.arange(b.n)
        for c, values in only.items():
            if c in ("pos", "dep_rel") and not callable(values):  # by number, without making their names
                names, number = (TAGS, tag) if c == "pos" else (RELATIONS, relation)
                at = at[np.array([x in values for x in names])[number[at]]]
                continue
            found = make[c](at)
            at = at[_flags((values(found) if callable(values) else pc.is_in(found, pa.array(list(values), found.type))).fill_null(False))]
        return at

    if wanted.only:
        shown = np.zeros(b.n, dtype=bool)
        for only in wanted.only if isinstance(wanted.only, tuple) else (wanted.only,):
            shown[those(only)] = True
        at = np.flatnonzero(shown)
    own = pa.array(b.of[at])
    columns = {c: batch.column(c).take(own) for c in ids if not wanted.by or c in wanted.by} | {c: make[c](at) for c in wanted.columns}
    if not wanted.by:
        return pa.RecordBatch.from_pydict(columns)
    rest = [c for c in wanted.columns if c not in wanted.by]
    table = pa.table(columns).append_column("n", pa.array(np.ones(len(at), dtype=np.int64)))
    how = {c: "max" if pa.types.is_string(table.schema.field(c).type) else "sum" for c in rest}
    out = table.group_by(list(wanted.by), use_threads=False).aggregate([("n", "sum"), *how.items()])
    kinds = {c: pa.string() if k == "max" else pa.int64() for c, k in how.items()}
    return pa.RecordBatch.from_pydict({c: out[c].combine_chunks() for c in wanted.by} | {"n": out["n_sum"].combine_chunks()} | {c: out[f"{c}_{how[c]}"].cast(kinds[c]).combine_chunks() for c in rest})


def modifiers_of(b: Batch, head: np.ndarray, relation: np.ndarray) -> pa.Array:
    """The texts of each token's modifiers, in text order; null without any."""
    own = np.flatnonzero(np.isin(relation, [i for i, r in enumerate(RELATIONS) if r in MODIFIERS]) & (head >= 0))
    own = own[np.argsort(head[own], kind="stable")]
    offsets = np.searchsorted(head[own], np.arange(b.n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), b.flat.take(pa.array(own)), mask=pa.array(offsets[1:] == offsets[:-1]))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of sentences in slices of up to ``PIECE`` tokens; longer sentences are slices of their own."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("toks")), 0).to_numpy().astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + PIECE, side="right")))
        yield batch.slice(a, z - a)
        a = z


def sentence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of marked documents, a few megabytes of text at a time; other columns come along."""
    for batch in batches:
        texts = batch.column("marked_")
        others = batch.drop_columns(["marked_"])
        ends, a = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)), 0
        while a < len(ends):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TEXTS, side="right")))
            of, place, toks = marked_sentences(texts.slice(a, z - a))
            own = others.slice(a, z - a).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(place), toks], names=[*own.schema.names, "sentence_idx", "toks"])
            a = z


def sorted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sentences as pieces of those of up to ``LONG`` tokens, and others of longer ones, which wait until there are enough of them.

    What goes through all sentences of a piece a step at a time has as many steps as the longest one.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        long = pc.greater(pc.list_value_length(batch.column("toks")), LONG)
        yield from pieces(batch.filter(pc.invert(long)))
        if (some := batch.filter(long)).num_rows:
            waiting.append(some)
            if sum(len(x.column("toks").flatten()) for x in waiting) > PIECE:
                yield from pieces(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                waiting = []
    if waiting:
        yield from pieces(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])


def annotate_batches(docs: DataFrame, keep: tuple[str, ...], lang_col: str, work, columns: tuple[str, ...] | None = None, only: dict[str, tuple] | None = None, by: tuple[str, ...] | None = None) -> DataFrame:
    """``work(batch, Batch, id columns, Wanted)`` over Arrow batches of sentences; gives the token table, or with ``by`` its parts to be added up."""
    kept, rows = marked_rows(docs, keep, lang_col)
    wanted = Wanted(names_of(columns), only or {}, by)
    fields = fields_of(wanted, {c: docs.schema[c].dataType.simpleString() for c in kept})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, b in laid_out(batches, lang_col):
            yield work(piece, b, kept, wanted)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in fields.items()))


def names_of(columns: tuple[str, ...] | None) -> tuple[str, ...]:
    """The columns of a token table that are asked for, in its order."""
    every = [x.split(" ")[0] for x in TOKEN_SCHEMA.split(", ")]
    more = [x.split(" ")[0] for x in SENTENCE_COLUMNS.split(", ")]
    return tuple(c for c in every if columns is None or c in columns) + tuple(c for c in more if columns is not None and c in columns)


def fields_of(wanted: Wanted, ids: dict[str, str]) -> dict[str, str]:
    """Types of the columns of a token table or its parts."""
    kinds = dict(x.split(" ") for x in f"{TOKEN_SCHEMA}, {SENTENCE_COLUMNS}".split(", ")) | ids
    if wanted.by:
        return {c: kinds[c] for c in wanted.by} | {"n": "bigint"} | {c: "string" if kinds[c] == "string" else "bigint" for c in wanted.columns if c not in wanted.by}
    return {c: kinds[c] for c in (*ids, *wanted.columns)}


def marked_rows(docs: DataFrame, keep: tuple[str, ...], lang_col: str) -> tuple[list[str], DataFrame]:
    """Names of the columns that are kept, and what tasks get: these, the language and the marked text."""
    kept = list(dict.fromkeys(["doc_id", *keep]))
    langs = [lang_col] if lang_col in docs.columns and lang_col not in kept else []
    return kept, docs.select(*kept, *langs, marked(F.col("text")).alias("marked_"))


def laid_out(batches: Iterator[pa.RecordBatch], lang_col: str) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Pieces of sentences and their tokens laid out flat."""
    for piece in sorted_pieces(sentence_batches(batches)):
        known = piece.column(lang_col) if lang_col in piece.schema.names else pa.nulls(piece.num_rows, pa.string())
        yield piece, Batch(piece.column("toks"), known)


class RuleAnnotator:
    """Closed classes, endings and nearest heads; languages without lists are read by the English ones."""

    def __init__(self, lang_col: str = "lang"):
        self.lang_col = lang_col

    def info(self) -> dict[str, str]:
        return {"backend": "rules", "model_name": "closed-classes-and-endings", "model_version": "1"}

    def annotate(self, docs: DataFrame, keep: tuple[str, ...] = (), columns: tuple[str, ...] | None = None, only: dict[str, tuple] | None = None, by: tuple[str, ...] | None = None) -> DataFrame:
        """Null and empty texts have no tokens; every token has a head within its sentence, or none if it is the root."""
        return annotate_batches(docs, keep, self.lang_col, rule_batch, columns, only, by)

    def tables(self, docs: DataFrame, wants: list[Wanted]) -> list[DataFrame]:
        """A token table (or parts) for each of ``wants``, all made in one pass over the texts and stored."""
        kept, rows = marked_rows(docs, (), self.lang_col)
        ids, lang_col = {c: docs.schema[c].dataType.simpleString() for c in kept}, self.lang_col
        fields = [fields_of(w, ids) for w in wants]
        schema = "table_ int, " + ", ".join(f"`{i}_{c}` {k}" for i, own in enumerate(fields) for c, k in own.items())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            empty: list[pa.RecordBatch] = []  # no rows of each table, for its types
            for piece, b in laid_out(batches, lang_col):
                found, tag, head, relation = rule_tags(b)
                out = [token_rows(piece, b, kept, w, found, b.word, tag, head, relation) for w in wants]
                empty = empty or [x.slice(0, 0) for x in out]
                for i, own in enumerate(out):
                    columns = {"table_": pa.array(np.full(own.num_rows, i, dtype=np.int32))}
                    for j, x in enumerate(empty):
                        columns |= {f"{j}_{c}": own.column(c) if i == j else pa.nulls(own.num_rows, x.column(c).type) for c in x.schema.names}
                    yield pa.RecordBatch.from_pydict(columns)

        made = stored(rows.mapInArrow(run, schema), "token-tables")
        return [made.where(F.col("table_") == i).select(*(F.col(f"`{i}_{c}`").alias(c) for c in own)) for i, own in enumerate(fields)]


def rule_tags(b: Batch) -> tuple[Lexemes, np.ndarray, np.ndarray, np.ndarray]:
    """Lexemes of the batch's words, and each token's tag, head and relation by rule."""
    found = lexemes(b.lower, b.lang, b.langs)
    past = (found.tag == _TAG_NO["VERB"]) & _flags(pc.equal(found.morph, "Tense=Past"))
    tag = found.tag[b.word].astype(np.int8)
    of_words = (_flags(pc.equal(found.lemma, "be")), past, _flags(pc.is_in(b.lower, pa.array(RELATIVE))))
    head, relation = rule_heads(b, tag, *(x[b.word] for x in of_words))
    return found, tag, head, relation


def rule_batch(batch: pa.RecordBatch, b: Batch, ids: list[str], wanted: Wanted) -> pa.RecordBatch:
    found, tag, head, relation = rule_tags(b)
    return token_rows(batch, b, ids, wanted, found, b.word, tag, head, relation)
