"""Operators by name: what a tool-calling client or a job description asks for, with checked arguments.

Every tool takes documents and named arguments and gives a DataFrame.  Its parameters have types, defaults and
bounds, so an unknown tool, an unknown or missing argument or a bad value is refused before anything runs.
``schemas`` describes all tools in JSON-schema form; ``register_views`` makes their results views for SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions.tokens import tokens
from ..sources.storage import stored
from . import annotation, arabic, association, concordance, frequency, language, lexical, syntax
from .annotation import Wanted
from .catalog import subcorpus


class ToolError(ValueError):
    """A call that is refused; the message says why."""


@dataclass(frozen=True)
class Param:
    """A parameter: its type, its default (required without one), bounds of a number, values or length of a text."""

    kind: type
    about: str
    default: object = ...
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] | None = None

    def checked(self, tool: str, name: str, value: object) -> object:
        if value is None and self.default is None:
            return None
        kinds = (int, float) if self.kind is float else (self.kind,)
        if not isinstance(value, kinds) or (isinstance(value, bool) and self.kind is not bool):
            raise ToolError(f"{tool}: {name} has to be of type {self.kind.__name__}")
        size = len(value) if isinstance(value, (str, list)) else value
        if isinstance(value, list) and not all(isinstance(x, str) for x in value):
            raise ToolError(f"{tool}: {name} has to be a list of texts")
        if (self.least is not None and size < self.least) or (self.most is not None and size > self.most):
            raise ToolError(f"{tool}: {name} has to be between {self.least} and {self.most}")
        if self.values is not None and value not in self.values:
            raise ToolError(f"{tool}: {name} has to be one of {', '.join(self.values)}")
        return value

    def schema(self) -> dict:
        kinds = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array"}
        out: dict = {"type": kinds[self.kind], "description": self.about}
        if self.kind is list:
            out["items"] = {"type": "string"}
        if self.kind in (int, float):
            out |= {k: v for k, v in (("minimum", self.least), ("maximum", self.most)) if v is not None}
        elif self.least is not None:
            out["minLength" if self.kind is str else "minItems"] = self.least
        if self.values is not None:
            out["enum"] = list(self.values)
        if self.default is not ...:
            out["default"] = self.default
        return out


@dataclass(frozen=True)
class Tool:
    """A tool's parameters and how its result is made: of documents, of the tokens it wants, or of the words' counts too.

    ``wants`` and ``counted`` say by the arguments what tokens it is made of and whether counts will do; calls share these, see ``call_all``.
    """

    about: str
    params: dict[str, Param]
    run: Callable[..., DataFrame] | None = None
    wants: Callable[..., Wanted] | None = None
    of_tokens: Callable[..., DataFrame] | None = None
    counted: Callable[..., bool] | None = None
    of_counts: Callable[..., DataFrame] | None = None


WORD = Param(str, "The word looked for; * and ? stand for any letters and any letter.", least=1, most=200)
LIMIT = Param(int, "How many rows to give, all by default.", default=None, least=1, most=1_000_000)
LEVEL = Param(str, "What is counted.", default="text", values=("text", "lemma", "pos"))


def _limited(df: DataFrame, limit: int | None, *order) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


PAIR = ("lemma", "dep_rel", "head_lemma")
SHOWN = ("sentence_idx", "token_idx", "text", "lemma", "pos", "morph", "dep_rel", "head_text", "modifiers")


def _shown(patterns: list[str] | None) -> Wanted:
    unknown = set(patterns or ()) - set(syntax.DETECTORS)
    if unknown:
        raise ValueError(f"unknown patterns: {', '.join(sorted(unknown))}")
    return Wanted(annotation.names_of(SHOWN), tuple(only for n in patterns or syntax.DETECTORS for only in syntax.SHOWN_BY[n]))


def _frequency(docs: DataFrame, level: str, min_freq: int, limit: int | None) -> DataFrame:
    return frequency.frequency(annotation.RuleAnnotator().annotate(docs, (), (level,)), level, min_freq=min_freq, limit=limit)


def _keyness(docs: DataFrame, source: str, direction: str, limit: int | None) -> DataFrame:
    found = association.keyness_of_parts(tokens(docs.where("source is not null"), ("source",)), F.col("source") == source)
    return association.top_keyness(found, direction, limit) if limit else found.where(F.col("direction") == direction)


TOOLS: dict[str, Tool] = {
    "concordance": Tool("A word with what stands around it.", {"query": WORD, "window": Param(int, "Words on either side.", default=5, least=1, most=50), "case_sensitive": Param(bool, "Capitals matter.", default=False), "limit": LIMIT}, lambda docs, query, window, case_sensitive, limit: concordance.search_concordance(docs, query, case_sensitive, window, limit)),
    "frequency": Tool("How often words, lemmas or tags occur.", {"level": LEVEL, "min_freq": Param(int, "Least frequency.", default=1, least=1), "limit": LIMIT}, _frequency, counted=lambda level, **_: level == "text", of_counts=lambda docs, counts, level, min_freq, limit: frequency.shares(counts, min_freq, limit)),
    "collocations": Tool("Words that stand near a word more often than by chance.", {"query": WORD, "scope": Param(str, "What margins are counted in.", default="corpus", values=("corpus", "node_sentences")), "limit": LIMIT}, lambda docs, query, scope, limit: association.collocations(docs, query, scope=scope, limit=limit)),
    "keyness": Tool("Words of one source against those of all others.", {"source": Param(str, "The source.", least=1, most=200), "direction": Param(str, "More or less frequent there.", default="positive", values=("positive", "negative")), "limit": LIMIT}, _keyness),
    "dispersion": Tool("How evenly a word is spread over documents or sources.", {"query": WORD, "part": Param(str, "The parts.", default="doc_id", values=("doc_id", "source"))}, lambda docs, query, part: frequency.dispersion(docs, query, part=part)),
    "ngrams": Tool("Runs of words.", {"n": Param(int, "Words in a run.", default=2, least=2, most=8), "min_freq": Param(int, "Least frequency.", default=2, least=1), "min_range": Param(int, "Least number of documents.", default=1, least=1), "limit": LIMIT}, lambda docs, n, min_freq, min_range, limit: frequency.ngrams(docs, n, min_freq=min_freq, min_range=min_range, limit=limit)),
    "statistics": Tool("Documents, sentences, words and types.", {}, counted=lambda: True, of_counts=lambda docs, counts: frequency.corpus_statistics(docs, known=counts)),
    "grammar": Tool("Passives, modals, negations, relative clauses, noun phrases and tenses.", {"patterns": Param(list, "Which of them, all by default.", default=None, least=1)}, wants=_shown, of_tokens=lambda t, patterns: syntax.grammar(t, patterns)),
    "dependency_pairs": Tool("Pairs of governor and dependent in a relation.", {"relation": Param(str, "The relation.", default="nsubj", values=tuple(annotation.RELATIONS)), "limit": LIMIT}, wants=lambda relation, limit: Wanted(PAIR, {"dep_rel": (relation,)}, PAIR), of_tokens=lambda t, relation, limit: syntax.dependency_pairs(t, relation, limit)),
    "tags": Tool("Shares of word classes.", {}, wants=lambda: Wanted(("pos",), {}, ("pos",)), of_tokens=lambda t: syntax.pos_distribution(t)),
    "sentiment": Tool("Sentences by positive and negative words.", {"positive": Param(list, "Positive words.", default=None, least=1), "negative": Param(list, "Negative words.", default=None, least=1)}, lambda docs, positive, negative: lexical.sentiment(docs, *([positive, negative] if positive and negative else []))),
    "redaction": Tool("Texts without sentences that have listed words.", {"words": Param(list, "The words.", default=None, least=1)}, lambda docs, words: lexical.redact_sentences(docs, words)),
    "clean": Tool("Cleaned texts.", {"lowercase": Param(bool, "Lower case.", default=False), "remove_punctuation": Param(bool, "No punctuation.", default=False), "remove_stop_words": Param(bool, "No stop words.", default=False), "min_token_length": Param(int, "Least length of a word.", default=0, least=0, most=100)}, lambda docs, **options: docs.select("doc_id", cleaning.clean_text(F.col("text"), cleaning.CleanOptions(**options)).alias("text"))),
    "languages": Tool("Which language each text is in, by profiles of the corpus's own languages.", {"default": Param(str, "The language of short texts.", default=None)}, lambda docs, default: language.detect_own(docs, default=default)),
    "roots": Tool("Arabic roots and their frequency.", {}, lambda docs: arabic.root_frequency(arabic.word_analysis(docs))),
    "subcorpus": Tool("Documents by their metadata.", {"year_min": Param(str, "First year.", default=None), "year_max": Param(str, "Last year.", default=None), "genre": Param(str, "The genre.", default=None)}, lambda docs, year_min, year_max, genre: subcorpus(docs, year_min=year_min, year_max=year_max, **({"genre": genre} if genre else {}))),
}


def schemas() -> list[dict]:
    """Name, description and parameters of every tool, as tool-calling clients expect them."""
    out = []
    for name, tool in TOOLS.items():
        required = [k for k, p in tool.params.items() if p.default is ...]
        out.append({"name": name, "description": tool.about, "parameters": {"type": "object", "properties": {k: p.schema() for k, p in tool.params.items()}, "required": required, "additionalProperties": False}})
    return out


def checked(name: str, arguments: dict | str | None) -> dict:
    """All arguments of a call, with defaults; ToolError if it cannot be made."""
    if name not in TOOLS:
        raise ToolError(f"unknown tool {name!r}; there are {', '.join(TOOLS)}")
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except json.JSONDecodeError as e:
            raise ToolError(f"{name}: arguments are no JSON: {e}") from None
    arguments = {} if arguments is None else arguments
    if not isinstance(arguments, dict):
        raise ToolError(f"{name}: arguments have to be an object")
    params = TOOLS[name].params
    if unknown := sorted(set(arguments) - set(params)):
        raise ToolError(f"{name}: unknown arguments {', '.join(unknown)}")
    out = {}
    for k, p in params.items():
        if k not in arguments and p.default is ...:
            raise ToolError(f"{name}: {k} is missing")
        out[k] = p.checked(name, k, arguments[k]) if k in arguments else p.default
    return out


def call(docs: DataFrame, name: str, arguments: dict | str | None = None) -> DataFrame:
    """The result of a tool over documents (doc_id, text, and lang, source or meta where a tool needs them)."""
    return call_all(docs, {name: (name, arguments)})[name]


def call_all(docs: DataFrame, calls: dict[str, tuple[str, dict | str | None]]) -> dict[str, DataFrame]:
    """Results of calls, {key: (tool, arguments)}; what several of them are made of is made once for all.

    Tools that look at annotated tokens share one pass that annotates them, those that count words one count; all calls are
    checked before anything is made.
    """
    values = {key: checked(name, arguments) for key, (name, arguments) in calls.items()}
    own = {key: TOOLS[name] for key, (name, _) in calls.items()}

    def of_operator(key: str, make: Callable[[], object]):
        try:
            return make()
        except ToolError:
            raise
        except ValueError as e:  # what only the operator itself can tell, such as unknown patterns
            raise ToolError(f"{calls[key][0]}: {e}") from None

    wanted = {key: of_operator(key, lambda tool=tool, key=key: tool.wants(**values[key])) for key, tool in own.items() if tool.wants}
    if len(wanted) > 1:
        tables = dict(zip(wanted, annotation.RuleAnnotator().tables(docs, list(wanted.values())), strict=True))
    else:
        tables = {key: annotation.RuleAnnotator().annotate(docs, (), w.columns, w.only, w.by) for key, w in wanted.items()}
    counting = [key for key, tool in own.items() if tool.counted and tool.counted(**values[key])]
    counts = stored(frequency.count_items(frequency.words(docs), "text_lc"), "word-counts") if counting else None
    out = {}
    for key, tool in own.items():
        if key in tables:
            out[key] = of_operator(key, lambda tool=tool, key=key: tool.of_tokens(tables[key], **values[key]))
        elif key in counting:
            out[key] = of_operator(key, lambda tool=tool, key=key: tool.of_counts(docs, counts, **values[key]))
        else:
            out[key] = of_operator(key, lambda tool=tool, key=key: tool.run(docs, **values[key]))
    return out


def register_views(docs: DataFrame, calls: dict[str, tuple[str, dict]]) -> None:
    """Results of calls as temporary views, for SQL: {view: (tool, arguments)}; all are checked before the first is made."""
    for view, found in call_all(docs, calls).items():
        found.createOrReplaceTempView(view)
