"""Patterns over annotated tokens (lemma, tag, morphology, dependency head and relation).

Heads are 1-based within the sentence, 0 is the root.  Tables of ``operators.annotation`` bring their heads'
columns along; for others, head lookups are equi-joins on (doc_id, sentence_idx, token_idx).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import CONCRETE_NOUNS, LIGHT_VERBS, MODALS
from ..sources.storage import stored
from .annotation import MODIFIERS
from .frequency import slide

KEY = ["doc_id", "sentence_idx"]


def evidence(prefix: str = "") -> Column:
    return F.concat_ws(":", "doc_id", "sentence_idx", f"{prefix}token_idx").alias("evidence_id")


def looked_up(t: DataFrame) -> DataFrame:
    """Every token with its head's place, text, lemma and tag; null for roots and heads outside the sentence.

    Annotators give these columns themselves, as a head is in the same sentence; other tables are joined with themselves.
    """
    if "head_text" in t.columns:
        return t.withColumn("head_idx", F.when(F.col("head_text").isNotNull(), F.col("dep_head") - 1))
    heads = t.select(*KEY, (F.col("token_idx") + 1).alias("dep_head"), F.col("token_idx").alias("head_idx"), F.col("text").alias("head_text"), F.col("lemma").alias("head_lemma"), F.col("pos").alias("head_pos"))
    return t.join(heads, [*KEY, "dep_head"], "left")


def with_heads(rows: DataFrame, tokens_df: DataFrame) -> DataFrame:
    """Each row with the place, text, lemma and tag of its head; rows without a head in the sentence are left out."""
    if "head_text" in rows.columns:
        return looked_up(rows).where("head_idx is not null")
    heads = tokens_df.select(*KEY, (F.col("token_idx") + 1).alias("dep_head"), F.col("token_idx").alias("head_idx"), F.col("text").alias("head_text"), F.col("lemma").alias("head_lemma"), F.col("pos").alias("head_pos"))
    return rows.join(heads, [*KEY, "dep_head"])


def _found(marker: Column | str, target: Column | str | None, when: Column) -> tuple[Column, Column, Column]:
    none = F.lit(None).cast("string")
    return when, F.col(marker) if isinstance(marker, str) else marker, none if target is None else F.col(target)


def row_patterns() -> dict[str, tuple[Column, Column, Column]]:
    """Patterns that a token and its head show by themselves: (condition, marker, target)."""
    morph = F.coalesce("morph", F.lit(""))
    headed = F.col("head_text").isNotNull()
    tense = F.when(morph.contains("Tense=Past"), "past").when(morph.contains("Tense=Pres"), "present").when(morph.contains("Tense=Fut"), "future")
    return {
        "passive": _found("text", "head_text", headed & F.col("dep_rel").isin("aux:pass", "auxpass")),
        "modal": _found("text", "head_text", headed & (F.col("dep_rel") == "aux") & F.lower("lemma").isin(MODALS)),
        "negation": _found("text", None, (F.col("dep_rel") == "neg") | ((F.col("pos") == "PART") & morph.contains("Neg"))),
        "relative_clause": _found("text", None, F.col("dep_rel").isin("acl:relc", "relcl")),
        "tense": _found(tense, "text", F.col("pos").isin("VERB", "AUX") & tense.isNotNull()),
    }


#: What a token has to have for each pattern: alternatives for an annotator's ``only``, which leave out most tokens that show none.
SHOWN_BY: dict[str, tuple[dict[str, object], ...]] = {
    "passive": ({"dep_rel": ("aux:pass", "auxpass")},),
    "modal": ({"dep_rel": ("aux",)},),
    "negation": ({"dep_rel": ("neg",)}, {"pos": ("PART",)}),
    "relative_clause": ({"dep_rel": ("acl:relc", "relcl")},),
    "complex_np": ({"pos": ("NOUN",), "modifiers": lambda m: pc.greater_equal(pc.list_value_length(m), 2)},),
    "tense": ({"pos": ("VERB", "AUX"), "morph": lambda m: pc.match_substring(m, "Tense=")},),
}


def complex_noun_phrases(t: DataFrame) -> DataFrame:
    """Nouns with two or more modifiers; the modifiers in text order.  Without a column ``modifiers`` they are grouped by their heads."""
    if "modifiers" in t.columns:
        found = t.where((F.col("pos") == "NOUN") & (F.size("modifiers") >= 2))
        return found.select(*KEY, "token_idx", F.lit("complex_np").alias("pattern"), F.array_join("modifiers", " ").alias("marker"), F.col("text").alias("target"), evidence())
    found = with_heads(t.where(F.col("dep_rel").isin(*MODIFIERS)), t).where(F.col("head_pos") == "NOUN")
    grouped = found.groupBy(*KEY, F.col("head_idx").alias("token_idx"), F.col("head_text").alias("target")).agg(F.array_sort(F.collect_list(F.struct("token_idx", "text"))).alias("m")).where(F.size("m") >= 2)
    return grouped.select(*KEY, "token_idx", F.lit("complex_np").alias("pattern"), F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("marker"), "target", evidence())


DETECTORS = ("passive", "modal", "negation", "relative_clause", "complex_np", "tense")


def grammar(t: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """All matches of the named patterns (all by default): one pass for those that a token shows, and one for noun phrases if modifiers are not given."""
    names = list(patterns or DETECTORS)
    unknown = set(names) - set(DETECTORS)
    if unknown:
        raise ValueError(f"unknown patterns: {', '.join(sorted(unknown))}")
    own = row_patterns()
    if "modifiers" in t.columns:
        own["complex_np"] = _found(F.array_join("modifiers", " "), "text", (F.col("pos") == "NOUN") & (F.size("modifiers") >= 2))
    out = None
    if shown := [n for n in names if n in own]:
        any_ = own[shown[0]][0]
        for n in shown[1:]:
            any_ = any_ | own[n][0]
        structs = [F.when(own[n][0], F.struct(F.lit(n).alias("pattern"), own[n][1].alias("marker"), own[n][2].alias("target"))) for n in shown]
        # Most tokens show no pattern: they leave before structs are made.
        rows = t if "head_text" in t.columns else looked_up(t)
        found = rows.where(any_).select(*KEY, "token_idx", F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("p"))
        out = found.select(*KEY, "token_idx", "p.pattern", "p.marker", "p.target", evidence())
    if "complex_np" in names and "complex_np" not in own:
        phrases = complex_noun_phrases(t)
        out = phrases if out is None else out.unionByName(phrases)
    return out


def grammar_counts(t: DataFrame, patterns: list[str] | None = None, examples: int = 3, tokens_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Number of matches of each pattern, and the first few evidence ids.

    These stand in the first few documents that have the pattern.  ``tokens_of(ids)`` gives the token table of such documents (a column doc_id),
    which spares an annotator all others; without it they are looked up in ``t``.
    """
    by_doc = stored(grammar(t, patterns).groupBy("pattern", "doc_id").agg(F.count("*").alias("n")), "grammar-counts")
    first = F.slice(F.array_sort(F.collect_list(F.struct(*KEY, "token_idx", "evidence_id"))), 1, examples)
    counts = by_doc.groupBy("pattern").agg(F.sum("n").alias("freq"))
    ids = F.broadcast(top_rows(by_doc, "pattern", ["doc_id"], examples).select("doc_id").distinct())
    some = tokens_of(ids) if tokens_of else t.join(ids, "doc_id", "left_semi")
    # Each partition is cut to its first few before the shuffle, so no group is gathered whole.
    ranked = top_rows(grammar(some, patterns), "pattern", [*KEY, "token_idx", "evidence_id"], examples)
    return counts.join(ranked.groupBy("pattern").agg(F.transform(first, lambda x: x["evidence_id"]).alias("examples")), "pattern", "left")


def top_rows(df: DataFrame, group: str | list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k rows a group before the shuffle."""
    groups = [group] if isinstance(group, str) else group
    ranked = df.withColumn("rank_", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("rank_") <= k).drop("rank_")


def dependency_pairs(t: DataFrame, relation: str = "nsubj", limit: int | None = 100, examples: int = 0) -> DataFrame:
    """Governor and dependent lemmas of a relation, how often, and with ``examples`` the places of the first few.

    ``t`` may be parts by lemma, head's lemma and relation with their number ``n``, if no examples are asked for.
    """
    pair = ["governor", "dependent"]
    own = t.where(F.col("dep_rel") == relation)
    found = own.where("head_lemma is not null") if "n" in t.columns else with_heads(own, t)
    found = found.withColumns({"governor": F.col("head_lemma"), "dependent": F.col("lemma")})
    if examples:  # counts and places read them
        found = stored(found.select(*pair, *KEY, "token_idx"), "dependency-pairs")
    out = found.groupBy(*pair).agg(_freq(found))
    if examples:
        first = top_rows(found.select(*pair, *KEY, "token_idx", evidence()), pair, [*KEY, "token_idx", "evidence_id"], examples)
        places = first.groupBy(*pair).agg(F.transform(F.array_sort(F.collect_list(F.struct(*KEY, "token_idx", "evidence_id"))), lambda x: x["evidence_id"]).alias("examples"))
        same = [out[c].eqNullSafe(places[c]) for c in pair]
        out = out.join(places.hint("merge"), same).select(out["governor"], out["dependent"], "freq", "examples")
    return out if limit is None else out.orderBy(F.desc("freq"), "governor", "dependent").limit(limit)


def _freq(t: DataFrame) -> Column:
    """How many tokens, of a token table or of parts with their number ``n``."""
    return (F.sum("n") if "n" in t.columns else F.count("*")).alias("freq")


def pos_distribution(t: DataFrame) -> DataFrame:
    """Shares of tags, of a token table or of parts by tag."""
    counts = t.groupBy("pos").agg(_freq(t))
    # As few rows as there are tags: a window over them reads the texts once, whatever columns are asked for.
    return counts.select("pos", "freq", F.round(F.col("freq") / F.sum("freq").over(Window.partitionBy(F.lit(0))) * 100, 4).alias("percent"))


def pos_ngrams(t: DataFrame, n: int = 2, min_freq: int = 2, limit: int | None = 100) -> DataFrame:
    """Runs of n tags within sentences.  A table with each sentence's ``tags`` needs no grouping by sentence."""
    rows = t.where("token_idx = 0").select("tags") if "tags" in t.columns else t.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "pos"))), lambda x: x["pos"]).alias("tags"))
    out = rows.select(F.explode(slide(F.col("tags"), n)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    return out if limit is None else out.orderBy(F.desc("freq"), "pattern").limit(limit)


def metaphor_candidates(t: DataFrame, limit: int | None = 50, light: list[str] = LIGHT_VERBS, concrete: list[str] = CONCRETE_NOUNS) -> DataFrame:
    """Verbs that are not light whose first subject is an abstract noun."""
    subjects = with_heads(t.where("dep_rel = 'nsubj'"), t).where((F.col("head_pos") == "VERB") & ~F.lower("head_lemma").isin(light))
    first = subjects.groupBy(*KEY, F.col("head_idx").alias("at")).agg(F.min(F.struct("token_idx", "head_lemma", "lemma", "pos")).alias("s"))
    found = first.where((F.col("s.pos") == "NOUN") & ~F.lower("s.lemma").isin(concrete)).withColumnRenamed("at", "token_idx")
    out = found.select(*KEY, "token_idx", F.lower("s.head_lemma").alias("verb"), F.col("s.lemma").alias("subject"), evidence())
    return out if limit is None else out.orderBy(*KEY, "token_idx").limit(limit)
