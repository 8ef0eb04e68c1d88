"""Collocation and keyness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.tokens import sentences
from .concordance import at_matches
from .frequency import count_items


def neighbours(sents: DataFrame, node: str, window: int) -> DataFrame:
    """(collocate, o): lower-cased tokens within ``window`` of the node, itself left out; slices of each row, no join."""
    low = sents.select(F.transform("toks", lambda t: F.lower(t)).alias("toks"))
    at = at_matches(low, lambda t: t == node.lower()).withColumnRenamed("token_idx", "at")
    start = F.greatest(F.col("at") - window, F.lit(0))
    around = F.concat(F.slice("toks", start + 1, F.col("at") - start), F.slice("toks", F.col("at") + 2, F.lit(window)))
    return at.select(F.explode(around).alias("collocate")).groupBy("collocate").agg(F.count("*").alias("o"))


def collocations(docs: DataFrame, node: str, window: int = 5, min_freq: int = 3, scope: str = "corpus", limit: int | None = 100) -> DataFrame:
    """Collocates of a node with eight association scores.

    ``scope`` says what N and the marginal frequencies count: all tokens
    (``corpus``) or those of sentences that hold the node (``node_sentences``).
    ``o`` is capped by both marginals for the contingency table, ``o_raw`` is not;
    rows whose table would have a negative cell are left out.
    """
    if scope not in ("corpus", "node_sentences"):
        raise ValueError(f"unknown scope {scope!r}")
    sents = sentences(docs)
    own = sents.where(F.exists("toks", lambda t: F.lower(t) == node.lower()))
    base = own if scope == "node_sentences" else sents
    counts = count_items(base.select(F.explode("toks").alias("t")).select(F.lower("t").alias("w")), "w")
    totals = counts.agg(F.sum("freq").alias("n"), F.coalesce(F.sum(F.when(F.col("item") == node.lower(), F.col("freq"))), F.lit(0)).alias("fx"))
    pairs = neighbours(own, node, window).where(F.col("o") >= min_freq).join(counts, F.col("collocate") == F.col("item")).crossJoin(F.broadcast(totals))
    o, fx, fy, n = F.col("o"), F.col("fx"), F.col("freq"), F.col("n")
    a = F.least(o, fx, fy)
    cells = (a, fx - a, fy - a, n - fx - fy + a)
    some = pairs.where((cells[1] >= 0) & (cells[2] >= 0) & (cells[3] >= 0))
    forward, backward = m.delta_p(o, fx, fy, n)
    scores = {
        "mi": m.mutual_information(o, fx, fy, n),
        "t_score": m.t_score(o, fx, fy, n),
        "log_likelihood": m.log_likelihood(*cells),
        "chi_square": m.chi_square(*cells),
        "dice": m.dice(o, fx, fy),
        "log_dice": m.log_dice(o, fx, fy),
        "delta_p_yx": forward,
        "delta_p_xy": backward,
    }
    out = some.select("collocate", o.alias("o_raw"), a.alias("o"), "fx", fy.alias("fy"), "n", *(F.round(v, 4).alias(k) for k, v in scores.items()))
    if limit is None:
        return out
    strength = F.coalesce(F.nullif(F.col("log_likelihood"), F.lit(0.0)), F.nullif(F.col("mi"), F.lit(0.0)), F.col("o").cast("double"))
    return out.orderBy(F.desc(strength), "collocate").limit(limit)


def keyness(target: DataFrame, reference: DataFrame, min_freq: int = 5) -> DataFrame:
    """Keyness of terms of two (item, freq) lists: six measures and direction.

    N1 and N2 are the full sums of the lists.  A term needs ``min_freq`` on one
    side; the other side's true count is used, not zero.
    """
    n1 = target.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n1"))
    n2 = reference.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n2"))
    t = target.select(F.col("item").alias("term"), F.col("freq").alias("a"))
    r = reference.select(F.col("item").alias("term"), F.col("freq").alias("b"))
    both = t.join(r, "term", "full_outer").select("term", F.coalesce("a", F.lit(0)).alias("f1"), F.coalesce("b", F.lit(0)).alias("f2"))
    return _scored(both, n1.crossJoin(F.broadcast(n2)), min_freq)


def keyness_of_parts(tokens_df: DataFrame, is_target: Column, item: str = "text_lc", min_freq: int = 5) -> DataFrame:
    """``keyness`` of the tokens for which ``is_target`` holds against those for which it does not, counted in one pass."""
    one = F.count_if(is_target).alias("f1"), F.count_if(~is_target).alias("f2")
    both = tokens_df.groupBy(F.col(item).alias("term")).agg(*one).where("f1 + f2 > 0")
    return _scored(both, both.agg(F.coalesce(F.sum("f1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("f2"), F.lit(0)).alias("n2")), min_freq)


def _scored(both: DataFrame, totals: DataFrame, min_freq: int) -> DataFrame:
    both = both.where(F.greatest("f1", "f2") >= min_freq).crossJoin(F.broadcast(totals))
    scores = m.keyness_columns(F.col("f1"), F.col("f2"), F.col("n1"), F.col("n2"))
    ratio = scores["log_ratio"]
    direction = F.when(ratio > 0, "positive").when(ratio < 0, "negative").otherwise("none")
    return both.select("term", "f1", "f2", "n1", "n2", *(F.round(v, 4).alias(k) for k, v in scores.items()), direction.alias("direction"))


def top_keyness(scored: DataFrame, direction: str, limit: int = 100) -> DataFrame:
    return scored.where(F.col("direction") == direction).orderBy(F.desc("log_likelihood"), "term").limit(limit)


def network_layout(collocates: DataFrame, limit: int = 20) -> DataFrame:
    """Circle positions, edge widths and node radii of the strongest collocates, for drawing."""
    from pyspark.sql import Window

    top = collocates.orderBy(F.desc("log_likelihood"), "collocate").limit(limit)
    order = Window.orderBy(F.desc("log_likelihood"), "collocate")  # ``limit`` rows at most
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    angle = 2 * 3.141592653589793 * (F.row_number().over(order) - 1) / F.count("*").over(whole)
    strongest, most = F.max(F.abs("log_likelihood")).over(whole), F.max("o").over(whole)
    width = F.greatest(F.lit(0.5), 4 * F.abs("log_likelihood") / F.when(strongest > 0, strongest).otherwise(1.0))
    radius = 12 + 18 * F.col("o") / F.when(most > 0, most).otherwise(1)
    return top.select("collocate", F.round(F.cos(angle), 6).alias("x"), F.round(F.sin(angle), 6).alias("y"), F.round(width, 4).alias("edge_width"), F.round(radius, 4).alias("radius"))
