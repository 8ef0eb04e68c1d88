"""Framework readings of an image with its caption: rules over colour measures and words.

Rows have an image_id, the measures of ``vision.analyse_pixels`` that a reading names, and
``caption`` and ``ocr`` texts (null: empty).  Every reading gives (image_id, category,
confidence); what a category says more than once stands after a colon.  All are plain
column expressions, so a reading shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from .lexical import claims, markers_found

CDA_FRAMEWORKS = ("fairclough", "van_dijk", "wodak", "machin_mayr")


def shown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def has_any(text: Column, words: list[str]) -> Column:
    return markers_found(text, words) > 0


def words_present(text: Column, words: list[str]) -> Column:
    """How many of the words occur between white space."""
    found = F.split(F.lower(text), r"\s+")
    return F.size(F.array_intersect(found, F.array(*map(F.lit, words))))


def colour_notes(measured: DataFrame) -> list[tuple[str, Column]]:
    """(note, condition): hue of the most frequent colour, the first that holds, and key by brightness."""
    first = F.try_element_at("dominant", F.lit(1))
    r, g, b = (F.conv(F.substring(first, at, 2), 16, 10).cast("int") for at in (2, 4, 6))
    # Bounds of the hue notes and of high and low key.
    hue = (
        F.when((r > 150) & (g < 100) & (b < 100), "red")
        .when((r > 200) & (g > 200) & (b < 100), "yellow")
        .when((g > 120) & (r < 120) & (b < 120), "green")
        .when((b > 120) & (r < 100) & (g < 100), "blue")
        .when((r > 150) & (g < 100) & (b > 150), "purple")
    )
    notes = [(k, hue == k) for k in ("red", "yellow", "green", "blue", "purple")]
    return [*notes, ("high_key", F.col("brightness") > 200), ("low_key", F.col("brightness") < 60)]


def social_semiotic(measured: DataFrame) -> DataFrame:
    """Symbolic colours, power of a salient centre, identity by first-person words."""
    centre = F.col("iv_centre")
    rules = [(f"symbolic_attribute:{k}", ok, F.lit(0.5)) for k, ok in colour_notes(measured)]
    rules.append(("power_relation", centre > 0.6, F.least(F.lit(1.0), (centre - 0.5) * 2)))
    rules.append(("identity", has_any(F.lower(shown("caption")), lexicons.FIRST_PERSON), F.lit(0.6)))
    return claims(measured, rules, "image_id")


def critical_discourse(measured: DataFrame, framework: str = "fairclough") -> DataFrame:
    """Critical discourse analysis by one of CDA_FRAMEWORKS."""
    warm = F.col("warm_cold")
    if framework == "fairclough":
        some_text = (shown("caption") != "") | (shown("ocr") != "")
        rules = [("textual_analysis", some_text, F.lit(0.5)), ("ideological_naturalization", F.col("saturation") > 0.5, F.least(F.lit(1.0), F.col("saturation")))]
    elif framework == "van_dijk":
        both = words_present(shown("caption"), lexicons.IN_GROUP) + words_present(shown("caption"), lexicons.OUT_GROUP)
        rules = [("us_them_polarization", both > 0, F.least(F.lit(1.0), both / 5))]
    elif framework == "wodak":
        rules = [("historical_context", F.lit(True), F.lit(0.4))]
    elif framework == "machin_mayr":
        rules = [("visual_evaluative_loading:warm", warm > 0.2, F.least(F.lit(1.0), F.abs(warm))), ("visual_evaluative_loading:cold", warm < -0.2, F.least(F.lit(1.0), F.abs(warm)))]
    else:
        raise ValueError(f"unknown framework {framework!r}; one of {', '.join(CDA_FRAMEWORKS)}")
    return claims(measured, rules, "image_id")


def visual_metaphor(measured: DataFrame) -> DataFrame:
    """Candidates only: warm and saturated images, and cold words beside warm colours."""
    warm, caption, ocr = F.col("warm_cold"), shown("caption"), shown("ocr")
    cold_words = has_any(F.lower(F.concat(caption, F.lit(" "), ocr)), lexicons.COLD_WORDS)
    return claims(
        measured,
        [
            ("visual_metaphor_candidate", (warm > 0.3) & (F.col("saturation") > 0.4), F.lit(0.4)),
            ("cross_modal_metaphor_candidate", (caption != "") & (ocr != "") & (warm > 0.2) & cold_words, F.lit(0.3)),
        ],
        "image_id",
    )


def combined_emotion(measured: DataFrame) -> DataFrame:
    """Emotion of the colours, of the words, and whether they disagree."""
    warm, bright = F.col("warm_cold"), F.col("brightness")
    tone = F.when((warm > 0.2) & (bright > 150), "positive/warm").when((warm < -0.2) & (bright < 100), "negative/cold").when(bright > 200, "positive/bright").otherwise("neutral")
    low = F.lower(F.concat(shown("ocr"), F.lit(" "), shown("caption")))
    rows = measured.select("image_id", tone.alias("tone"), markers_found(low, lexicons.GLAD_WORDS).alias("glad"), markers_found(low, lexicons.SAD_WORDS).alias("sad"))
    some, glad = F.col("glad") + F.col("sad"), F.col("glad") > F.col("sad")
    strength = F.least(F.lit(1.0), some / 5)
    rules = [(f"image_emotion:{k}", F.col("tone") == k, F.lit(0.5)) for k in ("positive/warm", "negative/cold", "positive/bright", "neutral")]
    rules += [("text_emotion:positive", (some > 0) & glad, strength), ("text_emotion:negative", (some > 0) & ~glad, strength)]
    rules.append(("emotional_mismatch", F.col("tone").startswith("positive") & (some > 0) & ~glad, F.lit(0.4)))
    return claims(rows, rules, "image_id")
