"""Rules over image measurements, region-text alignment and batch summaries.

Pixels come from decoded raw RGB (``analyse_pixels``); rule operators take its
columns, so they are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..sources.images import pieces, text_pixels
from .lexical import claims

#: Named colours of the alignment and their RGB.
COLOURS = {
    "red": (220, 50, 50), "crimson": (220, 20, 60), "scarlet": (255, 36, 0), "blue": (50, 50, 220), "navy": (0, 0, 128), "azure": (0, 127, 255), "green": (50, 180, 50), "olive": (128, 128, 0), "lime": (191, 255, 0),
    "yellow": (255, 255, 0), "gold": (255, 215, 0), "orange": (255, 165, 0), "amber": (255, 191, 0), "purple": (128, 0, 128), "violet": (238, 130, 238), "magenta": (255, 0, 255), "pink": (255, 192, 203),
    "white": (255, 255, 255), "black": (0, 0, 0), "grey": (128, 128, 128), "gray": (128, 128, 128), "brown": (139, 69, 19), "tan": (210, 180, 140),
}
#: Where the centre of a region has to be for a position term.
MIDDLE = "x > 0.3 and x < 0.7 and y > 0.3 and y < 0.7"
POSITIONS = {"left": "x < 0.4", "right": "x > 0.6", "top": "y < 0.4", "bottom": "y > 0.6", "center": MIDDLE, "centre": MIDDLE, "middle": MIDDLE}


def pixel_measures(pixels: np.ndarray) -> dict:
    """Colour and composition of an (h, w, 3) array."""
    h, w, _ = pixels.shape
    level = (pixels // 32).astype(np.int64)
    codes, counts = np.unique(level[..., 0] * 64 + level[..., 1] * 8 + level[..., 2], return_counts=True)
    top = sorted(zip(-counts, codes, strict=True))[:5]
    rgb = np.stack([codes // 64, codes // 8 % 8, codes % 8], axis=1) * 32 / 255.0
    high, low = rgb.max(axis=1), rgb.min(axis=1)
    spread = high - low
    saturation = np.divide(spread, high, out=np.zeros_like(high), where=high > 0)
    r, g, b = rgb.T
    with np.errstate(invalid="ignore", divide="ignore"):
        hue = np.where(high == r, ((g - b) / spread) % 6, np.where(high == g, (b - r) / spread + 2, (r - g) / spread + 4)) * 60
    vivid = saturation > 0.1
    warm = vivid & ((hue < 90) | (hue >= 270))
    n = counts.sum()
    grey = pixels @ np.array([0.299, 0.587, 0.114])
    # Saliency: distance from a blurred copy.
    pad = np.pad(grey, 2, mode="edge")
    blurred = sum(pad[i : i + h, j : j + w] for i in range(5) for j in range(5)) / 25
    salience = np.abs(grey - blurred)
    total = salience.sum()
    total = total if total > 1e-6 else 0.0  # a plain image leaves rounding errors only
    share = (lambda part: float(part.sum() / total)) if total else (lambda part: 0.5)
    across, down = salience.sum(axis=0), salience.sum(axis=1)
    thirds = []
    for tx in (w / 3, 2 * w / 3):  # around each crossing of the lines of thirds
        for ty in (h / 3, 2 * h / 3):
            part = salience[max(0, int(ty - 10)) : int(ty + 10), max(0, int(tx - 10)) : int(tx + 10)]
            thirds.append(round(float(part.sum() / total), 4) if total else 0.0)
    centre = share(salience[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4])
    return {
        "dominant": [f"#{c // 64 * 32:02x}{c // 8 % 8 * 32:02x}{c % 8 * 32:02x}" for _, c in top],
        "warm_cold": round(float((counts[warm].sum() - counts[vivid & ~warm].sum()) / n), 3),
        "brightness": round(float(grey.mean()), 1),
        "contrast": round(float(grey.std()), 1),
        "saturation": round(float((saturation * counts)[vivid].sum() / n), 3),
        "iv_left": round(share(salience[:, : w // 2]), 3),
        "iv_right": round(share(salience[:, w // 2 :]), 3),
        "iv_top": round(share(salience[: h // 2]), 3),
        "iv_bottom": round(share(salience[h // 2 :]), 3),
        "iv_centre": round(centre, 3),
        "salience_x": round(float(np.arange(w) @ across / total / w) if total else 0.5, 3),
        "salience_y": round(float(np.arange(h) @ down / total / h) if total else 0.5, 3),
        "shares": [round(float(-c / n) * 100, 2) for c, _ in top],
        "thirds": thirds,
        "balance": round(share(salience[:, w // 2 :]) - share(salience[:, : w // 2]), 3),
        "framing": round(1 - centre, 3),
    }


MEASURES = "dominant array<string>, warm_cold double, brightness double, contrast double, saturation double, iv_left double, iv_right double, iv_top double, iv_bottom double, iv_centre double, salience_x double, salience_y double, shares array<double>, thirds array<double>, balance double, framing double"


def analyse_pixels(images: DataFrame) -> DataFrame:
    """Measures of images given as (image_id, width, height, rgb binary); those without pixels are left out."""
    images = images.where("rgb is not null and width > 0 and height > 0")
    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "width", "height", "rgb").mapInArrow(_measured, f"image_id {kind}, {MEASURES}")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in MEASURES.split(", ")]
    lists = {"dominant": pa.list_(pa.string()), "shares": pa.list_(pa.float64()), "thirds": pa.list_(pa.float64())}
    kinds = [lists.get(n, pa.float64()) for n in names]
    for batch in pieces(batches, 3):
        batch = batch.filter(pc.fill_null(pc.greater(pc.multiply(batch.column("width"), batch.column("height")), 0), False))
        rows = [pixel_measures(np.frombuffer(x.as_py(), np.uint8).reshape(h, w, 3)) for w, h, x in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("rgb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], names=["image_id", *names])


def analyse_texts(docs: DataFrame) -> DataFrame:
    """``analyse_pixels`` of each text's image."""
    return text_pixels(docs, _measured, "image_id {}, " + MEASURES)


def _twice(x: Column) -> Column:
    return F.least(F.lit(1.0), x * 2)


def visual_grammar(measured: DataFrame) -> DataFrame:
    """(image_id, category, confidence) claims about layout, salience, framing and modality."""
    left, right, top, bottom, centre = (F.col(f"iv_{k}") for k in ("left", "right", "top", "bottom", "centre"))
    margin = 1 - centre
    modality = (F.col("saturation") + F.col("brightness") / 255) / 2
    rules = [
        ("information_value:given_new", F.abs(left - right) > 0.1, _twice(F.abs(left - right))),
        ("information_value:ideal_real", F.abs(top - bottom) > 0.1, _twice(F.abs(top - bottom))),
        ("information_value:centre_margin", centre > 0.6, _twice(centre - 0.5)),
        ("salience", F.lit(True), F.lit(0.9)),
        ("framing", (margin > 0.6) | (margin < 0.4), _twice(F.abs(margin - 0.5))),
        ("modality", (modality > 0.6) | (modality < 0.3), _twice(F.abs(modality - 0.5))),
    ]
    return claims(measured, rules, "image_id")




def metafunction_confidence(found: DataFrame) -> DataFrame:
    """Mean confidence of each metafunction."""
    group = F.when(F.col("category") == "modality", "interactive").otherwise("compositional")
    return found.groupBy(group.alias("metafunction")).agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("claims"))


def text_spans(captions: DataFrame, stop: list[str]) -> DataFrame:
    """(image_id, at, span): words of four letters or more, and colour or position terms; edge punctuation is stripped."""
    words = captions.select("image_id", F.posexplode(F.split(F.lower("caption"), r"\s+")).alias("at", "raw"))
    span = F.regexp_replace("raw", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    terms = [*COLOURS, *POSITIONS]
    return words.select("image_id", "at", span.alias("span")).where(((F.length("span") >= 4) | F.col("span").isin(terms)) & ~F.col("span").isin(stop))


def align_regions(regions: DataFrame, spans: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Score regions (image_id, region, x, y, r, g, b) against the text spans of the same image."""
    colour = F.lit(None).cast("double")
    for name, (r, g, b) in COLOURS.items():
        colour = F.when(F.col("span") == name, F.greatest(F.lit(0.0), 1 - 2 * m.colour_distance(F.col("r"), F.col("g"), F.col("b"), r, g, b))).otherwise(colour)
    place = F.lit(None).cast("double")
    for name, rule in POSITIONS.items():
        place = F.when(F.col("span") == name, F.when(F.expr(rule), 0.7).otherwise(0.0)).otherwise(place)
    score = F.coalesce(colour, place, F.lit(0.2))
    both = regions.join(spans, "image_id").withColumn("score", F.round(score, 6))
    return both.where(F.col("score") > threshold).select("image_id", "region", "at", "span", "score")


def cross_modal_relation(regions: DataFrame, alignments: DataFrame) -> DataFrame:
    """silence without alignments, reinforcement with a strong one, else complementarity."""
    best = alignments.groupBy("image_id").agg(F.max("score").alias("best"))
    base = regions.select("image_id").distinct().join(best, "image_id", "left")
    return base.select("image_id", F.when(F.col("best").isNull(), "silence").when(F.col("best") >= 0.5, "reinforcement").otherwise("complementarity").alias("relation"))


def theme_counts(claim_rows: DataFrame, limit: int = 10) -> DataFrame:
    """Categories of each framework with their counts, the ten most frequent of each."""
    from .syntax import top_rows

    counts = claim_rows.groupBy("framework", "category").agg(F.count("*").alias("freq"))
    return top_rows(counts, "framework", [F.desc("freq"), "category"], limit)
