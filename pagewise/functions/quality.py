"""Content quality score (0-100) as column expressions.

Five components — depth 30, readability 20, structure 20, media 15, SEO 15 —
a letter grade, and recommendation codes in a fixed emission order (first 8
kept).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewise.functions.text import round_half_even

MAX_SCORES = {"content_depth": 30, "readability": 20, "structure": 20, "media": 15, "seo_signals": 15}
MAX_RECOMMENDATIONS = 8

# Grade bands (lower bound, grade), highest first; below -> F.
GRADES = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D")]


def depth_score(wc: Column) -> Column:
    return (F.when(wc >= 2000, 30).when(wc >= 1000, 25).when(wc >= 500, 20)
             .when(wc >= 300, 15).when(wc >= 100, 8).otherwise(3))


def readability_score(fre: Column) -> Column:
    base = (F.when((fre >= 50) & (fre <= 80), 20).when((fre >= 40) & (fre <= 90), 15)
             .when(fre >= 30, 10).otherwise(5))
    return F.when(fre > 90, 12).otherwise(base)


def structure_score(h1: Column, h2: Column, sentences: Column) -> Column:
    s1 = F.when(h1 == 1, 8).when(h1 > 1, 4).otherwise(0)
    s2 = F.when(h2 >= 2, 8).when(h2 == 1, 5).otherwise(0)
    s3 = F.when(sentences >= 5, 4).otherwise(2)
    return s1 + s2 + s3


def media_score(total: Column, without_alt: Column) -> Column:
    ratio = (total - without_alt) / F.greatest(total, F.lit(1))
    return F.when(total > 0, F.lit(8) + round_half_even(F.lit(7.0) * ratio, 0).cast("int")).otherwise(0)


def seo_score(has_desc: Column, has_canonical: Column, has_og: Column, has_schema: Column) -> Column:
    return (F.when(has_desc, 5).otherwise(0) + F.when(has_canonical, 3).otherwise(0)
            + F.when(has_og, 4).otherwise(0) + F.when(has_schema, 3).otherwise(0))


def grade(total: Column) -> Column:
    expr = None
    for bound, g in GRADES:
        expr = F.when(total >= bound, g) if expr is None else expr.when(total >= bound, g)
    return expr.otherwise("F")


def recommendations(wc, fre, h1, h2, total_images, without_alt, has_desc, has_og, has_schema) -> Column:
    codes = [
        F.when(wc < 100, F.lit("THIN_CONTENT")),
        F.when(wc < 300, F.lit("SHORT_CONTENT")),
        F.when(fre < 30, F.lit("HARD_TO_READ")),
        F.when(fre > 90, F.lit("TOO_SIMPLE")),
        F.when(h1 > 1, F.lit("MULTIPLE_H1")),
        F.when(h1 <= 0, F.lit("MISSING_H1")),
        F.when(h2 <= 0, F.lit("MISSING_H2")),
        F.when((total_images > 0) & (without_alt > 0),
               F.concat(F.lit("IMAGES_WITHOUT_ALT:"), without_alt.cast("string"))),
        F.when(total_images <= 0, F.lit("NO_IMAGES")),
        F.when(~has_desc, F.lit("NO_META_DESCRIPTION")),
        F.when(~has_og, F.lit("NO_OPEN_GRAPH")),
        F.when(~has_schema, F.lit("NO_SCHEMA")),
    ]
    return F.slice(F.array_compact(F.array(*codes)), 1, MAX_RECOMMENDATIONS)


def quality_columns(wc, sentences, fre, h1, h2, total_images, without_alt,
                    has_desc, has_canonical, has_og, has_schema) -> dict[str, Column]:
    parts = {
        "content_depth": depth_score(wc),
        "readability": readability_score(fre),
        "structure": structure_score(h1, h2, sentences),
        "media": media_score(total_images, without_alt),
        "seo_signals": seo_score(has_desc, has_canonical, has_og, has_schema),
    }
    total = parts["content_depth"] + parts["readability"] + parts["structure"] + parts["media"] + parts["seo_signals"]
    return {
        **{f"score_{k}": v.cast("long") for k, v in parts.items()},
        "total_score": total.cast("long"),
        "grade": grade(total),
        "recommendations": recommendations(wc, fre, h1, h2, total_images, without_alt, has_desc, has_og, has_schema),
    }


def breakdown_map(prefix: str = "score_") -> Column:
    return F.create_map(*[x for k in MAX_SCORES for x in (F.lit(k), F.col(f"{prefix}{k}"))])


def max_scores_map() -> Column:
    return F.create_map(*[x for k, v in MAX_SCORES.items() for x in (F.lit(k), F.lit(v).cast("long"))])
