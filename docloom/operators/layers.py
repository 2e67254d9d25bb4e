"""Values that the first of several layers decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color


def first_known(rows: DataFrame, keys: list[str], value: str = "value", rank: str = "rank") -> DataFrame:
    """(keys, value, rank): per key the value of the least rank that has one; keys with none don't appear.

    One hash aggregation with partial results, so a key's layers are never
    gathered; of equal ranks the least value stands.
    """
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.min(F.struct(F.col(rank).alias("rank"), F.col(value).alias("value"))).alias("x")).select(*keys, F.col("x.value").alias(value), F.col("x.rank").alias(rank))


def styled(runs: DataFrame, style: Column, default: Column) -> DataFrame:
    """Runs (color, size_pt, bold, align, inherited) with what a style says filled in where they say nothing; ``inherited`` names it.

    ``style`` and ``default`` are maps of CSS properties, of the run's own
    surroundings and of the page's body: a colour like the body's (black, if
    it has none) is no choice of anyone and stays out.  Sizes in px become
    points; weights from 600 and ``bold`` are bold.
    """
    says = lambda m, k: F.try_element_at(m, F.lit(k))
    weight = F.coalesce(says(style, "font-weight"), F.lit(""))
    shade = color.css_color(says(style, "color"))
    plain = F.coalesce(color.css_color(says(default, "color")), F.lit("#000000"))
    bold = (weight == "bold") | (weight.rlike(r"^\d{1,9}$") & (F.coalesce(weight.try_cast("int"), F.lit(0)) >= 600))
    found = {
        "color": F.when(F.col("color").isNull() & (shade != plain), shade),
        "size_pt": F.when(F.coalesce("size_pt", F.lit(0.0)) == 0, F.nullif(color.px_to_pt(says(style, "font-size")), F.lit(0.0))),
        "bold": F.when(~F.coalesce("bold", F.lit(False)) & bold, True),
    }
    marks = F.filter(F.array(*[F.when(v.isNotNull(), n) for n, v in found.items()]), lambda n: n.isNotNull())
    align = says(style, "text-align")
    return runs.withColumns(
        {n: F.coalesce(v, F.col(n)) for n, v in found.items()}
        | {"inherited": F.concat(F.coalesce("inherited", F.array().cast("array<string>")), marks), "align": F.coalesce("align", F.when(align.isin("center", "right", "justify"), align))}
    )
