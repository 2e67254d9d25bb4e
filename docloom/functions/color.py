"""CSS colours and lengths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PX_PER_PT = 96 / 72


def css_color(c: Column) -> Column:
    """``#RRGGBB`` of rgb(), rgba() or hex notation; null if transparent or unknown."""
    v = F.trim(c)
    rgb = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)(?:\s*,\s*([\d.]+))?"
    part = lambda i: F.lpad(F.hex(F.least(F.lit(255), F.regexp_extract(v, rgb, i).cast("decimal(20,0)").cast("long"))), 2, "0")
    short = F.regexp_extract(v, r"^#([0-9A-Fa-f]{3})$", 1)
    return (
        F.when(v.rlike(rgb), F.when(F.coalesce(F.regexp_extract(v, rgb, 4).try_cast("double"), F.lit(1.0)) != 0, F.concat(F.lit("#"), part(1), part(2), part(3))))
        .when(v.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(v))
        .when(short != "", F.upper(F.concat(F.lit("#"), *[F.repeat(F.substring(short, i, 1), 2) for i in (1, 2, 3)])))
    )


def px_to_pt(c: Column) -> Column:
    """Points with one decimal of a ``px`` length; null for others."""
    return F.bround(F.regexp_extract(F.trim(c), r"^([\d.]+)px", 1).try_cast("double") / F.lit(PX_PER_PT), 1)


def channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")


def is_dark(c: Column, exact: bool = False) -> Column:
    """Whether the weighted brightness is below 128; in doubles, which put some colours of exactly 128 below it, or in whole thousandths."""
    r, g, b = (channel(c, i) for i in range(3))
    return 299 * r + 587 * g + 114 * b < 128_000 if exact else 0.299 * r + 0.587 * g + 0.114 * b < 128


def luma(c: Column) -> Column:
    return 0.2126 * channel(c, 0) / 255 + 0.7152 * channel(c, 1) / 255 + 0.0722 * channel(c, 2) / 255


def chroma(c: Column) -> Column:
    parts = [channel(c, i) for i in range(3)]
    return (F.greatest(*parts) - F.least(*parts)) / 255


def brighter(c: Column, amount: float) -> Column:
    """Toward white for a positive amount, toward black for a negative one; halves to even."""
    def to(i: int) -> Column:
        x = channel(c, i)
        moved = x + (255 - x) * F.lit(amount) if amount >= 0 else x * F.lit(1 + amount)
        return F.lpad(F.hex(F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), moved.cast("double")))).cast("long")), 2, "0")

    return F.concat(F.lit("#"), *[to(i) for i in range(3)])


#: The properties that an inline style may carry.
INLINE = ("color", "background-color", "background", "font-size", "font-weight", "text-align", "float")


def inline_style(c: Column) -> Column:
    """Map of the allowed properties of a style attribute; colours only if they can be read."""
    pairs = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: p.contains(":")), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v")))
    shade = lambda v: F.regexp_extract(v, r"(#[0-9A-Fa-f]{3,6}|rgba?\([^)]*\))", 1)
    pairs = F.transform(pairs, lambda p: F.struct(F.when(p["k"] == "background", "background-color").otherwise(p["k"]).alias("k"), F.when(p["k"] == "background", shade(p["v"])).otherwise(p["v"]).alias("v")))
    ok = lambda p: p["k"].isin(*INLINE) & (p["v"] != "") & (~p["k"].isin("color", "background-color") | css_color(p["v"]).isNotNull())
    good = F.filter(pairs, ok)
    #: the last of equal properties stands
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(good, lambda p: p["k"])), lambda k: F.struct(k, F.element_at(F.filter(good, lambda p: p["k"] == k), -1)["v"])))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; null for null."""
    return F.transform(F.array(value), use)[0]


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _rgb(parts: list[Column]) -> Column:
    return F.struct(*[p.cast("double").alias(n) for p, n in zip(parts, "rgb")])


def _hsl(rgb: Column) -> Column:
    """(hue in degrees, saturation, lightness) of shares of red, green and blue."""
    r, g, b = (rgb[c] for c in "rgb")
    ends = F.struct(F.greatest(r, g, b).alias("hi"), F.least(r, g, b).alias("lo"))

    def of(e: Column) -> Column:
        spread, total = e["hi"] - e["lo"], e["hi"] + e["lo"]
        turn = F.when(spread == 0, 0.0).when(e["hi"] == r, F.pmod((g - b) / spread, F.lit(6.0))).when(e["hi"] == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
        share = F.when(spread == 0, 0.0).when(total > 1, spread / (2 - total)).otherwise(spread / total)
        return F.struct((turn * 60).alias("h"), share.alias("s"), (total / 2).alias("l"))

    return bound(ends, of)


def _from_hsl(hsl: Column) -> Column:
    def of(x: Column) -> Column:
        chroma = (1 - F.abs(2 * x["l"] - 1)) * x["s"]
        turn = F.pmod(x["h"], F.lit(360.0)) / 60
        second = chroma * (1 - F.abs(turn % 2 - 1))
        sixth, least = F.floor(turn), x["l"] - chroma / 2
        #: the sixths of the wheel in which a channel is strongest, and second
        part = lambda most, some: least + F.when(sixth.isin(*most), chroma).when(sixth.isin(*some), second).otherwise(0.0)
        return _rgb([part((0, 5), (1, 4)), part((1, 2), (0, 3)), part((3, 4), (2, 5))])

    return bound(hsl, of)


def _step(rgb: Column, op: Column, value: Column) -> Column:
    """One step of :func:`transformed`; an unknown one changes nothing."""
    moved = lambda old, mod, off: F.when(op == mod, old * value).when(op == off, old + value).otherwise(old)
    wheel = lambda x: F.struct(moved(x["h"], "hueMod", "hueOff").alias("h"), _within(x["s"], moved(x["s"], "satMod", "satOff")).alias("s"), _within(x["l"], moved(x["l"], "lumMod", "lumOff")).alias("l"))
    linear = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    shown = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    goal = F.when(op == "tint", 1 - value).otherwise(0.0)
    gray = 0.299 * rgb["r"] + 0.587 * rgb["g"] + 0.114 * rgb["b"]
    return (
        F.when(op.rlike("^(lum|sat|hue)(Mod|Off)$"), _from_hsl(bound(_hsl(rgb), wheel)))
        .when(op.isin("shade", "tint"), _rgb([bound(_unit(linear(_unit(rgb[c])) * value + goal), shown) for c in "rgb"]))
        .when(op == "gray", bound(gray, lambda v: _rgb([v, v, v])))
        .when(op == "inv", _rgb([1 - rgb[c] for c in "rgb"]))
        .otherwise(rgb)
    )


def _within(old: Column, new: Column) -> Column:
    return F.when(old == new, old).otherwise(_unit(new))


def transformed(c: Column, steps: Column) -> Column:
    """A ``#RRGGBB`` colour after an array of steps (op, value) in order: lum, sat and hue Mod or Off, shade, tint, gray, inv.

    Values are fractions, of hueOff degrees.  Lightness steps work in HSL,
    shade and tint in linear light toward black and white.  Null steps change
    nothing, a null colour stays null; halves round to even.
    """
    start = _rgb([channel(c, i) / 255.0 for i in range(3)])
    to_hex = lambda rgb: F.concat(F.lit("#"), *[F.lpad(F.hex(F.bround(_unit(rgb[p]) * 255).cast("long")), 2, "0") for p in "rgb"])
    end = F.aggregate(F.coalesce(steps, F.array().cast("array<struct<op:string,value:double>>")), start, lambda rgb, s: _step(rgb, s["op"], s["value"]))
    return F.when(c.isNotNull(), bound(end, to_hex))
