"""Diagrams put together again from their boxes: by the names that the boxes carry, or by where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window as W

from ..plans.staging import release, staged
from .components import components

# How members are named, the height of a reading row, from what distance boxes stand in different columns, which kinds pair boxes.
NAMED = r"^diagram:([^:]*):([^:]*):"
ROW, COLUMN = 20, 4
PAIRED, TWO = ("kpi", "timeline", "compare"), "compare"
#: The width of the finest cells, in points, and the levels of cells above them, each twice as wide.
CELL, LEVELS = 16.0, 40
#: Where more boxes than these have equal keys, they are compared on the grid, else in one row.
FEW = 32


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, those with equal keys in one task, in all of the session's shuffle partitions.

    Adaptive execution merges partitions up to a size as shuffled; sorted or
    hashed rows take twenty times as much, which is too much for a task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# -- by name ---------------------------------------------------------------------------


def members(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The elements that are named as parts of a diagram, with its kind and id."""
    part = lambda i: F.regexp_extract("name", NAMED, i)
    return elements.where(F.col("name").rlike(NAMED)).withColumn("kind", part(1)).withColumn("diagram", part(2))


def items(parts: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, kind, diagram, item_no, title, value, text) of the members' texts, in reading order.

    Boxes of the paired kinds whose left edges lie within one column give one
    item by twos: a value and its label, or a title and its text; a
    comparison has its first two.  Other boxes give one item each: the first
    line and the rest.  A column ends where the next edge is COLUMN points
    away.  Boxes of one place and number come in the order of their texts, so
    that reruns agree.
    """
    keys = [id_col, "slide_no", "kind", "diagram"]
    lines = F.filter(F.transform("lines", lambda t: F.trim(t)), lambda t: t != "")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    read = ["row", "x", "el_no", "head", "rest"]
    paired, kpi = F.col("kind").isin(*PAIRED), F.col("kind") == "kpi"
    rest = F.when(F.size("lines") > 1, F.array_join(F.slice("lines", F.lit(2), F.size("lines")), " "))
    rows = parts.select(*keys, "el_no", lines.alias("lines"), x.alias("x"), y.alias("y")).where(F.size("lines") > 0)
    rows = rows.select(*keys, "el_no", "x", F.floor(F.col("y") / ROW).alias("row"), F.col("lines")[0].alias("head"), F.when(paired, None).otherwise(rest).alias("rest"))
    rows = dealt(rows, id_col, "kind", "diagram")  # not by slide_no: where all have the same, Spark leaves it out of the windows and would shuffle once more
    along = W.partitionBy(*keys).orderBy("x", "el_no")
    apart = F.when(F.col("x") - F.lag("x").over(along) >= COLUMN, 1).otherwise(0)
    rows = rows.withColumn("apart", apart).withColumn("column", F.sum("apart").over(along.rowsBetween(W.unboundedPreceding, 0)))
    down = W.partitionBy(*keys, "column").orderBy(*read)
    rows = rows.withColumns({"nth": F.row_number().over(down), "below": F.lead("head").over(down)}).where(~paired | (F.col("nth") % 2 == 1))
    rows = rows.select(
        *keys, F.row_number().over(W.partitionBy(*keys).orderBy(*read)).alias("item_no"), F.when(kpi, F.coalesce("below", "head")).otherwise(F.col("head")).alias("title"),
        F.when(kpi, F.col("head")).alias("value"), F.when(paired, F.col("below")).otherwise(F.col("rest")).alias("text"),
    )
    return rows.where((F.col("kind") != TWO) | (F.col("item_no") <= 2))


def diagrams(parts: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, kind, diagram, el_no, n, x, y, w, h): one row per diagram, at its first member's place, around all its boxes.

    A diagram without a text or without a box is none; its members stay what they are.
    """
    keys = [id_col, "slide_no", "kind", "diagram"]
    said = F.exists("lines", lambda t: F.trim(t) != "")
    rows = parts.groupBy(*keys).agg(F.min("el_no").alias("el_no"), F.count(F.lit(1)).alias("n"), F.max(said).alias("said"), *_around())
    return rows.where("said and x is not null").drop("said")


def _around() -> list[Column]:
    """Position and size of the box around all boxes of a group."""
    x, y = F.min("x"), F.min("y")
    return [x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h")]


def regrouped(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The element table with ``kind`` and ``items``, in which one row of type ``diagram`` stands for the members of each named diagram.

    Items are gathered per diagram of one slide; :func:`items` has them as rows.
    """
    keys = [id_col, "slide_no", "kind", "diagram"]
    parts = members(elements, id_col)
    whole = diagrams(parts, id_col)
    of = F.transform(F.array_sort(F.collect_list(F.struct("item_no", "title", "value", "text"))), lambda i: F.struct(i["title"].alias("title"), i["value"].alias("value"), i["text"].alias("text")))
    whole = whole.join(items(parts, id_col).groupBy(*keys).agg(of.alias("items")), keys)
    gone = parts.join(whole.select(*keys), keys).select(id_col, "slide_no", "el_no")
    rest = elements.join(gone, [id_col, "slide_no", "el_no"], "left_anti")
    return rest.unionByName(whole.withColumn("type", F.lit("diagram")).drop("diagram", "n"), allowMissingColumns=True)


# -- by place ---------------------------------------------------------------------------


def touching(boxes: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """(a, b) of the boxes (node, x, y, w, h) with equal keys that lie at most ``gap`` apart in both directions, each pair once.

    A band join on a grid of levels: a box has at most four cells of the level
    that is about as wide as itself, and visits as few of each wider level, so
    neither small nor large boxes fill many cells.  A pair is told only in
    the cell that holds the corner of its overlap.
    """
    by = gap / 2
    lo = {"x0": F.col("x") - by, "y0": F.col("y") - by, "x1": F.col("x") + F.col("w") + by, "y1": F.col("y") + F.col("h") + by}
    wide = F.greatest(F.col("w"), F.col("h")) + gap
    level = F.when(wide <= CELL, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log2(wide / CELL))))
    rows = boxes.select(*keys, "node", *[c.alias(n) for n, c in lo.items()], level.cast("int").alias("level")).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    present = sorted(r["level"] for r in rows.select("level").distinct().collect())  # LEVELS + 1 numbers at most

    def cells(frame: DataFrame, at: Column) -> DataFrame:
        size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("at"))
        span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
        return frame.withColumn("at", F.explode(at)).withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))

    own = cells(rows, F.array("level")).alias("p")
    visits = cells(rows, F.filter(F.array(*[F.lit(k) for k in present]), lambda k: k >= F.col("level"))).alias("q")
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    same = [p(c).eqNullSafe(q(c)) for c in keys] + [p(c) == q(c) for c in ("at", "cx", "cy")]
    once = (q("level") < p("level")) | (p("node") < q("node"))
    meet = (p("x0") <= q("x1")) & (q("x0") <= p("x1")) & (p("y0") <= q("y1")) & (q("y0") <= p("y1"))
    size = F.lit(CELL) * F.pow(F.lit(2.0), p("at"))
    corner = (F.floor(F.greatest(p("x0"), q("x0")) / size) == p("cx")) & (F.floor(F.greatest(p("y0"), q("y0")) / size) == p("cy"))
    on = once & meet & corner
    for c in same:
        on = on & c
    return own.join(visits, on).select(F.least(p("node"), q("node")).alias("a"), F.greatest(p("node"), q("node")).alias("b"))


def groups_of_boxes(boxes: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """(keys, node, grp, x, y, w, h): boxes reachable over others at most ``gap`` apart have the same group, named by its least node.

    Boxes whose keys are shared by few are gathered and compared in one row;
    only the others, and those whose node stands under several keys, go over
    the grid and its links.  Boxes with the same node belong together.  A box
    with a null place or size is linked with no other node.
    """
    inside = [F.col(k).alias(f"in_{k}") for k in keys]
    of = F.xxhash64(*keys)
    astray = dealt(boxes.select("node", of.alias("of")), "node").groupBy("node").agg(F.min("of").alias("one"), F.max("of").alias("other")).where("one <> other").select(F.col("node").alias("in_node"))
    astray = boxes.join(astray, F.col("node") == F.col("in_node"), "left_semi").select(*inside)
    crowded = staged(boxes.groupBy(*keys).count().where(F.col("count") > FEW).select(*inside).union(astray).distinct())
    if crowded.isEmpty():
        release(crowded)
        return _grouped_in_rows(boxes, keys, gap)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"in_{k}"))
    few, many = boxes.join(crowded, same, "left_anti"), boxes.join(crowded, same, "left_semi")
    return _grouped_in_rows(few, keys, gap).unionByName(_grouped_by_links(many, keys, gap))


def _grouped_in_rows(boxes: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Groups of boxes that are few for each key: taken by node, each box joins the groups of those before it that it touches."""
    place, by = ["x", "y", "w", "h"], gap / 2
    near = lambda p, q, at, size: (p[at] - by <= q[at] + q[size] + by) & (q[at] - by <= p[at] + p[size] + by)
    equal = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"]) & (p["w"] == q["w"]) & (p["h"] == q["h"])
    meet = lambda p, q: (p["node"] == q["node"]) | (near(p, q, "x", "w") & near(p, q, "y", "h")) | equal(p, q)

    def joined(groups: Column, box: Column, met: Column) -> Column:
        least = F.array_min(met)
        return F.concat(F.transform(groups, lambda g: F.when(F.array_contains(met, g), least).otherwise(g)), F.array(F.coalesce(least, box["node"])))

    def added(groups: Column, box: Column) -> Column:
        met = F.filter(groups, lambda _, i: meet(F.get("boxes", i), box))
        return F.get(F.transform(F.array(met), lambda m: joined(groups, box, m)), F.lit(0))

    rows = dealt(boxes.select(*keys, "node", *place), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", *place))).alias("boxes"))
    none = F.array().cast(ArrayType(boxes.schema["node"].dataType))
    rows = rows.withColumn("groups", F.aggregate("boxes", none, added))
    rows = rows.select(*keys, F.explode(F.arrays_zip("boxes", "groups")).alias("of"))
    return rows.select(*keys, "of.boxes.node", F.col("of.groups").alias("grp"), *[f"of.boxes.{c}" for c in place])


def _grouped_by_links(boxes: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Groups of boxes, however many have equal keys; those that are equal are linked to one of them and compared once."""
    place = ["x", "y", "w", "h"]
    first = staged(boxes.groupBy(*keys, *place).agg(F.min("node").alias("node")))
    same = first.withColumnRenamed("node", "b").select(*keys, *place, "b")
    equal = boxes.where("x is not null and y is not null and w is not null and h is not null").join(same, [*keys, *place]).select(F.col("node").alias("a"), "b").where("a <> b")
    linked = components(touching(first, keys, gap).union(equal)).select(F.col("id").alias("node"), F.col("component").alias("grp"))
    return boxes.join(linked, "node", "left").select(*keys, "node", F.coalesce("grp", "node").alias("grp"), *place)


def drawn(elements: DataFrame, gap: float = 12.0, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, el_no, n, members, x, y, w, h): groups of two shapes or more that no diagram's name holds together, by place."""
    node = F.struct(id_col, "slide_no", "el_no")
    shapes = elements.where((F.col("type") == "shape") & ~F.coalesce(F.col("name"), F.lit("")).rlike(NAMED)).select(id_col, "slide_no", "x", "y", "w", "h", node.alias("node"))
    grouped = groups_of_boxes(shapes, [id_col, "slide_no"], gap)
    rows = grouped.groupBy(id_col, "slide_no", "grp").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("node.el_no")).alias("members"), *_around())
    return rows.where("n > 1").select(id_col, "slide_no", F.col("grp.el_no").alias("el_no"), "n", "members", "x", "y", "w", "h")
