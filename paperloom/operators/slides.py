"""PowerPoint decks from package rows to one unit per slide, relationally.

Placeholders inherit from layout and master by joins with a priority, list depth is a rank
within runs of list items, reading order a sort by rows of the slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import messages
from ..functions import markdown as md
from ..functions.regexkit import escaped, let, strip
from ..sources.stage import stage

NOWHERE = 10**12
TITLES = ("title", "ctrTitle")
BODIES = ("body", "obj")
EMPTY = "dia zonder tekst"


def inline(runs: Column) -> Column:
    """Pieces of a paragraph: escaped, external links, breaks, emphasis merged."""

    def piece(r: Column) -> Column:
        text = escaped(r["text"])
        lead, trail = F.regexp_extract(text, r"(?U)^(\s*)", 1), F.regexp_extract(text, r"(?U)(\s*)\z", 1)
        linked = r["url"].isNotNull() & (strip(text) != "")
        shown = F.when(r["brk"], F.lit("  \n")).when(linked, F.concat(lead, F.lit("["), strip(text), F.lit("]("), r["url"], F.lit(")"), trail)).otherwise(text)
        return F.struct(shown.alias("text"), F.when(linked | r["brk"], F.lit("")).otherwise(r["fmt"]).alias("fmt"))

    return strip(md.join_runs(F.transform(runs, piece)))


def inherited(shapes: DataFrame, slides: DataFrame, holders: DataFrame) -> DataFrame:
    """For each placeholder shape its match on the layout and on the master: by index first,
    then by type, the first of the part. (doc_id, z, l, m) with structs<y, x, levels>."""
    ph = shapes.filter("ph").join(slides.select("doc_id", "slide_no", "layout", "master"), ["doc_id", "slide_no"])
    at = F.struct("y", "x", "levels")

    def firsts(rank: int, key: str) -> DataFrame:
        """Of a part's placeholders with one index or type only the first can be a match."""
        one = holders.filter(F.col(key).isNotNull()).groupBy("doc_id", "part", F.lit(rank).alias("rank"), F.col(key).alias("key"))
        return one.agg(F.min_by(F.struct("seq", at.alias("at")), F.struct("seq")).alias("h"))

    looks = F.array(*(F.struct(F.lit(of).alias("of"), F.col(part).alias("part"), F.lit(rank).alias("rank"), F.col(key).alias("key")) for of, part in (("l", "layout"), ("m", "master")) for rank, key in ((0, "ph_idx"), (1, "ph_type"))))
    found = ph.select("doc_id", "z", F.inline(looks)).join(firsts(0, "idx").unionByName(firsts(1, "type")), ["doc_id", "part", "rank", "key"])
    best = lambda of: F.min_by("h.at", F.when(F.col("of") == of, F.struct("rank", "h.seq"))).alias(of)
    return found.groupBy("doc_id", "z").agg(best("l"), best("m"))


def text_bodies(bodies: DataFrame) -> DataFrame:
    """(doc_id, z, text) of rows (doc_id, z, paras, styles): styles is an array of level lists,
    nearest first. List depth counts indents within a run of list items."""
    p = bodies.select("doc_id", "z", "styles", F.posexplode("paras").alias("i", "p")).withColumn("t", inline(F.col("p.runs"))).filter("t <> ''")
    at = F.filter(F.flatten("styles"), lambda s: s["lvl"] == F.col("p.lvl"))
    first = lambda items: F.get(items, F.lit(0))
    style = F.struct(first(F.filter(at, lambda s: s["decided"]))["marker"].alias("marker"), first(F.filter(at, lambda s: s["margin"].isNotNull()))["margin"].alias("margin"))
    p = p.withColumn("s", style)
    p = p.select("doc_id", "z", "i", "t", F.when(F.col("p.decided"), F.col("p.marker")).otherwise(F.col("s.marker")).alias("marker"), F.coalesce("p.margin", "s.margin", "p.lvl").alias("margin"))
    body = Window.partitionBy("doc_id", "z")
    order = body.orderBy("i")
    p = p.withColumn("marker", F.when(F.count("*").over(body) > 1, F.col("marker")))  # a single item is a text
    plain = F.col("marker").isNull()
    p = p.withColumn("run", F.sum(plain.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    p = p.withColumn("depth", F.dense_rank().over(Window.partitionBy("doc_id", "z", "run", plain).orderBy("margin")) - 1)
    count = (F.col("marker") == "1.") & ~plain
    # Numbers restart under a shallower numbered item and after any text that is no item.
    before = Window.partitionBy("doc_id", "z", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    shallower = F.array(*(F.coalesce(F.sum(F.when(count & (F.col("depth") < d), 1).otherwise(0)).over(before), F.lit(0)) for d in range(1, 10)))
    p = p.withColumn("stretch", F.when(F.col("depth") == 0, 0).otherwise(F.get(shallower, F.least(F.col("depth"), F.lit(9)) - 1)))
    own = Window.partitionBy("doc_id", "z", "run", "depth", "stretch").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum(F.when(count, 1).otherwise(0)).over(own)
    mark = F.when(count, F.concat(number.cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    p = p.withColumn("line", F.when(plain, F.col("t")).otherwise(F.concat(F.repeat(F.lit("   "), F.col("depth")), mark, F.col("t"))))
    gap = F.when(F.lag("i").over(order).isNull(), F.lit("")).when(plain | F.lag(plain).over(order), F.lit("\n\n")).otherwise(F.lit("\n"))
    return p.select("doc_id", "z", "i", F.concat(gap, "line").alias("part")).groupBy("doc_id", "z").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("text"))


def table_text(cells: Column) -> Column:
    """A slide table: paragraphs and breaks as <br>, pipes escaped."""

    def cell(pieces: Column) -> Column:
        # Paragraphs end with a piece that is a single line feed.
        ended = F.aggregate(pieces, F.array(F.array().cast("array<struct<text:string,fmt:string,url:string,brk:boolean>>")), lambda acc, r: F.when(
            r["text"] == "\n", F.array_append(acc, F.array().cast("array<struct<text:string,fmt:string,url:string,brk:boolean>>"))
        ).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array_append(F.element_at(acc, -1), r)))))
        paras = F.filter(F.transform(ended, inline), lambda t: t != "")
        return F.replace(F.replace(F.array_join(paras, "<br>"), F.lit("  \n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))

    return md.render_table(F.transform(cells, lambda row: F.transform(row, cell)))


def chart_text(title: Column, points: Column) -> Column:
    """Cached chart values as a table: categories down, series across."""

    def put(p: Column) -> Column:
        heads = F.array_sort(F.filter(p, lambda x: x["series"].isNotNull() & x["idx"].isNull()))
        names = F.transform(heads, lambda h: F.coalesce(h["name"], F.concat(F.lit(messages.SERIES), (h["series"] + 1).cast("string"))))
        indices = F.array_sort(F.array_distinct(F.transform(F.filter(p, lambda x: x["idx"].isNotNull()), lambda x: x["idx"])))
        one = lambda keep, name: F.get(F.transform(F.filter(p, keep), lambda x: x[name]), F.lit(0))
        row = lambda i: F.concat(
            F.array(F.coalesce(one(lambda x: x["series"].isNull() & (x["idx"] == i), "category"), (i + 1).cast("string"))),
            F.transform(heads, lambda h: F.coalesce(one(lambda x: (x["series"] == h["series"]) & (x["idx"] == i), "value"), F.lit(""))),
        )
        table = md.render_table(F.concat(F.array(F.concat(F.array(F.lit("")), names)), F.transform(indices, row)))
        head = F.concat(F.lit(messages.CHART), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")), F.lit("_\n\n"))
        return F.when(F.size(heads) == 0, F.lit(messages.EMPTY_CHART)).otherwise(F.concat(head, table))

    return let(points, put)


def smartart_text(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), escaped(t))), "\n")


def convert(packages: DataFrame, slugs: DataFrame, notes: bool = True) -> DataFrame:
    """Units (doc_id, unit_no, title, markdown, warnings), one per slide."""
    slides = packages.select("doc_id", "height", F.explode("slides").alias("s")).select("doc_id", "height", "s.*")
    shapes = packages.select("doc_id", "height", F.explode("shapes").alias("s")).select("doc_id", "height", "s.*")
    holders = packages.select("doc_id", F.explode("holders").alias("h")).select("doc_id", "h.*")
    styles = packages.select("doc_id", F.explode("body_styles").alias("b")).select("doc_id", "b.master", F.col("b.levels").alias("body_levels"))
    shapes = shapes.join(inherited(shapes, slides, holders), ["doc_id", "z"], "left")
    shapes = shapes.withColumns({"y": F.coalesce("y", "l.y", "m.y", F.lit(NOWHERE)), "x": F.coalesce("x", "l.x", "m.x", F.lit(0))})
    shapes = stage(shapes, "slide-shapes")
    of_slide = slides.select("doc_id", "slide_no", "master").join(styles, ["doc_id", "master"], "left").drop("master")
    text = shapes.filter("kind = 'sp'").join(of_slide, ["doc_id", "slide_no"], "left")
    none = F.array().cast("array<struct<lvl:int,marker:string,decided:boolean,margin:int>>")
    chain = F.array(F.col("levels"), F.coalesce("l.levels", none), F.coalesce("m.levels", none), F.when(F.col("ph_type").isin(*BODIES), F.coalesce("body_levels", none)).otherwise(none))
    bodies = text_bodies(text.select("doc_id", "z", "paras", F.when(F.col("notes"), F.array(none)).otherwise(chain).alias("styles")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("slide_no", "z"))
    pics = shapes.filter("kind = 'pic'").join(slugs, "doc_id").withColumn("n", n)
    path = F.concat(F.lit("figures/"), F.col("slug"), F.lit("-dia"), F.col("slide_no").cast("string"), F.lit("-img"), F.col("n").cast("string"), F.lower(F.regexp_extract("image", r"(\.[^./]*)$", 1)))
    pics = pics.select("doc_id", "z", F.concat(F.lit("!["), escaped(md.clean_alt(F.col("alt"))), F.lit("]("), path, F.lit(")")).alias("text"))
    other = shapes.filter("kind IN ('tbl', 'chart', 'smartart')").select("doc_id", "z", F.when(F.col("kind") == "tbl", table_text(F.col("cells"))).when(F.col("kind") == "chart", chart_text(F.col("title"), F.col("points"))).otherwise(smartart_text(F.col("texts"))).alias("text"))
    leaves = shapes.select("doc_id", "slide_no", "z", "ancestors", "notes", "kind", "ph_type", "y", "x", "height").join(bodies.unionByName(pics).unionByName(other), ["doc_id", "z"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    placed = stage(grouped(stage(leaves, "slide-leaves")), "slide-placed")
    order = Window.partitionBy("doc_id", "slide_no").orderBy("row", "x", "z")
    top = placed.filter("NOT notes").withColumn("place", F.row_number().over(order))
    titled = F.col("ph_type").isNull() & (F.col("y") < F.col("height") * 0.25) & ~F.col("text").contains("\n") & (F.length("text") <= 120) & ~F.col("text").rlike(r"^(?:-|\d+\.) |^!\[|^\|")
    titles = top.groupBy("doc_id", "slide_no").agg(F.coalesce(F.min_by(F.when(F.col("ph_type").isin(*TITLES), F.col("text")), F.when(F.col("ph_type").isin(*TITLES), F.col("place"))), F.max(F.when((F.col("place") == 1) & titled, F.col("text"))), F.lit("")).alias("title"))
    body = top.join(titles, ["doc_id", "slide_no"]).filter("text <> title").groupBy("doc_id", "slide_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("body"))
    said = placed.filter("notes").groupBy("doc_id", "slide_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "text"))), lambda x: x["text"]), "\n\n").alias("said"))
    quoted = F.concat(F.lit(messages.NOTES + "\n\n"), F.array_join(F.transform(F.split("said", "\n", -1), lambda t: F.when(t == "", F.lit(">")).otherwise(F.concat(F.lit("> "), t))), "\n"))
    warned = shapes.filter("kind IN ('smartart', 'other')").groupBy("doc_id", "slide_no").agg(F.collect_set(F.when(F.col("kind") == "other", F.lit(messages.EMBEDDED)).otherwise(F.lit(messages.SMARTART))).alias("w"))
    out = slides.join(titles, ["doc_id", "slide_no"], "left").join(body, ["doc_id", "slide_no"], "left").join(said, ["doc_id", "slide_no"], "left").join(warned, ["doc_id", "slide_no"], "left")
    empty = F.array().cast("array<string>")
    title = F.replace(F.coalesce("title", F.lit("")), F.lit("  \n"), F.lit(" "))
    head = F.concat(F.lit(messages.SLIDE), F.col("slide_no").cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")), F.when(F.col("hidden"), F.lit(messages.HIDDEN_SLIDE)).otherwise(F.lit("")))
    return out.select(
        "doc_id", F.col("slide_no").alias("unit_no"), title.alias("title"),
        F.concat_ws("\n\n", head, F.coalesce("body", empty), F.when(F.lit(notes) & (F.col("said") != ""), quoted)).alias("markdown"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("w", empty), F.when(F.coalesce(F.size("body"), F.lit(0)) <= 0, F.array(F.lit(EMPTY))).otherwise(empty)))).alias("warnings"),
    )


def grouped(leaves: DataFrame) -> DataFrame:
    """Shapes with text, those of a group folded into one shape at the group's position. A shape's
    place is the path of places of the groups around it, so one sort orders any nesting."""
    row = F.floor(F.col("y") / F.greatest(F.lit(1), F.floor(F.col("height") * 0.05)))
    rows = leaves.withColumn("row", row)
    places = rows.select("doc_id", F.col("z").alias("a"), F.struct("row", "x", "z").alias("at"))
    # Charts and tables may be empty; texts that are do not stand on a slide.
    shown = rows.filter("kind NOT IN ('group', 'other') AND (text <> '' OR kind IN ('tbl', 'chart', 'smartart'))")
    steps = shown.select("doc_id", "z", F.posexplode(F.concat("ancestors", F.array("z"))).alias("d", "a")).join(places, ["doc_id", "a"])
    paths = steps.groupBy("doc_id", "z").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "at"))), lambda x: x["at"]).alias("path"))
    whole = shown.join(paths, ["doc_id", "z"]).withColumn("top", F.coalesce(F.get("ancestors", F.lit(0)), F.col("z")))
    units = whole.groupBy("doc_id", "slide_no", "notes", F.col("top").alias("z")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.max(F.when(F.size("ancestors") == 0, F.col("ph_type"))).alias("ph_type"),
    )
    return units.join(rows.select("doc_id", "z", "row", "x", "y", "height"), ["doc_id", "z"])
