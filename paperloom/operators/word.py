"""Word documents from package rows to sections, relationally.

Lookups (styles, numbering, relationships) are joins on the document and a key, numbering and
section splits are windows over the paragraphs' order. All of them partition by document, so
one exchange serves them; figures' bytes stay in a table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import messages
from ..functions import markdown as md
from ..functions.regexkit import escaped, let, strip
from ..sources.stage import stage

ITEM = r"^\s*(?:-|\d+\.) "
VECTOR_EXTENSIONS = (".emf", ".wmf")


def style_levels(packages: DataFrame) -> DataFrame:
    """(doc_id, style, heading, num_id, ilvl, list_depth): what each style or, failing that, the
    nearest style it is based on decides. A chain without a cycle has no more steps than the
    document has styles; so many are followed, so a cycle ends too."""
    s = packages.select("doc_id", F.explode("styles").alias("s")).select("doc_id", "s.*").dropDuplicates(["doc_id", "id"])
    named = F.try_to_number(F.regexp_extract("name", r"(?i)^heading\s*(\d)$", 1), F.lit("9")).cast("int")
    own = F.coalesce(named, F.when(F.lower("name") == "title", 1), F.col("outline") + 1)
    depth = F.try_to_number(F.regexp_extract("name", r"(?i)^list (?:bullet|number|paragraph)? ?(\d)$", 1), F.lit("9")).cast("int")
    s = s.select("doc_id", F.col("id").alias("style"), F.when(own.between(1, 6), own).alias("heading"), F.struct("num_id", "ilvl").alias("num"), "based_on", depth.alias("list_depth"))
    # All styles of a document as one map (a package part, a few hundred entries) to walk in.
    maps = s.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("style", F.struct("heading", "num", "based_on")))).alias("all"))

    def walk(start, pick):
        step = lambda acc, _: F.when(acc["found"].isNotNull() | acc["at"].isNull(), acc).otherwise(
            F.struct(F.col("all")[acc["at"]]["based_on"].alias("at"), pick(F.col("all")[acc["at"]]).alias("found"))
        )
        zero = F.struct(start.alias("at"), pick(F.col("all")[F.lit(None).cast("string")]).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.size("all")), zero, step, lambda acc: acc["found"])

    numbered = lambda x: F.when(x["num"]["num_id"].isNotNull(), x["num"])
    out = s.select("doc_id", "style", "list_depth").join(maps, "doc_id")
    return out.select("doc_id", "style", "list_depth", walk(F.col("style"), lambda x: x["heading"]).alias("heading"), walk(F.col("style"), numbered).alias("num"))


def figures(packages: DataFrame, slugs: DataFrame) -> DataFrame:
    """(doc_id, ord, at, rid, path, part, vector): images in document order, numbered over the
    document; those that are external or missing have no row."""
    runs = packages.select("doc_id", F.explode("paras").alias("p")).select("doc_id", "p.ord", F.posexplode("p.runs").alias("at", "r")).filter("r.kind = 'image'")
    rels = packages.select("doc_id", F.explode("rels").alias("x")).filter("NOT x.external").select("doc_id", F.col("x.id").alias("rid"), part_of(F.col("x.target")).alias("part"))
    media = packages.select("doc_id", F.explode("media").alias("m")).select("doc_id", F.col("m.part").alias("part"))
    found = runs.select("doc_id", "ord", "at", F.col("r.text").alias("rid")).join(rels, ["doc_id", "rid"]).join(media, ["doc_id", "part"], "left_semi")
    ext = F.lower(F.regexp_extract("part", r"(\.[^./]*)$", 1))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "at"))
    path = F.concat(F.lit("figures/"), F.col("slug"), F.lit("-img"), n.cast("string"), ext)
    return found.join(slugs, "doc_id").select("doc_id", "ord", "at", "part", path.alias("path"), ext.isin(*VECTOR_EXTENSIONS).alias("vector"), ext.alias("ext"))


def part_of(target):
    """A relationship's target as a part name of a package below word/."""
    joined = F.when(target.startswith("/"), target.substr(F.lit(2), F.length(target))).otherwise(F.concat(F.lit("word/"), target))
    return F.regexp_replace(F.regexp_replace(joined, r"(^|/)\./", "$1"), r"[^/]+/\.\./", "")


def paragraphs(packages: DataFrame, slugs: DataFrame) -> DataFrame:
    """(doc_id, ord, block, place, ..., text, prefix-free) rendered inline, with their heading
    level, list properties and warnings."""
    paras = packages.select("doc_id", F.explode("paras").alias("p")).select("doc_id", "p.*")
    runs = paras.select("doc_id", "ord", F.posexplode_outer("runs").alias("at", "r")).select("doc_id", "ord", "at", "r.*")
    rels = packages.select("doc_id", F.explode("rels").alias("x")).select("doc_id", F.col("x.id").alias("link"), F.col("x.target").alias("target")).dropDuplicates(["doc_id", "link"])
    # Display numbers of footnotes: by first reference.
    firsts = runs.filter("kind = 'note'").groupBy("doc_id", "note").agg(F.min(F.struct("ord", "at")).alias("first"))
    numbers = firsts.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))).drop("first")
    runs = runs.join(rels, ["doc_id", "link"], "left").join(numbers, ["doc_id", "note"], "left").join(figures(packages, slugs), ["doc_id", "ord", "at"], "left")
    text = (
        F.when(F.col("kind") == "text", escaped(F.col("text")))
        .when(F.col("kind") == "tab", F.lit(" "))
        .when(F.col("kind") == "break", F.lit("  \n"))
        .when(F.col("kind") == "note", F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]")))
        .when(F.col("kind") == "chart", F.lit(f"\n\n{messages.CHART_PLACE}\n\n"))
        .when(F.col("path").isNotNull(), F.concat(F.lit("\n\n!["), F.col("alt"), F.lit("]("), F.col("path"), F.lit(")\n\n")))
        .otherwise(F.lit(""))
    )
    warning = F.when(F.col("kind") == "chart", F.lit(messages.CHART_NOT_CONVERTED)).when(F.col("vector"), F.replace(F.lit(messages.VECTOR_FIGURE), F.lit("{n}"), F.col("ext")))
    # A hyperlink's pieces are rendered first and stand as one plain piece.
    grouped = runs.groupBy("doc_id", "ord", F.coalesce("link_no", -1 - F.col("at"), F.lit(0)).alias("g"), F.col("link_no").isNotNull().alias("linked")).agg(
        F.min("at").alias("at"), F.first("target", True).alias("target"), F.collect_set(warning).alias("warned"),
        F.array_sort(F.collect_list(F.struct("at", text.alias("text"), F.when(F.col("kind").isin("text", "tab"), F.col("fmt")).otherwise(F.lit("")).alias("fmt")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "note", F.struct("at", "number")))).alias("notes"),
    )
    inner = md.join_runs(F.transform("pieces", lambda x: F.struct(x["text"].alias("text"), x["fmt"].alias("fmt"))))
    link = let(F.struct(inner.alias("t"), F.col("target").alias("u")), lambda x: F.when((x["u"] != "") & (strip(x["t"]) != ""), F.concat(F.lit("["), x["t"], F.lit("]("), x["u"], F.lit(")"))).otherwise(x["t"]))
    piece = F.when(F.col("linked"), F.array(F.struct(link.alias("text"), F.lit("").alias("fmt")))).otherwise(F.transform("pieces", lambda x: F.struct(x["text"].alias("text"), x["fmt"].alias("fmt"))))
    lines = grouped.groupBy("doc_id", "ord").agg(
        F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))).alias("parts"), F.array_distinct(F.flatten(F.collect_list("warned"))).alias("warnings"), F.flatten(F.collect_list("notes")).alias("notes")
    )
    lines = lines.withColumn("text", strip(md.join_runs(F.flatten(F.transform("parts", lambda x: x["p"]))))).drop("parts")
    styles = style_levels(packages).withColumnRenamed("num", "style_num")
    out = paras.drop("runs").join(lines, ["doc_id", "ord"]).join(styles, ["doc_id", "style"], "left")
    own = F.col("num_id").isNotNull()
    return out.withColumns({
        "num_id": F.when(own, F.col("num_id")).otherwise(F.col("style_num.num_id")),
        "ilvl": F.coalesce(F.when(own, F.col("ilvl")).otherwise(F.col("style_num.ilvl")), F.lit(0)),
    }).drop("style_num")


def numbered(items: DataFrame, formats: DataFrame) -> DataFrame:
    """List numbers over rows (doc_id, ord, num_id, ilvl): fmt and number (null for bullets).

    A numbered item restarts the deeper levels of its list. For each item the count of
    shallower numbered items before it tells which stretch of its level it belongs to."""
    rows = items.join(formats, ["doc_id", "num_id", "ilvl"], "left").withColumn("fmt", F.coalesce("fmt", F.lit("bullet")))
    counts = ~F.col("fmt").isin("bullet", "none")
    before = Window.partitionBy("doc_id", "num_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    shallower = F.array(*(F.coalesce(F.sum(F.when(counts & (F.col("ilvl") < level), 1).otherwise(0)).over(before), F.lit(0)) for level in range(1, 10)))
    rows = rows.withColumn("stretch", F.when(F.col("ilvl") == 0, 0).otherwise(F.get(shallower, F.least(F.col("ilvl"), F.lit(9)) - 1)))
    own = Window.partitionBy("doc_id", "num_id", "ilvl", "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("number", F.when(counts, F.sum(F.when(counts, 1).otherwise(0)).over(own))).drop("stretch")


def rendered(paras: DataFrame, packages: DataFrame) -> DataFrame:
    """paras with line: headings, list items and escaped plain text."""
    formats = packages.select("doc_id", F.explode("nums").alias("n")).select("doc_id", "n.*").dropDuplicates(["doc_id", "num_id", "ilvl"])
    listed = (F.col("text") != "") & F.col("heading").isNull() & F.col("num_id").isNotNull() & (F.col("num_id") != "0")
    items = numbered(paras.filter(listed & (F.col("place") != "note")).select("doc_id", "ord", "num_id", "ilvl"), formats).select("doc_id", "ord", "fmt", "number")
    out = paras.join(items, ["doc_id", "ord"], "left")
    nesting = F.when(F.col("list_depth").isNotNull() & (F.col("ilvl") == 0), F.col("list_depth") - 1).otherwise(F.col("ilvl"))
    mark = F.when(F.col("number").isNull(), F.lit("- ")).otherwise(F.concat(F.col("number").cast("string"), F.lit(". ")))
    item = F.concat(F.repeat(F.lit("   "), nesting), mark, F.col("text"))
    line = F.when(F.col("text") == "", F.lit("")).when(F.col("heading").isNotNull(), md.heading(F.col("heading"), F.col("text"))).when(F.col("fmt").isNotNull(), item).otherwise(md.escape_block_start(F.col("text")))
    return out.withColumn("line", line)


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, text, warnings, notes): paragraphs as they are, tables rendered."""
    body = lines.filter("place = 'body'").select("doc_id", "block", F.col("line").alias("text"), "warnings", "notes", F.col("heading").isNotNull().alias("is_heading"))
    cells = lines.filter("place = 'cell'").groupBy("doc_id", "block", "row", "cell").agg(
        F.first("span").alias("span"), F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("ord", "line")))).alias("x"),
        F.flatten(F.collect_list("warnings")).alias("warnings"), F.flatten(F.collect_list("notes")).alias("notes"),
    )
    text = F.replace(F.array_join(F.transform("x", lambda x: x["line"]), "<br>"), F.lit("  \n"), F.lit("<br>"))
    text = F.replace(strip(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit("|"), F.lit("\\|"))
    padded = F.concat(F.array(text), F.array_repeat(F.lit(""), F.greatest(F.col("span") - 1, F.lit(0))))
    rows = cells.groupBy("doc_id", "block", "row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", padded.alias("c")))), lambda x: x["c"])).alias("cells"),
        F.flatten(F.collect_list("warnings")).alias("warnings"), F.flatten(F.collect_list("notes")).alias("notes"),
    )
    tables = rows.groupBy("doc_id", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"),
        F.flatten(F.collect_list("warnings")).alias("warnings"), F.flatten(F.collect_list("notes")).alias("notes"),
    )
    width = F.array_max(F.transform("rows", F.size))
    boxed = F.array_join(F.filter(F.transform("rows", lambda r: F.replace(F.get(r, F.lit(0)), F.lit("<br>"), F.lit("\n\n"))), lambda t: t != ""), "\n\n")
    table = F.when(width == 1, boxed).otherwise(md.render_table(F.col("rows")))
    tables = tables.select("doc_id", "block", table.alias("text"), "warnings", "notes", F.lit(False).alias("is_heading"))
    return body.unionByName(tables).filter("text <> ''")


def placed_blocks(found: DataFrame) -> DataFrame:
    """Blocks with their section: a new one starts at every heading of the shallowest level that
    the document uses."""
    order = Window.partitionBy("doc_id").orderBy("block")
    level = F.length(F.regexp_extract("text", r"(?s)^(#{1,6}) .*$", 1))
    rows = found.withColumn("level", F.when(level > 0, level)).withColumn("top", F.min("level").over(Window.partitionBy("doc_id")))
    starts = (F.coalesce(F.col("level") == F.col("top"), F.lit(False)) & (F.row_number().over(order) > 1)).cast("int")
    return rows.withColumn("unit_no", 1 + F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sections(placed: DataFrame) -> DataFrame:
    """(doc_id, unit_no, title, body, warnings) of placed blocks; list items of one list follow
    each other without a blank line."""
    inside = Window.partitionBy("doc_id", "unit_no").orderBy("block")
    rows = placed.withColumn("previous", F.lag("text").over(inside))
    kind = lambda c: F.when(c.rlike(r"^\s*- "), "-").when(c.rlike(ITEM), "1.")
    this, last = kind(F.col("text")), kind(F.col("previous"))
    tight = this.isNotNull() & last.isNotNull() & ((this == last) | F.col("text").startswith(" ") | F.col("previous").startswith(" "))
    gap = F.when(F.col("previous").isNull(), F.lit("")).when(tight, F.lit("\n")).otherwise(F.lit("\n\n"))
    return rows.groupBy("doc_id", "unit_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.concat(gap, F.col("text")).alias("t")))), lambda x: x["t"]), "").alias("body"),
        F.coalesce(F.regexp_extract(F.min_by(F.when(F.col("previous").isNull() & F.col("level").isNotNull(), F.col("text")), "block"), r"(?s)^#{1,6} (.*)$", 1), F.lit("")).alias("title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"),
    )


def convert(packages: DataFrame, slugs: DataFrame) -> DataFrame:
    """Units (doc_id, unit_no, title, markdown, warnings) of Word packages. A document without
    text has one empty section."""
    lines = stage(rendered(stage(paragraphs(packages, slugs), "word-paragraphs"), packages), "word-lines")
    placed = stage(placed_blocks(blocks(lines)), "word-blocks")
    cut = sections(placed)
    refs = placed.select("doc_id", "unit_no", "block", F.explode("notes").alias("n")).select("doc_id", "unit_no", "block", F.col("n.number").alias("number"), F.col("n.at").alias("at"))
    first = refs.groupBy("doc_id", "number").agg(F.min(F.struct("unit_no", "block", "at")).alias("f"))
    ids = packages.select("doc_id", F.explode("paras").alias("p")).select("doc_id", "p.ord", F.posexplode("p.runs").alias("at", "r")).filter("r.kind = 'note'")
    ids = ids.groupBy("doc_id", F.col("r.note").alias("note")).agg(F.min(F.struct("ord", "at")).alias("x")).withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("x"))).drop("x")
    texts = lines.filter("place = 'note'").groupBy("doc_id", "note").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), " ")).alias("text"))
    noted = first.join(ids, ["doc_id", "number"]).join(texts, ["doc_id", "note"], "left")
    line = F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]: "), F.coalesce("text", F.lit("")))
    noted = noted.groupBy("doc_id", F.col("f.unit_no").alias("unit_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", line.alias("l")))), lambda x: x["l"]), "\n").alias("defined"))
    units = packages.filter("error IS NULL").select("doc_id").join(cut, "doc_id", "left").join(noted, ["doc_id", "unit_no"], "left")
    return units.select(
        "doc_id", F.coalesce("unit_no", F.lit(1)).cast("int").alias("unit_no"), F.coalesce("title", F.lit("")).alias("title"),
        F.concat_ws("\n\n", F.coalesce("body", F.lit("")), "defined").alias("markdown"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
