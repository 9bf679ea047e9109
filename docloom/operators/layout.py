"""Tables, lists, runs, pages and sheets as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.predicates import block_kind
from docloom.functions.text import strip, sub
from docloom.sources.text import raw_lines


def cells(row: Column) -> Column:
    inner = sub(sub(strip(row), r"^\|"), r"\|$")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def is_separator(row: Column) -> Column:
    c = cells(row)
    return (F.size(c) > 0) & F.forall(c, lambda x: x.rlike("^:?-+:?$"))


def alignment(cell: Column) -> Column:
    return F.when(cell.rlike("^:-*:$"), "center").when(cell.rlike("-:$"), "right").otherwise("left")


def is_divider(row: Column) -> Column:
    c = cells(row)
    return (F.size(c) > 1) & (c[0] != "") & F.forall(F.slice(c, 2, F.size(c)), lambda x: x == "")


def width_class(first: int | Column, rest: int | Column) -> Column:
    """The class of a table by the longest text in its first column and in the others."""
    return F.when((first <= 12) & (rest <= 25), "narrow").when((first <= 20) & (rest <= 50), "medium").when(
        (first <= 20) & (rest <= 80), "wide-label").otherwise("equal")


def tables(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row_no, col_no, cell, align of a text that is one table, whose second row must be a separator; short rows are padded."""
    lines = docs.select(key, F.split(strip(F.col("text")), "\n").alias("rows"))
    good = lines.where((F.size("rows") >= 2) & is_separator(F.get("rows", F.lit(1))))
    aligns = F.transform(cells(F.get("rows", F.lit(1))), alignment)
    body = F.concat(F.slice("rows", 1, 1), F.slice("rows", 3, F.greatest(F.size("rows") - 2, F.lit(1))))
    rows = good.select(key, aligns.alias("aligns"), F.posexplode(F.when(F.size("rows") > 2, body).otherwise(F.slice("rows", 1, 1))).alias("row_no", "row"))
    each = rows.select(key, "row_no", cells(F.col("row")).alias("c"), F.posexplode("aligns").alias("col_no", "align"))
    return each.select(key, "row_no", "col_no", F.coalesce(F.get("c", F.col("col_no")), F.lit("")).alias("cell"), "align")


def table_widths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    found = tables(docs, key).withColumn("n", F.length("cell"))
    both = found.groupBy(key).agg(F.max(F.when(F.col("col_no") == 0, F.col("n"))).alias("a"), F.coalesce(F.max(F.when(F.col("col_no") > 0, F.col("n"))), F.lit(0)).alias("b"), (F.max("col_no") + 1).alias("columns"))
    return both.select(key, "columns", width_class(F.col("a"), F.col("b")).alias("width"))


def list_levels(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item, level, text: levels are indents over the smallest, in units of the first step."""
    items = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*([-*+]|\d+[.)])\s"))
    indents = F.array_distinct(F.array_sort(F.transform(items, lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)))))
    unit = F.when(F.size(indents) > 1, indents[1] - indents[0]).otherwise(1)
    rows = docs.select(key, indents[0].alias("least"), unit.alias("unit"), F.posexplode(items).alias("item", "row"))
    level = F.floor((F.length(F.regexp_extract("row", r"^(\s*)", 1)) - F.col("least")) / F.col("unit"))
    return rows.select(key, "item", level.cast("int").alias("level"), sub(F.col("row"), r"^\s*([-*+]|\d+[.)])\s+").alias("text"))


def block_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, run, kind, first_line, lines: runs of lines of one kind."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = raw_lines(docs, key).withColumn("kind", block_kind(F.col("line")))
    new = F.when(F.col("kind") == F.lag("kind").over(by), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    return runs.groupBy(key, "run", "kind").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"))


def previous_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, previous: for each line the last one before it that isn't blank."""
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when(strip(F.col("line")) != "", F.col("line"))
    return raw_lines(docs, key).select(key, "line_no", F.last(shown, ignorenulls=True).over(by).alias("previous"))


def depths(docs: DataFrame, key: str = "doc_id", tag: str = "div") -> DataFrame:
    """key, line_no, depth: open tags after each line."""
    by = Window.partitionBy(key).orderBy("line_no")
    change = F.regexp_count("line", F.lit(f"<{tag}\\b")) - F.regexp_count("line", F.lit(f"</{tag}\\b"))
    return raw_lines(docs, key).select(key, "line_no", F.sum(change).over(by).cast("int").alias("depth"))


def outside(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Points (key, pos) that lie in no span (key, begin, finish)."""
    s = spans.select(F.col(key).alias("_k"), "begin", "finish")
    return points.join(s, (points[key] == F.col("_k")) & points["pos"].between(F.col("begin"), F.col("finish")), "left_anti")


def line_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, at: characters ahead of each line."""
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return raw_lines(docs, key).select(key, "line_no", F.coalesce(F.sum(F.length("line") + 1).over(by), F.lit(0)).alias("at"))


def chunks(docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """key, chunk, lines, chars: lines gathered until the next one would go over ``most`` characters."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)
    start = F.array().cast("array<struct<lines:int,chars:int>>")

    def step(acc: Column, n: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct((last["lines"] + 1).alias("lines"), (last["chars"] + n).alias("chars"))
        fresh = F.struct(F.lit(1).alias("lines"), n.alias("chars"))
        fits = (F.size(acc) > 0) & (last["chars"] + n <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    rows = docs.select(key, F.posexplode(F.aggregate(sizes, start, step)).alias("chunk", "c"))
    return rows.select(key, "chunk", "c.lines", "c.chars")


def paging(docs: DataFrame, per_page: int, key: str = "doc_id") -> DataFrame:
    """key, page, side, lines: lines in pages of a fixed number, left and right in turn."""
    rows = raw_lines(docs, key).withColumn("page", F.floor(F.col("line_no") / per_page).cast("int"))
    out = rows.groupBy(key, "page").agg(F.count("*").alias("lines"))
    return out.withColumn("side", F.when(F.col("page") % 2 == 0, "left").otherwise("right"))


def saddle_stitch(spark: SparkSession, pages: int) -> DataFrame:
    """sheet, face, left_page, right_page for ``pages`` pages, padded to a multiple of four; a padding page is null."""
    n = -(-pages // 4) * 4
    s = spark.range(n // 4).select(F.col("id").cast("int").alias("sheet"))
    front = s.select("sheet", F.lit("front").alias("face"), (n - 1 - 2 * F.col("sheet")).alias("l"), (2 * F.col("sheet")).alias("r"))
    back = s.select("sheet", F.lit("back").alias("face"), (2 * F.col("sheet") + 1).alias("l"), (n - 2 - 2 * F.col("sheet")).alias("r"))
    page = lambda c: F.when(F.col(c) < pages, F.col(c))
    return front.unionByName(back).select("sheet", "face", page("l").alias("left_page"), page("r").alias("right_page"))


def folios(spark: SparkSession, pages: int) -> DataFrame:
    """sheet (from 1), face, left_page, right_page of folded sheets of four pages each; a missing page is null."""
    s = spark.range(1, -(-pages // 4) + 1).select(F.col("id").cast("int").alias("sheet"))
    f = F.col("sheet")
    front = s.select("sheet", F.lit("front").alias("face"), (4 * f - 1).alias("l"), (4 * f - 4).alias("r"))
    back = s.select("sheet", F.lit("back").alias("face"), (4 * f - 3).alias("l"), (4 * f - 2).alias("r"))
    page = lambda c: F.when(F.col(c) < pages, F.col(c))
    return front.unionByName(back).select("sheet", "face", page("l").alias("left_page"), page("r").alias("right_page"))


def vocabulary(docs: DataFrame, words: DataFrame, most: int = 6, key: str = "doc_id") -> DataFrame:
    """key, n, word, meaning: the first ``most`` different words of a text that the dictionary (word, meaning) holds."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = docs.select(key, F.posexplode(tokens).alias("pos", "word"))
    met = rows.join(words, "word").groupBy(key, "word", "meaning").agg(F.min("pos").alias("pos"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return met.withColumn("n", n).where(F.col("n") <= most).select(key, "n", "word", "meaning")


def wrap(text: Column, width: int) -> Column:
    """Words of a text in lines of at most ``width`` characters, a longer word alone."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)
