"""Operators on messages: merging, ordering, threads, zones, and similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import discard, materialize

#: Rows of a table of rules at most.
MOST_RULES = 1000


def identity_merge(rows: DataFrame, by: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """One row for each identity: the columns ``carry`` of the first row in ``order``, and how many rows went into it."""
    head = F.min_by(F.struct(*carry), F.struct(*order))
    return rows.groupBy(*by).agg(head.alias("_h"), (F.count("*") - 1).alias("merged")).select(*by, "_h.*", "merged")


def richest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in ``order``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def stable_index(rows: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """A number from 0 in the order of the whole table, without bringing the table to one task.

    Rows are sorted in ranges and stored; each range begins where the counts
    of those before it end, and there are as many counts as ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = materialize(ranged.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_row")), "ordered")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_start"))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row") - F.col("_first")).drop(
        "_part", "_row", "_first", "_start", "_n"
    )


def time_band_pairs(rows: DataFrame, key: str, id_col: str, at: str, band: int) -> DataFrame:
    """key, a, b, apart: rows of a key at most ``band`` seconds apart, the smaller id first.

    Time is cut into bins of the band's width, so that a row meets only its own
    bin and the next ones, however many rows a key has.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    width = band * 1_000_000
    base = rows.select(F.col(key), F.col(id_col).alias("a"), t.alias("ta"), F.floor(t / width).alias("bin"))
    other = rows.select(F.col(key), F.col(id_col).alias("b"), t.alias("tb"), F.explode(F.array(F.floor(t / width) - 1, F.floor(t / width), F.floor(t / width) + 1)).alias("bin"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= width)
    return base.join(other, [key, "bin"]).where(near).select(key, "a", "b", (F.abs(F.col("ta") - F.col("tb"))).alias("apart"))


def thread_links(rows: DataFrame, thread: str, order: list[str], id_col: str) -> DataFrame:
    """Each row with the one that it replies to: the previous row of its thread."""
    return rows.withColumn("reply_to", F.lag(id_col).over(Window.partitionBy(thread).orderBy(*order)))


def reply_fanin(links: DataFrame, id_col: str) -> DataFrame:
    """replied_by: the ids of the rows that reply to a row, in order."""
    return links.where("reply_to IS NOT NULL").groupBy(F.col("reply_to").alias(id_col)).agg(F.array_sort(F.collect_list(id_col)).alias("replied_by"))


def guard_chronology(entries: DataFrame, id_col: str = "id", link: str = "quotes") -> DataFrame:
    """Each entry with its explicit link, if both sides are dated and the target isn't later."""
    target = entries.select(F.col(id_col).alias(link), F.struct("date", "time").alias("_t"), F.col("date").alias("_d"))
    right = F.col("date").isNotNull() & F.col("_d").isNotNull() & (F.col("_t") <= F.struct("date", "time"))
    return entries.join(target, link, "left").select(id_col, F.when(F.coalesce(right, F.lit(False)), F.col(link)).alias(link))


def first_match(rows: DataFrame, rules: DataFrame, text: str, key: list[str], default) -> DataFrame:
    """The name of the first rule, by its number, whose pattern is found in ``text``.

    rules: (ord, pattern, name), a table that a person keeps, of MOST_RULES rows
    at most.  They become one expression, so rows are neither moved nor merged.
    """
    known = rules.orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.coalesce(*(F.when(F.col(text).rlike(r["pattern"]), F.lit(r["name"])) for r in known), default)
    return rows.select(*key, found.alias("name"))


def page_owner(entry_pages: DataFrame, owners: DataFrame, zones: DataFrame) -> DataFrame:
    """entry, owner, zone: the commonest owner of an entry's pages, of equally common ones that of the earliest page."""
    counted = entry_pages.join(owners, "page_no").groupBy("entry", "owner").agg(F.count("*").alias("n"), F.min("page_no").alias("page"))
    best = counted.groupBy("entry").agg(F.min_by("owner", F.struct(-F.col("n"), "page")).alias("owner"))
    return best.join(zones, "owner", "left").where("zone IS NOT NULL")


def inherit_zones(entries: DataFrame) -> DataFrame:
    """id, zone, source: along quote links, a quoted entry that is sure of nothing takes its quoter's zone.

    entries: id, quotes, zone, source (offset, owner_code, inherited,
    affiliation).  A breadth-first pass for each link of the longest chain;
    every pass makes entries sure, so it ends.
    """
    now = materialize(entries.select("id", "quotes", "zone", "source"), "zones")
    while True:
        quoter = now.where("source <> 'affiliation' AND quotes IS NOT NULL")
        given = quoter.groupBy(F.col("quotes").alias("id")).agg(F.min_by("zone", "id").alias("_z"))
        step = now.join(given, "id", "left")
        takes = (F.col("source") == "affiliation") & F.col("_z").isNotNull()
        if step.where(takes).isEmpty():
            break
        zone, source = F.when(takes, F.col("_z")).otherwise(F.col("zone")), F.when(takes, "inherited").otherwise(F.col("source"))
        old, now = now, materialize(step.select("id", "quotes", zone.alias("zone"), source.alias("source")), "zones")
        discard(old)
    return now.select("id", "zone", "source")


def page_union(rows: DataFrame, key: str, page: str) -> DataFrame:
    """key, pages (sorted, each once), start, end, merged."""
    pages = F.array_sort(F.collect_set(page))
    out = rows.groupBy(key).agg(pages.alias("pages"), (F.count("*") - 1).alias("merged"))
    return out.select(key, "pages", F.element_at("pages", 1).alias("start"), F.element_at("pages", -1).alias("end"), "merged")


def mode_earliest(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the earliest."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    return counted.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "first")).alias("m")).select(key, f"m.{value}", "m.n")
