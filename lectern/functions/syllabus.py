"""Syllabus lines to items: five kinds of lines, numbered in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the five kinds of lines, tried in this order.
LINES = {
    "module": r"(?i)^\s*module\s+(\d+)\s*[:.\-]\s*(.+)$",
    "topic": r"^\s*(\d+)\.(\d+)\s*[:.\-]?\s*(.+)$",
    "assessment": r"(?i)^\s*(assignment|exam|quiz|midterm|final|project)\s*\d*\s*[:.\-]?\s*(.+?)(?:\((?:weight\s+)?(\d+(?:\.\d+)?)\s*%\))?\s*$",
    "schedule": r"(?i)^\s*week\s+(\d+)\s*[:.\-]\s*(.+)$",
    "reference": r"(?i)^\s*reference[s]?\s*[:.\-]\s*(.+)$",
}


def parsed_lines(lines: DataFrame, group: str, at: str) -> DataFrame:
    """Items of each group's lines in order: (group, item, item_type, ordinal, parent_ordinal, title, weight_pct, week_number, references, description).

    Modules, assessments and schedule entries count from 0. A topic ``m.n`` hangs below module m if that has come, else
    below the last one, and counts from 0 there; one before any module is added to the last module's description. A
    reference belongs to the item before it. Blank lines and others are ignored. All counts are running windows of a group.
    """
    text = F.trim("line")
    kind = F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in LINES.items()))
    get = lambda k, i: F.regexp_extract(text, LINES[k], i)
    rows = lines.select(group, at, text.alias("line"), kind.alias("kind")).where("kind IS NOT NULL")
    so_far = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    count = lambda k: F.count_if(F.col("kind") == k).over(so_far) - 1
    rows = rows.withColumn("module", count("module"))
    number = get("topic", 1).try_cast("long") - 1
    parent = F.when(F.col("kind") == "topic", F.when(number.between(0, F.col("module")), number).otherwise(F.col("module")))
    rows = rows.withColumn("parent_ordinal", parent)
    own = (F.col("kind") != "reference") & ~((F.col("kind") == "topic") & (F.col("parent_ordinal") < 0))
    rows = rows.withColumn("is_item", own).withColumn("item", F.count_if("is_item").over(so_far) - 1)
    beside = Window.partitionBy(group, "parent_ordinal", "is_item", "kind").orderBy(at)
    ordinal = F.when(F.col("kind") == "topic", F.row_number().over(beside) - 1)
    for k in ("module", "assessment", "schedule"):
        ordinal = F.when(F.col("kind") == k, count(k)).otherwise(ordinal)
    label = get("assessment", 1)
    entitled = F.trim(F.concat(F.initcap(label), F.lit(": "), F.trim(get("assessment", 2))), F.lit(": "))
    title = F.when(F.col("kind") == "module", F.trim(get("module", 2))).when(F.col("kind") == "topic", F.trim(get("topic", 3))).when(F.col("kind") == "assessment", entitled).when(F.col("kind") == "schedule", F.trim(get("schedule", 2))).otherwise(F.trim(get("reference", 1)))
    rows = rows.withColumn("ordinal", ordinal).withColumn("title", title)
    rows = rows.withColumn("weight_pct", F.when(F.col("kind") == "assessment", get("assessment", 3).try_cast("double"))).withColumn("week_number", F.when(F.col("kind") == "schedule", get("schedule", 1).try_cast("long")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(at, "title")))), lambda x: x["title"])
    cited = rows.where((F.col("kind") == "reference") & (F.col("item") >= 0)).groupBy(group, "item").agg(in_order(F.lit(True)).alias("references"))
    flat = rows.where(~F.col("is_item") & (F.col("kind") == "topic")).groupBy(group).agg(F.array_join(in_order(F.lit(True)), "; ").alias("description"))
    last = rows.where("kind = 'module'").groupBy(group).agg(F.max("item").alias("item"))
    items = rows.where("is_item").join(cited, [group, "item"], "left").join(last.join(flat, group), [group, "item"], "left")
    return items.select(group, "item", F.col("kind").alias("item_type"), "ordinal", "parent_ordinal", "title", "weight_pct", "week_number", F.coalesce("references", F.array().cast("array<string>")).alias("references"), "description")


def extraction_confidence(lines: Column, items: Column) -> Column:
    """0.4 and up by the share of lines that became items; 0 without items."""
    return F.when((lines == 0) | (items == 0), 0.0).otherwise(F.round(F.least(0.4 + 0.6 * F.least(items / F.greatest(lines, F.lit(1)), F.lit(1.0)), F.lit(1.0)), 2))


def authority_grade(confidence: Column) -> Column:
    """1 (sure) to 5 (nothing found)."""
    return F.when(confidence >= 0.85, 1).when(confidence >= 0.65, 2).when(confidence >= 0.4, 3).when(confidence > 0, 4).otherwise(5)
