"""Texts to located spans: paragraphs, diff hunks, runner logs. One scan and windows per text; no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Where a text breaks into lines (fixed values).
BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, words): lines from 1, without the empty one after a final break."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return texts.select(key, F.posexplode(parts).alias("at", "line")).select(key, (F.col("at") + 1).alias("n"), "line")


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")


def paragraphs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, start_line, end_line, text): blocks between blank lines; lone headings lead the block after them.

    A text is cut where it lies, by the runs of blank lines; only the blocks are shuffled, once, by key. A null text has
    no blocks.
    """
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, "\n"), r"\n\s*\z", "")
    rows = texts.select(key, F.explode(F.array(plain)).alias("t"))
    rows = rows.withColumn("lead", F.regexp_extract("t", r"\A(\s*\n)", 1)).withColumn("t", F.expr("substr(t, length(lead) + 1)"))
    gap = r"\n\s*\n"
    pieces = F.arrays_zip(F.split("t", gap, -1).alias("block"), F.concat(F.regexp_extract_all("t", F.lit(gap), F.lit(0)), F.array(F.lit(""))).alias("gap"))
    rows = rows.select(key, newlines(F.col("lead")).alias("above"), F.posexplode(pieces).alias("i", "p")).select(key, "above", "i", "p.block", "p.gap")
    each = W.partitionBy(key).orderBy("i")
    before = F.coalesce(F.sum(newlines(F.col("block")) + newlines(F.col("gap"))).over(each.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("a", (F.col("above") + before + 1).cast("int")).withColumn("b", (F.col("a") + newlines(F.col("block"))).cast("int"))
    heading = (F.col("a") == F.col("b")) & F.col("block").rlike(r"^#{1,6}[ \t]+\S")
    # the block that a heading leads is the next without one; headings that lead none stay alone
    after = F.min(F.when(~heading, F.col("i"))).over(each.rowsBetween(0, W.unboundedFollowing))
    rows = rows.filter(F.col("block").rlike(r"\S")).withColumn("leads", F.coalesce(after, F.col("i")))
    parts = F.array_sort(F.collect_list(F.struct("i", "block", "gap")))
    whole = F.array_join(F.transform(parts, lambda x, k: F.concat(x["block"], F.when(k < F.size(parts) - 1, x["gap"]).otherwise(""))), "")
    out = rows.groupBy(key, "leads").agg(F.min("a").alias("start_line"), F.max("b").alias("end_line"), whole.alias("text"))
    return out.select(key, F.row_number().over(W.partitionBy(key).orderBy("start_line")).alias("chunk"), "start_line", "end_line", "text")


def diff_hunks(texts: DataFrame, key: str = "pr", text: str = "text") -> DataFrame:
    """(key, hunk, file, start_line, end_line, text): hunks begin at @@ and end before the next or at a file header."""
    each = W.partitionBy(key).orderBy("n")
    rows = lines(texts, key, text)
    header = F.col("line").startswith("diff --git ")
    rows = rows.withColumn("header", F.last(F.when(header, F.col("line")), ignorenulls=True).over(each))
    rows = rows.withColumn("part", F.sum((header | F.col("line").startswith("@@")).cast("int")).over(each))
    rows = rows.withColumn("opens", F.first("line").over(W.partitionBy(key, "part").orderBy("n")).startswith("@@"))
    hunks = rows.filter(F.col("opens") & (F.col("part") > 0)).groupBy(key, "part").agg(F.first("header").alias("header"), F.min("n").alias("start_line"), F.max("n").alias("end_line"), _joined().alias("body"))
    head = F.coalesce("header", F.lit(""))
    return hunks.select(key, F.row_number().over(W.partitionBy(key).orderBy("part")).alias("hunk"), F.element_at(F.split(head, " b/"), -1).alias("file"), "start_line", "end_line", F.concat(head, F.lit("\n"), F.col("body")).alias("text"))


def log_chunks(texts: DataFrame, key: str = "run", text: str = "text", context: int = 3) -> DataFrame:
    """(key, name, job, step, start_line, end_line, text) of runner logs `job TAB step TAB time message`.

    Lines of one job and step in a row form a group; lines without a prefix go on with it. From `context` lines before
    the first ##[error] to the end of its group is an error chunk, the rest a plain one.
    """
    each = W.partitionBy(key).orderBy("n")
    clean = texts.withColumn(text, F.regexp_replace(text, "^\\x{FEFF}+", ""))
    rows = lines(clean, key, text).withColumn("parts", F.split("line", "\t", 3))
    rows = rows.withColumn("own", F.when(F.size("parts") == 3, F.struct(F.col("parts")[0].alias("job"), F.col("parts")[1].alias("step"))))
    rows = rows.withColumn("at", F.last("own", ignorenulls=True).over(each)).filter("at is not null")
    rows = rows.withColumn("fresh", F.coalesce(F.col("at") != F.lag("at").over(each), F.lit(True)))
    rows = rows.withColumn("part", F.sum(F.col("fresh").cast("int")).over(each))
    message = F.rtrim(F.regexp_replace(F.regexp_replace(F.when(F.col("own").isNotNull(), F.element_at("parts", -1)).otherwise(F.col("line")), r"^\d{4}-\d\d-\d\dT[\d:.]+Z ?", ""), "\x1b\\[[0-9;]*[A-Za-z]", ""))
    rows = rows.select(key, "n", "at", "part", message.alias("line"))
    group = W.partitionBy(key, "part")
    place = F.row_number().over(group.orderBy("n")) - 1
    rows = rows.withColumn("place", place)
    first = F.min(F.when(F.contains("line", F.lit("##[error]")), F.col("place"))).over(group)
    rows = rows.withColumn("error", F.coalesce(F.col("place") >= first - context, F.lit(False)))
    chunks = rows.groupBy(key, "part", "error", "at").agg(F.min("n").alias("start_line"), F.max("n").alias("end_line"), _joined().alias("text"))
    number = F.row_number().over(W.partitionBy(key, "error").orderBy("start_line"))
    return chunks.select(key, F.concat(F.when(F.col("error"), "error").otherwise("chunk"), number.cast("string")).alias("name"), "at.job", "at.step", "start_line", "end_line", "text")
