"""Many spans of many texts replaced in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans_of(texts: DataFrame, id_col: str, text_col: str, regex: str, new: Column, rank: int = 0) -> DataFrame:
    """Edits (id, start, length, new, rank) for each match of a regular expression; starts are characters from 0."""
    found = texts.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(F.split(text_col, regex, -1).alias("kept"), F.regexp_extract_all(text_col, F.lit(regex), F.lit(0)).alias("hit"))).alias("k", "x"))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.withColumns({"length": F.length("x.hit"), "start": F.sum(F.length("x.kept") + F.coalesce(F.length("x.hit"), F.lit(0))).over(w) - F.coalesce(F.length("x.hit"), F.lit(0))})
    return ends.filter("x.hit is not null").select("id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), new.alias("new"), F.lit(rank).alias("rank"))


def accepted(edits: DataFrame) -> DataFrame:
    """edits with `fits` and, of those that fit, `moved`: where the new text stands.

    By start, then the longer, then the lower rank, then the text: an edit that begins before the end
    of one that came before is refused, whether that one fits or not, so that no order of work decides.
    """
    w = Window.partitionBy("id").orderBy("start", F.desc("length"), "rank", "new")
    before = F.max(F.col("start") + F.greatest("length", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = edits.withColumn("fits", F.col("start") >= F.coalesce(before, F.lit(0)))
    gain = F.when(F.col("fits"), F.length("new") - F.col("length")).otherwise(0)
    shift = F.coalesce(F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("moved", F.when(F.col("fits"), F.col("start") + shift))


def segments(texts: DataFrame, edits: DataFrame, id_col: str) -> DataFrame:
    """(id, start, moved, length): the runs of a text that stay, where they stood and where they stand now."""
    good = accepted(edits).filter("fits")
    w = Window.partitionBy("id").orderBy("start")
    after = good.select("id", (F.col("start") + F.col("length")).alias("start"), (F.col("moved") + F.length("new")).alias("moved"), F.lead("start").over(w).alias("upto"))
    first = good.groupBy("id").agg(F.min("start").alias("upto")).select("id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("moved"), "upto")
    sizes = texts.select(F.col(id_col).alias("id"), F.length("text").cast("long").alias("size"))
    rows = first.unionByName(after).join(sizes, "id").select("id", "start", "moved", (F.coalesce("upto", "size") - F.col("start")).alias("length"))
    return rows.filter("length > 0")


def splice(texts: DataFrame, edits: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """texts with `spliced`, n_edits and n_refused; a text's pieces are gathered in its own row. Texts without edits stay; null texts stay null."""
    w = Window.partitionBy("id").orderBy("start")
    done = accepted(edits)
    good = done.filter("fits").withColumn("upto", F.lead("start").over(w))
    tally = done.groupBy("id").agg(F.count_if("fits").alias("n_edits"), F.count_if(~F.col("fits")).alias("n_refused"))
    parts = good.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "new", "upto"))).alias("parts"))
    rows = texts.join(parts.withColumnRenamed("id", id_col), id_col, "left").join(tally.withColumnRenamed("id", id_col), id_col, "left")
    text = F.col(text_col)

    def piece(p: Column) -> Column:
        begin = (p["start"] + p["length"] + 1).cast("int")
        return F.concat(p["new"], F.substring(text, begin, F.coalesce((p["upto"] - p["start"] - p["length"]).cast("int"), F.length(text))))

    head = F.substring(text, F.lit(1), F.col("parts")[0]["start"].cast("int"))
    spliced = F.when(F.col("parts").isNull(), text).otherwise(F.concat(head, F.array_join(F.transform("parts", piece), "")))
    return rows.select(*texts.columns, spliced.alias("spliced"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_edits", "n_refused")])
