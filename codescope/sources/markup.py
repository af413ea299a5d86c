"""Elements of markup as syntax nodes, with SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What holds no elements, whatever it looks like.
HIDDEN = (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"(?s)<!--.*?-->")


def tags(html: Column, kinds: list[str]) -> Column:
    """The opening and closing tags of these kinds, in order."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    return F.regexp_extract_all(html, F.lit(rf"</?(?:{'|'.join(kinds)})\b[^>]*>"), F.lit(0))


def nodes(pages: DataFrame, key: str, html: str, kinds: list[str]) -> DataFrame:
    """``file`` (the page's key), ``id`` (from 0, in the order of opening tags), ``parent``, ``kind``, ``pos`` and ``kids`` of elements of ``kinds``.

    An element's depth is the number of tags that are open before it, so it
    belongs to the last one before it that is a level up; kinds whose tags are
    often left out had better not be named. Null and empty pages have none.
    """
    rows = pages.select(F.col(key).alias("file"), F.posexplode(tags(F.col(html), kinds)).alias("id", "tag"))
    rows = rows.select("file", F.col("id").cast("long").alias("id"), F.regexp_extract("tag", "^</?([a-z0-9]+)", 1).alias("kind"), F.when(F.col("tag").startswith("</"), -1).otherwise(1).alias("step"))
    rows = rows.withColumn("depth", F.sum("step").over(Window.partitionBy("file").orderBy("id"))).filter("step = 1")
    # the last element before it on the level above: both stand in one window, in their order
    levels = rows.select("file", "id", "kind", F.explode(F.array(F.struct("depth", F.col("id").alias("up"), F.lit(False).alias("asks")), F.struct((F.col("depth") - 1).alias("depth"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("asks")))).alias("l")).select("file", "id", "kind", "l.*")
    before = Window.partitionBy("file", "depth").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    out = levels.withColumn("parent", F.last("up", ignorenulls=True).over(before)).filter("asks").select("file", "id", "parent", "kind")
    among = Window.partitionBy("file", "parent").orderBy("id")
    kids = out.filter("parent is not null").groupBy("file", F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    return out.withColumn("pos", (F.row_number().over(among) - 1).cast("long")).join(kids, ["file", "id"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)).cast("long"))
