"""JSON documents of any size as pieces that hold whole elements (behind S1-S3).

A file that is one JSON array or object has no line breaks to split it at, but an element that is an object ends
with a closing brace.  The splittable text source reads such files with ``}`` as line separator, so one file
is read by as many tasks as it has splits.  Whether a brace ends an element depends on what
stands before it: is it inside a string, and how deep.  A backslash stands in strings only, and a
brace is never the escaped character, so each fragment's quotes and brackets are counted on their own, once for a start
outside and once for a start inside a string; splits are composed from their totals (one row a split), and a running
sum inside each split finds the fragments that end an element.  Fragments are brought together by split, never by file;
an element that crosses splits is glued from the last piece of one and the first of the next.

What a task holds is a split (``spark.sql.files.maxPartitionBytes``) or one element, whichever is larger.  Elements without a
brace (nulls, numbers, strings, lists of them) stay with the object that follows, so a run of them is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_SPLIT = ["file_path", "file_start"]
_BLANK = " \t\r\n"
_STRING = r'"[^"]*+("|\z)'


def _opened(text: Column) -> Column:
    """Opening less closing brackets of a text without strings; the brace that ended it is not part of it."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "[{", ""))


def _fragments(spark: SparkSession, names: list[str]) -> DataFrame:
    """Texts between closing braces with ``q`` (1: an odd number of quotes) and the change in depth, brace included,
    for a start outside (``d0``) and inside (``d1``) a string."""
    text = spark.read.text(names, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_start"),
        F.monotonically_increasing_id().alias("at"))
    # column by column, so that no pattern runs twice over a text
    text = text.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))  # an escaped character opens and ends nothing
    text = text.withColumn("out", F.regexp_replace("bare", _STRING, "")) \
               .withColumn("in", F.regexp_replace(F.concat(F.lit('"'), F.col("bare")), _STRING, "")) \
               .withColumn("q", (F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))) % 2)
    return text.select("value", *_SPLIT, "at", "q", (_opened(F.col("out")) - (1 - F.col("q"))).alias("d0"),
                       (_opened(F.col("in")) - F.col("q")).alias("d1"))


def _by_state(state: Column, outside: str, inside: str) -> Column:
    return F.when(state == 0, F.col(outside)).otherwise(F.col(inside))


def _sum(col, window) -> Column:
    return F.coalesce(F.sum(col).over(window), F.lit(0))


def _pieces(fragments: DataFrame, ends: tuple[int, ...]) -> DataFrame:
    """(file_path, file_start, g, at, text, first, clean, closed): the runs of fragments of a split that end with an element.

    ``first``: begins the file; ``clean``: begins where an element may begin; ``closed``: ends with an element.
    ``ends``: the depths at which a document may end, where a brace is counted after the last fragment too."""
    order = Window.partitionBy(*_SPLIT).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = fragments.withColumn("p", _sum("q", before) % 2)  # state, as if the split began outside a string
    splits = rows.groupBy(*_SPLIT).agg((F.sum("q") % 2).alias("sq"), F.sum(_by_state(F.col("p"), "d0", "d1")).alias("s0"),
                                       F.sum(_by_state(F.col("p"), "d1", "d0")).alias("s1"))
    of_file = Window.partitionBy("file_path").orderBy("file_start")  # one row a split
    earlier, whole = of_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_path")
    splits = splits.withColumn("state", _sum("sq", earlier) % 2)
    change = _by_state(F.col("state"), "s0", "s1")
    splits = splits.withColumn("end", F.sum(change).over(whole)).withColumn("odd", F.sum("sq").over(whole) % 2)
    wrong = F.raise_error(F.concat(F.lit("JSON document without its end: "), F.col("file_path"))).cast("long")
    splits = splits.withColumn("depth", F.when((F.col("odd") == 0) & F.col("end").isin(*ends), _sum(change, earlier)).otherwise(wrong)) \
                   .select(*_SPLIT, "state", "depth", (F.row_number().over(of_file) == 1).alias("head"))
    rows = rows.join(splits, _SPLIT).withColumn("st", (F.col("p") + F.col("state")) % 2)
    after = F.col("depth") + F.sum(_by_state(F.col("st"), "d0", "d1")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ends", ((F.col("st") + F.col("q")) % 2 == 0) & (after == 1))
    rows = rows.withColumn("g", _sum(F.col("ends").cast("int"), before))
    fresh = F.col("head") | ((F.col("state") == 0) & (F.col("depth") == 1))
    return rows.groupBy(*_SPLIT, "g").agg(
        F.min("at").alias("at"), _glued(F.struct("at", "value")).alias("text"),
        F.first(F.col("head") & (F.col("g") == 0)).alias("first"), F.first(fresh | (F.col("g") > 0)).alias("clean"),
        F.max("ends").alias("closed"))


def _glued(ordered: Column) -> Column:
    """The last fields of the structs in their order, with the braces that stood between them."""
    fields = F.array_sort(F.collect_list(ordered))
    return F.array_join(F.transform(fields, lambda x: x["value"]), "}")


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces that are whole, and those glued from the pieces of several splits.  Only the numbers of the border
    pieces (two a split) go through the window over a file."""
    whole = F.col("clean") & F.col("closed")
    border = pieces.where(~whole)
    running = Window.partitionBy("file_path").orderBy("file_start", "g").rowsBetween(Window.unboundedPreceding, 0)
    begins = border.select(*_SPLIT, "g", F.last(F.when(F.col("clean"), F.struct(F.col("file_start").alias("s"), "at")), True)
                           .over(running).alias("begin"))
    glued = border.join(begins, [*_SPLIT, "g"]).groupBy("file_path", "begin").agg(
        _glued(F.struct("file_start", "g", F.col("text").alias("value"))).alias("text"),
        F.max("first").alias("first"), F.max("closed").alias("closed"))
    glued = glued.select("file_path", F.col("begin.s").alias("file_start"), F.col("begin.at").alias("at"), "text", "first", "closed")
    return pieces.where(whole).select(*glued.columns).unionByName(glued)


def _bodies(pieces: DataFrame, opening: str, closing: str) -> DataFrame:
    """``body``: the elements of a piece as a document of their own; what does not fit the layout is an error."""
    wrong = F.raise_error(F.concat(F.lit("malformed JSON document: "), F.col("file_path"))).cast("string")
    text = F.col("text")
    pieces = pieces.withColumn("text", F.trim("text", F.lit(_BLANK)))
    # the piece that is not closed is the file's last
    if closing == "]":
        last = F.when(F.endswith(text, F.lit("]")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(wrong)
    else:  # the brace that closes the document may be the separator after its last fragment
        last = F.when(F.endswith(text, F.lit("}")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    pieces = pieces.withColumn("text", F.when(F.col("closed"), F.concat(text, F.lit("}"))).otherwise(F.rtrim(last, F.lit(_BLANK))))
    # all but the first begin with a comma, or are the end of a document and hold nothing
    fits = F.when(F.col("first"), F.startswith(text, F.lit(opening))) \
            .otherwise((text == "") | (F.startswith(text, F.lit(",")) & (F.length(text) > 1)))
    return pieces.withColumn("body", F.when(fits, F.concat(F.lit(opening), F.substring(text, F.lit(2), F.length(text)), F.lit(closing)))
                             .otherwise(wrong))


def read_pieces(spark: SparkSession, names: list[str], opening: str) -> DataFrame:
    """(file_path, file_start, at, body): every element of the files once, in documents of one or a few elements; the order
    of a file's elements is that of (file_start, at, place in the body).

    ``opening`` is ``[`` or ``{``.  Positions are counted in one scan, so its fragments are written once, and so are the
    pieces.  Files that are empty have no rows.  A document that begins or ends otherwise, or lacks a comma, is an error;
    a missing last brace after the last whole record of an object is not noticed."""
    fragments = cut_lineage(_fragments(spark, names))
    pieces = cut_lineage(_pieces(fragments, (-1,) if opening == "[" else (-1, 0)))
    return _bodies(_joined(pieces), opening, "]" if opening == "[" else "}").select(*_SPLIT, "at", "body")
