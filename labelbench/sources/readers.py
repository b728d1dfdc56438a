"""Readers for the raw dataset layouts.

Row order carries meaning in several layouts (array position is a join key,
positional clusters, "first k rows").  Spark rows have no order, so every
reader returns an explicit ``ord`` column: the position inside its file, made
dense across files in the order of the given paths, then of the file names.

Line-oriented layouts are read with the splittable text and CSV sources, in one scan whose rows
are written once.  A row's position inside its split comes from the order in which that scan brought it, the
rows of the splits before it from one small count table per (file, split).
Single-document layouts (a JSON array or object per file) are split at closing braces
(see ``documents``), so a large file is read by many tasks too.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..operators.labels import map_labels, map_split_names
from ..session import cut_lineage
from .documents import read_pieces


def list_files(spark: SparkSession, paths) -> list[str]:
    """Data files behind paths, folders or globs, in path order then name order
    (driver-side listing of names only; hidden and ``_`` files skipped)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, None] = {}
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        found = []
        for st in (fs.globStatus(hp) or []):
            if st.isDirectory():
                it = fs.listFiles(st.getPath(), True)
                while it.hasNext():
                    found.append(it.next().getPath())
            else:
                found.append(st.getPath())
        out.update(dict.fromkeys(sorted(str(x) for x in found if not x.getName().startswith(("_", ".")))))
    return list(out)


def _files(spark: SparkSession, paths) -> tuple[list[str], DataFrame]:
    """The files behind the paths, and (file_path, file_no, file_src): their order, and the number of the path that first names them."""
    of: dict[str, int] = {}
    for i, p in enumerate([paths] if isinstance(paths, str) else paths):
        for f in list_files(spark, p):
            of.setdefault(f, i)
    names = [(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).toUri().toString(), no, src) for no, (f, src) in enumerate(of.items())]
    return list(of), spark.createDataFrame(names, "file_path string, file_no int, file_src int")


def _uri(path: Column) -> Column:
    """One form for the URIs of local files, with or without an empty host."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def _placed(df: DataFrame, *cols) -> DataFrame:
    """``cols`` of a file scan with where they stand: file, split, and the order in which the task reads them."""
    return df.select(*cols, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_start"),
                     F.monotonically_increasing_id().alias("__at"))


def _lines(spark: SparkSession, paths, keep_blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """(line, place) for every line of text files, in one scan over all paths, and the files; a carriage return before the line feed goes."""
    names, files = _files(spark, paths)
    if not names:
        raise FileNotFoundError(f"no files behind {paths}")
    text = spark.read.text(names, lineSep="\n").withColumn("line", F.regexp_replace("value", "\r$", ""))
    return _placed(text if keep_blank else text.where(F.col("line") != ""), "line"), files


def _numbered(rows: DataFrame, files: DataFrame, per_path: bool = False) -> DataFrame:
    """``ord`` = 0-based position over all files in their order, or over those of one path.

    Where a scan is split follows from the session's settings and cores at the time it is planned, so positions that are
    counted in one scan say nothing about the rows of another: the rows are written once, and
    the counts and the rows come from that table.  The rows of one split are consecutive in one task, so a row's position in
    it is its number less the split's smallest."""
    rows = cut_lineage(rows)
    place = ["file_path", "file_start"]
    splits = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    known = files.withColumn("__uri", _uri(F.col("file_path"))).drop("file_path")
    splits = splits.withColumn("__uri", _uri(F.col("file_path"))).join(known, "__uri", "left")
    splits = splits.withColumn("file_no", F.when(F.col("file_no").isNull(), F.raise_error(F.concat(F.lit("a file of no path: "), F.col("file_path"))).cast("int"))
                               .otherwise(F.col("file_no")))
    of = Window.partitionBy("file_src") if per_path else Window.partitionBy()
    before = of.orderBy("file_no", "file_start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    start = splits.select(*place, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return rows.join(start, place).withColumn("ord", (F.col("__off") + F.col("__at") - F.col("__first")).cast("long")) \
               .drop(*place, "__at", "__first", "__off")


def _elements(spark: SparkSession, paths: list[str], opening: str) -> DataFrame:
    """(file_no, file_src, file_start, at, body) for the pieces of JSON documents; a file that is named twice is there twice."""
    found = [(p, list_files(spark, p)) for p in paths]
    for p, files in found:
        if not files and not _exists(spark, p):
            raise FileNotFoundError(f"no files behind {p}")
    named = [(f, src) for src, (_, files) in enumerate(found) for f in files]
    uris = [(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).toUri().toString(), no, src) for no, (f, src) in enumerate(named)]
    known = spark.createDataFrame(uris, "uri string, file_no int, file_src int").withColumn("uri", _uri(F.col("uri")))
    pieces = read_pieces(spark, list(dict.fromkeys(f for f, _ in named)) or paths, opening)
    pieces = pieces.withColumn("uri", _uri(F.col("file_path"))).join(known, "uri", "left")
    lost = F.raise_error(F.concat(F.lit("a file of no path: "), F.col("file_path"))).cast("int")
    return pieces.select(F.coalesce("file_no", lost).alias("file_no"), "file_src", "file_start", "at", "body")


def _exists(spark: SparkSession, path: str) -> bool:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hp))


def _dense_ord(rows: DataFrame) -> DataFrame:
    """ord from (file_no, file_start, at, pos): the place in the split, and the rows of the splits before it from one
    small count table."""
    split = ["file_no", "file_start"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    start = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("n")) \
                .select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy(*split).orderBy("at", "pos"))
    return rows.withColumn("place", place).join(start, split) \
               .withColumn("ord", (F.col("off") + F.col("place") - 1).cast("long"))


def _array_rows(spark: SparkSession, paths: list[str], element: str) -> DataFrame:
    """(file_src, r, ord) for the elements of JSON arrays."""
    pieces = _elements(spark, paths, "[")
    return _dense_ord(pieces.select("file_no", "file_src", "file_start", "at", F.posexplode(
        F.from_json("body", f"array<{element}>", {"mode": "FAILFAST"})).alias("pos", "r")))


def read_json_array(spark: SparkSession, paths, schema: str | T.StructType) -> DataFrame:
    """JSON arrays of objects, each file of any size in as many tasks as it has splits; ``ord`` = array position
    (dense across files).  Null elements are rows of nulls."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    rows = _array_rows(spark, [paths] if isinstance(paths, str) else list(paths), ddl)
    return rows.select("r.*", "ord")


def read_labelled_sources(spark: SparkSession, sources: list[tuple[str, str]], field: str = "code") -> DataFrame:
    """Several JSON arrays, one literal label per file, concatenated in the
    given order (the first source's rows first)."""
    rows = _array_rows(spark, [path for path, _ in sources], f"struct<{field}:string>")
    labels = F.array(*[F.lit(label) for _, label in sources])
    return rows.select(F.col(f"r.{field}").alias("src"), F.get(labels, F.col("file_src")).alias("label"), "ord")


BIFI_VALUE = "struct<code_string:string,err_obj:struct<msg:string>>"


def read_json_object(spark: SparkSession, path: str, value_schema: str = BIFI_VALUE) -> DataFrame:
    """S3: JSON object ``id -> record`` with file order kept, a file in as many tasks as it has splits; a repeated key
    of a file keeps its first position and takes its last value (an ordered dict load)."""
    pieces = _elements(spark, [path] if isinstance(path, str) else list(path), "{")
    rows = pieces.select("file_no", "file_start", "at", F.posexplode(
        F.from_json("body", f"map<string,{value_schema}>", {"mode": "FAILFAST"})).alias("pos", "id", "r"))
    rows = rows.withColumn("place", F.struct("file_start", "at", "pos")).groupBy("file_no", "id").agg(
        F.min("place").alias("first"), F.max_by("r", "place").alias("r"))
    return _dense_ord(rows.select("file_no", "first.*", "id", "r")).select("id", "r.*", "ord")


def shard_paths(folder: str, dataset: str, split_in: str, n: int) -> list[str]:
    """File names of the sharded JSON-lines layout for one split."""
    return [f"{folder}/20200621_Python_{dataset}_datasets_{split_in}.jsontxt-0000{i}-of-0000{n}"
            for i in range(n)]


def read_json_lines(spark: SparkSession, paths, schema: str, ordered: bool = True) -> DataFrame:
    """S6 core: JSON lines with a fixed schema (FAILFAST).  ``ordered`` keeps
    ``ord`` = line position across the files in path order."""
    if not ordered:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    rows = _numbered(*_lines(spark, paths, keep_blank=False)).select(
        "ord", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    # the check sits inside the struct column that is read, so it cannot be pruned
    rows = rows.withColumn("r", F.when(F.col("r").isNull(), F.raise_error(F.lit("malformed JSON line")))
                           .otherwise(F.col("r")))
    return rows.select("r.*", "ord")


def read_jsonl_shards(spark: SparkSession, paths: list[str], split: str,
                      src_field: str = "function", label_field: str = "label") -> DataFrame:
    """Shards concatenated in shard order, split name mapped."""
    df = read_json_lines(spark, paths, f"{src_field} string, {label_field} string")
    return df.select("ord", F.col(src_field).alias("src"), F.col(label_field).alias("label"),
                     map_split_names(F.lit(split)).alias("split"))


def shard_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows per shard file (the per-shard log line of the original)."""
    df = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file_name"))
    return df.groupBy(F.regexp_extract("file_name", r"jsontxt-(\d+)-of-", 1).cast("int").alias("shard")) \
             .agg(F.count(F.lit(1)).alias("n"))


def read_index_list(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One integer per line, Python-stripped; duplicates collapse; a blank
    line is an error (ANSI cast)."""
    t = spark.read.text(path)
    v = py_strip(F.col("value"))
    out = t.select(F.when(v == "", F.raise_error(F.lit("blank line in index list"))).otherwise(v)
                   .cast("long").alias("ord")).distinct()
    return out.withColumn("split", F.lit(split)) if split else out


def read_jsonl(spark: SparkSession, path, label_type: str = "string") -> DataFrame:
    """``src``, ``label`` out of JSON lines, with line order as ``ord``."""
    return read_json_lines(spark, path, f"src string, label {label_type}").select("ord", "src", "label")


def read_paired_text(spark: SparkSession, corpus: str, labels: str) -> DataFrame:
    """Corpus and label files zipped by line, each line stripped; files of
    different length are an error."""
    a = _numbered(*_lines(spark, corpus)).select("ord", py_strip("line").alias("src"))
    b = _numbered(*_lines(spark, labels)).select("ord", py_strip("line").alias("label"))
    j = a.join(b, "ord", "full_outer")
    label = F.when(F.col("src").isNull() | F.col("label").isNull(),
                   F.raise_error(F.lit("corpus and label files differ in length"))).otherwise(F.col("label"))
    return j.select(F.col("ord").cast("long"), "src", label.alias("label"))


RUNS_CSV_SCHEMA = {
    "params.combination_type": "string", "params.hidden_layer_to_use": "int", "params.seed": "int",
    "params.epochs": "int", "params.not_special_tokens_to_zero": "boolean",
    "params.num_trainable_parameters": "bigint", "start_time": "string", "end_time": "string",
    "metrics.time_train_min": "double", "metrics.total_time": "string", "metrics.acc_test": "double", "metrics.balanced_acc_test": "double",
    "metrics.f1_micro_test": "double", "metrics.f1_macro_test": "double", "metrics.f1_weighted_test": "double",
}


def _plain(name: str) -> str:
    return re.sub(r"^(params|metrics)\.", "", name).replace(".", "_")


def _typed(col: Column, kind: str) -> Column:
    """The value in its type; a value that does not parse is an error."""
    value = col.try_cast(kind)
    return F.when(col.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"not a {kind}: "), col)).cast(kind)).otherwise(value)


def read_runs_csv(spark: SparkSession, paths: list[str], dataset_pattern: str = r"mlflow_([^/]+)\.csv",
                  multi_line: bool = False) -> DataFrame:
    """Run tables, one CSV file or folder of part files per dataset; dotted headers become plain
    names, every column is kept, ``dataset`` comes from the path, ``ord`` is the row's position
    over the files of its path.

    A dataset's header is the first line of its first file; other part files may repeat it or
    not, since only lines equal to it are dropped.  Broken lines and values that do not parse are errors.  ``multi_line`` reads quoted
    fields with line breaks, at the price of one task per file."""
    parts = []
    for path in paths:
        files = list_files(spark, path)
        if not files:
            raise FileNotFoundError(f"no files behind {path}")
        first = spark.read.text(files[0], lineSep="\n").where(F.col("_metadata.file_block_start") == 0).first()  # only its first split is read
        if first is None:
            continue
        names = next(csv.reader([first.value.rstrip("\r")]))
        rows = (spark.read.schema(", ".join(f"`{h}` string" for h in names)).option("mode", "FAILFAST")
                .option("multiLine", multi_line).option("escape", '"').csv(path))
        is_head = F.lit(True)
        for h in names:
            is_head = is_head & F.col(f"`{h}`").eqNullSafe(F.lit(h or None))
        dataset = F.regexp_extract("_metadata.file_path", dataset_pattern, 1)
        parts.append(_placed(rows.where(~is_head), F.when(dataset == "", F.lit(path)).otherwise(dataset).alias("dataset"),
                             *[_typed(F.col(f"`{h}`"), RUNS_CSV_SCHEMA.get(h, "string")).alias(_plain(h)) for h in names]))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q, allowMissingColumns=True)
    return _numbered(out, _files(spark, paths)[1], per_path=True)


def bifi_labels(df: DataFrame) -> DataFrame:
    """P1 + P3 for the keyed layout: code_string -> src, mapped message -> label."""
    return df.select("ord", "id", F.col("code_string").alias("src"), map_labels(F.col("err_obj.msg")).alias("label"))


# Name -> reader of each raw layout, for callers that pick the layout by name.
READERS = {
    "json_array": read_json_array,          # one array per file, position = key
    "labelled_sources": read_labelled_sources,
    "json_object": read_json_object,        # id -> record, file order kept
    "jsonl_shards": read_jsonl_shards,
    "index_list": read_index_list,
    "jsonl": read_jsonl,
    "paired_text": read_paired_text,
    "runs_csv": read_runs_csv,
}
