"""Label mapping and encoding.

Label dimensions are small (one row per class or per vocabulary word); they
are built with ``distinct`` + a ranking and joined back by equi join, which
AQE turns into a broadcast once the dimension's real size is known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import cut_lineage

# Error messages of the syntax-error dataset -> three classes.
ERROR_LABELS = {
    "unbalanced (){}[]": "unbalanced (){}[]",
    "expected an indented block": "indentation error",
    "unexpected indent": "indentation error",
    "unexpected unindent": "indentation error",
    "unindent does not match any outer indentation level": "indentation error",
    "invalid syntax": "invalid syntax",
}

#: Rows that share one dictionary of words; words of dictionaries and vocabulary, and chunks, in a partition.
CHUNK, WORDS, CHUNKS = 1024, 1 << 18, 4

# Input split names -> output split names.
SPLIT_NAMES = {"train": "train", "dev": "valid", "eval": "test"}


def _map_or_fail(col: Column, mapping: dict, what: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[col], F.raise_error(F.concat(F.lit(f"unknown {what}: "), col.cast("string"))))


def to_labelled(df: DataFrame, src: str, label: str, keep=()) -> DataFrame:
    """Project raw fields (dotted paths allowed) to ``src``, ``label``."""
    return df.select(*[F.col(k) for k in keep], F.col(src).alias("src"), F.col(label).alias("label"))


def map_labels(col, mapping: dict = ERROR_LABELS) -> Column:
    """Many-to-one label map; an unknown value raises."""
    c = F.col(col) if isinstance(col, str) else col
    return _map_or_fail(c, mapping, "label")


def map_split_names(col, mapping: dict = SPLIT_NAMES) -> Column:
    """Raw split names to train/valid/test; an unknown name raises."""
    c = F.col(col) if isinstance(col, str) else col
    return _map_or_fail(c, mapping, "split name")


def label_codes(df: DataFrame, label_col: str = "label", fit_split: str | None = "train",
                split_col: str = "split") -> DataFrame:
    """X10 fit: ``(label, code)`` with code = position in the sorted distinct
    labels of the fit split (train), sorted by the label's own type.

    The original refits on each split's own labels, so its codes can shift
    between splits; fitting once on train and reusing it is the fix."""
    src = df.where(F.col(split_col) == fit_split) if fit_split and split_col in df.columns else df
    labels = src.select(label_col).distinct()
    return labels.withColumn("code", (F.row_number().over(Window.orderBy(label_col)) - 1).cast("int"))


def label_encode(df: DataFrame, codes: DataFrame, label_col: str = "label", out: str = "code") -> DataFrame:
    """X10 transform: label -> code; a label unseen at fit time raises."""
    c = codes.select(F.col(label_col).alias("__l"), F.col("code").alias("__c"))
    j = df.join(c, df[label_col].eqNullSafe(c["__l"]), "left")  # a NULL label is a label too
    return j.withColumn(out, F.coalesce(F.col("__c"), F.raise_error(
        F.concat(F.lit("unknown label: "), F.col(label_col).cast("string"))))).drop("__l", "__c")


def label_decode(df: DataFrame, codes: DataFrame, code_col: str = "code", out: str = "label") -> DataFrame:
    """X10 inverse: code -> label."""
    c = codes.select(F.col("code").alias("__c"), F.col(codes.columns[0]).alias(out))
    return df.join(c, df[code_col] == c["__c"], "left").drop("__c")


def dense_ranks(values: DataFrame, col: str, out: str, first: int = 0) -> DataFrame:
    """Distinct ``values`` with ``out`` = place in their sort order, counted from ``first``.

    Range partitions come in the order of the values, so a value's place is its place in its
    partition plus the rows of the partitions before, of which there is one count each.  Ranges are cut
    by a sample of the values themselves, so long common beginnings make no partition larger.  The
    sorted partitions are written once: counts and rows come from the same ones."""
    place = F.monotonically_increasing_id()  # partition number, then row number, 33 bits
    ranged = values.select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
    rows = cut_lineage(ranged.select(col, F.shiftright(place, 33).cast("int").alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__pos")))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return rows.join(offsets, "__part").select(col, (F.col("__off") + F.col("__pos") + first).alias(out))


def vocabulary(texts: DataFrame, src_col: str = "src", first_id: int = 0, tokens_col: str | None = None) -> DataFrame:
    """Distinct tokens with dense ids in sorted token order."""
    toks = F.col(tokens_col) if tokens_col else tokens(src_col)
    words = texts.select(F.explode(toks).alias("token"))
    return dense_ranks(words, "token", "id", first_id).select("token", F.col("id").cast("int").alias("id"))


def _by_place(df: DataFrame, id_col: str, words: str) -> DataFrame:
    """The rows of ``df`` with their words as ``places`` in the dictionary of their chunk of at most ``CHUNK`` rows, whose
    first row has the dictionary in ``words``.  Written once, as the chunks follow from the tasks."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("chunk", T.LongType()), df.schema[id_col], T.StructField("places", ints),
                           T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches):
        chunk = TaskContext.get().partitionId() << 33
        for rows in batches:
            for at in range(0, rows.num_rows, CHUNK):
                part = rows.slice(at, CHUNK)
                texts = part.column(1)
                coded = pc.list_flatten(texts).dictionary_encode()
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy())])
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.indices.cast(pa.int32()))
                first = pa.ListArray.from_arrays(pa.array([0] + [len(coded.dictionary)] * len(part), pa.int32()), coded.dictionary.cast(pa.string()),
                                                 mask=pa.array([False] + [True] * (len(part) - 1)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), part.column(0), places, first], schema.names)
                chunk += 1

    return cut_lineage(df.select(id_col, words).mapInArrow(run, schema))


def encode_fixed_length(df: DataFrame, vocab: DataFrame, id_col: str, src_col: str = "src",
                        max_length: int = 512, bos_id: int = 0, eos_id: int = 2,
                        pad_id: int | None = 1, unk_id: int = 3, tokens_col: str | None = None) -> DataFrame:
    """X11: start token, token ids truncated to ``max_length - 2``, end token,
    right padding to ``max_length`` and the attention mask.  A missing pad id
    falls back to the end id.

    Only the positions that fit the fixed length leave the token array (that cut is the
    operator's definition).  ``tokens_col`` takes an already tokenized array column
    instead of ``src_col``.

    The vocabulary is joined to the different words of each chunk of rows, not to every word: a frequent word comes
    once a chunk, so no task gets much of it.  The chunks' ids meet their rows by chunk.  Both shuffles have
    partitions by the number of their rows, so a task's share does not grow with the tables."""
    pad = eos_id if pad_id is None else pad_id
    # a text without tokens is a row of length 0
    arr = F.col(tokens_col) if tokens_col else tokens(src_col)
    rows = _by_place(df.select(id_col, F.slice(arr, 1, max_length - 2).alias("__words")), id_col, "__words")
    many = rows.agg(F.count("words").alias("chunks"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    by_word, by_chunk = 1 + (many.words + vocab.count()) // WORDS, 1 + many.chunks // CHUNKS
    words = rows.select("chunk", F.posexplode("words").alias("place", "token")).repartition(by_word, "token")
    ids = (words.join(vocab.select("token", F.col("id").cast("int").alias("id")).repartition(by_word, "token"), "token")
           .select(F.col("chunk").alias("of"), "place", "id").repartition(by_chunk, "of"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([df.schema[id_col], T.StructField("input_ids", ints), T.StructField("attention_mask", ints)])

    def encode(texts, found):
        places = pc.fill_null(pc.list_flatten(texts.column("places")), -1).to_numpy()
        known = np.full(places.max(initial=-1) + 2, unk_id, np.int32)  # the last is for a null word
        known[found.column("place").to_numpy()] = found.column("id").to_numpy()
        end, at = pc.list_value_length(texts.column("places")).to_numpy()[:, None] + 1, np.arange(max_length)
        full = np.full((len(end), max_length), pad, np.int32)
        full[:, 0] = bos_id
        full[(at > 0) & (at < end)] = known[places]
        full[at == end] = eos_id
        offsets = pa.array(np.arange(len(end) + 1) * max_length, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.int32())) for x in (full, (at <= end).astype(np.int32))]
        return pa.Table.from_arrays([texts.column(id_col), *lists], schema.names)

    texts = rows.select("chunk", id_col, "places").repartition(by_chunk, "chunk")
    return texts.groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(encode, schema)
