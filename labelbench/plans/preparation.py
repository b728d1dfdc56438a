"""End-to-end preparation job (the three entry points of the original, as
Spark plans).

``prepare``: labelled rows -> text shrink -> split -> written once as parquet
in the output folder (lineage cut: a lost executor recomputes from the
written table, not from the raw files) -> class table, token tables, overlap
and label check as separate actions on the written table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shrink_text, split_join
from ..operators import profile as PR
from ..operators import splits as SP
from ..session import cut_lineage
from ..sources import sinks as SK


def prepare(df: DataFrame, out_dir: str | None = None, split: str = "three_way", keep_formatting: bool = False,
            shrink: bool = True, devign_style: bool = False, ratio_train: float = 0.8, ratio_valid: float = 0.1,
            ratio_test: float = 0.1, seed: int = 42, id_col: str = "ord", tokenizer=None) -> dict:
    """Run the preparation on ``df(ord, src, label[, split])``.

    ``split``: ``'three_way'`` (W5), ``'given'`` (keep the ``split`` column),
    ``'train_valid'`` (W2 on the rows without a split, the rest is test) or
    ``'cluster'`` (W3 + W2 + J2; ``ord`` must be a dense position).
    Returns the written split table and the profile tables (lazy frames on
    the written data)."""
    x = df
    if shrink:
        x = x.withColumn("src", split_join("src") if devign_style else shrink_text("src", keep_formatting))
    if split == "three_way":
        x = SP.three_way_split(x.drop("split") if "split" in x.columns else x, "label", id_col,
                               ratio_train, ratio_valid, ratio_test, seed)
    elif split == "cluster":  # positional clusters, stratified train/valid by id, last clusters test
        x = SP.cluster_split(x.drop("split") if "split" in x.columns else x, "label", id_col,
                             ratio_train=ratio_train, seed=seed)
    elif split == "train_valid":
        pool = x.where(F.col("split").isNull()).drop("split")
        rest = x.where(F.col("split").isNotNull())
        x = SP.stratified_split(pool, "label", id_col, 1.0 - ratio_train, seed, ("train", "valid")) \
              .unionByName(rest)
    x = PR.with_token_count(x, tokenizer=tokenizer)
    if out_dir:
        # written once; the JSON lines and every profile read the written table
        x.write.mode("overwrite").partitionBy("split").parquet(os.path.join(out_dir, "table"))
        table = x.sparkSession.read.parquet(os.path.join(out_dir, "table"))
        SK.write_split_jsonl(table, os.path.join(out_dir, "jsonl"))
    else:
        table = cut_lineage(x)
    out = {
        "table": table,
        "class_distribution": PR.class_distribution(table),
        "token_count": PR.describe_tokens(table),
        "token_count_per_class": PR.describe_tokens_by_class_wide(table),
        "overlap": PR.split_overlap(table),
        "label_check": PR.label_set_check(table),
        "first_examples": PR.first_examples(table),
    }
    if out_dir:
        # K2: the three profile tables, with the parameters as columns
        params = {"split_method": split, "keep_formatting": keep_formatting, "shrink": shrink, "seed": seed,
                  "ratio_train": ratio_train, "ratio_valid": ratio_valid, "ratio_test": ratio_test}
        SK.write_tables({k: out[k] for k in ("class_distribution", "token_count", "token_count_per_class")},
                        os.path.join(out_dir, "stats"), params)
    return out
