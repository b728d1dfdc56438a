"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time evaluation over document shards.

*Index.*  Documents are reduced to the terms that the queries ask for: one row for each document with its length,
term numbers and occurrences, written once.  From it come the number of documents, their total length and
each term's document frequency, over all documents.

*Search.*  Each task reads its rows in shards of bounded size, in memory as posting lists in the order of doc_id.
For a query, the short lists are merged first, term at a time, into summed accumulators; these then stand as one more
list, bounded by their largest sum, beside the long lists.  Those are walked document at a time, in windows of
documents: a list's largest score in a window bounds it there, lists whose bounds together stay below the k-th best score are
not walked but only probed for the documents of the others, and a window whose bounds stay below it is skipped.  The
k best documents of a task, with the threshold they set, are kept from shard to shard; a task returns
at most k rows for a query, and the best of all tasks follow from them.

*Queries* go in blocks of about ``BLOCK`` different (item, term) pairs, chosen by the hash of item_id, so what is broadcast
is bounded; another block is another pass.

Scores are 64-bit integers; a bound equal to the threshold is not skipped, so ties are never lost.

Defined cases: null and empty texts have no terms and never rank; items without a term return nothing; rows
that share an item_id are one item with the terms of all; rows that share a doc_id are ranked each by itself; a null
doc_id comes after all others of equal score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut_lineage, id_and_text, rows_of

#: Pairs of item and term in a block of queries, postings in a shard, documents in a window.
BLOCK, SHARD, WINDOW = 1_000_000, 2_000_000, 4096
#: A list is short if it has at most one posting for so many documents of a shard.
SHORT = 32
#: What separates terms: all ASCII but letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_TOP = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
#: Stands for a null doc_id in the order of documents: behind all others.
_LAST = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats; only A-Z are lower-cased."""
    return text.encode().translate(_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), 0)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of the known ones, ascending), tfs."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        get = known.value.get
        for rows in batches:
            ids, sizes, found, tfs = [], [], [], []
            for doc_id, text in rows_of(rows, "doc_id", "text"):
                words = terms(text)
                hits = np.fromiter((h for h in map(get, words) if h is not None), np.int32)
                own, tf = np.unique(hits, return_counts=True)
                ids.append(doc_id)
                sizes.append(len(words))
                found.append(own)
                tfs.append(tf)
            if ids:
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tfs), pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _frequencies(indexed: DataFrame, count: int) -> np.ndarray:
    """Document frequency of each of the block's terms."""

    def run(batches):
        total = np.zeros(count, np.int64)
        for rows in batches:
            total += np.bincount(rows.column("terms").flatten().to_numpy(), minlength=count)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["term", "df"])

    out = np.zeros(count, np.int64)
    for r in indexed.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Lists:
    """Posting lists of a shard: documents by number, in the order of doc_id, with their scores."""

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weights: np.ndarray, n_docs: int, length: int):
        order = np.argsort(doc_ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.doc_ids, self.n_docs = doc_ids[order], len(order)
        m = 10 + (90 * n * n_docs) // max(length, 1)
        doc = np.repeat(place, sizes)
        tf = tfs.astype(np.int64)
        score = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
        by = np.lexsort((doc, terms))
        self.docs, self.scores, terms = doc[by], score[by], terms[by]
        self.begin = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.begin))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.scores, self.begin[there])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[term], self.begin[term + 1]
        return self.docs[a:b], self.scores[a:b]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the sum of several lists as one list."""
    docs, scores = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
    by = np.argsort(docs, kind="stable")
    docs, scores = docs[by], scores[by]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[first], np.add.reduceat(scores, first)


def best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, equal ones by document."""
    if len(scores) > k:
        there = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        there = np.arange(len(scores))
    return there[np.lexsort((docs[there], -scores[there]))][:k]


def top(lists: Lists, query: np.ndarray, k: int, least: int = 1, window: int = WINDOW, short: int = SHORT) -> list[tuple[int, int]]:
    """(score, doc_id) of the k best documents of a shard with a score of ``least`` or more, not sorted."""
    sizes = lists.begin[query + 1] - lists.begin[query]
    query, sizes = query[lists.most[query] > 0], sizes[lists.most[query] > 0]
    few = sizes * short <= lists.n_docs
    parts = [lists.of(t) for t in query[~few]]
    if few.any():
        parts.append(accumulate([lists.of(t) for t in query[few]]))
    # document at a time: windows of documents, with the bound of each list in each of them
    edges = np.arange(0, lists.n_docs + window, window)
    cuts = [np.searchsorted(docs, edges) for docs, _ in parts]
    bounds = np.zeros((len(edges) - 1, len(parts)), np.int64)
    for p, (_, scores) in enumerate(parts):
        there = np.flatnonzero(np.diff(cuts[p]))
        if len(there):
            bounds[there, p] = np.maximum.reduceat(scores, cuts[p][there])
    kept_scores, kept_docs = np.empty(0, np.int64), np.empty(0, np.int64)
    reach = bounds.sum(axis=1)
    for w in np.argsort(-reach, kind="stable").tolist():  # the most promising windows raise the threshold early
        if reach[w] < least:
            break
        by = np.argsort(bounds[w], kind="stable")
        upto = np.cumsum(bounds[w][by])
        probed = int(np.searchsorted(upto, least))  # these alone stay below the threshold
        sums = np.zeros(window, np.int64)
        for p in by[probed:].tolist():
            a, b = cuts[p][w], cuts[p][w + 1]
            sums[parts[p][0][a:b] - edges[w]] += parts[p][1][a:b]
        found = np.flatnonzero(sums)
        for j in range(probed - 1, -1, -1):  # what the lists up to j can still add
            found = found[sums[found] + upto[j] >= least]
            docs, scores = (x[cuts[by[j]][w]:cuts[by[j]][w + 1]] for x in parts[by[j]])
            if not len(found) or not len(docs):
                continue
            at = np.minimum(np.searchsorted(docs, found + edges[w]), len(docs) - 1)
            hit = docs[at] == found + edges[w]
            sums[found[hit]] += scores[at[hit]]
        found = found[sums[found] >= least]
        if len(found):
            kept_scores, kept_docs = np.append(kept_scores, sums[found]), np.append(kept_docs, found + edges[w])
            keep = best(kept_scores, kept_docs, k)
            kept_scores, kept_docs = kept_scores[keep], kept_docs[keep]
            if len(keep) == k:
                least = max(least, int(kept_scores[-1]))
    return list(zip(kept_scores.tolist(), lists.doc_ids[kept_docs].tolist()))


def _shards(batches, most: int):
    """Columns of the rows, with about ``most`` postings at a time."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += len(rows.column("terms").flatten()) + rows.num_rows
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(indexed: DataFrame, items: list, numbers: dict[bytes, int], k: int, shard: int) -> DataFrame:
    """The k best of each task for each item of a block: item (its number), doc_id, score."""
    n_docs, length = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = _frequencies(indexed, len(numbers))
    weights = np.array([weight(n_docs, int(df)) if df else 0 for df in frequency], np.int64)
    shared = indexed.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        tops: list[list] = [[] for _ in items]  # (-score, doc_id), ascending
        for table in _shards(batches, shard):
            listed = table.column("terms").chunk(0)
            ids = table.column("doc_id").fill_null(_LAST).to_numpy()
            lists = Lists(ids, table.column("n").to_numpy(), np.diff(listed.offsets.to_numpy()), listed.flatten().to_numpy(),
                          table.column("tfs").chunk(0).flatten().to_numpy(), weights, n_docs, length)
            for i, query in enumerate(items):
                least = -tops[i][-1][0] if len(tops[i]) == k else 1
                found = [(-s, d) for s, d in top(lists, query, k, least)]
                if found:
                    tops[i] = sorted(tops[i] + found)[:k]
        out = [(i, None if d == _LAST else d, -s) for i, rows in enumerate(tops) for s, d in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TOP)], schema=_TOP)

    return indexed.where("size(terms) > 0").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, with a score above 0."""
    spark = docs.sparkSession
    pairs = cut_lineage(item_terms(items))
    blocks = -(-pairs.count() // block)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        numbers: dict[bytes, int] = {}
        by_item: dict = {}
        for r in mine.collect():  # about ``block`` pairs
            by_item.setdefault(r.item_id, []).append(numbers.setdefault(r.term.encode(), len(numbers)))
        if not by_item:
            continue
        indexed = cut_lineage(index(docs, numbers))
        found = _search(indexed, [np.array(sorted(t), np.int64) for t in by_item.values()], numbers, k, shard)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(by_item)), "item int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def search_sql(k: int = 10) -> str:
    """The same ranking in DuckDB SQL, scoring every pair of item and document that share a term."""
    found = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
with words as (select doc_id, unnest({found}) term from documents),
lengths as (select doc_id, count(*) n from words group by doc_id),
total as (select count(*) n_docs, sum(n)::bigint length from lengths),
tfs as (select doc_id, term, count(*) tf from words group by doc_id, term),
asked as (select distinct item_id, unnest({found}) term from benchmark),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint w from tfs, total group by term, n_docs),
scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length))))::bigint score
  from asked join tfs using (term) join weights using (term) join lengths using (doc_id), total group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {k}"""
