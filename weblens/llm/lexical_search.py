"""The k best documents of each query by a ranked word search with integer scores.

Documents are read once: a task counts the terms of whole texts and packs what the queries' terms
occur in into chunks of a bounded number of postings. Which terms matter is told by a bit table of
fixed size over all queries' terms, so that nothing grows with the number of queries on the way
to the tasks; terms that pass by chance weigh nothing. Counts of documents and terms are then sums
over all documents, and weights of terms join the queries.

Each chunk meets each block of queries, and is ranked term at a time: rarest term first, into one
accumulator per document. As soon as all that the remaining terms could add is less than the k-th
best partial score, no new accumulators are created; those there are go on exactly. The chunks'
best k meet in a ranked window, which Spark cuts to k per query before the shuffle.

A document's score is the sum over the query's terms, repeats included, of
`w * ((1000000000*tf) div (1000*tf + 12*m))`, with `m = 75 + (25*n*N) div L` and
`w = floor(1000*ln((2N+2)/(2df+1)))`; equal scores rank by ascending document id.

Cases: a NULL or empty text has no terms; it is neither counted nor found, and as a query finds
nothing. Texts are read whole, however long. A query that is given twice is answered twice, a
document given twice is two documents. A NULL document id ranks after all others, a NULL query id
is kept. An empty table on either side gives no rows. Further columns are not looked at, so their
names may clash with anything. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weblens.llm.store import bit_table, stored
from weblens.llm.text import blocks, signed, span_hashes

#: Bits of the table of query terms: 2 MB, whatever the number of queries.
TABLE_BITS = 24
#: Postings of a chunk of documents, of which one more document may be too many.
CHUNK = 200_000
#: Terms of a block of queries.
BLOCK_TERMS = 20_000
#: Rows a block of queries is copied to, so that chunks of documents do not meet it in one task.
COPIES = 64

IS_TERM = np.ones(256, dtype=bool)
IS_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_CHUNK_SCHEMA = ("ids array<long>, sizes array<long>, ends array<int>, terms array<long>, tfs array<int>, "
                 "filled long, words long")


def counted_terms(column: pa.Array, table: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: its first row, each text's number of terms, and (text, term, count)
    of its different terms in ascending order; with a table only of terms whose bit is set."""
    for block in blocks(column):
        block.data = LOWER[block.data]
        starts, ends, at = block.words(IS_TERM)
        sizes = np.diff(at)
        hashes = span_hashes(block.data, starts, ends)
        text = np.repeat(np.arange(len(sizes)), sizes)
        if table is not None:
            place = hashes >> np.uint64(64 - TABLE_BITS)
            known = (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
            hashes, text = hashes[known], text[known]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        yield block.first, sizes, text[first], hashes[first], np.diff(np.append(first, len(text)))


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, repeats) of numbered queries."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, text, term, count in counted_terms(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query").take(pa.array(text + first)), pa.array(signed(term)), pa.array(count, pa.int64())],
                    names=["query", "term", "repeats"])

    return queries.select("query", "text").mapInArrow(task, "query long, term long, repeats long")


def _chunks(docs: DataFrame, table: bytes, most: int) -> DataFrame:
    """Packed postings of documents with a query term; documents without one are counted alone."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table, np.uint8)
        held: list[tuple] = []
        filled = words = 0

        def packed() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held]) if held else pa.array([], pa.int64())
            sizes, counts, terms, tfs = (
                np.concatenate([h[i] for h in held]) if held else np.empty(0, np.int64) for i in range(1, 5))
            def one(kind, values):
                return pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(pa.int64(), sizes),
                one(pa.int32(), np.cumsum(counts)), one(pa.int64(), signed(terms.astype(np.uint64))), one(pa.int32(), tfs),
                pa.array([filled], pa.int64()), pa.array([words], pa.int64())],
                names=["ids", "sizes", "ends", "terms", "tfs", "filled", "words"])

        for batch in batches:
            ids = batch.column("id").cast(pa.int64())
            for first, sizes, text, term, count in counted_terms(batch.column("text"), bits):
                filled += int(np.count_nonzero(sizes))
                words += int(sizes.sum())
                per_text = np.bincount(text, minlength=len(sizes))
                upto = np.concatenate(([0], np.cumsum(per_text)))
                low = 0
                while low < len(sizes):
                    room = most - sum(len(h[3]) for h in held)
                    stop = max(low + 1, int(np.searchsorted(upto, upto[low] + room, "right")) - 1)
                    some = low + np.flatnonzero(per_text[low:stop])
                    if len(some):
                        part = slice(upto[low], upto[stop])
                        held.append((ids.take(pa.array(some + first)), sizes[some], per_text[some], term[part], count[part]))
                    if sum(len(h[3]) for h in held) >= most:
                        yield packed()
                        held, filled, words = [], 0, 0
                    low = stop
        if held or filled:
            yield packed()

    return docs.mapInArrow(task, _CHUNK_SCHEMA)


def _frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df) over all chunks, summed up in the tasks first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts, pa.int64())], names=["term", "df"])

    return chunks.select("terms").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Postings:
    """The postings of one chunk, by term; the impact of each is known once for all queries."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 filled: int, words: int):
        self.unknown = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        tf = tfs.astype(np.int64)
        m = 75 + (25 * sizes * filled) // words
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.terms, start = np.unique(terms[order], return_index=True)
        self.bounds = np.append(start, len(terms))
        self.doc, self.impact = doc[order], impact[order]
        self.most = np.maximum.reduceat(self.impact, start) if len(start) else np.empty(0, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents; `weights` are ascending by frequency of the
        terms, that is, rarest first, and hold the repeats."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (weights > 0)
        here[here] = self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        left = np.cumsum((weights * self.most[at])[::-1])[::-1]
        scores = np.zeros(len(self.ids), np.int64)
        open_ = True
        for n, (t, w) in enumerate(zip(at.tolist(), weights.tolist())):
            if open_ and n and len(scores) > k:
                kth = int(np.partition(scores, -k)[-k])
                open_ = left[n] >= kth
            part = slice(self.bounds[t], self.bounds[t + 1])
            docs, gain = self.doc[part], w * self.impact[part]
            if not open_:
                alive = scores[docs] > 0
                docs, gain = docs[alive], gain[alive]
            scores[docs] += gain
        found = np.flatnonzero(scores)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        order = np.lexsort((self.ids[found], self.unknown[found], -scores[found]))[:k]
        return found[order], scores[found[order]]


def _ranked(pairs: DataFrame, k: int, filled: int, words: int) -> DataFrame:
    """(query, doc_id, score): the best k of each chunk for each query of the block it met."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def values(name, row):
                return batch.column(name)[row].values
            for row in range(batch.num_rows):
                postings = Postings(values("ids", row), *(values(c, row).to_numpy() for c in ("sizes", "ends", "terms", "tfs")),
                                    filled, words)
                block = values("block_terms", row)
                query, term, weight = (block.field(i).to_numpy() for i in range(3))
                order = np.lexsort((term, np.asarray(block.field(3)), query))
                query, term, weight = query[order], term[order], weight[order]
                starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
                out: list[tuple] = []
                for low, high in zip(starts, np.append(starts[1:], len(query))):
                    places, scores = postings.best(term[low:high], weight[low:high], k)
                    out.append((np.full(len(places), query[low]), places, scores))
                places = np.concatenate([o[1] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[0] for o in out]), pa.int64()),
                     pa.array(postings.ids[places], pa.int64(), mask=postings.unknown[places]),
                     pa.array(np.concatenate([o[2] for o in out]), pa.int64())], names=["query", "doc_id", "score"])

    return pairs.mapInArrow(task, "query long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", query_id: str = "item_id",
           text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, doc_id and score of the k best documents of each query, as described above."""
    spark = docs.sparkSession
    numbered = stored(queries.select(
        F.monotonically_increasing_id().alias("query"), F.col(f"`{query_id}`").alias("query_id"),
        F.col(f"`{text}`").cast("string").alias("text")), "queries")
    asked = stored(_query_terms(numbered), "query-terms")
    table = bit_table(asked.select("term"), F.shiftrightunsigned("term", 64 - TABLE_BITS), TABLE_BITS)
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    chunks = stored(_chunks(given, table, chunk).withColumn("chunk", F.monotonically_increasing_id()), "postings")
    filled, words = chunks.agg(F.sum("filled"), F.sum("words")).first()
    if not filled:
        filled, words = 1, 1

    rarity = F.floor(1000 * F.log(F.lit(float(2 * filled + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighted = asked.join(_frequencies(chunks), "term").select(
        "query", "term", (F.col("repeats") * rarity).cast("long").alias("weight"), "df")
    n_blocks = asked.count() // BLOCK_TERMS + 1
    blocked = weighted.groupBy(F.pmod(F.xxhash64("query"), F.lit(n_blocks).cast("long")).alias("block")).agg(
        F.collect_list(F.struct("query", "term", "weight", "df")).alias("block_terms"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    met = (
        chunks.select("ids", "sizes", "ends", "terms", "tfs", F.pmod(F.xxhash64("chunk"), F.lit(COPIES)).cast("int").alias("copy"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
        .where(F.size("ids") > 0)
        .join(blocked.select("block", "block_terms", copies), ["block", "copy"])
        .drop("block", "copy")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        _ranked(met, k, filled, words).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .join(numbered.select("query", F.col("query_id").alias("__id")), "query")
        .select(F.col("__id").alias(query_id), "rank", "doc_id", "score")
    )


def ranked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of each benchmark item's 20 best documents."""
    return search(docs, benchmark, k=20)


#: The same in DuckDB SQL.
SQL = r"""
WITH terms AS (
    SELECT doc_id, d, unnest(t) AS term, len(t) AS n
    FROM (SELECT doc_id, row_number() OVER () AS d,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)),
postings AS (SELECT any_value(doc_id) AS doc_id, d, term, any_value(n) AS n, count(*) AS tf FROM terms GROUP BY d, term),
whole AS (SELECT count(DISTINCT d) AS docs, count(*) AS words FROM terms),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, whole GROUP BY term),
items AS (
    SELECT item_id, i, term, count(*) AS repeats
    FROM (SELECT item_id, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT *, row_number() OVER () AS i FROM benchmark))
    GROUP BY ALL),
scored AS (
    SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
           CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
    FROM items JOIN postings USING (term) JOIN weights USING (term), whole
    GROUP BY i, d),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
