"""What a task does with a batch of rows and a block of queries at once, in Arrow and numpy.

A join gives one row for each query and passage with a word in common, or for
each query and vector: with hundreds of queries that is hundreds of rows for
each row read. Here the same numbers go into a small table of rows by queries,
and a task passes on k rows for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS_AT_ONCE = 512
CELLS_AT_ONCE = 4096  # scores that are made exact at once
FLOAT_ERROR = 2.0**-23  # of a number in single precision
PASSAGES_AT_ONCE = 2048  # whose postings are made at once
COMMON_SHARE = 1 / 16  # of the queries: a word at least that many use is scored in the matrix product
COMMON_TERMS = 1024  # at most: bounds the full table of weights


class QueryBlock(NamedTuple):
    """Weights of a block of queries by term: entries ``starts[t]`` to ``starts[t + 1]`` belong to term t."""

    query_ids: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    numbers: np.ndarray  # position in query_ids
    weights: np.ndarray
    wants: dict[str, np.ndarray]  # column -> wanted value of each query, None for any


def query_block(table: pa.Table) -> QueryBlock:
    """From rows query_id, term, weight and optional want_lang, want_source."""
    ids, first, numbers = np.unique(table["query_id"].to_numpy(), return_index=True, return_inverse=True)
    names = table["term"].combine_chunks().dictionary_encode()
    by_name = pc.sort_indices(names.dictionary)
    place = np.empty(len(by_name), np.int64)
    place[by_name.to_numpy()] = np.arange(len(by_name))
    term = place[names.indices.to_numpy()]
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(by_name) + 1))
    wants = {
        c.removeprefix("want_"): table[c].take(pa.array(first)).to_numpy(zero_copy_only=False)
        for c in table.column_names if c.startswith("want_")
    }
    return QueryBlock(ids, names.dictionary.take(by_name), starts, numbers[order], table["weight"].to_numpy()[order], wants)


def document_block(table: pa.Table) -> QueryBlock:
    """The same from documents as queries: doc_id, terms and weights."""
    table = table.combine_chunks()
    terms, weights = (table[c].combine_chunks() for c in ("terms", "weights"))
    return query_block(pa.table({
        "query_id": np.repeat(table["doc_id"].to_numpy(), pc.list_value_length(terms).to_numpy()), "term": terms.flatten(), "weight": weights.flatten()}))


class TopK:
    """The k best of each query so far: by score, then by the ids in their order."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)  # score of each query's k-th best
        self.rows: list[tuple[np.ndarray, ...]] = []  # query number, score, ids
        self.offered = 0  # rows since the last trim

    def offer(self, scores: np.ndarray, numbers: np.ndarray, *ids: np.ndarray) -> None:
        """Scores of rows by queries, -inf for none; the queries' numbers; the rows' ids."""
        limit = self.floor[numbers]
        if len(scores) > self.k:
            place = len(scores) - self.k
            limit = np.maximum(limit, np.partition(scores, place, axis=0)[place])
        row, column = np.nonzero((scores >= limit) & (scores > -np.inf))
        self.rows.append((numbers[column], scores[row, column], *[one[row] for one in ids]))

    def offer_sums(self, scores: np.ndarray, error: float, exact: Callable, digits: int, *ids: np.ndarray) -> None:
        """Scores of rows by all queries, 0 for none, that are off by the part ``error`` at most.

        Only cells that can be among the best are made ``exact`` (rows, columns) and rounded; nothing else is done for each cell.
        """
        near = 10.0**-digits  # rounded scores are equal only within this
        limit = np.maximum(self.floor - near, 0.0) * (1 - error)
        still = np.flatnonzero(np.isneginf(self.floor))  # queries without k rows so far
        if len(scores) > self.k and len(still):
            place = len(scores) - self.k
            least = np.partition(scores[:, still], place, axis=0)[place]
            limit[still] = np.maximum(limit[still], (least * (1 - error) - near) * (1 - error))
        row, column = np.nonzero((scores >= limit.astype(scores.dtype) * (1 - FLOAT_ERROR)) & (scores > 0))
        if len(row):
            self.rows.append((column, np.round(exact(row, column), digits), *[one[row] for one in ids]))
            self.offered += len(row)
        if self.offered > len(self.floor):
            self.trim()
            self.offered = 0

    def trim(self) -> None:
        if not self.rows:
            return
        rows = [np.concatenate(column) for column in zip(*self.rows)]
        order = np.lexsort((*rows[:1:-1], -rows[1], rows[0]))
        query = rows[0][order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = order[place == self.k - 1]
        self.floor[rows[0][last]] = rows[1][last]
        kept = order[place < self.k]
        self.rows = [tuple(column[kept] for column in rows)]


def best_passages(
    batches: Iterator[pa.RecordBatch], block: tuple, avg_length: float, k: int, k1: float, b: float, digits: int
) -> Iterator[pa.RecordBatch]:
    """The task's k best passages for each query: query_id, doc_id, chunk, score."""
    block = QueryBlock(*block)
    common = _common_terms(block)
    top = TopK(len(block.query_ids), k)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            scores, exact = _scores(part, block, common, avg_length, k1, b)
            top.offer_sums(scores, common.error, exact, digits, part["doc_id"].to_numpy(), part["chunk"].to_numpy())
    top.trim()
    for query, score, doc, chunk in top.rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.query_ids[query]), pa.array(doc), pa.array(chunk, pa.int32()), pa.array(score)],
            ["query_id", "doc_id", "chunk", "score"],
        )


def best_documents(batches: Iterator[pa.RecordBatch], block: tuple, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """The task's k documents (doc_id, terms, weights) with the highest sums of products for each of the block's: from_doc, doc_id, score."""
    block = QueryBlock(*block)
    common = _common_terms(block)
    top = TopK(len(block.query_ids), k)
    for batch in batches if len(block.query_ids) else ():
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            docs = part["doc_id"].to_numpy()
            term = pc.index_in(part["terms"].flatten(), value_set=block.terms).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(docs)), pc.list_value_length(part["terms"]).to_numpy())
            known = term >= 0
            scores, exact = _sums(term[known], row[known], part["weights"].flatten().to_numpy()[known], len(docs), block, common)
            # No document is near itself.
            place = np.minimum(np.searchsorted(block.query_ids, docs), len(block.query_ids) - 1)
            own = np.flatnonzero(block.query_ids[place] == docs)
            scores[own, place[own]] = 0.0
            top.offer_sums(scores, common.error, exact, digits, docs)
    top.trim()
    for query, score, doc in top.rows:
        yield pa.RecordBatch.from_arrays([pa.array(block.query_ids[query]), pa.array(doc), pa.array(score)], ["from_doc", "doc_id", "score"])


class CommonTerms(NamedTuple):
    """Terms many queries share: each term's row in a full table of weights (or -1), that table, and the part by which a
    sum of its products in single precision is off at most (all products are positive)."""

    place: np.ndarray
    weights: np.ndarray
    single: np.ndarray
    error: float


def _common_terms(block: QueryBlock) -> CommonTerms:
    n_entries = np.diff(block.starts)
    common = np.flatnonzero(n_entries >= max(2, len(block.query_ids) * COMMON_SHARE))
    common = common[np.argsort(-n_entries[common], kind="stable")[:COMMON_TERMS]]
    place = np.full(len(n_entries), -1)
    place[common] = np.arange(len(common))
    table = np.zeros((len(common), len(block.query_ids)))
    for i, t in enumerate(common):
        entries = slice(block.starts[t], block.starts[t + 1])
        table[i, block.numbers[entries]] = block.weights[entries]
    return CommonTerms(place, table, table.astype(np.float32), (len(common) + 8) * FLOAT_ERROR)


def _scores(
    part: pa.RecordBatch, block: QueryBlock, common: CommonTerms, avg_length: float, k1: float, b: float
) -> tuple[np.ndarray, Callable]:
    """BM25 of each passage (row) for each query (column), as ``_sums`` has it."""
    n_rows = part.num_rows
    lengths = part["n_tokens"].to_numpy()
    term = pc.index_in(part["tokens"].flatten(), value_set=block.terms).fill_null(-1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n_rows), lengths)
    known = term >= 0
    pair, tf = np.unique(term[known] * n_rows + row[known], return_counts=True)
    term, row = pair // n_rows, pair % n_rows
    gain = tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * lengths[row] / avg_length))
    scores, exact = _sums(term, row, gain, n_rows, block, common)
    for column, wanted in block.wants.items():
        have = part[column].to_numpy(zero_copy_only=False)
        allowed = (wanted[None, :] == have[:, None]) | np.equal(wanted, None)[None, :]
        scores[~allowed] = 0.0
    return scores, exact


def _sums(
    term: np.ndarray, row: np.ndarray, gain: np.ndarray, n_rows: int, block: QueryBlock, common: CommonTerms
) -> tuple[np.ndarray, Callable]:
    """Sums over terms of the rows' gains times the queries' weights: of all rows by all queries in single precision,
    and a function that gives those of (rows, columns) in double precision."""
    n_queries = len(block.query_ids)
    # Words many queries share: a product of two full tables.
    shared = common.place[term] >= 0
    gains = np.zeros((n_rows, len(common.weights)))
    gains[row[shared], common.place[term[shared]]] = gain[shared]
    scores = gains.astype(np.float32) @ common.single

    # Other words: one number for each passage and query that share the word.
    term, row, gain = term[~shared], row[~shared], gain[~shared]
    n_entries = block.starts[term + 1] - block.starts[term]
    ends = np.cumsum(n_entries)
    entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(block.starts[term] - ends + n_entries, n_entries)
    cell = np.repeat(row * n_queries, n_entries) + block.numbers[entry]
    rest = np.bincount(cell, np.repeat(gain, n_entries) * block.weights[entry], n_rows * n_queries).astype(np.float64, copy=False).reshape(n_rows, n_queries)
    scores += rest

    def exact(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = rest[rows, columns]
        for i in range(0, len(rows), CELLS_AT_ONCE):
            some = slice(i, i + CELLS_AT_ONCE)
            out[some] += np.einsum("ij,ij->i", gains[rows[some]], common.weights.T[columns[some]])
        return out

    return scores, exact


def postings_of(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The postings of passages (doc_id, chunk, tokens, own, lang, source): a row for each passage and distinct term.

    The rows of so many passages at a time are in order of the terms (by their bytes, as Spark has it), and of the passages
    within a term: a table sorted by term is then merged from a few long runs.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, PASSAGES_AT_ONCE):
            part = batch.slice(at, PASSAGES_AT_ONCE)
            words = part["tokens"].flatten().dictionary_encode()
            if not len(words):
                continue
            lengths = pc.list_value_length(part["tokens"]).to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            by_name = pc.sort_indices(words.dictionary)
            number = np.empty(len(by_name), np.int64)
            number[by_name.to_numpy()] = np.arange(len(by_name))
            # Stable, so that the places of a term stay in order.
            key = number[words.indices.to_numpy()] * len(lengths) + row
            order = np.argsort(key, kind="stable")
            key, row, place = key[order], row[order], place[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            owned = np.add.reduceat(place < part["own"].to_numpy()[row], heads, dtype=np.int32)
            positions = (part["chunk"].to_numpy()[row] * step + place).astype(np.int32)
            ends = np.append(heads, len(key)).astype(np.int32)
            passage = row[heads]
            rows = part.select(["doc_id", "chunk", "lang", "source"]).take(pa.array(passage))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["chunk"], words.dictionary.take(by_name.take(pa.array(key[heads] // len(lengths)))), pa.array(np.diff(ends)), pa.array(owned),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(positions)), pa.array(lengths[passage].astype(np.int32)), rows["lang"], rows["source"]],
                ["doc_id", "chunk", "term", "tf", "own_tf", "positions", "len", "lang", "source"],
            )


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as the rows of a table; all need the same number of values."""
    return vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), -1)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zero rows stay zero), and the lengths they had."""
    lengths = np.linalg.norm(rows, axis=1)
    return rows / np.where(lengths > 0, lengths, 1.0)[:, None], lengths


def nearest_centers(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding, list_dist, list_id: each vector with its nearest centre."""
    squares = (centers * centers).sum(axis=1)
    for batch in batches:
        units, _ = unit(matrix(batch["embedding"]))
        chosen = np.argmin(squares - 2.0 * (units @ centers.T), axis=1)
        distance = np.linalg.norm(units - centers[chosen], axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["embedding"], pa.array(distance), pa.array(chosen, pa.int32())],
            ["vec_id", "embedding", "list_dist", "list_id"],
        )


def nearest_vectors(
    batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray,
    probes: dict[int, tuple[np.ndarray, ...]], k: int, digits: int,
) -> Iterator[pa.RecordBatch]:
    """The task's k nearest vectors for each query: query_id, vec_id, score.

    ``probes`` gives for each list the numbers of the queries that look into
    it, their distances to its centre, and how far from each a vector may be.
    """
    top = TopK(len(query_ids), k)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            units, _ = unit(matrix(part["embedding"]))
            ids, lists = part["vec_id"].to_numpy(), part["list_id"].to_numpy()
            for one in np.unique(lists):
                if one in probes:
                    numbers, distance, bound = probes[one]
                    rows = np.flatnonzero(lists == one)
                    gap = np.abs(part["list_dist"].to_numpy()[rows, None] - distance[None, :])
                    scores = np.round(units[rows] @ queries[numbers].T, digits) + 0.0
                    top.offer(np.where(gap <= bound[None, :], scores, -np.inf), numbers, ids[rows])
            top.trim()
    for query, score, vector in top.rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[query]), pa.array(vector), pa.array(score)], ["query_id", "vec_id", "score"]
        )
