"""Frequencies of n-grams (problem 4) from suffix arrays.

Each task builds the suffix array of the token sequences it holds by prefix
doubling, and from its ranks the common prefix of neighbouring suffixes.  The
suffixes that share a prefix of n terms form an interval: its length is the
number of occurrences of the n-gram, and the number of records is that length
less the adjacencies of suffixes of one record inside the interval.  Both add
up over tasks, so the shuffle gets what is left after this reduction and no
frequent term can skew it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS = 400_000


def suffix_array(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, length of each), in terms; suffixes end with their row, equal ones are in text order.

    ``ids`` are term numbers from 0 in text order, ``row`` the ascending row
    number of each position.
    """
    size = len(ids)
    ends = np.searchsorted(row, row, side="right")
    left = ends - np.arange(size)
    _, rank = np.unique(ids, return_inverse=True)
    ranks, width = [rank.astype(np.int64)], 1
    longest = int(left.max(initial=0))
    while width < longest and ranks[-1].max(initial=0) + 1 < size:
        r = ranks[-1]
        after = np.full(size, -1, dtype=np.int64)
        here = np.flatnonzero(left > width)
        after[here] = r[here + width]
        _, new = np.unique(r * (size + 1) + after + 1, return_inverse=True)
        ranks.append(new.astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    # the ranks of each width tell, from the widest down, how far neighbours agree
    common = np.zeros(size, dtype=np.int64)
    a, b = order[1:], order[:-1]
    most = np.minimum(left[a], left[b])
    shared_terms = np.zeros(size - 1 if size else 0, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        open_ = np.flatnonzero(shared_terms < most)
        x, y = a[open_] + shared_terms[open_], b[open_] + shared_terms[open_]
        shared_terms[open_] += np.where(ranks[k][x] == ranks[k][y], 1 << k, 0)
    if size:
        common[1:] = np.minimum(shared_terms, most)
    return order, common, left[order]


def suffix_counts(ids: np.ndarray, record: np.ndarray, weight: np.ndarray, max_n: int | None, row: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n (all, if None): (n, a start position of each n-gram, occurrences, records, weight).

    ``ids`` are term numbers in text order, ``record`` the record number of
    each position; n-grams don't cross the rows numbered by ``row`` (default:
    the records).
    """
    row = record if row is None else row
    if not len(ids):
        return
    suffixes, common, length = suffix_array(ids, row)
    rec, wt = record[suffixes], weight[suffixes]
    # the suffix of the same record that comes before in the array
    by_record = np.argsort(rec, kind="stable")
    before = np.full(len(ids), -1)
    same = rec[by_record[1:]] == rec[by_record[:-1]]
    before[by_record[1:][same]] = by_record[:-1][same]
    top = int(length.max())
    for n in range(1, min(top, max_n or top) + 1):
        interval = np.cumsum(common < n) - 1
        long_enough = length >= n
        twice = long_enough & (before >= 0) & (interval == interval[before])  # within-record duplicate adjacencies
        groups = interval[-1] + 1
        count = np.bincount(interval, long_enough, groups)
        records = count - np.bincount(interval, twice, groups)
        total = np.bincount(interval, np.where(long_enough, wt, 0), groups)
        first = np.flatnonzero(common < n)
        keep = count > 0
        yield n, suffixes[first[keep]], count[keep].astype(np.int64), records[keep].astype(np.int64), total[keep].astype(np.int64)


def _chunks(max_n: int | None, chunk_tokens: int, by_record: bool):
    """Partial counts of the rows of a task: (ngram as JSON, n, weight, records), or with the record and its weight if ``by_record``."""

    def flush(parts: list[tuple[list[str], object, int]]) -> Iterator[pd.DataFrame]:
        sizes = [len(t) for t, _, _ in parts]
        ids, names = pd.factorize(np.array([t for ts, _, _ in parts for t in ts], dtype=object))
        row = np.repeat(np.arange(len(parts)), sizes)
        weight = np.repeat(np.array([w for _, _, w in parts], dtype=np.int64), sizes)
        records = [r for _, r, _ in parts]
        coded = [json.dumps(x, ensure_ascii=False) for x in names]

        def named(at: np.ndarray, n: int) -> list[str]:
            return ["[" + ",".join([coded[i] for i in ids[a : a + n]]) + "]" for a in at]

        if not by_record:
            for n, at, _, found, total in suffix_counts(ids.astype(np.int64), row, weight, max_n, row):
                yield pd.DataFrame({"ngram": named(at, n), "n": np.int32(n), "rec": None, "wt": total, "recs": found})
            return
        suffixes, common, length = suffix_array(ids.astype(np.int64), row)
        _, number = np.unique(np.array([str(r) for r in records], dtype=object), return_inverse=True)
        rec = number[row][suffixes]
        names_of = dict(zip(number, records))
        top = int(length.max(initial=0))
        for n in range(1, min(top, max_n or top) + 1):
            interval = np.cumsum(common < n) - 1
            ok = np.flatnonzero(length >= n)
            key = interval[ok] * (int(number.max()) + 1) + rec[ok]
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weight[suffixes][ok]).astype(np.int64)
            at = suffixes[ok][first]
            yield pd.DataFrame({"ngram": named(at, n), "n": np.int32(n), "rec": [names_of[r] for r in rec[ok][first]], "wt": total, "recs": 1})

    def arrow(batches):
        parts: list[tuple[list[str], object, int]] = []
        held = 0

        def out():
            for f in flush(parts):
                for i in range(0, len(f), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(f["ngram"].iloc[i : i + 50_000], pa.string()), pa.array(f["n"].iloc[i : i + 50_000], pa.int32()), pa.array([None if r is None else str(r) for r in f["rec"].iloc[i : i + 50_000]], pa.string()), pa.array(f["wt"].iloc[i : i + 50_000], pa.int64()), pa.array(f["recs"].iloc[i : i + 50_000], pa.int64())], names=["ngram", "n", "rec", "wt", "recs"])

        for b in batches:
            for rec, terms, w in zip(b.column("_rec").to_pylist(), b.column("_terms").to_pylist(), b.column("_w").to_pylist()):
                terms = [t for t in json.loads(terms) if t is not None]
                if terms:
                    parts.append((terms, rec, w))
                    held += len(terms)
                if held >= chunk_tokens:
                    yield from out()
                    parts, held = [], 0
        if parts:
            yield from out()

    return arrow


def term_counts(df: DataFrame, record_col: str, terms_col: str, weight_col: str | None = None, max_n: int | None = 1, chunk_tokens: int = CHUNK_TOKENS, row_id: str | None = None) -> DataFrame:
    """(ngram array, n, total, records): occurrences weighted by ``weight_col`` (1 if none, null as 0) and records of every n-gram up to max_n, or of any length if that is None.

    Rows are one per ``row_id`` (default: the record): repeated rows count
    once, the least by weight and terms if they differ.  Several rows may
    belong to one record; n-grams stay within a row, and a record need not be
    in one task.  Null terms are left out and let their neighbours touch; null
    arrays and empty ones add nothing; a row whose record or id is null counts
    nowhere.  Terms are compared by stored characters.
    """
    row = row_id or record_col
    w = F.lit(1) if weight_col is None else F.coalesce(F.col(weight_col).cast("long"), F.lit(0))
    # terms travel as one string, which is a third of the array's size
    rows = df.where(F.col(terms_col).isNotNull() & (F.size(terms_col) > 0)).select(F.col(record_col).alias("_rec"), F.col(row).alias("_row"), w.cast("long").alias("_w"), F.to_json(terms_col, {"ignoreNullFields": "false"}).alias("_terms")).where("_rec is not null and _row is not null")
    one = rows.groupBy("_row").agg(F.min(F.struct("_w", "_terms", "_rec")).alias("r")).select("r._rec", "r._w", "r._terms")
    several = row_id is not None and row_id != record_col
    part = one.mapInArrow(_chunks(max_n, chunk_tokens, several), "ngram string, n int, rec string, wt long, recs long")
    if several:
        part = part.groupBy("ngram", "n", "rec").agg(F.sum("wt").alias("wt")).withColumn("recs", F.lit(1))
    sums = part.groupBy("ngram", "n").agg(F.sum("wt").alias("total"), F.sum("recs").alias("records"))
    return sums.select(F.from_json("ngram", "array<string>").alias("ngram"), "n", "total", "records")


def marked_terms(df: DataFrame, row_id: str, record_col: str, terms_col: str, weight_col: str | None, rare, common_share: float = 0.25, n_records: DataFrame | None = None, max_n: int = 1) -> DataFrame:
    """(term, n, total, records, mark) with mark rare, common or null; the number of all records is joined as one row.

    ``rare`` is a condition on total and records.  ``n_records`` is a one-row
    table ``n_all``; by default the records with a non-null terms array.
    """
    counts = term_counts(df, record_col, terms_col, weight_col, max_n, row_id=None if row_id == record_col else row_id)
    if n_records is None:
        n_records = df.where(F.col(terms_col).isNotNull()).agg(F.countDistinct(record_col).alias("n_all"))
    n_all = F.broadcast(n_records)  # one row
    both = counts.join(n_all)
    mark = F.when(rare, "rare").when(F.col("records") > F.col("n_all") * common_share, "common")
    return both.select(F.array_join("ngram", " ").alias("term"), "n", "total", "records", mark.alias("mark"))
