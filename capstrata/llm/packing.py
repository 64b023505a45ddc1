"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import columns_of, fresh, number_within
from capstrata.session import stage

#: Letters of these texts have had the same Unicode classes for many versions, so both tokenizer libraries cut them alike.
OLD_CHARACTERS = re.compile(r"[\x00-ɏͰ-ͳΆ-ϿЀ-ҁ‐-‧€]*")
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level BPE vocabulary; one per task.

    The faster library of the two encodes ordinary text; whatever it might cut differently (special tokens
    spelled out in the text, scripts with recent Unicode changes) goes to the tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and SPECIAL not in text and OLD_CHARACTERS.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole capacities, with a shorter first piece where the length leaves a rest."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def tokenize_pieces(df: DataFrame, key: str, text: str, tokenizer_path: str, capacity: int, end_id: int, ranks_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Cut every document's ids (its text's, then end_id) into pieces of at most `capacity`.

    Returns key, piece (from 0), start, length, ids_crc32 (little-endian unsigned 32-bit ids) and, unless
    with_ids is False, the ids. Null text counts as empty; a repeated row gives repeated pieces.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path, ranks_path)
        for batch in batches:
            key_type = batch.schema.field(0).type
            out: list[list] = [[] for _ in range(6)]
            size = 0

            def flush():
                arrays = [pa.array(out[0], key_type), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(out[5], pa.list_(pa.int32())))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end_id], dtype="<u4")
                for i, (start, length) in enumerate(pieces(len(ids), capacity)):
                    part = ids[start:start + length]
                    for c, v in zip(out, (k, i, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        c.append(v)
                size += len(ids)
                if size > 2_000_000:  # tokens in memory at once
                    yield flush()
                    out, size = [[] for _ in range(6)], 0
            yield flush()

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return df.select(key, text).mapInArrow(cut, schema).withColumnRenamed("key", key)


class CapacityTree:
    """Segment tree over remaining capacities 0 .. size: which of them have an open bin."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [0] * (2 * self.width)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.width
        self.open[i] = int(is_open)
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` with an open bin, in logarithmic time."""
        i = need + self.width
        while not self.open[i]:
            while i & 1:  # the right edge of a subtree: climb
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if i & (i - 1) == 0:  # ran over the last leaf's level
                return None
        while i < self.width:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.width


def best_fit_plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of one length are interchangeable and a bin, once chosen as the tightest, stays the tightest until
    it is too full for that length; so a run of equal pieces fills a run of equal bins at once, with the result
    of the piece-by-piece algorithm. Returns (length, first rank, first bin, pieces per bin, offset in the bin):
    the piece of rank r, up to the next run of its length, lies in bin first + (r - first rank) // per_bin at
    offset + (r - first rank) % per_bin * length. Work and memory depend on the capacity, not on the number of pieces.
    """
    runs: dict[int, deque[tuple[int, int]]] = {}
    tree, n_bins, plan = CapacityTree(capacity), 0, []

    def give(c: int, first: int, n: int, front: bool = False) -> None:
        if n and c:
            q = runs.setdefault(c, deque())
            (q.appendleft if front else q.append)((first, n))
            tree.set(c, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = counts[length], 0
        while left:
            c = tree.tightest(length)
            if c is None:
                c, new = capacity, -(-left // (capacity // length))
                give(c, n_bins, new)
                n_bins += new
            first, n = runs[c].popleft()
            if not runs[c]:
                tree.set(c, False)
            per = c // length
            full = min(n, left // per)
            plan.append((length, rank, first, per, capacity - c))
            rank, left = rank + full * per, left - full * per
            give(c - per * length, first, full)
            if full < n and left:  # fewer than one bin takes: a last bin is filled in part
                give(c - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            give(c, first + full, n - full, front=True)
    return plan


def pack_best_fit(df: DataFrame, length: str, capacity: int, order: Sequence[str], sequence_out: str = "sequence_id", offset_out: str = "offset") -> DataFrame:
    """Place pieces into as few sequences of `capacity` as best-fit decreasing finds, over all rows at once.

    Spark counts the lengths (at most `capacity` rows reach the driver, whatever the input), the segment tree
    plans runs of equal pieces, and every row finds its place by its rank within its length. So no task ever
    holds the pieces of a bin group and the packing is that of one global run. The plan is broadcast: it has
    one row per length, with arrays whose total size depends on the capacity alone. Null lengths are refused.
    Rows that tie on `order` are interchangeable. Existing columns named like the results are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in (sequence_out.lower(), offset_out.lower())]
    rank, runs, at, planned = fresh(df.columns, "rank_of_length", "runs_of_length", "run", "plan_length")
    rows = stage(df.select(*columns_of(keep)))
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}
    if None in counts:
        raise ValueError(f"{length} is null in {counts[None]} rows")
    per_length: dict[int, list] = {}
    for n, first_rank, first_bin, per, offset in best_fit_plan(counts, capacity):
        per_length.setdefault(n, []).append((first_rank, first_bin, per, offset))
    plan = df.sparkSession.createDataFrame([(n, r) for n, r in per_length.items()] , f"{planned} long, {runs} array<struct<first_rank:long,first_bin:long,per_bin:long,offset:long>>")
    ranked = number_within(rows, [length], order, rank)
    placed = ranked.join(F.broadcast(plan), F.col(length) == F.col(planned)).drop(planned)
    placed = placed.withColumn(at, F.element_at(F.filter(F.col(runs), lambda r: r["first_rank"] <= F.col(rank)), -1))
    since = F.col(rank) - F.col(f"{at}.first_rank")
    return placed.select(
        *columns_of(keep),
        (F.col(f"{at}.first_bin") + F.floor(since / F.col(f"{at}.per_bin"))).cast("long").alias(sequence_out),
        (F.col(f"{at}.offset") + since % F.col(f"{at}.per_bin") * F.col(length)).cast("long").alias(offset_out),
    )


def assemble(placed: DataFrame, sequence: str = "sequence_id", offset: str = "offset", ids: str = "ids", out: str = "tokens") -> DataFrame:
    """The training sequences themselves: each bin's ids in order of offset. A bin holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(offset).alias("o"), F.col(ids).alias("i"))))
    return placed.groupBy(sequence).agg(F.flatten(F.transform(parts, lambda p: p["i"])).alias(out))
