"""Cross-tokenizer alignment: token ends of two tokenizers merged along merge-path pieces, pair counts over the corpus."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import fresh
from capstrata.llm.packing import OLD_CHARACTERS
from capstrata.session import stage


@dataclass(frozen=True)
class AlignRule:
    """Sizes that bound memory; none of them changes a result.

    `piece` merged ends go into one merge-path piece; `batch` characters are tokenized at once (a longer text alone);
    a block of documents shares one dictionary of groups and is closed after `block` characters or `pairs` id pairs.
    """

    piece: int = 1 << 15
    batch: int = 1 << 20
    block: int = 1 << 24
    pairs: int = 1 << 20


#: Units up to this length are remembered; a task remembers at most so many.
UNIT_CHARS, UNITS_KEPT = 48, 300_000


class Units(dict):
    """Ids of the units between spaces, remembered while a task works."""

    def __init__(self, encode: Callable[[str], Sequence[int]]):
        self.encode = encode

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = tuple(self.encode(unit))
        if len(unit) <= UNIT_CHARS:
            if len(self) >= UNITS_KEPT:
                self.clear()
            self[unit] = ids
        return ids


class TokenizerPair:
    """Ids of space + text under both vocabularies, and every id's bytes.

    A: given the same vocabulary as ranks, texts of characters that both libraries cut alike go to the faster one.
    B: where none of its pieces holds a space behind another character, as is checked, no merge crosses the boundary
    before a space; so texts without runs of spaces (or its own sign for one) are encoded unit by unit, each unit once.
    """

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True  # their strings in a text are ordinary text
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.full_a = lambda s: a.encode(s, add_special_tokens=False).ids
        self.full_b = lambda s: b.encode(s[1:])
        self.fast_a = from_ranks(a_ranks).encode_ordinary if a_ranks else None
        plain = {c: i for i, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * (max(a.get_vocab().values()) + 1)
        for entry, i in a.get_vocab().items():
            self.a_bytes[i] = bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        self.by_unit = not any(re.search(rb"[^ ] ", x) for x in self.b_bytes)
        self.b_units = Units(b.encode)

    def encode_a(self, spaced: str) -> list[int]:
        return (self.fast_a if self.fast_a and OLD_CHARACTERS.fullmatch(spaced) else self.full_a)(spaced)

    def encode_b(self, spaced: str) -> list[int]:
        if self.by_unit and "  " not in spaced and "▁" not in spaced and spaced[-1:] != " ":
            return list(itertools.chain.from_iterable(map(self.b_units.__getitem__, spaced.split(" ")[1:])))
        return self.full_b(spaced)


def from_ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(i if i in visible else next(hidden)) for i in range(256)]


def merge_path(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals 0, size, 2 size, ... cross the path that merges two sorted arrays (equal values: a's first).

    All diagonals are searched at once by bisection. Piece k merges a[i[k]:i[k + 1]] with b[j[k]:j[k + 1]]; every
    piece but the last has `size` elements, however unevenly the values fall, and needs nothing of the others.
    """
    diagonal = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        go = low < high
        m = np.where(go, mid, 0)
        first = np.zeros(len(m), bool)  # a[m] comes before b[diagonal - m - 1]
        first[go] = a[m[go]] <= b[(diagonal - m - 1)[go]]
        low, high = np.where(go & first, mid + 1, low), np.where(go & ~first, mid, high)
    return low, diagonal - low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one piece: how many of a's and of b's ends lie at or before each common end."""
    at = np.searchsorted(a, b)
    hit = np.nonzero((at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b))[0] if len(a) else np.zeros(0, np.int64)
    return at[hit] + 1, hit + 1


def groups_of(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For strictly increasing ends with one last end: (a_stop, b_stop) of every group, in order.

    Pieces emit the common ends inside them; what remains open at a piece's edge is stitched to the next piece's first
    common end, and a pair of equal ends that a diagonal parts (a's end last in its piece) closes a group on the edge.
    """
    i, j = merge_path(a, b, size)
    stops = []
    for k in range(len(i) - 1):
        if i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:
            stops.append((i[k:k + 1], j[k:k + 1] + 1))
        x, y = piece_overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]])
        stops.append((i[k] + x, j[k] + y))
    if not stops:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s[0] for s in stops]), np.concatenate([s[1] for s in stops])


def spread(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each slice's ids in order."""
    with np.errstate(over="ignore"):
        place = np.arange(len(ids)) - np.repeat(starts, stops - starts)
        return spread(np.add.reduceat(spread(spread(ids + 1) + np.uint64(seed) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts) + (stops - starts).astype(np.uint64))


#: Parts the ids of a group's key; no id is negative.
BETWEEN = np.int32(-1).tobytes()


class Dictionary:
    """The distinct groups of a block, their id pairs, and how many of the block's documents hold each pair."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}  # ids of A, -1, ids of B: one short key per group, as a block has very many
        self.texts: list[str] = []
        self.pair_index: dict[int, int] = {}
        self.group_pairs: list[int] = []  # indexes of pairs, group after group
        self.group_weights: list[int] = []  # links of each of those pairs within the group
        self.group_stops: list[int] = [0]
        self.docs = np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> int:
        """The group's number; ids are 32-bit integers."""
        key = a.tobytes() + BETWEEN + b.tobytes()
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.index)
            if len(a) == len(b) == 1:
                codes, weights = [(int(a[0]) << 32) | int(b[0])], [1]
            else:
                (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
                codes, weights = ((x[:, None].astype(np.int64) << 32) | y[None, :]).ravel().tolist(), (m[:, None] * n[None, :]).ravel().tolist()
            self.group_pairs.extend(self.pair_index.setdefault(c, len(self.pair_index)) for c in codes)
            self.group_weights.extend(weights)
            self.group_stops.append(len(self.group_pairs))
            self.texts.append(f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}")
        return at

    def count_documents(self, doc: np.ndarray, group: np.ndarray) -> None:
        """Add the documents of one batch: (document, group) occurrences."""
        both = np.unique(doc * len(self.index) + group)
        doc, group = both // len(self.index), both % len(self.index)
        stops, pairs = np.array(self.group_stops), np.array(self.group_pairs, np.int64)
        n = stops[group + 1] - stops[group]
        held = pairs[np.repeat(stops[group] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        held = np.unique(np.repeat(doc, n) * len(self.pair_index) + held) % len(self.pair_index)
        docs = np.bincount(held, minlength=len(self.pair_index))
        docs[:len(self.docs)] += self.docs
        self.docs = docs


def align_batches(key_type: pa.DataType, a_path: str, b_path: str, a_ranks: str | None, rule: AlignRule):
    """A function for mapInArrow: one row per document, and per block one row with its groups and pairs."""
    schema = pa.schema([
        ("key", key_type), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("digest", pa.string()), ("groups", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
        ("group_texts", pa.list_(pa.string())), ("group_stops", pa.list_(pa.int32())), ("group_pairs", pa.list_(pa.int32())), ("group_weights", pa.list_(pa.int64())),
    ])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seen, block = TokenizerPair(a_path, b_path, a_ranks), Dictionary(), TaskContext.get().partitionId() << 32
        a_size, b_size = (np.array([len(x) for x in t], np.int64) for t in (encode.a_bytes, encode.b_bytes))

        def align(keys: list, texts: list[str]) -> pa.RecordBatch:
            ids: tuple[list, list] = ([], [])
            counts = np.zeros((len(texts), 2), np.int64)
            for d, text in enumerate(texts):
                if text:
                    a, b = encode.encode_a(" " + text), encode.encode_b(" " + text)
                    raw = (" " + text).encode("utf-8", "surrogatepass")
                    if b"".join(map(encode.a_bytes.__getitem__, a)) == raw == b"".join(map(encode.b_bytes.__getitem__, b)):
                        ids[0].append(np.array(a, np.int64))
                        ids[1].append(np.array(b, np.int64))
                        counts[d] = len(a), len(b)
            n_groups, n_links, digests, members = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts), [[]] * len(texts)
            if ids[0]:
                a, b = np.concatenate(ids[0]), np.concatenate(ids[1])
                a_stop, b_stop = groups_of(np.cumsum(a_size[a]), np.cumsum(b_size[b]), rule.piece)
                a_start, b_start = np.append(0, a_stop[:-1]), np.append(0, b_stop[:-1])
                doc = np.searchsorted(np.cumsum(counts[:, 0]), a_start, side="right")
                first = fingerprints(a, a_start, a_stop, 1) ^ fingerprints(b, b_start, b_stop, 2)
                second = fingerprints(a, a_start, a_stop, 3) + fingerprints(b, b_start, b_stop, 4)
                _, where, of = np.unique(first, return_index=True, return_inverse=True)
                if (second[where][of] != second).any():  # 64 bits were not enough
                    _, where, of = np.unique(np.stack([first, second]), axis=1, return_index=True, return_inverse=True)
                short_a, short_b = a.astype(np.int32), b.astype(np.int32)
                group = np.array([seen.add(short_a[s:t], short_b[u:v]) for s, t, u, v in zip(a_start[where].tolist(), a_stop[where].tolist(), b_start[where].tolist(), b_stop[where].tolist())])[of.ravel()]
                seen.count_documents(doc, group)
                links = np.cumsum((a_stop - a_start) * (b_stop - b_start))
                stop = np.searchsorted(doc, np.arange(len(texts)), side="right")
                n_groups = np.diff(stop, prepend=0)
                n_links = np.diff(np.append(0, links)[stop], prepend=0)
                names = seen.texts
                for d in np.nonzero(n_groups)[0].tolist():
                    members[d] = group[stop[d] - n_groups[d]:stop[d]].astype(np.int32)
                    digests[d] = hashlib.sha256(";".join([names[g] for g in members[d].tolist()]).encode()).hexdigest()
            return rows(key=keys, block=[block] * len(texts), n_a=counts[:, 0], n_b=counts[:, 1], n_groups=n_groups, n_links=n_links, digest=digests, groups=members)

        def close() -> pa.RecordBatch:
            return rows(
                block=[block], pairs=[list(seen.pair_index)], docs=[seen.docs], group_texts=[seen.texts],
                group_stops=[seen.group_stops], group_pairs=[seen.group_pairs], group_weights=[seen.group_weights],
            )

        keys, texts, size, in_block = [], [], 0, 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                keys.append(k)
                texts.append(text)
                size += len(text)
                if size >= rule.batch or len(texts) >= 10_000:
                    yield align(keys, texts)
                    in_block += size
                    keys, texts, size = [], [], 0
                    if in_block >= rule.block or len(seen.pair_index) >= rule.pairs:
                        yield close()
                        seen, block, in_block = Dictionary(), block + 1, 0
        if texts:
            yield align(keys, texts)
        if seen.index:
            yield close()

    return work


#: Group occurrences whose values are gathered at once: a block has millions, and their values take many times their memory.
GATHERED = 1 << 16


def list_sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """For each list of column numbers, the sums of those columns of `values`; lists of any length are gathered in chunks."""
    at = lists.flatten().to_numpy(zero_copy_only=False)
    stops = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    total, before = np.zeros((len(values), len(lists)), np.int64), np.zeros((len(values), 1), np.int64)
    for start in range(0, len(at), GATHERED):
        sums = np.cumsum(values[:, at[start:start + GATHERED]], axis=1) + before
        first, last = np.searchsorted(stops, [start, start + sums.shape[1]], side="right")
        total[:, first:last] = sums[:, stops[first:last] - start - 1]
        before = sums[:, -1:]
    return np.diff(total, axis=1, prepend=0)


@dataclass(frozen=True)
class Alignment:
    """What align_tokens found, as staged tables.

    `documents`: key, block, n_a, n_b, n_groups, n_links, digest, groups (indexes into the block's groups, in text order).
    `blocks`: block, pairs (a << 32 | b), docs (the block's documents holding each), group_texts (`a1,a2|b1`),
    group_stops, group_pairs, group_weights (each group's pairs and its links of that pair).
    `pairs`: pair, a_id, b_id, n_docs (over the whole corpus), best (highest n_docs of its a_id, ties included).
    """

    key: str
    documents: DataFrame
    blocks: DataFrame
    pairs: DataFrame

    def groups(self) -> DataFrame:
        """The groups themselves: key, position (from 0), a_ids, b_ids of every document's groups."""
        ids = lambda part: F.transform(F.split(F.split_part("g", F.lit("|"), F.lit(part)), ","), lambda x: x.cast("int"))
        numbered = self.documents.select(self.key, "block", F.posexplode("groups").alias("position", "at"))
        texts = self.blocks.select("block", F.posexplode("group_texts").alias("at", "g"))
        return numbered.join(texts, ["block", "at"]).select(self.key, "position", ids(1).alias("a_ids"), ids(2).alias("b_ids"))

    def scores(self) -> DataFrame:
        """`documents` with n_best (links whose pair is best for its a_id) and count_sum (n_docs summed over all links)."""
        kind = self.documents.schema[self.key].dataType.simpleString()
        wanted = self.blocks.select("block", F.explode("pairs").alias("pair")).join(self.pairs.select("pair", "n_docs", "best"), "pair").withColumnRenamed("block", "of_block")
        fixed = ["n_a", "n_b", "n_groups", "n_links"]
        found = self.documents.select(F.col(self.key).alias("key"), "block", *fixed, "digest", "groups")
        both = found.unionByName(self.blocks.drop("docs", "group_texts"), allowMissingColumns=True)

        def work(block: pa.Table, counted: pa.Table) -> pa.Table:
            of_group = np.zeros((2, 0), np.int64)
            if counted.num_rows:
                row = block.filter(block.column("pairs").is_valid())
                get = lambda c: row.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                pairs, order = get("pairs"), np.argsort(counted.column("pair").to_numpy())
                at = order[np.searchsorted(counted.column("pair").to_numpy()[order], pairs)]
                n, best = counted.column("n_docs").to_numpy()[at], counted.column("best").to_numpy(zero_copy_only=False)[at].astype(np.int64)
                use, weight, start = get("group_pairs"), get("group_weights"), get("group_stops")[:-1]
                of_group = np.stack([np.add.reduceat(weight * best[use], start), np.add.reduceat(weight * n[use], start)])
            kept = []
            for batch in block.select(["key", *fixed, "digest", "groups", "pairs"]).to_batches():
                docs = batch.filter(pc.is_null(batch.column("pairs")))
                n_best, count_sum = list_sums(of_group, docs.column("groups"))
                kept.append(pa.table([*(docs.column(c) for c in ["key", *fixed]), pa.array(n_best), pa.array(count_sum), docs.column("digest")], ["key", *fixed, "n_best", "count_sum", "digest"]))
            return pa.concat_tables(kept)

        schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string"
        scored = both.groupBy("block").cogroup(wanted.groupBy("of_block")).applyInArrow(work, schema)
        return scored.withColumnRenamed("key", self.key)


def align_tokens(df: DataFrame, key: str, text: str, a_path: str, b_path: str, a_ranks: str | None = None, rule: AlignRule = AlignRule()) -> Alignment:
    """Align two tokenizations of every text: byte offsets where tokens of both end cut them into groups.

    A is a `tokenizers` file with a byte-level vocabulary and reads space + text (`a_ranks`: the same vocabulary for the
    faster `tiktoken`); B is a `sentencepiece` model that adds
    the space itself. Special tokens' strings are ordinary text. A document whose text is null or empty, or whose A or B
    bytes differ from space + text, has no tokens. Every row is a document, repeated rows and null keys too; other
    columns are not read. An id pair is linked in a document if some group holds both ids.

    Spark deals the documents out; a task concatenates a batch's token ends and merges them along merge-path pieces of
    equal work whatever the documents' lengths. Tokens never leave the task: a block of documents leaves its distinct
    groups and pairs with their document counts, summed in Spark by pair. `best` joins with one row per A id, which the
    vocabulary bounds.
    """
    kind = df.schema[key].dataType.simpleString()
    inner, = fresh([key], "key")
    source = df.select(F.col(f"`{key}`").alias(inner), F.col(f"`{text}`").cast("string"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = (f"key {kind}, block long, n_a long, n_b long, n_groups long, n_links long, digest string, groups array<int>, pairs array<long>, docs array<long>, "
              "group_texts array<string>, group_stops array<int>, group_pairs array<int>, group_weights array<long>")
    rows = stage(source.mapInArrow(align_batches(to_arrow_type(df.schema[key].dataType), a_path, b_path, a_ranks, rule), schema))
    documents = rows.where("pairs is null").select(F.col("key").alias(key), "block", "n_a", "n_b", "n_groups", "n_links", "digest", "groups")
    blocks = rows.where("pairs is not null").select("block", "pairs", "docs", "group_texts", "group_stops", "group_pairs", "group_weights")
    each = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n_docs"))
    counted = stage(each.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n_docs"))
    highest = counted.groupBy("a_id").agg(F.max("n_docs").alias("highest"))
    pairs = counted.join(F.broadcast(highest), "a_id").withColumn("best", F.col("n_docs") == F.col("highest")).drop("highest")
    return Alignment(key, documents, blocks, pairs)
