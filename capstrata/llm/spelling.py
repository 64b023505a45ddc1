"""Spelling variant grouping: near words by bidirectional FM-index search, forms by counts, roots by pointer jumping."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.session import stage, unstage


@dataclass(frozen=True)
class SpellingRule:
    """Words of at least `min_chars` code points (2 at least) seen `min_count` times; a form is `ratio` times as frequent.

    `shard` bounds the characters of one index; it changes the division of work only.
    """

    min_chars: int = 5
    min_count: int = 3
    ratio: int = 2
    shard: int = 100_000


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of words: A-Z, a-z and U+00C0 to U+00FF.
RUN = "([A-Za-z\\u00C0-\\u00FF]+)"


def runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): one row per maximal run of letters, A-Z lower-cased; null texts have none."""
    low = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    return df.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(1))).alias("word"))


def with_slips(typed: DataFrame, modulus: int = 97) -> DataFrame:
    """Runs with one code point deleted where `modulus` divides the CRC-32 of `<key>:<word>` (null keys: empty)."""
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return typed.withColumn("h", h).select("key", F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("word")).alias("word"))


def count_words(typed: DataFrame, rule: SpellingRule = SpellingRule()) -> DataFrame:
    """(word, n) of the words long and frequent enough; counts cover all rows."""
    counted = typed.where(F.length("word") >= rule.min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= rule.min_count)


class FMIndex:
    """Suffix ranks of the delimited words in both directions, extended by one symbol at a time for many patterns at once.

    The text is `$w1$w2$...$wn$` and an end mark. A pattern is an interval of suffix ranks in the text and one of equal
    length in the reversed text. Rank tables hold, per row, how many earlier symbols of the Burrows-Wheeler transform are
    below each symbol: one row difference gives the interval lengths of all extensions.
    """

    END, DELIMITER, FIRST = 0, 1, 2

    def __init__(self, words: list[str]):
        letters = sorted(set().union(*words)) if words else []
        self.code = {c: i + self.FIRST for i, c in enumerate(letters)}
        self.symbols = self.FIRST + len(letters)
        body = np.fromiter((x for w in words for x in (self.DELIMITER, *map(self.code.__getitem__, w))), np.int64)
        body = np.append(body, self.DELIMITER)
        self.word_at = np.cumsum(body == self.DELIMITER) - 1  # the word behind each delimiter
        self.suffixes = suffix_array(np.append(body, self.END))
        self.left = self._ranks(np.append(body, self.END), self.suffixes)
        flipped = np.append(body[::-1], self.END)
        self.right = self._ranks(flipped, suffix_array(flipped))
        self.below = np.cumsum(np.bincount(body, minlength=self.symbols)) + 1  # suffixes that start with a smaller or equal symbol
        self.below = np.append([0, 1], self.below[1:-1]) if self.symbols > 1 else self.below
        self.size = len(body) + 1

    def _ranks(self, text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        last = text[suffixes - 1]
        table = np.zeros((len(text) + 1, self.symbols + 1), np.int32)
        table[np.arange(1, len(text) + 1), last + 1] = 1
        np.cumsum(table, axis=0, out=table)
        return np.cumsum(table, axis=1, out=table)

    def extend(self, ranks: np.ndarray, main: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """The intervals of the patterns with `symbol` added at the side that `ranks` stands for (unknown symbols: -1)."""
        c = np.maximum(symbol, 0)
        low, low_next = ranks[main, c], ranks[main, c + 1]
        high, high_next = ranks[main + size, c], ranks[main + size, c + 1]
        n = np.where(symbol < 0, 0, (high_next - high) - (low_next - low))
        return self.below[c] + low_next - low, other + high - low, n

    def extend_all(self, ranks: np.ndarray, main: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Interval lengths of the patterns with each symbol added: one row per pattern."""
        return np.diff(ranks[main + size] - ranks[main], axis=1)

    def within_one(self, patterns: list[str], exact: np.ndarray, rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) for all words at exactly one insertion, deletion or replacement behind the first `exact` symbols.

        Rightwards, a pattern is read from its first symbol on, else from its last. The exact part is matched with the
        delimiter before it; then every place allows one error, and the rest must match up to the closing delimiter.
        Pairs may repeat.
        """
        ranks = self.right if rightwards else self.left
        length = np.array([len(p) for p in patterns], np.int64)
        symbols = np.full((len(patterns), int(length.max(initial=0)) + 2), -1, np.int64)
        for i, p in enumerate(patterns):
            symbols[i, :len(p)] = [self.code.get(c, -1) for c in (p if rightwards else reversed(p))]
        symbols[np.arange(len(patterns)), length] = self.DELIMITER
        q = np.arange(len(patterns))
        main, other, size = self.extend(ranks, np.zeros_like(q), np.zeros_like(q), np.full_like(q, self.size), np.full_like(q, self.DELIMITER))
        erred: list[tuple[np.ndarray, ...]] = []  # (pattern, next place, main, other, size)
        for place in range(symbols.shape[1] - 1):
            live = (size > 0) & (length[q] >= place)
            q, main, other, size = q[live], main[live], other[live], size[live]
            open_ = exact[q] <= place
            if open_.any():
                p, m, o, s = q[open_], main[open_], other[open_], size[open_]
                here = symbols[p, place]
                inside = length[p] > place
                skip = inside & (symbols[p, place + 1] != here)  # of equal symbols only the last is left out
                erred.append((p[skip], np.full(skip.sum(), place + 1), m[skip], o[skip], s[skip]))
                n = self.extend_all(ranks, m, s)
                n[:, :self.FIRST] = 0
                known = here >= self.FIRST
                n[np.nonzero(known)[0], here[known]] = 0  # adding an equal symbol is adding it behind
                row, symbol = np.nonzero(n)
                new = self.extend(ranks, m[row], o[row], s[row], symbol)
                erred.append((p[row], np.full(len(row), place), *new))
                swap = inside[row]
                erred.append((p[row][swap], np.full(swap.sum(), place + 1), *[x[swap] for x in new]))
            main, other, size = self.extend(ranks, main, other, size, symbols[q, place])
        if not erred:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, place, main, other, size = (np.concatenate(c) for c in zip(*erred))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(p):
            main, other, size = self.extend(ranks, main, other, size, symbols[p, place])
            done = (size > 0) & (place == length[p])
            found.append((p[done], self.word_at[self.suffixes[(other if rightwards else main)[done]]]))
            live = (size > 0) & ~done
            p, place, main, other, size = p[live], place[live] + 1, main[live], other[live], size[live]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by doubling the compared length; the last symbol is the only smallest."""
    rank, step = text.astype(np.int64), 1
    while True:
        behind = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
        both = rank * (len(text) + int(text.max()) + 2) + behind
        order = np.argsort(both, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.cumsum(np.append(0, np.diff(both[order]) != 0))
        if rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


def half(word: Column) -> Column:
    """Length of a word's first half."""
    return F.floor(F.length(word) / 2).cast("int")


def routed(words: DataFrame, rule: SpellingRule) -> DataFrame:
    """Rows of the shards: (bucket, heavy, part, asks, front, word, n).

    A search that matches a half exactly concerns the words with that half alone. So a word asks in the shard of its first
    half and in that of its second, and is indexed for every half that a word one shorter, equally long or one longer
    could ask for. Halves share shards by hash; a half with more characters than a shard has parts of its own, among
    which its words are dealt out, and which all its searches visit.
    """
    w, n = F.col("word"), F.length("word")
    ends = lambda k, front: F.substring(w, 1, k) if front else F.substring(w, -k if isinstance(k, int) else F.negative(k), k)
    near = F.array(n - 1, n, n + 1)
    keys = lambda front, lengths: F.array_distinct(F.transform(lengths, lambda m: F.struct(F.lit(front).alias("front"), ends((F.floor(m / 2) if front else F.ceil(m / 2)).cast("int"), front).alias("half"))))
    indexed = words.select("word", "n", F.explode(F.concat(keys(True, near), keys(False, near))).alias("k")).select("word", "n", "k.*")
    asking = words.select("word", "n", F.explode(F.concat(keys(True, F.array(n)), keys(False, F.array(n)))).alias("k")).select("word", "n", "k.*")
    weight = F.sum((F.length("word") + 1).cast("long"))
    loads = indexed.groupBy("front", "half").agg(weight.alias("load"))
    heavy = loads.where(F.col("load") > rule.shard).select("front", "half", F.ceil(F.col("load") / rule.shard).cast("int").alias("parts"))
    total = indexed.agg(weight.alias("t")).first()["t"] or 0
    bucket = F.pmod(F.xxhash64("front", "half"), F.lit(-(-total // rule.shard) or 1)).cast("int")
    heavy_name = F.when(F.col("parts").isNotNull(), F.col("half"))
    named = lambda df: df.join(heavy, ["front", "half"], "left").withColumn("bucket", F.when(F.col("parts").isNull(), bucket).otherwise(F.when(F.col("front"), -1).otherwise(-2))).withColumn("heavy", heavy_name)
    mine = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("parts"))).cast("int")
    every = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["bucket", "heavy", "part", "asks", "front", "word", "n"]
    return named(indexed).withColumn("part", mine).withColumn("asks", F.lit(False)).select(*cols).unionByName(
        named(asking).withColumn("part", every).withColumn("asks", F.lit(True)).select(*cols))


def search_shard(t: pa.Table) -> pa.Table:
    """Near words of the words asking in one shard: (word, n_near, best_n, best)."""
    words, counts = t["word"].to_pylist(), t["n"].to_pylist()
    asks, front = t["asks"].to_pylist(), t["front"].to_pylist()
    n_of = {w: n for w, n, a in zip(words, counts, asks) if not a}
    kept = sorted(n_of, key=lambda w: (-n_of[w], w))  # by preference as a form
    index = FMIndex(kept)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for rightwards in (True, False):
        asking = [w for w, a, f in zip(words, asks, front) if a and f == rightwards]
        exact = np.array([len(w) // 2 if rightwards else -(-len(w) // 2) for w in asking], np.int64)
        p, found = index.within_one(asking, exact, rightwards)
        pairs = np.unique(p * len(kept) + found)
        p, found = pairs // max(len(kept), 1), pairs % max(len(kept), 1)
        if not rightwards:  # words with an equal first half belong to the other search
            other = np.array([not kept[f].startswith(asking[i][:len(asking[i]) // 2]) for i, f in zip(p.tolist(), found.tolist())], bool)
            p, found = p[other], found[other]
        asked, first, n = np.unique(p, return_index=True, return_counts=True)
        for i, at, m in zip(asked.tolist(), found[first].tolist(), n.tolist()):
            for c, v in zip(out, (asking[i], m, n_of[kept[at]], kept[at])):
                c.append(v)
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()), "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})


def near_words(words: DataFrame, rule: SpellingRule = SpellingRule()) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) with a near word: exactly one code point inserted, deleted or replaced.

    `words` holds each word once and is read several times: pass a staged table.
    """
    shards = routed(words, rule)
    found = shards.groupBy("bucket", "heavy", "part").applyInArrow(search_shard, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def group_variants(typed: DataFrame, rule: SpellingRule = SpellingRule()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of (..., word) rows that is long and frequent enough.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least `ratio`
    times the word's own, else null; root follows forms to the last. Null words are passed over, repeated rows count as
    often as they occur, other columns are not read, an empty table gives an empty result. Counts grow along forms by
    the ratio, so roots are found in rounds that double the distance followed: some five for counts up to 10^9.
    """
    if rule.ratio < 2 or rule.min_chars < 2:
        raise ValueError("ratio and min_chars are at least 2")
    words = stage(count_words(typed.select("word").where("word is not null"), rule))
    near = words.join(near_words(words, rule), "word", "left")
    has = F.coalesce(F.col("best_n") >= rule.ratio * F.col("n"), F.lit(False))
    near = stage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    hops = stage(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = stage(hops.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        unstage(hops)
        hops = longer
        if not longer.where("moved").take(1):
            break
    return near.join(hops.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
