"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from capstrata.llm.common import columns_of, fresh, numbered
from capstrata.llm.wordhash import Texts, mix, repeated, slices
from capstrata.session import stage

#: The statistics, all counts of a whole text.
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks"]
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MARKS = np.isin(np.arange(256), list(b"!?"))
#: Base rules: fewest words, and the largest share of words in repeated three-word windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def count_rules(t: Texts) -> dict[str, np.ndarray]:
    n_words = t.words_per_row()
    first, h = t.windows(3)
    again = repeated(mix(h ^ mix(t.row[first].astype(np.uint64))))
    covered = np.zeros(len(t.starts) + 3, bool)
    for i in range(3):
        covered[first[again] + i] = True
    covered = covered[:len(t.starts)]
    starts, ends, row = t.lines()
    sums = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(t.word_byte, out=sums[1:])
    with_word = sums[ends] > sums[starts]
    starts, ends, row = starts[with_word], ends[with_word], row[with_word]

    _, at = np.unique(mix(t.hash(starts, ends) ^ mix(row.astype(np.uint64))), return_index=True)
    upper = (t.data >= 65) & (t.data <= 90)
    return {
        "n_words": n_words,
        "word_chars": t.per_row(t.word_byte & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_row(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(row, minlength=t.n) - np.bincount(row[at], minlength=t.n),
        "n_repeat_words": np.bincount(t.row[covered], minlength=t.n),
        "n_upper": t.per_row(upper),
        "n_letters": t.per_row(upper | ((t.data >= 97) & (t.data <= 122))),
        "n_marks": t.per_row(MARKS[t.data]),
    }


def rule_statistics(df: DataFrame, text: str) -> DataFrame:
    """All columns of the input plus STATISTICS of the whole text (null: empty); columns of these names are replaced.

    One pass without a shuffle. Words are [^\\x20\\x09-\\x0D]+, lines are cut at line feeds.
    """
    low = [s.lower() for s in STATISTICS]
    kept = df.select(*columns_of(c for c in df.columns if c.lower() not in low))
    plain = numbered(kept)
    names = [*plain.columns, *STATISTICS]
    at = [c.lower() for c in kept.columns].index(text.lower())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(at)):
                part = batch.slice(start, texts.n)
                counts = count_rules(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(counts[s].astype(np.int64)) for s in STATISTICS]], names=names)

    return plain.mapInArrow(count, StructType([*plain.schema.fields, *[StructField(s, LongType()) for s in STATISTICS]])).toDF(*kept.columns, *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of a text, independent of its length; square roots spread out the small rates."""
    s = {k: np.asarray(v, float) for k, v in stats.items()}
    words, letters = np.maximum(1.0, s["n_words"]), np.maximum(1.0, s["n_letters"])
    return np.column_stack([s["word_chars"] / words, np.sqrt(s["n_symbols"] / words), np.sqrt(s["n_marks"] / words), np.sqrt(s["n_upper"] / letters)])


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat arrays: split feature (-1: leaf), split value, left child (the right one follows), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows_per_tree: int

    @staticmethod
    def fit(x: np.ndarray, n_trees: int, rows_per_tree: int, seed: int) -> "IsolationForest":
        rng, trees = np.random.default_rng(seed), []
        size = min(rows_per_tree, len(x))
        limit = math.ceil(math.log2(max(size, 2)))
        for _ in range(n_trees):
            nodes: list[list[float]] = [[-1, 0, 0, 0]]
            todo = [(0, x[rng.choice(len(x), size, replace=False)] if size else x, 0)]
            while todo:
                i, rows, depth = todo.pop()
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                can = np.nonzero(high > low)[0]
                if depth >= limit or len(rows) < 2 or not len(can):
                    nodes[i] = [-1, 0, 0, depth + float(expected_path(len(rows)))]
                    continue
                f = int(rng.choice(can))
                cut = rng.uniform(low[f], high[f])
                nodes[i] = [f, cut, len(nodes), 0]
                todo += [(len(nodes), rows[rows[:, f] < cut], depth + 1), (len(nodes) + 1, rows[rows[:, f] >= cut], depth + 1)]
                nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            a = np.array(nodes, float)
            trees.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3]))
        return IsolationForest(trees, size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score between 0 and 1: 2 to the power of -(mean path length / expected one)."""
        total = np.zeros(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (open_ := np.nonzero(feature[at] >= 0)[0]).size:
                n = at[open_]
                at[open_] = left[n] + (x[open_, feature[n]] >= cut[n])
            total += path[at]
        norm = float(expected_path(self.rows_per_tree)) or 1.0
        return np.exp2(-total / max(1, len(self.trees)) / norm)


@dataclass(frozen=True)
class QualityModel:
    forest: IsolationForest
    threshold: float


#: Scores are counted in this many steps for the calibration.
SCORE_STEPS = 1000


def sample_features(rows: DataFrame, key: str, n: int, seed: int) -> np.ndarray:
    """Features of at most n rows, those of the smallest hash of the key."""
    sample = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), *STATISTICS).limit(n).select(*STATISTICS).toPandas()
    return features({s: sample[s].to_numpy() for s in STATISTICS})


def with_scores(stats: DataFrame, forest: IsolationForest, out: str) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # its size depends on its parameters alone
    names = [c for c in stats.columns if c.lower() != out.lower()]
    plain = numbered(stats.select(*columns_of(names)))
    made = [*plain.columns, "score"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in STATISTICS}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(features(s)))], names=made)

    return plain.mapInArrow(add, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*names, out)


def calibrate(scored: DataFrame, score: str, good: str, false_cost: float) -> float:
    """The score above which rows are rejected: the cut with the largest share of bad rows above it minus
    false_cost times the share of good rows above it. Without bad or good rows nothing is rejected (1.0).

    `good` is true or false; Spark counts both by score step, so SCORE_STEPS rows reach the driver.
    """
    step = F.floor(F.col(score) * SCORE_STEPS).cast("int")
    counts = scored.groupBy(step.alias("step")).agg(F.count_if(F.col(good)).alias("good"), F.count_if(~F.col(good)).alias("bad")).collect()
    good_at, bad_at = np.zeros(SCORE_STEPS + 2), np.zeros(SCORE_STEPS + 2)
    for r in counts:
        good_at[r["step"]], bad_at[r["step"]] = r["good"], r["bad"]
    if not good_at.sum() or not bad_at.sum():
        return 1.0
    above = lambda c: np.concatenate([np.cumsum(c[::-1])[::-1][1:], [0.0]]) / c.sum()
    gain = above(bad_at) - false_cost * above(good_at)
    best = np.nonzero(gain >= gain.max() - 1e-12)[0]
    return float((best[len(best) // 2] + 1) / SCORE_STEPS)  # the middle of equally good cuts


def fit_quality(stats: DataFrame, labels: DataFrame, key: str, quality: str, n_trees: int = 100, rows_per_tree: int = 256, bad_share: float = 0.02, false_cost: float = 4.0, seed: int = 8) -> QualityModel:
    """Fit the forest on labelled rows that pass the base rules and calibrate its threshold on all of those.

    The trees see a bounded sample of labelled rows, n_trees * rows_per_tree at most, of which bad_share are bad
    ones: enough for the splits to reach the values that only bad rows take, few enough for those to stay lonely.
    The calibration covers every labelled row. A key with several labels takes the lowest; null labels count as
    none. Without any good labelled row the trees are fitted on all rows that pass the base rules, and nothing but
    the base rules rejects. stats should be staged.
    """
    label, marked_key = fresh(stats.columns, "label_quality", "label_key")
    marked = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias(marked_key)).agg(F.min(quality).alias(label))
    passing = stats.where(~base_failed())
    labelled = stage(passing.join(marked, F.col(key) == F.col(marked_key)).select(key, *STATISTICS, (F.col(label) > 0).alias(label)))
    size = n_trees * rows_per_tree
    good = sample_features(labelled.where(F.col(label)), key, size - int(size * bad_share), seed)
    bad = sample_features(labelled.where(~F.col(label)), key, max(1, int(len(good) * bad_share / (1 - bad_share))), seed)
    x = np.concatenate([good, bad]) if len(good) else sample_features(passing, key, size, seed)
    forest = IsolationForest.fit(x, n_trees, rows_per_tree, seed)
    score, = fresh([key, label, *STATISTICS], "score")
    return QualityModel(forest, calibrate(with_scores(labelled, forest, score), score, label, false_cost))


def judge(stats: DataFrame, model: QualityModel, score_out: str = "anomaly", failed_out: str = "base_failed", kept_out: str = "kept") -> DataFrame:
    """Add the base rules' result, the anomaly score and the verdict to rows that carry STATISTICS."""
    scored = with_scores(stats, model.forest, score_out)
    return scored.withColumn(failed_out, base_failed()).withColumn(kept_out, ~F.col(failed_out) & (F.col(score_out) <= model.threshold))


def keep_good(docs: DataFrame, text: str, model: QualityModel) -> DataFrame:
    """The documents that pass, in one pass over the texts without a shuffle; columns stay as they were."""
    inner = fresh(STATISTICS, *[f"c{i}" for i in range(len(docs.columns))])  # no column is lost to a statistic of its name
    at = [c.lower() for c in docs.columns].index(text.lower())
    stats = rule_statistics(docs.toDF(*inner), inner[at])
    score, failed, kept = fresh(stats.columns, "anomaly", "base_failed", "kept")
    return judge(stats, model, score, failed, kept).where(F.col(kept)).select(*inner).toDF(*docs.columns)
