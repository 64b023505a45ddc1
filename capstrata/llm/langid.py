"""Language identification: known words by their log frequency, unseen ones by shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from capstrata.llm.common import columns_of, numbered
from capstrata.session import stage

WORD = re.compile(r"[^\W\d_]+")
#: The longest n-grams tried for an unseen word.
LONGEST = 4
UNDETERMINED = "und"
#: Weight of a word or n-gram that a language never showed.
UNSEEN = 0.1
#: Distinct words a task counts before it hands them on, and rows of unseen words it remembers.
HELD = 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its bounds; single characters without them."""
    padded = word if n == 1 else f"_{word}_"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(text, lang) to counts (lang, word, n) over all rows; tasks count ahead of the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def give() -> pd.DataFrame:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD:
                    yield give()
        yield give()

    return texts.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """Counts (lang, size, gram, n) of character n-grams, from the counted words."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        held[lang, size, g] += n
            if len(held) > HELD:
                yield pd.DataFrame([(*k, n) for k, n in held.items()], columns=["lang", "size", "gram", "n"])
                held.clear()
        yield pd.DataFrame([(*k, n) for k, n in held.items()], columns=["lang", "size", "gram", "n"])

    return words.mapInPandas(count, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """tables[0] holds words, tables[n] character n-grams: key to row of log frequencies by language."""

    langs: list[str]
    tables: list[dict[str, int]]
    logs: np.ndarray

    def gram_rows(self, word: str) -> list[int]:
        """Rows of an unseen word's longest known n-grams; none if nothing is known."""
        for n in range(LONGEST, 0, -1):
            rows = [r for g in grams(word, n) if (r := self.tables[n].get(g)) is not None]
            if rows:
                return rows
        return []

    def vector(self, word: str) -> np.ndarray:
        """Log frequencies of a word, or the mean of its longest known n-grams'; zeros if nothing is known."""
        return self.total(Counter([word]), {}).astype(np.float32)

    def total(self, counts: Counter, seen: dict[str, list[int]]) -> np.ndarray:
        """Sum of all words' vectors. Their rows are fetched at once; `seen` keeps the rows of unseen words."""
        rows, starts, weights = [], [], []
        for word, n in counts.items():
            at = self.tables[0].get(word)
            if at is None:
                found = seen.get(word)
                if found is None:
                    found = seen[word] = self.gram_rows(word)
                if not found:
                    continue
            starts.append(len(rows))
            weights.append(n)
            if at is None:
                rows.extend(found)
            else:
                rows.append(at)
        if not rows:
            return np.zeros(len(self.langs))
        sums = np.add.reduceat(self.logs[rows], starts, axis=0)
        return np.array(weights, float) @ (sums / np.diff(starts, append=len(rows)).astype(np.float32)[:, None]).astype(float)

    def predict(self, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
        """(language, posterior probability under equal priors) of each whole text.

        Ties go to the language learned from more words. Texts without a letter, and all texts of a model that learned
        nothing, are undetermined with score 0.
        """
        seen: dict[str, list[int]] = {}
        for text in texts:
            words = words_of(text) if text else []
            if not self.langs or not has_letter(words):
                yield UNDETERMINED, 0.0
                continue
            if len(seen) > HELD // 10:
                seen.clear()
            total = self.total(Counter(words), seen)
            p = np.exp(total - total.max())
            best = int(total.argmax())
            yield self.langs[best], float(p[best] / p.sum())


def fit_languages(df: DataFrame, text: str, lang: str, min_share: float = 2.0 ** -17) -> LanguageModel:
    """Learn from every row with a text and a language.

    Words and n-grams that make up at least min_share of a language's are known. So a language has at most
    1 / min_share known words, and as many n-grams of each length, however large the corpus: that bounds what reaches
    the driver and is broadcast. Everything else is scored by its known, shorter parts.
    """
    texts = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    words = stage(word_counts(texts))
    counted = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").unionByName(gram_counts(words))
    counted = stage(counted)
    totals = stage(counted.groupBy("lang", "size").agg(F.sum("n").alias("total")))  # staged: its size is known, so it is joined without dealing a language to one task
    frequent = counted.join(totals, ["lang", "size"]).where(F.col("n") >= min_share * F.col("total")).select("size", "gram").distinct()
    rows = counted.join(frequent, ["size", "gram"]).join(totals, ["lang", "size"]).select("size", "gram", "lang", "n", "total")
    known = rows.orderBy("size", "gram", "lang").toPandas()
    sums = {(r["lang"], r["size"]): r["total"] for r in totals.collect()}
    langs = sorted({k[0] for k in sums}, key=lambda x: (-sums[x, 0], x))
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    column = {x: i for i, x in enumerate(langs)}
    keys = known[["size", "gram"]].drop_duplicates().reset_index(drop=True)
    logs = np.empty((len(keys), len(langs)), np.float32)
    for size in range(LONGEST + 1):
        at = (keys["size"] == size).to_numpy()
        logs[at] = [[math.log(UNSEEN / (sums.get((x, size), 0) + 1)) for x in langs]] if langs else 0
    for i, (size, gram) in enumerate(keys.itertuples(index=False)):
        tables[size][gram] = i
    at = [tables[s][g] for s, g in zip(known["size"], known["gram"])]
    logs[at, [column[x] for x in known["lang"]]] = np.log((known["n"].to_numpy(float) + UNSEEN) / (known["total"].to_numpy(float) + 1))
    return LanguageModel(langs, tables, logs)


def identify(df: DataFrame, text: str, model: LanguageModel, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns plus the predicted language and its score. Only the text is looked at; replaced columns go."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the model's min_share
    names = [c for c in df.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    at = names.index(text)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(shared.value.predict(t if isinstance(t, str) else None for t in batch.iloc[:, at]))
            yield batch.assign(lang=[f[0] for f in found], score=[f[1] for f in found])

    rows = numbered(df.select(*columns_of(names)))
    return rows.mapInPandas(work, StructType([*rows.schema.fields, StructField("lang", StringType()), StructField("score", DoubleType())])).toDF(*names, lang_out, score_out)
