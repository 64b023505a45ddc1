"""Line dedup: a deletion-neighbourhood join over words, keeping the earliest of equal or nearly equal lines.

Two lines are near when one word inserted, deleted or replaced turns one into the other. Such lines share a
deletion variant: the line itself or the line without one of its words. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import columns_of, fresh
from capstrata.session import stage, unstage


@dataclass(frozen=True)
class LineRule:
    """Lines of fewer than `min_words` words are left alone; the edit bound of one word holds from `near_words` on."""

    min_words: int = 3
    near_words: int = 10


def words_of(line: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(line), r"[ \t\x0B\f\r]+"), "")


def word_hashes() -> Column:
    """64 bits for each word: parts of a line are many, and hash faster and travel lighter as numbers than as words."""
    return F.transform("words", lambda w: F.xxhash64(w))


def line_rows(docs: DataFrame, rule: LineRule) -> DataFrame:
    """(id, version, text) to one row per line that counts: id, version, pos, words.

    Lines are cut into words before they are exploded: a condition on words made afterwards would be pushed below
    them and cut every line twice. Null texts give one row without words, which does not count.
    """
    lines = F.transform(F.split("text", "\n"), words_of)
    return docs.select("id", "version", F.posexplode_outer(lines).alias("pos", "words")).where(F.size("words") >= rule.min_words)


def place() -> Column:
    """Order of lines: by document (null ids last), then by place in it."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "pos")


def line_hashes() -> list[Column]:
    """128 bits that stand for a line's words."""
    return [F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("second"), F.col("words")).alias("h2")]


def half_keys(rule: LineRule) -> list[Column]:
    """Hashes of which near lines share one: an edit of one word leaves the first or the last half of the words alone.

    Read from the words' hashes in `hashes`. A line of n words is compared with lines of n and of n + 1 words under size n, and of n - 1 words under n - 1.
    """
    n, out = F.size("hashes"), []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        rest = size - half
        for tag, part in (("first", F.slice("hashes", F.lit(1), half)), ("last", F.slice("hashes", n - rest + 1, rest))):
            out.append(F.when(size >= rule.near_words, F.xxhash64(F.lit(tag), size, part)))
    return out


def suspects(unique: DataFrame) -> DataFrame:
    """Lines that share a half with another line; no other line has a near one."""
    keys = unique.select("h1", "h2", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keys.join(shared, "key").select("h1", "h2").distinct()


def variants(lines: DataFrame) -> DataFrame:
    """All lines reached by deleting at most one word, as hashes: (h1, h2, place, variant, at).

    at is the deleted word's number, 0 for the line itself.
    """
    n = F.size("hashes")
    spots = F.sequence(F.lit(0), n)
    left = F.when(F.col("at") == 0, F.xxhash64("hashes")).otherwise(
        F.xxhash64(F.concat(F.slice("hashes", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), F.slice("hashes", F.col("at") + 1, n)))
    )
    return lines.select("h1", "h2", "place", word_hashes().alias("hashes")).select("h1", "h2", "place", "hashes", F.explode(spots).alias("at")).select("h1", "h2", "place", "at", left.alias("variant"))


def within_one_word(a: Column, b: Column) -> Column:
    """Exact check of the bound: the common first and last words cover all but one word of the longer line."""
    short, longest = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(F.slice(x, F.lit(1), short), F.slice(y, F.lit(1), short), lambda p, q: p != q), True)
        return F.when(differs == 0, short).otherwise(differs - 1)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1


def near_earlier(docs: DataFrame, unique: DataFrame) -> DataFrame:
    """(h1, h2, near): the earliest line within one word's edit before each line's own first place.

    Lines that share a variant by deleting the word at the same place, or of which one is the variant, are within
    the bound; so the earliest of each (variant, place) is all that a line has to be compared with, however many
    lines share it. Every line and its candidate are verified once on their words.
    """
    chosen = unique.join(suspects(unique), ["h1", "h2"]).select("h1", "h2", F.col("first").alias("place"))
    of_doc = chosen.groupBy(F.col("place.id").alias("d"), F.col("place.version").alias("v")).agg(F.collect_list(F.struct("place.pos", "h1", "h2", "place")).alias("wanted"))
    found = docs.join(of_doc, F.col("id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")))
    lines = stage(
        found.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
        .select("w.h1", "w.h2", "w.place", words_of(F.element_at("lines", F.col("w.pos") + 1)).alias("words"))
        .dropDuplicates(["h1", "h2"])  # repeated rows of a document give its lines again
    )
    entries = variants(lines)
    first = entries.groupBy("variant", "at").agg(F.min(F.struct("place", "h1", "h2")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = first.groupBy("variant").agg(
        F.sum("n").alias("n"), F.min("first").alias("any"), F.min(F.when(F.col("at") == 0, F.col("first"))).alias("whole"),
        F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("by_place"),  # at most one entry per word of a line
    ).where("n > 1").drop("n")
    met = entries.join(groups, "variant")
    best = F.when(F.col("at") == 0, F.col("any")).otherwise(F.least("whole", F.element_at("by_place", F.col("at"))))
    earlier = met.select("h1", "h2", "place", best.alias("best")).where(F.col("best.place") < F.col("place"))
    pairs = earlier.groupBy("h1", "h2").agg(F.min("best").alias("best"))
    texts = lines.select("h1", "h2", "words")
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("o_words"))
    both = pairs.join(texts, ["h1", "h2"]).join(other, (F.col("best.h1") == F.col("o1")) & (F.col("best.h2") == F.col("o2")))
    near = stage(both.where(within_one_word(F.col("words"), F.col("o_words"))).select("h1", "h2", F.col("best.place").alias("near")))
    unstage(lines)
    return near


def repeated_lines(df: DataFrame, key: str, text: str, rule: LineRule = LineRule()) -> DataFrame:
    """The lines to drop: (id, version, pos, kept): each has an equal line before it, or a near line before its first place.

    Lines are ordered by document id, then by place; a line is compared with all lines before it, dropped ones too.
    version is a hash of the text: rows of one id with different texts are different documents, repeated rows are
    one document. Null texts and blank or shorter lines than the rule's are left alone. Equality and nearness
    disregard case and the amount of white space. Other columns are not read.
    """
    docs = versions(df, key, text).select("id", "version", "text")
    lines = line_rows(docs, rule).withColumn("hashes", word_hashes())
    keys = [k.alias(f"k{i}") for i, k in enumerate(half_keys(rule))]
    hashed = stage(lines.select("id", "version", "pos", *line_hashes(), *keys))  # texts are cut into words once
    unique = stage(
        hashed.withColumn("place", place()).groupBy("h1", "h2")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), *[F.any_value(f"k{i}").alias(f"k{i}") for i in range(4)])
    )
    near = near_earlier(docs, unique)
    doomed = unique.select("h1", "h2", "first", "last").join(near, ["h1", "h2"], "left").where("near is not null or first < last")
    doomed = doomed.select("h1", "h2", "first", F.col("near").isNotNull().alias("all"), F.coalesce("near", "first").alias("kept"))
    at = hashed.select("id", "version", "pos", "h1", "h2", place().alias("place"))
    dropped = stage(at.join(doomed, ["h1", "h2"]).where(F.col("all") | (F.col("place") > F.col("first"))).select("id", "version", "pos", "kept").distinct())
    unstage(hashed, unique, near)
    return dropped


def versions(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.xxhash64(F.lit("text"), F.col(text)).alias("version"), F.col(text).alias("text"))


def by_document(dropped: DataFrame) -> DataFrame:
    """One row per document: the sorted numbers of its dropped lines (from 0). At most a document's lines."""
    return dropped.groupBy("id", "version").agg(F.sort_array(F.collect_list("pos")).alias("drop_lines"))


def drop_repeated(df: DataFrame, key: str, text: str, rule: LineRule = LineRule()) -> DataFrame:
    """The documents without their repeated lines; all columns stay, only the text changes.

    A document of which every line with a word is dropped goes as a whole: it holds nothing of its own. A document
    without such lines (null, empty or blank text) stays as it is.
    """
    of_id, of_version, lines, left = fresh(df.columns, "ld_id", "ld_version", "ld_lines", "ld_kept")
    dropped = by_document(repeated_lines(df, key, text, rule)).select(F.col("id").alias(of_id), F.col("version").alias(of_version), F.col("drop_lines").alias(lines))
    version = F.xxhash64(F.lit("text"), F.col(text))
    joined = df.join(dropped, F.col(key).eqNullSafe(F.col(of_id)) & (version == F.col(of_version)), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(lines, i))
    joined = joined.withColumn(left, F.when(F.col(lines).isNotNull(), F.array_join(kept, "\n")))
    changed = F.coalesce(F.col(left), F.col(text))
    stays = F.col(lines).isNull() | F.col(left).rlike(r"[^ \t\n\x0B\f\r]")
    return joined.where(stays).select(*[changed.alias(c) if c.lower() == text.lower() else q for c, q in zip(df.columns, columns_of(df.columns))])
