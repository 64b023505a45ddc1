"""Extra columns come back as they were, also under the names of working columns and names with dots."""
import pytest

from capstrata.llm import htmltext, jaccard, langid, linededup, mixing, packing, pii, quality, sharding

WORKING = [
    "a.b", "a`b", "id", "version", "text_", "host_of_page", "v1_of_page", "v2_of_page", "hashes_of_page", "ld_id", "ld_version", "ld_lines", "ld_kept", "kj_id",
    "kj_version", "kj_twice", "kj_version_of_row", "plan_length", "rank_of_length", "runs_of_length", "run", "part", "n_part", "before", "mix_source_key", "mix_count",
    "row", "rid", "c0", "between", "found", "at", "n_words", "n_symbols", "anomaly", "host", "page", "hash", "doc", "component", "n_letters", "shard_",
]
TEXTS = [" ".join(f"w{i}" for i in range(80)), "one two three four five six seven eight nine ten " * 6, "write to ann.lee@mail.com now " * 15, None, "", "one two three four five six seven eight nine ten " * 6]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "x", 5, *[f"{c}-{i}" for c in WORKING]) for i, t in enumerate(TEXTS)]
    names = ["doc_id", "text", "source", "length", *WORKING]
    schema = ", ".join(["doc_id long, text string, source string, length int", *["`" + c.replace("`", "``") + "` string" for c in WORKING]])
    df = spark.createDataFrame(data, schema)
    assert df.columns == names
    return df


MODEL = quality.QualityModel(quality.IsolationForest([], 1), 1.0)
OPERATORS = {
    "mixing": lambda df: mixing.mix_sources(df, "source", ["doc_id"], "text", {"x": 1.0}, seed=1),
    "packing": lambda df: packing.pack_best_fit(df, "length", 16, ["doc_id"]),
    "surrogates": lambda df: pii.replace_entities(df, "text", "key"),
    "line dedup": lambda df: linededup.drop_repeated(df, "doc_id", "text"),
    "near-duplicates": lambda df: jaccard.keep_one(df, "doc_id", "text", jaccard.JaccardRule(words=5, num=80)),
    "languages": lambda df: langid.identify(df, "text", langid.LanguageModel([], [{}] * 5, None)),
    "quality": lambda df: quality.keep_good(df, "text", MODEL),
    "pages": lambda df: htmltext.extract_text(df, "doc_id", "source", "text", out="main"),
    "shards": lambda df: sharding.assign_shards(df, ["doc_id"], [1.0, 1.0]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_stay(rows, name):
    out = OPERATORS[name](rows)
    assert [c for c in out.columns if c in rows.columns] == rows.columns
    got = [r.asDict() for r in out.collect()]
    assert got
    for r in got:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in WORKING)
