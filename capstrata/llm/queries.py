"""The registered queries of the training-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm import align, htmltext, jaccard, langid, linededup, mixing, neardup, packing, pii, quality, sharding, spelling, vectorgraph
from capstrata.llm.common import table
from capstrata.session import stage

#: Packing: the given vocabulary, the id that ends a document, and the sequence length.
TOKENIZER, RANKS, END_ID, SEQUENCE_TOKENS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 2, 1024
#: Alignment: the second tokenizer.
OTHER_TOKENIZER = "piece_bpe_32k.model"
#: Similarity join of the contract: four words, 85 percent.
JOIN_RULE = jaccard.JaccardRule(words=4, num=85)
#: Surrogates: the key that a deployment replaces by its own secret.
PII_KEY = "change me"
#: Mixing: target weights of sources; all others weigh 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
MIX_SEED = 20
#: Spelling variants of the contract: five code points, three occurrences, twice as frequent.
SPELLING_RULE = spelling.SpellingRule()
#: Graph search: ten neighbours.
GRAPH_RULE = vectorgraph.GraphRule()
#: Sharding: equal shards.
N_SHARDS = 40


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    parts = packing.tokenize_pieces(docs, "doc_id", "text", P.path(TOKENIZER), SEQUENCE_TOKENS, END_ID, P.path(RANKS), with_ids=False)
    return packing.pack_best_fit(parts, "length", SEQUENCE_TOKENS, ["doc_id", "piece", "ids_crc32"])


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold.alias("fold"))
    model = langid.fit_languages(docs.where("fold <> 2"), "text", "lang")
    rows = docs.select("doc_id", F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, "text", model).select("doc_id", "held_out", "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", JOIN_RULE)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, "text", PII_KEY).select("doc_id", "n_entities", "text")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), "source", ["doc_id"], "text", MIX_WEIGHTS, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "mix_copy", "mix_order")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = htmltext.extract_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", neardup.RangeRule(cosine=0.95))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = stage(quality.rule_statistics(docs.select("doc_id", "text"), "text").drop("text"))
    judged = quality.judge(stats, quality.fit_quality(stats, labels, "doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.versions(table(spark, sf_dir, "documents"), "doc_id", "text")
    dropped = linededup.by_document(linededup.repeated_lines(docs, "id", "text")).withColumnRenamed("id", "d").withColumnRenamed("version", "v")
    n_lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0)
    counted = docs.select(F.col("id").alias("doc_id"), "version", n_lines.alias("n_lines"))
    found = counted.join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("drop_lines"), F.lit(0)).alias("n_dropped"), F.concat_ws(",", F.transform("drop_lines", lambda p: p.cast("string"))).alias("dropped_lines"))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").withColumns({
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
    })
    shards = sharding.assign_shards(sized, ["doc_id"], [1.0] * N_SHARDS, fallback=["text"], grown_by=[1.0])
    narrow = stage(shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard"))
    return sharding.number_slots(narrow, "shard", ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    found = align.align_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", P.path(TOKENIZER), P.path(OTHER_TOKENIZER), P.path(RANKS))
    return found.scores().withColumnRenamed("digest", "groups_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = spelling.with_slips(spelling.runs(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return spelling.group_variants(typed, SPELLING_RULE)


def op13_vector_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    graphs = vectorgraph.build_graphs(vectors, "vec_id", "embedding", GRAPH_RULE)
    return vectorgraph.nearest(graphs, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", GRAPH_RULE)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_ngram_jaccard_join, op4_pii_surrogates, op5_source_mixing, op6_html_extraction, op7_embedding_near_dedup, op8_quality_rules, op9_line_dedup, op10_rendezvous_sharding, op11_token_alignment, op12_spelling_variants, op13_vector_graph_search)
}

#: Twin of the Jaccard join: shingles as text, all pairs that share one, and everything reachable.
_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {JOIN_RULE.words} THEN list_distinct(list_transform(range(1, len(w) - {JOIN_RULE.words - 2}), lambda i: array_to_string(w[i:i + {JOIN_RULE.words - 1}], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {JOIN_RULE.den} * c >= {JOIN_RULE.num} * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT y, root FROM r JOIN both_ways ON doc_id = x)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY ALL) c USING (doc_id)"""

#: Twin of the range join: the cosine of all pairs, and everything reachable.
_NEAR = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT y, root FROM r JOIN k ON vec_id = x),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY ALL)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON vec_id = x"""

#: Word-for-word twin of the line rule: lists instead of hashes, near lines by common deletion variants.
_LINES = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS line FROM raw),
l AS (SELECT {'d': doc_id, 'p': pos} AS place, list_filter(regexp_split_to_array(lower(line), '[ \t\x0B\f\r]+'), lambda w: w <> '') AS words FROM line),
u AS (SELECT words, min(place) AS first FROM l WHERE len(words) >= 3 GROUP BY words),
v AS (SELECT words, first, i, CASE WHEN i = 0 THEN words ELSE list_concat(words[1:i - 1], words[i + 1:]) END AS variant
      FROM (SELECT words, first, unnest(range(0, len(words) + 1)) AS i FROM u WHERE len(words) >= 10)),
near AS (SELECT DISTINCT a.words FROM v a JOIN v b ON a.variant = b.variant AND (a.i = b.i OR a.i = 0 OR b.i = 0) AND b.first < a.first),
dropped AS (SELECT l.place.d AS doc_id, l.place.p AS pos FROM l JOIN u USING (words) LEFT JOIN near ON near.words = l.words WHERE near.words IS NOT NULL OR l.place > u.first),
by_doc AS (SELECT doc_id, count(*)::INT AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS lines FROM dropped GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(lines, '') AS dropped_lines
FROM documents LEFT JOIN by_doc USING (doc_id)"""

#: Twin of the spelling groups: CRC-32 byte by byte, near words by common deletion variants, roots by recursion.
_SPELLING = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
each AS (SELECT d, w, count(*) AS k FROM run GROUP BY ALL),
bytes AS (SELECT w, k, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM each),
hashed AS (SELECT w, k, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) AS h FROM bytes, crc),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= {SPELLING_RULE.min_chars} GROUP BY word HAVING sum(k) >= {SPELLING_RULE.min_count}),
cut AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS variant FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.variant = b.variant AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, {{'n': -n, 'o': other}}) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {SPELLING_RULE.ratio} * n THEN other END AS form, CASE WHEN other_n >= {SPELLING_RULE.ratio} * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
top AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, f.form, top.root, f.n, f.n_near, f.form_n FROM f JOIN top USING (word)"""

_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1.0 END"
LLM_ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": _JACCARD,
    "op7_embedding_near_dedup": _NEAR,
    "op9_line_dedup": _LINES,
    "op12_spelling_variants": _SPELLING,
    "op5_source_mixing": f"""
WITH mass AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS m, {_WEIGHT}::DOUBLE AS w FROM documents GROUP BY source),
rate AS (SELECT source, w / (SELECT sum(w) FROM mass) * (SELECT sum(m) FROM mass) / m AS r FROM mass),
part AS (SELECT source, greatest(1, ceil(r / {mixing.LARGEST_MEAN}))::INT AS parts, r / greatest(1, ceil(r / {mixing.LARGEST_MEAN})) AS mean FROM rate),
point AS (SELECT source, k, CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1)) ELSE (k = 0)::INT END AS p FROM part, range(0, {mixing.LARGEST_COUNT + 1}) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM point),
tables AS (SELECT source, list(below ORDER BY k) AS cdf FROM cdf GROUP BY source),
counted AS (
  SELECT d.doc_id, d.source, coalesce(d.doc_id::VARCHAR, 'null') AS id,
    list_sum(list_transform(range(0, parts), lambda i: len(list_filter(cdf, lambda p: p <= (('0x' || substr(md5('{MIX_SEED}|' || i || '|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / {1 << 52}))))::INT AS n
  FROM documents d JOIN part USING (source) JOIN tables USING (source)),
copies AS (SELECT doc_id, source, id, unnest(range(0, n))::INT AS mix_copy FROM counted WHERE n > 0)
SELECT doc_id, source, mix_copy, ('0x' || substr(md5('{MIX_SEED}|order|' || mix_copy || '|' || id), 1, 15))::BIGINT AS mix_order FROM copies""",
}
