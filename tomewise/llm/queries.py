"""The registered queries of the training-data operators, and SQL where it can express them."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.llm import (
    chat, conv_trie, decontam, filter_audit, jaccard, language_id, lines, lsh_forest, mixing, quality, substrings, token_files, toxicity,
)
from tomewise.llm.common import shared_dir, table
from tomewise.llm.labelled import held_out
from tomewise.llm.sql import AUDIT, CHAT, SAID, TRIE
from tomewise.session import fresh_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Operator 1: weights of the mix, whole numbers; a node without one weighs 1.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIX_SEED, MIX_EPOCHS = 17, 3
# Share of all tokens that the mix takes.
MIX_SHARE = (8, 10)


def domain_of(source: str) -> Column:
    """The domain of a source: the remainder by 4 of the number its name ends with, 0 without one."""
    number = F.coalesce(F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.concat(F.lit("domain"), (number % 4).cast("string"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", domain_of("source").alias("domain"), "lang", "source", mixing.word_tokens("text").alias("n_tokens")
    )
    taken = mixing.select_epochs(
        docs, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, ["doc_id"],
        max_epochs=MIX_EPOCHS, seed=MIX_SEED,
    )
    return taken.select("doc_id", *MIX_LEVELS, "n_tokens", "epoch", "tokens_taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold=(4, 2))
    scored = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), quality.score(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.md5("kept").alias("kept_md5"))


def op3_lines_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for repeated runs of any length, single lines too."""
    docs = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=1)
    return docs.select("doc_id", "n_lines", "n_removed", F.md5("kept").alias("kept_md5"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "tokens")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.read_token_files(manifest, path)


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return lsh_forest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold=(5, 0))
    scored = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), toxicity.score(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(
        [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.written(chat.format_chats(turns, TOKENIZER)), TOKENIZER)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conv_trie.ordered(table(spark, sf_dir, "conversations"))
    return conv_trie.trie(*conv_trie.with_family_heads(turns))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold=(4, 2))
    told = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), language_id.predict(model, "text").alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_quality, op3_lines, op3_lines_any_length, op4_decontam, op5_token_files, op6_lsh_forest,
        op7_toxicity, op8_substrings, op9_chat, op10_jaccard, op11_conversation_trie, op12_language_id, op13_filter_audit,
    )
}

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mix_sql(docs: str, seed: int, epochs: int, share: tuple[int, int]) -> str:
    """SQL of the mix over ``docs (doc_id, domain, lang, source, n_tokens)``: rows (doc_id, domain, lang, source,
    n_tokens, epoch, tokens_taken)."""
    steps = []
    before, parents = "budget0", []
    for level in MIX_LEVELS:
        node = ", ".join([*parents, level])
        within = ", ".join(parents) or "1"
        weight = "".join(f" WHEN {level} = '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items())
        weight = f"CASE{weight} ELSE 1 END" if weight else "1"
        order = f"PARTITION BY {within} ORDER BY able::DOUBLE / w, able, {level}"
        steps.append(f"""
n_{level} AS (SELECT {node}, sum(able)::HUGEINT able, min(b)::HUGEINT b, ({weight})::HUGEINT w FROM {before} GROUP BY {node}),
o_{level} AS (SELECT *, b - coalesce(sum(able) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
    sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among FROM n_{level}),
s_{level} AS (SELECT *, able * among <= spare * w AS short FROM o_{level}),
f_{level} AS (SELECT *, first_value(spare) OVER (PARTITION BY {within} ORDER BY short, able::DOUBLE / w, able, {level}) AS spare0,
    first_value(among) OVER (PARTITION BY {within} ORDER BY short, able::DOUBLE / w, able, {level}) AS among0 FROM s_{level}),
g_{level} AS (SELECT {node}, CASE WHEN short THEN able ELSE least(able, spare0 * w // among0) END AS given FROM f_{level}),
budget_{level} AS (SELECT x.* EXCLUDE (b), g.given AS b FROM {before} x JOIN g_{level} g USING ({node}))""")
        before, parents = f"budget_{level}", [*parents, level]
    keys = ", ".join(MIX_LEVELS)
    return f"""
WITH d AS ({docs}),
totals AS (SELECT {keys}, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY {keys}),
budget0 AS (SELECT *, tokens * {epochs} AS able,
    least((SELECT sum(tokens) FROM totals) * {share[0]} // {share[1]}, (SELECT sum(tokens) FROM totals) * {epochs})::HUGEINT AS b FROM totals),
{",".join(steps)},
leaf AS (SELECT {keys}, (b // greatest(tokens, 1))::INT AS whole, (b % greatest(tokens, 1))::BIGINT AS rest FROM {before}),
k AS (SELECT d.*, whole, rest, ('0x' || substr(md5('{seed}:' || whole || ':' || doc_id), 1, 15))::BIGINT AS key FROM d JOIN leaf USING ({keys})),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM k),
t AS (SELECT *, CASE WHEN ahead < rest THEN least(n_tokens, rest - ahead) END AS part FROM p)
SELECT doc_id, {keys}, n_tokens, e.epoch::INT AS epoch, (CASE WHEN e.epoch < whole THEN n_tokens ELSE part END)::BIGINT AS tokens_taken
FROM t JOIN (SELECT unnest(range({epochs + 1})) AS epoch) e ON e.epoch < whole OR (e.epoch = whole AND part IS NOT NULL)"""


DOMAIN_SQL = (
    "'domain' || coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INT), 0) % 4"
)
DOCS_SQL = f"""SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, 'unknown') AS lang,
    coalesce(source, 'unknown') AS source, ({WORDS_SQL})::BIGINT AS n_tokens FROM documents"""


def lines_sql(min_lines: int) -> str:
    run = " || chr(10) || ".join(f"lead(line, {k}) OVER o" if k else "line" for k in range(min_lines))
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, {run} AS run FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM w WHERE run IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM f, (SELECT unnest(range({min_lines})) AS k) WHERE nth > 1),
d AS (SELECT l.doc_id, count(*) AS n, count(g.i) AS g, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept
    FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n_lines, coalesce(g, 0)::INT AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_mixing": mix_sql(DOCS_SQL, MIX_SEED, MIX_EPOCHS, MIX_SHARE),
    "op3_lines": lines_sql(lines.MIN_LINES),
    "op3_lines_any_length": lines_sql(1),
    "op9_chat": CHAT,
    "op11_conversation_trie": TRIE,
    "op13_filter_audit": AUDIT,
}
