"""One query per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    ans, fm, langid, minhash, mixing, ngram_join, packing, rabitq, recompression, shards, spotsigs, tokens,
    trie, whitening,
)
from leafmill.llm.common import documents
from leafmill.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Expected results as DuckDB SQL, where SQL can express the operator.
ORACLE: dict[str, str] = {}


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE["op4_substring_dedup"] = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
    windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
        FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
    words AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(j)),
    marked AS (SELECT words.doc_id, j, word, max(i) OVER (PARTITION BY words.doc_id ORDER BY j
            ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
        FROM words LEFT JOIN again ON again.doc_id = words.doc_id AND i = j)
    SELECT w.doc_id, count(j) AS n_words, count(gone) AS n_removed,
        sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone IS NULL), '')) AS kept_sha256
    FROM w LEFT JOIN marked ON marked.doc_id = w.doc_id GROUP BY w.doc_id"""
_CLASSES = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram
        FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * c >= {{percent}} * (nx.n + ny.n - c)),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(doc_id, label) AS (SELECT doc_id, doc_id FROM w
        UNION SELECT y, label FROM reached JOIN sides ON x = reached.doc_id WHERE label < y)
    SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(label) AS component_id{{more}}
    FROM w JOIN reached ON reached.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""
ORACLE["op7_ngram_jaccard"] = _CLASSES.format(percent=85, more="")
ORACLE["op11_minhash"] = _CLASSES.format(percent=80, more=", w.doc_id = min(label) AS kept")
ORACLE["op13_prefix_trie"] = f"""
    WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS m,
            turn, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    places AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS place FROM t),
    convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
            flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END),
            4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM t)),
    heads AS (SELECT c.conv_id, place, m, words FROM convs c JOIN places p ON p.conv_id = base AND place <= h),
    rest AS (SELECT p.conv_id, place - h + (SELECT count(*) FROM heads WHERE heads.conv_id = p.conv_id) AS place,
            m, words FROM places p JOIN convs c ON c.conv_id = p.conv_id WHERE place > h),
    turns AS (FROM heads UNION ALL FROM rest),
    paths AS (SELECT conv_id, place AS depth, words,
            string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM turns
        UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words
        FROM paths GROUP BY path, depth),
    children AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    own AS (SELECT nodes.*, coalesce(n, 0) AS n_children,
            CASE WHEN depth > 0 THEN substr(nodes.path, 1, 32 * (depth - 1)) END AS above
        FROM nodes LEFT JOIN children ON children.path = nodes.path),
    subtrees AS (SELECT substr(path, 1, 32 * k) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
            sum((n_convs - 1) * words)::BIGINT AS saved_tokens
        FROM own, unnest(range(0, depth + 1)) AS u(k) GROUP BY 1),
    ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path)
    SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens,
        sha256(coalesce(ids, '')) AS ends_sha256
    FROM own JOIN subtrees ON subtrees.path = own.path LEFT JOIN ends ON ends.path = own.path
        LEFT JOIN nodes up ON up.path = own.above"""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepare(spark), folder)

    QUERIES[build.__name__] = prepared
    return build


@query
def op1_kd_shards(spark, folder):
    placed = shards.kd_shards(documents(spark, folder), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_mix_sources(spark, folder):
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_token_files(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found = ans.round_trip(docs, vocabulary(tokens.VOCABULARY), end_id=0)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_substring_dedup(spark, folder):
    left = recompression.remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return left.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op5_quality(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return fm.quality_scores(documents(spark, folder), labels)


@query
def op6_one_bit_search(spark, folder):
    return rabitq.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), k=20, every=20)


@query
def op7_ngram_jaccard(spark, folder):
    return ngram_join.ngram_components(documents(spark, folder), n=4, percent=85)


@query
def op8_packing(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    packed = packing.pack(docs, vocabulary(tokens.VOCABULARY), capacity=2048, end_id=1)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_spotsigs(spark, folder):
    return spotsigs.with_next(documents(spark, folder))


@query
def op10_language_id(spark, folder):
    found = langid.language_ids(documents(spark, folder), vocabulary(langid.VOCABULARY))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_minhash(spark, folder):
    return minhash.minhash_components(documents(spark, folder), n=4, percent=80)


@query
def op12_whitening(spark, folder):
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"), most=16)


@query
def op13_prefix_trie(spark, folder):
    turns = trie.numbered_turns(spark.read.parquet(f"{folder}/conversations.parquet"))
    return trie.prefix_trie(*trie.with_shared_heads(turns, group=20, longest=3))
