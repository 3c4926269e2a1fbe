"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm import bpe, chat, decontaminate, exact_dedup, gam, hard_negatives, language, licenses, near_dedup, phrases, sharding, site_tree, token_files
from feedweave.llm.common import read_table

BYTE_BPE = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WORD_BPE = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract_text(read_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    turn = F.col("id").alias("turn")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn, F.element_at(F.array(F.lit("user"), F.lit("assistant")), (turn + 1).cast("int")).alias("role"), said)
    return chat.digests(rows.unionByName(more))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, parts = token_files.write_token_files(read_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)
    return token_files.read_token_files(folder, parts)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = licenses.template_table(spark, licenses.STATEMENTS)
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"), templates)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=16)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_decontamination, op3_exact_dedup, op4_html_extraction, op5_quality, op6_chat_formatting, op7_bpe, op8_token_files,
        op9_licenses, op10_sharding, op11_hard_negatives, op12_collocations, op13_language_id,
    )
}

SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, length(text) + 4 * (length(text) - length(replace(replace(text, '&', ''), '[', '')))
                   + 3 * (length(text) - length(replace(text, '<', '')))
                   + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                     ELSE 20 + length(role) + 4 * (length(role) - length(replace(replace(role, '&', ''), '[', '')))
                          + 3 * (length(role) - length(replace(role, '<', ''))) END AS chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op9_licenses": f"""
        WITH given(template, text) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.STATEMENTS.items())}),
        parts AS (SELECT template, list_filter(regexp_split_to_array(lower(text), '{licenses.SEPARATORS}'), lambda w: w <> '') AS words FROM given),
        wanted AS (
            SELECT template, len(words) AS n, greatest(1, len(words) // 4) AS step,
                   list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) AS shingles
            FROM parts),
        texts AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{licenses.SEPARATORS}') AS words FROM documents),
        places AS (
            SELECT doc_id, template, shingles, unnest(range(0, greatest(len(words) - 4, 0), step)) AS start, n + step AS width, words
            FROM texts, wanted),
        windows AS (SELECT doc_id, template, shingles, start, words[start + 1 : start + width] AS words FROM places),
        shares AS (
            SELECT doc_id, template, start,
                   len(list_intersect(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')), shingles)) / len(shingles) AS share
            FROM windows WHERE len(words) >= 5),
        good AS (SELECT doc_id, template, start, max(share) AS share FROM shares WHERE share >= {licenses.CONTAINMENT} GROUP BY ALL)
        SELECT doc_id, template, max(share) AS containment, min(start) FILTER (WHERE share = best)::BIGINT AS first_word, count(*) AS windows
        FROM (SELECT *, max(share) OVER (PARTITION BY doc_id, template) AS best FROM good) GROUP BY doc_id, template""",
    "op1_near_dedup": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles
            FROM split),
        each AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.other = ways.a)
        SELECT doc_id, len(any_value(shingles)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reached JOIN sets USING (doc_id) GROUP BY doc_id""",
    "op10_sharding": """
        WITH RECURSIVE rows AS (
            SELECT doc_id, coalesce(text, '') AS text, (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key FROM documents),
        jumps(doc_id, n, key, b, j) AS (
            SELECT doc_id, n, key, -1::BIGINT, 0::BIGINT FROM rows, (VALUES (16), (17)) counts(n)
            UNION ALL
            SELECT doc_id, n, next, j, floor((j + 1) * (2147483648.0::DOUBLE / ((next // 8589934592)::DOUBLE + 1)))::BIGINT
            FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < n)),
        placed AS (SELECT doc_id, max(b) FILTER (WHERE n = 16 AND j >= n)::INT AS shard, max(b) FILTER (WHERE n = 17 AND j >= n)::INT AS grown_shard FROM jumps GROUP BY doc_id),
        crc_table AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
        bytes AS (
            SELECT doc_id, strlen(text) + 1 AS size, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(text), 2 * i + 1, 2))::BIGINT) AS b FROM rows),
        sums AS (
            SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT)::BIGINT AS text_crc32
            FROM bytes, crc_table)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY ((key * 2862933555777941757 + 1) % 18446744073709551616) // 1048576 % 4096, doc_id) - 1 AS slot
        FROM rows JOIN placed USING (doc_id) JOIN sums USING (doc_id)""",
    "op11_hard_negatives": """
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM scores JOIN positives USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= 10""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        grams AS (
            SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
            FROM split, (VALUES (1), (2), (3)) sizes(size) WHERE len(w) >= size),
        freq AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE size = 1 GROUP BY lang),
        found AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM freq WHERE size > 1 AND f >= 10),
        ends AS (
            SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k+1:], ' ') AS tail
            FROM found, (VALUES (1), (2)) cuts(k) WHERE k < size),
        scored AS (
            SELECT e.lang, e.phrase, e.size, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM ends e JOIN freq x ON x.lang = e.lang AND x.phrase = e.head JOIN freq y ON y.lang = e.lang AND y.phrase = e.tail
            QUALIFY row_number() OVER (PARTITION BY e.lang, e.phrase ORDER BY score, k) = 1),
        held AS (
            SELECT lang, phrase, max(a) AS held
            FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE size = 3) GROUP BY ALL)
        SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
        FROM scored LEFT JOIN held USING (lang, phrase) JOIN total USING (lang)
        WHERE held IS NULL OR 100 * held < 50 * a
        WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
        QUALIFY row_number() OVER best <= 2000""",
}
