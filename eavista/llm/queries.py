"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eavista.llm import (
    embedding_dedup, exact_dedup, language, minhash_dedup, mixing, packing, prefix_trie, spelling, subword_lattice, suffix_dedup,
    token_files, toxicity, url_filter,
)
from eavista.llm.shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op11_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_lattice.scored(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.thinned_words(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_exact_dedup, op3_embedding_dedup, op4_url_filter, op5_toxicity, op6_language_id, op7_packing, op8_token_files, op9_minhash_dedup,
        op10_mixing, op11_lattice_scores, op12_prefix_trie, op13_spelling_variants,
    )
}

# CRC-32 by its table of 256 entries, as in every text on it; ``{0}`` is a list of byte values.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""
_CRC = "xor(list_reduce([4294967295] || {0}, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295)"

ORACLE = {
    "op13_spelling_variants": rf"""
        WITH RECURSIVE runs AS MATERIALIZED (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS n FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
            ) WHERE length(run) >= 5 GROUP BY ALL
        ),
        -- 256 byte values and their CRC steps; letters beyond ASCII are two bytes of UTF-8
        hashed AS (
            SELECT run, n, {_CRC.format("""flatten(list_transform(string_split(named, ''), lambda x: CASE
                WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))""")} AS h
            FROM runs, {_CRC_TABLE}
        ),
        vocabulary AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
            ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ),
        -- a word and its n patterns with one character open, and its n rests with one left out
        gaps AS MATERIALIZED (
            SELECT word, n, length(word) AS size, i, word[1:i - 1] || word[i + 1:] AS rest
            FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
        ),
        near AS MATERIALIZED (
            SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
            UNION SELECT a.word, v.word, v.n FROM gaps a JOIN vocabulary v ON a.rest = v.word
            UNION SELECT v.word, b.word, b.n FROM gaps b JOIN vocabulary v ON b.rest = v.word
        ),
        ranked AS (
            SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near
            FROM near
        ),
        formed AS MATERIALIZED (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN other END AS form,
                CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
            FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
        ),
        ways AS (
            SELECT word, word AS root, form AS onward FROM formed
            UNION ALL SELECT ways.word, onward, formed.form FROM ways JOIN formed ON formed.word = onward
        )
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word AND w.onward IS NULL
    """,
    "op12_prefix_trie": f"""
        WITH said AS MATERIALIZED (
            SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_sha,
                length(coalesce(text, '')) AS chars,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        ids AS MATERIALIZED (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                {_CRC.format("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM said), {_CRC_TABLE}
        ),
        placed AS (
            SELECT ids.conv_id, 0 AS tail, pos, turn_sha, chars FROM ids JOIN said ON said.conv_id = base AND pos < h
            UNION ALL SELECT ids.conv_id, 1, pos, turn_sha, chars FROM ids JOIN said ON said.conv_id = ids.conv_id AND pos >= h
        ),
        whole AS MATERIALIZED (
            SELECT ids.conv_id, coalesce(list(turn_sha ORDER BY tail, pos) FILTER (turn_sha IS NOT NULL), []) AS shas,
                coalesce(list(chars ORDER BY tail, pos) FILTER (turn_sha IS NOT NULL), []) AS sizes
            FROM ids LEFT JOIN placed ON placed.conv_id = ids.conv_id GROUP BY ids.conv_id
        ),
        begun AS MATERIALIZED (
            SELECT conv_id, len(shas) AS n, d, shas[1:d] AS beginning, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS chars
            FROM (SELECT *, unnest(range(0, len(shas) + 1)) AS d FROM whole)
        ),
        nodes AS MATERIALIZED (
            SELECT d, beginning, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM begun GROUP BY d, beginning
        ),
        children AS MATERIALIZED (SELECT d - 1 AS d, beginning[1:d - 1] AS beginning, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
        valued AS MATERIALIZED (
            SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf
            FROM nodes LEFT JOIN children USING (d, beginning)
        ),
        sums AS (
            SELECT up AS d, beginning[1:up] AS beginning, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM valued) GROUP BY ALL
        )
        SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
            CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM valued v JOIN sums USING (d, beginning) LEFT JOIN nodes p ON p.d = v.d - 1 AND p.beginning = v.beginning[1:v.d - 1]
    """,
    "op3_embedding_dedup": """
        WITH RECURSIVE fit AS MATERIALIZED (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ),
        reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v),
        least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least ON v = vec_id LEFT JOIN counts ON a = vec_id
    """,
    "op9_minhash_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
            FROM words
        ),
        flat AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ),
        links AS MATERIALIZED (
            SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)
        ),
        ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS v, doc_id AS r FROM sets UNION SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.v)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
        FROM sets JOIN reach ON v = doc_id GROUP BY doc_id, s
    """,
    "op2_exact_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        sized AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
        FROM texts JOIN sized USING (text)
    """,
}
