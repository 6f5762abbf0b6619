"""Queries ``opN_<name>`` over the whole of their tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(documents(spark, sf_dir))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pfor import token_output

    return token_output(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir)).drop("kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_report

    return chat_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_ids

    return language_ids(documents(spark, sf_dir))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_token_output,
        op3_substring_dedup,
        op4_mix_sources,
        op5_chat_rotation,
        op6_minhash_near_dedup,
        op7_exact_dedup,
        op8_language_id,
        op9_pii_pseudonyms,
        op10_decontaminate,
    )
}

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    return f"""
        SELECT doc_id, n, {kind} AS k, '{name}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}', 0) AS m,
               regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d"""


ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
        a AS ({_matches(1, "assign", _ASSIGN, 2, 12)} UNION ALL {_matches(2, "access", "AKIA[A-Z0-9]+", 0, 18)}
              UNION ALL {_matches(3, "hex", "[0-9a-f]+", 0, 16)}),
        b AS (SELECT n, k, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i FROM a),
        c AS (SELECT n, k, kind, least, length(m) AS size, length(g) AS held,
                     sum(length(p) + length(m)) OVER (PARTITION BY n, k ORDER BY i) AS stop FROM b),
        s AS (SELECT n, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
                     string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, k) AS spans
              FROM c WHERE held >= least GROUP BY n)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN s USING (n)""",
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op5_chat_rotation": """
        WITH l AS (
            SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(nullif(role, ''), 'unknown') AS role,
                   replace(replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') AS text,
                   row_number() OVER (ORDER BY conv_id, turn NULLS FIRST, role, text) AS n
            FROM conversations
        ),
        p AS (SELECT DISTINCT conv_id, lone, role AS perspective FROM l WHERE role <> 'system'),
        r AS (
            SELECT l.conv_id, l.lone, perspective, n, role = perspective AS mine,
                   CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                        ELSE '<|user name=' || replace(replace(role, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') || '|>' END || chr(10) AS head,
                   text || '<|end|>' || chr(10) AS body
            FROM l JOIN p ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.lone IS NOT DISTINCT FROM p.lone
        ),
        o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, lone, perspective ORDER BY n) AS stop FROM r)
        SELECT conv_id, perspective, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
               coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY n) FILTER (mine), '') AS mask
        FROM o GROUP BY conv_id, lone, perspective""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
        k AS (
            SELECT *, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead AS size FROM w
            WINDOW ahead AS (PARTITION BY n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
        ),
        f AS (SELECT s, min(doc_id) AS first FROM k WHERE size = 13 GROUP BY s),
        m AS (SELECT k.n, pos, word, size = 13 AND first < doc_id AS again FROM k LEFT JOIN f ON k.s = f.s AND size = 13),
        c AS (SELECT n, pos, word, coalesce(bool_or(again) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM m),
        g AS (SELECT n, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY n)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (n)""",
    "op6_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, row_number() OVER () AS n,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ),
        w AS (SELECT n, len(ws) AS words, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
        k AS (
            SELECT n, words, pos, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead AS size FROM w
            WINDOW ahead AS (PARTITION BY n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
        ),
        e AS (SELECT DISTINCT n, s FROM k WHERE size = 5 OR words < 5 AND pos = 0),
        z AS (SELECT n, count(*) AS size FROM e GROUP BY n),
        p AS (SELECT a.n AS a, b.n AS b, count(*) AS same FROM e a JOIN e b ON a.s = b.s AND a.n < b.n GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN z x ON x.n = a JOIN z y ON y.n = b WHERE 100 * same >= 85 * (x.size + y.size - same)),
        both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT n AS a, n AS b FROM d UNION SELECT r.a, both_.b FROM r JOIN both_ ON both_.a = r.b),
        c AS (SELECT r.a AS n, min(doc_id) AS component_id FROM r JOIN d ON d.n = r.b GROUP BY r.a)
        SELECT doc_id, coalesce(z.size, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (n) LEFT JOIN z USING (n)""",
}
