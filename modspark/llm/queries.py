"""The registered queries of this subpackage, each next to its check in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_minhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.langid import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _record_sql(html: str) -> str:
    end = "chr(13) || chr(10)"
    return (
        f"'WARC/1.1' || {end} || 'WARC-Type: resource' || {end} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')"
        f" || '>' || {end} || 'WARC-Target-URI: ' || coalesce(url, '') || {end} || 'Content-Type: text/html' || {end} || 'Content-Length: '"
        f" || strlen(coalesce({html}, '')) || {end} || {end} || coalesce({html}, '') || {end} || {end}"
    )


@query(
    "op5_warc_fixity",
    f"""
    WITH p AS (
        SELECT page_id, url, html,
               CASE WHEN page_id % 97 = 5 THEN translate(html, 'e', 'c')
                    WHEN page_id % 101 = 7 THEN substr(html, 1, length(html) // 2) ELSE html END AS copy
        FROM pages
    ), r AS (
        SELECT page_id, url, page_id // 512 AS archive, {_record_sql('html')} AS a, {_record_sql('copy')} AS b FROM p
    ), m AS (
        SELECT page_id, archive, sha256(a) AS digest_a, strlen(a) AS length_a,
               CASE WHEN page_id % 103 <> 9 THEN sha256(b) END AS digest_b,
               CASE WHEN page_id % 103 <> 9 THEN strlen(b) END AS length_b, url FROM r
    ), o AS (
        SELECT *, row_number() OVER w - 1 AS ordinal, CAST(coalesce(sum(length_a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM m WINDOW w AS (PARTITION BY archive ORDER BY page_id, url, digest_a)
    )
    SELECT page_id, archive, CAST(0 AS BIGINT) AS file, ordinal, "offset", length_a, length_b, digest_a, digest_b,
           CASE WHEN digest_b IS NULL THEN 'missing' WHEN length_a <> length_b THEN 'length' ELSE 'bytes' END AS status
    FROM o WHERE digest_b IS DISTINCT FROM digest_a
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.warc import audit_pages

    return audit_pages(table(spark, sf_dir, "pages"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.suffix import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op7_pack_sequences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024, added=True)


@query(
    "op8_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm
        FROM documents
    ), g AS (
        SELECT norm, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM n JOIN g USING (norm)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.lines import repeated_lines

    return repeated_lines(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from modspark.llm.bpe import bpe_roundtrip

    return bpe_roundtrip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query(
    "op13_conversation_repair",
    r"""
    WITH bits AS (
        SELECT list_transform(range(256), lambda n : list_reduce(range(8), lambda x, k : xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), n)) AS step
    ), named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS name
        FROM conversations
    ), crc AS (
        SELECT conv_id, turn, role, text,
               (4294967295 - list_reduce(list_transform(name, lambda c : ascii(c)::BIGINT), lambda x, b : xor(x >> 8, step[(xor(x, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS how
        FROM named, bits
    ), damaged AS (
        SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
               CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM crc
    ), marked AS (
        SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place
        FROM damaged
    ), faults AS (
        SELECT *, left(role, 1) AS initial,
               CASE WHEN bare = '' THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
        FROM marked
    ), shut AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
               list({'i': initial, 'gone': fault IN ('blank', 'duplicate'), 'more': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'role': role, 'text': text} ORDER BY place) AS rows
        FROM faults GROUP BY conv_id
    ), solved AS (
        -- States: nothing yet, after s, after u, after a; of each the least (cost, audit). No row is ever put in.
        SELECT *, list_reduce(rows, lambda b, r : {
            'n': {'c': b.n.c + 2, 'l': b.n.l || 'D'},
            's': least({'c': b.s.c + 2, 'l': b.s.l || 'D'},
                       {'c': CASE WHEN r.gone OR r.i <> 's' THEN 1000000000 ELSE b.n.c + r.more END, 'l': b.n.l || 'K'}),
            'u': least({'c': b.u.c + 2, 'l': b.u.l || 'D'},
                       {'c': CASE WHEN r.gone THEN 1000000000 ELSE least(b.n, b.s, b.a).c + r.more + CASE r.i WHEN 'u' THEN 0 ELSE 1 END END,
                        'l': least(b.n, b.s, b.a).l || CASE r.i WHEN 'u' THEN 'K' ELSE 'R' END}),
            'a': least({'c': b.a.c + 2, 'l': b.a.l || 'D'},
                       {'c': CASE WHEN r.gone THEN 1000000000 ELSE b.u.c + r.more + CASE r.i WHEN 'a' THEN 0 ELSE 1 END END,
                        'l': b.u.l || CASE r.i WHEN 'a' THEN 'K' ELSE 'R' END})
            }, {'n': {'c': 0::BIGINT, 'l': ''}, 's': {'c': 1000000000::BIGINT, 'l': ''}, 'u': {'c': 1000000000::BIGINT, 'l': ''}, 'a': {'c': 1000000000::BIGINT, 'l': ''}}) AS best
        FROM shut
    ), told AS (
        SELECT conv_id, gaps, blank, duplicate, truncated, illegal, least(best.n, best.a).c AS cost, least(best.n, best.a).l AS audit,
               list_reduce(range(len(rows)), lambda b, k : CASE least(best.n, best.a).l[k + 1]
                   WHEN 'K' THEN {'t': b.t || [rows[k + 1].role || ':' || rows[k + 1].text], 'u': left(rows[k + 1].role, 1) = 'u'}
                   WHEN 'R' THEN {'t': b.t || [CASE WHEN b.u THEN 'assistant' ELSE 'user' END || ':' || rows[k + 1].text], 'u': NOT b.u}
                   ELSE b END, {'t': []::VARCHAR[], 'u': false}).t AS lines
        FROM solved
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.dialogue import repaired_after_damage

    return repaired_after_damage(table(spark, sf_dir, "conversations"))


@query(
    "op12_hard_negatives",
    """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 3
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.hardneg import mined

    return mined(table(spark, sf_dir, "embeddings"))


@query("op11_order_minhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modspark.llm.orderhash import with_edited

    return with_edited(table(spark, sf_dir, "documents"))
