"""The named queries of this subpackage: (spark, folder of the tables) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (
    decontaminate,
    exact_dedup,
    jaccard,
    language,
    line_dedup,
    lm,
    mixing,
    pii,
    repair,
    secrets,
    shards,
    warc,
    whitening,
)
from marquee.llm.common import shared_folder
from marquee.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op2_line_dedup",
    f"""
    WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
    placed AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM cut),
    keyed AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS k FROM placed),
    often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
    marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_length=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op5_mix",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               md5(concat_ws('/', 'mix', doc_id)) AS h
        FROM documents),
    s AS (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i
          FROM d GROUP BY source),
    fill AS (
        SELECT 0 AS round, i, size, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, false AS capped FROM s
        UNION ALL
        SELECT round + 1, i, size, w,
               capped OR (sum(size) OVER () - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER ()) * w
                         > 3 * size * sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()
        FROM fill WHERE round < 30),
    shares AS (
        SELECT i, capped, 3 * size AS cap,
               ((sum(size) OVER () - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER ()) * w)::BIGINT AS part,
               (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS parts
        FROM fill WHERE round = 30),
    goal AS (
        SELECT s.source, s.size::BIGINT AS source_size,
               CASE WHEN capped THEN cap::DOUBLE ELSE part::DOUBLE / parts::DOUBLE END AS target,
               CASE WHEN capped THEN cap::BIGINT ELSE part // parts END AS words
        FROM shares JOIN s USING (i)),
    laid AS (
        SELECT doc_id, source, size,
               sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size)
            + greatest(0, least(start + size, words % source_size) - start) END)::BIGINT AS taken
    FROM laid JOIN goal ON laid.source IS NOT DISTINCT FROM goal.source
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))[1].drop("text_hash")


@query("op7_shard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(documents(spark, sf_dir), shards=16)


@query(
    "op8_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS h FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(documents(spark, sf_dir))


@query(
    "op4_decontaminate",
    f"""
    WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
                FROM documents),
    bw AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
           FROM benchmark),
    bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
           FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i
                 FROM bw WHERE len(w) > 0)),
    n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
    ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
           FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
                 FROM dw, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)),
    met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY ALL)
    SELECT doc_id, item_id, n_shared, n_item FROM met JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(documents(spark, sf_dir), items).drop("text_hash")


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


@query(
    "op10_jaccard_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
                         FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
              WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(b), w.doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = w.doc_id GROUP BY w.doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(documents(spark, sf_dir)).drop("text_hash")


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    cut AS (SELECT *, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS v FROM p),
    named AS (
        SELECT page_id, octet_length(encode(html)) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest
        FROM cut),
    last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS l FROM named)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = l THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> l THEN l END AS refers_to
    FROM last
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.archive_round_trip(pages, shared_folder(pages, "warc"))


#: The checksum in SQL: a byte at a time through the usual table, itself made of eight halvings per entry.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
    THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t"""
CRC = """xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"""


@query(
    "op11_repair",
    f"""
    WITH RECURSIVE crc AS ({CRC_TABLE}),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    hurt AS (SELECT named.*, {CRC.format("name")} % 20 AS f FROM named, crc),
    kept AS (
        SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM hurt, (SELECT unnest([1, 2]) AS copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
               substr(role, 1, 1) AS c, trim(text, {BLANKS}) AS bare FROM kept),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM placed),
    judged AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup,
                      bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM seen),
    -- the first way in ASCII order of the least cost to each state: 0 start, 1 system, 2 user, 3 assistant
    ways AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM judged
        UNION ALL
        SELECT conv_id, i, q, min(cost) AS cost, arg_min(audit, lpad(cost::VARCHAR, 9, '0') || audit) AS audit FROM (
            SELECT w.conv_id, j.i, e.q, w.cost + e.cost AS cost, w.audit || e.edit AS audit
            FROM (SELECT conv_id, i, q, cost, audit FROM ways
                  UNION ALL SELECT conv_id, i, CASE q WHEN 2 THEN 3 ELSE 2 END, cost + 5, audit || 'I' FROM ways
                  UNION ALL SELECT conv_id, i, CASE q WHEN 2 THEN 2 ELSE 3 END, cost + 10, audit || 'II' FROM ways) w
            JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1,
            LATERAL (
                SELECT w.q AS q, 2 AS cost, 'D' AS edit
                UNION ALL SELECT CASE w.q WHEN 2 THEN 3 ELSE 2 END, 1 + CASE WHEN cut THEN 5 ELSE 0 END, 'R'
                WHERE NOT blank AND NOT dup
                UNION ALL SELECT CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN cut THEN 5 ELSE 0 END, 'K'
                WHERE NOT blank AND NOT dup
                  AND (c = 's' AND w.q = 0 OR c = 'u' AND w.q <> 2 OR c = 'a' AND w.q = 2)) e)
        GROUP BY conv_id, i, q),
    n AS (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id),
    ended AS (
        SELECT ways.conv_id, q, cost + CASE q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
               audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
        FROM ways JOIN n ON n.conv_id IS NOT DISTINCT FROM ways.conv_id AND ways.i = n.n),
    best AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, lpad(cost::VARCHAR, 9, '0') || audit) AS audit
             FROM ended GROUP BY conv_id),
    steps AS (
        SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p
        FROM best WHERE audit <> ''),
    met AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p)::BIGINT AS i FROM steps),
    said AS (
        SELECT met.conv_id, p, edit, role, text, c,
               row_number() OVER (PARTITION BY met.conv_id ORDER BY p) AS r,
               max((edit = 'K' AND c = 's')::INT) OVER (PARTITION BY met.conv_id)::BIGINT AS led
        FROM met LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM met.conv_id AND j.i = met.i AND edit <> 'I'
        WHERE edit <> 'D'),
    told AS (
        SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role || ':' || text
            ELSE CASE (r - led) % 2 WHEN 1 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'I' THEN '' ELSE text END END,
            chr(10) ORDER BY p)) AS sha FROM said GROUP BY conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
               count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
               count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
           coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.repair_conversations(repair.damage(rows), ids=rows)


@query("op12_whiten")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query("op13_lm_score")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), held_out=F.pmod(lm.crc32_of("doc_id"), F.lit(7)) == 2)
