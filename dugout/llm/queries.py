"""The queries of this subpackage over the given tables, and their SQL where SQL can ask the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import (
    ann_partitions, conversation_repair, flat_graph, html_text, language_zstd, license_scan, minhash_forest, mixing, packing_binary,
    periodic_runs, quality_qda, secret_scan, warc_index,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_secret_scan")
def op3(spark, sf_dir):
    """Spans of secrets in every text."""
    found = secret_scan.found(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined("base").cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"))


@query("op5_quality_qda")
def op5(spark, sf_dir):
    """A quality score per text; a quarter of the ids is never learned from."""
    own = quality_qda.remainder(F.col("doc_id"), 4)
    scored = quality_qda.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), own != 2)
    return scored.select("doc_id", (own == 2).alias("held_out"), "score", "predicted")


@query("op6_minhash_forest")
def op6(spark, sf_dir):
    """Groups of near-duplicate texts."""
    return minhash_forest.grouped(table(spark, sf_dir, "documents"))


MIX_SQL = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM sized GROUP BY source
), capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM sizes
), ordered AS (
    SELECT *, coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS cap_before,
           sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE) AS w_left,
           1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
    FROM capped
    WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (SELECT *, cap * w_left <= w * (budget - cap_before) AS is_full FROM ordered
), goals AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN cap ELSE w * (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0.0::DOUBLE))
               / (sum(w) OVER () - coalesce(sum(w) FILTER (is_full) OVER (), 0.0::DOUBLE)) END AS target
    FROM filled
), rests AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
           target - whole * source_size AS rest
    FROM goals
), buckets AS (
    SELECT source, hash // 1073741824 AS bucket, sum(size) AS n FROM sized GROUP BY ALL
), running AS (
    SELECT source, bucket, n, sum(n) OVER (PARTITION BY source ORDER BY bucket) AS so_far FROM buckets
), edges AS (
    SELECT r.source, min(bucket) AS edge, arg_min(n, bucket) AS n, arg_min(so_far, bucket) - arg_min(n, bucket) AS before
    FROM running r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source
    WHERE so_far > rest GROUP BY r.source
), cuts AS (
    SELECT t.*, CASE WHEN edge IS NULL THEN 0
                     WHEN n - (rest - before) < rest - before THEN edge + 1 ELSE edge END AS cut
    FROM rests t LEFT JOIN edges e ON t.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((whole + CASE WHEN hash // 1073741824 < cut THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""


@query("op7_source_mixing", MIX_SQL)
def op7(spark, sf_dir):
    """Words each document gives to the mix."""
    mixed = mixing.with_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_binary_packing")
def op10(spark, sf_dir):
    """Pieces of every document and their sequences."""
    import public_tokenizers

    pieces = packing_binary.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("ids")


@query("op1_learned_partitions")
def op1(spark, sf_dir):
    """The five nearest vectors of every fiftieth."""
    return ann_partitions.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op8_capture_index", """
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM rows
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM best""")
def op8(spark, sf_dir):
    """Pages written as WARC, found through the index and read back."""
    return warc_index.archived(table(spark, sf_dir, "pages"))


@query("op9_compression_language")
def op9(spark, sf_dir):
    """The language of every text; a fifth of the ids is never learned from."""
    own = quality_qda.remainder(F.col("doc_id"), 5)
    found = language_zstd.predicted(table(spark, sf_dir, "documents"), own != 0)
    return found.select("doc_id", (own == 0).alias("held_out"), "lang_pred", "score", "accepted")


@query("op2_license_scan")
def op2(spark, sf_dir):
    """License notices in every text."""
    found = license_scan.scanned(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"], m["end"]))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct("matches.template")), ",").alias("licenses"),
                        F.array_join(spans, ",").alias("spans"))


@query("op4_flat_graph")
def op4(spark, sf_dir):
    """Links and components of near-equal vectors."""
    return flat_graph.grouped(table(spark, sf_dir, "embeddings"))


@query("op11_host_suffixes")
def op11(spark, sf_dir):
    """The main text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def repair_sql() -> str:
    """The repair as a recursion over rows: per state the least (cost, audit, lines), compared as structs."""
    def edit(state: str, letter: str, cost: str, line: str = "") -> str:
        grown = f"{state}.lines || chr(10) || {line}" if line else f"{state}.lines"
        return (f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', "
                f"'lines': {grown}}} END")

    insert = lambda state, role: edit(state, "I", "2", f"'{role}:'")
    delete = lambda state: edit(state, "D", "3")
    rerole = lambda state, role: edit(state, "R", "2 + cut", f"'{role}:' || text")
    kept = lambda state, letter: f"CASE WHEN letter = '{letter}' THEN {edit(state, 'K', 'cut', "role || ':' || text")} END"
    free = lambda *options: "CASE WHEN NOT gone THEN least(" + ", ".join(options) + ") END"
    state = "STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR)"
    return f"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps
    FROM range(256) bytes(b)
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                          lambda d: ascii(d)::BIGINT),
                           lambda c, d: xor(c >> 8, steps[(xor(c, d) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
    FROM conversations, crc
), after AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS letter,
           NOT regexp_matches(text, '[^ \\t-\\r]') AS empty
    FROM after
), judged AS (
    SELECT *, NOT empty AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter AS pair
    FROM numbered
), lines AS (
    SELECT *, empty OR again AS gone,
           (NOT empty AND NOT again AND NOT regexp_matches(text, '[.!?][ \\t-\\r]*$'))::INT AS cut
    FROM judged
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (empty) AS blank, count(*) FILTER (again) AS duplicate, sum(cut)::BIGINT AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM lines GROUP BY conv_id
), best AS (
    SELECT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'lines': ''}}::{state} AS s0, NULL::{state} AS ss, NULL::{state} AS su, NULL::{state} AS sa
    FROM counts
    UNION ALL
    SELECT conv_id, i, {delete('s0')}::{state} AS s0, least({delete('ss')}, {free(kept('s0', 's'), 'NULL')})::{state} AS ss,
           least({delete('u2')}, {free(rerole('s0', 'user'), rerole('ss', 'user'), rerole('a2', 'user'), kept('s0', 'u'), kept('ss', 'u'), kept('a2', 'u'))})::{state} AS su,
           least({delete('a2')}, {free(rerole('u2', 'assistant'), kept('u2', 'a'))})::{state} AS sa
    FROM (
        SELECT *, least(u1, {free(insert('a1', 'user'), 'NULL')}) AS u2, least(a1, {free(insert('u1', 'assistant'), 'NULL')}) AS a2
        FROM (
            SELECT best.conv_id, l.i, role, text, letter, gone, cut, s0, ss,
                   least(su, {free(insert('s0', 'user'), insert('ss', 'user'), insert('sa', 'user'))}) AS u1,
                   least(sa, {free(insert('su', 'assistant'), 'NULL')}) AS a1
            FROM best JOIN lines l ON l.conv_id IS NOT DISTINCT FROM best.conv_id AND l.i = best.i + 1
        )
    )
), ended AS (
    SELECT b.conv_id, unnest([least(s0, sa, {edit('su', 'I', '2', repr('assistant:'))},
        CASE WHEN ss IS NOT NULL THEN {{'cost': ss.cost + 4, 'audit': ss.audit || 'II', 'lines': ss.lines || chr(10) || 'user:' || chr(10) || 'assistant:'}} END)]) AS least
    FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(least.cost, 0) AS cost,
       coalesce(least.audit, '') AS audit, sha256(substr(coalesce(least.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op12_audit_repair", repair_sql())
def op12(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    """Periodic runs of words in every text, a tenth of them with a repeated tail."""
    return periodic_runs.analysis(table(spark, sf_dir, "documents"), damage=True)
