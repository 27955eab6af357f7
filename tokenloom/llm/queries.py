"""The registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import (
    arc_warc,
    chat_windows,
    context_tree,
    decontaminate,
    exact_dedup,
    html_cut,
    jaccard_join,
    mixing,
    parse_language,
    pii_semicrf,
    reversed_search,
    tokenizer_alignment,
    zstd_quality,
)
from tokenloom.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_semicrf.find_personal_data(docs)
    columns = pii_semicrf.digest_columns(F.col("pii"))
    return found.select("doc_id", *[v.alias(k) for k, v in columns.items()])


def op2_parse_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    found = parse_language.predict_language(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    scored = context_tree.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_cut.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = exact_dedup.exact_dedup(docs)
    return tagged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = arc_warc.archive_pages(pages)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = zstd_quality.classify(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return tokenizer_alignment.align_tokens(docs)


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    marked = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat_windows.digest_columns(chat_windows.format_chat(turns.unionByName(marked)))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)
),
hit AS (SELECT doc_id, item_id, i, dw.m AS m FROM dw JOIN bw USING (m, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM k
"""

OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
size AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, size GROUP BY t, nn),
m AS (SELECT doc_id, 100 - 90 + ((90 * len(w) * nn) // ll) AS m FROM d, size WHERE len(w) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

OP13_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
),
r AS (
  SELECT *, row_number() OVER c - 1 AS k, sum(cost) OVER c - cost AS s, first(CASE WHEN role = 'system' THEN cost ELSE 0 END) OVER c AS sys,
         first(role = 'system') OVER c AS has_sys, first(chars) OVER c AS sys_chars
  FROM (
    SELECT *, 4 + len(regexp_extract_all(text, '{chat_windows.TOKEN}')) AS cost,
           26 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) - 2 AS chars
    FROM t
  ) WINDOW c AS (PARTITION BY conv_id ORDER BY turn)
),
h AS (
  SELECT a.conv_id, a.k, max(a.s) - coalesce(min(b.s), max(a.s)) AS back, coalesce(sum(b.chars), 0) AS back_chars
  FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.k < a.k AND b.k >= CAST(a.has_sys AS INT)
       AND a.s - b.s <= least({chat_windows.HISTORY}, greatest({chat_windows.BUDGET} - CASE WHEN a.k > 0 THEN a.sys ELSE 0 END - a.cost, 0))
  GROUP BY a.conv_id, a.k
),
x AS (SELECT r.*, back, back_chars, CASE WHEN k > 0 THEN sys ELSE 0 END AS again FROM r JOIN h USING (conv_id, k)),
w AS (
  SELECT conv_id, k, s + greatest(cost, {chat_windows.BUDGET} - again - back) AS lim, true AS opens FROM x WHERE k = 0
  UNION ALL
  SELECT x.conv_id, x.k,
         CASE WHEN x.k % {chat_windows.SEGMENT} > 0 AND x.s + x.cost <= w.lim THEN w.lim ELSE x.s + greatest(x.cost, {chat_windows.BUDGET} - again - back) END,
         x.k % {chat_windows.SEGMENT} = 0 OR x.s + x.cost > w.lim
  FROM w JOIN x ON x.conv_id = w.conv_id AND x.k = w.k + 1
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN opens THEN back_chars + CASE WHEN k > 0 AND has_sys THEN sys_chars ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM x JOIN w USING (conv_id, k) GROUP BY conv_id
"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_semicrf": op1_pii_semicrf,
        "op2_parse_language": op2_parse_language,
        "op3_context_tree": op3_context_tree,
        "op4_html_cut": op4_html_cut,
        "op5_decontaminate": op5_decontaminate,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_mixing": op8_mixing,
        "op9_arc_warc": op9_arc_warc,
        "op10_zstd_quality": op10_zstd_quality,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_reversed_search": op12_reversed_search,
        "op13_chat_windows": op13_chat_windows,
    }


def all_oracles() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op9_arc_warc": OP9_SQL, "op12_reversed_search": OP12_SQL, "op13_chat_windows": OP13_SQL}
