"""One query an operator, with its production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.llm import bpe, chat, gif, langid, quality, repair, trie, urls, warc
from chronocell.llm.minhash import near_duplicates
from chronocell.llm.mixture import mix_sources
from chronocell.llm.tokens import token_counts
from chronocell.llm.winnow import contamination
from chronocell.sources.scratch import Scratch
from chronocell.sources.tables import table

#: The vocabulary of ``op1_token_counts`` and ``op11_bpe_codec``, a file of the tokenizers' package.
VOCABULARY = "byte_bpe_50k.json"


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9)) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, source, source_size, weight, false AS is_full,
         1.5::DOUBLE * sum(source_size) OVER () * weight / sum(weight) OVER () AS target
  FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight, is_full OR target >= 2 * source_size,
         CASE WHEN is_full OR target >= 2 * source_size THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN is_full OR target >= 2 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ())
                   * weight / sum(CASE WHEN is_full OR target >= 2 * source_size THEN 0 ELSE weight END) OVER () END
  FROM fill WHERE step < 64),
t AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM fill WHERE step = 64),
b AS (SELECT source, h, sum(size) AS w FROM d GROUP BY source, h),
r AS (SELECT source, h, w, sum(w) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (
  SELECT r.source, min(h + CASE WHEN (target - rounds * source_size - upto + w) * 2 >= w THEN 1 ELSE 0 END) AS threshold
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
  WHERE target - rounds * source_size > 0 AND upto > target - rounds * source_size
  GROUP BY r.source)
SELECT doc_id, size, source_size, target, (rounds + CASE WHEN h < coalesce(threshold, 0) THEN 1 ELSE 0 END) * size AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], turns.schema)
    messages = chat.turns_as_messages(turns.unionByName(extra), Scratch(spark, "turns"))
    return chat.digests(chat.format_replies(messages))


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM turns),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS said,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(11 + length(regexp_replace(role, '([<\[|\\])', '\1\\', 'g')) - 1 + length(regexp_replace(text, '([<\[|\\])', '\1\\', 'g')))::BIGINT AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.payload_features(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS width, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM win),
grams AS (
  SELECT row_id, width, i, array_to_string(list_slice(w, i, i + width - 1), ' ') AS gram
  FROM (SELECT row_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
hits AS (SELECT row_id, item_id, i, g.width FROM grams g JOIN win USING (width, gram)),
words AS (SELECT row_id, count(DISTINCT k) AS n_hit FROM (SELECT row_id, unnest(range(i, i + width)) AS k FROM hits) GROUP BY row_id),
items AS (
  SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
same AS (SELECT payload, max(page_id) AS last FROM p WHERE octet_length(payload) >= 1000 GROUP BY payload HAVING count(*) > 1)
SELECT page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN same USING (payload)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_reports(repair.damaged(table(spark, sf_dir, "conversations")))


#: CRC-32 of a text of ASCII letters, ``{0}``, in SQL; ``tab`` is the table of its 256 steps.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


OP12_SQL = (
    r"""
WITH RECURSIVE """
    + CRC_TABLE
    + r""",
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """
    + CRC.format("place")
    + r""" % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations), crc_table),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM d),
r AS (
  SELECT *, CASE WHEN seen = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN seen[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM o),
back AS (
  SELECT DISTINCT conv_id, n + 1 AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM r
  UNION ALL
  SELECT conv_id, i, least(b0, 2 + b2, 4 + b3), least(b1, 2 + b2, 4 + b3), least(b2, 2 + b3), least(b3, 2 + b2)
  FROM (
    SELECT r.conv_id, r.i,
           CASE WHEN fault IN ('b', 'd') THEN 3 + c0 ELSE least(3 + c0, 2 + stay + c2, CASE initial WHEN 's' THEN stay + c1 WHEN 'u' THEN stay + c2 END) END AS b0,
           CASE WHEN fault IN ('b', 'd') THEN 3 + c1 ELSE least(3 + c1, 2 + stay + c2, CASE initial WHEN 'u' THEN stay + c2 END) END AS b1,
           CASE WHEN fault IN ('b', 'd') THEN 3 + c2 ELSE least(3 + c2, 2 + stay + c3, CASE initial WHEN 'a' THEN stay + c3 END) END AS b2,
           CASE WHEN fault IN ('b', 'd') THEN 3 + c3 ELSE least(3 + c3, 2 + stay + c2, CASE initial WHEN 'u' THEN stay + c2 END) END AS b3
    FROM back JOIN (SELECT *, CASE fault WHEN 't' THEN 1 ELSE 0 END AS stay FROM r) r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1)),
costs AS (SELECT conv_id, i, [c0, c1, c2, c3] AS c FROM back),
ways AS (
  SELECT costs.conv_id, costs.i, costs.c, nxt.c AS after, r.role, r.text, r.fault, CASE r.fault WHEN 't' THEN 1 ELSE 0 END AS stay,
         CASE r.initial WHEN 's' THEN [1, NULL, NULL, NULL] WHEN 'u' THEN [2, 2, NULL, 2] WHEN 'a' THEN [NULL, NULL, 3, NULL] ELSE [NULL, NULL, NULL, NULL]::INTEGER[] END AS kept
  FROM costs LEFT JOIN costs nxt ON nxt.conv_id IS NOT DISTINCT FROM costs.conv_id AND nxt.i = costs.i + 1
  LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM costs.conv_id AND r.i = costs.i),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, '' AS said, NULL::INTEGER AS _ FROM costs WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept[q + 1] ELSE forced END, audit || letter,
         CASE WHEN letter = 'D' THEN said ELSE said || chr(10) || CASE WHEN letter = 'K' THEN role WHEN forced = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END END, NULL
  FROM (
    SELECT walk.conv_id, walk.i, walk.q, walk.audit, walk.said, ways.kept, ways.role, ways.text, CASE walk.q WHEN 2 THEN 3 ELSE 2 END AS forced,
           CASE WHEN c[q + 1] = 3 + after[q + 1] THEN 'D' WHEN c[q + 1] = 2 + c[CASE walk.q WHEN 2 THEN 3 ELSE 2 END + 1] THEN 'I'
                WHEN fault NOT IN ('b', 'd') AND c[q + 1] = stay + after[kept[q + 1] + 1] THEN 'K' ELSE 'R' END AS letter
    FROM walk JOIN ways ON ways.conv_id IS NOT DISTINCT FROM walk.conv_id AND ways.i = walk.i
    WHERE after IS NOT NULL OR c[q + 1] > 0)),
done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM walk GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(c[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN costs ON costs.conv_id IS NOT DISTINCT FROM a.conv_id AND costs.i = 1
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
"""
)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = (
    r"""
WITH RECURSIVE """
    + CRC_TABLE
    + r""",
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, """
    + CRC.format("conv_id::VARCHAR")
    + r""" % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
t AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS d, octet_length(encode(text)) AS n_bytes,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS said
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
r AS (
  SELECT conv_id, d, n_bytes, sha256(said) AS node, coalesce(lag(sha256(said)) OVER (PARTITION BY conv_id ORDER BY d), 'root') AS above FROM p
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
l AS (SELECT conv_id, max(d) AS n FROM r GROUP BY conv_id),
n AS (SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes FROM r GROUP BY node, d),
kids AS (SELECT above AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above, d),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n_bytes AS saved FROM n LEFT JOIN kids USING (node, d)),
subtree AS (
  SELECT a.node, a.d, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
  FROM v JOIN r a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.node, a.d),
ends AS (SELECT r.node, r.d, sha256(string_agg(r.conv_id::VARCHAR, ',' ORDER BY r.conv_id)) AS ends_sha256 FROM r JOIN l ON l.conv_id = r.conv_id AND l.n = r.d GROUP BY r.node, r.d)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM v JOIN subtree USING (node, d) LEFT JOIN ends USING (node, d) LEFT JOIN n up ON up.node = v.above AND up.d = v.d - 1
"""
)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_source_mix": op3_source_mix,
    "op4_gif_media": op4_gif_media,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_structure_repair": op12_structure_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op2_chat_format": OP2_SQL,
    "op3_source_mix": OP3_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op12_structure_repair": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
