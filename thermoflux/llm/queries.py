"""The op queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoflux.llm import chat_format, conversation_repair, decontaminate, exact_dedup, katz_lm, language_id, lexical_search, line_dedup, mixing, near_dedup, quality, substring_dedup, toxicity
from thermoflux.llm.common import crc_mod, documents


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 0
    model = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Shingles of 3 words, linked from a similarity of 0.85 on.
NEAR = {"shingle": 3, "similarity": 0.85}


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), **NEAR)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, min(root)) AS component_id, least(d.doc_id, min(root)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of the conversations with the same first turn; texts as digests and lengths."""
    pairs = chat_format.pair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = chat_format.format_pairs(pairs)

    def trained(mask: str):
        return F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])

    return out.select(
        "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"),
        *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"),
    )


OP4_SQL = """
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, max(CASE WHEN i = 1 THEN role END) AS r1, max(CASE WHEN i = 1 THEN text END) AS t1, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT conv_id, r1, t1, n, row_number() OVER (PARTITION BY r1, t1 ORDER BY md5('pair-' || conv_id), conv_id) - 1 AS rk FROM c),
p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.n AS na, b.n AS nb
      FROM k a LEFT JOIN k b ON a.r1 = b.r1 AND a.t1 = b.t1 AND b.rk = a.rk + 1 WHERE a.rk % 2 = 0),
f AS (SELECT chosen_id, rejected_id, CASE WHEN rejected_id IS NULL THEN 0 ELSE coalesce(
        (SELECT min(x.i) - 1 FROM t x LEFT JOIN t y ON y.conv_id = p.rejected_id AND y.i = x.i AND y.role = x.role AND y.text = x.text
         WHERE x.conv_id = p.chosen_id AND y.i IS NULL), na) END AS n_common FROM p),
s AS (SELECT chosen_id, 'prompt' AS part, i, role, text FROM f JOIN t ON conv_id = chosen_id AND i <= n_common
      UNION ALL SELECT chosen_id, 'chosen', i, role, text FROM f JOIN t ON conv_id = chosen_id AND i > n_common
      UNION ALL SELECT chosen_id, 'rejected', i, role, text FROM f JOIN t ON conv_id = rejected_id AND i > n_common),
r AS (SELECT chosen_id, part, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS body,
             sum(CASE WHEN role = 'assistant' THEN length(text) + 10 ELSE 0 END)::BIGINT AS trained FROM s GROUP BY 1, 2)
SELECT f.chosen_id, f.rejected_id, n_common::BIGINT AS n_common, sha256(coalesce(a.body, '')) AS prompt_sha256, sha256(coalesce(b.body, '')) AS chosen_sha256,
       CASE WHEN f.rejected_id IS NOT NULL THEN sha256(coalesce(c.body, '')) END AS rejected_sha256, coalesce(b.trained, 0) AS chosen_trained,
       CASE WHEN f.rejected_id IS NOT NULL THEN coalesce(c.trained, 0) END AS rejected_trained
FROM f LEFT JOIN r a ON a.chosen_id = f.chosen_id AND a.part = 'prompt' LEFT JOIN r b ON b.chosen_id = f.chosen_id AND b.part = 'chosen'
LEFT JOIN r c ON c.chosen_id = f.chosen_id AND c.part = 'rejected'
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

def op8_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    docs = documents(spark, sf_dir).select("doc_id", "text", (~held_out).alias("train"))
    return katz_lm.score(docs).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Weights of the sources by code point, repeating, and the share of all words that the mix takes.
MIX = {"weights": [5.0, 2.0, 1.0], "share": 1.5, "max_passes": 2}


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(documents(spark, sf_dir), **MIX)


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY 1),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
fill AS (  -- cut the sources above their cap, share the excess again, until none is above
  SELECT 0 AS k, source, cap, w, false AS full_, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) AS target FROM l
  UNION ALL
  SELECT k + 1, source, cap, w, full_ OR target > cap,
         CASE WHEN full_ OR target > cap THEN cap
              ELSE (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) FILTER (WHERE full_ OR target > cap) OVER (), 0))
                   / (sum(w) FILTER (WHERE NOT (full_ OR target > cap)) OVER ()) * w END
  FROM fill WHERE k < 60),
t AS (SELECT source, source_size, target FROM (SELECT * FROM fill WHERE k = 60) f JOIN s USING (source)
      UNION ALL SELECT NULL, f2.source_size, f1.target FROM (SELECT * FROM fill WHERE k = 60 AND source IS NULL) f1, (SELECT * FROM s WHERE source IS NULL) f2),
o AS (SELECT d.doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - c)) + greatest(0, least(size, round(target)::BIGINT - source_size - c)))::BIGINT AS taken
FROM o
"""

def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.filter(~held_out))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod("doc_id", 4) == 2
    model = quality.fit(docs, labels.filter(~held_out))
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.summary(rows, dropped=F.col("dropped"))


OP11_SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT),
          lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda z: 0::BIGINT), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h FROM raw),
live AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, substr(role, 1, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM live),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN again THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
             count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND p || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM f GROUP BY 1),
-- states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
e(a, b, letters, cost, lines) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 5, ['user:']),
             (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 2, '', 0, []), (2, 3, 'I', 5, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 5, ['user:'])),
g(b, letter, first_, c) AS (VALUES (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
             (0, 'R', '', 2), (1, 'R', '', 2), (2, 'R', '', 3), (3, 'R', '', 2)),
d AS (SELECT conv_id, 0::BIGINT AS i, 0 AS a, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM raw)
      UNION ALL
      SELECT conv_id, i, c, cost, audit, lines FROM (
        SELECT d.conv_id, f.i, g.c, d.cost + e.cost + CASE g.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 3 AND g.letter <> 'D' THEN 5 ELSE 0 END AS cost,
               d.audit || e.letters || g.letter AS audit,
               d.lines || e.lines || CASE g.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE g.c WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END AS lines
        FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN e ON e.a = d.a
        JOIN g ON g.b = e.b AND (g.letter = 'D' OR fault NOT IN (1, 2) AND (g.letter = 'R' OR g.first_ = f.r)))
      QUALIFY row_number() OVER (PARTITION BY conv_id, i, c ORDER BY cost, audit) = 1),
z AS (SELECT d.conv_id, d.cost + e.cost AS cost, d.audit || e.letters AS audit, d.lines || e.lines AS lines
      FROM d JOIN e ON e.a = d.a AND e.b IN (0, 3) LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id WHERE d.i = coalesce(n.size, 0)
      QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.cost + e.cost, d.audit || e.letters) = 1)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       z.cost::BIGINT AS cost, z.audit, sha256(array_to_string(z.lines, chr(10))) AS repaired_sha256
FROM z LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.line_report(docs, line_dedup.build(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM s)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY 1
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(documents(spark, sf_dir))
    found = lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("doc", "doc_id")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, (row_number() OVER o)::INT AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_katz_lm": op8_katz_lm,
    "op9_mix": op9_mix,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op3_near_dedup": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_mix": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
