"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tablelens.llm.chat import digest_conversations, format_conversations
from tablelens.llm.edit_fingerprint import fingerprint_edits
from tablelens.llm.html_text import extract_pages
from tablelens.llm.jaccard_join import ngram_jaccard_join
from tablelens.llm.mixing import mix_sources
from tablelens.llm.packing import pack_documents
from tablelens.llm.phrases import collocations
from tablelens.llm.pitman_yor import score_documents
from tablelens.llm.prefix_forest import nearest_neighbours
from tablelens.llm.quality import fit_quality, grade_documents, grades_of_labels
from tablelens.llm.sentence_pieces import encode_documents
from tablelens.llm.substring_dedup import remove_repeated_spans
from tablelens.llm.turn_repair import damage_conversations, repair_conversations

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


#: Words of each document: runs of bytes other than space and 0x09-0x0D.
_WORDS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = "WITH RECURSIVE " + _WORDS.format(text=_FOLDED) + """,
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2),
         lambda k: array_to_string(ws[k:k + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(doc_id, first) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.first FROM reach r JOIN links l ON l.x = r.doc_id)
SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, CAST(coalesce(max(k.k), 0) AS BIGINT) AS n_links,
       min(first) AS component_id
FROM reach LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM links GROUP BY x) k USING (doc_id)
GROUP BY doc_id"""

DEDUP_SQL = "WITH " + _WORDS.format(text="coalesce(text, '')") + """,
i AS (SELECT doc_id, u.k AS k, u.g AS g FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11),
        lambda k: {'k': k, 'g': array_to_string(ws[k:k + 12], ' ')})) AS u FROM w WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS m FROM i GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 13)) AS p FROM i JOIN f USING (g) WHERE m < doc_id)),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w)
SELECT w.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, CAST(count(gone.p) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN pos ON pos.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p
GROUP BY w.doc_id"""


CHAT_SQL = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, (['user', 'assistant'])[i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
o AS (SELECT *, row_number() OVER w - 1 AS place,
        coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, 4 + len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]')) AS tokens FROM t)
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, before // 512 AS win, 24 + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
        + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) AS size FROM o),
s AS (SELECT conv_id, win, min(place) AS first FROM p GROUP BY ALL),
y AS (SELECT conv_id, min(place) AS system_place FROM p WHERE role = 'system' GROUP BY conv_id),
again AS (SELECT s.conv_id, sum(q.size) AS size FROM s JOIN p q ON q.conv_id = s.conv_id AND q.place < s.first
          LEFT JOIN y ON y.conv_id = s.conv_id WHERE q.place >= s.first - 2 OR q.place = y.system_place GROUP BY s.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(p.size) + coalesce(any_value(again.size), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN again USING (conv_id) GROUP BY conv_id"""


#: Targets by the closed form: sources by size over weight, the first that is not full sets the level.
MIX_SQL = r"""WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''))), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
f AS (SELECT *, CAST(3 * sum(source_size) OVER () AS HUGEINT) - 4 * coalesce(sum(source_size) OVER b, 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS shared
      FROM s WINDOW b AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT rest, shared FROM f WHERE rest * w <= 4 * source_size * shared ORDER BY shared DESC, rest DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lv.rest * w > 4 * source_size * lv.shared THEN CAST(2 * source_size AS DOUBLE)
        ELSE CAST(lv.rest AS DOUBLE) / 2 * w / CAST(lv.shared AS DOUBLE) END AS target FROM s, lv),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d),
e AS (SELECT p.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
        CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - place)) AS BIGINT) AS taken FROM e"""


PHRASES_SQL = r"""WITH pc AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(""" + _FOLDED + r""", '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS len
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, least(len(w), 5) + 1)) AS k FROM pc))),
f AS (SELECT lang, phrase, any_value(len) AS len, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len >= 2 AND f >= 100),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
        FROM (SELECT *, unnest(range(1, len)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f::HUGEINT) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, m, unnest(range(1, len - m + 2)) AS j FROM (SELECT *, unnest(range(2, len)) AS m FROM c)) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""


#: The cheapest scripts turn by turn, by the state of the grammar after it (0: nothing yet, s, u, a):
#: at most two inserts go before a turn, and two may close the conversation.
REPAIR_SQL = r"""WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END) AS c
  FROM conversations),
kind AS (SELECT *, xor(c, 4294967295::BIGINT) % 20 AS k FROM raw),
harm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kind),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM harm),
p AS (SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
moves AS (SELECT * FROM (VALUES ('0', 'K', 's', 's'), ('0', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('a', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'),
        ('0', 'R', '', 'u'), ('s', 'R', '', 'u'), ('a', 'R', '', 'u'), ('u', 'R', '', 'a')) AS v(state, op, x, after)),
ins AS (SELECT * FROM (VALUES ('0', '', '0'), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('0', 'I', 'u'), ('s', 'I', 'u'), ('a', 'I', 'u'), ('u', 'I', 'a'),
        ('0', 'II', 'a'), ('s', 'II', 'a'), ('a', 'II', 'a'), ('u', 'II', 'u')) AS v(state, ops, mid)),
lead AS (SELECT ins.state AS state, ops || m.op AS ops, m.x, m.after, 3 * len(ops) + CASE m.op WHEN 'R' THEN 3 ELSE 0 END AS cost
         FROM ins JOIN moves m ON m.state = ins.mid
         UNION ALL SELECT ins.state, ops || 'D', '', mid, 3 * len(ops) + 4 FROM ins),
walk(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, '0', 0::BIGINT, '', []::VARCHAR[] FROM (SELECT DISTINCT conv_id FROM raw)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT w.conv_id, p.i, l.after AS state, w.cost + l.cost + CASE WHEN p.fault = 't' AND right(l.ops, 1) <> 'D' THEN 3 ELSE 0 END AS cost,
           w.audit || l.ops AS audit,
           list_concat(w.lines, CASE WHEN starts_with(l.ops, 'II') THEN [CASE w.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END, CASE w.state WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
             WHEN starts_with(l.ops, 'I') THEN [CASE w.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END] ELSE [] END,
             CASE right(l.ops, 1) WHEN 'K' THEN [p.role || ':' || p.text] WHEN 'R' THEN [CASE l.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || p.text] ELSE [] END) AS lines
    FROM walk w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1 JOIN lead l ON l.state = w.state
    WHERE (right(l.ops, 1) <> 'K' OR l.x = p.x) AND (p.fault NOT IN ('b', 'd') OR right(l.ops, 1) = 'D')
      AND (right(l.ops, 1) <> 'R' OR p.x <> l.after))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1),
last AS (SELECT conv_id, max(i) AS i FROM walk GROUP BY conv_id),
ended AS (SELECT w.conv_id, cost + CASE state WHEN 'u' THEN 3 WHEN 's' THEN 6 ELSE 0 END AS cost,
          audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit,
          list_concat(lines, CASE state WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END) AS lines
        FROM walk w JOIN last ON last.conv_id IS NOT DISTINCT FROM w.conv_id AND last.i = w.i),
fin AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
j AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM p),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
        count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
        count(*) FILTER (WHERE prev IS NOT NULL AND prev || x NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
SELECT fin.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM fin LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM fin.conv_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, decoded_col="decoded")
    return coded.select("doc_id", F.size("piece_ids").alias("n_pieces"),
                        F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"))


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def op2(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), payload="crc32")


@query("op6_document_fingerprints")
def op6(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op7_chat_formatting", CHAT_SQL)
def op7(spark, sf_dir):
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digest_conversations(format_conversations(rows))


@query("op8_nearest_neighbours")
def op8(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_html_extraction")
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op10_substring_dedup", DEDUP_SQL)
def op10(spark, sf_dir):
    return remove_repeated_spans(table(spark, sf_dir, "documents"), payload="digest")


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, grades_of_labels(table(spark, sf_dir, "labels")), levels=3)
    graded = grade_documents(docs.select("doc_id", "text"), model, select_grade=2)
    return graded.select("doc_id", "score", "expected_grade", "p_select", (F.col("p_select") >= 0.5).alias("selected"))


@query("op11_source_mixing", MIX_SQL)
def op11(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("epochs", "part")


@query("op12_phrase_collocations", PHRASES_SQL)
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair", REPAIR_SQL)
def op13(spark, sf_dir):
    return repair_conversations(damage_conversations(table(spark, sf_dir, "conversations"))).report


@query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
