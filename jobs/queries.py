"""The jobs as registered queries, with their SQL. Each runs its job twice into one new
folder under ``spark.checkpoint.dir`` and returns what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagelake.functions import lang, text
from passagelake.plans.chunk_sql import chunk_ctes
from passagelake.plans.queries import SPACE, STRIP, q, sql_any, sql_norm, sql_terms, sql_type

from . import chat_digest, refresh_passages
from .common import own_folder


def job1_refresh_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "refresh_passages")
    for _ in range(2):
        refresh_passages.refresh(spark, f"{sf_dir}/documents.parquet", f"{folder}/passages", f"{folder}/checkpoint")
    return refresh_passages.passages(spark, f"{folder}/passages")


def job2_chat_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "chat_digest")
    for _ in range(2):
        chat_digest.write_digest(spark, f"{sf_dir}/conversations.parquet", f"{folder}/digest")
    return chat_digest.read_digest(spark, f"{folder}/digest")


_CUT = refresh_passages.Settings()
JOB1_SQL = f"""WITH {chunk_ctes('SELECT doc_id, text AS whole FROM documents', _CUT.chunk_size, _CUT.chunk_overlap)}
SELECT c.text, '{_CUT.book}' AS book, 'd' || c.doc_id AS chapter, c.doc_id::INT AS chapter_no, 'd' || c.doc_id || ' — {lang.LABEL_PART} ' || pos || '/' || parts AS section, d.source,
  pos::INT AS chunk_index, parts::INT AS chunks_in_chapter, start::INT AS start_index, format('ch{{:02d}}-{{:03d}}', c.doc_id, pos) AS chunk_id, coalesce(nullif(d.lang, ''), 'und') AS lang_key
FROM chunk c JOIN documents d ON d.doc_id = c.doc_id"""

_SAID = chat_digest.Settings()
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(answer, ''), {STRIP}), '(?i)^```(?:text|markdown)?[{SPACE}]*', ''), '[{SPACE}]*```$', ''), '(?i)^(?:{'|'.join(lang.ANSWER_PREFIXES)})[{SPACE}]*:[{SPACE}]*', ''), {STRIP})"
_CITED = f"len(list_filter(list_transform(flatten(list_transform(regexp_extract_all(answer, {q(text.CITATION)}, 1), lambda b: string_split(translate(b, {q(lang.BENGALI_DIGITS)}, '0123456789'), ','))), lambda p: try_cast(trim(p) AS INT)), lambda c: c BETWEEN 1 AND {_SAID.most_passages})) > 0"
JOB2_SQL = f"""
WITH a AS (SELECT conv_id, turn, min(coalesce(text, '')) AS question FROM conversations WHERE role = '{_SAID.asking_role}' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS answer FROM conversations WHERE role = '{_SAID.replying_role}' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
e AS (SELECT conv_id, turn, question, {sql_norm('question')} AS question_key, {_CLEAN} AS answer FROM a LEFT JOIN r USING (conv_id, turn)),
s AS (SELECT *, CASE WHEN answer = '' THEN 'unanswered' WHEN {sql_any(sql_norm('nfc_normalize(answer)'), lang.ABSTENTION)} THEN 'abstained' WHEN {_CITED} THEN 'cited' ELSE 'uncited' END AS state,
  row_number() OVER (PARTITION BY question_key ORDER BY conv_id, turn) AS nth FROM e WHERE question_key <> ''),
g AS (SELECT question_key, count(*) AS asked, count(DISTINCT conv_id) AS conversations, count(*) FILTER (state = 'cited') AS cited, count(*) FILTER (state = 'uncited') AS uncited,
  count(*) FILTER (state = 'abstained') AS abstained, count(*) FILTER (state = 'unanswered') AS unanswered FROM s GROUP BY question_key)
SELECT g.question_key, {sql_type('g.question_key')} AS kind, array_to_string({sql_terms('g.question_key')}, ' ') AS terms, asked::BIGINT AS asked, conversations::BIGINT AS conversations, cited::BIGINT AS cited,
  uncited::BIGINT AS uncited, abstained::BIGINT AS abstained, unanswered::BIGINT AS unanswered, conv_id AS first_conv_id, turn AS first_turn, question, answer,
  CASE WHEN cited > 0 THEN 'cited' WHEN uncited > 0 THEN 'uncited' WHEN abstained > 0 THEN 'abstained' ELSE 'unanswered' END AS outcome
FROM g JOIN s ON s.question_key = g.question_key AND nth = 1"""

QUERIES = {"job1_refresh_passages": job1_refresh_passages, "job2_chat_digest": job2_chat_digest}
SQL = {"job1_refresh_passages": JOB1_SQL, "job2_chat_digest": JOB2_SQL}
