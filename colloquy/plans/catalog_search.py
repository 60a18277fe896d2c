"""Queries over a stored word index, and their SQL. Importing it registers them.

The index of a table is built by the first query that needs it, in the session's shared folder, under a name that
changes with the table's files; later queries read their terms' buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as W
from ..sources.folders import exists, signature, work_folder
from .catalog import _FOLD, ORACLE_SQL, QUERIES
from .standins import cte, frame

#: Table, key and text of what is indexed, and the file under it.
INDEXED = {"documents": ("doc_id", "text", "documents"), "messages": ("id", "content_text", "conversations")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, name) if name == "messages" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_index(spark: SparkSession, sf_dir: str, name: str) -> W.Index:
    """The index of a table, in two segments as if half of its rows had come later."""
    key, text, file = INDEXED[name]
    folder = f"{work_folder(spark)}/word-index-{name}-{signature(spark, f'{sf_dir}/{file}.parquet')}"
    rows = table(spark, sf_dir, name)
    for half in (0, 1):
        if not exists(spark, f"{folder}/figures/segment=s{half}/_SUCCESS"):
            W.add_segment(rows.where(F.pmod(F.hash(key), F.lit(2)) == half), key, text, folder, f"s{half}")
    return W.Index(spark, folder)


def _snippets(name: str, words: str, limit: int):
    key, text, _ = INDEXED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored_index(spark, sf_dir, name).search(words, limit)
        return W.with_snippets(found, table(spark, sf_dir, name), key, text)

    return run


def _sql(name: str, phrases: list[list[str]], limit: int, before: str = "", among: str = "true") -> str:
    """Search and snippet in SQL, over the texts themselves."""
    key, text, _ = INDEXED[name]
    starts = [f"list_filter(range(len(t)), lambda i: {' AND '.join(f't[i + {j + 1}] = {chr(39)}{w}{chr(39)}' for j, w in enumerate(p))})" for p in phrases]
    each = " UNION ALL ".join(f"SELECT key, n, {i} AS phrase, {len(p)} AS size, unnest({s}) AS pos FROM t" for i, (p, s) in enumerate(zip(phrases, starts)))
    return f"""{before}{', ' if before else 'WITH '}t AS (SELECT {key} AS key, regexp_extract_all({_FOLD.format(c=text)}, '[\\p{{L}}\\p{{N}}]+') AS t, len(t) AS n, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*') AS pieces FROM {name}),
h AS ({each}), g AS (SELECT count(*) AS docs, sum(n) AS words FROM t),
f AS (SELECT key, phrase, any_value(n) AS n, count(*) AS times FROM h GROUP BY 1, 2), d AS (SELECT phrase, count(*) AS holders FROM f GROUP BY 1),
r AS (SELECT key, round(sum(greatest(ln((docs - holders + 0.5) / (holders + 0.5)), 1e-6) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * n * docs / words))), 4)::DOUBLE AS score FROM f JOIN d USING (phrase), g GROUP BY 1 HAVING count(*) = {len(phrases)}),
b AS (SELECT * FROM r WHERE {among} ORDER BY score DESC, key LIMIT {limit}),
s AS (SELECT h.key, pos, (SELECT count(DISTINCT x.phrase) FROM h x WHERE x.key = h.key AND x.pos BETWEEN h.pos AND h.pos + 31) AS kinds, (SELECT count(*) FROM h x WHERE x.key = h.key AND x.pos BETWEEN h.pos AND h.pos + 31) AS n, (SELECT max(x.pos + x.size) FROM h x WHERE x.key = h.key AND x.pos BETWEEN h.pos AND h.pos + 31) AS last FROM h JOIN b USING (key)),
c AS (SELECT key, pos AS first, last FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY kinds DESC, n DESC, pos) = 1),
w AS (SELECT key, pieces, len(pieces) AS n, greatest(0, least(first - CAST(floor((32 - (last - first)) / 2.0) AS BIGINT), len(pieces) - 32)) AS a FROM c JOIN t USING (key)),
p AS (SELECT key, n, a, least(a + 32, n) AS e, unnest(range(a, least(a + 32, n))) AS i, pieces FROM w),
m AS (SELECT p.*, regexp_extract(pieces[i + 1], '^[\\p{{L}}\\p{{N}}]+') AS word, substr(pieces[i + 1], length(regexp_extract(pieces[i + 1], '^[\\p{{L}}\\p{{N}}]+')) + 1) AS gap,
  EXISTS (SELECT 1 FROM h WHERE h.key = p.key AND h.pos <= i AND i < h.pos + h.size) AS inside,
  EXISTS (SELECT 1 FROM h WHERE h.key = p.key AND h.pos = i) AND NOT EXISTS (SELECT 1 FROM h WHERE h.key = p.key AND h.pos < i AND i < h.pos + h.size) AS opens,
  EXISTS (SELECT 1 FROM h WHERE h.key = p.key AND h.pos + h.size = i + 1) AND NOT EXISTS (SELECT 1 FROM h WHERE h.key = p.key AND h.pos <= i AND i + 1 < h.pos + h.size) AS closes FROM p)
SELECT key, score, concat(CASE WHEN any_value(a) > 0 THEN '...' ELSE '' END, string_agg(concat(CASE WHEN inside AND opens THEN '<mark>' ELSE '' END, word, CASE WHEN inside AND closes THEN '</mark>' ELSE '' END, CASE WHEN i + 1 < e THEN gap ELSE '' END), '' ORDER BY i), CASE WHEN any_value(e) < any_value(n) THEN '...' ELSE '' END) AS snippet
FROM m JOIN b USING (key) GROUP BY key, score"""


def register(name: str, of: str, words: str, limit: int) -> None:
    QUERIES[name] = _snippets(of, words, limit)
    ORACLE_SQL[name] = _sql(of, W.phrases_of(words), limit, cte(of) if of == "messages" else "")


register("srh_01_snippets", "documents", 'apache ("license)', 20)
register("srh_01_phrases", "documents", "licensed apache-license under", 20)
register("srh_01_common_words", "messages", "the and", 15)


def _lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index lacks what has come since: here, nothing of the first segment's half is newer than its largest key."""
    return stored_index(spark, sf_dir, "documents").lag(table(spark, sf_dir, "documents"), "doc_id")


QUERIES["srh_09_index_lag"] = _lag
ORACLE_SQL["srh_09_index_lag"] = "SELECT max(doc_id) AS newest, max(doc_id) AS indexed, 0::BIGINT AS lag FROM documents"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching messages of one provider's sessions with their title and snippet."""
    messages, sessions = (frame(spark, sf_dir, t) for t in ("messages", "sessions"))
    its = messages.join(sessions.where("provider = 'openai'").select(F.col("id").alias("its_session"), "provider", "title_hint"), F.col("session_id") == F.col("its_session"))
    found = stored_index(spark, sf_dir, "messages").search("the of", 20, its.select(F.col("id").alias("key")))
    shown = W.with_snippets(found, messages, "id", "content_text")
    return shown.join(its.select(F.col("id").alias("key"), "session_id", "provider", "title_hint"), "key")


QUERIES["jon_04_snippets"] = _matched
ORACLE_SQL["jon_04_snippets"] = (
    _sql("messages", [["the"], ["of"]], 20, cte("messages", "sessions"), "key IN (SELECT m.id FROM messages m JOIN sessions s ON m.session_id = s.id WHERE s.provider = 'openai')")
    .replace("SELECT key, score, concat(", "SELECT m.key, score, any_value(session_id) AS session_id, any_value(provider) AS provider, any_value(title_hint) AS title_hint, concat(")
    .replace("FROM m JOIN b USING (key) GROUP BY key, score", "FROM m JOIN b USING (key) JOIN messages x ON x.id = m.key JOIN sessions z ON z.id = x.session_id GROUP BY m.key, score")
)
