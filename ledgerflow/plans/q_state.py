"""Registered queries: state tables as batch merges, question log and cache
statistics, conversation helpers, JSON and transcript sinks (M1-M11,
A44-A46, J8, J9, W2, W8, S9, S10)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.operators import state as M
from ledgerflow.operators.state_table import StateTable
from ledgerflow.operators.joins import recent_messages, sessions_with_counts
from ledgerflow.operators.windows import running_hit_count
from ledgerflow.plans.q_kpi import kpi_sql
from ledgerflow.plans.registry import END, START, register
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.sources.io import assemble_transcript, export_transcript, to_json_rows

NOW = S.AS_OF_TS
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
CUT = _dt.datetime(2024, 1, 16)
CUT_SQL = "TIMESTAMP '2024-01-16 00:00:00'"
NL = "chr(10)"

MEMORY_SQL = """
SELECT memory_id, user_name, memory_type, memory_key, memory_val, source, confidence, created_at, updated_at,
       CAST(0 AS BIGINT) AS access_count
FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY updated_at DESC, seq DESC) AS rn,
             MIN(updated_at) OVER (PARTITION BY memory_id) AS created_at FROM v_memory_changes) WHERE rn = 1"""


def _memory(v):
    ch = v.memory_changes
    state = M.memory_state(ch.filter(F.col("updated_at") < F.lit(CUT)))
    return M.memory_state(ch.filter(F.col("updated_at") >= F.lit(CUT)), state)


@register("memory_upsert", "M1", MEMORY_SQL)
def q_memory_upsert(v):
    """M1 memory state from an early batch, then merged with the later batch."""
    return _memory(v)


TOUCHED_SQL = f"""
WITH m AS ({MEMORY_SQL}),
r AS (SELECT memory_id, COUNT(*) AS reads FROM v_memory_changes GROUP BY 1)
SELECT m.memory_id, user_name, memory_type, memory_key, memory_val, source, confidence, created_at, updated_at,
       CAST(access_count + COALESCE(r.reads, 0) AS BIGINT) AS access_count
FROM m LEFT JOIN r ON m.memory_id = r.memory_id"""


def _touched(v):
    reads = v.memory_changes.select("memory_id")          # every event reads its key
    return M.touch_count(_memory(v), reads, "memory_id", "access_count")


@register("memory_upsert_batched", "M1", MEMORY_SQL)
def q_memory_upsert_batched(v):
    """M1 memory state folded from weekly change batches, lineage cut by a
    reliable checkpoint every two batches."""
    ch = v.memory_changes
    cuts = [_dt.datetime(2024, 1, d) for d in (8, 15, 22, 29)]
    bounds = [None] + cuts + [None]
    batches = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("updated_at") >= F.lit(lo))
        if hi is not None:
            cond = cond & (F.col("updated_at") < F.lit(hi))
        batches.append(ch.filter(cond))
    empty = v.spark.createDataFrame([], M.memory_state(ch).schema)
    return M.merge_batches(empty, batches, lambda state, b: M.memory_state(b, state), every=2)


@register("memory_touch", "M4", TOUCHED_SQL)
def q_memory_touch(v):
    """M4 every read adds one to the access count."""
    return _touched(v)


def _state_folder(v, name: str) -> str:
    return f"{ensure_checkpoint_dir(v.spark).rstrip('/')}/state/{name}-{uuid.uuid4().hex}"


@register("memory_state_table", "M1+M4", TOUCHED_SQL)
def q_memory_state_table(v):
    """M1 and M4 on a written state table: an early and a late batch of changes,
    then the reads, each rewriting the buckets it touches. Runs jobs when built."""
    ch = v.memory_changes
    table = StateTable.create(v.spark, _state_folder(v, "memory"), M.memory_state(ch).schema, ["memory_id"], 16)
    late = F.coalesce(F.col("updated_at") >= F.lit(CUT), F.lit(False))
    for i, batch in enumerate((ch.filter(~late), ch.filter(late))):
        table.merge(batch, lambda state, b: M.memory_state(b, state), batch=i)
    table.merge(ch.select("memory_id"), lambda state, r: M.touch_count(state, r, "memory_id", "access_count"), batch=2)
    return table.read()


@register("memory_by_user", "M6", f"""
SELECT memory_key, memory_val, memory_type, source, confidence, updated_at, access_count
FROM ({TOUCHED_SQL}) WHERE user_name = '1'""")
def q_memory_by_user(v):
    """M6 one user's memories ordered by type then access count."""
    return M.memory_by_user(_touched(v), "1")


@register("memory_by_user_type", "M6", f"""
SELECT memory_key, memory_val, memory_type, source, confidence, updated_at, access_count
FROM ({TOUCHED_SQL}) WHERE user_name = '1' AND memory_type = 'preference'""")
def q_memory_by_user_type(v):
    """M6 with a memory type."""
    return M.memory_by_user(_touched(v), "1", "preference")


@register("memory_delete", "M5", f"""
SELECT * FROM ({MEMORY_SQL}) WHERE memory_id NOT IN (
  SELECT md5(user_name || ':' || memory_key) FROM v_memory_changes WHERE memory_key = 'error' AND user_name = '2')""")
def q_memory_delete(v):
    """M5 delete listed keys."""
    keys = (v.memory_changes.filter((F.col("memory_key") == "error") & (F.col("user_name") == "2"))
            .select(F.md5(F.concat_ws(":", "user_name", "memory_key")).alias("memory_id")))
    return M.delete_keys(_memory(v), keys, ["memory_id"])


@register("session_upsert", "M1", "SELECT * FROM v_chat_sessions")
def q_session_upsert(v):
    """M1 sessions: created_at kept, last_updated follows the newest activity."""
    ev = v.chat_events.select("session_id", "user_name", F.col("ts").alias("created_at"),
                              F.col("ts").alias("last_updated"), "turn_index")
    order = ["last_updated", "turn_index"]
    empty = v.spark.createDataFrame([], ev.drop("turn_index").schema)
    state = M.upsert_latest(empty, ev.filter(F.col("last_updated") < F.lit(CUT)), ["session_id"],
                            order, keep=("created_at",), first=("created_at",))
    return M.upsert_latest(state, ev.filter(F.col("last_updated") >= F.lit(CUT)), ["session_id"],
                           order, keep=("created_at",), first=("created_at",))


CACHE_SQL = """
SELECT query_hash, question, created_at, event_id, ttl_seconds, cache_type,
       CAST(n - 1 AS BIGINT) AS hit_count
FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY created_at DESC, event_id DESC) AS rn,
             COUNT(*) OVER (PARTITION BY query_hash) AS n FROM v_cache_writes) WHERE rn = 1"""


@register("cache_from_writes", "M3", CACHE_SQL)
def q_cache_from_writes(v):
    """M3 the cache after every write (first write 0 hits, +1 per re-write)."""
    return M.upsert_count(None, v.cache_writes, ["query_hash"], ["created_at", "event_id"], initial=0)


@register("cache_rewrite", "M3", CACHE_SQL.replace("CAST(n - 1 AS BIGINT)", "CAST(n AS BIGINT)"))
def q_cache_rewrite(v):
    """M3 early writes then re-writes merged into the state (initial count 1)."""
    w = v.cache_writes
    state = M.upsert_count(None, w.filter(F.col("created_at") < F.lit(CUT)), ["query_hash"],
                           ["created_at", "event_id"], initial=1)
    return M.upsert_count(state, w.filter(F.col("created_at") >= F.lit(CUT)), ["query_hash"],
                          ["created_at", "event_id"], initial=1)


@register("cache_state_table", "M3+M5", f"""
SELECT * FROM ({CACHE_SQL.replace("CAST(n - 1 AS BIGINT)", "CAST(n AS BIGINT)")})
WHERE query_hash NOT IN (SELECT query_hash FROM v_cache_writes WHERE cache_type = 'error' AND ttl_seconds > 36000)""")
def q_cache_state_table(v):
    """M3 and M5 on a written state table: early writes, re-writes, then listed
    keys deleted, each in the buckets touched. Runs jobs when built."""
    w = v.cache_writes
    keys, order = ["query_hash"], ["created_at", "event_id"]
    table = StateTable.create(v.spark, _state_folder(v, "cache"), M.upsert_count(None, w, keys, order).schema, keys, 16)
    late = F.coalesce(F.col("created_at") >= F.lit(CUT), F.lit(False))
    for batch in (w.filter(~late), w.filter(late)):
        table.merge(batch, lambda state, b: M.upsert_count(state, b, keys, order, initial=1))
    listed = w.filter((F.col("cache_type") == "error") & (F.col("ttl_seconds") > 36000)).select("query_hash")
    table.merge(listed, lambda state, k: M.delete_keys(state, k, keys))
    return table.read()


@register("cache_live", "M2", f"""
SELECT * FROM v_query_cache
WHERE epoch_us({NOW_SQL}) - epoch_us(created_at) <= COALESCE(ttl_seconds, 3600) * 1000000""")
def q_cache_live(v):
    """M2 entries still within their time to live."""
    return M.ttl_live(v.query_cache, NOW)


@register("cache_lookup", "M2+C19", f"""
WITH q AS (SELECT '  ' || upper(question) || ' ' AS asked, cache_type FROM v_cache_writes)
SELECT c.*, q.asked FROM v_query_cache c JOIN q
  ON c.query_hash = md5(lower(trim(q.asked, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))) AND c.cache_type = q.cache_type
WHERE epoch_us({NOW_SQL}) - epoch_us(c.created_at) <= COALESCE(c.ttl_seconds, 3600) * 1000000""")
def q_cache_lookup(v):
    """M2 live hits for every logged question re-asked with stray case/spaces."""
    qs = v.cache_writes.select(F.concat(F.lit("  "), F.upper("question"), F.lit(" ")).alias("question"),
                               "cache_type")
    return M.cache_lookup(v.query_cache, qs, NOW)


@register("cache_touch", "M4+M2", f"""
WITH q AS (SELECT '  ' || upper(question) || ' ' AS asked, cache_type FROM v_cache_writes),
hits AS (SELECT c.query_hash FROM v_query_cache c JOIN q
           ON c.query_hash = md5(lower(trim(q.asked, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))) AND c.cache_type = q.cache_type
         WHERE epoch_us({NOW_SQL}) - epoch_us(c.created_at) <= COALESCE(c.ttl_seconds, 3600) * 1000000),
n AS (SELECT query_hash, COUNT(*) AS reads FROM hits GROUP BY 1)
SELECT c.query_hash, c.question, c.created_at, CAST(c.hit_count + COALESCE(n.reads, 0) AS BIGINT) AS hit_count,
       c.ttl_seconds, c.cache_type
FROM v_query_cache c LEFT JOIN n ON c.query_hash = n.query_hash""")
def q_cache_touch(v):
    """M4 each live cache lookup adds one hit (expired entries are not hit)."""
    qs = v.cache_writes.select(F.concat(F.lit("  "), F.upper("question"), F.lit(" ")).alias("question"),
                               "cache_type")
    hits = M.cache_lookup(v.query_cache, qs, NOW).select("query_hash")
    return M.touch_count(v.query_cache, hits, "query_hash", "hit_count")


@register("cache_delete_type", "M5", """
SELECT query_hash, question, created_at, hit_count, ttl_seconds,
       CASE WHEN cache_type <> 'click' THEN cache_type END AS cache_type
FROM v_query_cache WHERE cache_type IS DISTINCT FROM 'error'""")
def q_cache_delete_type(v):
    """M5 remove one cache type; entries without a type (here: the clicks') stay."""
    cache = v.query_cache.withColumn("cache_type", F.when(F.col("cache_type") != "click", F.col("cache_type")))
    return M.delete_type(cache, "error")


@register("cache_stats", "A44", f"""
SELECT cache_type AS type, COUNT(*) AS entries, CAST(COALESCE(SUM(hit_count), 0) AS BIGINT) AS total_hits,
       COALESCE(CAST(printf('%.1f', CAST(SUM(hit_count) AS DOUBLE) / COUNT(hit_count)) AS DOUBLE), 0.0) AS avg_hits,
       CAST(SUM(CASE WHEN epoch_us({NOW_SQL}) - epoch_us(created_at) > ttl_seconds * 1000000 THEN 1 ELSE 0 END)
            AS BIGINT) AS expired
FROM v_query_cache GROUP BY cache_type""")
def q_cache_stats(v):
    """A44 cache statistics per type."""
    return M.cache_stats(v.query_cache, NOW)


@register("running_hit_count", "W8", """
SELECT query_hash, event_id, row_number() OVER (PARTITION BY query_hash ORDER BY created_at, event_id) - 1
         AS hit_count
FROM v_cache_writes""")
def q_running_hit_count(v):
    """W8 hits accumulated over re-writes of each key."""
    return running_hit_count(v.cache_writes, "query_hash", "created_at", "event_id") \
        .select("query_hash", "event_id", "hit_count")


@register("running_hit_count_rows", "W8", """
SELECT query_hash, question, created_at, event_id, ttl_seconds, cache_type,
       (SELECT COUNT(*) FROM v_cache_writes e WHERE e.query_hash = w.query_hash
          AND (e.created_at < w.created_at OR e.created_at = w.created_at AND e.event_id < w.event_id)) AS hit_count
FROM v_cache_writes w""")
def q_running_hit_count_rows(v):
    """W8 with the rows' other columns kept."""
    return running_hit_count(v.cache_writes, "query_hash", "created_at", "event_id", parts=3)


def _freq_sql(where: str) -> str:
    return f"""
SELECT *, substring(query, 1, 55) AS label FROM (
  SELECT normalized_query AS query, COUNT(*) AS count, MAX(asked_at) AS last_asked
  FROM v_question_history {where} GROUP BY 1 ORDER BY last_asked DESC, query LIMIT 10)"""


@register("frequent_questions", "A45", _freq_sql(""))
def q_frequent_questions(v):
    """A45 most recently asked questions with counts, everyone."""
    return M.frequent_questions(v.question_history)


@register("frequent_questions_user", "A45", _freq_sql("WHERE user_name = '3'"))
def q_frequent_questions_user(v):
    """A45 for one user."""
    return M.frequent_questions(v.question_history, "3")


@register("entity_mentions", "A46", """
WITH recent AS (SELECT lower(query_text) AS q FROM (
                  SELECT query_text, MAX(asked_at) AS last_asked FROM v_question_history WHERE user_name = '1'
                  GROUP BY query_text ORDER BY last_asked DESC, query_text LIMIT 20)),
ents AS (SELECT n_name AS entity, row_number() OVER (ORDER BY n_name) AS position FROM nation
         ORDER BY position LIMIT 50),
c AS (SELECT e.entity, e.position,
             CAST((SELECT COUNT(*) FROM recent r WHERE contains(r.q, lower(e.entity))) AS INTEGER) AS mentions
      FROM ents e)
SELECT 'frequent_vendor' AS memory_key, entity AS memory_val, 'entity' AS memory_type, 'inferred' AS source,
       least(mentions / 10.0, 1.0) AS confidence, mentions
FROM c WHERE mentions >= 3 ORDER BY position LIMIT 1""")
def q_entity_mentions(v):
    """A46 the first listed entity mentioned in >= 3 of a user's recent questions."""
    ents = v.t.nation.select(F.col("n_name").alias("entity"),
                             F.row_number().over(Window.orderBy("n_name")).alias("position"))
    return M.entity_mentions(v.question_history, ents, "1")


@register("recent_messages", "J8", f"""
SELECT e.session_id, e.turn_index, e.role, e.content, e.ts
FROM v_chat_events e JOIN v_chat_sessions s ON e.session_id = s.session_id
WHERE s.user_name = '1' AND e.ts >= {NOW_SQL} - INTERVAL 2 DAY""")
def q_recent_messages(v):
    """J8 a user's messages of the last two days."""
    return recent_messages(v.chat_events, v.chat_sessions, "1", NOW - _dt.timedelta(days=2)) \
        .select("session_id", "turn_index", "role", "content", "ts")


@register("sessions_with_counts", "J9", """
WITH s AS (SELECT * FROM v_chat_sessions WHERE user_name = '2'
           ORDER BY last_updated DESC NULLS LAST, session_id LIMIT 10),
c AS (SELECT session_id, COUNT(*) AS message_count FROM v_chat_events GROUP BY 1)
SELECT s.session_id, s.user_name, s.created_at, s.last_updated, c.message_count
FROM s JOIN c ON s.session_id = c.session_id""")
def q_sessions_with_counts(v):
    """J9 a user's newest sessions with message counts."""
    return sessions_with_counts(v.chat_sessions, v.chat_events, "2")


@register("session_messages", "M7", """
SELECT * FROM v_chat_events WHERE session_id = '7'""")
def q_session_messages(v):
    """M7 one session's messages in order."""
    return M.session_messages(v.chat_events, "7")


def _insights(v):
    h = v.question_history
    return h.select(F.col("id").alias("insight_id"), F.col("user_name").alias("created_by"),
                    F.when(F.col("id") % 2 == 0, F.lit("assistant")).otherwise(F.lit("dashboard")).alias("page"),
                    F.substring("query_text", 1, S.INSIGHT_TITLE_CHARS).alias("title"),
                    F.col("query_text").alias("question"),
                    F.when(F.col("id") % 3 == 0, F.lit("kpi_summary")).otherwise(F.lit("mom_drivers"))
                    .alias("verified_query_name"), F.col("asked_at").alias("created_at"))


@register("saved_insights", "M8+C16", """
SELECT insight_id, title, question, verified_query_name, created_at FROM (
  SELECT id AS insight_id, user_name AS created_by, CASE WHEN id % 2 = 0 THEN 'assistant' ELSE 'dashboard' END AS page,
         substring(query_text, 1, 45) AS title, query_text AS question,
         CASE WHEN id % 3 = 0 THEN 'kpi_summary' ELSE 'mom_drivers' END AS verified_query_name,
         asked_at AS created_at FROM v_question_history)
WHERE created_by = '4' AND page = 'assistant' ORDER BY created_at DESC, insight_id DESC LIMIT 20""")
def q_saved_insights(v):
    """M8 a user's newest saved insights on a page."""
    return M.saved_insights(_insights(v), "4", "assistant")


@register("question_log_rows", "M10", """
SELECT lower(trim(query_text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS normalized_query, query_text, user_name, asked_at FROM v_question_history""")
def q_question_log_rows(v):
    """M10 rows as appended to the question log (normalised text)."""
    return M.log_rows(v.question_history)


@register("conversation_context", "M11+J8+C17", f"""
WITH m AS (SELECT e.* FROM v_chat_events e JOIN v_chat_sessions s ON e.session_id = s.session_id
           WHERE s.user_name = '0' AND e.ts >= {NOW_SQL} - INTERVAL 2 DAY
           ORDER BY e.ts DESC, e.turn_index DESC LIMIT 20)
SELECT COUNT(*) AS messages,
       CASE WHEN COUNT(*) > 0 THEN 'Conversation history:' || {NL} || {NL}
         || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content,
                       {NL} || {NL} ORDER BY ts, turn_index)
         || {NL} || {NL} || 'New question:' || {NL} ELSE '' END AS context
FROM m""")
def q_conversation_context(v):
    """M11 prompt context from a user's recent messages."""
    return M.conversation_context(v.chat_events, v.chat_sessions, "0", NOW)


@register("short_term_text", "M11+W2+C16+C17", """
WITH t AS (SELECT session_id, turn_index, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': '
      || CASE WHEN length(content) > 600 THEN substring(content, 1, 600) || '…' ELSE content END AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS rn
          FROM v_chat_messages) WHERE rn <= 6)
SELECT session_id, 'Previous conversation context (use this to answer follow-up questions):' || chr(10) || chr(10)
       || string_agg(line, chr(10) || chr(10) ORDER BY turn_index)
       || chr(10) || chr(10) || '---' || chr(10) || 'New question:' || chr(10) AS context
FROM t GROUP BY session_id""")
def q_short_term_text(v):
    """M11 the newest turns of each session as one prompt text."""
    return M.short_term_text(v.chat_messages, 3)


@register("short_term_context", "W2+C16+C17", """
SELECT session_id, turn_index,
       CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' ||
       CASE WHEN length(content) > 600 THEN substring(content, 1, 600) || '…' ELSE content END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS rn
      FROM v_chat_messages) WHERE rn <= 6""")
def q_short_term_context(v):
    """W2 newest 3 turns (6 messages) per conversation, labelled and cut."""
    return M.short_term_context(v.chat_messages, 3)


@register("export_transcript", "S10+C17", f"""
SELECT DISTINCT session_id, CAST(-2 AS BIGINT) AS line_no, '# Conversation' || {NL} AS text FROM v_chat_messages
UNION ALL
SELECT session_id, CAST(turn_index AS BIGINT),
       CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END || {NL} || {NL} || COALESCE(content, '')
       || {NL} || {NL} || '---' || {NL}
FROM v_chat_messages""")
def q_export_transcript(v):
    """S10 Markdown transcript blocks per conversation."""
    return export_transcript(v.chat_messages)


@register("transcript_documents", "S10+C17", f"""
SELECT session_id, CAST(0 AS BIGINT) AS part, '# Conversation' || {NL} || {NL} || CASE WHEN session_id LIKE '%7' THEN
         '**Summary**' || {NL} || {NL} || 'About ' || session_id || {NL} || {NL} || '---' || {NL} || {NL} ELSE '' END || string_agg(
         CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END || {NL} || {NL} || COALESCE(content, '')
         || {NL} || {NL} || '---' || {NL}, {NL} ORDER BY turn_index) AS document
FROM v_chat_messages GROUP BY session_id""")
def q_transcript_documents(v):
    """S10 one Markdown document per conversation, some with a summary (these are all short: one part)."""
    m = v.chat_messages
    told = m.filter(F.col("session_id").endswith("7")).select(
        "session_id", F.concat(F.lit("About "), F.col("session_id")).alias("summary")).distinct()
    return assemble_transcript(export_transcript(m, summaries=told))


# blocks cut into parts of 200 code points: the part of a block by a plain window over its session
@register("transcript_document_parts", "S10", f"""
WITH b AS (SELECT DISTINCT session_id, -2 AS line_no, '# Conversation' || {NL} AS text FROM v_chat_messages
  UNION ALL SELECT session_id, turn_index, CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END
    || {NL} || {NL} || COALESCE(content, '') || {NL} || {NL} || '---' || {NL} FROM v_chat_messages),
p AS (SELECT *, CAST(COALESCE(SUM(length(text) + 1) OVER (PARTITION BY session_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200 AS BIGINT) AS part FROM b)
SELECT session_id, part, string_agg(text, {NL} ORDER BY line_no) AS document FROM p GROUP BY session_id, part""")
def q_transcript_document_parts(v):
    """S10 documents cut into short numbered parts."""
    return assemble_transcript(export_transcript(v.chat_messages), part_chars=200)


@register("kpi_snapshot", "M9+C19+S9", f"""
WITH k AS ({kpi_sql(START, END).strip()})
SELECT md5('user1:YTD:{START.isoformat()}:{END.isoformat()}') AS snapshot_id, 'user1' AS user_name,
       'YTD' AS preset, '{START.isoformat()}' AS start_date, '{END.isoformat()}' AS end_date,
       CAST(to_json({{'total_spend': CAST(total_spend AS DECIMAL(38,6)), 'active_pos': active_pos,
                      'total_pos': total_pos, 'pending_inv': pending_inv, 'active_vendors': active_vendors,
                      'avg_processing_days': CAST(avg_processing_days AS DECIMAL(38,6)),
                      'first_pass_rate': CAST(first_pass_rate AS DECIMAL(38,6)),
                      'auto_rate': CAST(auto_rate AS DECIMAL(38,6))}}) AS VARCHAR) AS kpi_json,
       {NOW_SQL} AS created_at
FROM k""")
def q_kpi_snapshot(v):
    """M9 the KPI row stored as JSON under its snapshot key."""
    from ledgerflow.operators.kpi import kpi_summary
    k = kpi_summary(v, START, END)
    plain = k.select(*[F.col(c).cast("decimal(38,6)").alias(c) if t == "double" else c for c, t in k.dtypes])
    return M.kpi_snapshot(plain, "user1", "YTD", START, END, NOW)


@register("json_rows", "S9", """
SELECT CAST(to_json({'payment_window': payment_window, 'invoice_count': invoice_count,
                     'total_amount': CAST(total_amount AS DECIMAL(38,2)), 'window_order': window_order}) AS VARCHAR)
       AS json
FROM (SELECT CASE WHEN due_date < DATE '2000-06-30' THEN 'Overdue'
                  WHEN due_date <= DATE '2000-06-30' + INTERVAL 7 DAY THEN 'Due in 0-7 days'
                  WHEN due_date <= DATE '2000-06-30' + INTERVAL 14 DAY THEN 'Due in 8-14 days'
                  WHEN due_date <= DATE '2000-06-30' + INTERVAL 30 DAY THEN 'Due in 15-30 days'
                  ELSE 'Due later' END AS payment_window,
             COUNT(*) AS invoice_count, CAST(SUM(invoice_amount_local) AS DOUBLE) AS total_amount,
             CAST(0 AS INTEGER) AS window_order
      FROM v_invoice WHERE upper(invoice_status) IN ('OPEN','DUE') GROUP BY 1) t""")
def q_json_rows(v):
    """S9 result rows serialised as JSON objects."""
    from ledgerflow.operators.forecast import payment_timing
    pt = payment_timing(v.invoice, S.AS_OF).withColumn("window_order", F.lit(0)).withColumn(
        "total_amount", F.col("total_amount").cast("decimal(38,2)"))
    return to_json_rows(pt)
