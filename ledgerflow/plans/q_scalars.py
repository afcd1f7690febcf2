"""Registered queries: scalar functions C1-C30 applied to fixture columns.

The oracle CASE expressions for the text rules (C21-C24) are written out
from the same fixed lists in ``ledgerflow.semantics``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions import scalars as C
from ledgerflow.plans.registry import AS_OF, dlit, register

A = dlit(AS_OF)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def relevant_sql(col: str) -> str:
    q = f"lower(trim({col}, {WS_SQL}))"
    rej = " OR ".join(f"regexp_matches({q}, {_q(p)})" for p in S.NON_PROCUREMENT_PATTERNS)
    kw = " OR ".join(f"contains({q}, {_q(k)})" for k in S.PROCUREMENT_KEYWORDS)
    return f"(CASE WHEN {q} IS NULL THEN FALSE WHEN {rej} THEN FALSE ELSE COALESCE({kw}, FALSE) END)"


def route_sql(col: str) -> str:
    parts = [f"WHEN {col} = {_q(t)} THEN {_q(i)}" for t, i in S.EXACT_ROUTES]
    parts.append(f"WHEN NOT {relevant_sql(col)} THEN {_q(S.ROUTE_IRRELEVANT)}")
    for words, intent in S.KEYWORD_ROUTES:
        cond = " OR ".join(f"contains(lower({col}), {_q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {_q(intent)}")
    return "CASE " + " ".join(parts) + f" ELSE {_q(S.ROUTE_DEFAULT)} END"


def title_sql(col: str) -> str:
    inc = " OR ".join(f"contains(lower({col}), {_q(w)})" for w in S.INCREASE_WORDS)
    dec = " OR ".join(f"contains(lower({col}), {_q(w)})" for w in S.DECREASE_WORDS)
    return (f"{_q(S.TITLE_PREFIX)} || CASE WHEN {inc} THEN {_q(S.TITLE_INCREASED)} "
            f"WHEN {dec} THEN {_q(S.TITLE_DECREASED)} ELSE {_q(S.TITLE_CHANGED)} END")


def preset_sql(col: str) -> tuple[str, str]:
    p, c = [], []
    for words, name, conf in S.PRESET_RULES:
        cond = " OR ".join(f"contains(lower({col}), {_q(w)})" for w in words)
        p.append(f"WHEN {cond} THEN {_q(name)}")
        c.append(f"WHEN {cond} THEN CAST({conf} AS DOUBLE)")
    return "CASE " + " ".join(p) + " END", "CASE " + " ".join(c) + " END"


@register("scalar_dates", "C1+C2+C3+C5+C6", f"""
SELECT DISTINCT posting_date,
       CAST(date_trunc('month', posting_date) AS DATE) AS month_start,
       CAST(date_trunc('year', posting_date) AS DATE) AS year_start,
       CAST(posting_date + INTERVAL 1 MONTH AS DATE) AS next_month,
       CAST(posting_date - INTERVAL 6 MONTH AS DATE) AS six_months_back,
       posting_date + 30 AS plus_30_days,
       CAST(datediff('day', posting_date, due_date) AS INTEGER) AS days_to_due,
       CAST(year(posting_date) * 100 + month(posting_date) AS INTEGER) AS yyyymm,
       CAST(datediff('day', posting_date, {A}) AS INTEGER) AS age_days
FROM v_invoice""")
def q_scalar_dates(v):
    """C1-C3, C5, C6 date helpers."""
    return v.invoice.select(
        "posting_date", C.month_start("posting_date").alias("month_start"),
        C.year_start("posting_date").alias("year_start"),
        C.add_months_("posting_date", 1).alias("next_month"),
        C.add_months_("posting_date", -6).alias("six_months_back"),
        C.add_days("posting_date", 30).alias("plus_30_days"),
        C.days_between("posting_date", "due_date").alias("days_to_due"),
        C.yyyymm("posting_date").alias("yyyymm"),
        C.days_between("posting_date", C.as_of_date(AS_OF)).alias("age_days")).distinct()


@register("scalar_month_labels", "C4+C15", """
SELECT DISTINCT strftime(posting_date, '%Y-%m') AS month_key, strftime(posting_date, '%b %Y') AS month_label,
       printf('%04d-%02d', year(posting_date), month(posting_date)) AS ym_label
FROM v_invoice""")
def q_scalar_month_labels(v):
    """C4 'yyyy-MM' and 'Mon yyyy' labels, C15 from (year, month)."""
    return v.invoice.select(C.month_key("posting_date").alias("month_key"),
                            C.month_label("posting_date").alias("month_label"),
                            C.ym_label(F.year("posting_date"), F.month("posting_date")).alias("ym_label")
                            ).distinct()


@register("scalar_pct_delta", "C7+W3", """
WITH m AS (SELECT CAST(date_trunc('month', posting_date) AS DATE) AS month,
                  CAST(SUM(invoice_amount_local) AS DOUBLE) AS spend FROM v_invoice GROUP BY 1),
p AS (SELECT month, spend AS cur, COALESCE(lag(spend) OVER (ORDER BY month), 0.0) AS prev FROM m),
c AS (SELECT *, (cur - prev) / prev * 100.0 AS ch FROM p)
SELECT month, CASE WHEN prev = 0 THEN (CASE WHEN cur = 0 THEN '-' ELSE '+100%' END)
                   WHEN abs(ch) < 0.05 THEN '0%' ELSE printf('%+.1f%%', ch) END AS label,
       CASE WHEN prev = 0 THEN cur >= 0 WHEN abs(ch) < 0.05 THEN TRUE ELSE ch >= 0 END AS up
FROM c""")
def q_scalar_pct_delta(v):
    """C7 month-over-month change labels of monthly spend (one row per month)."""
    m = (v.invoice.groupBy(C.month_start("posting_date").alias("month"))
         .agg(F.sum("invoice_amount_local").cast("double").alias("spend")))
    p = m.select("month", F.col("spend").alias("cur"),
                 F.coalesce(F.lag("spend").over(Window.orderBy("month")), F.lit(0.0)).alias("prev"))
    d = C.pct_delta("cur", "prev")
    return p.select("month", d["label"].alias("label"), d["up"].alias("up"))


def _abbr_sql(x: str) -> str:
    n = f"abs({x})"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"

    def f(val, d, suf):
        return f"{sign} || '$' || printf('%.{d}f', {val}) || '{suf}'"
    return (f"CASE WHEN {n} >= 1e9 THEN {f(f'{n} / 1e9', 1, 'B')} WHEN {n} >= 1e6 THEN {f(f'{n} / 1e6', 1, 'M')} "
            f"WHEN {n} >= 1e3 THEN {f(f'{n} / 1e3', 1, 'K')} ELSE {f(n, 0, '')} END")


@register("scalar_abbr_currency", "C8", f"""
WITH a AS (SELECT invoice_number, CAST(invoice_amount_local AS DOUBLE) AS amt FROM v_invoice)
SELECT invoice_number, amt, {_abbr_sql('amt')} AS amount_label, {_abbr_sql('-amt / 1000')} AS small_label,
       {_abbr_sql('amt * 100')} AS m_label, {_abbr_sql('amt * 100000')} AS b_label
FROM a""")
def q_scalar_abbr_currency(v):
    """C8 short currency labels across K / M / B ranges and signs."""
    a = v.invoice.select("invoice_number", F.col("invoice_amount_local").cast("double").alias("amt"))
    return a.select("invoice_number", "amt", C.abbr_currency("amt").alias("amount_label"),
                    C.abbr_currency(-F.col("amt") / 1000).alias("small_label"),
                    C.abbr_currency(F.col("amt") * 100).alias("m_label"),
                    C.abbr_currency(F.col("amt") * 100000).alias("b_label"))


INV_TEXT = ("CASE WHEN invoice_number % 7 = 0 THEN NULL WHEN invoice_number % 5 = 0 THEN 'INV-' || "
            "CAST(invoice_number AS VARCHAR) WHEN invoice_number % 2 = 0 THEN CAST(invoice_number AS VARCHAR) "
            "|| '.0' ELSE CAST(invoice_amount_local AS VARCHAR) END")


@register("scalar_invoice_numbers", "C9+C10", f"""
WITH t AS (SELECT invoice_number, {INV_TEXT} AS raw FROM v_invoice),
u AS (SELECT *, regexp_replace(raw, '\\.0$', '') AS s FROM t)
SELECT invoice_number, raw, split_part(raw, '.', 1) AS cleaned,
       CASE WHEN raw IS NULL THEN '' ELSE COALESCE(CAST(TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS VARCHAR), s)
       END AS formatted
FROM u""")
def q_scalar_invoice_numbers(v):
    """C9 text before '.', C10 display form (drop '.0', integer text, '' for null)."""
    n = F.col("invoice_number")
    raw = (F.when(n % 7 == 0, F.lit(None).cast("string"))
           .when(n % 5 == 0, F.concat(F.lit("INV-"), n.cast("string")))
           .when(n % 2 == 0, F.concat(n.cast("string"), F.lit(".0")))
           .otherwise(F.col("invoice_amount_local").cast("string")))
    t = v.invoice.select("invoice_number", raw.alias("raw"))
    return t.select("invoice_number", "raw", C.clean_invoice_number("raw").alias("cleaned"),
                    C.format_invoice_number("raw").alias("formatted"))


EVENT_TEXT = ("CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN CAST(value AS VARCHAR) "
              "ELSE NULL END")


@register("scalar_safe_numbers", "C11+C13", f"""
WITH t AS (SELECT event_id, {EVENT_TEXT} AS raw FROM events)
SELECT event_id, raw, COALESCE(TRY_CAST(raw AS DOUBLE), 0.0) AS as_number,
       COALESCE(TRY_CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT), 0) AS as_int,
       CAST(event_id AS VARCHAR) AS id_text,
       CASE WHEN regexp_matches(raw, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(raw AS INTEGER) END AS try_int
FROM t""")
def q_scalar_safe_numbers(v):
    """C11 number-or-default parsing, C13 casts."""
    e = v.t.events
    raw = (F.when(F.col("event_id") % 3 == 0, F.col("props"))
           .when(F.col("event_id") % 3 == 1, F.col("value").cast("string")))
    t = e.select("event_id", raw.alias("raw"))
    return t.select("event_id", "raw", C.safe_number("raw", 0.0).alias("as_number"),
                    C.safe_int("raw", 0).alias("as_int"), F.col("event_id").cast("string").alias("id_text"),
                    C.try_cast_("raw", "int").alias("try_int"))


@register("scalar_text_basics", "C12", """
SELECT id, upper(query_text) AS upper_text, lower(query_text) AS lower_text, trim(query_text) AS trimmed,
       contains(lower(query_text), 'vendor') AS mentions_vendor
FROM v_question_history""")
def q_scalar_text_basics(v):
    """C12 upper / lower / trim / contains."""
    h = v.question_history
    return h.select("id", F.upper("query_text").alias("upper_text"), F.lower("query_text").alias("lower_text"),
                    F.trim("query_text").alias("trimmed"),
                    F.lower("query_text").contains("vendor").alias("mentions_vendor"))


@register("scalar_conditionals", "C14+C28+C30", f"""
SELECT invoice_number, vendor_id, COALESCE(due_date, posting_date) AS due_or_posted,
       CASE WHEN upper(invoice_status) IN ('PAID','CLEARED','CLOSED','POSTED','SETTLED') THEN 'Paid'
            WHEN upper(invoice_status) IN ('OPEN','PENDING','ON HOLD','PARKED','IN PROGRESS') THEN 'Pending'
            WHEN upper(invoice_status) IN ('DISPUTE','DISPUTED','BLOCKED','CONTESTED') THEN 'Disputed'
            ELSE 'Other' END AS status_group,
       CAST(round(invoice_amount_local * 0.015, 2) AS DOUBLE) AS fee,
       abs(aging_days) AS abs_aging,
       greatest(COALESCE(CAST(datediff('day', due_date, {A}) AS INTEGER), aging_days, 0), 0) AS detail_aging
FROM v_invoice""")
def q_scalar_conditionals(v):
    """C14 coalesce / case / round / abs, C28 status groups, C30 detail aging."""
    i = v.invoice
    return i.select("invoice_number", "vendor_id",
                    C.coalesce_("due_date", "posting_date").alias("due_or_posted"),
                    C.status_group("invoice_status").alias("status_group"),
                    C.round_(F.col("invoice_amount_local") * F.lit(0.015).cast("decimal(4,3)"), 2)
                    .cast("double").alias("fee"),
                    F.abs("aging_days").alias("abs_aging"),
                    C.detail_aging("due_date", "aging_days", C.as_of_date(AS_OF)).alias("detail_aging"))


@register("scalar_conversation_text", "C16+C17", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn,
       CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS label,
       CASE WHEN length(text) > 600 THEN substring(text, 1, 600) || '…' ELSE text END AS short_text,
       substring(text, 1, 45) AS title
FROM conversations""")
def q_scalar_conversation_text(v):
    """C16 600-char cut with ellipsis and 45-char label prefix, C17 role labels."""
    c = v.t.conversations
    return c.select(F.col("conv_id").cast("string").alias("session_id"), "turn",
                    C.role_label("role").alias("label"), C.truncate_text("text").alias("short_text"),
                    F.substring("text", 1, 45).alias("title"))


@register("scalar_age_label", "C18", f"""
WITH h AS (SELECT session_id, CAST(floor((epoch_us({NOW_SQL}) - epoch_us(created_at)) / 3600000000) AS BIGINT) AS h
           FROM v_chat_sessions)
SELECT session_id, CASE WHEN h < 24 THEN CAST(h AS VARCHAR) || 'h ago'
                        ELSE CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age
FROM h""")
def q_scalar_age_label(v):
    """C18 session age labels."""
    return v.chat_sessions.select("session_id",
                                  C.age_label("created_at", F.lit(S.AS_OF_TS).cast("timestamp_ntz")).alias("age"))


@register("scalar_keys", "C19+C20", """
SELECT l_orderkey, l_linenumber, md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)) AS md5_key,
       sha256(concat_ws('||', COALESCE(CAST(l_orderkey AS VARCHAR), ''), COALESCE(CAST(l_linenumber AS VARCHAR), ''),
                        COALESCE(l_returnflag, ''))) AS sha_key
FROM lineitem""")
def q_scalar_keys(v):
    """C19 md5 of 'a:b', C20 sha2-256 of '||'-joined text."""
    li = v.t.lineitem
    return li.select("l_orderkey", "l_linenumber", C.md5_key("l_orderkey", "l_linenumber").alias("md5_key"),
                     C.sha_key("l_orderkey", "l_linenumber", "l_returnflag").alias("sha_key"))


@register("scalar_question_rules", "C21+C22+C23+C24", f"""
SELECT id, {relevant_sql('query_text')} AS relevant, {route_sql('query_text')} AS intent,
       {title_sql('query_text')} AS chart_title,
       {preset_sql('query_text')[0]} AS preset, {preset_sql('query_text')[1]} AS preset_confidence
FROM v_question_history""")
def q_scalar_question_rules(v):
    """C21 relevance gate, C22 intent routing, C23 chart title, C24 preset."""
    h = v.question_history
    p = C.infer_preset("query_text")
    return h.select("id", C.is_relevant("query_text").alias("relevant"),
                    C.route_intent("query_text").alias("intent"),
                    C.chart_title_class("query_text").alias("chart_title"),
                    p["preset"].alias("preset"), p["confidence"].alias("preset_confidence"))


NARRATIVE = ("CASE WHEN turn % 2 = 0 THEN '**Descriptive** ' || text || chr(10) || '**Prescriptive** — act on ' "
             "|| role ELSE text END")
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@register("scalar_split_sections", "C25", f"""
WITH t AS (SELECT conv_id, turn, {NARRATIVE} AS txt FROM conversations),
m AS (SELECT *, regexp_matches(txt, '(?i)\\n?\\*{{0,2}}prescriptive\\*{{0,2}}[:\\s\\-—]*') AS has,
             regexp_extract(txt, '(?is)^(.*?)\\n?\\*{{0,2}}prescriptive\\*{{0,2}}[:\\s\\-—]*(.*)$', 1) AS d0,
             regexp_extract(txt, '(?is)^(.*?)\\n?\\*{{0,2}}prescriptive\\*{{0,2}}[:\\s\\-—]*(.*)$', 2) AS p0
      FROM t)
SELECT conv_id, turn,
       trim(regexp_replace(trim(CASE WHEN has THEN d0 ELSE txt END, {WS}), '(?i)^\\*{{0,2}}descriptive\\*{{0,2}}[:\\s\\-—]*', ''), {WS})
         AS descriptive,
       CASE WHEN has THEN trim(p0, {WS}) ELSE '' END AS prescriptive
FROM m""")
def q_scalar_split_sections(v):
    """C25 narrative split into descriptive / prescriptive parts."""
    c = v.t.conversations
    txt = F.when(F.col("turn") % 2 == 0,
                 F.concat(F.lit("**Descriptive** "), F.col("text"), F.lit("\n**Prescriptive** — act on "),
                          F.col("role"))).otherwise(F.col("text"))
    s = C.split_sections(txt)
    return c.select("conv_id", "turn", s["descriptive"].alias("descriptive"),
                    s["prescriptive"].alias("prescriptive"))


MODEL_TEXT = "'```json' || chr(10) || replace(props, '}', ', }') || chr(10) || '```'"


@register("scalar_json", "C26+C27", f"""
WITH t AS (SELECT event_id, props, {MODEL_TEXT} AS raw FROM events),
s AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '```json\\s*', '', 'g'), '```\\s*$', '') AS t1 FROM t),
b AS (SELECT *, instr(t1, '{{') AS f, length(t1) - instr(reverse(t1), '}}') + 1 AS l,
             instr(reverse(t1), '}}') AS lr FROM s),
c AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN f > 0 AND lr > 0 AND l > f THEN substring(t1, f, l - f + 1)
                                                     ELSE t1 END, ',\\s*}}', '}}', 'g'), ',\\s*]', ']', 'g') AS cand FROM b)
SELECT event_id, json_extract_string(cand, '$.k') AS k_value, CAST(len(json_keys(cand)) AS INTEGER) AS n_keys,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k_parsed
FROM c""")
def q_scalar_json(v):
    """C26 repair of model-style JSON text into a map, C27 typed JSON parse."""
    e = v.t.events
    raw = F.concat(F.lit("```json\n"), F.regexp_replace("props", "}", ", }"), F.lit("\n```"))
    m = C.repair_json_map(raw)
    return e.select("event_id", m["k"].alias("k_value"), F.size(m).alias("n_keys"),
                    C.parse_json_cell("props", "k int")["k"].alias("k_parsed"))


@register("scalar_bucket_label", "C29", """
WITH b AS (SELECT CASE WHEN du < 0 THEN 'OVERDUE_NOW' WHEN du <= 7 THEN 'due_7_days' WHEN du <= 30 THEN 'DUE_30_DAYS'
                       ELSE 'LATER' END AS code, invoice_number
           FROM (SELECT invoice_number, datediff('day', DATE '2000-06-30', due_date) AS du FROM v_invoice))
SELECT invoice_number, code, CASE upper(code) WHEN 'TOTAL_UNPAID' THEN 'Total Unpaid' WHEN 'OVERDUE_NOW' THEN 'Overdue Now'
  WHEN 'DUE_7_DAYS' THEN 'Due in 7 Days' WHEN 'DUE_14_DAYS' THEN 'Due in 14 Days'
  WHEN 'DUE_30_DAYS' THEN 'Due in 30 Days' WHEN 'DUE_60_DAYS' THEN 'Due in 60 Days'
  WHEN 'DUE_90_DAYS' THEN 'Due in 90 Days' WHEN 'BEYOND_90_DAYS' THEN 'Beyond 90 Days' ELSE code END AS label
FROM b""")
def q_scalar_bucket_label(v):
    """C29 bucket codes to labels (case-insensitive, unknown codes kept)."""
    du = F.datediff(F.col("due_date"), C.as_of_date(AS_OF))
    code = (F.when(du < 0, "OVERDUE_NOW").when(du <= 7, "due_7_days").when(du <= 30, "DUE_30_DAYS")
            .otherwise("LATER"))
    b = v.invoice.select("invoice_number", code.alias("code"))
    return b.select("invoice_number", "code", C.bucket_label("code").alias("label"))
