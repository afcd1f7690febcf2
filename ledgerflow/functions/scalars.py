"""Scalar functions C1-C30: date, text, number and rule helpers.

Each takes and returns ``Column`` objects and stays inside whole-stage
codegen (no Python UDFs).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import semantics as S

__all__ = [
    "col_", "month_start", "year_start", "add_months_", "add_days", "days_between",
    "month_key", "month_label", "yyyymm", "as_of_date", "tenths", "round_tenth", "fixed_text", "pct_delta", "abbr_currency",
    "clean_invoice_number", "format_invoice_number", "safe_number", "safe_int",
    "try_cast_", "coalesce_", "case_",
    "round_", "ym_label", "strip_", "truncate_text", "role_label", "age_label", "md5_key",
    "sha_key", "hash_text", "key_text", "is_relevant", "route_intent", "chart_title_class",
    "infer_preset", "split_sections", "repair_json_map", "parse_json_cell", "status_group",
    "bucket_label", "detail_aging", "ratio", "any_contains",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- C1-C6 dates ------------------------------------------------------------
def month_start(c) -> Column:
    """C1 DATE_TRUNC('month') keeping a DATE."""
    return F.trunc(col_(c), "MM")


def year_start(c) -> Column:
    return F.trunc(col_(c), "YEAR")


def add_months_(c, n: int) -> Column:
    """C2 DATE_ADD('month', n, d)."""
    return F.add_months(col_(c), n)


def add_days(c, n: int) -> Column:
    return F.date_add(col_(c), n)


def days_between(a, b) -> Column:
    """C3 DATE_DIFF('day', a, b) = b - a."""
    return F.datediff(col_(b), col_(a))


def month_key(c) -> Column:
    """C4 '%Y-%m'."""
    return F.date_format(col_(c), "yyyy-MM")


def month_label(c) -> Column:
    """C4 '%b %Y' (e.g. 'Jan 2000')."""
    return F.date_format(col_(c), "MMM yyyy")


def yyyymm(c) -> Column:
    """C5 year*100+month as an int."""
    c = col_(c)
    return F.year(c) * 100 + F.month(c)


def as_of_date(value: _dt.date | None = None) -> Column:
    """C6 CURRENT_DATE replaced by an explicit date (R9)."""
    return F.current_date() if value is None else F.lit(value).cast("date")


# -- C7-C11 numbers and identifiers ----------------------------------------
def ratio(num, den, scale: float = 1.0) -> Column:
    """num/den*scale in double, 0.0 when den is 0 or null (R10)."""
    num, den = col_(num), col_(den)
    return (F.when(den > 0, num.cast("double") / den.cast("double") * F.lit(scale))
            .otherwise(F.lit(0.0)))


def _let(c: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def tenths(c) -> Column:
    """|c| * 10 rounded to a bigint, by the exact value of c and half-even on
    exact ties, as Python's ``round`` and format round; null from 9.2e17 up.

    Whole part and fraction f are exact. The rounded product p = 10 f and its
    exact error e (f split in two halves, whose products with 10 are exact) tell
    on which side of a tie f lies: where p is no tie, ``rint(p)`` is right,
    since e is less than the distance of p to the next tie; where it is one, the
    sign of e decides."""
    def rounded(f: Column, high: Column) -> Column:
        p, near = f * F.lit(10.0), F.rint(f * F.lit(10.0))
        e = (high * F.lit(10.0) - p) + (f - high) * F.lit(10.0)
        tie = F.abs(p - near) == 0.5
        return F.when(tie & (e > 0), F.ceil(p)).when(tie & (e < 0), F.floor(p)).otherwise(near.cast("bigint"))

    split = F.lit(134217729.0)                  # 2^27 + 1

    def of(x: Column) -> Column:
        whole = F.floor(F.when(x < 9.2e17, x))
        return whole * 10 + _let(x - whole, lambda f: _let(f * split - (f * split - f), lambda high: rounded(f, high)))

    return _let(F.abs(col_(c).cast("double")), of)


def round_tenth(c) -> Column:
    """c rounded to one decimal as Python's ``round(c, 1)``."""
    c = col_(c).cast("double")
    near = _let(tenths(c), lambda n: F.when(F.abs(c) < 2.0 ** 49, n.cast("double") / F.lit(10.0)).when(
        F.abs(c) < 2.0 ** 52, (n - n % 10).cast("double") / F.lit(10.0) + (n % 10).cast("double") / F.lit(10.0)))
    return F.coalesce(F.signum(c) * near, c)


def fixed_text(c, digits: int) -> Column:
    """The text of |c| with 0 or 1 decimals, as Python's ``f"{abs(c):.1f}"``."""
    c = F.abs(col_(c).cast("double"))
    if digits == 0:
        whole = F.when(c < 9.2e18, F.rint(c)).cast("bigint").cast("string")
        return F.coalesce(whole, F.format_string("%.0f", c))
    text = _let(tenths(c), lambda n: F.concat(
        F.call_function("div", n - n % 10, F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string")))
    return F.coalesce(text, F.format_string("%.1f", c))


def pct_delta(cur, prev) -> Column:
    """C7 struct(label, up): percent change label as the dashboard shows it."""
    cur, prev = col_(cur).cast("double"), col_(prev).cast("double")
    change = (cur - prev) / prev * F.lit(100.0)
    label = (F.when(prev == 0, F.when(cur == 0, F.lit("-")).otherwise(F.lit("+100%")))
             .when(F.abs(change) < 0.05, F.lit("0%"))
             .otherwise(F.concat(F.when(change < 0, F.lit("-")).otherwise(F.lit("+")), fixed_text(change, 1), F.lit("%"))))
    up = (F.when(prev == 0, cur >= 0)
          .when(F.abs(change) < 0.05, F.lit(True))
          .otherwise(change >= 0))
    return F.struct(label.alias("label"), up.alias("up"))


def abbr_currency(c, sym: str = "$") -> Column:
    """C8 '$1.2M' style: K/M/B at 1e3/1e6/1e9 with 1 dp, else 0 dp.
    Rounded by the exact value of the double, as Python's format does."""
    v = col_(c).cast("double")
    n = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))

    def fmt(x, digits, suffix):
        return F.concat(sign, F.lit(sym), fixed_text(x, digits), F.lit(suffix))

    return (F.when(n >= 1e9, fmt(n / 1e9, 1, "B"))
            .when(n >= 1e6, fmt(n / 1e6, 1, "M"))
            .when(n >= 1e3, fmt(n / 1e3, 1, "K"))
            .otherwise(fmt(n, 0, "")))


def clean_invoice_number(c) -> Column:
    """C9 text before the first '.'; numbers truncated to an integer."""
    c = col_(c)
    return F.substring_index(c.cast("string"), ".", 1)


def format_invoice_number(c) -> Column:
    """C10 drop a trailing '.0', integer text when numeric, '' for null."""
    s = F.regexp_replace(col_(c).cast("string"), r"\.0$", "")
    as_int = s.try_cast("double").try_cast("bigint").cast("string")
    return F.when(col_(c).isNull(), F.lit("")).otherwise(F.coalesce(as_int, s))


def safe_number(c, default: float = 0.0) -> Column:
    """C11 float or default."""
    return F.coalesce(try_cast_(col_(c).cast("string"), "double"), F.lit(float(default)))


def safe_int(c, default: int = 0) -> Column:
    return F.coalesce(try_cast_(try_cast_(col_(c).cast("string"), "double"), "bigint"),
                      F.lit(int(default)).cast("bigint"))


# -- C12-C15 generic ---------------------------------------------------------
def any_contains(c, words) -> Column:
    c = col_(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def try_cast_(c, t: str) -> Column:
    """CAST that yields NULL on bad input (ANSI mode safe)."""
    return col_(c).try_cast(t)


def coalesce_(*cs) -> Column:
    return F.coalesce(*[col_(c) for c in cs])


def case_(pairs, otherwise=None) -> Column:
    """CASE WHEN: ``pairs`` is a sequence of (condition, value)."""
    out = None
    for cond, val in pairs:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if otherwise is not None:
        out = out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return out


def round_(c, n: int = 0) -> Column:
    """ROUND half-up (round decimals, not doubles, to agree across engines)."""
    return F.round(col_(c), n)


def ym_label(year, month) -> Column:
    """C15 'yyyy-MM' from (year, month) pair columns."""
    return F.format_string("%04d-%02d", col_(year).cast("int"), col_(month).cast("int"))


# -- C16-C19 text and keys ---------------------------------------------------
def truncate_text(c, n: int = S.TRANSCRIPT_TRUNCATE, ellipsis: str = "…") -> Column:
    """C16 first n chars plus an ellipsis when longer."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def role_label(c) -> Column:
    """C17 user -> User, anything else -> Assistant."""
    return F.when(col_(c) == "user", F.lit(S.ROLE_USER_LABEL)).otherwise(F.lit(S.ROLE_OTHER_LABEL))


def age_label(ts, now) -> Column:
    """C18 '<h>h ago' under 24 h, else '<d>d ago' (whole hours, truncated)."""
    micros = F.timestamp_diff("MICROSECOND", col_(ts), col_(now))
    hours = F.floor(micros / 3600000000).cast("bigint")
    return F.when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))) \
        .otherwise(F.concat(F.floor(hours / 24).cast("bigint").cast("string"), F.lit("d ago")))


def md5_key(*cols, sep: str = ":") -> Column:
    """C19 md5 hex of the ':'-joined text."""
    return F.md5(F.concat_ws(sep, *[col_(c).cast("string") for c in cols]))


def hash_text(c, kind: T.DataType | None = None) -> Column:
    """Text form of a value for hashing: its full plain text, null -> ''."""
    return F.coalesce(col_(c).cast("string"), F.lit(""))


def key_text(c, kind: T.DataType | None = None) -> Column:
    """Text form of a business key, the same for every numeric type: whole
    numbers as plain digits, decimals without trailing zeros, doubles in full.
    Other types, and an unknown type, as ``hash_text``."""
    c = col_(c)
    if isinstance(kind, T.DecimalType):
        plain = c.cast("string")
        text = F.when(F.contains(plain, F.lit(".")),
                      F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))).otherwise(plain)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c.cast("double"))) & (F.abs(c) < 9.007199254740992e15)
        text = F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def sha_key(*cols) -> Column:
    """C20 sha2-256 over '||'-joined text, null -> ''."""
    return F.sha2(F.concat_ws("||", *[hash_text(c) for c in cols]), 256)


# -- C21-C25 question rules ---------------------------------------------------
def _q(c) -> Column:
    """Question text as the rules see it: lower-cased, whitespace stripped."""
    return F.lower(strip_(col_(c)))


def is_relevant(c) -> Column:
    """C21 reject patterns first, then any procurement keyword."""
    q = _q(c)
    reject = reduce(lambda a, b: a | b, [q.rlike(p) for p in S.NON_PROCUREMENT_PATTERNS])
    keyword = any_contains(q, S.PROCUREMENT_KEYWORDS)
    return F.when(q.isNull(), F.lit(False)).when(reject, F.lit(False)) \
        .otherwise(F.coalesce(keyword, F.lit(False)))


def route_intent(c) -> Column:
    """C22 exact titles, then the relevance gate, then keyword rules in order."""
    raw = col_(c)
    lq = F.lower(raw)
    out = None
    for title, intent in S.EXACT_ROUTES:
        cond = raw == F.lit(title)
        out = F.when(cond, F.lit(intent)) if out is None else out.when(cond, F.lit(intent))
    out = out.when(~is_relevant(raw), F.lit(S.ROUTE_IRRELEVANT))
    for words, intent in S.KEYWORD_ROUTES:
        out = out.when(any_contains(lq, words), F.lit(intent))
    return out.otherwise(F.lit(S.ROUTE_DEFAULT))


def chart_title_class(c) -> Column:
    """C23 title suffix from increase/decrease words (substring match)."""
    lq = F.lower(col_(c))
    suffix = (F.when(any_contains(lq, S.INCREASE_WORDS), F.lit(S.TITLE_INCREASED))
              .when(any_contains(lq, S.DECREASE_WORDS), F.lit(S.TITLE_DECREASED))
              .otherwise(F.lit(S.TITLE_CHANGED)))
    return F.concat(F.lit(S.TITLE_PREFIX), suffix)


def infer_preset(c) -> Column:
    """C24 struct(preset, confidence) or nulls when no rule matches."""
    lq = F.lower(col_(c))
    preset, conf = None, None
    for words, name, confidence in S.PRESET_RULES:
        cond = any_contains(lq, words)
        preset = F.when(cond, F.lit(name)) if preset is None else preset.when(cond, F.lit(name))
        conf = F.when(cond, F.lit(confidence)) if conf is None else conf.when(cond, F.lit(confidence))
    return F.struct(preset.alias("preset"), conf.alias("confidence"))


WHITESPACE = " \t\n\r\f\x0b"


def strip_(c) -> Column:
    """Python-style strip(): all ASCII whitespace, not only spaces."""
    return F.trim(col_(c), F.lit(WHITESPACE))


def split_sections(c) -> Column:
    """C25 struct(descriptive, prescriptive) split at the first prescriptive
    heading; the leading descriptive heading is stripped."""
    parts = F.split(col_(c), S.PRESCRIPTIVE_SPLIT, 2)
    desc = strip_(F.regexp_replace(strip_(parts.getItem(0)), S.DESCRIPTIVE_HEAD, ""))
    pres = F.when(F.size(parts) > 1, strip_(parts.getItem(1))).otherwise(F.lit(""))
    return F.struct(desc.alias("descriptive"), pres.alias("prescriptive"))


# -- C26-C27 JSON -------------------------------------------------------------
def repair_json_map(c) -> Column:
    """C26 map<string,string> from model output: strip code fences, keep the
    outermost {...}, drop trailing commas, parse; when parsing fails, fall
    back to the "key": "value" pairs found by a regex (a repeated key keeps
    its last value, as a dict built from the pairs would)."""
    bare = F.regexp_replace(strip_(col_(c)), r"```json\s*|```\s*$", "")
    outer = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    body = F.regexp_replace(F.when(outer != "", outer).otherwise(bare), r",\s*([}\]])", "$1")
    parsed = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    pair = r'"([^"]+)"\s*:\s*"([^"]*)"'
    found = F.reverse(F.arrays_zip(F.regexp_extract_all(body, F.lit(pair), 1).alias("k"),
                                   F.regexp_extract_all(body, F.lit(pair), 2).alias("v")))
    keys = F.transform(found, lambda e: e["k"])
    # newest first: a pair stays if its key has not come up before
    newest = F.filter(found, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    fallback = F.when(F.size(found) > 0, F.map_from_entries(newest))
    return F.coalesce(parsed, fallback)


def parse_json_cell(c, schema: str) -> Column:
    """C27 JSON text -> typed value."""
    return F.from_json(col_(c), schema)


# -- C28-C30 domain lookups --------------------------------------------------
def status_group(c) -> Column:
    """C28 14-status map to Paid / Pending / Disputed / Other."""
    u = F.upper(col_(c))
    out = None
    for label, members in S.STATUS_GROUPS:
        cond = u.isin(*members)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(S.STATUS_GROUP_ELSE))


def bucket_label(c) -> Column:
    """C29 bucket code -> label, unknown codes pass through."""
    m = F.create_map(*[F.lit(x) for pair in S.BUCKET_LABELS for x in pair])
    c = col_(c)
    return F.coalesce(m[F.upper(c.cast("string"))], c.cast("string"))


def detail_aging(due, aging, as_of) -> Column:
    """C30 days past due from due_date, else stored aging_days, else 0; >= 0."""
    return F.greatest(F.coalesce(F.datediff(col_(as_of), col_(due)), col_(aging).cast("int"),
                                 F.lit(0)), F.lit(0))
