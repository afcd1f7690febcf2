"""State tables re-aimed from point updates to batch merges (M1-M11),
question-log statistics (A44-A46) and conversation helpers (J8/J9/W2/W8).

A merge is: changes -> newest per key (a partial ``max_by`` aggregate,
so a hot key is combined map-side) -> FULL OUTER JOIN with the state on
the key -> per-column choice (new value, kept value or counter).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions.scalars import md5_key, role_label, round_tenth, truncate_text


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def age_micros(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` (zone-less timestamps), exact and
    independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", start, end)


def newest_per_key(changes: DataFrame, keys: list[str], order: list[str],
                   first: dict[str, str] | None = None) -> DataFrame:
    """Newest change per key by ``order``; ``first`` adds min() columns
    (e.g. the time of the first insert) and ``_n`` counts the changes."""
    vals = [c for c in changes.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    aggs = [F.max_by(F.struct(*[F.col(c) for c in vals]), ordering).alias("_new"),
            F.count(F.lit(1)).alias("_n")]
    for out, src in (first or {}).items():
        aggs.append(F.min(src).alias(out))
    g = changes.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[F.col(f"_new.{c}").alias(c) for c in vals], "_n",
                    *list((first or {}).keys()))


def upsert_latest(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str],
                  keep: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """M1 insert-or-update by key. Columns in ``keep`` retain the stored value
    for existing keys (new keys take ``defaults`` or the change's value);
    every other column takes the newest change. ``first`` columns of a new
    key take the earliest change's value (e.g. the creation time). Keys
    without changes pass through unchanged."""
    defaults = {c: F.col(f"n._first_{c}") for c in first}
    new = newest_per_key(changes, keys, order, {f"_first_{c}": c for c in first}).alias("n")
    marked = state.withColumn("_exists", F.lit(True)).alias("o")
    j = marked.join(new, keys, "full")
    exists = F.coalesce(F.col("o._exists"), F.lit(False))
    has_new = F.col("n._n").isNotNull()
    cols = [F.col(k) for k in keys]
    for c in state.columns:
        if c in keys:
            continue
        kept = F.col(f"o.{c}")
        if c in keep:
            fresh = defaults.get(c, F.col(f"n.{c}") if c in changes.columns else F.lit(None))
            cols.append(F.when(exists, kept).otherwise(fresh).alias(c))
        elif c in changes.columns:
            cols.append(F.when(has_new, F.col(f"n.{c}")).otherwise(kept).alias(c))
        else:
            cols.append(kept.alias(c))
    return j.select(*cols)


MEMORY_COLS = ("memory_id", "user_name", "memory_type", "memory_key", "memory_val", "source",
               "confidence", "created_at", "updated_at", "access_count")


def memory_state(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """M1 for user memory: value, type, source, confidence and updated_at
    follow the newest change; created_at (time of the first insert) and
    access_count are kept for existing keys; new keys start at 0 accesses."""
    ch = (changes.withColumn("_seq", F.col("seq")).drop("seq")
          .withColumn("created_at", F.col("updated_at"))
          .withColumn("access_count", F.lit(0).cast("bigint")))
    if state is None:
        state = changes.sparkSession.createDataFrame(
            [], ch.select(*MEMORY_COLS).schema)
    out = upsert_latest(state.select(*MEMORY_COLS), ch, ["memory_id"], ["updated_at", "_seq"],
                        keep=("created_at", "access_count"), first=("created_at",))
    return out.withColumn("access_count", F.coalesce(F.col("access_count"), F.lit(0).cast("bigint")))


def ttl_live(cache: DataFrame, as_of_ts, default_ttl: int = S.DEFAULT_TTL_SECONDS) -> DataFrame:
    """M2 entries whose age (as_of - created_at) is at most their ttl
    (default when null); integer microseconds, so the boundary is exact."""
    age = age_micros(F.col("created_at"), _ts(as_of_ts))
    ttl = F.coalesce(F.col("ttl_seconds"), F.lit(default_ttl)).cast("bigint") * 1_000_000
    return cache.filter(age <= ttl)


def cache_lookup(cache: DataFrame, questions: DataFrame, as_of_ts,
                 default_ttl: int = S.DEFAULT_TTL_SECONDS) -> DataFrame:
    """M2 live cache hits for a batch of (question, cache_type) lookups; the
    key is md5(lower(trim(question)))."""
    from ledgerflow.functions.scalars import strip_
    q = questions.select(F.md5(F.lower(strip_("question"))).alias("query_hash"),
                         F.col("question").alias("asked"), "cache_type")
    return ttl_live(cache, as_of_ts, default_ttl).join(q, ["query_hash", "cache_type"], "inner")


def upsert_count(state: DataFrame | None, writes: DataFrame, keys: list[str], order: list[str],
                 initial: int = 0) -> DataFrame:
    """M3 INSERT OR REPLACE with hit_count = old + 1 per re-write (``initial``
    for the first write of a new key); the row otherwise is the newest write."""
    new = newest_per_key(writes, keys, order)
    payload = [c for c in writes.columns if c not in keys]
    if state is None:
        return new.select(*keys, *payload,
                          (F.lit(initial) + F.col("_n") - 1).cast("bigint").alias("hit_count"))
    j = state.select(*keys, F.col("hit_count").alias("_old")).join(new, keys, "right")
    hits = F.when(F.col("_old").isNotNull(), F.col("_old") + F.col("_n")) \
        .otherwise(F.lit(initial) + F.col("_n") - 1)
    merged = j.select(*keys, *payload, hits.cast("bigint").alias("hit_count"))
    untouched = state.join(new.select(*keys), keys, "left_anti").select(*keys, *payload, "hit_count")
    return merged.unionByName(untouched)


def touch_count(state: DataFrame, accesses: DataFrame, key: str, counter: str) -> DataFrame:
    """M4 each read adds one to ``counter``: reads are counted per key first
    (partial aggregate) and joined back."""
    n = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("_reads"))
    j = state.join(n, key, "left")
    return j.withColumn(counter, (F.col(counter) + F.coalesce(F.col("_reads"), F.lit(0))).cast("bigint")) \
        .drop("_reads")


def delete_keys(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """M5 remove rows whose key is listed."""
    return state.join(keys.select(*on).distinct(), on, "left_anti")


def delete_type(state: DataFrame, cache_type: str | None) -> DataFrame:
    """M5 remove a whole type, or everything when ``cache_type`` is None; rows
    without a type stay."""
    if cache_type is None:
        return state.limit(0)
    return state.filter(~F.col("cache_type").eqNullSafe(cache_type))


def memory_by_user(memory: DataFrame, user: str, memory_type: str | None = None) -> DataFrame:
    """M6 one user's memories: by type then access count desc (or by access
    count only when a type is given)."""
    f = memory.filter(F.col("user_name") == user)
    if memory_type is not None:
        f = f.filter(F.col("memory_type") == memory_type)
        order = [F.col("access_count").desc(), F.col("memory_key")]
    else:
        order = [F.col("memory_type"), F.col("access_count").desc(), F.col("memory_key")]
    return f.select("memory_key", "memory_val", "memory_type", "source", "confidence", "updated_at",
                    "access_count").orderBy(*order)


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    """M7 one session's messages in (turn, time) order."""
    order = [c for c in ("turn_index", "ts") if c in messages.columns]
    return messages.filter(F.col("session_id") == session_id).orderBy(*order)


def saved_insights(insights: DataFrame, user: str, page: str, limit: int = 20) -> DataFrame:
    """M8 a user's insights on a page, newest first, ``limit`` rows."""
    return (insights.filter((F.col("created_by") == user) & (F.col("page") == page))
            .select("insight_id", "title", "question", "verified_query_name", "created_at")
            .orderBy(F.col("created_at").desc(), F.col("insight_id").desc()).limit(limit))


def kpi_snapshot(kpi: DataFrame, user: str, preset: str, start: _dt.date, end: _dt.date,
                 created_at) -> DataFrame:
    """M9 the KPI row as JSON keyed by md5(user:preset:start:end)."""
    return kpi.select(
        md5_key(F.lit(user), F.lit(preset), F.lit(start.isoformat()), F.lit(end.isoformat()))
        .alias("snapshot_id"),
        F.lit(user).alias("user_name"), F.lit(preset).alias("preset"),
        F.lit(start.isoformat()).alias("start_date"), F.lit(end.isoformat()).alias("end_date"),
        F.to_json(F.struct(*kpi.columns)).alias("kpi_json"),
        _ts(created_at).alias("created_at"))


def log_rows(questions: DataFrame, user_col: str = "user_name") -> DataFrame:
    """M10 rows appended to the question log: normalised text, user, time."""
    from ledgerflow.functions.scalars import strip_
    return questions.select(F.lower(strip_("query_text")).alias("normalized_query"), "query_text",
                            user_col, "asked_at")


def append_log(df: DataFrame, path: str) -> None:
    """M10 append rows to a log table."""
    df.write.mode("append").parquet(path)


def conversation_context(messages: DataFrame, sessions: DataFrame, user: str, now,
                         limit: int = S.CONTEXT_MESSAGES, days: int = S.CONTEXT_DAYS) -> DataFrame:
    """M11 the user's newest ``limit`` messages of the last ``days`` days,
    oldest first, labelled and joined into one prompt text (a bounded list:
    at most ``limit`` rows reach the final aggregate)."""
    from ledgerflow.operators.joins import recent_messages
    now_c = _ts(now)
    cutoff = now_c - F.expr(f"INTERVAL {int(days)} DAYS")
    m = recent_messages(messages, sessions, user, cutoff)
    top = m.orderBy(F.col("ts").desc(), F.col("turn_index").desc()).limit(limit)
    line = F.concat(role_label("role"), F.lit(": "), F.col("content"))
    pieces = top.select(F.struct("ts", "turn_index", line.alias("line")).alias("p"))
    agg = pieces.agg(F.array_sort(F.collect_list("p")).alias("ps"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit(S.CONTEXT_HEADER),
                    F.array_join(F.transform("ps", lambda x: x["line"]), "\n\n"),
                    F.lit(S.CONTEXT_FOOTER))
    return agg.select(F.col("n").alias("messages"),
                      F.when(F.col("n") > 0, text).otherwise(F.lit("")).alias("context"))


def short_term_text(messages: DataFrame, max_turns: int = 6) -> DataFrame:
    """M11 (session_id, context): the newest ``max_turns * 2`` messages of each
    session, oldest first, as one text with header and footer. A group holds
    that many messages at most. A session without messages has no row."""
    from ledgerflow.operators.windows import top_n_per_group
    kept = top_n_per_group(messages, "session_id", [F.col("turn_index").desc()], max_turns * 2)
    line = F.concat(role_label("role"), F.lit(": "), F.coalesce(truncate_text("content"), F.lit("")))
    own = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line")))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["line"]), "\n\n")
    return own.select("session_id", F.concat(F.lit(S.SHORT_CONTEXT_HEADER), text,
                                             F.lit(S.SHORT_CONTEXT_FOOTER)).alias("context"))


def short_term_context(messages: DataFrame, max_turns: int) -> DataFrame:
    """W2 + C16 + C17 per session: newest ``max_turns*2`` messages, oldest
    first, as 'Label: text' with text cut at 600 characters."""
    from ledgerflow.operators.windows import recent_n
    r = recent_n(messages, max_turns)
    return r.select("session_id", "turn_index",
                    F.concat(role_label("role"), F.lit(": "), truncate_text("content")).alias("line"))


# -- A44-A46 question log and cache statistics ---------------------------------------
def cache_stats(cache: DataFrame, as_of_ts) -> DataFrame:
    """A44 per cache type: entries, total and mean hits (1 dp), expired count."""
    age = age_micros(F.col("created_at"), _ts(as_of_ts))
    expired = age > F.col("ttl_seconds").cast("bigint") * 1_000_000
    return (cache.groupBy(F.col("cache_type").alias("type"))
            .agg(F.count(F.lit(1)).alias("entries"),
                 F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("total_hits"),
                 F.sum("hit_count").alias("_sum"),
                 F.count("hit_count").alias("_n"),
                 F.sum(F.when(expired, 1).otherwise(0)).cast("bigint").alias("expired"))
            .select("type", "entries", "total_hits",
                    F.coalesce(round_tenth(F.col("_sum").cast("double") / F.col("_n")), F.lit(0.0))
                    .alias("avg_hits"), "expired"))


def frequent_questions(history: DataFrame, user: str | None = None, limit: int = 10) -> DataFrame:
    """A45 questions by normalised text: count and last asked, most recent
    first (ties by text), ``limit`` rows; one user or everyone."""
    f = history if user is None else history.filter(F.col("user_name") == user)
    g = f.groupBy(F.col("normalized_query").alias("query")).agg(
        F.count(F.lit(1)).alias("count"), F.max("asked_at").alias("last_asked"))
    return (g.orderBy(F.col("last_asked").desc(), F.col("query")).limit(limit)
            .withColumn("label", F.substring("query", 1, S.FAQ_LABEL_CHARS)))


def recent_distinct_questions(history: DataFrame, user: str, recent: int = 20) -> DataFrame:
    """The user's ``recent`` newest distinct question texts (by their latest
    asking time), lower-cased."""
    g = (history.filter(F.col("user_name") == user)
         .groupBy("query_text").agg(F.max("asked_at").alias("last_asked")))
    return g.orderBy(F.col("last_asked").desc(), F.col("query_text")).limit(recent) \
        .select(F.lower("query_text").alias("q"))


def entity_mentions(history: DataFrame, entities: DataFrame, user: str,
                    recent: int = S.ENTITY_RECENT_QUESTIONS, first_n: int = S.ENTITY_FIRST_N,
                    min_count: int = S.ENTITY_MIN_MENTIONS) -> DataFrame:
    """A46 the first entity (in list order, among the first ``first_n``)
    contained in at least ``min_count`` of the user's ``recent`` newest
    distinct questions; confidence = min(count / 10, 1).

    The recent questions are a bounded list (``recent`` rows) packed into
    one array by a scalar subquery and tested against each entity, so no
    question x entity pairs are materialised."""
    qs = recent_distinct_questions(history, user, recent).agg(F.collect_list("q")).scalar()
    ents = (entities.select("entity", "position").orderBy("position").limit(first_n))
    counted = ents.select("entity", "position", qs.alias("qs")).select(
        "entity", "position",
        F.size(F.filter("qs", lambda q: q.contains(F.lower(F.col("entity"))))).alias("mentions"))
    hit = counted.filter(F.col("mentions") >= min_count).orderBy("position").limit(1)
    return hit.select(F.lit(S.FREQUENT_VENDOR_KEY).alias("memory_key"), F.col("entity").alias("memory_val"),
                      F.lit(S.ENTITY_MEMORY_TYPE).alias("memory_type"), F.lit(S.INFERRED_SOURCE).alias("source"),
                      F.least(F.col("mentions") / 10.0, F.lit(1.0)).alias("confidence"), "mentions")


def infer_preset_memory(history: DataFrame) -> DataFrame:
    """C24 applied to the question log: preferred preset per question."""
    from ledgerflow.functions.scalars import infer_preset
    p = infer_preset("query_text")
    return history.select("id", "user_name", p["preset"].alias("preset"),
                          p["confidence"].alias("confidence")).filter(F.col("preset").isNotNull())


def merge_batches(state: DataFrame, batches, merge, every: int = 4) -> DataFrame:
    """Fold change batches into a state table: ``state = merge(state, batch)``
    for each batch in order. Each merge adds a join to the plan, so the
    lineage is cut with a reliable ``checkpoint()`` (written to the shared
    ``spark.checkpoint.dir``; never a local checkpoint) every ``every``
    batches; a lost executor then recomputes from the last checkpoint, not
    from the first batch."""
    from ledgerflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(state.sparkSession)
    for i, batch in enumerate(batches, 1):
        state = merge(state, batch)
        if every and i % every == 0:
            state = state.checkpoint(eager=True)
    return state
