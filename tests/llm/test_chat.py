from ledgerflow.llm import chat

TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> all"), (1, 2, "bob", "Hello"), (1, 3, "cy d", None),
    (1, 4, "ann", "Bye"), (1, 2, "bob", "Hello"), (1, 2, "ann", "at once"),
    (2, 0, "user", "alone"), (3, 0, "system", "nobody speaks"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "ok"), (4, None, "user", "no number"), (4, 5, None, "no role"),
    (5, 0, "user", "x" * 20_000), (5, 300, "user", "second window"), (5, 301, "assistant", "yes"), (6, 0, "user", ""),
]


def brute(rows, window=256, lead=16):
    out = set()
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, set()).add((-1 if turn is None else turn, role or "unknown", text or ""))
    for c, turns in talks.items():
        turns = sorted(turns)
        told = [t for t in turns[:window] if t[1] == "system"]
        for part, at in enumerate(range(0, len(turns), window)):
            own = turns[at:at + window]
            context = [] if not part else told + [t for t in turns[at - lead:at] if part > 1 or t[1] != "system"]
            for who in sorted({r for _, r, _ in own} - {"system"}):
                text, spans = "", []
                for k, (_, role, words) in enumerate(context + own):
                    name = "_".join(role.replace("<|", "< |").split()) if role != who else ""
                    head = ("<|im_start|>assistant\n" if role == who else "<|im_start|>system\n" if role == "system"
                            else f"<|im_start|>user name={name}\n")
                    body = words.replace("<|", "< |") + "<|im_end|>"
                    if role == who and k >= len(context):
                        spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
                    text += head + body + "\n"
                out.add((c, part, who, len(own), len(context), text, tuple(spans), sum(b - a for a, b in spans)))
    return out


def found(df):
    return {(r.conv_id, r.part, r.perspective, r.n_turns, r.n_context, r.text,
             tuple((m.start, m.end) for m in r["mask"]), r.n_masked) for r in df.collect()}


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*t, "clash", 1) for t in TURNS],
                               "conv_id long, turn long, role string, text string, part string, mask int")
    got = chat.examples(df)
    assert found(got) == brute(TURNS)
    assert got.count() == len(brute(TURNS))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


LONG = ([(7, 0, "system", "Be brief."), (7, 3, "system", "And kind.")]
        + [(7, k + 1, f"p{k % 3}" if k < 500 else "late", f"turn {k}") for k in range(600)]
        + [(7, 400, "system", "Later rule.")]
        + [(8, 5, f"q{k % 2}", f"same turn {k:04d}") for k in range(1000)] * 2      # 1,000 rows on one turn
        + [(None, None, "p0", f"null {k:03d}") for k in range(300)] + [(9, 0, "p0", "short")])


def test_long_conversations_keep_their_context(spark):
    df = spark.createDataFrame(LONG, "conv_id long, turn long, role string, text string").repartition(7)
    got = found(chat.examples(df))
    assert got == brute(LONG)
    later = [r for r in got if r[0] == 7 and r[1] == 1]
    assert {r[2] for r in later} == {"p0", "p1", "p2", "late"}
    assert all(r[5].startswith("<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>system\nAnd kind.") for r in later)
    small = found(chat.examples(df, window=100, lead=7))
    assert small == brute(LONG, 100, 7) and max(r[3] for r in small) == 100


def test_sql_on_long_conversations(spark, tmp_path):
    import duckdb

    from ledgerflow.llm import queries

    df = spark.createDataFrame(LONG + TURNS, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(queries.SQL["op10_chat"])
    names = [d[0] for d in cur.description]
    got = queries.op10_chat(spark, str(tmp_path))
    assert {tuple(r[c] for c in names) for r in got.collect()} == set(cur.fetchall())


def test_masked_spans_hold_only_the_speaker(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for r in chat.examples(df).filter("conv_id = 1").collect():
        spoken = [r.text[m.start:m.end] for m in r["mask"]]
        said = [t for _, _, role, t in sorted(set(TURNS[:7]), key=lambda x: (x[1], x[2])) if role == r.perspective]
        assert spoken == [(t or "").replace("<|", "< |") + "<|im_end|>" for t in said]


def test_long_conversation_is_dealt_in_windows(spark):
    df = spark.range(2000).selectExpr("7L AS conv_id", "id AS turn", "concat('p', id % 3) AS role", "'t' AS text")
    got = chat.examples(df, window=100)
    assert got.count() == 60
    assert got.agg({"n_turns": "max"}).first()[0] == 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.examples(df).count() == 0
