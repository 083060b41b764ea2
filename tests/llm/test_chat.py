import duckdb

from flowgrain.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "unknown", x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = set()
    for c, s in seqs.items():
        same = [d for d, z in seqs.items() if z == s]
        if min(same) == c and not any(len(z) > len(s) and z[: len(s)] == s for z in seqs.values()):
            out.add((c, len(s), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s)))
    return out


def test_prefixes_collapse(spark):
    rows = []
    for c, n in [(1, 1), (2, 3), (3, 2), (4, 3), (5, 4)]:
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(n)]
    rows += [(6, 0, "user", "turn 0"), (6, 1, "assistant", "other"), (7, 5, None, None), (8, None, "user", ""), (2, 1, "assistant", "turn 1"), (9, 0, "user", "same"), (9, 0, "user", "tie"), (10, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as pos", "2 as n_turns")
    got = {tuple(r) for r in chat.format_chats(df).collect()}
    assert got == brute(rows)
    assert {g[0] for g in got} == {5, 6, 7, 8, 9, 10}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_equals_sql_and_runs_without_python(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    out = chat.format_chats(spark.read.parquet(path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    assert {tuple(r) for r in out.collect()} == set(con.execute(chat.ORACLE_SQL).fetchall())
    assert "Python" not in out._jdf.queryExecution().toString()
