import duckdb

from bidscope.llm import chat

from test_chat import check, table


def conversation(conv, system, sizes):
    return [(conv, 0, "system", "word " * system)] + [
        (conv, i, ("user", "assistant")[i % 2], "some " * n) for i, n in enumerate(sizes, 1)]


def test_no_window_exceeds_the_budget(spark):
    rows = conversation(1, 600, [20 + 37 * i % 230 for i in range(120)])
    rows += conversation(2, 70, [5, 40, 800, 60, 30, 900, 240, 250, 250, 240, 250, 10, 940, 3])
    rows += conversation(3, 130, [250] * 40) + conversation(4, 900, [1 + i % 60 for i in range(90)])
    rows += conversation(None, 500, [2, 500, 3, 300, 210])
    docs = table(spark, rows)
    cost = {(r["conv_id"], r["at"]): r["cost"] for r in chat.turns(docs).collect()}
    by = {}
    for r in chat.windows(docs).collect():
        by.setdefault(r["conv_id"], []).append(r)
    for conv, found in by.items():
        found.sort(key=lambda r: r["window"])
        firsts = [r["first"] for r in found]
        assert firsts == sorted(set(firsts)) and firsts[0] == 0
        ends = [*firsts[1:], sum(1 for c, _ in cost if c == conv)]
        for r, end in zip(found, ends):
            again = r["n_repeated"] - (r["first"] > 0)
            total = sum(cost[conv, i] for i in range(r["first"] - again, end))
            total += cost[conv, 0] * (r["first"] > 0)
            assert total <= chat.BUDGET
    # Where there is room, history stays and turns still share windows.
    assert any(r["n_repeated"] > 1 for r in by[1]) and len(by[1]) < 80
    check(spark, docs, rows)


def test_a_system_turn_longer_than_the_budget(spark):
    rows = conversation(1, 1200, [30] * 50)
    docs = table(spark, rows)
    assert chat.windows(docs).count() < 10
    check(spark, docs, rows)


def test_sql_equals_the_windows_of_conversations_over_the_budget(spark):
    rows = conversation(1, 600, [20 + 37 * i % 230 for i in range(60)])
    rows += conversation(2, 70, [5, 40, 800, 60, 30, 900, 240, 250, 250, 240, 250, 10, 940, 3])
    rows += conversation(3, 1200, [30] * 50) + conversation(None, 500, [2, 500, 3, 300, 210])
    rows += [(4, 1, "user", "same <|im_end|>"), (4, 1, "user", "same <|im_end|>"), (4, None, None, None)]
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.read_back(chat.windows(table(spark, rows + probe)))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = con.execute(chat.ORACLE)
    names = [d[0] for d in result.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(
        "Row(" + ", ".join(
            f"{n}={v!r}" for n, v in zip(names, r)) + ")" for r in result.fetchall())
    assert sum(r["n_windows"] for r in got.collect()) > 40


def test_the_conversations_are_read_once(spark):
    docs = table(spark, conversation(1, 70, [30] * 20))
    plan = chat.windows(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 6 and "ExistingRDD" not in plan
