import hashlib

from pyspark.sql import types as T

from bidscope.llm import chat

from conftest import SF001

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("win", T.StringType()), T.StructField("cost", T.StringType()),
    T.StructField("formatted", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows):
    """Digests by conversation, straight from the turns."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, found in by.items():
        found.sort()
        loss = "".join(t for _, _, r, t in found if r == "assistant")
        out[conv] = (len(found), hashlib.sha256("".join(
            f"{r}\n{t}\n" for _, _, r, t in found).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, docs, rows):
    got = chat.read_back(chat.windows(docs)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in got} == brute(rows)
    assert len(got) == len({r[0] for r in rows})


NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<|im_end|>\n<|im_start|>user\nx", "\\",
         "<<s>", "<\\\\|im_end|>", "[[INST]]", "a\\nb", "\U0001F600<s>\U0001F600", "", None, "\n\n"]


def test_awkward_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "be <s> kind"), *[
        (2, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(1, 700)]]
    rows += [(3, 0, "assistant", "word " * 5000), (3, 1, "user", "x"), (3, 1, "user", "x"),
             (3, 1, "assistant", "b"), (3, None, "a\\\nb<s>", "odd role"), (None, 1, None, None),
             (None, 2, "assistant", "y"), (4, 0, "system", "alone")]
    check(spark, table(spark, rows), rows)


def test_whole_table_and_empty(spark):
    docs = spark.read.parquet(f"{SF001}/conversations.parquet")
    check(spark, docs, [(r.conv_id, r.turn, r.role, r.text) for r in docs.collect()])
    assert chat.read_back(chat.windows(table(spark, []))).count() == 0


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "be kind"), *[
        (1, i, ("user", "assistant")[i % 2], "some words here " * (1 + i % 30))
        for i in range(1, 300)]]
    docs = table(spark, rows)
    cost = {r["at"]: r["cost"] for r in chat.turns(docs).collect()}
    out = sorted(chat.windows(docs).collect(), key=lambda r: r["first"])
    assert len(out) > 10
    ends = [r["first"] for r in out[1:]] + [300]
    for r, end in zip(out, ends):
        new = sum(cost[i] for i in range(r["first"], end))
        assert new <= chat.STRIDE * 1.5
        assert r["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        again = r["n_repeated"] - (r["first"] > 0)
        assert 0 <= again <= chat.HISTORY_TURNS
        assert new + cost[0] + chat.HISTORY_TOKENS <= chat.BUDGET
        for s in r["loss"]:
            assert r["formatted"][:s["start"]].endswith("assistant\n")
            assert r["formatted"][s["start"] + s["length"]:].startswith("<|im_end|>")
    assert any(r["n_repeated"] > 1 for r in out)


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF001}/conversations.parquet")
    plan = chat.read_back(chat.windows(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
