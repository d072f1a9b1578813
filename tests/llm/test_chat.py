import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def test_any_text_comes_back(spark):
    piece = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("\\<>/lsturn\n")), max_size=12)
    rows = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.sampled_from(["user", "assistant", "system", "a<b\\", ""]), piece), min_size=1, max_size=60)

    @settings(max_examples=8, deadline=None)
    @given(rows)
    def check(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
        for r in out.collect():
            turns = sorted((t, ro, tx) for c, t, ro, tx in rows if c == r["conv_id"])
            assert [(b["role"], b["text"]) for b in r["back"]] == [(ro, tx) for _, ro, tx in turns]
            assert r["loss"] == "".join(tx for _, ro, tx in turns if ro == "assistant")
            assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
            assert r["n_blocks"] == sum(i == 0 or turns[i - 1][1] != t[1] for i, t in enumerate(turns))

    check()


def test_template_and_nulls(spark):
    df = spark.createDataFrame([(1, 2, "assistant", None), (1, 1, "user", "b"), (1, 0, "user", "a<"), (1, None, None, "\\"), (None, 0, "user", "n")], SCHEMA).selectExpr("*", "1 as turns", "2 as formatted")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    assert got[1] == "<turn><says>\\s</turn>\n<turn>user<says>a\\l<part>b</turn>\n<turn>assistant<says></turn>\n"
    assert got[None] == "<turn>user<says>n</turn>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    r = chat.format_chats(df).select("n_blocks", F.size(chat.read_back(F.col("formatted"))).alias("n")).first()
    assert (r["n_blocks"], r["n"]) == (20_000, 20_000)


def test_many_turns_of_one_role(spark):
    """Reading a block back takes time in proportion to its parts."""
    df = spark.range(50_000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "concat('turn ', id, ' <', repeat('x', 200)) as text")
    formatted = spark.createDataFrame([(chat.format_chats(df).first()["formatted"],)], "formatted string")
    began = time.time()
    back = formatted.select(chat.read_back(F.col("formatted")).alias("b")).selectExpr("size(b) as n", "b[49999].text as last").first()
    assert time.time() - began < 10
    assert back["n"] == 50_000 and back["last"] == "turn 49999 <" + "x" * 200


def test_query_against_sql(spark, duck, same):
    same(spark, duck, registry.op9_chat, registry.ORACLE_SQL["op9_chat"])
    plan = registry.op9_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
