import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.chat import Template, escape, format_chat, loss_text, read_chat, unescape

T = Template()
PARTS = [*T.controls, "<", "[", "\\", "|im_start|>", "s>", "INST]", "a", "\n", "é", "<|im_end|", "/s>"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_escapes_are_exact_and_hide_controls(spark):
    df = spark.createDataFrame([(t,) for t in texts(0, 2000)], "t string").withColumn("e", escape(F.col("t"), T)).withColumn("u", unescape(F.col("e"), T))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in T.controls)


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 1000))
def test_reads_back_what_was_formatted(spark, seed):
    t, rng = texts(seed), random.Random(seed)
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "system", "", "odd\nrole", "back\\nslash", "</s>"]), x) for i, x in enumerate(t)]
    out = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), T)
    for r in out.select("conv_id", read_chat(F.col("formatted"), T).alias("turns"), loss_text(F.col("segments"), T).alias("loss"), "segments", "formatted").collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


def test_turn_order(spark):
    orders = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "system assistant", 7: "user assistant tool"}
    rows = [(k, i, role, "x") for k, v in orders.items() for i, role in enumerate(v.split())]
    random.Random(0).shuffle(rows)
    got = {r.conv_id: r.valid for r in format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, turns string"
    rows = [(None, 1, "user", "q", "mine"), (1, None, "user", "first", None), (1, 1, None, None, None), (1, 1, "assistant", "b", None), (1, 1, "assistant", "b", None), (2, 1, "assistant", "", "")]
    got = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in format_chat(spark.createDataFrame(rows, schema)).select("conv_id", read_chat(F.col("formatted")).alias("turns")).collect()}
    assert got == {None: [("user", "q")], 1: [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")], 2: [("assistant", "")]}
    assert format_chat(spark.createDataFrame([], schema)).count() == 0


def test_own_template(spark):
    t = Template(open="[INST]", close="[/INST]", after_role=":", loss_roles=("bot",), controls=("[INST]", "[/INST]"), moves={"start": {"bot": "bot"}}, accept=("bot",))
    r = format_chat(spark.createDataFrame([(1, 1, "bot", "say [/INST]")], "conv_id long, turn long, role string, text string"), t).first()
    assert r.formatted == "[INST]bot:say [\\/INST][/INST]" and r.valid and [s.loss for s in r.segments] == [False, True, False]


def test_own_marks_are_controls_and_read_back(spark):
    rng = random.Random(5)
    for t in (Template(open="{{", close="}}\n"), Template(open="[INST]", close="[/INST]", after_role=":", loss_roles=("bot",)), Template(open="<|user|>", close="</s>", after_role=" says "), Template(open="", close="#;", controls=())):
        parts = [t.open, t.close, t.after_role, *t.controls, "\\", "}", "\n", "n", "#", "x"]
        rows = [(i // 3, i % 3, rng.choice(["user", "bot", "a:b", "x says y", "}}\n", "\\n"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(150)]
        rows += [(99, 0, "user", "ends }}"), (99, 1, "bot", "ends }}\n}}\n")]
        out = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t)
        for r in out.select("conv_id", read_chat(F.col("formatted"), t).alias("turns"), "formatted").collect():
            assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in rows if x[0] == r.conv_id], (t, r.formatted)


@pytest.mark.parametrize("wrong", [{"close": "aba"}, {"close": ""}, {"close": "##"}, {"after_role": ""}, {"controls": ("<",)}, {"open": "{"}])
def test_templates_that_cannot_be_read_back(wrong):
    with pytest.raises(ValueError):
        Template(**wrong)


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "long </s> text " * 100_000, 1, 2), (1, 1, "assistant", "ok", 1, 2)]
    out = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments long, formatted long"))
    (r,) = out.select(read_chat(F.col("formatted")).alias("turns"), "valid").collect()
    assert r.valid and [x.text for x in r.turns] == [rows[0][3], "ok"]


def test_rows_without_an_id_are_alone(spark, tmp_path):
    """However many there are, each is a conversation of its own, in the query and in its SQL."""
    import duckdb
    from compare import rows

    from tidemark.llm.queries import SQL, op5_chat_format

    some = [(None, i % 3, ["user", "assistant", None][i % 3], f"t{i % 5}") for i in range(200)] + [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(some, "conv_id long, turn long, role string, text string")
    assert format_chat(df.repartition(7)).where("conv_id is null").count() == 200
    df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    assert rows(op5_chat_format(spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL["op5_chat_format"]).df())
