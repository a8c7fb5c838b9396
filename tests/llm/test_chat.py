import hashlib

from pyspark.sql import functions as F

from quillrow.llm import chat

ODD = ["", "</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<s><s>", "a <s", "s>", "[ROLE] x [/ROLE]", "\\", "$1 \\2", "line\nline", "🙂[/SYS]"]


def test_reads_back_what_was_said(spark):
    roles = ["user", "assistant", "system", "tool", "", None, "</s>", "a [/ROLE]"]
    rows = [(c, t, roles[(c + t) % len(roles)], None if (c * t) % 7 == 6 else ODD[(c * 5 + t) % len(ODD)]) for c in range(20) for t in range(9)]
    rows += [(50, None, "user", "first"), (50, 1, "user", "same"), (50, 1, "user", "same"), (None, 0, "assistant", "no id"), (60, 3, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"size": F.lit(1), "formatted": F.lit("x"), "place": F.lit(2)})
    chats = chat.format_chats(df)
    found = chats.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in found} == expected
    for r in found:
        assert r["loss"] == "".join(text for role, text in expected[r["conv_id"]] if role == "assistant")
        assert all(0 <= a <= b <= len(r["formatted"]) for a, b in r["loss_spans"])


def test_layouts_are_recognised(spark):
    messages = "array<struct<role:string,content:string>>"
    shares = "array<struct<from:string,value:string>>"
    frames = [
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], f"conv_id long, messages {messages}"),
        spark.createDataFrame([(2, [("human", "q"), ("gpt", "a")])], f"conv_id long, conversations {shares}"),
        spark.createDataFrame([(3, "q", "a", None)], "conv_id long, prompt string, completion string, system string"),
        spark.createDataFrame([(4, "q", "a")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(5, "q", "i", "a"), (6, "q", None, "a")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(7, ("q", "a"))], "conv_id long, qa struct<question:string,answer:string>"),
        spark.createDataFrame([(8, 0, "user", "q"), (8, 1, "assistant", "a")], "conv_id long, turn long, role string, text string"),
        spark.createDataFrame([(9, "q", "a", "be brief")], "conv_id long, prompt string, completion string, system string"),
        spark.createDataFrame([(10, "q", "zzz")], "conv_id long, prompt string, instruction string"),
    ]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    found = {r["conv_id"]: r for r in chat.format_chats(df.withColumn("unknown", F.lit(1))).collect()}
    user, plain = "<s>[INST] q [/INST]</s>", "<s>a</s>"
    assert {k: found[k]["formatted"] for k in (1, 2, 3, 4, 6, 7, 8)} == dict.fromkeys((1, 2, 3, 4, 6, 7, 8), user + plain)
    assert found[5]["formatted"] == "<s>[INST] q\n\ni [/INST]</s>" + plain and found[9]["formatted"].startswith("<s>[SYS] be brief [/SYS]</s>")
    assert 10 not in found and found[7]["layouts"] == ["question and answer"]


def test_lists_beside_other_columns(spark):
    messages, shares = "array<struct<role:string,content:string>>", "array<struct<from:string,value:string>>"
    said = [("user", "q"), ("assistant", "a")]
    rows = [(1, said, None, "be brief", None), (2, None, said, "be brief", None), (3, said, None, None, None), (4, said, None, None, "p"), (5, None, said, "s", "p")]
    df = spark.createDataFrame(rows, f"conv_id long, messages {messages}, conversations {shares}, system string, prompt string")
    found = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    plain = "<s>[INST] q [/INST]</s><s>a</s>"
    assert found[1] == found[2] == "<s>[SYS] be brief [/SYS]</s>" + plain and found[3] == plain
    lost = chat.unrecognised(df).collect()
    assert {r["conv_id"] for r in lost} == {4, 5} - set(found) and len({r["fingerprint"] for r in lost}) == len(lost) == 2


def test_nested_paths(spark):
    """Presence is that of the nested value, not of the struct around it."""
    rows = [(1, ("q", "a")), (2, ("q", None)), (3, (None, "a")), (4, None)]
    df = spark.createDataFrame(rows, "conv_id long, qa struct<question:string,answer:string>")
    found = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df.filter("conv_id < 4")).collect()}
    assert found == {1: "<s>[INST] q [/INST]</s><s>a</s>", 2: "<s>[INST] q [/INST]</s>"}
    assert [r["conv_id"] for r in chat.unrecognised(df.filter("conv_id < 4")).collect()] == [3]


def test_query_plants_its_conversation(spark, tmp_path):
    spark.createDataFrame([(0, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r for r in chat.op2_chat_formatting(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert found[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert found[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[0]["loss_chars"] == 0
