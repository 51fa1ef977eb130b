from pyspark.sql import functions as F

from distillery.functions.text import chat_messages, render_messages, teacher_prompt
from distillery.operators.chat import conversation_messages, render_turn_lines
from tests.conftest import SF_SMALL


def test_turn_lines_join_to_rendered_conversation(spark):
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    grouped = {r.conv_id: r.t for r in conversation_messages(turns)
               .select("conv_id", render_messages("messages").alias("t")).collect()}
    lines = render_turn_lines(turns).select("conv_id", "turn", "line").collect()
    by_conv = {}
    for r in sorted(lines, key=lambda r: (r.conv_id, r.turn)):
        by_conv.setdefault(r.conv_id, []).append(r.line)
    assert {k: "\n".join(v) for k, v in by_conv.items()} == grouped


def test_two_message_render_equals_teacher_prompt(spark):
    df = spark.createDataFrame([("Tell me a joke.",)], "instruction STRING")
    r = df.select(render_messages(chat_messages("instruction"), generation_prompt=True).alias("a"),
                  teacher_prompt("instruction").alias("b")).first()
    assert r.a == r.b
    assert F is not None
