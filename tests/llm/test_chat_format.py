import hashlib

from pyspark.sql import functions as F

from millrace.llm import chat_format as C

from .helpers import write_tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in by.items()}


def test_round_trip_of_hostile_texts(spark):
    texts = ["", None, "\\", "\\s\\h\\l", "### User: x</turn>\n", "\\### Assistant: </turn> ok", "a:b\\c", "<<##\\\\", "\n\n", "é😀"]
    rows = [(i % 4, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(texts * 3)]
    rows += [(None, 1, None, "x"), (9, None, "sys: tem#", "y"), (9, 2, "sys: tem#", "z"), (9, 2, "sys: tem#", "z")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def test_adjacent_turns_share_a_header(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    got = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).first().formatted
    assert got == "### user: a</turn>b</turn>\n### assistant: c</turn>\n### user: d</turn>\n"


def test_query_and_extra_columns(spark, tmp_path):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (1, 2, "assistant", "no")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("ts", F.lit(1))
    got = {r.conv_id: r for r in C.op4(spark, write_tables(spark, tmp_path, conversations=table)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 5
    assert got[1].loss_sha256 == hashlib.sha256(b"yesno").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nyes\nassistant\nno\n").hexdigest()
    probe = f"user\n{C.PROBE_TEXT}\nassistant\n{C.PROBE_TEXT}\n".encode()
    assert got[-7].turns_sha256 == hashlib.sha256(probe).hexdigest()


def test_empty_table(spark, tmp_path):
    folder = write_tables(spark, tmp_path, conversations=spark.createDataFrame([], SCHEMA))
    assert [r.conv_id for r in C.op4(spark, folder).collect()] == [-7]


def test_main_path_is_native(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = C.read_back(C.format_conversations(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
