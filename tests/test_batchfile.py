from distillery.operators import batchfile as B

LINES = [
    "",                                                        # empty: dropped
    "{bad",                                                    # malformed: dropped
    "5",                                                       # not an object: dropped
    '{"custom_id":"request-0","response":null,"error":null}',  # null response, no error
    '{"custom_id":"request-1","response":{"body":{"choices":[]}},"error":{}}',
    '{"custom_id":"request-2","response":{"body":{"choices":[{"message":{"content":null}}]}},"error":null}',
    '{"response":{"body":{"choices":[{"message":{"content":"hi"}}]}}}',   # missing id
    '{"custom_id":"request-3","response":null,"error":{"code":"x"}}',
    '{"custom_id":"request-4","response":{"body":{"choices":[{"message":{"content":"é ok"}}]}},"error":false}',
]


def test_response_ladder(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value STRING")
    reqs = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "row_idx BIGINT, instruction STRING")
    out = B.attach_instructions(B.parse_responses(lines), B.build_requests(reqs)).collect()
    got = {r.custom_id: (r.instruction, r.output, r.status) for r in out}
    assert len(out) == 6
    assert got["request-0"] == ("q0", "[No content]", "no_content")
    assert got["request-1"] == ("q1", "[No content]", "no_content")
    assert got["request-2"] == ("q2", None, "ok")
    assert got[""] == ("[Batch custom_id=]", "hi", "unknown_id")
    assert got["request-3"] == ("q3", '[ERROR] => {"code":"x"}', "error")
    assert got["request-4"] == ("q4", "é ok", "ok")


def test_request_json(spark):
    import json

    reqs = spark.createDataFrame([(7, "naïve \"q\"")], "row_idx BIGINT, instruction STRING")
    line = B.build_requests(reqs).first().request
    obj = json.loads(line)
    assert obj == {"custom_id": "request-7", "method": "POST", "url": "/v1/chat/completions",
                   "body": {"model": "gpt-3.5-turbo",
                            "messages": [{"role": "developer", "content": "You are a Python Developer."},
                                         {"role": "user", "content": "naïve \"q\""}],
                            "temperature": 0.7, "top_p": 0.9}}


def test_status_counts_at_sf001(spark):
    from tests.conftest import SF_MID

    import __spark_entry__ as E

    got = {r.status: r.n for r in E.queries()["batch_status"](spark, SF_MID).collect()}
    assert got == {"ok": 159, "error": 30, "no_content": 16, "unknown_id": 10}


def test_request_escapes_non_ascii(spark):
    reqs = spark.createDataFrame([(1, "café 中")], "row_idx BIGINT, instruction STRING")
    line = B.build_requests(reqs).first().request
    assert "caf\\u00E9" in line or "caf\\u00e9" in line
    assert all(ord(ch) < 128 for ch in line)
