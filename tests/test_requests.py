import json

import pytest

from loglantern.operators import requests as r
from loglantern.params import RequestParams

GOOD = '{"title": "T\\nx", "summary": "S", "notify": true}'


def test_verdicts(spark):
    cases = {
        GOOD: ("T / x", "S", True), f"```json\n{GOOD}\n```": ("T / x", "S", True), f"```\n{GOOD}\n ``` ": ("T / x", "S", True),
        f"Sure: {GOOD} ok?": ("T / x", "S", True), '{"title": "a", "notify": false, "summary": null}': ("a", "", False),
        '{"title": "' + "x" * 300 + '", "notify": false}': ("x" * 200, "", False), '{"title": 5, "notify": true, "summary": 7}': ("5", "7", True),
        '{"title": true, "notify": true, "summary": false}': ("True", "False", True),
        "no object": None, "[" + GOOD + "]": None, '"{}"': None, "5": None, '{"title": "a"}': None, '{"title": "a", "notify": "true"}': None,
        '{"title": "a", "notify": 1}': None, '{"title": " ", "notify": true}': None, '{"title": null, "notify": true}': None,
        '{"notify": true}': None, '{"title": 0, "notify": true}': None, "{broken}": None, "": None, "} {": None, '{"title": "a", "notify": null}': None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, reply string")
    for row in r.parse_verdict(df).collect():
        want = cases[row["reply"]]
        assert (row["error"] is None) == (want is not None), row
        assert (row["title"], row["summary"], row["notify"]) == (want or (None, None, None)), row["reply"]


ROW = dict(
    host="h", open_seq=1, pattern="*p*", matched_line="the line", path="/c/x.log", always_notify=False, always_notify_line=None,
    verdict_title="VT", verdict_summary="VS", verdict_notify=False, verdict_error=None, post_failed=False, excerpt="E",
)
SCHEMA = (
    "host string, open_seq bigint, pattern string, matched_line string, path string, always_notify boolean, always_notify_line string, "
    "verdict_title string, verdict_summary string, verdict_notify boolean, verdict_error string, post_failed boolean, excerpt string"
)
PLAIN = "h: *p*"


@pytest.mark.parametrize("params,change,want", [
    (RequestParams(), {}, (True, PLAIN, "the line", False, True)),
    (RequestParams(notify=False), {}, (True, PLAIN, "the line", False, False)),
    (RequestParams(model=True), {}, (False, "VT", "VS", True, False)),
    (RequestParams(model=True), {"verdict_notify": True, "verdict_summary": ""}, (True, "VT", "the line", True, True)),
    (RequestParams(model=True), {"path": None}, (True, PLAIN, "the line", False, True)),
    (RequestParams(model=True), {"verdict_error": "x"}, (True, PLAIN, "the line", True, True)),
    (RequestParams(model=True), {"always_notify": True, "always_notify_line": "AL"}, (True, PLAIN, "AL\nModel summary: VS", True, True)),
    (RequestParams(model=True), {"always_notify": True, "always_notify_line": "AL", "verdict_summary": ""}, (True, PLAIN, "AL", True, True)),
    (RequestParams(model=True), {"always_notify": True, "always_notify_line": "AL", "verdict_error": "x"}, (True, PLAIN, "the line", True, True)),
    (RequestParams(events=True, model=True), {}, (False, PLAIN, "the line", False, False)),
    (RequestParams(events=True), {"post_failed": True}, (False, PLAIN, "the line", False, False)),
    (RequestParams(events=True), {"always_notify": True, "always_notify_line": "AL"}, (True, PLAIN, "AL", False, False)),
    (RequestParams(events=True), {"always_notify": True, "always_notify_line": "AL", "post_failed": True}, (True, PLAIN, "AL", False, True)),
])
def test_routing(spark, params, change, want):
    df = spark.createDataFrame([tuple({**ROW, **change}.values())], SCHEMA)
    got = r.route_capture(df, params).first()
    assert (got["push"], got["title"], got["body_text"], got["model_called"], got["to_phone"]) == want


def test_payloads(spark):
    rows = [ROW, {**ROW, "open_seq": 2, "path": None}]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    routed = r.route_capture(df, RequestParams(events=True))
    events = [json.loads(x["event"]) for x in r.event_payload(routed, RequestParams(events=True), "now").orderBy("open_seq").collect()]
    assert list(events[0]) == ["source", "version", "host", "pattern", "title", "body", "push", "always_notify", "excerpt", "path", "time"]
    assert events[0]["body"] == "the line\n/c/x.log" and events[0]["excerpt"] == "E" and events[0]["time"] == "now"
    assert events[1]["path"] is None and events[1]["excerpt"] == "" and events[1]["body"].endswith(r.NOT_SAVED)
    requests = r.model_request(df, RequestParams(model=True, notes=" two\n lines "), "salt").collect()
    assert len(requests) == 1
    sent = json.loads(requests[0]["request"])
    user = sent["messages"][1]["content"]
    token = user.split("BEGIN ")[1].split(" ")[0]
    assert sent["temperature"] == 0 and "Notes from the operator: two lines\n" in user and user.count(token) == 4
    again = json.loads(r.model_request(df, RequestParams(model=True), "other").first()["request"])["messages"][1]["content"]
    assert token not in again
    pushes = r.push_request(r.route_capture(df, RequestParams(priority=5)), RequestParams(priority=5)).collect()
    assert [(p["title"], p["priority"]) for p in pushes] == [(PLAIN, 5)] * 2
