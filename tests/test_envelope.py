"""Edge rows of message decoding."""

import json

import pytest

from rowtide.operators import envelope

USER = {"record": '{"id":1,"name":"John"}', "metadata": '{"table_name":"users","database_name":"app"}', "action": "update"}


def message(**changed):
    fields = {**USER, **changed}
    return json.dumps({k: v for k, v in fields.items() if v is not ...})


MESSAGES = [
    (message(), None),
    (message(changes='{"name":"Jane"}'), None),
    (message(changes=None), None),
    (message(changes="oops"), None),
    (message(changes={"a": 1}), "bad_changes"),
    (message(changes=5), "bad_changes"),
    (message(extra=[1, 2]), None),
    (message(record=...), "missing_record"),
    (message(metadata=...), "missing_metadata"),
    (message(action=...), "missing_action"),
    (message(record={"id": 1}), "bad_record"),
    (message(record=None), "bad_record"),
    (message(metadata=5), "bad_metadata"),
    (message(action=True), "bad_action"),
    (message(id="1b4e28ba-2fa1-11d2-883f-0016d3cca427"), None),
    (message(id="1B4E28BA2FA111D2883F0016D3CCA427"), None),
    (message(id="urn:uuid:1b4e28ba-2fa1-11d2-883f-0016d3cca427"), None),
    (message(id="{1b4e28ba-2fa1-11d2-883f-0016d3cca427}"), None),
    (message(id=None), "bad_id"),
    (message(id="17"), "bad_id"),
    (message(id=17), "bad_id"),
    (message(timestamp="2024-01-02T03:04:05Z"), None),
    (message(timestamp="2024-01-02T03:04:05.25+02:00"), None),
    (message(timestamp=None), "bad_timestamp"),
    (message(timestamp="yesterday"), "bad_timestamp"),
    (message(timestamp="2024-13-02T03:04:05Z"), "bad_timestamp"),
    (message(timestamp="2024-01-02"), "bad_timestamp"),
    ("", "not_an_object"),
    ("5", "not_an_object"),
    ("null", "not_an_object"),
    ("[1]", "not_an_object"),
    ("{}", "missing_record"),
    (message() + " tail", "not_an_object"),
    (message() + message(), "not_an_object"),
    (message() + "," + message(), "not_an_object"),
    (message()[:-1], "not_an_object"),
    (message().replace('"', "'"), "not_an_object"),
    (message()[:-1] + ',"action":"delete"}', "duplicate_field"),
    (message()[:-1] + ',"x":1,"x":2}', None),
    ("  " + message() + "\n", None),
    # the sample message of the public documentation lacks record and action
    ('{"operation":"insert","table":"users","data":{"id":1},"metadata":{}}', "missing_record"),
]


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(i, text) for i, (text, _) in enumerate(MESSAGES)]
    return envelope.decode_envelope(spark.createDataFrame(rows, "seq bigint, value string")).cache()


def test_reject_reasons(decoded):
    got = {r.seq: r.reject_reason for r in decoded.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(MESSAGES)}


def test_rejects_keep_text_and_good_rows_go_on(decoded):
    good, rejects = envelope.split_rejects(decoded)
    assert good.count() + rejects.count() == len(MESSAGES)
    for row in rejects.collect():
        assert row.payload == MESSAGES[row.seq][0]
        assert row.error.endswith(row.payload)
    counts = {r.reason: r.n for r in envelope.reject_counts(rejects).collect()}
    assert counts["bad_id"] == 3 and counts["duplicate_field"] == 1


def test_id_and_time(decoded):
    rows = {r.seq: r for r in decoded.collect()}
    same = "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
    by_text = {text: rows[i] for i, (text, _) in enumerate(MESSAGES)}
    for given in ("1B4E28BA2FA111D2883F0016D3CCA427", f"urn:uuid:{same}", f"{{{same}}}", same):
        assert by_text[message(id=given)].id == same
    assert by_text[message(timestamp="2024-01-02T03:04:05.25+02:00")].timestamp.isoformat().endswith("01:04:05.250000")
    assert by_text[message()].timestamp is not None
    again = {r.seq: r.id for r in decoded.select("seq", "id").collect()}
    assert rows.keys() == again.keys()
    for s, row in rows.items():
        assert row.id == again[s]
        assert row.reject_reason is not None or len(row.id) == 36


def test_binary_values(spark):
    rows = [(0, message().encode()), (1, b"\xff" + message().encode()), (2, None)]
    out = envelope.decode_envelope(spark.createDataFrame(rows, "seq bigint, value binary")).collect()
    reasons = {r.seq: r.reject_reason for r in out}
    assert reasons == {0: None, 1: "invalid_utf8", 2: "not_an_object"}
    assert next(r for r in out if r.seq == 1).payload.startswith("�")


def test_entries(spark):
    full = {k: bytearray(v.encode()) for k, v in USER.items()}
    broken = bytearray(b"\xff\xfe")
    rows = [
        (0, "1-0", full),
        (1, "1-1", {**full, "changes": bytearray(b"{}")}),
        (2, "1-2", {**full, "changes": broken}),
        (3, "1-3", {**full, "metadata": broken}),
        (4, "1-4", {"action": full["action"]}),
        (5, "1-5", {k: v for k, v in full.items() if k != "action"}),
    ]
    out = {
        r.seq: r
        for r in envelope.decode_entries(
            spark.createDataFrame(rows, "seq bigint, entry_id string, fields map<string,binary>")
        ).collect()
    }
    assert [out[i].reject_reason for i in range(6)] == [
        None, None, None, "missing_metadata", "missing_record", "missing_action",
    ]
    assert out[1].changes == "{}" and out[2].changes is None
    assert len({r.id for r in out.values()}) == 6


def test_route_and_operation(spark):
    def row(seq, action="insert", metadata='{"table_name":"t"}', record="{}", changes=None):
        return (seq, "x", record, metadata, action, changes)

    rows = [
        row(0, "INSERT"),
        row(1, "Update"),
        row(2, " delete"),
        row(3, ""),
        row(4, "truncate"),
        row(5, "DELETE", metadata='{"table_name":5}'),
        row(6, metadata='{"table_name":null}'),
        row(7, metadata='{"table_name":""}'),
        row(8, metadata="[1]"),
        row(9, metadata='{"database_name":"d"}'),
        row(10, metadata='{"table_name":"a","table_name":"b"}'),
    ]
    df = spark.createDataFrame(rows, "seq bigint, id string, record string, metadata string, action string, changes string")
    out = {r.seq: (r.op, r.table_name, r.database_name) for r in envelope.with_route(df).collect()}
    assert out == {
        0: ("insert", "t", None),
        1: ("update", "t", None),
        2: ("snapshot", "t", None),
        3: ("snapshot", "t", None),
        4: ("snapshot", "t", None),
        5: ("delete", None, None),
        6: ("insert", None, None),
        7: ("insert", "", None),
        8: ("insert", None, None),
        9: ("insert", None, "d"),
        10: ("insert", "b", None),
    }


def test_payload_and_key(spark):
    def row(seq, record, action="insert", changes=None):
        return (seq, record, '{"table_name":"t"}', action, changes)

    rows = [
        row(0, '{"id":5,"a":1}'),
        row(1, '{"id":"5","a":null}'),
        row(2, '{"Id":5}', "delete"),
        row(3, '{"ID":5}', "delete"),
        row(4, '{"iD":5}'),
        row(5, '{"id":1,"a":1}', "update", '{"a":2,"b":3}'),
        row(6, '{"id":1,"a":1}', "update", "oops"),
        row(7, '{"id":1,"a":1}', "insert", '{"a":2}'),
        row(8, "[1]"),
        row(9, '{"a":1}'),
        row(10, '{"id":null}'),
        row(11, '{"id":"1B4E28BA-2FA1-11D2-883F-0016D3CCA427"}'),
        row(12, '{"a":1,"a":2,"id":1}'),
        row(13, '{"Id":2,"id":1}'),
        row(14, '{"id":1,"a":1}', "update", '{"a":null}'),
    ]
    df = spark.createDataFrame(rows, "seq bigint, record string, metadata string, action string, changes string")
    out = {r.seq: r for r in envelope.change_rows(df).collect()}
    assert out[0].pk == out[1].pk == out[2].pk == out[4].pk == "5"
    assert out[1].payload == {"id": "5", "a": None}
    assert out[3].pk is None and out[3].key_name is None
    assert out[4].key_name == "iD"
    assert out[5].payload == {"id": "1", "a": "2", "b": "3"}
    assert out[6].payload == {"id": "1", "a": "1"} and not out[6].changes_ok
    assert out[7].payload == {"id": "1", "a": "1"} and out[7].changes_ok
    assert out[8].payload is None and out[8].pk is None
    assert out[9].key_name is None
    assert out[10].key_name == "id" and out[10].pk is None
    assert out[11].pk == "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
    assert out[12].payload == {"a": "2", "id": "1"}
    assert out[13].key_name == "id" and out[13].pk == "1"
    assert out[14].payload == {"id": "1", "a": None}
