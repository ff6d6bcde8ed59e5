from datetime import datetime

from pyspark.sql import functions as F

from conftest import as_set
from firnlake import contracts
from firnlake.operators import lifecycle, privacy, quality
from firnlake.sources import outbox, poll
from firnlake.sources.topics import MESSAGE

KEYS = "partner_id string, key binary"


def test_encrypt_decrypt_shred(spark):
    keys = spark.createDataFrame([("a", bytes(range(32))), ("b", bytes(32))], KEYS)
    df = spark.createDataFrame([("a", "Zoë"), ("a", None), ("a", ""), ("b", "x")], "partner_id string, v string")
    enc = privacy.join_keys(df, keys, "partner_id").select(
        "partner_id", "v", privacy.encrypt(F.col("v")).alias("c")
    )
    rows = enc.collect()
    assert all(r.c.startswith("vault:v1:") for r in rows if r.v)
    assert {r.c for r in rows if not r.v} == {None, ""}
    stored = spark.createDataFrame(rows, "partner_id string, v string, c string")
    back = privacy.join_keys(stored, keys, "partner_id").select("v", privacy.decrypt(F.col("c")).alias("p"))
    assert all(r.v == r.p for r in back.collect())
    erased = spark.createDataFrame([("b",)], "partner_id string")
    left = privacy.shred(keys, erased)
    after = {(r.partner_id, r.v): r.p for r in privacy.join_keys(stored, left, "partner_id")
             .select("partner_id", "v", privacy.decrypt(F.col("c")).alias("p")).collect()}
    assert after[("b", "x")] is None and after[("a", "Zoë")] == "Zoë"


def test_decrypt_passes_plain_and_survives_garbage(spark):
    keys = spark.createDataFrame([("a", bytes(32))], KEYS)
    df = spark.createDataFrame([("a", "plain"), ("a", "vault:v1:!!!"), ("a", "vault:v1:AAAA"), ("a", None), ("z", "vault:v1:AAAA")],
                               "partner_id string, c string")
    got = [r.p for r in privacy.join_keys(df, keys, "partner_id").select(privacy.decrypt(F.col("c")).alias("p")).collect()]
    assert sorted(g for g in got if g) == ["plain"] and got.count(None) == 4


def test_wrong_key_gives_null(spark):
    one = spark.createDataFrame([("a", bytes(32))], KEYS)
    other = spark.createDataFrame([("a", bytes(range(32)))], KEYS)
    df = spark.createDataFrame([("a", "secret")], "partner_id string, v string")
    c = privacy.join_keys(df, one, "partner_id").select("partner_id", privacy.encrypt(F.col("v")).alias("c"))
    assert privacy.join_keys(c, other, "partner_id").select(privacy.decrypt(F.col("c"))).first()[0] is None


def test_new_keys_are_random_and_one_per_person(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "partner_id string")
    rows = privacy.new_keys(ids).collect()
    assert sorted(r.partner_id for r in rows) == ["a", "b"]
    assert len({bytes(r.key) for r in rows}) == 2 and all(len(r.key) == 32 for r in rows)


def test_retention(spark):
    ev = spark.createDataFrame([("a", datetime(2010, 1, 1)), ("a", datetime(2023, 1, 1)), ("b", datetime(2010, 1, 1))],
                               "personid string, event_at timestamp")
    assert [r.partner_id for r in privacy.due_for_shredding(ev, "2024-01-01").collect()] == ["b"]


def test_tags_and_mask(spark):
    df = privacy.tag_columns(spark.createDataFrame([("n", None, "VN-1")], "family_name string, first_name string, insured_number string"))
    assert privacy.tagged(df) == ["family_name", "first_name"]
    assert as_set(privacy.masked(df)) == {("***", None, "VN-1")}


def test_checks(spark):
    df = spark.createDataFrame([("1", "OPEN", "a@b.ch"), ("1", "XX", None), (None, None, "bad")], "id string, s string, m string")
    checks = [
        quality.rows(), quality.no_duplicates("id"), quality.no_missing("id"),
        quality.only_values("s", ["OPEN"]), quality.only_pattern("m", r"^\S+@\S+$", "m IS NOT NULL"),
        quality.no_duplicates("s"), quality.same_rows("o"),
    ]
    got = {r.check_name: (r.measured, r.passed) for r in quality.check_table("t", df, checks, {"o": spark.range(5)}).collect()}
    assert got == {
        "has rows": (3, True), "id unique": (1, False), "id present": (1, False), "s in list": (1, False),
        "m in form": (1, False), "s unique": (0, True), "as many rows as o": (2, False),
    }


def test_checks_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id string")
    got = {r.check_name: (r.measured, r.passed)
           for r in quality.check_table("t", df, [quality.rows(), quality.no_duplicates("id"), quality.no_missing("id")]).collect()}
    assert got == {"has rows": (0, False), "id unique": (0, True), "id present": (0, True)}


def test_contract_problems(spark):
    c = contracts.CONTRACTS["policy.v1.cancelled"]
    good = '{"eventId":"1","eventType":"PolicyCancelled","policyId":"p","policyNumber":"n","timestamp":"t"}'
    rows = [
        good, good.replace('"policyId":"p",', ""), good.replace("}", ',"zz":1,"aa":2}'),
        good.replace("PolicyCancelled", "Other"), "[]", "no json", None,
    ]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = [r[0] for r in df.select(c.problems(contracts.as_map("value"))).collect()]
    assert got == ["", "missing:policyId", "extra:aa,zz", "value:eventType", "not a JSON object", "not a JSON object",
                   "not a JSON object"]
    ok, bad = contracts.split_valid(df, c)
    assert ok.count() == 1 and bad.count() == 6


def test_every_raw_table_topic_has_a_contract():
    topics = [t for ts in contracts.RAW_TABLES.values() for t in ts]
    assert sorted(topics) == sorted(contracts.CONTRACTS)


def test_event_json_escapes(spark):
    df = spark.createDataFrame([("e", "ClaimOpened", "c", 'a "b" \\ \n', "2024-01-01T00:00:00Z")],
                               "eventid string, eventtype string, claimid string, description string, timestamp string")
    text = outbox.to_messages(df, "claims.v1.opened").first().value
    import json

    assert json.loads(text)["description"] == 'a "b" \\ \n'


def test_outbox_round_trip(spark):
    m = spark.createDataFrame([("t", "k", "{}", "E", datetime(2024, 1, 1))], MESSAGE)
    back = outbox.from_outbox(outbox.to_outbox(m, "policy"))
    assert as_set(back) == as_set(m)


def test_poll(spark):
    src = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "id int, last_modified timestamp")
    assert poll.changed_since(src, None).count() == 2
    assert [r.id for r in poll.changed_since(src, "2024-01-01 00:00:00").collect()] == [2]
    assert poll.next_mark(src) == datetime(2024, 1, 2)


def test_claim_lifecycle(spark):
    rows = [("c1", "1", "ClaimOpened", 1), ("c1", "2", "ClaimUnderReview", 2), ("c1", "3", "ClaimSettled", 3),
            ("c2", "1", "ClaimOpened", 1), ("c2", "2", "ClaimSettled", 2),
            ("c3", "1", "ClaimRejected", 1), ("c4", "1", "ClaimOpened", 1), ("c4", "2", "ClaimRejected", 40),
            ("c4", "3", "ClaimUnderReview", 41)]
    df = spark.createDataFrame([(c, e, k, datetime(2024, 1, 1 + d // 24, d % 24)) for c, e, k, d in rows],
                               "claimid string, eventid string, eventtype string, event_at timestamp")
    got = {(r.claimid, r.from_status, r.to_status) for r in lifecycle.illegal_transitions(df, "claimid", lifecycle.CLAIM).collect()}
    assert got == {("c2", "OPEN", "SETTLED"), ("c3", "NONE", "REJECTED"), ("c4", "REJECTED", "IN_REVIEW")}


def test_dunning(spark):
    df = spark.createDataFrame([("i", str(n), "DunningInitiated", datetime(2024, 1, n)) for n in range(1, 6)],
                               "invoiceid string, eventid string, eventtype string, event_at timestamp")
    got = {r.step: r.level for r in lifecycle.dunning_levels(df).collect()}
    assert got == {1: "REMINDER", 2: "FIRST_WARNING", 3: "FINAL_WARNING", 4: "COLLECTION", 5: None}


def test_freshness(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0),)], "event_at timestamp")
    got = quality.freshness({"a": t, "b": t.filter("false")}, "2024-01-01 00:00:30", {"a": 30, "b": 30})
    assert {(r.table_name, r.age_seconds, r.passed) for r in got.collect()} == {("a", 30, True), ("b", None, False)}


def test_hr_ids_are_stable(spark):
    src = spark.createDataFrame([("EMP-1", None, None)], "employee_id string, active boolean, version int").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in
               ("first_name", "last_name", "email", "job_title", "department", "org_unit_id", "entry_date", "exit_date")])
    now = F.lit("2024-01-01").cast("timestamp")
    a, b = (sorted(map(str, poll.employee_events(src, now).collect())) for _ in range(2))
    assert a == b and len(a) == 2
    state = [r for r in poll.employee_events(src, now).collect() if r.eventtype is None][0]
    assert state.active is True and state.version == 1 and state.deleted is False


def test_plain_comparison_finds_what_each_check_finds(spark):
    """Fields in another order, twice, too few or too many, values null or wrong: as judged one by one; good ones by one comparison."""
    own = {
        "a": contracts.Contract("a", ("eventId", "eventType"), event_type="A", unique=("eventId",)),
        "b": contracts.Contract("b", ("eventId",), ("n",), number_fields=("n",)),
        "c": contracts.Contract("c", ("x", "y"), values={"x": ("1",), "y": ("2",)}),
    }
    rows = [
        ("a", '{"eventId":"1","eventType":"A"}', ""), ("a", '{"eventType":"A","eventId":"1"}', ""),
        ("a", '{"eventId":"1","eventType":"B"}', "value:eventType"), ("a", '{"eventId":"1","eventType":null}', ""),
        ("a", '{"eventId":"1"}', "missing:eventType"), ("a", '{"eventId":"1","eventType":"A","z":1}', "extra:z"),
        ("a", '{"z":1,"eventType":"B"}', "missing:eventId;extra:z;value:eventType"), ("a", "[]", "not a JSON object"), ("a", None, "not a JSON object"),
        ("b", '{"eventId":"1"}', ""), ("b", '{"eventId":"1","n":2}', ""), ("b", '{"eventId":"1","n":"x"}', "type:n"), ("b", "{}", "missing:eventId"),
        ("c", '{"x":"1","y":"2"}', ""), ("c", '{"x":"1","y":"3"}', "value:y"), ("c", '{"x":"0","y":"3"}', "value:x;value:y"),
        ("d", "{}", "unknown topic"),
    ]
    df = spark.createDataFrame(rows, "topic string, value string, want string")
    checked = contracts.with_reason(df, own)
    assert [r for r in checked.collect() if r.reason != r.want] == []
    # the good ones by one comparison, before any check of its own
    assert "CASE WHEN isnull(_found" in (plan := checked._jdf.queryExecution().optimizedPlan().toString()) and "(size(_spec" in plan


def test_duplicates_carry_a_number_for_topic_and_field(spark):
    own = {
        "a": contracts.Contract("a", ("eventId",), unique=("claimId", "eventId")),
        "b": contracts.Contract("b", ("eventId",), unique=("eventId",)),
        "c": contracts.Contract("c", ("eventId",)),
    }
    rows = [
        ("a", '{"eventId":"1","claimId":"1"}'), ("a", '{"eventId":"2","claimId":"1"}'), ("a", '{"eventId":"2"}'), ("b", '{"eventId":"2"}'),
        ("b", '{"eventId":"3"}'), ("b", '{"eventId":"3"}'), ("b", '{"eventId":"3"}'), ("b", '{"claimId":"3"}'), ("b", None), ("b", "{"),
        ("c", '{"eventId":"9"}'), ("c", '{"eventId":"9"}'), ("d", '{"eventId":"9"}'), (None, '{"eventId":"9"}'), (None, '{"eventId":"9"}'),
    ]
    found = contracts.duplicates(spark.createDataFrame(rows, "topic string, value string"), own)
    assert found.columns == ["topic", "field", "key", "n"]
    assert {tuple(r) for r in found.collect()} == {("a", "claimId", "1", 2), ("a", "eventId", "2", 2), ("b", "eventId", "3", 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slot" in plan and "hashpartitioning(topic" not in plan
