import json
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from firnlake.contracts import CONTRACTS
from firnlake.sources.lake import ChangeLog
from firnlake.sources.outbox import write_topics
from firnlake.sources.topics import MESSAGE, parse, raw_table, stream_messages
from firnlake.streaming import reactions, read_models, run

T0 = datetime(2024, 1, 1)


def messages(spark, rows):
    """(topic, key, body or text[, minutes]) → message rows, one minute apart unless told."""
    out = []
    for i, (topic, key, body, *at) in enumerate(rows):
        text = body if isinstance(body, str) else json.dumps(body)
        out.append((topic, key, text, None, T0 + timedelta(minutes=at[0] if at else i)))
    return spark.createDataFrame(out, MESSAGE)


def deliver(spark, tmp_path, parts, start):
    """Write the parts one after the other; ``start`` runs the stream after each."""
    source = str(tmp_path / "topics")
    for part in parts:
        write_topics(part.coalesce(1), source)
        started = start(stream_messages(spark, source))
        run.finish(started if isinstance(started, list) else [started])


def chunks(rows, n):
    size = -(-len(rows) // n)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


PERSONS = [
    ("person.v1.created", "1", {"personId": "p-123", "firstName": "Hans", "name": "Muster"}),
    ("person.v1.created", "2", {"firstName": "No", "name": "Id"}),
    ("person.v1.created", "3", {"personId": "p-3"}),
    ("person.v1.created", "4", "not json"),
    ("person.v1.created", "5", {"personId": "p-5", "name": "Solo", "insuredNumber": None}),
    ("person.v1.updated", "1", {"personId": "p-123", "firstName": "Hans", "name": "Neu", "insuredNumber": "VN-00000001"}),
    ("person.v1.deleted", "5", {"personId": "p-5"}),
]


@pytest.mark.parametrize("n", [1, 3, 7])
def test_partner_view_does_not_depend_on_batches(spark, tmp_path, n):
    home = str(tmp_path / "home")
    deliver(spark, tmp_path, [messages(spark, [(*r, PERSONS.index(r)) for r in c]) for c in chunks(PERSONS, n)],
            lambda s: read_models.maintain(s, read_models.PARTNER, home, once=True, condense_every=2))
    view = read_models.current(spark, read_models.PARTNER, home)
    assert as_set(view) == {("p-123", "Hans Neu", "VN-00000001"), ("p-5", "Solo", None)}
    rejected = {(r.key, r.reason) for r in read_models.rejected(spark, home).collect()}
    assert rejected == {("2", "personId is missing"), ("3", "name is missing"), ("4", "personId is missing")}


def test_product_view(spark, tmp_path):
    rows = [
        ("product.v1.deprecated", "c", {"productId": "c"}),
        ("product.v1.defined", "a", {"productId": "a", "name": "A", "productLine": "TRAVEL", "basePremium": 10.5}),
        ("product.v1.defined", "b", {"productId": "b", "name": "B"}),
        ("product.v1.updated", "a", {"productId": "a", "name": "A2", "productLine": "TRAVEL", "basePremium": "11"}),
        ("product.v1.deprecated", "b", {"productId": "b"}),
        ("product.v1.defined", "c", {"productId": "c", "name": "C"}),
        ("product.v1.defined", "d", {"productId": "d"}),
        ("product.v1.deprecated", "e", {"productId": "unknown"}),
    ]
    home = str(tmp_path / "home")
    deliver(spark, tmp_path, [messages(spark, rows)], lambda s: read_models.maintain(s, read_models.PRODUCT, home, once=True))
    got = {(r.product_id, r.name, r.product_line, str(r.base_premium), r.active)
           for r in read_models.current(spark, read_models.PRODUCT, home).collect()}
    assert got == {("a", "A2", "TRAVEL", "11.00", True), ("b", "B", "UNKNOWN", "0.00", False),
                   ("c", "C", "UNKNOWN", "0.00", True)}
    assert [r.key for r in read_models.rejected(spark, home).collect()] == ["d"]


def test_policyholder_view_skips_and_falls_back(spark, tmp_path):
    rows = [
        ("person.v1.state", "1", {"personId": "1", "firstName": "A", "name": "B", "deleted": False}),
        ("person.v1.state", "2", {"personId": "2", "deleted": False}),
        ("person.v1.state", "1", {"personId": "1", "deleted": True}),
        ("person.v1.state", "3", {"personId": " "}),
        ("person.v1.state", "4", "broken"),
    ]
    home = str(tmp_path / "home")
    deliver(spark, tmp_path, [messages(spark, rows)], lambda s: read_models.maintain(s, read_models.POLICYHOLDER, home, once=True))
    assert as_set(read_models.current(spark, read_models.POLICYHOLDER, home)) == {("1", "A B", None), ("2", "2", None)}
    assert read_models.rejected(spark, home).count() == 0


def test_search_view_tombstone_and_unreadable(spark, tmp_path):
    from firnlake.operators.privacy import encrypt, join_keys

    keys = spark.createDataFrame([("1", bytes(range(32))), ("2", bytes(32))], "partner_id string, key binary")
    enc = {
        r.partner_id: r.c
        for r in join_keys(keys.select("partner_id"), keys, "partner_id")
        .select("partner_id", encrypt(F.lit("Muster")).alias("c")).collect()
    }
    body = lambda p, **kw: {"personId": p, "deleted": False, "encrypted": True, **kw}
    rows = [
        ("person.v1.state", "1", body("1", name=enc["1"], firstName=enc["1"])),
        ("person.v1.state", "2", body("2", name=enc["2"], firstName=enc["2"])),
        ("person.v1.state", "3", body("3", name=enc["1"], firstName=enc["1"])),
        ("person.v1.state", "2", {"personId": "2", "deleted": True}),
        ("person.v1.state", "4", {"personId": "4", "name": "Plain", "firstName": "P", "dateOfBirth": "1980-02-03"}),
    ]
    home, model = str(tmp_path / "home"), read_models.search_model(keys)
    deliver(spark, tmp_path, [messages(spark, rows[:3]), messages(spark, [(*r, 60) for r in rows[3:]])],
            lambda s: read_models.maintain(s, model, home, once=True))
    view = {(r.partner_id, r.last_name, str(r.date_of_birth)) for r in read_models.current(spark, model, home).collect()}
    assert view == {("1", "Muster", "None"), ("4", "Plain", "1980-02-03")}
    assert [r.key for r in read_models.rejected(spark, home).collect()] == ["3"]


@pytest.mark.parametrize("field", ["name", "firstName", "dateOfBirth", "socialSecurityNumber"])
def test_search_view_rejects_a_sealed_field(spark, tmp_path, field):
    """Each of the four encrypted fields that cannot be read rejects its message."""
    keys = spark.createDataFrame([("1", bytes(range(32)))], "partner_id string, key binary")
    clear = {"name": "Muster", "firstName": "A", "dateOfBirth": "1980-02-03", "socialSecurityNumber": "756.1"}
    rows = [("person.v1.state", "1", {"personId": "1", "deleted": False, "encrypted": True, **clear, field: "vault:v1:AAAA"})]
    home, model = str(tmp_path / "home"), read_models.search_model(keys)
    deliver(spark, tmp_path, [messages(spark, rows)], lambda s: read_models.maintain(s, model, home, once=True))
    assert read_models.current(spark, model, home).isEmpty()
    assert [(r.key, r.reason) for r in read_models.rejected(spark, home).collect()] == [("1", "cannot decrypt")]


def issued(policy, partner="x", premium="100.00"):
    return {"policyId": policy, "policyNumber": f"POL-{policy}", "partnerId": partner, "premium": premium,
            "productId": "pr", "coverageStartDate": "2024-02-01"}


def test_snapshot_skips_thin_messages(spark, tmp_path):
    rows = [
        ("policy.v1.issued", "1", issued("1")),
        ("policy.v1.issued", "2", {"policyId": "2"}),
        ("policy.v1.issued", "3", issued("3", premium="abc")),
    ]
    home = str(tmp_path / "home")
    deliver(spark, tmp_path, [messages(spark, rows)], lambda s: read_models.maintain(s, read_models.SNAPSHOT, home, once=True))
    assert [r.policy_id for r in read_models.current(spark, read_models.SNAPSHOT, home).collect()] == ["1"]
    assert [r.reason for r in read_models.rejected(spark, home).collect()] == ["premium is not a number"]


def test_invoices_once_and_cancelled(spark, tmp_path):
    rows = [
        ("policy.v1.issued", "1", issued("1")),
        ("policy.v1.issued", "2", issued("2", premium="55.55")),
        ("policy.v1.issued", "1", issued("1", premium="999.00")),
        ("policy.v1.issued", "3", {"policyId": "3"}),
        ("policy.v1.cancelled", "2", {"policyId": "2"}),
        ("policy.v1.issued", "2", issued("2")),
        ("policy.v1.cancelled", "9", {"policyId": "9"}),
        ("policy.v1.cancelled", "?", {}),
    ]
    expected = {("1", "100.00", "OPEN"), ("2", "55.55", "CANCELLED")}
    for n in (1, 3, 8):
        where = tmp_path / str(n)
        home = str(where / "home")
        deliver(spark, where, [messages(spark, [(*r, rows.index(r)) for r in c]) for c in chunks(rows, n)],
                lambda s: reactions.bill_policies(s, home, once=True))
        got = {(r.policy_id, str(r.total_amount_chf), r.status) for r in reactions.invoices(spark, home).collect()}
        assert got == expected
        assert {r.key for r in read_models.rejected(spark, home).collect()} == {"3", "?"}


def redeliver(home):
    """Forget that the last batch was finished, as if the job had died before saying so."""
    commits = os.path.join(home, "checkpoint", "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))


def test_billing_reads_no_history(spark, tmp_path):
    """What was billed before is known from the keyed state: a batch neither reads nor needs the log."""
    home = str(tmp_path / "home")
    start = lambda s: reactions.bill_policies(s, home, once=True)
    rows = [("policy.v1.issued", str(i), issued(str(i)), 0) for i in range(40)]
    deliver(spark, tmp_path, [messages(spark, rows)], start)
    log = ChangeLog(spark, f"{home}/log", reactions.INVOICE_LOG)
    before = as_set(log.read())
    for n in sorted(os.listdir(f"{home}/log")):
        shutil.copytree(f"{home}/log/{n}", str(tmp_path / "kept" / n))
        shutil.rmtree(f"{home}/log/{n}")
    repeats = [("policy.v1.issued", "1", issued("1", premium="9.00"), 5), ("policy.v1.cancelled", "2", {"policyId": "2"}, 6),
               ("policy.v1.issued", "new", issued("new"), 7)]
    deliver(spark, tmp_path, [messages(spark, repeats)], start)
    got = {(r.policy_id, str(r.total_amount_chf), r.status) for r in log.read().collect()}
    assert got == {("1", "100.00", "OPEN"), ("2", "100.00", "CANCELLED"), ("new", "100.00", "OPEN")}
    assert len(before) == 40


def test_redelivered_billing_batch_changes_nothing(spark, tmp_path):
    home = str(tmp_path / "home")
    start = lambda s: reactions.bill_policies(s, home, once=True)
    parts = [[("policy.v1.issued", "1", issued("1"), 0), ("policy.v1.issued", "2", issued("2"), 1)],
             [("policy.v1.cancelled", "2", {"policyId": "2"}, 5), ("policy.v1.issued", "3", issued("3"), 6)]]
    deliver(spark, tmp_path, [messages(spark, p) for p in parts], start)
    want = as_set(ChangeLog(spark, f"{home}/log", reactions.INVOICE_LOG).read())
    redeliver(home)
    run.finish(start(stream_messages(spark, str(tmp_path / "topics"))))
    assert as_set(ChangeLog(spark, f"{home}/log", reactions.INVOICE_LOG).read()) == want
    assert {r.policy_id: r.status for r in reactions.invoices(spark, home).collect()} == {"1": "OPEN", "2": "CANCELLED", "3": "OPEN"}


def test_cancellation_before_the_issue_changes_nothing(spark, tmp_path):
    rows = [("policy.v1.cancelled", "1", {"policyId": "1"}, 0), ("policy.v1.issued", "1", issued("1"), 3)]
    for n in (1, 2):
        where = tmp_path / str(n)
        deliver(spark, where, [messages(spark, c) for c in chunks(rows, n)], lambda s: reactions.bill_policies(s, str(where / "home"), once=True))
        assert [r.status for r in reactions.invoices(spark, str(where / "home")).collect()] == ["OPEN"]


def test_numbers_continue_over_batches_and_redelivery(spark, tmp_path):
    people = spark.createDataFrame([(p, None) for p in "abcd"] + [("e", "VN-00000009")], "partner_id string, insured_number string")
    home = str(tmp_path / "home")
    start = lambda s: reactions.assign_numbers(s, people, home, once=True)
    deliver(spark, tmp_path, [
        messages(spark, [("policy.v1.issued", "1", issued("1", "b")), ("policy.v1.issued", "2", issued("2", "a")),
                         ("policy.v1.issued", "6", issued("6", "e")), ("policy.v1.issued", "7", issued("7", "nobody"))]),
        messages(spark, [("policy.v1.issued", "3", issued("3", "b")), ("policy.v1.issued", "4", issued("4", "d")),
                         ("policy.v1.issued", "5", {"policyId": "5"})]),
    ], start)
    want = {("b", 1), ("a", 2), ("d", 3)}
    assert as_set(reactions.numbers(spark, home).select("partner_id", "sequence")) == want
    redeliver(home)
    run.finish(start(stream_messages(spark, str(tmp_path / "topics"))))
    assert as_set(reactions.numbers(spark, home).select("partner_id", "sequence")) == want
    deliver(spark, tmp_path, [messages(spark, [("policy.v1.issued", "8", issued("8", "c"))])], start)
    assert as_set(reactions.numbers(spark, home).select("partner_id", "sequence")) == want | {("c", 4)}
    rejected = spark.read.schema(run.REJECT).parquet(f"{home}/dead-letters/unknown").unionByName(
        spark.read.schema(run.REJECT).parquet(f"{home}/dead-letters/incomplete"))
    assert {(r.key, r.reason) for r in rejected.collect()} == {("nobody", "partner is not known"), ("5", "partnerId is missing")}


def test_invoice_between_two_batches_pays_out(spark, tmp_path):
    payees, home = str(tmp_path / "payees"), str(tmp_path / "pay")
    bills = lambda s: reactions.bill_policies(s, str(tmp_path / "bill"), payees=payees, once=True)
    settled = lambda c, p, a="10.50": ("claims.v1.settled", c, {"claimId": c, "policyId": p, "settlementAmount": a})
    pay = lambda rows: deliver(spark, tmp_path / "claims", [messages(spark, rows)], lambda s: reactions.pay_claims(s, payees, home, once=True))
    pay([settled("c0", "p1")])
    deliver(spark, tmp_path / "policies", [messages(spark, [("policy.v1.issued", "p1", issued("p1", "anna"))])], bills)
    pay([settled("c1", "p1"), settled("c2", "p2"), settled("c3", "p1", None), settled("c4", "p1", "much"), settled(" ", "p1")])
    deliver(spark, tmp_path / "policies", [messages(spark, [("policy.v1.issued", "p2", issued("p2", "bert"))])], bills)
    pay([settled("c5", "p2")])
    paid = {(r.claim_id, r.partner_id, str(r.settlement_amount_chf)) for r in reactions.paid_claims(spark, home).collect()}
    assert paid == {("c1", "anna", "10.50"), ("c5", "bert", "10.50")}
    assert {(r.key, r.reason) for r in read_models.rejected(spark, home).collect()} == {
        ("c0", "no invoice of the policy"), ("c2", "no invoice of the policy"), ("c3", "settlementAmount is missing"),
        ("c4", "settlementAmount is not a number"), (" ", "claimId is missing")}


def test_all_topics_land_by_one_query(spark, tmp_path):
    rows = [
        ("claims.v1.opened", "c", {"eventId": "e1", "eventType": "ClaimOpened", "claimId": "c", "timestamp": "2024-01-01T10:00:00Z"}),
        ("person.v1.deleted", "p", {"eventId": "e2", "eventType": "PersonDeleted", "personId": "p", "timestamp": "2024-01-02T10:00:00Z"}),
        ("person.v1.deleted", "q", {"eventId": "e3", "eventType": "PersonDeleted", "personId": "q", "timestamp": "when?"}),
        ("billing.v1.payment-received", "i", "no json"), ("other.topic", "x", {"a": 1}),
    ]
    raw = str(tmp_path / "raw")
    start = lambda s: run.land_all(s, raw, str(tmp_path), once=True)
    deliver(spark, tmp_path, [messages(spark, rows[:2]), messages(spark, rows[2:])], start)
    deleted = run.landed(spark, raw, "person.v1.deleted")
    assert deleted.columns == parse(messages(spark, rows), CONTRACTS["person.v1.deleted"]).columns
    assert {(r.personid, str(r.event_date)) for r in deleted.collect()} == {("p", "2024-01-02"), ("q", "None")}
    assert run.landed(spark, raw, "hr.v1.employee.state").isEmpty()
    rejects = {(r.topic, r.reason.split(":")[0]) for r in spark.read.schema(run.REJECT).parquet(f"{raw}/_rejects").collect()}
    assert rejects == {("claims.v1.opened", "missing"), ("billing.v1.payment-received", "not a JSON object"), ("other.topic", "unknown topic")}


def test_events_without_id_are_kept(spark, tmp_path):
    """Three events without id in one batch, one of them twice, and two different ones under one id."""
    said = ["a", "b", "c", "a"]
    rows = [("claims.v1.opened", "c", {"claimId": x, "timestamp": "2024-01-01T00:00:00Z"}) for x in said]
    rows += [("claims.v1.opened", "c", {"eventId": "e", "claimId": x, "timestamp": f"2024-01-01T00:0{i}:00Z"}) for x, i in (("late", 5), ("early", 1))]
    source, out = str(tmp_path / "topics"), str(tmp_path / "out")
    for part in (rows, rows[:2]):
        write_topics(messages(spark, part), source)
        events = parse(stream_messages(spark, source), CONTRACTS["claims.v1.opened"]).select("eventid", "claimid", "event_at")
        run.finish([run.without_repeats(events, "eventid", "event_at", out, once=True)])
    got = sorted((r.eventid or "", r.claimid) for r in run.passed_on(spark, out, events.schema).collect())
    assert got == [("", "a"), ("", "b"), ("", "c"), ("e", "early")]


def test_payouts_use_newest_invoice(spark):
    inv = spark.createDataFrame([("p1", "old", "i1", T0), ("p1", "new", "i2", T0 + timedelta(days=1))],
                                "policy_id string, partner_id string, invoice_id string, invoice_date timestamp")
    rows = [
        ("claims.v1.settled", "c1", '{"claimId":"c1","policyId":"p1","settlementAmount":12.5}'),
        ("claims.v1.settled", "c2", '{"claimId":"c2","policyId":"none","settlementAmount":1}'),
        ("claims.v1.settled", "c3", '{"claimId":"c3","policyId":"p1"}'),
        ("claims.v1.opened", "c4", '{"claimId":"c4","policyId":"p1","settlementAmount":1}'),
    ]
    got = [(r.claim_id, r.partner_id, str(r.settlement_amount_chf)) for r in reactions.payouts(messages(spark, rows), inv).collect()]
    assert got == [("c1", "new", "12.50")]


def test_landing_equals_batch_parse(spark, tmp_path, sf):
    from firnlake.workload import queries as q

    msgs = q.claim_messages(spark, sf)
    source = str(tmp_path / "topics")
    write_topics(msgs.repartition(5), source)
    topics = [t for t in CONTRACTS if t.startswith("claims.")]
    stream = stream_messages(spark, source, files_per_trigger=2)
    run.finish(run.land_topics(stream, topics, str(tmp_path / "raw"), str(tmp_path / "cp"), once=True))
    for t in topics:
        contract = CONTRACTS[t]
        batch = parse(msgs, contract)
        landed = spark.read.schema(batch.schema).parquet(str(tmp_path / "raw" / t))
        assert sorted(map(str, landed.collect())) == sorted(map(str, batch.collect()))


def test_without_repeats(spark, tmp_path):
    rows = [("claims.v1.opened", "c", {"eventId": f"e{i % 3}", "timestamp": f"2024-01-01T00:0{i % 3}:00Z"}) for i in range(6)]
    source, out = str(tmp_path / "topics"), str(tmp_path / "out")
    for part in (rows[:4], rows[4:]):
        write_topics(messages(spark, part), source)
        events = parse(stream_messages(spark, source), CONTRACTS["claims.v1.opened"]).select("eventid", "event_at")
        run.finish([run.without_repeats(events, "eventid", "event_at", out, once=True)])
    assert sorted(r.eventid for r in run.passed_on(spark, out, events.schema).collect()) == ["e0", "e1", "e2"]


def test_late_first_events_pass(spark, tmp_path):
    """No event is too late, in whatever batches the deliveries come."""
    days = ["2024-03-01", "2024-03-02", "2024-01-01", "2024-03-01", "2024-01-01"]
    ids = ["a", "b", "late", "a", "late"]
    for size in (1, 2, 5):
        source, home = str(tmp_path / f"t{size}"), str(tmp_path / f"o{size}")
        rows = [("claims.v1.opened", "c", {"eventId": i, "timestamp": f"{d}T00:00:00Z"}) for i, d in zip(ids, days, strict=True)]
        rows.append(("claims.v1.opened", "c", {"eventId": "undated", "timestamp": "?"}))
        for at in range(0, len(rows), size):
            write_topics(messages(spark, rows[at : at + size]), source)
            events = parse(stream_messages(spark, source), CONTRACTS["claims.v1.opened"]).select("eventid", "event_at")
            run.finish([run.without_repeats(events, "eventid", "event_at", home, once=True)])
        got = sorted(r.eventid for r in run.passed_on(spark, home, events.schema).collect())
        assert got == ["a", "b", "late", "undated"]


def test_compaction(spark):
    rows = [
        ("person.v1.state", "a", {"personId": "a", "n": 1}), ("person.v1.state", "a", {"personId": "a", "n": 2}),
        ("person.v1.state", "b", {"personId": "b"}), ("person.v1.state", "b", {"personId": "b", "deleted": True}),
    ]
    got = read_models.compacted(messages(spark, rows)).collect()
    assert [(r.key, json.loads(r.value)["n"]) for r in got] == [("a", 2)]


def test_raw_table_unions_topics(spark):
    rows = [
        ("claims.v1.opened", "c", {"claimId": "c", "description": 'say "hi"\n', "timestamp": "2024-01-01T10:00:00.123456789+02:00"}),
        ("claims.v1.settled", "c", {"claimId": "c", "settlementAmount": 12.5, "timestamp": "bad"}),
    ]
    raw = raw_table(messages(spark, rows), ["claims.v1.opened", "claims.v1.settled"])
    by = {r.description: r for r in raw.collect()}
    assert by['say "hi"\n'].event_at == datetime(2024, 1, 1, 8, 0, 0, 123456)
    assert by[None].event_at is None and str(by[None].settlementamount) == "12.50"


def test_large_input_is_staged_without_a_shuffle_in_more_files(spark, tmp_path, monkeypatch):
    from firnlake.workload import stream_queries

    rows = [("t", str(i), "{}", None, None) for i in range(100)]
    spark.createDataFrame(rows, "topic string, key string, value string, event_type string, created_at timestamp").repartition(20).write.parquet(str(tmp_path / "sent"))
    monkeypatch.setattr(stream_queries, "PIECE_BYTES", 100)
    sent = spark.read.parquet(str(tmp_path / "sent"))
    assert stream_queries._pieces(sent) >= stream_queries.FILES
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        source = stream_queries.staged(spark, sent, "large", by_makers=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    staged = spark.read.parquet(source)
    assert len(staged.inputFiles()) > stream_queries.FILES
    assert {r.key for r in staged.collect()} == {str(i) for i in range(100)}
    batches = []

    def seen(batch, number):
        batches.append(batch.count())

    stream_queries.run.finish([stream_queries.run.each_batch(stream_queries.feed(spark, source), seen, str(tmp_path / "c"), once=True)])
    assert len(batches) == stream_queries.BATCHES and sum(batches) == 100


def test_landed_days_are_few_files_however_many_tasks_read(spark, tmp_path):
    """Forty files of messages, each with the same two days: not a file per task and day."""
    rows = [("claims.v1.rejected", f"c{i}", {"eventId": f"e{i}", "eventType": "ClaimRejected", "claimId": f"c{i}", "claimNumber": "n",
             "policyId": "p", "claimDate": "2024-01-01", "status": "REJECTED", "timestamp": f"2024-01-0{1 + i // 40 % 2}T10:00:00Z"})
            for i in range(400)]
    source, raw = str(tmp_path / "topics"), str(tmp_path / "raw")
    write_topics(messages(spark, rows).repartition(40), source)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task per file
    try:
        stream = stream_messages(spark, source)
        run.finish(run.land_topics(stream, ["claims.v1.rejected"], raw, str(tmp_path / "cp"), once=True))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    landed = spark.read.parquet(f"{raw}/claims.v1.rejected")
    assert landed.count() == 400 and len({r.eventid for r in landed.collect()}) == 400
    assert len(landed.inputFiles()) == 2


def test_a_batch_is_checked_once_and_leaves_nothing_aside(spark, tmp_path, monkeypatch):
    """By year no row is moved between tasks, nothing is kept in memory or aside, and a batch can come again."""
    rows = [("person.v1.deleted", f"p{i}", {"eventId": f"e{i}", "eventType": "PersonDeleted", "personId": f"p{i}", "timestamp": f"202{i % 3}-01-02T10:00:00Z"})
            for i in range(30)] + [("person.v1.deleted", "bad", "no json"), (None, "none", {"a": 1})]
    raw, checkpoint = str(tmp_path / "raw"), str(tmp_path / "cp")
    source = str(tmp_path / "topics")
    write_topics(messages(spark, rows).repartition(3), source)
    caught = []
    start = run.each_batch
    run.each_batch = lambda m, handle, *a, **k: caught.append(handle)
    try:
        run.land_all(stream_messages(spark, source), raw, checkpoint, unit="year", once=True)
    finally:
        run.each_batch = start
    batch = spark.read.schema(MESSAGE).parquet(source)
    with monkeypatch.context() as m:
        m.setattr(type(batch), "persist", None)
        m.setattr(type(batch), "repartition", None)
        for _ in range(2):
            caught[0](batch, 0)
    assert sorted(r.personid for r in run.landed(spark, raw, "person.v1.deleted").collect()) == sorted(f"p{i}" for i in range(30))
    rejects = spark.read.schema(run.REJECT).parquet(f"{raw}/_rejects").collect()
    assert {(r.topic, r.key, r.value, r.reason) for r in rejects} == {
        ("person.v1.deleted", "bad", "no json", "not a JSON object"), (None, "none", '{"a": 1}', "unknown topic")}
    assert not list((tmp_path / "cp" / "_checked").glob("batch=*"))


def test_consumed_messages_give_their_disk_back(spark, tmp_path):
    """All are seen, and the files of the batches that are done go; without ``consume`` they stay."""
    import time

    rows = [("t", str(i), {"i": i}) for i in range(90)]
    for consume in (False, True):
        source, seen = tmp_path / f"topics-{consume}", []
        write_topics(messages(spark, rows).repartition(9), str(source))
        stream = stream_messages(spark, str(source), files_per_trigger=3, consume=consume)
        handle = lambda batch, _: seen.append(batch.count())  # noqa: E731, B023
        run.finish([run.each_batch(stream, handle, str(tmp_path / f"c-{consume}"), once=True)])
        assert len(seen) == 3 and sum(seen) == 90
        until = time.time() + 20
        while consume and len(list(source.rglob("*.parquet"))) > 3 and time.time() < until:
            time.sleep(0.2)
        left = len(list(source.rglob("*.parquet")))
        assert left <= 3 if consume else left == 9


def test_landed_rows_are_packed(spark, tmp_path):
    """Also of many rows, whose texts share large pages."""
    import pyarrow.parquet as pq

    made = lambda i: {"eventId": f"e{i}", "eventType": "PersonDeleted", "personId": f"p{i}", "timestamp": "2024-01-02T10:00:00Z"}
    rows = [("person.v1.deleted", f"p{i}", made(i)) for i in range(30_000)]
    source, raw = str(tmp_path / "topics"), str(tmp_path / "raw")
    write_topics(messages(spark, rows).coalesce(1), source)
    run.finish([run.land_all(stream_messages(spark, source), raw, str(tmp_path / "cp"), unit="year", once=True)])
    files = list((tmp_path / "raw" / "person.v1.deleted").rglob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    assert run.landed(spark, raw, "person.v1.deleted").count() == 30_000


def test_billing_keeps_time_and_text_of_an_issue(spark, tmp_path):
    """The fields are read from the text that won, and only the columns that are wanted are moved."""
    issue = lambda p, n, pr: {"policyId": p, "policyNumber": n, "partnerId": "7", "premium": pr}
    rows = [
        ("policy.v1.issued", "1", issue("1", "B", "2.00"), 5), ("policy.v1.issued", "1", issue("1", "A", "1.00"), 5),
        ("policy.v1.issued", "1", issue("1", "0", "3.00"), 6), ("policy.v1.cancelled", "1", {"policyId": "1"}, 7),
        ("policy.v1.cancelled", "2", {"policyId": "2"}, 1),
    ]
    state = reactions.billing_state(messages(spark, rows))
    assert {(r.policy_id, r.row and (r.row.policyNumber, r.row.premium, r.row.created_at)) for r in state.collect()} == {
        ("1", ("A", "1.00", T0 + timedelta(minutes=5))), ("2", None)}
    assert "min_by" not in state._jdf.queryExecution().analyzed().toString()
    home = str(tmp_path / "home")
    deliver(spark, tmp_path, [messages(spark, rows[:2]), messages(spark, rows[2:])], lambda s: reactions.bill_policies(s, home, once=True))
    found = reactions.invoices(spark, home, ["invoice_id", "policy_id", "total_amount_chf", "status"])
    assert found.columns == ["invoice_id", "policy_id", "total_amount_chf", "status"]
    assert [(r.policy_id, str(r.total_amount_chf), r.status) for r in found.collect()] == [("1", "1.00", "CANCELLED")]
    assert {spark.conf.get(k) for k in run.STATE_PACKED} == {"zstd", "16"}
