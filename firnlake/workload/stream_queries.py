"""Registered streaming queries.

Each stages the messages of its topics once in a folder below the shared one, runs its
streams over that folder until the input is used up, and returns what they maintain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnlake.contracts import CONTRACTS
from firnlake.plans import silver
from firnlake.plans.models import MODELS, current_state, keep_current
from firnlake.session import PIECE_BYTES, new_path, release_shuffles
from firnlake.sources.buckets import BucketTable
from firnlake.sources.lake import filesystem
from firnlake.sources.outbox import write_topics
from firnlake.sources.topics import MESSAGE, parse, raw_table, stream_messages, union_wide
from firnlake.streaming import reactions, read_models, run
from firnlake.workload import queries as q
from firnlake.workload.queries import query

FILES = 9  # per topic and delivery, at least
BATCHES = 3  # micro-batches of every stream, whatever the machine


def feed(spark, source: str, *, consume: bool = False) -> DataFrame:
    """The staged messages as a stream of ``BATCHES`` micro-batches; one query alone may ``consume`` them."""
    files = len(spark.read.schema(MESSAGE).parquet(source).inputFiles())
    return stream_messages(spark, source, files_per_trigger=max(1, -(-files // BATCHES)), consume=consume)


def _pieces(messages: DataFrame) -> int:
    """Pieces in which the tables below the messages are scanned, at least."""
    spark = messages.sparkSession
    found = [filesystem(spark, name) for name in messages.inputFiles()]
    return sum(fs.getFileStatus(p).getLen() for fs, p in found) // PIECE_BYTES


def staged(spark, messages: DataFrame, label: str, deliveries: int = 1, *, by_makers: bool = True) -> str:
    """Messages written once (or again, as later deliveries), spread over files as over the
    partitions of a topic.

    They are dealt to ``FILES`` files.  Large input is written by the tasks that make the messages, so files grow in
    number and not in size, and no message is shuffled; ``by_makers`` False deals it too.
    """
    path = new_path(spark, f"topic-{label}")
    release_shuffles(spark)
    spread = messages if by_makers and _pieces(messages) >= FILES else messages.repartition(FILES)
    for _ in range(deliveries):
        write_topics(spread, path)
    return path


def _read_model(spark, messages: DataFrame, model: read_models.ReadModel, label: str) -> str:
    source = staged(spark, messages.filter(F.col("topic").isin(*model.topics)), label)
    home = new_path(spark, label)
    stream = feed(spark, source)
    run.finish([read_models.maintain(stream, model, home, once=True)])
    return home


@query("stream_landing", "SELECT * FROM s_claim")
def stream_landing(spark, d):
    """Claim topics landed one query per topic, then the claim model over the raw rows."""
    source, home = staged(spark, q.claim_messages(spark, d), "claims"), new_path(spark, "landing")
    topics = [t for t in CONTRACTS if t.startswith("claims.")]
    stream = feed(spark, source)
    run.finish(run.land_topics(stream, topics, f"{home}/raw", f"{home}/checkpoint", once=True))
    landed = [spark.read.schema(parse(stream, CONTRACTS[t]).schema).parquet(f"{home}/raw/{t}") for t in topics]
    return silver.claim(union_wide(landed))


@query("stream_silver_policy", f"SELECT {q._POLICY} FROM s_policy")
def stream_silver_policy(spark, d):
    """The policy model kept current from its topics as a stream equals the batch model."""
    source, home = staged(spark, q.policy_messages(spark, d), "policies"), new_path(spark, "silver-policy")
    topics = [t for t in CONTRACTS if t.startswith("policy.")]
    raw = raw_table(feed(spark, source), topics)
    model = MODELS["policy_silver.policy"]
    run.finish([keep_current(raw, model, home, once=True)])
    return current_state(spark, model, home, raw.schema)


_PARTNER_VIEW = """
    SELECT personid AS partner_id, firstname || ' ' || name AS name,
           CASE WHEN first_order IS NOT NULL AND k % 40 <> 9 THEN concat('VN-', lpad(personid, 8, '0')) END AS insured_number
    FROM person"""


@query("stream_partner_view", _PARTNER_VIEW)
def stream_partner_view(spark, d):
    home = _read_model(spark, q.person_messages(spark, d), read_models.PARTNER, "partner-view")
    return read_models.current(spark, read_models.PARTNER, home)


@query(
    "stream_dead_letters",
    """SELECT 'person.v1.updated' AS topic, personid AS key, 'name is missing' AS reason
       FROM person WHERE first_order IS NOT NULL AND k % 40 = 9""",
)
def stream_dead_letters(spark, d):
    """Updates without a name end up with the rejects of the partner view."""
    home = _read_model(spark, q.person_messages(spark, d), read_models.PARTNER, "dead-letters")
    return read_models.rejected(spark, home).select("topic", "key", "reason")


@query(
    "stream_product_view",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, coalesce(line, 'UNKNOWN') AS product_line,
              CAST(p_retailprice AS DECIMAL(15,2)) AS base_premium, p_size <= 45 AS active
       FROM part JOIN (SELECT productid, max(line) AS line FROM product_evt GROUP BY 1) ON productid = CAST(p_partkey AS VARCHAR)""",
)
def stream_product_view(spark, d):
    home = _read_model(spark, q.product_messages(spark, d), read_models.PRODUCT, "product-view")
    return read_models.current(spark, read_models.PRODUCT, home)


@query(
    "stream_policyholder_view",
    """SELECT personid AS partner_id, firstname || ' ' || name AS name,
              CASE WHEN first_order IS NOT NULL THEN concat('VN-', lpad(personid, 8, '0')) END AS insured_number
       FROM person""",
)
def stream_policyholder_view(spark, d):
    """Tombstones are skipped, so deleted persons keep their last name here."""
    home = _read_model(spark, q.person_messages(spark, d), read_models.POLICYHOLDER, "policyholder")
    return read_models.current(spark, read_models.POLICYHOLDER, home)


@query(
    "stream_search_view",
    """SELECT partner_id, family_name AS last_name, first_name, CAST(date_of_birth AS DATE) AS date_of_birth,
              social_security_number, insured_number FROM s_partner WHERE NOT deleted""",
)
def stream_search_view(spark, d):
    """Encrypted state messages, decrypted; tombstones remove the person."""
    keys = q.person_keys(spark, d)
    model = read_models.search_model(keys)
    home = _read_model(spark, q.person_messages(spark, d, keys), model, "search-view")
    return read_models.current(spark, model, home)


@query(
    "stream_policy_snapshot",
    """SELECT policyid AS policy_id, policynumber AS policy_number, partnerid AS partner_id, productid AS product_id,
              startdate AS coverage_start_date, CAST(cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS premium
       FROM policy_evt WHERE eventtype = 'PolicyIssued'""",
)
def stream_policy_snapshot(spark, d):
    home = _read_model(spark, q.policy_messages(spark, d), read_models.SNAPSHOT, "snapshot")
    return read_models.current(spark, read_models.SNAPSHOT, home)


_INVOICE_ID = q._uuid_sql("concat('invoice:', policyid)")


def _billed(spark, messages: DataFrame, label: str, deliveries: int, columns: list[str]) -> DataFrame:
    source, home = staged(spark, messages, label, deliveries), new_path(spark, label)
    run.finish(reactions.bill_policies(feed(spark, source), home, once=True))
    return reactions.invoices(spark, home, columns).select(columns)


@query(
    "stream_invoices",
    f"""SELECT {_INVOICE_ID} AS invoice_id, policyid AS policy_id, 'ANNUAL' AS billing_cycle,
               CAST(cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS total_amount_chf,
               CAST(event_at AS DATE) + 30 AS due_date, concat('Jahresprämie ', policynumber) AS line_text,
               'OPEN' AS status
        FROM policy_evt WHERE eventtype = 'PolicyIssued'""",
)
def stream_invoices(spark, d):
    """One invoice per policy although every message comes again in a later batch."""
    issued = q.policy_messages(spark, d).filter(F.col("topic") == "policy.v1.issued")
    columns = ["invoice_id", "policy_id", "billing_cycle", "total_amount_chf", "due_date", "line_text", "status"]
    return _billed(spark, issued, "invoices", 2, columns)


@query(
    "stream_cancel_cascade",
    """SELECT policyid AS policy_id, CASE WHEN max(CASE WHEN eventtype = 'PolicyCancelled' THEN 1 ELSE 0 END) = 1
              THEN 'CANCELLED' ELSE 'OPEN' END AS status FROM policy_evt GROUP BY 1""",
)
def stream_cancel_cascade(spark, d):
    """Invoices first, then the cancellations of the policies as a second delivery."""
    messages = q.policy_messages(spark, d)
    source, home = new_path(spark, "topic-cascade"), new_path(spark, "cascade")
    for topic in ("policy.v1.issued", "policy.v1.cancelled"):
        write_topics(messages.filter(F.col("topic") == topic), source)
        run.finish(reactions.bill_policies(stream_messages(spark, source), home, once=True))
    return reactions.invoices(spark, home).select("policy_id", "status")


@query(
    "stream_payout",
    """
    SELECT c.claimid AS claim_id, c.policyid AS policy_id, i.partner_id, c.settlementamount AS settlement_amount_chf
    FROM claim_evt c
    JOIN (SELECT policy_id, partner_id, row_number() OVER (PARTITION BY policy_id
            ORDER BY created_at DESC, invoice_id DESC) AS rn FROM s_invoice) i
      ON i.policy_id = c.policyid AND i.rn = 1
    WHERE c.eventtype = 'ClaimSettled'""",
)
def stream_payout(spark, d):
    """Settlements joined in flight with the payee of each policy, read from the buckets they fall into."""
    settled = q.claim_messages(spark, d).filter(F.col("topic") == "claims.v1.settled")
    source, home, payees = staged(spark, settled, "settled"), new_path(spark, "payout"), new_path(spark, "payees")
    invoices = q.invoices_with(spark, d, "policy_id", "partner_id", "created_at", "invoice_id").withColumnRenamed("created_at", "invoice_date")
    reactions.keep_payees(BucketTable(spark, payees, "policy_id"), invoices)
    run.finish([reactions.pay_claims(feed(spark, source), payees, home, once=True)])
    return reactions.paid_claims(spark, home)


@query(
    "stream_insured_numbers",
    """SELECT partnerid AS partner_id, TRUE AS own_number, TRUE AS in_sequence
       FROM policy_evt WHERE eventtype = 'PolicyIssued' AND partnerid IN (SELECT personid FROM person) GROUP BY 1""",
)
def stream_insured_numbers(spark, d):
    """Numbers given over several batches, each policy delivered twice.

    Which partner gets which number follows the delivery; what must hold is that every
    partner has one number, no number is given twice, and the numbers run from 1 without gaps.
    """
    issued = q.policy_messages(spark, d).filter(F.col("topic") == "policy.v1.issued")
    source, home = staged(spark, issued, "issued", deliveries=2), new_path(spark, "numbers")
    people = q.star.persons(spark, d).select(
        F.col("personid").alias("partner_id"), F.lit(None).cast("string").alias("insured_number")
    )
    run.finish(reactions.assign_numbers(feed(spark, source), people, home, once=True))
    given = reactions.numbers(spark, home)
    holders = given.groupBy(F.col("insured_number").alias("held")).agg(F.count(F.lit(1)).alias("holders"))
    total = given.count()
    return given.join(holders, F.col("insured_number") == F.col("held")).groupBy("partner_id").agg(
        ((F.count(F.lit(1)) == 1) & (F.max("holders") == 1)).alias("own_number"),
        F.max("sequence").between(1, total).alias("in_sequence"),
    )


@query("stream_without_repeats", "SELECT eventid AS event_id, event_at FROM claim_evt WHERE eventtype = 'ClaimOpened'")
def stream_without_repeats(spark, d):
    """Events delivered twice, the repeats in later batches, are passed on once; none is too late."""
    opened = q.claim_messages(spark, d).filter(F.col("topic") == "claims.v1.opened")
    source, home = staged(spark, opened, "repeats", deliveries=2), new_path(spark, "once")
    events = parse(feed(spark, source), CONTRACTS["claims.v1.opened"]).select(F.col("eventid").alias("event_id"), "event_at")
    run.finish([run.without_repeats(events, "event_id", "event_at", home, once=True)])
    return run.passed_on(spark, home, events.schema)


_TOPIC_OF_POLICY = """CASE eventtype WHEN 'PolicyIssued' THEN 'policy.v1.issued' WHEN 'PolicyChanged'
    THEN 'policy.v1.changed' ELSE 'policy.v1.cancelled' END"""


@query(
    "stream_landing_rejects",
    f"""SELECT topic, reason, count(*) AS messages FROM (
           SELECT {_TOPIC_OF_POLICY} AS topic,
                  CASE WHEN cents % 7 = 0 THEN 'not a JSON object' WHEN eventtype = 'PolicyIssued' AND productid IS NULL
                       THEN 'missing:productId' END AS reason FROM policy_evt
           UNION ALL
           SELECT 'product.v1.state', CASE WHEN base < 1000 THEN 'type:basePremium' END
           FROM product_evt WHERE eventtype = 'ProductState')
        WHERE reason IS NOT NULL GROUP BY ALL""",
)
def stream_landing_rejects(spark, d):
    """Cut-off texts, wrong types and missing fields become dead letters with their text; the rest lands."""
    policies = q.policy_messages(spark, d)
    premium = (F.get_json_object("value", "$.premium").cast("decimal(15,2)") * 100).cast("bigint")
    cut = F.when(premium % 7 == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    products = q.product_messages(spark, d).filter(F.col("topic") == "product.v1.state")
    base = F.get_json_object("value", "$.basePremium").cast("decimal(15,2)")
    typed = F.when(base < 1000, F.regexp_replace("value", r'"basePremium":[0-9.]+', '"basePremium":"much"')).otherwise(F.col("value"))
    sent = policies.withColumn("value", cut).unionByName(products.withColumn("value", typed))
    source, home = staged(spark, sent, "broken"), new_path(spark, "landing-rejects")
    stream = feed(spark, source)
    topics = ["policy.v1.issued", "policy.v1.changed", "policy.v1.cancelled", "product.v1.state"]
    landing = run.land_topics(stream, topics, f"{home}/raw", f"{home}/checkpoint", once=True)
    run.finish([*landing, run.land_rejects(stream, f"{home}/rejects", f"{home}/checkpoint", once=True)])
    rejects = spark.read.parquet(f"{home}/rejects").filter("value is not null")
    return rejects.groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "stream_landing_all",
    f"SELECT topic, count(*) FILTER (reason = '') AS landed, count(*) FILTER (reason <> '') AS rejected FROM ({q._REPORT}) GROUP BY 1",
)
def stream_landing_all(spark, d):
    """Every topic landed by one query, which reads and checks each batch once, with its rejects."""
    sent = q.all_messages(spark, d)
    source, home = staged(spark, sent, "all"), new_path(spark, "landing-all")
    stream = feed(spark, source, consume=True)
    run.finish([run.land_all(stream, f"{home}/raw", f"{home}/checkpoint", unit="year", once=True)])
    one, none = F.lit(1), F.lit(0)
    counts = [run.landed(spark, f"{home}/raw", t).select(F.lit(t).alias("topic"), one.alias("landed"), none.alias("rejected")) for t in CONTRACTS]
    rejects = spark.read.schema(run.REJECT).parquet(f"{home}/raw/_rejects")
    counts.append(rejects.select("topic", none.alias("landed"), one.alias("rejected")))
    return reduce(DataFrame.unionByName, counts).groupBy("topic").agg(F.sum("landed").alias("landed"), F.sum("rejected").alias("rejected"))


@query(
    "stream_landing_hr",
    f"""SELECT topic, count(*) FILTER (reason = '') AS landed, count(*) FILTER (reason <> '') AS rejected
        FROM ({q._REPORT}) WHERE topic LIKE 'hr.%' OR topic LIKE '%coverage%' GROUP BY 1""",
)
def stream_landing_hr(spark, d):
    """Employee, unit and coverage topics landed as streams, with their reject sink."""
    sent = q.hr_messages(spark, d).unionByName(q.coverage_messages(spark, d))
    source, home = staged(spark, sent, "hr"), new_path(spark, "landing-hr")
    topics = [t for t in CONTRACTS if t.startswith("hr.") or "coverage" in t]
    stream = feed(spark, source)
    landing = run.land_topics(stream, topics, f"{home}/raw", f"{home}/checkpoint", once=True)
    run.finish([*landing, run.land_rejects(stream, f"{home}/rejects", f"{home}/checkpoint", once=True)])
    one, none = F.lit(1), F.lit(0)
    counts = [
        spark.read.schema(parse(stream, CONTRACTS[t]).schema).parquet(f"{home}/raw/{t}")
        .select(F.lit(t).alias("topic"), one.alias("landed"), none.alias("rejected"))
        for t in topics
    ]
    counts.append(spark.read.parquet(f"{home}/rejects").select("topic", none.alias("landed"), one.alias("rejected")))
    return reduce(DataFrame.unionByName, counts).groupBy("topic").agg(F.sum("landed").alias("landed"), F.sum("rejected").alias("rejected"))
