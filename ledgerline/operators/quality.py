"""Validation, data-quality and integrity checks (F08-F16, W03, W04, W07, W13,
J08, J10, J12, U01).

Validation never throws: each rule is a boolean column; the violated rules
are collected with ``array_compact`` and reported as text, so a batch of
requests splits into accepted and rejected rows in one pass (B18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .ordering import with_neighbour

# Create-order request rules (message, in evaluation order).
CREATE_ORDER_RULES = (
    ("Customer ID is required", "customer_blank"),
    ("Total amount is required", "amount_null"),
    ("Amount must be greater than 0", "amount_min"),
    ("Currency is required", "currency_blank"),
    ("Currency must be 3 characters", "currency_size"),
    ("Item count is required", "items_null"),
    ("Must have at least 1 item", "items_min"),
    ("Shipping address is required", "address_blank"),
    ("Address too long", "address_size"),
    ("User ID is required", "user_blank"),
)
# Strict variant rules.
STRICT_RULES = (("Customer ID too long", 255), ("Amount too large", 999999.99),
                ("Currency must be 3 upper-case letters", "^[A-Z]{3}$"))
# Patterns for sensitive data and injection scans.
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD_RE = r"\b(?:\d[ -]?){13,16}\b"
SSN_RE = r"\b\d{3}-\d{2}-\d{4}\b"
SQL_INJECTION_RE = r"(?i)(\bunion\s+select\b|\bdrop\s+table\b|'\s*or\s*'1'\s*=\s*'1|;\s*--)"
SCRIPT_RE = r"(?i)<script"


def _blank(c):
    return c.isNull() | (F.trim(c) == "")


def _violations(checks: list) -> F.Column:
    return F.concat_ws(", ", F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for msg, cond in checks])))


def validate_create_orders(req: DataFrame) -> DataFrame:
    """create-order request validation.  Adds ``violations`` (text, rule
    order) and ``accepted``.  Columns: customer_id, total_amount, currency,
    item_count, shipping_address, user_id."""
    amt, cur, items, addr = (F.col(c) for c in ("total_amount", "currency", "item_count", "shipping_address"))
    conds = {
        "customer_blank": _blank(F.col("customer_id")),
        "amount_null": amt.isNull(),
        "amount_min": amt < 0.01,
        "currency_blank": _blank(cur),
        "currency_size": cur.isNotNull() & (F.length(cur) != 3),
        "items_null": items.isNull(),
        "items_min": items < 1,
        "address_blank": _blank(addr),
        "address_size": F.length(addr) > 500,
        "user_blank": _blank(F.col("user_id")),
    }
    v = _violations([(msg, F.coalesce(conds[key], F.lit(False))) for msg, key in CREATE_ORDER_RULES])
    return req.withColumn("violations", v).withColumn("accepted", v == "")


def validate_strict(req: DataFrame) -> DataFrame:
    """strict variant (length, upper bound, currency pattern)."""
    (m1, max_len), (m2, max_amt), (m3, pat) = STRICT_RULES
    checks = [(m1, F.coalesce(F.length("customer_id") > max_len, F.lit(False))),
              (m2, F.coalesce(F.col("total_amount") > max_amt, F.lit(False))),
              (m3, F.coalesce(~F.col("currency").rlike(pat), F.lit(True)))]
    v = _violations(checks)
    return req.withColumn("violations", v).withColumn("accepted", v == "")


def validate_status_requests(req: DataFrame) -> DataFrame:
    """status-update / cancel requests (status or reason required, reason
    at most 500, user required).  Columns: kind ('status' | 'cancel'),
    status, reason, user_id."""
    is_cancel = F.col("kind") == "cancel"
    checks = [("Status is required", ~is_cancel & _blank(F.col("status"))),
              ("Reason is required", is_cancel & _blank(F.col("reason"))),
              ("Reason too long", is_cancel & F.coalesce(F.length("reason") > 500, F.lit(False))),
              ("User ID is required", _blank(F.col("user_id")))]
    v = _violations(checks)
    return req.withColumn("violations", v).withColumn("accepted", v == "")


def order_response(orders: DataFrame) -> DataFrame:
    """API response shape of an order (text ids, ISO local date-time
    without seconds when they are zero and with the fraction in three or six
    digits when there is one, as a Java local date-time prints)."""
    t = F.col("created_at")
    micros = F.date_format(t, "SSSSSS")
    created = (F.when((F.second(t) == 0) & (micros == "000000"), F.date_format(t, "yyyy-MM-dd'T'HH:mm"))
               .when(micros == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
               .when(micros.endswith("000"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
               .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return orders.select(F.col("id").cast("string").alias("orderId"),
                         F.col("customer_id").cast("string").alias("customerId"),
                         F.col("total_amount").cast("double").alias("totalAmount"),
                         "currency", F.col("item_count").alias("itemCount"), "status",
                         created.alias("createdAt"))


def validation_chain(events: DataFrame, auth_types=("PaymentProcessed",)) -> DataFrame:
    """ordered rule chain; the first failing rule is reported, else PROCESSED.
    Rules: null payload, malformed payload, authentication required (a
    protected type without message properties)."""
    body = F.col("payload")
    parsed = F.from_json(body, "_x STRING, _corrupt STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    outcome = (F.when(_blank(body), F.lit("NULL_PAYLOAD"))
               .when(parsed["_corrupt"].isNotNull(), F.lit("MALFORMED"))
               .when(F.col("event_type").isin(list(auth_types)) & F.col("properties").isNull(),
                     F.lit("AUTH_REQUIRED"))
               .otherwise(F.lit("PROCESSED")))
    return events.withColumn("outcome", outcome)


def tenant_violations(rows: DataFrame, tenant_col: str, expected_col: str) -> DataFrame:
    """rows whose tenant is missing or differs from the expected tenant."""
    t, e = F.col(tenant_col), F.col(expected_col)
    kind = F.when(t.isNull(), "MISSING_TENANT").when(~t.eqNullSafe(e), "TENANT_MISMATCH")
    return rows.withColumn("violation", kind).where(F.col("violation").isNotNull())


def sensitive_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """counts of e-mail addresses, card-like numbers and SSN-like ids per
    text, plus the first e-mail masked (first letter kept).  Whole texts."""
    t = F.col(text_col)
    # Every e-mail contains '@': a byte search skips the (costly) pattern on
    # texts without one; the result is the same.
    emails = F.when(t.contains("@"), F.regexp_extract_all(t, F.lit(EMAIL_RE), 0)) \
        .otherwise(F.array().cast("array<string>"))
    first = F.try_element_at(emails, F.lit(1))
    masked = F.when(first.isNotNull(), F.concat(F.substring(first, 1, 1), F.lit("***@"),
                                                F.substring_index(first, "@", -1)))
    return docs.select("doc_id", F.size(emails).cast("bigint").alias("n_emails"),
                       F.size(F.regexp_extract_all(t, F.lit(CARD_RE), 0)).cast("bigint").alias("n_cards"),
                       F.size(F.regexp_extract_all(t, F.lit(SSN_RE), 0)).cast("bigint").alias("n_ssn"),
                       masked.alias("masked_email"))


def mask_emails(col: F.Column) -> F.Column:
    """replace every e-mail address in a text with a masked token."""
    return F.when(col.contains("@"), F.regexp_replace(col, EMAIL_RE, "***@***")).otherwise(col)


def injection_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """SQL-injection and script-tag flags per text."""
    t = F.col(text_col)
    return docs.select("doc_id", t.rlike(SQL_INJECTION_RE).alias("sql_injection"),
                       t.rlike(SCRIPT_RE).alias("script_tag"))


def sample_hits(df: DataFrame, miss_col: str, percent: int = 1, key: str = "id",
                hashed: bool = False) -> DataFrame:
    """F16: keep every miss and ``percent`` % of hits, deterministically
    (``key % 100`` or, with ``hashed``, ``pmod(xxhash64(key), 100)``)."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(100)) if hashed else F.pmod(F.col(key), F.lit(100))
    return df.where(F.col(miss_col) | (bucket < percent))


def out_of_order(rows: DataFrame, key_col: str, arrival_cols: list, version_col: str) -> DataFrame:
    """Rows whose version (event time) is older than the previous
    arrival's of the same key."""
    n = with_neighbour(rows, [key_col], arrival_cols, [version_col])
    return n.where(F.col(version_col) < F.col(f"prev_{version_col}"))


def sequence_gaps(rows: DataFrame, key_col: str, seq_col: str) -> DataFrame:
    """Positions where the next sequence number of a key jumps by more than 1."""
    n = with_neighbour(rows.select(key_col, seq_col), [key_col], [seq_col], [seq_col], offset=-1,
                       prefix="next_")
    return n.where(F.col(f"next_{seq_col}") - F.col(seq_col) > 1)


def causation_roots(events: DataFrame) -> DataFrame:
    """Root and depth of each event's causation chain, however long.

    Pointer doubling: each round an event takes over the pointer of the event
    it points at, so ``k`` rounds resolve chains of ``2**k`` events; rounds are
    checkpointed and go on until no pointer is open.  A missing parent ends a
    chain.  Events of a cycle have no root: they (and events that lead into
    one) report a null root and ``cycle``.  Deliveries of one id are one event (with
    the least causation id) and give one row.  Only open rows are joined: those that
    are done do not meet at their root.
    """
    ensure_checkpoint_dir(events.sparkSession)
    events = events.groupBy("event_id").agg(F.min("causation_id").alias("causation_id"))
    ids = events.select(F.col("event_id").alias("_known")).distinct()
    cur = (events.join(ids, events["causation_id"] == F.col("_known"), "left")
           .select("event_id", F.coalesce("_known", "event_id").alias("root_id"),
                   F.col("_known").isNotNull().cast("int").alias("depth"), F.col("_known").isNull().alias("done")).checkpoint())
    total, rounds = cur.count(), 0
    while True:
        still_open = cur.where(~F.col("done")).count()
        # A chain without a cycle has at most ``total`` events: after log2 of that only cycles are open.
        if still_open == 0 or 2 ** rounds > total:
            break
        rounds += 1
        up = cur.select(F.col("event_id").alias("_up"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"),
                        F.col("done").alias("_done"))
        waiting = cur.where(~F.col("done"))
        moved = waiting.join(up, waiting["root_id"] == F.col("_up"), "left").select(
            "event_id", F.coalesce("_root", "root_id").alias("root_id"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(False)).alias("done"))
        cur = cur.where("done").unionByName(moved).checkpoint()
    return cur.select("event_id", F.when(F.col("done"), F.col("root_id")).alias("root_id"),
                      F.when(F.col("done"), F.col("depth")).alias("depth"), (~F.col("done")).alias("cycle"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys only on one side, both ways (``exceptAll``), labelled by side."""
    lk, rk = left.select(key), right.select(key)
    return (lk.exceptAll(rk).withColumn("side", F.lit("only_left"))
            .unionByName(rk.exceptAll(lk).withColumn("side", F.lit("only_right"))))
