"""Order requests: validation, as-of market state, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import BUCKET_MS, AdmissionConfig
from tidemark.functions import canonical as cj
from tidemark.functions.scans import Running, chunk_of, running

# --- fixed values: reason code, status and explanation of every admission outcome ------
ADMISSION = {
    "PAUSED": (
        "ORDER_REJECTED_PAUSED",
        "rejected",
        "Rejected because the latest committed circuit-breaker state is PAUSED.",
    ),
    "RECOVERY": (
        "ORDER_REJECTED_RECOVERY",
        "rejected",
        "Rejected while the market proves stable recovery; admission resumes only after OPEN.",
    ),
    "WIDENED": (
        "ORDER_STALE_WIDENED_REQUOTE_REQUIRED",
        "stale",
        "Marked stale because WIDENED requires a fresh downstream quote before admission.",
    ),
    "version": (
        "ORDER_STALE_STATE_VERSION",
        "stale",
        "Marked stale because the quoted circuit-breaker version is not the latest committed version.",
    ),
    "age": ("ORDER_STALE_QUOTE_AGE", "stale", "Marked stale because quote age exceeds {limit}ms."),
    "open": (
        "ORDER_ACCEPTED_OPEN",
        "accepted",
        "Accepted against the latest committed OPEN circuit-breaker decision.",
    ),
}
NOT_INITIALIZED = "MARKET_NOT_INITIALIZED"
NAMESPACE_PATTERN = r"^(live|replay:[a-zA-Z0-9][a-zA-Z0-9._-]{0,255})$"
_REQUEST_JSON = {
    "expectedDecisionId": ("expected_decision_id", cj.text),
    "expectedStateVersion": ("expected_state_version", cj.scalar),
    "fixtureId": ("fixture_id", cj.text),
    "idempotencyKey": ("idempotency_key", cj.text),
    "marketId": ("market_id", cj.text),
    "namespace": ("namespace", cj.text),
    "outcomeId": ("outcome_id", cj.text),
    "price": ("price", cj.scalar),
    "quoteObservedAtMs": ("quote_observed_at_ms", cj.scalar),
    "requestedAtMs": ("requested_at_ms", cj.scalar),
    "side": ("side", cj.plain),
    "stakeMicros": ("stake_micros", cj.scalar),
}
# --------------------------------------------------------------------------------------


def order_violations(requests: DataFrame) -> DataFrame:
    """Order requests that break a range, the namespace pattern or quote-before-request."""
    sized = {"expected_decision_id": 512, "fixture_id": 512, "market_id": 512, "outcome_id": 512, "idempotency_key": 2048}
    tests = {f"{c}: length": f"length({c}) BETWEEN 1 AND {n}" for c, n in sized.items()} | {
        "expected_state_version: negative": "expected_state_version >= 0",
        "namespace: pattern": f"namespace RLIKE r'{NAMESPACE_PATTERN}'",
        "side: unknown": "side IN ('back', 'lay')",
        "stake_micros: not positive": "stake_micros > 0",
        "price: missing": "price IS NOT NULL",
        "quote_observed_at_ms: negative": "quote_observed_at_ms >= 0",
        "requested_at_ms: negative": "requested_at_ms >= 0",
        "quote_observed_at_ms: after request": "quote_observed_at_ms <= requested_at_ms",
    }
    arms = ", ".join(f"CASE WHEN NOT coalesce({t}, false) THEN '{m}' END" for m, t in tests.items())
    flagged = requests.withColumn("violations", F.expr(f"array_compact(array({arms}))"))
    return flagged.filter(F.size("violations") > 0).select("namespace", "idempotency_key", "violations")


def order_ids(requests: DataFrame) -> DataFrame:
    """Add the request hash and the order id, both over the whole request."""
    body = cj.obj({k: render(c) for k, (c, render) in _REQUEST_JSON.items()} | {"payloadVersion": "'1'"})
    hashed = requests.withColumn("request_hash", F.expr(cj.digest(body)))
    return hashed.withColumn("order_id", F.expr("concat('ord_', substring(request_hash, 1, 40))"))


def label_orders(identified: DataFrame, arrival: str = "requested_at_ms") -> DataFrame:
    """Label requests `inserted`, `duplicate` or `conflict` per (namespace, idempotency key).

    Of equal requests that arrive at the same time one is inserted.
    """
    keys = ["namespace", "idempotency_key"]
    ranked = identified.withColumn("__rank", F.struct(arrival, "order_id", F.monotonically_increasing_id().alias("row")))
    first = ranked.groupBy(*keys).agg(
        F.min_by("request_hash", "__rank").alias("__hash"), F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    joined = ranked.join(first, keys)
    status = (
        F.when(F.col("request_hash") != F.col("__hash"), F.lit("conflict"))
        .when((F.col("__rank") == F.col("__first")), F.lit("inserted"))
        .otherwise(F.lit("duplicate"))
    )
    return joined.withColumn("append_status", status).drop("__rank", "__hash", "__first", "__n")


def orders_asof(orders: DataFrame, decisions: DataFrame, chunk_ms: int = BUCKET_MS) -> DataFrame:
    """Attach to each order the market's last decision at or before its evaluation time.

    Orders and decisions merge per market by (time, kind, version), a decision before an
    order of the same time; a chunked running-last carries the state, so a hot market
    spreads over its chunks.  Orders of a market without a decision keep nulls.
    """
    timed = orders if "evaluated_at_ms" in orders.columns else orders.withColumn("evaluated_at_ms", F.col("requested_at_ms"))
    state = F.struct(
        F.col("decision_id"),
        F.col("fixture_id").alias("state_fixture_id"),
        F.col("next_state").alias("market_state"),
        (F.col("expected_state_version") + 1).alias("market_state_version"),
        F.col("logical_timestamp_ms").alias("state_at_ms"),
    )
    left = timed.select(
        "market_id",
        F.struct(
            F.col("evaluated_at_ms").alias("t"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("version"),
            F.concat_ws("|", "namespace", "idempotency_key", "order_id").alias("id"),
        ).alias("o"),
        F.struct(*timed.columns).alias("request"),
    )
    right = decisions.select(
        "market_id",
        F.struct(
            F.col("logical_timestamp_ms").alias("t"), F.lit(0).alias("rank"),
            F.col("expected_state_version").cast("long").alias("version"), F.col("decision_id").alias("id"),
        ).alias("o"),
        state.alias("state"),
    )
    merged = left.unionByName(right, allowMissingColumns=True).withColumn("chunk", chunk_of(F.col("o.t"), chunk_ms))
    seen = running(merged, ["market_id"], "o", "chunk", [Running("current", "last", F.col("state"))])
    return seen.filter("request IS NOT NULL").select("request.*", "current.*")


def admit(asof: DataFrame, config: AdmissionConfig = AdmissionConfig(), receipts: DataFrame | None = None) -> DataFrame:
    """Admission outcome per order; a market without state yields a `MARKET_NOT_INITIALIZED` row."""
    age = "evaluated_at_ms - quote_observed_at_ms"
    arms = [f"WHEN market_state = '{s}' THEN '{s}'" for s in ("PAUSED", "RECOVERY", "WIDENED")]
    arms += [
        "WHEN NOT (expected_decision_id <=> decision_id AND expected_state_version <=> market_state_version) THEN 'version'",
        f"WHEN {age} > {config.max_quote_age_ms} THEN 'age'",
    ]
    outcome = f"CASE WHEN decision_id IS NULL THEN NULL {' '.join(arms)} ELSE 'open' END"

    def pick(position: int) -> str:
        pairs = ", ".join(
            f"'{k}', {cj.literal(v[position].format(limit=config.max_quote_age_ms))}" for k, v in ADMISSION.items()
        )
        return f"element_at(map({pairs}), outcome)"

    judged = asof.withColumn("outcome", F.expr(outcome)).withColumns(
        {
            "admission_reason_code": F.expr(f"coalesce({pick(0)}, '{NOT_INITIALIZED}')"),
            "status": F.expr(f"coalesce({pick(1)}, 'error')"),
            "explanation": F.expr(f"coalesce({pick(2)}, 'No decision has been committed for this market.')"),
            "admission_latency_ms": F.expr("evaluated_at_ms - requested_at_ms"),
            "quote_age_ms": F.expr(age),
            "requires_requote": F.expr(f"coalesce({pick(1)} = 'stale', false)"),
            "created_at_ms": F.col("evaluated_at_ms"),
            "admission_policy_version": F.lit(config.policy_version),
            "settled_at_ms": F.lit(None).cast("long"),
            "settlement": F.lit(None).cast("string"),
        }
    )
    done = judged.drop("outcome")
    if receipts is None:
        return done
    ids = receipts.select("decision_id", F.col("receipt_id").alias("circuit_breaker_receipt_id"))
    return done.join(ids, "decision_id", "left")


def admission_violations(orders: DataFrame, decisions: DataFrame) -> DataFrame:
    """Orders whose market, fixture, state, version or time disagrees with the decision they cite."""
    d = decisions.select(
        "decision_id",
        F.col("fixture_id").alias("d_fixture"),
        F.col("market_id").alias("d_market"),
        F.col("next_state").alias("d_state"),
        (F.col("expected_state_version") + 1).alias("d_version"),
    )
    joined = orders.filter("decision_id IS NOT NULL").join(d, "decision_id", "left")
    issues = F.expr(
        """array_compact(array(
            CASE WHEN d_market IS NULL THEN 'unknown decision' END,
            CASE WHEN fixture_id <> d_fixture OR market_id <> d_market THEN 'order outside market' END,
            CASE WHEN market_state <> d_state THEN 'state mismatch' END,
            CASE WHEN market_state_version <> d_version THEN 'version mismatch' END,
            CASE WHEN evaluated_at_ms < requested_at_ms THEN 'admitted before request' END))"""
    )
    return joined.select("order_id", issues.alias("violations")).filter(F.size("violations") > 0)


def settlement_violations(orders: DataFrame) -> DataFrame:
    """Settled status, settlement outcome and settlement time must come together."""
    issues = F.expr(
        """array_compact(array(
            CASE WHEN (settled_at_ms IS NULL) <> (settlement IS NULL) THEN 'time and outcome differ' END,
            CASE WHEN status = 'settled' AND settlement IS NULL THEN 'settled without outcome' END,
            CASE WHEN status <> 'settled' AND settlement IS NOT NULL THEN 'outcome without settled status' END))"""
    )
    return orders.select("order_id", issues.alias("violations")).filter(F.size("violations") > 0)
