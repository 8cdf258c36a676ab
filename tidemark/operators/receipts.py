"""Hash-addressed decision receipts and their verification lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canonical as cj
from tidemark.functions.integers import div
from tidemark.functions.scans import Running, running
from tidemark.operators.dedup import with_decision_hash

# --- fixed values -----------------------------------------------------------------
VERIFICATION_STATUSES = ("pending", "verified", "rejected", "unavailable", "error")
CHAIN_FIELDS = (
    "attempted_at_ms", "explorer_account_url", "explorer_program_url", "kind", "network", "program_id",
    "proof_material_hash", "proof_reference", "root_account", "simulation_slot", "source_event_id",
    "source_message_id", "source_timestamp_ms",
)
# ----------------------------------------------------------------------------------
#: Columns of a receipt that its hash, its evidence and its cited decision account for.
HASHED = ("payload_hash", "evidence_event_ids", "trigger_event_id", "fixture_id", "market_id")


def _citations(decisions: DataFrame) -> DataFrame:
    ids = F.array_distinct(F.concat(F.array("trigger_event_id"), "evidence_event_ids"))
    return decisions.select("decision_id", F.explode(ids).alias("event_id"))


def receipt_evidence(decisions: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cited events of each decision, and the citations whose event is not stored."""
    keys = "array_distinct(score.stats.key)"
    facts = events.select(
        "event_id",
        "kind",
        "source",
        F.col("source_id").alias("source_message_id"),
        "source_timestamp_ms",
        F.expr(
            f"CASE WHEN kind = 'score.observed' THEN CASE WHEN array_contains({keys}, 1L) THEN 1L ELSE array_min({keys}) END END"
        ).alias("score_stat_key"),
    )
    joined = _citations(decisions).join(facts, "event_id", "left")
    found = joined.filter("kind IS NOT NULL")
    missing = joined.filter("kind IS NULL").select("decision_id", F.col("event_id").alias("missing_event_id"))
    return found, missing


def _evidence_json() -> str:
    return cj.obj(
        {
            "eventId": cj.text("e.event_id"),
            "kind": cj.plain("e.kind"),
            "scoreStatKey": cj.scalar("e.score_stat_key"),
            "source": cj.plain("e.source"),
            "sourceMessageId": cj.text("e.source_message_id"),
            "sourceTimestampMs": cj.scalar("e.source_timestamp_ms"),
        }
    )


def receipts(decisions: DataFrame, evidence: DataFrame, policies: dict | None = None) -> DataFrame:
    """One pending receipt per decision; ``decisions`` carry `decision_json` (see dedup).

    With ``policies`` it is rendered here, after the join, which then carries no documents.
    A decision cites at most a hundred events, so gathering them per decision is bounded.
    """
    item = F.struct("event_id", "kind", "score_stat_key", "source", "source_message_id", "source_timestamp_ms")
    gathered = evidence.groupBy("decision_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    joined = decisions.join(gathered, "decision_id")
    if policies is not None:
        joined = with_decision_hash(joined, policies)
    payload = cj.obj({"decision": "decision_json", "evidence": cj.items("evidence", "e", _evidence_json())})
    hashed = joined.withColumn("payload_hash", F.expr(cj.digest(payload)))
    return hashed.select(
        F.expr("concat('rcpt_', substring(payload_hash, 1, 40))").alias("receipt_id"),
        "decision_id",
        "fixture_id",
        "market_id",
        "trigger_event_id",
        "evidence_event_ids",
        "decision_json",
        "evidence",
        "payload_hash",
        F.col("logical_timestamp_ms").alias("created_at_ms"),
        F.lit("pending").alias("status"),
        F.lit(0).cast("long").alias("attempt_count"),
        F.col("logical_timestamp_ms").alias("updated_at_ms"),
    )


def receipt_violations(rows: DataFrame) -> DataFrame:
    """Evidence unique, sorted and cited; payload hash and receipt id recomputed."""
    payload = cj.obj({"decision": "decision_json", "evidence": cj.items("evidence", "e", _evidence_json())})
    issues = f"""array_compact(array(
        CASE WHEN size(array_distinct(evidence.event_id)) <> size(evidence) THEN 'evidence repeats' END,
        CASE WHEN evidence.event_id <> sort_array(evidence.event_id) THEN 'evidence not sorted' END,
        CASE WHEN size(array_except(evidence.event_id, array_union(evidence_event_ids, array(trigger_event_id)))) > 0
            THEN 'evidence not cited' END,
        CASE WHEN exists(evidence, e -> e.kind <> 'score.observed' AND e.score_stat_key IS NOT NULL)
            THEN 'stat key on non-score evidence' END,
        CASE WHEN payload_hash <> {cj.digest(payload)} THEN 'payload hash' END,
        CASE WHEN receipt_id <> concat('rcpt_', substring(payload_hash, 1, 40)) THEN 'receipt id' END))"""
    return rows.withColumn("violations", F.expr(issues)).filter(F.size("violations") > 0).select("receipt_id", "violations")


def pending_receipts(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` pending receipts that wait longest."""
    return rows.filter("status = 'pending'").orderBy("updated_at_ms", "receipt_id").limit(n)


def proof_coordinates(rows: DataFrame) -> DataFrame:
    """Where to fetch the proof of each receipt: odds evidence first, then score evidence.

    The trigger wins, else the newest evidence, else the smallest id.  The at most hundred
    items of a receipt are compared inside its row.
    """
    usable = "e.source <> 'simulation' AND e.source_timestamp_ms IS NOT NULL"
    rank = "struct(e.event_id <> trigger_event_id AS a, -e.source_timestamp_ms AS b, e.event_id AS c, e AS e)"
    fixture_part, seq_part = "split_part(e.source_message_id, ':', 1)", "split_part(e.source_message_id, ':', 2)"
    shaped = rf"""e.source_message_id RLIKE r'^\d{{1,15}}:\d{{1,15}}$' AND try_cast({seq_part} AS bigint) >= 1
        AND cast(try_cast({fixture_part} AS bigint) AS string) = fixture_id AND e.score_stat_key IS NOT NULL"""
    odds = f"get(sort_array(transform(filter(evidence, e -> e.kind = 'odds.observed' AND {usable}), e -> {rank})), 0).e"
    score = f"get(sort_array(transform(filter(evidence, e -> e.kind = 'score.observed' AND {usable} AND {shaped}), e -> {rank})), 0).e"
    return rows.withColumns({"o": F.expr(odds), "s": F.expr(score)}).selectExpr(
        "receipt_id",
        "decision_id",
        "CASE WHEN o IS NOT NULL THEN 'odds' WHEN s IS NOT NULL THEN 'score' ELSE 'unavailable' END AS proof_kind",
        "coalesce(o.event_id, s.event_id) AS source_event_id",
        "coalesce(o.source_message_id, s.source_message_id) AS source_message_id",
        "coalesce(o.source_timestamp_ms, s.source_timestamp_ms) AS source_timestamp_ms",
        "CASE WHEN o IS NULL THEN try_cast(split_part(s.source_message_id, ':', 2) AS bigint) END AS sequence",
        "CASE WHEN o IS NULL THEN s.score_stat_key END AS stat_key",
    )


def judge_updates(updates: DataFrame) -> DataFrame:
    """Flag verification updates that move attempt or time back or change the proof material.

    ``updates`` carry `update_seq`; each is compared with all earlier updates of its receipt.
    """
    chunked = updates.withColumn("__chunk", div(F.col("update_seq"), 1000))
    compared = running(
        chunked,
        ["receipt_id"],
        "update_seq",
        "__chunk",
        [
            Running("__attempt", "max", F.col("attempt_count"), inclusive=False),
            Running("__time", "max", F.col("updated_at_ms"), inclusive=False),
            Running("__material", "first", F.col("proof_material_hash"), inclusive=False),
        ],
    )
    issues = F.expr(
        """array_compact(array(
            CASE WHEN attempt_count < __attempt THEN 'attempt moved backwards' END,
            CASE WHEN updated_at_ms < __time THEN 'time moved backwards' END,
            CASE WHEN proof_material_hash <> __material THEN 'conflicting material' END))"""
    )
    return compared.withColumn("violations", issues).drop("__attempt", "__time", "__material", "__chunk")


def merge_verifications(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """Receipts with their latest sound verification update; immutable columns stay."""
    fields = ["status", "attempt_count", "updated_at_ms", "proof_material_hash"]
    sound = judge_updates(updates).filter(F.size("violations") == 0)
    last = sound.groupBy("receipt_id").agg(F.max_by(F.struct(*fields), "update_seq").alias("u"))
    keep = [c for c in rows.columns if c not in fields]
    base = rows if "proof_material_hash" in rows.columns else rows.withColumn("proof_material_hash", F.lit(None).cast("string"))
    merged = base.join(last, "receipt_id", "left")
    return merged.select(*keep, *[F.coalesce(F.col(f"u.{c}"), F.col(c)).alias(c) for c in fields])


def verification_violations(verifications: DataFrame) -> DataFrame:
    """Fields that a verification status requires or forbids."""
    chained = ", ".join(
        f"CASE WHEN status IN ('verified', 'rejected') AND {c} IS NULL THEN '{c} required' END" for c in CHAIN_FIELDS
    )
    issues = f"""array_compact(array(
        CASE WHEN status NOT IN {VERIFICATION_STATUSES} THEN 'unknown status' END,
        CASE WHEN status = 'pending' AND completed_at_ms IS NOT NULL THEN 'pending but completed' END,
        CASE WHEN status <> 'pending' AND completed_at_ms IS NULL THEN 'completed_at_ms required' END,
        CASE WHEN status = 'error' AND error_code IS NULL THEN 'error_code required' END,
        CASE WHEN attempt_count < 0 THEN 'negative attempts' END, {chained}))"""
    return verifications.withColumn("violations", F.expr(issues)).filter(F.size("violations") > 0).select("receipt_id", "violations")


def proof_summary(verifications: DataFrame) -> DataFrame:
    """Outcome counts of a proof run."""
    return verifications.groupBy("status").agg(F.count(F.lit(1)).alias("receipts"))


def proof_material_violations(materials: DataFrame) -> DataFrame:
    """Proof materials whose fixture or time lies outside their batch summary."""
    issues = F.expr(
        """array_compact(array(
            CASE WHEN fixture_id <> summary_fixture_id THEN 'fixture differs from batch summary' END,
            CASE WHEN summary_fixture_id < 0 THEN 'negative fixture' END,
            CASE WHEN ts < min_timestamp OR ts > max_timestamp THEN 'time outside batch summary' END))"""
    )
    return materials.withColumn("violations", issues).filter(F.size("violations") > 0).select("material_id", "violations")
