"""Multi-bookmaker consensus in exact millionths.

Quotes are validated and normalized once per quote, before any fan-out; everything that
depends on the moment of observation (freshness, preferred outcome set, medians) is a
row-local array computation over the at most one current quote per bookmaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PROBABILITY_SCALE, SELECTION_VERSION, ConsensusConfig, MarketSelection
from tidemark.functions import canonical as cj
from tidemark.functions.scans import Running, chunk_of, running
from tidemark.functions.staging import stage
from tidemark.schemas import event_order

VECTOR_CODES = (
    "empty_outcome_vector",
    "duplicate_outcome",
    "missing_reported_probability",
    "nonpositive_probability_sum",
)


def quote_vectors(events: DataFrame) -> DataFrame:
    """One row per odds event that carries probabilities (payload version 2)."""
    odds = F.col("odds")
    return events.filter((F.col("kind") == "odds.observed") & (F.col("payload_version") == 2)).select(
        "fixture_id",
        odds["market"]["market_id"].alias("market_id"),
        odds["bookmaker"]["id"].alias("bookmaker_id"),
        odds["bookmaker"]["name"].alias("bookmaker_name"),
        "event_id",
        F.col("source_timestamp_ms").alias("observed_at_ms"),
        F.transform(
            odds["outcomes"],
            lambda o: F.struct(
                o["outcome_id"].alias("outcome_id"),
                o["name"].alias("name"),
                o["reported_probability_micros"].alias("reported_micros"),
            ),
        ).alias("outcomes"),
        event_order().alias("ord"),
    )


def vector_diagnostic(outcomes: str) -> str:
    """First failing validity code of a quote vector, or null."""
    total = f"aggregate({outcomes}, 0L, (a, o) -> a + coalesce(o.reported_micros, 0L))"
    return f"""CASE
        WHEN size({outcomes}) < 2 THEN '{VECTOR_CODES[0]}'
        WHEN size(array_distinct({outcomes}.outcome_id)) <> size({outcomes}) THEN '{VECTOR_CODES[1]}'
        WHEN exists({outcomes}, o -> o.reported_micros IS NULL) THEN '{VECTOR_CODES[2]}'
        WHEN {total} <= 0 THEN '{VECTOR_CODES[3]}' END"""


def apportion(parts: str) -> str:
    """Scale ``parts`` (structs with ``outcome_id``, ``name``, ``micros``) to exactly one million.

    Largest remainders win the leftover units, ties go to the smaller outcome id.  The
    result is ordered by outcome id.  One-element transforms bind a value once.
    """
    scale = PROBABILITY_SCALE
    shares = f"""transform({parts}, p -> named_struct('outcome_id', p.outcome_id, 'name', p.name, 'micros', p.micros,
        'units', p.micros * {scale}L div total, 'rest', p.micros * {scale}L % total))"""
    winners = f"""slice(sort_array(transform(s, p -> struct(-p.rest AS r, p.outcome_id AS id))), 1,
        cast({scale}L - aggregate(s, 0L, (a, p) -> a + p.units) AS int)).id"""
    allocated = """sort_array(transform(s, p -> named_struct('outcome_id', p.outcome_id, 'name', p.name,
        'micros', p.micros, 'probability_micros',
        p.units + CASE WHEN array_contains(winners, p.outcome_id) THEN 1L ELSE 0L END)))"""
    bind_winners = f"transform(array({winners}), winners -> {allocated})[0]"
    bind_shares = f"transform(array({shares}), s -> {bind_winners})[0]"
    total = f"greatest(aggregate({parts}, 0L, (a, p) -> a + p.micros), 1L)"
    return f"transform(array({total}), total -> {bind_shares})[0]"


def normalize_vectors(quotes: DataFrame) -> DataFrame:
    """Add validity, sum, overround, outcome-set signature and the normalized vector."""
    parts = """transform(outcomes, o -> named_struct('outcome_id', o.outcome_id, 'name', o.name,
        'micros', o.reported_micros))"""
    checked = quotes.withColumn("code", F.expr(vector_diagnostic("outcomes")))
    with_vector = checked.withColumn("vector", F.expr(f"CASE WHEN code IS NULL THEN {apportion(parts)} END"))
    total = "aggregate(vector, 0L, (a, p) -> a + p.micros)"
    return with_vector.withColumns(
        {
            "reported_sum_micros": F.expr(total),
            "overround_micros": F.expr(f"{total} - {PROBABILITY_SCALE}L"),
            "signature": F.expr("array_join(vector.outcome_id, '|')"),
        }
    )


def normalized_outcomes(quotes: DataFrame) -> DataFrame:
    """Long form of `normalize_vectors`: one row per outcome of every quote."""
    return normalize_vectors(quotes).select(
        "market_id",
        "bookmaker_id",
        "event_id",
        "observed_at_ms",
        "code",
        "reported_sum_micros",
        "overround_micros",
        F.explode_outer("vector").alias("o"),
    ).select(
        "market_id",
        "bookmaker_id",
        "event_id",
        "observed_at_ms",
        "code",
        "reported_sum_micros",
        "overround_micros",
        F.col("o.outcome_id").alias("outcome_id"),
        F.col("o.micros").alias("reported_micros"),
        F.col("o.probability_micros").alias("probability_micros"),
    )


def _quote_struct() -> Column:
    """Compact current quote; comparing two of them compares (time, event id)."""
    return F.struct("observed_at_ms", "event_id", "bookmaker_id", "code", "signature", "vector")


def latest_by_bookmaker(quotes: DataFrame) -> DataFrame:
    """Latest quote per (market, bookmaker) by (observation time, event id)."""
    columns = [c for c in quotes.columns if c not in ("market_id", "bookmaker_id")]
    newest = F.max_by(F.struct(*columns), F.struct("observed_at_ms", "event_id")).alias("q")
    return quotes.groupBy("market_id", "bookmaker_id").agg(newest).select("market_id", "bookmaker_id", "q.*")


def freshness(quotes: DataFrame, at_ms: Column, config: ConsensusConfig) -> DataFrame:
    """Label each quote `fresh`, `stale_quote` or `future_quote` at ``at_ms``."""
    age = at_ms - F.col("observed_at_ms")
    label = (
        F.when(age < 0, F.lit("future_quote")).when(age > config.stale_after_ms, F.lit("stale_quote")).otherwise("fresh")
    )
    return quotes.withColumns({"freshness": label, "age_ms": F.when(label == "fresh", age)})


def preferred_signature(fresh: str) -> str:
    """Outcome set shared by most fresh quotes; ties go to the smallest signature."""
    counted = f"struct(-size(filter({fresh}, q -> q.signature = s)) AS n, s AS s)"
    return f"get(sort_array(transform(array_distinct({fresh}.signature), s -> {counted})), 0).s"


def assemble_snapshots(df: DataFrame, config: ConsensusConfig) -> DataFrame:
    """Turn rows of (``market_id``, ``t``, ``latest`` array of current quotes) into snapshots.

    Deltas need the previous snapshot and are added by `finish_snapshots`.
    """
    limit = f"{config.stale_after_ms}L"
    in_time = f"t - q.observed_at_ms BETWEEN 0 AND {limit}"
    by_bookmaker = """sort_array(transform(latest, q -> named_struct('bookmaker_id', q.bookmaker_id,
        'event_id', q.event_id, 'observed_at_ms', q.observed_at_ms, 'code', q.code, 'signature', q.signature,
        'vector', q.vector)))"""
    timed = df.withColumn("latest", F.expr(by_bookmaker)).withColumns(
        {
            "fresh": F.expr(f"filter(latest, q -> {in_time} AND q.code IS NULL)"),
            "stale_bookmaker_count": F.expr(f"size(filter(latest, q -> t - q.observed_at_ms > {limit}))"),
        }
    )
    chosen = timed.withColumn("chosen", F.expr(preferred_signature("fresh"))).withColumn(
        "preferred", F.expr("filter(fresh, q -> q.signature = chosen)")
    )
    label = f"""CASE WHEN t < q.observed_at_ms THEN 'future_quote' WHEN t - q.observed_at_ms > {limit} THEN 'stale_quote'
        WHEN q.code IS NOT NULL THEN q.code WHEN q.signature <> chosen THEN 'outcome_set_mismatch' END"""
    diagnostics = f"""sort_array(filter(transform(latest, q -> named_struct('code', {label},
        'bookmaker_id', q.bookmaker_id, 'event_id', q.event_id)), d -> d.code IS NOT NULL))"""
    # quotes of the preferred set list the same outcome ids in the same order
    component = """transform(array(sort_array(transform(preferred, q -> q.vector[i].probability_micros))), v ->
        named_struct('outcome_id', p.outcome_id, 'name', p.name, 'values', v,
        'micros', (v[cast((size(v) - 1) div 2 AS int)] + v[cast(size(v) div 2 AS int)]) div 2))[0]"""
    medians = f"""CASE WHEN size(preferred) >= {config.min_fresh_bookmakers}
        THEN transform(preferred[0].vector, (p, i) -> {component}) END"""
    middled = chosen.withColumns({"medians": F.expr(medians), "diagnostics": F.expr(diagnostics)})
    ready = "coalesce(aggregate(medians, 0L, (a, m) -> a + m.micros) > 0, false)"
    degenerate = "array(named_struct('code', 'degenerate_median', 'bookmaker_id', '', 'event_id', ''))"
    judged = middled.withColumns(
        {
            "status": F.expr(f"CASE WHEN {ready} THEN 'ready' ELSE 'insufficient' END"),
            "apportioned": F.expr(f"CASE WHEN {ready} THEN {apportion('medians')} END"),
            "diagnostics": F.expr(
                f"CASE WHEN medians IS NOT NULL AND NOT {ready} THEN sort_array(concat(diagnostics, {degenerate})) "
                "ELSE diagnostics END"
            ),
        }
    )
    base_outcome = """transform(array(sort_array(transform(medians[i].values, v -> abs(v - p.micros)))), g ->
        named_struct('outcome_id', p.outcome_id, 'name', p.name, 'probability_micros', p.probability_micros,
        'dispersion_micros', (g[cast((size(g) - 1) div 2 AS int)] + g[cast(size(g) div 2 AS int)]) div 2))[0]"""
    empty = """cast(array() AS ARRAY<STRUCT<outcome_id: STRING, name: STRING, probability_micros: BIGINT,
        dispersion_micros: BIGINT>>)"""
    ages = "transform(fresh, q -> t - q.observed_at_ms)"
    return judged.selectExpr(
        *[c for c in df.columns if c != "latest"],
        "status",
        "size(fresh) AS fresh_bookmaker_count",
        "size(preferred) AS valid_bookmaker_count",
        "stale_bookmaker_count",
        "size(latest) AS total_bookmaker_count",
        f"""(2L * stale_bookmaker_count * {PROBABILITY_SCALE} + greatest(size(latest), 1))
            div (2 * greatest(size(latest), 1)) AS stale_ppm""",
        f"array_min({ages}) AS freshest_age_ms",
        f"array_max({ages}) AS oldest_fresh_age_ms",
        "diagnostics",
        "sort_array(preferred.event_id) AS quote_event_ids",
        f"coalesce(transform(apportioned, (p, i) -> {base_outcome}), {empty}) AS base_outcomes",
    )


def finish_snapshots(df: DataFrame, config: ConsensusConfig, previous: str | None = None) -> DataFrame:
    """Add deltas, velocities and the content-addressed id; ``previous`` as in `chain_snapshots`."""
    return identify_snapshots(chain_snapshots(df, previous), config)


def chain_snapshots(df: DataFrame, previous: str | None = None) -> DataFrame:
    """Add deltas and velocities.

    ``previous`` names a struct column (status, t, base_outcomes) of the preceding snapshot
    of the market; it counts only when it was ready.
    """
    if previous is None:
        base = df.selectExpr("*", "cast(NULL AS bigint) AS prev_t", "slice(base_outcomes, 1, 0) AS prev")
    else:
        usable = f"{previous}.status = 'ready'"
        base = df.selectExpr(
            "*",
            f"CASE WHEN {usable} THEN {previous}.t END AS prev_t",
            f"CASE WHEN {usable} THEN {previous}.base_outcomes END AS prev",
        )
    before = "get(filter(prev, b -> b.outcome_id = o.outcome_id), 0).probability_micros"
    outcome = f"""transform(array(o.probability_micros - {before}), d -> named_struct(
        'outcome_id', o.outcome_id, 'name', o.name, 'probability_micros', o.probability_micros,
        'dispersion_micros', o.dispersion_micros, 'delta_micros', d,
        'velocity_micros_per_s', CASE WHEN t > prev_t THEN d * 1000L div (t - prev_t) END))[0]"""
    full = base.withColumn("outcomes", F.expr(f"transform(base_outcomes, o -> {outcome})"))
    return full.drop("prev_t", "prev", "base_outcomes")


def identify_snapshots(df: DataFrame, config: ConsensusConfig, time: str = "t") -> DataFrame:
    """Add the content-addressed id; ``time`` names the snapshot's own time."""
    configuration = cj.obj(
        {
            "formulaVersion": cj.plain(cj.literal(config.formula_version)),
            "minFreshBookmakers": f"'{config.min_fresh_bookmakers}'",
            "staleAfterMs": f"'{config.stale_after_ms}'",
        }
    )
    diagnostic = cj.obj(
        {
            "bookmakerId": cj.text("d.bookmaker_id"),
            "code": cj.plain("d.code"),
            "eventId": cj.text("d.event_id"),
        }
    )
    outcome_json = cj.obj(
        {
            "deltaMicros": cj.scalar("o.delta_micros"),
            "dispersionMadMicros": cj.scalar("o.dispersion_micros"),
            "name": cj.text("o.name"),
            "outcomeId": cj.text("o.outcome_id"),
            "probabilityMicros": cj.scalar("o.probability_micros"),
            "velocityMicrosPerSecond": cj.scalar("o.velocity_micros_per_s"),
        }
    )
    identity = cj.obj(
        {
            "configuration": configuration,
            "diagnostics": cj.items("diagnostics", "d", diagnostic),
            "formulaVersion": cj.plain(cj.literal(config.formula_version)),
            "logicalTimestampMs": cj.scalar(time),
            "marketId": cj.text("market_id"),
            "outcomes": cj.items("outcomes", "o", outcome_json),
            "quoteEventIds": cj.items("quote_event_ids", "e", cj.text("e")),
            "status": cj.plain("status"),
        }
    )
    return df.withColumn("consensus_id", F.expr(cj.short_id("cns_", identity)))


def _current_quotes(quotes: DataFrame, config: ConsensusConfig, probes: DataFrame | None = None) -> DataFrame:
    """For every quote (trigger) the current quote of each bookmaker of its market.

    Work is keyed by (market, chunk): the last quote of each bookmaker before the chunk
    comes in as a row of its own ahead of the chunk, so no task ever holds the whole history
    of a market.  A bookmaker has a numbered seat in its market and a trigger one column a
    seat, so quotes are not repeated for every bookmaker before they are sorted.  With
    ``probes`` (market_id, event_id, fixture_id, ord, t) these are the triggers instead, and
    only chunks that hold one are looked at.
    """
    chunked = quotes.withColumn("chunk", chunk_of(F.col("observed_at_ms"), config.chunk_ms))
    q = stage(
        normalize_vectors(chunked.filter("market_id IS NOT NULL AND chunk IS NOT NULL")).select(
            "fixture_id",
            "market_id",
            "bookmaker_id",
            "event_id",
            "ord",
            F.col("observed_at_ms").alias("t"),
            "chunk",
            _quote_struct().alias("quote"),
        )
    )
    # one row per bookmaker of a market
    seat = F.row_number().over(Window.partitionBy("market_id").orderBy("bookmaker_id")) - 1
    books = stage(q.select("market_id", "bookmaker_id").distinct().withColumn("seat", seat))
    seats = (books.agg(F.max("seat")).first()[0] or 0) + 1
    newest = F.max_by("quote", F.struct("quote.observed_at_ms", "quote.event_id")).alias("chunk_quote")
    per_chunk = q.groupBy("market_id", "bookmaker_id", "chunk").agg(newest)
    chunks = q.select("market_id", "chunk").distinct()
    if probes is not None:
        asked = probes.withColumn("chunk", chunk_of(F.col("t"), config.chunk_ms))
        asked = asked.join(books.select("market_id").distinct(), "market_id", "left_semi")
        wanted = asked.select("market_id", "chunk").distinct()
        chunks = chunks.unionByName(wanted).distinct()
        q = q.join(wanted, ["market_id", "chunk"], "left_semi").unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("market_id", "bookmaker_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.join(books, "market_id")
        .join(per_chunk, ["market_id", "bookmaker_id", "chunk"], "left")
        .select("market_id", "chunk", "seat", F.last("chunk_quote", ignorenulls=True).over(before).alias("quote"))
        .filter("quote IS NOT NULL")
    )
    if probes is not None:
        carried = carried.join(wanted, ["market_id", "chunk"], "left_semi")
    seated = q.join(books, ["market_id", "bookmaker_id"], "left").withColumn("is_trigger", F.lit(True))
    rows = seated.unionByName(carried.withColumn("is_trigger", F.lit(False)), allowMissingColumns=True)
    in_order = Window.partitionBy("market_id", "chunk").orderBy("ord")  # carried rows have no order and come first
    so_far = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    current = rows.select(
        "market_id", "chunk", "event_id", "fixture_id", "ord", "t", "bookmaker_id", "seat", "is_trigger",
        F.count(F.lit(1)).over(in_order.rangeBetween(Window.currentRow, Window.currentRow)).alias("copies"),
        F.lag("ord").over(in_order).eqNullSafe(F.col("ord")).alias("is_copy"),
        F.array(*[F.max(F.when(F.col("seat") == i, F.col("quote"))).over(so_far) for i in range(seats)]).alias("by_seat"),
    ).filter("is_trigger AND NOT is_copy")
    if probes is not None:
        current = current.filter("bookmaker_id IS NULL")
    latest = F.array_compact("by_seat")
    own = F.get("by_seat", "seat")
    return current.select(
        "market_id",
        "chunk",
        "event_id",
        "fixture_id",
        "ord",
        "t",
        # an event that comes twice counts twice
        F.when(F.col("copies") == 1, latest).otherwise(F.flatten(F.array_repeat(latest, F.col("copies").cast("int")))).alias("latest"),
        (F.col("seat").isNotNull() & F.coalesce(own["event_id"] != F.col("event_id"), F.lit(False))).alias("superseded"),
    )


#: What a snapshot was made of; its id needs them, its features do not.
PROVENANCE = ("diagnostics", "quote_event_ids")


def consensus_trace(events: DataFrame, config: ConsensusConfig) -> DataFrame:
    """Running consensus: one observation per odds event, in event order.

    A quote that is not newer than its bookmaker's current one repeats the market's last
    snapshot and is flagged ``superseded``.
    """
    return identify_snapshots(consensus_observations(events, config), config, "snapshot_t")


def consensus_observations(events: DataFrame, config: ConsensusConfig, provenance: bool = True) -> DataFrame:
    """`consensus_trace` without ids and, unless ``provenance``, without what only they need."""
    columns = ["market_id", "chunk", "event_id", "fixture_id", "ord", "t", "superseded"]
    triggers = _current_quotes(quote_vectors(events), config)
    assembled = assemble_snapshots(triggers, config)
    observed = stage(assembled if provenance else assembled.drop(*PROVENANCE))
    fresh = observed.filter(~F.col("superseded"))
    previous = Running("previous", "last", F.struct("status", "t", "base_outcomes"), inclusive=False)
    chained = running(fresh, ["market_id"], "ord", "chunk", [previous])
    snapshots = chain_snapshots(chained, "previous").drop("previous")
    payload = [c for c in snapshots.columns if c not in columns]
    observations = snapshots.select(*columns, F.col("t").alias("snapshot_t"), *payload)
    if observed.filter("superseded").isEmpty():
        return observations
    repeats = observed.filter("superseded").select(*columns)
    marks = observed.select("market_id", "chunk", "event_id", "ord", "superseded")
    sources = running(
        marks,
        ["market_id"],
        "ord",
        "chunk",
        [Running("source_event_id", "last", F.when(~F.col("superseded"), F.col("event_id")))],
    ).filter("superseded")
    repeated = (
        repeats.join(sources.select("market_id", "event_id", "source_event_id"), ["market_id", "event_id"])
        .join(
            snapshots.select(
                "market_id", F.col("event_id").alias("source_event_id"), F.col("t").alias("source_t"), *payload
            ),
            ["market_id", "source_event_id"],
        )
        .select(*columns, F.col("source_t").alias("snapshot_t"), *payload)
    )
    return observations.unionByName(repeated)


def probed_consensus(
    quotes: DataFrame, trace: DataFrame, probes: DataFrame, config: ConsensusConfig
) -> DataFrame:
    """The consensus of a market at the moments of other events: a snapshot per probe.

    ``probes``: (market_id, event_id, fixture_id, ord, t), unique per (market, event).  Each sees the
    current quotes of all earlier events, aged to its own time; deltas are against the last
    observation of ``trace`` (the result of `consensus_trace`) before it.
    """
    seen = assemble_snapshots(_current_quotes(quotes, config, probes), config).drop("superseded")
    last = F.struct(
        "status",
        F.col("snapshot_t").alias("t"),
        F.transform(
            "outcomes", lambda o: F.struct(*[o[n].alias(n) for n in ("outcome_id", "name", "probability_micros", "dispersion_micros")])
        ).alias("base_outcomes"),
    )
    marks = trace.filter("NOT superseded").select("market_id", "chunk", "ord", last.alias("seen"))
    asked = seen.select("market_id", "chunk", "ord", "event_id").withColumn("seen", F.lit(None).cast(marks.schema["seen"].dataType))
    before = running(
        marks.withColumn("event_id", F.lit(None).cast("string")).unionByName(asked),
        ["market_id"], "ord", "chunk", [Running("previous", "last", F.col("seen"), inclusive=False)],
    ).filter("event_id IS NOT NULL")
    chained = seen.join(before.select("market_id", "event_id", "previous"), ["market_id", "event_id"])
    return finish_snapshots(chained, config, "previous").drop("previous")


def consensus_at(quotes: DataFrame, at_ms: int, config: ConsensusConfig, ignore_later: bool = False) -> DataFrame:
    """Point-in-time consensus of every market over the latest quote per bookmaker at ``at_ms``.

    A bookmaker that quoted only later is reported as `future_quote`, or left out with
    ``ignore_later``; then a market whose every quote is later has no row.  Only the chosen
    quotes are normalized.
    """
    on_time = F.col("observed_at_ms") <= at_ms
    asked = quotes.filter(on_time) if ignore_later else quotes
    columns = [c for c in quotes.columns if c not in ("market_id", "bookmaker_id")]
    newest = F.max_by(F.struct(*columns), F.struct(on_time, "observed_at_ms", "event_id")).alias("q")
    known = asked.groupBy("market_id", "bookmaker_id").agg(newest).select("market_id", "bookmaker_id", "q.*")
    latest = normalize_vectors(known).select("market_id", *_latest_columns())
    grouped = latest.groupBy("market_id").agg(F.collect_list(_quote_struct()).alias("latest"))
    return finish_snapshots(assemble_snapshots(grouped.withColumn("t", F.lit(at_ms).cast("long")), config), config)


def _latest_columns() -> list[str]:
    return ["bookmaker_id", "observed_at_ms", "event_id", "code", "signature", "vector"]


def snapshot_outcomes(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("market_id", "event_id", "t", "consensus_id", F.explode("outcomes").alias("o")).select(
        "market_id", "event_id", "t", "consensus_id", "o.*"
    )


def snapshot_diagnostics(snapshots: DataFrame) -> DataFrame:
    """Diagnostics in long form, one row per rejected quote of a snapshot."""
    return snapshots.select(
        "market_id", F.col("event_id").alias("trigger_event_id"), "consensus_id", F.explode("diagnostics").alias("d")
    ).select("market_id", "trigger_event_id", "consensus_id", "d.code", "d.bookmaker_id", F.col("d.event_id").alias("quote_event_id"))


def max_delta(left: Column, right: Column) -> Column:
    """Largest outcome distance of two arrays ordered by outcome id; null unless the sets agree."""
    ids = lambda a: F.transform(a, lambda o: o["outcome_id"])
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a["probability_micros"] - b["probability_micros"]))
    return F.when((F.size(left) > 0) & (ids(left) == ids(right)), F.array_max(gaps))


def reaction_latency(signals: DataFrame, quotes: DataFrame, threshold_micros: int) -> DataFrame:
    """First material reaction of each bookmaker to a signal.

    ``signals``: (signal_id, market_id, signal_t, baseline_status, baseline_outcomes).  Every
    bookmaker that ever quoted the market stays in the result; those that never reacted carry
    nulls, and a baseline that is not ready gives `baseline_not_ready`.
    """
    first = signals.groupBy("market_id").agg(F.min("signal_t").alias("first_signal_t"))
    asked = quotes.join(first, "market_id")
    books = asked.groupBy("market_id", "bookmaker_id").agg(F.max("observed_at_ms").alias("last_quote_ms"))
    later = asked.filter(F.col("observed_at_ms") >= F.col("first_signal_t")).drop("first_signal_t")
    vectors = normalize_vectors(later).select("market_id", *_latest_columns())
    everyone = signals.join(books, "market_id")
    candidate = (
        (F.col("q.observed_at_ms") >= F.col("s.signal_t"))
        & F.col("q.code").isNull()
        & (F.col("s.baseline_status") == "ready")
    )
    moved = (
        signals.alias("s")
        .join(vectors.alias("q"), (F.col("s.market_id") == F.col("q.market_id")) & candidate)
        .filter(max_delta(F.col("s.baseline_outcomes"), F.col("q.vector")) >= threshold_micros)
        .groupBy("s.signal_id", "q.bookmaker_id")
        .agg(F.min(F.struct("q.observed_at_ms", "q.event_id")).alias("first"))
    )
    joined = everyone.join(moved, ["signal_id", "bookmaker_id"], "left")
    return joined.select(
        "signal_id",
        "market_id",
        "bookmaker_id",
        F.col("first.event_id").alias("first_reaction_event_id"),
        (F.col("first.observed_at_ms") - F.col("signal_t")).alias("latency_ms"),
        F.when(F.col("baseline_status") == "ready", F.lit("measured")).otherwise(F.lit("baseline_not_ready")).alias("status"),
    )


def select_core_market(candidates: DataFrame, selection: MarketSelection, scope: str = "fixture_id") -> DataFrame:
    """Rank the eligible covered markets inside each ``scope``; rank 1 is the selected one.

    ``candidates``: snapshot columns plus market_type, in_running and outcome_count.
    """
    ranks = F.lit(len(selection.preferred_types))
    for position, name in enumerate(selection.preferred_types):
        ranks = F.when(F.col("market_type") == name, F.lit(position)).otherwise(ranks)
    eligible = candidates.filter(
        (F.col("status") == "ready")
        & (F.col("valid_bookmaker_count") >= selection.min_valid_bookmakers)
        & (F.col("outcome_count") >= 2)
    )
    if selection.require_in_running:
        eligible = eligible.filter("in_running")
    order = [ranks, F.desc("valid_bookmaker_count"), F.asc("stale_ppm"), F.asc("market_id")]
    # one row per market of a fixture: the window holds a fixture's market list, not its events
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    return eligible.withColumns(
        {"selection_rank": rank, "selected": rank == 1, "selection_version": F.lit(SELECTION_VERSION)}
    )
