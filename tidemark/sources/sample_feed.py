"""A deterministic in-play feed derived from the `events` table.

The test tables hold no odds, so each row of `events` becomes one odds or one score
observation by integer arithmetic alone; see FIXTURES.md section 6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ConsensusConfig, FeedLabels, RiskPolicy
from tidemark.functions import canonical as cj
from tidemark.functions.integers import div
from tidemark.functions.staging import spread
from tidemark.schemas import DETAILS_DDL, FIXTURE_DDL, ODDS_DDL, SCORE_DDL

LABELS = FeedLabels()

# The feed's events are hours apart, so the limits are wider than the defaults.
CONSENSUS = ConsensusConfig(min_fresh_bookmakers=2, stale_after_ms=86_400_000)
POLICY = RiskPolicy(
    critical_shock_hold_ms=13_824_000,
    minimum_fresh_bookmakers=1,
    minimum_pause_ms=3_456_000,
    minimum_widened_ms=3_456_000,
    pause_dispersion_micros=90_000,
    pause_quote_age_ms=86_400_000,
    pause_reaction_latency_ms=69_120_000,
    pause_stale_bookmaker_fraction_ppm=900_000,
    pause_velocity_micros_per_second=60,
    recovery_cooldown_ms=5_184_000,
    recovery_dispersion_micros=55_000,
    recovery_quote_age_ms=79_000_000,
    recovery_stable_updates=2,
    recovery_stale_bookmaker_fraction_ppm=650_000,
    recovery_velocity_micros_per_second=12,
    reversal_shock_hold_ms=3_456_000,
    widen_dispersion_micros=60_000,
    widen_quote_age_ms=80_000_000,
    widen_reaction_latency_ms=25_920_000,
    widen_stale_bookmaker_fraction_ppm=700_000,
    widen_velocity_micros_per_second=15,
)

# --- fixed values: action text by k % 13 ----------------------------------------
ACTIONS_BY_K = (
    "possible",
    "goal",
    "penalty",
    "penalty_outcome",
    "red_card",
    "var",
    "var_end",
    "action_discarded",
    "action_amend",
    "score_adjustment",
    "suspend",
    "disconnected",
    "corner",
)
# --------------------------------------------------------------------------------


def _pick(index: Column, *choices) -> Column:
    return F.get(F.array(*[F.lit(c) if not isinstance(c, Column) else c for c in choices]), index.cast("int"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table with the derived integer columns `t`, `k`, `v`."""
    scan = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return spread(scan, "event_id").select(
        F.col("event_id").alias("n"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
        (F.col("user_id") % 12).cast("string").alias("fixture_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 24).cast("string")).alias("market_id"),
    )


def _is_odds() -> Column:
    return F.col("event_type").isin("view", "click", "purchase")


def _micros() -> tuple[Column, Column, Column]:
    home = F.lit(300_000) + (F.col("v") * 7) % 200_000
    draw = F.lit(200_000) + (F.col("n") * 7919) % 150_000
    away = F.lit(1_000_000) - home - draw + F.col("k") * 100
    return home, draw, away


def _odds_struct() -> Column:
    home, draw, away = _micros()

    def outcome(name: str, micros: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(name).alias("outcome_id"),
            F.col("v").alias("price"),
            micros.cast("long").alias("reported_probability_micros"),
        )

    with_draw = F.array(
        outcome("home", home), outcome("draw", F.when(F.col("k") != 97, draw)), outcome("away", away)
    )
    without_draw = F.array(outcome("home", home), outcome("away", away))
    book = (F.col("k") % 5).cast("string")
    return F.struct(
        F.col("fixture_id"),
        F.struct(F.concat(F.lit("b"), book).alias("id"), F.concat(F.lit("Book "), book).alias("name")).alias(
            "bookmaker"
        ),
        F.struct(
            F.lit("in_play").alias("game_state"),
            F.lit(True).alias("in_running"),
            F.col("market_id"),
            F.lit(None).cast("string").alias("parameters"),
            F.lit("full_time").alias("period"),
            F.lit("open").alias("status"),
            F.lit("1X2").alias("type"),
        ).alias("market"),
        F.when(F.col("k") == 98, without_draw).otherwise(with_draw).alias("outcomes"),
    ).cast(ODDS_DDL)


def _score_struct() -> Column:
    k, j = F.col("k"), div(F.col("k"), 13)
    is_error = F.col("event_type") == "error"
    action = F.when(is_error, _pick(k % 13, *ACTIONS_BY_K)).otherwise(F.lit("status"))
    flag = j % 4
    possible = action == "possible"
    details = F.struct(
        F.lit(None).cast("string").alias("amended_action"),
        F.when(action == "penalty_outcome", _pick(j % 3, "Scored", "Missed", "Retake"))
        .when(action == "var_end", _pick(j % 3, "Stands", "Overturned", F.lit(None).cast("string")))
        .alias("outcome"),
        F.struct(
            *[
                F.when(possible, flag == i).alias(n)
                for i, n in enumerate(("goal", "penalty", "red_card", "review"))
            ]
        ).alias("possible"),
        F.lit(None).cast("string").alias("referenced_action_id"),
        F.when(action == "suspend", j % 2 == 0).alias("reliable"),
        F.when(action == "var", _pick(flag, "Goal", "Penalty", "RedCard", "Other")).alias("review_type"),
    ).cast(DETAILS_DDL)
    home, away = F.col("v") % 4, F.col("k") % 3
    stats = F.array(
        F.struct(F.lit(1).alias("key"), F.lit(0).alias("period"), home.alias("value")),
        F.struct(F.lit(2).alias("key"), F.lit(0).alias("period"), away.alias("value")),
    )
    return F.struct(
        F.col("fixture_id"),
        action.alias("action"),
        away.alias("away_score"),
        home.alias("home_score"),
        F.lit(None).cast("long").alias("period"),
        stats.alias("stats"),
        F.when(~is_error, F.lit(1) + k % 19).alias("status_id"),
        F.col("n").cast("string").alias("action_id"),
        _pick(k % 3, F.lit(True), F.lit(False), F.lit(None).cast("boolean")).alias("confirmed"),
        details.alias("details"),
    ).cast(SCORE_DDL)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized odds and score events of the sample feed."""
    odds = _is_odds()
    version = F.lit(2)
    kind = F.when(odds, F.lit("odds.observed")).otherwise(F.lit("score.observed"))
    source_id = F.when(odds, F.col("n").cast("string")).otherwise(
        F.concat_ws(":", "fixture_id", F.col("n").cast("string"))
    )
    keyed = base(spark, sf_dir).select(
        "*",
        kind.alias("kind"),
        source_id.alias("source_id"),
    ).withColumn("idempotency_key", F.expr(cj.event_key(cj.literal(LABELS.live), "kind", "source_id", "2")))
    return keyed.select(
        F.expr(cj.event_id("idempotency_key")).alias("event_id"),
        "idempotency_key",
        "fixture_id",
        "kind",
        version.cast("int").alias("payload_version"),
        F.lit(LABELS.live).alias("source"),
        "source_id",
        F.lit(LABELS.priorities[LABELS.live]).cast("int").alias("source_priority"),
        F.col("t").alias("source_timestamp_ms"),
        F.col("t").alias("received_at_ms"),
        F.when(odds, F.lit(0)).otherwise(F.col("n")).cast("long").alias("sequence"),
        F.lit(None).cast(FIXTURE_DDL).alias("fixture"),
        F.when(odds, _odds_struct()).alias("odds"),
        F.when(~odds, _score_struct()).alias("score"),
    )


# --- the same feed as raw JSON text, with planted bad records ------------------------

LONG_DIGITS = "99999999999999999999"
COMPETITIONS = ("World Cup", "League", "Friendly world cup warm-up", "Cup")


def _json_number_list(*columns: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[c.cast("string") for c in columns]), F.lit("]"))


def _pct(micros: Column) -> Column:
    """Micros as percent text with three decimals; null as NA."""
    tenths = div(micros, 10)
    whole = div(tenths, 1000).cast("string")
    return F.coalesce(F.concat(whole, F.lit("."), F.lpad((tenths % 1000).cast("string"), 3, "0")), F.lit("NA"))


def _odds_json(price: Column, short: Column, long_pct: Column, long_price: Column) -> Column:
    home, draw, away = _micros()
    draw = F.when(F.col("k") != 97, draw)
    quoted = lambda *cs: F.concat(F.lit('["'), F.concat_ws('","', *cs), F.lit('"]'))
    full_prices, cut_prices = _json_number_list(price, price + 1, price + 2), _json_number_list(price, price + 1)
    book = (F.col("k") % 5).cast("string")
    return F.concat(
        F.lit('{"Bookmaker":"Book '),
        book,
        F.lit('","BookmakerId":'),
        book,
        F.lit(',"FixtureId":'),
        F.col("fixture_id"),
        F.lit(',"GameState":"in_play","InRunning":true,"MarketParameters":"'),
        F.col("market_id"),
        F.lit('","MarketPeriod":"full_time","MessageId":"'),
        F.col("n").cast("string"),
        F.lit('","Pct":'),
        quoted(F.when(long_pct, F.lit(LONG_DIGITS + ".000")).otherwise(_pct(home)), _pct(draw), _pct(away)),
        F.lit(',"PriceNames":["home","draw","away"],"Prices":'),
        F.when(short, cut_prices).when(long_price, _json_number_list(F.lit(LONG_DIGITS), price + 1, price + 2)).otherwise(full_prices),
        F.lit(',"SuperOddsType":"1X2","Ts":'),
        F.col("t").cast("string"),
        F.lit("}"),
    )


def _score_json(long_key: Column) -> Column:
    """Match events: errors in the UpperCase dialect, status changes in the lowerCase one."""
    n, k, j = F.col("n").cast("string"), F.col("k"), div(F.col("k"), 13)
    home, away = (F.col("v") % 4).cast("string"), (k % 3).cast("string")
    flag = F.when(k % 3 == 0, F.lit("true")).otherwise(F.lit("false"))
    said = F.when(k % 3 == 2, F.lit("")).otherwise(F.concat(F.lit('"Confirmed":'), flag, F.lit(",")))
    said_low = F.when(k % 3 == 2, F.lit("")).otherwise(F.concat(F.lit('"confirmed":'), flag, F.lit(",")))
    data = F.concat(
        F.lit('{"Goal":'),
        (j % 4 == 0).cast("string"),
        F.lit(',"Id":'),
        (F.col("n") + 1).cast("string"),
        F.lit(',"Outcome":"'),
        _pick(j % 3, "Scored", "Overturned", "Stands"),
        F.lit('","Reliable":'),
        (j % 2 == 0).cast("string"),
        F.lit("}"),
    )
    upper = F.concat(
        F.lit('{"Action":"'), _pick(k % 13, *ACTIONS_BY_K), F.lit('",'), said, F.lit('"Data":'), data,
        F.lit(',"FixtureId":'), F.col("fixture_id"), F.lit(',"Id":'), n, F.lit(',"Seq":'), n,
        F.lit(',"Stats":[{"Key":1,"Period":0,"Value":'), home, F.lit('},{"Key":2,"Period":0,"Value":'), away,
        F.lit('}],"Ts":'), F.col("t").cast("string"), F.lit("}"),
    )
    lower = F.concat(
        F.lit('{"action":"status",'), said_low, F.lit('"fixtureId":'), F.col("fixture_id"), F.lit(',"followsAction":'), n,
        F.lit(',"parti1StateSoccer":{"PossibleEvent":{"Goal":'), (j % 2 == 0).cast("string"),
        F.lit('}},"parti2StateSoccer":{"PossibleEvent":{"Goal":true,"Penalty":false}},"period":null,'),
        F.lit('"possibleEventSoccer":{"RedCard":false,"VAR":true},"seq":'), n,
        F.lit(',"stats":{"1":'), home, F.lit(',"1001":'), home, F.lit(',"2":'), away,
        F.when(long_key, F.lit(f',"{LONG_DIGITS}":1')).otherwise(F.lit("")), F.lit('},"statusSoccerId":"'),
        _pick(k % 4, "H1", " h2 ", "HT", "??"), F.lit('","ts":'), F.col("t").cast("string"), F.lit("}"),
    )
    return F.when(F.col("event_type") == "error", upper).otherwise(lower)


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw odds and score records; `arrival` orders them, copies come right after.

    Planted by n % 50: 0 loses its last price, 1 repeats, 2 repeats with another price,
    3 has an unknown kind, 4 a percent, 7 a price and 6 a statistic key of twenty digits, 5 a
    price beyond 32 bits, which is kept.
    """
    mod, odds = F.col("n") % 50, _is_odds()
    repeats = (mod == 1) | ((mod == 2) & odds)
    copies = F.when(repeats, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base(spark, sf_dir).withColumn("copy", F.explode(copies))
    price = F.col("v") + F.when(mod == 2, F.col("copy") * 10).when(mod == 5, F.lit(3_000_000_000)).otherwise(F.lit(0))
    kind = F.when(mod == 3, F.lit("weather")).when(odds, F.lit("odds")).otherwise(F.lit("score"))
    return rows.select(
        (F.col("n") * 2 + F.col("copy")).alias("arrival"),
        kind.alias("payload_kind"),
        F.lit(None).cast("int").alias("payload_version"),
        F.lit(LABELS.live).alias("source"),
        F.col("t").alias("received_at_ms"),
        F.lit(None).cast("long").alias("sequence"),
        F.when(odds, _odds_json(price, mod == 0, mod == 4, mod == 7)).otherwise(_score_json(mod == 6)).alias("payload"),
    )


def raw_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture observations derived from `orders`: one per order, for twelve fixtures."""
    scan = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = spread(scan, "o_orderkey").select(
        F.col("o_orderkey").alias("n"),
        (F.col("o_custkey") % 12).alias("f"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("d"),
    )
    text_ = lambda c: c.cast("string")
    payload = F.concat(
        F.lit('{"Competition":"'), _pick(F.col("f") % 4, *COMPETITIONS), F.lit('","CompetitionId":'), text_(F.col("f") % 4),
        F.lit(',"FixtureId":'), text_(F.col("f")), F.lit(',"GameState":'), text_(F.col("n") % 7),
        F.lit(',"Participant1":"Side '), text_(F.col("f") * 2), F.lit('","Participant1Id":'), text_(F.col("f") * 2),
        F.lit(',"Participant1IsHome":'), text_(F.col("n") % 2 == 0),
        F.lit(',"Participant2":"Side '), text_(F.col("f") * 2 + 1), F.lit('","Participant2Id":'), text_(F.col("f") * 2 + 1),
        F.lit(',"StartTime":'), text_(F.col("d") + F.col("f") * 3_600_000), F.lit(',"Ts":'), text_(F.col("d") + F.col("n")),
        F.lit("}"),
    )
    return orders.select(
        F.col("n").alias("arrival"),
        F.lit("fixture").alias("payload_kind"),
        F.lit(1).alias("payload_version"),
        F.lit(LABELS.snapshot).alias("source"),
        (F.col("d") + F.col("n")).alias("received_at_ms"),
        F.lit(None).cast("long").alias("sequence"),
        payload.alias("payload"),
    )


def order_requests(spark: SparkSession, sf_dir: str, decisions: DataFrame) -> DataFrame:
    """Order requests from click rows; each quotes its market's first decision.

    By k % 10: 0 asks right after that decision with a fresh quote, 1 right before it.
    """
    first = decisions.groupBy("market_id").agg(
        F.min_by("decision_id", "expected_state_version").alias("expected_decision_id"), F.min("logical_timestamp_ms").alias("first_ms")
    )
    mod, first_ms = F.col("k") % 10, F.col("first_ms")
    requested = F.when(mod == 0, first_ms + 1).when(mod == 1, first_ms - 1)
    quoted = F.when(mod == 0, first_ms).when(mod == 1, first_ms - 1)
    clicks = base(spark, sf_dir).filter("event_type = 'click'").join(first, "market_id", "left")
    return clicks.select(
        "market_id",
        "fixture_id",
        F.concat(F.lit("order-"), F.col("n").cast("string")).alias("idempotency_key"),
        F.lit("live").alias("namespace"),
        _pick(F.col("k") % 3, "home", "draw", "away").alias("outcome_id"),
        F.col("v").alias("price"),
        F.coalesce(quoted, F.col("t") - F.col("k") * 60_000).alias("quote_observed_at_ms"),
        F.coalesce(requested, F.col("t") + 1_800_000).alias("requested_at_ms"),
        F.when(F.col("k") % 2 == 0, F.lit("back")).otherwise(F.lit("lay")).alias("side"),
        (F.col("v") * 10_000 + 1).alias("stake_micros"),
        "expected_decision_id",
        F.lit(1).cast("long").alias("expected_state_version"),
    )
