"""Plain-SQL (DuckDB) equivalents of the named queries, written independently of the library.

Each query is a chain of named table expressions over the given tables; `_sql` picks the
ones a final SELECT needs.
"""

from __future__ import annotations

import re

NOW_MS, MID_MS = 1_706_659_200_000, 1_705_276_800_000
STALE, MIN_BOOKS = 86_400_000, 2

# policy: critical hold, reversal hold, min pause, min widened, cooldown, stable updates, configuration hash
_BASE = {
    "criticalShockHoldMs": 13_824_000, "minimumFreshBookmakers": 1, "minimumPauseMs": 3_456_000, "minimumWidenedMs": 3_456_000,
    "pauseDispersionMicros": 90_000, "pauseQuoteAgeMs": 86_400_000, "pauseReactionLatencyMs": 69_120_000,
    "pauseStaleBookmakerFractionPpm": 900_000, "pauseVelocityMicrosPerSecond": 60, "recoveryCooldownMs": 5_184_000,
    "recoveryDispersionMicros": 55_000, "recoveryQuoteAgeMs": 79_000_000, "recoveryStableUpdates": 2,
    "recoveryStaleBookmakerFractionPpm": 650_000, "recoveryVelocityMicrosPerSecond": 12, "reversalShockHoldMs": 3_456_000,
    "widenDispersionMicros": 60_000, "widenQuoteAgeMs": 80_000_000, "widenReactionLatencyMs": 25_920_000,
    "widenStaleBookmakerFractionPpm": 700_000, "widenVelocityMicrosPerSecond": 15,
}


def _policy_json(**changes: int) -> str:
    values = _BASE | changes
    return "{" + ",".join(f'"{k}":{values[k]}' for k in sorted(values)) + "}"


POLICY_JSON = {
    "base": _policy_json(),
    "short_hold": _policy_json(criticalShockHoldMs=6_912_000),
    "slow_reopen": _policy_json(recoveryStableUpdates=4),
}

CTES: dict[str, str] = {}
CTES["feed"] = """SELECT event_id AS n, epoch_us(ts) // 1000 AS t, user_id, event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS v,
    CAST(user_id % 12 AS VARCHAR) AS fixture_id, 'm' || (user_id % 24) AS market_id,
    event_type IN ('view', 'click', 'purchase') AS is_odds FROM events"""
CTES["micros"] = """SELECT *, 300000 + (v * 7) % 200000 AS home, 200000 + (n * 7919) % 150000 AS draw FROM feed"""
CTES["keyed"] = """SELECT *, 'evt_' || substr(sha256('"' || ekey || '"'), 1, 40) AS event_id FROM (
    SELECT *, 'event|4:live|' || length(kind) || ':' || kind || '|' || length(source_id) || ':' || source_id || '|1:2' AS ekey FROM (
        SELECT *, CASE WHEN is_odds THEN 'odds.observed' ELSE 'score.observed' END AS kind,
            CASE WHEN is_odds THEN CAST(n AS VARCHAR) ELSE fixture_id || ':' || n END AS source_id,
            CASE WHEN is_odds THEN 0 ELSE n END AS sequence FROM micros))"""
CTES["q"] = """SELECT event_id, market_id, fixture_id, t, 'b' || (k % 5) AS bookmaker_id, outcome_id, v AS price, m FROM (
    SELECT *, 'home' AS outcome_id, home AS m FROM keyed WHERE is_odds
    UNION ALL SELECT *, 'draw', CASE WHEN k <> 97 THEN draw END FROM keyed WHERE is_odds AND k <> 98
    UNION ALL SELECT *, 'away', 1000000 - home - draw + k * 100 FROM keyed WHERE is_odds)"""
CTES["qv"] = """SELECT event_id, any_value(market_id) AS market_id, any_value(fixture_id) AS fixture_id, any_value(t) AS t,
    any_value(bookmaker_id) AS bookmaker_id, CASE WHEN count(*) < 2 THEN 'empty_outcome_vector'
        WHEN count(m) < count(*) THEN 'missing_reported_probability' END AS code,
    CAST(sum(m) AS BIGINT) AS total, string_agg(outcome_id, '|' ORDER BY outcome_id) AS sig FROM q GROUP BY event_id"""
CTES["norm"] = """SELECT event_id, market_id, bookmaker_id, t, outcome_id, m, total, base +
    CASE WHEN rk <= 1000000 - CAST(sum(base) OVER (PARTITION BY event_id) AS BIGINT) THEN 1 ELSE 0 END AS p FROM (
        SELECT q.*, v.total, m * 1000000 // v.total AS base,
            row_number() OVER (PARTITION BY event_id ORDER BY m * 1000000 % v.total DESC, outcome_id) AS rk
        FROM q JOIN qv v USING (event_id) WHERE v.code IS NULL)"""


def _snapshots(triggers: str, prefix: str) -> None:
    """Snapshot tables for a set of triggers (trig, market_id, tt)."""
    p = prefix
    CTES[f"{p}grid"] = f"""SELECT a.trig, a.market_id, a.tt, c.event_id, c.bookmaker_id, c.t AS qt, c.code AS vcode, c.sig
        FROM (SELECT tr.trig, tr.market_id, tr.tt, b.bookmaker_id FROM ({triggers}) tr
            JOIN (SELECT DISTINCT market_id, bookmaker_id FROM qv) b USING (market_id)) a
        ASOF JOIN qv c ON a.market_id = c.market_id AND a.bookmaker_id = c.bookmaker_id AND a.tt >= c.t"""
    CTES[f"{p}fresh"] = f"SELECT * FROM {p}grid WHERE tt - qt <= {STALE} AND vcode IS NULL"
    CTES[f"{p}pref"] = f"""SELECT trig, sig FROM (SELECT trig, sig, row_number() OVER (PARTITION BY trig ORDER BY c DESC, sig) AS r
        FROM (SELECT trig, sig, count(*) AS c FROM {p}fresh GROUP BY ALL)) WHERE r = 1"""
    CTES[f"{p}use"] = f"SELECT f.* FROM {p}fresh f JOIN {p}pref USING (trig, sig)"
    CTES[f"{p}diag"] = f"""SELECT g.trig, g.market_id, CASE WHEN tt - qt > {STALE} THEN 'stale_quote' WHEN vcode IS NOT NULL THEN vcode
        WHEN g.sig <> p.sig THEN 'outcome_set_mismatch' END AS code, g.bookmaker_id, g.event_id
        FROM {p}grid g LEFT JOIN {p}pref p USING (trig)"""
    CTES[f"{p}head"] = f"""SELECT g.trig, any_value(g.market_id) AS market_id, any_value(tt) AS tt, count(*) AS total_books,
        count(*) FILTER (tt - qt > {STALE}) AS stale_books,
        count(*) FILTER (tt - qt <= {STALE} AND vcode IS NULL) AS fresh_books,
        count(*) FILTER (tt - qt <= {STALE} AND vcode IS NULL AND g.sig = p.sig) AS valid_books,
        min(tt - qt) FILTER (tt - qt <= {STALE} AND vcode IS NULL) AS youngest,
        max(tt - qt) FILTER (tt - qt <= {STALE} AND vcode IS NULL) AS oldest
        FROM {p}grid g LEFT JOIN {p}pref p USING (trig) GROUP BY g.trig"""
    CTES[f"{p}med"] = f"""SELECT u.trig, n.outcome_id, CAST(floor(median(n.p)) AS BIGINT) AS med, list(n.p) AS ps
        FROM {p}use u JOIN norm n USING (event_id) JOIN {p}head h USING (trig) WHERE h.valid_books >= {MIN_BOOKS} GROUP BY ALL"""
    CTES[f"{p}out0"] = f"""SELECT trig, outcome_id, base + CASE WHEN rk <= 1000000 - CAST(sum(base) OVER (PARTITION BY trig) AS BIGINT)
            THEN 1 ELSE 0 END AS p, mad FROM (
        SELECT m.trig, outcome_id, med * 1000000 // s AS base,
            row_number() OVER (PARTITION BY m.trig ORDER BY med * 1000000 % s DESC, outcome_id) AS rk,
            CAST(floor(list_median(list_transform(ps, lambda x: abs(x - med)))) AS BIGINT) AS mad
        FROM {p}med m JOIN (SELECT trig, CAST(sum(med) AS BIGINT) AS s FROM {p}med GROUP BY trig) USING (trig))""".replace(
        "list_median(", "list_aggregate("
    ).replace("abs(x - med))))", "abs(x - med)), 'median'))")
    CTES[f"{p}snap"] = f"""SELECT *, CASE WHEN valid_books >= {MIN_BOOKS} THEN 'ready' ELSE 'insufficient' END AS status,
        (2 * stale_books * 1000000 + total_books) // (2 * total_books) AS ppm,
        lag(trig) OVER (PARTITION BY market_id ORDER BY tt) AS prev_trig, lag(tt) OVER (PARTITION BY market_id ORDER BY tt) AS prev_t
        FROM {p}head"""
    CTES[f"{p}out"] = f"""SELECT o.trig, s.market_id, o.outcome_id, o.p, o.mad, o.p - b.p AS delta,
        CASE WHEN s.tt > s.prev_t AND b.p IS NOT NULL THEN sign(o.p - b.p) * (abs(o.p - b.p) * 1000 // (s.tt - s.prev_t)) END AS vel
        FROM {p}out0 o JOIN {p}snap s USING (trig) LEFT JOIN {p}out0 b ON b.trig = s.prev_trig AND b.outcome_id = o.outcome_id"""
    js = "coalesce(CAST({} AS VARCHAR), 'null')"
    CTES[f"{p}ids"] = f"""SELECT s.*, 'cns_' || substr(sha256(
        '{{"configuration":{{"formulaVersion":"reported-pct-proportional-median-v1","minFreshBookmakers":{MIN_BOOKS},"staleAfterMs":{STALE}}},"diagnostics":['
        || coalesce(d.j, '') || '],"formulaVersion":"reported-pct-proportional-median-v1","logicalTimestampMs":' || s.tt
        || ',"marketId":"' || s.market_id || '","outcomes":[' || coalesce(o.j, '') || '],"quoteEventIds":[' || coalesce(u.j, '')
        || '],"status":"' || s.status || '"}}'), 1, 40) AS consensus_id
        FROM {p}snap s
        LEFT JOIN (SELECT trig, string_agg('{{"bookmakerId":"' || bookmaker_id || '","code":"' || code || '","eventId":"' || event_id || '"}}',
            ',' ORDER BY code, bookmaker_id, event_id) AS j FROM {p}diag WHERE code IS NOT NULL GROUP BY trig) d USING (trig)
        LEFT JOIN (SELECT trig, string_agg('{{"deltaMicros":' || {js.format('delta')} || ',"dispersionMadMicros":' || mad || ',"name":"'
            || outcome_id || '","outcomeId":"' || outcome_id || '","probabilityMicros":' || p || ',"velocityMicrosPerSecond":'
            || {js.format('CAST(vel AS BIGINT)')} || '}}', ',' ORDER BY outcome_id) AS j FROM {p}out GROUP BY trig) o USING (trig)
        LEFT JOIN (SELECT trig, string_agg('"' || event_id || '"', ',' ORDER BY event_id) AS j FROM {p}use GROUP BY trig) u USING (trig)"""
    CTES[f"{p}feat"] = f"""SELECT s.trig, s.market_id, s.tt, s.status, s.fresh_books, s.oldest, s.ppm,
        CAST(max(abs(o.vel)) AS BIGINT) AS vel, max(o.mad) AS mad FROM {p}snap s LEFT JOIN {p}out o USING (trig) GROUP BY ALL"""


_snapshots("SELECT event_id AS trig, market_id, t AS tt FROM qv", "t_")
_snapshots(f"SELECT DISTINCT market_id AS trig, market_id, {MID_MS} AS tt FROM qv WHERE t <= {MID_MS}", "n_")

CTES["sc"] = """SELECT *, CASE WHEN event_type = 'error' THEN ['possible','goal','penalty','penalty_outcome','red_card','var','var_end',
        'action_discarded','action_amend','score_adjustment','suspend','disconnected','corner'][k % 13 + 1] ELSE 'status' END AS action,
    k // 13 AS j, ['confirmed','unconfirmed','unknown'][k % 3 + 1] AS conf,
    CASE WHEN event_type <> 'error' THEN 1 + k % 19 END AS status_id FROM keyed WHERE NOT is_odds"""
CTES["sig"] = """SELECT *, CASE
        WHEN kind2 IN ('normal', 'coverage_recovered') THEN 'none' WHEN kind2 = 'phase_change' THEN 'widen' ELSE 'pause' END AS prot,
    CASE WHEN kind2 = 'normal' THEN 'none' WHEN kind2 IN ('coverage_recovered', 'phase_change') THEN 'low'
        WHEN kind2 IN ('penalty_missed', 'var_overturned', 'var_stands', 'action_discarded', 'action_amended') THEN 'high' ELSE 'critical' END AS sev,
    CASE WHEN kind2 = 'normal' THEN 'not_applicable' WHEN kind2 LIKE 'possible%' THEN 'unconfirmed'
        WHEN kind2 IN ('var_overturned', 'action_discarded') THEN 'reversal' WHEN kind2 = 'action_amended' THEN 'amendment'
        WHEN kind2 IN ('score_adjusted', 'coverage_recovered') OR (action = 'suspend') THEN 'confirmed' ELSE conf END AS conf2
    FROM (SELECT *, CASE action
        WHEN 'possible' THEN ['possible_goal','possible_penalty','possible_red_card','possible_var'][j % 4 + 1]
        WHEN 'goal' THEN 'goal' WHEN 'penalty' THEN 'penalty'
        WHEN 'penalty_outcome' THEN ['penalty_scored','penalty_missed','penalty'][j % 3 + 1]
        WHEN 'red_card' THEN 'red_card' WHEN 'var' THEN 'var_started'
        WHEN 'var_end' THEN ['var_stands','var_overturned','var_stands'][j % 3 + 1]
        WHEN 'action_discarded' THEN 'action_discarded' WHEN 'action_amend' THEN 'action_amended'
        WHEN 'score_adjustment' THEN 'score_adjusted'
        WHEN 'suspend' THEN CASE WHEN j % 2 = 0 THEN 'coverage_recovered' ELSE 'coverage_unreliable' END
        WHEN 'disconnected' THEN 'coverage_unreliable'
        WHEN 'status' THEN CASE WHEN status_id BETWEEN 14 AND 19 THEN 'phase_unsafe' ELSE 'phase_change' END
        ELSE 'normal' END AS kind2,
    CASE action
        WHEN 'possible' THEN 'EVENT_POSSIBLE_' || ['GOAL','PENALTY','RED_CARD','VAR'][j % 4 + 1]
        WHEN 'goal' THEN 'EVENT_GOAL' || CASE WHEN conf = 'unconfirmed' THEN '_UNCONFIRMED' ELSE '' END
        WHEN 'penalty' THEN 'EVENT_PENALTY' || CASE WHEN conf = 'unconfirmed' THEN '_UNCONFIRMED' ELSE '' END
        WHEN 'penalty_outcome' THEN 'EVENT_PENALTY_' || ['SCORED','MISSED','RETAKE'][j % 3 + 1]
        WHEN 'red_card' THEN 'EVENT_RED_CARD' || CASE WHEN conf = 'unconfirmed' THEN '_UNCONFIRMED' ELSE '' END
        WHEN 'var' THEN 'EVENT_VAR_' || ['GOAL','PENALTY','RED_CARD','OTHER'][j % 4 + 1]
        WHEN 'var_end' THEN 'EVENT_VAR_' || ['STANDS','OVERTURNED','ENDED'][j % 3 + 1]
        WHEN 'action_discarded' THEN 'EVENT_ACTION_DISCARDED' WHEN 'action_amend' THEN 'EVENT_ACTION_AMENDED'
        WHEN 'score_adjustment' THEN 'EVENT_SCORE_ADJUSTMENT'
        WHEN 'suspend' THEN CASE WHEN j % 2 = 0 THEN 'FEED_RELIABILITY_RESTORED' ELSE 'FEED_UNRELIABLE' END
        WHEN 'disconnected' THEN 'SCOUT_DISCONNECTED'
        WHEN 'status' THEN CASE WHEN status_id BETWEEN 14 AND 19 THEN 'MATCH_PHASE_UNSAFE' ELSE 'MATCH_PHASE_CHANGED' END
        ELSE 'SCORE_EVENT_NORMAL' END AS reason FROM sc)"""
CTES["inp"] = """SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY t, sequence, source_id) AS rn FROM (
    SELECT k.event_id, k.t, k.sequence, k.source_id, k.fixture_id, k.kind, f.market_id, f.status, f.fresh_books, f.oldest, f.ppm, f.vel, f.mad,
        s.prot, s.conf2, s.reason, s.kind2, s.sev
    FROM keyed k
    ASOF JOIN (SELECT e.fixture_id, f.* FROM t_feat f JOIN qv e ON e.event_id = f.trig) f ON k.fixture_id = f.fixture_id AND k.t >= f.tt
    LEFT JOIN sig s ON s.event_id = k.event_id)"""
_PAUSES = """list_filter([
        CASE WHEN status <> 'ready' OR fresh_books < 1 OR oldest IS NULL THEN 'MARKET_DATA_UNAVAILABLE'
             WHEN oldest >= 86400000 THEN 'QUOTE_AGE_PAUSE' END,
        CASE WHEN ppm >= 900000 THEN 'STALE_BOOKMAKER_QUORUM' END,
        CASE WHEN vel >= 60 THEN 'CONSENSUS_VELOCITY_PAUSE' END,
        CASE WHEN mad >= 90000 THEN 'CONSENSUS_DISPERSION_PAUSE' END], lambda x: x IS NOT NULL)"""
_WIDENS = """list_filter([
        CASE WHEN status = 'ready' AND fresh_books >= 1 AND oldest >= 80000000 AND oldest < 86400000 THEN 'QUOTE_AGE_WIDEN' END,
        CASE WHEN ppm >= 700000 AND ppm < 900000 THEN 'STALE_BOOKMAKER_WARNING' END,
        CASE WHEN vel >= 15 AND vel < 60 THEN 'CONSENSUS_VELOCITY_WIDEN' END,
        CASE WHEN mad >= 60000 AND mad < 90000 THEN 'CONSENSUS_DISPERSION_WIDEN' END], lambda x: x IS NOT NULL)"""
_HEALTHY = """coalesce(status = 'ready' AND fresh_books >= 1 AND oldest <= 79000000 AND ppm <= 650000
        AND coalesce(vel, 0) <= 12 AND coalesce(mad, 0) <= 55000, false)"""
CTES["judged"] = f"SELECT *, {_PAUSES} AS pr, {_WIDENS} AS wr, {_HEALTHY} AS healthy FROM inp"
_snapshots("SELECT event_id AS trig, market_id, t AS tt FROM inp WHERE kind = 'score.observed'", "e_")
CTES["e_snap"] = f"""SELECT h.*, CASE WHEN h.valid_books >= {MIN_BOOKS} THEN 'ready' ELSE 'insufficient' END AS status,
    (2 * h.stale_books * 1000000 + h.total_books) // (2 * h.total_books) AS ppm, s.trig AS prev_trig, s.tt AS prev_t
    FROM e_head h ASOF LEFT JOIN t_snap s ON s.market_id = h.market_id AND h.tt >= s.tt"""
CTES["e_out"] = CTES["e_out"].replace("LEFT JOIN e_out0 b", "LEFT JOIN t_out0 b")
CTES["einp"] = """SELECT i.* REPLACE (e.status AS status, e.fresh_books AS fresh_books, e.oldest AS oldest, e.ppm AS ppm, e.vel AS vel, e.mad AS mad)
    FROM inp i JOIN (SELECT * FROM e_feat UNION ALL SELECT * FROM t_feat) e ON e.trig = i.event_id"""
CTES["ejudged"] = f"SELECT *, {_PAUSES} AS pr, {_WIDENS} AS wr, {_HEALTHY} AS healthy FROM einp"
CTES["pol"] = " UNION ALL ".join(
    f"SELECT '{n}' AS policy_id, {6_912_000 if n == 'short_hold' else 13_824_000} AS hold, {4 if n == 'slow_reopen' else 2} AS need, "
    f"sha256('{j}') AS chash" for n, j in POLICY_JSON.items()
)


def _fold_tables(source: str, name: str, start: str | None = None) -> None:
    """The control fold as a recursion over row numbers, straight from the policy."""
    # state before the first row of a market: OPEN, or what `start` says
    entry = (
        "'OPEN' AS s0, i.t AS c0, CAST(0 AS BIGINT) AS n0, CAST(0 AS BIGINT) AS h0, CAST(0 AS BIGINT) AS v0"
        if start is None
        else "coalesce(z.s1, 'OPEN') AS s0, coalesce(z.c1, i.t) AS c0, coalesce(z.n1, 0) AS n0, coalesce(z.h1, 0) AS h0, coalesce(z.v0 + 1, 0) AS v0"
    )
    join = "" if start is None else f"LEFT JOIN ({start}) z ON z.market_id = i.market_id"
    shock = "CASE WHEN prot = 'pause' AND conf2 = 'reversal' THEN t + 3456000 WHEN prot = 'pause' THEN greatest(h0, t + hold) ELSE h0 END"
    step = f"""SELECT market_id, policy_id, rn, t, event_id, hold, need, chash, s0, c0, n0, h0, v0, h1, paused, s1,
            CASE WHEN s1 <> s0 THEN t ELSE c0 END AS c1,
            CASE WHEN s1 <> s0 THEN CASE WHEN s1 = 'RECOVERY' THEN 1 ELSE 0 END
                 WHEN s0 = 'RECOVERY' THEN CASE WHEN healthy THEN n0 + 1 ELSE 0 END WHEN s0 = 'PAUSED' THEN 0 ELSE n0 END AS n1
        FROM (SELECT *, CASE WHEN paused THEN 'PAUSED'
                WHEN s0 = 'OPEN' THEN CASE WHEN len(wr) > 0 OR prot = 'widen' THEN 'WIDENED' ELSE 'OPEN' END
                WHEN s0 = 'WIDENED' THEN CASE WHEN healthy AND t - c0 >= 3456000 THEN 'RECOVERY' ELSE 'WIDENED' END
                WHEN s0 = 'PAUSED' THEN CASE WHEN healthy AND t - c0 >= 3456000 THEN 'RECOVERY' ELSE 'PAUSED' END
                ELSE CASE WHEN healthy AND n0 + 1 >= need AND t - c0 >= 5184000 THEN 'OPEN' ELSE 'RECOVERY' END END AS s1
            FROM (SELECT *, coalesce(prot = 'pause', false) OR len(pr) > 0 OR h1 > t AS paused
                FROM (SELECT *, {shock} AS h1 FROM ({{}}))))"""
    cols = "i.market_id, i.rn, i.t, i.event_id, i.prot, i.conf2, i.pr, i.wr, i.healthy"
    first = step.format(f"SELECT {cols}, p.policy_id, p.hold, p.need, p.chash, {entry} FROM {source} i {join}, pol p WHERE i.rn = 1")
    more = step.format(
        f"SELECT {cols}, f.policy_id, f.hold, f.need, f.chash, f.s1 AS s0, f.c1 AS c0, f.n1 AS n0, f.h1 AS h0, f.v0 + 1 AS v0 "
        f"FROM {name}_r f JOIN {source} i ON i.market_id = f.market_id AND i.rn = f.rn + 1"
    )
    CTES[f"{name}_r"] = f"{first} UNION ALL {more}"
    CTES[name] = f"""SELECT r.*, i.fixture_id, i.kind, i.pr, i.wr, i.prot, i.reason, i.kind2, i.sev, i.conf2, i.status, i.fresh_books, i.oldest, i.ppm,
        i.vel, i.mad, i.sequence, i.source_id, CASE WHEN s0 = s1 THEN 'none' WHEN s1 = 'PAUSED' THEN 'pause' WHEN s1 = 'WIDENED' THEN 'widen'
            WHEN s1 = 'OPEN' THEN 'reopen' ELSE 'begin_recovery' END AS action,
        'dec_' || substr(sha256('decision|' || length(r.event_id) || ':' || r.event_id || '|' || length(r.market_id) || ':' || r.market_id
            || '|14:soccer-risk-v1|64:' || chash), 1, 40) AS decision_id
        FROM {name}_r r JOIN {source} i ON i.market_id = r.market_id AND i.rn = r.rn"""


_fold_tables("judged", "dec")
_DEC = """policy_id, decision_id, market_id, event_id, action, s0 AS previous_state, s1 AS next_state, v0 AS expected_state_version,
    array_to_string(list_filter(rs, lambda x, i: list_position(rs, x) = i), ',') AS reasons, n1 AS stable_updates, h1 AS shock_until_ms,
    c1 AS state_change_ms"""


def _reasoned(name: str) -> str:
    return f"""SELECT *, list_filter(list_concat([CASE WHEN prot = 'pause' THEN reason END], pr, [CASE WHEN h1 > t THEN 'EVENT_SHOCK_HOLD' END,
        CASE WHEN prot = 'widen' THEN reason END], wr, ['PROOF_NOT_READY_NON_BLOCKING', reason,
        CASE action WHEN 'begin_recovery' THEN 'RECOVERY_CONVERGENCE_STARTED' WHEN 'reopen' THEN 'RECOVERY_QUORUM_SATISFIED' END]),
        lambda x: x IS NOT NULL) AS rs FROM {name}"""


CTES["finp"] = """SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY t, sequence, source_id) AS rn FROM (
    SELECT k.event_id, k.t, k.sequence, k.source_id, k.fixture_id, k.kind, f.market_id, f.status, f.fresh_books, f.oldest, f.ppm, f.vel, f.mad,
        s.prot, s.conf2, s.reason, s.kind2, s.sev
    FROM (SELECT e.* EXCLUDE (market_id), m.market_id AS mid FROM keyed e JOIN (SELECT DISTINCT fixture_id, market_id FROM qv) m USING (fixture_id)
        WHERE NOT e.is_odds OR e.market_id = m.market_id) k
    ASOF JOIN t_feat f ON f.market_id = k.mid AND k.t >= f.tt
    LEFT JOIN sig s ON s.event_id = k.event_id)"""
CTES["fjudged"] = f"SELECT *, {_PAUSES} AS pr, {_WIDENS} AS wr, {_HEALTHY} AS healthy FROM finp"
_fold_tables("fjudged", "fan")
CTES["decr"] = _reasoned("dec")
_fold_tables("ejudged", "aged")
CTES["agedr"] = _reasoned("aged")
CTES["base"] = "SELECT * FROM decr WHERE policy_id = 'base'"
CTES["half"] = f"SELECT * FROM base WHERE t < {MID_MS}"
CTES["halfstate"] = "SELECT market_id, arg_max(struct_pack(s1, c1, n1, h1, v0, t), v0) AS z FROM half GROUP BY market_id"
CTES["later"] = f"""SELECT * REPLACE (row_number() OVER (PARTITION BY market_id ORDER BY t, sequence, source_id) AS rn)
    FROM judged WHERE t >= {MID_MS}"""
_fold_tables("later", "res", "SELECT market_id, z.s1, z.c1, z.n1, z.h1, z.v0 FROM halfstate")
CTES["resr"] = _reasoned("res")
CTES["ords"] = """SELECT o.*, 'ord_' || substr(rhash, 1, 40) AS order_id FROM (SELECT o.*, sha256('{"expectedDecisionId":"' || expected || '","expectedStateVersion":1,"fixtureId":"' || fixture_id
    || '","idempotencyKey":"' || ikey || '","marketId":"' || market_id || '","namespace":"live","outcomeId":"' || outcome_id || '","payloadVersion":1,"price":' || v
    || ',"quoteObservedAtMs":' || quoted || ',"requestedAtMs":' || requested || ',"side":"' || side || '","stakeMicros":' || (v * 10000 + 1) || '}') AS rhash
    FROM (SELECT f.*, 'order-' || n AS ikey, ['home','draw','away'][k % 3 + 1] AS outcome_id, CASE WHEN k % 10 < 2 AND d.t IS NOT NULL THEN d.t - k % 10 ELSE f.t - k * 60000 END AS quoted,
        CASE k % 10 WHEN 0 THEN coalesce(d.t + 1, f.t + 1800000) WHEN 1 THEN coalesce(d.t - 1, f.t + 1800000) ELSE f.t + 1800000 END AS requested,
        CASE WHEN k % 2 = 0 THEN 'back' ELSE 'lay' END AS side, d.decision_id AS expected
        FROM feed f LEFT JOIN (SELECT market_id, decision_id, t FROM base WHERE v0 = 0) d USING (market_id) WHERE event_type = 'click') o) o"""
CTES["adm"] = """SELECT *, CASE WHEN decision_id IS NULL THEN 'MARKET_NOT_INITIALIZED' WHEN s1 = 'PAUSED' THEN 'ORDER_REJECTED_PAUSED'
        WHEN s1 = 'RECOVERY' THEN 'ORDER_REJECTED_RECOVERY' WHEN s1 = 'WIDENED' THEN 'ORDER_STALE_WIDENED_REQUOTE_REQUIRED'
        WHEN expected <> decision_id OR v1 <> 1 THEN 'ORDER_STALE_STATE_VERSION'
        WHEN requested - quoted > 2000 THEN 'ORDER_STALE_QUOTE_AGE' ELSE 'ORDER_ACCEPTED_OPEN' END AS code FROM (
    SELECT o.*, d.decision_id, d.s1, d.v0 + 1 AS v1 FROM ords o
    ASOF LEFT JOIN (SELECT * FROM base) d ON o.market_id = d.market_id AND o.requested >= d.t)"""
CTES["psig"] = """SELECT fixture_id, arg_min(struct_pack(event_id, t, kind2, conf2), struct_pack(t, sequence, source_id)) AS s, count(*) AS c
    FROM sig WHERE prot <> 'none' GROUP BY fixture_id"""
CTES["asig"] = f"""SELECT fixture_id, arg_max(struct_pack(event_id, t, kind2, conf2), struct_pack(t, event_id)) AS s
    FROM sig WHERE prot = 'pause' AND t < {MID_MS} GROUP BY fixture_id"""
CTES["obs"] = "SELECT e.fixture_id, i.* FROM t_ids i JOIN qv e ON e.event_id = i.trig"
CTES["probe"] = """SELECT *, 'ord_' || substr(sha256('{"expectedDecisionId":"' || did || '","expectedStateVersion":' || version || ',"fixtureId":"' || fixture_id
        || '","idempotencyKey":"evaluation-paused-order","marketId":"' || market_id || '","namespace":"replay:evaluation","outcomeId":"' || outcome_id
        || '","payloadVersion":1,"price":2400,"quoteObservedAtMs":' || moment || ',"requestedAtMs":' || moment || ',"side":"back","stakeMicros":1000000}'), 1, 40) AS order_id
    FROM (SELECT d.fixture_id, d.policy_id, d.z.did AS did, d.z.v0 + 1 AS version, d.z.market_id AS market_id, v.outcome_id, CAST(v.p AS BIGINT) AS p, d.signal_t + 3000 AS moment
        FROM (SELECT a.fixture_id, dec.policy_id, any_value(a.s.t) AS signal_t, arg_min(struct_pack(did := decision_id, v0 := v0, market_id := market_id), dec.t) AS z
            FROM asig a JOIN dec ON dec.fixture_id = a.fixture_id AND dec.t >= a.s.t AND s1 = 'PAUSED' GROUP BY ALL) d
        JOIN (SELECT a.fixture_id, arg_max(q.event_id, q.t) AS event_id FROM asig a JOIN qv q ON q.fixture_id = a.fixture_id AND q.t < a.s.t GROUP BY a.fixture_id) l
            ON l.fixture_id = d.fixture_id
        JOIN (SELECT event_id, min(outcome_id) AS outcome_id, arg_min(p, outcome_id) AS p FROM norm GROUP BY event_id) v ON v.event_id = l.event_id)"""
for _name, _sig in (("pbase", "psig"), ("abase", "asig")):
    CTES[_name] = f"""SELECT o.fixture_id, any_value(g.s.t) AS signal_t,
        arg_max(struct_pack(trig, market_id, tt, status, consensus_id), struct_pack(tt, trig)) AS b
        FROM obs o JOIN {_sig} g ON g.fixture_id = o.fixture_id AND o.tt < g.s.t GROUP BY o.fixture_id"""
CTES["sets"] = "SELECT trig, count(*) AS c, string_agg(outcome_id, '|' ORDER BY outcome_id) AS sig FROM t_out0 GROUP BY trig"
CTES["cand"] = "SELECT a.fixture_id, a.signal_t, a.b.trig AS btrig, o.trig, o.tt FROM abase a JOIN obs o ON o.market_id = a.b.market_id AND o.tt >= a.signal_t"
CTES["after"] = """SELECT c.*, x.sig, CASE WHEN x.sig = y.sig THEN d.delta END AS delta FROM cand c LEFT JOIN sets x ON x.trig = c.trig
    LEFT JOIN sets y ON y.trig = c.btrig LEFT JOIN (SELECT c.fixture_id, c.trig, max(abs(n.p - b.p)) AS delta FROM cand c JOIN t_out0 n ON n.trig = c.trig
        JOIN t_out0 b ON b.trig = c.btrig AND b.outcome_id = n.outcome_id GROUP BY ALL) d ON d.fixture_id = c.fixture_id AND d.trig = c.trig"""
CTES["pairgap"] = """SELECT a.fixture_id, a.trig, max(abs(p.p - r.p)) AS gap, count(DISTINCT coalesce(w.sig, '')) AS sets_seen FROM after a
    JOIN after w ON w.fixture_id = a.fixture_id AND w.tt BETWEEN a.tt AND a.tt + 21600000
    LEFT JOIN t_out0 p ON p.trig = a.trig LEFT JOIN t_out0 r ON r.trig = w.trig AND r.outcome_id = p.outcome_id WHERE a.delta >= 30000 GROUP BY ALL"""
CTES["conv"] = """SELECT a.fixture_id, min(struct_pack(t := a.tt, id := a.trig)) AS c FROM after a JOIN pairgap g USING (fixture_id, trig)
    JOIN (SELECT fixture_id, max(tt) AS last_t FROM after GROUP BY 1) l USING (fixture_id)
    WHERE a.delta >= 30000 AND g.gap <= 60000 AND g.sets_seen = 1 AND l.last_t >= a.tt + 21600000 GROUP BY a.fixture_id"""
CTES["ends"] = "SELECT fixture_id, max(t) AS end_t FROM feed GROUP BY fixture_id"
CTES["paused"] = """SELECT d.fixture_id, policy_id, min(struct_pack(t := d.t, v := v0, id := decision_id)) AS p FROM dec d
    JOIN psig g ON g.fixture_id = d.fixture_id AND d.t >= g.s.t WHERE s1 = 'PAUSED' GROUP BY ALL"""
CTES["life"] = """SELECT p.fixture_id, p.policy_id, p.p.t AS paused_t, x.exit_t, x.reopened_t, coalesce(x.exit_t, e.end_t) - p.p.t AS pause_duration_ms, y.pause_total_ms
    FROM paused p JOIN ends e USING (fixture_id)
    LEFT JOIN (SELECT d.fixture_id, d.policy_id, min(d.t) FILTER (d.s1 <> 'PAUSED') AS exit_t,
        min(d.t) FILTER (d.s0 <> 'OPEN' AND d.s1 = 'OPEN') AS reopened_t FROM dec d JOIN paused p USING (fixture_id, policy_id) WHERE d.t > p.p.t GROUP BY ALL) x
        USING (fixture_id, policy_id)
    LEFT JOIN (SELECT d.fixture_id, policy_id, CAST(sum(coalesce(nt, end_t) - t) AS BIGINT) AS pause_total_ms
        FROM (SELECT *, lead(t) OVER (PARTITION BY policy_id, market_id ORDER BY v0) AS nt FROM dec) d JOIN ends USING (fixture_id)
        WHERE s1 = 'PAUSED' GROUP BY ALL) y USING (fixture_id, policy_id)"""

# --- the raw feed --------------------------------------------------------------------------
CTES["rawrows"] = """SELECT m.*, c.copy, n * 2 + c.copy AS arrival, CASE WHEN n % 50 = 3 THEN 'weather' WHEN is_odds THEN 'odds' ELSE 'score' END AS payload_kind,
    v + CASE WHEN n % 50 = 2 THEN c.copy * 10 WHEN n % 50 = 5 THEN 3000000000 ELSE 0 END AS price FROM micros m, (SELECT 0 AS copy UNION ALL SELECT 1) c
    WHERE c.copy = 0 OR n % 50 = 1 OR (n % 50 = 2 AND is_odds)"""
_PCT = "coalesce((({m}) // 10) // 1000 || '.' || lpad(CAST((({m}) // 10) % 1000 AS VARCHAR), 3, '0'), 'NA')"
_OJ = (
    """'{"Bookmaker":"Book ' || (k % 5) || '","BookmakerId":' || (k % 5) || ',"FixtureId":' || fixture_id || ',"GameState":"in_play","InRunning":true,"MarketParameters":"'
    || market_id || '","MarketPeriod":"full_time","MessageId":"' || n || '","Pct":["' || """
    + "CASE WHEN n % 50 = 4 THEN '99999999999999999999.000' ELSE " + _PCT.format(m="home") + """ END || '","' || """ + _PCT.format(m="CASE WHEN k <> 97 THEN draw END") + """ || '","' || """
    + _PCT.format(m="1000000 - home - draw + k * 100")
    + """ || '"],"PriceNames":["home","draw","away"],"Prices":[' || CASE WHEN n % 50 = 7 THEN '99999999999999999999' ELSE CAST(price AS VARCHAR) END || ',' || (price + 1) || CASE WHEN n % 50 = 0 THEN '' ELSE ',' || (price + 2) END
    || '],"SuperOddsType":"1X2","Ts":' || t || '}'"""
)
_SAID = "CASE WHEN k % 3 = 2 THEN '' ELSE '\"{}\":' || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END || ',' END"
_UJ = (
    """'{"Action":"' || ['possible','goal','penalty','penalty_outcome','red_card','var','var_end','action_discarded','action_amend','score_adjustment','suspend','disconnected','corner'][k % 13 + 1]
    || '",' || """ + _SAID.format("Confirmed") + """ || '"Data":{"Goal":' || (k // 13 % 4 = 0) || ',"Id":' || (n + 1) || ',"Outcome":"' || ['Scored','Overturned','Stands'][k // 13 % 3 + 1]
    || '","Reliable":' || (k // 13 % 2 = 0) || '},"FixtureId":' || fixture_id || ',"Id":' || n || ',"Seq":' || n || ',"Stats":[{"Key":1,"Period":0,"Value":' || (v % 4)
    || '},{"Key":2,"Period":0,"Value":' || (k % 3) || '}],"Ts":' || t || '}'"""
)
_LJ = (
    """'{"action":"status",' || """ + _SAID.format("confirmed") + """ || '"fixtureId":' || fixture_id || ',"followsAction":' || n
    || ',"parti1StateSoccer":{"PossibleEvent":{"Goal":' || (k // 13 % 2 = 0) || '}},"parti2StateSoccer":{"PossibleEvent":{"Goal":true,"Penalty":false}},"period":null,"possibleEventSoccer":{"RedCard":false,"VAR":true},"seq":' || n
    || ',"stats":{"1":' || (v % 4) || ',"1001":' || (v % 4) || ',"2":' || (k % 3) || CASE WHEN n % 50 = 6 THEN ',"99999999999999999999":1' ELSE '' END || '},"statusSoccerId":"' || ['H1',' h2 ','HT','??'][k % 4 + 1] || '","ts":' || t || '}'"""
)
CTES["raw"] = f"""SELECT *, sha256(payload) AS phash FROM (SELECT *, CASE WHEN is_odds THEN {_OJ} WHEN event_type = 'error' THEN {_UJ} ELSE {_LJ} END AS payload FROM rawrows)"""
CTES["nrm"] = """SELECT *, 'raw_' || substr(sha256('"' || rkey || '"'), 1, 40) AS ingest_id,
    CASE WHEN code IS NULL THEN 'evt_' || substr(sha256('"event' || substr(ekind, 1) || '"'), 1, 40) END AS event_id FROM (
    SELECT *, 'raw|4:live|' || length(payload_kind) || ':' || payload_kind || '|' || length(sid) || ':' || sid || '|1:' || ver AS rkey,
        '|4:live|' || (length(payload_kind) + 9) || ':' || payload_kind || '.observed|' || length(sid) || ':' || sid || '|1:' || ver AS ekind FROM (
        SELECT *, CASE WHEN payload_kind = 'weather' THEN 1 ELSE 2 END AS ver,
            CASE WHEN payload_kind = 'weather' THEN 'unknown_payload_kind' WHEN (payload_kind = 'odds' AND n % 50 IN (0, 4, 7)) OR (payload_kind = 'score' AND event_type <> 'error' AND n % 50 = 6) THEN 'malformed_payload' END AS code,
            CASE WHEN is_odds THEN CAST(n AS VARCHAR) WHEN event_type = 'error' OR (payload_kind = 'score' AND n % 50 <> 6) THEN fixture_id || ':' || n
                ELSE 'sha256:' || phash END AS sid FROM raw))"""
CTES["lab"] = """SELECT *, CASE WHEN arrival = first_arrival THEN CASE WHEN code IS NULL THEN 'inserted' ELSE 'quarantined' END
    WHEN phash = first_hash THEN 'duplicate' ELSE 'conflict' END AS append_status FROM (
    SELECT *, min(arrival) OVER (PARTITION BY rkey) AS first_arrival, first_value(phash) OVER (PARTITION BY rkey ORDER BY arrival) AS first_hash FROM nrm)"""
CTES["hsel"] = f"""SELECT fixture_id AS sel, CASE fixture_id WHEN '3' THEN 0 WHEN '4' THEN {MID_MS + 1} ELSE min(t) END AS lo, {MID_MS} AS hi
    FROM (SELECT CAST(fixture_id AS VARCHAR) AS fixture_id, t FROM feed) WHERE fixture_id <> '1' GROUP BY fixture_id"""
CTES["hyd"] = """SELECT *, CASE WHEN arrival = first_arrival THEN CASE WHEN code IS NULL THEN 'inserted' ELSE 'quarantined' END
    WHEN phash = first_hash THEN 'duplicate' ELSE 'conflict' END AS append_status FROM (
    SELECT n.* EXCLUDE (fixture_id), sel, CAST(n.fixture_id AS VARCHAR) AS own, replace(ekind, '|4:live|', '|10:historical|') AS ek,
        CASE WHEN code IS NULL OR is_odds OR event_type = 'error' THEN CAST(n.fixture_id AS VARCHAR) END AS known,
        min(arrival) OVER (PARTITION BY rkey) AS first_arrival, first_value(phash) OVER (PARTITION BY rkey ORDER BY arrival) AS first_hash
    FROM nrm n JOIN hsel ON sel = CASE WHEN CAST(n.fixture_id AS VARCHAR) = '1' THEN '2' ELSE CAST(n.fixture_id AS VARCHAR) END AND t BETWEEN lo AND hi
    WHERE payload_kind <> 'weather')"""
CTES["fx"] = """SELECT *, 'fixture:' || f || ':' || ts AS sid, 'evt_' || substr(sha256('"' || 'event|8:snapshot|16:fixture.observed|'
    || length('fixture:' || f || ':' || ts) || ':fixture:' || f || ':' || ts || '|1:1"'), 1, 40) AS event_id FROM (
    SELECT o_orderkey AS n, o_custkey % 12 AS f, epoch_us(o_orderdate) // 1000 AS d, epoch_us(o_orderdate) // 1000 + o_orderkey AS ts FROM orders)"""
CTES["lfx"] = """SELECT f, arg_max(struct_pack(n, d, ts, event_id), struct_pack(ts, sid)) AS r FROM fx GROUP BY f"""
CTES["rct"] = """SELECT b.*, '{"decision":{"action":"' || action || '","decisionId":"' || decision_id || '","evidenceEventIds":["' || event_id || '"],"expectedStateVersion":' || v0
    || ',"fixtureId":"' || fixture_id || '","idempotencyKey":"decision|44:' || event_id || '|' || length(market_id) || ':' || market_id || '|14:soccer-risk-v1|64:' || chash
    || '","inputFeatureHash":"' || fhash || '","logicalTimestampMs":' || t || ',"marketId":"' || market_id || '","metrics":{"activeShockRemainingMs":' || greatest(0, h1 - t)
    || ',"freshBookmakerCount":' || fresh_books || ',"lastStateChangeAtMs":' || c1 || ',"maxAbsVelocityMicrosPerSecond":' || coalesce(vel, -1)
    || ',"maxDispersionMadMicros":' || coalesce(mad, -1) || ',"maxReactionLatencyMs":-1,"oldestFreshQuoteAgeMs":' || coalesce(oldest, -1)
    || ',"proofStatus":0,"recoveryStableUpdates":' || n1 || ',"scoreSeverity":' || sevn || ',"shockUntilMs":' || h1 || ',"staleBookmakerFractionPpm":' || ppm
    || ',"unreactedBookmakerCount":0},"nextState":"' || s1 || '","payloadVersion":2,"policyConfigurationHash":"' || chash || '","policyVersion":"soccer-risk-v1","previousState":"' || s0
    || '","reasonCodes":["' || array_to_string(list_filter(rs, lambda x, i: list_position(rs, x) = i), '","') || '"],"thresholds":' || '""" + POLICY_JSON["base"] + """'
    || ',"triggerEventId":"' || event_id || '"},"evidence":[{"eventId":"' || event_id || '","kind":"' || kind || '","scoreStatKey":' || CASE WHEN kind = 'score.observed' THEN '1' ELSE 'null' END
    || ',"source":"live","sourceMessageId":"' || source_id || '","sourceTimestampMs":' || t || '}]}' AS pj FROM fh b"""
CTES["fh"] = """SELECT *, CASE coalesce(sev, 'none') WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sevn,
    sha256('{"evidenceEventIds":["' || event_id || '"],"features":{"consensusStatus":"' || status || '","freshBookmakerCount":' || fresh_books || ',"maxAbsVelocityMicrosPerSecond":'
    || coalesce(CAST(vel AS VARCHAR), 'null') || ',"maxDispersionMadMicros":' || coalesce(CAST(mad AS VARCHAR), 'null') || ',"maxReactionLatencyMs":null,"oldestFreshQuoteAgeMs":'
    || coalesce(CAST(oldest AS VARCHAR), 'null') || ',"staleBookmakerFractionPpm":' || ppm || ',"unreactedBookmakerCount":0},"fixtureId":"' || fixture_id
    || '","logicalTimestampMs":' || t || ',"marketId":"' || market_id || '","previous":{"fixtureId":"' || fixture_id || '","lastLogicalTimestampMs":'
    || coalesce(lag(t) OVER (PARTITION BY market_id ORDER BY v0), 0) || ',"lastStateChangeAtMs":' || c0 || ',"marketId":"' || market_id || '","recoveryStableUpdates":' || n0
    || ',"shockUntilMs":' || h0 || ',"state":"' || s0 || '","stateVersion":' || v0 || '},"proofStatus":"unavailable","scoreSignal":{"confirmation":"' || coalesce(conf2, 'not_applicable')
    || '","kind":"' || coalesce(kind2, 'normal') || '","protectiveAction":"' || coalesce(prot, 'none') || '","reasonCode":"' || coalesce(reason, 'SCORE_EVENT_NORMAL')
    || '","severity":"' || coalesce(sev, 'none') || '"},"triggerEventId":"' || event_id || '"}') AS fhash FROM base"""
CTES["rec"] = "SELECT *, sha256(pj) AS phash, 'rcpt_' || substr(sha256(pj), 1, 40) AS receipt_id FROM rct"
CTES["runs"] = """SELECT o_orderkey AS n, 'run-' || o_orderkey AS run_id, 'manifest-' || (o_custkey % 12) AS manifest_id,
    ['pending','running','paused','completed','stopped','failed'][o_orderkey % 6 + 1] AS status, epoch_us(o_orderdate) // 1000 + o_orderkey AS started,
    o_orderkey % 100 AS events FROM orders"""
CTES["reqs"] = """SELECT CASE l_linenumber WHEN 7 THEN 503 WHEN 6 THEN 404 ELSE 200 END AS code, (l_orderkey * 7919 + l_partkey) % 997 AS d FROM lineitem"""

def _needs(sql: str, skip: str = "") -> list[str]:
    """Table expressions that ``sql`` reads, in the order they are defined."""
    words = {m for m in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)", sql)}
    words |= {"pol"} if re.search(r",\s*pol p\b", sql) else set()
    return [name for name in CTES if name in words and name != skip]


def _sql(body: str) -> str:
    """Prefix ``body`` with the table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _needs(CTES[name], name):
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in _needs(body):
        visit(name)
    recursive = "RECURSIVE " if any(n.endswith("_r") for n in ordered) else ""
    kinds = {n: "" if n.endswith("_r") else "MATERIALIZED " for n in ordered}
    parts = ",\n".join(f"{n} AS {kinds[n]}({CTES[n]})" for n in ordered)
    return f"WITH {recursive}{parts}\n{body}"


_SNAP = """status, fresh_books AS fresh_bookmaker_count, valid_books AS valid_bookmaker_count, stale_books AS stale_bookmaker_count,
    total_books AS total_bookmaker_count, ppm AS stale_ppm, youngest AS freshest_age_ms, oldest AS oldest_fresh_age_ms, consensus_id"""

FINAL: dict[str, str] = {
    "consensus_trace": f"SELECT trig AS event_id, market_id, tt AS t, {_SNAP} FROM t_ids",
    "consensus_outcomes": """SELECT trig AS event_id, market_id, outcome_id, p AS probability_micros, mad AS dispersion_micros,
        delta AS delta_micros, CAST(vel AS BIGINT) AS velocity_micros_per_s FROM t_out""",
    "consensus_diagnostics": """SELECT trig AS trigger_event_id, code, bookmaker_id, event_id AS quote_event_id FROM t_diag WHERE code IS NOT NULL""",
    "normalized_vectors": """SELECT v.market_id, v.bookmaker_id, v.event_id, v.t AS observed_at_ms, v.code,
        CASE WHEN v.code IS NULL THEN v.total END AS reported_sum_micros, CASE WHEN v.code IS NULL THEN v.total - 1000000 END AS overround_micros,
        n.outcome_id, n.m AS reported_micros, CAST(n.p AS BIGINT) AS probability_micros FROM qv v LEFT JOIN norm n USING (event_id)""",
    "latest_quotes": """SELECT market_id, bookmaker_id, arg_max(event_id, struct_pack(t, event_id)) AS event_id, max(t) AS observed_at_ms FROM qv GROUP BY 1, 2""",
    "quote_freshness": f"""SELECT market_id, bookmaker_id, event_id, CASE WHEN t > {MID_MS} THEN 'future_quote' WHEN {MID_MS} - t > {STALE} THEN 'stale_quote'
        ELSE 'fresh' END AS freshness, CASE WHEN {MID_MS} - t BETWEEN 0 AND {STALE} THEN {MID_MS} - t END AS age_ms FROM (
        SELECT market_id, bookmaker_id, arg_max(event_id, struct_pack(t, event_id)) AS event_id, max(t) AS t FROM qv WHERE t <= {MID_MS + 43_200_000} GROUP BY 1, 2)""",
    "score_classes": "SELECT event_id, action, kind2 AS kind, reason AS reason_code, prot AS protective_action, sev AS severity, conf2 AS confirmation FROM sig",
    "snapshot_risk_features": """SELECT trig AS event_id, status AS consensus_status, fresh_books AS fresh_bookmaker_count, vel AS max_abs_velocity,
        mad AS max_dispersion, oldest AS oldest_fresh_age_ms, ppm AS stale_ppm FROM t_feat""",
    "threshold_reasons": f"""SELECT trig AS event_id, array_to_string({_PAUSES}, ',') AS pause_reasons, array_to_string({_WIDENS}, ',') AS widen_reasons,
        CAST({_HEALTHY} AS INTEGER) AS healthy FROM t_feat""",
    "attributed_events": "SELECT event_id, market_id, kind, oldest AS oldest_fresh_age_ms FROM inp",
    "event_time_features": """SELECT event_id, market_id, kind, status AS consensus_status, fresh_books AS fresh_bookmaker_count, vel AS max_abs_velocity,
        mad AS max_dispersion, oldest AS oldest_fresh_age_ms, ppm AS stale_ppm FROM einp""",
    "event_time_decisions": f"SELECT {_DEC} FROM agedr WHERE policy_id = 'base'",
    "risk_decisions": f"SELECT {_DEC} FROM base",
    "resumed_decisions": f"SELECT {_DEC} FROM resr WHERE policy_id = 'base'",
    "policy_sweep_decisions": "SELECT policy_id, market_id, s0 AS previous_state, s1 AS next_state, count(*) AS decisions FROM dec GROUP BY ALL",
    "decision_payloads": """SELECT decision_id, chash AS policy_configuration_hash, fhash AS input_feature_hash, greatest(0, h1 - t) AS active_shock_remaining_ms,
        fresh_books AS fresh_bookmaker_count, coalesce(vel, -1) AS max_abs_velocity_micros_per_second, coalesce(mad, -1) AS max_dispersion_mad_micros,
        -1 AS max_reaction_latency_ms, coalesce(oldest, -1) AS oldest_fresh_quote_age_ms, 0 AS proof_status, sevn AS score_severity,
        ppm AS stale_bookmaker_fraction_ppm, 0 AS unreacted_bookmaker_count FROM fh""",
    "restart_states": """SELECT market_id, fixture_id, decision_id AS last_decision_id, s1 AS state, v0 + 1 AS state_version, t AS last_logical_ms,
        c1 AS last_state_change_ms, n1 AS stable_updates, h1 AS shock_until_ms FROM base QUALIFY v0 = max(v0) OVER (PARTITION BY market_id)""",
    "late_inputs": "SELECT i.market_id, i.event_id, i.t, z.z.t AS last_applied_ms FROM inp i JOIN halfstate z USING (market_id) WHERE i.t < z.z.t",
    "transition_audit": """SELECT decision_id, a AS action, s0 AS previous_state, s1 AS next_state FROM (SELECT *, CASE WHEN v0 % 20 = 0 THEN 'reopen' ELSE action END AS a FROM base)
        WHERE NOT (a = 'none' AND s0 = s1 OR a = 'reopen' AND s0 = 'RECOVERY' AND s1 = 'OPEN' OR a = 'widen' AND s0 = 'OPEN' AND s1 = 'WIDENED'
            OR a = 'begin_recovery' AND s0 IN ('PAUSED', 'WIDENED') AND s1 = 'RECOVERY' OR a = 'pause' AND s0 <> 'PAUSED' AND s1 = 'PAUSED')""",
    "namespaced_markets": """SELECT DISTINCT market_id, 'evaluation:sample:' || substr(sha256('"' || market_id || '"'), 1, 32) AS evaluation_market_id,
        'replay:run-1:' || market_id AS replay_market_id FROM qv""",
    "bucket_coordinates": """SELECT n, t // 86400000 AS epoch_day, t % 86400000 // 3600000 AS hour, t % 3600000 // 300000 AS interval,
        t // 300000 * 300000 AS bucket_start_ms, t // 300000 * 300000 + 300000 AS bucket_end_ms FROM feed""",
    "planned_buckets": f"""SELECT fixture_id, {MID_MS} >= f AS valid, {MID_MS} // 300000 - f // 300000 + 1 AS buckets, f // 300000 * 300000 AS first_ms,
        {MID_MS} // 300000 * 300000 + 300000 AS last_ms FROM (SELECT fixture_id, min(t) AS f FROM feed GROUP BY 1)""",
    "source_range": f"SELECT arrival, t AS source_time_ms FROM raw WHERE t BETWEEN 1704844800000 AND {MID_MS}",
    "feed_messages": """SELECT arrival, payload_kind, payload FROM raw WHERE arrival % 9 > 3 UNION ALL SELECT arrival, payload_kind, payload FROM raw WHERE arrival % 9 = 2
        UNION ALL SELECT arrival, payload_kind, payload FROM raw WHERE arrival % 9 = 2 UNION ALL SELECT arrival, payload_kind, 'not json ' || arrival FROM raw WHERE arrival % 9 = 3""",
    "normalized_scores": """SELECT arrival, event_id, fixture_id, sid AS source_id, n AS sequence,
        CASE WHEN event_type = 'error' THEN ['possible','goal','penalty','penalty_outcome','red_card','var','var_end','action_discarded','action_amend','score_adjustment','suspend','disconnected','corner'][k % 13 + 1] ELSE 'status' END AS action,
        CASE WHEN event_type = 'error' THEN CAST(n AS VARCHAR) ELSE fixture_id || ':' || n END AS action_id, v % 4 AS home_score, k % 3 AS away_score,
        CASE WHEN event_type <> 'error' THEN [2, 4, 3, NULL][k % 4 + 1] END AS status_id, ['true', 'false', NULL][k % 3 + 1] AS confirmed,
        CASE WHEN event_type = 'error' THEN CAST(k // 13 % 4 = 0 AS VARCHAR) ELSE CAST(k // 13 % 2 = 0 AS VARCHAR) END AS goal,
        CASE WHEN event_type <> 'error' THEN 'false' END AS penalty, CASE WHEN event_type <> 'error' THEN 'false' END AS red_card,
        CASE WHEN event_type <> 'error' THEN 'true' END AS review, CASE WHEN event_type = 'error' THEN ['Scored','Overturned','Stands'][k // 13 % 3 + 1] END AS outcome,
        CASE WHEN event_type = 'error' THEN CAST(n + 1 AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS referenced_action_id,
        CASE WHEN event_type = 'error' THEN CAST(k // 13 % 2 = 0 AS VARCHAR) END AS reliable,
        '1:0:' || (v % 4) || ',2:0:' || (k % 3) || CASE WHEN event_type = 'error' THEN '' ELSE ',1001:1:' || (v % 4) END AS stats
        FROM nrm WHERE payload_kind = 'score' AND code IS NULL""",
    "normalized_odds": """SELECT arrival, event_id, fixture_id, mid AS market_id, 'open' AS market_status, CAST(k % 5 AS VARCHAR) AS bookmaker_id,
        'out_' || substr(sha256('{"market":"' || mid || '","name":"' || o.name || '"}'), 1, 40) AS outcome_id, price + o.i AS price,
        CASE o.i WHEN 0 THEN home // 10 * 10 WHEN 1 THEN CASE WHEN k <> 97 THEN draw // 10 * 10 END ELSE (1000000 - home - draw + k * 100) // 10 * 10 END AS reported_micros
        FROM (SELECT *, 'mkt_' || substr(sha256('{"fixtureId":"' || fixture_id || '","inRunning":true,"outcomeNames":["away","draw","home"],"parameters":"' || market_id
            || '","period":"full_time","type":"1X2"}'), 1, 40) AS mid FROM nrm WHERE payload_kind = 'odds' AND code IS NULL),
        (SELECT 0 AS i, 'home' AS name UNION ALL SELECT 1, 'draw' UNION ALL SELECT 2, 'away') o""",
    "normalized_fixtures": """SELECT event_id, CAST(f AS VARCHAR) AS fixture_id, sid AS source_id, ts AS source_timestamp_ms,
        ['World Cup','League','Friendly world cup warm-up','Cup'][f % 4 + 1] AS competition, d + f * 3600000 AS scheduled_at_ms,
        CASE WHEN n % 7 = 6 THEN 'cancelled' ELSE 'scheduled' END AS status, 'Side ' || CASE WHEN n % 2 = 0 THEN f * 2 ELSE f * 2 + 1 END AS home,
        CAST(CASE WHEN n % 2 = 0 THEN f * 2 + 1 ELSE f * 2 END AS VARCHAR) AS away_id FROM fx""",
    "quarantine": """SELECT arrival, ingest_id, payload_kind, CASE WHEN is_odds OR event_type = 'error' THEN fixture_id END AS fixture_id, sid AS source_id,
        code AS quarantine_code, phash AS payload_hash, 1 AS issues FROM nrm WHERE code IS NOT NULL""",
    "raw_identity": """SELECT ingest_id, sid AS source_id, payload_kind, CASE WHEN code IS NULL OR is_odds OR event_type = 'error' THEN t END AS source_timestamp_ms,
        CASE WHEN code IS NULL THEN 'accepted' ELSE 'quarantined' END AS status, phash AS raw_payload_hash FROM nrm""",
    "odds_issue_counts": """SELECT CASE n % 50 WHEN 0 THEN 'Prices: PriceNames and Prices differ in length' WHEN 4 THEN 'Pct: above 100.000'
        ELSE 'Prices: expected integers' END AS issue, count(*) AS records FROM raw WHERE payload_kind = 'odds' AND n % 50 IN (0, 4, 7) GROUP BY 1""",
    "raw_event_audit": "SELECT ingest_id, event_id FROM lab WHERE append_status = 'inserted' AND t % 25 = 0",
    "world_cup_fixtures": """SELECT f AS fixture_id, ['World Cup','','Friendly world cup warm-up',''][f % 4 + 1] AS competition, 'Side ' || CASE WHEN n % 2 = 0 THEN f * 2 ELSE f * 2 + 1 END AS home,
        'Side ' || CASE WHEN n % 2 = 0 THEN f * 2 + 1 ELSE f * 2 END AS away, count(*) AS observations, min(d + f * 3600000) AS first_start_ms FROM fx WHERE f % 2 = 0 GROUP BY 1, 2, 3, 4""",
    "hydration_events": """SELECT 'evt_' || substr(sha256('"event' || substr(ek, 1) || '"'), 1, 40) AS event_id, own AS fixture_id, payload_kind || '.observed' AS kind,
        'historical' AS source, t AS source_timestamp_ms, CASE WHEN is_odds THEN 0 ELSE n END AS sequence FROM hyd WHERE append_status = 'inserted' AND own = sel""",
    "hydration_counts": """SELECT sel AS selected_fixture, lo > hi AS refused, count(append_status) FILTER (append_status = 'inserted') AS inserted,
        count(append_status) FILTER (append_status = 'duplicate') AS duplicate, count(append_status) FILTER (append_status = 'quarantined') AS quarantined,
        count(append_status) FILTER (append_status = 'conflict') AS conflict, count(known) FILTER (known <> sel) AS "foreign"
        FROM hsel LEFT JOIN hyd USING (sel) GROUP BY ALL""",
    "append_conflicts": """SELECT DISTINCT rkey AS idempotency_key, sid AS source_id, phash AS raw_payload_hash, CASE WHEN code IS NULL THEN 'accepted' ELSE 'quarantined' END AS status
        FROM (SELECT *, first_value(phash) OVER (PARTITION BY rkey ORDER BY arrival % 3 <> 0, arrival) AS held FROM nrm) WHERE phash <> held""",
    "append_labels": "SELECT arrival, ingest_id, append_status FROM lab",
    "payload_conflicts": "SELECT rkey AS raw_key, count(*) AS records FROM nrm GROUP BY 1 HAVING count(DISTINCT phash) > 1",
    "event_key_conflicts": """SELECT 'event' || ekind AS event_key, count(*) AS records FROM (SELECT *, rkey || CASE WHEN arrival % 7 = 0 THEN '|moved' ELSE '' END AS rk FROM nrm WHERE code IS NULL)
        GROUP BY 1 HAVING count(DISTINCT rk) > 1""",
    "append_counts": """SELECT CASE WHEN code IS NULL OR is_odds OR event_type = 'error' THEN fixture_id END AS fixture_id, append_status, count(*) AS records FROM lab GROUP BY 1, 2""",
    "decision_payload_conflicts": """SELECT 'decision|44:' || event_id || '|' || length(market_id) || ':' || market_id || '|14:soccer-risk-v1|64:' || chash AS idempotency_key,
        2 AS records FROM base WHERE v0 % 10 = 0""",
    "version_audit": """SELECT market_id, v0 AS expected_state_version, 'WIDENED' AS previous_state, CASE WHEN v0 = 0 THEN 'OPEN' ELSE s0 END AS expected_state
        FROM base WHERE v0 % 50 = 0 AND s0 <> 'WIDENED'""",
    "latest_fixture_rows": """SELECT CAST(f AS VARCHAR) AS fixture_id, ['World Cup','League','Friendly world cup warm-up','Cup'][f % 4 + 1] AS competition, r.d + f * 3600000 AS scheduled_at_ms,
        CASE WHEN r.n % 7 = 6 THEN 'cancelled' ELSE 'scheduled' END AS status, 'Side ' || CASE WHEN r.n % 2 = 0 THEN f * 2 ELSE f * 2 + 1 END AS home,
        r.event_id, r.ts AS source_timestamp_ms FROM lfx""",
    "latest_market_rows": """SELECT market_id, arg_max(fixture_id, struct_pack(t, event_id)) AS fixture_id, '1X2' AS market_type, 'full_time' AS period, 'open' AS status,
        arg_max(event_id, struct_pack(t, event_id)) AS event_id, max(t) AS source_timestamp_ms FROM qv GROUP BY 1""",
    "quote_rows": "SELECT event_id, market_id, bookmaker_id, outcome_id, price, m AS reported_probability_micros, t AS source_timestamp_ms FROM q",
    "score_history": """SELECT event_id, fixture_id, t AS source_timestamp_ms, action, status_id, v % 4 AS home_score, k % 3 AS away_score,
        ['true', 'false', NULL][k % 3 + 1] AS confirmed,
        CASE action WHEN 'penalty_outcome' THEN ['Scored','Missed','Retake'][j % 3 + 1] WHEN 'var_end' THEN ['Stands','Overturned',NULL][j % 3 + 1] END AS outcome,
        CASE WHEN action = 'var' THEN ['Goal','Penalty','RedCard','Other'][j % 4 + 1] END AS review_type FROM sc""",
    "latest_score_rows": """SELECT fixture_id, action, v % 4 AS home_score, k % 3 AS away_score, status_id, ['true', 'false', NULL][k % 3 + 1] AS confirmed, event_id FROM sc
        QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY t DESC, n DESC) = 1""",
    "control_states": """SELECT market_id, fixture_id, s1 AS state, v0 + 1 AS state_version, decision_id AS last_decision_id, t AS logical_timestamp_ms
        FROM base QUALIFY v0 = max(v0) OVER (PARTITION BY market_id)""",
    "order_audit": """SELECT ikey AS idempotency_key, CASE v % 20 WHEN 0 THEN 'stake_micros: not positive' WHEN 1 THEN 'namespace: pattern' ELSE 'quote_observed_at_ms: after request' END AS violations
        FROM ords WHERE v % 20 <= 2""",
    "order_admissions": """SELECT a.order_id, ikey AS idempotency_key, a.market_id, a.decision_id, a.s1 AS market_state, v1 AS market_state_version, a.code AS admission_reason_code,
        CASE WHEN a.decision_id IS NULL THEN 'error' ELSE CASE split_part(a.code, '_', 2) WHEN 'REJECTED' THEN 'rejected' WHEN 'STALE' THEN 'stale' ELSE 'accepted' END END AS status,
        CASE a.code WHEN 'ORDER_REJECTED_PAUSED' THEN 'Rejected because the latest committed circuit-breaker state is PAUSED.'
            WHEN 'ORDER_REJECTED_RECOVERY' THEN 'Rejected while the market proves stable recovery; admission resumes only after OPEN.'
            WHEN 'ORDER_STALE_WIDENED_REQUOTE_REQUIRED' THEN 'Marked stale because WIDENED requires a fresh downstream quote before admission.'
            WHEN 'ORDER_STALE_STATE_VERSION' THEN 'Marked stale because the quoted circuit-breaker version is not the latest committed version.'
            WHEN 'ORDER_STALE_QUOTE_AGE' THEN 'Marked stale because quote age exceeds 2000ms.'
            WHEN 'ORDER_ACCEPTED_OPEN' THEN 'Accepted against the latest committed OPEN circuit-breaker decision.'
            ELSE 'No decision has been committed for this market.' END AS explanation,
        requested - quoted AS quote_age_ms, CAST(split_part(a.code, '_', 2) = 'STALE' AS INTEGER) AS requires_requote, r.receipt_id AS circuit_breaker_receipt_id
        FROM adm a LEFT JOIN rec r USING (decision_id)""",
    "admission_audit": "SELECT order_id, 'version mismatch' AS violations FROM adm WHERE v % 15 = 0 AND decision_id IS NOT NULL",
    "settlement_audit": """SELECT order_id, CASE WHEN v % 10 = 1 THEN 'time and outcome differ' ELSE 'outcome without settled status' END AS violations FROM ords
        WHERE v % 10 = 1 OR v % 20 = 10""",
    "evidence_rows": "SELECT decision_id, event_id, kind, source_id AS source_message_id, CASE WHEN kind = 'score.observed' THEN 1 END AS score_stat_key FROM base",
    "missing_evidence": "SELECT decision_id, event_id AS missing_event_id FROM base WHERE t % 10 = 0",
    "envelope_audit": """SELECT event_id, ['source priority', 'idempotency key,event id', 'fixture mismatch'][n % 40 + 1] AS violations FROM keyed WHERE n % 40 < 3""",
    "event_shape_audit": """SELECT event_id, CASE WHEN is_odds THEN 'odds shape' ELSE 'score shape' END AS violations FROM keyed
        WHERE n % 30 = CASE WHEN is_odds THEN 0 ELSE 1 END""",
    "receipt_audit": "SELECT receipt_id, 'evidence repeats,payload hash' AS violations FROM rec WHERE t % 20 = 0",
    "order_labels": """SELECT ikey AS idempotency_key, rhash AS request_hash, 'inserted' AS append_status, 1 AS requests FROM ords
        UNION ALL SELECT ikey, rhash, 'duplicate', 1 FROM ords WHERE v % 4 = 1
        UNION ALL SELECT ikey, sha256('{"expectedDecisionId":"' || expected || '","expectedStateVersion":1,"fixtureId":"' || fixture_id
    || '","idempotencyKey":"' || ikey || '","marketId":"' || market_id || '","namespace":"live","outcomeId":"' || outcome_id || '","payloadVersion":1,"price":' || v
    || ',"quoteObservedAtMs":' || quoted || ',"requestedAtMs":' || (requested + 1) || ',"side":"' || side || '","stakeMicros":' || (v * 10000 + 1) || '}'), 'conflict', 1 FROM ords WHERE v % 4 = 0""",
    "decision_receipts": "SELECT receipt_id, decision_id, phash AS payload_hash, t AS created_at_ms, 'pending' AS status FROM rec",
    "pending_queue": "SELECT receipt_id, t AS updated_at_ms FROM rec ORDER BY t, receipt_id LIMIT 50",
    "proof_coordinates": """SELECT decision_id, CASE WHEN kind = 'odds.observed' THEN 'odds' WHEN sequence >= 1 THEN 'score' ELSE 'unavailable' END AS proof_kind,
        CASE WHEN kind = 'odds.observed' OR sequence >= 1 THEN event_id END AS source_event_id, CASE WHEN kind = 'odds.observed' OR sequence >= 1 THEN source_id END AS source_message_id,
        CASE WHEN kind = 'odds.observed' OR sequence >= 1 THEN t END AS source_timestamp_ms, CASE WHEN kind <> 'odds.observed' AND sequence >= 1 THEN sequence END AS sequence,
        CASE WHEN kind <> 'odds.observed' AND sequence >= 1 THEN 1 END AS stat_key FROM base""",
    "merged_verifications": """SELECT decision_id, CASE WHEN t % 10 < 3 THEN 'error' WHEN t % 10 < 6 THEN 'verified' ELSE 'rejected' END AS status,
        CASE WHEN t % 10 < 3 THEN 1 ELSE 2 END AS attempt_count, t + CASE WHEN t % 10 < 3 THEN 1000 ELSE 2000 END AS updated_at_ms, 'material' AS proof_material_hash FROM base""",
    "verification_updates_audit": """SELECT decision_id, 2 AS update_seq, ['attempt moved backwards','time moved backwards','conflicting material'][t % 10 + 1] AS violations FROM base WHERE t % 10 < 3""",
    "verification_audit": """SELECT decision_id, array_to_string(vs, ',') AS violations FROM (SELECT decision_id, list_filter([
            CASE WHEN u % 4 = 0 THEN 'completed_at_ms required' END, CASE WHEN failed AND u % 5 = 0 THEN 'error_code required' END,
            CASE WHEN NOT failed AND u % 3 = 0 THEN 'simulation_slot required' END], lambda x: x IS NOT NULL) AS vs
        FROM (SELECT decision_id, t % 10 < 3 AS failed, t + CASE WHEN t % 10 < 3 THEN 1000 ELSE 2000 END AS u FROM base)) WHERE len(vs) > 0""",
    "manifest_audit": f"""SELECT fixture_id, 'event count,sequence hash,input hash' AS violations FROM keyed WHERE CAST(fixture_id AS INTEGER) % 3 = 0
        GROUP BY fixture_id HAVING max(t) >= {MID_MS}""",
    "fanned_out_decisions": """SELECT market_id, s1 AS next_state, count(*) AS decisions, max(v0) AS last_version FROM fan WHERE policy_id = 'base' GROUP BY ALL""",
    "probe_order_rows": """SELECT fixture_id, order_id, version AS expected_state_version, market_id, outcome_id, moment AS requested_at_ms,
        p AS requested_probability_micros FROM probe WHERE policy_id = 'base'""",
    "price_error_proxy": """SELECT r.fixture_id, r.policy_id, count(*) AS rejected_orders, count(o.p) AS evaluated_orders, max(abs(o.p - r.p)) AS max_error_micros,
        CAST((2 * sum(abs(o.p - r.p)) + count(o.p)) // (2 * count(o.p)) AS BIGINT) AS mean_error_micros
        FROM probe r LEFT JOIN conv c ON c.fixture_id = r.fixture_id LEFT JOIN t_out0 o ON o.trig = c.c.id AND o.outcome_id = r.outcome_id GROUP BY ALL""",
    "proof_outcomes": """SELECT CASE WHEN t % 10 < 3 THEN 'error' WHEN t % 10 < 6 THEN 'verified' ELSE 'rejected' END AS status, count(*) AS receipts FROM base GROUP BY 1""",
    "proof_material_audit": """SELECT n AS material_id, array_to_string(list_filter([CASE WHEN k % 20 = 0 THEN 'fixture differs from batch summary' END,
        CASE WHEN k % 20 = 0 THEN 'negative fixture' END, CASE WHEN k < 3 OR k > 98 THEN 'time outside batch summary' END], lambda x: x IS NOT NULL), ',') AS violations
        FROM feed WHERE k % 20 = 0 OR k < 3 OR k > 98""",
    "protective_signals": """SELECT fixture_id, s.event_id AS signal_event_id, s.t AS signal_t, s.kind2 AS signal_kind, s.conf2 AS signal_confirmation, c AS signal_count FROM psig""",
    "signal_baselines": """SELECT fixture_id, b.market_id, b.consensus_id AS baseline_consensus_id, b.tt AS baseline_t, b.status AS baseline_status FROM pbase""",
    "first_moves": "SELECT fixture_id, m.t AS move_t, m.id AS move_event_id FROM (SELECT fixture_id, min(struct_pack(t := tt, id := trig)) AS m FROM after WHERE delta >= 30000 GROUP BY 1)",
    "convergences": "SELECT fixture_id, c.t AS convergence_t, c.id AS convergence_event_id FROM conv",
    "market_lifecycles": "SELECT fixture_id, policy_id, paused_t, exit_t, reopened_t, pause_duration_ms, pause_total_ms FROM life",
    "state_transitions": "SELECT fixture_id, policy_id, s0 AS previous_state, s1 AS next_state, count(*) AS transitions FROM dec WHERE s0 <> s1 GROUP BY ALL",
    "state_transition_summary": """SELECT fixture_id, policy_id, CAST(sum(c) AS BIGINT) AS transition_count, CAST(coalesce(sum(c) FILTER (s0 = 'RECOVERY' AND s1 IN ('PAUSED', 'WIDENED')), 0) AS BIGINT) AS flap_count,
        '{' || string_agg('"' || s0 || '->' || s1 || '":' || c, ',' ORDER BY s0, s1) || '}' AS transition_json
        FROM (SELECT fixture_id, policy_id, s0, s1, count(*) AS c FROM dec WHERE s0 <> s1 GROUP BY ALL) GROUP BY 1, 2""",
    "control_windows": """SELECT d.fixture_id, policy_id, count(*) AS control_decisions, count(*) FILTER (s1 <> s0 AND s1 <> 'OPEN') AS control_restrictive
        FROM dec d JOIN abase a ON a.fixture_id = d.fixture_id AND d.t >= a.b.tt AND d.t < a.signal_t GROUP BY ALL""",
    "false_pauses": """SELECT f.fixture_id, CASE WHEN g.s IS NULL THEN 'no_protective_signal' WHEN g.s.conf2 = 'confirmed' THEN 'confirmed_signal'
        WHEN EXISTS (SELECT 1 FROM sig x WHERE x.fixture_id = f.fixture_id AND x.t > g.s.t AND x.conf2 = 'reversal') THEN 'overturned_signal'
        ELSE 'indeterminate_unconfirmed' END AS false_pause_status FROM (SELECT DISTINCT fixture_id FROM feed) f LEFT JOIN psig g USING (fixture_id)""",
    "evaluation_facts": """SELECT x.fixture_id, x.policy_id, coalesce(g.c, 0) AS signal_count, CAST(x.tc AS BIGINT) AS transition_count, x.fc AS flap_count, CASE WHEN g.s IS NULL THEN 'no_protective_signal' WHEN g.s.conf2 = 'confirmed' THEN 'confirmed_signal'
        WHEN EXISTS (SELECT 1 FROM sig y WHERE y.fixture_id = x.fixture_id AND y.t > g.s.t AND y.conf2 = 'reversal') THEN 'overturned_signal'
        ELSE 'indeterminate_unconfirmed' END AS false_pause_status, l.pause_duration_ms, l.pause_total_ms, l.reopened_t - g.s.t AS reopen_latency_ms,
        (SELECT count(*) FROM dec d JOIN pbase p ON p.fixture_id = d.fixture_id WHERE d.fixture_id = x.fixture_id AND d.policy_id = x.policy_id AND d.t >= p.b.tt AND d.t < p.signal_t) AS control_decisions,
        CASE WHEN l.reopened_t IS NOT NULL THEN 'OPEN' ELSE x.last_state END AS final_state, x.dc AS decision_count
        FROM (SELECT fixture_id, policy_id, count(*) FILTER (s0 <> s1) AS tc, count(*) FILTER (s0 = 'RECOVERY' AND s1 = 'PAUSED') AS fc, count(*) AS dc,
            arg_max(s1, struct_pack(t, sequence, source_id)) AS last_state FROM dec GROUP BY ALL) x
        LEFT JOIN psig g USING (fixture_id) LEFT JOIN life l USING (fixture_id, policy_id)""",
    "dispatch_order": """SELECT fixture_id, event_id, row_number() OVER (PARTITION BY fixture_id ORDER BY t, sequence, source_id) - 1 AS dispatch_index, t AS logical_timestamp_ms,
        'replay:sample' AS namespace FROM keyed""",
    "reconciled_runs": f"""SELECT run_id, CASE WHEN n % 6 < 3 THEN 'failed' ELSE status END AS status, CASE WHEN n % 6 < 3 THEN greatest({NOW_MS}, started) ELSE started + 60000 END AS completed_at_ms,
        CAST(n % 6 < 3 AS INTEGER) AS recovered FROM runs""",
    "run_log_audit": """SELECT run_id, 1 AS update_seq, 'immutable field changed' AS violations FROM runs WHERE n % 11 = 0 UNION ALL
        SELECT run_id, 2, v FROM (SELECT run_id, array_to_string(list_filter([CASE WHEN status = 'pending' THEN 'illegal status move' END, CASE WHEN n % 11 = 0 THEN 'immutable field changed' END,
            CASE WHEN events < 50 THEN 'progress moved backwards' END, CASE WHEN status = 'completed' AND events <> 99 THEN 'completed early' END], lambda x: x IS NOT NULL), ',') AS v FROM runs) WHERE v <> ''""",
    "overview": """SELECT (SELECT count(*) FROM lfx) AS fixtures, (SELECT count(*) FROM base) AS decisions, (SELECT count(*) FROM ords) AS orders, (SELECT count(*) FROM base) AS pending_proofs,
        (SELECT count(*) FROM runs) AS replay_runs, (SELECT decision_id FROM base ORDER BY t DESC, decision_id DESC LIMIT 1) AS latest_decision_id,
        (SELECT order_id FROM ords ORDER BY requested DESC, order_id DESC LIMIT 1) AS latest_order_id""",
    "fixtures_view": """SELECT CAST(f AS VARCHAR) AS fixture_id, ['World Cup','League','Friendly world cup warm-up','Cup'][f % 4 + 1] AS competition, r.d + f * 3600000 AS scheduled_at_ms,
        r.ts AS updated_at_ms, s.action, s.v % 4 AS home_score, s.k % 3 AS away_score, s.t AS score_timestamp_ms FROM lfx
        LEFT JOIN (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY t DESC, n DESC) = 1) s ON s.fixture_id = CAST(f AS VARCHAR)
        WHERE r.n % 7 <> 6 ORDER BY scheduled_at_ms, fixture_id LIMIT 10""",
    "timeline_view": f"""SELECT * FROM (SELECT t AS at_ms, event_id AS id, 'score' AS kind, action AS detail FROM sc WHERE fixture_id = '3' UNION ALL
        SELECT t, decision_id, 'decision', s1 FROM base WHERE fixture_id = '3') WHERE at_ms < {MID_MS} ORDER BY at_ms DESC, id DESC LIMIT 50""",
    "decisions_view": "SELECT decision_id, t AS logical_timestamp_ms, s1 AS next_state FROM base WHERE fixture_id = '5' ORDER BY t DESC, decision_id DESC LIMIT 40",
    "receipts_view": "SELECT receipt_id, decision_id, t AS logical_timestamp_ms FROM rec WHERE fixture_id = '5' ORDER BY t DESC, receipt_id DESC LIMIT 40",
    "orders_view": """SELECT order_id, requested AS created_at_ms, code AS admission_reason_code FROM adm WHERE fixture_id = '5' AND code LIKE 'ORDER_REJECTED%'
        ORDER BY requested DESC, order_id DESC LIMIT 40""",
    "runs_view": "SELECT run_id, status, started AS started_at_ms FROM runs ORDER BY started DESC, run_id DESC LIMIT 25",
    "event_page": """SELECT event_id, t AS source_timestamp_ms, sequence, CASE WHEN total > 40 THEN last_id END AS next_cursor FROM (
        SELECT *, row_number() OVER w AS r, count(*) OVER () AS total, nth_value(event_id, 40) OVER (ORDER BY t, sequence, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id
        FROM keyed WHERE fixture_id = '4' WINDOW w AS (ORDER BY t, sequence, source_id)) WHERE r BETWEEN 21 AND 40""",
    "market_maxima": """SELECT market_id, coalesce(max(mad), 0) AS max_dispersion_micros, coalesce(max(vel), 0) AS max_velocity_micros_per_s FROM t_feat GROUP BY 1""",
    "purged_records": f"""SELECT payload_kind, source, purged, count(*) AS records, count(*) FILTER (purged = 0) AS payloads FROM (
        SELECT payload_kind, CASE WHEN ts % 2 = 0 THEN 'historical' ELSE 'live' END AS source, CAST(coalesce(ts % 2 = 0, false) AND t + 86400000 <= {MID_MS} AS INTEGER) AS purged
        FROM (SELECT *, CASE WHEN code IS NULL OR is_odds OR event_type = 'error' THEN t END AS ts FROM nrm)) GROUP BY 1, 2, 3""",
    "feed_health": f"""SELECT payload_kind, count(*) FILTER (append_status = 'inserted') AS accepted, count(*) FILTER (append_status = 'duplicate') AS duplicates,
        count(*) FILTER (append_status NOT IN ('inserted', 'duplicate')) AS quarantined, max(ts) AS last_source_ms, greatest(0, {NOW_MS} - max(ts)) AS lag_ms,
        count(DISTINCT CASE WHEN ts IS NOT NULL THEN fixture_id END) AS tracked_fixtures FROM (SELECT *, CASE WHEN code IS NULL OR is_odds OR event_type = 'error' THEN t END AS ts FROM lab) GROUP BY 1""",
    "tracked_fixtures": "SELECT DISTINCT payload_kind, fixture_id FROM lab WHERE code IS NULL OR is_odds OR event_type = 'error'",
    "bucketed_feed_health": """SELECT ts // 300000 * 300000 AS bucket_start_ms, payload_kind, count(*) FILTER (append_status = 'inserted') AS accepted,
        count(*) FILTER (append_status = 'duplicate') AS duplicates, count(*) FILTER (append_status NOT IN ('inserted', 'duplicate')) AS quarantined
        FROM (SELECT *, CASE WHEN code IS NULL OR is_odds OR event_type = 'error' THEN t END AS ts FROM lab) WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "request_metrics": """SELECT count(*) AS total, count(*) FILTER (code = 404) AS client_errors, count(*) FILTER (code = 503) AS server_errors,
        CAST(sum(d) AS BIGINT) AS total_duration_ms, max(d) AS maximum_duration_ms FROM reqs""",
    "latency_percentiles": """SELECT max(d) FILTER (r = least(c - 1, CAST(floor(c * 0.5) AS BIGINT))) AS p50, max(d) FILTER (r = least(c - 1, CAST(floor(c * 0.95) AS BIGINT))) AS p95,
        max(d) AS maximum FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS c FROM reqs)""",
    "chunked_hashes": """SELECT fixture_id, CAST(sum(n) AS BIGINT) AS event_count, sha256('[' || string_agg(h, ',' ORDER BY day) || ']') AS event_sequence_hash FROM (
        SELECT fixture_id, t // 86400000 AS day, count(*) AS n, sha256('[' || string_agg('"' || event_id || '"', ',' ORDER BY t, sequence, source_id) || ']') AS h
        FROM keyed GROUP BY 1, 2) GROUP BY 1""",
    "sequence_hashes": """SELECT fixture_id, count(*) AS event_count, sha256('[' || string_agg('"' || event_id || '"', ',' ORDER BY t, sequence, source_id) || ']') AS event_sequence_hash FROM keyed GROUP BY 1""",
    "consensus_at_time": f"SELECT market_id, {_SNAP} FROM n_ids",
    "core_markets": """SELECT fixture_id, market_id, r AS selection_rank, CAST(r = 1 AS INTEGER) AS selected FROM (SELECT e.fixture_id, s.market_id,
        row_number() OVER (PARTITION BY e.fixture_id ORDER BY valid_books DESC, ppm, s.market_id) AS r
        FROM n_snap s JOIN (SELECT DISTINCT market_id, fixture_id FROM qv) e USING (market_id) WHERE s.status = 'ready')""",
    "markets_view": """SELECT m.market_id, m.fixture_id, m.t AS updated_at_ms, d.s1 AS state, d.v0 + 1 AS state_version, n.consensus_id, n.status AS consensus_status,
        n.valid_books AS valid_bookmaker_count FROM (SELECT market_id, any_value(fixture_id) AS fixture_id, max(t) AS t FROM qv GROUP BY 1) m
        LEFT JOIN (SELECT * FROM base QUALIFY v0 = max(v0) OVER (PARTITION BY market_id)) d USING (market_id) LEFT JOIN n_ids n USING (market_id)
        ORDER BY updated_at_ms DESC, m.market_id LIMIT 20""",
    "fixture_detail": """SELECT CAST(f AS VARCHAR) AS fixture_id, ['World Cup','League','Friendly world cup warm-up','Cup'][f % 4 + 1] AS competition, s.action, s.v % 4 AS home_score,
        m.market_id, d.s1 AS state, n.consensus_id FROM lfx
        LEFT JOIN (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY t DESC, n DESC) = 1) s ON s.fixture_id = CAST(f AS VARCHAR)
        LEFT JOIN (SELECT DISTINCT market_id, fixture_id FROM qv) m ON m.fixture_id = CAST(f AS VARCHAR)
        LEFT JOIN (SELECT * FROM base QUALIFY v0 = max(v0) OVER (PARTITION BY market_id)) d ON d.market_id = m.market_id LEFT JOIN n_ids n ON n.market_id = m.market_id WHERE f = 3""",
    "reaction_latencies": """SELECT a.fixture_id AS signal_id, a.b.market_id AS market_id, k.bookmaker_id, x.first.id AS first_reaction_event_id, x.first.t - a.signal_t AS latency_ms,
        CASE WHEN a.b.status = 'ready' THEN 'measured' ELSE 'baseline_not_ready' END AS status
        FROM pbase a JOIN (SELECT DISTINCT market_id, bookmaker_id FROM qv) k ON k.market_id = a.b.market_id
        LEFT JOIN (SELECT fixture_id, bookmaker_id, min(struct_pack(t := t, id := event_id)) AS first FROM (
            SELECT a.fixture_id, q.bookmaker_id, q.t, q.event_id, max(abs(n.p - o.p)) AS d FROM pbase a JOIN qv q ON q.market_id = a.b.market_id AND q.t >= a.signal_t
            JOIN sets z ON z.trig = a.b.trig AND z.sig = q.sig JOIN norm n ON n.event_id = q.event_id JOIN t_out0 o ON o.trig = a.b.trig AND o.outcome_id = n.outcome_id
            GROUP BY ALL) WHERE d >= 20000 GROUP BY ALL) x ON x.fixture_id = a.fixture_id AND x.bookmaker_id = k.bookmaker_id""",
}


def oracles() -> dict[str, str]:
    """SQL text per query; the others give hashes over whole histories or nested reports, which pytest checks."""
    return {name: _sql(body) for name, body in FINAL.items()}
