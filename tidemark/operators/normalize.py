"""Raw feed records to normalized events, or to quarantine with a code and issues.

Payloads are parsed once into VARIANT; every check looks at the JSON type of a field, so a
number in quotes or a null where none is allowed is malformed rather than silently cast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeedLabels
from tidemark.functions import canonical as cj
from tidemark.functions.staging import fence
from tidemark.schemas import FIXTURE_DDL, ODDS_DDL, SCORE_DDL

# --- fixed values -----------------------------------------------------------------
PHASE_IDS = {
    "A": 15,
    "C": 16,
    "ET1": 7,
    "ET2": 9,
    "F": 5,
    "FET": 10,
    "FPE": 13,
    "H1": 2,
    "H2": 4,
    "HT": 3,
    "HTET": 8,
    "I": 14,
    "NS": 1,
    "P": 19,
    "PE": 12,
    "TXCC": 17,
    "TXCS": 18,
    "WET": 6,
    "WPE": 11,
}
QUARANTINE_CODES = ("unsupported_payload_version", "unknown_payload_kind", "malformed_payload")
CANCELLED_GAME_STATE = 6
MAX_SAFE_INTEGER = 9_007_199_254_740_991
# ----------------------------------------------------------------------------------


# JSON text of every field the checks look at, extracted once per record: path -> column.
_FIELDS: dict[str, str] = {}
_INTEGERS: dict[str, str] = {}


def _json(path: str) -> str:
    """Column holding a field's JSON text: null when absent, the text ``null`` for a JSON null."""
    # column names ignore case, field names do not
    return _FIELDS.setdefault(path, ("lower_" if path[0].islower() else "upper_") + path.replace(".", "_"))


def _integer_of(j: str) -> str:
    """Integral JSON number within the safe range (7.0 counts, "7" does not)."""
    number = rf"{j} RLIKE r'^-?\d+(\.\d+)?([eE][+-]?\d+)?$'"
    real = f"try_cast({j} AS double)"
    return rf"""CASE WHEN {j} RLIKE r'^-?\d{{1,15}}$' THEN cast({j} AS bigint)
        WHEN {number} AND {real} = floor({real}) AND abs({real}) <= {MAX_SAFE_INTEGER} THEN cast({real} AS bigint) END"""


def _string(path: str) -> str:
    return f"CASE WHEN {_json(path)} LIKE '\"%' THEN try_variant_get(v, '$.{path}', 'string') END"


def _boolean(path: str) -> str:
    return f"CASE {_json(path)} WHEN 'true' THEN true WHEN 'false' THEN false END"


def _integer(path: str) -> str:
    """Column holding a field's integer value, null unless it is an integral number."""
    _json(path)
    return _INTEGERS.setdefault(path, "int_" + _json(path))


def _array(path: str) -> str:
    """Array of variants; an absent field is the empty array, any other type is null."""
    return f"""CASE WHEN {_absent(path)} THEN cast(array() AS array<variant>)
        WHEN {_json(path)} LIKE '[%' THEN try_variant_get(v, '$.{path}', 'array<variant>') END"""


def _absent(path: str) -> str:
    return f"{_json(path)} IS NULL"


def _absent_or_null(path: str) -> str:
    return f"({_absent(path)} OR {_json(path)} = 'null')"


def _is_object(path: str) -> str:
    return f"{_json(path)} LIKE '{{%'"


def _checks(*rules: tuple[str, str]) -> str:
    """Array of messages of the rules that do not hold."""
    arms = [f"CASE WHEN NOT coalesce({test}, false) THEN '{message}' END" for message, test in rules]
    # a message is one line; around the tests stands nothing that Spark would interpret instead of compiling
    return rf"array_remove(split(concat_ws('\n', {', '.join(arms)}), '\n'), '')"


def _text_rule(path: str) -> tuple[str, str]:
    # the JSON text of a non-empty string is longer than its two quotes
    return f"{path}: expected non-empty text", f"{_json(path)} LIKE '\"%' AND length({_json(path)}) > 2"


def _int_rule(path: str, least: int | None = None) -> tuple[str, str]:
    test = f"{_integer(path)} IS NOT NULL" if least is None else f"{_integer(path)} >= {least}"
    return f"{path}: expected integer", test


def _optional(path: str, rule: tuple[str, str], nullable: bool = False) -> tuple[str, str]:
    gone = _absent_or_null(path) if nullable else _absent(path)
    return rule[0], f"{gone} OR coalesce({rule[1]}, false)"


def _bool_rule(path: str) -> tuple[str, str]:
    return f"{path}: expected boolean", f"{_json(path)} IN ('true', 'false')"


def _nullable_text(path: str) -> tuple[str, str]:
    return f"{path}: expected text or null", f"{_absent_or_null(path)} OR {_json(path)} LIKE '\"%'"


# --- odds -------------------------------------------------------------------------

_TEXT = "try_variant_get(x, '$', 'string')"
_BOUND = {
    "names_array": _array("PriceNames"),
    "name_texts": f"transform({_array('PriceNames')}, x -> {_TEXT})",
    "prices_array": _array("Prices"),
    # null where it is neither NA nor a number of three decimals
    "pct_texts": rf"""transform({_array('Pct')}, x -> CASE WHEN to_json(x) RLIKE r'^"(NA|\d+\.\d{{3}})"$' THEN {_TEXT} END)""",
}
_NAMES, _NAME_TEXTS, _PRICES, _PCT = _BOUND
_PRICE_OK = rf"coalesce(to_json(x) RLIKE r'^-?\d{{1,16}}$' AND abs(try_cast(to_json(x) AS bigint)) <= {MAX_SAFE_INTEGER}, false)"


def pct_micros(value: str) -> str:
    """Percent text with three decimals to millionths, exactly; null for ``NA`` and from 1000 on."""
    whole = f"ltrim('0', split_part({value}, '.', 1))"
    return rf"""CASE WHEN {value} RLIKE r'^0*\d{{1,3}}\.\d{{3}}$' THEN
        coalesce(try_cast({whole} AS bigint), 0L) * 10000 + try_cast(split_part({value}, '.', 2) AS bigint) * 10 END"""


ODDS_ISSUES = _checks(
    _text_rule("Bookmaker"),
    _int_rule("BookmakerId"),
    _int_rule("FixtureId"),
    _nullable_text("GameState"),
    _bool_rule("InRunning"),
    _nullable_text("MarketParameters"),
    _nullable_text("MarketPeriod"),
    _text_rule("MessageId"),
    (
        "PriceNames: expected non-empty texts",
        f"forall({_NAMES}, x -> to_json(x) LIKE '\"%' AND length(to_json(x)) > 2)",
    ),
    ("Prices: expected integers", f"forall({_PRICES}, x -> {_PRICE_OK})"),
    ("Pct: expected NA or three decimals", f"{_absent('Pct')} OR forall({_PCT}, x -> x IS NOT NULL)"),
    _text_rule("SuperOddsType"),
    _int_rule("Ts", least=0),
    ("Prices: PriceNames and Prices differ in length", f"size({_NAMES}) = size({_PRICES})"),
    ("Pct: Pct and PriceNames differ in length", f"{_absent('Pct')} OR size({_PCT}) = size({_NAMES})"),
    (
        "Pct: above 100.000",
        f"{_absent('Pct')} OR NOT exists({_PCT}, x -> x IS NOT NULL AND x <> 'NA' AND coalesce({pct_micros('x')} > 1000000, true))",
    ),
    (
        "PriceNames: names repeat",
        f"size(array_distinct({_NAME_TEXTS})) = size({_NAMES})",
    ),
)

_PRICE_I = f"try_variant_get(({_PRICES})[i], '$', 'bigint')"
_ODDS_OUTCOMES = f"""transform({_NAME_TEXTS}, (x, i) -> named_struct('name', x,
    'outcome_id', {cj.outcome_id('mid', 'x')}, 'price', {_PRICE_I},
    'reported_probability_micros', CASE WHEN ver = 2 THEN {pct_micros(f'get({_PCT}, i)')} END))"""


# --- score ------------------------------------------------------------------------

# fixed values: field names of the feed, here and in the lists of checks
_DETAIL_FIELDS = (
    ("Action", "text"),
    ("Goal", "bool"),
    ("Id", "int"),
    ("Outcome", "text"),
    ("Penalty", "bool"),
    ("RedCard", "bool"),
    ("Reliable", "bool"),
    ("Type", "text"),
    ("VAR", "bool"),
)
_RULE = {"text": _text_rule, "bool": _bool_rule, "int": _int_rule}


def _object_rules(path: str, fields: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    is_object = (f"{path}: expected object", f"{_absent(path)} OR {_is_object(path)}")
    return [is_object] + [_optional(f"{path}.{n}", _RULE[k](f"{path}.{n}")) for n, k in fields]


def _member(name: str) -> str:
    """Integer member of the array element ``x``."""
    value = f"to_json(variant_get(x, '$.{name}', 'variant'))"
    return f"({_integer_of(value)})"


# fixed values: flags of possible events in the feed
_PARTY = (("Corner", "bool"), ("Goal", "bool"), ("Penalty", "bool"))
_NEUTRAL = (("RedCard", "bool"), ("VAR", "bool"), ("YellowCard", "bool"))
_STAT_OK = " OR ".join(
    "(" + " AND ".join(f"{_member(n)} IS NOT NULL" for n in names) + ")"
    for names in (("Key", "Period", "Value"), ("key", "period", "value"))
)


def _phase_rule(path: str) -> tuple[str, str]:
    return (
        f"{path}: expected integer or text",
        f"{_absent(path)} OR {_integer(path)} IS NOT NULL OR ({_text_rule(path)[1]})",
    )


UPPER_ISSUES = _checks(
    _text_rule("Action"),
    _optional("Confirmed", _bool_rule("Confirmed")),
    *_object_rules("Data", _DETAIL_FIELDS),
    _int_rule("FixtureId"),
    _optional("FollowsAction", _int_rule("FollowsAction")),
    _optional("Id", _int_rule("Id")),
    _optional("Period", _int_rule("Period"), nullable=True),
    _int_rule("Seq", least=0),
    ("Stats: expected key, period, value integers", f"forall({_array('Stats')}, x -> {_STAT_OK})"),
    _optional("StatusId", _int_rule("StatusId"), nullable=True),
    _phase_rule("StatusSoccerId"),
    _int_rule("Ts", least=0),
)
_STATS_MAP = "try_variant_get(v, '$.stats', 'map<string,variant>')"
LOWER_ISSUES = _checks(
    _text_rule("action"),
    _optional("confirmed", _bool_rule("confirmed")),
    *_object_rules("dataSoccer", _DETAIL_FIELDS),
    _int_rule("fixtureId"),
    _optional("followsAction", _int_rule("followsAction")),
    _optional("id", _int_rule("id")),
    *_object_rules("parti1StateSoccer", ()),
    *_object_rules("parti1StateSoccer.PossibleEvent", _PARTY),
    *_object_rules("parti2StateSoccer", ()),
    *_object_rules("parti2StateSoccer.PossibleEvent", _PARTY),
    _optional("period", _int_rule("period"), nullable=True),
    *_object_rules("possibleEventSoccer", _NEUTRAL),
    _int_rule("seq", least=0),
    (
        "stats: expected map of digits to integers",
        f"{_absent('stats')} OR ({_is_object('stats')} AND forall(map_entries({_STATS_MAP}), "
        rf"e -> e.key RLIKE r'^0*\d{{1,15}}$' AND coalesce(to_json(e.value) RLIKE r'^-?\d{{1,16}}$' "
        f"AND abs(try_cast(to_json(e.value) AS bigint)) <= {MAX_SAFE_INTEGER}, false)))",
    ),
    _optional("statusId", _int_rule("statusId"), nullable=True),
    _phase_rule("statusSoccerId"),
    _int_rule("ts", least=0),
)


def phase_id(path: str) -> str:
    """Status id of a phase given as integer or as code; unknown codes are null."""
    table = ", ".join(f"'{k}', {i}" for k, i in PHASE_IDS.items())
    code = f"upper(regexp_replace({_string(path)}, r'(?U)^\\s+|\\s+$', ''))"
    return f"coalesce({_integer(path)}, cast(try_element_at(map({table}), {code}) AS bigint))"


_UPPER_STATS = f"""transform({_array('Stats')}, x -> named_struct(
    'key', coalesce({_member('Key')}, {_member('key')}),
    'period', coalesce({_member('Period')}, {_member('period')}),
    'value', coalesce({_member('Value')}, {_member('value')})))"""
_LOWER_STATS = f"""transform(sort_array(transform(map_entries(coalesce({_STATS_MAP}, cast(map() AS map<string,variant>))),
        e -> named_struct('key', try_cast(e.key AS bigint), 'value', try_variant_get(e.value, '$', 'bigint')))),
    e -> named_struct('key', e.key, 'period', CASE WHEN e.key < 1000 THEN 0L ELSE e.key div 1000 END, 'value', e.value))"""


def _details(data: str, goal: str, penalty: str, red: str, review: str, follows: str) -> str:
    return f"""named_struct('amended_action', {_string(data + '.Action')}, 'outcome', {_string(data + '.Outcome')},
        'possible', named_struct('goal', {goal}, 'penalty', {penalty}, 'red_card', {red}, 'review', {review}),
        'referenced_action_id', cast(coalesce({_integer(data + '.Id')}, {_integer(follows)}) AS string),
        'reliable', {_boolean(data + '.Reliable')}, 'review_type', {_string(data + '.Type')})"""


def _first_flag(*paths: str) -> str:
    """First reported flag: an explicit false wins over a later true."""
    return f"coalesce({', '.join(_boolean(p) for p in paths)})"


_P1, _P2 = "parti1StateSoccer.PossibleEvent", "parti2StateSoccer.PossibleEvent"
_UPPER_DETAILS = _details("Data", *(_boolean(f"Data.{n}") for n in ("Goal", "Penalty", "RedCard", "VAR")), "FollowsAction")
_LOWER_DETAILS = _details(
    "dataSoccer",
    _first_flag("dataSoccer.Goal", f"{_P1}.Goal", f"{_P2}.Goal"),
    _first_flag("dataSoccer.Penalty", f"{_P1}.Penalty", f"{_P2}.Penalty"),
    _first_flag("dataSoccer.RedCard", "possibleEventSoccer.RedCard"),
    _first_flag("dataSoccer.VAR", "possibleEventSoccer.VAR"),
    "followsAction",
)


def _score_parts(upper: bool) -> str:
    """Dialect-free intermediate struct of a score record."""
    n = (lambda a, b: a if upper else b)
    status = n("StatusId", "statusId"), n("StatusSoccerId", "statusSoccerId")
    return f"""named_struct('action', {_string(n('Action', 'action'))}, 'confirmed', {_boolean(n('Confirmed', 'confirmed'))},
        'fixture', {_integer(n('FixtureId', 'fixtureId'))}, 'id', {_integer(n('Id', 'id'))},
        'period', {_integer(n('Period', 'period'))}, 'seq', {_integer(n('Seq', 'seq'))},
        'stats', {n(_UPPER_STATS, _LOWER_STATS)},
        'status', coalesce({_integer(status[0])}, {phase_id(status[1])}),
        'ts', {_integer(n('Ts', 'ts'))}, 'details', {n(_UPPER_DETAILS, _LOWER_DETAILS)})"""


# --- fixture ----------------------------------------------------------------------

FIXTURE_ISSUES = _checks(
    _text_rule("Competition"),
    _int_rule("CompetitionId"),
    _optional("FixtureGroupId", _int_rule("FixtureGroupId")),
    _int_rule("FixtureId"),
    _optional("GameState", _int_rule("GameState")),
    _text_rule("Participant1"),
    _int_rule("Participant1Id"),
    _bool_rule("Participant1IsHome"),
    _text_rule("Participant2"),
    _int_rule("Participant2Id"),
    _int_rule("StartTime"),
    _int_rule("Ts"),
    _optional("gameState", _int_rule("gameState")),
)


def _side(number: int, role: str) -> str:
    return f"""named_struct('id', cast({_integer(f'Participant{number}Id')} AS string),
        'name', {_string(f'Participant{number}')}, 'role', '{role}')"""


_FIXTURE_STRUCT = f"""named_struct('fixture_id', cast({_integer('FixtureId')} AS string),
    'competition', {_string('Competition')}, 'competition_id', cast({_integer('CompetitionId')} AS string),
    'participants', CASE WHEN {_boolean('Participant1IsHome')} THEN array({_side(1, 'home')}, {_side(2, 'away')})
        ELSE array({_side(2, 'home')}, {_side(1, 'away')}) END,
    'scheduled_at_ms', {_integer('StartTime')},
    'status', CASE WHEN coalesce({_integer('GameState')}, {_integer('gameState')}) = {CANCELLED_GAME_STATE}
        THEN 'cancelled' ELSE 'scheduled' END)"""


# --- assembly ---------------------------------------------------------------------


def odds_issues(raw: DataFrame) -> DataFrame:
    """Validation messages of odds payloads; an empty array means valid."""
    parsed = _with_fields(raw.withColumn("v", F.try_parse_json("payload")))
    return parsed.withColumn("issues", F.expr(ODDS_ISSUES)).drop("v", *_FIELDS.values(), *_INTEGERS.values(), *_BOUND)


def _with_fields(df: DataFrame) -> DataFrame:
    """Bind the JSON text of every inspected field as a column.

    An object is gone through once for all its fields, as looking one up goes through the object
    from its beginning.  Names in a struct ignore case, so the two cases have a struct each.
    """
    members: dict[str, dict[bool, list[str]]] = {}
    for path in _FIELDS:
        parent, _, name = path.rpartition(".")
        members.setdefault(parent, {True: [], False: []})[name[0].islower()].append(name)
    place = lambda path, low: f"{'low' if low else 'up'}_of_{path.replace('.', '_')}"
    member = lambda path: f"{place(path.rpartition('.')[0], path.rpartition('.')[2][0].islower())}.{path.rpartition('.')[2]}"
    opened = fence(df)
    for depth in range(max(p.count(".") for p in members if p) + 2):
        level = {p: m for p, m in members.items() if (p.count(".") + 1 if p else 0) == depth}
        opened = opened.withColumns(
            {
                place(p, low): F.expr(f"try_variant_get({member(p) if p else 'v'}, '$', 'struct<{', '.join(f'{n}: variant' for n in names)}>')")
                for p, m in level.items()
                for low, names in m.items()
                if names
            }
        )
    texts = {c: F.expr(f"to_json({member(p)})") for p, c in _FIELDS.items()}
    numbers = {c: F.expr(_integer_of(_json(p))) for p, c in _INTEGERS.items()}
    arrays = {c: F.expr(sql) for c, sql in _BOUND.items()}
    bound = opened.withColumns(texts).drop(*[place(p, low) for p in members for low in (True, False)])
    return fence(bound).withColumns(numbers | arrays)


def _narrow(df: DataFrame, *later: str) -> DataFrame:
    """Drop the bound fields that none of the expressions to come names; a fence would copy them row by row."""
    named = set(re.findall(r"\w+", " ".join(later)))
    return df.drop(*[c for c in (*_FIELDS.values(), *_INTEGERS.values(), *_BOUND) if c not in named])


def normalize(raw: DataFrame, labels: FeedLabels = FeedLabels(), now_ms: int = 0) -> DataFrame:
    """One row per raw record: raw identity, quarantine code and issues, and the event or null.

    Exactly one code applies, in the order of `QUARANTINE_CODES`.
    """
    kinds = "payload_kind IN ('fixture', 'odds', 'score')"
    # the payload kind decides which checks run; each record is parsed once
    typed = raw.selectExpr(
        "* EXCEPT (payload_version, received_at_ms)",
        "coalesce(payload_version, CASE WHEN payload_kind IN ('odds', 'score') THEN 2 ELSE 1 END) AS ver",
        f"coalesce(received_at_ms, {now_ms}L) AS received_at_ms",
        "try_parse_json(payload) AS v",
    )
    supported = "(ver = 1 OR (payload_kind IN ('odds', 'score') AND ver = 2))"
    checked = _with_fields(typed).withColumns(
        {
            "issues_upper": F.expr(f"CASE WHEN payload_kind = 'score' THEN {UPPER_ISSUES} END"),
            "own_issues": F.expr(
                f"CASE payload_kind WHEN 'odds' THEN {ODDS_ISSUES} WHEN 'fixture' THEN {FIXTURE_ISSUES} END"
            ),
        }
    ).withColumn("issues_lower", F.expr(f"CASE WHEN payload_kind = 'score' AND size(issues_upper) > 0 THEN {LOWER_ISSUES} END"))
    coded = fence(checked).withColumn(
        "kind_issues",
        F.expr(
            """CASE WHEN payload_kind <> 'score' THEN own_issues
               WHEN size(issues_upper) = 0 OR size(issues_lower) = 0 THEN cast(array() AS array<string>)
               WHEN size(issues_lower) < size(issues_upper) THEN issues_lower ELSE issues_upper END"""
        ),
    ).withColumns(
        {
            "quarantine_code": F.expr(
                f"""CASE WHEN NOT {supported} THEN '{QUARANTINE_CODES[0]}' WHEN NOT {kinds} THEN '{QUARANTINE_CODES[1]}'
                    WHEN v IS NULL OR size(kind_issues) > 0 THEN '{QUARANTINE_CODES[2]}' END"""
            ),
            "quarantine_issues": F.expr(
                f"""CASE WHEN NOT {supported} THEN array(concat('payload_version: not supported: ', ver))
                    WHEN NOT {kinds} THEN array(concat('payload_kind: not known: ', payload_kind))
                    WHEN v IS NULL THEN array('payload: expected object')
                    WHEN size(kind_issues) > 0 THEN kind_issues END"""
            ),
        }
    )
    good = "quarantine_code IS NULL"
    market = cj.market_id(
        f"cast({_integer('FixtureId')} AS string)",
        _boolean("InRunning"),
        _NAME_TEXTS,
        _string("MarketParameters"),
        _string("MarketPeriod"),
        _string("SuperOddsType"),
    )
    odds = f"""named_struct('fixture_id', cast({_integer('FixtureId')} AS string),
        'bookmaker', named_struct('id', cast({_integer('BookmakerId')} AS string), 'name', {_string('Bookmaker')}),
        'market', named_struct('game_state', {_string('GameState')}, 'in_running', {_boolean('InRunning')},
            'market_id', mid, 'parameters', {_string('MarketParameters')}, 'period', {_string('MarketPeriod')},
            'status', CASE WHEN size({_PRICES}) = 0 THEN 'suspended' ELSE 'open' END, 'type', {_string('SuperOddsType')}),
        'outcomes', {_ODDS_OUTCOMES})"""
    total = "get(filter(s.stats, x -> x.key = {k} AND x.period = 0), 0).value"
    v2 = "ver = 2"
    score = f"""named_struct('fixture_id', cast(s.fixture AS string), 'action', s.action,
        'away_score', {total.format(k=2)}, 'home_score', {total.format(k=1)}, 'period', s.period, 'stats', s.stats,
        'status_id', s.status,
        'action_id', CASE WHEN {v2} THEN cast(coalesce(cast(s.id AS string), concat(s.fixture, ':', s.seq)) AS string) END,
        'confirmed', CASE WHEN {v2} THEN s.confirmed END, 'details', CASE WHEN {v2} THEN s.details END)"""
    is_score = f"({good} AND payload_kind = 'score')"

    def number(upper: str, lower: str, otherwise: str) -> str:
        return f"CASE WHEN {is_score} THEN CASE WHEN size(issues_upper) = 0 THEN {_integer(upper)} ELSE {_integer(lower)} END ELSE {otherwise} END"

    # identity of a record that did not validate: only UpperCase keys are looked at
    loose_fixture, loose_seq = _integer("FixtureId"), _integer("Seq")
    fallback = f"""coalesce(nullif({_string('MessageId')}, ''),
        CASE WHEN {loose_fixture} IS NOT NULL THEN concat({loose_fixture}, ':', coalesce({loose_seq}, 0L)) END,
        concat('sha256:', payload_hash))"""
    priorities = ", ".join(f"'{k}', {p}" for k, p in labels.priorities.items())
    parts = f"CASE WHEN size(issues_upper) = 0 THEN {_score_parts(True)} ELSE {_score_parts(False)} END"
    later = (parts, market, odds, score, fallback, _FIXTURE_STRUCT, _string("MessageId"), _integer("Ts"), loose_fixture)
    # no fence after this one: what a query does not read of a record or its event is not computed
    identified = (
        fence(_narrow(coded.drop("issues_lower", "own_issues", "kind_issues"), *later))
        .withColumns(
            {
                "payload_hash": F.expr(cj.parsed_json_hash("v", "payload")),
                "own_fixture": F.expr(number("FixtureId", "fixtureId", loose_fixture)),
                "event_sequence": F.expr(number("Seq", "seq", "coalesce(sequence, 0L)")),
                "source_timestamp_ms": F.expr(number("Ts", "ts", _integer("Ts"))),
            }
        )
        .withColumns(
            {
                "source_id": F.expr(
                    f"""CASE WHEN NOT ({good}) THEN {fallback}
                        WHEN payload_kind = 'odds' THEN {_string('MessageId')}
                        WHEN payload_kind = 'score' THEN concat(own_fixture, ':', event_sequence)
                        ELSE concat('fixture:', {_integer('FixtureId')}, ':', {_integer('Ts')}) END"""
                ),
                "fixture_id": F.expr("cast(own_fixture AS string)"),
                "source_priority": F.expr(f"cast(try_element_at(map({priorities}), source) AS int)"),
                "kind": F.expr("concat(payload_kind, '.observed')"),
            }
        )
        .withColumns(
            {
                "raw_key": F.expr(cj.raw_key("source", "payload_kind", "source_id", "ver")),
                "event_key": F.expr(f"CASE WHEN {good} THEN {cj.event_key('source', 'kind', 'source_id', 'ver')} END"),
                "s": F.expr(f"CASE WHEN {is_score} THEN {parts} END"),
                "mid": F.expr(f"CASE WHEN {good} AND payload_kind = 'odds' THEN {market} END"),
            }
        )
    )
    extra = [c for c in raw.columns if c not in _CORE_RAW]
    return identified.select(
        *extra,
        F.expr(cj.raw_id("raw_key")).alias("ingest_id"),
        "raw_key",
        "fixture_id",
        "payload_kind",
        F.expr("cast(ver AS int)").alias("payload_version"),
        "source",
        "source_id",
        "source_timestamp_ms",
        "received_at_ms",
        "payload",
        "payload_hash",
        "quarantine_code",
        "quarantine_issues",
        F.expr(f"CASE WHEN {good} THEN {cj.event_id('event_key')} END").alias("event_id"),
        "event_key",
        F.expr(f"CASE WHEN {good} THEN kind END").alias("kind"),
        "source_priority",
        "event_sequence",
        F.expr(f"CASE WHEN {good} AND payload_kind = 'fixture' THEN {_FIXTURE_STRUCT} END").cast(FIXTURE_DDL).alias("fixture"),
        F.expr(f"CASE WHEN {good} AND payload_kind = 'odds' THEN {odds} END").cast(ODDS_DDL).alias("odds"),
        F.expr(f"CASE WHEN {good} AND payload_kind = 'score' THEN {score} END").cast(SCORE_DDL).alias("score"),
    )


_CORE_RAW = ("payload_kind", "payload_version", "source", "received_at_ms", "sequence", "payload")


#: What a step that reads identities alone may drop; the tables below then lack it too.
PAYLOADS = ("payload", "quarantine_issues", "fixture", "odds", "score")


def accepted_events(normalized: DataFrame) -> DataFrame:
    """Events table rows of the records that validated."""
    return normalized.filter("quarantine_code IS NULL").selectExpr(
        "event_id",
        "event_key AS idempotency_key",
        "fixture_id",
        "kind",
        "payload_version",
        "source",
        "source_id",
        "source_priority",
        "source_timestamp_ms",
        "received_at_ms",
        "event_sequence AS sequence",
        *[c for c in ("fixture", "odds", "score") if c in normalized.columns],
    )


def raw_records(normalized: DataFrame, retention_expires_at_ms: Column | None = None) -> DataFrame:
    """Raw table rows, accepted and quarantined alike."""
    expiry = F.lit(None).cast("long") if retention_expires_at_ms is None else retention_expires_at_ms
    return normalized.select(
        "ingest_id",
        F.col("raw_key").alias("idempotency_key"),
        "source",
        "source_id",
        "fixture_id",
        "payload_kind",
        "payload_version",
        F.lit(True).alias("payload_retained"),
        "source_timestamp_ms",
        "received_at_ms",
        expiry.alias("retention_expires_at_ms"),
        *[F.col(c).alias("raw_payload") for c in ("payload",) if c in normalized.columns],
        F.col("payload_hash").alias("raw_payload_hash"),
        F.when(F.col("quarantine_code").isNull(), F.lit("accepted")).otherwise(F.lit("quarantined")).alias("status"),
        "quarantine_code",
        *[c for c in ("quarantine_issues",) if c in normalized.columns],
    )


def quarantined(normalized: DataFrame) -> DataFrame:
    return normalized.filter("quarantine_code IS NOT NULL")


def fixtures_in(raw_fixtures: DataFrame, pattern: str = r"(?i)\bworld cup\b") -> DataFrame:
    """Summaries of valid fixture records whose competition matches, ordered by start time."""
    parsed = _with_fields(raw_fixtures.withColumn("v", F.try_parse_json("payload"))).withColumn("issues", F.expr(FIXTURE_ISSUES))
    valid = parsed.filter(F.size("issues") == 0)
    home = f"CASE WHEN {_boolean('Participant1IsHome')} THEN {_string('Participant1')} ELSE {_string('Participant2')} END"
    away = f"CASE WHEN {_boolean('Participant1IsHome')} THEN {_string('Participant2')} ELSE {_string('Participant1')} END"
    summary = valid.selectExpr(
        f"{_integer('FixtureId')} AS fixture_id",
        f"{_string('Competition')} AS competition",
        f"{_integer('CompetitionId')} AS competition_id",
        f"{home} AS home",
        f"{away} AS away",
        f"coalesce({_integer('GameState')}, {_integer('gameState')}) AS game_state",
        f"{_integer('StartTime')} AS start_time_ms",
    )
    return summary.filter(F.col("competition").rlike(pattern)).orderBy("start_time_ms", "fixture_id")


# --- audits -----------------------------------------------------------------------


def envelope_violations(events: DataFrame, labels: FeedLabels = FeedLabels()) -> DataFrame:
    """Events whose envelope disagrees with payload, source priority or derived identity."""
    priorities = ", ".join(f"'{k}', {p}" for k, p in labels.priorities.items())
    expected = cj.event_key("source", "kind", "source_id", "payload_version")
    issues = _checks(
        ("fixture mismatch", "fixture_id = coalesce(fixture.fixture_id, odds.fixture_id, score.fixture_id)"),
        ("source priority", f"source_priority = try_element_at(map({priorities}), source)"),
        ("idempotency key", f"idempotency_key = {expected}"),
        ("event id", f"event_id = {cj.event_id('idempotency_key')}"),
    )
    return events.withColumn("violations", F.expr(issues)).filter(F.size("violations") > 0).select("event_id", "violations")


def raw_event_mismatches(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Raw/event pairs (joined on source, kind, id and version) whose shared metadata differ."""
    shared = ("fixture_id", "received_at_ms", "source_timestamp_ms")
    right = events.select(
        "source",
        "source_id",
        "payload_version",
        F.regexp_replace("kind", r"\.observed$", "").alias("payload_kind"),
        "event_id",
        *[F.col(c).alias(f"event_{c}") for c in shared],
    )
    differs = F.lit(False)
    for c in shared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"event_{c}"))
    canonical = F.col("ingest_id") == F.expr(cj.raw_id("idempotency_key"))
    return (
        raw.filter("status = 'accepted'")
        .join(right, ["source", "source_id", "payload_version", "payload_kind"])
        .filter(differs | ~canonical)
        .select("ingest_id", "event_id")
    )


def event_violations(events: DataFrame) -> DataFrame:
    """Shape checks of normalized events: lengths, ranges, one home and one away side."""
    def sized(path: str, most: int) -> str:
        return f"length({path}) BETWEEN 1 AND {most}"

    def is_kind(name: str, *tests: str) -> str:
        return f"kind <> '{name}.observed' OR ({' AND '.join(tests)})"

    issues = _checks(
        ("identifier length", " AND ".join(sized(c, 512) for c in ("event_id", "fixture_id", "source_id"))),
        ("key length", sized("idempotency_key", 2048)),
        ("time range", f"source_timestamp_ms BETWEEN 0 AND {MAX_SAFE_INTEGER} AND received_at_ms BETWEEN 0 AND {MAX_SAFE_INTEGER}"),
        ("sequence range", f"sequence BETWEEN 0 AND {MAX_SAFE_INTEGER}"),
        (
            "fixture shape",
            is_kind(
                "fixture",
                sized("fixture.competition", 200),
                sized("fixture.competition_id", 512),
                "size(fixture.participants) = 2",
                "sort_array(fixture.participants.role) = array('away', 'home')",
                "forall(fixture.participants, p -> length(p.id) BETWEEN 1 AND 512 AND length(p.name) BETWEEN 1 AND 200)",
                "fixture.scheduled_at_ms >= 0",
                "fixture.status IN ('scheduled', 'live', 'finished', 'cancelled', 'unknown')",
            ),
        ),
        (
            "odds shape",
            is_kind(
                "odds",
                sized("odds.bookmaker.id", 512),
                sized("odds.bookmaker.name", 200),
                sized("odds.market.market_id", 512),
                sized("odds.market.type", 200),
                "coalesce(length(odds.market.game_state) <= 100, true)",
                "coalesce(length(odds.market.parameters) <= 500, true)",
                "coalesce(length(odds.market.period) <= 100, true)",
                "odds.market.status IN ('open', 'suspended')",
                "odds.market.in_running IS NOT NULL",
                "size(odds.outcomes) <= 100",
                "forall(odds.outcomes, o -> length(o.name) BETWEEN 1 AND 200 AND length(o.outcome_id) BETWEEN 1 AND 512 "
                "AND o.price IS NOT NULL AND coalesce(o.reported_probability_micros BETWEEN 0 AND 1000000, true))",
            ),
        ),
        (
            "score shape",
            is_kind(
                "score",
                sized("score.action", 200),
                "coalesce(score.home_score >= 0, true)",
                "coalesce(score.away_score >= 0, true)",
                "size(score.stats) <= 1000",
                "forall(score.stats, x -> x.key >= 0 AND x.period IS NOT NULL AND x.value IS NOT NULL)",
                f"(payload_version = 1 OR ({sized('score.action_id', 512)} AND score.details IS NOT NULL))",
            ),
        ),
    )
    flagged = events.withColumn("violations", F.expr(issues))
    return flagged.filter(F.size("violations") > 0).select("event_id", "violations")
