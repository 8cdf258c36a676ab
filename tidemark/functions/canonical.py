"""Canonical JSON text and the content-addressed identifiers built on it.

The helpers compose Spark SQL expression text, so a whole document renders and hashes as
one expression inside the JVM.  Arguments are SQL expressions, usually column names; turn
a result into a Column with `F.expr`.
"""

from __future__ import annotations

from collections.abc import Mapping


def literal(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else 'r"' + value + '"'


def text(v: str) -> str:
    """JSON string literal, or ``null``; control characters take their short or hex escape."""
    short = r"map(8, r'\b', 9, r'\t', 10, r'\n', 12, r'\f', 13, r'\r')"
    escape = rf"coalesce(try_element_at({short}, c), concat(r'\u00', lower(lpad(hex(c), 2, '0'))))"
    start = rf"""replace(replace({v}, r'\', r'\\'), '"', r'\"')"""
    escaped = f"aggregate(sequence(0, 31), {start}, (a, c) -> replace(a, chr(c), {escape}))"
    body = rf"""CASE WHEN {v} RLIKE r'["\\\x00-\x1f]' THEN {escaped} ELSE {v} END"""
    return f"""coalesce(concat('"', {body}, '"'), 'null')"""


def plain(v: str) -> str:
    """JSON string literal for values known to need no escaping (hashes, enum words)."""
    return f"""coalesce(concat('"', {v}, '"'), 'null')"""


def scalar(v: str) -> str:
    """JSON integer or boolean literal, or ``null``."""
    return f"coalesce(cast({v} AS string), 'null')"


def items(values: str, variable: str, render: str) -> str:
    return f"concat('[', array_join(transform({values}, {variable} -> {render}), ','), ']')"


def obj(fields: Mapping[str, str]) -> str:
    """JSON object with its keys in binary order."""
    parts = []
    for position, key in enumerate(sorted(fields)):
        opening = "{" if position == 0 else ","
        parts.append(f"""'{opening}"{key}":', {fields[key]}""")
    return f"concat({', '.join(parts)}, '}}')" if parts else "'{}'"


def digest(v: str) -> str:
    return f"sha2({v}, 256)"


def short_id(prefix: str, v: str) -> str:
    """Prefix plus the first 40 hex characters of the hash of ``v``."""
    return f"concat('{prefix}', substring(sha2({v}, 256), 1, 40))"


def utf16_length(v: str) -> str:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    astral = rf"length(regexp_replace({v}, r'[\x{{0}}-\x{{FFFF}}]', ''))"
    return f"(CASE WHEN octet_length({v}) = length({v}) THEN length({v}) ELSE length({v}) + {astral} END)"


def key(head: str, *parts: str) -> str:
    """Length-prefixed key: ``head|len:part|len:part``."""
    coded = [f"concat(cast({utf16_length(p)} AS string), ':', {p})" for p in parts]
    return f"concat_ws('|', '{head}', {', '.join(coded)})"


# Two conventions exist for hashing a key: as a JSON string (with quotes) for events
# and raw records, and bare for decisions.


def event_key(source: str, kind: str, source_id: str, version: str) -> str:
    return key("event", source, kind, source_id, f"cast({version} AS string)")


def event_id(event_key_: str) -> str:
    return short_id("evt_", text(event_key_))


def raw_key(source: str, kind: str, source_id: str, version: str) -> str:
    return key("raw", source, kind, source_id, f"cast({version} AS string)")


def raw_id(raw_key_: str) -> str:
    return short_id("raw_", text(raw_key_))


def decision_key(trigger: str, market: str, version: str, config_hash: str | None = None) -> str:
    return key("decision", trigger, market, version, *([] if config_hash is None else [config_hash]))


def decision_id(decision_key_: str) -> str:
    return short_id("dec_", decision_key_)


def market_id(fixture: str, in_running: str, names: str, parameters: str, period: str, type_: str) -> str:
    return short_id(
        "mkt_",
        obj(
            {
                "fixtureId": text(fixture),
                "inRunning": scalar(in_running),
                "outcomeNames": items(f"sort_array({names})", "name", text("name")),
                "parameters": text(parameters),
                "period": text(period),
                "type": text(type_),
            }
        ),
    )


def outcome_id(market: str, name: str) -> str:
    return short_id("out_", obj({"market": text(market), "name": text(name)}))


def json_hash(payload: str) -> str:
    """Hash of a JSON document in canonical form; text that is no JSON hashes as a JSON string.

    A VARIANT keeps object fields in key order, which is what the canonical form needs.
    """
    return parsed_json_hash(f"try_parse_json({payload})", payload)


def parsed_json_hash(parsed: str, payload: str) -> str:
    """`json_hash` of a payload whose VARIANT is at hand."""
    return digest(f"coalesce(to_json({parsed}), {text(payload)})")
