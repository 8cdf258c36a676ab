"""Plain DuckDB SQL for the operators that SQL can express; the others are tested by brute force."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
    SELECT DISTINCT item_id, w[k : k + 9] AS win
    FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS n FROM win),
doc AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
piece AS (
    SELECT doc_id, k, n, w[k : k + n - 1] AS win
    FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n
), hit AS (SELECT DISTINCT doc_id, k, n, item_id FROM piece JOIN win USING (win)),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS u(p) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
        sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256
    FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _secret_rule(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
        list_sum(list_transform(gaps[1 : k], lambda x: length(x)))
            + coalesce(list_sum(list_transform(found[1 : k - 1], lambda x: length(x))), 0) AS start,
        length(found[k]) AS n, length(tested[k]) AS tested, {least} AS least
    FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS found,
            regexp_extract_all(text, '{pattern}', {group}) AS tested,
            regexp_split_to_array(text, '{pattern}') AS gaps
        FROM documents WHERE text IS NOT NULL
    ), unnest(range(1, len(found) + 1)) AS u(k)"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _op7() -> str:
    words = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = (
        ("assign", rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]{24,}", 0, 24),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
        ("key_block", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    )
    union = " UNION ALL ".join(_secret_rule(k, *r) for k, r in enumerate(rules))
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT)"
    return f"""
WITH span AS (SELECT * FROM ({union}) WHERE tested >= least),
listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
        string_agg({text}, ',' ORDER BY start, rank) AS spans
    FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


OP11 = r"""
WITH doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), marked AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM doc LEFT JOIN marked USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT [a.name, b.name, c.name, d.name, e.name] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
    SELECT array_to_string(names, '') AS filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit,
        coalesce(list_sum(bits[1 : k - 1]), 0)::INTEGER AS earlier
    FROM orders, unnest([1, 2, 3, 4, 5]) AS u(k)
), counted AS (
    SELECT part, filter_order, step, bit,
        count(*) FILTER (mask & (earlier | bit) = 0) AS kept,
        count(*) FILTER (mask & earlier = 0 AND mask & bit > 0) AS removed,
        count(*) FILTER (mask & earlier > 0 AND mask & bit > 0) AS redundant,
        count(*) FILTER (mask = bit) AS unique_fails,
        count(*) FILTER (mask & earlier = 0 AND mask & bit > 0 AND good) AS good_lost,
        count(*) FILTER (mask & earlier = 0 AND mask & bit > 0 AND toxic) AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


OP12 = """
WITH given AS (
    SELECT conv_id, coalesce(role, '') || sha256(coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS size,
        row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))
        ) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
    SELECT conv_id, list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS items
    FROM given GROUP BY conv_id
), conv AS (
    SELECT conv_id, xor(list_reduce(items, lambda c, x:
        xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 9 AS h
    FROM bytes
), joined AS (
    SELECT conv.conv_id, 0 AS part, k, key, size FROM conv JOIN given ON given.conv_id = conv.conv_id - conv.conv_id % 5 AND k <= h
    UNION ALL
    SELECT conv.conv_id, 1, k, key, size FROM conv JOIN given ON given.conv_id = conv.conv_id AND k > h
), said AS (
    SELECT conv_id, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth,
        sha256(string_agg(key, '/') OVER (PARTITION BY conv_id ORDER BY part, k)) AS path
    FROM joined
), member AS (SELECT conv_id, depth, path, size FROM said UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
node AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM member GROUP BY ALL
), linked AS (
    SELECT node.*, above.path AS above FROM node
    LEFT JOIN member AS above ON above.conv_id = node.conv_id AND above.depth = node.depth - 1
), children AS (SELECT above AS path, count(*) AS n_children FROM linked GROUP BY above),
below AS (
    SELECT member.path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
    FROM node LEFT JOIN children USING (path) JOIN member ON member.conv_id = node.conv_id AND member.depth <= node.depth
    GROUP BY member.path
), ending AS (
    SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(path, depth) AS path FROM member GROUP BY conv_id) GROUP BY path
)
SELECT linked.conv_id, linked.depth, up.conv_id AS parent_conv_id, linked.n_convs, coalesce(n_children, 0) AS n_children,
    n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM linked LEFT JOIN node AS up ON up.path = linked.above
LEFT JOIN children ON children.path = linked.path
JOIN below ON below.path = linked.path LEFT JOIN ending ON ending.path = linked.path
"""


def oracles() -> dict[str, str]:
    return {
        "op7_secret_scan": _op7(),
        "op9_benchmark_contamination": OP9,
        "op11_filter_audit": OP11,
        "op12_prefix_trie": OP12,
    }
