"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression.  From its syntax tree the operator derives a Boolean query
over trigrams every match must contain.  An inverted index (trigram, document) is built for the
trigrams of all queries, postings are intersected per alternative, and the candidates are
verified with the expression itself.  Rules without a mandatory trigram scan every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as syntax
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


@dataclass(frozen=True)
class Rule:
    """``pattern``: for Python's and Java's regex alike; the ``group`` must have ``least`` characters.

    Matches are leftmost and do not overlap; a match whose group is too short is dropped after
    matching, so it still covers its text.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same matches as runs of any length, cut to 24 and more
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)

# A query is a list of alternatives (any of them), each a set of lower-case trigrams (all of them).
Query = list[frozenset[str]]
_MOST = 64  # literals an expression may expand to before it counts as anything


def _literals(tree) -> list[list[str | None]]:
    """Alternatives of ``tree``, each a sequence of literal runs and None for anything."""
    out: list[list[str | None]] = [[]]
    for op, arg in tree:
        if op is syntax.LITERAL:
            options: list[list[str | None]] = [[chr(arg)]]
        elif op is syntax.IN and len(arg) <= 8 and all(o is syntax.LITERAL for o, _ in arg):
            options = [[chr(c)] for _, c in arg]
        elif op is syntax.SUBPATTERN:
            options = _literals(arg[3])
        elif op is syntax.BRANCH:
            options = [x for branch in arg[1] for x in _literals(branch)]
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT):
            low, high, inner = arg
            once = _literals(inner)
            if (low, high) == (0, 1):
                options = [[], *once]
            elif low == 0:
                options = [[None]]
            else:
                options = [[*x, None] if high > 1 else x for x in once]
        elif op is syntax.AT:
            options = [[]]
        else:
            options = [[None]]
        if len(out) * len(options) > _MOST:
            options = [[None]]
        out = [a + b for a in out for b in options]
    return out


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of mandatory trigrams, in lower case; None if some match needs no trigram."""
    alternatives: set[frozenset[str]] = set()
    for parts in _literals(parser.parse(pattern)):
        runs = "".join("\0" if x is None else x for x in parts).lower().split("\0")
        grams = {r[k : k + 3] for r in runs for k in range(len(r) - 2)}
        if not grams:
            return None
        alternatives.add(frozenset(grams))
    # An alternative with more trigrams than another one finds nothing new.
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in ``text`` as (start, end) code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    gaps = F.slice(between, 1, F.size(found))
    steps = F.zip_with(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"))),
        tested,
        lambda s, t: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), F.length(t).alias("tested")),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")

    def walk(block: Column, start: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            first = s["at"] + m["gap"]
            span = F.struct(F.lit(rule.kind).alias("kind"), first.alias("start"), (first + m["n"]).alias("end"))
            longer = F.when(m["tested"] >= rule.least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
            return F.struct((first + m["n"]).alias("at"), longer.alias("spans"))

        return F.aggregate(block, F.struct(start.alias("at"), none.alias("spans")), step, lambda s: s["spans"])

    def placed(blocks: Column) -> Column:
        width = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, m: n + m["gap"] + m["n"]))
        starts = _running(width, lambda at, n: at + n)
        return F.flatten(F.zip_with(blocks, starts, walk))

    return F.when(F.size(found) > 0, _let(_blocks(steps), placed)).otherwise(none)


# Spans and masked texts are built in blocks of this many matches: an array that grows by one is
# copied at each step, which over all matches of a text takes time in their square.
_BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """``items`` (one at least) cut into arrays of _BLOCK."""
    return _let(
        items,
        lambda held: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(held) - 1) / _BLOCK).cast("int")),
            lambda k: F.slice(held, k * _BLOCK + 1, F.lit(_BLOCK)),
        ),
    )


def _running(values: Column, use: Callable[[Column, Column], Column]) -> Column:
    """The state before each of ``values``, from zero on."""
    return F.aggregate(
        values,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("seen")),
        lambda s, v: F.struct(use(s["at"], v).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")),
        lambda s: s["seen"],
    )


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of ``grams``: (gram, row_key)."""
    present = F.array_compact(F.array(*[F.when(F.col("lower").contains(g), F.lit(g)) for g in grams]))
    return texts.select("row_key", F.lower("text").alias("lower")).select("row_key", F.explode(present).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(row_key, rules): the documents that have all trigrams of some alternative of a rule."""
    bits = {g: k for k, g in enumerate(sorted({g for q in queries.values() for a in q for g in a}))}
    number = F.create_map(*[x for g, k in bits.items() for x in (F.lit(g), F.lit(k))])
    # Intersection of postings: the bits of a document's trigrams, summed before the shuffle.
    held = index.groupBy("row_key").agg(F.collect_set(number[F.col("gram")]).alias("held"))

    def met(query: Query) -> Column:
        ways = [F.size(F.array_intersect("held", F.array(*[F.lit(bits[g]) for g in sorted(a)]))) == len(a) for a in query]
        return reduce(lambda x, y: x | y, ways)

    rules = F.array_compact(F.array(*[F.when(met(q), F.lit(kind)) for kind, q in queries.items()]))
    return held.select("row_key", rules.alias("rules")).where(F.size("rules") > 0)


def secrets(documents: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """``documents`` with ``secrets``: all matches as (kind, start, end), by start, then by rule order.

    Null and empty texts have none.  Rows are told apart by a hash of doc_id and text: rows
    without id and repeated rows are scanned like any other.  Very long texts are scanned whole.
    An empty table gives an empty result.  Other columns stay, whatever their names; one named
    ``secrets`` is replaced.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    key, tested = free_name(documents, "row_key"), free_name(documents, "rules")
    docs = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    if queries:
        grams = sorted({g for q in queries.values() for a in q for g in a})
        index = staged(postings(docs.select(F.col(key).alias("row_key"), "text"), grams))
        docs = docs.join(candidates(index, queries).toDF(key, tested), key, "left")
    else:
        docs = docs.withColumn(tested, F.lit(None).cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    found = [
        F.when(F.array_contains(tested, r.kind), _spans(text, r)).otherwise(empty) if r.kind in queries else _spans(text, r)
        for r in rules
    ]
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    ranked = F.transform(
        F.concat(*found),
        lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(
        F.array_sort(ranked),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return docs.withColumn("secrets", spans).drop(key, tested)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(documents: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, mark: str = "[secret]") -> DataFrame:
    """``documents`` with ``mark`` in place of every secret in ``text``; n_chars, if there, follows.

    Matches of several rules that overlap become one mark; texts without secrets stay as they are,
    null and empty ones too.  Very long texts are masked whole, repeated rows alike; an empty table
    gives an empty result.  Other columns stay, whatever their names.
    """
    held, name = free_name(documents, "secrets"), free_name(documents, "clean")
    out = secrets(documents.withColumnRenamed("secrets", held), rules)
    text = F.col("text")

    def masked(block: Column, start: Column) -> Column:
        """The text from ``start`` to the end of the block's last match."""
        end = F.aggregate(block, start, lambda at, m: F.greatest(at, m["end"]))
        part = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

        def step(piece: Column) -> Callable[[Column, Column], Column]:
            def go(s: Column, m: Column) -> Column:
                before = F.substring(piece, (s["at"] - start + 1).cast("int"), (m["start"] - s["at"]).cast("int"))
                longer = F.when(m["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.array(F.concat(before, F.lit(mark)))))
                return F.struct(F.greatest(s["at"], m["end"]).alias("at"), longer.alias("out"))

            return go

        first = F.struct(start.alias("at"), F.array().cast("array<string>").alias("out"))
        return _let(part, lambda piece: F.aggregate(block, first, step(piece), lambda s: F.array_join(s["out"], "")))

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda at, m: F.greatest(at, m["end"])))
        starts = _running(ends, F.greatest)
        tail = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.zip_with(blocks, starts, masked), ""), tail)

    hit = F.size("secrets") > 0
    clean = F.when(hit, _let(_blocks(F.col("secrets")), joined)).otherwise(text)
    out = out.withColumn(name, clean)
    columns = {"text": F.col(name)}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        columns["n_chars"] = F.when(hit, F.length(name).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[columns.get(c, F.col(f"`{held if c == 'secrets' else c}`")).alias(c) for c in documents.columns])
