"""Secret scan in DataFrame expressions only: pattern matches plus windows of high entropy.

Base patterns are matched leftmost and non-overlapping per kind; a span is the whole match in code
points, end exclusive. The method adds kind ``entropy``: every maximal run of token characters is a
candidate; a window of fixed width slides over it. The state is the count of each character in the
window and the sum of c*log2(c) over the counts; a step changes the two counts of the characters that
leave and enter, and the sum by these. Each character class (hex digits,
letters and digits, the base64 alphabet) has its own threshold. A candidate that an allow-list pattern
matches is suppressed.

Nothing is shuffled: every span of a text is found in the row that holds the text. Work grows in
proportion to a text's length, with a logarithm of its number of matches: places are prefix sums, which
are doubled in whole-array steps, and redaction cuts the text from blocks of BLOCK characters.

Cases: a null text is the empty text; a text without matches gives zero counts, empty spans and the
digest of the empty string; a null id is kept; equal rows each give a row; other columns of the input
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds with their patterns, the group whose length counts and that least length; the
#: last is a pattern that every text with such a match holds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (
    ("assign", ASSIGN, 2, 12, r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    ("access", ACCESS, 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", HEX, 0, 16, r"[0-9a-f]{16}"),
)
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class, pattern of the whole candidate, least bits per character in a window of WIDTH.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", 3.03),
    ("alnum", r"^[0-9A-Za-z]+$", 3.53),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.77),
)
WIDTH = 20
#: Candidates' characters are so many from this code on; a count of none as a character, and the widest window.
FIRST_CODE, SYMBOLS, NONE, WIDEST = 43, 80, 32, 94
#: Characters of a block that a text is cut from.
BLOCK = 2048
#: Candidates that are no secrets: no digit or no letter, one symbol repeated, counting sequences,
#: dotted or dashed words, UUIDs, and marked examples.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^(.)\1*$",
    r"(?i)0123456789|abcdefghij|example|placeholder|xxxx",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([-_/=+][A-Za-z0-9]{1,8})*$",
)


SPAN = "array<struct<start:int,k:int,end:int>>"


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _scan(values: Column, join) -> Column:
    """For each element what join makes of it and all before it; the reach doubles with each step."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    steps = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))

    def double(acc, step):
        reach = _shifted(F.lit(1), step)
        return F.transform(acc, lambda v, i: F.when(i >= reach, join(v, F.get(acc, i - reach))).otherwise(v))

    return F.aggregate(steps, values, double)


def _bound(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _placed(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, m>> of all matches, m the length of their group.

    The pieces between matches and the matches alternate, so the prefix sums of their lengths give the ends.
    """
    hits = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("n"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("m"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
    )
    matches = _bound(hits, lambda h: F.filter(h, lambda x: x["n"].isNotNull()))
    return _bound(
        matches,
        lambda h: F.zip_with(
            h,
            _scan(F.transform(h, lambda x: x["gap"] + x["n"]), lambda a, b: a + b),
            lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["m"].alias("m")),
        ),
    )


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, holds: str) -> Column:
    """Spans of all matches whose group has the least length, in order.

    They are placed only in texts in which a long enough match can be.
    """
    order = F.lit(KINDS.index(kind))
    found = F.transform(
        F.filter(_placed(text, pattern, group), lambda x: x["m"] >= least),
        lambda x: F.struct(x["start"].alias("start"), order.alias("k"), x["end"].alias("end")),
    )
    return F.when(text.rlike(holds), found).otherwise(F.array().cast(SPAN))


def _surprise(count: Column, width: int) -> Column:
    """count * log2(count), from a table."""
    table = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    return F.element_at(F.array(*[F.lit(x) for x in table]), count + 1)


def _entropy_hit(candidate: Column, width: int) -> Column:
    """First and last start of a window at or over its class's threshold, as a struct; null where none."""
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(least)
    places = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - (FIRST_CODE - 1))
    w = F.lit(width)
    nothing = F.lit(None).cast("int")
    # The counts are a string, a character for each symbol: its code less NONE is how often the window has it.
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - NONE
    counted = lambda counts, place, n: F.overlay(counts, F.char(n + NONE), place, F.lit(1))

    def enter(acc, place):
        """The window with one more character."""
        return _bound(
            count(acc["counts"], place),
            lambda n: F.struct(
                counted(acc["counts"], place, n + 1).alias("counts"),
                (acc["s"] - _surprise(n, width) + _surprise(n + 1, width)).alias("s"),
            ),
        )

    def leave(acc, place):
        return _bound(
            count(acc["counts"], place),
            lambda n: F.struct(
                counted(acc["counts"], place, n - 1).alias("counts"),
                (acc["s"] - _surprise(n, width) + _surprise(n - 1, width)).alias("s"),
            ),
        )

    def slid(pair):
        places, least = pair["places"], pair["least"]
        over = lambda s: (math.log2(width) - s / w) >= least
        none = F.struct(F.lit(chr(NONE) * SYMBOLS).alias("counts"), F.lit(0.0).alias("s"))
        state = _bound(
            F.aggregate(F.slice(places, 1, w), none, enter),
            lambda f: F.struct(
                f["counts"].alias("counts"),
                f["s"].alias("s"),
                F.when(over(f["s"]), F.lit(0)).otherwise(nothing).alias("first"),
                F.when(over(f["s"]), F.lit(0)).otherwise(nothing).alias("last"),
            ),
        )
        steps = F.when(F.size(places) > w, F.sequence(F.lit(1), F.size(places) - w)).otherwise(F.array().cast("array<int>"))

        def step(acc, i):
            """The window that starts at i: one character leaves and one enters."""
            moved = _bound(leave(acc, F.element_at(places, i)), lambda left: enter(left, F.element_at(places, i + w)))
            return _bound(
                moved,
                lambda now: F.struct(
                    now["counts"].alias("counts"),
                    now["s"].alias("s"),
                    F.coalesce(acc["first"], F.when(over(now["s"]), i)).alias("first"),
                    F.when(over(now["s"]), i).otherwise(acc["last"]).alias("last"),
                ),
            )

        return F.aggregate(steps, state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _bound(F.struct(places.alias("places"), least.alias("least")), slid)


def _entropy_spans(text: Column, width: int) -> Column:
    if not 0 < width <= WIDEST:
        raise ValueError(f"a window holds 1 to {WIDEST} characters")
    candidates = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    named = F.zip_with(
        _placed(text, CANDIDATE, 0), candidates, lambda x, c: F.struct(x["start"].alias("at"), c.alias("c"))
    )
    measured = F.transform(
        F.filter(named, lambda x: ~_allowed(x["c"])),
        lambda x: F.struct(x["at"].alias("at"), _entropy_hit(x["c"], width).alias("hit")),
    )
    spans = F.transform(
        F.filter(measured, lambda x: x["hit"]["first"].isNotNull()),
        lambda x: F.struct(
            (x["at"] + x["hit"]["first"]).alias("start"),
            F.lit(KINDS.index("entropy")).alias("k"),
            (x["at"] + x["hit"]["last"] + F.lit(width)).alias("end"),
        ),
    )
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(SPAN))


def _allowed(candidate: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | candidate.rlike(pattern)
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda x: F.concat_ws(
                ":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", width: int = WIDTH) -> DataFrame:
    """docs with column ``into``: array<struct<start, k, end>> of all spans, k an index into KINDS.

    A column of that name that docs already has is replaced; free_name() gives one that it has not.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = [_spans(whole, *kind) for kind in BASE]
    return docs.withColumn(into, F.concat(*found, _entropy_spans(whole, width)))


def redact(docs: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mark, overlapping spans by one mark together."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    b = F.lit(BLOCK)

    def between(blocks, start, end):
        """Characters from start to end of a text cut in blocks."""
        first, last = F.floor(start / b).cast("int"), F.floor(end / b).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        inner = F.when(last - first > 1, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
        return F.when(end <= start, F.lit("")).when(
            first == last, F.substring(block(first), start % b + 1, end - start)
        ).otherwise(F.concat(F.substring(block(first), start % b + 1, b), inner, F.substring(block(last), F.lit(1), end % b)))

    def rebuilt(x):
        """The text before each span that begins a new one, its mark, and what follows the last."""
        blocks, found, ends, size = x["blocks"], x["found"], x["ends"], x["size"]
        kept = F.transform(
            found,
            lambda s, i: _bound(
                F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)),
                lambda before: F.when(s["start"] >= before, F.concat(between(blocks, before, s["start"]), F.lit(mark))).otherwise(""),
            ),
        )
        return F.concat(F.array_join(kept, ""), between(blocks, F.element_at(ends, -1), size))

    sorted_ = F.sort_array(F.col(f"`{spans}`"))
    parts = F.struct(
        F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
        sorted_.alias("found"),
        _scan(F.transform(sorted_, lambda s: s["end"]), F.greatest).alias("ends"),
        F.length(whole).alias("size"),
    )
    return docs.withColumn(
        text, F.when(F.size(F.col(f"`{spans}`")) > 0, _bound(parts, rebuilt)).otherwise(F.col(f"`{text}`"))
    )


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def secret_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of base spans, the digest of the base spans and all spans."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = find_secrets(slim, "text", "found").select("doc_id", "found")
    of = lambda kind: F.filter(F.col("found"), lambda x: x["k"] == KINDS.index(kind))
    base = F.filter(F.col("found"), lambda x: x["k"] != KINDS.index("entropy"))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for secret_report(documents); it measures each window's entropy anew.

    Hex digits and access keys are whole runs, so there the least length can stand in the pattern.
    """
    q = lambda x: "'" + x.replace("'", "''") + "'"
    bare = lambda p: p.replace(r"\x20", " ")
    only = {HEX: "[0-9a-f]{16,}", ACCESS: "AKIA[A-Z0-9]{14,}"}
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {KINDS.index(kind)} AS k, unnest(range(1, len(hits) + 1)) AS i, hits, gaps,
            regexp_extract_all(text, {q(bare(pattern))}, {group}) AS measured, {least} AS least
        FROM (SELECT doc_id, text, regexp_extract_all(text, {q(bare(pattern))}) AS hits,
            string_split_regex(text, {q(bare(pattern))}) AS gaps FROM d)"""
        for kind, pattern, group, least, _ in (*BASE, ("entropy", CANDIDATE, 0, WIDTH, ""))
        for pattern in [only.get(pattern, pattern)]
    )
    bits = " ".join(f"WHEN regexp_matches(c, {q(p)}) THEN {b}" for _, p, b in CLASSES)
    plain = [p for p in ALLOWED if "\\1" not in p]
    allowed = " OR ".join(
        [f"regexp_matches(c, {q(p)})" for p in plain] + ["len(list_distinct(string_split(c, ''))) = 1"]
    )
    text = lambda where: (
        "coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k, e)" + where + ", '')"
    )
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{kind}" for i, kind in enumerate(KINDS))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, coalesce(text, '') AS text FROM documents),
    matched AS ({found.replace("doc_id", "r")}),
    placed AS (
        SELECT r, k, hits[i] AS c,
            list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (FROM matched WHERE length(measured[i]) >= least)),
    candidate AS (
        SELECT r, s, c, CASE {bits} END AS least FROM placed WHERE k = 3 AND NOT ({allowed})),
    windows AS (
        SELECT r, s, list_filter(range(0, length(c) - {WIDTH} + 1),
            lambda x: list_aggregate(string_split(substr(c, x + 1, {WIDTH}), ''), 'entropy') >= least) AS w
        FROM candidate),
    spans AS (
        SELECT r, k, CAST(s AS BIGINT) AS s, CAST(s + length(c) AS BIGINT) AS e FROM placed WHERE k < 3
        UNION ALL
        SELECT r, 3, CAST(s + w[1] AS BIGINT), CAST(s + w[-1] + {WIDTH} AS BIGINT) FROM windows WHERE len(w) > 0),
    named AS (SELECT *, {list(KINDS)}[k + 1] AS name FROM spans)
    SELECT any_value(d.id) AS doc_id, {counts},
        sha256({text(" FILTER (k < 3)")}) AS base_sha256, {text("")} AS spans
    FROM d LEFT JOIN named USING (r) GROUP BY d.r
    """
