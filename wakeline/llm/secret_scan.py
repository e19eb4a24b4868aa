"""Secret scans: spans of credentials, and weak parts linked by an interval join.

Method. Three strong kinds are secrets on their own: an assigned value, an access key, a long run of hex digits. Three
weak kinds are not: an account name, a short or unnamed secret, an endpoint. A weak part is reported only where its
complements co-occur: secrets and account names are joined where the name starts within ``REACH`` code points of the
secret and both lie in the same scope (a paragraph: what stands between two blank lines). A pair makes its weak members
reported; an endpoint that starts within reach of a paired secret is reported with it. Strong spans serve as partners:
access keys as account names, assigned values and hex runs as secrets. Weak parts that touch a strong span are that
span, not a part of their own.

Scale. Only DataFrame functions. The text is read once; what leaves that pass are the lengths of the matches and of the
gaps before them, from which a running sum per text and kind gives the places. Texts are keyed by their row, so neither
an id nor a text that a third of all rows share is a hot key. The interval join meets on (row, cell of ``REACH`` code
points) and checks the distance; a name stands in one cell, a secret in those it reaches, so the pairs of a text grow
with its length, not with its square. Texts without a weak part do not reach the join.

Defined cases: a null text is empty and has no spans; repeated rows and null ids each keep their own row; very long
texts are scanned whole; spans of different kinds may overlap, those of one kind do not; a kind's matches are taken
leftmost first, then those that fail its length drop out; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.session import cut_lineage

#: A name and a secret, or a secret and an endpoint, farther apart do not belong together.
REACH = 200


def either_case(words: str) -> str:
    """A pattern of the words, its ASCII letters in either case, for engines that fold other letters too."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


def assigned(names: str, value: str) -> str:
    return rf"""({either_case(names)})["']?\x20*[:=]\x20*["']?({value}+)"""


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    least: int
    #: Group whose length must reach ``least``.
    group: int = 0
    #: Patterns a match must also hold.
    holds: tuple[str, ...] = ()


#: Fixed kinds, in the order of the contract.
STRONG = (
    Kind("assign", assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]"), 6, 2),
    # maximal runs: those of the least length are the runs of any length that reach it
    Kind("access", "AKIA[A-Z0-9]{16,}", 20),
    Kind("hex", "[0-9a-f]{24,}", 24),
)
WEAK = (
    Kind("account", assigned("user|username|login|account|client_?id|key_?id|access_?key", "[A-Za-z0-9+/_.@-]"), 3, 2),
    Kind("short_secret", assigned("password|passwd|secret|token|api_?key|pass|pwd|passphrase|credential|auth|pin", "[A-Za-z0-9+/_.=-]"), 4, 2),
    Kind("bare_secret", "[A-Za-z0-9+/_]{20,}", 20, 0, ("[0-9]", "[a-z]", "[A-Z]")),
    Kind("endpoint", r"(https?|ftp|ssh|s3|smtp|ldap|redis|amqp|mysql|mongodb|postgresql)://[A-Za-z0-9._~:/@-]+", 8),
)
KINDS = STRONG + WEAK
#: A blank line: it ends a scope.
BLANK = Kind("blank", r"\n[\x20\t\r]*\n", 2)
ACCOUNTS, SECRETS, ENDPOINTS = ("access", "account"), ("assign", "hex", "short_secret", "bare_secret"), ("endpoint",)


def numbers(*names: str) -> list[int]:
    return [k for k, kind in enumerate(KINDS) if kind.name in names]


def matches(text: Column, kind: Kind) -> Column:
    return F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))


def passing(match: Column, kind: Kind) -> Column:
    value = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
    ok = F.char_length(value) >= kind.least
    for p in kind.holds:
        ok = ok & match.rlike(p)
    return ok


def lengths(text: Column, found: Column, k: int, kind: Kind) -> Column:
    """Of each match: kind, number, length of the gap before it, its length and whether it counts."""
    gaps = F.split(text, kind.pattern, -1)
    each = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
        lambda e, i: F.struct(
            F.lit(k).alias("kind"), i.alias("at"), F.char_length(e["g"]).alias("gap"), F.char_length(e["m"]).alias("size"), passing(e["m"], kind).alias("ok")
        ),
    )
    return F.when(F.size(found) > 0, each).otherwise(F.expr("array()").cast("array<struct<kind:int,at:int,gap:int,size:int,ok:boolean>>"))


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, events: the lengths of all matches of a text, without the text."""
    # a matched array is used four times: in a select of its own it is found once
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("*", *[matches(F.col("text"), kind).alias(f"m{k}") for k, kind in enumerate(KINDS)])
    sized = found.select("doc_id", "text", *[lengths(F.col("text"), F.col(f"m{k}"), k, kind).alias(f"e{k}") for k, kind in enumerate(KINDS)])
    weak = F.lit(False)
    for k in range(len(STRONG), len(KINDS)):
        weak = weak | F.exists(f"e{k}", lambda e: e["ok"])
    # scopes matter only where something weak stands
    sized = sized.select("doc_id", "text", F.concat(*[F.col(f"e{k}") for k in range(len(KINDS))]).alias("events"), weak.alias("weak"))
    blanks = F.when(F.col("weak"), matches(F.col("text"), BLANK)).otherwise(F.expr("array()").cast("array<string>"))
    sized = sized.select("doc_id", "text", "events", "weak", blanks.alias("m"))
    both = F.concat("events", lengths(F.col("text"), F.col("m"), len(KINDS), BLANK))
    return cut_lineage(sized.select("doc_id", both.alias("events"), "weak")).withColumn("row", F.monotonically_increasing_id())


def placed(texts: DataFrame) -> DataFrame:
    """row, weak, kind, start, end: every span that counts, blank lines with the number after the last kind."""
    each = texts.where(F.size("events") > 0).select("row", "weak", F.explode("events").alias("e")).select("row", "weak", "e.*")
    sofar = Window.partitionBy("row", "kind").orderBy("at")
    ends = F.sum(F.col("gap").cast("long") + F.col("size")).over(sofar)
    return each.select("row", "weak", "kind", ends.alias("end"), "size", "ok").where("ok").select("row", "weak", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def parts(spans: DataFrame) -> DataFrame:
    """row, scope, kind, start, end of the texts with weak parts; those that touch a strong span are left out."""
    inside = Window.partitionBy("row").orderBy("start", "kind")
    blank, strong = F.col("kind") == len(KINDS), F.col("kind") < len(STRONG)
    before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    touched = (F.max(F.when(strong, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"))
    known = spans.where("weak").select(
        "row", F.count_if(blank).over(before).alias("scope"), "kind", "start", "end", F.coalesce(touched, F.lit(False)).alias("touched")
    )
    return known.where(~blank & (strong | ~F.col("touched"))).drop("touched")


def of_kinds(spans: DataFrame, names: tuple[str, ...], prefix: str) -> DataFrame:
    some = spans.where(F.col("kind").isin(numbers(*names)))
    return some.select("row", "scope", F.col("kind").alias(f"{prefix}_kind"), F.col("start").alias(f"{prefix}_start"), F.col("end").alias(f"{prefix}_end"))


def near(secrets: DataFrame, others: DataFrame, prefix: str, reach: int) -> DataFrame:
    """Secrets with what starts within reach of them in their scope: an interval join over cells."""
    lowest, highest = F.col("secret_start") - reach, F.col("secret_end") + reach
    cells = F.sequence(F.floor(lowest / reach), F.floor(highest / reach))
    reached = secrets.select("*", F.explode(cells).alias("cell"))
    homes = others.withColumn("cell", F.floor(F.col(f"{prefix}_start") / reach))
    return reached.join(homes, ["row", "scope", "cell"]).where(F.col(f"{prefix}_start").between(lowest, highest)).drop("cell")


def links(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """row, scope, secret_*, account_*: every pair of a secret and an account name, one of them weak, in reach of each other."""
    pairs = near(of_kinds(spans, SECRETS, "secret"), of_kinds(spans, ACCOUNTS, "account"), "account", reach)
    apart = (F.col("account_end") <= F.col("secret_start")) | (F.col("secret_end") <= F.col("account_start"))
    return pairs.where(apart)


def reported(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """row, kind, start, end of the weak parts whose complements co-occur."""
    pairs = cut_lineage(links(spans, reach))
    paired = pairs.select("row", "scope", "secret_kind", "secret_start", "secret_end").distinct()
    ends = near(paired, of_kinds(spans, ENDPOINTS, "endpoint"), "endpoint", reach)
    found = [
        rows.select("row", F.col(f"{side}_kind").alias("kind"), F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"))
        for rows, side in ((paired, "secret"), (pairs, "account"), (ends, "endpoint"))
    ]
    return found[0].union(found[1]).union(found[2]).where(F.col("kind") >= len(STRONG)).distinct()


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def counted(kind: int):
    return lambda n, s: n + F.when(s["kind"] == kind, 1).otherwise(0)


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: how many strong spans of each kind, their digest, and all spans reported."""
    texts = scanned(docs)
    spans = cut_lineage(placed(texts))
    strong = spans.where(F.col("kind") < len(STRONG)).select("row", "kind", "start", "end")
    every = strong.union(reported(cut_lineage(parts(spans)), reach))
    listed = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = texts.select("row", "doc_id").join(listed, "row", "left")
    out = out.select("doc_id", F.coalesce("spans", F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(STRONG))
    counts = [F.aggregate("all", F.lit(0).cast("long"), counted(k)).alias(f"n_{kind.name}") for k, kind in enumerate(STRONG)]
    return out.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))


def oracle(reach: int = REACH) -> str:
    """The same rows from DuckDB; weak parts are compared with all other parts of their text."""
    def events(k: int, kind: Kind) -> str:
        p = "'" + kind.pattern.replace("'", "''") + "'"
        value = f"regexp_extract(m, {p}, {kind.group})"
        tests = " AND ".join([f"length({value}) >= {kind.least}", *[f"regexp_matches(m, '{h}')" for h in kind.holds]])
        return f"""SELECT rid, {k} AS kind, pos, length(g) AS gap, length(m) AS size, {tests} AS ok FROM (
            SELECT rid, unnest(ms) AS m, unnest(string_split_regex(text, {p})[1 : len(ms)]) AS g, unnest(range(len(ms))) AS pos
            FROM (SELECT rid, text, regexp_extract_all(text, {p}, 0) AS ms FROM d) WHERE len(ms) > 0)"""

    def of(names: tuple[str, ...]) -> str:
        return ", ".join(map(str, numbers(*names)))

    union = " UNION ALL ".join(events(k, kind) for k, kind in enumerate((*KINDS, BLANK)))
    n, strong = len(KINDS), len(STRONG)
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    written_ = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    within = f"BETWEEN s.start - {reach} AND s.stop + {reach}"
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = {k}), 0) AS n_{kind.name}" for k, kind in enumerate(STRONG))
    zeros = ", ".join(f"coalesce(n_{kind.name}, 0) AS n_{kind.name}" for kind in STRONG)
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        e AS MATERIALIZED ({union}),
        s AS MATERIALIZED (SELECT rid, kind, stop - size AS start, stop FROM (
            SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY pos) AS stop FROM e) WHERE ok),
        w AS MATERIALIZED (SELECT s.*, (SELECT count(*) FROM s b WHERE b.rid = s.rid AND b.kind = {n} AND b.start <= s.start) AS scope
              FROM s WHERE kind < {strong} OR (kind < {n} AND NOT EXISTS (
                  SELECT 1 FROM s b WHERE b.rid = s.rid AND b.kind < {strong} AND b.start < s.stop AND s.start < b.stop))),
        pairs AS MATERIALIZED (SELECT s.rid, s.scope, s.kind, s.start, s.stop, a.kind AS a_kind, a.start AS a_start, a.stop AS a_stop
              FROM w s JOIN w a USING (rid, scope)
              WHERE s.kind IN ({of(SECRETS)}) AND a.kind IN ({of(ACCOUNTS)}) AND a.start {within}
                AND (a.stop <= s.start OR s.stop <= a.start)),
        r AS (SELECT rid, kind, start, stop FROM pairs
              UNION SELECT rid, a_kind, a_start, a_stop FROM pairs
              UNION SELECT s.rid, t.kind, t.start, t.stop FROM pairs s JOIN w t USING (rid, scope)
              WHERE t.kind IN ({of(ENDPOINTS)}) AND t.start {within}),
        x AS (SELECT rid, kind, start, stop FROM s WHERE kind < {strong} UNION ALL SELECT * FROM r WHERE kind >= {strong}),
        g AS (SELECT rid, {counts}, {written_} FILTER (WHERE kind < {strong}) AS base, {written_} AS spans FROM x GROUP BY rid)
        SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)"""
