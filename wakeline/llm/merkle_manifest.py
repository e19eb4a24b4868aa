"""Merkle dataset manifest: a tree of hashes whose parents keep the state before each child.

Method. A leaf is the hash of a row's fields. Leaves of one source ascend by id; every three consecutive nodes become
their hash until one, the subroot, is left; the subroots, ordered by source, give the root in the same way. While a
parent is hashed, a copy of the running state is kept before every child slot (SHA-256 takes in one child's 64 digits
as one whole block, so a state stands between two blocks). To fold a replaced leaf, the state of its slot is copied and
resumed with the replacement and the siblings to its right only; what stands to the left is never hashed again. A proof
is the hash of the siblings of all levels, left to right.

Scale. The text is read once, natively, and leaves as its digest. Places are found by ranges: rows are dealt out by
(source, id) ranges, each range counts its rows, and the counts give every row its number, so a source with a third of
all rows is many ranges. Seven levels (up to 2,187 consecutive nodes) are one group, folded in one task; a tree of
10^12 leaves takes four such tiers. States are objects of the hash library and stay in their task: a group's own parents
keep theirs, and for the few parents above a group (at most seven a tier) the state before the slot is made once a
group. Between tasks travel digests, and one path of siblings per group.

Defined cases: a null field is ``-``; null ids come first within a source and are never tampered with; a null source is
a source of its own, ordered first; rows repeated under one id are ordered by their leaf, equal rows stand side by side;
an empty text is ``0:``; a single row is leaf, subroot and root at once and its proof is the hash of nothing; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import id_remainder, shuffle_partitions
from wakeline.session import cut_lineage

FAN = 3
#: Levels that one group folds.
TIER = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


class Subtree:
    """The levels above some consecutive nodes; every parent keeps its states."""

    def __init__(self, nodes: list[bytes], height: int | None) -> None:
        """``height`` levels, a lone node being hashed too; None: up to the one node that is left."""
        self.levels, self.states = [nodes], []
        while len(self.levels[-1]) > 1 if height is None else len(self.states) < height:
            row, parents, kept = self.levels[-1], [], []
            for at in range(0, len(row), FAN):
                running, before = sha256(), []
                for child in row[at : at + FAN]:
                    before.append(running.copy())
                    running.update(child)
                kept.append(before)
                parents.append(running.hexdigest().encode())
            self.levels.append(parents)
            self.states.append(kept)

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def path(self, place: int) -> list[tuple[bytes, bytes]]:
        """Level by level what stands left and right of the node at ``place`` in its run."""
        out = []
        for row in self.levels[:-1]:
            first = place - place % FAN
            out.append((b"".join(row[first:place]), b"".join(row[place + 1 : first + FAN])))
            place //= FAN
        return out

    def fold(self, place: int, node: bytes) -> bytes:
        """The top with ``node`` at ``place``."""
        for row, kept in zip(self.levels, self.states):
            run, slot = divmod(place, FAN)
            resumed = kept[run][slot].copy()
            resumed.update(node + b"".join(row[place + 1 : run * FAN + FAN]))
            node, place = resumed.hexdigest().encode(), run
        return node


class Ancestors:
    """The parents above a subtree, as one state before the slot and the right siblings per level."""

    def __init__(self, path: list[tuple[bytes, bytes]]) -> None:
        self.steps = [(sha256(left), right) for left, right in path]
        self.known: dict[bytes, bytes] = {}

    def fold(self, node: bytes) -> bytes:
        start = node
        if start not in self.known:
            for before, right in self.steps:
                resumed = before.copy()
                resumed.update(node + right)
                node = resumed.hexdigest().encode()
            self.known[start] = node
        return self.known[start]


def leaves(docs: DataFrame, fields: tuple[str, ...], doc_id: str, group: str, text: str) -> DataFrame:
    """doc_id, tree, leaf, tampered: one row each; ``tampered`` is null where tampering changes nothing."""
    even = F.coalesce(id_remainder(F.col(doc_id), 2) == 0, F.lit(False))
    whole = [F.col(f) for f in fields]
    cut = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text else F.col(f) for f in fields]
    changed = F.when(even & F.contains(F.col(text), F.lit("\n")), leaf_hash(cut))
    # the empty name is the null source's, so that it comes first
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), tree.alias("tree"), leaf_hash(whole).alias("leaf"), changed.alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place within ``group`` by ``order`` from 0, and ``n``, the group's rows. No group is one task."""
    parts = shuffle_partitions(rows.sparkSession)
    keys = [group, *order]
    ranged = cut_lineage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    # the checkpoint keeps partitions and their order, so both numbers are the same whenever they are read
    placed = ranged.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    ranges = placed.groupBy(group, "range").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(group)
    shift = F.sum("here").over(whole.orderBy("range")) - F.col("here") - F.col("first")
    shifts = ranges.select(group, "range", shift.alias("shift"), F.sum("here").over(whole).alias("n"))
    return placed.join(shifts, [group, "range"]).withColumn("idx", F.col("place") + F.col("shift")).drop("range", "place", "shift")


def digests(column: pd.Series) -> list[bytes]:
    return [x.encode() for x in column]


def subtree(nodes: pd.DataFrame, tier: int) -> Subtree:
    return Subtree(digests(nodes["node"]), None if nodes["n"].iloc[0] <= FAN**tier else tier)


def parents(nodes: pd.DataFrame, tier: int) -> pd.DataFrame:
    nodes, size = nodes.sort_values("idx"), FAN**tier
    first = nodes.iloc[0]
    return pd.DataFrame([(first["tree"], first["idx"] // size, subtree(nodes, tier).top.decode(), -(-first["n"] // size))], columns=["tree", "idx", "node", "n"])


def block(tier: int) -> Column:
    return F.expr(f"idx div {FAN**tier}").alias("block")


def tiers(nodes: DataFrame, tier: int) -> list[DataFrame]:
    """tree, idx, node, n of every tier, from the given one up to the one with one row per tree."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while len(out) == 1 or most > 1:
        up = out[-1].select("tree", "idx", "node", "n", block(tier)).groupBy("tree", "block")
        out.append(cut_lineage(up.applyInPandas(lambda nodes: parents(nodes, tier), "tree string, idx long, node string, n long")))
        most = -(-most // FAN**tier)
    return out


def below(nodes: pd.DataFrame, above: pd.DataFrame, tier: int) -> pd.DataFrame:
    """The path of every node of a group: its own within the group, then the group's."""
    nodes, up = nodes.sort_values("idx"), above.iloc[0]
    grown, upper = subtree(nodes, tier), [(s["left"], s["right"]) for s in up["path"]]
    paths = [[{"left": a.decode(), "right": b.decode()} for a, b in grown.path(i)] + [{"left": a, "right": b} for a, b in upper] for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "idx": nodes["idx"], "path": paths, "subroot": up["subroot"], "root": up["root"]})


def proven(nodes: pd.DataFrame, above: pd.DataFrame, tier: int) -> pd.DataFrame:
    """The result rows of one group of leaves."""
    nodes, up = nodes.sort_values("idx"), above.iloc[0]
    grown, upper = subtree(nodes, tier), [(s["left"].encode(), s["right"].encode()) for s in up["path"]]
    ancestors, rest = Ancestors(upper), b"".join(a + b for a, b in upper)
    proofs, folded = [], []
    for i, node in enumerate(digests(nodes["tampered"].where(nodes["tampered"].notna(), nodes["node"]))):
        proofs.append(sha256(b"".join(a + b for a, b in grown.path(i)) + rest).hexdigest())
        folded.append(ancestors.fold(grown.fold(i, node)).decode())
    out = nodes[["doc_id", "node"]].rename(columns={"node": "leaf"})
    return out.assign(subroot=up["subroot"], root=up["root"], proof_sha256=proofs, folded_root=folded, verified=[f == up["root"] for f in folded])


def paths(levels: list[DataFrame], top: DataFrame, tier: int) -> DataFrame:
    """From ``top`` (tree, path, subroot, root of each tree's last node) down to the groups of the lowest tier."""
    known = top.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    kind = f"tree string, idx long, path {PATH}, subroot string, root string"
    for level in reversed(levels[1:-1]):
        own = level.select("tree", "idx", "node", "n", block(tier)).groupBy("tree", "block")
        down = own.cogroup(known.groupBy("tree", "block")).applyInPandas(lambda a, b: below(a, b, tier), kind)
        known = cut_lineage(down.withColumnRenamed("idx", "block"))
    return known


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", group: str = "source", text: str = "text", tier: int = TIER) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``."""
    read = cut_lineage(leaves(docs, fields, doc_id, group, text))
    # equal rows may stand in any order; their number only spreads them over ranges
    placed = numbered(read.withColumn("equal", F.monotonically_increasing_id()), "tree", ["doc_id", "leaf", "equal"])
    base = cut_lineage(placed.select("tree", "idx", "n", "doc_id", F.col("leaf").alias("node"), "tampered"))
    sources = tiers(base, tier)
    subroots = sources[-1].select(F.col("tree").alias("name"), "node", F.lit("").alias("tree"))
    ordered = cut_lineage(numbered(subroots, "tree", ["name"]))
    roots = tiers(ordered, tier)
    # the root tier's own top has nothing above it
    last = roots[-1].select("tree", F.expr("array()").cast(PATH).alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    upper = paths(roots, last, tier)
    names = ordered.select("tree", "idx", "node", "n", block(tier)).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    climbed = names.applyInPandas(lambda a, b: below(a, b, tier), f"tree string, idx long, path {PATH}, subroot string, root string").select("idx", "path", "root")
    top = ordered.select("idx", F.col("name"), F.col("node").alias("subroot")).join(climbed, "idx")
    lowest = paths(sources, cut_lineage(top.select(F.col("name").alias("tree"), "path", "subroot", "root")), tier)
    own = base.select("tree", "idx", "n", "doc_id", "node", "tampered", block(tier)).groupBy("tree", "block")
    id_type = base.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return own.cogroup(lowest.groupBy("tree", "block")).applyInPandas(lambda a, b: proven(a, b, tier), kind)


def oracle() -> str:
    """The same rows from DuckDB, level by level; crc32 by the table of its polynomial."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))"

    def grown(name: str, start: str) -> str:
        return f"""{name}(tree, lvl, idx, h) AS (
            {start} UNION ALL
            SELECT tree, lvl + 1, idx // {FAN}, sha256(string_agg(h, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {name}) WHERE m > 1 GROUP BY tree, lvl, idx // {FAN})"""

    def sides(name: str) -> str:
        return f"""s{name} AS MATERIALIZED (SELECT a.tree, a.lvl, a.idx,
            coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
            coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
            FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // {FAN} = b.idx // {FAN}
            JOIN (SELECT tree, max(lvl) AS top FROM {name} GROUP BY tree) t ON t.tree = a.tree AND a.lvl < t.top
            GROUP BY a.tree, a.lvl, a.idx)"""

    def climbed(name: str, start: str, nodes: str) -> str:
        return f"""{name}(rid, tree, lvl, idx, proof, folded) AS (
            {start} UNION ALL
            SELECT rid, c.tree, c.lvl + 1, c.idx // {FAN}, proof || l || r, sha256(l || folded || r)
            FROM {name} c JOIN s{nodes} USING (tree, lvl, idx))"""

    parts = " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in FIELDS)
    cut = parts.replace("CAST(text AS VARCHAR)", "replace(text, chr(10), '')")
    return f"""
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree,
                     sha256({parts}) AS leaf, sha256({cut}) AS cut, CAST(doc_id AS VARCHAR) AS s FROM documents),
        e AS MATERIALIZED (SELECT rid, doc_id, tree, leaf,
                     CASE WHEN coalesce(xor({crc}, 4294967295) % 2 = 0, false) THEN cut ELSE leaf END AS bad,
                     row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d, tab),
        {grown("a", "SELECT tree, 0, idx, leaf FROM e")}, {sides("a")},
        sub AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx
                FROM a WHERE (tree, lvl) IN (SELECT (tree, max(lvl)) FROM a GROUP BY tree)),
        {grown("b", "SELECT '', 0, idx, subroot FROM sub")}, {sides("b")},
        {climbed("x", "SELECT rid, tree, 0, idx, '', bad FROM e", "a")},
        y AS MATERIALIZED (SELECT x.rid, s.idx, s.subroot, x.proof, x.folded FROM x JOIN sub s USING (tree)
              WHERE (x.rid, x.lvl) IN (SELECT (rid, max(lvl)) FROM x GROUP BY rid)),
        {climbed("z", "SELECT rid, '', 0, idx, proof, folded FROM y", "b")},
        w AS (SELECT rid, arg_max(proof, lvl) AS proof, arg_max(folded, lvl) AS folded FROM z GROUP BY rid),
        root AS (SELECT arg_max(h, lvl) AS root FROM b)
        SELECT doc_id, leaf, subroot, root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = root AS verified
        FROM e JOIN y USING (rid) JOIN w USING (rid), root"""
