"""Constraint checks, audit chains, dossiers and run summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.sequences import neighbours

# The rules of each table as (rule name, SQL condition that must hold).
RULES: dict[str, list[tuple[str, str]]] = {
    "tracks": [
        ("speed_range", "speed_knots BETWEEN 0 AND 100"),
        ("course_range", "course_degrees BETWEEN 0 AND 360"),
        ("heading_range", "heading_degrees BETWEEN 0 AND 360"),
    ],
    "vessels": [
        ("mmsi_format", "mmsi RLIKE '^[0-9]{9}$'"),
        ("imo_format", "imo RLIKE '^[0-9]{7}$'"),
        ("dwt_positive", "deadweight_tonnage > 0"),
    ],
    "ais_gaps": [("gap_order", "gap_end > gap_start"), ("duration_positive", "gap_duration_min > 0")],
    "attribution_scores": [
        *[(f"{c}_range", f"{c} BETWEEN 0 AND 1") for c in ("cpa_score", "dark_vessel_score", "loitering_score", "capacity_multiplier", "draft_change_score", "permutation_p_value", "stability_index")],
        ("total_range", "total_score BETWEEN 0 AND 100"),
    ],
    "target_correlations": [
        ("dark_has_no_vessel", "match_status <> 'dark_vessel' OR vessel_id IS NULL"),
        ("matched_has_vessel", "match_status <> 'matched' OR vessel_id IS NOT NULL"),
    ],
    "scenes": [
        ("cloud_range", "cloud_cover_percentage BETWEEN 0 AND 100"),
        ("wind_direction_range", "wind_direction BETWEEN 0 AND 360"),
        ("hash_format", "sha256 RLIKE '^[0-9a-f]{64}$'"),
    ],
    "spills": [("area_positive", "area_sq_km > 0")],
}


TEXT = re.compile("'[^']*'")
COLUMN = re.compile("[a-z_]+[a-z_0-9]*")
SQL_WORDS = frozenset("and between in is like not null or rlike length".split())


def violations(df: DataFrame, table: str, key: str, rules: list[str] | None = None) -> DataFrame:
    """One row per broken rule; a null operand satisfies a rule, as in SQL CHECK.

    All rules of the table are checked, or those named in ``rules``; a rule whose column is absent raises.
    """
    known = dict(RULES[table])
    wanted = list(known) if rules is None else rules
    have = {c.lower() for c in df.columns}
    for name in wanted:
        missing = {w for w in COLUMN.findall(TEXT.sub("", known[name]).lower()) if w not in SQL_WORDS} - have
        if missing:
            raise ValueError(f"rule {name} of {table} needs {', '.join(sorted(missing))}")
    broken = [F.when(~F.expr(known[name]), F.lit(name)) for name in wanted]
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def violation_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def canonical_payload(fields: list[str]) -> Column:
    """JSON object with sorted keys; absent values are written as null."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


_CHAIN_SCHEMA = "id bigint, entity_type string, entity_id string, occurred_s bigint, payload_json string, hash_chain_previous string, event_hash string"


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    last, previous = None, None
    for pdf in batches:
        prevs, hashes = [], []
        for key, text in zip(zip(pdf["entity_type"], pdf["entity_id"]), pdf["payload_json"]):
            if key != last:
                last, previous = key, None
            prevs.append(previous)
            previous = hashlib.sha256(((previous or "") + text).encode()).hexdigest()
            hashes.append(previous)
        yield pdf.assign(hash_chain_previous=prevs, event_hash=hashes)


def hash_chain(events: DataFrame) -> DataFrame:
    """event_hash = sha256(previous hash, payload) along each entity's events in time order.

    ``events``: id, entity_type, entity_id, occurred_s, payload_json. A chain is
    sequential by definition; it is streamed through its sorted partition batch by
    batch, so no chain is ever held in memory.
    """
    cols = ["id", "entity_type", "entity_id", "occurred_s", "payload_json"]
    return (
        events.select(*cols).repartition("entity_type", "entity_id")
        .sortWithinPartitions("entity_type", "entity_id", "occurred_s", "id")
        .mapInPandas(_chain, _CHAIN_SCHEMA)
    )


def verify_chain(chained: DataFrame) -> DataFrame:
    """Broken links: wrong predecessor or wrong hash. Fully parallel, no sequential pass.

    Events of one entity are ordered by (occurred_s, id).
    """
    keyed = chained.withColumn("_pos", F.struct("occurred_s", "id"))
    day = F.floor(F.col("occurred_s") / 86400).cast("long")
    t = neighbours(keyed, ["entity_type", "entity_id"], "_pos", ["event_hash"], bucket=day)
    expected = F.sha2(F.concat(F.coalesce("hash_chain_previous", F.lit("")), "payload_json"), 256)
    bad_link = ~F.col("hash_chain_previous").eqNullSafe(F.col("prev.event_hash"))
    bad_hash = F.col("event_hash") != expected
    return t.filter(bad_link | bad_hash).select(
        "id", "entity_type", "entity_id", F.when(bad_link, "broken_link").otherwise("bad_hash").alias("problem")
    )


#: Seconds of a segment of a segmented chain.
SEGMENT_S = 86400
_ENTITY = ["entity_type", "entity_id"]
_SEGMENT = [*_ENTITY, "segment"]


def _hashed_along(rows: DataFrame, keys: list[str], order: list[str], text: str, previous: str, out: str) -> DataFrame:
    """``out`` = sha256(``out`` of the row before, ``text``) along the rows of each key, streamed through sorted partitions."""
    from pyspark.sql.types import StringType, StructType

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        last, before = None, None
        for pdf in batches:
            befores, hashes = [], []
            for key, value in zip(zip(*(pdf[k] for k in keys)), pdf[text]):
                if key != last:
                    last, before = key, None
                befores.append(before)
                before = hashlib.sha256(((before or "") + value).encode()).hexdigest()
                hashes.append(before)
            yield pdf.assign(**{previous: befores, out: hashes})

    schema = StructType(rows.schema.fields.copy()).add(previous, StringType()).add(out, StringType())
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(chain, schema)


def segmented_chain(events: DataFrame, segment_s: int = SEGMENT_S) -> DataFrame:
    """Events chained within (entity, stretch of time), so that one busy entity spreads over its stretches.

    Columns as in ``hash_chain`` and ``segment``, the number of the stretch. The first event of a segment has no
    predecessor; ``segment_links`` ties the segments of an entity together. Entity and payload must not be null.
    """
    cols = ["id", *_ENTITY, "occurred_s", "payload_json"]
    rows = events.select(*cols, F.floor(F.col("occurred_s") / segment_s).cast("long").alias("segment"))
    return _hashed_along(rows, _SEGMENT, ["occurred_s", "id"], "payload_json", "hash_chain_previous", "event_hash")


def _roots(chained: DataFrame) -> DataFrame:
    """Number of events and last hash of every segment."""
    last = F.max(F.struct("occurred_s", "id", "event_hash"))["event_hash"]
    return chained.groupBy(*_SEGMENT).agg(F.count(F.lit(1)).alias("n_events"), last.alias("root"))


def _link_text() -> Column:
    return F.concat_ws(":", F.col("segment").cast("string"), F.col("n_events").cast("string"), "root")


def segment_links(chained: DataFrame) -> DataFrame:
    """One row per segment: events, last hash, and ``link`` = sha256(link before, segment:events:last hash).

    The only sequential pass: an entity has one row per stretch of time in which it had events, however many those are.
    """
    rows = _roots(chained).withColumn("_text", _link_text())
    return _hashed_along(rows, _ENTITY, ["segment"], "_text", "previous_link", "link").drop("_text")


def verify_segments(chained: DataFrame, links: DataFrame) -> DataFrame:
    """What is wrong with a segmented chain: (entity, segment, id, problem), id only for single events.

    Events: ``broken_link`` (wrong predecessor) and ``bad_hash``. Segments: ``missing_segment`` (linked, but without
    events), ``unlinked_segment`` (events without a link), ``bad_root`` (other events or last hash than linked),
    ``broken_segment_link`` (the link before is another: a segment's link was removed or added), ``bad_link``. Every
    event and every link is looked at on its own. Removing an entity's last segment together with its link is not seen
    here: keep the newest link elsewhere.
    """
    keyed = chained.withColumn("_pos", F.struct("occurred_s", "id"))
    day = F.floor(F.col("occurred_s") / 86400).cast("long")
    t = neighbours(keyed, _SEGMENT, "_pos", ["event_hash"], bucket=day)
    wrong = ~F.col("hash_chain_previous").eqNullSafe(F.col("prev.event_hash"))
    forged = ~F.col("event_hash").eqNullSafe(F.sha2(F.concat(F.coalesce("hash_chain_previous", F.lit("")), "payload_json"), 256))
    events = t.filter(wrong | forged).select(*_SEGMENT, "id", F.when(wrong, "broken_link").otherwise("bad_hash").alias("problem"))

    before = F.lag("link").over(Window.partitionBy(*_ENTITY).orderBy("segment"))
    expected = F.sha2(F.concat(F.coalesce("previous_link", F.lit("")), _link_text()), 256)
    own = links.withColumn("_before", before).withColumn("_expected", expected).withColumn("_linked", F.lit(True))
    found = _roots(chained).select(*_SEGMENT, F.col("n_events").alias("_n"), F.col("root").alias("_root"))
    both = own.join(found, _SEGMENT, "full_outer")
    problems = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), "missing_segment"),
            F.when(F.col("_linked").isNull(), "unlinked_segment"),
            F.when((F.col("_n") != F.col("n_events")) | (F.col("_root") != F.col("root")), "bad_root"),
            F.when(F.col("_linked") & ~F.col("previous_link").eqNullSafe(F.col("_before")), "broken_segment_link"),
            F.when(F.col("_linked") & ~F.col("link").eqNullSafe(F.col("_expected")), "bad_link"),
        )
    )
    segments = both.select(*_SEGMENT, F.lit(None).cast("long").alias("id"), F.explode(problems).alias("problem"))
    return events.unionByName(segments)


def audit_history(log: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    return log.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).orderBy(F.desc("occurred_s"), F.desc("id"))


def finalise_dossiers(dossiers: DataFrame) -> DataFrame:
    """Drafts become final and get the hash of their snapshot; final rows stay as they are."""
    draft = F.col("status") == "draft"
    return dossiers.withColumns(
        {"sha256": F.when(draft, F.sha2("snapshot", 256)), "status": F.when(draft, "finalized").otherwise(F.col("status"))}
    )


def changed_finals(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Finalized rows that were altered or removed, which must never happen."""
    b = before.filter("status = 'finalized'").select(key, F.sha2(F.to_json(F.struct(*cols)), 256).alias("_b"))
    a = after.select(key, F.sha2(F.to_json(F.struct(*cols)), 256).alias("_a"))
    return b.join(a, key, "left").filter(~F.col("_b").eqNullSafe(F.col("_a"))).select(
        key, F.when(F.col("_a").isNull(), "deleted").otherwise("updated").alias("mutation")
    )


def run_summary(scenes: DataFrame, nearest: DataFrame, fleet: DataFrame, gaps: DataFrame) -> DataFrame:
    """Totals per scene: targets, vessels, matched, dark, tracks of two points or more, gaps."""
    t = nearest.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("dark")
    )
    v = fleet.groupBy("scene_id").agg(F.count(F.lit(1)).alias("vessels"), F.count_if(F.col("n_points") >= 2).alias("tracks"))
    g = gaps.groupBy("scene_id").agg(F.count(F.lit(1)).alias("gaps"))
    out = scenes.select("scene_id").join(t, "scene_id", "left").join(v, "scene_id", "left").join(g, "scene_id", "left")
    return out.na.fill(0, ["targets", "vessels", "matched", "dark", "tracks", "gaps"])


def tagged_counts(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Rows of each table whose ``source`` carries the tag."""
    parts = [
        d.filter(F.col("source") == tag).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, d in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge(df: DataFrame, tag: str) -> DataFrame:
    """The table without the tagged rows; write it to a new place, then swap."""
    return df.filter(~F.col("source").eqNullSafe(F.lit(tag)))
