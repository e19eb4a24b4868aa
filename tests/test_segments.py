"""Segmented hash chains: one busy entity spreads, and tampering is found."""

import hashlib

from pyspark.sql import functions as F

from wakeline.operators import integrity

DAY = 86400
SCHEMA = "id long, entity_type string, entity_id string, occurred_s long, payload_json string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def events(spark):
    """One entity with most events over ten days (none on the fourth), two with few."""
    rows = [(i, "v", "busy", (i % 10) * DAY + i, f"p{i}") for i in range(400) if i % 10 != 3]
    rows += [(1000 + i, "v", "b", i * DAY // 2, f"q{i}") for i in range(6)] + [(2000, "w", "b", 5, "r")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_segments_against_plain_hashing(spark):
    frame, rows = events(spark)
    want, roots = {}, {}
    for i, kind, entity, s, text in sorted(rows, key=lambda r: (r[3], r[0])):
        key = (kind, entity, s // DAY)
        previous, n = roots.get(key, (None, 0))
        roots[key] = (sha(previous or "", text), n + 1)
        want[i] = (previous, roots[key][0])
    chained = integrity.segmented_chain(frame)
    assert {r.id: (r.hash_chain_previous, r.event_hash) for r in chained.collect()} == want
    links, last = {}, {}
    for kind, entity, segment in sorted(roots):
        root, n = roots[kind, entity, segment]
        before = last.get((kind, entity))
        last[kind, entity] = sha(before or "", f"{segment}:{n}:{root}")
        links[kind, entity, segment] = (n, root, before, last[kind, entity])
    got = integrity.segment_links(chained).collect()
    assert {(r.entity_type, r.entity_id, r.segment): (r.n_events, r.root, r.previous_link, r.link) for r in got} == links


def test_a_busy_entity_spreads(spark):
    spread = integrity.segmented_chain(events(spark)[0]).filter("entity_id = 'busy'").groupBy("segment").count().collect()
    assert len(spread) == 9 and max(r["count"] for r in spread) == 40


def test_tampering_is_found(spark):
    chained = integrity.segmented_chain(events(spark)[0])
    links = integrity.segment_links(chained)

    def problems(c, k):
        return sorted(((r.entity_id, r.segment, r.id, r.problem) for r in integrity.verify_segments(c, k).collect()), key=repr)

    assert problems(chained, links) == []
    changed = F.when(F.col("id") == 15, F.lit("x")).otherwise(F.col("payload_json"))
    assert problems(chained.withColumn("payload_json", changed), links) == [("busy", 5, 15, "bad_hash")]
    gone = chained.filter("not (entity_id = 'busy' and segment = 4)")
    assert problems(gone, links) == [("busy", 4, None, "missing_segment")]
    without = links.filter("not (entity_id = 'busy' and segment = 4)")
    assert problems(gone, without) == [("busy", 5, None, "broken_segment_link")]
    assert sorted(p for *_, p in problems(chained, without)) == ["broken_segment_link", "unlinked_segment"]
    cut = chained.filter("id <> 391")  # the last event of a segment leaves no gap behind it
    assert problems(cut, links) == [("busy", 1, None, "bad_root")]
    inner = chained.filter("id <> 201")
    assert problems(inner, links) == [("busy", 1, 211, "broken_link"), ("busy", 1, None, "bad_root")]
    forged = links.withColumn("root", F.when(F.col("segment") == 2, F.lit("0")).otherwise(F.col("root")))
    assert {p for *_, p in problems(chained, forged)} == {"bad_root", "bad_link"}
    empty = chained.limit(0)
    assert integrity.verify_segments(empty, integrity.segment_links(empty)).count() == 0
