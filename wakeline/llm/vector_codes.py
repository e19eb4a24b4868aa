"""Vector code compression: product codes found by the equal-average search.

Method. Components become integers ``floor(4096 * x)`` and vectors are cut into consecutive parts, each with a codebook
of its own. The entries of a codebook are sorted by their component sum. For a part the search starts at its own sum
and expands outward to the nearer sum on either side; an entry whose squared sum gap over the dimension strictly
exceeds the best distance so far ends the search, since by Cauchy and Schwarz no entry farther out can be nearer. All
numbers are integers, so a cut never loses an entry and ties go to the lower index exactly. Six rounds move each entry
to the floor of the mean of its parts; entries without parts stay.

Scale. The integers are written once to the shared folder. A round is one pass over them: a task returns one row of
sums per (part, entry), Spark adds those up, and ``entries * dimension`` integers come to the driver, whatever the
number of vectors. Labels are summed before they are joined back, so a label with a third of all rows is one row per
task there; the join is an ordinary one, whose hot key adaptive execution splits.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. The dimension is that of
the first remaining row by (id, vector), nulls last; part p of d components takes those from ``p * d // parts`` up to
``(p + 1) * d // parts`` (a part may be empty: entry 0, distance 0). Rows of another length, and rows with a component
of ``REACH / d`` or more after scaling (|x| of 2,048 for d = 64; squared distances would leave a long), get a null code
and a null error and train nothing. Rows repeated under one id count as rows, ordered by their vectors;
rows of null id come last. Fewer rows than entries give smaller codebooks; an empty table gives an empty result. An
error sum beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer component times dimension: sums, gaps and distances of such vectors stay exact in a long.
REACH = 2**29


def cuts(dim: int, parts: int = PARTS) -> list[slice]:
    return [slice(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def equal_average(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest row of ``book`` (ties to the lower) and its squared distance."""
    n, dim = x.shape
    if not dim:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, far = sums[order], np.int64(2**31)
    best, index = np.full(n, 2**62, np.int64), np.full(n, len(book), np.int64)
    rows, own = np.arange(n), x.sum(axis=1)
    up = np.searchsorted(sums, own)
    down = up - 1
    while len(rows):
        below = np.where(down >= 0, own - sums[np.maximum(down, 0)], far)
        above = np.where(up < len(sums), sums[np.minimum(up, len(sums) - 1)] - own, far)
        gap = np.minimum(below, above)
        open_ = gap < far
        # until something is found the best distance is no bound yet
        open_[open_] &= (index[rows[open_]] == len(book)) | (gap[open_] ** 2 <= best[rows[open_]] * dim)
        rows, own, up, down, below, above = (a[open_] for a in (rows, own, up, down, below, above))
        low = below <= above
        at = order[np.where(low, down, up)]
        apart = ((x[rows] - book[at]) ** 2).sum(axis=1)
        better = (apart < best[rows]) | ((apart == best[rows]) & (at < index[rows]))
        best[rows[better]], index[rows[better]] = apart[better], at[better]
        down, up = down - low, up + ~low
    return index, best


def kept_rows(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, x: every vector that is not dropped, scaled, its components still doubles."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    scaled = F.transform("v", lambda x: x * F.lit(float(scale)))
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", "label", scaled.alias("x"))


def whole(x: Column, dim: int) -> Column:
    """The integer vector, or null where it does not fit."""
    limit = float(REACH // max(dim, 1))
    fits = (F.size(x) == dim) & F.forall(x, lambda c: F.abs(c) < limit)
    return F.when(fits, F.transform(x, lambda c: F.floor(c).cast("int")))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def round_sums(books: list[np.ndarray], dim: int, parts: int):
    """Per task: number and component sums of the parts nearest to each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((len(books[0]), dim), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            for p, cut in enumerate(cuts(dim, parts)):
                index, _ = equal_average(x[:, cut], books[p])
                np.add.at(count[p], index, 1)
                np.add.at(total[:, cut], index, x[:, cut])
        p, e = np.nonzero(count)
        sums = [total[j, cuts(dim, parts)[i]].tolist() for i, j in zip(p, e)]
        columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(sums, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return run


def moved(books: list[np.ndarray], ints: DataFrame, dim: int, parts: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    task = ints.select("v").mapInArrow(round_sums(books, dim, parts), "part int, entry int, n long, sums array<long>")
    # an entry of a part without components has a count and no sums: outer keeps no such row, it need not move
    each = task.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    found = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = [b.copy() for b in books]
    for r in found:
        out[r["part"]][r["entry"], r["at"]] = r["s"] // r["n"]
    return out


def coded(books: list[np.ndarray], dim: int, parts: int):
    """Per row: vec_id, label, the code and its error; both null where ``v`` is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            fits = np.flatnonzero(~np.asarray(v.is_null()))
            x = matrix(v.drop_null(), dim)
            errors, digits = np.zeros(len(x), np.int64), np.zeros((len(x), parts), np.uint8)
            for p, cut in enumerate(cuts(dim, parts)):
                index, apart = equal_average(x[:, cut], books[p])
                errors, digits[:, p] = errors + apart, index
            code, error = [None] * len(v), [None] * len(v)
            for i, row, e in zip(fits, digits, errors.tolist()):
                code[i], error[i] = row.tobytes().hex(), e
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(c) for book in books for entry in book.tolist() for c in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def train(ints: DataFrame, first: list, dim: int, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook per part, from the integer vectors ``v`` and the starting rows ``first``."""
    start = np.array(first, np.int64).reshape(len(first), dim)
    books = [start[:, cut].copy() for cut in cuts(dim, parts)]
    for _ in range(rounds):
        books = moved(books, ints, dim, parts)
    return books


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is not dropped; ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code digit is one byte")
    rows = kept_rows(vectors, vec_id, vector, label, scale)
    by_id = (F.asc_nulls_last("vec_id"), F.asc("x"))
    head = rows.orderBy(*by_id).select(F.size("x").alias("dim")).first()
    dim = head["dim"] if head else 0
    ints = cut_lineage(rows.select("vec_id", "label", whole(F.col("x"), dim).alias("v")))
    fitting = ints.where(F.col("v").isNotNull())
    first = [r["v"] for r in fitting.orderBy(F.asc_nulls_last("vec_id"), F.asc("v")).limit(entries).select("v").collect()]
    books = train(fitting, first, dim, parts, rounds) if first else []
    kind = T.StructType([ints.schema["vec_id"], ints.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        none = ints.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    found = cut_lineage(ints.mapInArrow(coded(books, dim, parts), kind)) if books else none
    # decimals do not overflow; what leaves a long becomes null
    sums = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_sum")).withColumnRenamed("label", "of_label")
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select(
        "vec_id", "code", "error",
        F.when(F.col("label_sum") < F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("label_sum").cast("long")).alias("label_error"),
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows from DuckDB, by comparing every part with every entry."""
    def assigned(k: int) -> str:
        gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
        return f"""a{k} AS MATERIALIZED (SELECT part, r, best[1] AS error, best[2] AS e FROM (
            SELECT p.part, p.r, min([CAST(coalesce({gap}, 0) AS BIGINT), c.e]) AS best FROM p JOIN c{k} c USING (part) GROUP BY p.part, p.r))"""

    steps = []
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""m{k} AS (SELECT part, e, list(v ORDER BY pos) AS x FROM (
            SELECT part, e, pos, CAST((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
            FROM (SELECT a.part, a.e, p.x, unnest(range(1, len(p.x) + 1)) AS pos FROM a{k} a JOIN p USING (part, r)) GROUP BY part, e, pos)
            GROUP BY part, e)""")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, e))")
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                          list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x
                           FROM v, range({parts}) t(part)),
        c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= {entries}),
        {", ".join(steps)}, {assigned(rounds)},
        g AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
              FROM a{rounds} GROUP BY r),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS s FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
        FROM v JOIN g USING (r), h"""
