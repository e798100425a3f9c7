"""Differences between two copies of data by invertible Bloom lookup tables.

Every record becomes one item ``(key hash, row hash)``.  Each side is passed once on its own: the newest delivery of
a key is kept (combined map-side), and the task that holds a bucket of keys fills the bucket's table of cells, each a
count and XORs of the items in it.  Only these tables meet: subtracting them cancels equal records, and peeling cells
that hold a single item reveals the keys that differ.  Buckets whose table was too small are filled again with more
cells, and what is still not peeled is compared item by item, so nothing is missed.  The records of the revealed keys
are then fetched from the tables and their fields compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldloom.functions.values import once
from worldloom.session import materialize

HASHES = 3
#: Tables a task holds at once; beyond them it sends on what it has, and tables of one bucket are added up later.
OPEN_TABLES = 4096


@dataclass(frozen=True)
class Copies:
    """Two copies of one table: records are found by ``key``, and ``fields`` are compared under their names."""

    left: DataFrame
    right: DataFrame
    key: list[str]
    fields: dict[str, Column]


def _stir(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _places(kh: np.ndarray, rh: np.ndarray, cells: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The item's cell under each hash function, each in its own part of the table, and its check word."""
    both = _stir(kh, 1) ^ _stir(rh, 2)
    part = cells // HASHES
    return [(_stir(both, 11 + i).view(np.uint64) % np.uint64(part)).astype(np.int64) + i * part for i in range(HASHES)], _stir(both, 5)


def _put(tables: np.ndarray, row: np.ndarray, sign: np.ndarray, kh: np.ndarray, rh: np.ndarray) -> None:
    """Add items to tables ``(row, cell, n kx rx cx)``; with the opposite sign, take them out."""
    cells = tables.shape[1]
    flat = tables.reshape(-1, 4)
    where, check = _places(kh, rh, cells)
    for place in where:
        at = row * cells + place
        np.add.at(flat[:, 0], at, sign)
        for j, x in ((1, kh), (2, rh), (3, check)):
            np.bitwise_xor.at(flat[:, j], at, x)


def _fill(cells: int, sign: int):
    """Tables of the buckets met in a task: ``bucket, cells`` (count, key, row and check word of each cell)."""
    schema = pa.schema([("bucket", pa.int64()), ("cells", pa.list_(pa.int64()))])

    def sent(rows: dict[int, int], tables: np.ndarray) -> pa.RecordBatch:
        k = len(rows)
        offsets = np.arange(k + 1, dtype=np.int32) * (cells * 4)
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tables[:k].reshape(-1).copy()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        tables = np.zeros((64, cells, 4), np.int64)
        for b in batches:
            bucket, kh, rh = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            seen, inverse = np.unique(bucket, return_inverse=True)
            if rows and len(rows) + len(seen) > OPEN_TABLES:
                yield sent(rows, tables)
                rows = {}
                tables[:] = 0
            for x in seen.tolist():
                rows.setdefault(x, len(rows))
            if len(rows) > len(tables):
                tables = np.concatenate([tables, np.zeros((max(len(rows) - len(tables), len(tables)), cells, 4), np.int64)])
            at = np.asarray([rows[x] for x in seen.tolist()], np.int64)[inverse] if len(seen) else np.zeros(0, np.int64)
            _put(tables, at, np.full(len(at), sign, np.int64), kh, rh)
        if rows:
            yield sent(rows, tables)

    return run


def _peel(cells: int):
    """Subtract and peel the tables of each bucket: ``bucket, kh, stuck``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 500_000 // cells)  # bounds the tables peeled at once
        for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            k = b.num_rows
            buckets = b.column(0).to_numpy(zero_copy_only=False)
            tables = np.zeros((k, cells, 4), np.int64)
            for row, parts in enumerate(b.column(1)):
                for part in parts.values:
                    t = part.values.to_numpy(zero_copy_only=False).reshape(cells, 4)
                    tables[row, :, 0] += t[:, 0]
                    tables[row, :, 1:] ^= t[:, 1:]
            flat = tables.reshape(-1, 4)
            found_row, found_key = [], []
            while True:
                one = np.flatnonzero(np.abs(flat[:, 0]) == 1)
                one = one[_places(flat[one, 1], flat[one, 2], cells)[1] == flat[one, 3]] if len(one) else one
                if not len(one):
                    break
                # The same item may stand alone in several of its cells.
                row = one // cells
                _, first = np.unique(np.stack([row, flat[one, 1], flat[one, 2]]), axis=1, return_index=True)
                one, row = one[first], row[first]
                sign, key, rh = flat[one, 0].copy(), flat[one, 1].copy(), flat[one, 2].copy()
                _put(tables, row, -sign, key, rh)
                found_row.append(row)
                found_key.append(key)
                if sum(map(len, found_row)) > k * cells:  # more items than cells: a check word was hit by chance
                    break
            stuck = (flat != 0).any(1).reshape(k, cells).any(1)
            row = np.concatenate(found_row) if found_row else np.zeros(0, np.int64)
            key = np.concatenate(found_key) if found_key else np.zeros(0, np.int64)
            ok = ~stuck[row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[buckets[row[ok]], buckets[stuck]], pa.int64()),
                    pa.array(np.r_[key[ok], np.zeros(stuck.sum(), np.int64)], pa.int64()),
                    pa.array(np.r_[np.zeros(ok.sum(), bool), np.ones(stuck.sum(), bool)]),
                ],
                names=["bucket", "kh", "stuck"],
            )

    return run


def differing_keys(left: DataFrame, right: DataFrame, buckets: int, cells: int = 240, growth: int = 4, rounds: int = 2) -> DataFrame:
    """``kh``: hashes of the keys whose items differ between the sides, a few equal ones at most.

    The sides hold ``kh, rh, at``, deliveries of a key in any number; the greatest ``at`` counts.  Each bucket's
    table has ``cells`` cells, ``growth`` times more in each of ``rounds``.
    """
    spark = left.sparkSession
    # A multiple of the shuffle partitions, by the shuffle's own hash: all keys of a bucket meet in one task.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = width * -(-max(1, buckets) // width)
    bucket = F.pmod(F.hash("kh"), F.lit(n)).cast("bigint").alias("bucket")
    newest = [s.groupBy("kh").agg(F.max_by("rh", "at").alias("rh")).select(bucket, "kh", "rh") for s in (left, right)]
    found: list[DataFrame] = []
    for _ in range(rounds):
        tables = [s.mapInArrow(_fill(cells, sign), "bucket bigint, cells array<bigint>") for s, sign in zip(newest, (1, -1))]
        met = tables[0].unionByName(tables[1]).groupBy("bucket").agg(F.collect_list("cells").alias("tables"))
        got = materialize(met.mapInArrow(_peel(cells), "bucket bigint, kh bigint, stuck boolean"), f"iblt-{cells}")
        found.append(got.filter("NOT stuck").select("kh"))
        stuck = got.filter("stuck").select("bucket").distinct()
        if stuck.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        again = [s.withColumn("bucket", bucket).join(stuck, "bucket", "left_semi").drop("bucket") for s in (left, right)]
        newest = [s.groupBy("kh").agg(F.max_by("rh", "at").alias("rh")).select(bucket, "kh", "rh") for s in again]
        cells *= growth
    # Exact way for the rest: every key of a stuck bucket whose items do not cancel.
    signed = newest[0].withColumn("sign", F.lit(1)).unionByName(newest[1].withColumn("sign", F.lit(-1)))
    found.append(signed.groupBy("kh", "rh").agg(F.sum("sign").alias("n")).filter("n <> 0").select("kh"))
    return reduce(DataFrame.unionByName, found).distinct()


def _key_hash(key: list[str], salt: int = 0) -> Column:
    return F.xxhash64(F.lit(salt), *[c for k in key for c in (F.col(k), F.col(k).isNull())])


def _row_hash(fields: dict[str, Column]) -> Column:
    """Hash of all fields that keeps null apart from every value; each field is computed once."""
    return F.xxhash64(*[once(c, lambda x: F.xxhash64(F.lit(3), x.isNull(), x)) for c in fields.values()])


def reconcile_all(copies: list[Copies], order: str = "loaded_at", missing_right: str = "missing_in_mirror", missing_left: str = "missing_in_live", bucket_rows: int = 2000, **tuning: int) -> list[DataFrame]:
    """Rows missing on either side and rows whose values differ, of several tables at once: per table ``*key, difference``.

    Both sides may hold superseded deliveries: the greatest ``order`` per key counts, and a null order is the oldest.
    Values are compared null-safely (null equals null only); hand in lists spelled as text, since a hash of a list
    skips its nulls.  Null key parts are ordinary key values.  Two empty
    sides give no rows.  A bucket holds about ``bucket_rows`` records of a side.
    """
    at = F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))

    def items(side: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(c, side).select(_key_hash(c.key, i).alias("kh"), _row_hash(c.fields).alias("rh"), at.alias("at")) for i, c in enumerate(copies)])

    rows = reduce(DataFrame.unionByName, [c.left.select(F.lit(1).alias("one")) for c in copies]).count()
    keys = materialize(differing_keys(items("left"), items("right"), -(-rows // bucket_rows), **tuning), "differing")
    out = []
    for i, c in enumerate(copies):
        # Fetch the records of the revealed keys and compare the values themselves.
        def fetched(df: DataFrame, sign: int) -> DataFrame:
            hit = df.withColumn("__kh", _key_hash(c.key, i)).join(keys.withColumnRenamed("kh", "__kh"), "__kh", "left_semi")
            return hit.select(*c.key, at.alias("__at"), F.struct(*[v.alias(f) for f, v in c.fields.items()]).alias("__f"), F.lit(sign).alias("__sign"))

        newest = fetched(c.left, 1).unionByName(fetched(c.right, -1)).groupBy(*c.key).agg(*[F.max_by(F.when(F.col("__sign") == s, F.col("__f")), F.when(F.col("__sign") == s, F.col("__at"))).alias(n) for s, n in ((1, "__a"), (-1, "__b"))])
        each = F.array_compact(F.array(*[F.when(~F.col("__a")[f].eqNullSafe(F.col("__b")[f]), F.lit(f)) for f in c.fields]))
        names = F.when(F.col("__b").isNull(), F.array(F.lit(missing_right))).when(F.col("__a").isNull(), F.array(F.lit(missing_left))).otherwise(each)
        out.append(newest.select(*c.key, F.explode(names).alias("difference")))
    return out


def reconcile(left: DataFrame, right: DataFrame, key: list[str], fields: dict[str, Column], **how) -> DataFrame:
    """``reconcile_all`` of one table."""
    return reconcile_all([Copies(left, right, key, fields)], **how)[0]
