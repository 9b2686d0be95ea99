"""Writing a table as many small files and compacting them by bin packing, day by day.

1. `dealt` gives each row its day, lot and piece; the writer makes one sorted file of each.
2. The manifest, a row a file, is sorted by (day, descending rows, lot, piece) with an RDD's
   secondary sort; a day streams through one partition, which packs its small files first
   fit into a linked list of open groups.  Groups that even the day's smallest file would
   overfill leave the list at once.
3. Each group of several files is written by one task, streaming file after file under a
   hidden name that is then moved; a task that runs again makes the same file again.
4. When all groups are written and described, the sources that they replace are deleted,
   which may be repeated too.

Nothing but the number of rows comes to the driver, and nothing is broadcast.
Files are opened with pyarrow's file systems, by the URIs that Spark reports.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.frames import checkpointed, free_name, quoted, shared_folder

#: Parts of a day's rows where its number of rows meets them.
SALTS = 32


def share(rows: int, x: int) -> int:
    """The limit S(x) of a table of so many rows."""
    return 1 + rows // x


def dealt(df: DataFrame, total: int, at: str, key: str, day: str, lot: str, piece: str, lots: int = 150) -> DataFrame:
    """df with the columns day, lot and piece.

    day: whole days of `at` since 1970 (null: null).  The crc32 h of the decimal key (null:
    of nothing, 0) gives lot, floor(h / 16) modulo 1 + floor(rows of the day / S(lots)), and
    piece, the lesser of two base-4 digits of h.  A day's number of rows meets them salted.
    """
    h, salt, n, same_day, same_salt = (free_name([*df.columns, day, lot, piece], c) for c in ("_h", "_salt", "_n", "_d", "_s"))
    keyed = df.withColumns({day: F.unix_date(F.col(at).cast("date")).cast("long"), h: F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))})
    keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(h), F.lit(SALTS)).cast("int"))
    sizes = keyed.groupBy(F.col(day).alias(same_day)).agg(F.count("*").alias(n)).withColumn(same_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = keyed.join(sizes.hint("merge"), F.col(day).eqNullSafe(F.col(same_day)) & (F.col(salt) == F.col(same_salt)))
    low = lambda by: F.floor(F.col(h) / by) % 4
    made = {lot: F.floor(F.col(h) / 16) % (1 + F.floor(F.col(n) / share(total, lots))), piece: F.least(low(1), low(4))}
    return out.withColumns(made).select(*quoted(df.columns), day, lot, piece)


class Group:
    """An open group: its files in joining order and its neighbours in the list."""

    def __init__(self, room: int):
        self.files: list[tuple] = []
        self.room, self.rows, self.before, self.after = room, 0, None, None


class OpenGroups:
    """Groups in order of opening, linked both ways."""

    def __init__(self) -> None:
        self.first: Group | None = None
        self.last: Group | None = None

    def append(self, group: Group) -> None:
        group.before = self.last
        if self.last:
            self.last.after = group
        else:
            self.first = group
        self.last = group

    def remove(self, group: Group) -> None:
        if group.before:
            group.before.after = group.after
        else:
            self.first = group.after
        if group.after:
            group.after.before = group.before
        else:
            self.last = group.before

    def __iter__(self) -> Iterator[Group]:
        group = self.first
        while group:
            after = group.after
            yield group
            group = after


def first_fit(files: Iterable[tuple], small: int, most: int) -> Iterator[list[tuple]]:
    """Groups of files (day, rows, lot, piece, path, least rows of the day's small files).

    The files come by day and descending rows.  One of `small` rows or more stays alone; each
    other joins the earliest-opened group that then has at most `most` rows, or opens one
    (of its own if it alone has more).
    """
    open_, day = OpenGroups(), object()
    for f in files:
        if f[0] != day:
            yield from (g.files for g in open_)
            open_, day = OpenGroups(), f[0]
        rows, least = f[1], f[5]
        if rows >= small:
            yield [f]
            continue
        group = next((g for g in open_ if g.room >= rows), None)
        if group is None:
            group = Group(most)
            open_.append(group)
        group.files.append(f)
        group.room -= rows
        if group.room < least:
            open_.remove(group)
            yield group.files
    yield from (g.files for g in open_)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def joined_file(sources: list[str], name: str) -> str:
    """Streams the files, in their order, into one called `name` beside the first; its URI."""
    folder, _, _ = sources[0].rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    system, path = opened(hidden)
    with system.open_output_stream(path) as sink:
        writer = None
        for source in sources:
            origin, at = opened(source)
            with origin.open_input_file(at) as raw:
                part = pq.ParquetFile(raw)
                writer = writer or pq.ParquetWriter(sink, part.schema_arrow, compression="snappy")
                for batch in part.iter_batches(batch_size=1 << 16):
                    writer.write_batch(batch)
        writer.close()
    system.move(path, opened(f"{folder}/{name}")[1])
    return f"{folder}/{name}"


def described(uri: str, key: str, value: str) -> tuple:
    """(rows, least and greatest key, cents, digest of the keys in file order, column names)."""
    system, path = opened(uri)
    rows, cents, low, high, digest = 0, 0, None, None, hashlib.sha256()
    with system.open_input_file(path) as raw:
        part = pq.ParquetFile(raw)
        for batch in part.iter_batches(batch_size=1 << 16, columns=[key, value]):
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            money = batch.column(batch.schema.get_field_index(value)).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
            money = np.floor(100 * money + 0.5)
            cents += int(np.where(np.isfinite(money), money, 0).astype(np.int64).sum())
            digest.update(("," if rows and keys else "").encode() + ",".join("" if k is None else str(k) for k in keys).encode())
            rows += len(keys)
            known = [k for k in keys if k is not None]
            if known:
                low, high = min(known) if low is None else min(low, min(known)), max(known) if high is None else max(high, max(known))
        names = ",".join(part.schema_arrow.names)
    return rows, low, high, cents, digest.hexdigest(), names


def compacted(df: DataFrame, at: str = "arrived_at", key: str = "click_id", value: str = "value", lots: int = 150, small: int = 600, most: int = 400) -> DataFrame:
    """Writes df into a new folder of the shared checkpoint folder, compacts it there, and describes each final file.

    `at`: a timestamp; `key`: whole numbers; `value`: a number, null and infinite ones count as
    0 cents.  Files are sorted by at, then key, nulls first; rows equal in both are in any order.
    A null `at` is a day of its own (null).  Other columns are carried along, whatever
    their names; an empty table leaves an empty folder and gives no rows.
    """
    spark = df.sparkSession
    total = df.count()
    day, lot, piece = (free_name(df.columns, c) for c in ("day", "lot", "piece"))
    folder = f"{shared_folder(spark)}/compacted-{uuid.uuid4().hex}"
    parts = dealt(df, total, at, key, day, lot, piece, lots).repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, at, key)
    parts.write.partitionBy(day, lot, piece).parquet(folder)

    whole = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in (day, lot, piece))])
    files = spark.read.schema(whole).parquet(folder).groupBy(F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    files = checkpointed(files)
    limits = share(total, small), share(total, most)
    least = files.where(F.col("rows") < limits[0]).groupBy(F.col("day").alias("d")).agg(F.min("rows").alias("least"))
    manifest = files.join(least.hint("merge"), F.col("day").eqNullSafe(F.col("d")), "left").select("day", "rows", "lot", "piece", "path", F.coalesce("least", F.lit(0)).alias("least"))

    def pack(rows: Iterator) -> Iterator[tuple]:
        plain = ((r[0][0][1] if r[0][0][0] else None, -r[0][1], *r[0][2:], *r[1]) for r in rows)
        for group in first_fit(plain, *limits):
            f = group[0]
            yield (f[0], f[2], f[3], [f"{x[2]}-{x[3]}" for x in group], [x[4] for x in group])

    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = manifest.rdd.map(lambda r: (((r["day"] is not None, r["day"] or 0), -r["rows"], r["lot"], r["piece"]), (r["path"], r["least"])))
    ordered = keyed.repartitionAndSortWithinPartitions(n, lambda k: hash(k[0]))
    groups = spark.createDataFrame(ordered.mapPartitions(pack), "day long, lot long, piece long, names array<string>, paths array<string>")

    def execute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g in b.to_pylist():
                several = len(g["paths"]) > 1
                path = joined_file(g["paths"], f"compact-{g['lot']}-{g['piece']}.snappy.parquet") if several else g["paths"][0]
                rows, low, high, cents, digest, names = described(path, key, value)
                out.append({"day": g["day"], "lot": g["lot"], "piece": g["piece"], "n_rows": rows, "min_click_id": low, "max_click_id": high, "cents": cents, "sources": ",".join(g["names"]), "ids_sha256": digest, "columns": names, "path": path, "rewritten": several, "paths": g["paths"]})
            yield pa.RecordBatch.from_pylist(out, schema=shape) if out else pa.RecordBatch.from_pylist([], schema=shape)

    shape = pa.schema([
        ("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("n_rows", pa.int64()), ("min_click_id", pa.int64()), ("max_click_id", pa.int64()), ("cents", pa.int64()),
        ("sources", pa.string()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string()), ("rewritten", pa.bool_()), ("paths", pa.list_(pa.string())),
    ])
    result = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean, paths array<string>"
    final = checkpointed(groups.repartition(n, "day", "lot", "piece").mapInArrow(execute, result))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deletes replaced files, their checksum files and what tasks that were lost left."""
        for b in batches:
            for paths in b.column("paths").to_pylist():
                system, first = opened(paths[0])
                gone = [opened(p)[1] for p in paths]
                parent = first.rpartition("/")[0]
                left = [i.path for i in system.get_file_info(fs.FileSelector(parent)) if i.base_name.startswith(".compact-")]
                for path in [*gone, *(f"{p.rpartition('/')[0]}/.{p.rpartition('/')[2]}.crc" for p in gone), *left]:
                    with contextlib.suppress(FileNotFoundError):
                        system.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    final.where("rewritten").select("paths").mapInArrow(replace, "n long").agg(F.sum("n")).first()
    return final.drop("paths")
