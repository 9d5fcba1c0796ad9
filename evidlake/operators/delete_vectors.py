"""Change feeds applied to a table with delete vectors.

A table is a folder of immutable files: images, key index and bitmaps. Applying a batch of changes never rewrites
one: the rows a batch supersedes are located through the key index (key -> file, position; of the buckets of keys
that the batch touches), the new images are appended, the superseded positions get their bits in bitmaps per file and
block of 32,768 rows, and readers drop the positions whose bit is set. Expiries are kept as tombstone images, so that a
later, older upsert can still be told to be out of date.

A version exists once its manifest does, which names its folders and is put in place by one rename. A batch that broke off
before that leaves folders nobody reads, and is simply applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions.times import instant_us
from evidlake.session import names_in, new_path, passing, put_new, text_of

#: Bits of one bitmap, as bitmap_construct_agg has them.
BLOCK = 32_768
_ORDER = "_order"
#: Buckets of the key index; a batch reads those of its keys.
BUCKETS = 16
#: Bitmaps (of 4 KB) that a reader broadcasts at once (64 MB); more are taken in groups of files, each read once.
GROUP = 16_384


def normalized(feed: DataFrame) -> DataFrame:
    """The changes of an entry feed that count, with their place in the order of application.

    Kept: rows with an id whose action is ``upsert`` or ``expire`` and whose ``ts`` is readable RFC 3339
    text. ``_order`` sorts by instant, then expire before upsert, then the higher ``seq`` first, so that
    the greatest is the last change and, of repeated changes, the one with the lowest ``seq`` (a null
    ``seq`` loses to any other). Every other column is carried along as it is.
    """
    return (
        feed.filter(F.col("action").isin("upsert", "expire") & F.col("id").isNotNull())
        .withColumn("_instant", instant_us("ts"))
        .filter(F.col("_instant").isNotNull())
        .withColumn(
            _ORDER,
            F.struct(
                F.col("_instant").alias("instant"),
                F.when(F.col("action") == "upsert", 1).otherwise(0).cast("int").alias("rank"),
                F.coalesce(-F.col("seq"), F.lit(-(2**63) + 1)).cast("bigint").alias("back"),
            ),
        )
        .drop("_instant")
    )


class DeleteVectorTable:
    """Versioned table kept by key. Opens the newest version in the folder, or the one asked for; ``version`` is 0 and
    nothing can be read where there is none yet. Versions are immutable and stay readable; ``epoch`` is the
    last batch number applied. ``buckets`` is fixed by the first version."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str], version: int | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, columns
        self.manifest = {"version": 0, "epoch": -1, "buckets": buckets, "images": [], "index": [], "vectors": []}
        newest = version if version is not None else max(self._versions(), default=0)
        if newest:
            self.manifest = json.loads(text_of(self.spark, self._manifest_path(newest)))

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def epoch(self) -> int:
        return self.manifest["epoch"]

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0].isdigit()]

    def _commit(self, manifest: dict) -> DeleteVectorTable:
        """Puts the manifest in place; fails if another writer made that version."""
        if not put_new(self.spark, self._manifest_path(manifest["version"]), json.dumps(manifest).encode()):
            raise FileExistsError(f"version {manifest['version']} of {self.path} exists already")
        nxt = DeleteVectorTable.__new__(DeleteVectorTable)
        nxt.__dict__.update(self.__dict__, manifest=manifest)
        return nxt

    def _images(self, folders: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in (folders or self.manifest["images"])]).select(
            "*",
            F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name")).alias("_file"),
            F.col("_metadata.row_index").alias("_pos"),
        )

    def _vectors(self) -> DataFrame | None:
        folders = self.manifest["vectors"]
        if not folders:
            return None
        v = self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])
        return v.groupBy("_file", "_block").agg(F.bitmap_or_agg("_bits").alias("_bits")) if len(folders) > 1 else v

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.manifest["buckets"])).cast("int")

    def _rows(self, columns: list[str]) -> DataFrame:
        """Rows whose bit is not set. Files without bitmaps are read as they are; the others meet the bitmaps of their own
        files, broadcast in groups of at most ``GROUP``, so that images are never shuffled."""
        if not self.version:
            raise ValueError(f"no version in {self.path} yet")
        rows, vectors = self._images().select(*columns, "_file", "_pos"), self._vectors()
        if vectors is None:
            return rows
        per_file = vectors.groupBy("_file").agg(F.count("*").alias("n")).orderBy("_file").collect()  # one row per file
        groups: list[list[str]] = [[]]
        n = 0
        for r in per_file:
            if n and n + r.n > GROUP:
                groups.append([])
                n = 0
            groups[-1].append(r["_file"])
            n += r.n
        block, bit = F.floor(F.col("_pos") / BLOCK).cast("bigint"), (F.col("_pos") % BLOCK).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")

        def without(part: DataFrame, v: DataFrame) -> DataFrame:
            return (
                part.withColumns({"_block": block, "_bit": bit})
                .join(F.broadcast(v), ["_file", "_block"], "left")
                .filter(F.col("_bits").isNull() | (F.getbit(byte, F.col("_bit") % 8) == 0))
                .drop("_block", "_bit", "_bits")
            )

        if len(groups) == 1:
            return without(rows, vectors)
        paths = {"/".join(f.split("/")[-2:]): f for f in self.spark.read.parquet(*[f"{self.path}/{f}" for f in self.manifest["images"]]).inputFiles()}
        out, rest = None, set(paths)
        for g in groups:
            rest -= set(g)
            part = without(self._of_files([paths[f] for f in g], columns), vectors.filter(F.col("_file").isin(g)))
            out = part if out is None else out.unionByName(part)
        return out.unionByName(self._of_files([paths[f] for f in sorted(rest)], columns)) if rest else out

    def _of_files(self, files: list[str], columns: list[str]) -> DataFrame:
        return self.spark.read.parquet(*files).select(
            *columns,
            F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name")).alias("_file"),
            F.col("_metadata.row_index").alias("_pos"),
        )

    def _index(self) -> DataFrame:
        kind = f"`{self.key}` {self.manifest['key_type']}, {_ORDER} struct<instant: bigint, rank: int, back: bigint>, _file string, _pos bigint, v string, _bucket int"
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/index").parquet(*[f"{self.path}/{f}" for f in self.manifest["index"]])

    def _touched(self, changes: DataFrame) -> DataFrame:
        """The index in the buckets of the keys of ``changes``."""
        buckets = [r[0] for r in changes.select(self._bucket()).distinct().collect()]  # as many as there are buckets at most
        return self._index().filter(F.col("_bucket").isin(buckets))

    def index(self) -> DataFrame:
        """Key -> order, file and position of its present image (tombstones too), one row per key."""
        last = self._index().groupBy(self.key).agg(F.max_by(F.struct(_ORDER, "_file", "_pos"), _ORDER).alias("_at"))
        return last.select(self.key, "_at.*")

    def read(self) -> DataFrame:
        """The live rows."""
        return self._rows([*self.columns, _ORDER]).filter(F.col(f"{_ORDER}.rank") == 1).drop(_ORDER, "_file", "_pos")

    def _index_of(self, folder: str, name: str) -> str:
        """Writes the index of new images: their keys are read back with the positions they got."""
        at = self._images([folder]).select(self.key, _ORDER, "_file", "_pos", self._bucket().alias("_bucket"))
        at.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/index/v={name}")
        return f"index/v={name}"

    def apply(self, changes: DataFrame, epoch: int | None = None) -> DeleteVectorTable:
        """The next version, with a batch of ``normalized`` changes applied.

        Of a batch only the last change per key goes on (combined map-side, so a hot key costs one row
        per task). Changes that are not later than the key's present one are dropped, whatever the order
        in which batches arrive; applying a batch again changes nothing. With an ``epoch`` that is not above the
        table's own the batch was applied before, and the same version comes back.
        """
        if epoch is not None and epoch <= self.epoch:
            return self
        payload, name, m = [c for c in self.columns if c != self.key], uuid.uuid4().hex, {**self.manifest, "key_type": dict(changes.dtypes)[self.key]}
        new = changes.select(self.key, _ORDER, F.struct(*payload).alias("_row"))
        if m["index"]:
            new = new.withColumn("_at", F.lit(None).cast("struct<_file: string, _pos: bigint>")).unionByName(
                self._touched(changes).select(self.key, _ORDER, F.struct("_file", "_pos").alias("_at")), allowMissingColumns=True
            )
            mine, theirs = F.when(F.col("_at").isNull(), F.col(_ORDER)), F.when(F.col("_at").isNotNull(), F.col(_ORDER))
            fresh = (
                new.groupBy(self.key)
                .agg(F.max_by("_row", mine).alias("_row"), F.max(mine).alias(_ORDER), F.max_by("_at", theirs).alias("_at"), F.max(theirs).alias("_was"))
                .filter(F.col(_ORDER).isNotNull() & (F.col("_was").isNull() | (F.col(_ORDER) > F.col("_was"))))
            )
        else:
            fresh = new.groupBy(self.key).agg(F.max_by("_row", _ORDER).alias("_row"), F.max(_ORDER).alias(_ORDER)).withColumn(
                "_at", F.lit(None).cast("struct<_file: string, _pos: bigint>")
            )
        images = f"images/{name}"
        # What an image supersedes stays beside it, so that index and bitmaps come from the files just written.
        fresh.select(self.key, "_row.*", _ORDER, F.col("_at._file").alias("_old_file"), F.col("_at._pos").alias("_old_pos")).write.option(
            "compression", "zstd"
        ).parquet(f"{self.path}/{images}")
        m["images"], m["index"] = [*m["images"], images], [*m["index"], self._index_of(images, name)]
        if self.manifest["index"]:
            bits = (
                self.spark.read.parquet(f"{self.path}/{images}").filter(F.col("_old_file").isNotNull())
                .groupBy(F.col("_old_file").alias("_file"), F.floor(F.col("_old_pos") / BLOCK).cast("bigint").alias("_block"))
                .agg(F.bitmap_construct_agg((F.col("_old_pos") % BLOCK).cast("bigint")).alias("_bits"))
            )
            bits.write.parquet(f"{self.path}/vectors/{name}")
            m["vectors"] = [*m["vectors"], f"vectors/{name}"]
        m["version"], m["epoch"] = m["version"] + 1, max(m["epoch"], m["epoch"] if epoch is None else epoch)
        return self._commit(m)

    def compact(self) -> DeleteVectorTable:
        """The next version with the same state: present images and tombstones in one folder, no bitmaps, one index."""
        name, m = uuid.uuid4().hex, dict(self.manifest)
        rows = self._rows([*self.columns, _ORDER]).drop("_file", "_pos")
        rows.withColumns({"_old_file": F.lit(None).cast("string"), "_old_pos": F.lit(None).cast("bigint")}).write.option("compression", "zstd").parquet(f"{self.path}/images/{name}")
        m["images"], m["vectors"] = [f"images/{name}"], []
        m["index"] = [self._index_of(f"images/{name}", name)]
        m["version"] += 1
        return self._commit(m)


def current_state(feed: DataFrame, batches: int = 4) -> DataFrame:
    """Live entries with their present fields after a whole feed, applied in ``batches`` of arrival order.

    The feed's ``seq`` range is cut into equal spans; each span is one batch for the delete-vector table.
    ``seq`` in the result is the lowest of the change that made the entry what it is. Ids, times and
    actions that do not count (null id, unreadable ``ts``, other actions) are skipped, repeated and late
    rows change nothing, null or odd values in any other column are kept, extra columns are ignored.
    An empty feed gives an empty table with the same columns.
    """
    spark = feed.sparkSession
    columns = [c for c in ("id", "seq", "path", "summary", "tags", "kind", "evidence_status", "permanent", "version_ref", "session_id", "ts") if c in feed.columns]
    changes = normalized(feed)
    lo, hi = feed.agg(F.min("seq"), F.max("seq")).first()
    out = DeleteVectorTable(spark, path := new_path(spark, "entries"), "id", columns)
    if lo is None:
        out = out.apply(changes)
        passing(spark, path)
        return out.read()
    cuts = [lo + (hi - lo) * i // batches for i in range(1, batches)]
    seq = F.col("seq")
    for i in range(batches):
        span = F.lit(True)
        if i:
            span = seq > cuts[i - 1]
        if i < batches - 1:
            span = span & (seq <= cuts[i])
        if i == 0:
            span = span | seq.isNull()
        out = out.apply(normalized(feed.filter(span)))
    passing(spark, path)
    return out.read()
