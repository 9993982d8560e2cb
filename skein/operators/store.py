"""The chunk store: a Parquet table of chunks and vectors, bucketed by article.

Rows: id, wiki_page_id, article_title, section_path, chunk_text, chunk_index,
article_last_updated, links, embedding, and a partition column ``bucket`` by a hash of
the article, so that a change rewrites only the buckets it touches.  The number of buckets is
set when the store is made.

A change writes its buckets to a new version folder and then a new manifest, which names the
version folders of every bucket.  Readers take the manifest with the largest number, so they see the
state before a change or after it; a job that dies leaves the state before.  The
files of the state before the last are deleted with the next change, so a reader may go on for
the time of one change.  Of two writers at once the second one fails, if the file
system refuses to rename a file to an existing name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import log, shared
from skein.session import NotFoundError, ValidationError

BUCKETS = 64
#: Columns as they are given and returned; in the files, links are JSON text (``encode_metadata``).
SCHEMA = "id string, wiki_page_id string, article_title string, section_path string, chunk_text string, chunk_index int, article_last_updated string, links array<string>, embedding array<float>"
STORED = SCHEMA.replace("links array<string>", "links string") + ", bucket int"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def encode_metadata(rows: DataFrame) -> DataFrame:
    """Metadata as flat columns: links as JSON text (null if empty); names and books are left out."""
    return rows.withColumn("links", F.when(F.size(F.coalesce("links", F.array())) > 0, F.to_json("links"))).drop("character_names", "source_books")


def decode_metadata(rows: DataFrame) -> DataFrame:
    """The reverse: bad JSON is no links; missing texts are empty and a missing index is 0."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("wiki_page_id", "article_title", "section_path") if c in rows.columns}
    index = {"chunk_index": F.coalesce("chunk_index", F.lit(0))} if "chunk_index" in rows.columns else {}
    return rows.withColumns({**text, **index, "links": F.coalesce(F.from_json("links", "array<string>"), F.expr("cast(array() as array<string>)"))})


class ChunkStore:
    """A store under ``path``; opening creates it, with ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path_of = lambda p: hadoop.Path(p)
        self._files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._numbers():
            self._publish({"buckets": buckets, "live": {}}, 1)

    # --- manifests

    def _numbers(self) -> list[int]:
        folder = self._path_of(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_manifests/{number}", wholetext=True).first()[0])

    def state(self) -> tuple[int, dict]:
        """The current manifest's number, and the manifest: number of buckets, and each bucket's version folders."""
        numbers = self._numbers()
        if not numbers:
            raise NotFoundError(f"no store under {self.path}")
        return numbers[-1], self._manifest(numbers[-1])

    def _publish(self, manifest: dict, number: int) -> None:
        aside, final = (self._path_of(f"{self.path}/_manifests/{n}") for n in (f"_{uuid.uuid4().hex}", number))
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(aside, final):
            self._files.delete(aside, False)
            raise ValidationError("another change was made at the same time")

    def _commit(self, number: int, manifest: dict, live: dict[str, list[str]]) -> None:
        """Make ``live`` the state after ``number``, then delete what neither it nor the state before needs."""
        self._publish(manifest | {"live": live}, number + 1)
        versions = lambda m: {v for vs in m["live"].values() for v in vs}
        kept = versions(manifest) | versions({"live": live})
        for old in self._numbers()[:-2]:
            for v in versions(self._manifest(old)) - kept:
                self._files.delete(self._path_of(f"{self.path}/v={v}"), True)
            self._files.delete(self._path_of(f"{self.path}/_manifests/{old}"), False)

    # --- rows

    def _bucket(self, buckets: int, page="wiki_page_id"):
        return F.pmod(F.xxhash64(F.col(page) if isinstance(page, str) else page), F.lit(buckets)).cast("int")

    def _stored(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        live = (manifest or self.state()[1])["live"]
        wanted = live if buckets is None else {str(b): live[str(b)] for b in buckets if str(b) in live}
        paths = [f"{self.path}/v={v}/bucket={b}" for b, versions in wanted.items() for v in versions]
        if not paths:
            return self.spark.range(0).where("false").select(*(F.lit(None).cast(k).alias(n) for n, k in (f.split(" ", 1) for f in STORED.split(", "))))
        return self.spark.read.schema(STORED).option("basePath", self.path).parquet(*paths).select(*NAMES, "bucket")

    def rows(self) -> DataFrame:
        return decode_metadata(self._stored()).select(*NAMES)

    def _prepared(self, rows: DataFrame, buckets: int) -> DataFrame:
        have = [F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in (f.split(" ", 1) for f in SCHEMA.split(", "))]
        return encode_metadata(rows.select(*have)).withColumn("bucket", self._bucket(buckets))

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write prepared rows to a new version folder; its name and the buckets it has."""
        version = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/v={version}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._path_of(f"{self.path}/v={version}"))]
        return version, [int(n[7:]) for n in names if n.startswith("bucket=")]

    def add(self, rows: DataFrame) -> None:
        """Append chunks with vectors; a chunk without one is an error."""
        if rows.where(F.col("embedding").isNull()).take(1):
            raise ValidationError("a chunk has no vector")
        number, manifest = self.state()
        version, written = self._write(self._prepared(rows, manifest["buckets"]))
        live = dict(manifest["live"])
        for b in map(str, written):
            live[b] = [*live.get(b, []), version]
        self._commit(number, manifest, live)

    def get(self, chunk: str) -> DataFrame:
        """The row of an id, from one bucket; an unknown id is an error."""
        page, _, _ = chunk.rpartition("_")
        manifest = self.state()[1]
        b = self.spark.range(1).select(self._bucket(manifest["buckets"], F.lit(page))).first()[0]
        found = decode_metadata(self._stored([b], manifest).where(F.col("id") == chunk)).select(*NAMES)
        if not found.take(1):
            raise NotFoundError(chunk)
        return found

    def find(self, filters: dict | None = None, limit: int | None = None) -> DataFrame:
        from skein.operators.vector import where_equal

        found = where_equal(self.rows(), filters)
        return found.limit(limit) if limit is not None else found

    def count(self) -> int:
        return self._stored().count()

    def versions(self) -> DataFrame:
        """``(wiki_page_id, stored)``: each article's stored version."""
        return self._stored().groupBy("wiki_page_id").agg(F.min_by("article_last_updated", "chunk_index").alias("stored"))

    def _swap(self, number: int, manifest: dict, touched: list[int], kept: DataFrame) -> None:
        """Put the prepared rows ``kept`` in the place of the touched buckets."""
        version, written = self._write(kept)
        live = {b: v for b, v in manifest["live"].items() if int(b) not in set(touched)} | {str(b): [version] for b in written}
        self._commit(number, manifest, live)

    def delete_articles(self, ids: DataFrame) -> int:
        """Delete all chunks of the articles ``ids`` (wiki_page_id); returns how many there were."""
        number, manifest = self.state()
        pages = ids.select("wiki_page_id").distinct()
        counted = self._stored(None, manifest).join(pages, "wiki_page_id", "left_semi").groupBy("bucket").count().collect()  # at most a row for a bucket
        touched = [r["bucket"] for r in counted]
        if touched:
            self._swap(number, manifest, touched, self._stored(touched, manifest).join(pages, "wiki_page_id", "left_anti"))
        return sum(r["count"] for r in counted)

    def delete_chunk(self, chunk: str) -> None:
        """Delete one chunk; an unknown id is an error."""
        self.get(chunk)
        number, manifest = self.state()
        b = self.spark.range(1).select(self._bucket(manifest["buckets"], F.lit(chunk.rpartition("_")[0]))).first()[0]
        self._swap(number, manifest, [b], self._stored([b], manifest).where(F.col("id") != chunk))

    def replace_articles(self, rows: DataFrame) -> None:
        """Put new chunks of articles in the place of their old ones: the new rows are complete before an old one goes."""
        number, manifest = self.state()
        new = shared.materialise(self._prepared(rows, manifest["buckets"]))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if touched:
            old = self._stored(touched, manifest).join(new.select("wiki_page_id").distinct(), "wiki_page_id", "left_anti")
            self._swap(number, manifest, touched, old.unionByName(new))
            log.event("articles_replaced", store=self.path, buckets=len(touched))

    def purge(self) -> int:
        """Delete every row; returns how many there were."""
        number, manifest = self.state()
        n = self.count()
        self._commit(number, manifest, {})
        log.event("store_purged", store=self.path, rows=n)
        return n

    def drop(self) -> None:
        """Delete the store with its folder; opening it again makes an empty one."""
        shared.delete(self.spark, self.path)

    def health(self) -> dict:
        """Status, row count, or the error."""
        try:
            return {"status": "healthy", "count": self.count()}
        except Exception as e:  # whatever the storage raises is the answer
            return {"status": "unhealthy", "error": str(e)}
