"""Reading and writing the catalogue, captions, payloads and stores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.functions.text import present, strip
from rulemill.sources.jsonarray import JsonArray
from rulemill.sources.paths import exists
from rulemill.sources.store import BUCKETS, KeyedStore

HITS = "hits array<struct<title: string, download_categories: array<string>, id: struct<file: string>>>"
MANIFEST = "title string, url string, filename string, category string, parser_profile string, relative_path string, sha256 string, bytes long, downloaded_at timestamp"
CAPTIONS = "source_pdf string, sha256 string, model string, generated_at string, render_dpi int, budget_usd double, pages map<string, struct<caption: string, has_figure: boolean, prompt_tokens: int, output_tokens: int, cost_usd: double, diagram_score: double, drawing_count: int, image_count: int, text_chars: int>>"
#: Bytes of a file that are hashed at once.
PIECE = 4 << 20
_TEXT = T.StringType()
_MESSAGE = T.StructType([T.StructField("id", _TEXT), T.StructField("from_me", T.BooleanType()), T.StructField("type", _TEXT), T.StructField("chat_id", _TEXT), T.StructField("timestamp", T.LongType()), T.StructField("text", T.StructType([T.StructField("body", _TEXT)])), T.StructField("from", _TEXT), T.StructField("from_name", _TEXT)])
PAYLOAD = T.StructType([T.StructField("messages", T.ArrayType(_MESSAGE)), T.StructField("event", T.StructType([T.StructField("type", _TEXT), T.StructField("event", _TEXT)])), T.StructField("channel_id", _TEXT)])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """pos, title, download_categories, id of a catalogue response; a response without hits
    has none, one whose hits aren't a list fails."""
    raw = spark.read.schema(HITS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.posexplode("hits").alias("pos", "hit")).select("pos", "hit.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows of a manifest with pos, the place that was written with them, or else that in
    the file, and previous_path; JSON lines or one array. A missing file has no rows."""
    schema = MANIFEST + ", pos long"
    raw = spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return raw.withColumn("pos", F.coalesce("pos", F.monotonically_increasing_id())).withColumn("previous_path", F.col("relative_path"))


def write_manifest(records: DataFrame, path: str) -> None:
    """A manifest in whole as one JSON array, in place of the one before: `path` (a URI) is the file. Rows are
    in the order of their partitions; a column pos keeps their own. A write that fails leaves the old file as it was."""
    spark = records.sparkSession
    spark.dataSource.register(JsonArray)
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.format("json_array").mode("append").option("path", path).save()


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the source), caption_sha256, page, caption; blank captions are left out."""
    raw = spark.read.schema(CAPTIONS).option("multiLine", True).json(path)
    rows = raw.select(F.col("source_pdf").alias("doc_id"), F.col("sha256").alias("caption_sha256"), F.explode("pages").alias("page", "p"))
    return rows.select("doc_id", "caption_sha256", F.col("page").cast("int").alias("page"), strip(F.col("p.caption")).alias("caption")).where(present(F.col("caption")).isNotNull())


def caption_file(summary: DataFrame, pages: DataFrame, run: str = "run_id") -> DataFrame:
    """A row per run: the columns of its summary and a map of its captioned pages."""
    detail = [c for c in pages.columns if c not in (run, "page", "status", "skip_reason")]
    done = pages.where("status = 'captioned'").groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), F.struct(*detail)))).alias("pages"))
    return summary.join(done, run, "left")


def page_text(pages: DataFrame) -> DataFrame:
    """Pages with text; they keep the numbers they have among all pages."""
    return pages.where(F.length(strip(F.coalesce("text", F.lit("")))) > 0)


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes rows (path, content) as a file each below `folder`, which all executors must share. A
    task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(content)
            yield batch.select([0])

    rows.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def file_digests(spark: SparkSession, path: str, manifest: DataFrame | None = None, root: str = "") -> DataFrame:
    """relative_path, sha256 of files: the manifest's digest where it has one. Only files without are read, each
    as a stream, so their size doesn't matter; they are dealt to tasks by their names. Spark's listing leaves out
    files of no bytes, and so does this."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select("path", F.regexp_replace("path", "^.*" + root, "").alias("relative_path"))  # without their contents
    known = manifest.where("sha256 IS NOT NULL").groupBy("relative_path").agg(F.min("sha256").alias("sha256")) if manifest is not None else spark.createDataFrame([], "relative_path string, sha256 string")
    told = named.join(known, "relative_path", "left")
    own = told.where("sha256 IS NULL").select("relative_path", "path").repartition("path").mapInArrow(_digests, "relative_path string, sha256 string")
    return told.where("sha256 IS NOT NULL").select("relative_path", "sha256").unionByName(own)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            store, name = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("relative_path"), pa.array(found, pa.string())], ["relative_path", "sha256"])


def upsert_store(spark: SparkSession, path: str, new: DataFrame, key: str = "doc_key", order: tuple[str, ...] = ("page", "chunk_index"), buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Upserts into the keyed store at `path`, which is made if it isn't there, and returns its rows
    and the number of rows that were written: those of `new` without repeated keys. Only
    the buckets of its keys are written again."""
    store = KeyedStore(spark, path, new.schema, key, tuple(c for c in order if c in new.columns), buckets)
    written = store.upsert(new)
    return store.read(), written


def messages(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A row per message of JSON payloads, batch or stream; payloads whose event is of
    another type than messages are ignored, missing strings are empty."""
    parsed = payloads.select(*[c for c in payloads.columns if c != column], F.from_json(column, PAYLOAD).alias("p"))
    wanted = parsed.where(F.col("p.event.type").isNull() | (F.col("p.event.type") == "messages"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = wanted.select(*[c for c in payloads.columns if c != column], F.explode("p.messages").alias("m"))
    return rows.select(
        *[c for c in payloads.columns if c != column], text("m.id").alias("id"), F.coalesce("m.from_me", F.lit(False)).alias("from_me"), text("m.type").alias("type"), text("m.chat_id").alias("chat_id"),
        F.timestamp_seconds("m.timestamp").alias("ts"), text("m.text.body").alias("body"), text("m.from").alias("sender"), text("m.from_name").alias("sender_name"),
    )
