"""Download catalogue: routing, names, de-duplication and the plans for syncing and moving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.functions.text import present, strip

# Profiles and the routes to them. A route has a category
# (None: any), a test of the lower-cased title ("is", "has" or None) with its texts, and the
# profile; the first that fits wins.
PROFILES = ("core_rules", "updates_and_faq", "reference", "faction_packs", "event_companions", "miscellaneous", "excluded")
ROUTES = (
    (None, "is", ("core rules",), "excluded"),
    (None, "has", ("quick start",), "excluded"),
    (None, "has", ("faction pack",), "faction_packs"),
    ("event-companions", None, (), "event_companions"),
    ("miscellaneous", None, (), "miscellaneous"),
    ("core-rules-and-key-downloads", "has", ("core rules updates", "rules commentary"), "updates_and_faq"),
    ("core-rules-and-key-downloads", "is", ("balance dataslate", "munitorum field manual"), "reference"),
    ("core-rules-and-key-downloads", "has", ("tournament companion", "chapter approved"), "event_companions"),
    ("new40k", "has", ("core rules",), "core_rules"),
    ("faction-packs", None, (), "faction_packs"),
    ("new40k", None, (), "faction_packs"),
)
OTHERWISE, UNCATEGORISED = "miscellaneous", "uncategorised"
#: What a title's slug loses: a prefix and a marker that may be anywhere.
SLUG_PREFIX, SLUG_MARKER = "faction pack:", "#new40k - "


def profile_col(title: Column, category: Column) -> Column:
    """The parser profile, also the folder, that a title and a category lead to."""
    name = F.lower(strip(title))
    out: Column | None = None
    for wanted, test, texts, profile in ROUTES:
        fits = F.lit(True) if wanted is None else category.eqNullSafe(F.lit(wanted))
        if test:
            any_of = F.lit(False)
            for text in texts:
                any_of = any_of | (name == text if test == "is" else F.contains(name, F.lit(text)))
            fits = fits & any_of
        out = F.when(fits, profile) if out is None else out.when(fits, profile)
    return out.otherwise(OTHERWISE)


def url_name(url: Column) -> Column:
    """The last part of a url's path, its query left out."""
    return F.regexp_extract(F.substring_index(url, "?", 1), r"([^/]*)/*\z", 1)


def title_from_url(url: Column) -> Column:
    return F.translate(F.regexp_replace(url_name(url), r"(?s)(?<=.)\.[^.]+\z", ""), "_-", "  ")


def safe_filename(title: Column, url: Column) -> Column:
    """A slug of the title of at most 80 characters, and the url's own name if that is a pdf."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-zA-Z0-9._-]+", "_"), r"^_+|_+\z", "")
    slug = F.coalesce(present(F.left(slug, F.lit(80))), F.lit("download"))
    name = url_name(url)
    return F.when(F.lower(name).endswith(".pdf"), F.concat(slug, F.lit("__"), name)).otherwise(F.concat(slug, F.lit(".pdf")))


def source_slug(title: Column) -> Column:
    """The label of a source: letters and digits of any script, joined by single underscores."""
    low = F.lower(title)
    low = F.when(low.startswith(SLUG_PREFIX), strip(F.substr(low, F.lit(len(SLUG_PREFIX) + 1)))).otherwise(low)
    low = F.translate(F.replace(low, F.lit(SLUG_MARKER), F.lit("")), " -", "__")
    low = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_]", ""), "_+", "_")
    return F.coalesce(present(F.regexp_replace(low, r"^_|_\z", "")), F.lit("unknown"))


def parse_hits(hits: DataFrame, host: str) -> DataFrame:
    """hits (pos, title, download_categories, id.file) -> pos, title, url, filename, category,
    parser_profile, relative_path. Hits without a file go; of hits with the same url the
    first stays."""
    found = hits.where(present(F.col("id.file")).isNotNull()).select("pos", F.concat(F.lit(f"https://{host}/"), "id.file").alias("url"), "title", F.coalesce(F.get("download_categories", F.lit(0)), F.lit(UNCATEGORISED)).alias("category"))
    # min_by is combined before the shuffle, so a url with very many hits is one row a task.
    first = found.groupBy("url").agg(F.min("pos").alias("pos"), F.min_by(F.struct("title", "category"), "pos").alias("hit"))
    named = first.select("pos", F.coalesce(present(F.col("hit.title")), title_from_url(F.col("url"))).alias("title"), "url", F.col("hit.category").alias("category"))
    return with_paths(named)


def with_paths(df: DataFrame) -> DataFrame:
    """Adds filename, parser_profile and relative_path of title, url and category."""
    out = df.withColumn("filename", safe_filename(F.col("title"), F.col("url"))).withColumn("parser_profile", profile_col(F.col("title"), F.col("category")))
    return out.withColumn("relative_path", F.concat_ws("/", "parser_profile", "filename"))


def normalise_manifest(raw: DataFrame) -> DataFrame:
    """Manifest rows (pos, url, title, filename, category, sha256, bytes, downloaded_at) with
    profile and path worked out anew; of rows with the same url the last stays."""
    keep = [c for c in raw.columns if c not in ("url", "pos", "parser_profile", "relative_path")]
    last = raw.groupBy("url").agg(F.max_by(F.struct(*keep), "pos").alias("r")).select("url", "r.*")
    rows = last.withColumn("category", F.coalesce("category", F.lit(UNCATEGORISED))).withColumn("parser_profile", profile_col(F.col("title"), F.col("category")))
    return rows.withColumn("relative_path", F.concat_ws("/", "parser_profile", "filename"))


def sync_plan(entries: DataFrame, manifest: DataFrame, files: DataFrame, force: bool = False, compare_digest: bool = False) -> DataFrame:
    """Adds the action for every catalogue entry: skip or download.

    An entry whose file exists and has a digest in the manifest is skipped unless forced.
    With `compare_digest` (entries then have fetched_sha256) changed bytes under a known url
    are downloaded as well.
    """
    known = manifest.select("url", F.col("sha256").alias("known_sha256"))
    there = files.select("relative_path").distinct().withColumn("exists", F.lit(True))
    df = entries.join(known, "url", "left").join(there, "relative_path", "left")
    have = F.coalesce("exists", F.lit(False)) & F.col("known_sha256").isNotNull()
    if compare_digest:
        have = have & F.col("known_sha256").eqNullSafe(F.col("fetched_sha256"))
    return df.withColumn("action", F.when(have & ~F.lit(force), "skip").otherwise("download")).drop("exists")


def sync_outcomes(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """Adds outcome to a plan after its downloads were tried (fetched: url, ok): skipped,
    downloaded, or failed, which is also what was never tried."""
    tried = fetched.groupBy("url").agg(F.bool_or("ok").alias("_ok"))
    outcome = F.when(F.col("action") == "skip", "skipped").when(F.coalesce("_ok", F.lit(False)), "downloaded").otherwise("failed")
    return plan.join(tried, "url", "left").withColumn("outcome", outcome).drop("_ok")


def sync_counts(plan: DataFrame) -> DataFrame:
    """How many entries have each outcome of a plan, or each action where nothing was tried."""
    return plan.groupBy("outcome" if "outcome" in plan.columns else "action").count()


def reconcile_plan(manifest: DataFrame, files: DataFrame, fallback: str = "core_rules") -> DataFrame:
    """url, target, source, action of manifest rows with previous_path: skip if the target
    exists; move from the first that exists of the previous path, the bare file name and the
    file in the `fallback` folder; else nothing."""
    there = files.select("relative_path").distinct().withColumn("exists", F.lit(True))
    row = ["url", "target", "from"]
    rows = manifest.select("url", F.col("relative_path").alias("target"), F.array(F.col("previous_path"), F.col("filename"), F.concat(F.lit(fallback + "/"), "filename")).alias("from"))
    # Urls may repeat, so each row has its own answer; equal rows have the same and are counted.
    places = F.posexplode_outer(F.concat(F.array("target"), F.filter("from", lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("target")))))
    tried = rows.groupBy(*row).agg(F.count(F.lit(1)).alias("copies")).select(*row, "copies", places.alias("place", "relative_path")).join(there, "relative_path", "left")
    found = F.col("exists") & F.col("relative_path").isNotNull()
    best = tried.groupBy(*row, "copies").agg(F.coalesce(F.bool_or(found & (F.col("place") == 0)), F.lit(False)).alias("done"), F.min_by(F.when(found & (F.col("place") > 0), F.col("relative_path")), F.when(found & (F.col("place") > 0), F.col("place"))).alias("source"))
    action = F.when(F.col("done"), "skip").when(F.col("source").isNotNull(), "move").otherwise("none")
    return best.select("url", "target", "source", action.alias("action"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def migrate_plan(manifest: DataFrame, legacy: DataFrame, files: DataFrame) -> DataFrame:
    """url, target, action: move what the legacy folder has and the new layout lacks."""
    old = legacy.select(F.col("relative_path").alias("filename")).distinct().withColumn("in_legacy", F.lit(True))
    new = files.select(F.col("relative_path").alias("target")).distinct().withColumn("in_new", F.lit(True))
    df = manifest.select("url", "filename", F.col("relative_path").alias("target")).join(old, "filename", "left").join(new, "target", "left")
    return df.select("url", "target", F.when(F.col("in_new") | F.col("in_legacy").isNull(), "skip").otherwise("move").alias("action"))


def guard(paths: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """Paths below `root` that may be ingested, with their profile, and the rejected, with a
    reason: unknown folder or excluded profile."""
    inside = F.col("path").startswith(root)
    folder = F.get(F.split(F.substr("path", F.lit(len(root) + 1)), "/"), F.lit(0))
    reason = F.when(~inside | ~folder.isin(*PROFILES), "unknown profile").when(folder == "excluded", "excluded profile")
    df = paths.withColumn("parser_profile", F.when(inside & folder.isin(*PROFILES), folder)).withColumn("reason", reason)
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")


def canonical_documents(files: DataFrame, marker: str = "new40k") -> DataFrame:
    """folder, name, ambiguous: the first name (sorted) with the marker, else the only one."""
    has = F.contains(F.lower("name"), F.lit(marker))
    best = files.groupBy("folder").agg(F.min(F.when(has, F.col("name"))).alias("marked"), F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    return best.select("folder", F.when(F.col("marked").isNotNull() | (F.col("n") == 1), F.coalesce("marked", "name")).alias("name"), (F.col("marked").isNull() & (F.col("n") > 1)).alias("ambiguous"))


def caption_status(documents: DataFrame, captions: DataFrame) -> DataFrame:
    """documents (doc_id, sha256, parser_profile) against captions (doc_id, caption_sha256):
    adds caption_status: ok, stale, missing (core rules without captions) or none."""
    df = documents.join(captions, "doc_id", "left")
    has = F.col("caption_sha256").isNotNull()
    status = F.when(has & (F.col("caption_sha256") != F.col("sha256")), "stale").when(has, "ok").when(F.col("parser_profile") == "core_rules", "missing").otherwise("none")
    return df.withColumn("caption_status", status)
