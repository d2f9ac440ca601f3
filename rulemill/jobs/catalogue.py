"""Jobs over the catalogue and over caption runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.operators import captions, catalog
from rulemill.sources import files
from rulemill.sources.folders import new_folder
from rulemill.sources.tables import read

HOST = "files.example.org"
#: Catalogue hits made of pages: files repeat, titles and categories take turns.
_HIT = (
    "page_id AS pos",
    "array('Core Rules', 'Quick Start Guide', 'Faction Pack: Über Host', 'Balance Dataslate', 'Core Rules Updates', '#New40k - Core Rules', 'Tournament Companion', '')[page_id % 8] || CASE WHEN page_id % 5 = 0 THEN ' ' || page_id ELSE '' END AS title",
    "CASE WHEN page_id % 9 = 0 THEN array() ELSE array(array('core-rules-and-key-downloads', 'new40k', 'event-companions', 'miscellaneous', 'faction-packs', 'other')[page_id % 6]) END AS download_categories",
    "named_struct('file', CASE WHEN page_id % 31 = 0 THEN NULL ELSE 'eng_' || (page_id - page_id % 2) || CASE WHEN page_id % 4 = 0 THEN '-rules.PDF' ELSE '_notes.zip' END END) AS id",
)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parse_hits(read(spark, sf_dir, "pages").selectExpr(*_HIT), HOST)


def catalogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


def source_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole texts as titles."""
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'Faction Pack: ' WHEN 1 THEN '#New40k - ' ELSE '' END || text AS title")
    return docs.select("doc_id", catalog.source_slug(F.col("title")).alias("slug"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    manifest = entries.where("pos % 7 != 0").selectExpr("url", "CASE WHEN pos % 3 = 0 THEN NULL ELSE sha2(url, 256) END AS sha256")
    return catalog.sync_plan(entries, manifest, entries.where("pos % 5 != 0").select("relative_path"))


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("url", "relative_path", "action")


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sync_counts(_outcomes(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth download fails, every eleventh isn't tried."""
    plan = _plan(spark, sf_dir)
    return catalog.sync_outcomes(plan, plan.where("action = 'download' AND pos % 11 != 0").selectExpr("url", "pos % 9 != 0 AS ok"))


def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("url", "action", "outcome")


def hits_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue responses written as JSON files of some hits each, then read and parsed."""
    folder = new_folder(spark, "hits")
    rows = read(spark, sf_dir, "pages").selectExpr("page_id div 16 AS response", *_HIT)
    responses = rows.groupBy("response").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "download_categories", "id"))).alias("hits"))
    files.write_files(responses.select(F.concat("response", F.lit(".json")).alias("path"), F.encode(F.to_json(F.struct("hits")), "UTF-8").alias("content")), folder)
    hits = files.read_hits(spark, folder)
    return hits.select(F.col("pos").cast("long").alias("pos"), "title", F.array_join("download_categories", "|").alias("categories"), F.col("id.file").alias("file"))


def manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in which urls repeat, written, read and normalised: the last row of a url stays."""
    file = f"{new_folder(spark, 'manifest')}.json"
    rows = read(spark, sf_dir, "pages").selectExpr("page_id AS pos", "'Title ' || page_id AS title", "'https://files.example.org/' || (page_id - page_id % 3) AS url", "'f' || page_id || '.pdf' AS filename", "CASE WHEN page_id % 4 != 0 THEN 'faction-packs' END AS category", "sha2(html, 256) AS sha256", "CAST(length(html) AS BIGINT) AS bytes", "timestamp_seconds(page_id) AS downloaded_at")
    files.write_manifest(rows.repartition(4), file)
    return catalog.normalise_manifest(files.read_manifest(spark, file)).select("url", "title", "category", "parser_profile", "relative_path", "sha256", "bytes", F.unix_timestamp("downloaded_at").alias("at"))


def captions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption files of all runs, written with their summaries and read again, blank ones left out."""
    folder = new_folder(spark, "captions")
    pages = _runs(spark, sf_dir).withColumn("caption", F.expr("CASE WHEN event_id % 12 = 5 THEN ' ' ELSE ' caption ' || event_id || ' ' END"))
    told = files.caption_file(captions.summarise(_runs(spark, sf_dir), 60_000.0), pages.select("run_id", "page", "status", "skip_reason", "caption", "prompt_tokens", "output_tokens", "cost_usd"))
    body = F.to_json(F.struct(F.concat(F.lit("run_"), "run_id").alias("source_pdf"), F.sha2(F.col("run_id").cast("string"), 256).alias("sha256"), "pages"))
    files.write_files(told.select(F.concat("run_id", F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content")), folder)
    return files.read_captions(spark, folder).select("doc_id", "caption_sha256", F.col("page").cast("long").alias("page"), "caption")


def digests_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of pages written as a file each; those in the manifest have its digest."""
    folder = new_folder(spark, "pages")
    files.write_files(read(spark, sf_dir, "pages").select(F.concat(F.lit("f"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content")), folder)
    manifest = read(spark, sf_dir, "pages").where("page_id % 5 = 0").selectExpr("'f' || page_id || '.html' AS relative_path", "sha2('known ' || page_id, 256) AS sha256")
    return files.file_digests(spark, folder, manifest, root=folder.rsplit("/", 1)[-1] + "/")


#: Manifest rows made of pages, and the files that exist.
_ROW = ("page_id", "url", "'doc_' || page_id || '.pdf' AS filename", "'reference/doc_' || page_id || '.pdf' AS relative_path", "CASE page_id % 3 WHEN 0 THEN 'old/doc_' || page_id || '.pdf' WHEN 1 THEN 'reference/doc_' || page_id || '.pdf' END AS previous_path")
_FILE = "CASE page_id % 5 WHEN 0 THEN 'reference/doc_' WHEN 1 THEN 'old/doc_' WHEN 2 THEN 'doc_' WHEN 3 THEN 'core_rules/doc_' ELSE 'gone/doc_' END || page_id || '.pdf' AS relative_path"


def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return catalog.reconcile_plan(pages.selectExpr(*_ROW), pages.selectExpr(_FILE))


def migrate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return catalog.migrate_plan(pages.selectExpr(*_ROW), pages.where("page_id % 3 != 0").selectExpr("'doc_' || page_id || '.pdf' AS relative_path"), pages.selectExpr(_FILE))


def ingest_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "pages").selectExpr("CASE page_id % 4 WHEN 0 THEN 'rules/core_rules/' WHEN 1 THEN 'rules/excluded/' WHEN 2 THEN 'rules/unknown/' ELSE 'other/reference/' END || page_id || '.pdf' AS path")
    accepted, rejected = catalog.guard(paths, "rules/")
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").selectExpr("'folder_' || doc_id div 3 AS folder", "CASE WHEN doc_id % 5 = 0 THEN 'a_New40k_' ELSE 'b_' END || doc_id || '.pdf' AS name")
    return catalog.canonical_documents(files)


def caption_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", "sha2(text, 256) AS sha256", "CASE WHEN doc_id % 2 = 0 THEN 'core_rules' ELSE 'reference' END AS parser_profile")
    told = read(spark, sf_dir, "labels").join(docs.select("doc_id", "sha256"), "doc_id").selectExpr("doc_id", "CASE WHEN quality = 1 THEN sha256 ELSE 'old' END AS caption_sha256")
    return catalog.caption_status(docs, told).select("doc_id", "caption_status")


def layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as layouts: list items, paragraphs and links as drawings, links as images."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<(?:li|p|a)[ >]")).alias("drawing_count"), (F.regexp_count("html", F.lit("<a ")) % 12).alias("image_count"), (F.length("html") % 3000).alias("text_chars"))
    return captions.flag_pages(pages).select("page_id", *[F.col(c).cast("long").alias(c) for c in ("drawing_count", "image_count", "text_chars")], "diagram_score")


#: Events as caption calls: tokens from ids, every sixth of an unknown model.
_USAGE = ("event_id", "user_id", "event_id AS page", "array('gemini-2.5-pro', 'gemini-2.5-flash', 'gemini-2.5-flash-lite')[event_id % 3] || CASE WHEN event_id % 6 = 0 THEN '-x' ELSE '' END AS model", "named_struct('prompt', event_id % 1500, 'output', CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 400 END, 'thoughts', CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 90 END, 'total', event_id % 2100) AS usage")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, output = captions.billable_tokens(F.col("usage"))
    usage = read(spark, sf_dir, "events").selectExpr(*_USAGE).withColumn("prompt_tokens", prompt).withColumn("output_tokens", output)
    return captions.with_cost(usage, captions.prices(spark))


def caption_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir).select("event_id", "prompt_tokens", "output_tokens", F.bround("cost_usd", 9).alias("cost_usd"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _costs(spark, sf_dir).withColumn("cost_usd", F.bround(F.col("cost_usd") * 1e6)).withColumn("run_id", F.col("user_id"))
    return captions.apply_budget(costs.withColumn("caption", F.expr("CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'text' END")).withColumn("dry_run", F.lit(False)), 60_000.0)


def caption_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by user with costs in millionths, so that sums are exact."""
    return _runs(spark, sf_dir).select("event_id", "status", "skip_reason", "charged_usd")


def caption_budget_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all pages in one run."""
    costs = _costs(spark, sf_dir).withColumn("cost_usd", F.bround(F.col("cost_usd") * 1e6)).withColumn("run_id", F.lit(1))
    pages = costs.withColumn("caption", F.expr("CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'text' END")).withColumn("dry_run", F.lit(False))
    return captions.apply_budget(pages, 1_000_000.0).select("event_id", "status", "skip_reason", "charged_usd")


def caption_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.summarise(_runs(spark, sf_dir), 60_000.0)


QUERIES = [catalogue_entries, hits_read, manifest_read, captions_read, digests_of_files, source_slugs, sync_plan, sync_outcomes, sync_counts, reconcile_plan, migrate_plan, ingest_guard, canonical_documents, caption_digests, layout_flags, caption_costs, caption_budget, caption_budget_of_one, caption_runs]

_HITS_SQL = r"""
hits AS (
  SELECT page_id AS pos, ['Core Rules', 'Quick Start Guide', 'Faction Pack: Über Host', 'Balance Dataslate', 'Core Rules Updates', '#New40k - Core Rules', 'Tournament Companion', ''][page_id % 8 + 1] || CASE WHEN page_id % 5 = 0 THEN ' ' || page_id ELSE '' END AS t,
         CASE WHEN page_id % 9 = 0 THEN 'uncategorised' ELSE ['core-rules-and-key-downloads', 'new40k', 'event-companions', 'miscellaneous', 'faction-packs', 'other'][page_id % 6 + 1] END AS category,
         'eng_' || (page_id - page_id % 2) || CASE WHEN page_id % 4 = 0 THEN '-rules.PDF' ELSE '_notes.zip' END AS name
  FROM pages WHERE page_id % 31 != 0),
firsts AS (SELECT min(pos) AS pos, 'https://files.example.org/' || name AS url, name, arg_min(t, pos) AS t, arg_min(category, pos) AS category FROM hits GROUP BY name),
titled AS (SELECT pos, url, name, category, CASE WHEN t = '' THEN translate(regexp_replace(name, '\.[^.]+$', ''), '_-', '  ') ELSE t END AS title FROM firsts),
named AS (SELECT *, lower(trim(title)) AS n, left(regexp_replace(regexp_replace(lower(title), '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS slug FROM titled),
entries AS (
  SELECT pos, title, url, CASE WHEN lower(name) LIKE '%.pdf' THEN slug || '__' || name ELSE slug || '.pdf' END AS filename, category,
         CASE WHEN n = 'core rules' OR n LIKE '%quick start%' THEN 'excluded' WHEN n LIKE '%faction pack%' THEN 'faction_packs' WHEN category = 'event-companions' THEN 'event_companions' WHEN category = 'miscellaneous' THEN 'miscellaneous'
              WHEN category = 'core-rules-and-key-downloads' AND (n LIKE '%core rules updates%' OR n LIKE '%rules commentary%') THEN 'updates_and_faq' WHEN category = 'core-rules-and-key-downloads' AND n IN ('balance dataslate', 'munitorum field manual') THEN 'reference'
              WHEN category = 'core-rules-and-key-downloads' AND (n LIKE '%tournament companion%' OR n LIKE '%chapter approved%') THEN 'event_companions' WHEN category = 'new40k' AND n LIKE '%core rules%' THEN 'core_rules'
              WHEN category IN ('faction-packs', 'new40k') THEN 'faction_packs' ELSE 'miscellaneous' END AS parser_profile,
         parser_profile || '/' || filename AS relative_path
  FROM named)"""
_OUTCOME = "CASE WHEN action = 'skip' THEN 'skipped' WHEN pos % 11 != 0 AND pos % 9 != 0 THEN 'downloaded' ELSE 'failed' END"
_PLAN_SQL = f"""
WITH {_HITS_SQL}, plan AS (
  SELECT pos, url, relative_path, CASE WHEN pos % 5 != 0 AND pos % 7 != 0 AND pos % 3 != 0 THEN 'skip' ELSE 'download' END AS action FROM entries)"""
_MANIFEST_SQL = """
WITH manifest AS (SELECT page_id, url, 'doc_' || page_id || '.pdf' AS filename, 'reference/doc_' || page_id || '.pdf' AS target FROM pages)"""
_COST_SQL = """
WITH usage AS (
  SELECT event_id, user_id, event_id % 1500 AS prompt_tokens, CASE WHEN event_id % 7 != 0 AND event_id % 400 + event_id % 90 > 0 THEN event_id % 400 + event_id % 90 ELSE greatest(event_id % 2100 - event_id % 1500, 0) END AS output_tokens,
         CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 3 END AS m FROM events),
costs AS (SELECT *, (prompt_tokens * [1.25::DOUBLE, 0.30::DOUBLE, 0.10::DOUBLE][m + 1] + output_tokens * [10.0::DOUBLE, 2.50::DOUBLE, 0.40::DOUBLE][m + 1]) / 1e6::DOUBLE AS usd FROM usage)"""
_RUN_SQL = f"""{_COST_SQL}, micros AS (SELECT *, round_even(usd * 1e6::DOUBLE, 0) AS cost FROM costs),
runs AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM micros),
told AS (SELECT *, CASE WHEN before >= 60000 THEN 'budget_exceeded' WHEN event_id % 10 = 0 THEN 'empty_response' ELSE 'captioned' END AS status FROM runs),
charged AS (SELECT *, CASE WHEN status != 'captioned' THEN status END AS skip_reason, CASE WHEN status = 'budget_exceeded' THEN 0.0::DOUBLE ELSE cost END AS charged_usd FROM told)"""
ORACLES = {
    "catalogue_entries": f"WITH {_HITS_SQL} SELECT pos, title, url, filename, category, parser_profile, relative_path FROM entries",
    "source_slugs": r"""
WITH titles AS (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'Faction Pack: ' WHEN 1 THEN '#New40k - ' ELSE '' END || text) AS t FROM documents),
cut AS (SELECT doc_id, CASE WHEN starts_with(t, 'faction pack:') THEN regexp_replace(substr(t, 14), '^\s+|\s+$', '', 'g') ELSE t END AS t FROM titles)
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate(replace(t, '#new40k - ', ''), ' -', '__'), '[^\p{L}\p{N}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'unknown') AS slug FROM cut
""",
    "sync_plan": f"{_PLAN_SQL} SELECT url, relative_path, action FROM plan",
    "sync_outcomes": f"{_PLAN_SQL} SELECT url, action, {_OUTCOME} AS outcome FROM plan",
    "sync_counts": f"{_PLAN_SQL} SELECT {_OUTCOME} AS outcome, count(*) AS count FROM plan GROUP BY ALL",
    "hits_read": "SELECT row_number() OVER (PARTITION BY page_id // 16 ORDER BY page_id) - 1 AS pos, ['Core Rules', 'Quick Start Guide', 'Faction Pack: Über Host', 'Balance Dataslate', 'Core Rules Updates', '#New40k - Core Rules', 'Tournament Companion', ''][page_id % 8 + 1] || CASE WHEN page_id % 5 = 0 THEN ' ' || page_id ELSE '' END AS title, CASE WHEN page_id % 9 = 0 THEN '' ELSE ['core-rules-and-key-downloads', 'new40k', 'event-companions', 'miscellaneous', 'faction-packs', 'other'][page_id % 6 + 1] END AS categories, CASE WHEN page_id % 31 != 0 THEN 'eng_' || (page_id - page_id % 2) || CASE WHEN page_id % 4 = 0 THEN '-rules.PDF' ELSE '_notes.zip' END END AS file FROM pages",
    "manifest_read": """
WITH last AS (SELECT page_id - page_id % 3 AS u, max(page_id) AS p FROM pages GROUP BY ALL)
SELECT 'https://files.example.org/' || u AS url, 'Title ' || p AS title, CASE WHEN p % 4 != 0 THEN 'faction-packs' ELSE 'uncategorised' END AS category, CASE WHEN p % 4 != 0 THEN 'faction_packs' ELSE 'miscellaneous' END AS parser_profile, parser_profile || '/f' || p || '.pdf' AS relative_path, sha256(html) AS sha256, length(html)::BIGINT AS bytes, p AS at
FROM last JOIN pages ON p = page_id""",
    "digests_of_files": "SELECT 'f' || page_id || '.html' AS relative_path, CASE WHEN page_id % 5 = 0 THEN sha256('known ' || page_id) ELSE sha256(html) END AS sha256 FROM pages",
    "captions_read": f"{_RUN_SQL} SELECT 'run_' || user_id AS doc_id, sha256(user_id::VARCHAR) AS caption_sha256, event_id AS page, 'caption ' || event_id AS caption FROM charged WHERE status = 'captioned' AND event_id % 12 != 5",
    "reconcile_plan": f"""{_MANIFEST_SQL}
SELECT url, target, CASE WHEN page_id % 5 = 1 AND page_id % 3 = 0 THEN 'old/' || filename WHEN page_id % 5 = 2 THEN filename WHEN page_id % 5 = 3 THEN 'core_rules/' || filename END AS source,
       CASE WHEN page_id % 5 = 0 THEN 'skip' WHEN source IS NOT NULL THEN 'move' ELSE 'none' END AS action FROM manifest""",
    "migrate_plan": f"{_MANIFEST_SQL} SELECT url, target, CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 'skip' ELSE 'move' END AS action FROM manifest",
    "ingest_guard": """
SELECT CASE page_id % 4 WHEN 0 THEN 'rules/core_rules/' WHEN 1 THEN 'rules/excluded/' WHEN 2 THEN 'rules/unknown/' ELSE 'other/reference/' END || page_id || '.pdf' AS path,
       CASE page_id % 4 WHEN 0 THEN 'core_rules' WHEN 1 THEN 'excluded' END AS parser_profile, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'excluded profile' ELSE 'unknown profile' END AS reason FROM pages
""",
    "canonical_documents": """
WITH files AS (SELECT 'folder_' || doc_id // 3 AS folder, CASE WHEN doc_id % 5 = 0 THEN 'a_New40k_' ELSE 'b_' END || doc_id || '.pdf' AS name FROM documents)
SELECT folder, CASE WHEN count(*) FILTER (name LIKE '%New40k%') > 0 THEN min(name) FILTER (name LIKE '%New40k%') WHEN count(*) = 1 THEN min(name) END AS name, count(*) FILTER (name LIKE '%New40k%') = 0 AND count(*) > 1 AS ambiguous FROM files GROUP BY folder
""",
    "caption_digests": """
SELECT doc_id, CASE WHEN quality = 0 THEN 'stale' WHEN quality = 1 THEN 'ok' WHEN doc_id % 2 = 0 THEN 'missing' ELSE 'none' END AS caption_status FROM documents LEFT JOIN labels USING (doc_id)
""",
    "layout_flags": """
WITH layout AS (SELECT page_id, len(regexp_extract_all(html, '<(?:li|p|a)[ >]'))::BIGINT AS d, (len(regexp_extract_all(html, '<a ')) % 12)::BIGINT AS i, (length(html) % 3000)::BIGINT AS c FROM pages),
rated AS (SELECT *, d / greatest(c, 1) * 1000 AS ratio FROM layout)
SELECT page_id, d AS drawing_count, i AS image_count, c AS text_chars, round_even(d + 3 * i + ratio, 2) AS diagram_score FROM rated
WHERE d >= 70 OR i >= 8 OR (d >= 25 AND c < 2000 AND ratio >= 15) OR (d >= 35 AND c < 1200) OR (d >= 20 AND c < 1000 AND ratio >= 20) OR (d >= 40 AND c < 2800 AND ratio >= 12)
""",
    "caption_costs": f"{_COST_SQL} SELECT event_id, prompt_tokens, output_tokens, round_even(usd, 9) AS cost_usd FROM costs",
    "caption_budget": f"{_RUN_SQL} SELECT event_id, status, skip_reason, charged_usd FROM charged",
    "caption_budget_of_one": f"{_RUN_SQL.replace('PARTITION BY user_id ', '').replace('60000', '1000000')} SELECT event_id, status, skip_reason, charged_usd FROM charged",
    "caption_runs": f"""{_RUN_SQL}
SELECT user_id AS run_id, count(*) AS pages_scanned, count(*) AS pages_flagged, count(*) FILTER (status = 'captioned') AS pages_captioned, count(skip_reason) AS pages_skipped,
       coalesce(sum(prompt_tokens) FILTER (status != 'budget_exceeded'), 0)::BIGINT AS prompt_tokens, coalesce(sum(output_tokens) FILTER (status != 'budget_exceeded'), 0)::BIGINT AS output_tokens,
       sum(charged_usd) AS cost_usd, 60000.0::DOUBLE - sum(charged_usd) AS budget_left_usd FROM charged GROUP BY user_id""",
}
