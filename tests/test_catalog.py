import pytest
from pyspark.sql import functions as F

from rulemill.operators import catalog


@pytest.mark.parametrize(
    "title, category, profile",
    [
        (" Core Rules ", "new40k", "excluded"),
        ("Quick Start Guide", "new40k", "excluded"),
        ("Faction Pack: Any", "event-companions", "faction_packs"),
        ("Pairs", "event-companions", "event_companions"),
        ("Any", "miscellaneous", "miscellaneous"),
        ("Core Rules Updates", "core-rules-and-key-downloads", "updates_and_faq"),
        ("Balance Dataslate", "core-rules-and-key-downloads", "reference"),
        ("Chapter Approved 25", "core-rules-and-key-downloads", "event_companions"),
        ("#New40k - Core Rules", "new40k", "core_rules"),
        ("Something", "faction-packs", "faction_packs"),
        ("Something", None, "miscellaneous"),
    ],
)
def test_routes(spark, title, category, profile):
    df = spark.createDataFrame([(title, category)], "t string, c string")
    assert df.select(catalog.profile_col(F.col("t"), F.col("c"))).first()[0] == profile


def test_hits(spark):
    hits = spark.createDataFrame([(0, "A", ["x"], ("f.pdf",)), (1, "B", ["x"], ("f.pdf",)), (2, None, None, ("dir/my_file-1.PDF?q=1",)), (3, "C", [], (None,))], "pos long, title string, download_categories array<string>, id struct<file: string>")
    rows = sorted(catalog.parse_hits(hits, "h").collect(), key=lambda r: r.pos)
    assert [(r.title, r.category, r.filename) for r in rows] == [("A", "x", "a__f.pdf"), ("my file 1", "uncategorised", "my_file_1__my_file-1.PDF")]


def test_slugs(spark):
    df = spark.createDataFrame([("Faction Pack: Black  Sun",), ("#New40k - Core-Rules!",), ("***",), ("Ünï_cöde 9",)], "t string")
    assert [r[0] for r in df.select(catalog.source_slug(F.col("t"))).collect()] == ["black_sun", "core_rules", "unknown", "ünï_cöde_9"]


def test_manifest_last_row_wins(spark):
    raw = spark.createDataFrame([(0, "u", "A", "a.pdf", None, "s1"), (1, "u", "Core Rules", "b.pdf", "new40k", "s2")], "pos long, url string, title string, filename string, category string, sha256 string")
    (r,) = catalog.normalise_manifest(raw).collect()
    assert (r.sha256, r.relative_path) == ("s2", "excluded/b.pdf")


def test_sync_refresh(spark):
    entries = spark.createDataFrame([("u", "p", "new")], "url string, relative_path string, fetched_sha256 string")
    manifest = spark.createDataFrame([("u", "old")], "url string, sha256 string")
    files = spark.createDataFrame([("p",)], "relative_path string")
    act = lambda **k: catalog.sync_plan(entries, manifest, files, **k).first().action
    assert (act(), act(force=True), act(compare_digest=True)) == ("skip", "download", "download")


def test_reconcile_rows_of_one_url_are_told_apart(spark):
    rows = [("u", "a.pdf", "reference/a.pdf", "old/a.pdf"), ("u", "b.pdf", "reference/b.pdf", None), ("u", "c.pdf", "reference/c.pdf", "old/c.pdf"), ("u", "c.pdf", "reference/c.pdf", "old/c.pdf"), ("v", "d.pdf", "reference/d.pdf", "old/d.pdf")]
    manifest = spark.createDataFrame(rows, "url string, filename string, relative_path string, previous_path string")
    files = spark.createDataFrame([("old/a.pdf",), ("a.pdf",), ("core_rules/b.pdf",), ("reference/d.pdf",)], "relative_path string")
    got = sorted(tuple(r) for r in catalog.reconcile_plan(manifest, files).collect())
    none = ("u", "reference/c.pdf", None, "none")
    assert got == sorted([("u", "reference/a.pdf", "old/a.pdf", "move"), ("u", "reference/b.pdf", "core_rules/b.pdf", "move"), none, none, ("v", "reference/d.pdf", None, "skip")], key=str)
