"""Crawl files: a file holds many records, so their number follows the rows slowly."""

from __future__ import annotations

from newsloom.plans import catalog_sources


def test_crawl_files_hold_many_records(spark, sf_dir, monkeypatch):
    seen = []
    read = catalog_sources.sources.crawled_urls
    monkeypatch.setattr(catalog_sources.sources, "crawled_urls", lambda s, path: seen.append(len(s.read.text(path).inputFiles())) or read(s, path))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = catalog_sources.crawled_urls(spark, sf_dir)
    assert seen[0] <= pages.count() // 100 + 1
    assert sorted(r.url for r in found.collect()) == sorted(r.url for r in pages.where("url IS NOT NULL").select("url").distinct().collect())
