"""The store's tables; nothing is inferred. VERSION goes up with any change."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 2
TABLES = {
    "images": "id string, url string, sha256_hash string, width int, height int, format string, content_type string, file_size_bytes int, discovered_at timestamp, last_seen_at timestamp, download_success boolean, phash_hash string, dhash_hash string",
    "provenance": "id string, image_id string, source_page_url string, source_domain string, discovered_at timestamp, discovery_type string",
    "crawl_log": "id string, page_url string, domain string, crawled_at timestamp, status int, images_found int, images_downloaded int, error_message string, crawl_type string, crawl_run_id string",
    "crawl_runs": "id string, started_at timestamp, completed_at timestamp, mode string, pages_crawled int, images_found int, images_downloaded int, seed_source string, status string, error_message string",
    "domains": "id string, domain string, status string, block_reason string, block_reason_code string, first_blocked_at timestamp, claimed_by string, claim_expires_at timestamp, version int, pages_discovered long, pages_crawled long, images_found long, images_stored long, max_pages_per_run int, crawl_depth_reached int, image_yield_rate double, avg_images_per_page double, error_rate double, total_error_count int, consecutive_error_count int, priority_score int, priority_computed_at timestamp, seed_rank int, source string, first_seen_at timestamp, last_crawled_at timestamp, next_crawl_after timestamp, updated_at timestamp, last_crawl_run_id string, frontier_checkpoint_id string, frontier_size int, frontier_updated_at timestamp",
    "image_assets": "id string, sha256_hash string, file_size long, width int, height int, mime_type string, perceptual_hash string, dhash string, phash string, created_at timestamp",
    "image_observations": "id string, image_asset_id string, url string, source_page_url string, source_domain string, crawl_run_id string, observed_at timestamp",
    "detections": "id string, image_asset_id string, detection_confidence double, watermark_type string, detected_at timestamp, detector_version string",
    "frontier": "checkpoint_id string, url string, depth int, seq long, expires_at timestamp",
    "start_urls": "url string, domain_key string, rank long, priority long, source string",
    "requests": "url string, domain string, priority int, seq long, fingerprint string, crawl_type string",
    "fingerprints": "fingerprint string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
