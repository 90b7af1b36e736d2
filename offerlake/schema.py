"""Explicit schemas (as DDL) of what ingestion reads and writes, and natural keys. ``llm_metadata`` has provider_name, provider_domain, highlights,
expires_at and extracted_at, of which any may be absent."""

POSTS = "id string, source_id string, source_name string, source_thread_id string, canonical_url string, title string, author string, posted_at timestamp, last_seen_at timestamp, category string, raw_html string, raw_text string, is_duplicate boolean, llm_metadata variant, created_at timestamp, updated_at timestamp"
ITEMS = "post_id string, provider_name string, plan_name string, provider_domain string, price_amount double, price_currency string, billing_period string, price_monthly double, location string, cpu string, cpu_brand string, cpu_cores int, ram_mb int, storage_gb int, bandwidth_gb int, ipv4 int, ipv6 boolean, order_url string, promo_code string, promo_url string, is_primary boolean, created_at timestamp"
FINGERPRINTS = "post_id string, fingerprint string, fingerprint_type string, created_at timestamp"
THREADS = "source_name string, url string, title string, category string, summary string, html string"
REJECTED = "source_name string, canonical_url string, error string"

KEYS = {"posts": ["source_name", "canonical_url"], "sources": ["name"], "items": ["post_id"], "fingerprints": ["post_id"], "owners": ["fingerprint"]}


def names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]
