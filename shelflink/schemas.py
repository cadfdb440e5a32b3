"""Explicit table schemas; nothing in the engine relies on schema inference."""

PAGES = "page_id bigint, url string, html string"

PAGE_INFO = """
  page_id bigint, url string, host string, origin string, title string,
  h1 array<string>, h2 array<string>, h3 array<string>,
  headings array<struct<level:int,tag:string,text:string>>,
  og_title string, og_type string, site_name string, description string, keywords string,
  json_ld_name string, json_ld_type string, json_ld_author string, canonical_url string,
  og_url string, lang string, image_count int, text_sample string, info_text string,
  info_fields array<string>, body_length int, navigation_type string, analysis_count int,
  captured_at timestamp, settled boolean
"""

RESPONSES = """
  step_id string, store string, tier int, query string, http_status int, final_url string,
  body string, ts timestamp
"""

STORE_ITEM = """
  store string, product_id string, title string, url string, maker string, author string,
  category string, price int, price_text string, currency string, is_free boolean,
  original_price int, original_price_text string, discount_label string, labels array<string>,
  approx_cny int, image_url string, age_rating int
"""

SEARCH_STEPS = """
  store string, query string, step_id string, http_status int, ok boolean, reason string,
  item_count int
"""

PAGE_SNAPSHOTS = "tab bigint, url string, signature string, kind string, ts timestamp"
