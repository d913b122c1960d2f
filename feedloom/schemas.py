"""Table schemas and fixed values. No schema is ever inferred."""

# Table schemas.
FETCHES = (
    "fetch_id string, feed_id bigint, url string, final_url string, kind string, scrape_rule string, "
    "status int, network_error string, content_type string, content_length bigint, etag string, "
    "last_modified string, body binary, fetched_at timestamp"
)
ITEMS = (
    "item_id bigint, feed_id bigint, guid string, url string, title string, author string, summary string, "
    "content string, published_at timestamp, fetched_at timestamp, is_read int, is_starred int, read_at timestamp"
)
FEEDS = (
    "feed_id bigint, feed_url string, site_url string, title string, folder string, etag string, "
    "last_modified string, last_polled_at timestamp, last_status string, last_error string, error_count int, "
    "added_at timestamp, kind string, scrape_rule string, last_item_count int"
)
VERDICTS = "video_id string, is_short int, checked_at timestamp"
RUNS = (
    "run_id bigint, started_at timestamp, finished_at timestamp, trigger string, feeds bigint, ok bigint, "
    "not_modified bigint, errored bigint, inserted bigint, shorts_swept bigint, unclassified bigint, "
    "duration_ms bigint, note string"
)
ACTIONS = "action_id bigint, ts timestamp, act string, item_id bigint, feed_id bigint, folder string, state int"
PAGES = "page_id bigint, url string, html string"
RULE = "struct<item:string,title:string,link:string,date:string,summary:string>"
NODES = (
    "page_id bigint, error string, base_url string, node_id int, parent_id int, depth int, tag string, id string, "
    "classes array<string>, attrs map<string,string>, start int, open_end int, close_start int, end int, "
    "text string, text_len int, links int"
)

# Limits and thresholds of the reader and the poller.
PAGE_SIZE = 100
RETAIN_PER_FEED = 100
MAX_ITEMS_PER_POLL = 200
ERROR_BACKOFF_THRESHOLD = 5
BACKOFF_MINUTES = 360
POLL_INTERVAL_MIN = 20
SCRAPE_DECAY_RATIO = 0.5
SCRAPE_DECAY_FLOOR = 4
SHORTS_MAX_SECONDS = 195
PROBES_PER_FEED = 40
PROBES_PER_RUN = 200
API_BATCH = 50
MAX_PAGE_BYTES = 4_000_000
MAX_PAGE_ITEMS = 100
MAX_TITLE = 300
MAX_SUMMARY = 2000
MAX_SELECTOR = 200
FEED_TITLE_CAP = 200
FOLDER_CAP = 100
QUERY_CAP = 120
QUERY_TOKENS = 12
EXCERPT_LENGTH = 260
PANEL_MAX = 25
HEAD_SCAN_CHARS = 200_000
META_CHARS = 2048
UNGROUPED = "Ungrouped"
YOUTUBE_MARKER = "youtube.com/feeds/videos.xml"
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json", "application/json"]
COMMON_PATHS = ["/feed", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/feed/"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
NO_RULE_ERROR = "Marked as a scrape but carries no usable rule; re-add the page from the Add form."
