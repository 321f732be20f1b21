"""Fixed values for saved-page rules: keyword lists, field patterns and phrases."""

# --- fixed values ---------------------------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RUN = (r"(?:(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])?\d{3}[\s.-]?\d{3,4}(?:[\s.-]?\d{3,4})?)")

SECTION_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dd", "dt", "a", "span", "footer"]

PAGE_KEYWORDS = {
    "instagram": ["followers", "following", "posts", "likes", "comments", "share", "profile", "bio", "caption",
                  "story", "reel", "igtv", "highlights", "instagram", "follow", "like", "comment", "save", "bookmark"],
    "youtube": ["views", "subscribers", "likes", "comments", "share", "subscribe", "channel", "video", "shorts",
                "playlist", "youtube", "watch", "uploaded", "streamed"],
    "linkedin": ["connections", "followers", "posts", "likes", "comments", "shares", "profile", "company",
                 "newsletter", "article", "post", "feed", "linkedin", "connect", "follow", "like", "comment", "share",
                 "experience", "education", "skills", "endorsements"],
    "facebook": ["likes", "comments", "shares", "friends", "followers", "posts", "photos", "videos", "about",
                 "community", "reviews", "events", "groups", "marketplace", "facebook", "meta"]}

# Field name, kind (text, flag, whole) and the patterns that fill it; a later pattern wins over an earlier one.
INSTAGRAM_SCRIPT_FIELDS = [
    ("username", "text", [r'"username"\s*:\s*"([^"]+)"']),
    ("full_name", "text", [r'"full_name"\s*:\s*"([^"]+)"']),
    ("biography", "text", [r'"biography"\s*:\s*"([^"]+)"']),
    ("is_private", "flag", [r'"is_private"\s*:\s*(true|false)']),
    ("is_verified", "flag", [r'"is_verified"\s*:\s*(true|false)']),
    ("is_business_account", "flag", [r'"is_business_account"\s*:\s*(true|false)']),
    ("is_professional_account", "flag", [r'"is_professional_account"\s*:\s*(true|false)']),
    ("business_email", "text", [r'"business_email"\s*:\s*"([^"]*)"']),
    ("business_phone_number", "text", [r'"business_phone_number"\s*:\s*"([^"]*)"']),
    ("business_category_name", "text", [r'"business_category_name"\s*:\s*"([^"]*)"']),
    ("followers", "whole", [r'"edge_followed_by"\s*:\s*\{\s*"count"\s*:\s*(\d+)', r'"followers"\s*:\s*(\d+)']),
    ("following", "whole", [r'"edge_follow"\s*:\s*\{\s*"count"\s*:\s*(\d+)', r'"following"\s*:\s*(\d+)']),
    ("posts", "whole", [r'"edge_owner_to_timeline_media"\s*:\s*\{\s*"count"\s*:\s*(\d+)', r'"posts"\s*:\s*(\d+)']),
    ("shortcode", "text", [r'"shortcode"\s*:\s*"([^"]+)"']),
    ("is_video", "flag", [r'"is_video"\s*:\s*(true|false)']),
    ("caption", "text", [r'"caption"\s*:\s*"([^"]+)"']),
    ("taken_at_timestamp", "whole", [r'"taken_at_timestamp"\s*:\s*(\d+)']),
    ("likes", "whole", [r'"edge_media_preview_like"\s*:\s*\{\s*"count"\s*:\s*(\d+)', r'"likes"\s*:\s*(\d+)']),
    ("comments", "whole", [r'"edge_media_to_comment"\s*:\s*\{\s*"count"\s*:\s*(\d+)', r'"comments"\s*:\s*(\d+)']),
    ("video_url", "text", [r'"video_url"\s*:\s*"([^"]+)"']),
    ("video_view_count", "whole", [r'"video_view_count"\s*:\s*(\d+)']),
    ("media_type", "text", [r'"media_type"\s*:\s*"([^"]+)"'])]

YOUTUBE_SCRIPT_FIELDS = [
    ("video_id", "text", [r'(?i)"videoId"\s*:\s*"([^"]+)"']),
    ("title", "text", [r'(?i)"title"\s*:\s*"([^"]+)"']),
    ("channel_name", "text", [r'(?i)"author"\s*:\s*"([^"]+)"']),
    ("channel_id", "text", [r'(?i)"channelId"\s*:\s*"([^"]+)"']),
    ("views", "whole", [r'(?i)"viewCount"\s*:\s*"?(\d+)"?']),
    ("duration", "whole", [r'(?i)"lengthSeconds"\s*:\s*"?(\d+)"?']),
    ("description", "text", [r'(?i)"shortDescription"\s*:\s*"([^"]*)"']),
    ("upload_date", "text", [r'(?i)"publishDate"\s*:\s*"([^"]+)"', r'(?i)"uploadDate"\s*:\s*"([^"]+)"']),
    ("subscribers", "text", [r'(?i)"subscriberCountText"\s*:\s*\{\s*"simpleText"\s*:\s*"([^"]+)"']),
    ("channel_url", "text", [r'(?i)"channelUrl"\s*:\s*"([^"]+)"']),
    ("likes", "whole", [r'(?i)"likes"\s*:\s*"?(\d+)"?']),
    ("dislikes", "whole", [r'(?i)"dislikes"\s*:\s*"?(\d+)"?']),
    ("keywords", "text", [r'(?i)"keywords"\s*:\s*\[([^\]]*)\]'])]

VIEW_PATTERNS = [r"(?i)([\d,]+)\s+views?", r"(?i)(\d+(?:\.\d+)?[KMB]?)\s+views?", r"(?i)views?\s*:\s*([\d,]+)"]
SUBSCRIBER_PATTERNS = [r"(?i)([\d.]+[KMB]?)\s+subscribers?", r"(?i)subscribers?\s*:\s*([\d.]+[KMB]?)",
                       r"(?i)([\d,]+)\s+subscribers?"]
UPLOAD_DATE_PATTERNS = [r"Published on (\w+ \d+, \d{4})", r"(\w+ \d+, \d{4})", r"(\d+ \w+ ago)",
                        r"Streamed (\w+ \d+, \d{4})"]

PLACEHOLDER_MARKS = r"(?i)class\s*=\s*[\"'][^\"']*\b(?:skeleton|placeholder|loading)\b|aria-busy\s*=\s*[\"']true[\"']"
SPA_MARKS = [r"(?i)\bid\s*=\s*[\"'](?:root|app)[\"']", r"(?i)\bdata-reactroot\s*=\s*[\"']true[\"']",
             r"(?i)\bng-version\s*=\s*[\"']true[\"']"]

CHALLENGE_PHRASES = ["cloudflare", "cf-browser-verification", "cf-challenge", "checking your browser", "ddos protection",
                     "cf-ray"]
FACEBOOK_LOGIN_PHRASES = ["log in to facebook", "sign up for facebook", "facebook helps you connect and share",
                          "you must log in to continue", "the page may have been removed"]
PAGE_CATEGORY_WORDS = ["artist", "musician", "brand", "product", "company", "organization", "public figure",
                       "community", "blog", "news", "shopping", "retail", "local business", "nonprofit organization",
                       "government organization", "education", "media", "sports", "entertainment"]
# --- end of fixed values --------------------------------------------------------------------------------------
