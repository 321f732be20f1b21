"""Fixed values for contact rules: patterns, word lists and host lists."""

# --- fixed values ---------------------------------------------------------------------------------------------
PHONE_PATTERNS = [r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
                  r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", r"\d{10,15}"]
PHONE_WORDS = ["phone", "call", "tel", "contact"]
MOBILE_WORDS = ["mobile", "cell", "direct"]
NAVIGATION_WORDS = ["dashboard", "sign in", "home", "menu", "navigation", "footer"]

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
EMAIL_WORDS = ["email", "contact", "reach"]
EMAIL_ROLES = [("info", ["info", "information"]), ("contact", ["contact", "hello", "hi"]),
               ("sales", ["sales", "business", "inquiries", "quote"]), ("support", ["support", "help", "service"]),
               ("admin", ["admin", "administrator"]), ("marketing", ["marketing", "promo", "newsletter"])]
SHARED_ROLES = ["info", "contact", "sales", "support"]

ADDRESS_PATTERNS = [
    r"(?i)\b\d+[-\s]+[A-Za-z0-9\s,.-]{10,}(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Place|Pl\.?)(?:\s*,?\s*[A-Za-z\s]+)?(?:\s*,?\s*\d{5}(?:-\d{4})?)?",
    r"(?i)P\.?O\.?\s*Box\s+\d+(?:\s*,?\s*[A-Za-z\s]+)?(?:\s*,?\s*\d{5}(?:-\d{4})?)?",
    r"(?i)\b\d+[A-Za-z]?\s+[A-Z][a-zA-Z\s]{5,30}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b"]
ADDRESS_STREET_WORDS = ["street", "avenue", "road", "boulevard"]
ADDRESS_REJECT_WORDS = ["dashboard", "sign in", "home", "about", "contact", "blog", "news", "course", "certification",
                        "students", "class", "participants"]
ADDRESS_SENTENCE_WORDS = ["he took", "when he", "you could", "here you"]

TEXT_URL = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+|[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?"
SKIPPED_HOSTS = ["example.com", "localhost", "fonts.googleapis.com", "cdnjs.cloudflare.com", "fonts.gstatic.com",
                 "ajax.googleapis.com", "code.jquery.com", "stackpath.bootstrapcdn.com", "unpkg.com", "cdn.jsdelivr.net"]
STORE_HOSTS = ["play.google.com", "apps.apple.com", "microsoft.com"]
BUSINESS_HOST_WORDS = ["course", "institute", "academy", "company", "corp", "inc", "ltd"]
SOCIAL_HOSTS = ["facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com", "tiktok.com",
                "pinterest.com", "snapchat.com", "whatsapp.com", "telegram.org", "discord.com"]
SOCIAL_NAMES = [("Facebook", ["facebook"]), ("Twitter", ["twitter"]), ("LinkedIn", ["linkedin"]),
                ("Instagram", ["instagram"]), ("YouTube", ["youtube"]), ("TikTok", ["tiktok"]),
                ("Pinterest", ["pinterest"]), ("Snapchat", ["snapchat"]), ("WhatsApp", ["whatsapp"]),
                ("Telegram", ["telegram"]), ("Discord", ["discord"])]

ASSET_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".css", ".js", ".ico", ".svg", ".webp"]
ASSET_WORDS = r"^\d|@2x|@3x|logo|icon|image|img|photo|pic|asset"
SAMPLE_DOMAINS = ["example.com", "test.com", "sample.com", "domain.com", "email.com"]
RISING_DIGITS = r"012|123|234|345|456|567|678|789"

SOURCE_EMAILS = [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
                 r"mailto:([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
                 r"email[\"']?\s*:\s*[\"']?([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"]
SOURCE_PHONES = [r"\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"tel:(\+?\d[\d\s\-\(\)]+)",
                 r"phone[\"']?\s*:\s*[\"']?(\+?\d[\d\s\-\(\)]+)", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"]
SOURCE_SITES = [r"https?://[-\w.]+(?:[:\d]+)?(?:/[\w/_.]*)?", r"www\.[-\w.]+(?:[:\d]+)?(?:/[\w/_.]*)?"]

NANP_REJECT = (r"^0+$|^1+$|^2+$|^123456|^987654|0{10}|1{10}|2{10}|3{10}|4{10}|5{10}|6{10}|7{10}|8{10}|9{10}|"
               r"^202\d{7}|^201\d{7}|^203\d{7}")

LEAD_EMAILS = [r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
               r"(?i)(?:info|sales|support|admin|contact)@\S+\.\S+"]
LEAD_PHONES = [r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{0,4}",
               r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
               r"tel:\s*(\+?\d[\d\s\-\(\)]+)", r"phone[\"']?\s*:\s*[\"']?(\+?\d[\d\s\-\(\)]+)",
               r"contact[\"']?\s*:\s*[\"']?(\+?\d[\d\s\-\(\)]+)", r"\b\d{10,11}\b",
               r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}"]
LEAD_SITES = r"https?://[-\w.]+(?:[:\d]+)?(?:/[\w/_.]*(?:\?[\w&=%.]*)?(?:#\w*)?)?"
LEAD_SOCIAL = [("instagram", r"instagram\.com/([^\s/]+)"), ("twitter", r"(?:twitter|x)\.com/([^\s/]+)"),
               ("facebook", r"facebook\.com/([^\s/]+)"), ("linkedin", r"linkedin\.com/(?:in|company)/([^\s/]+)"),
               ("youtube", r"youtube\.com/(?:user|c|channel)/([^\s/]+)"), ("tiktok", r"tiktok\.com/@([^\s/]+)")]

CAPTION_EMAIL = r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}"
CAPTION_PHONES = [r"(?<!\d)[6-9]\d{9}(?!\d)",
                  r"(?<!\d)\+?1[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(?!\d)",
                  r"(?<!\d)\+[1-9]\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}(?!\d)",
                  r"(?<!\d)(?:\+?[1-9]\d{0,3}[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}(?!\d)"]
# What every caption phone of ten digits or more holds.
CAPTION_DIGITS = r"[0-9](?:[-.\s()]{0,2}[0-9]){9}"
BIO_PHONE = r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"

# Platform, URL prefix and suffix of the rebuilt link, and the patterns that find the handle.
HANDLE_PATTERNS = [
    ("instagram", "https://www.instagram.com/", "/", [r"(?i)instagram\.com/([a-zA-Z0-9_.]+)/?", r"(?i)ig\.com/([a-zA-Z0-9_.]+)/?", r"(?i)instagr\.am/([a-zA-Z0-9_.]+)/?"]),
    ("twitter", "https://twitter.com/", "", [r"(?i)twitter\.com/([a-zA-Z0-9_]+)/?", r"(?i)x\.com/([a-zA-Z0-9_]+)/?"]),
    ("tiktok", "https://www.tiktok.com/@", "", [r"(?i)tiktok\.com/@([a-zA-Z0-9_.]+)/?", r"(?i)tiktok\.com/([a-zA-Z0-9_.]+)/?"]),
    ("facebook", "https://www.facebook.com/", "", [r"(?i)facebook\.com/([a-zA-Z0-9_.]+)/?", r"(?i)fb\.com/([a-zA-Z0-9_.]+)/?", r"(?i)fb\.me/([a-zA-Z0-9_.]+)/?"]),
    ("linkedin", "https://www.linkedin.com/in/", "", [r"(?i)linkedin\.com/in/([a-zA-Z0-9_.-]+)/?", r"(?i)linkedin\.com/company/([a-zA-Z0-9_.-]+)/?"]),
    ("snapchat", "https://www.snapchat.com/add/", "", [r"(?i)snapchat\.com/add/([a-zA-Z0-9_.]+)/?", r"(?i)snapchat\.com/([a-zA-Z0-9_.]+)/?"]),
    ("discord", "https://discord.gg/", "", [r"(?i)discord\.gg/([a-zA-Z0-9_.]+)/?", r"(?i)discord\.com/invite/([a-zA-Z0-9_.]+)/?"]),
    ("twitch", "https://www.twitch.tv/", "", [r"(?i)twitch\.tv/([a-zA-Z0-9_.]+)/?"]),
    ("email", "mailto:", "", [r"(?i)([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"])]

FACEBOOK_EMAIL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})?"
FACEBOOK_PHONE = (r"(?:(?:\+|00)\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{2,4})")
MISSING_WORDS = ["NA", "", "N/A"]
# --- end of fixed values --------------------------------------------------------------------------------------
