"""Fixed values for company, people, intent and topic rules.  Every table is a plain argument default: pass another
one to adapt an operator to a different market."""

# --- fixed values ---------------------------------------------------------------------------------------------
INDUSTRIES = {
    "education_services": ["career guidance", "career counseling", "career test", "psychometric test",
                           "educational counseling", "academic guidance", "student counseling", "career development",
                           "skill assessment", "aptitude test", "career planning"],
    "travel_agency": ["travel agency", "travel agent", "tour operator", "travel service"],
    "transportation": ["bus company", "transportation", "charter bus", "shuttle service"],
    "hospitality": ["hotel", "resort", "accommodation", "hospitality"],
    "event_planning": ["event planning", "event management", "wedding planner"],
    "education": ["school", "university", "college", "student", "education"],
    "corporate": ["corporate", "business", "company", "enterprise"],
    "nonprofit": ["nonprofit", "charity", "foundation", "ngo"],
    "government": ["government", "municipal", "city", "county", "state"],
    "healthcare": ["hospital", "medical", "healthcare", "clinic"],
    "sports": ["sports", "athletic", "team", "league"],
    "religious": ["church", "religious", "faith", "ministry"]}

SERVICES = {
    "group_travel": ["group travel", "group tour", "group trip"],
    "corporate_travel": ["corporate travel", "business travel"],
    "event_transportation": ["event transportation", "wedding transportation"],
    "sightseeing": ["sightseeing", "city tour", "guided tour"],
    "long_distance": ["long distance", "interstate", "cross country"],
    "local_transport": ["local transport", "city bus", "commuter"],
    "consulting": ["consulting", "advisory", "advice", "strategy"],
    "training": ["training", "workshop", "course", "bootcamp"],
    "software": ["software", "saas", "platform", "application", "cloud"],
    "marketing": ["marketing", "advertising", "seo", "branding", "promotion"],
    "ecommerce": ["shop", "store", "retail", "catalog", "ecommerce"],
    "finance": ["loan", "insurance", "investment", "mortgage", "credit"],
    "real_estate": ["property", "real estate", "broker", "realtor", "lease"],
    "event_services": ["event", "conference", "wedding", "seminar", "expo"],
    "healthcare": ["clinic", "hospital", "doctor", "pharmacy", "healthcare"]}

LARGE_WORDS = ["enterprise", "corporation", "nationwide", "international"]
COUNTED_WORDS = ["team of", "staff of", "employees"]
SMALL_WORDS = ["family owned", "local", "small business"]

TOPIC_WORDS = ["travel", "tour", "trip", "vacation", "holiday", "journey", "bus", "transport", "charter", "excursion",
               "sightseeing", "cruise", "flight", "hotel", "booking", "itinerary", "destination", "package",
               "group travel", "corporate travel"]

INTENTS = {
    "travel_planning": ["planning a trip", "arranging travel", "organizing tour", "planning to visit",
                        "looking for transport", "itinerary", "bus booking", "charter service", "hire a bus",
                        "reserve seats"],
    "purchase_intent": ["buy", "purchase", "order", "get started", "subscribe"],
    "quote_request": ["request a quote", "get a quote", "pricing", "estimate"],
    "demo_interest": ["demo", "trial", "schedule a demo", "free trial"],
    "service_inquiry": ["services", "solutions", "offerings", "learn more"],
    "job_hiring": ["hiring", "apply now", "careers", "recruiting"],
    "support_request": ["help", "support", "customer service", "issue", "complaint"],
    "corporate_travel": ["corporate tour", "office trip", "team outing", "company travel", "business delegation",
                         "staff transport"],
    "general_inquiry": ["need a quote", "request for quotation", "price inquiry", "availability", "details please"]}
INTENT_WEIGHTS = {"travel_planning": 0.9, "corporate_travel": 0.8, "group_travel": 0.85, "general_inquiry": 1.0,
                  "past_travel": 0.4}
HIGH_INTENT = ["booking", "quote", "inquiry", "planning", "event"]
MEDIUM_INTENT = ["travel", "tour", "trip", "group"]

AUTHORITY = [(1.0, ["ceo", "chief executive", "president", "owner", "founder", "principal"]),
             (0.9, ["director", "vp", "vice president", "chief", "head of"]),
             (0.7, ["manager", "head", "lead", "senior manager"]), (0.5, ["coordinator", "supervisor", "team lead"]),
             (0.3, ["specialist", "analyst", "consultant", "advisor"]),
             (0.6, ["counselor", "counsellor", "guidance", "dean", "professor"])]

TITLE_QUESTION_WORDS = ["what", "how", "which", "keeping", "mind"]
TITLE_DESCRIPTORS = (r"(?i)\b(?:career guidance|career counseling|education|courses|training|services|solutions|"
                     r"consulting|academy|institute|center|centre)\b")
COMPANY_SUFFIXES = ["inc", "llc", "ltd", "corp", "company", "co", "pvt"]
GENERIC_TITLES = ["home", "welcome", "index", "main", "page", ""]

NAME_EXCLUDED = [
    "plan", "test", "course", "management", "development", "science", "design", "arts", "communication", "business",
    "professional", "career", "skill", "index", "basic", "advance", "face", "mentorship", "ideal", "humanities",
    "commerce", "engineering", "online", "digital", "back", "end", "web", "explore", "colleges", "new", "zealand",
    "hong", "kong", "sign", "dashboard", "questions", "report", "taken", "answers", "post", "reply", "verified", "ask",
    "university", "hospital", "organization", "entrance", "exam", "parents", "psychometric", "knowledge", "base",
    "pricing", "guide", "profile", "certification", "community", "jobs", "exclusive", "interviews", "impact",
    "stories", "inspirational", "shipping", "industry", "state", "bank", "staff", "college", "hyderabad",
    "retirement", "suitable", "option", "keeping"]
NOT_PERSON_WORDS = [
    "industry", "indutry", "shipping", "transport", "college", "bank", "staff", "state", "government", "department",
    "organization", "company", "corporation", "institute", "academy", "university", "course", "class", "test", "exam",
    "certification", "degree", "bachelor", "master", "diploma", "science", "arts", "commerce", "option", "suitable",
    "keeping", "mind", "career", "guidance"]
NOT_TITLE_PHRASES = ["here you could", "when he took", "you could opt", "keeping this"]
NOT_TITLE = (r"^\|+$|^\s*$|^\d+\s*answers?$|^←>.*$|^\w{1,2}$|^(?:test|for|and|the|in|of|to|at|on|is|are|was|were)$")

# Repeats of words are possessive: Java walks those in a loop, others by recursion, which long runs of words overflow. The
# words between are grouped so that a run ends with a word of two letters, hence nothing has to be given back.
FULL_NAME = r"[A-Z][a-z]++(?:(?:\s++[A-Z](?![a-z]))*+\s++[A-Z][a-z]++)++"
TEAM_HTML = [
    r'(?is)<(?:section|div)[^>]*(?:class|id)="[^"]*(?:team|about|staff|management|founder|leadership)[^"]*"[^>]*>(.*?)</(?:section|div)>',
    r"(?is)<h[1-6][^>]*>(?:[^<]*(?:team|about|staff|management|founder|leadership)[^<]*)</h[1-6]>(.*?)(?=<h[1-6]|</(?:section|div|body)|$)",
    r'(?is)<(?:section|div)[^>]*(?:class|id)="[^"]*(?:bio|profile|member)[^"]*"[^>]*>(.*?)</(?:section|div)>']
TEAM_TEXT = [
    r"(?is)(?:about us|our team|meet the team|leadership|management|founded by|started by|owned by|directors?)[:\n](.*?)(?=\n\s*\n|\Z)",
    r"(?is)(?:founder|ceo|president|director|manager)[:\s]+(.*?)(?=\n\s*\n|\Z)"]
# Later starts in a run end where the first one does: the second branch takes a run without a title whole, with empty groups.
NAME_THEN_TITLE = r"\b(" + FULL_NAME + r")\s*[,\-–—:]\s*([^,\n\r.]{3,50}?)(?=\s*[,\n\r.]|$)|\b" + FULL_NAME
TITLE_THEN_NAME = r"\b([A-Z][^,\n\r:]{2,30}?)\s*[:\-–—]\s*(" + FULL_NAME + ")"
FOUNDED_BY = r"(?i)(?:founded|started|established|owned)\s+by\s+(" + FULL_NAME + ")"
# Up to the last word of two letters before an "is" with a title. Where a run of words has none, no later start in it has
# one either, so the other branches take a lone letter or the whole run, with empty groups.
_IS = r"\s++(?:is|was)(?=\s+(?:the\s+)?[a-z][^.]{2})"
NAME_IS_TITLE = (r"(?i)([a-z]{2,}+(?:(?:\s++(?![a-z]{2,}+" + _IS + r")[a-z]++)*+\s++[a-z]{2,}+(?=" + _IS + r"))++)"
                 r"\s+(?:is|was)\s+(?:the\s+)?([a-z][^.]{2,30})|[a-z](?![a-z])|[a-z]{2,}+(?:\s++[a-z]++)*+")

SECTION_WORDS = ["business", "company", "contact", "phone", "email", "address", "office", "location", "headquarters",
                 "branch", "about us", "team", "staff", "management", "director", "manager", "ceo", "founder", "owner",
                 "social media", "facebook", "twitter", "linkedin", "instagram", "website", "www", "http"]
SECTION_IRRELEVANT = [
    "privacy policy", "terms", "legal", "pricing", "menu", "help", "faq", "support", "services", "cookie", "disclaimer",
    "copyright", "navigation", "breadcrumb", "sidebar", "advertisement", "ads", "banner", "header menu", "footer menu",
    "social links", "search", "login", "register", "sign up", "sign in", "dashboard", "cart", "checkout", "payment",
    "shipping", "return policy", "refund", "warranty", "testimonial", "review", "blog", "news", "article",
    "press release", "media", "gallery", "portfolio", "case study", "white paper", "download", "resource"]
SECTION_VALUABLE = ["contact", "about", "team", "staff", "management", "leadership", "founder", "ceo", "director",
                    "office", "location", "address", "phone", "email", "headquarters", "branch", "business", "company",
                    "organization", "profile", "biography", "bio", "meet", "our team"]

STRUCTURED_ORG_TYPES = ["Organization", "LocalBusiness", "TravelAgency", "NewsMediaOrganization"]
STRUCTURED_TYPES = ["Organization", "LocalBusiness", "TravelAgency", "Person", "ContactPoint", "PostalAddress",
                    "Service", "Product", "NewsMediaOrganization", "Article"]
STRUCTURED_FIELDS = ["name", "legalName", "description", "telephone", "email", "address", "url", "sameAs",
                     "contactPoint", "member", "employee", "serviceType", "areaServed", "jobTitle", "foundingDate",
                     "headline", "articleBody", "keywords", "articleSection"]
STRUCTURED_NESTED = ["publisher", "author", "worksFor", "parentOrganization"]
STRUCTURED_NESTED_FIELDS = ["name", "legalName", "description", "url", "jobTitle", "sameAs", "@type"]

RELEVANCE_HIGH = ["travel_agency", "transportation", "event_planning"]
RELEVANCE_MEDIUM = ["education", "corporate", "nonprofit"]
RELEVANCE_LOW = ["hospitality", "sports", "religious"]
RELEVANT_SERVICES = ["group_travel", "charter_bus", "corporate_travel", "event_transportation"]
SIZE_HIGH = ["corporate", "education", "government"]
SIZE_LOW = ["nonprofit", "sports", "religious"]

# Topic gate: primary words count double, the others once.
GATE_PRIMARY = ["travel", "trip", "vacation", "holiday", "tourism", "tourist", "destination", "journey", "adventure",
                "explore", "visiting", "backpack", "backpacking", "nomad", "wanderlust", "getaway", "itinerary",
                "sightseeing", "excursion", "expedition"]
GATE_SECONDARY = [
    "hotel", "resort", "hostel", "accommodation", "booking", "flight", "airline", "airport", "passport", "visa",
    "beach", "mountain", "city break", "road trip", "cruise", "restaurant", "food tour", "local cuisine",
    "street food", "museum", "landmark", "attraction", "guide", "tour", "travel vlog", "budget travel",
    "luxury travel", "solo travel", "family travel", "culture", "heritage", "historic", "scenery", "landscape",
    "backpack"]
GATE_PLACES = ["paris", "tokyo", "london", "new york", "bali", "thailand", "italy", "spain", "greece", "japan",
               "india", "australia", "europe", "asia", "africa", "south america", "north america", "caribbean",
               "mediterranean", "scandinavia", "middle east", "national park", "world heritage", "unesco"]
GATE_ACTIVITIES = ["hiking", "trekking", "camping", "safari", "diving", "snorkeling", "skiing", "surfing", "climbing",
                   "photography", "festival", "pilgrimage", "volunteering", "study abroad", "gap year", "honeymoon",
                   "retreat", "spa", "wellness", "eco tourism"]
GATE_TRANSPORT = ["train", "bus", "car rental", "uber", "taxi", "metro", "transfer", "transportation"]

COMPANY_TEXT_WORDS = ["ltd", "limited", "inc", "incorporated", "corp", "corporation", "llc", "company", "co."]
# --- end of fixed values --------------------------------------------------------------------------------------
