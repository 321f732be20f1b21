"""Fixed values for URL rules: host lists, path rules and the source registry."""

# --- fixed values: platform hosts, in the order they are tested -----------------------------------------------
PLATFORM_HOSTS = [("instagram", ["instagram.com"]), ("facebook", ["facebook.com"]), ("reddit", ["reddit.com"]),
                  ("quora", ["quora.com"]), ("twitter", ["twitter.com", "x.com"]), ("linkedin", ["linkedin.com"]),
                  ("youtube", ["youtube.com"])]

DIRECTORY_HOSTS = [
    "thomasnet.com", "indiamart.com", "kompass.com", "yellowpages.com", "yelp.com", "crunchbase.com",
    "opencorporates.com", "manta.com", "dexknows.com", "superpages.com", "bizdir.com", "businessdirectory.com",
    "local.com", "bbb.org", "angieslist.com", "houzz.com", "thumbtack.com", "homeadvisor.com", "angi.com",
    "cylex.net", "tuugo.us", "hotfrog.com", "brownbook.net", "citysearch.com", "insiderpages.com",
    "showmelocal.com", "getthedata.co", "companycheck.co.uk", "duedil.com", "thesunbusinessdirectory.com",
    "yell.com", "touchlocal.com", "cylex-uk.co.uk", "ukindex.co.uk", "findopen.co.uk", "thesun.co.uk",
    "scotsman.com", "telegraph.co.uk", "independent.co.uk"]

BUCKETS = [("instagram", ["instagram.com"]), ("linkedin", ["linkedin.com"]), ("youtube", ["youtube.com", "youtu.be"]),
           ("facebook", ["facebook.com"]), ("company_directory", DIRECTORY_HOSTS)]

CONTACT_PLATFORMS = [("instagram", ["instagram.com"]), ("linkedin", ["linkedin.com"]),
                     ("facebook", ["facebook.com"]), ("twitter", ["twitter.com"])]

LINKEDIN_REJECTED_HOSTS = ["economicgraph", "careers", "news", "business", "help", "developer"]
LINKEDIN_REJECTED_PATHS = ["legal", "learning", "pulse", "jobs", "sales", "talent", "marketing",
                           "business/learning", "checkpoint", "authwall", "signup", "login", "start"]
LINKEDIN_ACCEPTED_PATHS = [r"in/[a-zA-Z0-9\-_%]+", r"company/[a-zA-Z0-9\-_%]+",
                           r"posts/[a-zA-Z0-9\-_%]+-activity-\d+-[a-zA-Z0-9]+", r"feed/update/urn:li:activity:\d+",
                           r"newsletters/[a-zA-Z0-9\-_%]+-\d+"]

FACEBOOK_SYSTEM_PATHS = [
    "friends", "messages", "bookmarks", "saved", "notifications", "settings", "help", "privacy", "terms", "login",
    "recover", "marketplace", "games", "gaming", "watch", "live", "stories", "search", "groups", "events",
    "findfriends", "developers", "business", "creators", "community", "gamingvideo", "jobs", "weather",
    "coronavirus", "news", "shops", "offers", "donations"]
FACEBOOK_PAGE_OG = ["website", "article", "business.business", "books.book", "music.song", "video.movie",
                    "video.tv_show", "video.episode"]

SKIPPED_URL_PARTS = [
    "google.com", "gstatic.com", "youtube.com", "maps.google", "policies.google", "support.google",
    "accounts.google", "webcache.googleusercontent.com", "facebook.com", "twitter.com", "x.com", "instagram.com",
    "linkedin.com", "tiktok.com", "reddit.com", "pinterest.com", "snapchat.com", "tumblr.com", "discord.com",
    "twitch.tv", "threads.net", "mastodon.social", "doubleclick.net", "adservice.google", "amazon.in",
    "flipkart.com", "ebay.", "aliexpress.", "wikipedia.org", "quora.com", "medium.com", "wordpress.com",
    "blogspot.com", "imdb.com", "spotify.com", "apple.com"]

COMPANY_URL_WORDS = ["company", "profile", "business", "supplier", "manufacturer", "firm", "corp", "ltd", "inc", "llc"]
COMPANY_URL_AVOID = [
    "search", "category", "tag", "page", "sort", "filter", "login", "register", "business.thomasnet.com",
    "thomasnet.com/ads", "thomasnet.com/news", "about", "contact", "privacy", "terms", "help", "support", "blog",
    "marketing", "advertising", "seo", "analytics", "sponsorship", "article", "news", "story", "press", "media",
    "event", "webinar"]
COMPANY_URL_SITES = [("thomasnet.com", ["/suppliers/", "/profile/", "/company/"]), ("indiamart.com", ["/proddetail/"]),
                     ("yellowpages.com", ["/business/"]), ("yelp.com", ["/biz/"]),
                     ("crunchbase.com", ["/organization/"]), ("opencorporates.com", ["/companies/"])]
THOMASNET_OWN = ["business.thomasnet.com", "thomasnet.com/ads", "thomasnet.com/news", "thomasnet.com/search.html",
                 "thomasnet.com/articles", "thomasnet.com/companyhistory"]
COMPANY_LINK_WORDS = ["company", "business", "supplier", "manufacturer", "firm", "corp", "ltd", "inc", "llc",
                      "services", "solutions", "group", "enterprises"]
COMPANY_LINK_INTERNAL = ["login", "register", "about", "contact", "privacy", "terms", "help", "search", "category"]

SEARCH_URL_MARKS = ["search", "find", "query", "q=", "keyword=", "ss="]
SEARCH_PAGE_WORDS = ["result", "company", "business", "supplier", "manufacturer", "listing", "search", "found", "matches"]
DIRECTORY_URL_WORDS = ["directory", "companies", "business", "suppliers"]
DIRECTORY_PAGE_WORDS = ["company", "business", "supplier", "manufacturer", "directory"]
PROFILE_URL_WORDS = ["profile", "company", "business", "supplier", "product"]
PROFILE_PAGE_WORDS = ["contact", "about", "services", "products", "phone", "email"]
LISTING_PAGE_WORDS = ["companies", "businesses", "suppliers", "manufacturers"]

SITE_KIND_DIRECTORY_WORDS = [
    "kompass", "thomasnet", "yellowpages", "yelp", "company directory", "business directory", "opencorporates",
    "corporate registry", "company search", "business search", "company database", "corporate database",
    "company information", "business information", "company register", "corporate register", "companies house",
    "sec filings"]
SITE_KIND_DIRECTORY_URLS = ["/search", "/directory", "/companies", "/businesses", "/corporations", "/opencorporates",
                            "opencorporates.com", "kompass.com", "thomasnet.com", "yellowpages.com", "yelp.com",
                            "crunchbase.com"]
SITE_KIND_SOCIAL = ["facebook.com", "linkedin.com", "twitter.com", "instagram.com"]
SITE_KIND_NEWS = ["published", "author", "byline", "article-content", "news-article"]
SITE_KIND_LISTING = ["listing", "business", "contact", "about us"]

DIRECTORY_SEARCH_PATHS = [("thomasnet.com", "/search.html?q="), ("indiamart.com", "/search.html?keyword="),
                          ("yellowpages.com", "/search?search_terms="), ("yelp.com", "/search?find_desc="),
                          ("crunchbase.com", "/search/organizations?query="), ("opencorporates.com", "/companies?q=")]
DIRECTORY_RESULT_SKIP = ["facebook.com", "twitter.com", "instagram.com", "youtube.com", "wikipedia.org", "amazon.com",
                         "ebay.com", "craigslist.org", "reddit.com", "pinterest.com", "tiktok.com", "snapchat.com"]
DIRECTORY_RESULT_WORDS = [
    "directory", "companies", "business", "suppliers", "manufacturers", "search", "yellowpages", "thomasnet",
    "indiamart", "kompass", "crunchbase", "opencorporates", "yelp", "bbb", "manta", "dexknows", "superpages",
    "angieslist", "houzz", "thumbtack", "homeadvisor", "angi", "cylex", "tuugo", "hotfrog", "brownbook",
    "citysearch", "insiderpages", "showmelocal"]
DIRECTORY_FALLBACK = [
    "https://www.thomasnet.com/", "https://www.indiamart.com/", "https://www.yellowpages.com/",
    "https://www.yelp.com/", "https://www.crunchbase.com/", "https://opencorporates.com/",
    "https://www.kompass.com/", "https://www.manta.com/", "https://www.dexknows.com/", "https://www.superpages.com/"]

# Source registry: name, URL type it takes, search filter added to a base query, description.
SOURCES = [
    ("web_scraper", "general", "", "General web scraping for websites"),
    ("company_directory", "company_directory",
     "site:thomasnet.com OR site:indiamart.com OR site:kompass.com OR site:yellowpages.com OR site:yelp.com OR "
     "site:crunchbase.com OR site:opencorporates.com OR site:manta.com OR site:dexknows.com OR site:superpages.com ",
     "Business directory websites (ThomasNet, IndiaMart, YellowPages, etc.)"),
    ("instagram", "instagram", "site:instagram.com (site:instagram.com/p OR site:instagram.com/reel OR "
     "site:instagram.com/*) ", "Instagram profiles and posts"),
    ("linkedin", "linkedin", "site:linkedin.com (site:linkedin.com/in OR site:linkedin.com/company OR "
     "site:linkedin.com/posts OR site:linkedin.com/newsletters) ", "LinkedIn profiles and companies"),
    ("youtube", "youtube", "site:youtube.com (site:youtube.com/@ OR site:youtube.com/channel) ",
     "YouTube channels and videos"),
    ("facebook", "facebook", "site:facebook.com (site:facebook.com/profile.php OR site:facebook.com/pages OR "
     "site:facebook.com/groups OR site:facebook.com/events) ", "Facebook profiles, pages, and posts"),
    ("twitter", "twitter", "site:twitter.com OR site:x.com ", "Twitter/X profiles and posts"),
    ("reddit", "reddit", "site:reddit.com (site:reddit.com/r/ OR site:reddit.com/user/) ",
     "Reddit posts and user profiles"),
    ("quora", "quora", "site:quora.com ", "Quora profiles and answers")]

# Rows handed to each source per run.
QUOTAS = {"general": 5, "instagram": 5, "linkedin": 5, "twitter": 5, "quora": 5, "youtube": 5, "facebook": 3}

# Query templates per platform; {persona}, {industry} and {region} are replaced, with the default after the bar.
QUERY_TEMPLATES = {
    "linkedin": [
        'intitle:"{persona|marketing director}" "{industry|SaaS}" {region|India} site:linkedin.com/in',
        '("{persona|travel manager}" OR "event coordinator") "group travel" {region|India} site:linkedin.com/company',
        'intitle:"operations head" "corporate travel" {region|India} site:linkedin.com/in'],
    "instagram": [
        '("{persona|club organizer}" OR "sports team manager") "team travel" {region|India} site:instagram.com',
        'intitle:"travel agency" (corporate OR group) {region|India} site:instagram.com',
        '("wedding planner" OR "event manager") "guest transport" {region|India} site:instagram.com'],
    "youtube": [
        'intitle:"corporate travel" {region|India} site:youtube.com/@',
        '("travel agency" OR "tour operator") "group travel" {region|India} site:youtube.com/channel',
        'intitle:"team travel" {region|India} site:youtube.com'],
    "web_scraper": [
        'intitle:"travel agency" (corporate OR group) {region|India} -site:instagram.com -site:linkedin.com -site:youtube.com',
        '("bus charter" OR "coach hire") {region|India} (corporate OR wedding) -site:instagram.com -site:linkedin.com -site:youtube.com',
        'intitle:"tour operator" "group travel" {region|India} -site:instagram.com -site:linkedin.com -site:youtube.com']}
# --- end of fixed values --------------------------------------------------------------------------------------

URL_SHAPE = (r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
             r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
LINKEDIN_REJECT = (
    r"(?i)^https://(?:(?:" + "|".join(LINKEDIN_REJECTED_HOSTS) + r")\.linkedin\.com/|.*\.linkedin\.com/(?:"
    + "|".join(LINKEDIN_REJECTED_PATHS) + r")/|.*\.linkedin\.com/(?:home|feed)/?$|.*\.linkedin\.com/?$)")
LINKEDIN_ACCEPT = r"(?i)^https://(?:www|[a-z]{2})\.linkedin\.com/(?:" + "|".join(LINKEDIN_ACCEPTED_PATHS) + r")/?(\?.*)?$"
FACEBOOK_SYSTEM = r"facebook\.com/(?:" + "|".join(FACEBOOK_SYSTEM_PATHS) + r")/?$"
