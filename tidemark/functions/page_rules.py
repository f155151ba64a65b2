"""Fixed values of the categories that read the element tree or a match's surroundings."""

from __future__ import annotations

# --- emails: fixed values -----
CLOUDFLARE_EMAIL = r'data-cfemail\s*=\s*"([0-9a-fA-F]{8,})"'
OBFUSCATED_EMAIL = r"(?i)([A-Za-z0-9._%+\-]{2,})\s*[\[\(\{]\s*(?:at|@)\s*[\]\)\}]\s*([A-Za-z0-9.\-]+?)\s*[\[\(\{]\s*(?:dot|\.)\s*[\]\)\}]\s*([A-Za-z]{2,})"
CONCAT_EMAIL = r'"([A-Za-z0-9._%+\-]+)"\s*\+\s*"@"\s*\+\s*"([A-Za-z0-9.\-]+\.[A-Za-z]{2,})"'
#: Stands in every obfuscated address.
OBFUSCATED_AT = r"[\[\(\{]\s*(?:[aA][tT]|@)\s*[\]\)\}]"
OBFUSCATED_TLDS = frozenset(("com", "org", "net", "io", "co", "ai", "app", "dev", "fr", "de", "es", "it", "uk", "us", "ca", "eu", "gov", "edu", "mil", "info", "biz", "me", "tv", "cc", "be", "nl", "pl", "pt", "se", "no", "fi", "dk", "ch", "at", "cz", "ro", "jp", "cn", "kr", "in", "br", "mx", "ar", "au", "nz", "tech", "cloud", "xyz", "site", "online", "store", "shop"))

# --- phones: fixed values -----
PHONE = r"(?<![.\d/@])(?:\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?(?:[\s\-.]?\d{2,5}){1,4}|\(\d{2,4}\)[\s\-.]?\d{2,4}(?:[\s\-.]?\d{2,4})+|\d{2,4}[\s\-.]\d{2,4}(?:[\s\-.]?\d{2,4})+)(?![\d.])"
PHONE_REJECT = (r"^\d{4}[-/.]\d{2}[-/.]\d{2}$", r"^(19|20)\d{6}$", r"^\d{1,3}\.\d{1,3}\.\d{1,3}", r"^\d+\.\d+\.\d+", r"^\d{7,}$", r"^\d+px", r"\d+\.\d{3,}", r"\d[\s,]*000", r"^20\d{2}[-/]\d{3,}$")
PHONE_CONTEXT = r"(?i)(?:phone|tel(?:ephone)?|t[ée]l(?:[ée]phone)?|fax|call|mobile|whatsapp|viber|contact|hotline|numero|num[ée]ro|joindre|appeler|ligne|accueil|standard|nous\s+(?:joindre|appeler|contacter)|\bau\s*:?\s*$)"
PHONE_ATTRIBUTES = ("data-phone", "data-tel", "data-telephone", "data-mobile")
PHONE_JSON = r"(?i)[\"'](?:telephone|phone|phonenumber|tel|mobile)[\"']\s*:\s*[\"']([^\"']{6,40})[\"']"
FRENCH_PHONE = r"(?:\+?33|0)[1-79]\d{8}"

# --- hosts, paths, links: fixed values -----
HOST_ATTRIBUTES = (("a", "href"), ("img", "src"), ("script", "src"), ("link", "href"), ("iframe", "src"), ("source", "src"), ("video", "src"), ("audio", "src"), ("embed", "src"), ("object", "data"), ("form", "action"))
JSONLD_URL_KEYS = frozenset(("url", "sameas", "@id", "logo", "image", "thumbnailurl", "contenturl"))
HINT_RELS = frozenset(("dns-prefetch", "preconnect", "preload", "prerender"))
HOST_HEADERS = ("content-security-policy", "content-security-policy-report-only", "access-control-allow-origin", "permissions-policy", "feature-policy", "link", "via")
NO_URL = ("#", "mailto:", "tel:", "javascript:", "data:", "blob:")
ENDPOINT_ALLOWED_PARTS = ("/wp-json/", "/api/", "/rest/", "/graphql", "/v1/", "/v2/", "/v3/", "/oauth", "/.well-known/")
ENDPOINT_ALLOWED = frozenset(("/admin", "/login", "/logout", "/signin", "/signup", "/register", "/auth", "/account", "/dashboard", "/profile"))
ENDPOINT_ALLOWED_STARTS = ("/admin/", "/login/", "/auth/", "/signin/", "/signup/", "/account/", "/dashboard/", "/profile/")
ENDPOINT_DROPPED = frozenset(("/favicon.ico", "/robots.txt", "/sitemap.xml", "/sitemap_index.xml", "/apple-touch-icon.png", "/apple-touch-icon-precomposed.png"))
ENDPOINT_SKIPPED = r"(?i)\.(?:png|jpe?g|gif|svg|webp|bmp|ico|woff2?|ttf|otf|eot|map)(?:\?|$)"
ENDPOINT_ATTRIBUTES = ("data-url", "data-endpoint", "data-api", "data-href", "data-action", "data-src", "hx-get", "hx-post", "hx-put", "hx-delete", "hx-patch", "ng-href", "formaction")
INLINE_PATH = r"[\"'`](/[A-Za-z0-9_\-./]{1,200}(?:\?[^\"'`\s]{0,200})?)[\"'`]"
DATE_FORMAT = r"[YMDHhmsSAaZz][YMDHhmsSAaZz:.\-\s]*"
ASSET_TYPES = {"stylesheet": (".css", ".scss", ".less"), "script": (".js", ".mjs", ".cjs", ".map"), "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".svg", ".bmp", ".tiff"), "font": (".woff", ".woff2", ".ttf", ".otf", ".eot"), "video": (".mp4", ".webm", ".mov"), "audio": (".mp3", ".ogg", ".wav", ".flac"), "archive": (".zip", ".tar", ".gz", ".rar", ".7z")}
ASSET_SUBTREES = ("/wp-content/cache/", "/wp-content/plugins/", "/wp-content/themes/", "/wp-content/uploads/", "/wp-includes/", "/node_modules/", "/_next/static/", "/__nuxt/", "/assets/", "/static/", "/dist/", "/vendor/", "/build/", "/bundles/", "/min/")
DOCUMENT = r"(?i)\.(pdf|doc|docx|xls|xlsx|csv|ppt|pptx|txt|rtf|odt|ods|epub)$"
SOCIAL_HOSTS = {"twitter.com": "twitter", "x.com": "x", "linkedin.com": "linkedin", "facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "youtube.com": "youtube", "youtu.be": "youtube", "github.com": "github", "tiktok.com": "tiktok", "snapchat.com": "snapchat", "telegram.org": "telegram", "t.me": "telegram", "discord.gg": "discord", "discord.com": "discord", "reddit.com": "reddit", "mastodon.social": "mastodon", "mastodon.online": "mastodon", "threads.net": "threads", "pinterest.com": "pinterest", "tumblr.com": "tumblr", "vimeo.com": "vimeo", "twitch.tv": "twitch", "medium.com": "medium"}
ARCHIVE_HOSTS = ("web.archive.org", "archive.org")
PARKING_HOSTS = ("sedo.com", "sedoparking.com", "parkingcrew.net", "bodis.com", "dan.com", "afternic.com", "uniregistry.com", "hugedomains.com")
INTENTS = ("/share?", "/share/", "/sharer", "/sharer.php", "/intent/", "/intent?", "/dialog/", "/dialog?", "/submit?", "/submit/", "/plus.google.com/+", "plus.google.com/share", "/widgets.js", "/platform.js", "op=share", "/app/plus/x?v=compose", "/app/plus/x/?v=compose", "v=compose", "pinterest.com/pin/create", "addtoany.com/share", "addthis.com/bookmark")
IFRAME_SERVICES = (("youtube.com", "youtube"), ("youtube-nocookie.com", "youtube"), ("youtu.be", "youtube"), ("vimeo.com", "vimeo"), ("google.com", "google_maps"), ("maps.google.com", "google_maps"), ("docs.google.com", "google_docs"), ("calendly.com", "calendly"), ("typeform.com", "typeform"), ("hubspot.com", "hubspot"), ("intercom.io", "intercom"), ("spotify.com", "spotify"), ("soundcloud.com", "soundcloud"), ("twitter.com", "twitter"), ("platform.twitter.com", "twitter"))
IFRAME_SKIPPED = ("doubleclick.net", "googlesyndication.com", "pagead2.googlesyndication.com", "amazon-adsystem.com", "web.archive.org")
JS_URL = r"https?://[^\s\"'`<>)\]},;]{15,500}"
JS_ASSIGNMENT = r"(?i)(?:apiUrl|api_url|baseUrl|base_url|API_URL|BASE_URL|API_BASE|api_base|endpoint|apiEndpoint|api_endpoint|serverUrl|server_url)\s*[:=]\s*[\"'`](https?://[^\s\"'`<>]+)[\"'`]"
JS_SKIPPED = ("cdnjs.cloudflare.com", "cdn.jsdelivr.net", "unpkg.com", "fonts.googleapis.com", "fonts.gstatic.com", "google-analytics.com", "googletagmanager.com", "googlesyndication.com", "googleadservices.com", "facebook.net", "connect.facebook.net", "hotjar.com", "mixpanel.com", "segment.com", "web.archive.org", "archive.org", "schema.org", "w3.org")
FEED = r"(?i)https?://[^\s\"'<>]+?(?:/feed\.xml|/rss\.xml|/atom\.xml|/index\.xml|/feeds/posts/default(?:/?-/[^\s\"'<>]+)?(?:\?[^\s\"'<>]*)?|/feed/rss2/?|/feed/atom/?|/feed/?|/rss/?|\?feed=(?:rss2?|atom|rdf)(?:&[^\s\"'<>]*)?)(?=[\s\"'<>]|$)"
STYLESHEET_LINK = r"(?i)<link\b[^>]*\brel\s*=\s*['\"]?stylesheet['\"]?[^>]*>"
SITE_FILES = ((r"/sitemap_index\.xml\b", "sitemap"), (r"/sitemap\.xml\b", "sitemap"), (r"/sitemap[a-z0-9_\-]*\.xml\b", "sitemap"), (r"/robots\.txt\b", "robots"), (r"/humans\.txt\b", "humans"), (r"/\.well-known/security\.txt\b", "security"), (r"/security\.txt\b", "security"), (r"/ads\.txt\b", "ads"), (r"/app-ads\.txt\b", "ads"))
SITE_URL = r"(?:https?://[^\s\"'<>]+|/[A-Za-z0-9._/\-]+)"
ICON_RELS = frozenset(("icon", "shortcut icon", "alternate icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon", "fluid-icon", "manifest"))
LOGO_HINT = r"(?i)(?:logo|icon|favicon|brand|wordmark)"

# --- technologies, people, organisations: fixed values -----
TECH_ALIASES = {"wp": "WordPress", "wordpress.org": "WordPress", "wordpress.com": "WordPress", "joomla!": "Joomla"}
TECH_COMMENT = r"(?i)<!--\s*(WordPress|Joomla|Drupal|Typo3|Magento)[\s\d.]*-->"
CMS_MARKS = {"wp-content": "WordPress", "wp-includes": "WordPress", "drupal": "Drupal", "joomla": "Joomla"}
SCRIPT_TECHNOLOGIES = (
    ("jQuery", r"jquery[.\-/]"), ("React", r"react(?:\.min)?\.js|react-dom"), ("Angular", r"angular(?:\.min)?\.js|angular\.io"), ("Vue.js", r"\bvue(?:\.min)?\.js|vuejs\.org"), ("Svelte", r"[/@]svelte[@/.]|\bsvelte\.dev\b"),
    ("Next.js", r"_next/static|__next"), ("Nuxt", r"_nuxt/"), ("Remix", r"/build/_shared/|__remixContext"), ("Gatsby", r"/page-data/[^\"']+/page-data\.json|gatsby-chunk"), ("Astro", r"/_astro/|astro-island"),
    ("Bootstrap", r"bootstrap(?:\.min)?\.(?:js|css)"), ("Tailwind", r"tailwindcss|tailwind\.min\.css"), ("Font Awesome", r"font-awesome|fontawesome"), ("Lodash", r"lodash(?:\.min)?\.js"), ("D3.js", r"\bd3(?:\.min)?\.js|d3js\.org"), ("Moment.js", r"moment(?:\.min)?\.js"),
    ("Google Fonts", r"fonts\.googleapis\.com"), ("Cloudflare cdnjs", r"cdnjs\.cloudflare\.com"), ("Unpkg", r"unpkg\.com"), ("jsDelivr", r"cdn\.jsdelivr\.net"), ("Sentry", r"@sentry/|browser\.sentry-cdn\.com|sentry-trace"), ("LogRocket", r"cdn\.lr-(?:ingest|in|intake)|logrocket"),
    ("Datadog RUM", r"datadog(?:hq)?-browser-(?:agent|logs|rum)"), ("New Relic", r"js-agent\.newrelic\.com|nr-data\.net"), ("Segment", r"cdn\.segment\.com/analytics\.js"), ("PostHog", r"posthog(?:-js|\.com/static)"), ("Amplitude", r"cdn\.amplitude\.com|amplitude-js"),
    ("FullStory", r"fullstory\.com/s/fs\.js|edge\.fullstory\.com"), ("Plausible", r"plausible\.io/js/"), ("Matomo", r"matomo\.(?:js|php)|piwik\.(?:js|php)"), ("Stripe.js", r"js\.stripe\.com/v\d"), ("PayPal SDK", r"paypal\.com/sdk/js|paypalobjects\.com"),
    ("Intercom", r"widget\.intercom\.io|js\.intercomcdn\.com"), ("Zendesk Widget", r"static\.zdassets\.com|ekr\.zdassets\.com"), ("Drift", r"js\.driftt\.com|widget\.drift\.com"), ("HubSpot", r"js\.hs-scripts\.com|js\.hsforms\.net|js\.hubspot\.com"), ("Auth0", r"cdn\.auth0\.com|auth0-spa-js"),
    ("Okta", r"okta-(?:signin|auth)-js|\.okta\.com/"), ("Optimizely", r"cdn\.optimizely\.com"), ("LaunchDarkly", r"launchdarkly(?:-js-client-sdk|\.com/sdk)"), ("Algolia", r"algoliasearch|@algolia/"), ("Tealium", r"tags\.tiqcdn\.com"), ("Contentful", r"cdn\.contentful\.com|images\.ctfassets\.net"),
    ("Sanity", r"cdn\.sanity\.io|@sanity/client"), ("Webflow", r"assets\.website-files\.com|webflow\.com/(?:css|js)"), ("Framer", r"framerusercontent\.com|framer\.com/m/"),
)
PERSON_EXCLUDED = frozenset(("admin", "administrator", "author", "anonymous", "unknown", "undeveloped", "editor", "moderator", "root", "webmaster", "guest", "bot", "system", "staff", "team", "support", "default", "test", "null", "none"))
PERSON_TOOLS = frozenset(("yoast seo", "yoast", "rank math", "all in one seo", "wordpress", "elementor", "wpbakery", "wp engine", "jetpack", "squarespace", "wix", "shopify", "google", "site admin", "admin user", "wp admin"))
BYLINE = r"(?i)^\s*(?:by|par|von|door|av|written by|posted by)\s*[:\-]?\s+"
NAME_TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'.\-]{0,29}"
PERSON_LEAVES = (("author", ("a", "span", "cite", "b", "strong", "em")), ("byline", ("a", "span", "cite")), ("writer", ("a", "span")))
ORGANIZATION_TYPES = frozenset(("Organization", "LocalBusiness", "Corporation", "EducationalOrganization", "CollegeOrUniversity", "School", "ElementarySchool", "HighSchool", "MiddleSchool", "Preschool", "GovernmentOrganization", "NGO", "PoliticalParty", "ResearchOrganization", "NewsMediaOrganization", "Library", "MedicalOrganization", "Hospital", "Pharmacy", "SportsOrganization", "SportsTeam", "MusicGroup", "PerformingGroup", "TheaterGroup", "DanceGroup", "Restaurant", "Hotel", "Store", "ShoppingCenter"))
VERIFICATION = {"google-site-verification": "google", "msvalidate.01": "bing", "facebook-domain-verification": "facebook", "p:domain_verify": "pinterest", "yandex-verification": "yandex", "baidu-site-verification": "baidu", "norton-safeweb-site-verification": "norton", "alexaverifyid": "alexa", "linkedin-site-verification": "linkedin", "shopify-checkout-api-token": "shopify", "wot-verification": "wot", "ahrefs-site-verification": "ahrefs", "semrush-verification": "semrush", "zoominfo-verification": "zoominfo", "mailru-domain": "mailru", "naver-site-verification": "naver"}
VERIFICATION_PLACEHOLDER = r"(?i)^[Xx]+$|^your[_-]|^insert[_-]|^replace[_-]|^example"
FIELD_NOISE = frozenset(("__VIEWSTATE", "__EVENTVALIDATION", "__REQUESTVERIFICATIONTOKEN", "__VIEWSTATEGENERATOR", "__PREVIOUSPAGE", "__EVENTARGUMENT", "__EVENTTARGET", "utf8", "__REQUESTDIGEST"))
#: Meta properties: (names, key prefix, characters in the key or None for all, characters kept).
META = ((("og:site_name",), "site_name", None, None), (("og:title",), "og_title", 80, 300), (("og:type",), "og_type", None, 120), (("og:url",), "og_url", None, 300), (("description", "og:description", "twitter:description"), "desc", 80, 500), (("keywords",), "keywords", 80, 500), (("twitter:card",), "twitter_card", None, 80), (("twitter:site",), "twitter_site", None, 80), (("twitter:creator",), "twitter_creator", None, 80), (("author",), "author", 80, 200), (("generator",), "generator", 80, 200), (("viewport",), "viewport", 80, 200), (("robots",), "robots", 80, 200))

# --- addresses in text: fixed values -----
INTERNAL_IP = r"(?<![.\d])(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3}|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3})(?!\.\d)"
IP_DOCUMENTATION = r"(?i)\b(?:rfc\s?1918|rfc1918|rfc\s?5737|rfc\s?6598|reserved\s+for|private[-\s]use(?:\s+network)?s?|address\s+space|addressing\s+plan|special[-\s]purpose|documentation\s+(?:purpose|range|prefix|example)|example\s+(?:network|address|range|ip)|/8\s+reserved|/12\s+reserved|/16\s+reserved|through\s+(?:to\s+)?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|begins?\s+with\s+<?strong>?\d{1,3}\.?)\b"
IP_VERSION = r"(?i)(?:version|release|build|rev(?:ision)?|firmware|kernel|update|upgrade|changelog|\bv)\s*$"
COINS = (
    ("btc", r"(?<![A-Za-z0-9])[13][a-km-zA-HJ-NP-Z1-9]{25,34}(?![A-Za-z0-9])", "base58check", (0x00, 0x05)),
    ("btc", r"(?i)(?<![A-Za-z0-9])bc1[ac-hj-np-z02-9]{6,87}(?![A-Za-z0-9])", "bech32", "bc"),
    ("ltc", r"(?<![A-Za-z0-9])[LM3][a-km-zA-HJ-NP-Z1-9]{25,34}(?![A-Za-z0-9])", "base58check", (0x30, 0x32, 0x05)),
    ("ltc", r"(?i)(?<![A-Za-z0-9])ltc1[ac-hj-np-z02-9]{6,87}(?![A-Za-z0-9])", "bech32", "ltc"),
    ("doge", r"(?<![A-Za-z0-9])D[5-9A-HJ-NP-U][a-km-zA-HJ-NP-Z1-9]{32}(?![A-Za-z0-9])", "base58check", (0x1E,)),
    ("trx", r"(?<![A-Za-z0-9])T[a-km-zA-HJ-NP-Z1-9]{33}(?![A-Za-z0-9])", "base58check", (0x41,)),
    ("xrp", r"(?<![A-Za-z0-9])r[rpshnaf39wBUDNEGHJKLM4PQRST7VWXYZ2bcdeCg65jkm8oFqi1tuvAxyz]{24,34}(?![A-Za-z0-9])", "ripple", (0x00,)),
    ("xmr", r"(?<![A-Za-z0-9])4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}(?![A-Za-z0-9])", "length", ("monero", "xmr", "wownero", "getmonero")),
    ("sol", r"(?<![A-Za-z0-9])[1-9A-HJ-NP-Za-km-z]{32,44}(?![A-Za-z0-9])", "length", ("solana", "sol ", "spl ", "spl-", "phantom", "solscan", "@solana")),
)
ETHEREUM = r"(?<![A-Za-z0-9])0x[0-9a-fA-F]{40}(?![0-9a-fA-F])"
COIN_BLOCKED = ("sha256", "sha-256", "sha1", "sha-1", "sha512", "md5", "nonce", "hash", "digest", "uuid", "guid", "etag", "commit", "checksum", "id=", "data-", "sessionid", "csrf", "xsrf", "_token")
SIREN = r"(?<![\d])\d{3}([ .]?)\d{3}\1\d{3}(?![\d])"
SIRET = r"(?<![\d])\d{3}([ .]?)\d{3}\1\d{3}\1\d{5}(?![\d])"
TVA = r"\bFR[ ]?[0-9A-HJ-NP-Z]{2}[ .]?\d{3}[ .]?\d{3}[ .]?\d{3}\b"
RCS = r"(?i)\bRCS\s+([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ\-]{1,40}(?:\s[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ\-]{1,40}){0,3})\s+(?:[AB]\s+)?(\d{3}[ .]?\d{3}[ .]?\d{3})\b"
QUALIOPI = r"(?<![A-Za-z0-9])(\d{2})FOR(\d{5})(?:\.(\d+))?(?![A-Za-z0-9])"
RNCP = ((r"(?i)\bRNCP[\s\-]?(\d{4,6})\b", False), (r"(?i)francecompetences\.fr/(?:[a-z\-/]+/)?rncp/?(\d{4,6})\b", True))
FRENCH_CONTEXT = r"(?i)\b(?:siren|siret|kbis|insee|pappers|infogreffe|qualiopi|tva\s+intra(?:communautaire)?|rcs\s+[a-zà-ÿ]|num[ée]ro\s+(?:de\s+)?si(?:ren|ret|rene)t?|raison\s+sociale|si[èe]ge\s+social|immatricul(?:e|é|ée|ation)|micro[\s\-]?entrepreneur|auto[\s\-]?entrepreneur)\b"
#: One of these, case folded, stands wherever the pattern above matches.
FRENCH_WORDS = ("siren", "siret", "kbis", "insee", "pappers", "infogreffe", "qualiopi", "tva", "rcs", "raison", "social", "immatricul", "entrepreneur")
PGP_BLOCK = r"(?s)-----BEGIN PGP (PUBLIC|PRIVATE) KEY BLOCK-----(.*?)-----END PGP \1 KEY BLOCK-----"
PGP_FINGERPRINTS = (r"(?<![A-Fa-f0-9])(?:[A-Fa-f0-9]{4}[ \t ]+){9}[A-Fa-f0-9]{4}(?![A-Fa-f0-9])", r"(?<![A-Fa-f0-9])(?:[A-Fa-f0-9]{8}[ \t ]+){4}[A-Fa-f0-9]{8}(?![A-Fa-f0-9])", r"(?<![A-Fa-f0-9])[A-Fa-f0-9]{40}(?![A-Fa-f0-9])")
PGP_KEY_ID = r"0x([A-Fa-f0-9]{16}|[A-Fa-f0-9]{8})(?![A-Fa-f0-9])"
PGP_SERVER = r"(?i)https?://(?:[a-z0-9.\-]*\.)?(?:keys\.openpgp\.org|pgp\.mit\.edu|keyserver\.ubuntu\.com|keys\.gnupg\.net|pgp\.surf(?:net)?\.nl|sks-keyservers\.net|pgpkeys\.eu|keys\.mailvelope\.com)[^\s\"'<>]*|https?://[^\s\"'<>]*/pks/lookup[^\s\"'<>]*"
KEYBASE = r"(?i)keybase\.io/([a-z0-9_]{2,40})"
KEYBASE_RESERVED = frozenset(("docs", "blog", "legal", "privacy", "about", "download", "popular-teams", "pricing", "_", "team", "kb"))
PGP_WORDS = ("pgp", "gpg", "openpgp", "gnupg", "fingerprint", "keyid", "key id", "public key", "keyserver", "keybase")
PGP_OTHER = ("sha", "commit", "git ", " git", "checksum", "integrity", "digest", "etag", "subresource", "sri-", "content-hash", "blob")

# --- captchas, headers: fixed values -----
UUID = r"(?i)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b"
#: Captcha keys in order: (provider, pattern, group, word needed in the 80 characters before).
CAPTCHA_KEYS = (("recaptcha", r"\b6L[A-Za-z0-9_\-]{38}\b", 0, None), ("turnstile", r"\b0x4AAAAAAA[A-Za-z0-9_\-]{14,30}\b", 0, None), ("hcaptcha", UUID, 0, r"(?i)h[-_]?captcha"), ("arkose", r"(?i)arkoselabs\.com/v2/([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})/", 1, None), ("geetest", r"(?i)\b[a-f0-9]{32}\b", 0, r"(?i)geetest|initgeetest|\bgt\b"), ("friendly_captcha", r"\bFC[A-Z0-9]{10,30}\b", 0, r"(?i)friendly\s*captcha|friendlycaptcha|frc-captcha"))
CAPTCHA_SCRIPTS = (("recaptcha", r"(?i)https?://(?:www\.)?google\.com/recaptcha/(?:api|enterprise)\.js"), ("hcaptcha", r"(?i)https?://(?:js|api)\.hcaptcha\.com/1/api\.js"), ("turnstile", r"(?i)https?://challenges\.cloudflare\.com/turnstile/v0/api\.js"), ("recaptcha-enterprise", r"(?i)https?://(?:www\.)?google\.com/recaptcha/enterprise/"), ("arkose", r"(?i)\b(?:[a-z0-9.\-]+\.)?arkoselabs\.com/|\bfuncaptcha\.com/"), ("geetest", r"(?i)\b(?:static|api|gcaptcha4)\.geetest\.com/"), ("aws_waf", r"(?i)\b[a-z0-9.\-]+\.(?:token|captcha)\.awswaf\.com/"), ("friendly_captcha", r"(?i)\bfriendlycaptcha\.com/|\bfriendly-challenge\b"))
TRACKED_HEADERS = (("server", "server", 200), ("x-powered-by", "x_powered_by", 200), ("x-aspnet-version", "aspnet_version", 80), ("x-aspnetmvc-version", "aspnetmvc_version", 80), ("x-generator", "generator_hdr", 200), ("strict-transport-security", "hsts", 200), ("content-security-policy", "csp", 500), ("content-security-policy-report-only", "csp_ro", 500), ("x-frame-options", "x_frame", 80), ("x-content-type-options", "x_content_type", 80), ("x-xss-protection", "x_xss", 120), ("referrer-policy", "referrer", 120), ("permissions-policy", "permissions", 500), ("feature-policy", "feature", 500), ("via", "via", 300), ("cf-ray", "cf_ray", 120), ("cf-cache-status", "cf_cache", 80), ("x-served-by", "x_served_by", 200), ("x-cache", "x_cache", 80), ("x-amz-cf-id", "aws_cf_id", 200), ("x-akamai-transformed", "akamai", 200), ("x-github-request-id", "github_req", 200), ("x-vercel-id", "vercel_id", 200), ("x-vercel-cache", "vercel_cache", 80), ("x-nf-request-id", "netlify_id", 200), ("x-drupal-cache", "drupal_cache", 80), ("x-drupal-dynamic-cache", "drupal_dynamic", 80), ("x-backend-server", "backend", 200), ("x-pingback", "pingback", 300), ("x-litespeed-cache", "litespeed_cache", 80), ("x-runtime", "runtime", 80), ("x-turbo-charged-by", "litespeed_lscache", 120))
COOKIE_NAME = r"[A-Za-z0-9!#$%&'*+\-.^_`|~]{1,64}"
#: One of a provider's words, case folded, stands in every page where its key, or its script, is found.
CAPTCHA_KEY_WORDS = {"recaptcha": ("6l",), "turnstile": ("0x4aaaaaaa",), "hcaptcha": ("captcha",), "arkose": ("arkoselabs.com",), "geetest": ("geetest", "gt"), "friendly_captcha": ("friendly", "frc-captcha")}
CAPTCHA_SCRIPT_WORDS = {"recaptcha": ("google.com/recaptcha",), "hcaptcha": ("hcaptcha.com",), "turnstile": ("challenges.cloudflare.com",), "recaptcha-enterprise": ("google.com/recaptcha",), "arkose": ("arkoselabs.com", "funcaptcha.com"), "geetest": ("geetest.com",), "aws_waf": ("awswaf.com",), "friendly_captcha": ("friendlycaptcha.com", "friendly-challenge")}

# --- what patterns need ------------------------------------------------------------
SITE_FILE_WORDS = ("/sitemap", "/robots.txt", "/humans.txt", "security.txt", "ads.txt")
#: One of a pattern's words, case folded, stands in every match: a page without them is not searched.
WORDS_OF = {
    CONCAT_EMAIL: ('"@"',),
    FEED: ("/feed", "/rss", "/atom.xml", "/index.xml", "?feed="),
    INTERNAL_IP: ("10.", "192.168.", "172.", "127.", "169.254.", "100."),
    PGP_SERVER: ("keys.openpgp.org", "pgp.mit.edu", "keyserver.ubuntu.com", "keys.gnupg.net", "pgp.surf", "sks-keyservers.net", "pgpkeys.eu", "keys.mailvelope.com", "/pks/lookup"),
    KEYBASE: ("keybase.io/",),
    **{pattern: SITE_FILE_WORDS for pattern, _ in SITE_FILES},
}
#: Cheap patterns that do not look behind, each found wherever a longer one is: in phone numbers; in addresses of coins but those told
#: by a prefix; in keys and fingerprints without gaps; in fingerprints by groups.
TWO_DIGITS = r"\d\d"
COIN_RUN = r"[A-Za-z0-9][A-Za-z0-9]{24}"
HEX_RUN = r"[A-Fa-f0-9][A-Fa-f0-9]{31}"
HEX_GROUPS = r"[A-Fa-f0-9][A-Fa-f0-9]{3}[ \t]+[A-Fa-f0-9]{4}(?:[A-Fa-f0-9]{4})?[ \t]+[A-Fa-f0-9]{4}"
