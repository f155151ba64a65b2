"""Fixed values of the text categories: patterns, deny lists and URL templates.

Everything in this module is data that must equal the values results are compared
with; the logic that applies it is in ``tidemark.operators``.
"""

from __future__ import annotations

import re

I = "(?i)"  # noqa: E741  case-insensitive prefix

# --- archive artefacts -----------------------------------------------------
ARCHIVE_ARTEFACTS = (
    r"(?s)<!-- BEGIN WAYBACK TOOLBAR INSERT -->.*?<!-- END WAYBACK TOOLBAR INSERT -->",
    r'(?is)<script[^>]+src="/_static/[^"]*"[^>]*>.*?</script>',
    r'(?is)<div\s+id="wm-ipp-base"[^>]*>.*?</div>\s*</div>\s*</div>',
)

# --- emails ----------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
EMAIL_EXCLUDE = ("noreply", "no-reply", "example", "email", "user", "test", "info@example", "your", "name@", "sample", "placeholder", "changeme", "youremail", "yourname")
EMAIL_PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "email.com", "email.fr", "domain.com", "domain.fr", "test.com", "test.org", "mail.com", "yourdomain.com", "yourcompany.com", "company.com", "acme.com", "localhost")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")
ASSET_EXTENSIONS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".css", ".scss", ".less", ".map", ".json", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".vue", ".wasm", ".min", ".html", ".htm", ".php", ".xml")

# --- analytics -------------------------------------------------------------
TRACKERS = (
    ("GA_Universal", r"UA-\d{4,10}-\d{1,2}", 0),
    ("GA4", r"\bG-[A-Z0-9]{10}\b", 0),
    ("GTM", r"GTM-[A-Z0-9]{5,8}", 0),
    ("Google_Ads", r"AW-\d{9,12}", 0),
    ("Meta_Pixel", r"fbq\([^)]*[\"'](\d{14,16})[\"']", 1),
    ("Hotjar", r"hjid[:\s]*[\"']?(\d{5,8})[\"']?", 1),
    ("Mixpanel", r"mixpanel\.init\([\"']([a-f0-9]{32})[\"']", 1),
    ("Yandex_Metrica", r"ym\((\d{7,10})\s*,", 1),
)
ID_DENYLIST = ("GTM-XXXXXX", "GTM-XXXXXXX", "UA-000000-1", "UA-0-1", "G-XXXXXXXXXX")
ANALYTICS = (
    ("ga4", r"\bG-[A-Z0-9]{10}\b", 0),
    ("ua", r"\bUA-\d{4,10}-\d{1,4}\b", 0),
    ("gtm", r"\bGTM-[A-Z0-9]{6,9}\b", 0),
    ("hotjar", r"hjid\s*[:=]\s*['\"]?(\d{5,8})['\"]?", 1),
    ("hotjar", r"static\.hotjar\.com/c/hotjar-(\d{5,8})", 1),
    ("matomo", r"setSiteId['\"]?\s*[,(]\s*['\"]?(\d{1,6})", 1),
    ("matomo", r"piwik\.php\?idsite=(\d{1,6})", 1),
    ("matomo", r"matomo\.php\?idsite=(\d{1,6})", 1),
    ("mixpanel", r"mixpanel\.init\(\s*['\"]([a-f0-9]{32})['\"]", 1),
    ("segment", r"analytics\.load\(\s*['\"]([A-Za-z0-9]{20,40})['\"]", 1),
    ("yandex_metrica", r"\bym\(\s*(\d{7,9})\s*,", 1),
    ("yandex_metrica", r"mc\.yandex\.ru/watch/(\d{7,9})", 1),
    ("fathom", r"data-site=[\"']([A-Z]{8})[\"']", 1),
)
ANALYTICS_PIVOTS = {
    "ga4": "https://www.google.com/search?q=%22{}%22",
    "ua": "https://www.google.com/search?q=%22{}%22",
    "gtm": "https://www.googletagmanager.com/gtm.js?id={}",
    "hotjar": "https://insights.hotjar.com/sites/{}/",
    "matomo": "https://www.google.com/search?q=%22idsite%3D{}%22+matomo",
    "mixpanel": "https://mixpanel.com/report/{}/",
    "segment": "https://app.segment.com/workspaces/write-keys?q={}",
    "yandex_metrica": "https://metrika.yandex.com/dashboard?id={}",
    "plausible": "https://plausible.io/{}",
    "fathom": "https://app.usefathom.com/share/{}/",
}

# --- social ----------------------------------------------------------------
SOCIAL = (
    ("twitter", r"(?<![A-Za-z0-9])twitter\.com/(?!share|intent)([A-Za-z0-9_]{1,50})"),
    ("x", r"(?<![A-Za-z0-9])x\.com/(?!share|intent)([A-Za-z0-9_]{1,50})"),
    ("linkedin", r"(?<![A-Za-z0-9])linkedin\.com/(?:in|company|school|edu|org|pub|profile)/([A-Za-z0-9_\-%.]{1,100})"),
    ("facebook", r"(?<![A-Za-z0-9])(?:facebook|fb)\.com/(?!sharer|share|dialog|plugins|tr[/?])([A-Za-z0-9_.]{1,100})"),
    ("instagram", r"(?<![A-Za-z0-9])instagram\.com/([A-Za-z0-9_.]{1,100})"),
    ("telegram", r"(?<![A-Za-z0-9])t\.me/(?!joinchat)([A-Za-z0-9_]{3,50})"),
    ("youtube", r"(?<![A-Za-z0-9])youtube\.com/(?:channel/|@|user/|c/)([A-Za-z0-9_\-]{1,100})"),
    ("pinterest", r"(?<![A-Za-z0-9])pinterest\.com/(?!pin/|search/|categories/|ideas/|today/)([A-Za-z0-9_\-]{2,60})"),
    ("github", r"(?<![A-Za-z0-9])github\.com/([A-Za-z0-9_\-]{1,100})"),
    ("tiktok", r"(?<![A-Za-z0-9])tiktok\.com/@([A-Za-z0-9_.]{1,50})"),
    ("snapchat", r"(?<![A-Za-z0-9])snapchat\.com/add/([A-Za-z0-9_.]{1,50})"),
    ("discord", r"(?<![A-Za-z0-9])discord(?:\.gg|\.com/invite)/([A-Za-z0-9\-]{2,32})"),
)
SOCIAL_URLS = {
    "twitter": "https://twitter.com/{}",
    "x": "https://x.com/{}",
    "facebook": "https://facebook.com/{}",
    "instagram": "https://instagram.com/{}",
    "telegram": "https://t.me/{}",
    "youtube": "https://youtube.com/{}",
    "github": "https://github.com/{}",
    "tiktok": "https://tiktok.com/@{}",
    "snapchat": "https://snapchat.com/add/{}",
    "discord": "https://discord.gg/{}",
    "pinterest": "https://pinterest.com/{}",
}
SOCIAL_EXCLUDE = ("share", "intent", "sharer", "dialog", "plugins", "widgets", "platform", "about", "help", "settings", "privacy", "terms", "login", "signup", "search", "explore", "notifications", "linkedin", "facebook", "twitter", "instagram", "youtube", "necolas", "nicgirault")
SOCIAL_RESERVED = {
    "github": ("features", "pricing", "marketplace", "topics", "sponsors", "enterprise", "codespaces", "collections", "trending", "readme", "security", "customer-stories", "team", "pulls", "issues", "new", "orgs", "organizations", "apps", "join", "contact"),
    "instagram": ("reel", "reels", "stories", "tv", "accounts", "directory"),
    "facebook": ("tr", "pages", "groups", "events", "watch", "gaming", "profile.php", "marketplace", "bookmarks"),
    "twitter": ("home", "hashtag", "messages", "compose", "tos", "privacy"),
    "x": ("home", "hashtag", "messages", "compose"),
    "pinterest": ("pin", "search", "categories", "ideas", "today", "business"),
}
LINKEDIN_ANONYMOUS = r"^ACoA[A-Za-z0-9_\-]{20,}$"

# --- cloud buckets and keys --------------------------------------------------
CLOUD_BUCKETS = (
    I + r"(?:[a-z0-9][a-z0-9.\-]{0,62}\.s3(?:[.\-][a-z0-9]+(?:-[a-z0-9]+)*){0,4}\.amazonaws\.com|s3(?:[.\-][a-z0-9]+(?:-[a-z0-9]+)*){0,4}\.amazonaws\.com/[a-z0-9._\-]+)[^\s\"'<>]*",
    I + r"storage\.googleapis\.com/[a-z0-9._\-]+",
    I + r"[a-z0-9]+\.blob\.core\.windows\.net[^\s\"'<>]*",
    I + r"[a-z0-9.\-]+\.digitaloceanspaces\.com[^\s\"'<>]*",
)
API_KEYS = (
    ("AWS", r"\b(?:AKIA|ASIA|ABIA|ACCA|AGPA|AIDA|AIPA|ANPA|ANVA|AROA|ASCA)[0-9A-Z]{16}\b"),
    ("Google_API", r"(?<![A-Za-z0-9_\-])AIza[0-9A-Za-z_\-]{35}(?![A-Za-z0-9_\-])"),
    ("Google_OAuth_Client", r"\b\d{9,}-[a-z0-9]{32}\.apps\.googleusercontent\.com\b"),
    ("Stripe", r"\b(?:sk|pk|rk)_(?:test|live)_[0-9a-zA-Z]{24,}\b"),
    ("Mailgun", r"(?<![A-Za-z0-9\-])key-[0-9a-zA-Z]{32}\b"),
    ("Twilio", r"\b(?:AC|SK)[0-9a-fA-F]{32}\b"),
    ("SendGrid", r"SG\.[0-9A-Za-z_\-]{22}\.[0-9A-Za-z_\-]{43}"),
    ("Slack_Webhook", r"hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[a-zA-Z0-9]+"),
    ("Slack_Token", r"\bxox[bpoasr]-\d+-\d+-[A-Za-z0-9]+(?:-[A-Za-z0-9]+)?\b"),
    ("GitHub", r"\bgh[pousr]_[A-Za-z0-9_]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    ("OpenAI", r"\bsk-(?:proj|svcacct|admin)-[A-Za-z0-9_\-]{20,}\b|\bsk-[A-Za-z0-9]{48}\b"),
    ("Anthropic", r"\bsk-ant-(?:api|sid|skey)\d{2}-[A-Za-z0-9_\-]{93,}\b"),
    ("GitLab", r"\bgl(?:pat|soat|dt|cbt|ptt|rt)-[A-Za-z0-9_\-]{20,}\b"),
    ("HuggingFace", r"\bhf_[A-Za-z0-9]{34,40}\b"),
    ("Notion", r"\bsecret_[A-Za-z0-9]{43}\b"),
    ("Discord_Token", r"\b[MN][A-Za-z\d_\-]{23,28}\.[A-Za-z\d_\-]{6,7}\.[A-Za-z\d_\-]{27,38}\b"),
    ("Sentry_DSN", I + r"https?://[a-f0-9]{32}@(?:o\d+\.)?(?:[a-z0-9-]+\.)?ingest(?:\.[a-z]{2})?\.sentry\.io/\d+"),
    ("Mapbox", r"\bpk\.eyJ[A-Za-z0-9_\-]{15,}\.[A-Za-z0-9_\-]{20,}\b"),
    ("Telegram_Bot", r"\b\d{8,10}:[A-Za-z0-9_\-]{35}\b"),
    ("Discord_Webhook", I + r"https?://discord(?:app)?\.com/api/webhooks/\d+/[A-Za-z0-9_\-]+"),
    ("Supabase", r"\bsbp_[a-f0-9]{40}\b"),
    ("DigitalOcean", r"\bdo[opr]_v1_[a-f0-9]{64}\b"),
    ("Shopify", r"\bshp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}\b"),
    ("Linear", r"\blin_api_[A-Za-z0-9]{40}\b"),
    ("npm", r"\bnpm_[A-Za-z0-9]{36}\b"),
)
TWILIO_CONTEXT = I + r"twilio|account[_\-]?sid|auth[_\-]?token"
PUBLIC_KEY_TYPES = ("Google_OAuth_Client", "Mapbox", "Sentry_DSN")

# --- tenants -----------------------------------------------------------------
JOB_BOARDS = (
    ("greenhouse", I + r"\bboards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?([a-z0-9_\-]{2,60})\b"),
    ("lever", I + r"\b(?:jobs|api)\.lever\.co/(?:v0/postings/)?([a-z0-9_\-]{2,60})\b"),
    ("workable", I + r"\bapply\.workable\.com/([a-z0-9_\-]{2,60})\b|\b([a-z0-9_\-]{2,60})\.workable\.com\b"),
    ("ashby", I + r"\bjobs\.ashbyhq\.com/([a-z0-9_\-]{2,60})\b"),
    ("personio", I + r"\b([a-z0-9_\-]{2,60})\.jobs\.personio\.(?:com|de)\b"),
    ("recruitee", I + r"\b([a-z0-9_\-]{2,60})\.recruitee\.com\b"),
    ("bamboohr", I + r"\b([a-z0-9_\-]{2,60})\.bamboohr\.com/(?:jobs|careers)\b"),
    ("smartrecruiters", I + r"\bcareers\.smartrecruiters\.com/([a-z0-9_\-]{2,60})\b"),
)
JOB_BOARD_RESERVED = ("www", "app", "api", "blog", "help", "docs", "support", "login", "signup", "search", "embed", "boards-api", "careers", "jobs", "resources", "go", "info", "status", "widget", "assets", "cdn")
JOB_BOARD_PIVOTS = {
    "greenhouse": "https://boards.greenhouse.io/{}",
    "lever": "https://jobs.lever.co/{}",
    "workable": "https://apply.workable.com/{}",
    "ashby": "https://jobs.ashbyhq.com/{}",
    "personio": "https://{}.jobs.personio.com",
    "recruitee": "https://{}.recruitee.com",
    "bamboohr": "https://{}.bamboohr.com/careers",
    "smartrecruiters": "https://careers.smartrecruiters.com/{}",
}
AUTH_PROVIDERS = (
    ("auth0", I + r"\bhttps?://([a-z0-9_\-]{2,60})(?:\.[a-z]{2})?\.auth0\.com\b"),
    ("okta", I + r"\bhttps?://([a-z0-9_\-]{2,60})\.(?:okta|oktapreview)\.com\b"),
    ("cognito", I + r"\bhttps?://(?:cognito-idp\.[a-z0-9-]+\.amazonaws\.com/([a-z0-9-]+_[A-Za-z0-9]+)|([a-z0-9_\-]{2,60})\.auth\.[a-z0-9-]+\.amazoncognito\.com)\b"),
    ("keycloak", r"/auth/realms/([a-zA-Z0-9_\-]{2,60})/"),
    ("workos", I + r"\bhttps?://api\.workos\.com\b|\bworkos_[A-Za-z0-9_\-]+\b"),
    ("clerk", I + r"\bhttps?://([a-z0-9_\-]{2,60})\.clerk\.accounts\.dev\b|\bclerk\.[a-z0-9_\-]+\.com\b"),
)
AUTH_RESERVED = ("www", "app", "api", "auth", "admin", "blog", "help", "docs", "support", "login", "signup", "dashboard", "manage", "console", "cdn", "assets", "master", "account")
AUTH_PIVOTS = {
    "auth0": "https://manage.auth0.com/dashboard/eu/{}/",
    "okta": "https://{}.okta.com/admin/dashboard",
    "cognito": "https://{}.console.aws.amazon.com/cognito/v2/idp/user-pools",
    "keycloak": "",
    "workos": "https://dashboard.workos.com/",
    "clerk": "https://dashboard.clerk.com/",
}
BUG_BOUNTIES = (
    ("hackerone", I + r"\bhackerone\.com/(?!hacktivity|opportunities|reports|directory|sitemap|signup|users|login|leaderboard|teams)([a-z0-9_\-]{2,60})\b"),
    ("bugcrowd", I + r"\bbugcrowd\.com/(?!faq|leaderboard|program-list|signin|engagements|sign-up|disclosures|crowdcontrol)([a-z0-9_\-]{2,60})\b"),
    ("intigriti", I + r"\bintigriti\.com/(?:companies/|programs/|researcher/programs/)?(?!login|signup|search|api|hall-of-fame|company)([a-z0-9_\-]{2,60})\b"),
    ("yeswehack", I + r"\byeswehack\.com/(?:programs/)?(?!login|signup|hall-of-fame|directory)([a-z0-9_\-]{2,60})\b"),
)
BUG_BOUNTY_RESERVED = ("blog", "pricing", "contact", "careers", "customers", "researchers", "research", "about", "about-us", "product", "products", "solutions", "security", "company", "companies", "features", "resources", "terms", "privacy", "press", "partners", "platform", "docs", "documentation", "faq", "support", "help", "login", "signup", "sign-up", "search", "programs", "program-list", "current_user", "bug_bounty", "hall-of-fame", "directory", "leaderboard", "events")
BUG_BOUNTY_PIVOTS = {
    "hackerone": "https://hackerone.com/{}",
    "bugcrowd": "https://bugcrowd.com/{}",
    "intigriti": "https://app.intigriti.com/programs/{}",
    "yeswehack": "https://yeswehack.com/programs/{}",
}
STATUS_PAGES = (
    ("statuspage.io", I + r"\bhttps?://([a-z0-9][a-z0-9-]{1,40})\.statuspage\.io\b"),
    ("instatus.com", I + r"\bhttps?://([a-z0-9][a-z0-9-]{1,40})\.instatus\.com\b"),
    ("betterstack", I + r"\bhttps?://([a-z0-9][a-z0-9-]{1,40})\.betteruptime\.com\b"),
    ("freshstatus", I + r"\bhttps?://([a-z0-9][a-z0-9-]{1,40})\.freshstatus\.io\b"),
    ("statushub", I + r"\bhttps?://([a-z0-9][a-z0-9-]{1,40})\.statushub\.io\b"),
)
STATUS_PAGE_RESERVED = ("www", "blog", "docs", "help", "status")
STATUS_PAGE_PIVOTS = {
    "statuspage.io": "https://{}.statuspage.io/",
    "instatus.com": "https://{}.instatus.com/",
    "betterstack": "https://{}.betteruptime.com/",
    "freshstatus": "https://{}.freshstatus.io/",
    "statushub": "https://{}.statushub.io/",
    "custom-domain": "https://{}/",
}
STATUS_CUSTOM = I + r"\bhttps?://((?:status|health|incidents|uptime)\.[a-z0-9][a-z0-9.\-]+\.[a-z]{2,})\b"

# --- advertising, consent, hosting -------------------------------------------
ADSENSE = (("admob", r"ca-app-pub-(\d{10,16})", 0), ("adsense_publisher", r"ca-pub-(\d{10,16})", 0), ("ad_slot", r"data-ad-slot\s*=\s*[\"'](\d{10,})[\"']", 1))
COOKIE_CONSENT = (
    ("iubenda", I + r"cdn\.iubenda\.com/cs/iubenda_cs\.js|iubenda\.com/privacy-policy/(\d+)"),
    ("tarteaucitron", I + r"tarteaucitron(?:\.min)?\.js|class=['\"][^'\"]*tarteaucitron"),
    ("onetrust", I + r"cdn\.cookielaw\.org|otSDKStub\.js|id=['\"]otnotice"),
    ("cookieyes", I + r"cdn-cookieyes\.com|cdn\.cookieyes\.com|cky-consent-container"),
    ("cookiebot", I + r"consent\.cookiebot\.com|data-cbid=['\"]([A-Za-z0-9-]+)['\"]"),
    ("axeptio", I + r"static\.axept\.io|acNamespace"),
    ("didomi", I + r"sdk\.privacy-center\.org|didomi-host"),
    ("trustarc", I + r"consent\.trustarc\.com|class=['\"][^'\"]*truste[_\-]"),
    ("usercentrics", I + r"app\.usercentrics\.eu"),
    ("termly", I + r"app\.termly\.io"),
)
COOKIE_ACCOUNTS = {
    "iubenda": r"iubenda\.com/privacy-policy/(\d+)",
    "cookiebot": I + r"data-cbid=['\"]([A-Za-z0-9-]+)['\"]",
    "usercentrics": I + r"data-settings-id=['\"]([A-Za-z0-9_\-]+)['\"]",
    "onetrust": I + r"data-domain-script=['\"]([A-Za-z0-9\-]+)['\"]",
}
COOKIE_PIVOTS = {
    "iubenda": "https://www.iubenda.com/",
    "tarteaucitron": "https://tarteaucitron.io/",
    "onetrust": "https://app.onetrust.com/",
    "cookieyes": "https://www.cookieyes.com/",
    "axeptio": "https://www.axeptio.eu/",
    "didomi": "https://www.didomi.io/",
    "trustarc": "https://www.trustarc.com/",
    "termly": "https://termly.io/",
    "cookiebot": "https://www.cookiebot.com/",
    "usercentrics": "https://usercentrics.com/",
}
COOKIE_ACCOUNT_PIVOTS = {
    "iubenda": "https://www.iubenda.com/privacy-policy/{}",
    "cookiebot": "https://www.cookiebot.com/en/manager/?cbid={}",
    "onetrust": "https://app.onetrust.com/",
    "usercentrics": "https://admin.usercentrics.com/#/settings/{}",
}
HOSTING = (
    ("Cloudflare", "meta/script", I + r"\bcloudflare(?:\.com|insights\.com)?\b|\bworkers\.dev\b|\bpages\.dev\b|cdn-cgi/"),
    ("Netlify", "meta/script", I + r"\bnetlify(?:\.(?:com|app))?\b"),
    ("Vercel", "script/meta", I + r"__vercel|x-vercel|\bvercel\.(?:com|app)\b"),
    ("GitHub Pages", "link/meta", I + r"\.github\.io\b"),
    ("AWS S3", "meta/link", I + r"\bAmazonS3\b|\.amazonaws\.com\b"),
    ("AWS Lambda", "url", I + r"\.execute-api\.[a-z0-9-]+\.amazonaws\.com\b|\.lambda-url\.[a-z0-9-]+\.on\.aws\b"),
    ("WordPress.com", "link", I + r"\bs\d+\.wp\.com\b|\bwordpress\.com\b"),
    ("Shopify", "link/script", I + r"\bcdn\.shopify\.com\b|\b[a-z0-9-]+\.myshopify\.com\b|\bShopify\.(?:theme|shop|routes|Checkout|analytics)\b"),
    ("Squarespace", "link/script", I + r"\bsquarespace(?:\.com|-cdn)\b"),
    ("Wix", "link/script", I + r"\bwix\.com\b|\bwixstatic\.com\b"),
    ("WP Engine", "link", I + r"\bwpengine\.com\b"),
    ("WPServeur", "script/comment", I + r"\bwpserveur\b"),
    ("OVH", "meta/link", I + r"\bovh(?:\.com|cloud)\b"),
    ("Heroku", "meta/link", I + r"\bheroku(?:app|cdn)?\.com\b"),
    ("Firebase", "script/link", I + r"\bfirebase(?:app)?\.com\b|\bfirebaseio\.com\b"),
    ("Firebase Hosting", "url", I + r"\bweb\.app\b"),
    ("Azure", "meta/link", I + r"\bazurewebsites\.net\b|\bazure\.com\b"),
    ("Google Cloud", "link", I + r"\bgoogleusercontent\.com\b|\bappspot\.com\b"),
    ("Google Cloud Run", "url", I + r"\b[a-z0-9-]+\.run\.app\b"),
    ("Render", "meta", I + r"\brender\.com\b"),
    ("Fly.io", "meta", I + r"\bfly\.(?:io|dev)\b"),
    ("DigitalOcean App Platform", "url", I + r"\bondigitalocean\.app\b"),
    ("Railway", "url", I + r"\brailway\.app\b"),
    ("Deno Deploy", "url", I + r"\bdeno\.dev\b"),
    ("AWS CloudFront", "url", I + r"\b[a-z0-9]+\.cloudfront\.net\b"),
    ("AWS Amplify", "url", I + r"\.amplifyapp\.com\b"),
    ("Akamai", "url", I + r"\b(?:akamaihd|akamaized|edgesuite|edgekey)\.net\b"),
    ("Fastly", "url", I + r"\bfastly(?:lb)?\.net\b"),
    ("bunny.net", "url", I + r"\bb-cdn\.net\b|\bbunnycdn\.com\b"),
    ("KeyCDN", "url", I + r"\bkxcdn\.com\b"),
    ("Supabase", "url", I + r"\bsupabase\.co\b"),
    ("Ghost(Pro)", "url", I + r"\bghost\.io\b"),
    ("Strapi Cloud", "url", I + r"\bstrapiapp\.com\b"),
)
HEADER_HOSTING = (
    ("x-served-by", I + r"\bcache-[a-z]{2,4}(?:[-\d])", "Fastly"),
    ("x-cache", I + r"\b(?:HIT|MISS)\b", "Fastly"),
    ("x-fastly-request-id", r".", "Fastly"),
    ("server", I + r"\bopenresty\b", "OpenResty"),
    ("via", I + r"\bvarnish\b", "Varnish"),
    ("x-akamai-transformed", r".", "Akamai"),
    ("server", I + r"\bAkamaiGHost\b", "Akamai"),
    ("server", I + r"\bcloudflare\b", "Cloudflare"),
    ("cf-ray", r".", "Cloudflare"),
    ("server", I + r"\bvercel\b", "Vercel"),
    ("x-vercel-id", r".", "Vercel"),
    ("server", I + r"\bnetlify\b", "Netlify"),
)

# --- repositories --------------------------------------------------------------
GITHUB_RESERVED_OWNERS = ("settings", "issues", "pulls", "marketplace", "notifications", "explore", "topics", "trending", "collections", "events", "sponsors", "orgs", "features", "pricing", "about", "contact", "security", "enterprise", "customer-stories", "readme", "site", "apps", "login", "logout", "signup", "new", "dashboard", "codespaces", "search")
GITHUB_RESERVED_REPOS = ("settings", "followers", "following", "repositories", "projects", "packages", "stars", "sponsoring", "people", "teams", "tabs", "wiki", "network", "pulse", "commits", "branches", "releases", "tags", "actions", "deployments", "discussions", "community", "security", "advisories", "members", "policies", "forks", "watchers", "graphs", "traffic", "billing", "achievements")
GITHUB_URLS = (
    I + r"https?://(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9_.\-]{0,38}))/([A-Za-z0-9](?:[A-Za-z0-9_.\-]{0,99}))",
    I + r"https?://raw\.githubusercontent\.com/([A-Za-z0-9](?:[A-Za-z0-9_.\-]{0,38}))/([A-Za-z0-9](?:[A-Za-z0-9_.\-]{0,99}))",
    I + r"https?://([A-Za-z0-9](?:[A-Za-z0-9_\-]{0,38}))\.github\.io(?:/([A-Za-z0-9](?:[A-Za-z0-9_.\-]{0,99})))?",
)

# --- comments, listings, connection strings, tokens -----------------------------
COMMENT = r"(?s)<!--(.*?)-->"
COMMENT_EXCLUDE = ("wayback", "end ", "begin ", "[if ", "[endif", "<!-", "<![")
COMMENT_NOISE = ("google tag manager", "[attributes by finsweet]", "finsweet cookie consent", "last published:", "powered by webflow", "powered by squarespace", "powered by wix", "this site is optimized with the yoast", "begin yoast", "end yoast", "facebook pixel code", "end facebook pixel code", "hotjar tracking code", "google analytics", "begin gtm", "end gtm", "matomo", "powered by shopify")
LISTINGS = (
    (I + r"<h1>\s*Index of\s+/", "apache"),
    (I + r"<title>\s*Index of\s+/", "apache"),
    (I + r"Directory listing for\s+/", "python"),
    (I + r"<a[^>]*>\s*Parent Directory\s*</a>", "generic"),
    (I + r"<th[^>]*>\s*Name\s*</th>\s*<th[^>]*>\s*Last modified", "unknown"),
    (I + r"<th[^>]*>\s*Name</a>\s*</th>", "unknown"),
)
CONNECTION = I + r"(?<![A-Za-z0-9+.\-])(mysql|mariadb|postgres(?:ql)?|cockroachdb|mongodb(?:\+srv)?|rediss?|amqps?|smtps?|ftp|ldaps?|mssql|sqlserver|oracle|cassandra|neo4j(?:\+s)?|clickhouse)://[^\s\"'<>]{5,300}"
JWT = r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"
JWT_ALGORITHMS = ("HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "PS256", "PS384", "PS512", "ES256", "ES256K", "ES384", "ES512", "EdDSA", "none")
JWT_SENSITIVE = ("email", "password", "api_key", "access_token", "refresh_token", "session_id", "secret", "credential", "username", "passwd")
JWT_INTERESTING = ("sub", "name", "role", "scope", "iss", "aud", "exp", "iat")

# --- words that patterns need ------------------------------------------------------
#: One of these stands in every match of a pattern, by its name: as written, in lower case where the pattern ignores case.
#: A text without them is not tried.
EMAIL_WORDS = ("@",)
TRACKER_WORDS = {"GA_Universal": ("UA-",), "GA4": ("G-",), "GTM": ("GTM-",), "Google_Ads": ("AW-",), "Meta_Pixel": ("fbq(",), "Hotjar": ("hjid",), "Mixpanel": ("mixpanel.init(",), "Yandex_Metrica": ("ym(",)}
ANALYTICS_WORDS = {"ga4": ("G-",), "ua": ("UA-",), "gtm": ("GTM-",), "hotjar": ("hjid", "static.hotjar.com/c/hotjar-"), "matomo": ("setSiteId", "piwik.php?idsite=", "matomo.php?idsite="), "mixpanel": ("mixpanel.init(",), "segment": ("analytics.load(",), "yandex_metrica": ("ym(", "mc.yandex.ru/watch/"), "fathom": ("data-site=",)}
SOCIAL_WORDS = {
    "twitter": ("twitter.com/",),
    "x": ("x.com/",),
    "linkedin": ("linkedin.com/",),
    "facebook": ("facebook.com/", "fb.com/"),
    "instagram": ("instagram.com/",),
    "telegram": ("t.me/",),
    "youtube": ("youtube.com/",),
    "pinterest": ("pinterest.com/",),
    "github": ("github.com/",),
    "tiktok": ("tiktok.com/@",),
    "snapchat": ("snapchat.com/add/",),
    "discord": ("discord.gg/", "discord.com/invite/"),
}
CLOUD_BUCKET_WORDS = ((".amazonaws.com",), ("storage.googleapis.com/",), (".blob.core.windows.net",), (".digitaloceanspaces.com",))
API_KEY_WORDS = {
    "Google_API": ("AIza",),
    "Google_OAuth_Client": (".apps.googleusercontent.com",),
    "Stripe": ("_test_", "_live_"),
    "Mailgun": ("key-",),
    "Twilio": ("AC", "SK"),
    "SendGrid": ("SG.",),
    "Slack_Webhook": ("hooks.slack.com/services/T",),
    "Slack_Token": ("xox",),
    "GitHub": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "OpenAI": ("sk-",),
    "Anthropic": ("sk-ant-",),
    "GitLab": ("glpat-", "glsoat-", "gldt-", "glcbt-", "glptt-", "glrt-"),
    "HuggingFace": ("hf_",),
    "Notion": ("secret_",),
    "Sentry_DSN": (".sentry.io/",),
    "Mapbox": ("pk.eyJ",),
    "Discord_Webhook": (".com/api/webhooks/",),
    "Supabase": ("sbp_",),
    "DigitalOcean": ("_v1_",),
    "Shopify": ("shpat_", "shpca_", "shppa_", "shpss_"),
    "Linear": ("lin_api_",),
    "npm": ("npm_",),
}
#: A cheaper pattern that is found wherever a key without words is.
API_KEY_SHAPES = {"AWS": r"A[A-Z]{3}[0-9A-Z]{16}", "Discord_Token": r"\.[A-Za-z\d_\-]{6,7}\.[A-Za-z\d_\-]{27}", "Telegram_Bot": r"\d:[A-Za-z0-9_\-]{35}"}
JOB_BOARD_WORDS = {"greenhouse": (".greenhouse.io/",), "lever": (".lever.co/",), "workable": (".workable.com", "apply.workable.com/"), "ashby": ("jobs.ashbyhq.com/",), "personio": (".jobs.personio.",), "recruitee": (".recruitee.com",), "bamboohr": (".bamboohr.com/",), "smartrecruiters": ("careers.smartrecruiters.com/",)}
AUTH_WORDS = {"auth0": (".auth0.com",), "okta": (".okta.com", ".oktapreview.com"), "cognito": (".amazonaws.com/", ".amazoncognito.com"), "keycloak": ("/auth/realms/",), "workos": ("://api.workos.com", "workos_"), "clerk": (".clerk.accounts.dev", "clerk.")}
BUG_BOUNTY_WORDS = {"hackerone": ("hackerone.com/",), "bugcrowd": ("bugcrowd.com/",), "intigriti": ("intigriti.com/",), "yeswehack": ("yeswehack.com/",)}
STATUS_PAGE_WORDS = {"statuspage.io": (".statuspage.io",), "instatus.com": (".instatus.com",), "betterstack": (".betteruptime.com",), "freshstatus": (".freshstatus.io",), "statushub": (".statushub.io",)}
STATUS_CUSTOM_WORDS = ("://status.", "://health.", "://incidents.", "://uptime.")
ADSENSE_WORDS = {"admob": ("ca-app-pub-",), "adsense_publisher": ("ca-pub-",), "ad_slot": ("data-ad-slot",)}
COOKIE_WORDS = {
    "iubenda": ("cdn.iubenda.com/cs/iubenda_cs.js", "iubenda.com/privacy-policy/"),
    "tarteaucitron": ("tarteaucitron",),
    "onetrust": ("cdn.cookielaw.org", "otsdkstub.js", "id='otnotice", 'id="otnotice'),
    "cookieyes": ("cdn-cookieyes.com", "cdn.cookieyes.com", "cky-consent-container"),
    "cookiebot": ("consent.cookiebot.com", "data-cbid="),
    "axeptio": ("static.axept.io", "acnamespace"),
    "didomi": ("sdk.privacy-center.org", "didomi-host"),
    "trustarc": ("consent.trustarc.com", "truste_", "truste-"),
    "usercentrics": ("app.usercentrics.eu",),
    "termly": ("app.termly.io",),
}
HOSTING_WORDS = {
    "Cloudflare": ("cloudflare", "workers.dev", "pages.dev", "cdn-cgi/"),
    "Netlify": ("netlify",),
    "Vercel": ("__vercel", "x-vercel", "vercel.com", "vercel.app"),
    "GitHub Pages": (".github.io",),
    "AWS S3": ("amazons3", ".amazonaws.com"),
    "AWS Lambda": (".execute-api.", ".lambda-url."),
    "WordPress.com": (".wp.com", "wordpress.com"),
    "Shopify": ("cdn.shopify.com", ".myshopify.com", "shopify."),
    "Squarespace": ("squarespace.com", "squarespace-cdn"),
    "Wix": ("wix.com", "wixstatic.com"),
    "WP Engine": ("wpengine.com",),
    "WPServeur": ("wpserveur",),
    "OVH": ("ovh.com", "ovhcloud"),
    "Heroku": ("heroku.com", "herokuapp.com", "herokucdn.com"),
    "Firebase": ("firebase.com", "firebaseapp.com", "firebaseio.com"),
    "Firebase Hosting": ("web.app",),
    "Azure": ("azurewebsites.net", "azure.com"),
    "Google Cloud": ("googleusercontent.com", "appspot.com"),
    "Google Cloud Run": (".run.app",),
    "Render": ("render.com",),
    "Fly.io": ("fly.io", "fly.dev"),
    "DigitalOcean App Platform": ("ondigitalocean.app",),
    "Railway": ("railway.app",),
    "Deno Deploy": ("deno.dev",),
    "AWS CloudFront": (".cloudfront.net",),
    "AWS Amplify": (".amplifyapp.com",),
    "Akamai": ("akamaihd.net", "akamaized.net", "edgesuite.net", "edgekey.net"),
    "Fastly": ("fastly.net", "fastlylb.net"),
    "bunny.net": ("b-cdn.net", "bunnycdn.com"),
    "KeyCDN": ("kxcdn.com",),
    "Supabase": ("supabase.co",),
    "Ghost(Pro)": ("ghost.io",),
    "Strapi Cloud": ("strapiapp.com",),
}
GITHUB_WORDS = (("github.com/",), ("raw.githubusercontent.com/",), (".github.io",))
COMMENT_WORDS = ("<!--",)
LISTING_WORDS = (("index of",), ("index of",), ("directory listing for",), ("parent directory",), ("last modified",), ("name</a>",))
CONNECTION_WORDS = ("sql://", "db://", "db+srv://", "postgres://", "redis://", "rediss://", "amqp://", "amqps://", "smtp://", "smtps://", "ftp://", "ldap://", "ldaps://", "sqlserver://", "oracle://", "cassandra://", "neo4j", "clickhouse://")
JWT_WORDS = (".eyJ",)
#: Every pattern with its words.
NEEDED = (
    (EMAIL, EMAIL_WORDS),
    *((pattern, TRACKER_WORDS[name]) for name, pattern, _ in TRACKERS),
    *((pattern, ANALYTICS_WORDS[name]) for name, pattern, _ in ANALYTICS),
    *((pattern, SOCIAL_WORDS[name]) for name, pattern in SOCIAL),
    *zip(CLOUD_BUCKETS, CLOUD_BUCKET_WORDS, strict=True),
    *((pattern, API_KEY_WORDS[name]) for name, pattern in API_KEYS if name not in API_KEY_SHAPES),
    *((pattern, JOB_BOARD_WORDS[name]) for name, pattern in JOB_BOARDS),
    *((pattern, AUTH_WORDS[name]) for name, pattern in AUTH_PROVIDERS),
    *((pattern, BUG_BOUNTY_WORDS[name]) for name, pattern in BUG_BOUNTIES),
    *((pattern, STATUS_PAGE_WORDS[name]) for name, pattern in STATUS_PAGES),
    (STATUS_CUSTOM, STATUS_CUSTOM_WORDS),
    *((pattern, ADSENSE_WORDS[name]) for name, pattern, _ in ADSENSE),
    *((pattern, COOKIE_WORDS[name]) for name, pattern in COOKIE_CONSENT),
    *((pattern, HOSTING_WORDS[name]) for name, _, pattern in HOSTING),
    *zip(GITHUB_URLS, GITHUB_WORDS, strict=True),
    (COMMENT, COMMENT_WORDS),
    *zip((pattern for pattern, _ in LISTINGS), LISTING_WORDS, strict=True),
    (CONNECTION, CONNECTION_WORDS),
    (JWT, JWT_WORDS),
)
WORDS_OF: dict[str, tuple[str, ...]] = {}
for _pattern, _words in NEEDED:  # a pattern may stand in two tables
    WORDS_OF[_pattern] = tuple(dict.fromkeys((*WORDS_OF.get(_pattern, ()), *_words)))

#: A word of letters alone between white space: a text without such words holds all words above that have another character and no white space.
PROSE = r"\s[a-zA-Z\u00C0-\u024F]++(?=\s)"


def in_prose(word: str) -> bool:
    """Whether a word may go with the prose."""
    return " " in word or not re.search("[^a-zA-Z]", word)


#: Characters from frequent to rare in pages; others are rarer still.
_FREQUENT = " etaoinsrhldcumpgf<>/wybv.k"


def rare_part(word: str) -> str:
    """A word without a part of its first third, so that it begins with its rarest character there: a search stops at every place of that one."""
    starts = [i for i in range(1 + len(word) // 3) if i == 0 or word[i] not in " ./"]
    return word[max(starts, key=lambda i: (_FREQUENT.find(word[i]) % 99, -i)) :]
