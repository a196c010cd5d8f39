"""Word lists, path lists and regular expressions the results depend on."""

from __future__ import annotations

# White space and word characters as the Python re module knows them, spelt so that Java and RE2
# agree: \s and \w mean something else there.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def portable(pattern: str) -> str:
    """Rewrite ``\\s`` of a pattern list entry for Java."""
    inner = SPACE[1:-1]
    return pattern.replace(r"[_\s-]", f"[_{inner}-]").replace(r"\s", SPACE)


def any_of(patterns) -> str:
    """One alternation out of a pattern list; ``(?d)``: only a newline ends a line."""
    return "(?d)" + "|".join(f"(?:{portable(p)})" for p in patterns)


# Paths tried under the host root of every site.
COMMON_PATHS = (
    "/api/docs",
    "/api-docs",
    "/api/documentation",
    "/docs",
    "/docs/api",
    "/documentation",
    "/documentation/api",
    "/developers",
    "/developer",
    "/dev/docs",
    "/reference",
    "/api-reference",
    "/api/reference",
    "/guides/api",
    "/v1/docs",
    "/v2/docs",
    "/api/v1/docs",
    "/api/v2/docs",
    "/guide",
    "/guides",
    "/tutorial",
    "/tutorials",
    "/getting-started",
    "/quickstart",
    "/quick-start",
    "/how-to",
    "/api-guide",
    "/rest-api",
    "/graphql",
    "/resources",
    "/help",
    "/support/api",
)

# In order of preference.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml")

# A lower-cased url matching one of these may be API documentation.
DOC_URL_PATTERNS = (
    r"/api",
    r"/docs?",
    r"/documentation",
    r"/reference",
    r"/api.?reference",
    r"/developer",
    r"/developers",
    r"/guides?",
    r"/tutorials?",
    r"/getting.?started",
    r"/quick.?start",
    r"/how.?to",
    r"/resources",
    r"/help",
    r"/support/api",
    r"/knowledge.?base",
    r"endpoint",
    r"authentication",
    r"authorization",
    r"/rest",
    r"/graphql",
    r"/webhook",
)

# A lower-cased url matching one of these is API documentation.
STRONG_DOC_URL_PATTERNS = (
    r"/api.*docs?",
    r"/api.*reference",
    r"/rest.*api",
    r"/graphql",
)

# Words counted in a page, and how many of them are enough.
DOC_KEYWORDS = (
    "endpoint",
    "api",
    "request",
    "response",
    "authentication",
    "get",
    "post",
    "put",
    "delete",
    "parameter",
    "header",
    "body",
    "json",
)
KEYWORDS_WITH_URL = 2
KEYWORDS_ALONE = 5
SPEC_MARKERS = ('"openapi"', '"swagger"')

# Marks of a page drawn by scripts, and the text length below which it needs them.
RENDER_INDICATORS = (
    r"<div\s+id=['\"]root['\"]",
    r"<div\s+id=['\"]app['\"]",
    r"React",
    r"Vue",
    r"Angular",
    r"ng-app",
    r"data-reactroot",
)
RENDER_TEXT_LIMIT = 500

# How authentication methods are written about (lower-cased text).
AUTH_PATTERNS = {
    "api_key_header": (
        r"api[_\s-]?key.{0,50}header",
        r"x-api-key",
        r"authorization.{0,30}api[_\s-]?key",
        r"include.{0,30}api[_\s-]?key.{0,30}header",
    ),
    "api_key_query": (
        r"api[_\s-]?key.{0,50}query.{0,20}parameter",
        r"api[_\s-]?key.{0,50}url",
        r"\?api[_\s-]?key=",
    ),
    "bearer_token": (
        r"bearer\s+token",
        r"authorization:\s*bearer",
        r"bearer.{0,30}authentication",
        r"jwt.{0,30}bearer",
    ),
    "basic_auth": (
        r"basic\s+auth",
        r"authorization:\s*basic",
        r"username.{0,30}password.{0,30}base64",
    ),
    "oauth2": (
        r"oauth\s*2\.0",
        r"oauth2",
        r"authorization.{0,30}code.{0,30}flow",
        r"client.{0,30}credentials.{0,30}flow",
        r"access.{0,30}token.{0,30}endpoint",
    ),
}

# Every pattern of a family needs one of these words. Looking for them first spares most texts the
# regular expressions.
AUTH_WORDS = {
    "api_key_header": ("key",),
    "api_key_query": ("key",),
    "bearer_token": ("bearer",),
    "basic_auth": ("basic", "base64"),
    "oauth2": ("oauth", "flow", "endpoint"),
}

# OAuth flows in the order they are reported.
OAUTH_FLOW_PATTERNS = {
    "authorization_code": (
        r"authorization.{0,20}code",
        r"three.{0,10}legged",
        r"redirect.{0,20}uri",
    ),
    "client_credentials": (
        r"client.{0,20}credentials",
        r"machine.{0,20}to.{0,20}machine",
        r"two.{0,10}legged",
    ),
    "password": (
        r"resource.{0,20}owner.{0,20}password",
        r"password.{0,20}flow",
        r"username.{0,20}password.{0,20}grant",
    ),
    "implicit": (
        r"implicit.{0,20}flow",
        r"implicit.{0,20}grant",
    ),
}

# Where the name of a key header is written; the first pattern that matches counts.
HEADER_NAME_PATTERNS = (
    r"(?:header|include).{0,30}['\"`]([xX]-[aA][pP][iI]-[kK]ey)['\"`]",
    r"(?:header|include).{0,30}['\"`]([aA]uthorization)['\"`]",
    r"(?:header|include).{0,30}['\"`]([xX]-[aA][uU][tT][hH]-[tT]oken)['\"`]",
    r"['\"`]([xX]-[^'\"` ]+)['\"`].{0,30}header",
)
DEFAULT_HEADER_NAME = "X-API-Key"

# Words of a search that carry no meaning.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from up about into through during only just "
    "all show get find list return give me i want need endpoints api spec specification generate "
    "create"
).split()

# A search word in one of these groups, or naming it, brings in the whole group.
KEYWORD_GROUPS = {
    "payment": ("payment", "pay", "charge", "invoice", "billing", "transaction"),
    "user": ("user", "account", "profile", "customer", "member"),
    "auth": ("auth", "login", "signin", "signup", "register", "token", "session"),
    "product": ("product", "item", "catalog", "inventory", "sku"),
    "order": ("order", "purchase", "cart", "checkout", "basket"),
    "search": ("search", "query", "find", "lookup", "filter"),
    "analytics": ("analytics", "stats", "metrics", "report", "dashboard"),
    "notification": ("notification", "alert", "message", "email", "sms"),
    "file": ("file", "upload", "download", "document", "attachment"),
    "admin": ("admin", "management", "config", "settings", "control"),
}

# Search defaults.
RELEVANCE_THRESHOLD = 0.3
PATH_BOOST = 0.2
TOP_MATCHES = 5

# Limits of extraction, crawl and cache.
HASHED_CHARS = 50_000
PROMPT_CHARS = 600_000
PROMPT_SAMPLES = 10
TRUNCATION_MARK = "\n\n[... truncated ...]"
CRAWL_ROUNDS = 3
CRAWL_BATCH = 5
CRAWL_LINKS = 10
CRAWL_PAGES = 50
CRAWL_IF_FEWER_THAN = 3
CACHE_TTL_SECONDS = 86_400

# Markup that is not content, and markup that never has content.
REMOVED_TAGS = ("nav", "footer", "header", "aside", "script", "style", "noscript")
CONTENT_CLASS = r"content|documentation|docs"
VOID_TAGS = (
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer"
).split()
