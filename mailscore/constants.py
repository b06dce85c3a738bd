"""Fixed values of the email-risk model.

Everything in this module is data: word lists, weights, cut points and
patterns that decide results. The order of the lists matters where the first
few matches are reported.
"""

# ---------------------------------------------------------------- fixed values
# Column names accepted for the message text and the label, in order of choice.
TEXT_COLUMNS = ["body", "email_body", "content", "message", "text", "email_text", "mail", "raw_text"]
LABEL_COLUMNS = ["label", "class", "target", "is_phishing", "phishing", "spam", "y"]
TRAINING_LABEL_COLUMNS = ["label", "class", "target", "category", "type"]

# Domains whose mail and links lower the risk.
TRUSTED_DOMAINS = [
    "linkedin.com", "indeed.com", "glassdoor.com", "vietnamworks.com",
    "google.com", "gmail.com", "microsoft.com", "outlook.com",
    "amazon.com", "apple.com", "facebook.com", "meta.com",
    "github.com", "twitter.com", "x.com", "slack.com",
    "shopee.vn", "lazada.vn", "tiki.vn",
    "paypal.com", "stripe.com",
]

# Parts of a sender domain that raise the risk, and top-level domains that do.
SUSPICIOUS_DOMAIN_PARTS = [
    "secure-", "account-", "login-", "verify-", "update-",
    "alert-", "billing-", "support-", "-security", "-alert",
    "-verify", "-confirm", "paypal", "amazon", "microsoft",
    "apple", "google", "facebook", "bank", "netflix",
]
SUSPICIOUS_TLDS = [".xyz", ".top", ".click", ".link", ".info", ".biz"]

# Words of urgency, found as sub-strings of the lower-cased text.
URGENT_KEYWORDS = [
    "urgent", "immediately", "action required", "act now", "suspend",
    "verify", "confirm", "expire", "limited time", "final notice",
    "warning", "alert", "security", "locked", "disabled", "blocked",
    "unauthorized", "suspicious", "unusual", "violation", "risk",
    "24 hours", "48 hours", "deadline", "asap", "important",
]

# Words that announce an attachment, found the same way.
ATTACHMENT_KEYWORDS = [
    "attached", "attachment", "attachments", "see attached",
    "enclosed", "find attached", "please find", "attached file",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".exe", ".jpg", ".png", ".gif",
]

# Label words.
PHISHING_LABELS = [
    "phishing", "phising", "spam", "scam",
    "malicious", "fraud", "attack", "1", "1.0", "true", "yes",
]
LEGITIMATE_LABELS = [
    "legitimate", "legit", "benign", "ham",
    "normal", "safe", "clean", "0", "0.0", "false", "no",
]
LENIENT_PHISHING_LABELS = ["1", "phishing", "spam", "malicious", "fraud"]
LENIENT_LEGITIMATE_LABELS = ["0", "benign", "legit", "legitimate", "ham", "normal"]

# Segment patterns (on lower-cased text) with the reason shown to the reader.
SEGMENT_PATTERNS = [
    (r"click\s*(here|this|now)", "Yêu cầu click"),
    (r"verify\s*(your|account)", "Yêu cầu xác minh"),
    (r"(password|credit\s*card|ssn|bank)", "Yêu cầu thông tin nhạy cảm"),
    (r"(suspended|locked|disabled|expired)", "Cảnh báo tài khoản"),
    (r"(winner|prize|reward|gift|free)", "Hứa hẹn phần thưởng"),
    (r"(\$\d+|money|cash)", "Đề cập tiền bạc"),
]
SEGMENT_KEYWORD_REASON = "Từ khóa khẩn cấp: "
SEGMENT_LINK_REASON = ("Chứa ", " link")
SEGMENT_KEYWORD_WEIGHT, SEGMENT_KEYWORD_MAX = 0.3, 3
SEGMENT_LINK_WEIGHT, SEGMENT_LINK_MAX = 0.2, 2
SEGMENT_PATTERN_WEIGHT = 0.15
SEGMENT_KEEP_SCORE = 0.2
SEGMENT_MIN_CHARS = 10
SEGMENT_SHOWN_CHARS = 150
SEGMENTS_PER_EMAIL = 10
SEVERITY_HIGH, SEVERITY_MEDIUM = 60, 30

# Risk of a sender domain.
DOMAIN_RISK_UNKNOWN, DOMAIN_RISK_TRUSTED = 0.3, 0.0
DOMAIN_RISK_PART, DOMAIN_RISK_TLD, DOMAIN_RISK_OTHER = 0.8, 0.6, 0.1

# Risk of the links: by trusted share (at least) and by number of links (at most).
LINK_SHARE_RISKS = [(0.8, 0.1), (0.5, 0.3)]
LINK_COUNT_RISKS = [(0, 0.0), (1, 0.2), (3, 0.4), (5, 0.6)]
LINK_COUNT_RISK_MORE = 0.8
LINKS_TRUSTED_SHARE = 0.8

# Ensemble weights, trust factors, verdict cut points.
WEIGHT_MODEL, WEIGHT_URGENT, WEIGHT_LINKS, WEIGHT_DOMAIN = 0.60, 0.15, 0.15, 0.10
FACTOR_BOTH_TRUSTED, FACTOR_ONE_TRUSTED = 0.6, 0.8
DEFAULT_THRESHOLD = 0.5
SUSPICIOUS_MARGIN = 0.2
LEGITIMATE, SUSPICIOUS, PHISHING = "LEGITIMATE", "SUSPICIOUS", "PHISHING"
NOT_SCORED = "NOT_SCORED"  # no model probability, so no score
SCORE_DECIMALS = 6

# Threshold sweep of the evaluation, in order (the first best one wins).
SWEEP_THRESHOLDS = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]

# Body-length buckets: (name, upper bound, inclusive); a length of 0 has none.
LENGTH_BUCKETS = [
    ("<100", 100), ("100-500", 500), ("500-1K", 1000), ("1K-2K", 2000),
    ("2K-5K", 5000), ("5K-10K", 10000), ("10K-50K", 50000), (">50K", None),
]
EXTREME_LENGTH = 100000
MIN_BODY_CHARS = 10

# Model settings.
FEATURE_NUMERIC = ["has_attachment", "links_count", "urgent_keywords", "body_length", "exclamation_count"]
FEATURE_COLUMNS = ["text"] + FEATURE_NUMERIC + ["sender_domain"]
VOCABULARY_SIZE = 5000
TERMS_PER_CLASS = 30
TERM_VERDICT_CUT = 0.001
GBT_ROUNDS, GBT_DEPTH, GBT_RATE, GBT_ROW_SHARE, GBT_COLUMN_SHARE = 200, 6, 0.1, 0.8, 0.8
TEST_SHARE, SEED = 0.2, 42

# Dataset intake.
DATASET_SUFFIXES = [".csv", ".tsv", ".txt", ".json"]
SEPARATORS = [",", ";", "\t", "|"]
FINGERPRINT_CHARS = 16
FINGERPRINT_HEAD_BYTES = 2_000_000

# Store pages: (default, most) rows.
EMAIL_PAGE, HISTORY_PAGE = (50, 100), (100, 500)

# English stop words: the list of Spark's own stop-word remover.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll "
    "we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't "
    "mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would"
).split()

# Every match of a segment pattern holds one of these, so that most texts need no regular expression.
SEGMENT_PATTERN_LITERALS = [
    ["click"], ["verify"], ["password", "credit", "ssn", "bank"],
    ["suspended", "locked", "disabled", "expired"],
    ["winner", "prize", "reward", "gift", "free"], ["$", "money", "cash"],
]

# ------------------------------------------------- portable regular expressions
# Spelled so that Java, RE2 and Python read them alike.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same characters as a string.
WS_CHARS = "".join(
    chr(n)
    for first, last in [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
    for n in range(first, last + 1)
)
URL_RE = rf"(?i)(https?://[^{WS}]+|www\.[^{WS}]+)"
ADDRESS_RE = r"[\p{L}\p{N}_.-]+@([\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+)"
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
LINK_DOMAIN_RE = rf"(?:https?://)?(?:www\.)?([^/{WS}?&#]+)"
SEGMENT_SPLIT_RE = r"[.\n\r]+"

# HTML: parts that hold no text, then any other tag. Applied in this order.
HTML_DROP_RES = [
    r"(?is)<script[^>]*>.*?</script[^>]*>",
    r"(?is)<style[^>]*>.*?</style[^>]*>",
    r"(?s)<!--.*?-->",
    r"(?s)<![A-Za-z][^>]*>",
    r"(?s)</?[A-Za-z][^>]*>",
]
# Character references; the ampersand itself comes last.
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&"),
]
