"""Fixed values that results depend on: label sets, thresholds, word lists and patterns."""

# --- label sets (fixed values) ---
CATEGORIES = ("Work", "Personal", "Other")
BUCKETS = ("low", "medium", "high")
SPAM_LABELS = ("spam", "ham")
MODELS = ("category", "priority", "spam")
STATUSES = ("active", "rejected", "superseded")
MAX_CUSTOM_LABEL_CHARS = 40

# --- cut-offs (fixed values) ---
SPAM_THRESHOLD = 0.5
BUCKET_MEDIUM_FROM = 0.35
BUCKET_HIGH_FROM = 0.55
SCORE_MIN = 0.1
SCORE_MAX = 1.0
SENTIMENT_CUT = 0.05
BUCKET_SCORE = {"low": 0.2, "medium": 0.5, "high": 0.8}
SPAM_TARGET = {"ham": 0, "spam": 1}
MIN_CLEAN_CHARS = 10

# --- personalisation limits (fixed values) ---
RETRAIN_THRESHOLD = 5
CORRECTION_WEIGHT = 10.0
SWEEP_WEIGHTS = (1.0, 3.0, 10.0, 30.0)
OWN_CORRECTION_MIN = 0.80
MAX_GATE_DROP = 0.03
MAX_CUSTOM_FRACTION = 0.10
REPRODUCE_TOLERANCE = 1e-6

# --- confidence gate per predicted class (fixed values) ---
GATE_THRESHOLDS = {"Work": 0.60, "Other": 0.80, "Personal": 0.75}

# --- feature column order (fixed values) ---
HEADER_COLS = (
    "n_recipients", "is_reply_or_forward", "sender_automated", "has_list_unsubscribe",
    "has_precedence_bulk", "hour_sin", "hour_cos", "is_weekend", "is_business_hours",
)
STYLE_COLS = (
    "text_len_log", "excl_density", "caps_word_count", "informal_greeting", "formal_greeting",
    "family_words", "formal_closing", "informal_closing", "question_count",
)
KEYWORD_COLS = ("kw_high", "kw_med", "kw_low", "excl_subj")
CATEGORY_NUMERIC = HEADER_COLS[:5] + STYLE_COLS
PRIORITY_NUMERIC = HEADER_COLS[:3] + STYLE_COLS + ("spam_conf", "vader_compound") + KEYWORD_COLS

# --- words a transport layer adds to flattened mail (fixed values) ---
ROUTING_WORDS = (
    "received", "delivered", "return", "path", "message", "mime", "version", "content", "type",
    "transfer", "encoding", "disposition", "precedence", "errors", "references", "reply",
    "organization", "status", "esmtp", "smtp", "postfix", "sendmail", "qmail", "exim", "fetchmail",
    "localhost", "imap", "pop3", "mandark", "webnote", "xent", "jmason",
)

# --- sender local parts that mark automated mail (fixed values) ---
AUTOMATED_SENDER = (
    r"no[\-_]?reply", r"do[\-_]?not[\-_]?reply", r"mailer[\-_]?daemon", "support", "notifications?",
    "alerts?", "updates?", "digest", "newsletter", "bounces?", "postmaster",
)
REPLY_PREFIXES = ("re", "fw", "fwd")

# --- style and keyword word lists (fixed values) ---
INFORMAL_GREETING = ("hey", r"hi\s+\w+", "hiya", "yo", "sup")
FORMAL_GREETING = (r"dear\s+\w+", r"to\s+whom\s+it\s+may\s+concern", "greetings")
FAMILY_WORDS = ("mom", "dad", "mother", "father", "honey", "sweetie", r"love\s+you", "xoxo", "dearest")
FORMAL_CLOSING = ("regards", "sincerely", r"best\s+regards", "respectfully")
INFORMAL_CLOSING = ("cheers", r"talk\s+soon", "luv", "later", "ttyl")
HIGH_WORDS = (
    "urgent", "asap", "emergency", "critical", r"escalat\w*", "breach", "outage", "deadline",
    "overdue", "end of day", "eod", "cob", "due by", "expires?", "right away", "time sensitive",
    "crisis", "disaster", "lawsuit", "legal action", "margin call", "default", r"liquidat\w*",
)
MEDIUM_WORDS = (
    "action required", "please respond", "please advise",
    r"need your (approval|input|sign[\s\-]?off)", "response needed", "follow up", "reminder",
)
LOW_WORDS = (
    "unsubscribe", "newsletter", "fyi", "for your information", "no action needed", "digest",
    "weekly update", "monthly report", "do not reply", "automatic notification", "out of office",
    "calendar invite", "meeting reminder", "rescheduled",
)
GREETING_CHARS = 100
CLOSING_CHARS = 200
CAPS_CAP = 10
QUESTION_CAP = 5

# --- folder name to weak label, and folders too noisy to use (fixed values) ---
FOLDER_LABELS = {
    "Work": (
        "inbox", "sent", "_sent_mail", "sent_mail", "sent_items", "sent messages",
        "discussion_threads", "notes_inbox", "calendar", "meetings", "schedule_crawler",
        "logistics", "wellhead", "projects", "contracts", "legal", "hr", "finance", "trading",
        "operations", "administrative", "to do", "action items", "tasks", "follow up", "important",
    ),
    "Personal": ("personal", "personal folders", "family", "friends", "personal email"),
    "News/Newsletter": ("enron announcements", "news", "newsletters"),
    "Mailing List": ("mailing lists", "lists", "forums", "discussion", "ces", "_americas"),
}
SKIP_FOLDERS = (
    "all_documents", "all documents", "deleted_items", "deleted items", "trash", "junk",
    "archiving", "archive", "attachments", "c",
)

# --- display links (fixed values) ---
MAX_LINK_LABEL = 36

# --- word-level sentiment modifiers: negation and degree words, and their published weights ---
NEGATION_SCALAR = -0.74
BOOSTER_STEP = 0.293
BOOSTER_DAMP = (1.0, 0.95, 0.9)
NORMALISER_ALPHA = 15.0
NEGATIONS = ("not", "no", "never", "none", "cannot", "without", "neither", "nor", "nothing", "nowhere")
BOOSTERS_UP = ("very", "really", "extremely", "absolutely", "completely", "totally", "so", "incredibly")
BOOSTERS_DOWN = ("slightly", "somewhat", "barely", "hardly", "almost", "marginally")

# --- class-mix recipe of the spam training set (fixed values) ---
MIX_SPAM, MIX_HAM, MIX_OTHER_HAM = 500, 300, 700

# --- shown name and form of each numeric column (fixed values) ---
SIGNALS = {
    "n_recipients": ("Recipients", "log count"),
    "is_reply_or_forward": ("Reply or forward", "yes or no"),
    "sender_automated": ("Sent from an automated address", "yes or no"),
    "has_list_unsubscribe": ("Has an unsubscribe link", "yes or no"),
    "has_precedence_bulk": ("Marked as bulk mail", "yes or no"),
    "text_len_log": ("Length", "log characters"),
    "excl_density": ("Exclamation marks", "per thousand"),
    "caps_word_count": ("Words in capitals", "count"),
    "informal_greeting": ("Informal greeting", "yes or no"),
    "formal_greeting": ("Formal greeting", "yes or no"),
    "family_words": ("Family words", "yes or no"),
    "formal_closing": ("Formal sign-off", "yes or no"),
    "informal_closing": ("Informal sign-off", "yes or no"),
    "question_count": ("Question marks", "count"),
    "spam_conf": ("Spam score", "percent"),
    "vader_compound": ("Tone (−1 negative, 1 positive)", "two digits"),
    "kw_high": ("Urgent words", "count"),
    "kw_med": ("Request words", "count"),
    "kw_low": ("For-your-information words", "count"),
    "excl_subj": ("Exclamation marks in subject", "count"),
}
