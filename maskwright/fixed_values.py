"""Fixed values.

These are the label names, limits, word lists and patterns a result depends on. They are data,
not logic: changing one of them changes which characters are masked. Patterns are written in the
Python ``re`` dialect and translated for the JVM by :mod:`maskwright.functions.regex`.
"""

# Labels a detector may return.
LABELS = [
    "private_person",
    "private_email",
    "private_phone",
    "private_address",
    "private_url",
    "private_date",
    "account_number",
    "secret",
]

# Label used for ranges a reviewer adds by hand.
MANUAL_LABEL = "manual"

# Display priority, most urgent first.
LABEL_ORDER = [
    "secret",
    "account_number",
    "private_address",
    "private_person",
    "private_email",
    "private_phone",
    "private_date",
    "private_url",
]

# Detection rules, as (rule name, label, pattern).
RULES = [
    (
        "secret",
        "secret",
        r"(?i)\b(?:sk-[A-Za-z0-9_\-]{16,}|ghp_[A-Za-z0-9]{20,}|"
        r"AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,}|"
        r"Bearer\s+[A-Za-z0-9._\-]{20,}|"
        r"(?:api[_-]?key|token|password|passwd|secret)\s*[:=]\s*[^\s,;]{6,})",
    ),
    (
        "account",
        "account_number",
        r"\b(?:(?:\d[ -]?){13,19}|\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{2}[A-Z0-9]{10,30}|\d{9,12})\b",
    ),
    ("email", "private_email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    (
        "phone",
        "private_phone",
        r"(?:(?<=\s)|(?<=^))(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])"
        r"\d{3,4}[\s.-]?\d{3,4}(?=[\s.,;:]|$)",
    ),
    ("url", "private_url", r"https?://[^\s<>\"']+"),
    (
        "date",
        "private_date",
        r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
        r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}"
        r"|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})\b",
    ),
    (
        "address",
        "private_address",
        r"\b\d{1,5}\s+[A-Z][A-Za-z.]+(?:\s+[A-Z][A-Za-z.]+){0,4}"
        r"\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|"
        r"Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Way|Plaza|Terrace|Parkway|Pkwy\.?|Circle)\b"
        r"(?:,\s*(?:Apt\.?|Suite|Ste\.?|Unit)\s*\d+)?",
    ),
    (
        "person_hint",  # the span is group 1, the name after the greeting
        "private_person",
        r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|"
        r"I am|My name is|Regards,|Sincerely,|Best,|Cheers,|Thanks,|Thank you,|From:|To:|Dear)\s*"
        r"([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,2})",
    ),
    ("person_loose", "private_person", r"\b[A-Z][a-z]{2,}[ \t]+[A-Z][a-z]{2,}\b"),
]

# Key names and header names of the credential policy.
CREDENTIAL_KEYS = r"(?:api[_-]?key|token|password|passwd|secret)"
CREDENTIAL_HEADERS = ["Authorization", "Proxy-Authorization", "Cookie", "Set-Cookie"]

# Use cases of the sharing policy and the fields each of them must supply, in processing order.
USE_CASE_FIELDS = {
    "support_ticket": ["text"],
    "ai_prompt": ["text"],
    "email": ["sender", "recipients", "subject", "body"],
}
ROUTING_FIELDS = ["sender", "recipients"]
POLICY_VERSION = "2026-09-30.4"

# Limits of a request sent to a service. Tables have none; `prepare` flags them on demand.
REQUEST_LIMITS = {
    "text_chars": 16_000,
    "manual_masks": 128,
    "findings_per_field": 512,
    "recipients": 20,
    "body_bytes": 65_536,
}
RECEIPT_CHARS = 43

# Review receipts.
RECEIPT_LIFE_SECONDS = 600
MAX_PENDING_REVIEWS = 256
MAX_EVENTS_LISTED = 128
REVIEW_ACTOR = "configured_operator"

# Evaluation.
GROUP_NAME = r"[a-z][a-z0-9_-]{0,31}"
ERROR_COUNTS = [
    "false_positives",
    "false_negatives",
    "unredacted_sensitive_characters",
    "extra_redacted_characters",
]
OFFSET_UNIT = "unicode_code_points"
SCHEMA_VERSION = 1
