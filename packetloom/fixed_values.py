"""Fixed values.

Everything in this module is a constant whose exact value decides a result:
thresholds, weights, word lists, patterns and output formats. They are kept
together, in natural order, so that they can be reviewed in one place. The
operators only read them; most operators also take them as parameters.
"""

# --- value sets -----------------------------------------------------------
RULE_ACTIONS = ("allow", "block")
RULE_MATCH_TYPES = ("ip_src", "ip_dst", "port", "domain", "keyword")
DEFAULT_PRIORITY = 100

# --- file signatures, in test order (hex of the leading bytes -> kind) ----
# The MPEG audio signature FFFB is recognised but maps to no kind, so it is
# simply absent here.
FILE_MAGIC = [
    ("25504446", "document"),          # %PDF
    ("89504E470D0A1A0A", "image"),     # PNG
    ("FFD8FF", "image"),               # JPEG
    ("47494638", "image"),             # GIF8
    ("504B0304", "document"),          # ZIP container
    ("4D5A", "executable"),            # MZ
    ("7F454C46", "executable"),        # ELF
]
SNIFF_WINDOW_BYTES = 1024
ENTROPY_LIMIT = 7.5

# --- text detectors -------------------------------------------------------
SECRET_PATTERNS = [
    # (finding name, plain text that every match contains, lower-case?, regex)
    ("AWS Access Key", "AKIA", False, r"AKIA[0-9A-Z]{16}"),
    # The class below is the range backslash..underscore, so "-" is excluded.
    ("Google API Key", "AIza", False, r"AIza[0-9A-Za-z\\-_]{35}"),
    ("Private Key Header", "-----BEGIN ", False, r"-----BEGIN (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----"),
    ("Generic Secret", None, True, r"(?i)(api_key|secret|password)[\s]*=[\s]*['\"][0-9a-zA-Z\-_]{16,}['\"]"),
]
GENERIC_SECRET_WORDS = ("api_key", "secret", "password")
RCE_MARKERS = ("eval(", "exec(", "os.system(")
RCE_FINDING = "Potential RCE (Remote Code Execution) pattern"
SECRET_SCORE = 1.0
RCE_SCORE = 0.7
CONTEXT_SCORE = 0.1

# (entity, score, confidence shown in the finding)
PII_ENTITIES = [
    ("PHONE_NUMBER", 0.4, "0.40"),
    ("EMAIL_ADDRESS", 0.4, "1.00"),
    ("IBAN", 0.9, "1.00"),
    ("CREDIT_CARD", 0.9, "1.00"),
    ("US_SSN", 0.9, "0.50"),
]
PII_PATTERNS = {
    "PHONE_NUMBER": r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b(?:\+?1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    # The look-behind keeps long tokens without "@" from being scanned once per character.
    "EMAIL_ADDRESS": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IBAN": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "CREDIT_CARD": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}

SEMANTIC_HIGH = (0.5, 0.8)    # similarity above -> score
SEMANTIC_LOW = (0.35, 0.4)

# --- document content classes --------------------------------------------
KEYWORD_BUCKETS = [
    ("internal financial balance sheet", [
        r"\bbalance sheet\b",
        r"\bquarterly (?:revenue|earnings)\b",
        r"\binternal financial\b",
    ]),
    ("confidential legal contract", [
        r"\bconfidential\b",
        r"\bnon[- ]disclosure\b",
        r"\bnda\b",
        r"\battorney[- ]client\b",
    ]),
    ("employee personal record with salary", [
        r"\bsalary\b",
        r"\bsocial security number\b",
        r"\bssn\b",
        r"\bpayroll\b",
    ]),
    ("source code listing with credentials", [
        r"api[_ ]?key\s*[=:]",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        r"AKIA[0-9A-Z]{16}",
    ]),
    ("network diagram with internal ip addresses", [
        r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
        r"\b192\.168\.\d{1,3}\.\d{1,3}\b",
        r"\b172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}\b",
    ]),
]
# Lower-case text contained in every match of the pattern of the same place.
KEYWORD_GUARDS = [
    ["balance sheet", "quarterly ", "internal financial"],
    ["confidential", "disclosure", "nda", "attorney"],
    ["salary", "social security number", "ssn", "payroll"],
    ["key", "-----begin ", "akia"],
    ["10.", "192.168.", "172."],
]
SENSITIVE_DOCUMENT_CLASSES = (
    "internal financial balance sheet",
    "confidential legal contract",
    "non-disclosure agreement",
    "source code listing with credentials",
    "network diagram with internal ip addresses",
    "employee personal record with salary",
)
KEYWORD_BASE, KEYWORD_STEP, KEYWORD_CAP = 0.5, 0.15, 0.95

# --- byte signatures ------------------------------------------------------
EICAR = "X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"
# A rule is true when the payload starts with `starts` (if given) and one of
# the groups in `any_of` has all of its byte strings present. Strings are
# latin-1 text of the bytes.
SIGNATURES = [
    dict(name="EICAR_Test_String", severity="test",
         description="EICAR antivirus test signature (regression marker)",
         starts=None, any_of=[[EICAR]]),
    dict(name="Office_VBA_Macro_Project", severity="high",
         description="Office document containing a VBA macro project (vbaProject.bin)",
         starts="PK\x03\x04", any_of=[["vbaProject.bin"]]),
    dict(name="PDF_JavaScript_Launcher", severity="high",
         description="PDF containing /JavaScript or /OpenAction auto-launch keys",
         starts="%PDF",
         any_of=[["/JavaScript", "/OpenAction"], ["/JS", "/OpenAction"], ["/Launch"],
                 ["/AA", "/JavaScript"], ["/AA", "/JS"]]),
    dict(name="PDF_Embedded_Executable", severity="critical",
         description="PDF with embedded file stream containing Windows/Linux executable header",
         starts="%PDF",
         any_of=[["/EmbeddedFile", "MZ"], ["/EmbeddedFile", "\x7fELF"]]),
    dict(name="Office_Equation_Editor_CVE_2017_11882", severity="critical",
         description="OLE equation editor object commonly abused for CVE-2017-11882",
         starts=None, any_of=[["Equation Native"], ["Microsoft Equation 3.0"]]),
]
SIGNATURE_SCORE, SIGNATURE_CRITICAL_SCORE = 0.95, 0.99
HASH_INTEL_SCORE = 0.99

# --- document metadata ----------------------------------------------------
PATH_LEAK_PATTERNS = [
    (r'(?i)C:\\Users\\[^\\"\s]+', "c:"),
    (r'/home/[^/\s"]+/', "/home/"),
    (r'/Users/[^/\s"]+/', "/users/"),
]
PRODUCER_KEYS = ("producer", "Producer", "creator", "Creator", "creatorTool")
KNOWN_PRODUCERS = (
    "microsoft word", "microsoft excel", "microsoft powerpoint", "microsoft office",
    "libreoffice", "openoffice", "adobe", "acrobat", "chromium", "chrome", "skia",
    "macos", "preview", "pages", "tex", "latex", "pdftex", "xetex", "luatex",
    "pdfkit", "wkhtmltopdf", "mupdf", "pymupdf", "ghostscript",
)
SUSPICIOUS_PRODUCERS = ("metasploit", "msfvenom", "cobaltstrike", "empire", "exploit", "payload")
METADATA_HIT, METADATA_UNKNOWN, METADATA_CAP = 0.25, 0.1, 0.9

# --- document structure ---------------------------------------------------
STRUCTURE_FEATURES = [
    "javascript", "openaction", "aa", "launch", "embeddedfile", "xfa", "acroform",
    "object_count", "stream_count", "page_count", "entropy",
    "vba_project", "ole_object", "external_rels", "embedded_files",
]
PDF_KEYS = [
    ("/JavaScript", "javascript"), ("/JS", "javascript"), ("/OpenAction", "openaction"),
    ("/AA", "aa"), ("/Launch", "launch"), ("/EmbeddedFile", "embeddedfile"),
    ("/XFA", "xfa"), ("/AcroForm", "acroform"),
]
# Pages of a PDF whose text is read.
PDF_PAGES = 5
HARD_STRUCTURE_FEATURES = ("javascript", "openaction", "vba_project")
HARD_STRUCTURE_SCORE = 0.7
FOREST = dict(trees=200, sample=256, rows=1024, contamination=0.05, seed=42, gain=5.0)
# Envelope of harmless documents: (feature, lowest, highest, drawn as integer?)
FOREST_ENVELOPE = [
    ("object_count", 3, 400, True), ("stream_count", 0, 80, True), ("page_count", 1, 60, True),
    ("entropy", 4.5, 7.6, False),
]
FOREST_ACROFORM_RATE = 0.15

# --- image model outputs --------------------------------------------------
OCR_KEYWORDS = ("confidential", "secret", "password", "private key", "internal use only",
                "revenue", "q1", "q2", "q3", "q4", "budget", "ssn")
OCR_SCORE = 0.9
IDENTITY_TERMS = ("passport", "id card", "cnic", "identity", "nsfw", "porn", "nude", "lingerie")
SENSITIVE_IMAGE_LABELS = (
    "proprietary source code screenshot with api keys",
    "internal financial spreadsheet with sensitive data",
    "server network diagram with ip addresses",
    "official id card passport document",
    "pakistani cnic national identity card",
    "smart identity card with chip",
    "nsfw nude explicit sexual content",
    "pornography and adult content",
    "bikini lingerie or semi-nude person",
    "architectural blueprint of secure facility",
    "microsoft office 365 or outlook login page with logo",
    "google or gmail account sign in page with logo",
    "apple id icloud sign in page with logo",
    "paypal payment or login page with logo",
    "amazon account sign in page with logo",
    "facebook or meta login page with logo",
    "instagram login page with logo",
    "linkedin login page with logo",
    "netflix or streaming service login with logo",
    "dropbox or cloud storage login page with logo",
    "whatsapp or telegram login page with logo",
    "bank login page with financial institution logo",
    "cryptocurrency exchange logo like binance coinbase kraken",
    "internal corporate document with company logo header",
    "employee id badge with company logo",
    "corporate presentation slide with company branding",
    "confidential report watermarked with company logo",
)
IDENTITY_MIN, IDENTITY_SCORE = 0.4, 0.95
SENSITIVE_MIN, SENSITIVE_CONFIRMED, SENSITIVE_ALONE = 0.6, 0.9, 0.5
RISKY_DEVICE_CLASSES = (63, 67)
DEVICE_MIN, DEVICE_SCORE, OBJECT_MIN = 0.5, 0.4, 0.6
STEGO_DISTANCE, STEGO_SCORE = 0.005, 0.3
STEGO_FINDING = "Suspicious LSB pattern detected (Possible Steganography)"

# --- verdicts -------------------------------------------------------------
BLOCK_ABOVE, WARN_ABOVE = 0.8, 0.5
DOCUMENT_WEIGHTS = {"malware": 0.4, "structure": 0.25, "content": 0.20, "metadata": 0.15}
IMAGE_WEIGHTS = {"semantic_clip": 0.4, "ocr": 0.3, "stego": 0.2, "object_detection": 0.1}
DEFAULT_REASON = "No threats detected"

# --- threat labels: first substring found in the reason decides -----------
THREAT_LABELS = [
    ("sql", "SQL Injection", "high", 0.94),
    ("xss", "Cross-Site Scripting", "high", 0.90),
    ("injection", "Command Injection", "critical", 0.98),
    ("malware", "Malware Payload", "critical", 0.96),
    ("eicar", "EICAR Test Signature", "medium", 0.99),
    ("pii", "PII Exfiltration", "high", 0.92),
    ("dlp", "Data Loss Prevention", "high", 0.90),
    ("brute", "Brute Force", "medium", 0.85),
    ("scan", "Port Scan", "low", 0.72),
    ("credential", "Credential Stuffing", "high", 0.91),
    ("phish", "Phishing Attempt", "high", 0.88),
    ("nsfw", "NSFW Content", "medium", 0.86),
    ("api key", "API Key Leak", "critical", 0.95),
    ("api_key", "API Key Leak", "critical", 0.95),
]
THREAT_DEFAULT = ("Anomalous Content", "medium", 0.80)

LAN_PREFIXES = ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "127.")
REGION_BUCKETS = ("US", "DE", "GB", "RU", "CN", "NL", "BR", "IN", "FR", "JP")
PROTOCOL_NAMES = {"TCP": "HTTPS / TLS 1.3", "UDP": "DNS / UDP", "ICMP": "ICMP", "HTTP": "HTTP / 1.1"}
RULE_CATEGORIES = {"ip_src": "Network", "ip_dst": "Network", "port": "Network",
                   "domain": "Allowlist", "keyword": "WAF"}
UPLOAD_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "webp")
NO_BYTES = "\u2014"

# --- flow cache and telemetry --------------------------------------------
RESCAN_PACKETS, CACHE_TTL_SECONDS = 50, 10
SERIES_SECONDS, SERIES_POINTS = 3, 48
LATENCY_SAMPLES, P95 = 100, 0.95
PROTOCOL_ROWS, REGION_ROWS = 6, 8
BUFFER_LIMIT_BYTES = 10 * 1024 * 1024
