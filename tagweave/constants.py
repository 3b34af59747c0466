"""Fixed values that results depend on. They are defaults of public parameters."""

# fixed value: lowest pair score that is kept as an edge
SCORE_THRESHOLD = 0.85
# fixed value: candidates in one scorer call
CHUNK_SIZE = 20

# fixed value: the tag that means "no information"
UNCATEGORIZED = "Uncategorized"

# fixed values: horizontal capability subsectors
HORIZONTAL_SUBSECTORS = (
    "AI Agent Platforms And Automation",
    "General Purpose AI Models",
    "AI World Models",
    "Speech & Audio AI",
)
# fixed values: sectors in which horizontal subsectors are legitimate
HORIZONTAL_SECTORS = ("AI & Machine Learning", "Developer Tools & Infrastructure")
# fixed values: horizontal tags the audit checks (the first is not in HORIZONTAL_SUBSECTORS)
AUDITED_HORIZONTALS = (
    "Horizontal Workflow Automation",
    "AI World Models",
    "General Purpose AI Models",
)
# fixed values: the generic tag and the tags that replace it
GENERIC_SUBSECTOR = "ERP & Business Operations"
REDIRECT_SUBSECTORS = (
    "Supply Chain & Logistics Automation",
    "ERP Modernization & Migration",
    "Productivity Tools",
)

# fixed values: classification thresholds
MIN_SECTOR_CONFIDENCE = 0.7
MIN_SUBSECTOR_CONFIDENCE = 0.9
MAX_SUB_SUBSECTORS = 4

# fixed values: review types and the verdicts of a taxonomy split
REVIEW_TYPES = (
    "taxonomy_split",
    "scraping_diagnostic",
    "redundant_uncategorized_cleanup",
    "empty_subsectors_backfill",
)
SPLIT_VERDICTS = ("isolated mis-tag", "structural gap", "scraping artifact", "ambiguous")

# fixed values: the readiness queue
READINESS_QUEUE = (
    "AI Agent Platforms And Automation",
    "AI Data & Training Infrastructure",
    "Threat Detection & Intelligence",
    "Supply Chain & Logistics Automation",
    "Payment And Fraud Solutions",
    "Field & Industrial Operations",
    "Financial Compliance Automation",
    "Cybersecurity Risk Management",
    "Embedded Financial Services",
    "API Infrastructure",
    "MLOps & Model Serving",
)
MIN_DIAGNOSED = 9
READINESS_WINDOW = 3

# fixed values: page gates
BLOCKING_PHRASES = (
    "enable javascript",
    "verify you are human",
    "checking your browser",
    "captcha",
    "access denied",
    "are you a robot",
    "unusual traffic",
)
MIN_LIGHT_CHARS = 200
MIN_CONTENT_CHARS = 500
SHORT_LINE_CHARS = 40
MAX_NOISE_RATIO = 0.85
MAX_TEXT_CHARS = 30_000
DIAGNOSIS_STREAK = 5
LOGO_EXTENSIONS = ("svg", "png", "jpg", "jpeg", "webp", "ico")
MAX_LOGO_IMAGES = 5
MAX_LOGO_CANDIDATES = 8

# fixed values: graph reports
MIN_COMMUNITY_SIZE = 3
MIN_SPLIT_MEMBERS = 3
MIN_DISTANCE = 1e-6

# fixed values: node colour of each sector, and of any other
SECTOR_COLOURS = {
    "AI & Machine Learning": "#4e79a7",
    "Cybersecurity": "#e15759",
    "SaaS & Enterprise Software": "#59a14f",
    "FinTech": "#f28e2b",
    "HealthTech": "#ff9da7",
    "Developer Tools": "#9c755f",
    "Robotics": "#bab0ac",
    "CleanTech": "#76b7b2",
    "EdTech": "#edc948",
    "E-commerce & Retail": "#b07aa1",
    "Marketing Tech": "#d4a6c8",
    "Deep Tech": "#499894",
    "Life Sciences": "#86bcb6",
    "Aerospace": "#8cd17d",
    "Energy": "#f1ce63",
    "Mobility": "#a0cbe8",
    "SpaceTech": "#c7a8d8",
    "Defense": "#d7b5a6",
}
DEFAULT_COLOUR = "#777"
