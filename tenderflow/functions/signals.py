"""Word lists, lookup tables and formats that results depend on. Kept as plain text."""

# Characters removed by a default trim.
TRIM_CHARS = " \t\n\r\0\x0b"

# Two-digit sector prefixes of an acceptable industry code.
NAICS_SECTORS = [
    "11", "21", "22", "23", "31", "32", "33", "42", "44", "45", "48", "49",
    "51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "81", "92",
]
# The only acceptable six-digit codes that begin with 926.
NAICS_926 = ["926110", "926120", "926130", "926140", "926150", "926160"]
# Code used when nothing else is found.
NAICS_DEFAULT = "921190"
# Keywords to industry code, in order of precedence.
NAICS_KEYWORDS = [
    (["software", "saas", "it services", "cloud", "system", "platform"], "541512"),
    (["data center", "hosting"], "518210"),
    (["record", "records management", "document management", "archives", "land records"], "519190"),
    (["web", "website"], "541511"),
    (["cyber", "security"], "541519"),
    (["consulting", "professional services"], "541611"),
    (["engineering"], "541330"),
    (["telecom", "telecommunications"], "517919"),
    (["janitorial", "custodial", "cleaning"], "561720"),
    (["landscape", "mowing", "grounds", "lawn"], "561730"),
    (["waste", "trash", "recycling", "garbage"], "562111"),
    (["construction", "renovation", "remodel", "building"], "236220"),
    (["roof", "roofing"], "238160"),
    (["electrical"], "238210"),
    (["hvac", "mechanical", "plumbing"], "238220"),
    (["road", "street", "paving", "asphalt", "bridge"], "237310"),
]

# Substrings that mark a restricted third-party portal URL.
PORTAL_MARKERS = ["demandstar", "vendorlink", "bidnetdirect", "publicpurchase"]
# Host suffixes of procurement portals that are not buying agencies.
PORTAL_HOST_SUFFIXES = [
    "bonfirehub.com", "planetbids.com", "ionwave.net", "publicpurchase.com",
    "vendorlink.com", "bidnetdirect.com", "demandstar.com", "public-portal.us.workdayspend.com",
]
# Host suffixes of portals whose listings are drawn by scripts, and of those that also take long to draw.
SCRIPT_LISTING_HOSTS = ["bidnetdirect.com", "vendorregistry.com", "demandstar.com", "publicpurchase.com", "pr-webs-customer.des.wa.gov"]
HEAVY_PORTAL_HOSTS = ["bonfirehub.com", "bidnetdirect.com", "pr-webs-customer.des.wa.gov"]
# Portal vendor names removed from organization names.
PORTAL_VENDOR_PATTERNS = [
    r"\bbonfire\s*hub\b", r"\bbidnet\s*direct\b", r"\bdemandstar\b", r"\bplanet\s*bids\b",
    r"\bionwave\b", r"\bpublic\s*purchase\b", r"\bvendorlink\b", r"\bworkday\s*spend\b",
]
# Characters trimmed from an organization name afterwards.
ORG_TRIM_CHARS = " \t\n\r\0\x0b,-·|—–"
# Words that carry no weight in a name.
NAME_STOP_WORDS = [
    "the", "and", "for", "of", "city", "county", "state", "department", "dept",
    "school", "district", "public", "services",
]
# Labels that introduce an organization name in free text.
ORG_LABELS = [
    r"Awarding\s+Agency", r"Agency", r"Issuing\s+organization", r"Issuing\s+Organization",
    r"Buyer", r"Procuring\s+Entity", r"Department", r"School\s+District",
]
# US state and district codes.
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
    "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR",
    "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

# First lines that mean an address or phone was not given.
SNIPPET_PLACEHOLDERS = ["n/a", "na", "unknown", "none", "tbd", "—", "-"]
# Heading of the contact block added to a description.
CONTACT_HEADING = "---\n**Issuing entity — address & phone**"
# Texts used when a description is missing.
NO_TEXT = "No PDF or description found."
NO_DESCRIPTION = "No description or PDF link found."

# Titles that never name a solicitation.
GENERIC_TITLES = [
    "home", "contact", "about", "document", "documents", "news", "events", "calendar",
    "bids.aspx", "bidding page", "portal", "webs",
]
# Words that make a record look like a solicitation.
BID_WORDS = "(bid|bids|rfp|rfq|rfi|tender|solicitation|proposal|invitation)"
# Phrases of geo-blocked pages.
GEO_BLOCK_PHRASES = ["blocked country", "geolocation", "watchguard", "connection was denied because this country"]
# One portal with an extra rule.
WEBS_PORTAL_HOST = "pr-webs-customer.des.wa.gov"

# Page signals.
BROWSER_CHECK_PHRASES = [
    "please wait while we are checking your browser", "browser check", "checking your browser", "dom is busy",
]
BLOCKED_PHRASES = [
    "blocked country", "sorry, you have been blocked", "unable to access", "cloudflare", "geolocation setting",
    "connection was denied because this country", "watchguard", "wrong captcha answer", "recaptcha",
]
SPA_MARKERS = [
    '<div id="root"', '<div id="app"', '<div id="__next"', '<div id="__nuxt"', "window.__INITIAL_STATE__",
    "window.__NEXT_DATA__", "ng-app=", "ng-version=", "data-reactroot",
]
# Words that a login page of a listing still shows.
LOGIN_BID_WORDS = (
    "(bid|bids|rfp|rfq|rfi|tender|solicitation|proposal|invitation|procurement|bid opportunities|"
    "current bids|open bids|closing date|bids due)"
)
NO_OPEN_PHRASES = [
    "no open bid", "no open bids", "no open solicitations", "no open opportunities", "no bid postings",
    "there are no bids", "no current bids", "no current solicitations", "no open procurement",
    "no opportunities available", "there are no open bid postings",
]
# Phrases and codes of open solicitations.
OPEN_PHRASES = [
    "/solicitations/open-bids/", "open solicitations tab", "solicitation number", "published date",
    "closing date", "bid opportunity", "bid opportunities",
]
OPEN_CODE_PATTERN = r"(?i)\b(ifb|rfp|rfq|itb|rfb|ifq|ib|ipwb)[- ][a-z0-9]{2,}"
OPEN_COUNT_PATTERN = r"(?i)(\d+)\s+open\s+solicitation"
PLATFORM_MARKERS = ["granicus", "powered by granicus", "opengov_open_search", "og-bid-listing"]
DETAIL_PATH_PATTERN = r"""(?i)\bhref=(["'])([^"']*/Bids/[^"']+)\1"""

# Words that rule a linked document out, then words that rule it in.
DOC_NEGATIVE = [
    "accessibility", "americans with disabilities", "annual report", "ap contacts", "ap-contact",
    "background check", "brochure", "code report", "contact guide", "ethics", "manual", "mission", "policy",
    "procedure", "procurement code", "responsible contractor policy", "social media", "standard terms",
    "suspended", "debarred", "terms and conditions", "vendor guide", "vision", "w-9", "w9", "protest protocol",
    "pc_protest", "spirit airlines shutdown", "shutdown flymco",
]
# Words that rule a linked document in.
DOC_POSITIVE = [
    "addendum", "amendment", "bid", "bids", "formalbid", "formal bid", "ifb", "invitation", "itb", "proposal",
    "quote", "request for", "rfi", "rfp", "rfq", "solicitation", "specification", "tender",
]
DOC_ID_PATTERN = r"(?i)\b[a-z]{1,6}\d{2,}[-_a-z0-9]*\b"
# Words of links to single solicitations.
DETAIL_LINK_WORDS = "bid|rfp|rfq|tender|solicitation|proposal|opportunit"
# The host whose pages carry a project description.
TRADE_JOURNAL_HOST = "compliancenews.com"
DOCUMENT_SEPARATOR = "\n\n----- NEXT DOCUMENT -----\n\n"

# Characters per excerpt of a crawled page, and the budget for all pages of a listing.
EXCERPT_CAPS = {"text": 16000, "html": 6000, "pdf_text": 9000}
EXCERPT_BUDGET = 34000

# Defaults of an ingested record.
SUBSCRIPTION_TYPE = 10
SET_ASIDE_CODE = 1
DEFAULT_GROUP = "Test"
DIRECTORY_ZONE = "Asia/Manila"
PUBLIC_LINK_BASE = "/bids/ShowBid/"  # path of the record page; put the host of the public site before it

# Accepted date shapes (a pattern that the text must match, and its format).
DATE_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [ap]m$", "M/d/yyyy h:mm a"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"(?i)^[A-Z][a-z]{2,} \d{1,2}, \d{4} \d{1,2}:\d{2} [ap]m$", "MMMM d, yyyy h:mm a"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2,} \d{4}$", "d MMMM yyyy"),
]
