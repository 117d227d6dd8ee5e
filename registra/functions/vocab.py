"""Default vocabularies. Every operator that uses one takes it as a parameter.

The values in this module are fixed: results depend on exactly these words, codes and limits.
"""

CATEGORIES = ["Vendime", "Prokurime", "Konsultime publike"]
NATIONWIDE_CATEGORY = "Prokurime"
STATUSES = ["draft", "published", "archived"]
YEARS = (2000, 2100)
CONSULTATION_FLOOR = 2023
CURRENCIES = ["ALL", "EUR", "USD"]

# Operator prefixes and exact authority names that are matched to municipalities.
OPERATOR_PREFIXES = [
    "NDERMARRJA E SHERBIMEVE PUBLIKE",
    "NDERMARRJA E PASURIVE PUBLIKE",
    "NDERMARRJA E PASTRIMIT",
    "AGJENCIA E SHERBIMEVE PUBLIKE",
    "AGJENCIA E SHERBIMEVE PUBLIKE RURALE",
    "NDERMARRJA RRUGA",
    "QENDRA EKONOMIKE E ARSIMIT",
    "QENDRA E ARTIT DHE E KULTURES",
    "SHOQERIA RAJONALE UJESJELLES KANALIZIME",
    "UJESJELLES KANALIZIME",
    "NDERMARRJA E SHERBIMEVE KOMUNALE",
    "NDERMARRJA E GJELBERIMIT",
    "NDERMARRJA E MIREMBAJTJES SE RRUGEVE",
]
EXACT_AUTHORITIES = {
    "QENDRA E ARTIT DHE E KULTURES KORCE": "korce",
    "QENDRA EKONOMIKE E ARSIMIT BASHKIA KUCOVE": "kucove",
    "SHKOLLA E MESME TREGTARE VLORE": "vlore",
}
GENITIVE_SUFFIXES = ["S", "SE", "IT", "UT"]

# Header keywords of procurement exports, in order of preference.
AUTHORITY_HEADERS = ["autoriteti kontraktor", "autoritet kontraktor", "autoriteti kontraktues", "autoritet kontraktues", "emri i autoritetit kontraktor", "emri i autoritetit kontraktues", "contracting authority", "authority"]
TITLE_HEADERS = ["objekti i kontrates", "objekti i prokurimit", "object of contract", "object", "pershkrimi", "description", "title", "procedure"]
DATE_HEADERS = ["data e publikimit", "publication date", "date of publication", "publikimit", "date", "data"]
DETAIL_HEADERS = ["link", "url", "details", "detail", "notice", "njoftim", "document", "dokument", "file"]
ITEM_PROCEDURE_HEADERS = ["numri i references", "nr i references", "nr reference", "reference no", "reference number", "procedure id", "id procedure"]
RECORD_PROCEDURE_HEADERS = ["numri i references", "nr reference", "reference number", "procedure id", "id procedure"]
AMOUNT_HEADERS = ["vlera", "vlera e fondit", "fondi limit", "fondi limit i kontrates", "contract value", "estimated value", "value", "cmimi"]
CURRENCY_HEADERS = ["monedha", "currency", "valuta"]
SUPPLIER_HEADERS = ["operatori ekonomik", "fituesi", "furnitori", "supplier", "economic operator", "contractor"]
CPV_HEADERS = ["cpv", "cpv code", "kodi cpv", "kode cpv"]
PROCEDURE_TYPE_HEADERS = ["lloji i procedures", "lloji i prokurimit", "procedure type", "type of procedure"]

# Words that keep, reject or label documents.
NOT_DECISIONS = ["plani", "aktivit", "program", "raport"]
ACTION_LABELS = ["shiko", "lexo", "lexo me shume", "download", "shkarko", "view"]
GENERIC_LABELS = ["njoftim", "njoftime", "bashkia"]
AGGREGATOR_HOSTS = ["vendime.al", "www.vendime.al"]
DOWN_ERRORS = ["UPSTREAM_DOWN", "TLS_CERT_EXPIRED", "TLS_SELF_SIGNED", "TLS_UNVERIFIED_CHAIN"]
NETWORK_CODES = ["ENOTFOUND", "EAI_AGAIN", "ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "UND_ERR_CONNECT_TIMEOUT"]
TLS_CODES = {"CERT_HAS_EXPIRED": "TLS_CERT_EXPIRED", "DEPTH_ZERO_SELF_SIGNED_CERT": "TLS_SELF_SIGNED", "UNABLE_TO_VERIFY_LEAF_SIGNATURE": "TLS_UNVERIFIED_CHAIN"}
MONTHS_SQ = ["janar", "shkurt", "mars", "prill", "maj", "qershor", "korrik", "gusht", "shtator", "tetor", "nentor", "dhjetor"]
MONTHS_EN = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Phrases of consultation evidence.
ANNUAL_ITEM = ["kalendari vjetor", "plani i konsultimeve publike"]
ANNUAL_DOCUMENT = ["kalendari vjetor", "plani i konsultimeve publike", "plani i aktiviteteve dhe plani i konsultimeve publike"]
PER_ITEM_CALENDAR = ["kalendari i konsultimit publik", "kalendari i konsultimeve publike"]
DRAFT_ACT = ["projekt vendim", "projektvendim", "projekt akt", "relacion", "pv"]
NOT_RESPONSE = ["procesverbal", "permbledhje jo teknike", "permbledhje joteknike", "jo teknike", "joteknike"]
CONSULTATION_DOCUMENT = ["konsultim"]
CONSULTATION_ITEM = ["konsultim", "konsultime publike", "degjese publike", "degjesave publike"]
RESPONSE = ["raport permbledhes", "raport permbledhese", "permbledhje", "permbledhes", "permbledhese", "rekomandimeve", "pergjigje"]

# Fixed values: (pattern on the lower-case URL, points) of consultation page candidates.
CONSULTATION_PATHS = [
    ("/konsultim([/?#-]|$)", 34),
    ("/konsultime([/?#-]|$)", 34),
    ("konsultim-publik|konsultimi-publik|konsultime-publike", 30),
    ("njoftime-dhe-konsultim-publik", 34),
    ("regjistri-elektronik", 30),
    ("/category/konsultime|/kategoria/konsultime", 20),
    ("transparen", 8),
]
CONSULTATION_PHRASES = [("konsultimi publik|konsultim publik", 20), ("njoftim dhe konsultim publik", 24), ("regjistri elektronik", 24)]
CANDIDATE_METHODS = {"homepage_link": 8, "common_path": 12}
# Fixed values: (pattern, points) of decision page candidates, on text, href and URL together or on one of them.
DECISION_ALL = [("vendime-te-keshillit-bashkiak", 140), ("vendime-te-keshillit", 120), ("vendime-keshilli|vendime-keshillit", 90), ("keshill", 25)]
DECISION_URL = [("/vendime([/?#-]|$)", 75), ("category/vendime|kategoria/vendime", 55), ("vendim", 50)]
DECISION_TEXT = [("vendim", 45)]
DECISION_HREF = [("vendim", 50)]
DECISION_METHODS = {"homepage_link": 10, "common_path": 20}
# Fixed values: (pattern, points) of procurement and consultation page candidates, and the points of all categories.
PROCUREMENT_KEYWORDS = [(r"\bprokurim[a-z-]*\b", 38), (r"\bprocurement\b", 28), (r"\btender[a-z-]*\b", 28), (r"\bnjoftim[a-z-]*\b", 18)]
CONSULTATION_KEYWORDS = [(r"\bkonsultim[a-z-]*\b", 36), (r"\bkonsultime[a-z-]*\b", 36), (r"\bkonsultim[a-z-]*\s+publik[a-z-]*\b", 28), (r"\bdegjes[a-z-]*\b", 26)]
GENERIC_ALL = [("transparen|program|publik|njoftime", 8)]
GENERIC_URL = [("/category/|/kategoria/", 6)]
GENERIC_METHODS = {"homepage_link": 8, "common_path": 16}
# Titles of links that say nothing, and the names of spend buckets.
GENERIC_TITLES = ["shkarko", "download", "pdf", "shiko vendimin", "kliko ketu", "klikoni ketu", "lexo me shume", "read more", "shiko", "lexo", "view"]
CPV_NAMES = {"other": "Kategori të tjera më të vogla", "others": "Kategori të tjera", "label": "Etiketa burimore: ", "unknown": "E panjohur", "code": "Kodi CPV: ", "no_code": "Kodi CPV mungon"}
# Host suffix and path of a procurement export's address.
EXPORT_HOST, EXPORT_PATH = "app.gov.al", "/getdata/exportdocument"

# Arguments of automatic scores, by indicator; {0} to {2} are filled in.
PENDING_REVIEW = "Pending review - could not auto-compute consultation score from available public evidence."
ARGUMENTS = {
    "annual": "Ind1=10 - consultation calendar/annual plan evidence identified: {0}. Full-year coverage and quality remain pending review.",
    "no_annual": "No annual consultation calendar document detected in archived consultation attachments. Per-item consultation calendars are not counted as annual plans - pending review.",
    "register": "A consultation register was found ({0}). Not assessed for dedicated / mobile-friendly / intuitive access (20 pts) - pending review.",
    "no_register": "No consultation register source configured - pending review.",
    "draft": "Ind3=10 - draft/project-act evidence identified: {0}. Plain-language explanatory material and completeness remain pending review.",
    "documents": "{0} consultation items published with {1} archived documents across {2} items, but no clear draft/project-act or relacion document was identified by conservative patterns - pending review.",
    "items": "{0} consultation items found but no documents archived - pending review.",
    "no_items": "No consultation drafts/documents found - pending review.",
    "timeframe": "Consultation-to-vote timeframe could not be automatically verified (no reliable link between consultations and council decisions). Pending review.",
    "response": "Ind5=10 - consultation response/summary-report evidence identified: {0}. Whether it addresses public input remains pending review.",
    "no_response": "No explicit post-consultation response or summary-report document detected in archived consultation attachments. Generic council reports and processverbals are not counted - pending review.",
}
