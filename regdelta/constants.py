"""Enumerations, thresholds and lookup tables that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


# fixed values: thresholds and limits
@dataclass(frozen=True)
class Config:
    filter_min_words: int = 300
    filter_min_hits: int = 3
    filter_min_density: float = 0.003
    dense_min_words: int = 50
    dense_min_density: float = 0.02
    score_gate: float = 0.6
    content_head: int = 4500
    content_tail: int = 1500
    diff_chars: int = 6000
    obligation_chunk: int = 6000
    obligation_overlap: int = 400
    obligation_chunks: int = 15
    match_chars: int = 500_000
    delivery_retries: int = 5
    price_input: float = 0.15
    price_output: float = 0.60
    min_quote: int = 20
    diff_cap: int = 100_000


CHANGE_TYPES = ("typo_or_cosmetic", "minor_wording", "clarification", "substantive", "critical")
TOPICS = (
    "customs_trade", "financial_services", "data_privacy", "environmental", "healthcare_pharma", "sanctions_export_control",
    "labor_employment", "tax_accounting", "consumer_protection", "corporate_governance", "other",
)
TRADE_FLOWS = ("inbound", "outbound", "bilateral", "global")
OBLIGATION_TYPES = ("reporting", "prohibition", "threshold", "disclosure", "registration", "penalty", "other")
WORKFLOW = {"open": ("in_progress", "done", "waived"), "in_progress": ("open", "done", "waived"), "done": (), "waived": ()}
TERMINAL = ("done", "waived")

# fixed values: words whose presence marks regulatory text
REGULATORY_WORDS = (
    "shall", "must", "required", "requires", "requirement", "prohibited", "prohibits", "obligated", "obligation", "pursuant", "effective", "compliance", "comply",
    "section", "subsection", "paragraph", "subparagraph", "article", "clause", "provision", "chapter", "title", "part",
    "regulation", "regulations", "directive", "statute", "statutes", "rule", "rules", "act", "amendment", "ordinance", "bylaw", "guidance", "handbook", "code",
    "penalty", "penalties", "fine", "fines", "violation", "violates", "enforcement", "sanctioned", "sanctions",
    "doit", "doivent", "conformément", "règlement", "règle", "paragraphe", "alinéa", "disposition", "interdiction", "sanction", "pénalité",
    "muss", "müssen", "gemäß", "verordnung", "artikel", "absatz", "vorschrift", "pflicht", "verbot", "strafe",
    "debe", "deberá", "deberán", "conforme", "artículo", "reglamento", "párrafo", "disposición", "obligación", "prohibición", "sanción",
    "deve", "devono", "articolo", "regolamento", "comma", "disposizione", "divieto", "sanzione",
)
REGULATORY_PHRASES = ("ai sensi",)
# fixed values: what counts as a word, and the marks of paragraphs, articles, codes and acts
WORD_PATTERN = "[A-Za-zÀ-ɏ]+"
MARKER_PATTERN = (
    r"(?i)(?:§\s*\d|\b(?:Art(?:icle|\.)|Sec(?:tion|\.)|Chapter|Title|Part)\s+\d|\b\d+\s*(?:CFR|U\.?S\.?C\.?|USC)\b|\b(?:EU|EC|EEC)\s*\d+/\d{2,4})"
)

# fixed values: what interstitial pages say
BLOCKER_TITLES = (
    "access denied", "request access", "are you a robot", "are you human", "just a moment", "attention required", "cloudflare", "captcha",
    "please verify", "security check", "403 forbidden", "429 too many", "rate limit", "blocked",
    "accès refusé", "acces refuse", "vérification de sécurité", "verification de securite", "êtes-vous un robot", "etes-vous un robot", "veuillez patienter",
    "acceso denegado", "verificación de seguridad", "verificacion de seguridad", "¿es usted un robot?", "es usted un robot",
    "zugriff verweigert", "zugriff abgelehnt", "sicherheitsüberprüfung", "sicherheitsuberprufung", "sind sie ein roboter",
    "访问被拒绝", "请稍候", "人机验证", "驗證您是真人",
)
BLOCKER_BODIES = (
    "enable javascript", "javascript is required", "enable cookies", "cookies are required", "verifying you are human", "checking your browser",
    "challenge-platform", "cf-chl-", "__cf_chl_", "ddos protection by cloudflare", "access to this resource is forbidden", "your ip has been blocked",
    "veuillez activer javascript", "activer les cookies", "habilite javascript", "active las cookies", "javascript aktivieren", "cookies aktivieren",
    "启用javascript", "请启用 javascript", "请启用cookies", "啟用 javascript",
)
BLOCKER_HEAD, BLOCKER_SHORT, BLOCKER_EMPTY = 4000, 1500, 200

# fixed values: URL rules
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_referrer", "fbclid", "gclid", "msclkid", "ttclid",
    "_ga", "_gl", "ref", "referrer", "mc_cid", "mc_eid",
)
SESSION_PATTERN = r"(?i)[?&](session_?id|sid|jsessionid|phpsessid|aspsessionid)="
CALENDAR_PATTERN = r"/\d{4}/(?:0[1-9]|1[0-2])(?:/(?:0[1-9]|[12]\d|3[01]))?(?:/|$)"
REPEATED_PATTERN = r"(/[^/?#]{2,})\1{2,}"
SKIPPED_ENDINGS = (
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".gz", ".tar", ".7z", ".exe", ".dmg", ".pkg",
    ".mp4", ".mp3", ".avi", ".mov", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico",
)
SKIPPED_FRAGMENTS = ("nota_to_doc", "nota_to_imagen", "download", "export", "print_version", "printable", "/attachment/")
NOT_LEGAL_XML = ("sitemap", "robots", "feed", "rss", "atom")

# fixed values: host suffix to jurisdiction
JURISDICTIONS = {
    "cbp.gov": "US", "ustr.gov": "US", "federalregister.gov": "US", "regulations.gov": "US", "sec.gov": "US", "cftc.gov": "US", "fda.gov": "US",
    "treasury.gov": "US", "ofac.treasury.gov": "US", "state.gov": "US", "gov": "US",
    "europa.eu": "EU", "ec.europa.eu": "EU", "eur-lex.europa.eu": "EU", "eba.europa.eu": "EU", "esma.europa.eu": "EU", "edpb.europa.eu": "EU",
    "gov.uk": "GB", "fca.org.uk": "GB", "bankofengland.co.uk": "GB", "hmrc.gov.uk": "GB", "admin.ch": "CH", "finma.ch": "CH",
    "gov.cn": "CN", "customs.gov.cn": "CN", "mof.gov.cn": "CN", "gov.au": "AU", "canada.ca": "CA", "gov.sg": "SG", "meti.go.jp": "JP", "go.jp": "JP",
    "gov.kr": "KR", "gov.br": "BR", "gov.in": "IN",
}

# fixed values: country names to codes
COUNTRIES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.": "US", "u.s": "US", "us": "US", "america": "US",
    "european union": "EU", "eu": "EU", "europe": "EU", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "britain": "GB", "england": "GB",
    "china": "CN", "people's republic of china": "CN", "prc": "CN", "canada": "CA", "mexico": "MX", "japan": "JP", "switzerland": "CH", "australia": "AU",
    "new zealand": "NZ", "germany": "DE", "france": "FR", "italy": "IT", "spain": "ES", "netherlands": "NL", "belgium": "BE", "poland": "PL", "sweden": "SE",
    "norway": "NO", "denmark": "DK", "finland": "FI", "ireland": "IE", "austria": "AT", "portugal": "PT", "greece": "GR", "india": "IN",
    "south korea": "KR", "republic of korea": "KR", "korea": "KR", "vietnam": "VN", "thailand": "TH", "indonesia": "ID", "malaysia": "MY",
    "singapore": "SG", "philippines": "PH", "taiwan": "TW", "brazil": "BR", "argentina": "AR", "chile": "CL", "colombia": "CO",
    "russia": "RU", "russian federation": "RU", "turkey": "TR", "saudi arabia": "SA", "united arab emirates": "AE", "uae": "AE", "israel": "IL",
    "egypt": "EG", "south africa": "ZA", "nigeria": "NG", "kenya": "KE", "morocco": "MA", "hong kong": "HK", "macau": "MO", "macao": "MO",
    "iran": "IR", "iraq": "IQ", "north korea": "KP", "dprk": "KP", "pakistan": "PK", "bangladesh": "BD", "ukraine": "UA",
}

# fixed values: agency and regulation acronyms
AGENCIES = {
    "fca": "financial conduct authority", "sec": "securities and exchange commission", "cftc": "commodity futures trading commission",
    "cbp": "customs and border protection", "uscbp": "customs and border protection", "ofac": "office of foreign assets control",
    "fda": "food and drug administration", "ema": "european medicines agency", "ecb": "european central bank",
    "esma": "european securities and markets authority", "eba": "european banking authority", "fincen": "financial crimes enforcement network",
    "irs": "internal revenue service", "doj": "department of justice", "dol": "department of labor", "dhs": "department of homeland security",
    "epa": "environmental protection agency", "osha": "occupational safety and health administration", "nrc": "nuclear regulatory commission",
    "aml": "anti-money laundering", "kyc": "know your customer", "pra": "prudential regulation authority",
    "bafin": "bundesanstalt für finanzdienstleistungsaufsicht", "mas": "monetary authority of singapore", "hkma": "hong kong monetary authority",
    "rbi": "reserve bank of india", "pboc": "people's bank of china", "boe": "bank of england", "fdic": "federal deposit insurance corporation",
    "occ": "office of the comptroller of the currency", "frb": "federal reserve board", "ftc": "federal trade commission",
    "fcc": "federal communications commission", "fra": "federal railroad administration", "cdc": "centers for disease control and prevention",
    "cms": "centers for medicare and medicaid services", "nist": "national institute of standards and technology",
    "uspto": "united states patent and trademark office", "noaa": "national oceanic and atmospheric administration",
}
REGULATIONS = {
    "gdpr": "general data protection regulation", "hipaa": "health insurance portability and accountability act", "ccpa": "california consumer privacy act",
    "sox": "sarbanes-oxley act", "fatca": "foreign account tax compliance act", "mifid": "markets in financial instruments directive",
    "mifid ii": "markets in financial instruments directive ii", "psd2": "payment services directive 2",
    "emir": "european market infrastructure regulation", "basel iii": "basel iii", "dodd-frank": "dodd-frank wall street reform act",
}
# fixed values: words that name an agency, and words that name a state or union before one
AGENCY_WORD = r"\b(agency|authority|commission|bureau|administration|department|ministry|office|board|council|service|inspectorate|directorate|secretariat|comptroller|registrar|prosecutor|protection|enforcement|patrol|customs|intelligence|tribunal|supervisor|supervisory|regulator)\b"
STATE_WORD = r"(?:^|\b)(u\.s\.|u\.s\b|us\b|united\s+states|federal|european|eu|state|national|royal|her\s+majesty|royal\s+norwegian|hm|ministry|ministerio|ministère|bundes|people's\s+republic|government\s+of)"
# fixed values: entity types, the first pattern that is found decides
ENTITY_PATTERNS = (
    ("regulation", r"(?i)\b\d+\s*C\.?F\.?R\.?\b"),
    ("regulation", r"(?i)\b\d+\s*U\.?S\.?C\.?\b"),
    ("regulation", r"(?i)\b(?:eu|ec|eec)\s*\d+/\d+"),
    ("regulation", r"(?i)\b(?:mifid|gdpr|ccpa|basel|solvency|dodd-frank|sox|hipaa|psd2|emir|fatca)\b"),
    ("regulation", r"(?i)\b(?:regulation|directive|act|rule)\s+(?:no\.?\s*)?\d+\b"),
    ("regulation", r"(?i)\bsection\s+\d"),
    ("regulation", r"(?i)\btitle\s+\d"),
    ("code", r"(?i)\bhs\s*codes?\b|\bhts(?:us)?\b|\bschedule\s*b\b|\bcn\s*\d{4,}\b|\bnaics\b|\bsic\b"),
    ("code", r"^\d{4}\.\d{2}(?:\.\d{2,4})?$"),
    ("code", r"(?i)\b(?:hts(?:us)?|hs|schedule\s*b)\s*\d{4}(?:\.\d{2,4}){0,2}\b"),
    ("code", r"(?i)\b(?:chapter|heading)\s+\d{2}\.\d{2}\b"),
    ("code", r"^\d{6,10}$"),
    ("agency", rf"(?i){AGENCY_WORD}.+(?:of|for)\b"),
    ("agency", rf"(?i){STATE_WORD}\s+\w.*{AGENCY_WORD}"),
    ("agency", rf"(?i){AGENCY_WORD}"),
    ("agency", r"^[A-Z]{2,6}$"),
    ("program", r"(?i)\b(?:program|programme|scheme|initiative|framework)\b"),
    ("industry", r"(?i)\b(?:industry|sector|manufacturers?|providers?|exchanges?|institutions?|importers?|exporters?|operators?)\b"),
)

# fixed values: tariff codes in running text
CODE_PATTERNS = (
    ("hs_dotted", r"\b\d{4}\.\d{2}\.\d{2,4}\b"),
    ("prefixed", r"(?i)\b(?:hts(?:us)?|hs(?:\s*codes?)?|schedule\s*b)\s+\d{4}(?:\.\d{2,4}){0,2}\b"),
    ("squashed", r"(?i)\bhs\s?codes?\s?\d{4}(?:\.\d{2,4}){0,2}\b"),
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# fixed values: dollars a million tokens, in and out
PRICES = {
    "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "gpt-4.1": (2.00, 8.00), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1-nano": (0.10, 0.40),
    "o1-mini": (3.00, 12.00), "o1": (15.00, 60.00), "o3-mini": (1.10, 4.40),
}
RETRY_BASES = {"ingest": 60, "score": 30, "match": 10, "deliver": 30}

#: Function words by language, for the vote on Latin-script text.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "ist", "im", "dem", "nicht", "ein", "eine"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "this", "are", "from"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "las", "se", "del", "por", "con", "una", "su", "para", "es"),
    "fr": ("le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "dans", "qui", "par"),
    "it": ("il", "di", "che", "la", "e", "in", "un", "una", "per", "non", "del", "della", "con", "sono", "gli", "le"),
}
CHANNELS = ("email", "slack", "webhook", "none")
HANDLED_CHANNELS = ("email",)

# fixed values: English stop words
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

# fixed value: words of a raw rule that are shown as matched
RULE_WORD_PATTERN = "[A-Za-z0-9][A-Za-z0-9_./-]*"
