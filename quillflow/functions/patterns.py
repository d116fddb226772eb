"""Patterns and word lists of bibliographic text."""

# Results depend on these patterns being just so.
UPPER = "A-ZÁÉÍÓÚÑ"
LOWER = "a-záéíóúñ"
AUTHOR_FULL = rf"^[{UPPER}][{LOWER}]+(?:\s+[{UPPER}][{LOWER}]+)?,\s*[A-Z]\.?"
AUTHOR_SEARCH = rf"[{UPPER}][{LOWER}]{{2,}},\s*[A-Z]\."
AUTHOR_NO_COMMA = rf"[{UPPER}][{LOWER}]{{2,}}\s+[A-Z]\."
AUTHOR_COMMA_INITIAL = r",\s*[A-Z]\."
AUTHOR_YEAR_RANGE = r"[A-Z][a-z]+,\s*\d{4}[-–—]"
AUTHOR_MULTIPLE_COMMA = rf"[{UPPER}][{LOWER}]{{2,}},\s*[A-Z]\.?\s*,\s*[A-Z]"
AUTHOR = rf"([{UPPER}][{LOWER}]{{2,}}(?:\s+[{UPPER}][{LOWER}]+)?,\s*[A-Z]\.(?:\s*[A-Z]\.)*)"
AUTHOR_PLAIN = rf"([{UPPER}][{LOWER}]{{2,}}(?:\s+[{UPPER}][{LOWER}]+)?\s+[A-Z](?:\s*[A-Z])?)"
YEAR_FULL = r"\b(19\d{2}|20[0-2]\d)\b"
YEAR_SHORT = r"^\b(19|20)\d{2}\b"
YEAR_PARENTHESIS = r"\((\d{4})\)"
YEAR_SEMICOLON = r"(\d{4});"
YEAR_DOT_SPACE = r"(\d{4})\.\s+[A-Z]"
YEAR_DOT = r"(\d{4})\."
YEAR_COMMA = r"(\d{4}),"
DOI_URL = r"https?://(?:dx\.)?doi\.org/(10\.\d{4,}/[^\s\)]+)"
DOI_HOST = r"doi\.org/(10\.\d{4,}/[^\s\)]+)"
DOI_LABEL = r"doi[:\s]+(10\.\d{4,}/[^\s\)]+)"
DOI_BARE = r"(10\.\d{4,}/[a-zA-Z0-9\.\-]+)"
ISBN = r"ISBN[-\s]?(?:13[-\s]?:?)?[-\s]?(\d{13}|\d{10})|ISBN[-\s]?(\d{10})"
ISSN = r"ISSN[-\s]?(\d{4}[-\s]?\d{3}[\dX])"
URL = r"https?://[^\s\)]+"
TITLE_QUOTED = r"""["'](.+?)["']"""
JOURNAL_VOLUME = r"\.\s+([A-Z][\w\s\.\,&-]{1,50}?)\s+\d+"
IN_BOOK = r"\bIn:\s*"
EDITORS = r"\(Eds?\.\)"
BOOK_TITLE_ENDS = [r"\bpp\.", r"\.\s+[A-Z][a-z]+\s+\d{4}", r"\.\s+\d{1,4}\s*$"]
REF_SECTION_START = r"^(REFERENCES|References|REFERENCIAS|Bibliografía|Bibliography|LITERATURE\s+CITED|Works\s+Cited)"
REF_NUMBERED = r"^\d+\.\s+[A-Z]"
REF_START_FULL = rf"(^|\.\s|\)\.?\s|doi:[^\s]+\s|[\d]+–[\d]+\.?\s)([{UPPER}][{LOWER}]{{2,}},\s*[A-Z]\.)"
REF_START_SIMPLE = rf"(^|\.doi:[^\s]+\s+|[\d]+–[\d]+\.\s+|[\d]{{4}}\)\.\s*)([{UPPER}][{LOWER}]{{3,}},\s*[A-Z]\.)"
REF_SPLIT_YEAR = r"(\(\d{4}\)|\s\d{4}[\.,])"
HEADERS = r"^(?:Frontiers|Volume \d+|Article \d+|doi:|http|www\.)"
SECTIONS = r"^(?:FUNDING|ACKNOWLEDGMENTS?|DATA AVAILABILITY|SUPPLEMENTARY|AUTHOR CONTRIBUTIONS)"
EXCLUDED_TITLES = r"^(?:Author|Abstract|Summary|Keywords|Received|Accepted|Published|Editor|Citation|RESEARCH ARTICLE|REVIEW ARTICLE)"
INVALID_PHRASES = [
    "THIS RESEARCH WAS SPONSORED",
    "FONDAP-CONICYT",
    "FONDEQUIP",
    "FONDECYT",
    "WE APPRECIATE",
    "THE ORIGINAL CONTRIBUTIONS",
    "FURTHER INQUIRIES",
    "SUPPLEMENTARY MATERIAL",
    "AUTHOR CONTRIBUTIONS",
    "ENDORSED BY THE PUBLISHER",
    "NO USE, DISTRIBUTION OR REPRODUCTION",
]
END_SECTIONS = [
    "FUNDING",
    "ACKNOWLEDGMENTS",
    "DATA AVAILABILITY",
    "SUPPLEMENTARY MATERIAL",
    "AUTHOR CONTRIBUTIONS",
]
GARBAGE_PREFIXES = [
    r"^and\s+approved\s+the\s+submitted\s+version\.?\s*",
    r"^submitted\s+version\.?\s*",
    r"^approved\s+the\s+submitted\.?\s*",
    r"^and\s+approved\.?\s*",
    r"^REFERENCES\s+",
    r"^References\s+",
    r"^\.\s*",
    r"^,\s*",
]
RUNNING_HEADS = [
    r"Frontiers in Marine Science[^\n]*",
    r"Volume \d+[^\n]*",
    r"Article \d+[^\n]*",
    r"www\.frontiersin\.org[^\n]*",
]
ONLY_NUMBERS = r"^\d+$"
ONLY_UPPERCASE_SHORT = r"^[A-Z\s]{1,30}$"
HAS_CONCAT_WORDS = r"[a-z][A-Z]"
DASHES = "-–—"
TRUNCATED = "... [truncado]"

# Document types.
ARTICLE = "Artículo en revista científica"
CHAPTER = "Capítulo de libro"
REPORT = "Informe técnico"
THESIS = "Tesis"
BOOK = "Libro"
WORK_TYPES = {
    "journal-article": ARTICLE,
    "book-chapter": CHAPTER,
    "book": BOOK,
    "report": REPORT,
    "dissertation": THESIS,
    "proceedings-article": "Artículo en actas",
    "dataset": "Conjunto de datos",
}
