"""Word lists, patterns, thresholds and labels that results depend on."""

TOC_KEYWORDS = ("sommaire", "table des matieres", "table des matières", "table of contents", "contents", "inhaltsverzeichnis")
EN_STOPWORDS = ("the", "and", "for", "with", "this", "that", "from", "have", "are", "was")
FR_STOPWORDS = ("le", "la", "les", "un", "une", "des", "est", "dans", "avec", "pour", "que", "qui")
OCR_ARTIFACTS = "@#$%^&*[]{}|\\<>~`"

#: Page and document classification.
FULL_PAGE, MIN_NATIVE_CHARS, MIN_OCR_CHARS, OCR_QUALITY, DOC_RATIO = 0.85, 30, 50, 0.70, 0.95

#: Intents and their words, in order of priority.
INTENTS = (
    ("summarization", ("summarize", "summarise", "résume", "résumé", "give me an overview", "overview of", "what does this say", "donne un résumé", "synthétise", "executive summary")),
    ("translation", ("translate", "traduis", "traduire", "in french", "in english", "in plain english", "en anglais", "en français", "render as", "version anglaise", "version française")),
)

#: Answer shapes and their patterns, in order of priority.
SHAPES = (
    ("entity", (r"\bwho\b", r"\bqui\b", r"\bwhom\b", r"\bwhat is the (?:name|insurer|insured|policy holder|seller|buyer)\b", r"\b(?:nom de|identité|raison sociale)\b")),
    ("date", (r"\bwhen\b", r"\bquand\b", r"\b(?:effective\s+date|date\s+(?:d['e]'?effet|de\s+début|de\s+fin|d'expiration))\b", r"\bcoverage start", r"\bdate\s+(?:du|de)\b", r"\b(?:start(?:ing)?|end(?:ing)?|expiration|expiry|deadline)\s+date\b", r"\b(?:valid until|valable jusqu|expire|échéance)\b")),
    ("amount", (r"\bhow much\b", r"\bcombien\b", r"\b(?:cost|price|prime|premium|montant|tarif|cotisation|amount|value)\b", r"\b(?:plafond|franchise|limite|limit|deductible|cap)\b")),
    ("table", (r"\bcompare(?:r|s|d)?\b", r"\bdans un tableau\b", r"\bin a table\b", r"\btabular\b", r"\b(?:vs|versus)\b", r"\bdiff(?:é|e)rence(?:s)?\b")),
    ("list", (r"\blist all\b", r"\bliste\s+(?:de|des)\b", r"\b(?:quels?|quelles?)\s+sont\b", r"\bwhat are the\b", r"\b(?:tous|toutes)\s+les\b", r"\ball the\b", r"\bensemble des\b", r"\bénumère")),
    ("boolean", (r"^\s*(?:does|do|did|is|are|was|were|has|have|can|could|will|would|should|may|might)\b.+\?\s*$", r"^\s*(?:est-ce\s+que|y\s+a-t-il|peut-on|doit-on|peuvent-ils|sont-ils)\b", r"\b(?:yes\s*/\s*no|oui\s*/\s*non|true\s*/\s*false|vrai\s*/\s*faux)\b")),
)

#: Formats that a question asks for, in order of priority.
FORMATS = (
    (r"\b(?:yyyy[-/]mm[-/]dd|iso\s*8601|iso\s*date)\b", "ISO 8601 date (YYYY-MM-DD)"),
    (r"\bjson\b", "valid JSON"),
    (r"\b(?:in\s+euros?|en\s+euros?|€)\b", "numeric value in EUR"),
    (r"\b(?:in\s+dollars?|en\s+dollars?|usd|\$)\b", "numeric value in USD"),
    (r"\bas\s+a\s+number\b", "numeric value"),
    (r"\b(?:in\s+one\s+sentence|en\s+une\s+phrase)\b", "single sentence, no preamble"),
    (r"\b(?:bullet\s*list|liste\s*à\s*puces|en\s*liste)\b", "bullet list"),
    (r"\b(?:yes\s*/\s*no|oui\s*/\s*non|boolean)\b", "boolean (yes/no)"),
    (r"\b(?:percentage|pourcentage|%)\b", "percentage"),
)

PAGE_HINTS = (r"\bpage\s*n?[°o]?\s*(\d+)", r"\bp\.?\s*(\d+)\b", r"\bon\s+page\s+(\d+)", r"\bà\s+la\s+page\s+(\d+)")
LAYOUTS = (
    ("table", ("table", "tableau", "grille", "grid")),
    ("image", ("image", "figure", "diagramme", "diagram", "schéma", "schema", "photo")),
    ("header", ("header", "en-tête", "entête", "haut de page", "top of page", "top-right")),
    ("footer", ("footer", "pied de page", "bas de page", "bottom of page")),
)
ANCHORS = (r"\b[lLrR]\.?\s?\d+[-]\d+\b", r"(?i)\b(?:art\.?|article)\s+[lLrR]?\.?\s?\d+(?:[-./]\d+)*\b", r"\b[A-Z]{2,}-?\d+(?:[-./]\d+)*\b", r"\b[A-Z]{3,}\b", r"\b\d{4,}\b")
ANCHOR_STOPWORDS = (
    "THE", "AND", "FOR", "WITH", "WHAT", "WHEN", "WHERE", "WHICH", "WHO", "WHY", "HOW", "DOES", "ARE", "WAS", "WERE", "BUT", "NOT", "ALL", "ANY",
    "DANS", "POUR", "AVEC", "LES", "DES", "QUE", "QUI", "QUEL", "QUELLE", "EST", "SONT", "MAIS", "ALSO", "ABOUT",
    "YYYY", "MM", "DD", "HH", "ISO", "JSON", "XML", "PDF", "CSV", "TXT", "HTML", "URL", "API", "EUR", "USD", "GBP", "JPY", "TVA", "TTC", "HT",
)

#: Languages of a translation request by their names and codes.
LANGUAGES = {
    "en": ("english", "anglais", "inglese", "ingles", "englisch", "engels", "en"),
    "fr": ("french", "francais", "francese", "frances", "franzosisch", "frans", "fr"),
    "de": ("german", "allemand", "tedesco", "aleman", "deutsch", "deutsche", "duits", "de"),
    "es": ("spanish", "espagnol", "spagnolo", "espanol", "spanisch", "spaans", "es"),
    "it": ("italian", "italien", "italiano", "italienisch", "italiaans", "it"),
    "pt": ("portuguese", "portugais", "portoghese", "portugues", "pt"),
    "nl": ("dutch", "neerlandais", "olandese", "neerlandes", "nl"),
    "zh": ("chinese", "chinois", "cinese", "chino", "chinesisch", "chinees", "zh", "中文"),
    "ja": ("japanese", "japonais", "giapponese", "japones", "japanisch", "japans", "ja", "日本語"),
}
STYLES = (
    ("formal", ("formal", "formel", "formelle", "soutenu", "professional", "professionnel")),
    ("casual", ("casual", "informel", "informal", "decontracte", "friendly")),
    ("technical", ("technical", "technique", "scientifique", "scientific")),
)

#: Tools by the category that document metadata name. The kind says how a pattern is compared.
CATEGORIES = {
    "word_native": (
        ("microsoft word", "contains"), ("microsoft® word", "contains"), ("word for windows", "contains"), ("word for mac", "contains"), ("microsoft office word", "contains"),
        ("ms word", "contains"), ("libreoffice", "contains"), ("openoffice", "contains"), ("staroffice", "contains"), ("google docs", "contains"), ("google", "exact"),
        ("wps writer", "contains"), ("wps office", "contains"), ("kingsoft writer", "contains"), ("onlyoffice", "contains"), ("pages", "exact"), (r"^pages \d", "regex"),
        ("abiword", "contains"), ("iwork", "contains"),
    ),
    "design_tool": (
        ("adobe indesign", "contains"), ("adobe photoshop", "contains"), ("adobe illustrator", "contains"), ("adobe acrobat", "contains"), ("indesign", "contains"),
        ("photoshop", "contains"), ("illustrator", "contains"), ("affinity publisher", "contains"), ("affinity designer", "contains"), ("affinity photo", "contains"),
        ("figma", "contains"), ("sketch", "contains"), ("canva", "contains"), ("coreldraw", "contains"), ("corel draw", "contains"), ("corel designer", "contains"),
        ("inkscape", "contains"), ("quarkxpress", "contains"), ("scribus", "contains"), ("microsoft powerpoint", "contains"), ("powerpoint", "exact"),
        ("keynote", "contains"), ("adobe xd", "contains"),
    ),
    "scanned": (
        ("scanner", "contains"), ("scansnap", "contains"), ("hp scan", "contains"), ("hp scanjet", "contains"), ("hp digital sender", "contains"), ("xerox", "contains"),
        ("epson scan", "contains"), ("epson workforce", "contains"), ("canon", "contains"), ("brother mfc", "contains"), ("brother dcp", "contains"), ("ricoh", "contains"),
        ("kyocera", "contains"), ("fujitsu", "contains"), ("paperstream", "contains"), ("kofax", "contains"), ("acrobat capture", "contains"), ("readiris", "contains"),
        ("nuance", "contains"), ("finereader", "contains"), ("abbyy", "contains"), ("tesseract", "contains"), ("ocrmypdf", "contains"), ("paperport", "contains"),
        ("camscanner", "contains"), ("adobe scan", "contains"), ("office lens", "contains"), ("microsoft lens", "contains"), ("genius scan", "contains"),
        ("scanbot", "contains"), ("scannable", "contains"), ("turboscan", "contains"),
    ),
}
GENERIC_PRODUCERS = (
    "acrobat distiller", "adobe pdf library", "pdfwriter", "ghostscript", "gpl ghostscript", "itext", "tcpdf", "fpdf", "reportlab", "wkhtmltopdf", "weasyprint", "prince",
    "chromium", "skia", "quartz pdfcontext", "macos quartz", "microsoft: print to pdf", "pdf-xchange", "pdfsharp", "pdfium",
)

#: Sections and documents that a question names.
SECTION_HINTS = (
    r"section\s+(?:called|named|nommée|appelée|nommé|appelé)\s+['\"]?([\w\s-]{2,40}?)['\"]?(?=[\.,;]|$)",
    r"(?:dans\s+(?:la|le)|in\s+the)\s+section\s+['\"]?([\w\-]{2,40})['\"]?(?=[\s\.,;]|$)",
    r"\b([\w\-]{2,40})\s+section\b",
    r"\bsection\s+['\"]?([\w\-]{2,40})['\"]?(?=[\s\.,;]|$)",
)
SECTION_STOPWORDS = ("the", "a", "an", "le", "la", "les", "un", "une", "this", "that", "ce", "cette", "ces", "called", "named", "nommée", "appelée")
DOCUMENT_HINTS = (
    r"(?:la\s+)?(?:dernière|latest)\s+version(?:\s+(?:du\s+)?(?:contrat|document|policy|polic[eé]))?",
    r"(?:dans|in)\s+(?:le|the)\s+(?:contrat|document|polic[eé]|policy)\s+([\w\-]+)",
)

#: What a question sets aside.
DISTINCTIONS = (
    r"\bnot\s+(?:the\s+)?([\w\s-]{2,30}?)(?=[\.,;]|$)",
    r"\bpas\s+(?:la\s+|le\s+|les\s+)?([\w\s-]{2,30}?)(?=[\.,;]|$)",
    r"\binstead\s+of\s+(?:the\s+)?([\w\s-]{2,30}?)(?=[\.,;]|$)",
    r"(?:don['’]t|do\s+not)\s+confuse\s+(?:it\s+)?with\s+(?:the\s+)?([\w\s-]{2,30}?)(?=[\.,;]|$)",
    r"\bas\s+opposed\s+to\s+(?:the\s+)?([\w\s-]{2,30}?)(?=[\.,;]|$)",
    r"\bexcluding\s+(?:the\s+)?([\w\s-]{2,30}?)(?=[\.,;]|$)",
)
LONGEST_DISTINCTION = 60

#: Bricks of a question plan: the part they feed, and the types of document they fit (none: all).
BRICKS = {
    "anchor_keywords": ("retrieval", ()),
    "page_hint": ("retrieval", ("pdf", "pptx")),
    "section_hint": ("retrieval", ("pdf", "word", "pptx")),
    "layout_hint": ("retrieval", ()),
    "document_hint": ("retrieval", ()),
    "format": ("generation", ()),
    "disambiguation": ("generation", ()),
    "answer_shape": ("generation", ()),
}
PRESETS = {
    "pdf": ("anchor_keywords", "page_hint", "section_hint", "layout_hint", "document_hint", "format", "disambiguation", "answer_shape"),
    "word": ("anchor_keywords", "section_hint", "layout_hint", "document_hint", "format", "disambiguation", "answer_shape"),
    "excel": ("anchor_keywords", "document_hint", "format", "disambiguation", "answer_shape"),
    "email": ("anchor_keywords", "document_hint", "format", "disambiguation", "answer_shape"),
    "pptx": ("anchor_keywords", "page_hint", "section_hint", "layout_hint", "document_hint", "format", "disambiguation", "answer_shape"),
}
DEFAULT_PRESET = "pdf"

#: Task kinds of the older parser, in order of priority.
TASKS = (
    ("compare", ("compare", "consistent", "matches", "match between", "differ", "difference between", "vs ", "versus", "cohérent", "cohérence", "écart entre")),
    ("aggregate", ("list all", "rank ", "ranked", "every ", "all of the", "all the ", "lister tous", "lister toutes", "classer ")),
    ("conditional", ("and if so", "and if yes", "if so,", "if yes,", "et si oui", "le cas échéant")),
    ("open", ("explain ", "summarize", "summary", "overview", "expliquer", "résumer", "résumé", "synthèse")),
)

#: Sections that a translation request names, and its glossary pairs with the places of source and target.
EXCLUDED = (
    r"\b(?:skip|except|without|excluding|exclude|sauf|sans|excepte|excepté|hors|hormis)\s+(?:the\s+|les\s+|le\s+|la\s+|l['])?([\w\s,&-]+?)(?=[.!,;]|$|\s+(?:and|et|but)\s+)",
    r"\b(?:do not|don'?t|ne pas|ne)\s+translate\s+(?:the\s+|les\s+|le\s+|la\s+)?([\w\s,&-]+?)(?=[.!,;]|$)",
)
INCLUDED = (r"\b(?:only|just|seulement|uniquement)\s+(?:translate\s+)?(?:the\s+|les\s+|le\s+|la\s+)?([\w\s,&-]+?)(?=[.!,;]|$|\s+(?:and|et)\s+)",)
PAIRS = (
    (r"""use\s+['"]([^'"]+)['"]\s+for\s+['"]([^'"]+)['"]""", 2, 1),
    (r"""translate\s+['"]([^'"]+)['"]\s+as\s+['"]([^'"]+)['"]""", 1, 2),
    (r"""traduire\s+['"]([^'"]+)['"]\s+(?:par|en)\s+['"]([^'"]+)['"]""", 1, 2),
    (r"""['"]([^'"]+)['"]\s*(?:->|=>|:=|=)\s*['"]([^'"]+)['"]""", 1, 2),
)

#: Fields of XMP metadata.
XMP = {
    "creator_tool": r"<xmp:CreatorTool[^>]*>(.*?)</xmp:CreatorTool>",
    "producer": r"<pdf:Producer[^>]*>(.*?)</pdf:Producer>",
    "title": r"<dc:title[^>]*>.*?<rdf:li[^>]*>(.*?)</rdf:li>",
    "creator": r"<dc:creator[^>]*>.*?<rdf:li[^>]*>(.*?)</rdf:li>",
}
XMP_AGENT = r"<stEvt:softwareAgent[^>]*>(.*?)</stEvt:softwareAgent>"

#: System fonts for names found in documents.
FONTS = {
    "TimesNewRoman": "Times New Roman", "ArialMT": "Arial", "CourierNew": "Courier New", "Helvetica": "Arial", "HelveticaNeue": "Arial",
    "Times": "Times New Roman", "Courier": "Courier New",
}
BULLET_LINE = r"^[\s]*[•●○◦▪▸►–—\-\*]\s+"
NUMBER_LINE = r"^[\s]*\d{1,3}[\.\)]\s+"

#: Codes of Word files.
ALIGNMENTS = {0: "left", 1: "center", 2: "right", 3: "justify", 4: "distribute", 5: "justify_med", 7: "justify_hi", 8: "justify_low", 9: "thai_justify"}
LINE_SPACINGS = {1: "single", 2: "1.5", 3: "double", 4: "at_least", 5: "exactly", 6: "multiple"}
#: Tools by a word in the author or the last editor, in order of priority.
WORD_TOOLS = (
    ("LibreOffice", ("libreoffice", "openoffice")), ("Google Docs", ("google",)), ("WPS Office", ("wps", "kingsoft")), ("OnlyOffice", ("onlyoffice",)), ("Apple Pages", ("pages",)),
)

#: Tools by a part of their name in lower case, in order of priority, and those of them that scan.
TOOLS = (
    ("microsoft office word", "Microsoft Word"), ("microsoft® word", "Microsoft Word"), ("microsoft word", "Microsoft Word"), ("word for windows", "Microsoft Word"),
    ("word for mac", "Microsoft Word"), ("ms word", "Microsoft Word"), ("libreoffice", "LibreOffice"), ("openoffice", "OpenOffice"), ("staroffice", "StarOffice"),
    ("google docs", "Google Docs"), ("wps writer", "WPS Writer"), ("wps office", "WPS Office"), ("kingsoft writer", "Kingsoft Writer"), ("onlyoffice", "OnlyOffice"),
    ("abiword", "AbiWord"), ("iwork", "Apple iWork"), ("apple pages", "Apple Pages"),
    ("adobe indesign", "Adobe InDesign"), ("adobe photoshop", "Adobe Photoshop"), ("adobe illustrator", "Adobe Illustrator"), ("adobe xd", "Adobe XD"),
    ("adobe acrobat", "Adobe Acrobat"), ("indesign", "Adobe InDesign"), ("photoshop", "Adobe Photoshop"), ("illustrator", "Adobe Illustrator"),
    ("affinity publisher", "Affinity Publisher"), ("affinity designer", "Affinity Designer"), ("affinity photo", "Affinity Photo"), ("figma", "Figma"), ("sketch", "Sketch"),
    ("canva", "Canva"), ("coreldraw", "CorelDRAW"), ("corel draw", "CorelDRAW"), ("corel designer", "Corel Designer"), ("inkscape", "Inkscape"),
    ("quarkxpress", "QuarkXPress"), ("scribus", "Scribus"), ("microsoft powerpoint", "Microsoft PowerPoint"), ("keynote", "Apple Keynote"),
    ("hp scanjet", "HP ScanJet"), ("hp digital sender", "HP Digital Sender"), ("hp scan", "HP Scan"), ("scansnap", "Fujitsu ScanSnap"), ("xerox", "Xerox"),
    ("epson workforce", "Epson WorkForce"), ("epson scan", "Epson Scan"), ("brother mfc", "Brother MFC"), ("brother dcp", "Brother DCP"), ("ricoh", "Ricoh"),
    ("kyocera", "Kyocera"), ("paperstream", "Fujitsu PaperStream"), ("fujitsu", "Fujitsu"), ("kofax", "Kofax"), ("acrobat capture", "Adobe Acrobat Capture"),
    ("readiris", "Readiris"), ("finereader", "ABBYY FineReader"), ("abbyy", "ABBYY"), ("nuance", "Nuance"), ("tesseract", "Tesseract"), ("ocrmypdf", "OCRmyPDF"),
    ("paperport", "PaperPort"), ("camscanner", "CamScanner"), ("adobe scan", "Adobe Scan"), ("microsoft lens", "Microsoft Lens"), ("office lens", "Microsoft Office Lens"),
    ("genius scan", "Genius Scan"), ("scanbot", "Scanbot"), ("scannable", "Scannable"), ("turboscan", "TurboScan"), ("canon", "Canon"), ("scanner", "Generic scanner"),
    ("acrobat distiller", "Adobe Acrobat Distiller"), ("adobe pdf library", "Adobe PDF Library"), ("microsoft: print to pdf", "Microsoft Print to PDF"),
    ("gpl ghostscript", "Ghostscript"), ("ghostscript", "Ghostscript"), ("itext", "iText"), ("tcpdf", "TCPDF"), ("fpdf", "FPDF"), ("reportlab", "ReportLab"),
    ("wkhtmltopdf", "wkhtmltopdf"), ("weasyprint", "WeasyPrint"), ("prince", "Prince"), ("chromium", "Chromium"), ("skia", "Chrome / Skia"),
    ("quartz pdfcontext", "macOS Quartz"), ("macos quartz", "macOS Quartz"), ("pdf-xchange", "PDF-XChange"), ("pdfsharp", "PDFsharp"), ("pdfium", "PDFium"),
)
_NAMES = [part for part, _ in TOOLS]
SCANNERS = TOOLS[_NAMES.index("hp scanjet") : _NAMES.index("scanner") + 1]  # from the first to the last scanner of the table

#: What an unclear question refers to.
REFERENTS = (
    "this", "that", "the cap", "the limit", "the latest", "last year", "the same", "the previous", "celui-ci", "celui-là", "celle-ci", "celle-là",
    "le plafond", "la limite", "la dernière version", "l'an passé",
)

# Parts of creator and producer that tell how a document was made, by category, with the confidence.
MADE_WITH = (
    ("word_native", 0.95, "meta:word_creator", ("microsoft word", "word", "libreoffice writer", "openoffice writer", "wps writer", "wps office", "google docs")),
    ("design_tool", 0.95, "meta:design_creator", ("adobe photoshop", "adobe illustrator", "adobe indesign", "figma", "sketch", "canva", "affinity publisher", "affinity designer", "coreldraw", "inkscape")),
    ("scanned", 0.90, "meta:scanner_creator", ("scanner", "scan", "xerox", "hp scanjet", "epson scan", "canon scan", "acrobat capture", "readiris", "nuance", "finereader", "abbyy", "paperstream", "kofax")),
)
# Page sizes in points (A4, Letter, A5, A3) and their tolerance, and limits of the content rules.
PAGE_SIZES, SIZE_TOLERANCE = ((595, 842), (612, 792), (420, 595), (842, 1191)), 0.05
MIN_PAGE_CHARS, MIN_TEXT_QUALITY, DESIGN_IMAGES, DESIGN_CHARS, COMPLEX_IMAGES = 50, 0.60, 0.55, 120, 0.50

# Conversion engines, whether their result can be edited, and how close it comes; their labels are our own.
ENGINES = {
    "adobe": ("Adobe cloud service", True, "pixel-perfect"),
    "msword": ("Microsoft Word", True, "high"),
    "docling": ("Docling", True, "high"),
    "libreoffice": ("LibreOffice", True, "high"),
    "text": ("Text layer", True, "high"),
    "ocr": ("Text recognition", True, "approximate"),
    "hybrid": ("Page image with hidden text", False, "pixel-perfect"),
    "smart": ("Layout rebuilt", True, "approximate"),
}

# Patterns of page ranges in requests.
PAGE_RANGES = (
    r"\bpages?\s+(\d+)\s*(?:to|-|–|a|à|jusqu['’]?a|jusqu['’]?à)\s*(\d+)\b",
    r"\bfrom\s+page\s+(\d+)\s+to\s+(?:page\s+)?(\d+)\b",
    r"\bde\s+la\s+page\s+(\d+)\s+(?:a|à|jusqu['’]?a|jusqu['’]?à)\s+(?:la\s+page\s+)?(\d+)\b",
)

# What to ask back, by words of the question.
CLARIFICATIONS = (
    (("cap", "limit", "plafond", "limite"), ("Liability cap?", "Indemnification cap?", "Coverage limit per claim?", "Aggregate limit?")),
    (("version", "latest", "dernière"), ("Latest signed version?", "Latest draft?", "Latest as of a specific date?")),
    (("compare", "last year", "l'an passé"), ("Compare with which year/document?", "Compare on which dimension (price, scope, parties)?")),
    ((), ("Could you clarify which document?", "Could you clarify which concept exactly?")),
)

# Steps of the older way of reading questions, by type of document.
OLDER_PRESETS = {
    "pdf": ("rewrite", "anchor_keywords", "page_hint", "section_hint", "layout_hint", "format", "disambiguation"),
    "word": ("rewrite", "anchor_keywords", "section_hint", "layout_hint", "format", "disambiguation"),
    "excel": ("rewrite", "anchor_keywords", "format", "disambiguation"),
    "email": ("rewrite", "anchor_keywords", "format", "disambiguation"),
    "pptx": ("rewrite", "anchor_keywords", "page_hint", "section_hint", "layout_hint", "format", "disambiguation"),
}
