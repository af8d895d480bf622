"""Word lists, patterns and constants that matching and extraction take as parameters.

Fixed values: they must equal the established ones for right results.  Every
operator takes them as arguments, so that other languages can be used.
"""

#: Brands that stand at the end of an article.
BRAND_SUFFIXES = (
    "IEK", "EKF", "DEK", "HIKVISION", "DAHUA", "AJAX", "BOLID", "BOSCH", "ABB", "LEGRAND", "SCHNEIDER", "HAGER",
    "REXANT", "TDM", "KEAZ", "TEXENERGO", "TEKFOR", "ELVERT", "ANDELI", "CHINT", "NOARK", "APATOR", "EASTEC",
    "WAGO", "PHOENIX", "SIEMENS", "MOELLER", "EATON", "RITTAL", "MEANWELL", "DELTA", "FLUKE", "FLIR", "HIOKI",
)
#: Segments, texts that mean nothing, scores, bounds and lengths of matching and of vector search.
SEGMENTS = ("ss", "os", "sil")
NULL_TEXTS = ("None", "-", "—", "")
EXACT_SCORE, CONTAINS_SCORE, NAME_EXACT_SCORE, NAME_CONTAINS_SCORE = 100, 95, 99, 93
FUZZY_MIN, NAME_FROM_ARTICLE_MIN, NAME_FUZZY_MIN, NAME_PARTIAL_MIN = 80, 90, 93, 96
LENGTH_RATIO, WORD_COVERAGE = 0.70, 0.40
NAME_MIN_LENGTH, NOCYR_MIN_LENGTH, CODE_DIGITS = 20, 3, 10
CLOSE_SCORE = 5
VECTOR_TOP_K, VECTOR_MIN, VECTOR_SURE, VECTOR_GAP, VECTOR_LOW, CORRECTION_MIN = 8, 0.72, 0.90, 0.05, 0.82, 0.92
#: Units and the segment of rows that name none.
CATALOG_UNIT, PRICE_UNIT, DEFAULT_SEGMENT = "шт.", "шт", "ss"
PIECE_UNITS = ("шт", "шт.", "")

#: Beginnings and parts of references to norms, words of title blocks, of rows to skip, and units.
STANDARD_PREFIXES = ("гост", "ст рк", "снип", "сп ", "ту ", "ту-")
STANDARD_PARTS = ("гост", "ст рк")
STAMP_WORDS = ("изм", "лист", "подпись", "дата", "инв", "взам", "формат", "кол\\.уч", "гип", "проверил", "выполнил", "утвердил", "н\\.конт", "н\\.к\\.", "рп ", "стадия", "согласов", "разработ")
SKIP_KEYWORDS = ("оборудование", "кабели", "провода", "монтажные", "кабеленесущие", "материалы и изделия", "комплектующ")
UNITS = ("шт", "шт.", "м", "м.", "м2", "м3", "м³", "компл", "компл.", "рул", "рул.", "кг", "км", "л", "уп", "уп.", "п.м", "п.м.", "пм", "пог.м", "пог.м.")
#: What header cells hold, by field, and phrases of tables that are no specifications.
HEADER_PATTERNS = {
    "pos": ("поз", "позиция", "№"),
    "name": ("наименование", "наим", "техническ", "обозначениеитехн"),
    "article": ("типмарка", "тип,марка", "типмарки", "маркаобозначение", "марка,обозначение", "обозначениедок", "обозначение"),
    "code": ("кодоборудования", "кодизделия", "кодматер", "кодобор", "шифр", "казниис", "каз.ниис", "кодпродукции"),
    "unit": ("едизм", "единиц", "ед.изм", "едизмерения"),
    "qty": ("кол.", "колво", "количество", "колич"),
}
HEADER_EXCLUDED = ("маркировка кабел", "кабельная трасса", "марка кабеля", "длина, м", "длина м")
HEADERLESS_EXCLUDED = HEADER_EXCLUDED[:3]
NON_SPEC_MARKERS = (
    "уго", "позиционное обозначение", "тип линии связи", "граф. обозначение", "маркировка кабел", "кабельная трасса", "марка кабеля",
    "структурированные кабельн", "ведомость земляных", "ведомость основного", "ведомость рабочих", "ведомость строительных", "основного комплекта",
)
#: What is cut from both ends of a name before it is asked for.
CONTEXT_PREFIX = r"^\.{0,3}\s*на\s+(?:вводе?|линий?|ответвлении?|отходящих?)\s*"
CONTEXT_SUFFIX = r",?\s*в\s+том\s+числе\s*[:.]?\s*$"
#: Words of project titles, and of page kinds.
PROJECT_KEYWORDS = (
    "проектирование", "строительство", "реконструкция", "здание", "здания", "объект", "объекта", "сооружение", "сооружения",
    "комплекс", "система", "автоматизация", "оснащение", "монтаж", "установка", "реализация", "разработка",
)
PAGE_LEXICON = {
    "title": ("спецификация оборудования",),
    "index": ("ведомость",),
    "suffix": (".со",),
    "position": ("поз.", "поз ", "позиция"),
    "name": ("наименование",),
    "quantity": ("кол-во", "количество", "кол.", "коли-", "кол-"),
    "type": ("тип, марка", "тип,марка", "тип марка"),
}
#: Constants of a brand without its own, and the price that each rate number takes.
BRAND_DEFAULTS = {"margin": 1.2, "logistics": 1.03, "rate": 4.0, "currency_rate": 1.0, "nds": 1.16, "gp": 0.8}
RATE_FIELDS = ("kaznisa", "kaznisa", "rrts", "mrc", "opt", "rrts", "rrts", "partner")
GP_RATES = (6, 7)
PRICE_FIELDS = ("kaznisa", "rrts", "mrc", "opt", "partner")
#: What a match method is called in a quote.
METHOD_LABELS = {
    "exact": "Артикул (точн.)",
    "contains": "Артикул (вхожд.)",
    "fuzzy_article": "Артикул (нечётк.)",
    "fuzzy_name_from_article": "Артикул (нечётк.)",
    "name_exact": "Название (точн.)",
    "name_contains": "Название (вхожд.)",
    "name_fuzzy": "Название (нечётк.)",
    "name_partial": "Название (частич.)",
    "code_exact": "КазНИИСА (код)",
    "kaznisa": "КазНИИСА (код)",
    "correction_history": "📚 История",
}
VECTOR_PREFIX, VECTOR_LABEL = "ai", "ИИ"
#: Names of sheets, and headings among their rows.
SHEET_NAMES = ("БД", "бд", "BD", "bd", "База", "Sheet1")
PEOPLE_HEADERS, BRAND_HEADERS = ("Фамилия, имя", "ФИО"), ("Бренд", "Brand")
#: VAT of a stored layout that names no rate.
MAPPED_VAT = 0.12
MAPPING_KEYS = ("supplier_code", "supplier_name", "sheet", "header_row", "data_start_row", "columns")
#: Sheets that name a vendor at once, then (sheet, row, column, keyword, vendor) rules in order.
VENDOR_SHEETS = (("Продукция EKF", "ekf"), ("Прайс ДКС", "dkc"), ("Тариф 2026", "schneider"))
VENDOR_RULES = (
    ("Тариф", 3, 1, "референс", "himel"),
    ("Продукция EKF", 12, 1, "артикул", "ekf"),
    ("Прайс", 7, 1, "артикул", "iek"),
    ("Прайс ДКС", 11, 6, "код", "dkc"),
    ("Тариф", 4, 1, "id reference", "legrand"),
    ("Тариф 2026", 7, 1, "артикул", "schneider"),
)
#: Weekday (Monday is 0) on which a segment's vectors are rebuilt.
SEGMENT_WEEKDAYS = {"ss": 0, "os": 1, "sil": 4}
#: Characters that count as a hyphen, and quotes that are dropped.
DASHES = "[–—−‒]"
QUOTES = "[«»“”„‟‘’`]"
#: The end of a title from a standard on.
NORM_SUFFIX = r"(?i)\s+(ТУ|ГОСТ|СТ\s+РК)\s+\S+.*$"
#: Fields that a new match overwrites, and those that a reset clears.
REMATCH_FIELDS = ("status", "best_match", "candidates", "match_method", "ai_confidence", "ai_used", "ai_reason", "ai_low_confidence", "ai_downgraded")
RESET_FIELDS = ("best_match", "candidates", "match_method", "ai_confidence", "ai_used", "ai_reason", "user_edited", "user_const_price", "corrected", "comment", "delivery")
