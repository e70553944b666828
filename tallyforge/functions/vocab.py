"""Fixed values that results depend on: units, patterns' word lists, labels. They are data, kept in natural order."""

# Units of measure and the spellings of each.
COLUMN_UNITS = {
    "шт": ["штук", "штука", "штуки", "шт"],
    "кг": ["кг", "килограмм", "килограмма", "килограммов"],
    "г": ["граммов", "грамма", "грамм", "гр", "г"],
    "м": ["метров", "метра", "метр", "м"],
    "мм": ["мм"],
    "л": ["литров", "литра", "литр", "л"],
    "уп": ["упаковок", "упаковки", "упаковка", "упак", "уп"],
    "компл": ["комплектов", "комплекта", "комплект", "компл"],
    "пач": ["пачек", "пачки", "пачка", "пач"],
    "м²": ["кв.м", "м²", "м2"],
    "м³": ["куб.м", "м³", "м3"],
}
# The units that may end a line of text.
TAIL_UNITS = {
    "шт": ["штук", "штука", "штуки", "шт", "pcs", "pc", "штк"],
    "кг": ["кг", "kg", "килограмм", "килограмма", "килограммов"],
    "г": ["г", "гр", "граммов", "грамма", "грамм"],
    "м": ["м", "метров", "метра", "метр"],
    "мм": ["мм", "mm"],
    "л": ["л", "литров", "литра", "литр"],
    "уп": ["упаковок", "упаковки", "упаковка", "упак", "уп"],
    "компл": ["комплектов", "комплекта", "комплект", "компл", "набор", "набора", "наборов"],
    "пач": ["пачек", "пачки", "пачка", "пач"],
    "пар": ["пар", "пара", "пары"],
    "м²": ["кв.м", "м²", "м2"],
    "м³": ["куб.м", "м³", "м3"],
    "т": ["т", "тонн", "тонна", "тонны", "ton", "tons"],
}
# Where a quantity was found, and why it was not.
FROM_COLUMN = "из колонки количества"
FROM_UNIT_COLUMN = "из отдельных колонок"
FROM_HEADER = "из заголовка"
FROM_NAME = "из наименования"
FROM_JOINED = "из объединённого текста"
NOT_FOUND = "не найдено"
UNKNOWN_UNIT = "Не распознана единица измерения в хвосте"
# Words that carry no meaning in names.
STOP_WORDS = ["для", "при", "без", "над", "под", "про", "все", "the", "and", "for", "not"]
TOKEN_STOP_WORDS = ["для", "при", "без", "над", "под", "про", "все", "или", "как", "the", "and", "for", "not", "with"]
KIT_MARKERS = ["комплект", "в сборе", "набор"]
# Strength codes at the end of a size, and in coded names.
STRENGTH_TAILS = {"129": "12.9", "109": "10.9", "88": "8.8", "98": "9.8", "68": "6.8", "58": "5.8", "56": "5.6", "48": "4.8", "46": "4.6"}
CODED_STRENGTHS = {"4": "4", "5": "5", "6": "6", "8": "8", "10": "10", "12": "12"}
CODED_COATINGS = {"016": "цинк 6мкм", "019": "цинк хром. 9мкм"}
# Stems of item types, in order of precedence.
TYPE_STEMS = [("саморез", "саморез"), ("шуруп", "шуруп"), ("болт", "болт"), ("винт", "винт"), ("гайк", "гайка"), ("шайб", "шайба"), ("шпильк", "шпилька"), ("анкер", "анкер")]
# Names of standards' kinds at the start of a text.
STANDARD_PREFIXES = [("гост р", "GOST"), ("гост", "GOST"), ("iso", "ISO"), ("исо", "ISO"), ("din", "DIN")]
# Cues of line classes in quotes.
TOTAL_WORDS = ["итого", "итог", "всего", "к оплате", "оплата", "задолженность", "баланс", "текущая", "просроченная", "погашение", "долг клиента"]
REQUISITE_WORDS = ["инн", "кпп", "банк", "р/с", "корр", "бик", "поставщик", "покупатель", "адрес", "тел", "email", "дог.", "договор", "основание", "грузоотправитель", "грузополучатель", "плательщик", "расчетный счет", "корреспондентский"]
TAX_WORDS = ["налог", "ндс", "без ндс", "в т.ч. ндс", "в том числе ндс", "nds"]
HEADER_WORDS = ["наименование", "название", "позиция", "номенклатура", "кол-во", "количество", "ед.", "единица", "цена", "стоимость", "сумма", "артикул", "код", "номер"]
DATE_WORDS = ["дата", "счет", "счёт", "от №", "счет-фактура", "накладная"]
ITEM_WORDS = ["болт", "гайка", "шайба", "винт", "саморез", "шуруп", "шпилька", "анкер", "дюбель", "заклепка", "гвоздь", "скоба", "диск", "круг", "лента", "пена", "герметик", "пистолет", "ключ", "труба", "фланец", "муфта", "хомут", "кабель", "провод", "электрод", "сверло", "бур", "коронка", "патрон", "пластина", "ролик", "втулка", "кольцо", "ось", "washer", "bolt", "nut", "screw", "anchor", "rivet", "nail"]
# Fields of the match fingerprint, in order.
FINGERPRINT_FIELDS = ["item_type", "size", "diameter", "length", "gost", "iso", "din", "strength", "coating"]
# Labels of fields in reasons.
FIELD_LABELS = {
    "code": "Код", "name": "Наименование", "qty": "Количество", "uom": "Ед.", "item_type": "Тип изделия", "diameter": "Диаметр", "length": "Длина", "size": "Размер",
    "strength": "Класс прочности", "coating": "Покрытие", "gost": "ГОСТ", "iso": "ISO", "din": "DIN", "status": "Статус", "confidence": "Уверенность",
    "standard_raw": "Стандарт (из файла)", "strength_raw": "Класс пр. (из файла)", "note_raw": "Примечание (из файла)", "reason": "Причина", "item_type_source": "Источник типа",
    "internal_match": "Наша номенклатура", "wrench_size": "Размер под ключ", "standard": "Стандарт (любой)", "width": "Ширина", "thickness": "Толщина",
    "validation_status": "Проверка", "validation_missing": "Не хватает",
}
# Units in free text lines, and service lines' beginnings.
NOTE_STARTS = [r"все\b", r"можно\b", r"особые\b", "требование", "примечание", "комментарий", r"итого\b", r"p\.?\s*s\.?\b", r"п\.?\s*с\.?\b"]
# Words of table headers.
HEADER_NAME_WORDS = ["наименование", "номенклатура", "товар", "позиция"]
HEADER_QTY_WORDS = ["количество", "кол-во", "кол во", "колво", "заказ", "потребность"]
HEADER_CODE_WORDS = ["код", "артикул", "арт"]
SUBHEADER_WORDS = ["шт", "ед.изм", "ед. изм", "единица", "штук"]
HEADER_TOKENS = [
    "наименование", "товар", "номенклатура", "позиция", "поз", "ед", "ед.", "ед.изм", "ед.изм.", "единица", "изм", "кол-во", "кол.", "количество", "qty", "uom", "amount",
    "price", "цена", "сумма", "итого", "код", "артикул", "арт", "арт.", "описание", "материал", "марка", "обозначение", "покрытие", "примечание", "стандарт", "класс",
    "№", "п/п", "п.п", "n", "no", "name", "item", "description", "unit",
]
HEADER_PARTS = ["наимен", "ед.изм", "ед изм", "арт.", "обозн", "кол-во"]
# Words of recognised text tables.
PRODUCT_NAME_WORDS = ["товар", "наименование", "товары", "product", "item", "услуги", "работы"]
PRODUCT_NUMBER_WORDS = ["кол-во", "количество", "qty", "ед", "шт", "кг", "цена", "сумма"]
SUMMARY_LINE = r"(?iuU)\b(?:итого|ндс|всего|к оплате|сумма по счету|в т\.?ч\.?\s*ндс|без ндс)\b"
