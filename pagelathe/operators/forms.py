"""Fixed values of waybill forms: titles, marks and patterns that readings of them have.

All of this must be as it is for right results; the logic that uses it is in ``waybills``.
"""

from __future__ import annotations

import re

from pagelathe.functions.validators import PLATE_CYRILLIC, PLATE_LATIN

I = re.IGNORECASE  # noqa: E741

#: What a field reads when nothing, or nothing legible, was found.
MISSING, GARBAGE = "отсутствует", "неразборчиво"
FIELDS = ("number", "date", "shipper", "consignee", "cargo", "volume", "driver", "vehicle", "reception")

# --- fixed values: titles, marks and patterns of the forms ---------------------------------
TITLES = {
    "reception": ("прием груза", "приём груза", "погрузка груза"),
    "consignee": ("грузополучатель", "покупатель"),
    "shipper": ("грузоотправитель", "продавец", "поставщик"),
    "vehicle": ("транспортное средство",),
    "carrier": ("перевозчик",),
    "cargo": ("груз",),
}
OTHER_TITLES = (
    "сопроводительные документы", "указания грузоотправителя", "условия перевозки", "информация о принятии", "оговорки и замечания", "прочие условия",
    "переадресовк", "стоимость услуг", "стоимость перевозки", "дата составления", "отметки", "выдача груза", "сдача груза",
)
BY_NUMBER = {"3": "cargo", "6": "carrier", "7": "vehicle", "8": "reception"}
FORM_DATES = {"30.11.2021", "21.12.2020", "26.12.2011", "02.04.2021", "02.04.2024", "11.12.2023"}
FORM_NUMBERS = {"1137", "2116", "2200", "2311", "272", "534", "1117"}
UPD = re.compile(r"счет[-\s]?фактура|универсал\w+\s+передаточн", I)
REGISTRY = re.compile(r"\bреестр\b|отгрузочн\w+\s+специф|товарн\w+\s+реестр", I)
HEADER = re.compile(r"транспортн\w+\s+накладн\w+", I)
FIRST_PAGE = re.compile(r"грузоотправ|грузополуч|перевозчик|транспортн\w+\s+средств", I)
ANCHOR = re.compile(r"(?mi)^\s*транспортн(?:ая|ой)\s+накладн(?:ая|ой)\b")
LEGAL_FORM = re.compile(r"\b(?:ООО|ОАО|АО|ЗАО|ПАО|НКО|ПБОЮЛ|ИП|ТОО|КФХ|АНО|ЧУ|ФГУП|ГУП|МУП|ФГБУ|ГБУ|НОУ|АНПО)\b|\b000(?=\s*[«\"'“”„А-ЯЁ])", I)
BANK = re.compile(r"\b(?:СБЕРБАНК|ВТБ|АЛЬФА[-\s]?БАНК|ГАЗПРОМБАНК|РОССЕЛЬХОЗБАНК|ОТКРЫТИЕ|РОСБАНК|ТИНЬКОФФ|УРАЛСИБ|ПСБ|СОВКОМБАНК|БИН[-\s]?БАНК|МКБ|МОСКОВСКИЙ\s+КРЕДИТНЫЙ|РАЙФФАЙЗЕН|ЮНИКРЕДИТ)\b", I)
MONEY_MARK = re.compile(r"\b(?:ИНН|КПП|ОГРН|ОКПО|ОКВЭД|БИК)\b", I)
INN_LABELLED = re.compile(r"\bИНН\s*\d{10,12}", I)
SERVICE = re.compile(r"(?:является\s+(?:экспедитором|грузоотправителем)|\(\s*реквизиты\b|полное\s+наименование|сокращ\w*\s+наименование|наименование\s+(?:юр|лица)|фио\b|ф\.?и\.?о\.?|экземпляр\s*№?|реквизиты\s+документа|да\b|нет\b|заказчик\s+услуг\b|при\s+наличи[ии]\b|[\[\(][\s xх×✓✔][\]\)]|[\-–—=_\s]{3,}|\([а-яА-Я]+\))", I)
PARTY_END = re.compile(r"(?:подпис[ьиея]|м\.?\s*п\.?\b|печат[ьи]\b|контактн(?:ое|ый|ого)\s+лиц|дата\s+составлен|ответственн[оы]й\s+за|должност[ьи]\b|доверенност|ф\.?\s*и\.?\s*о\.?\s+(?:водител|ответствен|предста))", I)
NEXT_FIELD = re.compile(r"\b(?:грузоотправител|грузополучател|перевозчик|транспортн(?:ое|ого)\s+средств|при[её]м\s+груз|выдач\w*\s+груз|переадресовк|сопроводительн|стоимость\s+(?:услуг|перевозк)|оговорк|отметк\w+\s+грузо|указан\w+\s+грузоотправ)", I)
CARGO_END = re.compile(r"(?:класс\s+опасност|упаковк|тара\b|способ\s+(?:погрузк|упаковк)|условия\s+(?:хранен|перевозк)|маркировк|номер\s+контейнер)", I)
CARGO_MEASURE = re.compile(r"(?:ед\.\s*изм|кол-во|количес|масс|объ[её]м|нетто|брутто|в том числе)\b", I)
CARGO_LABEL = re.compile(r"[^\nа-яёА-ЯЁa-zA-Z]{0,8}(?:\d+[.)]\s*)?[а-яА-Я\-\^'\"«»„]{0,3}?н.{1,5}мен\w*\s*[:\-–—‐-―−]+\s*(.*)$", I)
PIECES = r"(?:шт|штт|нтт|нт)"
PLACES = re.compile(r"\bкол[-\s]?во\s+мест\b|\bколичество\s+мест\b", I)
WEIGHTS = re.compile(r"нетто[^\n]*брутто[^\n]*(?:объ[её]м|м[³3])[^\n]*", I)
RECEPTION_END = re.compile(r"\n\s*(?:\d{1,2}\s*[.)]\s*(?:выдача\s+груз|переадресовк|отметк|стоимость|прочие\s+условия)|сдач\w*\s+груз|выдач\w*\s+груз|доставк\w*\s+груз|переадресовк|отметк\w+\s+грузоотпр)", I)
INITIALS = re.compile(r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.|\b[А-ЯЁ]\.\s?[А-ЯЁ]\.\s+[А-ЯЁ][а-яё]+|\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ]\.(?!\s?[А-ЯЁ])")
FULL_NAME = re.compile(r"\b[A-Za-zА-ЯЁа-яё]{3,14}[ \t]+[А-ЯЁ][а-яё]{2,14}[ \t]+[А-ЯЁ][а-яё]{2,14}\b")
DASH = r":\-–—‐-―−"
_G = f"[{PLATE_CYRILLIC}{PLATE_LATIN}]"
PLATE = re.compile(rf"(?:{_G}\d{{3}}{_G}{{2}}\s?\d{{2,3}}|{_G}{{2}}\d{{4}}\s?\d{{2,3}})(?!\d)")
CONTENT = re.compile(r"[А-Яа-яЁёA-Za-z]{4,}|\d{2}\.\d{2}\.\d{4}|\d{5,}")

# --- fixed values: what spoils a token, and notes of the form inside a line -----------------
QUOTES = "\"'`‘’‚‛“”„‟"
FRAME = " \t\r\n.,;:!?\"'«»()[]{}|\\/=_~^`<>*#$%+‐‑‒–—―‘’“”"
SPOILS_RAW = re.compile(rf"[А-ЯЁа-яёA-Za-z0-9][{QUOTES}]+[А-ЯЁа-яёA-Za-z]|[0-9][\"'`‘’]+$")
SPOILS_CORE = re.compile(rf"[іїєґІЇЄҐàáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸÑÇ]|[А-ЯЁа-яёA-Za-z0-9][{QUOTES[:-2]}]+$")
PARTICULARS = re.compile(r"\s*\([^)]*реквизиты[^)]*\)\s*$", I)
CUSTOMER, CUSTOMER_FORM = re.compile(r"заказчик\s+услуг", I), re.compile(r"\b(?:ООО|АО|ЗАО|ПАО|ИП|ПБОЮЛ)\b", I)
# --- fixed values: misread titles, what a number sign may belong to, labels -----------------
MISREAD_TITLES = {"consignee": r"груз[ово]{0,2}(?:получ|пелуч|палуч|опуч)", "shipper": r"груз[ов]{0,2}(?:отправ|тправ|втир|стправ|тир|тпр)"}
#: Number signs of other things: by what stands before them, within so many signs, on the same line or not.
OTHER_NUMBERS = (
    (20, True, re.compile(r"экземпляр|экз\.")),
    (10_000, True, re.compile(r"приложение|прил\.|постановлен|договор|к правилам")),
    (300, False, re.compile(r"постановлен|в ред\.|к правилам|правительств(?=[\s\S]*рф)|рф(?=[\s\S]*правительств)")),
    (300, False, re.compile(r"приложени(?=[\s\S]*(?:1137|2116|2200|534))|(?:1137|2116|2200|534)(?=[\s\S]*приложени)")),
)
NO_NUMBER = re.compile(r"транспортн|заказ|дата|экземпляр|№|no|приложение|.*накладн", I)
LOST_LABEL, TAIL_CRUMB = re.compile(r",\s*[И]н{1,2}\.?\s*,?\s*(?=\d{10,12}\b)", I), re.compile(r",\s*[А-Яа-яЁёA-Za-z]{1,3}\.?\s*$")
NAME_STEM = re.compile(r"мен[оае]ван\w*", I)
CARRIER_WORD, RECEPTION_WORD, HEADER_WORDS = r"п[ес][рст]евоз\w{0,5}", r"при[ёе]м\s+груз\w*", r"транспортн(?:ая|ой)\s+накладн(?:ая|ой)"
PLATE_LABELS = (r"гос\.?\s*номер", r"рег\.?\s*знак", r"государственн\w*\s+регистрационн\w*\s+номер")
