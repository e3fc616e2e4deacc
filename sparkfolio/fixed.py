"""Word lists, labels and patterns that have to equal those of the layouts and texts that results are compared with."""

from __future__ import annotations

#: Raw labels of layout elements and the type each stands for; any other label is its own type.
LABELS = {
    "header": "page_header",
    "footer": "page_footer",
    "number": "page_number",
    "page_no": "page_number",
    "pagenumber": "page_number",
    "footnote": "page_footnote",
    "aside_text": "page_aside_text",
    "doc_title": "title",
    "paragraph_title": "section_heading",
    "display_formula": "equation",
    "formula": "equation",
    "inline_formula": "inline_equation",
    "interline_formula": "interline_equation",
    "image_body": "image",
    "figure": "image",
    "chart_body": "chart",
    "stamp": "seal",
    "figure_title": "figure_caption",
    "image_title": "figure_caption",
    "table_title": "table_caption",
    "abstract": "text",
    "reference": "text",
    "references": "text",
    "content": "text",
}
FURNITURE_TEXT = ("page_header", "page_footer", "page_number")
FURNITURE_IMAGE = ("header_image", "footer_image")
FORMULA = ("equation", "inline_equation", "interline_equation", "display_equation", "formula_number")
VISUAL = ("image", "chart", "seal")
CAPTIONS_AND_TABLES = ("figure_caption", "table", "table_caption", "table_text")

#: Numbers of headings, as number and label: with dots inside, with a mark after them, with a dot that no digit follows.
HEADING_NUMBERS = (
    r"^(\d{1,3}(?:\.\d{1,3}){1,5}[、.)．:：]?)(\s+\S.*|[A-Za-z㐀-鿿].*)$",
    r"^(\d{1,3}\s*[、)．:：])\s*(\S.*)$",
    r"^(\d{1,3}\s*\.)(\s+\S.*|[^\s\d].*)$",
)
HEADING_MARKS = r"[、.)．:：]+$"
SENTENCE_END = r"[.!?;。！？；]$"

#: Cells that say the same in any language: dates, numbers with a unit, codes, formulae, abbreviations.
LOCKED_DATE = r"^\d{2,4}[./-]\d{1,2}[./-]\d{1,2}$"
LOCKED_NUMBER = r"^[<>≤≥±]?\s*[\d.,]+(?:\s*(?:%|‰|℃|°C|[A-Za-zμµ]+(?:/[A-Za-zμµ]+)?))?$"
LOCKED_CODE = r"^[A-Za-z][A-Za-z0-9_.()/-]*$"
CODE_MARK = r"[\d./()-]"
LOCKED_FORMULA = r"^(?:[A-Z][a-z]?\d*){2,}$"
ABBREVIATIONS = ("API", "CAPA", "GMP", "HPLC", "ICH", "N/A", "NA", "ND", "OOT", "OOS", "QA", "QC", "RRT", "RT", "SOP", "USP")

#: Protected inside a text: formulae, and a single capital after a Chinese character.
FORMULA_IN_TEXT = r"(?<![A-Za-z])(?:[A-Z][a-z]?\d*){2,}(?![A-Za-z])"
CAPITAL_AFTER_HAN = r"(?<=[㐀-鿿])[A-Z](?![A-Za-z])"

#: Marks that end a clause.
CLAUSE_MARKS = "，,；;。！？!?：:、"

#: A table for signatures: a word for signing close before one for a date.
SIGNATURE = r"(?is)(?:签名|签字|手签).{0,12}(?:日期|date)|signature.{0,12}(?:date|日期)"

#: What recognition makes of one abbreviation.
CONFUSED, MENDED = r"(?i)(?<![A-Za-z0-9])(?:0OS|O0S|00S)(?![A-Za-z0-9])", "OOS"

#: Numerals before a unit, and the digit of each.
NUMERALS, DIGITS, NUMERAL_UNIT = "〇零一二三四五六七八九", "00123456789", "车间"

#: A page number: ``n/m``, or a number with or without page marks.
PAGE_OF = r"^(\d+)\s*[/／]\s*(\d+)$"
PAGE = r"(?i)^(?:第\s*)?(\d+)(?:\s*页|\s*page)?$"
