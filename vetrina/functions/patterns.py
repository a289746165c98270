"""Regular expressions used by the operators (Java regex syntax).

Fixed values: these patterns decide which inputs are accepted, so they are
kept together here, in plain text.
"""

# One token of HTML after the other, so that what looks like a tag in a comment,
# a raw element or a quoted value is no tag. Quotes delimit a value only, after
# "=". Possessive and lazy repetition keep the JVM stack flat.
_INSIDE = r'''(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+'''
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_TAG = rf"<[a-z/!?]{_INSIDE}>"
# Group 1: attributes, ">" and body of a script element; empty for other tokens.
HTML_SCRIPT = (rf"(?is)<script(?=[\s/>])({_INSIDE}>.*?)(?:</script(?=[\s/>])|\z)|{_COMMENT}|"
               rf"<(style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]){_INSIDE}>.*?(?:</\2(?=[\s/>])|\z)|{_TAG}")
# The attributes of such a script and its body; an attribute's name and value.
SCRIPT_PARTS = rf"(?s)\A({_INSIDE})>(.*)\z"
ATTRIBUTE = r'''([^\s/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'][^\s]*))?'''
LD_JSON = "application/ld+json"

# A capacity in a product title: digits, optional space, "ml" in any case.
# (?U) gives Unicode digits and spaces, like Python's str patterns.
CAPACITY = r"(?iU)(\d+)\s*ml"

# A label score list: [["name", int], ...], single or double quotes, an
# optional trailing comma, an empty list allowed. Possessive repetition keeps
# the JVM stack flat on long replies.
SCORE_LIST = (
    r'''(?s)\A\s*\[\s*(?:\[\s*(?:"[^"]*"|'[^']*')\s*,\s*[+-]?\d+\s*\]'''
    r'''\s*(?:,\s*(?=[\[\]])|(?=\])))*+\]\s*\z'''
)

# One ("name", 0|1) pair anywhere in a damaged reply; the score may be quoted or signed.
SCORE_PAIR = r'''["']([^"']+)["']\s*,\s*["']?\+?([01])\b'''

# Decimal literal without exponent (xsd:decimal lexical space).
DECIMAL_TEXT = r"\A\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*\z"

# Slot formats accepted from a slot-filling reply.
SLOT_CAPACITY = r"\A\d+ ml\z"
SLOT_PRICE = r"\A< \d+\z"

# Price phrase of a keyword query ("minori di 30 euro", "meno di 30 euro").
PRICE_PHRASE = r"(?i)\b(?:minori|meno)\s+di\s+(\d+)(?:\s+euro)?\b"

# HTML to text: runs of comments, scripts, styles and tags. A block that isn't
# closed runs to the end of the page.
HTML_RUN = rf"(?is)(?:{_COMMENT}|<(script|style)(?=[\s/>]){_INSIDE}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)|{_TAG})++"
# A character reference at the start of what follows an ampersand, with or without its semicolon.
CHAR_REFERENCE = r"\A(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
TRIM_WS = r"\A[ \t\n\r\f]+|[ \t\n\r\f]+\z"

# Suffix that the shop appends to product node ids.
RICH_SNIPPET = "/#richSnippet"
