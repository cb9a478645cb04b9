"""Regular expressions and fixed values shared by the functions.

The values below are fixed by the data format: another spelling would give other
results.
"""

# --- fixed values: white space as Python's str methods and as JavaScript see it
PY_SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
JS_SPACE_SET = r"\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PY_SPACE = f"[{PY_SPACE_SET}]"
JS_SPACE = f"[{JS_SPACE_SET}]"
_WIDE_SPACES = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PY_SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85" + _WIDE_SPACES
JS_SPACE_CHARS = "\t\n\x0b\x0c\r " + _WIDE_SPACES + "\ufeff"
# Line ends of Python's splitlines.
PY_LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"

# --- fixed values: Markdown and HTML
DATA_URL = r"data:(image/[a-zA-Z0-9.+-]+);base64,([A-Za-z0-9+/=\r\n]+)"
IMAGE_TOKEN = r"note-image://([a-zA-Z0-9_-]+)"
IMAGE_LINK = r"!\[([^\]]*)\]\(([^)]+)\)"
HTML_BREAK = r"(?i)<br[" + PY_SPACE_SET + r"]*/?>"
HTML_BLOCK_END = r"(?iu)</(p|div|li|ul|ol|h[1-6]|section|article|blockquote|pre)>"
HTML_TAG = r"<[^>]+>"
HTML_TABLE = r"(?iU)<table\b[^>]*>(?s:.*?)</table>"
HTML_ROW = r"(?iU)<tr\b[^>]*>((?s:.*?))</tr>"
HTML_CELL = r"(?iU)<t[hd]\b[^>]*>((?s:.*?))</t[hd]>"
HTML_MEDIA = r"(?iU)<(img|video|audio|iframe|embed|object)\b"
TABLE_RULE = (
    rf"^{PY_SPACE}*\|?{PY_SPACE}*:?-{{3,}}:?{PY_SPACE}*"
    rf"(\|{PY_SPACE}*:?-{{3,}}:?{PY_SPACE}*)+\|?{PY_SPACE}*$"
)
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
BAD_FILE_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
# --- end of fixed values
