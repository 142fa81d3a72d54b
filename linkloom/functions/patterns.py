"""Fixed values shared by the Spark plans and the SQL oracle.

Every pattern here is written so that Java regex (Spark) and RE2 (DuckDB)
read it the same way: explicit character classes instead of ``\\s`` (ASCII in
both, but RE2 leaves out vertical tab), ``\\A``/``\\z`` anchors, ``\\x{..}``
escapes.
"""

from html.entities import name2codepoint

# --- fixed values: Python's str.isspace() set, i.e. what str.strip() removes ---
PY_SPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
PY_STRIP = f"\\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\\z"

# ASCII whitespace as Java's \s reads it (space, \t, \n, \x0B, \f, \r).
ASCII_SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"

# Word characters: letters and digits of any script.
NON_WORD = "[^\\p{L}\\p{N}]"
NON_WORD_OR_SPACE = "[^\\p{L}\\p{N} ]"
OUTER_NON_WORD = "\\A[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+\\z"

# --- fixed values: HTML extraction ---
# Text that is not shown.
HIDDEN_RE = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
# A tag's rest after its name: a quoted attribute may hold ">". Possessive, so that long tags need no backtracking.
_ATTRIBUTES = "[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"


def _open(names: str) -> str:
    return f"<(?:{names})(?:[\\s/]{_ATTRIBUTES})?>"


# One pass over all tags, left to right: the wanted ones are kept (group 1), any other is matched whole. A tag whose
# quotes do not close ends at its first ">".
WANTED_TAGS = "article|main|body|h1|title"
TAGS_RE = (f"(?is)({_open(WANTED_TAGS)}|</(?:{WANTED_TAGS})\\s*+>)|<[a-z/!?]{_ATTRIBUTES}>|<[a-z/!?][^>]*+>")
WANTED_RE = f"(?is){_open(WANTED_TAGS)}|</(?:{WANTED_TAGS})\\s*+>"
TITLE_RE = f"(?is){_open('title')}(.*?)</title\\s*+>"
H1_RE = f"(?is){_open('h1')}(.*?)</h1\\s*+>"
# The elements that hold the main text, the first that a page has.
MAIN_ELEMENTS = ["article", "main", "body"]
OPEN_RES = {name: f"(?is){_open(name)}" for name in MAIN_ELEMENTS}
CLOSE_RES = {name: f"(?is)</{name}\\s*+>" for name in MAIN_ELEMENTS}
# Character references: decimal, hexadecimal and named ones (HTML 4 names, from the standard library).
# "&amp;" is decoded last, so that "&amp;lt;" becomes the text "&lt;", not "<".
ENTITY_RE = "&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
NAMED_ENTITIES = {name: chr(point) for name, point in sorted(name2codepoint.items()) if name != "amp"} | {"apos": "'"}

# --- fixed values: entity extraction rules of the link contract ---
URL_EXTENSION_RE = "(?i)\\.(html?|php|aspx?)$"
URL_WORD_JOINERS_RE = "[_-]"
TITLE_SEPARATOR_RE = "[|–—]|-"

# A raw token ending in one of these closes a clause: no phrase spans it.
CLAUSE_END_CHARS = [".", "!", "?", ";", ":", ","]

# --- fixed values: CSV missing-value markers (pandas read_csv defaults) ---
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: job ledger ---
JOB_STATUSES = ["queued", "running", "paused", "completed", "failed", "stopped"]
ACTIVE_STATUSES = ["running", "paused"]
TERMINAL_STATUSES = ["completed", "failed", "stopped"]

# Suggestion table columns (fixed order for files).
SUGGESTION_COLUMNS = ["source_url", "anchor_text", "target_url", "entity_match"]
# Column names of the reference's CSV files.
SUGGESTION_HEADERS = ["Source URL", "Anchor Text", "Target URL", "Entity Match"]
CORPUS_HEADERS = ["URL", "H1", "Meta Title", "Content"]
