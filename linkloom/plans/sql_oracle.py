"""Independent DuckDB SQL for every registered query.

Written in DuckDB's dialect against the raw driver views (``pages``,
``events``...). It shares nothing with the Spark side, neither plan code nor values.
"""

from __future__ import annotations

# Fixed values, written out: a wrong value in the code under test must not pass on both sides.
class P:
    HIDDEN_RE = '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>'
    ATTRIBUTES = '[^>"\']*(?:"[^"]*"[^>"\']*|\'[^\']*\'[^>"\']*)*'
    ASCII_SPACE_RUN = '[ \\t\\n\\x0B\\f\\r]+'
    CLAUSE_END_CHARS = ['.', '!', '?', ';', ':', ',']
    HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"),
                     ("&middot;", "\u00b7"), ("&eacute;", "\u00e9"), ("&#8211;", "\u2013"), ("&#x2013;", "\u2013"),
                     ("&amp;", "&")]
    NON_WORD = '[^\\p{L}\\p{N}]'
    NULL_MARKERS = ['', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null']
    OUTER_NON_WORD = '\\A[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+\\z'
    PY_STRIP = '\\A[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+\\z'
    TITLE_SEPARATOR_RE = '[|–—]|-'
    URL_EXTENSION_RE = '(?i)\\.(html?|php|aspx?)$'
    URL_WORD_JOINERS_RE = '[_-]'


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(P.PY_STRIP)}, '', 'g')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(P.ASCII_SPACE_RUN)}, ' ', 'g')"


def decode(x: str) -> str:
    for ent, txt in P.HTML_ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(txt)})"
    return x


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(P.NON_WORD)}, '', 'g')"


def tokens(x: str) -> str:
    return f"string_split({py_strip(collapse_ws(x))}, ' ')"


def corpus_cte(src: str, name: str = "corpus") -> str:
    def opens(names: str) -> str:
        return f"<(?:{names})(?:[\\s/]{P.ATTRIBUTES})?>"

    names = "article|main|body|h1|title"
    wanted = f"{opens(names)}|</(?:{names})\\s*>"
    any_tag = f"(?is)({wanted})|<[a-z/!?]{P.ATTRIBUTES}>|<[a-z/!?][^>]*>"
    text = lambda x: py_strip(collapse_ws(decode(f"regexp_replace({x}, {q('(?is)' + wanted)}, ' ', 'g')")))
    h1, title = (f"(?is){opens(e)}(.*?)</{e}\\s*>" for e in ("h1", "title"))
    marked = "CASE " + " ".join(
        f"WHEN regexp_matches(body, {q('(?is)' + opens(e))}) THEN regexp_replace(regexp_replace(body, {q('(?is)' + opens(e))}, chr(1), 'g'), "
        f"{q(f'(?is)</{e}' + chr(92) + 's*>')}, chr(2), 'g')" for e in ("article", "main", "body")) + " ELSE '' END"
    mark = "'[' || chr(1) || chr(2) || ']'"
    return f"""
{name}_kept AS (
  SELECT page_id, url, regexp_replace(regexp_replace(html, {q(P.HIDDEN_RE)}, ' ', 'g'), {q(any_tag)}, '\\1 ', 'g') AS shown FROM {src}
),
{name}_marked AS (
  SELECT page_id, url, shown, {marked} AS marked FROM (SELECT *, regexp_replace(shown, {q(h1)}, ' ', 'g') AS body FROM {name}_kept)
),
{name}_steps AS (
  SELECT *, list_transform(range(1, len(signs) + 2), lambda i: coalesce(list_sum(signs[1:i - 1]), 0)) AS sums
  FROM (SELECT *, list_transform(regexp_extract_all(marked, {mark}), lambda m: CASE WHEN m = chr(1) THEN 1 ELSE -1 END) AS signs,
               regexp_split_to_array(marked, {mark}) AS pieces FROM {name}_marked)
),
{name} AS (
  SELECT page_id, url, nullif({text(f"regexp_extract(shown, {q(h1)}, 1)")}, '') AS h1,
         nullif({text(f"regexp_extract(shown, {q(title)}, 1)")}, '') AS meta_title,
         {text("array_to_string(list_transform(list_filter(range(1, len(pieces) + 1), "
               "lambda i: sums[i] > least(0, list_min(sums[1:i]))), lambda i: pieces[i]), ' ')")} AS content
  FROM {name}_steps
)"""


CORPUS = corpus_cte("pages")

PAGE_VARIANTS = """
page_variants AS (
  SELECT page_id, url, CASE page_id % 9
    WHEN 1 THEN replace(html, '</article>', '<script>var hidden = 1 < 2;</script><!-- note --></article>')
    WHEN 2 THEN replace(html, '</article>', '</article><article><p>second &#8211; caf&eacute;</p></article>')
    WHEN 3 THEN replace(replace(html, '<article', '<main'), '</article>', '</main>')
    WHEN 4 THEN replace(replace(html, '<article', '<div'), '</article>', '</div>')
    WHEN 5 THEN replace(html, '</article>', '<article>nested</article> tail &#x2013; &amp;lt; &nosuch;</article>')
    WHEN 6 THEN replace(html, '</article>', '</article><nav>menu home login</nav><ARTICLE class=''x > y''>two text</ARTICLE >')
    WHEN 7 THEN replace(html, '</article>', '<b title="x > y <article>">bold</b> 1 < 2 <i lang="en>open</i></article>')
    WHEN 8 THEN replace(replace(html, '</article>', ''), '</body>', '</article></article>after</body>')
    ELSE html END AS html
  FROM pages
)"""

CORPUS_GAPS = """
corpus_gaps AS (
  SELECT page_id, url,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 13 = 0 THEN 'NA' ELSE h1 END AS h1,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN meta_title || ' - Site | Example'
         ELSE meta_title END AS meta_title,
    content
  FROM corpus
)"""

# The reference reads its CSV with pandas, which turns missing markers
# (including 'NA') into NaN; the same step on the gapped corpus.
_markers = ", ".join(q(m) for m in P.NULL_MARKERS)
CORPUS_READ = f"""
corpus_read AS (
  SELECT page_id, url,
    CASE WHEN h1 IN ({_markers}) THEN NULL ELSE h1 END AS h1,
    CASE WHEN meta_title IN ({_markers}) THEN NULL ELSE meta_title END AS meta_title,
    CASE WHEN content IN ({_markers}) THEN NULL ELSE content END AS content
  FROM corpus_gaps
)"""


def url_entity(u: str) -> str:
    seg = (f"CASE WHEN strpos({u}, '/') > 0 THEN "
           f"string_split(rtrim({u}, '/'), '/')[-1] ELSE '' END")
    words = py_strip(
        f"regexp_replace(regexp_replace({seg}, {q(P.URL_EXTENSION_RE.replace('(?i)', ''))}, '', 'gi'), "
        f"{q(P.URL_WORD_JOINERS_RE)}, ' ', 'g')")
    return f"(CASE WHEN {words} <> '' AND strpos({words}, '.') = 0 THEN {words} END)"


def h1_entity(h: str) -> str:
    return f"(CASE WHEN {h} <> '' THEN {py_strip(h)} END)"


def title_entity(t: str) -> str:
    head = py_strip(f"regexp_split_to_array({t}, {q(P.TITLE_SEPARATOR_RE)})[1]")
    return f"(CASE WHEN {t} <> '' AND {head} <> '' THEN {head} END)"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


# ---------------------------------------------------------------- entities
def entities_cte(src: str = "corpus", name: str = "ents") -> str:
    h, t = "coalesce(h1, '')", "coalesce(meta_title, '')"
    return f"""
{name} AS (
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY fpos) AS pos, origin, entity FROM (
    SELECT page_id, url, 1 AS fpos, 'url' AS origin, {url_entity('url')} AS entity FROM {src}
    UNION ALL SELECT page_id, url, 2, 'h1', {h1_entity(h)} FROM {src}
    UNION ALL SELECT page_id, url, 3, 'title', {title_entity(t)} FROM {src}
  ) WHERE entity IS NOT NULL
)"""


URL_PARTS_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def url_silo(u: str) -> str:
    segs = f"list_filter(string_split(regexp_extract({u}, {q(URL_PARTS_RE)}, 2), '/'), lambda s: s <> '')"
    return f"(lower(regexp_extract({u}, {q(URL_PARTS_RE)}, 1)) || '/' || coalesce({segs}[1], ''))"


def url_depth(u: str) -> str:
    segs = f"list_filter(string_split(regexp_extract({u}, {q(URL_PARTS_RE)}, 2), '/'), lambda s: s <> '')"
    return f"len({segs})"


_CLAUSE = ", ".join(q(c) for c in P.CLAUSE_END_CHARS)


def grams_cte(name: str, src: str, keep: str, text: str, with_anchor: bool,
              min_n: int = 2, max_n: int = 6) -> str:
    """Phrases of min_n..max_n tokens of ``text`` for each row of ``src``."""
    anchor = ""
    if with_anchor:
        anchor = (f", regexp_replace(array_to_string(list_slice(raw, i, i + n - 1), ' '), "
                  f"{q(P.OUTER_NON_WORD)}, '', 'g') AS anchor")
    ns = ", ".join(f"({k})" for k in range(min_n, max_n + 1))
    return f"""
{name}_tok AS (
  SELECT {keep}, raw,
    list_transform(raw, lambda t: {norm('t')}) AS nt,
    list_transform(raw, lambda t: right(t, 1) IN ({_CLAUSE})) AS brk
  FROM (SELECT {keep}, {tokens(text)} AS raw FROM {src})
),
{name} AS (
  SELECT {keep}, i AS pos, n, array_to_string(list_slice(nt, i, i + n - 1), ' ') AS gram{anchor}
  FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM {name}_tok) x, (VALUES {ns}) v(n)
  WHERE i + n - 1 <= len(raw)
    AND NOT list_contains(list_slice(nt, i, i + n - 1), '')
    AND NOT list_contains(list_slice(brk, i, i + n - 2), true)
)"""


def link_ctes(src: str = "corpus", k: int = 5, near_dup: bool = True) -> list[str]:
    """CTEs ending in ``ranked`` (all candidate pairs with rank) for L1-L11."""
    ctes = [
        entities_cte(src, "l_ents"),
        grams_cte("tgrams", "l_ents", "page_id, url, pos, origin", "entity", False),
        """
tphr AS (
  SELECT page_id AS target_id, url AS target_url, n, gram, arg_min(origin, pos) AS origin
  FROM tgrams GROUP BY page_id, url, n, gram
)""",
        f"""
pdf AS (SELECT n, gram, count(*) AS df FROM tphr GROUP BY n, gram),
tg AS (
  SELECT tphr.*, pdf.df, {url_silo('target_url')} AS t_silo, {url_depth('target_url')} AS t_depth
  FROM tphr JOIN pdf USING (n, gram)
)""",
        f"""
l_src AS (SELECT page_id, url, coalesce(content, '') AS content FROM {src})""",
        grams_cte("sgrams", "l_src", "page_id, url", "content", True),
        f"""
matches AS (
  SELECT s.page_id AS source_id, s.url AS source_url, {url_silo('s.url')} AS s_silo,
         {url_depth('s.url')} AS s_depth, s.pos, s.n, s.gram, s.anchor,
         t.target_id, t.target_url, t.t_silo, t.t_depth, t.origin, t.df
  FROM sgrams s JOIN tg t ON s.n = t.n AND s.gram = t.gram
  WHERE s.url <> t.target_url
),
pairs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY n DESC, df, pos) AS rn
    FROM matches) WHERE rn = 1
)""",
        f"""
sh_tok AS (
  SELECT page_id, list_filter(list_transform({tokens("coalesce(content, '')")}, lambda t: {norm('t')}),
                              lambda w: w <> '') AS words
  FROM {src}
),
sh AS (
  SELECT page_id, list_distinct(list_transform(range(1, len(words) - 3),
           lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) AS shl FROM sh_tok
),
shn AS (SELECT page_id, len(shl) AS nsh FROM sh),
shr AS (SELECT page_id, unnest(shl) AS s FROM sh),
pair_inter AS (
  SELECT p.source_id, p.target_id, count(*) AS inter
  FROM (SELECT DISTINCT source_id, target_id FROM pairs) p
  JOIN shr a ON a.page_id = p.source_id
  JOIN shr b ON b.page_id = p.target_id AND b.s = a.s
  GROUP BY p.source_id, p.target_id
),
dups AS (
  SELECT i.source_id, i.target_id, i.inter, na.nsh + nb.nsh - i.inter AS uni
  FROM pair_inter i JOIN shn na ON na.page_id = i.source_id JOIN shn nb ON nb.page_id = i.target_id
  WHERE na.nsh > 0 AND nb.nsh > 0 AND i.inter * 5 >= (na.nsh + nb.nsh - i.inter) * 4
)""",
        f"""
kept AS (
  SELECT p.*, CASE WHEN s_silo = t_silo AND t_depth < s_depth THEN 2
                   WHEN s_silo = t_silo THEN 1 ELSE 0 END AS priority
  FROM pairs p
  {"WHERE NOT EXISTS (SELECT 1 FROM dups d WHERE d.source_id = p.source_id AND d.target_id = p.target_id)" if near_dup else ""}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, df ASC, priority DESC,
                                pos ASC, target_url ASC, target_id ASC) AS rank
  FROM kept
)""",
    ]
    return ctes


def link_suggestions_sql(src_ctes: list[str], src: str = "corpus", k: int = 5) -> str:
    return with_ctes(*src_ctes, *link_ctes(src, k), body=f"""
SELECT source_url, anchor AS anchor_text, target_url, origin || ': ' || gram AS entity_match, rank
FROM ranked WHERE rank <= {k}""")


# ---------------------------------------------------------------- fixtures
def words_sql(text: str, start: int, count: int) -> str:
    return f"array_to_string(list_slice(string_split({text}, ' '), {start}, {start + count - 1}), ' ')"


SUGGESTIONS = f"""
sg_c AS (SELECT page_id, url, h1, content FROM corpus),
sg_t AS (SELECT page_id AS t_id, url AS t_url, h1 AS t_h1 FROM corpus),
sg_next AS (SELECT page_id AS from_id, coalesce(lead(page_id) OVER (ORDER BY page_id),
              min(page_id) OVER ()) AS next_id FROM corpus),
sg_base AS (SELECT c.*, t.* FROM sg_c c JOIN sg_next x ON x.from_id = c.page_id JOIN sg_t t ON t.t_id = x.next_id),
suggestions AS (
  SELECT page_id AS source_id, url AS source_url,
    CASE WHEN page_id % 10 = 4 THEN {words_sql('content', 1, 1)}
         WHEN page_id % 10 = 5 THEN 'zq absent words' ELSE {words_sql('content', 1, 3)} END AS anchor_text,
    CASE WHEN page_id % 10 = 1 THEN t_url || '?unknown=1' WHEN page_id % 10 = 2 THEN url
         ELSE t_url END AS target_url,
    'h1: ' || coalesce(t_h1, '') AS entity_match, 1 AS seq
  FROM sg_base
  UNION ALL
  SELECT page_id, url, {words_sql('content', 4, 3)}, t_url, 'h1: ' || coalesce(t_h1, ''), 2
  FROM sg_base WHERE page_id % 10 = 3
  UNION ALL
  SELECT c.page_id, c.url, {words_sql('c.content', 1, 3)}, t.t_url, 'h1: ' || coalesce(t.t_h1, ''), o.off
  FROM sg_c c CROSS JOIN (SELECT unnest(range(2, 8)) AS off) o
  JOIN sg_t t ON t.t_id = c.page_id + o.off
  WHERE c.page_id % 10 = 6
)"""


def _clean_words(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({x}, ' '), lambda t: {norm('t')}), "
            f"lambda w: w <> ''), ' ')")


_NL = "chr(10)"
RESPONSES = f"""
resp_items AS (
  SELECT source_id, source_url,
    string_agg('{{"anchor_text": "' || {_clean_words('anchor_text')} || '", "target_url": "' || target_url
               || '", "entity_match": "seq ' || CAST(seq AS VARCHAR) || '", "relevance": "r"}}', ', '
               ORDER BY seq, target_url, anchor_text) AS items
  FROM suggestions GROUP BY source_id, source_url
),
responses AS (
  SELECT source_id, source_url, 1 AS response_no,
    CASE source_id % 5
      WHEN 0 THEN '[' || items || ']'
      WHEN 1 THEN 'Here are the suggestions:' || {_NL} || '```json' || {_NL} || '[' || items || ']'
                  || {_NL} || '```' || {_NL} || 'Hope this helps.'
      WHEN 2 THEN '[1, {{"note": "none"}}, ' || items || ']'
      WHEN 3 THEN '{{"anchor_text": "x y", "target_url": "' || source_url || '"}}'
      ELSE '[' || left(items, CAST(floor(length(items) / 2) AS INTEGER)) END AS response_text
  FROM resp_items
  UNION ALL
  SELECT source_id, source_url, 2, '[' || items || ']' FROM resp_items WHERE source_id % 10 = 6
)"""

ARRAY_SPAN_RE = "(?s)\\[.*\\]"

RESPONSE_PARSE = f"""
rp0 AS (SELECT source_url, response_no, {py_strip("coalesce(response_text, '')")} AS t FROM responses),
rp1 AS (SELECT source_url, response_no, t, json_valid(t) AS d_ok, regexp_extract(t, {q(ARRAY_SPAN_RE)}, 0) AS span FROM rp0),
parsed AS (
  SELECT source_url, response_no,
    CASE WHEN d_ok THEN 'direct' WHEN span <> '' AND json_valid(span) THEN 'fallback' ELSE 'failed' END AS parse_status,
    CASE WHEN d_ok THEN CAST(t AS JSON) WHEN span <> '' AND json_valid(span) THEN CAST(span AS JSON) END AS root
  FROM rp1
),
r_items AS (
  SELECT source_url, response_no, pos, json_extract(root, '$[' || CAST(pos AS VARCHAR) || ']') AS el
  FROM (SELECT source_url, response_no, root, unnest(range(0, CAST(json_array_length(root) AS BIGINT))) AS pos
        FROM parsed WHERE json_type(root) = 'ARRAY')
),
r_valid AS (
  SELECT * FROM r_items
  WHERE json_extract(el, '$.anchor_text') IS NOT NULL AND json_extract(el, '$.target_url') IS NOT NULL
)"""

def _event_case(moves: dict) -> str:
    return "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in moves.items()) + " END"


_BASE_COMMANDS = {"signup": "create", "view": "start", "click": "pause", "purchase": "complete", "error": "stop"}
RUN_EVENTS = f"""
run_events AS (
  SELECT user_id AS job_id, CASE WHEN user_id % 4 = 1 THEN ts + INTERVAL 28 DAY ELSE ts END AS ts, event_id,
    CASE user_id % 5
      WHEN 0 THEN {_event_case({**_BASE_COMMANDS, "purchase": "start", "error": "pause"})}
      WHEN 1 THEN {_event_case({**_BASE_COMMANDS, "purchase": "start", "error": "fail"})}
      WHEN 2 THEN {_event_case({k: "create" if k == "signup" else "pause" for k in _BASE_COMMANDS})}
      ELSE {_event_case(_BASE_COMMANDS)} END AS cmd
  FROM events
)"""

# Accepted commands, written out: (command, status before, status after).
_MOVES = [
    ("create", "none", "queued"), ("start", "queued", "running"), ("start", "paused", "running"),
    ("pause", "running", "paused"), ("complete", "running", "completed"), ("stop", "running", "stopped"),
    ("stop", "paused", "stopped"), ("fail", "queued", "failed"), ("fail", "running", "failed"), ("fail", "paused", "failed"),
]


def fold_case() -> str:
    whens = [f"WHEN c = {q(c)} AND acc.s = {q(a)} THEN {{'s': {q(b)}, 'a': acc.a + 1}}" for c, a, b in _MOVES]
    return "CASE " + " ".join(whens) + " ELSE acc END"


def move_case(cmd: str, status: str) -> str:
    whens = [f"WHEN {cmd} = {q(c)} AND {status} = {q(a)} THEN {q(b)}" for c, a, b in _MOVES]
    return "CASE " + " ".join(whens) + f" ELSE {status} END"


JOBS = f"""
j_fold AS (
  SELECT job_id, count(*) AS n_events,
    list_reduce(list(cmd ORDER BY ts, event_id), lambda acc, c: {fold_case()}, {{'s': 'none', 'a': 0}}) AS r
  FROM run_events GROUP BY job_id
),
job_state AS (
  SELECT job_id, CASE WHEN r.s <> 'none' THEN r.s END AS status, CAST(r.a AS BIGINT) AS accepted,
         n_events - r.a AS ignored, n_events FROM j_fold
),
job_latest AS (
  SELECT job_id, min(ts) AS created_at, max(ts) AS updated_at,
         arg_max(event_id, (ts, event_id)) AS last_event_id, arg_max(cmd, (ts, event_id)) AS last_cmd,
         count(*) AS n_events
  FROM run_events GROUP BY job_id
),
jobs AS (
  SELECT CAST(l.job_id AS VARCHAR) AS job_id, s.status, l.n_events AS total_pages, s.accepted AS current_page,
         l.created_at, l.updated_at, CAST(s.accepted AS DOUBLE) / CAST(greatest(1, l.n_events) AS DOUBLE) AS progress
  FROM job_latest l JOIN job_state s USING (job_id)
)"""


# ------------------------------------------------------------------ queries
def _w(*ctes, body):
    return with_ctes(*ctes, body=body)


_C = [CORPUS]
_CR = [CORPUS, CORPUS_GAPS, CORPUS_READ]
_BF = "coalesce(h1, '') AS h1, coalesce(meta_title, '') AS meta_title"
_LS = link_ctes("corpus")


def _ranked_body(k: int) -> str:
    return f"SELECT * FROM ranked WHERE rank <= {k}"


def _link_sugg(k: int = 5) -> str:
    return (f"SELECT source_url, anchor AS anchor_text, target_url, origin || ': ' || gram AS entity_match, "
            f"rank FROM ranked WHERE rank <= {k}")


_AUDIT_FIX = f"""
audit_cat AS (SELECT DISTINCT url AS target_url FROM corpus),
audit_src AS (SELECT url AS source_url, arg_min(coalesce(content, ''), page_id) AS content FROM corpus GROUP BY url),
audit AS (
  SELECT s.source_url, s.anchor_text, s.target_url, CAST(s.seq AS BIGINT) AS seq,
    s.target_url NOT IN (SELECT target_url FROM audit_cat) AS unknown_target,
    s.source_url = s.target_url AS self_link,
    row_number() OVER (PARTITION BY s.source_url, s.target_url ORDER BY s.seq, s.anchor_text) > 1 AS duplicate_target,
    NOT (CASE WHEN {py_strip(collapse_ws("coalesce(s.anchor_text, '')"))} = '' THEN 0
              ELSE len(string_split({py_strip(collapse_ws("coalesce(s.anchor_text, '')"))}, ' ')) END
         BETWEEN 2 AND 6) AS bad_length,
    (coalesce(s.anchor_text, '') = '' OR NOT coalesce(strpos(a.content, coalesce(s.anchor_text, '')) > 0, false)) AS not_verbatim,
    row_number() OVER (PARTITION BY s.source_url ORDER BY s.seq, s.target_url, s.anchor_text) > 5 AS over_cap
  FROM AUDIT_INPUT s LEFT JOIN audit_src a ON a.source_url = s.source_url
)"""

_FLAGS = ["unknown_target", "self_link", "duplicate_target", "bad_length", "not_verbatim", "over_cap"]
_TOTALS = ("SELECT count(*) AS suggestions, count(DISTINCT source_url) AS sources, "
           + ", ".join(f"CAST(sum(CAST({f} AS INTEGER)) AS BIGINT) AS {f}" for f in _FLAGS)
           + ", CAST(sum(CAST(" + " OR ".join(_FLAGS) + " AS INTEGER)) AS BIGINT) AS any_violation FROM audit")

_ORDERED = """
ordered AS (
  SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS page_no, count(*) OVER () AS total_pages
  FROM corpus
)"""

_BLOCK = ("CAST(page_no AS VARCHAR) || '. URL: ' || url || chr(10) || '   H1: ' || h1 || chr(10) "
          "|| '   Meta Title: ' || meta_title || chr(10) || chr(10)")

_ENTITY_LIST = f"""
SELECT page_id, CAST(count(entity) AS BIGINT) AS n_entities,
       coalesce(string_agg(entity, ' | ' ORDER BY fpos), '') AS entities
FROM (
  SELECT page_id, 1 AS fpos, {url_entity('url')} AS entity FROM corpus_read
  UNION ALL SELECT page_id, 2, {h1_entity("coalesce(h1, '')")} FROM corpus_read
  UNION ALL SELECT page_id, 3, {title_entity("coalesce(meta_title, '')")} FROM corpus_read
) GROUP BY page_id"""

ORACLE = {
    "corpus_from_html": _w(PAGE_VARIANTS, corpus_cte("page_variants"), body="SELECT * FROM corpus"),
    "corpus_scan": _w(*_CR, body="SELECT url, h1, meta_title, content FROM corpus_read"),
    "null_markers": _w(*_CR, body="SELECT page_id, h1, meta_title FROM corpus_read"),
    "suggestions_reload": _w(*_C, *_LS, body=f"SELECT source_url, anchor_text, target_url, entity_match "
                                              f"FROM ({_link_sugg()})"),
    "resume_append": _w(*_C, *_LS, body=_link_sugg()),
    "job_records": _w(RUN_EVENTS, JOBS, body="SELECT job_id, status, total_pages, current_page FROM jobs"),
    "blank_fill": _w(*_CR, body=f"SELECT page_id, {_BF}, coalesce(content, '') AS content FROM corpus_read"),
    "url_entity": _w(*_CR, body=f"SELECT page_id, entity FROM (SELECT page_id, {url_entity('url')} AS entity "
                                 f"FROM corpus_read) WHERE entity IS NOT NULL"),
    "h1_entity": _w(*_CR, body=f"SELECT page_id, entity FROM (SELECT page_id, "
                                f"{h1_entity('coalesce(h1, chr(0))'.replace('chr(0)', chr(39) * 2))} AS entity "
                                f"FROM corpus_read) WHERE entity IS NOT NULL"),
    "title_entity": _w(*_CR, body=f"SELECT page_id, entity FROM (SELECT page_id, "
                                   f"{title_entity('coalesce(meta_title, ' + chr(39) * 2 + ')')} AS entity "
                                   f"FROM corpus_read) WHERE entity IS NOT NULL"),
    "entity_list": _w(*_CR, body=_ENTITY_LIST),
    "entity_rows": _w(*_CR, entities_cte("corpus_read", "ents"),
                      body="SELECT page_id, CAST(pos AS BIGINT) AS pos, origin, entity FROM ents"),
    "catalogue_rows": _w(*_CR, body=f"SELECT row_number() OVER (ORDER BY page_id) AS page_no, url, {_BF} "
                                     f"FROM corpus_read"),
    "catalogue_blocks": _w(*_CR, body=f"SELECT page_no, {_BLOCK} AS block FROM (SELECT row_number() OVER "
                                       f"(ORDER BY page_id) AS page_no, url, {_BF} FROM corpus_read)"),
    "link_requests": _w(*_C, *link_ctes("corpus"), body="""
SELECT c.url AS source_url, coalesce(c.h1, '') AS h1, coalesce(c.meta_title, '') AS meta_title,
       coalesce(c.content, '') AS content, CAST(least(coalesce(r.found, 0), 10) AS BIGINT) AS n_candidates,
       coalesce(r.candidates, '') AS candidates, coalesce(r.found, 0) > 10 AS more_candidates, CAST(5 AS BIGINT) AS k
FROM corpus c LEFT JOIN (
  SELECT source_id, count(*) AS found,
         string_agg(target_url || ' | ' || coalesce(t.h1, '') || ' | ' || coalesce(t.meta_title, ''), chr(10) ORDER BY rank)
           FILTER (WHERE rank <= 10) AS candidates
  FROM ranked JOIN corpus t ON t.page_id = target_id WHERE rank <= 11 GROUP BY source_id) r ON r.source_id = c.page_id"""),
    "content_head_words": f"SELECT doc_id, array_to_string(list_slice({tokens('text')}, 1, 500), ' ') AS head "
                          f"FROM documents",
    "content_head_chars": "SELECT doc_id, left(text, 500) AS head FROM documents",
    "remaining_pages": _w(*_C, _ORDERED, body="SELECT page_no, url FROM ordered WHERE page_no > floor(total_pages / 2)"),
    "progress_series": _w(*_C, _ORDERED, body="SELECT page_no AS current_page, total_pages FROM ordered "
                                               "WHERE page_no > floor(total_pages / 2)"),
    "expired_jobs": _w(RUN_EVENTS, JOBS, body="SELECT job_id, created_at FROM jobs WHERE created_at < "
                                               "TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"),
    "active_jobs": _w(RUN_EVENTS, JOBS, body="SELECT job_id, status FROM jobs WHERE status IN ('running', 'paused')"),
    "terminal_jobs": _w(RUN_EVENTS, JOBS, body="SELECT job_id, status FROM jobs "
                                                "WHERE status IN ('completed', 'failed', 'stopped')"),
    "response_parse": _w(*_C, SUGGESTIONS, RESPONSES, RESPONSE_PARSE, body="""
SELECT source_url, response_no, parse_status,
       CASE WHEN json_type(root) = 'ARRAY' THEN CAST(json_array_length(root) AS BIGINT) END AS n_items
FROM parsed"""),
    "response_items": _w(*_C, SUGGESTIONS, RESPONSES, RESPONSE_PARSE,
                         body="SELECT source_url, response_no, CAST(pos AS BIGINT) AS pos FROM r_valid"),
    "response_suggestions": _w(*_C, SUGGESTIONS, RESPONSES, RESPONSE_PARSE, body="""
SELECT source_url, response_no, json_extract_string(el, '$.anchor_text') AS anchor_text,
       json_extract_string(el, '$.target_url') AS target_url,
       json_extract_string(el, '$.entity_match') AS entity_match, CAST(pos AS BIGINT) AS item_pos
FROM (SELECT *, row_number() OVER (PARTITION BY source_url, response_no ORDER BY pos) AS rn FROM r_valid) WHERE rn <= 5"""),
    "response_outcomes": _w(*_C, SUGGESTIONS, RESPONSES, RESPONSE_PARSE,
                            body="SELECT parse_status, count(*) AS responses FROM parsed GROUP BY parse_status"),
    "phrase_links": _w(*_C, *_LS, body="SELECT s.page_id AS source_id, CAST(s.n AS BIGINT) AS n, s.gram, "
                                        "CAST(any_value(pdf.df) AS BIGINT) AS df, CAST(min(s.pos) AS BIGINT) AS start_pos "
                                        "FROM sgrams s JOIN pdf ON s.n = pdf.n AND s.gram = pdf.gram "
                                        "GROUP BY s.page_id, s.n, s.gram"),
    "one_link_per_target": _w(*_C, *_LS, body="SELECT source_id, target_id, CAST(n AS BIGINT) AS n, "
                                               "CAST(df AS BIGINT) AS df, CAST(pos AS BIGINT) AS start_pos, gram FROM pairs"),
    "near_duplicate_pairs": _w(*_C, *_LS, body="SELECT source_id, target_id, CAST(inter AS BIGINT) AS inter, "
                                                "CAST(uni AS BIGINT) AS uni FROM dups"),
    "link_priority": _w(*_C, *_LS, body="""
SELECT source_id, target_id, CAST(CASE WHEN s_silo = t_silo AND t_depth < s_depth THEN 2
                                       WHEN s_silo = t_silo THEN 1 ELSE 0 END AS BIGINT) AS priority FROM pairs"""),
    "link_classes": _w(*_C, *_LS, body="""
SELECT source_id, gram, CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df, CAST(min(pos) AS BIGINT) AS start_pos, priority,
       count(DISTINCT target_id) AS links
FROM (SELECT *, CAST(CASE WHEN s_silo = t_silo AND t_depth < s_depth THEN 2 WHEN s_silo = t_silo THEN 1 ELSE 0 END AS BIGINT)
                AS priority FROM matches)
GROUP BY source_id, gram, n, df, priority"""),
    "link_class_members": _w(*_C, *_LS, body="SELECT gram, CAST(n AS BIGINT) AS n, target_id, t_silo, "
                                              "CAST(t_depth AS BIGINT) AS t_depth, origin FROM tg WHERE target_url IS NOT NULL"),
    "duplicate_classes": _w(*_C, *_LS, """
alike AS (
  SELECT a.page_id AS u, b.page_id AS v, count(*) AS inter
  FROM shr a JOIN shr b ON a.s = b.s AND a.page_id <> b.page_id GROUP BY u, v
),
near AS (
  SELECT u, v FROM alike JOIN shn x ON x.page_id = u JOIN shn y ON y.page_id = v
  WHERE inter * 5 >= (x.nsh + y.nsh - inter) * 4
),
reach AS (
  SELECT page_id AS id, page_id AS r FROM corpus
  UNION SELECT reach.id, near.v FROM reach JOIN near ON near.u = reach.r
)""", body="SELECT id AS page_id, min(r) AS class_id FROM reach GROUP BY id").replace("WITH", "WITH RECURSIVE", 1),
    "top_k_links": _w(*_C, *_LS, body="SELECT source_id, target_id, rank FROM ranked WHERE rank <= 3"),
    "link_suggestions": _w(*_C, *_LS, body=_link_sugg()),
    "unknown_targets": _w(*_C, SUGGESTIONS, body="""
SELECT source_url, anchor_text, target_url, CAST(seq AS BIGINT) AS seq FROM suggestions s
WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.url = s.target_url)"""),
    "self_links": _w(*_C, SUGGESTIONS, body="SELECT source_url, anchor_text, target_url, CAST(seq AS BIGINT) AS seq "
                                             "FROM suggestions WHERE source_url = target_url"),
    "anchor_verbatim": _w(*_C, SUGGESTIONS, _AUDIT_FIX.replace("AUDIT_INPUT", "suggestions"),
                          body="SELECT source_url, anchor_text, target_url, seq, NOT not_verbatim AS anchor_verbatim FROM audit"),
    "anchor_length": _w(*_C, SUGGESTIONS, body=f"""
SELECT source_url, anchor_text, CAST(seq AS BIGINT) AS seq, CAST(nw AS BIGINT) AS n_words,
       nw BETWEEN 2 AND 6 AS length_ok
FROM (SELECT *, CASE WHEN {py_strip(collapse_ws('anchor_text'))} = '' THEN 0
                     ELSE len(string_split({py_strip(collapse_ws('anchor_text'))}, ' ')) END AS nw FROM suggestions)"""),
    "suggestion_audit": _w(*_C, SUGGESTIONS, _AUDIT_FIX.replace("AUDIT_INPUT", "suggestions"),
                           body="SELECT * FROM audit"),
    "audit_totals": _w(*_C, SUGGESTIONS, _AUDIT_FIX.replace("AUDIT_INPUT", "suggestions"), body=_TOTALS),
    "link_audit_totals": _w(*_C, *_LS, f"link_sugg AS (SELECT source_url, anchor_text, target_url, rank AS seq "
                                       f"FROM ({_link_sugg()}))",
                            _AUDIT_FIX.replace("AUDIT_INPUT", "link_sugg"), body=_TOTALS),
    "corpus_stats": _w(*_CR, body="SELECT count(*) AS total_pages, count(h1) AS pages_with_h1, "
                                   "count(meta_title) AS pages_with_title FROM corpus_read"),
    "suggestion_stats": _w(*_C, *_LS, f"ls AS ({_link_sugg()})", body="""
SELECT total_suggestions, pages_with_suggestions,
       coalesce(CAST(total_suggestions AS DOUBLE) / nullif(pages_with_suggestions, 0), 0.0) AS avg_per_page
FROM (SELECT count(*) AS total_suggestions, count(DISTINCT source_url) AS pages_with_suggestions FROM ls)"""),
    "job_progress": _w(RUN_EVENTS, JOBS, body="SELECT job_id, current_page, total_pages, progress FROM jobs"),
    "page_ordinal": _w(*_C, body="SELECT page_id, row_number() OVER (ORDER BY page_id) AS page_no FROM corpus"),
    "job_latest": _w(RUN_EVENTS, JOBS, body="SELECT * FROM job_latest"),
    "job_state_fold": _w(RUN_EVENTS, JOBS, body="SELECT * FROM job_state"),
    "job_status_spans": f"""
WITH RECURSIVE {RUN_EVENTS},
sp_ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM run_events),
sp_st AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, 'none' AS before, 'none' AS s FROM sp_ev
  UNION ALL
  SELECT e.job_id, e.rn, st.s, {move_case('e.cmd', 'st.s')}
  FROM sp_st st JOIN sp_ev e ON e.job_id = st.job_id AND e.rn = st.rn + 1
)
SELECT e.job_id, e.event_id, nullif(before, 'none') AS prev_status, s AS status,
       epoch_us(lead(ts) OVER (PARTITION BY e.job_id ORDER BY e.rn)) - epoch_us(ts) AS micros_in_status
FROM sp_st JOIN sp_ev e USING (job_id, rn) WHERE s <> before""",
    "job_listing": _w(RUN_EVENTS, JOBS, body="""
SELECT row_number() OVER (ORDER BY created_at DESC, job_id ASC) AS list_pos, job_id, status,
       replace(left(CAST(created_at AS VARCHAR), 19), 'T', ' ') AS created
FROM jobs"""),
    "corpus_preview": _w(*_CR, body=f"SELECT row_number() OVER (ORDER BY page_id) AS page_no, url, {_BF} "
                                     f"FROM corpus_read ORDER BY page_id LIMIT 10"),
    "suggestion_preview": _w(*_C, *_LS, body=f"""
SELECT *, row_number() OVER (ORDER BY source_url, rank) AS preview_pos
FROM ({_link_sugg()}) ORDER BY source_url, rank LIMIT 20"""),
    "stream_link_suggestions": _w(*_C, *_LS, body=_link_sugg()),
    "stream_growing_links": _w(*_C, *_LS, body=_link_sugg() + " AND source_id % 2 = 1"),
    "run_totals": _w(*_C, *_LS, f"ls AS ({_link_sugg()})", body="""
SELECT total_suggestions, pages_with_suggestions,
       coalesce(CAST(total_suggestions AS DOUBLE) / nullif(pages_with_suggestions, 0), 0.0) AS avg_per_page
FROM (SELECT count(*) AS total_suggestions, count(DISTINCT source_url) AS pages_with_suggestions FROM ls)"""),
    "stream_suggestion_stats": _w(*_C, *_LS, f"ls AS ({_link_sugg()})", body="""
SELECT total_suggestions, pages_with_suggestions,
       coalesce(CAST(total_suggestions AS DOUBLE) / nullif(pages_with_suggestions, 0), 0.0) AS avg_per_page
FROM (SELECT count(*) AS total_suggestions, count(DISTINCT source_url) AS pages_with_suggestions FROM ls)"""),
    "stream_corpus_stats": _w(*_CR, body="SELECT count(*) AS total_pages, count(h1) AS pages_with_h1, "
                                          "count(meta_title) AS pages_with_title FROM corpus_read"),
    "stream_job_state": _w(RUN_EVENTS, JOBS, body="SELECT job_id, status, accepted, ignored, n_events, "
                                                    "CAST(CASE WHEN job_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS late "
                                                    "FROM job_state"),
}


def _word_rows(src: str, text: str) -> str:
    return (f"SELECT page_id, unnest(list_filter(list_transform({tokens(text)}, lambda t: {norm('t')}), "
            f"lambda w: w <> '')) AS w FROM {src}")


ORACLE["topic_relevance"] = _w(*_C, *_LS, f"""
tr_words AS ({_word_rows('corpus', "coalesce(content, '')")}),
tr_idf AS (
  SELECT w, ln(CAST((SELECT count(*) FROM corpus) AS DOUBLE) / CAST(df AS DOUBLE)) AS idf
  FROM (SELECT w, count(DISTINCT page_id) AS df FROM tr_words GROUP BY w)
),
tr_sv AS (SELECT page_id, w, count(*) * any_value(idf) AS x FROM tr_words JOIN tr_idf USING (w) GROUP BY page_id, w),
tr_ew AS ({_word_rows('l_ents', 'entity')}),
tr_tv AS (SELECT page_id, w, count(*) * any_value(idf) AS x FROM tr_ew JOIN tr_idf USING (w) GROUP BY page_id, w),
tr_ns AS (SELECT page_id, sqrt(sum(x * x)) AS ns FROM tr_sv GROUP BY page_id),
tr_nt AS (SELECT page_id, sqrt(sum(x * x)) AS nt FROM tr_tv GROUP BY page_id),
tr_keys AS (SELECT source_id, target_id, source_url, target_url, anchor, origin, gram, rank FROM ranked WHERE rank <= 5),
tr_dot AS (
  SELECT k.source_id, k.target_id, sum(s.x * t.x) AS dot
  FROM tr_keys k JOIN tr_tv t ON t.page_id = k.target_id
  JOIN tr_sv s ON s.page_id = k.source_id AND s.w = t.w
  GROUP BY k.source_id, k.target_id
)""", body="""
SELECT k.source_url, k.anchor AS anchor_text, k.target_url, k.origin || ': ' || k.gram AS entity_match, k.rank,
       round(CASE WHEN ns > 0 AND nt > 0 THEN coalesce(d.dot, 0.0) / (ns * nt) ELSE 0.0 END, 6) AS relevance
FROM tr_keys k
LEFT JOIN tr_dot d ON d.source_id = k.source_id AND d.target_id = k.target_id
LEFT JOIN tr_ns a ON a.page_id = k.source_id
LEFT JOIN tr_nt b ON b.page_id = k.target_id""")


ORACLE["link_run_summary"] = _w(*_C, *_LS, f"ls AS ({_link_sugg()})", body="""
SELECT 'pages' AS metric, CAST(count(*) AS BIGINT) AS value FROM corpus
UNION ALL SELECT 'target_phrases', count(*) FROM tphr
UNION ALL SELECT 'distinct_phrases', count(*) FROM pdf
UNION ALL SELECT 'most_pages_of_a_phrase', coalesce(max(df), 0) FROM pdf
UNION ALL SELECT 'pages_without_topic_phrase', count(*) FROM corpus
          WHERE page_id NOT IN (SELECT DISTINCT target_id FROM tphr)
UNION ALL SELECT 'links', count(*) FROM ls
UNION ALL SELECT 'linked_sources', count(DISTINCT source_url) FROM ls""")
