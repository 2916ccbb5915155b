"""Check queries in plain SQL, written apart from the Spark plans.

The SQL derives the same source texts from the same template constants and
then works on tables of lines and characters with windows and joins, where the
Spark side folds over each file's row.
"""

from __future__ import annotations

import re

from .. import dims
from ..functions import normalize as N
from ..operators import risk as R
from ..sources import corpus

NL = "chr(10)"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def array(texts) -> str:
    return "[" + ", ".join(q(t) for t in texts) + "]"


def _content(lang: str) -> str:
    bodies = array(corpus.FUNCTIONS[lang])
    parts = [q(corpus.HEADERS[lang])]
    for slot, (step, shift) in enumerate(corpus.SLOTS, 1):
        pick = f"{bodies}[(((o_orderkey // 3) // {step}) + {shift}) % {len(corpus.FUNCTIONS[lang])} + 1]"
        parts.append(f"replace({pick}, '{{ID}}', concat(o_orderkey, '_{slot}'))")
    return f"replace({(f' || {NL} || ').join(parts)}, '{{PRI}}', o_orderpriority)"


def _by_key(values: list[str]) -> str:
    whens = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values))
    return f"CASE o_orderkey % 3 {whens} END"


# Cut a text into literals, comments and the rest; keep only line breaks of the
# first two (and a quote for a literal).  "~" marks a line inside a literal.
def _skeleton(literal: str, comment: str, other: str, keep_mark: bool, coded: tuple[str, str] | None = None) -> str:
    breaks = "regexp_replace(x, '[^\\n]', '', 'g')"
    if keep_mark:
        breaks = f"replace({breaks}, {NL}, {NL} || '~')"
    first = "left(x, 1)"
    # Literals that hold code: (pattern, what stays of them).
    also = f"WHEN regexp_full_match(x, {q(coded[0])}) THEN {coded[1]} " if coded else ""
    literals = f"(?:{coded[0]})|(?:{literal})" if coded else f"(?:{literal})"
    return (
        f"array_to_string(list_transform(regexp_extract_all(content, {q(f'{literals}|{comment}|{other}')}), "
        f"lambda x: CASE {also}WHEN regexp_full_match(x, {q(comment)}) THEN {breaks if not keep_mark else q('')} "
        f"WHEN length(x) > 1 AND regexp_full_match(x, {q(literal)}) THEN {first} || {breaks} ELSE x END), '')"
    )


# An f-string keeps its quote and the code in braces, whose own literals leave a quote.
_PY_CODED = (
    "f\"[^\"\\n]*\"|f'[^'\\n]*'",
    "left(x, 2) || regexp_replace(array_to_string(regexp_extract_all(substr(x, 3), "
    + q(r"\{(?:[^{}]|\{[^{}]*\})*\}") + "), ''), " + q("f?\"[^\"]*\"|'[^']*'") + ", '\"', 'g')",
)
_PY_SKEL = _skeleton(
    "\"\"\"(?s:.*?)\"\"\"|\"[^\"\\n]*\"|'[^'\\n]*'", "#[^\\n]*", "[^\"'#f]+|[\"'f]", True, _PY_CODED
)
# A template keeps the code of its interpolations, and that of templates in them.
_JS_CODED = (
    r"`(?:[^`$]|\$\{(?:[^`{}]|`(?:[^`$]|\$\{[^`{}]*\})*`)*\})*`",
    "regexp_replace(array_to_string(regexp_extract_all(regexp_replace(x, "
    + q(r"([({])`[^`$]*\$\{([^`{}]*)\}[^`]*`") + r", '\1(\2)', 'g'), " + q(r"\$\{[^{}]*\}") + "), ''), "
    + q(r"\$\{([^{}]*)\}") + r", ' +(\1)', 'g')",
)
_C_SKEL = _skeleton(
    "\"[^\"\\n]*\"|'[^'\\n]*'", "/\\*(?s:.*?)\\*/|//[^\\n]*", "[^\"'/]+|[/\"']", False
)
_JS_SKEL = _skeleton(
    "\"[^\"\\n]*\"|'[^'\\n]*'", "/\\*(?s:.*?)\\*/|//[^\\n]*", "[^\"'/`]+|[/\"'`]", False, _JS_CODED
)


def _count(text: str, chars: str) -> str:
    return f"length(regexp_replace({text}, {q('[^' + chars + ']')}, '', 'g'))"


_JS_KIND = r"""
CASE WHEN regexp_matches(line, '^\s*(const|let|var)\s+\w+\s*=\s*(async\s+)?(function\b|(\(.*\)|\w+)\s*=>)')
     THEN 'variable_function'
     WHEN regexp_matches(line, '^\s*\w+\s*:\s*(async\s+)?(function\b|\([^)]*\)\s*=>)') THEN 'property_method'
     WHEN regexp_matches(line, '^\s*(export\s+)?(async\s+)?function\s+\w+') THEN 'declaration'
     WHEN regexp_matches(line, 'function\s*\(') THEN 'expression'
     WHEN regexp_matches(line, '=>') THEN 'arrow'
     WHEN regexp_matches(line, '^\s*(async\s+)?\w+\s*\([^)]*\)\s*\{\s*$')
          AND NOT regexp_matches(line, '^\s*(if|for|while|switch|catch)\b') THEN 'method' END"""
_JS_NAME = r"""
CASE kind WHEN 'variable_function' THEN regexp_extract(line, '(?:const|let|var)\s+(\w+)', 1)
     WHEN 'property_method' THEN regexp_extract(line, '^\s*(\w+)\s*:', 1)
     WHEN 'declaration' THEN regexp_extract(line, 'function\s+(\w+)', 1)
     WHEN 'method' THEN regexp_extract(line, '(\w+)\s*\(', 1)
     ELSE 'anonymous_' || kind END"""
_JS_FIRST = r"""
CASE kind WHEN 'variable_function' THEN regexp_extract(head, '=\s*(.*)$', 1)
     WHEN 'property_method' THEN regexp_extract(head, ':\s*(.*)$', 1)
     WHEN 'declaration' THEN regexp_extract(head, '((?:async )?function.*)$', 1)
     WHEN 'expression' THEN regexp_extract(head, '(function.*)$', 1)
     WHEN 'arrow' THEN regexp_extract(head, '(\([^()]*\) =>.*)$', 1)
     ELSE regexp_extract(head, '(\(.*)$', 1) END"""

_NOT_CALLS = {
    "python": "if elif while for return and or not in is lambda assert with yield await except raise "
    "del else from import as async match case def class",
    "javascript": "if for while switch catch function return typeof await async",
    "c": "if for while switch return sizeof",
}


def _words(text: str) -> str:
    return "(" + ", ".join(q(w) for w in text.split()) + ")"


CTES = {
    "files": f"""
SELECT o_orderkey AS file_id, {_by_key([q(x) for x in corpus.LANGS])} AS lang,
       {_by_key([f"{array(corpus.EXTENSIONS[x])}[(o_orderkey // 3) % 4 + 1]" for x in corpus.LANGS])} AS ext,
       'src/' || lang || '/mod_' || o_orderkey || '.' || ext AS path,
       {_by_key([_content(x) for x in corpus.LANGS])} AS content
FROM orders""",
    "skels": f"""
SELECT file_id, lang, content,
       CASE lang WHEN 'python' THEN {_PY_SKEL}
                 WHEN 'c' THEN regexp_replace({_C_SKEL}, '(^|\\n)[ \\t]*#[^\\n]*', '\\1', 'g')
                 ELSE {_JS_SKEL} END AS skel
FROM files""",
    "texts": f"SELECT file_id, lang, string_split(content, {NL}) AS src, "
    f"string_split(skel, {NL}) AS sk FROM skels",
    # Lines of the second branch of an #if do not count for the depth after it; in it, those of the first do not.
    "directed": f"""
SELECT file_id, lang, ln, line, delta,
       count(*) FILTER (word = 'if') OVER up AS ifs,
       count(*) FILTER (word = 'else') OVER up > count(*) FILTER (word = 'endif') OVER up AS second,
       count(*) FILTER (word = 'if') OVER up > count(*) FILTER (word = 'endif') OVER up
         AND count(*) FILTER (word = 'else') OVER up <= count(*) FILTER (word = 'endif') OVER up AS first
FROM (SELECT file_id, lang, ln, sk[ln] AS line, CASE WHEN lang = 'c' THEN regexp_extract(src[ln], '^#(if|else|endif)', 1) END AS word,
             CASE WHEN lang = 'python' THEN {_count('sk[ln]', '(\\[{')} - {_count('sk[ln]', ')\\]}')}
                  ELSE {_count('sk[ln]', '{')} - {_count('sk[ln]', '}')} END AS delta
      FROM (SELECT file_id, lang, sk, src, unnest(range(1, len(sk) + 1)) AS ln FROM texts))
WINDOW up AS (PARTITION BY file_id ORDER BY ln)""",
    "lines": """
SELECT file_id, lang, ln, line, CASE WHEN second THEN 0 ELSE delta END AS delta,
       coalesce(sum(CASE WHEN second THEN 0 ELSE delta END) OVER (PARTITION BY file_id ORDER BY ln
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       - CASE WHEN second THEN sum(CASE WHEN first THEN delta ELSE 0 END) OVER (PARTITION BY file_id, ifs) ELSE 0 END AS before
FROM directed""",
    # Python ------------------------------------------------------------------
    "py_lines": r"""
SELECT file_id, ln, line, length(line) - length(ltrim(line)) AS indent,
       before = 0 AND NOT starts_with(line, '~') AS logical,
       regexp_extract(line, '^\s*(async def|def|class)\s+\w+', 1) AS head,
       regexp_extract(line, '^\s*(?:async def|def|class)\s+(\w+)', 1) AS name
FROM lines WHERE lang = 'python' AND trim(line) <> ''""",
    "py_next": """
SELECT h.file_id, h.ln, h.indent, h.head, h.name, min(n.ln) AS next_ln
FROM py_lines h LEFT JOIN py_lines n
  ON n.file_id = h.file_id AND n.ln > h.ln AND n.logical AND n.indent <= h.indent
WHERE h.logical AND h.head <> '' GROUP BY ALL""",
    "py_blocks": """
SELECT h.file_id, h.ln, h.indent, h.head, h.name, max(b.ln) AS end_ln
FROM py_next h JOIN py_lines b
  ON b.file_id = h.file_id AND b.ln >= h.ln AND (h.next_ln IS NULL OR b.ln < h.next_ln)
GROUP BY ALL""",
    "py_deco_lines": r"""
SELECT file_id, ln, regexp_extract(line, '@([\w.]+)', 1) AS deco,
       ln - row_number() OVER (PARTITION BY file_id ORDER BY ln) AS grp
FROM py_lines WHERE starts_with(ltrim(line), '@')""",
    "py_deco": """
SELECT file_id, max(ln) + 1 AS ln, min(ln) AS first_line, string_agg(deco, ',' ORDER BY ln) AS decorators
FROM py_deco_lines GROUP BY file_id, grp""",
    "py_fns": """
SELECT f.file_id, f.name, f.ln AS line_number, f.end_ln AS end_line,
       CASE f.head WHEN 'def' THEN 'function' ELSE 'async_function' END AS kind,
       c.cls AS class_context, coalesce(d.decorators, '') AS decorators,
       coalesce(d.first_line, f.ln) AS first_line
FROM py_blocks f
LEFT JOIN (SELECT f.file_id, f.ln, string_agg(c.name, '.' ORDER BY c.ln) AS cls
           FROM py_blocks f JOIN py_blocks c ON c.file_id = f.file_id AND c.head = 'class'
                AND c.ln < f.ln AND f.ln <= c.end_ln GROUP BY ALL) c USING (file_id, ln)
LEFT JOIN py_deco d USING (file_id, ln)
WHERE f.head <> 'class'""",
    # C and JavaScript ----------------------------------------------------------
    "closers": "SELECT file_id, ln, before + delta AS after FROM lines "
    "WHERE lang <> 'python' AND contains(line, '}')",
    "c_heads": rf"""
SELECT l.file_id, l.ln, l.before,
       regexp_extract(array_to_string(t.sk[l.ln:], {NL}),
         '^([ \t]*[A-Za-z_][\w\s*]*?[\s*])([A-Za-z_]\w*)\s*\(([^;{{}}]*)\)\s*\{{', ['ret', 'name', 'params']) AS h
FROM lines l JOIN texts t USING (file_id) WHERE l.lang = 'c' AND l.before = 0 AND contains(l.line, '(')""",
    "c_fns": r"""
SELECT h.file_id, h.h.name AS name, h.ln AS line_number, min(c.ln) AS end_line, 'function' AS kind,
       h.h.params AS params,
       trim(regexp_replace(regexp_replace(regexp_replace(h.h.ret, '\bstatic\b', ' ', 'g'),
            '\s+', ' ', 'g'), '\s*\*\s*', ' *', 'g')) AS return_type
FROM c_heads h JOIN closers c ON c.file_id = h.file_id AND c.ln >= h.ln AND c.after = 0
WHERE h.h.name <> '' GROUP BY ALL""",
    "js_lines": f"SELECT file_id, ln, line, before, delta, {_JS_KIND} AS kind FROM lines WHERE lang = 'javascript'",
    "js_class": r"""
SELECT h.file_id, h.ln, h.before, min(c.ln) AS end_ln FROM js_lines h
JOIN closers c ON c.file_id = h.file_id AND c.ln >= h.ln AND c.after <= h.before
WHERE regexp_matches(h.line, '^\s*class\s') GROUP BY ALL""",
    "js_fns": f"""
SELECT h.file_id, {_JS_NAME} AS name, h.ln AS line_number, h.line,
       CASE WHEN contains(h.line, '{{') THEN min(c.ln) ELSE h.ln END AS end_line, h.kind
FROM js_lines h LEFT JOIN closers c
  ON c.file_id = h.file_id AND c.ln >= h.ln AND c.after <= h.before
WHERE h.kind IS NOT NULL GROUP BY h.file_id, h.ln, h.line, h.kind""",
    "spans": """
SELECT file_id, name, kind, line_number, end_line, first_line, decorators, class_context,
       NULL AS params, NULL AS return_type, NULL AS line FROM py_fns
UNION ALL SELECT file_id, name, kind, line_number, end_line, line_number, '', NULL, params, return_type, NULL FROM c_fns
UNION ALL SELECT file_id, name, kind, line_number, end_line, line_number, '', NULL,
       NULL, NULL, line FROM js_fns""",
    "coded": f"""
SELECT s.*, t.lang, f.path,
       row_number() OVER (PARTITION BY s.file_id ORDER BY s.line_number) AS fn_no,
       array_to_string(t.src[s.line_number:s.end_line], {NL}) AS whole,
       array_to_string(t.sk[s.first_line:s.end_line], {NL}) AS whole_skel,
       t.src[s.line_number] AS head, t.src[s.end_line] AS tail,
       array_to_string(t.src[s.line_number + 1:s.end_line - 1], {NL}) AS middle,
       t.sk[s.line_number] AS sk_head, t.sk[s.end_line] AS sk_tail,
       array_to_string(t.sk[s.line_number + 1:s.end_line - 1], {NL}) AS sk_middle
FROM spans s JOIN texts t USING (file_id) JOIN files f USING (file_id)""",
    "fns": f"""
SELECT file_id, path, lang, fn_no, file_id || '#' || fn_no AS fn_id, name, kind, line_number, end_line,
       first_line, decorators, class_context, params, return_type,
       CASE WHEN class_context IS NULL THEN name ELSE class_context || '.' || name END AS full_name,
       CASE WHEN lang <> 'javascript' THEN whole
            WHEN end_line > line_number THEN {_JS_FIRST} || {NL} || middle || {NL}
                 || regexp_replace(tail, '\\}}.*$', '}}')
            ELSE {_JS_FIRST} END AS code,
       CASE WHEN lang <> 'javascript' THEN whole_skel
            WHEN end_line > line_number THEN {_JS_FIRST.replace('head', 'sk_head')} || {NL} || sk_middle || {NL}
                 || regexp_replace(sk_tail, '\\}}.*$', '}}')
            ELSE {_JS_FIRST.replace('head', 'sk_head')} END AS skel
FROM coded""",
    # Calls -----------------------------------------------------------------------
    "chars": """
SELECT fn_id, i, c, d, coalesce(sum(d) OVER (PARTITION BY fn_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT fn_id, i, skel[i] AS c,
             CASE WHEN skel[i] IN ('(', '[', '{') THEN 1 WHEN skel[i] IN (')', ']', '}') THEN -1 ELSE 0 END AS d
      FROM (SELECT fn_id, skel, unnest(range(1, length(skel) + 1)) AS i FROM fns WHERE lang = 'python'))""",
    "py_opens": r"""
SELECT fn_id, i, before, first_line + length(regexp_replace(pre, '[^\n]', '', 'g')) AS line_number,
       regexp_extract(pre, '([A-Za-z_]\w*)[ \t]*$', 1) AS name,
       regexp_extract(pre, '(\.?)((?:[A-Za-z_]\w*\.)*)[A-Za-z_]\w*[ \t]*$', 2) AS owner,
       regexp_matches(pre, '[)\]"''~]\.(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*[ \t]*$') AS on_value,
       regexp_matches(pre, '\b(def|class)\s+\w+\s*$') AS heads
FROM (SELECT c.fn_id, c.i, c.before, f.first_line, left(f.skel, c.i - 1) AS pre
      FROM chars c JOIN fns f USING (fn_id) WHERE c.c = '(')""",
    "py_ends": """
SELECT o.fn_id, o.i, min(c.i) AS j FROM py_opens o JOIN chars c
  ON c.fn_id = o.fn_id AND c.i > o.i AND c.c = ')' AND c.before + c.d = o.before GROUP BY ALL""",
    "py_args": """
SELECT e.fn_id, e.i, count(*) FILTER (c.c = ',' AND c.before = o.before + 1) AS commas,
       count(*) FILTER (c.c = '=' AND c.before = o.before + 1) AS equals,
       count(*) FILTER (trim(c.c, ' ' || chr(10)) <> '') AS filled
FROM py_ends e JOIN py_opens o USING (fn_id, i)
LEFT JOIN chars c ON c.fn_id = e.fn_id AND c.i > e.i AND c.i < e.j GROUP BY ALL""",
    "py_all_calls": f"""
SELECT o.fn_id, o.line_number, o.name, o.i, e.j,
       nullif(rtrim(CASE WHEN o.on_value THEN 'complex_object.' ELSE '' END || o.owner, '.'), '') AS object,
       CASE WHEN o.on_value OR o.owner <> '' THEN 'method_call' ELSE 'function_call' END AS kind,
       CASE WHEN a.filled = 0 THEN 0 ELSE a.commas + 1 - a.equals END AS args_count, a.equals AS kwargs_count,
       CASE WHEN object IS NULL THEN o.name ELSE object || '.' || o.name END AS call
FROM py_opens o JOIN py_args a USING (fn_id, i) JOIN py_ends e USING (fn_id, i)
WHERE o.name <> '' AND NOT o.heads AND o.name NOT IN {_words(_NOT_CALLS['python'])}""",
    "names": rf"""
SELECT DISTINCT fn_id, lang, name FROM (
  SELECT fn_id, lang, unnest(regexp_extract_all(
    CASE lang WHEN 'python' THEN regexp_replace(skel, '\b(?:def|class)\s+\w+\s*\(', ';(', 'g')
              WHEN 'c' THEN regexp_replace(skel, '^[^{{]*\{{', '')
              ELSE regexp_replace(regexp_replace(skel, '\bfunction\b\s*\w*\s*\(', '(', 'g'), '\bnew\s+\w+\s*(?:<[^<>()]*>)?\(', '(', 'g') END,
    '([A-Za-z_$][\w$]*)\s*\(', 1)) AS name FROM fns)
WHERE name NOT IN (SELECT unnest(CASE lang WHEN 'python' THEN {array(_NOT_CALLS['python'].split())}
  WHEN 'c' THEN {array(_NOT_CALLS['c'].split())} ELSE {array(_NOT_CALLS['javascript'].split())} END))""",
    "deps": "SELECT fn_id, list(name ORDER BY name)[1:10] AS deps FROM names GROUP BY fn_id",
    # Imports -----------------------------------------------------------------------
    "py_import_lines": r"""
SELECT file_id, ln, regexp_extract(line, '^from\s+([\w.]+)\s+import', 1) AS module,
       CASE WHEN starts_with(line, 'from') AND contains(line, '(')
            THEN regexp_extract(line, 'import\s*\((.*)$', 1) || ' ' || regexp_extract(next_line, '^([^)]*)', 1)
            WHEN starts_with(line, 'from') THEN regexp_extract(line, 'import\s+(.*)$', 1)
            ELSE regexp_extract(line, '^import\s+(.*)$', 1) END AS listing
FROM (SELECT file_id, ln, line, lead(line) OVER (PARTITION BY file_id ORDER BY ln) AS next_line
      FROM lines WHERE lang = 'python')
WHERE regexp_matches(line, '^(import|from)\s')""",
    "py_imps": r"""
SELECT file_id, ln AS line_number, CASE WHEN module = '' THEN 'import' ELSE 'from_import' END AS kind,
       CASE WHEN module = '' THEN base ELSE module END AS module,
       CASE WHEN module <> '' THEN base END AS name, alias, pos,
       CASE WHEN module = '' THEN 'import ' || base ELSE 'from ' || module || ' import ' || base END
         || CASE WHEN alias IS NULL THEN '' ELSE ' as ' || alias END AS statement
FROM (SELECT file_id, ln, module, pos, split_part(trim(item), ' as ', 1) AS base,
             nullif(split_part(trim(item), ' as ', 2), '') AS alias
      FROM (SELECT file_id, ln, module, pos, string_split(listing, ',')[pos] AS item
            FROM (SELECT *, unnest(range(1, len(string_split(listing, ',')) + 1)) AS pos FROM py_import_lines)))""",
    "js_imps": r"""
SELECT file_id, ln AS line_number,
       CASE WHEN regexp_matches(line, '^import .* from ') THEN 'import'
            WHEN starts_with(line, 'import') THEN 'bare_import' ELSE 'require' END AS kind,
       regexp_extract(line, '''([^'']+)''', 1) AS module,
       CASE kind WHEN 'import' THEN 'import {' || replace(replace(replace(replace(
              regexp_extract(line, '^import (.*) from ', 1), '{ ', ''), ' }', ''), '{', ''), '}', '')
              || '} from ''' || module || ''''
            WHEN 'bare_import' THEN 'import ''' || module || ''''
            ELSE 'const ' || regexp_extract(line, 'const (\w+)', 1) || ' = require(''' || module || ''')' END AS statement
FROM (SELECT file_id, ln, src[ln] AS line
      FROM (SELECT file_id, src, unnest(range(1, len(src) + 1)) AS ln FROM texts WHERE lang = 'javascript'))
WHERE starts_with(line, 'import') OR contains(line, 'require(')""",
    "c_imps": r"""
SELECT file_id, ln AS line_number, regexp_extract(line, '[<"]([^>"]+)[>"]', 1) AS module, line AS statement
FROM (SELECT file_id, ln, src[ln] AS line
      FROM (SELECT file_id, src, unnest(range(1, len(src) + 1)) AS ln FROM texts WHERE lang = 'c'))
WHERE starts_with(line, '#include')""",
    "imports5": """
SELECT file_id, list(statement ORDER BY line_number, pos)[1:5] AS imports FROM (
  SELECT file_id, line_number, pos, statement FROM py_imps
  UNION ALL SELECT file_id, line_number, 1, statement FROM js_imps
  UNION ALL SELECT file_id, line_number, 1, statement FROM c_imps) GROUP BY file_id""",
    "contexts": """
SELECT f.*, coalesce(i.imports, []) AS imports, coalesce(d.deps, []) AS deps
FROM fns f LEFT JOIN imports5 i USING (file_id) LEFT JOIN deps d USING (fn_id)""",
}


def _case_of(texts: list[str | None], n: str) -> str:
    return f"{array(texts)}[({n}) % {len(texts)} + 1]"


def _fallback(field: int, none: str, suffix: str = "") -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower(code), {q(rule[0])}) THEN "
        + (q(rule[field] + suffix) if field in (2, 3) else f"{rule[field]}")
        for rule in dims.FALLBACK_RULES
    )
    return f"CASE {whens} ELSE {none} END"


_FB_SNIPPET = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(code), {q(r[0])}) THEN left(regexp_extract(lower(code), {q(r[0])}), 100)"
    for r in dims.FALLBACK_RULES
) + " ELSE '' END"
_FB_HIT = " OR ".join(f"regexp_matches(lower(code), {q(r[0])})" for r in dims.FALLBACK_RULES)


def _risk(text: str) -> str:
    number = f"regexp_extract({text}, {q(dims.RISK_NUMBER)})"
    words = " ".join(
        f"WHEN regexp_matches(lower({text}), {q('|'.join(ws))}) THEN {value}"
        for ws, value in dims.RISK_WORDS
    )
    return (
        f"CAST(CASE WHEN {number} <> '' THEN least(1.0, CAST({number} AS DOUBLE)) {words} "
        "ELSE 0.5 END AS DOUBLE)"
    )


def _tier(score: str, op: str) -> str:
    return f"CASE WHEN {score} {op} 0.5 THEN 'analyse' WHEN {score} > 0.3 THEN 'medium' ELSE 'low' END"


_F = "vulnerable, confidence, vulnerability_type, severity, explanation, code_snippet, remediation"

CTES |= {
    "answers": f"""
SELECT file_id || '#' || fn_no AS fn_id, {_case_of(corpus.RISK_TEXTS, '(file_id + fn_no) * 3')} AS risk_text,
       {_case_of(corpus.VERDICT_TEXTS, 'file_id + fn_no')} AS verdict_text
FROM (SELECT file_id, unnest(range(1, {corpus.MAX_FUNCTIONS + 1})) AS fn_no FROM files)""",
    "bodies": """
SELECT fn_id, verdict_text, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS js
FROM (SELECT fn_id, verdict_text, substring(verdict_text, strpos(verdict_text, '{'),
        length(verdict_text) + 2 - strpos(reverse(verdict_text), '}') - strpos(verdict_text, '{')) AS body
      FROM answers WHERE verdict_text IS NOT NULL)""",
    "parsed": """
SELECT fn_id, coalesce(ok, false) AS accepted,
       CASE WHEN ok THEN js->>'$.vulnerable' NOT IN ('false', '0', '') END AS vulnerable,
       CASE WHEN ok THEN greatest(0.0, least(1.0, conf)) END AS confidence,
       CASE WHEN ok THEN js->>'$.vulnerability_type' END AS vulnerability_type,
       CASE WHEN ok THEN coalesce(js->>'$.severity', 'medium') END AS severity,
       CASE WHEN ok THEN js->>'$.explanation' END AS explanation,
       CASE WHEN ok THEN left(coalesce(js->>'$.code_snippet', ''), 200) END AS code_snippet,
       CASE WHEN ok THEN coalesce(js->>'$.remediation', '') END AS remediation
FROM (SELECT fn_id, js, TRY_CAST(js->>'$.confidence' AS DOUBLE) AS conf,
             conf IS NOT NULL AND json_exists(js, '$.vulnerable') AND json_exists(js, '$.explanation') AS ok
      FROM bodies)""",
    "ruled": f"""
SELECT fn_id, file_id, path, lang, name, line_number, ({_FB_HIT}) AS vulnerable,
       CAST({_fallback(1, '0.0')} AS DOUBLE) AS confidence, {_fallback(2, 'NULL')} AS vulnerability_type,
       CASE WHEN vulnerable THEN 'high' ELSE 'none' END AS severity,
       {_fallback(3, q(dims.FALLBACK_CLEAN), dims.FALLBACK_SUFFIX)} AS explanation,
       {_FB_SNIPPET} AS code_snippet,
       CASE WHEN vulnerable THEN {q(dims.FALLBACK_REMEDIATION)} ELSE '' END AS remediation
FROM fns""",
    "scored": f"""
SELECT f.fn_id, f.path, f.lang, CASE WHEN a.risk_text IS NULL THEN 0.5 ELSE {_risk('a.risk_text')} END AS risk_score
FROM fns f LEFT JOIN answers a USING (fn_id)""",
    "settled": """
SELECT r.fn_id, r.path AS file, r.lang, r.name AS "function", r.line_number, s.risk_score,
       CASE WHEN p.accepted THEN 'response' ELSE 'fallback' END AS verdict_source,
""" + ",\n".join(
        f"       CASE WHEN p.accepted THEN p.{f} ELSE r.{f} END AS {f}" for f in _F.split(", ")
    ) + """
FROM ruled r JOIN scored s USING (fn_id) LEFT JOIN parsed p USING (fn_id) WHERE s.risk_score >= 0.5""",
    "found": f"""
SELECT file, lang, "function", line_number, coalesce(vulnerability_type, 'unknown') AS vulnerability_type,
       confidence, severity, code_snippet, explanation, remediation, risk_score
FROM settled WHERE vulnerable AND confidence > 0.5""",
    "per_file": """
SELECT file, count(*) AS n, max(confidence) AS top,
       string_agg("function" || ':' || vulnerability_type, ';' ORDER BY line_number, "function") AS listing,
       to_json(list({'function': "function", 'vulnerability_type': vulnerability_type, 'confidence': confidence,
         'severity': severity, 'line_number': line_number, 'code_snippet': code_snippet, 'explanation': explanation,
         'remediation': remediation} ORDER BY line_number, "function"))::VARCHAR AS findings,
       to_json(list({'type': vulnerability_type, 'function': "function", 'confidence': confidence,
         'severity': severity} ORDER BY line_number, "function"))::VARCHAR AS brief
FROM found GROUP BY file""",
    "totals": """
SELECT (SELECT count(*) FROM files) AS total_files_analyzed, (SELECT count(*) FROM per_file) AS files_with_vulnerabilities,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM per_file) AS total_vulnerabilities""",
    "inventory": r"""
SELECT path, content, regexp_extract(path, '\.([A-Za-z]+)$', 1) AS ext FROM (
  SELECT path, content FROM files
  UNION ALL SELECT 'docs/' || source || '/' || doc_id || '.' || lang, text FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages)""",
    "extended": f"""
SELECT file_id, replace({q('<EXT>')}, '{{K}}', file_id::VARCHAR) || content AS content FROM files WHERE lang = 'c'""",
    "records": r"""
SELECT p_partkey AS record_id, '/home/dev/proj/' || lower(p_type) AS cwd,
  ['gcc', 'clang', '/usr/bin/cc', 'g++', 'cc-wrapper', 'icc'][p_partkey % 6 + 1] AS compiler,
  CASE p_partkey % 4
    WHEN 0 THEN ['-c', '-I', 'include', '-DSIZE=' || p_size, 'src/' || stem || '_' || p_partkey || '.c', '-o', 'out.o']
    WHEN 1 THEN ['-std=c99', '-include', 'pre.c', '-UDEBUG', '/opt/code/../lib/' || stem || '_' || p_partkey || '.c', 'util.c']
    WHEN 2 THEN ['-O2', '-D', 'NAME', '-Ivendor', '-c', '../shared/./' || stem || '.c']
    ELSE ['main.o', '-lm', '-I'] END AS argv
FROM (SELECT *, replace(p_name, ' ', '_') AS stem FROM part)""",
    "args": """
SELECT record_id, cwd, no::INTEGER AS arg_no, argv[no] AS arg,
       CASE WHEN no > 1 THEN argv[no - 1] END AS prev,
       coalesce(prev IN ('-I', '-D', '-U', '-include'), false) AS taken,
       NOT taken AND ends_with(arg, '.c') AS is_source
FROM (SELECT record_id, cwd, argv, unnest(range(1, len(argv) + 1)) AS no FROM records)""",
    "sources": """
SELECT record_id, arg_no, arg AS source, CASE WHEN starts_with(arg, '/') THEN arg ELSE cwd || '/' || arg END AS source_path
FROM args WHERE is_source""",
    "c_param_rows": r"""
SELECT fn_id, pos, trim(regexp_replace(string_split(params, ',')[pos], '\s+', ' ', 'g')) AS p, n FROM (
  SELECT fn_id, params, len(string_split(params, ',')) AS n, unnest(range(1, len(string_split(params, ',')) + 1)) AS pos
  FROM fns WHERE lang = 'c' AND trim(params) <> 'void')""",
    "c_params_t": r"""
SELECT fn_id, pos, n, regexp_extract(p, '(\w+)(?:\[\d*\])*$', 1) AS name,
       trim(regexp_replace(regexp_replace(p, '\w+((?:\[\d*\])*)$', '\1'), '\s*(\*+)\s*', ' \1')) AS type
FROM c_param_rows""",
    "py_sig": r"""
SELECT fn_id, regexp_extract(code, '(?s)^\s*(?:async )?def \w+\((.*?)\)\s*(?:->\s*([^:\n]+?)\s*)?:\n', 1) AS sig,
       regexp_extract(code, '(?s)^\s*(?:async )?def \w+\((.*?)\)\s*(?:->\s*([^:\n]+?)\s*)?:\n', 2) AS ret
FROM fns WHERE lang = 'python'""",
    # Commas outside brackets and quotes separate parameters.
    "py_sig_chars": r"""
SELECT fn_id, i, c, quoted, sum(CASE WHEN quoted THEN 0 WHEN c IN ('(', '[', '{') THEN 1 WHEN c IN (')', ']', '}') THEN -1 ELSE 0 END)
         OVER (PARTITION BY fn_id ORDER BY i) AS depth
FROM (SELECT fn_id, i, c, sum((c IN ('"', chr(39)))::INT) OVER (PARTITION BY fn_id ORDER BY i) % 2 = 1 AS quoted
      FROM (SELECT fn_id, i, s[i] AS c FROM (SELECT fn_id, s, unnest(range(1, length(s) + 1)) AS i
            FROM (SELECT fn_id, regexp_replace(sig, '\s+', ' ', 'g') AS s FROM py_sig WHERE trim(sig) <> ''))))""",
    "py_parts": r"""
SELECT fn_id, pos, trim(p) AS p, max(CASE WHEN regexp_matches(trim(p), '^\*\w') THEN pos END) OVER (PARTITION BY fn_id) AS star
FROM (SELECT fn_id, pos, coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT cut), '') AS p
      FROM (SELECT *, c = ',' AND depth = 0 AND NOT quoted AS cut,
                   1 + count(*) FILTER (c = ',' AND depth = 0 AND NOT quoted) OVER (PARTITION BY fn_id ORDER BY i) AS pos
            FROM py_sig_chars) GROUP BY fn_id, pos)""",
    "py_params_t": r"""
SELECT fn_id, (row_number() OVER (PARTITION BY fn_id ORDER BY pos) - 1)::INTEGER AS pos,
       regexp_extract(p, '^(\*{0,2}\w+)', 1) AS name,
       nullif(trim(regexp_extract(p, '^\w+: ([^=]+)', 1)), '') AS annotation,
       nullif(trim(regexp_extract(p, '=(.*)$', 1)), '') AS "default"
FROM py_parts WHERE star IS NULL OR pos <= star OR starts_with(p, '**')""",
    "js_param_rows": r"""
SELECT fn_id, kind, pos, trim(ps[pos]) AS p FROM (SELECT fn_id, kind, ps, unnest(range(1, len(ps) + 1)) AS pos FROM (
  SELECT fn_id, kind, string_split(regexp_replace(CASE kind WHEN 'method' THEN regexp_extract(code, '^\(([^()]*)\)', 1)
     ELSE regexp_extract(code, '\(([^()]*)\)', 1) END, '\{[^}]*\}', '{}'), ',') AS ps FROM fns WHERE lang = 'javascript'))""",
    "js_params_t": r"""
SELECT fn_id, coalesce(string_agg(r, ',' ORDER BY pos) FILTER (kind IN ('declaration', 'expression', 'arrow') AND p <> ''
         OR kind = 'method' AND r <> 'complex_param' AND NOT starts_with(r, '...') AND p <> ''), '') AS params
FROM (SELECT *, CASE WHEN starts_with(p, '{') OR contains(p, '=') THEN 'complex_param'
                     ELSE regexp_replace(p, ':.*$', '') END AS r FROM js_param_rows) GROUP BY fn_id""",
    "all_params": """
SELECT fn_id, name, coalesce(annotation, '') AS annotation FROM py_params_t
UNION ALL SELECT fn_id, name, type FROM c_params_t
UNION ALL SELECT fn_id, unnest(string_split(params, ',')), '' FROM js_params_t""",
    "inputs": f"""
SELECT f.fn_id, f.lang, f.name, f.decorators, coalesce(bool_or(CASE f.lang
         WHEN 'python' THEN regexp_matches(lower(p.name), {q('|'.join(dims.USER_INPUT_PARAMS['python']))})
         WHEN 'javascript' THEN regexp_matches(lower(p.name), {q('|'.join(dims.USER_INPUT_PARAMS['javascript']))})
         ELSE regexp_matches(lower(p.name), {q('|'.join(dims.USER_INPUT_PARAMS['c']))})
              OR contains(p.annotation, '*') AND contains(p.annotation, 'char') END), false) AS flag
FROM fns f LEFT JOIN all_params p USING (fn_id) GROUP BY ALL""",
    "cats": """
SELECT DISTINCT f.fn_id, f.name, k.category FROM fns f JOIN (
""" + " UNION ALL ".join(
        f"SELECT {q(c)} AS category, unnest({array(ws)}) AS word" for c, ws in dims.RISK_KEYWORDS.items()
    ) + ") k ON contains(lower(f.name), lower(k.word))",
    "catalog": " UNION ALL ".join(
        f"SELECT {q(c)} AS category, {q(f)} AS word, {q(m)} AS match_kind, false AS focus"
        for c, f, m in dims.dangerous_function_rows()
    ) + "".join(
        f" UNION ALL SELECT {q(c)}, {q(f)}, {q(m)}, true"
        for c, f, m in dims.dangerous_function_rows(True)
    ),
    "dangerous": """
SELECT n.fn_id, n.name, k.category, k.match_kind, k.focus FROM names n JOIN catalog k
  ON (k.match_kind = 'exact' AND n.name = k.word) OR (k.match_kind = 'prefix' AND starts_with(n.name, k.word))
WHERE n.lang = 'c'""",
    "indicators": " UNION ALL ".join(
        f"SELECT fn_id, {n} AS pos, {q(tag)} AS indicator FROM fns WHERE lang = 'c' AND "
        f"regexp_matches(lower(code), {q('|'.join(ws))})"
        for n, (tag, ws) in enumerate(dims.CRYPTO_INDICATORS.items())
    ),
    "types": " UNION ALL ".join(
        f"SELECT {q(lang)} AS lang, unnest({array(ts)}) AS vulnerability_type"
        for lang, ts in dims.VULN_TYPES.items()
    ),
}


def _rules(table: str, key: str, text: str, typed: bool, extra=()) -> str:
    kind = ", {t} AS vulnerability_type" if typed else ""
    return " UNION ALL ".join(
        f"SELECT {key}, {q(rule)} AS rule_id{kind.format(t=q(t))} FROM {table} "
        f"WHERE regexp_matches({text}, {q(regex)})"
        for rule, t, regex in [*dims.rule_rows(), *extra]
    ).replace("'<none>'", "NULL")


def _strip(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"
    return text


def _none(listing: str, n: int) -> str:
    return f"coalesce(nullif(array_to_string({listing}[1:{n}], ', '), ''), 'None')"


_TS_STEPS = [(p, "\\1") for p in N.TS_ANNOTATIONS] + [(p, "") for p in N.TS_DECLARATIONS]
_GCC_STEPS = [
    (r"__attribute__\s*\(\([^)]*\)\)", ""),
    (r"__aligned__?\s*\([^)]*\)", ""),
    (r"__packed__?\s*", ""),
    (r"__always_inline__?\s*", ""),
    (r"\brestrict\b\s*", ""),
]
_FD_STEPS = [(r"\bfd_set\b", "int")] + [
    (p, to) for _, p, to in N.FD_MACROS if not p.startswith("FD_SET")
]
_WS_STEPS = [(r"\s+", " "), (r"\s*;\s*", ";\n"), (r"\s*\{\s*", " {\n"), (r"\s*\}\s*", "\n}\n")]


def _review(lang: str) -> str:
    types = ", ".join(dims.VULN_TYPES[lang])
    head = (
        f"Review this {lang} function for security flaws. {R._ANSWER_FORM}\n"
        f"Types: {types}.\n{R._FOCUS[lang]}\n\nFunction: "
    )
    return (
        f"{q(head)} || name || {q(chr(10) + 'Line: ')} || line_number || {q(chr(10) + 'Imports: ')} || "
        f"{_none('imports', 5)} || {q(chr(10) + 'Dependencies: ')} || {_none('deps', 10)} || "
        f"{q(chr(10) * 2 + '```' + lang + chr(10))} || code || {q(chr(10) + '```')}"
    )


def _py(columns: str) -> str:
    return f"SELECT {columns} FROM fns WHERE lang = 'python'"


_LANG_OF = (
    "CASE WHEN ext = 'py' THEN 'python' WHEN ext IN ('js', 'jsx', 'ts', 'tsx') THEN 'javascript' "
    "WHEN ext IN ('c', 'h', 'i') THEN 'c' END"
)
_SUPPORTED = "('py', 'js', 'jsx', 'ts', 'tsx', 'c', 'h', 'i')"
_REPORT = (
    "{'file': file, 'findings': findings::JSON, 'total_vulnerabilities': n}"
)
_BANDS = "CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.7 THEN 'high' " \
    "WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very_low' END"
_I = "::INTEGER"

SQL = {
    "scan_source_files": f"SELECT path, ext FROM inventory WHERE ext IN {_SUPPORTED}",
    "scan_text_files": "SELECT doc_id, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM documents",
    "decode_with_fallback": """SELECT doc_id, md5(CASE lang WHEN 'fr' THEN '\u201c' || text || '\u201d' ELSE text END) AS content_md5,
        CASE WHEN lang = 'fr' THEN 'cp1252' WHEN lang = 'de' AND strlen(text) > length(text) THEN 'latin1'
             WHEN lang = 'es' THEN CASE WHEN source < 'src2' THEN 'utf-16-le' ELSE 'utf-16-be' END ELSE 'utf-8' END AS encoding FROM documents""",
    "route_language": f"SELECT path, ext, {_LANG_OF} AS lang FROM inventory",
    "unsupported_files": f"SELECT path, ext FROM inventory WHERE ext NOT IN {_SUPPORTED}",
    "scan_preprocessed": "SELECT path, length(content)::INTEGER AS n_chars FROM inventory WHERE ext = 'i'",
    "drop_marker_line": "SELECT file_id, md5(content) AS content_md5 FROM files WHERE lang = 'c'",
    "lines_explode": f"""SELECT doc_id, ln::INTEGER AS ln, parts[ln] AS line FROM (
        SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS ln FROM (
        SELECT doc_id, string_split(text, {NL}) AS parts FROM documents))""",
    "read_findings_json": 'SELECT file, "function", vulnerability_type, confidence, severity, '
    "line_number::INTEGER AS line_number, code_snippet, explanation, remediation FROM found",
    "quarantine_files": f"SELECT path, 'unsupported extension' AS error FROM inventory WHERE ext NOT IN {_SUPPORTED}",
    "scan_build_records": "SELECT record_id, cwd, compiler, array_to_string(argv, ' ') AS argv FROM records",
    "report_single_file": f"SELECT file, to_json({_REPORT})::VARCHAR AS value FROM per_file",
    "report_scan": """SELECT 'scan_summary' AS section, NULL AS file, to_json(totals)::VARCHAR AS payload FROM totals
        UNION ALL SELECT 'files_analyzed', file, NULL FROM per_file
        UNION ALL SELECT 'findings', file, to_json({'file': file, 'function': "function",
          'vulnerability_type': vulnerability_type, 'confidence': confidence, 'severity': severity,
          'line_number': line_number, 'code_snippet': code_snippet, 'explanation': explanation,
          'remediation': remediation})::VARCHAR FROM found""",
    "report_preprocessed": """SELECT f.path AS file, NULL::VARCHAR AS error,
        coalesce(v.n, 0) AS total_vulnerabilities, coalesce(s.n, 0) AS functions_analyzed, coalesce(s.high, 0) AS high_risk_functions,
        coalesce(v.findings, '[]') AS findings
        FROM files f LEFT JOIN (SELECT path, count(*) AS n, count(*) FILTER (risk_score > 0.5) AS high FROM scored GROUP BY path) s USING (path)
        LEFT JOIN (SELECT file AS path, count(*) AS n,
          to_json(list({'function': "function", 'vulnerability_type': vulnerability_type, 'confidence': confidence,
            'severity': severity, 'line_number': line_number, 'code_snippet': code_snippet, 'explanation': explanation,
            'remediation': remediation} ORDER BY line_number, "function"))::VARCHAR AS findings
          FROM found WHERE risk_score > 0.5 GROUP BY file) v USING (path)
        WHERE f.lang = 'c'""",
    "report_build_summary": """SELECT file, n AS n_findings, brief AS vulnerabilities FROM per_file
        UNION ALL SELECT NULL, total_vulnerabilities, to_json({'total_vulnerabilities': total_vulnerabilities,
          'files_analyzed': total_files_analyzed, 'files_with_vulnerabilities': files_with_vulnerabilities})::VARCHAR FROM totals""",
    "sink_per_file_json": r"SELECT lang, file, count(*) AS total_vulnerabilities, "
    r"regexp_replace(file, '\.[a-z]+$', '.analysis.json') AS report_path, count(*)::INTEGER AS n_listed FROM found GROUP BY lang, file",
    "strip_c_comments": "SELECT file_id, "
    + _strip("content", [(r"/\*(?s:.*?)\*/|//[^\n]*", ""), (r"(?m)^[ \t]*\n", ""), (r"\n[ \t]*$", "")])
    + " AS text FROM files WHERE lang = 'c'",
    "drop_c_directives": f"""SELECT file_id, array_to_string(list_filter(string_split(content, {NL}),
        lambda x: NOT regexp_matches(x, '^\\s*#(include|define|pragma|ifndef|ifdef|endif|else)')), {NL}) AS text
        FROM files WHERE lang = 'c'""",
    "strip_gcc_attributes": f"SELECT file_id, {_strip('content', _GCC_STEPS)} AS text FROM extended",
    # "FD_SET (" with a blank does not count as a use of the macro.
    "stub_fd_macros": f"SELECT file_id, {_strip('content', _FD_STEPS)} AS text FROM extended",
    "canonical_whitespace": f"SELECT file_id, {_strip('content', _WS_STEPS)} AS text FROM extended",
    "strip_ts_types": f"SELECT file_id, {_strip('content', _TS_STEPS)} AS text FROM files WHERE lang = 'javascript'",
    "py_functions": _py(f"fn_id, name, kind, line_number{_I} AS line_number, end_line{_I} AS end_line"),
    "py_class_context": _py("fn_id, full_name, class_context"),
    "py_decorators": _py(f"fn_id, decorators, first_line{_I} AS first_line"),
    # A subscript whose only element is another one is elided, from the inside out.
    "py_params": r"""SELECT fn_id, pos, name, regexp_replace(annotation, '(Optional|List)\[\w+\[.*?\]\]', '\1[...]') AS annotation,
        CASE WHEN starts_with("default", '[') THEN '[]' WHEN starts_with("default", '{') THEN '{}' ELSE "default" END AS "default" FROM py_params_t""",
    "py_return_annotation": r"""SELECT f.fn_id, f.name, nullif(regexp_replace(s.ret, '(Optional|List)\[\w+\[.*?\]\]', '\1[...]'), '') AS return_annotation
        FROM fns f JOIN py_sig s USING (fn_id)""",
    "js_functions": f"SELECT fn_id, name, kind, line_number{_I} AS line_number, end_line{_I} AS end_line FROM fns WHERE lang = 'javascript'",
    "js_params": "SELECT fn_id, params FROM js_params_t",
    "c_functions": f"SELECT fn_id, name, line_number{_I} AS line_number, return_type FROM fns WHERE lang = 'c'",
    "c_params": f"""SELECT fn_id, n{_I} AS param_count, (pos - 1){_I} AS pos, name, type,
        contains(type, '*') AS is_pointer, contains(type, '[') AS is_array FROM c_params_t""",
    "c_function_span": f"SELECT fn_id, line_number{_I} AS line_number, end_line{_I} AS end_line, md5(code) AS code_md5 FROM fns WHERE lang = 'c'",
    "py_function_source": _py("fn_id, code"),
    "js_function_source": "SELECT fn_id, code FROM fns WHERE lang = 'javascript'",
    "union_functions": f"SELECT fn_id, lang, name, line_number{_I} AS line_number FROM fns",
    "number_functions": f"SELECT path, fn_no{_I} AS fn_no, name, line_number{_I} AS line_number FROM fns",
    # Finished orders' files: the text, an empty line's end, the broken line, and the text again.
    "parse_recovery": f"""SELECT file_id, (CASE WHEN broken THEN 2 * n + 1 ELSE n END){_I} AS n_lines,
        (CASE WHEN NOT broken THEN 0 WHEN lang = 'python' THEN 2 WHEN lang = 'c' THEN 1 ELSE 0 END){_I} AS n_unbalanced,
        (CASE WHEN broken THEN n + 1 END){_I} AS error_line, n{_I} AS n_kept, k{_I} AS functions_before,
        (CASE WHEN broken THEN k ELSE 0 END){_I} AS functions_after
        FROM (SELECT t.file_id, t.lang, len(t.src) AS n, o.o_orderstatus = 'F' AS broken, coalesce(f.k, 0) AS k
              FROM texts t JOIN orders o ON o.o_orderkey = t.file_id
              LEFT JOIN (SELECT file_id, count(*) AS k FROM fns GROUP BY file_id) f USING (file_id))""",
    "py_imports": f"SELECT file_id, line_number{_I} AS line_number, kind, module, name, alias, statement FROM py_imps",
    "js_imports": f"SELECT file_id, line_number{_I} AS line_number, kind, module, statement FROM js_imps",
    "c_includes": f"SELECT file_id, line_number{_I} AS line_number, module, statement FROM c_imps",
    "hint_includes": """SELECT f.file_id, coalesce(h.hints, '') AS hints FROM files f LEFT JOIN (
        SELECT file_id, array_to_string(list(statement ORDER BY line_number)[1:5], ';') AS hints FROM c_imps
        WHERE line_number <= 50 AND regexp_matches(statement, 'stdio\\.h|stdlib\\.h|string\\.h|openssl/') GROUP BY file_id) h
        USING (file_id) WHERE f.lang = 'c'""",
    "py_calls": f"""SELECT fn_id, line_number{_I} AS line_number, name, object, kind, args_count{_I} AS args_count,
        kwargs_count{_I} AS kwargs_count, regexp_matches(lower(call), {q('|'.join(re.escape(w) for w in dims.DANGEROUS_PY_NAMES))}) AS is_dangerous
        FROM py_all_calls""",
    "js_calls": "SELECT fn_id, name FROM names WHERE lang = 'javascript'",
    "c_calls": "SELECT fn_id, name FROM names WHERE lang = 'c'",
    "page_script_calls": f"""SELECT DISTINCT page_id, name FROM (
        SELECT page_id, unnest(regexp_extract_all(regexp_replace(script, '"[^"\\n]*"|''[^''\\n]*''', '""', 'g'),
          '([\\w$]+)\\s*\\(', 1)) AS name FROM (
        SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS script FROM pages))
        WHERE name NOT IN {_words(_NOT_CALLS['javascript'])}""",
    "dangerous_calls_c": "SELECT fn_id, name, category, match_kind FROM dangerous WHERE NOT focus",
    "crypto_catalog_extend": "SELECT category, name, match_kind, count(*) AS n_functions FROM dangerous WHERE focus GROUP BY ALL",
    "has_dangerous_calls": "SELECT fn_id, name, fn_id IN (SELECT fn_id FROM dangerous WHERE NOT focus) AS has_dangerous_calls FROM fns WHERE lang = 'c'",
    "crypto_indicators": "SELECT fn_id, indicator FROM indicators",
    "crypto_enrich_context": """SELECT c.fn_id, array_to_string(list_concat(c.deps, coalesce(t.tags, [])), ',') AS dependencies
        FROM contexts c LEFT JOIN (SELECT fn_id, list(indicator ORDER BY pos) AS tags FROM indicators GROUP BY fn_id) t USING (fn_id)
        WHERE c.lang = 'c'""",
    "user_input_params": "SELECT fn_id, flag AS has_user_input_params FROM inputs",
    "dangerous_calls_py": f"""SELECT fn_id, line_number{_I} AS line_number, call FROM py_all_calls
        WHERE regexp_matches(lower(call), {q('|'.join(re.escape(w) for w in dims.DANGEROUS_PY_NAMES))})""",
    "name_risk_categories": "SELECT fn_id, name, category FROM cats",
    "web_endpoint_flag": _py("fn_id, name, regexp_matches(lower(decorators), 'route|post|get|put|delete|api') AS is_web_endpoint"),
    "traditional_risk_score": """SELECT i.fn_id, round(least(1.0, CASE WHEN i.lang <> 'c' AND i.flag THEN 0.3 ELSE 0.0 END
        + CASE WHEN i.lang = 'python' AND regexp_matches(lower(i.decorators), 'route|post|get|put|delete|api') THEN 0.4 ELSE 0.0 END
        + 0.2 * coalesce(k.n, 0))::DOUBLE, 4) AS score FROM inputs i
        LEFT JOIN (SELECT fn_id, count(*) AS n FROM cats GROUP BY fn_id) k USING (fn_id)""",
    "rule_scan": _rules("fns", f'path AS file, name AS "function", line_number{_I} AS line_number', "code", False),
    "rule_scan_pages": _rules(
        "pages", "page_id", "html", True, [("inline_script", "<none>", "<script>[^<]"), ("plain_http_link", "<none>", r"http://[\w.]+")]
    ),
    "rule_scan_documents": _rules(
        "documents", "doc_id", "text", True, [("credential_in_text", "<none>", r"(password|token)\s*=\s*\S"), ("access_key", "<none>", "AKIA[A-Z0-9]{16}")]
    ),
    "fallback_verdict": f"SELECT fn_id, {_F} FROM ruled",
    "c_security_flags": f"""SELECT fn_id,
        regexp_matches(code, {q('(?i)' + '|'.join(dims.BUFFER_OVERFLOW_PATTERNS))}) AS buffer_overflow_risk,
        regexp_matches(code, {q('(?i)' + '|'.join(dims.FORMAT_STRING_PATTERNS))}) AS format_string_risk,
        (contains(code, 'malloc(') OR contains(code, 'calloc(')) AND NOT contains(code, 'free(') AS memory_leak_risk,
        false AS integer_overflow_risk,
        regexp_matches(code, '\\*\\s*[a-zA-Z_]($|[^=!]|[=!]$|[=!][^=])') AS null_pointer_risk FROM fns WHERE lang = 'c'""",
    "py_pattern_categories": f"SELECT * FROM (SELECT fn_id, line_number{_I} AS line_number, call, CASE "
    + " ".join(
        f"WHEN regexp_matches(lower(call), {q('|'.join(ws))}) THEN {q(c)}"
        for c, ws in dims.PY_CALL_CATEGORIES.items()
    )
    + " END AS category FROM py_all_calls) WHERE category IS NOT NULL",
    "sql_string_concat_flag": rf"""SELECT c.fn_id, c.line_number{_I} AS line_number, c.call,
        regexp_matches(c.args, '(^|,\s*)(f["''][^,]*|["'']\s*\+[^,]*|[^,]*\+\s*["''])$') AS has_string_concat
        FROM (SELECT c.fn_id, c.line_number, c.call, substr(f.skel, c.i + 1, c.j - c.i - 1) AS args
              FROM py_all_calls c JOIN fns f USING (fn_id)) c WHERE regexp_matches(lower(c.call), 'execute|query|cursor|fetchall')""",
    "vuln_taxonomy": f"""SELECT lang, vulnerability_type, file, "function", line_number{_I} AS line_number FROM found
        WHERE (lang, vulnerability_type) NOT IN (SELECT (lang, vulnerability_type) FROM types)""",
    "severity_scale": f"""SELECT file, "function", line_number{_I} AS line_number, severity,
        (CASE severity WHEN 'high' THEN 4 ELSE 5 END){_I} AS severity_rank FROM found WHERE severity IN ('high', 'critical')""",
    "confidence_bands": f"SELECT {_BANDS} AS band, count(*) AS n, count(*) FILTER (confidence >= 0.7) AS n_probable FROM settled GROUP BY 1",
    "hardcoded_secrets": f"""SELECT doc_id, (pos - 1){_I} AS pos, hits[pos] AS literal FROM (
        SELECT doc_id, hits, unnest(range(1, len(hits) + 1)) AS pos FROM (
        SELECT doc_id, regexp_extract_all(text, {q(dims.SECRET_PATTERN)}) AS hits FROM documents))""",
    "build_context": f"""SELECT fn_id, name AS function_name, line_number{_I} AS line_number, md5(code) AS code_md5,
        array_to_string(imports, ';') AS imports, array_to_string(deps, ',') AS dependencies FROM contexts""",
    "risk_context_truncate": f"SELECT file_id, left(content || {NL} || content, 2000) AS scoring_code FROM files WHERE lang = 'c'",
    "render_risk_prompt": f"""SELECT fn_id, {q('Rate the security risk of this function with one number from 0.0 to 1.0.' + chr(10) * 2 + 'Function:' + chr(10) + '```' + chr(10))}
        || code || {q(chr(10) + '```' + chr(10) + 'Name: ')} || name || {q(chr(10) + 'Imports: ')} || {_none('imports', 3)}
        || {q(chr(10) + 'Deps: ')} || {_none('deps', 5)} AS prompt FROM contexts""",
    "render_vuln_prompt": f"""SELECT fn_id, CASE lang WHEN 'python' THEN {_review('python')}
        WHEN 'javascript' THEN {_review('javascript')} ELSE {_review('c')} END AS prompt FROM contexts""",
    "attach_responses": "SELECT f.fn_id, f.name, a.risk_text, a.verdict_text FROM fns f LEFT JOIN answers a USING (fn_id)",
    "parse_risk_response": f"SELECT fn_id, {_risk('risk_text')} AS score FROM answers WHERE risk_text IS NOT NULL",
    "parse_risk_text": f"SELECT conv_id, turn, {_risk('text')} AS score FROM conversations",
    "default_risk": "SELECT fn_id, risk_score::DOUBLE AS risk_score FROM scored",
    "parse_verdict": f"SELECT fn_id, accepted, {_F} FROM parsed",
    "settled_verdicts": f"SELECT fn_id, verdict_source, {_F} FROM settled",
    "risk_gate": f"SELECT fn_id, {_tier('risk_score', '>=')} AS tier, {_tier('risk_score', '>')} AS strict_tier FROM scored",
    "accept_findings": f'SELECT file, lang, "function", vulnerability_type, confidence, severity, line_number{_I} AS line_number, '
    "code_snippet, explanation, remediation FROM found",
    "scan_summary": "SELECT * FROM totals",
    "offline_scan_summary": """SELECT (SELECT count(*) FROM files) AS total_files_analyzed,
        count(DISTINCT path) AS files_with_vulnerabilities, count(*) AS total_vulnerabilities FROM ruled WHERE vulnerable""",
    "functions_summary": "SELECT lang, count(*) AS functions_analyzed, count(*) FILTER (risk_score > 0.5) AS high_risk_functions FROM scored GROUP BY lang",
    "findings_by_file": "SELECT file, n AS n_findings, top AS max_confidence, listing FROM per_file",
    "clean_files": "SELECT file_id, path AS file FROM files WHERE path NOT IN (SELECT file FROM found)",
    "incremental_scan": """SELECT f.path, sha256(f.content) AS sha, CASE WHEN o.o_orderstatus = 'O' THEN 'new' ELSE 'changed' END AS change
        FROM files f JOIN orders o ON o.o_orderkey = f.file_id WHERE o.o_orderstatus <> 'F'""",
    "deleted_paths": """SELECT f.path, sha256(f.content || CASE WHEN o.o_orderstatus = 'P' THEN '# old' || chr(10) ELSE '' END) AS sha,
        'deleted' AS change FROM files f JOIN orders o ON o.o_orderkey = f.file_id
        WHERE o.o_orderstatus = 'F' AND o.o_orderpriority = '5-LOW'""",
    "scan_versions": """SELECT f.path, sha256(f.content) AS sha,
        CASE o.o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'changed' ELSE CASE o.o_orderpriority WHEN '5-LOW' THEN 'deleted' ELSE 'new' END END AS change,
        (CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority <> '5-LOW' THEN 1 ELSE 2 END)::BIGINT AS version
        FROM files f JOIN orders o ON o.o_orderkey = f.file_id""",
    "rollup_findings": """SELECT lang, vulnerability_type, severity, count(*) AS n_findings, max(confidence) AS max_confidence,
        (GROUPING(lang) + GROUPING(vulnerability_type) + GROUPING(severity))::INTEGER AS level
        FROM found GROUP BY ROLLUP (lang, vulnerability_type, severity)""",
    "changed_findings": f'SELECT path AS file, lang, name AS "function", vulnerability_type, confidence, severity, line_number{_I} AS line_number, '
    "code_snippet, explanation, remediation FROM ruled WHERE vulnerable AND confidence > 0.5 AND path IN "
    "(SELECT f.path FROM files f JOIN orders o ON o.o_orderkey = f.file_id WHERE o.o_orderstatus <> 'F')",
    "append_findings": f'SELECT path AS file, lang, name AS "function", vulnerability_type, confidence, severity, line_number{_I} AS line_number, '
    "code_snippet, explanation, remediation FROM ruled WHERE vulnerable AND confidence > 0.5",
    "stream_findings": f'SELECT path AS file, lang, name AS "function", vulnerability_type, confidence, severity, line_number{_I} AS line_number, '
    "code_snippet, explanation, remediation FROM ruled WHERE vulnerable AND confidence > 0.5 AND "
    "file_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')",
    "corrected_findings": f'SELECT path AS file, lang, name AS "function", vulnerability_type, confidence, severity, line_number{_I} AS line_number, '
    "code_snippet, explanation, remediation FROM ruled WHERE vulnerable AND confidence > 0.5 AND "
    "file_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')",
    "compile_sources": "SELECT record_id, arg_no, source FROM sources",
    "preprocessor_flags": f"""SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY arg_no)){_I} AS flag_no, arg AS flag
        FROM args WHERE taken OR (NOT is_source AND regexp_matches(arg, '^(-I|-D|-U|-std=|-include$)'))""",
    "compile_only_flag": "SELECT record_id, list_contains(argv, '-c') AS compile_only FROM records",
    "resolve_source_path": r"""SELECT record_id, arg_no, source_path, out AS output_path, regexp_replace(out, '\.i$', '.meta.json') AS meta_path
        FROM (SELECT *, 'out/' || regexp_replace(regexp_replace(regexp_replace(source_path, '/\./', '/', 'g'),
          '/[^/]+/\.\./', '/', 'g'), '^/(home/dev/proj/)?', '') || '.i' AS out FROM sources)""",
    "compiler_family": r"""SELECT record_id, regexp_extract(compiler, '([^/]*)$', 1) AS compiler,
        CASE WHEN compiler IN ('clang', 'g++') THEN compiler ELSE 'gcc' END AS family FROM records""",
}


def oracle_sql() -> dict[str, str]:
    from .queries import EXTENSION_LINES

    ctes = {k: v.replace("<EXT>", EXTENSION_LINES.replace("'", "''")) for k, v in CTES.items()}
    names = list(ctes)

    def needed(sql: str, seen: set[str]) -> set[str]:
        for name in names:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                seen.add(name)
                needed(ctes[name], seen)
        return seen

    out = {}
    for key, sql in SQL.items():
        used = needed(sql, set())
        parts = [f"{n} AS MATERIALIZED ({ctes[n]})" for n in names if n in used]
        out[key] = (f"WITH {', '.join(parts)} " if parts else "") + sql
    return out
