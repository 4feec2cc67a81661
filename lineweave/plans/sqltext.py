"""Shared pieces of the SQL twins (DuckDB)."""

LINES = """SELECT doc_id, lang, source, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no,
       unnest(string_split(text, chr(10))) AS line FROM documents"""

PAIRS = """SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""

BLANK = r"[ \t\n\x0B\f\r]"
PUNCT = r"[!-/:-@\[-`{-~]"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{BLANK}+'), lambda x: x <> '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"
