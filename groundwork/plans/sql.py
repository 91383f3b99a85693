"""SQL for DuckDB that says the same as the plans, built of common table expressions."""

from __future__ import annotations

from groundwork.functions import text as T

TOKEN, EDGE = T.TOKEN, r"^\s+|\s+$"


def tokens(c: str, stop: tuple[str, ...] = T.SEARCH_STOP) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    found = f"list_distinct(list_transform(regexp_extract_all({c}, '{TOKEN}'), lambda x: lower(x)))"
    return f"list_filter({found}, lambda x: x NOT IN ({words}) AND (length(x) > 2 OR regexp_matches(x, '[0-9]')))"


def numbers(c: str) -> str:
    return rf"list_distinct(regexp_extract_all({c}, '\b\d+(?:\.\d+)?(?:%\B|\b)'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{EDGE}', '', 'g')"


def sentences(c: str) -> str:
    parts = rf"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> '')"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def chunks(table: str = "documents", id_: str = "doc_id", text: str = "text", size: int = 160, overlap: int = 32) -> str:
    """words_, chunks (doc_id, pos, chunk_id, text)"""
    stride = size - overlap
    return f"""words_ AS (SELECT {id_} AS doc_id, {words(text)} AS w FROM {table} WHERE len({words(text)}) > 0),
chunks AS (SELECT doc_id, t.i AS pos, doc_id || ':chunk:' || t.i AS chunk_id,
  array_to_string(w[t.i * {stride} + 1 : t.i * {stride} + {size}], ' ') AS text
  FROM words_, unnest(range(0, greatest(1, ceil((len(w) - {size}) / {stride})::BIGINT + 1))) AS t(i))"""


def index() -> str:
    """post, df, n over chunks"""
    return f"""post AS (SELECT chunk_id, doc_id, unnest({tokens("text")}) AS term FROM chunks),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM chunks)"""


def queries(sql: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    """q, qt (qid, term, idf), den (qid, whole)"""
    return f"""q AS ({sql}),
qw AS (SELECT qid, unnest({tokens("question")}) AS term FROM q),
qt AS (SELECT qid, qw.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qw LEFT JOIN df ON qw.term = df.term, n),
den AS (SELECT qid, sum(idf) AS whole FROM qt GROUP BY qid)"""


def hits(k: int = 5, where: str = "TRUE") -> str:
    """hits (qid, rk, chunk_id, score)"""
    return f"""part AS (SELECT qid, chunk_id, sum(idf) AS part FROM qt JOIN post ON qt.term = post.term WHERE {where} GROUP BY qid, chunk_id),
scored AS (SELECT part.qid, chunk_id, round(part / whole, 9) AS score FROM part JOIN den ON part.qid = den.qid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rk FROM scored),
hits AS (SELECT qid, rk::INTEGER AS rk, chunk_id, score FROM ranked WHERE rk <= {k})"""


def best() -> str:
    """best (qid, sentence, chunk_id, confidence): candidate sentences of hits"""
    return f"""sent AS (SELECT h.qid, h.rk, h.chunk_id, h.score, unnest({sentences("c.text")}) AS sentence,
  generate_subscripts({sentences("c.text")}, 1) AS k FROM hits h JOIN chunks c ON h.chunk_id = c.chunk_id),
worth AS (SELECT sent.*, round(({share(tokens("question"), tokens("sentence"))}) * score, 9) AS confidence
  FROM sent JOIN q ON sent.qid = q.qid),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, chunk_id DESC, rk, k) AS o
  FROM worth WHERE confidence > 0) WHERE o = 1)"""


def verified(min_overlap: float = 0.35) -> str:
    """verified, from said (answer_id, pos, text, ids) and ev (answer_id, rk, chunk_id, text)"""
    tok, num = tokens("text", T.EVIDENCE_STOP), numbers("text")
    return f"""evt AS (SELECT answer_id, chunk_id, arg_max({tok}, rk) AS tok, arg_max({num}, rk) AS num FROM ev GROUP BY answer_id, chunk_id),
cite AS (SELECT answer_id, pos, unnest(list_distinct(ids)) AS id FROM said),
cited AS (SELECT cite.answer_id, cite.pos, bool_or(evt.chunk_id IS NULL) AS missing, flatten(list(evt.tok)) AS tok, flatten(list(evt.num)) AS num
  FROM cite LEFT JOIN evt ON cite.answer_id = evt.answer_id AND cite.id = evt.chunk_id GROUP BY cite.answer_id, cite.pos),
judged AS (SELECT said.answer_id, said.pos, said.text, {share(tokens("said.text", T.EVIDENCE_STOP), "coalesce(cited.tok, [])")} AS share,
  CASE WHEN {strip("said.text")} = '' THEN 'empty_sentence' WHEN len(said.ids) = 0 THEN 'missing_supporting_chunk_ids'
  WHEN missing THEN 'supporting_chunk_not_retrieved'
  WHEN len(list_filter({numbers("said.text")}, lambda x: NOT list_contains(cited.num, x))) > 0 THEN 'numeric_claim_not_in_evidence'
  END AS early FROM said LEFT JOIN cited ON said.answer_id = cited.answer_id AND said.pos = cited.pos),
verified AS (SELECT answer_id, pos, text, CASE WHEN reason IS NULL THEN 'supported' ELSE 'unsupported' END AS verdict, reason,
  CASE WHEN reason IS NULL OR reason IN ('numeric_claim_not_in_evidence', 'insufficient_evidence_overlap') THEN round(share, 9) ELSE 0.0 END AS support_score
  FROM (SELECT *, coalesce(early, CASE WHEN share < {min_overlap} THEN 'insufficient_evidence_overlap' END) AS reason FROM judged))"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
