"""Queries over the test tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import evaluate, extensions, grounding, index, qa, scan, state
from groundwork.plans import sql as Q
from groundwork.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """One file is one scan task; text work is dealt over the cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def doc_chunks(spark: SparkSession, sf: str, size: int = 160, overlap: int = 32) -> DataFrame:
    return index.chunk_words(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", size, overlap)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.lit(0).cast("long").alias("scope"), F.col("item_id").alias("qid"), F.col("text").alias("question")
    )


# ------------------------------------------------------------------ text


@query("chunk_documents", Q.with_(Q.chunks(), select="SELECT doc_id, pos, chunk_id, text FROM chunks"))
def chunk_documents(spark, sf):
    return doc_chunks(spark, sf).withColumn("pos", F.col("pos").cast("long"))


@query("chunk_small_overlap", Q.with_(Q.chunks("benchmark", "item_id", "text", 4, 1), select="SELECT doc_id, pos, chunk_id, text FROM chunks"))
def chunk_small_overlap(spark, sf):
    out = index.chunk_words(table(spark, sf, "benchmark"), "item_id", "text", 4, 1)
    return out.withColumn("pos", F.col("pos").cast("long"))


def _exploded(name: str, stop: tuple[str, ...]):
    @query(name, f"SELECT item_id, unnest({Q.tokens('text', stop)}) AS term FROM benchmark")
    def fn(spark, sf):
        return table(spark, sf, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"), stop)).alias("term"))


_exploded("token_sets", T.SEARCH_STOP)
_exploded("verifier_token_sets", T.EVIDENCE_STOP)


def _sentences(name: str, source: str, keys: tuple[str, ...]):
    cols = ", ".join(keys)

    @query(name, f"SELECT {cols}, unnest({Q.sentences('text')}) AS sentence, generate_subscripts({Q.sentences('text')}, 1) - 1 AS pos FROM {source}")
    def fn(spark, sf):
        rows = table(spark, sf, source).select(*keys, F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
        return rows.withColumn("pos", F.col("pos").cast("long"))


_sentences("sentence_split", "documents", ("doc_id",))
_sentences("sentence_split_turns", "conversations", ("conv_id", "turn"))


@query("number_claims", f"SELECT doc_id, unnest({Q.numbers('text')}) AS number FROM documents")
def number_claims(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("number"))


# ------------------------------------------------------------------ index and search


@query("document_frequency", Q.with_(Q.chunks(), Q.index(), select="SELECT term, df FROM df"))
def document_frequency(spark, sf):
    return index.document_frequency(index.postings(doc_chunks(spark, sf))).select("term", "df")


@query("idf_table", Q.with_(Q.chunks(), Q.index(), select="SELECT term, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf FROM df, n"))
def idf_table(spark, sf):
    chunks = doc_chunks(spark, sf)
    n = index.chunk_counts(chunks).select(F.col("scope").alias("_s"), "n")
    df = index.document_frequency(index.postings(chunks))
    return df.join(n, F.col("scope") == F.col("_s")).select("term", F.round(T.idf(F.col("n"), F.col("df")), 9).alias("idf"))


def _search(name: str, k: int):
    @query(name, Q.with_(Q.chunks(), Q.index(), Q.queries(), Q.hits(k), select="SELECT * FROM hits"))
    def fn(spark, sf):
        return index.search(questions(spark, sf), doc_chunks(spark, sf), k)


_search("search_topk", 5)
_search("search_topk_1", 1)


@query(
    "search_scoped",
    Q.with_(Q.chunks(), Q.index(), Q.queries(), Q.hits(5, "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"), select="SELECT * FROM hits"),
)
def search_scoped(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    return index.search(questions(spark, sf), doc_chunks(spark, sf), 5, doc_ids=good)


def _hits(spark, sf, k=5):
    found = index.search(questions(spark, sf), doc_chunks(spark, sf), k)
    # only the documents found are cut again; their number is bounded by the questions
    own = F.substring_index("chunk_id", ":", 1).cast("long").alias("_d")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(found.select(own).distinct(), F.col("doc_id") == F.col("_d"), "left_semi")
    texts = index.chunk_words(docs, "doc_id", "text").select(F.col("chunk_id").alias("_c"), F.col("doc_id"), "text")
    return found.join(texts, F.col("chunk_id") == F.col("_c")).select("qid", "rk", "chunk_id", "doc_id", "score", "text")


@query("candidate_sentence", Q.with_(Q.chunks(), Q.index(), Q.queries(), Q.hits(), Q.best(), select="SELECT qid, sentence, chunk_id, confidence FROM best"))
def candidate_sentence(spark, sf):
    return qa.candidates(questions(spark, sf), _hits(spark, sf))


@query(
    "search_trace",
    Q.with_(
        Q.chunks(), Q.index(), Q.queries(), Q.hits(1 << 30),
        select="""SELECT q.qid, (SELECT count(*) FROM qt WHERE qt.qid = q.qid) AS terms, (SELECT count(*) FROM hits WHERE hits.qid = q.qid) AS matched_chunks,
        (SELECT count(*) FROM hits WHERE hits.qid = q.qid AND rk <= 5) AS retrieved_chunks FROM q""",
    ),
)
def search_trace(spark, sf):
    return qa.trace(questions(spark, sf), doc_chunks(spark, sf))


# ------------------------------------------------------------------ verification

_CASES = f"""s0 AS (SELECT doc_id, chunk_id, pos AS place, unnest({Q.sentences("text")}) AS text, generate_subscripts({Q.sentences("text")}, 1) - 1 AS pos
  FROM chunks),
said AS (SELECT chunk_id AS answer_id, pos, CASE WHEN doc_id % 6 = 4 THEN '   ' ELSE text END AS text,
  CASE doc_id % 6 WHEN 1 THEN [doc_id || ':chunk:' || (place + 1)] WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN ['none:chunk:0']
  WHEN 5 THEN [chunk_id, chunk_id] ELSE [chunk_id] END AS ids FROM s0),
ev AS (SELECT a.chunk_id AS answer_id, c.pos AS rk, c.chunk_id, c.text FROM chunks a JOIN chunks c ON c.doc_id = a.doc_id AND c.pos IN (a.pos, a.pos + 1))"""


def _cases(spark, sf):
    """The sentences of every chunk of every document, citing by doc_id mod 6: own, next, nothing, unknown, own though blank, own twice.

    Retrieved are the own chunk and the next; the last one's next doesn't exist.
    """
    chunks = doc_chunks(spark, sf)
    named = lambda p: F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("chunk"), p.cast("string"))
    kind, own = F.col("doc_id") % 6, F.col("chunk_id")
    said = chunks.select("doc_id", "chunk_id", F.col("pos").alias("place"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "text")).select(
        own.alias("answer_id"),
        F.col("pos").cast("long").alias("pos"),
        F.when(kind == 4, "   ").otherwise(F.col("text")).alias("text"),
        F.when(kind == 1, F.array(named(F.col("place") + 1)))
        .when(kind == 2, F.array().cast("array<string>"))
        .when(kind == 3, F.array(F.lit("none:chunk:0")))
        .when(kind == 5, F.array(own, own))
        .otherwise(F.array(own))
        .alias("ids"),
    )
    near = chunks.withColumn("_for", F.explode(F.array("pos", F.col("pos") - 1))).where("_for >= 0")
    return said, near.select(named(F.col("_for")).alias("answer_id"), F.col("pos").cast("int").alias("rk"), "chunk_id", "text")


@query("verify_reasons", Q.with_(Q.chunks(), _CASES, Q.verified(), select="SELECT * FROM verified"))
def verify_reasons(spark, sf):
    said, retrieved = _cases(spark, sf)
    return grounding.verify(said, retrieved).drop("ids")


_TURNS = f"""prev AS (SELECT conv_id * 1000 + turn AS answer_id, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
answers AS (SELECT answer_id, text, before FROM prev WHERE role = 'assistant' AND before IS NOT NULL),
said AS (SELECT answer_id, unnest({Q.sentences("text")}) AS text, generate_subscripts({Q.sentences("text")}, 1) - 1 AS pos, ['before'] AS ids FROM answers),
ev AS (SELECT answer_id, 1 AS rk, 'before' AS chunk_id, before AS text FROM answers)"""


def _turns(spark, sf):
    """Assistant turns as answers that cite the turn before."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").withColumn("before", before)
    answers = rows.where("role = 'assistant' AND before IS NOT NULL").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text", "before"
    )
    said = answers.select(
        "answer_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"), F.array(F.lit("before")).alias("ids")
    ).withColumn("pos", F.col("pos").cast("long"))
    ev = answers.select("answer_id", F.lit(1).alias("rk"), F.lit("before").alias("chunk_id"), F.col("before").alias("text"))
    return answers, said, ev


@query("verify_conversations", Q.with_(_TURNS, Q.verified(), select="SELECT * FROM verified"))
def verify_conversations(spark, sf):
    _, said, ev = _turns(spark, sf)
    return grounding.verify(said, ev).drop("ids")


_DECIDE = """SELECT a.answer_id, count(v.answer_id) AS n_sentences, count(*) FILTER (v.verdict = 'unsupported') AS unsupported_sentence_count,
count(v.answer_id) = 0 OR count(*) FILTER (v.verdict = 'unsupported') > 0 AS abstained,
CASE WHEN count(v.answer_id) = 0 THEN 'no_answer_sentences' WHEN count(*) FILTER (v.verdict = 'unsupported') > 0 THEN 'grounding_contract_failed' END AS abstain_reason
FROM answers a LEFT JOIN verified v ON a.answer_id = v.answer_id GROUP BY a.answer_id"""


@query("answer_decision", Q.with_(_TURNS, Q.verified(0.05), select=_DECIDE))
def answer_decision(spark, sf):
    answers, said, ev = _turns(spark, sf)
    return grounding.decide(answers, grounding.verify(said, ev, 0.05))


@query(
    "eval_claim_rates",
    Q.with_(
        _TURNS,
        Q.verified(0.05),
        f"decided AS ({_DECIDE})",
        select="""SELECT count(*) AS n_answers, count(*) FILTER (abstained) AS n_abstained, sum(n_sentences)::BIGINT AS total_sentences,
        sum(n_sentences - unsupported_sentence_count)::BIGINT AS supported_sentences,
        round(sum(n_sentences - unsupported_sentence_count)::DOUBLE / sum(n_sentences), 4) AS citation_coverage,
        round(sum(unsupported_sentence_count)::DOUBLE / sum(n_sentences), 4) AS unsupported_claim_rate FROM decided""",
    ),
)
def eval_claim_rates(spark, sf):
    answers, said, ev = _turns(spark, sf)
    return evaluate.claim_rates(grounding.decide(answers, grounding.verify(said, ev, 0.05)))


_NONE = _TURNS.replace("AS ids FROM answers)", "AS ids FROM answers WHERE answer_id % 3 > 0)")


@query("no_answer_sentences", Q.with_(_NONE, Q.verified(0.05), select=_DECIDE))
def no_answer_sentences(spark, sf):
    answers, said, ev = _turns(spark, sf)
    return grounding.decide(answers, grounding.verify(said.where("answer_id % 3 > 0"), ev, 0.05))


_BENCH_SAID = f"""said AS (SELECT h.qid AS answer_id, unnest({Q.sentences("q.question")}) AS text, generate_subscripts({Q.sentences("q.question")}, 1) - 1 AS pos,
  [h.chunk_id] AS ids FROM hits h JOIN q ON h.qid = q.qid),
ev AS (SELECT h.qid AS answer_id, h.rk, h.chunk_id, c.text FROM hits h JOIN chunks c ON h.chunk_id = c.chunk_id)"""


@query(
    "verify_threshold_high",
    Q.with_(Q.chunks(), Q.index(), Q.queries(), Q.hits(1), _BENCH_SAID, Q.verified(0.8), select="SELECT * FROM verified"),
)
def verify_threshold_high(spark, sf):
    ev = _hits(spark, sf, 1).withColumnRenamed("qid", "answer_id")
    q = questions(spark, sf).select(F.col("qid").alias("_q"), "question")
    said = (
        ev.join(q, F.col("answer_id") == F.col("_q"))
        .select("answer_id", F.posexplode(T.sentences(F.col("question"))).alias("pos", "text"), F.array("chunk_id").alias("ids"))
        .withColumn("pos", F.col("pos").cast("long"))
    )
    return grounding.verify(said, ev, 0.8).drop("ids")


# ------------------------------------------------------------------ answers

#: A candidate is a verbatim sentence of the chunk it cites and thus always supported.
_ASK = """SELECT q.qid, coalesce(b.sentence, '') AS answer, b.qid IS NULL AS abstained,
CASE WHEN l.qid IS NULL THEN 'no_retrieved_evidence' WHEN b.qid IS NULL THEN 'no_candidate_sentence' END AS abstain_reason,
b.chunk_id AS supporting_chunk_id, b.confidence, coalesce(l.ids, '') AS retrieved, coalesce(l.n, 0) AS n_passages
FROM q LEFT JOIN best b ON q.qid = b.qid
LEFT JOIN (SELECT qid, string_agg(chunk_id, ' ' ORDER BY rk) AS ids, count(*) AS n FROM hits GROUP BY qid) l ON q.qid = l.qid"""


def _flat(out: DataFrame) -> DataFrame:
    return out.select(
        "qid", "answer", "abstained", "abstain_reason", "supporting_chunk_id", "confidence",
        F.array_join("retrieved_chunk_ids", " ").alias("retrieved"),
        F.size("best_supporting_passages").cast("long").alias("n_passages"),
    )


@query("ask_flagship", Q.with_(Q.chunks(), Q.index(), Q.queries(), Q.hits(), Q.best(), select=_ASK))
def ask_flagship(spark, sf):
    return _flat(qa.ask(questions(spark, sf), doc_chunks(spark, sf)))


def _inline(sql: str, k: int) -> str:
    """The same with an index a question: p (scope, question, passages, doc)."""
    return f"""WITH p AS ({sql}), q AS (SELECT scope AS qid, question FROM p),
chunks AS (SELECT scope, doc || ':passage:' || t.i AS chunk_id, passages[t.i + 1] AS text FROM p, unnest(range(0, len(passages))) AS t(i)),
post AS (SELECT scope, chunk_id, unnest({Q.tokens("text")}) AS term FROM chunks),
df AS (SELECT scope, term, count(*) AS df FROM post GROUP BY scope, term),
n AS (SELECT scope, count(*)::DOUBLE AS n FROM chunks GROUP BY scope),
qw AS (SELECT qid, unnest({Q.tokens("question")}) AS term FROM q),
qt AS (SELECT qid, qw.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qw JOIN n ON qw.qid = n.scope
  LEFT JOIN df ON qw.term = df.term AND qw.qid = df.scope),
den AS (SELECT qid, sum(idf) AS whole FROM qt GROUP BY qid),
part AS (SELECT qid, chunk_id, sum(idf) AS part FROM qt JOIN post ON qt.term = post.term AND qt.qid = post.scope GROUP BY qid, chunk_id),
scored AS (SELECT part.qid, chunk_id, round(part / whole, 9) AS score FROM part JOIN den ON part.qid = den.qid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rk FROM scored),
hits AS (SELECT qid, rk::INTEGER AS rk, chunk_id, score FROM ranked WHERE rk <= {k}),
{Q.best().replace("ON h.chunk_id = c.chunk_id", "ON h.chunk_id = c.chunk_id AND h.qid = c.scope")}"""


_PASSAGES = """SELECT conv_id AS scope, 'conv-' || conv_id AS doc, arg_max(text, turn) FILTER (role = 'user') AS question,
list(text ORDER BY turn) FILTER (role = 'assistant') AS passages FROM conversations GROUP BY conv_id
HAVING count(*) FILTER (role = 'assistant') > 0 AND count(*) FILTER (role = 'user') > 0"""


def _passages(spark, sf):
    """Each conversation's last user turn as question, its assistant turns as passages."""
    said = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"),
        F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]).alias("passages"),
        F.count_if(F.col("role") == "user").alias("_u"),
    )
    return rows.where((F.size("passages") > 0) & (F.col("_u") > 0)).select(
        "conv_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("doc"), "question", "passages"
    )


@query("ask_inline_passages", _inline(_PASSAGES, 10) + _ASK)
def ask_inline_passages(spark, sf):
    return _flat(qa.ask_inline(_passages(spark, sf), "conv_id", "question", "passages", "doc"))


# ------------------------------------------------------------------ evaluation

_EXAMPLES = f"""SELECT b.item_id AS scope, 'doc-' || b.item_id AS doc, CASE WHEN b.item_id % 4 = 3 THEN 'zzunseen' ELSE b.text END AS question,
[b.text] AS passages, CASE WHEN b.item_id % 2 = 0 THEN ({Q.sentences("b.text")})[1] ELSE '' END AS expected, b.item_id % 4 >= 2 AS must FROM benchmark b"""


def _examples(spark, sf):
    """Benchmark texts as questions about themselves; a quarter ask for what isn't there."""
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("question_id"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("doc_id"),
        F.when(i % 4 == 3, "zzunseen").otherwise(F.col("text")).alias("question"),
        F.array("text").alias("passages"),
        F.when(i % 2 == 0, F.get(T.sentences(F.col("text")), F.lit(0))).otherwise("").alias("expected_answer"),
        (i % 4 >= 2).alias("requires_abstention"),
    )


_ROWS = f""", res AS (SELECT p.scope AS question_id, p.must AS requires_abstention, p.expected AS expected_answer, a.answer, a.abstained, a.abstain_reason
FROM p JOIN ({_ASK}) a ON p.scope = a.qid)"""


@query("eval_rows", _inline(_EXAMPLES, 5) + _ROWS + " SELECT * FROM res")
def eval_rows(spark, sf):
    return evaluate.rows(_examples(spark, sf)).drop("retrieved_chunk_ids", "n_sentences", "n_supported")


def _rate(n: str, d: str) -> str:
    return f"round(CASE WHEN {d} = 0 THEN 0.0 ELSE ({n})::DOUBLE / {d} END, 4)"


_SUMMARY = f"""SELECT n AS n_questions, answerable AS answerable_questions, n - answerable AS abstention_expected, n - predicted AS answered_questions,
{_rate("predicted", "n")} AS abstention_rate, {_rate("exact", "answerable")} AS exact_answer_match, {_rate("hit", "predicted")} AS abstention_precision,
{_rate("hit", "(n - answerable)")} AS abstention_recall, {_rate("n - predicted", "(n - predicted)")} AS citation_coverage,
{_rate("0", "(n - predicted)")} AS unsupported_claim_rate FROM (SELECT count(*) AS n, count(*) FILTER (NOT requires_abstention) AS answerable,
count(*) FILTER (abstained) AS predicted, count(*) FILTER (abstained AND requires_abstention) AS hit,
count(*) FILTER (NOT requires_abstention AND answer = expected_answer) AS exact FROM res)"""


@query("eval_summary", _inline(_EXAMPLES, 5) + _ROWS + _SUMMARY)
def eval_summary(spark, sf):
    return evaluate.summary(evaluate.rows(_examples(spark, sf)))


@query("median_metric", "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def median_metric(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@query(
    "latency_percentiles",
    "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, "
    "round(avg(value), 6) AS mean FROM events",
)
def latency_percentiles(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), "value", 6)


# ------------------------------------------------------------------ identity, states, events


@query("sha256_dedupe", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def sha256_dedupe(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "upload_idempotent",
    """WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), k AS (SELECT sha256, min(doc_id) AS doc_id FROM h WHERE doc_id % 2 = 0 GROUP BY 1),
    f AS (SELECT sha256, min(doc_id) AS doc_id FROM h WHERE doc_id % 2 = 1 GROUP BY 1)
    SELECT f.sha256, coalesce(k.doc_id, f.doc_id) AS doc_id, k.doc_id IS NULL AS is_new FROM f LEFT JOIN k ON f.sha256 = k.sha256""",
)
def upload_idempotent(spark, sf):
    """Documents with an odd id are uploaded where the others are known."""
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return files.upload(hashed.where("doc_id % 2 = 0"), hashed.where("doc_id % 2 = 1"))


@query(
    "reingest_versions",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 2 ELSE 1 END AS version, source FROM documents",
)
def reingest_versions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), "source")
    return files.latest_versions(files.reingest(docs, table(spark, sf, "labels").where("quality = 0")))


#: Events have no status; each type stands for one.
_STATUS = {"signup": "pending", "view": "running", "click": "complete", "error": "failed", "purchase": "running"}


def _statuses(spark, sf):
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf, "events").select("user_id", "ts", "event_id", status.alias("status"))


def _transitions(machine: str):
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())
    edges = ", ".join(f"'{a}>{b}'" for a, b in state.MACHINES[machine])

    @query(
        f"transition_check_{machine}",
        f"""WITH s AS (SELECT user_id, ts, event_id, CASE event_type {case} END AS status FROM events),
        l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current FROM s)
        SELECT user_id, event_id, current, status AS next, current || '>' || status IN ({edges}) AS valid FROM l WHERE current IS NOT NULL""",
    )
    def fn(spark, sf):
        return state.transitions(_statuses(spark, sf), machine, "user_id", ["ts", "event_id"]).drop("ts")


for _m in state.MACHINES:
    _transitions(_m)


@query(
    "retry_counts",
    f"""WITH s AS (SELECT user_id, ts, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status FROM events),
    l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current FROM s)
    SELECT user_id, count(*) FILTER (current = 'failed' AND status = 'running') AS retry_count FROM l WHERE current IS NOT NULL GROUP BY user_id""",
)
def retry_counts(spark, sf):
    return state.retries(state.transitions(_statuses(spark, sf), "parse", "user_id", ["ts", "event_id"]), "user_id")


@query("event_payload_decode", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_payload_decode(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", "event_type", F.col("p.k").alias("k"))


@query(
    "searchable_flags",
    "SELECT user_id, count(*) AS n_events, bool_or(event_type = 'view') AS is_body_searchable, "
    "bool_or(event_type = 'purchase') AS is_enriched_searchable, count(DISTINCT event_type) AS completed FROM events GROUP BY user_id",
)
def searchable_flags(spark, sf):
    return state.searchable(table(spark, sf, "events"), ["user_id"], "view", "purchase")


# ------------------------------------------------------------------ extensions


@query(
    "ext_retrieval_metrics",
    Q.with_(
        Q.chunks(), Q.index(), Q.queries(), Q.hits(),
        """rel AS (SELECT DISTINCT b.qid, b.chunk_id AS item FROM (SELECT qid, chunk_id, count(*) AS c FROM qt JOIN post ON qt.term = post.term GROUP BY 1, 2) b
        JOIN (SELECT qid, count(*) AS t FROM qt GROUP BY 1) w ON b.qid = w.qid WHERE c >= 0.8 * t),
        n_ AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
        f_ AS (SELECT h.qid, count(*) AS c, sum(1 / log2(rk + 1)) AS dcg, min(rk) AS first FROM hits h JOIN rel ON h.qid = rel.qid AND h.chunk_id = rel.item GROUP BY h.qid)""",
        select="""SELECT n_.qid, round(coalesce(c, 0) / 5, 6) AS precision, round(coalesce(c, 0) / n, 6) AS recall,
        round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
        round(coalesce(1 / first, 0), 6) AS mrr FROM n_ LEFT JOIN f_ ON n_.qid = f_.qid""",
    ),
)
def ext_retrieval_metrics(spark, sf):
    """A chunk is relevant to a question if it has four in five of its terms."""
    chunks, q = doc_chunks(spark, sf), questions(spark, sf)
    if (a := scan.asked(q)) is not None:
        hits = scan.search(a, chunks, chunks, 5).select("qid", "rk", F.col("chunk_id").alias("item"))
        return evaluate.retrieval_metrics(hits, scan.sharing(a, chunks, 0.8))
    terms = q.select("qid", F.explode(T.tokens(F.col("question"))).alias("term"))
    size = terms.groupBy(F.col("qid").alias("_q")).agg(F.count(F.lit(1)).alias("t"))
    both = index.postings(chunks).select("chunk_id", F.col("term").alias("_t")).join(terms, F.col("term") == F.col("_t"))
    relevant = both.groupBy("qid", F.col("chunk_id").alias("item")).agg(F.count(F.lit(1)).alias("c"))
    relevant = relevant.join(size, F.col("qid") == F.col("_q")).where(F.col("c") >= 0.8 * F.col("t")).select("qid", "item")
    hits = index.search(q, chunks).select("qid", "rk", F.col("chunk_id").alias("item"))
    return evaluate.retrieval_metrics(hits, relevant)


_BM25 = f"""bag AS (SELECT chunk_id, list_filter(list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda x: lower(x)),
  lambda x: x NOT IN ({", ".join(f"'{w}'" for w in T.SEARCH_STOP)}) AND (length(x) > 2 OR regexp_matches(x, '[0-9]'))) AS bag FROM chunks),
tf AS (SELECT chunk_id, size, term, count(*) AS tf FROM (SELECT chunk_id, len(bag) AS size, unnest(bag) AS term FROM bag) GROUP BY ALL),
st AS (SELECT count(*) AS cn, avg(len(bag)) AS mean FROM bag), bd AS (SELECT term, count(*) AS bd FROM tf GROUP BY term),
bm AS (SELECT qid, chunk_id, round(sum(ln(1 + (cn - bd + 0.5) / (bd + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score
  FROM qw JOIN bd ON qw.term = bd.term JOIN tf ON qw.term = tf.term, st GROUP BY qid, chunk_id),
bmr AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rk FROM bm)"""


@query("ext_bm25", Q.with_(Q.chunks(), Q.index(), Q.queries(), _BM25, select="SELECT qid, rk, chunk_id, score FROM bmr WHERE rk <= 5"))
def ext_bm25(spark, sf):
    return extensions.bm25(questions(spark, sf), doc_chunks(spark, sf))


@query(
    "ext_rrf",
    Q.with_(
        Q.chunks(), Q.index(), Q.queries(), Q.hits(10), _BM25,
        """both_ AS (SELECT qid, chunk_id AS item, rk FROM hits UNION ALL SELECT qid, chunk_id, rk FROM bmr WHERE rk <= 10),
        fused AS (SELECT qid, item, round(sum(1.0 / (60 + rk)), 9) AS score FROM both_ GROUP BY 1, 2)""",
        select="SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item)::INTEGER AS rk, item, score FROM fused) WHERE rk <= 10",
    ),
)
def ext_rrf(spark, sf):
    """The idf ranking and the BM25 ranking fused."""
    q, chunks = questions(spark, sf), doc_chunks(spark, sf)
    if (asked := scan.asked(q)) is not None:  # both rankings need the same counts
        stats = scan.counts(asked, chunks)
        found = scan.search(asked, chunks, chunks, 10, stats), scan.bm25(asked, chunks, 10, extensions.BM25_K1, extensions.BM25_B, stats)
        return extensions.fuse(*(x.select("qid", "rk", F.col("chunk_id").alias("item")) for x in found))
    a = index.search(q, chunks, 10).select("qid", "rk", F.col("chunk_id").alias("item"))
    b = extensions.bm25(q, chunks, 10).select("qid", "rk", F.col("chunk_id").alias("item"))
    return extensions.fuse(a, b)


@query(
    "ext_knn",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS item,
    round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item)::INTEGER AS rk, item, score FROM s)
    SELECT * FROM r WHERE rk <= 10""",
)
def ext_knn(spark, sf):
    """Neighbours of the vectors whose id 50 divides, against all."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    return extensions.nearest(vectors.where("item % 50 = 0").withColumnRenamed("item", "qid"), vectors)


@query(
    "ext_budget",
    Q.with_(
        Q.chunks(), Q.index(), Q.queries(), Q.hits(10),
        f"""hw AS (SELECT h.*, c.doc_id, len({Q.words("c.text")})::BIGINT AS words FROM hits h JOIN chunks c ON h.chunk_id = c.chunk_id WHERE score >= 0.1),
        hd AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rk) AS d FROM hw)""",
        select="""SELECT qid, rk, chunk_id, words, used FROM (SELECT *, sum(words) OVER (PARTITION BY qid ORDER BY rk)::BIGINT AS used FROM hd WHERE d <= 2)
        WHERE used <= 400""",
    ),
)
def ext_budget(spark, sf):
    return extensions.budget(_hits(spark, sf, 10))


@query(
    "ext_resolver",
    """SELECT doc_id, CASE WHEN (doc_id % 10) / 10 >= 0.8 THEN source ELSE lang END AS resolved_title,
    CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS resolved_authors,
    CASE WHEN doc_id % 3 = 0 THEN 1990 ELSE 2000 + doc_id % 20 END AS resolved_year, source AS resolved_venue, '1.0' AS resolution_policy_version FROM documents""",
)
def ext_resolver(spark, sf):
    i = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("docling_title"), F.col("source").alias("grobid_title"), (i % 10 / 10).alias("grobid_title_confidence"),
        F.array("lang").alias("docling_authors"), F.array("lang", "source").alias("grobid_authors"), F.lit(1990).cast("long").alias("docling_year"),
        F.when(i % 3 != 0, 2000 + i % 20).alias("grobid_year"), F.col("source").alias("grobid_venue"),
    )
    return extensions.resolve(docs).withColumn("resolved_authors", F.array_join("resolved_authors", ","))


@query(
    "ext_gate",
    _inline(_EXAMPLES, 5) + _ROWS + f", sm AS ({_SUMMARY}) " + """SELECT 'citation_coverage' AS metric, citation_coverage AS value, 0.9::DOUBLE AS threshold,
    citation_coverage >= 0.9 AS passed FROM sm UNION ALL SELECT 'abstention_recall', abstention_recall, 0.6::DOUBLE, abstention_recall >= 0.6 FROM sm""",
)
def ext_gate(spark, sf):
    return evaluate.gate(evaluate.summary(evaluate.rows(_examples(spark, sf))), {"citation_coverage": 0.9, "abstention_recall": 0.6})
