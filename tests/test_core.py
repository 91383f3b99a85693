import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from groundwork import schemas
from groundwork.functions import text as T
from groundwork.operators import evaluate, extensions, grounding, index, qa, state
from groundwork.sources import files
from groundwork.streaming import events as stream

TOKENS = {
    "state-of-the-art": ["state-of", "the-art"], "1.2.3": ["1.2", "3"], "GPT-4-turbo": ["gpt-4", "turbo"], "node_1": ["node", "1"],
    "3,000": ["3", "000"], "94% of 94": ["94%", "94"], "is it an ox": [], "How WHAT x1": ["x1"],
}
NUMBERS = {
    "F1": [], "18ms": [], "1e5": [], "x_5": [], "1,234": ["1", "234"], "4.2.1": ["4.2", "1"], "-3": ["3"], "3.5x": ["3"], "12.34x": ["12"],
    "5%x": ["5"], "v2.0": ["0"], "in 2020.": ["2020"], "94%": ["94%"], "4.20 4.2": ["4.20", "4.2"],
}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens_numbers_sentences(spark):
    for text, want in TOKENS.items():
        assert one(spark, text, T.tokens) == want
    for text, want in NUMBERS.items():
        assert one(spark, text, T.numbers) == want
    assert one(spark, "how it is", lambda c: T.tokens(c, T.EVIDENCE_STOP)) == ["how"]
    assert one(spark, " A b.  C!d?   E\n", T.sentences) == ["A b.", "C!d?", "E"]
    assert one(spark, "  \t", T.sentences) == []


def test_numbers_match_the_definition(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("19.%x_ ,-é") for _ in range(rng.randrange(14))) for _ in range(400)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.numbers(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.n == list(dict.fromkeys(re.findall(r"(?<!\w)\d+(?:\.\d+)?%?(?!\w)", texts[r.k])))


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (1, 0), (5, 4), (160, 32)])
def test_chunks(spark, size, overlap):
    rows = [(n, " ".join(f"w{k}" for k in range(n))) for n in (0, 1, 3, 4, 5, 8, 200)]
    got = {}
    for r in index.chunk_words(spark.createDataFrame(rows, "d int, t string"), "d", "t", size, overlap).orderBy("doc_id", "pos").collect():
        assert r.chunk_id == f"{r.doc_id}:chunk:{r.pos}"
        got.setdefault(r.doc_id, []).append(r.text)
    for n, t in rows:
        w, want, at = t.split(), [], 0
        while w:
            want.append(" ".join(w[at : at + size]))
            if at + size >= n:
                break
            at += size - overlap
        assert got.get(n, []) == want


def test_parameters(spark):
    df = spark.createDataFrame([(1, "a")], "d int, t string")
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            index.chunk_words(df, "d", "t", *bad)
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError):
            grounding.verify(df, df, bad)


def corpus(spark):
    rows = [("c1", "d1", "Red foxes hunt rabbits at dawn. They sleep all day."), ("c2", "d2", "Blue whales eat krill."), ("c3", "d1", "Rabbits eat clover at dawn.")]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")


def ask_of(spark, *texts):
    return spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "scope long, qid long, question string")


def test_search(spark):
    q, chunks = ask_of(spark, "What do whales eat?", "Quantum chess", "rabbits dawn"), corpus(spark)
    got = {}
    for r in index.search(q, chunks, 2).orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == {0: ["c2", "c3"], 2: ["c1", "c3"]}  # equal scores by chunk_id
    only = spark.createDataFrame([("d2",)], "doc_id string")
    assert {r.chunk_id for r in index.search(q, chunks, 5, doc_ids=only).collect()} == {"c2"}
    assert index.search(q, chunks, 5, doc_ids=only.where("false")).count() == 4  # none named: no filter
    assert index.search(q, chunks, 0).count() == 0


def test_ask(spark):
    got = {r.qid: r for r in qa.ask(ask_of(spark, "What do whales eat?", "Quantum chess", ""), corpus(spark)).collect()}
    assert got[0].answer == "Blue whales eat krill." and got[0].supporting_chunk_id == "c2" and got[0].support_score == 1.0
    assert got[1].abstained and got[1].abstain_reason == "no_retrieved_evidence" and got[1].answer == "" and got[1].retrieved_chunk_ids == []
    assert got[2].abstained


def test_inline(spark):
    rows = [("q1", None, "Who bakes bread?", ["The baker bakes bread. He sings.", "Cats sleep."]), ("q2", "d", "Who flies?", [])]
    got = {r.qid: r for r in qa.ask_inline(spark.createDataFrame(rows, "q string, d string, t string, p array<string>"), "q", "t", "p", "d").collect()}
    assert got["q1"].answer == "The baker bakes bread." and got["q1"].supporting_chunk_id == "inline:passage:0"
    assert got["q2"].abstain_reason == "no_retrieved_evidence"


EVIDENCE = "Our sorter beats the old one by 7.5 seconds on large lists."
CASES = [
    (EVIDENCE, ["e"], None, 1.0), ("Our sorter wins by 7.5 seconds.", [], "missing_supporting_chunk_ids", 0.0),
    ("Our sorter wins.", ["gone"], "supporting_chunk_not_retrieved", 0.0), ("Tomatoes grow well in warm greenhouses.", ["e"], "insufficient_evidence_overlap", 0.0),
    ("Our sorter beats the old one by 9.9 seconds.", ["e"], "numeric_claim_not_in_evidence", None), ("Sorter beats old by 7.5 seconds", ["e", "e"], None, 1.0),
    (" \t", ["e"], "empty_sentence", 0.0), ("It is.", ["e"], "insufficient_evidence_overlap", 0.0), ("Our sorter wins.", None, "missing_supporting_chunk_ids", 0.0),
]


def test_verify_and_decide(spark):
    said = spark.createDataFrame([(k, 0, t, ids) for k, (t, ids, _, _) in enumerate(CASES)], "answer_id long, pos long, text string, ids array<string>")
    ev = spark.createDataFrame([(k, rk, "e", t) for k in range(len(CASES)) for rk, t in ((1, "first text"), (2, EVIDENCE))], "answer_id long, rk int, chunk_id string, text string")
    verified = grounding.verify(said, ev)
    got = {r.answer_id: r for r in verified.collect()}
    for k, (_, ids, reason, score) in enumerate(CASES):
        assert got[k].reason == reason and (got[k].verdict == "supported") == (reason is None)
        assert score is None or got[k].support_score == score
        assert got[k].ids == list(dict.fromkeys(ids or []))
    answers = spark.createDataFrame([(k,) for k in range(len(CASES) + 1)], "answer_id long")
    done = {r.answer_id: r for r in grounding.decide(answers, verified, ev).collect()}
    assert not done[0].abstained and done[0].retrieved_chunk_ids == ["e"]
    assert done[1].abstain_reason == "grounding_contract_failed" and done[1].unsupported_sentence_count == 1
    assert done[len(CASES)].abstain_reason == "no_answer_sentences" and done[len(CASES)].retrieved_chunk_ids == []


def test_evaluation(spark, tmp_path):
    rows = [
        {"question_id": "a", "doc_id": "d", "question": "Who bakes bread?", "passages": ["The baker bakes bread. He sings."], "expected_answer": "The baker bakes bread."},
        {"question_id": "b", "doc_id": "d", "question": "Who flies?", "passages": ["The baker bakes bread."], "requires_abstention": True},
        {"question_id": "c", "doc_id": "d", "question": "Who swims?", "passages": ["Bread is good."], "requires_abstention": False},
    ]
    path = tmp_path / "x.jsonl"
    path.write_text("\n\n".join(map(json.dumps, rows)) + "\n  \n")
    got = evaluate.evaluate(files.read_examples(spark, str(path)))
    assert (got["n_questions"], got["answered_questions"], got["exact_answer_match"]) == (3, 1, 1.0)  # an empty answer matches an empty expectation
    assert (got["abstention_precision"], got["abstention_recall"], got["citation_coverage"], got["unsupported_claim_rate"]) == (0.5, 1.0, 1.0, 0.0)
    assert files.write_result(got | {"rows": []}, str(tmp_path / "o/p/r.json")) and json.loads((tmp_path / "o/p/r.json").read_text())["n_questions"] == 3
    path.write_text('{"question_id": "a"}\n')
    with pytest.raises(Exception, match="missing"):
        files.read_examples(spark, str(path)).collect()


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "b")], "qid string, rk int, item string")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("r", "z")], "qid string, item string")
    got = {r.qid: r for r in evaluate.retrieval_metrics(hits, rel, 5).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].mrr, got["r"].ndcg) == (0.4, 0.666667, 0.5, 0.0)
    assert got["q"].ndcg == 0.530721


@pytest.mark.parametrize("machine", list(state.MACHINES))
def test_machines(spark, machine):
    for a in schemas.PARSE:
        for b in schemas.PARSE:
            ok = (a, b) in {("pending", "running"), ("running", "complete"), ("running", "failed"), ("failed", "running")} or (machine == "projection" and (a, b) == ("complete", "running"))
            if ok:
                state.check(machine, a, b)
            else:
                with pytest.raises(state.InvalidTransition, match=a):
                    state.check(machine, a, b)
    rows = [("k", k, s) for k, s in enumerate(["pending", "running", "failed", "running", "complete", "running", None])]
    df = spark.createDataFrame(rows, "key string, seq long, status string")
    steps = state.transitions(df, machine, "key", ["seq"])
    assert [r.valid for r in steps.orderBy("seq").collect()] == [True, True, True, True, machine == "projection", False]
    assert state.retries(steps, "key").first().retry_count == 1
    with pytest.raises(Exception, match="isn't allowed"):
        state.transitions(df, machine, "key", ["seq"], strict=True).collect()


def event(k, kind, at=0, **more):
    return json.dumps({"event_id": f"e{k}", "event_type": kind, "doc_id": "d", "version_id": "v", "occurred_at": f"2024-01-01T00:{at:02d}:00Z"} | more)


def test_events(spark, tmp_path):
    lines = [event(k, t, k) for k, t in enumerate(schemas.EVENT_TYPES)] + [event(2, "body_chunks_indexed", 2), "{broken", event(99, "unknown_kind")]
    df = state.decode(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert df.where("is_valid").count() == 9
    flags = state.searchable(df.where("is_valid"), ["doc_id", "version_id"]).first()
    assert flags.is_body_searchable and flags.is_enriched_searchable and flags.completed == 8
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    for name, frame, mode in (("flags", stream.flags(stream.read_events(spark, str(tmp_path / "in"))), "update"), ("rate", stream.throughput(stream.read_events(spark, str(tmp_path / "in"))), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    got = spark.table("flags").first()
    assert got.n_events == 8 and got.is_body_searchable
    assert spark.table("rate").agg(F.sum("n")).first()[0] == 10  # a broken event has no time


def test_stream_of_statuses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, part in enumerate([["pending", "running"], ["failed", "complete"]]):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"key": "a", "seq": 2 * k + i, "status": s}) for i, s in enumerate(part)))
    rows = spark.readStream.schema("key string, seq long, status string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream.check_statuses(rows, "parse").writeStream.format("memory").queryName("steps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.seq, r.valid) for r in spark.table("steps").collect()) in ([(1, True), (2, True), (3, False)], [(0, False), (1, True), (3, False)])


def test_files(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc" * 70_000)
    row = files.file_hashes(spark, str(tmp_path / "f.bin")).first()
    assert row.sha256 == hashlib.sha256(b"abc" * 70_000).hexdigest()
    docs = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "doc_id string, version int, source string")
    more = files.reingest(docs, docs.where("doc_id = 'a'"))
    assert more.count() == 3 and {(r.doc_id, r.version) for r in files.latest_versions(more).collect()} == {("a", 2), ("b", 1)}
    assert files.status(more, "a").first().version == 2
    assert files.with_defaults(spark.createDataFrame([(None, None)], "language string, citation_density double"), "chunks").first() == ("en", 0.0)
    for ddl in (schemas.EVIDENCE, schemas.SENTENCE, schemas.DOCUMENT, schemas.CHUNK, schemas.PROJECTION, schemas.RUN, schemas.EVENT):
        assert spark.createDataFrame([], ddl).columns


def test_extensions(spark):
    chunks = spark.createDataFrame([("a", None, "p", True, ["X"]), ("b", "a", "q", False, ["X"])], "chunk_id string, parent_chunk_id string, text string, is_enriched_searchable boolean, authors array<string>")
    assert {r.chunk_id: r.parent_text for r in extensions.with_parents(chunks).collect()} == {"a": None, "b": "p"}
    assert [r.chunk_id for r in extensions.by_author(chunks, "X").collect()] == ["a"]
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "qid string, rk int, item string")
    b = spark.createDataFrame([("q", 1, "y")], "qid string, rk int, item string")
    assert [r.item for r in extensions.fuse(a, b).orderBy("rk").collect()] == ["y", "x"]
