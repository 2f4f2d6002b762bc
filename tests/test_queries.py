"""Every engine query with SQL gives the same rows as DuckDB over the smallest tables."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
from evalloom import schemas  # noqa: E402
from evalloom.plans.oracle import oracle_sql  # noqa: E402
from evalloom.plans.queries import queries  # noqa: E402

DATA = os.environ.get("EVALLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    assert set(oracle_sql()) == set(queries()) - {"pass_rate_ci"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    rows = queries()[name](spark, DATA)
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, rows.collect())) == Counter(found)


def both(spark, directory, name):
    """What a query gives over the tables of a folder, and what its SQL gives."""
    rows = queries()[name](spark, str(directory))
    con = duckdb.connect()
    for file in os.listdir(directory):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{directory}/{file}{'/*.parquet' if os.path.isdir(f'{directory}/{file}') else ''}'")
    return sorted(map(tuple, rows.collect())), sorted(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({oracle_sql()[name]})").fetchall())


def test_planted_violations(spark, tmp_path):
    claim = lambda text="It is so.", citations=("a",): {"text": text, "citations": list(citations)}
    answered = lambda *claims, answer="So.": {"answer": answer, "claims": list(claims)}
    planted = {
        "fine": ("Is it?", ["a"], False, answered(claim())), "silent": ("Is it?", [], True, {"answer": None, "claims": []}),
        "Upper": ("Is it?", ["a"], False, answered(claim())), "blank": ("\u00a0 \u2003", ["a"], False, answered(claim())), "long": ("x" * 10_001, ["a"], False, answered(claim())),
        "ids": ("Is it?", ["A b"], False, answered(claim())), "twice": ("Is it?", ["a", "a"], False, answered(claim())), "flag": ("Is it?", ["a"], None, answered(claim())),
        "expects": ("Is it?", ["a"], True, answered(claim())), "nothing": ("Is it?", [], False, answered(claim())), "none": ("Is it?", ["a"], False, None),
        "answer": ("Is it?", ["a"], False, answered(claim(), answer="\u3000")), "abstains": ("Is it?", ["a"], False, answered(claim(), answer=None)), "claims": ("Is it?", ["a"], False, answered()),
        "claim": ("Is it?", ["a"], False, answered(claim(" "))), "uncited": ("Is it?", ["a"], False, answered(claim(citations=()))), "recited": ("Is it?", ["a"], False, answered(claim(citations=("a", "a")))),
        "unknown": ("Is it?", ["a", "nowhere"], False, answered(claim(citations=("No",)))),
    }
    rows = [("s", i, q, *v[:3], False, v[3]) for i, (q, v) in enumerate(planted.items())]
    spark.createDataFrame([*rows, rows[0]], schemas.QUESTIONS).write.parquet(str(tmp_path / "questions.parquet"))
    sources = [("s", i, s, "T", "u", "l", None, None, "trusted", "c", None, i) for i, s in enumerate("aab")] + [("s", 9, "c", "\u00a0", "u", "l", None, None, "trusted", "c", None, 9)]
    spark.createDataFrame(sources, schemas.DOCUMENTS + ", record_id long").write.parquet(str(tmp_path / "source_docs.parquet"))
    spark.createDataFrame([("s", "1.0", "1.0.0", None, 8, 0, 3, "overlap", 0.5)], schemas.SUITES).write.parquet(str(tmp_path / "suites.parquet"))
    got, want = both(spark, tmp_path, "question_violations")
    assert got == want and {q: v for _, q, v in got} == {
        "Upper": "question_id", "blank": "text", "long": "text", "ids": "expected_source_ids", "twice": "repeated_expected_source", "flag": "no_answer", "expects": "expectation", "nothing": "expectation", "none": "response",
        "answer": "answer", "abstains": "claims", "claims": "claims", "claim": "claim_text", "uncited": "citations", "recited": "repeated_citation", "unknown": "citations",
    }
    got, want = both(spark, tmp_path, "repeated_ids")
    assert got == want == [("question", "s", "fine", 2), ("source", "s", "a", 2)]
    got, want = both(spark, tmp_path, "unknown_expected_sources")
    assert got == want == [("s", "ids", "A b"), ("s", "unknown", "nowhere")]
    got, want = both(spark, tmp_path, "contract_violations")
    assert got == want and (9, "title,observed_at,sha256") in got


def test_index_guards(spark):
    from evalloom.operators.scoring import Index, retrieve
    from evalloom.sources.contract import ContractError

    chunks = spark.createDataFrame([("s", "c1", "one two three"), ("s", "c2", "two"), ("t", "c1", "")], "suite_id string, chunk_id string, text string")
    asked = spark.createDataFrame([("s", "q", "two three"), ("t", "q", "two"), ("u", "q", "two")], "suite_id string, question_id string, text string")
    suites = lambda k: spark.createDataFrame([("s", k, None), ("t", k, 0.5)], "suite_id string, retrieval_k int, hybrid_weight double")
    index = Index(chunks, asked).check()
    for strategy in ("overlap", "bm25", "tfidf", "hashing", "hybrid"):
        hits = retrieve(strategy, index, suites(1000)).orderBy("rank").collect()
        assert [(r.suite_id, r.question_id, r.rank) for r in hits][:1] == [("s", "q", 1)] and hits[0].chunk_id == "c1", strategy
    assert retrieve("bm25", index, suites(None)).count() == 0
    for bad in (lambda: Index(chunks.limit(0), asked).check(), lambda: Index(chunks.unionByName(chunks), asked).check(), lambda: retrieve("bm25", index, suites(1001)), lambda: retrieve("bm25", index, suites(0))):
        with pytest.raises(ContractError):
            bad()
    with pytest.raises(ValueError):
        retrieve("other", index, suites(1))


def test_pass_rate_ci(spark):
    got = queries()["pass_rate_ci"](spark, DATA).collect()
    assert got and all(r.lower <= r.mean <= r.upper for r in got)


def test_suites_are_judged_by_their_own_strategy(spark):
    own = {r.suite_id: r.mean for r in queries()["pass_rate_ci"](spark, DATA).collect()}
    rates = {r.suite_id: r.pass_rate for r in queries()["own_suite_metrics"](spark, DATA).collect()}
    assert own.keys() == rates.keys() and all(abs(own[s] - rates[s]) < 2e-6 for s in own)


def test_streams_and_tables(spark, tmp_path):
    from evalloom.operators import corpus
    from evalloom.runtime import read_table
    from evalloom.sources import tables
    from evalloom.sources.contract import ContractError
    from evalloom.streaming import chunk_stream

    documents, suites = tables.read(spark, f"{DATA}/source_docs.parquet", "documents"), read_table(spark, DATA, "suites")
    tables.write(documents.repartition(3), str(tmp_path / "in"), "orc")
    again = tables.read(spark, str(tmp_path / "in"), "documents", "orc")
    stream = chunk_stream(spark.readStream.schema(again.schema).orc(str(tmp_path / "in")), suites)
    stream.writeStream.format("memory").queryName("chunked").trigger(availableNow=True).start().awaitTermination(120)
    batch = corpus.chunk(corpus.validate(documents, suites).where("valid"))
    assert Counter(spark.table("chunked").collect()) == Counter(batch.collect())
    with pytest.raises(ContractError):
        tables.read(spark, f"{DATA}/suites.parquet", "documents")
