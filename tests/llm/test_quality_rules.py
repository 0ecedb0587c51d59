import random

import duckdb

from meterql.llm import quality_rules as rules
from tests.llm.helpers import docs


def texts():
    rng = random.Random(9)
    clean = lambda n: " ".join(rng.choice("walk house tree river stone cloud morning letter".split()) + str(rng.randrange(99)) for _ in range(n))
    line = clean(25)
    return [None, "", " \n\t ", "short text", clean(60), clean(60) + " ###", " ".join(w + "###" for w in clean(60).split()), "same " * 60, "\n".join([line] * 5 + [clean(30)]),
            clean(40).upper(), "a b c d e f g h i j k l m n o p q r s t u v", "x" * 5000, clean(3000) + "\n" + line + " " + line, (line + "\n\n") * 3, "é漢 " * 30, clean(19) + "\x0bword\x0c|"]


def expected(found, policy):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(found)))
    result = con.sql(rules.ledger_sql(policy))
    return result.columns, sorted(result.fetchall())


def test_ledger_against_sql(spark):
    found = texts()
    for policy in rules.POLICIES:
        columns, want = expected(found, policy)
        got = rules.judge(rules.ledger(docs(spark, found, extra=["n_words", "__x", "failed_bits"])), policy)
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_repeat_words_by_hand(spark):
    words = "a b c d e f g h".split()
    text = " ".join([*words, "i", *words, *"1 2 3 4 5".split()])
    (row,) = rules.ledger(docs(spark, [text])).collect()
    assert (row.n_words, row.n_repeat_words, row.word_chars) == (22, 16, 22)


def test_empty_and_null_fail_one_rule(spark):
    assert [r.failed_bits for r in rules.ledger(docs(spark, [None, "", " "])).collect()] == [rules.BITS["too_few_words"]] * 3
    assert rules.ledger(docs(spark, [])).collect() == []


def test_stage_keeps_rows_and_columns(spark):
    found = texts()
    frame = docs(spark, [*found, found[4]], [*range(len(found)), 4], ["kept", "n_words"])
    out = rules.keep_good(frame)
    columns, want = expected(found, rules.DEFAULT_POLICY)
    kept = [r[0] for r in want if r[columns.index("kept")]]
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == sorted([*kept, 4])


def test_ablation_counts(spark):
    entries = rules.ledger(docs(spark, texts())).cache()
    bits = [r.failed_bits for r in entries.collect()]
    mask = rules.POLICIES["v2"]
    for r in rules.ablation(entries, "v2").collect():
        assert r.n_failed == sum(b & r.bit > 0 for b in bits)
        assert r.n_kept_without == sum(b & mask & ~r.bit == 0 for b in bits)
        assert r.n_only_this == sum(b & mask == r.bit for b in bits)


def test_no_python_in_the_plan(spark):
    frame = rules.judge(rules.ledger(docs(spark, ["a"])))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_of_any_name_pass(spark):
    frame = docs(spark, texts()[:6], extra=["__q_text", "__q_bits", "row", "n_words"])
    out = rules.keep_good(frame)
    assert out.columns == frame.columns and {(r["__q_text"], r["__q_bits"], r["row"], r["n_words"]) for r in out.collect()} <= {("x", "x", "x", "x")}


def test_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    assert {r.doc_id for r in rules.ledger(docs(spark, ["a", "b"], [big, None])).collect()} == {big, None}
