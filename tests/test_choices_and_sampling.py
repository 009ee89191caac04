"""Q7-Q9, Q13-Q16, L5, C5, C7 on hand-written rows and against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import docs_df
from pyspark.sql import functions as F
from spantide.operators import choices as QC
from spantide.operators import qa as Q
from spantide.operators import sampling as S
from spantide.plans import pipelines as L

TEXT = "It cost €12 in 1999. Or 15 % in 2001! The 3rd run took 12 km. Nothing here. Then 7 and 8 and 9?\nIn 1999, again. no end"


def md5(*parts):
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def test_choices_hold_one_correct_answer(spark):
    docs = docs_df(spark, [TEXT, "Only 5 here.", "", "None at all."])
    got = QC.mc_inputs(docs).collect()
    pools = {0: 9, 1: 1}
    assert Counter(r["doc_id"] for r in got) == {0: 10, 1: 1}
    for r in got:
        right = [c["answer"] for c in r["choices"] if c["correct"]]
        assert right == [r["answer"]]
        assert len(r["choices"]) == min(4, pools[r["doc_id"]])
        assert r["qg_input"] == f"{Q.ANSWER_TOKEN} {r['answer']} {Q.CONTEXT_TOKEN} {r['sentence']}"
        assert r["sentence"][r["begin"]:r["begin"] + len(r["answer"])] == r["answer"]


def plain_distractors(pool, e, n=4, seed="2022"):
    """The ring rule said again: walk the ring of the label, then that of the document."""
    ring = sorted(pool, key=lambda x: (md5(seed, x[1], x[0]), x[1], x[0]))
    out = []
    for members in ([x for x in ring if x[1] == e[1]], ring):
        at = members.index(e)
        out += [x for x in members[at + 1:] + members[:at] if x not in out and (members is not ring or x[1] != e[1])]
    return [x[0] for x in out][:min(n, len(pool)) - 1]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 9, 40])
def test_distractors_against_plain_rings(spark, size):
    rng = random.Random(size)
    pool = sorted({(f"t{rng.randint(0, 60)}", rng.choice("ABBBC")) for _ in range(size)})
    rows = [(d, t, lab) for d in (1, 2) for t, lab in pool] + [(1, *pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    for r in QC.distractors(df).collect():
        assert r["others"] == plain_distractors(pool, (r["text"], r["label"]))


def test_styles(spark):
    docs = docs_df(spark, [TEXT])
    every = QC.question_inputs(docs, "all")
    assert {r["style"]: r["count"] for r in every.groupBy("style").count().collect()} == {"sentences": 6, "multiple_choice": 10}
    assert QC.question_inputs(docs, "sentences").where("choices IS NOT NULL OR answer IS NULL").count() == 0
    assert QC.question_inputs(docs, "multiple_choice").where("choices IS NULL OR answer IS NOT NULL").count() == 0
    assert QC.correct_answers(every).where("answer IS NULL").count() == 0
    with pytest.raises(ValueError, match="answer style"):
        QC.question_inputs(docs, "essay")


def test_generated_questions(spark):
    docs = docs_df(spark, [TEXT, ""])
    got = L.generate_questions(docs, "multiple_choice", 3).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and all(r["question"].endswith("?") and "____" in r["question"] for r in got)
    assert L.generate_questions(docs, "all", None).count() == 16


def test_replacement_is_one_pass(spark):
    """A replaced text is not looked at again, and repeated and neighbouring spans all go."""
    rows = [("a 1 b 12 c 1", [(2, 3, "1"), (6, 8, "12"), (11, 12, "1")], "12"), ("1234", [(0, 2, "12"), (2, 4, "34")], "é😀")]
    df = spark.createDataFrame(rows, "q string, e array<struct<begin:long,end:long,text:string>>, new string")
    got = [r[0] for r in df.select(QC.replace_spans(F.col("q"), F.col("e"), F.col("new"))).collect()]
    assert got == ["a 12 b 12 c 12", "é😀é😀"]


def test_corruption_kinds(spark):
    rows = [(1, "From 1999 to 2001?", "a"), (2, "In 1999?", "b"), (3, "Nothing?", "c"), (4, "In 7?", "7"), (5, None, "d"), (6, "3 and 3?", "e"), (7, "Nothing", None)]
    pairs = spark.createDataFrame(rows, "id long, question string, answer string")
    got = {r["id"]: r for r in QC.corrupt(pairs, ["id"]).collect()}
    assert got[1]["kind"] == "entities" and got[1]["question"] in ("From 1999 to 1999?", "From 2001 to 2001?") and got[1]["answer"] == "a"
    assert (got[2]["kind"], got[2]["answer"], got[2]["question"]) == ("entity", "1999", "In 1999?")
    for k in (3, 4, 5, 6):
        assert got[k]["kind"] == "swap" and got[k]["answer"] not in (None, rows[k - 1][2]) and got[k]["question"] == rows[k - 1][1]
    assert got[7]["kind"] == "none" and got[7]["answer"] is None
    e = {r["id"]: r for r in QC.evaluator_pairs(pairs, ["id"]).collect()}
    assert len(e) == len(rows)
    for i, q, a in rows:
        assert (e[i]["label"] == 1) == (e[i]["kind"] == "kept") == ((e[i]["question"], e[i]["answer"]) == (q, a))
    alone = pairs.where("id = 3")
    assert QC.corrupt(alone, ["id"]).first()["kind"] == "none"


def plain_quotas(counts, k, share):
    n, val, open_, todo = dict(counts), {}, set(counts), set(range(k))
    q = lambda x: int(x * share + 0.5)
    while True:
        left = sorted((sum(n[c] for c in open_ if c[j]), j) for j in todo if any(c[j] for c in open_))
        label = left[0][1] if left else None
        mine = sorted(c for c in open_ if label is None or c[label])
        whole = [c for c in n if label is None or c[label]]
        lack = q(sum(n[c] for c in whole)) - sum(val.get(c, 0) for c in whole)
        total = sum(n[c] for c in mine)
        take = max(0, min(lack, total))
        for c in mine:
            val[c] = take * n[c] // total
        rest = take - sum(val[c] for c in mine)
        for c in sorted(mine, key=lambda c: (-(take * n[c] % total), c))[:rest]:
            val[c] += 1
        open_ -= set(mine)
        if label is None:
            return val
        todo.discard(label)


@pytest.mark.parametrize("seed", [1, 2])
def test_multilabel_split(spark, seed):
    rng = random.Random(seed)
    rows = [(i, *(int(rng.random() < p) for p in (0.5, 0.1, 0.03, 0.002))) for i in range(1500)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, d int")
    got = S.multilabel_split(df, cols, "id", 0.2).collect()
    want = plain_quotas(Counter(r[1:] for r in rows), 4, 0.2)
    assert Counter(tuple(r[c] for c in cols) for r in got if r["is_val"]) == {c: v for c, v in want.items() if v}
    for c in cols:
        assert abs(sum(r["is_val"] for r in got if r[c]) - 0.2 * sum(r[c] for r in got)) <= 1
    assert abs(sum(r["is_val"] for r in got) - 300) <= 1 and len(got) == 1500
    assert S.multilabel_split(df.where("false"), cols, "id").count() == 0
    assert S.multilabel_split(df, cols, "id", 0.2, seed=1).where("is_val").count() == sum(want.values())


def plain_draws(rows, n, seed=2022):
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}{seed}".encode()).hexdigest(), r[0]))
    at, line = 0, []
    for i, w in order:
        size = int(max(0.0, w or 0.0) * 2 ** 40)
        line.append((at, at + size, i))
        at += size
    out = Counter()
    for k in range(n):
        p = int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16) % at
        out[next(i for b, e, i in line if b <= p < e)] += 1
    return out


def test_draws_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.001, 0.5, 0.0, 1 / 3])) for i in range(120)] + [(500, 30.0), (501, None), (502, -1.0)]
    df = spark.createDataFrame(rows, "id long, w double")
    for n, per_bucket in ((123, 7), (1000, 1), (50, 10 ** 6)):
        got = {r["id"]: r["n"] for r in S.draws(df, "id", "w", n, per_bucket=per_bucket).collect()}
        want = plain_draws(rows, n)
        assert got == {i: want.get(i, 0) for i, _ in rows}
    assert S.draws(df.where("false"), "id", "w").count() == 0
    assert {r["n"] for r in S.draws(df.where("id > 500"), "id", "w").collect()} == {0}
