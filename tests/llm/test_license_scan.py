import random
import re

from tunedata.llm import license_scan as L


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def sh(ws):
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def brute(rows):
    out = {}
    for i, text in rows:
        s = sh(words(text))
        for name, t in L.TEMPLATES.items():
            part = set(sh(words(t)))
            reach = 1
            while reach < len(part):
                reach *= 2
            for start in range(0, len(s), reach):
                m = len(part & set(s[start : start + 2 * reach]))
                if m >= 0.8 * len(part):
                    out[i, name] = max(out.get((i, name), (0, 0)), (m, -start))
    return {(*k, m, -back) for k, (m, back) in out.items()}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, size int")
    got = L.scan(docs).collect()
    assert {(r.doc_id, r.license, r.matched, r.first_word) for r in got} == brute(rows)
    assert all(r.containment == r.matched / r.size >= 0.8 for r in got) and len(got) == len({(r.doc_id, r.license) for r in got})
    return got


def test_templates_are_found_whole_and_in_part(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "the", "license", "under"]) for _ in range(n))
    rows = [(1000, None), (1001, ""), (1002, "under the mit"), (1003, "Released under the MIT License."), (1004, "RELEASED -- under\nthe (mit) license!" * 40)]
    for k, t in enumerate(L.TEMPLATES.values()):
        rows.append((k, filler(rng.randrange(90)) + " " + t + " " + filler(rng.randrange(60))))
        ws = t.split()
        ws[len(ws) // 2] = "changed"
        rows.append((100 + k, filler(30) + " " + " ".join(ws) + " " + filler(200)))
        rows.append((200 + k, " ".join(t.split()[: len(t.split()) // 2])))
    got = check(spark, rows)
    assert {r.license for r in got if r.doc_id < 100} == set(L.TEMPLATES)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = check(spark, [(r.doc_id, r.text) for r in docs])
    assert got


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(docs).collect() == []
    t = L.TEMPLATES["mit-line"]
    rows = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in L.scan(rows).collect()) == ["1", "None"]


def test_no_python_in_the_plan(spark):
    plan = L.op7_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
