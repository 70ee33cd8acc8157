import math
import re
from collections import Counter

import pytest

from rankforge.llm import licenses as lic
from rankforge.llm import queries

from .edges import ROWS, documents

SF = "/root/testdata/sf0.01"
NAMES = {"GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "MIT License": "MIT",
         "Apache License, Version 2.0": "Apache-2.0"}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\n" + "\n".join(lic.TEMPLATES["MIT"])), ("a/x.py", "print(1)"), ("a/b/y.py", "y = 2"),
        ("a/b/z.py", "# Licensed under the Apache License, Version 2.0.\n" + "code = 1\n" * 9), ("a/c/COPYING", lic.TEMPLATES["GPL-3.0"][1]),
        ("a/c/d/e/deep.c", "int x;"), ("b/none.txt", None), ("top.txt", ""), (None, "orphan text"),
        ("ab/x.py", "not below a"), ("a/c/licensing-talk.md", "We talked about a license for a while and left."),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id int, path string, text string")
    return {r.path: r for r in lic.resolve(df.repartition(3)).collect()}


def test_declared_and_inherited(tree):
    got = {p: (r.license, r.origin, r.license_folder) for p, r in tree.items()}
    assert got["a/LICENSE"][:2] == ("MIT", "declared")
    assert got["a/x.py"] == ("MIT", "inherited", "a")
    assert got["a/b/y.py"] == ("MIT", "inherited", "a")
    assert got["a/b/z.py"][:2] == ("Apache-2.0", "declared")
    assert got["a/c/COPYING"][:2] == ("GPL-3.0", "declared")
    assert got["a/c/d/e/deep.c"] == ("GPL-3.0", "inherited", "a/c")
    assert got["a/c/licensing-talk.md"] == ("GPL-3.0", "inherited", "a/c")
    for p in ("b/none.txt", "top.txt", None, "ab/x.py"):
        assert got[p] == (None, "none", None)


def test_top_folder_licence_reaches_everything(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "x/y/z.py", "z"), (3, "q", "")],
                               "doc_id int, path string, text string")
    assert {r.doc_id: (r.license, r.license_folder) for r in lic.resolve(df).collect()} == {
        1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", "")}


def test_declared_licences_of_the_sample(spark):
    rows = queries.op6_license_inheritance(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    said = 0
    for r in rows:
        want = {v for k, v in NAMES.items() if k in texts[r.doc_id]}
        if len(want) == 1:
            said += 1
            assert r.origin == "declared" and r.license in want
        elif not want:
            assert r.origin != "declared"
    assert said > 5


def test_cosine_equals_plain_python(spark):
    text = "Released under the MIT License, roughly."
    corpus = spark.createDataFrame([(text,), ("the other text",), ("MIT",)], "t string")
    df = spark.createDataFrame([(7, text)], "row long, t string")
    got = lic.declared(corpus, df, 0.3).first()
    lines = lic.template_lines(lic.TEMPLATES)
    terms = sorted({w for _, _, c in lines for w in c})
    seen = Counter(w for t in (text, "the other text", "MIT") for w in set(re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", t.lower())))
    idf = {w: 1 + math.log(4 / (seen[w] + 1)) for w in terms}
    top = max(idf.values())
    mine = {w: idf.get(w, top) for w in re.findall("[a-z]+", text.lower())}
    best = 0
    for _, _, c in lines:
        dot = sum(mine.get(w, 0) * n * idf[w] for w, n in c.items())
        best = max(best, dot / math.sqrt(sum(x * x for x in mine.values()) * sum((n * idf[w]) ** 2 for w, n in c.items())))
    assert got.license == "MIT" and abs(got.cosine - best) < 1e-6


def test_template_lines_need_a_licence_word():
    with pytest.raises(ValueError):
        lic.template_lines({"x": ["no such word"]})


def test_edges(spark):
    from pyspark.sql import functions as F
    df = documents(spark, clash=True).withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    got = lic.resolve(df).collect()
    assert len(got) == len(ROWS) and {r.origin for r in got} == {"none"}
    assert lic.resolve(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = queries.op6_license_inheritance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
