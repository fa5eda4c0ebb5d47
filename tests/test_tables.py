from pyspark.sql import functions as F

from vecbench.functions.text import bibtex_citation, resolve_prompt
from vecbench.operators.catalogops import filter_tasks
from vecbench.operators.points import rollup, violations


def test_points_rollup_and_validation(spark):
    recs = spark.createDataFrame(
        [("f1", "u1", 2, None, None), ("f2", "u1", None, 3, None), ("f3", "u2", 60, None, 1),
         ("440", "u3", 70, None, None), ("f4", "", 1, 1, None)],
        "file string, GitHub string, `New dataset` bigint, `Review PR` bigint, `Bug fixes` bigint")
    r = {x.GitHub: x for x in rollup(recs, "GitHub", ["New dataset", "Review PR", "Bug fixes"]).collect()}
    assert r["u1"].total == 5 and r["u1"]["New dataset"] == 2 and r["u2"].total == 61
    v = violations(recs, ["file"], required_nonempty=["GitHub"],
                   minima={"New dataset": 1, "Review PR": 2, "Bug fixes": 1},
                   maxima={"New dataset": 50}, exceptions_col="file", exceptions=["440"])
    got = sorted((x.file, x.rule) for x in v.collect())
    assert got == [("f3", "max:New dataset"), ("f4", "empty:GitHub"), ("f4", "min:Review PR")]


def test_bibtex_and_prompts(spark):
    bib = ["@article{x, author = {Doe, Jane and Roe, R.}, year = {2020}}",
           "@misc{y, author={Plato}, year={-380}}", "@misc{z, title={t}}", None]
    df = spark.createDataFrame([(b,) for b in bib], "b string")
    got = [r.c for r in df.select(bibtex_citation("b").alias("c")).collect()]
    assert got == [" (Doe et al., 2020)", " (Plato, -380)", "", ""]
    p = {"T1-query": "a: ", "T1": "b: ", "Retrieval": "c: ", "document": "d: "}
    rows = spark.createDataFrame([("T1", "Retrieval", "query"), ("T1", "Retrieval", "document"),
                                  ("T2", "Retrieval", "query"), ("T3", "STS", "document"),
                                  ("T3", "STS", "x")], "t string, ty string, pt string")
    got = [r.p for r in rows.select(resolve_prompt(p, F.col("t"), F.col("ty"), F.col("pt")).alias("p")).collect()]
    assert got == ["a: ", "b: ", "c: ", "d: ", None]


def test_task_filters(spark):
    tasks = spark.createDataFrame(
        [("A", "Retrieval", ["eng-Latn"], ["text"]), ("B", "STS", ["fra-Latn", "jpn-Jpan"], ["text", "image"]),
         ("C", "Retrieval", ["jpn-Jpan"], ["image"])],
        "task_name string, type string, languages array<string>, modalities array<string>")
    names = lambda d: sorted(r.task_name for r in d.collect())
    assert names(filter_tasks(tasks, languages=["fra", "jpn"])) == ["B", "C"]
    assert names(filter_tasks(tasks, scripts=["Jpan"], types=["Retrieval"])) == ["C"]
    assert names(filter_tasks(tasks, modalities=["image"])) == ["B", "C"]
    assert names(filter_tasks(tasks, modalities=["image"], exclusive_modality=True)) == ["C"]


def test_global_rank_with_hot_key(spark):
    from vecbench.operators.catalogops import global_rank
    rows = [("aa",)] * 50 + [("0f",), ("ff",), ("b1",)]
    df = spark.createDataFrame(rows, "k string").repartition(5)
    r = global_rank(df, "k", "pos", prefix=1, group_rows=7).collect()
    pos = sorted(x.pos for x in r)
    assert pos == list(range(1, 54))
    by = {}
    for x in r:
        by.setdefault(x.k, []).append(x.pos)
    assert by["0f"] == [1] and sorted(by["aa"]) == list(range(2, 52)) and by["b1"] == [52] and by["ff"] == [53]


def test_crosstab_multilingual_and_folding(spark):
    from vecbench.functions.text import fold_values
    from vecbench.operators.catalogops import crosstab
    tasks = spark.createDataFrame([(["eng", "fra"], "Retrieval"), (["eng"], "STS"), (["python"], "Retrieval")],
                                  "languages array<string>, type string")
    folded = tasks.withColumn("languages", F.transform("languages", lambda l: fold_values(l, ["python", "java"], "code")))
    x = {r.languages: r for r in crosstab(folded, "languages", "type", ["Retrieval", "STS"], explode_array=True).collect()}
    assert (x["eng"].Retrieval, x["eng"].STS, x["eng"].row_sum) == (1, 1, 2)
    assert (x["fra"].Retrieval, x["code"].Retrieval) == (1, 1)
    assert x["Total"].row_sum == 4
