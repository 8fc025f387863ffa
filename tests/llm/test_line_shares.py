"""Line rules are shares of the line: long articles stay, menus of any length go."""

from scenewright.llm import lines
from scenewright.llm.queries import SQL

ARTICLE, MORE = (" ".join(f"{w}{i} and some text" for i in range(1500)) for w in ("word", "term"))


def verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lines.clean_lines(df).select("doc_id", "cleaning.kept", "cleaning.n_good_lines").collect()
    return {r["doc_id"]: (r["kept"], r["n_good_lines"]) for r in rows}


def test_long_lines(spark):
    texts = [ARTICLE + " read more " + MORE, ARTICLE + " a | b | c " + MORE,
             ARTICLE + "\n" + " | ".join(f"Page {i}" for i in range(400)), ARTICLE + "\n" + "click here or read more " * 300,
             ARTICLE + "\nWe use cookies. Accept all cookies", ARTICLE + "\nHome | About us | Contact"]
    found = verdicts(spark, texts)
    assert all(kept for kept, _ in found.values())
    assert [found[i][1] for i in range(len(texts))] == [1] * len(texts)


def test_sql_judges_lines_alike(spark, tmp_path):
    import duckdb

    rows = list(enumerate([
        ARTICLE + " read more", "one | two | three four five six seven eight nine ten " * 3, "sign in " + "plain words here " * 30,
        "a | b | " + "c " * 10, "a | b | " + "d e " * 10, "read more " + "x1 y2 z3 q4 v5 " * 2, "read more " + "x1 y2 z3 q4 v5 w6 " * 2,
        None, "", "lines\n" * 30]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(SQL["op8_line_cleaning"])
    names = [d[0] for d in cursor.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cursor.fetchall()}
    for r in lines.clean_lines(df).select("doc_id", "cleaning.*").collect():
        assert all(r[c] == want[r["doc_id"]][c] for c in names)
