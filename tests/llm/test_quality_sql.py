"""The quality rules and their SQL on pages that share several notices."""

import duckdb
import pandas as pd

from faultline.llm import quality, sql
from tests.compare import differences


def pages():
    notices = ["This site uses cookies to remember you and your visits to it", "All rights reserved", "Contact us by post"]
    rows = [(i, "\n".join([*notices, f"Own line {i}"]), "shop") for i in range(40)]
    # copies count once, and hosts apart
    rows += [(100 + i, "Copied line\nsecond copied line of the page", "shop") for i in range(30)]
    rows += [(200 + i, "\n".join([f"Text {i} of ten words and more that stays as it is", *notices[:1]]), "news") for i in range(8)]
    return [*rows, (300, None, "shop"), (301, "", None), (302, notices[0].upper() + "  ", "shop")]


def test_shared_notices_are_cut_by_operator_and_sql(spark):
    rows = pages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert {got[i].n_lines_cut for i in range(40)} == {3} and not any(got[i].kept for i in range(40))
    assert {got[100 + i].n_lines_cut for i in range(30)} == {0} and {got[200 + i].n_lines_cut for i in range(8)} == {0}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert differences(quality.judge(docs), con, sql.QUALITY) == []
