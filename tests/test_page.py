"""The page sink writes every row."""

from linkscope.plans import sinks


def test_page_holds_all_rows(spark, tmp_path):
    sinks.page(str(tmp_path / "p.html"), "t", {"a": spark.range(1203), "none": spark.range(0)})
    text = (tmp_path / "p.html").read_text()
    assert all(f"<td>{i}</td>" in text for i in range(1203)) and text.count("<tr><td>") == 1203 and "<h2>none</h2>" in text
