"""Delimited files whose widest row comes late."""

from salesprism.sources import loading as LD


def test_cells_of_a_late_wider_row_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i},x\n" for i in range(300)) + "300,x,late,later\n")
    rows = {r["cells"][0]: r["cells"] for r in LD.read_delimited(spark, f"{tmp_path}/a.csv").collect()}
    assert rows["300"] == ["300", "x", "late", "later"] and rows["0"] == ["0", "x", None, None] and len(rows) == 301
