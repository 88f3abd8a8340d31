from __future__ import annotations

from salesprism.sources.loading import load


def test_fields_over_several_lines_and_plain_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Item,Note\n2024-01-01,Oil,"two\nlines, one ""cell"""\n2024-01-02,Soap,x\n')
    (tmp_path / "b.csv").write_text('Date,Item,Note\n2024-01-01,"Oil, large",y\n2024-01-02,Soap,x\n')
    assert sorted(tuple(r) for r in load(spark, f"{tmp_path}/a.csv")[0].collect()) == [("2024-01-01", "Oil", 'two\nlines, one "cell"'), ("2024-01-02", "Soap", "x")]
    table = load(spark, f"{tmp_path}/b.csv")[0]
    assert sorted(tuple(r) for r in table.collect()) == [("2024-01-01", "Oil, large", "y"), ("2024-01-02", "Soap", "x")]
