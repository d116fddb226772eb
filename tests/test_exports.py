"""Single files from parts: the same bytes as the standard library's writers give."""

import csv
import io
import json

import pytest

from quillflow.operators.relational import aligned, export_frame
from quillflow.sources import sinks

TEXTS = ['a "q", b\nline', "", None, "plain", "cr\rhere", "comma, y", "ñandú 漢字 é", " spaced ", '"', "tab\there", "back\\slash / slash"]


@pytest.mark.parametrize("n", [0, 1, 200])
def test_files(spark, tmp_path, n):
    rows = [(n - i, TEXTS[i % len(TEXTS)], 1990 + i if i % 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "numero_doc int, autores string, ano int").repartition(5)
    sinks.csv_file(df, str(tmp_path / "x.csv"))
    frame = export_frame(df)
    want = io.StringIO()
    writer = csv.writer(want, lineterminator="\n")
    writer.writerow(frame.columns)
    writer.writerows(["" if v is None else v for v in r] for r in frame.collect())
    assert (tmp_path / "x.csv").read_bytes() == b"\xef\xbb\xbf" + want.getvalue().encode()
    sinks.json_file(df, str(tmp_path / "x.json"))
    objects = [r.asDict() for r in aligned(df).orderBy("numero_doc").collect()]
    if n:
        assert (tmp_path / "x.json").read_text() == json.dumps(objects, ensure_ascii=False, indent=2)
    else:
        assert json.loads((tmp_path / "x.json").read_text()) == []
    sinks.csv_file(df.limit(0), str(tmp_path / "x.csv"))  # an older file is replaced
    assert (tmp_path / "x.csv").read_bytes().count(b"\n") == 1
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")) == ["x.csv", "x.json"]
