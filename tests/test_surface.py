from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sahifa.__main__ import main
from sahifa.plans.cache import ResultCache
from sahifa.sources import exporters


def test_cache_expires_and_drops_the_oldest():
    now = [0.0]
    cache = ResultCache(2, 10.0, lambda: now[0])
    a, b = cache.put("a"), cache.put("b")
    assert cache.get(a) == "a"
    c = cache.put("c")
    with pytest.raises(KeyError):
        cache.get(a)
    now[0] = 10.0
    assert (cache.get(b), cache.get(c)) == ("b", "c")
    now[0] = 10.1
    with pytest.raises(KeyError):
        cache.get(b)


def test_command_line(spark, data, tmp_path):
    (tmp_path / "in.txt").write_text("قَالَ رَسُولُ اللَّهِ كَذَا وَكَذَا " * 20, encoding="utf-8")
    main(["build", "--task", "tashkeel", "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / "ds")])
    assert spark.read.json(str(tmp_path / "ds")).count() == 2
    main(["build", "--task", "indexing", "--input", str(tmp_path / "in.txt"), "--headings", str(tmp_path / "in.txt"), "--output", str(tmp_path / "ix")])
    main(["query", "token_count", "--data", data, "--output", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 100
    (tmp_path / "p.txt").write_text("حدثنا مالك عن نافع عن ابن عمر قال : كان كذا وكذا وكذا وكذا وكذا وكذا وكذا وكذا", encoding="utf-8")
    main(["spans", "--input", str(tmp_path / "p.txt"), "--output", str(tmp_path / "s")])
    payload = json.loads(spark.read.text(str(tmp_path / "s")).first()[0])
    assert [s[2] for s in payload["spans"]] == ["ISNAD", "MATN"] and payload["usable"] is False


def test_markdown_document(spark):
    units = spark.createDataFrame([(1, "قال"), (2, " "), (3, "a|b")], "n int, output string").withColumn("doc", F.lit(1))
    body = exporters.markdown_document(units, ["doc"], "n", "output", "العنوان", {"Units": "3"}).first()["body"]
    assert body.startswith("# العنوان\n\n- **Units:** 3\n\n---\n\nقال\n\n\n\na|b\n")
