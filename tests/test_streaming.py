"""Incremental JSON → Parquet ingest gives the batch result, file by file."""

from __future__ import annotations

import json

from vitrine.plans.pipeline import catalog_from_json
from vitrine.streaming import start_silver_sink, stream_catalog


def _record(i: int) -> dict:
    return {
        "id": str(i),
        "data": {
            "appid": i, "name": f"item {i}", "genre": "Action, Indie", "price": str(100 * i),
            "positive": 10 * i, "negative": i, "platforms": {"linux": i % 2 == 0, "mac": False, "windows": True},
            "release_date": f"Oct {i}, 20{10 + i}",
        },
    }


def test_stream_ingest_matches_batch(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    out = str(tmp_path / "silver")
    ckpt = str(tmp_path / "ckpt")
    (src / "part-1.json").write_text("\n".join(json.dumps(_record(i)) for i in range(1, 4)) + "\n")

    q = start_silver_sink(stream_catalog(spark, str(src)).drop("languages_array", "genre_array"), out, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3

    # a second file: only the new records are appended
    (src / "part-2.json").write_text("\n".join(json.dumps(_record(i)) for i in range(4, 6)) + "\n")
    q = start_silver_sink(stream_catalog(spark, str(src)).drop("languages_array", "genre_array"), out, ckpt)
    q.awaitTermination(120)
    silver = spark.read.parquet(out)
    assert silver.count() == 5

    batch = catalog_from_json(spark, str(src)).select("app_id", "price_eur", "release_year", "positive_ratio")
    assert batch.exceptAll(silver.select(*batch.columns)).count() == 0
