from sitesieve.operators import registry
from sitesieve.operators.extract import extract
from sitesieve.streaming.incremental import append_findings, read_stream


def test_stream_equals_batch(spark, responses, tmp_path):
    rows = [
        {"url": f"https://e.com/{i}", "html": f'<a href="/x{i}"><script src="a.js"></script>', "page_id": i}
        for i in range(6)
    ]
    frame = responses(*rows, {"status": 404, "html": '<a href="/no">', "page_id": 99})
    folder, out = tmp_path / "in", tmp_path / "out"
    for part in ("page_id < 3", "page_id >= 3"):
        frame.where(part).write.mode("append").parquet(str(folder))
        query = append_findings(read_stream(spark, str(folder)), str(out), str(tmp_path / "state"))
        query.awaitTermination()
    stored = spark.read.parquet(str(out))
    batch = extract(frame.where("status = 200"), registry.names(in_audit=True, first_page_only=False))
    columns = ["page_id", "type", "value", "source"]
    assert sorted(map(tuple, stored.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
