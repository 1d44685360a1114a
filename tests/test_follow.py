"""Growing files as streams: each record once over restarts."""

import pytest
from pyspark.sql import functions as F

from flowspark.sources import follow
from test_captures import SHOWN, pcap_bytes, pcapng_bytes, whole

LOG = "#separator \\x09\n#fields\tts\tuid\tid.orig_h\n"


def drain(df, out, checkpoint):
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_zeek_lines_once(spark, tmp_path):
    logs, out, ck = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")
    logs.mkdir()
    (logs / "conn.log").write_text(LOG + "1.0\ta\t10.0.0.1\n2.0\tb\t10.0.0.2\n3.0\tcut")
    (logs / "none.log").write_text("no header\n")
    drain(follow.stream_zeek(spark, str(logs), 40), out, ck)
    first = spark.read.parquet(out)
    assert sorted(r["fields_raw"]["uid"] for r in first.collect()) == ["a", "b"]
    with (logs / "conn.log").open("a") as f:
        f.write("\t10.0.0.3\n4.0\td\t10.0.0.4\n")
    (logs / "dns.log").write_text(LOG + "5.0\te\té\n")
    drain(follow.stream_zeek(spark, str(logs), 40), out, ck)
    got = spark.read.parquet(out).orderBy(F.col("fields_raw")["ts"]).collect()
    assert [r["fields_raw"]["uid"] for r in got] == ["a", "b", "cut", "d", "e"]
    assert len({(r["file_path"], r["at"]) for r in got}) == 5


@pytest.mark.parametrize("data,name", [(pcap_bytes(300), "a.pcap"), (pcapng_bytes(300), "a.pcapng")])
def test_captures_once(spark, tmp_path, data, name):
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    (folder / name).write_bytes(data[:50_001])
    drain(follow.stream_captures(spark, str(folder), 30_000), out, ck)
    some = spark.read.parquet(out).count()
    with (folder / name).open("ab") as f:
        f.write(data[50_001:])
    drain(follow.stream_captures(spark, str(folder), 30_000), out, ck)
    (tmp_path / "whole.pcap").write_bytes(pcap_bytes(300))
    want = sorted(tuple(r) for r in whole(spark, str(tmp_path / "whole.pcap")).select(*SHOWN).collect())
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*SHOWN).collect())
    assert 0 < some < len(want) and got == want
