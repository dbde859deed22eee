"""Files in the shared folder are made without checksum files and chmod calls of their own, whose processes count as an executor's memory."""

from pathlib import Path

from trawlspark.llm.common import local_path, shared_dir, written


def test_tables_leave_no_checksum_files(spark):
    folder = Path(local_path(shared_dir(spark)))
    crc = lambda: {p for p in folder.rglob(".*.crc")}
    before = crc()
    df = written(spark.range(0, 1000, 1, 4), "rows")
    assert df.count() == 1000
    assert crc() == before
