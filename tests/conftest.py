import datetime as dt

import pytest
from pyspark.sql import SparkSession

LINES = (
    "id string, doc_id string, file_name string, ancestor_id string, ancestor_type string, facs_id string, image_info_url string, image_jpg_url string, lang array<string>, is_in_note string, contains_abbr string, "
    "contains_sic string, source_sic string, source_corr string, target_sic string, target_corr string, nonbreaking_next_line string, file_pos bigint, exported_at timestamp"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_lines(spark):
    """Line tables from dicts; ids default to one page, text to the id, extra columns with clashing names come along."""

    def make(rows, extra=True):
        names = [c.split()[0] for c in LINES.split(", ")]
        full = []
        for n, r in enumerate(rows):
            base = dict.fromkeys(names)
            base.update(doc_id="W0000001", file_pos=n + 1, exported_at=dt.datetime(2024, 1, 1), nonbreaking_next_line="")
            base.update(r)
            full.append(tuple(base[c] for c in names))
        df = spark.createDataFrame(full, LINES)
        return df.selectExpr("*", "'x' as root_id", "1 as depth", "'y' as text", "0 as pos", "'z' as split", "'w' as cid", "0 as _rn", "'k' as kind") if extra else df

    return make


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)
