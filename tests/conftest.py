import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.schema import LIBRARY  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "100000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def library(spark):
    """Builds a library from dicts; what a record leaves out is empty."""

    def build(*records):
        rows = []
        for seq, record in enumerate(records):
            row = {
                "id": str(seq + 1), "seq": seq, "title": "", "url": "#", "article_preview": "", "content": "",
                "source_file_id": "s", "source_file_name": "s.csv", "detected_language": "en", "tags": [],
                "instapaper_url": "", "provider": "instapaper", "is_favorite": False, "deleted_at": None,
            } | record
            rows.append(tuple(row[f.name] for f in LIBRARY.fields))
        return spark.createDataFrame(rows, LIBRARY)

    return build


def ids(frame):
    return [r["id"] for r in frame.select("id").collect()]
