import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path):
    """Tests name their own folder for written tables."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
