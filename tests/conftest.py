import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import get_spark
    s = get_spark("local[4]", 4, app_name="evalspark-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="evalspark-test-ckpt-")})
    yield s
    s.stop()
