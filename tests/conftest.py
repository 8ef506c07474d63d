import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shredline.session import build_session, ensure_checkpoint_dir

    s = build_session("local[4]", 4, app_name="shredline-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="shredline-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="shredline-test-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shredline-test-")
